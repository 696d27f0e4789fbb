"""Corpus tokenisation: words to pieces, one job over the distinct words."""

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pac
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from ..session import stored_rows

UNKNOWN = "[UNK]"
LONGEST_WORD = 100


def word_pieces(word: str, vocabulary: set[str], longest: int = LONGEST_WORD) -> list[str]:
    """Greedy longest pieces of one word; later pieces carry ``##``; unknown where it cannot be cut."""
    if len(word) > longest:
        return [UNKNOWN]
    found, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        stop = next((s for s in range(len(word), at, -1) if mark + word[at:s] in vocabulary), None)
        if stop is None:
            return [UNKNOWN]
        found.append(mark + word[at:stop])
        at = stop
    return found


# Fixed value: words of byte-pair texts; a space belongs to the word after it.
BYTE_WORDS = r"('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+)"


def byte_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BYTE_WORDS), 1)


def byte_letters(word: str) -> list[str]:
    """The UTF-8 bytes of a word as visible letters: printable bytes as they are, the others from U+0100 on."""
    def visible(x):
        return 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255

    hidden = [x for x in range(256) if not visible(x)]
    return [chr(x) if visible(x) else chr(256 + hidden.index(x)) for x in word.encode("utf-8")]


def byte_pairs(letters: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the best-ranked neighbours of a list of letters, all their places from the left, until none is left.

    Places are kept per pair and the open pairs in a heap, so a long word costs little more
    than its length.
    """
    parts, after, before = list(letters), list(range(1, len(letters) + 1)), list(range(-1, len(letters) - 1))
    places: dict[tuple[str, str], set[int]] = defaultdict(set)
    heap: list[tuple[int, tuple[str, str]]] = []

    def note(i):
        if i >= 0 and after[i] < len(parts):
            pair = (parts[i], parts[after[i]])
            if pair in ranks:
                if not places[pair]:
                    heapq.heappush(heap, (ranks[pair], pair))
                places[pair].add(i)

    def forget(i):
        if i >= 0 and after[i] < len(parts):
            places[parts[i], parts[after[i]]].discard(i)

    for i in range(len(parts)):
        note(i)
    while heap:
        pair = heapq.heappop(heap)[1]
        for i in sorted(places.pop(pair, ())):
            j = after[i]
            if parts[i] != pair[0] or j >= len(parts) or parts[j] != pair[1]:
                continue
            forget(before[i])
            forget(i)
            forget(j)
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            note(before[i])
            note(i)
    return [p for p in parts if p is not None]


# Words to pieces, as frames: (word) to (word, pieces). ------------------------------------


def by_broadcast(split_words, shared):
    """Cut each distinct word with ``split_words(word, shared)``; for a ``shared`` of known, small size.

    It goes to each executor once. A vocabulary or merges of any size are joined instead
    (``by_vocabulary``, ``by_merges``).
    """
    def cut(words: DataFrame) -> DataFrame:
        sent = words.sparkSession.sparkContext.broadcast(shared)

        def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(lambda w: split_words(w, sent.value))

        return words.withColumn("pieces", F.pandas_udf(split, "array<string>")("word"))

    return cut


def _spans(words: DataFrame, least: int, most: Column) -> DataFrame:
    """All parts of each word with ``least`` to ``most`` letters: word, first (from 0), part."""
    starts = words.filter(F.length("word") >= least).withColumn("first", F.explode(F.sequence(F.lit(0), F.length("word") - least)))
    last = F.least(most, F.length("word") - F.col("first"))
    sizes = F.explode(F.when(last >= least, F.sequence(F.lit(least), last)))
    return starts.withColumn("size", sizes).select("word", "first", F.expr("substring(word, first + 1, size)").alias("part"))


def by_vocabulary(vocabulary: DataFrame, longest: int = LONGEST_WORD):
    """Greedy longest pieces of each word, from a vocabulary frame with a column ``piece``.

    The parts of the distinct words are joined with the vocabulary; the longest known part
    from each letter on is a step, and a word's pieces are the steps from its first letter.
    Later pieces carry ``##``. A word that the steps do not cover, or longer than
    ``longest``, is unknown. Only parts as long as a piece can be are made. Pieces of one
    letter, no more than there are letters in Unicode, are looked up in the tasks instead: nearly
    every letter would be a row, and a frequent letter a key of many rows.
    """
    def cut(words: DataFrame) -> DataFrame:
        listed = vocabulary.select("piece").filter("piece != ''").distinct()
        marked = F.col("piece").startswith("##") & (F.length("piece") > 2)
        # A piece that begins with the mark is also a beginning of words that do.
        later = F.when(marked, F.length("piece") - 2)
        sizes = listed.agg(F.max(F.length("piece")).alias("first"), F.max(later).alias("later")).first()
        single = [r.piece for r in listed.filter((F.length("piece") == 1) | (later == 1)).collect()]
        sent = words.sparkSession.sparkContext.broadcast(frozenset(single))

        short = words.filter(F.length("word").between(1, longest))
        most = F.when(F.col("first") == 0, F.least(F.length("word"), F.lit(sizes["first"] or 0))).otherwise(
            F.least(F.length("word") - F.col("first"), F.lit(sizes["later"] or 0))
        )
        piece = F.concat(F.when(F.col("first") > 0, "##").otherwise(""), "part")
        step = F.col("first") * (longest + 1) + F.length("part")
        found = _spans(short, 2, most).select("word", step.alias("step"), piece.alias("piece"))
        steps = found.join(listed.hint("shuffle_hash"), "piece").groupBy("word").agg(F.collect_list("step").alias("steps"))

        def walked(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, known in columns:
                lists = [_walk(w, s, sent.value, longest) for w, s in zip(texts.to_pylist(), known.to_pylist())]
                yield pa.array(lists, pa.list_(pa.string()))

        pieces = F.arrow_udf(walked, ArrayType(StringType()))
        return words.join(steps.hint("merge"), "word", "left").select("word", pieces("word", "steps").alias("pieces"))

    return cut


def _walk(word: str | None, steps: list[int] | None, single: frozenset[str], longest: int) -> list[str]:
    """The pieces of a word by the places and sizes of its known longer parts and the known pieces of one letter."""
    if word is None or not 0 < len(word) <= longest:
        return [UNKNOWN]
    sizes = dict(divmod(step, longest + 1) for step in sorted(steps or ()))
    found, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        size = sizes.get(at) or (mark + word[at] in single)
        if not size:
            return [UNKNOWN]
        found.append(mark + word[at:at + size])
        at += size
    return found


def visible_letters(word: Column) -> Column:
    """The UTF-8 bytes of a word as visible letters, one a byte (``byte_letters`` as a column)."""
    hidden = [chr(x) for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255)]
    return F.translate(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "".join(hidden), "".join(chr(256 + k) for k in range(len(hidden))))


@F.pandas_udf(ArrayType(StringType()))
def _merged(words: pd.Series, rules: pd.Series) -> pd.Series:
    return pd.Series([byte_pairs(list(w), {} if r is None else {(x["left"], x["right"]): x["rank"] for x in r}) for w, r in zip(words, rules)])


def by_merges(merges: DataFrame):
    """Byte-pair pieces of each word of visible letters, from a frame of merges: rank, left, right.

    A merge can happen in a word only where the two sides together are part of it, so the parts
    of the distinct words are joined with the merges, and each word is merged with the few that
    it met. A pair that is listed twice has its last rank.
    """
    def cut(words: DataFrame) -> DataFrame:
        rules = merges.groupBy("left", "right").agg(F.max("rank").alias("rank")).withColumn("part", F.concat("left", "right"))
        longest = rules.agg(F.coalesce(F.max(F.length("part")), F.lit(2)).alias("n")).scalar()
        met = _spans(words.filter(F.length("word") > 1), 2, longest).select("word", "part").distinct().join(rules, "part")
        own = met.groupBy("word").agg(F.collect_list(F.struct("rank", "left", "right")).alias("rules"))
        return words.join(own, "word", "left").select("word", _merged("word", "rules").alias("pieces"))

    return cut


def tokenise(texts: DataFrame, key: str, toks: str, cut, shared=None) -> DataFrame:
    """Pieces of every text: (key, pieces array<string>).

    ``cut`` makes pieces of a frame of words (``by_vocabulary``, ``by_merges``), or of one word
    with ``shared`` (``by_broadcast``). Each distinct word is cut once; frequent words then
    meet their texts in a join that adaptive execution may split. A text without words has no
    pieces.
    """
    cut = cut if shared is None else by_broadcast(cut, shared)
    flat = texts.select(key, F.posexplode(toks).alias("pos", "word"))
    joined = flat.join(cut(flat.select("word").distinct()), "word").select(key, F.struct("pos", "pieces").alias("piece"))
    every = texts.select(key).withColumn("piece", F.lit(None).cast(joined.schema["piece"].dataType))
    return joined.unionByName(every).groupBy(key).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x.pieces)).alias("pieces")
    )


#: The pieces of so many words, the most frequent ones, are counted on the row.
FREQUENT_WORDS = 20_000


def token_counts(texts: DataFrame, key: str, toks: str, cut, shared=None, counts: DataFrame | None = None, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """Number of pieces of every text, 0 where it has no words, without putting the pieces back in order.

    ``counts``: the distinct words of the texts and how often they stand there (word, n), where
    they are at hand. The ``frequent`` most frequent ones are then looked up on the row, from a list
    sent to the tasks, and only the others are exploded and meet their pieces in a join.
    """
    cut = cut if shared is None else by_broadcast(cut, shared)
    every = texts.select(key, F.lit(0).cast("long").alias("n"))
    if counts is None:
        per_text = texts.select(key, F.explode(toks).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("times"))
        known = cut(per_text.select("word").distinct()).select("word", F.size("pieces").alias("n"))
        found = per_text.join(known, "word").select(key, (F.col("n") * F.col("times")).alias("n"))
    else:
        known = stored_rows(cut(counts.select("word")).select("word", F.size("pieces").alias("n")))
        top = counts.orderBy(F.desc("n"), "word").limit(frequent).select("word")
        split = texts.select(key, _counted(known.join(top, "word"))(toks).alias("row")).select(key, "row.*")
        others = split.select(key, F.explode("others").alias("word")).join(known.hint("merge"), "word").select(key, F.col("n").cast("long").alias("n"))
        found = others.unionByName(split.select(key, "n"))
    return found.unionByName(every).groupBy(key).agg(F.sum("n").alias("n_tokens"))


def _counted(words: DataFrame):
    """A column function for lists of words: n, the pieces of the listed words (word, n), and the words that are not listed."""
    rows = words.filter("word is not null").collect()
    sent = words.sparkSession.sparkContext.broadcast(([r.word for r in rows], [r.n for r in rows]))

    def look_up(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        listed, n = pa.array(sent.value[0], pa.string()), pa.array(sent.value[1], pa.int64())
        for batch in lists:
            flat = batch.flatten().cast(pa.string())
            found = n.take(pac.index_in(flat, listed, skip_nulls=True))
            open_ = found.is_null()
            row = pac.list_parent_indices(batch).to_numpy()
            sums = np.zeros(len(batch), dtype=np.int64)
            np.add.at(sums, row, found.fill_null(0).to_numpy())
            ends = np.cumsum(np.bincount(row[open_.to_numpy(zero_copy_only=False)], minlength=len(batch)))
            others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat.filter(open_))
            yield pa.StructArray.from_arrays([pa.array(sums), others], ["n", "others"])

    look_up.__annotations__ = {"lists": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(look_up, "n long, others array<string>")


def piece_ids(pieces: DataFrame, key: str, vocabulary: DataFrame, unknown: str = UNKNOWN) -> DataFrame:
    """Ids of the pieces of every text (key, pieces): (key, ids array<int>); pieces beyond the vocabulary have the id of ``unknown``."""
    other = vocabulary.filter(F.col("piece") == unknown).agg(F.max("id").alias("id")).scalar()
    flat = pieces.select(key, F.posexplode_outer("pieces").alias("pos", "piece")).join(vocabulary.select(F.col("id").alias("__id"), "piece"), "piece", "left")
    flat = flat.withColumn("__id", F.coalesce("__id", other))
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.col("__id").alias("id")))
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.id).alias("ids"))


def words_and_letters(words: DataFrame, least: int) -> DataFrame:
    """A vocabulary of all words seen ``least`` times or more and of all letters, alone and with ``##``: column ``piece``."""
    return counted_and_letters(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), least)


def counted_and_letters(counts: DataFrame, least: int) -> DataFrame:
    """``words_and_letters`` from the distinct words and their counts: word, n."""
    letter = counts.select(F.explode(F.split("word", "")).alias("piece")).filter("piece != ''").distinct()
    marked = letter.select(F.explode(F.array("piece", F.concat(F.lit("##"), "piece"))).alias("piece"))
    return counts.filter(F.col("n") >= least).select(F.col("word").alias("piece")).union(marked).distinct()
