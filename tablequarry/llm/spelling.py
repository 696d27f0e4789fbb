"""Spelling variants by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced character makes one from the other. The
shorter word (of two equally long, the smaller) is cut into two disjoint chunks that cover it; the
other gives its positional grams of the same lengths. One edit leaves one of the two chunks whole
and moves it by one place at most, so the pair meets in an equi-join on (length of the chunked
word, chunk, text of the gram) and is then verified. Only grams within one place of where a chunk
can stand are made, at most nine a word, so a long word costs in proportion to its length.

A stored word list is packed to a small part of its rows, and chunks and grams are several times
as many; Spark's size estimates see the files only. So the joins carry a merge hint, or the driver
would gather a list of up to ten packed megabytes for a broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from .common import discard, runs, stored, table, text_blocks

#: Words have at least so many characters and occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form has at least so many times the word's occurrences.
FORM_RATIO = 2
#: One run in so many of a document loses a character.
SLIP = 97
#: Distinct words a task holds before it hands on their counts.
HELD = 100_000

# Letters are A-Z, a-z and the code points C0 to FF, one byte each in Latin-1.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def slipped(run: bytes, seed: int, slip: int) -> bytes:
    """The lower-cased Latin-1 run, less one character where ``slip`` divides the checksum of document and run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % slip:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counter(slip: int, least: int):
    def count(batches):
        import pyarrow as pa

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        total = Counter()
        for batch in batches:
            for part, raws in text_blocks(batch, 1):
                for doc, raw in zip(part.column(0).to_pylist(), raws):
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    latin = raw if raw.isascii() else raw.decode().encode("latin-1", "replace")
                    for found in runs(latin, _KEEP):
                        for run, n in Counter(found).items():
                            word = slipped(run, seed, slip)
                            if len(word) >= least:
                                total[word] += n
                    if len(total) > HELD:
                        yield rows()
                        total.clear()
        if total:
            yield rows()

    return count


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP) -> DataFrame:
    """Words of the corpus and their occurrences, ``word, n``.

    Words are runs of letters, only A-Z lower-cased, of ``LEAST_LENGTH`` characters and
    ``LEAST_COUNT`` occurrences. Where ``slip`` divides the unsigned crc32 of ``<id>:<run>``, the run
    loses the character at crc32 modulo its length first. Null and empty texts have no words; the
    id of a row without id counts as empty; repeated rows count each time.
    """
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_counter(slip, LEAST_LENGTH), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _gram(word: str, at: str, size: str) -> str:
    return f"substring({word}, int({at}) + 1, int({size}))"


def _chunks(vocab: DataFrame) -> DataFrame:
    """The two chunks of every word: ``key``, the word and its count."""
    both = f"array(xxhash64(m, 1, {_gram('word', '0', 'm div 2')}), xxhash64(m, 2, {_gram('word', 'm div 2', 'm - m div 2')}))"
    return vocab.selectExpr("word as a", "n as na", "m as la", f"explode({both}) as key")


def _grams(vocab: DataFrame) -> DataFrame:
    """The positional grams of every word that a chunk of a word as long, or shorter by one, can meet within one place."""
    first = f"transform(array(0, 1), p -> if(p + l div 2 <= m, xxhash64(l, 1, {_gram('word', 'p', 'l div 2')}), null))"
    second = f"transform(array(l div 2 - 1, l div 2, l div 2 + 1), p -> if(p + l - l div 2 <= m, xxhash64(l, 2, {_gram('word', 'p', 'l - l div 2')}), null))"
    lengths = f"filter(array(m, m - 1), l -> l >= {LEAST_LENGTH})"
    keys = f"array_distinct(array_compact(flatten(transform({lengths}, l -> concat({first}, {second})))))"
    return vocab.selectExpr("word as b", "n as nb", "m as lb", f"explode({keys}) as key")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """All pairs of near words of ``word, n``, each once: ``a, na, b, nb``, a the shorter or smaller.

    Words are distinct; a word without partner is in no pair, an empty table gives none.
    """
    sized = vocab.select("word", "n", F.length("word").alias("m"))
    met = _chunks(sized).join(_grams(sized).hint("merge"), "key").where("lb - la in (0, 1) and (la < lb or a < b)")
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct()


def forms(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each word with near words: their number, and the most frequent one if it occurs ``FORM_RATIO`` times as often.

    Gives ``word, n_near, form, form_n``; of equally frequent near words the smallest by code point.
    """
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("other_n")),
    )
    near = pairs.select(F.explode(ways).alias("w")).select("w.*")
    best = near.groupBy("word").agg(F.max("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    often = -F.col("best.less") >= FORM_RATIO * F.col("n")
    return best.select("word", "n_near", F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form, by following forms to the last.

    Every step doubles the path that is known. Counts at least double along a path, so no path is
    longer than 64 and seven steps do.
    """
    up = stored(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = stored(up.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(up)
        if not far.where("moved").limit(1).count():
            return far.select("word", "root")
        up = stored(far.select("word", "root"))
        discard(far)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP) -> DataFrame:
    """Every word of the corpus with its form and root: ``word, n, form, form_n, root, n_near``.

    See ``words`` for null, empty and repeated rows; other columns of ``docs`` are not read.
    """
    vocab = stored(words(docs, id_col, text_col, slip))
    pairs = stored(near_pairs(vocab))
    found = stored(forms(vocab, pairs))
    discard(pairs)
    out = vocab.join(found.hint("merge"), "word", "left").join(roots(found).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def query(spark, folder):
    """op13: spelling variants of all words of ``documents``."""
    return variants(table(spark, folder, "documents"))


SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
found as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
run as (select doc_id, run, count(*) as n, string_split(coalesce(doc_id::varchar, '') || ':' || run, '') as c from found group by doc_id, run),
byte as (select run, n, flatten(list_transform(c, lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + (unicode(x)::bigint >> 6), 128 + (unicode(x)::bigint & 63)] end)) as b from run),
sum as (select run, n, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) as h from byte, crc),
slip as (select case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, n from sum),
word as (select word, sum(n)::bigint as n from slip where length(word) >= 5 group by word having sum(n) >= 3),
spot as (select word, n, unnest(range(1, length(word) + 1)) as i from word),
cut as (select word, n, i, word[:i - 1] || '_' || word[i + 1:] as hole, word[:i - 1] || word[i + 1:] as less from spot),
pair as (
  select a.word as a, a.n as na, b.word as b, b.n as nb from cut a join cut b on a.hole = b.hole and a.i = b.i and a.word <> b.word
  union select a.word, a.n, b.word, b.n from cut a join word b on a.less = b.word
  union select b.word, b.n, a.word, a.n from cut a join word b on a.less = b.word),
near as (select a as word, na as n, count(*) as n_near, max(nb) as top from pair group by all),
form as (select word, n_near, case when top >= 2 * n then (select min(b) from pair where a = word and nb = top) end as form, case when top >= 2 * n then top end as form_n from near),
path as (
  select word, form as upper from form where form is not null
  union all select path.word, form.form from path join form on path.upper = form.word where form.form is not null),
final as (select word, upper from path where upper not in (select word from form where form is not null))
select word, form, coalesce(final.upper, word) as root, n, coalesce(n_near, 0) as n_near, form_n
from word left join form using (word) left join final using (word)"""
