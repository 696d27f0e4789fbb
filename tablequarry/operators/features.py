"""Training rows for encoders: ids, masks, labels, spans."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.binding import let
from ..functions.names import first_words, short_header
from ..functions.seeded import pick_number, unit
from .ordered import numbered_in_order, running_number


def gold_parts(queries: DataFrame) -> DataFrame:
    """Select, aggregate, number of conditions, their columns, operators and literals."""
    return queries.select(
        "query_id", F.col("sel").alias("sc"), F.col("agg").alias("sa"), F.size("conds").alias("wn"),
        F.col("conds.col").alias("wc"), F.col("conds.op").alias("wo"), F.col("conds.val").alias("wv"),
    )


def question_answers(questions: DataFrame) -> DataFrame:
    """Question-answering rows per table: id ``table-number``, question, literals with their start.

    A literal that is not in the question fails the job. Rows stay flat, one per
    question; ``nest_questions`` puts them under their table.
    """
    def start(c):
        at = F.instr(F.lower("question"), F.lower(c.val)) - 1
        return F.when(at < 0, F.raise_error(F.concat(F.lit("literal not in question: "), c.val)).cast("int")).otherwise(at)

    numbered = running_number(questions, ["table_id"], "query_id", "qnum")
    return numbered.select(
        "table_id", F.concat_ws("-", "table_id", (F.col("qnum") - 1).cast("string")).alias("qas_id"), "query_id", "question",
        F.transform("conds", lambda c: c.val).alias("texts"), F.transform("conds", start).alias("starts"), F.array_join("header", " ").alias("context"),
    )


def columns_with_values(tables: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """Header names followed by up to four words of one drawn row."""
    pick = F.min_by(F.struct("row_id", "cells"), unit(seed, "row", "table_id", F.col("row_id").cast("string")))
    drawn = rows.groupBy("table_id").agg(pick.alias("r")).select("table_id", "r.row_id", "r.cells")
    shown = F.transform("header", lambda h, i: F.concat_ws(" ", short_header(h), first_words(F.get("cells", i), 4)))
    return tables.join(drawn, "table_id", "left").select(
        "table_id", "row_id", F.when(F.col("cells").isNull(), F.transform("header", short_header)).otherwise(shown).alias("columns")
    )


def consistency_pairs(rows: DataFrame, key: str, question: str, sql: str, n_first: int = 10_000) -> DataFrame:
    """Question / SQL pairs for consistency training.

    The first ``n_first`` rows stand with their own pair; every later row gives its SQL
    with the pair at its place modulo ``n_first``.
    """
    placed = running_number(rows, [], key, "pos").withColumn("pos", F.col("pos") - 1)
    first = placed.filter(F.col("pos") < n_first)
    pair = F.concat_ws(" ||| ", question, sql)
    own = first.select(key, F.concat_ws(" ||| ", F.col(question), pair).alias("line"))
    partner = first.select(F.col("pos").alias("at"), pair.alias("pair"))
    later = placed.filter(F.col("pos") >= n_first).withColumn("at", F.pmod(F.col("pos") - n_first, F.lit(n_first)))
    return own.unionByName(later.join(partner, "at").select(key, F.concat_ws(" ||| ", F.col(sql), F.col("pair")).alias("line")))


# ---- vocabulary and ids ------------------------------------------------------------------

# Special words of a vocabulary, in order of their ids.
SPECIALS = ["<UNK>", "<BOS>", "<EOS>"]


def build_vocabulary(words: DataFrame, max_count: int | None = None, min_freq: int = 1) -> DataFrame:
    """(id, word, n): the most frequent words, sorted by word, after the special words.

    Words of equal count are taken in order of the word; without ``max_count`` all are taken.
    """
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_freq)
    top = counts if max_count is None else counts.orderBy(F.desc("n"), "word").limit(max_count)
    numbered = numbered_in_order(top, ["word"], "place").select((F.col("place") + len(SPECIALS) - 1).cast("int").alias("id"), "word", "n")
    spark = words.sparkSession
    special = spark.createDataFrame([(i, w, 0) for i, w in enumerate(SPECIALS)], "id int, word string, n bigint")
    return special.unionByName(numbered)


def words_once_per_schema(items: DataFrame, group: str, word: str) -> DataFrame:
    """Distinct words of every schema; ``vocabulary_words`` counts repeats inside a schema."""
    return items.dropDuplicates([group, word])


def schema_words(schemas: DataFrame, with_table: bool = False) -> DataFrame:
    """All words of the column and table names of a database, as often as they stand there: db_id, word.

    ``schemas`` has one row a database: column_names (table, name), column_types, table_names. A
    column begins with the word of its type; with ``with_table`` its table's words follow.
    """
    def table_words(i):
        return F.when(i < 0, F.array(F.lit("<any-table>"))).otherwise(F.split(F.get("table_names", i), " "))

    def column_words(c, i):
        kind = F.concat(F.lit("<type: "), F.get("column_types", i), F.lit(">"))
        own = F.concat(F.array(kind), F.split(F.get(c, F.lit(1)), " "))
        return F.concat(own, F.array(F.lit("<table-sep>")), table_words(F.get(c, F.lit(0)).cast("int"))) if with_table else own

    columns = F.flatten(F.transform("column_names", column_words))
    tables = F.flatten(F.transform("table_names", lambda n: F.split(n, " ")))
    return schemas.select("db_id", F.explode(F.concat(columns, tables)).alias("word"))


def vocabulary_words(items: DataFrame, schemas: DataFrame, section: str = "train", with_table: bool = False) -> DataFrame:
    """The words a vocabulary is counted from, one row an occurrence: word.

    All question words of one section (items: db_id, section, toks), and the words of each
    database that a question of it asks, once a database, repeats inside a schema counted.
    """
    own = items.filter(F.col("section") == section)
    asked = schema_words(schemas, with_table).join(own.select("db_id").distinct(), "db_id", "left_semi")
    return own.select(F.explode("toks").alias("word")).unionByName(asked.select("word"))


def to_ids(tokens: DataFrame, vocab: DataFrame, key: str, toks: str = "toks", ends: bool = True) -> DataFrame:
    """Token lists to id lists in the same order; unknown words get 0.

    Ids come back to their row by position; a row is one text, and a text without words
    has no ids.
    """
    flat = tokens.select(key, F.posexplode_outer(toks).alias("pos", "word"))
    small = vocab.select("word", F.col("id").alias("__id"))
    found = flat.join(small, "word", "left").select(key, "pos", F.coalesce("__id", F.lit(0)).alias("__id"))
    grouped = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "__id")))), lambda x: x["__id"]).alias("ids"))
    if not ends:
        return grouped
    return grouped.withColumn("ids", F.concat(F.array(F.lit(1)), F.col("ids"), F.array(F.lit(2))))


def extend_vocabulary(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """Add words the vocabulary does not know at the next ids, in order of the word."""
    new = words.select("word").distinct().join(vocab.select("word"), "word", "left_anti")
    top = vocab.agg(F.max("id").alias("top")).scalar()
    added = numbered_in_order(new, ["word"], "place").select((F.col("place") + top).cast("int").alias("id"), "word")
    return vocab.select("id", "word").unionByName(added)


# ---- masking and labels on token arrays -----------------------------------------------------

# Marks of a caption, and the pad id, pad label and pad table index.
BEGIN, SEP, STAR, MASK = "<s>", "</s>", "*", "<mask>"
PAD_ID, NO_LABEL = 1, -1


def mask_words(toks: Column, words: Column, seed, *keys) -> Column:
    """Masked tokens and their labels: struct<toks, labels array<string>>; '' where not chosen.

    15 of 100 tokens that are no marks are chosen; of these 8 in 10 become the mask, 1 in
    10 a drawn word of ``words``, the others stay. The label is the old token.
    """
    def choose(x, i):
        u = F.when(x.isin(BEGIN, SEP), F.lit(1.0)).otherwise(unit(seed, "mask", *keys, i.cast("string")))
        return F.struct(x.alias("x"), i.alias("i"), (u / F.lit(0.15)).alias("u"))

    def new(c):
        other = F.get(words, pick_number(F.size(words), seed, "word", *keys, c.i.cast("string")))
        return F.when(c.u >= 1, c.x).when(c.u < 0.8, F.lit(MASK)).when(c.u < 0.9, other).otherwise(c.x)

    return let(
        lambda v: F.struct(
            F.transform(v.chosen, new).alias("toks"), F.transform(v.chosen, lambda c: F.when(c.u < 1, c.x).otherwise(F.lit(""))).alias("labels")
        ),
        chosen=F.transform(toks, choose),
    )


def separators(toks: Column) -> Column:
    """Places (from 0) of the separators."""
    return F.filter(F.transform(toks, lambda x, i: F.when(x == SEP, i)), lambda i: i.isNotNull())


def column_label_ids(toks: Column, labels: Column) -> Column:
    """Labels at the separators but the last, -1 elsewhere; labels without a place are cut."""
    def label(x, i, used):
        at = F.array_position(used, i)
        return F.when((x == SEP) & (at > 0), F.coalesce(F.get(labels, (at - 1).cast("int")), F.lit(NO_LABEL))).otherwise(F.lit(NO_LABEL))

    return let(
        lambda v: F.transform(toks, lambda x, i: label(x, i, F.slice(v.seps, 1, F.greatest(F.size(v.seps) - 1, F.lit(0))))),
        seps=separators(toks),
    )


def table_indexes(toks: Column) -> Column:
    """At each place the start of its table: the last mark that is followed by a ``*`` before the next mark."""
    def starts(marks):
        def starts_table(i):
            stop = F.coalesce(F.array_min(F.filter(marks, lambda j: j > i)), F.size(toks))
            return (i > 0) & F.array_contains(F.slice(toks, i + 2, F.greatest(stop - i - 1, F.lit(0))), STAR)

        return F.filter(marks, starts_table)

    marks = F.filter(F.transform(toks, lambda x, i: F.when(x.isin(SEP, BEGIN), i)), lambda i: i.isNotNull())
    return let(
        lambda v: let(
            lambda w: F.transform(toks, lambda x, i: F.coalesce(F.array_max(F.filter(w.starts, lambda s: s <= i)), F.lit(0))), starts=starts(v.marks)
        ),
        marks=marks,
    )


def fit(values: Column, length: int, pad, left: bool = False) -> Column:
    """Cut or pad to one length."""
    kept = F.slice(values, 1, length)
    fill = F.array_repeat(F.lit(pad) if not isinstance(pad, Column) else pad, F.greatest(F.lit(length) - F.size(kept), F.lit(0)))
    return F.concat(fill, kept) if left else F.concat(kept, fill)


def input_mask(values: Column, length: int, left: bool = False) -> Column:
    ones = F.transform(F.slice(values, 1, length), lambda x: F.lit(1))
    return fit(ones, length, 0, left)


def pair_lengths(n_first: Column, n_second: Column, most: int) -> tuple[Column, Column]:
    """Lengths after cutting the longer list one token at a time (ties cut the second)."""
    up, down = (most + 1) // 2, most // 2
    first = F.least(n_first, F.greatest(F.lit(up), F.lit(most) - n_second))
    second = F.least(n_second, F.greatest(F.lit(down), F.lit(most) - n_first))
    return first, second


def cut_pair(first: Column, second: Column, most: int) -> tuple[Column, Column]:
    a, b = pair_lengths(F.size(first), F.size(second), most)
    return F.slice(first, 1, a), F.slice(second, 1, b)


def cut_with_stride(first: Column, second: Column, most: int, stride: int, n_marks: int = 0, cut_first: bool = True) -> Column:
    """struct<first, second, overflow>: cut one list so that both and the marks fit.

    The overflow starts ``stride`` items before the cut; a start before the list counts
    from its end. Nothing is cut where the other list alone leaves no room.
    """
    cut, other = (first, second) if cut_first else (second, first)
    room = F.lit(most - n_marks) - F.size(other)
    too_long = (room > 0) & (F.size(cut) > room)
    start = room - stride
    tail = F.when(start >= 0, F.slice(cut, F.greatest(start, F.lit(0)) + 1, F.size(cut))).otherwise(
        F.slice(cut, F.greatest(F.size(cut) + F.least(start, F.lit(-1)), F.lit(0)) + 1, F.size(cut))
    )
    kept = F.when(too_long, F.slice(cut, 1, F.greatest(room, F.lit(0)))).otherwise(cut)
    overflow = F.when(too_long, tail).otherwise(F.slice(cut, 1, 0))
    one, two = (kept, other) if cut_first else (other, kept)
    return F.struct(one.alias("first"), two.alias("second"), overflow.alias("overflow"))


def with_specials(first: Column, second: Column, begin, sep) -> tuple[Column, Column]:
    """``[begin] first [sep] second [sep]`` and its segment ids (0 up to the first sep, then 1)."""
    one = F.concat(F.array(F.lit(begin)), first, F.array(F.lit(sep)))
    two = F.concat(second, F.array(F.lit(sep)))
    ids = F.concat(one, two)
    segments = F.concat(F.transform(one, lambda x: F.lit(0)), F.transform(two, lambda x: F.lit(1)))
    return ids, segments


def header_input(question: Column, headers: Column, sql_words: Column | None = None) -> Column:
    """Encoder input with spans: ``[CLS] [sql words [SEP] ...] question [SEP] header [SEP] ...``.

    ``headers`` and ``sql_words`` are lists of token lists. Gives struct<toks, segments,
    sql_spans, question_span, header_spans>; a span is (start, end) with end not in it.
    """
    words = sql_words if sql_words is not None else F.expr("cast(array() as array<array<string>>)")

    def made(v):
        return F.struct(*[c.alias(n) for n, c in _header_parts(v.question, v.headers, _block(v.words, F.lit(1))).items()])

    return let(made, question=question, headers=headers, words=words)


def _block(lists: Column, base: Column) -> tuple[Column, Column, Column]:
    """Tokens, segments and spans of token lists that begin at ``base``, each closed by a separator."""
    toks = F.flatten(F.transform(lists, lambda ts: F.concat(ts, F.array(F.lit("[SEP]")))))
    last = F.size(lists) - 1
    segs = F.flatten(F.transform(lists, lambda ts, i: F.concat(F.transform(ts, lambda x: F.lit(1)), F.array(F.when(i == last, 1).otherwise(0)))))
    start = F.struct(base.alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(s, ts):
        end = s.at + F.size(ts)
        return F.struct((end + 1).alias("at"), F.concat(s.spans, F.array(F.struct(s.at.alias("start"), end.alias("end")))).alias("spans"))

    return toks, segs, F.aggregate(lists, start, step, lambda s: s.spans)


def _fixed_block(lists: list[list[str]], base: int) -> tuple[Column, Column, Column]:
    """``_block`` of given words, as constants."""
    toks, segs, spans = [], [], []
    for k, words in enumerate(lists):
        spans.append(F.struct(F.lit(base + len(toks)).alias("start"), F.lit(base + len(toks) + len(words)).alias("end")))
        toks += [*words, "[SEP]"]
        segs += [1] * len(words) + [int(k == len(lists) - 1)]
    return F.array(*map(F.lit, toks)), F.array(*map(F.lit, segs)), F.array(*spans)


def _header_parts(question: Column, headers: Column, front: tuple[Column, Column, Column]) -> dict[str, Column]:
    """The fields of ``header_input``; ``front`` is the block of the SQL words."""
    toks, segs, sql_spans = front
    at = F.size(toks) + 1
    q_end = at + F.size(question)
    h_toks, h_segs, h_spans = _block(headers, q_end + 1)
    return {
        "toks": F.concat(F.array(F.lit("[CLS]")), toks, question, F.array(F.lit("[SEP]")), h_toks),
        "segments": F.concat(F.array(F.lit(0)), segs, F.transform(question, lambda x: F.lit(0)), F.array(F.lit(0)), h_segs),
        "sql_spans": sql_spans, "question_span": F.struct(at.alias("start"), q_end.alias("end")), "header_spans": h_spans,
    }


# ---- words and pieces -------------------------------------------------------------------------


def piece_maps(pieces: Column) -> tuple[Column, Column]:
    """From the pieces of each word: word of each piece, first piece of each word."""
    word_of = F.flatten(F.transform(pieces, lambda ps, i: F.array_repeat(i, F.size(ps))))
    first = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("firsts")),
        lambda s, ps: F.struct((s.at + F.size(ps)).alias("at"), F.concat(s.firsts, F.array(s.at)).alias("firsts")), lambda s: s.firsts,
    )
    return word_of, first


def words_of_pieces(rows: DataFrame, key: str, pieces: str) -> DataFrame:
    """Regroup word pieces (``##`` goes on) to words: (key, word_no, word, first piece)."""
    def words(v):
        def one(s, k):
            stop = F.coalesce(F.get(v.starts, k + 1), F.size(v.pieces))
            text = F.array_join(F.transform(F.slice(v.pieces, s + 1, stop - s), lambda p: F.regexp_replace(p, "^##", "")), "")
            return F.struct(k.alias("word_no"), text.alias("word"), s.alias("first"))

        return F.transform(v.starts, one)

    starts = F.filter(F.transform(F.col(pieces), lambda p, i: F.when(~p.startswith("##") | (i == 0), i)), lambda i: i.isNotNull())
    return rows.select(key, F.explode(let(words, pieces=F.col(pieces), starts=starts)).alias("w")).select(key, "w.*")


def links_to_pieces(links: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Carry links (key, word_no, ...) from words to the first piece of the word.

    The words of a key meet its links as one list, so links that stand together by key stay where they are.
    """
    placed = words.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("word_no", "first")).alias("__words"))
    own = F.filter("__words", lambda w: w["word_no"] == F.col("word_no"))
    met = links.join(placed.hint("merge"), key).withColumn("__word", F.explode(own))
    return met.select(*[c for c in links.columns if c != "word_no"], F.col("__word.first").alias("piece_no"))


def inverse_permutation(order: Column) -> Column:
    placed = F.transform(order, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(placed), lambda p: p.i)


# ---- pointers ------------------------------------------------------------------------------------

# Words a pointer can choose before the question, in order.
SQL_WORDS = [
    "sql none", "sql max", "sql min", "sql count", "sql sum", "sql average", "sql select", "sql where", "sql and",
    "sql equal", "sql greater than", "sql less than", "sql start", "sql end",
]


def pointer_targets(inp: Column, sel: Column, agg: Column, conds: Column, value_spans: Column) -> Column:
    """Start pointers of a gold query: start, select, agg, column, [where, (column, op, first, last [, and])...], end."""
    sql_at = lambda i: F.get(inp.sql_spans, i).start
    header_at = lambda i: F.get(inp.header_spans, i).start
    shift = F.get(inp.sql_spans, F.lit(13)).end + 1

    def condition(c, i):
        span = F.get(value_spans, i)
        body = F.array(header_at(c.col), sql_at(c.op + 9), span.first + shift, span.last + shift)
        return F.when(i < F.size(conds) - 1, F.concat(body, F.array(sql_at(F.lit(8))))).otherwise(body)

    where = F.concat(F.array(sql_at(F.lit(7))), F.flatten(F.transform(conds, condition)))
    head = F.array(sql_at(F.lit(12)), sql_at(F.lit(6)), sql_at(agg), header_at(sel))
    end = F.array(sql_at(F.lit(13)))
    return F.when(F.size(conds) > 0, F.concat(head, where, end)).otherwise(F.concat(head, end))


def pointer_rows(df: DataFrame, question: str, headers: Column, sql_words: list[list[str]], spans: Column) -> DataFrame:
    """Adds the pointer input ``x`` and the ``pointers`` of the gold query.

    The SQL words are constants of the job. The fields of ``x`` are columns first, so a query that
    reads spans only makes no tokens.
    """
    made = df.withColumns({"__headers": headers, "__spans": spans})
    parts = _header_parts(F.col(question), F.col("__headers"), _fixed_block(sql_words, 1))
    made = made.withColumns({f"__{n}": c for n, c in parts.items()})
    part = lambda *names: F.struct(*[F.col(f"__{n}").alias(n) for n in names])
    pointers = let(
        lambda v: pointer_targets(v.x, F.col("sel"), F.col("agg"), F.col("conds"), v.spans), x=part("sql_spans", "header_spans"), spans=F.col("__spans")
    )
    return made.select(*df.columns, part(*parts).alias("x"), pointers.alias("pointers"))


# ---- smaller parts -------------------------------------------------------------------------------


def ids_to_text(ids: DataFrame, vocab: DataFrame, key: str, col: str = "ids") -> DataFrame:
    """Ids back to clean text; ids of special words are left out. A row without known words gives an empty text."""
    from ..functions.textforms import clean_spaces

    flat = ids.select(key, F.posexplode_outer(col).alias("pos", "__id"))
    found = flat.join(vocab.filter(F.col("id") >= len(SPECIALS)).select(F.col("id").alias("__id"), "word"), "__id", "left")
    words = found.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))), lambda x: x.word).alias("words")
    )
    return words.select(key, clean_spaces(F.array_join("words", " ")).alias("text"))


def used_vectors(used: DataFrame, vectors: DataFrame, place: str, n_special: int = 3) -> DataFrame:
    """Vectors of the used words, with ids by first use (then by word) after the special ones."""
    first = used.groupBy("word").agg(F.min(place).alias("__place"))
    numbered = numbered_in_order(vectors.join(first, "word"), ["__place", "word"], "__no")
    return numbered.withColumn("id", (F.col("__no") + n_special - 1).cast("int")).drop("__no", "__place")


def task_features(rows: DataFrame, first: Column, second: Column, label: Column, labels: list[str] | None, length: int) -> DataFrame:
    """Sentence-task rows to features: tokens, mask, segments of one length and the label id (or number)."""
    paired = F.size(second) > 0
    cut = cut_with_stride(first, second, length, 0, 3)
    single = F.slice(first, 1, length - 2)
    ids2, seg2 = with_specials(F.col("__cut.first"), F.col("__cut.second"), "[CLS]", "[SEP]")
    one = F.concat(F.array(F.lit("[CLS]")), F.col("__single"), F.array(F.lit("[SEP]")))
    toks = F.when(F.col("__paired"), ids2).otherwise(one)
    segs = F.when(F.col("__paired"), seg2).otherwise(F.transform(one, lambda x: F.lit(0)))
    target = label.cast("double") if labels is None else (F.array_position(F.array(*[F.lit(x) for x in labels]), label) - 1).cast("int")
    made = rows.select("*", target.alias("label_id"), paired.alias("__paired"), cut.alias("__cut"), single.alias("__single"))
    made = made.withColumn("__toks", toks).withColumn("__segs", segs)
    return made.select(
        *rows.columns, "label_id", fit(F.col("__toks"), length, "[PAD]").alias("tokens"), input_mask(F.col("__toks"), length).alias("input_mask"),
        fit(F.col("__segs"), length, 0).alias("segments"),
    )


def paired_features(rows: DataFrame, question: str, sql: str, labels: str, length: int) -> DataFrame:
    """Question and SQL sequence side by side; ``error`` where they differ in their number of columns."""
    cut = rows.withColumn(question, F.slice(question, 1, length)).withColumn(sql, F.slice(sql, 1, length))
    seps = lambda c: F.transform(c, lambda x: x == SEP)
    made = cut.withColumn("q_seps", seps(question)).withColumn("s_seps", seps(sql))
    made = made.withColumn("col_label_ids", column_label_ids(F.col(question), F.col(labels)))
    count = lambda c: F.size(F.filter(c, lambda x: x))
    return made.withColumn("error", F.coalesce(count("q_seps") != count("s_seps"), F.lit(True)))


#: So many words of a vocabulary, the most frequent ones, go whole to the tasks.
KNOWN_WORDS = 20_000


def _known_ids(vocab: DataFrame, most: int):
    """The ids of a list of words, as a column function: NULL for a word that is not among the most frequent of the vocabulary."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ordered = vocab.orderBy(F.desc("n"), "id") if "n" in vocab.columns else vocab
    top = ordered.select("word", "id").filter("word is not null").limit(most).collect()
    sent = vocab.sparkSession.sparkContext.broadcast(([r.word for r in top], [r.id for r in top]))

    def look_up(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, ids = pa.array(sent.value[0], pa.string()), pa.array(sent.value[1], pa.int32())
        for batch in lists:
            found = ids.take(pc.index_in(batch.flatten().cast(pa.string()), words, skip_nulls=True))
            ends = pc.cumulative_sum(pc.list_value_length(batch)).to_pylist()
            yield pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), found)

    look_up.__annotations__ = {"lists": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(look_up, ArrayType(IntegerType()))


def sequence_ids(rows: DataFrame, key: str, sequences: list[str], vocab: DataFrame, unknown: int = 0, known: int = KNOWN_WORDS) -> DataFrame:
    """Ids of several token lists of a row in one pass: the key and each list as ids under its name.

    Words beyond the vocabulary (id, word) get ``unknown``; an empty or NULL list stays empty. The
    ``known`` most frequent words are looked up on the row. Only the others meet the vocabulary
    in a join, once a row, so no word that many rows hold is a key of it. ``rows`` are read twice.
    """
    none = F.expr("cast(array() as array<string>)")
    lists = [F.coalesce(F.col(c), none) for c in sequences]
    flat = rows.select(key, F.concat(*lists).alias("__words"), F.array(*[F.size(x) for x in lists]).alias("__sizes"))
    flat = flat.withColumn("__ids", _known_ids(vocab, known)("__words"))
    flat = flat.withColumn("__open", F.zip_with("__words", "__ids", lambda w, x: F.when(x.isNull(), w))).drop("__words")
    others = flat.select(key, F.explode(F.array_distinct(F.filter("__open", lambda w: w.isNotNull()))).alias("word"))
    met = others.join(vocab.select("word", F.col("id").alias("__id")).hint("merge"), "word").select(key, F.struct("word", "__id").alias("__met"))
    both = flat.select(key, F.struct("__sizes", "__ids", "__open").alias("__row")).unionByName(met, allowMissingColumns=True)
    grouped = both.groupBy(key).agg(F.collect_list("__row").alias("__rows"), F.collect_list("__met").alias("__met"))

    def id_of(x, w):
        found = F.get(F.filter("__met", lambda m: m["word"] == w), F.lit(0))["__id"]
        return F.coalesce(x, F.when(w.isNotNull(), found), F.lit(unknown))

    def filled(row):
        return F.struct(row["__sizes"].alias("sizes"), F.zip_with(row["__ids"], row["__open"], id_of).alias("ids"))

    whole = grouped.select(key, F.transform("__rows", filled).alias("__rows"))

    def part(row, k):
        before = F.aggregate(F.slice(row["sizes"], 1, k), F.lit(0), lambda a, n: a + n) if k else F.lit(0)
        return F.slice(row["ids"], before + 1, F.get(row["sizes"], F.lit(k)))

    def together(k):
        placed = F.flatten(F.transform("__rows", lambda row: F.transform(part(row, k), lambda x, i: F.struct(i.alias("i"), x.alias("x")))))
        return F.when(F.size("__rows") == 1, part(F.get("__rows", F.lit(0)), k)).otherwise(F.transform(F.array_sort(placed), lambda p: p["x"]))

    return whole.select(key, *[together(k).alias(c) for k, c in enumerate(sequences)])


def _at_separators(toks: Column) -> Column:
    """True at the separators but the last."""
    return let(lambda v: F.transform(toks, lambda x, i: (x == SEP) & (i < F.coalesce(F.element_at(F.concat(F.array(F.lit(-1)), v.seps), -1), F.lit(-1)))), seps=separators(toks))


def three_sequences(rows: DataFrame, key: str, names: tuple[str, str, str], labels: str, vocab: DataFrame, length: int, words: Column, seed, masked: bool = True) -> DataFrame:
    """The features of a consistency example: a caption, its question and its SQL, each of one length.

    ``names`` are the columns of the three token lists, ``labels`` the column labels of the
    caption, ``words`` the words that may stand for a masked one. Gives the key and

    - ids, mask, col_label_ids, lm_label_ids of the caption; with ``masked`` its ids are those of
      the masked tokens, and lm_label_ids (id of the old token, -1 elsewhere) are given either way;
    - question_ids, question_mask, question_cols and sql_ids, sql_mask, sql_cols (true at the
      separators but the last);
    - error, where the caption has not one label a column, or the others differ in their columns.

    Pad is id 1, label -1 and false. A row with an error keeps its features.
    """
    from ..session import stored_rows

    main, question, sql = names
    cut = rows.select(key, F.col(labels).alias("__labels"), *[F.slice(n, 1, length).alias(n) for n in names])
    made = cut.withColumn("__m", mask_words(F.col(main), words, seed, key))
    n_cols = lambda c: F.greatest(F.size(separators(F.col(c))) - 1, F.lit(0))
    wrong = (n_cols(main) != F.size("__labels")) | (n_cols(question) != n_cols(sql))
    made = stored_rows(made.select(
        key, (F.col("__m.toks") if masked else F.col(main)).alias("__input"), F.col("__m.labels").alias("__old"), question, sql,
        fit(column_label_ids(F.col(main), F.col("__labels")), length, NO_LABEL).alias("col_label_ids"),
        fit(_at_separators(F.col(question)), length, False).alias("question_cols"), fit(_at_separators(F.col(sql)), length, False).alias("sql_cols"),
        F.transform("__m.labels", lambda w: w != "").alias("__chosen"), F.coalesce(wrong, F.lit(True)).alias("error"),
    ))
    ids = sequence_ids(made, key, ["__input", "__old", question, sql], vocab)
    ids = ids.select(key, F.col("__input").alias("__ids"), F.col("__old").alias("__old_ids"), F.col(question).alias("__q_ids"), F.col(sql).alias("__s_ids"))
    both = made.drop("__input", "__old", question, sql).join(ids.hint("merge"), key)
    old = F.transform("__old_ids", lambda x, i: F.when(~F.get("__chosen", i), NO_LABEL).otherwise(x))
    return both.select(
        key, fit(F.col("__ids"), length, PAD_ID).alias("ids"), input_mask(F.col("__ids"), length).alias("mask"),
        "col_label_ids", fit(old, length, NO_LABEL).alias("lm_label_ids"),
        fit(F.col("__q_ids"), length, PAD_ID).alias("question_ids"), input_mask(F.col("__q_ids"), length).alias("question_mask"), "question_cols",
        fit(F.col("__s_ids"), length, PAD_ID).alias("sql_ids"), input_mask(F.col("__s_ids"), length).alias("sql_mask"), "sql_cols", "error",
    )


def used_column_labels(toks: Column, used: Column) -> Column:
    """1 at the separator of a used column, 0 at the others but the last, -1 elsewhere."""
    return let(
        lambda v: F.transform(
            toks,
            lambda x, i: F.when(
                (x == SEP) & (i != F.element_at(v.seps, -1)),
                F.array_contains(used, (F.array_position(v.seps, i) - 1).cast("int")).cast("int"),
            ).otherwise(F.lit(NO_LABEL)),
        ),
        seps=separators(toks),
    )


def filled_hints(rows: DataFrame, batch: str, hints: str, n: str) -> DataFrame:
    """Hints padded with zeros to the longest row of their batch; all zeros where absent."""
    longest = rows.groupBy(batch).agg(F.max(n).alias("__most"))
    given = F.coalesce(F.col(hints), F.expr("cast(array() as array<int>)"))
    return rows.join(longest, batch).withColumn(hints, F.concat(given, F.array_repeat(F.lit(0), F.col("__most") - F.size(given)))).drop("__most")


def value_places(rows: DataFrame, key: str, spans: str) -> DataFrame:
    """Token places of each literal as a sparse frame: (key, cond, step, place)."""
    flat = rows.select(key, F.posexplode(spans).alias("cond", "span"))
    return flat.select(key, "cond", F.posexplode(F.sequence("span.first", "span.last")).alias("step", "place"))


def header_sizes(header: Column) -> Column:
    return F.transform(header, lambda h: F.size(F.split(h, " ")))


def transposed(rows: DataFrame, key: str, row: str, cells: str, width: int) -> DataFrame:
    """Sample rows of a table to columns: (key, columns array<array<string>>); for the few sample rows of S2."""
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(row, cells))).alias("__rows"))
    return grouped.select(key, F.array(*[F.transform("__rows", _cell(cells, i)) for i in range(width)]).alias("columns"))


def _cell(cells: str, i: int):
    return lambda r: F.get(r[cells], F.lit(i))
