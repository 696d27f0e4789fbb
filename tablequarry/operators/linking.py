"""Links between question words and columns, tables and cells of a database.

Shapes:
    questions  item_id, db_id, toks array<string>
    columns    db_id, col_id, tab_id, name, type      (column 0 is ``*``)
    tables     db_id, tab_id, name
    cells      db_id, col_id, cell

Frames with a row for every word, column or link are many times the files they are made of,
which Spark's size estimates do not see; their joins carry a merge hint, or the driver would
gather them for a broadcast.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let

# English stop words; words of this list give no partial or cell link.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her "
    "hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just "
    "don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't "
    "haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won "
    "won't wouldn wouldn't"
).split()
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
NUMBER_WORD = r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"
LONGEST_GRAM = 5


def is_common(word: Column) -> Column:
    return word.isin(STOP_WORDS) | word.isin(PUNCTUATION)


def word_grams(questions: DataFrame, longest: int = LONGEST_GRAM, more: tuple[str, ...] = ()) -> DataFrame:
    """All runs of 1 to ``longest`` words: item_id, db_id, first, n, gram, and the columns ``more`` of the question."""
    places = questions.select("item_id", "db_id", "toks", *more, F.explode(F.sequence(F.lit(0), F.size("toks") - 1)).alias("first"))
    sized = places.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("toks") - F.col("first")))))
    gram = F.array_join(F.slice("toks", F.col("first") + 1, F.col("n")), " ")
    return sized.select("item_id", "db_id", *more, "first", "n", gram.alias("gram")).filter(F.trim("gram") != "")


def _grams_with_names(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """The runs of words that are a key of their database: item_id, first, n, kind, target, whole.

    The keys (db_id, gram, kind, target, whole) are a map in one row a database, joined to
    the questions; a run looks itself up there, so runs are neither shuffled nor sent about.
    """
    near = keys.filter("gram is not null").repartition("db_id")
    listed = near.groupBy("db_id", "gram").agg(F.collect_list(F.struct("kind", "target", "whole")).alias("found"))
    known = listed.groupBy("db_id").agg(F.map_from_entries(F.collect_list(F.struct("gram", "found"))).alias("known"))
    grams = word_grams(questions.join(known.hint("merge"), "db_id"), more=("known",))
    hits = grams.select("item_id", "first", "n", F.explode(F.try_element_at("known", F.col("gram"))).alias("hit"))
    return hits.select("item_id", "first", "n", "hit.*")


def schema_names(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """All names that words may link to: db_id, kind ('column' or 'table'), target, name. The column ``*`` has none."""
    named = columns.filter("col_id > 0").select("db_id", F.lit("column").alias("kind"), F.col("col_id").alias("target"), "name")
    return named.unionByName(tables.select("db_id", F.lit("table").alias("kind"), F.col("tab_id").alias("target"), "name"))


def name_beginnings(names: DataFrame) -> DataFrame:
    """The names and their beginnings that end at a word bound, each distinct name cut once: name, gram, whole."""
    word_at = lambda i: F.substring("name", i, 1).rlike(r"\w")
    cut = names.select("name").distinct().withColumn("stop", F.explode(F.sequence(F.lit(1), F.length("name"))))
    bound = word_at(F.col("stop")) != word_at(F.col("stop") + 1)
    starts = F.left(F.col("name"), F.col("stop"))
    whole = F.col("stop") == F.length("name")
    part_ok = bound & word_at(F.lit(1)) & ~is_common(starts)
    return cut.filter(whole | part_ok).select("name", starts.alias("gram"), whole.alias("whole"))


def _marked(hits: DataFrame) -> DataFrame:
    """The words of the runs that met a name: item_id, q_id, kind, target, whole; a whole name wins."""
    marked = hits.select("item_id", "kind", "target", "whole", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("q_id"))
    return marked.groupBy("item_id", "q_id", "kind", "target").agg(F.max("whole").alias("whole"))


def _link(whole: Column) -> Column:
    return F.concat(F.when(F.col("kind") == "column", "C").otherwise("T"), F.when(whole, "EM").otherwise("PM"))


def exact_links(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Words of runs that are a name: item_id, q_id, kind, target, link; runs meet the names as they are."""
    keys = names.select("db_id", "kind", "target", F.col("name").alias("gram"), F.lit(True).alias("whole"))
    return _marked(_grams_with_names(questions, keys)).select("item_id", "q_id", "kind", "target", _link(F.lit(True)).alias("link"))


def _beginnings(names: DataFrame) -> DataFrame:
    return names.join(name_beginnings(names), "name").select("db_id", "kind", "target", "gram", "whole")


def name_links(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Links of question words to names: item_id, q_id, kind, target, link.

    A run of words equal to a name links all its words exactly; a run that begins the
    name at a word bound links them partially; exact wins.
    """
    best = _marked(_grams_with_names(questions, _beginnings(names)))
    return best.select("item_id", "q_id", "kind", "target", _link(F.col("whole")).alias("link"))


def column_links(questions: DataFrame, columns: DataFrame) -> DataFrame:
    names = schema_names(columns, columns.select("db_id", F.lit(0).alias("tab_id"), "name").limit(0))
    return name_links(questions, names).select("item_id", "q_id", F.col("target").alias("col_id"), "link")


def question_words(questions: DataFrame) -> DataFrame:
    words = questions.select("item_id", "db_id", F.posexplode("toks").alias("q_id", "word"))
    return words.filter((F.trim("word") != "") & ~is_common(F.col("word")))


def _number_words(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """Number words with the number and time columns of their database as one list: item_id, q_id, found (target, link)."""
    words = question_words(questions).filter(F.col("word").rlike(NUMBER_WORD)).select("item_id", "db_id", "q_id")
    targets = columns.filter((F.col("col_id") > 0) & F.col("type").isin("number", "time") & F.col("db_id").isNotNull())
    listed = targets.groupBy("db_id").agg(F.collect_list(F.struct(F.col("col_id").alias("target"), F.upper("type").alias("link"))).alias("found"))
    return words.join(listed.hint("merge"), "db_id").select("item_id", "q_id", "found")


def number_links(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """Number words to every number or time column of their database: item_id, q_id, col_id, link."""
    found = _number_words(questions, columns).select("item_id", "q_id", F.explode("found").alias("f"))
    return found.select("item_id", "q_id", F.col("f.target").alias("col_id"), "f.link")


def cell_links(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """Words that are a cell, or one of its words, to the column: item_id, q_id, col_id, link.

    The words of the cells are made distinct before the join, so a value that fills a
    third of a column is one row.
    """
    words = question_words(questions).filter(~F.col("word").rlike(NUMBER_WORD)).withColumn("key", F.lower("word"))
    low = F.lower("cell")
    parts = F.explode(F.array_distinct(F.concat(F.split(low, " "), F.array(low))))
    known = cells.filter(F.col("cell").isNotNull()).select("db_id", "col_id", parts.alias("key")).filter("key != ''").distinct()
    return words.join(known.hint("merge"), ["db_id", "key"]).select("item_id", "q_id", "col_id", F.lit("CELLMATCH").alias("link"))


def all_links(questions, columns, tables, cells) -> DataFrame:
    """One frame of all links: item_id, q_id, kind ('column' or 'table'), target, link.

    For a word and a column the order is: name (whole, then part), then cell, then number or time.
    Runs of words and lists of columns go to the place of their item as they are and become links
    there, in one shuffle; all links of an item stand together, so steps by item need no other.
    """
    def met(df, first, n, kind, found, rank):
        return df.select("item_id", F.col(first).alias("first"), n.alias("n"), kind.alias("kind"), found.alias("found"), rank.cast("int").alias("rank"))

    one, column = F.lit(1), F.lit("column")
    only = lambda target, link: F.array(F.struct(F.col(target).alias("target"), link.alias("link")))
    hits = _grams_with_names(questions, _beginnings(schema_names(columns, tables)))
    both = met(hits, "first", F.col("n"), F.col("kind"), only("target", _link(F.col("whole"))), F.when(F.col("whole"), 0).otherwise(1))
    both = both.unionByName(met(cell_links(questions, cells), "q_id", one, column, only("col_id", F.col("link")), F.lit(2)))
    both = both.unionByName(met(_number_words(questions, columns), "q_id", one, column, F.col("found"), F.lit(3)))
    placed = both.repartition("item_id").select("item_id", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("q_id"), "kind", "found", "rank")
    flat = placed.select("item_id", "q_id", "kind", "rank", F.explode("found").alias("f")).select("item_id", "q_id", "kind", "f.target", "f.link", "rank")
    return flat.groupBy("item_id", "q_id", "kind", "target").agg(F.min_by("link", "rank").alias("link"))


_RELATION = "i_kind", "i", "j_kind", "j", "relation"


def _relation(i_kind, i, j_kind, j, relation) -> Column:
    values = [F.lit(i_kind) if isinstance(i_kind, str) else i_kind, i.cast("int"), F.lit(j_kind) if isinstance(j_kind, str) else j_kind, j.cast("int"), F.lit(relation) if isinstance(relation, str) else relation]
    return F.struct(*[v.alias(n) for v, n in zip(values, _RELATION)])


def relations(questions, schemas, links, reach: int = 2) -> DataFrame:
    """Relations of an item that are not the default of their block: item_id, i_kind, i, j_kind, j, relation.

    Question words: distances below ``reach`` (further words have the clamped distance).
    Words with columns and tables: the links, both ways. The rest are the relations of the
    database (``schema_relations``; ``schemas`` has one row of arrays a database). Left out,
    since they follow from these rows: defaults, clamped distances, and the same-table
    relation of two columns (equal ``table_match`` rows). So a row count is linear in the
    item, not square.
    """
    size = F.size("toks")
    near = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(F.lit(1 - reach), F.lit(reach - 1)), lambda d: F.struct(i.alias("i"), d.alias("d")))))
    kept = F.filter(near, lambda x: (x.i + x.d >= 0) & (x.i + x.d < size))
    words = F.transform(kept, lambda x: _relation("question", x.i, "question", x.i + x.d, F.concat(F.lit("qq_dist "), x.d.cast("string"))))
    of_schema = schemas.select("db_id", schema_relations(schemas).alias("__schema"))
    own = questions.join(of_schema.hint("merge"), "db_id").select("item_id", F.explode(F.concat(words, "__schema")).alias("r"))
    first = F.substring("kind", 1, 1)
    there = _relation("question", F.col("q_id"), F.col("kind"), F.col("target"), F.concat(F.lit("q"), first, "link"))
    back = _relation(F.col("kind"), F.col("target"), "question", F.col("q_id"), F.concat(first, F.lit("q"), "link"))
    return own.unionByName(links.select("item_id", F.explode(F.array(there, back)).alias("r"))).select("item_id", "r.*")


def schema_relations(schemas: DataFrame) -> Column:
    """The relations of a database as an array, from its row: column_names, table_names, primary_keys, foreign_keys.

    Columns: themselves and foreign keys. Columns with tables: own table, own primary key,
    foreign keys, ``*`` with every table. Tables: themselves and foreign keys.
    """
    def places(a):
        return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def made(v):
        keys, other = v.keys, F.filter(v.keys, lambda k: k.a != k.b)
        members = F.filter(v.cols, lambda c: c.tab >= 0)
        word = lambda c: F.when(F.array_contains(v.main, c.col), "primary_key").otherwise("table_match")
        there = F.array_distinct(F.transform(other, lambda k: F.struct(k.a, k.b)))
        back = F.transform(there, lambda k: F.struct(k.b.alias("a"), k.a.alias("b")))
        way = lambda k: F.when(F.array_contains(there, k) & F.array_contains(back, k), "both").when(F.array_contains(there, k), "forward").otherwise("backward")
        return F.concat(
            F.transform(v.cols, lambda c: _relation("column", c.col, "column", c.col, "cc_dist 0")),
            F.transform(v.tabs, lambda x: _relation("table", x, "table", x, "tt_dist 0")),
            F.transform(other, lambda k: _relation("column", k["from"], "column", k["to"], "cc_foreign_key_forward")),
            F.transform(other, lambda k: _relation("column", k["to"], "column", k["from"], "cc_foreign_key_backward")),
            F.transform(keys, lambda k: _relation("column", k["from"], "table", k.b, "ct_foreign_key")),
            F.transform(keys, lambda k: _relation("table", k.b, "column", k["from"], "tc_foreign_key")),
            F.transform(members, lambda c: _relation("column", c.col, "table", c.tab, F.concat(F.lit("ct_"), word(c)))),
            F.transform(members, lambda c: _relation("table", c.tab, "column", c.col, F.concat(F.lit("tc_"), word(c)))),
            F.transform(v.tabs, lambda x: _relation("column", F.lit(0), "table", x, "ct_any_table")),
            F.transform(v.tabs, lambda x: _relation("table", x, "column", F.lit(0), "tc_any_table")),
            F.transform(F.array_distinct(F.concat(there, back)), lambda k: _relation("table", k.a, "table", k.b, F.concat(F.lit("tt_foreign_key_"), way(k)))),
        )

    table_of = lambda i: F.get(F.get("column_names", i), F.lit(0)).cast("int")
    cols = F.transform(places(F.col("column_names")), lambda i: F.struct(i.alias("col"), table_of(i).alias("tab")))
    keys = F.transform("foreign_keys", lambda k: F.struct(
        F.get(k, F.lit(0)).alias("from"), F.get(k, F.lit(1)).alias("to"), table_of(F.get(k, F.lit(0))).alias("a"), table_of(F.get(k, F.lit(1))).alias("b")
    ))
    return let(made, cols=cols, tabs=places(F.col("table_names")), keys=keys, main=F.col("primary_keys"))


def item_records(questions, schemas, links, section: Column) -> DataFrame:
    """One record per item: question, columns and tables of its database (one row of arrays each), links; with its section."""
    names = schemas.select("db_id", F.transform("column_names", lambda c: F.get(c, F.lit(1))).alias("columns"), F.col("table_names").alias("tables"))
    linked = links.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("q_id", "kind", "target", "link"))).alias("links"))
    return questions.join(names.hint("merge"), "db_id").join(linked.hint("merge"), "item_id", "left").select(
        "item_id", "db_id", section.alias("section"), F.col("toks").alias("question"), "columns", "tables", "links"
    )
