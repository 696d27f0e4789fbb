"""Readers: each has a ``parse_*`` part that works on a frame of lines, and a file part."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.binding import let
from ..functions.names import first_words, is_number_text, name_from_title, qualify
from ..functions.seeded import unit


# ---- text lines with their numbers -----------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with file and line number (from 0).

    Lines are numbered inside each file part in parallel; only the line counts of the
    parts are put in order to find where each part starts.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("seen"),
    )
    parts = raw.groupBy("file", "part").agg(F.min("seen").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("file", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return raw.join(starts, ["file", "part"]).select("file", (F.col("start") + F.col("seen") - F.col("first")).alias("line_no"), "value")


def pair_by_line(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pair two frames (line_no, value) by line number; a gold line without a partner stays."""
    g = gold.select("line_no", F.col("value").alias("gold"))
    return g.join(predicted.select("line_no", F.col("value").alias("pred")), "line_no", "left")


def read_aligned(spark: SparkSession, gold_path: str, pred_path: str) -> DataFrame:
    return pair_by_line(numbered_lines(spark, gold_path), numbered_lines(spark, pred_path))


def head_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows in a fixed order (exactly n)."""
    return df.orderBy(order).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of a seeded shuffle."""
    return df.withColumn("__u", unit(seed, "sample", key)).orderBy("__u", key).limit(n).drop("__u")


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_word_vectors(spark: SparkSession, path: str, word: str = "word", vector: str = "vec") -> DataFrame:
    return spark.read.parquet(path).select(F.col(word).alias("word"), F.col(vector).cast("array<float>").alias("vec"))


# ---- vocabularies and merges -----------------------------------------------------------


def parse_piece_lines(lines: DataFrame) -> DataFrame:
    """Lines (line_no, value) of a piece vocabulary, one piece a line: (id, piece); the id is the line number."""
    return lines.select(F.col("line_no").cast("int").alias("id"), F.regexp_replace("value", r"\r?$", "").alias("piece"))


def read_piece_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return parse_piece_lines(numbered_lines(spark, path))


def parse_merge_lines(lines: DataFrame) -> DataFrame:
    """Lines (line_no, value) of a merges file: (rank, left, right). The first line is a heading; blank lines have no merge."""
    sides = F.split(F.trim("value"), " ")
    rows = lines.filter((F.col("line_no") > 0) & (F.size(sides) == 2))
    return rows.select((F.col("line_no") - 1).cast("int").alias("rank"), F.get(sides, F.lit(0)).alias("left"), F.get(sides, F.lit(1)).alias("right"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    return parse_merge_lines(numbered_lines(spark, path))


def read_vocabulary_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of pieces and their ids: (id, piece)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("piece", "id")).select("id", "piece")


def read_tokenizer_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (id, piece) and merges (rank, left, right) of a tokenizer's JSON file; merges are pairs or texts with a space."""
    text = spark.read.text(path, wholetext=True)
    vocabulary = text.select(F.explode(F.from_json("value", "model struct<vocab map<string,int>>").model.vocab).alias("piece", "id"))
    pairs = F.from_json("value", "model struct<merges array<array<string>>>").model.merges
    flat = F.transform(F.from_json("value", "model struct<merges array<string>>").model.merges, lambda m: F.split(m, " "))
    is_pair = F.get(F.get(pairs, F.lit(0)), F.lit(0)).isNotNull()
    merges = text.select(F.posexplode(F.when(is_pair, pairs).otherwise(flat)).alias("rank", "m"))
    return vocabulary.select("id", "piece"), merges.select("rank", F.get("m", F.lit(0)).alias("left"), F.get("m", F.lit(1)).alias("right"))


# ---- web tables ------------------------------------------------------------------------

MARKS = [("<special7>", "<tabn>"), ("<special8>", "<coln>"), ("<special9>", "<entry>"), ("*", ""), ("|||", "")]


def parse_marked_lines(lines: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One marked line is one table: (key, name, cols array<struct<pos,name,original,type,value>>).

    Tables with a short name or fewer than three columns are dropped. Position 0 is the
    pseudo column ``*`` of the table.
    """
    text = F.lower("value")
    for mark, new in MARKS:
        text = F.replace(text, F.lit(mark), F.lit(new))

    def column(p, i):
        original, cell = F.trim(F.get(p, F.lit(0))), F.trim(F.get(p, F.lit(1)))
        return F.struct(
            (i + 1).alias("pos"), first_words(original, 5).alias("name"), original.alias("original"),
            F.when(is_number_text(cell), "real").otherwise("text").alias("type"), first_words(cell, 5).alias("value"),
        )

    def parts(v):
        titled = F.filter(v.chunks, lambda c: F.contains(c, F.lit("<tabn>")))
        title = F.trim(F.replace(F.element_at(titled, -1), F.lit("<tabn>"), F.lit("")))
        pairs = F.transform(F.filter(v.chunks, lambda c: ~F.contains(c, F.lit("<tabn>"))), lambda c: F.split(c, " <entry> "))
        good = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.length(F.trim(F.get(p, F.lit(0)))) > 1))
        return let(kept, name=name_from_title(title, seed, key), cols=F.transform(good, column))

    def kept(v):
        whole = F.struct(v["name"].alias("name"), qualify(v["name"], v.cols).alias("cols"))
        return F.when((F.length(v["name"]) >= 2) & (F.size(v.cols) >= 3), F.array(whole))

    # A filter would be pushed under the parse and make it run again; the explode parses a line once.
    tables = F.explode(let(parts, chunks=F.split(text, " <coln> ")))
    return lines.select(key, tables.alias("t")).select(key, "t.name", "t.cols")


def read_marked_tables(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    lines = numbered_lines(spark, path)
    return parse_marked_lines(lines.withColumn("table_id", F.concat_ws("#", "file", F.col("line_no").cast("string"))), "table_id", seed)


def assemble_tagged_tables(cells: DataFrame, pages: DataFrame, seed: int = 0) -> DataFrame:
    """Tables from tagged cells (file, row, col, text) and page titles (file, title).

    Row -1 is the header and rows 0 to 2 are the sample; later rows are not read. A table
    whose sample rows differ in length, or whose title gives no name, is dropped. Gives
    (file, name, cols array<struct<pos,name,original,type,values>>).
    """
    short = cells.filter(F.col("row").between(-1, 2)).select("file", "row", "col", F.replace("text", F.lit("|"), F.lit(" ")).alias("text"))
    place = Window.partitionBy("file", "row").orderBy("col")
    short = short.withColumn("at", F.row_number().over(place))
    columns = short.groupBy("file", "at").agg(
        F.max(F.when(F.col("row") == -1, F.col("text"))).alias("original"),
        F.array_sort(F.collect_list(F.when(F.col("row") >= 0, F.struct("row", "text")))).alias("cells"),
    )
    columns = columns.withColumn("values", F.transform("cells", lambda c: c.text)).withColumn(
        "type", F.when(F.exists("values", is_number_text), "real").otherwise("text")
    )
    tables = columns.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").alias("pos"), F.col("original").alias("name"), "original", "type", "values"))).alias("cols")
    )
    whole = tables.filter(F.forall("cols", lambda c: c.original.isNotNull() & (F.size(c["values"]) == 3)))
    named = pages.select("file", name_from_title(F.col("title"), seed, "file").alias("name")).filter(F.col("name") != "")
    return whole.join(named, "file").select("file", "name", qualify(F.col("name"), F.col("cols"), sample=True).alias("cols"))


def read_tagged_tables(spark: SparkSession, tagged_glob: str, page_glob: str, seed: int = 0) -> DataFrame:
    def key(folder_end):
        return F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), rf"-{folder_end}/", "/"), r"\.[^./]*$", "")

    raw = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(tagged_glob)
    cells = raw.select(
        key("tagged").alias("file"), F.col("row").try_cast("int").alias("row"), F.col("col").try_cast("int").alias("col"),
        F.coalesce("lemmaTokens", F.lit("")).alias("text"),
    )
    pages = spark.read.schema("title string").option("multiLine", True).json(page_glob).select(key("page").alias("file"), "title")
    return assemble_tagged_tables(cells.filter(F.col("row").isNotNull()), pages, seed)


# ---- slot-query files --------------------------------------------------------------------


def parse_slot_tables(lines: DataFrame) -> DataFrame:
    """JSON lines to (table_id, header, types, rows); number cells keep their text."""
    schema = "id string, header array<string>, types array<string>, rows array<array<string>>"
    return lines.select(F.from_json("value", schema).alias("j")).select(F.col("j.id").alias("table_id"), "j.header", "j.types", "j.rows")


def read_slot_tables(spark: SparkSession, path) -> DataFrame:
    return parse_slot_tables(spark.read.text(path))


def parse_slot_questions(lines: DataFrame) -> DataFrame:
    """JSON lines to (id, table_id, question, sel, agg, conds); is_num marks a literal without quotes."""
    schema = "id bigint, table_id string, question string, sql struct<sel: int, agg: int, conds: array<string>>"
    j = lines.select(F.from_json("value", schema).alias("j"))
    part = lambda c, i: F.get(F.from_json(c, "array<string>"), F.lit(i))
    conds = F.transform(
        "j.sql.conds",
        lambda c: F.struct(
            part(c, 0).cast("int").alias("col"), part(c, 1).cast("int").alias("op"), part(c, 2).alias("val"),
            (~c.rlike(r'"\s*\]\s*$')).alias("is_num"),
        ),
    )
    return j.select("j.id", "j.table_id", "j.question", "j.sql.sel", "j.sql.agg", conds.alias("conds"))


def read_slot_questions(spark: SparkSession, path) -> DataFrame:
    return parse_slot_questions(spark.read.text(path))


def union_splits(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all splits; on an equal key the later split wins."""
    numbered = None
    for i, part in enumerate(parts):
        part = part.withColumn("__split", F.lit(i))
        numbered = part if numbered is None else numbered.unionByName(part)
    fields = [c for c in parts[0].columns if c != key]
    best = numbered.groupBy(key).agg(F.max_by(F.struct(*fields), "__split").alias("__row"))
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in fields])


# ---- database schemas and examples -------------------------------------------------------

SCHEMA_FIELDS = (
    "db_id string, table_names array<string>, table_names_original array<string>, column_names array<array<string>>, "
    "column_names_original array<array<string>>, column_types array<string>, primary_keys array<int>, foreign_keys array<array<int>>"
)


def split_schemas(raw: DataFrame) -> dict[str, DataFrame]:
    """Frames tables, columns, primary_keys and foreign_keys; column 0 is ``*``.

    A database id that stands twice makes the job fail when its rows are read.
    """
    times = raw.groupBy("db_id").count().filter("count > 1").select("db_id", "count")
    checked = raw.join(times, "db_id", "left").withColumn(
        "db_id", F.when(F.col("count") > 1, F.raise_error(F.concat(F.lit("repeated database id "), F.col("db_id")))).otherwise(F.col("db_id"))
    )
    tables = checked.select("db_id", F.posexplode(F.arrays_zip("table_names", "table_names_original")).alias("tab_id", "t")).select(
        "db_id", "tab_id", F.col("t.table_names").alias("name"), F.col("t.table_names_original").alias("original")
    )
    zipped = F.arrays_zip("column_names", "column_names_original", "column_types")
    columns = checked.select("db_id", F.posexplode(zipped).alias("col_id", "c")).select(
        "db_id", "col_id", F.get("c.column_names", F.lit(0)).cast("int").alias("tab_id"), F.get("c.column_names", F.lit(1)).alias("name"),
        F.get("c.column_names_original", F.lit(1)).alias("original"), F.col("c.column_types").alias("type"),
    )
    keys = checked.select("db_id", F.explode("primary_keys").alias("col_id"))
    links = checked.select("db_id", F.posexplode("foreign_keys").alias("fk_no", "k")).select(
        "db_id", "fk_no", F.get("k", F.lit(0)).alias("from_col"), F.get("k", F.lit(1)).alias("to_col")
    )
    return {"tables": tables, "columns": columns, "primary_keys": keys, "foreign_keys": links}


def read_db_schemas(spark: SparkSession, path) -> dict[str, DataFrame]:
    return split_schemas(spark.read.schema(SCHEMA_FIELDS).option("multiLine", True).json(path))


def parse_db_examples(lines: DataFrame, sql_schema: str) -> DataFrame:
    schema = f"db_id string, question string, question_toks array<string>, query string, sql {sql_schema}"
    return lines.select(F.from_json("value", schema).alias("j")).select("j.*")


def read_db_examples(spark: SparkSession, path, sql_schema: str) -> DataFrame:
    schema = f"db_id string, question string, question_toks array<string>, query string, sql {sql_schema}"
    return spark.read.schema(schema).option("multiLine", True).json(path)


# ---- templates, phrases, captions ----------------------------------------------------------


def parse_template_lines(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, value) to (file, block, pattern, constraints, count, questions).

    A block starts at its pattern line; the last block needs no blank line after it.
    """
    from ..operators.ordered import running_total

    is_start = F.contains(F.col("value"), F.lit("SQL Pattern:"))
    placed = running_total(lines, ["file"], "line_no", F.when(is_start, 1).otherwise(0), "block").filter("block > 0")
    body = F.trim("value")
    after = lambda mark: F.replace(body, F.lit(mark), F.lit(""))
    halves = F.split(F.when(is_start, after("SQL Pattern: ")).otherwise(after("question:  ")), r"\|\|\|")
    rules = F.when(
        F.size(halves) == 2,
        F.filter(F.transform(F.split(F.get(halves, F.lit(1)), r"\|"), lambda x: F.trim(x)), lambda x: x != ""),
    ).otherwise(F.array().cast("array<string>"))
    kind = (
        F.when(is_start, "pattern").when(F.contains(F.col("value"), F.lit("count: ")), "count")
        .when(F.contains(F.col("value"), F.lit("question:  ")), "question")
    )
    parts = placed.withColumn("kind", kind).withColumn("rules", rules).withColumn("text", F.get(halves, F.lit(0)))
    asked = F.struct("line_no", F.col("text").alias("text"), F.col("rules").alias("constraints"))
    return parts.groupBy("file", "block").agg(
        F.max(F.when(F.col("kind") == "pattern", F.trim("text"))).alias("pattern"),
        F.max(F.when(F.col("kind") == "pattern", F.col("rules"))).alias("constraints"),
        F.max(F.when(F.col("kind") == "count", after("count: ").cast("int"))).alias("count"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "question", asked))),
            lambda q: F.struct(q.text.alias("text"), q.constraints.alias("constraints")),
        ).alias("questions"),
    )


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    return parse_template_lines(numbered_lines(spark, path))


def parse_phrases(docs: DataFrame) -> DataFrame:
    """JSON ``{component: {key: [phrases]}}`` to (component, key, phrases)."""
    j = docs.select(F.from_json("value", "map<string, map<string, array<string>>>").alias("j"))
    return j.select(F.explode("j").alias("component", "m")).select("component", F.explode("m").alias("key", "phrases"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    return parse_phrases(spark.read.option("wholetext", True).text(path))


def parse_caption_corpus(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, value) to (file, doc, line_no, text, labels); blank lines part documents."""
    from ..operators.ordered import running_total

    blank = F.trim("value") == ""
    placed = running_total(lines, ["file"], "line_no", F.when(blank, 1).otherwise(0), "doc").filter(~blank)
    halves = F.split("value", r"\|\|\|")
    return placed.select(
        "file", "doc", "line_no", F.trim(F.get(halves, F.lit(0))).alias("text"),
        F.transform(F.split(F.trim(F.get(halves, F.lit(1))), " "), lambda x: x.cast("int")).alias("labels"),
    )


def read_caption_corpus(spark: SparkSession, path: str) -> DataFrame:
    return parse_caption_corpus(numbered_lines(spark, path))


def parse_consistency_corpus(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, value) of four parts to (file, line_no, toks, labels, question, sql); blank lines are left out."""
    parts = F.split("value", r"\|\|\|")
    part = lambda i: F.trim(F.get(parts, F.lit(i)))
    words = lambda i: F.filter(F.split(part(i), " "), lambda w: w != "")
    return lines.filter(F.trim("value") != "").select(
        "file", "line_no", words(0).alias("toks"), F.transform(words(1), lambda x: x.cast("int")).alias("labels"), words(2).alias("question"), words(3).alias("sql")
    )


def read_consistency_corpus(spark: SparkSession, path: str) -> DataFrame:
    return parse_consistency_corpus(numbered_lines(spark, path))


# ---- sentence-task files ---------------------------------------------------------------------

# Which column holds what in the train file of each task, its id mark and labels.
TASKS = {
    "mrpc": dict(a=3, b=4, label=0, guid=None, header=True, labels=["0", "1"]),
    "mnli": dict(a=8, b=9, label=-1, guid=0, header=True, labels=["contradiction", "entailment", "neutral"]),
    "mnli-mm": dict(a=8, b=9, label=-1, guid=0, header=True, labels=["contradiction", "entailment", "neutral"]),
    "cola": dict(a=3, b=None, label=1, guid=None, header=False, labels=["0", "1"]),
    "sst-2": dict(a=0, b=None, label=1, guid=None, header=True, labels=["0", "1"]),
    "sts-b": dict(a=7, b=8, label=-1, guid=0, header=True, labels=None),
    "qqp": dict(a=3, b=4, label=5, guid=0, header=True, labels=["0", "1"]),
    "qnli": dict(a=1, b=2, label=-1, guid=0, header=True, labels=["entailment", "not_entailment"]),
    "rte": dict(a=1, b=2, label=-1, guid=0, header=True, labels=["entailment", "not_entailment"]),
    "wnli": dict(a=1, b=2, label=-1, guid=0, header=True, labels=["0", "1"]),
}


def parse_task_lines(lines: DataFrame, task: str, split: str = "train") -> DataFrame:
    """Lines (line_no, value) of one task file to (guid, text_a, text_b, label).

    The header line is dropped except where the task has none; QQP rows with fewer than
    six columns are skipped.
    """
    spec = TASKS[task]
    cells = F.split("value", "\t")

    def pick(i) -> Column:
        if i is None:
            return F.lit(None).cast("string")
        return F.element_at(cells, -1) if i < 0 else F.get(cells, F.lit(i))

    found = lines.filter(F.col("line_no") > 0) if spec["header"] else lines
    if task == "qqp":
        found = found.filter(F.size(cells) >= 6)
    mark = F.col("line_no").cast("string") if spec["guid"] is None else pick(spec["guid"])
    return found.select(
        F.concat(F.lit(f"{split}-"), mark).alias("guid"), pick(spec["a"]).alias("text_a"), pick(spec["b"]).alias("text_b"),
        pick(spec["label"]).alias("label"),
    )


def read_task_tsv(spark: SparkSession, path: str, task: str, split: str = "train") -> DataFrame:
    return parse_task_lines(numbered_lines(spark, path), task, split)
