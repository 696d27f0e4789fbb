"""Slot queries ``SELECT agg(col) FROM table WHERE col op value AND ...`` in batch.

Shapes:
    tables   table_id, header array<string>, types array<string>  ('text' or 'real')
    rows     table_id, row_id long, cells array<string>           (row_id: place in the table)
    queries  query_id, table_id, sel int, agg int,
             conds array<struct<col int, op int, val string, is_num boolean>>

All queries over all tables run in one job, over a sorted index of the cells of every
column. A condition is a stretch of places in its column, found by sorting its literal among
the cells. A query reads the shortest stretch of its conditions, block by block, and tests
the others on the rows of it: work is in proportion to the rows that the shortest stretch
holds. A table of one block needs no index, it is the block. A block that many queries read
is given to several tasks; no answer depends on the size of blocks or parts.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.literals import AGGREGATES, COMPARISONS, leading_number, literal_number, name_of, strict_number

#: Cells of a column in one block of the index, and queries that read a block in one task.
BLOCK, PART = 256, 100_000


def rows_from_nested(tables: DataFrame) -> DataFrame:
    """Rows of tables given with a nested ``rows`` array; row_id is the list place."""
    return tables.select("table_id", F.posexplode("rows").alias("row_id", "cells")).withColumn(
        "row_id", F.col("row_id").cast("long")
    )


def lower_cells(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cells", F.transform("cells", F.lower))


def to_cells(rows: DataFrame, tables: DataFrame, lower: bool = True) -> DataFrame:
    """Long form (table_id, row_id, col_id, txt, num); num only for real columns."""
    flat = (lower_cells(rows) if lower else rows).select(
        "table_id", "row_id", F.posexplode("cells").alias("col_id", "txt")
    )
    kinds = tables.select("table_id", F.posexplode("types").alias("col_id", "type"))
    return flat.join(kinds, ["table_id", "col_id"]).select(
        "table_id", "row_id", "col_id", "txt", F.when(F.col("type") == "real", strict_number(F.col("txt"))).alias("num")
    )


def lower_conditions(conds: Column) -> Column:
    """Text literals in lower case."""
    return F.transform(
        conds, lambda c: F.struct(c.col.alias("col"), c.op.alias("op"), F.lower(c.val).alias("val"), c.is_num.alias("is_num"))
    )


def sort_conditions(conds: Column) -> Column:
    """Conditions in column order; equal columns keep their places."""
    placed = F.transform(conds, lambda c, i: F.struct(c.col.alias("k"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(placed), lambda p: p.c)


def _prepare(queries: DataFrame, tables: DataFrame, last_value_wins: bool) -> DataFrame:
    """Give each condition its column type and its literal as text and number.

    A query on an unknown table stays, with ``error`` set.
    """
    known = queries.join(tables.select("table_id", "types"), "table_id", "left")

    def value_of(c):
        if not last_value_wins:
            return c.val
        return F.element_at(F.filter(F.col("conds"), lambda d: d.col == c.col), -1).val

    def ready(c):
        kind = F.get(F.col("types"), c.col)
        val = F.lower(value_of(c))
        return F.struct(
            c.col.alias("col"), c.op.alias("op"), kind.alias("type"), val.alias("txt"),
            F.when(kind == "real", literal_number(val)).alias("num"),
        )

    found = known.withColumn("conds", F.transform("conds", ready)).withColumn("sel_type", F.get("types", F.col("sel")))
    bad = F.exists(
        "conds", lambda c: c.type.isNull() | (c.op < 0) | (c.op > 2) | ((c.type == "real") & c.num.isNull())
    ) | F.col("sel_type").isNull()
    return found.withColumn("error", F.coalesce(bad, F.lit(True))).drop("types")


def holds(cells: Column, c: Column, numbers: Column | None = None) -> Column:
    """Does one prepared condition hold for a row? Text sorts after every number.

    ``numbers`` are the cells as numbers, where the caller tests a row more than once.
    """
    cell = F.get(cells, c.col)
    number = strict_number(cell) if numbers is None else F.get(numbers, c.col)
    as_number = (
        F.when(number.isNull(), c.op == 1)
        .when(c.op == 0, number == c.num)
        .when(c.op == 1, number > c.num)
        .otherwise(number < c.num)
    )
    as_text = F.when(c.op == 0, cell == c.txt).when(c.op == 1, cell > c.txt).otherwise(cell < c.txt)
    return F.coalesce(F.when(cell.isNull(), F.lit(False)).when(c.type == "real", as_number).otherwise(as_text), F.lit(False))


# Classes of cells of a column in their order: numbers, texts, and the end. Whole rows are a column of their own.
_NUMBER, _TEXT, _END, _ROWS = 0, 1, 2, -1
_STRETCH = ["table_id", "col", "class", "num", "txt", "side", "row_id"]


def _cell_entries(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """The cells of every column, and every row once, as entries of the index. NULL cells have none."""
    def entry(cell, i):
        number = F.when(F.get("types", i) == "real", strict_number(cell))
        kind = F.when(cell.isNull(), None).when(number.isNotNull(), _NUMBER).otherwise(_TEXT)
        return F.struct(i.alias("col"), kind.alias("class"), number.alias("num"), F.when(number.isNull(), cell).alias("txt"))

    row = F.struct(F.lit(_ROWS).alias("col"), F.lit(_NUMBER).alias("class"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("txt"))
    known = rows.join(tables.select("table_id", "types"), "table_id")
    found = known.select("table_id", "row_id", F.explode(F.concat(F.array(row), F.transform("cells", entry))).alias("e"))
    return found.filter("e.class is not null").select("table_id", "e.*", F.lit(0).alias("side"), "row_id")


def _bound_entries(asked: DataFrame) -> DataFrame:
    """Where the stretches of all conditions begin and end, as entries among the cells.

    ``side`` puts a bound before (-1) or after (1) the cells that equal its literal. A query
    without conditions reads all rows.
    """
    def bound(which, k, col, kind, num=None, txt=None, side=0):
        none = F.lit(None)
        return F.struct(
            F.lit(which).alias("which"), k.alias("k"), col.alias("col"), kind.alias("class"), (none if num is None else num).cast("double").alias("num"),
            (none if txt is None else txt).cast("string").alias("txt"), F.lit(side).alias("side"),
        )

    def bounds(c, k):
        kind = F.when(c.type == "real", _NUMBER).otherwise(_TEXT)
        txt = F.when(c.type != "real", c.txt)
        before, after = [lambda which, side=side: bound(which, k, c.col, kind, c.num, txt, side) for side in (-1, 1)]
        to_end = bound("last", k, c.col, F.lit(_END))
        return F.when(c.op == 0, F.array(before("first"), after("last"))).when(c.op == 1, F.array(after("first"), to_end)).otherwise(F.array(before("last")))

    every = F.array(bound("last", F.lit(0), F.lit(_ROWS), F.lit(_END)))
    made = F.when(F.size("conds") == 0, every).otherwise(F.flatten(F.transform("conds", bounds)))
    return asked.select("query_id", "table_id", F.explode(made).alias("b")).select("query_id", "table_id", "b.*")


def _stretches(asked: DataFrame, rows: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index (table_id, col, place, row_id), and the shortest stretch of each query (query_id, table_id, col, first, last).

    A stretch is the places above ``first`` up to ``last``; queries with an empty one are left out.
    """
    from .ordered import running_total

    bounds, cells = _bound_entries(asked), _cell_entries(rows, tables)
    placed = running_total(
        cells.unionByName(bounds, allowMissingColumns=True), ["table_id", "col"], _STRETCH[2:], F.when(F.col("which").isNull(), 1).otherwise(0), "place"
    )
    def at(which):
        return F.coalesce(F.max(F.when(F.col("which") == which, F.col("place"))), F.lit(0))

    found = placed.filter("which is not null").repartition("query_id").groupBy("query_id", "k", "table_id", "col").agg(at("first").alias("first"), at("last").alias("last"))
    shortest = found.groupBy("query_id").agg(F.min_by(F.struct("table_id", "col", "first", "last"), F.struct(F.col("last") - F.col("first"), "k")).alias("s")).select("query_id", "s.*")
    return placed.filter("which is null").select("table_id", "col", "place", "row_id"), shortest.filter("last > first")


_IN_BLOCK = ["table_id", "col", "block"]


def _read_blocks(asked: DataFrame, data: DataFrame, tables: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """What the queries read of tables that have several blocks, and these blocks with the cells of their rows."""
    index, shortest = _stretches(asked, data, tables)
    wanted = F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block)))
    read = shortest.withColumn("block", wanted)
    blocks = index.withColumn("block", F.floor((F.col("place") - 1) / block)).join(read.select(*_IN_BLOCK).distinct(), _IN_BLOCK, "left_semi")
    return read.join(asked.drop("table_id"), "query_id"), blocks.join(data, ["table_id", "row_id"])


def _selected(ready: DataFrame, rows: DataFrame, tables: DataFrame, part: int, block: int) -> DataFrame:
    """query_id, agg, sel_type, row_id, txt (the selected cell) and num (its number) for every selected row, and whether its table has several blocks."""
    from ..session import cut_lineage

    asked = ready.filter(~F.col("error")).select("query_id", "table_id", "sel", "agg", "sel_type", "conds")
    data = lower_cells(rows).select("table_id", "row_id", "cells", F.transform("cells", strict_number).alias("nums"))
    large = cut_lineage(rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("table_id"))

    def whole(df):
        return df.withColumns({"col": F.lit(_ROWS), "block": F.lit(0).cast("long")})

    left, right, near, of_blocks = whole(asked), whole(data), F.lit(True), F.lit(False)
    if not large.isEmpty():
        of_large = lambda df, how: df.join(large, "table_id", how)
        read, blocks = _read_blocks(of_large(asked, "left_semi"), of_large(data, "left_semi"), tables, block)
        left = of_large(left, "left_anti").unionByName(read, allowMissingColumns=True)
        right = of_large(right, "left_anti").unionByName(blocks, allowMissingColumns=True)
        near = F.coalesce((F.col("place") > F.col("first")) & (F.col("place") <= F.col("last")), F.lit(True))
        of_blocks = F.col("place").isNotNull()
    parts = left.groupBy(*_IN_BLOCK).agg(F.ceil(F.count(F.lit(1)) / part).alias("parts")).filter("parts > 1")
    several = cut_lineage(parts)
    if not several.isEmpty():
        one = F.coalesce("parts", F.lit(1).cast("long"))
        left = left.join(several, _IN_BLOCK, "left").withColumn("part", F.pmod(F.xxhash64("query_id"), one)).drop("parts")
        right = right.join(several, _IN_BLOCK, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("parts")
    both = left.join(right, [c for c in left.columns if c in (*_IN_BLOCK, "part")]).filter(near)
    return both.filter(F.forall("conds", lambda c: holds(F.col("cells"), c, F.col("nums")))).select(
        "query_id", "agg", "sel_type", "row_id", F.get("cells", F.col("sel")).alias("txt"),
        F.get("nums", F.col("sel")).alias("num"), of_blocks.alias("of_blocks"),
    )


def _run(queries: DataFrame, tables: DataFrame, rows: DataFrame, part: int = PART, block: int = BLOCK, last_value_wins: bool = True) -> tuple[DataFrame, DataFrame]:
    """The prepared queries, written once to the checkpoint folder, and the rows they select."""
    from ..session import cut_lineage

    ready = cut_lineage(_prepare(queries.select("query_id", "table_id", "sel", "agg", "conds"), tables, last_value_wins))
    return ready, _selected(ready, rows, tables, part, block)


def matches(queries: DataFrame, tables: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """The rows each query selects: query_id, agg, sel_type, row_id, txt (the selected cell)."""
    return _run(queries, tables, rows, **options)[1].drop("num", "of_blocks")


def summaries(queries: DataFrame, tables: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """One row per query: query_id, agg, error, n_rows, num and txt.

    num is the value of an aggregate over numbers, txt of MAX or MIN over a text column.
    A query with no rows has n_rows 0, COUNT 0 and no value. A query that cannot run
    (unknown table, column or operator, no number in the literal for a number column)
    has error set.
    """
    return _totals(*_run(queries, tables, rows, **options))


def _totals(ready: DataFrame, found: DataFrame) -> DataFrame:
    number = F.when(F.col("sel_type") == "real", F.col("num"))
    summand = F.when(F.col("txt").isNotNull(), F.coalesce(number, leading_number(F.col("txt"))))
    text = F.when(F.col("sel_type") != "real", F.col("txt"))
    totals = found.groupBy("query_id").agg(
        F.count("row_id").alias("n_rows"), F.count("txt").alias("n_cells"), F.max(number).alias("max_num"), F.min(number).alias("min_num"),
        F.max(text).alias("max_txt"), F.min(text).alias("min_txt"), F.sum(summand).alias("total"),
    )
    runs = ~F.col("error")
    zero = F.lit(0).cast("long")
    return ready.select("query_id", "agg", "error").join(totals, "query_id", "left").select(
        "query_id", "agg", "error", F.coalesce("n_rows", zero).alias("n_rows"),
        F.when(runs & (F.col("agg") == 1), F.col("max_num")).when(runs & (F.col("agg") == 2), F.col("min_num"))
        .when(runs & (F.col("agg") == 3), F.coalesce("n_cells", zero).cast("double")).when(runs & (F.col("agg") == 4), F.col("total"))
        .when(runs & (F.col("agg") == 5) & (F.col("n_cells") > 0), F.col("total") / F.col("n_cells")).alias("num"),
        F.when(runs & (F.col("agg") == 1), F.col("max_txt")).when(runs & (F.col("agg") == 2), F.col("min_txt")).alias("txt"),
    )


def answer_items(queries: DataFrame, tables: DataFrame, rows: DataFrame, digits: int = 6, **options) -> DataFrame:
    """The answer lists in long form: query_id, place (from 1, in row order), cell.

    A number is written ``n`` and its rounded value, a text ``t`` and the text, so a list
    of one number equals an aggregate with that number. An aggregate is a list of one; a
    query that cannot run has the one cell ``error``. All queries run together; the rows they
    select are written to the checkpoint folder, as aggregates and lists both read them. A
    list from a table of one block is numbered in one task, longer ones over ranges.
    """
    from ..session import cut_lineage
    from .ordered import running_number

    def number(c):
        return F.concat(F.lit("n"), F.round(c, digits).cast("string"))

    ready, found = _run(queries, tables, rows, **options)
    found = cut_lineage(found)
    total = _totals(ready.filter("agg <> 0 or error"), found.filter("agg <> 0"))
    single = total.select(
        "query_id", F.lit(1).cast("long").alias("place"),
        F.when(F.col("error"), "error").otherwise(F.coalesce(number(F.col("num")), F.concat(F.lit("t"), F.col("txt")), F.lit("none"))).alias("cell"),
    )
    text = F.concat(F.lit("t"), F.col("txt"))
    cell = F.when(F.col("sel_type") == "real", F.coalesce(number(F.col("num")), text)).otherwise(text)
    kept = found.filter("agg = 0").select("query_id", "row_id", F.coalesce(cell, F.lit("none")).alias("cell"), "of_blocks")
    inside = F.row_number().over(Window.partitionBy("query_id").orderBy("row_id")).cast("long")
    placed = [kept.filter(~F.col("of_blocks")).withColumn("place", inside)]
    long = kept.filter("of_blocks")
    if not long.isEmpty():
        placed.append(running_number(long, ["query_id"], "row_id", "place"))
    for lists in placed:
        single = single.unionByName(lists.select("query_id", "place", "cell"))
    return single


def answer_digests(queries: DataFrame, tables: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """One row per query with its whole answer in comparable form: query_id, error, n_items, answer.

    Each item is hashed with its place and the hashes are summed exactly (their halves as long
    numbers), so two long lists are compared without gathering either in one task.
    """
    def total(digest):
        high, low = F.sum(F.shiftright(digest, 32)), F.sum(digest.bitwiseAND(F.lit((1 << 32) - 1)))
        return high.cast("decimal(38,0)") * F.lit(1 << 32) + low

    whole = F.col("cell") != "error"
    digest = answer_items(queries, tables, rows, **options).groupBy("query_id").agg(
        F.max(~whole).alias("error"), F.count_if(whole).alias("n_items"),
        F.concat_ws(
            "|", total(F.xxhash64("place", "cell")).cast("decimal(38,0)").cast("string"),
            total(F.xxhash64(F.lit(17), "cell", "place")).cast("decimal(38,0)").cast("string"),
        ).alias("answer"),
    )
    return queries.select("query_id").join(digest, "query_id", "left").select(
        "query_id", F.coalesce("error", F.lit(False)).alias("error"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("answer", F.lit("")).alias("answer"),
    )


def with_answer(candidates: DataFrame, tables: DataFrame, rows: DataFrame, **options) -> DataFrame:
    """Keep the candidates whose answer list is not empty.

    MAX, MIN, COUNT, SUM and AVG always give a list of one item; a plain list must have rows.
    All candidates run, but only the number of their rows leaves the run.
    """
    ready, found = _run(candidates, tables, rows, **options)
    selected = found.groupBy("query_id").agg(F.count("row_id").alias("n_rows"))
    runs = ready.filter(~F.col("error")).select("query_id", (F.col("agg") > 0).alias("one"))
    both = runs.unionByName(selected, allowMissingColumns=True).groupBy("query_id").agg(F.max("one").alias("one"), F.max("n_rows").alias("n_rows"))
    good = both.filter("one or n_rows > 0")
    return candidates.join(good.select("query_id"), "query_id", "left_semi")


def allowed_pair(kind: Column, agg: Column) -> Column:
    """May this aggregate be used on a column of this type? Unknown types raise an error."""
    return (
        F.when(kind == "text", agg.isin(0, 3)).when(kind == "real", F.lit(True))
        .otherwise(F.raise_error(F.concat(F.lit("unknown column type "), kind)).cast("boolean"))
    )


def generate_queries(tables: DataFrame, rows: DataFrame, n: int, seed, rounds: int = 4, tries: int = 5) -> DataFrame:
    """``n`` random queries per table that give an answer: query_id, table_id, sel, agg, conds, n_rows.

    Queries without an answer are drawn again with another seed, together, until each number
    has had ``tries`` tries; a number that never gave an answer has no row.
    """
    from ..session import cut_lineage

    data = lower_cells(rows).select("table_id", "row_id", "cells")
    wanted = tables.select("table_id", "types", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("no")).select(
        F.concat_ws("#", "table_id", F.col("no").cast("string")).alias("query_id"), "table_id", "types"
    )
    found = None
    for k in range(tries):
        made = cut_lineage(_drawn_queries(wanted, data, seed if k == 0 else f"{seed} try {k}", rounds))
        found = made if found is None else found.unionByName(made)
        wanted = cut_lineage(wanted.join(made.select("query_id"), "query_id", "left_anti"))
        if wanted.isEmpty():
            break
    return found


def _drawn_queries(wanted: DataFrame, data: DataFrame, seed, rounds: int) -> DataFrame:
    """One try for each wanted query (query_id, table_id, types); only those with an answer come out.

    A select column is drawn; in each round a further column, an operator and the cell of
    a drawn row of the current answer make a condition, kept only if it changes the
    answer. As a condition can only remove rows, the answer changes if and only if its
    length does. All open queries go through a round together; the remaining rows are
    written to the checkpoint folder after each round, so a round reads them once.
    """
    from ..functions.seeded import pick_item, pick_number, unit
    from ..session import cut_lineage

    state = wanted.withColumn("sel", pick_number(F.size("types"), seed, "select", "query_id"))
    state = state.withColumn("open", F.filter(F.sequence(F.lit(0), F.size("types") - 1), lambda i: i != F.col("sel")))
    state = state.withColumn("conds", F.expr("cast(array() as array<struct<col:int,op:int,val:string,is_num:boolean>>)"))
    alive = cut_lineage(state.select("query_id", "table_id").join(data, "table_id").drop("table_id"))
    for r in range(rounds):
        drawn = alive.groupBy("query_id").agg(
            F.count(F.lit(1)).alias("n_old"), F.min_by("cells", unit(seed, f"row {r}", "query_id", F.col("row_id").cast("string"))).alias("picked")
        )
        step = state.filter((F.size("open") > 0) & (F.size("types") > r)).join(drawn, "query_id")
        step = step.withColumn("col", pick_item(F.col("open"), seed, f"column {r}", "query_id")).withColumn("type", F.get("types", F.col("col")))
        step = step.withColumn("op", F.when(F.col("type") == "text", 0).otherwise(pick_number(3, seed, f"op {r}", "query_id")))
        step = step.withColumn("val", F.get("picked", F.col("col")))
        test = F.struct("col", "op", "type", F.col("val").alias("txt"), F.when(F.col("type") == "real", literal_number(F.col("val"))).alias("num"))
        tried = cut_lineage(
            alive.join(step.select("query_id", "n_old", test.alias("test")), "query_id", "left")
            .withColumn("ok", F.when(F.col("test").isNotNull(), holds(F.col("cells"), F.col("test"))).otherwise(True))
        )
        kept = tried.filter("test is not null").groupBy("query_id", "n_old", "test").agg(F.count_if("ok").alias("n_new")).filter("n_new != n_old")
        taken = kept.select(
            "query_id", F.struct(F.col("test.col").alias("col"), F.col("test.op").alias("op"), F.col("test.txt").alias("val"), (F.col("test.type") == "real").alias("is_num")).alias("new")
        )
        joined = state.join(taken, "query_id", "left")
        more = F.col("new").isNotNull()
        state = cut_lineage(
            joined.withColumn("conds", F.when(more, F.concat("conds", F.array("new"))).otherwise(F.col("conds")))
            .withColumn("open", F.when(more, F.filter("open", lambda i: i != F.col("new.col"))).otherwise(F.col("open"))).drop("new")
        )
        changed = taken.select("query_id", F.lit(True).alias("changed"))
        alive = tried.join(changed, "query_id", "left").filter(F.col("changed").isNull() | F.col("ok")).select("query_id", "row_id", "cells")
        alive = cut_lineage(alive)
    kind = F.get("types", F.col("sel"))
    agg = F.when(kind == "text", 0).otherwise(pick_number(len(AGGREGATES), seed, "agg", "query_id"))
    left = alive.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"))
    done = state.withColumn("agg", agg).join(left, "query_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return done.filter((F.col("agg") > 0) | (F.col("n_rows") > 0)).select("query_id", "table_id", "sel", "agg", "conds", "n_rows")


# ---- text forms -----------------------------------------------------------------

# Words of the aggregates and operators in a spoken query.
SPOKEN_AGGREGATES = ["", "max", "min", "count", "sum", "average"]
SPOKEN_COMPARISONS = ["equals", "is larger than", "is smaller than", "op"]


def _joined(items: Column, sep: str) -> Column:
    return F.array_join(items, sep)


def sql_text(header: Column | None, sel: Column, agg: Column, conds: Column, table: Column, style: str) -> Column:
    """A slot query as SQL text.

    style ``numbered``: columns as colN, an empty aggregate leaves its space.
    style ``named``: header names, always with WHERE.
    style ``readable``: lower-case aggregate, the selected header always in parentheses.
    """
    agg_name = name_of(AGGREGATES, agg)
    op_name = lambda c: name_of(COMPARISONS, c.op)
    if style == "numbered":
        where = _joined(F.transform(conds, lambda c: F.concat_ws(" ", F.concat(F.lit("col"), c.col.cast("string")), op_name(c), c.val)), " AND ")
        return F.concat(
            F.lit("SELECT "), agg_name, F.lit(" col"), sel.cast("string"), F.lit(" FROM table"),
            F.when(F.size(conds) > 0, F.concat(F.lit(" WHERE "), where)).otherwise(F.lit("")),
        )
    if style == "named":
        where = _joined(F.transform(conds, lambda c: F.concat_ws(" ", F.get(header, c.col), op_name(c), c.val)), " AND ")
        picked = F.get(header, sel)
        shown = F.when(agg == 0, picked).otherwise(F.concat(agg_name, F.lit("("), picked, F.lit(")")))
        return F.concat(F.lit("SELECT "), shown, F.lit(" FROM "), table, F.lit(" WHERE "), where)
    where = _joined(F.transform(conds, lambda c: F.concat_ws(" ", F.get(header, c.col), op_name(c), c.val)), " AND ")
    return F.concat(
        F.lit("SELECT "), F.lower(agg_name), F.lit("("), F.get(header, sel), F.lit(") FROM "), table,
        F.when(F.size(conds) > 0, F.concat(F.lit(" WHERE "), where)).otherwise(F.lit("")),
    )


def spoken_text(header: Column, sel: Column, agg: Column, conds: Column, quoted, bracketed: bool = False) -> Column:
    """A slot query in words; ``quoted(i)`` tells whether text literal i gets quotes."""
    name = lambda c: F.concat(F.lit("(["), F.get(header, c), F.lit("])")) if bracketed else F.get(header, c)
    value = lambda v: F.concat(F.lit("{["), v, F.lit("]}")) if bracketed else v
    select = F.concat_ws(" ", F.lit("select"), F.nullif(name_of(SPOKEN_AGGREGATES, agg), F.lit("")), name(sel))
    parts = F.transform(
        conds,
        lambda c, i: F.concat_ws(
            " ", name(c.col), name_of(SPOKEN_COMPARISONS, c.op),
            value(F.when(~c.is_num & quoted(i), F.concat(F.lit('"'), c.val, F.lit('"'))).otherwise(c.val)),
        ),
    )
    return F.when(F.size(conds) > 0, F.concat(select, F.lit(" where "), _joined(parts, " and "))).otherwise(select)


def column_labels(n_columns: Column, sel: Column, agg: Column, conds: Column) -> Column:
    """Per column: 1 + aggregate for the selected one, 7 + operator for a condition, else 0."""
    last_op = lambda i: F.element_at(F.filter(conds, lambda c: c.col == i), -1).op
    at = F.sequence(F.lit(0), n_columns - 1)
    return F.transform(
        at, lambda i: F.when(i == sel, agg + 1).when(F.exists(conds, lambda c: c.col == i), last_op(i) + 7).otherwise(F.lit(0))
    )


# Marks of a query written as a symbol sequence.
SYMBOLS = ["SELECT", "WHERE", "AND", "COL", "TABLE", "CAPTION", "PAGE", "SECTION", "OP", "COND", "QUESTION", "AGG", "AGGOPS", "CONDOPS"]


def symbol_output(header: Column, sel: Column, agg: Column, conds: Column) -> Column:
    """``SYMSELECT SYMAGG agg SYMCOL name [SYMWHERE SYMCOL name SYMOP op SYMCOND value SYMAND ...] SYMEND``."""
    head = F.concat(F.lit("SYMSELECT SYMAGG "), name_of(AGGREGATES, agg), F.lit(" SYMCOL "), F.get(header, sel))
    parts = F.transform(
        conds,
        lambda c: F.concat(F.lit("SYMCOL "), F.get(header, c.col), F.lit(" SYMOP "), name_of(COMPARISONS, c.op), F.lit(" SYMCOND "), c.val),
    )
    return F.when(
        F.size(conds) > 0, F.concat(head, F.lit(" SYMWHERE "), _joined(parts, " SYMAND "), F.lit(" SYMEND"))
    ).otherwise(F.concat(head, F.lit(" SYMEND")))


def symbol_input(header: Column, question: Column) -> Column:
    marks = " ".join("SYM" + s for s in SYMBOLS)
    fixed = f"SYMSYMS {marks} SYMAGGOPS {' '.join(AGGREGATES)} SYMCONDOPS {' '.join(COMPARISONS)} SYMTABLE "
    return F.concat(
        F.lit(fixed), _joined(F.transform(header, lambda h: F.concat(F.lit("SYMCOL "), h)), " "),
        F.lit(" SYMQUESTION "), question, F.lit(" SYMEND"),
    )


def read_symbols(df: DataFrame, sequence: str, header: str) -> DataFrame:
    """Read symbol sequences back to slot queries: adds sel, agg, conds and error.

    Names are compared in lower case and without white space, so a sequence that was
    split in tokens still finds its column. An unknown column, aggregate or operator
    sets ``error`` and leaves the parts NULL.
    """
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    body = F.lower(F.regexp_replace(F.col(sequence), r"(?i)\s*\bsymend\b.*$", ""))
    names = F.transform(header, squeeze)
    column = lambda text: F.when(
        F.array_contains(names, squeeze(text)), (F.array_position(names, squeeze(text)) - 1).cast("int")
    )
    halves = F.split(body, r"\s*\bsymwhere\b\s*", 2)
    head = F.regexp_extract(halves[0], r"^symselect symagg\s+(\w*)\s*symcol\s+(.*)$", 1)
    aggs = F.array(*[F.lit(a.lower()) for a in AGGREGATES])
    agg_id = (F.array_position(aggs, head) - 1).cast("int")
    picked = column(F.regexp_extract(halves[0], r"^symselect symagg\s+(\w*)\s*symcol\s+(.*)$", 2))
    pattern = r"^symcol\s+(.*?)\s+symop\s+(.*?)\s+symcond\s+(.*)$"
    ops = F.array(*[F.lit(o.lower()) for o in COMPARISONS])

    def condition(text):
        return F.struct(
            column(F.regexp_extract(text, pattern, 1)).alias("col"),
            (F.array_position(ops, F.regexp_extract(text, pattern, 2)) - 1).cast("int").alias("op"),
            F.regexp_extract(text, pattern, 3).alias("val"),
        )

    parts = F.when(F.size(halves) > 1, F.split(F.trim(halves[1]), r"\s+symand\s+"))
    conds = F.coalesce(F.transform(parts, condition), F.expr("cast(array() as array<struct<col:int,op:int,val:string>>)"))
    out = df.withColumn("sel", picked).withColumn("agg", agg_id).withColumn("conds", conds)
    wrong = (
        ~body.startswith("symselect symagg") | F.col("sel").isNull() | (F.col("agg") < 0)
        | F.exists("conds", lambda c: c.col.isNull() | (c.op < 0))
    )
    out = out.withColumn("error", wrong)
    return out.select(
        *[c for c in out.columns if c not in ("sel", "agg", "conds")],
        *[F.when(~F.col("error"), F.col(c)).alias(c) for c in ("sel", "agg", "conds")],
    )
