"""Database schemas: summaries, key maps, paths over foreign keys, FROM completion.

Joins with a row for every column, key or candidate carry a merge hint (see ``linking``).
"""

from pyspark.sql import DataFrame, functions as F


def member_summary(df: DataFrame, group: str, member: str, names: str, n: str) -> DataFrame:
    """Names of the members of each group in order and their number.

    For the tables or columns of a database; a database has a bounded number of them.
    """
    return df.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(member)), "|").alias(names), F.count(F.lit(1)).alias(n))


def table_shapes(columns: DataFrame, tables: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Per table: name, first column, number and list of columns, tables its foreign keys point to."""
    spans = columns.filter("tab_id >= 0").groupBy("db_id", "tab_id").agg(
        F.min("col_id").alias("first_col"), F.count(F.lit(1)).alias("n_cols"), F.array_sort(F.collect_list("col_id")).alias("cols")
    )
    a = columns.select("db_id", F.col("col_id").alias("from_col"), F.col("tab_id").alias("tab_id"))
    b = columns.select("db_id", F.col("col_id").alias("to_col"), F.col("tab_id").alias("to_tab"))
    points = foreign_keys.join(a.hint("merge"), ["db_id", "from_col"]).join(b.hint("merge"), ["db_id", "to_col"]).groupBy("db_id", "tab_id").agg(
        F.array_sort(F.collect_set("to_tab")).alias("fk_tables")
    )
    return tables.join(spans.hint("merge"), ["db_id", "tab_id"]).join(points.hint("merge"), ["db_id", "tab_id"], "left")


def key_map(raw: DataFrame) -> DataFrame:
    """Foreign-key equivalence per database: db_id, col_id, least column of its set.

    Sets are built greedily in key order and are never merged: a key joins the first set
    that holds one of its columns. The fold runs inside the row of a database.
    """
    def add(sets, key):
        a, b = F.get(key, F.lit(0)), F.get(key, F.lit(1))
        hit = F.transform(sets, lambda s: F.array_contains(s, a) | F.array_contains(s, b))
        at = F.array_position(hit, F.lit(True)) - 1
        return F.when(
            at >= 0, F.transform(sets, lambda s, i: F.when(i == at, F.array_union(s, F.array(a, b))).otherwise(s))
        ).otherwise(F.concat(sets, F.array(F.array_distinct(F.array(a, b)))))

    start = F.expr("cast(array() as array<array<int>>)")
    sets = raw.select("db_id", F.explode(F.aggregate("foreign_keys", start, add)).alias("s"))
    return sets.select("db_id", F.explode("s").alias("col_id"), F.array_min("s").alias("first_col"))


def edges_of(foreign_keys: DataFrame, columns: DataFrame) -> DataFrame:
    """Both directions of each foreign key as an array of edges per database: (a, b, a_col, b_col).

    Of two keys between the same tables the later one counts.
    """
    a = columns.select("db_id", F.col("col_id").alias("from_col"), F.col("tab_id").alias("a"))
    b = columns.select("db_id", F.col("col_id").alias("to_col"), F.col("tab_id").alias("b"))
    one = foreign_keys.join(a.hint("merge"), ["db_id", "from_col"]).join(b.hint("merge"), ["db_id", "to_col"])
    there = F.struct("a", "b", F.col("from_col").alias("a_col"), F.col("to_col").alias("b_col"))
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("to_col").alias("a_col"), F.col("from_col").alias("b_col"))
    both = one.select("db_id", "fk_no", F.explode(F.array(there, back)).alias("e")).select("db_id", "fk_no", "e.*")
    last = both.groupBy("db_id", "a", "b").agg(F.max_by(F.struct("a_col", "b_col"), "fk_no").alias("c"))
    edge = F.struct("a", "b", F.col("c.a_col").alias("a_col"), F.col("c.b_col").alias("b_col"))
    return last.groupBy("db_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def shortest_paths(edges, source):
    """Paths from one table to all it can reach: array<struct<table, path array<int>>>.

    A breadth-first walk over the edge list of one database, inside its row. Of equally
    short paths the one with the lower table numbers is taken. No path is longer than the
    number of tables that have a key.
    """
    start = F.array(F.struct(source.cast("int").alias("table"), F.array(source.cast("int")).alias("path")))

    def step(known, _):
        fresh = F.flatten(
            F.transform(
                known,
                lambda k: F.transform(
                    F.filter(edges, lambda e: (e.a == k.table) & ~F.exists(known, lambda x: x.table == e.b)),
                    lambda e: F.struct(e.b.alias("table"), F.concat(k.path, F.array(e.b)).alias("path")),
                ),
            )
        )
        ordered = F.array_sort(fresh)
        first = F.filter(ordered, lambda f, i: (i == 0) | (F.get(ordered, i - 1).table != f.table))
        return F.concat(known, first)

    n_tables = F.size(F.array_distinct(F.transform(edges, lambda e: e.a)))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n_tables, F.lit(1))), start, step)


def complete_from(items: DataFrame, edges: DataFrame) -> DataFrame:
    """FROM parts: items (item_id, db_id, used array<int>) to tables and join conditions.

    The first used table is joined to each other one over the shortest key path; tables
    on the way are added; an unreachable table stays without a condition.
    """
    from ..functions.binding import let

    with_edges = items.join(edges.hint("merge"), "db_id", "left").withColumn("used", F.array_sort(F.array_distinct("used")))
    walk = with_edges.withColumn("walk", shortest_paths(F.coalesce("edges", F.expr("cast(array() as array<struct<a:int,b:int,a_col:int,b_col:int>>)")), F.array_min("used")))
    paths = F.transform(F.filter("walk", lambda w: F.array_contains(F.col("used"), w.table)), lambda w: w.path)

    def edge_list(v):
        steps = F.flatten(
            F.transform(v.paths, lambda p: F.transform(F.slice(p, 2, F.size(p)), lambda b, i: F.struct(F.get(p, i).alias("a"), b.alias("b"))))
        )
        return F.array_distinct(
            F.transform(steps, lambda s: F.get(F.transform(F.filter(v.edges, lambda e: (e.a == s.a) & (e.b == s.b)), lambda e: F.struct(e.a_col.alias("a_col"), e.b_col.alias("b_col"))), F.lit(0)))
        )

    made = walk.withColumn("paths", paths)
    return made.select(
        "item_id", "db_id", "used", F.array_sort(F.array_union("used", F.flatten("paths"))).alias("tables"),
        let(edge_list, paths=F.col("paths"), edges=F.col("edges")).alias("conds"),
    )


def valid_from(candidates: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Predicted FROM parts that hold: adds ``valid``.

    Candidates: item_id, db_id, tables, columns, key_columns (all array<int>). No table
    may repeat, tables of all mentioned columns must be there, and the key columns must
    be those of the needed paths among the mentioned tables.
    """
    place = columns.filter("tab_id >= 0").groupBy("db_id").agg(F.map_from_entries(F.collect_list(F.struct("col_id", "tab_id"))).alias("table_of"))
    joined = candidates.withColumn("used", F.col("tables"))
    full = complete_from(joined.select("item_id", "db_id", "used"), edges).select("item_id", "conds", F.col("used").alias("known"))
    both = candidates.join(full.hint("merge"), "item_id").join(place.hint("merge"), "db_id")
    inside = F.filter("conds", lambda c: F.array_contains("tables", F.col("table_of")[c.a_col]) & F.array_contains("tables", F.col("table_of")[c.b_col]))
    needed = F.array_sort(F.array_distinct(F.flatten(F.transform(inside, lambda c: F.array(c.a_col, c.b_col)))))
    owners = F.filter(F.transform("columns", lambda c: F.col("table_of")[c]), lambda x: x.isNotNull())
    valid = (
        (F.size(F.array_distinct("tables")) == F.size("tables"))
        & (F.size(F.array_except(owners, F.col("tables"))) == 0)
        & (needed == F.array_sort(F.array_distinct("key_columns")))
    )
    return both.withColumn("valid", valid).select(*candidates.columns, "valid")
