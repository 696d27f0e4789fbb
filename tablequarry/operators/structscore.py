"""Structural scores of multi-table queries given as nested structs.

A query is a struct with the fields of ``QUERY_SCHEMA``; nested queries inside a
condition are canonical JSON text (``sub1``, ``sub2``), set operations hold one inner
query without further nesting.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let

COL_UNIT = "struct<agg:int,col:string,distinct:boolean>"
VAL_UNIT = f"struct<op:int,c1:{COL_UNIT},c2:{COL_UNIT}>"
CONDITION = f"struct<negated:boolean,op:int,unit:{VAL_UNIT},val1:string,val2:string,sub1:string,sub2:string>"
CORE_FIELDS = (
    f"sel_distinct:boolean,sel:array<struct<agg:int,unit:{VAL_UNIT}>>,tables:array<string>,from_conds:array<{CONDITION}>,from_ao:array<string>,"
    f"where:array<{CONDITION}>,where_ao:array<string>,grp:array<{COL_UNIT}>,having:array<{CONDITION}>,having_ao:array<string>,"
    f"order_dir:string,ord:array<{VAL_UNIT}>,lim:int"
)
CORE_SCHEMA = f"struct<{CORE_FIELDS}>"
QUERY_SCHEMA = f"struct<{CORE_FIELDS},intersect_q:{CORE_SCHEMA},except_q:{CORE_SCHEMA},union_q:{CORE_SCHEMA}>"

# Ids of the condition operators.
WHERE_OPS = ["not", "between", "=", ">", "<", ">=", "<=", "!=", "in", "like", "is", "exists"]
IN, LIKE = WHERE_OPS.index("in"), WHERE_OPS.index("like")

# Names of the ten parts.
PARTS = ["select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "group", "order", "and/or", "IUEN", "keywords"]
SET_OPS = ["intersect_q", "except_q", "union_q"]


# ---- normal form -----------------------------------------------------------------------------


def normal(q: Column, keys: Column, set_ops: bool = True) -> Column:
    """Literals and DISTINCT dropped; key columns of FROM tables as the first of their key set.

    ``keys`` maps a column (``table.column``) to the least column of its set.
    """
    def col_unit(u):
        table = F.substring_index(u.col, ".", 1)
        name = F.when(F.array_contains(q.tables, table), F.coalesce(keys[u.col], u.col)).otherwise(u.col)
        return F.when(u.isNotNull(), F.struct(u.agg.alias("agg"), name.alias("col"), F.lit(None).cast("boolean").alias("distinct")))

    def val_unit(u):
        return F.when(u.isNotNull(), F.struct(u.op.alias("op"), col_unit(u.c1).alias("c1"), col_unit(u.c2).alias("c2")))

    def condition(c):
        none = F.lit(None).cast("string")
        return F.struct(
            c.negated.alias("negated"), c.op.alias("op"), val_unit(c.unit).alias("unit"), none.alias("val1"), none.alias("val2"),
            c.sub1.alias("sub1"), c.sub2.alias("sub2"),
        )

    fields = {
        "sel_distinct": F.lit(None).cast("boolean"),
        "sel": F.transform(q.sel, lambda s: F.struct(s.agg.alias("agg"), val_unit(s.unit).alias("unit"))),
        "tables": q.tables,
        "from_conds": F.transform(q.from_conds, condition), "from_ao": q.from_ao,
        "where": F.transform(q["where"], condition), "where_ao": q.where_ao,
        "grp": F.transform(q.grp, col_unit),
        "having": F.transform(q.having, condition), "having_ao": q.having_ao,
        "order_dir": q.order_dir, "ord": F.transform(q.ord, val_unit), "lim": q.lim,
    }
    if set_ops:
        for s in SET_OPS:
            fields[s] = F.when(q[s].isNotNull(), let(lambda v: normal(v.inner, keys, False), inner=q[s]))
    return F.struct(*[v.alias(k) for k, v in fields.items()])


# ---- the ten parts ------------------------------------------------------------------------------

_SEP, _END = "\u001f", "\u001e"  # between the fields of an item, and after an item


def _text(*fields) -> Column:
    """An item as text; NULL fields differ from empty ones."""
    return F.concat_ws(_SEP, *[F.coalesce(f.cast("string"), F.lit("\u0001")) for f in fields])


def _bag(items: Column) -> Column:
    """Texts of items in any order as one text."""
    return F.array_join(F.array_sort(items), _END)


def _set(items: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(items)), _END)


def _col_unit(u: Column) -> Column:
    return F.when(u.isNotNull(), _text(u.agg, u.col))


def _val_unit(u: Column) -> Column:
    return F.when(u.isNotNull(), _text(u.op, _col_unit(u.c1), _col_unit(u.c2)))


def _condition(c: Column) -> Column:
    return _text(c.negated, c.op, _val_unit(c.unit), c.sub1, c.sub2)


def keywords(q: Column, set_ops: bool = True) -> Column:
    """The set of key words of a query."""
    conds = F.concat(q.from_conds, q["where"], q.having)
    joins = F.concat(q.from_ao, q.where_ao, q.having_ao)
    nested = [F.when(q[s].isNotNull(), s[:-2]) for s in SET_OPS] if set_ops else []
    marks = [
        F.when(F.size(q["where"]) > 0, "where"), F.when(F.size(q.grp) > 0, "group"), F.when(F.size(q.having) > 0, "having"),
        F.when(F.size(q.ord) > 0, q.order_dir), F.when(F.size(q.ord) > 0, "order"), F.when(q.lim.isNotNull(), "limit"), *nested,
        F.when(F.array_contains(joins, "or"), "or"), F.when(F.exists(conds, lambda c: c.negated), "not"),
        F.when(F.exists(conds, lambda c: c.op == IN), "in"), F.when(F.exists(conds, lambda c: c.op == LIKE), "like"),
    ]
    return F.array_sort(F.filter(F.array(*marks), lambda m: m.isNotNull()))


#: The texts of a query that its parts are compared by, and the counts of its parts.
_TEXTS = ["sel", "sel_units", "where", "where_units", "grp", "grp_full", "ord", "ao", "words"]
_COUNTS = ["n_sel", "n_where", "n_grp", "n_ord", "n_ao", "n_words"]


def signature(q: Column, set_ops: bool = True) -> Column:
    """A query in normal form as one sorted text for each part, made once and compared by equality.

    Fields: ``_TEXTS`` (a part that both queries lack is the same), ``tables``, ``_COUNTS``, and
    for each set operation the text and the tables of its inner query (NULL where it has none).
    """
    units = lambda a: _bag(F.transform(a, lambda c: _val_unit(c.unit)))
    order = _text(F.array_join(F.transform(q.ord, _val_unit), _END), q.order_dir, q.lim.isNull())
    group = F.concat_ws(
        "\u001d", F.array_join(F.transform(q.grp, lambda u: u.col), _END), F.array_join(F.transform(q.having, _condition), _END), F.array_join(q.having_ao, _END)
    )

    def made(v):
        found = {
            "sel": _bag(F.transform(q.sel, lambda x: _text(x.agg, _val_unit(x.unit)))), "sel_units": units(q.sel),
            "where": _bag(F.transform(q["where"], _condition)), "where_units": units(q["where"]),
            "grp": _bag(F.transform(q.grp, lambda u: F.substring_index(u.col, ".", -1))), "grp_full": F.when(F.size(q.grp) > 0, group).otherwise(""),
            "ord": F.when(F.size(q.ord) > 0, order).otherwise(""), "ao": _set(q.where_ao), "words": F.array_join(v.words, _END),
            "tables": _bag(q.tables), "n_sel": F.size(q.sel), "n_where": F.size(q["where"]), "n_grp": F.size(q.grp), "n_ord": F.size(q.ord),
            "n_ao": F.size(F.array_distinct(q.where_ao)), "n_words": F.size(v.words), "any_table": F.size(q.tables) > 0,
        }
        if set_ops:
            for s in SET_OPS:
                inner = let(lambda w: F.struct(_text(*[w.i[f] for f in (*_TEXTS, *_COUNTS)]).alias("body"), w.i.tables.alias("tables"), w.i.any_table.alias("any_table")), i=signature(q[s], False))
                found[s] = F.when(q[s].isNotNull(), inner)
        return F.struct(*[c.alias(n) for n, c in found.items()])

    return let(made, words=keywords(q, set_ops))


def _score(label: Column, pred: Column, same: Column) -> Column:
    return F.struct(label.cast("int").alias("label_total"), pred.cast("int").alias("pred_total"), F.coalesce(same, F.lit(False)).cast("int").alias("score"))


def _same_tables(p: Column, g: Column) -> Column:
    return ~g.any_table | (p.tables == g.tables)


def part_scores(p: Column, g: Column) -> Column:
    """Map of the ten parts to (label_total, pred_total, score), from two signatures."""
    some = lambda n: (n > 0).cast("int")
    same = lambda f: p[f] == g[f]
    n_of = lambda q: sum((q[s].isNotNull().cast("int") for s in SET_OPS), F.lit(0))
    hits = sum((F.coalesce((p[s].body == g[s].body) & _same_tables(p[s], g[s]), F.lit(False)).cast("int") for s in SET_OPS), F.lit(0))
    one_ao = lambda n: F.when(same("ao"), 1).otherwise(n)
    parts = [
        _score(g.n_sel, p.n_sel, same("sel")), _score(g.n_sel, p.n_sel, same("sel_units")),
        _score(g.n_where, p.n_where, same("where")), _score(g.n_where, p.n_where, same("where_units")),
        _score(g.n_grp, p.n_grp, same("grp")), _score(some(g.n_grp), some(p.n_grp), same("grp_full") & (some(g.n_grp) == some(p.n_grp))),
        _score(some(g.n_ord), some(p.n_ord), same("ord")), _score(one_ao(p.n_ao), one_ao(g.n_ao), same("ao")),
        _score(n_of(g), n_of(p), (n_of(p) == n_of(g)) & (hits == n_of(p))), _score(g.n_words, p.n_words, same("words")),
    ]
    return F.map_from_arrays(F.array(*[F.lit(n) for n in PARTS]), F.array(*parts))


def all_right(scores: Column, p: Column, g: Column) -> Column:
    """All parts right and the same FROM tables; ``p`` and ``g`` are signatures."""
    return F.forall(F.map_values(scores), lambda s: s.score == 1) & _same_tables(p, g)


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (item_id, gold, pred, keys) to item_id, hardness, exact and the part scores.

    The signatures are made once per row, in a projection of their own, and then compared.
    """
    signed = lambda q: let(lambda v: signature(v.n), n=normal(F.col(q), F.col("keys")))
    made = pairs.select("item_id", hardness(F.col("gold")).alias("hardness"), signed("pred").alias("p"), signed("gold").alias("g"))
    scored = made.select("item_id", "hardness", "p", "g", part_scores(F.col("p"), F.col("g")).alias("parts"))
    return scored.select("item_id", "hardness", all_right(F.col("parts"), F.col("p"), F.col("g")).cast("int").alias("exact"), "parts")


# ---- hardness -------------------------------------------------------------------------------------


def hardness(q: Column) -> Column:
    """easy, medium, hard or extra by the number of clauses, nested queries and other parts.

    A negated condition counts as an aggregate and the connectors of WHERE count as
    conditions.
    """
    conds = F.concat(q.from_conds, q["where"], q.having)
    joins = F.concat(q.from_ao, q.where_ao, q.having_ao)
    count = lambda a, test: F.size(F.filter(a, test))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    one = (
        yes(F.size(q["where"]) > 0) + yes(F.size(q.grp) > 0) + yes(F.size(q.ord) > 0) + yes(q.lim.isNotNull())
        + F.greatest(F.size(q.tables) - 1, F.lit(0)) + count(joins, lambda x: x == "or") + count(conds, lambda c: c.op == LIKE)
    )
    nested = (
        count(conds, lambda c: c.sub1.isNotNull()) + count(conds, lambda c: c.sub2.isNotNull()) + sum((yes(q[s].isNotNull()) for s in SET_OPS), F.lit(0))
    )
    aggs = (
        count(q.sel, lambda s: s.agg != 0) + count(q["where"], lambda c: c.negated) + count(q.grp, lambda u: u.agg != 0)
        + count(q.ord, lambda u: u.c1.agg != 0) + count(q.ord, lambda u: u.c2.isNotNull() & (u.c2.agg != 0)) + count(q.having, lambda c: c.negated)
    )
    other = (
        yes(aggs > 1) + yes(F.size(q.sel) > 1) + yes(F.size(q["where"]) + F.size(q.where_ao) > 1) + yes(F.size(q.grp) > 1)
    )

    def level(v):
        easy = (v.one <= 1) & (v.other == 0) & (v.nested == 0)
        medium = (v.nested == 0) & (((v.other <= 2) & (v.one <= 1)) | ((v.one <= 2) & (v.other < 2)))
        hard = (
            ((v.other > 2) & (v.one <= 2) & (v.nested == 0)) | ((v.one > 2) & (v.one <= 3) & (v.other <= 2) & (v.nested == 0))
            | ((v.one <= 1) & (v.other == 0) & (v.nested <= 1))
        )
        return F.when(easy, "easy").when(medium, "medium").when(hard, "hard").otherwise("extra")

    return let(level, one=one, nested=nested, other=other)


# ---- roll-up ---------------------------------------------------------------------------------------


def rolled_scores(scores: DataFrame) -> DataFrame:
    """Per hardness and for ``all``: level, part, n, acc, rec, f1; part ``exact`` has only acc.

    acc is the mean over rows that predict the part, rec over rows whose gold has it, f1
    of the two means; it is 1 where both are 0.
    """
    whole = F.create_map(F.lit("exact"), F.struct(F.lit(1).alias("label_total"), F.lit(1).alias("pred_total"), F.col("exact").alias("score")))
    flat = scores.select("hardness", F.explode(F.map_concat("parts", whole)).alias("part", "s"))
    sums = flat.groupBy("part", "hardness").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("s.pred_total") > 0, F.col("s.score"))).alias("acc_sum"), F.count_if(F.col("s.pred_total") > 0).alias("acc_n"),
        F.sum(F.when(F.col("s.label_total") > 0, F.col("s.score"))).alias("rec_sum"), F.count_if(F.col("s.label_total") > 0).alias("rec_n"),
    )
    by = sums.rollup("part", "hardness").agg(*[F.sum(c).alias(c) for c in ("n", "acc_sum", "acc_n", "rec_sum", "rec_n")]).filter(F.col("part").isNotNull())
    mean = lambda s, n: F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.coalesce(F.col(s), F.lit(0)) / F.col(n)).otherwise(F.lit(0.0))
    means = by.select(
        F.coalesce("hardness", F.lit("all")).alias("level"), "part", "n", mean("acc_sum", "acc_n").alias("acc"), mean("rec_sum", "rec_n").alias("rec")
    )
    f1 = F.when((F.col("acc") == 0) & (F.col("rec") == 0), 1.0).otherwise(2.0 * F.col("acc") * F.col("rec") / (F.col("acc") + F.col("rec")))
    part = F.col("part") != "exact"
    return means.select("level", "part", "n", "acc", F.when(part, F.col("rec")).alias("rec"), F.when(part, f1).alias("f1"))


# ---- answers and beams ------------------------------------------------------------------------------


def same_answer(gold: DataFrame, predicted: DataFrame, gold_units: list[str], pred_units: list[str], place: str | None = None) -> DataFrame:
    """One row: do two answers agree when their columns are keyed by select unit?

    Columns are named by their unit; rows are compared as a bag, by counting, so neither
    answer is gathered. Where the query orders its rows, ``place`` names a column of both
    answers with the place of each row, and rows must agree place by place.
    """
    if sorted(set(gold_units)) != sorted(set(pred_units)):
        return gold.sparkSession.range(1).select(F.lit(False).alias("same"))
    names = sorted(set(gold_units))

    def keyed(df, units, side):
        at = {u: i for i, u in enumerate(units)}
        shown = [c for c in df.columns if c != place]
        spot = F.col(place) if place else F.lit(0)
        plain = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(shown)], spot.alias("place"))
        return plain.select(*[F.col(f"c{at[u]}").cast("string").alias(f"u{i}") for i, u in enumerate(names)], "place", F.lit(side).alias("side"))

    both = keyed(gold, gold_units, 1).unionByName(keyed(predicted, pred_units, -1))
    diff = both.groupBy("place", *[f"u{i}" for i in range(len(names))]).agg(F.sum("side").alias("d"))
    return diff.agg(F.coalesce(F.max(F.abs("d")), F.lit(0)).alias("m")).select((F.col("m") == 0).alias("same"))


def beam_scores(beams: DataFrame) -> DataFrame:
    """Beams (item_id, rank, exact) to item_id, first (score of rank 0), best, and the rank it is found at."""
    return beams.groupBy("item_id").agg(
        F.max(F.when(F.col("rank") == 0, F.col("exact"))).alias("first"), F.max("exact").alias("best"),
        F.min(F.when(F.col("exact") == 1, F.col("rank"))).alias("best_rank"),
    )
