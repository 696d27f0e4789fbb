"""Scores of predicted slot queries: logical form, clauses and answers."""

from pyspark.sql import Column, DataFrame, functions as F

from .slotquery import answer_digests, sort_conditions


def _compared(conds: Column) -> Column:
    return F.transform(conds, lambda c: F.struct(c.col.alias("col"), c.op.alias("op"), F.lower(c.val).alias("val")))


def same_conditions(a: Column, b: Column, ordered: bool = False) -> Column:
    """Equal condition lists: as sets unless ``ordered``; literals in lower case."""
    if ordered:
        return _compared(a) == _compared(b)
    as_set = lambda c: F.array_sort(F.array_distinct(_compared(c)))
    return as_set(a) == as_set(b)


def same_form(g: str, p: str, ordered: bool = False) -> Column:
    """Logical-form match of two query structs."""
    gold, pred = F.col(g), F.col(p)
    return (gold.sel == pred.sel) & (gold.agg == pred.agg) & same_conditions(gold.conds, pred.conds, ordered)


def pair_queries(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """query_id, table_id, g and p structs, failed; every gold query stays."""
    g = gold.select("query_id", "table_id", F.struct("sel", "agg", "conds").alias("g"))
    failed = F.col("failed") if "failed" in predicted.columns else F.lit(False)
    p = predicted.select("query_id", F.struct("sel", "agg", "conds").alias("p"), failed.alias("failed"))
    return g.join(p, "query_id", "left").withColumn("failed", F.coalesce("failed", F.lit(True)))


def clause_scores(pairs: DataFrame, mode: str = "test") -> DataFrame:
    """Adds sc, sa, wn, wc, wo, wv and lx (all of them) as 0 or 1.

    In ``test`` mode both condition lists are put in column order before operators and
    literals are compared; in ``train`` mode they are taken as they stand.
    """
    gold, pred = F.col("g"), F.col("p")
    order = sort_conditions if mode == "test" else (lambda c: c)
    gc, pc = order(gold.conds), order(pred.conds)
    same_n = F.size(gold.conds) == F.size(pred.conds)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    part = lambda arr, name: F.transform(arr, lambda c: c[name])
    lowered = lambda arr: F.transform(arr, lambda c: F.lower(c.val))
    scores = {
        "sc": gold.sel == pred.sel,
        "sa": gold.agg == pred.agg,
        "wn": same_n,
        "wc": same_n & (F.array_sort(part(gold.conds, "col")) == (part(pc, "col"))),
        "wo": same_n & (part(gc, "op") == part(pc, "op")),
        "wv": same_n & (lowered(gc) == lowered(pc)),
    }
    out = pairs.select("*", *[flag(c).alias(n) for n, c in scores.items()])
    return out.withColumn("lx", F.least(*scores))


def execution_scores(gold, predicted, tables, rows, lenient: bool = False) -> DataFrame:
    """query_id, ex (answers equal), lf (logical form equal).

    Strict: answer lists are equal; a failed prediction or one that cannot run is wrong.
    Lenient: an empty predicted list is wrong as well. Both frames are stored, as they are run
    and compared.
    """
    from ..session import stored_rows

    gold = stored_rows(gold.select("query_id", "table_id", "sel", "agg", "conds"))
    predicted = stored_rows(predicted.select("query_id", "table_id", "sel", "agg", "conds", *[c for c in predicted.columns if c == "failed"]))

    def side(df, name):
        return df.select(F.concat(F.lit(name), F.col("query_id").cast("string")).alias("query_id"), "table_id", "sel", "agg", "conds")

    key = F.expr("substring(query_id, 2)")
    found = answer_digests(side(gold, "g").unionByName(side(predicted, "p")), tables, rows)
    is_gold = F.col("query_id").startswith("g")
    part = lambda c, g: F.max(F.when(is_gold == F.lit(g), F.col(c)))
    answers = found.groupBy(key.alias("item")).agg(
        part("answer", True).alias("g_answer"), part("answer", False).alias("p_answer"), part("error", False).alias("p_error"),
        part("error", True).alias("g_error"), part("n_items", False).alias("p_n"),
    )
    pairs = pair_queries(gold, predicted)
    both = pairs.join(answers, F.col("query_id").cast("string") == F.col("item"), "left")
    same = ~F.col("failed") & ~F.col("p_error") & ~F.col("g_error") & (F.col("g_answer") == F.col("p_answer"))
    if lenient:
        same = same & (F.col("p_n") > 0)
    return both.select(
        "query_id", F.coalesce(same, F.lit(False)).cast("int").alias("ex"),
        F.coalesce(~F.col("failed") & same_form("g", "p"), F.lit(False)).cast("int").alias("lf"),
    )


def item_and_mean(scores: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Score rows of all items (``key`` tells them apart) and one row, key NULL, with the means: one run, two grouping sets."""
    return scores.rollup(key).agg(*[F.avg(p).alias(p) for p in parts])


def with_gold_order(gold_cols: Column, pred_cols: Column) -> Column:
    """Gold condition order where both column sets are equal, else the predicted order."""
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    return F.when(as_set(gold_cols) == as_set(pred_cols), gold_cols).otherwise(pred_cols)
