"""Candidate ranking on score tables."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import ranked_by_score


def softmax(df: DataFrame, keys: list[str], score: str, out: str = "prob") -> DataFrame:
    """Soft-max of the scores of each group; the group totals are joined back, not windowed."""
    top = df.groupBy(*keys).agg(F.max(score).alias("__top"))
    shifted = df.join(top, keys).withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    total = shifted.groupBy(*keys).agg(F.sum("__e").alias("__sum"))
    return shifted.join(total, keys).withColumn(out, F.col("__e") / F.col("__sum")).drop("__top", "__e", "__sum")


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def joint_probability(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(1.0), lambda a, p: a * p)


def merge_beams(first: DataFrame, second: DataFrame, key: str, item: str, k: int, names=("open", "done")) -> DataFrame:
    """The best k of two candidate lists together, with their side and their place on that side."""
    both = first.withColumn("side", F.lit(names[0])).unionByName(second.withColumn("side", F.lit(names[1])))
    best = ranked_by_score(both, [key], [F.desc("score"), item], k, "place")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key, "side").orderBy("place")))


def likely_in_order(scores: DataFrame, key: str, item: str, n: int, out: str) -> DataFrame:
    """The n most likely items of each group, put in item order."""
    best = ranked_by_score(scores, [key], [F.desc("score"), item], n, "__rank")
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), ",").alias(out))


def best_and_pairs(scores: DataFrame, key: str, place: str, k: int) -> DataFrame:
    """Span candidates from start and end scores: (key, first, last, prob).

    The ceil(sqrt(k)) best starts meet the same number of best ends; the probability is
    the product of the two soft-max values over all places of the group. At most about
    k + 2 sqrt(k) + 1 rows per group are made.
    """
    import math

    side = math.ceil(math.sqrt(k))
    top = scores.groupBy(key).agg(F.max("start_score").alias("__ts"), F.max("end_score").alias("__te"))
    with_top = scores.join(top, key)
    sums = with_top.groupBy(key).agg(
        F.sum(F.exp(F.col("start_score") - F.col("__ts"))).alias("__ss"), F.sum(F.exp(F.col("end_score") - F.col("__te"))).alias("__se"),
        F.first("__ts").alias("__ts"), F.first("__te").alias("__te"),
    )

    def best(score):
        rows = scores.select(key, place, F.col(score).alias("score"))
        return ranked_by_score(rows, [key], [F.desc("score"), place], side, "__rank").drop("__rank")

    firsts = best("start_score").select(key, F.col(place).alias("first"), F.col("score").alias("__s"))
    lasts = best("end_score").select(key, F.col(place).alias("last"), F.col("score").alias("__e"))
    prob = F.exp(F.col("__s") - F.col("__ts")) / F.col("__ss") * F.exp(F.col("__e") - F.col("__te")) / F.col("__se")
    return firsts.join(lasts, key).join(sums, key).select(key, "first", "last", prob.alias("prob"))


def joint_probabilities(df: DataFrame) -> DataFrame:
    """Adds p_select, p_where and p_total from p_sc, p_sa, p_wn and the lists p_wc, p_wo, p_first, p_last."""
    one = F.col("p_sc") * F.col("p_sa")
    parts = F.concat("p_wc", "p_wo", "p_first", "p_last")
    return df.withColumn("p_select", one).withColumn("p_where", F.col("p_wn") * joint_probability(parts)).withColumn(
        "p_total", F.col("p_select") * F.col("p_where")
    )


def span_words(toks: Column, word_of: Column, spans: Column) -> Column:
    """Words of the spans given by their first and last piece."""
    def words(s):
        first, last = F.get(word_of, s.first), F.get(word_of, s.last)
        return F.slice(toks, first + 1, last - first + 1)

    return F.transform(spans, words)


def assemble_conditions(cols: Column, ops: Column, values: Column) -> Column:
    """Conditions from aligned lists."""
    return F.transform(cols, lambda c, i: F.struct(c.alias("col"), F.get(ops, i).alias("op"), F.get(values, i).alias("val"), F.lit(False).alias("is_num")))


def execution_guided(selects: DataFrame, conditions: DataFrame, counts: DataFrame, tables: DataFrame, rows: DataFrame, k: int = 4) -> DataFrame:
    """Choose a query per item from scored parts, keeping only conditions that give an answer.

    selects: item_id, table_id, sel, agg, prob; conditions: item_id, col, op, val, is_num,
    prob; counts: item_id, n, prob. The best of the k most likely allowed select pairs is
    taken (the k-th if none is allowed). Each of the k most likely conditions is run alone
    with it, all items in one job. The chosen pairs and the queries that are tried are stored
    once. The number of conditions has the largest product of its
    own probability and that of the last condition taken.
    """
    from ..session import stored_rows
    from .slotquery import allowed_pair, with_answer

    best = ranked_by_score(selects, ["item_id"], [F.desc("prob"), "sel", "agg"], k, "rank")
    pairs = best.groupBy("item_id", "table_id").agg(F.collect_list(F.struct("rank", "sel", "agg")).alias("pairs"))
    typed = pairs.join(tables.select("table_id", "types"), "table_id").select("item_id", "table_id", "types", F.explode("pairs").alias("p")).select("*", "p.*")
    typed = typed.withColumn("ok", allowed_pair(F.get("types", F.col("sel")), F.col("agg")))
    order = F.struct(F.when(F.col("ok"), 0).otherwise(1), F.when(F.col("ok"), F.col("rank")).otherwise(-F.col("rank")))
    chosen = stored_rows(typed.groupBy("item_id").agg(F.min_by(F.struct("table_id", "sel", "agg"), order).alias("s")).select("item_id", "s.*"))

    top = ranked_by_score(conditions, ["item_id"], [F.desc("prob"), "col", "op", "val"], k, "rank")
    cond = F.struct("col", "op", "val", "is_num")
    tried = top.join(chosen, "item_id").groupBy("item_id", "table_id", "sel", "agg").agg(
        F.array_sort(F.collect_list(F.struct("rank", "prob", cond.alias("cond")))).alias("tried")
    )
    tried = stored_rows(tried)
    alone = tried.select("item_id", "table_id", "sel", "agg", F.explode("tried").alias("c")).select(
        F.concat_ws(":", F.col("item_id").cast("string"), F.col("c.rank").cast("string")).alias("query_id"), "item_id", "table_id", "sel", "agg",
        F.array("c.cond").alias("conds"), F.col("c.rank").alias("rank"),
    )
    good = with_answer(alone, tables, rows).groupBy("item_id").agg(F.collect_list("rank").alias("ranks"))
    listed = tried.select("item_id", "tried").join(good.hint("merge"), "item_id").select(
        "item_id", F.filter("tried", lambda c: F.array_contains("ranks", c["rank"])).alias("found")
    )
    chances = counts.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "prob"))).alias("p_n"))
    both = chosen.join(chances, "item_id").join(listed, "item_id", "left")
    found = F.coalesce("found", F.slice(F.array(F.struct(F.lit(0).alias("rank"), F.lit(0.0).alias("prob"), F.struct(F.lit(0).alias("col"), F.lit(0).alias("op"), F.lit("").alias("val"), F.lit(False).alias("is_num")).alias("cond"))), 1, 0))
    made = both.withColumn("found", found)
    scores = F.concat(F.array(F.col("p_n")[F.lit(0)]), F.transform("found", lambda f, i: F.col("p_n")[i + 1] * f.prob))
    made = made.withColumn("scores", scores).withColumn("n", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))
    return made.select("item_id", "table_id", "sel", "agg", F.transform(F.slice("found", 1, F.col("n")), lambda f: f.cond).alias("conds"))


def rerank_valid(candidates: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """The best k valid candidates of each group; of a group without a valid one, the best k of all."""
    some = candidates.groupBy(key).agg(F.max(F.col("valid").cast("int")).alias("__some"))
    kept = candidates.join(some.hint("merge"), key).filter(F.col("valid") | (F.col("__some") == 0)).drop("__some")
    return ranked_by_score(kept, [key], [F.desc("score"), item], k, "place")


def rerank_by_from(candidates: DataFrame, columns: DataFrame, edges: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """The best k candidates of each group whose FROM part holds (``schemas.valid_from``); of a group without one, the best k of all.

    Candidates: ``key`` of the group, ``item`` (one row a candidate), db_id, tables, columns,
    key_columns, score. All candidates of all groups are checked in one run.
    """
    from .schemas import valid_from

    parts = candidates.select(F.col(item).alias("item_id"), "db_id", "tables", "columns", "key_columns")
    valid = valid_from(parts, columns, edges).select(F.col("item_id").alias(item), "valid")
    return rerank_valid(candidates.join(valid.hint("merge"), item), key, item, k)


def queries_of_pointers(df: DataFrame) -> DataFrame:
    """Pointer sequences back to slot queries: adds ``sel``, ``agg`` and ``conds`` of the prediction.

    Needs pointers, x (the pointer input with its spans), toks and question. Each pointer
    falls in a SQL word, the question or a header; an aggregate makes the next header the
    selected one, another header opens a condition, two question pointers close it.
    """
    from .spans import merge_tokens

    def listed(spans):
        """All places of the spans and the number of the span of each, so that a pointer is looked up and not tried on every span."""
        size = lambda s: F.greatest(s.end - s.start, F.lit(0))
        places = F.transform(spans, lambda s: F.when(size(s) > 0, F.sequence(s.start, s.end - 1)).otherwise(F.expr("cast(array() as array<int>)")))
        return F.struct(F.flatten(places).alias("places"), F.flatten(F.transform(spans, lambda s, i: F.array_repeat(i, size(s)))).alias("numbers"))

    def group_of(sql, header, asked, p):
        at = lambda known: F.when(known.places.isNotNull(), F.coalesce(F.get(known.numbers, (F.array_position(known.places, p) - 1).cast("int")), F.lit(-1)))
        return F.struct(at(sql).alias("sql"), (p - asked.start).alias("word"), ((p >= asked.start) & (p < asked.end)).alias("asked"), at(header).alias("header"))

    none = F.lit(None).cast("int")
    empty = F.expr("cast(array() as array<struct<col:int,op:int,first:int,last:int>>)")
    start = F.struct(none.alias("agg"), none.alias("sel"), F.lit(False).alias("agg_open"), none.alias("col"), none.alias("op"), none.alias("first"), empty.alias("conds"))

    def step(s, g):
        is_agg, is_op = g.sql.between(0, 5), g.sql.between(9, 11)
        sql, asked = g.sql >= 0, (g.sql < 0) & g.asked
        header = (g.sql < 0) & ~g.asked & (g.header >= 0)
        closes = asked & s.first.isNotNull()
        done = closes & s.col.isNotNull() & s.op.isNotNull()
        new = F.array(F.struct(s.col.alias("col"), s.op.alias("op"), s.first.alias("first"), g.word.alias("last")))
        return F.struct(
            F.when(is_agg, g.sql).otherwise(s.agg).alias("agg"),
            F.when(header & s.agg_open, g.header).otherwise(s.sel).alias("sel"),
            F.when(is_agg, True).when(header, False).otherwise(s.agg_open).alias("agg_open"),
            F.when(done, none).when(header & ~s.agg_open, g.header).otherwise(s.col).alias("col"),
            F.when(done, none).when(sql & is_op & s.col.isNotNull(), g.sql - 9).otherwise(s.op).alias("op"),
            F.when(closes, none).when(asked, g.word).otherwise(s.first).alias("first"),
            F.when(done, F.concat(s.conds, new)).otherwise(s.conds).alias("conds"),
        )

    known = df.withColumns({"__sql": listed(F.col("x.sql_spans")), "__header": listed(F.col("x.header_spans")), "__asked": F.col("x.question_span")})
    folded = known.withColumn("__groups", F.transform("pointers", lambda p: group_of(F.col("__sql"), F.col("__header"), F.col("__asked"), p)))
    folded = folded.withColumn("__q", F.aggregate("__groups", start, step))

    def condition(c):
        words = F.slice(F.col("toks"), c.first + 1, c.last - c.first + 1)
        return F.struct(c.col.alias("col"), c.op.alias("op"), merge_tokens(words, F.col("question")).alias("val"))

    kept = [c for c in df.columns if c not in ("sel", "agg", "conds")]
    return folded.select(*kept, F.col("__q.sel").alias("sel"), F.col("__q.agg").alias("agg"), F.transform("__q.conds", condition).alias("conds"))


def same_pointers(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.agg(F.avg((F.col(gold) == F.col(pred)).cast("int")).alias("accuracy"))
