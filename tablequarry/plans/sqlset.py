"""Registered queries: the multi-table SQL subset on the star schema."""

from pyspark.sql import functions as F

from . import base as b
from .registry import query

money = lambda c: b.near(c, 2)


@query(
    "f1_comparisons",
    """select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where l_quantity > 10 and l_quantity <= 40
       and l_discount >= 0.02 and l_tax < 0.08 and l_returnflag != 'A' and l_linestatus = 'O'""",
)
def f1_comparisons(t):
    return t.lineitem.filter(
        (F.col("l_quantity") > 10) & (F.col("l_quantity") <= 40) & (F.col("l_discount") >= 0.02) & (F.col("l_tax") < 0.08)
        & (F.col("l_returnflag") != "A") & (F.col("l_linestatus") == "O")
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query(
    "f2_between",
    """select o_orderkey, o_totalprice between 100000 and 200000 as inside, o_totalprice not between 100000 and 200000 as outside
       from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1998-12-31'""",
)
def f2_between(t):
    inside = F.col("o_totalprice").between(100000, 200000)
    dated = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1998-12-31").cast("timestamp"))
    return t.orders.filter(dated).select("o_orderkey", inside.alias("inside"), (~inside).alias("outside"))


@query("f3_like", "select p_partkey, p_name ilike '%RING%' as hit, p_name not ilike 'red%' as other from part where p_type ilike 'e%'")
def f3_like(t):
    name = F.col("p_name")
    return t.part.filter(F.col("p_type").ilike("e%")).select("p_partkey", name.ilike("%RING%").alias("hit"), (~name.ilike("red%")).alias("other"))


@query(
    "f4_in",
    """select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('F')
       and o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')""",
)
def f4_in(t):
    machinery = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    kept = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("F"))
    return kept.join(machinery, "o_custkey", "left_semi").select("o_orderkey")


@query(
    "f5_boolean",
    """select l_orderkey, l_linenumber from lineitem where (l_returnflag = 'R' and l_quantity > 30 or l_discount = 0.05 and not (l_tax > 0.04))
       and l_linestatus = 'F'""",
)
def f5_boolean(t):
    left = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30)
    right = (F.col("l_discount") == 0.05) & ~(F.col("l_tax") > 0.04)
    return t.lineitem.filter((left | right) & (F.col("l_linestatus") == "F")).select("l_orderkey", "l_linenumber")


@query(
    "p15_arithmetic",
    """select l_orderkey, l_linenumber, round(l_quantity + l_tax, 4) as added, round(l_quantity - l_discount, 4) as taken,
       round(l_extendedprice * l_discount + 1e-7, 4) as times, round(l_extendedprice / l_quantity + 1e-7, 4) as per from lineitem where l_quantity > 0""",
)
def p15_arithmetic(t):
    q, d, x, p = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
    return t.lineitem.filter(q > 0).select(
        "l_orderkey", "l_linenumber", F.round(q + x, 4).alias("added"), F.round(q - d, 4).alias("taken"),
        b.near(p * d).alias("times"), b.near(p / q).alias("per"),
    )


@query(
    "a3_distinct_aggregates",
    """select o_orderstatus, count(*) as n, count(distinct o_custkey) as customers, sum(distinct length(o_orderpriority))::bigint as lengths
       from orders group by o_orderstatus""",
)
def a3_distinct_aggregates(t):
    return t.orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.sum_distinct(F.length("o_orderpriority")).alias("lengths")
    )


@query(
    "a4_group_by",
    """select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity) + 1e-7, 2) as qty, round(sum(l_extendedprice) + 1e-7, 2) as price
       from lineitem group by l_returnflag, l_linestatus""",
)
def a4_group_by(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), money(F.sum("l_quantity")).alias("qty"), money(F.sum("l_extendedprice")).alias("price")
    )


@query("a5_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def a5_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 12")


@query("a6_distinct", "select distinct p_brand, p_type from part")
def a6_distinct(t):
    return t.part.select("p_brand", "p_type").distinct()


@query(
    "a16_rollup",
    """select coalesce(o_orderpriority, 'all') as level, count(*) as n, round(avg(o_totalprice) + 1e-7, 2) as mean
       from orders group by rollup (o_orderpriority)""",
)
def a16_rollup(t):
    return t.orders.rollup("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), money(F.avg("o_totalprice")).alias("mean")).select(
        F.coalesce("o_orderpriority", F.lit("all")).alias("level"), "n", "mean"
    )


@query(
    "j11_join_chain",
    """select r_name, n_name, count(*) as n, round(sum(l_extendedprice) + 1e-7, 2) as price
       from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name""",
)
def j11_join_chain(t):
    chain = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"))
    )
    named = chain.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), money(F.sum("price")).alias("price"))


def not_in(left, right, key):
    """``NOT IN`` of SQL: no row if the right side holds a NULL; a NULL on the left only passes an empty right side."""
    n, known = right.agg(F.count(F.lit(1))).scalar(), right.agg(F.count(key)).scalar()
    kept = left.join(right.select(key).distinct(), key, "left_anti")
    return kept.filter((n == 0) | ((n == known) & F.col(key).isNotNull()))


@query(
    "j13_semi_anti",
    """select c_custkey, 'has' as side from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)
       union all select c_custkey, 'not' from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000)
       union all select c_custkey, 'null' from customer where c_custkey not in (select case when o_orderkey % 7 > 0 then o_custkey end from orders)""",
)
def j13_semi_anti(t):
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    mark = lambda kind, side: t.customer.join(big, "c_custkey", kind).select("c_custkey", F.lit(side).alias("side"))
    holed = t.orders.select(F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).alias("c_custkey"))
    none = not_in(t.customer, holed, "c_custkey").select("c_custkey", F.lit("null").alias("side"))
    return mark("left_semi", "has").unionByName(not_in(t.customer, big, "c_custkey").select("c_custkey", F.lit("not").alias("side"))).unionByName(none)


@query("o1_order_by", "select s_suppkey, s_nationkey, s_acctbal from supplier order by s_nationkey desc, s_acctbal desc")
def o1_order_by(t):
    return t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal").orderBy(F.desc("s_nationkey"), F.desc("s_acctbal"))


@query("o2_order_by_count", "select p_brand, count(*) as n from part group by p_brand order by count(*) desc, p_brand limit 10")
def o2_order_by_count(t):
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("o3_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 1")
def o3_limit(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("o4_top_k", "select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 25")
def o4_top_k(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(25)


_URGENT = "select o_custkey as k from orders where o_orderpriority = '1-URGENT'"
_DONE = "select o_custkey as k from orders where o_orderstatus = 'F'"


def _sides(t):
    k = F.col("o_custkey").alias("k")
    return t.orders.filter("o_orderpriority = '1-URGENT'").select(k), t.orders.filter("o_orderstatus = 'F'").select(k)


@query("u1_union", f"{_URGENT} union {_DONE}")
def u1_union(t):
    one, two = _sides(t)
    return one.union(two).distinct()


@query("u2_intersect", f"{_URGENT} intersect {_DONE}")
def u2_intersect(t):
    one, two = _sides(t)
    return one.intersect(two)


@query("u3_except", f"{_URGENT} except {_DONE}")
def u3_except(t):
    one, two = _sides(t)
    return one.subtract(two)


@query(
    "u4_union_splits",
    """select o_orderkey, arg_max(src, split) as src from (select o_orderkey, 0 as split, 'train' as src from orders where o_orderstatus != 'P'
       union all select o_orderkey, 1, 'dev' from orders where o_totalprice > 250000 union all select o_orderkey, 2, 'test' from orders where o_orderstatus = 'F' and o_totalprice > 350000)
       group by o_orderkey""",
)
def u4_union_splits(t):
    from ..sources.readers import union_splits

    part = lambda cond, name: t.orders.filter(cond).select("o_orderkey", F.lit(name).alias("src"))
    return union_splits(
        [part("o_orderstatus != 'P'", "train"), part("o_totalprice > 250000", "dev"), part("o_orderstatus = 'F' and o_totalprice > 350000", "test")],
        "o_orderkey",
    )


@query("u7_scalar_subquery", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.8 from orders)")
def u7_scalar_subquery(t):
    t.orders.createOrReplaceTempView("u7_orders")
    return t.spark.sql("select o_orderkey from u7_orders where o_totalprice > (select avg(o_totalprice) * 1.8 from u7_orders)")


@query(
    "u8_from_subquery",
    """select n_orders, count(*) as customers from (select o_custkey, count(*) as n_orders from orders group by o_custkey) x group by n_orders""",
)
def u8_from_subquery(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return per.groupBy("n_orders").agg(F.count(F.lit(1)).alias("customers"))
