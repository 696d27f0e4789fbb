"""Frames derived from the given tables that many queries start from, with SQL twins.

Slot tables: every customer is a small table of orders; every order is a row and also
asks one seeded slot query of its customer's table. Literals come from the order itself.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.seeded import pick_number, unit
from .registry import Tables

HEADER = ["Order Key", "Order Status", "Total Price", "Order Priority"]
TYPES = ["real", "text", "real", "text"]


def strings(items):
    return F.array(*[F.lit(i) for i in items])


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def u_sql(seed, draw: str, *keys: str) -> str:
    """SQL twin of ``unit``."""
    text = f"'{seed}|{draw}|' || " + " || '|' || ".join(f"({k})::varchar" for k in keys)
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0)"


def n_sql(n, seed, draw: str, *keys: str) -> str:
    """SQL twin of ``pick_number``."""
    return f"floor({u_sql(seed, draw, *keys)} * {n})::int"


def near(column, digits: int = 4):
    """Round so that both engines agree at the half-way points."""
    return F.round(column + F.lit(1e-7), digits)


def near_sql(text: str, digits: int = 4) -> str:
    return f"round(({text}) + 1e-7, {digits})"


# ---- slot tables, queries and predictions ------------------------------------------


def slot_tables(t: Tables) -> DataFrame:
    return t.customer.select(
        F.concat(F.lit("1-"), F.col("c_custkey").cast("string")).alias("table_id"),
        strings(HEADER).alias("header"), strings(TYPES).alias("types"),
    )


def slot_rows(t: Tables) -> DataFrame:
    return t.orders.select(
        F.concat(F.lit("1-"), F.col("o_custkey").cast("string")).alias("table_id"),
        F.col("o_orderkey").alias("row_id"),
        F.array(
            F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("string"), F.col("o_orderpriority")
        ).alias("cells"),
    )


def _draws(t: Tables) -> DataFrame:
    """One row per order with its drawn parts c1, c2, op1, op2 still apart."""
    k = F.col("o_orderkey")
    base = slot_rows(t).withColumnRenamed("row_id", "o_orderkey")
    sel = pick_number(4, 1, "sel", k)
    agg = F.when(F.col("sel").isin(1, 3), F.when(unit(1, "agg", k) < 0.5, 0).otherwise(3)).otherwise(pick_number(6, 1, "agg", k))
    first = pick_number(4, 1, "c1", k)
    return (
        base.withColumn("sel", sel).withColumn("agg", agg.cast("int")).withColumn("n", pick_number(3, 1, "nc", k))
        .withColumn("c1", first)
        .withColumn("c2", ((F.col("c1") + 1 + pick_number(3, 1, "c2", k)) % 4).cast("int"))
        .withColumn("op1", F.when(F.col("c1").isin(1, 3), 0).otherwise(pick_number(3, 1, "op1", k)).cast("int"))
        .withColumn("op2", F.when(F.col("c2").isin(1, 3), 0).otherwise(pick_number(3, 1, "op2", k)).cast("int"))
        .withColumn("v1", _literal("c1", "v1")).withColumn("v2", _literal("c2", "v2"))
        .withColumn("m1", _plain("c1", "v1")).withColumn("m2", _plain("c2", "v2"))
    )


def _literal(col, draw):
    """The cell of the order itself; one number in ten is wrapped in a word."""
    cell = F.get("cells", F.col(col))
    return F.when(F.col(col).isin(0, 2) & (unit(1, draw, "o_orderkey") < 0.1), F.concat(F.lit("about "), cell)).otherwise(cell)


def _plain(col, draw):
    return F.col(col).isin(0, 2) & (unit(1, draw, "o_orderkey") >= 0.1)


def _conds(parts):
    made = [F.struct(F.col(c).alias("col"), F.col(o).alias("op"), F.col(v).alias("val"), F.col(m).alias("is_num")) for c, o, v, m in parts]
    return F.slice(F.array(*made), 1, F.col("n"))


def slot_queries(t: Tables) -> DataFrame:
    return _draws(t).select(
        F.col("o_orderkey").alias("query_id"), "table_id", "sel", "agg",
        _conds([("c1", "op1", "v1", "m1"), ("c2", "op2", "v2", "m2")]).alias("conds"),
    )


def slot_predictions(t: Tables) -> DataFrame:
    """The gold queries with seeded mistakes; ``failed`` marks a prediction with an error."""
    k = F.col("query_id")
    w = unit(2, "noise", k)
    flip = lambda c: F.struct(c.col.alias("col"), F.lit(1).alias("op"), c.val.alias("val"), c.is_num.alias("is_num"))
    return slot_queries(t).select(
        "query_id", "table_id",
        F.when(w < 0.1, (F.col("sel") + 1) % 4).otherwise(F.col("sel")).cast("int").alias("sel"),
        F.when((w >= 0.1) & (w < 0.2), F.lit(3)).otherwise(F.col("agg")).cast("int").alias("agg"),
        F.when((w >= 0.2) & (w < 0.3), F.slice("conds", 1, 1))
        .when((w >= 0.3) & (w < 0.4), F.transform("conds", flip))
        .when((w >= 0.4) & (w < 0.5), F.reverse("conds"))
        .otherwise(F.col("conds")).alias("conds"),
        (w >= 0.95).alias("failed"),
    )


_CELLS = "[o_orderkey::varchar, o_orderstatus, o_totalprice::varchar, o_orderpriority]"
_U1 = lambda draw: u_sql(1, draw, "o_orderkey")
_N1 = lambda n, draw: n_sql(n, 1, draw, "o_orderkey")


def _cond_sql(i):
    return f"{{'col': c{i}, 'op': op{i}, 'val': v{i}, 'is_num': m{i}}}"


CTES: dict[str, str] = {
    "slot_rows": f"select '1-' || o_custkey::varchar as table_id, o_orderkey as row_id, {_CELLS} as cells from orders",
    "slot_tables": f"select '1-' || c_custkey::varchar as table_id, {sql_list(HEADER)} as header, {sql_list(TYPES)} as types from customer",
    "slot_draws0": f"""
      select o_orderkey, '1-' || o_custkey::varchar as table_id, {_CELLS} as cells, {_N1(4, 'sel')} as sel,
             {_N1(6, 'agg')} as agg6, {_U1('agg')} as aggu, {_N1(3, 'nc')} as n, {_N1(4, 'c1')} as c1,
             {_N1(3, 'c2')} as c2s, {_N1(3, 'op1')} as o1, {_N1(3, 'op2')} as o2, {_U1('v1')} as w1, {_U1('v2')} as w2
      from orders""",
    "slot_draws1": """
      select o_orderkey, table_id, cells, sel, n, c1, ((c1 + 1 + c2s) % 4)::int as c2, o1, o2, w1, w2,
             case when sel in (1, 3) then case when aggu < 0.5 then 0 else 3 end else agg6 end as agg
      from slot_draws0""",
    "slot_draws": """
      select o_orderkey, table_id, sel, agg, n, c1, c2,
             case when c1 in (1, 3) then 0 else o1 end as op1, case when c2 in (1, 3) then 0 else o2 end as op2,
             case when c1 in (0, 2) and w1 < 0.1 then 'about ' || cells[c1 + 1] else cells[c1 + 1] end as v1,
             case when c2 in (0, 2) and w2 < 0.1 then 'about ' || cells[c2 + 1] else cells[c2 + 1] end as v2,
             (c1 in (0, 2) and w1 >= 0.1) as m1, (c2 in (0, 2) and w2 >= 0.1) as m2
      from slot_draws1""",
    "slot_queries": f"""
      select o_orderkey as query_id, table_id, sel, agg, ([{_cond_sql(1)}, {_cond_sql(2)}])[1:n] as conds from slot_draws""",
    "slot_predictions": f"""
      select query_id, table_id, case when w < 0.1 then (sel + 1) % 4 else sel end as sel,
             case when w >= 0.1 and w < 0.2 then 3 else agg end as agg,
             case when w >= 0.2 and w < 0.3 then conds[1:1]
                  when w >= 0.3 and w < 0.4 then [{{'col': c.col, 'op': 1, 'val': c.val, 'is_num': c.is_num}} for c in conds]
                  when w >= 0.4 and w < 0.5 then list_reverse(conds) else conds end as conds,
             w >= 0.95 as failed
      from (select *, {u_sql(2, 'noise', 'query_id')} as w from slot_queries)""",
}

NEEDS: dict[str, list[str]] = {
    "slot_rows": [], "slot_tables": [], "slot_draws0": [], "slot_draws1": ["slot_draws0"], "slot_draws": ["slot_draws1"],
    "slot_queries": ["slot_draws"], "slot_predictions": ["slot_queries"],
}


def add_cte(name: str, sql: str, *needs: str) -> None:
    CTES[name], NEEDS[name] = sql, list(needs)


def using(*names: str) -> str:
    """``WITH`` clause of the named frames and of those they need."""
    order: list[str] = []

    def visit(name):
        for other in NEEDS[name]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return "with " + ", ".join(f"{n} as ({CTES[n]})" for n in order) + " "


# ---- running slot queries in SQL ---------------------------------------------------

FIRST_NUMBER_SQL = r"([-+]?[0-9]*\.[0-9]+|[0-9]+)"


def strict_sql(text: str) -> str:
    """SQL twin of ``strict_number``."""
    return f"case when regexp_matches({text}, '^\\s*[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?\\s*$') then try_cast(trim({text}) as double) + 0.0 end"


def number_sql(text: str) -> str:
    """SQL twin of ``literal_number``."""
    return (
        f"coalesce(case when regexp_matches(trim({text}), '^[-+]?[0-9.,]+$') then try_cast(replace(trim({text}), ',', '') as double) end, "
        f"try_cast(nullif(regexp_extract({text}, '{FIRST_NUMBER_SQL}', 1), '') as double))"
    )


def run_sql(name: str, source: str) -> None:
    """Frames <name>_match (query rows) and <name>_sum (one row per query) for a query frame."""
    real = "types[c.col + 1] = 'real'"
    cell = "lower(cells[c.col + 1])"
    val = "lower(c.val)"
    holds = f"""case when {real} then
        case when {strict_sql(cell)} is null then c.op = 1 when c.op = 0 then {strict_sql(cell)} = {number_sql(val)}
                  when c.op = 1 then {strict_sql(cell)} > {number_sql(val)} else {strict_sql(cell)} < {number_sql(val)} end
        else case c.op when 0 then {cell} = {val} when 1 then {cell} > {val} else {cell} < {val} end end"""
    add_cte(
        f"{name}_match",
        f"""select query_id, agg, types[sel + 1] as sel_type, row_id, lower(cells[sel + 1]) as txt
            from {source} q join slot_tables using (table_id) join slot_rows using (table_id)
            where len([1 for c in conds if not ({holds})]) = 0""",
        source, "slot_tables", "slot_rows",
    )
    add_cte(
        f"{name}_sum",
        f"""select q.query_id, q.agg, coalesce(n, 0)::bigint as n_rows,
              case q.agg when 1 then mx when 2 then mn when 3 then coalesce(n, 0) when 4 then total when 5 then total / n end as num,
              case when st = 'text' and q.agg = 1 then mxt when st = 'text' and q.agg = 2 then mnt end as txt
            from {source} q left join (
              select query_id, any_value(sel_type) as st, count(*) as n,
                     max(case when sel_type = 'real' then txt::double end) as mx, min(case when sel_type = 'real' then txt::double end) as mn,
                     max(txt) as mxt, min(txt) as mnt,
                     sum(case when sel_type = 'real' then txt::double
                              else coalesce(try_cast(nullif(regexp_extract(txt, '^\\s*([-+]?[0-9]*\\.?[0-9]+)', 1), '') as double), 0) end) as total
              from {name}_match group by query_id) using (query_id)""",
        f"{name}_match",
    )


run_sql("gold", "slot_queries")
run_sql("pred", "slot_predictions")


# ---- questions in words ----------------------------------------------------------------

from ..operators import slotquery as _sq  # noqa: E402


def slot_questions(t: Tables) -> DataFrame:
    """Slot queries with their table, the question in words (no quotes) and its tokens."""
    both = slot_queries(t).join(slot_tables(t), "table_id")
    words = F.lower(_sq.spoken_text(F.col("header"), F.col("sel"), F.col("agg"), F.col("conds"), lambda i: F.lit(False)))
    return both.withColumn("question", words).withColumn("toks", F.split("question", " "))


def spoken_sql(quoted: str, bracketed: bool = False, header: str = "header", lst: str = "conds") -> str:
    """SQL twin of ``spoken_text``; ``quoted`` may use i, the place of the condition from 0."""
    name = lambda c: f"'([' || {header}[{c} + 1] || '])'" if bracketed else f"{header}[{c} + 1]"
    aggs, ops = sql_list(_sq.SPOKEN_AGGREGATES), sql_list(_sq.SPOKEN_COMPARISONS)
    raw = f"case when not c.is_num and ({quoted}) then '\"' || c.val || '\"' else c.val end"
    val = f"'{{[' || {raw} || ']}}'" if bracketed else raw
    part = f"{name('c.col')} || ' ' || ({ops})[c.op + 1] || ' ' || {val}"
    where = f"array_to_string(list_transform({lst}, lambda c, j: {part.replace('@i', '(j - 1)')}), ' and ')"
    return (
        f"'select ' || case when agg = 0 then '' else ({aggs})[agg + 1] || ' ' end || {name('sel')} || "
        f"case when len({lst}) > 0 then ' where ' || {where} else '' end"
    )


add_cte(
    "slot_questions",
    f"select *, string_split(question, ' ') as toks from (select *, lower({spoken_sql('false')}) as question "
    "from slot_queries join slot_tables using (table_id))",
    "slot_queries", "slot_tables",
)
