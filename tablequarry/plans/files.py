"""Registered queries: the parse parts of the file readers on lines made from the tables."""

from pyspark.sql import functions as F

from ..functions import names as nm
from ..operators import structscore as ss
from ..sources import readers as rd, sinks as sk
from . import base as b
from .registry import query
from .structs import struct_pairs

# One marked line per part, in words both engines read.
MARKED = """concat('<special7> ', p_name, ' List no-', cast(p_partkey as string), ' <special8> Brand Name <special9> ', p_brand, ' *',
  ' <special8> part type <special9> ', p_type, ' <special8> p_size <special9> ', cast(p_size as string),
  ' <special8> unit price of one single part now <special9> ', cast(p_retailprice as string), ' a b c d e f <special8> x <special9> 1',
  case when p_partkey % 9 = 0 then ' <special8> broken' else ' <special8> shelf no <special9> 7 |||' end)"""


def marked_lines(t):
    return t.part.select(F.col("p_partkey").alias("table_id"), F.expr(MARKED).alias("value"))


def web_tables(t):
    # A file of few row groups is read by few tasks; the lines are spread before they are parsed.
    return rd.parse_marked_lines(marked_lines(t).repartition("table_id"), "table_id", seed=20)


_TITLE = f"""case when {b.u_sql(20, 'title', 'p_partkey')} < 0.4 then array_to_string(good[-least(2, len(good)):], ' ') else good[-1] end"""
b.add_cte(
    "web_name",
    f"""select p_partkey as table_id, {_TITLE} as name, p_brand, p_type, p_size, p_retailprice, p_partkey from (select *,
       [w for w in string_split(lower(p_name) || ' list no-' || p_partkey::varchar, ' ') if length(w) > 1 and not regexp_matches(w, '[-0-9]')] as good from part)""",
)
b.add_cte(
    "web_col",
    """select table_id, name, pos, replace(name, ' ', '_') || ' ' || case when pos = 0 then name || ' *' else col end as col, orig, case when regexp_matches(val, '^[0-9]+$') then 'real' else 'text' end as type,
         array_to_string(string_split(val, ' ')[1:5], ' ') as val from (
       select table_id, name, 0 as pos, '' as col, '*' as orig, 'all' as val from web_name union all select table_id, name, 1, 'brand name', 'brand name', lower(p_brand) from web_name
       union all select table_id, name, 2, 'part type', 'part type', lower(p_type) from web_name union all select table_id, name, 3, 'p_size', 'p_size', p_size::varchar from web_name
       union all select table_id, name, 4, 'unit price of one single', 'unit price of one single part now', p_retailprice::varchar || ' a b c d e f' from web_name
       union all select table_id, name, 5, 'shelf no', 'shelf no', '7' from web_name where p_partkey % 9 != 0)""",
    "web_name",
)


@query("s1_marked_tables", b.using("web_col") + "select table_id, name, pos, col, orig, type, val from web_col")
def s1_marked_tables(t):
    c = web_tables(t).select("table_id", "name", F.explode("cols").alias("c"))
    return c.select(
        "table_id", "name", F.col("c.pos").alias("pos"), F.col("c.name").alias("col"), F.col("c.original").alias("orig"), F.col("c.type").alias("type"),
        F.col("c.value").alias("val"),
    )


@query("f6_wide_tables", "select p_partkey from part where length(p_name) >= 2 and (case when p_partkey % 5 = 0 then 2 else 3 end) >= 3")
def f6_wide_tables(t):
    from ..operators.filters import wide_table

    n = F.when(F.col("p_partkey") % 5 == 0, 2).otherwise(3)
    return t.part.filter(wide_table(F.col("p_name"), n)).select("p_partkey")


@query("p6_qualified_names", b.using("web_col") + "select table_id, string_agg(col, '|' order by pos) as cols from web_col group by table_id")
def p6_qualified_names(t):
    return web_tables(t).select("table_id", F.array_join(F.transform("cols", lambda c: c["name"]), "|").alias("cols"))


_TAGGED = """select l_orderkey, l_linenumber, max(l_partkey) as a, max(l_returnflag) as b from lineitem group by l_orderkey, l_linenumber"""


@query(
    "s2_tagged_tables",
    f"""with c as ({_TAGGED}), w as (select l_orderkey, max(case when l_linenumber = 1 then a end) as h, string_agg(a::varchar, ',' order by l_linenumber) filter (l_linenumber between 2 and 4) as vals,
        count_if(l_linenumber between 1 and 4) as n from c group by l_orderkey),
      nm as (select o_orderkey, [x for x in string_split(o_orderpriority || ' kind', ' ') if length(x) > 1 and not regexp_matches(x, '[-0-9]')] as good, {b.u_sql(21, 'title', 'o_orderkey')} as u from orders where o_orderstatus != 'F')
      select l_orderkey as file, case when u < 0.4 then array_to_string(good[-least(2, len(good)):], ' ') else good[-1] end as name, 'c ' || h::varchar as header, vals
      from w join nm on o_orderkey = l_orderkey where n = 4""",
)
def s2_tagged_tables(t):
    base = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("a"), F.max("l_returnflag").alias("b"))
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("c|"), F.col("a").cast("string"))).otherwise(F.col("a").cast("string"))
    cells = base.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") - 2).alias("row"), F.explode(F.array(
        F.struct(F.lit(0).alias("col"), text.alias("text")), F.struct(F.lit(1).alias("col"), F.col("b").alias("text")))).alias("c")).select("file", "row", "c.*")
    title = F.concat("o_orderpriority", F.lit(" kind"))
    pages = t.orders.filter("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("file"), title.alias("title"))
    out = rd.assemble_tagged_tables(cells, pages, seed=21)
    first = F.get("cols", F.lit(1))
    return out.select("file", "name", first.original.alias("header"), F.array_join(first["values"], ",").alias("vals"))


@query("p5_transposed", f"""with c as ({_TAGGED}) select l_orderkey as file, string_agg(a::varchar, ',' order by l_linenumber) as a, string_agg(b, ',' order by l_linenumber) as b from c group by l_orderkey""")
def p5_transposed(t):
    base = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("a"), F.max("l_returnflag").alias("b"))
    rows = base.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("row"), F.array(F.col("a").cast("string"), "b").alias("cells"))
    from ..operators.features import transposed

    out = transposed(rows, "file", "row", "cells", 2)
    return out.select("file", F.array_join(F.get("columns", F.lit(0)), ",").alias("a"), F.array_join(F.get("columns", F.lit(1)), ",").alias("b"))


@query(
    "s5_db_examples",
    """select o_orderkey as item_id, case o_orderkey % 7 when 0 then 2 when 2 then 0 when 6 then 0 else 1 end as n_where, case o_orderkey % 7 when 2 then 3 when 5 then 1 end as lim,
       o_orderkey % 7 = 3 as nested from orders""",
)
def s5_db_examples(t):
    rows = struct_pairs(t).select("item_id", "gold")
    lines = rows.select(F.to_json(F.struct(F.concat(F.lit("db"), F.col("item_id").cast("string")).alias("db_id"), F.lit("q").alias("question"), F.array(F.lit("q")).alias("question_toks"), F.lit("").alias("query"), F.col("gold").alias("sql"))).alias("value"))
    out = rd.parse_db_examples(lines, ss.QUERY_SCHEMA)
    return out.select(
        F.expr("cast(substring(db_id, 3) as bigint)").alias("item_id"), F.size("sql.where").alias("n_where"), F.col("sql.lim").alias("lim"),
        F.col("sql.intersect_q").isNotNull().alias("nested"),
    )


@query(
    "s6_templates",
    """select o_custkey as file, row_number() over (partition by o_custkey order by o_orderkey)::bigint as block, 'SELECT {COLUMN0} {FROM} ' || o_orderstatus as pattern, 'P0==,T0-T1-JOIN' as rules,
       (o_orderkey % 100)::int as count, case when o_orderkey % 2 = 0 then 'what is {COLUMN0} of ' || o_orderkey::varchar || '|list {COLUMN0}' else 'what is {COLUMN0} of ' || o_orderkey::varchar end as asked from orders""",
)
def s6_templates(t):
    k = F.col("o_orderkey")
    texts = F.array(
        F.concat(F.lit("SQL Pattern: SELECT {COLUMN0} {FROM} "), "o_orderstatus", F.lit(" ||| P0== | T0-T1-JOIN ")),
        F.concat(F.lit("count: "), (k % 100).cast("string")), F.concat(F.lit("question:  what is {COLUMN0} of "), k.cast("string"), F.lit("||| C0-id")),
        F.when(k % 2 == 0, F.lit("question:  list {COLUMN0}")).otherwise(F.lit("")),
    )
    lines = t.orders.select(F.col("o_custkey").alias("file"), k.alias("k"), F.posexplode(texts).alias("i", "value"))
    out = rd.parse_template_lines(lines.select("file", (F.col("k") * 4 + F.col("i")).alias("line_no"), "value"))
    return out.select(
        "file", "block", "pattern", F.array_join("constraints", ",").alias("rules"), "count", F.array_join(F.transform("questions", lambda q: F.trim(q.text)), "|").alias("asked")
    )


@query(
    "s7_phrases",
    """select p_brand as component, p_type as key, string_agg(p_name, '|' order by p_name) as phrases from (select distinct p_brand, p_type, p_name from part) group by p_brand, p_type""",
)
def s7_phrases(t):
    grouped = t.part.select("p_brand", "p_type", "p_name").distinct().groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list("p_name")).alias("names"))
    docs = grouped.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", "names"))).alias("m"))
    lines = docs.select(F.to_json(F.create_map("p_brand", "m")).alias("value"))
    return rd.parse_phrases(lines).select("component", "key", F.array_join("phrases", "|").alias("phrases"))


@query(
    "s8_caption_corpus",
    """select o_custkey as file, (sum(case when o_orderkey % 3 = 0 then 1 else 0 end) over (partition by o_custkey order by o_orderkey) - case when o_orderkey % 3 = 0 then 1 else 0 end)::bigint as doc,
       (o_orderkey * 2)::bigint as line_no, 'order ' || o_orderkey::varchar as text, (o_orderkey % 5 + 7)::bigint as total from orders""",
)
def s8_caption_corpus(t):
    k = F.col("o_orderkey")
    lines = t.orders.select(F.col("o_custkey").alias("file"), (k * 2).alias("line_no"), F.concat(F.lit("order "), k.cast("string"), F.lit(" ||| 7 "), (k % 5).cast("string")).alias("value"))
    blank = t.orders.filter(k % 3 == 0).select(F.col("o_custkey").alias("file"), (k * 2 + 1).alias("line_no"), F.lit(" ").alias("value"))
    out = rd.parse_caption_corpus(lines.unionByName(blank))
    return out.select("file", "doc", "line_no", "text", F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _task_sql(task):
    s = rd.TASKS[task]
    n = "(case when id % 7 = 0 then 5 else 12 end)"
    pick = lambda i: "null" if i is None else (f"('c' || ({n} - 1)::varchar || '-' || id::varchar)" if i < 0 else f"(case when {i} < {n} then 'c{i}-' || id::varchar end)")
    where = ["id > 0"] if s["header"] else []
    if task == "qqp":
        where.append("id % 7 != 0")
    mark = "id::varchar" if s["guid"] is None else pick(s["guid"])
    return f"select '{task}' as task, 'train-' || {mark} as guid, {pick(s['a'])} as text_a, {pick(s['b'])} as text_b, {pick(s['label'])} as label from l" + (" where " + " and ".join(where) if where else "")


@query("s9_task_lines", "with l as (select conv_id * 1000 + turn as id from conversations) " + " union all ".join(_task_sql(x) for x in rd.TASKS))
def s9_task_lines(t):
    k = F.col("conv_id") * 1000 + F.col("turn")
    n = F.when(k % 7 == 0, 5).otherwise(12)
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("c"), i.cast("string"), F.lit("-"), k.cast("string")))
    lines = t.conversations.select(k.alias("line_no"), F.array_join(cells, "\t").alias("value"))
    out = None
    for task in rd.TASKS:
        part = rd.parse_task_lines(lines, task).select(F.lit(task).alias("task"), "guid", "text_a", "text_b", "label")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "s10_example_lines",
    b.using("web_col") + """select table_id, '{"question":"list all","columns":[' || string_agg('"' || col || '"', ',' order by pos) || '],"rows":[[' || string_agg('"' || val || '"', ',' order by pos)
       || ']],"column_labels":[' || string_agg(pos::varchar, ',' order by pos) || ']}' as line from web_col group by table_id""",
)
def s10_example_lines(t):
    part = lambda f: F.transform("cols", lambda c: c[f])
    return web_tables(t).select("table_id", sk.example_line(F.lit("list all"), part("name"), part("value"), part("pos")).alias("line"))
