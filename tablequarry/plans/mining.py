"""Registered queries: patterns mined from question/SQL pairs over the star schema."""

from pyspark.sql import functions as F

from ..operators import mining as mi
from ..session import cut_lineage
from . import base as b
from .registry import query

# Words both engines read: the SQL text and the question each order gives.
QUERY_TEXT = """case o_orderkey % 6
  when 0 then concat('SELECT o_totalprice FROM orders WHERE o_orderstatus = "', o_orderstatus, '" AND o_totalprice > ', cast(o_totalprice as string))
  when 1 then concat('SELECT count(*) FROM orders AS T1 JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey WHERE T2.c_custkey = ', cast(o_custkey as string))
  when 2 then 'SELECT o_orderpriority , max(o_totalprice) FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC LIMIT 3'
  when 3 then concat('SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > ', cast(o_totalprice as string),
                     ' INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment != "BUILDING";')
  when 4 then concat('SELECT avg(o_totalprice) , o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < ',
                     cast(o_custkey as string), ') GROUP BY o_orderstatus HAVING count(*) >= 2')
  else concat('SELECT T1.o_orderkey FROM orders AS T1 WHERE T1.o_orderpriority LIKE "', substring(o_orderpriority, 3, 20), '" ORDER BY T1.o_totalprice ASC LIMIT 1') end"""
QUESTION_TEXT = """case o_orderkey % 6
  when 0 then concat('What are the totals of orders with status ', o_orderstatus, ' above ', cast(o_totalprice as string))
  when 1 then concat('How many orders has customer ', cast(o_custkey as string))
  when 2 then 'What are the 3 most common priorities and their highest totals'
  when 3 then concat('Which customers have orders above ', cast(o_totalprice as string), ' and are not in BUILDING')
  when 4 then concat('Average total per status for customers with balance below ', cast(o_custkey as string))
  else concat('First order with priority ', substring(o_orderpriority, 3, 20)) end"""

STAR_COLUMNS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_custkey", "c_name", "c_nationkey",
    "c_acctbal", "c_mktsegment",
]
STAR_TABLES = ["orders", "customer"]
COLUMN_WORDS = ["total", "status", "priority", "customer", "order", "balance"]

b.add_cte(
    "pairs",
    f"select o_orderkey as eid, {QUERY_TEXT} as query, {QUESTION_TEXT} as question from orders",
)
_NUM = r"^[-+]?[0-9]*\.[0-9]+$|^[^tT]?[0-9]+$"
b.add_cte(
    "masked",
    f"""select eid, query, question, [case when regexp_matches(w, '{_NUM}') then '{{VALUE_NUM}}' else w end for w in string_split(
       regexp_replace(replace(replace(replace(replace(query, ';', ''), chr(9), ''), '(', ' ( '), ')', ' ) '), '"[^"]*"|''[^'']*''', '{{VALUE_STR}}', 'g'), ' ') if w != ''] as toks
       from pairs""",
    "pairs",
)
_KW, _COLS, _TABS = b.sql_list(mi.KEYWORDS), b.sql_list(STAR_COLUMNS), b.sql_list(STAR_TABLES)
b.add_cte(
    "bared",
    f"""select *, [{{'w': w, 'kept': list_contains({_KW}, upper(w)) or w in ('{{VALUE_STR}}', '{{VALUE_NUM}}'),
       'name': lower(regexp_replace(upper(w), 'T[0-9]+\\.|["'']|T[0-9]+', '', 'g'))}} for w in toks] as parts from masked""",
    "masked",
)
# The places of first use are found by rank, not by list order.
b.add_cte(
    "slotted",
    f"""select m.eid, m.query, m.question, coalesce(array_to_string([x for x in [
          case when p.kept then upper(p.w) when list_contains({_COLS}, p.name) then '{{COLUMN' || (list_position(u.used, p.name) - 1)::varchar
               when list_contains({_TABS}, p.name) then '{{TABLE}}' end for p in m.parts] if x is not null], ' '), '') as pattern0
        from bared m join (select eid, list(name order by place) as used from (
             select eid, p.name as name, min(i) as place from (select eid, parts[i] as p, i from bared, unnest(range(1, len(parts) + 1)) as r(i))
             where not p.kept and list_contains({_COLS}, p.name) group by eid, p.name) group by eid) u using (eid)""",
    "bared",
)
b.add_cte("patterned", """select *, regexp_replace(pattern0, '\\bFROM\\b.*?( WHERE\\b| GROUP\\b| ORDER\\b|$)', '{FROM}\\1', 'g') as pattern from slotted""", "slotted")
_TUNED = f"""array_to_string([case when starts_with(w, '{{COLUMN') then '{{COLUMN' || (list_position(used, w) - 1)::varchar || '}}'
   when starts_with(w, '{{VALUE') then '{{VALUE}}' when w in ('ASC', 'DESC') then '{{DASC}}' when list_contains({b.sql_list(mi.WHERE_OPS)}, w) then '{{OP}}'
   when list_contains({b.sql_list(mi.AGG_OPS)}, w) then '{{AGG}}' else w end for w in words if w != 'DISTINCT'], ' ')"""
b.add_cte(
    "general",
    f"""select p.eid, p.query, p.question, p.pattern,
      array_to_string([w for w in words if list_contains({b.sql_list(mi.SHORT_WORDS)}, w)], ' ') as short,
      array_to_string([w for w in words if list_contains({b.sql_list(mi.WIDER_WORDS)}, w)], ' ') as wider, {_TUNED} as tuned
      from (select *, string_split(pattern, ' ') as words from patterned) p join (
        select eid, list(w order by place) as used from (select eid, w, min(i) as place from (
          select eid, string_split(pattern, ' ')[i] as w, i from patterned, unnest(range(1, len(string_split(pattern, ' ')) + 1)) as r(i))
          where starts_with(w, '{{COLUMN') group by eid, w) group by eid) u using (eid)""",
    "patterned",
)


def pairs(t):
    return t.orders.select(F.col("o_orderkey").alias("eid"), F.expr(QUERY_TEXT).alias("query"), F.expr(QUESTION_TEXT).alias("question"))


def patterned(t):
    slotted = mi.slot_columns(mi.mask_literals(F.col("query")), b.strings(STAR_COLUMNS), b.strings(STAR_TABLES))
    return pairs(t).withColumn("pattern0", F.array_join(slotted, " ")).withColumn("pattern", mi.collapse_from(F.col("pattern0")))


def general(t):
    p = F.col("pattern")
    return patterned(t).select(
        "eid", "query", "question", "pattern", mi.generalise(p, "short").alias("short"), mi.generalise(p, "wider").alias("wider"),
        mi.generalise(p, "tuned").alias("tuned"),
    )


@query("g1_mask_literals", b.using("masked") + "select eid, array_to_string(toks, ' ') as masked from masked")
def g1_mask_literals(t):
    return pairs(t).select("eid", F.array_join(mi.mask_literals(F.col("query")), " ").alias("masked"))


@query("g2_slot_columns", b.using("slotted") + "select eid, pattern0 from slotted")
def g2_slot_columns(t):
    return patterned(t).select("eid", "pattern0")


@query("g3_collapse_from", b.using("patterned") + "select eid, pattern from patterned")
def g3_collapse_from(t):
    return patterned(t).select("eid", "pattern")


@query("g4_generalise", b.using("general") + "select eid, short, wider, tuned from general")
def g4_generalise(t):
    return general(t).select("eid", "short", "wider", "tuned")


@query(
    "g5_question_template",
    b.using("pairs") + f"""select eid, array_to_string([case when list_contains({b.sql_list(COLUMN_WORDS)},
        regexp_replace(lower(w), '([a-z][a-z][^s])s$', '\\1')) then '{{COLUMN}}' else w end for w in string_split(text, ' ')], ' ') as template from (
      select eid, case eid % 6
        when 0 then regexp_replace(regexp_replace(lower(question), '\\b' || lower(regexp_extract(query, '"([^"]*)"', 1)) || '\\b', '{{VALUE_STR}}', 'g'),
             '\\b\\Q' || regexp_extract(query, '> (.*)$', 1) || '\\E\\b', '{{VALUE_NUM}}', 'g')
        when 1 then regexp_replace(lower(question), '\\b' || regexp_extract(query, '= ([0-9]+)$', 1) || '\\b', '{{VALUE_NUM}}', 'g')
        when 2 then regexp_replace(lower(question), '\\b3\\b', '{{VALUE_NUM}}', 'g')
        when 3 then regexp_replace(regexp_replace(lower(question), '\\bbuilding\\b', '{{VALUE_STR}}', 'g'),
             '\\b\\Q' || regexp_extract(query, '> ([0-9.]+) ', 1) || '\\E\\b', '{{VALUE_NUM}}', 'g')
        when 4 then regexp_replace(regexp_replace(lower(question), '\\b' || regexp_extract(query, '< ([0-9]+)', 1) || '\\b', '{{VALUE_NUM}}', 'g'), '\\b2\\b', '{{VALUE_NUM}}', 'g')
        else regexp_replace(lower(question), '\\b\\Q' || lower(regexp_extract(query, '"([^"]*)"', 1)) || '\\E\\b', '{{VALUE_STR}}', 'g') end as text from pairs)""",
)
def g5_question_template(t):
    q = F.col("query")
    template = mi.question_template(F.col("question"), mi.quoted_values(q), mi.numbers_of(F.replace(q, F.lit(";"), F.lit(""))), b.strings(COLUMN_WORDS))
    return pairs(t).select("eid", template.alias("template"))


@query(
    "a7_pattern_counts",
    b.using("general") + "select tuned, count(*) as count from general group by tuned",
)
def a7_pattern_counts(t):
    return mi.pattern_counts(general(t), "tuned", "wider").groupBy("tuned").agg(F.max("count").alias("count"))


@query(
    "a7_pattern_members",
    b.using("general") + "select eid, tuned, count(*) over (partition by tuned) as count, question || ' ||| ' || wider || ' ||| ' || query as member from general",
)
def a7_pattern_members(t):
    rows = cut_lineage(general(t).select("eid", "tuned", "question", "wider", "query"))  # patterns are made once
    counts = rows.groupBy("tuned").agg(F.count(F.lit(1)).alias("count"))
    return rows.join(counts, "tuned").select("eid", "tuned", "count", F.concat_ws(" ||| ", "question", "wider", "query").alias("member"))


@query(
    "a8_sub_patterns",
    b.using("general") + """select g.tuned, n as count, wider, count(*) as sub_count from general g join (select tuned, count(*) as n from general group by tuned)
       using (tuned) group by g.tuned, n, wider""",
)
def a8_sub_patterns(t):
    return mi.pattern_counts(general(t), "tuned", "wider")
