"""Registered queries: databases from web tables and examples from templates.

The templates and phrases are a small resource; the work grows with the part table.
"""

from pyspark.sql import functions as F

from ..operators import filters as fl, synthesis as sy
from ..operators.vocab import frequency_ids
from . import base as b
from .files import web_tables
from .registry import query
from .templates import PHRASES, TEMPLATES, phrase_frame, template_frame

SIZE_FACTOR = 2.5


def dbs(t):
    return sy.group_tables(web_tables(t), "table_id", 30)


def counted(t):
    return sy.add_key_column(dbs(t), "table_id", 31).withColumn(
        "n", F.lit(2) + (F.col("db_id") % 2).cast("int")
    )


def drawn(t):
    return sy.draw_templates(counted(t), sy.prepare_templates(template_frame(t.spark)), 32)


def filled(t):
    return sy.fill_slots(drawn(t), 33)


def spoken(t):
    return sy.verbalise(filled(t), phrase_frame(t.spark), 34)


def texts(t):
    """``spoken`` for queries that ask for its texts only, with the columns that these are made of."""
    name = lambda c: F.struct(F.col(c)["name"].alias("name")).alias(c)
    needed = filled(t).select("db_id", "sample_no", "pattern", "question", "q_slots", "values", name("t0"), name("t1"), "number")
    return sy.verbalise(needed, phrase_frame(t.spark), 34)


def labelled(t):
    return sy.label_examples(spoken(t))


b.add_cte("web_size", "select table_id, any_value(name) as name, count(*) as n, list(col) as cols from web_col group by table_id", "web_col")
b.add_cte(
    "web_pair",
    f"""select p.*, (w = 2 and {b.u_sql(30, 'pair', 'pair')} < 0.5 and total <= 25 and n_distinct = total) as joined from (
         select pair, count(*) as w, sum(n) as total, len(list_distinct(flatten(list(cols)))) as n_distinct, min(table_id) as first, max(table_id) as last from (
           select *, (row_number() over (order by table_id) - 1) // 2 as pair from web_size) group by pair) p""",
    "web_size",
)
b.add_cte(
    "web_db",
    "select first as db_id, first as table_id, w from (select *, first as f from web_pair) where true union all select case when joined then first else last end, last, w from web_pair where w = 2",
    "web_pair",
)


@query("g6_databases", b.using("web_db", "web_size") + "select db_id, count(*)::bigint as tabs, sum(n)::bigint as cols from web_db join web_size using (table_id) group by db_id")
def g6_databases(t):
    cols = F.aggregate("tables", F.lit(0), lambda a, x: a + F.size(x.cols))
    return dbs(t).select("db_id", F.size("tables").cast("long").alias("tabs"), cols.cast("long").alias("cols"))


_ADD = f"{b.u_sql(31, 'add key', 'table_id')} < 0.7"
_WORD = f"case when {b.u_sql(31, 'key name', 'table_id')} < 0.3 then 'name' else 'id' end"


@query(
    "g7_key_columns",
    b.using("web_db", "web_size") + f"""select db_id, table_id, case when w2 and {_ADD} then replace(name, ' ', '_') || ' ' || {_WORD} else replace(name, ' ', '_') || ' brand name' end as second,
      (n + (w2 and {_ADD})::int)::bigint as cols from (select *, count(*) over (partition by db_id) = 2 as w2 from web_db) join web_size using (table_id)""",
)
def g7_key_columns(t):
    out = sy.add_key_column(dbs(t), "table_id", 31).select("db_id", F.explode("tables").alias("x"))
    return out.select("db_id", F.col("x.table_id").alias("table_id"), F.get("x.cols", F.lit(1))["name"].alias("second"), F.size("x.cols").cast("long").alias("cols"))


@query("f8_unique_columns", b.using("web_pair") + "select pair, n_distinct = total as ok from web_pair")
def f8_unique_columns(t):
    from ..operators.ordered import running_number

    numbered = running_number(web_tables(t), [], "table_id", "no").withColumn("pair", F.floor((F.col("no") - 1) / 2))
    names = numbered.groupBy("pair").agg(F.flatten(F.collect_list(F.transform("cols", lambda c: c["name"]))).alias("names"))
    return names.select("pair", fl.unique_columns(F.col("names")).alias("ok"))


def order_templates(t):
    """One template per order, drawn from the list by its number."""
    n = len(TEMPLATES)
    listed = template_frame(t.spark).withColumnRenamed("template_id", "at")
    keyed = t.orders.select(F.col("o_orderkey").alias("template_id"), (F.col("o_orderkey") % n).cast("int").alias("at"))
    return keyed.join(listed, "at")


def _by_template(values, kind="varchar"):
    rows = ", ".join(f"({i}, " + ", ".join("'" + str(x).replace("'", "''") + "'" for x in v) + ")" for i, v in enumerate(values))
    return rows


_SINGLE = [0, 1, 2, 3, 4, 5, 7, 8, 9]


@query(
    "f7_one_table_templates",
    f"select o_orderkey as template_id, case o_orderkey % {len(TEMPLATES)} when 9 then 2 else 1 end as questions from orders where o_orderkey % {len(TEMPLATES)} != 6",
)
def f7_one_table_templates(t):
    return fl.for_one_table(order_templates(t)).select("template_id", F.size("questions").alias("questions"))


_ANALYSED = [
    ("{COLUMN0} {COLUMN1} {OP0} {VALUE0}", "", "{OP0}:{COLUMN1}:{VALUE0}", "", "false"),
    ("{AGG0} {COLUMN0} {COLUMN1} {OP0} {VALUE0} {COLUMN2} {OP1} {VALUE1}", "{COLUMN0}:number", "{OP0}:{COLUMN1}:{VALUE0},{OP1}:{COLUMN2}:{VALUE1}", "", "false"),
    ("{COLUMN0} {DASC} {VALUE0}", "", "", "{VALUE0}:integer", "true"),
    ("{COLUMN0} {COLUMN1} {DASC} {VALUE0}", "", "", "{VALUE0}:integer", "true"),
    ("{COLUMN0} {VALUE0} {VALUE1}", "{COLUMN0}:number", "", "{VALUE0}:number,{VALUE1}:number", "false"),
    ("{COLUMN0} {COLUMN1} {COLUMN2} {VALUE0}", "{COLUMN2}:{VALUE0}", "", "", "false"),
    ("{COLUMN0} {COLUMN1} {OP0} {VALUE0}", "", "{OP0}:{COLUMN1}:{VALUE0}", "", "false"),
    ("{COLUMN0} {OP0} {VALUE0}", "", "{OP0}:*:{VALUE0}", "", "false"),
    ("{COLUMN0} {COLUMN1} {OP0} {AGG0}", "{COLUMN1}:number", "{OP0}:{COLUMN1}:", "", "false"),
    ("{COLUMN0} {COLUMN1} {DASC}", "", "", "", "true"),
]


@query(
    "g8_pattern_analysis",
    f"select o_orderkey as template_id, slots, rules, ops, vals, dasc::boolean as dasc from orders join (values {_by_template(_ANALYSED)}) v(tid, slots, rules, ops, vals, dasc) on tid = o_orderkey % {len(TEMPLATES)}",
)
def g8_pattern_analysis(t):
    a = sy.analyse_patterns(order_templates(t))
    return a.select(
        "template_id", F.array_join("slots", " ").alias("slots"), F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r.col, r.rule)), ",").alias("rules"),
        F.array_join(F.transform("ops", lambda o: F.concat_ws(":", o.op, o.col, F.coalesce(o.value, F.lit("")))), ",").alias("ops"),
        F.array_join(F.transform("values", lambda v: F.concat_ws(":", v.slot, v.kind)), ",").alias("vals"), "dasc",
    )


_Q_SLOTS = [
    "{COLUMN0} {TABLE0} {COLUMN1} {OP0} {VALUE0}", "{AGG0} {COLUMN0} {COLUMN1} {OP0} {VALUE0} {COLUMN2} {OP1} {VALUE1}", "{COLUMN0} {TABLE0} SC_COL_COUNT_LIMIT",
    "{COLUMN0} SC_COL_LIMIT {COLUMN1}", "{TABLE0} {COLUMN0} {VALUE0} {VALUE1}", "{COLUMN0} {COLUMN1} {TABLE0} {COLUMN2} {VALUE0}", "{COLUMN0} {TABLE1} {COLUMN1} {OP0} {VALUE0}",
    "{COLUMN0} {TABLE0} {OP0} {VALUE0}", "{COLUMN0} {COLUMN1} {OP0} {AGG0}", "{COLUMN0} SC_COL-C1",
]


@query("g9_question_slots", f"select o_orderkey as template_id, slots from orders join (values {_by_template([(x,) for x in _Q_SLOTS])}) v(tid, slots) on tid = o_orderkey % {len(TEMPLATES)}")
def g9_question_slots(t):
    first = F.get("questions", F.lit(0)).text
    return order_templates(t).select("template_id", F.array_join(sy.question_slots(first), " ").alias("slots"))


@query(
    "g10_constraints",
    f"""select o_orderkey as template_id, case o_orderkey % {len(TEMPLATES)} when 1 then '=' when 8 then '>' end as op0, case o_orderkey % {len(TEMPLATES)} when 1 then '=' end as op1,
        case o_orderkey % {len(TEMPLATES)} when 6 then '{{COLUMN0}}:id,{{COLUMN0}}:T0,{{COLUMN1}}:T1' else '' end as cols, o_orderkey % {len(TEMPLATES)} = 6 as two_tables from orders""",
)
def g10_constraints(t):
    fx = order_templates(t).select("template_id", sy.constraint_effects(F.col("constraints")).alias("fx"))
    return fx.select(
        "template_id", F.col("fx.slots")[F.lit("{OP0}")].alias("op0"), F.col("fx.slots")[F.lit("{OP1}")].alias("op1"),
        F.array_join(F.transform("fx.columns", lambda c: F.concat_ws(":", c.col, c.rule)), ",").alias("cols"), F.col("fx.two_tables").alias("two_tables"),
    )


_LABELS = [
    "{COLUMN0}=SELECT;{COLUMN1}=WHERE {OP0}", "{COLUMN0}=SELECT {AGG0};{COLUMN1}=WHERE {OP0};{COLUMN2}=WHERE {OP1}", "{COLUMN0}=SELECT GROUP_BY;*=ORDER_BY COUNT {DASC} LIMIT",
    "{COLUMN0}=SELECT;{COLUMN1}=ORDER_BY {DASC} LIMIT", "*=SELECT COUNT;{COLUMN0}=WHERE BETWEEN", "{COLUMN0}=SELECT;{COLUMN1}=SELECT;{COLUMN2}=WHERE =",
    "{COLUMN0}=SELECT EXCEPT SELECT;{COLUMN1}=EXCEPT WHERE {OP0}", "{COLUMN0}=SELECT GROUP_BY;*=HAVING COUNT {OP0}", "{COLUMN0}=SELECT;{COLUMN1}=WHERE {OP0} OP_SEL SELECT {AGG0}",
    "{COLUMN0}=SELECT;{COLUMN1}=ORDER_BY {DASC}",
]


@query("g14_column_labels", f"select o_orderkey as template_id, labels from orders join (values {_by_template([(x,) for x in _LABELS])}) v(tid, labels) on tid = o_orderkey % {len(TEMPLATES)}")
def g14_column_labels(t):
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e.key, e.value)), ";")
    return order_templates(t).withColumn("m", sy.label_columns(F.col("pattern"))).select("template_id", text.alias("labels"))


_ALL_N, _ONE_N = len(TEMPLATES), len(_SINGLE)


@query(
    "g11_drawn_templates",
    b.using("web_db") + f""", d as (select db_id, count(*) as w, (2 + db_id % 2)::int as n from web_db group by db_id), s as (select db_id, w, (i + 1)::int as sample_no from d, unnest(range(n)) as r(i))
      select db_id, sample_no, (case when w = 2 then floor({b.u_sql(32, 'template', 'db_id', 'sample_no')} * {_ALL_N})::int else {_SINGLE}[floor({b.u_sql(32, 'template', 'db_id', 'sample_no')} * {_ONE_N})::int + 1] end)::int as template_id from s""",
)
def g11_drawn_templates(t):
    return drawn(t).select("db_id", "sample_no", "template_id")


@query(
    "g16_sample_counts",
    b.using("web_db") + f", d as (select distinct db_id from web_db) select db_id, (floor(per) + ({b.u_sql(35, 'count', 'db_id')} < per - floor(per))::int)::int as n from (select db_id, 3001.0::double / (select count(*) from d) as per from d)",
)
def g16_sample_counts(t):
    return sy.sample_counts(dbs(t), 3001, 35).select("db_id", "n")


@query("g12_slot_values", None)
def g12_slot_values(t):
    text = F.array_join(F.array_sort(F.transform(F.map_entries("values"), lambda e: F.concat_ws("=", e.key, e.value))), ";")
    return filled(t).select("db_id", "sample_no", "template_id", F.size("values").alias("n"), F.size("slots").alias("n_slots"), text.alias("filled"), "use_second")


@query("g13_verbalised", None)
def g13_verbalised(t):
    return texts(t).select("db_id", "sample_no", "question_text", "sql_text")


@query("p16_filled_sql", None)
def p16_filled_sql(t):
    return texts(t).select("db_id", "sample_no", "pattern", "sql_text")


@query("g15_example_labels", None)
def g15_example_labels(t):
    text = F.array_join(F.transform(F.map_entries("example_labels"), lambda e: F.concat_ws("=", e.key, e.value)), ";")
    return labelled(t).select("db_id", "sample_no", text.alias("labels"))


@query("a9_label_ids", None)
def a9_label_ids(t):
    return frequency_ids(labelled(t).select(F.explode(F.map_values("example_labels")).alias("label")), "label")


@query("u6_last_schema", None)
def u6_last_schema(t):
    return sy.keep_last_schema(labelled(t)).select("db_id", "sample_no")


@query("g17_examples", None)
def g17_examples(t):
    out = sy.final_examples(labelled(t))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return out.select("db_id", "sample_no", "question", text("columns").alias("columns"), text("values").alias("vals"), text("column_labels").alias("labels"))


@query("g17_from_tables", None)
def g17_from_tables(t):
    """The whole chain, with text keys, two and a half examples a table and the budget in pieces."""
    from ..operators import pieces as pc
    from .texts import byte_pair_files

    tables = web_tables(t).withColumn("table_id", F.concat(F.lit("t-"), F.col("table_id").cast("string")))
    marked = lambda words: words.withColumn("plain", F.col("word")).withColumn("word", pc.visible_letters(F.concat(F.lit(" "), "word")))
    merged = pc.by_merges(byte_pair_files(t.spark)[1])

    def cut(words):
        both = marked(words)
        return both.join(merged(both.select("word").distinct()), "word").select(F.col("plain").alias("word"), "pieces")

    size = int(SIZE_FACTOR * t.part.count())
    out = sy.synthesise(tables, "table_id", template_frame(t.spark), phrase_frame(t.spark), size, 36, cut=cut)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return out.select("db_id", "sample_no", "question", text("columns").alias("columns"), text("values").alias("vals"), text("column_labels").alias("labels"))


@query(
    "f13_known_labels",
    "select o_orderkey as example_id from orders where o_orderpriority != '5-LOW' and o_orderstatus != 'P'",
)
def f13_known_labels(t):
    rows = t.orders.select(F.col("o_orderkey").alias("example_id"), F.create_map(F.lit("a"), "o_orderpriority", F.lit("b"), "o_orderstatus").alias("labels"))
    known = t.orders.filter("o_orderpriority != '5-LOW'").select(F.col("o_orderpriority").alias("label")).unionByName(
        t.orders.filter("o_orderstatus != 'P'").select(F.col("o_orderstatus").alias("label"))
    ).distinct()
    return fl.known_labels(rows, known).select("example_id")


@query(
    "f14_capped_columns",
    """select o_orderkey, count(*) as kept, sum(i)::bigint as places from (select o_orderkey, i, sum(case when lab = 0 then 1 else 1 end) over (partition by o_orderkey order by i) as seen, lab from (
         select o_orderkey, i, case when (o_orderkey + i) % 13 = 0 then 1 else 0 end as lab from orders, unnest(range(60)) as r(i))) where seen <= 41 or lab > 0 group by o_orderkey""",
)
def f14_capped_columns(t):
    cols = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.struct(i.alias("i"), ((F.col("o_orderkey") + i) % 13 == 0).cast("int").alias("lab")))
    kept = t.orders.select("o_orderkey", fl.capped_columns(cols, "lab").alias("k"))
    return kept.select("o_orderkey", F.size("k").cast("long").alias("kept"), F.aggregate("k", F.lit(0).cast("long"), lambda a, c: a + c.i).alias("places"))


# ---- single steps on rows that SQL can make too ----------------------------------------------


def _said(component, key, slot):
    """SQL of the phrase drawn for a slot."""
    cases = " ".join(
        f"when '{k}' then ({b.sql_list(p)})[floor({b.u_sql(40, 'phrase', 'db_id', 'sample_no', repr(slot))} * {len(p)})::int + 1]" for k, p in PHRASES[component].items()
    )
    return f"case {key} {cases} end"


_OP = f"({b.sql_list(sy.OPERATORS)})[(o_orderkey % {len(sy.OPERATORS)})::int + 1]"
_AGG = f"({b.sql_list(sy.AGGREGATES)})[(o_orderkey % {len(sy.AGGREGATES)})::int + 1]"
b.add_cte(
    "to_say",
    f"""select o_custkey as db_id, o_orderkey as sample_no, (o_orderkey % 4)::int as kind, {_OP} as op, {_AGG} as agg, case when o_orderkey % 2 = 0 then 'ASC' else 'DESC' end as dasc,
       case when o_orderkey % 3 = 0 then 1 else 3 end as number, o_orderpriority as val from orders""",
)
_QUESTIONS = ["show {COLUMN0} of {TABLE0} that {OP0} {VALUE0}", "{AGG0} {COLUMN0} SC_COL_LIMIT {COLUMN1}", "list {TABLE1} SC", "{TABLE0} SC_COL_C1 SC_COL_COUNT_LIMIT"]
_NUM = "dasc || case when number > 1 then '_NUM' else '' end"


def to_say(t):
    pick = lambda items: F.get(b.strings(items), (F.col("o_orderkey") % len(items)).cast("int"))
    entry = lambda k, v: (F.lit(k), v)
    values = F.create_map(
        *entry("{COLUMN0}", F.lit("orders total price of one")), *entry("{COLUMN1}", F.lit("orders order date")), *entry("{OP0}", pick(sy.OPERATORS)),
        *entry("{AGG0}", pick(sy.AGGREGATES)), *entry("{DASC}", F.when(F.col("o_orderkey") % 2 == 0, "ASC").otherwise("DESC")), *entry("{VALUE0}", F.col("o_orderpriority")),
    )
    question = pick(_QUESTIONS)
    return t.orders.select(
        F.col("o_custkey").alias("db_id"), F.col("o_orderkey").alias("sample_no"), values.alias("values"), question.alias("question"), sy.question_slots(question).alias("q_slots"),
        F.lit("SELECT {COLUMN0} {FROM} WHERE {COLUMN1} {OP0} {VALUE0}").alias("pattern"), F.struct(F.lit("first table").alias("name")).alias("t0"),
        F.struct(F.lit("second").alias("name")).alias("t1"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(3).alias("number"),
    )


@query(
    "g13_said",
    b.using("to_say") + f"""select db_id, sample_no, case kind when 0 then 'show total price of one of first table that ' || {_said('OP', 'op', '{OP0}')} || ' ' || array_to_string(string_split(val, ' ')[1:5], ' ')
       when 1 then {_said('AGG', 'agg', '{AGG0}')} || ' total price of one ' || replace({_said('SC_COL_LIMIT', f'({_NUM})', 'SC_COL_LIMIT')}, '[NUM]', number::varchar) || ' order date'
       when 2 then 'list second ' || {_said('SC', 'dasc', 'SC')}
       else 'first table ' || replace({_said('SC_COL', 'dasc', 'SC_COL_C1')}, '[COL]', 'orders order date') || ' ' || replace({_said('SC_COL_COUNT_LIMIT', f'({_NUM})', 'SC_COL_COUNT_LIMIT')}, '[NUM]', number::varchar) end as question
       from to_say""",
)
def g13_said(t):
    return sy.verbalise(to_say(t), phrase_frame(t.spark), 40).select("db_id", "sample_no", F.col("question_text").alias("question"))


@query("p16_filled_patterns", b.using("to_say") + "select sample_no, 'SELECT orders_=_total_=_price_=_of_=_one WHERE orders_=_order_=_date ' || op || ' ' || val as sql_text from to_say")
def p16_filled_patterns(t):
    from ..functions.textforms import fill_sql

    return to_say(t).select("sample_no", fill_sql(F.col("pattern"), F.col("values")).alias("sql_text"))


@query(
    "g15_labels",
    """select o_orderkey as sample_no, case when o_orderkey % 3 = 0 then 'a b=WHERE ' || o_orderstatus else 'a b=SELECT;c d=WHERE ' || o_orderstatus end
       || case when o_orderkey % 2 = 0 then ';one *=SELECT' else '' end || case when o_orderkey % 5 = 0 then ';two *=SELECT' else '' end as labels from orders""",
)
def g15_labels(t):
    """Two slots that take the same column in every third row, and ``*`` columns of used tables."""
    k = F.col("o_orderkey")
    table = lambda n: F.struct(F.array(F.struct(F.lit(n).alias("name"))).alias("cols"))
    rows = t.orders.select(
        k.alias("sample_no"), F.create_map(F.lit("{COLUMN0}"), F.lit("SELECT"), F.lit("{COLUMN1}"), F.lit("WHERE {OP0}")).alias("labels"),
        F.create_map(F.lit("{COLUMN0}"), F.lit("a b"), F.lit("{COLUMN1}"), F.when(k % 3 == 0, "a b").otherwise("c d"), F.lit("{OP0}"), F.col("o_orderstatus")).alias("values"),
        (k % 2 == 0).alias("star0"), (k % 5 == 0).alias("star1"), table("one *").alias("t0"), table("two *").alias("t1"),
    )
    text = F.array_join(F.transform(F.map_entries("example_labels"), lambda e: F.concat_ws("=", e.key, e.value)), ";")
    return sy.label_examples(rows).select("sample_no", text.alias("labels"))


@query(
    "a9_ids_of_labels",
    "select label, n, (row_number() over (order by n desc, label))::int as label_id from (select o_orderpriority || ' ' || o_orderstatus || ' ' || (o_custkey % 97)::varchar as label, count(*) as n from orders group by 1)",
)
def a9_ids_of_labels(t):
    label = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 97).cast("string"))
    return frequency_ids(t.orders.select(label.alias("label")), "label")


@query(
    "u6_equal_schemas",
    "select db_id, sample_no from (select p_partkey as db_id, max(p_partkey) over (partition by p_brand, p_size % 3) as last from part) x, unnest(range(2)) as r(sample_no) where db_id = last",
)
def u6_equal_schemas(t):
    col = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    tables = F.array(F.struct(F.array(col("brand", F.col("p_brand"))).alias("cols")), F.struct(F.array(col("size", F.col("p_size") % 3)).alias("cols")))
    two = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("sample_no")
    return sy.keep_last_schema(t.part.select(F.col("p_partkey").alias("db_id"), tables.alias("tables"), two)).select("db_id", "sample_no")
