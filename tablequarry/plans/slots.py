"""Registered queries: slot queries, their execution, text forms and scores."""

from pyspark.sql import functions as F

from ..functions import literals as lit
from ..functions.seeded import pick_number, unit
from ..operators import slotquery as sq, slotscore as sc, spans
from . import base as b
from .registry import query

KEY = "query_id"


def _with_header(t):
    return b.slot_queries(t).join(b.slot_tables(t), "table_id")


def _flat(conds):
    return F.array_join(F.transform(conds, lambda c: F.concat_ws(":", c.col.cast("string"), c.op.cast("string"), c.val)), ";")


FLAT = "array_to_string([c.col::varchar || ':' || c.op::varchar || ':' || c.val for c in conds], ';')"


@query(
    "a2_slot_batch",
    b.using("gold_sum") + f"select query_id, agg, n_rows, {b.near_sql('num')} as num, txt from gold_sum",
)
def a2_slot_batch(t):
    out = sq.summaries(b.slot_queries(t), b.slot_tables(t), b.slot_rows(t))
    return out.select(KEY, "agg", "n_rows", b.near(F.col("num")).alias("num"), "txt")


@query(
    "a2_slot_lists",
    b.using("gold_match") + """select query_id, row_number() over (partition by query_id order by row_id) as place,
      case when sel_type = 'real' then null else txt end as txt,
      case when sel_type = 'real' then round(txt::double, 2) end as num from gold_match where agg = 0""",
)
def a2_slot_lists(t):
    items = sq.answer_items(b.slot_queries(t).filter("agg = 0"), b.slot_tables(t), b.slot_rows(t))
    num = F.when(F.col("cell").startswith("n"), F.expr("substring(cell, 2)").try_cast("double"))
    return items.select(
        KEY, "place", F.when(F.col("cell").startswith("t"), F.expr("substring(cell, 2)")).alias("txt"), F.round(num, 2).alias("num")
    )


@query(
    "s17_cells",
    b.using("slot_rows", "slot_tables") + """select table_id, row_id, i - 1 as col_id, lower(cells[i]) as txt,
      case when types[i] = 'real' then try_cast(cells[i] as double) end as num
      from slot_rows join slot_tables using (table_id), unnest(range(1, 5)) as r(i)""".replace("i - 1", "(i - 1)::int"),
)
def s17_cells(t):
    return sq.to_cells(b.slot_rows(t), b.slot_tables(t))


_ORDER_TABLES = """select '2-' || l_orderkey::varchar as table_id,
   row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as row_id,
   l_linenumber::varchar as c0, l_quantity::varchar as c1, l_returnflag as c2 from lineitem"""


def nested_order_tables(t):
    """One small table per order; at most seven line numbers keep the nested rows short."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    grouped = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("items"))
    return grouped.select(
        F.concat(F.lit("2-"), F.col("l_orderkey").cast("string")).alias("id"),
        b.strings(["Line Number", "Quantity", "Return Flag"]).alias("header"), b.strings(["real", "real", "text"]).alias("types"),
        "items",
    )


@query("s3_slot_tables", _ORDER_TABLES)
def s3_slot_tables(t):
    from ..sources.readers import parse_slot_tables

    lines = nested_order_tables(t).select(
        F.concat(
            F.lit('{"id": "'), F.col("id"), F.lit('", "header": ["Line Number", "Quantity", "Return Flag"], "types": ["real", "real", "text"], "rows": ['),
            F.array_join(
                F.transform(
                    "items",
                    lambda r: F.concat(F.lit("["), r.l_linenumber.cast("string"), F.lit(", "), r.l_quantity.cast("string"), F.lit(', "'), r.l_returnflag, F.lit('"]')),
                ), ", ",
            ), F.lit("]}"),
        ).alias("value")
    )
    rows = sq.rows_from_nested(parse_slot_tables(lines))
    return rows.select("table_id", "row_id", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(3)])


@query(
    "s3_slot_questions",
    b.using("slot_questions") + f"""select query_id, table_id, question, sel, agg,
      array_to_string([c.col::varchar || ':' || c.op::varchar || ':' || c.val || ':' || c.is_num::varchar for c in conds], ';') as conds
      from slot_questions""",
)
def s3_slot_questions(t):
    from ..sources.readers import parse_slot_questions

    quoted = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    conds = F.array_join(
        F.transform(
            "conds",
            lambda c: F.concat(F.lit("["), c.col.cast("string"), F.lit(", "), c.op.cast("string"), F.lit(", "), F.when(c.is_num, c.val).otherwise(quoted(c.val)), F.lit("]")),
        ), ", ",
    )
    lines = b.slot_questions(t).select(
        F.concat(
            F.lit('{"id": '), F.col(KEY).cast("string"), F.lit(', "table_id": '), quoted(F.col("table_id")), F.lit(', "question": '), quoted(F.col("question")),
            F.lit(', "sql": {"sel": '), F.col("sel").cast("string"), F.lit(', "agg": '), F.col("agg").cast("string"), F.lit(', "conds": ['), conds, F.lit("]}}"),
        ).alias("value")
    )
    shown = F.array_join(
        F.transform("conds", lambda c: F.concat_ws(":", c.col.cast("string"), c.op.cast("string"), c.val, c.is_num.cast("string"))), ";"
    )
    return parse_slot_questions(lines).select(F.col("id").alias(KEY), "table_id", "question", "sel", "agg", shown.alias("conds"))


@query("s18_scan_table", "select * from supplier")
def s18_scan_table(t):
    from ..sources.readers import scan_table

    return scan_table(t.spark, f"{t.folder}/supplier.parquet")


_OPS, _AGGS = b.sql_list(lit.COMPARISONS), b.sql_list(lit.AGGREGATES)
_NUMBERED = f"""'SELECT ' || ({_AGGS})[agg + 1] || ' col' || sel::varchar || ' FROM table' || case when len(conds) > 0 then ' WHERE ' ||
  array_to_string(['col' || c.col::varchar || ' ' || ({_OPS})[c.op + 1] || ' ' || c.val for c in conds], ' AND ') else '' end"""
_NAMED_WHERE = f"array_to_string([header[c.col + 1] || ' ' || ({_OPS})[c.op + 1] || ' ' || c.val for c in conds], ' AND ')"
_NAMED = f"""'SELECT ' || case when agg = 0 then header[sel + 1] else ({_AGGS})[agg + 1] || '(' || header[sel + 1] || ')' end ||
  ' FROM ' || 'table_' || replace(table_id, '-', '_') || ' WHERE ' || {_NAMED_WHERE}"""
_READABLE = f"""'SELECT ' || lower(({_AGGS})[agg + 1]) || '(' || header[sel + 1] || ') FROM ' || table_id ||
  case when len(conds) > 0 then ' WHERE ' || {_NAMED_WHERE} else '' end"""


@query(
    "p11_query_text",
    b.using("slot_queries", "slot_tables") + f"select query_id, {_NUMBERED} as numbered, {_NAMED} as named, {_READABLE} as readable "
    "from slot_queries join slot_tables using (table_id)",
)
def p11_query_text(t):
    parts = [F.col("header"), F.col("sel"), F.col("agg"), F.col("conds")]
    return _with_header(t).select(
        KEY, sq.sql_text(*parts, F.col("table_id"), "numbered").alias("numbered"),
        sq.sql_text(*parts, lit.table_key(F.col("table_id")), "named").alias("named"),
        sq.sql_text(*parts, F.col("table_id"), "readable").alias("readable"),
    )


_QUOTED = b.u_sql(3, "quote", "query_id", "@i") + " < 0.5"


@query(
    "p12_spoken",
    b.using("slot_queries", "slot_tables") + f"select query_id, {b.spoken_sql(_QUOTED)} as words, {b.spoken_sql(_QUOTED, True)} as bracketed "
    "from slot_queries join slot_tables using (table_id)",
)
def p12_spoken(t):
    parts = [F.col("header"), F.col("sel"), F.col("agg"), F.col("conds")]
    quoted = lambda i: unit(3, "quote", F.col(KEY), i) < 0.5
    return _with_header(t).select(
        KEY, sq.spoken_text(*parts, quoted).alias("words"), sq.spoken_text(*parts, quoted, bracketed=True).alias("bracketed")
    )


@query(
    "p13_lower",
    b.using("slot_queries") + "select query_id, array_to_string([lower(c.val) for c in conds], '|') as vals from slot_queries",
)
def p13_lower(t):
    low = sq.lower_conditions(F.col("conds"))
    return b.slot_queries(t).select(KEY, F.array_join(F.transform(low, lambda c: c.val), "|").alias("vals"))


_P14 = "'Paid ' || replace(o_totalprice::varchar, '.', ',') || ' or ' || o_totalprice::varchar || ' at -' || o_orderkey::varchar"


@query(
    "p14_number",
    f"""select o_orderkey, {b.number_sql("o_totalprice::varchar")} as plain, {b.number_sql("'-1,234,' || o_orderkey::varchar")} as grouped,
       {b.number_sql("'item -' || o_orderkey::varchar || ' cost -' || o_totalprice::varchar")} as first_found, {b.number_sql("o_orderstatus")} as none_found
       from orders""",
)
def p14_number(t):
    k, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")
    return t.orders.select(
        "o_orderkey", lit.literal_number(price).alias("plain"), lit.literal_number(F.concat(F.lit("-1,234,"), k)).alias("grouped"),
        lit.literal_number(F.concat(F.lit("item -"), k, F.lit(" cost -"), price)).alias("first_found"),
        lit.literal_number(F.col("o_orderstatus")).alias("none_found"),
    )


@query(
    "p18_names",
    b.using("slot_queries") + f"""select query_id, ({_AGGS})[agg + 1] as agg_name, agg as agg_id,
      array_to_string([({_OPS})[c.op + 1] for c in conds], ' ') as ops from slot_queries""",
)
def p18_names(t):
    name = lit.name_of(lit.AGGREGATES, F.col("agg"))
    return b.slot_queries(t).select(
        KEY, name.alias("agg_name"), lit.id_of(lit.AGGREGATES, name).alias("agg_id"),
        F.array_join(F.transform("conds", lambda c: lit.name_of(lit.COMPARISONS, c.op)), " ").alias("ops"),
    )


@query(
    "p19_table_key",
    b.using("slot_tables") + "select table_id, 'table_' || replace(table_id, '-', '_') as k, 'table_' || replace(table_id, '-', '_') as again from slot_tables",
)
def p19_table_key(t):
    out = b.slot_tables(t).select("table_id", lit.table_key(F.col("table_id")).alias("k"))
    return out.withColumn("again", lit.table_key(F.col("k")))


@query(
    "j1_query_table",
    b.using("slot_queries", "slot_tables") + """select query_id, table_id, header[sel + 1] as picked, types[sel + 1] as kind
      from slot_queries join slot_tables using (table_id)""",
)
def j1_query_table(t):
    return _with_header(t).select(KEY, "table_id", F.get("header", F.col("sel")).alias("picked"), F.get("types", F.col("sel")).alias("kind"))


@query(
    "f10_valid_example",
    b.using("slot_questions") + """select query_id,
       (len(header) > 0 and len([h for h in header if trim(h) = '']) = 0 and len(list_distinct([lower(h) for h in header])) = len(header)
        and len([w for c in conds for w in string_split(lower(c.val), ' ') if not list_contains(list_slice(toks, 2, 1000), w)]) = 0)
       as valid from slot_questions""".replace(
        "[w for c in conds for w in string_split(lower(c.val), ' ') if not list_contains(list_slice(toks, 2, 1000), w)]",
        "[w for w in flatten([string_split(lower(c.val), ' ') for c in conds]) if not list_contains(toks[2:], w)]",
    ),
)
def f10_valid_example(t):
    from ..operators.filters import valid_example

    seen = F.expr("slice(toks, 2, greatest(size(toks) - 1, 0))")
    words = F.flatten(F.transform("conds", lambda c: F.split(F.lower(c.val), " ")))
    return b.slot_questions(t).select(KEY, valid_example(F.col("header"), words, seen).alias("valid"))


@query(
    "f11_allowed_pair",
    b.using("slot_predictions", "slot_tables") + """select query_id, case when types[sel + 1] = 'text' then agg in (0, 3) else true end as ok
      from slot_predictions join slot_tables using (table_id)""",
)
def f11_allowed_pair(t):
    both = b.slot_predictions(t).join(b.slot_tables(t), "table_id")
    return both.select(KEY, sq.allowed_pair(F.get("types", F.col("sel")), F.col("agg")).alias("ok"))


@query(
    "f12_with_answer",
    b.using("pred_sum") + "select query_id from pred_sum where agg > 0 or n_rows > 0",
)
def f12_with_answer(t):
    return sq.with_answer(b.slot_predictions(t), b.slot_tables(t), b.slot_rows(t)).select(KEY)


@query(
    "f16_failed",
    b.using("slot_predictions") + "select count(*) as n, count_if(failed) as n_failed, avg(case when failed then 0.0 else 1.0 end) as usable from slot_predictions",
)
def f16_failed(t):
    from ..operators.filters import usable

    p = b.slot_predictions(t)
    return p.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("n_failed"), F.avg(usable(F.col("failed")).cast("double")).alias("usable")
    )


@query(
    "a1_aggregates",
    """select c_mktsegment, max(c_acctbal) as mx, min(c_acctbal) as mn, count(c_acctbal) as n, round(sum(c_acctbal) + 1e-7, 2) as total,
       round(avg(c_acctbal) + 1e-7, 4) as mean from customer group by c_mktsegment""",
)
def a1_aggregates(t):
    x = F.col("c_acctbal")
    return t.customer.groupBy("c_mktsegment").agg(
        F.max(x).alias("mx"), F.min(x).alias("mn"), F.count(x).alias("n"), b.near(F.sum(x), 2).alias("total"), b.near(F.avg(x)).alias("mean")
    )


@query(
    "o5_sorted_conditions",
    b.using("slot_predictions") + f"select query_id, {FLAT.replace('in conds', 'in list_sort(conds)')} as conds from slot_predictions",
)
def o5_sorted_conditions(t):
    return b.slot_predictions(t).select(KEY, _flat(sq.sort_conditions(F.col("conds"))).alias("conds"))


_SET = "list_sort(list_distinct([{{'col': c.col, 'op': c.op, 'val': lower(c.val)}} for c in {0}.conds]))"
_LIST = "[{{'col': c.col, 'op': c.op, 'val': lower(c.val)}} for c in {0}.conds]"
_SAME_SET = _SET.format("g") + " = " + _SET.format("p")
_SAME_LIST = _LIST.format("g") + " = " + _LIST.format("p")
_PAIRS = "slot_queries g join slot_predictions p using (query_id)"


@query(
    "u5_same_conditions",
    b.using("slot_queries", "slot_predictions") + f"select query_id, ({_SAME_SET}) as as_set, ({_SAME_LIST}) as as_list from {_PAIRS}",
)
def u5_same_conditions(t):
    pairs = sc.pair_queries(b.slot_queries(t), b.slot_predictions(t))
    return pairs.select(
        KEY, sc.same_conditions(F.col("g.conds"), F.col("p.conds")).alias("as_set"),
        sc.same_conditions(F.col("g.conds"), F.col("p.conds"), ordered=True).alias("as_list"),
    )


@query(
    "e1_logical_form",
    b.using("slot_queries", "slot_predictions") + f"select query_id, (g.sel = p.sel and g.agg = p.agg and {_SAME_SET})::int as lf from {_PAIRS}",
)
def e1_logical_form(t):
    pairs = sc.pair_queries(b.slot_queries(t), b.slot_predictions(t))
    return pairs.select(KEY, sc.same_form("g", "p").cast("int").alias("lf"))


def _answers(name):
    return f"""(select s.query_id, case when s.agg > 0 then [case when s.num is not null then 'n' || round(s.num, 6)::varchar
       when s.txt is not null then 't' || s.txt else 'none' end] else coalesce(l.cells, []) end as answer
       from {name}_sum s left join (select query_id, list(case when sel_type = 'real' then 'n' || round(txt::double, 6)::varchar else 't' || txt end order by row_id) as cells
       from {name}_match where agg = 0 group by query_id) l using (query_id))"""


def _exec_sql(lenient):
    more = " and len(pa.answer) > 0" if lenient else ""
    return b.using("gold_sum", "pred_sum") + f""", ga as {_answers('gold')}, pa as {_answers('pred')}, scored as (
      select g.query_id, (not p.failed and ga.answer = pa.answer{more})::int as ex,
             (not p.failed and g.sel = p.sel and g.agg = p.agg and {_SAME_SET})::int as lf
      from slot_queries g join slot_predictions p using (query_id) join ga using (query_id) join pa using (query_id)) """


@query("e2_execution_strict", _exec_sql(False) + "select count(*) as n, avg(ex) as ex_accuracy, avg(lf) as lf_accuracy from scored")
def e2_execution_strict(t):
    s = sc.execution_scores(b.slot_queries(t), b.slot_predictions(t), b.slot_tables(t), b.slot_rows(t))
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg("ex").alias("ex_accuracy"), F.avg("lf").alias("lf_accuracy"))


@query("e3_execution_lenient", _exec_sql(True) + "select query_id, ex from scored")
def e3_execution_lenient(t):
    s = sc.execution_scores(b.slot_queries(t), b.slot_predictions(t), b.slot_tables(t), b.slot_rows(t), lenient=True)
    return s.select(KEY, "ex")


@query(
    "e4_items_and_means",
    _exec_sql(False) + """select query_id, ex::double as ex, lf::double as lf from scored
      union all select null, avg(ex), avg(lf) from scored""",
)
def e4_items_and_means(t):
    s = sc.execution_scores(b.slot_queries(t), b.slot_predictions(t), b.slot_tables(t), b.slot_rows(t))
    return sc.item_and_mean(s, KEY, ["ex", "lf"])


_SORTED = "list_sort({0}.conds)"
_CLAUSES = f"""select query_id, (g.sel = p.sel)::int as sc, (g.agg = p.agg)::int as sa, (len(g.conds) = len(p.conds))::int as wn,
  (list_sort([c.col for c in g.conds]) = list_sort([c.col for c in p.conds]))::int as wc,
  ([c.op for c in {_SORTED.format('g')}] = [c.op for c in {_SORTED.format('p')}])::int as wo,
  ([lower(c.val) for c in {_SORTED.format('g')}] = [lower(c.val) for c in {_SORTED.format('p')}])::int as wv from {_PAIRS}"""


@query("e5_clauses", b.using("slot_queries", "slot_predictions") + _CLAUSES)
def e5_clauses(t):
    s = sc.clause_scores(sc.pair_queries(b.slot_queries(t), b.slot_predictions(t)))
    return s.select(KEY, "sc", "sa", "wn", "wc", "wo", "wv")


_SPANS = """list_transform({0}conds, lambda c: list_position(
   [array_to_string(toks[i:i + len(string_split(lower(c.val), ' ')) - 1], ' ') for i in range(1, len(toks) + 1)], lower(c.val)))"""


@query(
    "e5_value_spans",
    b.using("slot_questions", "slot_predictions") + f"""select query_id, (len(g.conds) = len(p.conds) and {_SPANS.format('g.')} = {_SPANS.format('p.')})::int as wvi
      from slot_questions g join slot_predictions p using (query_id)""",
)
def e5_value_spans(t):
    g = b.slot_questions(t).select(KEY, "toks", F.col("conds").alias("gc"))
    p = b.slot_predictions(t).select(KEY, F.col("conds").alias("pc"))
    same = (F.size("gc") == F.size("pc")) & (spans.value_spans(F.col("toks"), F.col("gc")) == spans.value_spans(F.col("toks"), F.col("pc")))
    return g.join(p, KEY).select(KEY, same.cast("int").alias("wvi"))


@query(
    "e6_all_clauses",
    b.using("slot_queries", "slot_predictions") + f"""select count(*) as n, avg(sc) as sc, avg(sa) as sa, avg(wn) as wn, avg(wc) as wc, avg(wo) as wo, avg(wv) as wv,
      avg(least(sc, sa, wn, wc, wo, wv)) as lx from ({_CLAUSES})""",
)
def e6_all_clauses(t):
    s = sc.clause_scores(sc.pair_queries(b.slot_queries(t), b.slot_predictions(t)))
    return s.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("sc", "sa", "wn", "wc", "wo", "wv", "lx")])


@query(
    "x11_value_spans",
    b.using("slot_questions") + f"""select query_id, i::int as cond, ({_SPANS.format('')}[i + 1] - 1)::int as first,
      ({_SPANS.format('')}[i + 1] + len(string_split(lower(conds[i + 1].val), ' ')) - 2)::int as last
      from slot_questions, unnest(range(len(conds))) as r(i)""",
)
def x11_value_spans(t):
    out = b.slot_questions(t).select(KEY, F.posexplode(spans.value_spans(F.col("toks"), F.col("conds"))).alias("cond", "span"))
    return out.select(KEY, "cond", F.col("span.first").alias("first"), F.col("span.last").alias("last"))


@query(
    "x12_gold_parts",
    b.using("slot_queries") + """select query_id, sel as sc, agg as sa, len(conds)::int as wn, array_to_string([c.col::varchar for c in conds], ',') as wc,
      array_to_string([c.op::varchar for c in conds], ',') as wo, array_to_string([c.val for c in conds], '|') as wv from slot_queries""",
)
def x12_gold_parts(t):
    from ..operators.features import gold_parts

    p = gold_parts(b.slot_queries(t))
    text = lambda c, s: F.array_join(F.transform(c, lambda x: x.cast("string")), s)
    return p.select(KEY, "sc", "sa", "wn", text("wc", ",").alias("wc"), text("wo", ",").alias("wo"), text("wv", "|").alias("wv"))


@query(
    "k10_gold_order",
    b.using("slot_queries", "slot_predictions") + """select query_id, array_to_string([x::varchar for x in
       (case when list_sort(list_distinct(gc)) = list_sort(list_distinct(pc)) then gc else pc end)], ',') as cols
       from (select query_id, [c.col for c in g.conds] as gc, [c.col for c in p.conds] as pc from slot_queries g join slot_predictions p using (query_id))""",
)
def k10_gold_order(t):
    pairs = sc.pair_queries(b.slot_queries(t), b.slot_predictions(t))
    cols = sc.with_gold_order(F.col("g.conds.col"), F.col("p.conds.col"))
    return pairs.select(KEY, F.array_join(F.transform(cols, lambda x: x.cast("string")), ",").alias("cols"))


@query(
    "g19_column_labels",
    b.using("slot_queries") + """select query_id, array_to_string([(case when i = sel then agg + 1 when len([c for c in conds if c.col = i]) > 0
       then 7 + [c.op for c in conds if c.col = i][-1] else 0 end)::varchar for i in range(4)], ' ') as labels from slot_queries""",
)
def g19_column_labels(t):
    labels = sq.column_labels(F.lit(4), F.col("sel"), F.col("agg"), F.col("conds"))
    return b.slot_queries(t).select(KEY, F.array_join(F.transform(labels, lambda x: x.cast("string")), " ").alias("labels"))


_SYM = f"""'SYMSELECT SYMAGG ' || ({_AGGS})[agg + 1] || ' SYMCOL ' || header[sel + 1] || case when len(conds) > 0 then ' SYMWHERE ' ||
  array_to_string(['SYMCOL ' || header[c.col + 1] || ' SYMOP ' || ({_OPS})[c.op + 1] || ' SYMCOND ' || c.val for c in conds], ' SYMAND ') else '' end || ' SYMEND'"""
_SYM_MARKS = " ".join("SYM" + s for s in sq.SYMBOLS)
_SYM_IN = f"""'SYMSYMS {_SYM_MARKS} SYMAGGOPS {" ".join(lit.AGGREGATES)} SYMCONDOPS {" ".join(lit.COMPARISONS)} SYMTABLE ' ||
  array_to_string(['SYMCOL ' || h for h in header], ' ') || ' SYMQUESTION ' || question || ' SYMEND'"""


@query("g22_symbols", b.using("slot_questions") + f"select query_id, {_SYM} as out_seq, {_SYM_IN} as in_seq from slot_questions")
def g22_symbols(t):
    return b.slot_questions(t).select(
        KEY, sq.symbol_output(F.col("header"), F.col("sel"), F.col("agg"), F.col("conds")).alias("out_seq"),
        sq.symbol_input(F.col("header"), F.col("question")).alias("in_seq"),
    )


@query(
    "g23_symbols_back",
    b.using("slot_queries") + f"select query_id, false as error, sel, agg, {FLAT.replace('c.val', 'lower(c.val)')} as conds, true as same from slot_queries",
)
def g23_symbols_back(t):
    seq = _with_header(t).withColumn("seq", sq.symbol_output(F.col("header"), F.col("sel"), F.col("agg"), F.col("conds")))
    gold = seq.select(KEY, "header", "seq", F.struct("sel", "agg", "conds").alias("g"))
    back = sq.read_symbols(gold, "seq", "header").withColumn("p", F.struct("sel", "agg", "conds"))
    return back.select(KEY, "error", "sel", "agg", _flat(F.col("conds")).alias("conds"), sc.same_form("g", "p").alias("same"))


@query(
    "s11_caption_lines",
    b.using("slot_questions") + """select query_id, trim('<s> ' || question || ' </s> ' || array_to_string(header, ' </s> ') || ' </s>  ||| ' ||
       array_to_string([(case when i = sel then agg + 1 when len([c for c in conds if c.col = i]) > 0
       then 7 + [c.op for c in conds if c.col = i][-1] else 0 end)::varchar for i in range(4)], ' ')) as line from slot_questions""",
)
def s11_caption_lines(t):
    from ..sources.sinks import caption_line

    labels = sq.column_labels(F.size("header"), F.col("sel"), F.col("agg"), F.col("conds"))
    return b.slot_questions(t).select(KEY, caption_line(F.col("question"), F.col("header"), labels).alias("line"))


@query(
    "s11b_three_lines",
    b.using("slot_questions") + f"""select query_id, lower('COLUMNS: ' || array_to_string(header, ' | ') || chr(10) || 'QUESTION: ' || question || chr(10) ||
      'SQL: ' || {b.spoken_sql('false', True)}) as lines from slot_questions""",
)
def s11b_three_lines(t):
    from ..sources.sinks import three_lines

    text = sq.spoken_text(F.col("header"), F.col("sel"), F.col("agg"), F.col("conds"), lambda i: F.lit(False), bracketed=True)
    return b.slot_questions(t).select(KEY, three_lines(F.col("header"), F.col("question"), text).alias("lines"))


@query(
    "s12_prediction_lines",
    b.using("slot_predictions") + """select query_id, '{"query":{"sel":' || sel::varchar || ',"agg":' || agg::varchar || ',"conds":[' ||
       array_to_string(['[' || c.col::varchar || ',' || c.op::varchar || ',"' || c.val || '"]' for c in conds], ',') || ']},"table_id":"' || table_id || '"}' as line
       from slot_predictions""",
)
def s12_prediction_lines(t):
    from ..sources.sinks import prediction_line

    return b.slot_predictions(t).select(KEY, prediction_line(F.col("sel"), F.col("agg"), F.col("conds"), F.col("table_id")).alias("line"))


@query(
    "s14_aligned",
    b.using("slot_queries", "slot_predictions") + """select query_id as line_no, g.sel as gold_sel, p.sel as pred_sel
      from slot_queries g join slot_predictions p using (query_id)""",
)
def s14_aligned(t):
    from ..sources.readers import pair_by_line

    gold = b.slot_queries(t).select(F.col(KEY).alias("line_no"), F.to_json(F.struct("sel")).alias("value"))
    pred = b.slot_predictions(t).select(F.col(KEY).alias("line_no"), F.to_json(F.struct("sel")).alias("value"))
    out = pair_by_line(gold, pred)
    sel = lambda c: F.get_json_object(c, "$.sel").cast("int")
    return out.select("line_no", sel("gold").alias("gold_sel"), sel("pred").alias("pred_sel"))


@query("s15_first_rows", "select o_orderkey from orders order by o_orderkey limit 100")
def s15_first_rows(t):
    from ..sources.readers import head_n

    return head_n(t.orders.select("o_orderkey"), "o_orderkey", 100)


@query("s15_seeded_sample", f"select o_orderkey from orders order by {b.u_sql(5, 'sample', 'o_orderkey')}, o_orderkey limit 100")
def s15_seeded_sample(t):
    from ..sources.readers import seeded_sample

    return seeded_sample(t.orders.select("o_orderkey"), "o_orderkey", 100, seed=5)


@query(
    "a13_nested_questions",
    b.using("slot_questions") + """select table_id, table_id || '-' || (row_number() over (partition by table_id order by query_id) - 1)::varchar as qas_id,
      query_id, question, array_to_string([(instr(question, lower(c.val)) - 1)::varchar for c in conds], ',') as starts,
      array_to_string(header, ' ') as context from slot_questions""",
)
def a13_nested_questions(t):
    from ..operators.features import question_answers

    return question_answers(b.slot_questions(t)).select(
        "table_id", "qas_id", KEY, "question", F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"), "context"
    )


@query(
    "a14_counters",
    b.using("slot_questions") + """select count(*) as lines, count_if(len(toks) <= 12) as kept, count_if(len(toks) > 12) as skipped,
       max(len(header))::int as max_columns, count(distinct agg) as labels from slot_questions""",
)
def a14_counters(t):
    from ..operators.filters import job_counters

    return job_counters(b.slot_questions(t), F.size("toks"), 12, F.size("header"), F.col("agg"))


@query(
    "g20_columns_with_values",
    b.using("slot_rows", "slot_tables") + f"""select table_id, array_to_string([header[i] || ' ' || array_to_string(string_split(cells[i], ' ')[1:4], ' ') for i in range(1, 5)], ' | ') as cols
      from slot_tables join (select table_id, arg_min(cells, {b.u_sql(6, 'row', 'table_id', 'row_id')}) as cells from slot_rows group by table_id) using (table_id)""",
)
def g20_columns_with_values(t):
    from ..operators.features import columns_with_values

    out = columns_with_values(b.slot_tables(t), b.slot_rows(t), seed=6)
    return out.filter(F.col("row_id").isNotNull()).select("table_id", F.array_join("columns", " | ").alias("cols"))


_G21 = b.using("slot_questions") + f""", o as (select query_id, 'q ' || question as q, 's ' || lower({_NUMBERED}) as s, row_number() over (order by query_id) - 1 as pos from slot_questions),
  first as (select * from o where pos < 10000), other as (select *, (pos - 10000) % 10000 as at from o where pos >= 10000) """


@query(
    "g21_consistency_pairs",
    _G21 + """select query_id, q || ' ||| ' || q || ' ||| ' || s as line from first
      union all select o.query_id, o.s || ' ||| ' || f.q || ' ||| ' || f.s from other o join first f on f.pos = o.at""",
)
def g21_consistency_pairs(t):
    from ..operators.features import consistency_pairs

    parts = [F.col("header"), F.col("sel"), F.col("agg"), F.col("conds")]
    rows = b.slot_questions(t).select(
        KEY, F.concat(F.lit("q "), F.col("question")).alias("q"),
        F.concat(F.lit("s "), F.lower(sq.sql_text(*parts, F.col("table_id"), "numbered"))).alias("s"),
    )
    return consistency_pairs(rows, KEY, "q", "s", n_first=10_000)


@query("g18_generated", None)
def g18_generated(t):
    out = sq.generate_queries(b.slot_tables(t), b.slot_rows(t), 2, 40)
    return out.select(KEY, "sel", "agg", _flat(F.col("conds")).alias("conds"), "n_rows")
