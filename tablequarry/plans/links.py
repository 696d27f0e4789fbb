"""Registered queries: database schemas and links of questions to them.

Every customer has a database: the first 3 to 7 tables of the star schema. Every order
asks one question of its customer's database.
"""

from pyspark.sql import functions as F

from ..functions.seeded import pick_number
from ..operators import linking as lk, schemas as sm
from ..sources import readers as rd
from . import base as b
from .registry import query

# The star schema as it is described to the linking jobs.
TABLES = ["region", "nation", "customer", "orders", "line item", "part", "supplier"]
COLUMNS = [
    (-1, "*", "text"), (0, "region key", "number"), (0, "name", "text"), (1, "nation key", "number"), (1, "name", "text"), (1, "region key", "number"),
    (2, "customer key", "number"), (2, "customer name", "text"), (2, "nation key", "number"), (2, "account balance", "number"), (2, "market segment", "text"),
    (3, "order key", "number"), (3, "customer key", "number"), (3, "order status", "text"), (3, "total price", "number"), (3, "order date", "time"),
    (3, "order priority", "text"), (4, "order key", "number"), (4, "part key", "number"), (4, "supplier key", "number"), (4, "quantity", "number"),
    (4, "discount", "number"), (5, "part key", "number"), (5, "part name", "text"), (5, "brand", "text"), (5, "size", "number"),
    (6, "supplier key", "number"), (6, "supplier name", "text"), (6, "nation key", "number"), (6, "account balance", "number"),
]
PRIMARY = [1, 3, 6, 11, 22, 26]
FOREIGN = [(5, 1), (8, 3), (12, 6), (17, 11), (18, 22), (19, 26), (28, 3)]

# The question of an order in words both engines read.
QUESTION = """concat('list the ', case o_orderkey % 5 when 0 then 'total price' when 1 then 'market segment' when 2 then 'order' when 3 then 'account balance'
  else 'name' end, ' and ', case o_orderkey % 3 when 0 then 'customer' when 1 then 'part' else 'order priority' end, ' of each ',
  case o_orderkey % 4 when 0 then 'customer' when 1 then 'orders' when 2 then 'line item' else 'line' end, ' with ', lower(substring(o_orderpriority, 3, 20)),
  ' above ', cast(o_orderkey % 50 as string), ' or ', lower(o_orderstatus))"""

_values = lambda rows: "values " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
b.add_cte("dbs", f"select 'db' || c_custkey::varchar as db_id, 3 + {b.n_sql(5, 9, 'tables', 'c_custkey')} as n from customer")
b.add_cte("star_tab", f"select * from ({_values(list(enumerate(TABLES)))}) v(tab_id, name)")
b.add_cte("star_col", f"select * from ({_values([(i, *c) for i, c in enumerate(COLUMNS)])}) v(col_id, tab_id, name, type)")
b.add_cte("star_fk", f"select * from ({_values([(i, *c) for i, c in enumerate(FOREIGN)])}) v(fk_no, from_col, to_col)")
b.add_cte("star_pk", f"select * from ({_values([(c,) for c in PRIMARY])}) v(col_id)")
b.add_cte("db_tab", "select db_id, tab_id, name from dbs join star_tab on tab_id < n", "dbs", "star_tab")
b.add_cte("db_col", "select db_id, col_id, tab_id, name, type from dbs join star_col on tab_id < n", "dbs", "star_col")
b.add_cte(
    "db_fk",
    """select db_id, fk_no, from_col, to_col, x.tab_id as from_tab, y.tab_id as to_tab from dbs join star_fk on true
    join star_col x on x.col_id = from_col join star_col y on y.col_id = to_col where x.tab_id < n and y.tab_id < n""",
    "dbs", "star_fk", "star_col",
)
b.add_cte("asked", f"select o_orderkey as item_id, 'db' || o_custkey::varchar as db_id, string_split({QUESTION}, ' ') as toks from orders")
b.add_cte(
    "db_cell",
    """select db_id, col_id, cell from (select 'db' || c_custkey::varchar as db_id, 10 as col_id, c_mktsegment as cell from customer
       union all select 'db' || o_custkey::varchar, 13, o_orderstatus from orders
       union all select 'db' || o_custkey::varchar, 16, replace(o_orderpriority, '-', ' ') from orders) join dbs using (db_id) join star_col using (col_id) where tab_id < n""",
    "dbs", "star_col",
)


def raw_schemas(t):
    """One row per database in the shape of the schema file."""
    n = F.col("n")
    tabs = b.strings(TABLES)
    cols = F.array(*[F.array(F.lit(str(x[0])), F.lit(x[1])) for x in COLUMNS])
    n_cols = F.element_at(F.create_map(*[F.lit(v) for k in range(1, 8) for v in (k, sum(c[0] < k for c in COLUMNS))]), n)
    fks = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in FOREIGN])
    base = t.customer.select(
        F.concat(F.lit("db"), F.col("c_custkey").cast("string")).alias("db_id"), (pick_number(5, 9, "tables", "c_custkey") + 3).alias("n")
    ).withColumn("nc", n_cols)
    nc = F.col("nc")
    kept = F.slice(cols, 1, nc)
    return base.select(
        "db_id", F.slice(tabs, 1, n).alias("table_names"), F.transform(F.slice(tabs, 1, n), lambda x: F.replace(x, F.lit(" "), F.lit("_"))).alias("table_names_original"),
        kept.alias("column_names"), F.transform(kept, lambda c: F.array(F.get(c, F.lit(0)), F.replace(F.get(c, F.lit(1)), F.lit(" "), F.lit("_")))).alias("column_names_original"),
        F.slice(b.strings([c[2] for c in COLUMNS]), 1, nc).alias("column_types"),
        F.filter(F.array(*[F.lit(p) for p in PRIMARY]), lambda p: p < nc).alias("primary_keys"),
        F.filter(fks, lambda k: (F.get(k, F.lit(0)) < nc) & (F.get(k, F.lit(1)) < nc)).alias("foreign_keys"),
    )


def schemas(t):
    return rd.split_schemas(raw_schemas(t))


def asked(t):
    return t.orders.select(
        F.col("o_orderkey").alias("item_id"), F.concat(F.lit("db"), F.col("o_custkey").cast("string")).alias("db_id"), F.split(F.expr(QUESTION), " ").alias("toks")
    )


def cells(t):
    columns = schemas(t)["columns"].select("db_id", "col_id")
    db = lambda c: F.concat(F.lit("db"), F.col(c).cast("string")).alias("db_id")
    found = t.customer.select(db("c_custkey"), F.lit(10).alias("col_id"), F.col("c_mktsegment").alias("cell"))
    found = found.unionByName(t.orders.select(db("o_custkey"), F.lit(13).alias("col_id"), F.col("o_orderstatus").alias("cell")))
    found = found.unionByName(t.orders.select(db("o_custkey"), F.lit(16).alias("col_id"), F.replace("o_orderpriority", F.lit("-"), F.lit(" ")).alias("cell")))
    return found.join(columns.hint("merge"), ["db_id", "col_id"])


def links(t):
    s = schemas(t)
    return lk.all_links(asked(t), s["columns"], s["tables"], cells(t))


@query(
    "s4_db_schemas",
    b.using("db_tab", "db_col", "db_fk", "dbs", "star_pk") + """select db_id, (select count(*) from db_tab x where x.db_id = d.db_id) as tabs, (select count(*) from db_col x where x.db_id = d.db_id) as cols,
      (select count(*) from db_fk x where x.db_id = d.db_id) as fks, (select count(*) from db_col x join star_pk using (col_id) where x.db_id = d.db_id) as pks from dbs d""",
)
def s4_db_schemas(t):
    s = schemas(t)
    count = lambda k, n: s[k].groupBy("db_id").agg(F.count(F.lit(1)).alias(n))
    out = count("tables", "tabs").join(count("columns", "cols"), "db_id").join(count("foreign_keys", "fks"), "db_id", "left")
    return out.join(count("primary_keys", "pks"), "db_id", "left").na.fill(0, ["fks", "pks"])


@query("s4_db_columns", b.using("db_col") + "select db_id, col_id, tab_id, replace(name, ' ', '_') as original, type from db_col")
def s4_db_columns(t):
    return schemas(t)["columns"].select("db_id", "col_id", "tab_id", "original", "type")


@query("j2_question_schema", b.using("asked", "db_tab") + "select item_id, tab_id, name from asked join db_tab using (db_id) where list_contains(toks, name)")
def j2_question_schema(t):
    return asked(t).join(schemas(t)["tables"], "db_id").filter(F.array_contains("toks", F.col("name"))).select("item_id", "tab_id", "name")


b.add_cte(
    "gram",
    "select item_id, db_id, i as first, n, array_to_string(toks[i + 1:i + n], ' ') as gram from asked, unnest(range(len(toks))) as r(i), unnest([1, 2, 3, 4, 5]) as s(n) where i + n <= len(toks)",
    "asked",
)
_STOP = b.sql_list(lk.STOP_WORDS + lk.PUNCTUATION)


def _link_sql(names, key, exact, partial):
    hit = f"(gram = name or (name[:length(gram) + 1] = gram || ' ' and not list_contains({_STOP}, gram)))"
    return f"""select item_id, (first + k)::int as q_id, {key}, case when bool_or(gram = name) then '{exact}' else '{partial}' end as link
      from gram join {names} using (db_id), unnest(range(n)) as u(k) where {hit} group by all"""


b.add_cte("col_link", _link_sql("(select * from db_col where col_id > 0)", "col_id", "CEM", "CPM"), "gram", "db_col")
b.add_cte("tab_link", _link_sql("db_tab", "tab_id", "TEM", "TPM"), "gram", "db_tab")
b.add_cte("word", f"select item_id, db_id, (i)::int as q_id, toks[i + 1] as word from asked, unnest(range(len(toks))) as r(i) where not list_contains({_STOP}, toks[i + 1])", "asked")
b.add_cte("num_link", "select item_id, q_id, col_id, upper(type) as link from word join db_col using (db_id) where regexp_matches(word, '^[0-9]+$') and type in ('number', 'time') and col_id > 0", "word", "db_col")
b.add_cte(
    "cell_link",
    """select distinct item_id, q_id, col_id, 'CELLMATCH' as link from word join db_cell using (db_id) where not regexp_matches(word, '^[0-9]+$')
       and (cell ilike word or cell ilike word || ' %' or cell ilike '% ' || word or cell ilike '% ' || word || ' %')""",
    "word", "db_cell",
)
b.add_cte(
    "all_link",
    """select item_id, q_id, kind, target, arg_min(link, rk) as link from (select item_id, q_id, 'column' as kind, col_id as target, link, 0 as rk from col_link
       union all select item_id, q_id, 'column', col_id, link, 1 from cell_link union all select item_id, q_id, 'column', col_id, link, 2 from num_link
       union all select item_id, q_id, 'table', tab_id, link, 0 from tab_link) group by item_id, q_id, kind, target""",
    "col_link", "tab_link", "num_link", "cell_link",
)


@query("j4_exact_links", b.using("col_link", "tab_link") + "select item_id, q_id, col_id as target, link from col_link where link = 'CEM' union all select item_id, q_id, tab_id, link from tab_link where link = 'TEM'")
def j4_exact_links(t):
    s = schemas(t)
    return lk.exact_links(asked(t), lk.schema_names(s["columns"], s["tables"])).drop("kind")


@query("j5_partial_links", b.using("col_link", "tab_link") + "select item_id, q_id, col_id as target, link from col_link where link = 'CPM' union all select item_id, q_id, tab_id, link from tab_link where link = 'TPM'")
def j5_partial_links(t):
    s = schemas(t)
    return lk.name_links(asked(t), lk.schema_names(s["columns"], s["tables"])).filter("link in ('CPM', 'TPM')").drop("kind")


@query("j6_number_links", b.using("num_link") + "select * from num_link")
def j6_number_links(t):
    return lk.number_links(asked(t), schemas(t)["columns"])


@query("j7_cell_links", b.using("cell_link") + "select * from cell_link")
def j7_cell_links(t):
    return lk.cell_links(asked(t), cells(t))


_OWN = "case when p.col_id is not null then 'primary_key' else 'table_match' end"


@query(
    "j15_relations",
    b.using("asked", "all_link", "db_tab", "db_col", "db_fk", "star_pk") + f""", s as (
      select db_id, 'column' as i_kind, col_id as i, 'column' as j_kind, col_id as j, 'cc_dist 0' as relation from db_col
      union all select db_id, 'table', tab_id, 'table', tab_id, 'tt_dist 0' from db_tab
      union all select db_id, 'column', from_col, 'column', to_col, 'cc_foreign_key_forward' from db_fk
      union all select db_id, 'column', to_col, 'column', from_col, 'cc_foreign_key_backward' from db_fk
      union all select db_id, 'column', from_col, 'table', to_tab, 'ct_foreign_key' from db_fk
      union all select db_id, 'table', to_tab, 'column', from_col, 'tc_foreign_key' from db_fk
      union all select db_id, 'column', col_id, 'table', tab_id, 'ct_' || {_OWN} from db_col left join star_pk p using (col_id) where tab_id >= 0
      union all select db_id, 'table', tab_id, 'column', col_id, 'tc_' || {_OWN} from db_col left join star_pk p using (col_id) where tab_id >= 0
      union all select db_id, 'column', 0, 'table', tab_id, 'ct_any_table' from db_tab
      union all select db_id, 'table', tab_id, 'column', 0, 'tc_any_table' from db_tab
      union all select db_id, 'table', from_tab, 'table', to_tab, 'tt_foreign_key_forward' from db_fk
      union all select db_id, 'table', to_tab, 'table', from_tab, 'tt_foreign_key_backward' from db_fk),
      r as (select item_id, 'question' as i_kind, i::int as i, 'question' as j_kind, (i + d)::int as j, 'qq_dist ' || d::varchar as relation
        from asked, unnest(range(len(toks))) as x(i), unnest([-1, 0, 1]) as y(d) where i + d >= 0 and i + d < len(toks)
      union all select item_id, 'question', q_id, kind, target, 'q' || kind[1] || link from all_link
      union all select item_id, kind, target, 'question', q_id, kind[1] || 'q' || link from all_link
      union all select item_id, i_kind, i, j_kind, j, relation from asked join s using (db_id))
      select relation, i_kind, j_kind, count(*) as n, sum((item_id * 31 + i * 7 + j) % 1000003)::bigint as mark from r group by relation, i_kind, j_kind""",
)
def j15_relations(t):
    rel = lk.relations(asked(t), raw_schemas(t), links(t))
    mark = F.sum((F.col("item_id") * 31 + F.col("i") * 7 + F.col("j")) % 1000003)
    return rel.groupBy("relation", "i_kind", "j_kind").agg(F.count(F.lit(1)).alias("n"), mark.alias("mark"))


@query(
    "j16_table_shapes",
    b.using("db_tab", "db_col", "db_fk") + """select t.db_id, t.tab_id, t.name, min(col_id)::int as first_col, count(*) as n_cols, string_agg(col_id::varchar, ',' order by col_id) as cols,
       (select string_agg(to_tab::varchar, ',' order by to_tab) from (select distinct to_tab from db_fk f where f.db_id = t.db_id and f.from_tab = t.tab_id)) as fk_tables
       from db_tab t join db_col c on c.db_id = t.db_id and c.tab_id = t.tab_id group by t.db_id, t.tab_id, t.name""",
)
def j16_table_shapes(t):
    s = schemas(t)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    out = sm.table_shapes(s["columns"], s["tables"], s["foreign_keys"])
    return out.select("db_id", "tab_id", "name", "first_col", "n_cols", text("cols").alias("cols"), text("fk_tables").alias("fk_tables"))


_REP = [(1, 1), (5, 1), (3, 3), (8, 3), (28, 3), (6, 6), (12, 6), (11, 11), (17, 11), (22, 18), (18, 18), (19, 19), (26, 19)]


@query(
    "a12_key_map",
    b.using("db_fk") + f""", rep as (select * from ({_values(_REP)}) v(col_id, first_col)), used as (select distinct db_id, c as col_id from (
      select db_id, from_col as c from db_fk union all select db_id, to_col from db_fk)) select db_id, col_id, first_col from used join rep using (col_id)""",
)
def a12_key_map(t):
    return sm.key_map(raw_schemas(t))


b.add_cte("edge", "select db_id, from_tab as a, to_tab as b, from_col as a_col, to_col as b_col from db_fk union all select db_id, to_tab, from_tab, to_col, from_col from db_fk", "db_fk")
_WALK = """walk as (select db_id, 0 as tab, [0] as path from dbs union all select w.db_id, e.b, list_append(w.path, e.b) from walk w join edge e on e.db_id = w.db_id and e.a = w.tab
   where not list_contains(w.path, e.b) and len(w.path) < 8)"""


@query(
    "j9_key_paths",
    b.using("edge", "dbs").replace("with ", "with recursive ", 1) + f", {_WALK} select db_id, tab as target, array_to_string(arg_min(path, (len(path), path)), '-') as path from walk group by db_id, tab",
)
def j9_key_paths(t):
    s = schemas(t)
    edges = sm.edges_of(s["foreign_keys"], s["columns"])
    walked = edges.select("db_id", F.explode(sm.shortest_paths(F.col("edges"), F.lit(0))).alias("w"))
    return walked.select("db_id", F.col("w.table").alias("target"), F.array_join(F.transform("w.path", lambda x: x.cast("string")), "-").alias("path"))


def used_tables(t):
    """Each order uses the customer table and one drawn table of the database."""
    drawn = pick_number(3, 10, "used", "o_orderkey")
    return t.orders.select(
        F.col("o_orderkey").alias("item_id"), F.concat(F.lit("db"), F.col("o_custkey").cast("string")).alias("db_id"), F.array(F.lit(0), drawn).alias("used")
    )


_USED = f"""used as (select o_orderkey as item_id, 'db' || o_custkey::varchar as db_id, {b.n_sql(3, 10, 'used', 'o_orderkey')} as x from orders)"""


@query(
    "j10_complete_from",
    f"""with {_USED} select item_id, case x when 0 then '0' when 1 then '0,1' else '0,1,2' end as tables,
      case x when 0 then '' when 1 then '1=5' else '1=5,3=8' end as conds from used""",
)
def j10_complete_from(t):
    s = schemas(t)
    made = sm.complete_from(used_tables(t), sm.edges_of(s["foreign_keys"], s["columns"]))
    conds = F.transform("conds", lambda c: F.concat_ws("=", c.a_col.cast("string"), c.b_col.cast("string")))
    return made.select("item_id", F.array_join(F.transform("tables", lambda x: x.cast("string")), ",").alias("tables"), F.array_join(conds, ",").alias("conds"))


@query(
    "f15_valid_from",
    f"""with {_USED} select item_id, case when item_id % 4 = 1 then false when item_id % 4 = 2 then false when item_id % 4 = 3 then x = 0 else true end as valid from used""",
)
def f15_valid_from(t):
    """Predictions: right ones, ones with a repeated table, with a column of a missing table, without keys."""
    preds = _predicted_from(used_tables(t), F.col("item_id") % 4).select("item_id", "db_id", "tables", "columns", "key_columns")
    return sm.valid_from(preds, _all_columns(t), _edges(t)).select("item_id", "valid")


def _predicted_from(used, kind):
    x = F.array_max("used")
    path = F.sequence(F.lit(0), x)
    keys = F.flatten(F.slice(F.array(F.array(F.lit(1), F.lit(5)), F.array(F.lit(3), F.lit(8))), 1, x))
    return used.select(
        "*", F.when(kind == 1, F.concat(path, F.array(F.lit(0)))).otherwise(path).alias("tables"),
        F.when(kind == 2, F.array(F.lit(26))).otherwise(F.array(F.lit(0), F.lit(2))).alias("columns"),
        F.when(kind == 3, F.expr("cast(array() as array<int>)")).otherwise(keys).alias("key_columns"),
    )


def _edges(t):
    s = schemas(t)
    return sm.edges_of(s["foreign_keys"], s["columns"])


def _all_columns(t):
    return t.customer.select(F.concat(F.lit("db"), F.col("c_custkey").cast("string")).alias("db_id")).select(
        "db_id", F.posexplode(F.array(*[F.lit(c[0]) for c in COLUMNS])).alias("col_id", "tab_id")
    )


_CAND = b.u_sql(19, "beam", "cand")


@query(
    "k7_by_from",
    f"""with {_USED}, cands as (select item_id, item_id * 4 + k as cand, kind != 1 and kind != 2 and (kind != 3 or x = 0) as valid from (
         select item_id, x, k, case when item_id % 5 = 0 and k in (0, 3) then 1 else k end as kind from used, unnest(range(4)) as r(k)))
       select item_id, cand, place from (select *, row_number() over (partition by item_id order by {_CAND} desc, cand) as place from (
         select *, max(valid::int) over (partition by item_id) as some_valid from cands) where valid or some_valid = 0) where place <= 2""",
)
def k7_by_from(t):
    """Four candidates an item, of the kinds of F15; every fifth item has none that holds."""
    from ..functions.seeded import unit
    from ..operators import ranking as rk

    four = used_tables(t).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    kind = F.when((F.col("item_id") % 5 == 0) & F.col("k").isin(0, 3), 1).otherwise(F.col("k"))
    cands = _predicted_from(four, kind).withColumn("cand", F.col("item_id") * 4 + F.col("k")).withColumn("score", unit(19, "beam", "cand"))
    return rk.rerank_by_from(cands, _all_columns(t), _edges(t), "item_id", "cand", 2).select("item_id", "cand", "place")


@query(
    "x14_item_records",
    b.using("asked", "all_link", "db_tab", "db_col") + """select item_id, case when item_id % 10 = 0 then 'val' else 'train' end as section, array_to_string(toks, ' ') as question,
      (select string_agg(name, '|' order by col_id) from db_col c where c.db_id = a.db_id) as columns, (select string_agg(name, '|' order by tab_id) from db_tab c where c.db_id = a.db_id) as tables,
      (select count(*) from all_link l where l.item_id = a.item_id) as n_links from asked a""",
)
def x14_item_records(t):
    section = F.when(F.col("item_id") % 10 == 0, "val").otherwise("train")
    rec = lk.item_records(asked(t), raw_schemas(t), links(t), section)
    return rec.select(
        "item_id", "section", F.array_join("question", " ").alias("question"), F.array_join("columns", "|").alias("columns"),
        F.array_join("tables", "|").alias("tables"), F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("n_links"),
    )


@query(
    "x15_links_to_pieces",
    b.using("asked", "all_link") + """select item_id, kind, target, link, (coalesce(list_sum([ceil(length(w) / 3.0)::int for w in toks[1:q_id]]), 0))::int as piece_no
       from all_link join asked using (item_id)""",
)
def x15_links_to_pieces(t):
    from ..operators import features as ft

    def pieces(w):
        return F.transform(F.regexp_extract_all(w, F.lit("(.{1,3})"), 1), lambda p, i: F.when(i > 0, F.concat(F.lit("##"), p)).otherwise(p))

    words = ft.words_of_pieces(asked(t).select("item_id", F.flatten(F.transform("toks", pieces)).alias("pieces")), "item_id", "pieces")
    return ft.links_to_pieces(links(t).withColumnRenamed("q_id", "word_no"), words, "item_id").select("item_id", "kind", "target", "link", "piece_no")


@query(
    "a15_database_summary",
    b.using("db_tab", "db_col") + """select t.db_id, string_agg(name, '|' order by name) as names, count(*) as tabs, (select count(*) from db_col c where c.db_id = t.db_id and c.tab_id >= 0) as cols
       from db_tab t group by t.db_id""",
)
def a15_database_summary(t):
    s = schemas(t)
    cols = s["columns"].filter("tab_id >= 0").groupBy("db_id").agg(F.count(F.lit(1)).alias("cols"))
    return sm.member_summary(s["tables"], "db_id", "name", "names", "tabs").join(cols, "db_id")
