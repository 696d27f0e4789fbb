"""Labelled question/SQL examples made from tables and templates.

Order of a run: ``group_tables`` -> ``add_key_column`` -> ``sample_counts`` ->
``draw_templates`` -> ``fill_slots`` -> ``verbalise`` -> ``label_examples`` ->
``frequency_ids`` -> ``finalise_examples``. Everything up to the labels is narrow
after one join with the templates; the label counts are the only other shuffle.

Templates are a resource of bounded size: template_id, pattern, constraints,
count, questions array<struct<text, constraints>>.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from ..functions.names import first_words
from ..functions.seeded import pick_item, pick_number, unit
from ..functions.textforms import fill_slots as replace_slots, fill_sql
from ..session import stored_rows
from .filters import capped_columns, for_one_table, unique_columns, within_budget
from .ordered import numbered_in_order, running_number

# Chances and ranges of the draws.
ADD_KEY, KEY_IS_NAME = 0.7, 0.3
OP_IS_EQUAL, USE_SECOND, USE_SECOND_ALONE, LIMIT_ONE = 0.4, 0.5, 0.6, 0.5
MOST_COLUMNS, MOST_TOKENS, FIRST_COLUMNS = 25, 150, 41
OPERATORS = ["=", ">", "<", ">=", "<=", "!=", "LIKE"]
COUNT_OPERATORS = [">", "<", ">=", "<=", "="]
ORDERED_OPERATORS = [">", "<", ">=", "<="]
AGGREGATES = ["MAX", "MIN", "SUM", "AVG"]
DIRECTIONS = ["ASC", "DESC"]

# Slot values and column rules that a constraint sets.
SET_SLOTS = {
    "P0==": {"{OP0}": "="}, "P1==": {"{OP1}": "="}, "P0=P1==": {"{OP0}": "=", "{OP1}": "="},
    "P0=P1=P2==": {"{OP0}": "=", "{OP1}": "=", "{OP2}": "="}, "P0=>": {"{OP0}": ">"}, "P0=<": {"{OP0}": "<"},
    "{AGG0}=MIN": {"{AGG0}": "MIN"}, "{AGG0}=MAX": {"{AGG0}": "MAX"},
}
SET_COLUMNS = {
    "C0-id": {"{COLUMN0}": "id"}, "C1-id": {"{COLUMN1}": "id"}, "C2-id": {"{COLUMN2}": "id"}, "C3-T1": {"{COLUMN3}": "T1"},
    "T0-T1-JOIN": {"{COLUMN0}": "T0", "{COLUMN1}": "T1"}, "T0-T1-NO-JOIN": {"{COLUMN0}": "T0", "{COLUMN1}": "T1"},
}



def _list(items):
    return F.array(*[F.lit(i) for i in items])


# ---- databases -------------------------------------------------------------------------------


def group_tables(tables: DataFrame, key: str, seed, most_columns: int = MOST_COLUMNS) -> DataFrame:
    """Databases of one or two tables: db_id, tables array<struct<key, name, cols>>.

    Tables are numbered in key order; two neighbours become one database with chance one
    half, if they have few enough columns and no column name twice; no table is lost. The
    tables are stored first: cutting them into ranges makes them twice.
    """
    numbered = running_number(stored_rows(tables), [], key, "__no").withColumn("pair", F.floor((F.col("__no") - 1) / 2))
    item = F.struct(key, "name", "cols")
    both = numbered.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("__no", item.alias("t")))).alias("ts"))
    both = both.withColumn("ts", F.transform("ts", lambda x: x.t))
    names = F.flatten(F.transform("ts", lambda x: F.transform(x.cols, lambda c: c["name"])))
    joined = (F.size("ts") == 2) & (unit(seed, "pair", "pair") < 0.5) & (F.size(names) <= most_columns) & unique_columns(names)
    alone = F.transform("ts", lambda x: F.array(x))
    groups = both.withColumn("g", F.explode(F.when(joined, F.array(F.col("ts"))).otherwise(alone)))
    return groups.select(F.get("g", F.lit(0))[key].alias("db_id"), F.col("g").alias("tables"))


def add_key_column(dbs: DataFrame, key: str, seed) -> DataFrame:
    """Two-table databases: a table gets, with chance 0.7, an ``id`` (or, 0.3 of these, ``name``) column at place 1."""
    def widened(t):
        is_name = unit(seed, "key name", t[key].cast("string")) < KEY_IS_NAME
        word = F.when(is_name, "name").otherwise("id")
        prefix = F.replace(t["name"], F.lit(" "), F.lit("_"))
        extra = F.struct(
            F.lit(1).alias("pos"), F.concat(prefix, F.lit(" "), word).alias("name"), word.alias("original"), F.lit("text").alias("type"),
            F.when(is_name, "value").otherwise("1").alias("value"),
        )
        longer = F.concat(F.slice(t.cols, 1, 1), F.array(extra), F.transform(F.slice(t.cols, 2, F.size(t.cols)), lambda c: c.withField("pos", c.pos + 1)))
        add = (unit(seed, "add key", t[key].cast("string")) < ADD_KEY) & ~F.exists(t.cols, lambda c: c["name"] == extra["name"])
        return t.withField("cols", F.when(add, longer).otherwise(t.cols))

    return dbs.withColumn("tables", F.when(F.size("tables") == 2, F.transform("tables", widened)).otherwise(F.col("tables")))


def sample_counts(dbs: DataFrame, size: int, seed) -> DataFrame:
    """Adds n, the examples of each database: size over the number of databases, its fraction by chance."""
    per = F.lit(float(size)) / dbs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return dbs.withColumn("__per", per).withColumn(
        "n", (F.floor("__per") + (unit(seed, "count", "db_id") < F.col("__per") - F.floor("__per")).cast("int")).cast("int")
    ).drop("__per")


# ---- templates -----------------------------------------------------------------------------------


def analyse_patterns(templates: DataFrame) -> DataFrame:
    """Adds slots, column rules, operators, values, aggregates and the direction flag of each pattern.

    slots array<string>; columns array<string>; rules array<struct<col, rule>> with rule
    ``number`` or a value slot; ops array<struct<op, col, value>>; values
    array<struct<slot, kind>>; aggs array<string>; dasc boolean.
    """
    has = lambda w, s: F.contains(w, F.lit(s))

    def parts(v):
        tk = v.tk

        def at(i):
            return F.coalesce(F.get(tk, i), F.lit(""))

        def op_col(i):
            return F.when(has(at(i - 1), "COLUMN"), at(i - 1)).when((at(i - 1) == ")") & (has(at(i - 2), "COLUMN") | (at(i - 2) == "*")), at(i - 2))

        ops = F.filter(
            F.transform(tk, lambda w, i: F.struct(w.alias("op"), op_col(i).alias("col"), F.when(has(at(i + 1), "VALUE"), at(i + 1)).alias("value"))),
            lambda o: has(o.op, "OP") & ~has(o.op, "AGG") & ~has(o.op, "COLUMN") & o.col.isNotNull(),
        )

        def rest(u):
            free = lambda w: has(w, "VALUE") & ~F.array_contains(u.taken, w)
            number = F.transform(
                tk,
                lambda w, i: F.when(has(w, "AGG") & (at(i + 1) == "(") & has(at(i + 2), "COLUMN"), F.struct(at(i + 2).alias("col"), F.lit("number").alias("rule")))
                .when(free(w) & (at(i - 1) == "BETWEEN"), F.struct(at(i - 2).alias("col"), F.lit("number").alias("rule")))
                .when(free(w) & (at(i - 1) == "="), F.struct(at(i - 2).alias("col"), w.alias("rule"))),
            )
            kind = F.transform(
                tk,
                lambda w, i: F.when(
                    free(w), F.when(at(i - 1).isin("BETWEEN", "AND"), F.struct(w.alias("slot"), F.lit("number").alias("kind")))
                    .when(at(i - 1) == "LIMIT", F.struct(w.alias("slot"), F.lit("integer").alias("kind"))),
                ),
            )
            known = lambda x: x.isNotNull()
            return F.struct(
                F.array_distinct(F.filter(tk, lambda w: has(w, "{") & has(w, "}") & ~has(w, "FROM"))).alias("slots"),
                F.array_distinct(F.filter(tk, lambda w: has(w, "COLUMN"))).alias("columns"), F.filter(number, known).alias("rules"), u.ops.alias("ops"),
                F.array_distinct(F.filter(kind, known)).alias("values"), F.array_distinct(F.filter(tk, lambda w: has(w, "AGG"))).alias("aggs"),
                F.exists(tk, lambda w: has(w, "DASC")).alias("dasc"),
            )

        return let(lambda u: let(rest, ops=u.ops, taken=F.transform(F.filter(u.ops, lambda o: o.value.isNotNull()), lambda o: o.value)), ops=ops)

    made = templates.withColumn("__a", let(parts, tk=F.split("pattern", " ")))
    return made.select(*templates.columns, "__a.*")


def question_slots(text: Column) -> Column:
    has = lambda w, s: F.contains(w, F.lit(s))
    return F.array_distinct(F.filter(F.split(F.trim(text), " "), lambda w: has(w, "TABLE") | has(w, "SC") | (has(w, "{") & has(w, "}"))))


def constraint_effects(rules: Column) -> Column:
    """struct<slots map<string,string>, columns array<struct<col, rule>>, two_tables boolean>."""
    def entries(table, a, b):
        rows = [F.struct(F.lit(name).alias("c"), F.lit(k).alias(a), F.lit(v).alias(b)) for name, m in table.items() for k, v in m.items()]
        hit = F.filter(F.array(*rows), lambda r: F.array_contains(rules, r.c))
        return F.array_distinct(F.transform(hit, lambda r: F.struct(r[a].alias(a), r[b].alias(b))))

    return F.struct(
        F.map_from_entries(entries(SET_SLOTS, "key", "value")).alias("slots"), entries(SET_COLUMNS, "col", "rule").alias("columns"),
        F.exists(rules, lambda r: r.isin(list(SET_COLUMNS))).alias("two_tables"),
    )


def label_columns(pattern: Column) -> Column:
    """Label of each column slot (and ``*``) of a pattern: map<string,string>.

    A label names the nesting, the clause, and the aggregate, operator, direction and
    limit; places of one column are joined in order.
    """
    text = pattern
    for old, new in (("GROUP BY", "GROUP_BY"), ("ORDER BY", "ORDER_BY"), ("NOT IN", "NOT_IN")):
        text = F.replace(text, F.lit(old), F.lit(new))
    clauses, nests = ["WHERE", "GROUP_BY", "HAVING", "ORDER_BY", "SELECT"], ["EXCEPT", "UNION", "INTERSECT"]

    def labels(v):
        tk = v.tk

        def at(i):
            return F.coalesce(F.get(tk, i), F.lit(""))

        def label(w, i):
            def of(u):
                clause, last = u.clause, at(i - 1)
                nest = F.when(F.size(u.seen) > 0, F.array_join(u.seen, " ")).when(u.selects > 1, "OP_SEL").otherwise("")
                direction = lambda j: F.when(at(j) == "{DASC}", "{DASC}").otherwise("ASC")
                limit = lambda j: F.when((at(j) == "LIMIT") | ((at(j) == "{DASC}") & (at(j + 1) == "LIMIT")), "LIMIT").otherwise("")
                tail = (
                    F.when((clause == "SELECT") & (last == "("), at(i - 2)).when(clause == "SELECT", "")
                    .when((clause == "WHERE") & ((last == "OR") | (at(i + 3) == "OR")), F.concat(F.lit("OR "), at(i + 1)))
                    .when(clause == "WHERE", at(i + 1)).when(clause == "GROUP_BY", "")
                    .when(clause == "HAVING", F.concat_ws(" ", at(i - 2), at(i + 2)))
                    .when(last == "(", F.concat_ws(" ", at(i - 2), direction(i + 2), limit(i + 2)))
                    .otherwise(F.concat_ws(" ", direction(i + 1), limit(i + 1)))
                )
                return F.struct(w.alias("col"), F.trim(F.concat_ws(" ", F.trim(F.concat_ws(" ", nest, clause)), tail)).alias("label"))

            def parts(u):
                return let(
                    of, clause=F.element_at(F.filter(u.before, lambda x: x.isin(clauses)), -1), seen=F.filter(u.before, lambda x: x.isin(nests)),
                    selects=F.size(F.filter(u.before, lambda x: x == "SELECT")),
                )

            return let(parts, before=F.slice(tk, 1, i + 1))

        is_column = lambda w: F.contains(w, F.lit("COLUMN")) | (w == "*")
        found = F.filter(F.transform(tk, lambda w, i: F.when(is_column(w), label(w, i))), lambda x: x.isNotNull())

        def merged(u):
            cols = F.array_distinct(F.transform(u.found, lambda x: x.col))
            return F.map_from_entries(
                F.transform(cols, lambda c: F.struct(c.alias("key"), F.array_join(F.transform(F.filter(u.found, lambda x: x.col == c), lambda x: x.label), " ").alias("value")))
            )

        return let(merged, found=found)

    return let(labels, tk=F.split(text, " "))


def prepare_templates(templates: DataFrame) -> DataFrame:
    """Analysed templates with labels and their places in the list of all and of one-table templates."""
    ready = analyse_patterns(templates).withColumn("labels", label_columns(F.col("pattern")))
    one = for_one_table(templates).select("template_id", F.col("questions").alias("one_questions"))
    both = ready.join(one, "template_id", "left")
    single = numbered_in_order(both.filter("one_questions is not null").select("template_id"), ["template_id"], "one_at")
    return numbered_in_order(both, ["template_id"], "all_at").join(single, "template_id", "left")


def draw_templates(dbs: DataFrame, prepared: DataFrame, seed) -> DataFrame:
    """One row per sample with its template and question: db_id, sample_no, tables, and the template's parts.

    Two-table databases draw from all templates, the others from the one-table ones.
    ``prepared`` is the template list; Spark sends a small one to all tasks and splits the
    large keys of a longer one.
    """
    n_all = prepared.agg(F.max("all_at").alias("n")).scalar()
    n_one = prepared.agg(F.max("one_at").alias("n")).scalar()
    samples = dbs.filter("n > 0").withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    u = unit(seed, "template", "db_id", "sample_no")
    two = F.size("tables") > 1
    drawn = samples.withColumn("__list", F.when(two, 0).otherwise(1)).withColumn(
        "__at", (F.floor(u * F.when(two, n_all).otherwise(n_one)) + 1).cast("int")
    )
    parts = ["template_id", "pattern", "constraints", "slots", "columns", "rules", "ops", "values", "aggs", "dasc", "labels"]
    listed = prepared.select(F.lit(0).alias("__list"), F.col("all_at").cast("int").alias("__at"), F.col("questions").alias("__qs"), *parts)
    listed = listed.unionByName(
        prepared.filter("one_at is not null").select(F.lit(1).alias("__list"), F.col("one_at").cast("int").alias("__at"), F.col("one_questions").alias("__qs"), *parts)
    )
    joined = drawn.join(listed, ["__list", "__at"])
    question = pick_item(F.col("__qs"), seed, "question", "db_id", "sample_no")
    return joined.withColumn("__q", question).select(
        "db_id", "sample_no", "tables", *parts, F.col("__q.text").alias("question"),
        F.array_distinct(F.concat("constraints", "__q.constraints")).alias("all_rules"),
    )


# ---- slot values -----------------------------------------------------------------------------------


def fill_slots(drawn: DataFrame, seed, id_rule: str = "first") -> DataFrame:
    """Adds values map<string,string> of all slots, t0, t1, use_second, number (of LIMIT) and the label flags.

    ``id_rule``: a column with the id rule is the ``first`` offered one, or the first
    ``named`` like an id or a name. A number rule takes the last real column that is not
    the first; a column without a fitting one is drawn.
    """
    key = ("db_id", "sample_no")
    u = lambda draw, *more: unit(seed, draw, *key, *more)
    has = lambda a, x: F.array_contains(a, F.lit(x))

    df = drawn.withColumn("fx", constraint_effects(F.col("all_rules"))).withColumn("q_slots", question_slots(F.col("question")))

    def set_op(o):
        fixed = F.col("fx.slots")[o.op]
        star = pick_item(_list(COUNT_OPERATORS), seed, "count op", *key, o.op)
        plain = F.when(u("equal", o.op) < OP_IS_EQUAL, "=").otherwise(pick_item(_list(OPERATORS), seed, "op", *key, o.op))
        value = F.when(fixed.isNull() & (o.col == "*") & o.value.isNotNull(), (pick_number(10, seed, "having", *key, o.op) + 1).cast("string"))
        chosen = F.coalesce(fixed, F.when(o.col == "*", star).otherwise(plain))
        return F.struct(
            o.op.alias("op"), o.col.alias("col"), o.value.alias("value"), chosen.alias("chosen"), value.alias("number"),
            (fixed.isNull() & (o.col != "*") & chosen.isin(ORDERED_OPERATORS)).alias("ordered"),
        )

    df = df.withColumn("set_ops", F.transform("ops", set_op))
    rule = lambda c, r: F.struct(c.alias("col"), r.alias("rule"))
    from_ops = F.concat(
        F.transform(F.filter("set_ops", lambda o: o.ordered), lambda o: rule(o.col, F.lit("number"))),
        F.transform(F.filter("set_ops", lambda o: o.value.isNotNull() & (o.col != "*")), lambda o: rule(o.col, o.value)),
    )
    df = df.withColumn("col_rules", F.concat("rules", "fx.columns", from_ops))

    two = F.size("tables") > 1
    swap = two & (u("swap") < 0.5)
    ask0, ask1, has0, has1 = has(F.col("q_slots"), "{TABLE0}"), has(F.col("q_slots"), "{TABLE1}"), has(F.col("columns"), "{COLUMN0}"), has(F.col("columns"), "{COLUMN1}")
    chance = F.when(ask1 & ~ask0, USE_SECOND_ALONE).otherwise(USE_SECOND)
    df = (
        df.withColumn("t0", F.get("tables", F.when(swap, 1).otherwise(0))).withColumn("t1", F.get("tables", F.when(two & ~swap, 1).otherwise(0)))
        .withColumn("use_second", two & (u("second") < chance))
        .withColumn("star0", has0 | ask0).withColumn("star1", two & (ask1 | (F.col("use_second") & has1)))
    )

    def offered(t):
        return F.slice(F.col(t).cols, 2, F.size(F.col(t).cols))

    def choose(slot, inputs):
        """The column taken for one slot from the offered ones; NULL where the template lacks the slot."""
        rules = F.transform(F.filter("col_rules", lambda r: r.col == slot), lambda r: r.rule)

        def pick(v):
            later = F.slice(v.ins, 2, F.greatest(F.size(v.ins) - 1, F.lit(0)))
            drawn_one = pick_item(F.when(F.size(later) > 0, later).otherwise(v.ins), seed, "column " + slot, *key)
            real = F.filter(later, lambda c: c.type == "real")
            numeric = F.when(F.size(real) > 0, F.element_at(real, -1))
            first = F.get(v.ins, F.lit(0))
            if id_rule == "named":
                first = F.coalesce(F.get(F.filter(v.ins, lambda c: F.contains(c["name"], F.lit("id")) | F.contains(c["name"], F.lit("name"))), F.lit(0)), first)
            return F.when(has(v.rules, "id"), first).when(has(v.rules, "number"), F.coalesce(numeric, drawn_one)).otherwise(drawn_one)

        return F.when(has(F.col("columns"), slot), let(pick, ins=inputs, rules=rules))

    def without(inputs, chosen, least):
        return F.when(chosen.isNotNull() & (F.size(inputs) > least), F.filter(inputs, lambda c: c["name"] != chosen["name"])).otherwise(inputs)

    df = df.withColumn("in0", offered("t0")).withColumn("c0", choose("{COLUMN0}", F.col("in0")))
    df = df.withColumn("in1", F.when(F.col("use_second"), offered("t1")).otherwise(without(F.col("in0"), F.col("c0"), 2)))
    df = df.withColumn("c1", choose("{COLUMN1}", F.col("in1")))
    df = df.withColumn("in2", without(F.col("in1"), F.col("c1"), 3)).withColumn("c2", choose("{COLUMN2}", F.col("in2")))
    df = df.withColumn("in3", without(F.col("in2"), F.col("c2"), 2)).withColumn("c3", choose("{COLUMN3}", F.col("in3")))

    limit = F.when(u("limit one") < LIMIT_ONE, 1).otherwise(pick_number(9, seed, "limit", *key) + 2)
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    col_entries = F.filter(
        F.array(*[F.struct(F.lit(f"{{COLUMN{i}}}").alias("slot"), F.col(f"c{i}").alias("c")) for i in range(4)]), lambda x: x.c.isNotNull()
    )
    df = df.withColumn("chosen", col_entries).withColumn("number", F.when(F.exists("values", lambda x: x.kind == "integer"), limit).otherwise(1))

    def cell_of(r):
        hit = F.get(F.filter("chosen", lambda x: x.slot == r.col), F.lit(0))
        return entry(r.rule, hit.c.value)

    all_entries = F.concat(
        F.map_entries("fx.slots"),
        F.transform("set_ops", lambda o: entry(o.op, o.chosen)),
        F.transform(F.filter("set_ops", lambda o: o.number.isNotNull()), lambda o: entry(o.value, o.number)),
        F.transform("chosen", lambda x: entry(x.slot, x.c["name"])),
        F.transform(F.filter("col_rules", lambda r: F.contains(r.rule, F.lit("VALUE"))), cell_of),
        F.transform("aggs", lambda a: entry(a, F.coalesce(F.col("fx.slots")[a], pick_item(_list(AGGREGATES), seed, "agg", *key, a)))),
        F.transform("values", lambda x: entry(x.slot, F.when(x.kind == "integer", F.col("number").cast("string")).otherwise(pick_number(101, seed, "value", *key, x.slot).cast("string")))),
        F.when(F.col("dasc"), F.array(entry(F.lit("{DASC}"), pick_item(_list(DIRECTIONS), seed, "direction", *key)))).otherwise(
            F.expr("cast(array() as array<struct<key:string,value:string>>)")
        ),
    )
    last = let(
        lambda v: F.map_from_entries(F.filter(v.e, lambda x, i: ~F.exists(F.slice(v.e, i + 2, F.size(v.e)), lambda y: y.key == x.key))), e=all_entries
    )
    kept = [c for c in drawn.columns if c not in ("values",)]
    return df.withColumn("filled", last).select(
        *kept, "q_slots", F.col("filled").alias("values"), "t0", "t1", "use_second", "star0", "star1", "number",
    )


def verbalise(filled: DataFrame, phrases: DataFrame, seed) -> DataFrame:
    """Adds the question text and the SQL text. Phrases: component, key, phrases.

    The slots that are said by a phrase are exploded and meet the phrases by (component, key)
    in a join; each draws its own. A phrase book of any size is on no row and in no task whole.
    ``filled`` is stored, as slots and texts are made from it: give it no more columns than are
    needed after. Its stored size does not tell that of the slots, so they are merged back, and are
    the left side of an outer join with the phrases, which is never sent to all tasks.
    """
    filled = stored_rows(filled)
    key = ["db_id", "sample_no"]
    value = F.col("values")
    direction = value[F.lit("{DASC}")]
    numbered = F.when(F.col("number") > 1, F.concat(direction, F.lit("_NUM"))).otherwise(direction)
    has = lambda w, s: F.contains(w, F.lit(s))

    def source(s):
        """Component and key of the phrases of a slot; NULL for a slot that is said by its value."""
        of = lambda component, k: F.struct(s.alias("slot"), F.lit(component).alias("component"), k.alias("key"))
        more = F.replace(s, F.lit("SC_COL_COUNT_LIMIT"), F.lit(""))
        return (
            F.when(s.isin("{TABLE0}", "{TABLE1}"), F.lit(None)).when(s == "SC", of("SC", direction)).when(s == "SC_COL_LIMIT", of("SC_COL_LIMIT", numbered))
            .when(has(s, "SC_COL_COUNT_LIMIT"), of("SC_COL_COUNT_LIMIT", F.concat(numbered, more))).when(has(s, "SC"), of("SC_COL", direction))
            .when(has(s, "OP"), of("OP", value[s])).when(has(s, "AGG"), of("AGG", value[s]))
        )

    asked = F.array_compact(F.transform(F.array_distinct("q_slots"), source))
    slots = filled.select(*key, F.explode(asked).alias("s")).select(*key, "s.slot", "s.component", F.col("s.key").alias("key"))
    drawn = pick_item(F.col("phrases"), seed, "phrase", *key, "slot")
    said = slots.join(phrases, ["component", "key"], "left").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("slot", drawn.alias("said")))).alias("said"))

    def word(s):
        by_column = F.when(has(s, "C1"), value[F.lit("{COLUMN1}")]).when(has(s, "C2"), value[F.lit("{COLUMN2}")])
        phrase = F.col("said")[s]
        return (
            F.when(s == "{TABLE0}", F.col("t0.name")).when(s == "{TABLE1}", F.col("t1.name")).when(s == "SC", phrase)
            .when((s == "SC_COL_LIMIT") | has(s, "SC_COL_COUNT_LIMIT"), F.replace(phrase, F.lit("[NUM]"), F.col("number").cast("string")))
            .when(has(s, "SC"), F.replace(phrase, F.lit("[COL]"), by_column)).when(has(s, "OP") | has(s, "AGG"), phrase)
            .when(has(s, "COLUMN"), first_words(value[s], 5, start=2)).when(has(s, "VALUE"), first_words(value[s], 5))
        )

    made = filled.join(said.hint("merge"), key, "left")
    words = F.map_from_entries(F.transform("q_slots", lambda s: F.struct(s.alias("key"), F.coalesce(word(s), F.lit("")).alias("value"))))
    made = made.withColumn("q_words", words)
    return made.withColumn("question_text", replace_slots(F.col("question"), F.col("q_words"))).withColumn("sql_text", fill_sql(F.col("pattern"), value)).drop("said", "q_words")


def label_examples(spoken: DataFrame) -> DataFrame:
    """Adds example_labels map<column name, label>: labels of the drawn columns, and SELECT for the ``*`` column of used tables.

    Where two slots took the same column the later label counts.
    """
    value = F.col("values")
    drawn = F.transform(
        F.map_entries("labels"),
        lambda e: F.struct(F.when(e.key == "*", e.key).otherwise(value[e.key]).alias("key"), replace_slots(e.value, value).alias("value")),
    )
    star = lambda flag, t: F.when(F.col(flag), F.array(F.struct(F.get(F.col(t).cols, F.lit(0))["name"].alias("key"), F.lit("SELECT").alias("value"))))
    none = F.expr("cast(array() as array<struct<key:string,value:string>>)")
    entries = F.concat(drawn, F.coalesce(star("star0", "t0"), none), F.coalesce(star("star1", "t1"), none))
    last = let(
        lambda v: F.map_from_entries(F.filter(v.e, lambda x, i: ~F.exists(F.slice(v.e, i + 2, F.size(v.e)), lambda y: y.key == x.key))), e=entries
    )
    return spoken.withColumn("example_labels", last)


def keep_last_schema(examples: DataFrame, order: str = "db_id") -> DataFrame:
    """Of databases with equal schema text keep the examples of the last one only."""
    cols = F.flatten(F.transform("tables", lambda t: t.cols))
    text = F.concat_ws(" </s> ", F.transform(cols, lambda c: F.concat_ws("|", c["name"], c.value)))
    keyed = examples.withColumn("__schema", F.sha2(text, 256))
    last = keyed.groupBy("__schema").agg(F.max(order).alias(order))
    return keyed.join(last, ["__schema", order], "left_semi").drop("__schema")


def finalise_examples(labelled: DataFrame, label_ids: DataFrame, n_tokens=None, budget: int = MOST_TOKENS, cut=None) -> DataFrame:
    """Final rows: question, columns, values, column_labels; within the token budget.

    ``label_ids`` (label, label_id) has one row per distinct label and is joined to the
    exploded labels, so it may grow; an example with an unknown label is dropped. The budget
    counts words, or what ``n_tokens`` makes of the text, or the pieces that ``cut`` makes of
    its words (``pieces.by_vocabulary``, ``pieces.by_merges``).
    """
    cols = F.concat(
        F.array(F.struct(F.lit("*").alias("full"), F.lit("*").alias("name"), F.lit("").alias("value"))),
        F.flatten(
            F.transform(
                "tables",
                lambda t: F.transform(t.cols, lambda c: F.struct(c["name"].alias("full"), F.array_join(F.slice(F.split(c["name"], " "), 2, 1000), " ").alias("name"), c.value.alias("value"))),
            )
        ),
    )
    one = labelled.select("db_id", "sample_no", F.explode("example_labels").alias("col", "label"))
    found = one.join(label_ids.select("label", "label_id"), "label", "left")
    ids = found.groupBy("db_id", "sample_no").agg(
        F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("label_id", F.lit(0))))).alias("ids"), F.max(F.col("label_id").isNull()).alias("unknown")
    ).filter(~F.col("unknown"))
    made = labelled.select("db_id", "sample_no", F.lower("question_text").alias("question"), cols.alias("cols")).join(ids, ["db_id", "sample_no"])
    numbered = F.transform("cols", lambda c: F.struct(c["name"].alias("name"), c.value.alias("value"), F.coalesce(F.col("ids")[c.full], F.lit(0)).alias("label")))
    made = made.withColumn("cols", numbered).withColumn("cols", capped_columns(F.col("cols"), "label", FIRST_COLUMNS))
    part = lambda f: F.transform("cols", lambda c: c[f])
    made = made.select("db_id", "sample_no", "question", part("name").alias("columns"), part("value").alias("values"), part("label").alias("column_labels"))
    text = F.concat(F.lit("<s> "), "question", F.lit(" </s> "), F.array_join("columns", " </s> "), F.lit(" </s> "))
    if cut is None:
        count = n_tokens(text) if n_tokens else F.size(F.split(F.trim(text), r"\s+"))
        return made.filter(within_budget(count, budget))
    from .pieces import token_counts

    key = ["db_id", "sample_no"]
    words = made.select(F.struct(*key).alias("k"), F.split(F.trim(text), r"\s+").alias("toks"))
    counted = token_counts(words, "k", "toks", cut).filter(within_budget(F.col("n_tokens"), budget))
    return made.join(counted.select("k.*"), key, "left_semi")


def final_examples(labelled: DataFrame, n_tokens=None, budget: int = MOST_TOKENS, cut=None) -> DataFrame:
    """Label ids over all examples, then the final rows.

    The label counts need all examples before any of them can be written, so the
    examples are written once to the checkpoint folder and read back for both steps.
    """
    from ..session import cut_lineage
    from .vocab import frequency_ids

    rows = cut_lineage(labelled.select("db_id", "sample_no", "tables", "question_text", "example_labels"))
    ids = frequency_ids(rows.select(F.explode(F.map_values("example_labels")).alias("label")), "label")
    return finalise_examples(rows, ids, n_tokens, budget, cut)


def synthesise(tables: DataFrame, key: str, templates: DataFrame, phrases: DataFrame, size: int, seed, budget: int = MOST_TOKENS, cut=None) -> DataFrame:
    """The whole run, from web tables (``key`` of any type, name, cols) to about ``size`` final examples.

    Databases of one or two tables, key columns, the number of examples of each database,
    templates, slot values, texts, labels; of databases with equal schema text the last one
    stays; label ids by frequency and the token budget (``finalise_examples``). Every step
    draws with its own part of the seed.
    """
    dbs = add_key_column(group_tables(tables, key, f"{seed} pairs"), key, f"{seed} keys")
    drawn = draw_templates(sample_counts(dbs, size, f"{seed} counts"), prepare_templates(templates), f"{seed} templates")
    spoken = verbalise(fill_slots(drawn, f"{seed} values"), phrases, f"{seed} words")
    return final_examples(keep_last_schema(label_examples(spoken)), None, budget, cut)
