"""Secret scan over a trigram index, with column expressions only.

Every rule is a regular expression. What trigrams a text must hold for a rule to match is derived
from the expression: a Boolean query of trigrams, without upper case. The index holds the postings
(trigram, document) of the trigrams that the rules ask for; the postings of a document meet in one
group, where each rule's query is tested. Only texts that pass are searched with the expression
itself. A rule without mandatory trigrams searches every text.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as code
from re import _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from .common import stored, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of one of its groups in a match that counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either(word: str) -> str:
    """A word with ASCII letters in either case, as an expression."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
# The base rules. Runs of one class are maximal, so their least length can stand in the expression.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public token formats.
RULES = BASE + (
    Rule("github", r"gh[opsru]_[A-Za-z0-9]{36}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"[Bb]earer\x20[A-Za-z0-9+/_.=-]{20,}"),
    Rule("private", r"-----BEGIN\x20(?:[A-Z]+\x20)?PRIVATE\x20KEY-----"),
    Rule("url", r"://[A-Za-z0-9_.-]{1,64}:[^\x20\x09-\x0D/:@]{6,128}@"),
)
#: Strings that an expression can match at one place are listed up to so many.
STRINGS = 64
#: Matches whose places are added up in one go.
BLOCK = 256


# ---- trigram queries ---------------------------------------------------------------------


def _letters(members) -> set[str] | None:
    """The ASCII characters of a class, lower-cased; None for one with others, or with more than eight."""
    out = set()
    for op, arg in members:
        low, high = arg if op is code.RANGE else (arg, arg) if op is code.LITERAL else (0, 128)
        if high > 127:
            return None
        out |= {chr(c).lower() for c in range(low, high + 1)}
    return out if len(out) <= 8 else None


def _needs(strings: set[str]) -> frozenset | None:
    """One of these strings stands in the text: sets of trigrams of which one must be whole; None if that says nothing."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in sets else frozenset(s for s in sets if not any(o < s for o in sets))


def _walk(items) -> tuple[set[str] | None, list[frozenset]]:
    """The strings that a sequence can match, None if they cannot be listed, and what it needs of a text."""
    strings, clauses, whole = {""}, [], True

    def gap():
        nonlocal strings, whole
        clauses.append(_needs(strings))
        strings, whole = {""}, False

    def then(more: set[str] | None):
        nonlocal strings
        if more is None:
            gap()
        else:
            if len(strings) * len(more) > STRINGS:
                gap()
            strings = {a + b for a, b in itertools.product(strings, more)} if len(more) <= STRINGS else strings

    for op, arg in items:
        if op is code.LITERAL:
            then(_letters([(op, arg)]))
        elif op is code.IN:
            then(_letters(arg))
        elif op in (code.AT, code.ASSERT, code.ASSERT_NOT):
            continue
        elif op is code.SUBPATTERN:
            inner, found = _walk(arg[-1])
            clauses += found
            then(inner)
        elif op is code.BRANCH:
            arms = [_walk(arm)[0] for arm in arg[1]]
            then(None if None in arms else set().union(*arms))
        elif op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
            least, most, body = arg
            inner, found = _walk(body)
            if least:
                clauses += found
            if (least, most) == (0, 1) and inner is not None:
                then(inner | {""})
            else:
                for _ in range(min(least, 3)):
                    then(inner)
                if (least, most) not in ((1, 1), (2, 2), (3, 3)):
                    gap()
        else:
            gap()
    clauses.append(_needs(strings))
    return strings if whole else None, [c for c in clauses if c is not None]


def trigram_query(pattern: str) -> list[frozenset]:
    """What every text that the expression matches holds, as clauses that all hold.

    A clause is a set of sets of trigrams, of which at least one set is in the text, upper case
    aside. An empty list means that the expression has no mandatory trigrams.
    """
    clauses = set(_walk(parser.parse(pattern))[1])
    return sorted((c for c in clauses), key=lambda c: sorted(map(sorted, c)))


def trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for way in clause for t in way})


# ---- index -------------------------------------------------------------------------------


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, the text (null: empty) and a key of both: rows with one key get one answer, so it may be shared."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__key", F.xxhash64(id_col, "__text"))


def index(docs: DataFrame, wanted: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of the wanted trigrams, ``trigram, key``, in order of trigrams inside each part."""
    low = _keyed(docs, id_col, text_col).select("__key", F.lower("__text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select(F.explode(held).alias("trigram"), F.col("__key").alias("key")).sortWithinPartitions("trigram")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Documents that hold the mandatory trigrams of a rule: ``key`` and the numbers of these rules as bits.

    Rules without mandatory trigrams are not looked up.
    """
    asked = trigrams(rules)
    place = {t: divmod(k, 62) for k, t in enumerate(asked)}
    number = F.create_map(*[x for k, t in enumerate(asked) for x in (F.lit(t), F.lit(k))])
    words = len(asked) // 62 + 1

    def bits(w):
        return F.bit_or(F.when(F.floor(F.col("t") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("t") % 62).cast("int"))).otherwise(0))

    def holds(way):
        test = F.lit(True)
        for w in range(words):
            mask = sum(1 << place[t][1] for t in way if place[t][0] == w)
            if mask:
                test = test & (F.col(f"w{w}").bitwiseAND(F.lit(mask).cast("long")) == mask)
        return test

    def passes(rule):
        test = F.lit(True)
        for clause in trigram_query(rule.pattern):
            some = F.lit(False)
            for way in sorted(clause, key=sorted):
                some = some | holds(way)
            test = test & some
        return test

    met = postings.where(F.col("trigram").isin(*asked)).select("key", F.element_at(number, F.col("trigram")).alias("t"))
    met = met.groupBy("key").agg(*[bits(w).alias(f"w{w}") for w in range(words)])
    found = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            found = found + F.when(passes(rule), 1 << k).otherwise(0)
    return met.select("key", found.alias("rules")).where("rules <> 0")


# ---- verification ------------------------------------------------------------------------


def running(values: Column) -> Column:
    """Running sums of an array of whole numbers, in blocks, so that a long array is not copied for each item."""
    def added(block):
        start = F.struct(F.lit(0).cast("long").alias("total"), F.expr("cast(array() as array<bigint>)").alias("all"))
        return F.aggregate(block, start, lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.array_append(acc["all"], acc["total"] + x).alias("all")))

    def joined(blocks):
        start = F.struct(F.lit(0).cast("long").alias("total"), F.expr("cast(array() as array<array<bigint>>)").alias("all"))
        moved = F.aggregate(blocks, start, lambda acc, b: F.struct((acc["total"] + b["total"]).alias("total"), F.array_append(acc["all"], F.transform(b["all"], lambda v: v + acc["total"])).alias("all")))
        return F.flatten(moved["all"])

    count = F.floor((F.size(values) - 1) / F.lit(BLOCK)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    return joined(F.transform(cut, added))


_NONE = "cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """All spans of a rule: leftmost matches without overlap, less those with too short a group."""
    def all_matches(b):
        gaps = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s).cast("long"))
        sizes = F.transform(b["m"], lambda m: F.length(m).cast("long"))
        ways = let(lambda c: F.transform(c["m"], lambda n, i: F.get(c["g"], i) + n), g=gaps, m=sizes)
        ends = let(lambda c: F.arrays_zip(running(c["w"]).alias("end"), c["m"].alias("size")), w=ways, m=sizes)
        spans = F.transform(ends, lambda z: F.struct((z["end"] - z["size"]).alias("start"), F.lit(kind).alias("kind"), z["end"].alias("end")))
        if rule.least:
            group = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
            spans = let(lambda c: F.filter(c["s"], lambda _, i: F.get(c["ok"], i)), s=spans, ok=group)
        return F.when(F.size(b["m"]) > 0, spans).otherwise(F.expr(_NONE))

    return let(all_matches, m=F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The spans of secrets of every row: ``id_col, found``, an array of (start, kind, end) in this order.

    Places are code points, the end is exclusive, the kind is the number of the rule. A null or empty
    text has no spans; repeated rows are scanned one by one; an empty table gives no rows; other
    columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    looked = [k for k, r in enumerate(rules) if trigram_query(r.pattern)]
    if looked:
        posted = stored(index(docs, trigrams(rules), id_col, text_col))
        keyed = keyed.join(stored(candidates(posted, rules)).withColumnRenamed("key", "__key"), "__key", "left")
    asked = F.coalesce(F.col("rules"), F.lit(0)) if looked else F.lit(0)
    found = [F.when(asked.bitwiseAND(F.lit(1 << k).cast("long")) != 0, _spans(F.col("__text"), r, k)).otherwise(F.expr(_NONE)) if k in looked else _spans(F.col("__text"), r, k) for k, r in enumerate(rules)]
    return keyed.select(id_col, F.array_sort(F.concat(*found)).alias("found"))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def query(spark, folder):
    """op11: secrets of every document; counts and digest of the base rules, spans of all rules."""
    found = scan(table(spark, folder, "documents"))

    def number(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    def quoted(pattern):
        return "'" + pattern.replace("'", "''") + "'"

    rows = " union all ".join(
        f"select d, {k} as k, '{r.kind}' as kind, {r.least} as least, regexp_extract_all(t, {quoted(r.pattern)}, 0) as m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) as g, string_split_regex(t, {quoted(r.pattern)}) as s from doc"
        for k, r in enumerate(RULES)
    )
    base = ", ".join(f"count(*) filter (where k = {k}) as n_{r.kind}" for k, r in enumerate(BASE))
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in BASE)
    return f"""
with doc as (select row_number() over () as d, doc_id, coalesce(text, '') as t from documents),
hit as ({rows}),
spot as (select d, k, kind, least, m, g, s, unnest(range(1, len(m) + 1)) as i from hit),
span as (
  select d, k, kind, list_sum(list_transform(s[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::bigint as start, length(m[i]) as size
  from spot where length(g[i]) >= least),
part as (
  select d, {base}, string_agg(concat(kind, ':', start, ':', start + size), ',' order by start, k) as spans,
    string_agg(concat(kind, ':', start, ':', start + size), ',' order by start, k) filter (where k < {len(BASE)}) as base_spans
  from span group by d)
select doc_id, {zero}, sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans from doc left join part using (d)"""


SQL = _sql()
