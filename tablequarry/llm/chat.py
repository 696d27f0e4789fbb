"""Chat formatting with column expressions only: turn order as a finite-state machine, text segments
with loss flags from a declarative template, and the way back from the formatted text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from .common import table


@dataclass(frozen=True)
class Template:
    """How turns are written.

    ``marks`` gives the strings around the text of a role. A role without marks is written as
    ``other[0] role other[1] text other[2]``. ``loss`` names the roles whose text is learnt.
    ``order`` maps a state and a role to the next state (a state is the last role, ``""`` at the
    start); ``last`` holds the states in which a conversation may end. Inside texts, ``escape`` is
    doubled and put after the first character of every mark, so no mark occurs in an escaped text.
    """

    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    loss: frozenset[str]
    order: dict[tuple[str, str], str]
    last: frozenset[str]
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        every = [m for pair in self.marks.values() for m in pair] + list(self.other)
        object.__setattr__(self, "controls", tuple(dict.fromkeys(every)))
        for a in self.controls:
            if len(a) < 2 or self.escape in a or any(a[:k] == b[-k:] for b in self.controls for k in range(1, len(a)) if k < len(b)):
                raise ValueError(f"mark {a!r} is too short, holds the escape character or may overlap another mark")
            if any(a != b and a in b for b in self.controls):
                raise ValueError(f"mark {a!r} is part of another mark")


INSTRUCT = Template(
    marks={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("[ROLE]", "[SAYS]", "[/SAYS]"),
    loss=frozenset({"assistant"}),
    order={("", "system"): "system", ("", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    last=frozenset({"assistant"}),
)


def escaped(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    found = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in t.controls)
    return F.when(out.rlike(found), F.regexp_replace(out, found, "$0" + re.escape(t.escape))).otherwise(out)


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(t.escape)}(.)", "$1")


def _segment(text: Column, loss: Column | bool) -> Column:
    return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))


def _segments(turn: Column, t: Template) -> Column:
    """The segments of one turn."""
    text = escaped(turn["text"], t)
    other = [F.lit(t.other[0]), escaped(turn["role"], t), F.lit(t.other[1]), text, F.lit(t.other[2])]
    out = F.array(*[_segment(x, False) for x in other])
    for role, (a, b) in t.marks.items():
        parts = F.array(_segment(F.lit(a), False), _segment(text, role in t.loss), _segment(F.lit(b), False))
        out = F.when(turn["role"] == role, parts).otherwise(out)
    return out


def _walk(turns: Column, t: Template) -> Column:
    """The state machine over the roles: last state and the number of the first turn out of order."""
    known = F.create_map(*[x for (s, r), to in t.order.items() for x in (F.lit(f"{s}\n{r}"), F.lit(to))])

    def step(acc, turn):
        to = F.element_at(known, F.concat(acc["state"], F.lit("\n"), turn["role"]))
        bad = F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"])
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), bad.alias("bad"), (acc["at"] + 1).alias("at"))

    start = F.struct(F.lit("").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("at"))
    return F.aggregate(turns, start, step)


def formatted(df: DataFrame, template: Template = INSTRUCT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv, n_turns, segments, formatted, valid, first_bad``.

    ``segments`` are (text, loss) in order, ``formatted`` their texts joined. ``first_bad`` is the
    number (from 0) of the first turn that breaks the turn order, ``valid`` says that none does and
    the conversation may end where it ends; conversations out of order are formatted all the same.
    A null text or role is empty; a null conversation id is one conversation; turns with equal
    numbers (null first) follow by role and text, repeated rows stay. An empty table gives no rows.
    Other columns are not read. A conversation is one row of the result, so it must fit in a task.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    grouped = df.groupBy(F.col(conv).alias("__conv")).agg(F.array_sort(F.collect_list(row)).alias("__turns"))
    made = grouped.select(
        F.col("__conv").alias(conv), F.size("__turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("__turns", lambda x: _segments(x, template))).alias("segments"), _walk(F.col("__turns"), template).alias("__walk"),
    )
    bad = F.col("__walk.bad")
    return made.select(
        conv, "n_turns", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (bad.isNull() & F.col("__walk.state").isin(*template.last)).alias("valid"), bad.alias("first_bad"),
    )


def turns_of(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) of a formatted conversation, read from its marks."""
    t = template
    pairs = [*t.marks.values(), (t.other[0], t.other[2])]
    found = "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in pairs)

    def inner(x, a, b):
        return F.substring(x, F.lit(len(a) + 1), F.length(x) - F.lit(len(a) + len(b)))

    def read(x):
        body = inner(x, t.other[0], t.other[2])
        at = F.instr(body, t.other[1])
        out = F.struct(
            unescaped(F.substring(body, F.lit(1), at - 1), t).alias("role"),
            unescaped(F.substring(body, at + F.lit(len(t.other[1])), F.length(body)), t).alias("text"),
        )
        for role, (a, b) in t.marks.items():
            out = F.when(x.startswith(a), F.struct(F.lit(role).alias("role"), unescaped(inner(x, a, b), t).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(text, F.lit(found), F.lit(0)), read)


def learnt_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss flags, without escapes, in order."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescaped(s["text"], template)), "")


#: A conversation whose texts look like marks.
PROBE = (-1, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])


def query(spark, folder):
    """op8: every conversation and the probe, formatted and read back."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    row = lambda k, role, text: F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
    turns = F.explode(F.array(*[row(k, *said) for k, said in enumerate(PROBE[1])])).alias("r")
    probe = spark.range(1).select(F.lit(PROBE[0]).cast("long").alias("conv_id"), turns).select("conv_id", "r.*")
    made = formatted(given.unionByName(probe))
    said = F.array_join(F.transform(turns_of(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size(turns_of(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        let(lambda x: F.struct(F.length(x["t"]).cast("long").alias("n"), F.sha2(x["t"], 256).alias("h")), t=learnt_text(F.col("segments"))).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_bad",
    ).select("conv_id", "n_turns", "turns_sha256", F.col("loss.n").alias("loss_chars"), F.col("loss.h").alias("loss_sha256"), "formatted_chars", "valid", "first_bad")


def _sql() -> str:
    t = INSTRUCT

    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    def esc(x):
        x = f"replace({x}, {quoted(t.escape)}, {quoted(t.escape * 2)})"
        for c in t.controls:
            x = f"replace({x}, {quoted(c)}, {quoted(c[0] + t.escape + c[1:])})"
        return x

    size = " ".join(f"when {quoted(r)} then {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    rows = " union all ".join(f"select {PROBE[0]}, {k}, {quoted(r)}, {quoted(x)}" for k, (r, x) in enumerate(PROBE[1]))
    state = "lag(role) over (partition by conv_id order by turn, role, text)"
    steps = " or ".join(f"(before = {quoted(s)} and role = {quoted(r)})" for s, r in t.order)
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all {rows}),
walk as (
  select *, coalesce({state}, '') as before, row_number() over (partition by conv_id order by turn, role, text) - 1 as spot,
    row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1 as final
  from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length({esc('text')}) + case role {size} else {sum(map(len, t.other))} + length({esc('role')}) end)::bigint as formatted_chars,
  bool_and({steps}) and bool_or(final and role in ({', '.join(map(quoted, sorted(t.last)))})) as valid,
  min(spot) filter (where not ({steps}))::integer as first_bad
from walk group by conv_id"""


SQL = _sql()
