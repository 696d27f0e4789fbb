"""Literals found again in question tokens, and value tokens merged back to text."""

from pyspark.sql import Column, functions as F

from ..functions.binding import let


def find_tokens(tokens: Column, wanted: Column) -> Column:
    """First place (from 0) where ``wanted`` stands in ``tokens``; NULL if nowhere."""
    places = F.filter(
        F.sequence(F.lit(0), F.size(tokens) - 1),
        lambda i: F.slice(tokens, i + 1, F.size(wanted)) == wanted,
    )
    return F.when((F.size(wanted) > 0) & (F.size(wanted) <= F.size(tokens)), F.get(places, F.lit(0)))


def value_spans(tokens: Column, conds: Column) -> Column:
    """Per condition the first and last token place of its literal in the question."""

    def span(v, c):
        found = lambda u: let(
            lambda w: F.struct(w.first.alias("first"), (w.first + F.size(u.words) - 1).alias("last")), first=find_tokens(v.tokens, u.words)
        )
        return let(found, words=F.split(F.lower(c.val), " "))

    return let(lambda v: F.transform(conds, lambda c: span(v, c)), tokens=tokens)


# Bracket and quote marks of tokenised text, and the letters that may be spaced.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "``": '"', "''": '"', "-lrb-": "(", "-rrb-": ")", "-lsb-": "[", "-rsb-": "]"}
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789$"
NO_SPACE_AFTER = ["(", "/", "–", "#", "$", "&"]


def merge_tokens(tokens: Column, question: Column) -> Column:
    """Join value tokens to text; the question tells where spaces belong.

    Where the question does not show the pair, a quote opens or closes, marks take no
    space before them and words take one unless an opening mark stands before them.
    """
    marks = F.create_map(*[F.lit(x) for pair in BRACKETS.items() for x in pair])
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("open"))
    plain = F.transform(F.filter(tokens, lambda x: x.isNotNull() & (x != "")), F.lower)

    def step(state, raw, asked):
        word = F.coalesce(marks[raw], raw)
        opened = F.when(word == '"', ~state.open).otherwise(state.open)
        last = F.right(state.text, F.lit(1))
        space = (
            F.when(F.length(state.text) == 0, False)
            .when(F.contains(asked, F.concat(state.text, F.lit(" "), word)), True)
            .when(F.contains(asked, F.concat(state.text, word)), False)
            .when(word == '"', opened)
            .when(F.instr(F.lit(LETTERS), F.left(word, F.lit(1))) == 0, False)
            .otherwise(~last.isin(NO_SPACE_AFTER) & ((last != '"') | ~opened))
        )
        joined = F.concat(state.text, F.when(space, F.lit(" ")).otherwise(F.lit("")), word)
        return F.struct(joined.alias("text"), opened.alias("open"))

    return let(lambda v: F.aggregate(plain, start, lambda s, raw: step(s, raw, v.asked), lambda s: F.trim(s.text)), asked=F.lower(question))
