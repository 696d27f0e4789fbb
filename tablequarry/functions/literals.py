"""Operators, aggregates and literals of slot queries."""

from pyspark.sql import Column, functions as F

# Ids of the aggregates and comparison operators of a slot query.
AGGREGATES = ["", "MAX", "MIN", "COUNT", "SUM", "AVG"]
COMPARISONS = ["=", ">", "<", "OP"]

# Fixed value: the first number of a text; only a decimal may carry a sign.
FIRST_NUMBER = r"([-+]?[0-9]*\.[0-9]+|[0-9]+)"


def name_of(names: list[str], index: Column) -> Column:
    """Name of an id; NULL for an id out of range."""
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def id_of(names: list[str], name: Column) -> Column:
    """Id of a name; NULL for an unknown name."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), name)
    return F.when(at > 0, (at - 1).cast("int"))


def table_key(table_id: Column) -> Column:
    """Storage name of a table: ``table_`` and the id with ``-`` as ``_``."""
    return F.when(table_id.startswith("table"), table_id).otherwise(
        F.concat(F.lit("table_"), F.replace(table_id, F.lit("-"), F.lit("_")))
    )


# Fixed value: a text that is a number as a whole.
NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


def strict_number(text: Column) -> Column:
    """The number that a text is, else NULL; no suffixes, names of numbers or negative zero."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double") + F.lit(0.0))


def literal_number(text: Column) -> Column:
    """A literal as a number: with group commas, else the first number found in it, else NULL."""
    whole = strict_number(F.replace(F.trim(text), F.lit(","), F.lit("")))
    found = F.regexp_extract(text, FIRST_NUMBER, 1)
    return F.coalesce(F.when(F.trim(text).rlike(r"^[-+]?[0-9.,]+$"), whole), strict_number(found))


def leading_number(text: Column) -> Column:
    """The number a text starts with, else 0: how SUM and AVG read a text cell."""
    head = F.regexp_extract(text, r"^\s*([-+]?[0-9]*\.?[0-9]+)", 1)
    return F.coalesce(head.try_cast("double"), F.lit(0.0))
