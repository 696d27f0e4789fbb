"""Question and SQL patterns mined from question/SQL pairs."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.binding import let

# Slot marks of patterns.
VALUE_STR, VALUE_NUM, TABLE, FROM = "{VALUE_STR}", "{VALUE_NUM}", "{TABLE}", "{FROM}"

# Words and marks kept in a pattern; a parameter, here those of the supported query language.
KEYWORDS = [
    "SELECT", "DISTINCT", "FROM", "AS", "JOIN", "ON", "WHERE", "AND", "OR", "NOT", "IN", "LIKE", "BETWEEN", "IS", "NULL", "EXISTS",
    "GROUP", "BY", "HAVING", "ORDER", "ASC", "DESC", "LIMIT", "INTERSECT", "UNION", "EXCEPT", "COUNT", "AVG", "MAX", "MIN", "SUM",
    ",", ".", "(", ")", "=", ">", "<", "<=", ">=", "+", "-", "*", "/", "!",
]

# Words kept in the short and the wider generalisation, and classes of the tuned one.
SHORT_WORDS = ["SELECT", "WHERE", "GROUP", "HAVING", "ORDER", "BY", "LIMIT", "EXCEPT", "UNION", "INTERSECT"]
WIDER_WORDS = SHORT_WORDS + ["DESC", "NOT", "IN", "OR", "LIKE", "(", ">", ")", "COUNT"]
WHERE_OPS = ["=", ">", "<", ">=", "<=", "!=", "LIKE", "IS", "EXISTS"]
AGG_OPS = ["MAX", "MIN", "SUM", "AVG"]
DIRECTIONS = ["ASC", "DESC"]


def quoted_values(query: Column) -> Column:
    """Quoted literals in order."""
    return F.regexp_extract_all(query, F.lit("(\"[^\"]*\"|'[^']*')"), 1)


def mask_literals(query: Column) -> Column:
    """Query tokens with quoted text and numbers as slots; a number after t or T stays."""
    text = F.replace(F.replace(query, F.lit(";"), F.lit("")), F.lit("\t"), F.lit(""))
    text = F.replace(F.replace(text, F.lit("("), F.lit(" ( ")), F.lit(")"), F.lit(" ) "))
    text = F.regexp_replace(text, "\"[^\"]*\"|'[^']*'", r"\{VALUE_STR\}")
    tokens = F.filter(F.split(text, " "), lambda w: w != "")
    return F.transform(tokens, lambda w: F.when(w.rlike(r"^[-+]?[0-9]*\.[0-9]+$|^[^tT]?[0-9]+$"), F.lit(VALUE_NUM)).otherwise(w))


def numbers_of(query: Column) -> Column:
    text = F.replace(F.replace(query, F.lit("("), F.lit(" ( ")), F.lit(")"), F.lit(" ) "))
    bare = F.regexp_replace(text, "\"[^\"]*\"|'[^']*'", "")
    return F.filter(F.split(bare, " "), lambda w: w.rlike(r"^[-+]?[0-9]*\.[0-9]+$|^[0-9]+$"))


def slot_columns(tokens: Column, columns: Column, tables: Column, keywords: list[str] = KEYWORDS) -> Column:
    """Columns as ``{COLUMNi`` by first use, tables as ``{TABLE}``, key words in capitals; other words go."""
    def part(w):
        name = F.lower(F.regexp_replace(F.upper(w), "T[0-9]+\\.|[\"']|T[0-9]+", ""))
        kept = F.upper(w).isin(keywords) | w.isin(VALUE_STR, VALUE_NUM)
        return F.struct(w.alias("w"), kept.alias("kept"), F.when(~kept & F.array_contains(columns, name), name).alias("column"), name.alias("name"))

    def slot(p, used):
        return (
            F.when(p.kept, F.upper(p.w))
            .when(p.column.isNotNull(), F.concat(F.lit("{COLUMN"), (F.array_position(used, p.column) - 1).cast("string")))
            .when(F.array_contains(tables, p["name"]), F.lit(TABLE))
        )

    def slots(v):
        return let(
            lambda u: F.filter(F.transform(u.parts, lambda p: slot(p, u.used)), lambda w: w.isNotNull()),
            parts=v.parts, used=F.array_distinct(F.filter(F.transform(v.parts, lambda p: p.column), lambda c: c.isNotNull())),
        )

    return let(slots, parts=F.transform(tokens, part))


def collapse_from(pattern: Column) -> Column:
    """Each FROM part up to the nearest WHERE, GROUP or ORDER as one mark."""
    return F.regexp_replace(pattern, r"\bFROM\b.*?( WHERE\b| GROUP\b| ORDER\b|$)", r"\{FROM\}$1")


def generalise(pattern: Column, level: str) -> Column:
    """``short``: key words only; ``wider``: more words; ``tuned``: operators, aggregates, directions and values as slots."""
    words = F.split(pattern, " ")
    if level != "tuned":
        kept = SHORT_WORDS if level == "short" else WIDER_WORDS
        return F.array_join(F.filter(words, lambda w: w.isin(kept)), " ")

    def tuned(w, used):
        return (
            F.when(w.startswith("{COLUMN"), F.concat(F.lit("{COLUMN"), (F.array_position(used, w) - 1).cast("string"), F.lit("}")))
            .when(w.startswith("{VALUE"), F.lit("{VALUE}")).when(w.isin(DIRECTIONS), F.lit("{DASC}"))
            .when(w.isin(WHERE_OPS), F.lit("{OP}")).when(w.isin(AGG_OPS), F.lit("{AGG}")).otherwise(w)
        )

    return let(
        lambda v: F.array_join(F.transform(F.filter(v.words, lambda w: w != "DISTINCT"), lambda w: tuned(w, v.used)), " "),
        words=words, used=F.array_distinct(F.filter(words, lambda w: w.startswith("{COLUMN"))),
    )


def singular(word: Column) -> Column:
    """Lower case without a plural ending."""
    return F.regexp_replace(F.lower(word), "(?<=[a-z]{2}[^s])s$", "")


def question_template(question: Column, values: Column, numbers: Column, column_words: Column) -> Column:
    """Literals as slots at word bounds, words that name a column as ``{COLUMN}``."""
    def swap(text, literal, mark):
        return F.regexp_replace(text, F.concat(F.lit(r"\b\Q"), F.lower(literal), F.lit(r"\E\b")), F.lit(mark))

    bare = F.transform(values, lambda v: F.regexp_replace(v, "[\"']", ""))
    text = F.aggregate(F.filter(bare, lambda v: v != ""), F.lower(question), lambda t, v: swap(t, v, r"\{VALUE_STR\}"))
    text = F.aggregate(numbers, text, lambda t, n: swap(t, n, r"\{VALUE_NUM\}"))
    return F.array_join(
        F.transform(F.split(text, " "), lambda w: F.when(F.array_contains(column_words, singular(w)), F.lit("{COLUMN}")).otherwise(w)), " "
    )


def pattern_counts(df: DataFrame, pattern: str, sub_pattern: str) -> DataFrame:
    """Members per pattern and per sub-pattern inside it, most frequent patterns first.

    The members themselves stay in ``df``; a pattern may hold a third of all rows, so
    its members are never gathered in one list.
    """
    inner = df.groupBy(pattern, sub_pattern).agg(F.count(F.lit(1)).alias("sub_count"))
    return inner.select(pattern, F.sum("sub_count").over(Window.partitionBy(pattern)).alias("count"), sub_pattern, "sub_count")
