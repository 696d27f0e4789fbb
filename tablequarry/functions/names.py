"""Table and column names."""

from pyspark.sql import Column, functions as F

from .seeded import unit


def is_name_word(word: Column) -> Column:
    """Longer than one letter, no hyphen, no digit."""
    return (F.length(word) > 1) & ~word.rlike(r"[-\p{Nd}]")


def is_number_text(text: Column) -> Column:
    """Digits only."""
    return text.rlike(r"^\p{Nd}+$")


def first_words(text: Column, n: int, start: int = 1) -> Column:
    """n words from word ``start`` on, words parted by one space."""
    return F.array_join(F.slice(F.split(text, " "), start, n), " ")


def short_header(text: Column) -> Column:
    """A header of ten or more words is cut to five."""
    return F.when(F.size(F.split(text, " ")) < 10, text).otherwise(first_words(text, 5))


def name_from_title(title: Column, seed, *keys, must_have: bool = False) -> Column:
    """The last name word of a title; with chance 0.4 the last two."""
    words = F.split(title, " ")
    good = F.filter(words, is_name_word)
    take = F.when(unit(seed, "title", *keys) < 0.4, 2).otherwise(1)
    last = F.array_join(F.slice(good, F.greatest(F.size(good) - take + 1, F.lit(1)), take), " ")
    if must_have:
        return F.when(last != "", last).otherwise(F.get(words, F.lit(0)))
    return last


def qualify(name: Column, cols: Column, sample: bool = False) -> Column:
    """Prefix all column names with the joined table name and put the ``*`` column first."""
    prefix = F.replace(name, F.lit(" "), F.lit("_"))
    shown = F.transform(cols, lambda c: c.withField("name", F.concat(prefix, F.lit(" "), c["name"])))
    every = F.array(F.lit("all"), F.lit("all"), F.lit("all")) if sample else F.lit("all")
    star = F.struct(
        F.lit(0).alias("pos"), F.concat(prefix, F.lit(" "), name, F.lit(" *")).alias("name"), F.lit("*").alias("original"),
        F.lit("text").alias("type"), every.alias("values" if sample else "value"),
    )
    return F.concat(F.array(star), shown)


def split_original(name: Column) -> Column:
    """Part camel case and underscores of an original name: lower-case words."""
    spaced = F.regexp_replace(name, r"([A-Z]+)", r" $1")
    return F.trim(F.lower(F.replace(spaced, F.lit("_"), F.lit(" "))))
