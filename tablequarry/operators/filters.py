"""Filters on examples and templates, and counters of a job."""

from pyspark.sql import Column, DataFrame, functions as F


def valid_example(header: Column, words: Column, vocabulary: Column) -> Column:
    """No empty header, headers unique in lower case, every word in the vocabulary."""
    low = F.transform(header, F.lower)
    return (
        (F.size(header) > 0) & ~F.exists(header, lambda h: F.trim(h) == "")
        & (F.size(F.array_distinct(low)) == F.size(low)) & (F.size(F.array_except(words, vocabulary)) == 0)
    )


def usable(failed: Column) -> Column:
    return ~F.coalesce(failed, F.lit(False))


def within_budget(n_tokens: Column, budget: int) -> Column:
    return n_tokens <= budget


def wide_table(name: Column, n_columns: Column) -> Column:
    """Name of two or more letters and three or more columns."""
    return (F.length(name) >= 2) & (n_columns >= 3)


def unique_columns(names: Column) -> Column:
    return F.size(F.array_distinct(names)) == F.size(names)


def for_one_table(templates: DataFrame) -> DataFrame:
    """Templates usable on one table: no rule on ids or a second table, questions without TABLE1."""
    def second(rule):
        return F.contains(rule, F.lit("id")) | F.contains(rule, F.lit("T1"))

    kept = templates.filter(~F.exists("constraints", second)).withColumn(
        "questions", F.filter("questions", lambda q: ~F.contains(q.text, F.lit("TABLE1")))
    )
    return kept.filter(F.size("questions") > 0)


def capped_columns(cols: Column, label: str, first: int = 41) -> Column:
    """The first 41 kept columns, later ones only with a label."""
    counted = F.aggregate(
        cols, F.struct(F.lit(0).alias("n"), F.slice(cols, 1, 0).alias("kept")),
        lambda s, c: F.struct(
            F.when((s.n >= first) & (c[label] == 0), s.n).otherwise(s.n + 1).alias("n"),
            F.when((s.n >= first) & (c[label] == 0), s.kept).otherwise(F.concat(s.kept, F.array(c))).alias("kept"),
        ),
        lambda s: s.kept,
    )
    return counted


def known_labels(examples: DataFrame, label_map: DataFrame, labels: str = "labels") -> DataFrame:
    """Drop examples with a label that is not in the label map."""
    one = examples.select("example_id", F.explode(F.map_values(labels)).alias("label"))
    unknown = one.join(label_map.select("label"), "label", "left_anti").select("example_id")
    return examples.join(unknown, "example_id", "left_anti")


def job_counters(df: DataFrame, n_tokens: Column, budget: int, n_columns: Column, label: Column) -> DataFrame:
    """Lines seen, kept and skipped by the token budget, most columns, distinct labels."""
    kept = within_budget(n_tokens, budget)
    return df.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"),
        F.max(n_columns).alias("max_columns"), F.countDistinct(label).alias("labels"),
    )
