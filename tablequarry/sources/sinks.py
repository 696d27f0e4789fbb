"""Sinks: line forms as columns, and writers for them."""

from pyspark.sql import Column, DataFrame, functions as F


def caption_line(question: Column, columns: Column, labels: Column) -> Column:
    """``<s> question </s> col </s> ... </s>  ||| label label ...`` on one line."""
    numbers = F.array_join(F.transform(labels, lambda x: x.cast("string")), " ")
    text = F.concat(F.lit("<s> "), question, F.lit(" </s> "), F.trim(F.array_join(columns, " </s> ")), F.lit(" </s>  ||| "), numbers)
    return F.replace(F.trim(text), F.lit("\n"), F.lit(""))


def three_lines(columns: Column, question: Column, sql: Column) -> Column:
    """Columns, question and SQL on three lower-case lines."""
    return F.lower(
        F.concat_ws(
            "\n", F.concat(F.lit("COLUMNS: "), F.array_join(columns, " | ")), F.concat(F.lit("QUESTION: "), question), F.concat(F.lit("SQL: "), sql)
        )
    )


def example_line(question: Column, columns: Column, values: Column, labels: Column) -> Column:
    return F.to_json(
        F.struct(question.alias("question"), columns.alias("columns"), F.array(values).alias("rows"), labels.alias("column_labels"))
    )


def prediction_line(sel: Column, agg: Column, conds: Column, table_id: Column) -> Column:
    """One prediction as JSON; conditions are three-item lists of mixed type."""
    def listed(c):
        value = F.regexp_replace(F.to_json(F.struct(c.val.alias("v"))), r'^\{"v":(.*)\}$', "$1")
        return F.concat(F.lit("["), c.col.cast("string"), F.lit(","), c.op.cast("string"), F.lit(","), value, F.lit("]"))

    return F.concat(
        F.lit('{"query":{"sel":'), sel.cast("string"), F.lit(',"agg":'), agg.cast("string"), F.lit(',"conds":['),
        F.array_join(F.transform(conds, listed), ","), F.lit(']},"table_id":"'), table_id, F.lit('"}'),
    )


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_examples(examples: DataFrame, path: str) -> None:
    examples.select("question", "columns", F.array("values").alias("rows"), "column_labels").write.mode("overwrite").json(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Ids, words and, where present, counts."""
    vocab.write.mode("overwrite").json(path)


def write_sections(records: DataFrame, path: str, section: str = "section") -> None:
    records.write.mode("overwrite").partitionBy(section).json(path)


def write_rows(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Store table rows; an existing table stays unless it is to be replaced."""
    rows.write.mode("overwrite" if replace else "ignore").parquet(path)
