"""Bounded samples of labelled documents, for the classifiers."""

from pyspark.sql import Column, DataFrame, functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """Labelled texts outside fold ``held``: ``doc_id, text, label``, at most ``most`` of each label.

    The documents of a label with the smallest id hashes are taken, so the sample does not depend
    on the layout of the tables. Rows without id or label are left out; of repeated labels the
    larger one counts, of repeated documents the first text in order.
    """
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    rows = rows.where(remainder(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    kinds = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    chosen = kinds[0].unionByName(kinds[1])  # 2 * most rows of two numbers
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
