"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL updates."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .bpe import span_hashes
from .common import mixed, table, text_blocks, tidied
from .labelled import remainder, sample

#: Hash space of the features: 2 to this power weights (1 MB).
BITS = 18
#: Most labelled documents of each class that the model is fitted on.
SAMPLE = 3_000
#: Fixed training parameters of the FTRL updates.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.1, 2
THRESHOLD = 0.3

# Letters, digits and other marks make words of their own.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs of some texts, and the text of each.

    A word is a run of letters, digits or other marks; case counts. Any word that follows itself
    gives one and the same pair.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = _KIND[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    edge = np.flatnonzero(new)
    ends = np.append(edge[1:], len(raw))
    word = kind[edge] > 0
    starts, ends = edge[word], ends[word]
    h = span_hashes(raw, starts, ends)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    of = np.searchsorted(begins, starts, "right") - 1
    with np.errstate(over="ignore"):
        pairs = np.where(h[:-1] == h[1:], np.uint64(0), mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]))
    inside = of[:-1] == of[1:]
    index = np.concatenate([h, pairs[inside]]) & np.uint64((1 << BITS) - 1)
    return index.astype(np.int64), np.concatenate([of, of[:-1][inside]])


def train(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias, by follow-the-regularised-leader updates, one document at a time."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    l1 = np.full(size, L1)
    l1[-1] = 0.0

    def weights(at):
        return np.where(np.abs(z[at]) <= l1[at], 0.0, -(z[at] - np.sign(z[at]) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rows = []
    for t in texts:
        index, count = np.unique(features([t])[0], return_counts=True)
        value = count / np.sqrt(max(count.sum(), 1))
        rows.append((np.append(index, size - 1), np.append(value, 1.0)))
    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, labels):
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, most: int = SAMPLE) -> bytes:
    """A model of ``label`` from at most ``2 * most`` labelled documents outside fold ``held``.

    The sample is bounded, so one task fits it; it runs in the order of the id hashes. Without
    labelled rows all weights are 0 and every score is 0.5.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(h=mixed(pdf["doc_id"].to_numpy().astype(np.int64).view(np.uint64))).sort_values(["h", "doc_id"])
        texts = [(t or "").encode("utf-8", "replace") for t in pdf["text"]]
        return pd.DataFrame({"model": [train(texts, pdf["label"].to_numpy(np.float64)).tobytes()]})

    rows = sample(documents, labels, label, folds, held, most).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else np.zeros((1 << BITS) + 1, np.float32).tobytes()


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Chance of label 1: the sparse dot product of a text's feature counts and the weights."""
    index, of = features(texts)
    n = np.bincount(of, minlength=len(texts))
    dot = np.bincount(of, weights[index], len(texts)) / np.sqrt(np.maximum(n, 1)) + weights[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35)))


def score(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every whole text, one row for each row.

    A null or empty text has no features and gets the score of the bias; repeated rows are scored
    one by one; an empty table gives no rows; other columns are not read. The model is 1 MB and
    goes to the executors as a broadcast variable.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    @tidied
    def run(batches):
        weights = np.frombuffer(sent.value, np.float32).astype(np.float64)
        for batch in batches:
            for part, texts in text_blocks(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(texts, weights))], ["key", "score"])

    cut = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return cut.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", id_col)


def scored(df: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """All columns of a table and ``score``; a column of that name is replaced. See ``score`` for the rules."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c != "score"]
    at = names.index(text_col)
    schema = StructType([*(df.schema[c] for c in names), StructField("score", DoubleType())])

    @tidied
    def run(batches):
        weights = np.frombuffer(sent.value, np.float32).astype(np.float64)
        for batch in batches:
            for part, texts in text_blocks(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(texts, weights))], [*names, "score"])

    return df.select(*names).mapInArrow(run, schema)


def query(spark, folder):
    """op10: quality score and decision for every document."""
    documents = table(spark, folder, "documents")
    model = fit(documents, table(spark, folder, "labels"))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
