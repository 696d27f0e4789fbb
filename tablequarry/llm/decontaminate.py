"""Benchmark decontamination by spaced-seed hashing.

A spaced seed hashes the words at some places of a window and ignores the others, so a changed word
at an ignored place does no harm. Hashes of the benchmark items and of the documents are joined; at
every hit the words around it are compared, and a document holds an item where at most
``MOST_WRONG`` words of ``WINDOW`` words in a row differ (words beyond a text's ends differ). Items too
short for the seeds are found by runs of words: the whole item where no word may differ, else its
first and its last half, of which one is as it was where one word differs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bitmap, in_bitmap, mixed, stored, table, text_blocks, tidied
from .spans import words

#: A leak is a window of so many words with at most so many of them changed.
WINDOW, MOST_WRONG = 13, 2
#: Places of the seeds. For any two changed words of thirteen, one of them hits somewhere (tested).
SEEDS = ((0, 1, 2, 3, 4, 6), (0, 2, 4, 7, 8, 9))
#: Items of fewer words than the shortest seed spans must be there word for word.
SHORTEST = min(s[-1] for s in SEEDS) + 1
#: From so many words on the seeds miss no window with the changed words it may have (tested).
SEEDED = 11
#: Words kept around a hit: any window of WINDOW words that holds the seed lies in them.
BEFORE, AFTER = WINDOW - SHORTEST, WINDOW
#: Size of the filter made from the benchmark's hashes: 2 to this power bits, 4 MB.
FILTER_BITS = 25

_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _words(texts: list[bytes]):
    """Hashes of the lower-case words (runs of letters and digits) and the first word of each text."""
    lower = [t.decode("utf-8", "replace").lower().encode("utf-8", "replace") for t in texts]
    return words(lower, _BREAK, lower=False)[:2]


def _hashes(h: np.ndarray, at: np.ndarray, seed, kind: int) -> np.ndarray:
    """The hash of the words at the places of ``seed`` from each place on."""
    out = np.full(len(at), kind, np.uint64)
    with np.errstate(over="ignore"):
        for o in seed:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[at + o])
    return out


def run_length(size: int) -> int:
    """Words of the runs that stand for an item of ``size`` words, fewer than ``SEEDED``."""
    return size // 2 if size * MOST_WRONG // WINDOW else size


def _seeds(h: np.ndarray, first: np.ndarray, runs: list[int]):
    """All hashes of the seeds and of runs of so many words: place and hash; each lies inside one text."""
    last = np.repeat(first[1:], np.diff(first))
    places, hashes = [], []
    for kind, seed in [*enumerate(SEEDS, 1), *((100 + n, range(n)) for n in runs)]:
        m = max(len(h) - seed[-1], 0)
        at = np.flatnonzero(np.arange(m) + seed[-1] < last[:m])
        places.append(at)
        hashes.append(_hashes(h, at, seed, kind))
    return np.concatenate(places), np.concatenate(hashes)


def _item_seeds(h: np.ndarray, first: np.ndarray):
    """The hashes that find each item: seeds from ``SEEDED`` words on, else its first and last run."""
    size = np.diff(first)
    at, hashes = _seeds(h, first, [])
    long = size[np.searchsorted(first, at, "right") - 1] >= SEEDED
    places, found = [at[long]], [hashes[long]]
    for words_in in range(1, SEEDED):
        n = run_length(words_in)
        for place in {0, words_in - n}:
            at = first[:-1][size == words_in] + place
            places.append(at)
            found.append(_hashes(h, at, range(n), 100 + n))
    return np.concatenate(places), np.concatenate(found)


def _around(h: np.ndarray, first: np.ndarray, at: np.ndarray, text: np.ndarray, none: int) -> np.ndarray:
    """The word hashes from ``BEFORE`` words before each place on; ``none`` outside the text."""
    spot = at[:, None] + np.arange(-BEFORE, AFTER)
    inside = (spot >= first[text][:, None]) & (spot < first[text + 1][:, None])
    return np.where(inside, h[np.clip(spot, 0, max(len(h) - 1, 0))], np.uint64(none))


def _rows(text_col: int, words_filter, runs, keys):
    """The hashes of all texts of the batches, with the words around them; without a filter, those of items."""

    @tidied
    def run(batches):
        held = words_filter and words_filter.value
        for batch in batches:
            for part, texts in text_blocks(batch, text_col):
                h, first = _words(texts)
                at, hashes = _item_seeds(h, first) if held is None else _seeds(h, first, runs)
                if held is not None:
                    keep = in_bitmap(hashes, held)
                    at, hashes = at[keep], hashes[keep]
                text = np.searchsorted(first, at, "right") - 1
                for k in range(0, len(at), 20_000):
                    s = slice(k, k + 20_000)
                    around = _around(h, first, at[s], text[s], 1 if held is None else 2).astype("<u8")
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(text[s])), pa.array(hashes[s].view(np.int64)), pa.array(at[s] - first[text[s]]),
                            pa.array((first[text[s] + 1] - first[text[s]])), pa.array([r.tobytes() for r in around], pa.binary()),
                        ],
                        keys,
                    )

    return run


def _verify(batches):
    """Best window of each hit: where it starts in the document and how many words of it are right."""
    for batch in batches:
        names = batch.schema.names
        col = {n: batch.column(k) for k, n in enumerate(names)}
        doc, item = (np.frombuffer(b"".join(col[n].to_pylist()), "<u8").reshape(-1, BEFORE + AFTER) for n in ("doc_words", "item_words"))
        size = np.minimum(col["item_size"].to_numpy(), WINDOW)
        right = np.concatenate([np.zeros((len(doc), 1), np.int64), np.cumsum(doc == item, axis=1)], axis=1)
        best, where = np.full(len(doc), -1), np.zeros(len(doc), np.int64)
        for s in range(BEFORE + AFTER):
            end = np.minimum(s + size, BEFORE + AFTER)
            n = np.where(s + size <= BEFORE + AFTER, right[np.arange(len(doc)), end] - right[:, s], -1)
            better = n > best
            best, where = np.where(better, n, best), np.where(better, s, where)
        good = np.flatnonzero(size - best <= size * MOST_WRONG // WINDOW)
        start = col["doc_at"].to_numpy()[good] - BEFORE + where[good]
        yield pa.RecordBatch.from_arrays(
            [col["doc_key"].take(pa.array(good)), col["item_key"].take(pa.array(good)), pa.array(start), pa.array(start + size[good]), pa.array(best[good] / size[good])],
            ["doc_key", "item_key", "first_word", "end_word", "share"],
        )


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``id_col, item_col, first_word, end_word, share``: which document holds a window of which item.

    One row for each pair; ``first_word`` and ``end_word`` bound all windows found (words from 0),
    ``share`` is the part of right words in the best one. An item of fewer than ``WINDOW`` words is
    compared whole, with changed words in proportion; items of fewer than ``SHORTEST`` words must be
    there word for word. Null and empty texts hold nothing. Repeated rows give one pair, null ids are ids.
    Empty tables give no rows; other columns are not read. Only documents' hashes that pass a
    filter of fixed size, made from the benchmark, are joined.
    """
    kind, item_kind = documents.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    shape = "hash long, {0}_at long, {0}_size long, {0}_words binary"
    items = benchmark.select(F.col(item_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        _rows(1, None, [], ["item_key", "hash", "item_at", "item_size", "item_words"]), f"item_key {item_kind}, {shape.format('item')}"
    )
    items = stored(items)
    short = items.where(F.col("item_size") < SEEDED).select("item_size").distinct().collect()
    runs = sorted({run_length(r.item_size) for r in short})
    sent = documents.sparkSession.sparkContext.broadcast(bitmap(items, "hash", FILTER_BITS))
    hits = documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(
        _rows(1, sent, runs, ["doc_key", "hash", "doc_at", "doc_size", "doc_words"]), f"doc_key {kind}, {shape.format('doc')}"
    )
    found = hits.join(items, "hash").select("doc_key", "doc_at", "doc_words", "item_key", "item_size", "item_words")
    found = found.mapInArrow(_verify, f"doc_key {kind}, item_key {item_kind}, first_word long, end_word long, share double")
    pairs = found.groupBy("doc_key", "item_key").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.max("share").alias("share"))
    return pairs.withColumnsRenamed({"doc_key": id_col, "item_key": item_col})


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no window of a benchmark item, with all their columns."""
    bad = leaks(documents, benchmark, id_col).select(F.col(id_col).alias("__bad")).distinct()
    return documents.join(bad, F.col(id_col).eqNullSafe(F.col("__bad")), "left_anti")


def query(spark, folder):
    """op1: every pair of a document and a benchmark item that it holds."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
