"""Quality rules on repetition: how much of a text lies inside repeated word runs and lines."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import span_hashes
from .common import mixed, table, text_blocks
from .spans import words

# Of the base rule.
SYMBOLS = b"#*$%&|<>"
BASE_RUN = 8
#: Lengths of word runs and the most of a text's word characters that repeated runs may cover.
RUN_LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
#: Most of the characters of all lines that repeated lines may cover, first ones included.
LINE_LIMIT = 0.40

# Odd multiplier of the rolling hashes.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeated(run: np.ndarray, text: np.ndarray, h: np.ndarray, n: int, among: np.ndarray) -> np.ndarray:
    """Places among ``among`` whose run of ``n`` words occurs twice or more in its text.

    ``run`` holds a hash of each run and its text; runs with equal hashes are compared word by word.
    """
    order = among[np.argsort(run[among], kind="stable")]
    same = run[order[1:]] == run[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    equal = text[a] == text[b]
    for k in range(n):
        equal &= h[a + k] == h[b + k]
    return np.unique(np.concatenate([a[equal], b[equal]]))


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All measures of some texts, an array with one value for each text."""
    n_texts = len(texts)
    h, first, raw, starts, ends = words(texts, lower=False)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    n_words = np.diff(first)
    text = np.repeat(np.arange(n_texts), n_words)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    size = lead[ends] - lead[starts]  # code points

    def total(of, value):
        return np.bincount(of, value, n_texts).astype(np.int64)

    out = {"n_words": n_words, "word_chars": total(text, size)}
    out["n_symbols"] = np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[raw])])[begins])

    line_ends = np.flatnonzero(raw == 10)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1]) if len(line_ends) else line_ends
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    owner = np.searchsorted(begins, line_starts, "right") - 1
    owners = mixed(np.arange(n_texts))
    _, inverse, count = np.unique(span_hashes(raw, line_starts, line_ends) ^ owners[owner], return_inverse=True, return_counts=True)
    kinds = np.zeros(len(count), np.int64)
    kinds[inverse] = owner
    out["n_dup_lines"] = total(kinds, count - 1)
    length = line_ends - line_starts
    all_lines = total(owner, length)
    again = count[inverse] > 1
    out["line_cover"] = total(owner[again], length[again]) / np.maximum(all_lines, 1)

    out["n_repeat_words"] = np.zeros(n_texts, np.int64)
    cover = {n: np.zeros(n_texts) for n in RUN_LIMITS}
    least, most = min([*RUN_LIMITS, BASE_RUN]), max([*RUN_LIMITS, BASE_RUN])
    run, among, last = np.zeros(len(h), np.uint64), None, np.repeat(first[1:], n_words)
    with np.errstate(over="ignore"):
        value = mixed(h)
        for n in range(1, most + 1):
            m = max(len(h) - n + 1, 0)
            run = run[:m] * _STEP + value[n - 1 :]  # each run grows by the word after it
            if n < least:
                continue
            # a run of n words that occurs twice begins with one of n - 1 words that does
            among = np.arange(m) if among is None else among
            among = among[(among + n) <= last[among]]
            among = _repeated(run ^ owners[text[:m]], text, h, n, among)
            if not len(among):
                break
            edge = np.zeros(len(h) + 1, np.int64)
            edge[among] += 1
            edge[among + n] -= 1
            inside = np.cumsum(edge[:-1]) > 0
            if n in cover:
                cover[n] = total(text[inside], size[inside]) / np.maximum(out["word_chars"], 1)
            if n == BASE_RUN:
                out["n_repeat_words"] = total(text, inside)
    out["base_failed"] = (n_words < 20) | (100 * out["n_repeat_words"] > 30 * n_words)
    out["cover"] = list(np.stack(list(cover.values()), axis=1))
    good = ~out["base_failed"] & (out["line_cover"] <= LINE_LIMIT)
    for n, limit in RUN_LIMITS.items():
        good &= cover[n] <= limit
    out["kept"] = good
    return out


_TYPES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "line_cover": pa.float64(), "cover": pa.list_(pa.float64()),
}


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every whole text, one row out for each row in.

    ``cover`` holds, for each length of ``RUN_LIMITS``, the part of the word characters inside runs
    of that many words that occur twice or more (first ones included, overlaps once);
    ``line_cover`` the part of the line bytes in repeated lines. A null or empty text has no words
    and fails the base rule. Repeated rows are judged one by one; an empty table gives no rows;
    other columns are not read. Work is in proportion to a text (one sort of its runs), memory to
    the longest text.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in text_blocks(batch, 1):
                found = measure(texts)
                out = [pa.array(found[k], t) for k, t in _TYPES.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), *out], ["key", *_TYPES])

    schema = (
        f"key {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, line_cover double, cover array<double>"
    )
    cut = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return cut.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def query(spark, folder):
    """op5: repetition measures and verdict for every document."""
    return repetition(table(spark, folder, "documents")).drop("line_cover", "cover")

