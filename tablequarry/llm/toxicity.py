"""Toxicity: a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two words counts the letter triples that both hold in order, gaps allowed, each
weighted by ``DECAY`` to the length it spans, and is normalised. A word is mapped by its kernels
with the landmark words (Nyström); a linear support vector machine decides there. As the kernel is
a dot product of sparse triple counts, landmarks and machine fold into one weight per triple, and
scoring a word is one sparse dot product divided by the word's norm. A sentence is as toxic as its
most toxic word: only texts are labelled, so the machine learns which word of a toxic text is meant
(multiple-instance training).
"""

import functools
import pickle
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import HashTable, span_hashes
from .common import mixed, table, text_blocks
from .labelled import remainder, sample

#: Fixed kernel parameters: weight for each letter a triple spans, and the most letters it spans.
DECAY, SPAN = 0.7, 5
LANDMARKS = 64  # of each class
#: Most labelled documents of each class that the model is fitted on.
SAMPLE = 1_500
ROUNDS, RIDGE = 5, 1.0
THRESHOLD = 0.3
_EDGE = 63
_TRIPLES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


@functools.cache
def _letters() -> np.ndarray:
    """A number from 1 to 62 for each letter (accents count), 0 for marks, 255 for white space."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = 27 + c % 36
    out[[*range(97, 123)]] = np.arange(1, 27)
    out[[*range(65, 91)]] = np.arange(1, 27)
    for a, b in zip("@013457", "aoieast"):  # fixed values: figures that stand for letters
        out[ord(a)] = ord(b) - 96
    out[[32, *range(9, 14), 0x85, 0xA0, 0x2028, 0x2029]] = 255
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter numbers of all words, where each word starts and ends, and its text.

    Marks inside a word are dropped; three or more single letters in a row make one word.
    """
    cp = np.frombuffer("\n".join([*(t.lower() for t in texts), ""]).encode("utf-32-le", "replace"), "<u4")
    code = _letters()[cp]
    blank = code == 255
    begins = np.cumsum([0, *(len(t.lower()) + 1 for t in texts)])
    first = ~blank
    first[1:] &= blank[:-1]
    word = np.cumsum(first) - 1
    kept = np.flatnonzero((code > 0) & ~blank)
    n = int(first.sum())
    size = np.bincount(word[kept], minlength=n)
    text = np.searchsorted(begins, np.flatnonzero(first), "right") - 1
    single = size == 1
    join = np.zeros(n, bool)  # goes on with the word before it
    if n:
        run = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for a, b in zip(run[::2].tolist(), run[1::2].tolist()):
            if b - a >= 3:
                join[a + 1 : b] = text[a + 1 : b] == text[a : b - 1]
    number = np.cumsum(~join) - 1
    size = np.bincount(number, size, int(number[-1]) + 1 if n else 0).astype(np.int64)
    text = text[~join]
    ends = np.cumsum(size)
    full = size > 0
    return code[kept], (ends - size)[full], ends[full], text[full]


def triples(code: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Weighted triple counts of words: word number, triple, count, and each word's norm."""
    size = ends - starts + 1
    n = len(starts)
    at = np.cumsum(size) - size
    row = np.repeat(np.arange(n), size)
    line = np.full(len(row), _EDGE, np.int64)
    inner = np.ones(len(row), bool)
    inner[at] = False
    take = np.repeat(starts - np.cumsum(size - 1) + size - 1, size - 1) + np.arange(int((size - 1).sum()))
    line[inner] = code[take]
    keys, values = [], []
    for a, b in _TRIPLES:
        m = len(line) - b
        if m <= 0:
            continue
        whole = row[:m] == row[b:]
        triple = (line[:m] << 12 | line[a : a + m] << 6 | line[b : b + m])[whole]
        keys.append(row[:m][whole] << 18 | triple)
        values.append(np.full(len(triple), DECAY ** (b + 1)))
    keys, values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, values))
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    values = np.add.reduceat(values, new) if len(new) else values
    keys = keys[new]
    row, triple = keys >> 18, keys & 0x3FFFF
    return row, triple, values, np.sqrt(np.bincount(row, values**2, n))


def kernel(code, starts, ends, weights: np.ndarray) -> np.ndarray:
    """Sum of triple counts times ``weights`` (one a triple), over the norm; 0 for words without triples."""
    row, triple, value, norm = triples(code, starts, ends)
    return np.bincount(row, value * weights[triple], len(starts)) / np.where(norm > 0, norm, 1.0)


class Profiles:
    """Normalised triple counts of many words, as sparse rows."""

    def __init__(self, code, starts, ends, step: int = 20_000):
        sizes, self.triple, self.value = [], [], []
        for k in range(0, len(starts), step):
            row, triple, value, norm = triples(code, starts[k : k + step], ends[k : k + step])
            sizes.append(np.bincount(row, minlength=len(starts[k : k + step])))
            self.triple.append(triple.astype(np.int32))
            self.value.append((value / norm[row]).astype(np.float32))
        self.size = np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64)
        self.triple, self.value = np.concatenate([*self.triple, np.zeros(0, np.int32)]), np.concatenate([*self.value, np.zeros(0, np.float32)])
        self.start = np.cumsum(self.size) - self.size

    def take(self, rows: np.ndarray) -> "Profiles":
        out = object.__new__(Profiles)
        out.size = self.size[rows]
        out.start = np.cumsum(out.size) - out.size
        at = np.repeat(self.start[rows] - out.start, out.size) + np.arange(int(out.size.sum()))
        out.triple, out.value = self.triple[at], self.value[at]
        return out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.size)), self.size), self.value * weights[self.triple], len(self.size))

    def kernels(self, marks: "Profiles", step: int = 2_000) -> np.ndarray:
        """The kernel of every row with every row of ``marks``."""
        used = np.unique(marks.triple)
        table = np.zeros((len(used) + 1, len(marks.size)), np.float32)
        table[np.searchsorted(used, marks.triple), np.repeat(np.arange(len(marks.size)), marks.size)] = marks.value
        out = np.zeros((len(self.size), len(marks.size)))
        for k in range(0, len(self.size), step):
            part = self.take(np.arange(k, min(k + step, len(self.size))))
            at = np.searchsorted(used, part.triple)
            at[at == len(used)] = 0
            at = np.where(used[at] == part.triple, at, len(used))
            both = np.flatnonzero(at < len(used))
            row = np.repeat(np.arange(len(part.size)), part.size)[both]
            if len(both):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out[k + row[first]] = np.add.reduceat(part.value[both, None] * table[at[both]], first, axis=0)
        return out

    def folded(self, weight: np.ndarray) -> np.ndarray:
        """One weight per triple: the weighted sum of the rows."""
        return np.bincount(self.triple, self.value * np.repeat(weight, self.size), 1 << 18)


def _bent(code, starts, ends, per_word: int = 4):
    """Words with one letter put in or taken out, at places and with letters fixed by the word."""
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        word = code[a:b].tolist()
        for k in range(per_word):
            at = 1 + (sum(word) + 5 * k) % (len(word) - 1)
            out.append(word[:at] + word[at + 1 :] if k == per_word - 1 else [*word[:at], 1 + (7 * at + 11 * k + word[0]) % 26, *word[at:]])
    size = np.array(list(map(len, out)), np.int64)
    ends = np.cumsum(size)
    return np.array([c for w in out for c in w], np.uint8), ends - size, ends


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton steps on the active set; the bias is last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        a, c = x[active], weight[active, None]
        new = np.linalg.solve(ridge + a.T @ (c * a), a.T @ (c[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def train(texts: list[str], labels: np.ndarray, prior: float) -> dict | None:
    """The folded model: weight of each triple, bias, and the line from word to text score."""
    texts, labels = _distinct(texts, labels)
    if len(set(labels.tolist())) < 2:
        return None
    code, starts, ends, text = words(texts)
    h, where, word = np.unique(span_hashes(code, starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[where], ends[where]
    pair = np.unique(text * len(h) + word)
    text, word = pair // len(h), pair % len(h)
    bad = np.bincount(word[labels[text] == 1], minlength=len(h))
    good = np.bincount(word[labels[text] == 0], minlength=len(h))
    n_bad, n_good = (labels == 1).sum(), (labels == 0).sum()
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    wide = ends - starts >= 3
    rows = Profiles(code, starts, ends)
    marks = _landmarks(rows, np.argsort(-np.where(wide & (bad > 1), odds * np.sqrt(bad), -1.0))[: 8 * LANDMARKS])
    usual = np.flatnonzero(wide & (odds < 0))
    usual = usual[np.argsort(-good[usual], kind="stable")]
    marks = np.concatenate([marks, _landmarks(rows, usual[:: max(1, len(usual) // (8 * LANDMARKS))][: 8 * LANDMARKS])])
    profile = rows.take(marks)
    value, vector = np.linalg.eigh(profile.kernels(profile))
    root = vector[:, value > 1e-6] / np.sqrt(value[value > 1e-6])  # Nyström map

    toxic = labels[text] == 1
    clean_words = np.unique(word[~toxic])
    sampled = clean_words[np.argsort(mixed(h[clean_words]))[:6_000]]
    f = np.where(wide, odds * np.sqrt(bad), -9.0)
    first = np.flatnonzero(np.diff(text[toxic], prepend=-1))
    for _ in range(ROUNDS):
        # the most toxic word of each toxic text is its witness; its bent forms are insults too
        best = np.maximum.reduceat(f[word[toxic]], first)
        is_best = f[word[toxic]] == np.repeat(best, np.diff(np.append(first, toxic.sum())))
        witness, count = np.unique(word[toxic][is_best], return_counts=True)
        often = witness[(count >= 3) & (ends - starts >= 4)[witness]]
        bent = Profiles(*_bent(code, starts[often], ends[often]))
        hard = clean_words[np.argsort(-f[clean_words])[:2_000]]
        negative = rows.take(np.unique(np.concatenate([sampled, hard])))
        sets = [(rows.take(witness), 1.0, 0.5 / len(witness)), (bent, 1.0, 0.5 / max(len(bent.size), 1)), (negative, -1.0, 1.0 / len(negative.size))]
        x = np.concatenate([p.kernels(profile) for p, _, _ in sets]) @ root
        y, weight = (np.concatenate([np.full(len(p.size), v) for p, v in pairs]) for pairs in ([(p, y) for p, y, _ in sets], [(p, c) for p, _, c in sets]))
        w = _machine(x, y, weight * len(negative.size))
        folded = profile.folded(root @ w[:-1])
        f = rows.dot(folded) + w[-1]
    top = np.full(len(texts), -2.0)
    np.maximum.at(top, text, f[word])
    share = np.where(labels == 1, prior / max(n_bad, 1), (1 - prior) / max(n_good, 1)) * len(texts)
    return {"weights": folded.astype(np.float32), "bias": w[-1], "line": _line(top, labels, share)}


def _distinct(texts, labels):
    first = {}
    for t, y in zip(texts, labels.tolist()):
        first[t] = max(y, first.get(t, 0))
    return list(first), np.array(list(first.values()))


def _landmarks(rows: Profiles, among: np.ndarray) -> np.ndarray:
    """Up to ``LANDMARKS`` words of ``among`` in order that are unlike each other."""
    like = rows.take(among).kernels(rows.take(among))
    out: list[int] = []
    for k in range(len(among)):
        if len(out) < LANDMARKS and (like[k, out] < 0.7).all():
            out.append(k)
    return among[out]


def _line(top: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the top word score."""
    x = np.stack([top, np.ones(len(top))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (labels - p)) - 0.5 * w * [1, 0]
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.diag([1.0, 1e-6])
        w = w + np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held: int = 2, most: int = SAMPLE) -> bytes:
    """A pickled model of ``label`` from at most ``2 * most`` labelled documents outside fold ``held``.

    The sample is bounded, so one task fits it. Without both classes there is no model and every
    score is 0.
    """
    counts = {r["k"]: r["n"] for r in labels.where(remainder(F.col("doc_id"), folds) != held).groupBy(F.col(label).alias("k")).agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(counts.get(0, 0) + counts.get(1, 0), 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        made = train([t or "" for t in pdf["text"]], pdf["label"].to_numpy(), prior)
        return pd.DataFrame({"model": [pickle.dumps(made)]})

    rows = sample(documents, labels, label, folds, held, most).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else pickle.dumps(None)


class Scorer:
    """Scores texts with a model; decisions of words seen before are kept, in bounded memory."""

    def __init__(self, model: dict):
        self.model = model
        self.weights = model["weights"].astype(np.float64)
        self.seen, self.known = HashTable(21), np.zeros(0)

    def _decisions(self, code, starts, ends) -> np.ndarray:
        h = span_hashes(code, starts, ends)
        entry = self.seen.find(h)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            if self.seen.n + len(lost) > self.seen.most:
                self.seen.clear()
                self.known, lost = np.zeros(0), np.arange(len(h))
            new, where = np.unique(h[lost], return_index=True)
            where = lost[where]
            f = np.concatenate([kernel(code, starts[where[k : k + 20_000]], ends[where[k : k + 20_000]], self.weights) for k in range(0, len(where), 20_000)])
            self.seen.place(new)
            self.known = np.concatenate([self.known, f + self.model["bias"]])
            entry = self.seen.find(h)
        return self.known[entry]

    def scores(self, texts: list[str]) -> np.ndarray:
        code, starts, ends, text = words(texts)
        top = np.full(len(texts), -2.0)
        if len(starts):
            np.maximum.at(top, text, self._decisions(code, starts, ends))
        a, b = self.model["line"]
        return 1 / (1 + np.exp(-np.clip(a * top + b, -35, 35)))


def score(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every whole text, one row for each row.

    A null or empty text, and one without letters, gets the lowest score of the line. Repeated rows
    are scored one by one; an empty table gives no rows; other columns are not read. The model (1 MB)
    goes to the executors as a broadcast variable.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        made = pickle.loads(sent.value)
        scorer = made and Scorer(made)
        for batch in batches:
            for part, texts in text_blocks(batch, 1):
                found = scorer.scores([t.decode("utf-8", "replace") for t in texts]) if scorer else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["key", "score"])

    cut = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return cut.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", id_col)


def query(spark, folder):
    """op3: toxicity score and decision for every document."""
    documents = table(spark, folder, "documents")
    model = fit(documents, table(spark, folder, "labels"))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
