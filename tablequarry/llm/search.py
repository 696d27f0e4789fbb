"""Ranked lexical search of many queries at once, with shared partial sums.

The items of a block share term sets. These are mined from the items: pairs of neighbouring terms
(or of sets found before) that stand in several items become a shared set, again and again. The
result is a graph in which every node is the sum of two others and each item is one node. A task
turns a batch of documents into one row of scores per term, adds up every node once for all its
documents, and keeps the best documents of each item.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.ordered import numbered_in_order
from .common import discard, runs, stored, table, text_blocks

#: Documents kept for each item.
TOP = 50
#: Items whose sums are worked out together; a benchmark of any size is a row of such blocks.
ITEMS = 1024
#: Bytes of partial sums a task holds.
SUMS = 32 << 20

# Terms are ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(raw: bytes) -> Counter:
    """Terms of a UTF-8 text and how often each occurs."""
    found = Counter()
    for part in runs(raw, _KEEP):
        found.update(part)
    return found


# ---- items: blocks and the graph of shared sets ------------------------------------------


def _item_terms(batches):
    import pyarrow as pa

    for batch in batches:
        for part, raws in text_blocks(batch, 1):
            sets = [sorted(terms(raw)) for raw in raws]
            low = [min((hash_of(t) for t in s), default=0) for s in sets]
            rows = [part.column(0), pa.array([[t.decode() for t in s] for s in sets], pa.list_(pa.string())), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["item", "terms", "low"])


def hash_of(term: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term) >> 1


def shared_sets(sets: list[list[int]], first: int) -> tuple[list[int], np.ndarray]:
    """The node of each set of terms (numbers below ``first``), and the two parts of every node from ``first`` on.

    Terms stand in order of how many sets hold them, so that sets with common terms have common
    neighbours. While a pair of neighbours stands in two sets or more it becomes a node; what is left
    of a set is added up in a balanced tree. A pair is a node only once.
    """
    spread = Counter(t for s in sets for t in s)
    left = [sorted(s, key=lambda t: (-spread[t], t)) for s in sets]
    nodes: dict[tuple[int, int], int] = {}

    def node(a, b):
        return nodes.setdefault((a, b), first + len(nodes))

    while True:
        together = Counter(p for s in left for p in zip(s, s[1:]))
        often = {p for p, n in together.items() if n > 1}
        if not often:
            break
        merged = False
        for s in left:
            pairs = [i for i in range(len(s) - 1) if (s[i], s[i + 1]) in often]
            taken, free = [], set(range(len(s)))
            for i in sorted(pairs, key=lambda i: (-together[s[i], s[i + 1]], i)):
                if i in free and i + 1 in free:
                    free -= {i, i + 1}
                    taken.append(i)
            for i in sorted(taken, reverse=True):
                s[i : i + 2] = [node(s[i], s[i + 1])]
                merged = True
        if not merged:
            break
    for s in left:
        while len(s) > 1:
            s[:] = [node(*s[i : i + 2]) if i + 1 < len(s) else s[i] for i in range(0, len(s), 2)]
    return [s[0] for s in left], np.array(list(nodes), np.int64).reshape(-1, 2)


def in_levels(parts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """How deep every node from ``first`` on is (its parts are less deep), and the order of nodes by depth."""
    deep = np.zeros(first + len(parts), np.int64)
    for k, (a, b) in enumerate(parts.tolist()):
        deep[first + k] = max(deep[a], deep[b]) + 1
    return deep[first:], np.argsort(deep[first:], kind="stable")


def _plan(frame):
    """The graph of one block of items, as one row: vocabulary, parts of the nodes level by level, node of each item."""
    import pandas as pd

    frame = frame.sort_values("number")
    vocab = sorted({t for s in frame["terms"] for t in s})
    number = {t: k for k, t in enumerate(vocab)}
    ends, parts = shared_sets([[number[t] for t in s] for s in frame["terms"]], len(vocab))
    deep, order = in_levels(parts, len(vocab))
    place = np.arange(len(vocab) + len(parts))
    place[len(vocab) + order] = len(vocab) + np.arange(len(parts))
    levels = [place[parts[order[deep[order] == d]]] for d in range(1, int(deep.max(initial=0)) + 1)]
    graph = {"terms": [t.encode() for t in vocab], "levels": levels, "numbers": frame["number"].to_numpy(np.int64), "ends": place[np.array(ends)]}
    return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "graph": [pickle.dumps(graph)]})


def graphs(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """The numbered items, and one graph of shared sets for each block of them.

    Items stand in order of the smallest hash of a term, so those with many common terms fall in the
    same block. Items without terms (null, empty) are left out: they match nothing.
    """
    wide = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = wide.schema["item"].dataType.simpleString()
    found = wide.mapInArrow(_item_terms, f"item {kind}, terms array<string>, low long").where("size(terms) > 0")
    numbered = stored(numbered_in_order(found, ["low", "item", "terms"], "number").withColumn("block", F.expr(f"(number - 1) div {block}")))
    cut = numbered.select("block", "number", "terms").groupBy("block").applyInPandas(_plan, "block long, graph binary")
    return numbered.select("number", "item"), stored(cut)


# ---- documents ---------------------------------------------------------------------------


def _postings(words: list[bytes]):
    number = {t: k for k, t in enumerate(words)}

    def post(batches):
        import pyarrow as pa

        for batch in batches:
            for part, raws in text_blocks(batch, 1):
                keep, size, at, often = [], [], [], []
                for k, raw in enumerate(raws):
                    found = terms(raw)
                    if not found:
                        continue
                    hits = [(i, n) for t, n in found.items() if (i := number.get(t)) is not None]
                    keep.append(k)
                    size.append(found.total())
                    at.append(np.array([i for i, _ in hits], np.int32).tobytes())
                    often.append(np.array([n for _, n in hits], np.int64).tobytes())
                rows = [part.column(0).take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()), pa.array(at, pa.binary()), pa.array(often, pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, ["doc", "size", "at", "often"])

    return post


def _held(words: int):
    def count(batches):
        import pyarrow as pa

        total = np.zeros(words, np.int64)
        for batch in batches:
            at = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            total += np.bincount(at, minlength=words)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return count


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def middle(size: int, documents: int, length: int) -> int:
    """A document's m: 100 for one of average length, half of the difference from it counts."""
    return 100 - 50 + (50 * size * documents) // length


class Best:
    """The best documents of every item so far, of equal scores those with the smaller id, null last."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.ones(items, np.int64)
        self.last = np.full(items, np.iinfo(np.int64).max)
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        """Scores of items (rows) for documents (columns)."""
        ids = np.where(known, docs, np.iinfo(np.int64).max)
        item, at = np.nonzero((scores > self.least[:, None]) | ((scores == self.least[:, None]) & (ids <= self.last[:, None])))
        self.rows.append((item, scores[item, at], ids[at], known[at]))
        self.held += len(item)
        if self.held > 4 * self.top * self.items:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """The rows of the best documents: item, score, id and whether there is one."""
        if not self.rows:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        item, score, ids, known = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((~known, ids, -score, item))
        item, score, ids, known = item[order], score[order], ids[order], known[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.top - 1
        self.least[item[full]], self.last[item[full]] = score[full], ids[full]
        kept = rank < self.top
        self.rows = [(item[kept], score[kept], ids[kept], known[kept])]
        self.held = int(kept.sum())
        return self.rows[0]


def _best(graph: dict, weight: np.ndarray, documents: int, length: int, top: int):
    words, levels, ends = len(graph["terms"]), graph["levels"], graph["ends"]
    nodes = words + sum(map(len, levels))
    width = max(1, min(256, SUMS // (8 * nodes)))

    def rank(batches):
        import pyarrow as pa

        best = Best(len(ends), top)
        for whole in batches:
            for start in range(0, whole.num_rows, width):
                batch = whole.slice(start, width)
                n = batch.num_rows
                at, often = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                column = np.repeat(np.arange(n), [len(a) // 4 for a in at])
                at, often = np.frombuffer(b"".join(at), np.int32), np.frombuffer(b"".join(often), np.int64)
                m = np.array([middle(s, documents, length) for s in batch.column(1).to_pylist()], np.int64)
                sums = np.zeros((nodes, n), np.int64)
                sums[at, column] = weight[at] * ((1_000_000_000 * often) // (1000 * often + 20 * m[column]))
                done = words
                for parts in levels:
                    np.add(sums[parts[:, 0]], sums[parts[:, 1]], out=sums[done : done + len(parts)])
                    done += len(parts)
                ids = batch.column(0)
                best.add(sums[ends], ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False))
        item, score, ids, known = best.cut()
        docs = pa.array(ids, pa.int64(), mask=~known)
        yield pa.RecordBatch.from_arrays([pa.array(graph["numbers"][item]), docs, pa.array(score)], ["number", "doc", "score"])

    return rank


def _block(docs: DataFrame, graph: dict, top: int) -> DataFrame:
    """The best documents of every task for the items of one block."""
    words = len(graph["terms"])
    posted = stored(docs.mapInArrow(_postings(graph["terms"]), "doc long, size long, at binary, often binary"))
    total = posted.agg(F.count("*").alias("documents"), F.sum("size").alias("length")).first()
    held = posted.select("at").mapInArrow(_held(words), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(words, np.int64)
    df[held.column(0).to_numpy()] = held.column(1).to_numpy()
    rank = _best(graph, weights(df, total["documents"]), total["documents"], total["length"] or 1, top)
    out = stored(posted.mapInArrow(rank, "number long, doc long, score long"))
    discard(posted)
    return out


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, block: int = ITEMS) -> DataFrame:
    """The ``top`` best documents of every item: ``item_col, rank, doc_id, score``.

    Items are searched in blocks; each block reads all documents once. Ids of documents are whole
    numbers; rows without id count and may be found, after those with ids of the same score. Null
    and empty texts have no terms: such documents do not count, such items find nothing. Repeated
    rows are documents (or items) of their own. Empty tables give no rows.
    """
    numbered, plans = graphs(items, item_col, item_text, block)
    wide = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    parts = []
    for number in range(plans.count()):
        graph = pickle.loads(plans.where(F.col("block") == number).select("graph").first()["graph"])
        parts.append(_block(wide, graph, top))
    spark: SparkSession = docs.sparkSession
    found = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "number long, doc long, score long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(numbered, "number").select(F.col("item").alias(item_col), "rank", F.col("doc").alias("doc_id"), "score")


def query(spark, folder):
    """op12: the 50 best documents of every benchmark item."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL = r"""
with doc as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
item as (
  select row_number() over () as i, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
total as (select count(*) as docs, sum(len(t))::bigint as len from doc where len(t) > 0),
asked as (select i, item_id, unnest(t) as term from item),
post as (
  select d, doc_id, n, term, count(*) as tf from (select d, doc_id, len(t)::bigint as n, unnest(t) as term from doc)
  where term in (select term from asked) group by all),
weight as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from post, total group by term, docs),
part as (
  select d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // len)))) as c
  from post join weight using (term), total),
scored as (select i, item_id, d, doc_id, sum(c)::bigint as score from asked join part using (term) group by all having sum(c) > 0),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from scored)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50"""
