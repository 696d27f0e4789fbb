"""N-gram Jaccard join by PartEnum signatures.

Sets are sorted into size bands; for two sets of one band that are similar enough, at most
``k = 2 * largest size / 9`` shingles differ. The shingle domain is cut by hash into ``k + 1`` parts
or a few more, so at least one part is the same in both sets: each part of a set, hashed, is a
signature (enumerating the subsets of parts of size n - k with one part each), and sets that link
share one. Candidates are checked with parity sketches (the number of bits in which two sketches
differ is never above the number of shingles in which the sets differ) and then exactly.

A set has no partner if fewer of its signatures are found in other sets than any partner must share
(all its parts but those in which the two can differ). Of sets that may have partners only the
rarest signatures are kept, as many as are sure to hold one that a partner shares.

Large groups: a bucket is never paired with itself as a whole. Its members are first compared with
one leader; members that are now in one class need no more links. Where few are left outside the
largest class, these are compared with the others directly; members of other buckets get the
signatures of a second, independent cut of the domain among themselves, and so on until no bucket
has two classes left to compare. What counts as few grows from round to round, so this ends.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import _spread
from .common import bitmap, discard, in_bitmap, mixed, settle, small_batches, stored, table, text_blocks, tidied
from .components import components
from .spans import windows, words

#: Shingle size in words; links need 100 * intersection >= 80 * union, which is 9 * differing <= sum of sizes.
SHINGLE = 5
#: Largest size of a band over that of the band before it.
BAND = 1.6
#: Parts beyond k + 1, so that most sets can do without parts of common shingles only.
SPARE = 1.1
#: Members of a bucket outside its largest class that are compared directly once its leader is done; eight times as many in each further round.
SMALL = 24
#: Sizes of the filters: 2 to this power bits (2 MB and 8 MB).
ROW_BITS, REPEATED_BITS = 24, 26


def band_limits() -> np.ndarray:
    """The largest set size of each band."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


LIMITS = band_limits()


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's start (and the end).

    A text of one to four words has its whole word sequence as its only shingle.
    """
    h, first = words(texts)[:2]
    count = np.diff(first)
    runs = windows(h, SHINGLE)
    last = np.repeat(first[1:], count)
    at = np.flatnonzero(np.arange(len(runs)) + SHINGLE <= last[: len(runs)])
    text = np.repeat(np.arange(len(texts)), count)[at]
    value = runs[at]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    text = np.concatenate([text, short])
    value = np.concatenate([value, *(windows(h[first[t] : first[t + 1]], int(count[t])) for t in short)])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[at[1:]] - total[at[:-1]]


def digests(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    return _sums(mixed(value), at), _sums(mixed(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)


def sketch(value: np.ndarray) -> bytes:
    """Parity bits of a set, twice as many as shingles, rounded up to a power of two."""
    bits = max(64, 1 << int(2 * len(value) - 1).bit_length()) if len(value) else 64
    odd = np.bincount((mixed(value + np.uint64(12345)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles that are in one of two sets only, from their sketches."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def schemes(value: np.ndarray, at: np.ndarray, common: np.ndarray, cut: int):
    """Signatures of many sets (hashes in a row, where each set starts): rows of ``set, part, need`` and their signatures.

    A row is a set in its band or, if larger partners may be there, in the next one. A part that
    holds common shingles only is left out when more parts hold other shingles than the set and any
    partner of it can differ in: one of those parts is then the same in both. ``need`` of the row's
    signatures at least are those of any partner too: all parts with other shingles but the
    ``differ`` in which both can differ. Returned are the three columns, the number of signatures of
    each row and the signatures; ``part`` tells the rows of a set apart.
    """
    out = []
    every = np.diff(at)
    for ahead in (0, 1):
        band = np.searchsorted(LIMITS, every)
        own = np.flatnonzero((every > 0) & ((ahead == 0) | (4 * (LIMITS[band] + 1) <= 5 * every)))
        if not len(own):
            continue
        size, band = every[own], band[own] + ahead
        largest = LIMITS[band]
        k = 2 * largest // 9
        parts = np.where(k > 0, np.maximum(k + 1, ((k + 1) * SPARE).astype(np.int64)), 1)
        base = np.cumsum(parts) - parts
        row, shingle = np.repeat(np.arange(len(own)), size), _spread(at[:-1][own], size)
        v, rarer = value[shingle], ~common[shingle]
        slot = base[row] + (mixed(v + np.uint64(1 + 1_000_003 * cut)) % parts[row].astype(np.uint64)).astype(np.int64)
        n = int(parts.sum())
        held = np.bincount(slot, minlength=n) > 0
        rare = np.bincount(slot[rarer], minlength=n) > 0
        n_held, n_rare = (np.add.reduceat(x.astype(np.int64), base) for x in (held, rare))
        differ = (size + np.minimum(largest, 5 * size // 4)) // 9
        total = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(total, slot, mixed(v))
        of = np.repeat(np.arange(len(own)), parts)
        mark = mixed((np.arange(n) - base[of] + (band << 40)[of] + (cut << 50)).astype(np.uint64))
        use = np.where((n_rare > differ)[of], rare, held)
        out.append((own, 2 * band, np.maximum(n_rare - differ, 0), np.add.reduceat(use.astype(np.int64), base), mixed(total ^ mark)[use]))
        # the part that is the same in both sets may be an empty one: see ``lonely``
        few = np.flatnonzero((parts > 1) & (n_held < parts) & (n_held <= differ))
        more = [lonely(value[at[own[j]] : at[own[j] + 1]], int(band[j]), cut) for j in few.tolist()]
        if more:
            out.append((own[few], 2 * band[few] + 1, np.zeros(len(few), np.int64), np.array(list(map(len, more))), np.concatenate(more)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def signatures(value: np.ndarray, common: np.ndarray, cut: int) -> np.ndarray:
    """All signatures of one set."""
    return schemes(value, np.array([0, len(value)]), common, cut)[4]


def lonely(value: np.ndarray, band: int, cut: int) -> np.ndarray:
    """Extra signatures of a set for which all parts that are the same in a partner may be empty.

    That needs at least as many differing shingles as parts that hold any. Such a set also gives
    the smallest ``size - least overlap + 1`` shingles (prefix filter): two sets that link share one.
    """
    size = len(value)
    least = -(-4 * size // 5)  # a partner shares at least four fifths of the set
    return mixed(np.sort(mixed(value))[: size - least + 1] ^ np.uint64((band << 40) + (cut << 50) + 7))


def _lists(sigs: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(sigs.view(np.int64)))


def _profile(df: DataFrame) -> DataFrame:
    """Two kinds of rows: ``doc, row, node, n`` of each text, and the signature rows of its set (with ``part``).

    ``node`` is a digest of the set and names it from here on. Equal sets of one task give their
    signatures once; rows without id give none.
    """
    kind = df.schema["doc"].dataType.simpleString()
    names = ["doc", "row", "node", "n", "part", "need", "sigs"]

    @tidied
    def run(batches):
        seen: set = set()
        for batch in batches:
            for part, texts in text_blocks(batch, 2):
                value, at = shingle_sets(texts)
                node, size = digests(value, at)[0], np.diff(at)
                none = [pa.nulls(len(texts), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node.view(np.int64)), pa.array(size), *none], names)
                if len(seen) > 50_000:
                    seen.clear()
                new = np.zeros(len(texts), bool)
                for k in np.flatnonzero((size > 0) & part.column(0).is_valid().to_numpy(zero_copy_only=False)).tolist():
                    new[k] = int(node[k]) not in seen
                    seen.add(int(node[k]))
                held = np.repeat(new, size)
                value = value[held]
                own, band, need, count, sigs = schemes(value, np.concatenate([[0], np.cumsum(size * new)]), np.zeros(len(value), bool), 0)
                col = [pa.nulls(len(own), part.column(0).type), part.column(1).take(pa.array(own)), pa.array(node[own].view(np.int64)), pa.array(size[own])]
                yield pa.RecordBatch.from_arrays([*col, pa.array(band), pa.array(need), _lists(sigs, count)], names)

    return df.select("doc", "row", "text").mapInArrow(run, f"doc {kind}, row long, node long, n long, part long, need long, sigs array<long>")


def _again(sets: DataFrame, cut: int) -> DataFrame:
    """Signature rows of sets by another cut."""
    names = ["row", "node", "part", "need", "sigs"]

    @tidied
    def run(batches):
        for batch in batches:
            each = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(1)]
            value, at = np.concatenate([np.zeros(0, np.uint64), *each]), np.cumsum([0, *map(len, each)])
            own, band, need, count, sigs = schemes(value, at, np.zeros(len(value), bool), cut)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int64)), batch.column(0).take(pa.array(own)), pa.array(band), pa.array(need), _lists(sigs, count)], names)

    return sets.select("node", "held").mapInArrow(run, "row long, node long, part long, need long, sigs array<long>")


def _shared(rows: DataFrame, known) -> DataFrame:
    """Signature rows cut to the signatures in a filter; those with fewer than ``need`` of them go, as they have no partner."""
    names = ["row", "node", "part", "need", "sigs"]

    @tidied
    def run(batches):
        words_known = known.value
        for batch in batches:
            lists = batch.column(4)
            sigs, count = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
            hit = in_bitmap(sigs, words_known)
            ends = np.cumsum(count)
            so_far = np.concatenate([[0], np.cumsum(hit)])
            got = so_far[ends] - so_far[ends - count]
            keep = got >= np.maximum(batch.column(3).to_numpy(), 1)
            col = [batch.column(k).filter(pa.array(keep)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*col, _lists(sigs[hit & np.repeat(keep, count)], got[keep])], names)

    return rows.select("row", "node", "part", "need", "sigs").mapInArrow(run, "row long, node long, part long, need long, sigs array<long>")


def _members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sig, doc`` of the buckets with two sets or more, and the signature rows that may have partners.

    A set has no partner if fewer of its signatures than a partner must share (``need``) are those of
    another set too. Of the others, ``need - 1`` can be left out: in any one order of all signatures
    the first that two partners share is among the rest of both. The order is that of the number of
    sets, so the largest buckets are left out. Of buckets with the same sets one is kept; buckets
    count as the same by their size, smallest and largest set and the exclusive or of the hashes of
    their sets.
    """
    spark = rows.sparkSession
    several = rows.select(F.explode("sigs").alias("sig"), "node").repartition("sig").groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    sent = spark.sparkContext.broadcast(bitmap(several.where("least < most"), "sig", REPEATED_BITS))
    settle(spark)
    with small_batches(spark, 1_000):
        kept = stored(_shared(rows, sent).dropDuplicates(["node", "part"]))
    sent.destroy()
    flat = kept.select(F.explode("sigs").alias("sig"), "node", "part", "need")
    often = flat.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    ranked = flat.join(often, "sig").groupBy("node", "part", "need").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("held"))
    ranked = ranked.where("size(held) >= need").select(F.col("node").alias("doc"), F.expr("slice(held, 1, size(held) - greatest(need - 1, 0)).sig").alias("sigs"))
    flat = stored(ranked.select(F.explode("sigs").alias("sig"), "doc"))
    settle(spark)
    of = flat.groupBy("sig").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("s"))
    once = of.where("least < most").groupBy("least", "most", "n", "s").agg(F.min("sig").alias("sig")).select("sig")
    out = stored(flat.join(once, "sig", "left_semi"))
    discard(flat)
    settle(spark)
    return out, kept


def _sets(df: DataFrame, kept: DataFrame) -> DataFrame:
    """``node, n, sketch, held`` of the sets in signature rows, from the text of one row of each."""
    spark = df.sparkSession
    asked = stored(kept.groupBy("node").agg(F.min("row").alias("row")))
    sent = spark.sparkContext.broadcast(bitmap(asked, "row", ROW_BITS))
    names = ["node", "n", "sketch", "held"]

    @tidied
    def run(batches):
        words_asked = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(batch.column(0).to_numpy().view(np.uint64), words_asked)))
            for _, texts in text_blocks(batch, 1):
                value, at = shingle_sets(texts)
                each = [value[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                col = [pa.array(digests(value, at)[0].view(np.int64)), pa.array(np.diff(at)), pa.array(list(map(sketch, each)), pa.binary())]
                yield pa.RecordBatch.from_arrays([*col, pa.array([x.astype("<u8").tobytes() for x in each], pa.binary())], names)

    found = df.select("row", "text").mapInArrow(run, "node long, n long, sketch binary, held binary")
    with small_batches(spark, 1_000):
        out = stored(found.join(asked.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]))
    sent.destroy()
    discard(asked)
    settle(spark)
    return out


def _joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """The component table with more links; a component so far goes in as links of its members to its name."""
    if links.isEmpty():
        discard(links)
        return named
    out = components(links.unionByName(named.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    discard(links)
    discard(named)
    settle(named.sparkSession)
    return out


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link: by size and sketch first, then by their shingles."""
    side = sets.select("node", "n", "sketch")

    @tidied
    def by_sketch(batches):
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            keep = [9 * differing(x.as_buffer(), y.as_buffer()) <= s for x, y, s in zip(batch.column(3), batch.column(5), n.tolist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    near = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    near = near.join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b").where("5 * na >= 4 * nb and 5 * nb >= 4 * na")
    with small_batches(pairs.sparkSession, 1_000):
        near = stored(near.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(by_sketch, "a long, b long"))

    @tidied
    def by_set(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both) > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    held = sets.select("node", "held").join(ends, "node", "left_semi")
    full = near.join(held.select(F.col("node").alias("a"), F.col("held").alias("ha")), "a").join(held.select(F.col("node").alias("b"), F.col("held").alias("hb")), "b")
    with small_batches(pairs.sparkSession, 50):  # a row holds two whole sets
        out = stored(full.select("a", "b", "ha", "hb").mapInArrow(by_set, "a long, b long"))
    discard(near)
    settle(pairs.sparkSession)
    return out


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row of the table.

    A text is lower-cased (A-Z) and cut into words at space and bytes 9 to 13; its set holds its
    distinct runs of five words, a shorter text's only shingle is its word sequence. Null, empty and
    blank texts have no shingles and link with nothing. Two documents link when
    100 * intersection >= 80 * union; ``component_id`` is the smallest id reachable by links. Repeated
    rows stay and share their component; rows without id have none. An empty table gives no rows;
    other columns are not read.
    """
    spark = documents.sparkSession
    df = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    with small_batches(spark, 1_000):  # rows carry whole texts
        found = stored(_profile(df))
    profile = stored(found.where("part is null").select("doc", "node", "n"))
    own = profile.where("n > 0 and doc is not null").select("doc", "node")

    # sets of rows with one id are in one class
    several = own.groupBy("doc").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("doc", F.col("least").alias("component"))
    named = stored(own.join(several, "doc").where("node <> component").select("node", "component").distinct())
    named = _joined(named, stored(named.select(F.col("component").alias("a"), F.col("node").alias("b"))))

    members, kept = _members(found.where("part is not null"))
    discard(found)
    sets, cut = _sets(df, kept), 0
    discard(kept)
    while True:
        step = _round(members, named, cut)
        if step.isEmpty():
            break
        named = _joined(named, _similar(step, sets))
        discard(step)
        left = stored(_left(members, named, cut))
        discard(members)
        small = SMALL << (3 * cut)
        pairs = stored(_direct(left, small))
        named = _joined(named, _similar(pairs, sets))
        discard(pairs)
        cut += 1
        large = left.where(F.col("minor") > small)
        if large.isEmpty():
            break
        asked = stored(large.select(F.col("doc").alias("node")).distinct())
        discard(left)
        with small_batches(spark, 100):
            rows = stored(_again(sets.join(asked, "node", "left_semi"), cut))
        discard(asked)
        members, kept = _members(rows)
        discard(rows)
        discard(kept)
    discard(sets)
    settle(spark)

    label = own.join(named, "node", "left").select("doc", F.coalesce("component", "node").alias("component"))
    label = stored(label.distinct())
    first = stored(label.groupBy("component").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("component", "first"))
    label = label.join(first, "component").where("doc <> first").select("doc", "first")
    return profile.join(label, "doc", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first", "doc").alias("component_id"),
    )


def _labelled(members: DataFrame, named: DataFrame) -> DataFrame:
    label = named.select(F.col("node").alias("doc"), "component")
    return members.join(label, "doc", "left").select("sig", "doc", F.coalesce("component", "doc").alias("label"))


def _order(cut: int):
    """Another order of the documents in each round, so that leaders change."""
    return F.struct(F.xxhash64(F.col("doc"), F.lit(cut)).alias("h"), F.col("doc").alias("doc"))


def _round(members: DataFrame, named: DataFrame, cut: int) -> DataFrame:
    """Pairs of each bucket's leader with its members of other classes."""
    rows = _labelled(members, named)
    lead = rows.groupBy("sig").agg(F.min(_order(cut)).alias("lead"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("sig", F.col("lead.doc").alias("lead"))
    ahead = _labelled(lead.select("sig", F.col("lead").alias("doc")), named).select("sig", F.col("doc").alias("lead"), F.col("label").alias("of"))
    pairs = rows.join(ahead, "sig").where("label <> of")
    return stored(pairs.select(F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b")).distinct())


def _left(members: DataFrame, named: DataFrame, cut: int) -> DataFrame:
    """Members other than the leader, of buckets that hold two classes without it.

    ``major`` is the class with most members of the bucket, ``minor`` the number of members of
    other classes. Of buckets with the same members one is kept.
    """
    rows = _labelled(members, named)
    lead = rows.groupBy("sig").agg(F.min(_order(cut)).alias("lead")).select("sig", F.col("lead.doc").alias("lead"))
    rest = rows.join(lead, "sig").where("doc <> lead").select("sig", "doc", "label")
    of = rest.groupBy("sig", "label").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("s"))
    open_ = of.groupBy("sig").agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top"), F.bit_xor("s").alias("s"), F.count("*").alias("labels")
    ).where("labels > 1")
    once = open_.groupBy("size", "s").agg(F.min(F.struct("sig", "top")).alias("b"))
    once = once.select(F.col("b.sig").alias("sig"), F.col("b.top.label").alias("major"), (F.col("size") - F.col("b.top.n")).alias("minor"))
    return rest.join(once, "sig")


def _direct(left: DataFrame, small: int) -> DataFrame:
    """Pairs of the members outside a bucket's largest class with all members of other classes, where they are at most ``small``."""
    few = left.where(F.col("minor") <= small)
    other = few.select("sig", F.col("doc").alias("b"), F.col("label").alias("of"))
    pairs = few.where("label <> major").select("sig", F.col("doc").alias("a"), "label").join(other, "sig").where("label <> of")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def query(spark, folder):
    """op7: shingle count and component of every document."""
    return classes(table(spark, folder, "documents"))
