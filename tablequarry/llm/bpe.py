"""Byte-level BPE over Arrow batches: split, byte-to-character mapping, merges, offsets, decoding.

The splits of the public pattern are found with numpy over code point classes; each distinct
piece goes through the tokenizers library once and a bounded cache keeps its ids.
"""

import base64
import codecs
import functools
import json
import unicodedata

import numpy as np

from .common import mixed

LETTER, NUMBER, SPACE = 1, 2, 3
# Code points with the Unicode property White_Space.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: A worker keeps the ids of half of 2 to this power pieces at most (about 60 MB).
CACHE_BITS = 21


@functools.cache
def _classes() -> np.ndarray:
    """Letter, number, white space or other (0), by code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    out[SPACES] = SPACE
    return out


def piece_starts(cp: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of the public split pattern start in code points ``cp``; texts start at ``begins``.

    A piece is a run of letters, numbers or other marks with one space before it, an English
    contraction, or white space without the space that belongs to the next run.
    """
    n = len(cp)
    kind = _classes()[cp]
    new = np.zeros(n + 3, bool)  # a text starts here
    new[begins] = True
    new[n:] = True
    first = new[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~new[1:n])
    first[last] = True
    first[last[cp[last] == 32] + 1] = False
    mark = np.flatnonzero((cp == 39) & first)
    if len(mark):
        after = np.concatenate([cp, np.zeros(3, cp.dtype)])
        one = ~new[mark + 1] & np.isin(after[mark + 1], [ord(c) for c in "stmd"])
        pair = after[mark + 1].astype(np.uint64) << np.uint64(32) | after[mark + 2].astype(np.uint64)
        two = ~new[mark + 1] & ~new[mark + 2] & np.isin(pair, np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")], np.uint64))
        first[mark[one | two] + 1] = False
        more = np.concatenate([mark[one] + 2, mark[two] + 3])
        first[more[more < n]] = True
    return np.flatnonzero(first)


class HashTable:
    """Numbers of 64-bit hashes, in open-addressing numpy arrays: entry k is the k-th hash added."""

    def __init__(self, bits: int):
        self.mask, self.most = np.uint64((1 << bits) - 1), 1 << (bits - 1)
        self.clear()

    def clear(self):
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        self.n = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        at = h & self.mask
        out = self.slot[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        out[left] = -1
        step = 1
        while len(left):
            at = (h[left] + np.uint64(step)) & self.mask
            entry = self.slot[at]
            hit = (entry >= 0) & (self.keys[at] == h[left])
            out[left[hit]] = entry[hit]
            left = left[(entry >= 0) & ~hit]
            step += 1
        return out

    def place(self, h: np.ndarray) -> np.ndarray:
        """Entries for new distinct hashes; at most ``most`` may be held."""
        entry = np.arange(self.n, self.n + len(h), dtype=np.int32)
        left, step = np.arange(len(h)), 0
        while len(left):
            at = (h[left] + np.uint64(step)) & self.mask
            free = self.slot[at] < 0
            self.slot[at[free]] = entry[left[free]]  # of two that want a place, one stays
            won = free & (self.slot[at] == entry[left])
            self.keys[at[won]] = h[left[won]]
            left, step = left[~won], step + 1
        self.n += len(h)
        return entry


class Seen(HashTable):
    """Ids of pieces by hash."""

    def clear(self):
        super().clear()
        self.used = 0
        self.start, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)

    def add(self, h: np.ndarray, ids: list[np.ndarray]):
        """New distinct hashes and their ids."""
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        more = np.concatenate(ids)
        while self.n + len(h) > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(more) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        entry = self.place(h)
        self.start[entry] = self.used + np.cumsum(count) - count
        self.count[entry] = count
        self.flat[self.used : self.used + len(more)] = more
        self.used += len(more)


# Odd multiplier of the rolling piece hash and its inverse modulo 2^64.
STEP = 0x9E3779B97F4A7C15 | 1
BACK = pow(STEP, -1, 1 << 64)


@functools.cache
def _weights() -> np.ndarray:
    """A fixed 64-bit weight for each byte."""
    return mixed(np.arange(256, dtype=np.uint64))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, STEP, np.uint64), np.full(n, BACK, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def span_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, alike for like bytes at any place."""
    up, down = _powers(1 << max(21, int(len(raw)).bit_length()))
    with np.errstate(over="ignore"):
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_weights()[raw] * up[: len(raw)], out=run[1:])
        return mixed((run[ends] - run[begins]) * down[begins] ^ (ends - begins).astype(np.uint64))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def cut_place(raw: np.ndarray, near: int) -> int:
    """A place after ``near`` where a piece surely starts (a space between two ASCII letters), else the end."""
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    while near < len(raw) - 2:
        part = raw[near : near + (1 << 16) + 2]
        found = np.flatnonzero((part[1:-1] == 32) & letter[part[:-2]] & letter[part[2:]])
        if len(found):
            return near + 1 + int(found[0])
        near += 1 << 16
    return len(raw)


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


@functools.cache
def char_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_chars())}


class Bpe:
    """A byte-level BPE coder for one vocabulary file; made once per worker by ``coder``."""

    def __init__(self, model, tokens: list[bytes]):
        self.model, self.tokens = model, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.all_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.shown = {b: c for b, c in enumerate(byte_chars())}
        self.seen = Seen(CACHE_BITS)

    def piece(self, raw: bytes) -> np.ndarray:
        """Ids of one piece, from the tokenizers library."""
        return np.array([t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.shown))], np.uint32)

    def _block(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other from the byte places ``begins`` on, and the ids before each."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(begins), np.int64)
        cp = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        text_at = np.searchsorted(place, begins)
        at = piece_starts(cp, text_at[text_at < len(cp)])
        starts = place[at]
        ends = np.append(starts[1:], len(raw))
        h = span_hashes(raw, starts, ends)
        entry = self.seen.find(h)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            if self.seen.n + len(lost) > self.seen.most:
                self.seen.clear()
                lost = np.arange(len(h))
            new, where = np.unique(h[lost], return_index=True)
            held = raw.tobytes()
            where = lost[where]
            self.seen.add(new, [self.piece(held[a:b]) for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            entry[lost] = self.seen.find(h[lost])
        count = self.seen.count[entry]
        ids = self.seen.flat[_spread(self.seen.start[entry], count)]
        if not np.array_equal(self._decoded(ids), raw):  # two pieces with one hash: each piece on its own
            held = raw.tobytes()
            each = [self.piece(held[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            ids, count = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        before = np.concatenate([[0], np.cumsum(count)])
        return ids, before[np.searchsorted(at, text_at)]

    def encode_all(self, texts: list[bytes], most: int = 1 << 20):
        """The ids of each text in turn; blocks of about ``most`` bytes bound the memory, also inside a long text."""
        held, size = [], 0
        for t in texts:
            if size + len(t) > most and held:
                yield from self._texts(held)
                held, size = [], 0
            if len(t) > most:
                yield self._long(t, most)
            else:
                held.append(t)
                size += len(t)
        yield from self._texts(held)

    def _texts(self, texts: list[bytes]):
        if texts:
            begins = np.cumsum([0, *map(len, texts)])
            ids, before = self._block(np.frombuffer(b"".join(texts), np.uint8), begins[:-1])
            yield from np.split(ids, before[1:])

    def _long(self, text: bytes, most: int) -> np.ndarray:
        raw, at, out = np.frombuffer(text, np.uint8), 0, []
        while at < len(raw):
            to = cut_place(raw, at + most)
            out.append(self._block(raw[at:to], np.array([0]))[0])
            at = to
        return np.concatenate(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; every piece is merged on its own."""
        return next(self.encode_all([text.encode("utf-8", "surrogatepass")]))

    def _decoded(self, ids: np.ndarray) -> np.ndarray:
        return self.all_bytes[_spread(self.places[ids], self.sizes[ids])]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character that each id has bytes of; ids that split a character share it."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte place
        ends = np.cumsum(self.sizes[ids])
        begins = ends - self.sizes[ids]
        return np.maximum(chars[np.minimum(begins + 1, len(raw))] - 1, 0), chars[ends]

    def decode_bytes(self, ids) -> bytes:
        return self._decoded(np.asarray(ids, np.int64)).tobytes()

    def decode_parts(self, ids) -> list[str]:
        """The text that becomes complete with each id: a split character appears with its last id,
        bytes that are no character as the replacement mark."""
        step = codecs.getincrementaldecoder("utf-8")("replace")
        out = [step.decode(self.tokens[i]) for i in np.asarray(ids).tolist()]
        rest = step.decode(b"", True)
        if rest and out:
            out[-1] += rest
        return out


def rank_merges(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """The merges that a rank table implies: every pair of tokens that forms a token, in the order of its rank."""
    shown = byte_chars()
    text = {t: "".join(shown[b] for b in t) for t in ranks}
    out = []
    for token in sorted(ranks, key=ranks.__getitem__):
        pairs = [(token[:k], token[k:]) for k in range(1, len(token))]
        pairs = [(a, b) for a, b in pairs if a in ranks and b in ranks]
        out += [(text[a], text[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    return out


@functools.cache
def coder(path: str) -> Bpe:
    """The coder of a ``.tiktoken`` rank file or of a ``tokenizers`` JSON file with a byte-level BPE model."""
    from tokenizers import models

    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        shown = byte_chars()
        vocab = {"".join(shown[b] for b in t): i for t, i in ranks.items()}
        model = models.BPE(vocab=vocab, merges=rank_merges(ranks), ignore_merges=True, cache_capacity=0)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        return Bpe(model, tokens)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["merges"]]
    model = models.BPE(vocab=parts["vocab"], merges=merges, ignore_merges=bool(parts.get("ignore_merges")), cache_capacity=0)
    back = char_bytes()
    tokens = [b""] * (max([*parts["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for t, i in parts["vocab"].items():
        tokens[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    for t in spec["added_tokens"]:
        tokens[t["id"]] = t["content"].encode()
    return Bpe(model, tokens)
