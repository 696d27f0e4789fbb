"""Corpus operators beside brute force, round trips and held-out accuracy, and their odd inputs."""

import base64
import collections
import hashlib
import itertools
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablequarry.llm import bpe, bpe_text, chat, decontaminate, licenses, packed, partenum, quality, queries, repetition, suffixes, toxicity
from tablequarry.llm.common import shared_folder, stored

FOLDER = os.environ.get("TABLEQUARRY_DATA", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long, repeated and strange texts, with columns whose names may clash."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same text here"), (6, "same text here"), (6, "same text here"), (7, "a\u0000b é 日本 \U0001F600 �"),
        (8, "x" * 50_000), (9, "one two three four five six seven eight " * 40), (None, "no id but a text"), (10, "\\ [ROLE] </s> <|endoftext|>"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "doc", "ids", "hash", "sig", "score", "mark", "n", "words", "name"):
        frame = frame.withColumn(name, F.lit(name))
    return frame


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- byte-level BPE -------------------------------------------------------------


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def strange_texts():
    draw = random.Random(5)
    parts = ["a", "'s", "'", "'ll", "d", " ", "  ", "\n", "é", "ß", "日本", "1", "२", "!", "..", "　", "\U0001F600", "\r\n", "'ve", "The", " and"]
    out = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(500)]
    return out + ["".join(draw.choice("aeth nis") for _ in range(60)) for _ in range(300)]


def test_bpe_as_tiktoken(public, strange_texts):
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.coder(path)
    ids = list(coder.encode_all([t.encode() for t in strange_texts], most=700))
    assert [i.tolist() for i in ids] == [other.encode_ordinary(t) for t in strange_texts]
    for t, i in zip(strange_texts, ids):
        assert coder.decode_bytes(i) == t.encode()
        assert "".join(coder.decode_parts(i)) == t
        a, b = coder.offsets(t, i)
        assert all(x < y for x, y in zip(a, b)) and (not len(a) or (a[0] == 0 and b[-1] == len(t)))


def test_bpe_as_tokenizers(public, strange_texts):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    other.encode_special_tokens = True
    assert [bpe.coder(path).encode(t).tolist() for t in strange_texts] == [other.encode(t, add_special_tokens=False).ids for t in strange_texts]


def test_bpe_hash_collisions_are_found(public, monkeypatch):
    coder = bpe.Bpe(*(lambda c: (c.model, c.tokens))(bpe.coder(public.path("byte_bpe_50k.json"))))
    want = coder.encode("alpha beta gamma alpha").tolist()
    coder.seen.clear()
    monkeypatch.setattr(bpe, "span_hashes", lambda raw, a, b: np.ones(len(a), np.uint64))
    assert coder.encode("alpha beta gamma alpha").tolist() == want


def test_bpe_frame(odd, public):
    path = public.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_text.encode(odd, path, offsets=True, decoded=True)
    assert coded.columns == ["doc_id", "ids", "n_tokens", "begins", "ends", "decoded"]
    want = sorted((d or 0, t.encode()) for d, t in texts(odd))
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in coded.collect()) == want
    back = bpe_text.decode(coded, path, keep=("n_tokens",)).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in back) == want
    assert bpe_text.encode(odd.limit(0), path).count() == 0


# ---- packed ids -------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_pack(bits):
    draw = np.random.RandomState(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = draw.randint(0, 1 << bits, n, dtype=np.uint64)
        raw = packed.pack(ids, bits)
        assert len(raw) == -(-n * bits // 8)
        assert packed.unpack(raw, n, bits).tolist() == ids.tolist()


def test_packed_file(tmp_path):
    draw = np.random.RandomState(1)
    docs = [draw.randint(0, 50_257, n) for n in (5, 0, 300, 1000, 1)]
    file = packed.Writer(str(tmp_path / "x.tqpack"), 16, block=128)
    for k, d in enumerate(docs):
        file.add(k, d)
    assert not (tmp_path / "x.tqpack").exists()
    file.close()
    read = packed.Reader(str(tmp_path / "x.tqpack"))
    every = np.concatenate(docs)
    assert read.starts.tolist() == [0, 5, 5, 305, 1305] and read.doc_ids.tolist() == [0, 1, 2, 3, 4]
    for a, n in ((0, len(every)), (127, 2), (300, 600), (1305, 1), (7, 0)):
        assert read.ids(a, n).tolist() == every[a : a + n].tolist()
    with pytest.raises(IndexError):
        read.ids(1300, 10)
    with pytest.raises(ValueError):
        packed.Writer(str(tmp_path / "y.tqpack"), 4).add(0, np.array([16]))


def test_packed_frame(spark, odd, public):
    path = public.path("byte_bpe_50k.json")
    to = shared_folder(spark)
    rows = packed.read_packed(packed.write_packed(odd, path, to), to).collect()
    rows.sort(key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]
    given = collections.defaultdict(list)
    for d, t in texts(odd):
        given[d].append([*bpe.coder(path).encode(t).tolist(), 0])
    at = 0
    for r in rows:
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() in given[r.doc_id]
        at += r.n_tokens
    assert packed.read_packed(packed.write_packed(odd.limit(0), path, to + "-none"), to + "-none").count() == 0


# ---- repetition -------------------------------------------------------------------


def base_rule(text):
    w = plain_words(text)
    lines = [x for x in text.split("\n") if plain_words(x)]
    runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = [False] * len(w)
    for i in range(len(w) - 7):
        if runs[tuple(w[i : i + 8])] > 1:
            inside[i : i + 8] = [True] * 8
    n = sum(inside)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


def covers(text):
    w = plain_words(text)
    total = sum(map(len, w))
    out = []
    for n in repetition.RUN_LIMITS:
        runs = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        inside = {j for i in range(len(w) - n + 1) if runs[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append(sum(len(w[j]) for j in inside) / total if total else 0.0)
    lines = [x for x in text.split("\n") if plain_words(x)]
    again = collections.Counter(lines)
    size = sum(len(x.encode()) for x in lines)
    return out, sum(len(x.encode()) for x in lines if again[x] > 1) / size if size else 0.0


@needs_data
def test_repetition(docs, odd):
    for frame in (docs, odd):
        given = collections.Counter()
        for d, t in texts(frame):
            cover, line = covers(t)
            base = base_rule(t)
            kept = not base[-1] and line <= repetition.LINE_LIMIT and all(c <= m for c, m in zip(cover, repetition.RUN_LIMITS.values()))
            given[(d, *base, kept, round(line, 9), *(round(c, 9) for c in cover))] += 1
        found = collections.Counter(
            (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.line_cover, 9), *(round(c, 9) for c in r.cover))
            for r in repetition.repetition(frame).collect()
        )
        assert found == given
    assert repetition.repetition(odd.limit(0)).count() == 0


# ---- chat and licences: SQL twins -------------------------------------------------


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in cur.fetchall()), key=repr)
    found = queries.QUERIES[name](spark, FOLDER).select(*names).collect()
    assert sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found), key=repr) == want


def test_chat(spark):
    marks = list(chat.INSTRUCT.controls)
    draw = random.Random(2)
    pieces = [*marks, "\\", "\\\\", "<", "[", "/", "s>", "é", "\n", "INST]", "<s", "$1"]
    rows = []
    for c in range(60):
        for k in range(draw.randint(1, 5)):
            rows.append((c, draw.choice([k, 0, None]), draw.choice(["user", "assistant", "system", "tool", "", None, "</s>\n"]), draw.choice([None, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 8)))])))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    made = chat.formatted(frame)
    back = made.select("conv_id", "n_turns", chat.turns_of(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("segments")).alias("learnt")).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    for r in back:
        turns = [x[2:] for x in sorted(want[r.conv_id])]
        assert [tuple(x) for x in r.turns] == turns and r.n_turns == len(turns)
        assert r.learnt == "".join(x for role, x in turns if role == "assistant")
    assert chat.formatted(frame.limit(0)).count() == 0


def test_chat_order(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "assistant"), (3, 0, "user"), (4, 0, "user"), (4, 1, "user"), (4, 2, "assistant")]
    made = chat.formatted(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: (r.valid, r.first_bad) for r in made.collect()} == {1: (True, None), 2: (False, 0), 3: (False, None), 4: (False, 1)}


def test_chat_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(marks={"user": ("<a>", "<a>b")}, other=("[R]", "[S]", "[T]"), loss=frozenset(), order={}, last=frozenset())


def test_licences(spark, odd):
    given = [
        (1, "Licensed under the Apache License, Version 2.0."), (2, "under the GNU general\npublic-license; MIT License MIT license"), (3, "cc by"),
        (4, None), (5, "gnu general public"), (6, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (6, "nothing"),
    ]
    found = licenses.scan(stored(licenses.postings(spark.createDataFrame(given, "doc_id long, text string")))).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append((r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 3)))
    assert by[1] == [(1, 3, 3, "apache", "apache,apache-2.0", 1.0)]
    assert by[2][0][:4] == (3, 2, 8, "gpl,mit")
    assert by[3] == [(1, 0, 0, "cc-by", "cc-by", 1.0)]
    assert by[4] == by[5] == [(0, None, None, "", "", 0.0)]
    assert sorted(x[4] for x in by[6]) == ["", "mit-grant"]
    assert licenses.scan(stored(licenses.postings(odd))).count() == odd.count()
    assert licenses.scan(stored(licenses.postings(odd.limit(0)))).count() == 0


def test_license_text_full_of_key_words(spark):
    """One text of 2 MB of key phrases takes little longer than a short one: work follows the hits."""
    def scanned(text):
        files = stored(licenses.postings(spark.createDataFrame([(1, text)], "doc_id long, text string")))
        start = time.time()
        return licenses.scan(files).first(), time.time() - start

    scanned("mit license")
    _, fixed = scanned("mit license")
    row, took = scanned("mit license " * 170_000)
    assert (row.n_words, row.n_base, row.first_word, row.last_word, row.labels, row.score) == (340_000, 170_000, 0, 339_998, "mit", 1.0)
    assert took < fixed + 20


def test_license_share_beside_plain_count(spark):
    """Shares of templates whose other words stand only in part, at several starts of one text."""
    entry = next(e for e in licenses.entries() if e.label == "apache-notice")
    rng = random.Random(4)
    texts_ = []
    for _ in range(30):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = list(entry.words)
            for j in range(entry.key[1], len(words)):
                if rng.random() < rng.choice([0.1, 0.5, 0.9]):
                    words[j] = "other"
            parts += words + ["and"] * rng.randrange(3)
        texts_.append(" ".join(parts))
    frame = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(stored(licenses.postings(frame))).collect()}
    for k, text in enumerate(texts_):
        words, labels, best = text.split(), set(), 0.0
        for e in licenses.entries():
            for at in range(-len(e.words), len(words)):
                same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(e.words)]
                if all(same[e.key[0] : e.key[1]]) and (e.base or sum(same) / len(same) >= licenses.LEAST_SHARE):
                    labels.add(e.label)
                    best = max(best, sum(same) / len(same))
        assert got[k] == (",".join(sorted(labels)), round(best, 9))


# ---- classifiers ------------------------------------------------------------------


def fold(n, d):
    return zlib.crc32(str(d).encode()) % n


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
@pytest.mark.parametrize("name, label, folds, held", [("op10_quality", "quality", 5, 0), ("op3_toxicity", "toxic", 4, 2)])
def test_held_out(spark, name, label, folds, held):
    folder = "/root/testdata/sf0.1"  # enough labelled texts of each language
    rows = queries.QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (fold(folds, r.doc_id) == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    test = [(r.score, r[label]) for r in rows if r.held_out]
    good, bad = [s for s, y in test if y == 1], [s for s, y in test if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9, auc


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_odd_input(spark, odd, module, label):
    labels = spark.createDataFrame([(d, d % 2) for d in range(1, 11)] + [(None, 1), (3, None), (4, 1)], f"doc_id long, {label} int")
    model = module.fit(odd, labels)
    rows = module.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = module.fit(odd, labels.limit(0))
    assert module.score(odd, none).count() == odd.count()
    assert module.score(odd.limit(0), none).count() == 0


def test_kernel():
    def slow(a, b):  # sum over common letter triples, weighted by the lengths they span
        def spans(w):
            w = "^" + w
            out = collections.Counter()
            for i, j, k in itertools.combinations(range(len(w)), 3):
                if k - i < toxicity.SPAN:
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        x, y = spans(a), spans(b)
        return sum(v * y[t] for t, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5

    given = ["idiot", "idxiot", "moron", "banana", "abc"]
    code, starts, ends, _ = toxicity.words([" ".join(given)])
    rows = toxicity.Profiles(code, starts, ends)
    found = rows.kernels(rows)
    assert np.allclose(found, [[slow(a, b) for b in given] for a in given], atol=1e-5)
    assert toxicity.words(["i d i o t x"])[2].tolist() == [6] and toxicity.words(["i.d-i"])[2].tolist() == [3]


# ---- decontamination --------------------------------------------------------------


def test_seeds_miss_no_window():
    n, wrong = decontaminate.WINDOW, decontaminate.MOST_WRONG
    for bad in itertools.combinations(range(n), wrong):
        assert any(not {o + s for o in seed} & set(bad) for seed in decontaminate.SEEDS for s in range(n - seed[-1]))


def brute_leaks(docs, items):
    def cut(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())

    out = set()
    for (d, t), (i, u) in itertools.product(docs, items):
        a, b = cut(t), cut(u)
        size = min(len(b), decontaminate.WINDOW)
        a, b = (["-"] * decontaminate.MOST_WRONG + a + ["-"] * decontaminate.MOST_WRONG), (["+"] * decontaminate.MOST_WRONG + b + ["+"] * decontaminate.MOST_WRONG)
        if size < decontaminate.SHORTEST:
            continue
        most = size * decontaminate.MOST_WRONG // decontaminate.WINDOW
        if any(sum(x != y for x, y in zip(a[p : p + size], b[q : q + size])) <= most for p in range(len(a) - size + 1) for q in range(len(b) - size + 1)):
            out.add((d, i))
    return out


def test_decontaminate(spark, odd):
    draw = random.Random(9)
    vocabulary = ["alpha", "beta", "Gamma", "délta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi"]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([13, 14, 20, 30])))) for k in range(8)] + [(90, None), (91, "short one"), (92, "")]
    docs = []
    for d in range(60):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(0, 30))]
        if d % 2:
            leak = draw.choice(items[:8])[1].split()
            at = draw.randint(0, max(len(leak) - 13, 0))
            leak = leak[at : at + draw.randint(11, 16)]
            for _ in range(draw.randint(0, 3)):
                leak[draw.randrange(len(leak))] = "changed"
            w[5:5] = leak
        docs.append((d, " ".join(w).upper() if d % 3 else ", ".join(w)))
    docs += [(1, None), (100, ""), (None, items[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    found = decontaminate.leaks(frame, bench).collect()
    want = brute_leaks([(d, t or "") for d, t in docs], [(i, t or "") for i, t in items])
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    left = decontaminate.clean(frame, bench)
    bad = {d for d, _ in want}
    assert left.columns == frame.columns and sorted(d or -1 for d, _ in texts(left)) == sorted(d or -1 for d, _ in docs if d not in bad)
    assert decontaminate.leaks(frame.limit(0), bench).count() == decontaminate.leaks(frame, bench.limit(0)).count() == 0
    assert decontaminate.leaks(odd, bench).count() == 0


@pytest.mark.parametrize("size", range(1, 14))
def test_no_item_size_is_missed(size):
    most = size * decontaminate.MOST_WRONG // decontaminate.WINDOW
    words = np.random.RandomState(size).randint(1, 1 << 60, size).astype(np.uint64)
    first = np.array([0, size])
    item = dict(zip(*(x.tolist() for x in decontaminate._item_seeds(words, first)[::-1])))
    for bad in itertools.combinations(range(size), most):
        doc = words.copy()
        doc[list(bad)] = 0
        runs = [decontaminate.run_length(size)] if size < decontaminate.SEEDED else []
        at, hashes = decontaminate._seeds(doc, first, runs)
        assert any(item.get(x) == a for a, x in zip(at.tolist(), hashes.tolist()))


def test_short_items(spark, monkeypatch):
    draw = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(1 + k % 13))) for k in range(26)] + [(90, None), (91, "")]
    docs = []
    for d in range(130):
        leak = items[d % 26][1].split()
        if d >= 26:
            leak[draw.randrange(len(leak))] = "changed"
        before, after = ([draw.choice(["x", "y", "z"]) for _ in range(draw.choice([0, 0, 3]))] for _ in range(2))
        docs.append((d, " ".join([*before, *leak, *after])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(frame, bench).collect()
    monkeypatch.setattr(decontaminate, "SHORTEST", 1)
    want = brute_leaks(docs, [(i, t) for i, t in items if t])
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert {(d, d) for d in range(26)} <= want and len(want) > 100


# ---- near duplicates --------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for d, t in rows:
        w = plain_words(lower(t))
        sets[d] = frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    name = {d: d for d in sets}

    def root(d):
        while name[d] != d:
            d = name[d]
        return d

    holds = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holds[g].append(d)
    for d, s in sets.items():
        for e, both in collections.Counter(e for g in s for e in holds[g] if e > d).items():
            if 100 * both >= 80 * (len(s) + len(sets[e]) - both):
                a, b = root(d), root(e)
                name[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def near_copies(n=110):
    """Groups of copies with some words changed, around the limit of similarity, small sets and a common passage."""
    draw = random.Random(11)
    word = lambda: "w" + str(draw.randrange(400))
    common = [word() for _ in range(12)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(draw.choice([1, 3, 5, 6, 7, 9, 12, 20, 40, 90, 200]))]
        if draw.random() < 0.4:
            base += common
        for _ in range(draw.choice([1, 2, 3, 8])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 6])):
                at = draw.randrange(len(copy) + 1)
                copy[at : at + draw.choice([0, 1])] = [word()] * draw.choice([0, 1])
            out.append(" ".join(copy))
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("small", [5])
def test_classes(spark, monkeypatch, small):
    monkeypatch.setattr(partenum, "SMALL", small)
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.classes(frame).collect()}
    assert found == brute_classes(rows)


def test_signatures_are_shared():
    """Any two sets that link share a signature, whatever shingles are held common."""
    draw = np.random.RandomState(4)
    for _ in range(600):
        size = int(draw.choice([1, 2, 4, 5, 6, 8, 9, 10, 17, 30, 60, 150]))
        a = draw.randint(1, 1 << 62, size).astype(np.uint64)
        b = np.concatenate([a[draw.randint(0, max(size // 8, 1) + 1) :], draw.randint(1, 1 << 62, draw.randint(0, size // 8 + 2)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        assert partenum.differing(partenum.sketch(a), partenum.sketch(b)) <= len(a) + len(b) - 2 * both
        for cut, share in ((0, 0.0), (1, 0.5), (2, 1.0)):
            common = a[draw.random_sample(len(a)) < share]
            one, two = (partenum.signatures(x, np.isin(x, common), cut) for x in (a, b))
            assert len(np.intersect1d(one, two))


def test_sets_without_partner_give_no_candidates(spark):
    """Texts that share a quarter of their words with others are not paired; of near copies only the rarest signatures are."""
    word = lambda d, n: " ".join(f"{d}x{i}" for i in range(n))
    rows = [(d, word("same", 80) + " " + word(d, 220)) for d in range(40)]
    rows += [(100 + d, word("near", 300) + " " + word(100 + d, 10)) for d in range(3)]
    frame = spark.createDataFrame(rows, "doc long, text string").withColumn("row", F.xxhash64("doc", "text"))
    found = stored(partenum._profile(frame))
    members, kept = partenum._members(found.where("part is not null"))
    nodes = {r.node for r in found.where("doc >= 100").collect()}
    assert {r.doc for r in members.collect()} == nodes and nodes <= {r.node for r in kept.collect()}
    whole = found.where("part is not null").selectExpr("node", "size(sigs) as n").groupBy("node").sum("n").collect()
    assert members.count() < sum(r[1] for r in whole if r.node in nodes) / 2
    out = {r.doc: r.component_id for r in partenum.classes(frame, "doc").collect()}
    assert out == {d: 100 if d >= 100 else d for d, _ in rows}


def test_shared_signatures_are_as_many_as_needed():
    """Two sets that link share at least ``need`` signatures of a row of one size band, in each cut."""
    draw = np.random.RandomState(7)
    for _ in range(300):
        size = int(draw.choice([9, 17, 30, 60, 150, 400]))
        a = np.unique(draw.randint(1, 1 << 62, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.randint(0, size // 9 + 1) :], draw.randint(1, 1 << 62, draw.randint(0, size // 9 + 1)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        for cut in (0, 1):
            met = 0
            rows = []
            for x in (a, b):
                _, part, need, count, sigs = partenum.schemes(x, np.array([0, len(x)]), np.zeros(len(x), bool), cut)
                rows.append({p: (n, s) for p, n, s in zip(part.tolist(), need.tolist(), np.split(sigs, np.cumsum(count)[:-1]))})
            for p in rows[0].keys() & rows[1].keys():
                (m, x), (n, y) = rows[0][p], rows[1][p]
                met += len(np.intersect1d(x, y)) >= max(m, n, 1)
            assert met


def test_classes_odd_input(spark, odd):
    rows = partenum.classes(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[5] == by[6] == {(1, 5)} and by[None] == {(1, None)}
    assert partenum.classes(odd.limit(0)).count() == 0


# ---- repeats ----------------------------------------------------------------------


def brute_removed(rows, length=suffixes.LENGTH):
    seen = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = collections.Counter()
    for d, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[(d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept)] += 1
    return out


def test_repeats(spark):
    draw = random.Random(3)
    noise = lambda n: "".join(draw.choice("abcdefgh é\n") for _ in range(n))
    parts = [noise(n) for n in (380, 399, 400, 401, 460, 900, 2000)] + ["ab" * 300, " " * 900]
    rows = []
    for d in range(40):
        rows.append((d, "".join(draw.choice([noise(draw.randint(0, 300)), draw.choice(parts)[draw.randint(0, 40) :]]) for _ in range(draw.randint(0, 6)))))
    rows += [(40, rows[5][1]), (41, None), (42, ""), (43, parts[5] + parts[5]), (43, parts[5]), (None, parts[6])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(1)).withColumn("starts", F.lit(2))
    found = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.removed(frame).collect())
    assert found == brute_removed([(d, (t or "").encode()) for d, t in rows])
    left = suffixes.rest(frame)
    assert left.columns == frame.columns
    want = collections.Counter()
    for (d, n, gone, _, kept), k in found.items():
        if not gone or kept.decode("utf-8", "ignore"):
            want[d] += k
    assert collections.Counter(d for d, _ in texts(left)) == want


@needs_data
def test_repeats_of_documents(spark, docs):
    rows = [(d, t.encode()) for d, t in texts(docs)]
    want = {(d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in brute_removed(rows)}
    assert {tuple(r)[:5] for r in queries.QUERIES["op2_suffix_repeats"](spark, FOLDER).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want


def test_repeats_odd_input(odd):
    assert suffixes.removed(odd).count() == odd.count()
    assert suffixes.removed(odd.limit(0)).count() == 0


# ---- pipeline ---------------------------------------------------------------------


@needs_data
def test_pipeline(spark, docs):
    import corpus_pipeline as p

    out, names = docs, docs.columns
    for k, (_, stage) in enumerate(p.STAGES):
        before, out = out, stored(stage(spark, out, FOLDER))
        rows = dict(texts(before))
        if k < len(p.STAGES) - 1:
            assert out.columns == names
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= set(rows) and ids
        if k == 1:
            assert ids == {d for d, (_, c) in brute_classes(list(rows.items())).items() if d == c}
        elif k == 2:
            want = {d: kept.decode("utf-8", "ignore") for d, _, gone, _, kept in brute_removed([(d, t.encode()) for d, t in rows.items()]) if not gone or kept}
            assert dict(texts(out)) == want
        elif k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            gone = {r.doc_id for r in decontaminate.leaks(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
            assert ids == set(rows) - gone and gone == {d for d, _ in brute_leaks([(d, rows[d]) for d in list(rows)[:30]], items)} | (gone - set(list(rows)[:30]))
        elif k == 4:
            assert all(r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest() for r in out.collect())


def test_rows_with_one_id_and_unlike_texts_stay(spark):
    import corpus_pipeline as p

    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near), (2, near + " end"), (2, "quite another text with some words"), (3, "a third text of its own"), (3, "a third text of its own"), (3, "unlike the third in all"), (None, near)]
    out = p.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    assert sorted((d or 0, t) for d, t in texts(out)) == sorted({(d or 0, t) for d, t in rows if t != near + " end"})


def test_pipeline_odd_input(spark, odd):
    import corpus_pipeline as p

    labels = spark.createDataFrame([(5, 1), (9, 1)], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    folder = shared_folder(spark)
    odd.select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "same words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    extra = odd.withColumn("n_chars", F.length("text").cast("long"))
    for given in (extra, extra.limit(0)):
        out = given
        for _, stage in p.STAGES:
            out = stored(stage(spark, out, folder))
        assert (out.count() > 0) == (given.count() > 0)
