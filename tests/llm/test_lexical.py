"""Secret scan, ranked search and spelling variants beside brute force, and their odd inputs."""

import collections
import functools
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablequarry.llm import search, secrets, spelling


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long, repeated and strange texts, with columns whose names may clash."""
    long = " ".join(f"word{i % 977} secret: 0123456789abcdef{i:04x}" for i in range(20_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same text here"), (6, "same text here"), (6, "same text here"), (7, "a\u0000b é 日本 \U0001F600 �"),
        (8, "x" * 50_000), (8, "x" * 49_999), (9, "one two three four five six seven eight " * 40), (None, "no id but a token=abcdefghijkl"), (10, "\\ [ROLE] </s> <|endoftext|>"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "word", "n", "found", "rules", "__key", "number", "item", "low", "trigram", "size", "doc"):
        frame = frame.withColumn(name, F.lit(name))
    return frame


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- secrets ---------------------------------------------------------------------


def plain_spans(text, rules=secrets.RULES):
    out = []
    for k, r in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return [tuple(s) for s in sorted(out)]


def found_spans(df):
    return [[tuple(s) for s in r.found] for r in df.collect()]


def secret_texts(n, seed):
    """Texts glued from pieces of rules, so that matches touch, fail and hide each other."""
    rng = random.Random(seed)
    parts = [
        "password", "PassWD", "secret", "Token", "api_key", "APIKEY", "=", ": ", " = \"", "'", "  ", "abcdefghijkl", "short", "AKIA", "ABCDEFGHIJKLMN", "QRST", "0123456789abcdef", "deadbeef", "é日\U0001F600",
        "ghp_", "x" * 36, "AIza", "Y-_" * 12, "xoxb-", "sk_live_", "rk_live_", "Bearer ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "://", "user:", "pass word", "longpassword", "@", "://me:longpassword@", "glpat-", "\n", "K", "ſ",
    ]
    return ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(n)]


def test_secrets_as_by_hand(spark):
    texts = secret_texts(3000, 1)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: [tuple(s) for s in r.found] for r in secrets.scan(frame).collect()}
    want = {k: plain_spans(t) for k, t in enumerate(texts)}
    assert got == want
    assert {s[1] for w in want.values() for s in w} == set(range(len(secrets.RULES)))


def test_secrets_odd(odd):
    got = {(r.doc_id, tuple(map(tuple, r.found))) for r in secrets.scan(odd).collect()}
    assert got == {(r.doc_id, tuple(plain_spans(r.text or ""))) for r in odd.select("doc_id", "text").collect()}
    assert secrets.scan(odd).count() == odd.count()
    assert secrets.scan(odd.limit(0)).count() == 0


def test_dropped_match_hides_the_next():
    assert plain_spans("token: secret: abcdefghijklmn") == []
    assert plain_spans("token: secret; token: abcdefghijklmn") == [(15, 0, 36)]


def test_mandatory_trigrams():
    query = secrets.trigram_query
    assert query(r"abcd") == [frozenset({frozenset({"abc", "bcd"})})]
    assert query(r"ab.cd") == [] and query(r"[a-z]+") == [] and query(r"(abc)?") == [] and query(r"(abc)*") == [] and query(r"abc|x") == []
    assert query(r"(abc)+") == [frozenset({frozenset({"abc"})})]
    assert query(r"a[xy]c") == [frozenset({frozenset({"axc"}), frozenset({"ayc"})})]
    assert query(r"AB(C|DE)F*") == [frozenset({frozenset({"abc"}), frozenset({"abd", "bde"})})]
    assert query(r"abc.*xyz|abq") == []


def test_no_match_without_its_trigrams():
    """What an expression matches always holds its trigrams, over random expressions."""
    rng = random.Random(3)
    atoms = ["a", "b", "c", "[ab]", "[a-c]", ".", "(?:ab|c)", "(a|bc|)", "[^a]", "\\b"]
    repeats = ["", "", "", "?", "*", "+", "{2}", "{2,}", "{1,3}", "+?"]
    tried = 0
    for _ in range(9000):
        pattern = "".join(rng.choice(atoms[:-1]) + rng.choice(repeats) for _ in range(rng.randrange(1, 6)))
        clauses = secrets.trigram_query(pattern)
        for _ in range(8):
            text = "".join(rng.choices("abcd", k=rng.randrange(3, 9)))
            if clauses and re.search(pattern, text):
                tried += 1
                held = {text[i : i + 3] for i in range(len(text) - 2)}
                assert all(any(way <= held for way in clause) for clause in clauses), (pattern, text)
    assert tried > 300


def test_only_candidates_have_bits(spark):
    texts = ["no words at all", "a token here", "AKIA and more", "key", "api key"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    posted = secrets.index(frame, secrets.trigrams(secrets.BASE))
    got = sorted(r["rules"] for r in secrets.candidates(posted, secrets.BASE).collect())
    assert got == [1, 2]


def test_only_full_scans(spark):
    frame = spark.createDataFrame([(1, "aa0123456789abcdef0"), (2, None)], "doc_id long, text string")
    assert found_spans(secrets.scan(frame, rules=(secrets.BASE[2],)).orderBy("doc_id")) == [[(0, 0, 19)], []]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    row = spark.range(1).select(F.array(*[F.lit(i % 7).cast("long") for i in range(n)]).cast("array<bigint>").alias("a"))
    got = row.select(F.when(F.size("a") > 0, secrets.running(F.col("a"))).otherwise(F.col("a")).alias("s")).first().s
    assert got == list(itertools.accumulate(i % 7 for i in range(n)))


# ---- ranked search ---------------------------------------------------------------


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def plain_search(docs, items, top=50):
    counted = [(d, collections.Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    total, length = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = collections.Counter()
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 50 + (50 * c.total() * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1):
            out[item, rank, d, -s] += 1
    return out


def found_items(df):
    return collections.Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@functools.cache
def search_rows():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Éa", "日本", "x1"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(n)))
    docs = [(k, text(60)) for k in range(400)]
    docs += [(1000 + k, docs[7][1]) for k in range(120)] + [(None, "w1 w2"), (None, "w1 w2"), (3, docs[3][1]), (5000, None), (5001, "")]
    base = [text(20) for _ in range(6)]
    items = [(k, base[k % 6] + " " + text(8)) for k in range(40)] + [(7, base[0]), (90, None), (91, "..."), (92, base[1]), (92, base[1])]
    return docs, items


@pytest.mark.parametrize("block,top", [(1024, 50), (7, 3)])
def test_search_as_by_hand(spark, block, top):
    docs, items = search_rows()
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), top=top, block=block)
    assert found_items(got) == plain_search(docs, items, top)


def test_search_odd(spark, odd):
    items = spark.createDataFrame([(1, "same word5 日本 seven"), (None, "x1 token")], "item_id long, text string").withColumn("number", F.lit("number"))
    want = plain_search([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found_items(search.search(odd, items)) == want
    assert search.search(odd.limit(0), items).count() == 0
    assert search.search(odd, items.limit(0)).count() == 0


def test_shared_sets_add_up():
    rng = random.Random(9)
    first = 60
    common = [rng.sample(range(first), 6) for _ in range(5)]
    sets = [sorted(set(rng.choice(common) + rng.sample(range(first), rng.randrange(1, 9)))) for _ in range(50)] + [[3], [3]]
    ends, parts = search.shared_sets(sets, first)
    members = [{k} for k in range(first)]
    for a, b in parts.tolist():
        assert not members[a] & members[b]
        members.append(members[a] | members[b])
    assert [members[e] for e in ends] == [set(s) for s in sets]
    assert len(parts) < sum(len(s) - 1 for s in sets) * 0.9
    deep, _ = search.in_levels(parts, first)
    assert all(deep[k] > max(deep[p - first] if p >= first else 0 for p in pair) for k, pair in enumerate(parts.tolist()))


def test_best_keeps_smaller_ids_of_ties():
    best = search.Best(2, 3)
    for start in range(0, 400, 40):
        ids = np.arange(start, start + 40)[::-1].copy()
        best.add(np.vstack([np.full(40, 5), ids % 7]), ids, np.ones(40, bool))
    item, score, ids, _ = best.cut()
    assert list(zip(item, score, ids)) == [(0, 5, 0), (0, 5, 1), (0, 5, 2), (1, 6, 6), (1, 6, 13), (1, 6, 20)]


# ---- spelling variants -----------------------------------------------------------


def plain_variants(docs, slip):
    n = collections.Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {a: [b for b in n if abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in n}
    best = {a: min(bs, key=lambda b: (-n[b], b)) for a, bs in near.items() if bs}
    form = {a: b for a, b in best.items() if n[b] >= 2 * n[a]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def found_variants(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_as_by_hand(spark):
    rng = random.Random(11)
    syllables = ["ab", "an", "en", "ne", "ü", "ÿa", "t", "tt"]
    base = ["".join(rng.choices(syllables, k=rng.randrange(2, 6))) for _ in range(120)]

    def bent(w):
        i = rng.randrange(len(w) + 1)
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abtü") + w[i:], w[:i] + rng.choice("abtü") + w[i + 1 :], w, w, w.upper(), w.title()])

    docs = [(d, rng.choice([" ", "-", "9", "×", "Ā"]).join(bent(rng.choice(base)) for _ in range(rng.randrange(80)))) for d in range(200)] + [(None, "abanne abanne abanne"), (4, None)]
    want = plain_variants(docs, 7)
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] != w[2] and w[1] for w in want)
    assert found_variants(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), slip=7)) == want


def test_every_edit_of_a_word_is_met(spark):
    """Each deletion, insertion and replacement at every place, for all lengths from the least up to twelve."""
    words = set()
    for size in range(5, 13):
        w = "abcdefghijkl"[:size]
        words |= {w} | {w[:i] + w[i + 1 :] for i in range(size)} | {w[:i] + c + w[i:] for i in range(size + 1) for c in "za"} | {w[:i] + c + w[i + 1 :] for i in range(size) for c in "zb"}
    words = sorted(w for w in words if len(w) >= 5)
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    got = {frozenset((r.a, r.b)) for r in pairs}
    assert len(got) == len(pairs)
    want = set()
    by_hole = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_hole[i, w[:i] + "_" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in set(words):
                want.add(frozenset((w, w[:i] + w[i + 1 :])))
    for group in by_hole.values():
        want |= {frozenset(p) for p in itertools.combinations(group, 2)}
    assert got == want


def test_long_chain_of_forms(spark):
    """Words of doubling counts, each near the next: the root is the last of the chain."""
    chain = ["aaaaaaaaaaaa"[:i] + "bbbbbbbbbbbb"[i:] for i in range(13)]
    text = [(k, " ".join([w] * (3 * 2**k))) for k, w in enumerate(chain)]
    got = spelling.variants(spark.createDataFrame(text, "doc_id long, text string"), slip=2**33).collect()
    assert {r.word: r.root for r in got} == dict.fromkeys(chain, chain[-1])


def test_variants_odd(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(1, "x" * 50_000)] * 2 + [(2, "x" * 49_999)] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("word")).withColumn("n", F.lit(1))
    assert found_variants(spelling.variants(frame)) == plain_variants(rows, spelling.SLIP)
    assert spelling.variants(odd.limit(0)).count() == 0


def test_spelling_variants_gather_no_word_list_on_the_driver(spark, tmp_path):
    path = str(tmp_path / "vocab")
    spark.createDataFrame([("anchor", 9), ("anchors", 4), ("anchr", 3), ("bright", 5)], "word string, n long").write.parquet(path)
    pairs = spelling.near_pairs(spark.read.parquet(path))
    assert {(r.a, r.b) for r in pairs.collect()} == {("anchor", "anchors"), ("anchr", "anchor")}
    out = spelling.variants(spark.createDataFrame([(1, "anchor anchor anchor anchor anchors " * 3)], "doc_id long, text string"), slip=2**33)
    for made in (pairs, out):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
