"""Operators on small hand-made frames, with golden values and brute force."""

import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tablequarry.functions import names as nm, textforms as tf
from tablequarry.functions.literals import literal_number
from tablequarry.functions.seeded import unit
from tablequarry.operators import features as ft, linking as lk, mining as mi, ordered as od, pieces as pc, schemas as sm, slotquery as sq, slotscore as sc, spans
from tablequarry.operators import ranking as rk, structscore as ss, synthesis as sy
from tablequarry.plans import base as plan_base, links as link_plans, ranks as rank_plans, slots as slot_plans, texts as text_plans
from tablequarry.plans.registry import Tables
from tablequarry.plans.templates import phrase_frame, template_frame
from tablequarry.sources import readers as rd, sinks as sk

COND = "array<struct<col:int,op:int,val:string,is_num:boolean>>"


def one(df, col):
    return df.select(col.alias("x")).first()["x"]


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


# ---- slot queries ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def slots(spark):
    tables = spark.createDataFrame([("1-a", ["Name", "Size"], ["text", "real"]), ("1-b", ["Name", "Size"], ["text", "real"])], "table_id string, header array<string>, types array<string>")
    rows = spark.createDataFrame(
        [("1-a", 0, ["Ann", "3"]), ("1-a", 1, ["bob", "5.5"]), ("1-a", 2, ["12 kg", "n/a"]), ("1-a", 3, ["Ann", "7"]), ("1-b", 0, ["x", "1"])],
        "table_id string, row_id long, cells array<string>",
    )
    return tables, rows


def run(spark, slots, queries, **options):
    q = spark.createDataFrame(queries, f"query_id string, table_id string, sel int, agg int, conds {COND}")
    return {r["query_id"]: r for r in sq.summaries(q, *slots, **options).collect()}, q


CASES = [
    ("all", "1-a", 0, 0, []), ("cnt", "1-a", 0, 3, [(0, 0, "ANN", False)]), ("sum", "1-a", 1, 4, [(0, 0, "ann", False)]),
    ("gt", "1-a", 1, 0, [(1, 1, "about 4", False)]), ("bad", "1-a", 0, 0, [(1, 0, "none", False)]), ("op", "1-a", 0, 0, [(0, 3, "x", False)]),
    ("empty", "1-a", 1, 1, [(0, 0, "nobody", False)]), ("nothing", "1-a", 1, 0, [(0, 0, "nobody", False)]), ("txt", "1-a", 0, 4, []),
    ("maxt", "1-a", 0, 1, []), ("last", "1-a", 1, 0, [(1, 1, "0", True), (1, 2, "4", True)]),
]


@pytest.mark.parametrize("options", [{}, {"part": 2}, {"part": 1}])
def test_slot_semantics(spark, slots, options):
    got, _ = run(spark, slots, CASES, **options)
    assert got["all"]["n_rows"] == 4
    assert got["cnt"]["num"] == 2 and got["sum"]["num"] == 10
    assert got["gt"]["n_rows"] == 3  # 5.5, 7 and the text, which sorts after numbers
    assert got["bad"]["error"] and got["op"]["error"]
    assert got["empty"]["n_rows"] == 0 and got["empty"]["num"] is None
    assert got["nothing"]["n_rows"] == 0 and not got["nothing"]["error"]
    assert got["txt"]["num"] == 12  # text counts as its leading number or 0
    assert got["maxt"]["txt"] == "bob"
    assert got["last"]["n_rows"] == 0  # the last value serves both conditions: > 4 and < 4


def test_slot_last_value(spark, slots):
    case = [("q", "1-a", 1, 0, [(1, 1, "0", True), (1, 2, "4", True)])]
    got, _ = run(spark, slots, case, last_value_wins=False)
    assert got["q"]["n_rows"] == 1


def test_answers_equal_as_lists(spark, slots):
    gold = [("1", "1-a", 1, 0, [(0, 0, "bob", False)]), ("2", "1-a", 1, 0, [(0, 0, "ann", False)]), ("3", "1-a", 1, 0, [(0, 0, "zed", False)])]
    pred = [("1", "1-a", 1, 1, [(0, 0, "bob", False)]), ("2", "1-a", 1, 0, [(1, 1, "6", True)]), ("3", "1-a", 1, 0, [(0, 0, "zed", False)])]
    _, g = run(spark, slots, gold)
    _, p = run(spark, slots, pred)
    strict = {r["query_id"]: r["ex"] for r in sc.execution_scores(g, p, *slots).collect()}
    lenient = {r["query_id"]: r["ex"] for r in sc.execution_scores(g, p, *slots, lenient=True).collect()}
    assert strict == {"1": 1, "2": 0, "3": 1}
    assert lenient == {"1": 1, "2": 0, "3": 0}


def test_generated_queries_answer(spark, slots):
    tables, rows = slots
    made = sq.generate_queries(tables, rows, 6, 5)
    got = {r["query_id"]: r for r in made.collect()}
    assert got
    check = {r["query_id"]: r for r in sq.summaries(made.select("query_id", "table_id", "sel", "agg", "conds"), tables, rows).collect()}
    for k, r in got.items():
        assert not check[k]["error"] and check[k]["n_rows"] == r["n_rows"]
        assert len({c["col"] for c in r["conds"]}) == len(r["conds"]) and r["sel"] not in {c["col"] for c in r["conds"]}


def test_generated_queries_are_tried_again(spark, slots):
    # A comparison with the only size left may leave no row, so one try gives fewer than asked.
    tables, rows = slots
    n = 20
    made = sq.generate_queries(tables, rows, n, 5)
    got = [r["query_id"] for r in made.collect()]
    assert sorted(got) == sorted(f"{t}#{i}" for t in ("1-a", "1-b") for i in range(1, n + 1))
    first = sq.generate_queries(tables, rows, n, 5, tries=1)
    assert 0 < first.count() < 2 * n and first.exceptAll(made).isEmpty()
    check = sq.summaries(made.select("query_id", "table_id", "sel", "agg", "conds"), tables, rows)
    rows_of = {r["query_id"]: r["n_rows"] for r in check.collect() if not r["error"]}
    assert all(rows_of[r["query_id"]] == r["n_rows"] and (r["agg"] > 0 or r["n_rows"] > 0) for r in made.collect())


def test_large_and_small_tables_agree(spark):
    rnd = random.Random(3)
    tables = spark.createDataFrame([("t", ["A", "B"], ["text", "real"])], "table_id string, header array<string>, types array<string>")
    data = [("t", i, [rnd.choice("abc"), str(rnd.randint(0, 9))]) for i in range(300)]
    rows = spark.createDataFrame(data, "table_id string, row_id long, cells array<string>")
    cases = []
    for i in range(30):
        conds = [(0, 0, rnd.choice("abcd"), False)] if i % 2 else [(1, rnd.randint(0, 2), str(rnd.randint(0, 9)), True)]
        cases.append((str(i), "t", 1, rnd.randint(0, 5), conds))
    small, _ = run(spark, (tables, rows), cases)
    large, _ = run(spark, (tables, rows), cases, part=7)
    assert {k: tuple(r) for k, r in small.items()} == {k: tuple(r) for k, r in large.items()}
    for q, _, sel, agg, conds in cases:
        c, op, v, num = conds[0]
        test = (lambda x: x == v) if not num else {0: lambda x: float(x) == float(v), 1: lambda x: float(x) > float(v), 2: lambda x: float(x) < float(v)}[op]
        assert small[q]["n_rows"] == sum(test(cells[c]) for _, _, cells in data)


@pytest.mark.parametrize("options", [{}, {"block": 16}, {"block": 7, "part": 3}])
def test_index_beside_all_pairs(spark, options):
    """Tables of several blocks and of one: ties, NULL cells, short rows, texts in a number column, up to three conditions."""
    rnd = random.Random(8)
    tables = spark.createDataFrame([(t, ["A", "B", "C"], ["text", "real", "real"]) for t in ("t", "u", "none")], "table_id string, header array<string>, types array<string>")
    data = []
    for t, n in (("t", 200), ("u", 6)):
        for i in range(n):
            cells = [rnd.choice(["Ab", "b", "C d", "", None]), rnd.choice([str(rnd.randint(-3, 12)), "2.50", "-0", "many", None]), str(rnd.randint(0, 3))]
            data.append((t, i, cells[: rnd.choice([3, 3, 3, 2])]))
    rows = spark.createDataFrame(data, "table_id string, row_id long, cells array<string>").repartition(3)
    cases = []
    for i in range(120):
        conds = [(0, rnd.randint(0, 2), rnd.choice(["AB", "b", "c d", "zz", ""]), False) if rnd.random() < 0.4 else (rnd.randint(1, 2), rnd.randint(0, 2), str(rnd.choice([0, 1, 2.5, 3, 11, 40])), True) for _ in range(rnd.randint(0, 3))]
        cases.append((i, rnd.choice("ttuun").replace("n", "none"), rnd.randint(0, 2), 0, conds))
    q = spark.createDataFrame(cases, f"query_id long, table_id string, sel int, agg int, conds {COND}")
    got = collections.defaultdict(set)
    for r in sq.matches(q, tables, rows, last_value_wins=False, **options).collect():
        assert (r.row_id, r.txt) not in got[r.query_id]
        got[r.query_id].add((r.row_id, r.txt))

    def place(cell, real):
        try:
            return (0, float(cell)) if real else (1, cell.lower())
        except ValueError:
            return (1, cell.lower())

    def holds(cells, c, op, val):
        if c >= len(cells) or cells[c] is None:
            return False
        a, b = place(cells[c], c > 0), place(val, c > 0)
        return (a == b, a > b, a < b and a[0] == b[0])[op]

    for i, t, sel, _, conds in cases:
        want = {(r, (cells[sel].lower() if sel < len(cells) and cells[sel] is not None else None)) for tt, r, cells in data if tt == t and all(holds(cells, c, op, v) for c, op, v, _ in conds)}
        assert got[i] == want, (i, t, sel, conds)


def test_means_stand_beside_items(spark):
    scores = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, 0)], "query_id long, ex int, lf int")
    got = {r.query_id: (r.ex, r.lf) for r in sc.item_and_mean(scores, "query_id", ["ex", "lf"]).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, 0.0), 3: (1.0, 1.0), 4: (1.0, 0.0), None: (0.75, 0.25)}


def test_literal_number(spark):
    df = texts(spark, "1,234.5", "about 7 or 8", "-5", "x -5", "none", "-.5 m")
    assert [r[0] for r in df.select(literal_number(F.col("v"))).collect()] == [1234.5, 7.0, -5.0, 5.0, None, -0.5]


def test_symbols_unknown_column(spark):
    df = spark.createDataFrame([("SYMSELECT SYMAGG MAX SYMCOL Si ze SYMEND", ["Name", "Size"]), ("SYMSELECT SYMAGG  SYMCOL Age SYMEND", ["Name", "Size"])], "s string, header array<string>")
    a, b = sq.read_symbols(df, "s", "header").collect()
    assert (a["sel"], a["agg"], a["error"]) == (1, 1, False) and b["error"] and b["sel"] is None


# ---- text ------------------------------------------------------------------------------------


def test_word_pieces():
    vocab = {"[UNK]", "want", "##want", "##ed", "wa", "un", "runn", "##ing"}
    assert pc.word_pieces("unwanted", vocab) == ["un", "##want", "##ed"]
    assert pc.word_pieces("running", vocab) == ["runn", "##ing"]
    assert pc.word_pieces("unwantedX", vocab) == ["[UNK]"] and pc.word_pieces("a" * 101, vocab | {"a", "##a"}) == ["[UNK]"]


def test_byte_pairs():
    ranks = {("l", "o"): 0, ("lo", "w"): 1, ("e", "r"): 2}
    assert pc.byte_pairs(list("lower"), ranks) == ["low", "er"]
    assert pc.byte_pairs(list("newer"), ranks) == ["n", "e", "w", "er"]


def test_byte_words(spark):
    ranks = {("\u0120", "l"): 0, ("\u0120l", "o"): 1, ("\u0120lo", "w"): 2, ("e", "r"): 3}
    df = texts(spark, " lower newer")
    words = one(df, pc.byte_words(F.col("v")))
    assert [p for w in words for p in pc.byte_pairs(pc.byte_letters(w), ranks)] == ["\u0120low", "er", "\u0120", "n", "e", "w", "er"]
    assert one(texts(spark, "it's 20 km!  ok"), pc.byte_words(F.col("v"))) == ["it", "'s", " 20", " km", "!", " ", " ok"]


def test_piece_counts_match_brute_force(spark):
    vocab = {"a", "##b", "ab", "c", "##c"}
    data = [(1, ["ab", "abc", "zz"]), (2, ["c", "c", "cc"])]
    df = spark.createDataFrame(data, "id long, toks array<string>")
    want = {i: sum(len(pc.word_pieces(w, vocab)) for w in ws) for i, ws in data}
    assert {r["id"]: r["n_tokens"] for r in pc.token_counts(df, "id", "toks", pc.word_pieces, vocab).collect()} == want
    got = {r["id"]: r["pieces"] for r in pc.tokenise(df, "id", "toks", pc.word_pieces, vocab).collect()}
    assert got == {i: [p for w in ws for p in pc.word_pieces(w, vocab)] for i, ws in data}


def test_pieces_from_files(spark, tmp_path):
    """Vocabulary and merges files of the two kinds, read and used by joins: the known pieces and ids."""
    marked = tmp_path / "vocab.txt"
    marked.write_text("".join(p + "\n" for p in ["[UNK]", "[CLS]", "[SEP]", "want", "##want", "##ed", "wa", "un", "runn", "##ing", ",", "low", "lowest"]))
    vocab = rd.read_piece_vocabulary(spark, str(marked))
    assert {r.piece: r.id for r in vocab.collect()}["##ing"] == 9
    df = spark.createDataFrame([(1, "UNwant\u00e9d,running"), (2, "unwantedX running"), (3, None), (4, " "), (5, "a" * 101)], "id int, v string")
    toks = df.select("id", tf.basic_tokens(F.col("v")).alias("toks"))
    pieces = pc.tokenise(toks, "id", "toks", pc.by_vocabulary(vocab))
    got = {r.id: r.pieces for r in pieces.collect()}
    assert got == {1: ["un", "##want", "##ed", ",", "runn", "##ing"], 2: ["[UNK]", "runn", "##ing"], 3: [], 4: [], 5: ["[UNK]"]}
    ids = {r.id: r.ids for r in pc.piece_ids(pieces, "id", vocab).collect()}
    assert ids == {1: [7, 4, 5, 10, 8, 9], 2: [0, 8, 9], 3: [], 4: [], 5: [0]}
    assert {r.id: r.n_tokens for r in pc.token_counts(toks, "id", "toks", pc.by_vocabulary(vocab)).collect()} == {1: 6, 2: 3, 3: 0, 4: 0, 5: 1}

    merges, names = tmp_path / "merges.txt", tmp_path / "vocab.json"
    merges.write_text("#version: 0.2\n\u0120 l\n\u0120l o\n\u0120lo w\ne r\n", encoding="utf-8")
    listed = ["l", "o", "w", "e", "r", "s", "t", "i", "d", "n", "\u0120", "\u0120l", "\u0120n", "\u0120lo", "\u0120low", "er", "\u0120lowest", "\u0120newer", "\u0120wider", "<unk>"]
    names.write_text(json.dumps({p: i for i, p in enumerate(listed)}), encoding="utf-8")
    rules = rd.read_merges(spark, str(merges))
    assert [tuple(r) for r in rules.orderBy("rank").collect()] == [(0, "\u0120", "l"), (1, "\u0120l", "o"), (2, "\u0120lo", "w"), (3, "e", "r")]
    words = F.transform(pc.byte_words(F.concat(F.lit(" "), "v")), pc.visible_letters)
    text = spark.createDataFrame([(1, "lower newer"), (2, ""), (3, "\u00e9")], "id int, v string").select("id", words.alias("toks"))
    pieces = pc.tokenise(text, "id", "toks", pc.by_merges(rules))
    assert {r.id: r.pieces for r in pieces.collect()}[1] == ["\u0120low", "er", "\u0120", "n", "e", "w", "er"]
    ids = {r.id: r.ids for r in pc.piece_ids(pieces, "id", rd.read_vocabulary_json(spark, str(names)), "<unk>").collect()}
    assert ids == {1: [14, 15, 10, 9, 3, 2, 15], 2: [10], 3: [10, 19, 19]}


def test_byte_pairs_as_the_library(spark):
    """All merges of a public tokenizer by joins beside the tokenizers library, on odd and long words."""
    public, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    whole = library.Tokenizer.from_file(path)
    rnd = random.Random(6)
    values = ["it's  20 km!\n\n ok", "na\u00efve \u65e5\u672c \U0001F600", "a" * 3000, "-" * 500, "\u0000 \t", "", " ".join("".join(rnd.choices("abcdeinrst\u00e9", k=rnd.randint(1, 14))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string").select("id", F.transform(pc.byte_words(F.col("v")), pc.visible_letters).alias("toks"))
    vocabulary, merges = rd.read_tokenizer_json(spark, path)
    pieces = pc.tokenise(df, "id", "toks", pc.by_merges(merges))
    ids = {r.id: r.ids for r in pc.piece_ids(pieces, "id", vocabulary, "<|endoftext|>").collect()}
    assert ids == {i: whole.encode(v, add_special_tokens=False).ids for i, v in enumerate(values)}


def test_byte_pairs_merge_in_rank_order():
    """Beside a plain loop over the whole word, with random merges, repeats and overlaps."""
    def plain(parts, ranks):
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda pair: ranks.get(pair, len(ranks)))
            if best not in ranks:
                break
            out, i = [], 0
            while i < len(parts):
                two = i + 1 < len(parts) and (parts[i], parts[i + 1]) == best
                out.append("".join(parts[i : i + 2]) if two else parts[i])
                i += 2 if two else 1
            parts = out
        return parts

    rnd = random.Random(2)
    for _ in range(400):
        pool = list("ab")
        pairs = []
        for _ in range(rnd.randint(0, 12)):
            pairs.append((rnd.choice(pool), rnd.choice(pool)))
            pool.append("".join(pairs[-1]))
        rnd.shuffle(pairs)
        ranks = {p: i for i, p in enumerate(dict.fromkeys(pairs))}
        letters = rnd.choices("abc", weights=[5, 5, 1], k=rnd.randint(0, 40))
        assert pc.byte_pairs(letters, ranks) == plain(letters, ranks)


def test_pieces_keep_texts_without_words(spark):
    df = spark.createDataFrame([(1, ["ab"]), (2, []), (3, None), (4, [None]), (None, [])], "id long, toks array<string>")
    assert {r["id"]: r["n_tokens"] for r in pc.token_counts(df, "id", "toks", pc.word_pieces, {"a", "##b"}).collect()} == {1: 2, 2: 0, 3: 0, 4: 0, None: 0}
    got = {r["id"]: r["pieces"] for r in pc.tokenise(df, "id", "toks", pc.word_pieces, {"a", "##b"}).collect()}
    assert got == {1: ["a", "##b"], 2: [], 3: [], 4: [], None: []}


def test_basic_tokens(spark):
    df = texts(spark, " \tHeLLo!how  \n Are yoU?  ", "Héllo", "ah博推zz")
    got = [r[0] for r in df.select(tf.basic_tokens(F.col("v"))).collect()]
    assert got == [["hello", "!", "how", "are", "you", "?"], ["hello"], ["ah", "博", "推", "zz"]]


def test_split_original_keeps_double_space(spark):
    assert one(texts(spark, "StudentID_Num"), nm.split_original(F.col("v"))) == "student id  num"


def test_merge_tokens(spark):
    df = spark.createDataFrame([(["butler", "cc", "-LRB-", "ks", "-RRB-"], "who is butler cc (ks) player"), (["$", "5", "million"], "it cost $5 million"), (["a", "/", "b"], "other text")], "t array<string>, q string")
    assert [r[0] for r in df.select(spans.merge_tokens(F.col("t"), F.col("q"))).collect()] == ["butler cc (ks)", "$5 million", "a/b"]


def test_mask_flags(spark):
    toks = ["<s>"] + [f"w{i}" for i in range(400)] + ["</s>"]
    df = spark.createDataFrame([(1, toks)], "id long, toks array<string>")
    m = one(df, ft.mask_words(F.col("toks"), F.array(F.lit("new")), 1, "id"))
    chosen = [i for i, x in enumerate(m["labels"]) if x]
    assert 30 < len(chosen) < 90 and m["toks"][0] == "<s>" and m["toks"][-1] == "</s>"
    assert all(m["labels"][i] == toks[i] for i in chosen) and all(m["toks"][i] == toks[i] for i in range(len(toks)) if i not in chosen)
    assert sum(m["toks"][i] == "<mask>" for i in chosen) > len(chosen) / 2


def test_column_labels_and_table_index(spark):
    toks = "<s> q </s> t * </s> a </s> b </s> u * </s>".split()
    df = spark.createDataFrame([(toks, [9, 8, 7, 6, 5])], "toks array<string>, labels array<int>")
    assert one(df, ft.column_label_ids(F.col("toks"), F.col("labels"))) == [-1, -1, 9, -1, -1, 8, -1, 7, -1, 6, -1, -1, -1]

    def brute(ts):
        marks = [1 if x in ("<s>", "</s>") else 2 if x == "*" else 0 for x in ts]
        starts, ahead = set(), False
        for i in range(len(marks) - 1, 0, -1):
            ahead, hit = (True, False) if marks[i] == 2 else ((False, True) if ahead and marks[i] == 1 else (ahead, False))
            if hit:
                starts.add(i)
        out, cur = [], 0
        for i in range(len(ts)):
            cur = i if i in starts else cur
            out.append(cur)
        return out

    assert one(df, ft.table_indexes(F.col("toks"))) == brute(toks)


@pytest.mark.parametrize("n,m,most", [(3, 3, 3), (10, 2, 7), (2, 10, 7), (5, 5, 8), (1, 1, 5), (9, 8, 6)])
def test_pair_lengths(spark, n, m, most):
    a, b = n, m
    while a + b > most:
        a, b = (a - 1, b) if a > b else (a, b - 1)
    x, y = ft.pair_lengths(F.lit(n), F.lit(m), most)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r["x"], r["y"]) == (a, b)


def test_cut_with_stride(spark):
    df = spark.createDataFrame([(list(range(10)), [1, 2])], "a array<int>, b array<int>")
    r = one(df, ft.cut_with_stride(F.col("a"), F.col("b"), 8, 2))
    assert r["first"] == list(range(6)) and r["overflow"] == list(range(10))[8 - 2 - 2:]
    assert one(df, ft.cut_with_stride(F.col("a"), F.col("b"), 2, 2))["first"] == list(range(10))


# ---- ordered, seeded -------------------------------------------------------------------------


def test_running_number_blocks(spark):
    data = [(i % 2, i * 3) for i in range(200)]
    df = spark.createDataFrame(data, "k int, o long")
    got = {(r["k"], r["o"]): r["no"] for r in od.running_number(df, ["k"], "o", "no", block=32).collect()}
    for k in (0, 1):
        for i, o in enumerate(sorted(o for kk, o in data if kk == k)):
            assert got[(k, o)] == i + 1


@pytest.mark.parametrize("block", [None, 16, 100_000])
def test_running_sums_over_ranges(spark, block):
    """Hashed 64-bit order keys, one hot group, small groups, a NULL group and no group at all."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(-(1 << 62), 1 << 62), rng.choice([0, 1, 2, None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, o long, v int").repartition(5)
    for keys in (["k"], []):
        got = {r.o: (r.no, r.total, r.last) for r in od.carried_marker(
            od.running_total(od.running_number(df, keys, "o", "no", block), keys, ["o"], F.col("v"), "total", block), keys, "o", F.when(F.col("v") == 2, F.col("o")), "last", block).collect()}
        groups = collections.defaultdict(list)
        for k, o, v in rows:
            groups[k if keys else None].append((o, v))
        for group in groups.values():
            total, last = 0, None
            for no, (o, v) in enumerate(sorted(group), 1):
                total, last = total + (v or 0), o if v == 2 else last
                assert got[o] == (no, total, last)
    assert od.running_number(df.limit(0), ["k"], "o", "no").count() == 0


def test_running_number_by_text(spark):
    df = spark.createDataFrame([(f"t{i % 3}", hashlib.md5(str(i).encode()).hexdigest()) for i in range(300)], "k string, w string")
    got = {(r.k, r.no): r.w for r in od.running_number(df, ["k"], "w", "no", block=20).collect()}
    for k in ("t0", "t1", "t2"):
        words = sorted(r.w for r in df.collect() if r.k == k)
        assert [got[k, i + 1] for i in range(100)] == words


def test_no_range_holds_a_hot_group(spark):
    ranged = od.in_ranges(spark.range(100_000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("o")), ["k", "o"], 10_000)
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 20_000


def test_numbered_in_order(spark):
    for words in ([f"same beginning {i}" for i in range(300)], [f"{c}{i}" for c in "abz" for i in range(20)], [str(hash(i)) for i in range(0, 1 << 62, 1 << 54)], ["one"], []):
        frame = spark.createDataFrame([(w, len(w)) for w in words], "w string, n int").repartition(7)
        assert {r["w"]: r["no"] for r in od.numbered_in_order(frame, ["w"], "no").collect()} == {w: i + 1 for i, w in enumerate(sorted(words))}
        ties = {r["w"]: r["no"] for r in od.numbered_in_order(frame, ["n", "w"], "no").collect()}
        assert ties == {w: i + 1 for i, w in enumerate(sorted(words, key=lambda w: (len(w), w)))}


def test_numbered_in_order_wide(spark):
    n = 1_200_000
    word = F.md5(F.col("id").cast("string"))
    frame = spark.range(n).select(word.alias("w"), F.repeat(word, 4).alias("extra"))
    got = od.numbered_in_order(frame, ["w"], "no")
    r = got.agg(F.count("*").alias("n"), F.countDistinct("no").alias("d"), F.min("no").alias("low"), F.max("no").alias("high"), F.count_if(F.col("extra") != F.repeat("w", 4)).alias("bad")).first()
    assert (r.n, r.d, r.low, r.high, r.bad) == (n, n, 1, n, 0)
    places = F.floor(F.col("no") / 200_000)
    ends = [(x.a, x.b) for x in got.groupBy(places.alias("p")).agg(F.min("w").alias("a"), F.max("w").alias("b")).orderBy("p").collect()]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_consistency_line_to_three_sequences(spark, tmp_path):
    """A corpus line of four parts to all arrays, padded and cut, by hand."""
    path = tmp_path / "lines.txt"
    path.write_text("<s> how big </s> size </s> name </s> ||| 5 7 ||| <s> big </s> a </s> ||| <s> select size </s> b </s>\n\n<s> x </s> y </s> ||| 1 2 ||| <s> q </s> ||| <s> </s> </s>\n<s> a b c d e f g h i j </s> k </s> ||| 3 ||| q ||| r\n")
    rows = rd.read_consistency_corpus(spark, str(path)).withColumn("key", F.col("line_no"))
    vocab = spark.createDataFrame([(3, "<s>"), (4, "</s>"), (5, "big"), (6, "size"), (7, "how"), (8, "select")], "id int, word string")
    got = {r.key: r for r in ft.three_sequences(rows, "key", ("toks", "question", "sql"), "labels", vocab, 9, F.array(F.lit("big")), 1, masked=False).collect()}
    r = got[0]
    assert r.ids == [3, 7, 5, 4, 6, 4, 0, 4, 1] and r.mask == [1] * 8 + [0]
    assert r.col_label_ids == [-1, -1, -1, 5, -1, 7, -1, -1, -1] and not r.error
    assert r.question_ids == [3, 5, 4, 0, 4, 1, 1, 1, 1] and r.question_mask == [1] * 5 + [0] * 4
    assert r.question_cols == [False, False, True] + [False] * 6
    assert r.sql_ids == [3, 8, 6, 4, 0, 4, 1, 1, 1] and r.sql_cols == [False] * 3 + [True] + [False] * 5
    assert all(x in (-1, y) for x, y in zip(r.lm_label_ids, r.ids))
    assert got[2].error and got[3].error  # a label too many; the cut caption has lost its columns
    masked = {r.key: r for r in ft.three_sequences(rows, "key", ("toks", "question", "sql"), "labels", vocab, 9, F.array(F.lit("big")), 1).collect()}
    for k, r in masked.items():
        assert r.lm_label_ids == got[k].lm_label_ids and len(r.ids) == 9
        assert all(x == y for x, y, old in zip(r.ids, got[k].ids, r.lm_label_ids) if old == -1)


def test_pair_features(spark):
    rows = spark.createDataFrame([(1, ["a"] * 9, ["b", "c"], "2.5"), (2, ["a"], ["b"] * 9, "1"), (3, ["a"], [], None)], "id int, a array<string>, b array<string>, label string")
    got = {r.id: r for r in ft.task_features(rows, F.col("a"), F.col("b"), F.col("label"), None, 8).collect()}
    assert got[1].tokens == ["[CLS]", "a", "a", "a", "[SEP]", "b", "c", "[SEP]"] and got[1].segments == [0] * 5 + [1] * 3 and got[1].label_id == 2.5
    assert got[3].tokens == ["[CLS]", "a", "[SEP]"] + ["[PAD]"] * 5 and got[3].input_mask == [1] * 3 + [0] * 5 and got[3].label_id is None


def test_vocabulary_of_the_train_section(spark):
    items = spark.createDataFrame([("d", "train", ["how", "how"]), ("d", "train", ["big"]), ("e", "val", ["never"])], "db_id string, section string, toks array<string>")
    schema = [("d", ["big name", "big"], [["-1", "*"], ["0", "big big"]], ["text", "number"]), ("e", ["never"], [["0", "never"]], ["text"])]
    frame = spark.createDataFrame(schema, "db_id string, table_names array<string>, column_names array<array<string>>, column_types array<string>")
    count = lambda df: dict(collections.Counter(r.word for r in df.collect()))
    assert count(ft.vocabulary_words(items, frame)) == {"how": 2, "big": 5, "name": 1, "*": 1, "<type: text>": 1, "<type: number>": 1}
    assert count(ft.vocabulary_words(items, frame, with_table=True)) == {"how": 2, "big": 6, "name": 2, "*": 1, "<type: text>": 1, "<type: number>": 1, "<any-table>": 1, "<table-sep>": 2}


def test_paired_features_keep_unequal_rows(spark):
    rows = [(1, ["<s>", "a", "</s>"], ["<s>", "b", "</s>"]), (2, ["<s>", "</s>", "a", "</s>"], ["b", "</s>"]), (3, None, ["b", "</s>"])]
    frame = spark.createDataFrame(rows, "id int, q array<string>, s array<string>").withColumn("labels", F.array(F.lit(1), F.lit(0)))
    got = {r["id"]: r["error"] for r in ft.paired_features(frame, "q", "s", "labels", 10).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_top_of_groups(spark):
    frame = spark.range(500).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(40)).alias("s"), "id")
    got = sorted((r["k"], r["rk"], r["id"]) for r in od.ranked_by_score(frame, ["k"], [F.desc("s"), "id"], 4, "rk").collect())
    rows = sorted(((r["k"], -r["s"], r["id"]) for r in frame.collect()))
    assert got == [(k, i + 1, x) for k in range(3) for i, (_, _, x) in enumerate([r for r in rows if r[0] == k][:4])]


def test_slot_odd_values(spark):
    """Text in number columns, negative zero, unknown tables and columns, in any number of parts."""
    tables = spark.createDataFrame([("t", ["A", "B"], ["text", "real"])], "table_id string, header array<string>, types array<string>")
    data = [("t", i, [f"x{i}", v]) for i, v in enumerate(["-0", "3d", "3", "NaN", "1e1", "0.0", None, "x"])]
    rows = spark.createDataFrame(data, "table_id string, row_id long, cells array<string>")
    cases = [
        ("zero", "t", 0, 3, [(1, 0, "0", True)]), ("three", "t", 0, 3, [(1, 0, "3", True)]), ("more", "t", 0, 3, [(1, 1, "3", True)]),
        ("lost", "u", 0, 3, []), ("lost list", "u", 0, 0, []), ("column", "t", 5, 0, []), ("total", "t", 1, 4, []),
    ]
    for part in (100, 3, 1):
        got, frame = run(spark, (tables, rows), cases, part=part)
        assert {k: got[k]["num"] for k in ("zero", "three", "more", "total")} == {"zero": 2, "three": 1, "more": 4, "total": 16}
        assert all(got[k]["error"] for k in ("lost", "lost list", "column")) and len(got) == len(cases)
    other = spark.createDataFrame([(q, "u", 1, 0, []) for q in ("lost", "lost list")], frame.schema)
    scores = sc.execution_scores(frame.filter("table_id = 'u'"), other, tables, rows).collect()
    assert [r["ex"] for r in scores] == [0, 0]


def test_long_key_chain(spark):
    n = 30
    edges = [(i, i + 1) for i in range(n - 1)]
    edges = sorted([(a, b, 10 * a, 10 * b) for a, b in edges] + [(b, a, 10 * b, 10 * a) for a, b in edges])
    graph = spark.createDataFrame([("d", edges)], "db_id string, edges array<struct<a:int,b:int,a_col:int,b_col:int>>")
    items = spark.createDataFrame([(1, "d", [0, n - 1])], "item_id int, db_id string, used array<int>")
    row = sm.complete_from(items, graph).first()
    assert row["tables"] == list(range(n)) and len(row["conds"]) == n - 1


def test_no_text_is_lost(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["new"])], "k int, toks array<string>")
    vocab = ft.build_vocabulary(frame.limit(1).select(F.explode("toks").alias("word")))
    ids = ft.to_ids(frame, vocab, "k")
    assert {r["k"]: r["ids"] for r in ids.collect()} == {1: [1, 3, 4, 3, 2], 2: [1, 2], 3: [1, 0, 2]}
    assert {r["k"]: r["text"] for r in ft.ids_to_text(ids, vocab, "k").collect()} == {1: "a b a", 2: "", 3: ""}


def test_vectors_of_one_place(spark):
    used = spark.createDataFrame([(w, 5) for w in "dbca"], "word string, place int")
    vectors = spark.createDataFrame([(w, 1.0) for w in "abcde"], "word string, first double").repartition(3)
    assert {r["word"]: r["id"] for r in ft.used_vectors(used, vectors, "place").collect()} == {"a": 3, "b": 4, "c": 5, "d": 6}


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_draws_do_not_depend_on_parts(spark, parts):
    df = spark.range(50).repartition(parts).select("id", unit(1, "x", "id").alias("u"))
    assert {r["id"]: r["u"] for r in df.collect()} == {r["id"]: r["u"] for r in spark.range(50).coalesce(1).select("id", unit(1, "x", "id").alias("u")).collect()}


# ---- schemas and links -----------------------------------------------------------------------


def test_key_map_is_greedy(spark):
    raw = spark.createDataFrame([("d", [[1, 2], [3, 4], [2, 3]])], "db_id string, foreign_keys array<array<int>>")
    got = {(r["col_id"], r["first_col"]) for r in sm.key_map(raw).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (3, 3), (4, 3)}  # the last key joins the first set; sets are not merged


def test_links(spark):
    q = spark.createDataFrame([(1, "d", "show the order date of all pre orders in 2019".split())], "item_id long, db_id string, toks array<string>")
    cols = spark.createDataFrame([("d", 0, -1, "*", "text"), ("d", 1, 0, "order date", "time"), ("d", 2, 0, "date", "number"), ("d", 3, 0, "pre-tax", "number"), ("d", 4, 0, "of all", "text")],
                                 "db_id string, col_id int, tab_id int, name string, type string")
    got = {(r["q_id"], r["col_id"]): r["link"] for r in lk.column_links(q, cols).collect()}
    assert got == {(2, 1): "CEM", (3, 1): "CEM", (3, 2): "CEM", (6, 3): "CPM", (4, 4): "CEM", (5, 4): "CEM"}
    nums = {(r["q_id"], r["col_id"], r["link"]) for r in lk.number_links(q, cols).collect()}
    assert nums == {(9, 1, "TIME"), (9, 2, "NUMBER"), (9, 3, "NUMBER")}


def test_repeated_database_fails(spark):
    row = ("d", ["t"], ["t"], [["-1", "*"], ["0", "a"]], [["-1", "*"], ["0", "a"]], ["text", "text"], [1], [])
    raw = spark.createDataFrame([row, row], rd.SCHEMA_FIELDS)
    with pytest.raises(Exception, match="repeated database id"):
        rd.split_schemas(raw)["columns"].collect()


# ---- mining and synthesis ----------------------------------------------------------------------


def test_mining(spark):
    q = texts(spark, 'SELECT T1.name FROM t AS T1 WHERE T1.age > 5 AND T1.city = "New York" ORDER BY T1.age DESC LIMIT 3;')
    slots = mi.slot_columns(mi.mask_literals(F.col("v")), F.array(F.lit("name"), F.lit("age"), F.lit("city")), F.array(F.lit("t")))
    pattern = mi.collapse_from(F.array_join(slots, " "))
    assert one(q, pattern) == "SELECT {COLUMN0 {FROM} WHERE {COLUMN1 > {VALUE_NUM} AND {COLUMN2 = {VALUE_STR} ORDER BY {COLUMN1 DESC LIMIT {VALUE_NUM}"
    assert one(q, mi.generalise(pattern, "tuned")) == "SELECT {COLUMN0} {FROM} WHERE {COLUMN1} {OP} {VALUE} AND {COLUMN2} {OP} {VALUE} ORDER BY {COLUMN1} {DASC} LIMIT {VALUE}"
    assert one(q, mi.generalise(pattern, "short")) == "SELECT WHERE ORDER BY LIMIT"


@pytest.fixture(scope="module")
def spoken(spark):
    col = lambda t, i, ty: (i, f"{t} col{i} x{i}", f"col{i}", ty, str(i * 11))
    tables = [(k, f"t{k}", [(0, f"t{k} t{k} *", "*", "text", "all")] + [col(f"t{k}", i, "real" if i % 2 else "text") for i in range(1, 6)]) for k in range(60)]
    df = spark.createDataFrame(tables, "table_id long, name string, cols array<struct<pos:int,name:string,original:string,type:string,value:string>>")
    dbs = sy.add_key_column(sy.group_tables(df, "table_id", 1), "table_id", 2).withColumn("n", F.lit(4))
    drawn = sy.draw_templates(dbs, sy.prepare_templates(template_frame(spark)), 3)
    return sy.label_examples(sy.verbalise(sy.fill_slots(drawn, 4), phrase_frame(spark), 5))


def test_slots_are_filled(spoken):
    rows = spoken.collect()
    assert len(rows) > 100 and {len(r["tables"]) for r in rows} == {1, 2}
    for r in rows:
        assert set(r["slots"]) == set(r["values"]), r["pattern"]
        assert all(v is not None for v in r["values"].values())
        assert "{" not in r["sql_text"] and "{" not in r["question_text"] and "SC" not in r["question_text"], (r["sql_text"], r["question_text"])
        known = {c["name"] for t in r["tables"] for c in t["cols"]} | {"*"}
        assert set(r["example_labels"]) <= known
        if len(r["tables"]) == 1:
            assert r["template_id"] != 6


def test_from_marked_lines_to_examples(spark, tmp_path):
    """A file of marked tables, with text keys, to final examples in one chain; the budget counts pieces."""
    lines = ["<special7> my list of town {0} <special8> town name <special9> rome {0} <special8> size <special9> {0} <special8> shop kind <special9> bakery".format(w) for w in ("alpha", "beta", "gamma", "delta", "omega", "alpha")]
    (tmp_path / "tables.txt").write_text("\n".join(lines) + "\n")
    tables = rd.read_marked_tables(spark, str(tmp_path / "tables.txt"))
    assert tables.count() == 6 and dict(tables.dtypes)["table_id"] == "string"
    vocab = pc.words_and_letters(spark.createDataFrame([("the",)], "word string"), 1)
    made = lambda **o: sy.synthesise(tables, "table_id", template_frame(spark), phrase_frame(spark), 40, 7, **o)
    rows = made().collect()
    dbs = {r.db_id for r in rows}
    assert len(rows) > 15 and len(dbs) >= 3 and dbs <= {r.table_id for r in tables.collect()}
    for r in rows:
        assert len(r.columns) == len(r["values"]) == len(r.column_labels) and r.question == r.question.lower() and "{" not in r.question
        assert any(r.column_labels)
    assert {tuple(r) for r in map(lambda r: (r.db_id, r.sample_no, r.question), made().collect())} == {(r.db_id, r.sample_no, r.question) for r in rows}
    every = pc.by_vocabulary(vocab)  # only letters are known, so nearly every word is one unknown piece
    words = {(r.db_id, r.sample_no): len(f"<s> {r.question} </s> {' </s> '.join(r.columns)} </s>".split()) for r in rows}
    limit = sorted(words.values())[len(words) // 2]
    kept = {(r.db_id, r.sample_no) for r in made(cut=pc.by_broadcast(lambda w, _: [w], 0), budget=limit).collect()}
    assert kept == {k for k, n in words.items() if n <= limit}
    assert made(cut=every, budget=0).count() == 0


def test_final_examples(spark, spoken):
    rows = sy.final_examples(spoken).collect()
    assert len(rows) == spoken.count()
    for r in rows:
        assert len(r["columns"]) == len(r["values"]) == len(r["column_labels"]) and r["columns"][0] == "*"
        assert max(r["column_labels"]) > 0 and r["question"] == r["question"].lower()


# ---- structure ------------------------------------------------------------------------------------


def test_empty_prediction_scores(spark):
    from tablequarry.plans import structs as st
    none = st._full(f"cast(array() as array<struct<agg:int,unit:{ss.VAL_UNIT}>>)", [])
    df = spark.sql(f"select 1 as item_id, {st._full(st._sel((0, 'a.b')), ['a'])} as gold, {none} as pred, map('x', 'y') as keys")
    r = ss.score_pairs(df).first()
    assert r["exact"] == 0 and r["parts"]["select"]["score"] == 0 and r["parts"]["where"]["score"] == 1 and r["hardness"] == "easy"


# ---- files ------------------------------------------------------------------------------------------


def test_line_numbers_over_parts(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = rd.numbered_lines(spark, str(path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 3000 and all(r["value"].startswith(f"line {r['line_no']} ") or r["value"].strip() == f"line {r['line_no']}" for r in rows)


def test_template_file(spark, tmp_path):
    path = tmp_path / "templates.txt"
    path.write_text("SQL Pattern: SELECT {COLUMN0} {FROM} ||| P0== | C0-id\ncount: 3\nquestion:  show {COLUMN0} ||| P1==\nquestion:  list {COLUMN0}\n\nSQL Pattern: SELECT *\ncount: 1\nquestion:  all\n")
    a, b = sorted(rd.read_templates(spark, str(path)).collect(), key=lambda r: r["block"])
    assert a["pattern"] == "SELECT {COLUMN0} {FROM}" and a["constraints"] == ["P0==", "C0-id"] and a["count"] == 3
    assert [(q["text"].strip(), q["constraints"]) for q in a["questions"]] == [("show {COLUMN0}", ["P1=="]), ("list {COLUMN0}", [])]
    assert b["pattern"] == "SELECT *" and b["constraints"] == []


def test_schema_and_tagged_files(spark, tmp_path):
    schema = [{"db_id": "d", "table_names": ["t"], "table_names_original": ["T"], "column_names": [[-1, "*"], [0, "a b"]], "column_names_original": [[-1, "*"], [0, "aB"]],
               "column_types": ["text", "number"], "primary_keys": [1], "foreign_keys": []}]
    (tmp_path / "tables.json").write_text(json.dumps(schema))
    cols = rd.read_db_schemas(spark, str(tmp_path / "tables.json"))["columns"].orderBy("col_id").collect()
    assert [(c["tab_id"], c["name"], c["type"]) for c in cols] == [(-1, "*", "text"), (0, "a b", "number")]
    (tmp_path / "200-tagged").mkdir()
    (tmp_path / "200-page").mkdir()
    head = "row\tcol\tid\tcontent\ttokens\tlemmaTokens\tposTags\n"
    body = "".join(f"{r}\t{c}\tx\ty\tz\t{'h|' if r < 0 else ''}{c + 1 if c else 'w'}{r if r > 0 else ''}\tp\n" for r in range(-1, 5) for c in range(2))
    (tmp_path / "200-tagged" / "0.tagged").write_text(head + body)
    (tmp_path / "200-page" / "0.json").write_text(json.dumps({"title": "Great rivers"}))
    t = rd.read_tagged_tables(spark, f"{tmp_path}/200-tagged/*.tagged", f"{tmp_path}/200-page/*.json").first()
    assert t["name"] in ("rivers", "Great rivers") and [c["type"] for c in t["cols"]] == ["text", "text", "real"] and t["cols"][2]["values"] == ["2", "21", "22"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q", ["a"], ["1"], [2])], "question string, columns array<string>, values array<string>, column_labels array<int>")
    sk.write_examples(rows, str(tmp_path / "ex"))
    assert spark.read.json(str(tmp_path / "ex")).first()["rows"] == [["1"]]
    lines = rows.select(sk.caption_line(F.col("question"), F.col("columns"), F.col("column_labels")).alias("line"))
    sk.write_lines(lines, "line", str(tmp_path / "cap"))
    back = rd.read_caption_corpus(spark, str(tmp_path / "cap")).first()
    assert back["text"] == "<s> q </s> a </s>" and back["labels"] == [2]
    sk.write_vocab(spark.createDataFrame([(0, "a")], "id int, word string"), str(tmp_path / "v"))
    sk.write_sections(spark.createDataFrame([("train", 1)], "section string, id int"), str(tmp_path / "s"))
    sk.write_rows(rows, str(tmp_path / "r"))
    sk.write_rows(rows.limit(0), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_label_ids_and_last_schema(spark):
    from tablequarry.operators.vocab import frequency_ids

    labels = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "label string")
    assert {r["label"]: (r["n"], r["label_id"]) for r in frequency_ids(labels, "label").collect()} == {"c": (2, 1), "a": (1, 2), "b": (1, 3)}
    rows = [(1, [([("x", "1")],)]), (2, [([("x", "1")],)]), (2, [([("x", "1")],)]), (3, [([("x", "2")],)])]
    df = spark.createDataFrame(rows, "db_id int, tables array<struct<cols:array<struct<name:string,value:string>>>>")
    assert sorted(r["db_id"] for r in sy.keep_last_schema(df).collect()) == [2, 2, 3]


def test_filled_sql(spark):
    df = spark.createDataFrame([("SELECT {COLUMN0} {FROM} WHERE {COLUMN1} {OP0} {VALUE0}", {"{COLUMN0}": "t a b", "{COLUMN1}": "t c", "{OP0}": ">", "{VALUE0}": "5 km"})], "p string, m map<string,string>")
    assert one(df, tf.fill_sql(F.col("p"), F.col("m"))) == "SELECT t_=_a_=_b WHERE t_=_c > 5 km"


# ---- joins of frames that are larger than the files they come from --------------------------------


def _stored(spark, folder, **frames):
    """The frames written as small files, so Spark's estimates take them for tiny."""
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(str(folder / name))
    return [spark.read.parquet(str(folder / name)) for name in frames]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_from_checks_gather_no_frame_on_the_driver(spark, tmp_path):
    cols, keys, cands = _stored(
        spark, tmp_path,
        cols=([("d", 0, 0), ("d", 1, 0), ("d", 2, 1), ("d", 3, 1)], "db_id string, col_id int, tab_id int"), keys=([("d", 0, 1, 2)], "db_id string, fk_no int, from_col int, to_col int"),
        cands=([(1, 10, "d", [0, 1], [0], [1, 2], 0.1), (1, 11, "d", [0, 1], [0], [], 0.9), (2, 20, "d", [0, 0], [0], [], 0.2), (2, 21, "d", [1, 1], [0], [], 0.3)],
               "item_id long, cand long, db_id string, tables array<int>, columns array<int>, key_columns array<int>, score double"),
    )
    edges = sm.edges_of(keys, cols)
    assert [tuple(e) for e in edges.first()["edges"]] == [(0, 1, 1, 2), (1, 0, 2, 1)]
    best = rk.rerank_by_from(cands, cols, edges, "item_id", "cand", 1)
    assert "Broadcast" not in _plan(best) and "Broadcast" not in _plan(sm.table_shapes(cols, cols.select("db_id", "tab_id").distinct(), keys))
    assert {(r["item_id"], r["cand"]) for r in best.collect()} == {(1, 10), (2, 21)}  # item 2 has none that holds


def test_links_gather_no_frame_on_the_driver(spark, tmp_path):
    q, cols, tabs, cells, raw = _stored(
        spark, tmp_path, q=([(1, "d", "show the order date of red in 2019".split()), (2, "e", ["order"]), (3, None, ["order"])], "item_id long, db_id string, toks array<string>"),
        cols=([("d", 0, -1, "*", "text"), ("d", 1, 0, "order date", "time"), ("d", 2, 0, "date", "number"), ("d", 3, 0, None, "text"), (None, 1, 0, "order", "text")],
              "db_id string, col_id int, tab_id int, name string, type string"),
        tabs=([("d", 0, "order"), ("d", 1, "order")], "db_id string, tab_id int, name string"), cells=([("d", 3, "dark red"), ("d", 3, "Red")], "db_id string, col_id int, cell string"),
        raw=([("d", ["order", "order"], [["-1", "*"], ["0", "date"]], [1], [[1, 1]])], "db_id string, table_names array<string>, column_names array<array<string>>, primary_keys array<int>, foreign_keys array<array<int>>"),
    )
    names = lk.schema_names(cols, tabs)
    exact = lk.exact_links(q, names)
    assert {tuple(r)[1:] for r in exact.collect()} == {(2, "column", 1, "CEM"), (3, "column", 1, "CEM"), (3, "column", 2, "CEM"), (2, "table", 0, "TEM"), (2, "table", 1, "TEM")}
    both = lk.name_links(q, names)
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in exact.collect()}
    given = spark.read.parquet(str(tmp_path / "q")).select("item_id", F.lit(0).alias("q_id"), F.lit("table").alias("kind"), F.lit(0).alias("target"), F.lit("TEM").alias("link"))
    number, cell = lk.number_links(q, cols), lk.cell_links(q, cells)
    assert {tuple(r) for r in number.collect()} == {(1, 7, 1, "TIME"), (1, 7, 2, "NUMBER")} and {tuple(r) for r in cell.collect()} == {(1, 5, 3, "CELLMATCH")}
    for df in (exact, number, cell, lk.item_records(q, raw, given, F.lit("train")), lk.relations(q, raw, given)):
        assert "Broadcast" not in _plan(df)
    assert _plan(lk.name_links(q, names)).count("BroadcastExchange") == 1  # the distinct names, each cut once


def test_links_to_pieces_gather_no_frame_on_the_driver(spark, tmp_path):
    links, words = _stored(spark, tmp_path, links=([(1, 0, "a"), (1, 1, "b"), (1, 1, "c")], "item_id long, word_no int, link string"),
                           words=([(1, 0, 0), (1, 1, 2)], "item_id long, word_no int, first int"))
    made = ft.links_to_pieces(links, words, "item_id")
    assert "Broadcast" not in _plan(made)
    assert sorted((r["link"], r["piece_no"]) for r in made.collect()) == [("a", 0), ("b", 2), ("c", 2)]


def test_labels_of_columns_only(spark):
    """Stars and columns get the label of their own clause, direction and limit, several joined in order."""
    (got,) = spark.sql("select 'SELECT {COLUMN0} , count ( * ) {FROM} WHERE {COLUMN1} {OP0} {VALUE0} GROUP BY {COLUMN0} ORDER BY count ( * ) {DASC} LIMIT {VALUE1}' as p").select(sy.label_columns(F.col("p"))).first()
    assert got == {"{COLUMN0}": "SELECT GROUP_BY", "*": "SELECT count ORDER_BY count {DASC} LIMIT", "{COLUMN1}": "WHERE {OP0}"}


def test_pattern_members_make_patterns_once(spark, tmp_path):
    from tablequarry.plans import QUERIES

    _stored(spark, tmp_path, **{"orders.parquet": ([(i, i, "O", 5.0 + i, "1-HIGH") for i in range(12)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")})
    made = QUERIES["a7_pattern_members"](spark, str(tmp_path))
    assert "regexp_replace" not in _plan(made)
    assert {r["count"] for r in made.collect()} == {2} and made.count() == 12


def test_marked_lines_are_parsed_once(spark, tmp_path):
    line = "<special7> big list <special8> a b <special9> 1 <special8> cd <special9> x y <special8> ef <special9> z"
    (lines,) = _stored(spark, tmp_path, lines=([(1, line), (2, "<special7> big <special8> a b <special9> 1"), (3, None), (4, line.replace("big list", "1"))], "table_id long, value string"))
    made = rd.parse_marked_lines(lines, "table_id").select("table_id", F.explode("cols").alias("c")).filter("c.pos is not null")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("lower(value") == 1
    assert [(r["table_id"], r["c"]["pos"], r["c"]["original"], r["c"]["type"]) for r in made.collect()] == [(1, 0, "*", "text"), (1, 1, "a b", "real"), (1, 2, "cd", "text"), (1, 3, "ef", "text")]


def test_productions_draw_the_queries_at_most_twice(spark, tmp_path):
    from tablequarry.plans import QUERIES

    _stored(spark, tmp_path, **{"orders.parquet": ([(i, i, "O", 5.0 + i, "1-HIGH") for i in range(40)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")})
    made = QUERIES["a11_productions"](spark, str(tmp_path))
    rules = [tuple(r) for r in made.collect()]
    assert [r[0] for r in sorted(rules)] == list(range(len(rules))) and {r[1] for r in rules} >= {"agg", "op", "sql", "cond*"}
    assert _plan(made).split("== Initial Plan ==")[0].count("Scan parquet") <= 2  # with and without the filter of the explode


def test_words_of_many_rows_are_looked_up_on_the_row(spark):
    """Ids are the same however many words are looked up on the row."""
    rows = spark.createDataFrame([(i, ["a", "b", f"w{i}", None, "zz"], ["a"] if i else None) for i in range(40)], "key int, one array<string>, two array<string>")
    rows = rows.unionByName(rows.filter("key = 7"))  # a key that stands twice
    vocab = spark.createDataFrame([(1, "a", 80), (2, "b", 40)] + [(10 + i, f"w{i}", 1) for i in range(40)], "id int, word string, n long")
    got = {}
    for known in (1, 2, 50):
        got[known] = {r.key: r for r in ft.sequence_ids(rows, "key", ["one", "two"], vocab, known=known).collect()}
    assert got[1] == got[2] == got[50] and len(got[2]) == 40
    assert got[2][3].one == [1, 2, 13, 0, 0] and got[2][3].two == [1] and got[2][0].two == []
    assert got[2][7].one == [1, 1, 2, 2, 17, 17, 0, 0, 0, 0] and got[2][7].two == [1, 1]


def counted(spark, df, column):
    """The frame with a counter of the rows that its column is made for."""
    count = spark.sparkContext.accumulator(0)

    def seen(x):
        count.add(1)
        return x

    made = F.udf(seen, df.schema[column].dataType).asNondeterministic()
    return df.withColumn(column, made(column)), count


def test_execution_guided_reads_its_parts_once(spark):
    tables = spark.createDataFrame([("t", ["text", "real"])], "table_id string, types array<string>")
    rows = spark.createDataFrame([("t", i, [f"c{i}", str(i)]) for i in range(5)], "table_id string, row_id long, cells array<string>")
    selects = spark.createDataFrame([(i, "t", s, a, 0.1 * s + 0.01 * a) for i in range(6) for s in (0, 1) for a in (0, 3, 5)], "item_id int, table_id string, sel int, agg int, prob double")
    conds = [(i, 0, 0, v, False, p) for i in range(6) for v, p in (("c1", 0.9), ("nowhere", 0.95))]
    conditions = spark.createDataFrame(conds, "item_id int, col int, op int, val string, is_num boolean, prob double")
    counts = spark.createDataFrame([(i, n, 0.2 + 0.1 * n) for i in range(6) for n in range(3)], "item_id int, n int, prob double")
    selects, n_selects = counted(spark, selects, "prob")
    conditions, n_conditions = counted(spark, conditions, "prob")
    got = rk.execution_guided(selects, conditions, counts, tables, rows, 2).collect()
    assert n_selects.value == 36 and n_conditions.value == 12
    assert len(got) == 6 and all((r.sel, r.agg) == (1, 5) and [c.val for c in r.conds] in (["nowhere", "c1"], ["nowhere"]) for r in got)


def test_execution_scores_read_the_queries_once(spark):
    tables = spark.createDataFrame([("t", ["text", "real"])], "table_id string, types array<string>")
    rows = spark.createDataFrame([("t", i, [f"c{i % 3}", str(i)]) for i in range(9)], "table_id string, row_id long, cells array<string>")
    schema = "query_id int, table_id string, sel int, agg int, conds array<struct<col:int,op:int,val:string,is_num:boolean>>"
    gold = spark.createDataFrame([(1, "t", 1, 0, [(0, 0, "c1", False)]), (2, "t", 1, 4, []), (3, "t", 0, 0, [(1, 1, "6", True)])], schema)
    made = spark.createDataFrame([(1, "t", 1, 0, [(0, 0, "C1", False)]), (2, "t", 1, 5, []), (3, "t", 0, 0, [(1, 1, "5", True)])], schema)
    gold, n_gold = counted(spark, gold, "sel")
    made, n_made = counted(spark, made, "sel")
    got = {r.query_id: (r.ex, r.lf) for r in sc.execution_scores(gold, made, tables, rows).collect()}
    assert got == {1: (1, 1), 2: (0, 0), 3: (0, 0)}
    assert n_gold.value == 3 and n_made.value == 3


def test_pieces_of_one_letter_are_not_joined(spark, monkeypatch):
    """Greedy pieces by brute force over odd words; single letters and parts longer than any piece make no rows."""
    made = []
    spans = pc._spans
    monkeypatch.setattr(pc, "_spans", lambda *a: made.append(spans(*a)) or made[-1])
    pieces = ["a", "##a", "##b", "b", "ab", "##", "##ab", "#", "###", "é", "##é", "ba", "##ba", "", None]
    words = ["a", "ab", "abab", "bab", "##ab", "##", "#a", "éa", "aaé", "zz", "az", "a" * 101, "a" * 100, "béba", ""]
    vocabulary = spark.createDataFrame([(p,) for p in pieces + ["ab"]], "piece string")
    got = {r.word: r.pieces for r in pc.by_vocabulary(vocabulary)(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {w: pc.word_pieces(w, set(pieces)) if w else ["[UNK]"] for w in words}
    long = spark.createDataFrame([("b" * 50,)], "word string")
    pc.by_vocabulary(vocabulary)(long)
    assert made[-1].count() <= 3 + 49
    pc.by_vocabulary(vocabulary.filter("length(replace(piece, '##', '')) = 1"))(long)
    assert made[-1].count() <= 2  # beginnings as long as a marked letter


def test_frequent_words_are_counted_on_the_row(spark):
    data = [(1, ["ab", "a", "zz", "ab"]), (2, []), (3, None), (1, ["c", "ab", None]), (None, ["ab", "zz"]), (4, ["c"] * 30)]
    df = spark.createDataFrame(data, "id long, toks array<string>")
    counts = df.select(F.explode("toks").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    cut = pc.by_vocabulary(spark.createDataFrame([("a",), ("##b",), ("c",)], "piece string"))
    want = {1: 2 + 1 + 1 + 2 + 1 + 2, 2: 0, 3: 0, None: 2 + 1, 4: 30}
    for frequent in (0, 1, 2, 100):
        got = {r.id: r.n_tokens for r in pc.token_counts(df, "id", "toks", cut, counts=counts, frequent=frequent).collect()}
        assert got == want


def test_slots_are_filled_once(spark):
    """The given rows of ``verbalise`` and ``group_tables`` are made once, whatever reads them."""
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    noted = F.udf(note, "long").asNondeterministic()
    tables = spark.range(40).select(noted("id").alias("table_id"), F.lit("t").alias("name"), F.expr("array(named_struct('name', concat('c', id)))").alias("cols"))
    assert sy.group_tables(tables, "table_id", 1).count() >= 20
    assert seen.value == 40
    values = F.expr("map('{OP0}', '=', '{VALUE0}', 'x')")
    name = lambda c: F.struct(F.lit(c).alias("name")).alias(c)
    rows = spark.range(30).select(
        noted("id").alias("db_id"), F.lit(1).alias("sample_no"), F.lit("a {OP0} {VALUE0}").alias("pattern"), F.lit("that {OP0} {VALUE0}").alias("question"),
        F.array(F.lit("{OP0}"), F.lit("{VALUE0}")).alias("q_slots"), values.alias("values"), name("t0"), name("t1"), F.lit(1).alias("number"),
    )
    said = sy.verbalise(rows, phrase_frame(spark), 5).collect()
    assert seen.value == 70 and len(said) == 30
    assert {r.question_text for r in said} == {"that is x", "that equals x"} and {r.sql_text for r in said} == {"a = x"}


def _orders(spark, folder):
    """Three customers and their orders, one file each, in the shape of the given tables."""
    spark.range(1, 4).selectExpr("id as c_custkey", "'BUILDING' as c_mktsegment").coalesce(1).write.parquet(str(folder / "customer.parquet"))
    spark.range(1, 61).selectExpr("id as o_orderkey", "id % 3 + 1 as o_custkey", "'O' as o_orderstatus", "id * 1.5d as o_totalprice", "if(id % 2 = 0, '1-URGENT', '5-LOW') as o_orderpriority").coalesce(1).write.parquet(str(folder / "orders.parquet"))
    return Tables(spark, str(folder))


def test_captions_of_one_row_group_are_made_in_several_tasks(spark, tmp_path, monkeypatch):
    t, kept = _orders(spark, tmp_path), []
    monkeypatch.setattr(text_plans, "stored_rows", lambda df: kept.append(df) or df)
    assert text_plans.x17_three_sequences(t).count() == 60
    assert "REPARTITION_BY_COL" in _plan(kept[0])
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(kept[0]) == as_rows(text_plans.captions(t))


def test_pointers_are_read_without_the_tokens_of_their_input(spark, tmp_path):
    t = _orders(spark, tmp_path)
    back = rank_plans.k8_pointers_back(t)
    assert "[SEP]" not in _plan(back)
    want = plan_base.slot_queries(t).select("query_id", "sel", "agg", slot_plans._flat(sq.lower_conditions(F.col("conds"))).alias("conds"))
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    assert as_rows(back) == as_rows(want)


def test_pointer_input_with_words_of_any_size(spark):
    df = spark.sql("select array('a', 'b') as q, array(array('c'), array('d', 'e')) as h, array(array('s'), array('t', 'u', 'v')) as w")
    by_row = one(df, ft.header_input(F.col("q"), F.col("h"), F.col("w")))
    assert by_row["toks"] == "[CLS] s [SEP] t u v [SEP] a b [SEP] c [SEP] d e [SEP]".split()
    assert [tuple(s) for s in [*by_row["sql_spans"], by_row["question_span"], *by_row["header_spans"]]] == [(1, 2), (3, 6), (7, 9), (10, 11), (12, 14)]
    assert by_row["segments"] == [0, 1, 0, 1, 1, 1, 1, 0, 0, 0, 1, 0, 1, 1, 1]
    made = df.select("*", F.lit(1).alias("sel"), F.lit(0).alias("agg"), F.expr(f"cast(array() as {COND})").alias("conds"))
    made = ft.pointer_rows(made, "q", F.col("h"), [["s"], ["t", "u", "v"]], F.expr("cast(array() as array<struct<first:int,last:int>>)"))
    assert made.first()["x"] == by_row


def test_links_of_an_item_are_shuffled_once(spark, tmp_path):
    t = _orders(spark, tmp_path)
    links = link_plans.links(t)
    by_item = [line for line in _plan(links).splitlines() if "Exchange hashpartitioning(item_id#" in line]
    assert len(by_item) == 1 and "REPARTITION_BY_COL" in by_item[0]
    s = link_plans.schemas(t)
    names = lk.schema_names(s["columns"], s["tables"])
    column = lambda df, rank: df.selectExpr("item_id", "q_id", "'column' as kind", "col_id as target", "link", f"{rank} as rank")
    want = lk.name_links(link_plans.asked(t), names).withColumn("rank", F.lit(0)).unionByName(column(lk.cell_links(link_plans.asked(t), link_plans.cells(t)), 1))
    want = want.unionByName(column(lk.number_links(link_plans.asked(t), s["columns"]), 2)).groupBy("item_id", "q_id", "kind", "target").agg(F.min_by("link", "rank").alias("link"))
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    assert as_rows(links) == as_rows(want) and links.count() > 500


def test_item_records_leave_the_links_where_they_are(spark, tmp_path):
    t = _orders(spark, tmp_path)
    lines = _plan(link_plans.x14_item_records(t)).splitlines()
    assert sum("Exchange hashpartitioning(item_id#" in line for line in lines) == 2  # the links, and the questions with their names


def test_links_to_pieces_shuffle_by_item_only(spark, tmp_path):
    plan = _plan(link_plans.x15_links_to_pieces(_orders(spark, tmp_path)))
    assert "word_no" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    links = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (None, 1, "c"), (1, None, "d"), (2, 0, "e")], "item_id long, word_no int, link string")
    words = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 1, 5), (None, 1, 4), (1, None, 6)], "item_id long, word_no int, first int")
    made = ft.links_to_pieces(links, words, "item_id")
    assert made.columns == ["item_id", "link", "piece_no"] and sorted(map(tuple, made.collect())) == [(1, "a", 0), (1, "b", 2), (1, "b", 5)]
