"""Registered queries: text forms, vocabularies and training rows."""

from pyspark.sql import functions as F

from ..functions import names as nm, textforms as tf
from ..functions.seeded import unit
from ..operators import features as ft, pieces as pc, slotquery as sq
from ..operators.ordered import numbered_in_order
from ..session import stored_rows
from . import base as b
from .registry import Spread, query

TOKS = "string_split(regexp_replace(regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"
b.add_cte("doc_toks", f"select doc_id, [w for w in {TOKS} if w != ''] as toks from documents")
b.add_cte("turn_toks", f"select conv_id::varchar || '/' || turn::varchar as id, conv_id, turn, [w for w in {TOKS} if w != ''] as toks from conversations")


def words_of(text="text"):
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def doc_toks(t):
    return t.documents.select("doc_id", words_of().alias("toks"))


def turn_toks(t):
    return t.conversations.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", words_of().alias("toks"))


def digest(items, sep=" "):
    return F.md5(F.array_join(F.transform(items, lambda x: x.cast("string")), sep))


def digest_sql(items, sep=" "):
    return f"md5(coalesce(array_to_string([x::varchar for x in {items}], '{sep}'), ''))"


# ---- names and cells ---------------------------------------------------------------------

_GOOD = "[w for w in string_split(p_name || ' No-' || p_partkey::varchar || ' by Maker', ' ') if length(w) > 1 and not regexp_matches(w, '[-0-9]')]"
_TAKE = f"(case when {b.u_sql(0, 'title', 'p_partkey')} < 0.4 then 2 else 1 end)"


@query("p1_title_name", f"select p_partkey, array_to_string(good[-least(take, len(good)):], ' ') as name from (select p_partkey, {_GOOD} as good, {_TAKE} as take from part)")
def p1_title_name(t):
    title = F.concat("p_name", F.lit(" No-"), F.col("p_partkey").cast("string"), F.lit(" by Maker"))
    return t.part.select("p_partkey", nm.name_from_title(title, 0, "p_partkey").alias("name"))


@query("p2_name_words", f"select doc_id, count_if(length(w) > 1 and not regexp_matches(w, '[-0-9]')) as good, count(*) as words from (select doc_id, unnest(toks) as w from doc_toks) group by doc_id".replace("select doc_id, count_if", b.using("doc_toks") + "select doc_id, count_if", 1))
def p2_name_words(t):
    w = doc_toks(t).select("doc_id", F.explode("toks").alias("w"))
    return w.groupBy("doc_id").agg(F.count_if(nm.is_name_word(F.col("w"))).alias("good"), F.count(F.lit(1)).alias("words"))


@query(
    "p3_first_words",
    """select conv_id, turn, md5(array_to_string(string_split(text, ' ')[1:5], ' ')) as five, md5(array_to_string(string_split(text, ' ')[2:6], ' ')) as from_two,
       md5(case when len(string_split(text, ' ')) < 10 then text else array_to_string(string_split(text, ' ')[1:5], ' ') end) as header from conversations""",
)
def p3_first_words(t):
    c = F.col("text")
    return t.conversations.select(
        "conv_id", "turn", F.md5(nm.first_words(c, 5)).alias("five"), F.md5(nm.first_words(c, 5, start=2)).alias("from_two"),
        F.md5(nm.short_header(c)).alias("header"),
    )


@query(
    "p4_column_types",
    """select p_partkey, case when regexp_matches(p_size::varchar, '^[0-9]+$') then 'real' else 'text' end as size_type,
       case when regexp_matches(p_retailprice::varchar, '^[0-9]+$') then 'real' else 'text' end as price_type,
       case when regexp_matches(p_partkey::varchar, '^[0-9]+$') or regexp_matches(p_brand, '^[0-9]+$') then 'real' else 'text' end as any_type from part""",
)
def p4_column_types(t):
    kind = lambda c: F.when(nm.is_number_text(c.cast("string")), "real").otherwise("text")
    cells = F.array(F.col("p_partkey").cast("string"), F.col("p_brand"))
    return t.part.select(
        "p_partkey", kind(F.col("p_size")).alias("size_type"), kind(F.col("p_retailprice")).alias("price_type"),
        F.when(F.exists(cells, nm.is_number_text), "real").otherwise("text").alias("any_type"),
    )


@query(
    "p7_split_names",
    """select p_partkey, lower(trim(replace(regexp_replace(p_type || 'Of_' || p_brand, '([A-Z]+)', ' \\1', 'g'), '_', ' '))) as words from part""",
)
def p7_split_names(t):
    return t.part.select("p_partkey", nm.split_original(F.concat("p_type", F.lit("Of_"), "p_brand")).alias("words"))


_AFTER = f"case when {b.u_sql(7, 'after', 'id', '(i - 1)')} < 0.8 then ' ' else '' end"


@query(
    "p8_rebuild",
    b.using("turn_toks") + f"select id, md5(trim(coalesce(array_to_string(list_transform(toks, lambda x, i: x || {_AFTER}), ''), ''))) as text from turn_toks",
)
def p8_rebuild(t):
    after = F.transform("toks", lambda x, i: F.when(unit(7, "after", F.col("id"), i) < 0.8, " ").otherwise(""))
    return turn_toks(t).select("id", F.md5(tf.rebuild(F.col("toks"), after)).alias("text"))


@query(
    "p9_merge_tokens",
    b.using("slot_questions") + "select query_id, array_to_string([lower(c.val) for c in conds], '|') as merged, array_to_string([lower(c.val) for c in conds], '|') as given from slot_questions",
)
def p9_merge_tokens(t):
    from ..operators import spans

    q = b.slot_questions(t)
    merged = F.transform("conds", lambda c: spans.merge_tokens(F.split(c.val, " "), F.col("question")))
    return q.select("query_id", F.array_join(merged, "|").alias("merged"), F.array_join(F.transform("conds", lambda c: F.lower(c.val)), "|").alias("given"))


@query(
    "p10_undo_pieces",
    """select conv_id, turn, md5(replace(replace(replace(trim(replace('<special7> ' || replace(text, 'en', 'e@@ n') || ' <special8> x <special9>', '@@ ', '')),
       '<special7>', '<s>'), '<special8>', '</s>'), '<special9>', '<unk>')) as line from conversations""",
)
def p10_undo_pieces(t):
    line = F.concat(F.lit("<special7> "), F.replace("text", F.lit("en"), F.lit("e@@ n")), F.lit(" <special8> x <special9>"))
    return t.conversations.select("conv_id", "turn", F.md5(tf.undo_pieces(line)).alias("line"))


@query(
    "p17_basic_tokens",
    """select doc_id, len(toks) as n, md5(coalesce(array_to_string(toks, ' '), '')) as toks from (select doc_id, [w for w in regexp_split_to_array(
       regexp_replace(strip_accents(lower(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\\x{ad}\\x{200b}-\\x{200f}\\x{feff}\\x{fffd}]', '', 'g'),
       '[\\pZ\\t\\n\\r]', ' ', 'g'))), '([\\pP$+<=>^`|~])', ' \\1 ', 'g'), '[ \\t\\n\\r]+') if w != ''] as toks from documents)""",
)
def p17_basic_tokens(t):
    return t.documents.select("doc_id", tf.basic_tokens(F.col("text")).alias("toks")).select(
        "doc_id", F.size("toks").cast("long").alias("n"), F.md5(F.array_join("toks", " ")).alias("toks")
    )


_CLEAN = "text2"
for _old, _new in tf.CLEANUPS:
    _CLEAN = "replace({}, '{}', '{}')".format(_CLEAN, _old.replace("'", "''"), _new.replace("'", "''"))


@query(
    "p20_ids_to_text",
    b.using("turn_toks", "doc_toks") + f""", v as (select row_number() over (order by word) + 2 as vid, word from (select distinct word from (select unnest(toks) as word from doc_toks))), f as (select id, i, toks[i] as w from turn_toks, unnest(range(1, len(toks) + 1)) as r(i)),
       g as (select id, coalesce(text2, '') as text2 from turn_toks left join (select id, string_agg(w, ' ' order by i) as text2 from f join v on v.word = w group by id) using (id))
       select id, md5({_CLEAN}) as text from g""",
)
def p20_ids_to_text(t):
    vocab = ft.build_vocabulary(doc_toks(t).select(F.explode("toks").alias("word")))
    ids = ft.to_ids(turn_toks(t), vocab, "id")
    return ft.ids_to_text(ids, vocab, "id").select("id", F.md5("text").alias("text"))


@query(
    "p21_keep_marks",
    b.using("slot_questions") + """select query_id, array_to_string([trim(p) for p in string_split(replace(replace(question, 'select', '#select#'), 'where', '#where#'), '#') if trim(p) != ''], '|') as parts
       from slot_questions""",
)
def p21_keep_marks(t):
    return b.slot_questions(t).select("query_id", F.array_join(tf.keep_marks(F.col("question"), ["select", "where"]), "|").alias("parts"))


@query("f9_token_budget", b.using("doc_toks") + "select doc_id, len(toks) as n from doc_toks where len(toks) <= 190")
def f9_token_budget(t):
    from ..operators.filters import within_budget

    return doc_toks(t).filter(within_budget(F.size("toks"), 190)).select("doc_id", F.size("toks").cast("long").alias("n"))


@query(
    "s16_word_vectors",
    "select 'w' || vec_id::varchar as word, len(embedding) as dim, embedding[1] as first, embedding[-1] as last from embeddings",
)
def s16_word_vectors(t):
    from ..sources.readers import read_word_vectors

    v = read_word_vectors(t.spark, f"{t.folder}/embeddings.parquet", "vec_id", "embedding")
    return v.select(
        F.concat(F.lit("w"), F.col("word").cast("string")).alias("word"), F.size("vec").cast("long").alias("dim"),
        F.get("vec", F.lit(0)).alias("first"), F.element_at("vec", -1).alias("last"),
    )


# ---- vocabulary --------------------------------------------------------------------------

_VOCAB = """, vocab as (select (row_number() over (order by word) + 2)::int as id, word, n from (select word, count(*) as n from (select unnest(toks) as word from doc_toks)
   group by word having count(*) >= 2 order by n desc, word limit 2000) union all values (0, '<UNK>', 0), (1, '<BOS>', 0), (2, '<EOS>', 0)) """


def doc_vocab(t):
    return ft.build_vocabulary(doc_toks(t).select(F.explode("toks").alias("word")), 2000, 2)


@query("a10_vocabulary", b.using("doc_toks") + _VOCAB + "select id, word, n from vocab")
def a10_vocabulary(t):
    return doc_vocab(t)


@query(
    "a10_schema_words",
    """select word, count(*) as n from (select distinct source, word from (select source, unnest(string_split(lang || ' ' || source, ' ')) as word from documents)) group by word""",
)
def a10_schema_words(t):
    words = t.documents.select("source", F.explode(F.split(F.concat_ws(" ", "lang", "source"), " ")).alias("word"))
    return ft.words_once_per_schema(words, "source", "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


b.add_cte(
    "train_words",
    """select unnest(toks) as word from asked where item_id % 10 != 0
       union all select unnest(list_concat(['<type: ' || type || '>'], string_split(name, ' '))) from db_col where db_id in (select db_id from asked where item_id % 10 != 0)
       union all select unnest(string_split(name, ' ')) from db_tab where db_id in (select db_id from asked where item_id % 10 != 0)""",
    "asked", "db_col", "db_tab",
)


@query(
    "a10_train_vocabulary",
    b.using("train_words") + """select id, word, n from (select (row_number() over (order by word) + 2)::int as id, word, n from (select word, count(*) as n from train_words group by word))
      union all select * from (values (0, '<UNK>', 0), (1, '<BOS>', 0), (2, '<EOS>', 0)) v(id, word, n)""",
)
def a10_train_vocabulary(t):
    from .links import asked, raw_schemas

    items = asked(t).withColumn("section", F.when(F.col("item_id") % 10 == 0, "val").otherwise("train"))
    return ft.build_vocabulary(ft.vocabulary_words(items, raw_schemas(t)))


@query(
    "j8_word_ids",
    b.using("doc_toks") + _VOCAB + """, f as (select doc_id, i, toks[i] as w from doc_toks, unnest(range(1, len(toks) + 1)) as r(i))
     select doc_id, count(f.w) + 2 as n, count_if(f.w is not null and vocab.id is null) as unknown,
       md5('1 ' || coalesce(string_agg(coalesce(vocab.id, 0)::varchar, ' ' order by i) filter (where f.w is not null) || ' ', '') || '2') as ids
     from doc_toks left join f using (doc_id) left join vocab on vocab.word = f.w group by doc_id""",
)
def j8_word_ids(t):
    ids = ft.to_ids(doc_toks(t), doc_vocab(t), "doc_id")
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n"), F.size(F.filter("ids", lambda x: x == 0)).cast("long").alias("unknown"), digest("ids").alias("ids")
    )


@query(
    "x2_id_lines",
    b.using("turn_toks", "doc_toks") + _VOCAB + """, f as (select id, i, toks[i] as w from turn_toks, unnest(range(1, len(toks) + 1)) as r(i))
     select t.id, coalesce(string_agg(coalesce(vocab.id, 0)::varchar, ' ' order by i) filter (where f.w is not null), '') as line
     from turn_toks t left join f on f.id = t.id left join vocab on vocab.word = f.w group by t.id""",
)
def x2_id_lines(t):
    ids = ft.to_ids(turn_toks(t), doc_vocab(t), "id", ends=False)
    return ids.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("line"))


@query("s13_vocab_lines", b.using("doc_toks") + _VOCAB + """select id, '{"id":' || id::varchar || ',"n":' || n::varchar || '}' as line from vocab""")
def s13_vocab_lines(t):
    return doc_vocab(t).select("id", F.to_json(F.struct("id", "n")).alias("line"))


@query(
    "x23_extend_vocabulary",
    b.using("turn_toks", "doc_toks") + _VOCAB + """, new as (select distinct unnest(toks) as word from turn_toks)
     select id, word from vocab union all select (row_number() over (order by word) + (select max(id) from vocab))::int, word from new where word not in (select word from vocab)""",
)
def x23_extend_vocabulary(t):
    return ft.extend_vocabulary(doc_vocab(t), turn_toks(t).select(F.explode("toks").alias("word")))


@query(
    "j14_word_vectors",
    b.using("doc_toks") + """, used as (select word, min(doc_id) as place from (select doc_id, unnest(toks) as word from doc_toks) group by word),
      w as (select word, row_number() over (order by word) - 1 as vec_id from (select distinct word from used)),
      v as (select word, embedding[1] as first from w join embeddings using (vec_id))
      select (row_number() over (order by place, word) + 2)::int as id, word, first from used join v using (word)""",
)
def j14_word_vectors(t):
    used = doc_toks(t).select("doc_id", F.explode("toks").alias("word")).select("word", F.col("doc_id").alias("place"))
    listed = numbered_in_order(used.select("word").distinct(), ["word"], "no").select("word", (F.col("no") - 1).alias("vec_id"))
    vectors = listed.join(t.embeddings, "vec_id").select("word", F.get("embedding", F.lit(0)).alias("first"))
    return ft.used_vectors(used, vectors, "place").select("id", "word", "first")


#: Words seen so often are pieces of the vocabulary of these queries, beside all letters.
_LEAST = 20

b.add_cte(
    "piece_words",
    f"""with recursive seen as (select word, count(*) as n from (select unnest(toks) as word from doc_toks) group by word),
       letter as (select distinct unnest(string_split(word, '')) as piece from seen),
       vocab as (select word as piece from seen where n >= {_LEAST} union select piece from letter union select '##' || piece from letter),
       start as (select word, i as first from seen, unnest(range(length(word))) as r(i) where length(word) <= 100),
       part as (select word, first, j as size from start, unnest(range(1, length(word) - first + 1)) as r(j)),
       step as (select word, first, max(size) as size from part semi join vocab on piece = case when first > 0 then '##' else '' end || substring(word, first + 1, size) group by word, first),
       walk as (select word, 0 as pos, 0 as n from seen union all
         select word, pos + size, walk.n + 1 from walk join step using (word) where step.first = walk.pos),
       last as (select word, max(n) filter (where pos = length(word)) as n from walk group by word)
       select word, coalesce(n, 1)::bigint as n from last""",
    "doc_toks",
)


@query(
    "x1_piece_counts",
    b.using("piece_words", "doc_toks") + """select doc_id, coalesce(sum(n), 0)::bigint as n_tokens
      from (select doc_id, unnest(case when len(toks) > 0 then toks else [null] end) as word from doc_toks) left join piece_words using (word) group by doc_id""",
)
def x1_piece_counts(t):
    toks = doc_toks(t)
    counts = stored_rows(toks.select(F.explode("toks").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    vocabulary = stored_rows(pc.counted_and_letters(counts, _LEAST))
    return pc.token_counts(toks, "doc_id", "toks", pc.by_vocabulary(vocabulary), counts=counts)


def byte_pair_files(spark):
    """Vocabulary and merges of a public byte-pair tokenizer, whose place is a parameter."""
    import public_tokenizers

    from ..sources.readers import read_tokenizer_json

    return read_tokenizer_json(spark, public_tokenizers.path("byte_bpe_50k.json"))


@query("x1_byte_pairs", None)
def x1_byte_pairs(t):
    vocabulary, merges = byte_pair_files(t.spark)
    turn = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    toks = t.conversations.select(turn.alias("id"), F.transform(pc.byte_words(F.coalesce("text", F.lit(""))), pc.visible_letters).alias("toks"))
    pieces = pc.tokenise(toks, "id", "toks", pc.by_merges(merges))
    ids = pc.piece_ids(pieces, "id", vocabulary, "<|endoftext|>")
    return pieces.join(ids, "id").select("id", F.size("pieces").alias("n"), F.array_join("pieces", " ").alias("pieces"), F.array_join("ids", " ").alias("ids"))


# ---- captions and their features ------------------------------------------------------------

# The caption of a slot query: question, a star column and the header names.
b.add_cte(
    "captions",
    """select query_id, string_split('<s> ' || question || ' </s> orders * </s> ' || array_to_string(header, ' </s> ') || ' </s> notes * </s> remark </s>', ' ') as toks,
       [(case when i = sel + 1 then agg + 1 when len([c for c in conds if c.col + 1 = i]) > 0 then 7 + [c.op for c in conds if c.col + 1 = i][-1] else 0 end)::int for i in range(7)] as labels
       from slot_questions""",
    "slot_questions",
)


def captions(t):
    labels = sq.column_labels(F.lit(7), F.col("sel") + 1, F.col("agg"), F.transform("conds", lambda c: c.withField("col", c.col + 1)))
    text = F.concat(
        F.lit("<s> "), "question", F.lit(" </s> orders * </s> "), F.array_join("header", " </s> "), F.lit(" </s> notes * </s> remark </s>")
    )
    return b.slot_questions(t).select("query_id", F.split(text, " ").alias("toks"), labels.alias("labels"))


_MU = b.u_sql(8, "mask", "query_id", "(i - 1)")
_WORDS = ["alpha", "beta", "gamma", "delta"]
_OTHER = f"({b.sql_list(_WORDS)})[{b.n_sql(4, 8, 'word', 'query_id', '(i - 1)')} + 1]"


@query(
    "x3_masking",
    b.using("captions") + f"""select query_id, {digest_sql(f"list_transform(toks, lambda x, i: case when x in ('<s>', '</s>') or {_MU} >= 0.15 then x when {_MU} / 0.15 < 0.8 then '<mask>' when {_MU} / 0.15 < 0.9 then {_OTHER} else x end)")} as toks,
      {digest_sql(f"list_transform(toks, lambda x, i: case when x not in ('<s>', '</s>') and {_MU} < 0.15 then x else '' end)")} as labels from captions""",
)
def x3_masking(t):
    made = captions(t).select("query_id", ft.mask_words(F.col("toks"), b.strings(_WORDS), 8, "query_id").alias("m"))
    return made.select("query_id", digest("m.toks").alias("toks"), digest("m.labels").alias("labels"))


_SEPS = "[i for i in range(1, len({0}) + 1) if {0}[i] = '</s>']"


@query(
    "x4_column_label_ids",
    b.using("captions") + f"""select query_id, array_to_string(list_transform(toks, lambda x, i: case when x = '</s>' and list_contains(seps[1:len(seps) - 1], i)
       then labels[list_position(seps, i)] else -1 end)::varchar[], ' ') as ids from (select *, {_SEPS.format('toks')} as seps from captions)""",
)
def x4_column_label_ids(t):
    return captions(t).select("query_id", F.array_join(F.transform(ft.column_label_ids(F.col("toks"), F.col("labels")), lambda x: x.cast("string")), " ").alias("ids"))


@query(
    "x5_table_index",
    b.using("captions") + """, f as (select query_id, i, toks[i + 1] as w from captions, unnest(range(len(toks))) as r(i)),
     m as (select *, min(case when w in ('<s>', '</s>') then i end) over (partition by query_id order by i rows between 1 following and unbounded following) as next_mark,
       min(case when w = '*' then i end) over (partition by query_id order by i rows between 1 following and unbounded following) as next_star from f)
     select query_id, string_agg(coalesce(start, 0)::varchar, ' ' order by i) as idx from (select query_id, i, max(case when i > 0 and w in ('<s>', '</s>') and next_star < coalesce(next_mark, 1000000) then i end)
       over (partition by query_id order by i) as start from m) group by query_id""",
)
def x5_table_index(t):
    return captions(t).select("query_id", F.array_join(F.transform(ft.table_indexes(F.col("toks")), lambda x: x.cast("string")), " ").alias("idx"))


@query(
    "x6_fit",
    b.using("turn_toks") + f"""select id, {digest_sql("(toks[1:64] || list_resize([]::varchar[], greatest(64 - len(toks), 0), '<pad>'))")} as padded,
      least(len(toks), 64)::bigint as ones, {digest_sql("(list_resize([]::varchar[], greatest(64 - len(toks), 0), '<pad>') || toks[1:64])")} as left_padded from turn_toks""",
)
def x6_fit(t):
    toks = F.col("toks")
    return turn_toks(t).select(
        "id", digest(ft.fit(toks, 64, "<pad>")).alias("padded"),
        F.aggregate(ft.input_mask(toks, 64), F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"),
        digest(ft.fit(toks, 64, "<pad>", left=True)).alias("left_padded"),
    )


b.add_cte(
    "turn_pairs",
    "select a.id, a.toks as one, b.toks as two from turn_toks a join turn_toks b on b.conv_id = a.conv_id and b.turn = a.turn + 1",
    "turn_toks",
)


def turn_pairs(t):
    toks = turn_toks(t)
    after = toks.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("toks").alias("two"))
    return toks.withColumnRenamed("toks", "one").join(after, ["conv_id", "turn"]).select("id", "one", "two")


@query(
    "x7_cut_pair",
    b.using("turn_pairs") + """select id, case when a + b2 <= 101 then a when b2 <= 50 then 101 - b2 when a <= 51 then a else 51 end as n_one,
      case when a + b2 <= 101 then b2 when b2 <= 50 then b2 when a <= 51 then 101 - a else 50 end as n_two, md5(coalesce(array_to_string(one[1:case when a + b2 <= 101 then a when b2 <= 50 then 101 - b2 when a <= 51 then a else 51 end], ' '), '')) as one
      from (select id, one, len(one) as a, len(two) as b2 from turn_pairs)""",
)
def x7_cut_pair(t):
    one, two = ft.cut_pair(F.col("one"), F.col("two"), 101)
    return turn_pairs(t).select("id", F.size(one).cast("long").alias("n_one"), F.size(two).cast("long").alias("n_two"), digest(one).alias("one"))


@query(
    "x8_cut_with_stride",
    b.using("turn_pairs") + """, s as (select id, one, two, 80 - 3 - len(two) as room from turn_pairs), k as (select *, room > 0 and len(one) > room as cut from s)
      select id, md5(coalesce(array_to_string(case when cut then one[1:room] else one end, ' '), '')) as kept,
        md5(coalesce(array_to_string(case when not cut then [] when room - 8 >= 0 then one[room - 7:] else one[greatest(len(one) + room - 8, 0) + 1:] end, ' '), '')) as overflow,
        (len(case when cut then one[1:room] else one end) + len(two) + 3)::bigint as n from k""",
)
def x8_cut_with_stride(t):
    cut = turn_pairs(t).select("id", ft.cut_with_stride(F.col("one"), F.col("two"), 80, 8, n_marks=3).alias("c"))
    ids, segments = ft.with_specials(F.col("c.first"), F.col("c.second"), "[CLS]", "[SEP]")
    return cut.select("id", digest("c.first").alias("kept"), digest("c.overflow").alias("overflow"), F.size(ids).cast("long").alias("n"))


_HTOKS = "[string_split(lower(h), ' ') for h in header]"


@query(
    "x9_header_input",
    b.using("slot_questions") + """select query_id, md5('[CLS] ' || question || ' [SEP] ' || array_to_string([lower(h) for h in header], ' [SEP] ') || ' [SEP]') as toks,
      (1 + len(toks))::int as q_end, array_to_string([(2 + len(toks) + i * 3)::varchar || '-' || (4 + len(toks) + i * 3)::varchar for i in range(4)], ',') as spans,
      repeat('0', len(toks)::int + 2) || '1101101101' || '11' as segments from slot_questions""",
)
def x9_header_input(t):
    headers = F.transform("header", lambda h: F.split(F.lower(h), " "))
    made = b.slot_questions(t).select("query_id", ft.header_input(F.col("toks"), headers).alias("x"))
    spans = F.transform("x.header_spans", lambda s: F.concat_ws("-", s.start.cast("string"), s.end.cast("string")))
    return made.select(
        "query_id", digest("x.toks").alias("toks"), F.col("x.question_span.end").alias("q_end"), F.array_join(spans, ",").alias("spans"),
        F.array_join(F.transform("x.segments", lambda s: s.cast("string")), "").alias("segments"),
    )


_PIECES = "[regexp_extract_all(w, '.{1,3}') for w in toks]"


@query(
    "x10_piece_maps",
    b.using("slot_questions") + f"""select query_id, array_to_string(flatten(list_transform(p, lambda ps, i: [(i - 1)::varchar for x in ps])), ' ') as word_of,
      array_to_string(list_transform(p, lambda ps, i: coalesce(list_sum([len(q) for q in p[1:i - 1]]), 0)::int)::varchar[], ' ') as first from (select query_id, {_PIECES} as p from slot_questions)""",
)
def x10_piece_maps(t):
    made = b.slot_questions(t).select("query_id", F.transform("toks", lambda w: F.regexp_extract_all(w, F.lit("(.{1,3})"), 1)).alias("p"))
    word_of, first = ft.piece_maps(F.col("p"))
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    return made.select("query_id", text(word_of).alias("word_of"), text(first).alias("first"))


_SQL_AT = [1 + sum(len(w.split(" ")) + 1 for w in ft.SQL_WORDS[:i]) for i in range(len(ft.SQL_WORDS) + 1)]
_FIRST = "(list_position([array_to_string(toks[k:k + len(string_split(c.val, ' ')) - 1], ' ') for k in range(1, len(toks) + 1)], lower(c.val)) - 1)"
_HEAD_AT = f"({_SQL_AT[-1]} + len(toks) + 1 + coalesce(list_sum([len(string_split(h, ' ')) + 1 for h in header[1:{{0}}]]), 0))::int"


@query(
    "x13_pointer_targets",
    b.using("slot_questions") + f"""select query_id, array_to_string([x::varchar for x in list_concat([{_SQL_AT[12]}, {_SQL_AT[6]}, ({_SQL_AT})[agg + 1], {_HEAD_AT.format('sel')}],
       case when len(conds) > 0 then list_concat([{_SQL_AT[7]}], flatten(list_transform(conds, lambda c, i: list_concat(
         [{_HEAD_AT.format('c.col')}, ({_SQL_AT})[c.op + 10], ({_FIRST} + {_SQL_AT[-1]})::int, ({_FIRST} + {_SQL_AT[-1]} + len(string_split(c.val, ' ')) - 1)::int], case when i < len(conds) then [{_SQL_AT[8]}] else [] end)))) else [] end,
       [{_SQL_AT[13]}])], ' ') as pointers from slot_questions""",
)
def x13_pointer_targets(t):
    return pointer_rows(t).select("query_id", F.array_join(F.transform("pointers", lambda x: x.cast("string")), " ").alias("pointers"))


def pointer_rows(t):
    from ..operators.spans import value_spans

    headers = F.transform("header", lambda h: F.split(F.lower(h), " "))
    words = [s.split(" ") for s in ft.SQL_WORDS]
    return ft.pointer_rows(b.slot_questions(t), "toks", headers, words, value_spans(F.col("toks"), F.col("conds")))


@query(
    "x15_words_of_pieces",
    b.using("slot_questions") + """select query_id, (i - 1)::int as word_no, toks[i] as word, coalesce(list_sum([ceil(length(w) / 3.0)::int for w in toks[1:i - 1]]), 0)::int as first
      from slot_questions, unnest(range(1, len(toks) + 1)) as r(i)""",
)
def x15_words_of_pieces(t):
    def pieces(w):
        return F.transform(F.regexp_extract_all(w, F.lit("(.{1,3})"), 1), lambda p, i: F.when(i > 0, F.concat(F.lit("##"), p)).otherwise(p))

    rows = b.slot_questions(t).select("query_id", F.flatten(F.transform("toks", pieces)).alias("pieces"))
    return ft.words_of_pieces(rows, "query_id", "pieces").withColumn("word_no", F.col("word_no").cast("int"))


@query(
    "x16_task_features",
    """select conv_id, turn, (quality)::int as label, least(n + 2, 32)::bigint as n_tokens, greatest(32 - n - 2, 0)::bigint as n_pad from (
       select conv_id, turn, case role when 'user' then 0 when 'assistant' then 1 else -1 end as quality, len([w for w in """ + TOKS + """ if w != '']) as n from conversations)""",
)
def x16_task_features(t):
    rows = t.conversations.select("conv_id", "turn", "role", words_of().alias("a"))
    made = ft.task_features(rows, F.col("a"), F.array().cast("array<string>"), F.col("role"), ["user", "assistant"], 32)
    ones = F.aggregate("input_mask", F.lit(0).cast("long"), lambda s, x: s + x)
    return made.select("conv_id", "turn", F.col("label_id").alias("label"), ones.alias("n_tokens"), (32 - ones).alias("n_pad"))


_X16 = "list_concat(['[CLS]'], a, ['[SEP]'], b, ['[SEP]'])"


@query(
    "x16_pair_features",
    f"""select doc_id, n_chars::double as label, {digest_sql(f"list_resize({_X16}, 48, '[PAD]')")} as tokens,
       {digest_sql(f"list_resize([1 for x in {_X16}], 48, 0)")} as mask, {digest_sql("list_resize(list_concat([0 for x in a], [0, 0], [1 for x in b], [1]), 48, 0)")} as segments
       from (select doc_id, n_chars, b, case when 48 - 3 - len(b) > 0 then a[1:48 - 3 - len(b)] else a end as a
       from (select doc_id, n_chars, w[1:len(w) // 2][1:60] as a, w[len(w) // 2 + 1:][1:20] as b from (select doc_id, n_chars, [w for w in {TOKS} if w != ''] as w from documents)) where len(b) > 0)""",
)
def x16_pair_features(t):
    words = t.documents.select("doc_id", "n_chars", words_of().alias("w")).withColumn("h", F.floor(F.size("w") / 2).cast("int"))
    pairs = words.select("doc_id", "n_chars", F.slice("w", 1, F.least("h", F.lit(60))).alias("a"), F.slice("w", F.col("h") + 1, 20).alias("b")).filter(F.size("b") > 0)
    made = ft.task_features(pairs, F.col("a"), F.col("b"), F.col("n_chars"), None, 48)
    return made.select("doc_id", F.col("label_id").alias("label"), digest("tokens").alias("tokens"), digest("input_mask").alias("mask"), digest("segments").alias("segments"))


_LM = f"case when x not in ('<s>', '</s>') and {_MU} < 0.15 then x else '' end"
_IN = f"case when x in ('<s>', '</s>') or {_MU} >= 0.15 then x when {_MU} / 0.15 < 0.8 then '<mask>' when {_MU} / 0.15 < 0.9 then {_OTHER} else x end"
_WIDE = 34
_FLAGS = "list_transform({0}, lambda x, i: x = '</s>' and len([j for j in range(i + 1, len({0}) + 1) if {0}[j] = '</s>']) > 0)"
b.add_cte("three", f"""select query_id, labels, toks[1:{_WIDE}] as toks, question[1:{_WIDE}] as q, sql[1:{_WIDE}] as s from (
   select *, toks[1:list_position(toks, '</s>') - 1] as head, list_concat(['<s>', 'select'], toks[list_position(toks, '</s>'):]) as sql, list_concat(['<s>'], toks[list_position(toks, '</s>'):]) as question from captions)""", "captions")
b.add_cte("three_ids", """select map_from_entries(list({'k': word, 'v': (id)::int})) as m from (select row_number() over (order by word) + 2 as id, word from (select distinct unnest(toks) as word from captions))""", "captions")


def _sql_ids(words):
    return f"list_transform({words}, lambda y: coalesce(m[y], 0))"


@query(
    "x17_three_sequences",
    b.using("three", "three_ids") + f"""select query_id, {digest_sql(f"list_resize({_sql_ids(f'list_transform(toks, lambda x, i: {_IN})')}, {_WIDE}, 1)")} as ids,
       {digest_sql(f"list_resize([1 for x in toks], {_WIDE}, 0)")} as mask,
       {digest_sql(f"list_resize(list_transform(list_transform(toks, lambda x, i: {_LM}), lambda y: case when y = '' then -1 else coalesce(m[y], 0) end), {_WIDE}, -1)")} as lm,
       {digest_sql(f"list_resize(list_transform(toks, lambda x, i: case when ({_FLAGS.format('toks')})[i] then coalesce(labels[len([j for j in range(1, i + 1) if toks[j] = '</s>'])], -1) else -1 end), {_WIDE}, -1)")} as cols,
       {digest_sql(f"list_concat(list_resize({_sql_ids('q')}, {_WIDE}, 1), list_resize([1 for x in q], {_WIDE}, 0))")} as question,
       {digest_sql(f"list_concat(list_resize({_sql_ids('s')}, {_WIDE}, 1), list_resize([1 for x in s], {_WIDE}, 0))")} as sql,
       {digest_sql(f"list_concat(list_resize({_FLAGS.format('q')}, {_WIDE}, false), list_resize({_FLAGS.format('s')}, {_WIDE}, false))")} as flags,
       greatest(len([x for x in toks if x = '</s>']) - 1, 0) != len(labels) or len([x for x in q if x = '</s>']) != len([x for x in s if x = '</s>']) as error
       from three, three_ids""",
)
def x17_three_sequences(t):
    # Stored, as the words are counted and looked up: an explode would also push a test of the whole caption under the spreading.
    rows = stored_rows(captions(Spread(t, orders="o_orderkey")))
    tail = F.slice("toks", F.array_position("toks", F.lit("</s>")).cast("int"), F.size("toks"))
    rows = rows.select("query_id", "toks", "labels", F.concat(F.array(F.lit("<s>")), tail).alias("question"), F.concat(F.array(F.lit("<s>"), F.lit("select")), tail).alias("sql"))
    vocab = ft.build_vocabulary(rows.select(F.explode("toks").alias("word")))
    made = ft.three_sequences(rows, "query_id", ("toks", "question", "sql"), "labels", vocab, _WIDE, b.strings(_WORDS), 8)
    both = lambda a, c: digest(F.concat(F.transform(a, lambda x: x.cast("string")), F.transform(c, lambda x: x.cast("string"))))
    return made.select(
        "query_id", digest("ids").alias("ids"), digest("mask").alias("mask"), digest("lm_label_ids").alias("lm"), digest("col_label_ids").alias("cols"),
        both("question_ids", "question_mask").alias("question"), both("sql_ids", "sql_mask").alias("sql"), both("question_cols", "sql_cols").alias("flags"), "error",
    )


@query(
    "x17_paired_features",
    b.using("captions", "slot_questions") + f"""select query_id, len({_SEPS.format('toks')})::bigint as q_seps, true as same from captions""",
)
def x17_paired_features(t):
    rows = captions(t).join(b.slot_queries(t).select("query_id", "sel", "agg"), "query_id")
    tail = F.slice("toks", F.array_position("toks", F.lit("</s>")).cast("int"), F.size("toks"))
    sql = F.concat(F.array(F.lit("<s>"), F.lit("select")), tail)
    made = ft.paired_features(rows.withColumn("sql_toks", sql), "toks", "sql_toks", "labels", 218)
    return made.select("query_id", F.size(F.filter("q_seps", lambda x: x)).cast("long").alias("q_seps"), (~F.col("error")).alias("same"))


@query(
    "x18_used_column_labels",
    b.using("captions", "slot_queries") + f"""select query_id, array_to_string(list_transform(toks, lambda x, i: case when x = '</s>' and list_contains(seps[1:len(seps) - 1], i)
       then case when list_contains(used, (list_position(seps, i) - 1)::int) then 1 else 0 end else -1 end)::varchar[], ' ') as ids
       from (select c.*, {_SEPS.format('toks')} as seps, list_concat([q.sel], [x.col for x in q.conds]) as used from captions c join slot_queries q using (query_id))""",
)
def x18_used_column_labels(t):
    rows = captions(t).select("query_id", "toks").join(b.slot_queries(t), "query_id")
    used = F.concat(F.array("sel"), F.col("conds.col"))
    return rows.select("query_id", F.array_join(F.transform(ft.used_column_labels(F.col("toks"), used), lambda x: x.cast("string")), " ").alias("ids"))


@query(
    "x19_hints",
    b.using("slot_questions") + """select query_id, array_to_string(list_resize(case when query_id % 2 = 0 then [1 for w in toks] else []::int[] end, m, 0)::varchar[], '') as hints
      from (select query_id, toks, max(len(toks)) over (partition by (query_id // 32)) as m from slot_questions)""",
)
def x19_hints(t):
    rows = b.slot_questions(t).select(
        "query_id", F.floor(F.col("query_id") / 32).alias("batch"), F.size("toks").alias("n"),
        F.when(F.col("query_id") % 2 == 0, F.transform("toks", lambda w: F.lit(1))).alias("hints"),
    )
    return ft.filled_hints(rows, "batch", "hints", "n").select("query_id", F.array_join(F.transform("hints", lambda x: x.cast("string")), "").alias("hints"))


_MARKED = "list_concat(flatten([list_concat(w, ['[SEP]']) for w in {0}]))"
_FRONT = _MARKED.format(f"([string_split(w, ' ') for w in {b.sql_list(ft.SQL_WORDS)}])")


@query(
    "x20_pointer_input",
    b.using("slot_questions") + f"""select query_id, len(x)::int as n, md5(array_to_string(x, ' ')) as toks, (1 + len(front))::int as q_start, {len(ft.SQL_WORDS)} as n_sql, (2 + len(front) + len(toks))::int as h_start
       from (select *, list_concat(['[CLS]'], front, toks, ['[SEP]'], {_MARKED.format("([string_split(lower(h), ' ') for h in header])")}) as x from (select *, {_FRONT} as front from slot_questions))""",
)
def x20_pointer_input(t):
    rows = pointer_rows(t)
    return rows.select(
        "query_id", F.size("x.toks").alias("n"), digest("x.toks").alias("toks"), F.col("x.question_span.start").alias("q_start"),
        F.size("x.sql_spans").alias("n_sql"), F.get("x.header_spans", F.lit(0)).start.alias("h_start"),
    )


@query(
    "x21_value_places",
    b.using("slot_questions") + """select query_id, (i - 1)::int as cond, j::int as step, (list_position([array_to_string(toks[k:k + len(w) - 1], ' ') for k in range(1, len(toks) + 1)], lower(conds[i].val)) - 1 + j)::int as place
      from (select *, string_split(lower(conds[i].val), ' ') as w from slot_questions, unnest(range(1, len(conds) + 1)) as r(i)), unnest(range(len(w))) as s(j)""",
)
def x21_value_places(t):
    from ..operators.spans import value_spans

    rows = b.slot_questions(t).select("query_id", value_spans(F.col("toks"), F.col("conds")).alias("spans"))
    return ft.value_places(rows, "query_id", "spans")


@query(
    "x22_header_sizes",
    b.using("slot_tables", "slot_predictions") + """select query_id, array_to_string([len(string_split(h, ' '))::varchar for h in header], ',') as sizes,
       array_to_string([x::varchar for x in (case when len(conds) < 2 then [c.col - c.col for c in conds] when conds[1].col <= conds[2].col then [0, 1] else [1, 0] end)], ',') as back
       from slot_predictions join slot_tables using (table_id)""",
)
def x22_header_sizes(t):
    rows = b.slot_predictions(t).join(b.slot_tables(t), "table_id")
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return rows.select("query_id", text(ft.header_sizes(F.col("header"))).alias("sizes"), text(ft.inverse_permutation(F.col("conds.col"))).alias("back"))
