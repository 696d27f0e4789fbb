"""The corpus pipeline: quality, near duplicates, repeats, benchmark leaks, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; ``run``
writes every result as Parquet in the shared folder and reads it again. All stages but the last
return the columns of ``documents``. As rows carry whole texts, the stages lower the session's Arrow
batch size to 1,000 rows. Rows without text count as empty; rows with equal ids stay
separate rows unless a stage rejects them.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablequarry.llm import bpe_text, decontaminate, partenum, quality, suffixes
from tablequarry.llm.common import stored, table, text_rows


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    The model is fitted on labelled documents of the table itself, so it does not depend on what
    is passed in as ``docs``.
    """
    text_rows(spark)
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("score") >= quality.THRESHOLD).drop("score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of rows with one id and text, one.

    Rows with one id and unlike texts are documents of their own. Rows without id are in no group
    and stay.
    """
    text_rows(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64(text).alias("text"))))
    groups = partenum.classes(keyed.select("__key", "text"), "__key")
    first = groups.where("__key = component_id").select("__key").distinct()
    kept = keyed.join(first, "__key", "left_semi")
    several = kept.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key")
    once = kept.join(several, "__key", "left_anti")
    names = docs.columns
    again = kept.join(several, "__key", "left_semi").groupBy("__key", text.alias("__text"))
    again = again.agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return once.select(*names).unionByName(again).unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 400 bytes that also start elsewhere; documents of which nothing is left go.

    A repeat may begin or end inside a character; what is left of such a character goes too.
    ``n_chars`` follows the text.
    """
    text_rows(spark)
    return suffixes.rest(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    text_rows(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, their number, and digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    text_rows(spark)
    coded = bpe_text.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
