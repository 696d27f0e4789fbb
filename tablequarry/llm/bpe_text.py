"""Byte-level BPE encoding and decoding of whole texts, batch by batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bpe
from .common import table, text_blocks, tidied


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Ids of every whole text: ``id_col, ids, n_tokens`` and, on request, offsets and the bytes decoded again.

    ``ids`` and the character offsets ``begins`` and ``ends`` are binary, little-endian unsigned
    32-bit numbers; ids that split a character share its offset. Each piece of the public split
    pattern is merged on its own, no special token is added, and the text of one is ordinary text.
    One row in gives one row out: a null or empty text has no ids, repeated rows stay, an empty
    table gives no rows. Other columns are not read, so their names cannot clash.
    """
    kind = df.schema[id_col].dataType.simpleString()
    extra = ["begins", "ends"] * offsets + ["decoded"] * decoded

    @tidied
    def run(batches):
        coder = bpe.coder(vocabulary)
        for batch in batches:
            for part, texts in text_blocks(batch, 1):
                ids = list(coder.encode_all(texts))
                out = [part.column(0), binaries(ids), pa.array(list(map(len, ids)), pa.int64())]
                if offsets:
                    spans = [coder.offsets(t.decode("utf-8", "replace"), i) for t, i in zip(texts, ids)]
                    out += [binaries([s[k] for s in spans]) for k in (0, 1)]
                if decoded:
                    out.append(pa.array(map(coder.decode_bytes, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["key", "ids", "n_tokens", *extra])

    cut = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    schema = ", ".join([f"key {kind}", "ids binary", "n_tokens long", *(f"{c} binary" for c in extra)])
    return cut.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def binaries(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.astype("<u4").tobytes() for a in arrays], pa.binary())


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """The bytes of binary ids: ``id_col, decoded`` and the columns named in ``keep``.

    The byte table is read backwards over all ids at once, so characters that several ids share
    come out whole. Null ids give empty bytes.
    """
    names = [id_col, *keep]
    kinds = ", ".join(f"c{k} {df.schema[n].dataType.simpleString()}" for k, n in enumerate(names))

    @tidied
    def run(batches):
        coder = bpe.coder(vocabulary)
        for batch in batches:
            raw = [coder.decode_bytes(np.frombuffer(i or b"", "<u4")) for i in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(raw, pa.binary())], [*(f"c{k}" for k in range(len(names))), "decoded"])

    cut = df.select(*[F.col(n).alias(f"c{k}") for k, n in enumerate(names)], F.col(ids_col).alias("ids"))
    out = cut.mapInArrow(run, f"{kinds}, decoded binary")
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], "decoded")


def query(spark, folder):
    """op4: ids and the bytes they decode to, as digests, for every document."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(table(spark, folder, "documents"), path, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
