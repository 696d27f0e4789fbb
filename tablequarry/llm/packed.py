"""Token ids in files of fixed-width packed bits, with random access.

A file holds ``MAGIC``, then blocks of ``block`` ids (the last one shorter), then a footer: the
byte place of every block, the id of every document and the place of its first token, a JSON head,
the head's length and ``MAGIC`` again. In a block, id number i takes the bits from i * bits on, low
bits first, of one long little-endian number, so numpy unpacks a whole block with a few shifts, and
the place of any id follows from its number.
"""

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import bpe
from .common import shared_folder, stored, table, text_blocks

MAGIC = b"TQPACK01"
BLOCK = 1 << 16


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each; 64 ids fill ``bits`` words of 64 bits."""
    n = len(ids)
    rows = np.zeros((-(-n // 64), 64), np.uint64)
    rows.reshape(-1)[:n] = ids
    words = np.zeros((len(rows), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()[: -(-n * bits // 8)]


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    rows = -(-n // 64)
    words = np.frombuffer(raw.ljust(rows * bits * 8, b"\0"), "<u8", rows * bits).reshape(rows, bits)
    out = np.empty((rows, 64), np.uint32)
    low = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = value & low
    return out.reshape(-1)[:n]


def place(uri: str):
    """File system and path of a folder name that may carry a scheme."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


class Writer:
    """Writes one file; nothing is seen under its name before ``close``."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK):
        self.fs, self.path = place(uri)
        self.bits, self.block = bits, block
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.at, self.held, self.n_held, self.n = len(MAGIC), [], 0, 0
        self.blocks, self.docs, self.starts = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray):
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id of more than {self.bits} bits")
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for k in range(0, whole, self.block):
                self._write(ids[k : k + self.block])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray):
        raw = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def close(self):
        if self.n_held:
            self._write(np.concatenate(self.held))
        known = [d is not None for d in self.docs]
        head = json.dumps({"bits": self.bits, "block": self.block, "ids": self.n, "blocks": len(self.blocks), "documents": len(self.docs), "unnamed": [k for k, x in enumerate(known) if not x]}).encode()
        self.out.write(np.array(self.blocks, "<u8").tobytes())
        self.out.write(np.array([d if d is not None else 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(head + np.array([len(head)], "<u8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, uri: str):
        files, path = place(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no file of packed ids")
        n_head = int(np.frombuffer(tail[:8], "<u8")[0])
        self.head = json.loads(self.file.read_at(n_head, size - 16 - n_head))
        n, d = self.head["blocks"], self.head["documents"]
        tables = np.frombuffer(self.file.read_at(8 * n + 16 * d, size - 16 - n_head - 8 * n - 16 * d), "<u8")
        self.blocks, self.doc_ids, self.starts = tables[:n], tables[n : n + d].view("<i8"), tables[n + d :]
        self.kept = (-1, None)

    def _block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            n = min(self.head["block"], self.head["ids"] - k * self.head["block"])
            raw = self.file.read_at(-(-n * self.head["bits"] // 8), int(self.blocks[k]))
            self.kept = k, unpack(raw, n, self.head["bits"])
        return self.kept[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from number ``start`` on; only the blocks that hold them are read."""
        if not 0 <= start <= start + n <= self.head["ids"]:
            raise IndexError("ids beyond the file")
        block, out = self.head["block"], []
        while n > 0:
            k, at = divmod(start, block)
            part = self._block(k)[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_packed(df: DataFrame, vocabulary: str, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """Encode every whole text and write the ids, documents in ascending id, to packed files in ``folder``.

    The documents are dealt out by ranges of their id; each range is one file, encoded as it
    streams by, so no task holds more than a block of ids. Returns the stored index: ``id_col,
    file, first`` (number of its first id in the file), ``n_tokens``. ``end_id`` follows every
    document. A null text is empty; a null id comes first; rows with equal ids follow each other in
    an order fixed by the hash of their text. A task that runs again writes the same file under the
    same name. An empty table writes no file. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    shared = folder.rstrip("/")

    def run(batches):
        coder = bpe.coder(vocabulary)
        width = bits or max(1, (len(coder.tokens) - 1).bit_length())
        end = np.array([] if end_id is None else [end_id], np.uint32)
        name, out = f"ids-{TaskContext.get().partitionId():06d}.tqpack", None
        for batch in batches:
            out = out or Writer(f"{shared}/{name}", width)
            for part, texts in text_blocks(batch, 1):
                first, count = [], []
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode_all(texts)):
                    first.append(out.n)
                    out.add(doc, np.concatenate([ids, end]).astype(np.uint32))
                    count.append(out.n - first[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name] * len(first)), pa.array(first, pa.int64()), pa.array(count, pa.int64())], ["key", "file", "first", "n_tokens"])
        if out:
            out.close()

    cut = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    dealt = cut.repartitionByRange("key", tie).sortWithinPartitions("key", tie)
    return stored(dealt.mapInArrow(run, f"key {kind}, file string, first long, n_tokens long").withColumnRenamed("key", id_col))


def read_packed(index: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids``: the ids of each document, read from the packed files.

    ``start`` counts the ids of all documents before it. ``ids`` is binary, little-endian unsigned
    32-bit numbers.
    """
    kind = index.schema[id_col].dataType.simpleString()
    shared = folder.rstrip("/")
    names = ["key", "file", "first", "n_tokens", "before"]

    def run(batches):
        name, file = None, None
        for batch in batches:
            out = []
            for path, first, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if path != name:
                    name, file = path, Reader(f"{shared}/{path}")
                out.append(file.ids(first, n).astype("<u4").tobytes())
                if len(out) == 512 or n > 1 << 18:
                    yield part(batch, names, out)
                    batch, out = batch.slice(len(out)), []
            if out:
                yield part(batch, names, out)

    # One row a file; a file holds a whole range of documents. Only index rows are moved, no ids.
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("__n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("before"))
    cut = index.select(F.col(id_col).alias("key"), "file", "first", "n_tokens").join(files, "file").select(*names).sortWithinPartitions("file", "first")
    read = cut.mapInArrow(run, f"key {kind}, file string, first long, n_tokens long, before long, ids binary")
    return read.select(F.col("key").alias(id_col), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


def part(batch, names: list[str], ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.slice(0, len(ids)).columns, pa.array(ids, pa.binary())], [*names, "ids"])


def query(spark, folder):
    """op6: where each document's ids lie and their checksum, from the files."""
    import public_tokenizers

    to = shared_folder(spark)
    index = write_packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), f"{to}-packed")
    back = read_packed(index, f"{to}-packed")
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
