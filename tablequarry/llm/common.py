"""Helpers shared by the corpus operators: table reads, stored tables, Arrow text access."""

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/tablequarry-{uuid.uuid4().hex}"


def stored(df: DataFrame, *, codec: str = "zstd") -> DataFrame:
    """The rows written to a Parquet table in the shared folder and read back: lineage ends there.

    Tasks that are run again read the files; ``discard`` removes them, else the folder is the
    caller's to remove after the job.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a stored table that no later step reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_blocks(batch, column: int, most: int = 1 << 20):
    """Slices of an Arrow batch with about ``most`` bytes of text each, and the texts as UTF-8 bytes.

    Null counts as empty. A text longer than ``most`` is a slice of its own.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at), [b"" if t is None else t for t in raw.slice(at, to - at).to_pylist()]
        at = to


def tidy() -> None:
    """Give the memory that this Python process has freed back to the system (glibc and Arrow keep it)."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run, most: int = 1 << 22):
    """A function on Arrow batches that tidies up after every ``most`` bytes of input and at its end.

    Python workers are kept for later tasks; without this each of them also keeps its largest block.
    """

    def counted(batches):
        size = 0
        for batch in batches:
            size += batch.nbytes
            yield batch
            if size >= most:
                del batch
                tidy()
                size = 0

    def out(batches):
        yield from run(counted(batches))
        tidy()

    return out


def text_rows(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of at most so many rows from here on in this session, as rows carry whole texts; a smaller setting stays.

    For frames that run after the call that made them; ``small_batches`` serves jobs that run inside.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (public-domain splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A bounded cache of a pure function: beyond ``most`` entries it starts anew."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each 64-bit hash of a column, by its low ``bits`` bits; at most 2 to ``bits`` / 8 bytes.

    The bits are joined per 64-bit word before they reach the driver. A filter by it lets all
    hashes of the column pass, and some others.
    """
    words = df.selectExpr(f"shiftrightunsigned({column}, 6) & {(1 << (bits - 6)) - 1}L as word", f"shiftleft(1L, cast({column} & 63 as int)) as bit")
    rows = words.groupBy("word").agg({"bit": "bit_or"}).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bitmap(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(6)) & np.uint64(len(words) - 1)
    return (words[at] >> (h & np.uint64(63))) & np.uint64(1) > 0


def settle(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that Spark removes the shuffle files of steps that are done and stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs run inside; for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def runs(raw: bytes, keep: bytes, most: int = 1 << 20):
    """Lists of the maximal runs of bytes that the table ``keep`` does not turn into a space, ``most`` bytes at a time.

    A run is never cut, so a text of any length needs memory for one piece and its longest run.
    """
    raw = raw.translate(keep)
    at = 0
    while at < len(raw):
        to = at + most
        if to < len(raw):
            to = raw.find(b" ", to)
            to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to
