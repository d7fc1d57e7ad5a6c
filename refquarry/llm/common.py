"""Helpers that the operators share: written cut points, folds, and vectorised word hashing.

Word hashing works on bytes with numpy: a batch of texts becomes one byte array, words are runs of
non-separator bytes, and each gets a 64-bit polynomial hash from one running sum.  No Python loop
runs over words.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ------------------------------------------------------------------ cut points


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and there is one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="refquarry-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Workspace:
    """Tables written once to the shared folder, so that lineage is short and a lost executor costs a reread."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/refquarry-{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets go of the shuffle files of frames that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        try:
            self.drop()
        except Exception:  # the session may have ended before the interpreter; nothing is left to tidy then
            return


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While a job of long texts runs, an Arrow batch has fewer rows than by default, so that a task holds less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(run):
    """A function for mapInArrow that gives what it has freed back to the system when its rows are done: workers wait for later stages' tasks, and would keep the largest size that any stage had."""

    def tidied(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return tidied


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ hashing

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: bytes hashed at once; bounds the power tables and the temporaries
CHUNK = 1 << 20

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.empty(n, np.uint64)
            p[0] = 1
            done = 1
            while done < n:
                step = min(done, n - done)
                p[done : done + step] = p[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            _powers.append(p)
    return _powers


def byte_table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words, and a random 64-bit value for each byte (A-Z like a-z if lower)."""
    is_sep = np.zeros(256, bool)
    is_sep[list(separators)] = True
    value = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
    if lower:
        value[65:91] = value[97:123]
    return is_sep, value


#: the six characters [\x20\x09-\x0D]
SPACES = b" \t\n\x0b\x0c\r"
#: every ASCII character that is no letter; bytes from 0x80 belong to words
NON_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def chunks(blobs: list[bytes], most: int = CHUNK):
    """Slices of the list whose bytes together stay near `most`; a longer text is a slice of its own."""
    at, total = 0, 0
    for i, b in enumerate(blobs):
        if total and total + len(b) > most:
            yield at, i
            at, total = i, 0
        total += len(b) + 1
    if at < len(blobs):
        yield at, len(blobs)


def words(blobs: list[bytes], tables: tuple[np.ndarray, np.ndarray], joiner: bytes = b"\n"):
    """Joined bytes, and for each word: its text's index, start, end and 64-bit hash.  The joiner is a separator byte."""
    is_sep, value = tables
    joined = joiner.join(blobs) + joiner
    buf = np.frombuffer(joined, np.uint8)
    inside = np.empty(len(buf) + 1, bool)
    inside[0] = False
    np.logical_not(is_sep[buf], out=inside[1:])
    inside[-1] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
    first = np.cumsum(lengths) - lengths
    doc = np.searchsorted(first, starts, "right") - 1
    return joined, doc, starts, ends, span_hashes(joined, value)(starts, ends)


def span_hashes(joined: bytes, value: np.ndarray):
    """A function that gives the 64-bit hashes of the bytes from starts to ends."""
    buf = np.frombuffer(joined, np.uint8)
    up, down = _power_tables(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value[buf] * up[: len(buf)], out=total[1:])
    return lambda starts, ends: mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    column = column.fill_null("")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def shingle_sets(blobs: list[bytes], tables: tuple[np.ndarray, np.ndarray], k: int = 5):
    """For each text its sorted distinct k-word shingle hashes (uint64); fewer words: the whole sequence as one; none: empty."""
    for a, b in chunks(blobs):
        part = blobs[a:b]
        _, doc, _, _, h = words(part, tables)
        n = np.bincount(doc, minlength=len(part))
        at = np.cumsum(n) - n
        if len(h) >= k:
            rolled = h[: len(h) - k + 1].copy()
            for j in range(1, k):
                rolled *= _STEP
                rolled += h[j : len(h) - k + 1 + j]
            rolled = mix(rolled)
        else:
            rolled = h[:0]
        for i in range(len(part)):
            if n[i] >= k:
                yield np.unique(rolled[at[i] : at[i] + n[i] - k + 1])
            elif n[i]:
                x = np.uint64(n[i])
                for w in h[at[i] : at[i] + n[i]]:
                    x = mix(np.array([(int(x) * int(_STEP) + int(w)) & _MASK], np.uint64))[0]
                yield np.array([x], np.uint64)
            else:
                yield h[:0]


# ------------------------------------------------------------------ bitmaps

#: bits of a bitmap of wanted keys: a fixed size (2 MB) whatever the input; a full one only lets more through
BITMAP = 1 << 24


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bit = mix(keys) % np.uint64(BITMAP)
    return (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bitmap of a table's one long column, for dropping rows early that an exact join would drop later."""
    import pyarrow as pa

    def run(batches):
        held = np.zeros(BITMAP // 64, np.uint64)
        for batch in batches:
            word, bit = _places(batch.column(0).to_numpy().view(np.uint64))
            np.bitwise_or.at(held, word, np.uint64(1) << bit)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].view(np.int64))], names=["at", "bits"])

    out = np.zeros(BITMAP // 64, np.uint64)
    for r in keys.mapInArrow(tidy(run), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["at"]] = r["bits"] & _MASK
    return out


def in_bitmap(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, bit = _places(keys)
    return (held[word] >> bit) & np.uint64(1) == 1
