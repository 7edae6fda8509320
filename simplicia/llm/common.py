"""Helpers shared by the operators: table access, shared storage, size-checked joins, Arrow text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python kernel at once; whole texts stay whole, only the batch is cut.
SLICE_ROWS = 1024
#: A side of a join is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python kernel works on at once; a longer text goes alone, whole.
CHUNK_BYTES = 1 << 22
#: The same where a kernel holds several numbers for each byte or word.
RUN_BYTES = 1 << 19
#: Seconds between two collections of the driver's heap at least.
TIDY_S = 4


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to SLICE_ROWS: whole texts may be long, and the default of ten thousand rows
    is held several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= SLICE_ROWS:
        spark.conf.set(key, str(SLICE_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only an unset one (local tests) gets a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    bounded_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tidied(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for tables in _RECORDED:
        tables.append(out)
    return out


_TIDIED = [float("-inf")]


def tidied(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage where its heap has grown beyond half its bound: it would let the plans of
    many small jobs fill the heap up to that bound instead, and gives memory back after a full collection only."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if time.monotonic() - _TIDIED[0] >= TIDY_S and 2 * heap.totalMemory() > heap.maxMemory():
        gc.collect()
        jvm.System.gc()
        _TIDIED[0] = time.monotonic()


_RECORDED: list[list[DataFrame]] = []


@contextlib.contextmanager
def recorded(tables: list[DataFrame]):
    """While it is open, tables that are stored are noted in the list, so that they can be released later."""
    _RECORDED.append(tables)
    try:
        yield
    finally:
        _RECORDED.pop()


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, and lets Spark's cleaner delete the shuffle files of stages whose
    results have been stored: it acts on what the garbage collector of the driver finds, which may come late in a small job
    and leaves every stage's files on disk till then."""
    for df in done:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    for _ in range(2):  # the first pass finds the plans, the second what they held; the cleaner works behind
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def give_back() -> None:
    """Returns to the system what Python holds no more; the C library keeps it else, for the rest of the session."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; lower() would also change other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod5(c: Column) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5))


def join_counted(big: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "left", salts: int = 32) -> DataFrame:
    """Joins a table of `rows` counted rows to a big one with hot keys: broadcast within the bound,
    beyond it on (key, salt), the small side repeated once for each salt."""
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")


def least_count(counts: DataFrame, bound: int) -> int | None:
    """The lowest count (column c) from which on no more than `bound` rows are left; None if not even the rows of the
    highest counts fit. It is found on a histogram of a few hundred steps, so nothing is sorted as a whole."""
    step = F.floor(F.log2("c") * 16).alias("step")
    least = None
    for r in counts.groupBy(step).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect():
        bound -= r["n"]
        if bound < 0:
            break
        least = r["least"]
    return least


def sliced(batches):
    """Arrow batches in pieces of at most SLICE_ROWS rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def chunked(raws: list[bytes], most: int = CHUNK_BYTES):
    """(first, last + 1) of runs of texts with no more than so many bytes, or of one longer text."""
    i = held = 0
    for j, raw in enumerate(raws):
        if j > i and held + len(raw) > most:
            yield i, j
            i, held = j, 0
        held += len(raw)
    if len(raws) > i:
        yield i, len(raws)


def spans(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[begin : begin + size] of every span, one after the other. So many places are made at a time as take RUN_BYTES, or
    those of one longer span."""
    ends = np.cumsum(sizes, dtype=np.int64)
    out, i, done = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype), 0, 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, done + RUN_BYTES // 8, side="right")))
        size = sizes[i:j].astype(np.int64)
        at = np.repeat(begin[i:j] - (ends[i:j] - size), size)
        at += np.arange(done, ends[j - 1])
        out[done : ends[j - 1]] = values[at]
        i, done = j, int(ends[j - 1])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(raws: list[bytes]):
    """The words of texts, cut at ASCII white space: the distinct ones (an Arrow binary array), the number of each word
    among them in order, and how many words each text has."""
    import pyarrow as pa

    joined = b"\n".join(raws) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    letters = raw[~space]
    if not len(letters):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(raws), np.int64)
    offsets = np.append(0, (ends - np.cumsum(space)[ends - 1]))
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    borders = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1), side="left")
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.diff(np.append(0, borders))
