"""What the operators share: byte buffers of text columns, rolling hashes, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.storage import shared_dir

U64 = np.uint64
BLOCK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch between JVM and Python, at most; one longer row makes a batch of its own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
ROWS_A_FILE = 250_000
#: Bytes in files that may be broadcast; in memory they are a few times as many.
BROADCAST_BYTES = 8 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack_row(df: DataFrame) -> Column:
    """The whole row as a struct, so that no name of its columns can clash with ours."""
    return F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns])


class Scratch:
    """Tables written to the shared folder, so that what is built on them survives the loss of an executor."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
        self.count, self.tables = 0, []
        for k, v in BATCH.items():
            spark.conf.set(k, v)

    def put(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """The table, written and read again; if the number of its rows is about known, in as few files as that needs."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        (df if rows is None else df.coalesce(1 + rows // ROWS_A_FILE)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.tables.append(out)
        return out

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Drops the tables that nothing will read again."""
        self.drop(*(df for df in self.tables if all(df is not k for k in kept)))
        self.tables = list(kept)

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` bytes together, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salts(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


BYTE_CODES = salts(256, 11)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse, modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = max(n + 1, BLOCK_BYTES * 2)
        inverse = pow(BASES[which], -1, 1 << 64)
        _powers[which] = tuple(np.concatenate(([U64(1)], np.multiply.accumulate(np.full(size, b, U64)))) for b in (BASES[which], inverse))
    return _powers[which]


class Rolling:
    """Hashes of any byte spans of a buffer, each in constant time."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = powers(len(data), which)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_CODES[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


def word_spans(blob: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``in_word`` marks."""
    marks = np.zeros(len(blob) + 2, np.int8)
    marks[1:-1] = in_word[blob]
    edges = np.flatnonzero(marks[1:] != marks[:-1])
    return edges[::2], edges[1::2]


def batches(rows: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := rows[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def bytes_of(df: DataFrame) -> int | None:
    """Bytes of the files of a table in the shared folder; None of any other."""
    if not hasattr(df, "scratch_path"):
        return None
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def fits(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has so few rows, and so few bytes if they are known, that a copy of it may go to every executor."""
    return (bytes_of(df) or 0) <= max_bytes and df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """The table with a broadcast hint if its checked size allows; else as it is, for a shuffled join.

    Of a table that isn't written yet only rows are counted, so it should be one of few narrow columns.
    """
    return F.broadcast(df) if fits(df, max_rows) else df
