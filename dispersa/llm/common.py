"""What the corpus operators share: bounded Arrow batches, scratch tables, byte helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key of more rows than this is hot; of the hot keys so many at most are salted, the hottest first.
HOT_ROWS, HOT_KEYS = 1000, 10_000
#: Written tables in a plain shared folder go without checksum files and marks of success: each file costs Hadoop's local
#: file system helper processes, during which a sampler may see a whole JVM twice. Other file systems do not read these.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_ODD = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd 64-bit number and of its inverse, for hashes of substrings from running sums."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches hold 8 MB at most unless the session says otherwise: rows hold whole texts of any length."""
    ship(spark)
    if int(spark.conf.get(ARROW_BYTES, str(2**31 - 1)).rstrip("bB") or 0) >= 2**31 - 1:
        spark.conf.set(ARROW_BYTES, str(8 << 20))


def text_bytes(column: str = "text"):
    """A text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def chunks(sizes: list[int], limit: int) -> Iterator[slice]:
    """Slices of consecutive rows whose sizes add up to ``limit`` or which hold a single row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if sizes:
        yield slice(start, len(sizes))


def as_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Scratch:
    """Written tables in the shared folder that the session names in ``spark.checkpoint.dir``.

    A written table cuts lineage and outlives lost executors. Where that setting is absent (local tests), a folder of
    this machine serves, for Spark then runs on this machine alone. Tables go when dropped, and at exit.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="dispersa-")
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._remove, self.root)

    def table(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Writes ``df`` and reads it back; shuffle files of what made it may then go."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.options(compression=codec, **_PLAIN).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._remove(df._scratch_path)

    def release(self) -> None:
        """Lets Spark's cleaner delete shuffle files of finished jobs."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended: its folder goes with it
            return


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], count: str, scratch: Scratch, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and says in ``count`` how many rows of ``left`` have it.

    A hot key would bring all its rows to one task. So for the ``HOT_KEYS`` keys of most rows, if of more than
    ``HOT_ROWS``, the rows are dealt by a salt, and the key's row of ``right`` is repeated for each salt: together one
    for each ``HOT_ROWS`` rows of ``left``. Only the numbers of salts are broadcast. No other key has more rows than any of those.
    """
    hot = right.filter(F.col(count) > HOT_ROWS).orderBy(F.col(count).desc(), *keys).limit(HOT_KEYS)
    hot = scratch.table(hot.select(*keys, F.ceil(F.col(count) / HOT_ROWS).alias("__salts")), "hot")
    if hot.isEmpty():
        return left.join(right, keys, how)
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), salts)).drop("__salts")
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("__salts")
    return dealt.join(repeated, [*keys, "__salt"], how).drop("__salt")
