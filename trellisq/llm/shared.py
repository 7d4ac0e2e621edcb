"""What several operators share: scratch tables in the shared folder, and Bloom filters of a bounded size."""

from __future__ import annotations

import functools
import inspect
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named and all runs in one process, as in tests, a new one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='trellisq-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Scratch tables written and not yet deleted.
_written: list[str] = []


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation.

    The table is deleted by ``released`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/trellisq-{uuid.uuid4().hex}"
    _written.append(path)
    folder, files = _files(spark, path)
    files.deleteOnExit(folder)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(spark.read.parquet(path).schema if partition_by else df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """The path and its file system, as the JVM knows them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def released(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Deletes the scratch tables written so far, but for those that ``keep`` reads; nothing that is still to be read may depend on the others."""
    used = keep.inputFiles() if keep is not None else []
    for path in list(_written):
        name = path.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in x for x in used):
            folder, files = _files(spark, path)
            files.delete(folder, True)
            _written.remove(path)


def bloom_bits(hashes: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2**bits bits with two probes, the high and the low bits of the column ``h`` (bits <= 32); what reaches the driver is 2**bits / 8 bytes at most."""
    h = F.col("h")
    slots = [F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND(F.lit((1 << bits) - 1))]
    words = (
        hashes.select(F.explode(F.array(*slots)).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("set"))
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("set").to_numpy().view(np.uint64)
    return out


def in_bloom(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which uint64 hashes the filter may hold; none that it holds is missed."""
    bits = len(filter_).bit_length() - 1 + 6
    out = np.ones(len(hashes), bool)
    for slot in (hashes >> np.uint64(64 - bits), hashes & np.uint64((1 << bits) - 1)):
        out &= (filter_[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in Arrow batches of so many rows; the default of 10,000 holds tens of MB of text off the heap several times over in each task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured_bytes(df: DataFrame) -> int:
    """About how many bytes the rows take in memory: strings, binaries and arrays by what they hold, all else by 8 bytes a value."""
    total = F.lit(16)
    for f in df.schema.fields:
        column = F.col(f.name)
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            held = F.octet_length(column) + 16
        elif isinstance(f.dataType, T.ArrayType):
            held = F.size(column) * (8 * len(f.dataType.elementType.fields) + 24 if isinstance(f.dataType.elementType, T.StructType) else 16) + 32
        else:
            held = F.lit(8)
        total = total + F.coalesce(held, F.lit(8))
    return df.agg(F.sum(total.cast("long"))).first()[0] or 0


#: The most that a table may take to be broadcast.
BROADCAST_BYTES = 48 << 20


def joined_small(df: DataFrame, small: DataFrame, on: list[str], how: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """df joined with a stored table: broadcast if its bytes were measured and are at most so many, else shuffled."""
    return df.join(F.broadcast(small) if measured_bytes(small) <= most else small, on, how)


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A new schema with more columns (StructType.add would change a frame's own)."""
    kinds = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in columns.items()))
    return T.StructType([*schema.fields, *kinds.fields])


def any_columns(*params: str):
    """For an operator on (docs, ...): inside, the columns of docs have numbered names, so no name of the input can clash with the operator's own.

    params: which parameters name columns.  Outputs replace columns of docs that have their names.
    """

    def decorate(operator):
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            names = docs.columns
            bound = signature.bind(docs.toDF(*(f"c{k}" for k in range(len(names)))), *args, **kwargs)
            bound.apply_defaults()
            for p in params:
                bound.arguments[p] = f"c{names.index(bound.arguments[p])}"
            out = operator(*bound.args, **bound.kwargs)
            new = [c for c in out.columns if not re.fullmatch(r"c\d+", c)]
            return out.select(*(F.col(f"c{k}").alias(x) for k, x in enumerate(names) if x not in new), *new)

        return run

    return decorate
