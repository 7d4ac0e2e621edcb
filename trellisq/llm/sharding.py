"""Sharding into parts of near equal bytes by histogram sort.

Rows are ordered by a hash of their text, so equal texts lie together.  The
splitters between shards are found without sorting: each round counts the exact
bytes of the rows below evenly spaced candidate boundaries, in every partition,
and the cells that hold a wanted boundary are divided again, until each
splitter is within ``tolerance`` of its aim or its cell is one key.  Then the
rows are exchanged once.

Groups of equal texts stay whole.  Those above 1 / (128 * shards) of all bytes
(128 * shards at most, by arithmetic) are first dealt to the shards, largest first to
the emptiest; the splitters then fill all shards to one level.  A group larger
than a shard's share makes a shard of its own.

Slots number a shard's rows without gaps: rows are numbered within ranges
of the hash, as many as the bytes call for (a large group is spread over ranges by a hash of the id), and the
counts of the ranges before are added.

Edge cases: a null text counts as an empty one (size 1); a null id sorts first;
equal rows get slots of their own; no rows give no rows; columns of the input
named like an output are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import any_columns, documents, stored

COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
KEY_BITS, STEP_BITS, SPREAD = 63, 10, 64
#: Bytes of text in the range of keys that one window numbers, and the most ranges (their counts are broadcast).
RANGE_BYTES, MOST_RANGE_BITS = 256 << 20, 20


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_sh_key": F.shiftrightunsigned(F.xxhash64(body), 1), "size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(body.cast("binary"))})


def _level(loads: list[int], rest: int) -> float:
    """The level to which rest fills the shards."""
    loads = sorted(loads)
    for k in range(len(loads), 0, -1):
        level = (rest + sum(loads[:k])) / k
        if level >= loads[k - 1]:
            return level
    return float(rest)


def _splitters(rest: DataFrame, aims: list[float], tolerance: float) -> list[int]:
    """Keys below which lie as many bytes as each aim, within the tolerance where a key allows it. rest: _sh_key, size."""
    found: dict[int, int] = {}
    open_ = {0: list(range(len(aims)))}  # start of a cell: the aims within it
    below = {0: 0}
    shift = KEY_BITS
    while open_ and shift > 0:
        step = min(STEP_BITS, shift)
        cells, top = sorted(open_), shift
        shift -= step
        here = rest if top == KEY_BITS else rest.where(F.shiftright("_sh_key", top).isin([c >> top for c in cells]))
        counts: dict[int, list[tuple[int, int]]] = {c: [] for c in cells}
        for r in here.groupBy(F.shiftright("_sh_key", shift).alias("cell")).agg(F.sum("size").alias("size")).orderBy("cell").collect():  # at most 2**STEP_BITS for each aim
            start = r["cell"] << shift
            counts[(start >> top) << top].append((start, r["size"]))
        again: dict[int, list[int]] = {}
        for cell, wanted in open_.items():
            for k in wanted:
                sum_, last = below[cell], None
                for start, size in counts[cell]:
                    if sum_ + size >= aims[k]:
                        last = (start, sum_, size)
                        break
                    sum_ += size
                if last is None:
                    found[k] = cell + (1 << top)
                elif abs(last[1] - aims[k]) <= tolerance:
                    found[k] = last[0]
                elif abs(last[1] + last[2] - aims[k]) <= tolerance or not shift:
                    near = not shift and aims[k] - last[1] < last[1] + last[2] - aims[k]
                    found[k] = last[0] if near else last[0] + (1 << shift)
                else:
                    again.setdefault(last[0], []).append(k)
                    below[last[0]] = last[1]
        open_ = again
    return [found[k] for k in range(len(aims))]


@any_columns("text", "id_")
def sharded(docs: DataFrame, shards: int = 8, text: str = "text", id_: str = "doc_id", tolerance: float = 0.001) -> DataFrame:
    """docs with size (bytes and 1), text_crc32, law, shard, slot and grown_shard (null: the law is ``bytes``)."""
    docs = docs.drop(*COLUMNS)
    light = stored(_keyed(docs.select(text), text).groupBy("_sh_key").agg(F.sum("size").alias("size")))
    total = light.agg(F.sum("size")).first()[0] or 0
    large = light.where(F.col("size") > total / (128 * shards)).orderBy(F.desc("size"), "_sh_key").collect()  # fewer than 128 * shards
    heap = [(0, s) for s in range(shards)]
    placed = []
    for k, r in enumerate(large):
        load, s = heapq.heappop(heap)
        placed.append((r["_sh_key"], s, k))
        heapq.heappush(heap, (load + r["size"], s))
    loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
    left = total - sum(loads)
    range_bits = min(MOST_RANGE_BITS, max(8, (total // RANGE_BYTES).bit_length()))
    level = _level(loads, left)
    aims, sum_ = [], 0.0
    for load in loads[:-1]:
        sum_ += max(0.0, level - load)
        aims.append(sum_)
    spark = docs.sparkSession
    groups = spark.createDataFrame(placed, "_sh_key long, _sh_placed int, _sh_number int")
    splitters = _splitters(light.join(F.broadcast(groups), "_sh_key", "left_anti"), aims, tolerance * total / shards) if left else [1 << KEY_BITS] * (shards - 1)
    by_key = sum((F.when(F.col("_sh_key") >= F.lit(min(k, (1 << 63) - 1)), 1).otherwise(0) for k in splitters), F.lit(0))
    spread = -(F.col("_sh_number") * SPREAD + F.pmod(F.xxhash64(F.col(id_)), F.lit(SPREAD)) + 1)
    rows = (
        _keyed(docs, text)
        .join(F.broadcast(groups), "_sh_key", "left")
        .withColumn("shard", F.coalesce("_sh_placed", by_key).cast("int"))
        .withColumn("_sh_range", F.coalesce(spread, F.shiftright("_sh_key", KEY_BITS - range_bits)).cast("long"))
    )
    counts = rows.groupBy("shard", "_sh_range").count()
    before = Window.partitionBy("shard").orderBy("_sh_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most 2**MOST_RANGE_BITS ranges, one more for each splitter, and SPREAD for each large group.
    offsets = stored(counts.select("shard", "_sh_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_sh_before")))
    within = Window.partitionBy("shard", "_sh_range").orderBy("_sh_key", F.col(id_))
    slot = F.row_number().over(within) - 1 + F.col("_sh_before")
    return rows.join(F.broadcast(offsets), ["shard", "_sh_range"]).select(*docs.columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
