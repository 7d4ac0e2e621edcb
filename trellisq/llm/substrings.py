"""Removal of repeated word passages, found by difference-cover anchors.

A window of ``window`` words that also starts in a document with a smaller id
is repeated, and each word inside a repeated window goes.  Hashing every window
of the corpus would shuffle a row per word.  Instead only short anchors are
hashed, at positions whose remainder modulo a period is in a difference cover:
for any two places of equal text there is an offset below the period that takes
both to a position of the cover, so two equal windows share an aligned anchor.

1. Exact copies: of equal texts only the one with the smallest id is searched;
   the others go whole (if they hold a window at all).
2. Anchors with more than one document set bits of a Bloom filter, whose size
   is a parameter; too small a filter costs time, not correctness.
3. Each such anchor extends to the windows around it.  They are hashed with
   96 bits; the smallest id of each is a pre-aggregated count, joined back
   to the places (a join that Spark may split at frequent windows).

Edge cases: null and short texts lose nothing; rows without an id lose nothing
and take nothing from others; rows that are equal or share an id never take
from each other, as neither id is smaller; no rows give no rows; columns of the
input named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .shared import any_columns, bloom_bits, documents, extended, in_bloom, joined_small, stored

#: Perfect difference sets (every remainder is a difference of two members), by period.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
BLOOM_BITS = 26


def period_for(window: int) -> int:
    """The largest period that leaves anchors of two fifths of a window at least."""
    return max((p for p in COVERS if 5 * (window - p + 1) >= 2 * window), default=3)


def _anchors(w: A.Words, hashed: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the texts that hold a window."""
    period = period_for(window)
    size = window - period + 1
    inside = np.zeros(period, bool)
    inside[list(COVERS[period])] = True
    at = w.whole(size)
    doc = w.doc[at]
    at = at[inside[(at - w.first[doc]) % period] & (np.diff(w.first)[doc] >= window)]
    return at, w.windows(hashed, size)[at] if len(at) else np.zeros(0, np.uint64)


def _key():
    return F.xxhash64("_sd_id", "_sd_text").alias("_sd_row")


def repeated_windows(docs: DataFrame, window: int, bloom: int = BLOOM_BITS) -> DataFrame:
    """(_sd_id, _sd_row, _sd_whole, _sd_places): first words of repeated windows, or whole for a copy of a text with a smaller id. docs: _sd_id long, _sd_text."""
    sc = docs.sparkSession.sparkContext
    docs = docs.where(F.col("_sd_id").isNotNull() & F.col("_sd_text").isNotNull())
    prints = docs.select("_sd_id", _key(), F.md5("_sd_text").alias("print"))
    smallest = stored(prints.groupBy("print").agg(F.min("_sd_id").alias("least"), F.max("_sd_id").alias("most")).where("least < most").drop("most"))
    copies = stored(joined_small(prints, smallest, ["print"], "inner").where("_sd_id > least").select("_sd_id", "_sd_row").distinct())
    rest = joined_small(docs.withColumn("_sd_row", _key()), copies, ["_sd_id", "_sd_row"], "left_anti")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in A.blocks(batches, "_sd_text"):
            w = A.Words(texts)
            at, h = _anchors(w, w.hashes(), window)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield A.table(h=A.signed(h), id=ids[w.doc[at]])

    found = rest.select("_sd_id", "_sd_text").mapInArrow(anchors, "h long, id long").groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    sent = sc.broadcast(bloom_bits(found, bloom))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        period = period_for(window)
        for part, texts in A.blocks(batches, "_sd_text"):
            w = A.Words(texts)
            hashed = w.hashes()
            at, h = _anchors(w, hashed, window)
            at = at[in_bloom(sent.value, h)]
            change = np.zeros(len(w) + 1, np.int64)
            np.add.at(change, np.maximum(at - period + 1, w.first[w.doc[at]]), 1)
            np.add.at(change, at + 1, -1)
            start = w.whole(window)
            start = start[np.cumsum(change)[start] > 0]
            ids, rows = part.column(0).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False)
            doc = w.doc[start]
            first, second = (w.windows(x, window, k)[start] if len(start) else np.zeros(0, np.uint64) for k, x in ((0, hashed), (1, hashed)))
            second = (second >> np.uint64(32)).astype(np.uint32)
            # A window that occurs several times in a text is one row with all its places.
            order = np.lexsort((start, second, first, doc))
            first, second, doc, start = first[order], second[order], doc[order], start[order]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(doc)), bool), (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
            ends = np.concatenate([new, [len(doc)]]).astype(np.int32)
            at = pa.ListArray.from_arrays(pa.array(ends), pa.array((start - w.first[doc]).astype(np.int32)))
            yield A.table(h=A.signed(first[new]), g=second[new].view(np.int32), id=ids[doc[new]], row=rows[doc[new]], places=at)

    places = rest.select("_sd_id", "_sd_text", "_sd_row").mapInArrow(windows, "h long, g int, id long, row long, places array<int>")
    least = places.groupBy("h", "g").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("h", "g", "least")
    repeated = places.join(least, ["h", "g"]).where("id > least").groupBy(F.col("id").alias("_sd_id"), F.col("row").alias("_sd_row")).agg(F.flatten(F.collect_list("places")).alias("_sd_places"))
    return repeated.withColumn("_sd_whole", F.lit(False)).unionByName(copies.select("_sd_id", "_sd_row", F.array().cast("array<int>").alias("_sd_places"), F.lit(True).alias("_sd_whole")))


@any_columns("text", "id_")
def without_repeats(docs: DataFrame, window: int = 50, text: str = "text", id_: str = "doc_id", bloom: int = BLOOM_BITS) -> DataFrame:
    """docs with n_words, n_removed and kept_text: the words that stay, joined by one space (empty for a null text)."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    found = repeated_windows(docs.select(F.col(id_).cast("long").alias("_sd_id"), F.col(text).alias("_sd_text")), window, bloom)
    both = docs.withColumns({"_sd_id": F.col(id_).cast("long"), "_sd_text": F.col(text)}).withColumn("_sd_row", _key()).drop("_sd_text").join(found, ["_sd_id", "_sd_row"], "left").drop("_sd_id", "_sd_row")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in A.blocks(batches, text):
            whole, places = part.column(part.schema.get_field_index("_sd_whole")).to_pylist(), part.column(part.schema.get_field_index("_sd_places"))
            n_words, n_removed, kept = [], [], []
            for k, raw in enumerate(texts):
                words = raw.split()
                keep = np.ones(len(words), bool)
                if whole[k]:
                    keep[:] = len(words) < window
                elif whole[k] is not None:
                    change = np.zeros(len(words) + 1, np.int64)
                    at = places[k].values.to_numpy(zero_copy_only=False)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
                    keep = np.cumsum(change)[:-1] == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(compress(words, keep.tolist()) if n_removed[-1] else words))
            columns = [c for c, name in zip(part.columns, part.schema.names, strict=True) if name not in ("_sd_whole", "_sd_places")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return both.select(*docs.columns, "_sd_whole", "_sd_places").mapInArrow(run, extended(docs.schema, n_words="long", n_removed="long", kept_text="string"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
