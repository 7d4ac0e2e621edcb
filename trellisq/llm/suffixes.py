"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else as
well, in the same text or another.

1. Where to look: each string of ``length`` bytes has one anchor, the ``GRAM`` bytes in it
   whose hash is least (leftmost of equals).  Equal strings have equal anchors
   at equal offsets.  Neighbouring starts share an anchor, so a text is a list of
   *runs*: (anchor, first start, last start).  Runs whose anchor occurs once in the corpus
   cannot repeat; a Bloom filter of a fixed size leaves the others.
2. Anchors with at most ``most`` runs: the runs with their bytes meet by anchor.  There the
   suffixes from the anchor are sorted by a mergesort whose comparisons are logarithmic: prefix
   polynomial hashes and binary search give the common extension of two
   suffixes, and the byte after it decides.  The least extension between two places of the
   order is what those two share to the right; the same search backwards gives the left, and
   together the starts that repeat.  Each match used is verified byte by byte.
3. Anchors with more runs: their strings are counted by a 128-bit hash, pre-aggregated, and
   the counts joined back (a join that Spark may split).  No group of more than ``most`` runs is ever gathered.

Equal texts are one: only one of them is searched, and all of them go whole.

Passages shorter than ``length`` stay.  With ``passage``, the same search for strings of so many bytes that
also start in another text tells how many bytes of each text such strings cover; it removes nothing.

Rows in which nothing was found, told by a Bloom filter of a fixed size, are not shuffled.

Edge cases: null and short texts lose nothing; equal rows are repeats of one
another; ids play no part, so they may be null or repeated; what stays may not be valid
UTF-8 and is therefore binary; no rows give no rows; columns of the input named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .shared import any_columns, bloom_bits, documents, extended, in_bloom, joined_small, stored

GRAM = 64
MOST = 64
BLOOM_BITS = 26
BATCH_BYTES = 1 << 20
#: Bytes that 50 words rarely fall short of: 95 of 100 texts of sf0.1 open with 50 words of 267 bytes or more, 99 with 244 or more.
PASSAGE = 250


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, in three passes."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Runs:
    """The runs of a block's texts: doc, anchor (hash), place of the anchor, first and last start, in bytes of the text."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        # Texts too short for a string take no part.
        self.texts = [t if len(t) >= length else b"" for t in texts]
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)
        sizes = np.where(sizes >= length, sizes, 0)
        offset = np.concatenate([[0], np.cumsum(sizes)])
        self.anchor = np.zeros(0, np.uint64)
        self.doc = self.place = self.lo = self.hi = np.zeros(0, np.int64)
        if not len(self.raw):
            return
        self.sums = A.prefix_sums(self.raw)
        at = np.arange(len(self.raw) - GRAM + 1)
        gram = A.between(self.sums, at, at + GRAM)
        least = sliding_least(gram & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64), length - GRAM + 1) & np.uint64(0xFFFFFFFF)
        doc = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
        start = np.flatnonzero(np.arange(len(least)) + length <= offset[doc + 1])
        place, doc = least[start].astype(np.int64), doc[start]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.concatenate([new[1:], [len(start)]]) - 1
        self.doc, self.anchor = doc[new], gram[place[new]]
        self.offset = offset
        self.place, self.lo, self.hi = place[new], start[new], start[last]


def _extension(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """How far the bytes from a and from b on (or, backwards, before them) agree, by binary search on hashes; at most ``most``."""
    lo, hi = np.zeros(len(a), np.int64), most.astype(np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) // 2
        if back:
            equal = A.between(sums, a - mid, a) == A.between(sums, b - mid, b)
        else:
            equal = A.between(sums, a, a + mid) == A.between(sums, b, b + mid)
        lo, hi = np.where(open_ & equal, mid, lo), np.where(open_ & ~equal, mid - 1, hi)
    return lo


def _precedes(raw: np.ndarray, sums: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether suffix a (up to its end) sorts before suffix b, or is equal to it."""
    most = np.minimum(a_end - a, b_end - b)
    same = _extension(sums, a, b, most)
    done = same == most
    last = len(raw) - 1
    return np.where(done, a_end - a <= b_end - b, raw[np.minimum(a + same, last)] < raw[np.minimum(b + same, last)])


def suffix_order(raw: np.ndarray, sums: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes start..end sorted within each group (groups are contiguous): bottom-up mergesort of all groups at once.

    To merge two runs, each element finds its place in the other run by binary search with ``_precedes``.
    """
    n = len(start)
    order = np.arange(n)
    first = np.searchsorted(group, group)  # of each place's group
    after = np.searchsorted(group, group, side="right")
    width = 1
    while width < (after - first).max(initial=0):
        here = np.arange(n)
        run = (here - first) // width
        mine = first + run * width
        other = np.where(run % 2 == 0, mine + width, mine - width)
        lo = np.minimum(other, after)
        hi = np.minimum(lo + width, after)
        base = lo.copy()
        while (open_ := lo < hi).any():
            k = np.flatnonzero(open_)
            mid = (lo[k] + hi[k]) // 2
            x, y = order[mid], order[k]
            left = run[k] % 2 == 0  # of equals the left run comes first
            below = np.where(left, ~_precedes(raw, sums, start[y], end[y], start[x], end[x]), _precedes(raw, sums, start[x], end[x], start[y], end[y]))
            lo[k], hi[k] = np.where(below, mid + 1, lo[k]), np.where(below, hi[k], mid)
        place = np.minimum(mine, np.where(run % 2 == 0, mine, other)) + (here - mine) + (lo - base)
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    return order


def repeated_starts(anchors: np.ndarray, pieces: list[bytes], offset: np.ndarray, count: np.ndarray, length: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): starts within a row's piece whose string repeats in a row of the same anchor.

    anchors: sorted. pieces: the bytes from a row's first start to the end of its last string. offset: of the anchor
    in the piece. count: of starts. of: the text of a row, if rows of one text are not to be compared.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sums = A.prefix_sums(raw)
    at, end = begin[:-1] + offset, begin[1:]
    group = np.concatenate([[0], np.cumsum(anchors[1:] != anchors[:-1])])
    order = suffix_order(raw, sums, group, at, end)
    at, end, begin, offset, count = at[order], end[order], begin[:-1][order], offset[order], count[order]
    n = len(order)
    right = np.zeros(n, np.int64)
    pair = np.arange(n - 1)[group[1:] == group[:-1]]
    right[pair] = _extension(sums, at[pair], at[pair + 1], np.minimum(end[pair] - at[pair], end[pair + 1] - at[pair + 1]))
    rows, first, last = [], [], []
    reach, i, step = right.copy(), np.flatnonzero(right > 0), 1
    while len(i):
        j = i + step
        left = _extension(sums, at[i], at[j], np.minimum(offset[i], offset[j]), back=True)
        # A start at distance d before the anchor repeats if d <= left and length - d <= right.
        most, least = left, np.maximum(length - reach[i], 0)
        ok = most >= least
        if of is not None:
            ok &= of[order[i]] != of[order[j]]
        a, b, most_, least_, reach_ = i[ok], j[ok], most[ok], least[ok], reach[i][ok]
        for x, y, l_, r_ in zip(at[a].tolist(), at[b].tolist(), left[ok].tolist(), reach_.tolist(), strict=True):
            if raw[x - l_ : x + r_].tobytes() != raw[y - l_ : y + r_].tobytes():
                raise ArithmeticError("two different strings have equal hashes")  # p < 2**-40 for a whole corpus
        for k in (a, b):
            lo, hi = np.maximum(offset[k] - most_, 0), np.minimum(offset[k] - least_, count[k] - 1)
            good = lo <= hi
            rows.append(order[k][good])
            first.append(lo[good])
            last.append(hi[good])
        # The next place of the order: what is shared is the least of the extensions between.
        step += 1
        i = i[i + step < n]
        i = i[group[i + step] == group[i]]
        reach[i] = np.minimum(reach[i], right[i + step - 1])
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(first), np.concatenate(last)


def _told_apart(h: np.ndarray, g: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of hashes that occur once (or, given doc, in one text only), of those that occur several times, and one place for each of the latter."""
    order = np.lexsort((g, h) if doc is None else (doc, g, h))
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]))
    n = np.diff(np.concatenate([new, [len(h)]]))
    many = n > 1 if doc is None else doc[order[new]] != doc[order[new + n - 1]]
    each = np.repeat(many, n)
    return order[~each], order[each], order[new[many]]


def repeated_strings(docs: DataFrame, length: int = 400, most: int = MOST, bloom: int = BLOOM_BITS, across: bool = False) -> DataFrame:
    """(_sx_row, _sx_whole, _sx_starts): first and last starts of repeated strings in the text, or whole if it has a copy. docs: _sx_row, _sx_text.

    across: only strings that also start in another text.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.where(F.octet_length("_sx_text") >= length)
    prints = docs.select("_sx_row", F.md5("_sx_text").alias("print"))
    classes = stored(prints.groupBy("print").agg(F.min("_sx_row").alias("least"), F.count("*").alias("n")).where("n > 1").select("print", "least"))
    copies = stored(joined_small(prints, classes, ["print"], "inner").select("_sx_row", (F.col("_sx_row") != F.col("least")).alias("skip")).distinct())
    rest = joined_small(docs, copies.where("skip").select("_sx_row"), ["_sx_row"], "left_anti").select("_sx_row", "_sx_text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in A.blocks(batches, "_sx_text"):
            h, n = np.unique(Runs(texts, length).anchor, return_counts=True)
            yield A.table(h=A.signed(h), n=n.astype(np.int64))

    counts = stored(rest.select("_sx_text").mapInArrow(anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    shared, frequent = sc.broadcast(bloom_bits(counts, bloom)), sc.broadcast(bloom_bits(counts.where(F.col("n") > most), bloom))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in A.blocks(batches, "_sx_text"):
            r, ids = Runs(texts, length), part.column(0).to_numpy()
            keep = np.flatnonzero(in_bloom(shared.value, r.anchor))
            hot = in_bloom(frequent.value, r.anchor[keep])
            k = keep[~hot]
            raw = r.raw.tobytes() if len(keep) else b""
            n, null = len(k), pa.nulls
            first = r.lo[k] - r.offset[r.doc[k]] if n else k
            yield A.table(
                anchor=A.signed(r.anchor[k]), row=ids[r.doc[k]], first=first.astype(np.int32), offset=(r.place[k] - r.lo[k]).astype(np.int32), count=(r.hi[k] - r.lo[k] + 1).astype(np.int32),
                piece=pa.array([raw[a:b] for a, b in zip(r.lo[k].tolist(), (r.hi[k] + length).tolist(), strict=True)], pa.binary()), h=null(n, pa.int64()), g=null(n, pa.int64()),
            )
            k = keep[hot]
            if len(k):
                size = r.hi[k] - r.lo[k] + 1
                start = np.repeat(r.lo[k], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                doc = np.repeat(r.doc[k], size)
                h, g = A.between(r.sums, start, start + length), A.between(A.prefix_sums(r.raw, 1), start, start + length, 1)
                once, several, example = _told_apart(h, g, doc if across else None)
                # What repeats within the block is known to repeat: its places go out as ranges, and one row tells other blocks of it.
                several = several[np.argsort(start[several])]
                at, of = start[several], doc[several]
                new = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])]))
                last = np.concatenate([new[1:], [len(at)]])[: len(new)] - 1
                m = len(new)
                yield A.table(anchor=null(m, pa.int64()), row=ids[of[new]], first=(at[new] - r.offset[of[new]]).astype(np.int32), offset=null(m, pa.int32()), count=(last - new + 1).astype(np.int32), piece=null(m, pa.binary()), h=null(m, pa.int64()), g=null(m, pa.int64()))
                row = pa.concat_arrays([pa.array(ids[doc[once]], pa.int64()), null(len(example), pa.int64())])
                first = np.concatenate([(start - r.offset[doc])[once], np.zeros(len(example), np.int64)]).astype(np.int32)
                both = np.concatenate([once, example])
                for a in range(0, len(both), 1 << 16):
                    n = min(len(both) - a, 1 << 16)
                    k = both[a : a + n]
                    yield A.table(anchor=null(n, pa.int64()), row=row.slice(a, n), first=first[a : a + n], offset=null(n, pa.int32()), count=null(n, pa.int32()), piece=null(n, pa.binary()), h=A.signed(h[k]), g=A.signed(g[k]))

    found = stored(rest.mapInArrow(runs, "anchor long, row long, first int, offset int, count int, piece binary, h long, g long"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            anchor, row, first, offset, count = (batch.column(k).to_numpy().astype(np.int64) for k in range(5))
            at, lo, hi = repeated_starts(anchor, batch.column(5).to_pylist(), offset, count, length, row if across else None)
            return A.table(row=row[at], lo=(first[at] + lo).astype(np.int32), hi=(first[at] + hi).astype(np.int32))

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            batch = pa.concat_batches(held)
            anchor = batch.column(0).to_numpy()
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])), [len(anchor)]])
            size = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(5)).to_numpy())])
            a = 0
            groups = edges if last else edges[:-1]
            while a < groups[-1]:
                b = int(groups[min(np.searchsorted(groups, np.searchsorted(size, size[a] + BATCH_BYTES)), len(groups) - 1)])
                b = b if b > a else int(groups[np.searchsorted(groups, a, side="right")])
                yield out(batch.slice(a, b - a))
                a = b
            held = [batch.slice(int(groups[-1]))] if groups[-1] < len(anchor) else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= 4096:
                    yield from whole(False)
        if held:
            yield from whole(True)

    rows = found.where("anchor is not null").select("anchor", "row", "first", "offset", "count", "piece")
    sorted_ = rows.repartition("anchor").sortWithinPartitions("anchor", "row", "first").mapInArrow(compared, "row long, lo int, hi int")
    known = found.where("anchor is null and h is null").select("row", F.col("first").alias("lo"), (F.col("first") + F.col("count") - 1).alias("hi"))
    strings = found.where("h is not null").select("h", "g", "row", F.col("first").alias("lo"))
    # An example stands for places in several texts.
    again = (F.min("row") != F.max("row")) | (F.count("*") > F.count("row")) if across else F.count("*") > 1
    often = strings.groupBy("h", "g").agg(again.alias("again")).where("again").select("h", "g")
    counted = strings.where("row is not null").join(often, ["h", "g"]).select("row", "lo", F.col("lo").alias("hi"))
    starts = sorted_.unionAll(counted).unionAll(known).groupBy(F.col("row").alias("_sx_row")).agg(F.collect_set(F.struct("lo", "hi")).alias("_sx_starts")).withColumn("_sx_whole", F.lit(False))
    return starts.select("_sx_row", "_sx_whole", "_sx_starts").unionAll(copies.select("_sx_row", F.lit(True), F.lit(None))).groupBy("_sx_row").agg(F.max("_sx_whole").alias("_sx_whole"), F.first("_sx_starts", True).alias("_sx_starts"))


def _covered(size: int, whole: bool | None, starts: pa.Scalar, length: int) -> np.ndarray:
    """Which bytes of a text lie in a string of so many bytes at one of the starts."""
    if whole:
        return np.ones(size, bool)
    change = np.zeros(size + 1, np.int64)
    if starts.is_valid:
        np.add.at(change, starts.values.field(0).to_numpy(), 1)
        np.add.at(change, starts.values.field(1).to_numpy() + length, -1)
    return np.cumsum(change)[:-1] > 0


@any_columns("text", "id_")
def without_repeated_strings(docs: DataFrame, length: int = 400, text: str = "text", id_: str = "doc_id", passage: int | None = None, bloom: int = BLOOM_BITS, **settings) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept_bytes (binary, empty for a null text).

    passage: n_shared as well, the bytes in strings of so many bytes that also start in another row's text.
    """
    new = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_bytes": "binary"} | ({"n_shared": "long"} if passage else {})
    docs = docs.drop(*new)
    names = docs.columns
    keyed = docs.withColumn("_sx_row", F.xxhash64(F.col(id_), F.col(text)))
    plain = keyed.select("_sx_row", F.col(text).alias("_sx_text"))
    found = repeated_strings(plain, length, bloom=bloom, **settings).select("*", F.lit(None).cast("boolean").alias("_sx_copy"), F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("_sx_shared"))
    if passage:
        shared = repeated_strings(plain, passage, bloom=bloom, across=True, **settings)
        both = found.unionAll(shared.select("_sx_row", F.lit(None).cast("boolean"), F.lit(None).cast("array<struct<lo:int,hi:int>>"), "_sx_whole", "_sx_starts"))
        found = both.groupBy("_sx_row").agg(*(F.max(c).alias(c) if c in ("_sx_whole", "_sx_copy") else F.first(c, True).alias(c) for c in both.columns[1:]))
    found = stored(found)
    some = docs.sparkSession.sparkContext.broadcast(bloom_bits(found.select(F.col("_sx_row").alias("h")), bloom))

    def result(part: pa.RecordBatch, texts: list[bytes], marks: list[pa.Array] | None = None) -> pa.RecordBatch:
        removed, spans, kept, shared = [], [], [], []
        for k, raw in enumerate(texts):
            if marks is None:
                removed.append(0), spans.append(0), kept.append(raw), shared.append(0)
                continue
            gone = _covered(len(raw), marks[0][k].as_py(), marks[1][k], length)
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes() if removed[-1] else raw)
            if passage:
                shared.append(int(_covered(len(raw), marks[2][k].as_py(), marks[3][k], passage).sum()))
        more = [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
        more += [pa.array(shared, pa.int64())] if passage else []
        return pa.RecordBatch.from_arrays([*part.columns[: len(names)], *more], names=[*names, *new])

    def chosen(batches: Iterator[pa.RecordBatch], hit: bool) -> Iterator[pa.RecordBatch]:
        """The rows in which something may have been found, or those in which nothing was."""
        for batch in batches:
            rows = A.unsigned(batch.column(batch.num_columns - 1).to_numpy())
            yield batch.filter(pa.array(in_bloom(some.value, rows) == hit))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in A.blocks(chosen(batches, False), text):
            yield result(part, texts)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in A.blocks(batches, text):
            yield result(part, texts, part.columns[len(names) :])

    schema = extended(docs.schema, **new)
    hits = keyed.mapInArrow(lambda batches: chosen(batches, True), keyed.schema).join(found, "_sx_row", "left")
    return keyed.mapInArrow(untouched, schema).unionAll(hits.select(*names, "_sx_whole", "_sx_starts", "_sx_copy", "_sx_shared").mapInArrow(touched, schema))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_strings(documents(spark, sf_dir).select("doc_id", "text"), passage=PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), "n_shared")
