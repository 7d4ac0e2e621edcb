"""Benchmark decontamination as a prefix-filtered set join.

The words of each benchmark window are ordered by how rare they are in the
corpus.  As containment has to be whole, a window's necessary prefix is its
rarest word: a document can hold the window only where it holds that word.
Each such place gives the one position at which the window could start; the
bounds of the document and the window's length cut places off, and what is
left is verified over the whole window, by its hash and then word by word.
Equal windows are one, and the (place, window) pairs of a block of documents are
looked at a bounded number at a time.

The benchmark goes to the executors in blocks of at most ``block_bytes`` of
text.  The corpus is never shuffled: each block is one pass that carries the
hits found so far along with the row, so any size of benchmark is joined in
bounded memory (one block is the common case).

Edge cases: a null, empty or short text has no words or windows and is hit by nothing; a very long one is a block of its own; equal rows get
equal results each; no documents give no rows; columns of docs named like an output are replaced; items without an id, a text or a word
match nothing; equal windows of several items count for each of them; an
item id that occurs twice is one item; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .shared import any_columns, documents, extended

WINDOW = 8
#: Pairs of places and windows that are held at a time.
PAIRS = 1 << 20
COLUMNS = {"n_words": "long", "n_hit": "long", "n_items": "long", "items": "array<string>", "contaminated": "boolean"}


class Lookup:
    """Sorted hashes with a bitmap before them, so that words that are not there cost one read."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.sorted >> np.uint64(42)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those that are there, and their ranks."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(42)])
        rank = np.searchsorted(self.sorted, hashes[at])
        rank[rank == len(self.sorted)] = 0
        there = self.sorted[rank] == hashes[at] if len(self.sorted) else np.zeros(len(at), bool)
        return at[there], rank[there]


class Index:
    """The different windows of one block of items, and the items of each (``items_of`` from ``item_first`` on)."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = [i for i, _ in items]
        w = A.Words([t.encode() for _, t in items], A.NON_WORD, lower=True)
        self.words = w.hashes()
        size = np.minimum(np.diff(w.first), WINDOW)
        n_windows = np.where(size > 0, np.diff(w.first) - size + 1, 0)
        item = np.repeat(np.arange(len(items)), n_windows)
        within = np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        start, size = w.first[item] + within, size[item]
        one, two = (span_hashes(span_sums(w.hashes(k), k), start, start + size, k) for k in (0, 1))
        order = np.lexsort((item, size, two, one))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (one, two, size)], axis=0)
        at = order[new]
        self.start, self.size, self.hash = start[at], size[at], one[at]
        window = np.cumsum(new) - 1
        owner = np.unique(np.stack([window, item[order]], axis=1), axis=0) if len(order) else np.zeros((0, 2), np.int64)
        self.items_of, self.item_first = owner[:, 1], np.searchsorted(owner[:, 0], np.arange(len(at) + 1))
        self.raw, self.word_start, self.word_end = w.raw, w.start, w.end
        self.vocabulary = np.unique(self.words)

    def order(self, counts: np.ndarray) -> None:
        """counts: of each word of the vocabulary in the corpus. Keys each window by its rarest word."""
        rarity = counts[np.searchsorted(self.vocabulary, self.words)]
        offsets = np.arange(WINDOW)
        at = np.minimum(self.start[:, None] + offsets, len(self.words) - 1)
        cost = np.where(offsets < self.size[:, None], rarity[at], np.iinfo(np.int64).max)
        self.offset = np.argmin(cost, axis=1) if len(cost) else np.zeros(0, np.int64)
        key = self.words[self.start + self.offset] if len(cost) else np.zeros(0, np.uint64)
        self.lookup = Lookup(key)
        rank = np.searchsorted(self.lookup.sorted, key)
        self.by_key = np.argsort(rank, kind="stable")
        self.key_first = np.searchsorted(rank[self.by_key], np.arange(len(self.lookup.sorted) + 1))

    def hits(self, w: A.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of all occurrences in a block of documents: a word starts one window of each size at most."""
        hashed = w.hashes()
        sums = span_sums(hashed, 0)
        places, rank = self.lookup(hashed)
        counts = self.key_first[rank + 1] - self.key_first[rank]
        until, out, lo = np.cumsum(counts), [], 0
        while lo < len(places):
            hi = max(lo + 1, int(np.searchsorted(until, (until[lo - 1] if lo else 0) + PAIRS, side="right")))
            n = counts[lo:hi]
            place, within = np.repeat(places[lo:hi], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            window = self.by_key[np.repeat(self.key_first[rank[lo:hi]], n) + within]
            first = place - self.offset[window]
            doc = w.doc[place]
            inside = (first >= w.first[doc]) & (first + self.size[window] <= w.first[doc + 1])
            first, window = first[inside], window[inside]
            same = span_hashes(sums, first, first + self.size[window], 0) == self.hash[window]
            first, window = first[same], window[same]
            same = self._same_words(w, first, window)
            out.append((first[same], window[same]))
            lo = hi
        if not out:
            return (np.zeros(0, np.int64),) * 2
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _same_words(self, w: A.Words, first: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Whether the words from first on are those of the window, byte by byte."""
        if not len(first):
            return np.zeros(0, bool)

        def ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            before = np.cumsum(n) - n
            return np.repeat(start - before, n) + np.arange(n.sum()), before

        size = self.size[window]
        (a, before), (b, _) = ranges(first, size), ranges(self.start[window], size)
        length = w.end[a] - w.start[a]
        same = length == self.word_end[b] - self.word_start[b]
        at = np.flatnonzero(same)
        if len(at):
            (x, begin), (y, _) = ranges(w.start[a[at]], length[at]), ranges(self.word_start[b[at]], length[at])
            same[at] = np.logical_and.reduceat(w.raw[x] == self.raw[y], begin)
        return np.logical_and.reduceat(same, before)


def span_sums(hashed: np.ndarray, which: int) -> np.ndarray:
    sums = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * A.powers(A._WORD_BASES[which], len(hashed) + 1)[0][: len(hashed)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return (sums[end] - sums[start]) * A.powers(A._WORD_BASES[which], len(sums))[1][start]


def _word_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each hashed word of the vocabulary occurs in the whole corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value)
        counts = np.zeros(len(lookup.sorted), np.int64)
        for _, texts in A.blocks(batches, text):
            counts += np.bincount(lookup(A.Words(texts, A.NON_WORD, lower=True).hashes())[1], minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield A.table(word=pa.array(seen, pa.int64()), n=counts[seen])

    counts = np.zeros(len(vocabulary), np.int64)
    for r in docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["word"]] = r["n"]
    return counts


def _blocks(benchmark: DataFrame, id_: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size, streamed to the driver a block at a time."""
    held, size = [], 0
    items = benchmark.where(F.col(id_).isNotNull() & F.col(text).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.col(text).alias("text"))
    for r in items.toLocalIterator():
        if held and size + len(r["text"]) > block_bytes:
            yield held
            held, size = [], 0
        held.append((r["id"], r["text"]))
        size += len(r["text"])
    if held:
        yield held


@any_columns("text")
def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_items: int = 2, block_bytes: int = 16 << 20, prefix: str = "") -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of a window), n_items, items (their ids, sorted) and contaminated.

    Columns of docs by these names (after the prefix) are replaced.
    """
    sc = docs.sparkSession.sparkContext
    names = [prefix + x for x in COLUMNS]
    out = docs.drop(*names)
    plain = out.schema
    parts = list(_blocks(benchmark, item_id, item_text, block_bytes)) or [[]]
    for k, items in enumerate(parts):
        index = Index(items)
        index.order(_word_counts(docs, text, index.vocabulary))
        out = _pass(out, text, sc.broadcast(index), k == 0, k == len(parts) - 1, names, min_items, plain)
    return out


def _pass(docs, text, sent, is_first, is_last, names, min_items, plain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        ids = np.array([*index.ids, ""], object)
        for part, texts in A.blocks(batches, text):
            w = A.Words(texts, A.NON_WORD, lower=True)
            first, window = index.hits(w)
            change = np.zeros(len(w) + 1, np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, first + index.size[window], -1)
            hit = np.cumsum(change)[:-1] > 0
            found = [set() for _ in texts]
            for d, x in set(zip(w.doc[first].tolist(), window.tolist(), strict=True)):
                found[d].update(ids[index.items_of[index.item_first[x] : index.item_first[x + 1]]])
            if not is_first:
                for d, (packed, seen) in enumerate(zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)):
                    a, b = w.first[d], w.first[d + 1]
                    hit[a:b] |= np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
                    found[d].update(seen)
            columns = part.columns if is_first else part.columns[:-2]
            lists = pa.array([sorted(x) for x in found], pa.list_(pa.string()))
            if is_last:
                n_items = np.fromiter(map(len, found), np.int64, len(found))
                more = [pa.array(np.diff(w.first)), pa.array(np.bincount(w.doc[hit], minlength=len(texts)).astype(np.int64)), pa.array(n_items), lists, pa.array(n_items >= min_items)]
            else:
                more = [pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)], pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*plain.names, *(names if is_last else ("_hits", "_items"))])

    return docs.mapInArrow(run, extended(plain, **(dict(zip(names, COLUMNS.values(), strict=True)) if is_last else {"_hits": "binary", "_items": "array<string>"})))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
