"""Personal data: patterns, and terms that disclose the people behind them.

Base kinds (email, ip, card, phone) are found by pattern.  Their values are the
protected entities.  A term discloses an entity as far as seeing the term tells of
the entity: P(entity | term) over whole texts, estimated as rows with both / (rows with
the term + ``prior``).  So a term that stands in rows of one entity alone has a share of 1/2 if it is one
row and the entity is known from this text only, and more with every row; a term of one such row and another
row without the entity has 1/3.  The least evidence is thus one row with the entity and none against it.
Terms with a share of ``disclosing`` or more are added as spans of kind ``term`` wherever they
occur in the corpus; in the sanitised text those at or above ``removing`` (nine rows, none against) are
removed and the others generalised.

Rows are counted for the whole corpus, and only terms whose rows with any entity reach the share go on.  A term whose
rows with entities are all one text needs no pairs.  For the others, entities of the same
texts are one class, and (class, term) is counted from (text, class) and (text, term), joined by hashes; the
disclosing terms go out in blocks of ``block_terms``, one pass each (one is the common case), so no text is shuffled.

Edge cases: a null text is empty and its sanitised text stays null; base spans of different kinds may
overlap and all stay, terms never overlap base spans; equal rows count as
rows of their own; no rows give no rows; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .decontaminate import Lookup
from .shared import any_columns, bloom_bits, documents, extended, in_bloom, stored

KINDS = ("email", "ip", "card", "phone", "term")
COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "n_term", "base", "spans", "sanitised")
SPAN = "array<struct<rank:int,start:int,kind:string,end:int>>"
BLOOM_BITS = 24
#: The patterns, on UTF-8. A match can only start where no digit precedes, as it would have started there.
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(rb"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = np.zeros(256, bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
_NOT_DIGIT = bytes(x for x in range(256) if not 48 <= x <= 57)


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and _LOCAL[text[start - 1]]:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find(b"@", max(at + 1, done))


def base_spans(text: bytes, digits: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes: leftmost, not overlapping within a kind, what fails its check dropped."""
    out = [(0, a, b) for a, b in _emails(text)] if b"@" in text else []
    if digits:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or b"0") <= 255 for x in (p.lstrip(b"0") for p in m.groups()))]
        for m in _CARD.finditer(text):
            d = m[0].translate(None, _NOT_DIGIT)
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(m[0].translate(None, _NOT_DIGIT)) <= 15]
    return out


class Found:
    """The base spans of the texts of a block, and the words between them."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.words = texts, A.Words(texts, A.NON_WORD, lower=True)
        w = self.words
        digit = np.concatenate([[0], np.cumsum((w.raw >= 48) & (w.raw <= 57))])
        has = (digit[w.offset[1:]] > digit[w.offset[:-1]]).tolist()
        self.base = [base_spans(t, d) for t, d in zip(texts, has, strict=True)]
        points = np.cumsum((w.raw & 0xC0) != 0x80)
        self.points = np.concatenate([[0], points])  # code points before each byte

    def point(self, doc: int, byte: int) -> int:
        start = self.words.offset[doc]
        return int(self.points[start + byte] - self.points[start])

    def free(self) -> np.ndarray:
        """Which words lie outside all base spans."""
        w = self.words
        change = np.zeros(len(w.raw) + 1, np.int64)
        for d, spans in enumerate(self.base):
            for _, a, b in spans:
                change[w.offset[d] + a] += 1
                change[w.offset[d] + b] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
        return covered[w.end] == covered[w.start]


def _counted(docs: DataFrame) -> DataFrame:
    """(term, rows, beside): the rows that hold a term, and those that hold it outside the base spans and hold an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in A.blocks(batches):
            f = Found(texts)
            w, h = f.words, f.words.hashes()
            beside = f.free() & np.array([bool(x) for x in f.base])[w.doc]
            order = np.lexsort((~beside, h, w.doc))
            h, doc = h[order], w.doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            term, at = np.unique(h[new], return_inverse=True)
            both = np.bincount(at, beside[order][new], len(term))
            yield A.table(term=A.signed(term), rows=np.bincount(at, minlength=len(term)).astype(np.int64), beside=both.astype(np.int64))

    return docs.mapInArrow(run, "term long, rows long, beside long").groupBy("term").agg(F.sum("rows").alias("rows"), F.sum("beside").alias("beside"))


def _held(docs: DataFrame, sent) -> DataFrame:
    """(print, entity, value): once for a row that holds an entity, its entities and those of its terms that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in A.blocks(batches):
            f = Found(texts)
            if not any(f.base):
                continue
            w, h, prints = f.words, f.words.hashes(), A.text_hashes(texts)
            free = f.free() & np.array([bool(x) for x in f.base])[w.doc]
            at = np.flatnonzero(free)
            at = at[in_bloom(sent.value, h[at])]
            order = at[np.lexsort((h[at], w.doc[at]))]
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
            term, doc = h[order][new], w.doc[order][new]
            owner, values = [], []
            for d, spans in enumerate(f.base):
                found = {bytes([k]) + (texts[d][a:b].lower() if k < 2 else texts[d][a:b].translate(None, _NOT_DIGIT)) for k, a, b in spans}
                owner += [d] * len(found)
                values += found
            kind = np.repeat([False, True], [len(term), len(values)])
            doc = np.concatenate([doc, np.array(owner, np.int64)])
            yield A.table(print=A.signed(prints[doc]), entity=pa.array(kind), value=A.signed(np.concatenate([term, A.text_hashes(values)])))

    return docs.mapInArrow(run, "print long, entity boolean, value long")


def disclosing_terms(docs: DataFrame, prior: float = 1.0, disclosing: float = 0.5, bloom: int = BLOOM_BITS) -> DataFrame:
    """(term, share): hashed terms, and the largest share of their rows that hold one entity. docs: text."""
    terms = stored(_counted(docs).where(F.col("beside") >= disclosing * (F.col("rows") + prior)).where("beside > 0"))
    sent = docs.sparkSession.sparkContext.broadcast(bloom_bits(terms.select(F.col("term").alias("h")), bloom))
    held = stored(_held(docs, sent).groupBy("print", "entity", "value").agg(F.count("*").alias("n")))
    near = stored(held.where("not entity").select("print", F.col("value").alias("term"), "n").join(terms, "term"))
    alone = near.where("n = beside").select("term", "rows", "n")
    # Entities of the same texts are one class: a text of many entities gives few pairs.
    texts = held.where("entity").select("value", "print")
    of = texts.groupBy("value").agg(F.xxhash64(F.count("*"), F.bit_xor("print"), F.bit_xor(F.xxhash64("print"))).alias("class"))
    classes = texts.join(of, "value").select("print", "class").distinct()
    pairs = near.where("n < beside").join(classes, "print").groupBy("class", "term").agg(F.first("rows").alias("rows"), F.sum("n").alias("n"))
    every = alone.unionAll(pairs.select("term", "rows", "n")).groupBy("term").agg((F.max("n") / (F.first("rows") + prior)).alias("share"))
    return stored(every.where(F.col("share") >= disclosing))


@any_columns("text")
def sanitised(docs: DataFrame, text: str = "text", removing: float = 0.9, block_terms: int = 1_000_000, **settings) -> DataFrame:
    """docs with the counts of each kind, base and spans (code points, sorted by kind as listed, then start) and the sanitised text."""
    docs = docs.drop(*COLUMNS)
    terms = disclosing_terms(docs.select(F.col(text).alias("text")), **settings)
    total, sc = terms.count(), docs.sparkSession.sparkContext
    blocks = max(1, -(-total // block_terms))
    out = docs
    for k in range(blocks):
        here = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).toArrow()  # about block_terms rows
        term = A.unsigned(here.column("term").to_numpy())
        order = np.argsort(term)
        out = _pass(out, text, sc.broadcast((term[order], here.column("share").to_numpy()[order] >= removing)), k == 0, k == blocks - 1, docs.schema)
    return out


def _pass(docs, text, sent, is_first, is_last, plain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gone = sent.value
        lookup = Lookup(known)
        for part, texts in A.blocks(batches, text):
            f = Found(texts)
            w, free = f.words, f.free()
            place, rank = lookup(w.hashes())
            held = [[] for _ in texts] if is_first else [[tuple(x) for x in v] for v in part.column(part.num_columns - 1).to_pylist()]
            for p, r in zip(place[free[place]].tolist(), rank[free[place]].tolist(), strict=True):
                d = int(w.doc[p])
                held[d].append((int(w.start[p] - w.offset[d]), int(w.end[p] - w.offset[d]), int(gone[r])))
            columns = part.columns if is_first else part.columns[:-1]
            if not is_last:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([[list(x) for x in v] for v in held], pa.list_(pa.list_(pa.int32())))], names=[*plain.names, "_pd_terms"])
                continue
            null = part.column(part.schema.get_field_index(text)).is_null().to_pylist()
            base, every, clean = [], [], []
            for d, raw in enumerate(texts):
                spans = sorted((k, f.point(d, a), KINDS[k], f.point(d, b)) for k, a, b in f.base[d])
                base.append([dict(zip(("rank", "start", "kind", "end"), x, strict=True)) for x in spans])
                more = sorted((4, f.point(d, a), "term", f.point(d, b)) for a, b, _ in held[d])
                every.append(base[-1] + [dict(zip(("rank", "start", "kind", "end"), x, strict=True)) for x in more])
                clean.append(None if null[d] else _rewritten(raw, f.base[d], held[d]))
            kind = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            counts = [pa.array([sum(x["rank"] == k for x in v) for v in every], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, *counts, pa.array(base, kind), pa.array(every, kind), pa.array(clean, pa.binary()).cast(pa.string())], names=[*plain.names, *COLUMNS])

    more = dict(zip(COLUMNS, (*["long"] * 5, SPAN, SPAN, "string"), strict=True)) if is_last else {"_pd_terms": "array<array<int>>"}
    return docs.mapInArrow(run, extended(plain, **more))


def _rewritten(raw: bytes, base: list[tuple[int, int, int]], terms: list[tuple[int, int, int]]) -> bytes:
    """The text with base spans named by kind (overlapping ones as the first), terms generalised or removed."""
    out, at = [], 0
    marks = sorted([(a, b, f"<{KINDS[k].upper()}>".encode()) for k, a, b in base] + [(a, b, b"" if gone else b"<TERM>") for a, b, gone in terms])
    for a, b, name in marks:
        if a >= at:
            out += [raw[at:a], name]
        at = max(at, b)
    return b"".join([*out, raw[at:]])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitised(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_term")
