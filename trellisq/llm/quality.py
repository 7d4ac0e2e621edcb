"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose feature is above a cutoff.  The cutoffs are
learned for each stratum (language): labelled documents are split by a hash of
their id into a half that selects and a half that certifies.  A cutoff may be
used only if the exact (Clopper-Pearson) upper bound of the share of good
documents it rejects, on the certifying half, is at most the rule's part of
``max_false_rejection``.  Cutoffs are tested from the loosest on and testing
stops at the first failure (fixed-sequence testing, which needs no correction
within a rule); across strata and rules the error rate is split evenly
(Bonferroni).  Of the certified cutoffs the selecting half chooses.

Edge cases: a null text has no words and fails the base rule; a null stratum is
a stratum of its own; labels without a quality, an id or a document are ignored
and an id labelled twice counts as good only if all its labels are; a stratum
with too few labels to certify anything gets no cutoffs, so only the base rule
rejects there; repeated rows each count where their id is labelled; very long texts are blocks of their own;
no labels or no documents give no cutoffs; columns of docs named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .shared import documents, extended, stored

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters")
PREFIX = "quality_"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
GRID = 200


@dataclass(frozen=True)
class Settings:
    min_words: int = 10
    max_repeat_percent: int = 20
    max_false_rejection: float = 0.05
    error_rate: float = 0.05
    #: A good document wrongly rejected weighs as much as this many bad ones rightly rejected.
    good_weight: int = 10


def rules(column=F.col) -> dict[str, Column]:
    """The rules' features, each a share from 0 to 1."""
    c = lambda name: column(PREFIX + name)
    share = lambda a, b: F.least(F.lit(1.0), F.coalesce(c(a) / F.nullif(c(b), F.lit(0)), F.lit(0.0)))
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "n_letters")}


def _repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (doc, key) occurs again, and whether it is a later occurrence."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    equal = np.zeros(len(order), bool)
    equal[1:] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    either = equal.copy()
    either[:-1] |= equal[1:]
    some, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    some[order], later[order] = either, equal
    return some, later


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The features of each text of a block."""
    w, n = A.Words(texts), len(texts)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.offset])
    out = {"n_words": np.diff(w.first), "n_symbols": total(_SYMBOL[w.raw]), "n_capitals": total(_CAPITAL[w.raw]), "n_letters": total(_LETTER[w.raw])}
    out["word_chars"] = total(((w.raw & 0xC0) != 0x80) & ~A.SPACE[w.raw])
    # Lines: from a text's start or a newline to the next newline or the text's end.
    newline = np.flatnonzero(w.raw == 10)
    start = np.sort(np.concatenate([w.offset[:-1], newline + 1]))
    end = np.sort(np.concatenate([w.offset[1:] - 1, newline]))
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[worded], end[worded]
    line_doc = np.searchsorted(w.offset, start, side="right") - 1
    _, later = _repeated(line_doc, A.mix(A.range_hashes(w.raw, start, end) + (end - start).astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    at = w.whole(5)
    some, _ = _repeated(w.doc[at], w.windows(w.hashes(), 5)[at] if len(at) else np.zeros(0, np.uint64))
    covered = np.zeros(len(w) + 1, np.int64)
    np.add.at(covered, at[some], 1)
    np.add.at(covered, at[some] + 5, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns ``quality_*``; columns of docs by these names are replaced. No shuffle."""
    names = [PREFIX + x for x in FEATURES]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in A.blocks(batches, text):
            got = measure(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(got[x].astype(np.int64)) for x in FEATURES)], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, extended(docs.schema, **dict.fromkeys(names, "long")))


def base_failed(s: Settings = Settings()) -> Column:
    n = F.col(PREFIX + "n_words")
    return (n < s.min_words) | (100 * F.col(PREFIX + "n_repeat_words") > s.max_repeat_percent * n)


def most_bad(n: int, rate: float, error: float) -> int:
    """The most bad ones of n for which the exact upper bound of their rate is at most ``rate``; -1 if not even none is enough.

    The bound is at most ``rate`` just if so few bad ones have a probability of ``error`` or less at that rate.
    """
    if not 0 < rate < 1 or n < least_labels(rate, error):
        return -1
    i = np.arange(int(n * rate) + 1)  # half of the probability lies below
    ratio = np.log(n - i) - np.log(i + 1) + np.log(rate) - np.log1p(-rate)
    logs = n * np.log1p(-rate) + np.concatenate([[0.0], np.cumsum(ratio)])  # of the probability of i bad ones
    below = np.logaddexp.accumulate(logs)
    return int(np.searchsorted(below, np.log(error), side="right")) - 1


def least_labels(rate: float, error: float) -> int:
    """How many labels it takes to certify a rate at all."""
    return int(np.ceil(np.log(error) / np.log1p(-rate) - 1e-9))


def upper_bound(bad: int, n: int, error: float) -> float:
    """The exact upper confidence bound of a binomial rate: the rate at which ``bad`` or fewer of n have probability ``error``."""
    if bad >= n:
        return 1.0
    from math import exp, lgamma, log, log1p

    def below(p: float) -> float:
        return sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p)) for i in range(bad + 1))

    lo, hi = bad / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0 < mid < 1 and below(mid) > error else (lo, mid)
    return hi


def cutoffs(features: DataFrame, labels: DataFrame, stratum: str = "lang", id_: str = "doc_id", s: Settings = Settings()) -> list[tuple[str | None, str, float]]:
    """(stratum, rule, cutoff) for each rule that is used.

    What reaches the driver is counts by stratum, rule and step of a grid, for those strata whose good labels
    could certify anything: at most one for each hundreds of labels, whatever the stratum column holds.
    """
    good = labels.where(F.col(id_).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_).alias("_id")).agg(F.min("quality").alias("_good"))
    marked = (
        features.where(~base_failed(s))
        .select(F.col(id_).alias("_id"), F.col(stratum).alias("stratum"), F.array(*(F.struct(F.lit(k).alias("rule"), F.ceil(v * GRID).cast("int").alias("step")) for k, v in rules().items())).alias("at"))
        .join(good, "_id")
        .select("stratum", (F.col("_good") > 0).alias("good"), (F.pmod(F.xxhash64("_id"), F.lit(2)) == 0).alias("selects"), F.explode("at").alias("at"))
        .groupBy("stratum", "good", "selects", "at.rule", "at.step")
        .count()
    )
    n_rules, share = len(rules()), s.max_false_rejection / len(rules())
    marked = stored(marked)
    certifies = marked.where("good and not selects").groupBy("stratum", "rule").agg(F.sum("count").alias("labels")).groupBy("stratum").agg(F.max("labels").alias("labels"))
    enough = stored(certifies.where(F.col("labels") >= least_labels(share, s.error_rate / n_rules)).select(F.col("stratum").alias("_stratum")))
    marked = marked.join(enough, F.col("stratum").eqNullSafe(F.col("_stratum")), "left_semi")
    counts: dict[tuple, np.ndarray] = {}
    for r in marked.toLocalIterator():
        counts.setdefault((r["stratum"], r["rule"]), np.zeros((2, 2, GRID + 1), np.int64))[int(r["good"]), int(r["selects"]), r["step"]] += r["count"]
    out = []
    n_tests = max(1, len(counts))
    for (where, rule), n in sorted(counts.items(), key=lambda x: (x[0][0] is None, x[0][0] or "", x[0][1])):
        certify, best, gain = n[1, 0], None, 0
        most = most_bad(int(certify.sum()), share, s.error_rate / n_tests)
        for step in range(GRID, -1, -1):  # rejects what is above the step
            if certify[step + 1 :].sum() > most:
                break
            now = int(n[0, 1, step + 1 :].sum()) - s.good_weight * int(n[1, 1, step + 1 :].sum())
            if now > gain:
                best, gain = step, now
        if best is not None:
            out.append((where, rule, best / GRID))
    return out


def kept_column(cuts: list[tuple[str | None, str, float]], stratum: str = "lang", s: Settings = Settings()) -> Column:
    """The verdict as an expression over the features; there are few cutoffs, as each needs hundreds of labels of its stratum."""
    values = rules()
    rejected = F.lit(False)
    for where, rule, cut in cuts:
        rejected = rejected | (F.col(stratum).eqNullSafe(F.lit(where)) & (F.ceil(values[rule] * GRID) > round(cut * GRID)))
    return ~base_failed(s) & ~rejected


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", stratum: str = "lang", id_: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """docs with their features, ``base_failed`` and ``kept``."""
    learned = cutoffs(with_features(docs.select(id_, text, stratum), text).drop(text), labels, stratum, id_, s)
    return with_features(docs.drop("base_failed", "kept"), text).withColumns({"base_failed": base_failed(s), "kept": kept_column(learned, stratum, s)})


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stored(with_features(documents(spark, sf_dir).select("doc_id", "text", "lang")).drop("text"))
    learned = cutoffs(features, documents(spark, sf_dir, "labels"))
    return features.select("doc_id", *(F.col(PREFIX + x).alias(x) for x in FEATURES[:5]), base_failed().alias("base_failed"), kept_column(learned).alias("kept"))
