"""Secret scan: patterns, and two character Markov models compared.  DataFrame operations only.

Base patterns (assign, access, hex) give the first spans.  The method adds
spans of kind ``model``: stretches within runs of 12 or more token characters (``TOKEN``) that a bigram model of random
strings explains better than one of ordinary identifiers, by a total
log-likelihood ratio above ``threshold``.  A stretch starts where the running total was last 0 and ends at its
peak, once the total falls to 0 or by more than ``threshold``, so a key inside a path or
identifier is found by itself; base spans divide a run.  Stretches without a letter are numbers or rules and are left out.

Both models are trained from labelled samples of this corpus: values that the
base patterns found are random strings, words in which no pattern matched are ordinary
(all lower-case, capitalised or upper-case letters, or parts joined by _ or -).
Each sample is of a documented bound: the ``sample`` texts with and without matches that come first by a
hash; everything else reads all texts.  The models are one table of 67 x 67
log ratios, sent as a literal, so scoring needs no join.

Edge cases: a null text is empty; overlapping base spans of different kinds
all stay, added ones never overlap base ones; without matches in
the corpus there is no model and nothing is added; equal rows give equal rows; a very long text is read by one task in time
proportional to its length (times its number of spans, for runs beside them);
no rows give no rows; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import any_columns, documents, stored

#: The patterns of the base kinds; assign and hex matches are then held to the least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12
TOKEN = r"[A-Za-z0-9+/_=-]{12,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
COLUMNS = ("n_assign", "n_access", "n_hex", "n_model", "base", "spans")
SAMPLE = 2000
#: Nats in all: odds of more than 500,000 to 1.
THRESHOLD = 13.3
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(text: Column, pattern: str, rank: int, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as spans: a match starts where the pieces and matches before it end."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found

    def step(acc: Column, at: Column) -> Column:
        start = acc["at"] + F.length(at["piece"])
        end = start + F.length(at["found"])
        span = F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(F.length(at["value"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # Zipped, each array is made once; an array read by its index in a lambda would be made for each match.
    zipped = F.filter(F.arrays_zip(found.alias("found"), pieces.alias("piece"), values.alias("value")), lambda x: x["found"].isNotNull())
    none = F.array().cast(SPAN)
    every = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    # Most texts have no match: they are searched once and not split.
    return F.when(F.regexp_like(text, F.lit(pattern)), every).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.concat(_spans(text, ASSIGN, 0, "assign", 2, LEAST_VALUE), _spans(text, ACCESS, 1, "access"), _spans(text, HEX, 2, "hex"))


def _samples(texts: DataFrame, sample: int) -> DataFrame:
    """(token, secret) labelled strings of a bounded sample of different texts. texts: text.

    Hashes alone are sorted for the sample; then only the texts below the last hash
    taken are read out, one of each, so no task gathers more than the sample.
    """
    h = F.xxhash64("text")
    light = stored(texts.select(h.alias("h"), (F.size(base_spans(F.col("text"))) > 0).alias("has")).groupBy("h").agg(F.max("has").alias("has")))
    parts = []
    for has in (True, False):
        last = light.where(F.col("has") == has).select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        chosen = texts.where(h <= F.lit(last if last is not None else -(1 << 63))).groupBy(h.alias("h")).agg(F.first("text").alias("text"))
        chosen = chosen.withColumn("base", base_spans(F.col("text")))
        parts.append(chosen.where(F.size("base") > 0 if has else F.size("base") == 0))
    secret = parts[0].select(F.explode("base").alias("s"), "text").select(
        F.regexp_extract(F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), r"([A-Za-z0-9+/_=-]+)$", 1).alias("token"), F.lit(1).alias("secret"))
    # Patterns repeat single classes only: a repeated group takes a stack frame for each part of a long identifier.
    whole = parts[1].select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_-])[A-Za-z_-]{3,}+(?![0-9])"), F.lit(0))).alias("token"), F.lit(0).alias("secret"))
    ordinary = whole.where(F.forall(F.split("token", "[_-]"), lambda x: x.rlike("^(?:[A-Z]?[a-z]+|[A-Z]+)$")))
    return secret.unionAll(ordinary).where(F.length("token") >= 3)


def model(texts: DataFrame, sample: int = SAMPLE) -> list[float] | None:
    """Log ratios by (first, second) character, row by row; None if there is nothing to learn from. texts: text."""
    n = len(ALPHABET)
    every = F.split("token", "")  # substr would read the token from its start for each place
    pairs = F.arrays_zip(F.slice(every, 1, F.length("token") - 1).alias("a"), F.slice(every, 2, F.length("token") - 1).alias("b"))
    bigrams = _samples(texts, sample).select("secret", F.explode(pairs).alias("x")).select("secret", F.concat("x.a", "x.b").alias("pair")).groupBy("secret", "pair").count()
    counts = [[[0.5] * n for _ in range(n)] for _ in range(2)]
    seen = [0, 0]
    for r in bigrams.collect():  # at most 2 * 67 * 67 rows
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if min(a, b) >= 0:
            counts[r["secret"]][a][b] += r["count"]
            seen[r["secret"]] += r["count"]
    if not all(seen):
        return None
    # Rare pairs shrink to the overall frequency of their second character.
    out = []
    rates = []
    for c in counts:
        column = [sum(row[b] for row in c) for b in range(n)]
        whole = sum(column)
        rates.append([[(c[a][b] + 20 * column[b] / whole) / (sum(c[a]) + 20) for b in range(n)] for a in range(n)])
    for a in range(n):
        out += [math.log(rates[1][a][b] / rates[0][a][b]) for b in range(n)]
    return out


def _stretches(base: Column, token: Column, start: Column, ratios: list[float], threshold: float) -> Column:
    """The spans within a run (a token and where it starts) whose total log ratio is above the threshold."""
    table, n = F.lit(ratios), len(ALPHABET)
    number = F.lit([ALPHABET.find(chr(k)) + 1 for k in range(1, 128)])
    codes = F.transform(F.split(token, ""), lambda c: F.element_at(number, F.ascii(c)))
    pairs = F.arrays_zip(F.slice(codes, 1, F.size(codes) - 1).alias("a"), F.slice(codes, 2, F.size(codes) - 1).alias("b"))

    def ratio(p: Column, k: Column) -> Column:
        at = start + k
        blocked = F.exists(base, lambda b: (b["start"] < at + 2) & (at < b["end"]))
        return F.struct(at.cast("int").alias("at"), F.when(blocked, F.lit(-1e9)).otherwise(F.element_at(table, (p["a"] - 1) * n + p["b"])).alias("ratio"))

    def ended(acc: Column) -> Column:
        span = F.struct(acc["start"].alias("start"), F.lit(3).alias("rank"), F.lit("model").alias("kind"), acc["end"].alias("end"))
        return F.when(acc["peak"] > threshold, F.array_append(acc["out"], span)).otherwise(acc["out"])

    def step(acc: Column, p: Column) -> Column:
        now, after = acc["now"] + p["ratio"], (p["at"] + 1).cast("int")
        done = (now <= 0) | (acc["peak"] - now > threshold)
        fresh = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("peak"), after.alias("start"), after.alias("end"), ended(acc).alias("out"))
        end = F.when(now > acc["peak"], (p["at"] + 2).cast("int")).otherwise(acc["end"])
        return F.when(done, fresh).otherwise(F.struct(now.alias("now"), F.greatest(acc["peak"], now).alias("peak"), acc["start"].alias("start"), end.alias("end"), acc["out"].alias("out")))

    first = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("peak"), start.alias("start"), start.alias("end"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(F.transform(pairs, ratio), first, step, ended)


def _added(text: Column, base: Column, ratios: list[float] | None, threshold: float) -> Column:
    if ratios is None:
        return F.array().cast(SPAN)
    # Each array is made once: a text can hold thousands of runs.
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("token"), F.split(text, TOKEN, -1).alias("piece"))
    runs = F.transform(F.filter(zipped, lambda x: x["token"].isNotNull()), lambda x: F.struct(x["token"].alias("token"), F.length(x["piece"]).alias("gap"), F.length(x["token"]).alias("size")))

    def step(acc: Column, run: Column) -> Column:
        start = acc["at"] + run["gap"]
        return F.struct((start + run["size"]).alias("at"), acc["base"].alias("base"), F.concat(acc["out"], _stretches(acc["base"], run["token"], start, ratios, threshold)).alias("out"))

    none = F.array().cast(SPAN)
    first = F.struct(F.lit(0).alias("at"), base.alias("base"), none.alias("out"))
    found = F.aggregate(runs, first, step, lambda acc: acc["out"])
    every = F.when(F.regexp_like(text, F.lit(TOKEN)), found).otherwise(none)
    return F.filter(every, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"]).rlike("[A-Za-z]"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@any_columns("text")
def scanned(docs: DataFrame, text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the counts of each kind, base (the base spans) and spans (all), sorted by start, then kind as listed. No shuffle of texts."""
    docs = docs.drop(*COLUMNS)
    body = F.coalesce(F.col(text), F.lit(""))
    ratios = model(docs.select(body.alias("text")), sample)
    read = docs.withColumn("_se_text", body).withColumn("_se_base", base_spans(F.col("_se_text")))
    read = read.withColumn("_se_more", _added(F.col("_se_text"), F.col("_se_base"), ratios, threshold))
    count = lambda kind: F.size(F.filter("_se_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return read.select(*docs.columns, count("assign"), count("access"), count("hex"), F.size("_se_more").cast("long").alias("n_model"), F.sort_array("_se_base").alias("base"), F.sort_array(F.concat("_se_base", "_se_more")).alias("spans"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_model")
