"""Mixing sources to target weights by entropy balancing.  DataFrame operations only.

Each source has a target in words.  Of all document rates r with
0 <= r <= ``max_repeats`` whose words meet the targets, the ones closest to
taking each document once (in relative entropy) are exponentially tilted:
r = min(max_repeats, exp(tilt * size / mean size)), one tilt a source.  The tilt solves a
convex dual in one variable for each source; all sources take their Newton steps
together, each step one aggregation of a histogram (source, size, documents),
kept between brackets so that it cannot diverge.

Rates become whole copies by floor(r + u) with u a hash of the id and the text, so
reruns agree.  A common factor of each source is then probed on a grid, twice,
so that the words really taken meet the target, and last single documents whose
size is nearest what is still missing (or too much) gain or lose a copy.

Edge cases: a null source is a source of its own, the last in order; a null or
empty text has size 0 and takes nothing; a source whose target is its largest
takes every document ``max_repeats`` times; equal rows get equal copies, and
only documents with an id are adjusted singly; a very long text is one document that its source's target
may miss by; no rows give no rows; columns of docs named like an output are replaced.

The table of sources is ordered and summed up in one task: it has a row of five numbers for each source, so millions of sources fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import any_columns, documents, joined_small, stored

WORD = r"[^\x20\x09-\x0D]+"
COLUMNS = ("size", "source_size", "target", "copies", "taken")
STEPS, TOLERANCE, PROBES, FLIPS = 40, 1e-7, 16, 4


def _prepared(docs: DataFrame, text: str, source: str, id_: str) -> DataFrame:
    return docs.withColumns({
        "_mx_key": F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))),
        "_mx_size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
        "_mx_id": F.col(id_).cast("long"),
        "_mx_u": F.pmod(F.xxhash64(F.col(id_), F.col(text)), F.lit(1 << 40)) / F.lit(float(1 << 40)),
    })


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(_mx_key, source_size, mean, target). sizes: _mx_key, source_size, n, for each source.

    A target is its weight's share of all words, at most max_repeats times the
    source's size, the excess shared again by weight: min(cap, weight * level)
    for the one level at which the targets add up.  The table has a row a source.
    """
    in_order = Window.orderBy((F.col("_mx_key") == "n").asc(), F.col("_mx_key").asc())
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumns({"weight": F.element_at(F.lit(list(weights)), (place + 1).cast("int")).cast("double"), "cap": F.col("source_size") * float(max_repeats)})
    full = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "_mx_key")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    # The level if exactly the sources before this one are full; it is the one as soon as this source is not.
    found = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    chosen = F.coalesce(F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "_mx_key", "level"))).over(everything)["level"], F.lit(float("inf")))
    return found.withColumn("target", F.least("cap", chosen * F.col("weight"))).select("_mx_key", "source_size", (F.col("source_size") / F.greatest(F.col("n"), F.lit(1))).alias("mean"), "target")


def _rate(tilt: Column, size: Column, mean: Column, max_repeats: int, factor: Column | None = None) -> Column:
    log = tilt * size / F.greatest(mean, F.lit(1e-9))
    rate = F.exp(F.least(log, F.lit(50.0)))
    return F.least(F.lit(float(max_repeats)), rate if factor is None else rate * factor)


def tilts(histogram: DataFrame, aims: DataFrame, max_repeats: int = 3) -> DataFrame:
    """aims with the tilt of each source: Newton's method on all sources at once. histogram: _mx_key, _mx_size, n."""
    full = F.col("target") >= F.col("source_size") * float(max_repeats) * (1 - 1e-12)
    state = aims.withColumns({"tilt": F.when(full, F.lit(1e6)).otherwise(F.lit(0.0)), "lo": F.lit(-1e4), "hi": F.lit(1e4), "done": full})
    state = stored(state)
    for _ in range(STEPS):
        size, mean = F.col("_mx_size"), F.col("mean")
        rate = _rate(F.col("tilt"), size, mean, max_repeats)
        free = rate < max_repeats
        sums = joined_small(histogram, state, ["_mx_key"], "inner").groupBy(*state.columns).agg(
            F.sum(F.col("n") * size * rate).alias("words"), F.sum(F.when(free, F.col("n") * size * size * rate / F.greatest(mean, F.lit(1e-9))).otherwise(0.0)).alias("slope"))
        over = F.col("words") - F.col("target")
        lo, hi = F.when(over < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(over > 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") - over / F.nullif(F.col("slope"), F.lit(0.0))
        # A step that leaves the bracket is replaced by its middle, on a scale that is fine near zero.
        middle = F.sinh((F.asinh(lo) + F.asinh(hi)) / 2)
        step = F.when((newton > lo) & (newton < hi), newton).otherwise(middle)
        done = F.col("done") | (F.abs(over) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
        state = stored(sums.select(*aims.columns, F.when(done, F.col("tilt")).otherwise(step).alias("tilt"), lo.alias("lo"), hi.alias("hi"), done.alias("done")))
        if not state.where("not done").limit(1).count():
            break
    return state.select(*aims.columns, "tilt")


def _copies(max_repeats: int, factor: Column) -> Column:
    rate = _rate(F.col("tilt"), F.col("_mx_size"), F.col("mean"), max_repeats, factor)
    return F.least(F.lit(max_repeats), F.floor(rate + F.col("_mx_u"))).cast("long")


@any_columns("text", "source", "id_")
def mixed(docs: DataFrame, text: str = "text", source: str = "source", id_: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """docs with size, source_size, target (words of its source), copies and taken (copies * size)."""
    docs = docs.drop(*COLUMNS)
    rows = stored(_prepared(docs.select(text, source, id_), text, source, id_).groupBy("_mx_key", "_mx_id", "_mx_u", "_mx_size").agg(F.count("*").alias("n")))
    histogram = stored(rows.groupBy("_mx_key", "_mx_size").agg(F.sum("n").alias("n")))
    aims = targets(histogram.groupBy("_mx_key").agg(F.sum(F.col("_mx_size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")), weights, max_repeats)
    state = stored(tilts(histogram, aims, max_repeats).withColumn("factor", F.lit(1.0)))
    mass = F.col("_mx_size") * F.col("n")
    for width in (0.5, 0.5 / PROBES):
        # At each probed factor the words really taken; the nearest to the target is kept.
        probes = [F.col("factor") * F.exp(F.lit(width * k / PROBES)) for k in range(-PROBES, PROBES + 1)]
        taken = joined_small(rows, state, ["_mx_key"], "inner").groupBy(*state.columns).agg(*(F.sum(_copies(max_repeats, p) * mass).alias(f"p{k}") for k, p in enumerate(probes)))
        best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"p{k}") - F.col("target")), F.abs(F.lit(k - PROBES)), p) for k, p in enumerate(probes))))
        state = stored(taken.withColumn("factor", best["col3"]).select(*state.columns))
    flips = None
    for _ in range(FLIPS):
        now = joined_small(rows, state, ["_mx_key"], "inner").withColumn("copies", _copies(max_repeats, F.col("factor")))
        if flips is not None:
            now = joined_small(now, flips, ["_mx_key", "_mx_id", "_mx_u"], "left").withColumn("copies", F.col("copies") + F.coalesce("flip", F.lit(0))).withColumn("flipped", F.col("flip").isNotNull()).drop("flip")
        else:
            now = now.withColumn("flipped", F.lit(False))
        short = stored(now.groupBy("_mx_key", "target").agg(F.sum(F.col("copies") * mass).alias("words")).select("_mx_key", (F.col("target") - F.col("words")).alias("short")))
        here = joined_small(now, short, ["_mx_key"], "inner")
        able = F.when(F.col("short") > 0, F.col("copies") < max_repeats).otherwise(F.col("copies") > 0) & F.col("_mx_id").isNotNull() & ~F.col("flipped")
        left = F.abs(F.abs(F.col("short")) - mass)
        pick = F.min(F.when(able & (left < F.abs(F.col("short"))), F.struct(left.alias("left"), F.col("_mx_id"), F.col("_mx_u")))).alias("pick")
        new = here.groupBy("_mx_key", "short").agg(pick).where("pick is not null").select("_mx_key", "pick._mx_id", "pick._mx_u", F.when(F.col("short") > 0, 1).otherwise(-1).cast("long").alias("flip"))
        flips = stored(new if flips is None else flips.unionAll(new))
    out = joined_small(_prepared(docs, text, source, id_), state, ["_mx_key"], "inner")
    out = joined_small(out, flips, ["_mx_key", "_mx_id", "_mx_u"], "left")
    copies = _copies(max_repeats, F.col("factor")) + F.coalesce("flip", F.lit(0))
    return out.withColumn("copies", copies).select(*docs.columns, F.col("_mx_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_mx_size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")
