"""Transitive closure of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut


def transitive_closure(edges: DataFrame, starts: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(s, o) for each o that one or more edges lead to from s; cycles end, as only pairs not seen before go on.

    starts: if given, (s) to begin at, so only what they reach is followed: each
    round joins the frontier with the edges and drops pairs already known. The
    whole closure joins what is known with itself, so the rounds are logarithmic in the
    longest path. Lineage is cut as it goes, so plans stay small on deep graphs.
    """
    edges = edges.select("s", "o").distinct()
    frontier = edges if starts is None else edges.join(starts.select("s").distinct(), "s", "left_semi")
    known = frontier = cut(frontier)
    doubling = starts is None and most is None
    rounds = 1
    while (most is None or rounds < most) and not frontier.isEmpty():
        # Without bounds both halves of a path may be long, so lengths double each round.
        step = (known if doubling else edges).select(F.col("s").alias("m"), F.col("o").alias("next"))
        new = (known if doubling else frontier).join(step, F.col("o") == F.col("m")).select("s", F.col("next").alias("o")).distinct()
        frontier = cut(new.join(known, ["s", "o"], "left_anti"))
        known = known.unionByName(frontier)
        rounds += 1
        if rounds % 4 == 0:
            known = cut(known)
    return known
