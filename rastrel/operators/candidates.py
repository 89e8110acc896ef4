"""Shape candidates: thresholds by kind and the best candidate of each contour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order that breaks ties, with the least confidence of each.
KINDS = (("circle", 0.90), ("ellipse", 0.88), ("rounded_rectangle", 0.84), ("isosceles_triangle", 0.84), ("star", 0.86), ("dshape", 0.82))
#: Kinds that a hole may have.
HOLE_KINDS = ("circle", "ellipse", "rounded_rectangle")


def best(candidates: DataFrame, contours: DataFrame, key: str) -> DataFrame:
    """(key, kind, confidence): of each contour's candidates (key, kind, confidence) that reach their kind's
    threshold, the surest, the first kind of equals; freeform at 1.0 for contours without one.

    contours: key and is_hole, null as for a hole. Both tables go into one aggregation, combined before the shuffle, so that
    neither is joined or broadcast; candidates of keys that contours doesn't have are dropped, and a null key has none."""
    c = F.col
    kind = dict(candidates.dtypes)[key]
    rank = F.create_map(*[x for k, (name, _) in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    least = F.create_map(*[x for name, t in KINDS for x in (F.lit(name), F.lit(t))])
    sure = candidates.where(c(key).isNotNull() & (c("confidence") >= least[c("kind")]))
    sure = sure.select(key, F.struct("confidence", (-rank[c("kind")]).alias("o"), "kind").alias("b"))
    own = contours.select(c(key).cast(kind).alias(key), F.lit(True).alias("known"), (~c("is_hole")).alias("outer"))
    rows = sure.unionByName(own, allowMissingColumns=True)
    top = rows.groupBy(key).agg(F.max("b").alias("any"), F.max(F.when(c("b.kind").isin(*HOLE_KINDS), c("b"))).alias("hole"), F.max("known").alias("known"), F.max("outer").alias("outer"))
    top = top.where("known").select(key, F.when(c("outer"), c("any")).otherwise(c("hole")).alias("b"))
    return top.select(key, F.coalesce("b.kind", F.lit("freeform")).alias("kind"), F.coalesce("b.confidence", F.lit(1.0)).alias("confidence"))
