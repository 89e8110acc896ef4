"""Palette operators: counts, merging of near colours, background, membership and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrel.functions.scalars import parse_hex_color, rgb_to_hex

KEY = "image_id"


def palette(pixels: DataFrame, key: str = KEY) -> DataFrame:
    """(key, ix int, r, g, b int, hex string, n long): colours by descending pixel count, ties by value."""
    counts = pixels.groupBy(key, "r", "g", "b").agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "r", "g", "b")
    return counts.select(key, (F.row_number().over(order) - 1).cast("int").alias("ix"), "r", "g", "b", rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "n")


def merge_similar(colours: DataFrame, distance: float = 28.0, key: str = KEY) -> DataFrame:
    """(key, ix, cluster int): the smallest ix that each colour reaches over pairs within `distance` in RGB.

    A palette is small by its maximum of colours, so its pairs are; labels spread until none changes, each round one
    aggregation over all images at once."""
    c = F.col
    other = colours.select(key, *[c(x).alias("o" + x) for x in ("ix", "r", "g", "b")])
    square = sum((c(x) - c("o" + x)) * (c(x) - c("o" + x)) for x in ("r", "g", "b"))
    near = colours.join(other, key).where(square <= distance * distance).groupBy(key, "ix").agg(F.collect_set("oix").alias("near"))
    grouped = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ix", "near"))).alias("sets"))
    # Within an image: fold the neighbourhoods into clusters, a handful of small sets.
    start = F.array().cast("array<array<int>>")
    def fold(clusters: Column, s: Column) -> Column:
        touching = F.filter(clusters, lambda x: F.arrays_overlap(x, s["near"]))
        rest = F.filter(clusters, lambda x: ~F.arrays_overlap(x, s["near"]))
        return F.concat(rest, F.array(F.array_distinct(F.concat(s["near"], F.flatten(touching)))))
    clusters = grouped.select(key, F.explode(F.aggregate("sets", start, fold)).alias("members"))
    return clusters.select(key, F.array_min("members").alias("cluster"), F.explode("members").alias("ix")).select(key, "ix", "cluster")


def merged_palette(colours: DataFrame, distance: float = 28.0, key: str = KEY) -> DataFrame:
    """(key, ix, r, g, b, n): each cluster's mean colour, weighted and rounded half to even, by descending count."""
    c = F.col
    joined = colours.join(merge_similar(colours, distance, key), [key, "ix"])
    mean = lambda x: F.bround(F.sum(c(x) * c("n")).cast("double") / F.sum("n")).cast("int").alias(x)
    got = joined.groupBy(key, "cluster").agg(mean("r"), mean("g"), mean("b"), F.sum("n").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "cluster")
    return got.select(key, (F.row_number().over(order) - 1).cast("int").alias("ix"), "r", "g", "b", "n")


def labels(pixels: DataFrame, colours: DataFrame, key: str = KEY) -> DataFrame:
    """pixels with `label`, the ix of their colour."""
    return pixels.join(colours.select(key, "r", "g", "b", F.col("ix").alias("label")), [key, "r", "g", "b"])


def background(labelled: DataFrame, key: str = KEY, least: float = 0.35) -> DataFrame:
    """(key, background int, support double): the commonest label of the four edges, corners counted twice, the lower
    label of equals; null below the least support."""
    c = F.col
    size = labelled.groupBy(key).agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    sides = (c("y") == 0).cast("int") + (c("y") == c("my")).cast("int") + (c("x") == 0).cast("int") + (c("x") == c("mx")).cast("int")
    edge = labelled.join(size, key).withColumn("times", sides).where("times > 0")
    votes = edge.groupBy(key, "label").agg(F.sum("times").alias("v"))
    best = votes.groupBy(key).agg(F.max(F.struct("v", (-c("label")).alias("l"))).alias("b"), F.sum("v").alias("all"))
    support = c("b.v") / c("all")
    return best.select(key, F.when(support >= least, -c("b.l")).cast("int").alias("background"), support.alias("support"))


def edge_colours(pixels: DataFrame, size: tuple[int, int], key: str = KEY) -> DataFrame:
    """palette() with `votes` long: how often a colour stands on the four edges of images of one size, corners counted twice.

    One aggregation, so that no pixel is joined with its colour."""
    c = F.col
    sides = sum((c(n) == at).cast("int") for n, length in zip(("x", "y"), size, strict=True) for at in (0, length - 1))
    counts = pixels.groupBy(key, "r", "g", "b").agg(F.count("*").alias("n"), F.sum(sides).alias("votes"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "r", "g", "b")
    return counts.select(key, (F.row_number().over(order) - 1).cast("int").alias("ix"), "r", "g", "b", rgb_to_hex(c("r"), c("g"), c("b")).alias("hex"), "n", "votes")


def background_of(colours: DataFrame, key: str = KEY, least: float = 0.35) -> DataFrame:
    """background() from edge_colours()."""
    c = F.col
    best = colours.where("votes > 0").groupBy(key).agg(F.max(F.struct("votes", (-c("ix")).alias("l"))).alias("b"), F.sum("votes").alias("all"))
    support = c("b.votes") / c("all")
    return best.select(key, F.when(support >= least, -c("b.l")).cast("int").alias("background"), support.alias("support"))


def nearest_colour(colours: DataFrame, text: str, key: str = KEY) -> DataFrame:
    """(key, background int): the colour nearest to a given one, the lower ix of equals."""
    c = F.col
    want = parse_hex_color(F.lit(text))
    square = sum((c(x) - want[x]) * (c(x) - want[x]) for x in ("r", "g", "b"))
    return colours.groupBy(key).agg(F.min_by("ix", F.struct(square, c("ix"))).alias("background"))


def colour_membership(colours: DataFrame, label: int, key: str = KEY) -> DataFrame:
    """(key, ix, member double) of every colour: nearest other distance over own plus nearest other; 1 with no other colour.

    A pixel's membership is its colour's, so this works on palettes alone."""
    c = F.col
    far = lambda p: F.sqrt(((c("r") - p["r"]) * (c("r") - p["r"]) + (c("g") - p["g"]) * (c("g") - p["g"]) + (c("b") - p["b"]) * (c("b") - p["b"])).cast("double"))
    held = colours.groupBy(key).agg(F.collect_list(F.struct("ix", "r", "g", "b")).alias("colours"))
    got = held.select(key, "colours", F.explode("colours").alias("p")).select(key, "colours", "p.*")
    own = F.array_min(F.transform(F.filter("colours", lambda p: p["ix"] == label), far))
    other = F.array_min(F.transform(F.filter("colours", lambda p: p["ix"] != label), far))
    got = got.select(key, "ix", own.alias("own"), other.alias("other"))
    return got.select(key, "ix", F.when(c("other").isNull(), 1.0).otherwise(F.coalesce(c("other") / F.nullif(c("own") + c("other"), F.lit(0.0)), F.lit(0.0))).alias("member"))


def membership(labelled: DataFrame, colours: DataFrame, label: int, key: str = KEY) -> DataFrame:
    """labelled with `member` double, that of its colour; a palette's few rows are joined back by label."""
    return labelled.join(colour_membership(colours, label, key).withColumnRenamed("ix", "label"), [key, "label"])


def layers(colours: DataFrame, ground: DataFrame, key: str = KEY) -> DataFrame:
    """(key, layer_id, z int, ix, hex, n): a layer for each colour but the background, by descending count."""
    return _layers(colours.join(ground, key), key)


def layers_of(colours: DataFrame, key: str = KEY, least: float = 0.35) -> DataFrame:
    """layers() from edge_colours(), whose rows of an image choose the background among themselves."""
    c = F.col
    whole = Window.partitionBy(key)
    best = F.max(F.when(c("votes") > 0, F.struct("votes", (-c("ix")).alias("l")))).over(whole)
    rows = colours.withColumn("b", best).withColumn("all", F.sum("votes").over(whole)).where("b is not null")
    return _layers(rows.withColumn("background", F.when(c("b.votes") / c("all") >= least, -c("b.l")).cast("int")), key)


def _layers(rows: DataFrame, key: str) -> DataFrame:
    c = F.col
    rest = rows.where(c("background").isNull() | (c("ix") != c("background")))
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "ix")) - 1
    return rest.select(key, order.cast("int").alias("z"), "ix", "hex", "n").select(key, F.format_string("layer_%02d_%s", "z", F.substring("hex", 2, 6)).alias("layer_id"), "z", "ix", "hex", "n")
