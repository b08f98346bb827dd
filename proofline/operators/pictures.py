"""Measured contrast of parts of pictures that come as tables of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import INK_PERCENTILE, PAPER_PERCENTILE, WHOLE_LABEL
from ..functions.contrast import crop, ratio_of, relative_luminance, to_hex
from ..sources.shared import write_shared


#: Equal parts of a group's range of values that are counted before any values are looked at one by one.
PARTS = 65_536


def at_rank(counts: DataFrame, keys: list[str], value: str, rank: Column) -> DataFrame:
    """The rows of counts in which a rank, from 0, falls when they are laid end to end by value; `rank` becomes the rank within."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"before": before, "wanted": rank})
    return placed.where((F.col("before") <= F.col("wanted")) & (F.col("wanted") < F.col("before") + F.col("n"))).withColumn("rank", F.col("wanted") - F.col("before")).drop("before", "wanted", "n")


def _selected(rows: DataFrame, value: str) -> DataFrame:
    """The rows of each (group, pick) that have the value at its `rank`, which becomes the rank among these; no group is sorted.

    First the part of the range in which the rank falls, by counts, then the value in it, by counts of equal values.
    """
    keys, v = ["group", "pick"], F.col(value).cast("double")
    ends = rows.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    part = F.when(v.isNull(), -1).when(F.col("high") > F.col("low"), F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * PARTS)).otherwise(0)
    parted = rows.join(ends, keys).withColumns({"part": part, "held": F.struct(value)})  # a struct of a null equals itself
    found = at_rank(parted.groupBy(*keys, "part", "rank").agg(F.count(F.lit(1)).alias("n")), keys, "part", F.col("rank"))
    near = parted.drop("rank").join(found, [*keys, "part"])
    exact = at_rank(near.groupBy(*keys, "held", "rank").agg(F.count(F.lit(1)).alias("n")), keys, "held", F.col("rank"))
    return near.drop("rank").join(exact, [*keys, "held"]).drop("low", "high", "part", "held")


def pick_percentiles(rows: DataFrame, key: list[str], value: str, tie: str, percentiles: dict[str, float], what: Column) -> DataFrame:
    """(key, a column for each percentile): `what` of the row at index min(n - 1, floor(p n)) by value, ties by `tie`; numbers, nulls first.

    By selection, so that a group is the work of many tasks: the value, then the tie among rows that have it.
    """
    given = rows.select(F.struct(*key).alias("group"), F.col(value).alias("value"), F.col(tie).alias("tie"), what.alias("what"))
    index = lambda p: F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
    picks = F.explode(F.array(*[F.struct(F.lit(n).alias("pick"), index(p).alias("rank")) for n, p in percentiles.items()]))
    asked = given.groupBy("group").agg(F.count(F.lit(1)).alias("n")).select("group", picks.alias("p")).select("group", "p.*")
    found = _selected(write_shared(_selected(given.join(asked, "group"), "value")), "tie")
    return found.groupBy("group").agg(*[F.max(F.when(F.col("pick") == n, F.col("what"))).alias(n) for n in percentiles]).select("group.*", *percentiles)


def measure(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, box_id, contrast, ink_hex, paper_hex) of each box of each picture; null contrast where it cannot be measured.

    pixels: (image_id, width, height, pixel_idx, r, g, b), rows of the picture one after another.
    boxes: (image_id, box_id, bounds), in pixels if any side is over 1, else in shares of the picture.
    """
    frames = pixels.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    cut = boxes.join(frames, "image_id").select("image_id", "box_id", crop(F.col("bounds"), F.col("width"), F.col("height")).alias("box"))
    x, y = F.col("pixel_idx") % F.col("width"), F.floor(F.col("pixel_idx") / F.col("width"))
    box = F.col("box")
    inside = (x >= box["left"]) & (x < box["left"] + box["width"]) & (y >= box["top"]) & (y < box["top"] + box["height"])
    luma = F.col("r") * F.lit(0.2126) + F.col("g") * F.lit(0.7152) + F.col("b") * F.lit(0.0722)
    seen = pixels.join(cut.where(box.isNotNull()), "image_id").where(inside).withColumn("luma", luma)
    picked = pick_percentiles(seen, ["image_id", "box_id"], "luma", "pixel_idx", {"ink": INK_PERCENTILE, "paper": PAPER_PERCENTILE}, F.struct("r", "g", "b"))
    lum = lambda c: relative_luminance(F.col(c)["r"], F.col(c)["g"], F.col(c)["b"])
    hexed = lambda c: to_hex(F.col(c)["r"], F.col(c)["g"], F.col(c)["b"])
    done = picked.select("image_id", "box_id", ratio_of(lum("ink"), lum("paper")).alias("contrast"), hexed("ink").alias("ink_hex"), hexed("paper").alias("paper_hex"))
    return boxes.select("image_id", "box_id").join(done, ["image_id", "box_id"], "left")


def relative_contrast(pixels: DataFrame, warnings: DataFrame) -> DataFrame:
    """(image_id, appearance struct): the warning's contrast, and as a share of the whole label's. Both boxes are measured in one pass.

    warnings: (image_id, bounds). A picture of which either cannot be measured has no appearance.
    """
    whole = F.struct(*[F.lit(v).alias(n) for v, n in zip(WHOLE_LABEL, ("x", "y", "width", "height"), strict=True)])
    boxes = warnings.select("image_id", F.explode(F.array(F.struct(F.lit("warning").alias("box_id"), F.col("bounds").alias("bounds")), F.struct(F.lit("label").alias("box_id"), whole.alias("bounds")))).alias("b")).select("image_id", "b.*")
    got = measure(pixels, boxes).groupBy("image_id").agg(
        F.max(F.when(F.col("box_id") == "warning", F.struct("contrast", "ink_hex", "paper_hex"))).alias("w"), F.max(F.when(F.col("box_id") == "label", F.col("contrast"))).alias("all")
    )
    appearance = F.struct(F.col("w.contrast").alias("measured_contrast"), F.when(F.col("all") > 0, F.col("w.contrast") / F.col("all")).alias("relative_contrast"), F.col("w.ink_hex").alias("text_color_hex"), F.col("w.paper_hex").alias("background_color_hex"))
    return got.select("image_id", F.when(F.col("w.contrast").isNotNull(), appearance).alias("appearance"))


def with_appearance(extractions: DataFrame, appearances: DataFrame, on: str = "filename_key") -> DataFrame:
    """Readings with the measured appearance in their warning, where there is a warning and a measurement."""
    joined = extractions.join(appearances.withColumnRenamed("image_id", on), on, "left")
    warning = F.col("government_warning")
    return joined.withColumn("government_warning", F.when(warning.isNotNull() & F.col("appearance").isNotNull(), warning.withField("appearance", F.col("appearance"))).otherwise(warning)).drop("appearance")


def box_shapes(frames: DataFrame) -> DataFrame:
    """(image_id, box_id, bounds): a loose box, a looser one, and one in pixels that overruns the picture."""
    box = lambda name, *v: F.struct(F.lit(name).alias("box_id"), F.struct(*[x.cast("double").alias(n) for x, n in zip(v, ("x", "y", "width", "height"), strict=True)]).alias("bounds"))
    w, h = F.col("width"), F.col("height")
    lit = F.lit
    shapes = F.array(box("loose", lit(0.05), lit(0.74), lit(0.9), lit(0.2)), box("looser", lit(0.03), lit(0.68), lit(0.94), lit(0.3)), box("overrunning", w * 0.05, h * 0.72, w * 0.9, h * 0.4))
    return frames.select("image_id", F.explode(shapes).alias("s")).select("image_id", "s.*")


def worst_contrast(measured: DataFrame) -> DataFrame:
    """(image_id, worst): the least contrast over a picture's boxes; null if none was measured."""
    return measured.groupBy("image_id").agg(F.min("contrast").alias("worst"))
