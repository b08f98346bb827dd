"""Many boxes of each picture measured at once, by summed-area histograms of brightness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import INK_PERCENTILE, PAPER_PERCENTILE
from ..functions.contrast import crop, ratio_of, relative_luminance, to_hex
from ..sources.shared import write_shared
from .pictures import at_rank


def _strip(borders: str, at: Column) -> Column:
    """How many borders lie at or before a place: the number of its strip."""
    return F.size(F.filter(borders, lambda b: b <= at))


def box_histograms(cells: DataFrame, cut: DataFrame) -> DataFrame:
    """(image_id, box_id, bin, n): pixels of each brightness in each box, from counts by cell of the grid that all boxes' borders make.

    The counts are summed up along rows, then along columns; a box is four corners of the sums. So a picture's boxes
    cost four rows a brightness each, however many cells they cover.
    """
    strips = lambda axis: F.explode(F.sequence(F.lit(0), F.size(axis) - 1)).alias(axis[0])
    borders = cut.select("image_id", "xs", "ys").dropDuplicates(["image_id"])
    bins = cells.select("image_id", "bin").distinct().join(borders, "image_id")
    grid = bins.select("image_id", "bin", "ys", strips("xs")).select("image_id", "bin", "x", strips("ys"))
    counted = grid.join(cells, ["image_id", "bin", "x", "y"], "left").fillna(0, ["n"])
    along = lambda by, order: Window.partitionBy("image_id", "bin", by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.withColumn("n", F.sum("n").over(along("y", "x"))).withColumn("n", F.sum("n").over(along("x", "y")))
    # The last strip before a side; before the first there is none, and its corner is not found.
    low, high = (lambda axis, side: _strip(axis, F.col("box")[side]) - 2), (lambda axis, side, size: _strip(axis, F.col("box")[side] + F.col("box")[size]) - 2)
    corner = lambda x, y, sign: F.struct(x.alias("x"), y.alias("y"), F.lit(sign).alias("sign"))
    x0, x1, y0, y1 = low("xs", "left"), high("xs", "left", "width"), low("ys", "top"), high("ys", "top", "height")
    corners = cut.select("image_id", "box_id", F.explode(F.array(corner(x1, y1, 1), corner(x0, y1, -1), corner(x1, y0, -1), corner(x0, y0, 1))).alias("c")).select("image_id", "box_id", "c.*")
    return corners.join(summed, ["image_id", "x", "y"]).groupBy("image_id", "box_id", "bin").agg(F.sum(F.col("sign") * F.col("n")).alias("n")).where("n > 0")


def sweep(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """measure() of many boxes: (image_id, box_id, contrast, ink_hex, paper_hex), exactly, without sorting a box's pixels.

    One pass counts pixels by cell and whole brightness; a second looks only at the pixels of the brightness in which
    a percentile falls and counts exact values; where colours of one value differ, a third orders these by place.
    """
    frames = pixels.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    cut = boxes.join(frames, "image_id").select("image_id", "box_id", crop(F.col("bounds"), F.col("width"), F.col("height")).alias("box"))
    cut = write_shared(cut).where("box is not null")
    sides = lambda at, size: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.lit(0), F.col("box")[at], F.col("box")[at] + F.col("box")[size])))))
    borders = cut.groupBy("image_id").agg(sides("left", "width").alias("xs"), sides("top", "height").alias("ys"))
    cut = write_shared(cut.join(borders, "image_id"))  # some rows a picture

    luma = F.col("r") * F.lit(0.2126) + F.col("g") * F.lit(0.7152) + F.col("b") * F.lit(0.0722)
    seen = pixels.select("image_id", "pixel_idx", "r", "g", "b", luma.alias("luma"), F.floor(luma).alias("bin"), (F.col("pixel_idx") % F.col("width")).alias("px"), F.floor(F.col("pixel_idx") / F.col("width")).alias("py"))
    celled = seen.join(borders, "image_id").select("image_id", "bin", _strip("xs", F.col("px")).alias("x"), _strip("ys", F.col("py")).alias("y"))
    shown = box_histograms(celled.groupBy("image_id", "bin", "x", "y").agg(F.count(F.lit(1)).alias("n")).select("image_id", "bin", (F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), "n"), cut)

    total = F.sum("n").over(Window.partitionBy("image_id", "box_id"))
    index = lambda p: F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total")))
    asked = shown.withColumn("total", total).select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("pick"), index(p).alias("index")) for n, p in (("ink", INK_PERCENTILE), ("paper", PAPER_PERCENTILE))])).alias("a"))
    asked = asked.select("image_id", "box_id", "bin", "n", "a.*")
    keys = ["image_id", "box_id", "pick"]
    in_bin = write_shared(at_rank(asked, keys, "bin", F.col("index")).join(cut.select("image_id", "box_id", "box"), ["image_id", "box_id"]).drop("index"))

    box = F.col("box")
    inside = (F.col("px") >= box["left"]) & (F.col("px") < box["left"] + box["width"]) & (F.col("py") >= box["top"]) & (F.col("py") < box["top"] + box["height"])
    near = seen.join(in_bin, ["image_id", "bin"]).where(inside)
    colour = F.struct("r", "g", "b")
    values = near.groupBy(*keys, "rank", "luma").agg(F.count(F.lit(1)).alias("n"), F.min(colour).alias("least"), F.max(colour).alias("most"))
    exact = write_shared(at_rank(values, keys, "luma", F.col("rank")))
    same = exact.where(F.col("least") == F.col("most")).select(*keys, F.col("least").alias("colour"))
    mixed = near.drop("rank").join(exact.where(F.col("least") != F.col("most")).select(*keys, "luma", "rank"), [*keys, "luma"])
    placed = mixed.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("pixel_idx")) - 1).where("k = rank").select(*keys, colour.alias("colour"))
    picked = same.unionByName(placed).groupBy("image_id", "box_id").agg(*[F.max(F.when(F.col("pick") == n, F.col("colour"))).alias(n) for n in ("ink", "paper")])
    lum = lambda c: relative_luminance(F.col(c)["r"], F.col(c)["g"], F.col(c)["b"])
    hexed = lambda c: to_hex(F.col(c)["r"], F.col(c)["g"], F.col(c)["b"])
    done = picked.select("image_id", "box_id", ratio_of(lum("ink"), lum("paper")).alias("contrast"), hexed("ink").alias("ink_hex"), hexed("paper").alias("paper_hex"))
    return boxes.select("image_id", "box_id").join(done, ["image_id", "box_id"], "left")
