"""Queries of the alcohol, volume, size and colour operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import STANDARDS_OF_FILL
from ..functions import contrast, fills, parse, scalars
from ..operators import pictures, scores
from .base import query, spread

#: Rows of lineitem are not unique in their keys, so results are counted by value.
ALCOHOL = """
    SELECT CAST(l_quantity AS INT) AS q, l_linenumber % 7 AS v, CASE l_linenumber % 7
        WHEN 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '% Alc./Vol.')
        WHEN 1 THEN concat('ALC. ', CAST(CAST(l_quantity AS INT) AS STRING), ',5% BY VOL')
        WHEN 2 THEN concat(CAST(CAST(l_quantity AS INT) * 2 AS STRING), ' Proof')
        WHEN 3 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '½% vol (', CAST(CAST(l_quantity AS INT) * 2 + 1 AS STRING), ' proof)')
        WHEN 4 THEN concat('51% corn, ', CAST(CAST(l_quantity AS INT) AS STRING), '% alcohol, ', CAST(CAST(l_quantity AS INT) * 2 + 5 AS STRING), ' PROOF')
        WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS STRING)
        ELSE 'full strength' END AS said
    FROM {lineitem}"""
ABV = "CASE v WHEN 0 THEN q WHEN 1 THEN q + 0.5 WHEN 2 THEN q WHEN 3 THEN q + 0.5 WHEN 4 THEN q WHEN 5 THEN q END"
PROOF = "CASE v WHEN 2 THEN q * 2 WHEN 3 THEN q * 2 + 1 WHEN 4 THEN q * 2 + 5 END"


def _read(d: DataFrame) -> DataFrame:
    return spread(d).withColumn("said", parse.alcohol_text(F.col("said"))).withColumn("r", parse.parse_alcohol(F.col("said")))


@query(ALCOHOL, f"SELECT q, v, CAST({ABV} AS DOUBLE) AS abv, CAST({PROOF} AS DOUBLE) AS proof, v = 2 AS derived, count(*) AS n FROM given GROUP BY ALL")
def parse_alcohol(d: DataFrame) -> DataFrame:
    return _read(d).groupBy("q", "v", F.col("r.abv").alias("abv"), F.col("r.proof").alias("proof"), F.col("r.derived").alias("derived")).agg(F.count(F.lit(1)).alias("n"))


@query(ALCOHOL, "SELECT v, CASE v WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN false END AS consistent, count(*) AS n FROM given GROUP BY 1, 2")
def proof_consistency(d: DataFrame) -> DataFrame:
    return _read(d).groupBy("v", parse.proof_consistent(F.col("r")).alias("consistent")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'wine' WHEN 1 THEN 'distilled_spirits' ELSE 'malt_beverage' END AS beverage, l_quantity AS declared, l_quantity + l_discount * 20 AS printed FROM {lineitem}",
    """SELECT beverage, CASE WHEN abs(declared - printed) = 0 THEN 'abv-exact' WHEN abs(declared - printed) <= CASE WHEN beverage <> 'wine' THEN CAST(0.3 AS DOUBLE) WHEN declared <= 14 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END THEN 'abv-within-tolerance' ELSE 'abv-outside-tolerance' END AS rule, count(*) AS n
    FROM given GROUP BY 1, 2""",
)
def abv_tolerance(d: DataFrame) -> DataFrame:
    off = F.abs(F.col("declared") - F.col("printed"))
    rule = F.when(off == 0, "abv-exact").when(off <= parse.tolerance(F.col("beverage"), F.col("declared")), "abv-within-tolerance").otherwise("abv-outside-tolerance")
    return d.groupBy("beverage", rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


VOLUMES = """
    SELECT p_partkey, p_size * 25 AS ml, p_partkey % 6 AS v, CASE p_partkey % 6
        WHEN 0 THEN concat(CAST(p_size * 25 AS STRING), ' mL') WHEN 1 THEN concat('NET CONT. ', CAST(p_size * 2.5 AS STRING), 'cl') WHEN 2 THEN concat(CAST(p_size AS STRING), ' FL. OZ. (x)')
        WHEN 3 THEN concat(replace(CAST(p_size / CAST(2 AS DOUBLE) AS STRING), '.', ','), ' Liters') WHEN 4 THEN concat(CAST(p_size AS STRING), ' pints') ELSE 'one bottle' END AS said
    FROM {part}"""


@query(
    VOLUMES,
    """SELECT p_partkey, round(CAST(CASE v WHEN 0 THEN ml WHEN 1 THEN ml WHEN 2 THEN ml / 25 * CAST(29.5735 AS DOUBLE) WHEN 3 THEN ml * 20 WHEN 4 THEN ml / 25 * CAST(473.176 AS DOUBLE) END AS DOUBLE), 6) AS ml,
        CASE v WHEN 0 THEN 'mL' WHEN 1 THEN 'cl' WHEN 2 THEN 'FL. OZ' WHEN 3 THEN 'Liters' WHEN 4 THEN 'pints' END AS unit FROM given""",
)
def parse_volume(d: DataFrame) -> DataFrame:
    r = parse.parse_volume(F.col("said"))
    return d.withColumn("said", parse.volume_text(F.col("said"))).select("p_partkey", F.round(r["ml"], 6).alias("ml"), r["unit"].alias("unit"))


@query("SELECT p_partkey, CAST(p_size * 100 AS DOUBLE) AS ml FROM {part}", "SELECT p_partkey, CASE WHEN ml < 1000 THEN concat(CAST(CAST(ml AS BIGINT) AS STRING), ' mL') WHEN ml % 1000 = 0 THEN concat(CAST(CAST(ml / 1000 AS BIGINT) AS STRING), ' L') ELSE concat(printf('%.2f', ml / 1000), ' L') END AS shown FROM given")
def format_volume(d: DataFrame) -> DataFrame:
    return d.select("p_partkey", parse.format_volume(F.col("ml")).alias("shown"))


LISTS = " UNION ALL ".join(f"SELECT '{k}' AS b, unnest([{', '.join(map(str, v))}]) AS size" for k, v in STANDARDS_OF_FILL.items())


@query(
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'wine' WHEN 1 THEN 'distilled_spirits' ELSE 'malt_beverage' END AS beverage, CAST(p_size * 25 + CASE WHEN p_partkey % 5 = 0 THEN 0.9 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 4000 WHEN p_partkey % 11 = 0 THEN 18000 ELSE 0 END AS DOUBLE) AS ml FROM {part}",
    f"""SELECT p_partkey, CASE WHEN beverage = 'malt_beverage' OR (beverage = 'wine' AND ml >= 18000) THEN true WHEN beverage = 'wine' AND ml >= 4000 THEN abs(ml / 1000 - floor(ml / 1000 + 0.5)) < 0.001 ELSE hits > 0 END AS authorised,
        beverage = 'malt_beverage' OR (beverage = 'wine' AND ml >= 18000) AS not_applicable
    FROM (SELECT given.*, (SELECT count(*) FROM ({LISTS}) AS s WHERE s.b = beverage AND abs(size - ml) <= 1) AS hits FROM given) AS g""",
)
def standard_of_fill(d: DataFrame) -> DataFrame:
    return d.select("p_partkey", fills.check_fill(F.col("beverage"), F.col("ml")).alias("f")).select("p_partkey", "f.authorised", "f.not_applicable")


@query(
    "SELECT p_partkey, CAST(p_size * 77 + 3 AS DOUBLE) AS ml FROM {part}",
    f"""SELECT p_partkey, CAST((SELECT max(size) FROM ({LISTS}) AS s WHERE b = 'distilled_spirits' AND size < ml) AS DOUBLE) AS below, CAST((SELECT min(size) FROM ({LISTS}) AS s WHERE b = 'distilled_spirits' AND size > ml) AS DOUBLE) AS above
    FROM given WHERE NOT EXISTS (SELECT 1 FROM ({LISTS}) AS s WHERE b = 'distilled_spirits' AND abs(size - ml) <= 1)""",
)
def fill_bracket(d: DataFrame) -> DataFrame:
    near = d.select("p_partkey", "ml", fills.check_fill(F.lit("distilled_spirits"), F.col("ml"))["nearest"].alias("n")).where("n is not null")
    side = lambda test: F.get(F.filter("n", test), 0)
    return near.select("p_partkey", side(lambda z: z < F.col("ml")).alias("below"), side(lambda z: z > F.col("ml")).alias("above"))


COLOURS = "SELECT p_partkey, CAST(p_partkey * 7 % 256 AS INT) AS r, CAST(p_partkey * 13 % 256 AS INT) AS g, CAST(p_partkey * 29 % 256 AS INT) AS b FROM {part}"
LUM = lambda v: f"CASE WHEN {v} / CAST(255 AS DOUBLE) <= 0.03928 THEN {v} / CAST(255 AS DOUBLE) / 12.92 ELSE pow(({v} / CAST(255 AS DOUBLE) + 0.055) / 1.055, 2.4) END"


@query(
    COLOURS,
    f"SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS colour, round(CAST(1.05 AS DOUBLE) / (0.2126 * {LUM('r')} + 0.7152 * {LUM('g')} + 0.0722 * {LUM('b')} + 0.05), 6) AS ratio FROM given",
)
def contrast_ratio(d: DataFrame) -> DataFrame:
    colour = contrast.to_hex(F.col("r"), F.col("g"), F.col("b"))
    return d.withColumn("colour", colour).select("p_partkey", "colour", F.round(contrast.contrast_ratio(F.col("colour"), F.lit("#FFF")), 6).alias("ratio"))


@query(
    "SELECT event_id, event_type, value FROM {events}",
    """SELECT event_type, max(CASE WHEN k = least(n - 1, CAST(floor(0.02 * n) AS BIGINT)) THEN event_id END) AS ink, max(CASE WHEN k = least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) THEN event_id END) AS paper
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM given) AS g GROUP BY 1""",
)
def percentile_pick(d: DataFrame) -> DataFrame:
    return pictures.pick_percentiles(d, ["event_type"], "value", "event_id", {"ink": 0.02, "paper": 0.9}, F.col("event_id"))


@query(
    "SELECT user_id, event_type, value FROM {events}",
    "SELECT event_type, user_id % 5 AS model, arr[len(arr) // 2 + 1] AS median, arr[len(arr)] AS worst FROM (SELECT event_type, user_id, list_sort(list(value)) AS arr FROM (SELECT event_type, user_id % 5 AS user_id, value FROM given) AS h GROUP BY 1, 2) AS g",
)
def upper_median_scorecard(d: DataFrame) -> DataFrame:
    rows = d.select("event_type", (F.col("user_id") % 5).alias("model"), "value")
    keys = ["event_type", "model"]
    return scores.upper_median(rows, keys, "value").join(rows.groupBy(*keys).agg(F.max("value").alias("worst")), keys)


@query(
    "SELECT n_nationkey, CAST(n_nationkey * 40 + 100 AS INT) AS width, CAST(n_nationkey * 20 + 60 AS INT) AS height FROM {nation}",
    """SELECT n_nationkey, box_id, x0 + CAST(floor(w * 0.05 + 0.5) AS INT) AS crop_left, CAST(floor(w * 0.9 + 0.5) AS INT) AS crop_width FROM (
        SELECT n_nationkey, box_id, CAST(floor(x * width + 0.5) AS INT) AS x0, least(CAST(floor(s * width + 0.5) AS INT), width - CAST(floor(x * width + 0.5) AS INT)) AS w
        FROM given, (VALUES ('loose', CAST(0.05 AS DOUBLE), CAST(0.9 AS DOUBLE)), ('looser', CAST(0.03 AS DOUBLE), CAST(0.94 AS DOUBLE)), ('overrunning', CAST(0.05 AS DOUBLE), CAST(0.9 AS DOUBLE))) AS b(box_id, x, s)) AS g""",
)
def cross_sweep_boxes(d: DataFrame) -> DataFrame:
    frames = d.withColumnRenamed("n_nationkey", "image_id")
    cut = pictures.box_shapes(frames).join(frames, "image_id").select("image_id", "box_id", contrast.crop(F.col("bounds"), F.col("width"), F.col("height")).alias("c"))
    return cut.select(F.col("image_id").alias("n_nationkey"), "box_id", F.col("c.left").alias("crop_left"), F.col("c.width").alias("crop_width"))


@query(
    "SELECT event_id, user_id, CASE WHEN event_id % 10 <> 0 THEN value END AS contrast FROM {events}",
    "SELECT user_id AS image_id, min(contrast) AS worst FROM given GROUP BY 1",
)
def cross_sweep_min(d: DataFrame) -> DataFrame:
    return pictures.worst_contrast(d.withColumnRenamed("user_id", "image_id"))


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'image/gif' ELSE 'image/png' END AS mime, CAST(event_id * 997 % 900000 AS INT) AS size, CAST(event_id * 31 % 4000 + 1 AS INT) AS w, CAST(event_id * 17 % 3000 + 1 AS INT) AS h FROM {events}",
    """SELECT event_id, CASE WHEN skipped THEN w ELSE CAST(floor(w * (CAST(1568 AS DOUBLE) / greatest(w, h)) + 0.5) AS INT) END AS width, CASE WHEN skipped THEN h ELSE CAST(floor(h * (CAST(1568 AS DOUBLE) / greatest(w, h)) + 0.5) AS INT) END AS height
    FROM (SELECT *, mime = 'image/gif' OR size <= 409600 OR greatest(w, h) <= 1568 AS skipped FROM given) AS g""",
)
def downscale_plan(d: DataFrame) -> DataFrame:
    return d.select("event_id", scalars.downscaled(F.col("mime"), F.col("size"), F.col("w"), F.col("h")).alias("s")).select("event_id", "s.width", "s.height")
