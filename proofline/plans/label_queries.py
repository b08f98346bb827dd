"""Queries of the rules, roll-ups, joins, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import STATUTORY_WARNING
from ..functions import scalars
from ..operators import rollup, scores
from ..operators.rules import verify_pairs
from ..schemas import APPEARANCE, CHECK, LEGIBILITY, QUALITY, WARNING
from ..sources import readers, sinks
from ..streaming.limits import rate_limit
from .base import derived, query, spread

STATUTE = STATUTORY_WARNING.replace("'", "''")
#: Applications and readings out of `part`, in eight ways by key.
PAIRS = f"""
    SELECT p_partkey, p_partkey % 8 AS v, concat('A-', CAST(p_partkey AS STRING)) AS a_application_id,
        CASE p_partkey % 3 WHEN 0 THEN 'wine' WHEN 1 THEN 'distilled_spirits' ELSE 'malt_beverage' END AS a_beverage_type,
        concat(p_name, ' ', p_brand) AS a_brand_name, p_type AS a_class_type, concat(CAST(p_size % 40 + 5 AS STRING), '% Alc./Vol.') AS a_alcohol_content, '750 mL' AS a_net_contents,
        concat(p_name, ' Distillery') AS a_bottler_name, CAST(NULL AS STRING) AS a_label_company_name, CASE WHEN p_partkey % 5 = 0 THEN 'Scotland' END AS a_country_of_origin, p_partkey % 5 = 0 AS a_is_import,
        CASE p_partkey % 8 WHEN 1 THEN upper(concat(p_name, ' ', p_brand)) WHEN 4 THEN concat(p_name, ' ', p_brand, 'x') ELSE concat(p_name, ' ', p_brand) END AS brand,
        concat(CAST(p_size % 40 + 5 + CASE WHEN p_partkey % 8 = 2 THEN 5 ELSE 0 END AS STRING), '% ALC BY VOL') AS alcohol,
        CASE p_partkey % 8 WHEN 3 THEN '75 cL' ELSE '750 ml' END AS volume,
        concat('BOTTLED BY ', upper(p_name), ' DISTILLERY, KY') AS bottler,
        CASE WHEN p_partkey % 8 = 5 THEN replace('{STATUTE}', 'may', 'might') ELSE '{STATUTE}' END AS warning,
        CASE WHEN p_partkey % 8 = 6 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS picture,
        CASE WHEN p_partkey % 8 = 7 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS sure
    FROM {{part}}"""


def readings(d: DataFrame) -> DataFrame:
    """The derived columns as verify_pairs() wants them."""
    reading = lambda c, sure=0.9: F.struct(F.col(c).alias("text"), (F.col(sure) if isinstance(sure, str) else F.lit(sure)).cast("double").alias("confidence"))
    warning = F.struct(F.col("warning").alias("text"), F.lit(0.9).alias("confidence"), F.lit(True).alias("header_is_all_caps"), F.lit(True).alias("header_is_bold"), F.lit(True).alias("legible_size"), F.lit(None).alias("bounds"), F.lit(None).cast(APPEARANCE).alias("appearance")).cast(WARNING)
    none = F.array().cast("array<string>")
    return d.withColumns({
        "brand_name": reading("brand", "sure"), "class_type": reading("a_class_type"), "alcohol_content": reading("alcohol"), "net_contents": reading("volume"), "bottler_name": reading("bottler"),
        "country_of_origin": F.when(F.col("a_is_import"), F.struct(F.lit("PRODUCT OF SCOTLAND").alias("text"), F.lit(0.9).alias("confidence"))), "government_warning": warning,
        "image_quality": F.struct(F.col("picture").alias("score"), none.alias("issues"), F.lit(False).alias("too_poor_to_review")).cast(QUALITY),
        "label_legibility": F.struct(F.lit(0.9).alias("score"), F.lit(False).alias("below_ordinary_eyesight"), none.alias("issues")).cast(LEGIBILITY), "notes": none, "extraction_ms": F.lit(1000).cast("long"), "reader": F.lit("table"),
    })


def reports(d: DataFrame) -> DataFrame:
    return verify_pairs(readings(spread(d)), "p_partkey")


@query(
    PAIRS,
    """SELECT p_partkey, CASE WHEN v IN (2, 5) THEN 'reject' WHEN v IN (4, 6, 7) THEN 'needs_review' ELSE 'approve' END AS recommendation,
        CAST(CASE a_beverage_type WHEN 'malt_beverage' THEN 10 ELSE 11 END AS INT) AS checks,
        CASE v WHEN 2 THEN 'abv-outside-tolerance' WHEN 4 THEN 'near-match-needs-review' WHEN 5 THEN 'warning-wording-altered' WHEN 6 THEN 'image-not-reviewable' WHEN 7 THEN 'low-transcription-confidence' ELSE '' END AS reasons FROM given""",
)
def verify_labels(d: DataFrame) -> DataFrame:
    bad = F.array_distinct(F.transform(F.filter("checks", lambda c: c["verdict"].isin("fail", "review", "unreadable")), lambda c: c["rule"]))
    return reports(d).select("p_partkey", "recommendation", F.size("checks").alias("checks"), F.array_join(bad, ",").alias("reasons"))


@query(
    PAIRS,
    """SELECT id, verdict, count(*) AS n FROM (
        SELECT unnest(['brand_name', 'class_type', 'alcohol_content', 'net_contents', 'bottler', 'label_legibility', 'government_warning', 'warning_capitalisation', 'warning_prominence']) AS id,
            unnest([CASE v WHEN 6 THEN 'unreadable' WHEN 7 THEN 'unreadable' WHEN 4 THEN 'review' ELSE 'pass' END, CASE v WHEN 6 THEN 'unreadable' ELSE 'pass' END, CASE v WHEN 6 THEN 'unreadable' WHEN 2 THEN 'fail' ELSE 'pass' END, CASE v WHEN 6 THEN 'unreadable' ELSE 'pass' END,
                CASE v WHEN 6 THEN 'unreadable' ELSE 'pass' END, CASE v WHEN 6 THEN 'unreadable' ELSE 'pass' END, CASE v WHEN 6 THEN 'unreadable' WHEN 5 THEN 'fail' ELSE 'pass' END, CASE v WHEN 6 THEN 'unreadable' ELSE 'pass' END, CASE v WHEN 6 THEN 'unreadable' ELSE 'pass' END]) AS verdict FROM given
        UNION ALL SELECT 'standard_of_fill', CASE v WHEN 6 THEN 'unreadable' ELSE 'pass' END FROM given WHERE a_beverage_type <> 'malt_beverage'
        UNION ALL SELECT 'country_of_origin', CASE WHEN NOT a_is_import THEN 'not_applicable' WHEN v = 6 THEN 'unreadable' ELSE 'pass' END FROM given) AS g GROUP BY 1, 2""",
)
def check_verdicts(d: DataFrame) -> DataFrame:
    return rollup.explode_checks(reports(d), "p_partkey").groupBy("id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(PAIRS, "SELECT DISTINCT unnest(['brand_name', 'class_type', 'alcohol_content', 'net_contents', 'standard_of_fill', 'bottler', 'country_of_origin', 'label_legibility', 'government_warning', 'warning_capitalisation', 'warning_prominence']) AS id")
def check_ids(d: DataFrame) -> DataFrame:
    return rollup.explode_checks(reports(d), "p_partkey").select("id").distinct()


ITEMS = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
        CASE CAST(floor(l_extendedprice) AS BIGINT) % 9 WHEN 0 THEN 'fail' WHEN 1 THEN 'review' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'not_applicable' ELSE 'pass' END AS verdict
    FROM {lineitem}"""
COUNTS = "SELECT l_orderkey, count(*) FILTER (verdict = 'fail') AS fails, count(*) FILTER (verdict = 'unreadable') AS blind, count(*) FILTER (verdict = 'review') AS looks FROM given GROUP BY 1"
RECOMMEND = "CASE WHEN fails > 0 THEN 'reject' WHEN blind > 0 OR looks > 0 THEN 'needs_review' ELSE 'approve' END"


def _rolled(d: DataFrame) -> DataFrame:
    c = d.groupBy("l_orderkey").agg(*[F.count_if(F.col("verdict") == v).alias(n) for v, n in (("fail", "fails"), ("unreadable", "blind"), ("review", "looks"))])
    return c.withColumn("recommendation", rollup.recommend(F.col("fails"), F.col("blind"), F.col("looks")))


@query(ITEMS, f"SELECT *, {RECOMMEND} AS recommendation FROM ({COUNTS}) AS c")
def verdict_rollup(d: DataFrame) -> DataFrame:
    return _rolled(d)


def _as_items(d: DataFrame) -> DataFrame:
    odd = F.col("l_orderkey") % 10
    rolled = _rolled(d).withColumn("error", F.when(odd == 0, "no picture"))
    rolled = rolled.withColumn("recommendation", F.when(odd > 1, F.col("recommendation")))
    return rollup.item_status(rolled.withColumn("application_id", F.when((odd != 1) | (F.col("l_orderkey") % 3 == 0), F.col("l_orderkey"))))


ITEM_SQL = f"SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN 'failed' WHEN l_orderkey % 10 = 1 THEN 'queued' ELSE {RECOMMEND} END AS state FROM ({COUNTS}) AS c"


@query(ITEMS, f"SELECT count(*) FILTER (state = 'approve') AS approve, count(*) FILTER (state = 'needs_review') AS needs_review, count(*) FILTER (state = 'reject') AS reject, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'queued') AS pending FROM ({ITEM_SQL}) AS i")
def batch_summary(d: DataFrame) -> DataFrame:
    return rollup.batch_summary(_as_items(d))


@query(ITEMS, f"SELECT l_orderkey FROM ({ITEM_SQL}) AS i WHERE state IN ('failed', 'needs_review', 'reject')")
def attention_items(d: DataFrame) -> DataFrame:
    return rollup.needs_attention(_as_items(d)).select("l_orderkey")


@query(ITEMS, f"SELECT count(*) FILTER (state = 'queued' AND l_orderkey % 3 = 0) AS ready, count(*) FILTER (state = 'queued' AND l_orderkey % 3 <> 0) AS unmatched FROM ({ITEM_SQL}) AS i")
def ready_counts(d: DataFrame) -> DataFrame:
    return rollup.ready_counts(_as_items(d))


ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _check(**known) -> F.Column:
    from ..operators.rules import check

    return check(**({"id": "c", "name": "C", "category": "match", "rule": "r", "explanation": "e"} | known))


def _grouped(d: DataFrame) -> DataFrame:
    """Each order's lines as an ordered list of checks: an order has a handful of lines."""
    one = F.struct(*ORDER, _check(name=F.col("l_linenumber").cast("string"), verdict=F.col("verdict"), explanation=F.col("l_partkey").cast("string")).alias("check"))
    return d.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["check"]).alias("checks"))


SORTED = ", ".join(ORDER)


@query(
    ITEMS,
    f"SELECT l_orderkey, string_agg(verdict || l_linenumber, ',' ORDER BY CASE verdict WHEN 'fail' THEN 0 WHEN 'unreadable' THEN 1 WHEN 'review' THEN 2 WHEN 'pass' THEN 3 ELSE 4 END, {SORTED}) AS ranked FROM given GROUP BY 1",
)
def verdict_rank_sort(d: DataFrame) -> DataFrame:
    return _grouped(d).select("l_orderkey", F.array_join(F.transform(rollup.by_severity(F.col("checks")), lambda c: F.concat(c["verdict"], c["name"])), ",").alias("ranked"))


@query(
    ITEMS,
    """SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN 'needs_review' WHEN count(*) FILTER (verdict = 'fail') > 0 THEN 'reject' WHEN count(*) FILTER (verdict IN ('unreadable', 'review')) > 0 THEN 'needs_review' ELSE 'approve' END AS recommendation,
        CASE WHEN l_orderkey % 4 = 0 THEN count(*) FILTER (verdict <> 'not_applicable') ELSE count(*) FILTER (verdict = 'unreadable') END AS unreadable FROM given GROUP BY 1""",
)
def image_override(d: DataFrame) -> DataFrame:
    quality = F.struct(F.when(F.col("l_orderkey") % 4 == 0, 0.4).otherwise(0.5).alias("score"), F.lit(False).alias("too_poor_to_review"))
    done = _grouped(d).withColumn("s", rollup.summarise(F.col("checks")))
    done = done.withColumns(rollup.override_unreviewable(quality, F.col("checks"), F.col("s")))
    return done.select("l_orderkey", "recommendation", rollup.verdict_count(F.col("checks"), "unreadable").cast("long").alias("unreadable"))


@query(
    ITEMS,
    f"""SELECT l_orderkey, concat_ws(',', CASE WHEN l_orderkey % 3 = 0 THEN '''=' ELSE 'F' END || l_orderkey, '', '', CASE WHEN fails > 0 THEN 'reject' WHEN blind > 0 OR looks > 0 THEN 'needs_review' ELSE 'approve' END, 's', coalesce(f, ''), coalesce(r, ''), '2.0') AS line FROM (
        SELECT l_orderkey, count(*) FILTER (verdict = 'fail') AS fails, count(*) FILTER (verdict = 'unreadable') AS blind, count(*) FILTER (verdict = 'review') AS looks, string_agg(l_linenumber || ': ' || l_partkey, ' | ' ORDER BY {SORTED}) FILTER (verdict = 'fail') AS f,
            string_agg(l_linenumber || ': ' || l_partkey, ' | ' ORDER BY {SORTED}) FILTER (verdict IN ('review', 'unreadable')) AS r FROM given GROUP BY 1) AS g""",
)
def export_rows(d: DataFrame) -> DataFrame:
    items = _grouped(d).withColumns({
        "filename": F.concat(F.when(F.col("l_orderkey") % 3 == 0, "=").otherwise("F"), F.col("l_orderkey")), "application_id": F.lit(None).cast("string"), "brand_name": F.lit(None).cast("string"), "error": F.lit(None).cast("string"),
        "elapsed_ms": F.lit(2000), "headline": F.lit("s"), "recommendation": rollup.summarise(F.col("checks"))["recommendation"],
    })
    rows = rollup.export_rows(rollup.item_status(items))
    return rollup.csv_lines(rows).select(F.regexp_extract("line", "^\\D*(\\d+)", 1).cast("long").alias("l_orderkey"), "line")


IMAGES = "SELECT o_orderkey, o_custkey AS filename_key FROM {orders}"


def _manifest(d: DataFrame, sf: str) -> DataFrame:
    return derived(d.sparkSession, sf, MANIFEST)


MANIFEST = "SELECT c_custkey AS filename_key, c_name AS brand_name, n AS line_no FROM {customer}, (VALUES (1), (2)) AS t(n) WHERE c_custkey % 5 <> 0 AND (n = 1 OR c_custkey % 2 = 0)"
JOINED = f"SELECT o.o_orderkey, o.o_custkey AS filename_key, m.brand_name, m.line_no FROM {{orders}} AS o LEFT JOIN ({MANIFEST}) AS m ON m.filename_key = o.o_custkey"


def two(name: str, left: str, right: str, oracle: str | None):
    """Registers a function of two derived tables."""
    import re

    from .base import ORACLES, QUERIES

    def register(f):
        QUERIES[name] = lambda spark, sf: f(derived(spark, sf, left), derived(spark, sf, right))
        if oracle:
            plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
            ORACLES[name] = f"WITH RECURSIVE a AS ({plain(left)}), b AS ({plain(right)}) {oracle}"
        return f

    return register


LAST = "(SELECT filename_key, brand_name, line_no FROM b QUALIFY row_number() OVER (PARTITION BY filename_key ORDER BY line_no DESC) = 1)"


@two("manifest_join", IMAGES, MANIFEST, f"SELECT a.o_orderkey, a.filename_key, m.brand_name, m.line_no FROM a LEFT JOIN {LAST} AS m USING (filename_key)")
def _join(a: DataFrame, b: DataFrame) -> DataFrame:
    return readers.match_images(a, readers.last_per_key(b, "filename_key", "line_no")).select("o_orderkey", "filename_key", "brand_name", "line_no")


@two("manifest_unmatched", IMAGES, MANIFEST, "SELECT o_orderkey, filename_key FROM a WHERE filename_key NOT IN (SELECT filename_key FROM b)")
def _unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    return readers.unmatched_images(a, b)


@two("manifest_rekey", "SELECT c_custkey AS filename_key, c_mktsegment AS brand_name FROM {customer}", MANIFEST, f"SELECT a.filename_key, coalesce(m.brand_name, a.brand_name) AS brand_name FROM a LEFT JOIN {LAST} AS m USING (filename_key)")
def _rekey(a: DataFrame, b: DataFrame) -> DataFrame:
    return readers.rekey(a, readers.last_per_key(b, "filename_key", "line_no"))


@two("set_difference", "SELECT DISTINCT p_size AS size FROM {part} WHERE p_size % 3 <> 0", "SELECT DISTINCT p_size AS size FROM {part} WHERE p_size % 2 <> 0", "SELECT size, 'left' AS side FROM a WHERE size NOT IN (SELECT size FROM b) UNION ALL SELECT size, 'right' FROM b WHERE size NOT IN (SELECT size FROM a)")
def _difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return readers.difference(a, b, "size")


@two(
    "expected_vs_actual", "SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 7 = 0 THEN 'reject' ELSE 'approve' END AS recommendation FROM {orders} WHERE o_orderkey % 11 <> 0", "SELECT o_orderkey AS sample_id, CASE WHEN o_orderkey % 5 = 0 THEN 'reject' ELSE 'approve' END AS recommendation FROM {orders}",
    "SELECT count(*) FILTER (coalesce(a.recommendation = b.recommendation, false)) AS passed, count(*) FILTER (NOT coalesce(a.recommendation = b.recommendation, false)) AS failed FROM b LEFT JOIN a USING (sample_id)",
)
def _expected(a: DataFrame, b: DataFrame) -> DataFrame:
    return scores.totals(scores.against_expected(a, b))


@two(
    "reader_scorecard", "SELECT CAST(user_id % 4 AS STRING) AS model, event_id AS sample_id, CAST(floor(value * 10) AS BIGINT) AS elapsed_ms, CASE WHEN event_id % 9 = 0 THEN 'other' ELSE upper(event_type) END AS brand FROM {events}", "SELECT event_id AS sample_id, event_type AS brand FROM {events}",
    """SELECT model, CAST(sum(CAST(event_ok AS INT)) AS BIGINT) AS correct, count(*) AS total, round(sum(CAST(event_ok AS INT)) / CAST(count(*) AS DOUBLE), 9) AS accuracy, list_sort(list(elapsed_ms))[count(*) // 2 + 1] AS median_ms, max(elapsed_ms) AS worst_ms
    FROM (SELECT a.*, lower(a.brand) = lower(b.brand) AS event_ok FROM a JOIN b USING (sample_id)) AS g GROUP BY 1""",
)
def _scorecard(a: DataFrame, b: DataFrame) -> DataFrame:
    return scores.scorecard(a, b, ["brand"]).withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT event_id, user_id, event_type, ts FROM {events}", "SELECT user_id, event_type, event_id FROM given QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins_dedupe(d: DataFrame) -> DataFrame:
    keyed = d.withColumn("id", F.concat_ws(":", "user_id", "event_type"))
    return readers.first_per_key(keyed, "id", "ts", "event_id").select("user_id", "event_type", "event_id")


@query(
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('{\"beverageType\":\"wine\",\"brandName\":\" ', event_type, ' \",\"classType\":\"Red\",\"isImport\":true}') WHEN 1 THEN '{\"beverageType\":\"cider\",\"brandName\":\"x\",\"classType\":\"y\"}' WHEN 2 THEN '{\"beverageType\":\"wine\",\"classType\":\"y\"}' WHEN 3 THEN '{not json' WHEN 4 THEN props ELSE concat('{\"beverageType\":\"wine\",\"brandName\":\"', repeat('x', 301), '\",\"classType\":\"y\"}') END AS raw FROM {events}",
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type END AS brand_name, CASE event_id % 6 WHEN 1 THEN 'beverage_type: not one of three' WHEN 2 THEN 'brand_name: missing' WHEN 3 THEN 'application: not valid' WHEN 4 THEN 'beverage_type: not one of three' WHEN 5 THEN 'brand_name: too long' END AS error FROM given JOIN events USING (event_id)",
)
def application_parse(d: DataFrame) -> DataFrame:
    return d.select("event_id", readers.parse_applications(F.col("raw")).alias("p")).select("event_id", "p.value.brand_name", "p.error")


@query(
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('{\"brand_name\":{\"text\":\"x\",\"confidence\":', CAST(value AS STRING), '}}') WHEN event_id % 4 = 1 THEN '{\"image_quality\":{\"score\":0.25,\"issues\":[],\"too_poor_to_review\":false}}' ELSE '{}' END AS raw, value FROM {events}",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 AND value > 1 THEN NULL WHEN event_id % 4 = 1 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS quality, CASE WHEN event_id % 4 = 0 AND value > 1 THEN 'brand_name: outside 0 to 1' END AS error FROM given",
)
def json_validate(d: DataFrame) -> DataFrame:
    return spread(d).select("event_id", readers.parse_extractions(F.col("raw")).alias("p")).select("event_id", F.col("p.value.image_quality.score").alias("quality"), "p.error")


@query(
    "SELECT event_id AS filename_key, n AS attempt, CASE WHEN (event_id + n) % 3 <> 0 THEN 'busy' END AS error, (event_id + n) % 5 <> 0 AS retryable, concat('r', CAST(n AS STRING)) AS reading FROM {events}, (VALUES (1), (2), (3)) AS t(n)",
    "SELECT filename_key, reading FROM given AS g WHERE error IS NULL AND NOT EXISTS (SELECT 1 FROM given AS h WHERE h.filename_key = g.filename_key AND h.attempt < g.attempt AND (h.error IS NULL OR NOT h.retryable))",
)
def reader_fallback(d: DataFrame) -> DataFrame:
    return readers.first_success(d).select("filename_key", "reading")


@query(
    "SELECT event_id, user_id AS key, epoch_ms AS at_ms FROM (SELECT event_id, user_id, CAST(event_id AS BIGINT) * 1000 * 97 % 86400000 AS epoch_ms FROM {events}) AS e",
    """, seq AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, event_id) AS k FROM given),
    walk AS (SELECT key, event_id, at_ms, k, 1 AS c, at_ms + 3600000 AS reset_at FROM seq WHERE k = 1
        UNION ALL SELECT s.key, s.event_id, s.at_ms, s.k, CASE WHEN w.reset_at <= s.at_ms THEN 1 ELSE w.c + 1 END, CASE WHEN w.reset_at <= s.at_ms THEN s.at_ms + 3600000 ELSE w.reset_at END FROM walk AS w JOIN seq AS s ON s.key = w.key AND s.k = w.k + 1)
    SELECT key, event_id, c <= 2 AS allowed, CAST(greatest(0, 2 - c) AS BIGINT) AS remaining, CAST(CASE WHEN c = 1 THEN 0 ELSE ceil((reset_at - at_ms) / CAST(1000 AS DOUBLE)) END AS BIGINT) AS retry_after_seconds FROM walk""",
)
def fixed_window_limit(d: DataFrame) -> DataFrame:
    return rate_limit(d, 2, 3_600_000, order="event_id").drop("at_ms")


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('27 CFR ', CAST(user_id AS STRING)) END AS citation, event_type AS rule, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS DOUBLE) / 100 END AS confidence FROM {events}",
    "SELECT event_id, concat_ws('   ', 'Regulation: ' || citation, 'Rule: ' || rule, 'Reading confidence: ' || CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS STRING) || '%') AS line FROM given",
)
def provenance(d: DataFrame) -> DataFrame:
    return d.select("event_id", sinks.provenance(F.struct("citation", "rule", "confidence")).alias("line"))


@query(
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'needs_review' END AS recommendation, CASE event_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'review' WHEN 2 THEN 'fail' WHEN 3 THEN 'unreadable' ELSE 'not_applicable' END AS verdict, value FROM {events}",
    """SELECT CASE recommendation WHEN 'approve' THEN 'NO PROBLEMS FOUND' WHEN 'reject' THEN 'PROBLEMS FOUND' ELSE 'NEEDS REVIEW BY AN AGENT' END AS result, CASE recommendation WHEN 'approve' THEN 'pass' WHEN 'reject' THEN 'fail' ELSE 'review' END AS chip,
        CASE verdict WHEN 'pass' THEN 'Matches' WHEN 'review' THEN 'Check by eye' WHEN 'fail' THEN 'Problem' WHEN 'unreadable' THEN 'Could not read' ELSE 'Not required' END AS screen, count(*) FILTER (value * 100 <= 5000) AS within_budget, count(*) AS n FROM given GROUP BY 1, 2, 3""",
)
def label_maps(d: DataFrame) -> DataFrame:
    from ..constants import BUDGET_MS

    keys = [scalars.lookup(sinks.RECOMMENDATION_WORDS, F.col("recommendation")).alias("result"), scalars.lookup(sinks.RECOMMENDATION_VERDICT, F.col("recommendation")).alias("chip"), scalars.lookup(sinks.SCREEN_WORDS, F.col("verdict")).alias("screen")]
    return d.groupBy(*keys).agg(F.count_if(F.col("value") * 100 <= BUDGET_MS).alias("within_budget"), F.count(F.lit(1)).alias("n"))
