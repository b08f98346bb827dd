"""Queries that drive every rule id: each row of `part` is one of the cases below, and the SQL lists what it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import STATUTORY_WARNING
from ..operators import rollup
from ..operators.rules import verify_pairs
from ..schemas import APPEARANCE, LEGIBILITY, QUALITY, READING, WARNING
from .base import query, spread

STATUTE = f"'{STATUTORY_WARNING}'"
BRAND, BOTTLER = "concat(p_name, ' Creek')", "concat(p_name, ' Distillery')"
#: What an application (a_*) and a reading say where a case does not say otherwise, as SQL.
INPUTS = {
    "a_beverage_type": "'distilled_spirits'", "a_brand_name": BRAND, "a_class_type": "'Straight Bourbon'", "a_alcohol_content": "'45% Alc./Vol.'", "a_net_contents": "'750 mL'", "a_bottler_name": BOTTLER,
    "a_label_company_name": "NULL", "a_country_of_origin": "NULL", "a_is_import": "false",
    "brand": BRAND, "class": "'Straight Bourbon'", "alcohol": "'45% ALC/VOL (90 PROOF)'", "volume": "'750 mL'", "bottler": BOTTLER, "origin": "NULL", "warning": STATUTE,
    "brand_sure": "0.9", "alcohol_sure": "0.9", "volume_sure": "0.9", "bottler_sure": "0.9", "warning_sure": "0.9", "bold": "true", "size_ok": "true", "relative": "NULL", "picture": "0.9", "legible": "0.9", "below": "false",
}
KINDS = {"brand_sure": "DOUBLE", "alcohol_sure": "DOUBLE", "volume_sure": "DOUBLE", "bottler_sure": "DOUBLE", "warning_sure": "DOUBLE", "relative": "DOUBLE", "picture": "DOUBLE", "legible": "DOUBLE", "below": "BOOLEAN", "bold": "BOOLEAN", "size_ok": "BOOLEAN", "a_is_import": "BOOLEAN"}
PLAIN = {
    "brand_name": ("pass", "normalised-match:exact"), "class_type": ("pass", "normalised-match:exact"), "alcohol_content": ("pass", "abv-exact"), "net_contents": ("pass", "volume-equal"),
    "standard_of_fill": ("pass", "authorised-container-size"), "bottler": ("pass", "normalised-match:exact"), "country_of_origin": ("not_applicable", "not-an-import"), "label_legibility": ("pass", "legible-to-ordinary-eyesight"),
    "government_warning": ("pass", "warning-verbatim"), "warning_capitalisation": ("pass", "warning-header-caps"), "warning_prominence": ("pass", "warning-prominent"),
}
WINE, MALT = {"a_beverage_type": "'wine'"}, {"a_beverage_type": "'malt_beverage'"}
NO_FILL = {"standard_of_fill": None}
ALONE = {"warning_capitalisation": None, "warning_prominence": None}
EMPTY = ("not_applicable", "application-field-empty")
#: (what a case has instead, what it gives instead); None for a check that is not made.
CASES: list[tuple[dict, dict]] = [
    ({}, {}),
    ({"brand": "NULL"}, {"brand_name": ("fail", "mandatory-field-absent")}),
    ({"a_brand_name": "' '"}, {"brand_name": EMPTY}),
    ({"brand_sure": "0.3"}, {"brand_name": ("unreadable", "low-transcription-confidence")}),
    ({"brand": f"concat(' ', {BRAND}, '  ')"}, {"brand_name": ("pass", "normalised-match:whitespace")}),
    ({"brand": f"upper({BRAND})"}, {"brand_name": ("pass", "normalised-match:case")}),
    ({"brand": f"concat({BRAND}, '!')"}, {"brand_name": ("pass", "normalised-match:punctuation")}),
    ({"brand": f"concat('The ', {BRAND})"}, {"brand_name": ("pass", "normalised-match:synonyms")}),
    ({"brand": f"concat({BRAND}, 'x')"}, {"brand_name": ("review", "near-match-needs-review")}),
    ({"brand": "'Zzyzx Qqqq'"}, {"brand_name": ("fail", "mismatch")}),
    ({"a_brand_name": "'***'", "brand": "'!?'"}, {"brand_name": ("review", "near-match-needs-review")}),
    ({"class": "'Old Straight Bourbon'"}, {"class_type": ("review", "label-adds-words-needs-review")}),
    ({"bottler": f"concat('Bottled by ', {BOTTLER})"}, {"bottler": ("pass", "label-contains-application-value")}),
    ({"a_bottler_name": "'Quite Another Firm'", "a_label_company_name": BOTTLER}, {"bottler": ("pass", "normalised-match:exact:trade-name")}),
    ({"a_bottler_name": "'Quite Another Firm'", "a_label_company_name": "'And Not This'"}, {"bottler": ("fail", "mismatch")}),
    ({"bottler_sure": "0.1"}, {"bottler": ("unreadable", "low-transcription-confidence")}),
    ({"a_alcohol_content": "''"}, {"alcohol_content": EMPTY}),
    ({"a_alcohol_content": "''", "alcohol": "NULL"}, {"alcohol_content": EMPTY, "alcohol_present": ("fail", "alcohol-statement-absent")}),
    ({"a_alcohol_content": "''", "alcohol": "NULL"} | WINE, {"alcohol_content": EMPTY, "alcohol_present": ("review", "alcohol-statement-absent-conditional")}),
    ({"a_alcohol_content": "''", "alcohol": "NULL"} | MALT, {"alcohol_content": EMPTY} | NO_FILL),
    ({"alcohol": "NULL"}, {"alcohol_content": ("fail", "label-field-absent")}),
    ({"alcohol": "NULL"} | MALT, {"alcohol_content": ("review", "label-field-absent")} | NO_FILL),
    ({"alcohol_sure": "0.2"}, {"alcohol_content": ("unreadable", "low-transcription-confidence")}),
    ({"alcohol": "'full strength'"}, {"alcohol_content": ("review", "alcohol-unparseable")}),
    ({"alcohol": "'96% ALC/VOL'"}, {"alcohol_content": ("review", "alcohol-unparseable")}),
    ({"alcohol": "'200 PROOF'"}, {"alcohol_content": ("review", "alcohol-unparseable")}),
    ({"alcohol": "'45.2% ALC/VOL'"}, {"alcohol_content": ("review", "abv-within-tolerance")}),
    ({"alcohol": "'48% ALC/VOL'"}, {"alcohol_content": ("fail", "abv-outside-tolerance")}),
    ({"a_alcohol_content": "'12%'", "alcohol": "'13.5% ALC/VOL'"} | WINE, {"alcohol_content": ("review", "abv-within-tolerance")}),
    ({"a_alcohol_content": "'15%'", "alcohol": "'16.5% ALC/VOL'"} | WINE, {"alcohol_content": ("fail", "abv-outside-tolerance")}),
    ({"alcohol": "'45% ALC/VOL (100 PROOF)'"}, {"proof_consistency": ("fail", "proof-inconsistent-with-abv")}),
    ({"a_alcohol_content": "''", "alcohol": "'45% ALC/VOL (100 PROOF)'"}, {"alcohol_content": EMPTY, "proof_consistency": ("fail", "proof-inconsistent-with-abv")}),
    ({"volume": "NULL"}, {"net_contents": ("fail", "label-field-absent")} | NO_FILL),
    ({"volume_sure": "0.2"}, {"net_contents": ("unreadable", "low-transcription-confidence")} | NO_FILL),
    ({"a_net_contents": "''"}, {"net_contents": EMPTY}),
    ({"volume": "'one bottle'"}, {"net_contents": ("review", "volume-unparseable")} | NO_FILL),
    ({"volume": "'1 L'"}, {"net_contents": ("fail", "volume-mismatch")}),
    ({"a_net_contents": "'740 mL'", "volume": "'740 mL'"}, {"standard_of_fill": ("fail", "unauthorised-container-size")}),
    ({"a_net_contents": "'20 L'", "volume": "'20 L'"} | WINE, NO_FILL),
    ({"warning": "NULL"}, {"government_warning": ("fail", "warning-absent")} | ALONE),
    ({"warning_sure": "0.2"}, {"government_warning": ("unreadable", "low-transcription-confidence")} | ALONE),
    ({"warning": f"replace({STATUTE}, 'may cause', 'might cause')"}, {"government_warning": ("fail", "warning-wording-altered")}),
    ({"warning": f"replace({STATUTE}, 'GOVERNMENT WARNING', 'Government Warning')"}, {"warning_capitalisation": ("fail", "warning-header-not-caps")}),
    ({"bold": "false"}, {"warning_prominence": ("fail", "warning-insufficiently-prominent")}),
    ({"size_ok": "false"}, {"warning_prominence": ("fail", "warning-insufficiently-prominent")}),
    ({"relative": "0.3"}, {"label_legibility": ("fail", "warning-below-measured-legibility")}),
    ({"below": "true"}, {"label_legibility": ("fail", "below-ordinary-eyesight")}),
    ({"legible": "0.55"}, {"label_legibility": ("review", "legibility-marginal")}),
    ({"a_is_import": "true"}, {"country_of_origin": ("fail", "origin-absent-on-import")}),
    ({"a_is_import": "true", "a_country_of_origin": "'Scotland'", "origin": "'Product of Scotland'"}, {"country_of_origin": ("pass", "label-contains-application-value")}),
    ({"a_is_import": "true", "origin": "'Product of Scotland'"}, {"country_of_origin": EMPTY}),
    ({"a_is_import": "true", "a_country_of_origin": "'Scotland'", "origin": "'Norway'"}, {"country_of_origin": ("fail", "mismatch")}),
    ({"picture": "0.3"}, {k: ("unreadable", "image-not-reviewable") for k in PLAIN if k != "country_of_origin"}),
]


def _input(name: str) -> str:
    """A column by case, as SQL for both engines."""
    other = "".join(f" WHEN {k} THEN {case[name]}" for k, (case, _) in enumerate(CASES) if name in case)
    plain = INPUTS[name]
    value = f"CASE v{other} ELSE {plain} END" if other else plain
    return f"CAST({value} AS {KINDS.get(name, 'STRING')}) AS {name}"


CASE_ROWS = f"SELECT p_partkey, v, concat('A-', CAST(p_partkey AS STRING)) AS a_application_id, {', '.join(map(_input, INPUTS))} FROM (SELECT p_partkey, p_name, p_partkey % {len(CASES)} AS v FROM {{part}}) AS p"
WANTED = ", ".join(f"({k}, '{i}', '{x[0]}', '{x[1]}')" for k, (_, gives) in enumerate(CASES) for i, x in (PLAIN | gives).items() if x)


def case_readings(d: DataFrame) -> DataFrame:
    """The case columns as verify_pairs() wants them."""
    said = lambda c, sure: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text"), sure.alias("confidence"))).cast(READING)
    appearance = F.when(F.col("relative").isNotNull(), F.struct(F.lit(2.0).alias("m"), F.col("relative").alias("r"), F.lit("#000000").alias("t"), F.lit("#ffffff").alias("b"))).cast(APPEARANCE)
    warning = F.struct(F.col("warning").alias("text"), F.col("warning_sure").alias("confidence"), F.lit(True).alias("caps"), F.col("bold").alias("bold"), F.col("size_ok").alias("size"), F.lit(None).alias("bounds"), appearance.alias("appearance")).cast(WARNING)
    none, sure = F.array().cast("array<string>"), F.lit(0.9)
    return d.withColumns({
        "brand_name": said("brand", F.col("brand_sure")), "class_type": said("class", sure), "alcohol_content": said("alcohol", F.col("alcohol_sure")), "net_contents": said("volume", F.col("volume_sure")),
        "bottler_name": said("bottler", F.col("bottler_sure")), "country_of_origin": said("origin", sure), "government_warning": F.when(F.col("warning").isNotNull(), warning),
        "image_quality": F.struct(F.col("picture").alias("score"), none.alias("issues"), F.lit(False).alias("poor")).cast(QUALITY), "label_legibility": F.struct(F.col("legible").alias("score"), F.col("below").alias("below"), none.alias("issues")).cast(LEGIBILITY),
        "notes": none, "extraction_ms": F.lit(1000).cast("long"), "reader": F.lit("table"),
    })


def case_reports(d: DataFrame) -> DataFrame:
    return verify_pairs(case_readings(spread(d)), "p_partkey")


@query(CASE_ROWS, f"SELECT given.v, w.id, w.verdict, w.rule, count(*) AS n FROM given JOIN (VALUES {WANTED}) AS w(v, id, verdict, rule) ON w.v = given.v GROUP BY ALL")
def rule_ids(d: DataFrame) -> DataFrame:
    made = rollup.explode_checks(case_reports(d), "p_partkey")
    return made.groupBy((F.col("p_partkey") % len(CASES)).alias("v"), "id", "verdict", "rule").agg(F.count(F.lit(1)).alias("n"))


def _gravest(gives: dict) -> str:
    verdicts = [x[0] for x in (PLAIN | gives).values() if x]
    return "reject" if "fail" in verdicts else "needs_review" if {"review", "unreadable"} & set(verdicts) else "approve"


@query(CASE_ROWS, f"SELECT p_partkey, w.recommendation, w.checks FROM given JOIN (VALUES {', '.join(f'({k}, {_gravest(g)!r}, CAST({sum(1 for x in (PLAIN | g).values() if x)} AS INT))' for k, (_, g) in enumerate(CASES))}) AS w(v, recommendation, checks) ON w.v = given.v")
def rule_recommendations(d: DataFrame) -> DataFrame:
    return case_reports(d).select("p_partkey", "recommendation", F.size("checks").alias("checks"))


@query(CASE_ROWS, f"SELECT p_partkey, substr(warning, 1, 40) AS shown FROM given WHERE warning IS NOT NULL AND warning_sure >= 0.5")
def warning_prefix(d: DataFrame) -> DataFrame:
    made = rollup.explode_checks(case_reports(d), "p_partkey")
    return made.where("id = 'warning_capitalisation'").select("p_partkey", F.col("found").alias("shown"))


@query(
    CASE_ROWS,
    f"""SELECT p_partkey, count(*) FILTER (w.id IN ('brand_name', 'class_type', 'alcohol_content', 'net_contents', 'bottler') AND rule <> 'mandatory-field-absent' OR w.id = 'country_of_origin' AND rule NOT IN ('not-an-import', 'origin-absent-on-import', 'mandatory-field-absent')) AS compared,
        bool_or(w.id = 'government_warning' AND rule = 'warning-absent') AS no_warning FROM given JOIN (VALUES {WANTED}) AS w(v, id, verdict, rule) ON w.v = given.v WHERE given.picture > 0.5 GROUP BY 1""",
)
def report_groups(d: DataFrame) -> DataFrame:
    r = case_reports(d.where("picture > 0.5"))
    return r.select("p_partkey", F.size(rollup.of_category(F.col("checks"), "match")).cast("long").alias("compared"), rollup.has_rule(F.col("checks"), "government_warning", "fail", "warning-absent").alias("no_warning"))
