import copy

import pytest
from proofline.constants import STATUTORY_WARNING
from proofline.operators import rollup
from proofline.operators.rules import verify_labels
from proofline.schemas import APPLICATION, EXTRACTION
from pyspark.sql import functions as F

APP = {
    "application_id": "A-1", "ttb_id": None, "beverage_type": "distilled_spirits", "brand_name": "Old Tom Distillery", "class_type": "Kentucky Straight Bourbon Whiskey", "alcohol_content": "45% Alc./Vol. (90 Proof)",
    "net_contents": "750 mL", "bottler_name": "Old Tom Distillery", "label_company_name": None, "country_of_origin": None, "is_import": False,
}
WARNING = {"text": STATUTORY_WARNING, "confidence": 0.98, "header_is_all_caps": True, "header_is_bold": True, "legible_size": True, "bounds": None, "appearance": None}
READ = {
    "brand_name": ("OLD TOM DISTILLERY", 0.98), "class_type": ("Kentucky Straight Bourbon Whiskey", 0.97), "alcohol_content": ("45% Alc./Vol. (90 Proof)", 0.96), "net_contents": ("750 mL", 0.96),
    "bottler_name": ("Bottled by Old Tom Distillery, Bardstown, KY", 0.9), "country_of_origin": None, "government_warning": WARNING, "image_quality": (0.92, [], False), "label_legibility": (0.9, False, []),
    "notes": [], "extraction_ms": 1500, "reader": "table",
}
W, M = {"beverage_type": "wine"}, {"beverage_type": "malt_beverage"}
IMPORT = {"is_import": True, "country_of_origin": "Scotland"}


def warn(**k):
    return {"government_warning": WARNING | k}


def seen(relative, measured=3.0):
    return warn(appearance=(measured, relative, "#000000", "#ffffff"))


#: name: (application changes, reading changes, expected {check id: (verdict, rule)}, recommendation)
CASES = {
    "compliant": ({}, {}, {"brand_name": ("pass", "normalised-match:case"), "class_type": ("pass", "normalised-match:exact"), "alcohol_content": ("pass", "abv-exact"), "net_contents": ("pass", "volume-equal"), "standard_of_fill": ("pass", "authorised-container-size"), "bottler": ("pass", "label-contains-application-value"), "country_of_origin": ("not_applicable", "not-an-import"), "label_legibility": ("pass", "legible-to-ordinary-eyesight"), "government_warning": ("pass", "warning-verbatim"), "warning_capitalisation": ("pass", "warning-header-caps"), "warning_prominence": ("pass", "warning-prominent"), "proof_consistency": None, "alcohol_present": None}, "approve"),
    "brand absent": ({}, {"brand_name": None}, {"brand_name": ("fail", "mandatory-field-absent")}, "reject"),
    "brand not filed": ({"brand_name": " "}, {}, {"brand_name": ("not_applicable", "application-field-empty")}, "approve"),
    "brand guessed": ({}, {"brand_name": ("OLD TOM DISTILLERY", 0.49)}, {"brand_name": ("unreadable", "low-transcription-confidence")}, "needs_review"),
    "brand at the gate": ({}, {"brand_name": ("OLD TOM DISTILLERY", 0.5)}, {"brand_name": ("pass", "normalised-match:case")}, "approve"),
    "brand close": ({}, {"brand_name": ("OLD TOM DISTILERY", 0.9)}, {"brand_name": ("review", "near-match-needs-review")}, "needs_review"),
    "brand other": ({}, {"brand_name": ("Blue Heron", 0.9)}, {"brand_name": ("fail", "mismatch")}, "reject"),
    "class adds words": ({"class_type": "Gin"}, {"class_type": ("SLOE GIN", 0.9)}, {"class_type": ("review", "label-adds-words-needs-review")}, "needs_review"),
    "abv off": ({}, {"alcohol_content": ("40% Alc./Vol.", 0.9)}, {"alcohol_content": ("fail", "abv-outside-tolerance")}, "reject"),
    "abv within": ({"alcohol_content": "40% alc"}, {"alcohol_content": ("40.3% alc", 0.9)}, {"alcohol_content": ("review", "abv-within-tolerance")}, "needs_review"),
    "abv edge of a double": ({"alcohol_content": "13.2% alc"}, {"alcohol_content": ("13.5% alc", 0.9)}, {"alcohol_content": ("fail", "abv-outside-tolerance")}, "reject"),
    "wine to 14": (W | {"alcohol_content": "14% alc"}, {"alcohol_content": ("15.5% alc", 0.9)}, {"alcohol_content": ("review", "abv-within-tolerance")}, "needs_review"),
    "wine above 14": (W | {"alcohol_content": "14.5% alc"}, {"alcohol_content": ("16% alc", 0.9)}, {"alcohol_content": ("fail", "abv-outside-tolerance")}, "reject"),
    "abv no number": ({}, {"alcohol_content": ("strong", 0.9)}, {"alcohol_content": ("review", "alcohol-unparseable"), "proof_consistency": None}, "needs_review"),
    "abv guessed": ({}, {"alcohol_content": ("45%", 0.1)}, {"alcohol_content": ("unreadable", "low-transcription-confidence")}, "needs_review"),
    "abv absent": ({}, {"alcohol_content": None}, {"alcohol_content": ("fail", "label-field-absent")}, "reject"),
    "abv absent, malt": (M, {"alcohol_content": None}, {"alcohol_content": ("review", "label-field-absent"), "standard_of_fill": None}, "needs_review"),
    "proof contradicts": ({}, {"alcohol_content": ("45% Alc./Vol. (95 Proof)", 0.9)}, {"alcohol_content": ("pass", "abv-exact"), "proof_consistency": ("fail", "proof-inconsistent-with-abv")}, "reject"),
    "none filed": ({"alcohol_content": None}, {}, {"alcohol_content": ("not_applicable", "application-field-empty"), "alcohol_present": None, "proof_consistency": None}, "approve"),
    "none filed or shown, spirits": ({"alcohol_content": None}, {"alcohol_content": None}, {"alcohol_present": ("fail", "alcohol-statement-absent")}, "reject"),
    "none filed or shown, wine": (W | {"alcohol_content": ""}, {"alcohol_content": None}, {"alcohol_present": ("review", "alcohol-statement-absent-conditional")}, "needs_review"),
    "none filed or shown, malt": (M | {"alcohol_content": ""}, {"alcohol_content": None}, {"alcohol_present": None}, "approve"),
    "none filed, proof contradicts, guessed": ({"alcohol_content": None}, {"alcohol_content": ("45% alc 95 proof", 0.1)}, {"proof_consistency": ("fail", "proof-inconsistent-with-abv")}, "reject"),
    "volume absent": ({}, {"net_contents": None}, {"net_contents": ("fail", "label-field-absent"), "standard_of_fill": None}, "reject"),
    "volume guessed": ({}, {"net_contents": ("750 mL", 0.2)}, {"net_contents": ("unreadable", "low-transcription-confidence"), "standard_of_fill": None}, "needs_review"),
    "volume not filed": ({"net_contents": None}, {}, {"net_contents": ("not_applicable", "application-field-empty"), "standard_of_fill": ("pass", "authorised-container-size")}, "approve"),
    "volume no number": ({}, {"net_contents": ("one bottle", 0.9)}, {"net_contents": ("review", "volume-unparseable"), "standard_of_fill": None}, "needs_review"),
    "volume other unit": ({}, {"net_contents": ("75 cL", 0.9)}, {"net_contents": ("pass", "volume-equal")}, "approve"),
    "volume off": ({}, {"net_contents": ("700 mL", 0.9)}, {"net_contents": ("fail", "volume-mismatch"), "standard_of_fill": ("pass", "authorised-container-size")}, "reject"),
    "volume unauthorised": ({"net_contents": "800 mL"}, {"net_contents": ("800 mL", 0.9)}, {"net_contents": ("pass", "volume-equal"), "standard_of_fill": ("fail", "unauthorised-container-size")}, "reject"),
    "trade name": ({"label_company_name": "Tom & Sons", "bottler_name": "Holding X"}, {"bottler_name": ("Bottled by Tom and Sons", 0.9)}, {"bottler": ("pass", "label-contains-application-value:trade-name")}, "approve"),
    "trade name other": ({"label_company_name": "Nobody", "bottler_name": "Holding X"}, {}, {"bottler": ("fail", "mismatch")}, "reject"),
    "import": (IMPORT, {"country_of_origin": ("Product of Scotland", 0.9)}, {"country_of_origin": ("pass", "label-contains-application-value")}, "approve"),
    "import without origin": (IMPORT, {}, {"country_of_origin": ("fail", "origin-absent-on-import")}, "reject"),
    "import, origin not filed": ({"is_import": True}, {"country_of_origin": ("Scotland", 0.9)}, {"country_of_origin": ("not_applicable", "application-field-empty")}, "approve"),
    "warning absent": ({}, {"government_warning": None}, {"government_warning": ("fail", "warning-absent"), "warning_capitalisation": None}, "reject"),
    "warning guessed": ({}, warn(confidence=0.3), {"government_warning": ("unreadable", "low-transcription-confidence"), "warning_prominence": None}, "needs_review"),
    "warning reworded": ({}, warn(text=STATUTORY_WARNING.replace("may", "might")), {"government_warning": ("fail", "warning-wording-altered")}, "reject"),
    "warning title case": ({}, warn(text=STATUTORY_WARNING.replace("GOVERNMENT WARNING", "Government Warning")), {"government_warning": ("pass", "warning-verbatim"), "warning_capitalisation": ("fail", "warning-header-not-caps")}, "reject"),
    "warning wrapped": ({}, warn(text=STATUTORY_WARNING.replace("GOVERNMENT WARNING", "GOVERNMENT \nWARNING")), {"warning_capitalisation": ("pass", "warning-header-caps")}, "approve"),
    "warning not bold": ({}, warn(header_is_bold=False), {"warning_prominence": ("fail", "warning-insufficiently-prominent")}, "reject"),
    "warning faint": ({}, seen(0.28), {"label_legibility": ("fail", "warning-below-measured-legibility")}, "reject"),
    "warning as clear as the rest": ({}, seen(0.93), {"label_legibility": ("pass", "legible-to-ordinary-eyesight")}, "approve"),
    "small print": ({}, {"label_legibility": (0.9, True, ["tiny"])}, {"label_legibility": ("fail", "below-ordinary-eyesight")}, "reject"),
    "marginal print": ({}, {"label_legibility": (0.59, False, [])}, {"label_legibility": ("review", "legibility-marginal")}, "needs_review"),
    "picture too poor": ({}, {"image_quality": (0.4, [], False), "brand_name": ("Blue Heron", 0.9)}, {"brand_name": ("unreadable", "image-not-reviewable"), "label_legibility": ("unreadable", "image-not-reviewable"), "country_of_origin": ("not_applicable", "not-an-import")}, "needs_review"),
    "picture declared too poor": ({}, {"image_quality": (0.9, [], True)}, {"government_warning": ("unreadable", "image-not-reviewable")}, "needs_review"),
}


@pytest.fixture(scope="module")
def reports(spark):
    apps, reads = [], []
    for name, (a, r, _, _) in CASES.items():
        apps.append((name, *(APP | a).values()))
        read = copy.deepcopy(READ | r)
        read["government_warning"] = read["government_warning"] and tuple(read["government_warning"].values())
        reads.append((name, *read.values()))
    out = verify_labels(spark.createDataFrame(apps, "filename_key string, " + APPLICATION), spark.createDataFrame(reads, "filename_key string, " + EXTRACTION)).cache()
    assert out.count() == len(CASES)
    return out


@pytest.fixture(scope="module")
def rows(reports):
    return {r.filename_key: r for r in reports.collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(rows, name):
    got = {c.id: (c.verdict, c.rule) for c in rows[name].checks}
    _, _, want, recommendation = CASES[name]
    assert {k: got.get(k) for k in want} == want
    assert rows[name].recommendation == recommendation


def test_order_and_conservation(rows):
    order = ["brand_name", "class_type", "alcohol_content", "proof_consistency", "alcohol_present", "net_contents", "standard_of_fill", "bottler", "country_of_origin", "label_legibility", "government_warning", "warning_capitalisation", "warning_prominence"]
    for r in rows.values():
        ids = [c.id for c in r.checks]
        assert ids == sorted(ids, key=order.index) and len(ids) == len(set(ids))
        assert all(c.verdict and c.rule and c.name and c.category for c in r.checks)


def test_every_rule_is_met(rows):
    seen_rules = {c.rule.split(":")[0] for r in rows.values() for c in r.checks}
    assert len(seen_rules) == 35


def test_case_does_not_matter(spark):
    apps, reads = [], []
    for k, f in enumerate((str, str.upper, str.lower, str.swapcase)):
        apps.append((str(k), *APP.values()))
        read = dict(READ) | {c: (f(READ[c][0]), 0.9) for c in ("brand_name", "class_type", "bottler_name")}
        read["government_warning"] = tuple(WARNING.values())
        reads.append((str(k), *read.values()))
    out = verify_labels(spark.createDataFrame(apps, "filename_key string, " + APPLICATION), spark.createDataFrame(reads, "filename_key string, " + EXTRACTION))
    assert [r.recommendation for r in out.collect()] == ["approve"] * 4


def test_rollups(spark, reports):
    items = reports.select(F.concat("filename_key", F.lit(".png")).alias("filename"), "application_id", "brand_name", "recommendation", "headline", "checks", F.lit(None).cast("string").alias("error"), F.lit(1250).alias("elapsed_ms"))
    odd = items.limit(2).withColumns({"recommendation": F.lit(None).cast("string"), "headline": F.lit(None).cast("string"), "checks": F.lit(None).cast(items.schema["checks"].dataType)})
    items = rollup.item_status(items.unionByName(odd.limit(1).withColumn("error", F.lit("no picture"))).unionByName(odd.limit(1).withColumn("filename", F.lit("q")).withColumn("application_id", F.lit(None).cast("string"))))
    want = [x[3] for x in CASES.values()]
    s = rollup.batch_summary(items).first()
    assert (s.approve, s.needs_review, s.reject, s.failed, s.pending) == (want.count("approve"), want.count("needs_review"), want.count("reject"), 1, 1)
    assert rollup.needs_attention(items).count() == len(want) - want.count("approve") + 1
    ready = rollup.ready_counts(items).first()
    assert (ready.ready, ready.unmatched) == (0, 1)
    exported = {r.File: r for r in rollup.export_rows(items).collect() if r.Recommendation != "ERROR"}
    assert len(exported) == len(want) and exported["brand other.png"]["Failed checks"].startswith("Brand Name: ") and exported["compliant.png"].Seconds == "1.3"
    bad = rollup.export_rows(items).where("Recommendation = 'ERROR'").first()
    assert bad.Summary == "no picture" and bad["Failed checks"] == ""
    checks = rollup.explode_checks(reports)
    assert checks.where("filename_key = 'compliant'").orderBy("check_seq").first().id == "brand_name"
    ranked = reports.select("filename_key", rollup.by_severity(F.col("checks")).alias("c")).where("filename_key = 'proof contradicts'").first().c
    assert [c.verdict for c in ranked] == ["fail"] + ["pass"] * 10 + ["not_applicable"] and ranked[1].id == "brand_name"
    assert reports.where(rollup.has_rule(F.col("checks"), "government_warning", "fail", "warning-wording-altered")).count() == 1


def test_hot_application_is_the_work_of_many_tasks(spark):
    """All readings are one application's: their reports come from many tasks, about as many each (one task before)."""
    from proofline.plans.base import derived
    from proofline.plans.label_queries import readings
    from proofline.plans.stream_queries import FILED, ONE_PAIR, READINGS

    sf = "/root/testdata/sf0.001"
    applications = derived(spark, sf, ONE_PAIR).where("filename_key = 1").withColumnsRenamed({c: c.removeprefix("a_") for c in FILED})
    columns = [c.split(" ", 1)[0] for c in EXTRACTION.split(", ")]
    read = readings(derived(spark, sf, READINGS)).select(F.lit(1).cast("long").alias("filename_key"), *columns)
    got = verify_labels(applications.withColumn("filename_key", F.col("filename_key").cast("long")), read)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == read.count() > 100
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 3 * sum(sizes) / len(sizes)
