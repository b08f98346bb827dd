"""The rules: each turns an application and a reading into check structs, as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EQUAL_VOLUME_ML, MARGINAL_LEGIBILITY, MIN_CONFIDENCE, MIN_IMAGE_SCORE, MIN_RELATIVE_CONTRAST, REVIEW_SIMILARITY
from ..functions.fills import check_fill
from ..functions.parse import alcohol_text, format_volume, parse_alcohol, parse_volume, proof_consistent, tolerance, volume_text
from ..functions.text import combined_similarity, contains_all, extra_tokens, forms, is_blank, ladder_level, plain_number, trimmed
from ..functions.warning import assess, compatible, warning_diff, words
from ..sources.shared import evenly
from .rollup import override_unreviewable, reviewable, summarise


def check(id: str, name: str, category: str, verdict, rule, explanation, expected=None, found=None, citation=None, confidence=None) -> Column:
    """One check struct; plain strings are literals, None is null."""
    values = {"id": id, "name": name, "category": category, "verdict": verdict, "expected": expected, "found": found, "rule": rule, "explanation": explanation, "citation": citation, "confidence": confidence}
    cols = [(v if isinstance(v, Column) else F.lit(v)).cast("double" if k == "confidence" else "string").alias(k) for k, v in values.items()]
    return F.struct(*cols)


def uncertain(reading: Column) -> Column:
    """The reader was guessing. An absent reading is absent, not uncertain."""
    return F.coalesce(reading["confidence"] < MIN_CONFIDENCE, F.lit(False))


def unreadable(id: str, name: str, category: str, reading: Column, citation, expected=None) -> Column:
    return check(id, name, category, "unreadable", "low-transcription-confidence", f"The {name.lower()} was read with too little confidence; a clearer picture is needed.", expected, reading["text"], citation, reading["confidence"])


def compare_text(id: str, name: str, expected: Column, reading: Column, expected_forms: Column, found_forms: Column, citation: str, subset: str | None = None) -> Column:
    """A text field: absent, not filed, unreadable, equal at some rung, contained (verdict `subset`), similar, or different."""
    found, confidence = reading["text"], reading["confidence"]
    known = {"expected": expected, "found": found, "citation": citation, "confidence": confidence}
    level = ladder_level(expected_forms, found_forms)
    wanted, had = expected_forms["tokens"], found_forms["tokens"]
    similarity = combined_similarity(F.lower(expected), F.lower(found), wanted, had)
    out = (
        F.when(reading.isNull(), check(id, name, "compliance", "fail", "mandatory-field-absent", f"The label shows no {name.lower()}, which every container must.", expected, citation=citation))
        .when(is_blank(expected), check(id, name, "match", "not_applicable", "application-field-empty", f"No {name.lower()} was filed to compare with.", found=found, citation=citation))
        .when(uncertain(reading), unreadable(id, name, "match", reading, citation, expected))
        .when(level.isNotNull(), check(id, name, "match", "pass", F.concat(F.lit("normalised-match:"), level), F.concat(F.lit("Label and application agree; level of comparison: "), level), **known))
    )
    if subset:
        rule = "label-contains-application-value" if subset == "pass" else "label-adds-words-needs-review"
        more = F.concat(F.lit("All that was filed is on the label, which adds: "), F.array_join(extra_tokens(had, wanted), ", "))
        out = out.when(contains_all(had, wanted), check(id, name, "match", subset, rule, more, **known))
    close = F.format_string("Close but not the same: %d %% alike.", F.floor(similarity * 100 + 0.5))
    out = out.when(similarity >= REVIEW_SIMILARITY, check(id, name, "match", "review", "near-match-needs-review", close, **known))
    return out.otherwise(check(id, name, "match", "fail", "mismatch", "Label and application name different things.", **known))


def _proof_check(reading: Column, printed: Column, citation) -> Column:
    said = F.concat(plain_number(printed["abv"]), F.lit(" % by volume is not "), plain_number(printed["proof"]), F.lit(" proof."))
    bad = check("proof_consistency", "Proof Statement", "compliance", "fail", "proof-inconsistent-with-abv", said, found=reading["text"], citation=citation, confidence=reading["confidence"])
    return F.when(~F.coalesce(proof_consistent(printed), F.lit(True)), bad)


def alcohol_checks(beverage: Column, filed: Column, reading: Column, declared: Column, printed: Column) -> Column:
    """The alcohol statement against what was filed, or by itself where nothing was: one or two checks."""
    id, name = "alcohol_content", "Alcohol Content"
    citation = F.when(beverage == "wine", "27 CFR 4.36").otherwise("27 CFR 5.65")
    known = {"expected": filed, "found": reading["text"], "citation": citation, "confidence": reading["confidence"]}
    malt = beverage == "malt_beverage"
    difference, allowed = F.abs(declared["abv"] - printed["abv"]), tolerance(beverage, declared["abv"])
    apart = F.concat(F.lit("Filed "), plain_number(declared["abv"]), F.lit(" %, printed "), plain_number(printed["abv"]), F.lit(" %; tolerance "), plain_number(allowed), F.lit("."))
    main = (
        F.when(reading.isNull(), check(id, name, "match", F.when(malt, "review").otherwise("fail"), "label-field-absent", "The label shows no alcohol statement.", filed, citation=citation))
        .when(uncertain(reading), unreadable(id, name, "match", reading, citation))
        .when(declared["abv"].isNull() | printed["abv"].isNull(), check(id, name, "match", "review", "alcohol-unparseable", "An alcohol statement is not a number; compare by eye.", **known))
        .when(difference == 0, check(id, name, "match", "pass", "abv-exact", apart, **known))
        .when(difference <= allowed, check(id, name, "match", "review", "abv-within-tolerance", apart, **known))
        .otherwise(check(id, name, "match", "fail", "abv-outside-tolerance", apart, **known))
    )
    compared = reading.isNotNull() & ~uncertain(reading) & declared["abv"].isNotNull() & printed["abv"].isNotNull()
    matched = F.array_compact(F.array(main, F.when(compared, _proof_check(reading, printed, "27 CFR 5.65"))))
    blank = check(id, name, "match", "not_applicable", "application-field-empty", "No alcohol content was filed to compare with.", found=reading["text"], citation=citation)
    present = lambda verdict, rule, cited: check("alcohol_present", "Alcohol Content Statement", "compliance", verdict, rule, "The label shows no alcohol statement.", citation=cited)
    absent = F.when(beverage == "distilled_spirits", present("fail", "alcohol-statement-absent", "27 CFR 5.63")).when(beverage == "wine", present("review", "alcohol-statement-absent-conditional", "27 CFR 4.36"))
    alone = F.array_compact(F.array(blank, F.when(reading.isNull(), absent).otherwise(_proof_check(reading, printed, citation))))
    return F.when(is_blank(filed), alone).otherwise(matched)


def volume_checks(beverage: Column, filed: Column, reading: Column, declared: Column, printed: Column) -> Column:
    """Net contents against what was filed, and against the authorised sizes: one or two checks."""
    id, name = "net_contents", "Net Contents"
    citation = F.when(beverage == "wine", "27 CFR 4.72").otherwise("27 CFR 5.203")
    known = {"expected": filed, "found": reading["text"], "citation": citation, "confidence": reading["confidence"]}
    both = F.concat(F.lit("Filed "), format_volume(declared["ml"]), F.lit(", printed "), format_volume(printed["ml"]), F.lit("."))
    main = (
        F.when(reading.isNull(), check(id, name, "match", "fail", "label-field-absent", "The label shows no net contents.", filed, citation=citation))
        .when(uncertain(reading), unreadable(id, name, "match", reading, citation))
        .when(is_blank(filed), check(id, name, "match", "not_applicable", "application-field-empty", "No net contents were filed to compare with.", found=reading["text"], citation=citation))
        .when(declared["ml"].isNull() | printed["ml"].isNull(), check(id, name, "match", "review", "volume-unparseable", "A net contents statement is not a volume; compare by eye.", **known))
        .when(F.abs(declared["ml"] - printed["ml"]) < EQUAL_VOLUME_ML, check(id, name, "match", "pass", "volume-equal", both, **known))
        .otherwise(check(id, name, "match", "fail", "volume-mismatch", both, **known))
    )
    fill = check_fill(beverage, printed["ml"])
    said = {"found": reading["text"], "citation": citation}
    near = F.concat(format_volume(printed["ml"]), F.lit(" is no authorised size; nearest: "), F.array_join(F.transform(fill["nearest"], format_volume), " or "))
    size = F.when(fill["authorised"], check("standard_of_fill", "Standard of Fill", "compliance", "pass", "authorised-container-size", "An authorised container size.", **said))
    size = size.otherwise(check("standard_of_fill", "Standard of Fill", "compliance", "fail", "unauthorised-container-size", near, **said))
    applies = reading.isNotNull() & ~uncertain(reading) & ~fill["not_applicable"] & printed["ml"].isNotNull()
    return F.array_compact(F.array(main, F.when(applies, size)))


def bottler_check(legal: Column, trade: Column, applicant: Column, trade_name: Column) -> Column:
    """The legal name counts first; the trade name only if it passes where the legal name does not."""
    via = trade.withField("expected", F.concat(trade_name, F.lit(" (trade name of "), F.coalesce(applicant, F.lit("no stated applicant")), F.lit(")")))
    via = via.withField("rule", F.concat(trade["rule"], F.lit(":trade-name")))
    return F.when(is_blank(trade_name) | (legal["verdict"] == "pass") | (trade["verdict"] != "pass"), legal).otherwise(via)


def origin_check(is_import: Column, filed: Column, reading: Column, compared: Column) -> Column:
    id, name, citation = "country_of_origin", "Country of Origin", "27 CFR 5.69"
    home = check(id, name, "compliance", "not_applicable", "not-an-import", "Not filed as an import, so no origin is required.", citation=citation)
    absent = check(id, name, "compliance", "fail", "origin-absent-on-import", "An import's label must show its origin.", filed, citation=citation)
    return F.when(~F.coalesce(is_import, F.lit(False)), home).when(reading.isNull(), absent).otherwise(compared)


def legibility_check(quality: Column, legibility: Column, warning: Column) -> Column:
    """Whether the print can be read: by measured contrast first, then by what the reader says."""
    id, name, citation = "label_legibility", "Legibility to the Naked Eye", "27 CFR 5.55, 16.22"
    relative = warning["appearance"]["relative_contrast"]
    score = legibility["score"]
    issues = F.concat(F.lit("Noted: "), F.array_join(legibility["issues"], "; "))
    say = lambda verdict, rule, text, sure=None: check(id, name, "compliance", verdict, rule, text, citation=citation, confidence=sure)
    return (
        F.when(~reviewable(quality), say("unreadable", "legibility-unassessable", "The picture does not show whether the print can be read."))
        .when(relative < MIN_RELATIVE_CONTRAST, say("fail", "warning-below-measured-legibility", F.format_string("Measured: the warning has %.2f of the contrast of the rest.", relative)))
        .when(legibility["below_ordinary_eyesight"], say("fail", "below-ordinary-eyesight", issues, score))
        .when(score < MARGINAL_LEGIBILITY, say("review", "legibility-marginal", issues, score))
        .otherwise(say("pass", "legible-to-ordinary-eyesight", "The print can be read.", score))
    )


def warning_checks(reading: Column, assessed: Column) -> Column:
    """Wording, capitals and prominence of the mandatory warning; one check only if it is absent or unreadable."""
    id, name, citation = "government_warning", "Government Warning", "27 CFR 16.21"
    absent = check(id, name, "compliance", "fail", "warning-absent", "The label shows no warning, which every container must.", citation=citation)
    two = lambda ok, good, bad: (F.when(ok, "pass").otherwise("fail"), F.when(ok, good).otherwise(bad))
    exact = assessed["wording_exact"]
    wording = check(id, "Government Warning: Wording", "compliance", *two(exact, "warning-verbatim", "warning-wording-altered"), F.format_string("%d words missing, %d added or altered.", assessed["deletions"], assessed["insertions"]), found=reading["text"], citation=citation, confidence=reading["confidence"])
    caps = check("warning_capitalisation", "Government Warning: Capitals", "compliance", *two(assessed["header_caps"], "warning-header-caps", "warning-header-not-caps"), "The heading must be in capitals.", found=F.substring(reading["text"], 1, 40), citation=citation)
    shown = assessed["header_bold"] & assessed["legible_size"]
    prominent = check("warning_prominence", "Government Warning: Prominence", "compliance", *two(shown, "warning-prominent", "warning-insufficiently-prominent"), F.array_join(F.filter(assessed["problems"], lambda p: p.isin("heading not bold", "not readily legible")), ", "), citation="27 CFR 16.22")
    return F.when(reading.isNull(), F.array(absent)).when(uncertain(reading), F.array(unreadable(id, name, "compliance", reading, citation))).otherwise(F.array(wording, caps, prominent))


def verify_labels(applications: DataFrame, extractions: DataFrame, on: str = "filename_key", how: str = "inner") -> DataFrame:
    """One report a pair: (on, application_id, brand_name, recommendation, headline, checks, image_quality, notes, warning_diff, extraction_ms, reader).

    Two narrow steps after the join: all normal forms and numbers, then the checks, so that nothing is computed twice.
    Pairs are dealt out evenly before, whatever share of them one key has.
    """
    a = applications.select(on, *[F.col(c).alias(f"a_{c}") for c in applications.columns if c != on])
    joined = a.join(extractions, on, how)
    return verify_pairs(evenly(joined), on)


def verify_pairs(joined: DataFrame, on: str = "filename_key", keep: Sequence[str] = ()) -> DataFrame:
    """verify_labels() of rows that have both: the application's columns as a_*, the reading's as they are; `keep` names columns that stay."""
    col, filed = F.col, lambda c: F.col(f"a_{c}")
    text = lambda c: F.col(c)["text"]
    trade = trimmed(filed("label_company_name"))
    fields = ("brand_name", "class_type", "bottler_name", "country_of_origin")
    step = joined.withColumns(
        {f"_e_{f}": forms(filed(f)) for f in fields}
        | {f"_f_{f}": forms(text(f)) for f in fields}
        | {"_e_trade": forms(trade), "_alcohol_filed": alcohol_text(filed("alcohol_content")), "_alcohol_read": alcohol_text(text("alcohol_content"))}
        | {"_volume_filed": volume_text(filed("net_contents")), "_volume_read": volume_text(text("net_contents")), "_warning": compatible(text("government_warning"))}
    )
    step = step.withColumn("_diff", warning_diff(words(col("_warning"))))
    step = step.withColumns({
        "_declared": parse_alcohol(col("_alcohol_filed")), "_printed": parse_alcohol(col("_alcohol_read")),
        "_declared_ml": parse_volume(col("_volume_filed")), "_printed_ml": parse_volume(col("_volume_read")),
        "_assessed": assess(col("government_warning"), col("_warning"), col("_diff")),
    })
    compare = lambda id, name, f, citation, subset=None: compare_text(id, name, filed(f), col(f), col(f"_e_{f}"), col(f"_f_{f}"), citation, subset)
    legal = compare("bottler", "Bottler / Producer", "bottler_name", "27 CFR 5.66", "pass")
    via = compare_text("bottler", "Bottler / Producer", trade, col("bottler_name"), col("_e_trade"), col("_f_bottler_name"), "27 CFR 5.66", "pass")
    step = step.withColumns({"_legal": legal, "_trade": via})
    checks = F.concat(
        F.array(compare("brand_name", "Brand Name", "brand_name", "27 CFR 5.63"), compare("class_type", "Class / Type", "class_type", "27 CFR 5.63", "review")),
        alcohol_checks(filed("beverage_type"), filed("alcohol_content"), col("alcohol_content"), col("_declared"), col("_printed")),
        volume_checks(filed("beverage_type"), filed("net_contents"), col("net_contents"), col("_declared_ml"), col("_printed_ml")),
        F.array(
            bottler_check(col("_legal"), col("_trade"), filed("bottler_name"), trade),
            origin_check(filed("is_import"), filed("country_of_origin"), col("country_of_origin"), compare("country_of_origin", "Country of Origin", "country_of_origin", "27 CFR 5.69", "pass")),
            legibility_check(col("image_quality"), col("label_legibility"), col("government_warning")),
        ),
        warning_checks(col("government_warning"), col("_assessed")),
    )
    step = step.withColumn("checks", checks)
    step = step.withColumn("_summary", summarise(col("checks")))
    step = step.withColumns(override_unreviewable(col("image_quality"), col("checks"), col("_summary")))
    diff = F.when(col("government_warning").isNotNull(), col("_diff"))
    return step.select(on, filed("application_id").alias("application_id"), filed("brand_name").alias("brand_name"), "recommendation", "headline", "checks", "image_quality", "notes", diff.alias("warning_diff"), "extraction_ms", "reader", *keep)
