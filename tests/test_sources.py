import csv
import io
import json
import random
import zipfile
import zlib

import pytest

from proofline.constants import STATUTORY_WARNING
from proofline.operators import pictures, rollup, scores, sweeps
from proofline.operators.rules import verify_labels
from proofline.schemas import APPLICATION, EXTRACTION
from proofline.sources import readers, sinks
from pyspark.sql import functions as F

MANIFEST = 'File Name,Beverage_Type,brand-name,Class Type,isImport,brandname\r\nA.png,Beer,x,Ale,yes,"Smith, ""Old"" & Sons"\r\n,,,,,\r\nb.png,wine,y,"Red\nwine",no\r\n a.PNG ,spirits,z,Gin,1,Later\r\n,beer,n,Ale,no,No file\r\n'


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(MANIFEST.encode())
    rows = readers.read_csv(spark, str(tmp_path / "m.csv"))
    assert rows.count() == 4 and set(rows.columns) == {"filename", "beveragetype", "brandname", "classtype", "isimport", "_line"}
    got = {r.filename_key: r for r in readers.load_manifest(rows).collect()}
    assert set(got) == {"a.png", "b.png"}
    assert (got["a.png"].brand_name, got["a.png"].beverage_type, got["a.png"].is_import) == ("Later", "distilled_spirits", True)
    assert got["b.png"].class_type.split() == ["Red", "wine"] and got["b.png"].brand_name == ""
    (tmp_path / "e.csv").write_bytes(b"")
    assert readers.read_csv(spark, str(tmp_path / "e.csv")).count() == 0


def test_images_and_joins(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 20
    for name, data in {"A.png": png, "c.jpg": b"\xff\xd8\xff" + b"1" * 20, "d.txt": b"text of a file", "e.png": b""}.items():
        (tmp_path / name).write_bytes(data)
    images = readers.read_images(spark, str(tmp_path))
    assert {(r.filename_key, r.mime) for r in images.collect()} == {("a.png", "image/png"), ("c.jpg", "image/jpeg")}
    manifest = spark.createDataFrame([("a.png", "A")], "filename_key string, application_id string")
    assert {(r.filename_key, r.application_id) for r in readers.match_images(images, manifest).collect()} == {("a.png", "A"), ("c.jpg", None)}
    assert [r.filename_key for r in readers.unmatched_images(images, manifest).collect()] == ["c.jpg"]
    items = spark.createDataFrame([("a.png", "old"), ("z.png", "kept")], "filename_key string, application_id string")
    assert {r.application_id for r in readers.rekey(items, manifest).collect()} == {"A", "kept"}

    def reader(content):
        if content.startswith(b"\xff"):
            raise ValueError("cannot read")
        return {"notes": [str(len(content))]}

    got = {r.filename_key: r for r in readers.read_with(images, reader).collect()}
    assert json.loads(got["a.png"].reading) == {"notes": ["28"]} and got["c.jpg"].error == "cannot read"


def test_applications(spark):
    good = {"beverageType": "wine", "brandName": " Ash ", "classType": "Red", "isImport": True, "other": 1, "netContents": 750, "bottlerName": "  "}
    cases = [
        (good, None), (good | {"beverageType": "cider"}, "beverage_type: not one of three"), (good | {"brandName": " "}, "brand_name: missing"), (good | {"classType": None}, "class_type: missing"),
        (good | {"netContents": "x" * 301}, "net_contents: too long"), (good | {"isImport": "true"}, None), ([1], "application: not valid"), (good | {"other": "y" * 9000}, "application: too long"),
    ]
    raw = [(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(90, "{not json"), (91, None)]
    got = {r.k: r.p for r in spark.createDataFrame(raw, "k int, raw string").select("k", readers.parse_applications(F.col("raw")).alias("p")).collect()}
    assert [got[k].error for k in range(len(cases))] == [e for _, e in cases]
    assert got[90].error == got[91].error == "application: not valid" and got[90].value is None
    v = got[0].value
    assert (v.brand_name, v.net_contents, v.bottler_name, v.is_import) == ("Ash", None, None, True) and got[5].value.is_import is False


def test_requests_and_readings(spark):
    png = bytearray(b"\x89PNG\r\n\x1a\n" + b"0" * 20)
    rows = [(png, "x", "{}"), (bytearray(), "image/png", "{}"), (bytearray(b"0" * 20), "text/plain", "{}"), (png, "x", None), (None, None, None), (png, "x", "y" * 9000)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, content binary, mime string, application string")
    got = [r.e for r in df.select("k", readers.request_error(F.col("content"), F.col("mime"), F.col("application")).alias("e")).orderBy("k").collect()]
    assert got == [None, "image: missing", "image: not supported", "application: missing", "image: missing", "application: too long"]
    raw = [{"brand_name": {"text": "A", "confidence": 0.9}}, {"brand_name": {"text": "A", "confidence": 1.9}, "class_type": {"confidence": 0.5}, "image_quality": {"score": 7, "issues": []}, "label_legibility": {"score": -1}}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(raw)] + [(2, "{oops")], "k int, raw string")
    a, b, c = (r.p for r in df.select("k", readers.parse_extractions(F.col("raw")).alias("p")).orderBy("k").collect())
    assert a.error is None and a.value.image_quality.score == 0.5 and a.value.label_legibility.score == 0.75 and a.value.notes == [] and a.value.class_type is None
    assert b.value is None and len(b.error.split("; ")) == 3 and c.error == "reading: not valid"


def test_samples_and_readers(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"samples": [{"id": "b", "isDefault": True, "application": {"brand_name": "X", "is_import": False}, "expected": {"recommendation": "approve", "checks": {"brand_name": "pass"}}}, {"id": "a", "isDefault": False}]}))
    samples = readers.read_samples(spark, str(tmp_path / "s.json"))
    first = readers.default_sample(samples).first()
    assert first.id == "b" and first.application.brand_name == "X" and first.expected.checks == {"brand_name": "pass"}
    assert [readers.choose_reader(["r1", "r2"], p) for p in (None, "r2", "mock", "zz")] == ["r1", "r2", "mock", "r1"] and readers.choose_reader([]) == "mock"
    tries = [("a", 1, "busy", True, None), ("a", 2, None, None, "ok"), ("b", 1, "bad key", False, None), ("b", 2, None, None, "never"), ("c", 1, None, None, "at once")]
    got = readers.first_success(spark.createDataFrame(tries, "filename_key string, attempt int, error string, retryable boolean, reading string")).collect()
    assert {(r.filename_key, r.reading) for r in got} == {("a", "ok"), ("c", "at once")}
    assert readers.constant_reading(spark.createDataFrame([("k",)], "filename_key string"), F.struct(F.lit(1).alias("x"))).first().x == 1
    doc = "# Sizes\n\ntext\n```\n750 mL, 1 L\n50 mL\n```\n## Other\n```\n9 mL\n```"
    sizes = readers.listed_sizes(spark.createDataFrame([(doc,)], "value string"), "# Sizes")
    assert [r.ml for r in sizes.collect()] == [50, 750, 1000]
    code = spark.createDataFrame([(750.0,), (60.0,)], "ml double")
    assert {(r.ml, r.side) for r in readers.difference(sizes, code, "ml").collect()} == {(50.0, "left"), (1000.0, "left"), (60.0, "right")}


def test_csv_round_trip(spark, tmp_path):
    rows = [("plain", "a,b"), ('say "x"', "two\nlines"), ("=1+1", None)]
    sinks.write_csv(spark.createDataFrame(rows, "File string, Note string").coalesce(1), str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert list(csv.reader(io.StringIO(data, newline=""))) == [["File", "Note"], ["plain", "a,b"], ['say "x"', "two\nlines"], ["'=1+1", ""]] and "\r\n" in data


def test_csv_folder(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k}.png", f"brand {k}\n\"x\"") for k in range(30)], "File string, `Brand Name` string")
    sinks.write_csv(rows.repartition(3), str(tmp_path / "out"))
    files = [p.read_text() for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    assert len(files) == 3 and all(t.startswith("File,Brand Name\n") for t in files)
    back = readers.read_csv(spark, str(tmp_path / "out"))
    assert sorted((r.file, r.brandname) for r in back.collect()) == sorted(map(tuple, rows.collect()))
    (tmp_path / "out" / "other.csv").write_text("File,Type\na.png,wine\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_csv(spark, str(tmp_path / "out"))


def test_every_response(spark):
    rows = spark.createDataFrame([(1, "mock", None, None, None), (2, "one", "image: missing", None, None), (3, "one", None, ("reader", "busy", True), None), (4, "one", None, ("reader", "key", False), None), (5, "one", None, ("code", "x", None), None), (6, "one", "image: missing", None, 7)],
        "report int, reader string, error string, failure struct<kind:string,message:string,retryable:boolean>, wait int")
    got = [(r.status, json.loads(r.body), r.retry_after) for r in sinks.responses(rows, failure="failure", retry_after="wait").collect()]
    assert [x[0] for x in got] == [200, 400, 503, 500, 500, 429] and [x[2] for x in got] == [None] * 5 + [7]
    assert got[2][1] == {"error": "reader_failed", "message": "busy", "retryable": True} and got[4][1]["error"] == "internal_error" and got[4][1]["retryable"] is True


def test_case_file(spark):
    app = ("A 1", None, "distilled_spirits", "Old Tom", "Gin", "45%", "750 mL", "Old Tom", None, None, False)
    read = (("OLD TOM", 0.9), ("Gin", 0.9), ("45%", 0.9), ("750 mL", 0.9), ("Old Tom", 0.9), None, (STATUTORY_WARNING, 0.9, True, True, True, None, None), (0.9, ["glare"], False), (0.9, False, []), ["a note " * 20], 1000, "mock")
    apps, reads = spark.createDataFrame([("k", *app)], "filename_key string, " + APPLICATION), spark.createDataFrame([("k", *read)], "filename_key string, " + EXTRACTION)
    report = verify_labels(apps, reads)
    rows = report.select("filename_key", F.struct(*report.columns).alias("report")).join(apps.select("filename_key", F.struct(*apps.columns[1:]).alias("application")), "filename_key")
    rows = rows.select("application", "report", F.lit("k.png").alias("filename"), F.lit(bytearray(b"PICTURE")).alias("content"), F.lit("2024-05-06 07:08:09").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("error"), F.lit("mock").alias("reader"))
    one, two = sinks.case_files(rows).first(), sinks.case_files(rows).first()
    assert one.name == "label-check-a-1-2024-05-06.zip" and bytes(one.bytes) == bytes(two.bytes)
    z = zipfile.ZipFile(io.BytesIO(bytes(one.bytes)))
    assert z.namelist() == ["report.txt", "report.json", "k.png"] and z.testzip() is None and z.read("k.png") == b"PICTURE"
    assert all(i.compress_type == zipfile.ZIP_STORED and i.CRC == zlib.crc32(z.read(i)) for i in z.infolist())
    data = json.loads(z.read("report.json"))
    assert data["application"]["application_id"] == "A 1" and data["report"]["recommendation"] == "approve" and data["generatedAt"] == "2024-05-06T07:08:09.000Z"
    text = z.read("report.txt").decode()
    assert "Result:            NO PROBLEMS FOUND" in text and "  Brand name             Old Tom" in text and "TTB ID" not in text and "[MATCHES]  Brand Name" in text
    assert "Regulation: 27 CFR 5.63   Rule: normalised-match:case   Reading confidence: 90%" in text and "  - glare" in text and max(map(len, text.split("\n"))) < 320
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        there = sinks.case_files(rows.withColumn("at", F.timestamp_seconds(F.lit(0)))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert there.name.endswith("-1970-01-01.zip") and b'"1970-01-01T00:00:00.000Z"' in bytes(there.bytes) and b"Generated:         1970-01-01T00:00:00.000Z" in bytes(there.bytes)
    ok, bad = sinks.responses(rows).first(), sinks.responses(rows.withColumn("error", F.lit("image: missing"))).first()
    assert ok.status == 200 and json.loads(ok.body)["isDemoReader"] is True and (bad.status, json.loads(bad.body)) == (400, {"error": "bad_request", "message": "image: missing"})


def test_a_sweep_measures_what_each_box_by_itself_does(spark):
    """Flat parts, noise, colours of one brightness, boxes that share borders, lie in one another, are off or too small."""
    rng = random.Random(3)
    w, h = 48, 30
    paint = {"flat": lambda k: (240, 240, 240) if k % w < 40 else (9, 9, 9), "noise": lambda k: (rng.randrange(256), rng.randrange(256), rng.randrange(256)), "twins": lambda k: rng.choice([(100, 0, 0), (0, 0, 100), (7, 7, 7)]) if k % 3 else (200, 200, 200)}
    rows = [(i, w, h, k, *f(k)) for i, f in paint.items() for k in range(w * h)]
    pixels = spark.createDataFrame(rows, "image_id string, width int, height int, pixel_idx int, r int, g int, b int")
    shapes = [(0.0, 0.0, 1.0, 1.0), (0.1, 0.1, 0.8, 0.5), (0.1, 0.1, 0.8, 0.8), (0.3, 0.3, 0.5, 0.5), (2.0, 3.0, 40.0, 60.0), (0.01, 0.01, 0.01, 0.01), (0.5, 0.5, 0.5, 0.5)]
    boxes = spark.createDataFrame([(i, f"b{n}", s) for i in [*paint, "none"] for n, s in enumerate(shapes)], "image_id string, box_id string, bounds struct<x:double,y:double,width:double,height:double>")
    got, want = ({(r.image_id, r.box_id): tuple(r)[2:] for r in f(pixels, boxes).collect()} for f in (sweeps.sweep, pictures.measure))
    assert got == want and sum(v[0] is not None for v in got.values()) == 18


def test_pictures(spark):
    w, h = 40, 20
    rows = [("i", w, h, k, *((0, 0, 0) if (k // w) % 4 == 0 else (255, 255, 255) if k // w < 12 else (250, 250, 250) if k % 7 else (200, 200, 200))) for k in range(w * h)]
    pixels = spark.createDataFrame(rows, "image_id string, width int, height int, pixel_idx int, r int, g int, b int")
    frames = pixels.select("image_id", "width", "height").distinct()
    boxes = pictures.box_shapes(frames).unionByName(frames.select("image_id", F.lit("tiny").alias("box_id"), F.struct(*[F.lit(0.01).alias(n) for n in ("x", "y", "width", "height")]).alias("bounds")))
    got = {r.box_id: r for r in pictures.measure(pixels, boxes).collect()}
    left, top, cw, ch = 4, 15, 32, 4  # the loose box, by hand

    def plain(x0, y0, x1, y1):
        inside = sorted((0.2126 * r[4] + 0.7152 * r[5] + 0.0722 * r[6], r[3], r[4:]) for r in rows if x0 <= r[3] % w < x1 and y0 <= r[3] // w < y1)
        lum = lambda p: sum(c * (v / 255 / 12.92 if v / 255 <= 0.03928 else ((v / 255 + 0.055) / 1.055) ** 2.4) for c, v in zip((0.2126, 0.7152, 0.0722), p, strict=True))
        a, b = (lum(inside[min(len(inside) - 1, int(p * len(inside)))][2]) for p in (0.02, 0.9))
        return (max(a, b) + 0.05) / (min(a, b) + 0.05)

    assert got["tiny"].contrast is None
    assert abs(got["loose"].contrast - plain(left, top, left + cw, top + ch)) < 1e-9
    assert pictures.worst_contrast(pictures.measure(pixels, boxes)).first().worst == min(r.contrast for r in got.values() if r.contrast)
    warn = frames.select("image_id", F.struct(F.lit(0.05).alias("x"), F.lit(0.74).alias("y"), F.lit(0.9).alias("width"), F.lit(0.2).alias("height")).alias("bounds"))
    a = pictures.relative_contrast(pixels, warn).first().appearance
    assert a.measured_contrast == got["loose"].contrast and 0 < a.relative_contrast <= 1.01 and a.text_color_hex.startswith("#")
    reads = spark.createDataFrame([("i", None, None, None, None, None, None, ("t", 0.9, True, True, True, None, None), (0.9, [], False), (0.9, False, []), [], 1, "r"), ("j", None, None, None, None, None, None, None, None, None, None, 1, "r")], "filename_key string, " + EXTRACTION)
    out = {r.filename_key: r.government_warning for r in pictures.with_appearance(reads, pictures.relative_contrast(pixels, warn)).collect()}
    assert out["i"].appearance.measured_contrast == a.measured_contrast and out["j"] is None


def test_scores(spark):
    readings = spark.createDataFrame([("m1", "s1", 100, "Old Tom", "1"), ("m1", "s2", 300, "x", None), ("m1", "s3", 200, "y", "2"), ("m2", "s1", 50, "OLD  TOM", "1")], "model string, sample_id string, elapsed_ms int, brand string, code string")
    truth = spark.createDataFrame([("s1", "old tom", "1"), ("s2", "x", None), ("s3", "z", "2")], "sample_id string, brand string, code string")
    got = {r.model: (r.correct, r.total, r.median_ms, r.worst_ms) for r in scores.scorecard(readings, truth, ["brand", "code"]).collect()}
    assert got == {"m1": (5, 6, 200, 300), "m2": (2, 2, 50, 50)}
    assert scores.upper_median(spark.createDataFrame([(1, v) for v in (4, 1, 3, 2)], "k int, v int"), ["k"], "v").first().median == 3
    done = scores.against_expected(spark.createDataFrame([("s1", "approve"), ("s2", "reject")], "sample_id string, recommendation string"), spark.createDataFrame([("s1", "approve"), ("s2", "approve"), ("s3", "reject")], "sample_id string, recommendation string"))
    assert tuple(scores.totals(done).first()) == (1, 2)
    ids = scores.unknown_ids(spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in ids.collect()] == ["b"] and rollup.verdict_rank is not None


@pytest.mark.parametrize("name", ["json_validate", "reading_issues"])
def test_a_reading_is_parsed_once(spark, name):
    """However many fields of a reading are looked at, its text is parsed once (up to dozens of times before), in as many tasks as there are cores."""
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("try_parse_json") + plan.count("parse_json(") <= 2
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
