import random
import unicodedata

import pytest
from proofline.constants import STATUTORY_WARNING
from proofline.functions import contrast, fills, parse, scalars, text, warning
from pyspark.sql import functions as F


def values(spark, column, *rows, schema=None):
    """column(F.col('_1'), ...) of each row, a tuple of arguments."""
    names = [f"_{k + 1}" for k in range(len(rows[0]))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + (schema or ", ".join(f"{n} string" for n in names)))
    return [r[0] for r in df.select(column(*map(F.col, names)).alias("x"), "k").orderBy("k").select("x").collect()]


def test_ladder(spark):
    cases = [
        ("Stone's Throw", "Stone's Throw", "exact"), ("A  B", " A B", "whitespace"), ("Stone’s–Throw", "Stone's-Throw", "typography"), ("STONE’S THROW", "Stone's Throw", "case"),
        ("Rosé", "ROSE", "accents"), ("St. Anne", "St Anne", "punctuation"), ("Smith & Sons", "Smith and Sons", "synonyms"), ("Old Co. Inc.", "The Old Company Incorporated", "synonyms"),
        ("...", "!!!", None), ("   ", "  ", None), ("A", "B", None), ("ﬁne", "fine", "typography"), ("L.L.C.", "LLC", None), ("whisky", "WHISKEY", "synonyms"),
    ]
    got = values(spark, lambda a, b: text.ladder_level(text.forms(a), text.forms(b)), *[c[:2] for c in cases])
    assert got == [c[2] for c in cases]


def test_folds(spark):
    odd = "“Ça” va﻿—x ′y` ﬀ"
    assert values(spark, text.collapse_whitespace, ("  a﻿b \n",)) == ["a b"]
    assert values(spark, text.fold_typography, (odd,), (None,)) == [unicodedata.normalize("NFKC", odd).translate(str.maketrans("“”—′`", "\"\"-''")), None]
    assert values(spark, text.strip_diacritics, ("Éà ñ ß",)) == ["Ea n ß"]
    assert values(spark, text.tokenize, ("Smith & Sons+Co., Ltd.",)) == [["smith", "and", "sons", "and", "co", "ltd"]]
    assert values(spark, text.canonical_tokens, ("The Whisky of A Dist. 1 L",)) == [["whiskey", "distillery", "1", "litre"]]


def test_similarity(spark):
    assert values(spark, text.edit_similarity, ("", ""), ("abc", "abd"), ("a", "")) == [1.0, pytest.approx(2 / 3), 0.0]
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    assert values(spark, lambda a, b: text.token_similarity(split(a), split(b)), ("", ""), ("a b b", "b c")) == [1.0, pytest.approx(1 / 3)]
    assert values(spark, lambda a, b: text.contains_all(split(a), split(b)), ("a b", "b"), ("a", ""), ("a", "b")) == [True, False, False]
    assert values(spark, lambda a, b: text.extra_tokens(split(a), split(b)), ("x a x", "a")) == [["x", "x"]]


@pytest.mark.parametrize("width", [5, 12, 60])
def test_wrap(spark, width):
    def plain(s):
        lines, line = [], ""
        for w in s.split(" "):
            if len(line) + len(w) + 1 > width and line:
                lines.append("> " + line)
                line = w
            else:
                line = f"{line} {w}" if line else w
        return "\n".join(lines + (["> " + line] if line else []))

    rng = random.Random(width)
    texts = [" ".join("x" * rng.randrange(1, 9) for _ in range(30)) for _ in range(5)] + ["", "one", "averylongwordindeed b"]
    assert values(spark, lambda c: text.wrap(c, width, "> "), *[(t,) for t in texts]) == [plain(t) for t in texts]


def test_slug(spark):
    assert values(spark, text.slug, ("Stone’s Thröw  No. 1",), ("!!!",), ("a" * 50,), ("_x-y",)) == ["stones-throw-no-1", "label", "a" * 40, "_x-y"]


def test_alcohol(spark):
    cases = {
        "40% ALC/VOL": (40, None), "ALC. 12.5% BY VOL.": (12.5, None), "5.0% ABV": (5, None), "ALCOHOL 45% BY VOLUME": (45, None), "13,5% vol": (13.5, None), "45": (45, None), ".5% ALC BY VOL": (0.5, None),
        "90 PROOF": (45, 90), "45% Alc./Vol. (90 Proof)": (45, 90), "12½% alc": (12.5, None), "5¼% vol": (5.25, None), "51% corn, 45% alc/vol": (45, None), "96% alc by vol": (None, None), "200 proof": (None, None),
        "": (None, None), None: (None, None), "strong": (None, None), "80 degrees proof": (40, 80), "40 % alc  80° x 81 proof 81 proof": (40, 81),
    }
    got = values(spark, lambda c: parse.parse_alcohol(parse.alcohol_text(c)), *[(c,) for c in cases])
    assert [(r.abv, r.proof) for r in got] == list(cases.values())
    assert got[7].derived and got[7].matched == "90 PROOF" and not got[8].derived
    same = values(spark, lambda c: parse.proof_consistent(parse.parse_alcohol(parse.alcohol_text(c))), ("45% alc 90 proof",), ("45% alc 91 proof",), ("45% alc 92 proof",), ("90 proof",), ("45%",))
    assert same == [True, True, False, True, None]


def test_tolerance(spark):
    rows = [("wine", 14.0), ("wine", 14.1), ("distilled_spirits", 40.0), ("malt_beverage", 5.0)]
    assert values(spark, parse.tolerance, *rows, schema="_1 string, _2 double") == [1.5, 1.0, 0.3, 0.3]


def test_volume(spark):
    cases = {
        "750 mL": 750, "750ml": 750, "75 cL": 750, "0.75 L": 750, "1.75 L": 1750, "1,5 L": 1500, "12 FL OZ": 354.882, "12 fl. oz.": 354.882, "12 fl. oz": 354.882, "one bottle": None, "750 MILLILITERS": 750,
        "750 mlé": 750, "750 mlx": None, "25.4 FL OZ (750 mL)": 751.1669, "1,000 mL": 1, "1 PT. 8 FL. OZ.": 236.588, "2 quarts": 1892.706, None: None, "": None, "5 gal": None, "3 fluid  ounces": 88.7205,
    }
    got = values(spark, lambda c: parse.parse_volume(parse.volume_text(c)), *[(c,) for c in cases])
    assert [r.ml for r in got] == [None if v is None else pytest.approx(v) for v in cases.values()]
    assert got[6].unit == "FL OZ" and got[9].unit is None
    assert values(spark, parse.format_volume, (750.0,), (1750.0,), (2000.0,), (354.882,), schema="_1 double") == ["750 mL", "1.75 L", "2 L", "354.9 mL"]


def test_fills(spark):
    rows = [("wine", 750.0), ("wine", 751.0), ("wine", 800.0), ("wine", 40.0), ("wine", 3500.0), ("wine", 4000.0), ("wine", 4500.0), ("wine", 18000.0), ("malt_beverage", 333.0), ("distilled_spirits", None), ("distilled_spirits", 945.0), ("distilled_spirits", 800.0)]
    got = [tuple(r) for r in values(spark, fills.check_fill, *rows, schema="_1 string, _2 double")]
    assert got == [
        (True, False, 750, None), (True, False, 750, None), (False, False, None, [750, 1000]), (False, False, None, [50]), (False, False, None, [3000]), (True, False, 4000, None), (False, False, None, [4000, 5000]),
        (True, True, None, None), (True, True, None, None), (True, False, None, None), (True, False, 945, None), (False, False, None, [750, 900]),
    ]


def diff_of(spark, *texts):
    return [[tuple(s) for s in d] for d in values(spark, lambda c: warning.warning_diff(warning.words(warning.compatible(c))), *[(t,) for t in texts])]


def test_warning_diff(spark):
    assert len(STATUTORY_WARNING) == 283 and len(STATUTORY_WARNING.split()) == 43
    same, other, cut, none = diff_of(spark, STATUTORY_WARNING.upper(), STATUTORY_WARNING.replace("may", "might"), STATUTORY_WARNING.replace(" because of the risk of birth defects", ""), "")
    assert [s[0] for s in same] == ["equal"]
    assert [s for s in other if s[0] != "equal"] == [("delete", "may"), ("insert", "might")]
    assert [s[0] for s in cut].count("delete") >= 1 and none == [("delete", STATUTORY_WARNING.lower())]
    rng = random.Random(9)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        runs = warning.diff_lists(a, b)
        assert " ".join(t for op, t in runs if op != "insert").split() == a and " ".join(t for op, t in runs if op != "delete").split() == b
        assert all(x[0] != y[0] for x, y in zip(runs, runs[1:], strict=False))


def test_colours(spark):
    ratio = values(spark, contrast.contrast_ratio, ("#000000", "#fff"), ("#777", "#777"), ("#fff", "000"), ("red", "#fff"), (None, "#fff"))
    assert ratio == [pytest.approx(21), pytest.approx(1), pytest.approx(21), None, None]
    assert values(spark, contrast.to_hex, (255.0, 0.5, 15.4), schema="_1 double, _2 double, _3 double") == ["#ff010f"]
    assert values(spark, contrast.clamp01, (float("nan"),), (-1.0,), (2.0,), (0.3,), (None,), schema="_1 double") == [0, 0, 1, 0.3, 0]
    box = lambda x, y, w, h: contrast.crop(F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")), F.lit(200), F.lit(100))
    got = values(spark, box, (0.0, 0.0, 1.0, 1.0), (10.0, 72.0, 180.0, 40.0), (0.0, 0.0, 0.01, 0.01), schema="_1 double, _2 double, _3 double, _4 double")
    assert [r and tuple(r) for r in got] == [(10, 5, 180, 90), (19, 73, 162, 25), None]


def test_cells_and_headers(spark):
    cells = ["=1+1", "+x", "-y", "@z", "\tq", "a,b", 'say "x"', "two\nlines", "plain", None, "=a,b", "5-3"]
    want = ["'=1+1", "'+x", "'-y", "'@z", "'\tq", '"a,b"', '"say ""x"""', '"two\nlines"', "plain", "", '"\'=a,b"', "5-3"]
    assert values(spark, scalars.csv_cell, *[(c,) for c in cells]) == want
    assert {scalars.normalise_header(h) for h in ("Brand Name", "brand_name", " brandname ", "brand - name")} == {"brandname"}
    assert values(spark, scalars.header_column, ("Brand - _Name ",)) == ["brandname"]
    assert values(spark, scalars.beverage_type, ("Beer",), ("Malt Beverage",), ("sake",), (None,), ("WINE",)) == ["malt_beverage", "malt_beverage", "distilled_spirits", "distilled_spirits", "wine"]
    assert values(spark, scalars.truthy, ("YES",), ("1",), ("no",), (None,)) == [True, True, False, False]
    assert values(spark, scalars.jpeg_name, ("a.b.png",), ("x",)) == ["a.b.jpg", "x.jpg"]


def test_sniff(spark):
    pad = b"0" * 12
    rows = [b"\x89PNG\r\n\x1a\n" + pad, b"\xff\xd8\xff" + pad, b"GIF89a" + pad, b"GIF87a" + pad, b"RIFF1234WEBP", b"RIFF1234WAVE", b"\xff\xd8\xff", pad]
    assert values(spark, scalars.sniff_image, *[(bytearray(r),) for r in rows], schema="_1 binary") == ["image/png", "image/jpeg", "image/gif", "image/gif", "image/webp", None, None, None]


def test_clients(spark):
    rows = [
        ({"x-vercel-forwarded-for": " 1 ", "x-real-ip": "2"},), ({"cf-connecting-ip": "3"},), ({"x-real-ip": "2", "x-forwarded-for": "9"},), ({"x-forwarded-for": "a, b , c"},), ({"x-forwarded-for": " , "},), ({"z": "1"},),
    ]
    assert values(spark, scalars.client_key, *rows, schema="_1 map<string,string>") == ["1", "3", "2", "c", "unknown", "unknown"]


def test_flow(spark):
    assert values(spark, scalars.backoff_ms, (0, None), (3, None), (9, None), (0, 2), (0, 99), schema="_1 int, _2 int") == [500, 4000, 15000, 2000, 15000]
    rows = [(400, "API key not valid"), (400, "x"), (403, ""), (404, ""), (429, ""), (503, ""), (418, "")]
    got = values(spark, scalars.http_error, *rows, schema="_1 int, _2 string")
    assert [r.retryable for r in got] == [False, True, False, False, True, True, True]
    rows = [("image/png", 500_000, 3136, 1000), ("image/gif", 500_000, 3136, 1000), ("image/png", 1000, 3136, 1000), ("image/png", 500_000, 100, 1000)]
    assert [tuple(r) for r in values(spark, scalars.downscaled, *rows, schema="_1 string, _2 int, _3 int, _4 int")] == [(False, 1568, 500), (True, 3136, 1000), (True, 3136, 1000), (True, 100, 1000)]
    assert [tuple(r) for r in values(spark, lambda c: scalars.dos_time(c.cast("timestamp")), ("2024-05-06 07:08:09",), ("1970-01-01 00:00:00",))] == [(7 << 11 | 8 << 5 | 4, 44 << 9 | 5 << 5 | 6), (0, 1 << 5 | 1)]
    assert values(spark, lambda c: F.crc32(c.cast("binary")), ("123456789",), ("",)) == [0xCBF43926, 0]
