"""Queries of the sources and sinks that need files, requests, pictures as pixels, and of the smaller operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contrast, fills, parse, scalars, text
from ..operators import pictures, scores, sweeps
from ..schemas import CHECK
from ..sources import readers, sinks
from ..sources.shared import shared_folder
from .base import query, spread
from .label_queries import two
from .number_queries import LISTS


def _new_folder(d: DataFrame) -> str:
    return f"{shared_folder(d.sparkSession)}/proofline-{uuid.uuid4().hex}"


@query(
    """SELECT c_custkey, n AS line_no, concat('F', CAST(c_custkey AS STRING), '.PNG ') AS file_name, CASE c_custkey % 4 WHEN 0 THEN 'Wine' WHEN 1 THEN 'BEER' WHEN 2 THEN 'spirits' ELSE 'mead' END AS kind,
        CASE c_custkey % 3 WHEN 0 THEN concat('="', c_name, '", ', CAST(n AS STRING)) WHEN 1 THEN concat(c_name, chr(10), 'line ', CAST(n AS STRING)) ELSE c_mktsegment END AS brand,
        CASE WHEN c_custkey % 5 = 0 THEN 'Yes' ELSE 'no' END AS imported, '' AS class_type FROM {customer}, (VALUES (1), (2)) AS t(n) WHERE n = 1 OR c_custkey % 2 = 0""",
    """SELECT lower(trim(file_name)) AS filename_key, CASE kind WHEN 'Wine' THEN 'wine' WHEN 'BEER' THEN 'malt_beverage' ELSE 'distilled_spirits' END AS beverage_type, CASE WHEN brand LIKE '=%' THEN concat('''', brand) ELSE brand END AS brand_name, imported = 'Yes' AS is_import
    FROM given QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY line_no DESC) = 1""",
)
def csv_round_trip(d: DataFrame) -> DataFrame:
    dealt = d.repartitionByRange(4, "line_no", "c_custkey").sortWithinPartitions("line_no", "c_custkey")  # a key's second row is in a later file
    names = {"file_name": "File Name", "kind": "Beverage-Type", "brand": "Brand_Name", "imported": "isImport", "class_type": "class type"}
    sinks.write_csv(dealt.select(*[F.col(c).alias(n) for c, n in names.items()]), path := _new_folder(d))
    return readers.load_manifest(readers.read_csv(d.sparkSession, path)).select("filename_key", "beverage_type", "brand_name", "is_import")


@query("SELECT n_nationkey, n_name FROM {nation}", "SELECT concat('s', CAST(n_nationkey AS STRING)) AS id, n_name AS title, n_nationkey % 10 = 3 AS chosen, concat(n_name, ' Creek') AS brand_name FROM given")
def sample_list(d: DataFrame) -> DataFrame:
    application = F.struct(F.lit("wine").alias("beverage_type"), F.concat("n_name", F.lit(" Creek")).alias("brand_name"))
    one = F.struct(F.concat(F.lit("s"), "n_nationkey").alias("id"), F.lit("f.png").alias("file"), F.col("n_name").alias("title"), (F.col("n_nationkey") % 10 == 3).alias("isDefault"), application.alias("application"))
    d.agg(F.collect_list(one).alias("samples")).select(F.to_json(F.struct("samples"))).coalesce(1).write.text(path := _new_folder(d))  # 25 samples
    return readers.read_samples(d.sparkSession, path).select("id", "title", F.col("isDefault").alias("chosen"), "application.brand_name")


@query("SELECT concat('s', CAST(n_nationkey AS STRING)) AS id, n_name AS title, n_nationkey % 10 = 3 AS chosen FROM {nation}", "SELECT id, title FROM given WHERE chosen ORDER BY id LIMIT 1")
def default_sample(d: DataFrame) -> DataFrame:
    return readers.default_sample(d.withColumnRenamed("chosen", "isDefault")).select("id", "title")


@query("SELECT n_nationkey, concat('GIF89a......', n_name) AS content FROM {nation}", "SELECT 'image/gif' AS mime, content, CAST(length(content) + 1 AS BIGINT) AS length FROM given")
def image_source(d: DataFrame) -> DataFrame:
    d.write.partitionBy("n_nationkey").text(path := _new_folder(d))
    got = readers.read_images(d.sparkSession, path)
    return got.select("mime", F.regexp_replace(F.decode("content", "UTF-8"), "\n$", "").alias("content"), "length")


@query(
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN concat('GIF89a......', event_type) WHEN 2 THEN concat('BM..........', event_type) ELSE 'GIF87a......' END AS content,
        CASE WHEN event_id % 7 = 3 THEN NULL WHEN event_id % 7 = 4 THEN repeat('x', 8193) ELSE '{}' END AS application, CASE WHEN event_id % 2 = 0 THEN 'image/tiff' ELSE 'image/png' END AS mime FROM {events}""",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'image: missing' WHEN event_id % 7 = 2 AND event_id % 2 = 0 THEN 'image: not supported' WHEN event_id % 7 = 3 THEN 'application: missing' WHEN event_id % 7 = 4 THEN 'application: too long' END AS refused,
        event_id % 2 = 1 AS named_supported FROM given""",
)
def request_gates(d: DataFrame) -> DataFrame:
    error = readers.request_error(F.encode("content", "UTF-8"), F.col("mime"), F.col("application"))
    return d.select("event_id", error.alias("refused"), scalars.supported_image(F.col("mime")).alias("named_supported"))


@query("SELECT doc_id, text FROM {documents}", "SELECT CAST(doc_id AS STRING) AS filename_key, CASE WHEN octet_length(encode(text)) % 2 = 0 THEN concat('{\"bytes\": ', CAST(octet_length(encode(text)) AS STRING), '}') END AS reading, CASE WHEN octet_length(encode(text)) % 2 = 1 THEN 'odd' END AS error FROM given")
def picture_reading(d: DataFrame) -> DataFrame:
    def reader(content: bytes) -> dict:
        if len(content) % 2:
            raise ValueError("odd")
        return {"bytes": len(content)}

    pictures_ = d.select(F.col("doc_id").cast("string").alias("filename_key"), F.encode("text", "UTF-8").alias("content")).where("content is not null")
    return readers.read_with(pictures_, reader)


@query("SELECT CAST(n_nationkey AS STRING) AS filename_key FROM {nation}", "SELECT filename_key, 'Creek' AS brand, CAST(0.9 AS DOUBLE) AS confidence FROM given")
def constant_reading(d: DataFrame) -> DataFrame:
    fixed = F.struct(F.struct(F.lit("Creek").alias("text"), F.lit(0.9).alias("confidence")).alias("brand_name"))
    return readers.constant_reading(d, fixed).select("filename_key", F.col("brand_name.text").alias("brand"), F.col("brand_name.confidence").alias("confidence"))


@query(
    "SELECT event_id, CAST(event_id % 6 AS INT) AS v FROM {events}",
    "SELECT CASE v WHEN 0 THEN 'one' WHEN 1 THEN 'two' WHEN 2 THEN 'mock' WHEN 3 THEN 'one' WHEN 4 THEN 'mock' ELSE 'mock' END AS reader, count(*) AS n FROM given GROUP BY 1",
)
def reader_choice(d: DataFrame) -> DataFrame:
    asked = [(["one", "two"], None), (["one", "two"], "two"), (["one", "two"], "mock"), (["one", "two"], "three"), ([], None), ([], "one")]
    names = F.array(*[F.lit(readers.choose_reader(*x)) for x in asked])
    return d.groupBy(F.element_at(names, F.col("v") + 1).alias("reader")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT p_partkey, concat('# Part', chr(10), 'Sizes', chr(10), '```text', chr(10), CAST(p_size * 10 AS STRING), ' mL (', CAST(p_size AS STRING), ' L)', chr(10), '```', chr(10), '```', chr(10), '7 mL', chr(10), '```') AS value FROM {part}",
    "SELECT DISTINCT CAST(p_size * m AS DOUBLE) AS ml FROM part, (VALUES (10), (1000)) AS t(m)",
)
def listed_sizes(d: DataFrame) -> DataFrame:
    return readers.listed_sizes(d, "Sizes")


@query(
    "SELECT n_nationkey, repeat('abcdef ', CAST(n_nationkey * 7 + 1 AS INT)) AS said FROM {nation}",
    """SELECT n_nationkey, (SELECT string_agg(concat('  ', rtrim(repeat('abcdef ', least(10, words - 10 * k)))), chr(10) ORDER BY k) FROM (SELECT unnest(range((words + 9) // 10)) AS k) AS r) AS wrapped
    FROM (SELECT n_nationkey, CAST(n_nationkey * 7 + 1 AS INT) AS words FROM given) AS g""",
)
def wrap_lines(d: DataFrame) -> DataFrame:
    return d.select("n_nationkey", text.wrap(F.rtrim("said"), 70, "  ").alias("wrapped"))


#: CRC-32 of a text of plain characters, bit by bit.
CRC_WALK = """, walk AS (SELECT n_nationkey, n_name, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM given UNION ALL
        SELECT n_nationkey, n_name, k + 1, xor(CASE WHEN k % 8 = 0 THEN xor(c, ord(substr(n_name, k // 8 + 1, 1))) ELSE c END // 2, CASE WHEN (CASE WHEN k % 8 = 0 THEN xor(c, ord(substr(n_name, k // 8 + 1, 1))) ELSE c END) % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
        FROM walk WHERE k < 8 * length(n_name)), sums AS (SELECT n_nationkey, n_name, xor(c, CAST(4294967295 AS BIGINT)) AS crc FROM walk WHERE k = 8 * length(n_name))"""


@query("SELECT n_nationkey, n_name FROM {nation}", CRC_WALK + " SELECT n_nationkey, crc, 2 * 30 + 2 * 46 + 22 + 4 * (length(n_name) + length('-copy.txt')) + 2 * length(n_name) AS bytes, 2 AS entries FROM sums")
def zip_layout(d: DataFrame) -> DataFrame:
    copy = F.concat("n_name", F.lit("-copy.txt"))
    content = F.encode("n_name", "UTF-8")
    z = d.select("n_nationkey", sinks.zip_entries(F.array(copy, F.concat(F.lit("2"), F.substring(copy, 2, 99))), F.array(content, content), F.timestamp_seconds(F.lit(1_700_000_000))).alias("z"))
    little = lambda at, n: sum((F.conv(F.hex(F.substring("z", at + k, 1)), 16, 10).cast("long") * (1 << (8 * k)) for k in range(n)), F.lit(0).cast("long"))
    return z.select("n_nationkey", little(15, 4).alias("crc"), F.octet_length("z").cast("long").alias("bytes"), F.conv(F.hex(F.substring("z", -12, 1)), 16, 10).cast("int").alias("entries"))


@query(
    "SELECT event_id, event_id % 8 AS v, event_type, user_id FROM {events}",
    """SELECT event_id, CAST(CASE v WHEN 0 THEN 429 WHEN 1 THEN 400 WHEN 2 THEN 503 WHEN 3 THEN 500 WHEN 4 THEN 500 ELSE 200 END AS INT) AS status,
        CASE v WHEN 0 THEN concat('{"error":"rate_limited","message":"Too many labels at once. Try again in ', CAST(user_id AS STRING), ' seconds."}') WHEN 1 THEN '{"error":"bad_request","message":"image: missing"}'
            WHEN 2 THEN concat('{"error":"reader_failed","message":"', event_type, '","retryable":true}') WHEN 3 THEN concat('{"error":"reader_failed","message":"', event_type, '","retryable":false}') WHEN 4 THEN '{"error":"internal_error","message":"The check failed. Try again.","retryable":true}'
            ELSE concat('{"report":{"recommendation":"approve"},"readerId":"', CASE v WHEN 5 THEN 'mock' ELSE 'one' END, '","isDemoReader":', CASE v WHEN 5 THEN 'true' ELSE 'false' END, ',"usage":{"inputTokens":', CAST(user_id AS STRING), '}}') END AS body, CASE v WHEN 0 THEN user_id END AS retry_after FROM given""",
)
def response_rows(d: DataFrame) -> DataFrame:
    v = F.col("v")
    failure = F.when(v.isin(2, 3, 4), F.struct(F.when(v == 4, "code").otherwise("reader").alias("kind"), F.col("event_type").alias("message"), (v == 2).alias("retryable")))
    rows = d.select("event_id", F.struct(F.lit("approve").alias("recommendation")).alias("report"), F.when(v == 1, "image: missing").alias("error"), F.when(v == 5, "mock").otherwise("one").alias("reader"), F.struct(F.col("user_id").alias("inputTokens")).alias("usage"), failure.alias("failure"), F.when(v == 0, F.col("user_id")).alias("wait"))
    return sinks.responses(rows, usage="usage", failure="failure", retry_after="wait", keep=["event_id"])


@query(
    "SELECT event_id, CAST(CASE event_id % 8 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 400 WHEN 4 THEN 400 WHEN 5 THEN 529 END AS INT) AS status, CASE event_id % 8 WHEN 3 THEN 'Your credit balance is too low' WHEN 6 THEN 'Request timed out.' WHEN 7 THEN 'Connection error.' ELSE event_type END AS message FROM {events}",
    "SELECT CASE event_id % 8 WHEN 0 THEN 'invalid key' WHEN 1 THEN 'invalid key' WHEN 2 THEN 'rate limited' WHEN 3 THEN 'no credit' WHEN 4 THEN 'other' WHEN 5 THEN 'upstream' WHEN 6 THEN 'timeout' ELSE 'connection' END AS kind, event_id % 8 NOT IN (0, 1, 3) AS retryable, count(*) AS n FROM given GROUP BY 1, 2",
)
def reader_errors(d: DataFrame) -> DataFrame:
    e = scalars.reader_error(F.col("status"), F.col("message"))
    return d.groupBy(e["kind"].alias("kind"), e["retryable"].alias("retryable")).agg(F.count(F.lit(1)).alias("n"))


FILED = """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('A-', CAST(p_partkey AS STRING)) END AS application_id, CAST(NULL AS STRING) AS ttb_id, CASE p_partkey % 2 WHEN 0 THEN 'wine' ELSE 'malt_beverage' END AS beverage_type, p_name AS brand_name,
    p_type AS class_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '12%' END AS alcohol_content, '750 mL' AS net_contents, CAST(NULL AS STRING) AS bottler_name, CAST(NULL AS STRING) AS label_company_name, CAST(NULL AS STRING) AS country_of_origin, p_partkey % 5 = 0 AS is_import FROM {part}"""
APPLICATION_COLUMNS = ("application_id", "ttb_id", "beverage_type", "brand_name", "class_type", "alcohol_content", "net_contents", "bottler_name", "label_company_name", "country_of_origin", "is_import")


@query(FILED, "SELECT p_partkey, concat_ws('; ', 'Application reference=' || application_id, 'Beverage type=' || replace(beverage_type, '_', ' '), 'Brand name=' || brand_name, 'Class / type=' || class_type, 'Alcohol content=' || nullif(alcohol_content, ''), 'Net contents=750 mL', CASE WHEN is_import THEN 'Imported=yes' ELSE 'Imported=no' END) AS filed FROM given")
def filed_fields(d: DataFrame) -> DataFrame:
    fields = sinks.filed_fields(F.struct(*APPLICATION_COLUMNS))
    return d.select("p_partkey", F.array_join(F.transform(fields, lambda f: F.concat_ws("=", f["label"], f["value"])), "; ").alias("filed"))


REPORT_SQL = """concat_ws(chr(10), repeat('=', 78), 'VERIFICATION RECORD', repeat('=', 78), '', 'Result:            NEEDS REVIEW BY AN AGENT', concat('                   ', '1 item needs a look'), '', 'Generated:         1970-01-01T00:00:00.000Z', 'Label artwork:     label.png', 'Reader:            table', 'Time taken:        1.5s', '',
    repeat('-', 78), 'APPLICATION AS FILED', repeat('-', 78), concat_ws(chr(10), '  Application reference  ' || application_id, '  Beverage type          ' || replace(beverage_type, '_', ' '), '  Brand name             ' || brand_name, '  Class / type           ' || class_type, '  Alcohol content        ' || nullif(alcohol_content, ''), '  Net contents           750 mL', CASE WHEN is_import THEN '  Imported               yes' ELSE '  Imported               no' END), '',
    repeat('-', 78), 'COMPARED WITH THE APPLICATION', repeat('-', 78), '', concat_ws(chr(10), '  [CHECK BY EYE]  Brand Name', '      Application says: ' || brand_name, '      Label shows:      ' || brand_name || 'x', '      Close.', concat('      Regulation: 27 CFR 5.63   Rule: near   Reading confidence: 90%', chr(10))),
    CASE WHEN p_partkey % 4 = 0 THEN concat_ws(chr(10), repeat('-', 78), 'PHOTOGRAPH QUALITY', repeat('-', 78), '  Score: 0.70', '  - glare', '') END, CASE WHEN p_partkey % 3 = 0 THEN concat_ws(chr(10), repeat('-', 78), 'OTHER OBSERVATIONS', repeat('-', 78), '  - torn', '') END,
    repeat('=', 78), 'Advisory only: a compliance agent decides every application.', repeat('=', 78)) || chr(10)"""


def _case_rows(d: DataFrame) -> DataFrame:
    one = F.struct(
        F.lit("brand_name").alias("id"), F.lit("Brand Name").alias("name"), F.lit("match").alias("category"), F.lit("review").alias("verdict"), F.col("brand_name").alias("expected"), F.concat("brand_name", F.lit("x")).alias("found"),
        F.lit("near").alias("rule"), F.lit("Close.").alias("explanation"), F.lit("27 CFR 5.63").alias("citation"), F.lit(0.9).alias("confidence"),
    ).cast(CHECK)
    none = F.array().cast("array<string>")
    quality = F.struct(F.lit(0.7).alias("score"), F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("glare"))).otherwise(none).alias("issues"), F.lit(False).alias("too_poor_to_review"))
    notes = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("torn"))).otherwise(none)
    report = F.struct(F.lit("needs_review").alias("recommendation"), F.lit("1 item needs a look").alias("headline"), F.array(one).alias("checks"), quality.alias("image_quality"), notes.alias("notes"), F.lit(1500).cast("long").alias("extraction_ms"), F.lit("table").alias("reader"))
    return d.select("p_partkey", F.struct(*APPLICATION_COLUMNS).alias("application"), report.alias("report"), F.lit("label.png").alias("filename"), F.timestamp_seconds(F.lit(0)).alias("at"), F.encode(F.lit("GIF89a"), "UTF-8").alias("content"))


@query(FILED, f"SELECT p_partkey, {REPORT_SQL} AS record FROM given")
def case_record(d: DataFrame) -> DataFrame:
    return _case_rows(d).select("p_partkey", sinks.report_text(F.col("application"), F.col("report"), F.col("filename"), F.col("at")).alias("record"))


@query(FILED, "SELECT concat('label-check-', CASE WHEN application_id IS NOT NULL THEN lower(application_id) ELSE lower(replace(left(brand_name, 40), ' ', '-')) END, '-1970-01-01.zip') AS name, 3 AS entries, p_partkey % 4 = 0 AS quality_shown FROM given")
def case_archives(d: DataFrame) -> DataFrame:
    rows = _case_rows(d)
    made = sinks.case_files(rows, keep=["p_partkey"])
    shown = rows.select("p_partkey", sinks.shows_quality(F.col("report.image_quality")).alias("quality_shown"))
    return made.join(shown, "p_partkey").select("name", F.conv(F.hex(F.substring("bytes", -12, 1)), 16, 10).cast("int").alias("entries"), "quality_shown")


@query(
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('IMG_', CAST(event_id AS STRING), '.HEIC.png') WHEN 1 THEN concat('scan', CAST(event_id AS STRING)) ELSE concat(event_type, '.webp') END AS filename, CASE event_id % 4 WHEN 0 THEN value - 5 WHEN 1 THEN value / 50 WHEN 2 THEN CAST('NaN' AS DOUBLE) END AS share FROM {events}",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('IMG_', CAST(event_id AS STRING), '.HEIC.jpg') WHEN 1 THEN concat('scan', CAST(event_id AS STRING), '.jpg') ELSE concat(split_part(filename, '.', 1), '.jpg') END AS jpeg, CASE WHEN event_id % 4 > 1 THEN CAST(0 AS DOUBLE) ELSE round(least(1, greatest(0, share)), 9) END AS clamped FROM given",
)
def jpeg_and_clamp(d: DataFrame) -> DataFrame:
    return d.select("event_id", scalars.jpeg_name(F.col("filename")).alias("jpeg"), F.round(contrast.clamp01(F.col("share")), 9).alias("clamped"))


@two("unknown_check_ids", "SELECT DISTINCT p_size AS id FROM {part}", "SELECT DISTINCT p_size AS id FROM {part} WHERE p_size % 7 <> 0", "SELECT id FROM a WHERE id NOT IN (SELECT id FROM b)")
def _unknown(a: DataFrame, b: DataFrame) -> DataFrame:
    return scores.unknown_ids(a, b)


@query(
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '1.5' ELSE '0.5' END AS low, CASE WHEN event_id % 2 = 0 THEN '-1' ELSE '1' END AS high FROM {events}",
    """SELECT event_id, nullif(concat_ws('; ', CASE WHEN event_id % 3 = 0 THEN 'brand_name: outside 0 to 1' END, CASE WHEN event_id % 2 = 0 THEN 'class_type: outside 0 to 1' END, CASE WHEN event_id % 2 = 0 THEN 'alcohol_content: outside 0 to 1' END,
        CASE WHEN event_id % 3 = 0 AND event_id % 2 <> 0 THEN 'net_contents: outside 0 to 1' END), '') AS error FROM given""",
)
def reading_issues(d: DataFrame) -> DataFrame:
    one = lambda name, sure: F.concat(F.lit(f'"{name}":{{"text":"x","confidence":'), sure, F.lit("}"))
    raw = F.concat(F.lit("{"), F.concat_ws(",", one("brand_name", F.col("low")), one("class_type", F.col("high")), one("alcohol_content", F.col("high")), one("net_contents", F.col("low"))), F.lit("}"))
    return spread(d).select("event_id", readers.parse_extractions(raw)["error"].alias("error"))


@query(
    "SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'wine' ELSE 'distilled_spirits' END AS beverage, CAST(p_size * 25 AS DOUBLE) + CASE p_partkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN -0.9 ELSE 5 END AS ml FROM {part}",
    f"SELECT p_partkey, CAST((SELECT min(size) FROM ({LISTS}) AS s WHERE s.b = beverage AND abs(size - ml) <= 1) AS DOUBLE) AS matched FROM given",
)
def fill_match(d: DataFrame) -> DataFrame:
    return d.select("p_partkey", fills.check_fill(F.col("beverage"), F.col("ml"))["matched"].alias("matched"))


@query(
    "SELECT p_partkey, p_name AS wanted, CASE p_partkey % 3 WHEN 0 THEN concat('old ', p_name) WHEN 1 THEN p_type ELSE '***' END AS had FROM {part}",
    "SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND len(list_filter(string_split(lower(wanted), ' '), lambda x: NOT list_contains(string_split(lower(had), ' '), x))) = 0 AS contained FROM given",
)
def containment(d: DataFrame) -> DataFrame:
    tokens = d.withColumns({c: text.canonical_tokens(F.col(c)) for c in ("wanted", "had")})
    return tokens.select("p_partkey", text.contains_all(F.col("had"), F.col("wanted")).alias("contained"))


@query(
    "SELECT l_linenumber % 6 AS v, CAST(l_quantity AS INT) AS q, CASE l_linenumber % 6 WHEN 0 THEN concat(CAST(CAST(l_quantity AS INT) + 60 AS STRING), '% alc/vol') WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) * 5 AS STRING), ' proof') WHEN 2 THEN concat(CAST(CAST(l_quantity AS INT) + 70 AS STRING), '%') ELSE '95% vol, 190 proof' END AS said FROM {lineitem}",
    "SELECT v, q, CAST(CASE v WHEN 0 THEN CASE WHEN q + 60 <= 95 THEN q + 60 END WHEN 1 THEN CASE WHEN q * 5 <= 190 THEN q * 2.5 END WHEN 2 THEN CASE WHEN q + 70 <= 95 THEN q + 70 END ELSE 95 END AS DOUBLE) AS abv, CAST(CASE WHEN v = 1 AND q * 5 <= 190 THEN q * 5 WHEN v > 2 THEN 190 END AS DOUBLE) AS proof, count(*) AS n FROM given GROUP BY ALL",
)
def plausible_alcohol(d: DataFrame) -> DataFrame:
    r = d.withColumn("r", parse.parse_alcohol(parse.alcohol_text(F.col("said"))))
    return r.groupBy("v", "q", F.col("r.abv").alias("abv"), F.col("r.proof").alias("proof")).agg(F.count(F.lit(1)).alias("n"))


#: A picture a nation: WIDE x HIGH pixels of colours by formula.
WIDE, HIGH = 60, 40
RED, GREEN, BLUE = "(image_id * 37 + x * 5 + y * 3) % 256", "(image_id * 11 + x * 7) % 256", "(x * y + image_id) % 256"
LUM = lambda v: f"CASE WHEN {v} / CAST(255 AS DOUBLE) <= 0.03928 THEN {v} / CAST(255 AS DOUBLE) / 12.92 ELSE pow(({v} / CAST(255 AS DOUBLE) + 0.055) / 1.055, 2.4) END"


def _box_sql(name: str, x: float, y: float, w: float, h: float) -> str:
    """The pixels that a box of these shares has, after it is drawn in on all sides, with their rank by brightness."""
    half = lambda v: int(v + 0.5)
    x0, y0 = half(x * WIDE), half(y * HIGH)
    bw, bh = min(half(w * WIDE), WIDE - x0), min(half(h * HIGH), HIGH - y0)
    left, top, cw, ch = x0 + half(bw * 0.05), y0 + half(bh * 0.05), half(bw * 0.9), half(bh * 0.9)
    return f"""SELECT image_id, '{name}' AS box, r, g, b, row_number() OVER (PARTITION BY image_id ORDER BY r * CAST(0.2126 AS DOUBLE) + g * CAST(0.7152 AS DOUBLE) + b * CAST(0.0722 AS DOUBLE), y * {WIDE} + x) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n
        FROM pix WHERE x >= {left} AND x < {left + cw} AND y >= {top} AND y < {top + ch}"""


def _painted(d: DataFrame) -> DataFrame:
    """Pictures as pixels, by formula."""
    places = d.select("image_id", F.lit(WIDE).alias("width"), F.lit(HIGH).alias("height"), F.explode(F.sequence(F.lit(0), F.lit(WIDE * HIGH - 1))).alias("pixel_idx"))
    places = places.withColumns({"x": F.col("pixel_idx") % WIDE, "y": F.floor(F.col("pixel_idx") / WIDE)})
    return places.select("image_id", "width", "height", "pixel_idx", *[F.expr(c).cast("int").alias(n) for n, c in (("r", RED), ("g", GREEN), ("b", BLUE))])


@query(
    "SELECT n_nationkey AS image_id FROM {nation}",
    f""", pix AS (SELECT image_id, x, y, CAST({RED} AS INT) AS r, CAST({GREEN} AS INT) AS g, CAST({BLUE} AS INT) AS b FROM given, (SELECT unnest(range({WIDE})) AS x) AS xs, (SELECT unnest(range({HIGH})) AS y) AS ys),
    ranked AS ({_box_sql('warning', 0.1, 0.5, 0.8, 0.4)} UNION ALL {_box_sql('label', 0.02, 0.02, 0.96, 0.96)}),
    lit AS (SELECT *, 0.2126 * {LUM('r')} + 0.7152 * {LUM('g')} + 0.0722 * {LUM('b')} AS l FROM ranked),
    ends AS (SELECT image_id, box, max(CASE WHEN k = least(n - 1, CAST(floor(0.02 * n) AS BIGINT)) THEN l END) AS ink, max(CASE WHEN k = least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) THEN l END) AS paper,
        max(CASE WHEN k = least(n - 1, CAST(floor(0.02 * n) AS BIGINT)) THEN printf('#%02x%02x%02x', r, g, b) END) AS ink_hex FROM lit GROUP BY 1, 2),
    ratios AS (SELECT image_id, box, (greatest(ink, paper) + 0.05) / (least(ink, paper) + 0.05) AS c, ink_hex FROM ends)
    SELECT w.image_id, round(w.c, 6) AS measured, round(w.c / l.c, 6) AS relative, w.ink_hex FROM ratios AS w JOIN ratios AS l ON w.image_id = l.image_id AND w.box = 'warning' AND l.box = 'label'""",
)
def measured_contrast(d: DataFrame) -> DataFrame:
    pixels = _painted(d)
    where = d.select("image_id", F.struct(*[F.lit(v).alias(n) for v, n in zip((0.1, 0.5, 0.8, 0.4), ("x", "y", "width", "height"), strict=True)]).alias("bounds"))
    reads = d.select(F.col("image_id").alias("filename_key"), F.struct(F.lit("w").alias("text"), F.lit(None).cast("struct<measured_contrast:double,relative_contrast:double,text_color_hex:string,background_color_hex:string>").alias("appearance")).alias("government_warning"))
    got = pictures.with_appearance(reads, pictures.relative_contrast(pixels, where)).select(F.col("filename_key").alias("image_id"), "government_warning.appearance.*")
    return got.select("image_id", F.round("measured_contrast", 6).alias("measured"), F.round("relative_contrast", 6).alias("relative"), F.col("text_color_hex").alias("ink_hex"))


@query(
    "SELECT n_nationkey AS image_id FROM {nation}",
    f""", pix AS (SELECT image_id, x, y, CAST({RED} AS INT) AS r, CAST({GREEN} AS INT) AS g, CAST({BLUE} AS INT) AS b FROM given, (SELECT unnest(range({WIDE})) AS x) AS xs, (SELECT unnest(range({HIGH})) AS y) AS ys),
    ranked AS ({_box_sql('loose', 0.05, 0.74, 0.9, 0.2)} UNION ALL {_box_sql('looser', 0.03, 0.68, 0.94, 0.3)} UNION ALL {_box_sql('overrunning', 0.05, 0.72, 0.9, 0.4)}),
    lit AS (SELECT *, 0.2126 * {LUM('r')} + 0.7152 * {LUM('g')} + 0.0722 * {LUM('b')} AS l FROM ranked),
    ends AS (SELECT image_id, box, max(CASE WHEN k = least(n - 1, CAST(floor(0.02 * n) AS BIGINT)) THEN l END) AS ink, max(CASE WHEN k = least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) THEN l END) AS paper FROM lit GROUP BY 1, 2),
    ratios AS (SELECT image_id, box AS box_id, (greatest(ink, paper) + 0.05) / (least(ink, paper) + 0.05) AS c FROM ends)
    SELECT image_id, box_id, round(c, 6) AS measured, round(min(c) OVER (PARTITION BY image_id), 6) AS worst FROM ratios""",
)
def contrast_sweep(d: DataFrame) -> DataFrame:
    frames = d.select("image_id", F.lit(WIDE).alias("width"), F.lit(HIGH).alias("height"))
    measured = sweeps.sweep(_painted(d), pictures.box_shapes(frames))
    return measured.join(pictures.worst_contrast(measured), "image_id").select("image_id", "box_id", F.round("contrast", 6).alias("measured"), F.round("worst", 6).alias("worst"))
