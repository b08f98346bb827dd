"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..functions.warning import assess, compatible, warning_diff, words
from ..operators.rules import compare_text, uncertain
from ..schemas import WARNING
from ..constants import STATUTORY_WARNING
from .base import query

NAMES = """
    SELECT p_partkey, p_partkey % 9 AS v, concat(p_name, ' & ', p_brand, ' Co.') AS filed,
        CASE p_partkey % 9
            WHEN 0 THEN concat(p_name, ' & ', p_brand, ' Co.')
            WHEN 1 THEN concat(p_name, '  & ', p_brand, ' Co. ')
            WHEN 2 THEN concat(p_name, '’s & ', p_brand, ' Co.')
            WHEN 3 THEN upper(concat(p_name, ' & ', p_brand, ' Co.'))
            WHEN 4 THEN concat('é', p_name, ' & ', p_brand, ' Co.')
            WHEN 5 THEN concat(p_name, ' &  ', p_brand, ' Co')
            WHEN 6 THEN concat('The ', p_name, ' and ', p_brand, ' Company')
            WHEN 7 THEN concat('old ', p_name, ' & ', p_brand, ' company')
            ELSE p_type END AS found
    FROM {part}"""
FILED = f"SELECT p_partkey, v, CASE v WHEN 2 THEN replace(filed, ' &', '''s &') WHEN 4 THEN concat('E', filed) ELSE filed END AS filed, found FROM ({NAMES}) AS n"


@query(FILED, "SELECT v, CASE v WHEN 0 THEN 'exact' WHEN 1 THEN 'whitespace' WHEN 2 THEN 'typography' WHEN 3 THEN 'case' WHEN 4 THEN 'accents' WHEN 5 THEN 'punctuation' WHEN 6 THEN 'synonyms' END AS level, count(*) AS n FROM given GROUP BY 1, 2")
def ladder_level_counts(d: DataFrame) -> DataFrame:
    formed = d.select("v", text.forms(F.col("filed")).alias("a"), text.forms(F.col("found")).alias("b"))
    return formed.groupBy("v", text.ladder_level(F.col("a"), F.col("b")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    FILED,
    """SELECT p_partkey, CASE WHEN v = 8 THEN CASE WHEN sim >= 0.82 THEN 'review' ELSE 'fail' END WHEN v = 7 THEN 'review' ELSE 'pass' END AS verdict,
        CASE v WHEN 0 THEN 'normalised-match:exact' WHEN 1 THEN 'normalised-match:whitespace' WHEN 2 THEN 'normalised-match:typography' WHEN 3 THEN 'normalised-match:case' WHEN 4 THEN 'normalised-match:accents'
            WHEN 5 THEN 'normalised-match:punctuation' WHEN 6 THEN 'normalised-match:synonyms' WHEN 7 THEN 'label-adds-words-needs-review' ELSE CASE WHEN sim >= 0.82 THEN 'near-match-needs-review' ELSE 'mismatch' END END AS rule
    FROM (SELECT *, 1 - levenshtein(lower(filed), lower(found)) / CAST(greatest(length(filed), length(found)) AS DOUBLE) AS sim FROM given) AS g""",
)
def text_compare_verdict(d: DataFrame) -> DataFrame:
    formed = d.withColumns({"a": text.forms(F.col("filed")), "b": text.forms(F.col("found")), "reading": F.struct(F.col("found").alias("text"), F.lit(0.9).alias("confidence"))})
    done = formed.select("p_partkey", compare_text("class_type", "Class / Type", F.col("filed"), F.col("reading"), F.col("a"), F.col("b"), "27 CFR 5.63", "review").alias("c"))
    return done.select("p_partkey", "c.verdict", "c.rule")


@query("SELECT doc_id, concat('“', text, '”—′') AS text FROM {documents}", "SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN md5(concat('\"', d.text, '\"-''')) END AS folded FROM given JOIN documents AS d USING (doc_id)")
def typography_fold(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.md5(text.fold_typography(F.col("text"))).alias("folded"))


@query("SELECT doc_id, text FROM {documents}", "SELECT doc_id, md5(strip_accents(text)) AS plain FROM given")
def diacritics_fold(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.md5(text.strip_diacritics(F.col("text"))).alias("plain"))


@query("SELECT doc_id, text FROM {documents}", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS flat FROM given")
def whitespace_collapse(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.md5(text.collapse_whitespace(F.col("text"))).alias("flat"))


SUFFIXED = "SELECT s_suppkey, concat('The ', s_name, CASE s_suppkey % 4 WHEN 0 THEN ' Co., Inc.' WHEN 1 THEN ' Whisky Dist. Ltd' WHEN 2 THEN ' & Bros. 1 L' ELSE ' of a Corp' END) AS name FROM {supplier}"


@query(
    SUFFIXED,
    """SELECT s_suppkey, concat('supplier ', lpad(CAST(s_suppkey AS STRING), 9, '0'), CASE s_suppkey % 4 WHEN 0 THEN ' company incorporated' WHEN 1 THEN ' whiskey distillery limited' WHEN 2 THEN ' and brothers 1 litre' ELSE ' corporation' END) AS tokens FROM given""",
)
def canonical_tokens(d: DataFrame) -> DataFrame:
    return d.select("s_suppkey", F.array_join(text.canonical_tokens(F.col("name")), " ").alias("tokens"))


PAIRS = "SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM {part} AS a JOIN {part} AS b ON b.p_partkey = a.p_partkey + 1"


@query(PAIRS, "SELECT p_partkey, round(1 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE), 9) AS similarity FROM given")
def edit_similarity(d: DataFrame) -> DataFrame:
    return d.select("p_partkey", F.round(text.edit_similarity(F.col("x"), F.col("y")), 9).alias("similarity"))


@query(
    PAIRS,
    """SELECT p_partkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 9) AS jaccard
    FROM (SELECT p_partkey, string_split(x, ' ') AS a, string_split(y, ' ') AS b FROM given) AS g""",
)
def jaccard_tokens(d: DataFrame) -> DataFrame:
    return d.select("p_partkey", F.round(text.token_similarity(text.canonical_tokens(F.col("x")), text.canonical_tokens(F.col("y"))), 9).alias("jaccard"))


@query(
    "SELECT p_partkey, p_name AS wanted, concat('ZZ', p_type, ' ', p_name, CASE WHEN p_partkey % 2 = 0 THEN ' yy yy' ELSE '' END) AS had FROM {part}",
    "SELECT p_partkey, true AS contained, concat('zz', lower(p_type), CASE WHEN p_partkey % 2 = 0 THEN ' yy yy' ELSE '' END) AS extra FROM given JOIN part USING (p_partkey)",
)
def containment_extra(d: DataFrame) -> DataFrame:
    tokens = d.withColumns({c: text.canonical_tokens(F.col(c)) for c in ("wanted", "had")})
    wanted, had = F.col("wanted"), F.col("had")
    return tokens.select("p_partkey", text.contains_all(had, wanted).alias("contained"), F.array_join(text.extra_tokens(had, wanted), " ").alias("extra"))


@query(
    "SELECT p_partkey, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' / No. 1!' WHEN 1 THEN '   Ünique' ELSE '’s' END) AS name FROM {part}",
    "SELECT p_partkey, concat(replace(p_name, ' ', '-'), CASE p_partkey % 3 WHEN 0 THEN '-no-1' WHEN 1 THEN '-unique' ELSE 's' END) AS slug FROM given JOIN part USING (p_partkey)",
)
def slug(d: DataFrame) -> DataFrame:
    return d.select("p_partkey", text.slug(F.col("name")).alias("slug"))


HEADERS = "SELECT page_id, concat(' ', replace(replace(url, '/', '_'), '.', ' - '), ' ') AS header FROM {pages}"


@query(HEADERS, r"SELECT page_id, regexp_replace(lower(header), '[\s_-]+', '', 'g') AS header FROM given")
def header_normalise(d: DataFrame) -> DataFrame:
    return d.select("page_id", scalars.header_column(F.col("header")).alias("header"))


CELLS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('=', text) WHEN 1 THEN concat('\"', text, '\"') WHEN 2 THEN concat('@', lang) WHEN 3 THEN lang WHEN 4 THEN concat('-', lang, ',x') ELSE text END AS cell FROM {documents}"


@query(
    CELLS,
    """SELECT doc_id, md5(CASE WHEN cell IS NULL THEN '' WHEN regexp_matches(guarded, '[",\\n\\r]') THEN concat('"', replace(guarded, '"', '""'), '"') ELSE guarded END) AS cell
    FROM (SELECT doc_id, cell, CASE WHEN regexp_matches(cell, '^[=+@\\t\\r-]') THEN concat('''', cell) ELSE cell END AS guarded FROM given) AS g""".replace("\\\\", "\\"),
)
def csv_escape(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.md5(scalars.csv_cell(F.col("cell"))).alias("cell"))


@query(
    "SELECT event_id, user_id, event_id % 5 AS v FROM {events}",
    """SELECT CASE v WHEN 0 THEN concat('p', CAST(user_id AS STRING)) WHEN 1 THEN concat('c', CAST(user_id AS STRING)) WHEN 2 THEN concat('r', CAST(user_id AS STRING)) WHEN 3 THEN concat('h', CAST(user_id AS STRING)) ELSE 'unknown' END AS client,
        count(*) AS n FROM given GROUP BY 1""",
)
def client_key(d: DataFrame) -> DataFrame:
    u = F.col("user_id").cast("string")
    one = lambda k, v: F.create_map(F.lit(k), v)
    headers = (
        F.when(F.col("v") == 0, F.create_map(F.lit("x-vercel-forwarded-for"), F.concat(F.lit(" p"), u), F.lit("x-real-ip"), F.lit("no")))
        .when(F.col("v") == 1, one("cf-connecting-ip", F.concat(F.lit("c"), u)))
        .when(F.col("v") == 2, one("x-real-ip", F.concat(F.lit("r"), u)))
        .when(F.col("v") == 3, one("x-forwarded-for", F.concat(F.lit("spoofed, h"), u, F.lit(" , "))))
        .otherwise(one("x-forwarded-for", F.lit(" ,")))
    )
    return d.groupBy(scalars.client_key(headers).alias("client")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT page_id, page_id % 6 AS v, html FROM {pages}",
    "SELECT page_id, CASE v WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' END AS mime FROM given",
)
def magic_sniff(d: DataFrame) -> DataFrame:
    start = F.when(F.col("v") == 0, "89504E470D0A1A0A").when(F.col("v") == 1, "FFD8FFE0").when(F.col("v") == 2, "474946383961").when(F.col("v") == 3, "524946463132333457454250").when(F.col("v") == 4, "5249464631323334").otherwise("")
    return d.select("page_id", scalars.sniff_image(F.concat(F.unhex(start), F.encode("html", "UTF-8"))).alias("mime"))


@query(
    "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Distilled Spirits' WHEN 1 THEN 'LIQUOR' WHEN 2 THEN 'wine' WHEN 3 THEN 'malt_beverage' WHEN 4 THEN 'Beer' WHEN 5 THEN 'Malt' WHEN 6 THEN event_type ELSE '' END AS kind, CASE event_id % 4 WHEN 0 THEN 'YES' WHEN 1 THEN '1' WHEN 2 THEN 'no' ELSE event_type END AS flag FROM {events}",
    "SELECT event_id, CASE event_id % 8 WHEN 2 THEN 'wine' WHEN 3 THEN 'malt_beverage' WHEN 4 THEN 'malt_beverage' WHEN 5 THEN 'malt_beverage' ELSE 'distilled_spirits' END AS beverage, event_id % 4 < 2 AS flag FROM given",
)
def manifest_values(d: DataFrame) -> DataFrame:
    return d.select("event_id", scalars.beverage_type(F.col("kind")).alias("beverage"), scalars.truthy(F.col("flag")).alias("flag"))


STATUTE = STATUTORY_WARNING.replace("'", "''")
VARIANTS = f"""SELECT item_id, item_id % 7 AS v, CASE item_id % 7 WHEN 0 THEN '{STATUTE}' WHEN 1 THEN replace('{STATUTE}', 'may', 'might') WHEN 2 THEN replace('{STATUTE}', ' during pregnancy', '')
    WHEN 3 THEN replace('{STATUTE}', 'GOVERNMENT WARNING', 'Government Warning') WHEN 4 THEN replace('{STATUTE}', 'car or', 'car  or big') WHEN 5 THEN '' ELSE lower('{STATUTE}') END AS text FROM {{benchmark}}"""


@query(
    VARIANTS,
    """SELECT item_id, v IN (0, 3, 6) AS wording_exact, CASE v WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS insertions, CASE v WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 43 ELSE 0 END AS deletions, v NOT IN (3, 5, 6) AS header_caps,
        CASE WHEN v IN (0, 3, 6) THEN 1 WHEN v = 5 THEN 1 WHEN v = 2 THEN 3 WHEN v = 1 THEN 4 ELSE 3 END AS runs FROM given""",
)
def warning_assess(d: DataFrame) -> DataFrame:
    reading = F.struct(F.col("text").alias("text"), F.lit(0.9).alias("confidence"), F.lit(True).alias("header_is_all_caps"), F.lit(True).alias("header_is_bold"), F.lit(True).alias("legible_size"), F.lit(None).alias("bounds"), F.lit(None).alias("appearance"))
    r = d.withColumns({"r": reading.cast(WARNING), "plain": compatible(F.col("text"))}).withColumn("diff", warning_diff(words(F.col("plain"))))
    a = assess(F.col("r"), F.col("plain"), F.col("diff"))
    return r.withColumn("a", a).select("item_id", "a.wording_exact", "a.insertions", "a.deletions", "a.header_caps", F.size("diff").alias("runs"))


@query("SELECT event_id, value / 100 AS confidence FROM {events}", "SELECT event_id, confidence < 0.5 AS unusable FROM given")
def confidence_gate(d: DataFrame) -> DataFrame:
    return d.select("event_id", uncertain(F.struct("confidence")).alias("unusable"))


@query(
    "SELECT event_id, CAST(event_id % 7 AS INT) AS attempt, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 20 AS INT) END AS retry_after, CAST(CASE event_id % 6 WHEN 0 THEN 400 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 ELSE 418 END AS INT) AS status FROM {events}",
    """SELECT event_id, CAST(CASE WHEN retry_after > 0 THEN least(retry_after * 1000, 15000) ELSE least(500 * pow(2, attempt) + event_id % 250, 15000) END AS BIGINT) AS wait_ms, status NOT IN (403, 404) AS retryable FROM given""",
)
def retry_plan(d: DataFrame) -> DataFrame:
    return d.select("event_id", scalars.backoff_ms(F.col("attempt"), F.col("retry_after"), F.col("event_id") % 250).alias("wait_ms"), scalars.http_error(F.col("status"), F.lit(""))["retryable"].alias("retryable"))


@query(
    "SELECT event_id, ts FROM {events}",
    "SELECT event_id, CAST(hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2 AS INT) AS dos_time, CAST((year(ts) - 1980) * 512 + month(ts) * 32 + day(ts) AS INT) AS dos_date FROM given",
)
def dos_times(d: DataFrame) -> DataFrame:
    t = scalars.dos_time(F.col("ts"))
    return d.select("event_id", t["time"].alias("dos_time"), t["date"].alias("dos_date"))
