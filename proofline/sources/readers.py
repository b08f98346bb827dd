"""Reading manifests, pictures, sample lists, readings and requests. A bad row gets an error; it does not stop a job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..constants import BEVERAGE_TYPES, MAX_APPLICATION_CHARS, MAX_IMAGE_BYTES
from ..functions.scalars import beverage_type, bounded_text, normalise_header, sniff_image, supported_image, truthy
from ..functions.text import let, trimmed
from ..schemas import APPLICATION, EXTRACTION
from .csv_ranges import read_records


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-string records under normalised headers: cells trimmed, missing ones empty, blank rows left out.

    Quotes, doubled quotes, commas and line ends in cells are read as such; of equal headers the last counts. Each
    file of a folder has its header; files whose headers differ are an error. `_line` numbers the rows, files in the
    order of their paths. A file is read in ranges, by many tasks, whatever its quotes hold.
    """
    rows, heads = read_records(spark, path)
    found = heads.select("cells").distinct().limit(2).collect()
    if not found:
        return spark.createDataFrame([], "_line long")
    if len(found) > 1:
        raise ValueError(f"files under {path} have different headers")
    headers = {normalise_header(h): k for k, h in enumerate(found[0]["cells"])}
    filled = rows.select(F.transform("cells", trimmed).alias("cells"), F.col("line").alias("_line")).where(F.exists("cells", lambda c: c != ""))
    return filled.select(*[F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(h) for h, k in headers.items() if h], "_line")


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in the order given."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def load_manifest(records: DataFrame) -> DataFrame:
    """Applications by filename_key from CSV records: of rows with one file name the last counts, rows without go."""
    got = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in records.columns], F.lit(None).cast("string"))
    rows = records.select(
        F.lower(trimmed(got("filename", "file", "image"))).alias("filename_key"), "_line", got("applicationid").alias("application_id"), F.lit(None).cast("string").alias("ttb_id"),
        beverage_type(F.coalesce(F.col("beveragetype") if "beveragetype" in records.columns else got("type"), F.lit(""))).alias("beverage_type"),
        F.coalesce(got("brandname"), F.lit("")).alias("brand_name"), F.coalesce(got("classtype"), F.lit("")).alias("class_type"), got("alcoholcontent").alias("alcohol_content"), got("netcontents").alias("net_contents"),
        got("bottlername").alias("bottler_name"), F.lit(None).cast("string").alias("label_company_name"), got("countryoforigin").alias("country_of_origin"), truthy(got("isimport")).alias("is_import"),
    )
    return last_per_key(rows.where(F.col("filename_key").isNotNull()), "filename_key", "_line").drop("_line")


def rekey(items: DataFrame, manifest: DataFrame, key: str = "filename_key") -> DataFrame:
    """Items with the manifest's values where it has the file, their own otherwise."""
    cols = [c for c in items.columns if c != key and c in manifest.columns]
    new = manifest.select(key, F.struct(*cols).alias("_new"))
    there = F.col("_new").isNotNull()
    return items.join(new, key, "left").withColumns({c: F.when(there, F.col("_new")[c]).otherwise(F.col(c)) for c in cols}).drop("_new")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, filename, filename_key, mime, length, content, path) of the pictures under a path; of equal ids the first path counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(
        F.concat_ws(":", name, F.col("length"), F.unix_millis("modificationTime")).alias("image_id"), name.alias("filename"), F.lower(name).alias("filename_key"),
        sniff_image(F.col("content")).alias("mime"), "length", "content", "path",
    )
    return first_per_key(out.where(supported_image(F.col("mime")) & F.col("length").between(1, MAX_IMAGE_BYTES)), "image_id", "path")


def match_images(images: DataFrame, manifest: DataFrame, key: str = "filename_key") -> DataFrame:
    """Every image, with its application where the manifest has one. The join's side is Spark's to pick, by size."""
    return images.join(manifest, key, "left")


def unmatched_images(images: DataFrame, manifest: DataFrame, key: str = "filename_key") -> DataFrame:
    return images.join(manifest, key, "left_anti")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The sample list, a JSON file of one array `samples`."""
    schema = f"samples array<struct<id:string,file:string,title:string,isDefault:boolean,application:struct<{APPLICATION.replace(' ', ':')}>,expected:struct<recommendation:string,checks:map<string,string>>>>"
    schema = re.sub(r",:", ",", schema)
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("samples"))


def default_sample(samples: DataFrame) -> DataFrame:
    return samples.where("isDefault").orderBy("id").limit(1)


def parse_applications(raw: Column) -> Column:
    """struct<value, error> of an application in JSON: one of three types, brand and class given, no field too long.

    Fields outside the ten are left out; a value that is no string is none, and only `true` is an import. A text is
    parsed once, a field taken out once.
    """
    names = {
        "application_id": "applicationId", "brand_name": "brandName", "class_type": "classType", "alcohol_content": "alcoholContent", "net_contents": "netContents",
        "bottler_name": "bottlerName", "label_company_name": "labelCompanyName", "country_of_origin": "countryOfOrigin",
    }

    def taken(got: Column) -> Column:
        field = lambda name: F.when(F.schema_of_variant(F.try_variant_get(got, f"$.{name}", "variant")) == "STRING", F.try_variant_get(got, f"$.{name}", "string"))
        imported = F.schema_of_variant(F.try_variant_get(got, "$.isImport", "variant")) == "BOOLEAN"
        return F.struct(
            F.coalesce(F.schema_of_variant(got).startswith("OBJECT"), F.lit(False)).alias("valid"), field("beverageType").alias("beverage_type"),
            F.coalesce(imported & F.try_variant_get(got, "$.isImport", "boolean"), F.lit(False)).alias("is_import"), *[field(j).alias(n) for n, j in names.items()],
        )

    def checked(f: Column) -> Column:
        texts = {n: bounded_text(f[n]) for n in names}
        kind = f["beverage_type"]
        value = F.struct(*[v.alias(n) for n, (v, _) in texts.items()], F.lit(None).cast("string").alias("ttb_id"), kind.alias("beverage_type"), f["is_import"].alias("is_import"))
        long = F.coalesce(*[F.when(e.isNotNull(), F.lit(f"{n}: too long")) for n, (_, e) in texts.items()])
        error = (
            F.when(F.length(raw) > MAX_APPLICATION_CHARS, "application: too long")
            .when(~f["valid"], "application: not valid")
            .when(~F.coalesce(kind.isin(*BEVERAGE_TYPES), F.lit(False)), "beverage_type: not one of three")
            .when(long.isNotNull(), long)
            .when(texts["brand_name"][0].isNull(), "brand_name: missing")
            .when(texts["class_type"][0].isNull(), "class_type: missing")
        )
        return let(error, lambda e: F.struct(F.when(e.isNull(), value).alias("value"), e.alias("error")))

    return let(let(F.try_parse_json(raw), taken), checked)


def request_error(content: Column, mime: Column, application: Column) -> Column:
    """Why a request is refused before anything is parsed; null if it is not."""
    size = F.octet_length(content)
    return (
        F.when(F.coalesce(size == 0, F.lit(True)), "image: missing")
        .when(size > MAX_IMAGE_BYTES, "image: too large")
        .when(~supported_image(F.coalesce(sniff_image(content), mime)), "image: not supported")
        .when(application.isNull(), "application: missing")
        .when(F.length(application) > MAX_APPLICATION_CHARS, "application: too long")
    )


def parse_extractions(raw: Column) -> Column:
    """struct<value, error> of a reading in JSON: defaults first, then confidences and scores must lie in 0 to 1; three problems at most are named.

    A text is parsed once, whatever is asked of the result. What is left out gets defaults that have no problem.
    """
    fields = ["brand_name", "class_type", "alcohol_content", "net_contents", "bottler_name", "country_of_origin", "government_warning"]
    outside = lambda c, name: F.when(~c.between(0, 1), F.lit(f"{name}: outside 0 to 1"))
    missing = lambda c, name: F.when(c.isNotNull() & (c["text"].isNull() | c["confidence"].isNull()), F.lit(f"{name}: incomplete"))

    def problems(got: Column) -> Column:
        issues = [outside(got[f]["confidence"], f) for f in fields] + [missing(got[f], f) for f in fields] + [outside(got[f]["score"], f) for f in ("image_quality", "label_legibility")]
        return let(F.slice(F.array_compact(F.array(*issues)), 1, 3), lambda named: F.when(F.size(named) > 0, F.array_join(named, "; ")))

    def checked(got: Column) -> Column:
        error = F.when(F.try_parse_json(raw).isNull(), "reading: not valid").otherwise(problems(got))
        return let(error, lambda e: F.struct(F.when(e.isNull(), with_defaults(got)).alias("value"), e.alias("error")))

    return let(F.from_json(raw, EXTRACTION, {"mode": "PERMISSIVE"}), checked)


def with_defaults(got: Column) -> Column:
    """A reading with what its reader left out: middling quality and legibility, no notes."""
    quality = F.struct(F.lit(0.5).alias("score"), F.array(F.lit("image quality not reported")).alias("issues"), F.lit(False).alias("too_poor_to_review"))
    legibility = F.struct(F.lit(0.75).alias("score"), F.lit(False).alias("below_ordinary_eyesight"), F.array(F.lit("legibility not assessed")).alias("issues"))
    out = got.withField("image_quality", F.coalesce(got["image_quality"], quality)).withField("label_legibility", F.coalesce(got["label_legibility"], legibility))
    return out.withField("notes", F.coalesce(got["notes"], F.array().cast("array<string>")))


def read_with(images: DataFrame, reader: Callable[[bytes], dict], key: str = "filename_key") -> DataFrame:
    """(key, reading json, error) by a function from a picture's bytes to a reading; a picture that fails has its error instead."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for k, content in zip(b[key], b["content"], strict=True):
                try:
                    out.append((k, json.dumps(reader(bytes(content))), None))
                except Exception as e:  # noqa: BLE001 the row is set aside with what went wrong
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "reading", "error"])

    return images.select(key, "content").mapInPandas(run, T.StructType([T.StructField(key, T.StringType()), T.StructField("reading", T.StringType()), T.StructField("error", T.StringType())]))


def constant_reading(images: DataFrame, reading: Column, key: str = "filename_key") -> DataFrame:
    """The same reading for every image: what stands in where no reader is configured."""
    return images.select(key, reading.alias("reading")).select(key, "reading.*")


def choose_reader(available: list[str], preferred: str | None = None) -> str:
    """The preferred reader if it is available or the stand-in, else the first available, else the stand-in."""
    if preferred == "mock" or preferred in available:
        return preferred
    return available[0] if available else "mock"


def first_success(attempts: DataFrame, key: str = "filename_key", order: str = "attempt") -> DataFrame:
    """A key's first attempt without error, if no attempt before it failed for good; (key, the attempt's columns)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    open_ = attempts.withColumn("_stopped", F.coalesce(F.max(F.when(F.col("error").isNotNull() & ~F.col("retryable"), 1)).over(w), F.lit(0)))
    return first_per_key(open_.where("_stopped = 0 and error is null").drop("_stopped"), key, order)


def listed_sizes(documents: DataFrame, heading: str, text: str = "value") -> DataFrame:
    """(ml) of the sizes in the first fenced list after a heading of a document, rising."""
    found = F.regexp_extract(text, f"(?s){re.escape(heading)}.*?```[^\\n]*\\n(.*?)```", 1)
    item = F.explode(F.regexp_extract_all(found, F.lit("(?i)(\\d+(?:\\.\\d+)?\\s*(?:mL|L)\\b)")))
    rows = documents.select(item.alias("item"))
    number = F.regexp_extract("item", "^[\\d.]+", 0).try_cast("double")
    return rows.select(F.when(F.lower("item").endswith("ml"), number).otherwise(number * 1000).alias("ml")).distinct().orderBy("ml")


def difference(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """(on, side): values that only one side has."""
    return left.join(right, on, "left_anti").select(on, F.lit("left").alias("side")).union(right.join(left, on, "left_anti").select(on, F.lit("right").alias("side")))
