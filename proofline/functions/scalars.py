"""Smaller scalar functions: files, headers, cells, clients, errors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BACKOFF_FIRST_MS, BACKOFF_MOST_MS, BEVERAGE_ALIASES, DEFAULT_BEVERAGE, MAX_EDGE_PIXELS, MAX_FIELD_CHARS, SMALL_IMAGE_BYTES, SUPPORTED_IMAGES
from .text import WS, trimmed


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def normalise_header(name: str) -> str:
    """A CSV header without case, spaces, hyphens and underscores."""
    return re.sub(r"[\s_-]+", "", name.strip().lower())


def header_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), f"(?:{WS}|[_-])+", "")


def csv_cell(c: Column) -> Column:
    """A cell that a spreadsheet will not take for a formula, quoted where needed; null is empty."""
    guarded = F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    quoted = F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(guarded.rlike('[",\\n\\r]'), quoted).otherwise(guarded), F.lit(""))


def sniff_image(content: Column) -> Column:
    """Media type by the first bytes of a file of 12 at least; null if none of the four is known."""
    starts = lambda n, hexes: F.substring(content, 1, n) == F.unhex(F.lit(hexes))
    webp = starts(4, "52494646") & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))
    kind = (
        F.when(starts(8, "89504E470D0A1A0A"), "image/png")
        .when(starts(3, "FFD8FF"), "image/jpeg")
        .when(starts(6, "474946383761") | starts(6, "474946383961"), "image/gif")
        .when(webp, "image/webp")
    )
    return F.when(F.octet_length(content) >= 12, kind)


def supported_image(mime: Column) -> Column:
    return F.coalesce(mime.isin(*SUPPORTED_IMAGES), F.lit(False))


def beverage_type(c: Column) -> Column:
    """One of the three types by its aliases; anything unknown counts as spirits."""
    return F.coalesce(lookup(BEVERAGE_ALIASES, header_column(c)), F.lit(DEFAULT_BEVERAGE))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin("true", "yes", "y", "1"), F.lit(False))


def bounded_text(c: Column) -> tuple[Column, Column]:
    """(value, error): trimmed text, null if blank; an error instead of a cut where it is too long."""
    return F.nullif(trimmed(c), F.lit("")), F.when(F.length(c) > MAX_FIELD_CHARS, F.lit("too long"))


def client_key(headers: Column) -> Column:
    """Who asks: the platform's header, the proxy's, or the last hop of the forwarded ones; a blank platform or proxy header is skipped."""
    get = lambda name: F.try_element_at(headers, F.lit(name))
    given = lambda c: F.when(c != "", trimmed(c))
    platform = given(F.coalesce(get("x-vercel-forwarded-for"), get("cf-connecting-ip")))
    hops = F.filter(F.transform(F.split(get("x-forwarded-for"), ","), trimmed), lambda h: h != "")
    return F.coalesce(platform, given(get("x-real-ip")), F.try_element_at(hops, F.lit(-1)), F.lit("unknown"))


def jpeg_name(c: Column) -> Column:
    return F.concat(F.regexp_replace(c, "\\.[^.]+$", ""), F.lit(".jpg"))


def downscaled(mime: Column, size: Column, width: Column, height: Column) -> Column:
    """struct<skipped, width, height>: the size a picture is reduced to before reading."""
    edge = F.greatest(width, height)
    skipped = (mime == "image/gif") | (size <= SMALL_IMAGE_BYTES) | (edge <= MAX_EDGE_PIXELS)
    scaled = lambda v: F.floor(v * (F.lit(float(MAX_EDGE_PIXELS)) / edge) + 0.5).cast("int")
    keep = lambda v: F.when(skipped, v.cast("int")).otherwise(scaled(v))
    return F.struct(skipped.alias("skipped"), keep(width).alias("width"), keep(height).alias("height"))


def backoff_ms(attempt: Column, retry_after_s: Column, jitter_ms: Column | None = None) -> Column:
    """Wait before a retry: what the server asks, else doubling and the jitter the caller gives, both bounded."""
    asked = F.when(retry_after_s > 0, F.least(retry_after_s * 1000, F.lit(BACKOFF_MOST_MS)))
    doubled = F.lit(BACKOFF_FIRST_MS) * F.pow(F.lit(2), attempt) + (F.lit(0) if jitter_ms is None else jitter_ms)
    return F.coalesce(asked, F.least(doubled, F.lit(BACKOFF_MOST_MS))).cast("long")


def http_error(status: Column, body: Column) -> Column:
    """struct<kind, retryable> of a failed reading."""
    def of(kind: str, again: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(again).alias("retryable"))

    return (
        F.when((status == 400) & body.rlike("(?i)API key not valid"), of("invalid key", False))
        .when(status == 403, of("forbidden", False))
        .when(status == 404, of("no such model", False))
        .when(status == 429, of("rate limited", True))
        .when(status >= 500, of("upstream", True))
        .otherwise(of("other", True))
    )


def reader_error(status: Column, message: Column) -> Column:
    """struct<kind, retryable> of a reading by the second reader that failed; without a status it is the connection's failure."""
    def of(kind: str, again: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(again).alias("retryable"))

    return (
        F.when(status.isin(401, 403), of("invalid key", False))
        .when(status == 429, of("rate limited", True))
        .when((status == 400) & message.rlike("(?i)credit|billing"), of("no credit", False))
        .when(status >= 500, of("upstream", True))
        .when(status.isNull() & message.rlike("(?i)timed? ?-?out"), of("timeout", True))
        .when(status.isNull() & message.rlike("(?i)connect"), of("connection", True))
        .otherwise(of("other", True))
    )


def dos_time(ts: Column) -> Column:
    """struct<time, date int> as archives have them: two-second steps, years from 1980."""
    year = F.greatest(F.year(ts), F.lit(1980)) - 1980
    time = F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.shiftright(F.second(ts), 1))
    return F.struct(time.alias("time"), F.shiftleft(year, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts)).alias("date"))
