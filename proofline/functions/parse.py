"""Numbers out of alcohol, volume and colour statements, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ABV_TOLERANCE, MAX_ABV, MAX_PROOF, PROOF_SLACK, UNITS_ML, VULGAR_FRACTIONS, WINE_TOLERANCE_ABOVE, WINE_TOLERANCE_TO_14
from .text import WS, let, normalized, trimmed

# Fixed by the contract: what counts as a statement of alcohol, proof or volume.
NUMBER = "(\\d*[.,]?\\d+)"
PROOF = f"(?i){NUMBER}{WS}*(?:degrees?{WS}*)?proof"
#: Tried in this order; the first whose number is plausible counts. With each what a text must contain, in lower
#: case, for it to match: most texts are spared most of the patterns.
ABV_PATTERNS = (
    (f"(?i){NUMBER}{WS}*%{WS}*(?:alc|alcohol|abv|vol)", "%"),
    (f"(?i)(?:alc|alcohol|abv)\\.?{WS}*{NUMBER}{WS}*(?:%|percent)?{WS}*(?:by{WS}*)?vol", "vol"),
    (f"^{WS}*{NUMBER}{WS}*%?{WS}*$", ""),
)
VOLUME = (
    f"(?i)(\\d+(?:[.,]\\d+)?){WS}*(ml|milliliters?|millilitres?|cl|centiliters?|centilitres?|dl|l|liters?|litres?|"
    f"fl\\.?{WS}*oz\\.?|fluid{WS}+ounces?|oz\\.?|pints?|quarts?|gallons?)"
)
#: No word character may follow a unit that ends in one; after a full stop one must.
VOLUME_END = "(?:(?<=[A-Za-z])(?![A-Za-z0-9_])|(?<=\\.)(?=[A-Za-z0-9_]))"


def decimal(c: Column) -> Column:
    """A number with a decimal comma or point; null if there is none."""
    return F.regexp_replace(c, ",", ".").try_cast("double")


def expand_fractions(c: Column) -> Column:
    for glyph, digits in VULGAR_FRACTIONS.items():
        c = F.replace(c, F.lit(glyph), F.lit(digits))
    return c


def _first(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def alcohol_text(c: Column) -> Column:
    """What parse_alcohol reads: fractions written out, compatibility form."""
    return trimmed(normalized(expand_fractions(c), "NFKC"))


def parse_alcohol(text: Column) -> Column:
    """struct<abv, proof, derived, matched> of an alcohol_text(); null numbers where it states none."""

    def found(c: Column, pattern: str, needs: str) -> Column:
        get = lambda group: F.when(F.contains(F.lower(c), F.lit(needs)), _first(c, pattern, group)).otherwise("")
        return F.struct(decimal(get(1)).alias("value"), get(0).alias("matched"))

    def without(text: Column, proof: Column) -> Column:
        at = F.position(proof["matched"], text)
        return F.when(proof["matched"] != "", F.concat(F.substr(text, F.lit(1), at - 1), F.lit(" "), F.substr(text, at + F.length(proof["matched"])))).otherwise(text)

    def result(proof: Column, hit: Column) -> Column:
        stated = F.when(proof["value"].between(0.0, MAX_PROOF), proof["value"])
        derived = F.coalesce(hit["value"].isNull() & stated.isNotNull(), F.lit(False))
        return F.struct(
            F.coalesce(hit["value"], stated / 2).alias("abv"),
            stated.alias("proof"),
            derived.alias("derived"),
            trimmed(F.when(derived, proof["matched"]).otherwise(hit["matched"])).alias("matched"),
        )

    def first_plausible(rest: Column) -> Column:
        return F.get(F.filter(F.array(*[found(rest, *p) for p in ABV_PATTERNS]), lambda h: h["value"].between(0.0, MAX_ABV)), 0)

    return let(text, lambda t: let(found(t, PROOF, "proof"), lambda proof: let(let(without(t, proof), first_plausible), lambda hit: result(proof, hit))))


def proof_consistent(reading: Column) -> Column:
    """Null unless both numbers are there; derived ones agree; else proof is twice the alcohol, give or take one."""
    both = reading["abv"].isNotNull() & reading["proof"].isNotNull()
    return F.when(both, reading["derived"] | (F.abs(reading["proof"] - reading["abv"] * 2) <= PROOF_SLACK))


def tolerance(beverage: Column, declared_abv: Column) -> Column:
    wine = F.when(declared_abv <= 14, WINE_TOLERANCE_TO_14).otherwise(WINE_TOLERANCE_ABOVE)
    return F.when(beverage == "wine", wine).otherwise(F.lit(ABV_TOLERANCE["distilled_spirits"]))


def volume_text(c: Column) -> Column:
    return trimmed(normalized(c, "NFKC"))


def canonical_unit(c: Column) -> Column:
    clean = trimmed(F.regexp_replace(F.replace(F.lower(c), F.lit("."), F.lit("")), f"{WS}+", " "))
    return F.when(clean.rlike("^fl ?oz$"), "fl oz").otherwise(clean)


def parse_volume(text: Column) -> Column:
    """struct<ml, unit, value, matched> of the leftmost volume in a volume_text(); nulls where there is none."""
    pattern = VOLUME + VOLUME_END
    factors = F.create_map(*[F.lit(x) for pair in UNITS_ML.items() for x in pair])

    def result(unit: Column) -> Column:
        ml = unit["value"] * F.try_element_at(factors, canonical_unit(unit["unit"]))
        given = lambda c: F.when(ml.isNotNull(), c)
        return F.struct(ml.alias("ml"), given(trimmed(unit["unit"])).alias("unit"), given(unit["value"]).alias("value"), given(trimmed(unit["matched"])).alias("matched"))

    read = lambda t: F.struct(decimal(_first(t, pattern, 1)).alias("value"), _first(t, pattern, 2).alias("unit"), _first(t, pattern, 0).alias("matched"))
    return let(text, lambda t: let(read(t), result))


def format_volume(ml: Column) -> Column:
    """Litres from one up, millilitres below; whole numbers without decimals."""
    litres = ml / 1000
    big = F.when(litres == F.floor(litres), litres.cast("long").cast("string")).otherwise(F.format_string("%.2f", litres))
    small = F.when(ml == F.floor(ml), ml.cast("long").cast("string")).otherwise(F.format_string("%.1f", ml))
    return F.when(ml >= 1000, F.concat(big, F.lit(" L"))).otherwise(F.concat(small, F.lit(" mL")))


def parse_hex(c: Column) -> Column:
    """struct<r, g, b int> of #rgb or #rrggbb, the sign optional; null for anything else."""
    clean = F.regexp_replace(trimmed(c), "^#", "")
    full = F.when(F.length(clean) == 3, F.regexp_replace(clean, "(.)", "$1$1")).otherwise(clean)
    ok = full.rlike("^[0-9a-fA-F]{6}$")
    part = lambda k: F.conv(F.when(ok, F.substring(full, k, 2)), 16, 10).cast("int")
    return F.when(ok, F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))
