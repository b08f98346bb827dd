"""Authorised container sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FILL_SLACK_ML, LITRE_SLACK, STANDARDS_OF_FILL, WINE_LITRES_FROM_ML, WINE_SCOPE_ML


def half_up(c: Column) -> Column:
    """Rounded to a whole number, halves towards plus infinity."""
    return F.floor(c + 0.5).cast("double")


def check_fill(beverage: Column, ml: Column) -> Column:
    """struct<authorised, not_applicable, matched, nearest>: whether a size is authorised, or the sizes on either side.

    Malt beverages have no list, wine of 18 litres and more is outside it, and from 4 litres wine may have any
    whole number of litres. An unknown volume counts as authorised.
    """
    lists = F.create_map(*[x for k, v in STANDARDS_OF_FILL.items() for x in (F.lit(k), F.array(*[F.lit(float(s)) for s in v]))])
    sizes = F.try_element_at(lists, beverage)
    litres = ml / 1000
    even = F.abs(litres - half_up(litres)) < LITRE_SLACK
    outside = sizes.isNull() | ((beverage == "wine") & F.coalesce(ml >= WINE_SCOPE_ML, F.lit(False)))
    large = (beverage == "wine") & (ml >= WINE_LITRES_FROM_ML)
    hit = F.get(F.filter(sizes, lambda z: F.abs(z - ml) <= FILL_SLACK_ML), 0)
    bracket = F.array_compact(F.array(F.array_max(F.filter(sizes, lambda z: z < ml)), F.array_min(F.filter(sizes, lambda z: z > ml))))

    def result(authorised, not_applicable: bool, matched, nearest) -> Column:
        return F.struct(
            F.lit(authorised).alias("authorised") if isinstance(authorised, bool) else authorised.alias("authorised"),
            F.lit(not_applicable).alias("not_applicable"),
            (F.lit(None) if matched is None else matched).cast("double").alias("matched"),
            (F.lit(None) if nearest is None else nearest).cast("array<double>").alias("nearest"),
        )

    return (
        F.when(outside, result(True, True, None, None))
        .when(ml.isNull(), result(True, False, None, None))
        .when(large & even, result(True, False, ml, None))
        .when(large, result(False, False, None, F.array(F.floor(litres) * 1000.0, F.ceil(litres) * 1000.0)))
        .when(hit.isNotNull(), result(True, False, hit, None))
        .otherwise(result(False, False, None, bracket))
    )
