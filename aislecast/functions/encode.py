"""Lookups, decoding and numeric transforms as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import (
    ASSORTMENT_NAMES,
    ASSORTMENT_OTHERWISE,
    ASSORTMENT_RANK,
    HOLIDAY_NAMES,
    HOLIDAY_OTHERWISE,
    MONTH_NAMES,
)


def _sql_literal(value: str | int | float) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(value)


def lookup(key: Column, table: Mapping) -> Column:
    """Value of ``key`` in a literal map; an unknown key gives NULL."""
    if not table:
        return F.lit(None)
    items = ", ".join(_sql_literal(item) for pair in table.items() for item in pair)
    return F.try_element_at(F.expr(f"map({items})"), key)


def decode(key: Column, names: Mapping[str, str], otherwise: str) -> Column:
    """Name of ``key``; every other value, NULL included, is ``otherwise``."""
    return F.coalesce(lookup(key, names), F.lit(otherwise))


def assortment_name(code: Column) -> Column:
    return decode(code, ASSORTMENT_NAMES, ASSORTMENT_OTHERWISE)


def holiday_name(code: Column) -> Column:
    return decode(code, HOLIDAY_NAMES, HOLIDAY_OTHERWISE)


def assortment_rank(name: Column) -> Column:
    return lookup(name, ASSORTMENT_RANK)


def month_abbreviation(date: Column, names: Mapping[int, str] = MONTH_NAMES) -> Column:
    return lookup(F.month(date), names)


def listed(item: Column, comma_list: Column) -> Column:
    """1 if ``item`` is a whole entry of the comma list, else 0 (also for no list)."""
    found = F.array_contains(F.split(comma_list, ","), item)
    return F.coalesce(found, F.lit(False)).cast("int")


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle of ``period`` steps."""
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def money(value: Column) -> Column:
    return F.concat(F.lit("R$"), F.format_number(value, 2))
