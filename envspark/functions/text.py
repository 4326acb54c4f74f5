"""Names: trimming, canonical forms and prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..defaults import CANONICAL_NAMES


def canonical(name: str) -> str:
    """Known sensor headings keep their short name; others become snake_case."""
    name = name.strip()
    return CANONICAL_NAMES.get(name) or re.sub(r"\s+", "_", name.lower())


def weather_name(name: str) -> str:
    """Weather columns other than the day and the rain amount get ``rain_``."""
    name = canonical(name)
    if name in ("date", "rainfall") or name.startswith("rain_"):
        return name
    return f"rain_{name}"


def component_name(column: Column) -> Column:
    """Name of the index component behind a contribution column."""
    return F.regexp_replace(column, "_contrib$", "")
