"""Identifiers: the bare form of an id that may carry a namespace, blanks or lower case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_id(col: Column | str) -> Column:
    """What follows the last ':' or '/', without blanks, in upper case; null for null and for nothing left."""
    c = F.col(col) if isinstance(col, str) else col
    tail = F.regexp_replace(F.regexp_replace(c, r"(?s)^.*[:/]", ""), r"(?U)\s+", "")
    return F.nullif(F.upper(tail), F.lit(""))


def bare_text(value: str | None) -> str | None:
    """bare_id for one Python string."""
    if value is None:
        return None
    return re.sub(r"\s+", "", re.sub(r"(?s)^.*[:/]", "", value)).upper() or None
