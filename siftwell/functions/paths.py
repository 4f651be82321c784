"""Path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """One spelling of a relative path: ``/`` separators, without ``\\\\?\\``,
    leading ``./`` and outer slashes. Null stays null."""
    p = F.regexp_replace(path, r"^\\\\\?\\", "")
    p = F.regexp_replace(F.translate(p, "\\", "/"), r"/(?:\./)+", "/")
    p = F.regexp_replace(p, r"/{2,}", "/")
    return F.regexp_replace(p, r"^(?:\./|/)+|/+$", "")
