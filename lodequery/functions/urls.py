"""Hosts and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_host(url: Column) -> Column:
    """Host in lower case, without user, port and one leading ``www.``; null where the url has none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))
