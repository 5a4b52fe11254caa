"""Content fingerprints and text repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 hex digest of the UTF-8 bytes of ``text`` (equals DuckDB ``sha256``)."""
    return F.sha2(text, 256)


def repair_utf8(raw: Column) -> Column:
    """Decode bytes as UTF-8, replacing invalid sequences with U+FFFD."""
    return F.make_valid_utf8(raw.cast("binary"))
