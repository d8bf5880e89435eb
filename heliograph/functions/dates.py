"""Times as evidence: instants only where the text names a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:[Zz]|[+-]\d{2}:?\d{2}(?::?\d{2})?)$"


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 of an ISO time with a zone; null for anything else.

    Malformed text is null, never an error.  The text itself stays the sort
    key where the original offset matters.
    """
    return F.when(text.rlike(_ZONED), F.unix_micros(F.try_to_timestamp(text)))


def iso_utc(us: Column) -> Column:
    """ISO text in UTC of microseconds since 1970."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
