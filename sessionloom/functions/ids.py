"""Deterministic ids and typed references as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKEN = "~"


def utc_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def natural_key(*parts: Column) -> Column:
    """Ordered key text; a missing part keeps its place as the null token."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(NULL_TOKEN)) for p in parts])


def natural_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(natural_key(*parts), 256))


def source_ref(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), key)


def parse_ref(ref: Column) -> tuple[Column, Column]:
    """Kind and key of ``KIND:key``; the key may itself hold colons."""
    return F.regexp_extract(ref, r"^([A-Z_]+):", 1), F.regexp_extract(ref, r"^[A-Z_]+:(.+)$", 1)


def ref_list(refs: Column) -> Column:
    """Canonical reference list: sorted, no repeats, no nulls."""
    return F.array_sort(F.array_distinct(F.filter(refs, lambda x: x.isNotNull())))


def bar_ref(instrument: Column, contract: Column, first_end: Column, last_end: Column | None = None) -> Column:
    last_end = first_end if last_end is None else last_end
    return source_ref("BAR", F.concat_ws("|", instrument, contract, utc_text(first_end), utc_text(last_end)))
