"""Allow-listed report filters as predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietcount.schema import PAGEVIEW

#: Filter dimension and its column.
DIMENSIONS = {
    "page": "path", "entry_page": "path", "source": "referrer_source", "referrer": "referrer_host", "country": "country_code",
    "browser": "browser", "os": "os", "device": "device_type", "screen": "screen_class", "utm_source": "utm_source",
    "utm_medium": "utm_medium", "utm_campaign": "utm_campaign", "utm_term": "utm_term", "utm_content": "utm_content",
    "event": "event_name", "hostname": "hostname",
}
MAX_PROPERTIES, MAX_KEY, MAX_VALUE = 10, 60, 500


def cleaned(filters: dict | None) -> dict[str, str]:
    """What is allowed of filters: known dimensions and up to MAX_PROPERTIES `props:key` ones, scalar values."""
    out: dict[str, str] = {}
    props = 0
    for key, value in (filters or {}).items():
        if isinstance(value, (dict, list, tuple, set)) or value in (None, ""):
            continue
        if key in DIMENSIONS:
            out[key] = str(value)
        elif key.startswith("props:") and 0 < len(key) - 6 <= MAX_KEY and props < MAX_PROPERTIES:
            out[key], props = str(value)[:MAX_VALUE], props + 1
    return out


def predicate(filters: dict | None) -> Column:
    tests = []
    for key, value in cleaned(filters).items():
        if key.startswith("props:"):
            tests.append(F.col("props")[key[6:]] == value)
        else:
            tests.append(F.col(DIMENSIONS[key]) == value)
            if key == "entry_page":
                tests.append(F.col("is_entry"))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def volume(filters: dict | None) -> Column:
    """Pageviews, or all matching rows under an event filter."""
    return F.count(F.lit(1)) if "event" in cleaned(filters) else F.count_if(F.col("event_name") == PAGEVIEW)


def qualified(scope: DataFrame, filters: dict | None) -> DataFrame:
    """Every event of scope in sessions that own at least one matching event."""
    if not cleaned(filters):
        return scope
    keys = ["site_id", "session_hash"] + [c for c in ("window",) if c in scope.columns]
    return scope.join(scope.where(predicate(filters)).select(*keys).distinct(), keys, "left_semi")
