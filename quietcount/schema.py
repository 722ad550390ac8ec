"""Fixed schemas: the wide event table, beacons, and the small dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One row per event; hashes are hex strings at the edges of the library.
EVENTS = _struct(
    occurred_at=_TS, site_id=_L, event_name=_S, visitor_hash=_S, session_hash=_S, is_entry=_B, hostname=_S, path=_S,
    referrer_host=_S, referrer_source=_S, utm_source=_S, utm_medium=_S, utm_campaign=_S, utm_term=_S, utm_content=_S,
    country_code=_S, browser=_S, browser_version=_S, os=_S, os_version=_S, device_type=_S, screen_class=_S,
    revenue_cents=_L, currency=_S, props=T.MapType(_S, _S),
)
EVENT_COLUMNS = EVENTS.names

#: A beacon's JSON body.
BEACON = _struct(s=_S, u=_S, n=_S, r=_S, w=_S, p=T.MapType(_S, _S), c=_S, v=_S)

PAGEVIEW = "pageview"
