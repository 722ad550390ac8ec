"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from quietcount.plans import behaviour, history, intake, money, payments, stored, streams, traffic

MODULES = (traffic, behaviour, money, intake, payments, history, stored, streams)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
