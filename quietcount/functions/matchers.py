"""String matchers of goals and funnel steps, and the kind test beside them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietcount.schema import PAGEVIEW


@dataclass(frozen=True)
class Matcher:
    """kind: pageview (on path) or event (on event_name); match_type: exact, prefix or wildcard."""

    kind: str
    match_type: str
    value: str
    mode: str = "segments"

    def pattern(self) -> str:
        """A wildcard as a regex: * stays within a path segment, ** goes across (mode like: both go across)."""
        parts = re.split(r"(\*\*|\*)", self.value)
        across = self.mode == "like"
        return "^" + "".join(".*" if p == "**" or (p == "*" and across) else "[^/]*" if p == "*" else re.escape(p) for p in parts) + "$"

    def matches(self, text: str | None) -> bool:
        """The same test on one string, for pruning goals."""
        if text is None:
            return False
        if self.match_type == "wildcard":
            return re.fullmatch(self.pattern().strip("^$"), text) is not None
        return text == self.value if self.match_type == "exact" else text.startswith(self.value)

    def column(self) -> Column:
        at = F.col("path" if self.kind == "pageview" else "event_name")
        kind = F.col("event_name") == PAGEVIEW if self.kind == "pageview" else F.col("event_name") != PAGEVIEW
        if self.match_type == "exact":
            test = at == self.value
        elif self.match_type == "prefix":
            test = at.startswith(self.value)
        else:
            test = at.rlike(self.pattern())
        return F.coalesce(kind & test, F.lit(False))


def any_of(matchers: list[Matcher]) -> Column:
    return reduce(lambda a, b: a | b, [m.column() for m in matchers])
