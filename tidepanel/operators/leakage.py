"""Whether features look ahead: by their names, and by changing what comes after a day."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of names that tell of outcomes or of flows that models must not see.
FORBIDDEN = ("label", "return", "target", "forward", "future", "status", "hedging")
LONGEST = 20


def name_issues(names: list[str], expected: int | None = None) -> list[str]:
    """What is wrong with feature names: forbidden parts, repeats, windows over LONGEST days, another number than expected."""
    said = [f"{n} holds {part}" for n in names for part in FORBIDDEN if part in n]
    said += [f"{n} is repeated" for n in sorted({n for n in names if names.count(n) > 1})]
    said += [f"{n} looks back {days} days" for n in names for days in map(int, re.findall(r"(\d+)d\b", n)) if days > LONGEST]
    if expected is not None and len(names) != expected:
        said.append(f"{len(names)} features, not {expected}")
    return said


def look_ahead(panel: DataFrame, make: Callable[[DataFrame], DataFrame], names: list[str], cut: int, changed: list[str]) -> DataFrame:
    """(feature, rows): how many rows up to day ``cut`` get another value when ``changed`` columns differ on all days after it.

    ``make`` gives a panel (stock_id, idx, ...) its features. A feature that only looks back has no such row.
    """
    later = F.col("idx") > cut
    moved = panel.withColumns({c: F.when(later, -2 * F.col(c) - 1).otherwise(F.col(c)) for c in changed})
    keys = ["stock_id", "idx"]
    before = make(panel).where(F.col("idx") <= cut).select(*keys, *names)
    after = make(moved).where(F.col("idx") <= cut).select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    both = before.join(after, keys)
    counts = both.agg(*[F.count_if(~F.col(n).eqNullSafe(F.col(f"_{n}"))).alias(n) for n in names])
    return counts.unpivot([], names, "feature", "rows")
