"""The query of the look-ahead probe (M18), with a feature that does look ahead planted beside those that don't."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import features as P
from tidepanel.operators import leakage as L
from tidepanel.plans.adapter import calendar, panel, with_ctes
from tidepanel.plans.core import query

_OWN = {"foreign_share_20d": ("foreign_net", 20), "trust_share_5d": ("trust_net", 5)}


@query(
    "m18_look_ahead",
    with_ctes(("panel", "cal"), "SELECT 'next_close' AS feature, count(*) AS rows FROM (SELECT idx, lead(close) OVER (PARTITION BY stock_id ORDER BY idx) AS n FROM panel) WHERE idx = (SELECT max(idx) // 2 FROM cal) AND n IS NOT NULL "
    + " ".join(f"UNION ALL SELECT '{n}', 0" for n in (*_OWN, "agreement_5d"))),
)
def m18(spark, d):
    """Rows up to the middle day whose features change when every later flow and price does."""
    cut = int(calendar(spark, d).agg(F.floor(F.max("idx") / 2)).first()[0])

    def make(p):
        return p.withColumns({n: P.flow_share(c, w) for n, (c, w) in _OWN.items()} | {"agreement_5d": P.agreement(5), "next_close": F.lead("close", 1).over(P.by_date())})

    return L.look_ahead(panel(spark, d), make, [*_OWN, "agreement_5d", "next_close"], cut, ["foreign_net", "trust_net", "dealer_net", "total_net", "close"])
