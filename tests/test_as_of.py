"""The as-of join of all ticks, against a plain loop."""

from __future__ import annotations

from bisect import bisect_right

from tickloom.plans import registry
from tickloom.plans.base import bars
from tickloom.sources import market
from tickloom.sources.market import table as load

SF = "/root/testdata/sf0.001"


def test_every_tick_is_joined(spark):
    known = {}
    for x in bars(spark, SF).select("symbol", "ts", "close", "volume").orderBy("ts").collect():
        known.setdefault(x.symbol, []).append((x.ts, x.close, x.volume))
    want = {}
    for x in market.ticks(load(spark, SF, "events")).collect():
        mine = known.get(x.symbol, [])
        at = bisect_right([b[0] for b in mine], x.ts)
        want[x.event_id] = mine[at - 1][1:] if at else (None, None)
    got = registry.queries()["join_as_of_all"](spark, SF).collect()
    assert len(got) == len(want) == 1000
    for x in got:
        for found, right in zip((x.close, x.volume), want[x.event_id], strict=True):
            assert (found is None) == (right is None) and (found is None or abs(found - right) < 1e-3)
