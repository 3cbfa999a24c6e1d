"""Keyed state moves at once: state calls of a micro-batch do not grow with its rows."""

import pandas as pd

from attestra.streaming.stepup import Challenges
from attestra.streaming.velocity import PACK, TrailingCounts, packed, unpacked


class Rows:
    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = rows

    def clear(self):
        self.calls.append("clear")
        self.rows = []


class Handle:
    """What a processor asks of Spark, with every call written down."""

    def __init__(self):
        self.calls, self.timers = [], set()

    def getListState(self, name, schema):
        return Rows(self.calls)

    def registerTimer(self, ms):
        self.calls.append("timer")
        self.timers.add(ms)

    def listTimers(self):
        return iter(sorted(self.timers))


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_packed_entries_come_back():
    entries = [(i, f"m{i}", i % 3) for i in range(2 * PACK + 5)]
    assert len(packed(entries)) == 3 and list(unpacked(packed(entries))) == entries and packed([]) == []


def test_a_bucket_of_challenges_is_judged_in_one_call():
    p, h = Challenges("123456", 1000), Handle()
    p.init(h)
    n, big = 500, 2 ** 60
    opens = [(f"A{i}", f"o{i}", True, 0, False, None, 300 + i) for i in range(n)]
    asked = [(f"A{i}", f"o{i}", False, big + i, True, "123456" if i % 2 else "000000", 100 + k) for k in (1, 0) for i in range(0, n, 2)]
    asked += [("A1", "o2", False, 7, True, "123456", 50), ("A3", "o3", False, 8, True, "12", 50), ("A5", "o5", False, 2 ** 63 - 1, False, "123456", 305)]
    batch = pd.DataFrame(opens + asked, columns=["attempt_ref", "owner", "opens", "response_id", "named", "code", "sec"])
    out = pd.concat(p.handleInputRows((0,), iter([batch]), Clock(0)))
    assert h.calls == ["get", "put", "timer"]
    first = out[(out.response_id >= big) & (out.sec == 100)]
    later = out[(out.response_id >= big) & (out.sec == 101)]
    assert set(first.outcome) == {"FAILED"} and set(later.outcome) == {"RESOLVED"} and len(first) == len(later) == n // 2
    assert set(first.response_id) == {big + i for i in range(0, n, 2)}
    assert out.set_index("attempt_ref").loc[["A1", "A3", "A5"]].outcome.tolist() == ["NOT_FOUND", "MALFORMED", "EXPIRED"]
    assert out[out.attempt_ref == "A5"].response_id.isna().all()
    gone = pd.concat(p.handleExpiredTimer((0,), Clock(350_001), Clock(301_000)))
    assert set(gone.attempt_ref) == {f"A{i}" for i in range(1, 51, 2)} and set(gone.outcome) == {"LAPSED"}
    assert pd.concat(p.handleExpiredTimer((0,), Clock(350_001), Clock(302_000))).empty
    assert len(pd.concat(p.handleExpiredTimer((0,), Clock(10_000_000), Clock(351_000)))) == n // 2 - 25 and not p._held()


def test_trailing_counts_store_their_window_in_one_call():
    p, h = TrailingCounts(60), Handle()
    p.init(h)

    def deliver(lo, hi, watermark):
        d = pd.DataFrame([(i, pd.Timestamp(i, unit="s"), i, f"m{i % 7}", True) for i in range(lo, hi)],
                         columns=["record_id", "ts", "sec", "member", "counts"])
        return pd.concat(p.handleInputRows(("k",), iter([d]), Clock(watermark)))

    deliver(0, 1000, 0)
    assert h.calls == ["get", "put", "timer"] and h.timers == {(999 + 62) * 1000}
    out = deliver(1000, 1100, 900_000)
    assert out.rows_before.tolist() == [60] * 100 and out.members_before.tolist() == [7] * 100
    assert min(p._kept())[0] == 840 and len(p._kept()) == 260
    list(p.handleExpiredTimer(("k",), Clock(2_000_000), Clock(1_061_000)))
    assert not p._kept()
