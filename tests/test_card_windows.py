"""Card features against a plain simulation, by both routes, with ties and idle gaps."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyguard.operators import skew
from tallyguard.operators.card_windows import FEATURES, card_features
from tallyguard.operators.snapshots import strict_week

HOUR, DAY, WEEK = 3_600_000, 86_400_000, 604_800_000
T0 = 1_700_000_000_000
SCHEMA = "tx_id long, card_id string, ts_ms long, amount double, merchant_id string, country string, device string"


def simulate(rows):
    out = {}
    for card in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == card), key=lambda r: (r[2], r[0]))
        last = None
        for tx, _, ts, amount, merchant, country, device in mine:
            idle = None if last is None else ts - last[0]
            if idle is None or idle >= WEEK:
                units, count, prev_country, prev_device, since = 0, 0, "", "", -1
            else:
                prev_country, prev_device, since = last[1], last[2], idle
            if idle is None or idle >= DAY:
                merchants = set()
            units, count = units + round(amount * 10_000), count + 1
            merchants.add(merchant)
            seen = {(r[2], r[4]) for r in mine if r[2] <= ts}
            c1, c6, c24 = (sum(t >= ts - back for t, _ in seen) for back in (HOUR, 6 * HOUR, DAY - 1))
            changed = prev_country != "" and prev_country != (country or "")
            velocity = 0.5 * min(c1 / 10.0, 1.0) + 0.3 * min(c6 / 20.0, 1.0) + 0.2 * float(changed)
            out[tx] = (c1, c6, c24, units / (10_000.0 * count), len(merchants), changed, since, prev_device or None, velocity)
            last = (ts, country or "", device or "")
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["tx_id"]: tuple(r[f] for f in FEATURES) for r in card_features(frame, **options).collect()}
    assert got == simulate(rows)


gap = st.sampled_from([0, 1, 1000, HOUR - 1, HOUR, HOUR + 1, 6 * HOUR, DAY - 1, DAY, DAY + 1, WEEK - 1, WEEK, WEEK + 1])
step = st.tuples(
    st.sampled_from(["a", "b", None]),
    gap,
    st.integers(1, 5_000_000),
    st.sampled_from(["m1", "m2", None]),
    st.sampled_from(["US", "GB", "", None]),
    st.sampled_from(["d1", "d2", "", None]),
)


def build(steps):
    now, rows = {"a": T0, "b": T0, None: T0}, []
    for tx, (card, wait, units, merchant, country, device) in enumerate(steps):
        now[card] += wait
        rows.append((tx, card, now[card], units / 10_000, merchant, country, device))
    return rows


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(step, min_size=1, max_size=60))
def test_plain_route_equals_simulation(spark, steps):
    check(spark, build(steps), max_rows_per_card=None)


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(step, min_size=20, max_size=60))
def test_sliced_route_equals_simulation(spark, steps):
    check(spark, build(steps), max_rows_per_card=5)


def test_frame_edges(spark):
    for back, counts in {
        HOUR: (2, 2, 2), HOUR + 1: (1, 2, 2), 6 * HOUR: (1, 2, 2), 6 * HOUR + 1: (1, 1, 2), DAY - 1: (1, 1, 2), DAY: (1, 1, 1)
    }.items():
        rows = [(1, "a", T0, 1.0, "m", "US", None), (2, "a", T0 + back, 1.0, "m", "US", None)]
        found = card_features(spark.createDataFrame(rows, SCHEMA), None).filter("tx_id = 2").head()
        assert (found.tx_count_1h, found.tx_count_6h, found.tx_count_24h) == counts


def test_strict_week_routes_agree(spark):
    rows = build([("a", (i * 7_919_003) % (9 * HOUR), i * 37 % 5000 + 1, "m1", "US", None) for i in range(300)])
    frame = spark.createDataFrame(rows, SCHEMA)
    columns = ["tx_id", "tx_count_7d", "avg_amount_strict_7d", "max_amount_7d"]
    plain = sorted(map(tuple, strict_week(frame, None).select(columns).collect()))
    assert plain == sorted(map(tuple, strict_week(frame, 10).select(columns).collect()))
    by_hand = [
        (tx, len(w), sum(round(x * 10_000) for x in w) / (10_000.0 * len(w)), max(w))
        for tx, _, ts, *_ in rows
        for w in [[r[3] for r in rows if ts - WEEK <= r[2] <= ts]]
    ]
    assert plain == sorted(by_hand)


def test_one_instant_is_cut_too(spark):
    """All rows of a card at one millisecond, or of the NULL card: slices are made by row count."""
    for card in ("a", None):
        rows = [(tx, card, T0, tx / 10_000, f"m{tx % 7}" if tx % 3 else None, "US", "d") for tx in range(80)]
        check(spark, rows, max_rows_per_card=10)
        sliced = skew.with_slice(spark.createDataFrame(rows, SCHEMA), ["card_id"], ["ts_ms", "tx_id"], parts=8)
        assert sliced.groupBy("_slice").count().agg({"count": "max"}).first()[0] < 40


def test_one_exchange_and_two_sorts(spark):
    rows = build([("a", 1000, 100, "m1", "US", None)] * 3)
    frame = spark.createDataFrame(rows, SCHEMA)
    plan = card_features(frame, None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 2


def test_strict_week_by_brute_force(spark):
    """Ties, exact weeks, gaps of many blocks, missing amounts; the plan has running frames only."""
    draw = random.Random(5)
    week = 7 * 86_400_000
    rows = []
    for card in range(6):
        t = draw.randrange(3 * week)
        for _ in range(60):
            t += draw.choice([0, 1, week, week + 1, draw.randrange(week // 4), draw.randrange(3 * week)])
            rows.append((card, len(rows), t, draw.choice([None, *map(float, range(9))])))
    frame = spark.createDataFrame(rows, "card_id long, tx_id long, ts_ms long, amount double")
    found = strict_week(frame, None)
    for row in found.collect():
        inside = [a for c, _, t, a in rows if c == row.card_id and row.ts_ms - week <= t <= row.ts_ms]
        assert row.tx_count_7d == len(inside)
        assert row.max_amount_7d == max((a for a in inside if a is not None), default=None)
    plan = strict_week(frame, None)._jdf.queryExecution().executedPlan().toString()
    assert "-604800000, currentrow" not in plan and plan.count("Exchange hashpartitioning") == 1
