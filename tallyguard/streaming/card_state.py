"""Per-card features on a stream: keyed state updated once per card and micro-batch.

Rows of a micro-batch are taken in ``(ts_ms, tx_id)`` order. A row older than the card's newest
one (but not behind the watermark) is counted at its own time and added to the sums; it does not
replace the last country, device and time, and features already emitted stay as they are.

Recent transactions are kept by hour. Counting looks into the hours at the frame edges only and
takes the hours between by their size, so an update of a busy card rewrites the current hour, not
the day. Every access to the state is a call out of the worker, so hours stay with the card's other
figures as long as they are small; of a busy card all but the newest few go to a map of hours.

A stream may start from a table: ``card_states`` folds the transactions before a cut into the state
the processor would hold then, and the first micro-batch takes it over.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from operator import itemgetter
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyguard.operators.card_windows import COUNT_FRAMES, DAY_MS, FEATURES, HOUR_MS, WEEK_MS
from tallyguard.operators.card_windows import _units as units_of
from tallyguard.operators.skew import null_safe_join
from tallyguard.session import STATE_STORE

_FEATURE_TYPES = {
    "tx_count_1h": T.LongType(),
    "tx_count_6h": T.LongType(),
    "tx_count_24h": T.LongType(),
    "avg_amount_7d": T.DoubleType(),
    "distinct_merchants_24h": T.LongType(),
    "country_changed": T.BooleanType(),
    "time_since_last_tx_ms": T.LongType(),
    "device_hash": T.StringType(),
    "velocity_score": T.DoubleType(),
}
_CARD = (
    "last_ms bigint, last_country string, last_device string, units bigint, rows bigint, "
    "merchants array<string>, spilled bigint, hours array<bigint>, sizes array<bigint>, "
    "near_ts array<bigint>, near_merchants array<string>, timer_ms bigint"
)
_HEAD = ["last_ms", "last_country", "last_device", "units", "rows", "merchants", "spilled", "hours", "sizes"]
_INPUTS = ["ts_ms", "tx_id", "merchant_id", "amount", "country", "device"]
# Merchants held next to the sums; further ones go to a map of their own.
_MERCHANTS_INLINE = 1_000
# (time, merchant) pairs of whole hours held next to the sums; beyond them the oldest of these hours
# go to the map.
_PAIRS_INLINE = 500


class _Recent:
    """Distinct (time, merchant) pairs of the last day, by hour, read on demand."""

    def __init__(self, state: Any, sizes: dict[int, int], near: Iterable[tuple[int, str]] = ()):
        self.state, self.sizes = state, sizes
        self.read: dict[int, list[tuple[int, str]]] = {}
        for pair in near:
            self.read.setdefault(pair[0] // HOUR_MS, []).append(pair)
        #: Hours that are not in the map.
        self.near = set(self.read)
        self.touched: set[int] = set()

    def hour(self, hour: int) -> list[tuple[int, str]]:
        if hour not in self.read:
            found = self.state.getValue((hour,)) if hour in self.sizes else None
            self.read[hour] = list(zip(*found)) if found else []
        return self.read[hour]

    def add(self, ts: int, merchant: str) -> None:
        hour, pair = ts // HOUR_MS, (ts, merchant)
        if hour not in self.sizes:
            self.near.add(hour)
        pairs = self.hour(hour)
        at = len(pairs) if not pairs or pairs[-1] < pair else bisect_left(pairs, pair)
        if at == len(pairs) or pairs[at] != pair:
            pairs.insert(at, pair)
            self.sizes[hour] = len(pairs)
            self.touched.add(hour)

    def reached(self, times: np.ndarray, side: str) -> np.ndarray:
        """Number of pairs before each of the ascending times (``left``) or up to it (``right``)."""
        low, high = int(times[0]) // HOUR_MS, int(times[-1]) // HOUR_MS
        earlier = sum(size for hour, size in self.sizes.items() if hour < low)
        between = sorted(hour for hour in self.sizes if low <= hour <= high)
        found = np.fromiter((ts for hour in between for ts, _ in self.hour(hour)), dtype="int64")
        return earlier + np.searchsorted(found, times, side)

    def counts(self, times: list[int]) -> list[tuple[int, ...]]:
        """The sliding counts at each of the ascending times."""
        at = np.array(times, dtype="int64")
        upto = self.reached(at, "right")
        return list(zip(*[(upto - self.reached(at - oldest, "left")).tolist() for oldest in COUNT_FRAMES.values()]))

    def save(self, oldest_ms: int) -> tuple[list[int], list[str]]:
        """Writes the map; the pairs that stay out of it, in order."""
        for hour in [h for h in self.sizes if (h + 1) * HOUR_MS <= oldest_ms]:
            del self.sizes[hour]
            self.touched.discard(hour)
            if hour in self.near:
                self.near.discard(hour)
            else:
                self.state.removeKey((hour,))
        held = sorted(self.near)
        total = sum(self.sizes[hour] for hour in held)
        for hour in held:
            if total <= _PAIRS_INLINE:
                break
            total -= self.sizes[hour]
            self.near.discard(hour)
            self.touched.add(hour)
        for hour in self.touched - self.near:
            pairs = self.read[hour]
            self.state.updateValue((hour,), ([ts for ts, _ in pairs], [m for _, m in pairs]))
        near = [pair for hour in sorted(self.near) for pair in self.read[hour]]
        return [ts for ts, _ in near], [m for _, m in near]


class CardFeatureProcessor(StatefulProcessor):
    def __init__(self, kept: Sequence[str] = ()):
        self.kept = list(kept)
        self.result = Row(*self.kept, *FEATURES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", _CARD)
        self.recent = handle.getMapState("recent", "hour bigint", "ts array<bigint>, merchant array<string>")
        self.merchants = handle.getMapState("merchants", "merchant string", "seen boolean")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        """One row of ``card_states``: the card's own figures, an hour, or a merchant of the overflow map."""
        if initialState["part"] == "head":
            last_ms, country, device, *sums = [initialState["head"][name] for name in _HEAD]
            units, count, merchants, spilled, hours, sizes = sums
            timer = last_ms + WEEK_MS
            self.handle.registerTimer(timer)
            self.card.update((last_ms, country, device, units, count, list(merchants), spilled, list(hours), list(sizes), [], [], timer))
        elif initialState["part"] == "hour":
            self.recent.updateValue((initialState["hour"],), (list(initialState["ts"]), list(initialState["merchants"])))
        else:
            self.merchants.updateValue((initialState["merchant"],), (True,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        named = list(rows)
        place = {name: at for at, name in enumerate(named[0].__fields__)}
        # Plain tuples: reading a Row by name costs a search per access.
        wanted = itemgetter(*[place[name] for name in _INPUTS])
        passed = itemgetter(*[place[name] for name in self.kept])
        batch = sorted(((wanted(plain), passed(plain)) for plain in map(tuple, named)), key=lambda pair: pair[0][:2])
        known = self.card.get()
        if known is None:
            last_ms, country, device, units, count, timer = None, "", "", 0, 0, None
            merchants, spilled, sizes, near = set(), 0, {}, ()
        else:
            last_ms, country, device, units, count, held, spilled, hours, hour_sizes, near_ts, near_merchants, timer = known
            merchants, sizes, near = set(held), dict(zip(hours, hour_sizes)), zip(near_ts, near_merchants)
        recent = _Recent(self.recent, sizes, near)
        for (ts, _, seller, *_), _ in batch:
            recent.add(ts, str(seller))
        out = []
        for (values, kept), counts in zip(batch, recent.counts([values[0] for values, _ in batch])):
            ts, _, seller, amount, here, gadget = values
            seller, here = str(seller), here or ""
            idle = None if last_ms is None else ts - last_ms
            fresh = idle is None or idle >= WEEK_MS
            if fresh:
                units, count = 0, 0
            if idle is None or idle >= DAY_MS:
                merchants, spilled = set(), self._forget(spilled)
            if seller not in merchants:
                spilled += self._remember(merchants, seller, spilled)
            units += _units(amount)
            count += 1
            changed = not fresh and country != "" and country != here
            out.append(
                self.result(
                    *kept,
                    *counts,
                    units / (10000.0 * count),
                    len(merchants) + spilled,
                    changed,
                    -1 if fresh else idle,
                    None if fresh or device == "" else device,
                    0.5 * min(counts[0] / 10.0, 1.0) + 0.3 * min(counts[1] / 20.0, 1.0) + 0.2 * float(changed),
                )
            )
            if idle is None or idle >= 0:
                last_ms, country, device = ts, here, gadget or ""
        # Rows behind this watermark are dropped from now on: nothing older can be asked for.
        near = recent.save(timerValues.getCurrentWatermarkInMs() - DAY_MS)
        if timer is None:
            timer = last_ms + WEEK_MS
            self.handle.registerTimer(timer)
        self.card.update(
            (last_ms, country, device, units, count, sorted(merchants), spilled, list(sizes), list(sizes.values()), *near, timer)
        )
        return iter(out)

    def _remember(self, merchants: set[str], seller: str, spilled: int) -> int:
        """Note a merchant; 1 when it went to the overflow map as a new one."""
        if len(merchants) < _MERCHANTS_INLINE:
            merchants.add(seller)
            return 0
        if spilled and self.merchants.containsKey((seller,)):
            return 0
        self.merchants.updateValue((seller,), (True,))
        return 1

    def _forget(self, spilled: int) -> int:
        if spilled:
            self.merchants.clear()
        return 0

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """Free the state of a card that was idle for a week; else look again later."""
        known = self.card.get()
        if known is not None:
            due = known[0] + WEEK_MS
            if due <= expiredTimerInfo.getExpiryTimeInMs():
                self.card.clear()
                self.recent.clear()
                self.merchants.clear()
            else:
                self.handle.registerTimer(due)
                self.card.update((*known[:-1], due))
        return iter([])

    def close(self) -> None:
        pass


def _units(amount: Any) -> int:
    scaled = float(amount) * 10000.0
    whole = int(abs(scaled) + 0.5)
    return whole if scaled >= 0 else -whole


def card_states(transactions: DataFrame, as_of_ms: int) -> DataFrame:
    """The processor's state after all rows before ``as_of_ms``, as rows for its start: one ``head``
    for each card seen in the last week, one row for each card and hour of the last day, one for each
    merchant beyond those held inline. Rows come once per transaction (see ``drop_redelivered``).

    Idle gaps of a day or more lie between the days of a card, never inside one, so sums by card and
    UTC day are enough to find the resets: they combine on the map side, and no card's rows meet in
    one task. Cards idle for a week start afresh with their next row and have no state.
    """
    past = transactions.filter(F.col("ts_ms") < as_of_ms).select(
        "card_id",
        "tx_id",
        "ts_ms",
        F.col("merchant_id").cast("string").alias("merchant"),
        units_of(F.col("amount")).alias("units"),
        F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce("device", F.lit("")).alias("device"),
    )
    day = F.expr(f"ts_ms div {DAY_MS}L").alias("day")
    days = past.groupBy("card_id", day).agg(
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.sum("units").alias("units"),
        F.count(F.lit(1)).alias("rows"),
        F.max(F.struct("ts_ms", "tx_id", "country", "device")).alias("newest"),
    )
    idle = F.col("first_ms") - F.lag("last_ms").over(Window.partitionBy("card_id").orderBy("day"))
    gaps = days.withColumn("idle", idle)

    def start(limit_ms: int):
        return F.max(F.when(F.coalesce(F.col("idle") >= limit_ms, F.lit(True)), F.col("first_ms"))).over(Window.partitionBy("card_id"))

    runs = gaps.withColumns({"week_from": start(WEEK_MS), "day_from": start(DAY_MS)})
    in_week = F.col("first_ms") >= F.col("week_from")
    heads = (
        runs.groupBy("card_id")
        .agg(
            F.max("newest").alias("newest"),
            F.sum(F.when(in_week, F.col("units"))).alias("units"),
            F.sum(F.when(in_week, F.col("rows"))).alias("rows"),
            F.max("day_from").alias("day_from"),
        )
        .filter(as_of_ms - F.col("newest.ts_ms") < WEEK_MS)
    )
    alive = heads.select(F.col("card_id").alias("card"), "day_from")
    sellers = past.groupBy("card_id", "merchant").agg(F.max("ts_ms").alias("seen_ms"))
    held = sellers.join(alive, F.col("card_id").eqNullSafe(F.col("card"))).filter(F.col("seen_ms") >= F.col("day_from")).select("card_id", "merchant")
    ranked = held.withColumn("nth", F.row_number().over(Window.partitionBy("card_id").orderBy("merchant")))
    inline = ranked.groupBy("card_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("nth") <= _MERCHANTS_INLINE, F.col("merchant")))).alias("merchants"),
        F.count_if(F.col("nth") > _MERCHANTS_INLINE).alias("spilled"),
    )
    hour = F.expr(f"ts_ms div {HOUR_MS}L").alias("hour")
    pairs = past.filter(F.col("ts_ms") >= as_of_ms - DAY_MS).select("card_id", hour, "ts_ms", "merchant").distinct()
    hours = (
        pairs.groupBy("card_id", "hour")
        .agg(F.sort_array(F.collect_list(F.struct("ts_ms", "merchant"))).alias("pairs"))
        .select("card_id", "hour", F.col("pairs.ts_ms").alias("ts"), F.col("pairs.merchant").alias("merchants"))
    )
    sizes = pairs.groupBy("card_id", "hour").agg(F.count(F.lit(1)).alias("n")).groupBy("card_id").agg(
        F.sort_array(F.collect_list(F.struct("hour", "n"))).alias("sizes")
    )
    full = null_safe_join(null_safe_join(heads, inline, ["card_id"], "left"), sizes, ["card_id"], "left")
    none = F.array().cast("array<bigint>")
    head = F.struct(
        F.col("newest.ts_ms").alias("last_ms"),
        F.col("newest.country").alias("last_country"),
        F.col("newest.device").alias("last_device"),
        "units",
        "rows",
        F.coalesce("merchants", F.array().cast("array<string>")).alias("merchants"),
        F.coalesce("spilled", F.lit(0).cast("bigint")).alias("spilled"),
        F.coalesce("sizes.hour", none).alias("hours"),
        F.coalesce("sizes.n", none).alias("sizes"),
    )
    beyond = ranked.filter(F.col("nth") > _MERCHANTS_INLINE)
    # No column of whole numbers is ever null: it would come as a fraction.
    parts = full.select("card_id", F.lit("head").alias("part"), head.alias("head"), F.lit(0).cast("bigint").alias("hour"))
    parts = parts.unionByName(hours.withColumn("part", F.lit("hour")), allowMissingColumns=True)
    parts = parts.unionByName(
        beyond.select("card_id", F.lit("merchant").alias("part"), F.lit(0).cast("bigint").alias("hour"), "merchant"), allowMissingColumns=True
    )
    return parts


def stream_card_features(transactions: DataFrame, event_time: str = "event_time", states: DataFrame | None = None) -> DataFrame:
    """Features of a watermarked stream of transactions (see ``sources.with_event_time``), from the
    start or from ``card_states`` of the transactions before it."""
    spark = transactions.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kept = [f for f in transactions.schema.fields if f.name != event_time]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept])
    for name in FEATURES:
        schema = schema.add(name, _FEATURE_TYPES[name])
    return transactions.groupBy("card_id").transformWithState(
        statefulProcessor=CardFeatureProcessor([f.name for f in kept]),
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if states is None else states.groupBy("card_id"),
    )
