"""Device fingerprints and behavioural traces."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.functions.text import fixed4
from tallyguard.operators import skew
from tallyguard.session import cut_lineage

# Limits of the collected traces.
MAX_INTERVAL_MS = 5_000
KEPT_INTERVALS = 100
WEB_LIMITS = {"mouse": 200, "keys": 100, "touch": 200}
MOBILE_LIMITS = {"acceleration": 100, "pressure": 50, "keys": 100}
MIN_SPACING_MS = 50


# --- columns ----------------------------------------------------------------------------------


def fingerprint(signals: Column) -> Column:
    """SHA-256 of the sorted ``key=value`` pairs."""
    pairs = F.transform(
        F.array_sort(F.map_entries(signals)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.sha2(F.array_join(pairs, "|"), 256)


def merge_signals(*maps: Column) -> Column:
    """One map of all; for a key in several, the last map wins. Independent of session settings."""

    def over(earlier: Column, later: Column) -> Column:
        kept = F.map_filter(earlier, lambda key, _: ~F.map_contains_key(later, key))
        return F.map_concat(kept, later)

    return reduce(over, maps)


def trace_counts(mouse: Column, keys: Column, touch: Column) -> Column:
    return F.create_map(
        F.lit("behavioral.mouseMovements"),
        F.size(mouse).cast("string"),
        F.lit("behavioral.keystrokeIntervals"),
        F.size(keys).cast("string"),
        F.lit("behavioral.touchEvents"),
        F.size(touch).cast("string"),
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values).cast("double")


def mean_acceleration(samples: Column) -> Column:
    """Mean length of the (x, y, z) samples as text, ``0`` without any."""
    length = lambda s: F.sqrt(s["x"] * s["x"] + s["y"] * s["y"] + s["z"] * s["z"])
    return F.when(F.size(samples) > 0, fixed4(_mean(F.transform(samples, length)))).otherwise("0")


def mean_pressure(pressures: Column) -> Column:
    return F.when(F.size(pressures) > 0, fixed4(_mean(pressures))).otherwise("0")


def mean_interval(intervals: Column) -> Column:
    mean = _mean(F.transform(intervals, lambda v: v.cast("double")))
    return F.when(F.size(intervals) > 0, F.round(mean).cast("long").cast("string")).otherwise("0")


def mobile_signals(samples: Column, pressures: Column, intervals: Column) -> Column:
    """A phone's traces as counts and means; no samples read 0."""
    traces = {
        "accelSampleCount": F.size(samples).cast("string"),
        "avgAccelMagnitude": mean_acceleration(samples),
        "touchPressureCount": F.size(pressures).cast("string"),
        "avgTouchPressure": mean_pressure(pressures),
        "keystrokeCount": F.size(intervals).cast("string"),
        "avgKeystrokeIntervalMs": mean_interval(intervals),
    }
    return F.create_map(*[c for name, value in traces.items() for c in (F.lit(f"behavioral.{name}"), value)])


def signal_defaults(fields: Mapping[str, Column]) -> Column:
    """Browser signals as a string map; an unset do-not-track reads ``unspecified``, an unset
    number 0."""
    zero = {"hardwareConcurrency", "maxTouchPoints"}
    pairs: list[Column] = []
    for name, value in fields.items():
        text = value.cast("string")
        if name == "doNotTrack":
            text = F.coalesce(text, F.lit("unspecified"))
        elif name in zero:
            text = F.coalesce(text, F.lit("0"))
        pairs += [F.lit(f"browser.{name}"), text]
    return F.create_map(*pairs)


def last_samples(samples: Column, limit: int) -> Column:
    """Newest ``limit`` entries of an array, order kept."""
    return F.slice(samples, F.greatest(F.size(samples) - limit, F.lit(0)) + 1, F.lit(limit))


# --- rows -------------------------------------------------------------------------------------


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Newest ``limit`` rows per key; the limit also applies before the exchange."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    ranked = df.withColumn("_rank", F.row_number().over(newest))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank")


def _with_previous(df: DataFrame, key: str, max_rows: int | None, values: Mapping[str, str]) -> DataFrame:
    """Add what each column of ``values`` (new name -> column) had in the key's previous row."""
    order = ["t", "seq"]

    def plain(rows: DataFrame) -> DataFrame:
        by_time = Window.partitionBy(key).orderBy(*order)
        return rows.withColumns({name: F.lag(source).over(by_time) for name, source in values.items()})

    def sliced(rows: DataFrame) -> DataFrame:
        rows = skew.sliced_previous(skew.with_slice(rows, [key], order), [key], order, values)
        return rows.drop("_slice").select(*df.columns, *values)

    return skew.by_heat(df, [key], plain, sliced, max_rows)


def keystroke_intervals(
    strokes: DataFrame, key: str = "session_id", limit: int = KEPT_INTERVALS, max_rows: int | None = skew.DEFAULT_MAX_ROWS
) -> DataFrame:
    """Times between successive strokes (session, t, seq), pauses left out, newest ``limit`` kept."""
    gaps = _with_previous(strokes, key, max_rows, {"_before": "t"}).withColumn("interval_ms", F.col("t") - F.col("_before"))
    gaps = gaps.filter((F.col("interval_ms") > 0) & (F.col("interval_ms") < MAX_INTERVAL_MS)).drop("_before")
    return keep_last(gaps, [key], ["t", "seq"], limit)


def key_holds(
    events: DataFrame, key: str = "session_id", limit: int = KEPT_INTERVALS, max_rows: int | None = skew.DEFAULT_MAX_ROWS
) -> DataFrame:
    """Times from a press to its release (session, t, seq, pressed), newest ``limit`` kept.

    A release counts if the event before it is a press: of presses in a row the last one counts, and
    one release for each. Events that say neither are left out.
    """
    known = events.filter(F.col("pressed").isNotNull())
    paired = _with_previous(known, key, max_rows, {"_before": "t", "_was": "pressed"})
    holds = paired.filter(~F.col("pressed") & F.col("_was")).withColumn("hold_ms", F.col("t") - F.col("_before"))
    return keep_last(holds.drop("pressed", "_before", "_was"), [key], ["t", "seq"], limit)


def _walk(spacing: int):
    """Keep of every group (session, run, slice) the first point from ``_from`` on, and then each
    that is ``spacing`` after the last one kept."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, allowed = None, 0
        for batch in batches:
            kept = np.zeros(len(batch), dtype=bool)
            columns = [batch[name] for name in ("session", "_run", "_slice", "_from", "t")]
            for at, (session, run, part, start, t) in enumerate(zip(*columns)):
                if (session, run, part) != group:
                    group, allowed = (session, run, part), start
                if t >= allowed:
                    allowed, kept[at] = t + spacing, True
            yield batch[kept]

    return keep


def _slice_exits(spacing: int, width: int):
    """For each way a walk can enter a slice (0 .. spacing - 1 ms after its start), how far into the
    next slice its last kept point reaches."""

    def exits(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        session, run, part = key
        start, end = run + part * width, run + (part + 1) * width
        t = np.sort(points["t"].to_numpy())
        following = np.searchsorted(t, t + spacing)
        reach = np.append(np.maximum(t + spacing - end, 0), 0)
        for at in range(len(t) - 1, -1, -1):
            if following[at] < len(t):
                reach[at] = reach[following[at]]
        table = reach[np.searchsorted(t, start + np.arange(spacing))]
        return pd.DataFrame({"session": [session], "_run": [run], "_slice": [part], "exits": [table.tolist()]})

    return exits


def _slice_entries(key: tuple, slices: pd.DataFrame) -> pd.DataFrame:
    """Chain the slices of one run: where the walk enters each of them."""
    slices = slices.sort_values("_slice")
    entries, entry = [], 0
    for table in slices["exits"]:
        entries.append(entry)
        entry = int(table[entry])
    return slices[["session", "_run", "_slice"]].assign(_entry=entries)


def downsample(
    points: DataFrame,
    key: str = "session_id",
    spacing_ms: int = MIN_SPACING_MS,
    max_rows: int | None = skew.DEFAULT_MAX_ROWS,
    slice_ms: int = 600_000,
) -> DataFrame:
    """Keep a point (session, t, seq) only if ``spacing_ms`` passed since the last kept one.

    A point that far from its predecessor is kept whatever came before, so it starts a run that
    can be walked by itself. Only one point per millisecond can be kept. A run of more than
    ``max_rows`` points is cut into slices: what a slice hands on depends only on where the walk
    enters it, so slices are worked out side by side and chained afterwards.
    """
    if slice_ms < 2 * spacing_ms:
        raise ValueError(f"slice_ms must be at least twice the spacing, got: {slice_ms}")
    order = ["t", "seq"]
    firsts = points.groupBy(key, "t").agg(F.min("seq").alias("seq")).select(F.col(key).alias("session"), "t", "seq")
    starts = F.when(F.col("_before").isNull() | (F.col("t") - F.col("_before") >= spacing_ms), F.col("t"))
    kind = dict(firsts.dtypes)
    run_key = f"session {kind['session']}, _run bigint, _slice bigint"

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.lit(0).cast("long").alias("_slice"), F.col("_run").alias("_from"))

    def cut(rows: DataFrame) -> DataFrame:
        part = F.floor((F.col("t") - F.col("_run")) / F.lit(slice_ms)).cast("long")
        rows = cut_lineage(rows.withColumn("_slice", part))
        tables = rows.groupBy("session", "_run", "_slice").applyInPandas(
            _slice_exits(spacing_ms, slice_ms), f"{run_key}, exits array<bigint>"
        )
        entries = tables.groupBy("session", "_run").applyInPandas(_slice_entries, f"{run_key}, _entry bigint")
        entered = F.col("_run") + F.col("_slice") * slice_ms + F.col("_entry")
        return skew.null_safe_join(rows, entries, ["session", "_run", "_slice"]).withColumn("_from", entered).drop("_entry")

    def plain(rows: DataFrame) -> DataFrame:
        by_time = Window.partitionBy("session").orderBy(*order)
        marked = rows.withColumn("_before", F.lag("t").over(by_time)).withColumn("_start", starts)
        running = by_time.rowsBetween(Window.unboundedPreceding, 0)
        return whole(marked.withColumn("_run", F.max("_start").over(running)).select("session", "_run", "t", "seq"))

    def sliced(rows: DataFrame) -> DataFrame:
        stepped = skew.sliced_previous(skew.with_slice(rows, ["session"], order), ["session"], order, {"_before": "t"})
        ran = skew.sliced_running(stepped, ["session"], order, maxima={"_run": starts})
        ran = cut_lineage(ran.select("session", "_run", "t", "seq"))
        # Only a hot session can hold a run above the limit.
        return skew.by_heat(ran, ["session", "_run"], whole, cut, max_rows)

    parts = skew.by_heat(firsts, ["session"], plain, sliced, max_rows)
    group = ["session", "_run", "_slice"]
    spread = parts.select(*group, "_from", "t", "seq").repartition(*group).sortWithinPartitions(*group, "t")
    kept = spread.mapInPandas(_walk(spacing_ms), f"{run_key}, _from bigint, t bigint, seq {kind['seq']}")
    return kept.select(F.col("session").alias(key), "t", "seq")
