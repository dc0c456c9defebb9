"""Challenge sessions on a stream: opened PENDING, closed COMPLETED or FAILED by their result."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyguard.operators.authentication import ECI_EVEN_SCORE, ECI_NOT_AUTHENTICATED, ECI_ODD_SCORE
from tallyguard.session import STATE_STORE

_OUT = "trans_id string, state string, trans_status string, eci string"
_CHANGE = Row("trans_id", "state", "trans_status", "eci")


# Fixed value: sessions share state by hash bucket. A checkpoint keeps the number it began with. More
# buckets cost calls in large micro-batches, fewer cost reading in small ones: 100 million sessions
# are about 1500 in each.
BUCKETS = 1 << 16


class SessionProcessor(StatefulProcessor):
    """The sessions of one hash bucket. Every access to the state is a call out of the worker, far
    dearer than a row, so a bucket reads its sessions once and writes them once per micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getValueState("sessions", "ids array<string>, scores array<int>, states array<string>, results_ms array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """Openings of a micro-batch come before its results, and those in the order of their time. A
        result older than one that an earlier micro-batch brought changes nothing."""
        held = self.sessions.get()
        known = {trans: tuple(session) for trans, *session in zip(*held)} if held is not None else {}
        out, changed = [], False
        plain = [(row.trans_id, row.risk_score, row.result_status, row.result_ms) for row in rows]
        for trans, score, result, ms in sorted(plain, key=lambda row: (row[2] is not None, row[3] or 0)):
            if result is None:
                known[trans], changed = (score, "PENDING", None), True
                out.append(_CHANGE(trans, "PENDING", None, None))
                continue
            session = known.get(trans)
            if session is None:
                out.append(_CHANGE(trans, "NOT_FOUND", None, None))
                continue
            if ms is not None and session[2] is not None and ms < session[2]:
                continue
            passed = result.upper() == "Y"
            code = (ECI_EVEN_SCORE if session[0] % 2 == 0 else ECI_ODD_SCORE) if passed else ECI_NOT_AUTHENTICATED
            state = "COMPLETED" if passed else "FAILED"
            known[trans], changed = (session[0], state, ms if ms is not None else session[2]), True
            out.append(_CHANGE(trans, state, "Y" if passed else "N", code))
        if changed:
            self.sessions.update((list(known), *map(list, zip(*known.values()))))
        return iter(out)

    def close(self) -> None:
        pass


def stream_sessions(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """State changes from the streams of openings (trans_id, risk_score) and results (trans_id,
    result_status, and result_ms where known: of several results the last by it stands, whatever
    micro-batches they come in)."""
    spark = sessions.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    opened = sessions.select(
        F.col("trans_id").cast("string").alias("trans_id"), F.col("risk_score").cast("int").alias("risk_score"), F.lit(None).cast("string").alias("result_status"), F.lit(None).cast("long").alias("result_ms")
    )
    at = F.col("result_ms").cast("long") if "result_ms" in results.columns else F.lit(None).cast("long")
    closed = results.select(
        F.col("trans_id").cast("string").alias("trans_id"), F.lit(None).cast("int").alias("risk_score"), F.col("result_status"), at.alias("result_ms")
    )
    bucket = F.pmod(F.xxhash64("trans_id"), F.lit(BUCKETS)).cast("int")
    return opened.unionByName(closed).withColumn("bucket", bucket).groupBy("bucket").transformWithState(
        statefulProcessor=SessionProcessor(), outputStructType=_OUT, outputMode="Append", timeMode="None"
    )
