"""Flow sessions with gap statistics over a stream, by arbitrary state with event-time timers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

FLAGS = ("syn", "ack", "fin", "rst", "psh")
_PACKET = "time_us bigint, pkt_len bigint, ttl bigint, label int, " + ", ".join(f"{f} int" for f in FLAGS)
_FLOW = "start_us bigint, last_us bigint, n bigint, total bigint, longest bigint, s1 string, s2 string, ttl bigint, label int, " + ", ".join(f"{f} bigint" for f in FLAGS)
RESULT = "pkt_count bigint, total_bytes bigint, max_pkt_len bigint, start_us bigint, duration_us bigint, mean_pkt_len double, mean_iat_ms double, std_iat_ms double, mean_ttl double, label int, " + ", ".join(f"{f}_count bigint" for f in FLAGS)


class FlowSessions(StatefulProcessor):
    """State of a key: packets that may still be overtaken (ahead of the watermark), and the running moments of the open flow:
    last time, number, sums of gaps and of their squares. Packets enter the flow in time order once the watermark has passed
    them; a flow ends when a packet comes more than the gap after the last, or the watermark does."""

    def __init__(self, names: list[str], gap_us: int) -> None:
        self.names, self.gap = names, gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", _FLOW)
        self.ahead = handle.getListState("ahead", _PACKET)

    def _ended(self, key: tuple, f: dict) -> tuple:
        gaps, s1, s2 = float(f["n"] - 1), float(int(f["s1"])), float(int(f["s2"]))
        mean = s1 / gaps / 1000 if gaps > 0 else 0.0
        deviation = math.sqrt(max(0.0, s2 / gaps - (s1 / gaps) * (s1 / gaps))) / 1000 if gaps > 1 else 0.0
        return (*key, f["n"], f["total"], f["longest"], f["start_us"], f["last_us"] - f["start_us"], f["total"] / f["n"], mean, deviation, f["ttl"] / f["n"], f["label"], *[f[x] for x in FLAGS])

    def _advance(self, key: tuple, new: list[tuple], watermark_ms: int) -> list[tuple]:
        done, mark = [], watermark_ms * 1000
        packets = sorted([*[tuple(p) for p in self.ahead.get()], *new])
        ripe, wait = [p for p in packets if p[0] <= mark], [p for p in packets if p[0] > mark]
        f = dict(zip([c.split()[0] for c in _FLOW.split(", ")], self.flow.get())) if self.flow.exists() else None
        for time, length, ttl, label, *flags in ripe:
            if f is not None and time - f["last_us"] > self.gap:
                done.append(self._ended(key, f))
                f = None
            if f is None:
                f = {"start_us": time, "last_us": time, "n": 0, "total": 0, "longest": length, "s1": "0", "s2": "0", "ttl": 0, "label": label, **{x: 0 for x in FLAGS}}
                step = None
            else:
                step = time - f["last_us"]
            if step is not None:
                f["s1"], f["s2"] = str(int(f["s1"]) + step), str(int(f["s2"]) + step * step)
            f["last_us"], f["n"], f["total"], f["longest"], f["ttl"], f["label"] = time, f["n"] + 1, f["total"] + length, max(f["longest"], length), f["ttl"] + ttl, max(f["label"], label)
            for x, v in zip(FLAGS, flags):
                f[x] += v
        if f is not None and mark - f["last_us"] > self.gap:
            done.append(self._ended(key, f))
            f = None
        if wait:
            self.ahead.put(wait)
        else:
            self.ahead.clear()
        if f is None:
            self.flow.clear()
        else:
            self.flow.update(tuple(f[c.split()[0]] for c in _FLOW.split(", ")))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if wait or f is not None:
            # the next time at which something is due: a packet that becomes ripe, or the end of the flow
            due = [*([wait[0][0]] if wait else []), *([f["last_us"] + self.gap + 1] if f is not None else [])]
            self.handle.registerTimer(max(-(-min(due) // 1000), watermark_ms + 1))
        return done

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[*self.names, *[c.split()[0] for c in RESULT.split(", ")]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PACKET.split(", ")]
        new = [tuple(int(v) for v in r) for pdf in rows for r in pdf[names].itertuples(index=False)]
        yield from self._frame(self._advance(tuple(key), new, max(0, timerValues.getCurrentWatermarkInMs())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frame(self._advance(tuple(key), [], max(0, timerValues.getCurrentWatermarkInMs())))

    def close(self) -> None:
        pass


def flow_sessions(packets: DataFrame, key: list[str], gap_seconds: float = 600.0, late: str = "1 hour") -> DataFrame:
    """A stream of packets (ts, key, pkt_len, ttl, label, tcp_flag_*) to flows that end after a gap, with the columns of the flow
    table of network.flows(): mean and population deviation of the gaps included.

    Packets later than the watermark are dropped; earlier ones may come in any order. The result comes once, when a flow
    has ended. The state store must keep timers: set spark.sql.streaming.stateStore.providerClass to the RocksDB one."""
    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)
    flags = [(F.coalesce(F.col(f"tcp_flag_{f}"), F.lit(0)) if f"tcp_flag_{f}" in packets.columns else F.lit(0)).cast("int").alias(f) for f in FLAGS]
    rows = packets.withWatermark("ts", late).select(*key, "ts", F.unix_micros("ts").alias("time_us"), count("pkt_len"), count("ttl") if "ttl" in packets.columns else F.lit(0).cast("bigint").alias("ttl"), F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"), *flags)
    types = ", ".join(f"{c} {packets.schema[c].dataType.simpleString()}" for c in key)
    return rows.groupBy(*key).transformWithStateInPandas(FlowSessions(list(key), int(gap_seconds * 1_000_000)), f"{types}, {RESULT}", "Append", "EventTime")
