"""Decimation of packets as they come, with the filter's and squelch's state per stream.

Rows are (stream, seq, samples); packets of a stream may arrive in any order
within the stream: those that are early wait in the state until their turn.
They don't wait for ever: after ``patience`` seconds without a packet, or with more than
``most_early`` of them waiting, what is missing is given up for lost.  The stream
then goes on with the first that waits, from a state as after a reset, and a
packet that comes after it was given up, or comes twice, is left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.fir import RESAMPLERS, apply
from cadenza.operators.squelch import THRESHOLD, squelch_array

OUTPUT = "stream long, seq long, first long, y array<double>"


def decimated_stream(packets: DataFrame, kind: str = "decimate4", squelch: bool = False, full: float = 32767.0, threshold: float = THRESHOLD, late: str = "10 minutes", most_early: int = 256) -> DataFrame:
    """Each packet's outputs: those whose newest input lies in it.  A packet without samples resets its stream."""
    r = RESAMPLERS[kind]
    timed = "ts" in packets.columns

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {"next": 0, "at": 0, "tail": [], "gate": [1.0, 1.0], "early": {}}
        phases, out, early = r.phases(), [], now["early"]
        for pdf in frames:
            early |= {str(s): np.asarray(x, float).tolist() for s, x in zip(pdf["seq"], pdf["samples"], strict=True) if s >= now["next"]}
            if timed and len(pdf):  # a stream whose time has run out has no rows
                now["time"] = max(now.get("time", 0), int(pdf["ts"].max().timestamp() * 1000))
        over = state.hasTimedOut
        while early:
            x = early.pop(str(now["next"]), None)
            if x is None:
                if not over and len(early) <= most_early:
                    break
                now |= {"next": min(map(int, early)), "at": 0, "tail": [], "gate": [1.0, 1.0]}
                continue
            now["next"] += 1
            if not x:
                now |= {"at": 0, "tail": [], "gate": [1.0, 1.0]}
                continue
            if squelch:
                gated, *now["gate"] = squelch_array(x, *now["gate"], full, threshold)
                x = gated.tolist()
            held, start, end = now["tail"] + x, now["at"] - len(now["tail"]), now["at"] + len(x)
            first = -(-now["at"] * r.up // r.down)
            out.append((key[0], now["next"] - 1, first, apply(np.array(held), r, phases, first, -(-end * r.up // r.down), start).tolist()))
            now["at"], now["tail"] = end, held[len(held) - min(r.history, len(held)) :]
        state.update((json.dumps(now),))
        if early and timed:
            state.setTimeoutTimestamp(max(now["time"], state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["stream", "seq", "first", "y"])

    keyed = packets.withWatermark("ts", late) if timed else packets
    keyed = keyed.select(F.col("stream").cast("long"), F.col("seq").cast("long"), F.col("samples").cast("array<double>"), *(["ts"] if timed else []))
    return keyed.groupBy("stream").applyInPandasWithState(run, OUTPUT, "state string", "append", "EventTimeTimeout" if timed else "NoTimeout")


def decimated_batch(packets: DataFrame, kind: str = "decimate4") -> DataFrame:
    """The same outputs from a table, by blocks with halos."""
    from pyspark.sql import Window

    from cadenza.operators.fir import framed

    before = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    frames = packets.select("stream", F.col("seq").cast("int").alias("frame_idx"), F.coalesce(F.sum(F.size("samples")).over(before), F.lit(0)).cast("long").alias("pcm_start"), "samples")
    return framed(frames, kind).select("stream", F.col("frame_idx").cast("long").alias("seq"), "first", "y")


def levels_by_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Peak and RMS of timed samples (ts, stream, x) by stream and minute, for streams with late data."""
    window = F.window("ts", "1 minute")
    return events.withWatermark("ts", late).groupBy(window, "stream").agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count(F.lit(1)).alias("n"))
