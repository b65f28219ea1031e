"""Evaluations since the best one, on a log that is still written. An extension: batch and stream give the same rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import evals_since_best

_STATE = "best double, since long, times array<long>, steps array<long>, losses array<double>"


def since_best(log: DataFrame, run: str, step: str = "step", loss: str = "loss", time: str = "time", late: str = "10 minutes") -> DataFrame:
    """(run, time, step, loss, best, since_best): of each evaluation the least loss so far and the evaluations since it first fell to that.

    The order is that of event time, then step, then loss. A loss that is null or NaN is a null one, which is no better than any; until a
    better one than infinity comes, since_best is null. Rows without run, time or step have no place in the order and leave. A stream holds back
    rows until the watermark passes them, so they may come in any order within ``late``; what it holds of a run is those rows and the best so
    far. A row that comes later than that leaves.
    """
    rows = log.where(F.col(run).isNotNull() & F.col(time).isNotNull() & F.col(step).isNotNull())
    value = F.col(loss).cast("double")
    rows = rows.select(F.col(run).cast("string").alias("run"), F.col(time).cast("timestamp").alias("time"), F.col(step).cast("long").alias("step"), F.when(~F.isnan(value), value).alias("loss"))
    if not rows.isStreaming:
        return evals_since_best(rows, "run", ["time", "step", "loss"], "loss").select("run", "time", "step", "loss", "best", "since_best")
    rows = rows.withWatermark("time", late).withColumn("at", F.unix_micros("time"))
    schema = "run string, at long, step long, loss double, best double, since_best long"
    out = rows.groupBy("run").applyInPandasWithState(_advance, schema, _STATE, "append", "EventTimeTimeout")
    return out.select("run", F.timestamp_micros("at").alias("time"), "step", "loss", "best", "since_best")


def _advance(key, frames, state):
    """Keep what came, then number what the watermark has passed."""
    best, since, *held = state.get if state.exists else (None, None, [], [], [])
    held = list(zip(*held, strict=True))
    for f in frames:
        held += zip(f["at"].tolist(), f["step"].tolist(), (None if math.isnan(x) else x for x in f["loss"].astype("float64").tolist()), strict=True)
    held.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0.0))
    passed, out = state.getCurrentWatermarkMs() * 1000, []
    n = sum(r[0] <= passed for r in held)
    for at, step, loss in held[:n]:
        if loss is not None and loss < (math.inf if best is None else best):
            best, since = loss, 0
        else:
            best = loss if best is None else best
            since = None if since is None else since + 1
        out.append((key[0], at, step, loss, best, since))
    times, steps, losses = (list(x) for x in zip(*held[n:], strict=True)) if held[n:] else ([], [], [])
    state.update((best, since, times, steps, losses))
    if times:
        state.setTimeoutTimestamp(max(-(-times[0] // 1000), passed // 1000 + 1))
    frame = pd.DataFrame(out, columns=["run", "at", "step", "loss", "best", "since_best"])
    yield frame.astype({"at": "int64", "step": "int64", "loss": "float64", "best": "float64", "since_best": "Int64"})
