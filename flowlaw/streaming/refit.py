"""Refitting as rows arrive: per window in the stream itself, or over all batches so far."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.summary import Summary, Triangle, summarize, triangle
from ..sources.results import append, load


def windowed_moments(stream: DataFrame, time: str, late: str, window: str, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    """Sums by window and keys that a line through (x, y) needs; rows later than late are dropped, and closed windows leave the state."""
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "sxy": F.sum(x * y)}
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(*[s.alias(k) for k, s in sums.items()])


def slope(moments: DataFrame) -> DataFrame:
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return moments.withColumn("slope", F.when(spread > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread))


class Refit:
    """Merges each batch's Summary into that of all batches before, and hands it on.

    With a state, a folder that outlives the driver, the factor is written with each batch's number before the batch counts as done, and a new Refit
    goes on from the last one written to its end. A batch that comes again after a failure, with a number that was seen, is not added twice.
    """

    def __init__(self, names: Sequence[str], on_summary: Callable[[Summary], None], state: str | None = None, spark: SparkSession | None = None):
        self.names, self.on_summary, self.state = tuple(names), on_summary, state
        self.summary: Summary | None = None
        self.last = -1
        if state and spark and (held := load(spark, state)) is not None and (row := held.orderBy(F.desc("batch")).first()) is not None:
            self.last = row["batch"]
            if row["n"]:
                self.summary = Summary(np.array(row["factor"]).reshape(-1, len(self.names) + 1), row["n"], self.names)

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        new = summarize(batch, self.names)
        merged = self.summary.merged(new) if self.summary else new
        if self.state:
            row = (number, merged.n, [float(x) for x in merged.factor.ravel()])
            # A file appears whole or not at all; of two for one number either is right.
            append(batch.sparkSession.createDataFrame([row], "batch long, n long, factor array<double>").coalesce(1), self.state)
        if new.n:
            self.summary = merged
            self.on_summary(self.summary)
        self.last = number

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """stream: theta and y."""
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keyed_fits(stream: DataFrame, keys: Sequence[str], names: Sequence[str], support: Sequence[int], idle: str | None = None) -> DataFrame:
    """keys, n, coefficients and closed of each key that a batch touches: the fit of some terms to all of the key's rows so far.

    stream: keys, theta and y. A key's triangle, as large as the dictionary, is in Spark's state store and so outlives the driver and any executor. With idle, a duration like "1 hour",
    a key that gets no rows for so long in processing time is given out a last time, closed, and its state is dropped.
    """
    width, names = len(names) + 1, tuple(names)
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = 0, Triangle(width)
        if state.exists:
            n, factor = state.get
            held.add(np.array(factor).reshape(-1, width), 0)
        closed = state.hasTimedOut
        if not closed:
            for pdf in frames:
                block = np.column_stack([np.stack(pdf["theta"].to_numpy()).astype(float), pdf["y"].to_numpy(float)])
                held.add(block, len(block))
        n += held.n
        factor = held.factor()
        fit = Summary(triangle(factor), n, names).fit(support)[0]
        if closed:
            state.remove()
        else:
            state.update((n, [float(x) for x in factor.ravel()]))
            if idle:
                state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        yield pd.DataFrame([(*key, n, [float(c) for c in fit], closed)], columns=[*keys, "n", "coefficients", "closed"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    grouped = stream.select(*keys, "theta", "y").groupBy(*keys)
    return grouped.applyInPandasWithState(update, f"{kinds}, n long, coefficients array<double>, closed boolean", "n long, factor array<double>", "update", timeout)
