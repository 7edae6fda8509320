"""Series as streams: windowed moments under a watermark, and delay embedding with a state of a few values a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, key: str, ts: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """key, start, n, mean and sd of tumbling windows; works on streams and on tables alike."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    got = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events
    return got.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).select(key, F.col("w.start").alias("start"), "n", "mean", "sd")


def streaming_takens(events: DataFrame, key: str, order: str, value: str, m: int = 3, tau: int = 1) -> DataFrame:
    """Points of the delay embedding as values arrive; the state of a key is its last (m - 1) * tau values and the
    number of points sent. Values of a micro-batch are put in order; later ones are taken as they come."""
    keep = (m - 1) * tau
    kind = dict(events.dtypes)[key]

    def run(k, frames, state):
        import pandas as pd

        sent, last = state.get if state.exists else (0, [])
        values = list(last)
        new = pd.concat(list(frames)).sort_values(order)[value].tolist()
        values += [float(v) for v in new]
        n = len(values) - keep
        rows = [(k[0], sent + i, *(values[i + j * tau] for j in range(m))) for i in range(max(n, 0))]
        state.update((sent + max(n, 0), values[max(n, 0) :]))
        yield pd.DataFrame(rows, columns=[key, "i", *(f"x{j}" for j in range(m))])

    schema = f"{key} {kind}, i long, " + ", ".join(f"x{j} double" for j in range(m))
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(run, schema, "sent long, last array<double>", "append", "NoTimeout")
