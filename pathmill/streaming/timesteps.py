"""Frequencies of statements or events per timestep: a workload whose mix changes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequencies(events: DataFrame, name: str, time: str, interval: str = "1 day") -> DataFrame:
    """(name, start, freq): how often each name occurs in each period. Works on tables and on streams alike; a stream needs
    a watermark on ``time`` to end periods."""
    at = F.col(time)
    if dict(events.dtypes)[time] != "timestamp":
        at = at.cast("timestamp")  # a cast hides the watermark of a stream
    period = F.window(at, interval)
    return events.groupBy(name, period.alias("_w")).agg(F.count(F.lit(1)).alias("freq")).select(name, F.col("_w.start").alias("start"), "freq")


def stream_frequencies(stream: DataFrame, name: str, time: str, interval: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The same of a stream: periods end when events are ``late`` past them; events after that are left out."""
    return frequencies(stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late), name, time, interval)


def run_frequencies(stream: DataFrame, name: str, time: str, path: str, interval: str = "1 day") -> DataFrame:
    """Runs a stream over all that is there and returns the frequencies so far: every trigger writes the whole table anew
    under ``path``, one folder for each batch, and the last one is returned."""
    last = {}

    def write(batch: DataFrame, number: int) -> None:
        last["at"] = f"{path}/batch-{number}"
        batch.write.mode("overwrite").parquet(last["at"])

    counted = frequencies(stream.withColumn(time, F.col(time).cast("timestamp")), name, time, interval)
    counted.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(last["at"])


def reset_interval(freq: DataFrame, interval: float, new_interval: float) -> DataFrame:
    """Frequencies of timesteps of one length as they are expected in timesteps of another."""
    return freq.withColumn("freq", F.col("freq") * (new_interval / interval))


def mix(freq: DataFrame, name: str, mode: str = "each") -> DataFrame:
    """Frequencies of one timestep for all: `static` takes the mean, `first` and `last` an end, `each` leaves them as they are."""
    if mode == "each":
        return freq
    if mode == "static":
        steps = freq.select("start").distinct().agg(F.count(F.lit(1)).alias("_steps"))
        return freq.groupBy(name).agg(F.sum("freq").alias("_sum")).crossJoin(F.broadcast(steps)).select(name, (F.col("_sum") / F.col("_steps")).alias("freq"))
    end = freq.agg((F.min if mode == "first" else F.max)("start").alias("start"))
    return freq.join(F.broadcast(end), "start").select(name, "freq")
