"""Stimulus trains from texts, as they arrive.

Closed-loop experiments drive a culture with encoded input. Here each text becomes a
pulse train: a letter run is a pulse on the channel that its first letter picks, of an
amplitude equal to its length; reading takes a fixed time per letter and one more for
the gap. The stream takes only files that its checkpoint has not seen, and stops when
none is left. It writes one row a document, partitioned by source: pulses, duration,
rate, intervals, amplitudes, and how evenly the channels are used. A second table sums
them up by source and language; it is derived from the first and replaced as a whole.

Null or empty texts give a row without pulses. A rerun finds nothing new and leaves
both tables as they are.

    python -m jobs.stimulus_trains --texts s3a://lab/texts --out s3a://lab/trains --checkpoint s3a://lab/trains_state
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from pulselake.functions.scalars import grade, safe_log2, timescale_label
from pulselake.operators.grid import r6

NAME = "stimulus_trains"
INPUT = "doc_id long, text string, lang string, source string"
TRAINS = (
    "doc_id long, lang string, pulses int, duration_ms long, timescale string, rate_hz double, isi_mean_ms double, isi_cv double, "
    "amp_mean double, amp_std double, channels_used int, evenness double, grade string, source string"
)
SUMMARY = "lang string, texts long, silent long, pulses long, hours double, mean_rate_hz double, mean_evenness double, source string"
LETTERS = "[A-Za-zÀ-ÿ]+"


def _moments(x: Column) -> tuple[Column, Column]:
    """Mean and deviation of an array of integers; null for an empty one."""
    n = F.nullif(F.size(x), F.lit(0))
    mean = F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v) / n
    spread = F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v * v) / n - mean * mean
    return mean, F.sqrt(F.when(spread < 0, 0.0).otherwise(spread))


def trains(texts: DataFrame, p: dict) -> DataFrame:
    """One row of train statistics for each text; no shuffle, no state."""
    pace, k = p["ms_per_letter"], p["channels"]
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LETTERS), F.lit(0))
    x = texts.select("doc_id", "lang", "source", runs.alias("runs"))
    x = x.withColumn("amp", F.transform("runs", F.length)).withColumn("gap", F.transform(F.slice("amp", 1, F.greatest(F.size("amp") - 1, F.lit(0))), lambda v: v + 1))
    # a text of one character per pulse names its channel, so that a channel's pulses are counted by string functions
    x = x.withColumn("at", F.array_join(F.transform("runs", lambda r: F.char(F.ascii(r) % k + 64)), ""))
    x = x.withColumn("used", F.array(*(F.length("at") - F.length(F.replace("at", F.lit(chr(64 + c)), F.lit(""))) for c in range(k))))
    n = F.size("amp")
    letters = F.aggregate("amp", F.lit(0).cast("long"), lambda s, v: s + v)
    x = x.select("doc_id", "lang", "source", "amp", "gap", "used", n.alias("pulses"), ((letters + n) * pace).alias("duration_ms"))
    share = lambda c: c / F.col("pulses")
    bits = F.aggregate("used", F.lit(0.0), lambda s, c: s - share(c) * safe_log2(share(c)))
    (mean, std), (gap, gap_std) = _moments(F.col("amp")), _moments(F.col("gap"))
    even = F.when(F.col("pulses") > 0, r6(bits / F.log2(F.lit(float(k)))))
    return x.select(
        "doc_id", "lang", "pulses", "duration_ms", timescale_label(F.col("duration_ms")).alias("timescale"), r6(F.try_divide(F.col("pulses") * 1000.0, F.col("duration_ms"))).alias("rate_hz"),
        r6(gap * pace).alias("isi_mean_ms"), r6(gap_std / gap).alias("isi_cv"), r6(mean).alias("amp_mean"), r6(std).alias("amp_std"),
        F.size(F.filter("used", lambda c: c > 0)).alias("channels_used"), even.alias("evenness"), grade(100 * even).alias("grade"), "source",
    )


def summary(table: DataFrame) -> DataFrame:
    return table.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("pulses") == 0).alias("silent"), F.sum("pulses").alias("pulses"), r6(F.sum("duration_ms") / 3.6e6).alias("hours"),
        r6(F.avg("rate_hz")).alias("mean_rate_hz"), r6(F.avg("evenness")).alias("mean_evenness"),
    ).select(*(c.split()[0] for c in SUMMARY.split(", ")))


def watched(path: str) -> str:
    """A pattern for this path alone: a file stream takes a plain path for a folder, a pattern for a folder or a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, texts: str, out: str, checkpoint: str, p: dict) -> dict:
    """Take the new files of ``texts`` into ``out``/trains and sum all up in ``out``/summary; returns what was read and written."""
    rows = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", p["files_per_batch"]).parquet(watched(texts))
    sink = trains(rows, p).writeStream.format("parquet").partitionBy("source").option("path", f"{out}/trains").option("checkpointLocation", checkpoint)
    query = sink.trigger(availableNow=True).start()
    query.awaitTermination()
    taken = sum(step["numInputRows"] for step in query.recentProgress)
    summary(read(spark, out)).repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{out}/summary")
    told = {"read": taken, "trains": read(spark, out).count(), "groups": read(spark, out, "summary").count()}
    log.info("%s: read %d new rows of %s; %s holds %d trains in %d groups", NAME, taken, texts, out, told["trains"], told["groups"])
    return told


def read(spark: SparkSession, out: str, table: str = "trains") -> DataFrame:
    """The written table as it stands."""
    return spark.read.schema({"trains": TRAINS, "summary": SUMMARY}[table]).parquet(f"{out}/{table}")


if __name__ == "__main__":
    main(NAME, run, {"texts": "the text table: a folder of Parquet files, or one", "out": "folder of the trains", "checkpoint": "folder of the stream's checkpoint"})
