"""Live forms of the two append-only logs. Each equals its batch twin on the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditspark.functions import vocab
from auditspark.functions.exprs import metric_outcome, wilson


def live_tally(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str],
               run_id: str = "run_id", at: str | None = None, within: str = "7 days") -> DataFrame:
    """Successes, denominator, excluded rows and Wilson bounds per (keys, metric) so far.

    A run reported twice counts once. Without ``at`` that holds for ever and every run id is kept.
    With ``at``, a timestamp of the report, repeats up to ``within`` apart count once, a report
    older than that when it arrives is left out, and an id is forgotten once reports are twice that
    past it: the state is the ids of two such spans and one counter per cell. Use it in complete or
    update mode.
    """
    once = rows.dropDuplicates([run_id]) if at is None else rows.withWatermark(
        at, within).dropDuplicatesWithinWatermark([run_id])
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), metric_outcome(rows, m).alias("success"))
        for m in metrics])).alias("m")
    counted = once.select(*keys, cells).groupBy(*keys, F.col("m.metric").alias("metric")).agg(
        F.count_if("m.success").alias("successes"), F.count("m.success").alias("n"),
        F.count_if(F.col("m.success").isNull()).alias("excluded"))
    low, high = wilson(F.col("successes"), F.col("n"), vocab.WILSON_Z)
    return counted.withColumns({"low": low, "high": high})


def live_dispositions(dispositions: DataFrame, keys: Sequence[str] = ("run_id", "objection_id"),
                      order: str = "iteration", value: str = "disposition") -> DataFrame:
    """Latest disposition per objection by pass number.

    A pass arriving late changes nothing that a later pass already decided, so no watermark is
    needed: the order is the pass number, not the arrival.
    """
    return dispositions.groupBy(*keys).agg(F.max(F.struct(order, value)).alias("last")).select(
        *keys, F.col(f"last.{value}").alias(value), F.col(f"last.{order}").alias(order))


def open_now() -> Column:
    return ~F.col("disposition").isin(*vocab.CLOSING)


def _versions(spark: SparkSession, folder: str, complete: bool = False) -> list[int]:
    """Sorted numbers of the versions in ``folder``, by any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("version=")]
    if complete:
        found = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in found)


def _read(spark: SparkSession, folder: str, versions: Sequence[int]) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/version={v}" for v in versions])


def standing_versions(spark: SparkSession, path: str, upto: int | None = None) -> tuple[int, list[int]]:
    """The newest base before version ``upto`` and the changes since then, which are all a read needs."""
    bases = [b for b in _versions(spark, f"{path}/base", complete=True) if upto is None or b < upto]
    if not bases:
        raise ValueError(f"no versions were ever written to {path}")
    return bases[-1], [v for v in _versions(spark, f"{path}/changes")
                       if v > bases[-1] and (upto is None or v <= upto)]


def _newest(spark: SparkSession, path: str, keys: Sequence[str], upto: int | None = None) -> DataFrame:
    base, changes = standing_versions(spark, path, upto)
    rows = _read(spark, f"{path}/base", [base])
    if changes:
        rows = rows.unionByName(_read(spark, f"{path}/changes", changes))
    values = [c for c in rows.columns if c not in (*keys, "version")]
    newest = F.max_by(F.struct(*values), F.col("version")).alias("v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "v.*")


def write_versions(updates: DataFrame, path: str, checkpoint: str, keys: Sequence[str],
                   compact_every: int = 16) -> StreamingQuery:
    """Write each micro-batch's changed keys as its own version and stop when the input is read.

    A version is overwritten when its batch is replayed after a failure, so every batch counts
    exactly once. Every ``compact_every`` versions the newest row of each key is written as a base,
    beside the versions it stands for, so a read never meets more changes than that. The first base
    is empty: a stream without rows reads as an empty table. A base that a failure cut short lacks
    its mark and is not read.
    """
    spark = updates.sparkSession
    if not _versions(spark, f"{path}/base", complete=True):
        spark.createDataFrame([], updates.schema).write.mode("overwrite").parquet(f"{path}/base/version=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/version={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _newest(batch.sparkSession, path, keys, batch_id).write.mode("overwrite").parquet(
                f"{path}/base/version={batch_id}")

    return (updates.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_versions(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current value of every key: its row in the highest version that mentions it."""
    return _newest(spark, path, keys)
