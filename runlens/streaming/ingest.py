"""Incremental ingest: listing pages become segments of a store (see ``sources.store``)."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.session import stored
from runlens.sources import store as log
from runlens.sources.json_pages import JOB_PAGE, RUN_PAGE, jobs_of_pages, runs_of_pages
from runlens.sources.store import read_store

__all__ = ["PAGE", "ingest", "job_totals", "latest_version", "read_store", "save_batch"]

PAGE = f"{RUN_PAGE}, {JOB_PAGE.removeprefix('total_count bigint, ')}"


def _latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key of a batch, the first in ``order``; the rank limit applies before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_version(spark: SparkSession, store: str) -> int | None:
    """Newest version of a store, or None."""
    return log.version(spark, store)["version"] or None


def job_totals(pages: DataFrame) -> DataFrame:
    """Number of jobs that the listing of a run announces; a page without the number announces what it has."""
    listed = pages.filter("size(jobs) > 0").select(
        F.coalesce("total_count", F.size("jobs").cast("bigint")).alias("total"), F.explode("jobs.run_id").alias("run_id"))
    return listed.groupBy("run_id").agg(F.max("total").alias("total"))


def save_batch(pages: DataFrame, store: str, source: str | None = None, batch: int | None = None) -> None:
    """Adds some pages to a store. Repeating a batch gives the same tables; with its number it is left out."""
    ended = F.col("completed_at").desc_nulls_last()
    runs = stored(_latest(runs_of_pages(pages), ["run_id"], F.col("run_attempt").desc(), F.col("updated_at").desc_nulls_last()))
    jobs, steps = jobs_of_pages(pages)
    # Steps are read once, so they are not written ahead; by job, their latest rows and their jobs meet in one shuffle.
    jobs, steps = stored(_latest(jobs, ["job_id"], ended)), _latest(steps.repartition("job_id"), ["job_id", "number"], ended)
    log.append(pages.sparkSession, store, runs, jobs, steps, job_totals(pages), source, batch)


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str):
    """Streams new page files of a folder into a store until none is left; returns the finished query.

    Each batch is one commit, numbered by the stream, and then merges segments that are due.
    """

    def save(pages: DataFrame, batch: int) -> None:
        save_batch(pages, store, checkpoint, batch)
        log.compact(spark, store)

    pages = spark.readStream.schema(PAGE).option("multiLine", True).json(folder)
    query = pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
