"""foreachBatch sinks that keep state in a keyed store.

A batch reads what it touches of the newest committed version and writes its changes as the next one. A batch that is run again after
a failure writes the same version once more. A query that starts anew, from epoch 0, goes on from the stored state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..operators import ledger, state
from ..sources import inventory
from .keyed_store import KeyedStore, names_in, newest_version, query_id

TRACKER_SCHEMA = "file_id string, md5 string, status string"
PUSH_LOG_SCHEMA = "item_type string, item_id string, company string, status string, batch_no long"

REGISTRATION = ["tenant_id", "registration_gstin"]

__all__ = ["file_sink", "newest_version", "push_log", "push_sink", "query_id", "read_version", "trigger_sink"]

Sink = Callable[[DataFrame, int], None]


def read_version(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame:
    """State as a committed version has it; nothing for version -1."""
    return KeyedStore(spark, path, schema).read(version)


def trigger_sink(path: str, scope: DataFrame, now: Column) -> Sink:
    """Merge the gaps of each reconciliation run into the trigger state.

    Only the buckets of registrations that the run covers are read, and only triggers that change are written.
    """
    def merge(gaps: DataFrame, epoch: int) -> None:
        store = KeyedStore(gaps.sparkSession, path, schemas.GAP_TRIGGERS, state.TRIGGER_KEY, REGISTRATION)
        base = store.base_version(epoch)
        covered = scope.join(gaps.select(*REGISTRATION).distinct(), REGISTRATION, "left_semi")
        old = store.read(base, store.buckets_of(covered))
        merged = state.merge_triggers(old, gaps, covered, now).select(*old.columns)
        store.write(merged.subtract(old), base, epoch)

    return merge


def file_sink(path: str, handle: Callable[[DataFrame], DataFrame | None]) -> Sink:
    """Hand new and changed files to ``handle`` and remember what became of them.

    ``handle`` returns (file_id, status) of the files it was given; a file it doesn't name has failed, and comes
    again. Where it returns nothing, all are completed.
    """
    def take(files: DataFrame, epoch: int) -> None:
        store = KeyedStore(files.sparkSession, path, TRACKER_SCHEMA, ["file_id"])
        base = store.base_version(epoch)
        latest = files.groupBy("file_id").agg(F.max_by("md5", "seq").alias("md5"))
        tracker = store.read(base, store.buckets_of(latest))
        todo = inventory.needs_processing(latest, tracker)
        outcome = handle(todo)
        done = todo.select("file_id", "md5")
        if outcome is None:
            done = done.withColumn("status", F.lit("completed"))
        else:
            done = done.join(outcome.select("file_id", "status"), "file_id", "left").withColumn("status", F.coalesce("status", F.lit("failed")))
        store.write(done, base, epoch)

    return take


def push_log(spark: SparkSession, path: str, without: str = "") -> DataFrame:
    """All logged attempts, but for those of one batch."""
    batches = [f"{path}/{n}" for n in names_in(spark, path) if n != without]
    return spark.read.schema(PUSH_LOG_SCHEMA).parquet(*batches) if batches else spark.createDataFrame([], PUSH_LOG_SCHEMA)


def push_sink(path: str, deliver: Callable[[DataFrame], DataFrame]) -> Sink:
    """Deliver export-ready items once; ``deliver`` returns them with the status of the attempt.

    Each batch adds a folder of its own to the log and touches no other; run again, it writes its folder anew.
    """
    def push(items: DataFrame, epoch: int) -> None:
        spark = items.sparkSession
        own = f"batch={query_id(spark)}-{epoch}"
        log = push_log(spark, path, without=own)
        results = deliver(ledger.to_push(items, log)).withColumn("batch_no", F.lit(epoch).cast("long"))
        results.select(*log.columns).write.mode("overwrite").parquet(f"{path}/{own}")

    return push
