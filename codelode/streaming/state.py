"""History and feedback as streams: a user's latest scans as keyed state, feedback as an append with its checks.

``scan_history`` keeps a user's last scans in the state store (RocksDB, checkpointed), so it goes on after a restart where
it stopped: a scan that comes again is updated, the oldest beyond ``keep`` are evicted, and both are told downstream.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalars import is_uuid4

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Scans that are kept a user, and the longest texts of feedback.
KEEP, MESSAGE_CHARS, NAME_CHARS = 5, 1000, 200


class History(StatefulProcessor):
    """The latest scans of each user by time, then by id; (user, scan, at, kept) of all that changed."""

    def __init__(self, keep: int = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scans = handle.getMapState("scans", "scan string", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changed = {}
        for row in rows:
            # Of one scan's rows in a batch the latest counts.
            if row.scan not in changed or changed[row.scan] < row.at:
                changed[row.scan] = row.at
        for scan, at in changed.items():
            self.scans.updateValue((scan,), (at,))
        held = sorted(((value[0], name[0]) for name, value in self.scans.iterator()), reverse=True)
        for at, scan in held[self.keep :]:
            self.scans.removeKey((scan,))
            yield Row(user=key[0], scan=scan, at=at, kept=False)
        for at, scan in held[: self.keep]:
            if scan in changed:
                yield Row(user=key[0], scan=scan, at=at, kept=True)

    def close(self) -> None:
        pass


def scan_history(scans: DataFrame, keep: int = KEEP) -> DataFrame:
    """(user, scan, at, kept) changes of a stream (user, scan, at); rows without a user, scan or time are left out.

    A change with ``kept`` adds or updates a scan, one without evicts it. The session's state store must be ``ROCKS``.
    """
    known = scans.select("user", "scan", "at").filter("user is not null and scan is not null and at is not null")
    return known.groupBy("user").transformWithState(History(keep), "user string, scan string, at timestamp, kept boolean", "Update", "None")


def history_table(spark, target: str) -> DataFrame:
    """What ``write_history`` has written, applied: the scans whose last change keeps them."""
    changes = spark.read.parquet(target)
    last = changes.groupBy("user", "scan").agg(F.max(F.struct("batch", "kept", "at")).alias("m"))
    return last.filter("m.kept").select("user", "scan", F.col("m.at").alias("at"))


def write_history(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each batch's changes in a folder of its own; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted_feedback(df: DataFrame) -> DataFrame:
    """(id, rating, message, scan_id, project, at) of feedback rows (id, rating, message, scan_id, project, company, at).

    Rows that fill in the hidden ``company`` and ratings that are no whole number from 1 to 5 are left out; texts are trimmed
    and cut to what is stored, a scan id that is none is null. The limits are the stored form's own.
    """
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    own = df.filter((trimmed("company") == "") & F.col("rating").between(1, 5) & (F.col("rating") == F.floor("rating")))
    return own.select(
        "id", F.col("rating").cast("int").alias("rating"), F.substring(trimmed("message"), 1, MESSAGE_CHARS).alias("message"),
        F.when(is_uuid4(trimmed("scan_id")), trimmed("scan_id")).alias("scan_id"), F.nullif(F.substring(trimmed("project"), 1, NAME_CHARS), F.lit("")).alias("project"), "at",
    )


def append_feedback(feedback: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Accepted feedback appended to a Parquet table, each entry once however often its batch is run."""
    return accepted_feedback(feedback).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
