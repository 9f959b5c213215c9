"""The messages table as the state of a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chatlens.operators import upsert
from chatlens.sources import schemas as S


# Keeps streaming state on local disk with changes logged to the checkpoint,
# instead of in executor memory.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_disk_state(spark: SparkSession) -> None:
    """For queries started from now on; needed once state outgrows memory."""
    for name, value in DISK_STATE.items():
        spark.conf.set(name, value)


def start_upsert_state(
    arrivals: DataFrame, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the folded row of every key as state; write changed rows per batch.

    State grows with the number of keys; it suits bounded sets of chats. For
    tables without bound use ``streaming.live``, whose state is files.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        upsert.fold_messages(arrivals)
        .writeStream.outputMode("update").foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )


def current_state(changes: DataFrame) -> DataFrame:
    """Last written row of every key."""
    return upsert.fold_latest(changes, seq=["batch_id"])


#: Groups among which the keys of the state are dealt; more than tasks, so that each task has several.
SLOTS = 256
#: Groups that a slot is dealt into again: a task holds the rows of one group at a time, those of its result included.
PARTS = 1024
_ORDER = T.StructType([T.StructField("first_seq", T.LongType()), T.StructField("last_seq", T.LongType())])
_HELD = T.StructType([*[f for f in S.MESSAGES.fields if f.name not in S.KEY], *_ORDER.fields])
_KEY = T.StructType([f for f in S.MESSAGES.fields if f.name in S.KEY])
HELD = "held"


def _newer(row: dict, held: dict) -> bool:
    """Whether the edit fields of ``row`` replace those held: newest edit, its first arrival; with no edit the last."""
    if row["edit_date"] is None or held["edit_date"] is None:
        if row["edit_date"] is None and held["edit_date"] is None:
            return row["last_seq"] > held["last_seq"]
        return held["edit_date"] is None
    if row["edit_date"] == held["edit_date"]:
        return row["last_seq"] < held["last_seq"]
    return row["edit_date"] > held["edit_date"]


def fold_two(held: dict | None, row: dict) -> dict:
    """The upsert rule for one arrival; any order of arrivals gives the same."""
    if held is None:
        return row
    edit, first = (row if _newer(row, held) else held), (row if row["first_seq"] < held["first_seq"] else held)
    return {c: edit[c] if c in upsert.EDITABLE or c == "last_seq" else first[c] for c in held}


class _Messages(StatefulProcessor):
    """Folded rows of the keys of a part of a slot, each dropped some time after it last changed."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState(HELD, _KEY, _HELD, self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        names = [f.name for f in _HELD.fields]
        changed: dict[tuple, dict] = {}
        for r in rows:
            k = tuple(r[c] for c in S.KEY)
            if k not in changed:
                old = self.held.getValue(k)
                changed[k] = None if old is None else dict(zip(names, old))
            changed[k] = fold_two(changed[k], {c: r[c] for c in names})
        for k, row in changed.items():
            value = tuple(row[c] for c in names)
            self.held.updateValue(k, value)
            yield Row(**dict(zip(S.KEY, k)), **{c: row[c] for c in names if c not in _ORDER.names})

    def close(self) -> None:
        pass


def start_expiring_state(
    arrivals: DataFrame, out: str, checkpoint: str, keep_ms: int, trigger: dict | None = None, slots: int = SLOTS
) -> StreamingQuery:
    """Keep the folded row of every key for ``keep_ms`` after it last changed; write changed rows per batch.

    State is bounded by the keys of that time. An edit that comes later counts
    as a first arrival here; folding it onto a stored table (``current_state``
    over older batches) still gives the right row, since the fold is the same.
    What is over goes with the next batch that has rows. Needs
    ``use_disk_state``. ``held_state`` reads what is held.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    seq = F.col(upsert.SEQ)
    dealt = arrivals.withColumns({
        "slot": F.pmod(F.xxhash64(*S.KEY), F.lit(slots)), "part": F.pmod(F.hash(*S.KEY), F.lit(PARTS)),
        "first_seq": seq, "last_seq": seq,
    })
    kept = dealt.groupBy("slot", "part").transformWithState(
        statefulProcessor=_Messages(keep_ms), outputStructType=S.MESSAGES, outputMode="Update", timeMode="ProcessingTime"
    )
    writer = (
        kept.writeStream.outputMode("update").foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
    )
    # else a clock that may expire something is a reason for one more batch, without end; a query takes the setting at its start
    conf, name = arrivals.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.start()
    finally:
        conf.set(name, before)


def held_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Keys and rows that the state of ``start_expiring_state`` holds, read from its checkpoint."""
    return (
        spark.read.format("statestore").option("stateVarName", HELD).load(checkpoint)
        .select("user_map_key.*", "user_map_value.value.*")
    )
