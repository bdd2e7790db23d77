"""Review decisions on a stream: keyed state, the latest decision of each entity (V1, V2, D-19).

State is kept per document: the latest decision of each entity and the latest
action on all.  These are maxima, so a decision that comes late or twice merges
as if it had come in order; the watermark only says when a document without
decisions is dropped from the state and a decision is too late to be counted.
Every change gives the document's whole registers, so the sink keeps the newest
row of a document, and ``operators.review`` reads them as it reads a batch's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import vocab
from ..session import shared_dir

DECISIONS = "doc_id bigint, seq int, action string, decided_at timestamp, event_id bigint"
# (time in microseconds, event): -1 where there is none.
_STATE = "seqs array<int>, ats array<bigint>, events array<bigint>, statuses array<string>, removed array<bigint>, accepted array<bigint>, version bigint"
_OUT = "doc_id bigint, version bigint, seqs array<int>, ats array<bigint>, events array<bigint>, statuses array<string>, removed array<bigint>, accepted array<bigint>"
_NEVER = (-1 << 62, -1)


def merge_decisions(own: dict, removed: tuple, accepted: tuple, rows) -> tuple[dict, tuple, tuple]:
    """Registers after ``rows`` (seq, action, micros, event_id); in any order, any number of times."""
    for seq, action, at, event in rows:
        when = (at, event)
        if action == "remove_all":
            removed = max(removed, when)
        elif action == "accept_all":
            accepted = max(accepted, when)
        elif action in vocab.REVIEW_STATUSES and seq is not None:
            own[seq] = max(own.get(seq, (*_NEVER, "")), (*when, action))
    return own, removed, accepted


def latest_decisions(stream: DataFrame, late: str = "1 day", idle: str = "30 days") -> DataFrame:
    """The registers of each document a decision changed, newest ``version`` last.

    Decisions more than ``late`` behind the newest seen may be dropped; a document
    without one for ``idle`` (event time) leaves the state."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own, removed, accepted, version = {}, _NEVER, _NEVER, 0
        if state.exists:
            seqs, ats, events, statuses, removed, accepted, version = state.get
            own = {s: (a, e, x) for s, a, e, x in zip(seqs, ats, events, statuses)}
            removed, accepted = tuple(removed), tuple(accepted)
        newest = 0
        for part in parts:
            micros = part["decided_at"].astype("datetime64[us]").astype("int64").tolist()
            newest = max([newest, *micros])
            seqs = [None if pd.isna(s) else int(s) for s in part["seq"]]
            own, removed, accepted = merge_decisions(own, removed, accepted, zip(seqs, part["action"], micros, part["event_id"].tolist()))
        order = sorted(own)
        now = (order, [own[s][0] for s in order], [own[s][1] for s in order], [own[s][2] for s in order], list(removed), list(accepted), version + 1)
        state.update(now)
        state.setTimeoutTimestamp(max(newest // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"doc_id": [key[0]], "version": [version + 1], "seqs": [now[0]], "ats": [now[1]], "events": [now[2]], "statuses": [now[3]],
                            "removed": [now[4]], "accepted": [now[5]]})

    known = stream.where("doc_id is not null and decided_at is not null").withWatermark("decided_at", late)
    return known.groupBy("doc_id").applyInPandasWithState(update, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def registers(updates: DataFrame) -> DataFrame:
    """The newest registers of each document, in the form of ``review.decision_registers``."""
    newest = updates.groupBy("doc_id").agg(F.max_by(F.struct("seqs", "ats", "events", "statuses", "removed", "accepted"), "version").alias("r")).select("doc_id", "r.*")
    when = lambda c: F.when(F.get(c, F.lit(1)) >= 0, F.struct(F.timestamp_micros(F.get(c, F.lit(0))).alias("at"), F.get(c, F.lit(1)).alias("event_id")))
    own = F.transform(F.arrays_zip("seqs", "ats", "events", "statuses"), lambda x: F.struct(
        x["seqs"].alias("seq"), F.timestamp_micros(x["ats"]).alias("at"), x["events"].alias("event_id"), x["statuses"].alias("status")))
    return newest.select("doc_id", own.alias("own"), when(F.col("removed")).alias("removed_at"), when(F.col("accepted")).alias("accepted_at"))


def start(spark: SparkSession, source_dir: str, sink_dir: str, name: str, late: str = "1 day", idle: str = "30 days", files: int = 64, available_now: bool = True):
    """Decisions as Parquet files in ``source_dir`` to register rows in ``sink_dir``.

    ``name`` tells this stream's checkpoint, in the shared folder, from others'.
    A batch that is run again writes its own folder again, so no row doubles."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={number}")

    stream = spark.readStream.schema(DECISIONS).option("maxFilesPerTrigger", files).parquet(source_dir)
    query = latest_decisions(stream, late, idle).writeStream.outputMode("update").option("checkpointLocation", shared_dir(spark, f"review-{name}")).foreachBatch(write)
    query = query.trigger(availableNow=True) if available_now else query.trigger(processingTime="30 seconds")
    return query.start()
