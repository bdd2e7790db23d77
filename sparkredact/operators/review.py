"""Review decisions on entities, and the mapping written back into them (V1, V2, B12, B15, D-19).

A decision accepts, removes or restores one entity, or acts on all of a
document: ``accept_all`` (what isn't removed) and ``remove_all``.  What counts in
the end is, per entity, the last decision or ``remove_all`` that set its status
outright, and whether an ``accept_all`` came after it.  So a document's state is
a few latest times, which merge in any order: late and repeated decisions need
no replay, in a batch or on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.binding import let
from .redact import running_numbers

REGISTERS = "array<struct<seq: int, at: timestamp, event_id: bigint, status: string>>"


def decision_registers(decisions: DataFrame) -> DataFrame:
    """Per document: ``own`` (the latest decision of each entity), ``removed_at``
    and ``accepted_at`` (the latest of the actions on all), as (time, event) pairs.

    ``decisions`` (doc_id, seq, action, decided_at, event_id); decisions without a
    document, a time or a known action are left out."""
    when = F.struct(F.col("decided_at").cast("timestamp").alias("at"), F.col("event_id").cast("bigint").alias("event_id"))
    known = decisions.where("doc_id is not null and decided_at is not null").withColumn("seq", F.when(F.col("action").isin(vocab.REVIEW_STATUSES), F.col("seq")))
    known = known.where(F.col("seq").isNotNull() | F.col("action").isin("accept_all", "remove_all"))
    latest = known.groupBy("doc_id", "seq").agg(
        F.max(F.struct(when.alias("when"), F.col("action").alias("status"))).alias("own"),
        F.max(F.when(F.col("action") == "remove_all", when)).alias("removed_at"), F.max(F.when(F.col("action") == "accept_all", when)).alias("accepted_at"))
    entry = F.struct(F.col("seq").cast("int").alias("seq"), F.col("own.when.at").alias("at"), F.col("own.when.event_id").alias("event_id"), F.col("own.status").alias("status"))
    return latest.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("seq").isNotNull(), entry))).alias("own"), F.max("removed_at").alias("removed_at"), F.max("accepted_at").alias("accepted_at"))


def status_of(seq: Column, own: Column, removed_at: Column, accepted_at: Column) -> Column:
    """The status of entity ``seq`` under a document's registers."""
    mine = F.get(F.filter(own, lambda d: d["seq"] == seq), F.lit(0))

    def settled(d):
        when = F.when(d.isNotNull(), F.struct(d["at"].alias("at"), d["event_id"].alias("event_id")))
        wiped = removed_at.isNotNull() & (when.isNull() | (removed_at > when))
        status = F.when(wiped, F.lit("removed")).otherwise(F.coalesce(d["status"], F.lit(vocab.DEFAULT_REVIEW_STATUS)))
        since = F.when(wiped, removed_at).otherwise(when)
        return F.when((status != "removed") & accepted_at.isNotNull() & (since.isNull() | (accepted_at > since)), F.lit("accepted")).otherwise(status)

    return let(mine, settled)


def reviewed(rows: DataFrame, registers: DataFrame, ents_col: str = "ents") -> DataFrame:
    """``rows`` with ``statuses``, the status of each entity of ``ents_col``, in its order."""
    joined = rows.join(registers, "doc_id", "left")
    state = F.struct(F.col(ents_col).alias("ents"), F.coalesce("own", F.array().cast(REGISTERS)).alias("own"), F.col("removed_at").alias("r"), F.col("accepted_at").alias("a"))
    statuses = let(state, lambda s: F.transform(s["ents"], lambda e: status_of(e["seq"], s["own"], s["r"], s["a"])))
    return joined.withColumn("statuses", statuses).drop("own", "removed_at", "accepted_at")


def accepted(ents: Column, statuses: Column) -> Column:
    """The entities that are substituted."""
    both = F.struct(ents.alias("ents"), statuses.alias("statuses"))
    return let(both, lambda b: F.filter(b["ents"], lambda e, i: F.get(b["statuses"], i) == "accepted"))


def default_placeholders(ents: Column, proposed: Column) -> Column:
    """The proposed placeholder of each entity, or ``[TYPE_n]`` where none was;
    n counts the entities without a proposal under the same label."""
    filled = lambda c: F.nullif(c, F.lit(""))
    label = lambda e: F.upper(F.coalesce(filled(e["entity_type"]), filled(e["category"]), F.lit("entita")))
    labels = lambda b: F.transform(b["ents"], lambda e, i: F.when(filled(F.get(b["proposed"], i)).isNull(), label(e)))
    shown = lambda b, names, n: F.transform(b["proposed"], lambda p, i: F.coalesce(
        filled(p), F.concat(F.lit("["), F.get(names, i), F.lit("_"), F.get(n, i).cast("string"), F.lit("]"))))
    return let(F.struct(ents.alias("ents"), proposed.alias("proposed")), lambda b: let(labels(b), lambda names: let(
        running_numbers(names), lambda n: shown(b, names, n))))


def write_back(ents: Column, shown: Column, mappings: Column) -> Column:
    """D-19: after the redaction, an entity whose value was replaced takes the real
    replacement and, where the mapping has one, its role; of several mappings of
    a value the last holds.  The result has original, substitution, semantic_role."""
    def row(b, e, i):
        hits = F.filter(b["maps"], lambda m: m["original"] == e["value"])
        return let(F.get(hits, F.size(hits) - 1), lambda m: F.struct(
            e["seq"].alias("seq"), e["value"].alias("original"), F.coalesce(m["replacement"], F.get(b["shown"], i)).alias("substitution"),
            F.coalesce(F.nullif(m["semantic_role"], F.lit("")), e["semantic_role"]).alias("semantic_role")))
    return let(F.struct(ents.alias("ents"), shown.alias("shown"), mappings.alias("maps")), lambda b: F.transform(b["ents"], lambda e, i: row(b, e, i)))
