"""Human review: merges that keep decisions, candidates, revisions, queues; plain snapshot rewrites."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``new`` and those of ``old`` that it does not replace."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not there yet."""
    return new.dropDuplicates(keys).join(old, keys, "left_anti")


def merge_keep_review(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str], status: str = "status", pending: str = "pending") -> DataFrame:
    """``new`` replaces ``old``, but columns of a human decision stay where one was made."""
    was = old.select(*keys, F.col(status).alias("_status"), *[F.col(c).alias(f"_{c}") for c in kept if c != status])
    decided = F.col("_status").isNotNull() & (F.col("_status") != pending)
    merged = new.join(was, keys, "left")
    for c in kept:
        merged = merged.withColumn(c, F.when(decided, F.col(f"_{c}")).otherwise(F.col(c)))
    return upsert(old, merged.select(*old.columns), keys)


def add_candidate(alternatives: Column, candidate: Column) -> Column:
    """A set that keeps its order."""
    there = F.coalesce(alternatives, F.array().cast("array<string>"))
    return F.when(F.array_contains(there, candidate), there).otherwise(F.array_append(there, candidate))


def decision_status(illegible: Column, decision: Column) -> Column:
    return F.when(F.coalesce(illegible, F.lit(False)), "illegible").when(F.coalesce(F.trim(decision), F.lit("")) != "", "accepted").otherwise("pending")


def needs_review(confidence: Column, limit: float = 0.9) -> Column:
    return F.coalesce(confidence < limit, F.lit(False))


def queue_view(confidence: Column, corrected: Column) -> Column:
    """The views of the review queue that an item is in."""
    return F.array_compact(F.array(F.lit("all"), F.when(needs_review(confidence) & ~corrected, "needs_review"), F.when(corrected, "verified")))


def next_open(regions: DataFrame, by: list[str], order: str, open_: Column) -> DataFrame:
    """Per region the first other open one of its document, null where there is none. Two per document are enough to know."""
    first = F.slice(F.array_sort(F.collect_list(F.when(open_, F.col(order)))), 1, 2)
    two = regions.groupBy(*by).agg(first.alias("_two"))
    return regions.join(two, by).withColumn("next_open", F.get(F.filter("_two", lambda r: r != F.col(order)), F.lit(0))).drop("_two")


#: What the audit trail says was done.
EDITED, ILLEGIBLE, ACCEPTED = "Manual transcript edit", "Marked illegible", "Accepted alternative"


def audit_rows(edits: DataFrame, illegible: Column) -> DataFrame:
    """A row for every edit that was taken (see ``revision_fold``): what was done, by its number and revision. A null region is the whole transcript."""
    action = F.when(F.col("region").isNull(), EDITED).when(illegible, ILLEGIBLE).otherwise(ACCEPTED)
    return edits.where("accepted").select("doc", "seq", "revision", "region", action.alias("action"))


def session(documents: DataFrame, regions: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Per document its regions in order, its events, its revision, and whether all of its regions are decided; each side is aggregated before it is joined."""
    r = regions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("region", "status"))).alias("regions"), (F.count_if(F.col("status") == "pending") == 0).alias("reviewed"))
    e = events.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.max("revision").alias("revision"))
    return documents.join(r, key, "left").join(e, key, "left").withColumns({"reviewed": F.coalesce("reviewed", F.lit(False)), "events": F.coalesce("events", F.lit(0)), "revision": F.coalesce("revision", F.lit(0))})


STATE = "text string, reviewed boolean, corrections map<string,string>, preferences struct<reviewer:string,language:string>, events array<struct<id:string,action:string,detail:string,time:string>>"


def saved_state(raw: Column, regions: list[str], most_text: int = 100_000, most_correction: int = 100, most_events: int = 500) -> Column:
    """A saved workspace as far as it is valid, null if it is not: corrections of known regions, whole events, and reviewed only if every region is corrected."""
    s = F.from_json(raw, STATE)
    valid = s.isNotNull() & s["text"].isNotNull() & (F.length(s["text"]) <= most_text) & (F.trim(s["preferences"]["reviewer"]) != "") & s["corrections"].isNotNull() & s["events"].isNotNull()
    kept = F.map_filter(s["corrections"], lambda k, v: k.isin(*regions) & (F.trim(v) != "") & (F.length(v) <= most_correction))
    events = F.slice(F.filter(s["events"], lambda e: e.id.isNotNull() & e.action.isNotNull() & e.detail.isNotNull() & e.time.try_cast("timestamp").isNotNull()), 1, most_events)
    return F.when(valid, F.struct(kept.alias("corrections"), events.alias("events"), (F.coalesce(s["reviewed"], F.lit(False)) & (F.size(kept) == len(regions))).alias("reviewed")))


def candidate(text: Column, confidence: Column, provider: Column) -> Column:
    """A reading as stored: its confidence, and the score that stands for a calibrated one."""
    return F.struct(text.alias("text"), F.round(confidence, 4).alias("confidence"), F.round(confidence * 0.95, 4).alias("calibrated_score"), provider.alias("provider_id"))


def queue_counts(items: DataFrame, by: list[str]) -> DataFrame:
    """Items in all, open for review, and verified. Needs ``confidence`` and ``corrected``."""
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("all_items"), F.count_if(needs_review(F.col("confidence")) & ~F.col("corrected")).alias("open_items"), F.count_if("corrected").alias("verified_items"))


def unresolved(regions: DataFrame, by: list[str]) -> DataFrame:
    """Pending regions per document and whether it is complete; a document without regions is not."""
    pending = F.col("status") == "pending"
    return regions.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.when(pending, F.col("region").cast("string")))), ",").alias("unresolved"), ((F.count("region") > 0) & (F.count_if(pending) == 0)).alias("complete"))


def revision_fold(edits: DataFrame) -> DataFrame:
    """Edits (doc, seq, expected) in order: one is taken if it expects the revision of that moment, which it raises.

    Only the current document and its revision are carried from batch to batch, however many edits it has.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, revision = None, 0
        for batch in batches:
            docs, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            taken, now = [], []
            for d, expected in zip(docs, wanted):
                if d != doc:
                    doc, revision = d, 0
                taken.append(expected == revision)
                revision += taken[-1]
                now.append(revision)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(taken, pa.bool_()), pa.array(now, pa.int64())], names=["doc", "seq", "accepted", "revision"])

    rows = edits.select("doc", F.col("seq").cast("long"), F.col("expected").cast("long")).repartition("doc").sortWithinPartitions("doc", "seq")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("accepted", T.BooleanType()), T.StructField("revision", T.LongType())]))
