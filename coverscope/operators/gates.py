"""Three-way join of events, mentions and documents under explicit gates, with counters of what falls out where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.schemas import Gates


def last_of_event(events: DataFrame) -> DataFrame:
    """Of repeated events the last one."""
    kept = [c for c in events.columns if c != "event_id"]
    return events.groupBy("event_id").agg(F.max_by(F.struct(*kept), "ord").alias("e")).select("event_id", "e.*")


def eligible_mentions(mentions: DataFrame, events: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Mentions that pass the gates, of events with a place: of each event and document the surest, then latest, then first.

    key_ord is the place of the pair's first eligible mention.
    """
    # Whether the last of an event has a place, and no more of it, so that it is summed by hash and what is shuffled is narrow.
    located = events.groupBy("event_id").agg(F.max_by(F.col("geo").isNotNull(), "ord").alias("located")).where("located").select("event_id")
    passed = mentions.where((F.col("mention_type") == gates.mention_type) & (F.col("in_raw_text") == gates.in_raw_text) & (F.col("confidence") >= gates.minimum_confidence))
    return deduplicated_mentions(passed.join(located, "event_id", "left_semi"))


def deduplicated_mentions(mentions: DataFrame) -> DataFrame:
    kept = [c for c in mentions.columns if c not in ("event_id", "identifier")]
    order = F.struct((-F.col("confidence")).alias("a"), (-F.unix_micros(F.col("mention_time").cast("timestamp"))).alias("b"), F.col("ord").alias("c"))
    best = mentions.groupBy("event_id", "identifier").agg(F.min_by(F.struct(*kept), order).alias("m"), F.min("ord").alias("key_ord"))
    return best.select("event_id", "identifier", *[F.col(f"m.{c}").alias(c) for c in kept], "key_ord")


def folded_documents(documents: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """One record of each document, by an ordered fold: the next record replaces the one held if it has a title and that has none, or if it is later.

    A later record without a title can replace one with a title, so this is no maximum. A document's records are as many as a batch repeats it.
    """
    fields = [c for c in documents.columns if c != "document_id"]
    own = documents.where(F.col("collection") == gates.collection) if "collection" in documents.columns else documents
    record = F.struct(F.col("ord").alias("_o"), *[F.col(c) for c in fields])
    sequence = own.groupBy("document_id").agg(F.array_sort(F.collect_list(record)).alias("s"))
    held = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.element_at("s", 1), lambda old, new: F.when(_replaces(old, new), new).otherwise(old))
    return sequence.select("document_id", held.alias("d")).select("document_id", *[F.col(f"d.{c}").alias(c) for c in fields])


def _replaces(old: Column, new: Column) -> Column:
    return (new["title"].isNotNull() & old["title"].isNull()) | (new["published_at"] > old["published_at"])


def joined_documents(eligible: DataFrame, documents: DataFrame) -> DataFrame:
    """Every eligible mention with its document or nulls, and outcome: joined, without_document, without_title."""
    titled = documents.select(F.col("document_id").alias("identifier"), *[F.col(c).alias(f"doc_{c}") for c in documents.columns if c != "document_id"], F.lit(True).alias("_found"))
    out = eligible.join(titled, "identifier", "left")
    outcome = F.when(F.col("_found").isNull(), "without_document").when(F.col("doc_title").isNull(), "without_title").otherwise("joined")
    return out.withColumn("outcome", outcome).drop("_found")


def gate_counters(joined: DataFrame) -> DataFrame:
    """One row: how many mentions were eligible, were joined, and fell out for want of a document or a title."""
    return joined.agg(F.count(F.lit(1)).alias("eligible"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("joined", "without_document", "without_title")])


def needed_documents(documents: DataFrame, eligible: DataFrame) -> DataFrame:
    """Only the documents that an eligible mention names."""
    return documents.join(eligible.select(F.col("identifier").alias("document_id")).distinct(), "document_id", "left_semi")
