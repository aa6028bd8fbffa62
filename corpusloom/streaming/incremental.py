"""Incremental forms of operators that keep no state beyond what is given here."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.scalars import clean_text, normalize_url
from corpusloom.operators.extract import actions


def new_urls(hits: DataFrame, delay: str = "1 day", time: str = "seen_at") -> DataFrame:
    """Hits of a stream whose address wasn't seen within `delay`; older state is dropped by the watermark."""
    keyed = hits.withColumn("url", normalize_url("url")).where("url <> ''")
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def action_counts_by_time(docs: DataFrame, window: str = "1 hour", delay: str = "1 day", time: str = "seen_at") -> DataFrame:
    """`start, type, cnt` of actions in tumbling windows; late documents count until the watermark passes."""
    found = actions(docs.withColumn("key", F.struct("doc_id", time)), "key")
    timed = found.select(F.col(f"doc_id.{time}").alias(time), "type").withWatermark(time, delay)
    return timed.groupBy(F.window(time, window).alias("w"), "type").agg(F.count("*").alias("cnt")).select("w.start", "type", "cnt")


def append_log(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends cleaned records to a JSON log, each once."""
    return records.withColumn("text", clean_text("text")).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
