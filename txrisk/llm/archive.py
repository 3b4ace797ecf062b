"""Pages as WARC records, repeated payloads as revisits, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.frames import store
from txrisk.llm.warc import read_warc

#: Shorter payloads are always written in full.
LEAST_BYTES = 100
PREFIX = "<urn:page:"
DATE = "2000-01-01T00:00:00Z"


def page_records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html).

    Of equal payloads of at least ``least_bytes`` bytes the smallest page_id is the response, others
    revisit it. Null html is an empty payload. Rows that repeat the smallest id and its payload are
    responses too; a row without an id revisits, or is a response if no row of its payload has an id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes")
    )
    first = (
        rows.filter(F.col("bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select("digest", "first")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit(PREFIX), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return rows.join(first, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def pages_in(spark: SparkSession, path: str) -> DataFrame:
    """Per record below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured by the payload that the archive holds; of revisits only headers are read,
    and they are joined to the response they refer to.
    """
    urn = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    held = store(
        read_warc(spark, path)
        .filter("record_type = 'response'")
        .select(
            urn("record_id").alias("page_id"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        ),
        "responses",
    )
    revisits = (
        read_warc(spark, path, payload=False)
        .filter("record_type = 'revisit'")
        .select(urn("record_id").alias("page_id"), urn("refers_to").alias("refers_to"))
    )
    source = held.filter(F.col("payload_bytes") >= LEAST_BYTES).dropDuplicates(["page_id", "payload_digest"])
    resolved = revisits.join(source.withColumnRenamed("page_id", "refers_to"), "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (
        held.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
        .select(columns)
        .unionByName(resolved.withColumn("record_type", F.lit("revisit")).select(columns))
    )
