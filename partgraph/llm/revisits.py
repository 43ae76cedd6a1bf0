"""Not-modified revisits of a web archive, resolved to the response they stand for.

A revisit record holds the headers of a "304 Not Modified" answer and no body. It is joined as of its time to the
latest earlier full response of the same canonical URL; if both name an ETag they must agree (weakly), else if both
name Last-Modified those must, else the payload digests if both have one. Of the revisit's headers only those that a 304 may update replace
the response's.

The as-of step works on slim rows (URL, time, id), range-partitioned by the full order, so a URL with a third of all rows
spans many tasks; each task carries the latest response forward, and one row per task passes on what is open at its
end. Headers and payload are joined afterwards by record id, with large partitions split.

Records without URL, time or id can't be resolved: status ``invalid``. Ties in time go by record id; of records equal in all three the
full response counts as the earlier. Extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partgraph.llm.common import Scratch

# Headers that a 304 answer may update, and query parameters that name no other page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "utm_[a-z]+|gclid|fbclid|ref"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, default port, tracking parameter, or slash at the end; http as https."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z]+://([^/?]*)", 1))
    rest = F.regexp_replace(bare, "^[A-Za-z]+://[^/?]*", "")
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    asked = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.concat(F.lit("https://"), F.regexp_replace(host, r":(80|443)$", ""), F.regexp_replace(path, "/+$", ""), asked)


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The latest response of the URL so far, for each row of a sorted range."""
    url = response = None
    for batch in batches:
        out = []
        for row_url, is_response, record in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url_key", "is_response", "record_id"))):
            if row_url != url:
                url, response = row_url, None
            out.append(None if is_response else response)
            if is_response:
                response = record
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "carried"])


def latest_response(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Each revisit (record_id, mark) and the record_id of the latest earlier response to its URL, or null."""
    order = ["url_key", "time", "record_id", "is_revisit"]
    slim = records.select(
        canonical_url(F.col("url")).alias("url_key"), "time", F.col("record_id").cast("long").alias("record_id"), (F.col("kind") == "response").alias("is_response")
    ).withColumn("is_revisit", ~F.col("is_response"))
    usable = slim.where("url_key is not null and time is not null and record_id is not null and is_response is not null")
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = usable.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    carried = scratch.save(ranged.mapInArrow(_carry, schema + ", carried long").withColumn("part", F.spark_partition_id()), "carried")
    # one row per task: its last URL, and the last response to that, if the task holds one
    ends = carried.groupBy("part").agg(F.max("url_key").alias("last_url"))
    last = carried.where("is_response").groupBy("part", "url_key").agg(F.max_by("record_id", F.struct("time", "record_id")).alias("response"))
    open_ends = ends.join(last, (ends.part == last.part) & (ends.last_url == last.url_key), "left").select(ends.part, "last_url", "response")
    so_far = Window.partitionBy("last_url").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = carried.groupBy("part").agg(F.min("url_key").alias("first_url"))
    ranges = open_ends.withColumn("open", F.last("response", ignorenulls=True).over(so_far)).join(heads, "part")
    # a range may begin inside the URL that the one before it ended with; one row per range, so one task holds them
    line = Window.orderBy("part")
    handed = ranges.select("part", "first_url", F.lag("last_url").over(line).alias("url_before"), F.lag("open").over(line).alias("handed"))
    handed = handed.where("first_url = url_before").select(F.col("part").alias("to_part"), "first_url", "handed")
    revisits = carried.where("not is_response")
    # bounded by the number of ranges
    joined = revisits.join(F.broadcast(handed), (F.col("part") == F.col("to_part")) & (F.col("url_key") == F.col("first_url")), "left")
    return joined.select("record_id", record_mark(F.col("url_key"), F.col("time")).alias("mark"), F.coalesce("carried", "handed").alias("response_id"))


def record_mark(url_key: Column, time: Column) -> Column:
    """Tells the few records that share an id apart."""
    return F.hash(url_key, time)


def weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def header(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def merged(old: Column, new: Column) -> Column:
    """The response's headers with those of the revisit that a 304 may update."""
    allowed = F.map_filter(new, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per revisit: the response it stands for, ``status``, merged headers, payload.

    ``records``: record_id, kind ('response' or 'revisit'), url, time, headers (map with lower-case names), digest, payload.
    Of responses to one URL that share an id, the one with the latest time counts. Status: ``resolved``, ``mismatch`` (validators disagree: no payload), ``missing`` (no earlier response), ``invalid``.
    """
    none = F.create_map().cast("map<string,string>")
    url_key = canonical_url(F.col("url"))
    full = records.select(
        F.col("record_id").cast("long").alias("record_id"), "kind", "url", "time", F.coalesce("headers", none).alias("headers"), "digest", "payload",
        record_mark(url_key, F.col("time")).alias("mark"),
        # of the canonical URL; rows that have none are dealt out, for they have no response
        F.coalesce(F.when(url_key.isNotNull(), F.hash(url_key)), F.hash("record_id", "url", "time")).alias("url_mark"),
    )
    revisits = full.where("kind = 'revisit'").drop("payload", "kind")
    responses = full.where("kind = 'response' and record_id is not null").select(
        F.col("record_id").alias("response_id"), "url_mark", F.col("headers").alias("old"), F.col("digest").alias("old_digest"), "payload", F.col("time").alias("old_time")
    )
    # an id alone does not name a record: an id may repeat with another URL or time
    matched = latest_response(records, scratch).groupBy("record_id", "mark").agg(F.max("response_id").alias("response_id"))
    matched = scratch.save(matched, "matched")
    scratch.drop("carried")  # all that is needed of it is written
    latest = Window.partitionBy("response_id", "url_mark").orderBy(F.desc("old_time"), "old_digest", F.xxhash64("payload"))
    responses = responses.withColumn("nth", F.row_number().over(latest)).where("nth = 1").drop("nth", "old_time")
    # revisits without a response are spread by their URL; by the response alone, null would bring them together
    rows = revisits.join(matched, ["record_id", "mark"], "left").drop("mark").join(responses, ["response_id", "url_mark"], "left")
    agree = F.coalesce(
        weak(header(F.col("headers"), "etag")) == weak(header(F.col("old"), "etag")),
        header(F.col("headers"), "last-modified") == header(F.col("old"), "last-modified"),
        F.col("digest") == F.col("old_digest"),
        F.lit(True),
    )
    unusable = F.col("record_id").isNull() | F.col("url").isNull() | F.col("time").isNull()
    status = (
        F.when(unusable, "invalid").when(F.col("response_id").isNull(), "missing").when(agree, "resolved").otherwise("mismatch")
    )
    good = F.col("status") == "resolved"
    return rows.withColumn("status", status).select(
        "record_id", "url", "time", "response_id", "status",
        F.when(good, merged(F.col("old"), F.col("headers"))).alias("headers"), F.when(good, F.col("payload")).alias("payload"),
    )
