"""Archive records derived from the given pages: each is fetched once or more, later visits may find it unchanged.

Everything follows from page_id by arithmetic, so SQL can make the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Visits of each page; visit 0 is the first response.
VISITS = 6


def crawl_records(pages: DataFrame) -> DataFrame:
    """record_id, kind, url, time, headers, digest and payload of every visit.

    Visit v of page p is full if v = 3 and 5 divides p, and before that unless 7 divides p (no response yet) for v = 0; other visits are
    revisits. The page's version is 2 from visit 3 on where 5 divides p. Where 11 divides p, revisits name a wrong ETag.
    """
    p, v = F.col("page_id"), F.col("visit")
    visits = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.explode(F.sequence(F.lit(0), F.lit(VISITS - 1))).alias("visit"))
    full = ((v == 0) & (p % 7 != 0)) | ((v == 1) & (p % 7 == 0)) | ((v == 3) & (p % 5 == 0))
    version = F.when((v >= 3) & (p % 5 == 0), 2).otherwise(1)
    tag = F.concat(F.lit('"'), p, F.lit("-"), F.when((p % 11 == 0) & ~full, 9).otherwise(version), F.lit('"'))
    headers = F.create_map(
        F.lit("etag"), F.when(full, tag).otherwise(F.concat(F.lit("W/"), tag)),
        F.lit("date"), F.concat(F.lit("day "), v),
        F.lit("server"), F.when(full, "origin").otherwise("edge"),
    )
    return visits.select(
        (p * VISITS + v).alias("record_id"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        F.when(v % 2 == 1, F.concat("url", F.lit("#again"))).otherwise(F.col("url")).alias("url"),
        (v * 86400 + p % 86400).alias("time"),
        headers.alias("headers"),
        F.md5(F.concat("html", F.lit("|"), version)).alias("digest"),
        F.when(full, F.concat("html", F.lit("|"), version)).alias("payload"),
    )
