"""Resolution of not-modified revisit records in web archives.

A revisit stands for the latest earlier full response of the same canonical
URL. The as-of join is a carried-forward "last full response", in two levels,
so that a URL that holds a large share of the records isn't one task: within
slices of time each record looks back in its slice, and the last response of
earlier slices is carried over one row a slice. The slices are quantiles of a
sample, so that bursts and outlying times don't fill one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import slices

#: Headers that a not-modified response may update, and query
#: parameters that don't name another page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

SLICE_ROWS = 10_000  # records in a slice of time, on average over all URLs, up to slices.MOST of them


def canonical(url: Column) -> Column:
    """Canonical form of a URL: no scheme, "www." or default port, host in
    lower case, no fragment or trailing slash, parameters sorted and without
    those for tracking; null stays null."""
    plain = F.regexp_replace(F.regexp_replace(url, r"#[\s\S]*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1)), r"^www\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(plain, r"\?([\s\S]*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def merged(full: Column, revisit: Column) -> Column:
    """The full response's headers, updated by the permitted ones of the
    revisit; names in lower case, as sorted lines."""
    lower = lambda m: F.coalesce(F.transform_keys(m, lambda k, _: F.lower(k)), F.create_map().cast("map<string,string>"))
    updates = F.map_filter(lower(revisit), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(lower(full), lambda k, _: ~F.map_contains_key(updates, k))
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.map_concat(kept, updates))), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def validated(full: Column, revisit: Column) -> Column:
    """Outcome of checking the revisit's validators: entity tags (compared
    weakly) decide, then the time of the last change."""
    weak = lambda t: F.regexp_replace(t, "^W/", "")
    by_tag = weak(full["etag"]) == weak(revisit["etag"])
    by_time = full["last_modified"] == revisit["last_modified"]
    same = F.when(full["etag"].isNotNull() & revisit["etag"].isNotNull(), by_tag).otherwise(by_time)
    return F.when(full.isNull(), "no earlier response").when(same.isNull(), "no common validator").when(same, "resolved").otherwise("validator mismatch")


def resolve(records: DataFrame) -> DataFrame:
    """record_id, url_key, source_id, outcome, digest, headers: one row per
    revisit.

    ``records``: record_id, url, time (long), type ("response" for a full one,
    "revisit"), etag, last_modified (long), digest, headers (map). The source
    is the latest full response before the revisit by (time, record_id); its
    payload digest and the merged headers are given only if the outcome is
    "resolved". Records with a null url, time or type take no part, nor do
    records of other types. Of full responses that share time and id, the one
    with the largest digest counts; repeated revisits give repeated rows;
    further columns, whatever their names, play no part. An empty table gives
    no rows.
    """
    fields = ("record_id", "time", "etag", "last_modified", "digest", "headers")
    known = records.where("url is not null and time is not null and type in ('response', 'revisit')")
    points = slices.cuts(known, ("time", "record_id"), SLICE_ROWS)
    rows = known.select(canonical(F.col("url")).alias("url_key"), slices.slice_of(("time", "record_id"), points).alias("slice"), "type", F.struct(*fields).alias("r"))
    order = F.struct("r.time", "r.record_id", F.col("type") == "response", "r.digest")
    rows = rows.withColumns({"order": order, "full": F.when(F.col("type") == "response", F.col("r"))})

    inside = Window.partitionBy("url_key", "slice").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("full is not null").groupBy("url_key", "slice").agg(F.max_by("full", "order").alias("end"))
    # the slices without a response need what is carried over them, too
    spans = rows.select("url_key", "slice").distinct().join(ends, ["url_key", "slice"], "left")
    carried = spans.select("url_key", "slice", F.last("end", ignorenulls=True).over(before).alias("carried"))
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("type = 'revisit'").select("url_key", "slice", "r", "near")
    joined = near.join(carried, ["url_key", "slice"], "left").select("url_key", "r", F.coalesce("near", "carried").alias("full"))
    outcome = validated(F.col("full"), F.col("r"))
    done = outcome == "resolved"
    return joined.select(
        F.col("r.record_id").alias("record_id"),
        "url_key",
        F.col("full.record_id").alias("source_id"),
        outcome.alias("outcome"),
        F.when(done, F.col("full.digest")).alias("digest"),
        F.when(done, merged(F.col("full.headers"), F.col("r.headers"))).alias("headers"),
    )
