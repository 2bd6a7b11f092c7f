"""WARC not-modified revisits: as-of join by canonical URL to the latest earlier full response.

A revisit (status 304) has no body; the one it stands for is in the latest full response (status 200) of the same
canonical URL captured before it. Its validators must agree, and the headers that a 304 may update are merged over the
stored ones. Only narrow columns are ordered: time is cut into ``slices`` by quantiles, each (URL, slice) is ordered
for itself, and what earlier slices left comes from one row per URL and slice. So a URL with a third of all captures
is ordered in ``slices`` tasks. Bodies are joined by record id, and only if asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import stored

#: Header fields of a 304 that replace those of the stored response; all others keep the stored value.
UPDATABLE = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that only track where a visitor came from.
TRACKING = r"(?i)^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, ``www.`` and default port, path without a last slash, parameters sorted and
    without tracking ones, no fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^(?i)[a-z][a-z0-9+.-]*://", "")
    place = F.split_part(bare, F.lit("?"), F.lit(1))
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_replace(F.lower(F.split_part(place, F.lit("/"), F.lit(1))), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(/.*)$", 1), r"/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the last."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def resolve_revisits(
    records: DataFrame, *, record_id: str = "record_id", url: str = "url", captured_at: str = "captured_at", status: str = "status", headers: str = "headers",
    payload: str | None = None, slices: int | None = None,
) -> DataFrame:
    """One row per revisit: record_id, canonical_url, outcome, resolved_id, headers (map, names in lower case), and
    with ``payload`` the body of the response it resolves to.

    Outcomes: resolved; ``no_earlier_response``; ``etag_mismatch`` and ``last_modified_mismatch``, if both sides have
    the field and it differs (entity tags compare weakly, and decide alone if both have one); ``no_validator``, if
    neither field is on both sides. All but the first have a null resolved_id and the revisit's own headers.

    Earlier is strictly so; of responses at one time the largest id counts. Records with null URL or time resolve to
    nothing; other statuses than 200 and 304, and null, are left out. Repeated revisits give repeated rows; repeated
    responses count once (of bodies of one record id the smallest). ``slices``: by default one for each 500,000
    captures, 32 at least. Null headers are none; an empty table gives an empty one. Other columns are left out.
    """
    base = records.where(F.col(status).isin(200, 304)).select(
        F.col(record_id).alias("record_id"), canonical_url(F.col(url)).alias("canonical_url"), F.col(captured_at).alias("at"),
        (F.col(status) == 200).alias("full"), _lowered(F.col(headers)).alias("headers"),
    )
    known = base.where(F.col("canonical_url").isNotNull() & F.col("at").isNotNull())
    slices = slices or max(32, known.count() // 500_000)
    cuts = known.select(F.percentile_approx(F.col("at").cast("double"), [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    of_slice = F.size(F.filter(bounds, lambda b: b < F.col("at").cast("double")))
    response = F.when(F.col("full"), F.struct("at", "record_id", "headers"))
    sliced = stored(known.withColumn("slice", of_slice).withColumn("response", response), "captures")

    per_slice = sliced.where("full").groupBy("canonical_url", "slice").agg(F.max_by("response", F.struct("at", "record_id")).alias("latest"))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per slice at most
    # a slice without full responses needs what came before it too
    wanted = sliced.select("canonical_url", "slice").distinct().join(per_slice, ["canonical_url", "slice"], "left")
    carried = wanted.select("canonical_url", F.col("slice").alias("slice"), F.last("latest", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("canonical_url", "slice").orderBy("at", "full", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sliced.withColumn("found", F.last("response", ignorenulls=True).over(inside)).where(~F.col("full"))
    asof = seen.join(carried, ["canonical_url", "slice"], "left").withColumn("found", F.coalesce("found", "carried")).select("record_id", "canonical_url", "headers", "found")
    lost = base.where(~F.col("full") & (F.col("canonical_url").isNull() | F.col("at").isNull())).select("record_id", "canonical_url", "headers", F.lit(None).cast(asof.schema["found"].dataType).alias("found"))
    asof = asof.unionByName(lost)

    field = lambda of, name: F.try_element_at(of, F.lit(name))
    tag = lambda of: F.regexp_replace(field(of, "etag"), r"^W/", "")
    own, old = F.col("headers"), F.col("found.headers")
    same_tag, same_date = tag(own) == tag(old), field(own, "last-modified") == field(old, "last-modified")
    outcome = (
        F.when(F.col("found").isNull(), "no_earlier_response")
        .when(same_tag, "resolved")
        .when(~same_tag, "etag_mismatch")
        .when(same_date, "resolved")
        .when(~same_date, "last_modified_mismatch")
        .otherwise("no_validator")
    )
    updates = F.map_filter(own, lambda k, v: k.isin(*UPDATABLE))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    out = asof.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "outcome", F.when(F.col("outcome") == "resolved", F.col("found.record_id")).alias("resolved_id"),
        F.when(F.col("outcome") == "resolved", F.map_concat(kept, updates)).otherwise(own).alias("headers"),
    )
    if payload is None:
        return out
    bodies = records.where(F.col(status) == 200).select(F.col(record_id).alias("resolved_id"), F.col(payload).alias("payload"))
    one = bodies.groupBy("resolved_id").agg(F.min("payload").alias("payload"))  # repeated responses are one body
    return out.join(one, "resolved_id", "left").select(*out.columns, "payload")
