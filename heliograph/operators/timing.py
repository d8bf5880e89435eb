"""Transport timing: declared dates, hop chains and replies held against thresholds.

Input is one row a mail with ``scope, uid, message_id, raw_sha256, date,
received, parent_uid`` (``received`` in header order, so the last element is
the first hop).  A time without a zone is no evidence: it compares with
nothing and is reported as a note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.dates import instant_us
from heliograph.lineage import keep
from heliograph.operators.gate import numbered, text_id
from heliograph.operators.ranking import block_of

FINDING_TYPES = ("client_clock_skew", "abnormal_transit", "hop_time_inversion", "reply_before_parent", "chain_mismatch")
THRESHOLDS = {"clock_skew_seconds": 120, "max_transit_seconds": 300}
MAX_THRESHOLD = 604_800

_COMMON = "scope, type, time_us, node_uids, message_ids, phase, lead_uid, rank, pos, value_us, direction, hop_from, hop_to, detail"


def thresholds(given: dict | None = None) -> dict[str, int]:
    """Defaults with what is given; unknown names, other types and values out of range are refused."""
    out = dict(THRESHOLDS)
    for name, value in (given or {}).items():
        if name not in THRESHOLDS:
            raise ValueError(f"unknown threshold: {name}")
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= MAX_THRESHOLD:
            raise ValueError(f"{name} must be an integer from 0 to {MAX_THRESHOLD}")
        out[name] = value
    return out


def timed(mails: DataFrame) -> DataFrame:
    """``mails`` with ``date_us``, ``hops`` in path order as (index, time_us, ...), ``first_hop_us`` and ``issue_hops``; as they are if they have these."""
    if {"date_us", "hops", "first_hop_us", "issue_hops"} <= set(mails.columns):
        return mails
    hops = F.transform(F.reverse(F.coalesce("received", F.expr("array()"))), lambda h: F.struct(h["index"].alias("index"), h["by_host"].alias("by_host"), h["time_utc"].alias("time_utc"), instant_us(h["time_utc"]).alias("time_us")))
    issues = F.size(F.filter(F.coalesce("received", F.expr("array()")), lambda h: F.size(F.coalesce(h["issues"], F.array().cast("array<string>"))) > 0)).cast("long")
    out = mails.withColumn("date_us", instant_us(F.col("date"))).withColumn("hops", hops).withColumn("issue_hops", issues)
    return out.withColumn("first_hop_us", F.when(F.size("hops") > 0, F.col("hops")[0]["time_us"]))


def slim(mails: DataFrame, scope: str = "scope") -> DataFrame:
    """What findings of single mails and replies and the timeline need of timed mails: no digests, hosts or original texts."""
    hops = F.transform("hops", lambda h: F.struct(h["index"].alias("index"), h["time_utc"].alias("time_utc"), h["time_us"].alias("time_us")))
    return timed(mails).select(scope, "uid", "message_id", "date", "parent_uid", "date_us", hops.alias("hops"), "first_hop_us", "issue_hops")


def ids_of_several_contents(mails: DataFrame, scope: str = "scope") -> DataFrame:
    """Hashes of (scope, message_id) that mails of different bytes share, from numbers alone; others can have no mismatch.

    Different ids that share a hash only make the list longer.
    """
    marks = [F.xxhash64(F.lit(i), F.coalesce("raw_sha256", F.lit(""))).alias(f"__mark{i}") for i in (0, 1)]
    ids = mails.where("message_id <> ''").select(F.xxhash64(scope, "message_id").alias("__id"), *marks)
    ends = ids.groupBy("__id").agg(*[f(f"__mark{i}").alias(f"__{n}{i}") for i in (0, 1) for n, f in (("least", F.min), ("most", F.max))])
    return ends.where("__least0 <> __most0 OR __least1 <> __most1").select("__id")


def _ids(*columns: str) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != ""))


def _rows(df: DataFrame, scope: str, kind: Column | str, phase: int, rank: int, **given: Column) -> DataFrame:
    null = {"time_us": "bigint", "value_us": "bigint", "direction": "string", "hop_from": "int", "hop_to": "int", "detail": "string"}
    values = {k: F.lit(None).cast(t) for k, t in null.items()} | {"pos": F.lit(0), "lead_uid": F.col("uid")} | given
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.col(scope).alias("scope"), kind.alias("type"), F.lit(phase).alias("phase"), F.lit(rank).alias("rank"), *[v.alias(k) for k, v in values.items()])


def clock_skew(t: DataFrame, scope: str, limit: int) -> DataFrame:
    """First hop against the declared date; only a difference beyond the limit counts."""
    skew = F.col("first_hop_us") - F.col("date_us")
    found = t.where(F.abs(skew) > limit * 1_000_000)
    return _rows(
        found, scope, "client_clock_skew", 0, 0, time_us=F.col("date_us"), node_uids=F.array("uid"), message_ids=_ids("message_id"), value_us=skew, direction=F.when(skew > 0, "client_behind").otherwise("client_ahead")
    )


def hop_gaps(t: DataFrame, scope: str) -> DataFrame:
    """Adjacent hops in path order; a hop without a time breaks the pair and is never bridged."""
    pairs = t.where(F.size("hops") > 1).select(scope, "uid", "message_id", F.posexplode(F.arrays_zip(F.slice("hops", 1, F.size("hops") - 1).alias("a"), F.slice("hops", 2, F.size("hops") - 1).alias("b"))).alias("pos", "pair"))
    gap = F.col("pair.b.time_us") - F.col("pair.a.time_us")
    return pairs.select(
        scope, "uid", "message_id", "pos", F.col("pair.a.index").alias("from_index"), F.col("pair.b.index").alias("to_index"), F.col("pair.a.time_us").alias("from_us"), F.col("pair.b.time_us").alias("to_us"), gap.alias("gap_us")
    ).where("gap_us IS NOT NULL")


def hop_findings(t: DataFrame, scope: str, limit: int) -> DataFrame:
    found = hop_gaps(t, scope).where((F.col("gap_us") < 0) | (F.col("gap_us") > limit * 1_000_000))
    kind = F.when(F.col("gap_us") < 0, "hop_time_inversion").otherwise("abnormal_transit")
    return _rows(
        found, scope, kind, 0, 1, time_us=F.col("from_us"), node_uids=F.array("uid"), message_ids=_ids("message_id"), value_us=F.col("gap_us"), pos=F.col("pos"), hop_from=F.col("from_index").cast("int"), hop_to=F.col("to_index").cast("int")
    )


def early_replies(t: DataFrame, scope: str, limit: int) -> DataFrame:
    """Replies dated before their parent by more than the tolerated skew."""
    up = t.select(scope, F.col("uid").alias("parent_uid"), F.col("message_id").alias("p_id"), F.col("date_us").alias("p_us")).where("p_us IS NOT NULL")
    found = t.where("date_us IS NOT NULL AND parent_uid IS NOT NULL").join(up, [scope, "parent_uid"]).withColumn("late", F.col("p_us") - F.col("date_us")).where(F.col("late") > limit * 1_000_000)
    return _rows(found, scope, "reply_before_parent", 0, 2, time_us=F.col("date_us"), node_uids=F.array("uid", "parent_uid"), message_ids=_ids("message_id", "p_id"), value_us=F.col("late"))


def chain_mismatches(t: DataFrame, scope: str) -> DataFrame:
    """Ids whose different contents took different hop chains, with up to five differences.

    The chain of a content is that of its first mail.  Chains of different
    length differ in their number of hops; else the positions are compared.
    """
    named = t.where("message_id <> ''")
    chain = F.transform(F.coalesce("received", F.expr("array()")), lambda h: F.struct(h["from_host"].alias("f"), h["by_host"].alias("b"), h["time_utc"].alias("t")))
    versions = named.groupBy(scope, "message_id", F.coalesce("raw_sha256", F.lit("")).alias("sha")).agg(F.min("uid").alias("first"), F.min_by(chain, "uid").alias("chain"), F.collect_list("uid").alias("uids"))
    groups = versions.groupBy(scope, "message_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chain").alias("chains"), F.array_sort(F.collect_list(F.struct("first", "chain"))).alias("v"), F.array_sort(F.flatten(F.collect_list("uids"))).alias("node_uids"))
    found = groups.where("n > 1 AND chains > 1")
    lengths = F.transform("v", lambda x: F.size(x["chain"]))
    size = F.size(F.col("v")[0]["chain"])

    def differs(i: Column) -> Column:
        cells = F.transform("v", lambda x: F.get(x["chain"], i))
        kind = lambda k: F.size(F.array_distinct(F.transform(cells, lambda c: F.coalesce(c[k], F.lit("\0"))))) > 1
        return F.when(kind("f"), F.concat(i.cast("string"), F.lit(":from_host"))).when(kind("b"), F.concat(i.cast("string"), F.lit(":by_host"))).when(kind("t"), F.concat(i.cast("string"), F.lit(":time")))

    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    per_place = F.slice(F.filter(F.transform(places, differs), lambda x: x.isNotNull()), 1, 5)
    detail = F.when(F.size(F.array_distinct(lengths)) > 1, F.concat(F.lit("hops:"), F.array_join(F.transform(lengths, lambda x: x.cast("string")), " vs "))).otherwise(F.array_join(per_place, "; "))
    found = found.withColumn("uid", F.col("node_uids")[0]).withColumn("detail", detail)
    return _rows(found, scope, "chain_mismatch", 1, 0, node_uids=F.col("node_uids"), message_ids=F.array("message_id"), detail=F.col("detail"), lead_uid=F.lit(0).cast("long"))


def findings(mails: DataFrame, scope: str = "scope", limits: dict | None = None, prepared: DataFrame | None = None, contents: DataFrame | None = None) -> DataFrame:
    """All findings, numbered: mails in uid order (skew, hops along the path, reply), then ids in order.

    ``prepared`` are the mails as ``slim`` gives them, where they were kept;
    ``contents`` are the mails without their hops (scope, message_id and
    raw_sha256), where these are read for less.  Hop chains are compared, and
    shuffled, only of ids that several contents share.
    """
    limit = thresholds(limits)
    t = timed(mails)
    single = t if prepared is None else prepared
    parts = [clock_skew(single, scope, limit["clock_skew_seconds"]), hop_findings(single, scope, limit["max_transit_seconds"]), early_replies(single, scope, limit["clock_skew_seconds"])]
    shared = keep(ids_of_several_contents(mails if contents is None else contents, scope), "shared-ids")
    if shared.limit(1).count():
        parts.append(chain_mismatches(t.withColumn("__id", F.xxhash64(scope, "message_id")).join(shared, "__id", "left_semi").drop("__id"), scope))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # only ids that follow all mails are in the order by their text
    lead_id = F.when(F.col("phase") == 1, F.get("message_ids", F.lit(0)))
    out = numbered(out.withColumn("lead_id", lead_id), "scope", "phase", "lead_uid", "rank", "pos", "lead_id", blocks=[F.col("phase"), block_of("lead_uid")], prefix="F")
    return out.withColumn("lead_id", F.get("message_ids", F.lit(0))).withColumn("status", F.lit("observed"))


def timeline(mails: DataFrame, found: DataFrame, scope: str = "scope") -> DataFrame:
    """One entry a mail: its time, what that rests on, and its findings; mails without a time come last.

    Findings meet their mails as numbers and places in ``FINDING_TYPES``, and
    mails as the columns of their entry; hops are not shuffled for it.
    """
    types = F.array(*[F.lit(k) for k in FINDING_TYPES])
    each = found.select(F.col("scope").alias(scope), F.explode("node_uids").alias("uid"), F.struct("seq", F.array_position(types, F.col("type")).cast("tinyint").alias("type")).alias("f"))
    per_mail = each.groupBy(scope, "uid").agg(F.array_sort(F.collect_list("f")).alias("f"))
    date_usable, hop_usable = F.col("date_us").isNotNull(), F.col("first_hop_us").isNotNull()
    note = F.when(F.coalesce("date", F.lit("")) == "", "date_missing").when(~date_usable, "date_without_zone")
    entries = timed(mails).select(
        scope, "uid", "message_id", "date", F.coalesce("date_us", "first_hop_us").alias("time_us"), F.when(date_usable, "date").when(hop_usable, "received").alias("time_basis"),
        F.when(date_usable, F.col("date")).when(hop_usable, F.col("hops")[0]["time_utc"]).alias("time"), F.size("hops").cast("long").alias("hop_count"), note.alias("date_note"), F.col("issue_hops").alias("hops_with_issues"),
    )
    out = entries.join(per_mail, [scope, "uid"], "left")
    of = lambda make: F.coalesce(F.transform("f", make), F.array().cast("array<string>"))
    return out.select(
        F.col(scope).alias("scope"), *[c for c in entries.columns if c != scope], of(lambda x: text_id("F", x["seq"])).alias("finding_ids"), of(lambda x: F.element_at(types, x["type"].cast("int"))).alias("finding_types")
    )


def timeline_order() -> list[Column]:
    return [F.col("time").isNull(), F.col("time"), F.col("uid")]


def stats(mails: DataFrame, found: DataFrame, scope: str = "scope") -> DataFrame:
    """Counts of each scope; every finding type is there, also those that are 0."""
    hops = F.size("hops")
    base = timed(mails).groupBy(F.col(scope).alias("scope")).agg(
        F.count(F.lit(1)).alias("emails"), F.count_if(hops > 0).alias("emails_with_received"), F.sum(hops.cast("long")).alias("hops_total"), F.sum("issue_hops").alias("hops_with_issues")
    )
    by = found.groupBy("scope").agg(F.count(F.lit(1)).alias("findings_total"), *[F.count_if(F.col("type") == k).alias(k) for k in FINDING_TYPES])
    out = base.join(by, "scope", "left")
    return out.select("scope", "emails", "emails_with_received", "hops_total", "hops_with_issues", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("findings_total", *FINDING_TYPES)])
