"""Attachment flow: multisets of attachments compared along reply edges.

Equal (name, bytes) cancel first; what is left with equal bytes is renamed,
then what is left with equal names has changed content, and the rest was
removed or added.  Attachments that could not be decoded take no part, and
what the other side lost or gained beside them is suppressed.

Pairing inside a group of equal bytes (or names) is by rank: the units of both
sides are laid out in order, and units of the same rank meet.  Units are rows
dealt by edge once; every later step groups or ranks inside that dealing, and
its work grows with the number of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.lineage import tasks_for
from heliograph.operators.gate import TASK_MAILS, gated, numbered
from heliograph.operators.ranking import block_of

EVENT_TYPES = ("added", "removed", "renamed", "content_changed")
REVIEW_KINDS = ("missing_parent", "reference_conflict", "undecodable_attachment")
#: Attachments of both sides that a task compares, about.
TASK_UNITS = 250_000


def _undecodable_issue(issue: Column) -> Column:
    """Issues that say an attachment's content is unusable (fixed phrases)."""
    return issue.startswith("附件") & issue.rlike("内容无法解码|传输解码失败|无法解码出可靠内容")


def split_attachments(mails: DataFrame) -> DataFrame:
    """Adds ``verifiable`` and ``undecodable`` arrays of (name, sha256, size), and ``legacy``.

    Without any marked attachment, an issue about undecodable content makes all
    attachments of the mail unusable, as it cannot be told which one is meant.
    """
    items = F.coalesce("attachments", F.expr("array()"))
    flagged = F.exists(items, lambda a: F.coalesce(a["undecodable"], F.lit(False)))
    legacy = ~flagged & F.exists(F.coalesce("issues", F.array().cast("array<string>")), lambda i: F.coalesce(_undecodable_issue(i), F.lit(False)))
    name = lambda a: F.coalesce(F.when(a["original_filename"] != "", a["original_filename"]), a["filename"])
    brief = lambda c: F.transform(c, lambda a: F.struct(name(a).alias("name"), a["sha256"].alias("sha256"), a["size"].cast("long").alias("size")))
    bad = lambda a: F.coalesce(a["undecodable"], F.lit(False))
    none = F.array().cast("array<struct<name:string,sha256:string,size:bigint>>")
    out = mails.withColumn("legacy", F.coalesce(legacy, F.lit(False)))
    out = out.withColumn("verifiable", F.coalesce(F.when(F.col("legacy"), none).otherwise(brief(F.filter("attachments", lambda a: ~bad(a)))), none))
    return out.withColumn("undecodable", F.coalesce(F.when(F.col("legacy"), brief(F.col("attachments"))).otherwise(brief(F.filter("attachments", bad))), none))


def prepare(mails: DataFrame, scope: str = "scope") -> DataFrame:
    return split_attachments(gated(mails, scope))


def _pairs(units: DataFrame, edge: list[str], by: str, other: str) -> DataFrame:
    """(edge, by, p, c): units of the parent and of the child with equal ``by`` and equal rank in the order of ``other``; one side is null where the other has no such rank."""
    rank = F.row_number().over(Window.partitionBy(*edge, "side", by).orderBy(other, "size"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct(F.col(other).alias("value"), "size"))).alias(s)
    return units.withColumn("rank", rank).groupBy(*edge, by, "rank").agg(side("p"), side("c")).drop("rank")


def _single(pairs: DataFrame, edge: list[str], by: str, other: str) -> DataFrame:
    """The units that met none, as rows again."""
    alone = pairs.where("p IS NULL OR c IS NULL").withColumn("u", F.coalesce("p", "c"))
    return alone.select(*edge, by, F.when(F.col("p").isNull(), "c").otherwise("p").alias("side"), F.col("u.value").alias(other), F.col("u.size").alias("size"))


def differences(prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """Events and suppressed notes of the compared edges, unnumbered.

    Columns: scope, uid, parent_uid, thread_root_uid, type, rank, filename,
    previous_filename, sha256, previous_sha256, size, previous_size, count,
    matched_unchanged, suppressed.  Null names or hashes are equal to one
    another; an edge without attachments has no rows.
    """
    up = prepared.select(scope, F.col("uid").alias("parent_uid"), F.col("verifiable").alias("p_items"), (F.size("undecodable") > 0).alias("p_bad"))
    own = prepared.where("compared").select(scope, "uid", "parent_uid", "thread_root_uid", F.col("verifiable").alias("c_items"), (F.size("undecodable") > 0).alias("c_bad"))
    # a number comes first, by which rows are sorted much faster than by a text
    edge = ["uid", scope, "parent_uid", "thread_root_uid", "p_bad", "c_bad"]
    of_side = lambda items, side: F.transform(items, lambda x, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), x["name"].alias("name"), x["sha256"].alias("sha256"), x["size"].alias("size")))
    # dealt as arrays, to so many tasks that none holds more units than it can sort in memory: equal names and digests fit a small shuffle, but not a small sort
    items = prepared.agg(F.sum(F.size("verifiable").cast("long"))).first()[0] or 0
    tasks = tasks_for(prepared.sparkSession, prepared.count(), TASK_MAILS)
    own, up = (x.repartition(tasks, "parent_uid", scope) for x in (own, up))
    dealt = own.join(up, ["parent_uid", scope]).where((F.size("p_items") > 0) | (F.size("c_items") > 0)).repartition(-(-2 * items // TASK_UNITS) or 1, "uid", scope)
    each = dealt.select(*edge, F.inline(F.concat(of_side("p_items", "p"), of_side("c_items", "c"))))
    count = lambda s: F.count_if(F.col("side") == s).alias(f"{s}_n")
    size = lambda s: F.min_by("size", F.when(F.col("side") == s, F.col("pos"))).alias(f"{s}_size")
    cells = each.groupBy(*edge, "name", "sha256").agg(count("p"), count("c"), size("p"), size("c"))
    cells = cells.withColumn("matched_unchanged", F.sum(F.least("p_n", "c_n")).over(Window.partitionBy(*edge)))
    edge.append("matched_unchanged")
    more = F.col("p_n") > F.col("c_n")
    units = cells.where("p_n <> c_n").select(
        *edge, F.when(more, "p").otherwise("c").alias("side"), "name", "sha256", F.when(more, F.col("p_size")).otherwise(F.col("c_size")).alias("size"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs(F.col("p_n") - F.col("c_n"))))
    ).drop("col")
    by_bytes = _pairs(units, edge, "sha256", "name")
    by_name = _pairs(_single(by_bytes, edge, "sha256", "name"), edge, "name", "sha256")
    rest = _single(by_name, edge, "name", "sha256")
    null, both = F.lit(None), "p IS NOT NULL AND c IS NOT NULL"

    def made(df: DataFrame, kind: Column | str, rank: Column | int, filename: str, before: Column, sha: str, before_sha: Column, size: str, before_size: Column) -> DataFrame:
        as_col = lambda x: F.lit(x) if isinstance(x, str | int) else x
        return df.select(
            *edge, as_col(kind).alias("type"), as_col(rank).alias("rank"), F.col(filename).alias("filename"), before.cast("string").alias("previous_filename"), F.col(sha).alias("sha256"), before_sha.cast("string").alias("previous_sha256"), F.col(size).alias("size"), before_size.cast("long").alias("previous_size")
        )

    gone = F.col("side") == "p"
    found = made(by_bytes.where(both), "renamed", 0, "c.value", F.col("p.value"), "sha256", null, "c.size", null)
    found = found.unionByName(made(by_name.where(both), "content_changed", 1, "name", null, "c.value", F.col("p.value"), "c.size", F.col("p.size")))
    found = found.unionByName(made(rest, F.when(gone, "removed").otherwise("added"), F.when(gone, 2).otherwise(3), "name", null, "sha256", null, "size", null))
    out = found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("count"))
    hidden = ((F.col("type") == "removed") & F.col("c_bad")) | ((F.col("type") == "added") & F.col("p_bad"))
    return out.withColumn("suppressed", hidden).drop("p_bad", "c_bad")


def events(diff: DataFrame, scope: str = "scope") -> DataFrame:
    """Numbered events: by mail, then renamed (by bytes), changed (by name), removed, added (by name and bytes)."""
    first = F.when(F.col("rank") == 0, F.col("sha256")).otherwise(F.col("filename"))
    second = F.when(F.col("rank") == 0, F.col("previous_filename")).when(F.col("rank") == 1, F.col("previous_sha256")).otherwise(F.col("sha256"))
    third = F.when(F.col("rank") == 0, F.col("filename")).otherwise(F.col("sha256"))
    tasks = tasks_for(diff.sparkSession, diff.count(), TASK_UNITS)
    return numbered(diff.where("NOT suppressed"), scope, "uid", "rank", first, second, third, blocks=[block_of("uid")], prefix="E", tasks=tasks)


def suppressed(diff: DataFrame) -> DataFrame:
    return diff.where("suppressed")


def reviews(prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """Numbered reviews: undecodable attachments in order, then the mail's unusable edge."""
    bad = prepared.select(F.col(scope).alias("scope"), "uid", "thread_root_uid", F.lit(0).alias("rank"), F.posexplode("undecodable").alias("pos", "a"), "legacy")
    bad = bad.select("scope", "uid", "thread_root_uid", "rank", "pos", F.lit("undecodable_attachment").alias("kind"), F.when(F.col("legacy"), "legacy").otherwise("marked").alias("cause"), F.col("a.name").alias("detail"))
    edge = prepared.where("skip_reason IN ('missing_parent', 'reference_conflict')").select(
        F.col(scope).alias("scope"), "uid", "thread_root_uid", F.lit(1).alias("rank"), F.lit(0).alias("pos"), F.col("skip_reason").alias("kind"), F.coalesce("conflict", F.col("skip_reason")).alias("cause"),
        F.when(F.col("conflict") == "own_id", F.col("message_id")).otherwise(F.col("claimed")).alias("detail"),
    )
    return numbered(bad.unionByName(edge), "scope", "uid", "rank", "pos", blocks=[block_of("uid")], prefix="R")


def ledger(prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """One row for each content (SHA-256): names, size of the first mail's copy, first place, occurrences."""
    seen = prepared.select(F.col(scope).alias("scope"), "uid", "date", F.posexplode("verifiable").alias("idx", "a"))
    order = F.struct(F.col("date").isNull(), F.coalesce("date", F.lit("")), F.col("uid"), F.col("idx"))
    return (
        seen.groupBy("scope", F.col("a.sha256").alias("sha256"))
        .agg(
            F.min_by("a.size", F.struct("uid", "idx")).alias("size"),
            F.array_sort(F.collect_set("a.name")).alias("names"),
            F.min_by(F.struct("uid", "date", F.col("a.name").alias("filename")), order).alias("first"),
            F.count(F.lit(1)).alias("occurrence_count"),
        )
        .select("scope", "sha256", "size", "names", F.col("first.uid").alias("first_uid"), F.col("first.date").alias("first_date"), F.col("first.filename").alias("first_filename"), "occurrence_count")
    )


def email_rows(prepared: DataFrame, event_rows: DataFrame, review_rows: DataFrame, diff: DataFrame, scope: str = "scope") -> DataFrame:
    """One row a mail: counts, comparison or its reason, ids of events and reviews, number of suppressed notes."""
    none = F.array().cast("array<string>")
    tasks = tasks_for(prepared.sparkSession, prepared.count(), TASK_MAILS)
    ids_of = lambda rows, name: rows.select(F.col("scope").alias(scope), "uid", "seq", "id").repartition(tasks, scope, "uid").groupBy(scope, "uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias(name))
    per_event = ids_of(event_rows.withColumnRenamed(scope, "scope"), "event_ids")
    per_review = ids_of(review_rows, "review_ids")
    notes = suppressed(diff).select(scope, "uid").repartition(tasks, scope, "uid").groupBy(scope, "uid").agg(F.count(F.lit(1)).alias("suppressed"))
    # the files themselves stay where they are
    counts = [F.coalesce(F.size("attachments"), F.lit(0)).cast("long").alias("attachment_count"), *[F.size(c).cast("long").alias(f"{c}_count") for c in ("verifiable", "undecodable")]]
    slim = prepared.select(scope, "uid", "message_id", "thread_root_uid", "parent_uid", *counts, "compared", "skip_reason").repartition(tasks, scope, "uid")
    met = slim.join(per_event, [scope, "uid"], "left").join(per_review, [scope, "uid"], "left").join(notes, [scope, "uid"], "left")
    return met.select(
        F.col(scope).alias("scope"), "uid", "message_id", "thread_root_uid", "parent_uid", "attachment_count", "verifiable_count",
        "undecodable_count", "compared", "skip_reason", F.coalesce("event_ids", none).alias("event_ids"), F.coalesce("review_ids", none).alias("review_ids"), F.coalesce("suppressed", F.lit(0)).cast("long").alias("suppressed"),
    )


def stats(rows: DataFrame, event_rows: DataFrame, review_rows: DataFrame, contents: DataFrame, scope: str = "scope") -> DataFrame:
    """The measures of each scope, zeros included."""
    parts = [
        rows.groupBy("scope").agg(
            F.count(F.lit(1)).alias("emails"), F.count_if(F.col("attachment_count") > 0).alias("emails_with_attachments"), F.sum("attachment_count").alias("attachments_total"), F.sum("verifiable_count").alias("attachments_verifiable"),
            F.sum("undecodable_count").alias("attachments_undecodable"), F.count_if("compared").alias("edges_compared"),
        ),
        contents.groupBy("scope").agg(F.count(F.lit(1)).alias("unique_contents")),
        event_rows.groupBy(F.col(scope).alias("scope")).agg(
            F.count(F.lit(1)).alias("events_total"), F.sum("count").alias("event_instances_total"), *[F.count_if(F.col("type") == k).alias(f"events_{k}") for k in EVENT_TYPES], *[F.sum(F.when(F.col("type") == k, F.col("count"))).alias(f"instances_{k}") for k in EVENT_TYPES]
        ),
        review_rows.groupBy("scope").agg(F.count(F.lit(1)).alias("reviews_total"), *[F.count_if(F.col("kind") == k).alias(f"reviews_{k}") for k in REVIEW_KINDS]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "scope", "left")
    return out.select("scope", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c != "scope"])
