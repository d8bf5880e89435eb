"""Merging the mails of several packages into one case.

Mails with the same bytes (SHA-256) become one node that keeps all its
sources; an id that several different nodes have is a conflict and never a
parent; a parent that was missing in a source package but is found in the case
is a relink.  Input rows have ``case_id, job_pos, job_id, uid, raw_sha256``
and the mail columns; all steps are keyed by the case, so many cases merge at
once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.ranking import numbered_from
from heliograph.operators.threads import resolve_parents

MAX_JOBS = 100
MAX_MAILS = 100_000


def admit(jobs: DataFrame, mails: DataFrame | None = None, max_jobs: int = MAX_JOBS, max_mails: int = MAX_MAILS) -> DataFrame:
    """Cases that may not be merged, with the reason.

    ``jobs`` has ``case_id, job_id`` and optionally ``status``: too many jobs, a
    job named twice, a job that is not completed, too many mails.
    """
    status = F.count_if(F.col("status") != "completed") if "status" in jobs.columns else F.lit(0)
    found = jobs.groupBy("case_id").agg(F.count(F.lit(1)).alias("jobs"), F.countDistinct("job_id").alias("distinct_jobs"), status.alias("unfinished"))
    if mails is not None:
        found = found.join(mails.groupBy("case_id").agg(F.count(F.lit(1)).alias("mails")), "case_id", "left")
    else:
        found = found.withColumn("mails", F.lit(0).cast("long"))
    reason = (
        F.when(F.col("jobs") > max_jobs, "too_many_jobs").when(F.col("distinct_jobs") < F.col("jobs"), "duplicate_jobs").when(F.col("unfinished") > 0, "job_not_completed").when(F.coalesce("mails", F.lit(0)) > max_mails, "too_many_mails")
    )
    return found.withColumn("reason", reason).where("reason IS NOT NULL").select("case_id", "reason")


def merge_nodes(occurrences: DataFrame) -> DataFrame:
    """One row for each (case, bytes): content of the first occurrence, all sources, the new uid.

    The first occurrence is the one of the lowest (job_pos, uid), and nodes are
    numbered in that order inside their case.  Mails without a hash are equal
    only to one another.
    """
    source = F.struct("job_pos", F.col("uid").alias("original_uid"), "job_id", "source_file")
    keyed = occurrences.withColumn("__sha", F.coalesce("raw_sha256", F.lit("")))
    all_of = keyed.groupBy("case_id", "__sha").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    first = F.row_number().over(Window.partitionBy("case_id", "__sha").orderBy("job_pos", "uid"))
    content = keyed.withColumn("__n", first).where("__n = 1").drop("__n")
    return (
        numbered_from(content.withColumnRenamed("uid", "original_uid"), ["case_id"], ["job_pos", "original_uid"], "uid")
        .drop("original_uid", "job_pos", "job_id")
        .join(all_of, ["case_id", "__sha"])
        .drop("__sha")
        .withColumn("source_count", F.size("sources").cast("long"))
        .withColumn("duplicates_merged", F.col("source_count") - 1)
    )


def mark_conflicts(nodes: DataFrame) -> DataFrame:
    """Adds ``conflict``, and for the nodes of one id ``conflict_class`` (the smallest uid among them) and ``conflict_size``.

    The other nodes of an id are the rows of its class in ``conflict_members``;
    a node does not list them, so an id of very many nodes costs a row each.
    """
    named = nodes.where("message_id IS NOT NULL")
    groups = named.groupBy("case_id", "message_id").agg(F.min("uid").alias("conflict_class"), F.count(F.lit(1)).alias("conflict_size")).where("conflict_size > 1")
    marked = named.join(groups, ["case_id", "message_id"], "left").withColumn("conflict", F.col("conflict_class").isNotNull())
    null = F.lit(None).cast("long")
    unnamed = nodes.where("message_id IS NULL").withColumns({"conflict_class": null, "conflict_size": null, "conflict": F.lit(False)})
    return marked.unionByName(unnamed)


def conflict_members(nodes: DataFrame) -> DataFrame:
    """(case_id, message_id, conflict_class, uid) of every node whose id other nodes have too."""
    return nodes.where("conflict").select("case_id", "message_id", "conflict_class", "uid")


def conflict_with(nodes: DataFrame, case_id: str, uid: int) -> DataFrame:
    """The uids of the other nodes with the id of one node, in order."""
    members = conflict_members(nodes).where(F.col("case_id") == case_id)
    own = members.where(F.col("uid") == uid).select("conflict_class")
    return members.where(F.col("uid") != uid).join(own, "conflict_class", "left_semi").select("uid").orderBy("uid")


def mark_relinks(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Adds ``relinked_for``, the source jobs that lacked the chosen parent, and ``relinked_via``.

    A job lacks a parent if no mail of the job has that id.  Jobs are listed in
    the order of the node's sources.
    """
    ids = occurrences.where("message_id IS NOT NULL").select("case_id", "job_id", F.col("message_id").alias("parent_ref")).distinct()
    jobs = nodes.where("parent_uid IS NOT NULL").select("case_id", "uid", "parent_ref", F.inline("sources")).groupBy("case_id", "uid", "parent_ref", "job_id").agg(F.min(F.struct("job_pos", "original_uid")).alias("place"))
    lacking = jobs.join(ids, ["case_id", "job_id", "parent_ref"], "left_anti")
    listed = lacking.groupBy("case_id", "uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "job_id"))), lambda x: x["job_id"]).alias("relinked_for"))
    out = nodes.join(listed, ["case_id", "uid"], "left")
    via = F.when(F.col("parent_ref").eqNullSafe(F.col("in_reply_to")), "in_reply_to").otherwise("references")
    return out.withColumn("relinked_for", F.coalesce("relinked_for", F.array().cast("array<string>"))).withColumn("relinked_via", F.when(F.size("relinked_for") > 0, via))


def merge_case(occurrences: DataFrame) -> DataFrame:
    """The merged forest: nodes with sources, conflicts, parents, roots and relinks."""
    nodes = mark_conflicts(merge_nodes(occurrences))
    resolved = resolve_parents(nodes, "case_id", ambiguous=True)
    return mark_relinks(nodes.join(resolved, ["case_id", "uid"]), occurrences)


def contributions(nodes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """What each job brought: mails, nodes it saw first, merged copies, conflicts, relinks, roots."""
    emails = occurrences.groupBy("case_id", "job_pos", "job_id").agg(F.count(F.lit(1)).alias("emails"))
    first = nodes.groupBy("case_id", F.col("sources")[0]["job_id"].alias("job_id")).agg(F.count(F.lit(1)).alias("unique_nodes"), F.count_if(F.col("parent_uid").isNull()).alias("root_nodes"))
    of_job = nodes.where("conflict").select("case_id", F.explode(F.array_distinct(F.transform("sources", lambda s: s["job_id"]))).alias("job_id")).groupBy("case_id", "job_id").agg(F.count(F.lit(1)).alias("conflict_nodes"))
    relinked = nodes.select("case_id", F.explode("relinked_for").alias("job_id")).groupBy("case_id", "job_id").agg(F.count(F.lit(1)).alias("relinked_nodes"))
    out = emails
    for part in (first, of_job, relinked):
        out = out.join(part, ["case_id", "job_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "case_id", "job_pos", "job_id", "emails", zero("unique_nodes"), (F.col("emails") - F.coalesce("unique_nodes", F.lit(0))).alias("duplicates_merged"), zero("conflict_nodes"), zero("relinked_nodes"), zero("root_nodes")
    )


def case_stats(nodes: DataFrame) -> DataFrame:
    """The measures of each case, without the jobs' own contributions."""
    conflicts = nodes.where("conflict").groupBy("case_id").agg(F.countDistinct("message_id").alias("conflict_groups"))
    stats = nodes.groupBy("case_id").agg(
        F.sum("source_count").alias("source_emails"), F.count(F.lit(1)).alias("merged_nodes"), F.sum("duplicates_merged").alias("duplicates_merged"), F.count_if("conflict").alias("conflict_nodes"),
        F.count_if(F.size("relinked_for") > 0).alias("relinked_nodes"), F.sum("ambiguous_refs").alias("ambiguous_references"), F.sum("missing_refs").alias("missing_references"),
        F.sum("cycle_refs").alias("reference_cycles"), F.sum("self_refs").alias("self_references"), F.count_if(F.col("parent_uid").isNull()).alias("thread_count"),
    )
    return stats.join(conflicts, "case_id", "left").withColumn("conflict_groups", F.coalesce("conflict_groups", F.lit(0)).cast("long"))
