"""Queries of the forensic operators over the mail-shaped views, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import addresses, quotes
from heliograph.lineage import keep
from heliograph.operators import attachments, case_merge, filters, gate, identity, quote_segments, recipients, threads, timing
from heliograph.plans import views
from heliograph.plans.registry import register
from heliograph.plans.views import duck_sql

WEEK = {"clock_skew_seconds": 604_800, "max_transit_seconds": 604_800}


def text_of(c: Column | str) -> Column:
    """An array of texts or numbers as one text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# ---------------------------------------------------------------------- threads


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.build_forest(views.thread_mails(spark, sf_dir))


@register(
    "thr_forest_summary",
    duck_sql(
        f"""WITH {views.THREAD_ORACLE} SELECT scope, root_uid, max(CASE WHEN uid = root_uid THEN message_id END) AS root_message_id, count(*)::BIGINT AS mail_count, max(depth)::BIGINT AS max_depth,
        sum(missing_refs)::BIGINT AS missing_refs, sum(self_refs)::BIGINT AS self_refs, sum(cycle_refs)::BIGINT AS cycle_refs, 0::BIGINT AS duplicate_ids FROM forest GROUP BY 1, 2"""
    ),
)
def thr_forest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.thread_summary(_forest(spark, sf_dir))


@register("thr_parents", duck_sql(f"WITH {views.THREAD_ORACLE} SELECT scope, uid, message_id, parent_uid, root_uid, depth, missing_refs, self_refs, cycle_refs FROM forest"))
def thr_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest(spark, sf_dir).select("scope", "uid", "message_id", "parent_uid", "root_uid", "depth", "missing_refs", "self_refs", "cycle_refs")


@register(
    "thr_preorder",
    duck_sql(
        f"""WITH {views.THREAD_ORACLE},
        paths(scope, uid, root_uid, path) AS (
          SELECT f.scope, f.uid, f.root_uid, [f.date || '|c' || m.conv_id || '-' || m.turn || '.eml'] FROM forest f JOIN m ON m.scope = f.scope AND m.uid = f.uid WHERE f.parent_uid IS NULL
          UNION ALL SELECT f.scope, f.uid, f.root_uid, p.path || [f.date || '|c' || m.conv_id || '-' || m.turn || '.eml'] FROM forest f JOIN paths p ON p.scope = f.scope AND p.uid = f.parent_uid JOIN m ON m.scope = f.scope AND m.uid = f.uid)
        SELECT scope, uid, root_uid, (row_number() OVER (PARTITION BY scope, root_uid ORDER BY path) - 1)::BIGINT AS thread_pos FROM paths"""
    ),
)
def thr_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = threads.preorder(_forest(spark, sf_dir), [F.coalesce("date", F.lit("")), F.col("source_file")])
    return placed.select("scope", "uid", "root_uid", "thread_pos")


@register(
    "thr_issue_summary",
    duck_sql(
        f"""WITH {views.THREAD_ORACLE} SELECT scope, count(*)::BIGINT AS eml_parsed, count(*) FILTER (WHERE parent_uid IS NULL)::BIGINT AS thread_count, 0::BIGINT AS attachment_count,
        count(*) FILTER (WHERE message_id IS NULL)::BIGINT AS missing_message_id, 0::BIGINT AS duplicate_message_id, sum(missing_refs)::BIGINT AS missing_parent, sum(cycle_refs)::BIGINT AS reference_cycle,
        sum(self_refs)::BIGINT AS self_reference, 0::BIGINT AS undecodable, 0::BIGINT AS other, (count(*) FILTER (WHERE message_id IS NULL) + sum(missing_refs) + sum(cycle_refs) + sum(self_refs))::BIGINT AS issues_total FROM forest GROUP BY 1"""
    ),
)
def thr_issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.package_stats(_forest(spark, sf_dir))


@register(
    "thr_duplicate_ids",
    duck_sql(
        f"""WITH o AS ({views.CASE_MAILS}), f AS (SELECT *, min(uid) OVER (PARTITION BY case_id, message_id) AS first_uid FROM o)
        SELECT f.case_id, f.uid, CASE WHEN f.message_id IS NOT NULL THEN f.first_uid END AS canonical_uid,
        CASE WHEN f.message_id IS NULL THEN 'none' WHEN f.uid = f.first_uid THEN 'first' WHEN f.raw_sha256 = c.raw_sha256 THEN 'copy' ELSE 'reused' END AS id_class
        FROM f LEFT JOIN o c ON c.case_id = f.case_id AND c.uid = f.first_uid"""
    ),
)
def thr_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.classify_duplicates(views.case_mails(spark, sf_dir), "case_id").select("case_id", "uid", "canonical_uid", "id_class")


@register(
    "qry_compact_tree",
    duck_sql(
        f"""WITH {views.THREAD_ORACLE} SELECT f.scope, f.uid, f.parent_uid, f.message_id, m.role AS subject, m.role || '@chat.example' AS from_address, f.date, 'c' || m.conv_id || '-' || m.turn || '.eml' AS source_file,
        0::BIGINT AS attachment_count, 0::BIGINT AS issue_count FROM forest f JOIN m ON m.scope = f.scope AND m.uid = f.uid"""
    ),
)
def qry_compact_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.compact_package_view(_forest(spark, sf_dir))


# ------------------------------------------------------------------------- case


def _case(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    occurrences = views.case_mails(spark, sf_dir)
    return keep(case_merge.merge_case(occurrences), "case-nodes"), occurrences


@register(
    "cas_nodes",
    duck_sql(
        f"""WITH {views.CASE_ORACLE} SELECT l.case_id, l.uid, l.message_id, l.source_count, (l.source_count - 1)::BIGINT AS duplicates_merged, l.variants > 1 AS conflict, l.parent_uid, l.parent_ref, t.root_uid, t.depth::BIGINT AS depth,
        l.missing_refs, l.self_refs, l.ambiguous_refs, coalesce(r.jobs, '') AS relinked_for, CASE WHEN r.jobs IS NOT NULL THEN CASE WHEN l.parent_ref = l.in_reply_to THEN 'in_reply_to' ELSE 'references' END END AS relinked_via
        FROM linked l JOIN tree t ON t.case_id = l.case_id AND t.uid = l.uid LEFT JOIN (SELECT case_id, node, string_agg(job_id, ',' ORDER BY job_pos) AS jobs FROM lacking GROUP BY 1, 2) r ON r.case_id = l.case_id AND r.node = l.uid"""
    ),
)
def cas_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _case(spark, sf_dir)
    return nodes.select(
        "case_id", "uid", "message_id", "source_count", "duplicates_merged", "conflict", "parent_uid", "parent_ref", "root_uid", "depth", "missing_refs", "self_refs", "ambiguous_refs", text_of("relinked_for").alias("relinked_for"), "relinked_via"
    )


@register(
    "cas_contributions",
    duck_sql(
        f"""WITH {views.CASE_ORACLE},
        e AS (SELECT case_id, job_id, count(*) AS emails FROM o GROUP BY 1, 2),
        u AS (SELECT case_id, job_id, count(*) AS unique_nodes, count(*) FILTER (WHERE parent_uid IS NULL) AS root_nodes FROM linked GROUP BY 1, 2),
        k AS (SELECT p.case_id, p.job_id, count(*) AS conflict_nodes FROM places p JOIN linked l ON l.case_id = p.case_id AND l.uid = p.node WHERE l.variants > 1 GROUP BY 1, 2),
        r AS (SELECT case_id, job_id, count(*) AS relinked_nodes FROM lacking GROUP BY 1, 2)
        SELECT e.case_id, e.job_id, e.emails::BIGINT AS emails, coalesce(u.unique_nodes, 0)::BIGINT AS unique_nodes, (e.emails - coalesce(u.unique_nodes, 0))::BIGINT AS duplicates_merged,
        coalesce(k.conflict_nodes, 0)::BIGINT AS conflict_nodes, coalesce(r.relinked_nodes, 0)::BIGINT AS relinked_nodes, coalesce(u.root_nodes, 0)::BIGINT AS root_nodes
        FROM e LEFT JOIN u USING (case_id, job_id) LEFT JOIN k USING (case_id, job_id) LEFT JOIN r USING (case_id, job_id)"""
    ),
)
def cas_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_merge.contributions(*_case(spark, sf_dir)).drop("job_pos")


@register(
    "cas_stats",
    duck_sql(
        f"""WITH {views.CASE_ORACLE} SELECT case_id, sum(source_count)::BIGINT AS source_emails, count(*)::BIGINT AS merged_nodes, sum(source_count - 1)::BIGINT AS duplicates_merged, count(*) FILTER (WHERE variants > 1)::BIGINT AS conflict_nodes,
        count(DISTINCT CASE WHEN variants > 1 THEN message_id END)::BIGINT AS conflict_groups, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lacking x WHERE x.case_id = linked.case_id AND x.node = linked.uid))::BIGINT AS relinked_nodes,
        sum(ambiguous_refs)::BIGINT AS ambiguous_references, sum(missing_refs)::BIGINT AS missing_references, 0::BIGINT AS reference_cycles, sum(self_refs)::BIGINT AS self_references, count(*) FILTER (WHERE parent_uid IS NULL)::BIGINT AS thread_count
        FROM linked GROUP BY 1"""
    ),
)
def cas_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_merge.case_stats(_case(spark, sf_dir)[0])


@register("qry_compact_case", duck_sql(f"""WITH {views.CASE_ORACLE} SELECT case_id, uid, parent_uid, message_id, source_count, variants > 1 AS conflict, EXISTS (SELECT 1 FROM lacking x WHERE x.case_id = linked.case_id AND x.node = linked.uid) AS relinked FROM linked"""))
def qry_compact_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _case(spark, sf_dir)
    return filters.compact_case_view(nodes.withColumn("from", F.struct(F.lit(None).cast("string").alias("address")))).drop("subject", "from_address", "date")


# ----------------------------------------------------------------------- timing

_TIMING = f"""
m AS MATERIALIZED ({views.ORDER_MAILS}), h AS MATERIALIZED ({views.ORDER_HOPS}),
path AS (SELECT uid, idx, moment, by_host, from_host, time_utc, odd, row_number() OVER w - 1 AS pos, lead(moment) OVER w AS next_moment, lead(idx) OVER w AS next_idx, count(*) OVER (PARTITION BY uid) AS hops FROM h WINDOW w AS (PARTITION BY uid ORDER BY idx DESC)),
raw AS (
  SELECT m.scope, 'client_clock_skew' AS type, m.uid, 0 AS rank, 0 AS pos, epoch_us(p.moment) - epoch_us(m.moment) AS value_us, epoch_us(m.moment) AS time_us, NULL::INT AS hop_from, NULL::INT AS hop_to FROM m JOIN path p ON p.uid = m.uid AND p.pos = 0
    WHERE abs(epoch_us(p.moment) - epoch_us(m.moment)) > 604800000000
  UNION ALL SELECT m.scope, CASE WHEN next_moment < p.moment THEN 'hop_time_inversion' ELSE 'abnormal_transit' END, m.uid, 1, p.pos, epoch_us(next_moment) - epoch_us(p.moment), epoch_us(p.moment), idx, next_idx FROM m JOIN path p ON p.uid = m.uid
    WHERE next_moment < p.moment OR epoch_us(next_moment) - epoch_us(p.moment) > 604800000000
  UNION ALL SELECT m.scope, 'reply_before_parent', m.uid, 2, 0, epoch_us(p.moment) - epoch_us(m.moment), epoch_us(m.moment), NULL, NULL FROM m JOIN m p ON p.scope = m.scope AND p.uid = m.parent_uid WHERE epoch_us(p.moment) - epoch_us(m.moment) > 604800000000),
found AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY uid, rank, pos)::BIGINT AS seq FROM raw)
"""


def _timing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Timed mails, read from their lines once, and their findings."""
    mails = views.timing_mails(spark, sf_dir)
    timed = keep(timing.slim(mails), "timed")
    return timed, timing.findings(mails, limits=WEEK, prepared=timed, contents=views.run(spark, sf_dir, views.ORDER_MAILS))


@register("tim_findings", duck_sql(f"WITH {_TIMING} SELECT scope, seq, type, uid, value_us::BIGINT AS value_us, time_us::BIGINT AS time_us, hop_from, hop_to FROM found"))
def tim_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timing(spark, sf_dir)[1].select("scope", "seq", "type", F.col("lead_uid").alias("uid"), "value_us", "time_us", "hop_from", "hop_to")


@register(
    "tim_timeline",
    duck_sql(
        f"""WITH {_TIMING}, per AS (SELECT scope, uid, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS ids FROM (SELECT scope, uid, seq FROM found UNION SELECT f.scope, m.parent_uid, f.seq FROM found f JOIN m ON m.uid = f.uid WHERE f.type = 'reply_before_parent') GROUP BY 1, 2)
        SELECT m.scope, m.uid, epoch_us(m.moment)::BIGINT AS time_us, 'date' AS time_basis, coalesce(x.n, 0)::BIGINT AS hop_count, coalesce(x.odd, 0)::BIGINT AS hops_with_issues, coalesce(per.ids, '') AS findings
        FROM m LEFT JOIN (SELECT uid, count(*) AS n, sum(odd) AS odd FROM h GROUP BY 1) x ON x.uid = m.uid LEFT JOIN per ON per.scope = m.scope AND per.uid = m.uid"""
    ),
)
def tim_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timing.timeline(*_timing(spark, sf_dir))
    ids = F.array_join(F.transform("finding_ids", lambda x: F.regexp_replace(x, "^F0*", "")), ",")
    return out.select("scope", "uid", "time_us", "time_basis", "hop_count", "hops_with_issues", ids.alias("findings"))


@register(
    "tim_stats",
    duck_sql(
        f"""WITH {_TIMING} SELECT m.scope, count(*)::BIGINT AS emails, count(x.n)::BIGINT AS emails_with_received, coalesce(sum(x.n), 0)::BIGINT AS hops_total, coalesce(sum(x.odd), 0)::BIGINT AS hops_with_issues,
        any_value(f.total)::BIGINT AS findings_total, any_value(f.a)::BIGINT AS client_clock_skew, any_value(f.b)::BIGINT AS abnormal_transit, any_value(f.c)::BIGINT AS hop_time_inversion, any_value(f.d)::BIGINT AS reply_before_parent, 0::BIGINT AS chain_mismatch
        FROM m LEFT JOIN (SELECT uid, count(*) AS n, sum(odd) AS odd FROM h GROUP BY 1) x ON x.uid = m.uid
        LEFT JOIN (SELECT scope, count(*) AS total, count(*) FILTER (WHERE type = 'client_clock_skew') AS a, count(*) FILTER (WHERE type = 'abnormal_transit') AS b, count(*) FILTER (WHERE type = 'hop_time_inversion') AS c, count(*) FILTER (WHERE type = 'reply_before_parent') AS d FROM found GROUP BY 1) f ON f.scope = m.scope GROUP BY 1"""
    ),
)
def tim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed, found = _timing(spark, sf_dir)
    return timing.stats(timed, found)


@register(
    "tim_chain_mismatch",
    duck_sql(
        f"""WITH m AS ({views.ORDER_MAILS}), h AS ({views.ORDER_HOPS}), v AS (SELECT 's' || (o_custkey % 16) AS scope, 'day' || substr(date, 1, 10) || '-' || (o_custkey % 40) AS message_id, m.uid, raw_sha256 FROM m),
        c AS (SELECT v.*, coalesce((SELECT string_agg(from_host || '>' || by_host || '@' || time_utc, '|' ORDER BY idx) FROM h WHERE h.uid = v.uid), '') AS chain FROM v)
        SELECT scope, message_id, count(*)::BIGINT AS nodes FROM c GROUP BY 1, 2 HAVING count(DISTINCT raw_sha256) > 1 AND count(DISTINCT chain) > 1"""
    ),
)
def tim_chain_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = views.timing_mails(spark, sf_dir)
    mails = mails.withColumn("message_id", F.concat(F.lit("day"), F.substring("date", 1, 10), F.lit("-"), F.col("o_custkey") % 40))
    found = timing.chain_mismatches(timing.timed(mails), "scope")
    return found.select("scope", F.col("message_ids")[0].alias("message_id"), F.size("node_uids").cast("long").alias("nodes"))


@register(
    "qry_timeline_range",
    duck_sql(
        f"""WITH {_TIMING}, x AS (SELECT f.scope, f.uid, f.seq FROM found f WHERE type = 'hop_time_inversion') SELECT m.scope, m.uid, epoch_us(m.moment)::BIGINT AS time_us, string_agg(x.seq::VARCHAR, ',' ORDER BY x.seq) AS findings
        FROM m JOIN x ON x.scope = m.scope AND x.uid = m.uid WHERE epoch_us(m.moment) BETWEEN epoch_us(TIMESTAMP '1995-01-01 00:00:00') AND epoch_us(TIMESTAMP '1996-12-31 23:00:00') GROUP BY 1, 2, 3"""
    ),
)
def qry_timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed, found = _timing(spark, sf_dir)
    # findings have their numbers; of other types none is asked for, so they do not meet the mails
    line = timing.timeline(timed, found.where("type = 'hop_time_inversion'"))
    kept = filters.filter_timeline(line, "1995-01-01T00:00:00+00:00", "1997-01-01T00:00:00+01:00", "hop_time_inversion")
    return kept.select("scope", "uid", "time_us", F.array_join(F.transform("finding_ids", lambda x: F.regexp_replace(x, "^F0*", "")), ",").alias("findings"))


# ------------------------------------------------------------------- recipients

_PEOPLE = f"""
{views.GATE_ORACLE}, rows AS ({views.ORDER_PEOPLE}),
ppl AS MATERIALIZED (SELECT DISTINCT uid, field, split_part(address, '@', 1) || '@' || lower(split_part(address, '@', 2)) AS key FROM rows WHERE address <> 'broken address' UNION SELECT uid, 'From', 'c' || (o_custkey % 7) || '@y.example' FROM m),
recip AS (SELECT uid, key, CASE WHEN bool_or(field = 'To') THEN 'to' ELSE 'cc' END AS role FROM ppl WHERE field <> 'From' GROUP BY 1, 2),
everyone AS (SELECT DISTINCT uid, key FROM ppl),
bad AS (SELECT uid, count(*) AS n FROM rows WHERE address = 'broken address' GROUP BY 1), listed AS (SELECT DISTINCT uid FROM ppl WHERE key = 'staff@x.example'),
edge AS MATERIALIZED (SELECT g.scope, g.uid, g.parent_uid, g.thread_root_uid, g.skip_reason, (l.uid IS NOT NULL OR pl.uid IS NOT NULL) AS lists, (b.uid IS NOT NULL OR pb.uid IS NOT NULL) AS broken FROM gate g
  LEFT JOIN listed l ON l.uid = g.uid LEFT JOIN listed pl ON pl.uid = g.parent_uid LEFT JOIN bad b ON b.uid = g.uid LEFT JOIN bad pb ON pb.uid = g.parent_uid WHERE g.parent_uid IS NOT NULL),
diff AS MATERIALIZED (
  SELECT e.uid, 0 AS rank, 'added' AS type, c.key, NULL AS from_role, NULL AS to_role FROM edge e JOIN everyone c ON c.uid = e.uid WHERE NOT EXISTS (SELECT 1 FROM everyone p WHERE p.uid = e.parent_uid AND p.key = c.key)
  UNION ALL SELECT e.uid, 1, 'role_changed', c.key, p.role, c.role FROM edge e JOIN recip c ON c.uid = e.uid JOIN recip p ON p.uid = e.parent_uid AND p.key = c.key WHERE p.role <> c.role
  UNION ALL SELECT e.uid, 2, 'dropped', p.key, NULL, NULL FROM edge e JOIN recip p ON p.uid = e.parent_uid WHERE NOT EXISTS (SELECT 1 FROM recip c WHERE c.uid = e.uid AND c.key = p.key) AND NOT EXISTS (SELECT 1 FROM ppl c WHERE c.uid = e.uid AND c.field = 'From' AND c.key = p.key)
  UNION ALL SELECT e.uid, 3, 'reply_all_omitted', p.key, NULL, NULL FROM edge e JOIN everyone p ON p.uid = e.parent_uid WHERE NOT EXISTS (SELECT 1 FROM everyone c WHERE c.uid = e.uid AND c.key = p.key)),
ev AS MATERIALIZED (SELECT e.scope, e.thread_root_uid, d.*, row_number() OVER (PARTITION BY e.scope ORDER BY d.uid, d.rank, d.key)::BIGINT AS seq FROM diff d JOIN edge e ON e.uid = d.uid WHERE e.skip_reason IS NULL AND NOT e.lists AND NOT e.broken),
rv AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY uid, rank, pos)::BIGINT AS seq FROM (
  SELECT m.scope, r.uid, 0 AS rank, row_number() OVER (PARTITION BY r.uid ORDER BY CASE WHEN field = 'To' THEN 0 ELSE 1 END, r.pos) - 1 AS pos, 'malformed_address' AS kind, 'white_space' AS cause FROM rows r JOIN m ON m.uid = r.uid WHERE address = 'broken address'
  UNION ALL SELECT m.scope, l.uid, 1, 0, 'possible_mailing_list', 'own_mail' FROM listed l JOIN m ON m.uid = l.uid
  UNION ALL SELECT scope, uid, 2, 0, skip_reason, CASE WHEN skip_reason = 'missing_parent' THEN 'missing_parent' ELSE 'broken_edge' END FROM gate WHERE skip_reason IN ('missing_parent', 'reference_conflict')
  UNION ALL SELECT scope, uid, 3, 0, CASE WHEN lists THEN 'possible_mailing_list' ELSE 'malformed_address' END, 'edge' FROM edge WHERE skip_reason IS NULL AND (lists OR broken)))
"""


_CONFLICTS = f"""
m AS MATERIALIZED ({views.CONFLICT_MAILS}), rows AS ({views.ORDER_PEOPLE}),
ppl AS MATERIALIZED (SELECT DISTINCT uid, field, split_part(address, '@', 1) || '@' || lower(split_part(address, '@', 2)) AS key FROM rows WHERE address <> 'broken address' UNION SELECT uid, 'From', 'c' || (o_custkey % 7) || '@y.example' FROM m),
recip AS (SELECT DISTINCT uid, key FROM ppl WHERE field <> 'From'), everyone AS (SELECT DISTINCT uid, key FROM ppl),
sets AS MATERIALIZED (SELECT m.uid, coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE field = 'To'), '') AS to_set, coalesce(string_agg(key, ',' ORDER BY key) FILTER (WHERE field = 'Cc'), '') AS cc_set FROM m LEFT JOIN ppl ON ppl.uid = m.uid GROUP BY 1),
ids AS MATERIALIZED (SELECT scope, message_id, min(uid) AS first_uid, count(*) AS n FROM m GROUP BY 1, 2),
g AS MATERIALIZED (SELECT m.*, own.first_uid <> m.uid AS repeated, up.first_uid AS claimed_uid, coalesce(up.n, 0) > 1 AS clash, p.message_id AS parent_id FROM m JOIN ids own ON own.scope = m.scope AND own.message_id = m.message_id
  LEFT JOIN ids up ON up.scope = m.scope AND up.message_id = m.in_reply_to LEFT JOIN m p ON p.uid = m.parent_uid),
state AS MATERIALIZED (SELECT *, CASE WHEN repeated THEN 'own_id' WHEN in_reply_to IS NOT NULL AND parent_id IS DISTINCT FROM in_reply_to THEN CASE WHEN claimed_uid IS NOT NULL THEN 'broken_edge' ELSE 'missing_parent' END
  WHEN parent_id IS NOT NULL AND parent_id IS DISTINCT FROM in_reply_to THEN 'missing_parent' WHEN clash THEN 'parent_id' END AS cause FROM g),
pairs AS MATERIALIZED (SELECT scope, uid, cause, in_reply_to AS claimed, CASE WHEN cause = 'broken_edge' THEN claimed_uid END AS candidate_uid FROM state WHERE cause IN ('own_id', 'missing_parent', 'broken_edge')
  UNION ALL SELECT s.scope, s.uid, s.cause, s.in_reply_to, c.uid FROM state s JOIN m c ON c.scope = s.scope AND c.message_id = s.in_reply_to WHERE s.cause = 'parent_id')
"""
_CHANGED = "SELECT string_agg({0}.key, ',' ORDER BY {0}.key) FROM {1} {0} WHERE {0}.uid = {2} AND NOT EXISTS (SELECT 1 FROM {3} o WHERE o.uid = {4} AND o.key = {0}.key)"


@register(
    "rcp_conflicts",
    duck_sql(
        f"""WITH {_CONFLICTS} SELECT p.scope, p.uid, p.cause, p.claimed, c.to_set AS child_to, c.cc_set AS child_cc, p.candidate_uid, s.to_set AS candidate_to, s.cc_set AS candidate_cc,
        CASE WHEN p.candidate_uid IS NOT NULL THEN coalesce(({_CHANGED.format("a", "everyone", "p.uid", "everyone", "p.candidate_uid")}), '') END AS added,
        CASE WHEN p.candidate_uid IS NOT NULL THEN coalesce(({_CHANGED.format("b", "everyone", "p.candidate_uid", "everyone", "p.uid")}), '') END AS omitted
        FROM pairs p JOIN sets c ON c.uid = p.uid LEFT JOIN sets s ON s.uid = p.candidate_uid"""
    ),
)
def rcp_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = keep(recipients.prepare(views.conflicted_mails(spark, sf_dir)).drop("from", "to", "cc", "entries"), "conflicted")
    # the pairs are very many: texts are made once a mail, and only the differences that are listed
    listed = lambda c: F.array_join(c, ",")
    e = recipients.conflict_evidence(prepared, show=listed, kinds=("added", "reply_all_omitted"))
    return e.select(
        "scope", "uid", "cause", "claimed", F.col("child.to").alias("child_to"), F.col("child.cc").alias("child_cc"), "candidate_uid", F.col("candidate.to").alias("candidate_to"), F.col("candidate.cc").alias("candidate_cc"),
        listed("differences.added").alias("added"), listed("differences.reply_all_omitted").alias("omitted"),
    )


@register("rcp_conflict_variants", duck_sql(f"WITH {_CONFLICTS} SELECT m.scope, m.message_id, ids.n::BIGINT AS variant_count, m.uid, m.raw_sha256, s.to_set AS to_set, s.cc_set AS cc_set FROM m JOIN ids ON ids.scope = m.scope AND ids.message_id = m.message_id JOIN sets s ON s.uid = m.uid WHERE ids.n > 1"))
def rcp_conflict_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared = keep(recipients.prepare(views.conflicted_mails(spark, sf_dir)).drop("from", "to", "cc", "entries"), "conflicted")
    v = recipients.conflict_variants(prepared)
    return v.select("scope", "message_id", "variant_count", "uid", "raw_sha256", text_of("sets.to").alias("to_set"), text_of("sets.cc").alias("cc_set"))


def _recipients(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What several queries need; a query of the mails alone does not come here."""
    prepared = keep(recipients.prepare(views.recipient_mails(spark, sf_dir)), "recipients")
    edges = keep(recipients.edges(prepared), "recipient-edges")
    return {"prepared": prepared, "edges": edges, "events": recipients.events(edges), "reviews": recipients.reviews(prepared, edges)}


@register("rcp_events", duck_sql(f"WITH {_PEOPLE} SELECT scope, seq, uid, type, key AS address, from_role, to_role FROM ev"))
def rcp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recipients(spark, sf_dir)["events"].select("scope", "seq", "uid", "type", "address", "from_role", "to_role")


@register("rcp_reviews", duck_sql(f"WITH {_PEOPLE} SELECT scope, seq, uid, kind, cause FROM rv"))
def rcp_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recipients(spark, sf_dir)["reviews"].select("scope", "seq", "uid", "kind", "cause")


@register(
    "rcp_edges",
    duck_sql(
        f"""WITH {_PEOPLE}, lists AS (SELECT uid, type, string_agg(key, ',' ORDER BY key) AS keys FROM diff GROUP BY 1, 2)
        SELECT e.scope, e.uid, e.parent_uid, (e.skip_reason IS NULL AND NOT e.lists AND NOT e.broken) AS compared, coalesce(a.keys, '') AS added, coalesce(r.keys, '') AS role_changed, coalesce(d.keys, '') AS dropped, coalesce(o.keys, '') AS reply_all_omitted
        FROM edge e LEFT JOIN lists a ON a.uid = e.uid AND a.type = 'added' LEFT JOIN lists r ON r.uid = e.uid AND r.type = 'role_changed' LEFT JOIN lists d ON d.uid = e.uid AND d.type = 'dropped' LEFT JOIN lists o ON o.uid = e.uid AND o.type = 'reply_all_omitted'"""
    ),
)
def rcp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _recipients(spark, sf_dir)["edges"]
    return e.select("scope", "uid", "parent_uid", F.col("edge_compared").alias("compared"), text_of("added").alias("added"), text_of(F.transform("role_changed", lambda x: x["address"])).alias("role_changed"), text_of("dropped").alias("dropped"), text_of("reply_all_omitted").alias("reply_all_omitted"))


@register(
    "rcp_ledger",
    duck_sql(
        f"""WITH {_PEOPLE}, seen AS (SELECT m.scope, p.key, p.field, p.uid, m.date, CASE p.field WHEN 'From' THEN 0 WHEN 'To' THEN 1 ELSE 2 END AS rank FROM ppl p JOIN m ON m.uid = p.uid)
        SELECT scope, key AS address, string_agg(DISTINCT field, ',' ORDER BY field) AS fields, arg_min(uid, (date, uid, rank)) AS first_uid, arg_min(field, (date, uid, rank)) AS first_field, count(*)::BIGINT AS occurrence_count FROM seen GROUP BY 1, 2"""
    ),
)
def rcp_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # addresses of mails: no edge is compared
    out = recipients.ledger(recipients.visible_addresses(views.recipient_mails(spark, sf_dir, edges=False)))
    return out.select("scope", "address", text_of("fields").alias("fields"), "first_uid", "first_field", "occurrence_count")


@register(
    "rcp_emails",
    duck_sql(
        f"""WITH {_PEOPLE} SELECT g.scope, g.uid, (SELECT count(*) FROM everyone x WHERE x.uid = g.uid)::BIGINT AS visible_count, (SELECT count(*) FROM ppl x WHERE x.uid = g.uid AND field = 'To')::BIGINT AS to_count,
        (SELECT count(*) FROM ppl x WHERE x.uid = g.uid AND field = 'Cc')::BIGINT AS cc_count, coalesce(b.n, 0)::BIGINT AS malformed_count, l.uid IS NOT NULL AS list_hints, coalesce(e.skip_reason IS NULL AND NOT e.lists AND NOT e.broken, false) AS compared, g.skip_reason,
        coalesce((SELECT string_agg(seq::VARCHAR, ',' ORDER BY seq) FROM ev WHERE ev.uid = g.uid), '') AS events, coalesce((SELECT string_agg(seq::VARCHAR, ',' ORDER BY seq) FROM rv WHERE rv.uid = g.uid), '') AS reviews
        FROM gate g LEFT JOIN bad b ON b.uid = g.uid LEFT JOIN listed l ON l.uid = g.uid LEFT JOIN edge e ON e.uid = g.uid"""
    ),
)
def rcp_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recipients(spark, sf_dir)
    rows = recipients.email_rows(r["prepared"], r["edges"], r["events"], r["reviews"])
    plain = lambda c: F.array_join(F.transform(c, lambda x: F.regexp_replace(x, "^[ER]0*", "")), ",")
    return rows.select("scope", "uid", "visible_count", "to_count", "cc_count", "malformed_count", "list_hints", "compared", "skip_reason", plain("event_ids").alias("events"), plain("review_ids").alias("reviews"))


@register(
    "rcp_threads",
    duck_sql(
        f"""WITH {_PEOPLE} SELECT g.scope, g.thread_root_uid, count(*)::BIGINT AS email_count, coalesce(sum(e.n), 0)::BIGINT AS event_count, coalesce(sum(r.n), 0)::BIGINT AS review_count
        FROM gate g LEFT JOIN (SELECT uid, count(*) AS n FROM ev GROUP BY 1) e ON e.uid = g.uid LEFT JOIN (SELECT uid, count(*) AS n FROM rv GROUP BY 1) r ON r.uid = g.uid GROUP BY 1, 2"""
    ),
)
def rcp_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what is counted needs no texts, names or differences that are kept
    prepared = recipients.prepare(views.recipient_mails(spark, sf_dir))
    prepared = keep(prepared.select("scope", "uid", "parent_uid", "message_id", "thread_root_uid", "c_from", "c_to", "c_cc", "hints", "malformed", "skip_reason", "conflict", "compared"), "recipients")
    return recipients.thread_counts(prepared, recipients.edges(prepared))


@register(
    "rcp_stats",
    duck_sql(
        f"""WITH {_PEOPLE}, s AS (SELECT scope, count(*) AS emails, count(DISTINCT thread_root_uid) AS threads_total FROM gate GROUP BY 1)
        SELECT s.scope, s.emails::BIGINT AS emails, s.threads_total::BIGINT AS threads_total, (SELECT coalesce(sum(b.n), 0) FROM bad b JOIN m ON m.uid = b.uid WHERE m.scope = s.scope)::BIGINT AS malformed_addresses,
        (SELECT count(DISTINCT p.key) FROM ppl p JOIN m ON m.uid = p.uid WHERE m.scope = s.scope)::BIGINT AS unique_addresses, (SELECT count(*) FROM edge e WHERE e.scope = s.scope)::BIGINT AS edges_total,
        (SELECT count(*) FROM edge e WHERE e.scope = s.scope AND e.skip_reason IS NULL AND NOT e.lists AND NOT e.broken)::BIGINT AS edges_compared, (SELECT count(DISTINCT d.uid) FROM diff d JOIN m ON m.uid = d.uid WHERE m.scope = s.scope)::BIGINT AS edges_with_changes,
        (SELECT count(*) FROM ev WHERE ev.scope = s.scope)::BIGINT AS events_total, (SELECT count(*) FROM ev WHERE ev.scope = s.scope AND type = 'added')::BIGINT AS events_added, (SELECT count(*) FROM ev WHERE ev.scope = s.scope AND type = 'dropped')::BIGINT AS events_dropped,
        (SELECT count(*) FROM ev WHERE ev.scope = s.scope AND type = 'role_changed')::BIGINT AS events_role_changed, (SELECT count(*) FROM ev WHERE ev.scope = s.scope AND type = 'reply_all_omitted')::BIGINT AS events_reply_all_omitted,
        (SELECT count(*) FROM rv WHERE rv.scope = s.scope)::BIGINT AS reviews_total, (SELECT count(*) FROM rv WHERE rv.scope = s.scope AND kind = 'possible_mailing_list')::BIGINT AS reviews_possible_mailing_list,
        (SELECT count(*) FROM rv WHERE rv.scope = s.scope AND kind = 'malformed_address')::BIGINT AS reviews_malformed_address, (SELECT count(*) FROM rv WHERE rv.scope = s.scope AND kind = 'missing_parent')::BIGINT AS reviews_missing_parent,
        (SELECT count(*) FROM rv WHERE rv.scope = s.scope AND kind = 'reference_conflict')::BIGINT AS reviews_reference_conflict FROM s"""
    ),
)
def rcp_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recipients(spark, sf_dir)
    rows = recipients.email_rows(r["prepared"], r["edges"], r["events"], r["reviews"])
    return recipients.stats(rows, r["edges"], r["events"], r["reviews"], recipients.ledger(r["prepared"]))


@register("qry_recipient_address", duck_sql(f"WITH {_PEOPLE} SELECT scope, seq, uid, type, key AS address FROM ev WHERE key = 'S3@x.example' AND type = 'dropped'"))
def qry_recipient_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.filter_recipient_events(_recipients(spark, sf_dir)["events"], "dropped", None, "Someone <S3@X.EXAMPLE>")
    return found.select("scope", "seq", "uid", "type", "address")


@register(
    "qry_recipient_threads",
    duck_sql(f"WITH {_PEOPLE} SELECT scope, thread_root_uid, count(*)::BIGINT AS matched_events FROM ev WHERE key = 'S3@x.example' GROUP BY 1, 2"),
)
def qry_recipient_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _recipients(spark, sf_dir)
    rows = recipients.thread_summaries(recipients.email_rows(r["prepared"], r["edges"], r["events"], r["reviews"]))
    return filters.filter_recipient_threads(rows, r["events"], None, "S3@x.example").select("scope", "thread_root_uid", "matched_events")


# ------------------------------------------------------------------ attachments

_FILES = f"""
{views.GATE_ORACLE}, rows AS MATERIALIZED ({views.ORDER_FILES}),
e AS MATERIALIZED (SELECT scope, uid, parent_uid, thread_root_uid FROM gate WHERE skip_reason IS NULL),
cells AS (SELECT uid, name, sha256, count(*) AS n, any_value(size) AS size FROM rows WHERE bad = 0 GROUP BY 1, 2, 3),
pc AS (SELECT e.uid, c.name, c.sha256, c.n, c.size FROM e JOIN cells c ON c.uid = e.parent_uid), cc AS (SELECT e.uid, c.name, c.sha256, c.n, c.size FROM e JOIN cells c ON c.uid = e.uid),
both_ AS (SELECT coalesce(pc.uid, cc.uid) AS uid, coalesce(pc.name, cc.name) AS name, coalesce(pc.sha256, cc.sha256) AS sha256, coalesce(pc.n, 0) AS pn, coalesce(cc.n, 0) AS cn, pc.size AS ps, cc.size AS cs FROM pc FULL JOIN cc ON pc.uid = cc.uid AND pc.name = cc.name AND pc.sha256 = cc.sha256),
left_ AS MATERIALIZED (SELECT uid, 'p' AS side, name, sha256, pn - least(pn, cn) AS n, ps AS size FROM both_ WHERE pn > cn UNION ALL SELECT uid, 'c', name, sha256, cn - least(pn, cn), cs FROM both_ WHERE cn > pn),
units AS (SELECT *, row_number() OVER (PARTITION BY uid, side, sha256 ORDER BY name) AS k FROM (SELECT uid, side, name, sha256, size, unnest(generate_series(1, n)) AS u FROM left_)),
ren AS MATERIALIZED (SELECT p.uid, p.sha256, p.name AS pname, c.name AS cname, count(*) AS n, any_value(c.size) AS size FROM units p JOIN units c ON c.uid = p.uid AND c.sha256 = p.sha256 AND c.k = p.k AND p.side = 'p' AND c.side = 'c' GROUP BY 1, 2, 3, 4),
rest1 AS MATERIALIZED (SELECT l.uid, l.side, l.name, l.sha256, l.size, l.n - coalesce(x.used, 0) AS n FROM left_ l LEFT JOIN (SELECT uid, 'p' AS side, pname AS name, sha256, sum(n) AS used FROM ren GROUP BY 1, 2, 3, 4 UNION ALL SELECT uid, 'c', cname, sha256, sum(n) FROM ren GROUP BY 1, 2, 3, 4) x
  ON x.uid = l.uid AND x.side = l.side AND x.name = l.name AND x.sha256 = l.sha256 WHERE l.n > coalesce(x.used, 0)),
units2 AS (SELECT *, row_number() OVER (PARTITION BY uid, side, name ORDER BY sha256) AS k FROM (SELECT uid, side, name, sha256, size, unnest(generate_series(1, n::BIGINT)) AS u FROM rest1)),
chg AS MATERIALIZED (SELECT p.uid, p.name, p.sha256 AS psha, c.sha256 AS csha, count(*) AS n, any_value(c.size) AS size FROM units2 p JOIN units2 c ON c.uid = p.uid AND c.name = p.name AND c.k = p.k AND p.side = 'p' AND c.side = 'c' GROUP BY 1, 2, 3, 4),
rest2 AS (SELECT l.uid, l.side, l.name, l.sha256, l.size, l.n - coalesce(x.used, 0) AS n FROM rest1 l LEFT JOIN (SELECT uid, 'p' AS side, name, psha AS sha256, sum(n) AS used FROM chg GROUP BY 1, 2, 3, 4 UNION ALL SELECT uid, 'c', name, csha, sum(n) FROM chg GROUP BY 1, 2, 3, 4) x
  ON x.uid = l.uid AND x.side = l.side AND x.name = l.name AND x.sha256 = l.sha256 WHERE l.n > coalesce(x.used, 0)),
badm AS (SELECT uid, count(*) AS n FROM rows WHERE bad = 1 GROUP BY 1),
allev AS (SELECT uid, 0 AS rank, 'renamed' AS type, cname AS filename, pname AS previous_filename, sha256, NULL AS previous_sha256, n, size FROM ren
  UNION ALL SELECT uid, 1, 'content_changed', name, NULL, csha, psha, n, size FROM chg UNION ALL SELECT uid, CASE WHEN side = 'p' THEN 2 ELSE 3 END, CASE WHEN side = 'p' THEN 'removed' ELSE 'added' END, name, NULL, sha256, NULL, n, size FROM rest2),
marked AS MATERIALIZED (SELECT e.scope, e.parent_uid, e.thread_root_uid, a.*, ((type = 'removed' AND b.uid IS NOT NULL) OR (type = 'added' AND pb.uid IS NOT NULL)) AS hidden FROM allev a JOIN e ON e.uid = a.uid LEFT JOIN badm b ON b.uid = e.uid LEFT JOIN badm pb ON pb.uid = e.parent_uid),
ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY uid, rank, CASE WHEN rank = 0 THEN sha256 ELSE filename END, CASE WHEN rank = 0 THEN previous_filename WHEN rank = 1 THEN previous_sha256 ELSE sha256 END, CASE WHEN rank = 0 THEN filename ELSE sha256 END)::BIGINT AS seq FROM marked WHERE NOT hidden),
rv AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY uid, rank, pos)::BIGINT AS seq FROM (SELECT m.scope, r.uid, 0 AS rank, r.idx AS pos, 'undecodable_attachment' AS kind, r.name AS detail FROM rows r JOIN m ON m.uid = r.uid WHERE bad = 1
  UNION ALL SELECT scope, uid, 1, 0, skip_reason, claimed FROM gate WHERE skip_reason IN ('missing_parent', 'reference_conflict')))
"""


def _prepared_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(attachments.prepare(views.attachment_mails(spark, sf_dir)), "attachments")


def _attachments(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What several queries need; a query without differences does not come here."""
    prepared = _prepared_attachments(spark, sf_dir)
    diff = keep(attachments.differences(prepared), "attachment-differences")
    return {"prepared": prepared, "diff": diff, "events": attachments.events(diff), "reviews": attachments.reviews(prepared)}


@register("att_events", duck_sql(f"WITH {_FILES} SELECT scope, seq, uid, type, filename, previous_filename, sha256, previous_sha256, n::BIGINT AS count, size::BIGINT AS size FROM ev"))
def att_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attachments(spark, sf_dir)["events"].select("scope", "seq", "uid", "type", "filename", "previous_filename", "sha256", "previous_sha256", "count", "size")


@register("att_suppressed", duck_sql(f"WITH {_FILES} SELECT scope, uid, type, filename, sha256, n::BIGINT AS count FROM marked WHERE hidden"))
def att_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachments.suppressed(_attachments(spark, sf_dir)["diff"]).select("scope", "uid", "type", "filename", "sha256", "count")


@register("att_reviews", duck_sql(f"WITH {_FILES} SELECT scope, seq, uid, kind, detail FROM rv"))
def att_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attachments.reviews(_prepared_attachments(spark, sf_dir)).select("scope", "seq", "uid", "kind", "detail")


@register(
    "att_ledger",
    duck_sql(
        f"""WITH m AS ({views.ORDER_MAILS}), r AS ({views.ORDER_FILES}) SELECT m.scope, r.sha256, any_value(r.size)::BIGINT AS size, string_agg(DISTINCT r.name, ',' ORDER BY r.name) AS names, arg_min(r.uid, (m.date, r.uid, r.row_no)) AS first_uid, count(*)::BIGINT AS occurrence_count
        FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY idx) AS row_no FROM r WHERE bad = 0) r JOIN m ON m.uid = r.uid GROUP BY 1, 2"""
    ),
)
def att_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # contents of mails: no edge is compared
    out = attachments.ledger(attachments.split_attachments(views.attachment_mails(spark, sf_dir, edges=False)))
    return out.select("scope", "sha256", "size", text_of("names").alias("names"), "first_uid", "occurrence_count")


@register(
    "att_emails",
    duck_sql(
        f"""WITH {_FILES} SELECT g.scope, g.uid, coalesce(x.n, 0)::BIGINT AS attachment_count, coalesce(x.n - x.bad, 0)::BIGINT AS verifiable_count, coalesce(x.bad, 0)::BIGINT AS undecodable_count, g.skip_reason IS NULL AS compared, g.skip_reason,
        coalesce((SELECT string_agg(seq::VARCHAR, ',' ORDER BY seq) FROM ev WHERE ev.uid = g.uid), '') AS events, coalesce((SELECT string_agg(seq::VARCHAR, ',' ORDER BY seq) FROM rv WHERE rv.uid = g.uid), '') AS reviews, (SELECT count(*) FROM marked k WHERE k.uid = g.uid AND hidden)::BIGINT AS suppressed
        FROM gate g LEFT JOIN (SELECT uid, count(*) AS n, sum(bad) AS bad FROM rows GROUP BY 1) x ON x.uid = g.uid"""
    ),
)
def att_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attachments(spark, sf_dir)
    rows = attachments.email_rows(a["prepared"], a["events"], a["reviews"], a["diff"])
    plain = lambda c: F.array_join(F.transform(c, lambda x: F.regexp_replace(x, "^[ER]0*", "")), ",")
    return rows.select("scope", "uid", "attachment_count", "verifiable_count", "undecodable_count", "compared", "skip_reason", plain("event_ids").alias("events"), plain("review_ids").alias("reviews"), "suppressed")


@register(
    "att_stats",
    duck_sql(
        f"""WITH {_FILES}, s AS (SELECT g.scope, count(*) AS emails, count(x.n) AS with_files, sum(coalesce(x.n, 0)) AS files, sum(coalesce(x.bad, 0)) AS bad, count(*) FILTER (WHERE skip_reason IS NULL) AS compared FROM gate g LEFT JOIN (SELECT uid, count(*) AS n, sum(bad) AS bad FROM rows GROUP BY 1) x ON x.uid = g.uid GROUP BY 1)
        SELECT s.scope, emails::BIGINT AS emails, with_files::BIGINT AS emails_with_attachments, files::BIGINT AS attachments_total, (files - bad)::BIGINT AS attachments_verifiable, bad::BIGINT AS attachments_undecodable, compared::BIGINT AS edges_compared,
        (SELECT count(DISTINCT sha256) FROM rows r JOIN m ON m.uid = r.uid WHERE m.scope = s.scope AND bad = 0)::BIGINT AS unique_contents, (SELECT count(*) FROM ev WHERE ev.scope = s.scope)::BIGINT AS events_total, (SELECT coalesce(sum(n), 0) FROM ev WHERE ev.scope = s.scope)::BIGINT AS event_instances_total,
        {", ".join(f"(SELECT count(*) FROM ev WHERE ev.scope = s.scope AND type = '{t}')::BIGINT AS events_{t}, (SELECT coalesce(sum(n), 0) FROM ev WHERE ev.scope = s.scope AND type = '{t}')::BIGINT AS instances_{t}" for t in attachments.EVENT_TYPES)},
        (SELECT count(*) FROM rv WHERE rv.scope = s.scope)::BIGINT AS reviews_total, {", ".join(f"(SELECT count(*) FROM rv WHERE rv.scope = s.scope AND kind = '{k}')::BIGINT AS reviews_{k}" for k in attachments.REVIEW_KINDS)} FROM s"""
    ),
)
def att_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attachments(spark, sf_dir)
    rows = attachments.email_rows(a["prepared"], a["events"], a["reviews"], a["diff"])
    return attachments.stats(rows, a["events"], a["reviews"], attachments.ledger(a["prepared"]))


@register("qry_attachment_events", duck_sql(f"WITH {_FILES} SELECT scope, seq, uid, type, filename, previous_filename FROM ev WHERE filename = 'p3' OR previous_filename = 'p3'"))
def qry_attachment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_attachment_events(_attachments(spark, sf_dir)["events"], filename="p3").select("scope", "seq", "uid", "type", "filename", "previous_filename")


# --------------------------------------------------------------------- identity

_IDENTITY = f"""
RECURSIVE i AS MATERIALIZED ({views.IDENTITY_MAILS}),
s AS MATERIALIZED (SELECT *, subject = 'Re: Fwd: order' AS fwd FROM i),
edge AS MATERIALIZED (SELECT c.*, p.f_domain AS p_domain, p.f_address AS p_address FROM s c JOIN s p ON p.scope = c.scope AND p.uid = c.parent_uid),
chg AS MATERIALIZED (SELECT e.*, EXISTS (SELECT 1 FROM s a WHERE a.o_custkey = e.o_custkey AND a.thread_pos < e.thread_pos AND a.f_domain = e.f_domain) AS seen FROM edge e WHERE f_domain <> p_domain),
drift AS (SELECT scope, root_uid, lower(f_address) AS address FROM s WHERE f_address IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT m_domain) > 1),
roots AS (SELECT scope, uid AS root_uid, row_number() OVER (PARTITION BY scope ORDER BY date, uid) AS thread_rank FROM s WHERE parent_uid IS NULL),
raw AS (
  SELECT scope, 'from_domain_mismatch' AS type, CASE WHEN fwd THEN 'needs_review' ELSE 'observed' END AS status, uid AS lead, root_uid, 0 AS phase, 0 AS thread_rank, 0 AS part, uid AS place, 0 AS rank, '' AS address FROM s WHERE f_address IS NOT NULL AND r_domain <> f_domain
  UNION ALL SELECT scope, 'message_id_domain_drift', CASE WHEN fwd THEN 'needs_review' ELSE 'observed' END, uid, root_uid, 0, 0, 0, uid, 1, '' FROM s WHERE f_address IS NOT NULL AND m_domain <> f_domain
  UNION ALL SELECT scope, 'dkim_from_not_covered', 'observed', uid, root_uid, 0, 0, 0, uid, 2, '' FROM s WHERE f_address IS NOT NULL AND signed = 1 AND covered = 0
  UNION ALL SELECT c.scope, 'reply_identity_change', CASE WHEN seen THEN 'observed' ELSE 'needs_review' END, c.uid, c.root_uid, 1, r.thread_rank, 0, c.thread_pos, 0, '' FROM chg c JOIN roots r ON r.scope = c.scope AND r.root_uid = c.root_uid
  UNION ALL SELECT d.scope, 'message_id_domain_drift', 'needs_review', NULL, d.root_uid, 1, r.thread_rank, 1, 0, 0, d.address FROM drift d JOIN roots r ON r.scope = d.scope AND r.root_uid = d.root_uid),
found AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY phase, thread_rank, part, place, rank, address)::BIGINT AS seq FROM raw),
flags AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY phase, uid, rank)::BIGINT AS seq FROM (
  SELECT scope, uid, 0 AS phase, 0 AS rank, 'possible_forward' AS kind, subject AS detail FROM s WHERE fwd
  UNION ALL SELECT scope, uid, 0, 3, 'missing_header', CASE WHEN f_address IS NULL AND signed = 0 THEN 'From,DKIM-Signature' WHEN f_address IS NULL THEN 'From' ELSE 'DKIM-Signature' END FROM s WHERE f_address IS NULL OR signed = 0
  UNION ALL SELECT scope, uid, 1, 0, 'missing_header', 'parent:' || parent_uid FROM edge WHERE f_address IS NULL OR p_address IS NULL)),
checks AS MATERIALIZED (SELECT *, CASE WHEN f_address IS NULL THEN 'inconclusive' WHEN r_domain <> f_domain AND fwd THEN 'needs_review' ELSE 'observed' END AS c1, CASE WHEN f_address IS NULL THEN 'inconclusive' WHEN m_domain <> f_domain AND fwd THEN 'needs_review' ELSE 'observed' END AS c2,
  CASE WHEN f_address IS NULL OR signed = 0 THEN 'inconclusive' ELSE 'observed' END AS c3 FROM s)
"""


def _checked(spark: SparkSession, sf_dir: str, headers: bool = True) -> DataFrame:
    """Checked mails; without ``headers`` only what findings and threads are made of."""
    checked = identity.check_mails(identity.prepare(views.identity_mails(spark, sf_dir)))
    return keep(checked if headers else identity.finding_columns(checked), "identity")


def _found(checked: DataFrame) -> DataFrame:
    return keep(identity.findings(checked), "identity-findings")


@register("idn_findings", duck_sql(f"WITH {_IDENTITY} SELECT scope, seq, type, status, lead AS uid, root_uid, address FROM found"))
def idn_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(_checked(spark, sf_dir, headers=False))
    lead = F.when(F.col("part") == 0, F.col("node_uids")[0])
    return found.select("scope", "seq", "type", "status", lead.alias("uid"), "root_uid", "address")


@register("idn_flags", duck_sql(f"WITH {_IDENTITY} SELECT scope, seq, uid, kind, detail FROM flags"))
def idn_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.review_flags(_checked(spark, sf_dir)).select("scope", "seq", "uid", "kind", "detail")


@register("idn_emails", duck_sql(f"WITH {_IDENTITY} SELECT scope, uid, f_address AS from_address, f_domain AS from_domain, m_domain AS message_id_domain, c1, c2, c3 FROM checks"))
def idn_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity.email_reports(_checked(spark, sf_dir))
    return rows.select("scope", "uid", "from_address", "from_domain", "message_id_domain", *[F.col(f"{c}_status").alias(f"c{i}") for i, c in enumerate(identity.CHECKS, 1)])


@register(
    "idn_threads",
    duck_sql(
        f"""WITH {_IDENTITY} SELECT s.scope, s.root_uid, count(*)::BIGINT AS email_count, string_agg(coalesce(f_domain, '-') || '/' || m_domain, ',' ORDER BY thread_pos) AS domains,
        coalesce(any_value((SELECT string_agg(seq::VARCHAR, ',' ORDER BY seq) FROM found f WHERE f.scope = s.scope AND f.root_uid = s.root_uid AND phase = 1)), '') AS findings FROM s GROUP BY 1, 2"""
    ),
)
def idn_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _checked(spark, sf_dir, headers=False)
    rows = identity.thread_reports(checked, _found(checked))
    domains = F.array_join(F.transform("identity_sequence", lambda x: F.concat(F.coalesce(x["domain"], F.lit("-")), F.lit("/"), x["message_id_domain"])), ",")
    return rows.select("scope", "root_uid", "email_count", domains.alias("domains"), F.array_join(F.transform("finding_ids", lambda x: F.regexp_replace(x, "^F0*", "")), ",").alias("findings"))


@register(
    "idn_stats",
    duck_sql(
        f"""WITH {_IDENTITY}, t AS (SELECT scope, count(*) AS emails, count(*) FILTER (WHERE parent_uid IS NULL) AS thread_count, count(*) FILTER (WHERE c1 = 'inconclusive') AS i1, count(*) FILTER (WHERE c2 = 'inconclusive') AS i2, count(*) FILTER (WHERE c3 = 'inconclusive') AS i3 FROM checks GROUP BY 1)
        SELECT t.scope, emails::BIGINT AS emails, thread_count::BIGINT AS thread_count, i1::BIGINT AS inconclusive_from_domain_mismatch, i2::BIGINT AS inconclusive_message_id_domain_drift, i3::BIGINT AS inconclusive_dkim_from_not_covered,
        (SELECT count(*) FROM found f WHERE f.scope = t.scope)::BIGINT AS findings_total, {", ".join(f"(SELECT count(*) FROM found f WHERE f.scope = t.scope AND type = '{k}')::BIGINT AS findings_{k}" for k in identity.FINDING_TYPES)},
        {", ".join(f"(SELECT count(*) FROM found f WHERE f.scope = t.scope AND status = '{k}')::BIGINT AS status_{k}" for k in ("observed", "needs_review", "inconclusive"))},
        (SELECT count(*) FROM flags f WHERE f.scope = t.scope)::BIGINT AS review_flags_total, {", ".join(f"(SELECT count(*) FROM flags f WHERE f.scope = t.scope AND kind = '{k}')::BIGINT AS flags_{k}" for k in identity.REVIEW_KINDS)} FROM t"""
    ),
)
def idn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _checked(spark, sf_dir)
    return identity.stats(checked, _found(checked), identity.review_flags(checked))


@register(
    "qry_identity_threads",
    duck_sql(
        f"""WITH {_IDENTITY} SELECT f.scope, f.root_uid, t.email_count, string_agg(f.seq::VARCHAR, ',' ORDER BY f.seq) AS seqs, string_agg(f.status, ',' ORDER BY f.seq) AS statuses FROM found f
        JOIN (SELECT scope, root_uid, count(*)::BIGINT AS email_count FROM s GROUP BY 1, 2) t ON t.scope = f.scope AND t.root_uid = f.root_uid WHERE f.phase = 1 AND f.type = 'reply_identity_change' GROUP BY 1, 2, 3"""
    ),
)
def qry_identity_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _checked(spark, sf_dir, headers=False)
    found = _found(checked)
    kept = filters.filter_identity_threads(identity.thread_reports(checked, found), found, "reply_identity_change")
    return kept.select("scope", "root_uid", "email_count", text_of(F.col("findings")["seq"]).alias("seqs"), F.array_join(F.col("findings")["status"], ",").alias("statuses"))


@register(
    "qry_identity_findings",
    duck_sql(f"WITH {_IDENTITY} SELECT f.scope, f.seq, f.type FROM found f JOIN s ON s.scope = f.scope AND s.uid = f.lead WHERE f.phase = 0 AND f.type = 'from_domain_mismatch' AND f.status = 'observed' AND (s.f_domain = 'moved.example' OR s.r_domain = 'moved.example')"),
)
def qry_identity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_identity_findings(_found(_checked(spark, sf_dir, headers=False)), "from_domain_mismatch", "observed", "moved.example").select("scope", "seq", "type")


@register("qry_identity_emails", duck_sql(f"WITH {_IDENTITY} SELECT scope, uid FROM checks WHERE f_address IS NOT NULL AND m_domain <> f_domain AND c2 = 'observed' AND (f_domain = 'moved.example' OR m_domain = 'moved.example' OR r_domain = 'moved.example')"))
def qry_identity_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = identity.email_reports(_checked(spark, sf_dir))
    return filters.filter_identity_emails(rows, "message_id_domain_drift", "observed", "moved.example").select("scope", "uid")


# ---------------------------------------------------------------------- parsing


@register(
    "prs_html_text",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?i)<\s*/?\s*(br|p|div|tr|h[1-6]|li|ul|ol|table|blockquote)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
      '[ \t\r\f\x0b]+', ' ', 'g'), '(?m)^[ ]+|[ ]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\n ]+|[\n ]+$', '', 'g') AS body FROM pages""",
)
def prs_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", quotes.html_to_text_column(F.col("html")).alias("body"))


_QUOTED = "SELECT conv_id, turn, text || chr(10) || 'On day ' || turn || ', ' || role || ' wrote:' || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> > ') AS body FROM conversations"


@register(
    "prs_quote_lines",
    f"""WITH b AS ({_QUOTED}), l AS (SELECT conv_id, turn, unnest(string_split(body, chr(10))) AS line FROM b), k AS (SELECT conv_id, turn, CASE WHEN regexp_matches(line, '^On\\s.{{0,200}}?wrote:\\s*$') THEN 'on_wrote' ELSE '' END AS marker,
    CASE WHEN starts_with(line, '> > ') THEN 2 WHEN starts_with(line, '> ') THEN 1 ELSE 0 END AS level FROM l) SELECT conv_id, turn, marker, level::BIGINT AS level, count(*)::BIGINT AS n FROM k GROUP BY ALL""",
)
def prs_quote_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, role, newline = F.col("text"), F.col("role"), F.lit("\n")
    body = F.concat(text, newline, F.lit("On day "), F.col("turn").cast("string"), F.lit(", "), role, F.lit(" wrote:"), newline, F.lit("> "), F.replace(text, newline, F.lit("\n> > ")))
    lines = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.explode(F.split(body, "\n")).alias("line"))
    kinds = lines.select("conv_id", "turn", F.coalesce(quotes.separator_kind(F.col("line")), F.lit("")).alias("marker"), quotes.quote_level(F.col("line")).cast("long").alias("level"))
    return kinds.groupBy("conv_id", "turn", "marker", "level").agg(F.count(F.lit(1)).alias("n"))


# Bodies of a text of one's own, a line that opens a passage, what is in it, and what comes after; in four forms.
_SEGMENTED = """SELECT conv_id, turn, how, text, own, opener, passage, tail, own || chr(10) || opener || chr(10) || passage || tail AS body FROM (
  SELECT conv_id, turn, how, text, CASE WHEN how = 3 THEN text || chr(10) || '==========' || chr(10) || 'after a rule' ELSE text END AS own,
    CASE how WHEN 0 THEN 'On day ' || turn || ', ' || role || ' wrote:' WHEN 1 THEN '---- Forwarded message ----' WHEN 2 THEN 'From: a@b.example' || chr(10) || 'Sent: day ' || turn || chr(10) || 'To: c@d.example' ELSE '在 某日 ' || role || ' 写道：' END AS opener,
    '> first' || chr(10) || '> second' || chr(10) || 'bare' AS passage, chr(10) || chr(10) || '-- ' || chr(10) || chr(10) || 'the end' || chr(10) AS tail
  FROM (SELECT conv_id, turn, role, text, (conv_id + turn) % 4 AS how FROM conversations WHERE text <> '' AND trim(replace(text, chr(10), ' ')) <> '') x) y"""


@register(
    "prs_segments",
    f"""WITH b AS ({_SEGMENTED}),
    p AS (SELECT *, length(text) AS t, length(own) AS o, length(opener) AS n FROM b),
    parts AS (SELECT conv_id, turn, body, unnest(CASE WHEN how = 3 THEN [
        {{'k': 'own', 'l': 0, 'm': '', 'a': false, 's': 0, 'e': t}}, {{'k': 'separator', 'l': 0, 'm': '', 'a': true, 's': t + 1, 'e': t + 11}}, {{'k': 'own', 'l': 0, 'm': '', 'a': true, 's': t + 12, 'e': o}}]
      ELSE [{{'k': 'own', 'l': 0, 'm': '', 'a': false, 's': 0, 'e': o}}] END || [
        {{'k': 'separator', 'l': 0, 'm': CASE how WHEN 0 THEN 'on_wrote' WHEN 1 THEN 'forwarded_message' WHEN 2 THEN 'outlook_header' ELSE 'cn_daowen' END, 'a': false, 's': o + 1, 'e': o + 1 + n}},
        {{'k': CASE WHEN how IN (0, 3) THEN 'quote' ELSE 'forward' END, 'l': 1, 'm': '>', 'a': false, 's': o + n + 2, 'e': o + n + 18}},
        {{'k': CASE WHEN how IN (0, 3) THEN 'quote' ELSE 'forward' END, 'l': CASE WHEN how IN (0, 3) THEN 1 ELSE 0 END, 'm': CASE how WHEN 0 THEN 'on_wrote' WHEN 3 THEN 'cn_daowen' ELSE '' END, 'a': false, 's': o + n + 19, 'e': o + n + 24}},
        {{'k': 'separator', 'l': 0, 'm': 'signature', 'a': false, 's': o + n + 25, 'e': o + n + 28}}, {{'k': 'own', 'l': 0, 'm': '', 'a': false, 's': o + n + 29, 'e': length(body)}}]) AS x,
      generate_subscripts(CASE WHEN how = 3 THEN [1, 2, 3, 4, 5, 6, 7, 8] ELSE [1, 2, 3, 4, 5, 6] END, 1) - 1 AS i FROM p)
    SELECT conv_id, turn, i::BIGINT AS segment, x.k AS kind, x.l::BIGINT AS level, nullif(x.m, '') AS marker, x.a AS ambiguous, x.s::BIGINT AS char_start, x.e::BIGINT AS char_end, substr(body, x.s + 1, x.e - x.s) AS text FROM parts""",
)
def prs_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = keep(views.run(spark, sf_dir, _SEGMENTED).select("conv_id", "turn", "body"), "bodies")
    found = quote_segments.of_text(bodies, ["conv_id", "turn"], "body").select("conv_id", "turn", F.inline("segments"))
    return found.select("conv_id", "turn", F.col("index").cast("long").alias("segment"), "kind", F.col("level").cast("long").alias("level"), "marker", "ambiguous", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "text")


@register(
    "prs_headers",
    f"""WITH m AS ({views.duck_sql(views.IDENTITY_MAILS)}) SELECT scope, uid, message_id AS first_id, message_id || ',' || '<x' || (uid % 5) || '@y.z>' AS refs, f_domain AS domain, CASE WHEN f_address IS NULL THEN NULL ELSE f_address END AS normal, subject = 'Re: Fwd: order' AS forward, m_domain AS dkim_d, uid % 2 = 0 AS covers_from FROM m""",
)
def prs_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.run(spark, sf_dir, views.IDENTITY_MAILS)
    line = F.concat(F.lit("noise "), "message_id", F.lit(" tail"))
    refs = F.concat("message_id", F.lit("\t"), F.lit("bare@token <x"), (F.col("uid") % 5).cast("string"), F.lit("@y.z> "), "message_id")
    raw = F.concat(F.lit("v=1; a=rsa; d="), F.upper("m_domain"), F.lit("; d=other; s=k; h="), F.when(F.col("uid") % 2 == 0, "To:From").otherwise("To:Cc"), F.lit("; b=x"))
    signature = addresses.parse_dkim(raw)
    return m.select(
        "scope", "uid", addresses.first_msgid(line).alias("first_id"), text_of(addresses.references(refs)).alias("refs"), addresses.domain_of(F.upper("f_address")).alias("domain"),
        addresses.normalize_address(F.concat(F.substring_index("f_address", "@", 1), F.lit("@"), F.upper(F.substring_index("f_address", "@", -1)))).alias("normal"), addresses.is_forward(F.col("subject")).alias("forward"),
        signature["d"].alias("dkim_d"), signature["covers_from"].alias("covers_from"),
    )


@register("gate_edges", duck_sql(f"WITH {views.GATE_ORACLE} SELECT scope, uid, claimed, claimed_uid, skip_reason, skip_reason IS NULL AS compared FROM gate"))
def gate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate_edges(views._order_base(spark, sf_dir)).select("scope", "uid", "claimed", "claimed_uid", "skip_reason", "compared")
