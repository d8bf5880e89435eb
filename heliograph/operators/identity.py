"""Declared identity: what a mail's own headers say about its sender, compared and never judged.

Differences of domains are ``observed``; with signs of forwarding or of a list
they ``needs_review``; without the headers that a check rests on it is
``inconclusive``.  No signature is verified and nothing is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.addresses import is_forward
from heliograph.lineage import cut, keep
from heliograph.operators.gate import numbered
from heliograph.operators.ranking import block_of, numbered_from
from heliograph.operators.recipients import list_hints

FINDING_TYPES = ("from_domain_mismatch", "reply_identity_change", "message_id_domain_drift", "dkim_from_not_covered")
REVIEW_KINDS = ("possible_forward", "possible_mailing_list", "missing_header", "header_parse_anomaly")
CHECKS = ("from_domain_mismatch", "message_id_domain_drift", "dkim_from_not_covered")

_TEXTS = "array<string>"


def _first(c: Column) -> Column:
    return F.get(c, F.lit(0))


def _set(c: Column) -> Column:
    return F.when(c != "", c)


def prepare(mails: DataFrame) -> DataFrame:
    """``mails`` with the values that the checks read, and the signals of their context.

    Adds ``f_present, f_address, f_name, f_domain`` (first From), ``m_present,
    m_value, m_domain`` (first Message-ID header), ``hints`` and ``signals``.
    """
    i = F.col("identity")
    f, m = _first(i["from"]), _first(i["message_id"]["headers"])
    out = mails.withColumns(
        {
            "f_present": f.isNotNull(), "f_address": _set(f["address"]), "f_name": _set(f["name"]), "f_domain": _set(f["domain"]),
            "m_present": m.isNotNull(), "m_value": _set(m["value"]), "m_domain": _set(m["domain"]), "hints": list_hints(i, None, group_syntax=False), "forward": is_forward(F.col("subject")),
        }
    )
    return out.withColumn("signals", F.array_compact(F.array(F.when(F.col("forward"), "possible_forward"), F.when(F.size("hints") > 0, "possible_mailing_list"))))


def _compared(header: str, entries: Column) -> Column:
    return F.transform(
        F.coalesce(entries, F.expr("array()")),
        lambda e: F.struct(F.lit(header).alias("header"), e["index"].cast("int").alias("index"), e["address"].alias("address"), _set(e["domain"]).alias("domain"), F.when(e["domain"] != "", e["domain"] == F.col("f_domain")).alias("match")),
    )


def check_mails(prepared: DataFrame) -> DataFrame:
    """The three checks of every mail: ``<check>_status`` and ``<check>_match``, with their evidence."""
    i = F.col("identity")
    out = prepared.withColumn("comparisons", F.concat(_compared("Sender", i["sender"]), _compared("Return-Path", i["return_path"])))
    out = out.withColumn("mismatched", F.filter("comparisons", lambda c: F.coalesce(~c["match"], F.lit(False))))
    reviewed = F.when(F.size("signals") > 0, "needs_review").otherwise("observed")
    differs = F.size("mismatched") > 0
    known = F.col("f_address").isNotNull()
    a, b, c = CHECKS
    dkim = F.coalesce(i["dkim"], F.expr("array()"))
    covers = lambda d: F.coalesce(d["covers_from"], F.lit(False))
    uncovered = F.filter(dkim, lambda d: ~covers(d))
    doubtful = F.exists(dkim, covers) | F.exists(uncovered, lambda d: F.coalesce(F.size(d["h"]), F.lit(0)) <= 0)
    usable = F.col("m_present") & known & F.col("m_domain").isNotNull() & F.col("f_domain").isNotNull()
    return out.withColumns(
        {
            f"{a}_status": F.when(~known, "inconclusive").when(differs, reviewed).when(F.col("f_domain").isNull(), "inconclusive").otherwise("observed"),
            f"{a}_match": F.when(known & differs, False).when(known & F.col("f_domain").isNotNull(), True),
            f"{b}_status": F.when(~usable, "inconclusive").when(F.col("m_domain") == F.col("f_domain"), "observed").otherwise(reviewed),
            f"{b}_match": F.when(usable, F.col("m_domain") == F.col("f_domain")),
            "signatures": F.size(dkim).cast("long"),
            "uncovered": F.size(uncovered).cast("long"),
            f"{c}_status": F.when((F.size(dkim) == 0) | ~known, "inconclusive").when(F.size(uncovered) == 0, "observed").when(doubtful, "needs_review").otherwise("observed"),
            f"{c}_match": F.when((F.size(dkim) > 0) & known & (F.size(uncovered) > 0), False),
        }
    )


def ancestor_domains(prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, uid, seen_domains): distinct From domains of all ancestors of every reply, by doubling.

    A mail's set over 2k mails upwards, itself included, is the union of its set
    over k and that of the mail it then points at, so rounds grow with the
    logarithm of depth; sets hold distinct domains, not chains.  Mails that have
    come to their root are only looked up from then on.
    """
    none = F.array().cast(_TEXTS)
    now = prepared.select(scope, "uid", F.array_compact(F.array("f_domain")).alias("domains"), F.col("parent_uid").alias("at"))
    done, open_ = now.where("at IS NULL"), now.where("at IS NOT NULL")
    while open_.limit(1).count():
        ahead = done.unionByName(open_).select(scope, F.col("uid").alias("at"), F.col("domains").alias("more"), F.col("at").alias("next"))
        met = open_.join(ahead, [scope, "at"], "left")
        now = cut(met.select(scope, "uid", F.array_union("domains", F.coalesce("more", none)).alias("domains"), F.col("next").alias("at")))
        done, open_ = done.unionByName(now.where("at IS NULL")), now.where("at IS NOT NULL")
    above = done.select(scope, F.col("uid").alias("parent_uid"), F.col("domains").alias("seen_domains"))
    return prepared.where("parent_uid IS NOT NULL").select(scope, "uid", "parent_uid").join(above, [scope, "parent_uid"]).select(scope, "uid", "seen_domains")


def _with_parent(prepared: DataFrame, scope: str, own: list[str], up: dict[str, str]) -> DataFrame:
    parent = prepared.select(scope, F.col("uid").alias("parent_uid"), *[F.col(c).alias(name) for c, name in up.items()])
    return prepared.where("parent_uid IS NOT NULL").select(scope, "uid", "parent_uid", *own).join(parent, [scope, "parent_uid"])


def unusable_edges(prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """Edges on which a change of the From domain cannot be told, as one end has no From."""
    met = _with_parent(prepared, scope, ["f_present"], {"f_present": "p_present"})
    return met.where("NOT f_present OR NOT p_present").select(F.col(scope).alias("scope"), "uid", "parent_uid")


def reply_changes(prepared: DataFrame, scope: str = "scope", place: str = "thread_pos") -> DataFrame:
    """Edges on which the From domain changes, and whether an ancestor had the new domain (``seen_before``).

    ``place`` numbers the mails of a thread, ancestors first.  A domain whose
    first mail in the thread comes no earlier was not seen.  If every later mail
    hangs under the mail before it or under one no earlier than that first mail,
    then the first mail is an ancestor of all of them, so the domain was seen.
    Only threads where neither decides are followed upwards.
    """
    mails = prepared.withColumn("place", F.col(place))
    own = ["root_uid", "place", "f_present", "f_domain", "f_name", "f_address", "signals"]
    met = _with_parent(mails, scope, own, {"f_present": "p_present", "f_domain": "p_domain", "f_name": "p_name", "f_address": "p_address", "place": "p_place"})
    changed = F.coalesce(F.col("f_present") & F.col("p_present") & (F.col("f_domain") != F.col("p_domain")), F.lit(False))
    aside = F.coalesce(F.col("p_place") != F.col("place") - 1, F.lit(True))
    same_name = F.coalesce(F.col("f_name") == F.col("p_name"), F.lit(False))
    met = met.select(
        scope, "uid", "parent_uid", "root_uid", "place", "p_place", "f_address", "f_domain", "p_address", "p_domain", same_name.alias("same_name"), (F.size("signals") == 0).alias("plain"), changed.alias("changed"), aside.alias("aside")
    )
    met = keep(met.where("changed OR aside"), "identity-edges")
    bent = met.where("aside").groupBy(scope, "root_uid").agg(F.min("p_place").alias("bent"))
    first = mails.where("f_domain IS NOT NULL").groupBy(scope, "root_uid", "f_domain").agg(F.min("place").alias("first"))
    told = met.where("changed").join(first, [scope, "root_uid", "f_domain"]).join(bent, [scope, "root_uid"], "left")
    under = F.col("bent").isNull() | (F.col("first") <= F.col("bent"))
    told = keep(told.withColumn("seen", F.when(F.col("first") >= F.col("place"), False).when(under, True)).drop("first", "bent", "changed", "aside", "p_place"), "identity-changes")
    unclear = told.where("seen IS NULL")
    if unclear.limit(1).count():
        inside = keep(mails.select(scope, "root_uid", "uid", "parent_uid", "f_domain").join(unclear.select(scope, "root_uid").distinct(), [scope, "root_uid"], "left_semi"), "identity-unclear")
        followed = unclear.join(ancestor_domains(inside, scope), [scope, "uid"], "left").withColumn("seen", F.coalesce(F.array_contains("seen_domains", F.col("f_domain")), F.lit(False)))
        told = told.where("seen IS NOT NULL").unionByName(followed.select(*told.columns))
    status = F.when(F.col("seen") | (F.col("same_name") & F.col("plain")), "observed").otherwise("needs_review")
    return told.select(
        F.col(scope).alias("scope"), "uid", "parent_uid", "root_uid", "place", "f_address", "f_domain", "p_address", "p_domain", "same_name", F.col("seen").alias("seen_before"), F.lit(True).alias("parent_established"), status.alias("status")
    )


def thread_drifts(prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """Senders whose Message-ID domains differ inside one thread."""
    usable = prepared.where("f_address IS NOT NULL AND m_domain IS NOT NULL")
    groups = usable.groupBy(F.col(scope).alias("scope"), "root_uid", F.lower("f_address").alias("address")).agg(
        F.array_sort(F.collect_set("m_domain")).alias("domains"), F.array_sort(F.collect_list("uid")).alias("node_uids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("signals")))).alias("signals")
    )
    return groups.where(F.size("domains") > 1).withColumn("status", F.lit("needs_review"))


def finding_columns(checked: DataFrame, scope: str = "scope", place: str = "thread_pos") -> DataFrame:
    """What ``findings`` and ``thread_reports`` read of checked mails: few values instead of all their headers."""
    signed_by = F.transform(F.col("identity")["dkim"], lambda d: F.struct(d["d"].alias("d"), d["i_domain"].alias("i_domain")))
    return checked.select(
        scope, "uid", "parent_uid", "root_uid", place, "date", "f_present", "f_address", "f_name", "f_domain", "m_domain", "signals", F.transform("mismatched", lambda m: F.struct(m["domain"].alias("domain"))).alias("mismatched"),
        F.struct(signed_by.alias("dkim")).alias("identity"), *[f"{c}_{part}" for c in CHECKS for part in ("status", "match")],
    )


def findings(checked: DataFrame, scope: str = "scope", place: str = "thread_pos") -> DataFrame:
    """All findings, numbered: mails by uid (mismatch, id, DKIM), then thread by thread (changes in reading order, drifts by address).

    ``place`` is the column with a mail's place in its thread.  Threads follow
    the order of their roots (date, then uid).
    """
    a, b, c = CHECKS
    base = F.col(scope).alias("scope")

    def of_mail(check: str, rank: int, domains: Column) -> DataFrame:
        return checked.where(F.col(f"{check}_match") == F.lit(False)).select(
            base, F.lit(check).alias("type"), F.lit("email").alias("level"), F.col(f"{check}_status").alias("status"), F.array("uid").alias("node_uids"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("thread_rank"), F.lit(0).alias("part"),
            F.col("uid").alias("place"), F.lit(rank).alias("rank"), F.lit("").alias("address"), "root_uid", domains.alias("domains"),
        )

    distinct = lambda x: F.array_sort(F.array_distinct(F.array_compact(x)))
    parts = [
        of_mail(a, 0, distinct(F.concat(F.array("f_domain"), F.transform("mismatched", lambda m: m["domain"])))),
        of_mail(b, 1, distinct(F.array("m_domain", "f_domain"))),
        of_mail(c, 2, distinct(F.concat(F.array("f_domain"), F.transform(F.col("identity")["dkim"], lambda d: _set(d["d"])), F.transform(F.col("identity")["dkim"], lambda d: _set(d["i_domain"]))))),
    ]
    roots = checked.where("parent_uid IS NULL").select(base, F.col("uid").alias("root_uid"), F.coalesce("date", F.lit("")).alias("__date"))
    roots = numbered_from(roots, ["scope"], ["__date", "root_uid"], "thread_rank", first=1).drop("__date")
    of_threads = [
        reply_changes(checked, scope, place).join(roots, ["scope", "root_uid"]).select(
            "scope", F.lit("reply_identity_change").alias("type"), F.lit("thread").alias("level"), "status", F.array("uid", "parent_uid").alias("node_uids"), F.lit(1).alias("phase"), "thread_rank", F.lit(0).alias("part"), "place", F.lit(0).alias("rank"),
            F.lit("").alias("address"), "root_uid", F.array_sort(F.array("f_domain", "p_domain")).alias("domains"),
        ),
        thread_drifts(checked, scope).join(roots, ["scope", "root_uid"]).select(
            "scope", F.lit("message_id_domain_drift").alias("type"), F.lit("thread").alias("level"), "status", "node_uids", F.lit(1).alias("phase"), "thread_rank", F.lit(1).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("rank"), "address", "root_uid", "domains"
        ),
    ]
    # they are counted and then numbered, but joined once
    parts.append(keep(of_threads[0].unionByName(of_threads[1]), "identity-threads"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return numbered(out, "scope", "phase", "thread_rank", "part", "place", "rank", "address", blocks=[F.col("phase"), block_of("thread_rank"), F.when(F.col("phase") == 0, block_of("place")).otherwise(0)], prefix="F")


def review_flags(checked: DataFrame, scope: str = "scope") -> DataFrame:
    """Review flags: of each mail forward, list, parse anomalies, missing headers; then unusable reply edges."""
    base = [F.col(scope).alias("scope"), "uid"]
    i = F.col("identity")

    def rows(df: DataFrame, phase: int, rank: int, kind: str, detail: Column, headers: Column, pos: Column | None = None) -> DataFrame:
        return df.select(*base, F.lit(phase).alias("phase"), F.lit(rank).alias("rank"), (F.lit(0) if pos is None else pos).alias("pos"), F.lit(kind).alias("kind"), detail.alias("detail"), headers.alias("headers"))

    words = lambda *x: F.array(*[F.lit(w) for w in x])
    lacking = F.array_compact(F.array(F.when(~F.col("f_present"), "From"), F.when(~F.coalesce(i["message_id"]["present"], F.lit(False)), "Message-ID"), F.when(F.coalesce(F.size(i["dkim"]), F.lit(0)) <= 0, "DKIM-Signature")))
    odd = F.array_distinct(F.transform(F.coalesce(i["anomalies"], F.expr("array()")), lambda a: F.struct(a["header"].alias("header"), a["index"].alias("index"), a["detail"].alias("detail"))))
    anomalies = checked.select(scope, "uid", F.posexplode(odd).alias("pos", "a"))
    missing = checked.withColumn("lacking", lacking)
    parts = [
        rows(checked.where("forward"), 0, 0, "possible_forward", F.col("subject"), words("Subject")),
        rows(checked.where(F.size("hints") > 0), 0, 1, "possible_mailing_list", F.array_join("hints", ","), words("From", "Sender", "Reply-To")),
        rows(anomalies, 0, 2, "header_parse_anomaly", F.col("a.detail"), F.array("a.header"), F.col("pos")),
        rows(missing.where(F.size("lacking") > 0), 0, 3, "missing_header", F.array_join("lacking", ","), F.col("lacking")),
    ]
    edges = unusable_edges(checked, scope).select(F.col("scope"), "uid", F.lit(1).alias("phase"), F.lit(0).alias("rank"), F.lit(0).alias("pos"), F.lit("missing_header").alias("kind"), F.concat(F.lit("parent:"), F.col("parent_uid").cast("string")).alias("detail"), words("From", "In-Reply-To").alias("headers"))
    out = parts[0]
    for part in [*parts[1:], edges]:
        out = out.unionByName(part)
    return numbered(out, "scope", "phase", "uid", "rank", "pos", blocks=[F.col("phase"), block_of("uid")], prefix="R")


def email_reports(checked: DataFrame, scope: str = "scope") -> DataFrame:
    i = F.col("identity")
    domains = lambda c: F.transform(F.coalesce(c, F.expr("array()")), lambda e: e["domain"])
    return checked.select(
        F.col(scope).alias("scope"), "uid", F.col("m_value").alias("message_id"), F.col("f_address").alias("from_address"), F.col("f_domain").alias("from_domain"), domains(i["sender"]).alias("sender_domains"), domains(i["return_path"]).alias("return_path_domains"),
        domains(i["reply_to"]).alias("reply_to_domains"), F.col("m_domain").alias("message_id_domain"), F.transform(i["dkim"], lambda d: d["d"]).alias("dkim_domains"), F.transform(i["dkim"], lambda d: d["i_domain"]).alias("dkim_i_domains"), "signals",
        *[f"{c}_{part}" for c in CHECKS for part in ("status", "match")],
    )


def thread_reports(checked: DataFrame, found: DataFrame, scope: str = "scope", place: str = "thread_pos") -> DataFrame:
    """One row a thread: its mails in reading order with their identity, and the thread's findings."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "uid", F.col("f_address").alias("address"), F.col("f_domain").alias("domain"), F.col("m_domain").alias("message_id_domain")))), lambda x: F.struct(x["uid"], x["address"], x["domain"], x["message_id_domain"]))
    threads = checked.groupBy(F.col(scope).alias("scope"), "root_uid").agg(F.count(F.lit(1)).alias("email_count"), F.array_sort(F.collect_list("uid")).alias("node_uids"), seq.alias("identity_sequence"))
    ids = found.where("level = 'thread'").groupBy("scope", "root_uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("finding_ids"))
    return threads.join(ids, ["scope", "root_uid"], "left").withColumn("finding_ids", F.coalesce("finding_ids", F.array().cast(_TEXTS)))


def stats(checked: DataFrame, found: DataFrame, flags: DataFrame, scope: str = "scope") -> DataFrame:
    """The measures of each scope, zeros included."""
    parts = [
        checked.groupBy(F.col(scope).alias("scope")).agg(
            F.count(F.lit(1)).alias("emails"), F.count_if(F.col("parent_uid").isNull()).alias("thread_count"), *[F.count_if(F.col(f"{c}_status") == "inconclusive").alias(f"inconclusive_{c}") for c in CHECKS]
        ),
        found.groupBy("scope").agg(
            F.count(F.lit(1)).alias("findings_total"), *[F.count_if(F.col("type") == t).alias(f"findings_{t}") for t in FINDING_TYPES], *[F.count_if(F.col("status") == t).alias(f"status_{t}") for t in ("observed", "needs_review", "inconclusive")]
        ),
        flags.groupBy("scope").agg(F.count(F.lit(1)).alias("review_flags_total"), *[F.count_if(F.col("kind") == k).alias(f"flags_{k}") for k in REVIEW_KINDS]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "scope", "left")
    return out.select("scope", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c != "scope"])
