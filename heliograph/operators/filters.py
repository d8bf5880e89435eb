"""Read-time filters over analysis results, compact views, and checked parameters."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.addresses import filter_key, same_or_below
from heliograph.functions.dates import instant_us
from heliograph.operators import attachments, identity, recipients, timing


class BadParameter(ValueError):
    """A filter value that no query can be built from."""


def one_of(name: str, value: str | None, allowed: tuple[str, ...]) -> str | None:
    if value is not None and value not in allowed:
        raise BadParameter(f"{name} must be one of {', '.join(allowed)}")
    return value


def instant(name: str, value: str | None) -> int | None:
    """Microseconds of an ISO time; the zone is mandatory."""
    if value is None:
        return None
    try:
        when = datetime.fromisoformat(value.replace(" ", "+") if re.search(r" \d{2}:\d{2}$", value) and "T" in value else value)
    except ValueError as e:
        raise BadParameter(f"{name} is not an ISO time") from e
    if when.tzinfo is None:
        raise BadParameter(f"{name} needs a zone")
    zero = datetime.fromisoformat("1970-01-01T00:00:00+00:00")
    delta = when - zero
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def domain_name(value: str | None) -> str | None:
    """A domain in small letters without outer blanks; blank, over-long and broken ones are refused."""
    if value is None:
        return None
    value = value.strip().lower()
    if not value:
        raise BadParameter("domain is empty")
    if len(value) > 253 or any(c.isspace() for c in value):
        raise BadParameter("domain is not a domain name")
    return value


def filter_timeline(timeline: DataFrame, start: str | None = None, end: str | None = None, kind: str | None = None) -> DataFrame:
    """Entries inside the inclusive range (untimed ones never are), with only the findings of ``kind``.

    With ``kind``, entries without such a finding are dropped.
    """
    lo, hi = instant("from", start), instant("to", end)
    if lo is not None and hi is not None and lo > hi:
        raise BadParameter("from lies after to")
    one_of("type", kind, timing.FINDING_TYPES)
    out = timeline
    if lo is not None:
        out = out.where(F.col("time_us") >= lo)
    if hi is not None:
        out = out.where(F.col("time_us") <= hi)
    if kind is not None:
        kept = F.filter(F.arrays_zip("finding_ids", "finding_types"), lambda x: x["finding_types"] == kind)
        out = out.withColumn("__kept", kept).where(F.size("__kept") > 0)
        out = out.withColumn("finding_ids", F.transform("__kept", lambda x: x["finding_ids"])).withColumn("finding_types", F.transform("__kept", lambda x: x["finding_types"])).drop("__kept")
    return out


def filter_identity_findings(found: DataFrame, kind: str | None = None, status: str | None = None, domain: str | None = None) -> DataFrame:
    """By type, status, and any evidence domain that equals ``domain`` or lies below it."""
    one_of("type", kind, identity.FINDING_TYPES)
    one_of("status", status, ("observed", "needs_review", "inconclusive"))
    domain = domain_name(domain)
    out = found
    if kind is not None:
        out = out.where(F.col("type") == kind)
    if status is not None:
        out = out.where(F.col("status") == status)
    if domain is not None:
        out = out.where(F.exists("domains", lambda d: same_or_below(d, domain)))
    return out


def filter_identity_flags(flags: DataFrame, domain: str | None = None) -> DataFrame:
    """Review flags take only the domain, as a part of their text."""
    domain = domain_name(domain)
    return flags if domain is None else flags.where(F.lower(F.coalesce("detail", F.lit(""))).contains(domain))


def filter_identity_emails(reports: DataFrame, kind: str | None = None, status: str | None = None, domain: str | None = None) -> DataFrame:
    """``kind`` keeps real differences of that check; status observed means a difference as well."""
    one_of("type", kind, identity.FINDING_TYPES)
    one_of("status", status, ("observed", "needs_review", "inconclusive"))
    domain = domain_name(domain)
    checks = [c for c in identity.CHECKS if kind in (None, c)]
    differs = lambda c: F.coalesce(~F.col(f"{c}_match"), F.lit(False))
    out = reports
    if kind is not None and not checks:
        return out.where(F.lit(False))
    if status is not None:
        is_status = lambda c: F.col(f"{c}_status") == status
        hit = [is_status(c) & (differs(c) if status == "observed" or (kind is not None and status != "inconclusive") else F.lit(True)) for c in checks]
        out = out.where(_any(hit))
    elif kind is not None:
        out = out.where(_any([differs(c) for c in checks]))
    if domain is not None:
        lists = ("sender_domains", "return_path_domains", "reply_to_domains", "dkim_domains", "dkim_i_domains")
        hit = [F.coalesce(same_or_below(F.col(c), domain), F.lit(False)) for c in ("from_domain", "message_id_domain")]
        hit += [F.coalesce(F.exists(c, lambda d: same_or_below(d, domain)), F.lit(False)) for c in lists]
        out = out.where(_any(hit))
    return out


def _any(conditions: list) -> object:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def filter_identity_threads(threads: DataFrame, found: DataFrame, kind: str | None = None, domain: str | None = None) -> DataFrame:
    """Threads with their thread-level ``findings`` that match, in order of number; without filters all threads.

    With a filter, threads without such a finding are dropped.  Status does not count here.
    """
    hits = filter_identity_findings(found, kind, None, domain).where("level = 'thread'")
    one = F.struct("seq", "id", "type", "status", "node_uids", "address", "domains")
    listed = hits.groupBy("scope", "root_uid").agg(F.array_sort(F.collect_list(one)).alias("findings"))
    out = threads.join(listed, ["scope", "root_uid"], "left" if kind is None and domain is None else "inner")
    return out.withColumn("findings", F.coalesce("findings", F.array()).cast(listed.schema["findings"].dataType))


def filter_attachment_events(events: DataFrame, kind: str | None = None, thread: int | None = None, filename: str | None = None, sha256: str | None = None) -> DataFrame:
    """Names and hashes match the current or the previous value."""
    one_of("type", kind, attachments.EVENT_TYPES)
    out = events
    if kind is not None:
        out = out.where(F.col("type") == kind)
    if thread is not None:
        out = out.where(F.col("thread_root_uid") == thread)
    if filename is not None:
        out = out.where((F.col("filename") == filename) | F.coalesce(F.col("previous_filename") == filename, F.lit(False)))
    if sha256 is not None:
        if not re.fullmatch(r"[0-9a-fA-F]{64}", sha256):
            raise BadParameter("sha256 must have 64 hexadecimal digits")
        low = sha256.lower()
        out = out.where((F.col("sha256") == low) | F.coalesce(F.col("previous_sha256") == low, F.lit(False)))
    return out


def filter_attachment_reviews(reviews: DataFrame, kind: str | None = None, thread: int | None = None, filename: str | None = None) -> DataFrame:
    """An event type hides reviews, as they have none."""
    if kind is not None:
        return reviews.where(F.lit(False))
    out = reviews if thread is None else reviews.where(F.col("thread_root_uid") == thread)
    return out if filename is None else out.where((F.col("kind") == "undecodable_attachment") & (F.col("detail") == filename))


def filter_attachment_ledger(ledger: DataFrame, sha256: str | None = None, filename: str | None = None) -> DataFrame:
    out = ledger if sha256 is None else ledger.where(F.col("sha256") == sha256.lower())
    return out if filename is None else out.where(F.array_contains("names", filename))


def filter_recipient_events(events: DataFrame, kind: str | None = None, thread: int | None = None, address: str | None = None) -> DataFrame:
    """``address`` matches the event's own address in its normal form."""
    one_of("type", kind, recipients.EVENT_TYPES)
    out = events if kind is None else events.where(F.col("type") == kind)
    if thread is not None:
        out = out.where(F.col("thread_root_uid") == thread)
    return out if address is None else out.where(F.col("address") == filter_key(address))


def filter_recipient_reviews(reviews: DataFrame, prepared: DataFrame, kind: str | None = None, thread: int | None = None, address: str | None = None, scope: str = "scope") -> DataFrame:
    """``address`` keeps reviews whose mail, or a mail beside it, has the address in a visible set."""
    one_of("kind", kind, recipients.REVIEW_KINDS)
    out = reviews if kind is None else reviews.where(F.col("kind") == kind)
    if thread is not None:
        out = out.where(F.col("thread_root_uid") == thread)
    if address is None:
        return out
    has = prepared.where(F.array_contains("people", filter_key(address))).select(F.col(scope).alias("scope"), F.col("uid").alias("who"))
    about = out.select("scope", "seq", F.explode(F.array_union(F.array("uid"), "candidate_uids")).alias("who")).join(has, ["scope", "who"], "left_semi").select("scope", "seq").distinct()
    return out.join(about, ["scope", "seq"], "left_semi")


def filter_recipient_threads(threads: DataFrame, events: DataFrame, thread: int | None = None, address: str | None = None) -> DataFrame:
    """Threads with ``matched_events``; with an address only threads where it has an event.  An event type does not count here."""
    hits = filter_recipient_events(events, None, thread, address)
    matched = hits.groupBy("scope", "thread_root_uid").agg(F.count(F.lit(1)).alias("matched_events"))
    out = threads if thread is None else threads.where(F.col("thread_root_uid") == thread)
    out = out.join(matched, ["scope", "thread_root_uid"], "left" if address is None else "inner")
    return out.withColumn("matched_events", F.coalesce("matched_events", F.lit(0)).cast("long"))


def filter_addresses(ledger: DataFrame, address: str | None = None) -> DataFrame:
    return ledger if address is None else ledger.where(F.col("address") == filter_key(address))


def compact_package_view(forest: DataFrame, scope: str = "scope") -> DataFrame:
    """The eight scalars of a mail in a package's tree, with its place."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return forest.select(F.col(scope).alias("scope"), "uid", "parent_uid", "message_id", "subject", F.col("from.address").alias("from_address"), "date", "source_file", size("attachments").alias("attachment_count"), size("issues").alias("issue_count"))


def compact_case_view(nodes: DataFrame) -> DataFrame:
    return nodes.select("case_id", "uid", "parent_uid", "message_id", "subject", F.col("from.address").alias("from_address"), "date", "source_count", "conflict", (F.size("relinked_for") > 0).alias("relinked"))


def latest(rows: DataFrame, by: str = "created_at", limit: int = 100) -> DataFrame:
    """The newest entries of a list."""
    return rows.orderBy(F.desc(by)).limit(limit)


def dated_between(rows: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows whose ISO time (with a zone) lies in the inclusive range."""
    lo, hi = instant("from", start), instant("to", end)
    us = instant_us(F.col(column))
    out = rows if lo is None else rows.where(us >= lo)
    return out if hi is None else out.where(us <= hi)
