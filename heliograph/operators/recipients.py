"""Recipient flow: visible addresses followed along reply edges.

Only From, To and Cc are looked at; nothing is concluded about who received a
mail.  Edges with signs of a list, or with addresses that have no normal form
on either side, are reported for review instead of giving events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.addresses import has_list_address, malformed_reason, normalize_address, strip_text
from heliograph.lineage import keep, tasks_for
from heliograph.operators.gate import TASK_MAILS, gated, id_groups, numbered
from heliograph.operators.ranking import block_of

EVENT_TYPES = ("added", "dropped", "role_changed", "reply_all_omitted")
REVIEW_KINDS = ("possible_mailing_list", "malformed_address", "missing_parent", "reference_conflict")

_TEXTS = "array<string>"
#: Mails of a claimed id in one slice, and pairs of a mail and a candidate that a task makes, about.
SLICE_MAILS, TASK_PAIRS = 256, 500_000
#: Events that a task numbers, about.
TASK_EVENTS = 250_000


def _none(kind: str = _TEXTS) -> Column:
    return F.array().cast(kind)


def visible_addresses(mails: DataFrame) -> DataFrame:
    """``mails`` with ``c_from, c_to, c_cc`` (sorted sets of normal forms), ``people``, ``entries`` and ``malformed``.

    ``entries`` are (key, name, field) in order of appearance, the first of each
    key; ``malformed`` are (field, raw, name, reason).  Empty addresses are
    ignored.  An address in To that is also in Cc belongs to both.
    """
    sender = F.when(F.col("from").isNotNull(), F.array(F.struct(F.lit("From").alias("field"), F.coalesce(F.col("from.name"), F.lit("")).alias("name"), F.coalesce(F.col("from.address"), F.lit("")).alias("address"))))

    def listed(column: str, field: str) -> Column:
        return F.transform(F.col(column), lambda x: F.struct(F.lit(field).alias("field"), F.coalesce(x["name"], F.lit("")).alias("name"), F.coalesce(x["address"], F.lit("")).alias("address")))

    empty = F.array().cast("array<struct<field:string,name:string,address:string>>")
    raw = F.concat(F.coalesce(sender, empty), F.coalesce(listed("to", "To"), empty), F.coalesce(listed("cc", "Cc"), empty))
    # each step is a column of its own, so that nothing is worked out again for every address
    stripped = F.transform(raw, lambda x: F.struct(x["field"].alias("field"), x["name"].alias("name"), strip_text(x["address"]).alias("raw")))
    keyed = F.transform(stripped, lambda x: F.struct(x["field"].alias("field"), x["name"].alias("name"), x["raw"].alias("raw"), normalize_address(x["raw"]).alias("key")))
    out = mails.withColumn("__seen", keyed).withColumn("__good", F.filter("__seen", lambda x: x["key"].isNotNull()))
    out = out.withColumn("__keys", F.col("__good.key"))

    def keys(field: str) -> Column:
        return F.sort_array(F.array_distinct(F.filter("__good", lambda x: x["field"] == field)["key"]))

    first = F.filter(F.transform("__good", lambda x, i: F.struct(x["key"].alias("key"), x["name"].alias("name"), x["field"].alias("field"), (F.array_position("__keys", x["key"]) == i + 1).alias("first"))), lambda x: x["first"])
    bad = F.transform(F.filter("__seen", lambda x: x["key"].isNull() & (x["raw"] != "")), lambda x: F.struct(x["field"].alias("field"), x["raw"].alias("raw"), x["name"].alias("name"), malformed_reason(x["raw"]).alias("reason")))
    out = out.withColumn("c_from", keys("From")).withColumn("c_to", keys("To")).withColumn("c_cc", keys("Cc"))
    out = out.withColumn("people", F.sort_array(F.array_distinct("__keys")))
    return out.withColumn("entries", first).withColumn("malformed", bad).drop("__seen", "__good", "__keys")


def list_hints(identity: Column, keys: Column | None, group_syntax: bool = True) -> Column:
    """Signs of a mailing list as short codes, in a fixed order."""
    sent_by, reply_to, froms = identity["sender"], identity["reply_to"], identity["from"]
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    first = lambda c: F.get(c, F.lit(0))
    address = lambda c: F.lower(F.when(first(c)["address"] != "", first(c)["address"]))
    hints = [
        F.when((size(froms) > 1) | F.coalesce(F.exists(froms, lambda e: F.size(e["addresses"]) > 1), F.lit(False)), "from_has_several_addresses"),
        F.when(address(sent_by) != address(froms), "sender_differs_from_from"),
        F.when(F.when(first(reply_to)["domain"] != "", first(reply_to)["domain"]) != F.when(first(froms)["domain"] != "", first(froms)["domain"]), "reply_to_other_domain"),
        F.when((size(sent_by) > 1) | (size(reply_to) > 1), "repeated_sender_or_reply_to"),
    ]
    if group_syntax:
        hints.append(F.when(F.coalesce(F.exists(froms, lambda e: F.coalesce(e["raw"].rlike(r":[^;]*;"), F.lit(False))), F.lit(False)), "from_group_syntax"))
    if keys is not None:
        hints.append(F.when(has_list_address(keys), "list_shaped_address"))
    return F.array_compact(F.array(*hints))


def prepare(mails: DataFrame, scope: str = "scope") -> DataFrame:
    """Visible addresses, list hints and the state of the parent edge of every mail."""
    out = visible_addresses(gated(mails, scope))
    hints = list_hints(F.col("identity"), F.col("people")) if "identity" in mails.columns else list_hints_of_addresses(F.col("people"))
    return out.withColumn("hints", hints)


def list_hints_of_addresses(keys: Column) -> Column:
    return F.array_compact(F.array(F.when(has_list_address(keys), "list_shaped_address")))


def set_difference(p: str = "p_", c: str = "c_") -> dict[str, Column]:
    """The four differences of a parent's and a child's sets, each sorted.

    ``role_changed`` holds (address, from_role, to_role); an address in both To
    and Cc counts as To.
    """
    col = lambda name: F.col(name)
    p_recipients, c_recipients = F.array_union(col(f"{p}to"), col(f"{p}cc")), F.array_union(col(f"{c}to"), col(f"{c}cc"))
    p_people, c_people = F.array_union(col(f"{p}from"), p_recipients), F.array_union(col(f"{c}from"), c_recipients)
    role = lambda side, a: F.when(F.array_contains(col(f"{side}to"), a), "to").otherwise("cc")
    both = F.transform(F.sort_array(F.array_intersect(p_recipients, c_recipients)), lambda a: F.struct(a.alias("address"), role(p, a).alias("from_role"), role(c, a).alias("to_role")))
    return {
        "added": F.sort_array(F.array_except(c_people, p_people)),
        "role_changed": F.filter(both, lambda x: x["from_role"] != x["to_role"]),
        "dropped": F.sort_array(F.array_except(F.array_except(p_recipients, c_recipients), col(f"{c}from"))),
        "reply_all_omitted": F.sort_array(F.array_except(p_people, c_people)),
    }


def edges(prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """One row for each mail with a parent: both sides' sets, their differences, and whether they count."""
    up = prepared.select(
        scope, F.col("uid").alias("parent_uid"), F.col("message_id").alias("parent_message_id"), F.col("c_from").alias("p_from"), F.col("c_to").alias("p_to"), F.col("c_cc").alias("p_cc"), (F.size("hints") > 0).alias("p_listed"), (F.size("malformed") > 0).alias("p_malformed")
    )
    # what the sets were made from stays with the mails
    own = prepared.where("parent_uid IS NOT NULL").drop("from", "to", "cc", "entries", "identity", "attachments", "issues", "refs", "in_reply_to", "subject", "raw_sha256", "thread_root_message_id")
    tasks = tasks_for(prepared.sparkSession, prepared.count(), TASK_MAILS)
    own, up = (x.repartition(tasks, "parent_uid", scope) for x in (own, up))
    met = own.join(up, ["parent_uid", scope])
    kinds = F.array_compact(F.array(F.when((F.size("hints") > 0) | F.col("p_listed"), "possible_mailing_list"), F.when((F.size("malformed") > 0) | F.col("p_malformed"), "malformed_address")))
    out = met.withColumn("edge_kinds", F.when(F.col("compared"), kinds).otherwise(_none()))
    out = out.withColumn("edge_compared", F.col("compared") & (F.size("edge_kinds") == 0))
    return out.withColumns(set_difference())


def _fields_of(side: str, address: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.array_contains(F.col(f"{side}{f.lower()}"), address), f) for f in ("From", "To", "Cc")]))


def _changes() -> Column:
    """How many events an edge gives if it counts."""
    return sum((F.size(c).cast("long") for c in ("added", "role_changed", "dropped", "reply_all_omitted")), F.lit(0))


def events(edge_rows: DataFrame, scope: str = "scope") -> DataFrame:
    """Events of the compared edges: by mail, then added, role_changed, dropped, omitted, each by address."""
    shape = "array<struct<rank:int,type:string,address:string,from_role:string,to_role:string,fields:array<string>>>"

    def of(rank: int, kind: str, column: str, fields) -> Column:
        if kind == "role_changed":
            return F.transform(column, lambda x: F.struct(F.lit(rank), F.lit(kind), x["address"], x["from_role"], x["to_role"], F.array(F.lit("To"), F.lit("Cc")))).cast(shape)
        return F.transform(column, lambda x: F.struct(F.lit(rank), F.lit(kind), x, F.lit(None).cast("string"), F.lit(None).cast("string"), fields(x))).cast(shape)

    made = F.concat(
        of(0, "added", "added", lambda a: _fields_of("c_", a)), of(1, "role_changed", "role_changed", None), of(2, "dropped", "dropped", lambda a: _fields_of("p_", a)),
        of(3, "reply_all_omitted", "reply_all_omitted", lambda a: F.array(F.lit("From"), F.lit("To"), F.lit("Cc"))),
    )
    out = edge_rows.where("edge_compared").select(
        F.col(scope).alias("scope"), "uid", "parent_uid", "thread_root_uid", "date", F.size(F.array_union("p_from", F.array_union("p_to", "p_cc"))).cast("long").alias("parent_people"), F.size("people").cast("long").alias("child_people"), F.inline(made)
    )
    tasks = tasks_for(edge_rows.sparkSession, edge_rows.where("edge_compared").agg(F.sum(_changes())).first()[0] or 0, TASK_EVENTS)
    return numbered(out, "scope", "uid", "rank", "address", blocks=[block_of("uid")], prefix="E", tasks=tasks)


def reviews(prepared: DataFrame, edge_rows: DataFrame, scope: str = "scope") -> DataFrame:
    """What needs a human: malformed addresses, list signs, unusable edges, edges with such a background.

    ``candidate_uids`` are the mails whose sets stand beside the child's: the
    first mail of a claimed id, or all variants of a conflicting one.
    """
    base = [F.col(scope).alias("scope"), "uid", "thread_root_uid"]
    null_ids, null_text = F.array().cast("array<bigint>"), F.lit(None).cast("string")

    def rows(df: DataFrame, rank: int, kind: Column | str, cause: Column | str, detail: Column, pos: Column | None = None, candidates: Column | None = None) -> DataFrame:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(*base, F.lit(rank).alias("rank"), (F.lit(0) if pos is None else pos).alias("pos"), as_col(kind).alias("kind"), as_col(cause).alias("cause"), detail.alias("detail"), (null_ids if candidates is None else candidates).alias("candidate_uids"))

    bad = prepared.select(scope, "uid", "thread_root_uid", F.posexplode("malformed").alias("pos", "m"))
    parts = [
        rows(bad, 0, "malformed_address", F.col("m.reason"), F.concat_ws(":", F.col("m.field"), F.col("m.raw")), F.col("pos")),
        rows(prepared.where(F.size("hints") > 0), 1, "possible_mailing_list", "own_mail", F.array_join("hints", ",")),
        rows(prepared.where("skip_reason = 'missing_parent'"), 2, "missing_parent", "missing_parent", F.col("claimed")),
        rows(prepared.where("conflict = 'broken_edge'"), 2, "reference_conflict", "broken_edge", F.col("claimed"), candidates=F.array("claimed_uid")),
    ]
    clash = prepared.where("conflict IN ('own_id', 'parent_id')").withColumn("__id", F.when(F.col("conflict") == "own_id", F.col("message_id")).otherwise(F.col("claimed")))
    # an id that makes a conflict is one that mails of other bytes have too
    conflicted = clash.select(F.col("__id").alias("message_id"), scope).distinct()
    variants = prepared.select("message_id", scope, "uid").join(conflicted, ["message_id", scope], "left_semi")
    variants = variants.groupBy(F.col("message_id").alias("__id"), scope).agg(F.array_sort(F.collect_list("uid")).alias("variants"))
    parts.append(rows(clash.join(variants, [scope, "__id"]), 2, "reference_conflict", F.col("conflict"), F.col("__id"), candidates=F.col("variants")))
    background = edge_rows.where(F.size("edge_kinds") > 0)
    parts.append(rows(background, 3, F.col("edge_kinds")[0], "edge", F.array_join("edge_kinds", ","), candidates=F.array("parent_uid")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return numbered(out.withColumn("detail", F.coalesce("detail", null_text)), "scope", "uid", "rank", "pos", blocks=[block_of("uid")], prefix="R")


def provisional_differences(review_rows: DataFrame, prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """For conflicts: the child's differences to each candidate parent, side by side, none of them chosen."""
    pairs = review_rows.where("kind = 'reference_conflict' AND cause <> 'own_id'").select("scope", "seq", "uid", F.explode("candidate_uids").alias("candidate_uid"))
    child = prepared.select(F.col(scope).alias("scope"), "uid", "c_from", "c_to", "c_cc")
    parent = prepared.select(F.col(scope).alias("scope"), F.col("uid").alias("candidate_uid"), F.col("c_from").alias("p_from"), F.col("c_to").alias("p_to"), F.col("c_cc").alias("p_cc"))
    met = pairs.join(child, ["scope", "uid"]).join(parent, ["scope", "candidate_uid"])
    return met.select("scope", "seq", "uid", "candidate_uid", *[c.alias(name) for name, c in set_difference().items()])


def _sets(side: str) -> Column:
    """The visible sets of one mail."""
    return F.struct(F.col(f"{side}from").alias("from"), F.col(f"{side}to").alias("to"), F.col(f"{side}cc").alias("cc"))


def conflict_variants(prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """The mails of every id that mails of other bytes have too, side by side: one row a mail, none chosen.

    Columns: scope, message_id, variant_count, uid, date, raw_sha256, sets.
    """
    groups = id_groups(prepared, scope).where("conflicted").select(scope, "message_id", F.col("id_mails").alias("variant_count"))
    return prepared.join(groups, [scope, "message_id"]).select(F.col(scope).alias("scope"), "message_id", "variant_count", "uid", "date", "raw_sha256", _sets("c_").alias("sets"))


def _pairs_of_conflicts(asked: DataFrame, parents: DataFrame) -> DataFrame:
    """Every mail that claims a conflicting id beside every mail of that id.

    The rows in are few and the pairs may be very many, so what decides the
    number of tasks is the number of pairs: the mails of an id are cut into
    slices, a claiming mail goes to each slice, and slices are dealt to tasks.
    """
    claims = asked.groupBy("scope", F.col("claimed").alias("candidate_id")).agg(F.count(F.lit(1)).alias("__claims"))
    sizes = parents.join(claims, ["candidate_id", "scope"]).groupBy("candidate_id", "scope").agg(F.count(F.lit(1)).alias("__mails"), F.first("__claims").alias("__claims"))
    slices = sizes.select("candidate_id", "scope", F.ceil(F.col("__mails") / SLICE_MAILS).cast("int").alias("__slices"), (F.col("__mails") * F.col("__claims")).alias("__pairs"))
    slices = keep(slices, "conflict-slices")
    tasks = max(1, min(20_000, -(-(slices.agg(F.sum("__pairs")).first()[0] or 0) // TASK_PAIRS)))
    key, slices = ["candidate_id", "scope"], slices.drop("__pairs")
    candidates = parents.join(slices, key).withColumn("__slice", F.pmod(F.xxhash64("candidate_uid"), F.col("__slices")).cast("int")).drop("__slices")
    claiming = asked.withColumn("candidate_id", F.col("claimed")).join(slices, key).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))).drop("__slices")
    dealt = [x.repartition(tasks, *key, "__slice") for x in (claiming, candidates)]
    return dealt[0].join(dealt[1], [*key, "__slice"]).drop("__slice")


def conflict_evidence(prepared: DataFrame, scope: str = "scope", show: Callable[[Column], Column] | None = None, kinds: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """What stands beside a mail whose parent is missing, broken or in conflict.

    One row for each such mail and each candidate parent: ``child`` and
    ``candidate`` are their visible sets, ``differences`` what changed if this
    candidate were the parent.  No candidate is chosen and nothing of it counts
    as an event.  A mail without candidates has one row with nulls; so has one
    whose own id is in conflict, as its variants have no order: they are the
    rows of ``message_id`` in ``conflict_variants``.

    ``show`` gives the sets another form, once a mail and not once a pair;
    ``kinds`` are the differences that are wanted.
    """
    show = show or (lambda c: c)
    fields = ("from", "to", "cc")
    seen = lambda side: [show(F.col(f"c_{f}")).alias(f"__{side}_{f}") for f in fields]
    shown = lambda side: F.struct(*[F.col(f"__{side}_{f}").alias(f) for f in fields])
    asked = prepared.where("skip_reason IN ('missing_parent', 'reference_conflict')").select(
        F.col(scope).alias("scope"), "uid", F.coalesce("conflict", "skip_reason").alias("cause"), "message_id", "claimed", "claimed_uid", "c_from", "c_to", "c_cc", F.col("people").alias("c_people"), *seen("c")
    )
    parents = prepared.select(
        F.col(scope).alias("scope"), F.col("uid").alias("candidate_uid"), F.col("message_id").alias("candidate_id"), F.col("date").alias("candidate_date"), F.col("raw_sha256").alias("candidate_sha256"), F.col("c_from").alias("p_from"), F.col("c_to").alias("p_to"), F.col("c_cc").alias("p_cc"), F.col("people").alias("p_people"), *seen("p")
    )
    # people are sorted sets, and so are their differences
    made = set_difference() | {"added": F.array_except("c_people", "p_people"), "reply_all_omitted": F.array_except("p_people", "c_people")}
    differences = F.struct(*[made[k].alias(k) for k in ("added", "role_changed", "dropped", "reply_all_omitted") if k in kinds])
    there = F.col("candidate_uid").isNotNull()
    one = asked.where("cause = 'broken_edge'").join(parents, (asked["scope"] == parents["scope"]) & (asked["claimed_uid"] == parents["candidate_uid"]), "left").drop(parents["scope"])
    one = one.withColumn("differences", F.when(there, differences)).withColumn("candidate", F.when(there, shown("p")))
    many = _pairs_of_conflicts(asked.where("cause = 'parent_id'"), parents).withColumn("differences", differences).withColumn("candidate", shown("p"))
    met = one.unionByName(many)
    none = asked.where("cause IN ('missing_parent', 'own_id')")
    columns = ["scope", "uid", "cause", "message_id", "claimed", shown("c").alias("child"), "candidate_uid", "candidate_date", "candidate_sha256", "candidate", "differences"]
    return met.select(*columns).unionByName(none.select(*columns[:6]), allowMissingColumns=True)


def ledger(prepared: DataFrame, scope: str = "scope") -> DataFrame:
    """One row an address: names in order of appearance, fields, first mail, and how often a mail's field has it.

    A field counts when it holds the address; From only for the entry that was
    first seen there.
    """
    def held(field: str, rank: int) -> Column:
        return F.transform(F.col(f"c_{field.lower()}"), lambda k: F.struct(k.alias("address"), F.lit(field).alias("field"), F.lit(rank).alias("rank")))

    name_of = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["key"], e["name"])))
    seen = prepared.select(
        F.col(scope).alias("scope"), "uid", "date", name_of.alias("names"),
        F.explode(F.concat(held("From", 0), held("To", 1), held("Cc", 2))).alias("o"),
    )
    seen = seen.select("scope", "uid", "date", F.element_at("names", F.col("o.address")).alias("name"), "o.address", "o.field", "o.rank")
    order = F.struct(F.col("date").isNull(), F.coalesce("date", F.lit("")), F.col("uid"), F.col("rank"))
    out = seen.groupBy("scope", "address").agg(
        F.array_sort(F.collect_set("field")).alias("fields"), F.min_by(F.struct("uid", "date", "field"), order).alias("first"), F.count(F.lit(1)).alias("occurrence_count"),
        F.array_sort(F.collect_list(F.when(F.col("name") != "", F.struct("uid", "rank", "name")))).alias("named"),
    )
    names = F.array_distinct(F.transform("named", lambda x: x["name"]))
    return out.select("scope", "address", names.alias("names"), "fields", F.col("first.uid").alias("first_uid"), F.col("first.date").alias("first_date"), F.col("first.field").alias("first_field"), "occurrence_count")


def email_rows(prepared: DataFrame, edge_rows: DataFrame, event_rows: DataFrame, review_rows: DataFrame, scope: str = "scope") -> DataFrame:
    """One row a mail: counts, whether its edge was compared or why not, and the ids of its events and reviews."""
    flags = edge_rows.select(scope, "uid", "edge_compared")
    tasks = tasks_for(prepared.sparkSession, prepared.count(), TASK_MAILS)
    # the addresses themselves stay where they are
    sizes = [F.size(c).cast("long").alias(name) for c, name in (("people", "visible_count"), ("c_to", "to_count"), ("c_cc", "cc_count"), ("malformed", "malformed_count"))]
    slim, flags = (x.repartition(tasks, scope, "uid") for x in (prepared.select(scope, "uid", "message_id", "thread_root_uid", "parent_uid", *sizes, (F.size("hints") > 0).alias("list_hints"), "skip_reason"), flags))
    per = lambda rows, name: rows.select(F.col("scope").alias(scope), "uid", "seq", "id").repartition(tasks, scope, "uid").groupBy(scope, "uid").agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias(name))
    met = slim.join(flags, [scope, "uid"], "left").join(per(event_rows, "e"), [scope, "uid"], "left").join(per(review_rows, "r"), [scope, "uid"], "left")
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["id"]), _none())
    return met.select(
        F.col(scope).alias("scope"), "uid", "message_id", "thread_root_uid", "parent_uid", "visible_count", "to_count", "cc_count",
        "malformed_count", "list_hints", F.coalesce("edge_compared", F.lit(False)).alias("compared"), "skip_reason", ids("e").alias("event_ids"), ids("r").alias("review_ids"),
    )


def thread_summaries(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scope", "thread_root_uid").agg(
        F.count(F.lit(1)).alias("email_count"), F.sum(F.size("event_ids").cast("long")).alias("event_count"), F.sum(F.size("review_ids").cast("long")).alias("review_count"), F.array_sort(F.collect_list("uid")).alias("node_uids")
    )


def thread_counts(prepared: DataFrame, edge_rows: DataFrame, scope: str = "scope") -> DataFrame:
    """The counts of ``thread_summaries`` where ids are not asked for: nothing is numbered, sorted or met by mail."""
    key, number = [F.col(scope).alias("scope"), "thread_root_uid"], lambda c: c.cast("long")
    once = lambda c: number(F.coalesce(c, F.lit(False)))
    own = F.size("malformed").cast("long") + once(F.size("hints") > 0) + once(F.col("skip_reason") == "missing_parent") + once(F.col("conflict").isNotNull())
    mails = prepared.select(*key, number(F.lit(1)).alias("emails"), number(F.lit(0)).alias("events"), own.alias("reviews"))
    along = edge_rows.select(*key, number(F.lit(0)).alias("emails"), F.when(F.col("edge_compared"), _changes()).otherwise(0).alias("events"), once(F.size("edge_kinds") > 0).alias("reviews"))
    return mails.unionByName(along).groupBy("scope", "thread_root_uid").agg(F.sum("emails").alias("email_count"), F.sum("events").alias("event_count"), F.sum("reviews").alias("review_count"))


def stats(rows: DataFrame, edge_rows: DataFrame, event_rows: DataFrame, review_rows: DataFrame, addresses: DataFrame, scope: str = "scope") -> DataFrame:
    """The measures of each scope, zeros included."""
    changed = (F.size("added") > 0) | (F.size("dropped") > 0) | (F.size("role_changed") > 0) | (F.size("reply_all_omitted") > 0)
    parts = [
        rows.groupBy("scope").agg(F.count(F.lit(1)).alias("emails"), F.sum("malformed_count").alias("malformed_addresses"), F.countDistinct("thread_root_uid").alias("threads_total")),
        addresses.groupBy("scope").agg(F.count(F.lit(1)).alias("unique_addresses")),
        edge_rows.groupBy(F.col(scope).alias("scope")).agg(F.count(F.lit(1)).alias("edges_total"), F.count_if("edge_compared").alias("edges_compared"), F.count_if(changed).alias("edges_with_changes")),
        event_rows.groupBy("scope").agg(F.count(F.lit(1)).alias("events_total"), *[F.count_if(F.col("type") == k).alias(f"events_{k}") for k in EVENT_TYPES]),
        review_rows.groupBy("scope").agg(F.count(F.lit(1)).alias("reviews_total"), *[F.count_if(F.col("kind") == k).alias(f"reviews_{k}") for k in REVIEW_KINDS]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "scope", "left")
    return out.select("scope", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns if c != "scope"])
