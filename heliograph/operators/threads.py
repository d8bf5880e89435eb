"""Conversation forests from message references.

Mails are numbered inside a *scope* (a package, or a case of several packages);
every step is keyed by the scope, so nothing is numbered or sorted globally and
any number of packages is handled at once.  Relations:

``mails``       scope, uid, message_id, in_reply_to, refs, ... one row a mail
``resolved``    scope, uid, parent_uid, parent_ref, chosen_pos and tallies
``forest``      resolved + root_uid, depth

A mail's candidates are its In-Reply-To, then its References from the nearest.
It hangs under the first one that is in the scope, is not itself and would not
close a cycle.  Without cycles that is a join and a ``min_by``.  Mails whose
first choices lead into a circle are found by pointer doubling; only they are
replayed mail by mail, each connected set of them a group of its own.  All
others keep their first choice: it never leads to a circle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.lineage import cut, keep
from heliograph.operators.components import connected_components
from heliograph.operators.ranking import numbered_from, running_sum

NO_POS = 2**31 - 1
#: Circular mails of one scope that are replayed together.
REPLAY_ROWS = 20_000


def blank_to_null(c: Column | str) -> Column:
    """Empty text counts as absent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def number_mails(mails: DataFrame, scope: str, *order: str) -> DataFrame:
    """``uid`` from 0 in arrival order inside each scope."""
    return numbered_from(mails, [scope], list(order), "uid")


def candidate_refs(in_reply_to: Column, refs: Column) -> Column:
    """In-Reply-To first, then the references backwards, each once."""
    first = F.when(in_reply_to.isNotNull() & (in_reply_to != ""), F.array(in_reply_to)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(first, F.reverse(F.coalesce(refs, F.array().cast("array<string>")))))


def direct_ref(in_reply_to: Column, refs: Column) -> Column:
    """The parent that a mail claims: In-Reply-To, else its last reference."""
    return F.coalesce(blank_to_null(in_reply_to), F.when(F.size(refs) > 0, F.element_at(refs, -1)))


def classify_duplicates(mails: DataFrame, scope: str = "scope") -> DataFrame:
    """Adds ``canonical_uid`` and ``id_class``: first, copy (same bytes), reused (other bytes), none (no id).

    The first mail of an id keeps it.  Mails without an id form no group, so
    they are kept out of the window that would otherwise gather them all.
    """
    w = Window.partitionBy(scope, "message_id")
    named = mails.where("message_id IS NOT NULL")
    first = F.min(F.struct("uid", "raw_sha256")).over(w)
    named = named.withColumn("__first", first).withColumn("canonical_uid", F.col("__first.uid"))
    named = named.withColumn(
        "id_class", F.when(F.col("uid") == F.col("canonical_uid"), "first").when(F.col("raw_sha256").eqNullSafe(F.col("__first.raw_sha256")), "copy").otherwise("reused")
    ).drop("__first")
    unnamed = mails.where("message_id IS NULL").withColumn("canonical_uid", F.lit(None).cast("long")).withColumn("id_class", F.lit("none"))
    return named.unionByName(unnamed)


def targets(mails: DataFrame, scope: str = "scope", ambiguous: bool = False) -> DataFrame:
    """(scope, ref, target, variants) of every message id in a scope.

    Packages: the first mail that has the id.  Cases (``ambiguous``): an id of
    several different mails has no target.
    """
    ids = mails.where("message_id IS NOT NULL").groupBy(scope, F.col("message_id").alias("ref")).agg(F.min("uid").alias("target"), F.count(F.lit(1)).alias("variants"))
    return ids.withColumn("target", F.when(F.col("variants") == 1, F.col("target"))) if ambiguous else ids


def candidates(mails: DataFrame, scope: str = "scope", ambiguous: bool = False) -> DataFrame:
    """One row for each candidate: scope, uid, pos, ref, target, kind.

    ``kind`` is self, missing, ambiguous or present.  In a package, a mail whose
    id an earlier mail has keeps no candidates.
    """
    own = mails
    if not ambiguous:
        own = classify_duplicates(mails, scope).where("id_class IN ('first', 'none')")
    each = own.select(scope, "uid", "message_id", F.posexplode(candidate_refs(F.col("in_reply_to"), F.col("refs"))).alias("pos", "ref"))
    met = each.join(targets(mails, scope, ambiguous), [scope, "ref"], "left")
    kind = F.when(F.col("ref") == F.col("message_id"), "self").when(F.col("variants").isNull(), "missing").when(F.col("target").isNull(), "ambiguous").otherwise("present")
    return met.select(scope, "uid", "pos", "ref", "target", kind.alias("kind"))


def _choose(tried: DataFrame, scope: str) -> DataFrame:
    present = F.col("kind") == "present"
    return tried.groupBy(scope, "uid").agg(
        F.min_by(F.when(present, F.struct("target", "ref")), F.when(present, F.col("pos"))).alias("hit"),
        F.min(F.when(present, F.col("pos"))).alias("chosen_pos"),
    ).select(scope, "uid", F.col("hit.target").alias("parent_uid"), F.col("hit.ref").alias("parent_ref"), "chosen_pos")


def climb(edges: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, uid, root_uid, depth, circular) of every mail that has a parent, by pointer doubling.

    ``edges`` has scope, uid, parent_uid.  Each round doubles the distance that
    pointers span.  It ends when all have arrived, or when a round lets none
    arrive: depths have no gaps, so what still moves then is on its way to a
    cycle.
    """
    now = cut(edges.where("parent_uid IS NOT NULL").select(scope, "uid", F.col("parent_uid").alias("at"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moving")))
    left, before = now.count(), -1
    while left and left != before:
        ahead = now.select(scope, F.col("uid").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        now = cut(now.join(ahead, [scope, "at"], "left").select(scope, "uid", F.coalesce("next", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moving")))
        left, before = now.where("moving").count(), left
    return now.select(scope, "uid", F.col("at").alias("root_uid"), "depth", F.col("moving").alias("circular"))


def _walk(options: dict[int, list[tuple[int, int]]], order: list[int]) -> tuple[dict[int, tuple[int, int] | None], dict[int, int]]:
    """Parents (target, pos) and broken edges of connected mails whose first choices lead into circles.

    From each unsettled mail, in arrival order, one walks up along the first
    option that is not on the walk itself, until a settled mail or a dead end is
    met; then the whole walk is settled.  Mails without options here are settled.
    """
    parent: dict[int, tuple[int, int] | None] = {}
    broken: dict[int, int] = {}
    for start in order:
        walk, on_walk = [start], {start}
        while start not in parent:
            here = walk[-1]
            step = None
            for pos, target in options.get(here, ()):
                if target in on_walk:
                    broken[here] = broken.get(here, 0) + 1
                    continue
                step = (target, pos)
                break
            if step is not None and step[0] in options and step[0] not in parent:
                walk.append(step[0])
                on_walk.add(step[0])
                continue
            # the end of the walk is known; every mail before it took the next one
            last = step
            for uid in reversed(walk):
                parent[uid] = last
                last = (uid, -1)
    return parent, broken


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    options: dict[int, list[tuple[int, int]]] = {}
    refs = {}
    for uid, pos, target, ref, kind in sorted(zip(pdf["uid"], pdf["pos"], pdf["target"], pdf["ref"], pdf["kind"], strict=True), key=lambda r: (r[0], r[1])):
        options.setdefault(int(uid), [])
        if kind == "present":
            options[int(uid)].append((int(pos), int(target)))
            refs[int(uid), int(target)] = (ref, int(pos))
    parent, broken = _walk(options, sorted(options))
    rows = []
    for uid in options:
        got = parent.get(uid)
        ref, pos = refs[uid, got[0]] if got else (None, None)
        rows.append((pdf["scope"].iloc[0], uid, got[0] if got else None, ref, pos, broken.get(uid, 0)))
    out = pd.DataFrame(rows, columns=["scope", "uid", "parent_uid", "parent_ref", "chosen_pos", "cycle_refs"])
    return out.astype({"parent_uid": "Int64", "chosen_pos": "Int32"})


def _replay_circles(tried: DataFrame, circular: DataFrame, scope: str) -> DataFrame:
    """Parents of the circular mails.

    Mails that reach one another by any option must be one group.  While no
    scope has more than ``REPLAY_ROWS`` circular mails, a scope is the group,
    which spares the search for components; the results are the same.
    """
    own = tried.join(circular, [scope, "uid"], "left_semi")
    most = circular.groupBy(scope).count().agg(F.max("count")).first()[0]
    if most <= REPLAY_ROWS:
        grouped = own.withColumn("group", F.lit(0).cast("long"))
    else:
        inner = own.where("kind = 'present'").join(circular.select(scope, F.col("uid").alias("target")), [scope, "target"], "left_semi")
        groups = connected_components(inner.select(F.struct(scope, "uid").alias("a"), F.struct(scope, F.col("target").alias("uid")).alias("b")))
        grouped = own.join(groups.select(F.col(f"node.{scope}").alias(scope), F.col("node.uid").alias("uid"), F.col("component.uid").alias("group")), [scope, "uid"])
    return (
        grouped.withColumnRenamed(scope, "scope")
        .groupBy("scope", "group")
        .applyInPandas(_replay, f"scope {dict(tried.dtypes)[scope]}, uid long, parent_uid long, parent_ref string, chosen_pos int, cycle_refs long")
        .withColumnRenamed("scope", scope)
    )


def resolve_parents(mails: DataFrame, scope: str = "scope", ambiguous: bool = False) -> DataFrame:
    """Parent and reference tallies of every mail.

    Returns ``scope, uid, parent_uid, parent_ref, chosen_pos, missing_refs,
    self_refs, ambiguous_refs, cycle_refs, root_uid, depth``.  Tallies count
    only candidates tried before the chosen one.  Null or empty references give
    roots; an empty table gives an empty result.
    """
    tried = cut(candidates(mails, scope, ambiguous))
    chosen = _choose(tried, scope)
    reached = climb(chosen, scope)
    circular = cut(reached.where("circular").select(scope, "uid"))
    plain = chosen.withColumn("cycle_refs", F.lit(0).cast("long"))
    if circular.limit(1).count():
        plain = cut(plain.join(circular, [scope, "uid"], "left_anti").unionByName(_replay_circles(tried, circular, scope)))
        reached = climb(plain, scope)
    before = F.col("pos") < F.coalesce("chosen_pos", F.lit(NO_POS))
    tally = (
        tried.join(plain.select(scope, "uid", "chosen_pos"), [scope, "uid"])
        .where(before)
        .groupBy(scope, "uid")
        .agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_refs") for k in ("missing", "self", "ambiguous")])
    )
    joined = mails.select(scope, "uid").join(plain, [scope, "uid"], "left").join(tally, [scope, "uid"], "left").join(reached, [scope, "uid"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        scope, "uid", "parent_uid", "parent_ref", "chosen_pos", *[zero(c) for c in ("missing_refs", "self_refs", "ambiguous_refs", "cycle_refs")],
        F.coalesce("root_uid", "uid").alias("root_uid"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def build_forest(mails: DataFrame, scope: str = "scope", ambiguous: bool = False) -> DataFrame:
    """``mails`` with parent, root, depth, tallies, and id class; repeated message ids never merge rows."""
    marked = classify_duplicates(mails, scope)
    return marked.join(resolve_parents(mails, scope, ambiguous), [scope, "uid"])


def subtree_sizes(links: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, uid, parent_uid, size) of every mail of a forest, by pointer doubling.

    After k rounds a mail points to its ancestor 2^k levels up and counts the
    descendants fewer than 2^k levels below itself; the next round adds what
    those exactly 2^k levels below have counted.  So the rounds are the
    logarithm of the depth, and no task sees more than its share of a thread.
    Rounds are written tables, whose sizes the optimizer knows; a checkpoint
    would carry estimates that grow with the power of the rounds.
    """
    now = keep(links.select(scope, "uid", "parent_uid", F.col("parent_uid").alias("at"), F.lit(1).cast("long").alias("size")), "sizes")
    while now.where("at IS NOT NULL").limit(1).count():
        below = now.where("at IS NOT NULL").groupBy(scope, F.col("at").alias("uid")).agg(F.sum("size").alias("below"))
        ahead = now.where("at IS NOT NULL").select(scope, F.col("uid").alias("at"), F.col("at").alias("next"))
        met = now.join(below, [scope, "uid"], "left").join(ahead, [scope, "at"], "left")
        now = keep(met.select(scope, "uid", "parent_uid", F.col("next").alias("at"), (F.col("size") + F.coalesce("below", F.lit(0))).alias("size")), "sizes")
    return now.drop("at")


def path_sums(steps: DataFrame, scope: str = "scope") -> DataFrame:
    """(scope, uid, total): the sum of ``step`` from each mail up to its root, by pointer doubling."""
    now = keep(steps.select(scope, "uid", F.col("parent_uid").alias("at"), F.col("step").alias("total")), "paths")
    while now.where("at IS NOT NULL").limit(1).count():
        ahead = now.select(scope, F.col("uid").alias("at"), F.col("at").alias("next"), F.col("total").alias("more"))
        now = keep(now.join(ahead, [scope, "at"], "left").select(scope, "uid", F.col("next").alias("at"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), "paths")
    return now.drop("at")


def preorder(forest: DataFrame, sort: list[Column], scope: str = "scope") -> DataFrame:
    """``forest`` with ``thread_pos``, the place of each mail when its thread is read depth first.

    Siblings follow ``sort`` (then uid).  A mail comes one place after its
    parent and the whole subtrees of its earlier siblings, so its place is the
    sum of these steps on the way to the root.  Sizes and sums double their
    reach in each round; the sums over siblings are parallel prefix sums, so
    neither a thread nor the children of one mail need to fit a task.
    """
    ranks = [c.alias(f"__sort{i}") for i, c in enumerate(sort)]
    order = [f"__sort{i}" for i in range(len(sort))] + ["uid"]
    base = keep(forest.select(scope, "uid", "parent_uid", *ranks), "links")
    sized = subtree_sizes(base, scope).join(base.drop("parent_uid"), [scope, "uid"])
    replies = running_sum(sized.where("parent_uid IS NOT NULL"), [scope, "parent_uid"], order, F.col("size"), "__earlier")
    steps = replies.select(scope, "uid", "parent_uid", (F.col("__earlier") + 1).alias("step"))
    roots = sized.where("parent_uid IS NULL").select(scope, "uid", "parent_uid", F.lit(0).cast("long").alias("step"))
    places = path_sums(steps.unionByName(roots), scope).withColumnRenamed("total", "thread_pos")
    return forest.join(places, [scope, "uid"])


def issue_class(issue: Column) -> Column:
    """Parse issues fall into ``undecodable`` and ``other`` by their wording (fixed phrases)."""
    return F.when(issue.rlike("无法解码|解码失败|均无法"), "undecodable").otherwise("other")


def issue_summary(forest: DataFrame, scope: str = "scope") -> DataFrame:
    """The seven issue counts of each scope."""
    parse = F.transform(F.coalesce("issues", F.array().cast("array<string>")), issue_class)
    rows = forest.select(
        scope, F.col("message_id").isNull().alias("no_id"), F.col("id_class").isin("copy", "reused").alias("dup"), "missing_refs", "cycle_refs", "self_refs",
        F.size(F.filter(parse, lambda x: x == "undecodable")).alias("undecodable"), F.size(F.filter(parse, lambda x: x == "other")).alias("other"),
    )
    return rows.groupBy(scope).agg(
        F.count_if("no_id").alias("missing_message_id"), F.count_if("dup").alias("duplicate_message_id"), F.sum("missing_refs").alias("missing_parent"),
        F.sum("cycle_refs").alias("reference_cycle"), F.sum("self_refs").alias("self_reference"),
        F.sum(F.col("undecodable").cast("long")).alias("undecodable"), F.sum(F.col("other").cast("long")).alias("other"),
    )


def package_stats(forest: DataFrame, entries: DataFrame | None = None, scope: str = "scope") -> DataFrame:
    """Counts of a package: mails, threads, attachments, issues, and skipped entries if ``entries`` is given."""
    issues = issue_summary(forest, scope)
    base = forest.groupBy(scope).agg(
        F.count(F.lit(1)).alias("eml_parsed"), F.count_if(F.col("parent_uid").isNull()).alias("thread_count"), F.sum(F.coalesce(F.size("attachments"), F.lit(0)).cast("long")).alias("attachment_count")
    )
    names = [c for c in issues.columns if c != scope]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    out = base.join(issues, scope).withColumn("issues_total", total)
    if entries is not None:
        counted = entries.groupBy(scope).agg(F.count(F.lit(1)).alias("zip_entries"), F.count_if(~F.col("is_mail")).alias("non_eml_skipped"))
        out = counted.join(out, scope, "left")
    return out


def thread_summary(forest: DataFrame, scope: str = "scope") -> DataFrame:
    """One row a thread: size, depth and what was found on the way."""
    root_id = F.max(F.when(F.col("uid") == F.col("root_uid"), F.col("message_id")))
    return forest.groupBy(scope, "root_uid").agg(
        root_id.alias("root_message_id"), F.count(F.lit(1)).alias("mail_count"), F.max("depth").alias("max_depth"), F.sum("missing_refs").alias("missing_refs"),
        F.sum("self_refs").alias("self_refs"), F.sum("cycle_refs").alias("cycle_refs"), F.count_if(F.col("id_class").isin("copy", "reused")).alias("duplicate_ids"),
    )
