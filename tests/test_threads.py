"""Forests against a recursive definition, deep chains, duplicates and issue counts."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from heliograph.operators import case_merge, threads

SCHEMA = "scope string, uid long, message_id string, raw_sha256 string, in_reply_to string, refs array<string>, date string, source_file string, issues array<string>"


def mails(spark, rows):
    full = []
    for uid, r in enumerate(rows):
        mid, irt, refs, *rest = r
        sha = rest[0] if rest else f"sha{uid}"
        full.append(("s", uid, mid, sha, irt, refs, rest[1] if len(rest) > 1 else f"2024-01-{10 + uid % 20}", f"{uid:04}.eml", []))
    return spark.createDataFrame(full, SCHEMA)


def recursive_parents(rows, ambiguous=False):
    """The definition by recursion, with the tallies of what was tried."""
    ids, count = {}, {}
    for uid, r in enumerate(rows):
        if r[0] is not None:
            ids.setdefault(r[0], uid)
            count[r[0]] = count.get(r[0], 0) + 1
    parent, tally, busy = {}, {}, set()

    def options(uid):
        mid, irt, refs = rows[uid][:3]
        if not ambiguous and mid is not None and ids[mid] != uid:
            return []
        return list(dict.fromkeys(([irt] if irt else []) + list(reversed(refs or []))))

    def settle(uid):
        busy.add(uid)
        t = tally[uid] = {"missing": 0, "self": 0, "ambiguous": 0, "cycle": 0}
        parent_of = None
        for ref in options(uid):
            if ref == rows[uid][0]:
                t["self"] += 1
            elif ref not in ids:
                t["missing"] += 1
            elif ambiguous and count[ref] > 1:
                t["ambiguous"] += 1
            elif ids[ref] in busy:
                t["cycle"] += 1
            else:
                parent_of = ids[ref]
                if parent_of not in parent:
                    settle(parent_of)
                break
        busy.discard(uid)
        parent[uid] = parent_of

    for uid in range(len(rows)):
        if uid not in parent:
            settle(uid)
    return parent, tally


@pytest.mark.parametrize(("seed", "ambiguous", "rows"), [(1, False, 20_000), (2, False, 1), (3, True, 20_000), (4, True, 1)])
def test_random_graphs_with_cycles(spark, monkeypatch, seed, ambiguous, rows):
    monkeypatch.setattr(threads, "REPLAY_ROWS", rows)
    rng = random.Random(seed)
    parts, wants = [], []
    for g in range(12):
        n = rng.randrange(3, 12)
        pick = lambda: f"<{rng.randrange(n + 2)}@x>"  # noqa: B023, E731
        rows = [(rng.choice([f"<{i}@x>", f"<{i}@x>", pick(), None]), rng.choice([None, pick()]), [pick() for _ in range(rng.randrange(3))]) for i in range(n)]
        wants.append((f"g{g}", *recursive_parents(rows, ambiguous)))
        parts += [(f"g{g}", uid, m, f"s{uid}", irt, refs, "2024", f"{uid}", []) for uid, (m, irt, refs) in enumerate(rows)]
    df = spark.createDataFrame(parts, SCHEMA).repartition(3)
    got = {(r["scope"], r["uid"]): r for r in threads.resolve_parents(df, ambiguous=ambiguous).collect()}
    assert len(got) == len(parts)
    for scope, parent, tally in wants:
        for uid, p in parent.items():
            r = got[scope, uid]
            assert r["parent_uid"] == p, (scope, uid)
            assert (r["missing_refs"], r["self_refs"], r["ambiguous_refs"], r["cycle_refs"]) == tuple(tally[uid][k] for k in ("missing", "self", "ambiguous", "cycle"))
            root, depth = uid, 0
            while parent[root] is not None:
                root, depth = parent[root], depth + 1
            assert (r["root_uid"], r["depth"]) == (root, depth)


@pytest.mark.parametrize("backwards", [False, True])
def test_deep_chain(spark, backwards):
    n = 1200
    assert n > sys.getrecursionlimit() or n > 1000
    rows = [(f"<{i}@x>", f"<{i - 1}@x>" if i else None, []) for i in range(n)]
    if backwards:
        rows.reverse()
    forest = threads.build_forest(mails(spark, rows))
    assert forest.agg(F.max("depth"), F.countDistinct("root_uid")).first()[:] == (n - 1, 1)
    assert threads.preorder(forest, [F.col("date")]).agg(F.max("thread_pos")).first()[0] == n - 1


def test_duplicates_and_missing_ids(spark):
    rows = [("<a@x>", None, [], "h1"), ("<a@x>", "<z@x>", [], "h1"), ("<a@x>", None, [], "h2"), (None, "<a@x>", []), (None, None, []), ("<b@x>", "<gone@x>", ["<a@x>", "<gone@x>"]), ("<c@x>", "<c@x>", None)]
    got = {r["uid"]: r for r in threads.build_forest(mails(spark, rows)).collect()}
    assert [got[i]["id_class"] for i in range(7)] == ["first", "copy", "reused", "none", "none", "first", "first"]
    assert [got[i]["parent_uid"] for i in range(7)] == [None, None, None, 0, None, 0, None]
    assert (got[5]["missing_refs"], got[6]["self_refs"], got[1]["missing_refs"]) == (1, 1, 0)
    summary = threads.issue_summary(threads.build_forest(mails(spark, rows))).first()
    assert (summary["missing_message_id"], summary["duplicate_message_id"], summary["missing_parent"], summary["self_reference"]) == (2, 2, 1, 1)
    assert threads.build_forest(mails(spark, rows).limit(0)).collect() == []


def test_siblings_follow_date_then_file(spark):
    rows = [("<r@x>", None, [], "a", "2024-01-05"), ("<1@x>", "<r@x>", [], "b", "2024-01-09"), ("<2@x>", "<r@x>", [], "c", None), ("<3@x>", "<1@x>", [], "d", "2024-01-01"), ("<4@x>", "<r@x>", [], "e", "2024-01-09")]
    forest = threads.build_forest(mails(spark, rows))
    placed = threads.preorder(forest, [F.coalesce("date", F.lit("")), F.col("source_file")])
    assert [r["uid"] for r in placed.orderBy("thread_pos").collect()] == [0, 2, 1, 3, 4]


CASE = "case_id string, job_pos int, job_id string, uid long, raw_sha256 string, message_id string, in_reply_to string, refs array<string>, date string, source_file string"


def test_case_merge(spark):
    rows = [
        ("k", 0, "A", 0, "h0", "<p@x>", None, [], "1", "a0"), ("k", 0, "A", 1, "h1", "<c@x>", "<q@x>", [], "2", "a1"), ("k", 1, "B", 0, "h2", "<q@x>", None, [], "3", "b0"),
        ("k", 1, "B", 1, "h0", "<p@x>", None, [], "1", "b1"), ("k", 1, "B", 2, "h3", "<d@x>", None, [], "4", "b2"), ("k", 2, "C", 0, "h4", "<d@x>", None, [], "5", "c0"), ("k", 2, "C", 1, "h5", "<e@x>", "<d@x>", ["<p@x>"], "6", "c1"),
    ]
    df = spark.createDataFrame(rows, CASE)
    nodes = case_merge.merge_case(df)
    got = {r["uid"]: r for r in nodes.collect()}
    assert [got[i]["raw_sha256"] for i in range(6)] == ["h0", "h1", "h2", "h3", "h4", "h5"]
    assert [(s["job_id"], s["original_uid"]) for s in got[0]["sources"]] == [("A", 0), ("B", 1)]
    assert [[r["uid"] for r in case_merge.conflict_with(nodes, "k", uid).collect()] for uid in (3, 4, 0)] == [[4], [3], []]
    assert [(got[i]["conflict"], got[i]["conflict_class"], got[i]["conflict_size"]) for i in (0, 3, 4)] == [(False, None, None), (True, 3, 2), (True, 3, 2)]
    assert (got[1]["parent_uid"], got[1]["relinked_for"], got[1]["relinked_via"]) == (2, ["A"], "in_reply_to")
    assert (got[5]["parent_uid"], got[5]["ambiguous_refs"], got[5]["relinked_for"], got[5]["relinked_via"]) == (0, 1, ["C"], "references")
    share = {r["job_id"]: r.asDict() for r in case_merge.contributions(nodes, df).collect()}
    assert (share["A"]["relinked_nodes"], share["B"]["duplicates_merged"], share["B"]["conflict_nodes"], share["C"]["unique_nodes"], share["C"]["root_nodes"]) == (1, 1, 1, 2, 1)
    stats = case_merge.case_stats(nodes).first()
    assert (stats["source_emails"], stats["merged_nodes"], stats["conflict_groups"], stats["relinked_nodes"]) == (7, 6, 1, 2)
    jobs = spark.createDataFrame([("k", "A", "completed"), ("k", "A", "completed"), ("m", "B", "failed"), ("n", "B", "completed")], "case_id string, job_id string, status string")
    assert {(r["case_id"], r["reason"]) for r in case_merge.admit(jobs).collect()} == {("k", "duplicate_jobs"), ("m", "job_not_completed")}
