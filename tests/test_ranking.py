"""Running sums, numbers and reading order against plain Python, with groups cut over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from heliograph.operators import ranking, threads


@pytest.fixture
def many_chunks(spark):
    """Small tables stay in several ranges, so that groups are cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_sum_of_a_hot_group(many_chunks):
    rng = random.Random(1)
    rows = [("hot", i, rng.choice([None, 1, 5, -2])) for i in range(700)] + [(None, i, 3) for i in range(40)] + [(f"g{i % 50}", i, 1) for i in range(200)]
    rng.shuffle(rows)
    df = many_chunks.createDataFrame(rows, "g string, at int, v int")
    summed = ranking.running_sum(df, ["g"], [F.col("at").desc()], F.col("v"), "before")
    want, total = set(), {}
    for g, at, v in sorted(rows, key=lambda r: -r[1]):
        want.add((g, at, v, total.get(g, 0)))
        total[g] = total.get(g, 0) + (v or 0)
    assert {tuple(r) for r in summed.collect()} == want
    numbers = [r["n"] for r in ranking.numbered_from(df.where("g = 'hot'"), ["g"], ["at"], "n", first=1).orderBy("at").collect()]
    assert numbers == list(range(1, 701))
    blocks = [ranking.block_of(F.col("at") * (ranking.BLOCK // 10))]
    by_block = ranking.numbered_by_blocks(df, ["g"], blocks, ["at"], "n", first=1)
    assert {(r["g"], r["at"], r["n"]) for r in by_block.collect()} == {(r["g"], r["at"], r["n"]) for r in ranking.numbered_from(df, ["g"], ["at"], "n", first=1).collect()}
    assert ranking.numbered_from(df.limit(0), ["g"], ["at"], "n").count() == 0


def read_depth_first(rows):
    """(scope, uid) to place, with an explicit stack."""
    children, place, count = {}, {}, {}
    for scope, uid, parent, root, date in sorted(rows, key=lambda r: (r[4], r[1])):
        children.setdefault((scope, parent), []).append((uid, root))
    stack = [(s, u, r) for (s, p), kids in children.items() if p is None for u, r in kids]
    while stack:
        scope, uid, root = stack.pop()
        place[scope, uid] = count.get((scope, root), 0)
        count[scope, root] = place[scope, uid] + 1
        stack += [(scope, u, r) for u, r in reversed(children.get((scope, uid), []))]
    return place


def test_preorder_of_random_forests_and_a_hot_parent(many_chunks):
    rng, rows = random.Random(2), []
    for scope in ("a", "b"):
        root_of = {}
        for uid in range(300):
            parent = None if uid == 0 or rng.random() < 0.05 else 0 if rng.random() < 0.4 else rng.randrange(uid)
            root_of[uid] = uid if parent is None else root_of[parent]
            rows.append((scope, uid, parent, root_of[uid], f"{rng.randrange(5)}"))
    df = many_chunks.createDataFrame(rows, "scope string, uid long, parent_uid long, root_uid long, date string")
    got = threads.preorder(df, [F.col("date")])
    assert {(r["scope"], r["uid"]): r["thread_pos"] for r in got.collect()} == read_depth_first(rows)
    sizes = {(r["scope"], r["uid"]): r["size"] for r in threads.subtree_sizes(df).collect()}
    assert sum(v for k, v in sizes.items() if any(k == (r[0], r[1]) and r[2] is None for r in rows)) == 600
    assert threads.preorder(df.limit(0), [F.col("date")]).count() == 0


def test_preorder_runs_no_python_and_no_group_a_thread(spark):
    df = spark.createDataFrame([("a", 0, None, 0, "x")], "scope string, uid long, parent_uid long, root_uid long, date string")
    plan = threads.preorder(df, [F.col("date")])._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Window" not in plan.replace("WindowExpression", "")
