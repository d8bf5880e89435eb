"""Conversation repair against every edit string, Lloyd rounds against Python integers."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

from heliograph.llm import conversation_repair as cr
from heliograph.llm import lloyd

EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, edits, repaired) of rows (role, text, fault), by best-first search over edit strings."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, made = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, made
        # what matters of the written initials is where they are in the pattern
        place = (at, "" if not initials else initials if initials == "s" else initials[-1])
        if place in seen or not re.fullmatch("s?(ua)*u?", initials):
            continue
        seen.add(place)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, initials + role[0], (*made, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, initials, made))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + (role[:1] or "?"), (*made, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, initials + new[0], (*made, (new, text))))
    raise AssertionError


def brute_report(rows):
    out = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        if not mine:
            out[conv] = (0, 0, 0, 0, 0, 0, "", EMPTY)
            continue
        seen, marked = set(), []
        for _, _, role, text in mine:
            visible = re.findall("[^\x20\x09-\x0d]", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, made = cheapest(marked)
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        out[conv] = (gaps, *[sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)
    return out


def report(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        df = df.selectExpr("*", extra)
    messages = cr.damage(df)
    plan = cr.repair_plan(messages)
    got = cr.repair_report(df, messages, plan).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rng.randrange(-3, 3)
        for _ in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "cut", "Dot. ", "x\n\t", "", " \x0b", None, "Yes.", f"t{rng.random()}."])
            rows.append((conv if conv else None, turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 7])
        if rng.random() < 0.2:
            rows.append((conv if conv else None, None, "user", "No turn."))
    return rows


def test_repair_equals_search_over_all_edits(spark):
    rows = conversations(5, 250)
    assert report(spark, rows) == brute_report(rows)


def test_repair_does_not_depend_on_order_partitions_or_other_columns(spark):
    rows = conversations(6, 40)
    want = report(spark, rows)
    random.Random(1).shuffle(rows)
    assert report(spark, rows, "'x' AS audit") == want


def test_dropped_conversations_and_empty_tables(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(spark, [(conv, 0, "user", "Gone.")]) == {conv: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert report(spark, []) == {}


def test_long_conversation_is_cut_by_batches_and_stays_one(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "Word." * (1 + t % 3) + str(t) + ".") for t in range(25_000)]
    rows += [(2, 0, "user", "A" * 2_000_000 + "."), (2, 1, "assistant", "B.")]
    got = report(spark, rows)
    after = sorted((r for r in damaged(rows) if r[0] == 1), key=lambda r: r[1])
    assert len(got[1][6].replace("I", "")) == len(after) and got[2] == brute_report(rows[-2:])[2]


def test_automaton_keeps_few_vectors():
    rng, automaton = random.Random(3), cr.CostAutomaton()
    for _ in range(300):
        automaton.repair(bytes(rng.choices(range(16), k=40)))
    assert len(automaton.vectors) < 60
    assert automaton.repair(b"") == (0, "")


def test_repaired_rows(spark):
    df = spark.createDataFrame([(7, 1, "user", "Hi."), (7, 2, "user", "Again."), (7, 3, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    got = cr.apply_plan(df, cr.repair_plan(df)).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(7, 0, "keep", "user", "Again."), (7, 1, "keep", "assistant", "Yes.")]


def brute_lloyd(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    mids = [v for _, v in starts[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((far(v, m), c) for c, m in enumerate(mids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        mids = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else m for c, m in enumerate(mids)]
    placed = [(i, *place(v)) for i, v in kept]
    inertia = {}
    for _, d, c in placed:
        inertia[c] = inertia.get(c, 0) + d
    total = sum(inertia.values())
    fits = lambda v: v if v < 2**63 else None
    known = all(d < 2**63 for _, d, _ in placed)
    of = lambda c: fits(inertia[c]) if all(d < 2**63 for _, d, x in placed if x == c) else None
    return sorted(((i, c, fits(d), of(c), fits(total) if known else None, hashlib.sha256(",".join(map(str, mids[c])).encode()).hexdigest()) for i, d, c in placed), key=str)


def lloyd_rows(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'mine' AS cluster", "1 AS inertia")
    df = df.repartition(5)
    centroids = lloyd.fit(df)
    assigned = lloyd.assign(df, centroids)
    got = lloyd.with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


def vectors(seed, n):
    rng = random.Random(seed)
    f32 = lambda x: float(__import__("numpy").float32(x))
    rows = [(i, [f32(rng.gauss((i % 5) - 2, 0.4)) for _ in range(64)]) for i in range(n)]
    rows += [(n + 1, None), (n + 2, []), (n + 3, [0.0] * 63), (n + 4, [None] + [0.0] * 63), (n + 5, [float("nan")] + [0.0] * 63), (n + 6, [float("-inf")] + [0.0] * 63)]
    rows += [rows[0], rows[0], (None, rows[3][1]), (2**60 + 1, rows[4][1])]
    return rows


def test_lloyd_equals_python_integers(spark):
    rows = vectors(1, 300)
    assert lloyd_rows(spark, rows) == brute_lloyd(rows)


def test_lloyd_with_few_vectors_and_none(spark):
    rows = vectors(2, 3)
    assert lloyd_rows(spark, rows) == brute_lloyd(rows)
    assert lloyd_rows(spark, []) == [] and lloyd_rows(spark, [(1, None)]) == []


def test_lloyd_is_exact_for_wide_components(spark):
    rows = [(i, [float(i * 10.0**9)] + [0.5] * 63) for i in range(20)] + [(30, [1e300] * 64), (31, [-1e300] * 64)]
    assert lloyd_rows(spark, rows, "double") == brute_lloyd(rows)
