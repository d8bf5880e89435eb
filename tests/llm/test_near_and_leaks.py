"""The Jaccard join and decontamination against brute force over word tuples."""

import random
import re

import numpy as np
import pytest

from heliograph.llm import decontaminate, ngram_join
from heliograph.llm.textops import U, mix

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    if len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_join(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)] if d is not None else None, links[i]) for i, (d, _) in enumerate(rows) if d is not None), [len(sets[i]) for i, (d, _) in enumerate(rows) if d is None]


def corpus(seed, docs=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows, texts = [], []
    for i in range(docs):
        kind = rng.random()
        if texts and kind < 0.25:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif texts and kind < 0.35:
            words = rng.choice(texts).split()
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 30, 60, 90]))]
            if rng.random() < 0.4:
                words += passage
        texts.append(" ".join(words))
        rows.append((rng.randrange(1000, 9000) * 2 if i % 2 else i, ("\t" + texts[-1].upper() + " \n") if kind > 0.9 else texts[-1]))
    return [*rows, (7, None), (8, ""), (9, " \n "), (None, texts[0]), rows[0]]


@pytest.mark.parametrize(("seed", "k", "percent", "short"), [(1, 4, 85, 32), (2, 5, 80, 32), (3, 2, 60, 3), (4, 1, 50, 1)])
def test_join_is_exact(spark, monkeypatch, seed, k, percent, short):
    monkeypatch.setattr(ngram_join, "SHORT_RUN", short)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    got = [tuple(r) for r in ngram_join.ngram_jaccard_join(df, k=k, percent=percent).collect()]
    want, nameless = brute_join(rows, k, percent)
    assert sorted(r for r in got if r[0] is not None) == want
    assert sorted(r[1] for r in got if r[0] is None) == sorted(nameless)
    assert all(r[2] is None and r[3] == 0 for r in got if r[0] is None)


def test_join_in_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_TOKENS", 150)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 2)
    rng = random.Random(5)
    base = [f"v{rng.randrange(500)}" for _ in range(40)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(40)] = f"z{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    got = sorted(tuple(r) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=70).collect())
    assert got == brute_join(rows, 3, 70)[0]


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_jaccard_join(empty).collect() == []
    with pytest.raises(ValueError, match="percent"):
        ngram_join.ngram_jaccard_join(empty, percent=0)


def test_groups_are_skipped_by_their_bound():
    rng = np.random.default_rng(3)
    common = mix(np.arange(70, dtype=U), 1)
    sets = [np.sort(np.concatenate([common, mix(np.arange(30, dtype=U) + U(1000 * (i + 1)), 2)])) for i in range(60)]
    _, links, stats = ngram_join.tile_links(sets, np.zeros(60, dtype=int), (0, 0), 85, np.ones(60, dtype=int), group_rows=4)
    assert links.sum() == 0
    assert stats["opened"] <= 60 < stats["bounds"]
    for _ in range(200):
        a, b = (np.unique(mix(rng.integers(0, 400, rng.integers(1, 200)).astype(U), 4)) for _ in range(2))
        assert ngram_join.overlap_bound(ngram_join.profile(a), ngram_join.profile(b), 10**9) >= len(np.intersect1d(a, b))


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g", "p"), (1, "a b c d e f g", "q"), (2, "x y z u v w t", "r"), (None, "a b c d e f g", "s"), (5, None, "t"), (6, "", "u"), (1, "a b c d e f g", "v")]
    kept = ngram_join.keep_first_of_groups(spark.createDataFrame(rows, "doc_id long, text string, extra string"))
    assert sorted(r.extra for r in kept.collect()) == ["q", "r", "s", "t", "u", "v"]


def brute_leaks(docs, items, k, percent):
    out = []
    for d, text in docs:
        words = WORD.findall((text or "").lower())
        for i, item in items:
            size = min(k, len(WORD.findall((item or "").lower())))
            want = shingle_set(item, k)
            if i is None or not want or text is None or len(words) < size:
                continue
            have = {tuple(words[j : j + size]) for j in range(len(words) - size + 1)}
            n = len(want & have)
            if 100 * n >= percent * len(want):
                out.append((d, i, n, len(want)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "percent", "block"), [(1, 80, 1 << 20), (2, 50, 1 << 20), (3, 100, 1 << 20), (4, 80, 600)])
def test_contaminations_are_exact(spark, seed, percent, block):
    rng = random.Random(seed)
    items = [(i, " ".join(f"t{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 4, 5, 9, 20, 60, 140])))) for i in range(25)]
    items += [(90, None), (91, ""), (None, "lost item text here now"), (3, items[3][1])]
    docs = []
    for d in range(60):
        words = [f"t{rng.randrange(400)}" for _ in range(rng.choice([0, 4, 50, 400]))]
        if rng.random() < 0.6:
            own = rng.choice(items[:25])[1].split()
            for _ in range(rng.randrange(0, max(1, len(own) // 4))):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        docs.append((d, " ".join(words)))
    docs += [(70, None), (71, ""), (None, items[10][1]), docs[5]]
    d = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([(a, b, "c") for a, b in items], "item_id long, text string, doc_id string")
    got = decontaminate.contaminations(d, b, percent=percent, block_bytes=block).collect()
    want = brute_leaks(docs, items, 5, percent)
    assert sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got), key=str) == want
    assert all(abs(r.containment - r.shared / r.item_shingles) < 1e-12 for r in got)
    stay = decontaminate.remove_contaminated(d, b, percent=percent, block_bytes=block).collect()
    dirty = {(x[0]) for x in want}
    assert sorted((r.doc_id for r in stay), key=str) == sorted((a for a, _ in docs if a not in dirty), key=str)


def test_contaminations_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminations(d, b).collect() == []
    assert decontaminate.remove_contaminated(d, b).collect() == []


def test_shared_phrases_make_no_pairs_where_the_sketch_is_full(spark):
    """Six hundred unrelated documents with the same phrases: a sketch that tells nothing must not let these meet."""
    rng = random.Random(7)
    phrases = [" ".join(f"p{i}x{j}" for j in range(5)) for i in range(40)]
    rows = []
    for i in range(600):
        own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))
        rows.append((i, " ".join(f"{own()} {p}" for p in rng.sample(phrases, 12))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    full = np.full(1 << ngram_join.SKETCH_BITS, 1000, dtype=np.int64)
    met = ngram_join._met(docs, docs.selectExpr("doc_id AS first_id"), full, 4, 0, 85)
    assert met.count() < 100
    assert ngram_join.ngram_jaccard_join(docs, k=4, percent=85).where("component_id <> doc_id").count() == 0


def test_shingles_of_one_set_only_are_not_dealt(spark, monkeypatch):
    """Where the sketch is full, prefixes deal what may meet (op1's CPU seconds), and the join stays that of brute force."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(300)]
    for i in range(300, 340):
        words = rows[i - 300][1].split()
        words[rng.randrange(60)] = "other"
        rows.append((i, " ".join(words + ["and", "more"][: i % 3])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    full = np.full(1 << ngram_join.SKETCH_BITS, 1000, dtype=np.int64)
    chosen, bits = ngram_join._id_bitmap(docs.selectExpr("doc_id AS first_id"))
    texts = ngram_join._with_bit(docs, bits)
    known = ngram_join._frequent(texts, 4, 0, 80, np.full(1 << ngram_join.SKETCH_BITS, 20, dtype=np.int64), chosen)
    prefix = texts.mapInArrow(ngram_join._prefixes(4, 0, 80, full.astype(np.int32), chosen, known), "token long, n int, key long, index boolean")
    assert 40 <= prefix.count() < 2600  # of about 4500 places
    monkeypatch.setattr(ngram_join, "_sketch", lambda _: np.full(1 << ngram_join.SKETCH_BITS, 20, dtype=np.int64))
    got = ngram_join.ngram_jaccard_join(docs, k=4, percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == brute_join(rows, 4, 80)[0]
    assert len({r.component_id for r in got}) == 300


def test_copies_add_no_rows_to_the_prefixes(spark):
    docs = spark.createDataFrame([(i, f"a{i % 7} b c d e f g{i % 7} h i j k") for i in range(700)], "doc_id long, text string").repartition(8)
    chosen, bits = ngram_join._id_bitmap(spark.range(7).selectExpr("id AS first_id"))
    sketch = np.zeros(1 << ngram_join.SKETCH_BITS, dtype=np.int32)
    prefix = ngram_join._with_bit(docs, bits).mapInArrow(ngram_join._prefixes(4, 0, 85, sketch, chosen, None), "token long, n int, key long, index boolean")
    assert prefix.groupBy("key", "token").count().agg({"count": "sum"}).first()[0] <= 2 * 7 * 2
    assert {r["component_id"] for r in ngram_join.ngram_jaccard_join(docs, k=4, percent=85).collect()} == set(range(7))
