"""Token counts, language ID and quality: brute force, set membership, held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest

from heliograph.llm import language_id, quality, token_counts
from heliograph.llm.textops import chunks

TABLES = "/root/testdata/sf0.01"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.Vocabulary.load(VOCABULARY)


def test_counts_equal_one_by_one(vocabulary):
    rng = random.Random(1)
    alphabet = "abcdetno  \n\t.,!1234éß漢🙂\0"
    texts = [None, "", " ", "\n", "a", "  a", "a\0", "a\0\0b a\0", "x" * 300, "12" * 60 + " end", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(60))]
    tokens, pres = token_counts.Counter(vocabulary)(pa.array(texts))
    for text, n, p in zip(texts, tokens, pres, strict=True):
        own = list(token_counts.segment(text or "", vocabulary))
        assert b"".join(own) == (text or "").encode()
        assert (n, p) == (sum(map(vocabulary.count_one, own)), len(own))


def test_prefixes_are_shared(vocabulary):
    words = [b" interest", b" interesting", b" interested", b" interests", b" internal"]
    width = 16
    letters = np.array([list(w.ljust(width, b"\0")) for w in words], dtype=np.uint8)
    counts, nodes = token_counts.count_trie(letters, np.array([len(w) for w in words]), vocabulary)
    assert counts.tolist() == [vocabulary.count_one(w) for w in words]
    assert nodes == len({w[:i] for w in words for i in range(1, len(w) + 1)}) < sum(map(len, words))


def test_small_vocabulary_prefers_the_best_path():
    v = token_counts.Vocabulary.build({b"ab": 0, b"abc": 1, b"c": 2, b"d": 3, b"cd": 4})
    assert v.count_one(b"abcd") == 2
    assert v.count_one(b"") == 0


def test_count_column(spark, vocabulary):
    df = spark.createDataFrame([(1, "one two", 9), (2, None, 9), (2, None, 9)], "doc_id long, text string, n_tokens int")
    rows = token_counts.count_tokens(df, vocabulary).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.n_pretokens) for r in rows] == [(1, 2, 2), (2, 0, 0), (2, 0, 0)]
    assert token_counts.count_tokens(df.limit(0), vocabulary).collect() == []


def naive_stream(text):
    out = [0]
    for c in text:
        if c.isalpha():
            low = c.lower()
            out.append(ord(low) if len(low) == 1 else ord(c))
        elif out[-1] != 0:
            out.append(0)
    if out[-1] != 0:
        out.append(0)
    return out


def test_letter_stream_and_grams():
    texts = ["Ab, c1d", "", "  ", "é", "Straße ÀB!", "x" * 9, "末 term"]
    for _, _, data, offsets in chunks(pa.array(texts)):
        stream, bounds, letters = language_id.letter_stream(data, offsets)
        for size in (3, 5):
            h, row = language_id.grams(stream, bounds, size)
            for i, text in enumerate(texts):
                s = naive_stream(text)
                assert (row == i).sum() == sum(1 for j in range(len(s) - size + 1)), (text, size)
        assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_bytes_that_are_no_text():
    data, good = b"ab\xffcd" + "né".encode(), "ab\ufffdcdné".encode()
    bad = language_id.letter_stream(np.frombuffer(data, dtype=np.uint8), np.array([0, 5, 8]))
    want = language_id.letter_stream(np.frombuffer(good, dtype=np.uint8), np.array([0, 7, 10]))
    assert all((x == y).all() for x, y in zip(bad, want))


def test_training_without_a_cut_holds_every_ngram(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = language_id.train(docs, min_share=0.0, rows_per_language=10**6)
    learned = docs.where(~language_id.held_out("doc_id") & (docs.lang == "de")).select("text").collect()
    b = model.languages.index("de")
    for _, _, data, offsets in chunks(pa.array([r.text for r in learned], pa.string())):
        stream, bounds, _ = language_id.letter_stream(data, offsets)
        for size in language_id.SIZES:
            h, _ = language_id.grams(stream, bounds, size)
            assert ((model.lookup(h)[b // 64] >> b % 64) & 1).all()


def test_filter_masks_have_no_false_negative():
    rng = np.random.default_rng(2)
    members = {f"l{i:02}": rng.integers(0, 2**63, 3000).astype(np.uint64) for i in range(70)}
    model = language_id.LanguageModel.build(members, "l02", bits=16)
    bit = lambda h, b: (model.lookup(h)[b // 64] >> np.uint64(b % 64)) & np.uint64(1)
    for b, name in enumerate(model.languages):
        assert bit(members[name], b).all()
    strange = rng.integers(0, 2**63, 20000).astype(np.uint64)
    for b in (0, 1, 63, 64, 69):
        assert abs(bit(strange, b).mean() - model.false_rate[b]) < 0.01


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = language_id.train(docs)
    out = language_id.identify(docs.withColumn("ho", language_id.held_out("doc_id")), model).where("ho").collect()
    assert len(out) > 150
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 34 !?", 0), (4, "漢字", 0), (5, "der die und nicht", 0), (5, "der die und nicht", 0)], "doc_id long, text string, lang_score int")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] in model.languages
    assert got[4][1] == 0.0
    assert got[5][0] == "de"
    assert language_id.train(odd.selectExpr("doc_id", "text", "cast(null as string) lang")) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_pairs_are_ranked(spark):
    docs, labels = spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).join(labels, "doc_id").where(language_id.held_out("doc_id")).collect()
    good = [r.quality_score for r in scored if r.quality == 1]
    bad = [r.quality_score for r in scored if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([g >= quality.CUT for g in good]) > 0.9


def test_quality_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 30000, 5), (4, "ein Text", 5), (4, "ein Text", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    flat = quality.score(df, quality.train(df, none)).collect()
    assert len({r.quality_score for r in flat}) == 1
    assert 0 <= flat[0].quality_score <= 1
    one_sided = spark.createDataFrame([(i, 0) for i in range(20)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert all(r.quality_score < quality.CUT for r in quality.score(df, quality.train(df, one_sided)).collect())
    got = quality.features(pa.array([None, "", "a"]))
    assert np.array_equal(got[0], got[1])
    assert quality.score(df.limit(0), quality.train(df, none)).collect() == []


def test_fit_prefers_the_better_side():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    label = (x[:, 2] - x[:, 5] + 0.1 * rng.normal(size=600) > -1).astype(int)
    model = quality.fit_pairs(x, label, pairs=20000)
    s = model.score(x)
    assert ((s >= quality.CUT) == (label == 1)).mean() > 0.95


def test_long_pretokens_share_their_prefixes():
    import time

    from heliograph.llm import token_counts

    rng = random.Random(9)
    ranks = {p: i for i, p in enumerate(dict.fromkeys("".join(rng.choice("ab中文") for _ in range(rng.randrange(1, 6))).encode() for _ in range(300)))}
    vocabulary = token_counts.Vocabulary.build(ranks)

    def plain(token):
        # the best score of all segmentations, then the one whose last pieces are longest
        best = {0: (0.0, 0)}
        for end in range(1, len(token) + 1):
            found = [(best[s][0] + vocabulary.pieces[token[s:end]], -s, best[s][1] + 1) for s in range(max(0, end - vocabulary.longest), end) if token[s:end] in vocabulary.pieces]
            top = max(x[0] for x in found)
            score, _, n = min((x for x in found if x[0] == top), key=lambda x: -x[1])
            best[end] = (score, n)
        return best[len(token)][1]

    base = "".join(rng.choice("ab中文字") for _ in range(120)).encode()
    tokens = sorted({base[: rng.randrange(49, len(base))] + "".join(rng.choice("abc中") for _ in range(rng.randrange(30))).encode() for _ in range(60)})
    counts, nodes = token_counts.count_long(tokens, vocabulary)
    assert counts == [plain(t) for t in tokens]
    assert nodes == len({t[:i] for t in tokens for i in range(1, len(t) + 1)})
    began = time.perf_counter()
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(350_000))
    assert token_counts.Counter(vocabulary)(pa.array([text], pa.string()))[0][0] > 0
    assert time.perf_counter() - began < 20


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, ("good words, and more. " if i % 2 else "BAD!!! $$$ ") * 5) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    often = labels.unionAll(spark.createDataFrame([(1, 1)] * 500, "doc_id long, quality int"))
    assert (quality.train(docs, labels).weights == quality.train(docs, often).weights).all()
    few = quality.train(docs.unionAll(docs.where("doc_id = 1").crossJoin(spark.range(500)).drop("id")), labels, max_rows=150)
    assert abs(few.weights).max() > 0


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "plain words in a row, " * (1 + i % 7) + ("" if i % 9 else "$$$ BUY !!! ")) for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(3000)], "doc_id long, quality int")
    used = [r.doc_id for r in docs.where(~language_id.held_out("doc_id")).select("doc_id").collect()]
    x = quality.features(pa.array([r.text for r in docs.where(~language_id.held_out("doc_id")).collect()]))
    label = np.array([int(i % 9 > 0) for i in used])
    monkeypatch.setattr(quality, "BLOCK", 1 << 20)
    model, all_pairs = quality.train(docs, labels), quality.fit_pairs(x, label)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.weights, all_pairs.weights, atol=1e-6) and np.isclose(model.threshold, all_pairs.threshold, atol=1e-6)
    monkeypatch.setattr(quality, "BLOCK", 100)
    many = quality.train(docs, labels)
    assert np.allclose(many.mean, x.mean(axis=0)) and np.isclose(many.threshold, np.quantile(many.latent(x), 1 - label.mean()), atol=1e-6)


def test_quantiles_are_exact(spark):
    from heliograph.llm.quantiles import quantiles

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=4001), "b": np.repeat(rng.random(5), 300), "c": np.array([3.5])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("d", 1.0)], "g string, v double")
    got = quantiles(df, {"a": 0.37, "b": 0.5, "c": 0.9, "e": 0.5})
    assert got.keys() == groups.keys()
    assert all(np.isclose(got[g], np.quantile(groups[g], q), rtol=1e-12) for g, q in (("a", 0.37), ("b", 0.5), ("c", 0.9)))


def test_language_model_and_shares_come_from_all_rows(spark):
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(400)]
    docs = spark.createDataFrame([(i, f"some words {names[i % 400]} {names[(i * i) % 400]}", "x" if i % 3 else "y") for i in range(6000)], "doc_id long, text string, lang string")
    model, whole = language_id.train(docs), language_id.train(docs, rows_per_language=10**9)
    assert (model.cells == whole.cells).all()
    told = [r for r in language_id.identify(docs.where(language_id.held_out("doc_id")), model).collect() if r.lang_score > 0]
    least = language_id.least_shares(docs, model)
    for lang in model.languages:
        assert np.isclose(least[lang], language_id.LEAST_PART * np.median([r.lang_score for r in told if r.lang_pred == lang]), rtol=1e-12)
