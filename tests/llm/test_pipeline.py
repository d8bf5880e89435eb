"""The corpus pipeline, stage by stage, against what brute force keeps; and the registered queries' shapes."""

import math
import random

import pytest
from test_near_and_leaks import brute_join, brute_leaks

import corpus_pipeline
from heliograph.llm import language_id
from heliograph.llm.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, part string, key int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    words = {"en": "the of and with thing house reading water", "de": "der die und nicht straße lesen wasser haus"}
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(80):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang].split()) + str(rng.randrange(60)) for _ in range(rng.choice([6, 30, 70])))
        rows.append([i, text, lang, rng.choice(["a", "b", None])])
    rows[10][1] = rows[4][1]
    rows[11][1] = rows[5][1] + " more"
    items = [(0, " ".join(f"leak{j}" for j in range(20))), (1, None)]
    rows[20][1] += " " + items[0][1]
    rows[21][1] += " mail joe@site.example.org or +1 (555) 555-0100"
    rows += [[90, None, "en", "a"], [91, "", "en", "a"], [92, "12 34", None, None], [None, "the house with water", "en", "b"], rows[3][:], [93, "the reading " * 9000, "en", "a"]]
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "x", 1) for r in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [(r[0], r[1]) for r in rows], items


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, folder).cache()
    model = language_id.train(docs)
    names, scores = model.predict(docs.select("text").toArrow().column(0))
    want = [d for (d, n, s) in zip([r.doc_id for r in docs.collect()], names, scores, strict=True) if n != "und" and s > 0]
    assert ids(told) == sorted(want, key=str)
    assert not {90, 91, 92} & {d for d, _ in rows if d in ids(told)}
    assert set(ids(told)) >= set(range(80))
    kept = [(r.doc_id, r.text) for r in told.collect()]

    alone = stages["ngram_jaccard_join"](spark, told, folder).cache()
    low = {(d, c) for d, _, c, _ in brute_join(kept, 5, 80)[0]}
    assert ids(alone) == sorted((d for d, _ in kept if d is None or (d, d) in low), key=str)
    assert 10 not in ids(alone)

    clean = stages["decontamination"](spark, alone, folder).cache()
    texts = [(r.doc_id, r.text) for r in alone.collect()]
    dirty = {d for d, *_ in brute_leaks(texts, items, 5, 80)}
    assert dirty == {20}
    assert ids(clean) == sorted((d for d, _ in texts if d not in dirty), key=str)

    safe = stages["pii_surrogates"](spark, clean, folder).cache()
    before, after = {r.doc_id: r for r in clean.collect()}, {r.doc_id: r for r in safe.collect()}
    assert set(before) == set(after)
    assert "joe@site" not in after[21].text
    assert all(after[d] == before[d] for d in before if d != 21)
    assert after[21].n_chars == len(after[21].text)
    for stage in (told, alone, clean, safe):
        assert stage.columns == docs.columns

    packed = stages["best_fit_packing"](spark, safe, folder).collect()
    tokens = {}
    for r in packed:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.tokens
    count = {}
    for r in safe.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + len((r.text or "").split())
    assert tokens == count
    assert sorted(map(tuple, packed), key=str) == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str)


def test_empty_tables(spark, tables, tmp_path):
    folder, _, items = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "pii_surrogates", "best_fit_packing"]
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, name):
    out = QUERIES[name](spark, TABLES)
    tables_of = {"op6_html_extraction": ("pages", "page_id"), "op2_quote_linking": ("conversations", None), "op11_conversation_repair": ("conversations", "conv_id"), "op13_centroid_clustering": ("embeddings", "vec_id")}
    table, key = tables_of.get(name, ("documents", "doc_id"))
    source = spark.read.parquet(f"{TABLES}/{table}.parquet")
    if name == "op4_decontamination":
        assert out.count() > 0
    elif key is None:
        assert out.count() == source.count()
    elif key == "conv_id":  # a row a conversation
        assert sorted(r[0] for r in out.select(key).collect()) == sorted({r[0] for r in source.select(key).collect()})
    elif key == "vec_id":  # a row a vector of 64 finite components
        kept = [r[0] for r in source.select(key, "embedding").collect() if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]
        assert len(kept) > 0
        assert sorted(r[0] for r in out.select(key).collect()) == sorted(kept)
    else:
        assert sorted({r[0] for r in out.select(key).collect()}) == sorted(r[0] for r in source.select(key).collect())


def test_unlearned_languages_go_at_any_length(spark):
    rng = random.Random(5)
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")

    def text(letters, n):
        return "".join(rng.choice(letters + "     ") for _ in range(n))

    alphabets = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz"]
    strange = [(100_000 + i, text(letters, n)) for i, (letters, n) in enumerate((a, n) for a in alphabets for n in (100, 2000, 20_000, 200_000))]
    extra = spark.createDataFrame(strange, "doc_id long, text string")
    both = docs.unionByName(extra, allowMissingColumns=True)
    kept = set(ids(corpus_pipeline.language(spark, both, TABLES)))
    assert not kept & {i for i, _ in strange}
    assert kept == {r.doc_id for r in docs.where("text rlike '[a-zA-Z]'").collect()}
