"""Token shards and their index: exact round trips against the tokenizer itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heliograph.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def expected(rows):
    """The rows that the contract asks for; rows of equal keys may come in any order."""
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def written(spark, rows, tmp_path, definition, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'x' AS part").repartition(3)
    files = tf.write(df, str(tmp_path / "set"), definition, **options)
    return df, files


def result(df, files, **options):
    return sorted((tuple(r) for r in tf.read(tf.lookup(df, files), files, **options).collect()), key=lambda r: r[1])


def texts(seed, n):
    rng = random.Random(seed)
    words = ["Hello", "world,", "it's", "don't.", "e.g.", "naïve", "café", "1234", "a1b2", "<|endoftext|>", "x<|startoftext|>y", "ΣΊΣΥΦΟΣ", "你好。世界", "́mark", "a,̸b", "🙂", "¿Qué?", "—", "d'accord;", "THE", "İ", "İ.", "\u0958.", "É,", "ß!", "1.5", " ", " wide"]
    return [" ".join(rng.choices(words, k=rng.randrange(0, 30))).replace(" ", rng.choice([" ", "\n", " \t ", "　", "\x0b"]), 3) for _ in range(n)]


def test_round_trip(spark, tmp_path, definition):
    rows = [(i * 37 % 1009 - 300, t) for i, t in enumerate(texts(1, 400))] + [(5000, None), (5001, ""), (2**62, "far"), (-(2**62), "low"), (7000, "word " * 200_000), (7001, "中" * 50_000)]
    df, files = written(spark, rows, tmp_path, definition, bucket_keys=16, shards=5)
    assert files.buckets > 20 and len(files.ids) > 1
    assert result(df, files) == expected(sorted(rows))
    assert tf.TokenFiles.load(files.folder).starts == files.starts and files.total == sum(r[2] for r in expected(rows))


def test_cut_texts_encode_as_whole_ones(definition):
    import pyarrow as pa

    tokenizer, many = Tokenizer.from_file(PATH), [*texts(2, 500), None]
    ids, bounds = tf.PieceEncoder(definition).encode(pa.array(many))
    for text, a, b in zip(many, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_repeated_null_and_hot_keys(spark, tmp_path, definition):
    rows = [(None, "first"), (None, "second one"), (4, "same"), (4, "same"), (9, "z")] + [(6, f"hot {i} {'x ' * (i % 7)}") for i in range(3000)]
    df, files = written(spark, rows, tmp_path, definition, bucket_keys=4, shards=5)
    got = result(df, files)
    assert len(got) == len(rows) and sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(rows))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    parts = tf.lookup(df.where("doc_id = 6"), files).collect()
    assert len(parts) > 1 and sum(p["docs"] for p in parts) == 3000


def test_absent_keys_and_empty_tables(spark, tmp_path, definition):
    df, files = written(spark, [(1, "a"), (2, "b c")], tmp_path, definition)
    asked = spark.createDataFrame([(2,), (3,), (None,), (2,)], "doc_id long")
    found = tf.read(tf.lookup(asked, files), files, with_ids=True).collect()
    assert [(r["key"], r["start"], len(r["ids"]), r["ids"][-1]) for r in found] == [(2, 2, 3, 1)]
    df, files = written(spark, [], tmp_path / "none", definition)
    assert result(asked, files) == [] and files.ids == []


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000, 100_000):
        keys = np.unique(rng.integers(0, 2**63, size=n, dtype=np.uint64))
        parts = np.zeros(len(keys), dtype=np.uint32)
        hashed = tf.PerfectHash.build(keys, parts)
        assert sorted(hashed.slots(keys, parts).tolist()) == list(range(len(keys)))
        again, _ = tf.PerfectHash.load(memoryview(hashed.dump()))
        assert again.slots(keys, parts).tolist() == hashed.slots(keys, parts).tolist()
    assert 8 * len(hashed.dump()) < 5 * n
    with pytest.raises(ValueError):
        tf.PerfectHash.build(np.array([5, 5]), np.zeros(2, dtype=np.uint32))


def test_damaged_shard_is_refused(spark, tmp_path, definition):
    _, files = written(spark, [(1, "a b c")], tmp_path, definition)
    path = next(p for p in (tmp_path / "set").iterdir() if p.name.startswith("ids-"))
    path.write_bytes(path.read_bytes()[3:])
    with pytest.raises(ValueError, match="cut short"):
        tf.ShardReader(files.folder, int(path.name[4:12]))


def test_ids_that_do_not_fit(spark, tmp_path, definition):
    with pytest.raises(Exception, match="does not fit"):
        written(spark, [(1, "hello")], tmp_path, definition, width=1)
