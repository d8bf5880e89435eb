"""Token ids as binary shards with a minimal perfect hash index.

A data set is a folder in a store that all executors reach (``file``, ``hdfs``,
``s3``, ``gs``: what Arrow's file systems open):

``ids-<shard>.bin``    the raw ids of the shard's documents one after the other, little-endian, 2 or 4 bytes each,
                       padded to a multiple of 8; where each document ends, as 8-byte counts of ids; a footer of 64
                       bytes (magic, version, width, numbers of ids and documents)
``index-<bucket>.mph`` a minimal perfect hash of the keys of a bucket and a table of entries: fingerprint, part,
                       number of parts, shard, first document in the shard, number of documents
``manifest.json``      the number of buckets and of the ids in each shard

Documents lie in ascending key order over the shards.  The hash is a cascade of
bit arrays: on each level a key that no other key meets owns its bit, the others
go on to the next; a key's slot is the rank of its bit, which counts of every
word give in one step.  Keys are 64-bit integers and the fingerprint is a
bijective mix of all their bits, so an absent key is never taken for a present
one.  A key whose documents reach over several shards has an entry, a *part*,
for each.  ``lookup`` finds keys in bulk: a shuffle of keys to their buckets,
one of locations to their shards, both narrow.

Files are written under a name of the attempt and then renamed, so that tasks
that run twice, or are lost on the way, leave the same file.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.lineage import keep
from heliograph.llm.textops import U, flat, mix

MAGIC, VERSION = b"HGTOKENS", 1
FOOTER = struct.Struct("<8sIIQQ32x")
INDEX_HEADER = struct.Struct("<8sI4xQ")
ENTRY = np.dtype([("fingerprint", "<u8"), ("part", "<u4"), ("parts", "<u4"), ("shard", "<u8"), ("first", "<u8"), ("docs", "<u8")])
#: Aimed-for number of keys of an index bucket; the number of buckets follows the number of keys.
BUCKET_KEYS = 1 << 18
#: Bits a key on each level of the hash.
GAMMA = 2
#: The bit of a part that marks the null key.
NULL_PART = 1 << 31
#: Bytes that are read at least, so that neighbouring documents need no read each.
READ_AHEAD = 1 << 20
#: Encoded pieces that a worker remembers before it starts anew; only a store of earlier answers.
REMEMBERED = 1 << 20


# --- encoding

#: Letters that lower-casing and NFC leave single letters (not U+0130), before a mark that is never in a pre-token with letters.
_BEFORE_MARK = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481])([,.;:!?])"


class PieceEncoder:
    """Ids of whole texts by a tokenizer, each distinct piece encoded once.

    A text is cut where the tokenizer cuts it anyway: at ASCII white space, and
    where one of ``,.;:!?`` follows a Latin or Cyrillic letter whose small form
    and composed form are one letter again.  That holds for tokenizers whose
    pre-tokens are never of letters together with these marks and never have
    white space in them; ``whole=True`` is for all others.
    """

    def __init__(self, definition: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_str(definition), whole
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the pieces in ``ids`` and ``bounds``; new ones are encoded."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self._forget()
            new = pieces
        got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        sizes = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        more = np.fromiter((i for ids in got for i in ids), dtype=np.uint32, count=int(sizes.sum()))
        self.ids = np.concatenate([self.ids, more])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        return np.fromiter((self.known[p] for p in pieces), dtype=np.int64, count=len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and where those of each row begin and end; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.whole:
            pieces, row_ends = texts, np.arange(len(texts) + 1)
        else:
            split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _BEFORE_MARK, r"\1 \2"))
            pieces, row_ends = split.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)))).astype(np.int64)
        coded = pieces.dictionary_encode()
        number = self._learn(coded.dictionary.to_pylist())
        of = number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, dtype=np.int64)
        sizes = (self.bounds[1:] - self.bounds[:-1])[of]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(ends[-1]) + np.repeat(self.bounds[of] - ends[:-1], sizes)
        return self.ids[at], ends[row_ends]


_encoders: dict[tuple[int, bool], PieceEncoder] = {}


def _encoder(definition: str, whole: bool) -> PieceEncoder:
    key = (zlib.crc32(definition.encode()), whole)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(definition, whole)
    return _encoders[key]


# --- files


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


class _Shard:
    """Writes the ids of one shard; only the documents' ends are held."""

    def __init__(self, folder: str, shard: int, width: int):
        self.fs, root = _open(folder)
        self.path, self.part = f"{root}/ids-{shard:08d}.bin", f"{root}/.ids-{shard:08d}-{uuid.uuid4().hex}"
        self.kind, self.ends, self.total = np.dtype(f"<u{width}"), [], 0
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.width = width

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        self.ends.append(self.total + ends)
        self.total += len(ids)

    def close(self) -> None:
        ends = np.concatenate(self.ends).astype("<u8") if self.ends else np.zeros(0, dtype="<u8")
        self.out.write(bytes(-self.total * self.width % 8) + ends.tobytes() + FOOTER.pack(MAGIC, VERSION, self.width, self.total, len(ends)))
        self.out.close()
        self.fs.move(self.part, self.path)


def shard_footer(file: pa.NativeFile) -> tuple[int, int, int]:
    """(bytes an id, ids, documents) of a shard."""
    size = file.size()
    magic, version, width, ids, docs = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token shard")
    if size != ids * width + (-ids * width) % 8 + 8 * docs + FOOTER.size:
        raise ValueError("a token shard is cut short")
    return width, ids, docs


class _Window:
    """The last range of a file that was read."""

    def __init__(self, file: pa.NativeFile, end: int):
        self.file, self.end, self.begin, self.data = file, end, 0, b""

    def at(self, offset: int, size: int) -> memoryview:
        if not self.begin <= offset <= offset + size <= self.begin + len(self.data):
            self.begin, self.data = offset, self.file.read_at(max(size, min(READ_AHEAD, self.end - offset)), offset)
        return memoryview(self.data)[offset - self.begin :][:size]


class ShardReader:
    """Documents of a shard by their place in it: two reads, whatever the size of the shard."""

    def __init__(self, folder: str, shard: int):
        files, root = _open(folder)
        self.file = files.open_input_file(f"{root}/ids-{shard:08d}.bin")
        self.width, self.total, self.docs = shard_footer(self.file)
        self.table = self.total * self.width + (-self.total * self.width) % 8
        self.payload, self.places = _Window(self.file, self.table), _Window(self.file, self.table + 8 * self.docs)

    def ends(self, first: int, docs: int) -> np.ndarray:
        """Where ``docs`` documents begin, and where the last one ends."""
        if not 0 <= first <= first + docs <= self.docs:
            raise IndexError("no such document in the shard")
        got = np.frombuffer(self.places.at(self.table + 8 * (first - (first > 0)), 8 * (docs + (first > 0))), dtype="<u8")
        return got if first else np.concatenate((np.zeros(1, dtype="<u8"), got))

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.payload.at(begin * self.width, (end - begin) * self.width), dtype=f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


# --- minimal perfect hash


def _pair(keys: np.ndarray, parts: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(keys, seed) + parts.astype(U) * U(0x9E3779B97F4A7C15), seed + 1)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(U), 101)


class PerfectHash:
    """A minimal perfect hash of distinct (key, part) pairs."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # words of 64 bits
        self.before = []
        total = 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.concatenate(([0], np.cumsum(counts)))[:-1])
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray, parts: np.ndarray) -> PerfectHash:
        levels, keys, parts = [], keys.astype(U), parts.astype(np.uint32)
        while len(keys):
            words = max(1, -(-GAMMA * len(keys) // 64))
            at = (_pair(keys, parts, 7 + 2 * len(levels)) % U(64 * words)).astype(np.int64)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(U))
            stay = ~alone[at]
            if len(levels) > 200:
                raise ValueError("pairs of key and part are repeated")
            keys, parts = keys[stay], parts[stay]
        return cls(levels)

    def slots(self, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The slot of each pair; -1, or some slot, for pairs that are not in the index."""
        keys, out = keys.astype(U), np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for i, words in enumerate(self.levels):
            at = _pair(keys[left], parts[left], 7 + 2 * i) % U(64 * len(words))
            word, bit = (at >> U(6)).astype(np.int64), at & U(63)
            hit = (words[word] >> bit) & U(1) == U(1)
            below = words[word] & ((U(1) << bit) - U(1))
            out[left[hit]] = (self.before[i][word] + np.bitwise_count(below))[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dump(self) -> bytes:
        return struct.pack("<I4x", len(self.levels)) + b"".join(struct.pack("<Q", len(w)) + w.astype("<u8").tobytes() for w in self.levels)

    @classmethod
    def load(cls, data: memoryview) -> tuple[PerfectHash, int]:
        (count,), at, levels = struct.unpack_from("<I4x", data), 8, []
        for _ in range(count):
            (words,) = struct.unpack_from("<Q", data, at)
            levels.append(np.frombuffer(data, dtype="<u8", count=words, offset=at + 8).astype(U))
            at += 8 + 8 * words
        return cls(levels), at


def write_bucket(folder: str, bucket: int, entries: pd.DataFrame) -> None:
    """The index file of a bucket from its entries: key, part, parts, shard, first, docs."""
    keys, parts = entries["key"].to_numpy(dtype=np.int64).view(U), entries["part"].to_numpy(dtype=np.uint32)
    hashed = PerfectHash.build(keys, parts)
    table = np.zeros(len(keys), dtype=ENTRY)
    at = hashed.slots(keys, parts)
    table["fingerprint"][at] = fingerprints(keys)
    for name in ENTRY.names[1:]:
        table[name][at] = entries[name]
    files, root = _open(folder)
    part = f"{root}/.index-{bucket:08d}-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(INDEX_HEADER.pack(MAGIC, VERSION, len(keys)))
        out.write(hashed.dump())
        out.write(table.tobytes())
    files.move(part, f"{root}/index-{bucket:08d}.mph")


class BucketReader:
    """One bucket of the index."""

    def __init__(self, folder: str, bucket: int):
        files, root = _open(folder)
        with files.open_input_file(f"{root}/index-{bucket:08d}.mph") as file:
            data = memoryview(file.read())
        magic, version, keys = INDEX_HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token index")
        self.hashed, used = PerfectHash.load(data[INDEX_HEADER.size :])
        self.table = np.frombuffer(data, dtype=ENTRY, offset=INDEX_HEADER.size + used, count=keys)

    def find(self, keys: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its entry) for each pair."""
        if not len(self.table):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=ENTRY)
        slot = self.hashed.slots(keys, parts)
        entry = self.table[np.maximum(slot, 0)]
        return (slot >= 0) & (entry["fingerprint"] == fingerprints(keys)) & (entry["part"] == parts), entry


def bucket_of(keys: np.ndarray, parts: np.ndarray, buckets: int) -> np.ndarray:
    return (_pair(keys.astype(U), parts, 3) % U(buckets)).astype(np.int64)


# --- Spark jobs


def _without_null(df: DataFrame) -> DataFrame:
    """The null key as a bit of the part, so that Python sees whole numbers only."""
    return df.withColumn("part", F.col("part") + F.when(F.col("key").isNull(), NULL_PART).otherwise(0)).withColumn("key", F.coalesce("key", F.lit(0).cast("long")))


def _with_null(df: DataFrame) -> DataFrame:
    missing = F.col("part") >= NULL_PART
    return df.withColumn("key", F.when(~missing, F.col("key"))).withColumn("part", F.col("part") - F.when(missing, NULL_PART).otherwise(0))


class TokenFiles:
    """A written data set: folder, numbers of shards and buckets, ids before each shard."""

    def __init__(self, folder: str, buckets: int, starts: list[int], ids: list[int]):
        self.folder, self.buckets, self.starts, self.ids = folder, buckets, starts, ids

    @property
    def total(self) -> int:
        return sum(self.ids)

    def save(self) -> None:
        files, root = _open(self.folder)
        with files.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps({"version": VERSION, "buckets": self.buckets, "ids": self.ids}).encode())

    @classmethod
    def load(cls, folder: str) -> TokenFiles:
        files, root = _open(folder)
        with files.open_input_file(f"{root}/manifest.json") as file:
            made = json.loads(file.read())
        return cls(folder, made["buckets"], np.concatenate(([0], np.cumsum(made["ids"])))[:-1].astype(int).tolist(), made["ids"])


def write(df: DataFrame, folder: str, definition: str, key_col: str = "doc_id", text_col: str = "text", end_id: int = 1, width: int = 2, whole: bool = False, bucket_keys: int = BUCKET_KEYS, shards: int | None = None) -> TokenFiles:
    """Encode every text and write shards and index into an empty folder.

    ``definition`` is the tokenizer's JSON; ids must fit ``width`` bytes.  A
    null text has the end id alone.  Rows with equal keys lie next to each
    other, ordered by a hash of their texts, and a hot key may reach over
    several shards; the null key comes first.  Keys are integers.  Without
    ``shards`` Spark sizes the shards as it does its shuffle partitions.  The driver
    holds one number for each shard, as it does for each of its tasks.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    rows = df.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(*([shards] if shards else []), "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encoder, out, doc, runs = TaskContext.get().partitionId(), _encoder(shared.value, whole), None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = _Shard(folder, shard, width)
            ids, bounds = encoder.encode(batch.column(1))
            lengths = np.diff(bounds)
            ends = np.cumsum(lengths + 1)
            every = np.full(int(ends[-1]), end_id, dtype=np.uint32)
            every[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
            if width < 4 and len(every) and int(every.max()) >> (8 * width):
                raise ValueError(f"an id does not fit {width} bytes")
            out.add(every, ends)
            keys = batch.column(0)
            runs.append((keys, doc))
            doc += len(keys)
            yield _runs(keys, shard, doc - len(keys), out.total)
        if out is not None:
            out.close()

    schema = "key long, shard long, first long, docs long, ids long"
    spread = keep(ordered.mapInArrow(run, schema), "token-runs")
    shared.unpersist()
    totals = {r["shard"]: r["ids"] for r in spread.groupBy("shard").agg(F.max("ids").alias("ids")).collect()}
    ids = [int(totals.get(s, 0)) for s in range(max(totals, default=-1) + 1)]
    # a key's runs inside a shard are one run, cut by batches; what it has in the n-th of its shards is its n-th part
    by_key = Window.partitionBy("key")
    entries = spread.groupBy("key", "shard").agg(F.min("first").alias("first"), F.sum("docs").alias("docs"))
    entries = entries.withColumn("part", (F.row_number().over(by_key.orderBy("shard")) - 1).cast("long")).withColumn("parts", F.count(F.lit(1)).over(by_key))
    entries = keep(_without_null(entries), "token-entries")
    buckets = max(1, -(-entries.count() // bucket_keys))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def write_held() -> pd.DataFrame:
            write_bucket(folder, now, pd.concat(held))
            return pd.DataFrame({"bucket": [now]})

        for batch in batches:
            for bucket, pdf in batch.groupby("bucket", sort=True):
                if bucket != now and held:
                    yield write_held()
                    held = []
                now = int(bucket)
                held.append(pdf)
        if held:
            yield write_held()

    placed = _with_bucket(entries, buckets).repartition("bucket").sortWithinPartitions("bucket")
    filled = {r["bucket"] for r in placed.mapInPandas(index, "bucket long").collect()}
    none = pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("key", *ENTRY.names[1:])})
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    for bucket in range(buckets):
        if bucket not in filled:
            write_bucket(folder, bucket, none)
    made = TokenFiles(folder, buckets, np.concatenate(([0], np.cumsum(ids)))[:-1].astype(int).tolist(), ids)
    made.save()
    return made


def _runs(keys: pa.Array, shard: int, first: int, total: int) -> pa.RecordBatch:
    """One row for each run of equal keys of a batch; ``total`` is the shard's number of ids so far."""
    values, missing = keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (missing[1:] != missing[:-1])
    at = np.flatnonzero(new)
    docs = np.diff(np.append(at, len(keys)))
    fixed = lambda v: pa.array(np.full(len(at), v, dtype=np.int64))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), fixed(shard), pa.array(at + first), pa.array(docs), fixed(total)], names=["key", "shard", "first", "docs", "ids"])


def _with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Adds ``bucket``, by key and part."""

    @F.pandas_udf("long")
    def bucket(keys: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(keys.to_numpy(dtype=np.int64).view(U), parts.to_numpy(dtype=np.uint32), buckets))

    return df.withColumn("bucket", bucket("key", "part"))


def lookup(keys: DataFrame, files: TokenFiles, key_col: str = "doc_id") -> DataFrame:
    """(key, shard, first, docs) of each distinct key that the data set has; absent keys have no row.

    A key is looked for in its bucket; an entry says how many parts its key
    has, and further parts of the few keys that have any are a second round.
    Each round is one narrow shuffle.
    """
    folder, buckets = files.folder, files.buckets

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reader = None, None
        for batch in batches:
            for bucket, pdf in batch.groupby("bucket", sort=True):
                if bucket != now:
                    now, reader = bucket, BucketReader(folder, int(bucket))
                there, entry = reader.find(pdf["key"].to_numpy(dtype=np.int64).view(U), pdf["part"].to_numpy(dtype=np.uint32))
                yield pd.DataFrame({"key": pdf["key"].to_numpy()[there], "part": pdf["part"].to_numpy()[there], **{c: entry[c][there].astype(np.int64) for c in ("parts", "shard", "first", "docs")}})

    def round_of(asked: DataFrame) -> DataFrame:
        dealt = _with_bucket(_without_null(asked), buckets).repartition("bucket").sortWithinPartitions("bucket")
        return keep(_with_null(dealt.mapInPandas(find, "key long, part long, parts long, shard long, first long, docs long")), "token-found")

    found = round_of(keys.select(F.col(key_col).cast("long").alias("key")).distinct().withColumn("part", F.lit(0).cast("long")))
    more = found.where("parts > 1").select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)).alias("part"))
    if more.limit(1).count():
        found = found.unionByName(round_of(more))
    return found.select("key", "shard", "first", "docs")


def read(found: DataFrame, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """One row for each document at the looked-up places: key, start, n_tokens, ids_crc32 (of the ids as 4-byte words), and ``ids`` if wanted.

    Places are dealt by shard, sorted, and read with seeks; documents of a
    place are read one by one, so a hot key needs no memory.
    """
    folder = files.folder
    shared = found.sparkSession.sparkContext.broadcast(files.starts)
    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        names = ["key", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
        for batch in batches:
            rows: list[tuple] = []
            for key, shard, first, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if reader is not None:
                        reader.close()
                    now, reader = shard, ShardReader(folder, shard)
                for at in range(first, first + docs, 1024):
                    ends = reader.ends(at, min(1024, first + docs - at)).tolist()
                    for begin, end in zip(ends[:-1], ends[1:], strict=True):
                        ids = reader.ids(begin, end)
                        rows.append((key, shared.value[shard] + begin, end - begin, zlib.crc32(ids.tobytes()), *([ids.astype(np.int64)] if with_ids else [])))
                    if len(rows) >= 8192:
                        yield _packed(rows, names)
                        rows = []
            if rows:
                yield _packed(rows, names)
        if reader is not None:
            reader.close()

    return found.repartition("shard").sortWithinPartitions("shard", "first").select("key", "shard", "first", "docs").mapInArrow(run, schema)


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
