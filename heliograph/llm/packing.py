"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds ``capacity`` tokens, and no two documents of one source nor of one
duplicate cluster.  Documents longer than a bin are cut: whole bins are split
off first, each piece of ``capacity`` tokens a bin of its own, and the rest is
packed like a short document.

Packing is best-fit decreasing.  Open bins are ordered by residual; each
carries a bitmap of the sources and one of the duplicate clusters in it.  The
search for a document starts at its length and goes through successive
residuals until it meets the first bin whose bitmaps do not conflict, which is
the tightest compatible one.  For every residual it is known how many bins hold
each source, so runs of bins that all conflict with a hot source are passed in
one step.

Rows are dealt to shards by a hash of their id; each shard is packed on its
own, so memory is bounded by the rows of a shard (``shard_rows``), and a hot
source or cluster is spread over all shards.  Only ids, lengths and labels are
shuffled, never texts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
SHARD_ROWS = 20_000


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.sources: list[int] = []  # bitmaps
        self.clusters: list[int] = []
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # bins by residual, in order of arrival
        self.filled = 0  # bitmap of the residuals that have bins
        self.holding: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))  # source -> residual -> bins that hold it
        self.steps = 0

    def _leave(self, b: int) -> None:
        r = self.residual[b]
        del self.at[r][b]
        if not self.at[r]:
            self.filled &= ~(1 << r)
        rest = self.sources[b]
        while rest:
            low = rest & -rest
            self.holding[low.bit_length() - 1][r] -= 1
            rest ^= low

    def _enter(self, b: int) -> None:
        r = self.residual[b]
        if r == 0:
            return  # full bins are never looked at again
        self.at[r][b] = None
        self.filled |= 1 << r
        rest = self.sources[b]
        while rest:
            low = rest & -rest
            self.holding[low.bit_length() - 1][r] += 1
            rest ^= low

    def find(self, size: int, source: int, cluster: int) -> int:
        """The compatible bin with the smallest residual of at least ``size``; -1 if there is none."""
        ahead = self.filled >> size
        at = size
        held = self.holding[source] if source >= 0 else {}
        while ahead:
            skip = (ahead & -ahead).bit_length() - 1
            ahead >>= skip
            at += skip
            if held.get(at, 0) < len(self.at[at]):
                for b in self.at[at]:
                    self.steps += 1
                    if (source < 0 or not self.sources[b] >> source & 1) and (cluster < 0 or not self.clusters[b] >> cluster & 1):
                        return b
            ahead >>= 1
            at += 1
        return -1

    def put(self, size: int, source: int, cluster: int) -> int:
        b = self.find(size, source, cluster)
        if b < 0:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        elif self.residual[b]:
            self._leave(b)
        self.residual[b] -= size
        if source >= 0:
            self.sources[b] |= 1 << source
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
        self._enter(b)
        return b


def pack_shard(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, order: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(row, piece, tokens, bin) of every piece; rows are taken by decreasing rest, then by ``order``.

    ``sources`` and ``clusters`` are small codes, -1 where there is none (such a
    row conflicts with nothing).  A row without tokens is a piece of 0 tokens,
    put with the others of its kind.
    """
    out = []
    bins = Bins(capacity)
    rest = sizes % capacity
    whole = 0
    pieces = np.zeros(len(sizes), dtype=np.int64)
    full: list[tuple[int, int, int]] = []
    for i in np.flatnonzero(sizes >= capacity).tolist():
        for p in range(int(sizes[i]) // capacity):
            full.append((i, p, whole))
            whole += 1
        pieces[i] = int(sizes[i]) // capacity
    # a cluster's bitmap position is given when it is first met twice; single ones need none
    counts = np.bincount(clusters[clusters >= 0]) if (clusters >= 0).any() else np.zeros(0, dtype=np.int64)
    code = np.full(len(counts) + 1, -1, dtype=np.int64)
    many = np.flatnonzero(counts > 1)
    code[many] = np.arange(len(many))
    for i in np.lexsort((order, -rest)).tolist():
        if rest[i] == 0 and sizes[i] > 0:
            continue
        cluster = int(code[clusters[i]]) if clusters[i] >= 0 else -1
        b = bins.put(int(rest[i]), int(sources[i]), cluster)
        out.append((i, int(pieces[i]), int(rest[i]), whole + b))
    out += [(i, p, capacity, b) for i, p, b in full]
    return out


_OUT = pa.schema([("shard", pa.int32()), ("bin", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("token_start", pa.int64()), ("tokens", pa.int64()), ("source", pa.string())])


def _pack(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("cluster", "ascending")])
        n = table.column("n").to_numpy()
        codes = []
        for name in ("source", "cluster"):
            encoded = table.column(name).combine_chunks().dictionary_encode().indices.fill_null(-1)
            codes.append(encoded.to_numpy().astype(np.int64))
        packed = pack_shard(n, codes[0], codes[1], np.arange(len(n)), capacity)
        row, piece, tokens, b = (np.array(x, dtype=np.int64) for x in zip(*packed, strict=True))
        take = pa.array(row)
        return pa.table(
            [pa.array(np.full(len(row), key[0].as_py(), dtype=np.int32)), pa.array(b), table.column("doc_id").take(take), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(tokens), table.column("source").take(take)],
            schema=_OUT,
        )

    return run


def word_count(text: F.Column) -> F.Column:
    """Words of a text as its length in tokens; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_cluster(text: F.Column) -> F.Column:
    """A key that texts share when they differ in the case of A-Z and white space only; null for null."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.isNotNull(), F.xxhash64(F.trim(F.regexp_replace(low, r"[\x20\x09-\x0D]+", " "))))


def best_fit_pack(docs: DataFrame, length: F.Column, cluster: F.Column, id_col: str = "doc_id", source_col: str = "source", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``shard, bin, doc_id, piece, token_start, tokens, source`` of every piece of every row.

    ``length`` and ``cluster`` are expressions over ``docs``.  A bin is named by
    (shard, bin).  Null length counts 0 tokens; a null source or cluster
    conflicts with nothing; a null id is packed like others and returned as
    null.  Repeated rows are packed each (and conflict, as they share a
    cluster).  Ties of length are taken by id.  An empty table gives an empty
    result; columns of other names are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"), cluster.cast("long").alias("cluster"))
    shards = max(1, -(-docs.count() // shard_rows))
    # the row's other values spread the rows of one id (or of none)
    shard = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.struct("n", "cluster", "source"))), F.lit(shards)).cast("int")
    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(_pack(capacity), "shard int, bin long, doc_id long, piece int, token_start long, tokens long, source string")
