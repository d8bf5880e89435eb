"""Benchmark decontamination: test items found inside documents.

A document is contaminated by an item when at least a given share of the item's
distinct k-word shingles occurs in the document (containment; words are runs of
bytes other than ASCII white space, A-Z lower-cased).

Items are short and documents long, so similarity of whole sets says nothing;
what counts is the share of the *item*.  Items are partitioned by size.  Each
partition has its own MinHash length: an item keeps its ``b`` smallest shingle
hashes, with ``b`` one more than the largest number of shingles an item of the
partition can lack and still reach the threshold.  So a document that reaches
the threshold has at least one of the kept hashes, and no item is missed.
Documents are looked through for kept hashes in one pass without a shuffle, and
each candidate is verified by exact containment.

Items are sent to the executors in blocks of bounded bytes; every block meets
every document.  An item of fewer than k words is its whole word sequence, and
is looked for among the documents' shingles of that many words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.textops import U, Words, chunks, distinct, mix, row_of, shingles

BLOCK_BYTES = 16 << 20
_FILTER_BITS = 20


@dataclass
class Items:
    """The sets of a block of items that have shingles of one number of words."""

    words: int
    ids: np.ndarray
    tokens: np.ndarray  # distinct hashes, item after item
    bounds: np.ndarray
    kept: np.ndarray  # sorted hashes of all sketches
    kept_item: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def build(cls, words: int, ids: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, percent: int) -> Items:
        kept, owner = [], []
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own = tokens[a:b]
            top = (1 << int(b - a).bit_length()) - 1  # the largest size in the item's partition
            lack = top - -(-percent * top // 100)
            chosen = own[np.argsort(mix(own, 9))][: lack + 1]
            kept.append(chosen)
            owner.append(np.full(len(chosen), i))
        kept, owner = np.concatenate(kept), np.concatenate(owner)
        order = np.argsort(kept, kind="stable")
        bitmap = np.zeros(1 << _FILTER_BITS, dtype=bool)
        bitmap[(kept >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(words, ids, tokens, bounds, kept[order], owner[order], bitmap)

    def candidates(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (row, item) pairs that share a kept hash."""
        maybe = np.flatnonzero(self.bitmap[(h >> U(64 - _FILTER_BITS)).astype(np.int64)])
        first = np.searchsorted(self.kept, h[maybe], side="left")
        count = np.searchsorted(self.kept, h[maybe], side="right") - first
        maybe, first, count = maybe[count > 0], first[count > 0], count[count > 0]
        if not len(maybe):
            return np.zeros((0, 2), dtype=np.int64)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.stack([np.repeat(row[maybe], count), self.kept_item[np.repeat(first, count) + step]], axis=1)
        return np.unique(pairs, axis=0)


def _blocks(benchmark: DataFrame, id_col: str | None, text_col: str, k: int, percent: int, block_bytes: int) -> Iterator[list[Items]]:
    """Items in blocks of about ``block_bytes`` of text; without an id column ids do not matter and all are 0."""
    named = F.col(id_col).cast("long") if id_col else F.lit(0).cast("long")
    items = benchmark.select(named.alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes)
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        got = part.collect()  # about block_bytes of text
        ids = np.array([r["id"] for r in got], dtype=np.int64)
        ids_of: dict[int, list] = {}
        for a, b, data, offsets in chunks(pa.array([r["text"] for r in got], pa.string())):
            words = Words(data, offsets)
            n = np.diff(words.bounds)
            h, bounds = distinct(*shingles(words, k))
            for j in range(b - a):
                if n[j]:
                    ids_of.setdefault(min(int(n[j]), k), []).append((ids[a + j], h[bounds[j] : bounds[j + 1]]))
        out = []
        for words, own in sorted(ids_of.items()):
            bounds = np.concatenate(([0], np.cumsum([len(h) for _, h in own])))
            out.append(Items.build(words, np.array([x for x, _ in own]), np.concatenate([h for _, h in own]), bounds, percent))
        if out:
            yield out


def _search(groups: list[Items], texts: pa.Array, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, item id, shared, shingles of the item) of each contamination."""
    for a, _, data, offsets in chunks(texts):
        words = Words(data, offsets)
        for items in groups:
            h, bounds = shingles(words, items.words)
            # shorter rows give one shingle that is no run of so many words
            full = np.diff(words.bounds) >= items.words
            row = row_of(bounds)
            ok = full[row]
            pairs = items.candidates(h[ok], row[ok])
            last, own = -1, h[:0]
            for r, i in pairs.tolist():
                if r != last:
                    own, last = np.unique(h[bounds[r] : bounds[r + 1]]), r
                want = items.tokens[items.bounds[i] : items.bounds[i + 1]]
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                shared = int((own[at] == want).sum())
                if 100 * shared >= percent * len(want):
                    yield a + r, int(items.ids[i]), shared, len(want)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document row and item with containment of at least ``percent``.

    Returns ``doc_id, item_id, shared, item_shingles, containment``.  Documents
    with null or empty text, and items with null id, null text or no words,
    give nothing; a null document id is returned as null.  Repeated rows of
    either table give repeated results; equal items each count.  Empty tables
    give an empty result.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    out = None
    for groups in _blocks(benchmark, item_id, item_text, k, percent, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], groups: list[Items] = groups) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(_search(groups, batch.column(1), percent))
                if hits:
                    r, i, s, n = (np.array(x, dtype=np.int64) for x in zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(i), pa.array(s), pa.array(n), pa.array(s / n)], names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", k: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns.

    Decided row by row without a shuffle; rows with null text stay.  Items need no
    id here.
    """
    out = docs
    for groups in _blocks(benchmark, None, item_text, k, percent, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], groups: list[Items] = groups) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for r, *_ in _search(groups, batch.column(batch.schema.names.index(text_col)), percent):
                    keep[r] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out
