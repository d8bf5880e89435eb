"""N-gram Jaccard join by a token-group matrix.

Documents become sets of distinct k-word shingles; two documents link when the
Jaccard similarity of their sets reaches a threshold.  The result names, for
every document, the connected component of links that it is in.  It is exact.

How it runs
-----------
1. *Sets.*  One scan hashes every text to its shingle set and names the set by
   a 64-bit key, so equal sets are one node however many documents have them.
   A second, independent key is kept to prove that no two sets share a name;
   if two ever did, the work starts again with another seed.
2. *Order.*  The same kind of scan adds up a count sketch of shingles of fixed
   size.  It only orders shingles from rare to frequent; any order is exact, a
   good one keeps widely shared passages out of the prefixes below.  Where the
   sketch is too small to tell rare from frequent, a fixed share of all hash
   values, wider than the prefixes, is counted, and those found in few sets
   come first; those found in one set only need not meet any other.  From here
   on a set is read from one of its rows.
3. *Partition.*  A linking pair must share a shingle inside short prefixes of
   their ordered sets.  Short runs of a shared prefix shingle give pairs, which
   stay only if the counts of their shingles by range of hash values admit the
   overlap (an upper bound, so nothing is lost).  Long runs give chains of
   edges, linear in the run.  The components of both partition the documents:
   every link lies inside one part.
4. *Groups.*  Parts are cut into tiles of bounded size.  In a tile, documents
   ordered by a minimum hash form small groups; the token-group matrix stores
   the union of each group's shingles.  A query's row sum bounds its overlap
   with any member, and only groups whose bound reaches the threshold are
   opened and verified by exact intersection.
5. Links found in the tiles join documents to components.

Only the sketch and hashed bitmaps, all of fixed size, reach the driver.  A
part made of very many *distinct* near copies costs a number of tiles that is
quadratic in the part's bytes over the tile size; exact copies cost nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.lineage import keep
from heliograph.llm.textops import U, Words, chunks, distinct, mix, row_of, row_sums, shingles
from heliograph.operators.components import connected_components

SKETCH_BITS = 20
SKETCH_PARTS = 64
#: Longer runs of a prefix shingle are chained instead of paired.
SHORT_RUN = 32
BITMAP_BITS = 28
#: Shingles of more sets than RARE_SETS count as frequent; a part or a blob has COUNTED_TOKENS of them at most, about.
RARE_SETS, COUNTED_TOKENS = 4, 2_000_000
#: Shingles of a block of a part: parts are cut into FEW_BLOCKS blocks at most while these stay below MOST_TILE_TOKENS.
TILE_TOKENS, FEW_BLOCKS, MOST_TILE_TOKENS = 64_000, 8, 1_000_000
#: Sets with more copies than HOT_COPIES, and than a HOT_SETS-th of all rows, are joined apart.
HOT_COPIES = 200
HOT_SETS = 1000
GROUP_ROWS = 32


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(column: pa.Array, k: int, seed: int) -> Iterator[tuple]:
    """(first, end, shingles, bounds, sizes, key, second key, words) of chunks of rows."""
    for a, b, data, offsets in chunks(column):
        words = Words(data, offsets)
        h, bounds = distinct(*shingles(words, k))
        n = np.diff(bounds)
        key = mix(row_sums(mix(h, 2 * seed + 31), bounds) + n.astype(U), seed)
        yield a, b, h, bounds, n, key, mix(row_sums(mix(h, 2 * seed + 32), bounds), seed + 1), np.diff(words.bounds)


_MEMBERS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("words", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("profile", pa.binary()), ("part", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])
_MEMBERS_DDL = "doc_id long, n int, words long, key long, key2 long, profile binary, part int, task int, counts binary"


def _packed(cells: np.ndarray) -> bytes:
    return zlib.compress(cells.astype("<u8").tobytes(), 1)


def _members(k: int, seed: int):
    def rows_of(columns: dict[str, pa.Array], m: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(m, f.type)) for f in _MEMBERS], schema=_MEMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        waiting: list[np.ndarray] = []
        for batch in batches:
            for a, b, h, bounds, n, key, key2, words in _sets(batch.column(1), k, seed):
                waiting.append((h >> U(64 - SKETCH_BITS)).astype(np.int32))
                if sum(map(len, waiting)) > len(cells):
                    cells += np.bincount(np.concatenate(waiting), minlength=len(cells))
                    waiting.clear()
                profiles = [profile(h[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield rows_of(
                    {"doc_id": batch.column(0).slice(a, b - a), "n": pa.array(n.astype(np.int32)), "words": pa.array(words.astype(np.int64)), "key": pa.array(_signed(key)), "key2": pa.array(_signed(key2)), "profile": pa.array(profiles, pa.binary())},
                    b - a,
                )
        if waiting:
            cells += np.bincount(np.concatenate(waiting), minlength=len(cells))
        if cells.any():
            size = len(cells) // SKETCH_PARTS
            counts = [_packed(cells[p * size : (p + 1) * size]) for p in range(SKETCH_PARTS)]
            task = np.full(SKETCH_PARTS, TaskContext.get().partitionId(), dtype=np.int32)
            yield rows_of({"part": pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), "task": pa.array(task), "counts": pa.array(counts, pa.binary())}, SKETCH_PARTS)

    return run


def _add_up(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, dtype=np.uint64)
    for value in table.column("counts"):
        total += np.frombuffer(zlib.decompress(value.as_py()), dtype="<u8")
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_packed(total)], pa.binary())})


def _sketch(pieces: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts: first of groups of tasks, then of the groups, so no task reads more than a few hundred pieces."""
    tasks = pieces.agg(F.max("task")).first()[0] or 0
    fan = max(1, math.isqrt(tasks))
    some = pieces.groupBy("part", F.pmod("task", F.lit(fan)).alias("fan")).applyInArrow(_add_up, "part int, counts binary")
    size = (1 << SKETCH_BITS) // SKETCH_PARTS
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for r in some.groupBy("part").applyInArrow(_add_up, "part int, counts binary").collect():
        sketch[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), dtype="<u8").astype(np.int64)
    return sketch


def _marked(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _fresh_sets(batches: Iterator[pa.RecordBatch], k: int, seed: int, bitmap: np.ndarray) -> Iterator[tuple]:
    """(shingles, row of each, bounds, sizes, keys) of the rows (bit, text) whose bit is set, each set once a task; only their texts are looked at."""
    seen: set[int] = set()
    for batch in batches:
        maybe = np.flatnonzero(_marked(bitmap, batch.column(0).to_numpy()))
        for _, _, h, bounds, n, key, _, _ in _sets(batch.column(1).take(pa.array(maybe)), k, seed):
            fresh = np.zeros(len(n), dtype=bool)
            for i, x in enumerate(key.tolist()):
                if n[i] and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            row = row_of(bounds)
            keep_ = fresh[row]
            if keep_.any():
                yield h[keep_], row[keep_], bounds, n, key


def _counted(h: np.ndarray, percent: int) -> np.ndarray:
    """The share of all hash values that is counted: two and a half times what a prefix takes."""
    return (h & U(255)) < U(min(256, 640 * (100 - percent) // 100 + 1))


def _rest(h: np.ndarray) -> np.ndarray:
    """32 bits of a hash, none of which decides whether or where it is counted."""
    return (h >> U(8)) & U(0xFFFFFFFF)


def _tokens(k: int, seed: int, percent: int, chosen: np.ndarray, parts: int):
    """Counted shingles of a task by the part that counts them, a blob of sorted 32-bit rests each; more than RARE_SETS + 1 of one are no news."""
    schema = pa.schema([("part", pa.int32()), ("tokens", pa.binary())])

    def packed(waiting: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(waiting)
        both = (((h >> U(40)) * U(parts)) >> U(24)) << U(32) | _rest(h)
        both.sort()
        few = np.ones(len(both), dtype=bool)
        few[RARE_SETS + 1 :] = both[RARE_SETS + 1 :] != both[: -RARE_SETS - 1]
        both = both[few]
        names, start = np.unique(both >> U(32), return_index=True)
        blobs = [x.astype("<u4").tobytes() for x in np.split(both & U(0xFFFFFFFF), start[1:])]
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for h, *_ in _fresh_sets(batches, k, seed, chosen):
            waiting.append(h[_counted(h, percent)])
            size += len(waiting[-1])
            if size > COUNTED_TOKENS:
                yield packed(waiting)
                waiting, size = [], 0
        if size:
            yield packed(waiting)

    return run


def _repeated(key: tuple, table: pa.Table) -> pa.Table:
    """The shingles of a part that more than one set holds, and whether more than RARE_SETS do."""
    tokens = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u4") for x in table.column("tokens")])
    names, sets = np.unique(tokens, return_counts=True)
    more = sets > 1
    return pa.table({"token": pa.array(names[more].astype(np.int64)), "often": pa.array(sets[more] > RARE_SETS)})


def _frequent(texts: DataFrame, k: int, seed: int, percent: int, sketch: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bitmaps of the counted shingles that several sets hold and of those that more than RARE_SETS hold; null where the sketch tells as much."""
    if int(sketch.sum()) <= RARE_SETS * len(sketch):
        return None
    parts = -(-int(sketch.sum()) // COUNTED_TOKENS)
    # a row is a task's shingles of a part: the counts of hundreds of millions are sorts of plain arrays, not rows
    tokens = texts.mapInArrow(_tokens(k, seed, percent, chosen, parts), "part int, tokens binary").repartition(parts, "part")
    shared = keep(tokens.groupBy("part").applyInArrow(_repeated, "token long, often boolean"), "ngram-shared")

    def marked(rows: DataFrame, spare: int) -> np.ndarray:
        n_bits = min(max(rows.count().bit_length() + spare, 16), BITMAP_BITS)
        return _bitmap(rows.select(F.shiftrightunsigned("token", 32 - n_bits).alias("bit")), n_bits)

    return marked(shared, 3), marked(shared.where("often"), 5)


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _marked(bitmap, (_rest(h) >> U(33 - (len(bitmap) * 8).bit_length())).astype(np.int64))


def _in_order(row: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Positions by row, cost and place; rows come in order."""
    n = len(row)
    place_bits, cost_bits = n.bit_length(), int(cost.max()).bit_length()
    if int(row[-1]).bit_length() + cost_bits + place_bits > 64:
        return np.lexsort((np.arange(n), cost, row))
    # one sort of plain numbers
    both = row.astype(U) << U(cost_bits + place_bits) | cost.astype(U) << U(place_bits) | np.arange(n, dtype=U)
    both.sort()
    return (both & U((1 << place_bits) - 1)).astype(np.int64)


def _prefixes(k: int, seed: int, percent: int, sketch: np.ndarray, chosen: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None):
    """The prefixes' shingles, apart from those that are known to be in one set only: they have their places, but meet no other."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("index", pa.bool_())])

    def cost(h: np.ndarray) -> np.ndarray:
        """Rare ones first, then those that were not counted, then frequent ones; by the sketch in each."""
        out = sketch[(h >> U(64 - SKETCH_BITS)).astype(np.int64)]
        if known is None:
            return out
        return out + np.where(_counted(h, percent), np.where(_has(known[1], h), 2, 0), 1).astype(np.int32) * np.int32(1 << SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, row, _, n, key in _fresh_sets(batches, k, seed, chosen):
            # the shingles of a row come in order of their hashes
            h = h[_in_order(row, cost(h))]
            first = np.searchsorted(row, np.arange(len(n)))
            place = np.arange(len(h)) - first[row]
            size = n[row]
            probe = size + (-percent * size // 100) + 1
            use = np.flatnonzero(place < probe)
            if known is not None:
                met = h[use]
                use = use[~_counted(met, percent) | _has(known[0], met)]
            size, place, row_ = size[use], place[use], row[use]
            index = size + (-2 * percent * size // (100 + percent)) + 1
            yield pa.RecordBatch.from_arrays([pa.array(_signed(h[use])), pa.array(size.astype(np.int32)), pa.array(_signed(key[row_])), pa.array(place < index)], schema=schema)

    return run


def profile(h: np.ndarray) -> bytes:
    """Counts of sorted hashes in equal ranges of values, about eight a range; 255 stands for any more."""
    bits = max(4, (len(h) // 8).bit_length())
    return np.minimum(np.bincount((h >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes, most: int) -> int:
    """No two sets with these profiles share more shingles."""
    x, y = (np.frombuffer(p, dtype=np.uint8).astype(np.int64) for p in (a, b))
    if x.max(initial=0) == 255 or y.max(initial=0) == 255:
        return most
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(axis=1), y.reshape(size, -1).sum(axis=1)).sum())


def _runs(percent: int):
    """Pairs of short runs and chains of long ones; rows come sorted by (token, n, key).

    A row may link with an index row of at most its size and at least the
    threshold's share of it.  In a long run all such index rows chain with one
    another, so the largest of them stands for all.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("chained", pa.bool_())])

    def emit(parts: list[np.ndarray], chained: bool) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate(parts, axis=1)
        pairs = pairs[:, np.lexsort(pairs)]
        fresh = np.ones(pairs.shape[1], dtype=bool)
        fresh[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
        pairs = pairs[:, fresh]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.full(pairs.shape[1], chained))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bool, list[np.ndarray]] = {False: [], True: []}
        held: list[tuple] = []  # the open run, while it is short
        long_token, last = None, (0, 0)  # an open long run, and its last index row

        def pairs_of(n: np.ndarray, key: np.ndarray, index: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
            # the i-th row of each run with the row d places before it
            for d in range(1, int(length.max(initial=1))):
                at = np.concatenate([np.arange(s + d, s + m) for s, m in zip(start[length > d].tolist(), length[length > d].tolist(), strict=True)])
                use = index[at - d] & (100 * n[at - d].astype(np.int64) >= percent * n[at].astype(np.int64)) & (key[at] != key[at - d])
                # of equal sizes either may be the smaller one
                use |= index[at] & (n[at] == n[at - d]) & (key[at] != key[at - d])
                at = at[use]
                if len(at):
                    found[False].append(np.stack([np.maximum(key[at], key[at - d]), np.minimum(key[at], key[at - d])]))

        def chain(n: np.ndarray, key: np.ndarray, index: np.ndarray, last: tuple[int, int]) -> tuple[int, int]:
            at = np.maximum.accumulate(np.where(index, np.arange(len(n)), -1))
            before = np.concatenate(([-1], at[:-1]))
            other_key, other_n = np.where(before >= 0, key[before], last[0]), np.where(before >= 0, n[before], last[1])
            use = (other_n > 0) & (100 * other_n.astype(np.int64) >= percent * n.astype(np.int64)) & (other_key != key)
            if use.any():
                found[True].append(np.stack([np.maximum(key[use], other_key[use]), np.minimum(key[use], other_key[use])]))
            return (int(key[at[-1]]), int(n[at[-1]])) if at[-1] >= 0 else last

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
                held = []
            token, n, key, index = columns
            if not len(token):
                continue
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            length = np.diff(np.append(start, len(token)))
            if long_token is not None and token[0] == long_token:
                last = chain(n[: length[0]], key[: length[0]], index[: length[0]], last)
                start, length = start[1:], length[1:]
            if len(start):
                long_token, last = None, (0, 0)
                if length[-1] <= SHORT_RUN:
                    # the last run may go on in the next batch
                    held = [c[start[-1] :] for c in columns]
                    start, length = start[:-1], length[:-1]
                for s, m in zip(start[length > SHORT_RUN].tolist(), length[length > SHORT_RUN].tolist(), strict=True):
                    last = chain(n[s : s + m], key[s : s + m], index[s : s + m], (0, 0))
                    long_token = int(token[s]) if s + m == len(token) else None
                some = (length > 1) & (length <= SHORT_RUN)
                if some.any():
                    pairs_of(n, key, index, start[some], length[some])
            for chained, parts in found.items():
                if sum(p.shape[1] for p in parts) > 200_000:
                    yield from emit(parts, chained)
                    parts.clear()
        if held and len(held[0]) > 1:
            pairs_of(held[1], held[2], held[3], np.array([0]), np.array([len(held[0])]))
        for chained, parts in found.items():
            if parts:
                yield from emit(parts, chained)

    return run


def _admissible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            pa_, pb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            ok = [(100 + percent) * overlap_bound(x, y, min(n, m)) >= percent * (n + m) for x, y, n, m in zip(pa_, pb, na, nb, strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def _candidates(k: int, seed: int, bitmap: np.ndarray):
    """(key, shingles) of the rows (bit, text) whose bit is set."""
    schema = pa.schema([("key", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, row, _, n, key in _fresh_sets(batches, k, seed, bitmap):
            rows = np.unique(row)
            ends = np.searchsorted(row, rows, side="right").tolist()
            blobs = [h[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_signed(key[rows])), pa.array(blobs, pa.binary())], schema=schema)

    return run


def _bitmap(bits: DataFrame, n: int) -> np.ndarray:
    """A bitmap of 2**n bits of the column ``bit``, put together in pieces of 4096 bytes."""
    bitmap = np.zeros(1 << (n - 3), dtype=np.uint8)
    built = bits.groupBy(F.shiftrightunsigned("bit", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND((1 << 15) - 1)).alias("map"))
    for r in built.collect():
        bitmap[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = np.frombuffer(r["map"], dtype=np.uint8)
    return bitmap


def _id_bit(c: str, n: int):
    return F.shiftrightunsigned(F.xxhash64(c), 64 - n)


def _id_bitmap(first_ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the ids in ``first_id``, by which one row of each set is looked up, and its number of bits as a power of two.

    More bits for more sets, at most 32 MiB; beyond that more rows pass, which are copies that count as any others or that a join drops.
    """
    n_bits = min(max(first_ids.count().bit_length() + 6, 16), BITMAP_BITS)
    return _bitmap(first_ids.select(_id_bit("first_id", n_bits).alias("bit")), n_bits), n_bits


def _with_bit(rows: DataFrame, n_bits: int) -> DataFrame:
    return rows.select(_id_bit("doc_id", n_bits).alias("bit"), "text")


def _met(rows: DataFrame, first_ids: DataFrame, sketch: np.ndarray, k: int, seed: int, percent: int) -> DataFrame:
    """(a, b, chained): sets that share a shingle of their prefixes, of short runs in pairs and of long ones as chains."""
    chosen, n_bits = _id_bitmap(first_ids)
    texts = _with_bit(rows, n_bits)
    known = _frequent(texts, k, seed, percent, sketch, chosen)
    # only the order of the counts matters
    sketch = np.unique(sketch, return_inverse=True)[1].astype(np.int32)
    prefix = texts.mapInArrow(_prefixes(k, seed, percent, sketch, chosen, known), "token long, n int, key long, index boolean")
    return prefix.repartition("token").sortWithinPartitions("token", "n", "key").mapInArrow(_runs(percent), "a long, b long, chained boolean").distinct()


def tile_links(sets: list[np.ndarray], block: np.ndarray, tile: tuple[int, int], percent: int, copies: np.ndarray, group_rows: int = GROUP_ROWS) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """Links inside a tile: for each set its smallest linked position and its number of linked documents.

    In an off-diagonal tile only pairs of the two blocks count.  ``stats`` tells
    how many query-group pairs there were and how many groups were opened.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    lowest = np.array([int(mix(s, 3).min()) for s in sets], dtype=U)
    order = np.lexsort((lowest, block))
    # groups never cross the two blocks
    place = np.empty(m, dtype=np.int64)
    for b in np.unique(block):
        own = order[block[order] == b]
        place[own] = np.arange(len(own)) // group_rows + (0 if b == tile[0] else 1 << 40)
    _, group = np.unique(place, return_inverse=True)
    tokens = np.concatenate(sets)
    names, local = np.unique(tokens, return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    # the matrix row by row: for each token the groups whose union holds it
    groups = int(group.max()) + 1
    cells = np.unique(local * groups + np.repeat(group, sizes))
    held_by, row_start = cells % groups, np.searchsorted(cells, np.arange(len(names) + 1) * groups)
    members = [np.flatnonzero(group == g) for g in range(groups)]
    member_tokens = [np.concatenate([local[bounds[i] : bounds[i + 1]] for i in g]) for g in members]
    member_bounds = [np.concatenate(([0], np.cumsum(sizes[g])))[:-1] for g in members]
    least, most = np.array([sizes[g].min() for g in members]), np.array([sizes[g].max() for g in members])
    side = np.array([block[g[0]] for g in members])
    parent = np.arange(m)
    links = np.zeros(m, dtype=np.int64)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    mark = np.zeros(len(names), dtype=bool)
    stats = {"bounds": 0, "opened": 0}
    for q in range(m):
        own = local[bounds[q] : bounds[q + 1]]
        nq = int(sizes[q])
        count = row_start[own + 1] - row_start[own]
        overlap = np.bincount(held_by[np.repeat(row_start[own] - np.cumsum(count) + count, count) + np.arange(count.sum())], minlength=groups)
        floor = np.maximum(least, -(-percent * nq // 100))
        may = ((100 + percent) * overlap >= percent * (nq + floor)) & (100 * most >= percent * nq) & (percent * least <= 100 * nq)
        if tile[0] != tile[1]:
            may &= side != block[q]
        stats["bounds"] += groups
        mark[own] = True
        for g in np.flatnonzero(may).tolist():
            stats["opened"] += 1
            inside = np.add.reduceat(mark[member_tokens[g]].astype(np.int64), member_bounds[g])
            others = members[g]
            hit = others[(100 * inside >= percent * (nq + sizes[others] - inside)) & (others != q)]
            links[q] += copies[hit].sum()
            for x in hit.tolist():
                a, b = find(q), find(x)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        mark[own] = False
    return np.array([find(i) for i in range(m)]), links, stats


def _verify(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        table = table.sort_by("key")
        keys = table.column("key").to_numpy()
        sets = [np.frombuffer(x.as_py(), dtype=U) for x in table.column("shingles")]
        first, links, _ = tile_links(sets, table.column("block").to_numpy(), (i, j), percent, table.column("copies").to_numpy())
        return pa.table({"key": pa.array(keys, pa.int64()), "low": pa.array(keys[first], pa.int64()), "links": pa.array(links, pa.int64())})

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, with_words: bool = False) -> DataFrame:
    """Component and number of links of every document.

    Returns ``doc_id, n_shingles, component_id, n_links`` (and ``n_words`` if asked
    for), one row per row of
    ``docs``; other columns are neither read nor returned.  Words are runs of
    bytes other than ASCII white space, A-Z lower-cased.  A document of fewer
    than k words has its whole sequence as its one shingle; null, empty or blank
    text has none and links with nothing, so its component is its own id.  Rows
    whose id is null get their size, a null component and no links, and take no
    part in components.  Repeated rows are copies of one another and each
    returned.  An empty table gives an empty result.  ``n_links`` counts the
    other rows that a row links with, equal sets included.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must lie in 1..100")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    for seed in range(8):
        scan = keep(rows.mapInArrow(_members(k, seed), _MEMBERS_DDL), "ngram-sets")
        members = scan.where("part IS NULL").select("doc_id", "n", "words", "key", "key2", "profile")
        clash = members.where("n > 0").groupBy("key").agg(F.min("key2").alias("x"), F.max("key2").alias("y")).where("x <> y").limit(1).count()
        if not clash:
            break
    else:
        raise RuntimeError("set names collide under every seed")
    sketch = _sketch(scan.where("part IS NOT NULL").select("part", "task", "counts"))
    copies = members.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max("n").alias("n"))
    met = keep(_met(rows.where("doc_id IS NOT NULL"), copies.select("first_id"), sketch, k, seed, percent), "ngram-runs")
    profiles = members.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("profile").alias("profile"))
    left = profiles.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa"))
    right = profiles.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb"))
    pairs = met.where("NOT chained").select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb")
    edges = keep(pairs.mapInArrow(_admissible(percent), "a long, b long").unionByName(met.where("chained").select("a", "b")), "ngram-edges")
    parts = keep(connected_components(edges), "ngram-parts")
    inside = keep(parts.withColumnsRenamed({"node": "key", "component": "part"}).join(copies, "key"), "ngram-candidates")
    bitmap, n_bits = _id_bitmap(inside.select("first_id"))
    sets = _with_bit(rows.where("doc_id IS NOT NULL"), n_bits).mapInArrow(_candidates(k, seed, bitmap), "key long, shingles binary")
    inside = inside.drop("first_id")
    tokens = F.sum("n")
    blocks = inside.groupBy("part").agg(F.greatest(F.least(F.ceil(tokens / TILE_TOKENS), F.lit(FEW_BLOCKS)), F.ceil(tokens / MOST_TILE_TOKENS)).cast("int").alias("blocks"))
    placed = inside.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tiled = placed.select(
        "key", "copies", "part", "block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda t: F.struct(F.least("block", t).alias("i"), F.greatest("block", t).alias("j")))).alias("tile")
    ).select("key", "copies", "part", "block", "tile.i", "tile.j")
    whole = sets.groupBy("key").agg(F.first("shingles").alias("shingles"))
    found = keep(
        tiled.join(whole, "key").groupBy("part", "i", "j").applyInArrow(_verify(percent), "key long, low long, links long"),
        "ngram-links",
    )
    component = connected_components(found.select("key", "low")).withColumnRenamed("node", "key")
    lowest = component.join(copies.select("key", "first_id"), "key").groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = component.join(lowest, "component").join(found.groupBy("key").agg(F.sum("links").alias("links")), "key").select("key", "component_id", "links")
    own = keep(
        copies.join(linked, "key", "left").select("key", "copies", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "ngram-components",
    )
    # at most HOT_SETS sets have so many copies; their rows are not dealt by key
    hot = own.where(F.col("copies") > max(HOT_COPIES, members.count() // HOT_SETS)).drop("copies")
    out = ["doc_id", "n_shingles", "component_id", "n_links", *(["n_words"] if with_words else [])]
    none = members.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.col("words").alias("n_words")).select(*out)
    named_rows = members.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("words").alias("n_words"), "key")
    often = named_rows.join(F.broadcast(hot), "key").select(*out)
    seldom = named_rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(own.drop("copies"), "key").select(*out)
    return often.unionByName(seldom).unionByName(none)


def keep_first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that a smaller id of their component stands for.

    All columns and row repetitions of what stays are kept, but repeated rows of
    one id stay together; rows with a null id or without words always stay.
    """
    joined = ngram_jaccard_join(docs, id_col, text_col, k, percent)
    drop = joined.where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(drop, docs[id_col] == drop["doc_id"], "left_anti")
