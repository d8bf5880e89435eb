"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

Texts are cut into pre-tokens: runs of letters (bytes above 127 included), of
digits, of other marks, each with the one space before it, and single white
space bytes that stand before no run.  Counting a pre-token means finding its
best segmentation into vocabulary pieces, and the best score of a prefix does
not depend on what follows.  So the distinct pre-tokens of a batch are put into
a trie, sorted and compared with their neighbours, and forward scores are
computed once for each node, level by level with array operations; terminal
nodes hold the number of pieces, which the texts then add up.

The vocabulary is a public list of byte strings by rank, read from a path; the
score of a piece is the logarithm of a Zipf law over its rank.  Every single
byte is a piece, so nothing is unknown.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heliograph.llm.columns import add_columns
from heliograph.llm.textops import _BASE, _BASE_INV, CHUNK_BYTES, U, chunks, mix, powers

#: Longer pre-tokens share their prefixes in a walk over the sorted ones instead of a table, with the same scores.
TRIE_BYTES = 48
TRIE_ROWS = 60_000

_KIND = np.full(256, 3, dtype=np.uint8)  # other marks
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pre-tokens of a chunk, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = _KIND[data]
    head = np.zeros(n, dtype=bool)
    head[offsets[:-1][offsets[:-1] < n]] = True
    start = head | (kind == 0)
    start[1:] |= kind[1:] != kind[:-1]
    # a run joins the space right before it
    join = np.zeros(n, dtype=bool)
    join[1:] = start[1:] & (kind[1:] != 0) & (data[:-1] == 0x20) & ~head[1:]
    begin = np.flatnonzero(start & ~join)
    return begin, np.append(begin[1:], n)


@dataclass
class Vocabulary:
    pieces: dict[bytes, float]
    hashes: np.ndarray  # sorted
    scores: np.ndarray
    longest: int
    bitmap: np.ndarray

    @classmethod
    def build(cls, ranks: dict[bytes, int]) -> Vocabulary:
        """Scores are log((1/(rank+1)) / sum of all); bytes that are missing rank last."""
        ranks = dict(ranks)
        for b in range(256):
            ranks.setdefault(bytes([b]), len(ranks))
        total = math.log(sum(1 / (r + 1) for r in ranks.values()))
        pieces = {p: -math.log(r + 1) - total for p, r in ranks.items()}
        h = np.array([_piece_hash(p) for p in pieces], dtype=U)
        order = np.argsort(h)
        if (np.diff(h[order]) == 0).any():
            raise ValueError("piece hashes collide")
        bitmap = np.zeros(1 << 20, dtype=bool)
        bitmap[(h >> U(44)).astype(np.int64)] = True
        return cls(pieces, h[order], np.fromiter(pieces.values(), dtype=float)[order], max(map(len, pieces)), bitmap)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls.build({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The score of each hash; minus infinity for what is no piece."""
        out = np.full(len(h), -np.inf)
        maybe = np.flatnonzero(self.bitmap[(h >> U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[maybe]
        out[maybe[hit]] = self.scores[at[hit]]
        return out

    def count_one(self, token: bytes) -> int:
        """Pieces of the best segmentation; of equal scores the longer last piece wins."""
        best = [0.0] + [-math.inf] * len(token)
        count = [0] * (len(token) + 1)
        for end in range(1, len(token) + 1):
            for size in range(1, min(end, self.longest) + 1):
                s = self.pieces.get(token[end - size : end])
                if s is not None and best[end - size] + s >= best[end]:
                    best[end], count[end] = best[end - size] + s, count[end - size] + 1
        return count[-1]


def _piece_hash(piece: bytes) -> int:
    h = 0
    for i, b in enumerate(piece):
        h += (b + 1) * pow(_BASE, i, 1 << 64)
    return int(mix(np.array([(h + len(piece) * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF], dtype=U))[0])


_UP = np.cumprod(np.array([1] + [_BASE] * TRIE_BYTES, dtype=U))
_DOWN = np.cumprod(np.array([1] + [_BASE_INV] * TRIE_BYTES, dtype=U))


def count_trie(letters: np.ndarray, length: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Pieces of each row (bytes padded with 0 to a matrix), and the number of trie nodes."""
    rows, width = letters.shape
    order = np.lexsort(letters.T[::-1])
    letters, length = letters[order], length[order]
    differ = letters[1:] != letters[:-1]
    shared = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), width)))
    total = np.zeros((rows, width + 1), dtype=U)
    np.cumsum((letters.astype(U) + U(1)) * _UP[:width], axis=1, out=total[:, 1:])
    # node of each row at each depth; a node is new where a row leaves its neighbour's path
    node = np.zeros((width + 1, rows), dtype=np.int32)
    best, count = [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
    terminal = np.zeros(rows, dtype=np.int64)
    nodes = 0
    for depth in range(1, width + 1):
        active = np.flatnonzero(length >= depth)
        if not len(active):
            break
        # a row between two active ones that is shorter cannot break a shared path deeper than itself
        fresh = np.ones(len(active), dtype=bool)
        if len(active) > 1:
            least = np.minimum.reduceat(shared, np.append(active[:-1] + 1, rows - 1))[:-1] if len(active) < rows else shared[1:]
            fresh[1:] = least < depth
        node[depth, active] = np.cumsum(fresh) - 1
        owner = active[fresh]
        nodes += len(owner)
        now, pieces = np.full(len(owner), -np.inf), np.zeros(len(owner), dtype=np.int64)
        for size in range(1, min(depth, vocabulary.longest) + 1):
            h = mix((total[owner, depth] - total[owner, depth - size]) * _DOWN[depth - size] + U(size * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
            score = vocabulary.lookup(h)
            up = node[depth - size, owner]
            score = best[depth - size][up] + score
            better = (score >= now) & (score > -np.inf)
            now = np.where(better, score, now)
            pieces = np.where(better, count[depth - size][up] + 1, pieces)
        best.append(now)
        count.append(pieces)
        ends = np.flatnonzero(length == depth)
        terminal[ends] = pieces[node[depth, ends]]
    out = np.empty(rows, dtype=np.int64)
    out[order] = terminal
    return out, nodes


def _pieces_of(token: bytes, vocabulary: Vocabulary, after: int) -> tuple[list[int], list[int], list[float]]:
    """(end, size, score) of every occurrence of a piece that ends beyond ``after``, by end, then size."""
    first = max(0, after + 1 - vocabulary.longest)
    data = np.frombuffer(token, dtype=np.uint8)[first:]
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], out=total[1:])
    ends, sizes, scores = [], [], []
    for size in range(1, min(n, vocabulary.longest) + 1):
        score = vocabulary.lookup(mix((total[size:] - total[:-size]) * down[: n - size + 1] + U(size * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)))
        hit = np.flatnonzero(score > -np.inf)
        hit = hit[hit + size + first > after]
        ends.append(hit + size + first)
        sizes.append(np.full(len(hit), size))
        scores.append(score[hit])
    end, size, score = np.concatenate(ends), np.concatenate(sizes), np.concatenate(scores)
    order = np.lexsort((size, end))
    return end[order].tolist(), size[order].tolist(), score[order].tolist()


def count_long(tokens: list[bytes], vocabulary: Vocabulary) -> tuple[list[int], int]:
    """Pieces of each of the sorted, distinct tokens, and the number of trie nodes that were scored.

    The path of the last token stays on a stack; the next one is scored only
    from where it leaves that path.
    """
    best, count = [0.0], [0]
    out, nodes, last = [], 0, b""
    for token in tokens:
        same = _common(last, token)
        del best[same + 1 :], count[same + 1 :]
        best += [-math.inf] * (len(token) - same)
        count += [0] * (len(token) - same)
        for end, size, score in zip(*_pieces_of(token, vocabulary, same), strict=True):
            total = best[end - size] + score
            if total >= best[end]:
                best[end], count[end] = total, count[end - size] + 1
        nodes += len(token) - same
        out.append(count[-1])
        last = token
    return out, nodes


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, dtype=np.uint8, count=n) != np.frombuffer(b, dtype=np.uint8, count=n)) if n else ()
    return int(differ[0]) if len(differ) else n


class Counter:
    """Counts of the texts of a task, with the pre-tokens of a chunk in common tries."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) of each text."""
        tokens, pres = np.zeros(len(column), dtype=np.int64), np.zeros(len(column), dtype=np.int64)
        for a, b, data, offsets in chunks(column, 16 * CHUNK_BYTES):
            start, end = pretokens(data, offsets)
            bounds = np.searchsorted(start, offsets)
            if len(start):
                counted = np.concatenate(([0], np.cumsum(self._counts(data, start, end))))
                tokens[a:b] = counted[bounds[1:]] - counted[bounds[:-1]]
            pres[a:b] = np.diff(bounds)
        return tokens, pres

    def _counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        short = length <= TRIE_BYTES
        out = np.zeros(len(start), dtype=np.int64)
        long = {i: data[start[i] : end[i]].tobytes() for i in np.flatnonzero(~short).tolist()}
        if long:
            kinds = sorted(set(long.values()))
            counted = dict(zip(kinds, count_long(kinds, self.vocabulary)[0], strict=True))
            for i, token in long.items():
                out[i] = counted[token]
        which = np.flatnonzero(short)
        # the distinct ones, by length: equal bytes in a fixed width are equal pre-tokens
        for low, high in ((1, 8), (9, 16), (17, TRIE_BYTES)):
            own = which[(length[which] >= low) & (length[which] <= high)]
            if not len(own):
                continue
            places = start[own][:, None] + np.arange(high)
            letters = np.where(np.arange(high) < length[own][:, None], data[np.minimum(places, len(data) - 1)], 0).astype(np.uint8)
            # the length is part of the key, as 0 may be a byte of a text
            key = np.concatenate([letters, length[own].astype(np.uint8)[:, None]], axis=1)
            packed = np.ascontiguousarray(key).view(f"V{high + 1}").ravel()
            if high == 8:
                number = letters.view("<u8").ravel() * U(0x9E3779B97F4A7C15) + length[own].astype(U)
                _, first, back = np.unique(number, return_index=True, return_inverse=True)
                if not (packed[first][back] == packed).all():
                    _, first, back = np.unique(packed, return_index=True, return_inverse=True)
            else:
                _, first, back = np.unique(packed, return_index=True, return_inverse=True)
            kinds = np.zeros(len(first), dtype=np.int64)
            rows, sizes = letters[first], length[own][first]
            for i in range(0, len(first), TRIE_ROWS):
                kinds[i : i + TRIE_ROWS] = count_trie(rows[i : i + TRIE_ROWS], sizes[i : i + TRIE_ROWS], self.vocabulary)[0]
            out[own] = kinds[back]
        return out


def count_tokens(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "n_tokens", pre_out: str = "n_pretokens") -> DataFrame:
    """``df`` with the numbers of tokens and of pre-tokens of each text.

    Null and empty texts have none.  Other columns pass through, columns with
    the output's names are replaced, repeated rows stay.
    """
    counter = Counter(vocabulary)

    def make(column: pa.Array) -> list[pa.Array]:
        tokens, pres = counter(column)
        return [pa.array(tokens), pa.array(pres)]

    return add_columns(df, text_col, {out: "bigint", pre_out: "bigint"}, make)


def segment(text: str, vocabulary: Vocabulary) -> Iterator[bytes]:
    """The pre-tokens of one text, for tests and inspection."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    start, end = pretokens(data, np.array([0, len(data)]))
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        yield data[a:b].tobytes()
