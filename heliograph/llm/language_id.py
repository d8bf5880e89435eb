"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter holds all languages: each cell is a bit mask with one bit a language,
so the AND of an n-gram's cells is the set of languages that contain it.  A
text's votes are the popcounts of each language's bit over all its n-grams;
they are corrected for that language's rate of false positives (its share of
set cells to the power of the number of hash functions), and the largest
corrected share decides.

Texts are read as code points: letters are lower-cased one by one, and each run
of other characters is one blank, also at both ends.  n-grams of 3 and 5 are
counted.  A language contains the n-grams of at least ``min_share`` of its training
rows, however many these are; with 0 all are inserted, which held-out texts and texts
of unknown languages are told apart worse by (figures in the README).  The filter is sized by the number of distinct ones,
so that a language sets about a seventh of its cells at most (beyond 2^26 cells
more, and the correction grows), and is put together from pieces of bitmaps, a
bit a cell and language: neither texts nor n-grams reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.lineage import keep
from heliograph.llm.columns import add_columns
from heliograph.llm.quantiles import quantiles
from heliograph.llm.textops import U, chunks, distinct, mix

SIZES = (3, 5)
#: Least and most cells of the filter (powers of two), and cells for each n-gram of the language that has most.
FILTER_BITS, MOST_FILTER_BITS, CELLS_A_GRAM = 20, 26, 20
HASHES = 3
#: A language contains an n-gram that is in this share of its training rows at least; rarer ones are names, foreign words and slips.
MIN_SHARE = 0.005
UNKNOWN = "und"
#: On sf0.1 the lowest held-out text has 0.605 of what is possible; of texts in a language left out, 19 of 20 stay below 0.53.
LEAST_PART = 0.57

_tables: dict[str, np.ndarray] = {}


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        points = range(0x110000)
        _tables["letter"] = np.fromiter((chr(i).isalpha() for i in points), dtype=bool, count=0x110000)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(_tables["letter"][:0x1F000]).tolist():
            low = chr(i).lower()
            if len(low) == 1:
                lower[i] = ord(low)
        _tables["lower"] = lower
    return _tables["letter"], _tables["lower"]


def _valid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, in which what is no UTF-8 is the replacement character."""
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer(b"".join(rows), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))
    return data, offsets


def letter_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with single blanks between runs of letters, bounds, letters a row)."""
    letter, lower = _letter_tables()
    data, offsets = _valid(data, offsets)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    place = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    rows = len(offsets) - 1
    # a blank before every row and one at the very end, then runs of blanks fall into one
    spread = np.zeros(len(points) + rows + 1, dtype=np.uint32)
    at = np.arange(len(points)) + np.repeat(np.arange(rows), np.diff(place)) + 1
    spread[at] = np.where(letter[points], lower[points], 0)
    start = place[:-1] + np.arange(rows)
    use = spread != 0
    use[1:] |= spread[:-1] != 0
    use[start] = True
    count = np.concatenate(([0], np.cumsum(use)))
    bounds = count[np.append(start, len(spread) - 1)]
    letters = np.concatenate(([0], np.cumsum(spread != 0)))[np.append(start, len(spread) - 1)]
    # the blank that ends a row without one of its own is the next row's first
    return spread[use], bounds, np.diff(letters)


def grams(stream: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a row's n-grams that have a letter, and their rows."""
    n = len(stream) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    h = np.full(n, U(size), dtype=U)
    for j in range(size):
        h = h * U(0x100000001B3) + stream[j : j + n].astype(U)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    row = np.append(row, np.full(len(stream) - len(row), len(bounds) - 1))
    # the last n-gram of a row may end on the blank that the next row starts with
    end = row[size - 2 : size - 2 + n]
    last, before = stream[size - 1 :], stream[size - 2 : -1]
    keep = (row[:n] == end) & ((row[size - 1 :] == row[:n]) | ((last == 0) & (before != 0))) & (row[:n] < len(bounds) - 1)
    return mix(h[keep], size), row[:n][keep]


@dataclass
class LanguageModel:
    """The bit-sliced filter: ``cells[b // 64, i]`` has bit b % 64 set if a hash of an n-gram of language b fell on i."""

    languages: list[str]
    cells: np.ndarray
    false_rate: np.ndarray
    prior: int = 0
    hashes: int = HASHES
    sizes: tuple[int, ...] = field(default=SIZES)

    @classmethod
    def build(cls, members: dict[str, np.ndarray], prior: str, bits: int = FILTER_BITS, sizes: tuple[int, ...] = SIZES) -> LanguageModel:
        def pieces() -> Iterator[tuple[str, int, np.ndarray]]:
            for name, h in members.items():
                cells = np.zeros(1 << bits, dtype=bool)
                for i in range(HASHES):
                    cells[cls._places(h, i, bits)] = True
                yield name, 0, cells

        return cls.of_pieces(sorted(members), bits, pieces(), prior, sizes)

    @classmethod
    def of_pieces(cls, languages: list[str], bits: int, pieces: Iterable[tuple[str, int, np.ndarray]], prior: str, sizes: tuple[int, ...] = SIZES) -> LanguageModel:
        """From (language, first cell, which cells are set); the cells' type is as small as the languages allow."""
        kind = next(t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (1 << 30, np.uint64)) if len(languages) <= n)
        cells = np.zeros((-(-len(languages) // 64), 1 << bits), dtype=kind)
        number = {name: b for b, name in enumerate(languages)}
        fill = np.zeros(len(languages))
        for name, start, some in pieces:
            b = number[name]
            cells[b // 64, start : start + len(some)] |= some.astype(kind) << kind(b % 64)
            fill[b] += np.count_nonzero(some) / (1 << bits)
        return cls(languages, cells, fill**HASHES, number.get(prior, 0), HASHES, sizes)

    @staticmethod
    def _places(h: np.ndarray, i: int, bits: int) -> np.ndarray:
        return ((h * U((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF)) >> U(64 - bits)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The bit masks of the languages that contain each n-gram, a row for every 64 languages."""
        bits = self.cells.shape[1].bit_length() - 1
        mask = self.cells[:, self._places(h, 0, bits)]
        for i in range(1, self.hashes):
            mask &= self.cells[:, self._places(h, i, bits)]
        return mask

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for a, b, data, offsets in chunks(column):
            stream, bounds, letters = letter_stream(data, offsets)
            rows = b - a
            total = np.zeros(rows)
            votes = np.zeros((rows, len(self.languages)))
            for size in self.sizes:
                h, row = grams(stream, bounds, size)
                mask = self.lookup(h)
                total += np.bincount(row, minlength=rows)
                for x in range(len(self.languages)):
                    hit = (mask[x // 64] >> mask.dtype.type(x % 64)) & mask.dtype.type(1)
                    votes[:, x] += np.bincount(row, weights=hit.astype(np.float64), minlength=rows)
            share = votes / np.maximum(total, 1)[:, None]
            share = np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
            best = share.argmax(axis=1)
            best[share.max(axis=1) <= 0] = self.prior
            for i in range(rows):
                if letters[i] == 0:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    names.append(self.languages[best[i]])
                    scores.append(float(share[i, best[i]]))
        return names, scores


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _gram_counts(sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, data, offsets in chunks(batch.column(1)):
                stream, bounds, _ = letter_stream(data, offsets)
                code, lang = np.unique(np.array(langs[a:b], dtype=object).astype(str), return_inverse=True)
                for size in sizes:
                    h, row = grams(stream, bounds, size)
                    once, within = distinct(h, np.searchsorted(row, np.arange(b - a + 1)))
                    owner = np.repeat(lang, np.diff(within))
                    for i, name in enumerate(code.tolist()):
                        gram, count = np.unique(once[owner == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])

    return run


def _set_cells(bits: int):
    """(lang, cell) of each n-gram's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy().view(U)
            for i in range(HASHES):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(LanguageModel._places(h, i, bits))], names=["lang", "cell"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int | None = None, min_share: float = MIN_SHARE, sizes: tuple[int, ...] = SIZES) -> LanguageModel | None:
    """Learn from rows whose crc32(id) mod 5 is not 0 and whose text and language are not null.

    All of these rows are read, and all n-grams of at least ``min_share`` of a
    language's rows are learned; repeated rows count as often as they are there.
    A caller who wants a bound gives ``rows_per_language``: about as many rows of
    each language are then taken by a hash of the id.  None if there is nothing
    to learn from, as in an empty table.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    most_rows = rows_per_language if rows_per_language is not None else max(counts.values())
    if most_rows < max(counts.values()):
        rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most_rows / n))])
        draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.where(draw < F.element_at(rate, F.col(lang_col)))
    learned = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = learned.mapInArrow(_gram_counts(sizes), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # of drawn rows the share is of their number up to chance
    least = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min_share * min(n, most_rows))])
    found = keep(counted.where(F.col("n") >= F.element_at(least, F.col("lang"))).select("lang", "gram"), "language-grams")
    most = {r[0]: r[1] for r in found.groupBy("lang").count().collect()}
    if not most:
        return None
    bits = min(max((max(most.values()) * CELLS_A_GRAM - 1).bit_length(), FILTER_BITS), MOST_FILTER_BITS)
    cells = found.mapInArrow(_set_cells(bits), "lang string, cell long")
    pieces = cells.groupBy("lang", F.shiftright("cell", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND((1 << 15) - 1)).alias("map"))
    maps = ((r["lang"], r["piece"] << 15, np.unpackbits(np.frombuffer(r["map"], dtype=np.uint8), bitorder="little").astype(bool)) for r in pieces.toLocalIterator())
    return LanguageModel.of_pieces(sorted(most), bits, maps, max(sorted(counts), key=lambda x: counts[x]), sizes)


def least_shares(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", part: float = LEAST_PART) -> dict[str, float]:
    """For each language of the model, the corrected share of n-grams below which a text is not of it.

    It is ``part`` of the exact median over all labelled rows that training left
    out, so neither a text's length nor a few odd rows decide.
    A language without such rows takes the lowest of the others, 0 if there are none.
    """
    if model is None:
        return {}
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isin(model.languages) & held_out(id_col))
    told = keep(identify(rows.select(F.col(text_col).alias("text")), model).where("lang_score > 0").select(F.col("lang_pred").alias("g"), F.col("lang_score").alias("v")), "language-shares")
    medians = quantiles(told, dict.fromkeys(model.languages, 0.5))
    lowest = min(medians.values(), default=0.0)
    return {lang: part * medians.get(lang, lowest) for lang in model.languages}


def identify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its corrected share of n-grams.

    Null text and text without a letter are ``und`` with score 0, and so is
    every text if there is no model.  A text of which no n-gram is known gets
    the language with most training rows, with score 0.  Equal shares go to the
    language that sorts first.  Bytes that are no UTF-8 are no letters, equal rows
    give equal results, an empty table an empty one.  Other columns pass through; a column with one of
    the two output names is replaced.
    """

    def make(texts: pa.Array) -> list[pa.Array]:
        names, scores = model.predict(texts) if model is not None else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return add_columns(docs, text_col, {lang_out: "string", score_out: "double"}, make)
