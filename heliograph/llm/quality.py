"""Quality scores learned from preference pairs (Bradley-Terry).

A document has a latent score that is linear in its features.  A document
labelled good is preferred to one labelled bad, and the Bradley-Terry model
says with which probability: the logistic function of the difference of their
scores.  The weights minimise the logistic loss on feature differences.

Every labelled row that may be learned from takes part.  Rows are dealt by a hash
into blocks of about ``BLOCK``, and inside a block every good row meets every bad
one, so the work is linear in the rows and no task sees more than a block.  The
decision threshold is the exact quantile of all these rows' scores at the share
of bad labels, and the reported score is shifted so that this threshold is 0.3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.lineage import keep
from heliograph.llm.columns import add_columns
from heliograph.llm.language_id import held_out
from heliograph.llm.quantiles import quantiles
from heliograph.llm.textops import Words, chunks, row_of, row_sums

CUT = 0.3

_CLASS = np.zeros((256, 6), dtype=np.int64)
_CLASS[65:91, 0] = 1  # upper case
_CLASS[97:123, 1] = 1  # lower case
_CLASS[128:, 1] = 1
_CLASS[48:58, 2] = 1  # digits
_CLASS[[33, 63], 3] = 1  # ! ?
_CLASS[[44, 46, 58, 59], 4] = 1  # , . : ;
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ",.:;!?'\"-()"], 5] = 1

FEATURES = (
    "log_words", "log_bytes", "upper", "digits", "shouts", "stops", "symbols", "mean_word", "long_words", "short_words", "same_as_last", "same_as_second_last",
    "distinct", "log_top_word", "top_word", "top_five", "symbol_words", "upper_words", "lines", "words_a_line", "repeated_lines", "words_per_stop", "distinct_log", "empty",
)


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets)
    words = Words(data, offsets)
    bounds, row = words.bounds, row_of(words.bounds)
    n = np.diff(bounds)
    safe, solid = np.maximum(n, 1), np.maximum(size, 1)
    share = [row_sums(_CLASS[data, k], offsets) for k in range(6)]
    length = words.end - words.start
    symbols, upper = np.concatenate(([0], np.cumsum(_CLASS[data, 5]))), np.concatenate(([0], np.cumsum(_CLASS[data, 0])))
    symbol_word = (symbols[words.end] - symbols[words.start]) > 0
    upper_word = (upper[words.end] - upper[words.start]) * 2 > length
    same = np.zeros(len(row), dtype=bool)
    same[1:] = (words.h[1:] == words.h[:-1]) & (row[1:] == row[:-1])
    second = np.zeros(len(row), dtype=bool)
    second[2:] = (words.h[2:] == words.h[:-2]) & (row[2:] == row[:-2])
    count = lambda x: np.bincount(row, weights=x, minlength=rows)
    top, five, kinds = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    for i in range(rows):
        h = np.sort(words.h[bounds[i] : bounds[i + 1]])
        if len(h):
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            runs = np.sort(np.diff(edge))
            top[i], five[i], kinds[i] = runs[-1], runs[-5:].sum(), len(runs)
    gap = np.zeros(256, dtype=bool)
    gap[10] = True
    lines = Words(data, offsets, rough=gap)
    n_lines = np.diff(lines.bounds)
    line_row = row_of(lines.bounds)
    repeated = np.zeros(rows)
    if len(line_row):
        order = np.lexsort((lines.h, line_row))
        again = (lines.h[order][1:] == lines.h[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
        repeated = np.bincount(line_row[order][1:][again], minlength=rows)
    out = np.stack(
        [
            np.log1p(n), np.log1p(size), share[0] / solid, share[2] / solid, share[3] / solid, share[4] / solid, share[5] / solid, count(length) / safe, count(length > 12) / safe, count(length <= 3) / safe,
            count(same) / safe, count(second) / safe, kinds / safe, np.log1p(top), top / safe, five / safe, count(symbol_word) / safe, count(upper_word) / safe, np.log1p(n_lines), np.log1p(n / np.maximum(n_lines, 1)),
            repeated / np.maximum(n_lines, 1), np.log1p(n / (share[4] + 1)), np.log1p(kinds), (n == 0).astype(float),
        ],
        axis=1,
    )
    return out


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` a text; null is the empty text."""
    parts = [_features(data, offsets) for _, _, data, offsets in chunks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their squares, so that a score may rise and fall along one of them."""
    return np.concatenate([x, x * x], axis=1)


@dataclass
class PairwiseModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return expand(z) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip(self.latent(x) - self.threshold + np.log(CUT / (1 - CUT)), -60, 60)
        return 1 / (1 + np.exp(-s))


def _pair_sums(z: np.ndarray, label: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, gradient and curvature of the logistic loss summed over all pairs of a good and a bad row, as one vector."""
    good, bad = z[label == 1], z[label == 0]
    wrong = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None], -30, 30)))
    bend = wrong * (1 - wrong)
    across = good.T @ (bend @ bad)
    curve = (good.T * bend.sum(axis=1)) @ good + (bad.T * bend.sum(axis=0)) @ bad - across - across.T
    grad = wrong.sum(axis=0) @ bad - wrong.sum(axis=1) @ good
    return np.concatenate([[float(wrong.size)], grad, curve.ravel()])


def _newton(sums, size: int, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """The weights at which the mean loss and its ridge are least; ``sums`` gives the sums of ``_pair_sums`` at some weights."""
    w = np.zeros(size)
    for _ in range(steps):
        total = sums(w)
        if not total[0]:
            break
        grad = total[1 : size + 1] / total[0] + ridge * w
        step = np.linalg.solve(total[size + 1 :].reshape(size, size) / total[0] + ridge * np.eye(size), grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return expand(np.clip((x - mean) / scale, -6, 6))


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs: int | None = None, ridge: float = 1e-3, steps: int = 30, seed: int = 11) -> PairwiseModel:
    """The model of rows in memory, from all pairs of a good and a bad one, or from ``pairs`` drawn ones if that is given."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = PairwiseModel(mean, scale, np.zeros(2 * x.shape[1]), 0.0)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if len(good) and len(bad):
        z = _scaled(x, mean, scale)
        if pairs is None:
            model.weights = _newton(lambda w: _pair_sums(z, label, w), z.shape[1], ridge, steps)
        else:
            rng = np.random.default_rng(seed)
            d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
            zero, one = np.zeros((1, d.shape[1])), np.repeat([0, 1], [1, pairs])
            model.weights = _newton(lambda w: _pair_sums(np.concatenate([zero, d]), one, w), d.shape[1], ridge, steps)
        model.threshold = float(np.quantile(model.latent(x), len(bad) / len(label)))
    elif len(bad):
        model.threshold = 10.0
    return model


#: Rows of a block, and rows of the rarer label that a block has at least while there are as many.
BLOCK, RARE = 2048, 64
_WIDE = len(FEATURES) + 2


def _features_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))], names=["__key", "x"])


def _block(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of a block as one matrix (features, label, whether this is the row's first block) in an order that does not depend on their arrival."""
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    rows = np.column_stack([x, table.column("label").to_numpy(), table.column("first").to_numpy()]).astype("<f8")
    rows = rows[np.lexsort(rows.T)]
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([rows.tobytes()], pa.binary())})


def _matrix(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype="<f8").reshape(-1, _WIDE)


def _add_blocks(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    total = sum(np.frombuffer(v.as_buffer(), dtype="<f8") for v in table.column("sums"))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})


def _total(blocks: DataFrame, n: int, of) -> np.ndarray:
    """The sum over all blocks of the vector ``of`` a block's rows, always added in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.asarray(of(_matrix(v)), dtype="<f8").tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.binary())], names=["block", "sums"])

    made = blocks.select("block", "rows").mapInArrow(run, "block long, sums binary")
    if n > 256:
        made = made.groupBy(F.pmod("block", F.lit(64)).alias("block")).applyInArrow(_add_blocks, "block long, sums binary")
    return sum(np.frombuffer(r["sums"], dtype="<f8") for r in sorted(made.collect(), key=lambda r: r["block"]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int | None = None) -> PairwiseModel:
    """Fit on all labelled rows whose crc32(id) mod 5 is not 0.

    A caller who wants a bound gives ``max_rows``: ids are then drawn by a hash
    at the rate of that number over the number of usable ones.
    Labels that are null or not 0 or 1 are left out, repeated ones count once; an
    id with both labels or several texts gives a row for each pair.  Where blocks
    would have less than ``RARE`` rows of the rarer label, its rows are in several
    blocks.  Without both kinds of label every score is the same.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).distinct()
    if max_rows is not None:
        draw = F.pmod(F.xxhash64(F.col("__id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
        usable = usable.where(draw < min(1.0, max_rows / max(usable.count(), 1)))
    # features are smaller than texts, so these are made before the rows are dealt by id
    texts = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__key"), F.col(text_col).alias("text"))
    featured = texts.mapInArrow(_features_of_rows, f"__key {docs.schema[id_col].dataType.simpleString()}, x array<double>")
    rows = keep(featured.join(usable, F.col("__key") == F.col("__id")).select(F.xxhash64("__id", "x", "label").alias("deal"), "x", "label"), "quality-rows")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size, wide = len(FEATURES), 2 * len(FEATURES)
    model = PairwiseModel(np.zeros(size), np.ones(size), np.zeros(wide), 0.0)
    if not counts:
        return model
    n = -(-sum(counts.values()) // BLOCK)
    rare = min((0, 1), key=lambda x: counts.get(x, 0))
    times = min(n, -(-RARE * n // max(counts.get(rare, 0), 1)))
    turns = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == rare, times - 1).otherwise(0))).alias("turn")
    dealt = rows.select("deal", "x", "label", turns).select(F.pmod(F.col("deal") + F.col("turn") * max(1, n // times), F.lit(n)).alias("block"), "x", "label", (F.col("turn") == 0).cast("int").alias("first"))
    blocks = keep(dealt.groupBy("block").applyInArrow(_block, "block long, rows binary"), "quality-blocks")
    once = lambda m: m[m[:, -1] == 1, :size]
    model.mean = _total(blocks, n, lambda m: once(m).sum(axis=0)) / sum(counts.values())
    mean = model.mean
    scale = np.sqrt(_total(blocks, n, lambda m: ((once(m) - mean) ** 2).sum(axis=0)) / sum(counts.values()))
    model.scale = scale = np.where(scale > 1e-9, scale, 1.0)
    if len(counts) == 2:
        model.weights = _newton(lambda w: _total(blocks, n, lambda m: _pair_sums(_scaled(m[:, :size], mean, scale), m[:, size], w)), wide)

        def latents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for v in batch.column(1):
                    yield pa.RecordBatch.from_arrays([pa.array(model.latent(once(_matrix(v))))], names=["v"])

        scores = blocks.select("block", "rows").mapInArrow(latents, "v double").select(F.lit(0).alias("g"), "v")
        model.threshold = quantiles(scores, {0: counts[0] / sum(counts.values())})[0]
    elif 0 in counts:
        model.threshold = 10.0
    return model


def score(docs: DataFrame, model: PairwiseModel, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with a quality score from 0 to 1; null and empty texts are scored as empty.

    Other columns pass through; a column with the output's name is replaced.
    """

    return add_columns(docs, text_col, {out: "double"}, lambda texts: [pa.array(model.score(features(texts)), pa.float64())])
