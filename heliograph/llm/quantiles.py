"""Exact quantiles of a column of any length, by narrowing ranges of values.

Each round counts the values of a range in bins and goes on with the bin that
holds the wanted rank, so no task and not the driver see more than the bins; a
round divides the range by their number, which ends after two or three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def _narrowed(bins: list, rank: int, below: int, after: float | None) -> tuple[float, float, int, int, float | None]:
    """(least, most, values, values below, next value) of the bin with this rank."""
    for i, r in enumerate(bins):
        if rank < below + r["n"]:
            return r["least"], r["most"], r["n"], below, bins[i + 1]["least"] if i + 1 < len(bins) else after
        below += r["n"]
    raise ValueError("rank beyond the values")


def quantiles(values: DataFrame, shares: dict) -> dict:
    """For each group the quantile of its share, linear between neighbours as NumPy's.

    ``values`` has a group ``g`` and finite numbers ``v``; groups without a share
    and null or NaN values are left out, and a group without values gets none.
    """
    values = values.where(F.col("g").isin(list(shares)) & F.col("v").isNotNull() & ~F.isnan("v")).select("g", F.col("v").cast("double").alias("v"))
    ends = [F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")]
    state = {r["g"]: (r["least"], r["most"], r["n"], 0, None, (r["n"] - 1) * shares[r["g"]]) for r in values.groupBy("g").agg(*ends).collect()}
    found = {}
    while state:
        for g, (least, most, n, below, after, place) in list(state.items()):
            rank = int(place)
            if least == most:
                upper = least if rank + 1 < below + n or after is None else after
                found[g] = least + (place - rank) * (upper - least)
                del state[g]
        if not state:
            break
        of = lambda pick: F.element_at(F.create_map(*[F.lit(x) for g, s in state.items() for x in (g, pick(s))]), F.col("g"))
        low = of(lambda s: s[0])
        cell = F.least(F.floor((F.col("v") - low) / of(lambda s: max((s[1] - s[0]) / BINS, 5e-324))), F.lit(BINS - 1))
        inside = values.where((F.col("v") >= low) & (F.col("v") <= of(lambda s: s[1])))
        bins: dict = {}
        for r in inside.groupBy("g", cell.alias("cell")).agg(*ends).collect():
            bins.setdefault(r["g"], []).append(r)
        for g, rows in bins.items():
            *_, below, after, place = state[g]
            state[g] = (*_narrowed(sorted(rows, key=lambda r: r["cell"]), int(place), below, after), place)
    return found
