"""Least squares per group: Spark sums the cross products, only the small solve is NumPy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_products(df: DataFrame, by: Sequence[str], x: Sequence[str], y: str) -> DataFrame:
    """Per group: ``n`` and the sums of y*y, x*x (upper triangle) and x*y over rows without nulls.

    The groupBy combines on the map side, so a hot group costs no more than a cold one."""
    pairs = upper(len(x))
    return df.dropna(subset=[*x, y]).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.col(y) * F.col(y)).alias("yy"),
        F.array(*[F.sum(F.col(x[i]) * F.col(x[j])) for i, j in pairs]).alias("xx"),
        F.array(*[F.sum(F.col(c) * F.col(y)) for c in x]).alias("xy"))


def upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def square(values: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    rows, cols = np.array(upper(k)).T
    out[rows, cols] = out[cols, rows] = values
    return out


def solve(n: int, yy: float, gram: np.ndarray, xy: np.ndarray):
    """(beta, standard errors, residual sum) or None; columns that are all zero get coefficient 0."""
    used = np.flatnonzero(np.diag(gram) > 0)
    scale = np.sqrt(np.diag(gram)[used])
    unit = gram[np.ix_(used, used)] / np.outer(scale, scale)
    if len(used) == 0 or n <= len(used) or np.linalg.matrix_rank(unit) < len(used):
        return None
    inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    beta, se = np.zeros(len(xy)), np.zeros(len(xy))
    beta[used] = inverse @ xy[used]
    rest = max(float(yy - beta @ xy), 0.0)
    se[used] = np.sqrt(np.diag(inverse) * rest / (n - len(used)))
    return beta, se, rest


def least_squares(df: DataFrame, by: Sequence[str], x: Sequence[str], y: str) -> DataFrame:
    """Regression of ``y`` on the columns ``x`` within each group.

    Returns ``by``, ``beta`` and ``se`` (arrays in the order of ``x``), ``sse`` and ``n``; one row per
    group, and the arrays are null where the system is singular.
    """
    k = len(x)
    sums = cross_products(df, by, x, y)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = [solve(n, yy, square(xx, k), np.asarray(xy, dtype=float))
                    for n, yy, xx, xy in zip(pdf["n"], pdf["yy"], pdf["xx"], pdf["xy"])]
            yield pdf[[*by, "n"]].assign(beta=[f and f[0].tolist() for f in fits], se=[f and f[1].tolist() for f in fits],
                                         sse=[f[2] if f else None for f in fits])

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "n bigint", "beta array<double>",
                        "se array<double>", "sse double"])
    return sums.mapInPandas(run, schema)
