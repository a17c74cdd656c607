"""Anomaly detection: feature statistics, z-scores, isolation forest, local outlier factor."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions import neighbours as nb
from paramo.functions.ranks import exact_quantiles, long_form, with_row
from paramo.operators.tree_attribution import spread
from paramo.session import cut_lineage, dropped, materialise

CONTAMINATION = 0.10


def filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def feature_moments(df: DataFrame, columns: Sequence[str] = tuple(fv.MEASURES)) -> DataFrame:
    """Per feature: mean and sample deviation (at least 1e-6)."""
    return long_form(filled(df, columns), columns).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.greatest(F.stddev_samp("value"), F.lit(1e-6)).alias("std"))


def feature_stats(df: DataFrame, columns: Sequence[str] = tuple(fv.MEASURES)) -> DataFrame:
    """Per feature: mean, sample deviation (at least 1e-6) and exact 5 % and 95 % quantiles."""
    rows = long_form(filled(df, columns), columns)
    return feature_moments(df, columns).join(exact_quantiles(rows, "value", {"p05": 0.05, "p95": 0.95}, ["feature"]).drop("n"), "feature")


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add ``_stats``: feature -> its statistics, one map entry per feature column."""
    known = stats.agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct(*[c for c in stats.columns if c != "feature"]))))).scalar()
    return df.withColumn("_stats", known)


def z_of(c: str) -> Column:
    s = F.col("_stats")[c]
    return (F.col(c) - s["mean"]) / s["std"]


def z_scores(df: DataFrame, stats: DataFrame, columns: Sequence[str] = tuple(fv.MEASURES)) -> DataFrame:
    """``stats`` needs mean and deviation only (``feature_moments``).  Add ``z_<feature>`` for each feature, the largest |z| and its feature (first listed wins ties)."""
    df = with_stats(df, stats).withColumns({f"z_{c}": z_of(c) for c in columns}).drop("_stats")
    sizes = [F.abs(F.col(f"z_{c}")) for c in columns]
    top = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return df.withColumns({"max_z": top, "max_feature": F.coalesce(*[F.when(s == top, F.lit(c)) for s, c in zip(sizes, columns)])})


def percentile_rules(df: DataFrame, stats: DataFrame, rain: str = "ideam_precipitacion_anomalia",
                     temp: str = "ideam_temperatura_anomalia", change: str = "upra_var_mensual_pct") -> DataFrame:
    """Flags: rain below its 5 % quantile, heat above its 95 % quantile, price change beyond 3 deviations."""
    known = F.col("_stats")
    return with_stats(df, stats).withColumns({
        "drought": F.col(rain) < known[rain]["p05"],
        "heat_wave": F.col(temp) > known[temp]["p95"],
        "price_spike": z_of(change) > fv.Z_CRITICAL}).drop("_stats")


# --- local outlier factor ----------------------------------------------------------------

def default_neighbours(n: int) -> int:
    return max(1, min(20, n // 3 + 1))


def _neighbours(row, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(point, place, copies) of the neighbours in a record of ``near_lists``; how many of these copies count once the row itself comes
    first with all of its own, and how many of its own do."""
    count, place, take = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("count", "place", "take"))
    point, w = np.repeat(np.arange(len(count)), count), np.frombuffer(row["w"], np.int64)
    other = np.where(place == point, 0, take)
    before = np.cumsum(other) - other
    first = np.cumsum(count) - count
    before = before - before[first[point]] + w[point]
    return point, place, take, np.clip(k - before, 0, other), np.minimum(w, k)


def _densities(row, kdist: np.ndarray, k: int) -> pd.DataFrame:
    """Of each point the density among its neighbours, and that of the row as a new one."""
    point, place, take, later, own = _neighbours(row, k)
    n = len(own)
    far = np.maximum(np.frombuffer(row["dist"], float), kdist[place])
    with np.errstate(invalid="ignore", divide="ignore"):
        trained = np.bincount(point, far * take, n) / np.bincount(point, take, n)
        fresh = (np.bincount(point, far * later, n) + kdist[:n] * own) / (np.bincount(point, later, n) + own)
    return pd.DataFrame([{"block": row["block"], "value": (1 / (trained + 1e-10)).tobytes(), "own": (1 / (fresh + 1e-10)).tobytes()}])


def _factors(row, values: np.ndarray, k: int) -> pd.DataFrame:
    """(uid, factor in the set, factor as a new row) of each point that has neighbours; ``values`` are the densities of its points in the set and as new
    rows, and those of the others in the set."""
    point, place, take, later, own = _neighbours(row, k)
    n = len(own)
    lrd, fresh = np.concatenate([values[:n], values[2 * n:]]), values[n:2 * n]
    near = lrd[place]
    some = np.bincount(point, minlength=n) > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        trained = np.bincount(point, near * take, n) / np.bincount(point, take, n) / lrd[:n]
        lof = (np.bincount(point, near * later, n) + lrd[:n] * own) / (np.bincount(point, later, n) + own) / fresh
    uid = np.frombuffer(row["uid"], "V16")
    return pd.DataFrame({"uid": [u.tobytes() for u in uid[some]], "trained": trained[some], "lof": lof[some]})


def local_outlier_factor(df: DataFrame, key: str, columns: Sequence[str], k: int | None = None,
                         contamination: float = CONTAMINATION, size: int = nb.BLOCK) -> DataFrame:
    """(key, lof, lof_outlier): exact local outlier factor of every row against the whole set.

    Densities of the set leave a point itself out; the score asks for the neighbours of the row as if
    it were new, so its own copy counts.  The cut is the contamination quantile of the set's factors.
    """
    z = materialise(nb.standardised(df, columns, [key]))
    k = k or default_neighbours(z.count())
    near = nb.near_lists(nb.distinct_points(z, columns, key), len(columns), k, size)
    dense = materialise(nb.with_values(near.select("block", "w", "count", "place", "dist", "take", "wants"), near.select("block", F.col("kdist").alias("value"), F.col("kdist").alias("own")),
                                       lambda row, kdist: _densities(row, kdist, k), "block long, value binary, own binary"))
    factors = nb.with_values(near.select("block", "uid", "w", "count", "place", "take", "wants"), dense.select("block", "value", F.concat("value", "own").alias("own")),
                             lambda row, values: _factors(row, values, k), "uid binary, trained double, lof double")
    # written once: the cut needs all of it before the first row can be judged
    rows = materialise(z.select(key, F.unhex(nb.point_key(columns)).alias("uid")).join(factors, "uid").select(key, "trained", "lof"))
    for table in (z, near, dense):
        dropped(table)
    cut = exact_quantiles(rows.select((-F.col("trained")).alias("_t")), "_t", {"cut": contamination}).select("cut").scalar()
    return rows.select(key, "lof", (-F.col("lof") < cut).alias("lof_outlier"))


# --- isolation forest ---------------------------------------------------------------------

def path_norm(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def forest_sample(df: DataFrame, key: str, columns: Sequence[str], trees: int, per_tree: int, n: int, seed: int) -> DataFrame:
    """(tree, point): for each tree the ``per_tree`` rows with the smallest hash of (seed, tree, key).

    A hash threshold keeps about four times the rows needed before anything is shuffled.
    """
    share = min(1.0, 4.0 * per_tree / max(n, 1))
    span = 2 ** 62
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col(key)), F.lit(span))
    picked = df.select(key, F.array(*columns).alias("point"), F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < F.lit(int(share * span)))).alias("tree"))
    picked = picked.withColumn("_draw", draw(F.col("tree")))
    return picked.withColumn("_rn", F.row_number().over(W.partitionBy("tree").orderBy("_draw", key))).where(
        F.col("_rn") <= per_tree).select("tree", "point")


FOREST_SCHEMA = "tree int, node int, feature int, cut double, low int, high int, size int, depth int"


def grow_trees(sample: DataFrame, per_tree: int, seed: int) -> DataFrame:
    """One isolation tree per group of at most ``per_tree`` points, as rows of nodes."""
    limit = max(1, math.ceil(math.log2(max(per_tree, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.array(pdf["point"].tolist(), dtype=float)
        x = x[np.lexsort(x.T)]
        rng = np.random.default_rng([seed, tree])
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        count = 1
        while todo:
            node, rows, depth = todo.pop()
            part = x[rows]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 and depth < limit else []
            if len(spread) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(rows), depth))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            left = part[:, f] <= cut
            nodes.append((tree, node, f, cut, count, count + 1, len(rows), depth))
            todo += [(count, rows[left], depth + 1), (count + 1, rows[~left], depth + 1)]
            count += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "size", "depth"])

    return sample.groupBy("tree").applyInPandas(grow, FOREST_SCHEMA)


class IsolationForest:
    """Fitted forest: at most ``trees`` x 511 node rows, which bounds what is sent to the tasks."""

    def __init__(self, nodes: pd.DataFrame, columns: Sequence[str], scale: dict, per_tree: int, cut: float | None = None):
        self.nodes, self.columns, self.scale, self.per_tree, self.cut = nodes, list(columns), scale, per_tree, cut

    def score(self, df: DataFrame, out: str = "if_score") -> DataFrame:
        """Add the anomaly score: negative, -1 for points that separate at once."""
        nodes = self.nodes.sort_values(["tree", "node"])
        starts = nodes.groupby("tree").size().cumsum().shift(fill_value=0).to_numpy()
        arrays = {c: nodes[c].to_numpy() for c in ("feature", "cut", "low", "high")}
        tail = np.array([d + path_norm(s) for d, s in zip(nodes["depth"], nodes["size"])])
        norm, mean, std = path_norm(self.per_tree), *[np.array([self.scale[f"{p}_{c}"] for c in self.columns]) for p in ("m", "s")]
        std = np.where(std > 0, std, 1.0)
        shared = df.sparkSession.sparkContext.broadcast((starts, arrays, tail))

        @F.pandas_udf("double")
        def run(points: Iterator[pd.Series]) -> Iterator[pd.Series]:
            first, node, ends = shared.value
            for batch in points:
                if len(batch) == 0:
                    yield pd.Series([], dtype=float)
                    continue
                x = (np.array(batch.tolist(), dtype=float) - mean) / std
                total = np.zeros(len(x))
                for start in first:
                    at = np.full(len(x), start)
                    while True:
                        f = node["feature"][at]
                        open_ = f >= 0
                        if not open_.any():
                            break
                        a, i = at[open_], np.flatnonzero(open_)
                        goes_low = x[i, f[open_]] <= node["cut"][a]
                        at[i] = start + np.where(goes_low, node["low"][a], node["high"][a])
                    total += ends[at]
                yield pd.Series(-np.power(2.0, -(total / len(first)) / norm))

        return df.withColumn(out, run(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns])))

    def detect(self, df: DataFrame) -> DataFrame:
        """Score and outlier flag of any rows against the fitted cut."""
        return self.score(df).withColumn("if_outlier", F.col("if_score") < F.lit(self.cut))


def fit_isolation_forest(df: DataFrame, key: str, columns: Sequence[str] = tuple(fv.MEASURES), contamination: float = CONTAMINATION,
                         seed: int = 2026, trees: int | None = None, per_tree: int = 256) -> IsolationForest:
    """``trees`` trees (by default two per row, 50 at least and 200 at most) over ``per_tree`` rows each, all rows if
    there are fewer; only the nodes, the scaling and the cut reach the driver."""
    data = materialise(filled(df, columns).select(key, *columns))
    stats = data.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns],
                     *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first().asDict()
    n = stats["n"]
    trees, per_tree = trees or min(200, max(50, n * 2)), min(n, per_tree)
    z = nb.standardised(data, columns, [key])
    nodes = grow_trees(forest_sample(z, key, columns, trees, per_tree, n, seed), per_tree, seed).toPandas()
    model = IsolationForest(nodes, columns, stats, per_tree)
    scores = materialise(model.score(spread(data)).select("if_score"))
    model.cut = exact_quantiles(scores, "if_score", {"cut": contamination}).first()["cut"]
    return model


# --- combination and reading -----------------------------------------------------------------

def combined(df: DataFrame, if_score: str = "if_score", lof: str = "lof", if_out: str = "if_outlier",
             lof_out: str = "lof_outlier") -> DataFrame:
    """Anomaly when either method says so; score 0-1 from both, each scaled to its range."""
    df = with_row(df, "_span", df, a=F.min(-F.col(if_score)), b=F.max(-F.col(if_score)), c=F.min(lof), d=F.max(lof))
    span = F.col("_span")
    forest = (-F.col(if_score) - span["a"]) / (span["b"] - span["a"] + 1e-9)
    local = (F.col(lof) - span["c"]) / (span["d"] - span["c"] + 1e-9)
    return df.withColumns({"is_anomaly": F.col(if_out) | F.col(lof_out), "combined": forest * 0.6 + local * 0.4}).drop("_span")


def classified(df: DataFrame, price: str = "z_upra_var_mensual_pct", rain: str = "z_ideam_precipitacion_anomalia",
               temp: str = "z_ideam_temperatura_anomalia", max_z: str = "max_z") -> DataFrame:
    """Kind and severity of a row from its z-scores."""
    p, r, t, m = F.col(price), F.col(rain), F.col(temp), fv.Z_MODERATE
    kind = (F.when((F.abs(p) >= m) & (F.abs(r) >= m), "riesgo_compuesto").when(p >= m, "precio_extremo")
            .when(p <= -m, "precio_minimo").when(r <= -m, "sequia_extrema").when(r >= m, "exceso_hidrico")
            .when(t >= m, "ola_calor").otherwise("anomalia_multivariada"))
    level = (F.when(F.col(max_z) >= fv.Z_CRITICAL, "CRÍTICA").when(F.col(max_z) >= fv.Z_HIGH, "ALTA").otherwise("MODERADA"))
    return df.withColumns({"kind": kind, "severity": level})


def described(df: DataFrame) -> DataFrame:
    """Add a sentence on what is unusual about a classified row."""
    change, rain, temp = F.col("upra_var_mensual_pct"), F.col("ideam_precipitacion_anomalia"), F.col("ideam_temperatura_anomalia")
    kind = F.col("kind")
    text = (F.when(kind == "riesgo_compuesto", F.format_string("Precio (%+.1f%%) y lluvia (%+.0f mm) se apartan a la vez de lo normal.", change, rain))
            .when(kind == "precio_extremo", F.format_string("Los insumos suben %.1f%% en el mes, muy por encima de lo habitual.", change))
            .when(kind == "precio_minimo", F.format_string("Los insumos bajan %.1f%% en el mes, algo fuera de lo habitual.", F.abs(change)))
            .when(kind == "sequia_extrema", F.format_string("Faltan %.0f mm de lluvia frente a lo normal.", F.abs(rain)))
            .when(kind == "exceso_hidrico", F.format_string("Sobran %.0f mm de lluvia frente a lo normal.", rain))
            .when(kind == "ola_calor", F.format_string("La temperatura supera en %.1f °C lo normal.", temp))
            .otherwise(F.concat(F.lit("Combinación poco común; lo que más destaca es "), F.coalesce("max_feature", F.lit("un conjunto de medidas")), F.lit("."))))
    return df.withColumn("description", text)


def detected(df: DataFrame, key: str, columns: Sequence[str] = tuple(fv.MEASURES), contamination: float = CONTAMINATION) -> DataFrame:
    """The whole path over every row: isolation forest and local outlier factor, combined, classified and described."""
    rows = materialise(filled(df, columns))
    forest = fit_isolation_forest(rows, key, columns, contamination).detect(rows)
    factors = local_outlier_factor(rows, key, columns, contamination=contamination)
    both = materialise(z_scores(forest, feature_moments(rows, columns), columns).join(factors, key))
    return described(classified(combined(both)))


def ranked(df: DataFrame, key: str, n: int | None = 10) -> DataFrame:
    """Anomalies, highest combined score first; all of them when ``n`` is None."""
    out = df.where("is_anomaly").orderBy(F.col("combined").desc(), key)
    return out.limit(n) if n else out


def summary(df: DataFrame) -> DataFrame:
    """Rows, anomalies, rate in percent, critical ones and the most frequent kind."""
    odd = F.col("is_anomaly")
    top = df.where("is_anomaly").groupBy("kind").agg(F.count("*").alias("n")).agg(
        F.max_by("kind", F.struct("n", "kind"))).scalar()
    return df.agg(
        F.count("*").alias("rows"), F.count_if(odd).alias("anomalies"),
        (F.count_if(odd) * 100.0 / F.count("*")).alias("rate_pct"),
        F.count_if(odd & (F.col("severity") == "CRÍTICA")).alias("critical"),
    ).withColumn("top_kind", top)
