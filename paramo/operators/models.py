"""Classifiers: forest, boosting, calibration, the weighted vote, and their upkeep."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramo import fixed_values as fv
from paramo.functions.ranks import hash_ranks
from paramo.operators import boosting, evaluate, forest
from paramo.operators.boosting import Boosting
from paramo.operators.forest import Forest
from paramo.operators.score import label_of
from paramo.session import cut_lineage

CLASSES = tuple(fv.LABELS)
SEED = 2026
#: Rows a training set must have.
LEAST_ROWS = 10


def checked(df: DataFrame, label: str = "class_id") -> list[int]:
    """The classes of a training set, in order; refuses one that cannot be learnt from."""
    counts = df.groupBy(label).agg(F.count("*").alias("n")).limit(len(CLASSES) + 1).collect()
    seen = sorted(r[label] for r in counts if r[label] is not None)
    rows = sum(r["n"] for r in counts)
    if not set(seen) <= set(CLASSES) or len(seen) < len(counts):
        raise ValueError(f"{label} must be one of {CLASSES} in every row")
    if rows < LEAST_ROWS:
        raise ValueError(f"a model needs {LEAST_ROWS} rows at least, there are {rows}")
    if len(seen) < 2:
        raise ValueError("a model needs rows of two classes at least")
    return seen


def class_weights(df: DataFrame, label: str = "class_id") -> DataFrame:
    """(label, rows, weight): n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    return counts.withColumn("_t", counts.agg(F.struct(F.sum("rows").alias("n"), F.count("*").alias("k"))).scalar()).select(
        label, "rows", (F.col("_t.n") / (F.col("_t.k") * F.col("rows"))).alias("weight"))


def weighted(df: DataFrame, label: str = "class_id") -> DataFrame:
    """Rows with the balanced weight of their class: a map of one entry per class, no join on a hot key."""
    table = class_weights(df, label).agg(F.map_from_entries(F.collect_list(F.struct(label, "weight")))).scalar()
    return df.withColumn("_w", table).withColumn("weight", F.col("_w")[F.col(label)]).drop("_w")


def stratified_split(df: DataFrame, key: str, label: str = "class_id", share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Add ``is_test``: the first share of each class by hash.

    With fewer than 20 rows everything trains and tests (``is_test`` null); with a one-row class the draw
    is not stratified.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.sum("n").alias("n")).first()
    if not sizes["n"] or sizes["n"] < 20:
        return df.withColumn("is_test", F.lit(None).cast("boolean"))
    ranked = hash_ranks(df, [key], seed, [label] if sizes["least"] >= 2 else [])
    return ranked.withColumn("is_test", F.col("draw_rank") < F.ceil(F.col("group_size") * share)).drop("draw", "draw_rank", "group_size")


def folds(df: DataFrame, key: str, k: int, label: str = "class_id", seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1, each class spread evenly."""
    ranked = hash_ranks(df, [key], seed, [label])
    return ranked.withColumn("fold", F.floor(F.col("draw_rank") * k / F.col("group_size")).cast("int")).drop("draw", "draw_rank", "group_size")


def fit_forest(df: DataFrame, columns: Sequence[str] = tuple(fv.FEATURES), label: str = "class_id", trees: int = 300, seed: int = SEED,
               key: str | None = None) -> Forest:
    """Random forest: depth 8, two rows per leaf, square root of the features, balanced classes."""
    return forest.fit(df, columns, checked(df, label), label, forest.Settings(trees=trees, seed=seed), key=key)[0]


def forest_proba(model: Forest, df: DataFrame, out: str = "proba") -> DataFrame:
    """Class probabilities in class order (a class never seen gets 0)."""
    return model.proba(df, out)


def fit_boosting(df: DataFrame, columns: Sequence[str] = tuple(fv.FEATURES), label: str = "class_id", rounds: int = 300, seed: int = SEED,
                 key: str | None = None) -> Boosting:
    """Gradient-boosted trees with a softmax over the classes: depth 5, step 0.08, 85 % of the rows and 80 % of the features per tree,
    L1, L2 and gain penalties."""
    return boosting.fit(df, columns, checked(df, label), label, boosting.Settings(rounds=rounds, seed=seed), key=key)[0]


@dataclass
class Calibration:
    """Per class, a map from raw to calibrated probability; the results are scaled to sum to 1."""

    models: dict
    kind: str

    def apply(self, df: DataFrame, raw: str, out: str = "proba") -> DataFrame:
        names = []
        for c, model in self.models.items():
            score = F.get(F.col(raw), F.lit(CLASSES.index(c)))
            names.append(f"_c_{c}")
            if self.kind == "isotonic":
                df = model.transform(df.withColumn("_s", score)).withColumn(f"_c_{c}", F.col("prediction")).drop("prediction", "_s")
            else:
                df = model.transform(df.withColumn("_s", array_to_vector(F.array(score)))).withColumn(
                    f"_c_{c}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "_s")
        total = sum((F.col(n) for n in names), F.lit(0.0))
        even = F.lit(1.0 / len(names))
        known = {c: F.when(total > 0, F.col(f"_c_{c}") / total).otherwise(even) for c in self.models}
        return df.withColumn(out, F.array(*[known.get(c, F.lit(0.0)) for c in CLASSES])).drop(*names)


def fit_calibration(scored: DataFrame, raw: str, kind: str, label: str = "class_id", digits: int | None = None) -> Calibration:
    """Isotonic or sigmoid calibration of out-of-fold probabilities.

    Equal scores are first pooled into one weighted point, exactly by default; with ``digits`` scores are rounded
    before, which bounds what the isotonic fit brings together (10,001 points per class for four).
    """
    models = {}
    for c in CLASSES:
        hit = (F.col(label) == c).cast("double")
        score = F.get(F.col(raw), F.lit(CLASSES.index(c)))
        pooled = scored.groupBy((score if digits is None else F.round(score, digits)).alias("_s"), hit.alias("_y")).agg(F.count("*").cast("double").alias("weight"))
        pooled = cut_lineage(pooled)
        if pooled.where("_y = 1").isEmpty():
            continue
        if kind == "isotonic":
            models[c] = IsotonicRegression(featuresCol="_s", labelCol="_y", weightCol="weight").fit(pooled)
        else:
            models[c] = LogisticRegression(featuresCol="_s", labelCol="_y", weightCol="weight").fit(
                pooled.withColumn("_s", array_to_vector(F.array("_s"))))
    return Calibration(models, kind)


def scored_folds(parts: DataFrame, models: Sequence, proba) -> DataFrame:
    """Every row of ``parts`` scored by the model of its fold."""
    out = [proba(m, parts.where(F.col("fold") == f)) for f, m in enumerate(models)]
    return cut_lineage(reduce(DataFrame.unionByName, out))


@dataclass
class Ensemble:
    """Calibrated forest (0.45) and boosting (0.55)."""

    forest: Forest
    boosting: Boosting
    forest_map: Calibration
    boosting_map: Calibration

    def predict(self, df: DataFrame) -> DataFrame:
        df = self.forest_map.apply(forest_proba(self.forest, df, "_rf"), "_rf", "forest_proba").drop("_rf")
        df = self.boosting_map.apply(self.boosting.proba(df, "_gb"), "_gb", "boosting_proba").drop("_gb")
        return evaluate.soft_vote(df, "forest_proba", "boosting_proba")


def fit_ensemble(df: DataFrame, key: str, trees: int = 400, rounds: int = 300, columns: Sequence[str] = tuple(fv.FEATURES), label: str = "class_id",
                 k: int = 3) -> Ensemble:
    """Both base models on all rows, and their calibration from models of ``k`` folds.

    The models of all folds and of all rows are grown together (see ``boosting.fit``, ``forest.fit``)."""
    parts, seen = cut_lineage(folds(df, key, k, label)), checked(df, label)
    fine, coarse = boosting.edges_for(parts, columns, [boosting.BINS, forest.BINS])
    *partial, boost = boosting.fit(parts, columns, seen, label, boosting.Settings(rounds=rounds, seed=SEED), "fold", k, key, fine)
    b = scored_folds(parts, partial, lambda m, d: m.proba(d))
    *partial, trees_ = forest.fit(parts, columns, seen, label, forest.Settings(trees=trees, seed=SEED), "fold", k, key, edges=coarse)
    a = scored_folds(parts, partial, forest_proba)
    return Ensemble(trees_, boost, fit_calibration(a, "proba", "isotonic", label), fit_calibration(b, "proba", "sigmoid", label))


def predicted(df: DataFrame, proba: str = "proba") -> DataFrame:
    at = F.array_position(proba, F.array_max(proba)) - 1
    return df.withColumn("predicted", F.get(F.array(*[F.lit(c) for c in CLASSES]), at.cast("int")))


def predict_batch(model: Forest, df: DataFrame) -> DataFrame:
    """Class and label of many rows; missing features count as 0."""
    out = predicted(forest_proba(model, df)).withColumnRenamed("predicted", "ivt_clase")
    return out.withColumn("ivt_etiqueta", label_of(F.col("ivt_clase")))


def report(df: DataFrame, label: str = "class_id", by: Sequence[str] = ()) -> DataFrame:
    return evaluate.class_report(evaluate.confusion(df, label, "predicted", by=by), by)


def cross_validate(df: DataFrame, key: str, trees: int = 300, k: int = 5, columns: Sequence[str] = tuple(fv.FEATURES), label: str = "class_id") -> DataFrame:
    """One row: folds used, mean and deviation of macro F1, mean accuracy."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    k = max(2, min(k, least))
    parts = cut_lineage(folds(df, key, k, label))
    models = forest.fit(parts, columns, checked(df, label), label, forest.Settings(trees=trees), "fold", k, key, whole=False)
    scored = scored_folds(parts, models, lambda m, d: predicted(forest_proba(m, d)))
    per = report(scored, label, ["fold"]).groupBy("fold").agg(
        F.max(F.when(F.col("name") == "macro", F.col("f1"))).alias("f1"), F.max(F.when(F.col("name") == "accuracy", F.col("f1"))).alias("accuracy"))
    return per.agg(F.count("*").alias("folds"), F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"), F.avg("accuracy").alias("accuracy_mean"))


def importances(model: Forest, spark, columns: Sequence[str] = tuple(fv.FEATURES), digits: int = 4) -> DataFrame:
    """(feature, importance, rank): one row per feature column."""
    rows = sorted(zip(columns, model.importance.tolist()), key=lambda r: -r[1])
    return spark.createDataFrame([(f, round(v, digits), i + 1) for i, (f, v) in enumerate(rows)], "feature string, importance double, rank int")


def compare_base(train: DataFrame, test: DataFrame, trees: int = 400, rounds: int = 300, label: str = "class_id") -> DataFrame:
    """(model, f1_macro, accuracy) of forest and boosting on the same split."""
    a = predicted(forest_proba(fit_forest(train, label=label, trees=trees), test)).select(label, "predicted", F.lit("forest").alias("model"))
    b = predicted(fit_boosting(train, label=label, rounds=rounds).proba(test)).select(label, "predicted", F.lit("boosting").alias("model"))
    return report(a.unionByName(b), label, ["model"]).groupBy("model").agg(
        F.max(F.when(F.col("name") == "macro", F.col("f1"))).alias("f1_macro"), F.max(F.when(F.col("name") == "accuracy", F.col("f1"))).alias("accuracy"))


def save(model: Forest, path: str, metadata: DataFrame) -> None:
    model.save(metadata.sparkSession, f"{path}/model")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load(spark, path: str) -> tuple[Forest, DataFrame]:
    return Forest.load(spark, f"{path}/model"), spark.read.parquet(f"{path}/metadata")


def scenario_grid(base: DataFrame, ranges: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Base rows with each listed column swept from low to high in steps: one row per combination."""
    for name, (low, high, step) in ranges.items():
        count = int(round((high - low) / step))
        values = F.transform(F.sequence(F.lit(0), F.lit(count)), lambda j: F.lit(float(low)) + j * F.lit(float(step)))
        base = base.withColumn(name, F.explode(values))
    return base
