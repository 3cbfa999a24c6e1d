"""Random-forest layer on Spark ML."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestra.operators.forest import Forest, fraud_share
from attestra.schema import FEATURES
from attestra.session import durable

LEGITIMATE = "LEGITIMATE"
INSTANCES = 32          # equal rows that a forest resamples one by one


def training_matrix(rows: DataFrame) -> DataFrame:
    """L1: 15 doubles and the label. ``features`` is JSON text or a struct; unreadable or empty
    feature sets are left out."""
    if dict(rows.dtypes)["features"] == "string":
        m = F.from_json("features", "map<string,double>")
        # Exploded, so that the filter does not parse the text again (a filter on a plain column moves below it).
        d = rows.select("scenario", F.explode(F.array(m)).alias("_m")).filter("size(_m) > 0")
        cols = [F.coalesce(F.try_element_at("_m", F.lit(n)), F.lit(0.0)).alias(n) for n in FEATURES]
    else:
        d = rows.filter("features IS NOT NULL")
        cols = [F.coalesce(F.col(f"features.{n}").cast("double"), F.lit(0.0)).alias(n) for n in FEATURES]
    return d.select(*cols, F.col("scenario").alias("label"))


def class_weights(matrix: DataFrame) -> dict[str, tuple[int, float]]:
    """Rows and balanced weight of each label."""
    counts = {r["label"]: r["count"] for r in matrix.groupBy("label").count().collect()}
    n = sum(counts.values())
    return {label: (c, n / (len(counts) * c)) for label, c in sorted(counts.items())}


def instances(matrix: DataFrame, most: int = INSTANCES) -> DataFrame:
    """The rows a forest is trained on: the matrix with ``n``, the number of equal rows that an instance stands for.

    Up to ``most`` equal rows are an instance each. More of them are dealt out evenly to ``most`` instances: every row counts with
    its full weight, and only the resampling of a tree takes rows of such a vector in handfuls. Spark keeps a number for
    each instance and tree, and sends each instance down every tree once for each level, so this bounds both by the different vectors.
    """
    d = matrix.groupBy(*FEATURES, "label").agg(F.count("*").alias("_all")) \
              .withColumn("_shares", F.least("_all", F.lit(most)))
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_shares")))
    return spread(d.select(*FEATURES, "label", (F.col("_all") / F.col("_shares")).alias("n")), "instances")


def spread(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in as many pieces as there are cores: few bytes, but much work for each row."""
    return durable(df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism)), name)


def by_vector(df: DataFrame, answers) -> DataFrame:
    """The columns that ``answers`` adds to a frame of feature vectors, added to ``df``: each different vector is asked once."""
    asked = spread(df.select(*FEATURES).distinct(), "vectors")
    told = durable(answers(asked), "answers")
    new = [c for c in told.columns if c not in FEATURES]
    told = told.select(*[F.col(n).alias(f"_v_{n}") for n in FEATURES], *new)
    same = [F.col(n).eqNullSafe(F.col(f"_v_{n}")) for n in FEATURES]
    return df.join(told, same).select(*df.columns, *new)


def train_model(matrix: DataFrame, seed: int = 42, trees: int = 200, min_rows: int = 50
                ) -> PipelineModel:
    """L2: forest with balanced class weights, over :func:`instances`. The class counts are the only thing collected."""
    weights = class_weights(matrix)
    if sum(n for n, _ in weights.values()) < min_rows or len(weights) < 2:
        raise ValueError("Need at least 50 labelled attempts and two classes.")
    weight = F.lit(None).cast("double")
    for label, (_, w) in weights.items():
        weight = F.when(F.col("label") == label, w).otherwise(weight)
    stages = [
        StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=FEATURES, outputCol="vector"),
        RandomForestClassifier(
            labelCol="label_index", featuresCol="vector", weightCol="weight", numTrees=trees,
            minInstancesPerNode=2, maxDepth=15, featureSubsetStrategy="sqrt", seed=seed),
    ]
    rows = instances(matrix)
    indexer = stages[0].fit(rows)
    return Pipeline(stages=[indexer, *stages[1:]]).fit(rows.withColumn("weight", weight * F.col("n")))


def _parts(model: PipelineModel) -> tuple[StringIndexerModel, VectorAssembler,
                                          RandomForestClassificationModel]:
    return model.stages[0], model.stages[1], model.stages[2]


def model_labels(model: PipelineModel) -> list[str]:
    return list(_parts(model)[0].labels)


def fraud_probability(df: DataFrame, model: PipelineModel | Forest | None,
                      out: str = "ml_probability") -> DataFrame:
    """L3: 1 - P(LEGITIMATE), or the highest class probability if there is no such class."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    if isinstance(model, Forest):
        return df.withColumn(out, fraud_share(model))
    _, assembler, forest = _parts(model)
    labels = model_labels(model)
    scored = forest.transform(assembler.transform(
        df.withColumns({f"_m_{n}": F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in FEATURES})
        .withColumnsRenamed({n: f"_k_{n}" for n in FEATURES})
        .withColumnsRenamed({f"_m_{n}": n for n in FEATURES})))
    p = vector_to_array("probability")
    value = (1.0 - p[labels.index(LEGITIMATE)] if LEGITIMATE in labels
             else F.array_max(F.slice(p, 1, len(labels))))
    back = scored.withColumn(out, value).drop(*FEATURES) \
                 .withColumnsRenamed({f"_k_{n}": n for n in FEATURES})
    return back.select(*df.columns, out)


def predicted_label(df: DataFrame, model: PipelineModel, out: str = "prediction") -> DataFrame:
    _, assembler, forest = _parts(model)
    labels = F.array(*[F.lit(x) for x in model_labels(model)])
    scored = forest.transform(assembler.transform(df))
    best = F.element_at(labels, F.least(F.col("prediction"), F.lit(len(model_labels(model)) - 1.0))
                        .cast("int") + 1)
    return scored.withColumn("_p", best).select(*df.columns, F.col("_p").alias(out))


def contributors(model: PipelineModel | Forest | None, top: int = 5) -> Column:
    """L4: features present in the attempt by importance x value, highest first."""
    kind = "array<struct<name:string,weight:double>>"
    if model is None:
        return F.array().cast(kind)
    weights = (list(model.importances) if isinstance(model, Forest)
               else _parts(model)[2].featureImportances.toArray().tolist())
    pairs = F.array(*[
        F.struct((-F.lit(w) * F.coalesce(F.col(n).cast("double"), F.lit(0.0))).alias("w"),
                 F.lit(i).alias("i"), F.lit(n).alias("name"),
                 (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) > 0).alias("on"))
        for i, (n, w) in enumerate(zip(FEATURES, weights))])
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["on"])), 1, top)
    return F.transform(best, lambda p: F.struct(p["name"].alias("name"), (-p["w"]).alias("weight")))


def drivers_text(contrib: Column, n: int = 3) -> Column:
    return F.array_join(F.transform(F.slice(contrib, 1, n),
                                    lambda c: F.replace(c["name"], F.lit("_"), F.lit(" "))), ", ")


def feature_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """One row per feature (15)."""
    w = _parts(model)[2].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(FEATURES, w)), "feature string, importance double")


def save_model(model: PipelineModel, path: str) -> None:
    """L6."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | None:
    """None when nothing usable is stored there, and scoring goes on with rules only."""
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # noqa: BLE001 - a broken model must not stop scoring
        if isinstance(exc, (KeyboardInterrupt, SystemExit)):
            raise
        return None


def assert_disjoint(train: DataFrame, held_out: DataFrame, key: str = "document_hash") -> None:
    """Fail if training and evaluation share a document."""
    both = held_out.filter(F.col(key).isNotNull()).select(key).join(
        train.filter(F.col(key).isNotNull()).select(key), key, "left_semi")
    if not both.isEmpty():
        raise ValueError("Evaluation documents overlap training documents.")


__all__ = ["training_matrix", "instances", "by_vector", "train_model", "model_labels", "fraud_probability", "predicted_label",
           "contributors", "drivers_text", "feature_importances", "save_model", "load_model",
           "assert_disjoint"]
