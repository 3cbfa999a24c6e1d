"""Evaluation metrics (M1-M11, F4). Undefined ratios are NULL except in M5, where they are 0.0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestra.operators.ordering import dense_rank_in_order
from attestra.operators.temporal import campaign_detection
from attestra.policy import DECISIONS, FALLBACK_ANOMALY_THRESHOLD
from attestra.session import durable


def _fraud() -> Column:
    return F.col("label_is_fraud")


def _legit() -> Column:
    return ~F.col("label_is_fraud")


def _challenged() -> Column:
    return F.col("decision") != "ALLOW"


def _ratio(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def labelled(results: DataFrame) -> DataFrame:
    """F4."""
    return results.filter((F.col("status") == "OK") & F.col("label_is_fraud").isNotNull())


def record_counts(results: DataFrame) -> DataFrame:
    """M11."""
    ok = F.col("status") == "OK"
    return results.agg(
        F.count("*").alias("records"), F.count_if(ok).alias("valid_records"),
        F.count_if(F.col("status") == "ERROR").alias("invalid_records"),
        F.count_if(ok & F.col("label_is_fraud").isNotNull()).alias("labeled_records"))


def classification_metrics(results: DataFrame) -> DataFrame:
    """M1: one row, or none when nothing is labelled. Positive means challenged or blocked."""
    c = labelled(results).agg(
        F.count("*").alias("labeled_records"),
        F.count_if(_fraud() & _challenged()).alias("tp"), F.count_if(_fraud() & ~_challenged()).alias("fn"),
        F.count_if(_legit() & ~_challenged()).alias("tn"), F.count_if(_legit() & _challenged()).alias("fp"),
        F.count_if(_legit() & (F.col("decision") == "BLOCK")).alias("lb"),
        F.count_if(_legit() & (F.col("decision") == "STEP_UP")).alias("ls"))
    c = c.filter("labeled_records > 0").select(
        "*", _ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        _ratio("tp", F.col("tp") + F.col("fn")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    legit, fraud = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    return c.select(
        "labeled_records", _ratio(F.col("tp") + F.col("tn"), "labeled_records").alias("accuracy"),
        "precision", "recall",
        F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).alias("f1"),
        _ratio("fp", legit).alias("false_positive_rate"), _ratio("fn", fraud).alias("false_negative_rate"),
        _ratio("lb", legit).alias("legitimate_block_rate"),
        _ratio("ls", legit).alias("legitimate_step_up_rate"),
        _ratio("tp", fraud).alias("attack_detection_rate"))


def detection_by_type(results: DataFrame) -> DataFrame:
    """M2."""
    return (labelled(results).filter(_fraud())
            .groupBy(F.coalesce("label_category", F.lit("UNKNOWN")).alias("category"))
            .agg(F.count("*").alias("total"), F.count_if(_challenged()).alias("detected"))
            .withColumn("detection_rate", _ratio("detected", "total")))


def auc(scores: DataFrame, label: str, value: str) -> DataFrame:
    """Exact Mann-Whitney area, ties counting one half; NULL unless both classes occur.

    Rows are first summed per distinct value. The running count of negatives over the values is a
    distributed prefix sum, so it does not matter how many distinct values there are.
    """
    per = (scores.filter(F.col(label).isNotNull() & F.col(value).isNotNull())
           .groupBy(F.col(value).alias("v"))
           .agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")))
    ranked = dense_rank_in_order(per, [F.col("v").asc()], "below", weight=F.col("neg"))
    s = ranked.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"),
                   F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(_ratio("u", F.col("p") * F.col("n")).alias("roc_auc"))


def roc_auc(results: DataFrame) -> DataFrame:
    """M3: on the model probability where there is one, else on the score."""
    d = labelled(results).select("label_is_fraud", F.coalesce(
        "fraud_probability", F.col("risk_score") / 100.0).alias("value"))
    return auc(d, "label_is_fraud", "value")


def confusion_matrix(pred: DataFrame, labels: list[str] | None = None, actual: str = "label",
                     predicted: str = "prediction") -> DataFrame:
    """M4: (actual, predicted, count) with zeros for the pairs of known labels that do not occur."""
    counts = pred.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")) \
                 .agg(F.count("*").alias("count"))
    if labels is None:
        known = counts.select(F.col("actual").alias("l")).unionByName(
            counts.select(F.col("predicted").alias("l"))).filter("l IS NOT NULL").distinct()
        names = known.agg(F.array_sort(F.collect_set("l")).alias("ls"))
    else:
        names = pred.sparkSession.range(1).select(F.array(*[F.lit(x) for x in labels]).alias("ls"))
    grid = names.select(F.explode("ls").alias("actual"), "ls").select(
        "actual", F.explode("ls").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def per_class(confusion: DataFrame) -> DataFrame:
    """M5."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)).alias("tp")
    rows = confusion.groupBy(F.col("actual").alias("label")).agg(hit, F.sum("count").alias("support"))
    cols = confusion.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("called"))
    d = rows.join(cols, "label", "left").select(
        "label", "support", F.coalesce(_ratio("tp", "called"), F.lit(0.0)).alias("precision"),
        F.coalesce(_ratio("tp", "support"), F.lit(0.0)).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return d.select("label", "precision", "recall",
                    F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def engine_rates(breakdown: DataFrame) -> DataFrame:
    """M6 from the scenario x initial decision counts."""
    legit = F.col("scenario") == "LEGITIMATE"

    def total(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0))

    s = breakdown.agg(
        total(legit).alias("l"), total(~legit).alias("a"),
        total(legit & (F.col("decision") == "BLOCK")).alias("lb"),
        total(legit & (F.col("decision") == "STEP_UP")).alias("ls"),
        total(~legit & F.col("decision").isin("STEP_UP", "BLOCK")).alias("hit"))
    return s.select(_ratio("lb", "l").alias("legitimate_block_rate"),
                    _ratio("ls", "l").alias("legitimate_step_up_rate"),
                    _ratio("hit", "a").alias("attack_detection_rate"))


def decision_quality(results: DataFrame) -> DataFrame:
    """M7: detection and hard blocking of attacks, friction and harm for legitimate rows."""
    d = results.filter(F.col("status") == "OK")
    s = d.agg(F.count_if(_fraud()).alias("a"), F.count_if(_legit()).alias("l"),
              F.count_if(_fraud() & F.col("decision").isin("STEP_UP", "BLOCK")).alias("hit"),
              F.count_if(_fraud() & (F.col("decision") == "BLOCK")).alias("hard"),
              F.count_if(_legit() & (F.col("decision") == "STEP_UP")).alias("friction"),
              F.count_if(_legit() & (F.col("decision") == "BLOCK")).alias("harm"))
    return s.select(_ratio("hit", "a").alias("attack_detection_rate"),
                    _ratio("hard", "a").alias("attack_hard_block_rate"),
                    _ratio("friction", "l").alias("legitimate_friction_rate"),
                    _ratio("harm", "l").alias("legitimate_harm_rate"))


def decision_mix(results: DataFrame) -> DataFrame:
    """Decision counts overall, of legitimate and of attack rows, in one aggregation.

    Unlabelled rows count only in ``overall``.
    """
    groups = F.array_compact(F.array(
        F.lit("overall"), F.when(_fraud(), F.lit("attack")).when(_legit(), F.lit("legitimate"))))
    return (results.filter(F.col("status") == "OK")
            .select(F.explode(groups).alias("group"), "decision").groupBy("group")
            .agg(*[F.count_if(F.col("decision") == x).alias(x) for x in DECISIONS]))


def medians(df: DataFrame, columns: list[str], bins: int = 1024) -> dict[str, float | None]:
    """Exact medians of numeric columns by refining histograms, without a sort.

    One aggregate counts ``bins`` equal bins between the smallest and the largest value of each column, with the extremes of
    every bin. The bin that holds the middle is cut again, until the middle is the end of a bin or all values of its bin
    are equal; what reaches the driver is one row for each bin. NULL, NaN and infinite values are left out.
    """
    d = df.select(*[F.when(F.abs(F.col(c).cast("double")) < math.inf, F.col(c).cast("double")).alias(f"c{i}")
                    for i, c in enumerate(columns)])
    ends = d.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    out: dict[str, float | None] = {c: None for c in columns}
    open_ = {}                                  # column: (smallest, largest, values below, positions wanted)
    for i, c in enumerate(columns):
        n = ends[f"n{i}"]
        if n and ends[f"a{i}"] == ends[f"b{i}"]:
            out[c] = ends[f"a{i}"]
        elif n:
            open_[i] = ends[f"a{i}"], ends[f"b{i}"], 0, ((n - 1) // 2, n // 2)

    def cell(v: Column, a: float, b: float) -> Column:
        s = 0.5 if math.isinf(b - a) else 1.0
        return F.least(F.lit(bins - 1), F.floor((v * s - a * s) / (b * s - a * s) * bins))

    while open_:
        cells = F.array_compact(F.array(*[F.when(F.col(f"c{i}").between(a, b), F.struct(
            F.lit(i).alias("c"), cell(F.col(f"c{i}"), a, b).alias("bin"), F.col(f"c{i}").alias("v")))
            for i, (a, b, *_) in open_.items()]))
        found = d.select(F.explode(cells).alias("e")).groupBy("e.c", "e.bin").agg(
            F.count("*").alias("n"), F.min("e.v").alias("low"), F.max("e.v").alias("high")).orderBy("c", "bin").collect()
        for i in list(open_):
            *_, below, wanted = open_.pop(i)
            values, inner = [], None
            for r in (r for r in found if r["c"] == i):
                for w in wanted:
                    at = w - below
                    if 0 <= at < r["n"]:
                        edge = r["low"] if at == 0 else r["high"] if at == r["n"] - 1 else None
                        if r["low"] == r["high"]:
                            edge = r["low"]
                        values.append(edge)
                        if edge is None:
                            inner = r["low"], r["high"], below, wanted
                below += r["n"]
            if inner is None:
                out[columns[i]] = sum(values) / 2
            else:
                open_[i] = inner
    return out


def campaign_metrics(results: DataFrame) -> DataFrame:
    """M8."""
    t = campaign_detection(results.filter((F.col("status") == "OK") & (F.col("campaign_id") != "")))
    t = durable(t, "campaigns")
    middle = medians(t, ["position", "seconds"])
    s = t.agg(F.count("*").alias("campaigns_total"), F.count_if("detected").alias("campaigns_detected")) \
         .withColumns({"median_events_to_detection": F.lit(middle["position"]).cast("double"),
                       "median_seconds_to_detection": F.lit(middle["seconds"]).cast("double")})
    return s.select("campaigns_total", "campaigns_detected",
                    _ratio("campaigns_detected", "campaigns_total").alias("campaign_detection_rate"),
                    "median_events_to_detection", "median_seconds_to_detection")


def full_report(results: DataFrame) -> DataFrame:
    """M1, M2, M3, M7, M8, M11 and A7 as one nested row."""

    def row(df: DataFrame) -> Column:
        return F.struct(*[F.col(c) for c in df.columns])

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(1).alias("_k"), row(df).alias(name))

    by_type = detection_by_type(results).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("category", "detection_rate")))).alias("m"))
    mix = decision_mix(results).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("group", F.struct(*DECISIONS))))).alias("m"))
    parts = [one(record_counts(results), "record_counts"),
             one(classification_metrics(results), "row_metrics"),
             by_type.select(F.lit(1).alias("_k"), F.col("m").alias("per_attack_type_detection")),
             roc_auc(results).select(F.lit(1).alias("_k"), "roc_auc"),
             mix.select(F.lit(1).alias("_k"), F.col("m").alias("decision_breakdown")),
             one(decision_quality(results), "decision_quality")]
    if "campaign_id" in results.columns:
        parts.append(one(campaign_metrics(results), "campaign_metrics"))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), "_k", "left")  # each side is one row
    return out.drop("_k")


def candidate_thresholds() -> list[float]:
    """0.0, 0.1, ... 40.0 by repeated addition, which decides the exact comparison values."""
    out, c = [], 0.0
    while c <= 40.0:
        out.append(c)
        c += 0.1
    return out


def calibrate_threshold(scores: DataFrame, value: str = "ela_score", tampered: str = "tampered",
                        default: float = FALLBACK_ANOMALY_THRESHOLD) -> DataFrame:
    """The candidate with the best balanced accuracy, the lowest one on a tie.

    Each row falls in one of about 400 bins between candidates; the sweep then runs over bins.
    NULL scores are ignored; if a class is missing the default comes back with NULL accuracy.
    """
    cand = candidate_thresholds()
    cs = F.array(*[F.lit(c) for c in cand])
    guess = F.greatest(F.lit(0), F.least(F.lit(len(cand) - 1), F.floor(F.col(value) * 10).cast("int")))

    def at_or_below(i: Column) -> Column:
        inside = (i >= 0) & (i < len(cand))
        return (inside & (F.try_element_at(cs, i + 1) <= F.col(value))).cast("int")

    # Candidates at or below the value: all below the guess, then a look at its neighbours.
    bin_no = (F.greatest(guess - 1, F.lit(0)) + F.when(guess >= 1, at_or_below(guess - 1)).otherwise(0)
              + at_or_below(guess) + at_or_below(guess + 1))
    d = scores.filter(F.col(value).isNotNull() & F.col(tampered).isNotNull())
    bins = d.groupBy(bin_no.alias("bin")).agg(
        F.count_if(~F.col(tampered)).alias("clean"), F.count_if(F.col(tampered)).alias("bad"))
    totals = d.agg(F.count_if(~F.col(tampered)).alias("n_clean"), F.count_if(F.col(tampered)).alias("n_tampered"),
                   F.round(F.avg(F.when(~F.col(tampered), F.col(value))), 3).alias("clean_mean"),
                   F.round(F.avg(F.when(F.col(tampered), F.col(value))), 3).alias("tampered_mean"))
    grid = scores.sparkSession.range(len(cand) + 1).select(F.col("id").cast("int").alias("bin"))
    # 402 bins at most, so these windows are over a constant number of rows.
    swept = grid.join(bins, "bin", "left").select(
        "bin", F.coalesce(F.sum("clean").over(W.orderBy("bin")), F.lit(0)).alias("tn"),
        F.coalesce(F.sum("bad").over(W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("tp"))
    both = swept.filter(F.col("bin") < len(cand)).withColumn("_k", F.lit(1)) \
        .join(F.broadcast(totals.withColumn("_k", F.lit(1))), "_k")
    scored = both.withColumn("acc", (F.try_divide("tn", F.col("n_clean").cast("double"))
                                     + F.try_divide("tp", F.col("n_tampered").cast("double"))) / 2)
    best = scored.agg(F.max_by(F.struct("bin", "acc"), F.struct("acc", -F.col("bin"))).alias("b"),
                      F.first("n_clean").alias("n_clean"), F.first("n_tampered").alias("n_tampered"),
                      F.first("clean_mean").alias("clean_mean"),
                      F.first("tampered_mean").alias("tampered_mean"))
    usable = F.col("b.acc") > 0
    return best.select(
        F.when(usable, F.round(F.element_at(cs, F.col("b.bin") + 1), 2)).otherwise(F.lit(default))
        .alias("threshold"),
        F.round("b.acc", 4).alias("balanced_accuracy"), "n_clean", "n_tampered", "clean_mean",
        "tampered_mean")


def evaluate_model(predictions: DataFrame, breakdown: DataFrame, labels: list[str],
                   legitimate: str = "LEGITIMATE") -> dict[str, DataFrame]:
    """Accuracy and AUC, confusion matrix, per-class figures and engine rates.

    ``predictions`` has ``label``, ``prediction`` and ``ml_probability``.
    """
    confusion = confusion_matrix(predictions, labels)
    fraud = predictions.select((F.col("label") != legitimate).alias("f"), "ml_probability")
    area = auc(fraud, "f", "ml_probability")
    summary = predictions.agg(
        F.count("*").alias("n_test"),
        _ratio(F.count_if(F.col("label") == F.col("prediction")), F.count("*")).alias("accuracy")) \
        .withColumn("_k", F.lit(1)).join(F.broadcast(area.withColumn("_k", F.lit(1))), "_k").drop("_k") \
        .withColumnRenamed("roc_auc", "fraud_vs_legitimate_auc")
    return {"summary": summary, "confusion": confusion, "per_class": per_class(confusion),
            "engine": engine_rates(breakdown)}
