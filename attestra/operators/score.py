"""Score, decision and the columns derived from reasons."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from attestra.policy import ALLOW, BLOCK, STEP_UP, Policy
from attestra.schema import FEATURES


def feature_struct() -> Column:
    """The 15 features as doubles in fixed order, 0 where nothing is known."""
    return F.struct(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in FEATURES])


def rule_points(reasons: Column) -> Column:
    """C2."""
    return F.aggregate(reasons, F.lit(0), lambda a, r: a + r["points"])


def combine_score(points: Column, floor: Column, probability: Column | None,
                  policy: Policy = Policy()) -> Column:
    """Blend, floors, half-even rounding, clip to 0..100."""
    plain = points.cast("double")
    if probability is not None:
        blend = policy.rule_weight * points + policy.model_weight * probability * 100.0
        plain = F.when(probability.isNull(), plain).otherwise(blend)
    raw = F.greatest(plain, floor.cast("double"))
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw, 0).cast("int"))).cast("int")


def floor_of(reasons: Column, policy: Policy = Policy()) -> Column:
    """Highest floor among the rules named in a reason array."""
    out = F.lit(0)
    for rule, low in policy.floors.items():
        out = F.greatest(out, F.when(F.exists(reasons, lambda r: r["rule"] == rule), low).otherwise(0))
    return out


def decide(score: Column, policy: Policy = Policy()) -> Column:
    """C4."""
    return (F.when(score >= policy.block_score, F.lit(BLOCK))
            .when(score >= policy.step_up_score, F.lit(STEP_UP)).otherwise(F.lit(ALLOW)))


def classify_attack(reasons: Column, decision: Column, policy: Policy = Policy()) -> Column:
    """The category whose rules scored most; earlier categories win ties."""
    sums = {name: F.aggregate(F.filter(reasons, lambda r: r["rule"].isin(*rules)),
                              F.lit(0), lambda a, r: a + r["points"])
            for name, rules in policy.attack_rules.items()}
    best = F.greatest(*sums.values())
    out = (F.when(decision == ALLOW, F.lit("LEGITIMATE"))
           .when(decision.isin(STEP_UP, BLOCK), F.lit("SUSPICIOUS")).otherwise(F.lit("UNKNOWN")))
    for name in reversed(list(sums)):
        out = F.when((best > 0) & (sums[name] == best), F.lit(name)).otherwise(out)
    return out


def ranked_reasons(reasons: Column) -> Column:
    """K2: by points, highest first; equal points keep the order in which rules fired."""
    keyed = F.transform(reasons, lambda r, i: F.struct(
        (-r["points"]).alias("p"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda k: k["r"])


def top_reasons(reasons: Column, n: int = 3) -> Column:
    """K3."""
    return F.array_join(F.transform(F.slice(ranked_reasons(reasons), 1, n), lambda r: r["rule"]), ";")
