"""Score attempts, with decisions feeding back into later scores.

Everything that does not depend on decisions is computed once and written out (``base``). What does depend on them is a handful
of yes/no columns (was this address, device, another member of the cluster blocked before?), so the decision of a row under
every combination of them is computed once as well, as a bit mask. Rows whose bits are equal are settled before the first
round; only *candidates*, rows that can block, are looked at again.

Decisions are a recurrence along the total order: a flag of a row says that its key was blocked before, which is one order number
for each key. Starting from "nothing is blocked", a round takes the keys whose number changed, visits the undecided rows
between the old and the new number, and reads their verdict from the mask. It ends when no verdict changes. A row depends on earlier
rows only, so the fixpoint is unique and equal to handling the rows one at a time.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestra.functions.names import name_mismatches
from attestra.functions.text import address_country, age_at
from attestra.operators import clusters, graph, model as ml, rules, score, temporal
from attestra.operators.ordering import chronological
from attestra.operators.skew import hot_values
from attestra.policy import BLOCK, Policy, Skew
from attestra.schema import ATTEMPT, KIND_BITS, conform
from attestra.session import durable

KEYS = ("ip_address", "claimed_user_ref", "device_id", "document_hash")
NARROW = ("seq", "sec", *KEYS, "login_status")

logger = logging.getLogger(__name__)


MOST_FLAGS = 6                      # verdicts of a row are one bit for each combination of flags, in one long


@dataclass
class Base:
    """Decision-free part of scoring. ``hubs`` covers linked identities only."""

    rows: DataFrame
    hubs: DataFrame | None


@dataclass
class Feedback:
    """The fixpoint: order numbers from which each key counts as blocked, and what each round looked at."""

    blocked_from: DataFrame | None              # dep, key, at
    rounds: list[tuple[int, int]]               # rows visited, verdicts changed


def ordered(attempts: DataFrame) -> DataFrame:
    """Canonical columns with ``seq``; rows that cannot be scored are left out."""
    d = conform(attempts).filter("error IS NULL AND sec IS NOT NULL")
    for c in ("ip_address", "device_id", "phone", "address", "document_hash", "claimed_user_ref"):
        d = d.withColumn(c, F.when(F.col(c) != "", F.col(c)))
    return d if "seq" in d.columns else chronological(d)


def temporal_features(log: DataFrame, policy: Policy, skew: Skew, total: int | None = None) -> DataFrame:
    """T2-T7 on narrow rows."""
    d = log.select(*NARROW)
    hot = hot_values(d, KEYS, skew, total)
    d = temporal.velocity_count(d, "ip_address", policy.velocity_seconds,
                                hot=hot["ip_address"], skew=skew)
    d = temporal.account_spread(d, policy.spread_seconds, hot=hot["ip_address"], skew=skew)
    d = temporal.failed_logins(d, policy.failed_seconds, hot=hot["claimed_user_ref"], skew=skew)
    d = temporal.device_identity_count(d, hot=hot["device_id"], skew=skew)
    return temporal.document_history(d, hot=hot["document_hash"], skew=skew)


def cluster_features(log: DataFrame, skew: Skew, total: int) -> tuple[DataFrame | None, DataFrame | None]:
    """As-of size and kinds of the attempts of linked identities, and the ancestors of these identities."""
    edges = durable(graph.identity_edges(log, KIND_BITS), "edges")
    vertices = durable(graph.edge_holders(edges), "vertices")
    links = durable(graph.identity_links(edges, vertices), "links")
    if links.isEmpty():
        return None, None
    roots = graph.connected(links, "vid", "anchor").select(
        F.col("node").alias("vid"), F.col("root").alias("component"))
    comps = durable(vertices.join(roots, "vid"), "components")
    rows = log.select("seq", F.col("claimed_user_ref").alias("identity")) \
              .join(comps.select("identity", "vid"), "identity") \
              .select("seq", "vid", F.lit(False).alias("blocked"))
    # A row, and a link for each of the four clustering kinds.
    replayed = durable(clusters.replay(rows, links, comps, skew, 5 * total), "replayed")
    return (replayed.filter("parent IS NULL").select("seq", "vid", "component", "cluster_size", "kind_mask"),
            durable(clusters.ancestors(replayed, comps), "hubs"))


def base_features(log: DataFrame, policy: Policy = Policy(), skew: Skew = Skew(),
                  extra_rules: Iterable[rules.Rule] = ()) -> Base:
    total = log.count()
    features = temporal_features(log, policy, skew, total).select(
        "seq", "velocity_ip_count", "velocity_account_spread", "failed_login_count",
        "device_identity_count", "document_reuse_count", "document_other_count")
    asof, hubs = cluster_features(log, skew, total)
    # All sides are narrow and keyed by seq: the wide rows move once.
    d = log.join(features, "seq")
    if asof is None:
        d = d.withColumns({c: F.lit(None).cast("long") for c in ("vid", "component", "cluster_size")}) \
             .withColumn("kind_mask", F.lit(0))
    else:
        d = d.join(asof, "seq", "left")
    d = d.join(name_mismatches(log, policy.name_similarity), "seq", "left")
    has_id = F.col("claimed_user_ref").isNotNull()
    d = d.withColumns({
        "cluster_identity_count": F.when(has_id, F.coalesce("cluster_size", F.lit(1)))
        .otherwise(F.lit(0)).cast("long"),
        "kind_mask": F.coalesce("kind_mask", F.lit(0)).cast("int"),
        "has_forensics": F.coalesce("has_forensics", F.lit(False)),
        "age": age_at(F.col("date_of_birth"), F.col("ts")),
        "residence_country": address_country(F.col("address"), policy.country_prefix),
        "phone_clean": F.coalesce(F.btrim("phone"), F.lit("")),
    })
    flags = F.lit(0)
    for r in rules.attribute_rules(policy):
        flags = flags + r.fired().cast("int")
    has = F.col("has_forensics")
    d = d.withColumns({
        "cluster_binding_kinds": F.bit_count("kind_mask").cast("long"),
        "attribute_flags": flags,
        "document_reuse_count": F.when(has, F.col("document_reuse_count")).otherwise(F.lit(0)),
        "metadata_flag": (has & (F.coalesce(F.size("metadata_flags"), F.lit(0)) > 0)).cast("int"),
        "liveness_failed": F.coalesce(F.col("liveness_status") == "FAIL", F.lit(False)).cast("int"),
        "credential_failed": F.coalesce(F.col("login_status") == "FAIL", F.lit(False)).cast("int"),
    }).drop("cluster_size")
    free = [r for r in rules.rule_chain(policy, extra_rules) if not r.feedback]
    d = d.withColumn("free_points", rules.points(free, policy)) \
         .withColumn("free_floor", rules.floor(free, policy))
    return Base(durable(d, "base"), hubs)


def _model_features(d: DataFrame) -> DataFrame:
    has = F.col("has_forensics")
    return d.withColumn("ela_score", F.when(has, F.bround(F.coalesce("ela_score", F.lit(0.0)), 3))
                        .otherwise(F.lit(0.0)))


def dependencies(extra_rules: Iterable[rules.Rule] = ()) -> list[rules.Earlier]:
    """The earlier decisions that rules read, built-in ones first."""
    needs = [rules.IP, rules.DEVICE, rules.CLUSTER]
    for r in extra_rules:
        if r.feedback and not r.needs:
            raise ValueError(f"{r.name} reads earlier decisions: say which in needs")
        needs += [n for n in r.needs if n not in needs]
    if len({n.name for n in needs}) < len(needs):
        raise ValueError("two dependencies have the same name")
    if len(needs) > MOST_FLAGS:
        raise ValueError(f"at most {MOST_FLAGS} dependencies on earlier decisions, built-in ones included")
    return needs


def with_feedback(rows: DataFrame, blocked_from: DataFrame | None, needs: list[rules.Earlier]) -> DataFrame:
    """T8, T9, G6 and added dependencies as of each row: a flag is set from the key's order number on."""
    for i, n in enumerate(needs):
        if blocked_from is None:
            rows = rows.withColumn(n.name, F.lit(False))
            continue
        kept = [c for c in rows.columns if c != n.name]
        at = blocked_from.filter(F.col("dep") == i).select(F.col("key").cast(rows.schema[n.key].dataType).alias(n.key), "at")
        rows = rows.join(at, n.key, "left").withColumn(n.name, F.coalesce(F.col("at") < F.col("seq"), F.lit(False))) \
                   .select(*kept, n.name)
    return rows


def scores(d: DataFrame, policy: Policy, model, extra_rules: Iterable[rules.Rule] = ()) -> DataFrame:
    """Points, probability, score and decision of rows that carry their feedback columns."""
    back = [*rules.feedback_rules(policy), *[r for r in extra_rules if r.feedback]]
    d = d.withColumn("rule_points", (F.col("free_points") + rules.points(back, policy)).cast("int")) \
         .withColumn("_floor", F.greatest("free_floor", rules.floor(back, policy)))
    if model is None:
        d = d.withColumn("ml_probability", F.lit(None).cast("double"))
    else:
        raw = d.withColumn("_ela", F.col("ela_score"))
        d = ml.fraud_probability(_model_features(raw), model) \
            .withColumn("ela_score", F.col("_ela")).drop("_ela")
    d = d.withColumn("risk_score", score.combine_score(
        F.col("rule_points"), F.col("_floor"),
        None if model is None else F.col("ml_probability"), policy))
    given = F.col("fixed_decision") if "fixed_decision" in d.columns else F.lit(None).cast("string")
    return d.withColumn("decision", F.coalesce(given, score.decide(F.col("risk_score"), policy))) \
            .drop("_floor")


def candidates(base: Base, policy: Policy, model, needs: list[rules.Earlier], extra_rules: list[rules.Rule]) -> DataFrame:
    """Rows that can end in BLOCK: ``mask`` has a bit for each combination of flags, ``settled`` if they block whatever the flags.

    Combinations with a flag that the row cannot have, for want of a key, do not count. The combinations of a row are put together
    again before anything is shuffled.
    """
    wanted = set(needs_columns(base.rows, needs, model, extra_rules))
    d = base.rows.select(*[c for c in base.rows.columns if c in wanted],
                         F.explode(F.sequence(F.lit(0), F.lit((1 << len(needs)) - 1))).alias("_f"))
    flags = {n.name: F.col("_f").bitwiseAND(1 << i) != 0 for i, n in enumerate(needs)}
    for n in needs:
        d = d.filter(~flags[n.name] | F.col(n.key).isNotNull())
    d = scores(d.withColumns(flags), policy, model, extra_rules).withColumn("_b", F.col("decision") == BLOCK)
    return d.groupBy("seq", *dict.fromkeys(n.key for n in needs)).agg(
        F.bit_or(F.expr("if(_b, shiftleft(1L, _f), 0L)")).alias("mask"), F.bool_and("_b").alias("settled"),
        F.bool_or("_b").alias("some")).filter("some").drop("some")


def needs_columns(rows: DataFrame, needs: list[rules.Earlier], model, extra_rules: list[rules.Rule]) -> list[str]:
    """Columns of ``rows`` that decide: all of them if added rules or a model may read them, else a few narrow ones."""
    if model is not None or extra_rules:
        return rows.columns
    return ["seq", *[n.key for n in needs], "free_points", "free_floor", "cluster_identity_count", "kind_mask",
            *[c for c in ("fixed_decision",) if c in rows.columns]]


def _nth_blocks(blocks: DataFrame, needs: list[rules.Earlier]) -> DataFrame:
    """(dep, key, at) from blocked rows in long form: the order number of the block that a key's rule waits for."""
    out = blocks.filter(F.col("dep").isin([i for i, n in enumerate(needs) if n.at_least == 1])) \
                .groupBy("dep", "key").agg(F.min("seq").alias("at"))
    for i, n in enumerate(needs):
        if n.at_least > 1:
            nth = blocks.filter(F.col("dep") == i).withColumn("n", F.row_number().over(W.partitionBy("dep", "key").orderBy("seq"))) \
                .filter(F.col("n") <= n.at_least).groupBy("dep", "key").agg(F.max("seq").alias("at"), F.count("*").alias("n"))
            out = out.unionByName(nth.filter(F.col("n") == n.at_least).drop("n"))
    return out


def _flagged_from(waited: DataFrame, needs: list[rules.Earlier], hubs: DataFrame | None) -> DataFrame:
    """(dep, key, at): the order number from which each key's flag is set. An identity's is set by blocks of others."""
    linked = [i for i, n in enumerate(needs) if n.at_least == 1 and n.key == "vid"]
    out = waited.filter(~F.col("dep").isin(linked))
    for i in linked if hubs is not None else []:
        own = waited.filter(F.col("dep") == i).select(F.col("key").cast("long").alias("vid"), "at")
        out = out.unionByName(clusters.linked_at(hubs, own).select(
            F.lit(i).alias("dep"), F.col("vid").cast("string").alias("key"), "at"))
    return out


def fixpoint(base: Base, policy: Policy = Policy(), model=None,
             extra_rules: Iterable[rules.Rule] = (), skew: Skew = Skew()) -> Feedback:
    """The keys' order numbers once no decision changes any more.

    Undecided rows are written once. A round keeps the verdicts of the rows it visits and corrects the order numbers of the keys
    whose rows turned; short lists of rows and keys are sent to the undecided rows, which then need no exchange.
    """
    extra_rules = list(extra_rules)
    needs = dependencies(extra_rules)
    keys = F.array(*[F.struct(F.lit(i).alias("dep"), F.col(n.key).cast("string").alias("key")) for i, n in enumerate(needs)])
    rows = durable(candidates(base, policy, model, needs, extra_rules).select("seq", "mask", "settled", F.explode(keys).alias("k"))
                   .select("seq", "mask", "settled", "k.dep", "k.key").filter("key IS NOT NULL"), "candidates")
    # Settled rows are summed up once; a key needs no more of their blocks than its rule counts.
    open_rows = rows.filter("NOT settled").drop("settled")
    most = max(n.at_least for n in needs)
    fixed = rows.filter("settled").select("seq", "dep", "key")
    if most == 1:
        fixed = fixed.groupBy("dep", "key").agg(F.min("seq").alias("seq"))
    else:
        fixed = fixed.withColumn("n", F.row_number().over(W.partitionBy("dep", "key").orderBy("seq"))) \
                     .filter(F.col("n") <= most).drop("n")
    fixed = durable(fixed, "settled")
    at_first = F.col("mask").bitwiseAND(1) != 0
    waited = durable(_nth_blocks(fixed.select("seq", "dep", "key").unionByName(
        open_rows.filter(at_first).select("seq", "dep", "key")), needs), "waited")
    rounds: list[tuple[int, int]] = []
    before = verdicts = None            # verdicts: of the rows visited so far
    far = F.lit(2 ** 63 - 1)

    def listed(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= skew.broadcast_values else df

    while True:                     # each round settles at least the next row, so this ends
        now = durable(_flagged_from(waited, needs, base.hubs), "blocked")
        if before is None:
            found = open_rows.join(now, ["dep", "key"]).filter("at < seq")
        else:
            changed = durable(now.join(before.withColumnRenamed("at", "was"), ["dep", "key"], "full_outer").filter("NOT at <=> was").select(
                "dep", "key", F.least(F.coalesce("at", far), F.coalesce("was", far)).alias("low"),
                F.greatest(F.coalesce("at", far), F.coalesce("was", far)).alias("high")), "changed")
            touched = durable(open_rows.join(listed(changed, changed.count()), ["dep", "key"]).filter("seq > low AND seq <= high")
                              .select("seq").distinct(), "touched")
            touched = listed(touched, touched.count())
            found = open_rows.join(touched, "seq", "left_semi").join(now, ["dep", "key"], "left")
        seen = found.groupBy("seq").agg(
            F.bit_or(F.expr("if(at < seq, shiftleft(1, dep), 0)")).alias("flags"), F.first("mask").alias("mask")).select(
                "seq", at_first.alias("was"), F.expr("(shiftright(mask, flags) & 1) = 1").alias("verdict"))
        if verdicts is not None:
            last = verdicts.join(touched, "seq", "left_semi").select("seq", F.col("verdict").alias("last"))
            seen = seen.join(last, "seq", "left").withColumn("was", F.coalesce("last", "was")).drop("last")
        seen = durable(seen, "seen")
        turned = seen.filter("verdict <> was").select("seq", "verdict")
        n, moved, freed = seen.agg(F.count("*"), F.count_if(F.expr("verdict <> was")), F.count_if(F.expr("was AND NOT verdict"))).first()
        rounds.append((n, moved))
        logger.info("round %d: %d rows visited, %d verdicts changed", len(rounds), *rounds[-1])
        if not moved:
            return Feedback(now, rounds)
        before, seen = now, seen.drop("was")
        verdicts = seen if verdicts is None else durable(
            verdicts.join(listed(seen.select("seq"), n), "seq", "left_anti").unionByName(seen), "verdicts")
        turned = durable(open_rows.join(listed(turned, moved), "seq").select("dep", "key", "seq", "verdict"), "turned")
        redo = None
        if most > 1:
            redo = turned
        else:                       # a new block only brings numbers down; one taken back asks for the next
            waited = waited.unionByName(turned.filter("verdict").select("dep", "key", F.col("seq").alias("at"))) \
                           .groupBy("dep", "key").agg(F.min("at").alias("at"))
            if freed:
                redo = turned.filter("NOT verdict")
        if redo is not None:
            redo = durable(redo.select("dep", "key").distinct(), "redo")
            redo = listed(redo, redo.count())
            mine = open_rows.join(redo, ["dep", "key"], "left_semi").join(verdicts, "seq", "left").filter(
                F.coalesce("verdict", at_first)).select("seq", "dep", "key")
            mine = mine.unionByName(fixed.select("seq", "dep", "key").join(redo, ["dep", "key"], "left_semi"))
            waited = waited.join(redo, ["dep", "key"], "left_anti").unionByName(_nth_blocks(mine, needs))
        waited = durable(waited, "waited")


def score_ordered(log: DataFrame, policy: Policy = Policy(), model=None, skew: Skew = Skew(),
                  extra_rules: Iterable[rules.Rule] = ()) -> DataFrame:
    """Score rows that already have ``seq``. One output row per input row."""
    extra_rules = list(extra_rules)
    needs = dependencies(extra_rules)
    base = base_features(log, policy, skew, extra_rules)
    found = fixpoint(base, policy, model, extra_rules, skew)
    keys = list(dict.fromkeys(n.key for n in needs))
    flags = with_feedback(base.rows.select("seq", *keys), found.blocked_from, needs)
    d = base.rows.join(flags.drop(*keys), "seq")
    d = scores(d, policy, model, extra_rules)
    # Who presented a document before does not depend on decisions: the feedback joins stay out of this.
    reused = base.rows.filter("has_forensics AND document_other_count > 0").select(
        "seq", "document_hash", "claimed_user_ref")
    named = temporal.document_other_names(reused, temporal.first_presenters(
        base.rows.join(reused.select("document_hash").distinct(), "document_hash", "left_semi"))) \
        .select("seq", "document_other_names")
    d = d.join(named, "seq", "left")
    chain = rules.rule_chain(policy, extra_rules)
    if model is not None:
        d = d.withColumn("ml_drivers", ml.drivers_text(ml.contributors(model)))
        chain.append(rules.model_rule())
    d = d.withColumn("reasons", rules.reasons(chain, policy))
    d = _model_features(d.withColumn("_ela", F.col("ela_score"))) \
        .withColumn("features", score.feature_struct()).withColumn("ela_score", F.col("_ela"))
    extra = [c for c in log.columns if c not in ATTEMPT.names and c != "seq"]
    return d.select(
        "seq", *ATTEMPT.names, *extra, "features", "reasons", "rule_points", "ml_probability",
        "risk_score", "decision", F.col("decision").alias("initial_decision"))


def score_attempts(attempts: DataFrame, policy: Policy = Policy(), model=None, skew: Skew = Skew(),
                   extra_rules: Iterable[rules.Rule] = ()) -> DataFrame:
    """C5 on canonical (or partly filled) attempts, scored in event-time order."""
    return score_ordered(ordered(attempts), policy, model, skew, extra_rules)
