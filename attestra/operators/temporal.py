"""As-of operators: what earlier attempts say about each attempt.

Every function takes a frame with ``seq`` (total order) and ``sec`` (second of the attempt) and
returns it with new columns; the caller passes narrow frames. ``hot`` is the key's hot list from
:func:`attestra.operators.skew.hot_values`. Without hot keys each operator is one exchange on its
key. Hot keys are split into blocks of the total order: window work stays inside a block, and what
earlier blocks contribute arrives through pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestra.operators.skew import hot_values, slotted
from attestra.policy import BLOCK, Skew
from attestra.session import durable

_PAST = (W.unboundedPreceding, -1)


def _hot(df: DataFrame, key: str, hot, skew: Skew) -> DataFrame | None:
    return hot_values(df, [key], skew)[key] if hot == "find" else hot


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def sums_before(totals: DataFrame, group: list[str], at: str, values: list[str], width: int) -> DataFrame:
    """Replace each value by its sum over the rows of the group with a smaller ``at``.

    ``totals`` has one row for each group and ``at``. No window holds more than ``width`` of them: sums inside
    blocks of ``width`` places come first, and what stands before a block is the same question about the
    blocks' totals, again in blocks, for as many levels as the span of ``at`` needs.
    """
    totals = durable(totals, "totals")
    low, high = totals.agg(F.min(at), F.max(at)).first()
    return _levels(totals, group, at, values, width, low or 0, (high or 0) - (low or 0) + 1)


def _levels(totals: DataFrame, group: list[str], at: str, values: list[str], width: int, low: int, span: int) -> DataFrame:
    def running(d, window):
        return d.select(*[c for c in d.columns if c not in values],
                        *[_zero(F.sum(v).over(window.orderBy(at).rowsBetween(*_PAST))).alias(v) for v in values])

    if span <= width:
        return running(totals, W.partitionBy(*group))
    block = f"_{at}_of"
    d = totals.withColumn(block, F.floor((F.col(at) - low) / width).cast("long"))
    blocks = d.groupBy(*group, block).agg(*[F.sum(v).alias(v) for v in values])
    before = _levels(blocks, group, block, values, width, 0, -(-span // width))
    before = before.select(*group, block, *[F.col(v).alias(f"_b{v}") for v in values])
    return running(d, W.partitionBy(*group, block)).join(before, [*group, block]).select(
        *[c for c in totals.columns if c not in values], *[(F.col(v) + F.col(f"_b{v}")).alias(v) for v in values])


def carried(marks: DataFrame, key: str, skew: Skew) -> DataFrame:
    """What a hot key's earlier blocks contribute to each (second, slot): openings of earlier seconds, less closings
    up to this second, plus openings of the same second in lower slots.

    ``marks``: key, ``sec``, ``_slot``, ``_up``, ``_down``; closings have negative slots and get no row.
    """
    marks = durable(marks, "marks")
    each = marks.groupBy(key, "sec").agg(F.sum("_up").alias("_up"), F.sum("_down").alias("_down")) \
        .withColumn("_own", F.col("_down"))
    seconds = sums_before(each, [key], "sec", ["_up", "_down"], skew.block_rows).select(
        key, "sec", (F.col("_up") - F.col("_down") - F.col("_own")).alias("_carry"))
    slots = sums_before(marks.filter("_slot >= 0").groupBy(key, "sec", "_slot").agg(F.sum("_up").alias("_up")),
                        [key, "sec"], "_slot", ["_up"], skew.block_rows)
    return slots.join(seconds, [key, "sec"]).select(key, "sec", "_slot", (F.col("_up") + F.col("_carry")).alias("_carry"))


def trailing_count(df: DataFrame, key: str, seconds: int, out: str, where: Column | None = None,
                   hot="find", skew: Skew = Skew(), weight: Column | None = None) -> DataFrame:
    """Earlier rows of the same key with ``sec - seconds <= t <= sec``; with ``weight`` their summed weight.

    That is all earlier rows in the total order less those older than the window, so ties inside a
    second are exact. Both are running sums over one sort by (key, sec, seq). Zero where key or second
    is missing.
    """
    hot = _hot(df, key, hot, skew)
    missing = F.col(key).isNull() | F.col("sec").isNull()
    d = slotted(df, key, hot, skew, missing)
    each = F.lit(1) if weight is None else _zero(weight)
    d = d.withColumn("_f", each if where is None else F.when(where, each).otherwise(F.lit(0)))
    group = W.partitionBy(key, "_slot")
    # Two steps on purpose: the finer order is sorted for first and serves the coarser one as well.
    d = d.withColumn("_before", _zero(F.sum("_f").over(group.orderBy("sec", "seq").rowsBetween(*_PAST))))
    d = d.withColumn("_older", _zero(F.sum("_f").over(
        group.orderBy("sec").rangeBetween(W.unboundedPreceding, -seconds - 1))))
    if hot is None:
        d = d.withColumn(out, F.col("_before") - F.col("_older"))
    else:
        peers = _zero(F.sum("_f").over(
            W.partitionBy(key, "_slot", "sec").orderBy("seq").rowsBetween(*_PAST)))
        # A row enters its window at its own second and leaves it ``seconds + 1`` later.
        counted = (d.filter(F.col("_hot") & ~missing).groupBy(key, "sec", "_slot").agg(F.sum("_f").alias("_up"))
                   .withColumn("_down", F.lit(0).cast("long")))
        gone = counted.filter(F.col("_up") > 0).groupBy(key, (F.col("sec") + seconds + 1).alias("sec")).agg(
            F.lit(-1).cast("long").alias("_slot"), F.lit(0).cast("long").alias("_up"), F.sum("_up").alias("_down"))
        carry = carried(counted.unionByName(gone), key, skew)
        d = (d.withColumn("_p", peers).join(carry, [key, "sec", "_slot"], "left")
             .withColumn(out, F.when(F.col("_hot"), F.col("_p") + _zero(F.col("_carry")))
                         .otherwise(F.col("_before") - F.col("_older")))
             .drop("_p", "_carry"))
    return d.withColumn(out, F.when(missing, F.lit(0)).otherwise(F.col(out)).cast("long")) \
            .drop("_hot", "_slot", "_f", "_before", "_older")


def velocity_count(df: DataFrame, key: str = "ip_address", seconds: int = 60,
                   out: str = "velocity_ip_count", hot="find", skew: Skew = Skew()) -> DataFrame:
    """T2."""
    return trailing_count(df, key, seconds, out, None, hot, skew)


def failed_logins(df: DataFrame, seconds: int = 300, out: str = "failed_login_count",
                  key: str = "claimed_user_ref", ip: str = "ip_address",
                  hot="find", skew: Skew = Skew()) -> DataFrame:
    """T4: earlier failed logins of the identity; looked at only when the attempt has an IP."""
    d = trailing_count(df, key, seconds, out, F.col("login_status") == "FAIL", hot, skew)
    return d.withColumn(out, F.when(F.col(ip).isNotNull(), F.col(out)).otherwise(F.lit(0)))


def account_spread(df: DataFrame, seconds: int = 300, out: str = "velocity_account_spread",
                   key: str = "ip_address", identity: str = "claimed_user_ref",
                   hot="find", skew: Skew = Skew()) -> DataFrame:
    """Distinct identities among the earlier rows of the key in the trailing window.

    An (address, identity) pair is *open* from its first row until ``seconds`` after a row that no
    other row of the pair follows in time. The answer is the number of open pairs, so it is openings
    minus closings before the row: a running sum in place of a distinct count over a sliding frame.
    """
    hot = _hot(df, key, hot, skew)
    missing = F.col(key).isNull() | F.col("sec").isNull()
    seen = (df.filter(~missing & F.col(identity).isNotNull())
            .groupBy(key, identity, "sec").agg(F.min("seq").alias("seq")))
    pair = W.partitionBy(key, identity).orderBy("sec")
    opens = F.coalesce(F.col("sec") - F.lag("sec").over(pair) > seconds, F.lit(True))
    closes = F.coalesce(F.lead("sec").over(pair) - F.col("sec") > seconds, F.lit(True))
    # _k orders rows of one instant: closings (0), the attempt itself (1), openings (2).
    marks = seen.select(key, "sec", "seq", opens.alias("_o"), closes.alias("_c")).select(
        key, F.explode(F.array(
            F.when(F.col("_o"), F.struct(F.col("sec").alias("sec"), F.col("seq").alias("seq"),
                                         F.lit(2).alias("_k"), F.lit(1).alias("_d"))),
            F.when(F.col("_c"), F.struct((F.col("sec") + seconds + 1).alias("sec"),
                                         F.lit(-1).cast("long").alias("seq"),
                                         F.lit(0).alias("_k"), F.lit(-1).alias("_d"))))).alias("m")
    ).filter("m IS NOT NULL").select(key, "m.*")
    stream = df.withColumn("_k", F.lit(1)).withColumn("_d", F.lit(0)) \
               .unionByName(marks, allowMissingColumns=True)
    d = slotted(stream, key, hot, skew, missing)
    if hot is not None:     # closings have no place in the order: a hot key's go to slots by time
        d = d.withColumn("_slot", F.when(F.col("_hot") & ~missing & (F.col("_k") == 0),
                                         -1 - F.floor(F.col("sec") / (seconds + 1)).cast("long")).otherwise(F.col("_slot")))
    running = _zero(F.sum("_d").over(
        W.partitionBy(key, "_slot").orderBy("sec", "seq", "_k").rowsBetween(*_PAST)))
    if hot is None:
        d = d.withColumn(out, running)
    else:
        same_second = _zero(F.sum(F.when(F.col("_d") > 0, F.col("_d"))).over(
            W.partitionBy(key, "_slot", "sec").orderBy("seq", "_k").rowsBetween(*_PAST)))
        per_block = (d.filter(F.col("_hot") & ~missing).groupBy(key, "sec", "_slot")
                     .agg(F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).alias("_up"),
                          F.sum(F.when(F.col("_d") < 0, 1).otherwise(0)).alias("_down")))
        carry = carried(per_block, key, skew)
        d = (d.withColumn("_r", running).withColumn("_s", same_second)
             .filter(F.col("_k") == 1)
             .join(carry, [key, "sec", "_slot"], "left")
             .withColumn(out, F.when(F.col("_hot"), F.col("_s") + _zero(F.col("_carry")))
                         .otherwise(F.col("_r")))
             .drop("_r", "_s", "_carry"))
    return d.filter(F.col("_k") == 1) \
            .withColumn(out, F.when(missing, F.lit(0)).otherwise(F.col(out)).cast("long")) \
            .drop("_hot", "_slot", "_k", "_d").select(*df.columns, out)


def distinct_so_far(df: DataFrame, key: str, member: str, out: str, inclusive: bool,
                    first: str | None = None, hot="find", skew: Skew = Skew()) -> DataFrame:
    """Distinct non-null members of the key up to this row (with or without it).

    A member counts at its first row only, so the distinct count is a running sum of first-row
    marks. ``first`` names a column to keep the mark in.
    """
    hot = _hot(df, key, hot, skew)
    d = slotted(df, key, hot, skew)
    real = F.col(key).isNotNull() & F.col(member).isNotNull()
    if hot is None:
        d = d.repartition(key, "_slot")
    rank = F.row_number().over(W.partitionBy(key, "_slot", member).orderBy("seq"))
    d = d.withColumn("_first", F.when(real & (rank == 1), 1).otherwise(0))
    if hot is not None:
        firsts = (df.join(hot.select(key), key, "left_semi").filter(real).groupBy(key, member)
                  .agg(F.min("seq").alias("seq")).select(key, "seq"))
        d = d.join(firsts.select("seq", F.lit(1).alias("_global")), "seq", "left").withColumn(
            "_first", F.when(F.col("_hot"), F.coalesce("_global", F.lit(0)))
            .otherwise(F.col("_first"))).drop("_global")
    frame = (W.unboundedPreceding, 0 if inclusive else -1)
    d = d.withColumn(out, _zero(F.sum("_first").over(
        W.partitionBy(key, "_slot").orderBy("seq").rowsBetween(*frame))))
    if hot is not None:
        carry = firsts.groupBy(
            key, F.floor(F.col("seq") / skew.block_rows).cast("long").alias("_slot")).count()
        slots = d.filter("_hot").groupBy(key, "_slot").count().select(key, "_slot")
        carry = sums_before(slots.join(carry, [key, "_slot"], "left").select(key, "_slot", _zero(F.col("count")).alias("_carry")),
                            [key], "_slot", ["_carry"], skew.block_rows)
        d = d.join(carry, [key, "_slot"], "left").withColumn(
            out, F.col(out) + _zero(F.col("_carry"))).drop("_carry")
    d = d.withColumn(out, F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.col(out)).cast("long"))
    if first:
        d = d.withColumn(first, F.col("_first") == 1)
    return d.drop("_hot", "_slot", "_first").select(*df.columns, out, *([first] if first else []))


def device_identity_count(df: DataFrame, hot="find", skew: Skew = Skew()) -> DataFrame:
    """T5: identities seen on the device, this attempt's own included."""
    return distinct_so_far(df, "device_id", "claimed_user_ref", "device_identity_count", True,
                           hot=hot, skew=skew)


def document_history(df: DataFrame, hot="find", skew: Skew = Skew()) -> DataFrame:
    """Identities that presented this document before, and how many were others."""
    d = distinct_so_far(df, "document_hash", "claimed_user_ref", "document_reuse_count", False,
                        first="_new", hot=hot, skew=skew)
    others = F.col("document_reuse_count") - F.when(F.col("_new"), 0).otherwise(1)
    return d.withColumn(
        "document_other_count",
        F.when(F.col("document_hash").isNotNull() & F.col("claimed_user_ref").isNotNull(), others)
        .otherwise(F.lit(0)).cast("long")).drop("_new")


def first_presenters(df: DataFrame, keep: int = 4) -> DataFrame:
    """The first ``keep`` identities of each document, oldest first (bounded state per document).

    ``keep`` is one more than the names shown, since one of them may be the reader.
    """
    firsts = (df.filter("document_hash IS NOT NULL AND claimed_user_ref IS NOT NULL")
              .groupBy("document_hash", "claimed_user_ref").agg(F.min("seq").alias("seq")))
    ranked = firsts.withColumn("_n", F.row_number().over(
        W.partitionBy("document_hash").orderBy("seq"))).filter(F.col("_n") <= keep)
    return ranked.groupBy("document_hash").agg(F.array_sort(F.collect_list(
        F.struct(F.col("seq"), F.col("claimed_user_ref").alias("ref")))).alias("presenters"))


def document_other_names(df: DataFrame, presenters: DataFrame) -> DataFrame:
    """T7 names: up to three other identities that came first, in order of appearance."""
    d = df.join(presenters, "document_hash", "left")
    names = F.transform(F.slice(F.filter(
        F.col("presenters"),
        lambda p: (p["seq"] < F.col("seq")) & (p["ref"] != F.col("claimed_user_ref"))), 1, 3),
        lambda p: p["ref"])
    return d.withColumn("document_other_names", names).drop("presenters").select(
        *df.columns, "document_other_names")


def flagged(df: DataFrame, decisions: DataFrame, key: str, out: str) -> DataFrame:
    """Did an earlier attempt with this key end in BLOCK?

    Only the first block of a key matters, so history shrinks to one pre-aggregated row per
    blocked key. ``decisions`` carries ``seq``, ``key`` and ``decision``.
    """
    first = (decisions.filter((F.col("decision") == BLOCK) & F.col(key).isNotNull())
             .groupBy(key).agg(F.min("seq").alias("_blocked_at")))
    return df.join(first, key, "left").withColumn(
        out, F.coalesce(F.col("_blocked_at") < F.col("seq"), F.lit(False))
    ).drop("_blocked_at").select(*[c for c in df.columns if c != out], out)


def ip_flagged(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """T8."""
    return flagged(df, decisions, "ip_address", "ip_flagged")


def device_flagged(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """T9."""
    return flagged(df, decisions, "device_id", "device_flagged")


def reputation_table(decisions: DataFrame, key: str) -> DataFrame:
    """First block and number of blocks of each flagged key."""
    return (decisions.filter((F.col("decision") == BLOCK) & F.col(key).isNotNull())
            .groupBy(key).agg(F.min("seq").alias("first_seq"), F.count("*").alias("hit_count"))
            .withColumn("reason", F.lit("produced a blocked attempt")))


def campaign_detection(df: DataFrame, campaign: str = "campaign_id", ts: str = "ts",
                       tie: str = "record_id") -> DataFrame:
    """Per campaign the position and delay of its first challenged or blocked event.

    Untimed events come first. Two map-side-combined aggregations; a campaign is never gathered.
    """
    when = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 62)))
    d = df.filter(F.col(campaign).isNotNull()).select(
        campaign, F.col(ts).cast("timestamp").alias("_ts"), "decision",
        F.struct(when.alias("t"), F.col(tie).alias("r")).alias("_at"))
    heads = d.groupBy(campaign).agg(
        F.min("_at").alias("_first"),
        F.min_by("_ts", "_at").alias("_first_ts"),
        F.min(F.when(F.col("decision") != "ALLOW", F.col("_at"))).alias("_hit"),
        F.min_by("_ts", F.when(F.col("decision") != "ALLOW", F.col("_at"))).alias("_hit_ts"))
    reached = d.select(campaign, "_at").join(
        heads.filter("_hit IS NOT NULL").select(campaign, "_hit"), campaign) \
        .filter(F.col("_at") <= F.col("_hit")).groupBy(campaign).agg(F.count("*").alias("position"))
    return heads.join(reached, campaign, "left").select(
        campaign, F.col("_hit").isNotNull().alias("detected"), "position",
        (F.unix_micros("_hit_ts") - F.unix_micros("_first_ts")).cast("double").__truediv__(1e6)
        .alias("seconds"))
