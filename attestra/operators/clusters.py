"""As-of clusters: what an attempt's cluster looked like when the attempt was scored.

Components of the final graph never interact, so small ones are replayed in parallel, many per
task. A component with more rows than ``Skew.cluster_rows`` is cut in time: the first half of the
links is contracted with :func:`attestra.operators.graph.connected`, the second half is rewritten to
the contracted nodes, and both halves go on independently until every piece is small enough. No
piece ever depends on how large the component is.

The replay runs once and leaves a *merge forest* behind. A cluster is named after the member whose hashed id is
smallest, so its name does not depend on how the component was cut. When two clusters meet, the name that loses gets
the winner as its parent, with the time of the meeting; an identity loses once, and an identity has about
``2 ln(size)`` ancestors. Times grow towards the root, so two identities are together from

    max(time of u below their lowest common ancestor, time of v below it)

on, and any other common ancestor gives a later time. Questions about "another member that was blocked earlier" are then
minima over shared ancestors, joins and sums without a replay (:func:`linked_at`).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from attestra.operators.graph import connected
from attestra.policy import Skew
from attestra.session import durable

# t: 0 node state at the start of the piece, 1 link, 2 attempt.
_EVENTS = "comp long, rng long, seq long, t int, a long, b long, x long, y long"
# meaning of the columns   state: a=node b=size x=lowest blocked y=highest blocked, seq=kind mask
#                          link:  a, b = nodes, x = kind bit
#                          attempt: a = node, b = identity, x = 1 if it ended in BLOCK
# Answers have no parent. Forest rows: vid lost its name to ``parent`` at ``seq``; ``all_above`` if rows for all further
# ancestors are there too.
_ANSWER = ("seq long, vid long, component long, cluster_size long, kind_mask int, linked_blocked boolean, parent long,"
           " all_above boolean")


# Rows of small pieces that one call takes together, however small ``Skew.cluster_rows`` is.
_PACKED = 31_250
_NONE = -2 ** 63


def _numbered(u, v) -> tuple:
    """Each different pair as a dense number, and the two values of each number."""
    (i, first), (j, second) = pd.factorize(u), pd.factorize(v)
    pair, keys = pd.factorize(i * max(len(second), 1) + j)
    return pair, first[keys // max(len(second), 1)], second[keys % max(len(second), 1)]


def _replay(events: pd.DataFrame) -> pd.DataFrame:
    """Replay some pieces in time order, each with union-find over its own nodes.

    Only links and attempts that ended in BLOCK change anything: they are walked one by one and leave, for each root, its
    state after each change. Attempts look theirs up, all at once: up the merge forest as far as names were lost before
    the attempt, then the last state of that root before it.
    """
    e = {c: events[c].to_numpy() for c in ("comp", "rng", "seq", "t", "a", "b", "x", "y")}
    is_link, is_state = e["t"] == 1, e["t"] == 0
    piece, comps, ranges = _numbered(e["comp"], e["rng"])
    whole = ranges == 1
    nodes, home, name = _numbered(np.concatenate([piece, piece[is_link]]), np.concatenate([e["a"], e["b"][is_link]]))
    n = len(name)
    left = nodes[:len(events)]
    right = np.full(len(events), -1)
    right[is_link] = nodes[len(events):]
    place = np.empty(n, "int64")                # a name's place in the order of hashed ids
    place[np.lexsort((name, [zlib.crc32(str(v).encode()) for v in name.tolist()]))] = np.arange(n)

    size0, mask0 = np.ones(n, "int64"), np.zeros(n, "int64")
    low0, high0 = np.full(n, 2 ** 63 - 1), np.full(n, _NONE)
    at = left[is_state]
    size0[at], mask0[at] = e["b"][is_state], e["seq"][is_state]
    known = is_state & (e["y"] >= 0)
    low0[left[known]], high0[left[known]] = e["x"][known], e["y"][known]

    flow = np.flatnonzero(~is_state)
    flow = flow[np.lexsort((e["t"][flow], e["seq"][flow]))]
    steps = np.flatnonzero((e["t"][flow] == 1) | (e["x"][flow] != 0))
    parent, size, mask, low, high, rank = list(range(n)), size0.tolist(), mask0.tolist(), low0.tolist(), high0.tolist(), place.tolist()

    def find(i):
        root = i
        while parent[root] != root:
            root = parent[root]
        while parent[i] != root:
            parent[i], i = root, parent[i]
        return root

    lost, above = np.full(n, len(flow)), np.full(n, -1)         # place in the flow where a name is lost, and to whom
    states = []
    rows = flow[steps]
    for k, r, q, b, x in zip(steps.tolist(), left[rows].tolist(), right[rows].tolist(), e["b"][rows].tolist(), e["x"][rows].tolist()):
        r = find(r)
        if q >= 0:
            q = find(q)
            if q != r:
                if rank[q] < rank[r]:
                    r, q = q, r
                parent[q] = r
                lost[q], above[q] = k, r
                size[r] += size[q]
                mask[r] |= mask[q]
                low[r], high[r] = min(low[r], low[q]), max(high[r], high[q])
            mask[r] |= x
        else:
            low[r], high[r] = min(low[r], b), max(high[r], b)
        states.append((r, k, size[r], mask[r], low[r], high[r]))

    asked = np.flatnonzero(e["t"][flow] == 2)
    rows = flow[asked]
    root = left[rows]
    while (climb := lost[root] < asked).any():
        root = np.where(climb, above[root], root)
    state = np.array(states, "int64").reshape(-1, 6)
    state = state[np.lexsort((state[:, 1], state[:, 0]))]
    last = np.searchsorted(state[:, 0] * len(flow) + state[:, 1], root * len(flow) + asked) - 1
    changed = (last >= 0) & (state[last, 0] == root) if len(state) else np.zeros(len(root), bool)

    def as_of(column, start):
        out = start[root]
        out[changed] = state[last[changed], column]
        return out

    who, lowest, highest = e["b"][rows], as_of(4, low0), as_of(5, high0)
    answers = (e["seq"][rows], who, e["comp"][rows], as_of(2, size0), as_of(3, mask0),
               (highest != _NONE) & ((lowest != who) | (highest != who)), np.full(len(rows), -1), np.zeros(len(rows), bool))
    parts = [answers]
    below = np.flatnonzero(above >= 0)
    hub = below
    while len(below):           # a level of ancestors a time
        none = np.zeros(len(below), "int64")
        parts.append((e["seq"][flow[lost[hub]]], name[below], comps[home[below]], none, none, none.astype(bool),
                      name[above[hub]], whole[home[below]]))
        go = whole[home[below]] & (above[above[hub]] >= 0)
        below, hub = below[go], above[hub][go]
    columns = [np.concatenate(c) for c in zip(*parts)]
    no_parent = np.arange(len(columns[0])) < len(rows)
    columns[4] = columns[4].astype("int32")
    columns[6] = pd.arrays.IntegerArray(columns[6].astype("int64"), no_parent)
    return pd.DataFrame(dict(zip(("seq", "vid", "component", "cluster_size", "kind_mask", "linked_blocked", "parent", "all_above"), columns)))


def _split(events: DataFrame, cut: DataFrame) -> DataFrame:
    """Cut the pieces listed in ``cut`` (comp, rng, mid) in two; the rest stays as it is."""
    key = ["comp", "rng"]
    e = events.join(cut, key, "left")
    keep = e.filter("mid IS NULL").drop("mid")
    big = e.filter("mid IS NOT NULL")
    first = big.filter("t > 0 AND seq < mid")
    later = big.filter("t > 0 AND seq >= mid")
    state = big.filter("t = 0").select(*key, F.col("a").alias("node"), F.col("b").alias("size"),
                                       F.col("seq").alias("mask"), F.col("x").alias("lo"),
                                       F.col("y").alias("hi"))
    found = durable(connected(first.filter("t = 1"), "a", "b", ("comp", "rng")), "found")
    # The name of a contracted node is the one the replay of the first half arrives at.
    names = found.groupBy(*key, "root").agg(F.min_by("node", F.struct(
        F.crc32(F.col("node").cast("string").cast("binary")).alias("h"), "node")).alias("name"))
    roots = durable(found.join(names, [*key, "root"]).select(*key, "node", F.col("name").alias("root")), "contracted")

    def to_root(df: DataFrame, col: str) -> DataFrame:
        r = roots.select(*key, F.col("node").alias(col), F.col("root").alias("_r"))
        return df.join(r, [*key, col], "left").withColumn(col, F.coalesce("_r", col)).drop("_r")

    # Node state at the cut: what was known at the start of the piece plus the first half.
    members = roots.join(state, [*key, "node"], "full_outer").select(
        *key, F.coalesce("root", "node").alias("node"), F.coalesce("size", F.lit(1)).alias("size"),
        F.coalesce("mask", F.lit(0)).alias("mask"), F.when(F.col("hi") >= 0, F.col("lo")).alias("lo"),
        F.when(F.col("hi") >= 0, F.col("hi")).alias("hi"))
    bits = to_root(first.filter("t = 1").select(*key, F.col("a").alias("node"), F.col("x").alias("mask")),
                   "node").withColumn("size", F.lit(0))
    blocks = to_root(first.filter("t = 2 AND x = 1").select(
        *key, F.col("a").alias("node"), F.col("b").alias("lo"), F.col("b").alias("hi")), "node")
    touched = members.select(*key, "node").unionByName(bits.select(*key, "node")).distinct()
    # A blocked node without links or state still has the default size of one.
    alone = blocks.select(*key, "node").distinct().join(touched, [*key, "node"], "left_anti") \
                  .withColumn("size", F.lit(1))
    at_cut = (members.unionByName(bits, allowMissingColumns=True)
              .unionByName(blocks, allowMissingColumns=True)
              .unionByName(alone, allowMissingColumns=True)
              .groupBy(*key, "node").agg(
                  F.sum("size").alias("size"), F.bit_or(F.coalesce("mask", F.lit(0))).alias("mask"),
                  F.min("lo").alias("lo"), F.max("hi").alias("hi")))

    left = first.withColumn("rng", F.col("rng") * 2).drop("mid")
    moved = to_root(later, "a")
    links = to_root(moved.filter("t = 1"), "b")
    right = links.unionByName(moved.filter("t = 2")).drop("mid")

    def start(nodes: DataFrame, flow: DataFrame, child: int) -> DataFrame:
        rows = nodes.select("comp", (F.col("rng") * 2 + child).alias("rng"),
                            F.col("mask").cast("long").alias("seq"), F.lit(0).alias("t"),
                            F.col("node").alias("a"), F.col("size").cast("long").alias("b"),
                            F.coalesce("lo", F.lit(-1)).alias("x"), F.coalesce("hi", F.lit(-1)).alias("y"))
        used = flow.select("comp", "rng", "a").unionByName(
            flow.filter("t = 1").select("comp", "rng", F.col("b").alias("a"))).distinct()
        return rows.join(used, ["comp", "rng", "a"], "left_semi")

    right = right.withColumn("rng", F.col("rng") * 2 + 1)
    return durable(keep.unionByName(left).unionByName(start(state, left, 0))
                   .unionByName(right).unionByName(start(at_cut, right, 1)), "pieces")


def replay(rows: DataFrame, links: DataFrame, comps: DataFrame,
           skew: Skew = Skew(), at_most: int | None = None) -> DataFrame:
    """Answers and forest rows (see ``_ANSWER``) of the attempts of linked identities.

    ``rows`` has ``seq``, ``vid`` and ``blocked`` (did this attempt end in BLOCK); ``comps`` maps the
    linked ``vid`` to its ``component``. ``at_most`` is a known bound on rows and links together; if that fits one
    piece there is nothing to cut and nothing to look up first.
    """
    c = comps.select(F.col("vid").alias("_v"), F.col("component").alias("comp"))
    one = F.lit(1).cast("long")
    zero = F.lit(0).cast("long")
    attempts = rows.join(c, F.col("vid") == F.col("_v")).select(
        "comp", one.alias("rng"), "seq", F.lit(2).alias("t"), F.col("vid").alias("a"),
        F.col("vid").alias("b"), F.col("blocked").cast("long").alias("x"), zero.alias("y"))
    joins = links.join(c, F.col("vid") == F.col("_v")).select(
        "comp", one.alias("rng"), "seq", F.lit(1).alias("t"), F.col("vid").alias("a"),
        F.col("anchor").alias("b"), F.col("bit").cast("long").alias("x"), zero.alias("y"))
    events = attempts.unionByName(joins)
    total = at_most
    if at_most is None or at_most > skew.cluster_rows:
        events = durable(events, "events")
        total = events.count()
    if total > skew.cluster_rows:
        while True:
            sizes = (events.filter("t > 0").groupBy("comp", "rng")
                     .agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi")))
            # One attempt brings at most one row and one link per kind: it cannot be cut further.
            cut = durable(sizes.filter((F.col("n") > skew.cluster_rows) & (F.col("lo") < F.col("hi")))
                          .select("comp", "rng", F.floor((F.col("lo") + F.col("hi")) / 2 + 1)
                                  .cast("long").alias("mid")), "cut")
            if cut.isEmpty():
                break
            events = _split(events, cut)
    # Small pieces share a call, those of cut components too: the number of calls follows the rows, not the pieces.
    packs = max(16, total // max(_PACKED, skew.cluster_rows // 8))
    return (events.withColumn("pack", F.pmod(F.xxhash64("comp", "rng"), F.lit(packs))).groupBy("pack")
            .applyInPandas(lambda pdf: _replay(pdf), _ANSWER))


def replay_clusters(rows: DataFrame, links: DataFrame, comps: DataFrame,
                    skew: Skew = Skew(), at_most: int | None = None) -> DataFrame:
    """(seq, vid, component, cluster_size, kind_mask, linked_blocked) of the attempts of linked
    identities.

    Identities without links are not in the result; their cluster is themselves.
    """
    return replay(rows, links, comps, skew, at_most).filter("parent IS NULL").drop("parent", "all_above")


def ancestors(replayed: DataFrame, comps: DataFrame) -> DataFrame:
    """(vid, hub, at): every linked identity with itself and its ancestors in the merge forest; ``at`` is the last order
    number at which it was not yet below that ancestor.

    Components that were replayed in one piece bring all their rows; only cut ones are joined upwards, one round for
    each level of their forest.
    """
    own = comps.select("vid", F.col("vid").alias("hub"), F.lit(-1).cast("long").alias("at"))
    forest = replayed.filter("parent IS NOT NULL").select(
        "vid", F.col("parent").alias("hub"), (F.col("seq") - 1).alias("at"), "all_above")
    found = own.unionByName(forest.drop("all_above"))
    cut = forest.filter("NOT all_above").drop("all_above")
    step = cut.select(F.col("vid").alias("hub"), F.col("hub").alias("above"), F.col("at").alias("later"))
    frontier = cut
    while not frontier.isEmpty():
        frontier = durable(frontier.join(step, "hub").select("vid", F.col("above").alias("hub"), F.col("later").alias("at")), "above")
        found = found.unionByName(frontier)
    return found


def linked_at(hubs: DataFrame, first_blocks: DataFrame) -> DataFrame:
    """(vid, at): attempts of the identity after order number ``at`` find another identity in their cluster that was
    blocked before. ``first_blocks`` has each blocked ``vid`` with the order number ``at`` of its first BLOCK.

    Per ancestor only the two earliest members count, the second for the earliest one itself.
    """
    near = hubs.join(first_blocks.select("vid", F.col("at").alias("_b")), "vid").select(
        "hub", "vid", F.greatest("at", "_b").alias("at"))
    two = near.withColumn("n", F.row_number().over(W.partitionBy("hub").orderBy("at", "vid"))).filter("n <= 2")
    best = two.groupBy("hub").agg(
        F.max(F.when(F.col("n") == 1, F.col("vid"))).alias("who"), F.min("at").alias("one"),
        F.max(F.when(F.col("n") == 2, F.col("at"))).alias("two"))
    other = F.when(F.col("who") != F.col("vid"), F.col("one")).otherwise(F.col("two"))
    return (hubs.join(best, "hub").filter(other.isNotNull())
            .groupBy("vid").agg(F.min(F.greatest(F.col("at"), other)).alias("at")))
