"""Identity graph as tables: edges, links, connected components and reports on them.

Vertices are identities. An attribute held by several identities is stored as links from each
later holder to the first one, which keeps the graph linear in the data: no pair list, no member
list of a shared attribute is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attestra.functions.text import mask_pii, opaque_id, short_label
from attestra.policy import BLOCK
from attestra.schema import KIND_BITS, LINK_KINDS, STRONG_KINDS, UNCLUSTERED_KINDS
from attestra.session import durable


def identity_edges(attempts: DataFrame, kinds: Iterable[str] = LINK_KINDS) -> DataFrame:
    """G1: distinct (identity, kind, value) with the first attempt that showed it."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value"))
                      for k in kinds])
    return (attempts.filter("claimed_user_ref IS NOT NULL AND claimed_user_ref <> ''")
            .select(F.col("claimed_user_ref").alias("identity"), "seq",
                    F.explode(pairs).alias("e"))
            .filter("e.value IS NOT NULL AND e.value <> ''")
            .groupBy("identity", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"))
            .agg(F.min("seq").alias("first_seq")))


def identities(attempts: DataFrame) -> DataFrame:
    """Each identity with its vertex id: the order number of its first attempt."""
    return (attempts.filter("claimed_user_ref IS NOT NULL AND claimed_user_ref <> ''")
            .groupBy(F.col("claimed_user_ref").alias("identity")).agg(F.min("seq").alias("vid")))


def edge_holders(edges: DataFrame) -> DataFrame:
    """Like :func:`identities`, but only those with edges and without another pass over the attempts.

    The vertex id is the identity's first attempt with an edge, which is just as unique.
    """
    return edges.groupBy("identity").agg(F.min("first_seq").alias("vid"))


def identity_links(edges: DataFrame, vertices: DataFrame,
                   exclude: Iterable[str] = UNCLUSTERED_KINDS) -> DataFrame:
    """Links (vid, anchor, seq, bit): this identity joined an attribute ``anchor`` already held.

    ``anchor`` is the attribute's first holder. As of any moment the links so far connect exactly
    the identities that the bipartite graph connects, and each link makes its kind binding.
    """
    held = (edges.filter(~F.col("kind").isin(*exclude)).join(vertices, "identity")
            .select("kind", "value", "vid", "first_seq"))
    anchors = (held.groupBy("kind", "value")
               .agg(F.min_by("vid", "first_seq").alias("anchor"), F.count("*").alias("degree"))
               .filter("degree > 1").drop("degree"))
    bit = F.lit(0)
    for kind in LINK_KINDS:
        bit = F.when(F.col("kind") == kind, KIND_BITS.get(kind, 0)).otherwise(bit)
    return (held.join(anchors, ["kind", "value"]).filter("vid <> anchor")
            .select("vid", "anchor", F.col("first_seq").alias("seq"), bit.alias("bit")))


def connected(pairs: DataFrame, a: str, b: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """Smallest reachable node for every node with a link (``node``, ``root``), within ``scope``.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each round is two
    map-side-combined minima and two joins on them, so a star of any size is fine, and the number of
    rounds grows with the logarithm of the component size. Every round is written out.
    """
    s = list(scope)
    edges = durable(
        pairs.select(*s, F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(*s, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*s, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, [*s, "u"]).filter("v > u").select(
            *s, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(*s, "u").agg(F.min("v").alias("m"))
        near = large.join(low, [*s, "u"])
        small = (near.filter("v <> m").select(*s, F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select(*s, "u", F.col("m").alias("v"))).distinct())
        edges = durable(small, "links")
        several = edges.groupBy(*s, "u").count().filter("count > 1").select(*s, "u")
        chained = edges.select(*s, F.col("v").alias("u")).join(edges.select(*s, "u"), [*s, "u"],
                                                               "left_semi")
        if several.unionByName(chained).isEmpty():
            break
    roots = edges.select(*s, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(*s, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def components(edges: DataFrame, vertices: DataFrame,
               exclude: Iterable[str] = UNCLUSTERED_KINDS,
               links: DataFrame | None = None) -> DataFrame:
    """Identity -> component (vertex id of its oldest member); unlinked ones stand alone.

    Pass ``exclude=()`` to let a shared IP connect as well.
    """
    links = identity_links(edges, vertices, exclude) if links is None else links
    roots = connected(links, "vid", "anchor").select(
        F.col("node").alias("vid"), F.col("root").alias("component"))
    return vertices.join(roots, "vid", "left").select(
        "identity", "vid", F.coalesce("component", "vid").alias("component"))


def attribute_degree(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Identities per attribute value. Edges are distinct, so this is a plain count."""
    e = edges if kind is None else edges.filter(F.col("kind") == kind)
    return e.groupBy("kind", "value").agg(F.count("*").alias("identities"))


def shared_attributes(edges: DataFrame) -> DataFrame:
    """Each identity's attributes that someone else holds too, with the number of others.

    The others themselves are :func:`shared_with`; listing them here for every holder would be
    quadratic in the size of the group.
    """
    shared = attribute_degree(edges).filter("identities > 1")
    return edges.join(shared, ["kind", "value"]).select(
        "identity", F.col("kind").alias("attribute"), "value",
        (F.col("identities") - 1).alias("others"))


def shared_with(edges: DataFrame, identity: str) -> DataFrame:
    """G3/J8 for one identity: (attribute, value, other) rows."""
    mine = edges.filter(F.col("identity") == identity).select("kind", "value")
    return (edges.filter(F.col("identity") != identity).join(mine, ["kind", "value"], "left_semi")
            .select(F.col("kind").alias("attribute"), "value", F.col("identity").alias("other"))
            .orderBy("attribute", "value", "other"))


def binding_kinds(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """The kinds of non-IP attribute that at least two members of the component share."""
    shared = (attribute_degree(edges).filter("identities > 1")
              .filter(~F.col("kind").isin(*UNCLUSTERED_KINDS)).select("kind", "value"))
    bound = (edges.join(shared, ["kind", "value"], "left_semi")
             .join(comps.select("identity", "component"), "identity")
             .select("component", "kind").distinct())
    return bound.groupBy("component").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def blocked_identities(attempts: DataFrame) -> DataFrame:
    """G11."""
    return (attempts.filter((F.col("decision") == BLOCK) & F.col("claimed_user_ref").isNotNull())
            .select(F.col("claimed_user_ref").alias("identity")).distinct())


def strength(kind: Column) -> Column:
    return F.when(kind.isin(*STRONG_KINDS), F.lit("strong")).otherwise(F.lit("weak"))


def link_summary(edges: DataFrame, identity: str | None = None) -> DataFrame:
    """Shared non-IP attributes, their strength and how many others hold them."""
    s = shared_attributes(edges).filter(~F.col("attribute").isin(*UNCLUSTERED_KINDS))
    if identity is not None:
        s = s.filter(F.col("identity") == identity)
    return s.select("identity", "attribute", strength(F.col("attribute")).alias("strength"),
                    F.col("others").alias("identity_count"))


def cluster_subgraph(edges: DataFrame, comps: DataFrame, identity: str | None = None,
                     limit: int = 180, key: str = "", blocked: DataFrame | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one cluster (or of everything), the focus first, at most ``limit`` nodes.

    In a cluster view an attribute is drawn only if it is not an IP and at least two identities hold
    it. Phone and address labels are masked. ``truncated`` tells whether nodes were left out.
    """
    if identity is not None:
        mine = comps.filter(F.col("identity") == identity).select("component")
        members = comps.join(mine, "component", "left_semi").select("identity")
        drawn = (attribute_degree(edges).filter("identities > 1")
                 .filter(~F.col("kind").isin(*UNCLUSTERED_KINDS)).select("kind", "value"))
        seen = edges.join(members, "identity", "left_semi").join(drawn, ["kind", "value"], "left_semi")
    else:
        members, seen = comps.select("identity"), edges
    people = members.select(F.lit("identity").alias("kind"), F.col("identity").alias("value"))
    nodes = people.unionByName(seen.select("kind", "value").distinct()).withColumn(
        "focus", (F.col("kind") == "identity") & F.coalesce(
            F.col("value") == F.lit(identity), F.lit(False)))
    is_person = F.col("kind") == "identity"
    order = [F.col("focus").desc(), is_person.asc(), F.col("kind").asc(), F.col("value").asc()]
    shown = nodes.orderBy(*order).limit(limit + 1)
    ranked = shown.withColumn("position", F.row_number().over(W.orderBy(*order)).cast("long")) \
                  .withColumn("truncated", F.count("*").over(W.partitionBy(F.lit(1))) > limit) \
                  .filter(F.col("position") <= limit)
    node_id = opaque_id(F.col("kind"), F.col("value"), key)
    label = F.when(F.col("kind").isin("phone", "address"), mask_pii(F.col("value"), 2, key)) \
             .otherwise(short_label(F.col("kind"), F.col("value")))
    out = ranked.withColumn("id", node_id).withColumn("label", label)
    if blocked is None:
        out = out.withColumn("blocked", F.lit(False))
    else:
        marks = blocked.select(F.lit("identity").alias("kind"), F.col("identity").alias("value"),
                               F.lit(True).alias("blocked")).distinct()
        out = out.join(marks, ["kind", "value"], "left").withColumn(
            "blocked", F.coalesce("blocked", F.lit(False)))
    kept = ranked.select("kind", "value")
    ends = (seen.join(kept, ["kind", "value"], "left_semi")
            .join(kept.filter("kind = 'identity'").select(F.col("value").alias("identity")),
                  "identity", "left_semi"))
    links = ends.select(opaque_id(F.lit("identity"), F.col("identity"), key).alias("from"),
                        opaque_id(F.col("kind"), F.col("value"), key).alias("to"))
    return out.select("position", "id", "label", F.col("kind").alias("group"), "blocked", "focus",
                      "truncated"), links
