"""Knowledge graph per project (G1-G5) without materialising cliques.

Edges of the matched graph, one per unordered pair, first writer wins:
explicit link (1.0) > shared tag (0.7, reason ``shared_tag:<first tag>``) >
same type in the project (0.4).  Tag groups and type groups are cliques, so
pairs are never listed; instead, per node u with tag set T(u) and group g(u):

* U(u)  = |union of tag groups of u|         (u included)
* Ug(u) = |union of tag groups of u within g(u)|
* both depend on the tag set alone, so nodes are first counted per (tag set, type);
  a project's most frequent tags are bits of a mask, and sets that share one are counted over masks; sets
  that share only other tags meet at the least of them, once, and their counts are
  summed.  Nodes never meet nodes: a tag set that a million nodes carry is one row.

Then, with P = explicit pairs (materialised; they come from data links):

* degree(u) = |P(u)| + (U(u)-1) - |P(u) sharing a tag|
              + (n_g(u)-1) - (Ug(u)-1) - |P(u) in g(u) not sharing a tag|
* shared_tag edges = sum (U-1)/2 - |P sharing a tag|
* same_type edges  = sum C(n_g, 2) - sum (Ug-1)/2 - |P in one group not sharing a tag|
* components: every group is a clique, so groups are super-nodes joined by a
  shared tag or an explicit link; min-label propagation runs on super-nodes
  with a checkpoint per round, until no label changes.

The summary works on a narrow copy of the nodes without texts, written once.

Self-loops (repeated tag, self link) are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from .conflicts import order_key


def nodes(mem: DataFrame) -> DataFrame:
    """Approved memories as nodes; tags de-duplicated keeping first occurrence."""
    return (mem.filter(F.col("approved"))
            .select("project", "id", "type", "summary", "source", "confidence", "created_at",
                    F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"),
                    F.coalesce("related_to", F.array().cast("array<bigint>")).alias("related_to"))
            .withColumn("ord", order_key()))


def narrow(nd: DataFrame) -> DataFrame:
    """What the counts need of the nodes, written once: no texts."""
    return nd.select("project", "id", "type", "tags", "related_to", "ord").checkpoint()


def explicit_pairs(nd: DataFrame) -> DataFrame:
    """Distinct explicit pairs (project, src < dst) whose ends are both nodes of the project,
    with share (any common tag) and same (same type) flags."""
    ids = nd.select("project", F.col("id").alias("b"))
    links = (nd.select("project", F.col("id").alias("a"), F.explode("related_to").alias("b"))
             .join(ids, ["project", "b"], "left_semi").filter(F.col("a") != F.col("b")))
    pairs = links.select("project", F.least("a", "b").alias("src"),
                         F.greatest("a", "b").alias("dst")).distinct()
    s = nd.select("project", F.col("id").alias("src"), F.col("type").alias("ts"), F.col("tags").alias("gs"))
    d = nd.select("project", F.col("id").alias("dst"), F.col("type").alias("td"), F.col("tags").alias("gd"))
    return (pairs.join(s, ["project", "src"]).join(d, ["project", "dst"])
            .select("project", "src", "dst", F.arrays_overlap("gs", "gd").alias("share"),
                    (F.col("ts") == F.col("td")).alias("same"), F.col("ts"), F.col("td")))


HEAVY_TAGS, HEAVY_SETS = 10, 32


def _masked(sets: DataFrame) -> DataFrame:
    """Tag sets (project, tags) with ``mask``, a bit for each heavy tag, and ``light``, the others in order.

    Heavy are a project's ``HEAVY_TAGS`` most frequent tags, where more than ``HEAVY_SETS`` distinct sets hold them."""
    each = sets.select("project", "tags", F.explode("tags").alias("t"))
    by_sets = Window.partitionBy("project").orderBy(F.col("sets").desc(), "t")
    heavy = (each.groupBy("project", "t").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > HEAVY_SETS)
             .withColumn("bit", F.row_number().over(by_sets)).where(F.col("bit") <= HEAVY_TAGS)
             .select("project", "t", F.expr("shiftleft(1, bit - 1)").alias("bit")))
    masks = (each.join(heavy, ["project", "t"]).groupBy("project", "tags")
             .agg(F.sum("bit").cast("int").alias("mask"), F.collect_set("t").alias("_h")))
    return sets.join(masks, ["project", "tags"], "left").select(
        "project", "tags", F.coalesce("mask", F.lit(0)).alias("mask"),
        F.array_except("tags", F.coalesce("_h", F.array().cast("array<string>"))).alias("light"))


def _light_meetings(masked: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of tag sets that share a light tag and no heavy one, once each way: (project, tags, otype, n)."""
    left = masked.select("project", "tags", "mask", "light", F.explode("light").alias("t"))
    right = sets.join(masked, ["project", "tags"]).select(
        "project", F.col("mask").alias("omask"), F.col("light").alias("other"), F.col("type").alias("otype"), "n",
        F.explode("light").alias("t"))
    return (left.join(right, ["project", "t"]).where(F.col("mask").bitwiseAND(F.col("omask")) == 0)
            .filter(F.col("t") == F.element_at(F.array_intersect("light", "other"), 1))     # sorted: the least one
            .select("project", "tags", "otype", "n"))


def tag_union_sizes(nd: DataFrame) -> DataFrame:
    """(project, id, U, Ug) for every node (1, 1 when it has no tags): the nodes, and those of its type, that share a tag.

    Nodes that share a heavy tag are counted over masks, at most 2 ** ``HEAVY_TAGS`` of them in a project; only tag sets that
    share nothing but light tags meet one another."""
    tagged = nd.select("project", "id", "type", F.array_sort("tags").alias("tags"))
    sets = (tagged.filter(F.size("tags") > 0).groupBy("project", "tags", "type").agg(F.count(F.lit(1)).alias("n")).checkpoint())
    masked = _masked(sets.select("project", "tags").distinct()).checkpoint()
    by_mask = (sets.join(masked, ["project", "tags"]).where("mask <> 0")
               .groupBy("project", "mask", F.col("type").alias("otype")).agg(F.sum("n").alias("n")))
    asked = by_mask.select("project", F.col("mask").alias("ask")).distinct()
    over = (asked.join(by_mask, "project").where(F.col("ask").bitwiseAND(F.col("mask")) != 0)
            .groupBy("project", F.col("ask").alias("mask"), "otype").agg(F.sum("n").alias("n")))
    heavy = masked.join(over, ["project", "mask"]).select("project", "tags", "otype", "n")
    met = _light_meetings(masked, sets).unionByName(heavy).groupBy("project", "tags", "otype").agg(F.sum("n").alias("m"))
    whole = met.groupBy("project", "tags").agg(F.sum("m").alias("U"))
    inner = met.select("project", "tags", F.col("otype").alias("type"), F.col("m").alias("Ug"))
    sizes = sets.join(whole, ["project", "tags"]).join(inner, ["project", "tags", "type"]).select(
        "project", "tags", "type", "U", "Ug")
    return (tagged.join(sizes, ["project", "tags", "type"], "left")
            .select("project", "id", F.coalesce("U", F.lit(1)).cast("bigint").alias("U"),
                    F.coalesce("Ug", F.lit(1)).cast("bigint").alias("Ug")))


def degrees(nd: DataFrame, pairs: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(project, id, degree, type, ord) per node."""
    pairs = explicit_pairs(nd) if pairs is None else pairs
    sizes = tag_union_sizes(nd) if sizes is None else sizes
    ends = pairs.select("project", F.col("src").alias("id"), "share", "same").unionByName(
        pairs.select("project", F.col("dst").alias("id"), "share", "same"))
    ex = ends.groupBy("project", "id").agg(
        F.count(F.lit(1)).alias("ex"), F.count_if("share").alias("ex_tag"),
        F.count_if(F.col("same") & ~F.col("share")).alias("ex_grp"))
    ng = nd.groupBy("project", "type").agg(F.count(F.lit(1)).alias("n_g"))
    d = (nd.select("project", "id", "type", "ord")
         .join(ng, ["project", "type"]).join(sizes, ["project", "id"])
         .join(ex, ["project", "id"], "left").fillna(0, ["ex", "ex_tag", "ex_grp"]))
    deg = (F.col("ex") + (F.col("U") - 1) - F.col("ex_tag")
           + (F.col("n_g") - 1) - (F.col("Ug") - 1) - F.col("ex_grp"))
    return d.select("project", "id", "type", "ord", deg.cast("bigint").alias("degree"))


def edge_counts(nd: DataFrame, pairs: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(project, explicit, shared_tag, same_type)."""
    pairs = explicit_pairs(nd) if pairs is None else pairs
    sizes = tag_union_sizes(nd) if sizes is None else sizes
    p = pairs.groupBy("project").agg(
        F.count(F.lit(1)).alias("explicit"), F.count_if("share").alias("p_tag"),
        F.count_if(F.col("same") & ~F.col("share")).alias("p_grp"))
    s = sizes.groupBy("project").agg((F.sum(F.col("U") - 1) / 2).cast("bigint").alias("tag_pairs"),
                                     (F.sum(F.col("Ug") - 1) / 2).cast("bigint").alias("tag_pairs_g"))
    g = (nd.groupBy("project", "type").agg(F.count(F.lit(1)).alias("n"))
         .groupBy("project").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("grp_pairs")))
    out = (nd.select("project").distinct().join(g, "project").join(s, "project", "left")
           .join(p, "project", "left").fillna(0, ["explicit", "p_tag", "p_grp", "tag_pairs", "tag_pairs_g"]))
    return out.select("project", F.col("explicit").cast("bigint").alias("explicit"),
                      (F.col("tag_pairs") - F.col("p_tag")).cast("bigint").alias("shared_tag"),
                      (F.col("grp_pairs") - F.col("tag_pairs_g") - F.col("p_grp")).cast("bigint").alias("same_type"))


def group_components(nd: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(project, type, label, n_g): connected super-nodes share a label."""
    pairs = explicit_pairs(nd) if pairs is None else pairs
    groups = nd.groupBy("project", "type").agg(F.count(F.lit(1)).alias("n_g"))
    tag_groups = nd.select("project", "type", F.explode("tags").alias("t")).distinct()
    hub = tag_groups.groupBy("project", "t").agg(F.min("type").alias("hub"))
    e_tag = tag_groups.join(hub, ["project", "t"]).select("project", F.col("type").alias("a"),
                                                          F.col("hub").alias("b"))
    e_ex = pairs.select("project", F.col("ts").alias("a"), F.col("td").alias("b"))
    e = e_tag.unionByName(e_ex).filter(F.col("a") != F.col("b")).distinct()
    roots = stars(e)
    return (groups.join(roots.select("project", F.col("a").alias("type"), F.col("b").alias("_root")),
                        ["project", "type"], "left")
            .select("project", "type", F.coalesce("_root", "type").alias("label"), "n_g"))


def stars(edges: DataFrame) -> DataFrame:
    """Edges (project, a, b) contracted to stars: (project, a, b), each a linked to b, its component's least node.

    Rounds of two star steps: every node hands its larger neighbours to the least node around it,
    then its smaller ones.  Paths halve in each round, so that rounds grow with the logarithm of
    the longest one.  A round is one checkpoint and two small checks; least neighbours are partial
    minima, and the rows of a hub meet its one minimum by a join that can be split."""
    def least(e, of, others):
        return e.groupBy("project", of).agg(F.min(others).alias("m"))

    low = (edges.select("project", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
           .filter(F.col("a") != F.col("b")).distinct().checkpoint())
    while True:
        both = low.unionByName(low.select("project", F.col("b").alias("a"), F.col("a").alias("b")))
        around = least(both, "a", "b").select("project", "a", F.least("a", "m").alias("m"))
        large = (both.filter(F.col("b") > F.col("a")).join(around, ["project", "a"])
                 .select("project", F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        below = least(large, "a", "b")
        small = large.join(below, ["project", "a"])
        nxt = (small.filter(F.col("b") != F.col("m")).select("project", F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(below.select("project", "a", F.col("m").alias("b"))).distinct().checkpoint())
        if nxt.count() == low.count() and nxt.join(low, ["project", "a", "b"], "left_anti").isEmpty():
            return nxt
        low = nxt


def summary(mem: DataFrame) -> DataFrame:
    """G4 per project: nodes, edges, components, largest component, most connected
    (id, degree, summary[:120]) and edge counts by reason."""
    nd = narrow(nodes(mem))
    pairs = explicit_pairs(nd).checkpoint()
    sizes = tag_union_sizes(nd).checkpoint()
    counts = edge_counts(nd, pairs, sizes)
    comp = (group_components(nd, pairs).groupBy("project", "label").agg(F.sum("n_g").alias("size"))
            .groupBy("project").agg(F.count(F.lit(1)).alias("components"),
                                    F.max("size").alias("largest_component")))
    top = _top(degrees(nd, pairs, sizes))
    text = mem.select(F.col("id").alias("most_connected_id"),
                      F.substring("summary", 1, rules.PREVIEW_CHARS).alias("most_connected_summary"))
    return (top.join(counts, "project").join(comp, "project").join(text, "most_connected_id")
            .select("project", "nodes",
                    (F.col("explicit") + F.col("shared_tag") + F.col("same_type")).alias("edges"),
                    "components", "largest_component", "most_connected_id", "most_connected_degree",
                    "most_connected_summary", "explicit", "shared_tag", "same_type"))


def _top(deg: DataFrame) -> DataFrame:
    """Per project: number of nodes, and the node of highest degree (ties: the earliest listed)."""
    return (deg.groupBy("project").agg(F.count(F.lit(1)).alias("nodes"),
                                       F.min(F.struct((-F.col("degree")).alias("nd"), "ord", "id")).alias("t"))
            .select("project", "nodes", F.col("t.id").alias("most_connected_id"),
                    (-F.col("t.nd")).alias("most_connected_degree")))


def tag_ranks(nd: DataFrame) -> DataFrame:
    """(project, tag, rank) - first occurrence in listing order, then tag position."""
    return (nd.select("project", "ord", F.posexplode("tags").alias("pos", "tag"))
            .groupBy("project", "tag").agg(F.min(F.struct("ord", "pos")).alias("trank")))


def memberships(nd: DataFrame) -> DataFrame:
    """(project, id, group): the type group and the tag groups of each node (a null type is no group)."""
    group = lambda kind, key: F.concat(F.lit(kind), key).alias("group")
    return (nd.select("project", "id", group("type ", F.col("type"))).where("group is not null").unionByName(
        nd.select("project", "id", F.explode("tags").alias("tag")).select("project", "id", group("tag ", F.col("tag")))))


def reach(member: DataFrame, adj: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search over groups: (project, start, id, hop) of the nodes reached, and (project, start, group) of
    the groups expanded on the way.

    member: (project, id, group); adj: (project, id, nb) links both ways; seeds: (project, start).  Groups that a start
    has expanded are taken out before a hop expands the others, so that a start reads each membership
    at most twice: once to leave a node, once to enter it."""
    frontier = seeds.select("project", "start", F.col("start").alias("id"))
    visited = frontier.withColumn("hop", F.lit(0)).limit(0)
    expanded = seeds.select("project", "start", F.lit("").alias("group")).limit(0)
    if depth > 1:
        member = member.checkpoint()
    for hop in range(1, depth + 1):
        groups = frontier.join(member, ["project", "id"]).select("project", "start", "group").distinct()
        if hop > 1:
            groups = groups.join(expanded, ["project", "start", "group"], "left_anti")
        if depth > 1:
            groups = groups.checkpoint()
        nxt = (groups.join(member, ["project", "group"]).select("project", "start", "id")
               .unionByName(frontier.join(adj, ["project", "id"]).select("project", "start", F.col("nb").alias("id")))
               .distinct().filter(F.col("id") != F.col("start")))
        if hop > 1:
            nxt = nxt.join(visited, ["project", "start", "id"], "left_anti")
        nxt = nxt.withColumn("hop", F.lit(hop)).checkpoint()
        visited = nxt if hop == 1 else visited.unionByName(nxt)
        expanded = groups if hop == 1 else expanded.unionByName(groups)
        frontier = nxt.select("project", "start", "id")
    return visited, expanded


def neighbors(mem: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """G3 for many starts at once: starts(start) ids.  Returns (start, id, hop,
    connection, weight, type, project, summary[:120], source, confidence, created_at).

    Expansion goes through memberships (type groups, tag groups, explicit links), never
    pairs, and each group is expanded once per start (``reach``).
    """
    nd = nodes(mem)
    pairs = explicit_pairs(nd)
    adj = pairs.select("project", F.col("src").alias("id"), F.col("dst").alias("nb")).unionByName(
        pairs.select("project", F.col("dst").alias("id"), F.col("src").alias("nb")))
    tags = nd.select("project", "id", F.explode("tags").alias("tag"))
    seeds = starts.select(F.col("start")).distinct().join(
        nd.select(F.col("id").alias("start"), "project"), "start")
    visited, _ = reach(memberships(nd), adj, seeds, depth)

    # direct-edge reason for hop 1
    ranks = tag_ranks(nd)
    st = (tags.withColumnRenamed("id", "start").join(seeds, ["project", "start"], "left_semi")
          .join(ranks, ["project", "tag"]))
    shared = (visited.filter(F.col("hop") == 1).join(st, ["project", "start"])
              .join(tags, ["project", "id", "tag"])
              .groupBy("project", "start", "id").agg(F.min_by("tag", "trank").alias("first_tag")))
    linked = adj.select("project", F.col("id").alias("start"), F.col("nb").alias("id"),
                        F.lit(True).alias("is_link"))
    out = (visited.join(linked, ["project", "start", "id"], "left")
           .join(shared, ["project", "start", "id"], "left"))
    connection = (F.when(F.col("hop") > 1, F.lit("indirect"))
                  .when(F.col("is_link"), F.lit(rules.EDGE_EXPLICIT[0]))
                  .when(F.col("first_tag").isNotNull(), F.concat(F.lit("shared_tag:"), F.col("first_tag")))
                  .otherwise(F.lit(rules.EDGE_SAME_TYPE[0])))
    weight = (F.when(F.col("hop") > 1, F.lit(0.0))
              .when(F.col("is_link"), F.lit(rules.EDGE_EXPLICIT[1]))
              .when(F.col("first_tag").isNotNull(), F.lit(rules.EDGE_SHARED_TAG[1]))
              .otherwise(F.lit(rules.EDGE_SAME_TYPE[1])))
    attrs = nd.select("project", "id", "type", F.substring("summary", 1, rules.PREVIEW_CHARS).alias("summary"),
                      "source", "confidence", F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))
    return (out.join(attrs, ["project", "id"])
            .select("start", "id", "hop", connection.alias("connection"), weight.alias("weight"),
                    "type", "project", "summary", "source", "confidence", "created_at"))


def most_connected(mem: DataFrame) -> DataFrame:
    """(project, start) - highest degree, ties to the earliest listed."""
    return _top(degrees(narrow(nodes(mem)))).select("project", F.col("most_connected_id").alias("start"))
