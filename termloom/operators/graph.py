"""Closures, restrictions and distances over edge tables, by semi-naive loops with written steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from termloom.functions.shared import staged


def closure(edges: DataFrame, nodes: DataFrame, rounds: int = 1000) -> DataFrame:
    """``(term_id, ancestor)``: reflexive over ``nodes (term_id)`` and transitive over ``edges (child, parent)``; cycles are no harm.

    Semi-naive, a step for each level above ``nodes``: for few nodes of a large graph. See :func:`closure_of_all`.
    """
    step = edges.select("child", "parent").distinct()
    new = staged(nodes.select("term_id", F.col("term_id").alias("ancestor")).distinct(), "closure")
    all_ = new
    for _ in range(rounds):
        grown = new.join(step, new["ancestor"] == step["child"]).select("term_id", F.col("parent").alias("ancestor")).distinct()
        new = staged(grown.join(all_, ["term_id", "ancestor"], "left_anti"), "closure")
        if new.isEmpty():
            break
        all_ = all_.unionByName(new)
    else:
        raise RuntimeError(f"chains of {rounds} edges or more")
    return all_


def closure_of_all(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """As :func:`closure`, by doubling: paths of up to 2^k edges are joined with themselves, so rounds grow with the logarithm of the depth.

    For vocabularies, where most nodes are asked: paths from all nodes of ``edges`` are worked out.
    """
    up = staged(edges.select("child", "parent").where("child <> parent").distinct(), "paths")
    size = up.count()
    for _ in range(rounds):
        on = up.select(F.col("child").alias("parent"), F.col("parent").alias("further"))
        longer = up.join(on, "parent").select("child", F.col("further").alias("parent")).where("child <> parent")
        up = staged(up.unionByName(longer).distinct(), "paths")
        before, size = size, up.count()
        if size == before:
            break
    else:
        raise RuntimeError(f"chains of 2^{rounds} edges or more")
    own = nodes.select("term_id").distinct()
    above = up.select(F.col("child").alias("term_id"), F.col("parent").alias("ancestor")).join(own, "term_id", "left_semi")
    return above.unionByName(own.select("term_id", F.col("term_id").alias("ancestor")))


def handed_down(edges: DataFrame, marks: DataFrame, rounds: int = 60) -> DataFrame:
    """``(term_id, mark)``: the marks of a term and of all above it over ``edges (child, parent)``; cycles are no harm.

    By doubling, without the closure: after k rounds a term has the marks of all less than 2^k steps above it, and
    ``jump`` leads exactly 2^k steps up, in a tree a row a term. Rows are those of the result and of the jumps.
    """
    jump = staged(edges.select("child", "parent").where("child <> parent").distinct(), "jumps")
    all_ = staged(marks.select("term_id", "mark").distinct(), "marks")
    size = all_.count()
    for _ in range(rounds):
        if jump.isEmpty():
            break
        above = all_.select(F.col("term_id").alias("parent"), "mark")
        down = jump.join(above, "parent").select(F.col("child").alias("term_id"), "mark")
        all_ = staged(all_.unionByName(down).distinct(), "marks")
        before, size = size, all_.count()
        if size == before:
            break
        on = jump.select(F.col("child").alias("parent"), F.col("parent").alias("further"))
        jump = staged(jump.join(on, "parent").select("child", F.col("further").alias("parent")).distinct(), "jumps")
    else:
        raise RuntimeError(f"chains of 2^{rounds} edges or more")
    return all_


def subtree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(term_id)``: the roots and all below them."""
    flipped = edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    return closure(flipped, roots).select(F.col("ancestor").alias("term_id")).distinct()


def restrict(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in ``kept (term_id)``."""
    k = kept.select("term_id")
    return edges.join(k, edges["child"] == k["term_id"], "left_semi").join(k, edges["parent"] == k["term_id"], "left_semi")


def inverse(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """``(child, parent)`` the other way round, without edges to parents that aren't in ``terms (term_id)``."""
    return edges.join(terms, edges["parent"] == terms["term_id"], "left_semi").select(F.col("parent").alias("child"), F.col("child").alias("parent"))


def most_specific(members: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Rows of ``members (set_id, term_id)`` without a descendant in their set; ``ancestors`` as :func:`closure` gives it."""
    up = members.join(ancestors, "term_id").where("ancestor <> term_id").select("set_id", F.col("ancestor").alias("term_id")).distinct()
    return members.join(up, ["set_id", "term_id"], "left_anti")


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int = 1000, reverse: bool = False) -> DataFrame:
    """``(source, node, hops, path)``: a path of the fewest edges ``(src, dst)`` from each of ``sources (source)`` to all it reaches.

    Breadth first. ``path`` lists the nodes from the source on; of several of one length the least, compared from its
    start. With ``reverse`` edges are walked backwards. Self edges are ignored; more than ``rounds`` edges are an error.
    """
    step = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select("src", "dst")
    step = step.where("src <> dst").distinct()
    new = staged(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops"), F.array("source").alias("path")).distinct(), "hops")
    all_ = new
    for k in range(1, rounds + 1):
        grown = new.join(step, new["node"] == step["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        fresh = grown.join(all_.select("source", "node"), ["source", "node"], "left_anti")
        new = staged(fresh.select("source", "node", F.lit(k).alias("hops"), "path"), "hops")
        if new.isEmpty():
            break
        all_ = all_.unionByName(new)
    else:
        raise RuntimeError(f"paths of more than {rounds} edges")
    return all_


def shortest_hops(edges: DataFrame, sources: DataFrame, rounds: int = 1000, reverse: bool = False) -> DataFrame:
    """``(source, node, hops)`` of :func:`shortest_paths`."""
    return shortest_paths(edges, sources, rounds, reverse).select("source", "node", "hops")


def reachable(edges: DataFrame, sources: DataFrame, without: list[str] = ()) -> DataFrame:
    """``(source, node)``, reflexive, over edges ``(src, dst, label)`` whose label isn't among ``without``."""
    used = edges.where(~F.col("label").isin(*without)) if without else edges
    pairs = closure(used.select(F.col("src").alias("child"), F.col("dst").alias("parent")), sources.select(F.col("source").alias("term_id")))
    return pairs.select(F.col("term_id").alias("source"), F.col("ancestor").alias("node"))


def on_cycles(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Edges ``(src, dst)`` left when those from nodes without an incoming edge are taken away until none is: empty without a cycle."""
    left = staged(edges.select("src", "dst").where("src <> dst").distinct(), "peel")
    before = left.count()
    for _ in range(rounds):
        left = staged(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "peel")
        now = left.count()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"edges are still peeled off after {rounds} rounds")
    return left


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new.where("src <> dst")).distinct()


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges but those of ``gone (src, dst)``; nodes left without an edge stay nodes of a node table."""
    return edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``(node)`` with the nodes of ``new (node)``, each once."""
    return nodes.select("node").unionByName(new.select("node")).distinct()


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node)``: the nodes of a node table and all ends of edges."""
    return add_nodes(nodes, edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))))


def children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, child)``: what edges ``(src, dst)`` lead to from each of ``nodes (node)``."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("child")).join(nodes.select("node").distinct(), "node", "left_semi").distinct()


def targets(edges: DataFrame, targets_: DataFrame) -> DataFrame:
    """``(node)``: the mapping targets ``(node)`` that an edge leads to."""
    return targets_.select("node").distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_semi")


def direct_subterms(rel: DataFrame, terms: DataFrame, asked: DataFrame) -> DataFrame:
    """``(term_id, sub_id, name)``: terms one ``is_a`` step below those of ``asked (term_id)``, with their names.

    ``rel (child, rel, parent)``, ``terms (term_id, name)``.
    """
    below = rel.where("rel = 'is_a'").select(F.col("parent").alias("term_id"), F.col("child").alias("sub_id")).distinct()
    return below.join(asked.select("term_id").distinct(), "term_id", "left_semi").join(terms.select(F.col("term_id").alias("sub_id"), "name"), "sub_id").select("term_id", "sub_id", "name")


def delete_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without those at ``nodes (node)``."""
    n = nodes.select("node")
    return edges.join(n, edges["src"] == n["node"], "left_anti").join(n, edges["dst"] == n["node"], "left_anti")


def all_inferred(edges: DataFrame, labels: list[str]) -> DataFrame:
    """``(sample_id, dst, consequent)``: whether all edges into a node have one of the inference ``labels``."""
    return edges.groupBy("sample_id", "dst").agg(F.bool_and(F.col("label").isin(*labels)).alias("consequent"))


def nearest_pair(paths: DataFrame) -> DataFrame:
    """For each ``(sample_id, node)`` the pair with the fewest hops; ties by key, then value."""
    best = F.min(F.struct("hops", "kv_key", "kv_value")).alias("b")
    return paths.groupBy("sample_id", "node").agg(best).select("sample_id", "node", "b.kv_key", "b.kv_value", "b.hops")
