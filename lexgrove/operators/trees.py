"""Labelled trees as node and edge tables: closure, yields, paths, constituents, overlaps.

Edges are (sent_id, parent_id, child_id, label); a node has one parent at most. Closures are
built by doubling the step, so a tree of height h takes log2(h) joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.sources.shared import cut

#: Beyond this height edges are taken for a cycle, and raise.
MOST_HEIGHT = 1 << 16


def closure(edges: DataFrame, height: int | None = None) -> DataFrame:
    """(sent_id, node_id, ancestor_id, depth) of every node and proper ancestor.

    height: a bound on the tree's height that the caller knows; without it doubling goes on, a
    table a step, until nothing is added.
    """
    step = edges.select("sent_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    known, reach = step, 1
    while height is None or reach < height:
        if reach >= MOST_HEIGHT:
            raise ValueError(f"no tree is higher than {MOST_HEIGHT}: the edges hold a cycle")
        # paths of up to reach steps, extended by those of exactly reach steps
        tail = known.select("sent_id", F.col("node_id").alias("_mid"), F.col("ancestor_id").alias("_top"), F.col("depth").alias("_more"))
        far = known.where(F.col("depth") == reach)
        longer = far.join(tail.hint("merge"), (far["sent_id"] == tail["sent_id"]) & (far["ancestor_id"] == tail["_mid"])).select(far["sent_id"], "node_id", F.col("_top").alias("ancestor_id"), (F.col("depth") + F.col("_more")).alias("depth"))
        if height is None:
            longer = cut(longer)
            if longer.isEmpty():
                break
        known, reach = known.unionAll(longer), reach * 2
    return known


def with_self(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    own = nodes.select("sent_id", "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    return own.unionByName(ancestors.select("sent_id", "node_id", "ancestor_id", "depth"))


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select("sent_id", F.col("child_id").alias("node_id")), ["sent_id", "node_id"], "left_anti")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with indeg and outdeg."""
    into = edges.groupBy("sent_id", F.col("child_id").alias("node_id")).agg(F.count(F.lit(1)).alias("indeg"))
    out = edges.groupBy("sent_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("outdeg"))
    return nodes.join(into, ["sent_id", "node_id"], "left").join(out, ["sent_id", "node_id"], "left").fillna(0, ["indeg", "outdeg"])


def node_yield(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(sent_id, node_id, term_id): the terminals below each node; a terminal yields itself."""
    terminals = nodes.where("kind = 't'").select("sent_id", F.col("node_id").alias("term_id"))
    up = with_self(nodes, ancestors).select("sent_id", F.col("node_id").alias("term_id"), F.col("ancestor_id").alias("node_id"))
    return up.join(terminals, ["sent_id", "term_id"], "left_semi").select("sent_id", "node_id", "term_id")


def lowest_common(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """pairs (sent_id, a, b) with lca, up_steps and down_steps; up is the closure with each node itself."""
    one = up.select("sent_id", F.col("node_id").alias("a"), "ancestor_id", F.col("depth").alias("up_steps"))
    two = up.select("sent_id", F.col("node_id").alias("b"), "ancestor_id", F.col("depth").alias("down_steps"))
    met = pairs.join(one.hint("merge"), ["sent_id", "a"]).join(two.hint("merge"), ["sent_id", "b", "ancestor_id"])
    best = F.min_by(F.struct(F.col("ancestor_id").alias("lca"), "up_steps", "down_steps"), F.col("up_steps") + F.col("down_steps"))
    return met.groupBy("sent_id", "a", "b").agg(best.alias("x")).select("sent_id", "a", "b", "x.*")


_STEP = "struct<dir:string,gf:string,pt:string,node_id:string>"


def chains(nodes: DataFrame, edges: DataFrame, ancestors: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(sent_id, node_id, ancestor_id, up, down): the steps from node to ancestor, and back down.

    wanted: (sent_id, node_id, ancestor_id) of the chains to give; without it all.

    An up step has the child's edge label and the parent's category, a down step the child's
    edge label and the child's category.
    """
    to = ancestors.select("sent_id", "node_id", "ancestor_id", "depth")
    if wanted is not None:
        to = to.join(wanted, ["sent_id", "node_id", "ancestor_id"], "left_semi")
        ancestors = ancestors.join(wanted, ["sent_id", "node_id"], "left_semi")
        nodes_of = nodes.join(wanted, ["sent_id", "node_id"], "left_semi")
    else:
        nodes_of = nodes
    # the edge above each node on the way: the node itself and ancestors below the last
    way = with_self(nodes_of, ancestors).select("sent_id", "node_id", F.col("ancestor_id").alias("child_id"), F.col("depth").alias("at"))
    cat = nodes.select("sent_id", F.col("node_id").alias("_n"), F.col("cat").alias("_cat"))
    labelled = (
        edges.join(cat.withColumnsRenamed({"_n": "parent_id", "_cat": "parent_cat"}), ["sent_id", "parent_id"])
        .join(cat.withColumnsRenamed({"_n": "child_id", "_cat": "child_cat"}), ["sent_id", "child_id"])
        .select("sent_id", "child_id", "parent_id", "label", "parent_cat", "child_cat")
    )
    steps = way.join(labelled.hint("merge"), ["sent_id", "child_id"])
    on = to.join(steps.hint("merge"), ["sent_id", "node_id"]).where("at < depth")
    ordered = F.array_sort(F.collect_list(F.struct("at", "label", "parent_cat", "child_cat", "parent_id", "child_id")))
    found = on.groupBy("sent_id", "node_id", "ancestor_id").agg(ordered.alias("s"))
    up = F.transform("s", lambda x: F.struct(F.lit("U").alias("dir"), x["label"].alias("gf"), x["parent_cat"].alias("pt"), x["parent_id"].alias("node_id")))
    down = F.transform(F.reverse("s"), lambda x: F.struct(F.lit("D").alias("dir"), x["label"].alias("gf"), x["child_cat"].alias("pt"), x["child_id"].alias("node_id")))
    return found.select("sent_id", "node_id", "ancestor_id", up.cast(f"array<{_STEP}>").alias("up"), down.cast(f"array<{_STEP}>").alias("down"))


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sent_id, node_id, neighbour_id, path): parent and children of each node, with a path of one step."""
    cats = nodes.select("sent_id", F.col("node_id").alias("neighbour_id"), "cat")
    up = edges.select("sent_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("neighbour_id"), F.lit("U").alias("dir"), "label")
    down = edges.select("sent_id", F.col("parent_id").alias("node_id"), F.col("child_id").alias("neighbour_id"), F.lit("D").alias("dir"), "label")
    step = F.struct("dir", F.col("label").alias("gf"), F.col("cat").alias("pt"), F.col("neighbour_id").alias("node_id"))
    found = up.unionAll(down).join(cats, ["sent_id", "neighbour_id"])
    return found.select("sent_id", "node_id", "neighbour_id", F.array(step).cast(f"array<{_STEP}>").alias("path"))


def paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """pairs (sent_id, a, b) with path, lca, up_steps, down_steps; pairs without a path are left out."""
    met = cut(lowest_common(pairs, with_self(nodes, ancestors)))
    ends = [met.select("sent_id", F.col(c).alias("node_id"), F.col("lca").alias("ancestor_id")) for c in ("a", "b")]
    steps = cut(chains(nodes, edges, ancestors, ends[0].unionAll(ends[1]).distinct()))
    none = F.array().cast(f"array<{_STEP}>")
    a = steps.select("sent_id", F.col("node_id").alias("a"), F.col("ancestor_id").alias("lca"), "up")
    b = steps.select("sent_id", F.col("node_id").alias("b"), F.col("ancestor_id").alias("lca"), "down")
    both = met.join(a, ["sent_id", "a", "lca"], "left").join(b, ["sent_id", "b", "lca"], "left")
    return both.withColumn("path", F.concat(F.coalesce("up", none), F.coalesce("down", none))).drop("up", "down")


def printed(path: Column, direction: bool = True, gf: bool = True, pt: bool = True, cutoff: bool = False) -> Column:
    """A path as text, each part followed by a space; missing parts are dashes; null if empty.

    cutoff: without the last category, if it is one word after others.
    """
    parts = [name for name, wanted in (("dir", direction), ("gf", gf), ("pt", pt)) if wanted]
    text = F.array_join(F.transform(path, lambda x: F.concat(*[p for n in parts for p in (F.coalesce(x[n], F.lit("-")), F.lit(" "))])), "")
    if cutoff and pt:
        text = F.regexp_replace(text, r"^(.+ )\w+ $", "$1")
    return F.nullif(text, F.lit(""))


def down_part(path: Column) -> Column:
    return F.filter(path, lambda x: x["dir"] == "D")


def maximal_constituents(wanted: DataFrame, nodes: DataFrame, edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(sent_id, set_id, node_id): the highest nodes whose terminals all belong to a set.

    wanted: (sent_id, set_id, term_id). Punctuation (nodes.is_punct) is ignored; together the
    nodes cover the set.
    """
    flags = nodes.select("sent_id", F.col("node_id").alias("term_id"), "is_punct")
    words = node_yield(nodes, ancestors).join(flags, ["sent_id", "term_id"]).where("not is_punct")
    sizes = words.groupBy("sent_id", "node_id").agg(F.count(F.lit(1)).alias("size"))
    inside = words.join(wanted.distinct(), ["sent_id", "term_id"]).groupBy("sent_id", "set_id", "node_id").agg(F.count(F.lit(1)).alias("hits"))
    covered = inside.join(sizes, ["sent_id", "node_id"]).where("hits = size").select("sent_id", "set_id", "node_id")
    parents = edges.select("sent_id", F.col("child_id").alias("node_id"), "parent_id")
    above = covered.select("sent_id", "set_id", F.col("node_id").alias("parent_id"))
    lower = covered.join(parents, ["sent_id", "node_id"]).join(above, ["sent_id", "set_id", "parent_id"]).select("sent_id", "set_id", "node_id")
    return covered.join(lower, ["sent_id", "set_id", "node_id"], "left_anti")


def convex(wanted: DataFrame, terminals: DataFrame) -> DataFrame:
    """Sets (sent_id, set_id, term_id) filled up to all terminals between their first and last."""
    placed = wanted.join(terminals.select("sent_id", F.col("node_id").alias("term_id"), "term_ord"), ["sent_id", "term_id"])
    ends = placed.groupBy("sent_id", "set_id").agg(F.min("term_ord").alias("low"), F.max("term_ord").alias("high"))
    every = terminals.select("sent_id", F.col("node_id").alias("term_id"), "term_ord")
    return ends.join(every, "sent_id").where("term_ord between low and high").select("sent_id", "set_id", "term_id")


def without_overlaps(rows: DataFrame, ancestors: DataFrame, label: str = "label", noval: str = "NONE") -> DataFrame:
    """rows (sent_id, node_id, label) with kept: no-value where an ancestor's row had the same label."""
    above = rows.select("sent_id", F.col("node_id").alias("ancestor_id"), F.col(label).alias(label)).where(F.col(label) != noval)
    hit = ancestors.select("sent_id", "node_id", "ancestor_id").join(above, ["sent_id", "ancestor_id"]).select("sent_id", "node_id", label, F.lit(True).alias("_hit")).distinct()
    return rows.join(hit, ["sent_id", "node_id", label], "left").withColumn("kept", F.when(F.col("_hit"), noval).otherwise(F.col(label))).drop("_hit")


def prune(up: Column, down: Column, through_pp: Column, conjunction_between: Column) -> Column:
    """1 keeps a node: it is the target, or the last step of an upward path goes down once, or twice through a PP."""
    reached = up.isNotNull() & down.isNotNull()
    keep = ((up == 0) & (down == 0)) | (~F.coalesce(conjunction_between, F.lit(False)) & (up >= 1) & ((down == 1) | ((down == 2) & F.coalesce(through_pp, F.lit(False)))))
    return F.when(reached & keep, 1).otherwise(0)


def conjunction_between(rows: DataFrame, keys: list[str], name: str = "conjunction") -> DataFrame:
    """rows with a boolean: whether a coordinating sister lies between the node and a sister nearer to the target.

    rows: keys (of sentence and target), b, parent, category, node_low, node_high and path_length.
    """
    sister = F.struct(F.col("b").alias("id"), F.col("node_low").alias("low"), F.col("node_high").alias("high"), F.col("path_length").alias("steps"), (F.col("category") == "con").alias("con"))
    sisters = rows.where("parent is not null").groupBy(*keys, "parent").agg(F.collect_set(sister).alias("_sisters")).where(F.exists("_sisters", lambda s: s["con"]))
    joined = rows.join(sisters, [*keys, "parent"], "left")
    nearer = lambda s: (s["id"] != F.col("b")) & (s["steps"] < F.col("path_length"))
    left = lambda c: (c["low"] < F.col("node_low")) & (c["high"] < F.col("node_high")) & F.exists("_sisters", lambda s: nearer(s) & (s["low"] < c["low"]) & (s["high"] < c["high"]))
    right = lambda c: (c["low"] > F.col("node_low")) & (c["high"] > F.col("node_high")) & F.exists("_sisters", lambda s: nearer(s) & (s["low"] > c["low"]) & (s["high"] > c["high"]))
    found = F.exists("_sisters", lambda c: c["con"] & (c["id"] != F.col("b")) & (left(c) | right(c)))
    return joined.withColumn(name, F.coalesce(found, F.lit(False))).drop("_sisters")


def relative_position(rows: DataFrame) -> DataFrame:
    """rows (node_low, node_high, anchor_low, anchor_high) with relpos: LEFT, RIGHT or DOM."""
    return rows.withColumn("relpos", F.when(F.col("node_high") < F.col("anchor_low"), "LEFT").when(F.col("node_low") > F.col("anchor_high"), "RIGHT").otherwise("DOM"))


def term_order(node_id: Column) -> Column:
    """Terminals are ordered by the digits at the end of their id; parts of split words by those before _s."""
    return F.regexp_extract(node_id, r"(\d+)(?:_s\d+)?$", 1).cast("int")


def split_order(node_id: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(node_id, r"_s(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))


def edit_edges(edges: DataFrame, removed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """A new version of the edges; a child that is added under a parent loses its old one."""
    if removed is not None:
        edges = edges.join(removed, ["sent_id", "parent_id", "child_id"], "left_anti")
    if added is not None:
        edges = edges.join(added.select("sent_id", "child_id"), ["sent_id", "child_id"], "left_anti").unionByName(added)
    return edges


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without single removed nodes; their children go to the parent with their labels."""
    above = edges.join(gone.select("sent_id", F.col("node_id").alias("child_id")), ["sent_id", "child_id"]).select("sent_id", F.col("child_id").alias("parent_id"), F.col("parent_id").alias("_up"))
    moved = edges.join(above, ["sent_id", "parent_id"], "left").withColumn("parent_id", F.coalesce("_up", "parent_id")).drop("_up")
    for side in ("child_id", "parent_id"):
        moved = moved.join(gone.select("sent_id", F.col("node_id").alias(side)), ["sent_id", side], "left_anti")
    return nodes.join(gone, ["sent_id", "node_id"], "left_anti"), moved.select(*edges.columns)


def first_and_last(nodes_yield: DataFrame, terminals: DataFrame) -> DataFrame:
    """(sent_id, node_id, first_id, last_id, low, high) over terminals that aren't punctuation."""
    words = terminals.where("not is_punct").select("sent_id", F.col("node_id").alias("term_id"), "term_ord")
    found = nodes_yield.join(words, ["sent_id", "term_id"])
    return found.groupBy("sent_id", "node_id").agg(
        F.min_by("term_id", "term_ord").alias("first_id"), F.max_by("term_id", "term_ord").alias("last_id"), F.min("term_ord").alias("low"), F.max("term_ord").alias("high")
    )


def strings(nodes_yield: DataFrame, terminals: DataFrame) -> DataFrame:
    """(sent_id, node_id, text): the words below each node, in order."""
    words = terminals.select("sent_id", F.col("node_id").alias("term_id"), "word", "term_ord")
    found = nodes_yield.join(words, ["sent_id", "term_id"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("term_ord", "term_id", "word"))), lambda x: x["word"])
    return found.groupBy("sent_id", "node_id").agg(F.array_join(ordered, " ").alias("text"))


def sibling_nodes(edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """(sent_id, node_id, left_id, right_id): neighbours under the same parent, by first terminal."""
    placed = edges.select("sent_id", "parent_id", F.col("child_id").alias("node_id")).join(bounds.select("sent_id", "node_id", "low"), ["sent_id", "node_id"])
    window = Window.partitionBy("sent_id", "parent_id").orderBy("low", "node_id")
    return placed.select("sent_id", "node_id", F.lag("node_id").over(window).alias("left_id"), F.lead("node_id").over(window).alias("right_id"))
