"""Role features: a row for each frame and node of its sentence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions import linguistics as lx
from lexgrove.operators import trees, windows
from lexgrove.sources.shared import cut

NOVAL = "NONE"
#: Columns in the order of the table; those of ADMIN, and gold, are no model features.
PATHS = {
    "path": (True, True, True), "pt_path": (True, False, True), "gf_path": (True, True, False),
    "combined_path": (False, True, True), "pt_combined_path": (False, False, True), "gf_combined_path": (False, True, False),
    "partial_path": (True, True, True), "pt_partial_path": (True, False, True), "gf_partial_path": (True, True, False),
    "gvpath": (True, True, True), "pt_gvpath": (True, False, True), "gf_gvpath": (True, True, False),
}
ADMIN = ("term", "nodeID", "sentid")
SECOND_PHASE = ("nearest_pt_path", "neareststring_pt", "nearestpath_pt")


def _joined(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return rows.join(other.hint("merge"), list(keys), "left")


def build(t: dict[str, DataFrame], language: str = "en", height: int | None = None) -> DataFrame:
    """The feature table of sentence tables (see sources.stxml), both phases; real nulls stand for no value.

    All joins are merges: these tables grow with the sentences, and none may go through the driver,
    which also keeps each plan again for every step of it, so that no plan has more than some dozen joins.
    """
    t = {name: rows.hint("merge") for name, rows in t.items()}
    nodes = lx.with_categories(t["syn_node"].where("kind <> 'part'"), language)
    nodes = cut(nodes.withColumn("lemma_", lx.lemma_or_word(F.col("lemma"), F.col("word"))))
    edges = cut(t["syn_edge"].where("is_tree"))
    up = cut(trees.closure(edges, height))
    below = cut(trees.node_yield(nodes, up))
    bounds = cut(trees.first_and_last(below, nodes.where("kind = 't'")))
    head_of = cut(lx.heads(nodes, edges, below, up, language, height))
    labelled = nodes.withColumn("cat", F.col("simple_pt"))

    # one target node a frame: the main terminal of its target
    targets = lx.targets_of_frames(t["frame"], t["fe_node"].join(t["fe"].where("is_target").select("sent_id", "fe_id", "frame_id"), ["sent_id", "fe_id"]), below, nodes, language)
    frames = targets.select("sent_id", "frame_id", F.col("name").alias("frame"), F.col("main_id").alias("a"), F.col("lemma").alias("target"), F.col("pos").alias("target_pos"))
    fine = nodes.select("sent_id", F.col("node_id").alias("a"), F.col("pt").alias("finegrained_target_pos"))
    voice = cut(lx.english_voice(nodes, edges, up).select("sent_id", F.col("node_id").alias("a"), "voice"))
    above = up.join(nodes.where("kind = 'nt' and category in ('verb')").select("sent_id", F.col("node_id").alias("ancestor_id")), ["sent_id", "ancestor_id"], "left_semi")
    verb_heads = above.join(head_of.select("sent_id", F.col("node_id").alias("ancestor_id"), F.col("head_id").alias("gv")), ["sent_id", "ancestor_id"])
    verb_heads = verb_heads.join(nodes.where("category = 'verb'").select("sent_id", F.col("node_id").alias("gv"), F.col("lemma_").alias("gov_verb")), ["sent_id", "gv"])
    own = nodes.select("sent_id", "node_id", F.col("lemma_").alias("own_lemma"))
    governing = verb_heads.join(own, ["sent_id", "node_id"]).where("gov_verb <> own_lemma").groupBy("sent_id", F.col("node_id").alias("a")).agg(F.min_by(F.struct("gv", "gov_verb"), "depth").alias("g")).select("sent_id", "a", "g.*")
    frames = cut(reduce(lambda rows, other: _joined(rows, other, "sent_id", "a"), (fine, voice, cut(governing)), frames))

    rows = frames.join(nodes.select("sent_id", F.col("node_id").alias("b"), F.col("simple_pt").alias("pt"), "kind", "category"), "sent_id")
    found = trees.paths(rows.select("sent_id", "a", "b").distinct(), labelled, edges, up).select("sent_id", "a", "b", "path", "lca", "up_steps", "down_steps")
    rows = _joined(rows, found.withColumnRenamed("path", "p"), "sent_id", "a", "b")
    gv_pairs = rows.where("gv is not null").select("sent_id", F.col("gv").alias("a"), "b").distinct()
    gv_paths = trees.paths(gv_pairs, labelled, edges, up).select("sent_id", F.col("a").alias("gv"), "b", F.col("path").alias("gp"))
    rows = _joined(rows, gv_paths, "sent_id", "gv", "b")
    ending = F.concat(F.lit("--"), F.coalesce("target_pos", F.lit("-")), F.lit("--"), F.coalesce("voice", F.lit("-")))
    for name, parts in PATHS.items():
        source = F.col("gp") if "gvpath" in name else trees.down_part(F.col("p")) if "partial" in name else F.col("p")
        text = trees.printed(source, *parts, cutoff=True)
        rows = rows.withColumn(name, F.concat(text, ending) if "combined" in name else text)
    rows = cut(rows.withColumn("path_length", F.when(F.col("p").isNotNull(), F.size("p"))).drop("p", "gp"))

    # what a node has without a frame, by narrow rows: b and all that hangs on it
    of_b = nodes.select("sent_id", F.col("node_id").alias("b")).distinct()
    parents = edges.select("sent_id", F.col("child_id").alias("b"), F.col("parent_id").alias("parent"))
    parent_pt = nodes.select("sent_id", F.col("node_id").alias("parent"), F.col("simple_pt").alias("father_pt"), F.col("category").alias("father_category"))
    of_b = _joined(of_b, parents, "sent_id", "b")
    children = edges.join(nodes.select("sent_id", F.col("node_id").alias("child_id"), "simple_pt"), ["sent_id", "child_id"])
    rules = children.groupBy("sent_id", F.col("parent_id").alias("lca")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_ord", "child_id", "simple_pt"))), lambda x: F.coalesce(x["simple_pt"], F.lit("-"))), " ").alias("rhs"))
    lhs = nodes.select("sent_id", F.col("node_id").alias("lca"), F.col("simple_pt").alias("lhs"))

    place = bounds.select("sent_id", F.col("node_id").alias("b"), F.col("low").alias("node_low"), F.col("high").alias("node_high"), F.col("first_id"), F.col("last_id"))
    anchor = bounds.select("sent_id", F.col("node_id").alias("a"), F.col("low").alias("anchor_low"), F.col("high").alias("anchor_high"))
    word = lambda key, lemma, pos: nodes.select("sent_id", F.col("node_id").alias(key), F.col("lemma_").alias(lemma), F.col("pt").alias(pos))
    heads = head_of.select("sent_id", F.col("node_id").alias("b"), "head_id")
    order = nodes.select("sent_id", F.col("node_id").alias("head_id"), F.col("term_ord").alias("head_ord"))
    content = lx.informative_content(nodes, edges, head_of, language).select("sent_id", F.col("node_id").alias("b"), "content_id")
    prep = lx.prepositions(nodes, below, language).select("sent_id", F.col("node_id").alias("b"), "prep")
    beside = trees.sibling_nodes(edges, bounds).withColumnRenamed("node_id", "b")
    for other in (place, heads, content, prep, beside):
        of_b = _joined(of_b, other, "sent_id", "b")
    of_b = _joined(cut(of_b), parent_pt, "sent_id", "parent")
    of_b = _joined(of_b, word("first_id", "firstword", "firstword_pos"), "sent_id", "first_id")
    of_b = _joined(of_b, word("last_id", "lastword", "lastword_pos"), "sent_id", "last_id")
    of_b = _joined(_joined(of_b, word("head_id", "const_head", "const_head_pos"), "sent_id", "head_id"), order, "sent_id", "head_id")
    of_b = _joined(of_b, word("content_id", "icont_lemma", "icont_pos"), "sent_id", "content_id")
    for side in ("left", "right"):
        near = nodes.select("sent_id", F.col("node_id").alias(f"{side}_id"), F.col("simple_pt").alias(f"{side}sib_pt"))
        near = _joined(near, head_of.select("sent_id", F.col("node_id").alias(f"{side}_id"), F.col("head_id").alias("_h")), "sent_id", f"{side}_id")
        near = _joined(near, nodes.select("sent_id", F.col("node_id").alias("_h"), F.col("lemma_").alias(f"{side}sib_lemma")), "sent_id", "_h").drop("_h")
        of_b = _joined(of_b, near, "sent_id", f"{side}_id")
    rows = _joined(_joined(rows, rules, "sent_id", "lca"), lhs, "sent_id", "lca").withColumn("ancestor_rule", F.when(F.col("rhs").isNotNull(), F.concat_ws(" -> ", "lhs", "rhs")))
    rows = _joined(_joined(rows, anchor, "sent_id", "a"), cut(of_b), "sent_id", "b")
    rows = rows.withColumn("ismaxproj", F.when(F.col("father_category").eqNullSafe(F.col("category")) & F.col("parent").isNotNull(), 0).otherwise(1))
    rows = trees.relative_position(rows).withColumn("worddistance", F.abs(F.col("head_ord") - F.col("anchor_low")))
    rows = cut(rows)
    if language == "en":  # from the row alone
        rows = lx.english_verb_functions(rows.withColumn("path_", F.col("path")).withColumn("path", F.col("pt_path"))).withColumn("path", F.col("path_")).drop("path_")
    else:
        functions = lx.edge_functions(edges).select("sent_id", F.col("anchor_id").alias("a"), F.col("node_id").alias("b"), "gf")
        rows = _joined(rows, functions.where("gf is not null").groupBy("sent_id", "a", "b").agg(F.min("gf").alias("gf")), "sent_id", "a", "b")
    through_pp = F.col("father_category") == "prep"
    rows = trees.conjunction_between(rows, ["sent_id", "frame_id", "a"])
    rows = rows.withColumn("prune", trees.prune(F.col("up_steps"), F.col("down_steps"), through_pp, F.col("conjunction")))
    elements = t["fe_node"].join(t["fe"].where("not is_target"), ["sent_id", "fe_id"])
    gold = elements.groupBy("sent_id", "frame_id", F.col("node_id").alias("b")).agg(F.min_by("name", "fe_ord").alias("gold"))
    rows = _joined(rows, gold, "sent_id", "frame_id", "b")
    rows = rows.withColumn("term", (F.col("kind") == "t").cast("int")).withColumn("nodeID", F.concat_ws(" ", "b", "parent")).withColumn("sentid", F.concat_ws("---", "sent_id", "frame_id")).withColumn("target_voice", F.substring("voice", 1, 4))
    columns = (
        "sentid", "nodeID", "term", "frame", "target", "target_pos", "finegrained_target_pos", "target_voice", "gov_verb", *PATHS, "path_length", "ancestor_rule", "relpos", "pt", "gf", "father_pt",
        "prep", "const_head", "const_head_pos", "icont_lemma", "icont_pos", "firstword", "firstword_pos", "lastword", "lastword_pos", "leftsib_pt", "leftsib_lemma", "rightsib_pt", "rightsib_lemma",
        "worddistance", "ismaxproj", "prune", "gold",
    )
    return second_phase(rows.select(*columns))


def second_phase(rows: DataFrame) -> DataFrame:
    """Flags of the nearest nodes of each frame's sentence, by path and by label."""
    some = rows.withColumns({c: F.coalesce(c, F.lit(NOVAL)) for c in ("pt_path", "pt")})
    for name, value, distance in zip(SECOND_PHASE, ("pt_path", "pt", "pt"), ("worddistance", "worddistance", "path_length"), strict=True):
        some = windows.nearest_flags(some, ["sentid"], value, distance, name, NOVAL)
    return some.withColumns({c: F.nullif(c, F.lit(NOVAL)) for c in ("pt_path", "pt")})


def at_boundary(rows: DataFrame, noval: str = NOVAL) -> DataFrame:
    """The table as learners read it: no-value for texts, 0 for numbers."""
    kinds = dict(rows.dtypes)
    fill: dict[str, Column] = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(noval)) if kinds[c] == "string" else F.coalesce(c, F.lit(0)) for c in rows.columns}
    return rows.withColumns(fill)


def model_features(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (*ADMIN, "gold", "prune")]


def with_row_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row_id", F.row_number().over(Window.partitionBy("sentid").orderBy("nodeID")))
