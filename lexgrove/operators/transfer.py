"""Carrying annotation from one version of a sentence to another, and repairing it.

Rules that recurse over one tree run on one sentence at a time, in Arrow batches; sentences
are small groups by nature.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.operators import trees


def matched_terminals(old: DataFrame, new: DataFrame) -> DataFrame:
    """(sent_id, old_id, new_id) of terminals by place, of sentences whose words all agree."""
    place = F.row_number().over(Window.partitionBy("sent_id").orderBy("term_ord", "node_id"))
    a = old.where("kind = 't'").select("sent_id", place.alias("n"), F.col("node_id").alias("old_id"), F.col("word").alias("old_word"))
    b = new.where("kind = 't'").select("sent_id", place.alias("n"), F.col("node_id").alias("new_id"), F.col("word").alias("new_word"))
    both = a.join(b, ["sent_id", "n"], "full")
    good = both.groupBy("sent_id").agg(F.bool_and(F.col("old_word").eqNullSafe(F.col("new_word"))).alias("ok")).where("ok").select("sent_id")
    return both.join(good, "sent_id", "left_semi").select("sent_id", "old_id", "new_id")


def transferred_elements(fe_node: DataFrame, old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], height: int | None = None) -> DataFrame:
    """fe_node of the new parse: an element's old terminals, found again, as maximal constituents."""
    old_nodes, old_edges = old
    new_nodes, new_edges = new
    terms = trees.node_yield(old_nodes, trees.closure(old_edges, height)).join(fe_node.select("sent_id", "fe_id", "node_id"), ["sent_id", "node_id"])
    moved = terms.select("sent_id", "fe_id", F.col("term_id").alias("old_id")).join(matched_terminals(old_nodes, new_nodes), ["sent_id", "old_id"])
    wanted = moved.select("sent_id", F.col("fe_id").alias("set_id"), F.col("new_id").alias("term_id"))
    found = trees.maximal_constituents(wanted, new_nodes, new_edges, trees.closure(new_edges, height))
    punct = wanted.join(new_nodes.where("is_punct").select("sent_id", F.col("node_id").alias("term_id")), ["sent_id", "term_id"])
    every = found.unionByName(punct.select("sent_id", "set_id", F.col("term_id").alias("node_id")))
    order = Window.partitionBy("sent_id", "set_id").orderBy("node_id")
    return every.select("sent_id", F.col("set_id").alias("fe_id"), "node_id", (F.row_number().over(order) - 1).alias("ord"))


def lemmas_by_place(nodes: DataFrame, tab: DataFrame) -> DataFrame:
    """Terminals with lemma and word of the tab line at their place; other nodes as they are."""
    place = F.row_number().over(Window.partitionBy("sent_id").orderBy("term_ord", "node_id")) - 1
    numbered = nodes.where("kind = 't'").select("sent_id", "node_id", place.alias("pos_in"))
    side = numbered.join(tab.select("sent_id", F.col("pos").alias("pos_in"), F.col("word").alias("_word"), F.col("lemma").alias("_lemma")), ["sent_id", "pos_in"]).drop("pos_in")
    joined = nodes.join(side, ["sent_id", "node_id"], "left")
    return joined.withColumn("word", F.coalesce("_word", "word")).withColumn("lemma", F.coalesce("_lemma", "lemma")).drop("_word", "_lemma")


def tolerant_constituents(wanted: DataFrame, nodes: DataFrame, edges: DataFrame, one_missing: bool = True) -> DataFrame:
    """(sent_id, set_id, node_id): maximal constituents, where a phrase may lack one child if two or more are in.

    wanted: (sent_id, set_id, term_id).
    """
    sent = nodes.groupBy("sent_id").agg(F.collect_list(F.struct("node_id", "kind", "is_punct")).alias("nodes"))
    tree = edges.groupBy("sent_id").agg(F.collect_list(F.struct("parent_id", "child_id", "child_ord")).alias("edges"))
    sets = wanted.groupBy("sent_id", "set_id").agg(F.collect_set("term_id").alias("terms"))
    rows = sets.join(sent, "sent_id").join(tree, "sent_id")

    def one(row) -> list[str]:  # noqa: ANN001
        kind = {n["node_id"]: (n["kind"], n["is_punct"]) for n in row.nodes}
        below: dict[str, list[str]] = {}
        for e in sorted(row.edges, key=lambda e: (e["child_ord"], e["child_id"])):
            below.setdefault(e["parent_id"], []).append(e["child_id"])
        children = {c for cs in below.values() for c in cs}
        terms = set(row.terms)

        def visit(node: str) -> tuple[bool | None, list[str]]:
            """True, False or None (to be ignored), and the true nodes below a false one."""
            if kind[node][0] == "t":
                if node in terms:
                    return True, []
                return (None if kind[node][1] else False), []
            states = [(c, *visit(c)) for c in below.get(node, [])]
            yes, no = [c for c, s, _ in states if s], [c for c, s, _ in states if s is False]
            if not no:
                return (True if yes else None), []
            if one_missing and len(no) == 1 and len(yes) > 1:
                return True, []
            return False, [x for c, s, inner in states for x in ([c] if s else inner)]

        out = []
        for root in (n for n in kind if n not in children):
            state, inner = visit(root)
            out += [root] if state else inner
        return sorted(out)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            found = [(r.sent_id, r.set_id, n) for r in batch.itertuples(index=False) for n in one(r)]
            yield pd.DataFrame(found, columns=["sent_id", "set_id", "node_id"])

    return rows.mapInPandas(run, "sent_id string, set_id string, node_id string")


def without_relative_clause_heads(fe_node: DataFrame, edges: DataFrame, relative: DataFrame) -> DataFrame:
    """Elements whose node holds a relative clause keep its last child only; relative: (sent_id, node_id)."""
    inside = fe_node.join(relative, ["sent_id", "node_id"])
    last = edges.groupBy("sent_id", F.col("parent_id").alias("node_id")).agg(F.max_by("child_id", "child_ord").alias("_last"))
    moved = inside.join(last, ["sent_id", "node_id"]).select("sent_id", "fe_id", F.col("_last").alias("node_id"), "ord")
    return fe_node.join(relative, ["sent_id", "node_id"], "left_anti").select("sent_id", "fe_id", "node_id", "ord").unionByName(moved)


def written_roles(predictions: DataFrame, fe: DataFrame, fe_node: DataFrame, noval: str = "NONE") -> tuple[DataFrame, DataFrame]:
    """fe and fe_node with the predicted roles in place of the old ones; targets stay.

    predictions: (sentid, nodeID, label), with sentid ``sentence---frame`` and nodeID ``node parent``.
    """
    keys = F.split("sentid", "---")
    some = predictions.where(F.col("label") != noval).select(keys[0].alias("sent_id"), keys[1].alias("frame_id"), F.substring_index("nodeID", " ", 1).alias("node_id"), F.col("label").alias("name"))
    order = F.dense_rank().over(Window.partitionBy("sent_id", "frame_id").orderBy("name"))
    named = some.withColumn("fe_ord", order - 1).withColumn("fe_id", F.concat(F.col("frame_id"), F.lit("_e"), F.col("fe_ord").cast("string")))
    none = [F.lit(None).cast("string").alias(c) for c in ("lemma", "pos")]
    new = named.select("sent_id", "frame_id", "fe_id", "name", F.lit(False).alias("is_target"), *none, "fe_ord").distinct()
    refs = named.select("sent_id", "fe_id", "node_id", (F.row_number().over(Window.partitionBy("sent_id", "fe_id").orderBy("node_id")) - 1).alias("ord"))
    targets = fe.where("is_target")
    kept = fe_node.join(targets.select("sent_id", "fe_id"), ["sent_id", "fe_id"], "left_semi")
    return targets.unionByName(new), kept.select("sent_id", "fe_id", "node_id", "ord").unionByName(refs)


def written_senses(senses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """frame, fe and fe_node tables of assigned senses (sent_id, ids array, main_id, lemma, pos, sense)."""
    number = F.row_number().over(Window.partitionBy("sent_id").orderBy("main_id", "sense"))
    named = senses.withColumn("frame_ord", number - 1).withColumn("frame_id", F.concat(F.col("sent_id"), F.lit("_f"), number.cast("string")))
    named = named.withColumn("fe_id", F.concat(F.col("frame_id"), F.lit("_t")))
    fe = named.select("sent_id", "frame_id", "fe_id", F.lit("target").alias("name"), F.lit(True).alias("is_target"), "lemma", "pos", F.lit(-1).alias("fe_ord"))
    refs = named.select("sent_id", "fe_id", F.posexplode("ids").alias("ord", "node_id")).select("sent_id", "fe_id", "node_id", "ord")
    return named.select("sent_id", "frame_id", F.col("sense").alias("name"), "frame_ord"), fe, refs
