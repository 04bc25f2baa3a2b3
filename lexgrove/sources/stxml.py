"""Sentence-graph XML: corpora to tables and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import is_punctuation
from lexgrove.operators.trees import split_order, term_order

_REF = "fenode: array<struct<_idref: string>>"
_BLOCKS = "struct<uspblock: array<struct<uspitem: array<struct<_idref: string>>>>>"
SCHEMA = f"""
_id string,
graph struct<_root: string,
  terminals: struct<t: array<struct<_id: string, _word: string, _lemma: string, _pos: string, _morph: string>>>,
  nonterminals: struct<nt: array<struct<_id: string, _cat: string, _head: string,
    edge: array<struct<_idref: string, _label: string>>, other_edge: array<struct<_idref: string, _label: string>>>>>>,
sem struct<globals: struct<global: array<struct<_type: string, _param: string, _VALUE: string>>>,
  frames: struct<frame: array<struct<_id: string, _name: string,
    target: struct<_id: string, _lemma: string, _pos: string, {_REF}>,
    fe: array<struct<_id: string, _name: string, {_REF}>>>>>,
  usp: struct<uspframes: {_BLOCKS}, uspfes: {_BLOCKS}>>
"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a sentence, as the XML nests it, with the file it came from."""
    return spark.read.format("xml").option("rowTag", "s").option("valueTag", "_VALUE").schema(SCHEMA).load(path).withColumn("file", F.input_file_name())


def tables(raw: DataFrame) -> dict[str, DataFrame]:
    """sentence, syn_node, syn_edge, frame, fe, fe_node and usp of sentences."""
    sent = F.col("_id").alias("sent_id")
    terminals = raw.select(sent, F.explode("graph.terminals.t").alias("t")).select(
        "sent_id", F.col("t._id").alias("node_id"), F.lit("t").alias("kind"), F.lit(None).cast("string").alias("cat"), F.trim("t._pos").alias("pos"), F.trim("t._word").alias("word"),
        F.trim("t._lemma").alias("lemma"), F.lit(None).cast("string").alias("head"), F.col("t._morph").alias("morph"),
    )
    nts = raw.select(sent, F.posexplode("graph.nonterminals.nt").alias("nt_ord", "n"))
    phrases = nts.select(
        "sent_id", F.col("n._id").alias("node_id"), F.lit("nt").alias("kind"), F.trim("n._cat").alias("cat"), *[F.lit(None).cast("string").alias(c) for c in ("pos", "word", "lemma")],
        F.col("n._head").alias("head"), F.lit(None).cast("string").alias("morph"),
    )
    # a terminal with parts becomes a node above its part nodes
    parts = F.col("node_id").rlike(r"_s\d+$")
    nodes = terminals.unionAll(phrases).withColumn("kind", F.when(parts, "part").otherwise(F.col("kind")))
    nodes = nodes.withColumn("term_ord", F.when(F.col("kind") != "nt", term_order(F.col("node_id")))).withColumn("split_ord", split_order(F.col("node_id"))).withColumn("is_punct", is_punctuation(F.col("word")))

    def edges_of(name: str, is_tree: bool) -> DataFrame:
        return nts.select("sent_id", F.col("n._id").alias("parent_id"), F.posexplode(f"n.{name}").alias("child_ord", "e")).select(
            "sent_id", "parent_id", F.col("e._idref").alias("child_id"), F.col("e._label").alias("label"), "child_ord", F.lit(is_tree).alias("is_tree")
        )

    frames = raw.select(sent, F.posexplode("sem.frames.frame").alias("frame_ord", "f"))
    fes = frames.select("sent_id", F.col("f._id").alias("frame_id"), F.posexplode("f.fe").alias("fe_ord", "x")).select(
        "sent_id", "frame_id", F.coalesce("x._id", F.concat_ws("_", "frame_id", F.concat(F.lit("e"), "fe_ord"))).alias("fe_id"), F.col("x._name").alias("name"), F.lit(False).alias("is_target"),
        F.lit(None).cast("string").alias("lemma"), F.lit(None).cast("string").alias("pos"), "fe_ord", F.col("x.fenode").alias("refs"),
    )
    targets = frames.where("f.target is not null").select(
        "sent_id", F.col("f._id").alias("frame_id"), F.coalesce("f.target._id", F.concat("f._id", F.lit("_t"))).alias("fe_id"), F.lit("target").alias("name"), F.lit(True).alias("is_target"),
        F.col("f.target._lemma").alias("lemma"), F.col("f.target._pos").alias("pos"), F.lit(-1).alias("fe_ord"), F.col("f.target.fenode").alias("refs"),
    )
    elements = fes.unionAll(targets)

    def usp_of(name: str, kind: str) -> DataFrame:
        return raw.select(sent, F.posexplode(f"sem.usp.{name}.uspblock").alias("block_id", "b")).select("sent_id", "block_id", F.lit(kind).alias("kind"), F.explode("b.uspitem").alias("i")).select("sent_id", "block_id", "kind", F.col("i._idref").alias("member_id"))

    flags = F.transform("sem.globals.global", lambda g: F.struct(g["_type"].alias("type"), g["_param"].alias("param"), g["_VALUE"].alias("text")))
    return {
        "sentence": raw.select(sent, "file", F.col("graph._root").alias("root_id"), flags.alias("flags")),
        "syn_node": nodes,
        "syn_edge": edges_of("edge", True).unionAll(edges_of("other_edge", False)),
        "frame": frames.select("sent_id", F.col("f._id").alias("frame_id"), F.col("f._name").alias("name"), "frame_ord"),
        "fe": elements.drop("refs"),
        "fe_node": elements.select("sent_id", "fe_id", F.posexplode("refs").alias("ord", "r")).select("sent_id", "fe_id", F.col("r._idref").alias("node_id"), "ord"),
        "usp": usp_of("uspframes", "frame").unionAll(usp_of("uspfes", "fe")),
    }


def _attribute(name: str, value: Column) -> Column:
    escaped = value
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escaped, F.lit('"'))).otherwise("")


def _listed(rows: DataFrame, keys: list[str], order: list[str], text: Column, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*order, text.alias("_x"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["_x"]), "").alias(name))


def written(t: dict[str, DataFrame]) -> DataFrame:
    """(sent_id, xml): each sentence's element; see write for whole files."""
    ref = lambda tag: F.concat(F.lit(f"<{tag}"), _attribute("idref", F.col("node_id" if tag == "fenode" else "child_id")), F.lit("/>"))
    terminals = F.concat(F.lit("<t"), *[_attribute(a, F.col(c)) for a, c in (("id", "node_id"), ("word", "word"), ("lemma", "lemma"), ("pos", "pos"), ("morph", "morph"))], F.lit("/>"))
    ts = _listed(t["syn_node"].where("kind <> 'nt'"), ["sent_id"], ["term_ord", "split_ord", "node_id"], terminals, "ts")
    tag = F.when(F.col("is_tree"), "edge").otherwise("other_edge")
    edge = F.concat(F.lit("<"), tag, _attribute("idref", F.col("child_id")), _attribute("label", F.col("label")), F.lit("/>"))
    edges = _listed(t["syn_edge"], ["sent_id", "parent_id"], ["is_tree", "child_ord", "child_id"], edge, "edges").withColumnRenamed("parent_id", "node_id")
    phrases = t["syn_node"].where("kind = 'nt'").join(edges, ["sent_id", "node_id"], "left")
    phrase = F.concat(F.lit("<nt"), *[_attribute(a, F.col(c)) for a, c in (("id", "node_id"), ("cat", "cat"), ("head", "head"))], F.lit(">"), F.coalesce("edges", F.lit("")), F.lit("</nt>"))
    nts = _listed(phrases, ["sent_id"], ["node_id"], phrase, "nts")
    refs = _listed(t["fe_node"], ["sent_id", "fe_id"], ["ord", "node_id"], ref("fenode"), "refs")
    elements = t["fe"].join(refs, ["sent_id", "fe_id"], "left").withColumn("refs", F.coalesce("refs", F.lit("")))
    target = F.concat(F.lit("<target"), *[_attribute(a, F.col(c)) for a, c in (("id", "fe_id"), ("lemma", "lemma"), ("pos", "pos"))], F.lit(">"), F.col("refs"), F.lit("</target>"))
    element = F.concat(F.lit("<fe"), _attribute("id", F.col("fe_id")), _attribute("name", F.col("name")), F.lit(">"), F.col("refs"), F.lit("</fe>"))
    inner = _listed(elements, ["sent_id", "frame_id"], ["fe_ord", "fe_id"], F.when(F.col("is_target"), target).otherwise(element), "inner")
    framed = t["frame"].join(inner, ["sent_id", "frame_id"], "left")
    frame = F.concat(F.lit("<frame"), _attribute("id", F.col("frame_id")), _attribute("name", F.col("name")), F.lit(">"), F.coalesce("inner", F.lit("")), F.lit("</frame>"))
    frames = _listed(framed, ["sent_id"], ["frame_ord", "frame_id"], frame, "frames")
    item = F.concat(F.lit("<uspitem"), _attribute("idref", F.col("member_id")), F.lit("/>"))
    blocks = _listed(t["usp"], ["sent_id", "kind", "block_id"], ["member_id"], item, "items").withColumn("items", F.concat(F.lit("<uspblock>"), "items", F.lit("</uspblock>")))
    usp = _listed(blocks, ["sent_id", "kind"], ["block_id"], F.col("items"), "blocks").groupBy("sent_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("blocks"))).alias(f"usp_{k}") for k in ("frame", "fe")])
    rows = t["sentence"]
    for part in (ts, nts, frames, usp):
        rows = rows.join(part, "sent_id", "left")
    flag = lambda g: F.concat(F.lit("<global"), _attribute("type", g["type"]), _attribute("param", g["param"]), F.lit(">"), F.coalesce(g["text"], F.lit("")), F.lit("</global>"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    xml = F.concat(
        F.lit("<s"), _attribute("id", F.col("sent_id")), F.lit("><graph"), _attribute("root", F.col("root_id")), F.lit("><terminals>"), text("ts"), F.lit("</terminals><nonterminals>"), text("nts"),
        F.lit("</nonterminals></graph><sem><globals>"), F.array_join(F.transform(F.coalesce("flags", F.array().cast("array<struct<type:string,param:string,text:string>>")), flag), ""),
        F.lit("</globals><frames>"), text("frames"), F.lit("</frames><usp><uspframes>"), text("usp_frame"), F.lit("</uspframes><uspfes>"), text("usp_fe"), F.lit("</uspfes></usp></sem></s>"),
    )
    return rows.select("sent_id", xml.alias("xml"))


_HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<corpus>\n<head/>\n<body>'
_FOOTER = "</body>\n</corpus>"


def _corpora(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sentences, between one header and one footer: a file holds one document."""
    begun = False
    for batch in batches:
        if batch.num_rows and not begun:
            begun = True
            yield pa.record_batch([pa.array([_HEADER])], ["value"])
        yield pa.record_batch([batch.column(0)], ["value"])
    if begun:
        yield pa.record_batch([pa.array([_FOOTER])], ["value"])


def write(t: dict[str, DataFrame], path: str) -> None:
    """Files of sentences between a corpus's header and footer, one corpus a file."""
    written(t).sortWithinPartitions("sent_id", "xml").select("xml").mapInArrow(_corpora, "value string").write.text(path)
