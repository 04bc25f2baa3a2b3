"""Edits of the semantic tables of sentences (see sources.stxml): each gives new tables, none changes in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def _with_ids(added: DataFrame, known: DataFrame, scope: list[str], name: str, mark: str) -> DataFrame:
    """added with an id where it has none: its scope's last key, the mark and a number after the largest in use."""
    number = F.nullif(F.regexp_extract(name, rf"_{mark}(\d+)$", 1), F.lit("")).cast("long")
    most = known.groupBy(*scope).agg(F.max(number).alias("_most"))
    rows = added if name in added.columns else added.withColumn(name, F.lit(None).cast("string"))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy("name", F.col(name).asc_nulls_last()))
    numbered = rows.withColumn("_place", place).join(most, scope, "left")
    fresh = F.concat(scope[-1], F.lit(f"_{mark}"), (F.coalesce("_most", F.lit(0)) + F.col("_place")).cast("string"))
    return numbered.withColumn(name, F.coalesce(name, fresh)).drop("_most", "_place")


def _after(rows: DataFrame, known: DataFrame, scope: list[str], name: str) -> DataFrame:
    """rows with a place behind those in use."""
    last = known.groupBy(*scope).agg(F.max(name).alias("_last"))
    place = F.row_number().over(Window.partitionBy(*scope).orderBy(*[c for c in ("frame_id", "fe_id", "node_id") if c in rows.columns]))
    return rows.withColumn("_place", place).join(last, scope, "left").withColumn(name, F.greatest(F.coalesce("_last", F.lit(-1)), F.lit(-1)) + F.col("_place")).drop("_last", "_place")


def add_frames(t: Tables, added: DataFrame) -> Tables:
    """added: (sent_id, name) and maybe frame_id."""
    rows = _after(_with_ids(added, t["frame"], ["sent_id"], "frame_id", "f"), t["frame"], ["sent_id"], "frame_ord")
    return t | {"frame": t["frame"].unionByName(rows.select("sent_id", "frame_id", "name", F.col("frame_ord").cast("int").alias("frame_ord")))}


def remove_frames(t: Tables, gone: DataFrame) -> Tables:
    """Without frames (sent_id, frame_id), their elements, and the underspecification of either."""
    gone = gone.select("sent_id", "frame_id").distinct()
    without = remove_elements(t, t["fe"].join(gone, ["sent_id", "frame_id"], "left_semi"))
    members = gone.select("sent_id", F.lit("frame").alias("kind"), F.col("frame_id").alias("member_id"))
    return without | {"frame": t["frame"].join(gone, ["sent_id", "frame_id"], "left_anti")} | _without_members(without, members)


def add_elements(t: Tables, added: DataFrame) -> Tables:
    """added: (sent_id, frame_id, name, node_ids array) and maybe fe_id; a frame gets no second target."""
    held = t["fe"].where("is_target").select("sent_id", "frame_id").distinct().withColumn("name", F.lit("target"))
    rows = _with_ids(added.join(held, ["sent_id", "frame_id", "name"], "left_anti"), t["fe"], ["sent_id", "frame_id"], "fe_id", "e")
    rows = _after(rows, t["fe"], ["sent_id", "frame_id"], "fe_ord").withColumn("is_target", F.col("name") == "target")
    none = F.lit(None).cast("string")
    place = F.when(F.col("is_target"), -1).otherwise(F.col("fe_ord")).cast("int")
    elements = rows.select("sent_id", "frame_id", "fe_id", "name", "is_target", none.alias("lemma"), none.alias("pos"), place.alias("fe_ord"))
    nodes = rows.select("sent_id", "fe_id", F.posexplode("node_ids").alias("ord", "node_id")).select("sent_id", "fe_id", "node_id", "ord")
    return t | {"fe": t["fe"].unionByName(elements), "fe_node": t["fe_node"].unionByName(nodes)}


def remove_elements(t: Tables, gone: DataFrame) -> Tables:
    """Without elements (sent_id, fe_id), their nodes and their underspecification."""
    gone = gone.select("sent_id", "fe_id").distinct()
    members = gone.select("sent_id", F.lit("fe").alias("kind"), F.col("fe_id").alias("member_id"))
    return t | {name: t[name].join(gone, ["sent_id", "fe_id"], "left_anti") for name in ("fe", "fe_node")} | _without_members(t, members)


def _without_members(t: Tables, members: DataFrame) -> Tables:
    return {"usp": t["usp"].join(members, ["sent_id", "kind", "member_id"], "left_anti").select(*t["usp"].columns)} if "usp" in t else {}


def add_element_nodes(t: Tables, added: DataFrame) -> Tables:
    """added: (sent_id, fe_id, node_id); nodes that an element has stay as they are."""
    new = added.select("sent_id", "fe_id", "node_id").distinct().join(t["fe_node"], ["sent_id", "fe_id", "node_id"], "left_anti")
    rows = _after(new, t["fe_node"], ["sent_id", "fe_id"], "ord")
    return t | {"fe_node": t["fe_node"].unionByName(rows.withColumn("ord", F.col("ord").cast("int")).select("sent_id", "fe_id", "node_id", "ord"))}


def remove_element_nodes(t: Tables, gone: DataFrame) -> Tables:
    keys = ["sent_id", "fe_id", "node_id"]
    return t | {"fe_node": t["fe_node"].join(gone.select(*keys), keys, "left_anti").select(*t["fe_node"].columns)}


def add_usp(t: Tables, added: DataFrame) -> Tables:
    """added: (sent_id, kind frame or fe, members array): a block of alternatives each row."""
    order = Window.partitionBy("sent_id", "kind").orderBy("members")
    last = t["usp"].groupBy("sent_id", "kind").agg(F.max("block_id").alias("_last"))
    rows = added.withColumn("_place", F.row_number().over(order)).join(last, ["sent_id", "kind"], "left")
    blocks = rows.select("sent_id", (F.coalesce("_last", F.lit(-1)) + F.col("_place")).cast("int").alias("block_id"), "kind", F.explode("members").alias("member_id"))
    return t | {"usp": t["usp"].unionByName(blocks)}


def remove_usp(t: Tables, gone: DataFrame) -> Tables:
    keys = ["sent_id", "kind", "block_id"]
    return t | {"usp": t["usp"].join(gone.select(*keys), keys, "left_anti").select(*t["usp"].columns)}


_FLAG = "struct<type:string,param:string,text:string>"


def _flags(rows: DataFrame) -> DataFrame:
    flag = F.struct("type", "param", "text").cast(_FLAG)
    return rows.groupBy("sent_id").agg(F.array_sort(F.collect_list(flag)).alias("_flags"))


def add_flags(t: Tables, added: DataFrame) -> Tables:
    """added: (sent_id, type, param, text)."""
    none = F.array().cast(f"array<{_FLAG}>")
    joined = t["sentence"].join(_flags(added), "sent_id", "left")
    return t | {"sentence": joined.withColumn("flags", F.concat(F.coalesce("flags", none), F.coalesce("_flags", none))).select(*t["sentence"].columns)}


def remove_flags(t: Tables, gone: DataFrame) -> Tables:
    """Without flags (sent_id, type, param, text) of equal values, null as a value."""
    joined = t["sentence"].join(_flags(gone), "sent_id", "left")
    left = F.filter("flags", lambda f: ~F.exists("_flags", lambda g: f["type"].eqNullSafe(g["type"]) & f["param"].eqNullSafe(g["param"]) & f["text"].eqNullSafe(g["text"])))
    return t | {"sentence": joined.withColumn("flags", F.when(F.col("_flags").isNull(), F.col("flags")).otherwise(left)).select(*t["sentence"].columns)}


def without_semantics(t: Tables) -> Tables:
    """The sentences with their parses alone."""
    return t | {name: t[name].limit(0) for name in ("frame", "fe", "fe_node", "usp") if name in t}


def combined_elements(t: Tables) -> DataFrame:
    """(sent_id, frame_id, name, fe_id, node_ids): an element for each name of a frame, but not its target.

    Elements of one name become one, whose id is the frame's and the name; a node counts once.
    """
    nodes = t["fe"].where("not is_target").join(t["fe_node"], ["sent_id", "fe_id"], "left")
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("node_id").isNotNull(), F.struct("fe_ord", "fe_id", "ord", "node_id")))), lambda x: x["node_id"]))
    found = nodes.groupBy("sent_id", "frame_id", "name").agg(F.count_distinct("fe_id").alias("_n"), F.min("fe_id").alias("_only"), listed.alias("node_ids"))
    return found.select("sent_id", "frame_id", "name", F.when(F.col("_n") == 1, F.col("_only")).otherwise(F.concat_ws("_", "frame_id", "name")).alias("fe_id"), "node_ids")


def with_head_words(nodes: DataFrame, heads: DataFrame, missing: str = "--") -> DataFrame:
    """nodes whose phrases have their head's word in head; heads: (sent_id, node_id, head_id)."""
    words = nodes.where("kind = 't'").select("sent_id", F.col("node_id").alias("head_id"), F.col("word").alias("_word"))
    of = heads.select("sent_id", "node_id", "head_id").join(words, ["sent_id", "head_id"]).drop("head_id")
    joined = nodes.drop("head").join(of, ["sent_id", "node_id"], "left")
    return joined.withColumn("head", F.when(F.col("kind") == "nt", F.coalesce("_word", F.lit(missing)))).drop("_word")
