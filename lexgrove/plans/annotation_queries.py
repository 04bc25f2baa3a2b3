"""Queries that run instances, edits of annotation, neighbours and the whole of role labelling, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.operators import annotation, instances, trees
from lexgrove.operators import relational as rel
from lexgrove.plans import experiment
from lexgrove.plans.feature_queries import _TURN_TOKENS, _treebank, _turn_tokens
from lexgrove.plans.queries import _EDGES, _HASH, _forest, query, read

# -- instances --------------------------------------------------------------------------------------


@query(
    "SELECT o_custkey, lemma, sid, string_agg(sense, '|' ORDER BY o_orderkey, sense) AS senses FROM (SELECT o_custkey, regexp_replace(o_orderpriority, '\\s', '_', 'g') AS lemma, o_orderstatus AS sid, "
    "'w' || (o_orderkey % 7) AS sense, o_orderkey FROM orders) GROUP BY ALL"
)
def grouped_senses(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select("o_custkey", F.col("o_orderpriority").alias("lex"), F.lit("v").alias("pos"), F.col("o_orderstatus").alias("sid"), F.concat(F.lit("w"), F.col("o_orderkey") % 7).alias("sense"), "o_orderkey")
    return instances.grouped_senses(rows, "o_orderkey", ["o_custkey"]).select("o_custkey", "lemma", "sid", F.array_join("senses", "|").alias("senses"))


@query(
    "SELECT lemma, string_agg(sense, '|' ORDER BY k, sense) AS senses FROM (SELECT 'c' || o_custkey || '.' || o_orderstatus AS lemma, o_orderpriority AS sense, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY lemma"
)
def sense_inventory(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("lemma"), F.col("o_orderstatus").alias("pos"), F.col("o_orderpriority").alias("sense"), "o_orderkey")
    return instances.sense_inventory(rows, "o_orderkey").select("lemma", F.array_join("senses", "|").alias("senses"))


@query(
    "SELECT o_orderkey, '0=' || o_orderstatus || ' 1=' || o_orderpriority || ' ' || o_custkey AS indicators, "
    "row_number() OVER (ORDER BY o_orderkey) || ' ' || o_custkey || ' ' || o_orderstatus || ' ' || o_orderpriority AS numbered FROM orders"
)
def learner_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").select("o_orderkey", F.concat_ws(",", "o_orderstatus", "o_orderpriority", F.concat(F.col("o_custkey").cast("string"), F.lit("."))).alias("instance"))
    return instances.numbered_lines(rows, ["o_orderkey"]).select("o_orderkey", instances.indicator_line(F.col("instance")).alias("indicators"), "numbered")


@query(
    "WITH e AS (SELECT l_orderkey, string_agg(l_shipmode, '|' ORDER BY l_shipmode) AS elements FROM (SELECT l_orderkey, l_returnflag || l_linenumber AS l_shipmode FROM lineitem) GROUP BY l_orderkey) "
    f"SELECT o_custkey AS sent_id, o_orderpriority AS frame, coalesce(elements, '') AS elements, CASE WHEN {_HASH.format(repr('split:') + ' || o_custkey')} % 100 < 70 THEN 'train' ELSE 'test' END AS dataset "
    "FROM orders LEFT JOIN e ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 5000)"
)
def failed_parse_split(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as frames of their customers as sentences, of which those of high balance have a parse."""
    orders, lines = read(spark, folder, "orders"), read(spark, folder, "lineitem")
    frames = orders.select(F.col("o_custkey").alias("sent_id"), F.col("o_orderkey").alias("frame_id"), F.col("o_orderpriority").alias("frame"), F.col("o_orderstatus").alias("target"), F.lit("v").alias("target_pos"))
    elements = lines.select(F.col("l_orderkey").alias("frame_id"), F.concat("l_returnflag", "l_linenumber").alias("name")).join(frames.select("sent_id", "frame_id"), "frame_id")
    parsed = read(spark, folder, "customer").where("c_acctbal >= 5000").select(F.col("c_custkey").alias("sent_id"))
    found = instances.split_failed(instances.failed_parses(frames, elements, parsed), 70)
    return found.select("sent_id", "frame", F.array_join("elements", "|").alias("elements"), "dataset")


@query(f"SELECT conv_id, turn AS instance_id, 'W' || lemma AS \"column\", count(*) AS value FROM ({_TURN_TOKENS}) GROUP BY conv_id, turn, lemma")
def refeaturized_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix of one of two stored kinds of features."""
    tokens = _turn_tokens(spark, folder)
    kinds = F.array(F.struct(F.lit("W").alias("kind"), F.col("lemma").alias("feature")), F.struct(F.lit("P").alias("kind"), F.col("pos").alias("feature")))
    meta = tokens.select("conv_id", F.col("turn").alias("instance_id"), F.explode(kinds).alias("x")).select("conv_id", "instance_id", "x.*")
    return instances.refeaturized(meta, "keep", ["W"], group="conv_id")


_PLACED = (
    f"t AS (SELECT conv_id || 'x' || turn AS sent_id, conv_id, turn, nr, word, lemma FROM ({_TURN_TOKENS})), "
    "c AS (SELECT *, list(lemma) OVER (ORDER BY conv_id, turn, nr ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, list(lemma) OVER (ORDER BY conv_id, turn, nr ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r FROM t), "
    "s AS (SELECT sent_id, md5(regexp_replace(lower(string_agg(word, ' ' ORDER BY nr)), '[^a-z]', '', 'g')) AS k FROM t GROUP BY sent_id HAVING k <> md5('')), "
    "o AS (SELECT min(sent_id) AS own, k FROM s GROUP BY k)"
)


@query(
    f"WITH {_PLACED} SELECT own || '_' || c.nr AS instance_id, c.sent_id AS corpus_sent_id, coalesce(array_to_string(l, ' '), '') AS before, coalesce(array_to_string(r, ' '), '') AS after "
    "FROM o JOIN s USING (k) JOIN t ON t.sent_id = own JOIN c ON c.sent_id = s.sent_id AND c.nr = t.nr"
)
def sparse_context(spark: SparkSession, folder: str) -> DataFrame:
    """Each different turn's tokens as targets, with contexts wherever the turn occurs among all turns."""
    tokens = _turn_tokens(spark, folder).withColumn("sent_id", F.concat_ws("x", "conv_id", "turn"))
    corpus = rel.with_index(tokens, ["conv_id", "turn", "nr"], "place").select("place", "sent_id", F.col("nr").alias("pos"), "word", "lemma")
    letters = instances._letters(corpus)
    own = corpus.join(letters.groupBy("_letters").agg(F.min("sent_id").alias("sent_id")).select("sent_id"), "sent_id", "left_semi").drop("place")
    targets = own.select(F.concat_ws("_", "sent_id", F.col("pos") + 1).alias("instance_id"), "sent_id", "pos")
    found = instances.sparse_contexts(corpus, own, targets, "lemma", 2).where("corpus_sent_id is not null")
    return found.select("instance_id", "corpus_sent_id", F.array_join("left", " ").alias("before"), F.array_join("right", " ").alias("after"))


# -- annotation -------------------------------------------------------------------------------------


@query(
    f"WITH e AS ({_EDGES}), n AS (SELECT 'R' || r_regionkey AS node, 'S' AS cat FROM region UNION ALL SELECT 'N' || n_nationkey, 'VP' FROM nation UNION ALL SELECT 'C' || c_custkey, c_mktsegment FROM customer "
    "UNION ALL SELECT 'O' || o_orderkey, o_orderstatus FROM orders) SELECT child_id AS node_id, parent_id AS neighbour_id, 'U ' || label || ' ' || cat || ' ' AS path FROM e JOIN n ON node = parent_id "
    "UNION ALL SELECT parent_id, child_id, 'D ' || label || ' ' || cat || ' ' FROM e JOIN n ON node = child_id"
)
def tree_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return trees.neighbours(*_forest(spark, folder)).select("node_id", "neighbour_id", trees.printed(F.col("path")).alias("path"))


@query(
    "WITH c AS (SELECT 'c' || c_custkey AS s, c_acctbal < 0 AS passive, c_acctbal >= 5000 AS rich FROM customer), "
    "x AS (SELECT s, '_f1' AS f, 'Buyer' AS name, s || '_f1_Buyer' AS e, CASE WHEN passive THEN s || '_504' ELSE s || '_501' END AS n FROM c WHERE NOT rich "
    "UNION ALL SELECT s, '_f1', 'Buyer', s || '_f1_Buyer', s || '_501 ' || s || '_505' FROM c WHERE rich "
    "UNION ALL SELECT s, '_f1', 'Goods', s || '_f1_Goods', CASE WHEN passive THEN s || '_501' ELSE s || '_503' END FROM c WHERE NOT rich "
    "UNION ALL SELECT s, '_f2', 'Debtor', s || '_f2_e1', s || '_505' FROM c WHERE passive) "
    "SELECT s AS sent_id, s || f AS frame_id, name, CASE WHEN n LIKE '% %' THEN s || f || '_' || name ELSE e END AS fe_id, n AS nodes FROM x"
)
def frame_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The elements by name after edits: a frame of debts, a second buyer of the rich, whose goods go."""
    t = _treebank(spark, folder)
    customers = read(spark, folder, "customer").withColumn("sent_id", F.concat(F.lit("c"), "c_custkey"))
    debts, rich = customers.where("c_acctbal < 0").select("sent_id"), customers.where("c_acctbal >= 5000").select("sent_id")
    at = lambda rows, node: rows.withColumn("node_ids", F.array(F.concat("sent_id", F.lit(f"_{node}"))))
    t = annotation.add_frames(t, debts.withColumn("name", F.lit("Debt")))
    extra = t["frame"].where("name = 'Debt'").select("sent_id", "frame_id", F.lit("Debtor").alias("name"))
    second = t["frame"].where("name = 'Commerce'").join(rich, "sent_id").select("sent_id", "frame_id", F.lit("Buyer").alias("name"))
    t = annotation.add_elements(t, at(extra.unionAll(second), 505))
    t = annotation.remove_elements(t, t["fe"].where("name = 'Goods'").join(rich, "sent_id"))
    return annotation.combined_elements(t).select("sent_id", "frame_id", "name", "fe_id", F.array_join("node_ids", " ").alias("nodes"))


# -- the whole of role labelling --------------------------------------------------------------------


@query(
    f"WITH s AS (SELECT count(*) AS n FROM customer WHERE {_HASH.format(repr('split:c') + " || c_custkey || '---c' || c_custkey || '_f1'")} % 100 >= 90), k(class, m) AS (VALUES ('Buyer', 1), ('Goods', 1), ('NONE', 10)) "
    "SELECT 'Commerce' AS frame, class, n * m AS gold, n * m AS assigned, n * m AS truepos, 1.0::DOUBLE AS f FROM s, k WHERE n > 0"
)
def role_labelling(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a whole run: roles follow from the features here, so all must be found."""
    run = experiment.run_roles(experiment.featurized(_treebank(spark, folder), height=8))
    return run.by_class().select(F.col("grp").alias("frame"), "class", "gold", "assigned", "truepos", "f")
