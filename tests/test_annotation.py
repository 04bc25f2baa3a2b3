"""Edits of annotation, neighbours, closures without a known height, tables of a catalog, and a whole run."""

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import annotation, trees
from lexgrove.operators import relational as rel
from lexgrove.plans import experiment


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in (columns or frame.columns)) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    flags = "array<struct<type:string,param:string,text:string>>"
    return {
        "sentence": spark.createDataFrame([("s1", "500", [("REEXAMINE", None, "x")]), ("s2", "500", None)], f"sent_id string, root_id string, flags {flags}"),
        "frame": spark.createDataFrame([("s1", "s1_f7", "Motion", 0)], "sent_id string, frame_id string, name string, frame_ord int"),
        "fe": spark.createDataFrame(
            [("s1", "s1_f7", "s1_f7_t", "target", True, "go", "v", -1), ("s1", "s1_f7", "s1_f7_e2", "Goal", False, None, None, 0), ("s1", "s1_f7", "s1_f7_e1", "Theme", False, None, None, 1)],
            "sent_id string, frame_id string, fe_id string, name string, is_target boolean, lemma string, pos string, fe_ord int",
        ),
        "fe_node": spark.createDataFrame([("s1", "s1_f7_t", "1", 0), ("s1", "s1_f7_e2", "2", 0), ("s1", "s1_f7_e1", "3", 0)], "sent_id string, fe_id string, node_id string, ord int"),
        "usp": spark.createDataFrame([("s1", 0, "fe", "s1_f7_e1"), ("s1", 0, "fe", "s1_f7_e2"), ("s1", 0, "frame", "s1_f7")], "sent_id string, block_id int, kind string, member_id string"),
    }


def test_frames_get_free_ids_and_go_with_what_hangs_on_them(spark, tables):
    t = annotation.add_frames(tables, spark.createDataFrame([("s1", "Seeking"), ("s1", "Being"), ("s2", "Being")], "sent_id string, name string"))
    assert rows(t["frame"], "frame_id", "name", "frame_ord") == [("s1_f7", "Motion", 0), ("s1_f8", "Being", 1), ("s1_f9", "Seeking", 2), ("s2_f1", "Being", 0)]
    t = annotation.remove_frames(t, spark.createDataFrame([("s1", "s1_f7"), ("s1", "none")], "sent_id string, frame_id string"))
    assert rows(t["frame"], "frame_id") == [("s1_f8",), ("s1_f9",), ("s2_f1",)]
    assert t["fe"].count() == t["fe_node"].count() == t["usp"].count() == 0


def test_elements_are_added_combined_and_removed(spark, tables):
    added = spark.createDataFrame([("s1", "s1_f7", "Goal", ["4", "2"]), ("s1", "s1_f7", "target", ["9"])], "sent_id string, frame_id string, name string, node_ids array<string>")
    t = annotation.add_elements(tables, added)
    assert rows(t["fe"], "fe_id", "name", "fe_ord")[1:] == [("s1_f7_e2", "Goal", 0), ("s1_f7_e3", "Goal", 2), ("s1_f7_t", "target", -1)]
    assert rows(annotation.combined_elements(t), "name", "fe_id", "node_ids") == [("Goal", "s1_f7_Goal", ["2", "4"]), ("Theme", "s1_f7_e1", ["3"])]
    t = annotation.remove_elements(t, t["fe"].where("name = 'Goal'"))
    assert rows(t["fe"], "fe_id") == [("s1_f7_e1",), ("s1_f7_t",)] and rows(t["usp"], "kind", "member_id") == [("fe", "s1_f7_e1"), ("frame", "s1_f7")]
    assert rows(annotation.combined_elements(annotation.without_semantics(t))) == []


def test_nodes_of_elements(spark, tables):
    one = spark.createDataFrame([("s1", "s1_f7_e1", "5"), ("s1", "s1_f7_e1", "3"), ("s1", "s1_f7_e1", "5")], "sent_id string, fe_id string, node_id string")
    t = annotation.add_element_nodes(tables, one)
    assert rows(t["fe_node"].where("fe_id = 's1_f7_e1'"), "node_id", "ord") == [("3", 0), ("5", 1)]
    assert rows(annotation.remove_element_nodes(t, one)["fe_node"], "node_id") == [("1",), ("2",)]


def test_underspecification_and_flags(spark, tables):
    t = annotation.add_usp(tables, spark.createDataFrame([("s1", "fe", ["a", "b"]), ("s2", "frame", ["c"])], "sent_id string, kind string, members array<string>"))
    assert rows(t["usp"].where("member_id in ('a', 'b', 'c')"), "sent_id", "block_id", "member_id") == [("s1", 1, "a"), ("s1", 1, "b"), ("s2", 0, "c")]
    assert rows(annotation.remove_usp(t, spark.createDataFrame([("s1", "fe", 0)], "sent_id string, kind string, block_id int"))["usp"], "member_id") == [("a",), ("b",), ("c",), ("s1_f7",)]
    flag = spark.createDataFrame([("s1", "LATER", "p", None), ("s2", "LATER", None, None)], "sent_id string, type string, param string, text string")
    t = annotation.add_flags(tables, flag)
    assert [(r["sent_id"], len(r["flags"])) for r in t["sentence"].orderBy("sent_id").collect()] == [("s1", 2), ("s2", 1)]
    assert [[f["type"] for f in r["flags"]] for r in annotation.remove_flags(t, flag)["sentence"].orderBy("sent_id").collect()] == [["REEXAMINE"], []]


def test_head_words(spark):
    nodes = spark.createDataFrame([("s", "1", "t", "dog", None), ("s", "500", "nt", None, "old"), ("s", "501", "nt", None, None)], "sent_id string, node_id string, kind string, word string, head string")
    heads = spark.createDataFrame([("s", "500", "1"), ("s", "501", None)], "sent_id string, node_id string, head_id string")
    assert rows(annotation.with_head_words(nodes, heads), "node_id", "head") == [("1", None), ("500", "dog"), ("501", "--")]


def chain(spark, length):
    return spark.range(length).select(F.lit("s").alias("sent_id"), F.col("id").cast("string").alias("parent_id"), (F.col("id") + 1).cast("string").alias("child_id"), F.lit("HD").alias("label"))


def test_closure_goes_on_to_the_root(spark):
    assert trees.closure(chain(spark, 100)).count() == 100 * 101 // 2
    assert trees.closure(chain(spark, 3).limit(0)).count() == 0


def test_closure_of_a_cycle_raises(spark, monkeypatch):
    monkeypatch.setattr(trees, "MOST_HEIGHT", 8)
    cycle = spark.createDataFrame([("s", "a", "b", "x"), ("s", "b", "a", "x")], "sent_id string, parent_id string, child_id string, label string")
    with pytest.raises(ValueError, match="cycle"):
        trees.closure(cycle)


def test_neighbours_have_paths_of_one_step(spark):
    nodes = spark.createDataFrame([("s", "0", "S"), ("s", "1", "VP"), ("s", "2", None)], "sent_id string, node_id string, cat string")
    found = trees.neighbours(nodes, chain(spark, 2)).select("node_id", "neighbour_id", trees.printed(F.col("path")).alias("path"))
    assert rows(found) == [("0", "1", "D HD VP "), ("1", "0", "U HD S "), ("1", "2", "D HD - "), ("2", "1", "U HD VP ")]


def test_columns_and_temporary_tables_go(spark):
    catalog = rel.Catalog(spark)
    catalog.create("edited", spark.createDataFrame([(1, "a", "b")], "row_id long, x string, y string"))
    assert catalog.drop_column("edited", "x").columns == ["row_id", "y"] and rows(catalog.open("edited")) == [(1, "b")]
    for column in ("row_id", "x"):
        with pytest.raises(ValueError, match="can go"):
            catalog.drop_column("edited", column)
    catalog.drop("edited")
    assert catalog.make_temporary("passing", spark.range(3)).count() == 3 and "passing" not in catalog.tables()
    assert catalog.drop_temporary("passing") and not catalog.drop_temporary("passing")


def test_a_run_with_groups_that_training_lacks(spark):
    """Rows whose group has no model get no value; pruned rows too."""
    data = [(f"s{i}", f"s{i} {n}", "go", "A" if i < 40 else "B", f"x{n}", int(n != 3), ("Theme", "Goal", "NONE", "NONE")[n]) for i in range(44) for n in range(4)]
    table = spark.createDataFrame(data, "sentid string, nodeID string, target string, frame string, pt string, prune int, gold string")
    table = table.withColumn(experiment.KEY, F.col("nodeID")).withColumn("dataset", F.when(F.col("sentid") < "s3", "train").when(F.col("frame") == "B", "test").otherwise("test"))
    run = experiment.run_roles(table.where("frame = 'A' or dataset = 'test'"), ["pt"])
    wrong = run.labelled.where("(frame = 'A' and gold <> arglab) or (frame = 'B' and arglab <> 'NONE')")
    assert wrong.count() == 0 and run.labelled.where("arglab = 'Theme'").count() > 0
    assert {r["class"] for r in run.by_class("argrec").collect()} == {"FE", "NONE"} and run.overall().first()["instances"] == run.labelled.count()
