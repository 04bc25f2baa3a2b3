"""Operators on hand-made rows: nulls, ties, quirks and tree invariants."""

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import linguistics as lx
from lexgrove.functions import text as fn
from lexgrove.operators import evaluation as ev
from lexgrove.operators import induction, learners, trees, windows
from lexgrove.operators import matrix as mx
from lexgrove.operators import relational as rel
from lexgrove.plans import role_features, sense_features
from lexgrove.sources import framenet, sinks, stxml, tabular


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in (columns or frame.columns)) for r in frame.collect()), key=str)


# -- scalars ----------------------------------------------------------------------------------------


def test_escapes_round_trip(spark):
    texts = ["a \"b\" 'c' `d`", "x<y & z>", "", "é, ; : \\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows(df.select(fn.unquote_literal(fn.quote_literal(F.col("t"))))) == sorted((t,) for t in texts)
    assert df.select(fn.escape_xml(F.lit('``"<&>\''))).first()[0] == "&quot;&apos;&apos;&lt;&amp;&gt;&apos;"
    assert df.select(fn.escape_field(F.lit("a,b;c:d"))).first()[0] == "aCOMMAbSEMICOLONcCOLONd"
    lemma, pos = fn.split_lemma_pos(fn.lemma_pos(F.lit("look.up"), F.lit("v.b")))
    assert tuple(df.select(lemma, pos).first()) == ("look.up", "vDOTb")
    assert fn.to_entities("aé") == "a&#xe9;" and fn.from_entities("a&#xe9;&#233;") == "aéé"


def test_templates():
    t = fn.Template("<lemma>.<pos>/<lemma>.txt")
    assert t.fill(lemma="go", pos="v") == "go.v/go.txt"
    assert t.match("go.v/go.txt") == {"lemma": "go", "pos": "v"} and t.match("go.v/run.txt") is None
    assert t.match("go.v/go.txt", pos="v") == {"lemma": "go", "pos": "v"} and t.match("go.v/go.txt", pos="n") is None


# -- tables -----------------------------------------------------------------------------------------


def test_views_and_tables(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "b", "x")], "k int, g string, v string")
    with pytest.raises(ValueError):
        rel.view(df, [])
    assert rows(rel.view(df, ["g"], [rel.Where("k", 1, equal=False)], distinct=True)) == [("b",)]
    assert rows(rel.gold_last(df, ["v"], "g").select("instance")) == [("NONE,a",), ("x,b",), ("x,b",)]
    new = spark.createDataFrame([(1, None), (3, "new")], "k int, v string")
    assert rows(rel.updated(df, "k", new, "v"), "k", "v") == [(1, None), (2, "x"), (3, "new")]
    assert rel.with_results(df, ["v", "r"]).columns == ["k", "g", "v", "r"]
    with pytest.raises(ValueError):
        rel.check_columns(df, ["k", "g"])
    assert [r["row_id"] for r in rel.with_index(df, ["k"]).orderBy("k").collect()] == [0, 1, 2]


def test_catalog(spark):
    catalog = rel.Catalog(spark)
    df = spark.createDataFrame([(1, "a")], "k int, g string")
    with pytest.raises(ValueError):
        catalog.create("t_words", df, ["nope"])
    catalog.create("t_words", df, ["k"])
    catalog.insert("t_words", df)
    assert catalog.count("t_words") == 2 and catalog.columns("t_words") == [("k", "int"), ("g", "string")] and "t_words" in catalog.tables()
    assert catalog.contents("t_words", 1).count() == 1
    with pytest.raises(ValueError):
        catalog.drop_all()
    catalog.drop("t_words")
    assert "t_words" not in catalog.tables()


def test_splits_are_stable_and_whole(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    one = dict(rows(rel.split(df, "k", 80), "k", "dataset"))
    two = dict(rows(rel.split(df.repartition(7), "k", 80), "k", "dataset"))
    assert one == two and 0.77 < sum(v == "train" for v in one.values()) / 5000 < 0.83
    assert set(dict(rows(rel.split(df, "k", 100), "k", "dataset")).values()) == {"train"}
    with pytest.raises(ValueError):
        rel.split(df, "k", 101)


def test_runs(spark):
    runs = spark.createDataFrame([(0, "t", "argrec", ["m"], ["b", "a"], ["frame"], True), (1, "t", "argrec", ["m"], ["a"], ["frame"], False), (2, "t", "arglab", ["m"], ["a"], [], True)], rel.RUN_SCHEMA)
    assert rows(rel.find_run(runs, "t", "argrec", ["m"], ["a", "b"], ["frame"]), "run_id") == [(0,)]
    assert rel.find_run(runs, "t", "argrec", ["m"], ["a"], ["frame"]).isEmpty()
    assert not rel.find_run(rel.confirm_run(runs, "t", 1), "t", "argrec", ["m"], ["a"], ["frame"]).isEmpty()
    assert rows(rel.next_run_id(runs)) == [("t", 3)]


# -- evaluation -------------------------------------------------------------------------------------


def test_evaluation_quirks(spark):
    data = [("g", "A", "A"), ("g", "A", "B"), ("g", None, "A"), ("g", "-", "-"), ("g", "", None), ("h", None, "C"), ("g", None, None)]
    df = spark.createDataFrame(data, "grp string, gold_label string, assigned_label string")
    counts = {(r[0], r[1]): tuple(r[2:]) for r in rows(ev.class_counts(df), "grp", "class", "gold", "assigned", "truepos")}
    assert counts == {("g", "A"): (2, 2, 1), ("g", "B"): (0, 1, 0)}  # h has no gold
    assert rows(ev.group_accuracy(df), "grp", "instances", "truepos") == [("g", 6, 3)]  # equal marks and nulls count
    assert rows(ev.overall(df), "instances", "truepos") == [(7, 3)]
    prf = {r["class"]: (r["prec"], r["rec"], r["f"]) for r in ev.group_class_prf(df).collect()}
    assert prf == {"A": (0.5, 0.5, 0.5), "B": (0.0, 0.0, 0.0)}
    failed = spark.createDataFrame([("g", "A")] * 3 + [("z", "N")] * 2, "grp string, class string")
    injected = {(r["grp"], r["class"]): r["gold"] for r in ev.with_injected_gold(ev.class_counts(df), failed, 2).collect()}
    assert injected == {("g", "A"): 4, ("g", "B"): 0, ("z", "N"): 1}


def test_role_steps(spark):
    df = spark.createDataFrame([("X", "FE", "Y", 1), ("NONE", "NONE", "Z", 0)], "gold string, argrec string, arglab string, prune int")
    labels = lambda step: rows(ev.step_labels(df, step), "gold_label", "assigned_label")
    assert labels("argrec") == [("FE", "FE"), ("NONE", "NONE")] and labels("all") == [("NONE", "NONE"), ("X", "Y")]
    assert labels("prune") == [("FE", "FE"), ("NONE", "NONE")] and labels("arglab") == [("NONE", "Z"), ("X", "Y")]


def test_sense_evaluation(spark):
    inst = spark.createDataFrame([("l", 1, ["a"]), ("l", 1, ["a"]), ("l", 2, ["b", "c"]), ("l", 3, ["a"])], "lemma string, instance_id int, gold array<string>")
    answers = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "c", 0.9), (2, "a", 0.1)], "instance_id int, sense string, confidence double")
    assert rows(ev.lenient_accuracy(inst, answers), "lemma", "instances", "truepos") == [("l", 2, 2)]  # ties by name; 3 has no answers
    inventory = spark.createDataFrame([("l", "a"), ("l", "b"), ("l", "c")], "lemma string, sense string")
    assert ev.thresholded(inst, answers, inventory, 0.5).where("assigned_label = 'true'").count() == 3
    tau = ev.kendall_tau(spark.createDataFrame([("g", 1.0, 1.0), ("g", 2.0, 2.0), ("g", 3.0, 3.0), ("h", 1.0, 2.0), ("h", 2.0, 1.0)], "grp string, x double, y double"), "grp", "x", "y")
    assert rows(tau) == [("g", 1.0), ("h", -1.0)]


# -- sequences --------------------------------------------------------------------------------------


def test_contexts(spark):
    df = spark.createDataFrame([("d", i, w) for i, w in enumerate("abcdefghij")], "doc string, i long, w string")
    whole = {r["i"]: (r["left"], r["right"]) for r in windows.symmetric_context(df, ["doc"], ["i"], "w", 2).collect()}
    assert whole[0] == ([], ["b", "c"]) and whole[5] == (["d", "e"], ["g", "h"])
    chunked = {r["i"]: (r["left"], r["right"]) for r in windows.chunked_context(df, "i", "w", 2, chunk=3).collect()}
    assert chunked == whole
    slots = {r["i"]: r["left"] for r in windows.context_slots(df, ["doc"], ["i"], "w", 2).collect()}
    assert slots[0] == [None, None] and slots[1] == [None, "a"]


def test_spans(spark):
    tags = ["B-x", "B-y", "E-y", "E-x", "B-z:E-z", "E-q", "B-x", "B-x", "E-x"]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(tags)], "s string, i int, tag string")
    assert rows(windows.decode_spans(df, ["s"], "i", "tag"), "label", "first", "last") == [("x", 0, 3), ("x", 7, 8), ("y", 1, 2), ("z", 4, 4)]
    assert rows(windows.broken_spans(df, ["s"], "i", "tag"), "label", "side", "place") == [("q", "E", 5), ("x", "B", 6)]
    spans = spark.createDataFrame([("s", 1, 3, 8), ("s", 2, 40, 41)], "s string, span_id int, start int, stop int")
    words = spark.createDataFrame([("s", 0, 4), ("s", 6, 9)], "s string, w_start int, w_stop int")
    assert rows(windows.snap_spans(spans, words, ["s"])) == [("s", 1, 0, 9)]
    assert rows(windows.islands(spark.createDataFrame([("s", i, v) for i, v in enumerate(["a", "a", None, None, "a"])], "s string, i int, v string"), ["s"], ["i"], "v"), "i", "island") == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]


# -- matrices ---------------------------------------------------------------------------------------


def test_matrix_counts_of_ten_eleven_and_three(spark):
    data = [("l", 1, "f")] * 10 + [("l", 2, "f")] * 11 + [("l", 3, "f")] * 3 + [("l", 4, "new")]
    df = spark.createDataFrame(data, "lemma string, instance_id int, feature string")
    vocab = mx.vocabulary(df.where("feature = 'f'"))
    assert rows(vocab) == [("l", "f", 11)]
    assert rows(mx.matrix(df, vocab, "keep"), "instance_id", "value") == [(1, 10), (2, 11), (3, 3)]
    assert mx.matrix(df, vocab, "repeat").count() == 24
    binned = rows(mx.matrix(df, vocab, "bin"), "instance_id", "column")
    assert binned == [(2, "f 0/2"), (3, "f 0/2")]  # multiples of ten give 0 in parity mode
    assert rows(mx.matrix(df, vocab, "bin", strict_parity=False), "instance_id", "column") == [(1, "f 0/2"), (2, "f 0/2"), (2, "f 1/2"), (3, "f 0/2")]
    assert mx.columns(vocab, "bin").count() == 2 and mx.columns(vocab, "repeat").count() == 11


def test_labels_and_purity(spark):
    inst = spark.createDataFrame([(1, "l", ["b", "a", "b"]), (2, "l", ["a"]), (3, "m", [])], "i int, lemma string, labels array<string>")
    assert rows(mx.repeated_labels(inst, "labels"), "i", "labels") == [(1, "a"), (1, "b"), (2, "a")]
    assert rows(mx.binarized(inst, "lemma", "labels"), "i", "sense", "target") == [(1, "a", "a"), (1, "b", "b"), (2, "a", "a"), (2, "b", "NONE")]
    df = spark.createDataFrame([("u", "1", "A"), ("u", "2", "A"), ("v", "2", "B"), (None, "1", "A")], "f string, g string, label string")
    pure = mx.pure_values(df, ["f", "g"], "label")
    assert rows(pure) == [("f", "u", "A"), ("f", "v", "B"), ("g", "1", "A")]
    assert rows(mx.apply_purity(df, ["f", "g"], "label", pure), "f", "g") == [("f0_A", "2"), ("f0_A", "f1_A"), ("f0_B", "2"), (None, "f1_A")]


# -- trees ------------------------------------------------------------------------------------------

XML = """<?xml version="1.0" encoding="UTF-8"?>
<corpus><head/><body>
<s id="s1"><graph root="s1_500"><terminals>
<t id="s1_1" word="The" lemma="the" pos="DT"/><t id="s1_2" word="dog" lemma="dog" pos="NN"/><t id="s1_3" word="was" lemma="be" pos="VBD"/>
<t id="s1_4" word="seen" lemma="see|saw" pos="VBN"/><t id="s1_5" word="by" lemma="by" pos="IN"/><t id="s1_6" word="Ann" lemma="&lt;unknown&gt;" pos="NNP"/><t id="s1_7" word="." pos="."/></terminals>
<nonterminals><nt id="s1_500" cat="S"><edge idref="s1_501" label="SB"/><edge idref="s1_502" label="HD"/><edge idref="s1_7" label="-"/></nt>
<nt id="s1_501" cat="NP"><edge idref="s1_1" label="-"/><edge idref="s1_2" label="-"/></nt>
<nt id="s1_502" cat="VP"><edge idref="s1_3" label="-"/><edge idref="s1_503" label="-"/></nt>
<nt id="s1_503" cat="VP"><edge idref="s1_4" label="-"/><edge idref="s1_504" label="-"/><other_edge idref="s1_501" label="link"/></nt>
<nt id="s1_504" cat="PP"><edge idref="s1_5" label="-"/><edge idref="s1_6" label="-"/></nt></nonterminals></graph>
<sem><globals><global type="flag" param="p">text</global></globals><frames><frame id="s1_f1" name="Perception">
<target id="s1_f1_t" lemma="see" pos="v"><fenode idref="s1_4"/></target><fe id="s1_f1_e1" name="Phenomenon"><fenode idref="s1_501"/></fe><fe id="s1_f1_e2" name="Perceiver"><fenode idref="s1_504"/></fe></frame>
</frames><usp><uspframes/><uspfes><uspblock><uspitem idref="s1_f1_e1"/><uspitem idref="s1_f1_e2"/></uspblock></uspfes></usp></sem></s>
<s id="s2"><graph root="s2_500"><terminals><t id="s2_1" word="Dogs" lemma="dog" pos="NNS"/><t id="s2_2" word="bark" lemma="bark" pos="VBP"/></terminals>
<nonterminals><nt id="s2_500" cat="S"><edge idref="s2_1" label="SB"/><edge idref="s2_2" label="HD"/></nt></nonterminals></graph>
<sem><globals/><frames/><usp><uspframes/><uspfes/></usp></sem></s>
</body></corpus>"""


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stxml") / "a.xml"
    path.write_text(XML)
    return stxml.tables(stxml.read(spark, str(path)))


@pytest.fixture(scope="module")
def graph(corpus):
    nodes, edges = corpus["syn_node"], corpus["syn_edge"].where("is_tree")
    up = trees.closure(edges)
    return nodes, edges, up


def test_stxml_tables(corpus):
    assert {k: v.count() for k, v in corpus.items()} == {"sentence": 2, "syn_node": 15, "syn_edge": 14, "frame": 1, "fe": 3, "fe_node": 3, "usp": 2}
    assert rows(corpus["syn_edge"].where("not is_tree"), "parent_id", "child_id", "label") == [("s1_503", "s1_501", "link")]
    assert rows(corpus["syn_node"].where("is_punct"), "node_id") == [("s1_7",)]


def test_stxml_round_trip(spark, corpus, tmp_path):
    stxml.write(corpus, str(tmp_path / "out"))
    again = stxml.tables(stxml.read(spark, str(tmp_path / "out")))
    for name, table in corpus.items():
        assert rows(again[name].drop("file")) == rows(table.drop("file")), name


def test_tree_invariants(graph):
    nodes, edges, up = graph
    assert {tuple(r) for r in rows(up.where("node_id = 's1_6'"), "ancestor_id", "depth")} == {("s1_504", 1), ("s1_503", 2), ("s1_502", 3), ("s1_500", 4)}
    assert rows(trees.roots(nodes, edges), "node_id") == [("s1_500",), ("s2_500",)]
    below = trees.node_yield(nodes, up)
    assert below.where("node_id = 's1_500'").count() == 7
    every = nodes.where("sent_id = 's1'").select("sent_id", F.col("node_id").alias("a"))
    pairs = every.crossJoin(every.select(F.col("a").alias("b")))
    found = {(r["a"], r["b"]): r for r in trees.paths(pairs, nodes, edges, up).collect()}
    assert len(found) == 144
    for (a, b), r in found.items():
        back = found[b, a]
        assert r["lca"] == back["lca"] and (r["up_steps"], r["down_steps"]) == (back["down_steps"], back["up_steps"])
        assert [s["node_id"] for s in r["path"]][-1:] == ([b] if a != b else [])
    line = found["s1_4", "s1_2"]
    assert [(s["dir"], s["gf"], s["pt"]) for s in line["path"]] == [("U", "-", "VP"), ("U", "-", "VP"), ("U", "HD", "S"), ("D", "SB", "NP"), ("D", "-", None)]


def test_printed_paths(spark):
    df = spark.createDataFrame([([("U", "HD", "VP", "x"), ("D", None, "NP", "y")],), ([],), ([("U", "-", "NP", "x")],)], "p array<struct<dir:string,gf:string,pt:string,node_id:string>>")
    printed = lambda **k: [r[0] for r in df.select(trees.printed(F.col("p"), **k)).collect()]
    assert printed() == ["U HD VP D - NP ", None, "U - NP "]
    assert printed(gf=False, cutoff=True) == ["U VP D ", None, "U "]
    assert printed(direction=False, gf=False, cutoff=True) == ["VP ", None, "NP "]


def test_maximal_constituents(graph, spark):
    nodes, edges, up = graph
    wanted = spark.createDataFrame([("s1", "a", t) for t in ("s1_1", "s1_2", "s1_5", "s1_6", "s1_3")] + [("s1", "b", f"s1_{i}") for i in range(1, 7)], "sent_id string, set_id string, term_id string")
    found = trees.maximal_constituents(wanted, nodes, edges, up)
    assert rows(found, "set_id", "node_id") == [("a", "s1_3"), ("a", "s1_501"), ("a", "s1_504"), ("b", "s1_500")]
    covered = found.join(trees.node_yield(nodes, up), ["sent_id", "node_id"]).join(nodes.where("is_punct").select("sent_id", F.col("node_id").alias("term_id")), ["sent_id", "term_id"], "left_anti")
    assert rows(covered, "sent_id", "set_id", "term_id") == rows(wanted)
    assert trees.convex(wanted.where("set_id = 'a'"), nodes.where("kind = 't'")).count() == 6


def test_overlaps_edits_and_order(graph, spark):
    nodes, edges, up = graph
    labels = spark.createDataFrame([("s1", "s1_502", "A"), ("s1", "s1_504", "A"), ("s1", "s1_501", "A"), ("s1", "s1_6", "B")], "sent_id string, node_id string, label string")
    assert rows(trees.without_overlaps(labels, up), "node_id", "kept") == [("s1_501", "A"), ("s1_502", "A"), ("s1_504", "NONE"), ("s1_6", "B")]
    gone = spark.createDataFrame([("s1", "s1_503")], "sent_id string, node_id string")
    _, moved = trees.remove_nodes(nodes, edges, gone)
    assert rows(moved.where("parent_id = 's1_502'"), "child_id") == [("s1_3",), ("s1_4",), ("s1_504",)]
    df = spark.createDataFrame([("a_12",), ("a_3_s0",), ("a_3_s1",), ("a_3",)], "id string")
    assert rows(df.select(trees.term_order(F.col("id")), trees.split_order(F.col("id")))) == [(12, 0), (3, 0), (3, 0), (3, 1)]


def test_prune(spark):
    df = spark.createDataFrame([(0, 0, False, False), (1, 1, False, False), (1, 2, True, False), (1, 2, False, False), (2, 1, False, True), (None, None, None, None), (0, 1, False, False)], "u int, d int, pp boolean, c boolean")
    assert [r[0] for r in df.select(trees.prune(*map(F.col, ("u", "d", "pp", "c")))).collect()] == [1, 1, 1, 0, 0, 0, 0]


# -- language ---------------------------------------------------------------------------------------


def test_categories(spark):
    english = {"JJ": "adj", "NN-SBJ": "noun", "VBD": "verb", "MD": "verb", "IN": "prep", "S": "sent", ".": "pun", "WHNP": "noun", "ZZ": None, "RP": "prep", "WRB": "con"}
    german = {"ADJA": "adj", "VVFIN": "verb", "NP": "noun", "$.": "pun", "PRELS": "noun", "PTKVZ": "part", "S": "sent", "APPR": "adj", "PP": "prep", "ITJ": "sent"}  # APPR falls to the earlier, open-ended rule
    for language, expected in (("en", english), ("de", german)):
        df = spark.createDataFrame([(k,) for k in expected], "l string")
        assert {r[0]: r[1] for r in df.select("l", lx.category(F.col("l"), language)).collect()} == expected


def test_voice_heads_prepositions(graph):
    nodes, edges, up = graph
    below = trees.node_yield(nodes, up)
    assert rows(lx.english_voice(nodes, edges, up), "node_id", "voice") == [("s1_3", "passive"), ("s1_4", "passive"), ("s2_2", None)]
    heads = dict(rows(lx.heads(nodes, edges, below, up), "node_id", "head_id"))
    assert heads["s1_501"] == "s1_2" and heads["s1_503"] == "s1_4" and heads["s1_6"] == "s1_6" and heads["s1_504"] == "s1_5"
    assert ("s1_504", "by") in rows(lx.prepositions(nodes, below), "node_id", "prep")


def test_frames(spark):
    frames = spark.createDataFrame([("s", "f1", "Test35"), ("s", "f2", "Unknown1"), ("s", "f3", "Motion")], "sent_id string, frame_id string, name string")
    assert rows(lx.kept_frames(frames), "frame_id") == [("f2",), ("f3",)]
    lemmas = spark.createDataFrame([("s", "f2", "go"), ("s", "f3", "go")], "sent_id string, frame_id string, lemma string")
    assert rows(lx.named_unknown(frames, lemmas), "frame_id", "name") == [("f1", "Test35"), ("f2", "go_Unknown1"), ("f3", "Motion")]


# -- features, learning -----------------------------------------------------------------------------


def test_role_features(corpus):
    table = role_features.build(corpus, height=8).persist()
    assert table.count() == 12  # every node of the sentence with the one frame
    by = {r["nodeID"].split()[0]: r for r in table.collect()}
    np_, pp, target = by["s1_501"], by["s1_504"], by["s1_4"]
    assert (np_["gold"], pp["gold"], target["gold"]) == ("Phenomenon", "Perceiver", None)
    assert np_["path"] == "U - VP U - VP U HD S D SB " and np_["path_length"] == 4 and np_["relpos"] == "LEFT" and pp["relpos"] == "RIGHT"
    assert np_["pt_path"] == "U VP U VP U S D " and np_["gf"] == "OA" and pp["prep"] == "by" and target["path_length"] == 0 and target["prune"] == 1
    assert np_["target_voice"] == "pass" and np_["const_head"] == "dog" and np_["firstword"] == "the" and np_["rightsib_pt"] == "VP" and np_["father_pt"] == "S"
    assert by["s1_503"]["ismaxproj"] == 0 and np_["ancestor_rule"] == "S -> NP VP ." and np_["partial_path"] == "D SB NP " or np_["partial_path"] == "D SB "
    plain = role_features.at_boundary(table)
    assert plain.where("gold = 'NONE'").count() == 10 and "gold" not in role_features.model_features(plain)


def test_sense_features(spark):
    tokens = spark.createDataFrame([("d", i, w, l, p, None, w == ".") for i, (w, l, p) in enumerate([("The", "the", "DT"), ("Dog", "dog", "NN"), (".", ".", "."), ("barks", "<unknown>", "VBZ"), ("now", "now", "RB")])], "doc string, i int, word string, lemma string, pos string, ne string, is_punct boolean")
    found = {r["i"]: r["cx_2"] for r in sense_features.contexts(tokens, (2,), ["doc"], ["i"]).collect()}
    assert found[3] == ["the#the#DT#", "dog#dog#NN#", "now#now#RB#"] and 2 not in found
    df = spark.createDataFrame([(found[3],)], "c array<string>")
    one = df.select(sense_features.context_features(F.col("c"), 2), sense_features.context_pos_features(F.col("c"), 2), sense_features.ngram_features(F.col("c"), 2)).first()
    assert one[0] == ["CX2DT", "CX2NN", "CX2RB"] and one[1] == ["POSCX2DT", "POSCX2NN", "POSCX2RB"]
    assert one[2] == ["BLEMdog_now", "TLEMthe_dog_now", "BPOSNN_RB", "TPOSDT_NN_RB"]


@pytest.mark.parametrize("kind", learners.KINDS)
def test_learners(spark, kind):
    data = [(i, "g" if i % 2 else "h", "x" if i % 3 else "y", str(i % 5), ("A" if i % 3 else "B")) for i in range(60)]
    df = spark.createDataFrame(data, "row_id int, frame string, f string, noise string, gold string")
    models = learners.train(df, ["frame"], ["f", "noise"], "gold", "onestep", kind)
    assert models.count() == 2
    extra = df.unionAll(spark.createDataFrame([(99, "unseen", "x", "0", "A")], df.schema))
    found = learners.with_prediction(extra, learners.apply(models, extra, "row_id", ["frame"], ["f", "noise"]), "row_id", "predicted")
    got = {r["row_id"]: (r["gold"], r["predicted"]) for r in found.collect()}
    assert got.pop(99) == ("A", "NONE")
    right = sum(a == b for a, b in got.values())
    assert right == 60 if kind == "maxent" else right >= 40
    confident = learners.apply(models, df, "row_id", ["frame"], ["f", "noise"]).select(F.explode("candidates").alias("c"), "row_id").groupBy("row_id").agg(F.sum("c.conf").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-6 for r in confident)


def test_binary_results_and_sweep(spark):
    data = [(1, "a", "NONE", 0.9, 0), (1, "a", "a", 0.1, 1), (1, "b", "b", 0.8, 0), (2, "a", "NONE", 1.0, 0)]
    df = spark.createDataFrame(data, "instance_id int, classifier string, label string, conf double, rank int")
    found = {r["instance_id"]: [(c["label"], c["conf"]) for c in r["candidates"]] for r in learners.join_binary(df).collect()}
    assert found == {1: [("b", 0.8), ("a", 0.1)], 2: [("NONE", 0.0)]}
    assert learners.sweep(lambda a, x: x * (1 if a else -1), {"a": [False, True]}, {"x": [1, 2, 3]}) == ({"a": True, "x": 3}, 3)
    with pytest.raises(ValueError):
        learners.combine([df, df])


def test_induction(spark):
    seen = [("v", "SB", None, ["U VP", "D NP"])] * 6 + [("v", "SB", None, ["U VP"])] * 9 + [("v", "OA", None, ["D NP"])] * 2 + [("n", "Head", None, ["D NP"])]
    df = spark.createDataFrame(seen, "pos string, gf string, prep string, path array<string>")
    paths = induction.path_frequencies(df)
    assert rows(paths, "gf", "freq") == [("Head", 1), ("SB", 6), ("SB", 9)]
    assert rows(induction.restricted(paths, only_down=True), "gf") == [("Head",)]
    named = paths.withColumn("prep", F.coalesce("prep", F.lit("-")))
    assert rows(induction.trie(named), "gf", "freq") == [("Head", 1), ("SB", 9)]
    fill = [("see", "v", "P", i, "SB", "-", "Perceiver") for i in (1, 2)] + [("see", "v", "P", i, "OA", "-", "Phenomenon") for i in (1, 2)] + [("see", "v", "P", 3, "SB", "-", "Perceiver")]
    frames = induction.subcat_frames(spark.createDataFrame(fill, "lemma string, pos string, frame string, instance_id int, gf string, prep string, fe string"))
    assert rows(frames.select(F.size("slots"), "freq")) == [(1, 1), (2, 2)]
    have = spark.createDataFrame([("x", "see", "v", "SB", "-"), ("x", "see", "v", "OA", "-"), ("y", "see", "v", "SB", "-")], "start string, lemma string, pos string, gf string, prep string")
    assert rows(induction.match_frames(have, frames), "start", "freq", "rank") == [("x", 1, 2), ("x", 2, 1), ("y", 1, 1)]
    assert rows(induction.match_frames(have, frames, strict=True), "start", "freq") == [("x", 2), ("y", 1)]


# -- formats ----------------------------------------------------------------------------------------


def test_tab_files(spark, tmp_path):
    (tmp_path / "a.tab").write_text("The\t-\ts1\ndog\tNP\tSB\tB-Agent:E-Agent\t-\t-\t-\t-\ts1\n\nHi\t-\ts2\n")
    (tmp_path / "a.pos").write_text("DT\nNN\n\nUH\n")
    (tmp_path / "bad.pos").write_text("DT\n\nNN\nUH\n")
    main = tabular.lines(spark, str(tmp_path / "a.tab"))
    both = tabular.aligned(main, tabular.lines(spark, str(tmp_path / "a.pos")), "pos", ".pos")
    found = tabular.parsed(tabular.sentences(both.withColumnRenamed("pos", "tag")))
    assert rows(found, "sent_no", "pos", "word", "tag", "sent_id") == [(0, 0, "The", "DT", "s1"), (0, 1, "dog", "NN", "s1"), (1, 0, "Hi", "UH", "s2")]
    assert rows(tabular.frame_slices(found), "word", "frame_no", "gf", "role") == [("dog", 0, "SB", "B-Agent:E-Agent")]
    assert rows(found.select(tabular.formatted("word", "ne", "sent_id"))) == [("Hi\t-\ts2",), ("The\t-\ts1",), ("dog\t-\ts1",)]
    other = tabular.lines(spark, str(tmp_path / "bad.pos")).withColumn("file", F.lit("a.pos"))
    with pytest.raises(Exception, match="not aligned"):
        tabular.aligned(main, other, "pos", ".pos").collect()


def test_plain_text_and_flat_parse(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Dogs bark, don't they?\n\nYes.\n")
    tokens = tabular.plain_sentences(tabular.lines(spark, str(tmp_path / "t.txt")))
    assert [w for _, _, w in sorted((s, p, w) for s, p, w in rows(tokens) if s == "t_0")] == ["Dogs", "bark", ",", "don't", "they", "?"]
    nodes, edges = tabular.flat_parse(tokens)
    assert nodes.where("kind = 'nt'").count() == 2 and edges.count() == tokens.count()
    tagged = sinks.annotated(tokens, lambda ws: [{"tag": w[:1].upper()} for w in ws], "tag string")
    assert ("t_1", 0, "Yes", "Y") in rows(tagged)


def test_brackets(spark):
    parses = spark.createDataFrame([("a", "( (S (NP_SB (DT The) (NN-X dog)) (VP (VBZ barks))) )", None), ("b", "(())", None), ("c", "(S (broken", ["one", "two"])], "sent_id string, tree string, words array<string>")
    found = tabular.read_brackets(parses, "berkeley")
    assert rows(found.where("sent_id = 'a' and kind = 't'"), "node_id", "pos", "word", "label") == [("a_1", "DT", "The", "-"), ("a_2", "NN", "dog", "X"), ("a_3", "VBZ", "barks", "-")]
    assert rows(found.where("kind = 'nt'"), "node_id", "cat", "label", "failed") == [("a_500", "S", "-", False), ("a_501", "NP", "SB", False), ("a_502", "VP", "-", False), ("c_500", "NOPARSE", "-", True)]
    assert tabular.split_label("NP_SB", "stanford") == ("NP_SB", None) and tabular.split_label("-LRB-", "berkeley") == ("-LRB-", None)
    nodes, edges = tabular.nodes_and_edges(found)
    assert trees.roots(nodes, edges).count() == 2


UNITS = """<lexunit-annotation ID="1" name="see.v" frame="Perception" pos="V"><subcorpus name="x"><annotationSet ID="10" status="MANUAL">
<layers><layer name="FE" rank="1"><labels><label ID="1" name="Perceiver" start="0" end="2"/><label ID="2" name="Phenomenon" start="8" end="15"/><label ID="3" name="Ground" itype="INI"/></labels></layer>
<layer name="FE" rank="2"><labels><label ID="4" name="Second" start="0" end="2"/></labels></layer><layer name="Target"><labels><label ID="5" name="Target" start="4" end="6"/></labels></layer></layers>
<sentence ID="77"><text>Ann saw the dogs</text></sentence></annotationSet></subcorpus></lexunit-annotation>"""


def test_framenet(spark, tmp_path):
    (tmp_path / "lu1.xml").write_text(UNITS)
    labels = framenet.read_units(spark, str(tmp_path / "lu1.xml"))
    assert labels.count() == 5 and rows(labels.select("lemma", "pos", "frame").distinct()) == [("see", "v", "Perception")]
    assert rows(framenet.usable_labels(labels), "label") == [("Perceiver",), ("Phenomenon",), ("Target",)]
    tags = framenet.word_tags(labels, framenet.words(labels))
    assert rows(tags, "layer", "pos", "tag") == [("FE", 0, "B-Perceiver:E-Perceiver"), ("FE", 2, "B-Phenomenon"), ("FE", 3, "E-Phenomenon"), ("Target", 1, "B-Target:E-Target")]
    lines = dict(rows(framenet.wide_lines(labels), "pos", "line"))
    assert lines[1] == "saw\t-\t-\t-\tsee\tPerception\t-\t-\t77" and lines[2].split("\t")[3] == "B-Phenomenon"
    assert framenet.by_frame(labels, frames=["Other"]).isEmpty()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b', 2.5, "F"), (2, None, None, "G")], "k int, v string, d double, grp string")
    sinks.dump(df, str(tmp_path / "dump"))
    back = sinks.load(spark, str(tmp_path / "dump"), ["result_0"])
    assert back.dtypes[:4] == df.dtypes and rows(back.select("k", "v", "d", "result_0")) == [(1, 'a,"b', 2.5, "NONE"), (2, None, None, "NONE")]
    lines = sinks.nary_lines(df, ["v", "d"], "grp")
    assert rows(lines, "line") == [(",,G",), ('aCOMMA"b,2.5,F',)]
    sinks.write_feature_files(lines, str(tmp_path / "cls"), "grp")
    assert rows(sinks.read_feature_files(spark, str(tmp_path / "cls")), "line", "grp") == [(",,G", "G"), ('aCOMMA"b,2.5,F', "F")]
    assert "F" in sinks.report(df.select("grp", "k"), "title")


# -- transfer ---------------------------------------------------------------------------------------


def test_tolerant_constituents(graph, spark):
    from lexgrove.operators.transfer import tolerant_constituents

    nodes, edges, up = graph
    wanted = spark.createDataFrame([("s1", "a", t) for t in ("s1_1", "s1_2", "s1_5")] + [("s1", "b", f"s1_{i}") for i in (1, 2, 4, 5, 6)], "sent_id string, set_id string, term_id string")
    exact = tolerant_constituents(wanted, nodes, edges, one_missing=False)
    assert rows(exact, "set_id", "node_id") == rows(trees.maximal_constituents(wanted, nodes, edges, up), "set_id", "node_id")
    assert rows(tolerant_constituents(wanted, nodes, edges), "set_id", "node_id") == [("a", "s1_5"), ("a", "s1_501"), ("b", "s1_501"), ("b", "s1_503")]


def test_transfer(corpus, graph, spark):
    from lexgrove.operators import transfer

    nodes, edges, _ = graph
    moved = transfer.transferred_elements(corpus["fe_node"], (nodes, edges), (nodes, edges))
    assert rows(moved, "fe_id", "node_id") == rows(corpus["fe_node"], "fe_id", "node_id")
    other = nodes.withColumn("word", F.when(F.col("node_id") == "s1_2", "cat").otherwise(F.col("word")))
    assert rows(transfer.matched_terminals(nodes, other).select("sent_id").distinct()) == [("s2",)]
    tab = spark.createDataFrame([("s2", 1, "barked", "bark+")], "sent_id string, pos int, word string, lemma string")
    assert rows(transfer.lemmas_by_place(nodes, tab).where("sent_id = 's2' and kind = 't'"), "word", "lemma") == [("Dogs", "dog"), ("barked", "bark+")]
    predictions = spark.createDataFrame([("s1---s1_f1", "s1_501 s1_500", "New"), ("s1---s1_f1", "s1_504 s1_503", "NONE")], "sentid string, nodeID string, label string")
    fe, refs = transfer.written_roles(predictions, corpus["fe"], corpus["fe_node"])
    assert rows(fe, "name", "is_target") == [("New", False), ("target", True)] and rows(refs, "node_id") == [("s1_4",), ("s1_501",)]
    senses = spark.createDataFrame([("s2", ["s2_2"], "s2_2", "bark", "verb", "Noise")], "sent_id string, ids array<string>, main_id string, lemma string, pos string, sense string")
    frame, element, nodes_of = transfer.written_senses(senses)
    assert rows(frame, "frame_id", "name") == [("s2_f1", "Noise")] and rows(nodes_of, "fe_id", "node_id") == [("s2_f1_t", "s2_2")] and element.count() == 1
