"""Senses of targets, contexts of sparse annotation, failed parses, refeaturizing and encodings."""

from pyspark.sql import functions as F

from lexgrove.operators import instances as inst
from lexgrove.operators import matrix as mx


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in (columns or frame.columns)) for r in frame.collect()), key=str)


def test_senses_of_one_target_are_grouped(spark):
    senses = spark.createDataFrame([(1, "look up", "v", "s1", "Seeking", 2), (1, "look up", "v", "s1", "Scrutiny two", 1), (1, "look up", "v", "s1", "Seeking", 3), (1, "go", "v", None, None, 1)], "t long, lex string, pos string, sid string, sense string, ord int")
    assert rows(inst.grouped_senses(senses, "ord", ["t"]), "t", "lemma", "sid", "senses") == [(1, "go", "", [""]), (1, "look_up", "s1", ["Scrutiny_two", "Seeking", "Seeking"])]
    assert rows(inst.grouped_senses(senses.limit(0), "ord", ["t"])) == []


def test_inventory_keeps_first_seen_order(spark):
    targets = spark.createDataFrame([("a", "v", "z", 1), ("a", "v", "b", 2), ("a", "v", "z", 3), ("a", "n", "q", 4), ("a", "n", None, 0)], "lemma string, pos string, sense string, ord int")
    assert rows(inst.sense_inventory(targets, "ord")) == [("a.n", ["q"]), ("a.v", ["z", "b"])]


def test_sparse_contexts_span_sentences_of_the_corpus(spark):
    sentences = [["A", "b"], ["The", "dog", "!"], ["c"], ["the", "Dog"], ["..."]]
    corpus, place = [], 0
    for s, words in enumerate(sentences):
        for pos, word in enumerate(words):
            corpus.append((place, f"c{s}", pos, word, word.lower()))
            place += 1
    corpus = spark.createDataFrame(corpus, "place long, sent_id string, pos int, word string, lemma string")
    own = spark.createDataFrame([("o1", 0, "the", "the"), ("o1", 1, "dog", "dog"), ("o2", 0, "new", "new"), ("o2", 1, "one", "one"), ("o3", 0, "...", "...")], "sent_id string, pos int, word string, lemma string")
    targets = spark.createDataFrame([(1, "o1", 1), (2, "o2", 1), (3, "o3", 0)], "instance_id long, sent_id string, pos int")
    for chunk in (100_000, 2):
        found = rows(inst.sparse_contexts(corpus, own, targets, "lemma", 2, chunk))
        assert found == [(1, "c1", ["b", "the"], ["!", "c"]), (1, "c3", ["c", "the"], ["..."]), (2, None, ["new"], []), (3, None, [], [])]
    assert rows(inst.sparse_contexts(corpus, own, targets.limit(0), "lemma", 2)) == []


def test_failed_parses_and_their_split(spark):
    frames = spark.createDataFrame([("s1", "f1", "Motion", "go", "v"), ("s2", "f1", "Motion", "run", "v"), ("s2", "f2", "Seeking", "look", "v")], "sent_id string, frame_id string, frame string, target string, target_pos string")
    elements = spark.createDataFrame([("s2", "f1", "Theme"), ("s2", "f1", "Goal"), ("s1", "f1", "Theme")], "sent_id string, frame_id string, name string")
    parsed = spark.createDataFrame([("s1",), ("s1",)], "sent_id string")
    failed = inst.failed_parses(frames, elements, parsed)
    assert rows(failed, "sent_id", "frame", "elements") == [("s2", "Motion", ["Goal", "Theme"]), ("s2", "Seeking", [])]
    assert len({r["dataset"] for r in inst.split_failed(failed, 50).collect()}) == 1
    many = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("sent_id"))
    assert {r["dataset"] for r in inst.split_failed(many, 100).collect()} == {"train"}
    assert 1300 < inst.split_failed(many, 70).where("dataset = 'train'").count() < 1500


def test_matrix_from_stored_features(spark):
    meta = spark.createDataFrame([("a", 1, "CX", "x"), ("a", 1, "CX", "x"), ("a", 2, "CX", "y"), ("a", 2, "SYN", "x")], "lemma string, instance_id long, kind string, feature string")
    assert rows(inst.refeaturized(meta, "keep")) == [("a", 1, "CXx", 2), ("a", 2, "CXy", 1), ("a", 2, "SYNx", 1)]
    assert rows(inst.refeaturized(meta, "keep", ["SYN"])) == [("a", 2, "SYNx", 1)]
    train = mx.vocabulary(inst.meta_features(meta.where("instance_id = 1")))
    assert rows(inst.refeaturized(meta, "repeat", vocab=train), "instance_id", "column") == [(1, "CXx 0/2"), (1, "CXx 1/2")]


def test_lines_for_learners(spark):
    lines = spark.createDataFrame([(3, "a,b,X."), (1, "c,,Y"), (2, None), (4, "Z")], "k int, instance string")
    assert rows(lines.select("k", inst.indicator_line(F.col("instance")))) == [(1, "0=c 1= Y"), (2, None), (3, "0=a 1=b X"), (4, "Z")]
    assert rows(inst.numbered_lines(lines, ["k"]), "k", "numbered") == [(1, "1 Y c "), (2, None), (3, "3 X a b"), (4, "4 Z ")]
