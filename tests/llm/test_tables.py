"""Archives, vectors, conversations, and the pipeline over a folder of tables."""

import collections
import hashlib
import re
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import chat, line_dedup, mixing, near_dedup, neighbours, warc
from lexgrove.llm.scratch import shared_folder

BIG = "y" * 1500
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1000, "u", None), (1001, None, "short"), (1002, "u\r\nX: y", BIG), (1003, "u", BIG), (1004, "u", BIG), (None, "u", BIG), (1005, "u", "short"), (1006, "u", FAKE * 3),
    (1007, "u", "a" * 30000 + FAKE + "b" * 50000 + "WARC/1.1\r\nzz" + "c" * 30000), (1008, "u", "é" * 700), (1009, "u", "WARC/1.1\r\n"), (1010, "u", FAKE), (1004, "u", BIG), (1002, "u", "other " * 300), (1011, "u", "other " * 300),
]


def brute_pages(pages):
    top = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(top.get(h, i), i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = i is not None and top.get(h, i) > i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "7000"])
def test_warc(spark, split):
    pages = PAGES + [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 90)) for i in range(300)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        rows = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, bytes string").repartition(2)
        warc.write_archives(rows, folder)
        found = sorted(map(tuple, warc.read_archives(spark, folder).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == brute_pages(pages)


def test_warc_empty(spark):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).collect() == []


def brute_nearest(rows, k=20):
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v) and len(v) == 24]
    out = {}
    for q, v in usable:
        if q is not None and q % 20 == 0:
            scored = sorted((-float((v * w).sum()), i) for i, w in usable if i != q)
            out[q] = scored[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 24)).astype("f4") * rng.uniform(0.5, 2, (3000, 1)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(4000 + i, vectors[20].tolist()) for i in range(50)]
    rows += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [float("inf")] + [1.0] * 23), (5080, [None] + [1.0] * 23), (5100, [1.0, 2.0])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", neighbours.F.lit(1)).repartition(4)).collect()
    expected = brute_nearest(rows)
    by = collections.defaultdict(list)
    for r in found:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(expected)
    vector = dict((i, v) for i, v in rows)
    hits = 0
    for q, own in by.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert own == [(r, i, s) for r, (_, i, s) in enumerate(sorted((-s, i, s) for _, i, s in own), 1)]
        assert all(abs(s - float(np.dot(np.array(vector[q], float), np.array(vector[i], float)))) < 1e-9 for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in expected[q]})
    assert hits / sum(map(len, expected.values())) > 0.9


def test_nearest_of_few_and_none(spark):
    one = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(one, key=lambda r: r["rank"])] == [(1, 1, 0.5), (2, 2, -1.0)]
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_nearest_repeated_and_null_ids(spark):
    """Rows that repeat a query's id are no candidates of it; a row without an id is found, but asks nothing."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (None, [0.5, 0.5]), (20, [0.0, 1.0])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 0 and r["vec_id"] is not None)
    assert [(r, i) for r, i, _ in own] == [(1, 1), (2, 1), (4, 20)] and {r["query_id"] for r in found} == {0, 20}


def test_nearest_of_huge_components(spark):
    """Squares beyond a double's range: rows take part, products are infinite."""
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1.0, 0.0]), (3, [-1e200, 1.0])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, float("inf")), (2, 1e200), (3, float("-inf"))]


@pytest.mark.parametrize(("kind", "rows"), [("spread", 20_000), ("clusters", 200_000)])
def test_collisions_filter(kind, rows):
    """At most a tenth of the rows is verified, and nine tenths of the neighbours are found."""
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((rows, 64))
    if kind == "clusters":
        vectors = rng.standard_normal((400, 64))[rng.integers(400, size=rows)] + 0.3 * vectors
    vectors, ids = vectors.astype("f4"), np.arange(rows)
    largest = float(np.abs(vectors).max())
    norm = float(np.sqrt(((vectors / largest) ** 2).sum(1).max()))
    hashing = neighbours.Hashing(vectors[rng.permutation(rows)[: neighbours.SAMPLE]].astype(float), largest, 20, rows, norm)
    asked = np.arange(0, rows, rows // 40)
    queries = vectors[asked].astype(float)
    exact = queries @ vectors.T.astype(float)
    exact[np.arange(len(asked)), asked] = -np.inf
    best = [[] for _ in asked]
    verified = 0
    for a in range(0, rows, neighbours.BLOCK):
        index = neighbours.Index(hashing, ids[a : a + neighbours.BLOCK], vectors[a : a + neighbours.BLOCK])
        for own, (found, score) in zip(best, index.search(queries, asked, 20), strict=True):
            own += zip((-score).tolist(), found.tolist(), strict=True)
        verified += index.verified
    recall = np.mean([len({i for _, i in sorted(own)[:20]} & set(np.argsort(-e)[:20].tolist())) / 20 for own, e in zip(best, exact, strict=True)])
    assert recall >= 0.9 and verified <= 0.1 * rows * len(asked)


def conversation(rng, i, turns):
    out = []
    for t in range(turns):
        role = "system" if t == 0 and rng.random() < 0.3 else ("user" if (t + i) % 2 else "assistant")
        text = {"system": "Rules apply.", "user": "what is it about this and that?", "assistant": "\n".join(["a long answer of many words here"] * int(rng.integers(2, 8)))}[role]
        if rng.random() < 0.3:
            text = {"system": "System: ", "user": "Human: ", "assistant": "### Assistant\n"}[role] + text
        out.append((i, t, role, text))
    return out


def test_chat_equals_one_pass(spark):
    rng = np.random.default_rng(6)
    rows = [r for i in range(60) for r in conversation(rng, i, int(rng.integers(1, 9)))] + conversation(rng, 99, 700)
    rows += [(None, 0, "user", "hi?"), (200, None, None, None), (200, 1, "", ""), (201, 0, "user", "x"), (201, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, features string").repartition(3)
    found = collections.Counter(map(tuple, chat.roles(turns).select("conv_id", "turn", "role", "rendered").collect()))
    assert sum(found.values()) == len(rows)
    # the same model, and one Viterbi pass over each conversation
    seen, start, step = collections.Counter(), collections.Counter(), collections.Counter()
    own = collections.defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
    order = lambda r: (r[1] is not None, r[1] or 0, r[3] is not None, r[3] or "")
    feats = {}
    for conv, turns_ in own.items():
        turns_.sort(key=order)
        numbers = [t for _, t, _, _ in turns_ if t is not None]
        feats[conv] = [" ".join(map(str, chat.features(x, t is None or t == min(numbers)))) for _, t, _, x in turns_]
        roles_at = collections.defaultdict(list)
        for (_, t, role, _), f in zip(turns_, feats[conv], strict=True):
            if role:
                seen[role, f] += 1
                if f.endswith("1"):
                    start[role] += 1
                if t is not None and conv is not None:
                    roles_at[t].append(role)
        for t, a in roles_at.items():
            for x in a:
                for y in roles_at.get(t + 1, []):
                    step[x, y] += 1
    model = chat.Chain(sorted({r for r, _ in seen}), start, step, seen)
    expected = collections.Counter()
    for conv, turns_ in own.items():
        for (_, t, _, x), s in zip(turns_, chat._trace(model, feats[conv], -1, None), strict=True):
            expected[conv, t, model.roles[s], chat.canonical(x, model.roles[s])] += 1
    assert found == expected
    truth = {(c, t): r for c, t, r, _ in rows if r}
    assert np.mean([truth[c, t] == r for c, t, r, _ in found if (c, t) in truth]) > 0.95


def test_chat_without_roles(spark):
    turns = spark.createDataFrame([(1, 0, "hello")], "conv_id long, turn long, text string")
    assert [r["role"] for r in chat.roles(turns).collect()] == [None]
    assert chat.roles(turns.where("turn > 5")).collect() == []


def test_chat_held_out_roles(spark):
    rng = np.random.default_rng(16)
    rows = [r for i in range(90) for r in conversation(rng, i, int(rng.integers(2, 9)))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.roles(turns.where("conv_id >= 45").drop("role"), turns.where("conv_id < 45")).collect()
    truth = {(c, t): r for c, t, r, _ in rows if c >= 45}
    assert len(found) == len(truth) and np.mean([truth[r["conv_id"], r["turn"]] == r["role"] for r in found]) > 0.95


def test_transcripts_in_one_text_are_cut_to_turns(spark):
    rng = np.random.default_rng(26)
    rows = [r for i in range(90) for r in conversation(rng, i, int(rng.integers(2, 9)))]
    turns = spark.createDataFrame([r for r in rows if r[0] < 60], "conv_id long, turn long, role string, text string")
    texts, truth = {}, {}
    for c in range(60, 90):
        own = [r for r in rows if r[0] == c]
        texts[c] = "\n".join(r[3] for r in own)
        truth[c] = [(r[2], chat.canonical(r[3], r[2])) for r in own]
    transcripts = spark.createDataFrame([*texts.items(), (1, None), (2, "")], "conv_id long, text string").withColumn("role", F.lit("x"))
    found = collections.defaultdict(list)
    for r in sorted(chat.parsed(transcripts, turns).collect(), key=lambda r: (r["conv_id"], r["turn"])):
        assert r["turn"] == len(found[r["conv_id"]])
        found[r["conv_id"]].append((r["role"], r["rendered"]))
    assert set(found) == set(texts) and np.mean([found[c] == truth[c] for c in texts]) > 0.8
    # by the model of the same turns, one pass over each text
    model = chat.fit_lines(turns)
    assert all([r for r, _ in chat.turns_of(model, texts[c])] == [r for r, _ in found[c]] for c in texts)
    long = "\n".join(["User: is it?", *["a long answer of many words here"] * 3000])
    assert [r["role"] for r in chat.parsed(spark.createDataFrame([(1, long)], "conv_id long, text string"), turns).collect()] == ["user", "assistant"]
    nobody = chat.parsed(spark.createDataFrame([(1, "a\nb")], "conv_id long, text string"), turns.limit(0)).collect()
    assert [(r["role"], r["rendered"]) for r in nobody] == [(None, chat.canonical("a\nb", None))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("aeiourstlnmdpk"), int(rng.integers(3, 9)))) for _ in range(900)]
    rows = []
    for i in range(500):
        w = list(rng.choice(vocabulary, int(rng.integers(30, 150))))
        if i % 5 == 0:
            for _ in range(4):
                w[rng.integers(len(w))] = "zorgleing"
        rows.append((i, " ".join(w) + ("\nthe line that all these texts share" if i % 3 == 0 else ""), "en", f"s{i % 4}", 0))
    rows[7] = (7, rows[7][1].replace(" ", "\n"), *rows[7][2:])  # lines too short to be dropped
    rows += [(600 + i, rows[7][1], "en", "s1", 0) for i in range(9)] + [(700, None, None, None, None), (701, "", "en", "s2", 0)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_pipeline_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = stage(spark, docs, folder)
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "packing" or docs.columns == columns
    ids = {name: {r["doc_id"] for r in rows.select("doc_id").collect()} for name, rows in inputs.items()}
    toxic, clean = {i for i in range(500) if i % 5 == 0}, {i for i in range(500) if i % 5} | {700, 701}
    assert len(ids["line_dedup"] & toxic) <= 2 and len(clean - ids["line_dedup"]) <= 4
    holding = inputs["mixing"].where("text like '%the line that all%'").count()
    assert ids["near_dedup"] == ids["line_dedup"] and holding == 1
    assert ids["mixing"] == ids["near_dedup"] - set(range(600, 609))
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in inputs["mixing"].collect()}
    mixed = sum(sizes[r["doc_id"]] for r in inputs["packing"].collect())
    assert abs(mixed - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == docs.columns and whole.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]


def test_queries_take_whole_tables(spark, folder):
    from lexgrove.llm import queries

    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op1_near_duplicates", "op2_mix_sources", "op5_toxicity", "op6_shared_lines", "op7_media_columns", "op8_quality"):
        assert queries.queries()[name](spark, folder).count() == n
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    expected = sorted(con.sql(line_dedup.ORACLE).fetchall())
    columns = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(tuple(r[c] for c in columns) for r in queries.op6_shared_lines(spark, folder).collect()) == expected
    assert re.match(r"op\d+_\w+$", "op1_near_duplicates") and mixing.CLOSERS and near_dedup.BANDS * near_dedup.ROWS <= near_dedup.REGISTERS
