"""Operators on documents against brute force, with odd inputs."""

import collections
import hashlib
import os
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexgrove.llm import line_dedup, media, mixing, near_dedup, packing, quality, textcols, toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _keep string, size string, kept string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with extra columns of clashing names."""
    full = [(i, t, "en", s, None if t is None else len(t), f"x{i}", "y", "z") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def sets_of(texts):
    out = []
    for text in texts:
        w = words(text)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(40)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    n = len(rows)
    for i in range(60):  # near copies of one text, from close to far
        w = base[0].split()
        for _ in range(1 + i // 6):
            w[rng.integers(len(w))] = "changed"
        rows.append((n + i, " ".join(w), "s0"))
    rows += [(200 + i, base[1], "s1") for i in range(30)]  # copies
    rows += [(300, None, None), (301, "", "s1"), (302, "  \n\t ", "s2"), (303, "one two", None), (304, "ONE  two", "s0"), (305, "a b c d e", "s0"), (306, "A B\nC D E", "s1")]
    rows += [(None, base[2], "s2"), (307, base[3], "s0"), (307, base[3], "s0"), (308, " ".join(rng.choice(vocabulary, 40_000)), "s2")]
    return rows


def test_shingles_equal_words(corpus):
    texts = [t for _, t, _ in corpus]
    data, offsets = textcols.text_bytes(pa.array(texts))
    assert [len(x) for x in textcols.shingles(data, offsets)] == [len(x) for x in sets_of(texts)]


def test_word_hash_tells_patterns_apart():
    """Complementary Thue-Morse words agree under any polynomial modulo 2**64."""
    signs = [0]
    for _ in range(10):
        signs += [1 - x for x in signs]
    one, two = "".join("ab"[x] for x in signs), "".join("ba"[x] for x in signs)
    hashes, _ = textcols.word_hashes(*textcols.text_bytes(pa.array([one, two])))
    assert hashes[0] != hashes[1]


def test_word_hash_is_free_of_place():
    a = textcols.word_hashes(*textcols.text_bytes(pa.array(["x" * 5000 + " Été b", "b  ÉtÉ"])))[0]
    b = textcols.word_hashes(*textcols.text_bytes(pa.array(["b ÉtÉ été"])))[0]
    assert a[2] == a[3] == b[0] and a[4] == b[1] and a[1] != a[4]


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    every = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    one, two = every[:2000], every[500:2500]
    a, b, both = near_dedup.registers([one, two, every[:2500]], 1024)
    assert (near_dedup.merge(a, b) == both).all()
    found = near_dedup.estimate(a[None], b[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(found - 1500 / 2500) < 0.06


def brute_components(rows, percent=85):
    sets = sets_of([t for _, t, _ in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            usable = rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]
            if usable and (same_id or 100 * both >= percent * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), None if r[0] is None else min(least[find(i)]) if sets[i] else r[0]) for i, r in enumerate(rows)]


def test_near_duplicates(spark, corpus):
    found = near_dedup.near_duplicates(frame(spark, corpus), blocks=8).collect()
    expected = brute_components(corpus)
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([tuple(r)[:3] for r in found], key=key) == sorted(expected, key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_long_texts(spark):
    """Sets that blocks don't hold, from copies to less than the threshold, beside short ones."""
    rng = np.random.default_rng(13)
    base = [f"v{x}" for x in rng.integers(10**6, size=near_dedup.LONG + 900)]
    rows = []
    for i in range(24):
        w = list(base)
        for at in rng.choice(len(w), 20 * (i % 8 + 1), replace=False):
            w[at] = f"c{i}"
        rows.append((i, " ".join(w[: len(w) - 60 * (i % 5)]), "s"))
    rows += [(100 + i, " ".join(base[: near_dedup.LONG - 500 * (i % 2)]), "s") for i in range(4)]
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), blocks=4).collect()}
    assert found == {i: c for i, _, c in brute_components(rows)}


def test_near_duplicate_blocks_give_few_links(spark):
    """In a bucket of many documents about as near as the threshold a block gives fewer links than rows."""
    rng = np.random.default_rng(14)
    base = [f"v{x}" for x in range(200)]
    rows = []
    for i in range(500):
        w = list(base)
        for at in rng.choice(len(w), 4, replace=False):
            w[at] = f"c{i}x{at}"
        rows.append((i, " ".join(w), "s"))
    docs = frame(spark, rows)
    signed = near_dedup.sketches(docs).select("doc_id", "n_shingles", "sketch").withColumnRenamed("doc_id", "node").cache()
    all_links, _ = near_dedup.links(docs, signed, 80, blocks=64)
    assert all_links.count() < 6 * len(rows)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 80, blocks=64).collect()}
    assert found == {i: c for i, _, c in brute_components(rows, 80)}


def test_near_duplicate_stage_keeps_one(spark, corpus):
    docs = frame(spark, corpus)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    expected = {i for i, _, c in brute_components(corpus) if i == c}
    assert sorted(-1 if i is None else i for i in ids) == sorted({-1 if i is None else i for i in expected})


def test_pipeline_stage_drops_pairs_from_080(spark, corpus):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    rows = []
    for i in range(60):  # similarities 0.827 and 0.785
        w = [f"v{x}" for x in rng.choice(10**6, 120, replace=False)]
        rows += [(1000 + 2 * i, " ".join(w), "s"), (1001 + 2 * i, " ".join(w[: -11 if i % 2 else -14] + [f"u{i}x{k}" for k in range(11 if i % 2 else 14)]), "s")]
    kept = {r[0] for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").select("doc_id").collect()}
    assert kept == {i for i, _, c in brute_components(rows, 80) if i == c} and len(kept) == 90
    found = near_dedup.near_duplicates(frame(spark, corpus), 80, blocks=8).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted([tuple(r)[:3] for r in found], key=key) == sorted(brute_components(corpus, 80), key=key)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = dict(map(tuple, near_dedup.components(chain).collect()))
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_lines(rows, least_chars=20, least_docs=3):
    holders = collections.defaultdict(set)
    keys = []
    for i, text, _ in rows:
        own = [x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode() for x in (text or "").split("\n")]
        keys.append(own)
        if i is not None:
            for k in own:
                if len(k) >= least_chars:
                    holders[k].add(i)
    out = []
    for (i, text, _), own in zip(rows, keys, strict=True):
        lines = (text or "").split("\n")
        gone = [i is not None and len(k) >= least_chars and len(holders[k]) >= least_docs and max(holders[k]) != i for k in own]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


LINES = [
    (1, "a shared line of some length\nown 1", "s"), (2, " A Shared Line of some length \nown 2\na shared line of some length", "s"), (3, "x\na shared line of some length", "s"),
    (4, "short\nshort", "s"), (5, "short", "s"), (6, "short", "s"), (7, None, "s"), (8, "", "s"), (None, "a shared line of some length", "s"),
    (9, "é" * 20 + "\n" + "é" * 19, "s"), (10, "é" * 20 + "\n" + "é" * 19, "s"), (11, "é" * 20 + "\n" + "é" * 19, "s"), (12, "\n".join(f"line number {i} of a long text" for i in range(3000)), "s"),
    (13, "\n".join(f"line number {i} of a long text" for i in range(0, 3000, 2)), "s"), (14, "\n".join(f"line number {i} of a long text" for i in range(0, 3000, 3)), "s"),
    (15, "again and again and again\nagain and again and again", "s"), (15, "again and again and again\nagain and again and again", "s"), (16, "again and again and again", "s"),
]


@pytest.mark.parametrize("many", [False, True])
def test_lines(spark, many):
    rows = LINES + [(1000 + i, f"the line of everyone here\nown {i}", "s") for i in range(400)] if many else LINES
    found = [tuple(r) for r in line_dedup.line_digests(frame(spark, rows)).collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(found, key=key) == sorted([r[:4] for r in brute_lines(rows)], key=key)


def test_line_stage(spark):
    docs = frame(spark, LINES)
    kept = line_dedup.drop_lines(docs)
    assert kept.columns == docs.columns
    found = sorted((r["doc_id"] or -1, r["text"] or "", r["_keep"]) for r in kept.collect())
    assert found == sorted((r[0] or -1, r[4], f"x{r[0]}") for r in brute_lines(LINES))


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        rest = budget * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        level = rest / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= set(over)


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), rng.choice(["a", "b", "c", "d", None])) for i in range(900)] + [(900, None, "a"), (901, "x " * 5000, "e"), (7, "again w", "f"), (7, "again w", "f"), (None, "no id", "b")]
    found = mixing.mixed(frame(spark, rows).select("doc_id", "source", mixing.word_count("text").alias("size")), slot=50).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    targets = brute_targets(sizes)
    taken = collections.Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= (5000 if s == "e" else 10)
    again = mixing.mixed(frame(spark, rows).select("doc_id", "source", mixing.word_count("text").alias("size")).repartition(2), slot=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mixed_rows(spark, corpus):
    docs = frame(spark, corpus)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    total = sum(len(words(t)) for _, t, _ in corpus)
    assert abs(sum(len(words(r["text"])) for r in out.collect()) - 1.5 * total) < 0.5 * total


def test_quality_weights_are_taken_first(spark):
    rows = [(i, "w " * 10, "a" if i % 3 else "b", 50.0 if i % 2 else 0.02) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    found = mixing.mix(docs, weights=(1.0, 8.0), budget=0.6, quality="q").where("taken > 0 and source = 'a'").collect()
    assert np.mean([r["q"] > 1 for r in found]) > 0.9


TOKENIZER = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer_path():
    public = pytest.importorskip("public_tokenizers")
    return public.path(TOKENIZER)


ODD = ["<|endoftext|> a b<|endoftext|>", " x", "a  b   c\n\n d ", "日本語 テキスト mixed", "", "\x1c\x1d a\x85b c", "don't you'll we've I'm", "tab\tsep  x", "a <|endoftext|> b <|endo", "é" * 50, "word " * 9000, "ab" * 3000]


def test_encoder_equals_tokenizer(tokenizer_path, corpus):
    encoder = packing.Encoder(tokenizer_path)
    texts = ODD + [t or "" for _, t, _ in corpus]
    expected = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder(texts) == expected and encoder(texts) == expected


def test_encoder_of_long_parts(tokenizer_path):
    """Texts without spaces between marks."""
    encoder = packing.Encoder(tokenizer_path)
    rng = np.random.default_rng(4)
    long = ["".join(rng.choice(list("abcdef-"), 60_000)) for _ in range(3)] + ["".join(rng.choice(list("ab é\nü  '.7"), 20_000)) for _ in range(3)]
    assert encoder(long) == [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(long, add_special_tokens=False)]


def test_pack(spark, tokenizer_path, corpus):
    rows = [(i, t, s) for i, t, s in corpus if i is not None and i != 307] + [(1000 + i, t, "s") for i, t in enumerate(ODD)]
    found = packing.pack(frame(spark, rows), tokenizer_path).collect()
    encoder = packing.Encoder(tokenizer_path)
    ids = {i: encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in rows}
    total = 0
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and len(own) == r["length"]
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for i, pieces in by_doc.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(ids[i])
        assert all(n == 2048 for p, _, n in pieces if p) and [a for _, a, _ in pieces] == list(np.cumsum([0, *[n for _, _, n in pieces]])[:-1])
    for own in by_sequence.values():
        own.sort()
        assert [a for a, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) <= 2048
    assert len(by_sequence) <= -(-total // 2048) * 11 / 9 + 1 and set(by_doc) == set(ids)


def test_best_fit_runs_are_best_fit():
    rng = np.random.default_rng(9)
    counts = collections.Counter(rng.integers(1, 101, 500).tolist())
    runs = packing.best_fit_runs(dict(counts), 100)
    fill = collections.Counter()
    for size, (first, to, at) in runs.items():
        ends = [*first[1:].tolist(), counts[size]]
        for a, b, s, o in zip(first.tolist(), ends, to.tolist(), at.tolist(), strict=True):
            for k in range(b - a):
                assert fill[s + k] == o
                fill[s + k] += size
    gaps = []  # row by row: the smallest gap that holds the piece
    for size in sorted(counts.elements(), reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((100 if fit is None else fit) - size)
    assert max(fill.values()) <= 100 and len(fill) == len(gaps)


def test_media_round_trip(spark):
    texts = [None, "", "a", "a" * 64, "a" * 65, "Zoë said: ünïcödé — 日本語 🙂" * 9, "\0" * 300 + "x", "line\n" * 2000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s")]
    found = media.media_digests(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    files = {r["doc_id"]: r["media"] for r in media.media_files(frame(spark, rows)).collect()}
    for r in found:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["media_sha256"] == hashlib.sha256(files[r["doc_id"]]).hexdigest() and r["media_bytes"] == len(files[r["doc_id"]])


def test_media_refuses_other_bytes():
    for data in (b"", b"\xff\xd8\xff\xd9", b"GIF89a", media.encode(np.zeros(64, np.uint8), np.array([0, 64]))[0][0][:40]):
        with pytest.raises((ValueError, IndexError)):
            media.decode([data])


def test_jpeg_without_restarts_and_with_three_components():
    """A colour scan written bit by bit here, with code lengths of 8 for all symbols."""
    dc = {s: 4 for s in range(9)}
    ac = {0x00: 4, 0x03: 4, 0x05: 4, 0xF0: 6, 0x21: 6}
    dc_table, dc_code, dc_length = media._canonical(dc)
    ac_table, ac_code, ac_length = media._canonical(ac)
    rng = np.random.default_rng(0)
    bits, last, expected = "", [0, 0, 0], {0: [], 1: [], 2: []}

    def value(v):
        n = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    for _ in range(2):
        for c, blocks in ((0, 4), (1, 1), (2, 1)):
            for _ in range(blocks):
                v = int(rng.integers(-100, 100))
                d = v - last[c]
                last[c] = v
                s = abs(d).bit_length()
                bits += format(int(dc_code[s]), f"0{int(dc_length[s])}b") + value(d)
                block = [v] + [0] * 63
                block[1], block[20] = 5, -1
                bits += format(int(ac_code[0x03]), f"0{int(ac_length[0x03])}b") + value(5)
                bits += format(int(ac_code[0xF0]), f"0{int(ac_length[0xF0])}b") + format(int(ac_code[0x21]), f"0{int(ac_length[0x21])}b") + value(-1)
                bits += format(int(ac_code[0x00]), f"0{int(ac_length[0x00])}b")
                expected[c].append(block)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    segment = media._segment
    file = b"".join((b"\xff\xd8", segment(0xDB, b"\0" + bytes([8] * 64)), segment(0xC0, b"\x08\0\x10\0\x20\x03\x01\x22\0\x02\x11\0\x03\x11\0"), segment(0xC4, b"\0" + dc_table), segment(0xC4, b"\x10" + ac_table), segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0"), scan, b"\xff\xd9"))
    picture = media.decode([file])[0]
    assert picture.coefficients[0].shape == (2, 4, 64) and picture.coefficients[1].shape == (1, 2, 64)
    order = [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
    assert [picture.coefficients[0][y, x].tolist() for y, x in order] == expected[0]
    assert [picture.coefficients[2][0, x].tolist() for x in (0, 1)] == expected[2]
    assert media.thumbnail(picture).shape == (2, 4) and media.thumbnail(picture)[0, 0] == np.clip(expected[0][0][0] + 128, 0, 255)


@pytest.fixture(scope="module")
def toxic_corpus():
    rng = np.random.default_rng(3)
    clean = ["".join(rng.choice(list("aeiourstlnmd"), int(rng.integers(3, 9)))) for _ in range(800)]
    bad = [f"zorgle{x}" for x in ("", "s", "d", "ing", "er", "x")]
    rows, marks = [], []
    for i in range(900):
        w = list(rng.choice(clean, int(rng.integers(20, 200))))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.integers(len(w))] = rng.choice(bad[:-1])
        rows.append((i, " ".join(w), "s"))
        marks.append((i, 1, int(toxic)))
    return rows, marks, bad


def test_toxicity(spark, toxic_corpus):
    rows, marks, bad = toxic_corpus
    extra = [(2000, None, "s"), (2001, "", "s"), (None, "x", "s"), (2002, f"a clean text but {bad[-1]} zorgleing zorgles here", "s")]
    docs, labels = frame(spark, rows + extra), spark.createDataFrame(marks + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity_scores(docs, labels).collect()
    assert len(found) == len(rows) + len(extra)
    truth = {i: t for i, _, t in marks}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2002]["predicted"] == 1 and by_id[2001]["predicted"] == 0 and by_id[2000]["predicted"] == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["predicted"] == 0}


def test_toxicity_learns_from_the_end_of_long_texts(spark, toxic_corpus):
    rows, _, bad = toxic_corpus
    rng = np.random.default_rng(8)
    clean = [t for i, t, _ in rows if i % 4]
    words = sorted({w for t in clean for w in t.split()})
    long = [" ".join([*rng.choice(words, 3300), *rng.choice(bad[:-1], 30)]) for _ in range(18)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(clean + long)])
    labels = spark.createDataFrame([(i, 1, int(i >= len(clean))) for i in range(len(clean + long))], "doc_id long, quality int, toxic int")
    assert min(map(len, long)) > 20_300 and {r["text"] for r in toxicity.sample_of(docs, labels).collect()} <= set(clean + long)
    toxic, *free = toxicity.fit(docs, labels).score(pa.array([" ".join(bad), *clean]))
    assert toxic >= toxicity.THRESHOLD > max(free)


def test_toxicity_takes_3000_labels(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('w', id) AS text")
    labels = spark.range(4000).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 2 AS int) AS toxic")
    usable = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(4000))
    assert 2500 < usable < 3000 and toxicity.sample_of(docs, labels).count() == usable


_TRAINING = """
import resource, numpy as np, pyarrow as pa
from lexgrove.llm import toxicity
rng = np.random.default_rng(1)
words = np.array(["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(20000)])
sample, before = toxicity.Sample(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _ in range(25):
    sample.add(pa.array([" ".join(rng.choice(words, 3334))[:20000] for _ in range(100)]))
toxicity.train(sample, np.arange(2500) % 2, passes=2)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_toxicity_trains_on_long_texts_in_bounded_memory():
    """2500 texts of 20,000 characters, 50 MB, within 600 MB."""
    found = subprocess.run([sys.executable, "-c", _TRAINING], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(found.stdout) < 600


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r["score"], r["predicted"]) for r in toxicity.toxicity_scores(docs, none).collect()] == [(0.5, 0)]


def _perplexity(trusted, text):
    """The defining formulas, with dictionaries."""

    def grams(t):
        found = textcols.word_hashes(*textcols.text_bytes(pa.array([t])))[0].tolist()
        kinds = [None, None, *found]
        return [(kinds[i], kinds[i + 1], w) for i, w in enumerate(found)]

    levels = {3: collections.Counter(g for t in trusted for g in grams(t))}
    for k in (2, 1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])

    def discount(k, c):
        of = collections.Counter(v for v in levels[k].values() if v <= 4)
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        i = min(c, 3)
        d = i - (i + 1) * y * of[i + 1] / of[i] if of[i] else y * i / 2
        return min(max(d, 0.05), i - 0.05)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len({x[-1] for x in levels[3]}) + 1)
        same = {x: c for x, c in levels[k].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        spare = sum(discount(k, c) for c in same.values())
        c = levels[k].get(g, 0)
        return (max(c - discount(k, c), 0) if c else 0) / total + spare / total * p(g[1:])

    own = grams(text or "")
    return np.exp(-np.mean([np.log(p(g)) for g in own])) if own else None


@pytest.mark.parametrize("head", [0, 3, 256])
def test_quality_against_brute_force(spark, monkeypatch, head):
    """Whatever number of words all tasks get, shards and texts that come again."""
    monkeypatch.setattr(quality, "HEAD", max(head, 1))
    rng = np.random.default_rng(6)
    words_of = [f"w{i}" for i in range(25)]
    trusted = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "the end", *(" ".join(rng.choice(words_of, 30)) for _ in range(5))]
    texts = [*trusted, "THE CAT", "zzz qqq zzz", "", None, "the", " \n", "the dog sat", " ".join(rng.choice(words_of, 5000)), "w1 " * 300]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    docs = docs.withColumn("trusted", docs["doc_id"] < len(trusted))
    found = {r[0]: r[2] for r in quality.perplexities(docs, shards=7).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        expected = _perplexity(trusted, t)
        assert found[i] is None if expected is None else abs(found[i] / expected - 1) < 1e-5


def test_quality_tells_all_words_before_apart(spark):
    """Two words before whose hashes begin with the same six bits."""
    words_of = [f"w{i}" for i in range(200)]
    kinds = (textcols.word_hashes(*textcols.text_bytes(pa.array(words_of)))[0] >> np.uint64(58)).tolist()
    one, two = next((a, b) for i, a in enumerate(words_of) for j, b in enumerate(words_of) if i < j and kinds[i] == kinds[j])
    trusted = [f"{one} red", f"{two} blue"] * 5 + ["red blue", f"blue {one} {two} red"]
    texts = [*trusted, f"{one} blue", f"{two} blue"]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r[0]: r[2] for r in quality.perplexities(docs.withColumn("trusted", docs["doc_id"] < len(trusted))).collect()}
    assert found[12] > 1.2 * found[13]
    for i, t in enumerate(texts):
        assert abs(found[i] / _perplexity(trusted, t) - 1) < 1e-5


def test_quality_deals_out_frequent_words(spark):
    """Words that many shards have a part of, before, between and after others, with texts that are one word."""
    rng = np.random.default_rng(9)
    share = np.array([8.0, 4.0, 2.0, *[0.2] * 40])
    words_of = ["the", "of", "and", *(f"w{i}" for i in range(40))]
    trusted = ["the", "the of", "of the the", *(" ".join(rng.choice(words_of, 40, p=share / share.sum())) for _ in range(12))]
    texts = [*trusted, "the " * 50, "of and the", "new the of new", *(" ".join(rng.choice([*words_of, "new"], 60)) for _ in range(6))]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r[0]: r[2] for r in quality.perplexities(docs.withColumn("trusted", docs["doc_id"] < len(trusted)), shards=40).collect()}
    for i, t in enumerate(texts):
        assert abs(found[i] / _perplexity(trusted, t) - 1) < 1e-5


@pytest.mark.parametrize("bits", [8, 1 << 26])
def test_quality_sends_unknown_words_as_one(spark, monkeypatch, bits):
    """Words of no trusted text, wherever they are and however many, by a bitmap with room or without; they are hardly sent."""
    monkeypatch.setattr(quality, "KNOWN", bits, raising=False)
    rng = np.random.default_rng(11)
    words_of = [f"w{i}" for i in range(30)]
    trusted = ["seldom used", "the w1 of w2", *(" ".join([*rng.choice(words_of, 20), f"rare{i}"]) for i in range(9))]
    texts = [*trusted, "new", "new new", "new the new", "the new", "new w1 w2 new w3", "w1 rare3 new of rare4", "seldom new used new"]
    texts += [" ".join(f"x{i}-{k} y{k % 50}" for k in range(1500)) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    docs = docs.withColumn("trusted", docs["doc_id"] < len(trusted))
    context = spark.sparkContext

    def written():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    found = {r[0]: r[2] for r in quality.perplexities(docs, shards=7).collect()}
    size = sum(map(len, texts))
    assert bits == 8 or written() - before < size / 3
    for i, t in enumerate(texts):
        assert abs(found[i] / _perplexity(trusted, t) - 1) < 1e-5


def test_quality_thresholds(spark):
    """Quantile by language of the held-out trusted, times the margin; ids sent and joined give the same."""
    rng = np.random.default_rng(7)
    words_of = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words_of, 20 + i % 9)), None if i % 5 == 0 else f"l{i % 3}") for i in range(240)]
    rows += [(7, rows[7][1], "l1"), (None, "w1 w2", "l0"), (900, None, "l2"), (901, "", "lx"), (902, "w3 w4 w5", "lx")]
    docs = spark.createDataFrame([(i, t, lang, "s", "clash") for i, t, lang in rows], "doc_id long, text string, lang string, source string, trusted string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)] + [(9, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.quality(docs, labels).collect()
    again = quality.quality(docs, labels, sent=0).collect()
    assert len(found) == len(again) == len(rows)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["perplexity"])
    for one, two in zip(sorted(found, key=key), sorted(again, key=key), strict=True):
        assert one["doc_id"] == two["doc_id"] and one["kept"] == two["kept"]
        assert one["perplexity"] == two["perplexity"] or abs(one["perplexity"] / two["perplexity"] - 1) < 1e-6
    held = {i for i in range(200) if i % 4 and zlib.crc32(str(i).encode()) % 3 == 1}
    by_id = {r["doc_id"]: r for r in found}
    groups = collections.defaultdict(list)
    for i, _, lang in rows:
        if i in held:
            groups[lang].append(by_id[i]["perplexity"])
            groups["all"].append(by_id[i]["perplexity"])
    for i, t, lang in rows:
        own = sorted(groups.get(lang) or groups["all"])
        limit = own[int(np.ceil(quality.QUANTILE * len(own))) - 1] * quality.MARGIN
        r = by_id[i]
        assert abs(r["threshold"] / limit - 1) < 1e-9
        assert r["kept"] == (r["perplexity"] is not None and r["perplexity"] <= r["threshold"])
        assert (r["perplexity"] is None) == (not words(t))


def test_quality_keeps_clean_text(spark, toxic_corpus):
    rows, marks, _ = toxic_corpus
    noise = [(5000 + i, "!#%& 0X9Q @@ ~~~ 7K%% ^^ |||" * 5, "s") for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows[:600]], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["kept"] for r in quality.quality(frame(spark, rows + noise), labels).collect()}
    assert np.mean([found[i] for i, _, _ in rows]) > 0.98 and not any(found[i] for i, _, _ in noise)
    bare = quality.quality(frame(spark, rows[:3]), labels.where("doc_id < 0")).collect()
    assert [r["kept"] for r in bare] == [False] * 3 or all(r["perplexity"] is None for r in bare)


def test_empty_tables(spark, tokenizer_path):
    docs = frame(spark, [(1, "x", "s")]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (
        near_dedup.near_duplicates(docs), near_dedup.drop_near_duplicates(docs), mixing.mix(docs), mixing.mixed_documents(docs), packing.pack(docs, tokenizer_path), toxicity.toxicity_scores(docs, labels),
        line_dedup.line_digests(docs), line_dedup.drop_lines(docs), media.media_digests(docs), quality.quality(docs, labels),
    ):
        assert rows.collect() == []
