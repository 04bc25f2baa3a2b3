"""Tab-separated sentences with parallel line-aligned files, plain text, and bracketed parses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUP = ("pt", "gf", "role", "target", "frame", "stuff")
EMPTY = "-"


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, line_no, line) of text files, in order; a last line end adds no line."""
    whole = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.decode("content", encoding).alias("text"))
    return whole.select("file", F.posexplode(F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n")).alias("line_no", "line"))


def sentences(rows: DataFrame) -> DataFrame:
    """Lines that aren't blank with sent_no (blank lines before) and pos in the sentence, both from 0."""
    order = Window.partitionBy("file").orderBy("line_no")
    marked = rows.withColumn("_blank", F.trim("line") == "").withColumn("sent_no", F.sum(F.col("_blank").cast("long")).over(order))
    kept = marked.where("not _blank").drop("_blank")
    kept = kept.withColumn("sent_no", F.dense_rank().over(Window.partitionBy("file").orderBy("sent_no")) - 1)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("file", "sent_no").orderBy("line_no")) - 1)


def aligned(main: DataFrame, side: DataFrame, name: str, suffix: str) -> DataFrame:
    """main with the side file's line at the same place; a line without counterpart is an error."""
    other = side.select(F.regexp_replace("file", re.escape(suffix) + "$", "").alias("_file"), F.col("line_no").alias("_no"), F.col("line").alias(name))
    stem = F.regexp_replace("file", r"\.tab$", "")
    joined = main.join(other, (stem == F.regexp_replace("_file", r"\.tab$", "")) & (F.col("line_no") == F.col("_no")), "left").drop("_file", "_no")
    bad = (F.trim("line") == "") != (F.trim(F.coalesce(name, F.lit(""))) == "")
    return joined.withColumn(name, F.when(bad, F.raise_error(F.concat(F.lit("files are not aligned: "), "file", F.lit(" line "), F.col("line_no").cast("string")))).otherwise(F.col(name)))


def parsed(rows: DataFrame) -> DataFrame:
    """Lines as word, frames (the repeating group), ne and id columns."""
    fields = F.split("line", "\t")
    n = F.floor((F.size(fields) - 3) / len(GROUP)).cast("int")
    group = lambda i: F.struct(*[F.element_at(fields, i * len(GROUP) + 2 + k).alias(name) for k, name in enumerate(GROUP)])
    frames = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), group)).otherwise(F.array().cast("array<struct<pt:string,gf:string,role:string,target:string,frame:string,stuff:string>>"))
    return rows.withColumn("word", F.element_at(fields, 1)).withColumn("frames", frames).withColumn("ne", F.element_at(fields, F.size(fields) - 1)).withColumn("sent_id", F.element_at(fields, -1))


def frame_slices(rows: DataFrame) -> DataFrame:
    """A row for each token and frame: frame_no and the group's columns."""
    return rows.select(*[c for c in rows.columns if c != "frames"], F.posexplode("frames").alias("frame_no", "f")).select("*", "f.*").drop("f")


def formatted(*columns: str) -> Column:
    """A line of the columns; missing ones are dashes."""
    return F.concat_ws("\t", *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(EMPTY)) for c in columns])


TOKEN = r"\p{L}[\p{L}\p{M}\p{N}'-]*|\p{N}+(?:[.,]\p{N}+)*|[^\s\p{L}\p{N}]"


def plain_sentences(rows: DataFrame) -> DataFrame:
    """(sent_id, pos, word) of text lines: one sentence a non-empty line, named file_number."""
    some = rows.where("trim(line) <> ''").withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return some.select(F.concat_ws("_", stem, "n").alias("sent_id"), F.posexplode(F.regexp_extract_all("line", F.lit(f"({TOKEN})"), F.lit(1))).alias("pos", "word"))


def flat_parse(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one root S over all tokens (sent_id, pos, word, [lemma, tag])."""
    maybe = lambda c: F.col(c) if c in tokens.columns else F.lit(None).cast("string")
    name = F.concat_ws("_", "sent_id", (F.col("pos") + 1).cast("string"))
    terms = tokens.select("sent_id", name.alias("node_id"), F.lit("t").alias("kind"), F.lit(None).cast("string").alias("cat"), maybe("tag").alias("pos"), "word", maybe("lemma").alias("lemma"), (F.col("pos") + 1).alias("term_ord"))
    root = F.concat(F.col("sent_id"), F.lit("_500"))
    none = [F.lit(None).cast("string").alias(c) for c in ("pos", "word", "lemma")]
    roots = tokens.select("sent_id").distinct().select("sent_id", root.alias("node_id"), F.lit("nt").alias("kind"), F.lit("S").alias("cat"), *none, F.lit(None).cast("int").alias("term_ord"))
    edges = tokens.select("sent_id", root.alias("parent_id"), name.alias("child_id"), F.lit(EMPTY).alias("label"), F.col("pos").alias("child_ord"), F.lit(True).alias("is_tree"))
    return terms.unionAll(roots), edges


# -- bracketed parses -------------------------------------------------------------------------------

_ATOM = re.compile(r"\(|\)|[^\s()]+")
STYLES = ("berkeley", "stanford", "collins")
NODE = "sent_id string, node_id string, kind string, cat string, pos string, word string, head string, term_ord int, parent_id string, label string, child_ord int, failed boolean"


def split_label(label: str, style: str) -> tuple[str, str | None]:
    """Category and function: apart at the first mark that the style uses."""
    parts = re.split("-" if style == "stanford" else "[-:_]", label, maxsplit=1)
    if len(parts) == 2 and parts[0]:
        return parts[0], parts[1]
    return label, None


def parse_brackets(text: str) -> list | None:
    """Nested lists of one bracketed tree; null if brackets don't match or nothing is inside."""
    stack: list[list] = [[]]
    for atom in _ATOM.findall(text):
        if atom == "(":
            stack.append([])
        elif atom == ")":
            if len(stack) < 2:
                return None
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(atom)
    return stack[0][0] if len(stack) == 1 and len(stack[0]) == 1 else None


def tree_rows(sent_id: str, text: str, style: str = "berkeley") -> list[tuple]:
    """NODE rows of a bracketed tree: terminals are numbered from 1, phrases from 500."""
    tree = parse_brackets(text)
    rows: list[tuple] = []
    count = {"t": 0, "nt": 499}

    def visit(node: list, parent: str | None, place: int) -> bool:
        while node and isinstance(node[0], list):  # an unnamed bracket around the tree
            if len(node) != 1:
                break
            node = node[0]
        if not node or not isinstance(node[0], str):
            return False
        name, inner = node[0], node[1:]
        head = None
        if style == "collins":
            parts = name.split("~")
            cat, gf, head = parts[0], None, parts[1] if len(parts) > 1 else None
            words = [x for x in inner if isinstance(x, str)]
            if len(inner) == 1 and isinstance(inner[0], list):
                return visit(inner[0], parent, place)
        else:
            cat, gf = split_label(name, style)
            words = []
        if style != "collins" and len(inner) == 1 and isinstance(inner[0], str):
            count["t"] += 1
            rows.append((sent_id, f"{sent_id}_{count['t']}", "t", None, cat, inner[0], None, count["t"], parent, gf or EMPTY, place, False))
            return True
        count["nt"] += 1
        own = f"{sent_id}_{count['nt']}"
        rows.append((sent_id, own, "nt", cat, None, None, head, None, parent, gf or EMPTY, place, False))
        for i, child in enumerate(inner):
            if isinstance(child, list):
                visit(child, own, i)
            elif words:
                word, _, pos = child.rpartition("/")
                if not word.startswith("TRACE") and pos != "TRACE":
                    count["t"] += 1
                    rows.append((sent_id, f"{sent_id}_{count['t']}", "t", None, pos, word, None, count["t"], own, EMPTY, i, False))
        return True

    if tree is not None and visit(tree, None, 0) and any(r[2] == "t" for r in rows):
        return rows
    return []


def failed_rows(sent_id: str, words: list[str]) -> list[tuple]:
    """A flat tree for a sentence that wasn't parsed."""
    root = f"{sent_id}_500"
    rows = [(sent_id, root, "nt", "NOPARSE", None, None, None, None, None, EMPTY, 0, True)]
    return rows + [(sent_id, f"{sent_id}_{i + 1}", "t", None, None, w, None, i + 1, root, EMPTY, i, True) for i, w in enumerate(words)]


def read_brackets(parses: DataFrame, style: str = "berkeley") -> DataFrame:
    """NODE rows of parses (sent_id, tree, [words]); a parse that fails gives a flat tree of its words, if given."""
    if style not in STYLES:
        raise ValueError(f"style is one of {STYLES}")
    with_words = "words" in parses.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples(index=False):
                own = tree_rows(r.sent_id, r.tree or "", style)
                rows += own or (failed_rows(r.sent_id, list(r.words)) if with_words and r.words is not None else [])
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])
            frame["term_ord"] = frame["term_ord"].astype("Int32")
            yield frame

    return parses.select("sent_id", "tree", *(["words"] if with_words else [])).mapInPandas(run, NODE)


def nodes_and_edges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = rows.select("sent_id", "node_id", "kind", "cat", "pos", "word", "head", "term_ord", "failed")
    edges = rows.where("parent_id is not null").select("sent_id", "parent_id", F.col("node_id").alias("child_id"), "label", "child_ord", F.lit(True).alias("is_tree"))
    return nodes, edges


# Tags of the tagger that parsers name otherwise.
TAG_CHANGES = {"collins": (("\\(", "-LRB-"), ("\\)", "-RRB-"), ("^''$", "\""), ("\\$", "$")), "berkeley": (("\\(", "*LRB*"), ("\\)", "*RRB*"), ("^PRP\\$$", "PRP$"))}


def convert_tags(tag: Column, parser: str) -> Column:
    for pattern, new in TAG_CHANGES[parser]:
        tag = F.regexp_replace(tag, pattern, new.replace("$", "\\$"))
    return tag
