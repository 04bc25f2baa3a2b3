"""Categories, voice, prepositions, heads and grammatical functions from labels and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.operators import trees

# What labels stand for, tried in this order. English labels are cut at a hyphen.
ENGLISH = (
    ("adj", r"^JJ|(WH)?ADJP|^PDT"),
    ("adv", r"^RB|(WH)?ADVP|^UH"),
    ("card", r"^CD|^QP"),
    ("con", r"^CC|^WRB|^CONJP"),
    ("det", r"^DT|^POS"),
    ("for", r"^FW|^SYM"),
    ("noun", r"^N|^WHAD$|^WDT$|^PRP|^WHNP|^EX|^WP"),
    ("prep", r"^IN|^TO|(WH)?PP|^RP$|^PR(T|N)"),
    ("pun", r"^PUNC|LRB|RRB|[,'\".:;!?()]"),
    ("sent", r"^S(s|bar|BAR|G|Q|BARQ|INV)?$|^UCP|^FRAG|^X|^INTJ"),
    ("top", r"^TOP"),
    ("trace", r"^TRACE"),
    ("verb", r"^V|^MD"),
)
GERMAN = (
    ("adj", r"^C?ADJ|^PIS|^C?AP[^A-Za-z]?"),
    ("adv", r"^C?ADV|^C?AVP|^PROAV"),
    ("card", r"^CARD"),
    ("con", r"^C?KO"),
    ("det", r"^PPOS|^ART|^PIAT|^PD|^PRELAT|^PWAT"),
    ("for", r"^FM|^XY"),
    ("noun", r"^C?N|^PPER|^PN|^PRELS|^PWS"),
    ("sent", r"^ITJ"),
    ("part", r"^PRF|^PTK|^TRUNC"),
    ("prep", r"^C?PP|^APPR|^PWAV"),
    ("pun", r"^\$"),
    ("sent", r"^C?S$|^CO|^DL|^CH|^ISU"),
    ("top", r"^TOP"),
    ("verb", r"^C?V"),
)
RULES = {"en": ENGLISH, "de": GERMAN}
RELATIVE = {"en": r"^WDT|^WHAD|^WHNP|^WP", "de": r"^PREL|^PWAV|^PWAT"}
BE = ("be", "am", "is", "are", "was", "were")
AUXILIARIES = {"en": ("have", "do", "be"), "de": ("haben", "sein", "werden")}
MODALS = {"en": ("can", "could", "may", "might", "must", "shall", "should", "will", "would"), "de": ("dürfen", "können", "mögen", "müssen", "sollen", "wollen")}


def category(label: Column, language: str = "en") -> Column:
    """The coarse category of a part of speech or phrase label; null if none fits."""
    text = F.trim(label)
    text = F.regexp_extract(text, "^([^-]*)", 1) if language == "en" else text
    out = None
    for name, pattern in RULES[language]:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def simplified(label: Column) -> Column:
    """The label up to its first function mark."""
    return F.regexp_extract(label, "^([^-]*)", 1)


def is_relative_pronoun(label: Column, language: str = "en") -> Column:
    return F.coalesce(simplified(label).rlike(RELATIVE[language]), F.lit(False))


def is_auxiliary(lemma: Column, language: str = "en") -> Column:
    return F.coalesce(lemma.isin(*AUXILIARIES[language]), F.lit(False))


def is_modal(label: Column, lemma: Column, language: str = "en") -> Column:
    by_label = label.rlike("^MD") if language == "en" else label.rlike("^VM")
    return F.coalesce(by_label | lemma.isin(*MODALS[language]), F.lit(False))


def lemma_or_word(lemma: Column, word: Column) -> Column:
    first = F.nullif(F.regexp_extract(lemma, r"^([^|]+)", 1), F.lit(""))
    return F.coalesce(F.when(lemma != "<unknown>", first), word)


def with_categories(nodes: DataFrame, language: str = "en") -> DataFrame:
    """nodes with pt (cat, or pos of terminals), simple_pt and category."""
    pt = F.coalesce("cat", "pos")
    return nodes.withColumn("pt", pt).withColumn("simple_pt", simplified(pt)).withColumn("category", category(pt, language))


def english_voice(nodes: DataFrame, edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(sent_id, node_id, voice) of verb terminals.

    Under verbs and sentences: passive if a form of be is a child of one of the unbroken line of
    verb or sentence ancestors, else active. Elsewhere past forms are passive. Verbs without
    a grandparent have none.
    """
    named = with_categories(nodes).withColumn("lemma_", lemma_or_word(F.col("lemma"), F.col("word")))
    verbs = named.where("category = 'verb' and kind = 't'").select("sent_id", "node_id", "pt")
    above = ancestors.join(named.select("sent_id", F.col("node_id").alias("ancestor_id"), F.col("category").alias("above")), ["sent_id", "ancestor_id"])
    line = verbs.join(above, ["sent_id", "node_id"])
    breaks = F.min(F.when(~F.col("above").isin("verb", "sent") | F.col("above").isNull(), F.col("depth")))
    facts = line.groupBy("sent_id", "node_id", "pt").agg(breaks.alias("broken"), F.max(F.when(F.col("depth") == 2, F.col("above"))).alias("grand"), F.max("depth").alias("height"))
    be = edges.join(named.where(F.col("lemma_").isin(*BE)).select("sent_id", F.col("node_id").alias("child_id")), ["sent_id", "child_id"])
    be = be.select("sent_id", F.col("parent_id").alias("ancestor_id")).distinct()
    near = line.join(be.hint("merge"), ["sent_id", "ancestor_id"]).groupBy("sent_id", "node_id").agg(F.min("depth").alias("be_depth"))
    joined = facts.join(near.hint("merge"), ["sent_id", "node_id"], "left")
    commanded = F.col("be_depth").isNotNull() & (F.col("broken").isNull() | (F.col("be_depth") < F.col("broken")))
    voice = (
        F.when(F.col("height") < 2, None)
        .when(F.col("grand").isin("verb", "sent"), F.when(commanded, "passive").otherwise("active"))
        .when(F.col("pt").isin("VBN", "VBD"), "passive")
    )
    return joined.select("sent_id", "node_id", voice.alias("voice"))


def prepositions(nodes: DataFrame, node_yield: DataFrame, language: str = "en") -> DataFrame:
    """(sent_id, node_id, prep): the first preposition below each prepositional phrase, as lemma."""
    named = with_categories(nodes, language).withColumn("lemma_", F.lower(lemma_or_word(F.col("lemma"), F.col("word"))))
    phrases = named.where("category = 'prep'").select("sent_id", "node_id")
    words = named.where("category = 'prep' and kind = 't'").select("sent_id", F.col("node_id").alias("term_id"), "lemma_", "term_ord")
    return node_yield.join(phrases, ["sent_id", "node_id"], "left_semi").join(words, ["sent_id", "term_id"]).groupBy("sent_id", "node_id").agg(F.min_by("lemma_", "term_ord").alias("prep"))


# Which child heads a phrase: edge label, and whether the first or last such child.
GERMAN_HEADS = {
    "AP": ("HD", "last"), "AVP": ("HD", "last"), "VP": ("HD", "last"), "VZ": ("HD", "last"), "S": ("HD", "last"),
    "NM": ("NMC", "last"), "NP": ("NK", "last"), "PP": ("NK", "last"), "PN": ("PNC", "last"),
    "CAP": ("CJ", "first"), "CAVP": ("CJ", "first"), "CNP": ("CJ", "first"), "CPP": ("CJ", "first"), "CS": ("CJ", "first"), "CVP": ("CJ", "first"),
}


def heads(nodes: DataFrame, edges: DataFrame, node_yield: DataFrame, ancestors: DataFrame, language: str = "en", height: int | None = None) -> DataFrame:
    """(sent_id, node_id, head_id): the head terminal of each node.

    The head attribute of a node names a word of its yield; otherwise a German phrase is headed
    by the child that its rule names, an English one by its last child of its own category,
    or else its last word that isn't punctuation.
    """
    named = with_categories(nodes, language)
    terminals = named.where("kind = 't'").select("sent_id", F.col("node_id").alias("term_id"), "word", "term_ord", "is_punct", F.col("category").alias("t_category"))
    below = node_yield.join(terminals, ["sent_id", "term_id"]).join(named.select("sent_id", "node_id", "kind", "head", "category", "cat"), ["sent_id", "node_id"])
    by_word = F.min_by("term_id", F.when(F.lower("word") == F.lower("head"), F.col("term_ord")))
    same = F.max_by("term_id", F.when((F.col("t_category") == F.col("category")) & ~F.col("is_punct"), F.col("term_ord")))
    last = F.max_by("term_id", F.when(~F.col("is_punct"), F.col("term_ord")))
    fallback = below.groupBy("sent_id", "node_id").agg(by_word.alias("by_word"), F.coalesce(same, last, F.max("term_id")).alias("other"))
    if language != "de":
        return fallback.select("sent_id", "node_id", F.coalesce("by_word", "other").alias("head_id"))
    rule = None
    for cat, (label, side) in GERMAN_HEADS.items():
        hit = (F.col("cat") == cat) & (F.col("label") == label)
        sign = F.lit(1 if side == "last" else -1)
        rule = F.when(hit, sign) if rule is None else rule.when(hit, sign)
    children = edges.join(named.select("sent_id", F.col("node_id").alias("parent_id"), "cat"), ["sent_id", "parent_id"]).withColumn("sign", rule)
    picked = children.where("sign is not null").groupBy("sent_id", F.col("parent_id").alias("node_id")).agg(F.max_by("child_id", F.col("child_ord") * F.col("sign")).alias("child_id"))
    # chains of head children end at terminals: a closure over one edge a node
    chain = picked.select("sent_id", F.col("node_id").alias("child_id"), F.col("child_id").alias("parent_id"), F.lit("").alias("label"))
    reach = trees.closure(chain, height).select("sent_id", "node_id", F.col("ancestor_id").alias("term_id"))
    ends = reach.join(terminals.select("sent_id", "term_id"), ["sent_id", "term_id"], "left_semi").groupBy("sent_id", "node_id").agg(F.min("term_id").alias("by_rule"))
    return fallback.join(ends, ["sent_id", "node_id"], "left").select("sent_id", "node_id", F.coalesce("by_word", "by_rule", "other").alias("head_id"))


def edge_functions(edges: DataFrame) -> DataFrame:
    """(sent_id, anchor_id, gf, node_id): siblings of a node, by their edge labels."""
    head = edges.select("sent_id", "parent_id", F.col("child_id").alias("anchor_id"))
    return edges.select("sent_id", "parent_id", F.col("child_id").alias("node_id"), F.col("label").alias("gf")).join(head, ["sent_id", "parent_id"]).where("node_id <> anchor_id").select("sent_id", "anchor_id", "gf", "node_id")


def english_verb_functions(rows: DataFrame) -> DataFrame:
    """rows with gf, from category, path (printed by direction and category), relpos, voice and prep."""
    inside = F.col("path").isin("U VP D ", "U SG D ")
    outside = F.col("path").rlike(r"^U (VP U )*S(BAR)? D $") | F.col("path").rlike(r"^U (VP U )*VP D ADVP D $")
    passive = F.col("voice") == "passive"
    gf = (
        F.when((F.col("category") == "noun") & inside, "OA")
        .when((F.col("category") == "noun") & outside & (F.col("relpos") == "LEFT"), F.when(passive, "OA").otherwise("SB"))
        .when((F.col("category") == "prep") & inside, F.when(passive & (F.col("prep") == "by"), "SB").otherwise(F.concat(F.lit("MO-"), F.coalesce("prep", F.lit("")))))
        .when((F.col("category") == "sent") & (inside | outside), "OC")
    )
    return rows.withColumn("gf", gf)


def governing_verbs(functions: DataFrame, nodes: DataFrame, language: str = "en") -> DataFrame:
    """(sent_id, node_id, verb_id) of nodes that fill a function of a verb."""
    verbs = with_categories(nodes, language).where("category = 'verb'").select("sent_id", F.col("node_id").alias("anchor_id"))
    return functions.join(verbs, ["sent_id", "anchor_id"], "left_semi").select("sent_id", "node_id", F.col("anchor_id").alias("verb_id")).distinct()


def dependencies(functions: DataFrame, head_of: DataFrame) -> DataFrame:
    """(sent_id, head_id, relation, dependent_id) between head terminals, each once."""
    a = head_of.select("sent_id", F.col("node_id").alias("anchor_id"), F.col("head_id"))
    b = head_of.select("sent_id", "node_id", F.col("head_id").alias("dependent_id"))
    return functions.join(a, ["sent_id", "anchor_id"]).join(b, ["sent_id", "node_id"]).where("head_id <> dependent_id").select("sent_id", "head_id", F.col("gf").alias("relation"), "dependent_id").distinct()


#: Phrases with a content of their own, and the tags that its head has by choice.
CONTENT = {
    "en": {"SBAR": "^VB", "VP": "^VB", "PP": "^NN"},
    "de": {"S": "^V", "CS": "^V", "VP": "^V", "CVP": "^V", "PP": "^N", "CPP": "^N"},
}


def informative_content(nodes: DataFrame, edges: DataFrame, head_of: DataFrame, language: str = "en") -> DataFrame:
    """(sent_id, node_id, content_id): the head of a phrase's content, for the phrases of CONTENT.

    Content is the only child with another head lemma than the phrase's; of several the first
    whose head has the phrase's tag, or else the first.
    """
    tags = F.create_map(*[F.lit(x) for pair in CONTENT[language].items() for x in pair])
    lemma = nodes.select("sent_id", F.col("node_id").alias("head_id"), lemma_or_word(F.col("lemma"), F.col("word")).alias("head_lemma"), F.col("pos").alias("head_pos"))
    heads_ = head_of.select("sent_id", "node_id", "head_id").join(lemma, ["sent_id", "head_id"])
    own = with_categories(nodes, language).where(F.col("simple_pt").isin(*CONTENT[language])).select("sent_id", "node_id", tags[F.col("simple_pt")].alias("tag"))
    own = own.join(heads_.select("sent_id", "node_id", F.col("head_lemma").alias("own_lemma")), ["sent_id", "node_id"]).withColumnRenamed("node_id", "parent_id")
    children = edges.select("sent_id", "parent_id", "child_id", "child_ord").join(heads_.withColumnRenamed("node_id", "child_id"), ["sent_id", "child_id"])
    others = children.join(own.hint("merge"), ["sent_id", "parent_id"]).where(~F.col("head_lemma").eqNullSafe(F.col("own_lemma")))
    place = F.struct((~F.coalesce(F.expr("head_pos rlike tag"), F.lit(False))).alias("other"), "child_ord", "child_id")
    return others.groupBy("sent_id", F.col("parent_id").alias("node_id")).agg(F.min_by("head_id", place).alias("content_id"))


def merged_particles(targets: DataFrame, particles: DataFrame, language: str = "en") -> DataFrame:
    """targets (sent_id, node_id, lemma) with separable particles (sent_id, node_id, particle) joined in."""
    joined = targets.join(particles.select("sent_id", "node_id", "particle"), ["sent_id", "node_id"], "left")
    text = F.concat("particle", "lemma") if language == "de" else F.concat_ws(" ", "lemma", "particle")
    return joined.withColumn("lemma", F.when(F.col("particle").isNotNull(), text).otherwise(F.col("lemma"))).drop("particle")


def kept_frames(frames: DataFrame) -> DataFrame:
    """Frames without deprecated ones."""
    return frames.where(~F.col("name").rlike("^Test|^Boulder$"))


def named_unknown(frames: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Unknown frames get their target's lemma before the name; lemmas: (sent_id, frame_id, lemma)."""
    joined = frames.join(lemmas, ["sent_id", "frame_id"], "left")
    return joined.withColumn("name", F.when(F.col("name").startswith("Unknown") & F.col("lemma").isNotNull(), F.concat_ws("_", "lemma", "name")).otherwise(F.col("name"))).drop("lemma")


def targets_of_frames(frames: DataFrame, target_nodes: DataFrame, node_yield: DataFrame, nodes: DataFrame, language: str = "en") -> DataFrame:
    """(sent_id, frame_id, ids, main_id, lemma, pos): all target terminals and the main one.

    The main one is the first verb, else the first noun, adjective, preposition, else the first word.
    """
    named = with_categories(nodes, language).where("kind = 't'")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("verb", "noun", "adj", "prep"))), F.col("category")), F.lit(0))
    words = named.select("sent_id", F.col("node_id").alias("term_id"), lemma_or_word(F.col("lemma"), F.col("word")).alias("lemma"), F.col("category").alias("pos"), F.struct(F.when(rank > 0, rank).otherwise(9).alias("r"), "term_ord").alias("o"), "term_ord")
    found = target_nodes.join(node_yield, ["sent_id", "node_id"]).join(words, ["sent_id", "term_id"])
    main = F.min_by(F.struct(F.col("term_id").alias("main_id"), "lemma", "pos"), "o")
    out = found.groupBy("sent_id", "frame_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("term_ord", "term_id"))), lambda x: x["term_id"]).alias("ids"), main.alias("m"))
    return out.join(frames.select("sent_id", "frame_id", "name"), ["sent_id", "frame_id"]).select("sent_id", "frame_id", "name", "ids", "m.*")


def all_targets(nodes: DataFrame, known: DataFrame, language: str = "en") -> DataFrame:
    """Terminals whose lemma and category are known (lemma, pos), without auxiliaries and prepositions."""
    named = with_categories(nodes, language).where("kind = 't' and category <> 'prep'").withColumn("lemma", F.lower(lemma_or_word(F.col("lemma"), F.col("word"))))
    rows = named.where(~is_auxiliary(F.col("lemma"), language)).select("sent_id", "node_id", "lemma", F.col("category").alias("pos"))
    return rows.join(known.select("lemma", "pos").distinct(), ["lemma", "pos"], "left_semi").select("sent_id", "node_id", "lemma", "pos")


def main_constituent_first(rows: DataFrame) -> DataFrame:
    """rows (sent_id, set_id, node_id, low) with only the first node of each set."""
    order = Window.partitionBy("sent_id", "set_id").orderBy("low", "node_id")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
