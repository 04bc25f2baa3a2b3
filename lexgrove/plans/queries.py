"""Queries over the driver's tables that apply each operator, with SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions import text as fn
from lexgrove.operators import evaluation as ev
from lexgrove.operators import matrix as mx
from lexgrove.operators import relational as rel
from lexgrove.operators import trees, windows
from lexgrove.operators.relational import Where

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(run):  # noqa: ANN001, ANN202
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return keep


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def md5_number(text):  # noqa: ANN001, ANN201
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


# -- views ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey <> 7")
def view_select_where(spark: SparkSession, folder: str) -> DataFrame:
    return rel.view(read(spark, folder, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"], [Where("o_orderstatus", "F"), Where("o_custkey", 7, equal=False)])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'")
def view_not_equal(spark: SparkSession, folder: str) -> DataFrame:
    return rel.view(read(spark, folder, "customer"), ["c_custkey", "c_name", "c_mktsegment"], [Where("c_mktsegment", "BUILDING", equal=False)]).select("c_custkey", "c_name")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def view_distinct_groups(spark: SparkSession, folder: str) -> DataFrame:
    return rel.groups(read(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def view_limit_ordered(spark: SparkSession, folder: str) -> DataFrame:
    return rel.view(read(spark, folder, "orders"), ["o_orderkey", "o_custkey"], limit=100, order=["o_orderkey"])


@query(
    "SELECT p_partkey, concat_ws(',', replace(replace(p_name, ',', 'COMMA'), '\\', 'BACK'), replace(replace(p_brand, ',', 'COMMA'), '\\', 'BACK'), "
    "replace(replace(p_type, ',', 'COMMA'), '\\', 'BACK')) AS instance FROM part"
)
def view_gold_last(spark: SparkSession, folder: str) -> DataFrame:
    return rel.gold_last(read(spark, folder, "part"), ["p_name", "p_brand"], "p_type").select("p_partkey", "instance")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'NONE' ELSE 'FE' END AS gold FROM orders")
def dyn_gold_binary(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "O", "NONE").otherwise(F.col("o_orderstatus"))
    return read(spark, folder, "orders").select("o_orderkey", rel.binary_gold(label).alias("gold"))


_SPLIT = f"{_HASH.format(repr('split:') + ' || o_custkey')} % 100 < 90"


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN {_SPLIT} THEN 'train' ELSE 'test' END AS dataset FROM orders")
def split_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return rel.split(read(spark, folder, "orders"), "o_custkey").select("o_orderkey", "o_custkey", "dataset")


@query(f"SELECT dataset, count(*) AS n, count(DISTINCT o_custkey) AS keys FROM (SELECT *, CASE WHEN {_SPLIT} THEN 'train' ELSE 'test' END AS dataset FROM orders) GROUP BY dataset")
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = rel.split(read(spark, folder, "orders").select("o_custkey"), "o_custkey")
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("keys"))


@query(
    f"SELECT o_orderkey, o_orderpriority FROM orders WHERE {_SPLIT} AND o_orderkey IN "
    "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"
)
def join_main_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = read(spark, folder, "orders")
    chosen = rel.split(rel.view(orders, ["o_orderkey", "o_custkey", "o_orderstatus"], [Where("o_orderstatus", "F")]), "o_custkey").where("dataset = 'train'")
    return rel.join_view(orders, chosen.select(F.col("o_orderkey").alias("split_index"), "dataset"), "o_orderkey", "split_index", ["o_orderkey", "o_orderpriority"])


@query("SELECT r_name, n_name FROM region, nation")
def cross_view(spark: SparkSession, folder: str) -> DataFrame:
    return rel.product_view(read(spark, folder, "region").select("r_name"), read(spark, folder, "nation").select("n_name"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    partial = read(spark, folder, "orders").where("o_orderstatus = 'P'")
    return rel.unmatched(read(spark, folder, "customer").select("c_custkey", "c_name"), "c_custkey", partial, "o_custkey")


@query("SELECT length_class, count(*) AS n FROM (SELECT CASE WHEN length(c_name) > 17 THEN 'long' ELSE 'fits' END AS length_class FROM customer) GROUP BY length_class")
def value_lengths(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "customer").select("c_name")
    long = rel.too_long(rows, "c_name", 17).select(F.lit("long").alias("length_class"))
    fits = rows.where(F.length("c_name") <= 17).select(F.lit("fits").alias("length_class"))
    return long.unionAll(fits).groupBy("length_class").agg(F.count(F.lit(1)).alias("n"))


# -- table versions ---------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_column_keyed(spark: SparkSession, folder: str) -> DataFrame:
    customers = read(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = customers.where("c_acctbal < 0").select("c_custkey", F.lit("DEBT").alias("c_mktsegment"))
    return rel.updated(customers, "c_custkey", new, "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("SELECT s_suppkey, 'NONE' AS result_0, 'NONE' AS result_1 FROM supplier")
def add_result_column(spark: SparkSession, folder: str) -> DataFrame:
    return rel.with_results(read(spark, folder, "supplier").select("s_suppkey"), ["result_0", "result_1"])


@query(
    "SELECT n_nationkey % 2 = 0 AS okay, n_regionkey::VARCHAR AS table_id, max(n_nationkey)::INT AS run_id FROM nation WHERE n_nationkey % 2 = 0 GROUP BY ALL"
)
def run_reuse(spark: SparkSession, folder: str) -> DataFrame:
    runs = read(spark, folder, "nation").select(
        F.col("n_nationkey").cast("int").alias("run_id"), F.col("n_regionkey").cast("string").alias("table_id"), F.lit("argrec").alias("step"), (F.col("n_nationkey") % 2 == 0).alias("okay")
    )
    return rel.latest_run(runs).select("okay", "table_id", "run_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS row_id FROM orders")
def autoincrement_index(spark: SparkSession, folder: str) -> DataFrame:
    return rel.with_index(read(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"]).select("o_orderkey", "row_id")


# -- joins of texts ---------------------------------------------------------------------------------

_SUM = "md5(regexp_replace(lower(text), '[^a-z]', '', 'g'))"


@query(
    f"SELECT d.doc_id, c.first_id, c.copies FROM (SELECT doc_id, {_SUM} AS s FROM documents) d JOIN "
    f"(SELECT {_SUM} AS s, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1) c USING (s)"
)
def checksum_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("doc_id", fn.letters_checksum(F.col("text")).alias("s"))
    found = rows.groupBy("s").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return rows.join(found, "s").select("doc_id", "first_id", "copies")


_TURN_WORDS = (
    "SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word, "
    "generate_subscripts(string_split(lower(text), ' '), 1) - 1 AS pos FROM conversations WHERE text IS NOT NULL"
)


@query(
    f"WITH w AS ({_TURN_WORDS}), z AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, a.word IS NOT DISTINCT FROM b.word AS same "
    "FROM w a FULL JOIN (SELECT conv_id, turn - 1 AS turn, pos, word FROM w) b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.pos = b.pos) "
    "SELECT conv_id, turn, count(*) AS positions, count(*) FILTER (WHERE same) AS matching, bool_and(same) AS aligned FROM z WHERE turn >= 0 GROUP BY conv_id, turn"
)
def positional_zip_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn with the next one of its conversation, word by word."""
    words = read(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "word"))
    both = windows.zipped(words, words.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn", "pos"], "word", "word")
    return windows.aligned(both.where("turn >= 0"), ["conv_id", "turn"])


# -- evaluation -------------------------------------------------------------------------------------


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    """Order status as gold, a rule of the price as assigned, by priority; some labels are missing."""
    price = F.col("o_totalprice")
    assigned = F.when(price < 50000, "F").when(price < 200000, "O").when(price < 250000, "P").otherwise("-")
    gold = F.when(F.col("o_orderkey") % 11 == 0, "-").otherwise(F.col("o_orderstatus"))
    return read(spark, folder, "orders").select(F.replace("o_orderpriority", F.lit(" "), F.lit("_")).alias("grp"), gold.alias("gold_label"), assigned.alias("assigned_label"))


_GOLD = (
    "SELECT replace(o_orderpriority, ' ', '_') AS grp, CASE WHEN o_orderkey % 11 = 0 THEN '-' ELSE o_orderstatus END AS gold_label, "
    "CASE WHEN o_totalprice < 50000 THEN 'F' WHEN o_totalprice < 200000 THEN 'O' WHEN o_totalprice < 250000 THEN 'P' ELSE '-' END AS assigned_label FROM orders"
)
_COUNTS = (
    "SELECT grp, class, sum(g)::BIGINT AS gold, sum(a)::BIGINT AS assigned, sum(t)::BIGINT AS truepos FROM ("
    f"SELECT grp, gold_label AS class, 1 AS g, 0 AS a, (gold_label = assigned_label)::INT AS t FROM ({_GOLD}) UNION ALL "
    f"SELECT grp, assigned_label, 0, 1, 0 FROM ({_GOLD})) WHERE class NOT IN ('', '-') GROUP BY grp, class"
)
_PRF = (
    "round(CASE WHEN assigned = 0 THEN 0 ELSE truepos / assigned END, 6) AS prec, round(CASE WHEN gold = 0 THEN 0 ELSE truepos / gold END, 6) AS rec, "
    "round(CASE WHEN truepos = 0 THEN 0 ELSE 2.0 * truepos / (assigned + gold) END, 6) AS f"
)


def _rounded(rows: DataFrame) -> DataFrame:
    whole = {c: F.col(c).cast("long") for c in ("gold", "assigned", "truepos", "instances") if c in rows.columns}
    return rows.withColumns(whole | {c: F.round(c, 6) for c in ("prec", "rec", "f", "accuracy") if c in rows.columns})


@query(f"SELECT grp, class, gold, assigned, truepos, {_PRF} FROM ({_COUNTS})")
def eval_group_class_prf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.group_class_prf(_gold(spark, folder)))


@query(
    "SELECT grp, count(*) AS instances, sum((gold_label = assigned_label)::INT)::BIGINT AS truepos, "
    f"round(sum((gold_label = assigned_label)::INT) / count(*), 6) AS accuracy FROM ({_GOLD}) GROUP BY grp HAVING count(*) FILTER (WHERE gold_label <> '-') > 0"
)
def eval_group_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.group_accuracy(_gold(spark, folder)))


@query(f"SELECT grp, class, gold, assigned, truepos, {_PRF} FROM ({_COUNTS}) WHERE class = 'F'")
def eval_single_class(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.single_class(_gold(spark, folder), "F"))


@query(
    "SELECT count(*) AS instances, sum((gold_label = assigned_label)::INT)::BIGINT AS truepos, "
    f"round(sum((gold_label = assigned_label)::INT) / count(*), 6) AS accuracy FROM ({_GOLD})"
)
def eval_overall(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.overall(_gold(spark, folder)))


@query(
    f"SELECT class, gold, assigned, truepos, {_PRF} FROM (SELECT class, sum(gold)::BIGINT AS gold, sum(assigned)::BIGINT AS assigned, "
    f"sum(truepos)::BIGINT AS truepos FROM ({_COUNTS}) WHERE class = 'O' GROUP BY class)"
)
def eval_overall_single_class(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.overall_single_class(_gold(spark, folder), "O"))


@query(
    "WITH failed AS (SELECT replace(o_orderpriority, ' ', '_') AS grp, o_orderstatus AS class, CAST(round(count(*) / 2) AS BIGINT) AS missed FROM orders WHERE o_orderkey % 11 = 0 GROUP BY ALL) "
    f"SELECT grp, class, gold, assigned, truepos, {_PRF} FROM (SELECT coalesce(c.grp, f.grp) AS grp, coalesce(c.class, f.class) AS class, "
    "coalesce(gold, 0) + coalesce(missed, 0) AS gold, coalesce(assigned, 0) AS assigned, coalesce(truepos, 0) AS truepos "
    f"FROM ({_COUNTS}) c FULL JOIN failed f ON c.grp = f.grp AND c.class = f.class)"
)
def eval_gold_injection(spark: SparkSession, folder: str) -> DataFrame:
    failed = read(spark, folder, "orders").where("o_orderkey % 11 = 0").select(F.replace("o_orderpriority", F.lit(" "), F.lit("_")).alias("grp"), F.col("o_orderstatus").alias("class"))
    return _rounded(ev.with_injected_gold(ev.class_counts(_gold(spark, folder)), failed, parts=2))


def _answers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A user is an instance, its event types with mean values are answers; the first event's type is gold."""
    events = read(spark, folder, "events")
    gold = events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("g"))
    instances = gold.select(F.concat(F.lit("l"), F.col("user_id") % 5).alias("lemma"), F.col("user_id").alias("instance_id"), F.array("g").alias("gold"))
    answers = events.groupBy(F.col("user_id").alias("instance_id"), F.col("event_type").alias("sense")).agg((F.round(F.max("value"), 3) / 100).alias("confidence"))
    return instances, answers


_INSTANCES = "SELECT 'l' || (user_id % 5) AS lemma, user_id AS instance_id, arg_min(event_type, (ts, event_id)) AS gold FROM events GROUP BY user_id"
_ANSWERS = "SELECT user_id AS instance_id, event_type AS sense, round(max(value), 3) / 100 AS confidence FROM events GROUP BY user_id, event_type"


@query(
    f"WITH best AS (SELECT instance_id, sense AS best FROM ({_ANSWERS}) QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY confidence DESC, sense) = 1) "
    f"SELECT lemma, count(*) AS instances, count(*) FILTER (WHERE gold = best) AS truepos, round(count(*) FILTER (WHERE gold = best) / count(*), 6) AS accuracy "
    f"FROM ({_INSTANCES}) JOIN best USING (instance_id) GROUP BY lemma"
)
def sense_eval_lenient(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ev.lenient_accuracy(*_answers(spark, folder)))


@query(
    f"WITH i AS ({_INSTANCES}), a AS ({_ANSWERS}), v AS (SELECT DISTINCT lemma, sense FROM i JOIN a USING (instance_id)) "
    "SELECT i.lemma, i.instance_id, v.sense, (gold = v.sense)::VARCHAR AS gold_label, coalesce(confidence >= 0.5, false)::VARCHAR AS assigned_label "
    "FROM i JOIN v USING (lemma) LEFT JOIN a ON a.instance_id = i.instance_id AND a.sense = v.sense"
)
def sense_eval_threshold(spark: SparkSession, folder: str) -> DataFrame:
    instances, answers = _answers(spark, folder)
    inventory = instances.join(answers, "instance_id").select("lemma", "sense").distinct()
    return ev.thresholded(instances, answers, inventory, 0.5)


@query(
    "WITH m AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), "
    "b AS (SELECT user_id, event_type AS predicted FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1) "
    "SELECT event_id, event_type, predicted FROM events JOIN b USING (user_id)"
)
def baseline_mfs(spark: SparkSession, folder: str) -> DataFrame:
    events = read(spark, folder, "events").select("event_id", "event_type", "user_id")
    return ev.baseline(events, events, "user_id", "event_type").select("event_id", "event_type", "predicted")


@query("SELECT CAST(floor((c_acctbal + 1000) / 500) AS BIGINT) AS bin, round(avg(c_custkey), 6) AS average, count(*) AS n FROM customer GROUP BY bin")
def binned_average(spark: SparkSession, folder: str) -> DataFrame:
    return ev.binned_average(read(spark, folder, "customer"), "c_acctbal", "c_custkey", -1000, 500).withColumn("average", F.round("average", 6))


@query(
    "WITH e AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem) "
    "SELECT CAST(least(floor((l_extendedprice - low) / (high - low) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM lineitem, e GROUP BY bin"
)
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ev.histogram(read(spark, folder, "lineitem"), "l_extendedprice")


@query(
    "WITH r AS (SELECT s_suppkey AS k, s_nationkey::VARCHAR AS grp, s_acctbal AS x, (s_suppkey % 17)::DOUBLE AS y FROM supplier), "
    "p AS (SELECT a.grp, sign(a.x - b.x) * sign(a.y - b.y) AS s, (a.x <> b.x)::INT AS dx, (a.y <> b.y)::INT AS dy FROM r a JOIN r b ON a.grp = b.grp AND a.k < b.k), "
    "t AS (SELECT grp, CASE WHEN sum(dx) * sum(dy) > 0 THEN round(sum(s) / sqrt(sum(dx) * sum(dy)), 9) END AS tau FROM p GROUP BY grp) SELECT grp, tau FROM (SELECT DISTINCT grp FROM r) LEFT JOIN t USING (grp)"
)
def kendall_tau(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "supplier").select(F.col("s_nationkey").cast("string").alias("grp"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 17).cast("double").alias("y"))
    return ev.kendall_tau(rows, "grp", "x", "y").withColumn("tau", F.when(~F.isnan("tau"), F.round("tau", 9)))


# -- sequences --------------------------------------------------------------------------------------

_TOKENS = (
    "SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word, "
    "generate_subscripts(string_split(lower(text), ' '), 1) - 1 AS pos FROM documents) WHERE word <> '' AND NOT regexp_matches(word, '^[^\\pL\\pN]+$')"
)


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return windows.tokens(read(spark, folder, "documents"))


@query(
    f"SELECT doc_id, pos::INT AS pos, word, coalesce(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' '), '') AS lhs, "
    f"coalesce(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ' '), '') AS rhs FROM ({_TOKENS})"
)
def ctx_window_sentence(spark: SparkSession, folder: str) -> DataFrame:
    found = windows.symmetric_context(_tokens(spark, folder), ["doc_id"], ["pos"], "word", 2)
    return found.select("doc_id", "pos", "word", F.array_join("left", " ").alias("lhs"), F.array_join("right", " ").alias("rhs"))


_TURN_TOKENS = (
    "SELECT conv_id, turn, pos, word, row_number() OVER (ORDER BY conv_id, turn, pos) - 1 AS i FROM (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word, "
    "generate_subscripts(string_split(lower(text), ' '), 1) - 1 AS pos FROM conversations) WHERE word <> '' AND NOT regexp_matches(word, '^[^\\pL\\pN]+$')"
)


@query(
    "SELECT i, word, coalesce(array_to_string(list(word) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), '') AS lhs, "
    f"coalesce(array_to_string(list(word) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ' '), '') AS rhs FROM ({_TURN_TOKENS})"
)
def ctx_window_contiguous(spark: SparkSession, folder: str) -> DataFrame:
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "word"))
    words = turns.where("word <> ''").where(~F.col("word").rlike(windows.PUNCTUATION))
    numbered = rel.with_index(words, ["conv_id", "turn", "pos"], "i")
    found = windows.chunked_context(numbered, "i", "word", 3, chunk=20_000)
    return found.select("i", "word", F.array_join("left", " ").alias("lhs"), F.array_join("right", " ").alias("rhs"))


@query(
    f"WITH c AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, "
    f"list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS r FROM ({_TOKENS})) "
    "SELECT doc_id, pos::INT AS pos, concat_ws('_', l[-1], r[1]) AS bigram, concat_ws('_', l[-2], l[-1], r[1]) AS trigram FROM c"
)
def ngram_edges(spark: SparkSession, folder: str) -> DataFrame:
    found = windows.symmetric_context(_tokens(spark, folder), ["doc_id"], ["pos"], "word", 2)
    return found.select("doc_id", "pos", *[v.alias(k) for k, v in windows.ngrams_around(F.col("left"), F.col("right")).items()])


@query(
    "WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM f"
)
def run_group_islands(spark: SparkSession, folder: str) -> DataFrame:
    return windows.islands(read(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "island")


@query(
    "WITH m AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'B' ELSE 'E' END AS side FROM events WHERE event_type IN ('click', 'purchase')), "
    "p AS (SELECT *, lead(side) OVER w AS next_side, lead(event_id) OVER w AS last FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) "
    "SELECT user_id, 'x' AS label, event_id AS first, last FROM p WHERE side = 'B' AND next_side = 'E'"
)
def span_decode(spark: SparkSession, folder: str) -> DataFrame:
    tag = F.when(F.col("event_type") == "click", "B-x").when(F.col("event_type") == "purchase", "E-x").otherwise("-")
    return windows.decode_spans(read(spark, folder, "events").withColumn("tag", tag), ["user_id"], "event_id", "tag")


@query(
    "SELECT l_orderkey, l_linenumber, (l_extendedprice = min(l_extendedprice) OVER (PARTITION BY l_orderkey, l_returnflag) AND l_returnflag <> 'N')::INT AS nearest FROM lineitem"
)
def nearest_flag(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return windows.nearest_flags(rows, ["l_orderkey"], "l_returnflag", "l_extendedprice", "nearest", noval="N").select("l_orderkey", "l_linenumber", "nearest")


@query(
    "SELECT n_nationkey, lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS left_sibling, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS right_sibling FROM nation"
)
def sibling_left_right(spark: SparkSession, folder: str) -> DataFrame:
    return windows.siblings(read(spark, folder, "nation"), ["n_regionkey"], ["n_nationkey"], "n_name").select("n_nationkey", "left_sibling", "right_sibling")


@query(
    "WITH s AS (SELECT l_orderkey AS k, l_linenumber AS span_id, l_linenumber * 10 AS start, CAST(l_linenumber * 10 + l_quantity AS INT) AS stop FROM lineitem) "
    "SELECT k, span_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.span_id < a.span_id AND a.start BETWEEN b.start AND b.stop) "
    "AND NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.span_id > a.span_id AND NOT (b.start BETWEEN a.start AND a.stop) AND b.stop BETWEEN a.start AND a.stop)"
)
def span_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    spans = read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("span_id"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("int").alias("stop")
    )
    return windows.without_overlaps(spans, ["k"]).select("k", "span_id")


# -- feature matrices ---------------------------------------------------------------------------------


def _features(spark: SparkSession, folder: str) -> DataFrame:
    words = windows.tokens(read(spark, folder, "documents"), also=["lang"])
    return words.select(F.col("lang").alias("lemma"), F.col("doc_id").alias("instance_id"), F.col("word").alias("feature"))


_FEATURE_COUNTS = f"SELECT lang AS lemma, t.doc_id AS instance_id, word AS feature, count(*) AS n FROM ({_TOKENS}) t JOIN documents d ON t.doc_id = d.doc_id GROUP BY ALL"
_VOCAB = f"SELECT lemma, feature, max(n) AS most FROM ({_FEATURE_COUNTS}) GROUP BY ALL"


@query(_VOCAB)
def vocab_max_counts(spark: SparkSession, folder: str) -> DataFrame:
    return mx.vocabulary(_features(spark, folder))


@query(f"SELECT lemma, instance_id, feature AS column, n AS value FROM ({_FEATURE_COUNTS})")
def matrix_keep(spark: SparkSession, folder: str) -> DataFrame:
    return mx.fitted_matrix(_features(spark, folder), "keep")


_CELLS = (
    "SELECT lemma, instance_id, feature || ' ' || k || '/' || width AS column, 1::BIGINT AS value FROM (SELECT *, unnest(range(width)) AS k FROM "
    f"(SELECT c.*, {{}} AS width FROM ({_FEATURE_COUNTS}) c JOIN ({_VOCAB}) v USING (lemma, feature))) WHERE {{}}"
)


@query(_CELLS.format("most", "n > k"))
def matrix_repeat(spark: SparkSession, folder: str) -> DataFrame:
    return mx.fitted_matrix(_features(spark, folder), "repeat")


@query(_CELLS.format("CAST(ceil(most / 10) AS BIGINT)", "n % 10 > 10 * k"))
def matrix_bin(spark: SparkSession, folder: str) -> DataFrame:
    return mx.fitted_matrix(_features(spark, folder), "bin")


@query("SELECT o_custkey, string_agg(o_orderstatus, '++' ORDER BY o_orderstatus) AS label FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY o_custkey")
def multilabel_join(spark: SparkSession, folder: str) -> DataFrame:
    return mx.joined_labels(read(spark, folder, "orders").select("o_custkey", F.col("o_orderstatus").alias("label")), ["o_custkey"], "label")


@query("SELECT DISTINCT o_custkey, o_orderstatus AS label FROM orders")
def multilabel_repeat(spark: SparkSession, folder: str) -> DataFrame:
    labels = read(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("label"))
    return mx.repeated_labels(labels, "label")


@query(
    "WITH i AS (SELECT doc_id, lang, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label FROM documents JOIN labels USING (doc_id)), "
    "s AS (SELECT DISTINCT lang, label AS sense FROM i) SELECT doc_id, lang, sense, CASE WHEN label = sense THEN sense ELSE 'NONE' END AS target FROM i JOIN s USING (lang)"
)
def binarize(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("bad")
    rows = read(spark, folder, "documents").select("doc_id", "lang").join(read(spark, folder, "labels"), "doc_id")
    return mx.binarized(rows.select("doc_id", "lang", F.array(label).alias("labels")), "lang", "labels").select("doc_id", "lang", "sense", "target")


@query(
    "WITH l AS (SELECT 'o_custkey' AS feature, o_custkey::VARCHAR AS value, o_orderstatus AS label FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderstatus FROM orders) "
    "SELECT feature, value, min(label) AS label FROM l GROUP BY feature, value HAVING count(DISTINCT label) = 1"
)
def value_purity(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "orders").withColumnRenamed("o_orderstatus", "label")
    return mx.pure_values(rows, ["o_custkey", "o_orderpriority"], "label")


# -- trees ------------------------------------------------------------------------------------------


def _forest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Regions over nations over customers over orders: nodes and edges of one forest."""
    region, nation, customer, orders = (read(spark, folder, t) for t in ("region", "nation", "customer", "orders"))
    node = lambda df, prefix, key, kind, cat: df.select(F.concat(F.lit(prefix), key).alias("node_id"), F.lit(kind).alias("kind"), cat.cast("string").alias("cat"))
    nodes = node(region, "R", "r_regionkey", "nt", F.lit("S")).unionAll(node(nation, "N", "n_nationkey", "nt", F.lit("VP"))).unionAll(node(customer, "C", "c_custkey", "nt", F.col("c_mktsegment"))).unionAll(node(orders, "O", "o_orderkey", "t", F.col("o_orderstatus")))
    edge = lambda df, up, parent, down, child, label: df.select(F.concat(F.lit(up), parent).alias("parent_id"), F.concat(F.lit(down), child).alias("child_id"), F.lit(label).alias("label"))
    edges = edge(nation, "R", "n_regionkey", "N", "n_nationkey", "HD").unionAll(edge(customer, "N", "c_nationkey", "C", "c_custkey", "OA")).unionAll(edge(orders, "C", "o_custkey", "O", "o_orderkey", "NK"))
    one = F.lit("s").alias("sent_id")
    return nodes.select(one, "*").withColumn("is_punct", F.lit(False)), edges.select(one, "*")


_EDGES = (
    "SELECT 'R' || n_regionkey AS parent_id, 'N' || n_nationkey AS child_id, 'HD' AS label FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'OA' FROM customer "
    "UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'NK' FROM orders"
)
_UP = (
    f"WITH RECURSIVE e AS ({_EDGES}), up AS (SELECT child_id AS node_id, parent_id AS ancestor_id, 1 AS depth FROM e UNION ALL "
    "SELECT up.node_id, e.parent_id, up.depth + 1 FROM up JOIN e ON up.ancestor_id = e.child_id) "
)


@query(_UP + "SELECT node_id, ancestor_id, depth FROM up")
def tree_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return trees.closure(_forest(spark, folder)[1], height=3).select("node_id", "ancestor_id", "depth")


@query(_UP + "SELECT ancestor_id AS node_id, count(*) AS n, min(node_id) AS first_term FROM up WHERE node_id LIKE 'O%' GROUP BY ancestor_id")
def tree_yield(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _forest(spark, folder)
    found = trees.node_yield(nodes, trees.closure(edges, height=3)).where("node_id not like 'O%'")
    return found.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.min("term_id").alias("first_term"))


@query("SELECT parent_id AS node_id, count(*) AS outdeg FROM (" + _EDGES + ") GROUP BY parent_id")
def tree_degrees(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _forest(spark, folder)
    return trees.degrees(nodes, edges).where("outdeg > 0").select("node_id", "outdeg")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every order with the next one by customer and key."""
    placed = rel.with_index(read(spark, folder, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "place")
    order = lambda name, place: placed.select(F.concat(F.lit("O"), "o_orderkey").alias(name), place.alias("place"))
    return order("a", F.col("place")).join(order("b", F.col("place") - 1), "place").select(F.lit("s").alias("sent_id"), "a", "b")


_PAIRS = (
    "pairs AS (SELECT * FROM (SELECT 'O' || o_orderkey AS a, 'O' || lead(o_orderkey) OVER (ORDER BY o_custkey, o_orderkey) AS b FROM orders) WHERE b IS NOT NULL), "
    "self AS (SELECT node_id, ancestor_id, depth FROM up UNION ALL SELECT DISTINCT node_id, node_id, 0 FROM up), "
    "met AS (SELECT a, b, x.ancestor_id AS lca, x.depth AS up_steps, y.depth AS down_steps FROM pairs JOIN self x ON x.node_id = a JOIN self y ON y.node_id = b AND y.ancestor_id = x.ancestor_id "
    "QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY x.depth + y.depth) = 1) "
)


@query(_UP.rstrip() + ", " + _PAIRS + "SELECT a, b, lca, up_steps, down_steps FROM met")
def tree_lca(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _forest(spark, folder)
    return trees.lowest_common(_pairs(spark, folder), trees.with_self(nodes, trees.closure(edges, height=3))).select("a", "b", "lca", "up_steps", "down_steps")


_CATS = (
    "cat AS (SELECT 'R' || r_regionkey AS node_id, 'S' AS cat FROM region UNION ALL SELECT 'N' || n_nationkey, 'VP' FROM nation UNION ALL SELECT 'C' || c_custkey, c_mktsegment FROM customer "
    "UNION ALL SELECT 'O' || o_orderkey, o_orderstatus FROM orders), "
    "ups AS (SELECT a, b, string_agg('U ' || e.label || ' ' || p.cat || ' ', '' ORDER BY s.depth) AS t FROM met JOIN self s ON s.node_id = a AND s.depth < up_steps "
    "JOIN e ON e.child_id = s.ancestor_id JOIN cat p ON p.node_id = e.parent_id GROUP BY a, b), "
    "downs AS (SELECT a, b, string_agg('D ' || e.label || ' ' || p.cat || ' ', '' ORDER BY s.depth DESC) AS t FROM met JOIN self s ON s.node_id = b AND s.depth < down_steps "
    "JOIN e ON e.child_id = s.ancestor_id JOIN cat p ON p.node_id = s.ancestor_id GROUP BY a, b) "
)


@query(_UP.rstrip() + ", " + _PAIRS.rstrip() + ", " + _CATS + "SELECT met.a, met.b, coalesce(ups.t, '') || coalesce(downs.t, '') AS path FROM met LEFT JOIN ups USING (a, b) LEFT JOIN downs USING (a, b)")
def tree_paths(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _forest(spark, folder)
    found = trees.paths(_pairs(spark, folder), nodes, edges, trees.closure(edges, height=3))
    return found.select("a", "b", trees.printed(F.col("path")).alias("path"))


_WANTED = "want AS (SELECT 'O' || o_orderkey AS node_id FROM orders WHERE o_custkey % 3 <> 0 OR o_orderstatus = 'F')"


@query(
    _UP.rstrip() + f", {_WANTED}, self AS (SELECT node_id, ancestor_id FROM up WHERE node_id LIKE 'O%' UNION ALL SELECT 'O' || o_orderkey, 'O' || o_orderkey FROM orders), "
    "cov AS (SELECT ancestor_id AS node_id FROM self LEFT JOIN want w ON w.node_id = self.node_id GROUP BY ancestor_id HAVING count(*) = count(w.node_id)) "
    "SELECT node_id FROM cov WHERE node_id NOT IN (SELECT child_id FROM e JOIN cov ON cov.node_id = e.parent_id)"
)
def max_constituents(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _forest(spark, folder)
    wanted = read(spark, folder, "orders").where("o_custkey % 3 <> 0 or o_orderstatus = 'F'").select(F.lit("s").alias("sent_id"), F.lit("x").alias("set_id"), F.concat(F.lit("O"), "o_orderkey").alias("term_id"))
    return trees.maximal_constituents(wanted, nodes, edges, trees.closure(edges, height=3)).select("node_id")


_LABELS = f"lab AS (SELECT node_id, CASE {_HASH.format('node_id')} % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'NONE' END AS label FROM (SELECT child_id AS node_id FROM e))"


@query(
    _UP.rstrip() + f", {_LABELS} SELECT node_id, CASE WHEN EXISTS (SELECT 1 FROM up JOIN lab a ON a.node_id = up.ancestor_id WHERE up.node_id = lab.node_id AND a.label = lab.label) "
    "THEN 'NONE' ELSE label END AS kept FROM lab"
)
def overlap_removal(spark: SparkSession, folder: str) -> DataFrame:
    _, edges = _forest(spark, folder)
    number = md5_number(F.col("child_id")) % 4
    rows = edges.select("sent_id", F.col("child_id").alias("node_id"), F.when(number == 0, "A").when(number == 1, "B").otherwise("NONE").alias("label"))
    return trees.without_overlaps(rows, trees.closure(edges, height=3)).select("node_id", "kept")


@query(
    _UP.rstrip() + ", " + _PAIRS + "SELECT a, b, CASE WHEN (up_steps = 0 AND down_steps = 0) OR (up_steps >= 1 AND (down_steps = 1 OR (down_steps = 2 AND b LIKE '%1'))) THEN 1 ELSE 0 END AS prune FROM met"
)
def prune_rule(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = _forest(spark, folder)
    met = trees.lowest_common(_pairs(spark, folder), trees.with_self(nodes, trees.closure(edges, height=3)))
    return met.select("a", "b", trees.prune(F.col("up_steps"), F.col("down_steps"), F.col("b").like("%1"), F.lit(False)).alias("prune"))


# -- texts ------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages")
def xml_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


@query(
    "SELECT conv_id, turn, sentence, count(*) AS lines FROM (SELECT conv_id, turn, line, sum((line = '')::INT) OVER (PARTITION BY conv_id, turn ORDER BY n)::BIGINT AS sentence FROM "
    "(SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations)) WHERE line <> '' GROUP BY ALL"
)
def pos_zip_text(spark: SparkSession, folder: str) -> DataFrame:
    lines = read(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    found = windows.sentences(lines, ["conv_id", "turn"], ["n"], F.col("line") == "")
    return found.groupBy("conv_id", "turn", "sentence").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "SELECT page_id, replace(replace(replace(url, ',', 'COMMA'), ';', 'SEMICOLON'), ':', 'COLON') AS field, replace(replace(replace(url, '\"', 'QQUOT0'), '''''', 'QQUOT1'), '`', 'QQUOT2') AS quoted, "
    "replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '``', '&quot;'), '\"', '&apos;&apos;'), '''''', '&apos;') AS xml FROM pages"
)
def scalar_escapes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select("page_id", fn.escape_field(F.col("url")).alias("field"), fn.quote_literal(F.col("url")).alias("quoted"), fn.escape_xml(F.col("html")).alias("xml"))


@query(
    "WITH need AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem), have AS (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem) "
    "SELECT l_suppkey FROM have GROUP BY l_suppkey HAVING count(*) = (SELECT count(*) FROM need)"
)
def relational_division(spark: SparkSession, folder: str) -> DataFrame:
    from lexgrove.operators.induction import divide

    rows = read(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    return divide(rows, rows.select("l_returnflag", "l_linestatus").distinct(), ["l_suppkey"])
