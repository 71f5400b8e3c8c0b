"""Aggregation, vote, metric and join queries."""

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import relational as R
from .registry import query
from .views import WITH


def _joined(v):
    return v.proofs.join(v.statements.select("statement_id", "uuid", "is_negation"), "statement_id")


JOINED = "joined AS (SELECT p.*, s.uuid, s.is_negation FROM proofs p JOIN statements s USING (statement_id))"


@query(WITH + "SELECT statement_id, n_proofs, n_correct_proofs, one_formal_proof, samples FROM agg_statements")
def agg01_proofs_to_statement(v):
    return A.proofs_to_statements(v.proofs).withColumn("samples", F.array_join("correct_proof_samples", ",")).drop("correct_proof_samples")


@query(
    WITH
    + """, runs AS (SELECT statement_id, sample_id % 3 AS run, count(DISTINCT formal_proof) AS n, count(*) FILTER (WHERE is_valid) AS k,
 string_agg(formal_proof, ',' ORDER BY sample_id, formal_proof) FILTER (WHERE is_valid) AS s FROM proofs GROUP BY ALL)
SELECT statement_id, sum(n)::BIGINT AS n_proofs, sum(k)::BIGINT AS n_correct_proofs, coalesce(string_agg(s, ',' ORDER BY run), '') AS samples FROM runs GROUP BY ALL"""
)
def agg02_repeat_merge(v):
    p = v.proofs.withColumn("run", F.col("sample_id") % 3)
    parts = [A.proofs_to_statements(p.where(F.col("run") == r)).withColumn("run", F.lit(r)) for r in range(3)]
    merged = A.merge_repeats(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return merged.select("statement_id", "n_proofs", "n_correct_proofs", F.array_join("correct_proof_samples", ",").alias("samples"))


PROBLEM = """agg_problems AS (SELECT s.uuid, count(*) AS n_statements, coalesce(sum(a.n_proofs) FILTER (WHERE NOT is_negation), 0)::BIGINT AS n_proofs,
 coalesce(sum(a.n_correct_proofs) FILTER (WHERE NOT is_negation), 0)::BIGINT AS n_correct_proofs,
 coalesce(first(a.one_formal_proof ORDER BY s.statement_id) FILTER (WHERE NOT is_negation AND a.one_formal_proof != ''), '') AS one_formal_proof
 FROM statements s JOIN agg_statements a USING (statement_id) GROUP BY s.uuid)"""


@query(WITH + f", {PROBLEM} SELECT * FROM agg_problems")
def agg03_statements_to_problem(v):
    return A.statements_to_problems(v.statements.join(A.proofs_to_statements(v.proofs), "statement_id"))


@query(WITH + "SELECT s.uuid, s.formal_statement, sum(n_proofs)::BIGINT AS n_proofs, sum(n_correct_proofs)::BIGINT AS n_correct_proofs, count(*) AS n_statements, bool_or(is_negation) AS is_negation FROM statements s JOIN agg_statements USING (statement_id) GROUP BY ALL")
def map01_statement_info(v):
    return A.statement_info(v.statements.join(A.proofs_to_statements(v.proofs), "statement_id"))


@query(
    WITH
    + f""", {PROBLEM} SELECT p.uuid, p.problem, p.source, n.n_name AS nation_name, r.r_name AS region_name, a.n_statements, a.n_proofs, a.n_correct_proofs, a.one_formal_proof, a.n_correct_proofs > 0 AS solved
 FROM problems p JOIN agg_problems a USING (uuid) JOIN nation n ON n.n_nationkey = p.nation JOIN region r ON r.r_regionkey = n.n_regionkey"""
)
def agg04_flagship(v):
    places = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("nation_name"), F.col("r_name").alias("region_name"))
    return A.aggregate_corpus(v.problems, v.statements, v.proofs).join(places, "nation").drop("nation")


@query(WITH + f", {PROBLEM} SELECT round(avg((n_correct_proofs > 0)::INT::DOUBLE), 6) AS solved_fraction FROM agg_problems")
def agg05_solved_fraction(v):
    return A.statements_to_problems(v.statements.join(A.proofs_to_statements(v.proofs), "statement_id")).agg(A.share(F.col("n_correct_proofs") > 0).alias("solved_fraction"))


@query(
    WITH
    + f""", {JOINED}, st AS (SELECT uuid, statement_id, is_negation, count(*) n, count(*) FILTER (WHERE is_valid) k FROM joined GROUP BY ALL),
 pr AS (SELECT uuid, sum(CASE WHEN NOT is_negation THEN k ELSE 0 END) own FROM st GROUP BY uuid)
SELECT (SELECT round(sum(k) / sum(n), 6) FROM st) AS valid_rate, (SELECT round(avg((own > 0)::INT::DOUBLE), 6) FROM pr) AS prove_rate,
 (SELECT round(sum(k) / count(*), 6) FROM st WHERE is_negation) AS negative_ratio_of_sums, (SELECT round(avg((k > 0)::INT::DOUBLE), 6) FROM st WHERE is_negation) AS negative_share_solved"""
)
def agg06_rates(v):
    return A.rates(_joined(v))


def _metrics_sql(by: str) -> str:
    cats = {"uuid": ("uuid", "NOT is_negation AND is_valid", "true"), "statement": ("statement_id", "NOT is_negation AND is_valid", "NOT is_negation"), "neg_statement": ("statement_id", "is_negation AND is_valid", "is_negation")}
    parts = [f"SELECT '{c}' AS category, {by} AS sh, count(DISTINCT {k}) FILTER (WHERE {ok}) AS valid, count(DISTINCT {k}) FILTER (WHERE {all_}) AS total FROM joined GROUP BY sh" for c, (k, ok, all_) in cats.items()]
    parts.append(f"SELECT 'proof', {by} AS sh, count(*) FILTER (WHERE is_valid), count(*) FROM joined GROUP BY sh")
    return WITH + f", {JOINED}, m AS ({' UNION ALL '.join(parts)}) SELECT category, sum(valid)::BIGINT AS valid, sum(total)::BIGINT AS total, round(sum(valid) / sum(total), 6) AS valid_ratio FROM m GROUP BY category"


@query(_metrics_sql("sample_id % 3"))
def agg07_shard_metrics(v):
    return A.shard_metrics(_joined(v), F.col("sample_id") % 3)


@query(_metrics_sql("1"))
def agg08_global_metrics(v):
    return A.global_metrics(_joined(v))


@query(WITH + "SELECT statement_id, count(*) AS proof_count FROM proofs WHERE is_valid GROUP BY statement_id")
def agg09_proof_record(v):
    return A.proof_records(v.proofs)


@query(
    WITH
    + """, g AS (SELECT s.uuid, (coalesce(a.n_correct_proofs, 0) > 0) AS ok FROM statements s LEFT JOIN agg_statements a USING (statement_id)),
 m AS (SELECT uuid, max(ok) OVER (PARTITION BY uuid) AS best FROM g)
SELECT round(avg(best::INT::DOUBLE), 6) AS row_rate, (SELECT round(avg(b::INT::DOUBLE), 6) FROM (SELECT max(best) b FROM m GROUP BY uuid)) AS uuid_rate FROM m"""
)
def agg10_pass_at_8(v):
    g = v.statements.join(A.proofs_to_statements(v.proofs), "statement_id", "left").select("uuid", (F.coalesce("n_correct_proofs", F.lit(0)) > 0).alias("ok"))
    by = g.groupBy("uuid").agg(F.max("ok").alias("best"), F.count("*").alias("n"))
    return by.agg(F.round(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("row_rate"), F.round(F.avg(F.col("best").cast("double")), 6).alias("uuid_rate"))


@query(WITH + "SELECT statement_id, uuid, max(is_negation) OVER (PARTITION BY uuid) AS any_negation FROM statements")
def win01_group_max(v):
    return A.group_max(v.statements.select("statement_id", "uuid", "is_negation"), "uuid", "is_negation", "any_negation").drop("is_negation")


@query(WITH + "SELECT source, count(DISTINCT uuid) AS n FROM problems GROUP BY source")
def agg11_nunique(v):
    return v.problems.groupBy("source").agg(F.count_distinct("uuid").alias("n"))


@query("SELECT (o_orderstatus = 'F') AS is_negation, (o_totalprice > 200000) AS is_valid, count(*) AS n FROM orders GROUP BY ALL")
def agg12_crosstab(v):
    return v.orders.groupBy((F.col("o_orderstatus") == "F").alias("is_negation"), (F.col("o_totalprice") > 200000).alias("is_valid")).agg(F.count("*").alias("n"))


@query(
    """SELECT c_mktsegment AS source, coalesce(sum(1) FILTER (WHERE o_orderstatus != 'F'), 0)::BIGINT AS false_n, coalesce(sum(1) FILTER (WHERE o_orderstatus = 'F'), 0)::BIGINT AS true_n,
 coalesce(sum(o_orderkey) FILTER (WHERE o_orderstatus != 'F'), 0)::BIGINT AS false_k, coalesce(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 0)::BIGINT AS true_k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
)
def agg13_unstack(v):
    df = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("source"), (F.col("o_orderstatus") == "F").alias("neg"), F.lit(1).cast("long").alias("n"), F.col("o_orderkey").alias("k"))
    return A.unstack_sums(df, "source", "neg", ["n", "k"])


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS ratio FROM orders GROUP BY 1")
def agg14_value_ratio(v):
    return A.shares(v.orders, "o_orderpriority")


@query("SELECT list_extract(string_split(p_type, ' '), -1) AS last_tag, count(*) FILTER (WHERE p_size <= 25) AS pos, count(*) FILTER (WHERE p_size > 25) AS neg FROM part GROUP BY 1")
def agg15_tag_breakdown(v):
    return v.part.groupBy(F.element_at(F.split("p_type", " "), -1).alias("last_tag")).agg(F.count_if(F.col("p_size") <= 25).alias("pos"), F.count_if(F.col("p_size") > 25).alias("neg"))


@query(WITH + f", {PROBLEM}, solved AS (SELECT uuid FROM agg_problems WHERE n_correct_proofs > 20) SELECT p.uuid, p.source FROM problems p WHERE NOT EXISTS (SELECT 1 FROM solved s WHERE s.uuid = p.uuid)")
def agg16_over_solved(v):
    solved = A.statements_to_problems(v.statements.join(A.proofs_to_statements(v.proofs), "statement_id")).where("n_correct_proofs > 20")
    return J.anti(v.problems.select("uuid", "source"), solved, "uuid")


VOTES = """c AS (SELECT conv_id, role, count(*) n, min(turn) f FROM conversations GROUP BY ALL), t AS (SELECT conv_id, sum(n) total, max(n) best FROM c GROUP BY 1)"""


@query(f"WITH {VOTES} SELECT t.conv_id, CASE WHEN 2 * best > total THEN (SELECT first(role) FROM c WHERE c.conv_id = t.conv_id AND c.n = t.best) ELSE 'Inconclusive' END AS status FROM t")
def agg17_strict_majority(v):
    return A.strict_majority(v.conversations, "conv_id", "role")


@query("WITH c AS (SELECT conv_id, role, count(*) n, min(turn) f FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) k FROM c) SELECT conv_id, role AS status, n AS votes FROM r WHERE k = 1")
def agg18_plurality(v):
    return A.plurality(v.conversations, "conv_id", "role", "turn")


@query(
    """WITH x AS (SELECT quality = 1 AS t, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE t AND p) tp, count(*) FILTER (WHERE NOT t AND NOT p) tn, count(*) FILTER (WHERE NOT t AND p) fp, count(*) FILTER (WHERE t AND NOT p) fn, count(*) n FROM x)
SELECT tp, tn, fp, fn, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, 1.0::DOUBLE AS conclusive FROM c"""
)
def agg19_confusion(v):
    return A.classification_metrics(v.labels.join(v.documents, "doc_id"), F.col("quality") == 1, F.col("n_chars") > 1000)


@query(WITH + ", f AS (SELECT statement_id, min(sample_id) FILTER (WHERE is_valid) AS first FROM proofs GROUP BY 1) SELECT k::INTEGER AS k, count(*) AS items, count(*) FILTER (WHERE first <= k) AS passed, round(count(*) FILTER (WHERE first <= k) / count(*), 6) AS pass_rate FROM f, range(1, 8) r(k) GROUP BY k")
def agg20_pass_at_n(v):
    return A.pass_at_n(v.proofs, 7)


@query(WITH + "SELECT statement_id, sample_id, formal_proof, is_valid, max(is_valid) OVER (PARTITION BY statement_id ORDER BY sample_id, formal_proof, is_valid ROWS UNBOUNDED PRECEDING) AS passed FROM proofs")
def win05_running_or(v):
    return R.running_or(v.proofs, "statement_id", ["sample_id", "formal_proof", "is_valid"], "is_valid", "passed")


RANKING = ("purchase", "error", "click", "view", "signup")


@query(
    """WITH r(rank, status) AS (VALUES (0, 'purchase'), (1, 'error'), (2, 'click'), (3, 'view'), (4, 'signup')), b AS (SELECT user_id, min(coalesce(r.rank, 4)) k FROM events LEFT JOIN r ON r.status = event_type GROUP BY 1)
SELECT r.status, count(b.k) AS n FROM r LEFT JOIN b ON b.k = r.rank GROUP BY 1"""
)
def agg21_status_rollup(v):
    return A.status_rollup(v.events, "user_id", F.col("event_type"), RANKING)


@query(WITH + "SELECT round(avg(is_valid::INT::DOUBLE), 6) AS valid_rate, count(DISTINCT statement_id) FILTER (WHERE is_valid) AS solved, count(DISTINCT statement_id) AS total FROM proofs")
def agg22_verification_rates(v):
    return v.proofs.agg(A.share(F.col("is_valid")).alias("valid_rate"), F.count_distinct(F.when(F.col("is_valid"), F.col("statement_id"))).alias("solved"), F.count_distinct("statement_id").alias("total"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def agg23_distinct_counts(v):
    return v.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("SELECT l_returnflag, round(sum(l_quantity) / count(*), 4) AS ratio, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1")
def agg24_ratio_of_sums(v):
    return v.lineitem.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity") / F.count("*"), 4).alias("ratio"), F.sum("l_linenumber").alias("total"))


@query(
    """WITH s AS (SELECT event_type, count(*) AS finished, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS elapsed FROM events GROUP BY 1), m AS (SELECT max(finished) AS target FROM s)
SELECT event_type, finished, elapsed, round(elapsed / finished * (target - finished), 4) AS eta_seconds FROM s, m"""
)
def agg25_eta(v):
    s = v.events.groupBy("event_type").agg(F.count("*").alias("finished"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("elapsed"))
    return s.join(F.broadcast(s.agg(F.max("finished").alias("target")))).select("event_type", "finished", "elapsed", F.round(F.col("elapsed") / F.col("finished") * (F.col("target") - F.col("finished")), 4).alias("eta_seconds"))


@query(WITH + "SELECT s.statement_id, s.uuid, a.n_proofs, a.n_correct_proofs FROM statements s JOIN agg_statements a USING (statement_id)")
def jn01_inner(v):
    return v.statements.select("statement_id", "uuid").join(A.proofs_to_statements(v.proofs).select("statement_id", "n_proofs", "n_correct_proofs"), "statement_id")


@query("SELECT o.o_orderkey AS id, o.o_custkey AS uuid, x.uuid AS uuid_verified, x.n FROM orders o LEFT JOIN (SELECT l_orderkey AS id, min(l_suppkey) AS uuid, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x ON x.id = o.o_orderkey")
def jn02_left_suffix(v):
    left = v.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("uuid"))
    right = v.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("uuid"), F.count("*").alias("n"))
    return J.left_with_suffix(left, right, "id")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'neg_' ELSE '' END || o_orderkey AS statement_id, c.c_name AS name FROM orders LEFT JOIN customer c ON c.c_custkey = o_orderkey")
def jn03_derived_key(v):
    left = v.orders.select(F.concat(F.when(F.col("o_orderstatus") == "F", "neg_").otherwise(""), F.col("o_orderkey").cast("string")).alias("statement_id"))
    info = v.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return J.left_on_derived(left, info, "id", J.strip_prefix(F.col("statement_id")))


@query(WITH + "SELECT a.statement_id, (a.formal_statement < '3') AS pos_flag, coalesce(b.formal_statement < '3', false) AS neg_flag FROM statements a LEFT JOIN statements b ON b.is_negation AND xor(b.statement_id, 1) = a.statement_id WHERE NOT a.is_negation")
def jn04_polarity_self_join(v):
    s = v.statements.withColumn("flag", F.col("formal_statement") < "3")
    return J.positive_with_negation(s, "statement_id", F.col("statement_id").bitwiseXOR(F.lit(1)), "flag")


@query(
    """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) i FROM orders), b AS (SELECT o_custkey, o_orderkey AS by_price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) i FROM orders)
SELECT o_custkey, o_orderkey, by_price FROM a JOIN b USING (o_custkey, i)"""
)
def jn05_positional(v):
    o = v.orders
    return J.positional(o.select("o_custkey", "o_orderkey"), o.select("o_custkey", F.col("o_orderkey").alias("by_price"), "o_totalprice"), ["o_orderkey"], ["o_totalprice", "by_price"], ["o_custkey"]).drop("o_totalprice")


@query("WITH r AS (SELECT text, max(doc_id) AS last_id FROM documents GROUP BY text) SELECT d.doc_id, r.last_id FROM documents d JOIN r USING (text)")
def jn06_lookup_last(v):
    d = v.documents
    return J.lookup_last(d.select("doc_id", "text"), d.select("text", F.col("doc_id").alias("last_id")), "text", "last_id").drop("text")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) , '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1")
def jn07_nest(v):
    right = v.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    out = J.nest(v.customer.select("c_custkey"), right, "c_custkey", ["o_orderkey"], "a")
    return out.select("c_custkey", F.size("a").cast("long").alias("n"), F.array_join(F.transform("a", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def jn08_anti(v):
    return J.anti(v.orders.select("o_orderkey"), v.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(WITH + ", s AS (SELECT statement_id, coalesce(n_correct_proofs, 0) > 0 AS solved FROM statements LEFT JOIN agg_statements USING (statement_id)) SELECT statement_id FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.solved AND xor(t.statement_id, 1) = s.statement_id)")
def jn09_polarity_anti(v):
    s = v.statements.join(A.proofs_to_statements(v.proofs), "statement_id", "left").select("statement_id", (F.coalesce("n_correct_proofs", F.lit(0)) > 0).alias("solved"))
    return J.drop_contradicted(s, "statement_id", F.col("statement_id").bitwiseXOR(F.lit(1)), F.col("solved")).select("statement_id")


@query(WITH + ", r AS (SELECT statement_id, count(*) AS n FROM proofs WHERE is_valid GROUP BY 1) SELECT s.statement_id FROM statements s LEFT JOIN r a ON a.statement_id = s.statement_id LEFT JOIN r b ON b.statement_id = xor(s.statement_id, 1) WHERE coalesce(a.n, 0) <= 2 AND coalesce(b.n, 0) = 0")
def jn10_filter_by_record(v):
    return J.within_record(v.statements.select("statement_id"), A.proof_records(v.proofs), "statement_id", F.col("statement_id").bitwiseXOR(F.lit(1)), 2)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def jn11_semi(v):
    return J.semi(v.customer.select("c_custkey", "c_name"), v.orders.where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def jn12_contains_join(v):
    return J.contains_join(v.documents.select("doc_id", "text"), v.benchmark.select("item_id", F.col("text").alias("passage")), "text", "passage").select("doc_id", "item_id")


@query("SELECT doc_id, min(item_id) AS item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1")
def jn13_first_contains(v):
    pairs = J.contains_join(v.documents.select("doc_id", "text"), v.benchmark.select("item_id", F.col("text").alias("passage")), "text", "passage")
    return J.first_match(pairs.select("doc_id", "item_id"), "doc_id", ["item_id"])


@query("SELECT a.vec_id, round(max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS max_cosine FROM embeddings a, embeddings b WHERE a.vec_id % 10 != 0 AND b.vec_id % 10 = 0 GROUP BY 1")
def jn14_max_cosine(v):
    e = v.embeddings
    return J.max_similarity(e.where("vec_id % 10 != 0").select("vec_id", "embedding"), e.where("vec_id % 10 = 0")).select("vec_id", F.round("max_cosine", 4).alias("max_cosine"))


@query("SELECT a.o_custkey, a.o_orderkey AS o_orderkey_a, b.o_orderkey AS o_orderkey_b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
def jn15_pairs(v):
    return J.pairs_within(v.orders, "o_custkey", "o_orderkey", ["o_orderkey"])


@query(
    """WITH r AS (SELECT user_id, min(event_id) AS s, min(event_id) + 500 AS e FROM events WHERE event_type = 'click' GROUP BY 1) SELECT event_id, user_id FROM events JOIN r USING (user_id) WHERE event_id BETWEEN s AND e"""
)
def jn16_range_join(v):
    r = v.events.where("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("s"), (F.min("event_id") + 500).alias("e"))
    return J.range_join(v.events.select("event_id", "user_id"), r, ["user_id"], "event_id", "s", "e", bin_size=500).select("event_id", "user_id")


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS request FROM orders")
def jn17_reorder(v):
    from pyspark.sql import Window as W

    requests = v.orders.select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("request"))
    answers = v.orders.select("o_orderkey", "o_custkey")
    return requests.join(answers, "o_orderkey")
