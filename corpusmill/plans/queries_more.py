"""Filter, projection, set, sampling, window, array, JSON, text, tree, source and monitoring queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import feedback as FB
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import joins as J
from ..operators import relational as R
from ..operators import sets as S
from ..operators import trees as TR
from ..operators.stored import scratch
from ..sources import tables as SRC
from .registry import query
from .views import WITH

# -- filters ---------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_custkey < 500")
def flt01_threshold(v):
    return v.orders.where("o_totalprice > 100000 and o_custkey < 500").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_type LIKE 'STANDARD%' OR NOT (p_brand = 'Brand#11' OR p_size < 10 OR p_retailprice > 1500)")
def flt02_valid_problem(v):
    kind = F.when(F.col("p_type").startswith("STANDARD"), "proof").otherwise("word")
    return v.part.where(R.valid_problem(kind, F.when(F.col("p_brand") == "Brand#11", "notfound"), F.when(F.col("p_size") < 10, "Incomplete"), F.when(F.col("p_retailprice") > 1500, "Invalid"))).select("p_partkey")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def flt03_flags(v):
    return v.labels.where("quality = 1 and toxic = 0").select("doc_id")


@query("SELECT count(*) FILTER (WHERE o_orderpriority LIKE '1-%') AS yes, count(*) FILTER (WHERE o_orderpriority NOT LIKE '1-%') AS no FROM orders")
def flt04_prefix(v):
    p = F.col("o_orderpriority").startswith("1-")
    return v.orders.agg(F.count_if(p).alias("yes"), F.count_if(~p).alias("no"))


@query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, 'the')) = 1")
def flt05_one_occurrence(v):
    return v.documents.where(R.occurrences(F.col("text"), "the")).select("doc_id")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(contains(o_orderpriority, 'URGENT')) OR bool_or(o_orderstatus = 'F')")
def flt06_any_in_array(v):
    g = v.orders.groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"), F.bool_or(F.col("o_orderstatus") == "F").alias("neg"))
    return g.where(F.exists("p", lambda x: x.contains("URGENT")) | F.col("neg")).select("o_custkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'SMALL') OR list_has_any(string_split(p_type, ' '), ['PROMO', 'TIN'])")
def flt07_tags(v):
    tags = F.split("p_type", " ")
    return v.part.where(F.array_contains(tags, "SMALL") | F.arrays_overlap(tags, F.array(F.lit("PROMO"), F.lit("TIN")))).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 3 AND 3000")
def flt08_chars(v):
    return v.documents.where(R.char_length(F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) BETWEEN 2 AND 150")
def flt09_lines(v):
    return v.documents.where(R.line_count(F.col("text"))).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\S+')) BETWEEN 3 AND 200")
def flt10_tokens(v):
    return v.documents.where(R.token_count(F.col("text"), 3, 200)).select("doc_id")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def flt11_array_size(v):
    return v.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s")).where(F.size("s") == 1).select("o_custkey")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text != '' AND lang IS NOT NULL AND lang != '' AND contains(text, 'the')")
def flt12_non_empty(v):
    return v.documents.where((F.coalesce("text", F.lit("")) != "") & (F.coalesce("lang", F.lit("")) != "") & F.col("text").contains("the")).select("doc_id")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^\s*Is\b') THEN 3 WHEN regexp_matches(text, '\bLicensed\b') THEN 4 END AS version FROM documents WHERE NOT regexp_matches(text, '(?m)^\s*Is\b')")
def flt13_version(v):
    version = F.when(F.col("text").rlike(r"(?m)^\s*Is\b"), 3).when(F.col("text").rlike(r"\bLicensed\b"), 4)
    d = v.documents.select("doc_id", version.alias("version"))
    return d.where((F.col("version") == 4) | F.col("version").isNull())


@query("SELECT doc_id FROM documents WHERE length(text) BETWEEN 100 AND 2000 AND len(string_split(text, chr(10))) BETWEEN 2 AND 20 AND NOT contains(text, '|')")
def flt14_filter_chain(v):
    return R.filter_chain(v.documents, "text", [("char_length", {"low": 100, "high": 2000}), ("line_count", {"low": 2, "high": 20}), ("without_word", {"word": "|"})]).select("doc_id")


@query(WITH + "SELECT event_id FROM lean_feedback WHERE NOT contains(feedback, '\"severity\":\"error\"')")
def flt15_error_text(v):
    return v.lean_feedback.where(R.without_word(F.col("feedback"), '"severity":"error"')).select("event_id")


# -- limits ------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def lim01_first_n(v):
    return R.first_n(v.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 10")
def lim02_slice(v):
    return R.first_n(v.orders, ["o_totalprice", "o_orderkey"], 50, 10).select("o_orderkey")


@query(
    r"""WITH c AS (SELECT source, doc_id, regexp_replace(regexp_replace(text, '(?s)/-.*?(?:-/|--/)', '', 'g'), '--[^\n]*', '', 'g') AS t FROM documents)
SELECT source, first(md5(t) ORDER BY length(t), doc_id) AS shortest, min(length(t))::INTEGER AS n FROM c GROUP BY 1"""
)
def lim03_shortest(v):
    by = v.documents.groupBy("source").agg(F.min(F.struct(F.length(T.remove_comments(F.col("text"))).alias("n"), "doc_id", T.remove_comments(F.col("text")).alias("t"))).alias("x"))
    return by.select("source", F.md5("x.t").alias("shortest"), F.col("x.n").alias("n"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) r FROM documents) WHERE r <= 3")
def lim04_first_n_per_group(v):
    return R.first_n_each(v.documents.select("source", "doc_id"), "source", ["doc_id"], 3)


@query("SELECT conv_id, turn, valid FROM (SELECT conv_id, turn, role = 'assistant' AS valid, row_number() OVER (PARTITION BY conv_id ORDER BY (role != 'assistant'), CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END, turn) r FROM conversations) WHERE r = 1")
def lim05_best_attempt(v):
    return R.best_attempt(v.conversations.withColumn("valid", F.col("role") == "assistant"), "conv_id", "valid", "text", "turn")


@query("SELECT o_orderkey FROM orders ORDER BY sha256(o_orderkey::VARCHAR || 'pick') LIMIT 1")
def lim07_random_row(v):
    return R.top_by_hash(v.orders, "o_orderkey", "pick").select("o_orderkey")


# -- sets ----------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, 'orders' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def set01_union_all(v):
    return S.union_all(v.orders.select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("kind")), v.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")))


@query("SELECT c_custkey, k::INTEGER AS copy FROM customer, range(3) r(k)")
def set02_copies(v):
    return S.copies(v.customer.select("c_custkey"), 3)


@query("SELECT p_partkey::VARCHAR AS id, p_size FROM part UNION ALL SELECT 'neg_' || p_partkey, -p_size FROM part")
def set03_with_transformed(v):
    p = v.part.select(F.col("p_partkey").cast("string").alias("id"), "p_size")
    return S.union_all(p, p.select(F.concat(F.lit("neg_"), "id").alias("id"), (-F.col("p_size")).alias("p_size")))


@query("SELECT count(*) AS violations FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def set04_subset(v):
    return J.missing_keys(v.orders.select(F.col("o_custkey").alias("k")).distinct(), v.customer.select(F.col("c_custkey").alias("k")), "k").agg(F.count("*").alias("violations"))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def set05_distinct_array(v):
    g = v.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return g.select("l_orderkey", F.size("f").cast("long").alias("n"), F.array_join("f", ",").alias("flags"))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def set06_keep_first(v):
    return S.keep_first(v.documents.select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query()
def set07_minhash_near_dedup(v):
    return S.near_dedup(v.documents.select("doc_id", "text"), "doc_id", "text")


@query("SELECT l_orderkey, l_partkey, max(l_quantity) AS best FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL")
def set08_distinct_candidates(v):
    return v.lineitem.where("l_discount > 0.02").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("best"))


@query("SELECT o_custkey::VARCHAR AS parent, o_orderpriority AS goals, o_orderstatus = 'F' AS is_valid, max(o_totalprice) AS logprob, count(*) AS merged FROM orders GROUP BY ALL")
def set09_merge_children(v):
    c = v.orders.select(F.col("o_custkey").cast("string").alias("parent"), F.col("o_orderpriority").alias("goals"), (F.col("o_orderstatus") == "F").alias("is_valid"), F.col("o_totalprice").alias("logprob"))
    return TR.merge_children(c)


# -- sampling ----------------------------------------------------------------------------

UNIT = "(('0x' || substr(sha256({}), 1, 13))::BIGINT / 4503599627370496.0)"


@query(
    WITH
    + f""", s AS (SELECT statement_id, is_negation, least(1.0, n_correct_proofs / n_proofs) AS rate FROM statements JOIN agg_statements USING (statement_id))
SELECT statement_id FROM s WHERE (1 - 0.8 * is_negation::INT) * pow(1 - 0.95 * rate, 2.0) > {UNIT.format("statement_id::VARCHAR")}"""
)
def smp01_weighted_keep(v):
    s = v.statements.join(A.proofs_to_statements(v.proofs), "statement_id")
    return S.weighted_keep(s, "statement_id", F.col("is_negation"), F.col("n_correct_proofs") / F.col("n_proofs"), 2.0).select("statement_id")


@query(f"SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'eval_building' WHEN {UNIT.format('c_custkey::VARCHAR')} < 0.1 THEN 'validation' ELSE 'train' END AS split FROM customer")
def smp02_hash_split(v):
    return S.hash_split(v.customer, "c_custkey", 0.1, {"BUILDING": "eval_building"}, "c_mktsegment").select("c_custkey", "split")


@query("SELECT o_orderkey FROM orders ORDER BY sha256(o_orderkey::VARCHAR || '42'), o_orderkey LIMIT 200")
def smp03_hash_sample(v):
    return S.hash_sample(v.orders, "o_orderkey", 200, "42").select("o_orderkey")


@query()
def smp04_with_replacement(v):
    return S.sample_with_replacement(v.customer.select("c_custkey"), 0.5, 37)


@query(
    """SELECT * FROM (SELECT c_custkey AS id, k::INTEGER AS copy, 'customer' AS part FROM customer, range(2) r(k))
UNION ALL SELECT * FROM (SELECT p_partkey, 0, 'part' FROM part ORDER BY sha256(p_partkey::VARCHAR || '142'), p_partkey LIMIT (SELECT floor(count(*) * 0.25)::BIGINT FROM part))"""
)
def smp05_mixture(v):
    return S.mixture({"customer": (v.customer.select(F.col("c_custkey").alias("id")), 2), "part": (v.part.select(F.col("p_partkey").alias("id")), 0.25)}, "id")


@query("SELECT o_orderkey, lpad(((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::VARCHAR, 5, '0') AS shard_id FROM orders")
def smp06_shard(v):
    return S.row_shards(v.orders.select("o_orderkey"), [F.col("o_orderkey")], 1000)


@query("WITH k AS (SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) // 100 AS shard FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, shard FROM orders JOIN k USING (o_custkey)")
def smp07_key_shard(v):
    return S.key_shards(v.orders.select("o_orderkey", "o_custkey"), "o_custkey", 100).select("o_orderkey", "shard")


@query("WITH r AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders) SELECT o_custkey, batch::BIGINT AS batch, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM r GROUP BY ALL")
def smp08_batches(v):
    r = v.orders.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) / 4))
    return r.groupBy("o_custkey", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT o_orderkey, ['a', 'b', 'c'][(('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 3 + 1)] AS model FROM orders")
def smp09_routing(v):
    return v.orders.select("o_orderkey", S.route(F.col("o_orderkey"), ["a", "b", "c"]).alias("model"))


# -- projection ------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_custkey AS uuid FROM orders")
def prj01_prune_rename(v):
    return v.orders.select("o_orderkey", "o_custkey").withColumnsRenamed({"o_orderkey": "id", "o_custkey": "uuid"})


@query("SELECT c_custkey, 'corpus:' || c_mktsegment AS source FROM customer")
def prj02_source_tag(v):
    return v.customer.select("c_custkey", F.concat(F.lit("corpus:"), "c_mktsegment").alias("source"))


@query("SELECT p_partkey, 'import Mathlib' || chr(10) || p_name || p_type AS code FROM part")
def prj03_concat_columns(v):
    return v.part.select("p_partkey", F.concat(F.lit("import Mathlib\n"), "p_name", "p_type").alias("code"))


@query("SELECT p_partkey, 'Mathematical Problem in Natural Language:' || chr(10) || p_name || chr(10) || 'Use the following theorem names: ' || array_to_string(string_split(p_type, ' '), ', ') || '.' || chr(10) || 'Source: ' || p_brand AS prompt FROM part")
def prj04_user_prompt(v):
    return v.part.select("p_partkey", T.user_prompt(F.col("p_name"), F.split("p_type", " "), F.col("p_brand"), True, True).alias("prompt"))


@query("SELECT p_partkey, 'Part ' || p_name || ' {' || p_size || '}' AS text FROM part")
def prj05_template(v):
    return v.part.select("p_partkey", T.template("Part {name} {{{size}}}", name=F.col("p_name"), size=F.col("p_size")).alias("text"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS messages FROM conversations GROUP BY 1")
def prj06_messages(v):
    m = v.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m")))).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["m"]["role"], F.length(x["m"]["content"]).cast("string"))), "|").alias("messages"))


@query("SELECT p_partkey, 'You prove.' AS system, p_name AS instruction, p_type AS output, '' AS input FROM part")
def prj07_alpaca(v):
    return v.part.select("p_partkey", F.lit("You prove.").alias("system"), F.col("p_name").alias("instruction"), F.col("p_type").alias("output"), F.lit("").alias("input"))


@query("SELECT o_custkey || '_' || lpad((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::VARCHAR, 2, '0') AS id FROM orders")
def prj08_row_ids(v):
    i = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return v.orders.select(F.concat(F.col("o_custkey").cast("string"), F.lit("_"), F.lpad(i.cast("string"), 2, "0")).alias("id"))


WIDE = "SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS sample_1, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS sample_2, max(CASE WHEN l_linenumber = 3 THEN l_partkey END) AS sample_3 FROM lineitem GROUP BY 1"


def _wide(v):
    return R.wide_samples(v.lineitem, ["l_orderkey"], "l_linenumber", 3, F.max("l_partkey"), "sample_")


@query(f"WITH w AS ({WIDE}) SELECT l_orderkey, 1 AS sample_id, sample_1 AS part FROM w UNION ALL SELECT l_orderkey, 2, sample_2 FROM w UNION ALL SELECT l_orderkey, 3, sample_3 FROM w")
def prj09_wide_to_long(v):
    return R.long_samples(_wide(v), ["l_orderkey"], "sample_", "part")


@query(WIDE)
def prj10_long_to_wide(v):
    return _wide(v)


@query("SELECT c_custkey, coalesce(o_orderpriority, '') AS priority FROM customer LEFT JOIN orders ON o_orderkey = c_custkey")
def prj11_fill(v):
    return v.customer.join(v.orders, F.col("o_orderkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN upper(lang) ELSE '' END AS answer FROM documents")
def prj12_scatter_back(v):
    d = v.documents.select("doc_id")
    return R.scatter_back(d, v.documents.where("lang = 'fr'").select("doc_id", F.upper("lang").alias("answer")), "doc_id", {"answer": ""})


# -- windows ----------------------------------------------------------------------------------


@query(
    """WITH i AS (SELECT user_id, event_id, event_id AS s, event_id + 40 AS e FROM events), l AS (SELECT user_id, event_id, s, least(e, coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id), e)) AS e FROM i)
SELECT user_id, event_id, s, e FROM l WHERE s < e"""
)
def win02_disjoint(v):
    i = v.events.select("user_id", "event_id", F.col("event_id").alias("s"), (F.col("event_id") + 40).alias("e"))
    return R.disjoint_intervals(i, "user_id", ["s", "event_id"], "s", "e")


@query(
    """WITH t AS (SELECT conv_id, turn, role || repeat(' ', (turn % 3)::INT) AS x FROM conversations)
SELECT conv_id, turn, coalesce(lag(regexp_extract(x, '[ \t]*$')) OVER (PARTITION BY conv_id ORDER BY turn, x), '') || rtrim(x) AS x FROM t"""
)
def win03_shift_space(v):
    t = v.conversations.select("conv_id", "turn", F.concat("role", F.expr("repeat(' ', cast(turn % 3 as int))")).alias("x"))
    return R.shift_trailing_space(t, "conv_id", ["turn", "x"], "x")


@query("WITH p AS (SELECT p_partkey, string_split(p_type, ' ') AS a FROM part) SELECT p_partkey, (j - 1)::INTEGER AS step, array_to_string(a[1:j-1], '') AS prefix, array_to_string(a[j:], '') AS suffix FROM p, range(1, 4) r(j) WHERE j <= len(a)")
def win06_prefixes(v):
    return R.prefixes(v.part.select("p_partkey", F.split("p_type", " ").alias("a")), "a").select("p_partkey", "step", "prefix", "suffix")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS line, (coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset_ FROM l"""
)
def win07_line_offsets(v):
    return v.documents.select("doc_id", F.posexplode(R.line_offsets(F.col("text"))).alias("line", "offset_"))


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def win08_keep_last(v):
    return R.keep_last(v.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


# -- arrays and JSON ------------------------------------------------------------------------------


@query("SELECT p_partkey || '_' || (i - 1) AS id, a[i] AS word FROM (SELECT p_partkey, string_split(p_type, ' ') AS a FROM part), range(1, 10) r(i) WHERE i <= len(a)")
def arr01_explode_ids(v):
    e = v.part.select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("i", "word"))
    return e.select(F.concat_ws("_", F.col("p_partkey").cast("string"), F.col("i").cast("string")).alias("id"), "word")


@query(WITH + "SELECT statement_id, formal_proof FROM proofs WHERE is_valid")
def arr02_explode_proofs(v):
    return A.proofs_to_statements(v.proofs).select("statement_id", F.explode("correct_proof_samples").alias("formal_proof"))


@query(WITH + "SELECT statement_id, unnest(CASE WHEN samples = '' THEN ['error'] ELSE string_split(samples, ',') END) AS completion FROM agg_statements")
def arr03_explode_with_errors(v):
    e = A.proofs_to_statements(v.proofs).select("statement_id", F.explode_outer("correct_proof_samples").alias("c"))
    return e.select("statement_id", F.coalesce("c", F.lit("error")).alias("completion"))


@query("SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS p FROM orders GROUP BY 1")
def arr04_field_of_structs(v):
    g = v.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    return g.select("o_custkey", F.array_join(F.transform("s", lambda x: x["o_orderpriority"]), ",").alias("p"))


@query("SELECT p_brand, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) FROM part) GROUP BY 1")
def arr05_flatten(v):
    return v.part.groupBy("p_brand").agg(F.size(F.flatten(F.collect_list(F.split("p_type", " ")))).cast("long").alias("n"))


@query(f"WITH w AS ({WIDE}) SELECT l_orderkey, x AS proof FROM (SELECT l_orderkey, unnest([sample_1, sample_2, sample_3]) AS x FROM w) WHERE x IS NOT NULL")
def arr06_unpivot(v):
    return R.long_samples(_wide(v), ["l_orderkey"], "sample_", "proof").where("proof is not null").select("l_orderkey", "proof")


@query("SELECT p_partkey, array_to_string(list_append(string_split(p_type, ' '), 'checked'), ',') AS tags FROM part")
def arr07_append_tag(v):
    return v.part.select("p_partkey", F.array_join(F.array_append(F.split("p_type", " "), F.lit("checked")), ",").alias("tags"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def grp01_collect(v):
    return v.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("ids"))


@query(
    WITH
    + """, c AS (SELECT event_id, CASE WHEN contains(feedback, 'not json') OR contains(feedback, 'timeout') THEN true ELSE contains(feedback, '"severity":"error"') END AS e, contains(feedback, 'uses ''sorry''') AS s FROM lean_feedback)
SELECT event_id, e AS has_error, NOT e AND NOT s AS is_valid_no_sorry, NOT e AS is_valid_with_sorry FROM c"""
)
def jsn01_reply_flags(v):
    return v.lean_feedback.select("event_id", FB.reply_flags(F.col("feedback")).alias("x")).select("event_id", "x.*")


@query(WITH + "SELECT event_id, coalesce(json_exists(CASE WHEN json_valid(feedback) THEN feedback ELSE '{}' END, '$.error'), false) AS literal_error FROM lean_feedback")
def jsn02_key_presence(v):
    return v.lean_feedback.select("event_id", FB.inner_has_error(F.col("feedback")).alias("literal_error"))


@query(WITH + "SELECT event_id, CASE WHEN contains(feedback, '\"severity\":\"error\"') THEN 'error' WHEN contains(feedback, '\"severity\":\"warning\"') THEN 'warning' ELSE '' END AS severities, 0 AS line FROM lean_feedback")
def jsn03_normal_messages(v):
    m = v.lean_feedback.select("event_id", FB.normal_messages(F.col("feedback")).alias("m"))
    return m.select("event_id", F.array_join(F.transform("m", lambda x: x["severity"]), ",").alias("severities"), F.coalesce(F.try_element_at(F.transform("m", lambda x: x["line"]), F.lit(1)), F.lit(0)).alias("line"))


@query("SELECT p_partkey, '{\"name\":\"' || p_name || '\",\"size\":' || p_size || ',\"none\":null}' AS doc FROM part")
def jsn04_to_json(v):
    return v.part.select("p_partkey", FB.as_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.lit(None).cast("string").alias("none"))).alias("doc"))


@query(WITH + "SELECT count(*) FILTER (WHERE json_valid(feedback)) AS readable, count(*) FILTER (WHERE NOT json_valid(feedback)) AS unreadable FROM lean_feedback")
def jsn05_invalid_json(v):
    return v.lean_feedback.agg(F.count_if(FB.readable(F.col("feedback"))).alias("readable"), F.count_if(~FB.readable(F.col("feedback"))).alias("unreadable"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def jsn06_props(v):
    return v.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# -- text ---------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace('/- a' || chr(10) || '-/' || text || ' -- end', '(?s)/-.*?(?:-/|--/)', '', 'g'), '--[^\n]*', '', 'g')) AS h FROM documents")
def str01_remove_comments(v):
    return v.documents.select("doc_id", F.md5(T.remove_comments(F.concat(F.lit("/- a\n-/"), "text", F.lit(" -- end")))).alias("h"))


@query("SELECT p_partkey, 'import Mathlib' || chr(10) || '/- ' || p_name || ' -/' || chr(10) || 'theorem x : ' || p_type AS t FROM part")
def str06_insert_informal(v):
    statement = F.concat(F.lit("import Mathlib\ntheorem x : "), "p_type")
    return v.part.select("p_partkey", T.insert_informal(statement, F.concat("p_name", F.lit(" The final answer is 3"))).alias("t"))


@query("SELECT doc_id, md5(string_split(text, 'the')[1] || chr(10)) AS h FROM documents")
def str07_remove_sorry(v):
    return v.documents.select("doc_id", F.md5(T.remove_sorry(F.regexp_replace("text", "the", "sorry"))).alias("h"))


@query("SELECT p_partkey, 'import A' || chr(10) || 'import B' AS header, p_name AS body FROM part")
def str13_split_header(v):
    h, b = T.split_header(F.concat(F.lit("import A\nimport B\n"), "p_name"))
    return v.part.select("p_partkey", h.alias("header"), b.alias("body"))


@query("SELECT doc_id, substr(string_split(text, chr(10))[1], 3, 5) AS part FROM documents")
def str15_snippet(v):
    return v.documents.select("doc_id", T.snippet(F.col("text"), F.lit(1), F.lit(2), F.lit(1), F.lit(7)).alias("part"))


@query("SELECT p_partkey, p_name || chr(10) AS first, p_name || chr(10) || chr(10) || p_type || chr(10) AS every FROM part")
def str16_fences(v):
    c = F.concat(F.lit("so\n```lean\n"), "p_name", F.lit("\n```\nand\n```\n"), "p_type", F.lit("\n```"))
    return v.part.select("p_partkey", T.first_fence(c).alias("first"), T.all_fences(c).alias("every"))


REPLY = "CASE WHEN p_size % 4 = 0 THEN 'Status: Correct' WHEN p_size % 4 = 1 THEN 'Status: Incorrect' || chr(10) || 'bye' WHEN p_size % 4 = 2 THEN 'the text is correct' ELSE 'unsure' END"


@query(f"SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Correct' WHEN p_size % 4 = 1 THEN 'Incorrect' ELSE 'Status not found' END AS status FROM part")
def str17_judge_lines(v):
    reply = F.expr(REPLY.replace("chr(10)", "'\\n'"))
    return v.part.select("p_partkey", T.judge_line_status(reply).alias("status"))


@query(f"SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Correct' WHEN p_size % 4 = 1 THEN 'Incorrect' WHEN p_size % 4 = 2 THEN 'Correct' ELSE 'Status not found' END AS status FROM part")
def str18_judge_boxed(v):
    reply = F.expr(REPLY.replace("chr(10)", "'\\n'"))
    return v.part.select("p_partkey", T.judge_boxed_status(reply).alias("status"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS verdict FROM part")
def str19_critic(v):
    c = F.when(F.col("p_size") % 3 == 0, F.lit('{"is_correct": true}')).when(F.col("p_size") % 3 == 1, F.lit("so is_correct: False.")).otherwise(F.lit("no idea"))
    return v.part.select("p_partkey", T.critic_verdict(c).alias("verdict"))


@query("SELECT doc_id, md5('  ' || replace(text, chr(10), chr(10) || '  ')) AS h FROM documents")
def str21_indent(v):
    return v.documents.select("doc_id", F.md5(T.indent(F.col("text"), "  ")).alias("h"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS id FROM orders")
def str22_strip_prefix(v):
    return v.orders.select("o_orderkey", J.strip_prefix(F.concat(F.lit("neg_"), F.col("o_orderkey").cast("string"))).alias("id"))


@query("SELECT doc_id, true AS same FROM documents")
def str25_round_trip(v):
    return v.documents.select("doc_id", T.round_trip(T.lines(F.col("text")), F.col("text"), "\n").alias("same"))


@query("SELECT p_partkey, p_name AS first FROM part")
def str27_unescape(v):
    return v.part.select("p_partkey", F.element_at(T.unescape_list(F.concat(F.lit('["'), "p_name", F.lit('", "\\u2200"]'))), 1).alias("first"))


@query("SELECT conv_id, bool_or(contains(text, 'the') OR contains(text, 'und')) AS hit FROM conversations GROUP BY 1")
def str28_any_step(v):
    g = v.conversations.groupBy("conv_id").agg(F.collect_list(F.regexp_replace(F.regexp_replace("text", "the", "sorry"), "und", "admit")).alias("s"))
    return g.select("conv_id", T.steps_have_sorry(F.col("s")).alias("hit"))


# -- trees --------------------------------------------------------------------------------------------

BELOW = """w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth, []::BIGINT[] AS path FROM region UNION ALL SELECT w.root, e.child, w.depth + 1, list_append(w.path, e.ord) FROM w JOIN tree_edges e ON e.parent = w.node)"""


@query(WITH + "SELECT child AS node FROM tree_edges WHERE child NOT IN (SELECT parent FROM tree_edges)")
def tre02_leaves(v):
    return TR.leaves(v.tree_edges)


@query("SELECT conv_id, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def tre04_snapshots(v):
    g = TR.group_snapshots(v.conversations, "conv_id", "turn", ["role"])
    return g.select("conv_id", F.size("steps").cast("long").alias("n"), F.array_join(F.transform("steps", lambda s: s["role"]), ">").alias("roles"))


def _roots(v):
    return v.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"))


@query(WITH + f", {BELOW} SELECT root, node, depth FROM w")
def tre06_levels(v):
    return TR.walk(v.tree_edges, _roots(v)).select("root", "node", "depth")


@query(WITH + f", {BELOW} SELECT root, node, array_to_string(path, '/') AS path FROM w")
def tre07_preorder(v):
    return TR.walk(v.tree_edges, _roots(v)).select("root", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


PROVED = "SELECT 'o' || o_orderkey AS node FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 97 = 0"
UP = f"u AS (SELECT node AS anc, 0 AS d FROM ({PROVED}) UNION ALL SELECT e.parent, u.d + 1 FROM u JOIN tree_edges e ON e.child = u.anc), dist AS (SELECT anc AS node, min(d) AS distance FROM u GROUP BY 1)"


def _distances(v):
    o = v.orders.where("o_totalprice > 400000").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    c = v.customer.where("c_custkey % 97 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return TR.distance_to_proof(v.tree_edges, o.unionByName(c))


@query(WITH + f", {UP} SELECT node, distance FROM dist")
def tre08_distance(v):
    return _distances(v)


@query(
    WITH
    + f""", {UP}, best AS (SELECT parent, first(child ORDER BY distance, ord) AS child, min(distance) AS distance FROM tree_edges JOIN dist ON node = child GROUP BY 1),
 s AS (SELECT 0 AS step, 'r1' AS node UNION ALL SELECT s.step + 1, b.child FROM s JOIN best b ON b.parent = s.node JOIN dist own ON own.node = s.node WHERE b.distance < own.distance) SELECT step, node FROM s"""
)
def tre09_shortest_path(v):
    return TR.shortest_path(v.tree_edges, _distances(v), "r1")


@query("SELECT r_name AS tree_id, n_nationkey::VARCHAR AS id, n_name AS content FROM nation JOIN region ON r_regionkey = n_regionkey")
def tre10_round_trip(v):
    j = v.nation.join(v.region, F.col("r_regionkey") == F.col("n_regionkey"))
    nodes = j.select(F.col("r_name").alias("tree_id"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("content"))
    edges = j.select(F.col("r_name").alias("tree_id"), F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("id"), F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return TR.deserialise(TR.serialise(nodes, edges), "struct<content:string>", "struct<src:string,dst:string>")[0]


@query(
    WITH
    + """, p AS (SELECT 'o' || o_orderkey AS node, 'o' || o_orderkey AS anc, 0 AS steps FROM orders UNION ALL SELECT p.node, e.parent, p.steps + 1 FROM p JOIN tree_edges e ON e.child = p.anc)
SELECT node, string_agg(anc, '/' ORDER BY steps DESC) AS path FROM p GROUP BY 1"""
)
def tre11_path_to_root(v):
    start = v.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    up = TR.up_to_root(v.tree_edges, start).groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("s"), "at"))).alias("p"))
    return up.select("node", F.array_join(F.transform("p", lambda x: x["at"]), "/").alias("path"))


@query("SELECT b.conv_id, b.turn, a.role AS parent_tactics FROM conversations b LEFT JOIN conversations a ON a.conv_id = b.conv_id AND a.turn = b.turn - 1")
def tre12_state_parents(v):
    s = v.conversations.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat_ws("_", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("parent_state_id"), F.col("role").alias("tactics"), "conv_id", "turn")
    return TR.state_parents(s).select("conv_id", "turn", "parent_tactics")


# -- sources, sinks, monitoring ----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def src01_scan(v):
    return v.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


def _scratch(v, name: str) -> str:
    """A folder of its own, shared by the executors, for the write-and-read queries."""
    return scratch(v.spark, name)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src04_csv_round_trip(v):
    from ..sources.sinks import write_csv

    write_csv(v.nation, path := _scratch(v, "csv"))
    return SRC.read_csv(v.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT conv_id, turn, role, md5(text) AS h FROM conversations")
def src05_json_round_trip(v):
    from ..sources.sinks import write_json

    write_json(v.conversations, path := _scratch(v, "json"))
    return SRC.read_json(v.spark, path, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("h"))


@query("SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS first_link, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def src09_page_links(v):
    return v.pages.select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_extract("html", '<a href="([^"]*)"', 1).alias("first_link"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("SELECT date_trunc('second', min(ts)) AS first_time, date_trunc('second', max(ts)) AS last_time, count(*) AS parsed_lines FROM events")
def src10_log_parse(v):
    lines = v.events.select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | INFO | "), "event_type").alias("value"))
    return SRC.log_times(lines.unionByName(v.spark.createDataFrame([("no time here",)], "value string")))


@query("SELECT * FROM (VALUES ('a', 1), ('b', 2)) t(name, n)")
def src11_literal_rows(v):
    return SRC.literal_rows(v.spark, [("a", 1), ("b", 2)], "name string, n int")


@query("SELECT o_orderkey, o_orderstatus AS shard_id FROM orders WHERE o_orderstatus = 'F'")
def snk01_shards(v):
    from ..sources.sinks import write_shards

    write_shards(v.orders.select("o_orderkey", F.col("o_orderstatus").alias("shard_id")), path := _scratch(v, "shards"), rows_a_file=5000)
    return SRC.read_shard(v.spark, path, "F")


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM customer) GROUP BY 1")
def snk05_splits(v):
    from ..sources.sinks import write_splits

    write_splits(v.customer.withColumn("split", F.when(F.col("c_custkey") % 10 == 0, "test").otherwise("train")), path := _scratch(v, "splits"))
    return v.spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 != 0")
def snk06_pending(v):
    from ..sources.sinks import pending

    v.orders.where("o_orderkey % 3 = 0").select("o_orderkey").write.parquet(path := _scratch(v, "done"))
    return pending(v.orders.select("o_orderkey"), path, "o_orderkey")


@query("SELECT c_custkey AS id, c_name FROM customer")
def snk07_append_unseen(v):
    from ..sources.sinks import append_unseen

    c = v.customer.select(F.col("c_custkey").alias("id"), "c_name")
    path = _scratch(v, "log")
    append_unseen(c.where("id % 2 = 0"), path)
    append_unseen(c, path)
    return v.spark.read.parquet(path)


@query("SELECT event_type AS stage, count(*) AS finished FROM events GROUP BY 1")
def stm02_progress(v):
    from ..streaming.monitors import progress_of

    return progress_of(v.spark, f"{v.sf_dir}/events.parquet", v.events.schema, "event_type", _scratch(v, "progress"))


@query("SELECT l_orderkey AS statement_id, count(*) AS proof_count FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def stm03_counters(v):
    from ..streaming.monitors import counters_of

    return counters_of(v.spark, f"{v.sf_dir}/lineitem.parquet", v.lineitem.schema, "l_orderkey", F.col("l_returnflag") == "R", _scratch(v, "counters"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x != '') AS a FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(1, len(a) - 4) + 1), lambda i: array_to_string(a[i:i+4], ' ')))) AS s FROM w WHERE len(a) > 0),
reps AS (SELECT min(doc_id) AS rep, s FROM g GROUP BY s), x AS (SELECT rep, len(s) AS l, unnest(s) AS t FROM reps),
i AS (SELECT a.rep AS src, b.rep AS dst, count(*) AS n, a.l AS la, b.l AS lb FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep GROUP BY ALL)
SELECT src, dst, round(n / (la + lb - n), 6) AS jaccard FROM i WHERE n / (la + lb - n) >= 0.7"""
)
def set07_exact_jaccard_pairs(v):
    return S.jaccard_pairs(v.documents, "doc_id", "text").select("src", "dst", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT s_suppkey, s_name FROM supplier")
def snk02_csv(v):
    from ..sources.sinks import write_csv

    write_csv(v.supplier.select("s_suppkey", "s_name"), path := _scratch(v, "csv"))
    return SRC.read_csv(v.spark, path, "s_suppkey long, s_name string")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def snk03_json(v):
    from ..sources.sinks import write_json

    write_json(v.supplier.select("s_suppkey", "s_name", "s_nationkey"), path := _scratch(v, "json"))
    return SRC.read_json(v.spark, path, "s_suppkey long, s_name string, s_nationkey int")


@query("SELECT r_regionkey, r_name FROM region")
def snk04_publish(v):
    from ..sources.sinks import publish

    return v.spark.read.parquet(publish(v.region, _scratch(v, "hub"), "region", "main"))


@query("SELECT part, count(*) AS n FROM (SELECT p_partkey % 4 AS part FROM part WHERE p_size > 20) GROUP BY 1")
def udf01_row_functions(v):
    """map, batched map and filter, as Arrow-batched functions of the user's."""
    import pandas as pd

    @F.pandas_udf("boolean")
    def keep(s: pd.Series) -> pd.Series:
        return s > 20

    @F.pandas_udf("long")
    def shard(s: pd.Series) -> pd.Series:
        return s % 4

    return v.part.where(keep("p_size")).select(shard("p_partkey").alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, max(o_orderkey) AS last FROM orders GROUP BY 1")
def udf02_group_function(v):
    import pandas as pd

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_custkey": [pdf["o_custkey"].iloc[0]], "kinds": [pdf["o_orderpriority"].nunique()], "last": [pdf["o_orderkey"].max()]})

    return v.orders.select("o_custkey", "o_orderpriority", "o_orderkey").groupBy("o_custkey").applyInPandas(summary, "o_custkey long, kinds long, last long")
