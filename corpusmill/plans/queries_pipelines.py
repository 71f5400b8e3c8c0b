"""Queries that run scanners, services (stubs) and whole pipelines; where SQL can say the result, it is given."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions import lean
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import external as X
from ..operators import joins as J
from ..operators import relational as R
from ..operators import sets as S
from ..operators import trees as TR
from ..sources import sinks, tables
from . import pipelines as P
from .queries_core import _joined, _metrics_sql
from .queries_more import _scratch
from .registry import query
from .views import WITH

def _scan(v, f, kind: str):
    return v.theorems.select("id", lean.column(f, kind)("code").alias("out"))


def _parts(v, f, *names: str):
    """A scanner's list as columns."""
    return _scan(v, lambda x: list(f(x) or ()), "array<string>").select("id", *[F.get("out", F.lit(i)).alias(n) for i, n in enumerate(names)])


#: Of a theorem's code, in SQL: what comes before its proof, and the whole up to its colon.
HEAD = "lib || 'theorem ' || name || ' ' || binders || ' : ' || conclusion || ' := by'"
BEFORE_COLON = "lib || 'theorem ' || name || ' ' || binders || ' '"


@query(WITH + f"SELECT id, length({HEAD})::INTEGER AS place FROM theorems")
def str02_split_indexes(v):
    return _scan(v, lean.split_indexes, "array<int>").select("id", F.explode("out").alias("place"))


@query(WITH + "SELECT id, true AS out FROM theorems")
def str03_splitable(v):
    return _scan(v, lean.splitable, "boolean")


@query(WITH + f"SELECT id, {HEAD} || chr(10) AS proof_input, proof AS proof_output FROM theorems")
def str04_split_proof(v):
    return v.theorems.select("id", P._split(F.col("code")).alias("s")).select("id", "s.*")


@query(WITH + f"SELECT id, {HEAD} AS head, proof AS tail FROM theorems")
def str05_split_by_line(v):
    return _parts(v, lean.split_proof_by_line, "head", "tail")


@query(WITH + f"SELECT id, length({BEFORE_COLON})::INTEGER AS out FROM theorems")
def str08_top_level_colon(v):
    return _scan(v, lean.top_level_colon, "int")


@query(WITH + "SELECT id, lib, name, binders, conclusion, ':= by' || chr(10) || proof AS proof FROM theorems")
def str09_components(v):
    return _parts(v, lambda x: (lean.components(x) or {}).values(), "lib", "name", "binders", "conclusion", "proof")


@query("SELECT p_partkey, replace(replace('{' || p_name || '}', '{', '('), '}', ')') AS out FROM part")
def str10_braces(v):
    return v.part.select("p_partkey", F.translate(F.concat(F.lit("{"), "p_name", F.lit("}")), "{}", "()").alias("out"))


@query(WITH + "SELECT id, lib || 'theorem ' || name || '_negated : ¬ (∀ ' || replace(replace(binders, '{', '('), '}', ')') || ', ' || conclusion || ') := by sorry' AS out FROM theorems")
def str11_negate(v):
    return _scan(v, lean.negate, "string")


@query(WITH + "SELECT id, lib || 'theorem ' || name || '_negated ' || binders || ' : ¬ (' || conclusion || ') := by sorry' AS out FROM theorems")
def str11_negate_partial(v):
    return _scan(v, lean.negate_partial, "string")


@query(WITH + "SELECT id, lib || 'theorem ' || name || '_contradicted ' || binders || ' : False := by sorry' AS out FROM theorems")
def str12_contradict(v):
    return _scan(v, lean.contradict, "string")


@query(WITH + f"SELECT id, 'import M' || chr(10) AS header, '' AS context, '' AS comment, substr({HEAD}, length(lib) + 1) AS statement FROM theorems")
def str14_context(v):
    return _parts(v, lambda x: lean.context_of(x, 99).values(), "header", "context", "comment", "statement")


@query(WITH + "SELECT id, '  simp' AS out FROM theorems")
def str20_truncate(v):
    return v.theorems.select("id", lean.column(lean.truncate_tactic, "string")(P._split(F.col("code"))["proof_output"]).alias("out"))


@query(WITH + "SELECT id, code AS out FROM theorems")
def str23_rebuild(v):
    return _scan(v, lambda x: lean.rebuild([{"tactic": t.strip(), "line": i + 1, "column": len(t) - len(t.lstrip())} for i, t in enumerate(x.split("\n"))]), "string")


@query(WITH + "SELECT id, len(string_split(p_name, ' ')) + 2 AS out FROM theorems")
def str24_longest_common_run(v):
    return _scan(v, lambda x: lean.longest_common_run(x.split(), ["by", "exact", *x.split()[x.split().index("simp") :], "x"]), "int").select("id", F.col("out").cast("long").alias("out"))


@query(WITH + f"SELECT id, (length({HEAD}) - 5)::INTEGER AS first, (length({HEAD}))::INTEGER AS last FROM theorems")
def str26_loose_match(v):
    return _scan(v, lambda x: list(lean.loose_span(x, ": = by") or ()), "array<int>").select("id", F.get("out", F.lit(0)).alias("first"), F.get("out", F.lit(1)).alias("last"))


@query(WITH + ", l AS (SELECT id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT id, string_split(p_name, ' ') AS w FROM theorems)) SELECT id, (i - 1)::INTEGER AS step, CASE WHEN i > 1 THEN ' ' ELSE '' END || x AS part FROM l")
def win03_settle_spaces(v):
    settled = lean.column(lambda x: lean.settle_spaces([p + " " for p in x.split(" ")][:-1] + x.split(" ")[-1:]), "array<string>")
    return v.part.select(F.col("p_partkey").alias("id"), F.posexplode(settled("p_name")).alias("step", "part"))


@query("SELECT p_partkey AS id, array_to_string(list_transform(range(0, len(w), 2), lambda i: w[i + 1] || coalesce(w[i + 2], '')), ',') AS out FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part)")
def win04_merge_equal_goals(v):
    def merged(x):
        steps = [{"tactic": t, "goals_before": [i // 2], "goals_after": [(i + 1) // 2]} for i, t in enumerate(x.split(" "))]
        return ",".join(s["tactic"] for s in TR.merge_equal_goals(steps))

    return v.part.select(F.col("p_partkey").alias("id"), lean.column(merged, "string")(F.concat_ws(" ", "p_name", "p_type")).alias("out"))


@query("SELECT id, (i - 1)::INTEGER AS line, (-0.5 * (length(x) + CASE WHEN i > 1 THEN 1 ELSE 0 END))::DOUBLE AS logprob FROM (SELECT p_partkey AS id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))")
def win09_segment_logprobs(v):
    sums = lean.column(lambda x: lean.segment_logprobs(list(x), [-0.5] * len(x), x.split("\n")), "array<double>")
    return v.part.select(F.col("p_partkey").alias("id"), F.posexplode(sums(F.translate("p_name", " ", "\n"))).alias("line", "logprob"))


def _infotrees(v):
    """An info tree for each part: a node, whose child failed to print, whose child is a node again; beside it a copy of the first."""

    def node(pp, column, children):
        return F.concat(F.lit('{"node":{"stx":{"pp":"'), pp, F.lit('","range":{"synthetic":false,"start":{"line":1,"column":'), column, F.lit('},"finish":{"line":1,"column":90}}},"goalsBefore":["g"],"goalsAfter":[]},"children":['), children, F.lit("]}"))

    inner = node(F.col("p_name"), F.lit("5"), F.lit(""))
    failed = node(F.lit("<failed to pretty print>"), F.lit("3"), inner)
    outer = node(F.concat(F.lit("by "), "p_name"), F.lit("2"), failed)
    return v.part.select(F.col("p_partkey").cast("string").alias("tree_id"), F.concat(F.lit("["), outer, F.lit(","), outer, F.lit("]")).alias("infotree"))


@query("SELECT p_partkey::VARCHAR AS tree_id, k AS node_id, CASE WHEN k % 2 = 1 THEN k - 1 ELSE -1 END AS parent_id, CASE WHEN k % 2 = 0 THEN 'by ' ELSE '' END || p_name AS text, false AS synthetic, CASE WHEN k % 2 = 0 THEN 2 ELSE 5 END AS start_column, 90 AS end_column, 'g' AS goal FROM part, (SELECT unnest([0, 1, 2, 3])::INTEGER AS k)")
def tre01_flatten_infotree(v):
    return TR.infotree_nodes(_infotrees(v)).select("tree_id", "node_id", "parent_id", "text", "synthetic", "start_column", "end_column", F.col("goals_before")[0].alias("goal"))


@query("SELECT p_partkey::VARCHAR AS tree_id, k AS node_id, CASE WHEN k = 2 THEN 'by ' ELSE '' END || p_name AS text, CASE WHEN k = 2 THEN 10002 ELSE 10005 END AS s, CASE WHEN k = 2 THEN 10005 ELSE 10090 END AS e FROM part, (SELECT unnest([2, 3])::INTEGER AS k)")
def tre03_extract_tactics(v):
    n = TR.infotree_nodes(_infotrees(v)).where("not synthetic")
    at = n.withColumn("s", F.col("start_line") * 10_000 + F.col("start_column")).withColumn("e", F.col("end_line") * 10_000 + F.col("end_column"))
    return R.disjoint_intervals(at, "tree_id", ["s", "node_id"], "s", "e").select("tree_id", "node_id", "text", "s", "e")


@query("SELECT p_partkey, unnest(['1', '1.1', '1.1.1', '1.2']) AS id, unnest([NULL, '1', '1.1', '1']) AS parent, unnest(['Proposition', 'Lemma', 'Claim', 'Lemma']) AS type, unnest([p_name, p_type, p_name || chr(10) || 'more of it', p_brand]) AS content FROM part")
def tre05_outline(v):
    outline = F.concat(F.lit("Proposition 1: "), "p_name", F.lit("\n├── Lemma 1.1: "), "p_type", F.lit("\n│   └── Claim 1.1.1: "), "p_name", F.lit("\n│       more of it\n└── Lemma 1.2: "), "p_brand")
    return TR.outline_nodes(v.part.select("p_partkey", outline.alias("outline")), "p_partkey", "outline")


@query()
def lim04_diverse_greedy(v):
    return P.diverse_each(v.proofs.select("statement_id", F.translate("formal_proof", "-", " ").alias("formal_proof")), "statement_id", "formal_proof", 3)


#: The stubs' number of some texts, in SQL.
def _digest(*parts: str) -> str:
    return "('0x' || substr(sha256(" + " || chr(31) || ".join(parts) + "), 1, 16))::UBIGINT"


@query("WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM r WHERE rank <= 2")
def lim06_priority(v):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return v.orders.select("o_custkey", "o_orderkey", rank.alias("rank")).where("rank <= 2")


@query(WITH + f"SELECT uuid, problem, NULL::VARCHAR AS error, 'proof ' || {_digest('problem', 'i::VARCHAR')} % 1000 || ' of ' || substr(problem, 1, 20) AS formal_proof, uuid || '_' || i AS proof_id FROM problems, range(2) r(i)")
def ext01_generate(v):
    return X.explode_completions(X.generate(v.problems.select("uuid", "problem"), "problem", 2), "uuid")


@query(f"SELECT p_partkey, p_name, i::INTEGER AS vote, 'Status: ' || CASE WHEN {_digest("'judge'", 'p_name', 'i::VARCHAR')} % 3 > 0 THEN 'Correct' ELSE 'Incorrect' END AS reply FROM part, range(3) r(i)")
def ext02_votes(v):
    return X.votes(v.part.select("p_partkey", "p_name"), "p_name", 3)


@query(WITH + f"SELECT statement_id, formal_proof, k < 3 AS has_error, k > 3 AS is_valid_no_sorry, k >= 3 AS is_valid_with_sorry FROM (SELECT *, {_digest("'verify'", 'formal_proof')} % 9 AS k FROM proofs)")
def ext03_verify(v):
    return X.verify(v.proofs.select("statement_id", "formal_proof"), "formal_proof").drop("lean_feedback")


@query(f"SELECT p_partkey, {_digest("'verify'", 'p_name')} % 9 < 3 AS has_error FROM part")
def ext03_cached_verify(v):
    return X.cached(v.part.select("p_partkey", "p_name"), _scratch(v, "cache"), "p_partkey", lambda d: X.verify(d, "p_name")).select("p_partkey", "has_error")


@query(f"SELECT p_partkey, p_name, 'theorem t' || {_digest("'model'", "'Formalise: ' || p_name")} % 10000 || ' : True' AS output, NULL::VARCHAR AS error FROM part")
def ext04_local_model(v):
    return X.infer(v.part.select("p_partkey", "p_name"), "p_name", prompt="Formalise: {}")


@query(f"SELECT p_partkey, i::INTEGER AS place, ({_digest('p_name', 'i::VARCHAR')} % 2001)::DOUBLE / 1000 - 1 AS value FROM part, range(8) r(i)")
def ext05_embed(v):
    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        return pd.Series(X.stub_embedder(s.fillna("").tolist()))

    return v.part.select("p_partkey", F.posexplode(embed("p_name")).alias("place", "value"))


@query()
def ext06_search(v):
    return X.search(v.part.select("p_name"), "p_name")


# -- sources and sinks ---------------------------------------------------------------


@query("SELECT count(*) AS n FROM orders")
def src02_directory(v):
    v.orders.repartition(3).write.parquet(path := _scratch(v, "dir"))
    return tables.read_table(v.spark, path).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
def src03_shard(v):
    sinks.write_shards(v.orders.select("o_orderkey", (F.col("o_orderkey") % 7).cast("string").alias("shard_id")), path := _scratch(v, "shard"))
    return tables.read_shard(v.spark, path, "3").select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation")
def src06_json_files(v):
    path = _scratch(v, "jsons")
    v.nation.select((F.col("n_nationkey") % 5).alias("folder"), F.to_json(F.struct("n_nationkey", "n_name")).alias("value")).repartition(25, F.col("value")).write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
    docs = tables.read_json_files(v.spark, f"{path}/*/*.txt")
    return docs.select(F.variant_get("doc", "$.n_nationkey", "int").alias("n_nationkey"), F.variant_get("doc", "$.n_name", "string").alias("n_name"))


@query()
def src07_folders(v):
    path = _scratch(v, "folders")
    v.nation.select((F.col("n_nationkey") % 5).alias("folder"), "n_name").groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value")).write.partitionBy("folder").text(path)
    names = tables.list_files(v.spark, path, "*.txt").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("n")).distinct()
    return tables.read_folders(v.spark, path, tuple(sorted(r["n"] for r in names.collect())))


@query()
def src08_list_files(v):
    return tables.list_files(v.spark, v.sf_dir, "*.parquet").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders")
def src12_saved(v):
    path = sinks.publish(v.orders.select("o_orderkey", "o_totalprice"), _scratch(v, "hub"), "orders", "v1")
    return tables.read_table(v.spark, path.rpartition("/")[0], revision="v1")


@query("SELECT event_type AS stage, count(*) AS finished, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def stm05_status(v):
    return A.shares(v.events, "event_type").withColumnsRenamed({"event_type": "stage", "n": "finished", "ratio": "share"})


@query("SELECT o_orderkey FROM orders")
def stm04_resume(v):
    """A run that stopped halfway and goes on: finished keys are left out, all are there in the end."""
    path = _scratch(v, "resume")
    o = v.orders.select("o_orderkey")
    o.where("o_orderkey % 2 = 0").write.parquet(path)
    sinks.pending(o, path, "o_orderkey").write.mode("append").parquet(path)
    return v.spark.read.parquet(path)


# -- pipelines ---------------------------------------------------------------------------


@query(WITH + f""", s AS (SELECT uuid, uuid || '_' || i AS statement_id, 'proof ' || {_digest('problem', 'i::VARCHAR')} % 1000 || ' of ' || substr(problem, 1, 20) AS st FROM problems, range(4) r(i)),
ok AS (SELECT * FROM s WHERE {_digest("'verify'", 'st')} % 9 >= 3), p AS (SELECT uuid, 'proof ' || {_digest('st', 'i::VARCHAR')} % 1000 || ' of ' || substr(st, 1, 20) AS pr FROM ok, range(4) r(i)),
v AS (SELECT uuid, {_digest("'verify'", 'pr')} % 9 > 3 AS valid FROM p), u AS (SELECT uuid, count(*) AS n, count(*) FILTER (WHERE valid) AS k FROM v GROUP BY 1)
SELECT round(sum(k) / sum(n), 6) AS valid_rate, round(count(*) FILTER (WHERE k > 0) / count(*), 6) AS prove_rate, NULL::DOUBLE AS negative_ratio_of_sums, NULL::DOUBLE AS negative_share_solved FROM u""")
def pip01_expert_iteration(v):
    return A.rates(P.expert_iteration(v.problems))


@query(
    WITH
    + f""", st AS (SELECT id::VARCHAR AS statement_id, code AS f FROM theorems UNION ALL SELECT 'neg_' || id, lib || 'theorem ' || name || '_negated : ¬ (∀ ' || replace(replace(binders, '{{', '('), '}}', ')') || ', ' || conclusion || ') := by sorry' FROM theorems),
rec AS (SELECT p_partkey::VARCHAR AS statement_id, 5 AS n FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'neg_' || p_partkey, 1 FROM part WHERE p_partkey % 4 = 1),
todo AS (SELECT st.* FROM st LEFT JOIN rec own USING (statement_id) LEFT JOIN rec o ON o.statement_id = CASE WHEN starts_with(st.statement_id, 'neg_') THEN substr(st.statement_id, 5) ELSE 'neg_' || st.statement_id END WHERE coalesce(own.n, 0) <= 2 AND coalesce(o.n, 0) = 0)
SELECT statement_id, statement_id || '_' || i AS proof_id, {_digest("'verify'", f"('proof ' || {_digest('f', 'i::VARCHAR')} % 1000 || ' of ' || substr(f, 1, 20))")} % 9 > 3 AS is_valid FROM todo, range(2) r(i)"""
)
def pip02_proof_generation(v):
    s = v.theorems.select(F.col("id").cast("string").alias("statement_id"), F.col("code").alias("formal_statement"), F.lit(False).alias("is_negation"))
    own = v.part.where("p_partkey % 4 = 0").select(F.col("p_partkey").cast("string").alias("statement_id"), F.lit(5).cast("long").alias("proof_count"))
    other = v.part.where("p_partkey % 4 = 1").select(F.concat(F.lit("neg_"), "p_partkey").alias("statement_id"), F.lit(1).cast("long").alias("proof_count"))
    return P.proof_generation(P.negated(s), own.unionByName(other))[0].select("statement_id", "proof_id", "is_valid")


@query(WITH + "SELECT a.statement_id, a.n_proofs, a.n_correct_proofs, s.uuid, s.is_negation FROM agg_statements a JOIN statements s USING (statement_id)")
def pip03_statements_only(v):
    return A.proofs_to_statements(v.proofs).select("statement_id", "n_proofs", "n_correct_proofs").join(v.statements.select("statement_id", "uuid", "is_negation"), "statement_id")


@query()
def pip04_auto_sft(v):
    return P.auto_sft(v.proofs, v.statements)


@query("WITH x AS (SELECT o_custkey AS uuid, o_orderpriority AS formal_proof, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) r FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_custkey % 10 != 0)) SELECT uuid, formal_proof FROM x WHERE r <= 2")
def pip05_human_statements(v):
    df = v.orders.groupBy(F.col("o_custkey").alias("uuid")).agg(F.collect_list("o_orderpriority").alias("proofs")).withColumn("tags", F.array(F.lit("human"), F.lit("x")))
    return P.human_statements(df, "human", v.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("uuid")), 2)


@query(WITH + f"SELECT id, {HEAD} || chr(10) AS proof_input, proof AS proof_output FROM theorems WHERE id % 10 != 0")
def pip06_human_proofs(v):
    t = v.theorems.where(lean.column(lean.splitable, "boolean")("code"))
    t = J.anti(t, v.part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("id")), "id")
    return t.select("id", P._split(F.col("code")).alias("s")).select("id", "s.*")


@query()
def pip07_filter_dedup(v):
    return P.filtered_and_deduped(v.documents.select("doc_id", "text"), "doc_id", "text", [("char_length", {"low": 50}), ("without_word", {"word": "|"})]).select("doc_id")


@query("SELECT part, count(*) AS n FROM (SELECT 'customer' AS part FROM customer, range(2) UNION ALL SELECT * FROM (SELECT 'part' FROM part LIMIT (SELECT floor(count(*) * 0.25)::BIGINT FROM part))) GROUP BY 1")
def pip08_mixture(v):
    return S.mixture({"customer": (v.customer.select(F.col("c_custkey").alias("id")), 2), "part": (v.part.select(F.col("p_partkey").alias("id")), 0.25)}, "id").groupBy("part").agg(F.count("*").alias("n"))


@query(WITH + f""", todo AS (SELECT min(statement_id) AS statement_id, uuid, formal_statement FROM statements WHERE statement_id NOT IN (SELECT statement_id FROM agg_statements WHERE n_correct_proofs > 0) GROUP BY 2, 3)
SELECT statement_id, uuid, formal_statement, 'Correct' AS status FROM todo WHERE (SELECT count(*) FROM range(3) r(i) WHERE {_digest("'judge'", 'formal_statement', 'i::VARCHAR')} % 3 > 0) >= 2""")
def pip09_candidates(v):
    return P.candidate_build(v.statements, A.proofs_to_statements(v.proofs).where("n_correct_proofs > 0"))


@query("SELECT source, count(*) AS n FROM (SELECT 'a:' || p_brand AS source FROM part WHERE p_size > 10 UNION ALL SELECT 'b:' || c_mktsegment FROM customer) GROUP BY 1")
def pip10_whole_proofs(v):
    both = S.union_all(v.part.where("p_size > 10").select(F.concat(F.lit("a:"), "p_brand").alias("source")), v.customer.select(F.concat(F.lit("b:"), "c_mktsegment").alias("source")))
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query(WITH + f"SELECT key, {HEAD} AS prefix, id, CASE WHEN id = 7 THEN 'eval' WHEN ('0x' || substr(sha256(key), 1, 13))::BIGINT < 0.1 * 4503599627370496 THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, id || '_' || length({HEAD}) AS key FROM theorems)")
def pip11_eval_splits(v):
    t = v.theorems.select("id", "code", F.explode(lean.column(lean.split_indexes, "array<int>")("code")).alias("at"))
    t = t.select(F.concat_ws("_", F.col("id").cast("string"), F.col("at").cast("string")).alias("key"), F.substring("code", F.lit(1), F.col("at")).alias("prefix"), "id")
    return S.hash_split(t, "key", 0.1, {7: "eval"}, "id")


@query(WITH + ", l AS (SELECT id, string_split(code, chr(10)) AS w FROM theorems) SELECT id, i::INTEGER AS step, array_to_string(w[1:i], chr(10)) || CASE WHEN i > 0 THEN chr(10) ELSE '' END AS prefix, array_to_string(w[i + 1:], chr(10)) AS suffix FROM l, range(5) r(i)")
def pip12_steps(v):
    t = v.theorems.select("id", F.split("code", "(?<=\n)").alias("tactics"))
    return R.prefixes(t, "tactics").select("id", "step", "prefix", "suffix")


@query(WITH + ", f AS (SELECT statement_id, min(sample_id) FILTER (WHERE is_valid) AS first, count(*) n, count(*) FILTER (WHERE is_valid) k FROM proofs GROUP BY 1) SELECT count(*) AS n_problems, sum(k)::BIGINT AS n_correct_proofs, round(count(first) / count(*), 6) AS success_rate FROM f")
def pip13_evaluation(v):
    f = v.proofs.groupBy("statement_id").agg(F.min(F.when(F.col("is_valid"), F.col("sample_id"))).alias("first"), F.count_if("is_valid").alias("k"))
    return f.agg(F.count("*").alias("n_problems"), F.sum("k").alias("n_correct_proofs"), F.round(F.count("first") / F.count("*"), 6).alias("success_rate"))


@query(f"""WITH d AS (SELECT quality = 1 AS t, (SELECT count(*) FROM range(3) r(i) WHERE {_digest("'judge'", "coalesce(text, '')", 'i::VARCHAR')} % 3 > 0) >= 2 AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) AS n FROM d)
SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn + fp + fn) / n, 6) AS conclusive FROM c""")
def pip14_judge_evaluation(v):
    return P.judge_evaluation(v.labels.join(v.documents, "doc_id").select("doc_id", "text", "quality"), "doc_id", "text", F.col("quality") == 1)


@query(f"SELECT p_partkey, p_name FROM part WHERE p_partkey <= 20 UNION ALL SELECT * FROM (SELECT p_partkey, p_name FROM part WHERE p_partkey > 20 ORDER BY sha256(p_partkey::VARCHAR || '37'), p_partkey LIMIT 100) WHERE {_digest("'verify'", 'p_name')} % 9 > 3")
def pip15_bootstrap(v):
    pool = v.part.select("p_partkey", "p_name")
    return P.bootstrap_round(pool, pool.where("p_partkey <= 20"), "p_partkey", "p_name", 100, "37")


@query(_metrics_sql("sample_id % 3").replace("SELECT category, sum(valid)::BIGINT AS valid, sum(total)::BIGINT AS total, round(sum(valid) / sum(total), 6) AS valid_ratio FROM m GROUP BY category", "SELECT category, sum(valid)::BIGINT AS shard_valid, sum(total)::BIGINT AS shard_total FROM m GROUP BY category"))
def pip16_monitoring(v):
    return P.monitoring(_joined(v)).select("category", "shard_valid", "shard_total")


@query(
    WITH
    + """, g AS (SELECT s.*, coalesce(a.n_correct_proofs, 0) AS k FROM statements s LEFT JOIN agg_statements a USING (statement_id)), o AS (SELECT uuid FROM g GROUP BY 1 HAVING sum(k) > 20),
 kept AS (SELECT * FROM g WHERE uuid NOT IN (SELECT uuid FROM o)), fine AS (SELECT * FROM kept x WHERE NOT EXISTS (SELECT 1 FROM kept y WHERE y.k > 0 AND xor(y.statement_id, 1) = x.statement_id))
SELECT min(statement_id) AS statement_id, uuid, formal_statement FROM fine GROUP BY uuid, formal_statement"""
)
def pip17_curate(v):
    return P.curate(v.statements, v.proofs)




@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Correct' ELSE 'Incorrect' END AS status FROM part")
def udf03_pluggable_judge(v):
    """A judge and a parser of the user's own."""

    def judge(texts, vote):
        return ["Status: Correct" if int(t) > 25 else "Status: Incorrect" for t in texts]

    replies = X.votes(v.part.select("p_partkey", F.col("p_size").cast("string").alias("t")), "t", 3, judge).withColumn("status", T.judge_line_status(F.col("reply")))
    return A.strict_majority(replies, "p_partkey", "status")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'valid' ELSE 'invalid' END AS status FROM customer, range(2)) GROUP BY 1")
def stm01_generate_verify(v):
    """Generation feeds verification; the table between them is the queue, and nothing is lost."""
    made = X.explode_completions(X.generate(v.customer.select("c_custkey", "c_name"), "c_name", 2, lambda p, n: [[t, t] for t in p]), "c_custkey")
    made.write.parquet(path := _scratch(v, "queue"))

    def checker(proofs):
        return ['{"error":null,"response":{"env":0}}' if int(p.split("#")[1]) % 2 == 0 else '{"error":"no","response":null}' for p in proofs]

    done = X.verify(v.spark.read.parquet(path), "formal_proof", checker)
    return done.groupBy(F.when(F.col("is_valid_no_sorry"), "valid").otherwise("invalid").alias("status")).agg(F.count("*").alias("n"))
