"""The entity tables (problems, statements, proofs, ...) as views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @property
    def problems(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("uuid"), F.col("c_name").alias("problem"), F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("nation"))

    @property
    def statements(self) -> DataFrame:
        return self.orders.select(F.col("o_orderkey").alias("statement_id"), F.col("o_custkey").alias("uuid"), F.col("o_orderpriority").alias("formal_statement"), (F.col("o_orderstatus") == "F").alias("is_negation"))

    @property
    def proofs(self) -> DataFrame:
        return self.lineitem.select(F.col("l_orderkey").alias("statement_id"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("formal_proof"), F.col("l_linenumber").alias("sample_id"), (F.col("l_returnflag") == "R").alias("is_valid"))

    @property
    def lean_feedback(self) -> DataFrame:
        """Checker replies as JSON, by event type: an error message, a sorry warning, a plain warning, a failed call, a clean reply."""
        body = (
            F.when(F.col("event_type") == "error", F.lit('{"error":null,"response":{"env":0,"messages":[{"severity":"error","data":"unknown identifier"}]}}'))
            .when(F.col("event_id") % 5 == 0, F.lit("{\"error\":null,\"response\":{\"env\":0,\"messages\":[{\"severity\":\"warning\",\"data\":\"declaration uses 'sorry'\"}]}}"))
            .when(F.col("event_id") % 5 == 1, F.lit('{"error":"timeout","response":null}'))
            .when(F.col("event_id") % 5 == 2, F.lit('{"error":null,"response":{"env":0,"messages":[{"severity":"warning","data":"unused variable"}]}}'))
            .when(F.col("event_id") % 5 == 3, F.lit('{"error":null,"response":{"env":0}}'))
            .otherwise(F.lit("{not json"))
        )
        return self.events.select("event_id", body.alias("feedback"))

    @property
    def theorems(self) -> DataFrame:
        """A formal theorem for each part: a header, binders of both kinds, a conclusion and a proof of two lines."""
        k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
        code = F.concat(F.lit("import M\n\ntheorem t"), k, F.lit(" (x : ℕ) {h : x > "), size, F.lit("} : x + "), k, F.lit(" = "), size, F.lit(" := by\n  simp\n  exact "), "p_name")
        return self.part.select(F.col("p_partkey").alias("id"), code.alias("code"))

    @property
    def tree_edges(self) -> DataFrame:
        """region -> nation -> customer -> order, with string ids and an order among siblings."""
        n = self.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.col("n_nationkey").cast("long").alias("ord"))
        c = self.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"), F.col("c_custkey").alias("ord"))
        o = self.orders.select(F.concat(F.lit("c"), "o_custkey").alias("parent"), F.concat(F.lit("o"), "o_orderkey").alias("child"), F.col("o_orderkey").alias("ord"))
        return n.unionByName(c).unionByName(o)


#: The same views as common table expressions.
SQL = """problems AS (SELECT c_custkey AS uuid, c_name AS problem, c_mktsegment AS source, c_nationkey AS nation FROM customer),
statements AS (SELECT o_orderkey AS statement_id, o_custkey AS uuid, o_orderpriority AS formal_statement, (o_orderstatus = 'F') AS is_negation FROM orders),
proofs AS (SELECT l_orderkey AS statement_id, concat_ws('-', l_partkey, l_suppkey) AS formal_proof, l_linenumber AS sample_id, (l_returnflag = 'R') AS is_valid FROM lineitem),
lean_feedback AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '{"error":null,"response":{"env":0,"messages":[{"severity":"error","data":"unknown identifier"}]}}'
 WHEN event_id % 5 = 0 THEN '{"error":null,"response":{"env":0,"messages":[{"severity":"warning","data":"declaration uses ''sorry''"}]}}'
 WHEN event_id % 5 = 1 THEN '{"error":"timeout","response":null}'
 WHEN event_id % 5 = 2 THEN '{"error":null,"response":{"env":0,"messages":[{"severity":"warning","data":"unused variable"}]}}'
 WHEN event_id % 5 = 3 THEN '{"error":null,"response":{"env":0}}' ELSE '{not json' END AS feedback FROM events),
tree_edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, n_nationkey::BIGINT AS ord FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey FROM orders),
theorems AS (SELECT *, lib || 'theorem ' || name || ' ' || binders || ' : ' || conclusion || ' := by' || chr(10) || proof AS code FROM (SELECT p_partkey AS id, 'import M' || chr(10) || chr(10) AS lib, 't' || p_partkey AS name,
 '(x : ℕ) {h : x > ' || p_size || '}' AS binders, 'x + ' || p_partkey || ' = ' || p_size AS conclusion, '  simp' || chr(10) || '  exact ' || p_name AS proof, p_name FROM part)),
agg_statements AS (SELECT statement_id, count(DISTINCT formal_proof) + max(CASE WHEN formal_proof IS NULL THEN 1 ELSE 0 END) AS n_proofs,
 count(*) FILTER (WHERE is_valid) AS n_correct_proofs,
 coalesce(first(formal_proof ORDER BY sample_id, formal_proof) FILTER (WHERE is_valid), '') AS one_formal_proof,
 coalesce(string_agg(formal_proof, ',' ORDER BY sample_id, formal_proof) FILTER (WHERE is_valid), '') AS samples FROM proofs GROUP BY statement_id)"""

WITH = f"WITH RECURSIVE {SQL}\n"
