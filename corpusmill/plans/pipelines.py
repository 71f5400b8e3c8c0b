"""End-to-end pipelines over the entity tables. Services are parameters; the stubs are the defaults."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lean
from ..functions import text as T
from ..operators import aggregate as A
from ..operators import external as X
from ..operators import joins as J
from ..operators import relational as R
from ..operators import sets as S


def negated(statements: DataFrame, keep: bool = False) -> DataFrame:
    """Statements and their negations; a negation that fails is dropped, or kept with a null text."""
    neg = lean.column(lean.negate, "string")
    made = statements.select(*[F.concat(F.lit("neg_"), "statement_id").alias(c) if c == "statement_id" else neg("formal_statement").alias(c) if c == "formal_statement" else F.lit(True).alias(c) if c == "is_negation" else F.col(c) for c in statements.columns])
    return statements.unionByName(made if keep else made.where("formal_statement is not null"))


def expert_iteration(problems: DataFrame, statements_each: int = 4, proofs_each: int = 4, generator=X.stub_generator, verifier=X.stub_verifier) -> DataFrame:
    """Problems to statements to verified proofs: uuid, statement_id, proof_id, flags."""
    s = X.explode_completions(X.generate(problems.select("uuid", "problem"), "problem", statements_each, generator), "uuid", "formal_statement").withColumnRenamed("proof_id", "statement_id").drop("error")
    s = X.verify(s, "formal_statement", verifier).where("is_valid_with_sorry").select("uuid", "statement_id", "formal_statement", F.lit(False).alias("is_negation"))
    p = X.explode_completions(X.generate(s, "formal_statement", proofs_each, generator), "statement_id")
    return X.verify(p, "formal_proof", verifier).select("uuid", "statement_id", "proof_id", "formal_proof", "is_negation", F.col("is_valid_no_sorry").alias("is_valid"))


def proof_generation(statements: DataFrame, store: DataFrame, samples: int = 2, most: int = 2, generator=X.stub_generator, verifier=X.stub_verifier) -> tuple[DataFrame, DataFrame]:
    """One round with early stop: statements within the record are proved; returns the proofs and the new record."""
    opposite = F.when(F.col("statement_id").startswith("neg_"), F.substring("statement_id", 5, 1000)).otherwise(F.concat(F.lit("neg_"), "statement_id"))
    todo = J.within_record(statements, store, "statement_id", opposite, most)
    p = X.verify(X.explode_completions(X.generate(todo, "formal_statement", samples, generator), "statement_id"), "formal_proof", verifier)
    p = p.withColumn("is_valid", F.col("is_valid_no_sorry"))
    return p, A.proof_records(p, store)


def auto_sft(proofs: DataFrame, statements: DataFrame, beta: float = 1.0, each: int = 3, text: str = "formal_proof") -> DataFrame:
    """Weighted keep, shortest proof of a statement, exact dedup, the first proofs of a problem, split into input and output."""
    agg = A.proofs_to_statements(proofs).join(statements, "statement_id").where("n_correct_proofs > 0")
    kept = S.weighted_keep(agg, "statement_id", F.col("is_negation"), F.col("n_correct_proofs") / F.col("n_proofs"), beta)
    short = kept.withColumn(text, R.shortest(F.col("correct_proof_samples"), T.remove_comments)).select("uuid", "statement_id", "formal_statement", text)
    one = S.keep_first(short, [text], ["statement_id"])
    chosen = R.first_n_each(one, "uuid", ["statement_id"], each)
    return chosen.withColumn("s", _split(F.col(text))).select("*", "s.*").drop("s")


def _split(c: Column) -> Column:
    @F.pandas_udf("struct<proof_input:string,proof_output:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lean.split_proof(x) or (x, "") for x in s], columns=["proof_input", "proof_output"])

    return run(c)


def diverse_each(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Greedy choice of n texts of a key that overlap least; a key's texts are one unit, their number bounded by samples a key. Python gets batches of keys, not a key at a time."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, chosen = [], []
            for i, texts in enumerate(b.column(1).to_pylist()):
                picked = lean.diverse(sorted(texts), n)
                rows += [i] * len(picked)
                chosen += picked
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(chosen, pa.string())], [key, text])

    texts = df.select(key, F.col(text).cast("string").alias(text)).groupBy(key).agg(F.collect_set(text).alias(text))
    return texts.mapInArrow(run, f"{key} {kind}, {text} string")


def human_statements(df: DataFrame, tag: str, eval_ids: DataFrame, pick: int) -> DataFrame:
    """Tagged rows outside the evaluation set, distinct proofs, the first `pick` of a problem."""
    rows = J.anti(df.where(F.array_contains("tags", tag)), eval_ids, "uuid").select("uuid", F.explode(F.array_distinct("proofs")).alias("formal_proof"))
    return R.first_n_each(rows, "uuid", ["formal_proof"], pick)


def filtered_and_deduped(df: DataFrame, key: str, text: str, chain: list[tuple[str, dict]]) -> DataFrame:
    """Named filters in order, then near-dedup."""
    return S.near_dedup(R.filter_chain(df, text, chain), key, text)


def candidate_build(statements: DataFrame, solved: DataFrame, n_votes: int = 3, judge=X.stub_judge) -> DataFrame:
    """Unsolved candidates, deduped by text, judged by votes; those with a strict majority for Correct."""
    todo = S.keep_first(J.anti(statements, solved, "statement_id").select("statement_id", "uuid", "formal_statement"), ["uuid", "formal_statement"], ["statement_id"])
    replies = X.votes(todo, "formal_statement", n_votes, judge).withColumn("status", F.nullif(T.judge_line_status(F.col("reply")), F.lit("Status not found")))
    return todo.join(A.strict_majority(replies, "statement_id", "status").where("status = 'Correct'"), "statement_id")


def judge_evaluation(df: DataFrame, key: str, text: str, label, n_votes: int = 3, judge=X.stub_judge) -> DataFrame:
    """Votes against labels: metrics of the strict majority."""
    replies = X.votes(df.select(key, text), text, n_votes, judge).withColumn("status", F.nullif(T.judge_line_status(F.col("reply")), F.lit("Status not found")))
    said = A.strict_majority(replies, key, "status")
    predicted = F.when(F.col("status") == "Correct", True).when(F.col("status") == "Incorrect", False)
    return A.classification_metrics(df.join(said, key), label, predicted)


def bootstrap_round(pool: DataFrame, done: DataFrame, key: str, text: str, n: int, seed: str, verifier=X.stub_verifier) -> DataFrame:
    """Anti-join, sample, verify, keep what passes, append."""
    new = X.verify(S.hash_sample(J.anti(pool, done, key).select(key, text), key, n, seed), text, verifier).where("is_valid_no_sorry")
    return S.union_all(done.select(key, text), new.select(key, text))


def curate(statements: DataFrame, proofs: DataFrame, most: int = 20) -> DataFrame:
    """Without over-solved problems and contradicted polarity, deduped by text within a problem."""
    agg = statements.join(A.proofs_to_statements(proofs), "statement_id", "left").withColumn("solved", F.coalesce("n_correct_proofs", F.lit(0)) > 0)
    over = agg.groupBy("uuid").agg(F.sum("n_correct_proofs").alias("n")).where(F.col("n") > most)
    kept = J.drop_contradicted(J.anti(agg, over, "uuid"), "statement_id", F.col("statement_id").bitwiseXOR(F.lit(1)), F.col("solved"))
    return S.keep_first(kept.select("statement_id", "uuid", "formal_statement"), ["uuid", "formal_statement"], ["statement_id"])


def monitoring(proofs: DataFrame) -> DataFrame:
    """Per category valid and total, by shards and globally."""
    return A.shard_metrics(proofs, F.col("sample_id") % 3).withColumnsRenamed({"valid": "shard_valid", "total": "shard_total", "valid_ratio": "shard_ratio"}).join(A.global_metrics(proofs), "category")
