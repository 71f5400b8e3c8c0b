"""Hierarchical aggregation: proofs to statements to problems, rates, votes, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_with_null(c: str | Column) -> Column:
    """Distinct values, null counted as one value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def proofs_to_statements(proofs: DataFrame, key: str = "statement_id", proof: str = "formal_proof", valid: str = "is_valid", order: str = "sample_id") -> DataFrame:
    """A row for each statement: distinct proof texts, valid rows, the valid proofs in order, and the first of them or ''."""
    ok, sample = F.coalesce(F.col(valid), F.lit(False)), F.struct(order, proof)
    samples = F.array_sort(F.collect_list(F.when(ok, sample)))
    return (
        proofs.groupBy(key)
        .agg(distinct_with_null(proof).alias("n_proofs"), F.count_if(ok).alias("n_correct_proofs"), samples.alias("s"))
        .select(key, "n_proofs", "n_correct_proofs", F.transform("s", lambda x: x[proof]).alias("correct_proof_samples"))
        .withColumn("one_formal_proof", F.coalesce(F.try_element_at("correct_proof_samples", F.lit(1)), F.lit("")))
    )


def merge_repeats(parts: DataFrame, key: str = "statement_id", run: str = "run") -> DataFrame:
    """Rows of one statement from several runs as one: counts are summed, samples flattened in the order of runs, the first proof kept."""
    ordered = F.array_sort(F.collect_list(F.struct(run, "correct_proof_samples", "one_formal_proof")))
    return (
        parts.groupBy(key)
        .agg(F.sum("n_proofs").alias("n_proofs"), F.sum("n_correct_proofs").alias("n_correct_proofs"), ordered.alias("o"))
        .select(key, "n_proofs", "n_correct_proofs", F.flatten("o.correct_proof_samples").alias("correct_proof_samples"), F.coalesce(F.try_element_at(F.filter("o.one_formal_proof", lambda p: p != ""), F.lit(1)), F.lit("")).alias("one_formal_proof"))
    )


def statement_info(statements: DataFrame) -> DataFrame:
    """(problem, statement text) rows: duplicates of a text merged, counts summed."""
    return statements.groupBy("uuid", "formal_statement").agg(F.sum("n_proofs").alias("n_proofs"), F.sum("n_correct_proofs").alias("n_correct_proofs"), F.count("*").alias("n_statements"), F.bool_or("is_negation").alias("is_negation"))


def statements_to_problems(statements: DataFrame) -> DataFrame:
    """A row for each problem: sums over statements that aren't negations, the first non-empty proof by statement id."""
    own = ~F.coalesce(F.col("is_negation"), F.lit(False))
    first = F.min(F.when(own & (F.col("one_formal_proof") != ""), F.struct("statement_id", "one_formal_proof")))
    return statements.groupBy("uuid").agg(
        F.count("*").alias("n_statements"),
        F.coalesce(F.sum(F.when(own, F.col("n_proofs"))), F.lit(0)).alias("n_proofs"),
        F.coalesce(F.sum(F.when(own, F.col("n_correct_proofs"))), F.lit(0)).alias("n_correct_proofs"),
        F.coalesce(first["one_formal_proof"], F.lit("")).alias("one_formal_proof"),
    )


def aggregate_corpus(problems: DataFrame, statements: DataFrame, proofs: DataFrame) -> DataFrame:
    """Problems with their statements' and proofs' totals."""
    with_proofs = statements.join(proofs_to_statements(proofs), "statement_id")
    return problems.join(statements_to_problems(with_proofs), "uuid").withColumn("solved", F.col("n_correct_proofs") > 0)


def share(flag: Column) -> Column:
    """Mean of a flag; null counts as false."""
    return F.round(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), 6)


def rates(proofs: DataFrame, negation: str = "is_negation") -> DataFrame:
    """Row valid rate, share of problems with a valid proof, and for negations both the ratio of sums and the share of statements."""
    ok, neg = F.coalesce(F.col("is_valid"), F.lit(False)), F.coalesce(F.col(negation), F.lit(False))
    by = proofs.groupBy("uuid", "statement_id", neg.alias("neg")).agg(F.count("*").alias("n"), F.count_if(ok).alias("k"))
    by_uuid = by.groupBy("uuid").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.when(~F.col("neg"), F.col("k")).otherwise(0)).alias("own"), F.sum(F.when(F.col("neg"), F.col("k")).otherwise(0)).alias("neg_k"), F.count_if("neg").alias("neg_n"), F.count_if(F.col("neg") & (F.col("k") > 0)).alias("neg_solved"))
    return by_uuid.agg(
        F.round(F.try_divide(F.sum("k"), F.sum("n")), 6).alias("valid_rate"),
        share(F.col("own") > 0).alias("prove_rate"),
        F.round(F.try_divide(F.sum("neg_k"), F.sum("neg_n")), 6).alias("negative_ratio_of_sums"),
        F.round(F.try_divide(F.sum("neg_solved"), F.sum("neg_n")), 6).alias("negative_share_solved"),
    )


CATEGORIES = ("uuid", "statement", "neg_statement", "proof")


def _category_counts(ok: Column, neg: Column) -> list[Column]:
    return [
        F.count_distinct("uuid").alias("uuid_total"),
        F.count_distinct(F.when(ok & ~neg, F.col("uuid"))).alias("uuid_valid"),
        F.count_distinct(F.when(~neg, F.col("statement_id"))).alias("statement_total"),
        F.count_distinct(F.when(~neg & ok, F.col("statement_id"))).alias("statement_valid"),
        F.count_distinct(F.when(neg, F.col("statement_id"))).alias("neg_statement_total"),
        F.count_distinct(F.when(neg & ok, F.col("statement_id"))).alias("neg_statement_valid"),
        F.count("*").alias("proof_total"),
        F.count_if(ok).alias("proof_valid"),
    ]


def shard_metrics(proofs: DataFrame, shard: Column) -> DataFrame:
    """Per category: valid and total, distinct within each shard and summed over shards."""
    ok, neg = F.coalesce(F.col("is_valid"), F.lit(False)), F.coalesce(F.col("is_negation"), F.lit(False))
    per = proofs.groupBy(shard.alias("shard")).agg(*_category_counts(ok, neg))
    return _as_categories(per.agg(*[F.sum(c).alias(c) for c in per.columns[1:]]))


def global_metrics(proofs: DataFrame) -> DataFrame:
    """Per category: valid and total, distinct over everything."""
    ok, neg = F.coalesce(F.col("is_valid"), F.lit(False)), F.coalesce(F.col("is_negation"), F.lit(False))
    return _as_categories(proofs.agg(*_category_counts(ok, neg)))


def _as_categories(one: DataFrame) -> DataFrame:
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_valid").alias("valid"), F.col(f"{c}_total").alias("total")) for c in CATEGORIES]))
    return one.select(stacked.alias("x")).select("x.*").withColumn("valid_ratio", F.round(F.coalesce(F.try_divide("valid", "total"), F.lit(0.0)), 6))


def proof_records(proofs: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """statement_id, proof_count: valid proofs, added to a stored count."""
    new = proofs.where("is_valid").groupBy("statement_id").agg(F.count("*").alias("proof_count"))
    if store is None:
        return new
    return new.unionByName(store.select("statement_id", "proof_count")).groupBy("statement_id").agg(F.sum("proof_count").alias("proof_count"))


def strict_majority(votes: DataFrame, item: str, vote: str, none: str = "Status not found", split: str = "Inconclusive") -> DataFrame:
    """The vote with over half of an item's parsed votes, else `split`; `none` without a parsed vote."""
    counts = votes.groupBy(item, vote).agg(F.count("*").alias("n"))
    parsed = F.when(F.col(vote).isNotNull(), F.col("n")).otherwise(0)
    best = F.max(F.when(F.col(vote).isNotNull(), F.struct(F.col("n"), F.col(vote).alias("v"))))
    by = counts.groupBy(item).agg(F.sum(parsed).alias("total"), best.alias("b"))
    return by.select(item, F.when(F.col("total") == 0, none).when(2 * F.col("b.n") > F.col("total"), F.col("b.v")).otherwise(split).alias("status"))


def plurality(votes: DataFrame, item: str, vote: str, order: str) -> DataFrame:
    """The most frequent vote; of equals the one that came first."""
    counts = votes.where(F.col(vote).isNotNull()).groupBy(item, vote).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(item).agg(F.max_by(vote, F.struct(F.col("n"), -F.col("first"))).alias("status"), F.max("n").alias("votes"))


def classification_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tp, tn, fp, fn, accuracy, precision, recall, f1 over rows where both are known, and the share of those; a zero denominator gives 0."""
    known = truth.isNotNull() & predicted.isNotNull()
    c = df.agg(F.count("*").alias("n"), *[F.count_if(known & (truth == t) & (predicted == p)).alias(k) for k, t, p in (("tp", True, True), ("tn", False, False), ("fp", False, True), ("fn", True, False))])

    def over(a, b):
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)

    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return c.select("tp", "tn", "fp", "fn", over(tp + tn, tp + tn + fp + fn).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), over(tp + tn + fp + fn, F.col("n")).alias("conclusive"))


def pass_at_n(attempts: DataFrame, n: int, item: str = "statement_id", sample: str = "sample_id", valid: str = "is_valid") -> DataFrame:
    """k, success rate among the first k samples, for k up to n. Samples are ranked by number, repeats of a number share it."""
    first = attempts.groupBy(item).agg(F.min(F.when(F.col(valid), F.col(sample))).alias("first"))
    ks = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")
    return first.select(ks, "first").groupBy("k").agg(F.count("*").alias("items"), F.count_if(F.col("first") <= F.col("k")).alias("passed")).withColumn("pass_rate", F.round(F.col("passed") / F.col("items"), 6))


def status_rollup(events: DataFrame, key: str, status: Column, ranking: tuple[str, ...]) -> DataFrame:
    """Per key the status of highest precedence, then the number of keys for every status, also those without any."""
    rank = F.coalesce(*[F.when(status == s, F.lit(i)) for i, s in enumerate(ranking)], F.lit(len(ranking) - 1))
    best = events.groupBy(key).agg(F.min(rank).alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))
    names = events.sparkSession.createDataFrame([(i, s) for i, s in enumerate(ranking)], "rank int, status string")
    return names.join(best, "rank", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Counts of a value and their share of all rows. The window runs over one row a value."""
    c = df.groupBy(by).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("total"), 6).alias("ratio"))


def unstack_sums(df: DataFrame, by: str, flag: str, values: list[str]) -> DataFrame:
    """Sums of values as columns for false and true; absent ones are 0."""
    wide = df.groupBy(by).pivot(flag, [False, True]).agg(*[F.sum(v).alias(v) for v in values])
    return wide.select(by, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in wide.columns if c != by])


def group_max(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.max(value).over(W.partitionBy(key)))
