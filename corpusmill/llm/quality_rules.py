"""Text-statistics rules whose cutoffs are chosen under a certified limit on false rejection.

Good labelled documents are parted by a hash of their id into a design half and a holdout. The design half sets, for
each stratum and rule, the largest value of a good document; the policies are nested: in each of LEVELS all rules
of a stratum reject above that value times the level's factor (or above the rule's floor, if that is more). The
holdout certifies: the exact (Clopper-Pearson) upper bound on the share of good documents that a policy's rules
reject together must be at most RISK. Policies are tested from the laxest on until one fails (fixed sequence, which
needs no correction within a stratum); the confidence is corrected for the strata (Bonferroni). The strictest
certified policy is taken; without one only the base rules reject.

A stratum is a language, or a pool of languages: with T strata a holdout of ln(error / T) / ln(1 - RISK) good documents
is needed to certify anything. T is the largest number for which the T - 1 largest languages have as many each and
the others have as many together. That looks at the numbers of good documents alone, never at what is rejected.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, persisted

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = "#*$%&|<>"
RISK, CONFIDENCE = 0.02, 0.95
#: Rule (a document is rejected above its cutoff): the least cutoff. Factors of the design half's largest value, the laxest policy first.
FLOORS = {"symbols_a_word": 0.05, "dup_lines_a_line": 0.05, "repeats_a_word": 0.025, "chars_a_word": 5.0}
LEVELS = (2.0, 1.75, 1.5, 1.25, 1.1, 1.0)
#: Languages among the labelled good documents; more are refused.
MOST_LANGUAGES = 10_000
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, lang string"


def text_statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the number of lines with a word."""
    words = WORDS(text)
    n = len(words)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(triples)) < len(triples):
        times = Counter(triples)
        end = 0  # words before this place are counted
        for i, t in enumerate(triples):
            if times[t] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    lines = [x for x in text.split("\n") if WORDS(x)] if "\n" in text else [text] * bool(n)
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


def statistics(docs: DataFrame) -> DataFrame:
    """STATS of every row, from whole texts; a null text has no words. No shuffle."""

    def run(batches):
        for b in batches:
            cols = list(zip(*(text_statistics(t or "") for t in b.column(1).to_pylist()), strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols), b.column(2)], [x.split()[0] for x in STATS.split(", ")])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lang.alias("lang")).mapInArrow(lean(run), STATS)


def metric(name: str) -> Column:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {"symbols_a_word": F.col("n_symbols") / words, "dup_lines_a_line": F.col("n_dup_lines") / lines, "repeats_a_word": F.col("n_repeat_words") / words, "chars_a_word": F.col("word_chars") / words}[name]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_upper(k: int, n: int, error: float) -> float:
    """Exact upper confidence bound: the p at which k or fewer of n has probability `error`."""
    if n == 0 or k >= n:
        return 1.0

    def below(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0 - 1e-12
    low = max(low, 1e-15)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) > error else (low, mid)
    return high


def least_holdout(risk: float, error: float) -> int:
    """Good documents that a holdout needs, if none of them is rejected, for a bound of at most risk."""
    return math.ceil(math.log(error) / math.log1p(-risk))


def strata(holdout: dict[str | None, int], risk: float = RISK, error: float = 1 - CONFIDENCE) -> list[list[str | None]]:
    """Languages, each with its number of good documents in the holdout, to strata; none if all together are too few."""
    order = sorted(holdout, key=lambda x: (-holdout[x], x is None, x or ""))
    for n in range(len(order), 0, -1):
        least = least_holdout(risk, error / n)
        if all(holdout[x] >= least for x in order[: n - 1]) and sum(holdout[x] for x in order[n - 1 :]) >= least:
            return [*([x] for x in order[: n - 1]), order[n - 1 :]]
    return []


def good_documents(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """STATS of documents that all their labels call good and that pass the base rules, once for each id, with `held`: whether they are in the holdout."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    own = stats.join(known, "doc_id", "left_semi").where(~base_failed())
    once = own.groupBy("doc_id").agg(F.min(F.struct(*own.columns[1:])).alias("r")).select("doc_id", "r.*")
    return once.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)


def certified_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE, levels: tuple[float, ...] = LEVELS) -> dict[str | None, dict[str, float]]:
    """Language: cutoff of each rule. To the driver come one row of maxima a language (more than MOST_LANGUAGES are refused) and one row of counts a stratum."""
    spark = stats.sparkSession
    good = persisted(good_documents(stats, labels))
    rows = good.groupBy("lang").agg(F.count_if("held").alias("n"), *[F.max(F.when(~F.col("held"), metric(m))).alias(m) for m in FLOORS]).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    parts = strata({r["lang"]: r["n"] for r in rows}, risk, 1 - confidence)
    largest = {r["lang"]: r for r in rows}
    cutoffs = [[{m: max(floor, f * max((largest[x][m] for x in part if largest[x][m] is not None), default=math.inf)) for m, floor in FLOORS.items()} for f in levels] for part in parts]
    table = [(x, k, [[c[m] for m in FLOORS] for c in cutoffs[k]]) for k, part in enumerate(parts) for x in part]
    if not table:
        return {}
    of = F.broadcast(spark.createDataFrame(table, "own string, stratum int, cutoffs array<array<double>>"))
    held = good.where("held").join(of, F.col("lang").eqNullSafe(F.col("own")))
    rejected = [F.count_if(F.array_max(F.array(*[metric(m) > F.col("cutoffs")[k][j] for j, m in enumerate(FLOORS)]))).alias(f"k{k}") for k in range(len(levels))]
    counts = {r["stratum"]: r for r in held.groupBy("stratum").agg(F.count("*").alias("n"), *rejected).collect()}
    error, out = (1 - confidence) / len(parts), {}
    for k, part in enumerate(parts):
        chosen = None
        for j in range(len(levels)):
            if binomial_upper(counts[k][f"k{j}"], counts[k]["n"], error) > risk:
                break
            chosen = cutoffs[k][j]
        if chosen:
            out |= dict.fromkeys(part, chosen)
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the failing rules of every row of docs (doc_id, text, lang).

    Null text: no words, so base_failed. Null doc_id: never labelled, judged like any other. A null lang, or no such
    column, is a language like any other. Repeated rows give a row each (and count once among the labelled). Empty
    tables: empty result; without labels, or in a language without certified cutoffs, only the base rules reject.
    The statistics of whole texts are written once and read twice.
    """
    stats = persisted(statistics(docs))
    chosen = certified_cutoffs(stats, labels, risk, confidence)
    table = docs.sparkSession.createDataFrame([(x, *(c[m] for m in FLOORS)) for x, c in chosen.items()], "own string, " + ", ".join(f"cut_{m} double" for m in FLOORS))
    joined = stats.join(F.broadcast(table), F.col("lang").eqNullSafe(F.col("own")), "left")  # at most MOST_LANGUAGES rows
    fails = F.array_compact(F.array(*[F.when(metric(m) > F.col(f"cut_{m}"), F.lit(m)) for m in FLOORS]))
    judged = joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", fails)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
