"""Boundaries to services: generators, verifiers, judges, embedders, local models. Each is a plain callable over a
batch, called inside mapInPandas. Input and replies are written to the shared folder, so that neither a second action
nor a stage that is lost later pays for the same calls again; a task that is lost before it has written repeats its
own. Failed calls are tried again with growing pauses, and then item by item. The stubs are deterministic."""

from __future__ import annotations

import hashlib
import heapq
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.feedback import reply_flags
from .stored import stored

Batch = Callable[[list[str]], list[str]]
#: Attempts of a call, seconds before the second (doubled for each further one), and single items that fail in a row before the service counts as down.
TRIES, PAUSE, DOWN = 3, 0.25, 3


def persistent(call: Callable[[list], list], items: list, tries: int = TRIES, pause: float = PAUSE) -> list[tuple[object, str | None]]:
    """(reply, error) of every item: the whole batch is tried, then each item on its own, so that one bad item costs no other its reply. A reply of the wrong length is a failure."""

    def attempt(some: list):
        for k in range(tries):
            try:
                got = list(call(some))
                if len(got) == len(some):
                    return got, None
                error = f"{len(got)} replies to {len(some)} items"
            except Exception as e:  # the service's failure is data
                error = str(e) or type(e).__name__
            if k + 1 < tries:
                time.sleep(pause * 2**k)
        return None, error

    if not items:
        return []
    got, error = attempt(items)
    if got is not None:
        return [(x, None) for x in got]
    if len(items) == 1:
        return [(None, error)]
    out: list[tuple[object, str | None]] = []
    for i, item in enumerate(items):
        if i == DOWN and all(x[1] for x in out):
            return out + [(None, error)] * (len(items) - DOWN)
        one, failed = attempt([item])
        out.append((None, failed) if one is None else (one[0], None))
    return out


def digest(*parts: object) -> int:
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:8], "big")


def stub_generator(prompts: list[str], samples: int = 1) -> list[list[str]]:
    return [[f"proof {digest(p, i) % 1000} of {p[:20]}" for i in range(samples)] for p in prompts]


def stub_verifier(proofs: list[str]) -> list[str]:
    """Replies in the checker's JSON form: a third errors, a ninth sorry warnings."""
    out = []
    for p in proofs:
        k = digest("verify", p) % 9
        messages = [{"severity": "error", "data": "failed"}] if k < 3 else [{"severity": "warning", "data": "declaration uses 'sorry'"}] if k == 3 else []
        out.append(json.dumps({"error": None, "response": {"env": 0, "messages": messages}}))
    return out


def stub_judge(texts: list[str], vote: int = 0) -> list[str]:
    return [f"Status: {'Correct' if digest('judge', t, vote) % 3 else 'Incorrect'}" for t in texts]


def stub_embedder(texts: list[str], width: int = 8) -> list[list[float]]:
    return [[(digest(t, i) % 2001 - 1000) / 1000 for i in range(width)] for t in texts]


def generate(df: DataFrame, prompt: str, samples: int, model: Callable[[list[str], int], list[list[str]]] = stub_generator) -> DataFrame:
    """df with completions (array) and error; an item that fails for good gives an error row, never none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = persistent(lambda items: model(items, samples), pdf[prompt].fillna("").tolist())
            yield pdf.assign(completions=pd.Series([x for x, _ in got], index=pdf.index, dtype=object), error=pd.Series([e for _, e in got], index=pdf.index, dtype=object))

    out = StructType([*df.schema.fields]).add("completions", ArrayType(StringType())).add("error", StringType())
    return stored(stored(df).mapInPandas(run, out))


def explode_completions(df: DataFrame, key: str, proof: str = "formal_proof") -> DataFrame:
    """A row for each completion, or an error row; proof_id is the key and the place."""
    e = df.select("*", F.posexplode_outer("completions").alias("_i", proof)).drop("completions")
    return e.withColumn("proof_id", F.concat_ws("_", F.col(key).cast("string"), F.coalesce("_i", F.lit(0)).cast("string"))).drop("_i")


def verify(df: DataFrame, proof: str, verifier: Batch = stub_verifier, lost: str = '{"error":"lost","response":null}') -> DataFrame:
    """df with lean_feedback and its flags. Null proofs and lost replies are errors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf[proof].notna()
            replies = pd.Series(lost, index=pdf.index, dtype=object)
            replies[known] = [json.dumps({"error": e, "response": None}) if e else x for x, e in persistent(verifier, pdf.loc[known, proof].tolist())]
            yield pdf.assign(lean_feedback=replies)

    fields = [f for f in df.schema.fields if f.name != "lean_feedback"]
    out = stored(stored(df.select(*[f.name for f in fields])).mapInPandas(run, StructType(fields).add("lean_feedback", StringType())))
    return out.withColumn("_f", reply_flags(F.col("lean_feedback"))).select(*out.columns, "_f.*")


def votes(df: DataFrame, text: str, n: int, judge: Callable[[list[str], int], list[str]] = stub_judge) -> DataFrame:
    """n replies for each row, as rows (columns vote, reply)."""
    fanned = df.withColumn("vote", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = pd.Series("", index=pdf.index, dtype=object)
            for v, part in pdf.groupby("vote"):
                replies[part.index] = [x or "" for x, _ in persistent(lambda items, v=v: judge(items, int(v)), part[text].fillna("").tolist())]
            yield pdf.assign(reply=replies)

    return stored(stored(fanned).mapInPandas(run, StructType([*fanned.schema.fields]).add("reply", StringType())))


def stub_model() -> Callable[[list[str]], list[str]]:
    """What load of infer gives: a function of a batch."""
    return lambda texts: [f"theorem t{digest('model', t) % 10_000} : True" for t in texts]


def infer(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[str]]] = stub_model, batch: int = 8, prompt: str = "{}") -> DataFrame:
    """df with output and error: a local model over batches of equal size. load runs once in a Python worker's task, not once a batch. Null texts have null outputs and reach no model; a batch that fails is tried item by item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            known = pdf[text].notna()
            prompts = [prompt.format(t) for t in pdf.loc[known, text]]
            got: list[tuple[object, str | None]] = []
            for i in range(0, len(prompts), batch):
                model = model or load()
                got += persistent(model, prompts[i : i + batch])
            out = pd.DataFrame({"output": None, "error": None}, index=pdf.index, dtype=object)
            out.loc[known, "output"], out.loc[known, "error"] = [x for x, _ in got], [e for _, e in got]
            yield pdf.assign(output=out["output"], error=out["error"])

    return stored(stored(df).mapInPandas(run, StructType([*df.schema.fields]).add("output", StringType()).add("error", StringType())))


def cached(df: DataFrame, store: str, key: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Call only for keys that the store doesn't have, append the answers, and read all from the store."""
    from ..sources.sinks import pending

    call(pending(df, store, key)).write.mode("append").parquet(store)
    return df.sparkSession.read.parquet(store).join(df.select(key).distinct(), key, "left_semi")


SEARCHED = "theorem string, id string, parent string, tactic string, logprob double, status string, expanded int"


def stub_policy(state: str, width: int = 3) -> list[tuple[str, float]]:
    return [(f"t{digest(state, i) % 50}", -0.1 - digest(state, i, "p") % 100 / 50) for i in range(width)]


def stub_environment(state: str, tactic: str) -> tuple[str, str]:
    """(new state, status): proved, failed or open."""
    k = digest(state, tactic, "env") % 10
    return f"{state}/{tactic}", "proved" if k == 0 else "failed" if k < 4 else "open"


def best_first(theorem: str, expansions: int = 20, policy=stub_policy, environment=stub_environment) -> list[tuple]:
    """Best-first search by summed log-probability; equal states of one node merge, the search ends with a proof."""
    rows = [(theorem, "0", None, None, 0.0, "open", 0)]
    heap, n = [(0.0, 0, "0", theorem)], 0
    while heap and n < expansions:
        cost, _, node, state = heapq.heappop(heap)
        n += 1
        children: dict[tuple[str, str], tuple[float, str]] = {}
        for tactic, lp in policy(state):
            key = environment(state, tactic)
            if key not in children or lp > children[key][0]:
                children[key] = (lp, tactic)
        for (new, status), (lp, tactic) in children.items():
            child = str(len(rows))
            rows.append((theorem, child, node, tactic, -cost + lp, status, n))
            if status == "proved":
                return rows
            if status == "open":
                heapq.heappush(heap, (cost - lp, len(rows), child, new))
    return rows


def search(theorems: DataFrame, column: str, expansions: int = 20, policy=stub_policy, environment=stub_environment) -> DataFrame:
    """Search trees as rows (SEARCHED), a theorem a unit of work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SEARCHED.split(", ")]
        for pdf in batches:
            for i in range(0, len(pdf), 500):  # a tree has many rows
                yield pd.DataFrame([r for t in pdf[column].iloc[i : i + 500] for r in best_first(t, expansions, policy, environment)], columns=names)

    return theorems.select(column).mapInPandas(run, SEARCHED)
