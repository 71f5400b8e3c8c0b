"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

Every word has a sparse ternary index vector that follows from its hash. A word's context vector is the sum of the
index vectors of its neighbours over the fitting sample. A document is the mean of its words' context vectors
beside the mean of their index vectors. A network with one hidden layer, trained in numpy, gives a logit; a
temperature fitted on rows kept out of the training turns it into a probability.

Bounds (parameters): the sample has at most FIT_ROWS labelled rows of at most FIT_CHARS characters each, and words
share BUCKETS hashed places, so the model is a fixed few megabytes whatever the corpus holds.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

FIT_ROWS, FIT_CHARS = 6_000, 20_000
BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 48, 6, 2
HIDDEN, EPOCHS, THRESHOLD = 32, 60, 0.7
MEMO_WORDS = 300_000

TOKENS = re.compile(r"\w+|[^\w\s]+").findall
#: Marks that accompany each token: its shape, or that the same token stood among the NEAR before it.
MARKS = ("upper", "title", "lower", "number", "other", "again")
NEAR = 4


def shape(token: str) -> int:
    """A token's shape as a number of MARKS, so that unseen words still say something."""
    if token[0].isalpha():
        return 0 if len(token) > 1 and token.isupper() else 1 if token[0].isupper() else 2
    return 3 if token[0].isdigit() else 4


class Words:
    """Tokens to bucket numbers, with a bounded memo."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def _new(self, token: str) -> int:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        out = self.memo[token] = (zlib.crc32(token.lower().encode("utf-8", "replace")) % BUCKETS) * 8 + shape(token)
        return out

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Each token's bucket, and how many tokens have each mark. A token can be marked as again and by its shape."""
        look, new = self.memo.get, self._new
        both = np.array([look(t) or new(t) for t in TOKENS(text)], np.int64)
        again = np.zeros(len(both), bool)
        for o in range(1, NEAR + 1):
            again[o:] |= both[o:] == both[:-o]
        again &= (both & 7) != 4
        marks = np.bincount(both & 7, minlength=len(MARKS)).astype(np.float64)
        marks[5] = again.sum()
        return both >> 3, marks


def index_vectors() -> np.ndarray:
    """[BUCKETS + marks, DIM] sparse ternary vectors that depend on the place alone."""
    rng = np.random.default_rng(20_240)
    out = np.zeros((BUCKETS + len(MARKS), DIM), np.float32)
    places = np.argsort(rng.random(out.shape), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice([-1.0, 1.0], places.shape).astype(np.float32), 1)
    return out


@dataclass
class Model:
    vectors: np.ndarray  # [BUCKETS, 2 * DIM]: context beside index
    marks: np.ndarray  # [marks, DIM]: index vectors of the marks
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pool(self, ids: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The mean of the words' vectors beside the mean of the marks'; zeros without words. In blocks, so that long texts need no more memory."""
        words, marks = ids
        n = max(1, len(words))
        total = np.zeros(self.vectors.shape[1])
        for i in range(0, len(words), 4096):
            total += self.vectors[words[i : i + 4096]].sum(0, dtype=np.float64)
        return np.concatenate([total, marks @ self.marks, marks]) / n

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(texts: list[str], labels: np.ndarray, validation: np.ndarray) -> Model:
    """Train on rows outside `validation`, set the temperature on rows in it."""
    words = Words()
    ids = [words.ids(t) for t in texts]
    index = index_vectors()
    context = np.zeros((BUCKETS, DIM))
    pairs = [(d[0][:-o], d[0][o:]) for d in ids for o in range(1, WINDOW + 1) if len(d[0]) > o]
    if pairs:
        left, right = (np.concatenate(p) for p in zip(*pairs, strict=True))
        pair, times = np.unique(left * BUCKETS + right, return_counts=True)
        left, right = pair // BUCKETS, pair % BUCKETS
        for k in range(DIM):
            context[:, k] = np.bincount(left, times * index[right, k], BUCKETS) + np.bincount(right, times * index[left, k], BUCKETS)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1)
    width = 3 * DIM + len(MARKS)
    model = Model(np.concatenate([context, index[:BUCKETS]], 1).astype(np.float32), index[BUCKETS:].astype(np.float64), np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    if not len(texts):
        return model
    x, y = np.stack([model.pool(d) for d in ids]), labels.astype(np.float64)
    rng = np.random.default_rng(7)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    model.w1, model.w2 = rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.b2 = float(np.log(rate / (1 - rate)))
    z = (x - model.mean) / model.scale
    rows = np.flatnonzero(~validation) if (~validation).any() else np.arange(len(y))
    weights = np.array([0.5 / max(1e-9, 1 - rate), 0.5 / rate])[y.astype(int)] ** 0.5
    params = [model.w1, model.b1, model.w2, np.array([model.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            zb, yb, wb = z[batch], y[batch], weights[batch]
            h = np.maximum(zb @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60)))
            g = wb * (p - yb) / len(batch)
            gh = np.outer(g, params[2]) * (h > 0)
            step += 1
            for k, grad in enumerate((zb.T @ gh + 1e-4 * params[0], gh.sum(0), h.T @ g + 1e-4 * params[2], np.array([g.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                params[k] -= 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = params[0], params[1], params[2], float(params[3][0])
    held = np.flatnonzero(validation)
    if len(held) > 20 and 0 < y[held].mean() < 1:
        logit = model.logits(x[held])
        loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logit / t))
        model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """Fit on at most fit_rows labelled documents (in order of a hash of the id) of folds 0, 1 and 3, of at most fit_chars characters each. Fold 1 sets the temperature.

    Documents whose labels disagree aren't used. Of rows that repeat an id the one with the least text is taken, by an
    aggregation, so that no more than fit_rows rows come to the driver.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.where("quality = most").drop("most")
    own = docs.select("doc_id", "text").where((fold(F.col("doc_id")) != 2) & (F.length("text") <= fit_chars))
    chosen = own.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    rows = rows.select("text", "quality", (fold(F.col("doc_id")) == 1).alias("v"), "doc_id").toPandas().sort_values("doc_id", kind="stable")
    return fit(rows["text"].tolist(), rows["quality"].to_numpy(np.int64), rows["v"].to_numpy(bool))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), from whole texts.

    Null and wordless texts: scored as the vector of no words. Null doc_id: not held out, never used for fitting.
    Repeated rows are scored each. Without labels every score is 0.5. An empty table gives an empty result. The
    model, a fixed few megabytes, is broadcast; scoring is one narrow stage.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        model, words = sent.value, Words()
        for b in batches:
            x = np.stack([model.pool(words.ids(t or "")) for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, len(model.mean)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores below threshold; columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        model, words = sent.value, Words()
        for b in batches:
            if b.num_rows:
                x = np.stack([model.pool(words.ids(t or "")) for t in b.column("text").to_pylist()])
                yield b.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)
