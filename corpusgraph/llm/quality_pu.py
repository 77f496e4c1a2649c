"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows marked good; the unlabelled web text is all
documents, their marks ignored, so it is never empty.  A small network is fitted by minimising the non-negative
unbiased risk

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))

with the logistic loss, so its sigmoid output is a probability of being good.
When the second term falls below zero, its gradient is followed back up, which
is what keeps a flexible model from fitting the unlabelled text as negative.
The class prior, the share of positives in the corpus, is estimated by a first
fit that ranks the positives left out of it and all documents: the least ratio of the
documents' share to the positives' share of the top, with a confidence margin on both, bounds it.
The documents' shares are counts over the scores of all of them, one aggregate.

Fitting uses a bounded sample: at most about ``MAX_POSITIVE`` and
``MAX_UNLABELLED`` rows, drawn by a hash of the id.  Scoring is one map-only
pass over all whole texts.  Only numbers measured on the text enter a score;
marks, language, source and id never do.

Defined cases: null text counts as empty and gets a score like any other;
rows whose id is null are scored and never trained on; a document with several marks counts
as positive only if all of them are; repeated rows are scored once each; without
two trusted positives or two documents, every score is the prior 0.5; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusgraph.llm.batches import values

MAX_POSITIVE, MAX_UNLABELLED = 12_000, 24_000
THRESHOLD = 0.3
FOLDS = 5
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 512, 0.01, 1e-4

_MARKS = b".,;:!?|-'\"()[]{}#*$%&<>=_/\\@+~^`"


# ---------------------------------------------------------------- features
def features(text: str | None) -> np.ndarray:
    """Numbers measured on one whole text."""
    raw = (text or "").encode()
    a = np.frombuffer(raw, np.uint8)
    n = max(1, len(a))
    count = np.bincount(a, minlength=256) / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    k, m = max(1, len(words)), max(1, len(lines))
    pairs = len(set(zip(words, words[1:])))
    used = count[count > 0]
    shares = [
        count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum(),
        count[list(b" \t\n\r\x0b\x0c")].sum(), count[10], count[:32].sum() - count[9:14].sum(),
        *count[list(_MARKS)],
        (a[1:] == a[:-1]).sum() / n,
        sum(map(eq, words, words[1:])) / k,
        1 - len(set(lines)) / m,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / m if lines else 0.0,
    ]
    sizes = [
        np.log1p(len(a)), np.log1p(len(words)), np.log1p(len(lines)),
        sum(map(len, words)) / k, len(words) / m / 50.0,
        len(set(words)) / k, pairs / k,
        np.log1p(len(set(words))) / np.log1p(k), np.log1p(pairs) / np.log1p(k),
        float(-(used * np.log2(used)).sum()),
    ]
    return np.concatenate([np.sqrt(np.maximum(shares, 0)), sizes]).astype(np.float32)


N_FEATURES = len(features(""))


# -------------------------------------------------------------------- model
@dataclass
class Network:
    """One hidden layer; ``logit`` of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x).astype(float), -40, 40)))


def _softplus(z):
    return np.logaddexp(0, z)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_risk(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int = 3,
             epochs: int = EPOCHS) -> Network:
    """Minimise the non-negative risk with Adam over mini-batches that hold
    both samples in their proportion."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (pos, unl))
    d = p.shape[1]
    theta = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(0.0)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    steps, t = max(1, -(-len(u) // BATCH)), 0
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        po, uo = np.resize(rng.permutation(len(p)), steps * max(1, BATCH // 2)), rng.permutation(len(u))
        for s in range(steps):
            t += 1
            xp, xu = p[po[s::steps]], u[uo[s::steps]]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ theta[0] + theta[1])
            z = h @ theta[2] + theta[3]
            zp, zu = z[:len(xp)], z[len(xp):]
            gap = _softplus(zu).mean() - prior * _softplus(zp).mean()
            as_neg = np.concatenate([-prior * _sigmoid(zp) / len(xp), _sigmoid(zu) / len(xu)])
            if gap >= 0:
                g = as_neg
                g[:len(xp)] -= prior * _sigmoid(-zp) / len(xp)
            else:
                g = -as_neg
            gh = np.outer(g, theta[2]) * (1 - h * h)
            grads = [x.T @ gh + DECAY * theta[0], gh.sum(0), h.T @ g + DECAY * theta[2], g.sum()]
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                theta[k] = theta[k] - rate * (first[k] / (1 - 0.9 ** t)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    w1, b1, w2, b2 = theta
    return Network(mean, scale, w1, b1, w2, float(b2))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 3, count_from=None) -> float:
    """Share of positives among the unlabelled rows.

    A model fitted on half of each sample ranks the other halves; with
    ``count_from``, all unlabelled rows instead of the other half of the sample
    (``count_from(model, cuts)``: rows from each cut on, and all rows).  For every
    cut c, share_unl(score >= c) is at least prior * share_pos(score >= c);
    the least ratio over the cuts, taken where its confidence margin is least, estimates the prior."""
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(len(pos)), rng.permutation(len(unl))
    model = fit_risk(pos[p[::2]], unl[u[::2]], 0.5, seed, epochs=max(1, EPOCHS // 3))
    sp = np.sort(model.logit(pos[p[1::2]]))
    cuts = np.unique(sp)
    top_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    if count_from:
        counts, n = count_from(model, cuts)
        top_u = counts / n
    else:
        su, n = np.sort(model.logit(unl[u[1::2]])), len(u[1::2])
        top_u = 1 - np.searchsorted(su, cuts) / n
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(n))
    best = np.argmin((top_u + margin) / top_p)
    return float(np.clip(top_u[best] / top_p[best], 0.05, 0.95))


def fit(pos: np.ndarray, unl: np.ndarray, count_from=None) -> Network | None:
    """The fitted network, or None without both samples."""
    if len(pos) < 2 or len(unl) < 2:
        return None
    return fit_risk(pos, unl, estimate_prior(pos, unl, count_from=count_from))


# -------------------------------------------------------------------- spark
def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _features(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of ``docs(doc_id, text)``."""
    def run(batches):
        for b in batches:
            x = [features(t) for t in values(b, 1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<float>")


def _sample(docs: DataFrame, bound: int) -> np.ndarray:
    """Features of about ``bound`` rows at most, drawn by a hash of the id."""
    n = docs.count()
    if n > bound:
        docs = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
                          < int((1 << 30) * bound / n))
    rows = _features(docs).orderBy("doc_id").toPandas()
    return np.array(rows["x"].tolist(), float).reshape(-1, N_FEATURES)


def _counter(docs: DataFrame):
    """``count_from`` of ``estimate_prior`` over all rows of ``docs(doc_id, text)``."""
    def count_from(model: Network, cuts: np.ndarray) -> tuple[np.ndarray, int]:
        def run(batches):
            counts = np.zeros(len(cuts) + 1, int)
            for b in batches:
                x = np.array([features(t) for t in values(b, 0)]).reshape(-1, N_FEATURES)
                counts += np.bincount(np.searchsorted(cuts, model.logit(x), "right"),
                                      minlength=len(counts))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                                             ["at", "n"])

        rows = (docs.select("text").mapInArrow(run, "at long, n long")
                .groupBy("at").agg(F.sum("n").alias("n")).collect())
        counts = np.zeros(len(cuts) + 1, int)
        for r in rows:
            counts[r["at"]] = r["n"]
        return counts[::-1].cumsum()[::-1][1:], counts.sum()

    return count_from


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> Network | None:
    """Fit on ``documents`` and ``labels(doc_id, quality)``; labels of held-out
    ids are never read."""
    pair = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc_id"), "quality"))
    good = (marked.where(fold_of(F.col("doc_id")) != 0).groupBy("doc_id")
            .agg(F.min("quality").alias("q")).where("q = 1").select("doc_id"))
    pos = pair.join(good, "doc_id", "left_semi")
    unl = pair.where(F.col("doc_id").isNotNull())
    return fit(_sample(pos, max_positive), _sample(unl, max_unlabelled), _counter(unl))


def score(docs: DataFrame, model: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per document."""
    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in values(b, 1)]).reshape(-1, N_FEATURES)
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, model: Network | None,
                   threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores at least ``threshold``, in one pass."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in values(b, at)]).reshape(-1, N_FEATURES)
            good = model.score(x) >= threshold if model else np.full(len(x), 0.5 >= threshold)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train and score in one call."""
    return score(docs, train(docs, labels), threshold)
