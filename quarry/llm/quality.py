"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all it sees; labels that say a text is bad are not used. The
class prior is estimated from the two by best-bin estimation. A logistic model minimises the non-negative
unbiased risk: the positives' risk weighted by the prior, plus the unlabelled rows' risk as negatives less
what the positives contribute to it, which is never let below zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read, ship, texts_of
from quarry.llm.words import word_blocks

FOLDS = 5
THRESHOLD = 0.3
SAMPLE = 40_000  # unlabelled rows, about, that the model is fitted to, and half as many positives; all else reads all rows
DECAYS = (1e-5, 1e-4, 1e-3, 1e-2)  # of which the one of least risk on the other half of the training rows is taken
ROUNDS = 60
STEPS = 600
CHOOSING = 10_000  # unlabelled rows, about, on which the decay is chosen
SEED = 7

_SYMBOLS = b"#$%&*|<>{}[]\\^~=_@/+"
_CLASS = np.zeros(256, dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        0 if _b == 10 else 1 if _b in b" \t\r\x0b\x0c" else 2 if "a" <= _c <= "z" else 3 if "A" <= _c <= "Z"
        else 4 if "0" <= _c <= "9" else 5 if _b >= 128 else 6 if _b in b".,;:" else 7 if _b in b"!?" else 8 if _b in b"'\"()-"
        else 9 if _b in _SYMBOLS else 10
    )
FEATURES = 26


def features(text: bytes | None) -> np.ndarray:
    """Numbers that describe a whole text in any language: shares of character classes, lengths and
    variety of words and lines, how often words end in symbols or follow themselves. None of them is a label, a source, a
    language or an id. An empty text has zeros, and a one in the last place."""
    out = np.zeros(FEATURES, dtype=np.float64)
    if not text or not text.strip():
        out[-1] = 1
        return out
    counts = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=11)
    out[:11] = counts / len(text)
    n = total = square = shouting = tailed = alone = ended = again = 0
    seen: set[bytes] = set()
    for words in word_blocks(text):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, total, square = n + len(words), total + int(lengths.sum()), square + int((lengths**2).sum())
        shouting += sum(map(bytes.isupper, words))
        last = np.fromiter((w[-1] for w in words), np.int64, len(words))
        kinds = _CLASS[last]
        tailed += int((kinds == 9).sum() + (kinds == 7).sum())
        alone += int(((lengths == 1) & (kinds == 9)).sum())
        ended += int((kinds == 6).sum())
        again += sum(map(bytes.__eq__, words, words[1:]))
        seen.update(words)
    lines = text.split(b"\n")
    mean = total / n
    out[11:25] = (
        np.log1p(len(text)) / 10, np.log1p(n) / 10, mean / 10, np.sqrt(max(0.0, square / n - mean * mean)) / 10, len(seen) / n, shouting / n,
        tailed / n, alone / n, ended / n, len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)) / 10, counts[3] / max(1, counts[2] + counts[3]), counts[9] / n, again / n,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _soft(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The non-negative risk of logistic weights, and the part of it (negatives) that is held at zero."""
    zp, zu = p @ w, u @ w
    as_negative = _soft(zu).mean() - prior * _soft(zp).mean()
    return float(prior * _soft(-zp).mean() + max(0.0, as_negative)), float(as_negative)


def newton(u: np.ndarray, target: np.ndarray, decay: float, weight: np.ndarray | None = None, start: float = 0.0) -> np.ndarray:
    """Weights that minimise the mean of softplus(u w) less target . w, by Newton's method with halved steps."""
    weight = np.full(len(u), 1 / len(u)) if weight is None else weight
    w, held = np.zeros(u.shape[1]), np.full(u.shape[1], decay)
    w[-1], held[-1] = start, 1e-9
    value = lambda w: weight @ _soft(u @ w) - target @ w + 0.5 * (held * w) @ w
    now = value(w)
    for _ in range(ROUNDS):
        s = _sigmoid(u @ w)
        slope = u.T @ (weight * s) - target + held * w
        step = np.linalg.solve((u.T * (weight * s * (1 - s))) @ u + np.diag(held + 1e-9), slope)
        for _ in range(30):
            if (after := value(w - step)) <= now:
                break
            step = step / 2
        if now - after < 1e-10:
            break
        w, now = w - step, after
    return w


def minimised(p: np.ndarray, u: np.ndarray, prior: float, decay: float) -> np.ndarray:
    """Weights of least non-negative risk. With logistic loss the unbiased risk is convex; where the part of the
    negatives isn't below zero at its minimum, that is the minimum of the non-negative risk too. Where it is
    (the unbiased risk may then have no minimum), small steps lead from the start to where that part would fall
    below zero, and back whenever it does."""
    start = float(np.log(prior / (1 - prior)))
    w = newton(u, prior * p.mean(axis=0), decay, start=start)
    if risk(w, p, u, prior)[1] >= 0:
        return w
    w, m, v = np.append(np.zeros(len(w) - 1), start), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        zp, zu = p @ w, u @ w
        slope = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        g = -slope if _soft(zu).mean() < prior * _soft(zp).mean() else slope - prior * (p.T @ _sigmoid(-zp)) / len(p)
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among the unlabelled rows by best-bin estimation (Garg and others, 2021).

    A classifier tells positives from unlabelled rows on one half; on the other half the share of unlabelled
    rows above a score, over that of positives, bounds the prior from above wherever the score is cut; the
    cut is the one with the least upper confidence bound. Both halves take turns.
    """
    found = []
    for a, b in ((0, 1), (1, 0)):
        pa, ua, pb, ub = p[a::2], u[a::2], p[b::2], u[b::2]
        if not (len(pa) and len(ua) and len(pb) and len(ub)):
            return 0.5
        x, weight = np.vstack([pa, ua]), np.concatenate([np.full(len(pa), 0.5 / len(pa)), np.full(len(ua), 0.5 / len(ua))])
        w = newton(x, 0.5 * pa.mean(axis=0), 1e-3, weight)
        cuts, su = np.sort(pb @ w), np.sort(ub @ w)
        share_p = 1 - np.arange(len(cuts)) / len(cuts)
        share_u = 1 - np.searchsorted(su, cuts) / len(su)
        slack = np.sqrt(np.log(4 / delta) / 2 / len(su)) + np.sqrt(np.log(4 / delta) / 2 / len(cuts))
        at = int(np.argmin((share_u + (1 + gamma) * slack) / share_p))
        found.append(share_u[at] / share_p[at])
    return float(min(0.98, max(0.02, np.mean(found))))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """The model of least non-negative risk; without a prior it is estimated. The decay is the one whose risk
    on the half that it isn't fitted to is least, both halves in turn; no label of a held-out row takes part."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    prior = class_prior(p, u) if prior is None else prior

    part = max(1, len(u) // CHOOSING)
    p1, u1 = p[::part], u[::part]

    def elsewhere(decay: float) -> float:
        halves = ((0, 1), (1, 0)) if min(len(p1), len(u1)) > 1 else ((0, 0),)
        return sum(risk(minimised(p1[a::2], u1[a::2], prior, decay), p1[b::2], u1[b::2], prior)[0] for a, b in halves)

    w = minimised(p, u, prior, min(DECAYS, key=elsewhere))
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id):
    """True for the fold that nothing is learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _features_column(text):
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            x = [features(t) for part in texts_of(a) for t in part]
            yield pa.array(x, pa.list_(pa.float64()))

    return run(text)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to about ``sample`` unlabelled training rows of ``docs`` and half as many trusted positives.

    A document is a trusted positive if most of its labels are 1. Unlabelled rows are chosen by a hash of id
    and text, positives by one of their id; rows equal in both count once, so that neither a hot id nor a hot
    text can flood the sample. Positives are among the unlabelled rows as often as elsewhere. Labels without
    an id or a quality are ignored. Without positives the sampled text itself stands for them, so that every
    score is near the prior.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").alias("q"))
    known = materialize(known.where(~held_out(F.col("id")) & (F.col("q") > 0.5)).select("id"), "positives")
    parts = 1 << 20

    def few(n: int, most: int, *by):
        return F.pmod(F.xxhash64(F.lit(SEED), *by), F.lit(parts)) < max(1, min(parts, round(parts * most / max(1, n))))

    trusted = known.where(few(known.count(), sample // 2, F.col("id"))).withColumn("positive", F.lit(True))
    mark = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").alias("id"), "text", mark.alias("mark"), few(docs.select("doc_id").count(), sample, F.col("doc_id"), mark).alias("plain")).where(~held_out(F.col("id")))
    # the ids of the trusted rows are bounded by the sample, so texts aren't shuffled to meet them
    rows = rows.join(F.broadcast(trusted), "id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))).where("plain or positive")
    rows = rows.select("id", "mark", "plain", "positive", _features_column(F.col("text")).alias("x"))
    table = rows.groupBy("id", "mark").agg(F.first("plain").alias("plain"), F.first("positive").alias("positive"), F.first("x").alias("x")).select("plain", "positive", "x").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if table.num_rows else np.zeros((1, FEATURES))
    plain, positive = (np.array(table.column(c).to_pylist() or [True], dtype=bool) for c in ("plain", "positive"))
    if not plain.any():
        plain[:] = True
    if not positive.any():
        positive = plain
    order = np.lexsort(x.T)  # the result doesn't depend on the order in which rows arrive
    order = order[np.random.default_rng(SEED).permutation(len(order))]  # the halves are alike
    return fit(x[order][positive[order]], x[order][plain[order]])


def score_column(text, model: Model):
    """Score from 0 to 1 of each whole text (double); a null text counts as empty."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            x = [features(t) for part in texts_of(a) for t in part]
            yield pa.array(model(np.array(x)) if x else np.empty(0), pa.float64())

    return run(text)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``score``: how likely the quality label of each row is 1, for every whole text.

    Nothing is learnt from the held-out fold. Rows of equal text have equal scores; null and empty texts
    have one too. A column ``score`` of ``docs`` is replaced, all others are kept.
    """
    return docs.withColumn("score", score_column(F.col("text"), train(docs, labels, sample)))


def op7_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents.

    Null and empty texts are scored like any other, whole texts count, repeated rows each give a row, rows
    without an id are not held out, an empty table gives none, and other columns are ignored.
    """
    out = score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
