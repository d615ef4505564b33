"""Quality classifier by positive-unlabelled learning.

A logistic model over the text's surface and its hashed words is fitted by
minimising the non-negative unbiased risk: prior * R+(positives) + max(0,
R-(unlabelled) - prior * R-(positives)), with trusted positives, unlabelled
documents and an estimated class prior.  Labelled negatives are not used.

The fit uses a bounded sample, drawn by hash: up to ``SAMPLE`` trusted
positives and about as many unlabelled documents.  The prior is estimated from
these: a first model is fitted on half of either, and among the scores of the
other halves the threshold is sought above which the share of unlabelled texts
by that of positives is least, with some slack for few texts; nearly all texts
above it are positives, so that ratio is the prior.  Every whole text is scored.

Defined cases: a null text counts as empty and has a score like any other.  A
document whose label rows disagree is no positive.  A null id is in no fold and
never labelled.  Rows with equal texts have equal scores.  Other columns pass
through the filter and are no inputs.  Without any positive every score is the
prior.  An empty table gives an
empty result; texts of any length are looked at whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, unused
from .simhash import word_hashes

#: Rows of each kind that the model is fitted on, at most; the prior where there
#: are too few to estimate it; standard errors that its bound allows for.
SAMPLE, PRIOR, ENOUGH, SLACK = 12_000, 0.8, 20, 0.35
#: Steps, step size and penalty of the fit; bins of each feature.
STEPS, RATE, PENALTY, BINS = 1200, 0.1, 1e-5, 16
#: Buckets of hashed words, as a power of two; penalty of their weights.
LEXICAL, LEXICAL_PENALTY = 7, 1e-3
#: Words looked at together.
CHUNK = 1 << 16

#: Byte classes whose share in a text is a feature.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n", b" \t", b".", b",", b"!", b"?", b"|", b"#", b"$", b"%", b"&", b"*", b"@", b"<>{}[]()/\\=_", b":;'\"-+~^`", bytes(range(128, 256))]
_CLASS = np.full(256, len(CLASSES))
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _i
SURFACE = len(CLASSES) + 9
N_FEATURES = SURFACE + (1 << LEXICAL)


def features(text: str | None) -> np.ndarray:
    """Of a whole text: shares of byte classes, sizes, repetition; then roots of
    the shares of its hashed words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=count, minlength=len(CLASSES) + 1)[: len(CLASSES)] / max(1, len(raw))
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    # Repetition within pieces of bounded size, so that it doesn't fall with length.
    seen = triples = 0
    words_in = np.zeros(1 << LEXICAL)
    for at in range(0, len(words), CHUNK):
        part = words[at : at + CHUNK]
        words_in += np.bincount((word_hashes([b" ".join(part)])[0] >> np.uint64(64 - LEXICAL)).astype(np.int64), minlength=1 << LEXICAL)
        seen += len(set(part))
        triples += len(set(zip(part, part[1:], part[2:])))
    surface = np.array(
        [
            *share,
            np.log1p(len(words)),
            len(raw) / n,
            seen / n,
            triples / n,
            same / n,
            len(set(lines)) / len(lines),
            np.log1p(len(lines)),
            sum(w.isupper() for w in words) / n,
            sum(not (w[-1:].isalnum() or w[-1] >= 128) for w in words) / n,
        ],
        np.float32,
    )
    return np.concatenate([surface, np.sqrt(words_in / max(1, words_in.sum())).astype(np.float32)])


@dataclass
class Model:
    """Bin edges of each surface feature, a weight for each bin, then for each
    bucket of words; a bias, the prior."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") + k * (BINS + 1) for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        n = len(self.edges) * (BINS + 1)
        z = self.weights[self.binned(x)].sum(1) + x[:, SURFACE:] @ self.weights[n:] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The positive and the negative part of the unbiased logistic risk at these
    logits of positives and unlabelled, and the slopes by each logit of what is
    minimised: where the negative part is below zero, its own slope turned
    round, as in the published method."""
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    positive = prior * float(np.mean(np.logaddexp(0, -zp)))
    negative = float(np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp)))
    gp, gn_p, gn_u = prior * (sp - 1) / len(zp), -prior * sp / len(zp), su / len(zu)
    return (positive, negative, gp + gn_p, gn_u) if negative >= 0 else (positive, negative, -gn_p, -gn_u)


def fit_features(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss; the last
    step with the risk's negative part at zero or above is kept."""
    both = np.concatenate([positive, unlabelled, np.zeros((int(len(positive) + len(unlabelled) == 0), N_FEATURES), np.float32)])
    edges = np.quantile(both[:, :SURFACE], np.arange(1, BINS + 1) / (BINS + 1), axis=0).T.astype(np.float32)
    size = len(edges) * (BINS + 1)
    model = Model(edges, np.zeros(size + (1 << LEXICAL)), float(np.log(prior / (1 - prior))), prior)
    if not len(positive) or not len(unlabelled):
        return model
    p, u = model.binned(positive), model.binned(unlabelled)
    wp, wu = np.ascontiguousarray(positive[:, SURFACE:]), np.ascontiguousarray(unlabelled[:, SURFACE:])

    def slope(bins: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.bincount(bins.ravel(), weights=np.repeat(g, bins.shape[1]), minlength=size)

    theta, m, v = np.append(model.weights, model.bias), 0.0, 0.0
    penalty = np.concatenate([np.full(size, PENALTY), np.full(1 << LEXICAL, LEXICAL_PENALTY), [0]])
    kept = theta
    for step in range(1, steps + 1):
        words = theta[size:-1].astype(np.float32)
        zp, zu = (np.clip(theta[b].sum(1) + w @ words + theta[-1], -30, 30) for b, w in ((p, wp), (u, wu)))
        _, negative, gp, gu = risk(zp, zu, prior)
        if negative >= 0:
            kept = theta
        grad = np.concatenate([slope(p, gp) + slope(u, gu), gp.astype(np.float32) @ wp + gu.astype(np.float32) @ wu, [gp.sum() + gu.sum()]])
        grad += penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights, model.bias = kept[:-1], float(kept[-1])
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from these two alone.

    Of the scores that either half gets from a model of the other, the
    threshold with the least upper bound on unlabelled share by positive share.
    """
    if min(len(positive), len(unlabelled)) < ENOUGH:
        return PRIOR
    models = [fit_features(positive[k::2], unlabelled[k::2], 0.5, STEPS // 4) for k in (1, 0)]
    p, u = (np.sort(np.concatenate([m.score(x[k::2]) for k, m in enumerate(models)])) for x in (positive, unlabelled))
    at = np.unique(np.concatenate([p, u]))
    qp, qu = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    at = qp > 0
    slack = SLACK * (len(u) ** -0.5 + len(p) ** -0.5)
    best = int(np.argmin((qu[at] + slack) / qp[at]))
    return float(min(0.98, max(0.02, qu[at][best] / qp[at][best])))


def held_out(id_: Column) -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def _sampled(df: DataFrame, key: Column, total: int) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, total))))


def feature_rows(texts: DataFrame) -> np.ndarray:
    """Features of a bounded number of texts (column ``text``), on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([features(t.as_py()).tobytes() for t in batch.column(0)], pa.binary())], ["x"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(tidy(run), "x binary").toArrow()["x"].to_pylist()
    return np.frombuffer(b"".join(sorted(rows)), np.float32).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on documents outside the held-out fold and their labels."""
    own = labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id"))
    own = own.agg(F.min(F.col(label_col).cast("int")).alias("good")).where(F.col("good").isNotNull())
    positives = own.where("good = 1").count()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    trusted = _sampled(own.where("good = 1"), F.col("id"), positives).select(F.col("id").alias("trusted"))
    # About SAMPLE ids at most, so they may be broadcast; of rows repeated under
    # one id a text each.
    found = rows.join(F.broadcast(trusted), F.col("id") == F.col("trusted"), "left_semi")
    positive = feature_rows(found.groupBy("id").agg(F.max("text").alias("text")))
    free = rows.where(~held_out(F.col("id")))
    unlabelled = feature_rows(_sampled(free, F.concat(F.lit("u"), F.col("id").cast("string")), rows.count()))
    return fit_features(positive, unlabelled, class_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the score of the whole text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)], np.float32).reshape(-1, N_FEATURES)
            yield pa.record_batch([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more."""
    name = unused(docs, "score")
    model = fit(docs, labels, id_col, text_col)
    return score(docs, model, text_col, name).where(F.col(name) >= least).select(*docs.columns)
