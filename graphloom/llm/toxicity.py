"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= j) = logistic(theta_j - w.x): one vector w serves all ordered thresholds theta, and the
expected severity is the sum of grades by probability. Features are words (runs of letters, digits and
bytes above 127, A-Z lower-cased) and their prefixes of 4, 5, 6 and 8 bytes, present or not.

The labels say only whether a document is toxic. Of those that are, the ones whose share of features
that favour toxicity is above the median have grade 2, the others grade 1; documents that are not have
grade 0. The model is fit on at most `bound` labelled documents of either kind (those of the least
hashes of their ids, of ids that documents have) and at most FEATURES features of those that are associated with the label; scoring
reads every whole text.

Defined cases: labels without id or value take no part, and several of one id count as toxic where one
does; without labels of both kinds every severity is 0 and nothing is rejected; null and empty texts
have no features; rows that repeat are scored alike, and one of them is used to fit, of several texts of an id the least; an empty table
gives an empty one; further columns are kept by `keep_clean` and ignored by `score`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batches, text_buffer, tune, words

BOUND = 4000
FEATURES = 2048
PREFIXES = (4, 5, 6, 8)
#: Standard errors by which a feature's share in toxic documents must exceed that in others, and times as much as it must be.
ASSOCIATED, TIMES = 4.0, 8.0
#: Share of toxic documents that must have a feature, so that what a few copies share is no sign.
RARE = 0.02
#: A document is rejected from the least probability of a grade above 0, within these bounds, that at most this share of clean labelled ones reach.
REJECT, ALLOWED = (0.2, 0.5), 0.002

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 32-bit feature hashes of all words and prefixes, repeats included."""
    w = words(*text_buffer(column), space=_SEPARATOR)
    rows, found = [w.row], [w.hash]
    for size in PREFIXES:
        long, h = w.prefixes(size)
        rows.append(w.row[long])
        found.append(h)
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Model:
    ids: np.ndarray  # sorted
    weights: np.ndarray
    thetas: np.ndarray
    reject: float = 1.0

    def severity(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and the probability of a grade above 0."""
        n = len(column)
        if not len(self.ids):
            return np.zeros(n), np.zeros(n)
        rows, found = features(column)
        may = np.zeros(1 << 16, bool)
        may[self.ids & 0xFFFF] = True
        hit = may[found & 0xFFFF]
        rows, found = rows[hit], found[hit]
        at = np.minimum(np.searchsorted(self.ids, found), len(self.ids) - 1)
        own = self.ids[at] == found
        pairs = np.unique(rows[own] * len(self.ids) + at[own])
        x = np.bincount(pairs // len(self.ids), self.weights[pairs % len(self.ids)], minlength=n)
        above = 1 / (1 + np.exp(self.thetas[None, :] - x[:, None]))
        return above.sum(axis=1), above[:, 0]


NONE = Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(0))


def fit(found: list[np.ndarray], toxic: np.ndarray, rounds: int = 600, decay: float = 2e-5) -> Model:
    """Fits on the distinct features of each document, by Adam on the penalised likelihood."""
    if not toxic.any() or toxic.all():
        return NONE
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    ids, cols = np.unique(np.concatenate(found), return_inverse=True)
    n1, n0 = toxic.sum(), (~toxic).sum()
    a = np.bincount(cols, toxic[rows], minlength=len(ids))
    b = np.bincount(cols, ~toxic[rows], minlength=len(ids))
    p = (a + b + 1) / (n1 + n0 + 2)
    z = (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    # what merely goes with a language or a kind of page is no evidence, so only clear signs count
    clear = np.flatnonzero((z >= ASSOCIATED) & (a >= np.maximum(3, n1 * RARE)) & ((a + 0.5) / n1 >= TIMES * (b + 0.5) / n0))
    best = np.sort(clear[np.argsort(-z[clear], kind="stable")[:FEATURES]])
    if not len(best):
        return NONE
    place = np.full(len(ids), -1)
    place[best] = np.arange(len(best))
    keep = place[cols] >= 0
    r, c = rows[keep], place[cols[keep]]
    share = np.bincount(r, minlength=len(found)) / np.maximum(1, [len(f) for f in found])
    grade = np.where(toxic, 1 + (share > np.median(share[toxic])), 0)
    w, theta = np.zeros(len(best)), np.array([0.0, 1.0])
    weight = np.where(toxic, 0.5 / n1, 0.5 / n0)
    moments = [np.zeros(len(best) + 2), np.zeros(len(best) + 2)]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        x = np.bincount(r, w[c], minlength=len(found))
        low = np.where(grade > 0, sig(theta[np.maximum(grade - 1, 0)] - x), 0.0)  # P(Y < grade)
        high = np.where(grade < 2, sig(theta[np.minimum(grade, 1)] - x), 1.0)
        mass = np.maximum(high - low, 1e-9)
        dl, dh = low * (1 - low), high * (1 - high)
        gx = weight * (dh - dl) / mass
        gt = np.array([-(weight * dh / mass)[grade == j].sum() + (weight * dl / mass)[grade == j + 1].sum() for j in (0, 1)])
        g = np.concatenate([np.bincount(c, gx[r], minlength=len(best)) + decay * w, gt])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w = w - move[:-2]
        theta = theta - move[-2:]
        theta[1] = max(theta[1], theta[0] + 1e-3)
    clean = np.sort(1 - sig(theta[0] - np.bincount(r, w[c], minlength=len(found))[~toxic]))
    over = clean[min(len(clean) - 1, math.ceil(len(clean) * (1 - ALLOWED)))]
    return Model(ids[best].astype(np.uint32), w, theta, float(np.clip(over + 1e-6, *REJECT)))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", bound: int = BOUND) -> Model:
    """Fits in one task, as what it reads is bounded; the model is at most FEATURES numbers."""
    tune(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.join(docs.select(F.col(id).alias("doc_id")), "doc_id", "left_semi")  # a label without a document doesn't use up the bound
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic > 0").orderBy(*order).limit(bound).unionByName(known.where("toxic <= 0").orderBy(*order).limit(bound))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")  # 2 * bound rows of 12 bytes
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # of several texts of an id, the least

    def distinct(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            r, f = features(batch.column(2))
            pairs = np.unique(r.astype(np.uint64) << np.uint64(32) | f.astype(np.uint64))
            at = np.concatenate([[0], np.cumsum(np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(pairs.astype(np.uint32).view(np.int32)))], names=["doc_id", "toxic", "found"])

    def once(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending")])
        m = fit([x.values.to_numpy().view(np.uint32) for x in t["found"]], t["toxic"].to_numpy() > 0)
        return pa.table({"ids": pa.array([m.ids.tolist()], pa.list_(pa.int64())), "weights": pa.array([m.weights.tolist()], pa.list_(pa.float64())), "thetas": pa.array([m.thetas.tolist()], pa.list_(pa.float64())), "reject": pa.array([m.reject])})

    found = rows.mapInArrow(distinct, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, found array<int>")
    fitted = found.groupBy(F.lit(1).alias("all")).applyInArrow(once, "ids array<bigint>, weights array<double>, thetas array<double>, reject double").first()
    return Model(np.array(fitted.ids, np.uint32), np.array(fitted.weights, float), np.array(fitted.thetas, float), fitted.reject) if fitted else NONE


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), p_toxic and rejected of every document."""
    tune(docs.sparkSession)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            severity, p = model.severity(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(p), pa.array(p >= model.reject)], names=["doc_id", "severity", "p_toxic", "rejected"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, severity double, p_toxic double, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without those that the model rejects."""
    tune(docs.sparkSession)

    def run(data: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(data):
            yield batch.filter(pa.array(model.severity(batch.column(text))[1] < model.reject))

    return docs.mapInArrow(run, docs.schema)
