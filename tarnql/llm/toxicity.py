"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct terms: the words, and the first four bytes of longer
words, so that inflected forms share evidence.  The machine adds a weight for each term
and, for each pair of terms, the product of their factor vectors: an insult together
with the mention of a group weighs more than both alone.  All pairs of a text cost one
pass over its terms, since the sum of products is half of (square of sums - sum of
squares).  Weights and factors are learned with AdaGrad on a bounded sample of labelled
rows; terms that are rare in it have none.  A term as frequent under either label has no
weight of its own but keeps its factors: it may tell in a pair what it doesn't alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text
from .quality import sigmoid

BITS = 18
FACTORS = 4
PREFIX = 4
#: Texts of the sample that a term must occur in, and standard deviations by which its share among either label must differ for a weight of its own.
LEAST, EVIDENCE = 5, 3.0
RATE, L1, L2, EPOCHS, BATCH = 0.15, 1e-3, 1e-5, 12, 32
#: Spread of the factors at the start, and their L1: a term in few texts loses them unless its pairs tell something.
SPREAD, FACTOR_L1 = 0.07, 5e-3
#: Labelled rows that the machine learns from, at most.
ROWS = 16000


def terms(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of lower-cased texts: rows and features."""
    hashes, counts, heads = text.tokens(texts, text.ALNUM, PREFIX)
    doc = np.repeat(np.arange(len(texts)), counts)
    long = heads != 0
    keys = np.concatenate([hashes, text.mix(heads[long] + np.uint64(1))])
    both = (np.concatenate([doc, doc[long]]) << bits) | (keys >> np.uint64(64 - bits)).astype(np.int64)
    both = np.unique(both)
    return both >> bits, both & ((1 << bits) - 1)


def _margin(rows, cols, n, w0, w, v):
    """Scores of ``n`` texts before the sigmoid, and the sums of their factors."""
    linear = np.bincount(rows, w[cols], n)
    factors = v[cols]
    sums = np.stack([np.bincount(rows, factors[:, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(rows, (factors * factors).sum(axis=1), n)
    return w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def fit(samples: list[np.ndarray], labels: np.ndarray, bits: int = BITS):
    """(w0, weights, factors) from the terms of each text; None without any."""
    if not len(labels):
        return None
    frequency = np.bincount(np.concatenate(samples), minlength=1 << bits)
    toxic = np.bincount(np.concatenate(samples), np.repeat(labels, [len(s) for s in samples]), 1 << bits)
    n1, n0 = max(labels.sum(), 0.5), max((1 - labels).sum(), 0.5)
    spread = np.sqrt((frequency + 1) / len(labels) * (1 / n1 + 1 / n0))
    used = np.flatnonzero(frequency >= LEAST)
    apart = (np.abs(toxic / n1 - (frequency - toxic) / n0) >= EVIDENCE * spread)[used]
    number = np.full(1 << bits, -1, np.int64)
    number[used] = np.arange(len(used))
    samples = [c[c >= 0] for c in (number[s] for s in samples)]
    rng = np.random.default_rng(0)
    w0, w, v = 0.0, np.zeros(len(used)), rng.normal(0, SPREAD, (len(used), FACTORS))
    g0, gw, gv = 1e-6, np.full(len(used), 1e-6), np.full((len(used), FACTORS), 1e-2)
    # either label weighs the same in all, within a factor of four
    share = min(max(labels.mean(), 0.2), 0.8)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(labels))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            cols = np.concatenate([samples[i] for i in batch])
            rows = np.repeat(np.arange(len(batch)), [len(samples[i]) for i in batch])
            margin, sums = _margin(rows, cols, len(batch), w0, w, v)
            error = (sigmoid(margin) - labels[batch]) * weight[batch] / len(batch)
            g = error.sum()
            g0 += g * g
            w0 -= RATE * g / np.sqrt(g0)
            uniq, where = np.unique(cols, return_inverse=True)
            e = error[rows]
            dw = np.bincount(where, e, len(uniq)) + L2 * w[uniq]
            gw[uniq] += dw * dw
            step = RATE / np.sqrt(gw[uniq])
            new = w[uniq] - step * dw
            w[uniq] = np.where(apart[uniq], np.sign(new) * np.maximum(np.abs(new) - step * L1, 0), 0)
            pull = e[:, None] * (sums[rows] - v[cols])
            dv = np.stack([np.bincount(where, pull[:, f], len(uniq)) for f in range(FACTORS)], axis=1) + L2 * v[uniq]
            gv[uniq] += dv * dv
            step = 0.3 * RATE / np.sqrt(gv[uniq])
            new = v[uniq] - step * dv
            v[uniq] = np.sign(new) * np.maximum(np.abs(new) - step * FACTOR_L1, 0)
    weights, factors = np.zeros(1 << bits, np.float32), np.zeros((1 << bits, FACTORS), np.float32)
    weights[used], factors[used] = w, v
    return w0, weights, factors


def predict(model, texts: list[bytes]) -> np.ndarray:
    rows, cols = terms(texts)
    keep = (model[1][cols] != 0) | (model[2][cols] != 0).any(axis=1)
    margin, _ = _margin(rows[keep], cols[keep], len(texts), *model)
    return sigmoid(margin)


def _sampled(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [t.lower() for t in text.utf8(batch.column("text"))]
        rows, cols = terms(texts)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(texts)))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(cols.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "cols"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS):
    """The model of at most ``rows`` labelled documents outside the held-out fold, and ``common.SAMPLE_FEATURES`` terms of them."""
    sample = common.labelled(docs, labels, "toxic", 5, 0, rows)
    sample = common.map_arrow(sample, _sampled, f"doc_id {dict(sample.dtypes)['doc_id']}, label int, cols array<int>")
    sample = common.within(sample, F.size("cols"), common.SAMPLE_FEATURES).toArrow().sort_by("doc_id")
    cols = sample.column("cols").combine_chunks()
    model = fit([cols[i].values.to_numpy() for i in range(len(sample))], sample.column("label").to_numpy().astype(np.float64))
    del sample, cols
    common.release()
    return model


def _scored(batches, model):
    import pyarrow as pa

    for batch in batches:
        texts = [t.lower() for t in text.utf8(batch.column("text"))]
        scores = predict(model.value, texts) if model else np.zeros(batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null text is scored as an empty one; a row without an id is neither held out nor
    learned from.  Repeated rows have the same score each; of texts or labels of one id,
    the smallest text and the largest label are learned from.  Without a labelled row to
    learn from, every score is 0; an empty table gives an empty result.  Ids are of any
    type that has an order; columns other than doc_id and text are ignored.
    """
    model = learn(docs, labels, rows)
    sent = docs.sparkSession.sparkContext.broadcast(model) if model else None  # 2**BITS * (1 + FACTORS) floats
    scored = common.map_arrow(docs.select("doc_id", "text"), lambda b: _scored(b, sent), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", common.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
