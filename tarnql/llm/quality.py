"""Quality by logistic regression over hashed word n-grams, fitted with FTRL-proximal.

Tokens are runs of letters and digits and runs of other signs.  Features are hashes of
single tokens, of neighbouring pairs, of each token's shape (all capitals, capitalised,
with digits) and of the event that a word repeats the one before it.  A text's vector
holds the square roots of its counts, scaled to length one.  Weights are learned on a
bounded sample of labelled rows; texts are scored where they lie, as sparse dot products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, text

BITS = 18
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5
#: Passes over the sample, whatever its size, and rows a step.
EPOCHS, BATCH = 20, 32

_PAIR, _SHAPE, _REPEAT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_upper = np.zeros(256, np.int64)
_upper[65:91] = 1
_digit = np.zeros(256, np.int64)
_digit[48:58] = 1


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of some texts: rows, features, values.

    Features are counted block by block: beside the vectors, only one block's tokens are held, however long a text is.
    """
    found, numbers, before = [], [], None
    for who, parts in text.blocks(texts, text.RUNS):
        raw = np.frombuffer(b"\n".join(parts), np.uint8)
        if not len(raw):
            continue
        buf = np.frombuffer(raw.tobytes().lower(), np.uint8)
        starts, ends = text.spans(buf, text.RUNS)
        if not len(starts):
            continue
        doc = np.repeat(np.array(who, np.int64), np.diff(np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))))
        h = text.stretch_hashes(text.prefix_sums(buf), starts, ends)
        capitals, digits = (np.concatenate([[0], np.cumsum(t[raw])]) for t in (_upper, _digit))
        n_upper = capitals[ends] - capitals[starts]
        shape = np.minimum(n_upper, 2) + 3 * (n_upper == ends - starts) + 6 * (digits[ends] > digits[starts])
        # a text that is cut goes on in the next block: the token before makes a pair with its first one
        docs, hs = (doc, h) if before is None else (np.append(before[0], doc), np.append(before[1], h))
        before = doc[-1:], h[-1:]
        with np.errstate(over="ignore"):
            inside = np.flatnonzero(docs[1:] == docs[:-1])
            pairs = text.mix(hs[inside] * _PAIR + hs[inside + 1])
            same = inside[hs[inside] == hs[inside + 1]]
            shape = text.mix((shape.astype(np.uint64) + np.uint64(16)) * _SHAPE)
        keys = np.concatenate([h, pairs, shape, np.full(len(same), _REPEAT)])
        rows = np.concatenate([doc, docs[inside], doc, docs[same]])
        both = np.sort((rows << bits) | (keys >> np.uint64(64 - bits)).astype(np.int64))
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        both, n = both[first], np.diff(np.append(first, len(both)))
        if found and found[-1][-1] >> bits == both[0] >> bits:
            both, n = _summed(np.append(found.pop(), both), np.append(numbers.pop(), n))
        found.append(both)
        numbers.append(n)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.float32)
    both, n = np.concatenate(found), np.sqrt(np.concatenate(numbers)).astype(np.float64)
    rows, cols = both >> bits, both & ((1 << bits) - 1)
    norm = np.sqrt(np.bincount(rows, n * n, len(texts)))
    return rows, cols, (n / norm[rows]).astype(np.float32)


def _groups(texts: list[bytes]):
    """Yields (first, end): neighbouring texts of about ``text.BLOCK`` bytes, or one that is longer."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > text.BLOCK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float] | None:
    """Weights and bias from sparse vectors (features, values) in their order; None without any."""
    if not len(labels):
        return None
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(labels))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            cols = np.concatenate([samples[i][0] for i in batch])
            vals = np.concatenate([samples[i][1] for i in batch])
            rows = np.repeat(np.arange(len(batch)), [len(samples[i][0]) for i in batch])
            uniq, where = np.unique(cols, return_inverse=True)
            w = weights(z[uniq], n[uniq])
            bias = -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            error = sigmoid(np.bincount(rows, w[where] * vals, len(batch)) + bias) - labels[batch]
            g = np.bincount(where, error[rows] * vals, len(uniq))
            sigma = (np.sqrt(n[uniq] + g * g) - np.sqrt(n[uniq])) / ALPHA
            z[uniq] += g - sigma * w
            n[uniq] += g * g
            gb = error.sum()
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / ALPHA * bias
            nb += gb * gb
    return weights(z, n).astype(np.float32), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA))


def predict(model: tuple[np.ndarray, float], texts: list[bytes], bits: int = BITS) -> np.ndarray:
    w, bias = model
    sums = np.zeros(len(texts))
    for first, end in _groups(texts):  # vectors take many times their texts' bytes
        rows, cols, vals = features(texts[first:end], bits)
        sums[first:end] = np.bincount(rows, w[cols].astype(np.float64) * vals, end - first)
    return sigmoid(sums + bias)


def _sampled(batches):
    import pyarrow as pa

    for batch in batches:
        texts = text.utf8(batch.column("text"))
        for first, end in _groups(texts):
            rows, cols, vals = features(texts[first:end])
            cuts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=end - first))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (cols.astype(np.int32), vals)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in ("doc_id", "label")), *lists], names=["doc_id", "label", "cols", "vals"])


def learn(docs: DataFrame, labels: DataFrame, rows: int = common.SAMPLE_ROWS) -> tuple[np.ndarray, float] | None:
    """The model of at most ``rows`` labelled documents outside the held-out fold, and ``common.SAMPLE_FEATURES`` features of them."""
    sample = common.labelled(docs, labels, "quality", 4, 2, rows)
    sample = common.map_arrow(sample, _sampled, f"doc_id {dict(sample.dtypes)['doc_id']}, label int, cols array<int>, vals array<float>")
    sample = common.within(sample, F.size("cols"), common.SAMPLE_FEATURES).toArrow().sort_by("doc_id")
    cols, vals = (sample.column(c).combine_chunks() for c in ("cols", "vals"))
    samples = [(cols[i].values.to_numpy(), vals[i].values.to_numpy()) for i in range(len(sample))]
    model = fit(samples, sample.column("label").to_numpy().astype(np.float64))
    del sample, cols, vals, samples
    common.release()
    return model


def _scored(batches, model, name: str):
    import pyarrow as pa

    for batch in batches:
        scores = predict(model.value, text.utf8(batch.column("text"))) if model else np.full(batch.num_rows, THRESHOLD)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])


def annotate(docs: DataFrame, labels: DataFrame, name: str = "score", rows: int = common.SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the chance that a text is labelled good, in a column ``name``.

    A null text is scored as an empty one; a row without an id isn't learned from.
    Repeated rows have the same score each; of texts or labels of one id, the smallest
    text and the largest label are learned from.  Without a labelled row to learn from,
    every score is the threshold, so that nothing is rejected without evidence; an empty
    table gives an empty result.  Ids are of any type that has an order.
    """
    if name in docs.columns:
        raise ValueError(f"docs have a column {name}: choose another name")
    model = learn(docs, labels, rows)
    sent = docs.sparkSession.sparkContext.broadcast(model) if model else None  # 2**BITS floats
    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes) + f", `{name}` double"
    return common.map_arrow(docs, lambda b: _scored(b, sent, name), schema)
