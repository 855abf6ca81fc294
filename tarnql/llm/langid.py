"""Language by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSION`` signs, fixed by its code point alone.
A trigram's vector binds its letters' vectors, the second and third one permuted
(rotated) by one and two places, by multiplication; a text's vector bundles the vectors
of its trigrams by addition, and so does a language's prototype over all its training
texts.  A text has the language whose prototype makes the smallest angle with it.

Letters are lower-cased; a stretch without letters counts as one blank, so that starts
and ends of words take part.  Prototypes are sums of whole numbers, so the order and the
partitions in which texts are bundled make no difference.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSION = 1024
UNKNOWN = "und"
#: Texts whose trigrams are turned into vectors together, and code points looked at together.
GROUP, CHUNK = 64, 1 << 19

_letters = None
_vectors: dict[int, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    global _letters
    if _letters is None:
        points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        _letters = np.where([unicodedata.category(chr(p))[0] == "L" for p in points.tolist()], points, 0).astype(np.uint32)
    return _letters


def letter_vector(point: int) -> np.ndarray:
    """The signs of a letter, or of the blank (0)."""
    if (v := _vectors.get(point)) is None:
        bits = np.random.Generator(np.random.Philox(key=[0x7A12, point])).integers(0, 2, DIMENSION, dtype=np.int8)
        v = _vectors[point] = 2 * bits - 1
    return v


def trigrams(whole: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, three code points in 63 bits, and their counts; none without a letter."""
    table, total = _letter_table(), []
    tail = np.zeros(1, np.uint32)
    lowered = whole.lower()
    for k in range(0, len(lowered), CHUNK):
        points = table[np.frombuffer(lowered[k : k + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        points = np.concatenate([tail, points, np.zeros(int(k + CHUNK >= len(lowered)), np.uint32)])
        points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])].astype(np.int64)
        if len(points) > 2:
            total.append(np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_counts=True))
        tail = points[-2:].astype(np.uint32)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(total) == 1:
        return total[0]
    keys, where = np.unique(np.concatenate([t[0] for t in total]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([t[1] for t in total])).astype(np.int64)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """A row of signs for each trigram."""
    out = np.ones((len(codes), DIMENSION), np.int8)
    for place, shift in enumerate((42, 21, 0)):
        points, where = np.unique((codes >> shift) & 0x1FFFFF, return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(p)), place) for p in points])[where]
    return out


def bundles(texts: list[str | None]) -> np.ndarray:
    """The vectors of some texts, a row each; zeros without a letter."""
    found = [trigrams(t or "") for t in texts]
    codes, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    out = np.zeros((len(texts), DIMENSION), np.float64)
    rows = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
    counts = np.concatenate([f[1] for f in found])
    for k in range(0, len(codes), 8192):  # bounds the memory of many rare trigrams
        part = (where >= k) & (where < k + 8192)
        table = np.zeros((len(texts), min(8192, len(codes) - k)), np.float32)
        table[rows[part], where[part] - k] = counts[part]
        # sums of whole numbers: exact in single precision below 2**24 trigrams
        exact = np.float64 if counts.sum() > 1 << 23 else np.float32
        out += table.astype(exact) @ trigram_vectors(codes[k : k + 8192]).astype(exact)
    return out


def _groups(batches, *columns):
    for batch in batches:
        for k in range(0, batch.num_rows, GROUP):
            part = batch.slice(k, GROUP)
            yield part, [part.column(c).to_pylist() for c in columns]


def _trained(batches):
    import pyarrow as pa

    sums: dict[str, np.ndarray] = {}

    def packed():
        names = sorted(sums)
        out = pa.RecordBatch.from_pydict(
            {"lang": names, "bundle": [sums[n].astype(np.int64) for n in names]}, schema=pa.schema([("lang", pa.string()), ("bundle", pa.list_(pa.int64()))])
        )
        sums.clear()
        return out

    for _, (texts, langs) in _groups(batches, "text", "lang"):
        vectors = bundles(texts)
        for lang in set(langs):
            mine = vectors[[x == lang for x in langs]].sum(axis=0)
            sums[lang] = sums[lang] + mine if lang in sums else mine
        if len(sums) > 256:
            yield packed()
    if sums:
        yield packed()


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """The prototype of each language in the training folds; one row of sums a language reaches the driver."""
    training = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.fold("doc_id", 4) != 2)).select("text", "lang")
    partial = common.map_arrow(training, _trained, "lang string, bundle array<long>")
    summed = partial.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    each = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("bundle"))  # DIMENSION entries
    found = {r["lang"]: np.array([b["x"] for b in r["bundle"]], np.float64) for r in each.toLocalIterator()}
    return {lang: v for lang, v in sorted(found.items()) if v.any()}


def predict(prototypes: dict[str, np.ndarray], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    vectors = bundles(texts)
    norms = np.linalg.norm(vectors, axis=1)
    if not prototypes:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    names = list(prototypes)
    table = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names], axis=1)
    cosines = vectors @ table / np.maximum(norms, 1e-300)[:, None]
    best = cosines.argmax(axis=1)
    lettered = norms > 0
    score = np.where(lettered, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)
    return [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score


def _predicted(batches, prototypes):
    import pyarrow as pa

    for part, (texts,) in _groups(batches, "text"):
        langs, scores = predict(prototypes.value, texts)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the score is the cosine, 0 at least.

    A null text, or one without a letter, is ``und`` with score 0; so is every text where
    there is no training text.  Of languages equally near, the first in order of bytes
    is taken.  A row without an id is neither held out nor learned from.  Repeated rows
    have the same result each, and count as often as they occur; an empty table gives an
    empty result.  Columns other than doc_id, text and lang are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))  # DIMENSION numbers a language
    kind = dict(docs.dtypes)["doc_id"]
    found = common.map_arrow(docs.select("doc_id", "text"), lambda b: _predicted(b, sent), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
