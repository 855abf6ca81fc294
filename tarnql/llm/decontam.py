"""Benchmark decontamination over a distributed positional inverted index.

``index`` stores the postings of all training tokens in the shared folder, one row a
segment of about ``SEGMENT_BYTES``: its documents with their word counts, its terms as
bytes, and for each term the ascending positions where it stands.  An index answers any
number of searches; texts aren't read again.  It is split by document, as search engines
split theirs, so postings are never shuffled and no term, however frequent, has a list
longer than a segment.

A search first counts the items' terms over all segments.  Each window of an item is then
looked up from its rarest term in the whole corpus: that term's list, moved by the term's
offset, is intersected with the list of the next rarest one, and so on.  Terms are
compared as bytes, so what is left is an occurrence.  A proximity match asks for all terms
of a window within ``slop`` words of its longest one, in any order.

Windows of common words only give candidates in proportion to the segment; they are
handled ``CANDIDATES`` at a time.  Windows go to the segments in blocks of
``BLOCK_WINDOWS``, an item of more windows in several blocks; each block is a pass over
the index, and findings of all passes are put together by segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common, text

WINDOW = 13
#: Further words over which the terms of a window may be spread in a proximity match.
SLOP = 12
#: Windows looked up in one pass over the index; they take about 100 bytes each.
BLOCK_WINDOWS = 100_000
#: Bytes of documents in one segment of the index, about.
SEGMENT_BYTES = 4 << 20
CANDIDATES = 1 << 20

_word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(whole: str | None) -> list[bytes]:
    """ASCII letters in lower case, digits, and all that is not ASCII."""
    return _word.findall((whole or "").encode().lower())


# -- the index


def index_schema(documents: T.StructType) -> T.StructType:
    fields = [("segment", T.LongType()), ("documents", T.ArrayType(documents)), ("n_words", T.BinaryType()), ("terms", T.BinaryType()), ("term_lengths", T.BinaryType()), ("counts", T.BinaryType()), ("steps", T.BinaryType())]
    return T.StructType([T.StructField(*f) for f in fields])


def _segments(batches, keep_text: bool):
    """One row for each slice of about ``SEGMENT_BYTES``; ``steps`` are differences of a term's positions."""
    import pyarrow as pa
    from pyspark import TaskContext

    context = TaskContext.get()
    segment = (context.partitionId() if context else 0) << 32
    for whole in batches:
        step = max(1, int(whole.num_rows * SEGMENT_BYTES / max(1, whole.nbytes)))
        for k in range(0, whole.num_rows, step):
            batch = whole.slice(k, step)
            terms, numbers, counts = text.words([t.lower() for t in text.utf8(batch.column("text"))], text.ALNUM)
            order = np.argsort(numbers, kind="stable")
            n = np.bincount(numbers, minlength=len(terms)).astype("<i4")
            steps = np.diff(order, prepend=0)
            first = (np.cumsum(n) - n)[n > 0]
            steps[first] = order[first]
            data, lengths = text.packed(terms)
            kept = [(name, c) for name, c in zip(batch.schema.names, batch.columns) if keep_text or name != "text"]
            documents = pa.StructArray.from_arrays([c for _, c in kept], fields=[batch.schema.field(name) for name, _ in kept])
            row = [
                pa.array([segment], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), documents),
                *(pa.array([x], pa.binary()) for x in (counts.astype("<i4").tobytes(), data, lengths.astype("<i4").tobytes(), n.tobytes(), steps.astype("<i4").tobytes())),
            ]
            yield pa.RecordBatch.from_arrays(row, names=["segment", "documents", "n_words", "terms", "term_lengths", "counts", "steps"])
            segment += 1


def index(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """The stored index of ``docs`` by their column ``text``; the other columns, and if asked for the texts, are kept beside the postings."""
    kept = T.StructType([f for f in docs.schema.fields if keep_text or f.name != "text"])
    # of a few MB a row: row groups are kept small, since a reader holds one at a time
    return common.stored(common.map_arrow(docs, lambda b: _segments(b, keep_text), index_schema(kept)), block_bytes=32 << 20)


class Segment:
    """Postings of one row of the index, with a gap between documents."""

    def __init__(self, row: dict, gap: int):
        read = lambda c: np.frombuffer(row[c], "<i4").astype(np.int64)
        self.n_words = read("n_words")
        self.terms = text.unpacked(row["terms"], read("term_lengths"))
        counts = read("counts")
        self.spread = np.concatenate([[0], np.cumsum(counts)])
        position = np.cumsum(read("steps"))
        first = self.spread[:-1][counts > 0]
        carried = np.zeros(len(position), np.int64)
        carried[first[1:]] = position[first[1:] - 1]
        position -= np.maximum.accumulate(carried) if len(first) else 0
        self.starts = np.cumsum(self.n_words) - self.n_words
        self.gap = gap
        # documents without words share their start with the next one, which owns the words from there
        self.owner = np.searchsorted(self.starts, position, side="right") - 1
        self.position = position + (self.owner + 1) * gap
        self.size = int(self.n_words.sum()) + (len(self.n_words) + 2) * gap
        self.keys = np.repeat(np.arange(len(counts)), counts) * self.size + self.position


# -- windows


class Phrases:
    """Distinct windows of some items as arrays: their terms, and whose they are."""

    def __init__(self, windows: dict[tuple, set], width: int = WINDOW):
        import pyarrow as pa

        phrases = list(windows)
        vocabulary = sorted({w for p in phrases for w in p})
        number = {w: k for k, w in enumerate(vocabulary)}
        self.vocabulary = pa.array(vocabulary, pa.large_binary())
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.terms = np.full((len(phrases), width), -1, np.int32)
        for k, p in enumerate(phrases):
            self.terms[k, : len(p)] = [number[w] for w in p]
        # the longest term, the first in order of bytes among equals
        self.anchors = np.array([min(range(len(p)), key=lambda i: (-len(p[i]), p[i], i)) for p in phrases], np.int64)
        owners = [sorted(windows[p], key=lambda i: (i is None, str(i))) for p in phrases]
        self.items = sorted({i for o in owners for i in o}, key=lambda i: (i is None, str(i)))
        place = {i: k for k, i in enumerate(self.items)}
        self.owned = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owners = np.array([place[i] for o in owners for i in o], np.int32)
        self.order = np.tile(np.arange(width, dtype=np.int8), (len(phrases), 1))

    def rank(self, counts: np.ndarray) -> None:
        """Orders every window's terms by their occurrences in the whole corpus, rarest first; places after a short window's end come last."""
        self.order = np.argsort(np.append(counts, np.iinfo(np.int64).max)[self.terms], axis=1, kind="stable").astype(np.int8)

    def of(self, phrase: int) -> list:
        """The ids of the items that have a window."""
        return [self.items[k] for k in self.owners[self.owned[phrase] : self.owned[phrase + 1]]]


def blocks(items: Iterable[tuple], width: int = WINDOW, limit: int | None = None) -> Iterator[Phrases]:
    """The windows of (item id, text), at most ``limit`` of them at a time."""
    limit = limit or BLOCK_WINDOWS
    windows: dict[tuple, set] = {}
    for item_id, whole in items:
        ws = words(whole)
        n = min(width, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            key = tuple(ws[k : k + n])
            if key not in windows and len(windows) >= limit:
                yield Phrases(windows, width)
                windows = {}
            windows.setdefault(key, set()).add(item_id)
    if windows:
        yield Phrases(windows, width)


# -- search


def _known(segment_terms, phrases: Phrases) -> np.ndarray:
    """Each vocabulary word's number among a segment's terms, -1 where it has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(phrases.vocabulary, value_set=segment_terms), -1).to_numpy(zero_copy_only=False)


def find(segment: Segment, phrases: Phrases, slop: int):
    """Exact matches (document, first word, window) and proximity matches (document, word of the longest term, window)."""
    number = np.append(_known(segment.terms, phrases), -1)
    terms = number[phrases.terms]  # places after a short window's end stay -1
    alive = np.flatnonzero(((terms >= 0) | (phrases.terms < 0)).all(axis=1))
    terms, order = terms[alive].astype(np.int64), phrases.order[alive].astype(np.int64)
    keys, size = segment.keys, segment.size
    exact, near = [], []
    for from_rarest, found in ((True, exact), (False, near)):
        begin = order[:, 0] if from_rarest else phrases.anchors[alive]
        term_at = terms[np.arange(len(alive)), begin]
        n = segment.spread[term_at + 1] - segment.spread[term_at]
        for group in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(np.cumsum(n) // CANDIDATES)) + 1):
            w = np.repeat(group, n[group])
            if not len(w):
                continue
            at = segment.spread[term_at[w]] + np.arange(len(w)) - np.repeat(np.cumsum(n[group]) - n[group], n[group])
            for j in range(order.shape[1]):
                offset = order[w, j]
                t, p = terms[w, offset], segment.position[at]
                # the list of term t, moved by its distance, or any of its places within the slop
                low, high = (p + offset - begin[w],) * 2 if from_rarest else (p - slop, p + slop)
                i = np.searchsorted(keys, t * size + low)
                keep = (t < 0) | (keys[np.minimum(i, len(keys) - 1)] <= t * size + high) & (i < len(keys))
                w, at = w[keep], at[keep]
                if not len(w):
                    break
            if len(w):
                doc = segment.owner[at]
                word = segment.position[at] - (doc + 1) * segment.gap - segment.starts[doc]
                found.append((doc, word - (begin[w] if from_rarest else 0), alive[w]))
    join = lambda xs: tuple(np.concatenate([x[k] for x in xs]) if xs else np.zeros(0, np.int64) for k in range(3))
    return join(exact), join(near)


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


def _counts(batches, phrases):
    """Occurrences of the vocabulary's words in a task's segments."""
    import pyarrow as pa

    phrases = phrases.value
    total = np.zeros(len(phrases.vocabulary), np.int64)
    for one in _rows(batches):
        row = one.to_pylist()[0]
        lengths, counts = (np.frombuffer(row[c], "<i4") for c in ("term_lengths", "counts"))
        number = _known(text.unpacked(row["terms"], lengths.astype(np.int64)), phrases)
        there = number >= 0
        total[there] += counts[number[there]]
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"term": seen, "n": total[seen]})


def _ranked(index: DataFrame, phrases: Phrases):
    """``phrases`` sent to the executors, their terms ordered by counts over the whole index."""
    sc = index.sparkSession.sparkContext
    sent = sc.broadcast(phrases)  # of BLOCK_WINDOWS windows at most
    counted = common.map_arrow(index.select("terms", "term_lengths", "counts"), lambda b: _counts(b, sent), "term long, n long")
    counts = np.zeros(len(phrases.vocabulary), np.int64)
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["term"]] = r["n"]
    sent.unpersist()
    phrases.rank(counts)
    return sc.broadcast(phrases)


class Findings:
    """What is known of the documents of one segment: stretches of hit words, items with windows, items near by."""

    def __init__(self):
        self.stretches: dict[int, list[tuple[int, int]]] = {}
        self.items: dict[int, set] = {}
        self.near: dict[int, set] = {}

    def add(self, segment: Segment, phrases: Phrases, slop: int) -> None:
        (doc, first, phrase), (near_doc, _, near_phrase) = find(segment, phrases, slop)
        for d, f, p in zip(doc.tolist(), first.tolist(), phrase.tolist()):
            self.stretches.setdefault(d, []).append((f, f + int(phrases.lengths[p])))
            self.items.setdefault(d, set()).update(phrases.of(p))
        for d, p in {*zip(near_doc.tolist(), near_phrase.tolist())}:
            self.near.setdefault(d, set()).update(phrases.of(p))
        for d in self.stretches:
            self.stretches[d] = merged(self.stretches[d])

    def load(self, parts: list[dict]) -> None:
        for p in parts:
            d = p["document"]
            self.stretches[d] = merged(self.stretches.get(d, []) + list(zip(p["starts"], p["ends"])))
            self.items.setdefault(d, set()).update(p["items"])
            self.near.setdefault(d, set()).update(p["near"])

    def result(self, d: int, n: int) -> tuple:
        stretches, items = self.stretches.get(d, []), self.items.get(d, set())
        lengths = [b - a for a, b in stretches]
        names = sorted(str(i) for i in items if i is not None)
        n_hit = sum(lengths)
        return n, n_hit, len(items), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n, len(self.near.get(d, set()) | items), max(lengths, default=0)


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


RESULT = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"), ("n_near_items", "long"), ("n_longest", "long")]


KINDS = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _partial(batches, phrases, item, width: int, slop: int):
    """Of one block of windows, what it found in each document where it found anything."""
    import pyarrow as pa

    phrases = phrases.value
    ints, names = pa.list_(pa.int64()), pa.list_(item)
    for one in _rows(batches):
        row = one.to_pylist()[0]
        found = Findings()
        found.add(Segment(row, width + slop), phrases, slop)
        docs = sorted({*found.stretches, *found.near})
        if docs:
            columns = [
                pa.array([row["segment"]] * len(docs), pa.int64()), pa.array(docs, pa.int64()),
                pa.array([[a for a, _ in found.stretches.get(d, [])] for d in docs], ints), pa.array([[b for _, b in found.stretches.get(d, [])] for d in docs], ints),
                *(pa.array([sorted(x.get(d, ()), key=str) for d in docs], names) for x in (found.items, found.near)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "document", "starts", "ends", "items", "near"])


def _annotated(batches, phrases, width: int, slop: int, names: list[str]):
    """The documents of each segment with their results: the last block's, and what earlier ones found (``parts``)."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    for one in _rows(batches):
        documents = one.column("documents")
        row = one.drop_columns(["documents"]).to_pylist()[0]
        found = Findings()
        if row.get("parts"):
            found.load(row["parts"])
        if phrases:
            found.add(Segment(row, width + slop), phrases.value, slop)
        results = [found.result(d, n) for d, n in enumerate(np.frombuffer(row["n_words"], "<i4").tolist())]
        new = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*results), RESULT)]
        inner = documents.flatten()
        yield pa.RecordBatch.from_arrays([*inner.flatten(), *new], names=[*(f.name for f in inner.type), *names])


def _items(benchmark: DataFrame) -> Iterator[tuple]:
    return map(tuple, benchmark.select("item_id", "text").toLocalIterator())


def annotate_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, prefix: str = "", block_windows: int | None = None) -> DataFrame:
    """The documents kept in an index with the columns of ``RESULT`` (see ``annotate``)."""
    documents = index.schema["documents"].dataType.elementType
    names = [prefix + n for n, _ in RESULT]
    if clash := set(names) & set(documents.names):
        raise ValueError(f"docs have columns {sorted(clash)}: choose another prefix")
    schema = T.StructType([*documents.fields, *(T.StructField(n, KINDS[k]) for n, (_, k) in zip(names, RESULT))])
    item, item_type = dict(benchmark.dtypes)["item_id"], to_arrow_type(benchmark.schema["item_id"].dataType)
    searched = index.select("segment", "n_words", "terms", "term_lengths", "counts", "steps")
    parts, last = None, None
    for phrases in blocks(_items(benchmark), window, block_windows):
        if last is not None:
            part = common.map_arrow(searched, lambda b, sent=last: _partial(b, sent, item_type, window, slop), f"segment long, document long, starts array<long>, ends array<long>, items array<{item}>, near array<{item}>")
            part = common.stored(part)
            last.unpersist()
            parts = part if parts is None else parts.unionByName(part)
        last = _ranked(index, phrases)
    if parts is not None:
        # a segment's own documents with findings, once a pass
        grouped = parts.groupBy("segment").agg(F.collect_list(F.struct("document", "starts", "ends", "items", "near")).alias("parts"))
        index = index.join(grouped, "segment", "left")
    return common.map_arrow(index, lambda b: _annotated(b, last, window, slop, names), schema)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, prefix: str = "", block_windows: int | None = None) -> DataFrame:
    """``docs`` with the columns of ``RESULT``, their names after ``prefix``.

    A document word inside an occurrence of any window of an item is hit; a document is
    contaminated if a twentieth of its words or more are hit; ``n_longest`` is the longest
    stretch of hit words.  ``n_near_items`` also counts items with a window all of whose
    terms lie within ``slop`` words of an occurrence of its longest one (the first in order
    of bytes among equals), in any order.  A null text has no words and an item without
    words no windows; repeated items of one id count once, items without an id together as
    one that the digest leaves out; without a benchmark nothing is hit.  Repeated rows and
    rows without an id each have their result; an empty table gives an empty one.
    """
    return annotate_index(index(docs, keep_text=True), benchmark, window, slop, prefix, block_windows)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id and the columns of ``RESULT`` for every row of ``docs``; its other columns are ignored."""
    return annotate_index(index(docs.select("doc_id", "text")), benchmark, **options)


def _matched(batches, phrases, item, width: int, slop: int):
    import pyarrow as pa

    phrases = phrases.value
    for one in _rows(batches):
        ids = one.column("documents").flatten().field("doc_id")
        segment = Segment(one.drop_columns(["documents"]).to_pylist()[0], width + slop)
        for kind, (doc, word, phrase) in zip(("exact", "near"), find(segment, phrases, slop)):
            for k in range(0, len(doc), 1 << 16):
                d, w, p = doc[k : k + (1 << 16)], word[k : k + (1 << 16)], phrase[k : k + (1 << 16)]
                n = phrases.owned[p + 1] - phrases.owned[p]
                at = np.repeat(phrases.owned[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                columns = [
                    ids.take(pa.array(np.repeat(d, n))), pa.array(phrases.items, item).take(pa.array(phrases.owners[at])), pa.array([kind] * len(at), pa.string()),
                    pa.array(np.repeat(w, n), pa.int64()), pa.array(np.repeat(phrases.lengths[p], n), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "kind", "word", "length"])


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, block_windows: int | None = None) -> DataFrame:
    """(doc_id, item_id, kind, word, length): every match of a window in an index.

    ``exact`` ones start at ``word``; for ``near`` ones it is the place of the window's longest term.
    """
    doc, item = index.schema["documents"].dataType.elementType["doc_id"].dataType.simpleString(), dict(benchmark.dtypes)["item_id"]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {doc}, item_id {item}, kind string, word long, length long"
    found = index.sparkSession.createDataFrame([], schema)
    for phrases in blocks(_items(benchmark), window, block_windows):
        sent = _ranked(index, phrases)
        found = found.unionByName(common.stored(common.map_arrow(index, lambda b, sent=sent: _matched(b, sent, item_type, window, slop), schema)))
        sent.unpersist()  # a worker holds one block at a time
    return found


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), q AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)
), lengths AS (SELECT DISTINCT n FROM q), g AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, lengths WHERE len(ws) >= n)
), m AS (SELECT doc_id, item_id, g.n, i FROM g JOIN q ON g.n = q.n AND g.phrase = q.phrase),
p AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m)),
stretch AS (  -- hit words in a row
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM p) GROUP BY doc_id, g
),
hit AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_hit, max(n) AS n_longest FROM stretch GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
, ts AS (  -- the terms of each phrase, and its anchor
  SELECT DISTINCT phrase, unnest(string_split(phrase, ' ')) AS term FROM q
), anchor AS (SELECT phrase, first(term ORDER BY octet_length(encode(term)) DESC, term) AS term, count(*) AS n_terms FROM ts GROUP BY phrase),
post AS (
  SELECT doc_id, p, ws[p] AS term FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM d)
  WHERE ws[p] IN (SELECT term FROM ts)
), around AS (
  SELECT post.doc_id, post.p, anchor.phrase, anchor.n_terms FROM post JOIN anchor ON post.term = anchor.term
), near AS (
  SELECT DISTINCT a.doc_id, a.phrase
  FROM around a JOIN post x ON x.doc_id = a.doc_id AND x.p BETWEEN a.p - 12 AND a.p + 12
  JOIN ts ON ts.phrase = a.phrase AND ts.term = x.term
  GROUP BY a.doc_id, a.p, a.phrase, a.n_terms HAVING count(DISTINCT x.term) = a.n_terms
), near_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM near JOIN q ON near.phrase = q.phrase GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items, coalesce(n_longest, 0) AS n_longest
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
LEFT JOIN near_items ON d.doc_id = near_items.doc_id
"""
