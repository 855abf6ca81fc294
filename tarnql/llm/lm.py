"""Scores of whole texts under a recurrent language model learned from the corpus.

1. One pass tokenises the documents into chunks of about ``CHUNK_BYTES``: distinct words
   as bytes, their counts in the training folds, and each token as a number.  Chunks are
   written to the shared folder; later passes read numbers, not texts.
2. Chunks' words travel by hash range to where they are counted, by their bytes, and their
   totals travel back.  A word costs one entry a chunk however often it occurs, so
   frequent words are no hot keys, and the number of ranges follows that of entries.
3. The recurrent model (``gru``) starts from about ``START_TOKENS`` tokens, is then trained
   by shares of about ``SHARE_TOKENS`` in parallel, one pass over all, and the results are
   averaged by their tokens.  A document's share and its place in it follow from a hash of
   its id and text, so the model depends on the corpus and not on partitions.
4. Every chunk is scored with its words' totals.

A word is a frequent one, whose probability is the model's, or belongs to a tail class by
its last bytes: then the model gives the class, and the counts the word's share in it,
with half a count for every word and for all unseen ones together, as in the base score.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, gru, text

CHUNK_BYTES = 12 << 20
#: Entries (distinct words of chunks) in one range of hashes, about.
RANGE_ENTRIES = 2_000_000
#: Training tokens that the model starts from, and passes over them.
START_TOKENS, START_PASSES = 500_000, 2
#: Training tokens of one share.
SHARE_TOKENS = 2_000_000
#: Stands for the end of a text: a word can't hold a line end.
END = b"\n"
SUFFIX = 3
#: Models that one task adds up.
ADDED = 16

_CHUNK = "source int, place int, doc_ids array<{0}>, lengths binary, trained binary, keys binary, tokens binary, n_words long, n_trained long, words binary, word_lengths binary, tails binary, counts binary"


def tail(word: bytes) -> int:
    """A word's tail class."""
    return zlib.crc32(word[-SUFFIX:]) % gru.TAIL


def _chunk(source: int, place: int, ids, trained: np.ndarray, keys: np.ndarray, texts: list[bytes], kind):
    """Words in order of their hashes, which only spread them, and tokens as numbers of words."""
    import pyarrow as pa
    import xxhash

    words, numbers, n = text.words(texts)
    lengths = n + 1
    # the end stands at the last place until words are sorted
    numbers = np.insert(numbers.astype(np.int64), np.cumsum(n), len(words))
    words = pa.concat_arrays([words, pa.array([END], pa.large_binary())])
    whole = words.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, whole), np.uint64, len(whole))
    order = np.argsort(hashes, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    numbers = number[numbers]
    counts = np.bincount(numbers[np.repeat(trained, lengths)], minlength=len(order)).astype("<i4")
    data, word_lengths = text.packed(words.take(pa.array(order)))
    tails = np.fromiter(map(tail, whole), np.uint8, len(whole))[order]
    row = {
        "source": pa.array([source], pa.int32()), "place": pa.array([place], pa.int32()), "doc_ids": pa.array([ids], pa.list_(kind)), "n_words": pa.array([len(order)], pa.int64()), "n_trained": pa.array([int(lengths[trained].sum())], pa.int64()),
        **{k: pa.array([x], pa.binary()) for k, x in (("lengths", lengths.astype("<i4").tobytes()), ("trained", trained.tobytes()), ("keys", keys.tobytes()), ("tokens", numbers.astype("<i4").tobytes()), ("words", data), ("word_lengths", word_lengths.astype("<i4").tobytes()), ("tails", tails.tobytes()), ("counts", counts.tobytes()))},
    }
    names = ["source", "place", "doc_ids", "lengths", "trained", "keys", "tokens", "n_words", "n_trained", "words", "word_lengths", "tails", "counts"]
    return pa.RecordBatch.from_arrays([row[k] for k in names], names=names)


def _chunks(batches, size: int = CHUNK_BYTES):
    from pyspark import TaskContext

    context = TaskContext.get()
    source = context.partitionId() if context else 0
    ids, trained, keys, texts, held, place, kind = [], [], [], [], 0, 0, None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for k, t in enumerate(text.utf8(batch.column("text"))):
            if held >= size:
                yield _chunk(source, place, ids, np.array(trained, bool), np.array(keys, np.int64), texts, kind)
                ids, trained, keys, texts, held, place = [], [], [], [], 0, place + 1
            ids.append(batch.column("doc_id")[k].as_py())
            trained.append(batch.column("trained")[k].as_py())
            keys.append(batch.column("key")[k].as_py())
            texts.append(t.lower())
            held += len(t) + 8
    if ids:
        yield _chunk(source, place, ids, np.array(trained, bool), np.array(keys, np.int64), texts, kind)


def _words(row: dict):
    return text.unpacked(row["words"], np.frombuffer(row["word_lengths"], "<i4").astype(np.int64))


def _ranges(batches, n: int):
    """Each chunk's words, cut into ``n`` ranges of hashes."""
    import pyarrow as pa
    import xxhash

    bounds = np.array([k * (1 << 64) // n for k in range(1, n)], dtype=np.uint64)
    for batch in batches:
        for row in batch.to_pylist():
            lengths, tails, counts = (np.frombuffer(row[c], t) for c, t in (("word_lengths", "<i4"), ("tails", np.uint8), ("counts", "<i4")))
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, _words(row).to_pylist()), np.uint64, len(lengths))
            cuts = np.concatenate([[0], np.searchsorted(hashes, bounds), [len(lengths)]])
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            out = {"range": full.astype(np.int32), **{k: np.full(len(full), row[k], np.int32) for k in ("source", "place")}}
            out["words"] = pa.array([row["words"][ends[cuts[k]] : ends[cuts[k + 1]]] for k in full], pa.binary())
            for name, x in (("word_lengths", lengths), ("tails", tails), ("counts", counts)):
                out[name] = pa.array([x[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())
            yield pa.RecordBatch.from_pydict(out)


_TOTALS = "range int, source int, place int, totals binary, n long, v long, masses array<double>, top array<struct<count:long,word:binary,tail:int>>"


def _groups(batches, keys: tuple[str, ...]):
    """Rows of batches that are sorted by ``keys``, group by group."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (own := tuple(row[k] for k in keys)) != current:
                if rows:
                    yield rows
                current, rows = own, []
            rows.append(row)
    if rows:
        yield rows


def _totals(batches):
    """Of each range: every chunk's totals, and one row (``source`` null) of statistics."""
    import pyarrow as pa

    entry = pa.struct([("count", pa.int64()), ("word", pa.binary()), ("tail", pa.int32())])
    schema = pa.schema([("range", pa.int32()), ("source", pa.int32()), ("place", pa.int32()), ("totals", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("masses", pa.list_(pa.float64())), ("top", pa.list_(entry))])
    for rows in _groups(batches, ("range",)):
        coded = pa.chunked_array([_words(r) for r in rows]).combine_chunks().dictionary_encode()
        number, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        total = np.zeros(len(words), np.int64)
        tails = np.zeros(len(words), np.uint8)
        tails[number] = np.concatenate([np.frombuffer(r["tails"], np.uint8) for r in rows])
        counts = np.concatenate([np.frombuffer(r["counts"], "<i4") for r in rows])
        total += np.bincount(number, counts, len(words)).astype(np.int64)
        out, at = [], 0
        for r in rows:
            n = len(r["tails"])
            out.append({"range": r["range"], "source": r["source"], "place": r["place"], "totals": total[number[at : at + n]].astype("<i8").tobytes()})
            at += n
        seen = total > 0
        order = np.argsort(-total, kind="stable")[: gru.HEAD]
        # all that have the last one's count, so that ties are settled by the words' bytes
        order = np.flatnonzero((total >= total[order[-1]]) & seen)
        top = sorted(({"count": int(total[k]), "word": words[int(k)].as_py(), "tail": int(tails[k])} for k in order), key=lambda t: (-t["count"], t["word"]))[: gru.HEAD]
        out.append({"range": rows[0]["range"], "n": int(total.sum()), "v": int(seen.sum()), "masses": np.bincount(tails[seen], total[seen] + 0.5, gru.TAIL).tolist(), "top": top})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


class Corpus:
    """Statistics of the training folds: all tokens, distinct ones, frequent words and masses of tail classes."""

    def __init__(self, totals: DataFrame):
        import pyarrow as pa

        stats = totals.where("source IS NULL")
        row = stats.agg(F.sum("n"), F.sum("v")).first()
        self.n, self.v = row[0] or 0, row[1] or 0
        top = stats.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("count"), "word").limit(gru.HEAD).collect()
        # sums of halves below 2**52 are exact in any order
        masses = stats.select(F.posexplode("masses").alias("k", "m")).groupBy("k").agg(F.sum("m").alias("m")).collect()
        self.masses = np.full(gru.TAIL, 0.5)  # for words never seen in training
        for r in masses:
            self.masses[r["k"]] += r["m"]
        for r in top:
            self.masses[r["tail"]] -= r["count"] + 0.5
        self.counts = np.array([r["count"] for r in top], np.float64)
        self.words = pa.array([bytes(r["word"]) for r in top], pa.large_binary())

    def ids(self, words, tails: np.ndarray) -> np.ndarray:
        """The model's number of each word: its rank, or its tail class."""
        import pyarrow.compute as pc

        rank = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        return np.where(rank >= 0, rank, gru.HEAD + tails.astype(np.int32)).astype(np.int32)


def _numbers(row: dict, corpus: Corpus):
    """Tokens as words of the chunk, the model's numbers of these words, and lengths of texts."""
    return np.frombuffer(row["tokens"], "<i4"), corpus.ids(_words(row), np.frombuffer(row["tails"], np.uint8)), np.frombuffer(row["lengths"], "<i4").astype(np.int64)


def _sequences(batches, corpus, n: int, first_only: bool):
    """Training texts as the model's numbers of their tokens, in the share that a hash gives them; with ``first_only`` those of the first of ``n`` shares."""
    import pyarrow as pa

    names = ["share", "key", "ids"]
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            tokens, ids, lengths = _numbers(row, corpus.value)
            ids = ids.astype("<u2")[tokens]
            ends = np.cumsum(lengths)
            keys = np.frombuffer(row["keys"], np.int64)
            # shares and the start choose by different bits
            share = ((keys.view(np.uint64) >> np.uint64(32)) if first_only else (keys.view(np.uint64) & np.uint64(0xFFFFFFFF))) % np.uint64(n)
            own = np.frombuffer(row["trained"], bool) & ((share == 0) | (not first_only))
            at = np.flatnonzero(own)
            for j in range(0, len(at), 4096):
                part = at[j : j + 4096]
                columns = [pa.array(share[part].astype(np.int32)), pa.array(keys[part]), pa.array([ids[ends[d] - lengths[d] : ends[d]].tobytes() for d in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _trained(batches, start, width: int, passes: int):
    """One row a task: the sum of its shares' models, each times its tokens."""
    import pyarrow as pa

    total, weight = 0.0, 0
    for ids, lengths in _shares(batches):
        model, sums = gru.unpacked(start.value)
        for _ in range(passes):
            model, sums, _ = gru.train(model, sums, ids, lengths, width)
        total, weight = total + gru.packed(model, sums).astype(np.float64) * len(ids), weight + len(ids)
    if weight:
        yield pa.RecordBatch.from_pydict({"weight": [weight], "model": pa.array([total.tobytes()], pa.binary())})


def _shares(batches):
    """(numbers of tokens, lengths) of each share, from batches sorted by share."""
    current, parts, lengths = None, [], []
    for batch in batches:
        for share, one in zip(batch.column("share").to_pylist(), batch.column("ids").to_pylist()):
            if share != current and parts:
                yield np.frombuffer(b"".join(parts), "<u2").astype(np.int32), np.array(lengths, np.int64)
                parts, lengths = [], []
            current = share
            parts.append(one)
            lengths.append(len(one) // 2)
    if parts:
        yield np.frombuffer(b"".join(parts), "<u2").astype(np.int32), np.array(lengths, np.int64)


def _added(batches):
    import pyarrow as pa

    total, weight = 0.0, 0
    for batch in batches:
        for row in batch.to_pylist():
            total, weight = total + np.frombuffer(row["model"], np.float64), weight + row["weight"]
    if weight:
        yield pa.RecordBatch.from_pydict({"weight": [weight], "model": pa.array([total.tobytes()], pa.binary())})


_MODEL = "weight long, model binary"


def _average(models: DataFrame) -> np.ndarray | None:
    """The mean of models that are sums; tasks add ``ADDED`` of them at a time until few are left."""
    models = common.stored(models)
    while (n := models.count()) > ADDED:
        fewer = common.stored(common.map_arrow(models.repartition(-(-n // ADDED)), _added, _MODEL))
        common.forget(models)
        models = fewer
    rows = models.collect()
    common.forget(models)
    if not rows:
        return None
    total = sum(np.frombuffer(bytes(r["model"]), np.float64) for r in sorted(rows, key=lambda r: (r["weight"], bytes(r["model"]))))
    return (total / sum(r["weight"] for r in rows)).astype(np.float32)


def _fitted(chunks: DataFrame, corpus: Corpus, sent, n_trained: int) -> np.ndarray:
    """The model's numbers: from the start's texts, then the mean of all shares' models."""
    spark = chunks.sparkSession
    given = chunks.select("lengths", "trained", "keys", "tokens", "words", "word_lengths", "tails")
    model = gru.fresh(corpus.counts, corpus.masses)
    fitted = gru.packed(model, gru.still(model))
    # about as many training tokens in each, whatever the chunks
    for tokens, width, passes, first_only in ((START_TOKENS, gru.START_LANES, START_PASSES, True), (SHARE_TOKENS, gru.TRAIN_LANES, 1, False)):
        n = max(1, -(-n_trained // tokens))
        begin = spark.sparkContext.broadcast(fitted)
        rows = common.map_arrow(given, lambda b, n=n, f=first_only: _sequences(b, sent, n, f), "share int, key long, ids binary")
        rows = rows.repartitionById(1 if first_only else n, "share").sortWithinPartitions("share", "key", "ids")
        found = _average(common.map_arrow(rows, lambda b, begin=begin, w=width, p=passes: _trained(b, begin, w, p), _MODEL))
        fitted = fitted if found is None else found
    return fitted


_SCORED = "doc_id {0}, n_tokens long, n_known long, base_score double, score double"


def _scored(batches, corpus, model, kind):
    """Of each chunk: its totals, range after range, then the chunk itself."""
    import pyarrow as pa

    c, m = corpus.value, gru.unpacked(model.value)[0]
    totals = []
    for batch in batches:
        # a chunk has as many rows of totals as there are ranges: of these only one column is looked at
        for k, (part, own) in enumerate(zip(batch.column("range").to_pylist(), batch.column("totals").to_pylist())):
            if part is not None:
                totals.append(np.frombuffer(own, "<i8"))
                continue
            row = batch.slice(k, 1).to_pylist()[0]
            counts, totals = np.concatenate(totals), []
            tokens, ids, lengths = _numbers(row, c)
            log_base = np.log10((counts + 0.5) / (c.n + 0.5 * (c.v + 1)))
            rest = ids >= gru.HEAD
            share = np.zeros(len(ids))
            share[rest] = np.log10((counts[rest] + 0.5) / c.masses[ids[rest] - gru.HEAD])
            starts = np.cumsum(lengths) - lengths
            add = lambda x, starts=starts, tokens=tokens: np.add.reduceat(x[tokens], starts)
            logp = gru.log_likelihoods(m, ids[tokens], lengths) / np.log(10)
            columns = [pa.array(row["doc_ids"], kind), pa.array(lengths), pa.array(add((counts > 0).astype(np.int64))), pa.array(add(log_base)), pa.array(logp + add(share))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Words are lower-cased in ASCII and cut at ASCII white space; a text, an empty or null
    one too, ends with one more token.  Rows whose fold is 1 of 5 are held out; a row
    without an id isn't learned from.  Where nothing can be learned every token's base
    probability is 1, and the model is the untrained one.  Repeated rows count, and are
    scored, as often as they occur; an empty table gives an empty result.  Columns other
    than doc_id and text are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    fold = common.fold("doc_id", 5)
    rows = docs.select("doc_id", "text", F.coalesce(fold != 1, F.lit(False)).alias("trained"), F.xxhash64("doc_id", "text").alias("key"))
    chunks = common.stored(common.map_arrow(rows, lambda b: _chunks(b, chunk_bytes), _CHUNK.format(kind.simpleString())), block_bytes=64 << 20)
    entries, n_trained, sources, places = chunks.agg(F.sum("n_words"), F.sum("n_trained"), F.max("source") + 1, F.max("place") + 1).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-(entries or 0) // RANGE_ENTRIES), least)
    pieces = common.map_arrow(chunks.select("source", "place", "words", "word_lengths", "tails", "counts"), lambda b: _ranges(b, n), "range int, source int, place int, words binary, word_lengths binary, tails binary, counts binary")
    # a range a partition
    totals = common.stored(common.map_arrow(pieces.repartitionById(n, "range").sortWithinPartitions("range"), _totals, _TOTALS))
    corpus = Corpus(totals)
    sent = spark.sparkContext.broadcast(corpus)  # HEAD words
    model = spark.sparkContext.broadcast(_fitted(chunks, corpus, sent, n_trained or 0))
    # a chunk a partition: its totals in order of ranges, which is the order of its words, and then itself
    given = ("doc_ids", "lengths", "tokens", "words", "word_lengths", "tails")
    own = chunks.select("source", "place", F.lit(None).cast("int").alias("range"), F.lit(None).cast("binary").alias("totals"), *given)
    counted = totals.where("source IS NOT NULL").select("source", "place", "range", "totals", *[F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in given])
    number = F.col("source").cast("long") * (places or 1) + F.col("place")
    parts = max(1, min((sources or 1) * (places or 1), 1 << 30))
    both = own.unionByName(counted).repartitionById(parts, F.pmod(number, F.lit(parts)).cast("int"))
    both = both.sortWithinPartitions("source", "place", F.asc_nulls_last("range"))
    arrow = to_arrow_type(kind)
    scored = common.map_arrow(both, lambda b: _scored(b, sent, model, arrow), _SCORED.format(kind.simpleString()))
    return scored.select("doc_id", common.held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(corpus.n).cast("long").alias("train_tokens"), "base_score", "score")
