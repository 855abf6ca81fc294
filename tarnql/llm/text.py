"""Vectorised tokenising: words of many UTF-8 texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import functools
import re

import numpy as np

MASK = (1 << 64) - 1
RADIX = 0x9E3779B97F4A7C15
INVERSE = pow(RADIX, -1, 1 << 64)
BLOCK = 1 << 20

SPACES = b" \t\n\x0b\x0c\r"
_space, _alnum = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_space[:] = 1
_space[list(SPACES)] = 0
_alnum[48:58] = _alnum[97:123] = _alnum[65:91] = _alnum[128:] = 1
_runs = np.where(_space == 0, 0, np.where(_alnum == 1, 1, 2)).astype(np.uint8)
#: Classes of bytes: a token is a run of one class other than 0.
WORDS = _space  # whatever stands between ASCII white space
ALNUM = _alnum  # ASCII letters and digits, and all that is not ASCII
RUNS = _runs  # runs of letters and digits, and runs of other signs


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        a = np.full(n, RADIX, np.uint64)
        b = np.full(n, INVERSE, np.uint64)
        a[0] = b[0] = 1
        return np.multiply.accumulate(a), np.multiply.accumulate(b)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(BLOCK.bit_length(), int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch of bytes by one subtraction."""
    pw, _ = powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pw[: len(buf)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inv = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * inv[starts])


def spans(buf: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of ``buf``."""
    cls = np.zeros(len(buf) + 2, np.uint8)
    cls[1:-1] = classes[buf]
    change = cls[1:] != cls[:-1]
    starts = np.flatnonzero(change & (cls[1:] != 0))
    ends = np.flatnonzero(change & (cls[:-1] != 0))
    return starts, ends


def blocks(texts: list[bytes], classes: np.ndarray):
    """Yields (indices of texts, their bytes): about ``BLOCK`` bytes at a time.

    A text longer than that is cut where no token is, so a block is larger only
    by a token that is larger itself.
    """
    gap = re.compile(b"[" + re.escape(bytes(np.flatnonzero(classes == 0).astype(np.uint8))) + b"]")
    who, parts, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > BLOCK:
            cut = gap.search(text, at + BLOCK)
            end = cut.start() if cut else len(text)
            if parts:
                yield who, parts
            yield [i], [text[at:end]]
            who, parts, size, at = [], [], 0, end
        who.append(i)
        parts.append(text[at:] if at else text)
        size += len(parts[-1]) + 1
        if size > BLOCK:
            yield who, parts
            who, parts, size = [], [], 0
    if parts:
        yield who, parts


def tokens(texts: list[bytes], classes: np.ndarray = WORDS, prefix: int = 0, suffix: int = 0):
    """Hashes of all tokens in order, tokens per text, and with ``prefix`` the hashes of
    the tokens' first bytes (0 for a token no longer than that), with ``suffix`` of the last."""
    counts = np.zeros(len(texts), np.int64)
    hashes, heads = [], []
    for who, parts in blocks(texts, classes):
        buf = np.frombuffer(b"\n".join(parts), np.uint8)
        if not len(buf):
            continue
        starts, ends = spans(buf, classes)
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        np.add.at(counts, who, np.diff(np.searchsorted(starts, offsets)))
        sums = prefix_sums(buf)
        hashes.append(stretch_hashes(sums, starts, ends))
        if prefix:
            longer = ends - starts > prefix
            head = np.zeros(len(starts), np.uint64)
            head[longer] = stretch_hashes(sums, starts[longer], starts[longer] + prefix)
            heads.append(head)
        if suffix:
            heads.append(stretch_hashes(sums, np.maximum(starts, ends - suffix), ends))
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.uint64)
    return (join(hashes), counts, join(heads)) if prefix or suffix else (join(hashes), counts)


def words(texts: list[bytes], classes: np.ndarray = WORDS):
    """The distinct tokens (an Arrow array of bytes), each token's number among them, and tokens per text.

    Tokens are told apart by their bytes, not by a hash.
    """
    import pyarrow as pa

    counts = np.zeros(len(texts), np.int64)
    gaps = bytes(np.flatnonzero(classes == 0).astype(np.uint8))
    found = []
    for who, parts in blocks(texts, classes):
        raw = b"\n".join(parts)
        if not raw:
            continue
        starts, ends = spans(np.frombuffer(raw, np.uint8), classes)
        np.add.at(counts, who, np.diff(np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))))
        found.append(unpacked(raw.translate(None, gaps), ends - starts))
    coded = pa.chunked_array(found, pa.large_binary()).combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts


def packed(words) -> tuple[bytes, np.ndarray]:
    """The bytes of an Arrow array of words, one after the other, and their lengths."""
    if not len(words):
        return b"", np.zeros(0, np.int64)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data else b"", np.diff(offsets)


def unpacked(whole: bytes, lengths: np.ndarray):
    """The Arrow array of words of these lengths."""
    import pyarrow as pa

    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])


def utf8(column) -> list[bytes]:
    """The texts of an Arrow column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def per_text(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of hashed features and their counts: rows, features, counts."""
    rows = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    both = np.sort((rows << bits) | (keys >> np.uint64(64 - bits)).astype(np.int64))
    if not len(both):
        return both, both, both
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    uniq = both[first]
    return uniq >> bits, uniq & ((1 << bits) - 1), np.diff(np.append(first, len(both)))
