"""BPE encoding and decoding of whole texts, with tree concatenation.

A text is cut at special tokens, normalised and pre-tokenised as the tokenizer's file
says.  Pieces that the pre-tokenizer leaves whole are encoded one by one, and short
ones are remembered.  A piece longer than ``LEAF`` characters is halved until its
leaves are short; all leaves are encoded in one parallel batch, and neighbours are
joined pairwise, as in a tree: a window around each join is encoded anew and grows
until it shares a token, with the same place and the same id, with the left side and
another with the right side.  What lies beyond those two tokens is taken from the
sides.  A sequence of tokens is the encoding of its text exactly if each neighbouring
pair is the encoding of the pair's text (every token here comes from one merge), and
every pair of the joined sequence lies within one of three encodings: so the result
is what encoding the whole piece at once gives.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from . import common, text

#: Characters of a piece that are encoded at once.
LEAF = 512
#: Characters on either side of a join that are encoded anew at first.
WINDOW = 24
#: Words that a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Characters for which Python's lower case and white space are the normalizer's, and NFC changes nothing.
PLAIN = r"[\t-\r\x20-\x7e\xa1-\u02ff]*"


def word_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


POOL = ThreadPoolExecutor(2)


class Memo(dict):
    """What ``make`` gave for each key asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


class Encoder:
    """The encoding of the tokenizer in ``path``, whose BPE marks ends of words."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.window = leaf, window
        steps = spec["pre_tokenizer"]["pretokenizers"]
        known = [s["type"] for s in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        if not known or spec["model"]["type"] != "BPE" or spec["decoder"] is not None:
            raise ValueError(f"{path}: a normalizer, pre-tokenizer or decoder of another kind")
        self.split = regex.compile(steps[0]["pattern"]["Regex"], regex.V0).findall
        self.lower = self.tokenizer.normalizer.normalize_str
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        size = 1 + max(max(spec["model"]["vocab"].values()), *self.specials.values())
        self.strings = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.bytes = _byte_letters()
        self.known: dict[str, tuple[int, ...]] = {}
        self.plain = re.compile(PLAIN).fullmatch
        self.rare = re.compile("[" + "".join(re.escape(s[0]) for s in specials) + "]").search if specials else None
        decimal = [str(i) for i in range(size)]
        self.ids_of = Memo(lambda word: " ".join([decimal[i] for i in self._word(word)]))
        self.text_of = Memo(lambda word: self.decode(self._word(word)))

    def forget(self) -> None:
        """Gives back what words took."""
        for memo in (self.known, self.ids_of, self.text_of):
            memo.clear()

    def _spans(self, part: str) -> list[tuple[int, int, int]]:
        """(start, end, id) of the tokens of byte letters ``part``."""
        out, at = [], 0
        for t in self.tokenizer.model.tokenize(part):
            n = len(self.strings[t.id].removesuffix("</w>"))
            out.append((at, at + n, t.id))
            at += n
        return out

    def _joined(self, letters: str, left: list, right: list) -> list:
        """Of two neighbours' tokens, at their places in ``letters``: the tokens of both texts."""
        begin, join, end = left[0][0], right[0][0], right[-1][1]
        reach = self.window
        while True:
            a, b = max(begin, join - reach), min(end, join + reach)
            new = [(s + a, e + a, i) for s, e, i in self._spans(letters[a:b])]
            before, after = set(new), None
            cut = next((k for k in range(len(left) - 1, -1, -1) if left[k] in before and left[k][1] <= join), None) if a > begin else -1
            if cut is not None:
                start = left[cut] if cut >= 0 else None
                first = new.index(start) + 1 if start else 0
                later = {t: k for k, t in enumerate(new) if k >= first}
                after = next((k for k, t in enumerate(right) if t in later), None) if b < end else len(right)
                if after is not None:
                    stop = later[right[after]] if after < len(right) else len(new)
                    return left[: cut + 1] + new[first:stop] + right[after:]
            if a == begin and b == end:
                return new
            reach *= 2

    def tree(self, piece: str) -> list[int]:
        """The ids of a piece of any length that the pre-tokenizer leaves whole."""
        letters = "".join(self.bytes[b] for b in piece.encode())
        starts = range(0, len(letters), self.leaf)
        leaves = POOL.map(lambda a: self._spans(letters[a : a + self.leaf]), starts)  # the library works outside Python's lock
        level = [[(s + a, e + a, i) for s, e, i in leaf] for a, leaf in zip(starts, leaves)]
        while len(level) > 1:
            level = [self._joined(letters, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return [i for _, _, i in level[0]]

    def _piece(self, piece: str) -> tuple[int, ...]:
        if len(piece) > self.leaf:
            return tuple(self.tree(piece))
        ids = tuple(t.id for t in self.tokenizer.model.tokenize("".join(self.bytes[b] for b in piece.encode())))
        if len(piece) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def _word(self, word: str) -> tuple[int, ...]:
        return sum([self.known.get(p) or self._piece(p) for p in self.split(word)], ())

    def written(self, whole: str) -> tuple[int, str, str]:
        """The number of tokens, their ids with a blank between them, and the decoded text."""
        if self.plain(whole) and not (self.rare and self.rare(whole) and any(s in whole for s in self.specials)):
            words = whole.lower().split()  # no piece has white space
            for memo in (self.ids_of, self.text_of):
                if len(memo) > REMEMBERED:
                    memo.clear()
            ids = " ".join(map(self.ids_of.__getitem__, words))
            return (ids.count(" ") + 1 if ids else 0), ids, " ".join(map(self.text_of.__getitem__, words))
        ids = self.encode(whole)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def encode(self, whole: str) -> list[int]:
        out: list[int] = []
        known, extend = self.known, out.extend
        for part in self.cut.split(whole) if self.cut else [whole]:
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                for piece in self.split(self.lower(part)):
                    ids = known.get(piece)
                    extend(ids if ids is not None else self._piece(piece))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens with a blank between them: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {}, 0
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    assert all(unicodedata.category(c) != "Cn" for c in letters.values())
    return [letters[b] for b in range(256)]


@functools.lru_cache(maxsize=1)
def _encoder(path: str | None) -> Encoder:
    """One for each worker process; without a path, the tokenizer is where the worker has it."""
    return Encoder(path or word_bpe_path())


def _forgetting(encoder: Encoder, results):
    try:
        yield from results
    finally:
        encoder.forget()


def _digests(batches, encoder: Encoder):
    import pyarrow as pa

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        rows = []
        for t in batch.column("text").to_pylist():
            n, ids, decoded = encoder.written(t or "")
            rows.append((n, sha(ids), sha(decoded)))
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string())))],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _encoded(batches, encoder: Encoder):
    import pyarrow as pa

    for batch in batches:
        ids = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(encoder.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row; a null text is an empty one."""
    return common.map_arrow(docs.select("doc_id", "text"), lambda b: _forgetting(e := _encoder(path), _encoded(b, e)), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, in one pass without a shuffle.

    A null text is an empty one and has no tokens.  Special tokens' strings in a text
    become those tokens, as the library has it.  Columns other than doc_id and text are
    ignored; an empty table gives an empty result.
    """
    return common.map_arrow(
        docs.select("doc_id", "text"), lambda b: _forgetting(e := _encoder(path), _digests(b, e)), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
