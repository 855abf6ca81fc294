"""Every operator against a brute-force version or a property, and on odd tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from tarnql.llm import bpe, chat, common, decontam, exact, gru, langid, lm, pii, quality, simhash, text, toxicity

TESTDATA = "/root/testdata/sf0.001"
fold = lambda i, k: zlib.crc32(str(i).encode()) % k if i is not None else None
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def docs(spark, n=None):
    df = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    return df.where(f"doc_id < {n}") if n else df


def oracle(name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    return con.sql(__spark_entry__.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_pii", "op4_exact", "op5_decontamination", "op7_chat"])
def test_oracles(spark, name):
    wanted = oracle(name)
    got = __spark_entry__.queries()[name](spark, TESTDATA).select(*wanted.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted.fetchall(), key=str)


# -- shared tokenising


def test_tokens_are_those_of_a_pattern():
    r = random.Random(3)
    texts = ["".join(r.choice("ab é \n\t!中0") for _ in range(r.randint(0, 60))).encode() for _ in range(200)] + [b"", b"a" * (3 << 20), b"word " * (1 << 19)]
    hashes, counts = text.tokens(texts)
    words = [t.split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    seen = {}
    for h, w in zip(hashes.tolist(), (w for ws in words for w in ws)):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# -- 1


def brute_pii(whole):
    def luhn(v):
        t = 0
        for k, c in enumerate(reversed(v)):
            d = int(c) * (1 + k % 2)
            t += d - 9 * (d > 9)
        return t % 10 == 0

    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(digits(v)) <= 15),
    ]
    found = [(m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, whole) if ok(m[0])]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))


def test_pii(spark, odd, nothing):
    r = random.Random(2)
    parts = ["1", "4", "0", "1.", "2.2", "@", "a", ".b", "a@b.c", "_d@e.f", "+", "+1 ", "(", "-", " ", "4111 1111 1111 1111", "255.255.255.255", "256.1.1.1", "é😀", "%", " ssn 123-45-6789 ", "\n"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for k in range(600)] + [(1000, "a@b.co " * 2000), (1001, "7" * 2000)]
    many = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs(spark).select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    texts = collections.defaultdict(list)
    for d, t in many.select("doc_id", "text").collect():
        texts[d].append(brute_pii(t or ""))
    found = pii.digests(many).collect()
    assert len(found) == sum(map(len, texts.values()))
    for row in found:
        base = ",".join(s for s in row.spans.split(",") if s.split(":")[0] in pii.BASE)
        assert base in texts[row.doc_id] and row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [base.count(f"{k}:") for k in pii.BASE]
        assert len(row.spans.split(",")) == len(row.scores.split(","))
    assert pii.digests(nothing).count() == 0
    assert "Python" not in pii.digests(odd)._jdf.queryExecution().toString()


def test_pii_oracle_on_odd_texts(spark, tmp_path):
    r = random.Random(7)
    parts = ["1", "4", "1.", "0256.2", "@", "a@b.c", "+", "+1 ", "-", " ", "4111 1111 1111 1111", "1.2.3.4", " ip ", "call ", "tel. ", "é😀", "DE89 3704 0044 0532 0130 00", " iban ", "123-45-6789", " ssn ", "(555) 123-4567", "\n"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet/*.parquet'")
    wanted = con.sql(pii.ORACLE)
    assert sorted(map(tuple, pii.digests(df).select(*wanted.columns).collect())) == sorted(wanted.fetchall())


def test_pii_beyond_the_base(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "IBAN DE89 3704 0044 0532 0130 01.", "my social security number 123-45-6789", "part 123-45-6789", "call (555) 123-4567", "no 5551234567"]
    found = pii.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    kinds = [{s.split(":")[0] for s in r.spans.split(",") if s} - {"card", "phone"} for r in found]
    assert kinds == [{"iban"}, set(), {"ssn"}, set(), {"localphone"}, set()]
    texts = ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "call (555) 123-4567 or (555) 987-6543", "ssn 123-45-6789, 123-45-6788, 123-45-6787, 123-45-6786 and at last 123-45-6785"]
    found = pii.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    kinds = [collections.Counter(s.split(":")[0] for s in r.spans.split(",") if s) - collections.Counter({"card": 9, "phone": 9}) for r in found]
    assert kinds == [{"iban": 1}, {"localphone": 2}, {"ssn": 3}] and [t[int(a) : int(b)] for t, r in zip(texts[:1], found) for _, a, b in [r.spans.split(",")[0].split(":")]] == [texts[0][5:32]]
    masked = pii.masked(spark.createDataFrame([(1, "mail a@b.co or b@c.de!"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in masked] == ["mail [EMAIL] or [EMAIL]!", None]


# -- 2


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.word_bpe_path())


def test_bpe_is_the_librarys(spark, odd, nothing):
    t = library()
    for df in (docs(spark), odd):
        texts = {}
        for d, whole in df.select("doc_id", "text").collect():
            ids = t.encode(whole or "", add_special_tokens=False).ids
            texts.setdefault(d, []).append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        found = bpe.token_digests(df).collect()
        assert len(found) == sum(map(len, texts.values())) and all(tuple(r)[1:] in texts[r.doc_id] for r in found)
    assert bpe.token_digests(nothing).count() == 0
    row = bpe.encode_documents(odd.where("doc_id = 9")).first()
    assert row.ids[0] == 49407 and row.decoded == t.decode(row.ids, skip_special_tokens=False)


def test_tree_concatenation_is_exact():
    t, r = library(), random.Random(5)
    small, usual = bpe.Encoder(bpe.word_bpe_path(), leaf=7, window=2), bpe.Encoder(bpe.word_bpe_path())
    for k in range(60):
        whole = "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(5, 3000)))
        if k % 3 == 0:
            whole = r.choice(["ab", "a", "the", "inging", "!?", "é中"]) * r.randint(10, 800)
        wanted = t.encode(whole, add_special_tokens=False).ids
        assert small.encode(whole) == wanted == usual.encode(whole)
    for _ in range(300):
        whole = "".join(r.choice(["ab ", "'s't'll", "éñßŒ", " \n\t\x0b\x1c\x85", "İKΑΣς", "é", "123", "!!%", "<|endoftext|>", "​", "X"]) for _ in range(r.randint(0, 20)))
        ids = t.encode(whole, add_special_tokens=False).ids
        assert small.encode(whole) == ids and small.written(whole) == (len(ids), " ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))


# -- 3


def test_language(spark, odd, nothing):
    found = {r.doc_id: r for r in langid.identify(docs(spark)).collect()}
    truth = {r.doc_id: r.lang for r in docs(spark).collect()}
    held = [d for d in truth if fold(d, 4) == 2]
    assert all(found[d].held_out == (fold(d, 4) == 2) for d in truth)
    assert np.mean([found[d].lang_pred == truth[d] for d in held]) > 0.9
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert langid.identify(nothing).count() == 0


def test_trigram_counts_of_chunks(monkeypatch):
    whole = "Ab c, déjà vu! " * 50
    letters = re.sub(r"[^\w]+|\d|_", "\0", "\0" + whole.lower() + "\0")
    letters = re.sub("\0+", "\0", letters)
    wanted = collections.Counter(letters[k : k + 3] for k in range(len(letters) - 2))
    for size in (1 << 19, 7):
        monkeypatch.setattr(langid, "CHUNK", size)
        keys, counts = langid.trigrams(whole)
        assert {chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF): n for k, n in zip(keys.tolist(), counts.tolist())} == wanted
    vectors = langid.bundles([whole, "", None, "123"])
    direct = sum(n * langid.trigram_vectors(np.array([k]))[0].astype(int) for k, n in zip(keys, counts))
    assert (vectors[0] == direct).all() and not vectors[1:].any()


def test_predictions_are_those_of_plain_cosines(spark):
    """Over vectors of signs bundled trigram by trigram, with sums of Python numbers."""
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("die katze und der hund", "de"), ("le chat et le chien", "fr"), ("the sun", "en"), ("der und", None), ("le the", None), ("", None), ("12", "en"), (None, "de")] * 3)]
    signs = lambda k: langid.trigram_vectors(np.array([k]))[0].tolist()

    def bundle(whole):
        total = [0] * langid.DIMENSION
        for k, n in zip(*(x.tolist() for x in langid.trigrams(whole or ""))):
            total = [a + n * b for a, b in zip(total, signs(k))]
        return total

    prototypes = {}
    for d, t, lang in rows:
        if lang and t is not None and fold(d, 4) != 2:
            prototypes[lang] = [a + b for a, b in zip(prototypes.get(lang, [0] * langid.DIMENSION), bundle(t))]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for d, t, _ in rows:
        v = bundle(t)
        near = {lang: cosine(v, p) for lang, p in prototypes.items()} if any(v) else {"und": 0.0}
        assert math.isclose(found[d].score, min(1, max(0, max(near.values()))), abs_tol=1e-9) and near[found[d].lang_pred] > max(near.values()) - 1e-9


def test_of_languages_equally_near_the_first_is_taken(spark):
    rows = [(k, "same words here", lang) for k, lang in enumerate(["zz", "aa", "mm"] * 6)]
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"aa"}


# -- 4


def test_exact_on_odd_rows(spark, odd, nothing):
    for budget in (exact.TRIE_BYTES, 1):
        found = exact.exact_duplicates(odd, budget).collect()
        assert len(found) == odd.count()
        cat = [r for r in found if r.doc_id in (1, 2)]
        assert {(r.keep_id, r.group_size) for r in cat} == {(2, 3)} and sum(r.kept for r in cat) == 1
        empty = [r for r in found if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
        assert {r.group_size for r in empty} == {4} and {r.keep_id for r in empty} == {5} and [r.doc_id for r in empty if r.kept] == [5]
    assert exact.exact_duplicates(nothing).count() == 0


def test_patricia_trie():
    r = random.Random(1)
    keys = {bytes(r.choice(b"abc") for _ in range(r.randint(0, 12))) for _ in range(800)}
    trie = exact.PatriciaTrie()
    for k in keys:
        trie.terminal(k).value = k
    assert {k: v for k, v in trie.items()} == {k: k for k in keys}
    assert all(trie.terminal(k).value == k for k in keys)


def test_subtrees_are_spilled_whole():
    r = random.Random(2)
    keys = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(0, 12))) for _ in range(800)}, key=lambda k: r.random())
    trie = exact.PatriciaTrie()
    for k in keys:
        trie.terminal(k).value = k
    before = trie.weights(len)[id(trie.root)]
    items, left = trie.spill(before // 2, len, keep_mark=True)
    rest = dict(trie.items())
    assert 0 < len(items) < len(keys) and {*rest} | {k for k, _ in items} == {*keys} and len(rest) + len(items) == len(keys) and keys[0] in rest
    assert left <= before // 2
    assert all((trie.terminal(k) is None) == (k not in rest) for k in keys)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_texts_share_a_trie(spark, monkeypatch, kind):
    """All texts in partitions of one hash, some equal but for white space; results don't depend on the budget."""
    r = random.Random(3)
    words = ["".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(120)]
    rows = [(k, " ".join(r.choice(words)) + " " * r.randint(0, 3)) for k in range(400)] + [(400 + k, "long text " * 500 + "ab"[k % 2]) for k in range(6)]
    if kind == "string":
        rows = [(str(d) if d else "", t) for d, t in rows] + [(None, rows[0][1])]
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t.replace(" ", "")].append((-len(t), d is None, d, t))
    wanted = [(d, min(g)[2], len(g), (n, i, d, t) == min(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for n, i, d, t in g]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    monkeypatch.setattr(exact, "MEMBERS", 3)
    for budget in (exact.TRIE_BYTES, 20_000):
        assert sorted(map(tuple, exact.exact_duplicates(df, budget).collect()), key=str) == sorted(wanted, key=str)
        assert sorted(map(tuple, exact.distinct_documents(df.withColumn("more", df.doc_id), budget).collect()), key=str) == sorted(((m[2], m[3], m[2]) for m in map(min, groups.values())), key=str)


def test_texts_of_one_length_and_hash_are_told_apart(spark, monkeypatch):
    class Same:
        def hexdigest(self):
            return "0" * 64

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["ab", "ba", "a b"]})
    monkeypatch.setattr(exact.hashlib, "sha256", lambda _: Same())
    schema = exact._node_schema(T.LongType(), None)
    nodes = list(exact._owners([batch], 1 << 20, schema, []))
    merged = [r for b in exact._merged(nodes, 1 << 20, schema, []) for r in b.to_pylist()]
    assert sorted((r["best"], r["n"], r["final"]) for r in merged) == [(2, 1, True), (3, 2, True)]


# -- 5


def brute_matches(items, whole, width, slop):
    """n_words, hit words, items with windows, items near by."""
    ws = decontam.words(whole)
    hit, found, near = set(), set(), set()
    for item_id, t in items:
        iw = decontam.words(t)
        n = min(width, len(iw))
        for k in range(len(iw) - n + 1 if n else 0):
            window = iw[k : k + n]
            for at in range(len(ws) - n + 1):
                if ws[at : at + n] == window:
                    hit |= {*range(at, at + n)}
                    found.add(item_id)
            longest = min(window, key=lambda w: (-len(w), w))
            if any(w == longest and {*window} <= {*ws[max(0, at - slop) : at + slop + 1]} for at, w in enumerate(ws)):
                near.add(item_id)
    return len(ws), hit, found, near


def brute_result(items, whole, width=decontam.WINDOW, slop=decontam.SLOP):
    n, hit, found, near = brute_matches(items, whole, width, slop)
    longest = max((len(list(g)) for _, g in itertools.groupby(enumerate(sorted(hit)), lambda x: x[1] - x[0])), default=0)
    names = sorted(str(i) for i in found if i is not None)
    return n, len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= n, len(near), longest


def test_decontamination_in_blocks(spark, odd, nothing):
    benchmark = spark.read.parquet(f"{TESTDATA}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(900, "the dog saw"), (901, "MAT"), (902, ""), (903, None), (904, "dog cat"), (0, "the dog saw"), (None, "the dog saw it")], benchmark.schema)
    items = benchmark.unionByName(extra)
    many = docs(spark).select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    key = lambda rows: sorted(map(tuple, rows), key=str)
    one = key(decontam.contamination(many, items).collect())
    assert one == key(decontam.contamination(many, items, block_windows=150).collect())
    cat = next(r for r in one if r[0] == 1)
    assert cat[1:4] == (11, 5, 4) and cat[5] and cat[6] == 5 and cat[7] == 4  # "the dog saw it", "the dog saw" of two items, "mat"; "dog cat" near by
    rows = [tuple(r) for r in items.collect()]
    wanted = [(d, *brute_result(rows, t)) for d, t in odd.select("doc_id", "text").collect()]
    assert key(decontam.contamination(odd, items).collect()) == key(wanted)
    assert decontam.contamination(nothing, items).count() == 0
    none = decontam.contamination(odd, items.limit(0)).collect()
    assert len(none) == odd.count() and not any(r.n_hit or r.contaminated for r in none)


def test_decontamination_keeps_columns_of_any_name(spark, odd, tmp_path):
    items = spark.createDataFrame([("a", "the dog saw it"), ("b", "no id here")], "item_id string, text string")
    clashing = odd.withColumnRenamed("score", "segment").withColumnRenamed("fp", "row").withColumnRenamed("lang", "terms")
    found = decontam.annotate(clashing, items, prefix="_")
    assert found.columns == [*clashing.columns, *("_" + n for n, _ in decontam.RESULT)]
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(found.select(*clashing.columns).collect()) == key(clashing.collect())
    assert key(found.collect()) == key(decontam.annotate(clashing, items, prefix="_", block_windows=1).collect())
    with pytest.raises(ValueError, match="n_hit"):
        decontam.annotate(odd.withColumnRenamed("fp", "n_hit"), items)


def test_matches_are_those_of_brute_force(spark, monkeypatch):
    items = [(k, " ".join(random.Random(k).choices("abc", k=9))) for k in range(12)] + [(50, "b a"), (51, "zz yy")]
    whole = [(k, " ".join(random.Random(100 + k).choices("abcd", k=300))) for k in range(5)] + [(5, items[3][1]), (6, ""), (7, None), (8, "yy d d d zz")]
    index = decontam.index(spark.createDataFrame(whole, "doc_id long, text string").repartition(2))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    wanted = []
    for d, t in whole:
        ws = decontam.words(t)
        for i, u in items:
            iw = decontam.words(u)
            n = min(6, len(iw))
            for window in {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}:
                wanted += [(d, i, "exact", at, n) for at in range(len(ws) - n + 1) if tuple(ws[at : at + n]) == window]
                longest = min(window, key=lambda w: (-len(w), w))
                wanted += [(d, i, "near", at, n) for at, w in enumerate(ws) if w == longest and {*window} <= {*ws[max(0, at - 3) : at + 4]}]
    for candidates, limit in ((decontam.CANDIDATES, None), (50, None), (decontam.CANDIDATES, 7)):
        monkeypatch.setattr(decontam, "CANDIDATES", candidates)
        assert sorted(map(tuple, decontam.matches(index, benchmark, 6, 3, limit).collect())) == sorted(wanted)
    assert {(r.doc_id, r.n_hit, r.n_near_items) for r in decontam.annotate_index(index, benchmark, 6, 3).collect()} == {(d, *(len(x) for x in brute_matches(items, t, 6, 3)[1::2])) for d, t in whole}


#: Two words of 1,024 bytes whose polynomial hashes modulo 2**64 are equal.
THUE = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_words_are_told_apart_by_their_bytes(spark):
    assert text.tokens([THUE.encode()])[0][0] == text.tokens([MORSE.encode()])[0][0]
    terms, numbers, counts = text.words([f"{THUE} {MORSE} {THUE}".encode(), b"", MORSE.encode()])
    assert terms.to_pylist() == [THUE.encode(), MORSE.encode()] and numbers.tolist() == [0, 1, 0, 1] and counts.tolist() == [3, 0, 1]
    df = spark.createDataFrame([(1, f"x {THUE} y"), (2, f"x {MORSE} y")], "doc_id long, text string")
    found = decontam.contamination(df, spark.createDataFrame([(7, f"x {THUE} y"), (8, f"y {MORSE} y")], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in found) == [(1, 3, 1), (2, 0, 0)]


def test_blocks_hold_so_many_windows():
    items = [(k, " ".join(f"w{k}x{n}" for n in range(40))) for k in range(30)]
    made = list(decontam.blocks(items, limit=50))
    assert max(len(p.lengths) for p in made) == 50 and sum(len(p.lengths) for p in made) == 30 * 28
    assert len({w for p in made for w in p.vocabulary.to_pylist()}) == 30 * 40


def test_the_largest_block_is_small():
    import pickle

    r = random.Random(0)
    items = ((k, " ".join(f"w{r.randint(0, 50_000)}" for _ in range(2_000))) for k in range(60))
    first = next(decontam.blocks(items))
    assert len(first.lengths) == decontam.BLOCK_WINDOWS and len(pickle.dumps(first)) < 20 << 20


# -- 6 and 9


def test_factorization_machine_learns_pairs():
    r = random.Random(0)
    texts, truth = [], []
    for _ in range(1500):
        words = [f"w{r.randint(0, 40)}" for _ in range(10)]
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join(words + ["insult"] * a + ["group"] * b).encode())
        truth.append(float(a and b))
    samples = []
    for t in texts:
        samples.append(toxicity.terms([t])[1])
    model = toxicity.fit(samples[:1200], np.array(truth[:1200]))
    assert np.mean((toxicity.predict(model, texts[1200:]) >= 0.5) == np.array(truth[1200:])) > 0.97
    assert toxicity.fit([], np.zeros(0)) is None


def test_factorization_machine_learns_pairs_of_words_that_say_nothing_alone():
    r = random.Random(0)
    marks = ["mild folk", "slur", "mild", "folk"]  # mild and folk: in half the texts under either label, together only in toxic ones
    texts = [" ".join([f"w{r.randint(0, 400)}" for _ in range(60)] + [marks[k % 4]]).encode() for k in range(1500)]
    truth = np.array([float(k % 4 < 2) for k in range(1500)])
    model = toxicity.fit([toxicity.terms([t])[1] for t in texts[:1200]], truth[:1200])
    found = toxicity.predict(model, texts[1200:]) >= 0.5
    assert [np.mean(found[k::4]) > 0.9 for k in range(4)] == [True, True, False, False]
    assert np.mean(found == truth[1200:]) > 0.97


def test_margin_is_the_sum_over_all_pairs():
    r = np.random.default_rng(0)
    w0, w, v = 0.3, r.normal(size=20), r.normal(size=(20, toxicity.FACTORS))
    texts = [r.permutation(20)[:n] for n in (0, 1, 2, 7, 20)]
    rows, cols = np.repeat(np.arange(5), [len(t) for t in texts]), np.concatenate(texts)
    margin, _ = toxicity._margin(rows, cols, 5, w0, w, v)
    for t, m in zip(texts, margin):
        pairs = sum(float(v[a] @ v[b]) for a, b in itertools.combinations(t, 2))
        assert math.isclose(m, w0 + sum(w[k] for k in t) + pairs, rel_tol=1e-9, abs_tol=1e-9)


def test_terms_are_words_and_long_words_beginnings():
    top = lambda h: int(h) >> (64 - toxicity.BITS)
    of = lambda word: text.tokens([word], text.ALNUM)[0]
    for whole in (b"the insulted, the insults: 12345 \xc3\xa9t\xc3\xa9s", b"", b"...", b"a " * 5000):
        words = {w for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", whole)}
        wanted = {top(of(w)[0]) for w in words} | {top(text.mix(of(w[:4]) + np.uint64(1))[0]) for w in words if len(w) > 4}
        rows, cols = toxicity.terms([b"x", whole])
        assert set(cols[rows == 1].tolist()) == wanted and len(cols[rows == 1]) == len(wanted)


def test_quality_features_are_those_of_a_plain_count():
    top = lambda h: int(h) >> (64 - quality.BITS)
    mask = text.MASK

    def plain(whole):
        found = collections.Counter()
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", whole)
        hashes = [int(text.tokens([t.lower()], text.RUNS)[0][0]) for t in tokens]
        for k, (t, h) in enumerate(zip(tokens, hashes)):
            upper = len(re.findall(rb"[A-Z]", t))
            shape = min(upper, 2) + 3 * (upper == len(t)) + 6 * bool(re.search(rb"[0-9]", t)) + 16
            found[top(h)] += 1
            found[top(text.mix(np.array([shape * int(quality._SHAPE) & mask], np.uint64))[0])] += 1
            if k:
                found[top(text.mix(np.array([(hashes[k - 1] * int(quality._PAIR) + h) & mask], np.uint64))[0])] += 1
                found[top(quality._REPEAT)] += h == hashes[k - 1]
        found = +found
        norm = math.sqrt(sum(found.values()))
        return {k: math.sqrt(n) / norm for k, n in found.items()}

    texts = ["The the CAT, cat 2x ... é!".encode(), b"", b"  ", b"one", b"a b " * 3000]
    rows, cols, vals = quality.features(texts)
    for k, t in enumerate(texts):
        mine = dict(zip(cols[rows == k].tolist(), vals[rows == k].tolist()))
        wanted = plain(t)
        assert mine.keys() == wanted.keys() and all(math.isclose(mine[c], wanted[c], rel_tol=1e-5) for c in wanted)


def test_quality_takes_memory_for_a_block_and_not_for_a_batch():
    r = random.Random(0)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8))) for _ in range(5000)]
    whole = " ".join(r.choices(words, k=2_600_000)).encode()[: common.BATCH_BYTES]
    model = np.ones(1 << quality.BITS, np.float32), 0.0
    for texts in ([whole[k : k + 16_000] for k in range(0, len(whole), 16_000)], [whole]):
        quality.predict(model, texts[:1])
        tracemalloc.start()
        quality.predict(model, texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 150e6, peak  # about 80 MB; all of a batch's features at once took over 500 MB


def test_quality_scores_dont_depend_on_blocks(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(r.choices(["a", "A1", "the", "The", "!!", "x" * 90, " " * 70, "\xe9"], k=r.choice([0, 1, 5, 200]))).encode() for _ in range(60)]
    model = np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32), 0.5
    vectors, scores = quality.features(texts), quality.predict(model, texts)
    for size in (16, 64, 1000):
        monkeypatch.setattr(text, "BLOCK", size)
        assert all(np.array_equal(a, b) for a, b in zip(vectors, quality.features(texts))) and np.array_equal(scores, quality.predict(model, texts))
        groups = list(quality._groups(texts))
        assert [k for a, b in groups for k in range(a, b)] == list(range(60)) and len(groups) > 1
        assert all(b - a == 1 or sum(map(len, texts[a:b])) <= size for a, b in groups)


def test_follow_the_regularised_leader_is_that_of_plain_loops(monkeypatch):
    r = random.Random(0)
    samples = [(np.array(sorted(r.sample(range(12), r.randint(0, 6))), np.int64), None) for _ in range(40)]
    samples = [(c, np.array([r.random() for _ in c], np.float32)) for c, _ in samples]
    labels = np.array([float(r.random() < 0.5) for _ in samples])
    monkeypatch.setattr(quality, "EPOCHS", 3)
    monkeypatch.setattr(quality, "BATCH", 8)
    w, bias = quality.fit(samples, labels, bits=4)
    a, b, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    z, n, zb, nb = [0.0] * 16, [0.0] * 16, 0.0, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((b + math.sqrt(n[i])) / a + l2)
    for epoch in range(3):
        order = np.random.default_rng(epoch).permutation(40)
        for k in range(0, 40, 8):
            ws, wb, g, gb = [weight(i) for i in range(16)], -zb / ((b + math.sqrt(nb)) / a), [0.0] * 16, 0.0
            for i in order[k : k + 8]:
                error = 1 / (1 + math.exp(-wb - sum(ws[c] * float(x) for c, x in zip(*samples[i])))) - labels[i]
                gb += error
                for c, x in zip(*samples[i]):
                    g[c] += error * float(x)
            for i in range(16):
                z[i] += g[i] - (math.sqrt(n[i] + g[i] ** 2) - math.sqrt(n[i])) / a * ws[i]
                n[i] += g[i] ** 2
            zb += gb - (math.sqrt(nb + gb**2) - math.sqrt(nb)) / a * wb
            nb += gb**2
    assert np.allclose(w, [weight(i) for i in range(16)], rtol=1e-5, atol=1e-7) and math.isclose(bias, -zb / ((b + math.sqrt(nb)) / a), rel_tol=1e-6)


def test_classifiers_take_ids_of_any_type(spark, odd, labels):
    named = lambda df: df.selectExpr("'d' || doc_id AS doc_id", *df.columns[1:])
    assert toxicity.score(named(odd), named(labels)).count() == odd.count() == quality.annotate(named(odd), named(labels), "q").count()
    assert {type(r.doc_id) for r in toxicity.score(named(odd), named(labels)).collect()} == {str, type(None)}


def test_a_sample_is_bounded_by_its_features(spark):
    df = spark.createDataFrame([(k, k % 4) for k in range(50)], "doc_id long, n long")
    order = [r.doc_id for r in df.selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()]
    sizes = list(itertools.accumulate((d % 4 for d in order), initial=0))
    kept = {r.doc_id for r in common.within(df, F.col("n"), 20).collect()}
    assert kept == {d for d, before in zip(order, sizes) if before < 20} and 5 < len(kept) < 30
    assert common.within(df, F.col("n"), 10**6).count() == 50


def test_classifiers(spark, odd, nothing, labels):
    scored = toxicity.score(odd, labels).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in scored)
    assert toxicity.score(nothing, labels).count() == 0 and {r.score for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}
    found = quality.annotate(odd, labels, "q").collect()
    assert len(found) == odd.count() and all(0 <= r.q <= 1 for r in found) and found[0].fp == "x"
    assert len({r.q for r in found if r.doc_id == 2}) == 1 == len({r.score for r in scored if r.doc_id == 2})  # repeated rows
    assert {r.q for r in quality.annotate(odd, labels.limit(0), "q").collect()} == {quality.THRESHOLD}
    with pytest.raises(ValueError, match="score"):
        quality.annotate(odd, labels)


def test_quality_by_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in __spark_entry__.queries()["op9_quality"](spark, big).collect()}
    truth = [r for r in spark.read.parquet(f"{big}/labels.parquet").collect() if fold(r.doc_id, 4) == 2]
    assert np.mean([found[r.doc_id].predicted == r.quality for r in truth]) > 0.9


def test_quality_makes_as_many_passes_over_any_sample(monkeypatch):
    made, real = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: made.append(seed) or real(seed))
    for n in (10, 6000):
        quality.fit([(np.array([k % 7]), np.ones(1, np.float32)) for k in range(n)], np.arange(n) % 7 / 6.0)
    assert len(made) == 2 * quality.EPOCHS and made[: quality.EPOCHS] == made[quality.EPOCHS :]


def test_toxic_and_clean_held_out_rows_each(spark):
    big = "/root/testdata/sf0.1"
    found = {r.doc_id: r.predicted for r in __spark_entry__.queries()["op6_toxicity"](spark, big).collect()}
    truth = [r for r in spark.read.parquet(f"{big}/labels.parquet").collect() if fold(r.doc_id, 5) == 0]
    toxic, clean = ([found[r.doc_id] for r in truth if r.toxic == t] for t in (1, 0))
    assert len(toxic) > 90 and np.mean(toxic) > 0.8 and np.mean(clean) < 0.02


# -- 7


def test_chat(spark):
    rows = [("a", 0, "user", "hi"), ("b", 0, "user", "hi"), ("b", 1, "bot", "yo"), ("c", 0, "user", "hi"), ("c", 1, "bot", "yo"), ("d", 0, "user", "hi"), ("d", 1, "bot", "no <|end|>")]
    rows += [("e", k, "user", f"t{k}") for k in range(600)] + [("f", k, "user", f"t{k}") for k in range(300)] + [("b", 1, "bot", "yo"), (None, 0, None, None), ("g", 0, "x", None), ("h", 0, None, "x"), ("i", None, "u", "n")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    found = collections.defaultdict(str)
    for r in chat.render(df).orderBy("conv_id", "part").collect():
        found[r.conv_id, r.n_turns, r.n_copies] += r.text
    assert set(found) == {("b", 2, 2), ("d", 2, 1), ("e", 600, 1), (None, 1, 1), ("g", 1, 1), ("h", 1, 1), ("i", 1, 1)}
    assert found["b", 2, 2] == "<|user|>\nhi\n<|end|>\n<|bot|>\nyo\n<|end|>\n" and "< |end|>" in found["d", 2, 1]
    assert found["e", 600, 1].count("<|end|>") == 600 and found["e", 600, 1].index("t299\n") < found["e", 600, 1].index("t300\n")
    assert found[None, 1, 1] == "<|unknown|>\n\n<|end|>\n"
    assert chat.render(df.limit(0)).count() == 0 and chat.maximal(df).count() == 7
    assert "Python" not in chat.render(df)._jdf.queryExecution().toString()


def test_chat_without_turn_numbers_in_parts(spark):
    """A third of the rows in one conversation, all with one turn number; another third without a conversation or a number."""
    rows = spark.range(9000).selectExpr("CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN NULL ELSE 'c' || id % 500 END AS conv_id", "CASE id % 3 WHEN 0 THEN 7 WHEN 2 THEN id DIV 500 END AS turn", "'user' AS role", "'t' || id AS text", "1 AS part", "2 AS block", "'x' AS conv")
    whole, texts = collections.Counter(), collections.defaultdict(str)
    for r in chat.render(rows).orderBy("conv_id", "part").collect():
        n = r.text.count("<|end|>")
        assert n == chat.PART or r.part == (r.n_turns - 1) // chat.PART and n == r.n_turns - r.part * chat.PART
        whole[r.conv_id] += n
        texts[r.conv_id] += r.text
    assert whole["hot"] == whole[None] == 3000 and sum(whole.values()) == 9000
    assert [t for t in texts["hot"].split("\n") if t[:1] == "t"] == sorted(f"t{k}" for k in range(0, 9000, 3))


def test_chat_is_the_oracle_on_ties_and_long_texts(spark, tmp_path):
    r = random.Random(5)
    rows = [(f"c{k % 9}", r.randint(0, 3), r.choice(["user", "bot", None, "<|x"]), r.choice(["a", "b", None, "", "long " * 40_000, "<|end|>"])) for k in range(300)]
    rows += [(f"s{k}", t, "user", f"m{t}") for k in range(1, 30) for t in range(k)]  # snapshots of one conversation
    rows += [("big", t, "user", f"m{t}") for t in range(600)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "c.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    wanted = con.sql(chat.ORACLE)
    got = chat.render(df).select(*wanted.columns).collect()
    assert sorted(map(tuple, got)) == sorted(wanted.fetchall())


# -- 8


def brute_fingerprint(whole):
    import xxhash

    w = WORD.findall(lower(whole))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(rows):
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min([x for x in (least.get(find(k)), d) if x is not None], default=None)
    return [least[find(k)] for k in range(len(rows))]


def test_simhash(spark, odd, nothing):
    many = docs(spark).select("doc_id", "text").unionByName(odd.select("doc_id", "text").selectExpr("doc_id + 1000 AS doc_id", "text"))
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in many.collect()]
    wanted = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows))), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(many).collect()), key=str) == wanted
    assert simhash.near_duplicates(nothing).count() == 0


def test_many_rows_of_one_fingerprint(spark, odd, monkeypatch):
    wanted = sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str)
    monkeypatch.setattr(simhash, "MANY", 1)
    assert sorted(map(tuple, simhash.near_duplicates(odd.withColumnRenamed("score", "n").withColumnRenamed("lang", "root")).collect()), key=str) == wanted


def test_crowded_listings_lose_no_link(spark):
    r = random.Random(4)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 60:
        fps.add(r.choice(sorted(fps)) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    for hot, m in ((simhash.HOT, 5), (2, 5), (simhash.HOT, 6), (simhash.HOT, 8)):
        found = {x.node: x.root for x in simhash.components(simhash.links(nodes, hot, m)).collect()}
        wanted = brute_components([(s, s & ((1 << 64) - 1)) for s in signed])
        assert [found.get(s, s) for s in signed] == wanted


def test_exploded_rows_are_not_broadcast(spark):
    """The planner takes them for as small as their nodes; both sets of nodes are far below its threshold."""
    crowd = F.expr("xxhash64(id) & ((1L << 38) - 1) | (5L << 38)").alias("fp")
    limit = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "8m")
    try:
        assert simhash.links(common.stored(spark.range(simhash.HOT + 50).select(crowd))).count() == 0  # far apart, but listed together
        assert simhash.links(common.stored(spark.range(40_000).select(F.xxhash64("id").alias("fp")))).count() == 0
    finally:
        spark.conf.set(limit, before)


def test_every_close_pair_shares_a_listing():
    r = random.Random(6)
    assert [simhash.blocks_for(n) for n in (0, 1 << 25, (1 << 25) + 1, 1 << 33, 10**14)] == [5, 5, 6, 7, 9]
    for m in range(simhash.LEAST_BLOCKS, simhash.MOST_BLOCKS + 1):
        assert len(simhash.masks(m)) == math.comb(m, 3)
        for _ in range(200):
            flips = sum(1 << b for b in r.sample(range(64), 3))
            assert any(not flips & mask for mask in simhash.masks(m))


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    found = {x.node: x.root for x in simhash.components(edges).collect()}
    assert all(found[k] == 0 for k in range(1, 201)) and found[501] == 500
    assert simhash.components(edges.limit(0)).count() == 0


# -- 10


def test_language_model(spark, odd, nothing):
    crafted = spark.createDataFrame([(k, f"{THUE} {MORSE} a") for k in range(3)] + [(3, THUE), (3, THUE)], "doc_id long, text string")
    for df, size in ((docs(spark).select("doc_id", "text"), 100_000), (odd, lm.CHUNK_BYTES), (crafted, 1)):
        rows = df.select("doc_id", "text").collect()
        cut = lambda t: [*WORD.findall(lower(t)), None]
        counts = collections.Counter(w for d, t in rows if d is not None and fold(d, 5) != 1 for w in cut(t))
        n, v = counts.total(), len(counts)
        wanted = collections.defaultdict(list)
        for d, t in rows:
            w = cut(t)
            wanted[d].append((len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
        found = lm.score(df, size).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r.train_tokens == n and r.held_out == (fold(r.doc_id, 5) == 1) and r.score < 0
            assert any(r.n_tokens == a and r.n_known == b and math.isclose(r.base_score, c, rel_tol=1e-9) for a, b, c in wanted[r.doc_id])
    assert lm.score(nothing).count() == 0


def test_scores_depend_on_the_corpus_and_not_on_partitions(spark):
    """Also better than the counts alone on rows that weren't learned from, at either size."""
    for sf, cuts in (("sf0.001", (1, 3, 8)), ("sf0.01", (3,))):
        found = []
        for n in cuts:
            df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").repartition(n)
            found.append({r.doc_id: r for r in lm.score(df, 400_000 * n).collect()})
        assert all(math.isclose(x[d].score, found[0][d].score, rel_tol=1e-6) for x in found for d in x)
        held = [r for r in found[0].values() if r.held_out]
        n = sum(r.n_tokens for r in held)
        assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.05
        assert np.mean([r.score > r.base_score for r in held]) > 0.8


def test_shares_by_key(monkeypatch):
    """Every training text is in one share; the order within is that of keys."""
    r = random.Random(0)
    texts = [" ".join(r.choices("abcdefg", k=r.randint(0, 9))) for _ in range(200)]
    keys, own = np.array([r.getrandbits(64) - (1 << 63) for _ in texts], np.int64), np.array([k % 5 > 0 for k in range(200)])
    chunk = lm._chunk(0, 0, list(range(200)), own, keys, [t.encode() for t in texts], pa.int64())

    class Sent:
        value = type("C", (), {"ids": staticmethod(lambda words, tails: np.arange(len(words), dtype=np.int32))})

    words = lm._words(chunk.to_pylist()[0]).to_pylist()
    rows = [x for b in lm._sequences([chunk], Sent, 7, False) for x in b.to_pylist()]
    assert {(x["key"], x["share"]) for x in rows} == {(int(k), (int(k) & 0xFFFFFFFF) % 7) for k in keys[own]}
    said = {x["key"]: b" ".join(words[i] for i in np.frombuffer(x["ids"], "<u2")) for x in rows}
    assert all(said[int(k)] == (t.encode() + b" \n" if t else b"\n") for k, t, o in zip(keys, texts, own) if o)
    first = {x["key"] for b in lm._sequences([chunk], Sent, 7, True) for x in b.to_pylist()}
    assert first == {int(k) for k in keys[own] if ((int(k) >> 32) & 0xFFFFFFFF) % 7 == 0}


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    m = {k: v.astype(np.float64) for k, v in gru.fresh(rng.integers(1, 50, gru.HEAD), rng.integers(1, 50, gru.TAIL)).items()}
    return rng, {k: v + rng.normal(0, 0.1, v.shape) for k, v in m.items()}


def test_gradients():
    rng, m = small_model()
    x, y, h = rng.integers(0, gru.START, (5, 3)), rng.integers(0, gru.START, (5, 3)), rng.normal(0, 1, (3, gru.HIDDEN))
    x[0] = x[2, 1] = gru.START
    g, (rows, dE), _, _ = gru._gradients(m, x, y, h)
    word = int(y[y < gru.HEAD][0])
    for name, at in (("U", (3, 5)), ("V", (1, 2)), ("Wc", (2, 3)), ("bc", (4,)), ("Ww", (word, 2)), ("bw", (word,)), ("E", (int(x[1, 0]), 7)), ("E", (int(x[1, 0]), 40))):
        kept, losses = m[name][at], []
        for step in (1e-2, -1e-2):
            m[name][at] = kept + step
            losses.append(gru._gradients(m, x, y, h)[3])
        m[name][at] = kept
        found = g[name][at] if name != "E" else dE[list(rows).index(at[0])][at[1]]
        assert math.isclose((losses[0] - losses[1]) / 2e-2 / y.size, found, rel_tol=2e-2, abs_tol=1e-7)


def test_probabilities_sum_to_one_and_state_is_carried(monkeypatch):
    _, m = small_model(1)
    every = np.arange(gru.START, dtype=np.int32)
    start = np.array([5, 2000 % gru.HEAD, gru.HEAD + 3] * 40, np.int32)
    ids = np.concatenate([np.concatenate([start, [w]]) for w in every]).astype(np.int32)
    lengths = np.full(len(every), len(start) + 1)
    shorter = gru.log_likelihoods(m, start, np.array([len(start)]))[0]
    assert math.isclose(np.exp(gru.log_likelihoods(m, ids, lengths) - shorter).sum(), 1, rel_tol=1e-3)
    one = gru.log_likelihoods(m, ids[:5000], np.array([3000, 1500, 1, 499]))
    monkeypatch.setattr(gru, "SCORE_WINDOW", 7)
    monkeypatch.setattr(gru, "SCORE_LANES", 2)
    assert np.allclose(one, gru.log_likelihoods(m, ids[:5000], np.array([3000, 1500, 1, 499])), rtol=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    cycle = np.tile(np.arange(50, dtype=np.int32), 2000)
    m = gru.fresh(np.full(50, 2000.0), np.full(gru.TAIL, 0.5))
    lengths = np.full(100, 1000)
    before = gru.log_likelihoods(m, cycle, lengths).sum()
    after, _, _ = gru.train(m, gru.still(m), cycle, lengths)
    assert gru.log_likelihoods(after, cycle, lengths).sum() > 0.8 * before and rng is not None
    a, b = gru.unpacked(gru.packed(after, gru.still(after)))
    assert all((a[k] == after[k]).all() for k in gru.NAMES) and (b["U"] == gru.still(after)["U"]).all()


def test_training_reaches_32_tokens_back(monkeypatch):
    windows, real = [], gru._gradients
    monkeypatch.setattr(gru, "_gradients", lambda m, x, y, *rest: windows.append(x.shape) or real(m, x, y, *rest))
    m = gru.fresh(np.full(50, 2000.0), np.full(gru.TAIL, 0.5))
    gru.train(m, gru.still(m), np.arange(9600, dtype=np.int32) % 50, np.full(100, 96))
    assert windows[0] == (32, 100)


def test_windows_use_the_same_arrays(monkeypatch):
    """After the first one a window allocates little, and its results are those of a window with arrays of its own."""
    import tracemalloc

    ids = np.random.default_rng(3).integers(0, gru.START, 128 * 32 * 5).astype(np.int32)
    lengths, m, fresh, real = np.full(64 * 5, 64), gru.fresh(np.full(gru.HEAD, 20.0), np.full(gru.TAIL, 20.0)), [], gru._gradients

    def watched(*given):
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        out = real(*given)
        fresh.append(tracemalloc.get_traced_memory()[1] - before)
        return out

    monkeypatch.setattr(gru, "_gradients", watched)
    tracemalloc.start()
    a = gru.train(m, gru.still(m), ids, lengths)
    tracemalloc.stop()
    assert len(fresh) > 2 and max(fresh[1:]) < 1_000_000
    monkeypatch.setattr(gru, "_gradients", lambda m, x, y, h, full, *_: real(m, x, y, h, full))
    b = gru.train(m, gru.still(m), ids, lengths)
    assert all((x[k] == y[k]).all() for x, y in zip(a[:2], b) for k in gru.NAMES) and a[2] == b[2]


def test_a_window_adds_up_its_lanes():
    """Also lanes that end within it, and texts that start there."""
    rng, m = small_model(4)
    x, y, h = rng.integers(0, gru.START, (9, 4)), rng.integers(0, gru.START, (9, 4)), rng.normal(0, 1, (4, gru.HIDDEN))
    x[0, 0] = x[4, 1] = gru.START
    ends = (9, 9, 6, 1)
    for k, end in enumerate(ends):
        y[end:, k], x[end:, k] = -1, gru.START
    g, (rows, dE), last, loss = gru._gradients(m, x, y, h, 1)
    alone = [gru._gradients(m, x[:end, k : k + 1], y[:end, k : k + 1], h[k : k + 1], 1) for k, end in enumerate(ends)]
    assert math.isclose(loss, sum(a[3] for a in alone), rel_tol=1e-6) and np.allclose(last[:2], [a[2][0] for a in alone[:2]], rtol=1e-5)
    assert all(np.allclose(v, sum(a[0][name] for a in alone), rtol=1e-4, atol=1e-5) for name, v in g.items())
    whole, parts = np.zeros(m["E"].shape), np.zeros(m["E"].shape)
    whole[rows] += dE
    for _, (own, d), _, _ in alone:
        parts[own] += d
    assert np.allclose(whole, parts, rtol=1e-4, atol=1e-5)


def test_a_long_text_trains_in_pieces():
    assert gru.pieces(np.array([1, 5, 6, 10]), 5).tolist() == [1, 5, 5, 1, 5, 5]
    ids = np.arange(3 * gru.PIECE + 10, dtype=np.int32) % 50
    given, target, _ = gru.lanes(ids, gru.pieces(np.array([len(ids)]), gru.PIECE), 4, longest_first=False)
    assert given.shape == (gru.PIECE, 4) and (target >= 0).sum() == len(ids)
