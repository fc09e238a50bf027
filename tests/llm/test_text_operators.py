"""Operators on texts against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coterie.llm import bpe, kneserney, langid, packing, registry, secrets, simhash, syncmers
from coterie.llm.common import scratch_path
from tests_llm_shared import brute_components, check_packed, plain_fingerprint


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def sample(spark, sf):
    return [r for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    sample = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in registry.op1_secret_scan(spark, sf).collect()}
    assert len(got) == len(sample)
    assert any(r["n_assign"] for r in got.values())
    for r in sample:
        spans, row = base_spans(r["text"] or ""), got[r["doc_id"]]
        assert (row["n_assign"], row["n_access"], row["n_hex"]) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert row["base_sha256"] == sha(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans))
        assert all(f"{s[3]}:{s[0]}:{s[2]}" in row["spans"].split(",") for s in spans)


def test_short_values_consume_their_match():
    assert secrets.find("token=token:abcdefgh") == []
    assert [x[:3] for x in secrets.find("Token: abcdefgh")] == [(0, 0, 15)]
    assert secrets.find("\u212aey api\u212aey=abcdefgh") == []


def ledger_rows(spark, path):
    return [(r["blob"], tuple(r["rules"])) for r in secrets.open_ledger(spark, path).collect()]


def test_ledger_scans_only_unseen_pairs(spark, docs, none):
    path, old = scratch_path(spark, "ledger"), docs.where("doc_id < 9")
    blobs = lambda df: {sha(r["text"] or "") for r in df.collect()}
    first = secrets.scan(old, path)
    assert first.count() == old.count() and sorted(b for b, _ in ledger_rows(spark, path)) == sorted(blobs(old))
    again = secrets.scan(docs, path)
    assert sorted(b for b, _ in ledger_rows(spark, path)) == sorted(blobs(docs))  # each blob scanned once, in either run
    fresh = sorted(map(str, secrets.scan(docs).collect()))
    assert sorted(map(str, again.collect())) == fresh
    # a changed rule, and rules in another order: only the new pairs are scanned, and order follows the rules at hand
    rules = tuple((k, v + (k == "hex"), *rest) for k, v, *rest in secrets.RULES[:3]) + secrets.RULES[3:][::-1]
    before = len(ledger_rows(spark, path))
    newer = {r["key"]: r["findings"] for r in secrets.scan(docs, path, rules, key="key").collect()}
    added = ledger_rows(spark, path)
    assert len(added) == 2 * before and sum(r == ("hex@2",) for _, r in added) == before
    want = {r["key"]: r["findings"] for r in secrets.scan(docs, None, rules, key="key").collect()}
    assert newer == want and any(want.values())
    # rows that two runs append are counted once
    secrets.open_ledger(spark, path).write.mode("append").parquet(path + "-twice")
    secrets.open_ledger(spark, path).write.mode("append").parquet(path + "-twice")
    assert {r["key"]: r["findings"] for r in secrets.scan(docs, path + "-twice", rules, key="key").collect()} == want
    assert secrets.scan(none).count() == 0


def test_secret_query_goes_through_a_lasting_ledger(spark, sf, sample):
    path = scratch_path(spark, "ledger")
    spark.conf.set(secrets.SETTING, path)
    try:
        runs = [sorted(registry.op1_secret_scan(spark, sf).collect()) for _ in range(2)]
    finally:
        spark.conf.unset(secrets.SETTING)
    assert runs[0] == runs[1]
    assert sorted(b for b, _ in ledger_rows(spark, path)) == sorted({sha(r["text"] or "") for r in sample})  # the second run scanned nothing


def test_redaction_leaves_no_secret(docs):
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for r in clean.collect():
        assert not secrets.find(r["text"] or "")
    before = {r["key"]: r for r in docs.collect()}
    for r in clean.collect():
        if not secrets.find(before[r["key"]]["text"] or ""):
            assert r == before[r["key"]]
        else:
            assert r["n_chars"] == len(r["text"])


# BPE


def test_encoding_equals_the_library(docs, texts, library, sample):
    got = {r["key2"]: r for r in bpe.encode(docs.withColumnRenamed("key", "key2"), "key2", decoded=True).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or "", add_special_tokens=False).ids, i
        assert got[i]["decoded"] == library.decode(got[i]["ids"], skip_special_tokens=False) == (t or "")
    c = bpe.Codec(bpe.default_vocabulary())
    for r in sample:
        assert np.frombuffer(c.encode(r["text"]), "<i4").tolist() == library.encode(r["text"], add_special_tokens=False).ids


def test_encoding_of_random_strings(library):
    rng, c = random.Random(5), bpe.Codec(bpe.default_vocabulary())
    parts = [*"ab'stre  \n\t1.\u00e9\u6f22\u0301\u200b", "<|endoftext|>", " ", "\r\n", "'ll", "\U0001f468\u200d\U0001f469", "the", "ing" * 40]
    strings = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for s, packed in zip(strings, c.encode_all(strings), strict=True):
        assert np.frombuffer(packed, "<i4").tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)
    for _ in range(300):
        ids = [rng.randrange(c.width) for _ in range(rng.randrange(8))]
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_both_merge_paths_agree():
    c, rng = bpe.Codec(bpe.default_vocabulary()), random.Random(2)
    words = [bytes(rng.choice(b"etaoin shr\xc3\xa9") for _ in range(rng.randrange(1, 64))) for _ in range(500)]
    ids, counts = c.merge_all(words)
    for w, end, n in zip(words, np.cumsum(counts).tolist(), counts.tolist(), strict=True):
        assert ids[end - n : end].tolist() == c.merge_long(w)


def test_encoder_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLOTS", 1 << 12)
    monkeypatch.setattr(bpe, "POOL", 1 << 13)
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1 << 14)
    monkeypatch.setattr(bpe, "SLICE", 1 << 12)
    c, rng = bpe.Codec(bpe.default_vocabulary()), random.Random(6)
    word = lambda most: "".join(rng.choice("etaoinshrdlu\u00e9\u6f22,") for _ in range(rng.randrange(1, most)))
    for _ in range(60):
        texts = [rng.choice(["", " ", "\n"]).join([" ".join(word(60 if rng.random() < 0.1 else 8) for _ in range(rng.randrange(300)))] * 2) for _ in range(4)]
        texts.append("x" * rng.randrange(5000))  # a piece of its own, longer than a slice
        for t, packed in zip(texts, c.encode_all(texts), strict=True):
            assert np.frombuffer(packed, "<i4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert c.held <= bpe.SLOTS // 2 and c.long.bytes <= bpe.MEMO_BYTES and len(c.long.old) * c.long.ENTRY <= bpe.MEMO_BYTES
        assert all(len(p) <= c.long.LONGEST for p in c.long)
    long = "\u6f22" * 20_000  # one piece of more ids than the pool holds
    assert np.frombuffer(c.encode(long), "<i4").tolist() == library.encode(long, add_special_tokens=False).ids and len(c.pool) > bpe.POOL
    c.encode_all(["a b"] * 10)
    assert len(c.pool) <= bpe.POOL


def test_bpe_query_and_decode(spark, sf, library, sample, docs, none):
    got = {r["doc_id"]: r for r in registry.op2_bpe(spark, sf).collect()}
    for r in sample:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"], got[r["doc_id"]]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(r["text"]))
    assert bpe.encode(none).count() == 0
    back = {r["n"]: r["text"] for r in bpe.decode(bpe.encode(docs.selectExpr("key n", "text t"), "n", "t"), "n").collect()}
    assert back == {r["key"]: r["text"] or "" for r in docs.collect()}


# SimHash


def test_simhash_query_equals_brute_force(spark, sf, sample):
    prints = {r["doc_id"]: plain_fingerprint(r["text"] or "") for r in sample}
    want = brute_components(prints)
    for r in registry.op4_simhash(spark, sf).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


def test_simhash_links_chains_and_edges(spark, docs, none):
    rng = random.Random(3)
    prints = {i: rng.getrandbits(64) for i in range(40)}
    for i in range(40, 200):
        prints[i] = prints[rng.randrange(i)] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(v),) for v in set(prints.values())], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(rows)).collect()}
    want = brute_components(prints)
    got = {i: roots.get(signed(v), signed(v)) for i, v in prints.items()}
    assert len(set(got.values())) == len(set(want.values()))
    assert len({(got[i], want[i]) for i in prints}) == len(set(want.values()))
    out = simhash.near_duplicates(docs).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(out) == docs.count() and by_id[2]["component_id"] == 0 == by_id[1]["component_id"] and by_id[5]["component_id"] == 3 and by_id[4]["fp"] == 0
    assert simhash.near_duplicates(none).count() == 0
    assert len(simhash.deduplicate(docs).collect()) == len({r["component_id"] if r["doc_id"] is not None else None for r in out} - {None}) + 1


def test_dedup_keeps_one_row_of_each_component(spark):
    near, own = "the quick brown fox jumps over the lazy dog", "seven green bottles stand on one long and very old wall"
    some = [(1, near, "a"), (1, own, "b"), (2, near, "c"), (3, own, "d"), (4, "alpha beta gamma", None), (4, "alpha beta gamma", None), (None, "alpha beta gamma", "n"), (None, "only rows without an id say this", "n"), (None, "only rows without an id say this", "n"), (5, None, "e"), (6, "", "f"), (None, None, None)]
    results = []
    for rows in (some, some[::-1]):
        results.append(sorted(map(tuple, simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=str))
    assert results[0] == results[1] == sorted([(1, near, "a"), (1, own, "b"), (4, "alpha beta gamma", None), (None, "only rows without an id say this", "n"), (5, None, "e")], key=str)


def test_dedup_of_many_rows_of_few_ids_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(6)) for _ in range(25)]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(texts), rng.randrange(3)) for _ in range(150)]
    components = brute_components(dict(enumerate(plain_fingerprint(t) for t in texts)))
    of = {t: components[i] for i, t in enumerate(texts)}
    kept = [tuple(r) for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()]
    assert sorted(of[t] for _, t, _ in kept) == sorted({of[t] for _, t, _ in rows})
    for i, t, n in kept:
        assert (i, t, n) in rows and i == min((j for j, u, _ in rows if of[u] == of[t] and j is not None), default=None)


# Kneser-Ney


def test_word_pair_mixing_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (kneserney.unmix(kneserney.mix(x)) == x).all()


def test_token_hashes():
    texts = [b"Ab ab\\tAB \\x0c", None, b"", b"  ", b"x" * 23 + b" " + b"X" * 24 + b"\\n" + b"x" * 24 + b" " + b"x" * 50, "\\u00e9\\u00c9 a\\x1cb\\u00a0c".encode(), b"a" * 8, b"a" * 7 + b" a"]
    hashes, sizes = kneserney.hashed_tokens(texts)
    words = [[*(t or b"").lower().split(), b"\\n"] for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    of = {}
    for w, h in zip([w for ws in words for w in ws], hashes.tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
    rng = random.Random(14)
    many = {bytes(rng.choice(b"ab\\0") for _ in range(rng.randrange(1, 40))) for _ in range(20_000)}
    assert len(set(kneserney.hashed_tokens([b" ".join(sorted(many))])[0].tolist())) == len(many) + 1


class PlainModel:
    def __init__(self, texts):
        from collections import Counter

        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            seq = [*self.cut(t), "\n"]
            self.words.update(seq)
            self.pairs.update(zip(["^", *seq], seq, strict=False))
        self.n, self.v = self.words.total(), len(self.words)
        self.left, self.follow, self.context = Counter(), {}, Counter()
        for (a, b), c in self.pairs.items():
            self.left[b] += 1
            self.follow.setdefault(a, [0, 0, 0])[min(c, 3) - 1] += 1
            self.context[a] += c
        of = lambda counts: kneserney.discounts(*[sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)])
        self.dp, self.dw = of(self.pairs), of(self.left)
        total = len(self.pairs)
        self.unknown = sum(self.dw[min(c, 3) - 1] for c in self.left.values()) / total / (self.v + 1)
        self.total = total

    @staticmethod
    def cut(t):
        return (t or "").encode().lower().decode().split() if (t or "").isascii() else [w.decode() for w in (t or "").encode().lower().split()]

    def lower(self, w):
        c = self.left[w]
        return (max(c - self.dw[min(c, 3) - 1], 0) if c else 0) / self.total + self.unknown

    def p(self, u, w):
        if not self.context[u]:
            return self.lower(w)
        c = self.pairs[u, w]
        own = max(c - self.dp[min(c, 3) - 1], 0) if c else 0
        return own / self.context[u] + sum(d * n for d, n in zip(self.dp, self.follow[u], strict=True)) / self.context[u] * self.lower(w)

    def score(self, t):
        seq = [*self.cut(t), "\n"]
        base = sum(np.log10((self.words[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in seq)
        return len(seq), sum(self.words[w] > 0 for w in seq), base, sum(np.log10(self.p(u, w)) for u, w in zip(["^", *seq], seq, strict=False))


def test_language_model_equals_brute_force(spark, sf, sample, monkeypatch):
    monkeypatch.setattr(kneserney, "RANGE_BYTES", 30_000)  # several ranges, in several blocks, packed several times
    monkeypatch.setattr(kneserney, "BLOCK", 4)
    monkeypatch.setattr(kneserney, "GATHER", 5000)
    plain = PlainModel([r["text"] for r in sample if zlib.crc32(str(r["doc_id"]).encode()) % 10])
    some = [r["doc_id"] for r in sample][::7]
    got = {r["doc_id"]: r for r in registry.op5_kneser_ney(spark, sf).collect()}
    assert len(got) == len(sample)
    for r in sample:
        if r["doc_id"] in some:
            n, known, base, score = plain.score(r["text"])
            row = got[r["doc_id"]]
            assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, plain.n)
            assert row["base_score"] == pytest.approx(base, rel=1e-9) and row["score"] == pytest.approx(score, rel=1e-9)
    u = next(iter(plain.follow))
    assert sum(plain.p(u, w) for w in plain.words) + plain.p(u, "never seen") == pytest.approx(1)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_edges(docs, none):
    model = kneserney.train(docs)
    rows = {r["key"]: r for r in kneserney.score(docs, model, "key").collect()}
    assert rows[3]["n_tokens"] == rows[4]["n_tokens"] == 1 and rows[3]["score"] == rows[4]["score"] and rows[0]["score"] == rows[1]["score"]
    assert kneserney.score(none, model).count() == 0
    blank = kneserney.score(docs, kneserney.train(none), "key").collect()
    assert all(r["score"] is None and r["n_known"] == 0 for r in blank) and {r["key"]: r["n_tokens"] for r in blank} == {k: r["n_tokens"] for k, r in rows.items()}


# packing


def test_packing_query(spark, sf, library, sample):
    rows = registry.op7_packing(spark, sf).collect()
    sequences = check_packed(rows)
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
    assert set(docs) == {r["doc_id"] for r in sample}
    for r in sample:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(docs[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert len(sequences) * 2048 < total * 1.05 + 2048


def test_packing_patterns_hold_the_histogram():
    rng = random.Random(4)
    for size in (8, 64, 2048):
        histogram = {rng.randrange(1, size + 1): rng.randrange(1, 50) for _ in range(size // 2)}
        patterns = packing.shortest_pack_first(dict(histogram), size)
        held = {}
        for count, lengths in patterns:
            assert sum(lengths) <= size and list(lengths) == sorted(lengths, reverse=True)
            for x in lengths:
                held[x] = held.get(x, 0) + count
        assert held == histogram


def test_packing_places_like_single_pieces():
    """Pieces one by one, longest first, each into the pack with the most space left."""
    rng = random.Random(15)
    for size, n in ((16, 60), (64, 300), (2048, 900)):
        lengths = [min(size, rng.choice([rng.randrange(1, size + 1), rng.randrange(1, size // 4 + 1), size // 8])) for _ in range(n)]
        spaces = []
        for x in sorted(lengths, reverse=True):
            if spaces and max(spaces) >= x:
                spaces[spaces.index(max(spaces))] -= x
            else:
                spaces.append(size - x)
        patterns = packing.shortest_pack_first({x: lengths.count(x) for x in lengths}, size)
        assert sorted(size - sum(p) for count, p in patterns for _ in range(count)) == sorted(spaces)


def test_packing_of_rows_without_or_with_one_id(spark):
    rows = [(None, f"word {i}") for i in range(40)] + [(7, "same words")] * 40
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    assert len(out) == 80 and sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in out)
    check_packed(out, 16)


def test_packing_edges(spark, docs, none, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)  # several buckets for a hot length
    many = docs.select("key", "text").union(spark.range(60).selectExpr("id + 100", "'same words'"))
    rows = packing.pack_documents(many, 16, key="key").collect()
    check_packed(rows, 16)
    assert packing.pack_documents(none).count() == 0
    assert sum(r["doc_tokens"] == 1 for r in rows) == 2
    parts = packing.pieces(docs, 16, keep_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] <= 16 for r in parts)


# language ID


def test_codewords():
    for n in (2, 3, 4, 6, 9, 30):
        code = langid.codewords(n)
        assert len({tuple(x) for x in code.tolist()}) == n and (abs(code.sum(axis=0)) < n).all()


def test_language_query_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = registry.op9_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_decoding_equals_brute_force():
    """Margins n-gram by n-gram, and each label's loss bit by bit."""
    import math

    values = np.random.default_rng(12)
    texts = ["The house, and 3 mice!", "\u00e9t\u00e9 na\u00efve", "a", "xyz " * 50, "-- a b --", "", None, "42 !?", "UPPER lower \u6f22\u5b57"]

    def plain_grams(text):
        raw = bytearray(b" ")
        for b in f" {text.lower()} ".encode():
            letter = b if b >= 128 or 97 <= b <= 122 else 32
            if letter != 32 or raw[-1] != 32:
                raw.append(letter)
        counts = {}
        for n in langid.GRAMS:
            for i in range(len(raw) - n + 1):
                h = 0
                for b in raw[i : i + n]:
                    h = (h * 0x01000193 + b) % 2**32
                h = (h ^ n) * 0x9E3779B1 % 2**32 >> 20
                counts[h] = counts.get(h, 0) + 1
        size = math.sqrt(sum(counts.values()))
        return {h: math.sqrt(c) / size for h, c in counts.items()} if counts else {}

    for labels in (["de", "en"], ["a", "b", "c", "d"], [f"l{i}" for i in range(9)]):
        code = langid.codewords(len(labels))
        model = langid.Model(labels, code, values.normal(size=(langid.DIMENSIONS, code.shape[1])).astype("f4"), values.normal(size=code.shape[1]).astype("f4"))
        names, scores = model.predict(texts)
        for t, name, score in zip(texts, names, scores, strict=True):
            if not t or not any(c.isalpha() for c in t):
                assert (name, score) == ("und", 0.0)
                continue
            row = plain_grams(t)
            margins = [sum(v * float(model.weights[h, b]) for h, v in row.items()) + float(model.bias[b]) for b in range(code.shape[1])]
            loss = [sum(math.log1p(math.exp(-m * float(bit))) for m, bit in zip(margins, word, strict=True)) for word in code]
            share = [math.exp(min(loss) - x) for x in loss]
            best = min(range(len(labels)), key=lambda i: loss[i])
            assert name == labels[best] and score == pytest.approx(share[best] / sum(share), rel=1e-4)
    tied = langid.Model(["a", "b"], langid.codewords(2), np.zeros((langid.DIMENSIONS, 1), "f4"), np.zeros(1, "f4"))
    assert tied.predict(["text"]) == (["a"], [0.5])


def test_language_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 3)
    rows = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(rows)
    assert langid.train(rows.where("doc_id < 3")).labels == ["l0", "l1", "l2"]


def test_language_edges(docs, none):
    rows = {r["key"]: r for r in langid.identify(docs.withColumnRenamed("score", "s"), langid.train(docs, "key"), "key").collect()}
    assert [rows[i]["lang_pred"] for i in (3, 4, 5, 11)] == ["und"] * 4 and rows[3]["score"] == 0
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] in ("en", "de")
    assert langid.identify(none, langid.train(docs)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(docs.where("lang = 'de'")), "key").collect()} == {"und", "de"}
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and 3 not in {r["key"] for r in kept.collect()}


# syncmers


def spark_xxhash(*values: int) -> int:
    seed = 42
    for v in values:
        seed = xxh_long(v, seed)
    return seed


M = (1 << 64) - 1
P = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def xxh_long(v: int, seed: int) -> int:
    return xxhash.xxh64_intdigest((v & M).to_bytes(8, "little"), seed & M)


def plain_anchors(text: str) -> list[int]:
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return []
    h = [*range(4), *[xxhash.xxh64_intdigest(w.encode(), 42) for w in words], *range(4)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    inner = [signed(spark_xxhash(a, b)) for a, b in zip(h, h[1:], strict=False)]
    out = []
    for i in range(len(inner) - 3):
        w = inner[i : i + 4]
        if min(w) in (w[0], w[3]):
            out.append(spark_xxhash(w[0], w[2], w[3]) & 0x7FFFFFFF | 0x80000000)
    return out


def dice(a: list[int], b: list[int]) -> float:
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def aligned(a: list[int], b: list[int]) -> float:
    first = [{x: i for i, x in reversed(list(enumerate(y)))} for y in (a, b)]
    total = len(first[0]) + len(first[1])
    pairs = sorted((i, first[1][x]) for x, i in first[0].items() if x in first[1])
    up = sum(y[1] > x[1] for x, y in zip(pairs, pairs[1:], strict=False)) + bool(pairs)
    return 2 * up / total if total else 1.0


def check_syncmers(rows, want):
    order = sorted(want, key=lambda x: -x)
    for at, i in enumerate(order):
        text, after = want[i] or "", want[order[(at + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, e, n = map(plain_anchors, (text, edited, after))
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha(edited), i
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in a) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in e), i
        assert r["near_edited"] == pytest.approx(dice(a, e)) and r["near_next"] == pytest.approx(dice(a, n))
        assert r["aligned_edited"] == pytest.approx(aligned(a, e)) and r["aligned_next"] == pytest.approx(aligned(a, n))


def test_syncmer_query_equals_brute_force(spark, sf, sample, monkeypatch):
    monkeypatch.setattr(syncmers.in_order, "__defaults__", (17,))  # several buckets
    rows = {r["doc_id"]: r for r in registry.op10_syncmers(spark, sf).collect()}
    assert len(rows) == len(sample)
    check_syncmers(rows, {r["doc_id"]: r["text"] for r in sample})
    long = [r for r in rows.values() if r["n_chars"] > 500]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.6


def test_alignment_tells_order_from_content(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    parts = [words[i : i + 60] for i in range(0, 600, 60)]
    turned = [w for p in reversed(parts) for w in p]
    shuffled = sorted(words)
    rows = [(" ".join(words), " ".join(x)) for x in (words, turned, shuffled, words[:300] + ["new"] * 7 + words[300:])]
    frame = spark.createDataFrame(rows, "a string, b string").select(syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    total = F.size(F.array_distinct(syncmers.hashes(a))) + F.size(F.array_distinct(syncmers.hashes(b)))
    got = frame.select(syncmers.likeness(syncmers.hashes(a), syncmers.hashes(b)).alias("near"), syncmers.alignment(a, b, total).alias("aligned")).collect()
    assert got[0]["aligned"] == got[0]["near"] == 1.0 and got[2]["near"] < 0.1 and got[3]["aligned"] > 0.9
    assert got[1]["near"] > 0.85 and 0.02 < got[1]["near"] - got[1]["aligned"] < 0.1  # nine breaks among ten blocks


def test_syncmer_edges(docs, none, texts):
    got = syncmers.compare_edits(docs).collect()
    assert len(got) == docs.count()
    check_syncmers({r["key"]: r for r in syncmers.compare_edits(docs.dropDuplicates(["key"]), "key").collect()}, dict(enumerate(texts)))
    assert syncmers.compare_edits(none).count() == 0
    one = syncmers.compare_edits(docs.where("key = 13")).collect()[0]
    assert one["near_next"] == 1.0
