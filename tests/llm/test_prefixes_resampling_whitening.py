"""Prefix BPE against the library, resampling and whitening against brute force, all on hostile rows too."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import bpe_prefixes, importance, queries, whitening

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = {"id": 1, "ids": 2, "n": 3, "d": 4, "v": 5, "rank": 6, "score": 7, "component": 8, "_n": 9, "_part": 10, "last": "x", "new": "y", "bucket": 1}
LETTERS = "abe'stl 01 \n\t.,-é漢\U0001f600x×_<|"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe_prefixes.prefix_bpe(RANKS, PATTERN).vocabulary


@pytest.fixture(scope="module")
def hostile(spark):
    long = " ".join(f"word{i % 977} of" for i in range(60_000))
    texts = [None, "", "   \n\t", "One", "one two three 4", "one two three 4", long, long + " end", "éàü ñ 漢字 ☃ don't <|endoftext|> x", "x" * 50_000, " " * 3000 + "y", "\0 nul\x85 '"]
    texts += [" ".join(f"w{(i * j) % 61}" for j in range(25)) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[4]), (None, long), (5, "another text of one id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})


def test_every_token_and_random_pieces_as_the_library(vocabulary, library):
    one = library._core_bpe.encode_single_piece
    assert not vocabulary.odd and all(vocabulary.encode_piece(t) == [i] for t, i in vocabulary.ranks.items())
    rng = random.Random(5)
    for letters in ("ab", "etaoin shrdlu", " ", "a", "\n ", ".-=", "éè漢字x"):
        for size in (1, 7, 300, 4000):
            piece = "".join(rng.choice(letters) for _ in range(size)).encode()
            assert vocabulary.encode_piece(piece) == one(piece)


def test_tokens_that_no_merge_makes_stand_for_whole_pieces(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"xyz", b"abc"]  # xyz has no halves
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    v = bpe_prefixes.Vocabulary(str(path))
    own = tiktoken.Encoding("few", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert v.odd == {257}
    for p in (b"xyz", b"xyzx", b"abcab", b"aabc", b"cab"):
        assert v.encode_piece(p) == own._core_bpe.encode_single_piece(p)
    path.write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError):
        bpe_prefixes.Vocabulary(str(path))


def test_appends_and_edits_equal_a_new_encoding(vocabulary, library):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice(LETTERS) for _ in range(rng.randrange(n)))
    for _ in range(600):
        p = bpe_prefixes.Prefixes(vocabulary, PATTERN, some(60))
        for _ in range(4):
            at = rng.randrange(len(p.text) + 3)
            end, new = at + rng.randrange(6), some(7)
            want = p.text[:at] + new + p.text[end:]
            p.edit(at, end, new)
            assert p.text == want and p.ids() == library.encode_ordinary(want)
    long = bpe_prefixes.Prefixes(vocabulary, PATTERN, "".join(rng.choice("etaoinshrdlu") for _ in range(20_000)))
    assert long.edit(10_000, 10_003, "zzz") < 1000 and long.ids() == library.encode_ordinary(long.text)
    assert long.append("abc") == 3 and long.ids() == library.encode_ordinary(long.text)


def test_op11_on_hostile_rows_and_on_all_documents(spark, hostile, library):
    digest = lambda s: hashlib.sha256(s).hexdigest()
    for docs in (hostile, hostile.where("false"), hostile.repartition(3)):
        both = bpe_prefixes.decode(bpe_prefixes.encode(docs, RANKS, PATTERN), RANKS).collect()
        got = sorted((r.doc_id or -1, r.ids, bytes(r.decoded)) for r in both)
        assert got == sorted((r.doc_id or -1, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {}
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (r.doc_id, len(ids), digest(" ".join(map(str, ids)).encode()), digest((r.text or "").encode()))
    got = queries.op11_bpe_prefixes(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs) and all(tuple(r) == want[r.doc_id] for r in got)
    with pytest.raises(Exception, match="lacks"):
        bpe_prefixes.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), RANKS).collect()
    nothing = bpe_prefixes.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first()
    assert (nothing.ids, bytes(nothing.decoded)) == ([], b"")


def test_stored_prefixes_take_edits(spark, hostile, library):
    docs = hostile.where("doc_id <> 9 or doc_id is null")
    stored = bpe_prefixes.prefixes(docs, RANKS, PATTERN)
    edits = spark.createDataFrame([(3, 2, None, None, "!"), (3, 1, 1, 2, "ab"), (4, 1, None, None, " more"), (6, 1, 5, 9, ""), (0, 1, 7, 1, "new"), (99, 1, 0, 0, "nobody"), (None, 1, 0, 0, "nobody"), (8, 1, 10_000, None, "é")], "doc_id long, seq int, at long, end long, new string")
    after = bpe_prefixes.edited(stored, edits, RANKS, PATTERN)
    texts = {}
    for r in docs.collect():
        t = r.text or ""
        for d, _, at, end, new in sorted((e for e in map(tuple, edits.collect()) if e[0] is not None and e[0] == r.doc_id), key=lambda e: e[1]):
            at = len(t) if at is None else min(at, len(t))
            end = at if end is None else max(at, end)
            t = t[:at] + (new or "") + t[end:]
        texts.setdefault(r.doc_id, []).append(t)
    got: dict = {}
    for r in after.join(bpe_prefixes.read_ids(after, RANKS, PATTERN).withColumnRenamed("doc_id", "k").distinct(), F.expr("doc_id <=> k")).select("doc_id", "text").collect():
        got.setdefault(r.doc_id, set()).add(r.text)
    assert {k: set(v) for k, v in texts.items()} == got
    ids = sorted((r.doc_id or -1, r.ids) for r in bpe_prefixes.read_ids(after, RANKS, PATTERN).collect())
    assert ids == sorted((k or -1, library.encode_ordinary(t)) for k, v in texts.items() for t in v)


def plain_features(text, n, buckets):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("n", [1, 3])
def test_op12_against_brute_force(spark, hostile, n):
    target = spark.createDataFrame([("one two Three w1 w2",), (None,), ("éàü 漢字",)], "text string")
    buckets = 97
    rows = [(r.doc_id, *plain_features(r.text, n, buckets)) for r in hostile.collect()]
    s, t = (np.bincount(np.concatenate([np.array(x, int) for x in parts]), minlength=buckets).tolist() for parts in ([f for _, _, f in rows], [plain_features(r.text, n, buckets)[1] for r in target.collect()]))
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    want = []
    for doc, words, found in rows:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        want.append([len(words) >= 20, -(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))), -1 if doc is None else doc, len(found), weight])
    able = sorted(w for w in want if w[0])
    ranks = [(w, k + 1 if k < len(able) * 30 // 100 else None) for k, w in enumerate(able)] + [(w, None) for w in want if not w[0]]
    got = importance.resample(hostile, target, n=n, buckets=buckets, share=(30, 100)).collect()
    key = lambda r: tuple(-9 if x is None else x for x in r)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=key) == sorted(((w[2], w[3], w[4], -w[1], k) for w, k in ranks), key=key)
    assert importance.resample(hostile.where("false"), target, n=n).count() == 0
    assert importance.resample(hostile, target.where("false"), n=n).count() == hostile.count()


def test_the_ring_goes_on_over_blocks(monkeypatch):
    monkeypatch.setattr(importance, "_BLOCK", 5)
    text = "Alpha béta  gamma-delta x y z " * 20
    for n in (1, 2, 4):
        words, found = importance.text_buckets(text, n, 1000)
        plain, want = plain_features(text, n, 1000)
        assert words == len(plain) and sorted(np.concatenate(found).tolist()) == sorted(want)


def test_ranks_of_a_hot_key_are_dealt_out(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("score"), F.col("id").alias("_n"))
    placed, before = importance.ranked(rows, [F.desc("score"), F.asc("_n")], 8)
    got = placed.join(before, "_part").select("score", "_n", (F.col("_before") + F.col("_at")).alias("k")).orderBy("k").collect()
    assert [r.k for r in got] == list(range(3000)) and [(-r.score, r._n) for r in got] == sorted((-r.score, r._n) for r in got)
    assert max(r["count"] for r in placed.groupBy("_part").count().collect()) < 1000


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({k: F.lit(v) for k, v in CLASH.items()})


def brute(rows, most):
    c = np.floor(1024 * np.array([np.float32(v).astype(float) for _, v in rows])) + 100_000
    n, s = len(c), c.sum(axis=0)
    v = (c - s / n).T @ (c - s / n) / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:most]
    x = c.astype(np.int64).astype(object)
    return e[order] / np.trace(v), (c - s / n) @ u[:, order] / np.sqrt(e[order]), [int(d) for d in ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)]


def test_op13_against_brute_force(spark):
    rng = np.random.default_rng(8)
    mixed = rng.normal(size=(5, 5))
    rows = [(i, [float(x) for x in rng.normal(size=5) @ mixed + 3]) for i in range(300)]
    rows += [(3, rows[3][1]), (None, rows[5][1])]
    other = [(1000 + i, [float(x) for x in rng.normal(size=3)]) for i in range(50)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 2.0, 3.0, 4.0]), (2003, [float("nan")] * 5), (2004, [float("inf")] * 5)]
    for tile, block in ((2, 7), (32, 4096)):
        got = whitening.whiten(vectors(spark, rows + other + odd).repartition(5), most=4, tile=tile, rows=block).collect()
        assert len(got) == 4 * len(rows) + 3 * len(other)
        for part in (rows, other):
            explained, white, deviation = brute(part, 4)
            mine: dict = {}
            for r in got:
                mine.setdefault(r.vec_id, []).append(r)
            signs = None
            for (vec_id, _), w, d in zip(part, white, deviation, strict=True):
                own = sorted(mine[vec_id], key=lambda r: r.component)[:: 2 if vec_id == 3 else 1]
                assert [r.component for r in own] == list(range(1, len(w) + 1)) and all(r.n == len(part) and r.deviation == d for r in own)
                values = np.array([r.whitened for r in own])
                signs = np.sign(values * w) if signs is None else signs
                assert np.allclose(values, w * signs, atol=1e-9) and np.allclose([r.explained for r in own], explained, rtol=1e-9) and own[0].identity_error < 1e-9


def test_op13_is_the_same_however_rows_are_dealt(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = (sorted((r.vec_id, r.component, r.deviation, r.explained, r.whitened) for r in whitening.whiten(data.repartition(k), rows=50, tile=t).collect()) for k, t in ((2, 32), (7, 10)))
    assert [x[:4] for x in a] == [x[:4] for x in b] and np.allclose([x[4] for x in a], [x[4] for x in b], rtol=0, atol=1e-12)


def test_op13_without_variance_and_at_the_ends(spark):
    same = whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert {(r.whitened, r.deviation, r.explained, r.identity_error) for r in same} == {(0.0, 0, 0.0, 1.0)}
    one = whitening.whiten(vectors(spark, [(1, [0.5])])).collect()
    assert [(r.n, r.deviation, r.whitened) for r in one] == [(1, 0, 0.0)]
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])])).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id < 3} == {2**63 - 1}
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
