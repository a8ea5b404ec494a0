"""Encoding by a trie, whitening and periodic runs against the library, numpy and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabvet.llm import bpe_trie, embedding_whitening, periodic_runs, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASHES = "lang string, ids string, decoded int, runs int, x int, n int, component string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    pieces = [" ", "'", "s", "'ll", "\n", "\t", "\x1c", "\x85", "\xa0", "9", "²", "é", "ª", "-", "漢", "😀", "ɐ", "<|endoftext|>", " the", "ing", "0"]
    return ["", None, "   ", "a" * 300, "-" * 200, " " * 90 + "x", "<|endoftext|><|endoftext|>", "don't we'll I'VE", "ab " * 400, "한국어 текст ไทย",
            *["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(300)],
            *["".join(rng.choices("etaoins", k=rng.randint(1, 60))) for _ in range(300)], "x" * 20_000 + " " + "ab" * 5_000, "same", "same"]


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(None if n % 50 == 7 else n, t, "en", "i", 1, 2, 3, 4, "c") for n, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[9]], "doc_id bigint, text string, " + CLASHES).repartition(3)


def test_encoding_is_the_librarys(table, texts):
    library = Tokenizer.from_file(PATH)
    want = [(None if n % 50 == 7 else n, library.encode(t or "", add_special_tokens=False).ids) for n, t in enumerate(texts)]
    want += [want[3], want[9]]
    back = bpe_trie.decode(bpe_trie.encode(table, PATH), PATH).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in back), key=order) == sorted(want, key=order)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in back)


def test_decoding_of_odd_ids(spark):
    rows = [(1, None), (2, []), (3, [50256, 220]), (4, [188]), (5, [99999999, None, -1, 64])]
    got = {r.doc_id: r.decoded for r in bpe_trie.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), PATH).collect()}
    library = Tokenizer.from_file(PATH)
    assert got == {1: "", 2: "", 3: "<|endoftext|> ", 4: library.decode([188]), 5: library.decode([64])}


def test_few_known_words_change_nothing(texts):
    small, library = bpe_trie.Encoder(PATH, known_words=5), Tokenizer.from_file(PATH)
    for t in texts:
        assert small.encode([t or ""])[0].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_branches_leave_the_trie_where_words_differ():
    assert bpe_trie.Trie([b"tea", b"ten", b"to", b"t", b"in", b"tea"]).branches == [(0, b"in"), (0, b"t"), (1, b"tea"), (3, b"tea"), (2, b"ten"), (1, b"to")]


def test_only_plain_byte_pair_encoding():
    with pytest.raises(ValueError):
        bpe_trie.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, embedding array<float>, vec_id bigint")
    assert bpe_trie.decode(bpe_trie.encode(none, PATH), PATH).collect() == []
    assert periodic_runs.periodic_runs(periodic_runs.with_period(none)).collect() == []
    assert embedding_whitening.whiten(none).collect() == []


def brute_runs(w, least=6, powers=4):
    out = []
    for q in range(1, len(w) // powers + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, powers * q) and not any(all(w[i + x] == w[i + x + p] for x in range(n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating_words(rng, letters, most):
    words = []
    while len(words) < most:
        words += rng.choices(letters, k=rng.randint(1, 6)) * rng.choice([1, 1, 2, 4, 7])
    return words


@pytest.mark.parametrize(("least", "powers"), [(6, 4), (4, 2), (2, 3)])
def test_runs(least, powers):
    rng = random.Random(least)
    documents = [repeating_words(rng, [b"a", b"b", b"c", b"d"][:rng.randint(1, 4)], rng.randint(0, 80)) for _ in range(400)]
    found = periodic_runs.runs_in(documents, least, powers)
    for k, w in enumerate(documents):
        assert found.get(k, []) == brute_runs(w, least, powers), w
    assert len(found) > 100


def test_suffix_array_and_lcp():
    rng = random.Random(4)
    s = [rng.randint(0, 2) for _ in range(300)]
    sa, isa = periodic_runs.suffix_arrays(np.array(s), np.zeros(len(s), np.int64))
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    lcp = periodic_runs.lcp_array(s, sa.tolist(), isa.tolist())
    for k in range(1, len(s)):
        a, b = s[sa[k - 1]:], s[sa[k]:]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    texts = ["", None, " \t\n", "one", "a " * 5, "a " * 6, "x a b a b a b a b y", "é\x0bé\x0cé é é é \x85", "w " * 3000]
    texts += [rng.choice(" \n").join(x.decode() for x in repeating_words(rng, [b"u", b"v", b"w"], rng.randint(1, 60))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "a a a a a a"), (None, "a a a a a a"), (3, "other text")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [*w[:a], *[w[a + (x - a) % p] for x in range(a, n)]]
        runs = brute_runs(w)
        gone = {x for s, length, q in runs for x in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want.append((i, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4),
                     sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r[:6]) + r[6:]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(1 for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0) > 5


def embeddings(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, d)) @ np.diag(np.linspace(1, 3, d)) + rng.standard_normal(d)


@pytest.mark.parametrize(("n", "d", "components", "guard"), [(900, 48, 32, 8), (300, 40, 5, 3), (50, 3, 32, 8)])
def test_whitening(spark, n, d, components, guard):
    x = embeddings(n, d)
    rows = [(i, v.tolist(), 1, 1, "c") for i, v in enumerate(x)]
    odd = [(None, x[0].tolist(), 1, 1, "c"), (n, None, 1, 1, "c"), (n + 1, [None] * d, 1, 1, "c"), (n + 2, [float("nan")] * d, 1, 1, "c"),
           (n + 3, [float("inf")] * d, 1, 1, "c"), (n + 4, [1.0], 1, 1, "c"), (n + 5, [], 1, 1, "c")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, n int, x int, component string").repartition(5)
    got = embedding_whitening.whiten(df, components=components, guard=guard).toPandas()
    ints = np.floor(64 * np.vstack([x, x[:1]])).astype(np.int64) + 1_000_000
    total, sums = n + 1, ints.sum(axis=0)
    c = ints - sums / total
    e, u = np.linalg.eigh(c.T @ c / total)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, d)
    assert len(got) == total * k and set(got.n) == {total} and got.vec_id.isna().sum() == k and got.vec_id.max() < n
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    exact = {i: int(((total * ints[i].astype(object) - sums.astype(object)) ** 2).sum()) for i in range(n)}
    of = got[got.vec_id.notna()]
    assert all(exact[i] == v for i, v in zip(of.vec_id, of.deviation, strict=True))
    for j in range(k):
        w = of[of.component == j + 1].sort_values("vec_id")
        np.testing.assert_allclose(w.explained, e[j] / e.sum(), rtol=1e-10)
        want = c[:n] @ u[:, j] / np.sqrt(e[j])
        np.testing.assert_allclose(w.whitened, want * np.sign(want @ w.whitened.to_numpy()), atol=1e-8)


def test_whitening_of_hard_spectra():
    rng = np.random.default_rng(3)
    u = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    for e in (np.ones(80), np.r_[1e9, 1e5, np.linspace(2, 1.9, 78)], np.r_[np.linspace(9, 1, 20), np.zeros(60)], np.r_[[5.0] * 40, [4.9] * 40], np.geomspace(1, 1e-9, 80)):
        v = (u * e) @ u.T
        found, q = embedding_whitening.leading_eigenvectors(lambda x, v=v: v @ x, 80, 32)
        np.testing.assert_allclose(found, np.sort(e)[::-1][:32], atol=1e-12 * e.max())
        assert np.abs(v @ q - q * found).max() <= 1e-12 * e.max() and np.abs(q.T @ q - np.eye(32)).max() < 1e-12


def test_nothing_to_whiten(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id bigint, embedding array<float>")
    assert embedding_whitening.whiten(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id bigint, embedding array<float>")
    assert {r.component for r in embedding_whitening.whiten(line).collect()} == {1}
    far = spark.createDataFrame([(i, [1e12 * i, 0.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        embedding_whitening.whiten(far).collect()
