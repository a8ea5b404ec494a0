"""The dealt operators against brute force on small tables, with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest

from tabvet.llm import (components, decontaminate, language_crf, minhash_dedup, mixing, order_minhash, repeats, seed_extend,
                        suffix_family, token_ids, url_filter, warc)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key int, words string"


@pytest.fixture(scope="module")
def corpus():
    """doc_id -> text: copies, near copies, shared passages, short, empty and null texts, a long one; ids out of order."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéßñ", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    base, passage = say(120), say(70)
    texts = [base, base, base, say(30) + "\n" + passage + " " + say(25), passage + " " + say(60), say(40) + "\t" + passage,
             " ".join([*base.split()[:110], *say(10).split()]), " ".join(["x", *base.split()[4:]]), "", None, "   ", "one two", "One TWO", "ONE two three",
             "ab " * 200, say(3000), "é" * 900, "a\x00b　c d", say(34), say(35), base.upper()]
    return dict(zip(rng.sample(range(-50, 500), len(texts)), texts, strict=True))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en", None if n % 5 == 0 else f"s{n % 3}", len(t or ""), "r", 1, "w") for n, (i, t) in enumerate(corpus.items())]
    return spark.createDataFrame([*rows, rows[3], rows[9]], DOCS).repartition(4)  # two rows twice


def test_order_minhash_report(docs, corpus):
    got = sorted(order_minhash.edit_report(docs).collect(), key=lambda r: (r.doc_id, r.n_chars))
    rows = sorted([*corpus.items(), *[list(corpus.items())[i] for i in (3, 9)]], key=lambda r: (r[0], r[1] or ""))
    make = order_minhash.OrderMinHash()
    assert len(got) == len(rows)
    for (i, t), (_, after), r in zip(rows, [*rows[1:], rows[0]], got, strict=True):
        t, after = t or "", after or ""
        changed = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(changed.encode()).hexdigest())
        one, two = make.coordinates(t), make.coordinates(changed)
        assert r.fingerprint == order_minhash.to_hex(one) and r.edited_fingerprint == order_minhash.to_hex(two)
        assert r.near_edited == np.mean(one == two) and r.near_next == np.mean(one == make.coordinates(after))


def test_order_minhash_selects_in_text_order():
    make = order_minhash.OrderMinHash(k=3, l=2, m=8)
    text = "abcabcabdxyzabc"
    grams = make.kmers(text)
    assert [make.kmers(text[i:i + 3])[0] for i in range(13)] == grams.tolist()
    count, value = Counter(), []
    for g in grams.tolist():
        number = np.array([count[g]], np.uint64)
        value.append(int((order_minhash.mix64(np.array([g], np.uint64) + number * make.numbering) >> np.uint64(32))[0]))
        count[g] += 1
    assert make.numbered(grams).tolist() == value and len(set(value)) == len(value)
    assert order_minhash.likeness(make.coordinates("abc" * 50 + "xyz" * 50), make.coordinates("xyz" * 50 + "abc" * 50)) < 1


def brute_near(texts):
    fold = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in texts:
        w = (t or "").translate(fold).encode().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    while True:
        before = dict(comp)
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if before == comp:
            return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(docs, corpus, block):
    want = brute_near(corpus.items())
    got = minhash_dedup.near_duplicates(docs, block=block).collect()
    assert len(got) == len(corpus) + 2
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, n, c, i == c) for i, (n, c) in want.items()}


def test_open_buckets_are_compared_whole(spark):
    """Sets linked to one another but not to the smallest of their bucket, in buckets cut into blocks."""
    rng = random.Random(2)
    core = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(24):
        w = list(core)
        for k in rng.sample(range(200), 6 if i % 2 else 3):
            w[k] = f"x{i}.{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), block=4).collect()}
    assert got == {i: c for i, (_, c) in brute_near(rows).items()}


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 250)]
    got = {(r.node, r.component) for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)} | {(i, 200) for i in (200, 250, 300)}


def brute_repeats(sequences, length):
    seen = Counter(tuple(s[i:i + length]) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        mask = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i:i + length])] > 1:
                mask[i:i + length] = [True] * length
        out.append(mask)
    return out


@pytest.mark.parametrize("together", [4096, 1])
def test_seed_extend(docs, corpus, together, monkeypatch):
    whole = repeats.repeated
    monkeypatch.setattr(repeats, "repeated", lambda *a, **k: whole(*a, **k, together=together))
    items = [*corpus.items(), *[list(corpus.items())[i] for i in (3, 9)]]
    sequences = [(t or "").encode().split() for _, t in items]
    want = sorted((i, len(w), sum(m), hashlib.sha256(b" ".join(x for x, gone in zip(w, m, strict=True) if not gone)).hexdigest())
                  for (i, _), w, m in zip(items, sequences, brute_repeats(sequences, 35), strict=True))
    got = seed_extend.without_repeats(seed_extend.repeated_spans(docs)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 500


@pytest.mark.parametrize(("together", "batches"), [(4096, 4), (1, 7)])
def test_suffix_family(docs, corpus, together, batches, monkeypatch):
    whole = repeats.repeated
    monkeypatch.setattr(repeats, "repeated", lambda *a, **k: whole(*a, **k, together=together))
    items = [*corpus.items(), *[list(corpus.items())[i] for i in (3, 9)]]
    sequences = [(t or "").encode() for _, t in items]
    want = sorted((i, len(s), sum(m), sum(a and not b for a, b in zip(m, [False, *m], strict=False)),
                   hashlib.sha256(bytes(x for x, gone in zip(s, m, strict=True) if not gone)).hexdigest())
                  for (i, _), s, m in zip(items, sequences, brute_repeats(sequences, 400), strict=True))
    got = suffix_family.without_repeats(suffix_family.repeated_spans(docs, batches=batches)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_levels_merge_geometrically(spark):
    family = suffix_family.SuffixFamily(spark, 3)
    for n in range(1, 8):
        found = family.add(spark.createDataFrame([(n,), (n + 100,), (100 + n // 2,), (-5 if n == 6 else -n,), (-n,)], "key bigint"))
        sizes = sorted({r["size"] for r in family.levels.select("size").distinct().collect()})
        assert sizes == [1 << b for b in range(3) if n >> b & 1]
        assert -n in {r.key for r in found.collect()} or n == 6


def test_runs_of_long_documents_in_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 100)
    first = np.array([0, 30, 30, 950, 1000])
    covered = [(d, a + k) for d, to, a, z in repeats._pieces(first, 20) for k in range(z - a - 19)]
    starts = {p for _, p in covered}
    assert all(p in starts for d in range(4) for p in range(first[d], first[d + 1] - 19))


def test_language_field(spark):
    rng = random.Random(1)
    kinds = {"aa": ["tion", "the", "ing", "was"], "bb": ["sch", "ung", "der", "keit"], "cc": ["eau", "oui", "ment", "les"]}
    def say(k, n):
        return " ".join("".join(rng.choices(kinds[k], k=2)) for _ in range(n))
    rows = [(i, say(k, 40), k) for i, k in enumerate(rng.choices(list(kinds), k=150))]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", None), (902, "123 !?", "bb"), (None, say("aa", 9), None)], "doc_id bigint, text string, lang string")
    field = language_crf.learn(docs.where(~language_crf.held_out()))
    out = language_crf.identify(docs.withColumn("score", language_crf.F.lit("clash")), field).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out if r.doc_id is not None and r.doc_id < 900)
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (900, 901, 902)} == {("und", 0.0)}
    held = {r.doc_id for r in docs.where(language_crf.held_out()).collect()}
    assert held == {r.doc_id for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert field.label([say("aa", 30) + " " + say("bb", 100)])[0] == ["bb"]
    none = language_crf.learn(docs.where("false"))
    assert none.label(["abc", ""]) == (["und", "und"], [0.0, 0.0])


def test_marginals_equal_enumeration():
    import itertools
    field = language_crf.LanguageField(["a", "b"])
    rng = np.random.default_rng(0)
    field.change = rng.normal(size=(2, 2)).astype(np.float32)
    e = rng.normal(size=(1, 4, 2)).astype(np.float32)
    word, _ = field.marginals(e, np.array([4]))
    want = np.zeros((4, 2))
    for path in itertools.product((0, 1), repeat=4):
        p = np.exp(sum(e[0, t, y] for t, y in enumerate(path)) + sum(field.change[a, b] for a, b in zip(path, path[1:], strict=False)))
        for t, y in enumerate(path):
            want[t, y] += p
    np.testing.assert_allclose(word[0], want / want.sum(axis=1, keepdims=True), rtol=1e-4)


def test_mixing(docs):
    got = mixing.mix_plan(docs.select("doc_id", "source", "text")).collect()
    size = Counter()
    for r in got:
        size[r.source] += r.mix_size
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, target, total = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, {}, sum(size.values())
    capped: set = set()
    while True:
        share = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * size[s] if s in capped else share * weight[s] for s in order}
        above = {s for s in order if target[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    taken = Counter()
    for r in got:
        taken[r.source] += r.mix_taken
        assert r.mix_source_size == size[r.source] and abs(r.mix_target - target[r.source]) < 1e-6 and 0 <= r.mix_taken <= 3 * r.mix_size
    assert all(taken[s] == int(target[s] + 0.5) for s in order) and len(got) == docs.count()
    again = mixing.mix_plan(docs.repartition(7).select("doc_id", "source", "text")).collect()
    assert sorted((r.doc_id, r.mix_taken) for r in again) == sorted((r.doc_id, r.mix_taken) for r in got)
    mixed = mixing.mixed_texts(docs).collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    want = Counter()
    for r in got:
        want[r.doc_id] += r.mix_taken
    assert +words == +want


def test_mixing_reaches_targets_of_small_sources(spark):
    say = lambda s, n: " ".join(f"{s}{k}" for k in range(n))
    sizes = {"a": [2], "b": [20], "c": [7], "d": [0], "e": [1, 0, 40, 3], "f": [5000, 900], None: [33, 33]}
    rows = [(n, s, say(s, k) if k else None) for s, ks in sizes.items() for n, k in enumerate(ks)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    plan = mixing.mix_plan(docs, texts=False).collect()
    for s, ks in sizes.items():
        own = [r for r in plan if r.source == s]
        assert sum(r.mix_taken for r in own) == int(own[0].mix_target + 0.5) and own[0].mix_source_size == sum(ks)
        assert all(0 <= r.mix_taken <= 3 * r.mix_size for r in own)
    assert {r.source: r.mix_taken for r in plan if r.source in ("a", "b", "c")} == {"a": 6, "b": 60, "c": 21}
    words = Counter()
    for r in mixing.mixed_texts(docs).collect():  # no other column than these three
        words[r.source, r.doc_id] += len(r.text.split())
    assert +words == +Counter({(r.source, r.doc_id): r.mix_taken for r in plan})


def test_sources_are_placed_without_python_workers(spark, monkeypatch):
    names = [None, "", "é", "Z", "a", "aa", *[f"s{i:02}" for i in range(40)]]
    sizes = spark.createDataFrame([(n, i) for i, n in enumerate(reversed(names))], "source string, source_size bigint").repartition(5)
    def refuse(frame):
        raise AssertionError("rows of a DataFrame go through Python workers")

    monkeypatch.setattr(type(sizes), "rdd", property(refuse))
    merged, parts = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (merged, parts)}
    try:
        spark.conf.set(merged, "false")
        spark.conf.set(parts, "7")
        got = {r.source: (r.place, r.source_size, r.weight) for r in mixing.source_targets(sizes).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    assert got == {s: (i, len(names) - 1 - names.index(s), (1.0, 2.0, 3.0)[i % 3]) for i, s in enumerate(order)}
    assert mixing.source_targets(sizes.limit(0)).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["doc_id", "mix_size", "mix_place", "text", "mix_source", "source", "place", "mix_taken", "extra_1", "words", "n_chars"]
    docs = spark.createDataFrame([(1, "x", "y", "a b c", "z", "s", 4, 5, "e", "w", 5), (2, None, None, None, None, None, None, None, None, None, None)],
                                 "doc_id bigint, mix_size string, mix_place string, text string, mix_source string, source string, place int, "
                                 "mix_taken int, extra_1 string, words string, n_chars int")
    got = mixing.mixed_texts(docs)
    assert got.columns == names and got.schema == docs.schema
    assert {tuple(r) for r in got.collect()} == {(1, "x", "y", "a b c", "z", "s", 4, 5, "e", "w", 5)}
    assert mixing.mix_plan(docs).count() == 2


def test_sainte_lague_takes_highest_quotients():
    rng = np.random.default_rng(4)
    for _ in range(30):
        w, most, seats = rng.integers(1, 50, 6).astype(float), rng.integers(0, 20, 6), int(rng.integers(0, 60))
        quotients = sorted(((-w[i] / (2 * k + 1), i) for i in range(6) for k in range(most[i])))[:seats]
        got = mixing.sainte_lague(w, seats, most)
        assert got.sum() == len(quotients)
        want = np.bincount([i for _, i in quotients], minlength=6)
        assert np.array_equal(got, want) or np.isclose(sorted(w / (2 * got + 1)), sorted(w / (2 * want + 1))).all()


def test_url_filter(spark):
    urls = ["http://Example.COM/en/a", "https://www.example.com/en/?x", "https://a.www.example.com/en/b", "http://x.net/es/", "http://x.net/ES/", "http://net/fr/1",
            "http://foo.com", "http://foo.com/", "http://foo.com?x=/", "nothing", "", None, "http://poker.org/Casino", "http://notexample.com/en/1", "ftp://u@b.com:80/en#f", "http://b.com/a#/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert got[i] == (host, path, best and best[0] + best[1], best[2] if best else "block" if i == 12 else "allow"), u
    many = [url_filter.host_rule("block", f"h{i}.org", "") for i in range(50)]
    judged = url_filter.judge(spark.createDataFrame([("http://h7.org/x",), ("http://z.h9.org",), ("http://h77.org/",)], "url string"), many, "r", block_rules=8).collect()
    assert [(r.r_rule, r.r_tried) for r in judged] == [("h7.org", 1), ("h9.org", 1), (None, 0)]


def test_token_ids(docs, corpus):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = sorted([*corpus.items(), *[list(corpus.items())[i] for i in (3, 9)]], key=lambda r: (r[0], r[1] or ""))
    got = sorted(token_ids.read_token_ids(token_ids.write_token_ids(docs, path, 2, block_ids=300)).collect(), key=lambda r: r.start)
    start = 0
    for (i, t), r in zip(rows, got, strict=True):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, mine = Tokenizer.from_file(path), token_ids.WordEncoder(path, cache_words=5)
    for text in ["", " ", "It's DON'T we'll 'S x's", "Ärger ÉTÉ ñandú İstanbul ΣΟΦΟΣ", "a,b.. c!? (d) 12 3.4 x2y", "été ﬁ ½ ª º µ", "日本 語 <|endoftext|> a<|startoftext|>b",
                 " x　y​z\x00\x1f", "ǅ Ǆ ŉ ẞ ß ſ K Å"]:
        assert mine.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_word_encoder_gives_a_piece_to_the_library_once():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, mine = Tokenizer.from_file(path), token_ids.kept_encoder(path, 50)
    texts = ["Lone, lone lone... ", "", "x\x1fy lone", "Été été! ΣΟΦΟΣ été's", "\u3000 \x85a\xa0b ", "!? lone!?"]
    asked, full = [], []
    model, tokenizer = mine.model, mine.tokenizer
    mine.model, mine.tokenizer = (SimpleNamespace(tokenize=lambda p: asked.append(p) or model.tokenize(p)),
                                  SimpleNamespace(encode=lambda t, **k: full.append(t) or tokenizer.encode(t, **k)))
    for _ in range(2):  # a second task of the worker
        assert token_ids.kept_encoder(path, 50) is mine
        ids, counts = mine.encode_all(texts)
        want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert len(asked) == len(set(asked)) and asked.count("lone") == 1
    assert [t for t in full if t != texts[2]] == list(dict.fromkeys(t for t in full if t != texts[2]))
    mine.chunk_chars = 4
    assert [x.tolist() for x in mine.encode_all(texts)] == [ids.tolist(), counts.tolist()]
    assert [x.tolist() for x in mine.encode_all([])] == [[], []]
    token_ids.kept_encoder.cache_clear()


def test_block_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ids = np.concatenate([rng.integers(0, 300, n), rng.integers(0, 1 << 17, n // 2)])
        counts, keys = np.array([len(ids), 0]), [None, -7]
        got, of, back = token_ids.decode_block(token_ids.encode_block(ids, counts, keys))
        assert got.tolist() == ids.tolist() and of.tolist() == counts.tolist() and back == keys
    with pytest.raises(ValueError):
        token_ids.decode_block(b"x" * 60)


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    html = ["<a>", "<a>", None, "", "<long é payload>", "<long é payload>", "<long é payload>", "z" * 300_000]
    pages = spark.createDataFrame([(i * 3, None if i == 1 else f"http://h/{i}", h, "x") for i, h in enumerate(html)] + [(None, "http://n/\r\nX: y", "only", "x")],
                                  "page_id bigint, url string, html string, digest_hex string").repartition(3)
    got = {r.page_id: r for r in warc.read_packages(warc.write_packages(pages, least_bytes=least, package_bytes=400)).collect()}
    assert len(got) == len(html) + 1
    for i, h in enumerate(html):
        raw, r = (h or "").encode(), got[i * 3]
        keeper = max(k for k, x in enumerate(html) if (x or "") == (h or "")) if len(raw) >= least else i
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if keeper == i else ("revisit", keeper * 3))
        assert r.payload == (raw if keeper == i else None)


def test_packages_with_64_bit_fields_read_the_same():
    records = [warc.page_record(str(i), "http://x", "D" * 32, 3, b"abc", None) for i in range(5)]
    for z in (False, True):
        package, reads = warc.write_package(records, zip64=z), []
        def fetch(at, n, package=package, reads=reads):
            reads.append(n)
            return package[at:at + n]
        got = list(warc.read_package(fetch, len(package)))
        assert [k for k, *_ in got] == list("01234") and all(b.endswith(b"abc") for *_, b in got)
        assert set(warc.members(fetch, len(package))) == {"archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"}
    with pytest.raises(ValueError):
        warc.members(lambda at, n: b"x" * n, 100)


def test_records_and_index_have_times_and_url_keys():
    keys = {"http://www.Example.com:80/A/b?Q=1#f": "com,example,www)/a/b?q=1", "https://u@x.org:8443": "org,x:8443)/", "http://x.org?a b": "org,x)/?a%20b",
            "no url": "no%20url", "": "-"}
    assert {u: warc.url_key(u) for u in keys} == keys
    urls = ["http://b.org/2", "http://a.org/1", "", "http://a.org/\u2028 x"]
    package = warc.write_package([warc.page_record(str(i), u, "D" * 32, 3, b"abc", None, "2024-01-31T10:20:30Z") for i, u in enumerate(urls)])
    fetch = lambda at, n: package[at:at + n]
    m = warc.members(fetch, len(package))["indexes/index.cdxj"]
    lines = fetch(warc.content_at(fetch, m), m.size).decode().split("\n")[:-1]
    assert [x.split(" ", 2)[:2] for x in lines] == [[k, "20240131102030"] for k in sorted(map(warc.url_key, [*urls[:3], "http://a.org/%2028 x"]))]
    got = {k: head for k, head, _ in warc.read_package(fetch, len(package))}
    assert set(got) == set("0123") and all(h["WARC-Date"] == "2024-01-31T10:20:30Z" for h in got.values())
    assert [k for k, *_ in warc.read_package(fetch, len(package), lambda key, entry: key.startswith("org,b)"))] == ["0"]


def test_package_files_are_read_by_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", "x" * (i % 9)) for i in range(60)], "page_id bigint, url string, html string").repartition(3)
    packages = warc.write_packages(pages, package_bytes=2000)
    files = warc.write_files(packages, (tmp_path / "packages").as_uri())
    assert files.count() == packages.count() == len(list((tmp_path / "packages").iterdir())) > 3
    rows = lambda df: sorted(map(tuple, df.collect()))
    key = lambda df: df.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "payload")
    assert rows(key(warc.read_files(files))) == rows(key(warc.read_packages(packages)))
    some = warc.read_files(files, lambda key, entry: key.startswith("org,h3)"))
    assert {r.page_id for r in some.collect()} == {i for i in range(60) if i % 7 == 3}


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination(spark, docs, corpus, block):
    some = [t for t in corpus.values() if t and len(t.split()) > 60]
    items = [(1, " ".join(some[0].split()[5:40])), (12, "ONE, two"), (2, " ".join(some[3].split()[:13])), (3, None), (4, "..."), (None, " ".join(some[1].split()[:20])), (1, "never seen")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    fold = {c: c + 32 for c in range(65, 91)}
    def cut(t):
        return "".join(chr(c) if c >= 128 or chr(c).isalnum() else " " for c in map(ord, (t or "").translate(fold))).split(" ")
    w = {i: [x for x in cut(t) if x] for i, t in corpus.items()}
    got = decontaminate.contamination(docs, bench, shard_words=100, block_phrases=block)
    for r in got.collect():
        hit, ids = set(), set()
        for item, t in items:
            x = [y for y in cut(t) if y]
            for k in range(max(1, len(x) - 12) if x else 0):
                phrase = x[k:k + 13]
                for at in range(len(w[r.doc_id]) - len(phrase) + 1):
                    if w[r.doc_id][at:at + len(phrase)] == phrase:
                        hit |= set(range(at, at + len(phrase)))
                        ids |= {item} - {None}
        assert (r.n_words, r.n_hit, sorted(r.item_ids)) == (len(w[r.doc_id]), len(hit), sorted(ids))
    assert got.count() == len(corpus) + 2


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y y gamma"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, "gamma")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma")], "item_id bigint, text string")
    near = lambda slop: {r.doc_id for r in decontaminate.contamination(docs, bench, slop=slop).where("n_hit > 0").collect()}
    assert near(3) == {1} and near(2) == set()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert order_minhash.edit_report(docs).count() == minhash_dedup.near_duplicates(docs).count() == 0
    assert seed_extend.repeated_spans(docs).count() == suffix_family.repeated_spans(docs).count() == 0
    assert mixing.mixed_texts(docs).count() == decontaminate.contamination(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert token_ids.read_token_ids(token_ids.write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2)).count() == 0
    assert warc.read_packages(warc.write_packages(spark.createDataFrame([], "page_id bigint, url string, html string"))).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, None), (5, "a b c")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (None, 0, None, True), (4, 1, 4, True), (5, 1, 4, False)], key=str)
    assert order_minhash.edit_report(docs).count() == 4
    starts = [r.start for r in token_ids.read_token_ids(token_ids.write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2)).collect()]
    assert len(starts) == 4 and min(starts) == 0
