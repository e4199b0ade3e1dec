"""Corpus operators against brute force, exact round trips, held-out accuracy and the cases their texts define."""

import collections
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from paperloom.llm import common, exact_dedup, license_scan, license_texts, line_dedup, ngrams, quality_classifier, quality_rules, sentencepiece_lattice, simhash, source_mixing, token_counts, url_filter, vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `digest` string, `b` int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, "One two", "en", "a", 7, "x", 1), (4, "one two", "en", "a", 7, None, 1), (4, "one two", "en", "a", 7, None, 1),
    (5, "ÉCOLE école\x0b\n\n x", "fr", "a", 9, "x", 1), (6, "A b c d e f g h i j " * 3000, "en", "b", 60000, "x", 1), (7, "a b c d e f g h i j " * 3000, "en", "b", 60000, "x", 1), (None, "no id here", "en", "b", 10, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, SF, "labels")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_lower_az_equals_translate_on_every_code_point(spark):
    chars = [chr(c) + "Aé" for c in range(1, 0x3000)] + ["", "ABC", "%41+ %zz"]
    df = spark.createDataFrame([(c,) for c in chars], "t string")
    assert df.where(common.lower_az(F.col("t")) != F.translate("t", common.UPPER, common.UPPER.lower())).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [26, 13])
def test_the_filter_loses_no_key(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    df = spark.createDataFrame([(i if i else None, i, "x") for i in range(5000)], "id long, `__slot` int, `__bits` string")
    keys = spark.createDataFrame([(i,) for i in range(-500, 5000, 7)] + [(None,)], "k long")
    rest, perhaps = common.split_by_filter(df, F.col("id"), keys)
    assert rest.columns == perhaps.columns == df.columns and rest.count() + perhaps.count() == 5000
    may = {r["__slot"] for r in perhaps.collect()}
    assert may >= {0} | {i for i in range(1, 5000) if (i + 500) % 7 == 0} and (bits < 20 or len(may) < 800)
    none = common.split_by_filter(df, F.col("id"), keys.limit(0))
    assert none[0].count() == 5000 and none[1].count() == 0


# ---- 10, 1 ----


def test_exact_dedup(docs, edge, empty):
    for df in (docs, edge):
        rows = df.select("doc_id", "text").collect()
        groups = collections.defaultdict(list)
        for r in rows:
            groups[(r.text or "").translate(AZ)].append(r.doc_id)
        want = sorted((str(r.doc_id), str(max((i for i in g if i is not None), default=None)), len(g), hashlib.sha256((r.text or "").translate(AZ).encode()).hexdigest()) for r in rows for g in [groups[(r.text or "").translate(AZ)]])
        got = exact_dedup.dedup_report(df).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
        assert exact_dedup.exact_dedup(df).count() == len(groups)
        assert exact_dedup.exact_dedup(df).columns == df.columns
    assert exact_dedup.dedup_report(empty).count() == 0


def test_exact_dedup_is_resumed(spark, docs, tmp_path, monkeypatch):
    """A run that is killed in its second batch goes on from its state when it is started again on its folder."""
    folder, source = f"file://{tmp_path}/run", f"file://{tmp_path}/docs"
    docs.repartition(6).write.parquet(source)
    rows = spark.read.parquet(source)
    kill, save = [True], DataFrameWriter.parquet

    def dying(self, path, *args, **more):
        if kill[0] and "/state/batch=1" in path:
            raise RuntimeError("killed")
        return save(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", dying)
    with pytest.raises(Exception, match="killed"):
        exact_dedup.dedup_report(rows, folder, 1)
    kill[0] = False
    first = [p.stat().st_mtime_ns for p in sorted((tmp_path / "run/state/batch=0").glob("*.parquet"))]
    got = exact_dedup.dedup_report(rows, folder, 1)
    assert sorted(map(str, got.collect())) == sorted(map(str, exact_dedup.dedup_report(docs).collect()))
    assert first == [p.stat().st_mtime_ns for p in sorted((tmp_path / "run/state/batch=0").glob("*.parquet"))]
    assert len(list((tmp_path / "run/state").glob("batch=*"))) >= 3


def test_different_texts_of_one_digest_stay_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "aa"), (4, "AB"), (5, "c")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(c, 1, 1))
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_report(rows).collect()}
    assert got == {1: (3, 2, False), 2: (4, 2, False), 3: (3, 2, True), 4: (4, 2, True), 5: (5, 1, True)}


def brute_fingerprint(text):
    words = WORDS.findall((text or "").translate(AZ))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_rows_meet_only_those_of_near_population_counts(monkeypatch):
    """Pairs whose population counts differ beyond the radius are never compared, whatever the bucket's size."""
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    fp[250:] = fp[:250] ^ np.uint64(5)
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, pop = fp[order], np.bitwise_count(fp[order]).astype(int)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (compared.append(len(x)), count(x))[1])
    a, b = simhash._links(np.zeros(500, np.int64), np.zeros(500, np.int8), fp)
    near = sum(abs(p - q) <= simhash.RADIUS for i, p in enumerate(pop) for q in pop[:i])
    assert sum(compared[1:]) == near < 500 * 499 // 2 * 0.8
    monkeypatch.undo()
    whole = simhash._forest(*(np.array(x) for x in zip(*((i, j) for i in range(500) for j in range(i) if int(count(fp[i] ^ fp[j])) <= 2), strict=True)), 500)
    assert sorted(a) == sorted(whole[0])


@pytest.mark.parametrize("tile", [simhash.TILE, 3])
def test_simhash_equals_brute_force(spark, docs, edge, tile):
    near = spark.createDataFrame([(10_000 + i, f"{w} " + "common words stand here in a row and more of them " * 40) for i, w in enumerate("one two three four five six".split())], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(near).union(edge.select("doc_id", "text"))
    local = [(r.doc_id, brute_fingerprint(r.text)) for r in rows.collect()]
    up = list(range(len(local)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(local)):
        for j in range(i):
            if bin(local[i][1] ^ local[j][1]).count("1") <= 2:
                up[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(local):
        least[root(i)] += [d] if d is not None else []
    want = sorted((str(d), f"{fp:016x}", str(min(least[root(i)], default=None))) for i, (d, fp) in enumerate(local))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(rows, tile).collect())
    assert got == want


def test_simhash_tiles_lose_no_link(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(3))) for b in base for _ in range(40)})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for tile in (1, 4, 30, 2048):
        got = {r.node: r.root for r in common.connected_components(simhash.links(df, tile)).collect()}
        groups = collections.defaultdict(set)
        for f in fps:
            groups[got.get(int(np.uint64(f).astype(np.int64)), f)].add(f)
        up = {f: f for f in fps}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i, a in enumerate(fps):
            for b in fps[:i]:
                if bin(a ^ b).count("1") <= 2:
                    up[root(a)] = root(b)
        want = collections.defaultdict(set)
        for f in fps:
            want[root(f)].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_dedup_keeps_one_of_each(docs, empty):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert simhash.near_duplicates(empty).count() == 0


# ---- 2, 5 ----


def brute_rules(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_equal_brute_force(docs, edge, empty, labels):
    model = quality_rules.train(docs, labels)
    for df in (docs, edge):
        got = quality_rules.quality_rules(df, model).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((str(r.doc_id), *brute_rules(r.text)) for r in df.select("doc_id", "text").collect())
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality_rules.quality_rules(empty, model).count() == 0


def test_words_across_segments(monkeypatch):
    text = ("alpha beta gamma delta " * 500).encode()
    whole = ngrams.words_of([text, b"", b"x"])
    monkeypatch.setattr(ngrams, "SEGMENT", 101)
    parts = ngrams.words_of([text, b"", b"x"])
    assert (whole.h == parts.h).all() and (whole.doc == parts.doc).all() and (whole.shape == parts.shape).all()


def test_classifier_on_the_held_out_fold(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = quality_classifier.scored(docs, quality_classifier.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.predicted for r in rows if r.quality == 1], [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)


def test_classifier_edges(docs, edge, empty, labels):
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.scored(edge, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_classifier.keep_quality(edge, model, 0.0).columns == edge.columns
    assert quality_classifier.train(empty, labels).scores([b"a"])[0] == 0.5
    assert quality_classifier.scored(empty, model).count() == 0


# ---- 3, 7 ----


@pytest.fixture(scope="module")
def vocab():
    return vocabulary.load()


def test_counts_equal_the_tokenizers_library(docs, vocab):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.Unigram(list(zip(vocab.pieces, vocab.scores, strict=True)), 0, True))
    other.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    rng = random.Random(2)
    texts = [t for t in texts_of(docs).values() if t][:60] + ["", " ", "  a", "a  b ", "\n\n", "é▁x", "日本語", "😀 x", "<s> <0x0A>"] + ["".join(rng.choice("ab \nété日😀<>s▁") for _ in range(rng.randrange(40))) for _ in range(300)]
    counter = token_counts.TokenCounter(vocab)
    assert [counter.count(t) for t in texts] == [len(other.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_rows(docs, edge, empty, vocab):
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(edge, vocab).collect()}
    assert got[1] == got[2] == 0 and got[6] > 30_000
    assert token_counts.token_counts(empty, vocab).count() == 0


def tiny():
    pieces = ["<u>", "▁", "a", "b", "▁a", "ab", "aa", "ba", "▁ab", *(f"<0x{i:02X}>" for i in range(256))]
    scores = [-9, -1, -1.5, -1.2, -1.1, -0.7, -1.9, -1.3, -2.0, *[-9.0] * 256]
    return vocabulary.Vocabulary(tuple(pieces), tuple(scores), tuple(range(9, 265)), frozenset({0}))


def segmentations(text, v):
    if not text:
        return [((), 0.0)]
    return [((p, *rest), s + v.scores[v.pieces.index(p)]) for n in range(1, len(text) + 1) for p in [text[:n]] if p in v.pieces[1:9] for rest, s in segmentations(text[n:], v)]


def test_samples_follow_the_exact_law():
    v, n = tiny(), 20_000
    every = [((*a, *c), s + t) for a, s in segmentations("▁aba", v) for c, t in segmentations("▁ab", v)]
    z = math.log(sum(math.exp(s) for _, s in every))
    p = {a: math.exp(s - z) for a, s in every}
    found, logp, inclusion = sentencepiece_lattice.encode([b"aba ab"] * n, list(range(n)), v, 2)
    pairs = collections.Counter(tuple(tuple(v.pieces[j] for j in found[t][0][found[t][1][i] : found[t][1][i + 1]]) for t in (0, 1)) for i in range(n))
    assert all(a != b for a, b in pairs)
    expected = {(a, b): n * p[a] * p[b] / (1 - p[a]) for a in p for b in p if a != b}
    chi2, df = sum((pairs[k] - e) ** 2 / e for k, e in expected.items()), len(expected) - 1
    assert abs(chi2 - df) < 5 * math.sqrt(2 * df)
    weights = np.exp(logp - inclusion).sum(axis=0)  # Horvitz-Thompson: averages to 1
    assert abs(weights.mean() - 1) < 5 * weights.std() / math.sqrt(n)
    few = sentencepiece_lattice.encode([b"a b"], [1], v, 9)
    assert np.isfinite(few[1][:, 0]).sum() == len(segmentations("▁a", v)) * len(segmentations("▁b", v))


def test_encoding_round_trips_and_ignores_batches(docs, edge, empty, vocab):
    texts = [(t or "").encode() for t in texts_of(docs).values()][:40] + [b"", b" ", b"  a", "a▁b 日本😀\n".encode(), b"x" * 5000]
    found, logp, _ = sentencepiece_lattice.encode(texts, list(range(len(texts))), vocab, 2)
    bytes_of = sentencepiece_lattice._pool_of(vocab).bytes_of
    for t in range(2):
        for i, text in enumerate(texts):
            if np.isfinite(logp[t, i]):
                assert sentencepiece_lattice.decode(found[t][0][found[t][1][i] : found[t][1][i + 1]].tolist(), bytes_of) == text
    alone = sentencepiece_lattice.encode(texts[7:8], [7], vocab, 2)
    assert (alone[0][1][0] == found[1][0][found[1][1][7] : found[1][1][8]]).all()
    rows = sentencepiece_lattice.sampled_encodings(edge, vocab, with_ids=True).collect()
    assert len(rows) == len(EDGE) and all(r.round_trip and [len(x) for x in r.ids] == r.n_pieces for r in rows)
    assert sentencepiece_lattice.sampled_encodings(empty, vocab).count() == 0
    back = sentencepiece_lattice.decoded(sentencepiece_lattice.sampled_encodings(edge, vocab, with_ids=True).select("doc_id", F.element_at("ids", 1).alias("ids"), F.lit("x").alias("text")), vocab)
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((r[0], r[1] or "")) for r in EDGE)


def test_a_small_pool_gives_the_same_samples(docs, vocab):
    """The pool turns over between batches; what it keeps or drops changes no result."""
    texts = [(t or "").encode() for t in texts_of(docs).values()][:60]
    want = sentencepiece_lattice.Sampler(sentencepiece_lattice.Pool(vocab), [t.decode() for t in texts], np.arange(60, dtype=np.uint64)).samples(2)
    pool = sentencepiece_lattice.Pool(vocab, 500)
    for i in range(0, 60, 3):
        paths, logp, kappa = sentencepiece_lattice.Sampler(pool, [t.decode() for t in texts[i : i + 3]], np.arange(i, i + 3, dtype=np.uint64)).samples(2)
        assert np.array_equal(logp, want[1][:, i : i + 3]) and np.array_equal(kappa, want[2][i : i + 3])
        pool.turn()
        assert pool.n_pos <= 250 + 500


def test_new_chunks_are_added_in_parts_of_bounded_memory(vocab):
    """Many new chunks take little more than what the pool holds of them, and get the lattices they have when added at once."""
    rng = np.random.default_rng(8)
    chunks = sorted({"▁" + bytes(w).decode() for w in rng.integers(97, 123, (60_000, 7), dtype=np.uint8)})
    pool, whole = sentencepiece_lattice.Pool(vocab), sentencepiece_lattice.Pool(vocab)
    tracemalloc.start()
    try:
        numbers = pool.numbers(chunks)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak - held < 40 << 20
    whole._add(chunks)
    assert numbers.tolist() == list(range(len(chunks))) and (pool.n_words, pool.n_pos, pool.n_edges) == (whole.n_words, whole.n_pos, whole.n_edges)
    for name, n in (("start", pool.n_words), ("size", pool.n_words), ("first", pool.n_pos + 1), ("length", pool.n_edges), ("piece", pool.n_edges), ("logp", pool.n_edges), ("cum", pool.n_edges)):
        assert np.array_equal(getattr(pool, name)[:n], getattr(whole, name)[:n]), name
    assert (pool.numbers(chunks[:3]) == [0, 1, 2]).all() and not len(pool.numbers([]))
    long = ["▁" + "ab" * n for n in range(15_000, 15_040)]  # of 1.2 million characters: one part, as each takes 30,000 steps
    assert [len(x) for x in sentencepiece_lattice._parts(long, sentencepiece_lattice.ADDED)] == [40]
    assert [c for x in sentencepiece_lattice._parts([*chunks[:9], *long[:1], *chunks[9:]], 10) for c in x] == [*chunks[:9], *long[:1], *chunks[9:]]


def test_a_text_without_spaces_of_ten_million_characters(vocab):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, 5000, dtype=np.uint8)) * 2000, b"x" * 200_000]
    found, logp, _ = sentencepiece_lattice.encode(texts, [1, 2], vocab, 2)
    assert np.isfinite(logp).all()
    for t in range(2):
        assert sentencepiece_lattice.round_trips(*found[t], texts, np.ones(2, bool), vocab).all()


def test_uniforms_stay_inside():
    u = sentencepiece_lattice._unit(np.array([0, (1 << 64) - 1], np.uint64))
    assert 0 < u[0] < u[1] < 1


def test_the_trie_finds_every_piece(vocab):
    pool = sentencepiece_lattice.Pool(vocab)
    for i in range(3, len(vocab.pieces), 97):
        piece = vocab.pieces[i]
        node = pool.trie.first[[ord(piece[0])]]
        for c in piece[1:]:
            node = pool.trie.step(node, np.array([ord(c)]))
        if i not in vocab.byte_ids and piece.find("▁", 1) < 0:
            assert pool.trie.piece[node[0]] == i


# ---- 4 ----

URLS = [
    ("https://a.EXAMPLE.org/es/1?x=1", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/15#t", "example.org", "/en/15", "example.org/en/1", "block"), ("http://example.org/en/25", "example.org", "/en/25", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"), ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://org", "org", "", None, None),
    ("no scheme", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("http://h.net?q=http://x.com/de/", "h.net", "", None, None), ("a\nb://C.net/\nz?y", "c.net", "/\nz", None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = host.translate(AZ)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_verdicts_equal_brute_force(spark):
    """Hosts, paths and rules of all pages, and the method's verdict by its threshold where no rule fits."""
    pages = common.table(spark, "/root/testdata/sf0.1", "pages")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    got = url_filter.url_verdicts(pages).collect()
    assert len(got) == len(urls)
    model = url_filter.train(url_filter.weak_labels(pages.select("url", url_filter.host_of(F.col("url")).alias("host"))))
    p = dict(zip(urls, model.probability(list(urls.values())), strict=True))
    for r in got:
        host, path, rule, verdict = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if p[r.page_id] >= url_filter.THRESHOLD else "allow"))
    free = [(r.verdict, any(w in url_filter.SEEDS for w in re.split("[.-]", r.host))) for r in got if r.rule is None]
    assert np.mean([v == "block" for v, bad in free if bad]) > 0.95 and np.mean([v == "block" for v, bad in free if not bad]) < 0.01


def test_url_trees_on_held_out_urls(spark):
    pages = common.table(spark, "/root/testdata/sf0.1", "pages").select("url", url_filter.host_of(F.col("url")).alias("host"))
    rows = url_filter.weak_labels(pages).orderBy(F.xxhash64("url"), "url").collect()
    urls, y = [r.url for r in rows], np.array([r.blocked for r in rows], float)
    out = np.arange(len(urls)) % 4 == 0
    p = url_filter.fit([u for u, o in zip(urls, out, strict=True) if not o], y[~out]).probability([u for u, o in zip(urls, out, strict=True) if o])
    blocked = p >= url_filter.THRESHOLD
    assert np.mean(blocked[y[out] == 1]) > 0.95 and np.mean(blocked[y[out] == 0]) < 0.01


def test_url_training_takes_different_bounded_urls(spark):
    rows = spark.createDataFrame([("http://a.net/x", 1)] * 50 + [(f"http://b{i}.net/", 0) for i in range(5)] + [("http://c.net/" + "y" * 100_000, 0)], "url string, blocked int")
    seen = []
    original, url_filter.fit = url_filter.fit, lambda urls, y: seen.extend(zip(urls, y, strict=True))
    try:
        url_filter.train(rows, 10)
    finally:
        url_filter.fit = original
    assert len(seen) == 6 and len({u for u, _ in seen}) == 6
    long = spark.createDataFrame([(1, "http://casino.net/" + "y" * 1_000_000), (2, "http://h.net/")], "page_id long, url string")
    assert url_filter.url_verdicts(long).count() == 2


# ---- 6 ----


def test_mixing_meets_its_targets(spark):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    rows = source_mixing.mixing_report(docs, labels).collect()
    total = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in source_mixing.DOMAINS}
    for d, share in source_mixing.TARGETS.items():
        assert abs(total[d] / sum(total.values()) - share) < 0.005
    assert all(r.rate >= 0 and abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 and abs(r.copies - r.rate) < 1 for r in rows)
    local = {r.doc_id: len(WORDS.findall(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == local


def test_mixing_edges(edge, empty, labels):
    assert source_mixing.mixing_report(edge, labels).count() == len(EDGE)
    assert source_mixing.mixing_report(empty, labels).count() == 0
    kept = source_mixing.mix_sources(edge, labels.limit(0))
    assert kept.columns == edge.columns and kept.count() == len(EDGE)


def test_mixed_rows_meet_the_targets(spark):
    """Scarce domains need rates above 1: the rows themselves, not only the rates, have the target shares."""
    kinds = [("clean", "plain prose of a calm day", 100), ("low", "junk spam filler noise click here", 20), ("toxic", "rude vile nasty cruel hateful words", 20)]
    rows = [(d, f"{text} own{i}") for d, (kind, text, i) in enumerate((kind, text, i) for kind, text, n in kinds for i in range(n))]
    kind_of = dict(enumerate(kind for kind, _, n in kinds for _ in range(n)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(d, int(k != "low"), int(k == "toxic")) for d, k in kind_of.items()], "doc_id long, quality int, toxic int")
    targets = {"clean": 0.5, "low": 0.3, "toxic": 0.2}
    got = collections.Counter()
    mixed = source_mixing.mix_sources(made, known, targets).collect()
    for r in mixed:
        got[kind_of[r.doc_id]] += len(WORDS.findall(r.text))
    assert all(abs(got[d] / sum(got.values()) - share) < 0.02 for d, share in targets.items())
    copies = {r.doc_id: r.copies for r in source_mixing.mixing_report(made, known, targets).collect()}
    assert collections.Counter(r.doc_id for r in mixed) == collections.Counter(copies)


# ---- 8 ----


def test_statistics_equal_brute_force():
    rng = random.Random(5)
    sequences = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
    sam = license_scan.SuffixAutomaton(sequences)
    within = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(50):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        for i, (state, n) in enumerate(sam.statistics(words)):
            assert n == max((k for k in range(i + 2) if tuple(words[i + 1 - k : i + 1]) in within), default=0)
            if n:
                assert sam.ends[state] == {(k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == words[i + 1 - n : i + 1]}


def brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(AZ))
    at = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_equals_brute_force(spark, docs, edge, empty):
    made = spark.createDataFrame([(1, "Under the MIT License. under the mit-license, under the mit licenses"), (2, "CC BY-NC by nc cc by nc; Apache License, Version 2.0"), (3, license_texts.MIT.upper())], "doc_id long, text string")
    for df in (docs, edge, made):
        got = license_scan.license_scan(df).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in got) == sorted((str(r.doc_id), *(str(x) if i in (2, 3) else x for i, x in enumerate(brute_base(r.text)))) for r in df.select("doc_id", "text").collect())
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.labels for r in license_scan.license_scan(made).collect()}[3] == "mit"
    assert license_scan.license_scan(empty).count() == 0


def test_every_template_and_its_short_form_is_labelled():
    scanner = license_scan.Scanner()
    notices = [*[t[:2] for t in license_texts.TEMPLATES], ("proprietary", "All rights reserved."), ("proprietary", "© 2020 Acme. All rights reserved. No part of it"), ("proprietary", "of all rights reserved no part of this"), ("mit", "Released under the MIT License."), ("apache-2", "Licensed under the Apache License, Version 2.0."), ("gpl-3", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0.")]
    for label, notice in notices:
        *_, labels, score = scanner.scan(f"Prose before it.\n{notice}\nprose after it".encode())
        assert label in labels.split(",") and score >= license_scan.MIN_COVERAGE, notice
    for text in ("all rights", "all rights are reserved", "reserved rights all", "rights reserved"):
        assert scanner.scan(text.encode())[5:] == ("", 0.0)


def test_versions_of_a_licence_are_told_apart():
    scanner = license_scan.Scanner()
    for name, version, label in ((license_texts._GPL, "2", "gpl-2"), (license_texts._GPL, "3", "gpl-3"), (license_texts._LGPL, "2.1", "lgpl-2.1"), (license_texts._LGPL, "3", "lgpl-3"), (license_texts._AGPL, "3", "agpl-3")):
        assert scanner.scan(license_texts._gnu(name, version).encode())[5] == label
    for label, text in (("isc", license_texts.ISC), ("mit", license_texts.MIT), ("zlib", license_texts.ZLIB), ("mpl-2", license_texts.MPL_2), ("bsd", license_texts._BSD_HEAD + license_texts._BSD_TAIL)):
        assert scanner.scan(text.encode())[5] == label


def brute_chains(words, template, phrases, gap, least):
    """(best cover, best cover with all phrases) over all chains of matches, which are found by comparing all places."""
    found = []
    for i in range(len(words)):
        for j in range(len(template)):
            if words[i] == template[j] and (i == 0 or j == 0 or words[i - 1] != template[j - 1]):
                n = 1
                while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                    n += 1
                if n >= least:
                    found.append((i, j, n))
    best = [0, 0]

    def grow(covered, text_end, template_end, held, last):
        best[0] = max(best[0], covered)
        if held == set(range(len(phrases))):
            best[1] = max(best[1], covered)
        for i, j, n in found:
            if (i, j) > last:
                cut = max(0, text_end - i, template_end - j)
                if cut < n and i + cut - text_end <= gap:
                    has = {b for b, p in enumerate(phrases) if any(template[a : a + len(p)] == p for a in range(j, j + n - len(p) + 1))}
                    grow(covered + n - cut, i + n, j + n, held | has, (i, j))

    for i, j, n in found:
        grow(n, i + n, j + n, {b for b, p in enumerate(phrases) if any(template[a : a + len(p)] == p for a in range(j, j + n - len(p) + 1))}, (i, j))
    return best


@pytest.mark.parametrize("seed", range(60))
def test_chains_equal_brute_force(seed, monkeypatch):
    """Coverage, labels, score and spans of texts made of broken, doubled and mixed passages of several templates."""
    rng = random.Random(seed)
    monkeypatch.setattr(license_scan, "GAP", 3)
    templates = []
    for k in range(3):
        words = rng.choices("abcdef", k=rng.randrange(6, 15))
        at = rng.randrange(len(words) - 2)
        templates.append((f"l{k}", " ".join(words), (" ".join(words[at : at + 3]),)))
    text = []
    for _ in range(rng.randrange(1, 4)):
        words = rng.choice(templates)[1].split()
        a, b = sorted(rng.sample(range(len(words) + 1), 2))
        text += words[a:b] + rng.choices("abcdefxy", k=rng.randrange(4))
    scanner = license_scan.Scanner(templates, {})
    *_, labels, score = scanner.scan(" ".join(text).encode())
    covers = [brute_chains(text, t.split(), [p.split() for p in ps], 3, license_scan.MIN_MATCH) for _, t, ps in templates]
    sizes = [len(t.split()) for _, t, _ in templates]
    assert score == max(c / n for (c, _), n in zip(covers, sizes, strict=True))
    want = {t[0] for t, (_, c), n in zip(templates, covers, sizes, strict=True) if c >= license_scan.MIN_COVERAGE * n}
    assert set(filter(None, labels.split(","))) == want == {label for label, *_ in scanner.spans(" ".join(text).encode())}


# ---- 9 ----


def brute_lines(rows):
    key = lambda line: line.strip(common.SPACES).translate(AZ)
    held = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(-(1 << 63) if d is None else d)
    gone = {k: max(ds) for k, ds in held.items() if len(ds) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == (-(1 << 63) if d is None else d)]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_equals_brute_force(spark, docs, edge, empty):
    long = "A line of more than forty characters, é included."
    made = spark.createDataFrame([(i, f"{long.upper() if i % 2 else long}\t\nown {i}\n{long}") for i in range(6)] + [(9, long), (9, long + "\nmore"), (None, long)], "doc_id long, text string")
    for df in (docs, edge, made):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_report(df).collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(edge).columns == edge.columns
    assert line_dedup.line_report(empty).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_sorted_ranges_equal_brute_force(seed):
    """Rows in order, cut into ranges and batches at random places, keys that span ranges included."""
    rng = random.Random(seed)
    docs_of = {k: rng.sample(range(1, 40), rng.choice([1, 2, 4, 5, 9, 30])) for k in range(rng.choice([1, 3, 20]))}
    rows = sorted(((k, -k, d, d % 2, p) for k, ds in docs_of.items() for d in ds for p in rng.sample(range(50), rng.choice([1, 1, 3]))), key=lambda r: (r[0], r[1], -r[2], r[4]))
    want = {(d, t, p) for k, _, d, t, p in rows if len(docs_of[k]) >= 5 and d != max(docs_of[k])}
    cuts = sorted({i for i in rng.sample(range(len(rows) + 1), min(len(rows), rng.choice([0, 2, 7]))) if 0 < i < len(rows) and rows[i][:3] != rows[i - 1][:3]})
    found = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        state = line_dedup._Range(5)
        while a < b:
            n = min(b - a, rng.randrange(1, 9))
            part = np.array(rows[a : a + n], np.int64)
            for out in state.feed(part[:, :2], part[:, 2], part[:, 3], part[:, 4]):
                found += out.to_pylist()
            a += n
        for out in state.end():
            found += out.to_pylist()
    assert sum(r["kind"] == line_dedup._SUMMARY for r in found) <= 2 * (len(cuts) + 1)
    n, largest = collections.Counter(), {}
    for r in found:
        if r["kind"] == line_dedup._SUMMARY:
            n[r["h1"]] += r["n"]
            largest[r["h1"]] = max(largest.get(r["h1"], 0), r["doc_id"])
    got = [(r["doc_id"], r["text_id"], p) for r in found for p in r["pos"] if r["kind"] == line_dedup._DROP or r["kind"] == line_dedup._OPEN and n[r["h1"]] >= 5 and r["doc_id"] != largest[r["h1"]]]
    assert sorted(got) == sorted((d, t, p) for k, _, d, t, p in rows if (d, t, p) in want and len(docs_of[k]) >= 5 and d != max(docs_of[k]))


def test_bitmaps_round_trip():
    for n, dropped in ((1, []), (9, [8]), (16, [0, 15]), (17, [16, 3])):
        keep = line_dedup.from_bitmap(line_dedup.to_bitmap(np.array(dropped, np.int64)), n)
        assert [i for i in range(n) if not keep[i]] == sorted(dropped)


# ---- pipeline ----

CLASH = "doc_id long, text string, `__id` string, `__n` int, `__copies` int, `__bitmap` string, `__digest` string, `__slot` int, `__bits` int, `__file` string, `__row` int, `__p_clean` double, `p_clean` double, `__buckets` int, `__copy` string, `_metadata` string"


def clashing(spark):
    long = "A line of more than forty characters, é included."
    text = lambda i: f"{long}\nown words of row {i // 2} " + "here and there " * 12
    return spark.createDataFrame([(i, text(i), f"id{i}", i, -i, f"b{i}", f"d{i}", i, i, f"f{i}", i, 0.5, 0.25, i, f"c{i}", f"m{i}") for i in range(12)], CLASH)


def test_columns_with_private_names_are_carried(spark, labels):
    """Extra columns keep their values, also those that the operators' own are named like."""
    rows = clashing(spark)
    want = {r.doc_id: tuple(r)[2:] for r in rows.collect()}
    model = quality_classifier.train(rows, labels.limit(0))
    for out in (exact_dedup.exact_dedup(rows), simhash.near_dedup(rows), line_dedup.dedup_lines(rows), source_mixing.mix_sources(rows, labels.limit(0)), quality_classifier.keep_quality(rows, model, 0.0)):
        assert out.columns == rows.columns
        got = out.collect()
        assert got and all(tuple(r)[2:] == want[r.doc_id] for r in got)
    assert exact_dedup.dedup_report(rows).count() == simhash.near_duplicates(rows).count() == line_dedup.line_report(rows).count() == 12


def test_stages_take_edge_rows_and_empty_tables(spark, edge, empty):
    """Nulls, empty texts, repeats and a null doc_id go through every stage; an empty table stays empty."""
    import corpus_pipeline

    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (edge, empty):
            out = stage(spark, df, SF)
            rows = out.collect()
            assert (k == 4 or out.columns == df.columns) and (bool(rows) <= (df is edge)), name
    kept = corpus_pipeline.STAGES[1][1](spark, edge, SF).collect()
    assert sorted((r.text or "").translate(AZ) for r in kept) == sorted({(r[1] or "").translate(AZ) for r in EDGE})
    near = [r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, edge, SF).collect()]
    assert 1 in near and 2 not in near and 6 in near and 7 not in near


def test_the_mixing_stage_meets_its_targets(spark):
    """Tokens by posterior of the rows that the stage returns, on what the stages before it keep."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    current = common.table(spark, sf, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        current = common.stored(stage(spark, current, sf), f"m{k}")
    labels = common.table(spark, sf, "labels")
    model = source_mixing.classifier(current, labels)
    members, names = source_mixing.with_posteriors(current, model)
    got = source_mixing.mix_sources(current, labels).groupBy("doc_id").count()
    sums = members.join(got, "doc_id").agg(*[F.sum(F.col("count") * F.col(names.n) * F.col(names.p[d])).alias(d) for d in source_mixing.DOMAINS]).first()
    have = sum(share for d, share in source_mixing.TARGETS.items() if sums[d])  # a domain without labels has no target
    for d, share in source_mixing.TARGETS.items():
        assert abs(sums[d] / sum(sums) - (share / have if sums[d] else 0)) < 0.02, (d, sums)


def test_training_is_bounded_in_rows_and_bytes(spark):
    """A label with many rows trains as many, within the bound; so do very long texts."""
    docs = spark.createDataFrame([(1, f"word{i} and more") for i in range(200)] + [(2, "other " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows, y = quality_classifier.labelled_rows(docs, labels, "quality", 10, False, 20)
    assert len(rows) == len(y) <= 20
    rows, _ = quality_classifier.labelled_rows(docs, labels, "quality", 18, False, 5000, 2000)
    assert sum(len(x) * 8 for x, _ in rows) <= 2000


def test_quality_verdicts_equal_brute_force(spark, docs, labels):
    """kept and the probability, from n-grams that are counted one by one."""
    model = quality_rules.train(docs, labels)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, model).collect()}
    for d, text in list(texts_of(docs).items())[:40]:
        [(x, v)] = ngrams.sparse_rows([(text or "").encode()], quality_rules.BITS, True)
        p = 1 / (1 + math.exp(-(model.a * (model.bias + float(model.weights[x] @ v)) + model.b)))
        assert abs(got[d].quality_p - p) < 1e-5
        assert got[d].kept == (not got[d].base_failed and got[d].quality_p >= quality_rules.KEEP)


def test_pipeline_stages(spark, docs, edge):
    import corpus_pipeline

    ids, current = None, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.stored(stage(spark, current, SF), f"t{k}")
        if k < 4:
            assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and (ids is None or now <= ids)
        ids, current = now, out
    assert all(r.round_trip for r in current.collect())
    rows = corpus_pipeline.STAGES[1][1](spark, edge, SF)
    assert rows.columns == edge.columns
