"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd inputs."""

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motusflow.llm import bpe_lexicon, embedding_dedup, fingerprints, graph, language_id, license_scan, lm_scoring, near_dedup, packing, pii, token_output
from motusflow.llm.encode import Encoder
from motusflow.llm.pieces import cut
from motusflow.llm.shingles import shingles

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "\n\n", "don't you''s 's x's'll  \n\n a b  ", "'", "''re", "I'll'd 123 4''5", "a<|endoftext|>b", "ΣΑΣ İ é ﬁ\x1c", "😀👍🏽 '🎉'S", "٣٤ Ⅷ ½", "$$$ %%%", "word " * 3000]
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
for _t in LIBRARY.values():
    _t.no_padding()
    _t.no_truncation()


def library_ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


def prose(k, n, lang=0):
    rng = np.random.default_rng(k)
    parts = [["the", "in", "er", "tion", "ou"], ["der", "sch", "ung", "ein", "ö"], ["le", "eux", "é", "que", "oi"]][lang]
    return " ".join("".join(rng.choice(parts, 3)) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*ODD, *(prose(k, 20 + 7 * k, k % 3) for k in range(40))]
    texts += [texts[20], texts[20], texts[40].replace(" ", "  "), texts[50] + " tail"]
    return table(spark, texts)


def table(spark, texts, langs=None):
    rows = [(i * 3, t, (langs or ["x"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ pieces and ids


@given(st.lists(st.text(alphabet=" '\n\tasretvmld1٣é.$😀　ß", max_size=25), max_size=6))
@settings(max_examples=200, deadline=None)
def test_pieces_equal_the_patterns(texts):
    import regex

    for how, pattern in (("gpt", public_tokenizers.PATTERN), ("clip", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")):
        if texts:
            p = cut(texts, how)
            words = p.words.to_pylist()
            got = [[words[c] for c in p.codes[a:z]] for a, z in zip(p.bounds[:-1], p.bounds[1:], strict=True)]
            assert got == [regex.findall(pattern, t) for t in texts]


@given(st.lists(st.text(max_size=40), max_size=5))
@settings(max_examples=60, deadline=None)
def test_ids_equal_the_library(texts):
    for path, how in ((BYTE, "gpt"), (WORD, "clip")):
        ids, at = Encoder(path, how).encode(texts)
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [library_ids(path, t) for t in texts]


def test_character_classes_are_the_library_s():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    from motusflow.llm.pieces import LETTER, NUMBER, SPACE, char_classes

    known = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    every = "".join(map(chr, known))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        hit = np.zeros(0x110000, bool)
        for _, (a, z) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            hit[known[a:z]] = True
        assert np.count_nonzero((char_classes() == kind) != hit) == 0


@given(st.lists(st.lists(st.sampled_from([*range(0x1C88, 0x1C8C), *range(0xA7C8, 0xA7DE), *range(0x105C0, 0x105C8), *range(0x13460, 0x13480), *range(0x10D40, 0x10D4A), 32, 58, 97, 49]).map(chr), max_size=12).map("".join), max_size=4))
@settings(max_examples=60, deadline=None)
def test_ids_of_new_characters_equal_the_library(texts):
    for path, how in ((BYTE, "gpt"), (WORD, "clip")):
        ids, at = Encoder(path, how).encode(texts)
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [library_ids(path, t) for t in texts]


def test_caches_are_bounded_and_change_nothing():
    from motusflow.llm.encode import Cache

    enc = Encoder(BYTE, "gpt")
    enc.cache = Cache(3000)
    texts = [prose(k, 50, k % 3) + "x" * 5000 for k in range(6)] * 2
    ids, at = enc.encode(texts)
    assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:], strict=True)] == [library_ids(BYTE, t) for t in texts]
    assert len(enc.cache.young) + len(enc.cache.old) <= 2 * 3000 // 200 + 2


# ------------------------------------------------------------------ packing (1)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=20))
@settings(max_examples=100, deadline=None)
def test_packing_of_histograms(counts):
    plan = packing.packed(counts, 64)
    used: dict[int, int] = {}
    for items, times in plan:
        assert times > 0 and sum(s * n for s, n in items) <= 64
        for s, n in items:
            used[s] = used.get(s, 0) + n * times
    assert used == counts
    bins = sum(t for _, t in plan)
    # no packing has fewer sequences than its large items, pairs of them and volume ask for (Martello and Toth's bound)
    low = 0
    for k in range(33):
        big, half, small = (sum(n for s, n in counts.items() if a < s <= z) for a, z in ((64 - k, 64), (32, 64 - k), (k - 1, 32)))
        room = half * 64 - sum(s * n for s, n in counts.items() if 32 < s <= 64 - k)
        more = sum(s * n for s, n in counts.items() if k <= s <= 32) - room
        low = max(low, big + half + max(0, -(-more // 64)))
    assert low <= bins <= 11 / 9 * (1.5 * low + 1) + 1  # the optimum is at most 1.5 times the bound


@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
@settings(max_examples=60, deadline=None)
def test_packing_is_near_the_optimum(items):
    bins = sum(t for _, t in packing.packed({w: items.count(w) for w in items}, 12))
    best = fewest(items)
    assert best <= bins <= 11 / 9 * best + 6 / 9


def fewest(left):
    if not left:
        return 0
    first, rest, low = left[0], left[1:], len(left)
    for mask in range(1 << len(rest)):
        if first + sum(w for i, w in enumerate(rest) if mask >> i & 1) <= 12:
            low = min(low, 1 + fewest([w for i, w in enumerate(rest) if not mask >> i & 1]))
    return low


@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
@settings(max_examples=80, deadline=None)
def test_dominance_keeps_the_optimum(items):
    counts = {w: items.count(w) for w in items}
    fixed, left = packing.fixed_by_dominance(counts, 12)
    rest = [w for w, n in left.items() for _ in range(n)]
    assert sum(t for _, t in fixed) + fewest(rest) == fewest(items)


def test_packed_documents(spark, docs):
    got = packing.pack(docs, BYTE).toPandas()
    want = {k: [*library_ids(BYTE, t), 2] for k, t in texts_of(docs).items()}
    assert set(got.doc_id) == set(want)
    for k, g in got.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        ids = want[k]
        assert g.length.sum() == len(ids) and (len(g) == 1 or (g.length.iloc[1:] == 1024).all()) and (len(ids) > 1024) == (len(g) > 1)
        for s, n, c in zip(g.start, g.length, g.ids_crc32, strict=True):
            assert zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 1024
    assert packing.pack(empty(spark), BYTE).count() == 0


# ------------------------------------------------------------------ LM scoring (2)


def lm_losses(texts, target, least_v, which=None):
    """Mean losses (target, all) of each text by the docstring's formula, every count but the text's own taken anew."""
    from collections import Counter

    words = [re.findall(r"[^\W_]+", _lower(t)) for t in texts]
    v, mu, out = max(least_v, len({w for ws in words for w in ws})), lm_scoring.MU, []
    for k in which or range(len(texts)):
        ws, mean = words[k], []
        for used in (target, range(len(texts))):
            rest = [words[i] for i in used if i != k]
            one, two = Counter(w for r in rest for w in r), Counter(p for r in rest for p in zip([None, *r], r, strict=False))
            total, texts_ = sum(one.values()), sum(1 for r in rest if r)
            lost = 0.0
            for a, b in zip([None, *ws], ws, strict=False):
                lost -= np.log((two[a, b] + mu * (one[b] + 1) / (total + v)) / ((texts_ if a is None else one[a]) + mu))
            mean.append(lost / len(ws) if ws else None)
        out.append(mean)
    return out


def test_lm_scores_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_WORDS", 500)
    held = texts_of(docs)
    ids = sorted(held)
    target = docs.filter(F.col("doc_id") % 2 == 0).select("doc_id")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, target).collect()}
    assert set(got) == set(ids)
    want = lm_losses([held[k] for k in ids], [i for i, k in enumerate(ids) if k % 2 == 0], lm_scoring.LEAST_V)
    for k, losses in zip(ids, want, strict=True):
        for name, loss in zip(("loss_target", "loss_background"), losses, strict=True):
            assert got[k][name] is None and got[k]["score"] is None if loss is None else abs(got[k][name] - loss) < 1e-9
    assert lm_scoring.score(empty(spark), target).count() == 0
    alone = lm_scoring.score(docs, target.limit(0)).filter("n_words > 0").select("loss_target").collect()
    assert alone and np.allclose([r[0] for r in alone], np.log(lm_scoring.LEAST_V), atol=1e-9)


def test_lm_scores_do_not_share_counts_between_words(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in np.concatenate([rng.integers(0, 50, 300), rng.integers(50, 10**7, 3000)])) for _ in range(100)]
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, docs.filter(F.col("doc_id") % 2 == 0).select("doc_id")).collect()}
    assert len({w for t in texts for w in t.split()}) > lm_scoring.LEAST_V and len(got) == len(texts)
    which = [0, 1, 2, 99]
    for k, losses in zip(which, lm_losses(texts, range(0, len(texts), 2), lm_scoring.LEAST_V, which), strict=True):
        assert np.allclose([got[3 * k]["loss_target"], got[3 * k]["loss_background"]], losses, atol=1e-9)


def _lower(t):
    return (t or "").replace("Σ", "σ").lower()


# ------------------------------------------------------------------ near-duplicates (3)


def near_corpus(spark):
    rng = np.random.default_rng(5)
    texts = [prose(100 + k, 150, k % 3) for k in range(30)]
    shared = prose(999, 60)
    texts = [t if i % 3 else t + " " + shared for i, t in enumerate(texts)]  # a passage that does not make duplicates
    for i in range(0, 12):
        words = texts[i].split()
        words[int(rng.integers(len(words)))] = "edited"
        texts.append(" ".join(words))
    texts += [texts[0]] * 5 + [texts[1].upper()] + ["", None, " ", "$$$", "$$$", "one two", "one two", "word"]
    chain = [prose(500, 200).split()]
    for k in range(6):
        chain.append([*chain[-1][10:], *prose(600 + k, 10).split()])
    return texts + [" ".join(c) for c in chain]


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = near_corpus(spark)
    df = table(spark, texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df).collect()}
    idf = near_dedup.idf_table(*near_dedup.document_frequencies(df))
    found = shingles(texts)
    weights = [near_dedup.weighted(s, idf) for s in found]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = len(found[i]) == len(found[j]) == 0 or (len(found[i]) and len(found[j]) and near_dedup.weighted_jaccard(weights[i], weights[j]) >= 0.8)
            if same and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    first = {x: min(i for i, y in enumerate(label) if y == x) for x in set(label)}
    assert {k: r["component_id"] for k, r in got.items()} == {i * 3: first[label[i]] * 3 for i in range(len(texts))}
    assert all(r["keep"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    kept = near_dedup.deduplicated(df.withColumn("component_id", F.lit("mine")))
    assert kept.columns == [*df.columns, "component_id"] and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["keep"]}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_clashing_names_pass_through(spark):
    texts = [prose(900 + k, 40, k % 3) for k in range(12)] + [prose(900, 40)]
    df = table(spark, texts, [["en", "de", "fr"][k % 3] for k in range(13)])
    for c in ("rid", "_row", "_rid", "_kept", "node", "u", "mark", "label", "lang_pred", "score", "key", "rank"):
        df = df.withColumn(c, F.lit(c))
    for got in (near_dedup.deduplicated(df), language_id.identified(df), pii.redacted(df)):
        rows = got.collect()
        assert got.columns == df.columns and len(rows) >= 12 and all(r["_row"] == "_row" and r["rid"] == "rid" and r["key"] == "key" for r in rows)
    assert len(near_dedup.deduplicated(df).collect()) == 12


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_of_near_duplicates_over_a_table(spark):
    """All pairs of the table by an inverted list of shingles, each compared exactly."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = sorted(texts_of(df).items())
    found = shingles([t for _, t in held])
    idf = near_dedup.idf_table(*near_dedup.document_frequencies(df))
    weights = [near_dedup.weighted(s, idf) for s in found]
    lists, pairs = {}, {}
    for i, (s, _) in enumerate(weights):
        for x in s.tolist():
            lists.setdefault(x, []).append(i)
    for where in lists.values():
        for a, i in enumerate(where):
            for j in where[:a]:
                pairs[i, j] = pairs.get((i, j), 0) + 1
    links = [(i, j) for (i, j), n in pairs.items() if n >= 0.3 * min(len(found[i]), len(found[j])) and near_dedup.weighted_jaccard(weights[i], weights[j]) >= 0.8]
    group = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    hit = sum(group[held[i][0]] == group[held[j][0]] for i, j in links)
    assert len(links) > 50 and hit >= 0.99 * len(links)


def test_document_frequencies_are_exact(spark):
    from collections import Counter

    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 2000))) for _ in range(150)]
    texts += [texts[k] + " tail" for k in range(20)] + ["", None]
    df = table(spark, texts)
    found = [np.unique(s) for s in shingles(texts)]
    exact = Counter(x for s in found for x in s.tolist())
    idf = near_dedup.idf_table(*near_dedup.document_frequencies(df))
    for s in found:
        want = 1 + np.log((len(texts) + 1) / (np.array([exact[x] for x in s.tolist()]) + 1)) / np.log(len(texts) + 1)
        assert np.allclose(near_dedup.weighted(s, idf)[1], want, atol=1e-5)
    rows = df.withColumn("rid", F.col("doc_id")).withColumn("mark", F.lit(0).cast("long"))
    for r in near_dedup.signatures(rows, len(texts)).collect():
        s = found[r["doc_id"] // 3]
        got = near_dedup.unpacked(bytes(r["df"]), "<u4") if r["df"] else np.ones(len(s))
        assert got.tolist() == [exact[x] for x in s.tolist()]


def test_rows_without_or_with_one_doc_id_are_deduplicated_by_text(spark):
    a, b, c, d = (prose(800 + k, 150) for k in range(4))
    near = a.split()
    near[70] = "edited"
    rows = [(None, a), (None, " ".join(near)), (None, b), (None, b), (7, c), (7, d), (7, d), (1, b), (None, ""), (None, None)]
    df = spark.createDataFrame([(k, t, "x", "s", 0) for k, t in rows], DOCS).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in near_dedup.deduplicated(df).collect()]
    assert len(got) == 5 and {(1, b), (7, c), (7, d)} < set(got)
    assert sum(t in (a, " ".join(near)) for _, t in got) == 1 and sum(not t for _, t in got) == 1
    assert near_dedup.near_duplicates(df).filter("keep").count() == 7  # rows equal in doc_id and text are flagged alike


def test_consistent_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
    a, b = (s[:500], np.ones(500, np.float32)), (s[100:600], np.where(np.arange(len(s[100:600])) % 2, 1, 1.5).astype(np.float32))
    share = np.mean(near_dedup.samples(*a) == near_dedup.samples(*b))
    assert abs(share - near_dedup.weighted_jaccard(a, b)) < 0.2
    assert (near_dedup.samples(*a) == near_dedup.samples(*a)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100} | {200 + i: 100 for i in range(50)}


# ------------------------------------------------------------------ licenses (4)


def test_licenses(spark):
    texts = [*ODD, "Some code. Released under the MIT License. " + prose(1, 40), "licensed UNDER the apache license version 2 0!", prose(2, 50) + " " + license_scan.TEMPLATES["mit-text"] + " " + license_scan.TEMPLATES["isc"], "released under the license of MIT"]
    df = table(spark, texts)
    got = {r["doc_id"] // 3: r for r in license_scan.digest(df).collect()}
    assert len(got) == len(texts)

    def grams(t):
        w = re.findall(r"[^\W_]+", _lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for i, t in enumerate(texts):
        shares = {n: len(grams(x) & grams(t)) / len(grams(x)) for n, x in license_scan.TEMPLATES.items()}
        assert got[i]["licenses"] == ",".join(sorted(n for n, s in shares.items() if s >= 0.8))
    plan = license_scan.digest(df)._jdf.queryExecution().toString()
    assert "Python" not in plan.split("Physical Plan")[1] and "Exchange hashpartitioning" not in plan
    assert license_scan.digest(empty(spark)).count() == 0


# ------------------------------------------------------------------ embeddings (5)


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", 40 * 24 * 4)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:25] + 0.15 * rng.normal(size=(25, 24)), base[:10] * 3, np.repeat(base[:1], 30, 0) + 0.01 * rng.normal(size=(30, 24))]).astype(np.float32)
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 0.0], [2.0, 0.0]]
    rows = [(i, v.tolist() if hasattr(v, "tolist") else v) for i, v in enumerate([*x, *odd])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(0)).repartition(3)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = y @ y.T >= 0.9
    label = np.arange(len(y))
    for _ in range(len(y)):
        label = np.where(hit, label[None, :], len(y)).min(1)
    for i in range(len(y)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (hit[i].sum() - 1, label[i], label[i] == i)
    n = len(y)
    for k, v in enumerate(odd):
        pair = k >= 6
        assert (got[n + k]["n_links"], got[n + k]["component_id"]) == (int(pair), n + 6 if pair else n + k)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_vec_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.1]), (3, [0.1, 3.0]), (None, [1.0, 0.0]), (4, [-1.0, 0.0]), (5, [1.0, 0.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)).collect()
    want = [(1, 2, 1), (1, 2, 1), (1, 1, 1), (2, 2, 1), (3, 1, 1), (None, 0, None), (4, 0, 4), (5, 2, 1)]
    assert sorted(map(str, ((r["vec_id"], r["n_links"], r["component_id"]) for r in got))) == sorted(map(str, want))


# ------------------------------------------------------------------ fingerprints (6)


def plain_sketch(text):
    """The fingerprint by the definition, a shingle at a time."""
    import xxhash

    m, words = 2**64 - 1, [xxhash.xxh64_intdigest(w) for w in re.findall(r"[^\W_]+", _lower(text))]

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & m
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & m
        return x ^ x >> 33

    found = []
    for i in range(len(words) - 4):
        x = 0
        for w in words[i : i + 5]:
            x = (x * 0x9E3779B97F4A7C15 + w) & m
        found.append(mix(x))
    if 0 < len(words) < 5:
        found = [mix(xxhash.xxh64_intdigest(np.array(words, np.uint64).tobytes()))]
    elif not words and text.strip():
        found = [mix(xxhash.xxh64_intdigest(text.strip()))]
    return sorted({x for x in found if x < 2**64 // 8}) or sorted(found)[:1]


def test_fingerprints(spark, docs):
    got = sorted(fingerprints.compared(docs).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for _, t in sorted(texts_of(docs).items())]
    assert len(got) == len(texts)

    def alike(a, b):
        return len({*a} & {*b}) / min(len(a), len(b)) if a and b else float(len(a) == len(b))

    for i, r in enumerate(got):
        following = texts[(i + 1) % len(texts)]
        k = len(texts[i]) // 4
        new = texts[i][: len(texts[i]) - k] + following[:k]
        a, b, c = (plain_sketch(t) for t in (texts[i], new, following))
        assert r["n_chars"] == len(texts[i]) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(f"{x:016x}" for x in a), "".join(f"{x:016x}" for x in b))
        assert (r["near_edited"], r["near_next"]) == (alike(a, b), alike(a, c))
    assert fingerprints.read_in(got[-1]["fingerprint"]).tolist() == plain_sketch(texts[-1])
    alone = fingerprints.compared(table(spark, ["a lone text of some words"])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fingerprints.compared(empty(spark)).count() == 0
    twice = fingerprints.compared(docs.union(docs)).count()
    assert twice == 2 * len(texts)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=12), st.lists(st.integers(0, 2**64 - 1), max_size=12))
@settings(max_examples=200, deadline=None)
def test_sketches_of_any_two_texts_merge(a, b):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert (fingerprints.merged(fingerprints.kept(x), fingerprints.kept(y)) == fingerprints.kept(np.concatenate([x, y]))).all()
    assert 0 <= fingerprints.containment(fingerprints.kept(x), fingerprints.kept(y)) <= 1


def test_sketches_merge_and_estimate_containment():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**64, 20000, np.uint64)
    small, large = fingerprints.kept(h[:2000]), fingerprints.kept(h[1000:])
    assert (fingerprints.merged(small, large) == fingerprints.kept(h)).all()
    assert abs(fingerprints.containment(small, large) - 0.5) < 0.1


# ------------------------------------------------------------------ language (7)


def test_language(spark):
    langs = ["en", "de", "fr"]
    texts = [prose(k, 30, k % 3) for k in range(150)]
    df = table(spark, [*texts, None, "", "123 $$$"], [langs[k % 3] for k in range(150)] + ["en", None, None])
    got = {r["doc_id"] // 3: r for r in language_id.predicted(df).collect()}
    assert len(got) == 153
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i * 3).encode()) % 4 == 2)
        assert r["lang_pred"] == (langs[i % 3] if i < 150 else "und") and 0 <= r["score"] <= 1
    kept = language_id.identified(df)
    assert kept.columns == df.columns and kept.count() == 150
    assert {r["lang_pred"] for r in language_id.predicted(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.predicted(empty(spark)).count() == 0


def test_language_scores_against_a_plain_solve(spark, monkeypatch):
    """Kernel values text by text, and the regression by least squares over all of the sample."""
    from motusflow.llm.encode import lowered

    langs = ["en", "de", "fr"]
    texts = [prose(k, 12 + k % 9, k % 3) for k in range(90)]
    df = table(spark, [*texts, None, "123"], [*(langs[k % 3] for k in range(90)), "en", None])
    got = {r["doc_id"] // 3: r for r in language_id.predicted(df).collect()}

    def places(text):
        c = [ord(x) if x.isalpha() else 32 for x in lowered(text)]
        out, m = set(), 2**32 - 1
        for i in range(len(c)):
            code = 0
            for n in range(1, language_id.N + 1):
                if i + n > len(c):
                    break
                code = (code * 0x01000193 + c[i + n - 1] + n) & m
                out.add(((code ^ code >> 15) * 0x9E3779B1 & m) >> 32 - language_id.BITS)
        return out

    sets = [places(t) for t in texts]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    learned = [k for k in range(90) if zlib.crc32(str(3 * k).encode()) % 4 != 2]
    order = {(r["i"]): r["h"] for r in df.select((F.col("doc_id") / 3).cast("int").alias("i"), F.xxhash64("doc_id", "text").alias("h")).collect()}
    learned.sort(key=lambda k: (langs.index(langs[k % 3]), order[k]))
    names = sorted(langs)
    marks = [k for name in names for k in [k for k in learned if langs[k % 3] == name][: language_id.LANDMARKS]]
    km = np.array([[kernel(sets[a], sets[b]) for b in marks] for a in marks])
    kx = np.array([[kernel(sets[a], sets[b]) for b in marks] for a in learned])
    share = np.array([1 / sum(langs[j % 3] == langs[k % 3] for j in learned) for k in learned])
    sides = np.array([[1.0 if langs[k % 3] == name else -1.0 for name in names] for k in learned])
    w = np.linalg.solve(kx.T @ (kx * share[:, None]) + language_id.RIDGE / len(learned) * km, kx.T @ (sides * share[:, None]))
    for k in range(90):
        s = np.array([kernel(sets[k], sets[b]) for b in marks]) @ w
        assert got[k]["lang_pred"] == names[int(s.argmax())] and abs(got[k]["score"] - min(1, max(0, (s.max() + 1) / 2))) < 1e-3
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und"


def test_copies_do_not_fill_the_sample(spark):
    texts = [prose(k, 30, k % 3) for k in range(9)]
    rows = [(3, texts[0], "en", "s", 0)] * 300 + [(3 * k + 4, t, ["en", "de", "fr"][k % 3], "s", 0) for k, t in enumerate(texts)]
    x, y, langs = language_id.sample(spark.createDataFrame(rows, DOCS).repartition(3), 4)
    learned = {(k, t) for k, t, *_ in rows if zlib.crc32(str(k).encode()) % 4 != 2}
    assert langs == ["de", "en", "fr"] and len(x) == len(y) == len(learned) <= 10


def test_unlearned_languages_are_rejected(spark):
    langs = ["en", "de", "fr"]
    foreign = ["Быстрая лиса прыгает через ленивую собаку", "日本語の文章です", "مرحبا بالعالم", "xqzv kjwq zzxv qqkj wvxz jkqx"]
    df = table(spark, [*(prose(k, 30, k % 3) for k in range(150)), *foreign], [*(langs[k % 3] for k in range(150)), *[None] * len(foreign)])
    assert set(texts_of(language_id.identified(df))) == {3 * k for k in range(150)}


# ------------------------------------------------------------------ codec (8)


@given(st.dictionaries(st.text(alphabet="abcé", min_size=1, max_size=7), st.lists(st.integers(0, 99), max_size=4), max_size=40))
@settings(max_examples=60, deadline=None)
def test_lexicon_maps_words_to_ids(words):
    import pyarrow as pa

    held = bpe_lexicon.Lexicon.mapped(bpe_lexicon.Lexicon.build({w.encode(): np.array(i, np.int32).tobytes() for w, i in words.items()}).to_bytes())
    asked = [*words, "zzz", "a", "", "ab", "abcabcabc"]
    for w, k in zip(asked, held.numbers(pa.array(asked, pa.string())).tolist(), strict=True):
        assert (k >= 0) == (w in words) and (k < 0 or held.ids(k).tolist() == words[w])


def test_automaton_shares_endings():
    edges, final, _ = bpe_lexicon.minimal_automaton(sorted(w.encode() for w in ("walking", "talking", "walked", "talked")))
    assert sum(map(len, edges)) == 2 + 3 + 5 and sum(final) == 1


def test_round_trip(spark, docs):
    got = {r["doc_id"]: r for r in bpe_lexicon.round_trip(docs, WORD, most=50).collect()}
    for k, t in texts_of(docs).items():
        ids = library_ids(WORD, t)
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(LIBRARY[WORD].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe_lexicon.decoded(bpe_lexicon.encoded(docs, WORD, most=50), WORD).collect()}
    assert back == {k: LIBRARY[WORD].decode(library_ids(WORD, t), skip_special_tokens=False) for k, t in texts_of(docs).items()}
    assert bpe_lexicon.round_trip(empty(spark), WORD).count() == 0


# ------------------------------------------------------------------ personal data (9)


def test_personal_data(spark):
    iban = "DE89370400440532013000"
    texts = [*ODD, "mail a.b+c@d-e.org. or x@y", "at 8.8.8.8 and 300.1.1.1 and 1.2.3.4.5", "card 4539 1488 0343 6467, not 4539 1488 0343 6468", "call +1 (310) 555-4510 or +12", f"bank {iban} but DE00370400440532013000", "phone 310-555-4510", "code 310-555-4510", "+", "@", "1" * 5000]
    df = table(spark, texts)
    got = {r["doc_id"] // 3: r for r in pii.spans(df).collect()}
    n = len(ODD)
    assert got[n]["spans"] == "email:5:18" and got[n]["n_email"] == 1
    assert got[n + 1]["spans"] == "ip:3:10,ip:29:36"
    assert got[n + 2]["spans"] == "card:5:24"
    assert got[n + 3]["spans"] == "phone:5:22"
    assert got[n + 4]["spans"] == f"iban:5:{5 + len(iban)}" and got[n + 4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[n + 5]["spans"] == "phone_local:6:18" and got[n + 6]["spans"] == ""
    for i, r in got.items():
        assert r["base_sha256"] == hashlib.sha256(",".join(base_spans(texts[i] or "")).encode()).hexdigest()
    clean = {r["doc_id"] // 3: r for r in pii.redacted(df).collect()}
    assert clean[n]["text"] == "mail <EMAIL>. or x@y" and clean[n]["n_chars"] == len(clean[n]["text"])
    assert clean[1]["text"] is None and clean[n + 7]["text"] == "+" and pii.redacted(df).columns == df.columns
    assert pii.spans(empty(spark)).count() == 0


def base_spans(text):
    """The base spans as the patterns are written down, by plain searches."""
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@given(st.lists(st.sampled_from([*"aZ09.-+@ ()%_", "1.2.3.4", "+49 30 1234567", "4539 1488 0343 6467", "x@y.z", "é", "٣"]), max_size=60).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert [f"{k}:{a}:{z}" for k, a, z, _ in pii.found(text) if k in pii.BASE] == base_spans(text)


def test_personal_data_in_very_long_runs_takes_linear_time():
    import time

    for run in ("1" * 1_000_000, "a" * 1_000_000, "1." * 500_000, "a.b@" * 250_000, "+1" * 500_000, "A1" * 500_000, "1 " * 500_000):
        began = time.time()
        assert not [s for s in pii.found(run) if s[0] not in pii.BASE]
        assert time.time() - began < 10
    many = "mail a@b.cd or call 310-555-4510. " * 20_000
    began = time.time()
    assert len(pii.found(many)) == 40_000 and time.time() - began < 10


def test_context_words_are_whole_words():
    for near, hit in (("our hotel 310-555-4510", 0), ("our tel 310-555-4510", 1), ("310-555-4510 telling", 0), ("Phone: 310-555-4510", 1), ("310-555-4510" + "." * 38 + "telling", 0)):
        assert len(pii.found(near)) == hit, near
    assert pii.found("a trip to 8.8.8.8")[0][3] == 0.7 and pii.found("the IP 8.8.8.8")[0][3] == 1.0


def test_checksums():
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    assert pii.mod_97("GB82 WEST 1234 5698 7654 32") and not pii.mod_97("GB82 WEST 1234 5698 7654 33")


# ------------------------------------------------------------------ token files (10)


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 16))
@settings(max_examples=60, deadline=None)
def test_codes_are_prefix_free_and_limited(counts, limit):
    lengths = token_output.code_lengths(np.array(counts), limit)
    assert lengths.max(initial=0) <= limit and ((lengths > 0) == (np.array(counts) > 0)).all()
    if (lengths > 0).sum() > 1:
        assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() == 1
    words = sorted(format(int(c), f"0{n}b") for c, n in zip(token_output.canonical_codes(lengths), lengths, strict=True) if n)
    assert all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False))


def test_many_ids_get_longer_codes():
    counts = np.ones(70_000, np.int64)
    lengths = token_output.code_lengths(counts)
    assert lengths.max() == 17
    ids = np.random.default_rng(0).integers(0, len(counts), 3000)
    bits, at = token_output.pack_bits(ids, token_output.canonical_codes(lengths), lengths)
    assert (token_output.unpack_bits(bits, len(ids), at[:: token_output.EVERY], token_output.decode_table(lengths)) == ids).all()


def test_codes_are_optimal_when_unlimited():
    import heapq

    counts = [5, 9, 12, 13, 16, 45]
    heap, cost = counts[:], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert (token_output.code_lengths(np.array(counts)) * np.array(counts)).sum() == cost


@given(st.lists(st.integers(0, 500), max_size=2000))
@settings(max_examples=40, deadline=None)
def test_bits_round_trip(ids):
    ids = np.array(ids, np.int64)
    lengths = token_output.code_lengths(np.bincount(ids, minlength=501))
    bits, at = token_output.pack_bits(ids, token_output.canonical_codes(lengths), lengths)
    assert (token_output.unpack_bits(bits, len(ids), at[:: token_output.EVERY], token_output.decode_table(lengths)) == ids).all()


def test_token_files(spark, docs):
    out = token_output.write_tokens(docs, WORD)
    got = sorted(token_output.read_tokens(spark, out).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, (k, t) in zip(got, sorted(texts_of(docs).items()), strict=True):
        ids = np.array([*library_ids(WORD, t), 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (k, start, len(ids), ids.tobytes())
        start += len(ids)
    assert token_output.read_tokens(spark, token_output.write_tokens(empty(spark), WORD)).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(k, 60, k % 3) for k in range(60)]
    texts += [texts[3], texts[4].replace(" ", "\n"), "12345 $$", None, texts[5][:-1] + " mail me@home.org"]
    table(spark, texts, [["en", "de", "fr"][k % 3] for k in range(len(texts))]).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "packing"]
    assert set(got.doc_id) == {3 * i for i in range(60)}
    for i in range(60):
        ids = [*library_ids(BYTE, pii.redact(texts[i])), 2]
        assert got[got.doc_id == 3 * i].ids_crc32.tolist() == [zlib.crc32(np.array(ids, "<u4").tobytes())]


def test_nulls_and_repeats_do_not_crash(spark, docs):
    odd = docs.limit(20).union(docs.limit(20)).union(spark.createDataFrame([(None, "a b c d e f", None, None, None), (None, None, None, None, None)], DOCS)).withColumn("label", F.lit(1)).withColumn("rank", F.lit("x"))
    n = odd.count()
    assert packing.pack(odd, BYTE).filter("piece = 0").count() == n
    assert lm_scoring.score(odd, odd.select("doc_id")).count() == n
    assert near_dedup.near_duplicates(odd).count() == n
    assert license_scan.digest(odd).count() == fingerprints.compared(odd).count() == language_id.predicted(odd).count() == n
    assert bpe_lexicon.round_trip(odd, WORD).count() == pii.spans(odd).count() == n
    assert token_output.read_tokens(spark, token_output.write_tokens(odd, WORD)).count() == n
