"""Every operator against a brute-force version, on whole small tables and odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidelake.llm import ann, bpe, lm, packing, queries, simhash, substrings, token_counts, topk
from tidelake.llm import toxicity, warc
from tidelake.llm.workers import ready

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SHARED = " ".join(f"shared{i}" for i in range(70))
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a"),
    (5, SHARED + " tail five"),
    (6, "head six " + SHARED),
    (6, "head six " + SHARED),
    (None, SHARED + " no id"),
    (None, None),
    (7, "Ünï cödé  ▁ double  spaces 　 日本語 🙂 " * 3),
    (8, "x" * 30_000 + " " + "ab" * 5000),
    (9, "aaaa " * 9000),
    (10, "<|endoftext|> <s> </s> it's we'll\r\n\r\nWARC/1.1\r\n"),
    (-5, SHARED.upper() + " " + SHARED),
    (11, "head six " + SHARED + " "),
]


@pytest.fixture(scope="module")
def odd(spark):
    ready(spark)
    rows = [(i, t, 0, "x", "y") for i, t in ODD]
    schema = "doc_id long, text string, n_tokens int, block string, row string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    ready(spark)
    return spark.createDataFrame([], "doc_id long, text string, score double")


@pytest.fixture(scope="module")
def documents(spark):
    ready(spark)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def words_of(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


# ---------------------------------------------------------------- 1


@pytest.fixture(scope="module")
def reference_bpe():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_bpe_query(spark, documents, reference_bpe):
    got = {r["doc_id"]: r for r in rows_of(queries.op1_byte_bpe(spark, SF))}
    assert len(got) == len(documents)
    for doc_id, text in documents:
        ids = reference_bpe.encode_ordinary(text)
        row = got[doc_id]
        assert row["n_tokens"] == len(ids)
        said = " ".join(map(str, ids)).encode()
        assert row["ids_sha256"] == hashlib.sha256(said).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_odd_rows(odd, none, reference_bpe):
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in encoded.collect())
    want = Counter(
        (i, tuple(reference_bpe.encode_ordinary(t or "")), (t or "").encode()) for i, t in ODD
    )
    assert got == want
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    assert Counter(bytes(r.decoded) for r in back.collect()) == Counter(
        (t or "").encode() for _, t in ODD
    )
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_queues_agree(reference_bpe):
    rng = random.Random(3)
    coder = bpe.Bpe.load(RANKS, public_tokenizers.PATTERN)
    some = ["".join(rng.choice("abABé ") for _ in range(rng.randint(2, 300))) for _ in range(300)]
    some += ["a" * n for n in range(2, 80)]
    raw = [t.encode() for t in some]
    want = [tuple(reference_bpe._core_bpe.encode_single_piece(b)) for b in raw]
    assert coder.encode_many(raw) == want
    assert [tuple(coder.encode_long(b)) for b in raw] == want


def test_rank_bitmap():
    rng, bitmap, held = random.Random(1), bpe.RankBitmap(70_000), set()
    for _ in range(5000):
        rank = rng.randrange(70_000)
        if rng.random() < 0.6:
            bitmap.add(rank)
            held.add(rank)
        elif held:
            assert bitmap.first() == min(held)
            held.remove(min(held))
            bitmap.remove(bitmap.first())
    assert bitmap.first() == min(held, default=-1)


# ---------------------------------------------------------------- 2


def brute_removal(rows, width):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for at in range(len(w) - width + 1):
            key = tuple(w[at : at + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words_of(t), set()
        for at in range(len(w) - width + 1):
            if i is not None and first[tuple(w[at : at + width])] < i:
                gone |= set(range(at, at + width))
        kept = b" ".join(x for at, x in enumerate(w) if at not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return Counter(out)


@pytest.mark.parametrize("width", [1, 3, 50])
def test_substrings_odd_rows(odd, none, width):
    got = Counter(tuple(r) for r in substrings.remove(odd, width).collect())
    assert got == brute_removal(ODD, width)
    assert substrings.remove(none, width).collect() == []


def test_substrings_many_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WINDOWS", 500)
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(4)
    got = Counter(tuple(r) for r in substrings.remove(df, 20).collect())
    assert got == brute_removal(documents, 20)


# ---------------------------------------------------------------- 3


def check_packing(rows, docs, capacity, path=WORDS):
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = Counter(
        (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows
    )
    assert got == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_query(spark, documents):
    used, least = check_packing(rows_of(queries.op3_best_fit_packing(spark, SF)), documents, 4096)
    assert used <= least + 1


@pytest.mark.parametrize("items", [8192, 4])
def test_packing_odd_rows(odd, none, monkeypatch, items):
    monkeypatch.setattr(packing, "SHARD_ITEMS", items)
    rows = rows_of(packing.pack(odd, WORDS, 700, ids=True))
    check_packing(rows, ODD, 700)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack(none, WORDS).collect() == []


def test_tokens_of_all_letters_before_marks():
    """Every letter of Unicode before each closing mark, alone and behind other letters."""
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha()]
    tokenizer, marks = Tokenizer.from_file(WORDS), ".,;:!?"
    texts = [c + m for n, c in enumerate(letters) for m in (marks[n % 6], marks[(n + 1) % 6] * 2)]
    odd = [c for c in letters if not tokenizer.normalizer.normalize_str(c)[-1].isalpha()]
    assert "\u0130" in odd and "\u0958" in odd
    texts += [a + c + m for c in odd for m in marks for a in ("", "ANKARAL", "ab\u0915")]
    texts += ["x\u0130,y ANKARAL\u0130. \u0915\u0958; \u0130"]
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    got = packing._encoded(WORDS, texts)
    wrong = [t for t, w, g in zip(texts, want, got, strict=True) if np.frombuffer(g, "<u4").tolist() != w.ids]
    assert wrong == []


class Asked:
    """A tokenizer that counts the words it is asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.words += sum(len(t.split()) - t.split().count("0") for t in texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_packing_asks_for_a_word_once(monkeypatch):
    """Some 360,000 words fit into what a worker remembers, which stays small."""
    words = packing._Words(WORDS)
    asked = words.tokenizer = Asked(words.tokenizer)
    monkeypatch.setattr(packing, "kept", lambda *_: words)
    letters = "abcdefghijklmnopqrst"
    some = ["".join(c) for c in product(letters, letters, letters, letters, "xyz")]
    many, few = " ".join(some[:240_000]), " ".join(some[240_000:360_000])
    first = packing._encoded(WORDS, [many])
    packing._encoded(WORDS, [few])
    assert packing._encoded(WORDS, [many]) == first
    assert 360_000 <= asked.words <= 361_000


@pytest.mark.parametrize("remembered", [0, 400, 4000, 1 << 20])
def test_packing_forgets_words_and_still_has_their_ids(monkeypatch, remembered):
    words = packing._Words(WORDS)
    monkeypatch.setattr(packing, "kept", lambda *_: words)
    monkeypatch.setattr(packing, "REMEMBERED", remembered, raising=False)
    tokenizer = Tokenizer.from_file(WORDS)
    odd = [
        "", " ", "0", "00", "10", "a0", "0.", "x00 0 y", "..", "a.", "A.!", "It's", "IT'S.", "don't,", "a-b;",
        "<|endoftext|>", "a<|startoftext|>.", "x<|endoftext|>0", "<|ENDOFTEXT|>", "\u0130.", "\u0301x", "e\u0301.",
        "\u1100\u1161!", "tab\tb.", "\r\n0\n", "\u2028a", "\u00a00", "\uff10", "\u0660.", "\u212a.", "\u037e", "\U0001f600!",
    ]
    rng = random.Random(5)
    for _ in range(40):
        texts = [
            rng.choice([" ", "\n", "  "]).join(
                rng.choice([rng.choice(odd), f"{rng.choice('abcXYZ')}{rng.randrange(300)}", chr(rng.randrange(97, 500)) * 2 + "!"])
                for _ in range(rng.randrange(60))
            )
            for _ in range(rng.randrange(1, 9))
        ]
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(g, "<u4").tolist() for g in packing._encoded(WORDS, texts)] == want


def test_crossover_keeps_every_item_once():
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    shuffled = rng.sample(range(300), 300)
    a = packing.Packing(100, [], []).best_fit(sorted(range(300), key=lambda i: -sizes[i]), sizes)
    b = packing.Packing(100, [], []).best_fit(shuffled, sizes)
    child = packing.cross(a, b, sizes, rng)
    assert sorted(i for bin_ in child.bins for i in bin_) == list(range(300))
    assert all(sum(sizes[i] for i in x) + f == 100 for x, f in zip(child.bins, child.free))
    best = packing.evolve(sizes, 100, 1, [a.places(300)], 20)
    assert max(best) + 1 <= len(a.bins)


# ---------------------------------------------------------------- 4


def test_token_counts(spark, documents, odd, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def want(rows):
        counts = [(i, t or "", len(model.encode(t or ""))) for i, t in rows]
        return Counter((i, len(t.encode()), n, n > 4096) for i, t, n in counts)

    assert Counter(map(tuple, queries.op4_token_counts(spark, SF).collect())) == want(documents)
    assert Counter(map(tuple, token_counts.count(odd, PIECES).collect())) == want(ODD)
    assert token_counts.count(none, PIECES).collect() == []


# ---------------------------------------------------------------- 5 and 7


def vectors_of(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r.vec_id: np.array(r.embedding, np.float64) for r in rows}


def brute_nearest(vectors, queries_, k):
    out = {}
    for q in queries_:
        scored = [(-float(v @ vectors[q]), i) for i, v in vectors.items() if i != q]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_neighbours_recall_and_scores(spark):
    vectors = vectors_of(spark)
    rows = rows_of(queries.op5_nearest_neighbours(spark, SF))
    want = brute_nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
        exact = float(vectors[r["query_id"]] @ vectors[r["vec_id"]])
        assert math.isclose(r["score"], exact, rel_tol=1e-12, abs_tol=1e-12)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    ranks = defaultdict(list)
    for r in rows:
        ranks[r["query_id"]].append(r["rank"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in ranks.values())


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3), -1.0]) for i in range(40)]
    rows += [(i, [2.0, 2.0, 2.0]) for i in range(40, 80)]  # copies
    rows += [(80, None), (81, [0.0, 0.0, 0.0]), (82, [1.0, None, 1.0]), (83, [nan, 1.0, 1.0])]
    rows += [(84, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (0, [1.0, 0.0, -1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def test_neighbours_odd_rows(spark):
    rows = odd_vectors(spark)
    rows = rows.select("vec_id", ann.usable().alias("vector"))
    got = defaultdict(list)
    found = ann.nearest(rows, F.col("vec_id") % 20 == 0, 5).collect()
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    vectors = {i: np.array([1.0, i % 3, -1.0]) for i in range(40)}
    vectors |= {i: np.full(3, 2.0) for i in range(40, 80)}
    assert dict(got) == brute_nearest(vectors, [0, 20, 40, 60], 5)
    assert ann.nearest(rows.limit(0), F.lit(True), 5).collect() == []


def test_neighbours_of_each_size_and_full_lists(spark):
    """An odd first row hides nothing, and leaves with few vectors give no short list."""
    ready(spark)
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 2.0])] + [(i, rng.normal(size=8).tolist()) for i in range(1, 301)]
    rows += [(1000 + i, (50 + rng.normal(size=8)).tolist()) for i in range(2)]  # far from the rest
    frame = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(3)
    got = Counter(r.query_id for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == {i: 20 for i in [*range(20, 301, 20), 1000]}
    few = ann.nearest(frame.filter("vec_id < 10"), F.lit(True), 20).collect()
    assert Counter(r.query_id for r in few) == {i: 8 for i in range(1, 10)}


def test_top_k_odd_rows(spark):
    rows = odd_vectors(spark)
    rows = rows.select("vec_id", topk.quantised().alias("vector"))
    found = topk.top_k(rows, F.col("vec_id") % 20 == 0, 5).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    vectors = {i: np.array([256, 256 * (i % 3), -256]) for i in range(40)}
    vectors |= {i: np.full(3, 512) for i in range(40, 80)} | {81: np.zeros(3, int)}
    want = brute_nearest(vectors, [0, 20, 40, 60], 5)
    assert {q: [i for i, _ in x] for q, x in got.items()} == want
    assert all(s == int(vectors[q] @ vectors[i]) for q, x in got.items() for i, s in x)
    assert topk.top_k(rows.limit(0), F.lit(True), 5).collect() == []


# ---------------------------------------------------------------- 6


def brute_base(rows):
    def fold(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 10

    tokens = [(i, [*words_of(t, lower=True), None]) for i, t in rows]
    counts = Counter(x for i, w in tokens if fold(i) for x in w)
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, w in tokens:
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        known = sum(counts[x] > 0 for x in w)
        out.append((i, fold(i) == 0, len(w), known, n, base))
    return out


def brute_model(rows, weights):
    """log10 probability of each text by dictionaries of counts and the given mixture."""

    def fold(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 10

    tokens = [(i, [None, *words_of(t, lower=True), None]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, w in tokens:
        if fold(i):
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
    n, out = sum(one.values()), []
    for i, w in tokens:
        total = 0.0
        for before, x in zip(w, w[1:], strict=False):
            seen = one[before]
            a, b, c = weights[min(int(math.log2(seen)) + 1, lm.BUCKETS - 1) if seen else 0]
            follows = two[before, x] / seen if seen else 0
            total += math.log10(a * follows + b * one[x] / n + c / (len(one) + 1))
        out.append((i, round(total, 6)))
    return Counter(out)


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_lm_model_scores(spark, documents, odd, table, monkeypatch):
    kept, learn = [], lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda *a: kept.append(learn(*a)) or kept[-1])
    rows = ODD if table == "odd" else documents
    frame = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    got = Counter((r.doc_id, round(r.score, 6)) for r in lm.score(frame).collect())
    assert got == brute_model(rows, kept[0])


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_lm_scores(spark, documents, odd, table, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)
    if table == "odd":
        rows, found = ODD, lm.score(odd).collect()
    else:
        rows = documents
        found = lm.score(spark.read.parquet(f"{SF}/documents.parquet").repartition(3)).collect()
    key = lambda x: tuple((y is not None, y) for y in x[:4]) + (round(x[5], 6),)
    got, want = sorted(map(tuple, found), key=key), sorted(brute_base(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert g[6] <= 1e-9
    if table == "documents":
        held = [g for g in got if g[1]]
        assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_lm_probabilities_add_up():
    bins = np.array([[0, 0, 40], [3, 9, 40], [3, 0, 80]])
    weights = lm.learn_weights(bins, np.array([10, 20, 5]), 100)
    assert np.allclose(weights.sum(axis=1), 1)
    assert weights[0, 0] == 0 and (weights[:, 2] > 0).all()


def test_lm_empty(none):
    assert lm.score(none).collect() == []


# ---------------------------------------------------------------- 8


def brute_fingerprint(text, width):
    words = [w.decode() for w in words_of(text, lower=True)]
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = [" ".join(words[i : i + width]) for i in range(n)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius, near=None):
    """Smallest id reachable, by id."""
    near = near or (lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius)
    ids = sorted(prints)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: root(i) for i in ids}


def test_simhash_query(spark, documents):
    prints = {i: brute_fingerprint(t, 3) for i, t in documents}
    groups = brute_groups(prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_groups(spark, SF).collect()}
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    prints = {i: brute_fingerprint(t, 3) for i, t in ODD if i is not None}
    groups = brute_groups(prints, 3)
    by_print = {p: groups[i] for i, p in sorted(prints.items(), reverse=True)}
    want = Counter()
    for i, t in ODD:
        own = brute_fingerprint(t, 3)
        want[i, own, by_print.get(own) if i is None else groups[i]] += 1
    assert Counter((r.doc_id, r.bits & (1 << 64) - 1, r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).collect() == []


def shingles_of(text, width=5):
    words = [w.decode() for w in words_of(text, lower=True)]
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def alike(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket", [16_384, 8])
def test_covering_finds_every_link(spark, bucket):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p, n) for n, p in enumerate(sorted(prints))]
    nodes = spark.createDataFrame(signed, "bits long, node long")
    found = simhash.components(simhash.links(nodes, 3, bucket)).collect()
    got = {n: n for _, n in signed} | {r.node: r.component for r in found}
    assert got == brute_groups({n: b & (1 << 64) - 1 for b, n in signed}, 3)


def test_masks_cover_every_small_difference():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(3)]
    assert len(masks) == 15
    rng = random.Random(5)
    for _ in range(3000):
        gone = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & gone for m in masks)


# ---------------------------------------------------------------- 9


PAGES = [
    (1, "http://Www.Example.com/a?b=1#c", "<p>same</p>"),
    (5, "https://user@example.com:80/ä", "<p>same</p>"),
    (3, None, None),
    (4, "", ""),
    (None, "x", "<p>same</p>"),
    (2, "http://example.com/a", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 3),
    (6, "http://example.com/a", "y" * 300_000),
    (6, "http://example.com/a", "y" * 300_000),
]


def test_warc_odd_rows(spark, tmp_path):
    ready(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = Counter(tuple(r) for r in warc.round_trip(pages.withColumn("file", F.lit(1))).collect())
    last = {"<p>same</p>": 5, "": 4}
    want = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        to = last.get(html or "")
        same = to is None or to == i
        want[i, len(data), digest, "response" if same else "revisit", None if same else to] += 1
    # One of the two equal rows of page 6 refers to the other.
    y = next(k for k in want if k[0] == 6)
    want[y] -= 1
    want[(*y[:3], "revisit", 6)] += 1
    assert got == +want
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_index_looks_up_one_url(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = str(tmp_path / "warc")
    captures = warc.write(pages, folder)
    index = warc.Index.load(folder, warc.write_index(captures, folder))
    rows = pages.select("page_id", "html", warc.surt("url").alias("key")).collect()
    assert len(index.entries) >= len(rows) // 3
    for key in {r["key"] for r in rows[:20]}:
        found = index.read(key)
        want = sorted(r.page_id for r in rows if r["key"] == key)
        assert sorted(int(h["WARC-Page-ID"]) for h, _ in found) == want
        for headers, payload in found:
            if headers["WARC-Type"] == "response":
                own = next(r for r in rows if str(r.page_id) == headers["WARC-Page-ID"])
                assert payload == own.html.encode()
    assert index.read("nowhere)/") == []


def test_surt(spark):
    df = spark.createDataFrame([(u,) for _, u, _ in PAGES[:5]], "url string")
    got = [r[0] for r in df.select(warc.surt("url")).collect()]
    assert got == ["com,example,www)/a?b=1", "com,example)/ä", ")", ")", "x)"]


# ---------------------------------------------------------------- 10


@pytest.fixture(scope="module")
def model(spark):
    ready(spark)
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def test_toxicity_held_out_accuracy(spark, model):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null")
    held = labels.filter(lm.remainder("doc_id", 3) == 1).select("doc_id", "toxic")
    rows = toxicity.score(docs.join(held, "doc_id"), model).collect()
    right = sum((r.score >= 0.7) == (r.toxic == 1) for r in rows)
    wrongly = sum(r.score >= 0.7 for r in rows if r.toxic == 0)
    assert right >= 0.97 * len(rows)
    assert wrongly <= 0.02 * len(rows)


def test_toxicity_odd_rows(odd, none, model):
    got = toxicity.score(odd.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.score < 0.7 for r in got if not (r.text or "").strip())
    assert toxicity.score(none, model).collect() == []
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_toxicity_reads_whole_texts(model):
    filler = "the quiet town had of in and to a is " * 400
    scores = toxicity.scores(model, [filler, filler + " you stupid idiot worthless moron loser"])
    assert scores[0] < 0.7 <= scores[1]


def brute_toxicity(model, text):
    """Score of a text of short words, word by word and step by step."""
    w, words = model.weights, [x.decode() for x in words_of(text, lower=True)]
    at = {int(h): n + 1 for n, h in enumerate(model.words)}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        data = word.encode()
        own = toxicity.hash_words(toxicity.Words([data]))[0]
        known = at.get(int(own), 0)
        marked, places = b"\x01" + data + b"\x02", []
        for i in range(len(data)):
            code = (marked[i] << 16 | marked[i + 1] << 8 | marked[i + 2]) * 2654435761 % 2**32
            places.append(code >> 32 - toxicity.THREE)
        for i in range(len(data) - 4):
            code = 0
            for b in data[i : i + 5]:
                code = (code ^ b) * 16777619 % 2**32
            places.append((1 << toxicity.THREE) + (code * 2654435761 % 2**32 >> 32 - toxicity.FIVE))
        grams = [w["char"][p].astype(float) for p in places]
        odds = max(w["gram_odds"][p] for p in places)
        return np.concatenate([w["word"][known], np.mean(grams, axis=0), [odds], [w["odds"][known]]])

    n, h = len(words), toxicity.HIDDEN
    starts = [0] if n <= toxicity.WINDOW else [
        min(i * toxicity.STRIDE, n - toxicity.WINDOW)
        for i in range(-(-(n - toxicity.WINDOW) // toxicity.STRIDE) + 1)
    ]
    worst = -np.inf
    for start in starts:
        inputs = [vector(x) @ w["enter"] + w["enter_bias"] for x in words[start : start + toxicity.WINDOW]]
        states = np.zeros((len(inputs), 2 * h))
        for way in (0, 1):
            state = np.zeros(h)
            for t in range(len(inputs)) if way == 0 else reversed(range(len(inputs))):
                x, y = inputs[t][way * 3 * h : (way + 1) * 3 * h], state @ w["inner"][way]
                z, r = sigmoid(x[:h] + y[:h]), sigmoid(x[h : 2 * h] + y[h : 2 * h])
                new = np.tanh(x[2 * h :] + r * y[2 * h :])
                state = z * state + (1 - z) * new
                states[t, way * h : (way + 1) * h] = state
        if len(inputs):
            raw = np.tanh(states @ w["attend"]) @ w["attend_to"]
            share = np.exp(raw - raw.max())
            pooled = (share / share.sum()) @ states
        else:
            pooled = np.zeros(2 * h)
        worst = max(worst, float(pooled @ w["out"] + w["bias"][0]))
    return sigmoid(model.scale[0] * worst + model.scale[1])


def test_toxicity_scores_equal_plain_loops(model, documents):
    some = [t for _, t in sorted(documents) if max(map(len, words_of(t)), default=0) <= 64][:25]
    some += ["a", "you stupid idiot", "x " * 49, "b c " * 100]
    got = toxicity.scores(model, some)
    assert np.allclose(got, [brute_toxicity(model, t) for t in some], atol=2e-4)


def test_training_sample_is_bounded_and_whole(spark, monkeypatch):
    """One text for each id however often it occurs, none beyond the bytes, none in part."""
    ready(spark)
    rows = [(i, f"text {i} " + "w " * 50) for i in range(40) for _ in range(3)] + [(3, "another"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda texts, marks: (sorted(texts), marks.tolist()))
    texts, marks = toxicity.train(docs, labels)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    want = sorted("another" if i == 3 else f"text {i} " + "w " * 50 for i in ids)
    assert texts == want and len(marks) == len(want)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 1000)
    texts, _ = toxicity.train(docs, labels)
    assert set(texts) <= set(want) and 800 < sum(map(len, texts)) <= 1000
    monkeypatch.undo()
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.train(docs, labels.filter("toxic = 1")) is None
    assert toxicity.train(docs.limit(0), labels) is None


def test_toxicity_gradients():
    """What training goes down is the slope of what scoring computes."""
    rng = np.random.default_rng(0)
    inputs = toxicity._Inputs(["a bad word here", "nothing at all", "x " * 60])
    w = toxicity._start(rng, 3, np.zeros(4), np.zeros(toxicity.CHAR_TABLE))
    w = {k: v.astype(np.float64) for k, v in w.items()}
    x, _ = toxicity._vectors(inputs, inputs.hashes[:3], w)
    projected = x.astype(np.float64) @ w["enter"] + w["enter_bias"]
    ids = inputs.windows(slice(None))
    real = ids != inputs.padding
    total = lambda: float(toxicity._run(w, projected, ids, real, False)[0].sum())
    _, trace = toxicity._run(w, projected, ids, real, keep=True)
    g, d_projected = toxicity._back(w, projected, ids, real, trace, np.ones(len(ids)))
    for table, slope in [(w[k], g[k]) for k in ("inner", "attend", "out")] + [(projected, d_projected)]:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in table.shape)
            before = table[at]
            table[at] = before + 1e-2
            up = total()
            table[at] = before - 1e-2
            down = total()
            table[at] = before
            assert math.isclose((up - down) / 2e-2, slope[at], rel_tol=0.1, abs_tol=5e-3)


# ---------------------------------------------------------------- pipeline


def brute_similar(texts):
    """Groups of texts alike in 0.8 of their shingles, by all pairs of sets."""
    sets = {i: shingles_of(t or "") for i, t in texts.items()}

    def near(a, b):
        x, y = sets[a], sets[b]
        return 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and alike(x, y) >= 0.8

    return brute_groups(texts, 0, near)


def test_pipeline_stages(spark):
    ready(spark)
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = corpus_pipeline.cut(stages["toxicity"](spark, docs, folder))
    assert clean.columns == docs.columns
    gone = docs.join(clean, "doc_id", "left_anti").collect()
    assert sum(labels.get(r.doc_id) == 0 for r in gone) <= 0.02 * docs.count()

    apart = corpus_pipeline.cut(stages["near_duplicates"](spark, clean, folder))
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id for r in apart.collect()} == set(brute_similar(texts).values())

    once = corpus_pipeline.cut(stages["repeated_passages"](spark, apart, folder))
    assert once.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in apart.collect()]
    own = dict(rows)
    want = {
        i: kept if removed else own[i]
        for (i, _, removed, kept) in brute_removal(rows, 50)
        if not (removed and not kept)
    }
    assert {r.doc_id: r.text for r in once.collect()} == want
    packed = rows_of(stages["packing"](spark, once, folder))
    used, least = check_packing(packed, [(i, t) for i, t in want.items()], 4096)
    assert used <= least + 1


def test_pipeline_odd_rows(spark, odd, none):
    docs = odd.select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")
    )
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, table: corpus_pipeline.cut(stages[name](spark, table, SF))
    empty = docs.limit(0)
    for name in stages:
        empty = run(name, empty)
        assert empty.count() == 0
    clean = run("toxicity", docs)
    assert Counter(map(tuple, clean.collect())) == Counter(map(tuple, docs.collect()))
    apart = run("near_duplicates", clean)
    # Rows without an id stay; of the others one of each group, that of the smallest id.
    known = sorted((i, t) for i, t in ((i, t or "") for i, t in ODD if i is not None))
    groups = brute_similar(dict(enumerate(t for _, t in known)))
    want = Counter(known[n][0] for n in set(groups.values())) + Counter([None] * 2)
    assert Counter(r.doc_id for r in apart.collect()) == want
    once = run("repeated_passages", apart)
    rows = [(r.doc_id, r.text) for r in apart.collect()]
    kept = {(i, t): n for (i, _, gone, t), n in brute_removal(rows, 50).items() if gone}
    changed = Counter({k: n for k, n in kept.items() if k[1]})
    texts = Counter((r.doc_id, r.text) for r in once.collect())
    assert texts - Counter(rows) == changed
    assert sum(texts.values()) == len(rows) - sum(n for k, n in kept.items() if not k[1])
    packed = rows_of(run("packing", once))
    check_packing(packed, list(texts.elements()), 4096)
