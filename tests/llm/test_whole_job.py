"""Near copies by their true similarity, repeated ids, and passages deep in a text."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_operators import alike, brute_groups, brute_removal, brute_similar, model, shingles_of  # noqa: F401
from tidelake.llm import jaccard, toxicity
from tidelake.llm.workers import ready


def edited(words, n, rng):
    """The words, some from each of ``n`` places on replaced."""
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.getrandbits(40)}"
    return out


def texts_between(low, high, n, seed):
    """``n`` pairs of texts with a similarity in [low, high)."""
    rng, pairs = random.Random(seed), []
    while len(pairs) < n:
        words = [f"w{rng.getrandbits(16)}" for _ in range(rng.choice([12, 40, 120, 400, 900]))]
        other = edited(words, max(1, int(len(words) * rng.uniform(0.01, 0.13))), rng)
        a, b = " ".join(words), " ".join(other)
        if low <= alike(shingles_of(a), shingles_of(b)) < high:
            pairs.append((a, b))
    return pairs


def stage_rows(spark, rows, stage):
    """Pairs of id and text that a stage of the pipeline leaves."""
    ready(spark)
    frame = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).repartition(3)
    return Counter((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)[stage](spark, frame, "").collect())


def groups_of(spark, rows):
    ready(spark)
    frame = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "row long, doc_id long, text string")
    found = jaccard.copies(frame.repartition(3)).collect()
    assert len(found) == len(rows)
    members = {}
    for r in found:
        members.setdefault(r.component, []).append(r)
    assert all(sum(r.kept for r in m) == 1 for m in members.values())
    return {r.row: min(x.row for x in members[r.component]) for r in found}


def test_only_verified_copies_go(spark):
    """Less similar texts stay, also those with equal fingerprints of word pairs."""
    rows = [t for pair in texts_between(0.5, 0.8, 40, 1) for t in pair]
    letters = [f"l{i}" for i in range(60)]
    for seed in range(3):
        random.Random(seed).shuffle(letters)
        rows.append("s " + " s ".join(letters) + " s")
    rows = list(enumerate(rows))
    assert stage_rows(spark, rows, "near_duplicates") == Counter(rows)


def test_groups_are_those_of_all_pairs(spark):
    """Chains, templates, copies and short texts, against every pair of shingle sets."""
    rng, texts = random.Random(2), ["", " ", None, "a", "A", "a b", "a b c d e", "a b c d e f", "x y"]
    for _ in range(25):
        words = [f"w{rng.getrandbits(12)}" for _ in range(rng.choice([6, 9, 20, 60, 200]))]
        texts += [" ".join(words), "  ".join(words).upper()]
        for _ in range(5):
            words = edited(words, rng.randint(0, 1 + len(words) // 30), rng)
            texts.append(" ".join(words + ["tail"] * rng.randint(0, 2)))
    rows = list(enumerate(texts))
    sets = {i: shingles_of(t or "") for i, t in rows}
    near = lambda a, b: sets[a] == sets[b] or alike(sets[a], sets[b]) >= 0.8
    assert groups_of(spark, rows) == brute_groups({i: 0 for i, _ in rows}, 0, near)


def test_no_copy_of_the_band_is_missed(spark):
    pairs = texts_between(0.8, 0.85, 150, 3)
    rows = list(enumerate(t for pair in pairs for t in pair))
    got = groups_of(spark, rows)
    assert [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))] == [True] * len(pairs)


@pytest.mark.parametrize("dealings", [1, 8])
def test_parts_without_shingles_lose_no_pair(monkeypatch, dealings):
    monkeypatch.setattr(jaccard, "DEALINGS", dealings)
    for a, b in texts_between(0.8, 1, 150, 4):
        value, doc = jaccard.shingles([a.encode(), b.encode()])
        signed, owner = jaccard.signatures(value, doc, 2)
        assert set(signed[owner == 0].tolist()) & set(signed[owner == 1].tolist())


def test_stages_judge_rows_of_one_id_apart(spark):
    """Repeated ids: each row keeps, loses or goes by its own text, and none is doubled."""
    passage = " ".join(f"p{i}" for i in range(70))
    own = " ".join(f"own{i}" for i in range(30))
    rows = [(1, passage)] + [(5, f"head {passage} tail")] * 3 + [(5, own), (6, passage), (6, own + " x")]
    want = Counter({(1, passage): 1, (5, "head tail"): 3, (5, own): 1, (6, own + " x"): 1})
    assert stage_rows(spark, rows, "repeated_passages") == want
    brute = {(i, kept): n for (i, _, _, kept), n in brute_removal(rows, 50).items() if kept}
    assert want == brute
    rows = [(1, passage), (5, passage + " more"), (5, own), (6, own), (6, passage + " x"), (7, "a b")] + [(None, own)] * 2
    want = Counter({(1, passage): 1, (5, own): 1, (7, "a b"): 1, (None, own): 2})
    assert stage_rows(spark, rows, "near_duplicates") == want


def test_near_duplicate_stage_on_documents(spark):
    """What the stage leaves of the documents is one of each group by true similarity."""
    frame = ready(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in frame.collect()}
    left = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, "").collect()
    assert sorted(r.doc_id for r in left) == sorted(set(brute_similar(texts).values()))


def test_template_texts_cost_rows_in_proportion(spark, monkeypatch):
    """Texts of one template that are not alike: no pair of them becomes a row."""
    kept = []
    check = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, texts: kept.append(pairs.count()) or check(pairs, texts))
    rng, ready_spark = random.Random(9), ready(spark)
    template = [f"t{i}" for i in range(200)]
    for n in (250, 500, 1000):
        rows = [(i, " ".join(edited(template, 10, rng))) for i in range(n)]
        kept.clear()
        frame = ready_spark.createDataFrame(rows, "row long, text string").repartition(3)
        assert jaccard.links(frame).count() == 0
        assert sum(kept) <= n, (n, kept)


def test_a_large_group_of_near_copies_costs_rows_in_proportion(spark, monkeypatch):
    """All alike: a tree of links, not all pairs, and one group in the end."""
    kept, check = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, texts: kept.append(pairs.count()) or check(pairs, texts))
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    rng = random.Random(10)
    base = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(edited(base, 5, rng))) for i in range(300)]
    sets = [shingles_of(t) for _, t in rows]
    near = lambda a, b: alike(sets[a], sets[b]) >= 0.8
    frame = ready(spark).createDataFrame(rows, "row long, text string").repartition(3)
    groups = {r.node: r.component for r in jaccard.components(jaccard.links(frame)).collect()}
    assert {i: groups.get(i, i) for i, _ in rows} == brute_groups({i: 0 for i, _ in rows}, 0, near)
    assert sum(kept) <= 12 * len(rows), kept


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 70, 400, 3000):
        for share in (0, 0.02, 0.1, 0.5):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.where(rng.random(n) < share, rng.integers(0, 1 << 63, n).astype(np.uint64), a)
            b = np.unique(b)[: max(1, int(n * rng.uniform(0.45, 1)))]
            a = np.unique(a)
            maps = [
                np.frombuffer(jaccard.bitmaps(x, np.zeros(len(x), np.int64), 1)[0], np.uint8) for x in (a, b)
            ]
            width = min(map(len, maps))
            x, y = (jaccard.folded(m, width) for m in maps)
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("mark", ["_", ".", "-", "/", ",", "\u00a0", "\u3000", "><", ""])
def test_toxicity_behind_the_head_of_a_long_word(model, mark):  # noqa: F811
    filler = "the quiet town had of in and to a is " * 40
    texts = [filler, filler + " you stupid idiot worthless moron loser"]
    clean, toxic = toxicity.scores(model, [mark.join(t.split()) for t in texts])
    assert clean < 0.7
    assert toxic >= 0.7 if mark else toxic > clean


def test_pieces_leave_nothing_out():
    text = ("日本語の文章" * 40 + "__a-" + "b" * 90 + "!" * 70).encode()
    words, hashes = toxicity._in_pieces(toxicity.Words([b"one two", text, b"", b"three"]))
    assert words.counts().tolist()[0::2] == [2, 0] and len(hashes) == len(words.starts) == words.first[-1]
    read = {b for lo, hi in zip(words.starts, words.ends, strict=True) for b in range(lo, hi)}
    begin = words.data.index(text)
    assert read >= set(range(begin, begin + len(text)))
    assert max(words.ends - words.starts) <= 64
    alone = toxicity.Words([b"three"])
    assert hashes[-1] == toxicity.hash_words(alone)[0]


def test_near_copies_come_through_fingerprints_first(spark, monkeypatch):
    """What SimHash and its covering tables find is what is verified first; the exact way
    meets only what they leave apart."""
    rng, asked, check = random.Random(11), [], jaccard.verified

    def told(pairs, texts):
        asked.append({(r.u, r.v) for r in pairs.collect()})
        return check(pairs, texts)

    monkeypatch.setattr(jaccard, "verified", told)
    base = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(base + [f"e{i}"])) for i in range(20)]
    other = [f"w{rng.getrandbits(30)}" for _ in range(400)]
    rows += [(20, " ".join(other)), (21, " ".join(edited(other, 6, rng)))]
    frame = ready(spark).createDataFrame(rows, "row long, text string").repartition(3)
    groups = {r.node: r.component for r in jaccard.components(jaccard.links(frame)).collect()}
    assert {i: groups.get(i, i) for i, _ in rows} == {i: 0 if i < 20 else 20 for i, _ in rows}
    fingerprints = {(r.u, r.v) for r in jaccard.by_fingerprint(frame).collect()}
    assert asked[0] and asked[0] <= fingerprints
    assert sum(u < 20 and v < 20 for u, v in asked[0]) >= 19
    assert not any(u < 20 and v < 20 for later in asked[1:] for u, v in later)


def test_a_block_of_long_texts_is_compared_in_bounded_steps(monkeypatch):
    """Bitmaps of long texts are held against each other a few at a time."""
    largest, little = [], jaccard._differ_little

    def told(a, b, sizes):
        largest.append(np.broadcast_shapes(a.shape, b.shape))
        return little(a, b, sizes)

    monkeypatch.setattr(jaccard, "_differ_little", told)
    monkeypatch.setattr(jaccard, "WORDS", 1 << 12)
    rng = np.random.default_rng(5)
    n, width = 100, 256
    table = pa.table(
        {
            "sig": pa.array([1] * n, pa.int64()),
            "lo": pa.array([0] * n, pa.int32()),
            "hi": pa.array([0] * n, pa.int32()),
            "block": pa.array([0] * n, pa.int32()),
            "node": pa.array(range(n), pa.int64()),
            "n": pa.array([1000] * n, pa.int64()),
            "g": pa.array(range(n), pa.int64()),
            "bits": pa.array([rng.bytes(width) for _ in range(n)], pa.binary()),
        }
    )
    assert jaccard.compare_block(table, None).num_rows == 0
    assert max(a * b * c for a, b, c in largest) <= max(1 << 12, n * width // 8)


def test_workers_forget_the_words_of_packing(spark):
    """What packing remembers is not in the way of the stages that use its workers later."""
    from tidelake.llm import packing, substrings, workers

    ready(spark)
    rows = [(i, f"w{i} " * 60, "en", "s", 0) for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.repartition(64)

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(workers._KEPT.get("packing", ()))]})

    def remembering():
        return spark.range(0, 64, 1, 64).mapInArrow(held, "n long").agg({"n": "sum"}).first()[0]

    for later in (lambda: toxicity.score(docs, None), lambda: substrings.remove(docs)):
        packing.pieces(docs, packing_words(), ids=False).write.format("noop").mode("overwrite").save()
        assert remembering()
        later().write.format("noop").mode("overwrite").save()
        assert not remembering()


def packing_words():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing_takes_a_batch_in_slices():
    from tidelake.llm import packing

    rng = random.Random(3)
    texts = [None, ""] + [f"t{i} " * rng.choice([1, 50_000, 400_000]) for i in range(60)] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(packing._taken(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    longest = max(len(t or "") for t in texts)
    assert all(sum(len(t or "") for t in p.column("text").to_pylist()) <= packing.TAKEN + longest for p in parts)
    assert list(packing._taken(batch.slice(0, 0))) == []
