"""Filter interactions, quality rules and vector codes against brute force and their SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, duck
from tests.llm.test_operators import ODD, none, odd  # noqa: F401
from tidelake.llm import codes, interactions, quality, queries
from tidelake.llm.workers import ready

SF = "/root/testdata/sf0.001"
NEW = ["op11_filter_interactions", "op12_quality_rules", "op13_vector_codes"]


@pytest.mark.parametrize("name", NEW)
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name]) is None


# ---------------------------------------------------------------- 11


def brute_fails(rows):
    """The letters each row (id, text, part) fails."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = "A" * (len(words) < 50)
        fails += "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            fails += "E"
        out.append(fails)
    return out


def brute_audit(rows, labels):
    """Every figure by going through all orders document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = {}, Counter()
    fails = brute_fails(rows)
    for part in {p or "" for _, _, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                out[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(letter in f for _, f in own) - len(gone),
                    sum(f == letter for _, f in own),
                    sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone),
                ]
                shapley[part, letter] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(1, 1, 0), (1, 0, 1), (5, 1, None), (6, None, 1), (6, 1, 0), (9, 1, 1), (None, 1, 1), (77, 1, 1)]
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, rows):
    docs = spark.createDataFrame(
        [(*r, "clash") for r in rows], "doc_id long, text string, source string, n string"
    ).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = interactions.text_filters(docs, labels).collect()
    assert len({(r.part, r.filter_order, r.step) for r in found}) == len(found)
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIGURES) for r in found}


def test_interactions_odd_rows(spark, none):  # noqa: F811
    ready(spark)
    rows = [(i, t, None if n % 3 == 0 else ("" if n % 3 == 1 else "s")) for n, (i, t) in enumerate(ODD)]
    many = " ".join(f"w{i}" for i in range(60))
    rows += [(20, many, "s"), (21, many, "t"), (20, many, "t"), (None, many, "t"), (19, many + " #", "t")]
    rows += [(30 + i, many, "hot") for i in range(40)]  # a group of copies
    assert audited(spark, rows) == brute_audit(rows, LABELS)
    empty = none.withColumn("source", F.lit("x"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert interactions.text_filters(empty, labels).collect() == []
    assert all(r[4] == 0 for r in brute_audit(rows, []).values())


def test_contractions_equal_sums_over_cells():
    rng = np.random.default_rng(1)
    tensor = rng.integers(0, 9, (3, 4, 2, 2, 2, 2))
    for (own, before), got in interactions.figures(tensor).items():
        for lead in np.ndindex(3, 4):
            kept = removed = failing = 0
            for cell in np.ndindex(2, 2, 2, 2):
                n, passed = tensor[lead][cell], not any(cell[b] for b in before)
                kept += n * (passed and not cell[own])
                removed += n * (passed and cell[own])
                failing += n * cell[own]
            assert got["kept"][lead] == kept and got["removed"][lead] == removed
            assert got["redundant"][lead] == failing - removed


# ---------------------------------------------------------------- 12


def brute_statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    again = {i + k for w in windows.values() if len(w) > 1 for i in w for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(again),
    )


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics_odd_rows(spark, odd, none):  # noqa: F811
    more = ["a b c d e a b c d e", "x\ny\nx\n \n\nx", "a  b\tc\x0bd\re\x0cf " * 3, "#$ | <x> **\n" * 4, "e d c b a a b c d e", "一 二 三 四 五 " * 2]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra).withColumns(
        {"lang": F.lit(None).cast("string"), "source": F.lit("s"), "words": F.lit(1), "pool": F.lit(2)}
    )
    got = Counter(tuple(r[c] for c in ["doc_id", *STATISTICS]) for r in quality.judge(docs).collect())
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(more))]
    assert got == Counter((i, *brute_statistics(t)) for i, t in rows)
    empty = none.withColumns({"lang": F.lit("x"), "source": F.lit("x")})
    assert quality.judge(empty).collect() == []


def brute_distances(vectors):
    """Distances of one group by the definition, in numpy."""
    wide = np.diag([(w * quality.UNIT) ** 2 for w in quality.WIDTH])
    n = len(vectors)

    def far(centre, cov):
        z = np.linalg.solve(np.linalg.cholesky(cov), (vectors - centre).T)
        return (z**2).sum(axis=0)

    def estimate(some, factor=1.0):
        x = vectors[some]
        return x.mean(axis=0), np.cov(x.T, bias=True) * factor + wide

    grid = np.sort(vectors // quality.GRID, axis=0)
    low, mid, high = (grid[-(-k * n // 4) - 1] for k in (1, 2, 3))
    spread = (high - low) * quality.GRID / 1.349
    tried = []
    for centre, cov in (((mid + 0.5) * quality.GRID, np.diag(spread**2) + wide), estimate(np.full(n, True))):
        for _ in range(quality.STEPS):
            bins = np.minimum(np.floor(np.sqrt(far(centre, cov)) * quality.BINS), quality.LAST_BIN)
            below = np.array([(bins < b).sum() for b in bins])
            centre, cov = estimate(4 * below < 3 * n)
        tried.append((np.linalg.det(cov), centre, cov))
    _, centre, cov = min(tried, key=lambda t: t[0])
    near = far(centre, cov) <= quality.NEAR * quality.CONSISTENT_HALF
    return far(*estimate(near, quality.CONSISTENT_NEAR))


def test_estimates_equal_numpy(spark):
    """Groups of their own, a shared one per language, and one of all small ones."""
    ready(spark)
    rng, rows = random.Random(3), []
    groups = [("a", "big", 200), ("a", "s1", 30), ("a", "s2", 30), ("b", "s1", 30), ("c", "s9", 35), ("d", "hot", 400)]
    for lang, source, n in groups:
        for _ in range(n):
            words = [f"{lang}{rng.getrandbits(30):x}"[: rng.randint(2, 9)] for _ in range(rng.randint(12, 90))]
            if rng.random() < 0.15:
                words = [w + "###" for w in words]
            rows.append((len(rows), " ".join(words) + "\nx" * rng.choice([0, 0, 0, 1, 6]), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    pools = defaultdict(list)
    for i, text, lang, source in rows:
        n, chars, symbols, dups, repeats = brute_statistics(text)
        failed = n < 10 or 100 * repeats > 20 * n
        assert found[i].base_failed == failed
        if not failed:
            pool = ("source", lang, source) if source in ("big", "hot") else ("language", lang) if lang == "a" else "all"
            x = [np.log(n), np.log(chars / n), np.sqrt(symbols / chars), np.log(1 + dups), np.sqrt(repeats / n)]
            pools[pool].append((i, np.floor(quality.UNIT * np.array(x) + 0.5)))
    assert len(pools) == 4
    for members in pools.values():
        want = brute_distances(np.array([x for _, x in members]))
        got = np.array([found[i].distance for i, _ in members])
        assert np.allclose(got, want, rtol=1e-6)
        assert [found[i].kept for i, _ in members] == (got <= quality.CUTOFF).tolist()
    outliers = [r for r in found.values() if r.n_symbols > r.n_words]
    assert len(outliers) > 60 and not any(r.kept for r in outliers)
    assert sum(r.kept for r in found.values()) > 0.7 * len(rows)


def test_small_pools_keep_what_the_base_rules_keep(spark):
    ready(spark)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20)) + "#" * (40 * i), "l", "s") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert all(r.kept and r.distance is None for r in quality.judge(docs).collect())


# ---------------------------------------------------------------- 13


def brute_codes(rows):
    """Rows (id, code, error, label error, digest), for vectors of each size by themselves."""
    out, coded = [], []
    for dim in sorted({len(v) for _, _, v in rows if v and len(v) % 8 == 0}):
        own = [(i, lab, v) for i, lab, v in rows if v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        whole = [[max(-(1 << 62), min(1 << 62, int(np.floor(4096 * float(x))))) for x in v] for _, _, v in own]
        width, books, codes_, far_ = dim // 8, [], [""] * len(own), [0] * len(own)
        for p in range(8):
            parts = [v[p * width : (p + 1) * width] for v in whole]
            book = [list(v) for v in parts[:16]]

            def nearest(v, book=book):
                return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), n) for n, e in enumerate(book))

            for _ in range(6):
                at = [nearest(v)[1] for v in parts]
                for e in range(len(book)):
                    mine = [v for v, a in zip(parts, at, strict=True) if a == e]
                    if mine:
                        book[e][:] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
            for n, v in enumerate(parts):
                far, e = nearest(v)
                codes_[n] += f"{e:02x}"
                far_[n] += far
            books += [x for e in book for x in e]
        digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
        coded += [(r[0], r[1], c, min(f, 2**63 - 1), digest) for r, c, f in zip(own, codes_, far_, strict=True)]
    sums = Counter()
    for _, label, _, far, _ in coded:
        sums[label] += far
    for i, label, code, far, digest in coded:
        out.append((i, code, far, min(sums[label], 2**63 - 1), digest))
    return Counter(out)


def coded(spark, rows, split=3):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(split)
    frame = frame.select("vec_id", "label", codes.finite().alias("vector"), F.lit("x").alias("dim"))
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return Counter(tuple(r[c] for c in columns) for r in codes.compress(frame).collect())


@pytest.mark.parametrize("block", [64, 3])
def test_codes_odd_rows(spark, block, monkeypatch):
    ready(spark)
    monkeypatch.setattr(codes, "BLOCK_ROWS", block)
    rng = random.Random(6)
    base = [[rng.choice([-1.5, -0.25, 0.0, 0.25, 0.3]) for _ in range(16)] for _ in range(20)]
    rows = [(100 - i, i % 3 if i % 4 else None, rng.choice(base)) for i in range(70)]
    rows += [(7, 1, base[0]), (7, 1, base[1]), (None, 2, base[2]), (3, None, [0.0] * 16), (2, None, [0.0] * 16)]
    rows += [(1, 1, None), (4, 1, [1.0] * 15 + [None]), (5, 1, [float("nan")] * 16), (6, 1, [float("inf")] + [0.0] * 15)]
    rows += [(8, 1, []), (9, 1, [1.0] * 7), (10, 1, [0.1] * 8), (11, 1, [-0.2] * 8), (12, None, [1.0 / k for k in range(1, 9)])]
    assert coded(spark, rows) == brute_codes(rows)
    assert coded(spark, rows[:1]) == brute_codes(rows[:1])
    assert coded(spark, [(1, 1, None)]) == Counter()
    # Numbers whose squares are beyond 64 bits are exact all the same.
    huge = [(i, 1, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 25) for _ in range(8)]) for i in range(40)]
    assert coded(spark, huge) == brute_codes(huge)


def test_shortlists_lose_no_nearest_entry():
    rng = np.random.default_rng(2)
    for spread in (1, 50, 5000):
        values = rng.integers(-spread, spread + 1, (500, 6))
        part = codes.Part(values, codes.hilbert_order(values))
        book = rng.integers(-spread, spread + 1, (16, 6))
        far = ((values[:, None] - book[None]) ** 2).sum(axis=2)
        at, error = part.assign(book)
        assert (at == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
        counts, sums = part.gather(book)
        for e in range(16):
            assert counts[e] == (at == e).sum() and (sums[e] == values[at == e].sum(axis=0)).all()
        assert sorted(part.order.tolist()) == list(range(500))


def test_curve_keeps_neighbours_together():
    """Steps along the whole curve over a grid go to a neighbour each."""
    grid = np.stack(np.meshgrid(np.arange(16), np.arange(16)), axis=-1).reshape(-1, 2)
    walk = grid[codes.hilbert_order(grid)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
