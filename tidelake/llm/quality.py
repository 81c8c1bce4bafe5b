"""Quality rules: base limits, then robust multivariate outliers per language and source.

The statistics of a text, transformed, are one vector. For every language and source the
minimum-covariance-determinant estimate is found by concentration steps: measure all rows
with the current centre and covariance, take the nearest three quarters, estimate again.
Of several starts the smallest determinant stays; one reweighting follows, and rows whose
Mahalanobis distance is beyond the cutoff are rejected.

All of it is DataFrame and SQL functions. Vectors are whole numbers (units of 1/1024), so
sums are exact in any order and every run gives the same verdicts. Distances are counted in
bins of fixed width with the moments of each bin, so a step is one pass that reduces before
it shuffles, and the nearest three quarters are whole bins: no group is ever sorted or
gathered. What a group costs after that is bounded by the number of bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.session import cut

MIN_WORDS, REPEAT_SHARE, WINDOW = 10, 20, 5
#: Rows that a group needs for estimates of its own, and the number of steps of each start.
LEAST_ROWS, STEPS = 50, 10
#: Vectors are in units of 1 / UNIT; bins per unit of distance, and the bin of all the rest.
UNIT, BINS, LAST_BIN = 1024, 32, 256
#: Where starts look for quartiles, vectors are rounded down to so many units.
GRID = 32

#: The vector, by components, as SQL text that Spark and other engines read alike.
VECTOR = (
    f"floor({UNIT} * ln(n_words) + 0.5)",
    f"floor({UNIT} * ln(word_chars / nullif(n_words, 0)) + 0.5)",
    f"floor({UNIT} * sqrt(n_symbols / nullif(word_chars, 0)) + 0.5)",
    f"floor({UNIT} * ln(1 + n_dup_lines) + 0.5)",
    f"floor({UNIT} * sqrt(n_repeat_words / nullif(n_words, 0)) + 0.5)",
)
#: Added to the variance of each component (as a deviation, in whole measures, not units):
#: what most texts of a group have in common, such as no symbols, still has some width.
WIDTH = (0.1, 0.05, 0.05, 0.5, 0.1)
DIMS = len(VECTOR)

# Fixed values of the chi-squared distribution with five degrees of freedom: its 0.975 and
# 0.9999 quantiles, and a share over the probability that seven degrees leave below that
# share's quantile, which makes a covariance of the nearest rows that of all.
NEAR, CUTOFF = 12.8325, 25.7448
CONSISTENT_HALF, CONSISTENT_NEAR = 1.4121, 1.0553

_X = [f"x{i + 1}" for i in range(DIMS)]
_PAIRS = [(i + 1, j + 1) for i in range(DIMS) for j in range(i + 1)]
_SEPARATORS = " \t\n\x0b\x0c\r"
_PARAMETERS = [*(f"m{i + 1}" for i in range(DIMS)), *(f"l{i}{j}" for i, j in _PAIRS)]


# ---------------------------------------------------------------- statistics of a text


def statistics(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as ``doc_id, lang, source`` and what its rules look at.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long). Words and lines
    are compared whole, windows of five words by 64-bit hashes within their text. A null text is an empty one, a null language or source an empty string. Rows stay apart, also where
    ids repeat.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(
        F.col("doc_id").cast("long"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
        text.alias("text"),
    )
    # Each rare character is looked for first: a plain search is far cheaper than a pattern.
    spaced = F.when(_any("\t\x0b\x0c\r"), F.regexp_replace("text", r"[\x09-\x0D]", " "))
    spaced = spaced.otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    symbols = F.when(_any("#*$%&|<>"), F.regexp_count("text", F.lit("[#*$%&|<>]"))).otherwise(0)
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SEPARATORS)) != "")
    parts = F.split(spaced, " ")
    out = out.select(
        "doc_id",
        "lang",
        "source",
        symbols.cast("long").alias("n_symbols"),
        # Between the parts lies one separator each.
        (F.char_length("text") - F.size(parts) + 1).cast("long").alias("word_chars"),
        F.array_remove(parts, "").alias("words"),
        F.when(_any("\n"), lines).alias("lines"),
    )
    dup_lines = F.size("lines") - F.size(F.array_distinct("lines"))
    out = out.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_dup_lines": F.coalesce(dup_lines, F.lit(0)).cast("long"),
            "w1": F.transform("words", lambda x: F.xxhash64(x)),
        }
    )
    out = out.withColumn("w2", _joined("w1", "w1", 1))
    out = out.withColumn("w4", _joined("w2", "w2", 2))
    # Five words that occur again hold four that do. Only such texts are sorted, by window
    # and place; a window is whole, so the last words begin none.
    again = F.size(F.array_distinct("w4")) < F.size("w4")
    n = F.greatest(F.size("w1") - (WINDOW - 1), F.lit(0))
    windows = F.slice(_joined("w4", "w1", 4), F.lit(1), n)
    numbered = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    out = out.withColumn("ordered", F.when(again, F.sort_array(numbered)))

    def twice(x: Column, k: Column) -> Column:
        same = [F.get("ordered", k + d)["w"] == x["w"] for d in (-1, 1)]
        return F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))

    out = out.withColumn(
        "places", F.sort_array(F.transform(F.filter("ordered", twice), lambda x: x["i"]))
    )
    gaps = F.transform(
        "places",
        lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))),
    )
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda n, x: n + x)
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _any(characters: str) -> Column:
    """Whether the text has any of the characters."""
    found = F.lit(False)
    for c in characters:
        found = found | F.contains("text", F.lit(c))
    return found


def _joined(first: str, second: str, after: int) -> Column:
    """Values for ``after`` words more: those of ``first`` with those of ``second`` behind.

    The values are 64-bit word hashes, shifted by their place and combined bit by bit, so
    other words, or the same in another order, are equal by a chance of 2^-60.
    """

    def one(x: Column, i: Column) -> Column:
        return x.bitwiseXOR(F.shiftleft(F.coalesce(F.get(second, i + after), F.lit(0)), after))

    return F.transform(first, one)


def base_rule() -> Column:
    """Whether a text fails before any estimate."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words")
    )


# ---------------------------------------------------------------- formulas, as SQL text


def _distance() -> list[tuple[str, str]]:
    """Names and formulas, each of which may use those before: Mahalanobis distance."""
    out = []
    for i in range(1, DIMS + 1):
        less = "".join(f" - l{i}{j} * z{j}" for j in range(1, i))
        out.append((f"z{i}", f"(x{i} - m{i}{less}) / l{i}{i}"))
    return [*out, ("d2", " + ".join(f"z{i} * z{i}" for i in range(1, DIMS + 1)))]


def _moments() -> list[tuple[str, str]]:
    """Sums over rows: their number, components, and products of two."""
    out = [("n", "count(*)")] + [(f"s{i + 1}", f"sum({x})") for i, x in enumerate(_X)]
    return out + [(f"q{i}{j}", f"sum(x{i} * x{j})") for i, j in _PAIRS]


def _centre(factor: float) -> list[tuple[str, str]]:
    """Centre and covariance of moments, the covariance times ``factor``, widened."""
    out = [(f"m{i + 1}", f"cast(s{i + 1} as double) / n") for i in range(DIMS)]
    for i, j in _PAIRS:
        wide = f" + {(WIDTH[i - 1] * UNIT) ** 2!r}" if i == j else ""
        product = f"cast(s{i} as double) * cast(s{j} as double) / n"
        out.append((f"c{i}{j}", f"(cast(q{i}{j} as double) - {product}) / n * {factor!r}{wide}"))
    return out


def _cholesky() -> list[tuple[str, str]]:
    """Lower triangle of the covariance, and the product of its diagonal."""
    out = []
    for j in range(1, DIMS + 1):
        less = "".join(f" - l{j}{k} * l{j}{k}" for k in range(1, j))
        out.append((f"l{j}{j}", f"sqrt(c{j}{j}{less})"))
        for i in range(j + 1, DIMS + 1):
            less = "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j))
            out.append((f"l{i}{j}", f"(c{i}{j}{less}) / l{j}{j}"))
    return [*out, ("det", " * ".join(f"l{i}{i}" for i in range(1, DIMS + 1)))]


_BIN = f"cast(least(floor(sqrt(d2) * {BINS}), {LAST_BIN}) as int)"


def _with(df: DataFrame, formulas: list[tuple[str, str]]) -> DataFrame:
    for name, formula in formulas:
        df = df.withColumn(name, F.expr(formula))
    return df


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.expr(e).alias(k) for k, e in _moments()))


def _estimate(moments: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Centres and triangles from moments; also ``n`` and ``det``."""
    made = _with(_with(moments, _centre(factor)), _cholesky())
    return made.select(*keys, "n", "det", *_PARAMETERS)


# ---------------------------------------------------------------- groups and starts


def pools(rows: DataFrame) -> DataFrame:
    """``lang, source, pool``: the group that estimates for each language and source.

    Those with fewer than ``LEAST_ROWS`` rows share one with their like of the same
    language, and if these are too few together, with all such languages.
    """
    groups = cut(rows.groupBy("lang", "source").agg(F.count("*").alias("n")))
    small = F.col("n") < LEAST_ROWS
    rest = groups.filter(small).groupBy("lang").agg(F.sum("n").alias("rest"))
    named = F.concat_ws(":", F.char_length("lang"), "lang")
    pool = (
        F.when(~small, F.concat(F.lit("source:"), named, F.lit(":"), "source"))
        .when(F.col("rest") >= LEAST_ROWS, F.concat(F.lit("language:"), named))
        .otherwise("all")
    )
    return groups.join(rest, "lang", "left").select("lang", "source", pool.alias("pool"))


def _middle(rows: DataFrame) -> DataFrame:
    """A start: medians, and the spread between quartiles, of each component alone."""
    each = rows.select(
        "pool", F.posexplode(F.array(*(F.floor(F.col(x) / GRID).cast("int") for x in _X))).alias("i", "x")
    )
    counts = each.groupBy("pool", "i", "x").agg(F.count("*").alias("n"))
    group = Window.partitionBy("pool", "i")
    below = group.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"below": F.sum("n").over(below), "total": F.sum("n").over(group)})
    quartiles = counts.groupBy("pool", "i").agg(
        F.max("total").alias("n"),
        *(F.min(F.expr(f"case when 4 * below >= {k} * total then x end")).alias(f"v{k}") for k in (1, 2, 3)),
    )
    # The quartiles of a normal distribution are 1.349 deviations apart.
    of = lambda k, i: f"max(case when i = {i} then v{k} end)"
    start = quartiles.groupBy("pool").agg(
        F.max("n").alias("n"),
        *(F.expr(f"({of(2, i)} + 0.5) * {GRID}").cast("double").alias(f"m{i + 1}") for i in range(DIMS)),
        *(
            F.expr(f"({of(3, i)} - {of(1, i)}) * {GRID} / 1.349e0").cast("double").alias(f"w{i + 1}")
            for i in range(DIMS)
        ),
    )
    for i, j in _PAIRS:
        wide = f"w{i} * w{i} + {(WIDTH[i - 1] * UNIT) ** 2!r}"
        start = start.withColumn(f"c{i}{j}", F.expr(wide if i == j else "0e0"))
    start = _with(start, _cholesky()).filter(F.col("n") >= LEAST_ROWS)
    return start.select("pool", F.lit(0).alias("start"), "n", "det", *_PARAMETERS)


def _step(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Estimates of the nearest three quarters by the current ones, rounded up to a bin."""
    met = _with(rows.join(current.select("pool", "start", *_PARAMETERS), "pool"), _distance())
    moments = _sums(met.withColumn("bin", F.expr(_BIN)), "pool", "start", "bin")
    group = Window.partitionBy("pool", "start")
    below = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moments = moments.withColumns({"below": F.sum("n").over(below), "total": F.sum("n").over(group)})
    near = moments.filter("4 * (below - n) < 3 * total")
    names = [k for k, _ in _moments()]
    whole = near.groupBy("pool", "start").agg(*(F.sum(k).alias(k) for k in names))
    return cut(_estimate(whole, 1.0, "pool", "start"))


def estimates(rows: DataFrame) -> DataFrame:
    """``pool`` and the reweighted estimates of ``rows`` (``pool`` and the vector).

    Pools of fewer than ``LEAST_ROWS`` rows have none.
    """
    # Three quarters of a pool's rows count, so what is wrong with fewer than a quarter of
    # them cannot move the estimates; the starts are the middle of each component, and all.
    everyone = _estimate(_sums(rows, "pool"), 1.0, "pool").filter(F.col("n") >= LEAST_ROWS)
    everyone = everyone.withColumn("start", F.lit(1)).select("pool", "start", "n", "det", *_PARAMETERS)
    current = cut(_middle(rows).unionByName(everyone))
    for _ in range(STEPS):
        current = _step(rows, current)
    best = current.groupBy("pool").agg(
        F.min_by(F.struct(*_PARAMETERS), F.struct("det", "start")).alias("best")
    )
    best = cut(best.select("pool", "best.*"))
    met = _with(rows.join(best, "pool"), _distance())
    near = met.filter(f"d2 <= {NEAR * CONSISTENT_HALF!r}")
    return cut(_estimate(_sums(near, "pool"), CONSISTENT_NEAR, "pool"))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics of every row, ``base_failed``, ``distance`` (squared) and ``kept``.

    Rows that fail the base rules have no distance and no part in the estimates. Rows of a
    pool too small for estimates are kept. An empty table gives none.
    """
    rows = statistics(docs).withColumn("base_failed", base_rule())
    rows = cut(
        rows.withColumns(
            {x: F.when(~F.col("base_failed"), F.expr(e).cast("long")) for x, e in zip(_X, VECTOR, strict=True)}
        )
    )
    sound = rows.filter(~F.col("base_failed"))
    groups = cut(pools(sound))
    fitted = cut(sound.join(groups, ["lang", "source"]).select("pool", *_X))
    found = groups.join(estimates(fitted), "pool").drop("pool", "n", "det")
    judged = _with(rows.join(cut(found), ["lang", "source"], "left"), _distance())
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))).alias("kept"),
        distance.alias("distance"),
    )
