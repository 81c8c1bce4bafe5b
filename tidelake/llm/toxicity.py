"""Toxicity of whole texts by a bidirectional gated recurrent network, trained in numpy.

Each word is a vector of its word embedding, the mean embedding of its character trigrams
and five-grams, and how much likelier it and its likeliest such gram are in toxic training
texts. The network reads windows that overlap
by a third, in both directions; attention pools its states into one logit. A text scores as
its most toxic window, through a logistic scale fitted to whole training texts.

Training takes a bounded sample of labelled rows, by hash of the id: at most ``CLEAN_ROWS``
and ``TOXIC_ROWS``, whole texts, of ``TRAIN_BYTES`` together. It runs in one task of an
executor, which returns the weights. Scoring reads everything.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelake.llm.blocks import Words, hash_windows, hash_words, mix
from tidelake.llm.lm import remainder
from tidelake.llm.workers import forget

CLEAN_ROWS, TOXIC_ROWS, TRAIN_BYTES = 1800, 600, 32 << 20
WINDOW, STRIDE = 48, 32
#: Bytes of a word that is read as one, and of the pieces of a longer one.
LONG, PIECE = 64, 32
#: Marks, and spaces that are not white space in ASCII, part the words of a longer one.
_MARKS = re.compile(
    rb"(?:[\x00-&(-/:-@\[-`{-\x7f]|\xc2\xa0|\xe2\x80[\x80-\x8b]|\xe3\x80[\x80-\x82])+"
)
WORD_DIM, CHAR_DIM, HIDDEN, VOCABULARY = 8, 8, 8, 20_000
#: Places for trigrams and for five-grams, as bits.
THREE, FIVE = 12, 15
CHAR_TABLE, INPUT = (1 << THREE) + (1 << FIVE), WORD_DIM + CHAR_DIM + 2
THRESHOLD, HELD_OUT, FOLDS = 0.7, 1, 3
_BATCH = 2048
#: Texts whose grams are counted at a time.
_TEXTS = 64
_TEXT = 4 << 20


@dataclass
class Model:
    """Weights, the sorted hashes of known words, and the scale from logit to score."""

    weights: dict[str, np.ndarray]
    words: np.ndarray
    scale: tuple[float, float]


# ---------------------------------------------------------------- inputs


def _in_pieces(words: Words) -> tuple[Words, np.ndarray]:
    """Words and their hashes, where a word over ``LONG`` bytes is several.

    Such a word may be a whole document, where white space does not part words. What stands
    between ASCII marks or wide spaces in it are words; after them come pieces of all of it,
    marks too, that overlap by half, so that nothing is left out.
    """
    starts, ends = words.starts, words.ends
    long = np.flatnonzero(ends - starts > LONG)
    if not len(long):
        return words, hash_words(words)
    count, inner, pieces = np.ones(len(starts), np.int64), [], []
    for i in long:
        begin, end = int(starts[i]), int(ends[i])
        marks = [(begin, begin), *(m.span() for m in _MARKS.finditer(words.data, begin, end)), (end, end)]
        gaps = np.array([(a, b) for (_, a), (b, _) in zip(marks, marks[1:], strict=False)], np.int64)
        sizes = gaps[:, 1] - gaps[:, 0]
        inner.append(gaps[(sizes > 0) & (sizes <= LONG)])
        from_ = np.arange(begin, end - PIECE // 2, PIECE // 2)
        pieces.append(np.stack([from_, np.minimum(from_ + PIECE, end)], axis=1))
        count[i] = len(inner[-1]) + len(pieces[-1])
    first = np.append(0, np.cumsum(count))
    plain = np.ones(len(starts), bool)
    plain[long] = False
    spans = np.empty((int(first[-1]), 2), np.int64)
    spans[first[:-1][plain]] = np.stack([starts[plain], ends[plain]], axis=1)
    piece = np.zeros(len(spans), bool)
    for i, own, cut in zip(long, inner, pieces, strict=True):
        spans[first[i] : first[i + 1]] = np.concatenate([own, cut])
        piece[first[i] + len(own) : first[i + 1]] = True
    hashes = np.empty(len(spans), np.uint64)
    for some in (~piece, piece):  # each in the order of the text
        words.starts, words.ends = spans[some].T
        hashes[some] = hash_words(words)
    words.starts, words.ends = spans.T
    words.first = first[words.first]
    return words, hashes


class _Inputs:
    """The distinct words of some texts and the windows over them."""

    def __init__(self, texts: list[str | None]):
        words = Words([t.encode() if t else None for t in texts], lower=True)
        words, hashes = _in_pieces(words)
        self.hashes, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self.grams, gram_of = self._trigrams(words, at)
        n = len(self.hashes)
        # Where the grams of each word begin; padding, the last, has none.
        self.gram_first = np.append(0, np.cumsum(np.bincount(gram_of, minlength=n + 1)))
        counts = words.counts()
        # A padding word stands after the last; an empty text is one window of padding.
        self.ids = np.append(inverse, n).astype(np.int32)
        self.padding = n
        windows = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
        self.doc = np.repeat(np.arange(len(counts)), windows)
        number = np.arange(len(self.doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        last = np.maximum(counts - WINDOW, 0)[self.doc]
        self.begin = words.first[:-1][self.doc] + np.minimum(number * STRIDE, last)
        self.end = words.first[1:][self.doc]
        self.counts, self.first = counts, words.first

    @staticmethod
    def _trigrams(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table places of the byte trigrams, edges marked, and five-grams of each word."""
        starts, ends = words.starts[at], words.ends[at]
        sizes = ends - starts
        owner = np.repeat(np.arange(len(at)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        here = starts[owner] + place
        buffer = words.buffer.astype(np.uint32)
        left = np.where(place == 0, 1, buffer[here - 1])
        right = np.where(place == sizes[owner] - 1, 2, buffer[np.minimum(here + 1, len(buffer) - 1)])
        code = (left * 65536 + buffer[here] * 256 + right).astype(np.uint32) * np.uint32(2654435761)
        three = (code >> np.uint32(32 - THREE)).astype(np.int32)
        at5 = np.flatnonzero(place + 5 <= sizes[owner])
        code = np.zeros(len(at5), np.uint32)
        for i in range(5):
            code = (code ^ buffer[here[at5] + i]) * np.uint32(16777619)
        five = (1 << THREE) + ((code * np.uint32(2654435761)) >> np.uint32(32 - FIVE)).astype(np.int32)
        grams, owner = np.append(three, five), np.append(owner, owner[at5]).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        return grams[order], owner[order]

    def windows(self, some: np.ndarray | slice) -> np.ndarray:
        """Word numbers of windows, one row each."""
        at = self.begin[some, None] + np.arange(WINDOW)
        return self.ids[np.where(at < self.end[some, None], at, len(self.ids) - 1)]


def _vectors(inputs: _Inputs, model_words: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    """Input vector of each distinct word, padding last; and its place among known words."""
    known = np.zeros(len(inputs.hashes), np.int64)
    if len(model_words):
        at = np.minimum(np.searchsorted(model_words, inputs.hashes), len(model_words) - 1)
        known = np.where(model_words[at] == inputs.hashes, at + 1, 0)
    n = len(inputs.hashes)
    x = np.zeros((n + 1, INPUT), np.float32)
    x[:n, :WORD_DIM] = w["word"][known]
    if n:
        begin, sizes = inputs.gram_first[:n], np.diff(inputs.gram_first[: n + 1])
        sums = np.add.reduceat(w["char"][inputs.grams], begin, axis=0)
        x[:n, WORD_DIM:-2] = sums / sizes[:, None]
        x[:n, -2] = np.maximum.reduceat(w["gram_odds"][inputs.grams], begin)
    x[:n, -1] = w["odds"][known]
    return x, known


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _run(w: dict, projected: np.ndarray, ids: np.ndarray, real: np.ndarray, keep: bool):
    """Logit of every window; with ``keep`` also all that going back needs."""
    n, steps, h3 = len(ids), ids.shape[1], 3 * HIDDEN
    states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    kept: list = [[], []]
    for way in (0, 1):
        inner, table = w["inner"][way], projected[:, way * h3 : way * h3 + h3]
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            x, y = table[ids[:, t]], h @ inner
            gates = _sigmoid(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
            after = (new + z * (h - new)) * real[:, t, None]
            if keep:
                kept[way].append((t, h, z, r, new, y[:, 2 * HIDDEN :]))
            h = after
            states[t, :, way * HIDDEN : (way + 1) * HIDDEN] = h
    heat = np.tanh(states @ w["attend"])
    raw = heat @ w["attend_to"] + np.where(real.T, 0, -1e4)
    share = np.exp(raw - raw.max(axis=0))
    share /= share.sum(axis=0)
    pooled = (share[:, :, None] * states).sum(axis=0)
    logit = pooled @ w["out"] + w["bias"][0]
    return logit, (states, kept, heat, share, pooled)


def _back(w: dict, projected, ids, real, trace, slope) -> tuple[dict, np.ndarray]:
    """Gradients of the network's weights and of the projected inputs."""
    states, kept, heat, share, pooled = trace
    g = {"out": pooled.T @ slope, "bias": np.array([slope.sum()], np.float32)}
    d_pooled = slope[:, None] * w["out"]
    d_share = (states * d_pooled).sum(axis=2)
    d_states = share[:, :, None] * d_pooled
    d_raw = share * (d_share - (share * d_share).sum(axis=0))
    g["attend_to"] = (heat * d_raw[:, :, None]).sum(axis=(0, 1))
    d_heat = d_raw[:, :, None] * w["attend_to"] * (1 - heat**2)
    g["attend"] = np.einsum("tni,tnj->ij", states, d_heat)
    d_states = d_states + d_heat @ w["attend"].T
    d_projected = np.zeros_like(projected)
    g["inner"] = np.zeros_like(w["inner"])
    for way in (0, 1):
        inner, d_h = w["inner"][way], np.zeros((len(ids), HIDDEN), np.float32)
        for t, h, z, r, new, y_new in reversed(kept[way]):
            d = (d_states[t, :, way * HIDDEN : (way + 1) * HIDDEN] + d_h) * real[:, t, None]
            d_new = d * (1 - z) * (1 - new**2)
            d_z, d_r = d * (h - new) * z * (1 - z), d_new * y_new * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=1)
            d_y = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g["inner"][way] += h.T @ d_y
            d_h = d * z + d_y @ inner.T
            np.add.at(d_projected[:, way * 3 * HIDDEN : (way + 1) * 3 * HIDDEN], ids[:, t], d_x)
    return g, d_projected


def _logits(w: dict, words: np.ndarray, inputs: _Inputs) -> np.ndarray:
    """Logit of every window."""
    x, _ = _vectors(inputs, words, w)
    projected = x @ w["enter"] + w["enter_bias"]
    out = np.empty(len(inputs.doc), np.float32)
    for lo in range(0, len(out), _BATCH):
        some = slice(lo, lo + _BATCH)
        ids = inputs.windows(some)
        out[some] = _run(w, projected, ids, ids != inputs.padding, keep=False)[0]
    return out


def _most(logits: np.ndarray, inputs: _Inputs) -> np.ndarray:
    """The highest logit of each text."""
    return np.maximum.reduceat(logits, np.searchsorted(inputs.doc, np.arange(len(inputs.counts))))


# ---------------------------------------------------------------- training


def _start(
    rng: np.random.Generator, known: int, odds: np.ndarray, gram_odds: np.ndarray
) -> dict[str, np.ndarray]:

    def some(*shape: int, scale: float = 0.2) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return {
        "word": some(known + 1, WORD_DIM, scale=0.05),
        "char": some(CHAR_TABLE, CHAR_DIM, scale=0.05),
        "odds": odds.astype(np.float32),
        "gram_odds": gram_odds.astype(np.float32),
        "enter": some(INPUT, 6 * HIDDEN),
        "enter_bias": np.zeros(6 * HIDDEN, np.float32),
        "inner": some(2, HIDDEN, 3 * HIDDEN),
        "attend": some(2 * HIDDEN, HIDDEN),
        "attend_to": some(HIDDEN),
        "out": some(2 * HIDDEN),
        "bias": np.zeros(1, np.float32),
    }


def _apart(texts: list[str]) -> np.ndarray:
    """Places of texts without near copies of earlier ones: these share two MinHash values."""
    words = Words([t.encode() for t in texts], lower=True)
    at, doc = words.spans(5)
    windows = hash_windows(hash_words(words), at, 5)
    kept = np.ones(len(texts), bool)
    if len(at):
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        least = [np.minimum.reduceat(mix(windows + np.uint64(s)), begin) for s in range(4)]
        for a, b in (least[:2], least[2:]):
            again = np.ones(len(begin), bool)
            again[np.unique(mix(a) ^ b, return_index=True)[1]] = False
            kept[doc[begin[again]]] = False
    return np.flatnonzero(kept)


class _Odds:
    """In how many texts each kind occurs, and the log odds of a toxic text with it."""

    def __init__(self, toxic: np.ndarray, size: int):
        self.toxic, self.counts = toxic, np.zeros((2, size), np.int64)

    def add(self, kind: np.ndarray, doc: np.ndarray) -> None:
        """Count kinds in texts that were not added before."""
        size = self.counts.shape[1]
        pairs = np.unique(doc * size + kind)
        mark, kind = self.toxic[pairs // size], pairs % size
        for i in (0, 1):
            self.counts[i] += np.bincount(kind[mark == i], minlength=size)

    def ratio(self) -> np.ndarray:
        n = [(~self.toxic).sum(), self.toxic.sum()]
        no, yes = (np.log((self.counts[i] + 0.5) / (n[i] + 1)) for i in (0, 1))
        return np.clip(yes - no, -3, 3)


def _vocabulary(inputs: _Inputs, toxic: np.ndarray):
    """Words of five texts or more with their log odds, and the log odds of all grams.

    Some texts at a time, as a text has many more grams than bytes.
    """
    n, texts = max(1, len(inputs.hashes)), len(inputs.counts)
    words, grams = _Odds(toxic, n), _Odds(toxic, CHAR_TABLE)
    for lo in range(0, texts, _TEXTS):
        hi = min(lo + _TEXTS, texts)
        doc = np.repeat(np.arange(lo, hi), inputs.counts[lo:hi])
        word = inputs.ids[inputs.first[lo] : inputs.first[hi]].astype(np.int64)
        words.add(word, doc)
        pairs = np.unique(doc * n + word)
        found, row, _ = _grams_of(inputs, pairs % n)
        grams.add(found, (pairs // n)[row])
    held, ratio = words.counts.sum(axis=0), words.ratio()
    often = np.argsort(-held, kind="stable")[:VOCABULARY]
    often = np.sort(often[held[often] >= 5])
    gram_ratio = grams.ratio()
    gram_ratio[grams.counts.sum(axis=0) < 5] = 0
    return inputs.hashes[often], np.append(0.0, ratio[often]), gram_ratio


def fit(texts: list[str], toxic: np.ndarray, epochs: int = 6, seed: int = 7) -> Model | None:
    """Train on labelled texts; None where a label has no text.

    A text is as toxic as its worst window, so each epoch learns from the windows that the
    network finds worst now, of either label, and from some others of clean texts.
    """
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    rng = np.random.default_rng(seed)
    kept = _apart(texts)
    # A text without words is clean.
    texts, toxic = [*(texts[i] for i in kept), ""], np.append(toxic[kept], False)
    if not toxic.any() or not (~toxic[:-1]).any():
        return None
    inputs = _Inputs(texts)
    words, odds, gram_odds = _vocabulary(inputs, toxic)
    w = _start(rng, len(words), odds, gram_odds)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    window_toxic = toxic[inputs.doc]
    # Every fourth text only helps to fit the scale, if that leaves enough to learn from.
    judged = (np.arange(len(texts)) % 4 == 3) & (toxic.sum() >= 100)
    learned = ~judged[inputs.doc]
    top_odds = np.zeros(len(inputs.doc))
    vectors, known = _vectors(inputs, words, w)
    known, likely = np.append(known, 0), vectors[:, -2:].max(axis=1)
    for lo in range(0, len(top_odds), _BATCH):
        some = slice(lo, lo + _BATCH)
        top_odds[some] = likely[inputs.windows(some)].max(axis=1)
    heat = top_odds  # before the first epoch, by the likeliest word
    epoch = 0
    while epoch < epochs or step < 150:
        epoch += 1
        order = np.lexsort((-heat, inputs.doc))
        rank = np.empty(len(order), np.int64)
        begin = np.searchsorted(inputs.doc, inputs.doc)
        rank[order] = np.arange(len(order)) - begin
        chosen = np.flatnonzero(learned & ((rank == 0) | (~window_toxic & (rank == 1))))
        clean = np.flatnonzero(learned & ~window_toxic)
        chosen = np.append(chosen, rng.choice(clean, min(len(clean), len(chosen))))
        rng.shuffle(chosen)
        for lo in range(0, len(chosen), 128):
            some = chosen[lo : lo + 128]
            ids = inputs.windows(some)
            here, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            real = ids != inputs.padding
            x_all, known_all = _some_vectors(inputs, here, known, w)
            projected = x_all @ w["enter"] + w["enter_bias"]
            logit, trace = _run(w, projected, local, real, keep=True)
            goal = window_toxic[some].astype(np.float32)
            slope = (_sigmoid(logit) - goal) * np.where(goal > 0, 2.0, 1.0) / len(some)
            g, d_projected = _back(w, projected, local, real, trace, slope.astype(np.float32))
            g["enter"] = x_all.T @ d_projected
            g["enter_bias"] = d_projected.sum(axis=0)
            d_x = d_projected @ w["enter"].T
            g["word"] = np.zeros_like(w["word"])
            np.add.at(g["word"], known_all, d_x[:, :WORD_DIM])
            g["word"][0] = 0
            g["char"] = np.zeros_like(w["char"])
            grams, row, sizes = _grams_of(inputs, here)
            np.add.at(g["char"], grams, (d_x[:, WORD_DIM:-2] / np.maximum(sizes, 1)[:, None])[row])
            step += 1
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v**2
                rate = 0.02 / (1 - 0.9**step)
                decay = 1 - 0.01 * (k in ("word", "char"))
                w[k] = (decay * w[k] - rate * first[k] / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        heat = _logits(w, words, inputs)
    if not judged.any():
        judged[:] = True
    return Model(w, words, _scale(_most(heat, inputs)[judged], toxic[judged]))


def _grams_of(inputs: _Inputs, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram places of some distinct words, the row each belongs to, and how many."""
    begin, end = (inputs.gram_first[here + i] for i in (0, 1))
    sizes = end - begin
    row = np.repeat(np.arange(len(here)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return inputs.grams[begin[row] + within], row, sizes


def _some_vectors(inputs: _Inputs, here: np.ndarray, known: np.ndarray, w: dict):
    """Input vectors of some distinct words."""
    x = np.zeros((len(here), INPUT), np.float32)
    x[:, :WORD_DIM], x[:, -1] = w["word"][known[here]], w["odds"][known[here]]
    grams, row, sizes = _grams_of(inputs, here)
    np.add.at(x[:, WORD_DIM:-2], row, w["char"][grams])
    x[:, WORD_DIM:-2] /= np.maximum(sizes, 1)[:, None]
    x[:, -2] = -9
    np.maximum.at(x[:, -2], row, w["gram_odds"][grams])
    x[here == inputs.padding] = 0
    return x, known[here]


def _scale(logits: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from a text's worst window to its label."""
    x, y = logits.astype(float), toxic.astype(float)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * x + b)
        v = p * (1 - p) + 1e-6
        # A weak pull to (1, 0) keeps the curve finite when the labels separate.
        grad = np.array([((p - y) * x).sum() + 0.5 * (a - 1), (p - y).sum() + 0.5 * b])
        hess = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 0.5]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


# ---------------------------------------------------------------- on Spark


def train(
    docs: DataFrame, labels: DataFrame, clean: int = CLEAN_ROWS, toxic: int = TOXIC_ROWS
) -> Model | None:
    """Fit to at most ``clean`` and ``toxic`` rows of the labels, never to held-out ids.

    Rows with a null id, a null or other label, or no text are no training rows; of
    repeated labels of an id the highest counts, of its texts the first in order. Texts that
    would take the sample beyond ``TRAIN_BYTES`` are left out whole. None where a label has
    no text.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter("doc_id is not null and toxic in (0, 1)")
        .filter(remainder("doc_id", FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    picked = None
    for label, most in ((0, clean), (1, toxic)):
        some = marked.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # ``picked`` has ``clean + toxic`` rows at most; an id that has several texts teaches one.
    sample = (
        texts.filter("text is not null")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size = [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))
            for row in zip(*columns, strict=True):
                if size + len(row[1].encode()) <= TRAIN_BYTES:
                    size += len(row[1].encode())
                    held.append(row)
        held.sort()
        marks = np.array([mark == 1 for _, _, mark in held], bool)
        model = pickle.dumps(fit([text for _, text, _ in held], marks))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    alone = sample.repartition(1).sortWithinPartitions(order, "doc_id")
    made = alone.mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else None


def scores(model: Model | None, texts: list[str | None]) -> np.ndarray:
    """Score of each whole text, in pieces of bounded size unless one text is longer."""
    out = np.zeros(len(texts))
    if model is None:
        return out
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _TEXT or i == len(texts) - 1:
            inputs = _Inputs(texts[begin : i + 1])
            worst = _most(_logits(model.weights, model.words, inputs), inputs)
            out[begin : i + 1] = _sigmoid(model.scale[0] * worst + model.scale[1])
            begin, size = i + 1, 0
    return out


def score(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """All columns of ``docs`` and a score from 0 to 1; only ``text`` is read for it.

    Null and empty texts score as a text without words. Without a model, for want of
    labels, every score is 0. Repeated rows score alike. A column named ``column`` is
    replaced.
    """
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = scores(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, column]
            )

    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(run, schema)
