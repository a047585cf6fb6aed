"""Toxic spans by a linear-chain conditional random field over tokens.

The chain has two states (clean, toxic), weights for what a token looks like (the word, its beginnings and
endings) and weights for the transitions. Only documents carry labels, so tokens get theirs from those: attributes that
tokens of toxic documents have often, and nearly only those (near copies counted once), mark the toxic tokens. The field
is fitted on the whole texts of the labelled rows, cut into windows; windows that look the same to it count several
times. Forward-backward marginals of every token of a text aggregate to its score by a logistic calibration on the same
labelled rows, and runs of tokens with a marginal of at least one half give the offending offsets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import append, bounded_sample, forget, tidied, written

TRAINING_ROWS = 12_000  #: the field is fitted on at most so many labelled rows, chosen by a hash of doc_id
THRESHOLD = 0.7
PURITY = 0.7  #: an attribute marks toxic tokens if at least this share of the tokens that have it is in toxic texts
WINDOW = 16  #: tokens of a training window
SEGMENT = 256  #: longer texts run in parts side by side, each with the messages of those before and after it
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—"
_TOKEN = re.compile(r"\S+")


def word_of(token: str) -> str:
    return token.lower().strip(_EDGES)


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) + 1


def attributes_of(word: str) -> list[str]:
    """What the field sees of a word: itself, beginnings of 4 to 8 and endings of 4 to 6 characters."""
    if not word:
        return []
    n = len(word)
    return [f"={word}", *(f"{word[:k]}-" for k in range(4, min(9, n))), *(f"-{word[-k:]}" for k in range(4, min(7, n)))]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Field:
    """Weights of a two-state chain: emission (toxic against clean) by attribute, bias, and log transition weights.

    ``calibration``: weights of ``evidence``; without one a text's score is its largest marginal.
    """

    words: dict[str, float]
    bias: float
    transitions: np.ndarray
    calibration: np.ndarray | None = None

    @cached_property
    def _starts(self) -> tuple[frozenset[str], frozenset[str]]:
        """First and last four characters of the beginnings and endings with a weight: most words have neither."""
        return frozenset(a[:4] for a in self.words if a[0] != "=" and a[-1] == "-" and len(a) > 4), frozenset(a[-4:] for a in self.words if a[0] == "-")

    def emission(self, token: str) -> float:
        word = word_of(token)
        begin, end = self._starts
        if word[:4] in begin or word[-4:] in end:
            get = self.words.get
            return self.bias + sum(get(a, 0.0) for a in attributes_of(word))
        return self.bias + self.words.get(f"={word}", 0.0)

    def marginals(self, emission: np.ndarray, lengths: np.ndarray | None = None, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) for each token: ``emission`` is [steps, texts], each as long as ``lengths`` says.

        With two states only the ratio of the scaled forward (and backward) values matters. ``entry``: that of the
        token before the first (nan: there is none); ``leave``: the backward ratio at the last.
        """
        t = np.exp(self.transitions)
        odds = np.exp(np.clip(emission, -50, 50))
        ahead = np.empty_like(odds)
        r = odds[0]
        if entry is not None:
            r = np.where(np.isnan(entry), r, r * (t[0, 1] + entry * t[1, 1]) / (t[0, 0] + entry * t[1, 0]))
        ahead[0] = r
        for k in range(1, len(odds)):
            r = odds[k] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
            ahead[k] = r
        q = last = np.ones(odds.shape[1]) if leave is None else leave
        inside = np.full(odds.shape[1], len(odds)) if lengths is None else lengths
        shortest = inside.min() if len(inside) else 0
        ahead[-1] *= q
        for k in range(len(odds) - 2, -1, -1):
            x = odds[k + 1] * q
            q = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
            if k + 1 >= shortest:
                q = np.where(k + 1 < inside, q, last)
            ahead[k] *= q
        return ahead / (1 + ahead)

    def _products(self, odds: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> list[list[float]]:
        """The 2 x 2 product of each segment's steps, row by row: from the state before it to that of its last token.
        Of a text's first segment, which has no state before it, the first row is the forward message at its end."""
        t = np.exp(self.transitions)
        x = np.array([np.ones(len(lengths)), np.zeros(len(lengths))])  # [from clean, from toxic] to clean
        y = np.array([np.zeros(len(lengths)), np.ones(len(lengths))])  # the same to toxic
        for k in range(len(odds)):
            clean, toxic = x * t[0, 0] + y * t[1, 0], (x * t[0, 1] + y * t[1, 1]) * odds[k]
            if k == 0:
                clean[:, first], toxic[:, first] = 1.0, odds[0, first]
            if k % 8 == 7:
                scale = 1 / (clean + toxic).sum(axis=0)
                clean, toxic = clean * scale, toxic * scale
            on = k < lengths
            x, y = (clean, toxic) if on.all() else (np.where(on, clean, x), np.where(on, toxic, y))
        scale = 1 / (x + y).sum(axis=0)
        return np.array([x[0], y[0], x[1], y[1]] * scale).T.tolist()

    def all_marginals(self, emissions: list[np.ndarray], segment: int = SEGMENT) -> list[np.ndarray]:
        """The marginals of texts of any length (none empty), cut into segments that run side by side.

        Each segment's 2 x 2 product is taken first; a text's products, one after the other, give the forward message
        that enters each of its segments and the backward message at its end, as if it had not been cut.
        """
        parts = [(k, at, min(at + segment, len(e))) for k, e in enumerate(emissions) for at in range(0, len(e), segment)]
        lengths = np.array([b - a for _, a, b in parts])
        grid = np.zeros((lengths.max(), len(parts)))
        for c, (k, a, b) in enumerate(parts):
            grid[: b - a, c] = emissions[k][a:b]
        entry, leave = np.full(len(parts), np.nan), np.ones(len(parts))
        cut = np.array([len(emissions[k]) > segment for k, _, _ in parts])
        if cut.any():
            at = np.nonzero(cut)[0]
            products = self._products(np.exp(np.clip(grid[:, at], -50, 50)), lengths[at], np.array([parts[c][1] == 0 for c in at]))
            clean = toxic = 1.0
            for c, (cc, ct, tc, tt) in zip(at, products):
                if parts[c][1]:
                    entry[c] = toxic / clean
                    clean, toxic = clean * cc + toxic * tc, clean * ct + toxic * tt
                else:
                    clean, toxic = cc, ct
                clean, toxic = clean / (clean + toxic), toxic / (clean + toxic)
            for c, (cc, ct, tc, tt) in zip(at[::-1], products[::-1]):
                if parts[c][2] == len(emissions[parts[c][0]]):
                    clean = toxic = 1.0
                leave[c] = toxic / clean
                clean, toxic = cc * clean + ct * toxic, tc * clean + tt * toxic
                clean, toxic = clean / (clean + toxic), toxic / (clean + toxic)
        p = self.marginals(grid, lengths, entry, leave)
        out = [np.empty(len(e)) for e in emissions]
        for c, (k, a, b) in enumerate(parts):
            out[k][a:b] = p[: b - a, c]
        return out

    def score(self, p: np.ndarray) -> float:
        """A text's score from its marginals."""
        if self.calibration is None:
            return float(p.max()) if len(p) else 0.0
        return float(1 / (1 + np.exp(-np.clip(evidence(p) @ self.calibration, -30, 30))))


def evidence(p: np.ndarray) -> np.ndarray:
    """What the calibration sees of a text: one, the largest marginal, how many toxic tokens are expected, how many
    for each thousand, and how often it was a strong one."""
    if not len(p):
        p = np.zeros(1)
    top, total = min(max(float(p.max()), 1e-5), 1 - 1e-5), float(p[p > 0.02].sum())
    return np.array([1.0, np.log(top / (1 - top)) / 4, np.log1p(total), np.log1p(1000 * total / (len(p) + 20)) / 4, np.log1p(float((p >= 0.5).sum()))])


def fit_calibration(features: np.ndarray, labels: np.ndarray, decay: float = 1e-3, steps: int = 60) -> np.ndarray | None:
    """Logistic regression by Newton steps; None where there is one kind of label only."""
    if len(set(labels.tolist())) < 2:
        return None
    theta, ridge = np.zeros(features.shape[1]), decay * len(labels) * np.diag([0.0] + [1.0] * (features.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        slope = features.T @ (labels - p) - ridge @ theta
        curve = (features * (p * (1 - p))[:, None]).T @ features + ridge + 1e-6 * np.eye(len(theta))
        move = np.linalg.solve(curve, slope)
        theta = theta + move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-8:
            break
    return theta


def fit_field(windows: list[tuple[list[str], list[int]]], counts: list[int] | None = None, known: frozenset[str] | None = None, epochs: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Adam on the log likelihood of labelled windows (words, labels): observed less expected features.

    ``counts``: how often each window occurs. ``known``: the attributes that get weights; all by default.
    """
    seen = {w: [a for a in attributes_of(w) if known is None or a in known] for w in {w for words, _ in windows for w in words}}
    vocabulary = {x: k for k, x in enumerate(sorted({x for found in seen.values() for x in found}))}
    size, steps = len(vocabulary), max((len(w) for w, _ in windows), default=0)
    if not steps:
        return Field({}, -6.0, np.zeros((2, 2)))
    deep = max((len(found) for found in seen.values()), default=0) or 1
    ids = np.full((deep, steps, len(windows)), size)  # the last id stands for no attribute
    gold = np.zeros((steps, len(windows)))
    mask = np.zeros((steps, len(windows)))
    share = np.ones(len(windows)) if counts is None else np.array(counts, dtype=float)
    for k, (words, labels) in enumerate(windows):
        for s, w in enumerate(words):
            ids[: len(seen[w]), s, k] = [vocabulary[x] for x in seen[w]]
        gold[: len(words), k] = labels
        mask[: len(words), k] = 1
    both = mask[1:] * mask[:-1] * share
    observed_pairs = np.array([[((1 - gold[:-1]) * (1 - gold[1:]) * both).sum(), ((1 - gold[:-1]) * gold[1:] * both).sum()], [(gold[:-1] * (1 - gold[1:]) * both).sum(), (gold[:-1] * gold[1:] * both).sum()]])
    theta = np.zeros(size + 1 + 4)  # words, bias, transitions
    theta[size] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n, whole = len(windows), share.sum()
    for epoch in range(1, epochs + 1):
        weights = np.append(theta[:size], 0.0)
        odds = np.exp(np.clip(np.where(mask > 0, weights[ids].sum(axis=0) + theta[size], 0.0), -50, 50)) * (mask > 0)
        t = np.exp(theta[size + 1 :].reshape(2, 2))
        ahead = np.empty((2, steps, n))
        z = 1 + odds[0]
        ahead[:, 0] = 1 / z, odds[0] / z
        for k in range(1, steps):
            a0 = ahead[0, k - 1] * t[0, 0] + ahead[1, k - 1] * t[1, 0]
            a1 = (ahead[0, k - 1] * t[0, 1] + ahead[1, k - 1] * t[1, 1]) * odds[k]
            ahead[0, k], ahead[1, k] = a0 / (a0 + a1), a1 / (a0 + a1)
        back = np.ones((2, steps, n))
        for k in range(steps - 2, -1, -1):
            b0 = t[0, 0] * back[0, k + 1] + t[0, 1] * odds[k + 1] * back[1, k + 1]
            b1 = t[1, 0] * back[0, k + 1] + t[1, 1] * odds[k + 1] * back[1, k + 1]
            on = mask[k + 1] > 0
            back[0, k], back[1, k] = np.where(on, b0 / (b0 + b1), 1.0), np.where(on, b1 / (b0 + b1), 1.0)
        p = ahead[1] * back[1] / (ahead[0] * back[0] + ahead[1] * back[1]) * mask
        pairs = np.empty((2, 2, steps - 1, n))
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] = ahead[i, :-1] * t[i, j] * (odds[1:] if j else 1.0) * back[j, 1:]
        expected_pairs = (pairs / pairs.sum(axis=(0, 1)) * both).sum(axis=(2, 3))
        residual = (gold - p) * mask * share
        slope = np.concatenate([np.bincount(ids.ravel(), np.broadcast_to(residual, ids.shape).ravel(), size + 1)[:size], [residual.sum()], (observed_pairs - expected_pairs).ravel()]) / whole - decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    words = {w: float(theta[k]) for w, k in vocabulary.items() if abs(theta[k]) > 0.05}
    return Field(words, float(theta[size]), theta[size + 1 :].reshape(2, 2))


def toxic_attributes(toxic: Counter, clean: Counter, texts: Counter, n_toxic: int, share: float = 0.01) -> frozenset[str]:
    """Attributes that mark toxic tokens: at least five toxic texts and ``share`` of all of these have it, and ``PURITY``
    of the tokens with it (``toxic`` and ``clean`` count different words of a text) are in toxic texts."""
    least = max(5.0, share * n_toxic)
    return frozenset(a for a, c in texts.items() if c >= least and toxic[a] >= PURITY * (toxic[a] + clean[a] + 1))


def _text_class(words: list[str]) -> int:
    """The same for near copies, mostly: the least hash of three words in a row."""
    codes = [hash_of(w) for w in words] or [0]
    h = np.array([*codes, 0, 0], dtype=np.uint64)
    return int((h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[2:] * np.uint64(0x165667B19E3779F9)).min() >> np.uint64(1))


def fit(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> Field:
    """The field from labelled documents that are not held out; at most ``training_rows`` of them, their whole texts.

    Null labels and documents without text are left out. Without any toxic rows nothing is learned and every score
    is small.
    """
    spark = docs.sparkSession
    known = bounded_sample(labels.where(F.col("toxic").isNotNull() & ~held_out()).select(F.col("doc_id").alias("id"), "toxic"), "id", training_rows)
    known = spark.createDataFrame(known.dropDuplicates(["id"]).toArrow(), known.schema)  # at most training_rows small rows
    texts = docs.join(F.broadcast(known), F.col("doc_id") == F.col("id")).where("text is not null").select("text", F.col("toxic").cast("int").alias("toxic")).distinct()

    def classed(batches):
        for b in batches:
            classes = [_text_class([word_of(t) for t in text.split()]) for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(classes, pa.int64())], names=["text", "toxic", "class"])

    # near copies side by side
    by_class = texts.mapInArrow(tidied(classed), "text string, toxic int, class long").repartition(spark.sparkContext.defaultParallelism, "class").sortWithinPartitions("class")
    sample = written(by_class, "labelled")

    def attributes(batches, only=None):
        """(attribute, n: how many words of a text have it, texts: how many have it), of near copies the most."""
        cache: dict[str, list[str]] = {}

        def of(word: str) -> list[str]:
            got = cache.get(word)
            if got is None:
                got = [a for a in attributes_of(word) if only is None or a in only]
                if len(word) <= 64 and len(cache) < 200_000:
                    cache[word] = got
            return got

        total: Counter = Counter()
        texts: Counter = Counter()
        held: Counter = Counter()
        last = None

        def close() -> None:
            total.update(held)
            texts.update(held.keys())

        for b in batches:
            for text, number in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if number != last:
                    close()
                    held, last = Counter(), number
                held |= Counter(a for w in {word_of(t) for t in text.split()} for a in of(w))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64()), pa.array([texts[a] for a in total], pa.int64())], names=["attribute", "n", "texts"])

    def counted(label: int, run, least: int) -> list:
        each = sample.where(F.col("toxic") == label).select("text", "class").mapInArrow(tidied(run), "attribute string, n long, texts long")
        return each.groupBy("attribute").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).where(F.col("texts") >= least).collect()

    # at most what the training rows hold; attributes of fewer than five toxic texts mark nothing
    mine = counted(1, attributes, 5)
    candidates = frozenset(r.attribute for r in mine)
    clean = Counter({r.attribute: r.n for r in counted(0, lambda batches: attributes(batches, candidates), 1)})
    n_toxic = sample.where("toxic = 1").count()
    marks = toxic_attributes(Counter({r.attribute: r.n for r in mine}), clean, Counter({r.attribute: r.texts for r in mine}), n_toxic)

    def windows(batches):
        """Every text in windows; words without a mark are all the same, and so are most windows."""
        found: Counter = Counter()
        cache: dict[str, str] = {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = []
                for t in text.split():
                    w = cache.get(t)
                    if w is None:
                        w = word_of(t)
                        w = w if any(a in marks for a in attributes_of(w)) else ""
                        if len(t) <= 64 and len(cache) < 300_000:
                            cache[t] = w
                    words.append(w)
                for k in range(0, len(words), WINDOW):
                    part = words[k : k + WINDOW]
                    found["\n".join(part) + ("\t1" if label == 1 and any(part) else "\t0")] += 1
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["window", "n"])

    rows = sample.select("text", "toxic").mapInArrow(tidied(windows), "window string, n long").groupBy("window").agg(F.sum("n").alias("n")).collect()  # the training rows' text at most
    cut = []
    for r in sorted(rows, key=lambda r: r.window):
        text, _, label = r.window.rpartition("\t")
        words = text.split("\n")
        cut.append((words, [int(label == "1" and w != "") for w in words], r.n))
    field = fit_field([(w, y) for w, y, _ in cut], [n for _, _, n in cut], marks) if marks else Field({}, -6.0, np.zeros((2, 2)))

    def seen(batches):
        tagger = Tagger(field)
        for b in batches:
            rows = [evidence(p).tolist() for p in tagger.marginals(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "evidence"])

    found = sample.select("text", "toxic").mapInArrow(tidied(seen), "toxic int, evidence array<double>").collect()  # at most training_rows
    forget(spark, sample)
    found = sorted((r.toxic, *r.evidence) for r in found)
    if marks and found:
        field.calibration = fit_calibration(np.array([f[1:] for f in found]), np.array([float(f[0] == 1) for f in found]))
    return field


class Tagger:
    """Applies a field to texts; emissions are looked up once per distinct token while they stay in the cache."""

    def __init__(self, field: Field, cache_words: int = 300_000):
        self.field, self.most = field, cache_words

        class Weights(dict):
            def __missing__(self, token: str) -> float:
                value = field.emission(token)
                if len(token) <= 64:
                    self[token] = value
                return value

        self.weights = Weights()

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """Marginals of each text's tokens (``str.split``)."""
        if len(self.weights) > self.most:
            self.weights.clear()
        get = self.weights.__getitem__
        emissions = [np.array([*map(get, text.split())]) if text else np.zeros(0) for text in texts]
        out = [np.zeros(len(e)) for e in emissions]
        like: dict[int, list[int]] = {}
        for k, e in enumerate(emissions):
            if len(e):
                like.setdefault(min(len(e) - 1, SEGMENT).bit_length(), []).append(k)
        for rows in like.values():
            some, size = [], 0
            for n, k in enumerate(rows, 1):
                some.append(k)
                size += len(emissions[k])
                if size > 1_000_000 or n == len(rows):
                    for j, p in zip(some, self.field.all_marginals([emissions[j] for j in some])):
                        out[j] = p
                    some, size = [], 0
        return out

    def spans(self, text: str, p: np.ndarray) -> list[dict]:
        """Runs of tokens with a marginal of at least one half, as character offsets."""
        found: list[dict] = []
        last = -2
        for k, token in enumerate(_TOKEN.finditer(text)):
            if p[k] >= 0.5:
                if k == last + 1:
                    found[-1] |= {"end": token.end(), "score": max(found[-1]["score"], float(p[k]))}
                else:
                    found.append({"start": token.start(), "end": token.end(), "score": float(p[k])})
                last = k
        return found


def tag(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted (1 if score >= threshold) and spans (start, end, score in characters).

    A null or empty text has the score of a text without any toxic token, and no spans. Texts of any length are tagged whole. Repeated rows get equal
    results.
    """

    def make():
        tagger = Tagger(field)

        def call(texts):
            marginals = tagger.marginals(texts)
            scores = [field.score(p) for p in marginals]
            spans = [tagger.spans(t, p) if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, marginals)]
            return scores, [int(s >= threshold) for s in scores], spans

        return call

    return append(docs, "score double, predicted int, spans array<struct<start:long, end:long, score:double>>", make, rows=512)
