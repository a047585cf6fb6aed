"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code point. A trigram's vector binds its letters' vectors, each permuted by its
place (rotated by 2, 1 and 0), by multiplication; a text's vector bundles (sums) those of its trigrams; a language's
prototype bundles the unit vectors of its training texts. A text gets the language whose prototype has the largest
cosine with it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import append, bounded_sample, tidied

DIMENSIONS = 1024
TRAINING_ROWS = 20_000  #: prototypes are fitted on at most so many rows, chosen by a hash of doc_id
UNKNOWN = "und"
SHARPNESS = 20.0
_SCALE = 1_000_000  # prototypes are summed in whole numbers, so that the order of rows changes nothing


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), dtype=bool, count=0x110000)


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The vector of each code point (0: the word boundary), made of its hash alone: +1 and -1, [points, dimensions]."""
    blocks = np.arange(-(-dimensions // 64), dtype=np.uint64)
    x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + blocks * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(unit vector of each text, whether it has a letter)."""
    letter = _is_letter()
    keys, has = [], np.zeros(len(texts), dtype=bool)
    for k, text in enumerate(texts):
        if not text:
            continue
        s = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        s = np.concatenate([[0], np.where(letter[s], s, 0), [0]])
        s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]  # one boundary for a run of others
        has[k] = s.any()
        if has[k]:
            codes, counts = np.unique((s[:-2].astype(np.int64) << 42) | (s[1:-1] << 21) | s[2:], return_counts=True)
            keys.append((k, codes, counts))
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    if keys:
        codes, place = np.unique(np.concatenate([c for _, c, _ in keys]), return_inverse=True)
        table = np.zeros((len(texts), len(codes)), dtype=np.float32)
        at = 0
        for k, own, counts in keys:
            table[k, place[at : at + len(own)]] = counts
            at += len(own)
        for first in range(0, len(codes), 2048):
            c = codes[first : first + 2048]
            points, spots = np.unique(np.concatenate([c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF]), return_inverse=True)
            vectors, spots = letter_vectors(points, dimensions), spots.reshape(3, -1)
            bound = np.roll(vectors, 2, axis=1)[spots[0]] * np.roll(vectors, 1, axis=1)[spots[1]] * vectors[spots[2]]
            out += table[:, first : first + 2048] @ bound.astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), has


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, dimensions: int = DIMENSIONS, training_rows: int = TRAINING_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from rows with a lang that are not held out; at most ``training_rows`` of them."""
    rows = bounded_sample(docs.where(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", "text"), "doc_id", training_rows)

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                unit, has = text_vectors(part.column(2).to_pylist(), dimensions)
                whole = np.rint(unit * _SCALE).astype(np.int64)
                for lang, v, ok in zip(part.column(1).to_pylist(), whole, has):
                    if ok:
                        total[lang] = total.get(lang, 0) + v
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[n].tolist() for n in names], pa.list_(pa.int64()))], names=["lang", "v"])

    summed = rows.mapInArrow(tidied(bundle), "lang string, v array<long>").select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    found: dict[str, np.ndarray] = {}
    for lang, pos, v in summed.collect():  # languages x dimensions rows
        found.setdefault(lang, np.zeros(dimensions))[pos] = v
    names = sorted(found)
    prototypes = np.array([found[n] / (np.linalg.norm(found[n]) or 1) for n in names]).reshape(len(names), dimensions)
    return names, prototypes.astype(np.float32)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """``docs`` with lang_pred, score (a softmax of the cosines) and cosine.

    A null text or one without any letter gets ``und`` and score 0, as does every text if nothing was learned. Ties
    go to the language first in order. Repeated rows get equal results.
    """

    def make():
        def call(texts):
            unit, has = text_vectors(texts, prototypes.shape[1])
            if not names:
                return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            cosines = (unit @ prototypes.T).astype(float)
            best = cosines.argmax(axis=1)
            odds = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
            score = np.where(has, 1 / odds.sum(axis=1), 0.0)
            return [names[k] if ok else UNKNOWN for k, ok in zip(best, has)], score.tolist(), np.where(has, cosines.max(axis=1), 0.0).tolist()

        return call

    return append(docs, "lang_pred string, score double, cosine double", make, rows=256)
