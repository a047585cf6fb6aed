"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

White space is marked and texts are cut into marked words, across which no piece of the vocabulary reaches. The distinct
words of a batch are sorted: neighbours then share their prefixes as in a trie walked depth-first, and the forward scores
of a common prefix are kept from one word to the next. Each word's best segmentation is the one with the highest sum
of piece scores; characters without a piece fall back to bytes.

The model file is read as it is. Where it holds a vocabulary of the merge kind, its scores are the negative ranks of
the merges: the result is then the best segmentation under these scores, which is not always that of the merges.
"""

from __future__ import annotations

import re
import struct
from array import array
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .shared import append, kept

MARK = "▁"
# Fixed values of the model format: piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack_from("<f" if kind == 5 else "<d", data, at)[0]
            at += size


@dataclass
class Model:
    """Pieces, scores and the few settings of a model file that this encoder knows."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    dummy_prefix: bool = True
    known: dict[str, tuple[float, int]] = field(default_factory=dict)
    blob: tuple | None = None

    @classmethod
    def read(cls, path: str) -> Model:
        pieces, scores, types, prefix = [], [], [], True
        with open(path, "rb") as file:
            data = file.read()
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1].decode())
                scores.append(one.get(2, 0.0))
                types.append(one.get(3, NORMAL))
            elif number == 3:
                settings = dict(_fields(value))
                if settings.get(2) or settings.get(4, 1):
                    raise ValueError("only models without normalisation of texts are supported")
                prefix = bool(settings.get(3, 1))
        return cls(pieces, scores, types, prefix)

    def __post_init__(self) -> None:
        self.known = {p: (s, k) for k, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types)) if t in (NORMAL, USER_DEFINED)}
        self.longest = max(map(len, self.known), default=1)
        self.unknown = min((s for p, (s, k) in self.known.items() if self.types[k] == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        found = {self.pieces[k]: k for k, t in enumerate(self.types) if t == BYTE}
        self.bytes = [found[f"<0x{b:02X}>"] for b in range(256)] if found else None
        if any(MARK in p.lstrip(MARK) for p in self.known):
            raise ValueError("a piece reaches over the start of a word")
        # characters that no piece holds end a word as well
        cut = "" if any("\n" in p for p in self.known) else "\n"
        self.word = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + f"|{cut}" * bool(cut))
        #: neighbours within some piece: between others no piece reaches
        self.joined = {(a, b) for p in self.known for a, b in zip(p, p[1:])}
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.encode() for p, t in zip(self.pieces, self.types)]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return self.word.findall(MARK + marked if self.dummy_prefix else marked)

    def segments(self, word: str) -> list[str]:
        """Parts of a word over whose ends no piece reaches: searched one by one, they give the word's best pieces."""
        joined, out, start = self.joined, [], 0
        for k, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in joined:
                out.append(word[start:k])
                start = k
        out.append(word[start:])
        return out

    def decode(self, ids) -> str:
        """The text of ids (a list, or an array of int32)."""
        import numpy as np

        if self.blob is None:
            size = np.array([len(r) for r in self.raw], dtype=np.int64)
            self.blob = np.frombuffer(b"".join(self.raw), dtype=np.uint8), np.cumsum(size) - size, size
        blob, start, size = self.blob
        ids = np.asarray(ids, dtype=np.int64)
        n = size[ids]
        ends = np.cumsum(n)
        place = np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        text = blob[place].tobytes().decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def viterbi(model: Model, words: list[str]):
    """(word, ids) for sorted ``words``: forward scores of the prefix shared with the word before are reused."""
    known, longest, unknown = model.known, model.longest, model.unknown
    best: list[float] = [0.0]  # of each prefix of the current word
    start: list[int] = [0]
    piece: list[int] = [-1]
    last = ""
    for word in words:
        n, same = len(word), 0
        most = min(len(last), n)
        while same < most and last[same] == word[same]:
            same += 1
        del best[same + 1 :], start[same + 1 :], piece[same + 1 :]
        for i in range(same + 1, n + 1):
            top, at, what = -1e30, i - 1, -1
            for j in range(i - longest if i > longest else 0, i):
                found = known.get(word[j:i])
                if found is not None:
                    score = best[j] + found[0]
                    if score > top:
                        top, at, what = score, j, found[1]
                elif j == i - 1:
                    score = best[j] + unknown
                    if score > top:
                        top, at, what = score, j, -1
            best.append(top)
            start.append(at)
            piece.append(what)
        ids: list[int] = []
        i = n
        while i:
            j = start[i]
            if piece[i] >= 0:
                ids.append(piece[i])
            elif model.bytes is None:
                ids.append(model.unknown_id)
            else:
                ids += [model.bytes[b] for b in reversed(word[j:i].encode("utf-8", "replace"))]
            i = j
        last = word
        yield word, ids[::-1]


class Generations:
    """A cache of two generations: what isn't used in one is dropped."""

    def __init__(self, most: int):
        self.most, self.now, self.older = most, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.most:
            self.now, self.older = {}, self.now

    def missing(self, keys) -> list:
        """Keys in neither generation; those of the older one are taken over."""
        fresh = []
        for key in set(keys).difference(self.now):
            if (value := self.older.get(key)) is not None:
                self.now[key] = value
            else:
                fresh.append(key)
        return fresh


class PieceEncoder:
    """Ids of texts as packed 32-bit numbers; words and their segments are searched once while they stay in the cache."""

    def __init__(self, path: str, cache_words: int = 500_000):
        self.model = Model.read(path)
        self.words, self.parts = Generations(cache_words), Generations(cache_words // 2)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.model.words(t or "") for t in texts]
        self.words.turn()
        self.parts.turn()
        fresh = self.words.missing(set().union(*split))
        cut = [self.model.segments(word) for word in fresh]
        for part, ids in viterbi(self.model, sorted(self.parts.missing(set().union(*cut)))):
            self.parts.now[part] = array("i", ids).tobytes()
        get = self.parts.now.__getitem__
        for word, parts in zip(fresh, cut):
            self.words.now[word] = get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts))
        get = self.words.now.__getitem__
        return [b"".join(map(get, words)) for words in split]


def encoder(path: str, cache_words: int) -> PieceEncoder:
    """One for each Python worker, whose tasks share its cache."""
    return kept(("pieces", path, cache_words), lambda: PieceEncoder(path, cache_words))


def encode(docs: DataFrame, model_path: str, cache_words: int = 500_000, decoded: bool = False) -> DataFrame:
    """``docs`` with ids (array<int>) of column text and, with ``decoded``, the text that they decode to.

    A null text has null ids, an empty one none. The mark itself in a text reads as a blank. Texts of any length are
    encoded whole; repeated rows get equal ids; columns named like a new one are replaced. An empty table gives no rows.
    """

    def make():
        import numpy as np
        import pyarrow as pa

        words = encoder(model_path, cache_words)

        def call(texts):
            found = words.encode(texts)
            ends = np.cumsum([0, *(len(b) // 4 for b in found)])
            flat = pa.array(np.frombuffer(b"".join(found), dtype=np.int32))
            none = pa.array([t is None for t in texts])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=none)
            if not decoded:
                return [ids]
            return ids, [None if t is None else words.model.decode(np.frombuffer(b, dtype=np.int32)) for t, b in zip(texts, found)]

        return call

    return append(docs, "ids array<int>" + ", decoded string" * decoded, make)


def decode(coded: DataFrame, model_path: str, column: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids in ``column``; null ids give null."""

    def make():
        model = encoder(model_path, 500_000).model

        def call(rows):
            flat, ends = rows.values.to_numpy(), rows.offsets.to_numpy()
            return [[model.decode(flat[a:z]) if ok else None for a, z, ok in zip(ends, ends[1:], rows.is_valid().to_pylist())]]

        return call

    return append(coded, f"{column} string", make, text="ids", as_arrow=True)
