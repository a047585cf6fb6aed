"""Packing documents into windows of 2048 tokens by the sum-of-squares rule.

Each document is turned into token ids and, cut where it is longer than a window, placed online: a piece of size s
goes to the fill level h (an open window with h tokens, or a new one) for which the sum over all levels of the
squared number of partially filled windows becomes smallest. The counts live in one array indexed by level. What
is still open at the end of a task is settled without padding: windows at a power of two stay as they are (such
sequences are not padded), the pieces of the others are cut again into full windows, and the rest into powers of two.

Every task packs what it reads, so there is no shuffle; sequence ids are (partition, counter). Memory is bounded by
the open windows (beyond ``max_open`` the fullest is filled from the emptiest) and by the cache of encoded words (``cache_words``).
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, tidied

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: What makes a word other than plain: then the tokenizer sees it whole.
_NOT_PLAIN = re.compile("[^\t\n\r\x20-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]|startoftext|endoftext")
#: The split pattern and the normalizers of the vocabularies whose texts fall apart as below. Texts of any
#: other vocabulary are given to the tokenizer whole.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The parts into which such a vocabulary splits a plain text: words, single digits, and runs of punctuation.
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \t\n\r]+")


class Known(dict):
    """What ``find`` gives for a key, kept."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.find(key)
        return found


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    A vocabulary with ``_SPLIT`` drops white space and never merges across it, nor across the parts of a plain word, so
    a text's ids are those of its words one after the other, and a plain word's those of its parts, each of which the
    vocabulary's model gets alone; with another one each text is a single word. Words repeat, and each is encoded once
    while it stays in the cache, which has two generations of ``cache_words``: what is not used in one is dropped.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), cache_words
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        split, *then = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normalizers = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        self.falls_apart = split.get("pattern", {}).get("Regex") == _SPLIT and split.get("invert") is True and normalizers == _NORMALIZERS and then == [_BYTES]
        in_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.in_bytes = {c: in_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.cache, self.older = Known(self.find), {}

    def words(self, text: str) -> list[str]:
        """The text cut at plain blanks; between two of them there is an empty word."""
        if not self.falls_apart:
            return [text]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:  # these letters have one small form each, wherever they stand
            small = text.lower()
            if "oftext" not in small:  # the special tokens are told by their case
                text = small
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def find(self, word: str) -> bytes:
        """The ids of a word that is not in the cache."""
        if (known := self.older.get(word)) is not None:
            return known
        if not self.falls_apart or _NOT_PLAIN.search(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        parts = _PARTS.findall(word.lower())
        if parts != [word]:
            return b"".join(map(self.cache.__getitem__, parts))
        if not word.isascii():
            word = word.translate(self.in_bytes)
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if len(self.cache) > self.most:
                self.cache, self.older = Known(self.find), self.cache
            yield b"".join(map(self.cache.__getitem__, self.words(text)))


def encoder(path: str, cache_words: int) -> Encoder:
    """One for each Python worker, whose tasks share its cache."""
    return kept(("encoder", path, cache_words), lambda: Encoder(path, cache_words))


class SumOfSquares:
    """Places pieces (doc_id, start, id bytes, doc_tokens) in windows; ``close`` gets each finished window's pieces."""

    def __init__(self, close: Callable[[list], None], window: int = WINDOW, max_open: int = 1024):
        self.close, self.window, self.max_open = close, window, max_open
        self.counts = np.zeros(window + 1, dtype=np.int64)  # the level array: open windows by fill
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def level(self, size: int) -> int:
        """The fill level (0: a new window) whose choice leaves the smallest sum of squared counts; ties: the fullest."""
        last = self.window - size
        counts = self.counts
        cost = 2 * counts[size : self.window + 1] + 1  # what comes to level h + size, for h = 0 .. last
        cost[last] = 0  # a full window is no longer partially filled
        cost[1:] -= 2 * counts[1 : last + 1] - 1
        cost[1:][counts[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(cost[::-1]))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.close([(doc_id, at, ids[4 * at : 4 * (at + self.window)], total)])
            at += self.window
        if at < total:
            self.place((doc_id, at, ids[4 * at :], total))

    def place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        h = self.level(size)
        if h:
            held = self.open[h].pop()
            self.counts[h] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if h + size == self.window:
            self.close(held)
        else:
            self.open[h + size].append(held)
            self.counts[h + size] += 1
            self.n_open += 1
            while self.n_open > self.max_open:
                self.fill_fullest()

    def fill_fullest(self) -> None:
        """Close the fullest open window with what the emptiest one holds, cut as needed: nothing is padded."""
        high, low = (next(h for h in order if self.open[h]) for order in (range(self.window, 0, -1), range(1, self.window + 1)))
        held = self.open[high].pop()
        other = self.open[low].pop()
        self.counts[high] -= 1
        self.counts[low] -= 1
        self.n_open -= 2
        room = self.window - high
        while room and other:
            doc_id, start, ids, total = other.pop()
            n = min(room, len(ids) // 4)
            held.append((doc_id, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                other.append((doc_id, start + n, ids[4 * n :], total))
            room -= n
        for pieces in (held, other):
            fill = sum(len(x[2]) for x in pieces) // 4
            if fill == self.window:
                self.close(pieces)
            elif fill:
                self.open[fill].append(pieces)
                self.counts[fill] += 1
                self.n_open += 1

    def settle(self) -> None:
        """Close all open windows: nothing is padded."""
        loose: list[tuple] = []
        for h, windows in enumerate(self.open):
            for held in windows:
                if h & (h - 1):
                    loose += held
                else:
                    self.close(held)
            windows.clear()
        self.counts[:] = 0
        self.n_open = 0
        left = sum(len(x[2]) for x in loose) // 4
        sizes = [self.window] * (left // self.window) + [1 << b for b in range(self.window.bit_length(), -1, -1) if (left % self.window) >> b & 1]
        pieces, held = iter(loose), []
        rest: tuple | None = None
        for room in sizes:
            held = []
            while room:
                doc_id, start, ids, total = rest or next(pieces)
                n = min(room, len(ids) // 4)
                held.append((doc_id, start, ids[: 4 * n], total))
                rest = (doc_id, start + n, ids[4 * n :], total) if 4 * n < len(ids) else None
                room -= n
            self.close(held)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, max_open: int = 1024, cache_words: int = 400_000) -> DataFrame:
    """Pieces of all documents (doc_id, text): see ``SCHEMA``.

    A null text counts as empty: its document is the end id alone. Null or repeated doc_ids are packed like others,
    row by row. An empty table gives no rows; other columns are ignored. ``docs`` should be a scan (or checkpointed):
    a task that runs again then reads the same rows and gives the same sequences.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, out = encoder(tokenizer_path, cache_words), []
        number = TaskContext.get().partitionId() << 32
        end = struct.pack("<I", end_id)
        schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

        def close(pieces: list) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                out.append((doc_id, start, n, zlib.crc32(ids), total, number, offset))
                offset += n
            number += 1

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
            out.clear()
            return made

        packer = SumOfSquares(close, window, max_open)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(texts)):
                    packer.add(doc_id, ids + end)
                if len(out) > 10_000:
                    yield batch()
        packer.settle()
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), SCHEMA)
