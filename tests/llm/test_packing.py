import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from cairnflow.llm import packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_is_the_tokenizer(tokenizer):
    rng = random.Random(12)
    odd = [" ", "\n", "\x1c", "\x85", "\xa0", " ", "a", "B", "the", "'s", "'", ",", "%%", "é", "É", "ß", "µ", "ª", "ÿ", "e", "́", "ΑΣ", "İ", "漢", "1", "23", "?!", "<|endoftext|>", "<|", "endoftext", "|>", "_", "-", "²", "×"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(0, 10))) for _ in range(4000)] + ["", " ", "word " * 3000]
    e = packing.Encoder(PATH, cache_words=100)
    got = [np.frombuffer(b, "<u4").tolist() for k in range(0, len(texts), 200) for b in e.encode(texts[k : k + 200])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(13)
    s = packing.SumOfSquares(lambda x: None, window=64)
    for _ in range(400):
        size = rng.randrange(1, 64)

        def after(h):
            c = s.counts.copy()
            if h:
                c[h] -= 1
            if h + size < 64:
                c[h + size] += 1
            return int((c[:64] ** 2).sum())

        options = [h for h in range(64 - size + 1) if h == 0 or s.counts[h]]
        assert after(s.level(size)) == min(map(after, options))
        s.place((0, 0, b"\0" * 4 * size, size))


def check(tokenizer, docs, rows, window=packing.WINDOW):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    for doc_id, text in docs.items():
        ids, at = ids_of(tokenizer, text), 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            part = np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(ids)
    assert set(by_doc) == set(docs)
    return padding / max(total, 1)


def test_contract(spark, tokenizer):
    rng = random.Random(14)
    docs = {d: " ".join(rng.choice(["alpha", "Beta,", "gamma.", "delta"]) for _ in range(rng.choice([1, 20, 300, 900, 5000]))) for d in range(120)}
    docs |= {500: None, 501: "", 502: "漢字 " * 3000}
    df = spark.createDataFrame([(d, t, 7) for d, t in docs.items()], "doc_id long, text string, length int").repartition(3)
    assert check(tokenizer, docs, packing.pack(df, PATH).collect()) == 0
    assert check(tokenizer, docs, packing.pack(df, PATH, max_open=3).collect()) == 0


def test_too_many_open_windows():
    """The fullest window is filled up and closed; the others stay open, and no id is lost."""
    rng, closed = random.Random(16), []
    s = packing.SumOfSquares(closed.append, window=64, max_open=4)
    put = {}
    for d in range(500):
        n = rng.randrange(1, 150)
        put[d] = np.arange(n, dtype="<u4").tobytes()
        s.add(d, put[d])
        assert s.n_open <= 4 and s.n_open == s.counts.sum() == sum(map(len, s.open))
        assert all(sum(len(x[2]) for x in w) == 4 * h for h, ws in enumerate(s.open) for w in ws)
    assert all(sum(len(x[2]) for x in w) == 256 for w in closed)
    s.settle()
    got = {d: b"".join(x[2] for x in sorted((x for w in closed for x in w if x[0] == d), key=lambda x: x[1])) for d in put}
    assert got == put


def test_another_vocabulary_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = tokenizers.Tokenizer.from_file(path)
    texts = ["Two  words,\n and\tmore's 123", "", "Ünï 漢字 don't"]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.Encoder(path).encode(texts)]
    assert got == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    rows = packing.pack(df, PATH).collect()
    assert sum(r.length for r in rows) == 6 and sum(r.doc_id is None for r in rows) >= 1
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_plain_words_go_to_the_model_once(tokenizer):
    """The tokenizer sees only words that are not plain; the parts of all others are encoded once, however texts repeat them."""

    class Told:
        def __init__(self, of):
            self.of, self.seen = of, []

        def __getattr__(self, name):
            return lambda x, **more: (self.seen.extend([x] if isinstance(x, str) else x), getattr(self.of, name)(x, **more))[1]

    plain = ["Über den Wolken, 12 mal!\n\tüber ... wolken.", "ÀÿÖß %% a-b_c (d) e.g. e.g.", "MAL mal, den\r\nDEN", "", "  "]
    texts = plain + ["it's ² µm a\x85b\xa0c \x1c d×e", "<|endoftext|> UPPER <|endoftext|>X", "<|ENDOFTEXT|> <|", "ŒUVRE 漢 Mal, ΑΣ"]
    e = packing.Encoder(PATH)
    e.tokenizer, e.model = Told(e.tokenizer), Told(e.tokenizer.model)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(plain)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in plain]
    assert e.tokenizer.seen == [] and len(e.model.seen) == len(set(e.model.seen)) and "wolken" in e.model.seen
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert "it's" in e.tokenizer.seen and "mal" not in e.tokenizer.seen
    one = packing.Encoder(PATH)  # every part of a plain word, byte by byte
    letters = [chr(c) * k + chr(d) for c in [*range(0x21, 0x7F), *range(0xC0, 0x100)] for d in (0x61, 0xE9, 0x2E, 0x37) for k in (1, 2)]
    assert [np.frombuffer(b, "<u4").tolist() for b in one.encode(letters)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in letters]
