import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from cairnflow.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Model.read(PATH)


def brute(model, word):
    """Best segmentation of a word on its own, by trying every cut."""
    best = {0: (0.0, [])}
    for i in range(1, len(word) + 1):
        options = []
        for j in range(i):
            part = word[j:i]
            if part in model.known:
                score, k = model.known[part]
                options.append((best[j][0] + score, -j, best[j][1] + [k]))
            elif j == i - 1:
                options.append((best[j][0] + model.unknown, -j, best[j][1] + [model.bytes[b] for b in part.encode()]))
        top = max(options, key=lambda o: (o[0], o[1]))
        best[i] = (top[0], top[2])
    return best[len(word)][1]


def test_shared_prefixes_change_nothing(model):
    rng = random.Random(3)
    words = sorted({"▁" + "".join(rng.choice("abcdest漢é1.") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"▁", "▁▁▁", "\n"})
    assert [(w, ids) for w, ids in pieces.viterbi(model, words)] == [(w, brute(model, w)) for w in words]


def test_against_the_library(model):
    """The library's lattice search on the same pieces with the model type set to unigram gives equal scores."""
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2", exc_type=ImportError)
    m = proto.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for text in ("the", "hello world", "Erthenin enestion"):
        own = [k for w, ids in ((w, brute(model, w)) for w in model.words(text)) for k in ids]
        score = lambda ids: sum(model.scores[k] for k in ids)
        assert score(own) == score(lib.nbest_encode(text, nbest_size=2)[0])


def test_round_trip_and_odd_rows(spark):
    long = "lang " * 50_000
    texts = [None, "", " ", "  two  blanks ", "line\nbreak\t\x00", "漢字 😀 é", long, "x" * 5000, "same", "same"]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = pieces.encode(df, PATH)
    rows = {r.doc_id: r for r in pieces.decode(coded, PATH).collect()}
    assert all(rows[k].decoded == t for k, t in enumerate(texts))
    assert {r.doc_id: r.decoded for r in pieces.encode(df, PATH, decoded=True).collect()} == {k: r.decoded for k, r in rows.items()}
    assert rows[0].ids is None and rows[1].ids == [] and rows[8].ids == rows[9].ids
    assert pieces.encode(df.limit(0), PATH).count() == 0


def test_cache_generations():
    e = pieces.PieceEncoder(PATH, cache_words=3)
    first = e.encode(["a b c d e", "b c"])
    assert e.encode(["a b c d e", "b c"]) == first and e.encode(["z y", "a b c d e"])[1] == first[0]
