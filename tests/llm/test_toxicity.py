import random
from collections import Counter

import numpy as np

from cairnflow.llm import toxicity


def exact(field, emission):
    """Marginals by summing over all labellings."""
    n = len(emission)
    total, ones = 0.0, np.zeros(n)
    for k in range(2**n):
        y = [(k >> i) & 1 for i in range(n)]
        w = np.exp(sum(e for e, v in zip(emission, y) if v) + sum(field.transitions[a, b] for a, b in zip(y, y[1:])))
        total += w
        ones += w * np.array(y)
    return ones / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    field = toxicity.Field({}, 0.0, rng.normal(size=(2, 2)))
    emissions = [rng.normal(size=n) * 3 for n in (1, 2, 7, 9)]
    for e in emissions:
        assert np.allclose(field.marginals(e[:, None])[:, 0], exact(field, e))


def test_padding_and_segments_change_nothing():
    rng = np.random.default_rng(1)
    for transitions in (np.array([[0.5, -0.5], [-0.5, 0.0]]), rng.normal(size=(2, 2)), np.zeros((2, 2))):
        field = toxicity.Field({"=bad": 9.0}, -4.0, transitions)
        tagger = toxicity.Tagger(field)
        text = " ".join("bad" if k % 97 == 0 else f"w{k % 13}" for k in range(10_000))
        whole = np.array([tagger.weights[t] for t in text.split()])
        got = tagger.marginals([text, "one bad word", "", None, "ok", "a b bad c d bad bad"])
        assert np.allclose(got[0], field.marginals(whole[:, None])[:, 0], atol=1e-12)
        assert np.allclose(got[5], exact(field, [tagger.weights[t] for t in "a b bad c d bad bad".split()]))
        assert np.allclose(got[1], exact(field, [tagger.weights[t] for t in "one bad word".split()]))
        assert [len(p) for p in got] == [10_000, 3, 0, 0, 1, 7]
        for n, segment in ((7, 3), (9, 3), (8, 4), (5, 1)):
            e = rng.normal(size=n) * 3
            other = rng.normal(size=4) * 3
            got = field.all_marginals([e, other, e[:segment], e], segment)
            assert np.allclose(got[0], exact(field, e)) and np.allclose(got[3], exact(field, e))
            assert np.allclose(got[1], exact(field, other)) and np.allclose(got[2], exact(field, e[:segment]))


def test_calibration_tells_one_strong_word_from_chance():
    p = [np.array([0.99] + [0.01] * 50), np.full(60, 0.01), np.array([0.5] * 6 + [0.01] * 100), np.array([0.5] + [0.01] * 900)]
    x = np.array([toxicity.evidence(q) for q in p * 40])
    y = np.array([1.0, 0.0, 1.0, 0.0] * 40)
    field = toxicity.Field({}, 0.0, np.zeros((2, 2)), toxicity.fit_calibration(x, y))
    assert [field.score(q) > 0.7 for q in p] == [True, False, True, False] and 0 <= field.score(np.zeros(0)) < 0.3
    assert toxicity.fit_calibration(x, np.ones(160)) is None


def test_fitting_learns_labels():
    rng = random.Random(0)
    windows = []
    for _ in range(300):
        w = [f"w{rng.randrange(30)}" for _ in range(9)]
        y = [0] * 9
        if rng.random() < 0.5:
            w[4], y[4] = rng.choice(["vile", "nasty"]), 1
        windows.append((w, y))
    field = toxicity.fit_field(windows)
    p = toxicity.Tagger(field).marginals(["w1 w2 Vile! w3", "w4 w5 unknown"])
    assert p[0][2] > 0.9 and p[0][0] < 0.1 and p[1].max() < 0.3
    assert toxicity.fit_field([]).words == {}


def test_marks_need_support_and_purity():
    toxic, texts = Counter({"=bad": 12, "=rare": 2, "=fine": 9, "b-": 8}), Counter({"=bad": 10, "=rare": 2, "=fine": 9, "b-": 6})
    assert toxicity.toxic_attributes(toxic, Counter({"=fine": 50, "b-": 2}), texts, 100) == {"=bad", "b-"}


def test_emission_sums_all_attributes():
    field = toxicity.Field({"=scum": 3.0, "abcd-": 1.0, "abcdef-": 0.5, "-wxyz": 0.25, "=-": 9.0, "=x-": 4.0}, -1.0, np.zeros((2, 2)))
    for token in ("scum", "Scum!", "abcdefg", "abcdx", "abcd", "vwxyz", "wxyz", "x", "", "-", "abcdefvwxyz", "other", "x-"):
        word = toxicity.word_of(token)
        assert field.emission(token) == -1.0 + sum(field.words.get(a, 0.0) for a in toxicity.attributes_of(word))


def test_words_are_whole():
    """Words that differ after many characters are different ones."""
    a, b = "x" * 80 + "a", "x" * 80 + "b"
    assert set(toxicity.attributes_of(a)) - set(toxicity.attributes_of(b)) and toxicity.word_of(a) == a


def corpus(spark, n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for d in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vile,", "Nasty", "vermin!"])
        rows.append((d, " ".join(w)))
        labels.append((d, 0, int(bad) if rng.random() > 0.03 else 1 - int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(spark):
    docs, labels = corpus(spark)
    field = toxicity.fit(docs, labels)
    tagged = toxicity.tag(docs, field).withColumn("held", toxicity.held_out()).join(labels, "doc_id").where("held").collect()
    right = sum(r.predicted == r.toxic for r in tagged) / len(tagged)
    assert len(tagged) > 80 and right > 0.9
    hit = next(r for r in tagged if r.predicted)
    assert any(hit.text[s.start : s.end].lower().strip(",!").split()[0] in ("vile", "nasty", "vermin") for s in hit.spans)


def test_odd_rows(spark):
    docs, labels = corpus(spark, 60)
    rows = spark.createDataFrame([(None, "vile", "x"), (900, None, None), (901, "", "y"), (901, "", "y"), (902, "w1 " * 20_000, "z")], "doc_id long, text string, score string")
    field = toxicity.Field({"=vile": 9.0}, -4.0, np.zeros((2, 2)))
    out = toxicity.tag(rows, field).collect()
    assert len(out) == 5 and sorted(r.score > 0.7 for r in out) == [False] * 4 + [True]
    assert all(r.spans == [] for r in out if not r.text)
    assert toxicity.tag(rows.limit(0), field).count() == 0
    blank = toxicity.fit(docs.limit(0), labels)
    assert blank.words == {} and all(r.predicted == 0 for r in toxicity.tag(rows, blank).collect())
    nulls = labels.selectExpr("doc_id", "quality", "cast(null as int) toxic")
    assert toxicity.fit(docs, nulls).words == {}
