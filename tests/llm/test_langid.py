import random

import numpy as np

from cairnflow.llm import langid

SYLLABLES = {"aa": ["the", "ing", "wh", "tion", "ou"], "bb": ["sch", "ein", "ich", "ung", "ä"], "cc": ["eau", "oi", "ç", "é", "que"]}


def corpus(spark, n=300):
    rng = random.Random(7)
    rows = []
    for d in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((d, text, lang if rng.random() > 0.1 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_held_out_documents(spark):
    docs = corpus(spark)
    names, prototypes = langid.fit(docs)
    assert names == ["aa", "bb", "cc"]
    found = langid.identify(docs, names, prototypes).withColumn("held", langid.held_out()).where("held").collect()
    assert len(found) > 40 and sum(r.lang_pred == r.truth for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_bound_on_training_rows(spark):
    docs = corpus(spark)
    names, prototypes = langid.fit(docs, training_rows=60)
    found = langid.identify(docs, names, prototypes).collect()
    assert sum(r.lang_pred == r.truth for r in found) / len(found) > 0.95
    again = langid.fit(docs.repartition(5), training_rows=60)
    assert (again[1] == prototypes).all()


def test_odd_rows(spark):
    names, prototypes = langid.fit(corpus(spark))
    rows = [(None, "theing", "x"), (1, None, "y"), (2, "", None), (3, "123 !?", "z"), (3, "123 !?", "z"), (4, "the " * 50_000, "w"), (5, "漢字かな", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.identify(df, names, prototypes).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0.0
    assert by[None].lang_pred == "aa" == by[4].lang_pred and by[5].lang_pred in names
    assert langid.identify(df.limit(0), names, prototypes).count() == 0
    none = langid.fit(corpus(spark).limit(0))
    assert none[0] == [] and {r.lang_pred for r in langid.identify(df, *none).collect()} == {"und"}


def brute_vector(text, dimensions):
    """Trigram by trigram, letter by letter."""
    total, has = np.zeros(dimensions), False
    letters = [0]
    for c in text.lower():
        if c.isalpha():
            letters.append(ord(c))
            has = True
        elif letters[-1]:
            letters.append(0)
    if letters[-1]:
        letters.append(0)
    one = lambda point: langid.letter_vectors(np.array([point]), dimensions)[0].astype(int)
    for x, y, z in zip(letters, letters[1:], letters[2:]):
        total += np.roll(one(x), 2) * np.roll(one(y), 1) * one(z)
    return total / (np.linalg.norm(total) or 1), has


def test_against_brute_force(spark):
    """Every training text's vector, the prototypes and each document's language, by plain loops."""
    docs = corpus(spark, 60)
    names, prototypes = langid.fit(docs, dimensions=256)
    rows = langid.identify(docs, names, prototypes).withColumn("held", langid.held_out()).collect()
    sums = {n: np.zeros(256) for n in names}
    for r in rows:
        if r.lang is not None and not r.held:
            sums[r.lang] += brute_vector(r.text, 256)[0]
    for k, n in enumerate(names):
        assert np.allclose(prototypes[k], sums[n] / np.linalg.norm(sums[n]), atol=1e-4)
    for r in rows:
        cosines = {n: float(brute_vector(r.text, 256)[0] @ sums[n] / np.linalg.norm(sums[n])) for n in names}
        assert abs(max(cosines.values()) - r.cosine) < 1e-4
        if sorted(cosines.values())[-1] - sorted(cosines.values())[-2] > 1e-3:
            assert r.lang_pred == max(cosines, key=cosines.get)


def test_every_letter_has_its_own_vector():
    points = np.arange(0x4E00, 0x4E00 + 2000)
    assert len(np.unique(langid.letter_vectors(points, 1024), axis=0)) == 2000
    v = langid.letter_vectors(points, 1024).astype(int)
    assert abs((v @ v.T - 1024 * np.eye(2000, dtype=int))).max() < 260 and abs(v.mean()) < 0.01
    assert langid.letter_vectors(points, 100).shape == (2000, 100)
