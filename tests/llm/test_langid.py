import random
import re

import numpy as np

from taproot.llm import langid

SYLLABLES = {"aa": "the and ing tion of er re", "bb": "der die und sch ein ung keit", "cc": "que les de eau oi aux ment"}


def words(lang, n, r):
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(spark, n=400):
    r = random.Random(5)
    rows = [(i, words(g := r.choice(list(SYLLABLES)), r.randint(3, 80), r), g, "x", 1) for i in range(n)]
    rows += [(n, None, "aa", "x", 1), (n + 1, "", "bb", "x", 1), (n + 2, "123 .. ! ½ ²", "cc", "x", 1), (n + 3, "the and of", None, None, None)]
    rows += [(n + 4, words("bb", 60000, r), "bb", "x", 1), rows[0], rows[0]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int")


def test_held_out_accuracy_and_edges(spark):
    rows, docs = corpus(spark)
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    truth = {r[0]: r[2] for r in rows}
    held = [g for g in got if g.held_out and g.lang_pred != "und"]
    assert len(held) > 50 and np.mean([g.lang_pred == truth[g.doc_id] for g in held if truth[g.doc_id]]) > 0.97
    assert all(by[400 + k].lang_pred == "und" and by[400 + k].score == 0 for k in range(3))
    assert by[403].lang_pred == "aa" and by[404].lang_pred == "bb"
    assert all(0 <= g.score <= 1 for g in got)


def test_sparse_weights_and_empty(spark):
    _, docs = corpus(spark, 120)
    model = langid.train(docs)
    assert 0 < len(model.weights) < 1 << 15 and 0.05 < model.temperature < 20
    none = docs.limit(0)
    assert langid.train(none).predict("words") == ("und", 0.0)
    assert langid.identify(none).count() == 0


def test_gradient_descends_and_l1_zeroes():
    r = np.random.default_rng(1)
    rows = [(np.array([k, 5]), np.array([1.0, r.normal()])) for k in r.integers(0, 3, 300)]
    w, _ = langid.fit_ftrl(rows, [int(f[0]) for f, _ in rows], 3, 6, l1=0.5)
    assert all(w[k].argmax() == k for k in range(3)) and not w[3].any()


def test_temperature_recovers_scale():
    r = np.random.default_rng(2)
    z = r.normal(size=(4000, 3)) * 2
    y = np.array([r.choice(3, p=langid.softmax(v)) for v in z])
    assert abs(langid.calibrate(z * 4, y) - 4) < 0.5


def test_rare_language_is_learned(spark):
    r = random.Random(9)
    rows = [(i, words("cc" if i % 250 == 3 else "aa", 60, r), "cc" if i % 250 == 3 else "aa") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, max_rows=60)
    assert model.languages == ["aa", "cc"] and all(model.predict(t)[0] == g for _, t, g in rows)


def test_document_counts_cover_all_rows(spark):
    rows, docs = corpus(spark, 90)
    n, seen = langid.document_counts(docs, 15)
    want = np.zeros(1 << 15, int)
    texts = [x[1] for x in rows if x[1] and langid.has_letter(x[1])]
    for t in texts:
        want[langid.ngram_counts(t)[0]] += 1
    assert n == len(texts) and (seen == want).all()


def test_scores_are_calibrated(spark):
    r = random.Random(17)
    blend = lambda a, b, n: " ".join(words(r.choices([a, b], [3, 2])[0], 1, r) for _ in range(n))
    rows = []
    for i in range(2400):
        a, b = r.sample(list(SYLLABLES), 2)
        rows.append((i, blend(a, b, r.randint(1, 12)), a))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [g for g in langid.identify(docs).collect() if g.held_out]
    p, hit = np.array([g.score for g in got]), np.array([g.lang_pred == rows[g.doc_id][2] for g in got])
    gaps = [abs(p[m].mean() - hit[m].mean()) * m.mean() for lo in np.arange(0, 1, 0.1) if (m := (p > lo) & (p <= lo + 0.1)).any()]
    assert len(got) > 400 and 0.5 < hit.mean() < 0.9 and sum(gaps) < 0.08


def test_temperature_stays_off_its_bounds_where_all_is_told_apart():
    z = np.eye(3)[np.arange(600) % 3] * 0.5
    t = langid.calibrate(z, np.arange(600) % 3)
    p = langid.softmax(z[0] / t).max()
    assert np.exp(-4.9) < t and 0.99 < p < 0.9985


def test_prediction_against_brute_force(spark):
    rows, docs = corpus(spark, 80)
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    for g, (_, text, *_) in zip(got, rows):
        if not text or not any(c.isalpha() for c in text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        spaced = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        s = re.sub(" +", " ", spaced)
        counts = {}
        for n in (1, 2, 3):
            for k in range(len(s) - n + 1):
                h = 0
                for c, mix in zip(s[k : k + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
                    h = ((h ^ ord(c)) * mix) % 2**32
                    h ^= h >> 15
                b = (h * 0x9E3779B1 % 2**32) >> 17
                counts[b] = counts.get(b, 0) + 1
        x = {b: np.log1p(c) * float(model.idf[b]) for b, c in counts.items()}
        size = sum(v * v for v in x.values()) ** 0.5
        z = model.bias.astype(float) + sum((model.weights[model.rows[b]].astype(float) * v / size for b, v in x.items()), np.zeros(len(model.bias)))
        p = langid.softmax(z / model.temperature)
        assert g.lang_pred == model.languages[int(p.argmax())] and abs(g.score - p.max()) < 1e-4
