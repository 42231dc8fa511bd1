import numpy as np

from taproot.llm import licences

PLAIN = ["words of no licence at all, only prose", "Le chat est sur la table et la porte est ouverte.", "Der Hund und die Katze sind im Garten, nicht im Haus."]


def rows():
    out, i = [], 0
    for family, texts in licences.TEMPLATES.items():
        for t in texts:
            out.append((i, f"{PLAIN[i % 3]}\n{t}\n{PLAIN[0]}", family))
            i += 1
    for p in [*PLAIN, *licences.DECOYS[:3], "", None, "\n\n\r\n", "word " * 60000]:
        out.append((i, p, None))
        i += 1
    return out


def brute(model, text):
    for i, p in enumerate(__import__("re").split("\r\n|[\r\n]", text or "")):
        g = licences.grams(p)
        z = np.array(model.bias) + sum((np.array(model.weights[x]) for x in g if x in model.weights), np.zeros(len(model.bias)))
        q = licences.softmax(z / model.temperature)[:-1]
        if q.max() >= model.threshold:
            family = model.families[int(q.argmax())]
            like = max(len(set(t) & set(g)) / min(len(t), len(g)) for t in model.templates[family]) if g else 0
            yield i, family, round(float(q.max()), 4), like >= 0.5


def test_scan_against_brute_force_and_truth(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in data], "doc_id long, text string, family string, paragraph int")
    model = licences.train(docs)
    got = licences.scan(docs, model).collect()
    want = {(i, *b) for i, t, _ in data for b in brute(model, t)}
    assert {(r.doc_id, r.paragraph, r.family, round(r.score, 4), r.confirmed) for r in got} == want
    truth = {i: f for i, _, f in data}
    found = {r.doc_id: r.family for r in got if r.confirmed}
    right = [found.get(i) == f for i, f in truth.items() if f]
    assert np.mean(right) > 0.95
    assert not [i for i in found if truth[i] is None]
    assert licences.scan(docs.limit(0), model).count() == 0


def test_held_out_accuracy():
    model = licences.train()
    rows = licences.examples(PLAIN, seed=99)
    hit = 0
    for f, t in rows:
        got = next((x[1] for x in brute(model, t)), licences.UNKNOWN)
        hit += got == f
    assert hit / len(rows) > 0.95


def test_telling_words_are_necessary():
    model = licences.train()
    words = set(licences.telling(model))
    assert words
    for f, t in licences.examples(PLAIN, seed=7):
        if not words & set(__import__("re").sub(licences.BETWEEN, " ", t.lower()).split(" ")):
            assert not list(brute(model, t))
    for t in [x for ts in licences.TEMPLATES.values() for x in ts]:
        assert words & set(licences.grams(t))


NEAR_MISSES = [
    "My driver's license expired in the second version of the story.", "The MIT campus is open to the general public.", "He spoke of Mozilla and of the software foundation under the bridge.",
    "The library may redistribute copies of the work to readers.", "Copyright law, license fees and public works were discussed.", "This eclipse was seen in the creative district; attribution is hard.",
    "You can obtain a copy of the minutes at the front desk, free of charge.", "An apache warrior is shown on the cover of the second edition.", "Without warranty the seller gave the machine to the buyer.",
    "The terms of use of the pool are posted at the gate, see the details there.", "GNU antelopes redistribute themselves over the plain.", "Artistic freedom and a poetic licence were granted to the author.",
]


def test_near_misses_are_unknown_and_false_rate_is_low():
    model = licences.train()
    assert not [t for t in NEAR_MISSES if list(brute(model, t))]
    words = sorted({x for t in [*NEAR_MISSES, *licences.near_misses()] for x in t.split()})
    r = __import__("random").Random(3)
    shuffled = [" ".join(r.choice(words) for _ in range(r.randint(4, 200))) for _ in range(2000)]
    assert sum(bool(list(brute(model, t))) for t in shuffled) <= 0.01 * len(shuffled)


def test_unseen_sentences_and_reliability():
    model = licences.train()
    rows = [(f, s.format(n)) for f, names in licences.NAMES.items() for n in names for s in ("You can use it under {}.", "This book is available under the {} only.")]
    found = [next(((x[1], x[2]) for x in brute(model, t)), (licences.UNKNOWN, 0)) for _, t in rows]
    hit = np.array([g[0] == f for g, (f, _) in zip(found, rows)])
    assert hit.mean() > 0.85 and len({round(g[1], 3) for g in found}) > 20
    assert np.mean([h for h, g in zip(hit, found) if g[0] != licences.UNKNOWN]) > 0.97


def test_all_licence_lines_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {(d.doc_id, i) for d in docs.collect() for i, p in enumerate(__import__("re").split("\r\n|[\r\n]", d.text or "")) if __import__("re").search("(?i)licen[sc]ed under|released under", p)}
    got = {(g.doc_id, g.paragraph) for g in licences.licensed(docs).where("confirmed").collect()}
    assert len(lines) == 39 and lines <= got and len(got - lines) <= 1


def test_corpus_paragraphs_are_whole_and_bounded(spark):
    long = "word " * 3000 + "tail"
    docs = spark.createDataFrame([(1, "a\nb\n" + long), (1, "a\nb\n" + long), (None, "c"), (2, None), (3, "Released under the MIT License.\nthe license of the driver")], "doc_id long, text string")
    got = licences.corpus_paragraphs(docs, 100, 1 << 20, "doc_id", "text")
    assert set(got) >= {"a", "b", long, "c", "the license of the driver"} and "Released under the MIT License." not in got
    assert max(map(len, licences.corpus_paragraphs(docs, 100, 500, "doc_id", "text"))) == 500
    both = licences.scan(docs.union(docs), licences.train()).collect()
    assert sorted((g.doc_id, g.family) for g in both) == [(3, "mit"), (3, "mit")]
