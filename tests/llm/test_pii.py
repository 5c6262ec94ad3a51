import math

import numpy as np

from vellumine.llm import pii

PERSONAL = {
    "Write to anna.b@mail3.example.com today.": ("EMAIL", "anna.b@mail3.example.com"), "Call +1 (017) 555-7713 now": ("PHONE", "+1 (017) 555-7713"), "from 129.38.82.176 it came": ("IP", "129.38.82.176"),
    "card 4845168114407329 was used": ("CARD", "4845168114407329"), 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" here': ("SECRET", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"),
}
CLEAN = ["Version 2.0. of the license", "GPL version 3. applies", "chapter 12 of 40 pages", "in 1999 there were 3 of them", "nothing at all"]


def rows(spark, copies=20):
    texts = [t for t in list(PERSONAL) + CLEAN for _ in range(copies)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_personal_spans_are_found_and_others_left(spark):
    texts, docs = rows(spark)
    got = {}
    for r in pii.personal_spans(docs).collect():
        got.setdefault(r.doc_id, []).append((r.kind, texts[r.doc_id][r.start : r.end]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == ([PERSONAL[t]] if t in PERSONAL else []), t


def test_estimation_finds_reliabilities():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.6
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.85])
    speaks = np.array([1, 0.8, 0.7, 0.5, 0.5, 0.9])
    v = np.where(rng.random((20000, 6)) < right, 1, -1) * np.where(y, 1, -1)[:, None] * (rng.random((20000, 6)) < speaks)
    kind = np.repeat([0, 3], 10000)  # a kind of its own for each half, in the second the last labeler is always wrong
    v[10000:, 5] = np.where(y[10000:], -1, 1)
    p, thetas, priors = pii.estimate(kind, v, np.ones(20000), strength=0)
    assert ((p > 0.5) == y).mean() > 0.97
    for x in (0, 3):
        assert abs(priors[x] - 0.6) < 0.03
        for k in range(5):
            share = thetas[x][k, 1, 2] / (thetas[x][k, 1, 2] + thetas[x][k, 1, 0])
            assert abs(share - right[k]) < 0.05
    assert thetas[0][5, 1, 2] > 0.7 and thetas[3][5, 1, 2] < 0.01  # reliabilities are of a kind


def slow_estimate(rows, strength):
    """The same model by loops over the spans of each kind."""
    out = {}
    for kind in {k for k, _ in rows}:
        own = [v for k, v in rows if k == kind]
        p = [float(pii.first_guess(np.array([kind]), np.array([v]))[0]) for v in own]
        for _ in range(200):
            weight = {(k, c, v): pii.MEANT[kind][k][c][v + 1] * (3 + strength * len(own)) for k in range(6) for c in (0, 1) for v in (-1, 0, 1)}
            for votes, x in zip(own, p, strict=True):
                for k, v in enumerate(votes):
                    weight[k, 1, v] += x
                    weight[k, 0, v] += 1 - x
            prior = (sum(p) + 1 + strength * len(p) / 2) / (len(p) * (1 + strength) + 2)
            new = []
            for votes in own:
                a, b = prior, 1 - prior
                for k, v in enumerate(votes):
                    if v:
                        a *= weight[k, 1, v] / (weight[k, 1, -1] + weight[k, 1, 1])
                        b *= weight[k, 0, v] / (weight[k, 0, -1] + weight[k, 0, 1])
                new.append(a / (a + b))
            done = max(abs(x - y) for x, y in zip(p, new, strict=True)) < 1e-9
            p = new
            if done:
                break
        out |= {(kind, v): x for v, x in zip(own, p, strict=True)}
    return out


def test_query_equals_a_slow_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(rows(spark, 3)[1].selectExpr("doc_id + 1000000 AS doc_id", "text"))
    described = []  # every text is searched here, without looking at bytes first
    for r in docs.collect():
        described += [(r.doc_id, a, b, pii._described(r.text, a, b, k)) for a, b, k in [*pii.spans(r.text), *pii.people(r.text)]]
    probability = slow_estimate([(d[0], d[1:7]) for *_, d in described], pii.STRENGTH)
    shapes = np.array([(d[0], *d[7:]) for *_, d in described])
    target = np.array([probability[d[0], d[1:7]] for *_, d in described])
    w = pii.fit(shapes, target, np.ones(len(shapes)))
    x = pii.design(shapes)
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - target) + 0.1 * w).max() < 1e-5  # the only optimum
    want = {}
    for (i, a, b, d), z in zip(described, x @ w, strict=True):
        if z >= 0:
            want[i, a, b] = (pii.OUTPUT.get(pii.KINDS[d[0]], pii.KINDS[d[0]]), 1 / (1 + math.exp(-z)))
    got = {(r.doc_id, r.start, r.end): (r.kind, r.probability) for r in pii.personal_spans(docs).collect()}
    assert set(got) == set(want) and len(got) > 30
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-4 for k in got)


def test_classifier_fits_counts():
    shapes = np.array([[0, 0, 0, 0, 0, 0, 2], [10, 1, 2, 0, 0, 1, 0]])
    w = pii.fit(shapes, np.array([0.9, 0.1]), np.array([1000.0, 1000.0]))
    p = 1 / (1 + np.exp(-pii.design(shapes) @ w))
    assert abs(p[0] - 0.9) < 0.02 and abs(p[1] - 0.1) < 0.02


WIDER = {
    "API_KEY=b44e15e09fd311c3cf3163b66d5a9875b883d8ce": [("SECRET", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce")], "export AWS_SECRET=b44e15e09fd311c3cf3163b66d5a9875b883d8ce": [("SECRET", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce")],
    "the password: hunter2xyz works": [("SECRET", "hunter2xyz")], "My name is Priya Raghunathan, hello": [("PERSON", "Priya Raghunathan")], "so my name is john smith.": [("PERSON", "john smith")], "ask Dr. Okonkwo today": [("PERSON", "Okonkwo")],
    "from 2001:db8:85a3::8a2e:370:7334 it came": [("IP", "2001:db8:85a3::8a2e:370:7334")], "IBAN DE89 3704 0044 0532 0130 00 please": [("IBAN", "DE89 3704 0044 0532 0130 00")], "ssn 078-05-1120 here": [("SSN", "078-05-1120")], "call 5551234567 now": [("PHONE", "5551234567")],
}
NOT_PERSONAL = ["walks in New York each day", "on 20240131 we met", "there are 12345678 stars", "in C++ std::vector a::b holds", "the token economy of games", "I am happy to be here", "the key idea is simple"]


def test_wider_candidates_end_to_end(spark):
    texts = [t for t in [*WIDER, *NOT_PERSONAL, *CLEAN] for _ in range(10)]
    got = {}
    for r in pii.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.kind, texts[r.doc_id][r.start : r.end]))
    assert {t: got.get(i, []) for i, t in enumerate(texts)} == {t: WIDER.get(t, []) for t in texts}


def test_words_before_are_whole():
    assert pii.words_before("a " + "x" * 100_000 + " of the mail ", 100_015) == ["x" * 100_000, "of", "the", "mail"]
    assert pii.words_before("1 2 3 " * 50_000, 200_000) == [] and pii.words_before("", 0) == []


def test_luhn_and_people():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.iban("DE89370400440532013000") and not pii.iban("DE89370400440532013001")
    assert [s for s in pii.people("I met Mr. Smith and Maria Lopez, but not alone.")] == [(10, 15, "PERSON"), (20, 31, "PERSON")]


def test_odd_rows(spark, odd, nothing):
    assert pii.personal_spans(odd).count() == 0
    assert pii.personal_spans(nothing).count() == 0
    mail = "write to anna.b@mail3.example.com"
    long = "filler text " * 100_000 + mail
    texts = [(1, mail), (1, mail), (None, mail), (2, long), (3, None), (4, "")]
    df = spark.createDataFrame([(*r, "a", 1, 2.0, "k") for r in texts], "doc_id long, text string, id string, start int, probability double, kind string")
    got = sorted((r.doc_id or -1, r.start, r.end, r.kind) for r in pii.personal_spans(df).collect())
    n = len(long) - len(mail)
    assert got == [(-1, 9, 33, "EMAIL"), (1, 9, 33, "EMAIL"), (1, 9, 33, "EMAIL"), (2, n + 9, n + 33, "EMAIL")]
