import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumine.llm import langid, textbytes


def slow_length(texts, text, order, least, all_texts):
    """Code length by dictionaries, one byte at a time."""
    total = Counter()
    for t in all_texts:
        b = t.encode()
        for i in range(len(b)):
            for d in range(1, order + 1):
                if i - d >= 0:
                    total[b[i - d : i]] += 1
                elif True:
                    break
    # contexts are counted where a byte or the end of a text follows
    for t in all_texts:
        b = t.encode()
        for d in range(1, order + 1):
            if len(b) >= d:
                total[b[len(b) - d :]] += 1
    counts = defaultdict(Counter)
    for t in texts:
        b = t.encode()
        for i, s in enumerate(b):
            for d in range(min(i, order) + 1):
                counts[b[i - d : i]][s] += 1
    bits, b = 0.0, text.encode()
    for i, s in enumerate(b):
        for d in range(min(i, order), -1, -1):
            c = b[i - d : i]
            if d and any(total[c[k:]] < least for k in range(len(c))):
                continue
            seen = counts.get(c)
            if not seen:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if s in seen:
                bits -= math.log2(seen[s] / (n + kinds))
                break
            bits -= math.log2(kinds / (n + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_slow_model():
    texts = {"x": ["the cat sat on the mat", "a cat"], "y": ["le chat dort", "élan vital, le chat"], "z": ["q"]}
    every = [t for v in texts.values() for t in v]
    for order, least in ((3, 1), (2, 1), (3, 2), (0, 1)):
        m = langid.Model(texts, order, least)
        for s in ["the chat", "", "zzz ü", "le cat sat", "t", "cat " * 50]:
            data, offsets = textbytes.utf8(pa.array(["pad before", s, "pad after"]))
            got = m.lengths(data, offsets, step=7)[1]
            want = [slow_length(texts[k], s, order, least, every) for k in m.languages]
            assert np.allclose(got, want, rtol=1e-5), (order, least, s)


def test_scoring_works_in_small_arrays():
    """What scoring holds at once fits a core's cache whatever the text's length: arrays of a step, none of bytes times languages."""
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    m = langid.Model({x: [" ".join(rng.choice(words) for _ in range(2000))] for x in "abcd"})
    data, offsets = textbytes.utf8(pa.array([" ".join(rng.choice(words) for _ in range(400)) for _ in range(400)]))
    m.lengths(data[: offsets[1]], offsets[:2])
    tracemalloc.start()
    m.lengths(data, offsets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 600_000 and most < 6e6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    even, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = langid.train(even, per_language=30)
    assert all(1 < x < langid.REJECT_BITS < 8 for x in model.limits.values())
    s = held.select("lang", langid.scored(F.col("text"), model).alias("s"))
    got = s.select(F.avg((F.col("lang") == F.col("s.lang")).cast("int")), F.avg(F.col("s.accepted").cast("int"))).first()
    assert got[0] >= 0.99 and got[1] >= 0.99


def test_what_no_language_explains_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    junk = [
        draw("0123456789", 400), " ".join(draw("0123456789", 5) for _ in range(60)), draw("abcdefghijklmnopqrstuvwxyz", 300), " ".join(draw("abcdefghijklmnopqrstuvwxyz", 6) for _ in range(50)),
        "La vita nuova di questa città è molto bella e gli abitanti camminano ogni giorno lungo il fiume per guardare le barche che passano lente",
        "Szybki brązowy lis skacze nad leniwym psem i ucieka do lasu gdzie mieszka ze swoją rodziną", "Погода сегодня хорошая, и завтра тоже будет.", "for (int i = 0; i < n; i++) { x[i] += y[i] * 3; } while (j > 0) { swap(ptr, buf, j--); }",
        "12 the 3333333333 444444444444 5555555555 66666666666666666 777777777777777777777777777", "??? !!! ... --- ~~~",
    ]
    clean = [r.text for r in docs.where("length(text) > 300").limit(200).collect()]
    planted = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(junk + [t.upper() for t in clean[:20]])], "doc_id long, text string, lang string"))
    out = {r.doc_id: r.accepted for r in langid.identify(planted).collect()}
    assert [out[10**6 + k] for k in range(len(junk))] == [False] * len(junk)
    assert all(out[10**6 + len(junk) + k] for k in range(20))  # capitals are the same language
    kept = langid.accepted_documents(planted)
    assert docs.count() * 0.99 <= kept.where("doc_id < 1000000").count() and kept.count() <= planted.count() - len(junk)


def test_texts_in_two_languages_are_explained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    texts = {x: [r.text[:600] for r in docs.where(F.col("lang") == x).where("length(text) > 700 and text = initcap(text) = false and not text rlike '[0-9%!]'").orderBy("doc_id").limit(10).collect()] for x in ("en", "fr")}
    both = spark.createDataFrame([(a + " " + b,) for a, b in zip(texts["en"], texts["fr"], strict=True)], "text string")
    assert all(r.accepted for r in both.select(langid.scored(F.col("text"), model).alias("s")).select("s.*").collect())


def test_words_with_digits_are_no_letters():
    data, offsets = textbytes.utf8(pa.array(["", "Ab c3d, É!", "7", None, "x"]))
    low, ends, letters, solid = langid.normal(data, offsets)
    assert [low[a:b].tobytes().decode() for a, b in zip(ends, ends[1:], strict=False)] == ["", "ab é ", "", "", "x"]
    assert letters.tolist() == [0, 4, 0, 0, 1] and solid.tolist() == [0, 9, 1, 0, 1]


def test_limits_need_held_out_texts():
    m = langid.Model({"x": ["abc abc"]})
    assert m.limits == {"x": langid.REJECT_BITS}


def test_foreign_bytes_are_rejected_and_odd_rows_defined(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    rows = spark.createDataFrame([("Погода сегодня хорошая, и завтра тоже будет.",), ("中文文本没有空格也没有字母表可以使用",), (None,), ("",), (" \n",)], "text string")
    assert [r.accepted for r in rows.select(langid.scored(F.col("text"), model).alias("s")).select("s.*").collect()] == [False] * 5
    out = langid.identify(odd).collect()
    assert len(out) == odd.count()
    assert {r.doc_id for r in out if not r.accepted and r.doc_id} == {2, 3, 4, 7}
    assert all(r.detected is None and r.bits is None for r in out if r.doc_id in (2, 3, 4))
    kept = langid.accepted_documents(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert langid.identify(nothing).count() == 0 and langid.accepted_documents(nothing).count() == 0
    assert langid.accepted_documents(odd.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_order_must_fit():
    with pytest.raises(Exception):
        langid.Model({"x": [None]}).lengths(np.zeros(3, np.uint8), None)


def test_every_labelled_text_counts_and_sets_limits(spark):
    """Halves by hash, models of all texts of the other half, limits of all that is held out, junk left out: by loops."""
    junk = [(None, "qxz vbk wjq pfh zzk xqj vkw " * 9, "en"), (10**6, "wkq zxv " * 40, "de")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string"))
    rows = [(r.lang, r.f, r.text) for r in docs.withColumn("f", F.expr("pmod(xxhash64(text), 2)")).collect() if r.text is not None]
    letters = lambda t: langid.normal(*textbytes.utf8(pa.array([t])))[0].tobytes()
    halves = [langid.Model({x: [letters(t) for lang, half, t in rows if (lang, half) == (x, f)] for x in ("de", "en", "es", "fr")}) for f in (0, 1)]
    rates = defaultdict(list)
    for f in (0, 1):
        mine = [(x, letters(t)) for x, half, t in rows if half == f]
        bits = halves[1 - f].lengths(np.frombuffer(b"".join(t for _, t in mine), np.uint8), np.cumsum([0] + [len(t) for _, t in mine]))
        for (x, t), b in zip(mine, bits, strict=True):
            if len(t) >= langid.LEAST_SIZE and halves[1 - f].languages[b.argmin()] == x and b.min() <= langid.REJECT_BITS * len(t):
                rates[x].append(b.min() / len(t))
    limits = {x: np.mean(v) + langid.SPREAD * np.std(v) for x, v in rates.items()}
    assert sum(map(len, rates.values())) > 900 and min(map(len, rates.values())) > 90
    model = langid.train(docs)
    assert model.limits == pytest.approx(limits)
    texts = defaultdict(list)
    out = []
    for f in (0, 1):
        halves[1 - f].limits = limits
        mine = [(x, t) for x, half, t in rows if half == f]
        judged = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(mine)], "k int, t string").select("k", langid.scored(F.col("t"), halves[1 - f]).alias("s")).collect()
        for r in judged:
            if r.s.accepted:
                texts[mine[r.k][0]].append(letters(mine[r.k][1]))
            else:
                out.append(mine[r.k][1])
    assert {t for _, t, _ in junk} <= set(out) and len(out) < 20
    whole = langid.Model(texts)
    assert len(whole.cost) == len(model.cost) and np.allclose(whole.cost, model.cost) and np.allclose(whole.escape, model.escape) and (whole.child == model.child).all()
    assert not any(r.accepted for r in langid.identify(docs).where("doc_id is null or doc_id = 1000000").collect())


def test_every_label_is_a_language(spark):
    """130 labels, the two rarest with letters of their own and without ids."""
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} some words that all of the labels have", f"l{k:03}") for k in range(128) for _ in range(3)]
    rows += [(None, "погода сегодня хорошая", "x1"), (None, "ωραίος καιρός σήμερα", "x2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.train(docs).languages) == 130
    assert {r.label: (r.detected, r.accepted) for r in langid.identify(docs).where("doc_id is null").collect()} == {"x1": ("x1", True), "x2": ("x2", True)}


def test_counts_of_many_batches_are_merged_and_handed_on(spark, monkeypatch):
    texts = [f"{chr(97 + k % 7)}{chr(97 + k % 11)}{chr(97 + k % 13)} abc" for k in range(60)]
    want = langid.grams(*textbytes.utf8(pa.array(texts)), 3)
    keyed = spark.createDataFrame([("x", t) for t in texts], "l string, t string").repartition(3).withColumn("f", F.lit(0)).cache()
    for least in (1 << 22, 40, 1):
        monkeypatch.setattr(langid, "HELD_IN_MEMORY", least)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        try:
            got = langid.counted(keyed, 3)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert list(got) == [("x", 0)] and all((a == b).all() for a, b in zip(got["x", 0], want, strict=True))
