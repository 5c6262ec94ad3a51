import functools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from vellumine.llm import decontaminate as dc

ITEM = "John has 3 apples and gives 3 apples to Mary after 2 days of waiting near the old station in town"
ITEMS = [(1, ITEM), (2, "one two"), (3, None), (4, ""), (5, "why is the sky so blue"), (5, "why is the sky so blue")]


def found(spark, texts, items=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r.doc_id, r.item_id, r.verbatim) for r in dc.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())


def test_templates_slots_and_windows(spark):
    other = ITEM.replace("John", "Alice").replace("Mary", "Robert Jones").replace("3", "7").replace("2 days", "5 hours")
    texts = [
        "Before it. " + ITEM + ". After it.", "So. " + other, "So. " + other.replace("gives 7", "gives 8"), "He has apples and gives some to her in town.", ITEM.upper(), "And " + ITEM[:40], None, "", "x: why is the sky so blue now", "why is the sea so blue",
        " ".join(["12 km"] * 40),
    ]
    assert found(spark, texts) == [(0, 1, True), (1, 1, False), (4, 1, True), (8, 5, True)]


def test_all_verbatim_items_of_the_data(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    known = [(r.item_id, f" {words(r.text)} ") for r in items.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in known if t in f" {words(d.text)} "}
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()}
    assert want and want <= got
    assert {d for d, _ in got} == {d for d, _ in want}
    kept = {r.doc_id for r in dc.clean_documents(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "A plain text of some words about nothing much at all, in the end."), (2, "A text without a number that is found nowhere else in here.")], "item_id long, text string")
    got = sorted(((r.doc_id or -1), r.item_id) for r in dc.leaks(odd, items).collect())
    assert got == [(-1, 2), (1, 1)]
    kept = dc.clean_documents(odd, items)
    assert kept.columns == odd.columns
    assert kept.count() == odd.count() - 3
    assert dc.leaks(nothing, items).count() == 0 and dc.leaks(odd, items.limit(0)).count() == 0
    assert dc.clean_documents(odd, items.limit(0)).count() == odd.count()
    assert dc.leaks(odd.withColumn("item_id", F.lit(1)), items).count() == 2


def test_items_dense_in_numbers_and_names(spark):
    items = [
        (1, "Compute 12 + 7 * 3 - 5 / 2"), (2, "3 4 5 6 7 8 9 10 11 12"), (3, "John Smith, Mary Jones, Robert Brown and Zofia Nowak"), (4, "Why is the sky so blue"),
        (5, "Values 12 kg 15 kg 18 kg 22 kg 31 kg 35 kg 40 kg 44 kg 52 kg"), (6, "Der Hund und die Katze im Haus"), (7, "What is 17 + 25 - 4 * 3"),
    ]
    texts = [f"He asked {t} and left." for _, t in items] + ["He asked: compute 14 + 9 * 6 - 8 / 4 now", "So, what is 11 + 32 - 5 * 7", "It weighs 3 kg and 5 kg, or 9 kg 11 kg 13 kg", "Anna Bell, Tom Hill, Hans Roth and Ivan Petrov met"]
    got = found(spark, texts, items)
    assert {(k, i) for k, (i, _) in enumerate(items)} <= {(d, i) for d, i, v in got if v}
    assert {(7, 1, False), (8, 7, False)} <= set(got)
    assert not {9, 10} & {d for d, _, _ in got}


def test_near_copies_of_long_items(spark):
    half = "red fox 5 runs over the old bridge while the tired miller counts sacks of grain in his barn and then walks home slowly"
    item = f"Once a {half} before a new day when a {half} again"
    other = item.replace(" 5 ", " 7 ")
    changed = " 8 ".join(other.rsplit(" 7 ", 1))
    equal = "a box holds 3 apples and 5 pears of which the girl takes a few home"
    texts = ["So. " + " 6 ".join(item.rsplit(" 5 ", 1)), "So. " + changed, "So. " + equal.replace("3", "4").replace("5", "4")]
    assert {(0, 1), (1, 1), (2, 2)} == {(d, i) for d, i, _ in found(spark, texts, [(1, item), (2, equal)])}


def test_runs_without_contradiction():
    windows = [(q, [(1, 10)] if q < 30 else [(1, 11)] if q > 37 else [(1, 10), (1, 11)] if q == 33 else []) for q in range(45)]
    assert dc.consistent_runs(windows, 8, 26) == list(range(33))
    assert dc.consistent_runs(windows, 8, 60) == []
    assert dc.consistent_runs([(0, [(1, 2), (1, 3)])], 8, 8) == []
    # equal item values of which one changes and changes back
    back = [(q, [(1, 3 if q == 20 else 2)]) for q in range(40)]
    assert dc.consistent_runs(back, 8, 26) == [*range(20), *range(21, 40)]


def slow_tokens(text):
    """Words, and (kind, literal or value, opens) of each token, by regular expressions."""
    words = []
    for m in re.finditer(r"[^\W_]+", text):
        cut = re.fullmatch(r"(\d\w*?)([^\W\d_]+)", m[0])
        if cut and cut[1].isdigit() and cut[2].lower() in dc.UNITS + dc.UNITS_AFTER_NUMBERS:
            middle = m.start() + len(cut[1])
            words += [(cut[1], m.start(), middle), (cut[2], middle, m.end())]
        else:
            words.append((m[0], m.start(), m.end()))
    out, prior = [], (None, 0, 0)
    for k, (w, a, b) in enumerate(words):
        gap = text[prior[2] : a] if k else ""
        opens, low = k == 0 or re.search(r"[^ ,\-'\t]", gap) is not None, w.lower()
        last = out[-1][0] if out else None
        kind = "NUMBER" if w[0].isdigit() or low in dc.NUMBER_WORDS else "UNIT" if low in dc.UNITS else None
        if kind is None and low in dc.UNITS_AFTER_NUMBERS and k and last == "NUMBER" and len(gap) <= 1:
            kind = "UNIT"
        elif kind is None and re.fullmatch(r"[A-ZÀ-Þ][a-zà-ÿ].*", w) and low not in dc.FUNCTION_WORDS + dc.UNITS_AFTER_NUMBERS:
            kind = "NAME"
        spelled = not w[0].isdigit()
        if k and kind == last and len(gap) == 1 and (kind == "NUMBER" and (gap in ",.-/:" or spelled and gap == " ") or kind == "NAME" and gap == " "):
            out[-1] = (kind, out[-1][1] + " " + low, False)
        else:
            out.append((kind, low, opens and kind == "NAME"))
        prior = (w, a, b)
    return [w.lower() for w, _, _ in words], out


@functools.cache
def slow_windows(text, size, least):
    """(stream, position, key, slots, literals, has a name) of every window in every reading."""
    words, tokens = slow_tokens(text)
    out = [("words", k, tuple(words[k : k + size]), (), size, False) for k in range(len(words) - size + 1)]
    for k in range(len(tokens) - size + 1):
        for second in (False, True):
            part = [(kind if second or not opens else None, v, opens) for kind, v, opens in tokens[k : k + size]]
            if second and not any(o for _, _, o in part):
                continue
            kinds = [x for x, _, _ in part]
            out.append(("tokens", k, tuple(x or v for x, v, _ in part), tuple(v for x, v, _ in part if x), kinds.count(None), "NAME" in kinds))
    return [x for x in out if x[4] > 0], {"words": len(words), "tokens": len(tokens)}


def slow_leaks(docs, items, least=dc.LEAST):
    found = {}
    for item, text in items:
        for size in range(1, dc.WINDOW + 1):
            windows, lengths = slow_windows(text, size, least)
            index = defaultdict(list)
            for stream, q, key, slots, literals, name in windows:
                n = lengths[stream]
                long_enough = n == size or size == dc.WINDOW
                if long_enough and (stream == "words" or size >= dc.TEMPLATE_SHORTEST and (literals >= 2 or n <= least and not name)):
                    index[stream, key].append((q, slots))
            for doc, body in docs:
                lines = defaultdict(set)
                for stream, p, key, slots, _, _ in slow_windows(body, size, least)[0]:
                    for q, own in index.get((stream, key), ()):
                        lines[stream, p - q].add((q, tuple(zip(own, slots, strict=True))))
                for stream in ("words", "tokens"):
                    covered, verbatim = set(), False
                    for (s, _), line in lines.items():
                        if s != stream:
                            continue
                        pairs = {x for _, z in line for x in z}
                        if len({a for a, _ in pairs}) == len(pairs):
                            covered |= {q for q, _ in line}
                            verbatim |= all(a == b for a, b in pairs)
                        else:  # every stretch without contradiction
                            qs = sorted({q for q, _ in line})
                            for i in range(len(qs)):
                                for j in range(i, len(qs)):
                                    inside = {x for q, z in line if qs[i] <= q <= qs[j] for x in z}
                                    tokens = {t for q in qs[i : j + 1] for t in range(q, q + size)}
                                    if len({a for a, _ in inside}) == len(inside) and len(tokens) >= 2 * least:
                                        covered |= set(qs[i : j + 1])
                    n = len({t for q in covered for t in range(q, q + size)})
                    if covered and n >= min(least, lengths[stream]):
                        old = found.get((doc, item), (0, False))
                        found[doc, item] = (max(old[0], min(n, lengths["tokens"])), old[1] or verbatim)
    return found


def test_re_parameterised_items_equal_a_slow_model(spark):
    rng = random.Random(4)
    names, units = ["Priya", "James", "Zofia Nowak", "Ivan", "Li", "Karl Maria"], ["km", "bushels", "Stunden", "heures", "kg", "m"]
    plain = "walks reads carries counts old river market basket slowly near behind apples stones letters before noon and with the then gives takes".split()

    def sentence(values):
        who, other, n, m, unit, tail = values
        return f"{who} {tail[0]} {n} {tail[1]} {tail[2]} and {tail[3]} {m} {unit} {tail[4]} with {other} {tail[5]} the {tail[6]} {tail[7]}"

    def values(tail):
        number = lambda: rng.choice([str(rng.randint(2, 99)), "twenty three", "7.5", "1,200", "zwanzig"])
        return (rng.choice(names), rng.choice(names), number(), number(), rng.choice(units), tail)

    items, docs = [], []
    for k in range(12):
        tails = [[rng.choice(plain) for _ in range(8)] for _ in range(rng.randint(1, 3))]
        items.append((k, ". ".join(sentence(values(t)) for t in tails) + "."))
        for _ in range(4):
            text = ". ".join(sentence(values(t)) for t in tails)
            docs.append((len(docs), rng.choice(["", "So, ", "He said that ", "Well. "]) + text + rng.choice([".", " and then some more", ". The end"])))
        docs.append((len(docs), "Hm: " + items[-1][1].replace(" km", "km")))
        docs.append((len(docs), "It is " + " ".join(rng.choice(plain) for _ in range(30))))
    items += [(90, "Is water wet?"), (91, "12 + 34 = 46 and 5 * 6 = 30"), (92, "Yes")]
    docs += [(len(docs), "They ask, is water wet, and why."), (len(docs) + 1, "so 12 + 34 = 46 and 5 * 6 = 30 holds"), (len(docs) + 2, "Yes, of course")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.covered, r.verbatim) for r in dc.leaks(df, bench).collect()}
    want = slow_leaks(docs, items)
    assert got == want
    reworded = {d for (d, i), (_, v) in got.items() if not v}
    assert len(reworded) >= 24 and all(i in {x for d, x in got if d == len(docs) - 3 + k} for k, i in enumerate((90, 91, 92)))


def test_other_spellings_of_numbers_units_and_names(spark):
    items = [(1, "Priya drives 60 km to the coast and 23 bushels of wheat are on the truck"), (2, "Quelle distance parcourt James en 3 heures avec son grand vélo rouge neuf"), (3, "Wie weit fährt Hans in 5 Stunden mit dem alten roten Fahrrad nach Hause"), (4, "Cuánto gana Ana en 4 días de trabajo si ahorra 20 euros cada noche fría")]
    texts = ["James drives 75km to the coast and twenty three bushels of wheat are on the truck", "Then Zofia drives 60km to the coast and 23 tons of wheat are on the truck", "quelle distance parcourt Marie en sept jours avec son grand vélo rouge neuf", "Gut. Wie weit fährt Priya in drei Tagen mit dem alten roten Fahrrad nach Hause", "cuánto gana Luis en diez semanas de trabajo si ahorra 9 dólares cada noche fría"]
    assert {(d, i) for d, i, _ in found(spark, texts, items)} == {(0, 1), (1, 1), (2, 2), (3, 3), (4, 4)}


def test_long_texts_and_clashing_names(spark):
    text = "filler words go on and on " * 50_000 + ITEM + " more filler" * 1000
    docs = spark.createDataFrame([(1, text, "a", 1, "b", "c"), (2, "other", "a", 1, "b", "c")], "doc_id long, text string, __hash string, t long, `__id` string, item_id string")
    items = spark.createDataFrame([(*x, "h", 1) for x in ITEMS], "item_id long, text string, hash string, size long")
    assert [(r.doc_id, r.item_id) for r in dc.leaks(docs, items).collect()] == [(1, 1)]
    kept = dc.clean_documents(docs, items)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2] and kept.first()["__hash"] == "a"


def test_bitmap_holds_all_hashes(spark):
    rng = random.Random(2)
    hashes = [rng.getrandbits(64) - 2**63 for _ in range(500)]
    bitmap = dc.bitmap_of(spark.createDataFrame([(h,) for h in hashes], "hash long"))
    assert bitmap.size == 1 << (dc.MAP_BITS[0] - 3)
    bit = [(h % 2**64) >> (64 - dc.MAP_BITS[0]) for h in hashes]
    assert all(bitmap[b >> 3] >> (b & 7) & 1 for b in bit) and sum(int(x).bit_count() for x in bitmap) == len(set(bit))
