import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.llm import neardup as nd


def brute(keys, most, segment_end, most_segment):
    out = set()
    for i in range(len(keys)):
        for j in range(i + 1, len(keys)):
            x = int(keys[i] ^ keys[j])
            if x.bit_count() <= most and (x >> (64 - segment_end)).bit_count() <= most_segment:
                out.add((i, j))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=0, max_size=12), st.lists(st.tuples(st.integers(0, 11), st.sets(st.integers(0, 63), max_size=12)), max_size=20), st.integers(1, 60))
def test_trie_join_equals_brute_force(base, flips, leaf):
    keys = set(base)
    for i, bits in flips:
        if base:
            x = base[i % len(base)]
            for b in bits:
                x ^= 1 << b
            keys.add(x)
    keys = np.array(sorted(keys), np.uint64)
    found = {(int(a), int(b)) for i, j in nd.trie_pairs(keys, 0, 21, 3, 11, leaf=leaf, wave=7) for a, b in zip(i, j, strict=True)}
    exact = brute(keys, 11, 21, 3)
    assert exact <= found <= brute(keys, 11, 21, 64)


def test_majority_counts_bits():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    first = np.array([0, 1, 700, 701, 4000])
    got = nd.majority(h, first)
    for k, (a, b) in enumerate(zip(first, [*first[1:], 5000], strict=True)):
        bits = [(h[a:b] >> np.uint64(i) & np.uint64(1)).sum() * 2 > b - a for i in range(64)]
        assert int(got[k]) == sum(1 << i for i, x in enumerate(bits) if x)


def groups_by_brute_force(rows):
    has, h, v = nd.signatures(pa.array([t for _, t in rows]))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        d = np.bitwise_count(h ^ h[i])
        s = np.bitwise_count(v ^ v[i]).sum(axis=1)
        for j in np.flatnonzero((d <= nd.BITS) & (s <= nd.SHINGLE_BITS) & has).tolist():
            if has[i] and j > i:
                parent[root(j)] = root(i)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), set()).add(rows[i][0])
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {}
    for r in nd.near_duplicate_groups(docs).collect():
        got.setdefault(r.group_id, set()).add(r.doc_id)
        assert r.is_kept == (r.doc_id == r.group_id)
    assert sorted(sorted(g) for g in got.values()) == groups_by_brute_force(rows)
    kept = {r.doc_id for r in nd.one_of_each_group(docs).collect()}
    assert kept == {i for i, _ in rows} - {i for g in got.values() for i in g} | set(got)


def test_near_copies_are_found_and_other_texts_are_not(spark):
    rng = np.random.default_rng(3)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)])
    rows, number = [], 0
    for g in range(40):
        text = rng.choice(words, 200)
        for _ in range(3):
            t = text.copy()
            t[rng.choice(200, 3, replace=False)] = rng.choice(words, 3)
            rows.append((number, " ".join(t), g))
            number += 1
    clean = [(number + k, " ".join(rng.choice(words, 60)), None) for k in range(200)]
    df = spark.createDataFrame(rows + clean, "doc_id long, text string, g int")
    got = {r.doc_id: r.group_id for r in nd.near_duplicate_groups(df).collect()}
    assert not {i for i, _, _ in clean} & set(got)
    assert sum(got.get(i) == got.get(i - i % 3, -1) for i, _, _ in rows) / len(rows) >= 0.95


def test_odd_rows(odd, nothing):
    groups = sorted((r.group_id, r.doc_id, r.is_kept) for r in nd.near_duplicate_groups(odd).collect())
    assert groups == [(1, 1, True), (5, 5, True), (5, 6, False), (8, 8, True), (8, 9, False)]
    kept = nd.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 7, 8]
    assert nd.near_duplicate_groups(nothing).count() == 0 and nd.one_of_each_group(nothing).count() == 0


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if root(x) != x}
