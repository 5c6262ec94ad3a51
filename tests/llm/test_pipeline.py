import os
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from test_decontaminate import slow_leaks
from test_neardup import groups_by_brute_force
from test_order import brute_mix
from vellumine.llm import decontaminate, langid, mixing, neardup, registry, sharding, storage

DATA = "/root/testdata/sf0.001"


def test_stages_equal_their_operators_by_hand(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]
    step = docs
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, DATA).write.parquet(f"{tmp_path}/{k}")
        step = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(step)
        if k < 4:
            assert sorted(step.columns) == sorted(docs.columns)
    ids = [sorted(r.doc_id for r in o.select("doc_id").collect()) for o in outs]
    assert ids[0] == sorted(r.doc_id for r in langid.identify(docs).where("accepted").collect())
    losers = {r.doc_id for r in neardup.near_duplicate_groups(outs[0]).where("not is_kept").collect()}
    assert ids[1] == [i for i in ids[0] if i not in losers] and losers
    leaking = {r.doc_id for r in decontaminate.leaks(outs[1], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert ids[2] == [i for i in ids[1] if i not in leaking]
    uses = Counter(r.doc_id for r in mixing.mixed(outs[2]).collect())
    assert Counter(ids[3]) == uses and set(uses) == set(ids[2])
    last = outs[4].collect()
    n = len(ids[3])
    assert sorted(r.position for r in last) == list(range(n))
    assert all(r.text == rows[r.doc_id].text and r.position == sharding.permuted(r.row_number, n, sharding.SEED) for r in last)
    assert corpus_pipeline.run(spark, DATA).count() == n


def slowly_accepted(model, text):
    """The gate one byte at a time: the deepest context, escapes, stretches of 128 bytes."""
    if text is None or not text.strip():
        return False
    words = [w for w in re.findall(r"[^\W_]+", text) if not re.search(r"[0-9]", w)]
    letters = sum(len(w.encode()) for w in words)
    if not letters or letters < langid.LEAST_LETTERS * sum(b > 32 for b in text.encode()):
        return False
    low = re.sub(r"[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text)
    low = re.sub(r"(?<![^\W_])[^\W_]*[0-9][^\W_]*", " ", low)
    data = re.sub(r"[\W_]+", " ", low).lstrip(" ").encode()
    excess, k = 0.0, range(len(model.languages))
    for a in range(0, len(data), langid.STRETCH):
        bits = [0.0 for _ in k]
        for i in range(a, min(a + langid.STRETCH, len(data))):
            node, x = 0, int(model.code[data[i]])
            for d in range(1, min(i, model.order) + 1):
                below = int(model.child[node, model.code[data[i - d]]])
                if below < 0:
                    break
                node = below
            for j in k:
                at = node
                while at >= 0 and model.pair[at, x] < 0:
                    bits[j] += float(model.escape[at, j])
                    at = int(model.parent[at])
                bits[j] += float(model.cost[model.pair[at, x], j]) if at >= 0 else 8
        best = min(k, key=lambda j: bits[j])
        excess += bits[best] - model.limits[model.languages[best]] * (min(a + langid.STRETCH, len(data)) - a)
    return excess <= langid.SLACK_BITS


def test_run_equals_a_brute_force_pipeline(spark, tmp_path):
    """Every stage by loops over all documents, pairs, windows and slots."""
    junk = [(10**6, "7345 99 3847 1213 4444 0918", "en", "src1", 27), (10**6 + 1, "qxz vbk wjq pfh zzk xqj vkw " * 9, "en", "src2", 252), (10**6 + 2, None, "en", None, None)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame(junk, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    rows = {r.doc_id: r for r in docs.collect()}
    kept = sorted(i for i, r in rows.items() if slowly_accepted(model, r.text))
    assert not {x[0] for x in junk} & set(kept) and len(kept) > 150
    for g in groups_by_brute_force([(i, rows[i].text) for i in kept]):
        kept = [i for i in kept if i not in g or i == min(g)]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    leaking = {d for d, _ in slow_leaks([(i, rows[i].text) for i in kept], items)}
    kept = [i for i in kept if i not in leaking]
    sources = [(rows[i].source or "", i) for i in kept]
    uses = [u[:2] for u in brute_mix(sources, mixing.shares(Counter(s for s, _ in sources), None), mixing.BLOCK)]
    ids = sorted(i for i, _ in uses)
    want = sorted((i, p, p % sharding.SHARDS, p // sharding.SHARDS) for k, i in enumerate(ids) for p in [sharding.permuted(k, len(ids), sharding.SEED)])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and leaking
    by_id = lambda rows_: {i: sorted(x[1:] for x in rows_ if x[0] == i) for i in {x[0] for x in rows_}}
    assert by_id(sorted((r.doc_id, r.position, r.shard, r.slot) for r in got)) == by_id(want)
    assert all(tuple(r)[:5] == tuple(rows[r.doc_id]) for r in got)


def test_stages_keep_odd_rows_defined(spark, odd, nothing):
    step = odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, nothing, DATA).count() == 0
        out = stage(spark, odd, DATA)
        assert set(odd.columns) <= set(out.columns) and out.count() > 0
        step = stage(spark, step, DATA)
        if k < 4:
            assert step.columns == odd.columns and all(r[x] == "x" + x for r in step.collect() for x in odd.columns[5:])
        if k == 2:
            assert {r.doc_id for r in step.collect()} == {1, 5, 8, None}


def test_clashing_columns_keep_their_values(spark, odd):
    step = odd.withColumn("slot", F.lit(7)).withColumn("position", F.lit(9))
    for _, stage in corpus_pipeline.STAGES[:4]:
        step = stage(spark, step, DATA)
        assert step.columns == [*odd.columns, "slot", "position"]
    assert step.count() >= 4 and {(r["slot"], r["position"], r["epoch"], r["block"]) for r in step.collect()} == {(7, 9, "xepoch", "xblock")}
    last = corpus_pipeline.STAGES[4][1](spark, step, DATA)
    assert {r["epoch"] for r in last.collect()} == {"xepoch"}


def test_run_deletes_the_tables_of_earlier_stages(spark):
    before = set(storage._made.get(spark, []))
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0
    new = [p for p in storage._made[spark] if p not in before]
    assert len(new) == 2 and sum("/stage3" in p for p in new) == 1  # the last stage's input and its helper table
    assert all(os.path.exists(p.removeprefix("file:").replace("//", "/")) for p in new)


def test_registry(spark):
    assert sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])))
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))
    assert set(registry.ORACLE) <= set(registry.QUERIES)
