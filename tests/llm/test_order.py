import math
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from vellumine.llm import mixing, sharding

DATA = "/root/testdata/sf0.001"


def test_permutation_is_one_and_inverts():
    for n in (1, 2, 3, 7, 16, 17, 100, 257, 1000):
        p = [sharding.permuted(i, n, 5) for i in range(n)]
        assert sorted(p) == list(range(n))
        assert [sharding.unpermuted(q, n, 5) for q in p] == list(range(n))
    assert [sharding.permuted(i, 50, 5) for i in range(50)] != [sharding.permuted(i, 50, 6) for i in range(50)]
    big = 10**12 + 39
    assert all(sharding.unpermuted(sharding.permuted(x, big, 1), big, 1) == x for x in range(0, big, big // 50))


@pytest.mark.parametrize("n", [1, 2, 5, 123, 10**6, 10**12 + 39, 10**15])
def test_column_equals_python(spark, n):
    xs = sorted({0, n - 1, n // 2, n // 3, min(7, n - 1)})
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x long").select(sharding.permutation(F.col("x"), n, 99)).collect()]
    assert got == [sharding.permuted(x, n, 99) for x in xs]


def test_sharding_of_odd_rows(odd, nothing):
    rows = sharding.sharded(odd.withColumn("shard", F.lit("old")), shards=5).collect()
    n = len(rows)
    assert n == odd.count()
    assert sorted(r.row_number for r in rows) == list(range(n)) == sorted(r.position for r in rows)
    assert all((r.shard, r.slot) == (r.position % 5, r.position // 5) and r.position == sharding.permuted(r.row_number, n, sharding.SEED) for r in rows)
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.row_number)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert sharding.sharded(nothing).count() == 0


def test_schedule_is_pfair():
    for share in ({"a": 1}, {"a": 3, "b": 5, "c": 2}, {"a": 333, "b": 333, "c": 334}, {str(i): 1 + i for i in range(30)}):
        total = sum(share.values())
        got = [s for _, s in mixing.scheduled(share, {s: 3 * p for s, p in share.items()})]
        assert len(got) == 3 * total and Counter(got) == {s: 3 * p for s, p in share.items()}
        done = Counter()
        for t, s in enumerate(got):
            assert done[s] * total // share[s] <= t < -(-(done[s] + 1) * total // share[s])
            done[s] += 1
            assert all(abs(done[x] * total - p * (t + 1)) < total for x, p in share.items())


@pytest.mark.parametrize("weights", [{"a": 0.70004, "b": 0.29940, "c": 0.00056}, {"hot": 0.5} | {f"s{k:02}": 0.5 / 19 for k in range(19)}, {"a": 1e-5, "b": 1.0}])
def test_less_than_a_block_from_the_target_weights_over_a_million_slots(weights):
    share = mixing.shares(dict.fromkeys(weights, 1), weights)
    exact = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    assert all(Fraction(p, sum(share.values())) == exact[s] for s, p in share.items())
    ratio = {s: (e.numerator, e.denominator) for s, e in exact.items()}
    done, worst = dict.fromkeys(weights, 0), Fraction(0)
    for t, s in mixing.scheduled(share, dict.fromkeys(weights, 10**7)):
        if t == 10**6:
            break
        done[s] += 1
        if t % 97 == 0 or t > 999_000:
            worst = max(worst, *(abs(done[x] - Fraction(n * (t + 1), d)) for x, (n, d) in ratio.items()))
    assert worst < 1


def brute_mix(rows, weights, block):
    """Earliest deadline first over all slots with fractions; rows: (source, id)."""
    sources = sorted(weights)
    total = sum(Fraction(w) for w in weights.values())
    w = {s: Fraction(weights[s]) / total for s in sources}
    queue = {s: sorted(i for x, i in rows if x == s) for s in sources}
    needed = {s: -(-len(queue[s]) // block) for s in sources}
    given = {s: [] for s in sources}
    t = 0
    while any(len(given[s]) < needed[s] for s in sources):
        ready = [s for s in sources if math.floor(len(given[s]) / w[s]) <= t]
        given[min(ready, key=lambda s: (math.ceil((len(given[s]) + 1) / w[s]), s))].append(t)
        t += 1
    out = []
    for s in sources:
        n = len(queue[s])
        for x in range(len(given[s]) * block if len(given[s]) > needed[s] else n):
            slot = given[s][x // block]
            out.append((queue[s][x % n], s, x // n, x // block, slot, slot * block + x % block))
    return sorted(out)


def test_mixing_equals_brute_force(spark):
    rows = [(s, k * 10 + n) for k, (s, n_rows) in enumerate((("a", 37), ("b", 5), ("c", 90))) for n in range(n_rows * 100) if n % 100 == 0]
    df = spark.createDataFrame([(i, s) for s, i in rows], "doc_id long, source string")
    for weights in ({"a": 1, "b": 2, "c": 1}, {"a": 0.2, "c": 0.8}, None):
        got = sorted(tuple(r) for r in mixing.mixed(df, weights, block=4).select("doc_id", "source", "epoch", "block", "slot", "position").collect())
        exact = weights or mixing.shares(Counter(s for s, _ in rows), None)
        assert got == brute_mix([r for r in rows if r[0] in exact], exact, 4)


def test_mixing_equals_sql(spark, tmp_path):
    skewed = [(k, f"s{min(k % 17, 3)}") for k in range(700)] + [(1000 + k, None) for k in range(5)] + [(2000 + k, "tiny") for k in range(2)]
    spark.createDataFrame(skewed, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder, block in ((DATA, 3), (DATA, 64), (tmp_path, 5), (tmp_path, 64)):
        c = duckdb.connect()
        path = f"{folder}/documents.parquet"
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}{'/*.parquet' if folder == tmp_path else ''}'")
        got = mixing.mixed(spark.read.parquet(path), block=block).selectExpr("doc_id", "coalesce(source, '')", "epoch", "block", "slot", "position")
        assert sorted(tuple(r) for r in got.collect()) == sorted(c.execute(mixing.mixing_sql(block=block)).fetchall())


def test_mixing_of_odd_rows(odd, nothing):
    rows = mixing.mixed(odd, block=2).collect()
    first = Counter(r.doc_id for r in rows if r.epoch == 0)
    assert first == Counter(r.doc_id for r in odd.collect())
    assert len({r.position for r in rows}) == len(rows)
    assert mixing.mixed(nothing).count() == 0
    assert mixing.mixed(odd, {"nowhere": 1.0}).count() == 0
    assert mixing.mixed(odd.withColumn("slot", F.lit("x"))).columns[-4:] == ["epoch", "block", "slot", "position"]
    kept = mixing.repeated(odd.withColumn("slot", F.lit("x")), block=2)
    assert kept.columns == [*odd.columns, "slot"] and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows) and {r["slot"] for r in kept.collect()} == {"x"}


def test_mixing_keeps_the_weights_themselves(spark):
    weights = {"hot": 0.5} | {f"s{k:02}": 0.5 / 19 for k in range(19)}
    rows = [("hot", k) for k in range(3000)] + [(s, k) for s in weights if s != "hot" for k in range(3)]
    got = mixing.mixed(spark.createDataFrame(rows, "source string, doc_id long"), weights, block=1).select("slot", "source").collect()
    given = Counter()
    for t, (slot, s) in enumerate(sorted(tuple(r) for r in got), 1):
        assert slot == t - 1
        given[s] += 1
        assert all(abs(given[x] - w * t) < 1 + 1e-9 for x, w in weights.items())
    assert given["hot"] == 3000


def test_blocks_of_repeated_sources_are_full(spark):
    rows = [("a", k) for k in range(10)] + [("b", k) for k in range(65)] + [("c", k) for k in range(64 * 30)]
    weights = {"a": 0.3, "b": 0.3, "c": 0.4}
    got = mixing.mixed(spark.createDataFrame(rows, "source string, doc_id long"), weights).select("source", "doc_id", "epoch", "block", "slot", "position").collect()
    assert set(Counter(r.slot for r in got).values()) == {64}
    given, total = Counter(r.source for r in got), len(got)
    assert all(abs(given[s] - w * total) < 64 for s, w in weights.items())
    for s, n in (("a", 10), ("b", 65), ("c", 64 * 30)):
        mine = sorted((r for r in got if r.source == s), key=lambda r: r.position)
        assert [(r.doc_id, r.epoch, r.block) for r in mine] == [(k % n, k // n, k // 64) for k in range(len(mine))]
        assert all(r.position // 64 == r.slot for r in mine)
