import numpy as np
import pytest

from vellumine.llm import ann


def test_chi_square():
    assert ann.chi_square(7.344, 8) == pytest.approx(0.5, abs=1e-3)
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert ann.chi_square_quantile(0.9, 2) == pytest.approx(4.605, abs=1e-3)


def truth(ids, x, k):
    d = ((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return {i: set(ids[np.argsort(r)[:k]].tolist()) for i, r in zip(ids, d, strict=True)}


@pytest.mark.parametrize("kind", ["flat", "clusters", "data"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "data":
        df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
        rows = df.toPandas()
        ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float32)
    else:
        x = rng.standard_normal((900, 24)).astype(np.float32)
        if kind == "clusters":
            x = (x[rng.integers(0, 12, 900)] * 4 + x * 0.3).astype(np.float32)
        ids = np.arange(900) * 3
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.neighbours(df, cell=150).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.distance)
    want = truth(ids, x, 10)
    assert set(got) == set(want)
    assert np.mean([len(want[i] & {n for n, _ in got[i].values()}) / 10 for i in want]) >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    for i in list(got)[:50]:
        found = [got[i][k] for k in sorted(got[i])]
        assert [d for _, d in found] == sorted(d for _, d in found)
        assert all(abs(np.linalg.norm(x[at[i]] - x[at[n]]) - d) < 1e-2 for n, d in found)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (None, [0.0, 1.0]), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, p string, cell int")
    got = sorted((r.vec_id, r.rank, r.neighbour_id, round(r.distance, 4)) for r in ann.neighbours(df, k=2).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 9, 1.0), (2, 1, 9, 0.0), (2, 2, 1, 1.0), (3, 1, 1, 2.0), (3, 2, 2, 2.2361), (9, 1, 2, 0.0), (9, 2, 1, 1.0)]
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.where("vec_id = 3")).count() == 0


def test_text_ids_and_huge_coordinates(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 6)).astype(np.float32)
    names = [f"v{k:03}" for k in range(120)]
    for scale in (1.0, 1e30):
        big = (x * np.float32(scale)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist(), 1, "c") for i, v in zip(names, big, strict=True)], "vec_id string, embedding array<float>, id int, cell string")
        got = {}
        for r in ann.neighbours(df, k=3).collect():
            got.setdefault(r.vec_id, {})[r.rank] = (r.neighbour_id, r.distance)
        at = {n: k for k, n in enumerate(names)}
        for n in names:
            d = np.linalg.norm(x.astype(np.float64) - x[at[n]].astype(np.float64), axis=1)
            d[at[n]] = np.inf
            assert [got[n][k][0] for k in (1, 2, 3)] == [names[j] for j in np.argsort(d)[:3]]
            assert abs(got[n][1][1] / scale - d.min()) < 1e-3
    assert ann.neighbours(df.limit(0)).schema["vec_id"].dataType.typeName() == "string"


def test_crowded_cells_are_copied_and_others_are_not(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    key = lambda rows: sorted((r.vec_id, r.rank, r.neighbour_id) for r in rows)
    assert key(ann.neighbours(df, cell=100, share=40).collect()) == key(ann.neighbours(df, cell=100).collect())
