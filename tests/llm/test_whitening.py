import numpy as np
import pytest

from logspark.llm import whitening as wh


def spectrum_error(values, vectors, matrix):
    scale = max(1e-300, np.abs(matrix).max())
    return max(
        np.abs(vectors @ np.diag(values) @ vectors.T - matrix).max() / scale,
        np.abs(vectors.T @ vectors - np.eye(len(values))).max(),
    )


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_changes(seed):
    """Plain values, equal ones, zero weights, tiny and huge changes."""
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 40))
    values = np.sort(rng.choice([0.0, 1.0, 1.0 + 1e-15, 2.0, 5.0], size) if seed % 2 else rng.exponential(1, size))
    vectors = np.linalg.qr(rng.normal(size=(size, size)))[0]
    matrix = vectors @ np.diag(values) @ vectors.T
    for step in range(60):
        change = rng.normal(size=size) * 10.0 ** rng.integers(-9, 3)
        if step % 5 == 0:
            change = vectors[:, rng.integers(size)] * 3
        if step % 7 == 0:
            change = vectors[:, : max(1, size // 2)] @ rng.normal(size=max(1, size // 2))
        matrix = matrix + np.outer(change, change)
        values, vectors = wh.rank_one(values, vectors, change)
        assert (np.diff(values) >= 0).all()
        assert spectrum_error(values, vectors, matrix) < 1e-12
    assert wh.rank_one(values, vectors, np.zeros(size))[0] is values


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(1)
    for count in (1, 2, 3, 50):
        poles = np.cumsum(10.0 ** rng.uniform(-9, 2, count))
        weights = 10.0 ** rng.uniform(-12, 2, count)
        away = wh.secular_roots(poles, weights)
        roots = poles[0] + away[:, 0]
        assert (away.diagonal() > 0).all() and (away[:-1].diagonal(1) < 0).all()
        assert roots[-1] <= poles[-1] + weights.sum() * (1 + 1e-12)
        # The product over roots gives the weights back.
        for j in range(count):
            product = 1.0
            for i in range(count):
                product *= away[i, j] / (poles[i] - poles[j] if i != j else 1)
            assert product == pytest.approx(weights[j], rel=1e-6)


def test_spectra_grow_and_merge():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 1e6
    whole = wh.Spectrum.empty(12)
    for at in range(0, 300, 70):
        part = wh.Spectrum.empty(12)
        for vector in x[at : at + 70]:
            part.add(vector)
        whole.merge(part)
    whole.merge(wh.Spectrum.empty(12))
    apart = x - x.mean(axis=0)
    assert whole.count == 300 and np.allclose(whole.mean, x.mean(axis=0), rtol=1e-13)
    assert spectrum_error(whole.values, whole.vectors, apart.T @ apart) < 1e-9


def frame(spark, vectors, ids=None):
    rows = list(zip(ids or range(len(vectors)), vectors, [None] * len(vectors), ["c"] * len(vectors)))
    return spark.createDataFrame(rows, "vec_id long, vector array<double>, x string, component string").repartition(3)


def check(found, vectors, components=16):
    """Rows against numpy's decomposition of the covariance of the distinct whole vectors."""
    x = {key: [int(np.floor(64 * c)) + 1_000_000 for c in vector] for key, vector in vectors.items()}
    distinct = np.array(sorted(set(map(tuple, x.values()))))
    n, sums = len(distinct), distinct.sum(axis=0)
    apart = (distinct * n - sums) / n
    values, basis = np.linalg.eigh(apart.T @ apart / n)
    values, basis = values[::-1], basis[:, ::-1]
    kept = min(components, int((values > 1e-10 * values.mean()).sum()))
    rows = {(row["vec_id"], row["component"]): row for row in found}
    assert len(rows) == len(found) == kept * len(x)
    signs = {}
    for (key, component), row in rows.items():
        e = values[component - 1]
        plain = (np.array(x[key]) * n - sums) / n @ basis[:, component - 1] / np.sqrt(e)
        if abs(plain) > 1e-3:
            signs.setdefault(component, np.sign(plain * row["whitened"]))
        assert row["whitened"] * signs.get(component, 1) == pytest.approx(plain, abs=1e-6)
        assert row["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[key], sums))
        assert row["n"] == n and row["explained"] == pytest.approx(e / values.sum(), rel=1e-9)
        assert row["identity_error"] < 1e-9
    assert len({row["identity_error"] for row in found}) <= 1


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = {at: (rng.normal(size=20) * np.arange(1, 21)).tolist() for at in range(90)}
    good |= {100 + at: good[0] for at in range(50)} | {200: [c + 1e-4 for c in good[1]]}
    bad = {300: None, 301: [], 302: [None, *good[0][1:]], 303: [float("nan"), *good[0][1:]], 304: [float("inf"), *good[0][1:]]}
    bad |= {305: [1.0] * 3, 306: [-float("inf")] * 20, 307: [1e300] * 20}
    every = good | bad
    found = wh.whiten(frame(spark, list(every.values()), list(every)), "vec_id", "vector").collect()
    check(found, good)


@pytest.mark.parametrize("count, size, left", [(1, 5, 0), (2, 5, 1), (4, 30, 3), (40, 3, 3)])
def test_few_vectors_and_few_entries(spark, count, size, left):
    rng = np.random.default_rng(count)
    vectors = {at: rng.normal(size=size).tolist() for at in range(count)}
    found = wh.whiten(frame(spark, list(vectors.values())), "vec_id", "vector").collect()
    assert {row["component"] for row in found} == set(range(1, left + 1))
    check(found, vectors)


def test_no_vectors(spark):
    assert wh.whiten(frame(spark, []), "vec_id", "vector").count() == 0
    assert wh.whiten(frame(spark, [None, [], [None]]), "vec_id", "vector").count() == 0
    assert wh.whiten(frame(spark, [[1.0, 2.0]] * 9), "vec_id", "vector").count() == 0


def test_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(20, 4)).tolist()
    found = wh.whiten(frame(spark, vectors + vectors[:1], [None, None, *[7] * 19]), "vec_id", "vector")
    assert found.count() == 21 * 4 and found.where("vec_id IS NULL").count() == 8


def test_wide_deviations():
    x = np.array([[2**40, 5], [-(2**29), 1]])
    model = wh.Whitening(3, np.array([1, 2]), np.ones(2), np.eye(2), 1.0)
    assert model.deviations(x) == [None, (3 * -(2**29) - 1) ** 2 + 1]


def test_op13(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    check(wh.op13_incremental_whitening(spark, sf_dir).collect(), {row["vec_id"]: row["embedding"] for row in rows})
