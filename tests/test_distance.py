"""Measures against small NumPy computations, and results over tables."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silovalue.operators import distance as X, reduce as R, stats as C


def silos(spark, sizes, d=3, seed=0, shift=0.3):
    random = np.random.RandomState(seed)
    data, kept, i = [], {}, 0
    for s, n in enumerate(sizes):
        x = random.normal(size=(n, d)) * (1 + 0.2 * s) + shift * s
        kept[str(s)] = x
        for row in x:
            data.append((i, s, [float(v) for v in row]))
            i += 1
    kept["Global"] = np.vstack([kept[str(s)] for s in range(len(sizes))])
    return spark.createDataFrame(data, "row_id bigint, client_id bigint, features array<double>"), kept


def table(df, column="value"):
    return {(r.src, r.tgt): r[column] for r in df.collect()}


def mmd(x, y, sigma):
    k = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * sigma**2)).mean()
    return 0.5 * (k(x, x) + k(y, y)) - k(x, y)


@pytest.mark.parametrize("sigma", [0.05, 0.7])
def test_mmd_equals_all_pairs(spark, sigma, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 7)
    monkeypatch.setattr(X, "TILE_BLOCKS", 2)
    df, kept = silos(spark, [40, 25, 10])
    found = table(X.gaussian_mmd(df, sigma=sigma))
    assert len(found) == 12
    for (s, t), v in found.items():
        assert v == pytest.approx(mmd(kept[s], kept[t], sigma), abs=1e-12)


def test_mmd_with_a_crowd_of_copies(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 5)
    monkeypatch.setattr(X, "TILE_BLOCKS", 2)
    data = [(i, i % 2, [0.25, 0.5]) for i in range(30)] + [(30 + i, i % 2, [float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(data, "row_id bigint, client_id bigint, features array<double>")
    kept = {str(s): np.array([f for _, c, f in data if c == s]) for s in (0, 1)}
    kept["Global"] = np.array([f for _, _, f in data])
    for (s, t), v in table(X.gaussian_mmd(df, sigma=0.2)).items():
        assert v == pytest.approx(mmd(kept[s], kept[t], 0.2), abs=1e-12)


def test_mmd_leaves_out_rows_without_a_vector(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 4)
    rng = np.random.RandomState(2)
    data = [(None if i % 3 else 1, None if i % 4 == 0 else i % 4, rng.normal(size=2).tolist()) for i in range(50)]
    df = spark.createDataFrame(data + [(90, 1, None), (91, 2, None)], "row_id bigint, client_id bigint, features array<double>")
    kept = {str(s): np.array([f for _, c, f in data if c == s]) for s in (1, 2, 3)}
    kept["Global"] = np.array([f for _, _, f in data])
    found = table(X.gaussian_mmd(df, sigma=0.3))
    for s, t in itertools.product(("1", "2", "3"), kept):
        assert found[s, t] == pytest.approx(mmd(kept[s], kept[t], 0.3), abs=1e-12)


def test_mmd_pairs_of_tiles_are_worked_out_once_in_bounded_groups():
    """A task holds the blocks of one tile; those of the other are streamed past it, and few near pairs cost few exponents."""
    rng = np.random.RandomState(0)
    x, y, z = rng.normal(size=(12, 2)), rng.normal(size=(11, 2)), rng.normal(size=(4, 2))
    names = lambda v: ["b" if i % 2 else "a" for i in range(len(v))]
    rows = [("p", 0, False, x), ("p", 0, False, z), ("p", 1, False, y), ("q", 0, True, x), ("q", 0, True, y)]
    batch = pa.RecordBatch.from_pylist([
        {"key": k, "side": s, "alone": o, "silos": names(v), "flat": v.ravel().tolist()} for k, s, o, v in rows])
    for least in (-1e9, -1e-9):  # the second takes the sparse way: only a vector with itself is near
        found = {}
        for out in X._kernel_sums(iter([batch]), -0.5, least):
            for r in out.to_pylist():
                found[r["src"], r["tgt"]] = r["value"]
        expected = dict.fromkeys(itertools.product("ab", "ab"), 0.0)
        for left, right in [(x, y), (y, x), (z, y), (y, z), (x, x), (y, y), (x, y), (y, x)]:
            for (s, u), (t, v) in itertools.product(zip(names(left), left), zip(names(right), right)):
                gap = ((u - v) ** 2).sum()
                expected[s, t] += np.exp(-0.5 * gap) if -0.5 * gap >= least else 0.0
        assert found == pytest.approx(expected)


def test_narrow_kernel_sees_only_the_row_itself(spark):
    df, kept = silos(spark, [50, 30], d=20)
    found = table(X.gaussian_mmd(df, sigma=0.05))
    assert found["0", "1"] == pytest.approx(0.5 * (1 / 50 + 1 / 30)) and found["0", "0"] == pytest.approx(0, abs=1e-15)


def test_random_features_near_the_exact_kernel(spark):
    df, kept = silos(spark, [60, 40])
    w = np.random.RandomState(1).normal(scale=1 / 0.7, size=(2000, 3))
    for (s, t), v in table(X.gaussian_mmd_rff(df, w)).items():
        assert v == pytest.approx(mmd(kept[s], kept[t], 0.7), abs=0.02)


def test_sinkhorn_is_exact_for_few_rows_and_close_when_quantised(spark):
    df, kept = silos(spark, [30, 20], d=2, shift=2.0)
    exact = table(X.wasserstein_sinkhorn(df, points=64))
    assert exact["0", "0"] == pytest.approx(0, abs=1e-9)
    assert exact["0", "1"] == pytest.approx(exact["1", "0"], rel=1e-6)
    n = 30 * 20
    a, b = np.repeat(kept["0"], 20, axis=0), np.repeat(kept["1"], 30, axis=0)
    assert len(a) == len(b) == n
    coarse = table(X.wasserstein_sinkhorn(df, points=12))
    assert coarse["0", "1"] == pytest.approx(exact["0", "1"], rel=0.15)


def test_sinkhorn_of_two_points():
    one = lambda v: np.array([[v]])
    assert X.sinkhorn_divergence(one(0.0), np.ones(1), one(3.0), np.ones(1)) == pytest.approx(4.5)


def test_sinkhorn_near_sorted_matching_on_a_line():
    random = np.random.RandomState(2)
    x, y = np.sort(random.normal(size=40)), np.sort(random.normal(size=40) + 1)
    w = np.full(40, 1 / 40)
    found = 2 * X.sinkhorn_divergence(x[:, None], w, y[:, None], w)
    assert found == pytest.approx(((x - y) ** 2).mean(), rel=0.02)


def line_coupling(x, y):
    x, y, i, j, p = sorted(x), sorted(y), 0, 0, {}
    left, right = 1 / len(x), 1 / len(y)
    while i < len(x) and j < len(y):
        m = min(left, right)
        p[x[i], y[j]] = p.get((x[i], y[j]), 0) + m
        left, right = left - m, right - m
        if left < 1e-12:
            i, left = i + 1, 1 / len(x)
        if right < 1e-12:
            j, right = j + 1, 1 / len(y)
    return p


@pytest.mark.parametrize("cells", [4, 1024])
def test_line_transport_with_many_ties(spark, cells):
    random = np.random.RandomState(3)
    x = [2.0] * 30 + [float(v) for v in random.randint(0, 9, 60)]
    y = [float(v) for v in random.randint(0, 12, 70)]
    frame = lambda v: spark.createDataFrame([(e,) for e in v], "value double")
    found = {(r.src_value, r.tgt_value): r.mass for r in X.transport_1d(frame(x), frame(y), cells=cells).collect()}
    want = {k: v for k, v in line_coupling(x, y).items() if v > 1e-12}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_line_transport_leaves_missing_values_out(spark):
    frame = lambda v: spark.createDataFrame([(e,) for e in v], "value double")
    found = X.transport_1d(frame([1.0, None, float("nan"), 2.0]), frame([3.0, None]), cells=8).collect()
    assert sum(r.mass for r in found) == pytest.approx(1) and {(r.src_value, r.tgt_value) for r in found} == {(1.0, 3.0), (2.0, 3.0)}


def test_sliced_distance_of_shifted_copies(spark):
    random = np.random.RandomState(4)
    x = random.normal(size=(200, 2))
    data = [(i, 0, [float(a), float(b)]) for i, (a, b) in enumerate(x)] + [(200 + i, 1, [float(a) + 3, float(b)]) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(data, "row_id bigint, client_id bigint, features array<double>")
    found = table(X.wasserstein_sliced(df, np.eye(2)))
    assert found["0", "1"] == pytest.approx(9 / 2) and found["0", "0"] == 0


def test_relevance_and_diversity(spark):
    df, kept = silos(spark, [50, 40, 30])
    found = {(r.src, r.tgt): (r.relevance, r.diversity) for r in X.relevance_diversity(df).collect()}
    for s, t in found:
        a, b = np.cov(kept[s].T), np.cov(kept[t].T)
        a, b = a.T @ a / len(kept[s]), b.T @ b / len(kept[t])
        values, vectors = np.linalg.eigh(a)
        norms = np.array([np.linalg.norm(b @ v) for v in vectors.T])
        low, high = np.minimum(values, norms), np.maximum(values, norms)
        assert found[s, t][0] == pytest.approx(np.prod((low / high) ** (1 / 3)))
        assert found[s, t][1] == pytest.approx(np.prod((abs(values - norms) / high) ** (1 / 3)), abs=1e-4)
    assert found["0", "0"][0] == pytest.approx(1)
    legacy = table(X.relevance_diversity(df, legacy=True), "relevance")
    assert legacy["0", "0"] < 1


def test_volumes(spark):
    df, kept = silos(spark, [50, 40])
    for r in X.volume(df).collect():
        assert r.value == pytest.approx(math.sqrt(np.linalg.det(kept[r.client_id].T @ kept[r.client_id]) + 1e-8))
    for r in X.robust_volume(df, 0.5).collect():
        x = kept[r.client_id]
        cells = {}
        for row, cell in zip(x, np.floor((x - x.min(axis=0)) / 0.5).astype(int)):
            cells.setdefault(tuple(cell), []).append(row)
        means = np.array([np.mean(v, axis=0) for v in cells.values()])
        alpha = 1 / (10 * len(cells))
        weight = np.prod([(1 - alpha ** (len(v) + 1)) / (1 - alpha) for v in cells.values()])
        assert r.value == pytest.approx(math.sqrt(np.linalg.det(means.T @ means) + 1e-8) * weight, abs=1e-3)


def test_principal_components(spark):
    df, kept = silos(spark, [60, 40], d=4)
    fitted = X.pca_fit(df, 2)
    for r in fitted.collect():
        x = kept[r.client_id]
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        values, vectors = np.linalg.eigh(z.T @ z / len(z))
        assert r.variance == pytest.approx(values[-1 - r.component])
        assert abs(np.dot(r.loadings, vectors[:, -1 - r.component])) == pytest.approx(1)
    rows = X.pca_transform(df, fitted, "Global").orderBy("row_id").collect()
    scores = np.array([r.scores for r in rows])
    assert scores.mean(axis=0) == pytest.approx([0, 0], abs=1e-9)


def test_projections_separate_classes(spark):
    random = np.random.RandomState(6)
    data = [(i, i % 3, [float(v) for v in random.normal(size=4) * [5, 1, 1, 1] + np.array([0, 0, 4.0, 0]) * (i % 3)]) for i in range(150)]
    df = spark.createDataFrame(data, "row_id bigint, label int, features array<double>")
    flat = np.array([r.scores for r in R.pca_project(df, 2).orderBy("row_id").collect()])
    x = np.array([f for _, _, f in data])
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))
    assert flat.var(axis=0) == pytest.approx(values[::-1][:2])
    found = np.array([r.scores for r in R.lda_project(df, 2).orderBy("row_id").collect()])
    y = np.array([c for _, c, _ in data])
    means = [found[y == c, 0].mean() for c in range(3)]
    assert min(abs(a - b) for a, b in itertools.combinations(means, 2)) > 3 * max(found[y == c, 0].std() for c in range(3))


def test_entropy_of_a_silo_with_itself_is_the_offset(spark):
    df = spark.createDataFrame([(i, 0, i % 6) for i in range(60)], "row_id bigint, client_id bigint, label int")
    found = table(X.negative_conditional_entropy(df))
    assert found["0", "0"] == pytest.approx(5e-20 * math.log(1e-20), rel=1e-6)


def entropy(source, target):
    joint = np.zeros((max(target) + 1, max(source) + 1))
    for s, t in zip(source, target):
        joint[t, s] += 1 / len(source)
    pz = joint.sum(axis=0)
    total = 0.0
    for z in range(joint.shape[1]):
        if pz[z]:
            p = joint[:, z] / pz[z] + 1e-20
            total += pz[z] * (p * np.log(p)).sum()
    return total


def test_entropy_stops_at_the_shorter_side(spark):
    random = np.random.RandomState(7)
    labels = [(i, 0 if i < 30 else 1, int(random.randint(0, 3 if i < 30 else 4))) for i in range(80)]
    df = spark.createDataFrame(labels, "row_id bigint, client_id bigint, label int")
    a, b, g = [l for _, c, l in labels if c == 0], [l for _, c, l in labels if c == 1], [l for _, _, l in labels]
    found = table(X.negative_conditional_entropy(df))
    assert found["0", "1"] == pytest.approx(entropy(a, b)) and found["1", "0"] == pytest.approx(entropy(b, a))
    assert found["0", "Global"] == pytest.approx(entropy(a, g)) and found["1", "Global"] == pytest.approx(entropy(b, g))


def test_hellinger_bounds(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (2, "a"), (2, "b")], "client_id int, label string")
    found = table(X.hellinger(df))
    assert found["0", "1"] == pytest.approx(1) and found["0", "0"] == 0 and found["0", "2"] == pytest.approx(found["2", "0"])


def test_equal_accuracies_give_no_shift(spark):
    cell = spark.createDataFrame([("a", "b", 1.0, 10, 5, 1.0, 10, 5)], "src string, tgt string, w_s double, n_s int, hit_s int, w_t double, n_t int, hit_t int")
    r = X.shared_density_ratio(cell).first()
    assert r.degradation == 0 and r["shift"] is None


def t_tail(t, df):
    x = np.linspace(abs(t), 4000, 4_000_001)
    density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    return 2 * np.trapezoid(density, x)


@pytest.mark.parametrize("n", [4, 5, 6, 7, 12, 25])
def test_p_values_of_pearson(spark, n):
    df = spark.createDataFrame([(0.45, n)], "r double, n int")
    t = 0.45 * math.sqrt((n - 2) / (1 - 0.45**2))
    assert C.pearson_p_value(df).first().p == pytest.approx(t_tail(t, n - 2), abs=2e-3 if n < 5 else 1e-5)


def test_perfect_and_missing_correlation(spark):
    df = spark.createDataFrame([(1.0, 5), (None, 5)], "r double, n int")
    assert [r.p for r in C.pearson_p_value(df).collect()] == [0.0, None]


def test_permutations_by_hand():
    x, y = np.array([1.0, 2, 3, 4]), np.array([1.0, 2, 4, 3])
    r, p = C.permutation_p(x, y)
    null = [np.corrcoef(x[list(o)], y)[0, 1] for o in itertools.permutations(range(4))]
    assert r == pytest.approx(0.8) and p == pytest.approx(2 * np.mean(np.array(null) >= 0.8 - 1e-9))
    assert C.permutation_p(np.arange(9.0), np.arange(9.0))[1] == pytest.approx(2 / 10_000)
    assert C.permutation_p(np.ones(4), y) == (None, None)


def test_values_of_losses_correlate_per_side(spark):
    sv = [(e, c, "Accuracy", float(c * (1 if e == "Global" else -1))) for e in ("Global", "0", "1") for c in range(4)]
    dist = [("hellinger", str(c), e, float(c) + 0.1 * (c % 2)) for e in ("Global", "0", "1") for c in range(4)]
    found = C.sv_distance_correlation(
        spark.createDataFrame(sv, "evaluator string, client_id int, metric string, value double"),
        spark.createDataFrame(dist, "measure string, src string, tgt string, value double"),
    ).collect()
    r = {x.side: x.r for x in found}
    assert r["Centralized"] > 0.99 and r["Decentralized"] < -0.99


def test_nonfinite_becomes_zero(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.0,)], "value double")
    assert [r.value for r in C.clean_nonfinite(df).collect()] == [0.0, 0.0, 0.0, 2.0]


def test_summary_skips_missing(spark):
    df = spark.createDataFrame([("a", v) for v in (0.1, 0.2, 0.3, 0.4, 0.5, None)], "k string, r double")
    r = C.correlation_summary(df, ["k"]).first()
    assert (r.n, r.min, r.q1, r["median"], r.q3, r.max) == (5, 0.1, 0.2, 0.3, 0.4, 0.5)
    assert C.correlation_summary(df, ["k"], F.col("r") > 0.25).first().n == 3
