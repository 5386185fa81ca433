"""Both vector searches against brute force, with null, zero, infinite, equal and tied vectors."""

import numpy as np
import pytest

from caregrid.llm import ann, topk


def vectors(spark, n=1500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 2:] = x[7]  # half of all rows are one vector
    rows = [(i, [float(a) for a in v], "?") for i, v in enumerate(x)]
    rows += [(5000, None, "?"), (5050, [0.0] * dim, "?"), (5100, [float("nan")] * dim, "?"), (5150, [None] * dim, "?"), (5200, [float("inf")] + [1.0] * (dim - 1), "?"),
             (5250, [], "?"), (None, [1.0] * dim, "?"), (50, [float(a) for a in x[50]], "?"), (5300, [1.0, 2.0], "?"), (5350, [2.0, 1.0], "?")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string"), rows


def usable(rows, zero):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and all(a is not None and np.isfinite(a) for a in v) and (zero or any(v)):
            out[i] = np.array(v, np.float64)
    return out


def brute(rows, score, zero, k=5):
    own, out = usable(rows, zero), {}
    for q in own:
        if q % 50 == 0:
            s = sorted((-score(own[q], v), i) for i, v in own.items() if i != q and len(v) == len(own[q]))[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


@pytest.mark.parametrize("blocks", [{}, {"rows": 100, "queries": 7}])
def test_top_products_are_exact(spark, blocks):
    df, rows = vectors(spark)
    quantised = lambda v: np.floor(256 * v).astype(np.int64)
    want = brute(rows, lambda a, b: int(quantised(a) @ quantised(b)), True)
    got = {}
    for r in sorted(topk.top_products(df, **blocks).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: v for q, v in want.items() if v}
    assert topk.top_products(df.where("false")).count() == 0


def test_rounds_stop_on_proof_only():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-256, 256, (3000, 24)), rng.integers(-256, 256, (20, 24))
    q[0], x[:5] = 0, 0
    for rounds, cost in ((topk.LEVELS, topk.COST), (topk.LEVELS, 0.0), ((0.0, -0.1), 0.0), ((0.9, 0.5, 0.25, 0.1), 1.0), ((), 1.0)):
        i, _, s = topk.saat_best(rounds, cost)(q, x, 6)
        assert all((np.sort(q[k] @ x.T)[::-1][:6] == s[i == k]).all() for k in range(20))


def test_skewed_impacts_stop_early():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((4000, 24)) * np.exp(-np.arange(24) / 2)).astype(np.int64)
    index = topk.Index(x)
    for w in x[:20]:
        best = np.sort(x @ w)[::-1][:6]
        member = index.members(w, 6, topk.LEVELS, topk.COST)
        assert (np.sort(x[member] @ w)[::-1][:6] == best).all()
    assert index.read < 0.3 * index.there
    members = [len(index.members(w, 6, topk.LEVELS, topk.COST)) for w in x[:20]]
    assert np.mean(members) < 0.2 * len(x)


@pytest.mark.parametrize("size", [1e6, 1e7])
def test_large_components_do_not_overflow(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, (size * rng.standard_normal(64) * 0.2).tolist()) for i in range(300)]
    want = {}
    exact = [[int(np.floor(256 * a)) for a in v] for _, v in rows]
    for i in range(0, 300, 50):
        s = sorted((-sum(a * b for a, b in zip(exact[i], v, strict=True)), j) for j, v in enumerate(exact) if j != i)[:5]
        want[i] = [(j, -x) for x, j in s]
    got = {}
    for r in sorted(topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want


def test_nearest_recall_and_scores(spark):
    df, rows = vectors(spark, dim=32)
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    want, got = brute(rows, cosine, False), {}
    own = usable(rows, False)
    for r in sorted(ann.nearest(df, rows=400, queries=16).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(cosine(own[r["query_id"]], own[r["vec_id"]]), abs=1e-12)
    assert set(got) == {q for q, v in want.items() if v}
    recall = np.mean([len({i for i, _ in want[q]} & set(got[q])) / len(want[q]) for q in got])
    assert recall >= 0.9
    ties = [q for q in got if q >= 750 and q < 1500]
    assert all(got[q] == [i for i, _ in want[q]] for q in ties) and ties
    assert ann.nearest(df.where("false")).count() == 0


def test_few_rows_give_all_of_them(spark):
    v = np.random.default_rng(5).standard_normal((3, 64))
    rows = [(50 * i, x.tolist()) for i, x in enumerate([*v, -v[0], -v[1]])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got == {q: {i for i, _ in rows} - {q} for q, _ in rows}


def test_probe_sets_come_in_order_of_expected_cost():
    s = ann.probe_sets(6, 40)
    assert len(s) == 40 and not s[0].any() and len({r.tobytes() for r in s}) == 40
    assert not (s[:, :6] & s[:, 6:][:, ::-1]).any()


def test_a_score_beyond_a_long_is_an_error(spark):
    rows = [(i, [1e16 + 64 * i] * 8) for i in range(9)]
    with pytest.raises(Exception, match="range of a long"):
        topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
