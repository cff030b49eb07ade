"""Block products and signal eigenvectors against numpy."""

import numpy as np
import pandas as pd
import pytest

from portica.operators import blocks, covariance, spectrum


def panel(n, t, seed, factors=3, gaps=0.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((t, factors)) @ (rng.standard_normal((factors, n)) * 1.5) + rng.standard_normal((t, n)) * rng.uniform(0.5, 2, n)
    rows = pd.DataFrame({"t": np.repeat(np.arange(t), n), "asset": np.tile([f"a{i:04d}" for i in range(n)], t), "ret": x.reshape(-1)})
    return rows[rng.random(len(rows)) >= gaps], x


def test_pairs_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ASSETS", 4)
    monkeypatch.setattr(blocks, "TIMES", 7)
    parts = [panel(13, 40, 1, gaps=0.3)[0].assign(k="x"), panel(3, 9, 2)[0].assign(k="y")]
    df = spark.createDataFrame(pd.concat(parts)).repartition(3)
    got = {(r.k, r.a, r.b): r for r in covariance.pair_moments(df, ["k"]).collect()}
    cov = {(r.k, r.a, r.b): (r.n, r.value) for r in covariance.cov_diagonal(df, ["k"], 0.0, 1.0).collect()}
    cor = {(r.k, r.a, r.b): r.value for r in covariance.correlation_matrix(df, ["k"]).collect()}
    for part in parts:
        k = part["k"].iloc[0]
        w = part.pivot(index="t", columns="asset", values="ret")
        z, names = w - w.mean(), sorted(w.columns)
        for i, a in enumerate(names):
            for b in names[i:]:
                both = z[[a, b]].dropna().to_numpy() if a != b else np.stack([z[a].dropna()] * 2, axis=1)
                if not len(both):
                    assert (k, a, b) not in got
                    continue
                x, y = both.T
                r = got[k, a, b]
                assert r.n == len(x)
                np.testing.assert_allclose((r.s11, r.s22, r.s31, r.s13), [(x**p * y**q).sum() for p, q in ((1, 1), (2, 2), (3, 1), (1, 3))], rtol=1e-9, atol=1e-9)
                if len(x) > 2:
                    assert cov[k, a, b][0] == len(x)
                    np.testing.assert_allclose(cov[k, a, b][1], np.cov(x, y)[0, 1], rtol=1e-9, atol=1e-12)
                    np.testing.assert_allclose(cor[k, a, b], np.corrcoef(x, y)[0, 1], rtol=1e-9)
    assert len(got) == 91 + 6
    assert "NestedLoop" not in (plan := covariance.pair_moments(df, ["k"])._jdf.queryExecution().toString()) and "Join" in plan


def test_panel_checks(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (2, "A", 2.0), (1, "B", 1.0), (1, "C", 3.0), (2, "C", 3.0)], "t int, asset string, ret double")
    assert sorted((r.asset, r.rule) for r in covariance.panel_checks(df, []).collect()) == [("B", "incomplete"), ("B", "no_variance"), ("C", "no_variance")]


def cleaned(x):
    t, n = x.shape
    z = x - x.mean(axis=0)
    s = z.T @ z / t
    sd = np.sqrt(np.diag(s))
    c = s / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(c)
    noise = values <= (1 + np.sqrt(n / t)) ** 2
    if noise.any() and not noise.all():
        values = np.where(noise, values[noise].mean(), values)
        d = vectors @ np.diag(values) @ vectors.T
        c = d / np.sqrt(np.outer(np.diag(d), np.diag(d)))
    return c * np.outer(sd, sd), values[~noise][::-1], vectors[:, ~noise][:, ::-1]


@pytest.mark.parametrize("case", ["factors", "keys"])
def test_random_matrix_covariance(spark, monkeypatch, case):
    monkeypatch.setattr(spectrum, "ASSETS", 16)
    monkeypatch.setattr(spectrum, "TIMES", 25)
    if case == "factors":  # more signals than the first columns
        made = {"x": panel(60, 400, 3, factors=14)}
    else:  # weak signals, none, more assets than times, one asset
        made = {"x": panel(40, 90, 4, 3), "none": panel(20, 300, 5, 0), "wide": panel(50, 12, 6, 2), "one": panel(1, 8, 7, 0)}
    df = spark.createDataFrame(pd.concat([rows.assign(k=k) for k, (rows, _) in made.items()])).repartition(3)
    found = spectrum.cov_random_matrix(df, ["k"], 1.0).toPandas()
    pairs = spectrum.signal_eigenpairs(df, ["k"]).toPandas()
    for k, (_, x) in made.items():
        want, values, vectors = cleaned(x)
        one = found[found["k"] == k]
        i, j = (one[c].str[1:].astype(int).to_numpy() for c in ("a", "b"))
        assert len(one) == x.shape[1] * (x.shape[1] + 1) // 2 and (i <= j).all() and set(one["n_signals"]) == {len(values)}
        np.testing.assert_allclose(one["value"], want[i, j], rtol=1e-6, atol=1e-7)
        mine = pairs[pairs["k"] == k]
        assert sorted(mine["rank"].unique()) == list(range(1, len(values) + 1))
        for r, v in enumerate(values):
            vec = mine[mine["rank"] == r + 1].sort_values("asset")
            np.testing.assert_allclose(vec["eigenvalue"], v, rtol=1e-9)
            assert abs(abs(vec["loading"].to_numpy() @ vectors[:, r]) - 1) < 1e-8


def test_more_assets_than_times_in_many_blocks(spark, monkeypatch):
    """Keys solved over their times: in one block and in several, with signals and without; nothing kept outgrows the panel."""
    for name, size in (("ASSETS", 8), ("TIMES", 7), ("SIDE", 2), ("SPANS", 2), ("CELLS", 50)):
        monkeypatch.setattr(spectrum, name, size, raising=False)
    made = {"one": panel(70, 6, 8, 2), "many": panel(60, 16, 9, 1), "none": panel(12, 10, 10, 0)}
    df = spark.createDataFrame(pd.concat([rows.assign(k=k) for k, (rows, _) in made.items()])).repartition(3)
    kept, save = [], spectrum.saved
    monkeypatch.setattr(spectrum, "saved", lambda d: kept.append(save(d)) or kept[-1])
    found = spectrum.cov_random_matrix(df, ["k"], 1.0)
    cells = [d.selectExpr(f"SUM(LENGTH({c})) / 8").first()[0] for d in kept for c, kind in d.dtypes if kind == "binary"]
    assert max(cells) <= sum(x.size for _, x in made.values())
    found = found.toPandas()
    for k, (_, x) in made.items():
        want, values, _ = cleaned(x)
        one = found[found["k"] == k]
        i, j = (one[c].str[1:].astype(int).to_numpy() for c in ("a", "b"))
        assert len(set(zip(i, j, strict=True))) == len(one) == x.shape[1] * (x.shape[1] + 1) // 2 and (i <= j).all() and set(one["n_signals"]) == {len(values)}
        np.testing.assert_allclose(one["value"], want[i, j], rtol=1e-6, atol=1e-7)
    assert [len(cleaned(x)[1]) > 0 for _, x in made.values()] == [True, True, False]


def test_diagonal_of_random_matrix_covariance(spark):
    rows, x = panel(30, 9, 11, 2)
    df = spark.createDataFrame(rows)
    got = spectrum.cov_random_matrix(df, [], 2.0, diagonal=True).toPandas()
    whole = spectrum.cov_random_matrix(df, [], 2.0).where("a = b").toPandas()
    assert len(got) == 30 and (got["a"] == got["b"]).all()
    pd.testing.assert_frame_equal(got.sort_values("a", ignore_index=True), whole.sort_values("a", ignore_index=True), check_exact=False, rtol=1e-12)
