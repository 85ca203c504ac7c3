import math
from dataclasses import replace

import numpy as np
import pytest

from fathomgrid.models import fitters, nuts, priors, samplers, simulate, sur


def data(n=4, k=3, t=60, seed=0, **kw):
    return simulate.simulate(n, k, t, seed=seed, **kw)


def test_cross_products_and_precision_equal_brute_force():
    s = data(3, 4, 20)
    g, fr = sur.cross_products(s.f, s.r)
    inverse = np.linalg.inv(s.sigma)
    big = np.zeros((3 * 20, 3 * 4))
    for i in range(3):
        big[i * 20 : (i + 1) * 20, i * 4 : (i + 1) * 4] = s.f[i]
    kron = np.kron(inverse, np.eye(20))
    np.testing.assert_allclose(sur.data_precision(s.f, s.sigma), big.T @ kron @ big, atol=1e-10)
    np.testing.assert_allclose(np.einsum("ij,ikj->ik", inverse, fr).ravel(), big.T @ kron @ s.r.ravel(), atol=1e-10)
    assert g.shape == (3, 4, 3, 4)


@pytest.mark.parametrize("n", [1, 63, 64, 200])
def test_triangles(n):
    rng = np.random.default_rng(n)
    low = np.tril(rng.normal(size=(n, n))) + n * np.eye(n)
    x = rng.normal(size=n)
    np.testing.assert_allclose(low @ sur.solve_lower(low, x), x, atol=1e-9)
    np.testing.assert_allclose(low.T @ sur.solve_transposed(low, x), x, atol=1e-9)


def test_likelihood_and_gradient():
    s = data(3, 2, 15)
    value, grad = sur.log_likelihood_gradient(s.r, s.f, s.b, s.sigma)
    e = s.r - sur.predict(s.f, s.b)
    direct = sum(-0.5 * (3 * math.log(2 * math.pi) + np.linalg.slogdet(s.sigma)[1] + e[:, t] @ np.linalg.inv(s.sigma) @ e[:, t]) for t in range(15))
    assert value == pytest.approx(direct)
    for i, j in ((0, 0), (2, 1)):
        b = s.b.copy()
        b[i, j] += 1e-6
        assert (sur.log_likelihood(s.r, s.f, b, s.sigma) - value) / 1e-6 == pytest.approx(grad[i, j], rel=1e-3, abs=1e-3)


def test_inverse_wishart_mean_and_density():
    rng = np.random.default_rng(0)
    scale = simulate.random_covariance(3, rng)
    x = np.stack([sur.inverse_wishart(12, scale, rng) for _ in range(6000)])
    np.testing.assert_allclose(x.mean(axis=0), scale / (12 - 4), atol=4 * x.std(axis=0).max() / math.sqrt(6000))
    one = sur.inverse_wishart_logpdf(np.array([[0.7]]), 5.0, np.array([[2.0]]))
    assert one == pytest.approx(2.5 * math.log(1.0) - math.lgamma(2.5) - 3.5 * math.log(0.7) - 1 / 0.7)
    low = np.linalg.cholesky(x[0])
    np.testing.assert_allclose(sur.unpacked(sur.packed(low), 3), low)
    # the Jacobian against numerical differences of vech(L L')
    p0, idx = sur.packed(low), np.tril_indices(3)
    f = lambda v: (sur.unpacked(v, 3) @ sur.unpacked(v, 3).T)[idx]
    j = np.stack([(f(p0 + 1e-6 * e) - f(p0 - 1e-6 * e)) / 2e-6 for e in np.eye(6)], axis=1)
    assert sur.cholesky_jacobian(low) == pytest.approx(np.linalg.slogdet(j)[1], abs=1e-5)


def test_prior_scales():
    s = data(5, 6, 80, dev_sd=0.3)
    p = priors.rescaled_prior(s.r, s.f, 0.05)
    assert priors.implied_r2(p, s.r, s.f) == pytest.approx(0.05, rel=1e-9)
    lasso = priors.lasso_prior(s.r, s.f, 0.05)
    assert priors.implied_r2(lasso, s.r, s.f) == pytest.approx(0.05, rel=1e-9)
    h = priors.sparse_prior(s.r, s.f, p0=2)
    assert priors.implied_m_eff(h, s.f, unit=True) == pytest.approx(2, rel=1e-9)
    assert priors.sparse_prior(s.r, s.f, p0=2, n_choice="NT").tau_0 == pytest.approx(h.tau_0 / math.sqrt(5))
    r = priors.sparse_prior(s.r, s.f, p0=2, nu=4.0)
    assert r.slab_variance == pytest.approx(2 * r.slab_scale**2) and 0 < priors.slab_reach(r.slab_variance, r.tau_0)[1] < 1
    d = priors.default_prior(s.r, 6)
    assert priors.coefficient_variance(d) == pytest.approx(0.103) and d.sigma_df == 7
    for bad in (lambda: priors.sparse_prior(s.r, s.f, p0=6), lambda: priors.sparse_prior(s.r, s.f, 2, n_choice="X"), lambda: priors.sparse_prior(s.r, s.f, 2, nu=2), lambda: priors.pooled_scale(s.r[:, :6], s.f[:, :6])):
        with pytest.raises(ValueError):
            bad()


def test_local_variance_has_its_moments():
    rng = np.random.default_rng(1)
    theta, s, rate = np.full(200_000, 0.3), 0.5, 2.0
    inverse = 1 / samplers.draw_local_variance(theta, s, rate, rng)
    assert inverse.mean() == pytest.approx(rate * s / 0.3, rel=0.02)  # inverse Gaussian mean
    assert inverse.var() == pytest.approx((rate * s / 0.3) ** 3 / rate**2, rel=0.05)
    assert np.isfinite(samplers.draw_local_variance(np.array([0.0, 1e-200, 1e3]), s, rate, rng)).all()


def test_rate_draw_matches_density():
    rng = np.random.default_rng(2)
    theta = rng.laplace(0, 0.2, (4, 5))
    x = np.array([samplers.draw_rate(theta, 1.0, 1.0, 0.05, rng) for _ in range(4000)])
    grid = np.linspace(0.01, 15, 4000)
    a = theta.size + 1
    dens = np.exp((a - 1) * np.log(grid) - np.abs(theta).sum() * grid - 0.05 * grid**2 - 30)
    mean = (grid * dens).sum() / dens.sum()
    assert x.mean() == pytest.approx(mean, rel=0.03)
    assert samplers.draw_rate_given_variance(np.ones(10), 1.0, 0.1, rng) > 0


def test_blocked_draw_has_exact_moments():
    s = data(3, 2, 40)
    d = samplers.Data(s.r, s.f, priors.rescaled_prior(s.r, s.f))
    st = samplers.start(d)
    st.sigma = s.sigma
    precisions = np.abs(np.random.default_rng(0).normal(2, 0.3, (3, 2)))
    rng = np.random.default_rng(1)
    kept = []
    for _ in range(6000):
        samplers.draw_coefficients(d, st, precisions, rng, True)
        kept.append(np.concatenate([st.b.ravel(), st.b_bar]))
    p = np.zeros((8, 8))
    p[:6, :6] = sur.data_precision(s.f, s.sigma) + np.diag(precisions.ravel())
    for i in range(3):
        p[2 * i : 2 * i + 2, 6:] = p[6:, 2 * i : 2 * i + 2] = -np.diag(precisions[i])
    p[6:, 6:] = np.diag(precisions.sum(axis=0)) + np.linalg.inv(d.prior.mean_cov)
    _, fr = sur.cross_products(s.f, s.r)
    rhs = np.concatenate([np.einsum("ij,ikj->ik", np.linalg.inv(s.sigma), fr).ravel(), np.zeros(2)])
    cov = np.linalg.inv(p)
    x = np.array(kept)
    np.testing.assert_allclose(x.mean(axis=0), cov @ rhs, atol=5 * np.sqrt(np.diag(cov) / 6000).max())
    np.testing.assert_allclose(np.cov(x.T), cov, atol=0.1 * cov.max())


@pytest.mark.parametrize("model", ["gaussian", "lasso", "horseshoe", "regularised"])
def test_samplers_recover_coefficients(model):
    s = data(4, 4, 300, seed=4, dev_sd=0.3)
    settings = {"target_r2": 0.9} | ({"p0": 2} if model in ("horseshoe", "regularised") else {})
    d = fitters.sampled(model, draws=400, burn=150, **settings)(s.r, s.f)
    b = d.fields["B"]
    assert b.shape == (250, 4, 4)
    assert np.corrcoef(b.mean(axis=0).ravel(), s.b.ravel())[0, 1] > 0.95
    np.testing.assert_allclose(d.fields["Sigma"].mean(axis=0), s.sigma, atol=0.5 * np.abs(s.sigma).max())
    again = fitters.sampled(model, draws=400, burn=150, **settings)(s.r, s.f)
    np.testing.assert_array_equal(b, again.fields["B"])


def test_sequential_and_blocked_agree():
    s = data(3, 3, 120, seed=6)
    # deviations of a size that lets the sequential scan mix
    p = replace(priors.rescaled_prior(s.r, s.f, 0.3), mean_cov=np.eye(3), dev_df=10.0, dev_scale=3 * np.eye(3))
    a, b = (samplers.run("gaussian", s.r, s.f, p, 2500, 500, 1, blocked=x).fields["B"].mean(axis=0) for x in (True, False))
    np.testing.assert_allclose(a, b, atol=0.05)


def test_wide_slab_is_the_plain_horseshoe():
    s = data(4, 5, 150, seed=8, deviations="sparse", dev_sd=0.5)
    base = priors.sparse_prior(s.r, s.f, p0=2, slab_scale=1e4, nu=4.0)
    reg = samplers.run("regularised", s.r, s.f, base, 900, 300, 3)
    plain = samplers.run("horseshoe", s.r, s.f, base, 900, 300, 3)
    np.testing.assert_allclose(reg.fields["B"].mean(axis=0), plain.fields["B"].mean(axis=0), atol=0.06)
    assert samplers.binding_summary(reg)["binding"] < 0.02


def test_slice_step_samples_its_target():
    rng = np.random.default_rng(5)
    x, kept = np.full(4000, 40.0), []
    for _ in range(30):
        x = samplers.slice_step(lambda z: -0.5 * z * z, x, rng)
        kept.append(x)
    assert abs(kept[-1].mean()) < 0.06 and kept[-1].std() == pytest.approx(1, abs=0.04)
    with pytest.raises(RuntimeError):
        samplers.slice_step(lambda z: np.zeros(z.shape), np.zeros(2), rng)


def test_budget_of_a_backtest():
    s = data(4, 3, 200, seed=9)
    full = fitters.sampled("gaussian", draws=900, burn=100, seed=1)(s.r, s.f).fields["B"].mean(axis=0)
    got = fitters.validate_budget(s.r, s.f, full, 800.0, draws=300, burn=100)
    assert got["max_z"] < 6 and got["within_3"] > 0.8 and got["corr"] > 0.99 and got["kept"] == 200


def horseshoe_data():
    s = data(3, 4, 90, seed=3, deviations="sparse", dev_sd=0.6)
    return s, priors.sparse_prior(s.r, s.f, p0=2, nu=4.0)


@pytest.mark.parametrize("model", ["horseshoe", "regularised"])
def test_nuts_gradient(model):
    s, p = horseshoe_data()
    target = nuts.Target(model, s.r, s.f, p)
    x = target.start() + 0.3 * np.random.default_rng(1).normal(size=target.size)
    value, grad = target(x)
    numeric = [(target(x + h)[0] - target(x - h)[0]) / 2e-5 for h in 1e-5 * np.eye(target.size)]
    assert math.isfinite(value)
    np.testing.assert_allclose(grad, numeric, rtol=1e-5, atol=1e-4)
    f = target.fields(x)
    assert (np.linalg.eigvalsh(f["Sigma"]) > 0).all() and f["B"].shape == (3, 4)
    assert target(np.full(target.size, 1e9))[0] == -math.inf


def test_nuts_density_of_a_wide_slab_is_the_plain_one():
    s, p = horseshoe_data()
    wide = replace(p, slab_scale=1e6)
    plain, slab = nuts.Target("horseshoe", s.r, s.f, wide), nuts.Target("regularised", s.r, s.f, wide)
    x = plain.start() + 0.1
    a = wide.slab_df / 2
    assert slab(np.append(x, 0.0))[0] - plain(x)[0] == pytest.approx(a * math.log(a) - math.lgamma(a) - a, abs=1e-6)


def test_nuts_samples_a_known_target():
    scale = np.array([0.1, 1.0, 20.0])
    x, stats = nuts.sample(lambda x: (-0.5 * float(((x / scale) ** 2).sum()), -x / scale**2), np.ones(3), 3000, 800, np.random.default_rng(2))
    np.testing.assert_allclose(x.std(axis=0), scale, rtol=0.1)
    assert (np.abs(x.mean(axis=0)) < 0.12 * scale).all()
    assert not stats["diverging"].any() and stats["tree_depth"].max() <= 10 and len(stats["energy"]) == 3000


@pytest.mark.parametrize("model", ["horseshoe", "regularised"])
def test_nuts_and_gibbs_agree(model):
    s, p = horseshoe_data()
    a = nuts.run(model, s.r, s.f, p, 700, 400, 1)
    b = samplers.run(model, s.r, s.f, p, 4000, 500, 2)
    np.testing.assert_allclose(a.fields["B"].mean(axis=0), b.fields["B"].mean(axis=0), atol=0.05)
    np.testing.assert_allclose(a.fields["Sigma"].mean(axis=0), b.fields["Sigma"].mean(axis=0), atol=0.12 * np.abs(s.sigma).max())
    assert np.log(a.fields["tau"]).mean() == pytest.approx(np.log(b.fields["tau"]).mean(), abs=0.4)
    again = nuts.run(model, s.r, s.f, p, 5, 5, 1)
    np.testing.assert_array_equal(again.fields["B"], nuts.run(model, s.r, s.f, p, 5, 5, 1).fields["B"])
    with pytest.raises(ValueError):
        nuts.run("lasso", s.r, s.f, p)


def test_nuts_statistics_as_rows(spark):
    s, p = horseshoe_data()
    df = fitters.chains(spark, "horseshoe", s.r, s.f, p, 2, 20, 20, 0, "nuts")
    stats = fitters.sampler_statistics(df).orderBy("chain", "draw").toPandas()
    assert len(stats) == 40 and stats["step_size"].gt(0).all() and stats["diverging"].dtype == bool


def test_sampler_errors():
    s = data()
    p = priors.rescaled_prior(s.r, s.f)
    for bad in (lambda: samplers.run("none", s.r, s.f, p), lambda: samplers.run("gaussian", s.r, s.f, p, 5, 5), lambda: samplers.run("gaussian", s.r[:, :9], s.f, p)):
        with pytest.raises(ValueError):
            bad()


def test_chains_as_rows(spark):
    s = data(3, 2, 40)
    df = fitters.chains(spark, "lasso", s.r, s.f, priors.lasso_prior(s.r, s.f), n=3, draws=12, burn=2)
    assert df.filter("field = 'B'").count() == 3 * 10 * 6 and df.filter("field = 'lam'").count() == 30
    assert df.filter("field = 'b_bar' and chain = 0 and draw = 0").count() == 2


def test_calibration_and_recovery(spark):
    rows = simulate.calibration(spark, "gaussian", 8, 4, 3, 80, 220, 60).toPandas()
    assert 0.8 < rows.cover_b.mean() <= 1 and len(rows) == 8
    summary = simulate.calibration_summary(simulate.calibration(spark, "lasso", 4, 4, 3, 60, 160, 60)).first()
    assert summary["n_used"] + summary["n_excluded"] == 4
    r = simulate.sparsity_recovery(spark, "horseshoe", 2, 4, 6, 120, 200, 80, p0=2).toPandas()
    assert (r.rmse_sparse < r.rmse_dense * 1.5).all()


def test_prior_predictive(spark):
    s = data(3, 5, 50)
    for p in (priors.sparse_prior(s.r, s.f, 2), priors.sparse_prior(s.r, s.f, 2, nu=4.0)):
        rows = simulate.prior_predictive(spark, p, s.f, float(s.r.var()), 40).toPandas()
        assert rows.m_eff.between(0, 5).all() and rows.r2.between(0, 1).all()


def test_simulated_panels(spark):
    df = simulate.simulated_panels(spark, 2, 3, 2, 10)
    assert df.count() == 60 and df.filter("f[0] = 1").count() == 60
    with pytest.raises(ValueError):
        simulate.simulate(2, 2, 5, deviations="other")


def test_sigma_reference_is_the_formula():
    s = data(3, 4, 60)
    low, scale = sur.sigma_reference(s.r, s.f)
    e = sur.residuals(s.r, s.f, priors.least_squares(s.r, s.f))
    e = e - e.mean(axis=1, keepdims=True)
    np.testing.assert_allclose(low @ low.T, e @ e.T / 59, atol=1e-12)
    want = [1 / math.sqrt(120) if i == j else low[j, j] / math.sqrt(60) for i in range(3) for j in range(i + 1)]
    np.testing.assert_allclose(scale, want, atol=1e-12)


def test_gradients_in_sigma():
    s = data(3, 2, 25)
    x = sur.packed(np.linalg.cholesky(s.sigma))
    scale = simulate.random_covariance(3, np.random.default_rng(4))
    f = lambda v: sur.log_likelihood(s.r, s.f, s.b, sur.unpacked(v, 3) @ sur.unpacked(v, 3).T)
    g = lambda v: sur.packed_inverse_wishart_logpdf(v, 9.0, scale)
    steps = 1e-6 * np.eye(6)
    low = sur.unpacked(x, 3)
    np.testing.assert_allclose(sur.packed_gradient(low, sur.log_likelihood_sigma_gradient(s.r, s.f, s.b, low @ low.T)), [(f(x + h) - f(x - h)) / 2e-6 for h in steps], rtol=1e-4, atol=1e-4)
    np.testing.assert_allclose(sur.packed_inverse_wishart_gradient(x, 9.0, scale), [(g(x + h) - g(x - h)) / 2e-6 for h in steps], rtol=1e-4, atol=1e-4)


def test_given_truth_is_used():
    cov, sigma, b_bar = np.diag([4.0, 1e-12]), np.diag([1.0, 2.0, 3.0]), np.array([5.0, -2.0])
    s = simulate.simulate(3, 2, 50, seed=1, deviations="sparse", b_bar=b_bar, dev_cov=cov, sigma=sigma)
    assert (s.sigma == sigma).all() and (s.b_bar == b_bar).all() and np.abs(s.theta[:, 1]).max() < 1e-5
    with pytest.raises(ValueError):
        simulate.simulate(3, 2, 50, sigma=np.eye(2))
    x = simulate.random_covariance(4, np.random.default_rng(0), extra=100_000)
    np.testing.assert_allclose(x, np.eye(4), atol=0.05)


def test_eigen_route_and_reference():
    s = data(3, 2, 50)
    assert sur.eigen_route(s.f, s.sigma) > 0
    low, scale = sur.sigma_reference(s.r, s.f)
    assert (np.diag(low) > 0).all() and (scale > 0).all() and len(scale) == 6
