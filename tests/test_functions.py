import math

import numpy as np
import pytest

from gaussmill.functions import kernels as K
from gaussmill.functions import priors as P
from gaussmill.functions.basis import Basis, monomials
from gaussmill.functions.special import ball_radius, ball_volume, normal_quantile

KERNELS = [K.Exponential(), K.SquareExponential(), K.Linear(), K.RationalQuadratic(1.2), K.Matern(0.5), K.Matern(1.2), K.Matern(1.5), K.Matern(2.5), K.Matern(3.3), K.Matern(200.0)]


@pytest.mark.parametrize("kernel", KERNELS, ids=str)
def test_kernel_derivatives_match_differences(kernel):
    x, h = np.array([0.3, 0.5, 0.8]), 1e-4
    assert np.allclose(kernel(x, 1), (kernel(x + h) - kernel(x - h)) / (2 * h), atol=1e-6)
    assert np.allclose(kernel(x, 2), (kernel(x + h) - 2 * kernel(x) + kernel(x - h)) / h**2, atol=1e-5)


@pytest.mark.parametrize("nu", [0.5, 1.5, 2.5])
def test_general_matern_equals_closed_forms(nu):
    x = np.array([0.0, 0.01, 0.5, 2.0])
    for k in range(3):
        skip = 1 if nu == 0.5 and k else 0  # no derivative at 0
        assert np.allclose(K.Matern(nu, general=True)(x, k)[skip:], K.Matern(nu)(x, k)[skip:], atol=1e-9)


def test_kernel_errors_and_reach():
    with pytest.raises(NotImplementedError):
        K.Exponential()(np.array([1.0]), 3)
    with pytest.raises(ValueError):
        K.Matern("a")
    with pytest.raises(ValueError):
        K.RationalQuadratic(None)
    for kernel in KERNELS:
        r = kernel.reach(0.3)
        assert float(kernel(np.array([r * (1 - 1e-9)]))[0]) >= 0.3 - 1e-8
        assert float(kernel(np.array([r * (1 + 1e-6)]))[0]) < 0.3
    assert K.Linear().reach(0.0) == math.inf


def test_kernel_table(spark):
    rows = K.SquareExponential().table(spark, points=50).dropna().collect()
    assert len(rows) == 48
    assert max(abs(r.d1 - r.n1) for r in rows) < 1e-2


PRIORS = [P.Uniform(0.2, 0.9), P.Normal(1.0, 3.0), P.Normal(0.0, 2.0, half=True), P.Cauchy(1.0, 2.0), P.StudentT(4.0), P.Erlang(2, 4.0), P.Gamma(2.0, 4.0), P.Gamma(3.7, 2.0), P.InverseGamma(4.0, 2.0), P.BetaPrime(2.0, 4.0)]


@pytest.mark.parametrize("prior", PRIORS, ids=str)
def test_prior_derivatives_match_differences(prior):
    h = 1e-4
    for x in (0.35, 0.5, 0.8):
        d = [float(prior.density(np.array(x + k * h))) for k in (-1, 0, 1)]
        assert float(prior.density(np.array(x), 1)) == pytest.approx((d[2] - d[0]) / (2 * h), abs=1e-5)
        assert float(prior.density(np.array(x), 2)) == pytest.approx((d[2] - 2 * d[1] + d[0]) / h**2, abs=1e-4)
        t = math.log10(x)
        f = [prior.log_pdf([t + k * h]) for k in (-1, 0, 1)]
        assert prior.log_pdf_jacobian([t])[0] == pytest.approx((f[2] - f[0]) / (2 * h), abs=1e-4)
        assert prior.log_pdf_hessian([t])[0, 0] == pytest.approx((f[2] - 2 * f[1] + f[0]) / h**2, abs=1e-3)


def test_priors_at_zero_and_outside():
    assert P.Gamma(1.0, 4.0).pdf([0.0])[0] == pytest.approx(4.0)
    assert P.Gamma(2.0, 4.0).pdf_jacobian([0.0])[0] == pytest.approx(16.0)
    assert P.Gamma(2.0, 4.0).pdf_hessian([0.0])[0, 0] == pytest.approx(-128.0)
    assert P.Gamma(0.5, 1.0).pdf([0.0])[0] == math.inf
    assert P.BetaPrime(2.0, 4.0).pdf_jacobian([0.0])[0] == pytest.approx(20.0)
    assert P.InverseGamma(4.0, 2.0).pdf([0.0])[0] == math.inf
    assert P.Uniform(0.2, 0.9).log_pdf([0.0]) == -math.inf
    assert P.Cauchy(1.0, 2.0).pdf_jacobian([1.0])[0] == 0.0


def test_prior_suggestions_and_checks():
    assert P.Erlang(3, 2.0).suggest_hyperparam() == 1.5
    assert P.Uniform(0.2, 0.9).suggest_hyperparam() == pytest.approx(0.55)
    assert P.Uniform().suggest_hyperparam() == 1.0
    assert P.InverseGamma(4.0, 2.0).suggest_hyperparam() == pytest.approx(2 / 3)
    assert P.Normal([1.0, -2.0], [1.0, 3.0]).suggest_hyperparam(positive=True) == [1.0, 3.0]
    assert P.Uniform(0.2, 0.9).mean() == pytest.approx(0.55)
    for bad in (lambda: P.Normal(0, 0), lambda: P.Erlang(2.5, 1.0), lambda: P.Uniform(1.0, 0.5), lambda: P.Gamma([1.0, 2.0], 1.0).pdf([1.0, 1.0, 1.0])):
        with pytest.raises(ValueError):
            bad()


def test_prior_table(spark):
    rows = P.Normal(1.0, 3.0).table(spark, 0.1, 4.0, 60).dropna().collect()
    assert max(abs(r.d1 - r.n1) for r in rows) < 1e-3


def test_basis_order_and_checks():
    assert monomials(2, 2) == [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (0, 2)]
    assert monomials(3, 1) == [(0, 0, 0), (0, 0, 1), (1, 0, 0), (0, 1, 0)]
    for bad in ({"polynomial_degree": None}, {"polynomial_degree": -1}):
        with pytest.raises(ValueError):
            Basis(**bad)


def test_special():
    assert ball_volume(1.0, 3) == pytest.approx(4 / 3 * math.pi)
    assert ball_radius(ball_volume(0.7, 5), 5) == pytest.approx(0.7)
    assert normal_quantile(0.95) == pytest.approx(1.959964, abs=1e-6)
