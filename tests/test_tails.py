import math

import numpy as np
import pytest

from terrastat.functions import tails


# Published test statistics with their p values.
@pytest.mark.parametrize(
    "f, d1, p",
    [
        (112.38527506130369, 4, 4.463645026829027e-58),
        (19.558503106632095, 4, 2.7261464567739792e-14),
        (8.101491248025438, 4, 3.285332039585221e-06),
        (56.0491908588703, 2, 2.333938445958323e-21),
        (0.7582263939478587, 3, 0.518333620212091),
    ],
)
def test_f_tail_matches_published(f, d1, p):
    assert float(tails.f_tail(f, d1, 295)) == pytest.approx(p, rel=1e-11)


# Published correlations of n = 1523 rows with their p values.
@pytest.mark.parametrize(
    "r, p",
    [
        (0.4051883564513694, 2.9471838957446094e-61),
        (0.27210645807159745, 2.91924801058707e-27),
        (0.059699312595772644, 0.0198077992571632),
        (0.02147333657811536, 0.4023570665341858),
        (0.5793313725229384, 3.1095330272528325e-137),
        (-0.34288646483441165, 2.9037429495135243e-43),
    ],
)
def test_pearson_p_matches_published(spark, r, p):
    from terrastat.operators.summary import pearson_p

    got = pearson_p(spark.createDataFrame([("a", "b", r, 1523)], "var1 string, var2 string, r double, n long")).first()["p"]
    assert got == pytest.approx(p, rel=1e-9)


def test_perfect_correlation_has_p_zero(spark):
    from terrastat.operators.summary import pearson_p

    got = pearson_p(spark.createDataFrame([("a", "b", -1.0, 10)], "var1 string, var2 string, r double, n long")).first()["p"]
    assert got == 0.0


def test_chi2_closed_forms():
    x = np.array([0.1, 1.0, 5.0, 30.0, 200.0])
    assert tails.chi2_tail(x, 2) == pytest.approx(np.exp(-x / 2), rel=1e-12)
    assert tails.chi2_tail(x, 4) == pytest.approx(np.exp(-x / 2) * (1 + x / 2), rel=1e-12)
    assert tails.chi2_tail(x, 1) == pytest.approx([math.erfc(math.sqrt(v / 2)) for v in x], rel=1e-11)


def test_t_closed_forms_and_critical_value():
    t = np.array([0.0, 0.5, 2.0, 40.0])
    assert tails.t_two_sided(t, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(t), rel=1e-9)
    assert tails.t_two_sided(t, 2) == pytest.approx(1 - t / np.sqrt(2 + t * t), rel=1e-9)
    crit = tails.t_critical(0.05, 295)
    assert float(tails.t_two_sided(crit, 295)) == pytest.approx(0.05, rel=1e-12)


def test_normal_quantile_inverts_the_tail(spark):
    """Against bisection on the complementary error function, in all three ranges of the approximation."""
    from pyspark.sql import functions as F

    from terrastat.functions.scalar import normal_quantile

    p = [1e-300, 1e-30, 1e-12, 1e-4, 0.0749, 0.0751, 0.2, 0.5, 0.9, 0.925, 0.975, 1 - 1e-9]
    d = spark.createDataFrame([(v,) for v in [*p, 0.0, 1.0, -0.1, None]], "p double")
    got = [r["z"] for r in d.select(normal_quantile(F.col("p")).alias("z")).collect()]

    def plain(v):
        lo, hi = -40.0, 40.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < v else (lo, mid)
        return (lo + hi) / 2

    for z, v in zip(got, p):
        want = plain(v) if v < 0.5 else -plain(1 - v)
        assert z == pytest.approx(want, rel=1e-12, abs=1e-15)
    assert got[len(p) :] == [-math.inf, math.inf, None, None]


def test_missing_statistics_stay_missing(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(1.0,), (None,)], "t double")
    got = [r["p"] for r in d.select(tails.t_test_p("t", F.lit(5.0)).alias("p")).collect()]
    assert got[1] is None and 0 < got[0] < 1
