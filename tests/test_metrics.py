import math

import pytest

from plumbline.errors import ValidationError
from plumbline.operators import metrics as M


@pytest.fixture(scope="module")
def regression(spark):
    rows = list(zip([1., 2, 4, 8, 16], [1.5, 1., 5, 7, 18], [1., 2, .5, 3, 1.5], strict=True))
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "truth double, pred double, w double")


@pytest.fixture(scope="module")
def binary(spark):
    rows = zip([0, 1, 0, 1, 1, 0, 1, 0], [0, 1, 1, 1, 0, 0, 1, 0], [.05, .8, .7, .6, .4, .2, .9, .3], [1., 2, .5, 1.5, 1, 2.5, .75, 1.25], strict=True)
    return spark.createDataFrame([(a, b, float(c), float(d)) for a, b, c, d in rows], "truth int, pred int, p double, w double").repartition(3)


def close(a, b):
    assert a == pytest.approx(b, rel=1e-12, abs=1e-12)


def test_regression(regression):
    close(M.mean_absolute_error(regression, weight="w"), 1.125)
    close(M.mean_squared_error(regression, weight="w"), 1.46875)
    close(M.root_mean_squared_error(regression, weight="w"), 1.2119199643540823)
    close(M.r2(regression, weight="w"), 0.94531704479348455)
    assert sorted(r[1] for r in M.residual_curve(regression).collect()) == [-2, -1, -.5, 1, 1]


def test_constant_truth(spark):
    d = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "truth double, pred double")
    with pytest.raises(ValidationError):
        M.r2(d)
    assert math.isnan(M.r2(d, undefined="nan")) and M.r2(d, undefined="fallback") == 0.0
    assert M.r2(d.where("pred = 2"), undefined="fallback") == 1.0


def test_binary(binary):
    close(M.accuracy(binary, weight="w"), 0.8571428571428571)
    close(M.balanced_accuracy(binary, weight="w"), 0.85714285714285721)
    close(M.precision(binary, weight="w"), 0.89473684210526316)
    close(M.recall(binary, weight="w"), 0.80952380952380953)
    close(M.f1(binary, weight="w"), 0.85)
    close(M.log_loss(binary, weight="w"), 0.3680779915861323)
    close(M.roc_auc(binary, weight="w"), 0.9546485260770976)


def test_curves(binary):
    roc = M.roc_curve(binary, weight="w").toPandas().sort_values("threshold", ascending=False)
    assert roc.threshold.tolist() == [math.inf, .9, .8, .7, .6, .4, .3, .2, .05]
    assert roc.fpr.tolist() == pytest.approx([0, 0, 0, .0952380952, .0952380952, .0952380952, .3333333333, .8095238095, 1])
    assert roc.tpr.tolist() == pytest.approx([0, .1428571429, .5238095238, .5238095238, .8095238095, 1, 1, 1, 1])
    pr = M.pr_curve(binary, weight="w").toPandas().sort_values("threshold", na_position="last")
    assert pr.threshold.tolist()[:-1] == [.05, .2, .3, .4, .6, .7, .8, .9]
    assert pr.precision.tolist() == pytest.approx([.5, .5526315789, .75, .9130434783, .8947368421, .8461538462, 1, 1, 1])
    assert pr.recall.tolist() == pytest.approx([1, 1, 1, 1, .8095238095, .5238095238, .5238095238, .1428571429, 0])


def test_undefined_and_invalid(spark, binary):
    one = binary.where("truth = 1")
    with pytest.raises(ValidationError):
        M.roc_auc(one)
    assert M.roc_auc(one, undefined="fallback") == 0.5
    with pytest.raises(ValidationError):
        M.precision(spark.createDataFrame([(0, 0)], "truth int, pred int"))
    with pytest.raises(ValidationError):
        M.accuracy(spark.createDataFrame([(0, 1), (2, 1)], "truth int, pred int"))
    with pytest.raises(ValidationError):
        M.log_loss(spark.createDataFrame([(0, 1.5)], "truth int, p double"))


def test_scorers_and_summaries(binary, regression):
    close(M.binary_scorers()["neg_log_loss"](binary, "w"), -0.3680779915861323)
    close(M.regression_scorers()["neg_mean_absolute_error"](regression, "w"), -1.125)
    s = M.summarize([1.0, 2.0, 4.0])
    assert (s.count, s.minimum, s.maximum) == (3, 1.0, 4.0)
    close((s.mean, s.standard_deviation), (7 / 3, math.sqrt(14) / 3))
    with pytest.raises(ValidationError):
        M.summarize([math.nan])
    assert math.isnan(M.summarize([1.0, math.nan], "nan").mean) and M.summarize([1.0, math.nan], "fallback").mean == 0.5
    for bad in ([], [math.inf]):
        with pytest.raises(ValidationError):
            M.summarize(bad)
