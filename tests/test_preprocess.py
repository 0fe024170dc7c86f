import math

import pytest

from plumbline.errors import DataError, NumericalError, SchemaError, ValidationError
from plumbline.operators.preprocess import SimpleImputer, StandardScaler, VarianceThreshold
from plumbline.schema import FeatureSchema
from plumbline.sources.dataset import matrix

NAN = math.nan
ROWS = [[1, NAN, 5, 0], [2, 4, 5, 1], [NAN, 8, 5, 2], [4, 6, 5, 3], [5, 10, 5, 4]]
NAMES = ["f0", "f1", "f2", "f3"]
SCHEMA = FeatureSchema.named(NAMES)


@pytest.fixture(scope="module")
def frame(spark):
    return matrix(spark, ROWS)


@pytest.mark.parametrize("spec, expected", [
    (SimpleImputer("mean"), (3, 7, 5, 2)), (SimpleImputer("median"), (3, 7, 5, 2)), (SimpleImputer("constant", -2.0), (-2,) * 4)])
def test_imputer_statistics(frame, spec, expected):
    assert spec.fit(frame, NAMES, SCHEMA).values == pytest.approx(expected, abs=1e-12)


def test_scaler_after_imputation(frame):
    filled, _ = SimpleImputer().fit(frame, NAMES, SCHEMA).transform(frame, NAMES, SCHEMA)
    fitted = StandardScaler().fit(filled, NAMES, SCHEMA)
    assert fitted.mean == pytest.approx((3, 7, 5, 2)) and fitted.variance == pytest.approx((2, 4, 0, 2))
    assert fitted.scale == pytest.approx((math.sqrt(2), 2, 1, math.sqrt(2)))
    out, _ = fitted.transform(filled, NAMES, SCHEMA, validate=True)
    assert list(out.where("row_id = 0").first())[1:] == pytest.approx([-math.sqrt(2), 0, 0, -math.sqrt(2)])
    kept = VarianceThreshold(1.5).fit(filled, NAMES, SCHEMA)
    assert kept.selected == (0, 1, 3) and kept.output_schema.names == ("f0", "f1", "f3")
    assert kept.transform(filled, NAMES, SCHEMA)[0].columns == ["row_id", "f0", "f1", "f3"]


def test_even_median_is_the_midpoint(spark):
    m = matrix(spark, [[1], [3], [NAN], [10], [100]])
    assert SimpleImputer("median").fit(m, ["f0"], FeatureSchema.named(["f0"])).values == (6.5,)


def test_failures(spark):
    one = FeatureSchema.named(["f0"])
    with pytest.raises(ValidationError) as error:
        SimpleImputer().fit(matrix(spark, [[NAN], [NAN]]), ["f0"], one)
    assert error.value.context == (("feature", 0),)
    with pytest.raises(DataError):
        SimpleImputer().fit(matrix(spark, [[math.inf], [1]]), ["f0"], one)
    with pytest.raises(NumericalError):
        StandardScaler(False, False).fit(matrix(spark, [[1.7e308], [-1.7e308]]), ["f0"], one)
    with pytest.raises(ValidationError):
        VarianceThreshold().fit(matrix(spark, [[1], [1]]), ["f0"], one)
    with pytest.raises(ValidationError):
        VarianceThreshold(-1.0)
    with pytest.raises(ValidationError):
        SimpleImputer("constant", math.inf)
    with pytest.raises(ValidationError):
        StandardScaler().fit(matrix(spark, [[1]]), ["f0"], one, weight="w")
    fitted = SimpleImputer().fit(matrix(spark, [[1.0]]), ["f0"], one)
    with pytest.raises(SchemaError):
        fitted.transform(matrix(spark, [[1.0]]), ["f0"], FeatureSchema.anonymous(1))


def test_mean_of_huge_values(spark):
    m = matrix(spark, [[1.6e308], [1.6e308], [NAN]])
    assert SimpleImputer().fit(m, ["f0"], FeatureSchema.named(["f0"])).values == pytest.approx((1.6e308,))


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_partitions_do_not_matter(frame, partitions):
    assert SimpleImputer().fit(frame.repartition(partitions), NAMES, SCHEMA).values == pytest.approx((3, 7, 5, 2), abs=1e-12)
