import numpy as np
import pytest

from plumbline.errors import ValidationError
from plumbline.functions.seeds import Rng, derive, permutation
from plumbline.operators.splitters import GroupKFold, KFold, StratifiedKFold, TimeSeriesSplit, check_split, split_parts
from plumbline.sources.dataset import CLASSIFICATION, admit


def dataset(spark, n, labels=None, groups=None):
    labels, groups = labels or [0] * n, groups or [0] * n
    rows = [(i, float(i), labels[i], groups[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, x double, label long, grp long").repartition(3)
    return admit(df, ["x"], "label", CLASSIFICATION, group="grp")


def folds(assigned):
    rows = assigned.collect()
    return [sorted(r["row_id"] for r in rows if r["fold"] == f) for f in range(max(r["fold"] for r in rows) + 1)]


def test_kfold(spark):
    assert folds(KFold(3).assign(dataset(spark, 11))) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10]]
    assert [len(f) for f in folds(KFold(3).assign(dataset(spark, 10)))] == [4, 3, 3]
    for bad in (1, 12):
        with pytest.raises(ValidationError):
            KFold(bad).assign(dataset(spark, 11))


@pytest.mark.parametrize("exact", [False, True])
def test_shuffled_kfold(spark, exact):
    d = dataset(spark, 23)
    a, b, c = (folds(KFold(4, True, exact).assign(d, seed)) for seed in (1, 1, 2))
    assert a == b != c
    assert sorted(sum(a, [])) == list(range(23)) and sorted(map(len, a)) == [5, 6, 6, 6]


def test_stratified(spark):
    d = dataset(spark, 18, [0] * 5 + [1] * 7 + [2] * 6)
    assert folds(StratifiedKFold(3).assign(d)) == [[0, 1, 5, 6, 12, 13], [2, 3, 7, 8, 14, 15], [4, 9, 10, 11, 16, 17]]
    labels = [0, 1] * 6
    shuffled = folds(StratifiedKFold(3, True).assign(dataset(spark, 12, labels), 1729))
    assert sorted(sum(shuffled, [])) == list(range(12))
    assert all(sum(labels[i] for i in f) == 2 for f in shuffled)


def test_groups(spark):
    d = dataset(spark, 22, groups=[10] * 6 + [20] * 5 + [30] * 4 + [40] * 3 + [50] * 2 + [60] * 2)
    assert folds(GroupKFold(3).assign(d)) == [[0, 1, 2, 3, 4, 5, 18, 19], [6, 7, 8, 9, 10, 20, 21], list(range(11, 18))]
    d = dataset(spark, 9, groups=[0, 0, 0, 1, 1, 2, 2, 3, 4])
    assert sorted(folds(GroupKFold(3).assign(d))) == [[0, 1, 2], [3, 4, 7], [5, 6, 8]]
    with pytest.raises(ValidationError):
        GroupKFold(7).assign(d)


def test_time_series(spark):
    rows = TimeSeriesSplit(3, 2, 1).assign(dataset(spark, 12)).collect()
    part = lambda f, p: sorted(r["row_id"] for r in rows if (r["fold"], r["part"]) == (f, p))
    assert [part(f, "test") for f in range(3)] == [[6, 7], [8, 9], [10, 11]]
    assert [part(f, "train") for f in range(3)] == [list(range(n)) for n in (5, 7, 9)]
    assert TimeSeriesSplit(3).windows(12) == [(3, 3, 6), (6, 6, 9), (9, 9, 12)]
    with pytest.raises(ValidationError):
        TimeSeriesSplit(5, 3).windows(12)


def test_split_checks(spark):
    d = dataset(spark, 6)
    parts = split_parts(d, KFold(2).assign(d))
    check_split(parts[0].train.df, parts[0].test.df, d)
    assert parts[1].materialize().train.rows == 3
    with pytest.raises(ValidationError):
        check_split(d.df, parts[0].test.df, d)
    with pytest.raises(ValidationError):
        check_split(d.df.limit(0), parts[0].test.df, d)


def test_seeds():
    assert derive(42, "cross_validate", 0) == -655211088011813383
    assert derive(42, "cross_validate", 1) == -3872047652920971549
    assert derive(derive(42, "candidate", 3), "fold", 7) == 2923168321759935908
    a, r = Rng(42).next_int64()
    b, r = r.next_int64()
    c, _ = r.next_float()
    assert (a, b) == (-4767286540954276203, 2949826092126892291)
    assert np.float64(c).view(np.int64) == 4598690451703514086
    assert Rng(42).draws(2).view(np.int64).tolist() == [a, b]
    assert sorted(permutation(50, 3).tolist()) == list(range(50))
