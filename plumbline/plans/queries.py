"""Registered queries of the workflow engine and the SQL that checks them; more in operator_queries.

Events give features (``value`` with every seventh missing, hour, user), lineitem gives regressions,
orders and documents with labels give classes. Floats are rounded alike on both sides.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numeric
from plumbline.operators import metrics as M
from plumbline.operators.linear import LinearRegression, LogisticRegression, RidgeRegression, discover_classes
from plumbline.operators.preprocess import SimpleImputer, StandardScaler, VarianceThreshold, moments
from plumbline.operators.splitters import KFold, StratifiedKFold, TimeSeriesSplit, check_split, split_parts
from plumbline.plans.execution import BoundedPool
from plumbline.plans.fusion import ridge_grid
from plumbline.plans.pipeline import Pipeline
from plumbline.plans.selection import competition_ranks, cross_validate, search
from plumbline.sources import artifact
from plumbline.sources.dataset import ALLOW_NAN, CLASSIFICATION, Dataset, admission_report, admit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 42


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# -- inputs ----------------------------------------------------------------------------------------
_NAN = "CAST('NaN' AS DOUBLE)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select(F.col("event_id").alias("row_id"), v.alias("a"), (F.col("user_id") % 11).cast("double").alias("b"),
                    F.lit(5.0).alias("c"), F.col("value").alias("y"), (F.col("event_type") == "purchase").cast("long").alias("label"),
                    (1.0 + F.col("event_id") % 3).alias("w"), F.col("user_id").alias("grp"))


#: The same rows in SQL; a missing cell is null there.
_E = """(SELECT event_id AS row_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS a,
    CAST(user_id % 11 AS DOUBLE) AS b, CAST(5 AS DOUBLE) AS c, value AS y,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, CAST(1 + event_id % 3 AS DOUBLE) AS w, user_id AS grp
    FROM events) e"""


def _event_data(spark: SparkSession, sf_dir: str, task: str = "regression", check: bool = True) -> Dataset:
    return admit(_events(spark, sf_dir), ["a", "b", "c"], "y" if task == "regression" else "label", task, weight="w",
                 group="grp", finiteness=ALLOW_NAN, check=check, unique_ids=True)


def _parts(spark: SparkSession, sf_dir: str) -> Dataset:
    p = _read(spark, sf_dir, "part")
    return admit(p.select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("x"),
                          (F.col("p_partkey") % 17).cast("double").alias("z"), F.col("p_retailprice").alias("y"),
                          (1.0 + F.col("p_partkey") % 4).alias("w")), ["x", "z"], "y", weight="w",
                 unique_ids=True)


_P = """(SELECT p_partkey AS row_id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 17 AS DOUBLE) AS z, p_retailprice AS y,
    CAST(1 + p_partkey % 4 AS DOUBLE) AS w FROM part) p"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths and predictions of both kinds, by formula."""
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_totalprice").alias("truth"),
                    (F.col("o_totalprice") + (F.col("o_orderkey") % 101 - 50)).alias("pred"),
                    (F.col("o_orderstatus") == "O").cast("int").alias("label"),
                    (F.col("o_orderkey") % 2).cast("int").alias("guess"),
                    ((F.col("o_orderkey") * 37 % 100 + F.when(F.col("o_orderstatus") == "O", 30).otherwise(0)) / 130.0).alias("p"),
                    (1.0 + F.col("o_orderkey") % 3).alias("w"))


_S = """(SELECT o_totalprice AS truth, o_totalprice + (o_orderkey % 101 - 50) AS pred,
    CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS label, o_orderkey % 2 AS guess,
    CAST(o_orderkey * 37 % 100 + CASE WHEN o_orderstatus = 'O' THEN 30 ELSE 0 END AS DOUBLE) / 130.0 AS p,
    CAST(1 + o_orderkey % 3 AS DOUBLE) AS w FROM orders) s"""


def _one(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(map(float, values.values()))], ", ".join(f"{k} double" for k in values))


# -- sources ---------------------------------------------------------------------------------------
@query(f"""SELECT count(*) AS rows, CAST(sum(CASE WHEN a IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_cells,
    CAST(0 AS BIGINT) AS infinite_cells, CAST(0 AS BIGINT) AS bad_targets, CAST(0 AS BIGINT) AS bad_weights,
    CAST(0 AS BIGINT) AS negative_weights, count(*) AS positive_weights FROM {_E}""")
def dataset_admission_report(spark, sf_dir):
    report = admission_report(_event_data(spark, sf_dir, check=False))
    return report.select(*[F.col(c).cast("long").alias(c) for c in report.columns])


@query(f"""SELECT 2 * (1000000000 - row_id) + twice.again AS pos, row_id, y FROM {_E}
    JOIN (SELECT 0 AS again UNION ALL SELECT 1 AS again) twice ON twice.again = 0 OR row_id % 3 = 0""")
def dataset_row_view(spark, sf_dir):
    """All rows in reverse, every third one twice."""
    data = _event_data(spark, sf_dir, check=False)
    first = 2 * (1000000000 - F.col("row_id"))
    positions = data.df.select("row_id", F.explode(F.when(F.col("row_id") % 3 == 0, F.array(first, first + 1)).otherwise(F.array(first))).alias("pos"))
    return data.view(positions).select("pos", "row_id", "y")


@query(f"SELECT row_id, c, coalesce(a, -1) AS a FROM {_E}")
def dataset_column_subset(spark, sf_dir):
    d = _event_data(spark, sf_dir, check=False).select_features([2, 0]).df
    return d.select("row_id", "c", F.when(F.isnan("a"), -1.0).otherwise(F.col("a")).alias("a"))


@query(f"SELECT count(DISTINCT grp) AS groups FROM {_E}")
def distinct_groups(spark, sf_dir):
    return spark.createDataFrame([(_event_data(spark, sf_dir, check=False).distinct_groups(),)], "groups long")


# -- sums ------------------------------------------------------------------------------------------
@query("SELECT round(sum(l_extendedprice), 2) AS price, round(sum(l_discount), 4) AS discount FROM lineitem")
def exact_sums(spark, sf_dir):
    sums = numeric.exact_column_sums(_read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount"])
    return _one(spark, price=sums[0], discount=sums[1]).select(F.round("price", 2).alias("price"), F.round("discount", 4).alias("discount"))


@query("SELECT l_orderkey, l_linenumber, round(0.5 * l_quantity - 2 * l_discount + 3 * l_tax, 6) AS product FROM lineitem")
def matrix_vector_product(spark, sf_dir):
    d = numeric.matrix_vector(_read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], [0.5, -2.0, 3.0])
    return d.select("l_orderkey", "l_linenumber", F.round("product", 6).alias("product"))


@query("SELECT round(sum(l_quantity * l_tax), 4) AS q, round(sum(l_discount * l_tax), 6) AS d FROM lineitem")
def transposed_product(spark, sf_dir):
    q, d = numeric.transposed_matrix_vector(_read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_tax")
    return _one(spark, q=q, d=d).select(F.round("q", 4).alias("q"), F.round("d", 6).alias("d"))


# -- preprocessing ---------------------------------------------------------------------------------
def _imputed(spark, sf_dir, spec):
    d = _event_data(spark, sf_dir, check=False)
    out, _ = spec.fit(d.df, d.features, d.schema).transform(d.df, d.features, d.schema)
    return out.select("row_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def _impute_sql(value: str) -> str:
    return f"SELECT row_id, round(coalesce(a, (SELECT {value} FROM {_E})), 6) AS a, round(b, 6) AS b FROM {_E}"


@query(_impute_sql("avg(a)"))
def impute_mean(spark, sf_dir):
    return _imputed(spark, sf_dir, SimpleImputer("mean"))


@query(_impute_sql("median(a)"))
def impute_median(spark, sf_dir):
    return _imputed(spark, sf_dir, SimpleImputer("median"))


@query(_impute_sql("-2.0 + 0 * count(*)"))
def impute_constant(spark, sf_dir):
    return _imputed(spark, sf_dir, SimpleImputer("constant", -2.0))


def _scaled(spark, sf_dir, spec):
    d = _event_data(spark, sf_dir, check=False).select_features([1, 2])
    out, _ = spec.fit(d.df, d.features, d.schema).transform(d.df, d.features, d.schema)
    return out.select("row_id", F.round("b", 6).alias("b"), F.round("c", 6).alias("c"))


def _scale_sql(b: str, c: str) -> str:
    return f"""SELECT row_id, round({b}, 6) AS b, round({c}, 6) AS c
        FROM {_E}, (SELECT avg(b) AS mb, sqrt(var_pop(b)) AS sb FROM {_E}) m"""


@query(_scale_sql("(b - mb) / sb", "c - 5"))
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, StandardScaler())


@query(_scale_sql("b / sb", "c"))
def scale_no_mean(spark, sf_dir):
    return _scaled(spark, sf_dir, StandardScaler(with_mean=False))


@query(_scale_sql("b - mb", "c - 5"))
def scale_no_std(spark, sf_dir):
    return _scaled(spark, sf_dir, StandardScaler(with_std=False))


@query(f"""SELECT name, round(v, 6) AS variance, v > 1.5 AS kept FROM (
    SELECT 'b' AS name, var_pop(b) AS v FROM {_E} UNION ALL SELECT 'c' AS name, var_pop(c) AS v FROM {_E}) u""")
def variance_threshold(spark, sf_dir):
    d = _event_data(spark, sf_dir, check=False).select_features([1, 2])
    fitted = VarianceThreshold(1.5).fit(d.df, d.features, d.schema)
    rows = [(n, float(v), k in fitted.selected) for k, (n, v) in enumerate(zip(d.features, fitted.variances, strict=True))]
    return spark.createDataFrame(rows, "name string, v double, kept boolean").select("name", F.round("v", 6).alias("variance"), "kept")


@query(f"SELECT round(avg(b), 6) AS mean_b, round(var_pop(b), 6) AS var_b, round(avg(y), 6) AS mean_y, round(var_pop(y), 4) AS var_y FROM {_E}")
def column_moments(spark, sf_dir):
    m = moments(_event_data(spark, sf_dir, check=False).df, ["b", "y"])
    return m.select(F.round("mu0", 6).alias("mean_b"), F.round("var0", 6).alias("var_b"),
                    F.round("mu1", 6).alias("mean_y"), F.round("var1", 4).alias("var_y"))


# -- splitters -------------------------------------------------------------------------------------
@query(f"SELECT row_id, CAST(ntile(5) OVER (ORDER BY row_id) - 1 AS INT) AS fold FROM {_E}")
def kfold(spark, sf_dir):
    return KFold(5).assign(_event_data(spark, sf_dir, check=False))


@query(f"SELECT row_id, CAST(ntile(5) OVER (ORDER BY md5('{SEED}:' || CAST(row_id AS VARCHAR)), row_id) - 1 AS INT) AS fold FROM {_E}")
def kfold_shuffled(spark, sf_dir):
    return KFold(5, shuffle=True).assign(_event_data(spark, sf_dir, check=False), SEED)


_STRATA = """WITH d AS (SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label FROM orders),
    c AS (SELECT label, count(*) AS n, min(row_id) AS lead_row FROM d GROUP BY label),
    o AS (SELECT label, n, sum(n) OVER (ORDER BY lead_row) - n AS off FROM c),
    f AS (SELECT o.label, k.fold, n // 3 + CASE WHEN (((k.fold - off) % 3) + 3) % 3 < n % 3 THEN 1 ELSE 0 END AS m
          FROM o, (SELECT 0 AS fold UNION ALL SELECT 1 AS fold UNION ALL SELECT 2 AS fold) k),
    s AS (SELECT label, fold, m, sum(m) OVER (PARTITION BY label ORDER BY fold) - m AS lo FROM f),
    r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS p FROM d)
    SELECT r.row_id, CAST(s.fold AS INT) AS fold FROM r JOIN s ON r.label = s.label AND r.p >= s.lo AND r.p < s.lo + s.m"""


def _strata(spark, sf_dir) -> Dataset:
    o = _read(spark, sf_dir, "orders")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return admit(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("x"), label.alias("label")),
                 ["x"], "label", CLASSIFICATION, check=False)


@query(_STRATA)
def stratified_kfold(spark, sf_dir):
    return StratifiedKFold(3).assign(_strata(spark, sf_dir))


@query(f"""SELECT row_id, k.fold, CASE WHEN i < n - (4 - k.fold) * t - 3 THEN 'train' ELSE 'test' END AS part
    FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n, count(*) OVER () // 5 AS t FROM {_E}) x,
    (SELECT 0 AS fold UNION ALL SELECT 1 AS fold UNION ALL SELECT 2 AS fold UNION ALL SELECT 3 AS fold) k
    WHERE i < n - (4 - k.fold) * t - 3 OR (i >= n - (4 - k.fold) * t AND i < n - (3 - k.fold) * t)""")
def time_series_split(spark, sf_dir):
    return TimeSeriesSplit(4, gap=3).assign(_event_data(spark, sf_dir, check=False))


@query(f"""SELECT k.fold, CAST(count(*) - sum(CASE WHEN f.fold = k.fold THEN 1 ELSE 0 END) AS BIGINT) AS train,
    CAST(sum(CASE WHEN f.fold = k.fold THEN 1 ELSE 0 END) AS BIGINT) AS test
    FROM (SELECT CAST(ntile(3) OVER (ORDER BY row_id) - 1 AS INT) AS fold FROM {_E}) f,
    (SELECT 0 AS fold UNION ALL SELECT 1 AS fold UNION ALL SELECT 2 AS fold) k GROUP BY k.fold""")
def split_materialize(spark, sf_dir):
    data = _event_data(spark, sf_dir)
    parts = split_parts(data, KFold(3).assign(data))
    check_split(parts[0].train.df, parts[0].test.df, data)
    rows = [(i, s.train.materialize().rows, s.test.materialize().rows) for i, s in enumerate(parts)]
    return spark.createDataFrame(rows, "fold int, train long, test long")


# -- metrics ---------------------------------------------------------------------------------------
def _value(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select(F.round("value", digits).alias("value"))


@query(f"SELECT round(sum(w * abs(pred - truth)) / sum(w), 6) AS value FROM {_S}")
def mae(spark, sf_dir):
    return _value(M.mae_frame(_scored(spark, sf_dir), weight="w"))


@query(f"SELECT round(sum(w * (pred - truth) * (pred - truth)) / sum(w), 4) AS value FROM {_S}")
def mse(spark, sf_dir):
    return _value(M.mse_frame(_scored(spark, sf_dir), weight="w"), 4)


@query(f"SELECT round(sqrt(sum(w * (pred - truth) * (pred - truth)) / sum(w)), 6) AS value FROM {_S}")
def rmse(spark, sf_dir):
    return M.mse_frame(_scored(spark, sf_dir), weight="w").select(F.round(F.sqrt("value"), 6).alias("value"))


@query(f"""SELECT round(1 - sum(w * (pred - truth) * (pred - truth)) / sum(w * (truth - m) * (truth - m)), 9) AS value
    FROM {_S}, (SELECT sum(w * truth) / sum(w) AS m FROM {_S}) a""")
def r2(spark, sf_dir):
    return _value(_one(spark, value=M.r2(_scored(spark, sf_dir), weight="w")), 9)


@query(f"SELECT round(pred, 4) AS prediction, round(truth - pred, 4) AS residual FROM {_S}")
def residual_curve(spark, sf_dir):
    c = M.residual_curve(_scored(spark, sf_dir), validate=False)
    return c.select(F.round("prediction", 4).alias("prediction"), F.round("residual", 4).alias("residual"))


_CONFUSION = f"""(SELECT sum(CASE WHEN label = 1 AND guess = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND guess = 0 THEN w ELSE 0 END) AS tn,
    sum(CASE WHEN label = 0 AND guess = 1 THEN w ELSE 0 END) AS fp, sum(CASE WHEN label = 1 AND guess = 0 THEN w ELSE 0 END) AS fn FROM {_S}) c"""


@query(f"SELECT tp, tn, fp, fn FROM {_CONFUSION}")
def confusion(spark, sf_dir):
    return M.confusion_frame(_scored(spark, sf_dir), 1, "label", "guess", "w")


@query(f"SELECT round((tp + tn) / (tp + tn + fp + fn), 9) AS value FROM {_CONFUSION}")
def accuracy(spark, sf_dir):
    return _value(_one(spark, value=M.accuracy(_scored(spark, sf_dir), "label", "guess", "w")), 9)


@query(f"SELECT round(0.5 * (tp / (tp + fn) + tn / (tn + fp)), 9) AS value FROM {_CONFUSION}")
def balanced_accuracy(spark, sf_dir):
    return _value(_one(spark, value=M.balanced_accuracy(_scored(spark, sf_dir), 1, "label", "guess", "w")), 9)


@query(f"SELECT round(tp / (tp + fp), 9) AS value FROM {_CONFUSION}")
def precision(spark, sf_dir):
    return _value(_one(spark, value=M.precision(_scored(spark, sf_dir), 1, "label", "guess", "w")), 9)


@query(f"SELECT round(tp / (tp + fn), 9) AS value FROM {_CONFUSION}")
def recall(spark, sf_dir):
    return _value(_one(spark, value=M.recall(_scored(spark, sf_dir), 1, "label", "guess", "w")), 9)


@query(f"SELECT round(2 * tp / (2 * tp + fp + fn), 9) AS value FROM {_CONFUSION}")
def f1(spark, sf_dir):
    return _value(_one(spark, value=M.f1(_scored(spark, sf_dir), 1, "label", "guess", "w")), 9)


@query(f"""SELECT round(sum(w * CASE WHEN label = 1 THEN -ln(q) ELSE -ln(1 - q) END) / sum(w), 9) AS value
    FROM (SELECT label, w, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM {_S}) x""")
def log_loss(spark, sf_dir):
    return _value(M.log_loss_frame(_scored(spark, sf_dir), 1, "label", weight="w"), 9)


_RANKED = f"""(SELECT score, sum(tp) OVER (ORDER BY score DESC) AS tp, sum(fp) OVER (ORDER BY score DESC) AS fp, tp AS own_tp, fp AS own_fp,
    sum(tp) OVER () AS all_tp, sum(fp) OVER () AS all_fp FROM (SELECT p AS score, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS tp,
    sum(CASE WHEN label = 1 THEN 0 ELSE w END) AS fp FROM {_S} GROUP BY p) g) r"""


@query(f"""SELECT round(score, 6) AS threshold, round(fp / all_fp, 9) AS fpr, round(tp / all_tp, 9) AS tpr FROM {_RANKED}
    UNION ALL SELECT CAST(9e99 AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr""")
def roc_curve(spark, sf_dir):
    c = M.roc_curve(_scored(spark, sf_dir), 1, "label", weight="w")
    t = F.when(F.col("threshold") > 1e99, F.lit(9e99)).otherwise(F.round("threshold", 6))
    return c.select(t.alias("threshold"), F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(f"""SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 9) AS "precision", round(tp / all_tp, 9) AS recall FROM {_RANKED}
    UNION ALL SELECT CAST(9e99 AS DOUBLE) AS threshold, CAST(1 AS DOUBLE) AS "precision", CAST(0 AS DOUBLE) AS recall""")
def pr_curve(spark, sf_dir):
    c = M.pr_curve(_scored(spark, sf_dir), 1, "label", weight="w")
    return c.select(F.coalesce(F.round("threshold", 6), F.lit(9e99)).alias("threshold"), F.round("precision", 9).alias("precision"),
                    F.round("recall", 9).alias("recall"))


@query(f"SELECT round(sum(own_fp * (tp - own_tp / 2)) / (max(all_tp) * max(all_fp)), 9) AS value FROM {_RANKED}")
def roc_auc(spark, sf_dir):
    return _value(_one(spark, value=M.auc_value(_scored(spark, sf_dir), 1, "label", weight="w")), 9)


@query("""SELECT count(p_retailprice) AS "count", round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS standard_deviation,
    min(p_retailprice) AS minimum, max(p_retailprice) AS maximum FROM part""")
def score_aggregation(spark, sf_dir):
    s = M.summarize_frame(_read(spark, sf_dir, "part"), "p_retailprice")
    return s.select("count", F.round("mean", 6).alias("mean"), F.round("standard_deviation", 6).alias("standard_deviation"), "minimum", "maximum")


# -- estimators ------------------------------------------------------------------------------------
def _coefficients(spark, fitted, digits=6) -> DataFrame:
    rows = [*(("x", "z")[i : i + 1][0:1] + (c,) for i, c in enumerate(fitted.coefficients)), ("intercept", fitted.intercept)]
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "term string, v double").select(
        "term", F.round("v", digits).alias("value"))


@query("""SELECT 'x' AS term, round(regr_slope(y, x), 6) AS value FROM (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) p
    UNION ALL SELECT 'intercept' AS term, round(regr_intercept(y, x), 6) AS value FROM (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part) p""")
def ols_single(spark, sf_dir):
    d = _parts(spark, sf_dir).select_features([0])
    return _coefficients(spark, LinearRegression().fit(d.df, d.features, "y", d.schema))


def _two(alpha: float) -> str:
    return f"""WITH m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * y) / sum(w) AS my FROM {_P}),
    s AS (SELECT sum(w * (x - mx) * (x - mx)) + {alpha} AS xx, sum(w * (z - mz) * (z - mz)) + {alpha} AS zz, sum(w * (x - mx) * (z - mz)) AS xz,
        sum(w * (x - mx) * (y - my)) AS xy, sum(w * (z - mz) * (y - my)) AS zy FROM {_P}, m),
    b AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM s)
    SELECT 'x' AS term, round(bx, 6) AS value FROM b UNION ALL SELECT 'z' AS term, round(bz, 6) AS value FROM b
    UNION ALL SELECT 'intercept' AS term, round(my - bx * mx - bz * mz, 6) AS value FROM b, m"""


@query(_two(0.0))
def ols_multi(spark, sf_dir):
    d = _parts(spark, sf_dir)
    return _coefficients(spark, LinearRegression().fit(d.df, d.features, "y", d.schema, "w"))


@query(_two(250.0))
def ridge(spark, sf_dir):
    d = _parts(spark, sf_dir)
    return _coefficients(spark, RidgeRegression(250.0).fit(d.df, d.features, "y", d.schema, "w"))


def _binary(spark, sf_dir) -> Dataset:
    o = _read(spark, sf_dir, "orders")
    return admit(o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1e5).alias("x"),
                          ((F.col("o_orderkey") % 13) / 13.0).alias("z"), (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).cast("long").alias("label")),
                 ["x", "z"], "label", CLASSIFICATION, unique_ids=True)


@query("""SELECT o_orderkey AS row_id, round(1 / (1 + exp(-(0.25 - 0.5 * o_totalprice / 1e5 + 2.0 * ((o_orderkey % 13) / 13.0)))), 6) AS p,
    CASE WHEN 0.25 - 0.5 * o_totalprice / 1e5 + 2.0 * ((o_orderkey % 13) / 13.0) > 0 THEN 1 ELSE 0 END AS predicted FROM orders""")
def logistic_proba_fixed_coef(spark, sf_dir):
    from plumbline.operators.linear import GRADIENT, FittedLogistic, SolverReport
    d = _binary(spark, sf_dir)
    m = FittedLogistic(LogisticRegression(), (-0.5, 2.0), 0.25, (0, 1), d.schema, SolverReport(1, 0.0, GRADIENT))
    out = m.predict(m.predict_proba(d.df, d.features, d.schema), d.features, d.schema)
    return out.select("row_id", F.round("p_high", 6).alias("p"), F.col("prediction").cast("int").alias("predicted"))


# -- pipelines, selection, persistence -------------------------------------------------------------
def _pipeline(estimator) -> Pipeline:
    return Pipeline().add("impute", SimpleImputer("mean")).add("scale", StandardScaler()).set_estimator("model", estimator)


@query(f"""WITH f AS (SELECT row_id, coalesce(a, m) AS v, y FROM {_E}, (SELECT avg(a) AS m FROM {_E}) q),
    s AS (SELECT avg(v) AS mv, sqrt(var_pop(v)) AS sv FROM f),
    g AS (SELECT row_id, (v - mv) / sv AS u, y FROM f, s)
    SELECT row_id, round((SELECT regr_intercept(y, u) FROM g) + u * (SELECT regr_slope(y, u) FROM g), 6) AS prediction FROM g""")
def pipeline_impute_scale_predict(spark, sf_dir):
    d = admit(_events(spark, sf_dir), ["a"], "y", finiteness=ALLOW_NAN, unique_ids=True)
    model = _pipeline(LinearRegression()).fit(d, SEED)
    return model.predict(d.df, d.features, d.schema).select("row_id", F.round("prediction", 6).alias("prediction"))


_FOLDED = f"(SELECT row_id, x, y, CAST(ntile(4) OVER (ORDER BY row_id) - 1 AS INT) AS fold FROM {_P}) t"


def _cv_sql(alphas: tuple[float, ...]) -> str:
    grid = " UNION ALL ".join(f"SELECT {i} AS candidate, CAST({a} AS DOUBLE) AS alpha" for i, a in enumerate(alphas))
    folds = " UNION ALL ".join(f"SELECT {k} AS fold" for k in range(4))
    return f"""WITH t AS (SELECT * FROM {_FOLDED}), k AS ({folds}), g AS ({grid}),
    m AS (SELECT k.fold, avg(x) AS mx, avg(y) AS my FROM k JOIN t ON t.fold <> k.fold GROUP BY k.fold),
    s AS (SELECT m.fold, max(mx) AS mx, max(my) AS my, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy
          FROM m JOIN t ON t.fold <> m.fold GROUP BY m.fold),
    b AS (SELECT g.candidate, s.fold, xy / (xx + alpha) AS beta, my - mx * xy / (xx + alpha) AS icpt FROM s, g),
    c AS (SELECT b.candidate, b.fold, -avg((icpt + beta * x - y) * (icpt + beta * x - y)) AS score
          FROM b JOIN t ON t.fold = b.fold GROUP BY b.candidate, b.fold)"""


_ALPHAS = (0.0, 1000.0, 1000000.0)


@query(_cv_sql((1000.0,)) + " SELECT fold, round(score, 4) AS score FROM c")
def cv_ridge_scores(spark, sf_dir):
    d = _parts(spark, sf_dir).select_features([0])
    d = admit(d.df, ["x"], "y", unique_ids=True)
    cv = cross_validate(Pipeline().set_estimator("ridge", RidgeRegression(1000.0)), d, KFold(4),
                        [M.regression_scorers()["neg_mean_squared_error"]], SEED)
    rows = [(f.fold, f.test_scores["neg_mean_squared_error"]) for f in cv.folds]
    return spark.createDataFrame(rows, "fold int, s double").select("fold", F.round("s", 4).alias("score"))


@query(_cv_sql(_ALPHAS) + """ SELECT candidate, round(avg(score), 4) AS mean_score,
    CAST(rank() OVER (ORDER BY avg(score) DESC) AS INT) AS "rank" FROM c GROUP BY candidate""")
def grid_ridge_rank(spark, sf_dir):
    d = admit(_parts(spark, sf_dir).df, ["x"], "y", unique_ids=True)
    g = ridge_grid(d, KFold(4).assign(d), _ALPHAS, impute=None, scale=False)
    rows = [(i, m, r) for i, (m, r) in enumerate(zip(g.means, g.ranks, strict=True))]
    return spark.createDataFrame(rows, "candidate int, m double, rank int").select("candidate", F.round("m", 4).alias("mean_score"), "rank")


@query(_cv_sql(_ALPHAS) + """ SELECT candidate, round(avg(score), 4) AS mean_score,
    CAST(rank() OVER (ORDER BY avg(score) DESC) AS INT) AS "rank" FROM c GROUP BY candidate""")
def grid_search_plain(spark, sf_dir):
    d = admit(_parts(spark, sf_dir).df, ["x"], "y", unique_ids=True)
    name = "neg_mean_squared_error"
    g = search(lambda p: Pipeline().set_estimator("ridge", RidgeRegression(p["alpha"])), [("alpha", _ALPHAS)], d, KFold(4),
               [M.regression_scorers()[name]], name, SEED, execution=BoundedPool(4, 1, spark))
    rows = [(c.index, c.summaries[name].mean, c.rank) for c in g.candidates]
    return spark.createDataFrame(rows, "candidate int, m double, rank int").select("candidate", F.round("m", 4).alias("mean_score"), "rank")


@query("""SELECT min(label) AS low, max(label) AS high FROM (SELECT CASE WHEN l.toxic = 1 THEN 7 WHEN l.quality = 1 THEN 3 ELSE 5 END AS label,
    CASE WHEN l.toxic = 1 OR l.quality = 1 THEN 1 ELSE 0 END AS w FROM documents d JOIN labels l ON d.doc_id = l.doc_id) x WHERE w > 0""")
def class_discovery(spark, sf_dir):
    """Three labels, one of which has no weight."""
    joined = _read(spark, sf_dir, "documents").select("doc_id").join(_read(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, 7).when(F.col("quality") == 1, 3).otherwise(5)
    rows = joined.select(label.alias("label"), F.when(label == 5, 0.0).otherwise(1.0).alias("w"))
    return spark.createDataFrame([discover_classes(rows, "label", "w")], "low int, high int")


@query(ORACLE_SQL["pipeline_impute_scale_predict"])
def artifact_round_trip(spark, sf_dir):
    d = admit(_events(spark, sf_dir), ["a"], "y", finiteness=ALLOW_NAN, unique_ids=True)
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "model.bin")
        artifact.save(_pipeline(LinearRegression()).fit(d, SEED), path, artifact.Metadata(training_rows=d.rows, root_seed=SEED))
        model, _ = artifact.load(path, "regression")
    return model.predict(d.df, d.features, d.schema).select("row_id", F.round("prediction", 6).alias("prediction"))


@query("""SELECT candidate, CAST(rank() OVER (ORDER BY score DESC) AS INT) AS "rank"
    FROM (SELECT p_size AS candidate, round(avg(p_retailprice), 0) AS score FROM part GROUP BY p_size) s""")
def competition_rank(spark, sf_dir):
    # one row per candidate reaches the driver, as from a search
    s = _read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("candidate")).agg(F.round(F.avg("p_retailprice"), 0).alias("score")).collect()
    ranks = competition_ranks([r["score"] for r in s])
    return spark.createDataFrame([(r["candidate"], k) for r, k in zip(s, ranks, strict=True)], "candidate int, rank int")
