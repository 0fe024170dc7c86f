"""More registered queries: one for each operator that the headline queries don't run by themselves.

Their SQL computes the same results another way: Newton rounds, greedy placement and Fisher-Yates as
chained or recursive tables, SplitMix64 in 128-bit arithmetic, sums of whole numbers.
"""

from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.errors import ArtifactError, ValidationError, WorkflowError
from plumbline.functions import numeric, seeds
from plumbline.operators import metrics as M
from plumbline.operators.linear import GRADIENT, FittedLogistic, LinearRegression, LogisticRegression, RidgeRegression, SolverReport
from plumbline.operators.preprocess import SimpleImputer, StandardScaler, VarianceThreshold
from plumbline.operators.splitters import GroupKFold, KFold, StratifiedKFold, split_parts
from plumbline.plans.execution import BoundedPool, Sequential, diagnose
from plumbline.plans.pipeline import Pipeline
from plumbline.plans.queries import (_ALPHAS, _E, _P, _S, SEED, _binary, _coefficients, _cv_sql, _event_data, _events, _one, _parts, _pipeline,
                                     _read, _scored, _strata, query)
from plumbline.plans.selection import RECORD, cross_validate, grid, search
from plumbline.schema import FeatureSchema
from plumbline.sources import artifact
from plumbline.sources.dataset import ALLOW_NAN, CLASSIFICATION, Dataset, admit, matrix, matrix_init, repeated_ids, vector, vector_filled

MSE = "neg_mean_squared_error"


# -- sources ---------------------------------------------------------------------------------------
@query("""SELECT 'values' AS kind, * FROM (VALUES (0, 1.5), (1, 2.5), (2, 4.0)) v(row_id, value)
    UNION ALL SELECT 'filled' AS kind, range AS row_id, 2.5 AS value FROM range(1000)
    UNION ALL SELECT 'made' AS kind, range AS row_id, 0.5 * range - 1 AS value FROM range(1000)""")
def vector_sources(spark, sf_dir):
    made = {"values": vector(spark, [1.5, 2.5, 4.0]), "filled": vector_filled(spark, 1000, 2.5),
            "made": vector_filled(spark, 1000, lambda r: 0.5 * r - 1)}
    out = None
    for kind, df in made.items():
        df = df.select(F.lit(kind).alias("kind"), "row_id", "value")
        out = df if out is None else out.unionByName(df)
    return out


@query("""SELECT 'rows' AS kind, * FROM (VALUES (0, 1.0, 2.0), (1, 3.0, 4.0)) v(row_id, f0, f1)
    UNION ALL SELECT 'made' AS kind, range AS row_id, 10.0 * range AS f0, 10.0 * range + 1 AS f1 FROM range(500)""")
def matrix_sources(spark, sf_dir):
    rows = matrix(spark, [[1, 2], [3, 4]]).select(F.lit("rows").alias("kind"), "row_id", "f0", "f1")
    return rows.unionByName(matrix_init(spark, 500, 2, lambda r, k: r * 10 + k).select(F.lit("made").alias("kind"), "row_id", "f0", "f1"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_acctbal AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier")
def dataset_export(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("a"),
                                                F.col("s_nationkey").alias("b"), F.lit(0.0).alias("y"))
    rows = admit(s, ["a", "b"], "y").collect_features()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place long, a double, b double")


@query(f"SELECT row_id, x, z, w FROM {_P} WHERE row_id IN (1, 7, 150)")
def dataset_element_access(spark, sf_dir):
    d = _parts(spark, sf_dir)
    rows = [(i, d.element(i, 0), d.element(i, 1), d.row(i)["w"]) for i in (150, 1, 7)]
    return spark.createDataFrame(rows, "row_id long, x double, z double, w double")


@query(f"SELECT row_id, a, y, w, grp FROM (SELECT row_id, coalesce(a, -1) AS a, b, y, w, grp FROM {_E}) v WHERE b > 4 AND w < 3")
def dataset_view_access(spark, sf_dir):
    view = _event_data(spark, sf_dir).where("b > 4").where("w < 3")
    return view.df.select("row_id", F.when(F.isnan(view.features[0]), -1.0).otherwise(F.col(view.features[0])).alias("a"), view.target, view.weight,
                          view.group)


@query("SELECT l_orderkey AS row_id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def dataset_repeated_ids(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_tax").alias("x"), F.lit(0.0).alias("y"))
    data = admit(rows, ["x"], "y", check=False)
    try:
        admit(rows, ["x"], "y")
        raise AssertionError("repeated ids were admitted")
    except ValidationError:
        return repeated_ids(data)


@query("SELECT user_id AS \"group\", count(*) AS n FROM events GROUP BY user_id")
def dataset_group_counts(spark, sf_dir):
    return _event_data(spark, sf_dir, check=False).group_counts()


def _hex(*names: str) -> str:
    raw = "".join(f"{len(n.encode()):016x}{n.encode().hex()}" for n in names)
    return f"md5(encode('plumbline-feature-schema-v1') || from_hex('{len(names):016x}01{raw}'))"


@query(f"""SELECT 'fingerprint' AS what, 'plumbline-schema-v1:' || {_hex('height', 'weight')} AS value
    UNION ALL SELECT 'subset' AS what, 'plumbline-schema-v1:' || {_hex('weight')} AS value
    UNION ALL SELECT 'equal' AS what, 'true' AS value UNION ALL SELECT 'other order' AS what, 'false' AS value
    UNION ALL SELECT 'anonymous' AS what, 'false' AS value""")
def schema_equality(spark, sf_dir):
    s = FeatureSchema.named(["height", "weight"])
    rows = [("fingerprint", s.fingerprint()), ("subset", s.subset([1]).fingerprint()),
            *((what, str(s == other).lower()) for what, other in (
                ("equal", FeatureSchema.named(["height", "weight"])), ("other order", FeatureSchema.named(["weight", "height"])),
                ("anonymous", FeatureSchema.anonymous(2))))]
    return spark.createDataFrame(rows, "what string, value string")


# -- sums ------------------------------------------------------------------------------------------
@query("""SELECT CAST(sum(CAST(CASE l_linenumber % 2 WHEN 0 THEN 1 ELSE -1 END AS HUGEINT) * 9007199254740992 * 1024
    + 2 * CAST(l_suppkey AS HUGEINT) * 1024) AS DOUBLE) AS x, CAST(sum(CAST(l_partkey AS HUGEINT) * l_linenumber) AS DOUBLE) AS y FROM lineitem""")
def compensated_sums(spark, sf_dir):
    """Terms of 2**63 that mostly cancel, beside small ones: plain addition loses these."""
    sign = F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(-1.0)
    rows = _read(spark, sf_dir, "lineitem").select((sign * 2.0 ** 63 + 2.0 * 1024 * F.col("l_suppkey")).alias("x"), F.col("l_partkey").alias("p"),
                                                   F.col("l_linenumber").alias("n"))
    return _one(spark, x=numeric.exact_column_sums(rows, ["x"])[0], y=numeric.dot_columns(rows, "p", "n"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS product FROM lineitem")
def matrix_vector_compensated(spark, sf_dir):
    """1e17 q + n - 1e17 q: plain addition gives 0 or 16."""
    rows = _read(spark, sf_dir, "lineitem").withColumn("again", F.col("l_quantity"))
    out = numeric.matrix_vector(rows, ["l_quantity", "l_linenumber", "again"], [1e17, 1.0, -1e17])
    return out.select("l_orderkey", "l_linenumber", "product")


@query(f"""SELECT round(1 / (1 + exp(-z)), 9) AS sigmoid, round(ln(1 + exp(-abs(z))) + greatest(z, 0), 9) AS softplus
    FROM (SELECT (truth - 150000) / 5000 AS z FROM {_S}) x""")
def stable_functions(spark, sf_dir):
    z = (F.col("truth") - 150000) / 5000
    return _scored(spark, sf_dir).select(F.round(numeric.sigmoid(z), 9).alias("sigmoid"), F.round(numeric.softplus(z), 9).alias("softplus"))


# -- splitters -------------------------------------------------------------------------------------
_64 = "CAST(18446744073709551616 AS UHUGEINT)"


def _mixed(state: str) -> str:
    """SplitMix64's output for a state, in 128-bit arithmetic (fixed values of the generator)."""
    a = f"(xor({state}, {state} // 1073741824) * 13787848793156543929) % {_64}"
    b = f"(xor({a}, {a} // 134217728) * 10723151780598845931) % {_64}"
    return f"xor({b}, {b} // 2147483648)"


def _draws(classes: str) -> str:
    """(label, i, x): the draws 1, 2, ... of each class (label, n, seed as unsigned number)."""
    state = f"((CAST(seed AS UHUGEINT) + CAST(i AS UHUGEINT) * 11400714819323198485) % {_64})"
    return f"""SELECT label, i, n, x1 AS x FROM (SELECT label, i, n, s1 AS s, {_mixed('s1')} AS x1 FROM (
        SELECT label, n, i, {state} AS s1 FROM {classes}, LATERAL (SELECT unnest(range(1, n)) AS i)) q) q2"""


def _fisher_yates(classes: str, rows: str) -> str:
    """CTEs up to ``placed`` (row_id, label, p): the place of a row among its class after the shuffle. ``rows`` has
    (row_id, label, idx) with idx the place before."""
    return f"""draws AS ({_draws(classes)}),
    swaps AS (SELECT label, i, n - i + 1 AS p, CAST(x % CAST(n - i + 1 AS UHUGEINT) AS BIGINT) + 1 AS q FROM draws),
    walk AS (SELECT label, CAST(0 AS BIGINT) AS i, range(0, n) AS l FROM {classes}
        UNION ALL SELECT w.label, d.i, list_transform(w.l, lambda v, k: CASE WHEN k = d.p THEN w.l[d.q] WHEN k = d.q THEN w.l[d.p] ELSE v END) AS l
        FROM walk w JOIN swaps d ON d.label = w.label AND d.i = w.i + 1),
    final AS (SELECT w.label, w.l FROM walk w JOIN {classes} c ON c.label = w.label AND w.i = c.n - 1),
    spots AS (SELECT label, unnest(l) AS idx, generate_subscripts(l, 1) - 1 AS p FROM final),
    placed AS (SELECT r.row_id, r.label, s.p FROM {rows} r JOIN spots s ON s.label = r.label AND s.idx = r.idx)"""


def _unsigned(seed: int) -> int:
    return seed & ((1 << 64) - 1)


@query(f"""WITH RECURSIVE rows AS (SELECT s_suppkey AS row_id, 0 AS label, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier),
    classes AS (SELECT 0 AS label, count(*) AS n, {SEED} AS seed FROM supplier), {_fisher_yates('classes', 'rows')}
    SELECT row_id, CAST(ntile(5) OVER (ORDER BY p) - 1 AS INT) AS fold FROM placed""")
def kfold_exact_shuffle(spark, sf_dir):
    s = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("x"), F.lit(0.0).alias("y"))
    return KFold(5, shuffle=True, exact=True).assign(admit(s, ["x"], "y"), SEED)


def _strata_ctes(k: int) -> str:
    """CTEs from ``d`` (row_id, label) to ``s``: places (lo, m) of every fold among a class; ``c`` numbers the classes."""
    folds = " UNION ALL ".join(f"SELECT {f} AS fold" for f in range(k))
    return f"""c AS (SELECT label, n, row_number() OVER (ORDER BY lead_row) - 1 AS number, sum(n) OVER (ORDER BY lead_row) - n AS off
        FROM (SELECT label, count(*) AS n, min(row_id) AS lead_row FROM d GROUP BY label) c0),
    f AS (SELECT c.label, k.fold, n // {k} + CASE WHEN (((k.fold - off) % {k}) + {k}) % {k} < n % {k} THEN 1 ELSE 0 END AS m FROM c, ({folds}) k),
    s AS (SELECT label, fold, m, sum(m) OVER (PARTITION BY label ORDER BY fold) - m AS lo FROM f)"""


def _class_seed(seed: int, classes: int, unsigned: bool = False) -> str:
    made = [seeds.derive(seed, "stratified-k-fold-class", i) for i in range(classes)]
    return "CASE number " + " ".join(f"WHEN {i} THEN {_unsigned(x) if unsigned else repr(str(x))}" for i, x in enumerate(made)) + " END"


def _stratified_digest(rows: str, k: int, seed: int, classes: int) -> str:
    """CTEs up to ``assigned`` (row_id, label, fold) of a stratified split shuffled by digests."""
    return f"""d AS ({rows}), {_strata_ctes(k)},
    r AS (SELECT d.row_id, d.label, row_number() OVER (PARTITION BY d.label
        ORDER BY md5({_class_seed(seed, classes)} || ':' || CAST(d.row_id AS VARCHAR)), d.row_id) - 1 AS p FROM d JOIN c ON c.label = d.label),
    assigned AS (SELECT r.row_id, r.label, CAST(s.fold AS INT) AS fold FROM r JOIN s ON r.label = s.label AND r.p >= s.lo AND r.p < s.lo + s.m)"""


_STATUS = "SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label FROM orders"


@query(f"WITH {_stratified_digest(_STATUS, 3, SEED, 3)} SELECT row_id, fold FROM assigned")
def stratified_kfold_shuffled(spark, sf_dir):
    return StratifiedKFold(3, shuffle=True).assign(_strata(spark, sf_dir), SEED)


@query(f"""WITH RECURSIVE d AS (SELECT c_custkey AS row_id, ascii(c_mktsegment) AS label FROM customer), {_strata_ctes(4)},
    classes AS (SELECT label, n, {_class_seed(SEED, 5, True)} AS seed FROM c),
    rows AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS idx FROM d), {_fisher_yates('classes', 'rows')}
    SELECT r.row_id, CAST(s.fold AS INT) AS fold FROM placed r JOIN s ON r.label = s.label AND r.p >= s.lo AND r.p < s.lo + s.m""")
def stratified_exact_shuffle(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("x"),
                                                F.ascii("c_mktsegment").alias("label"))
    return StratifiedKFold(4, shuffle=True, exact=True).assign(admit(c, ["x"], "label", CLASSIFICATION), SEED)


_GREEDY = "CASE " + " ".join(f"WHEN {' AND '.join(f'l{f} <= l{g}' for g in range(f + 1, 4))} THEN {f}" for f in range(3)) + " ELSE 3 END"


@query(f"""WITH RECURSIVE g AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp DESC) AS rn FROM (SELECT grp, count(*) AS n FROM {_E} GROUP BY grp) g0),
    r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS grp, -1 AS fold, CAST(0 AS BIGINT) AS l0, CAST(0 AS BIGINT) AS l1, CAST(0 AS BIGINT) AS l2,
            CAST(0 AS BIGINT) AS l3
        UNION ALL SELECT g.rn, g.grp, q.f, {', '.join(f'l{f} + CASE WHEN q.f = {f} THEN n ELSE 0 END' for f in range(4))}
        FROM (SELECT r.*, {_GREEDY} AS f FROM r) q JOIN g ON g.rn = q.rn + 1)
    SELECT e.row_id, CAST(r.fold AS INT) AS fold FROM {_E} JOIN r ON e.grp = r.grp""")
def group_kfold(spark, sf_dir):
    return GroupKFold(4).assign(_event_data(spark, sf_dir, check=False))


# -- metrics ---------------------------------------------------------------------------------------
def _binary_sql(negate: str) -> str:
    """(name, value) of the seven binary metrics of the scored rows."""
    from plumbline.plans.queries import ORACLE_SQL
    names = {"accuracy": "accuracy", "balanced_accuracy": "balanced_accuracy", "precision": "precision", "recall": "recall", "f1": "f1",
             "neg_log_loss": "log_loss", "roc_auc": "roc_auc"}
    return " UNION ALL ".join(f"SELECT '{name}' AS name, {negate if name == 'neg_log_loss' else ''}value AS value FROM ({ORACLE_SQL[q]}) q_{name}"
                              for name, q in names.items())


@query(_binary_sql("-"))
def binary_scorers(spark, sf_dir):
    df = _scored(spark, sf_dir)
    rows = []
    for name, s in M.binary_scorers().items():
        own = df.select(F.col("label").alias("truth"), *([F.col("guess").alias("pred")] if s.needs == "label" else ["p"]), F.col("w").alias("weight"))
        rows.append((name, s(own, "weight")))
    return spark.createDataFrame(rows, "name string, v double").select("name", F.round("v", 9).alias("value"))


@query(_binary_sql("-"))
def binary_prediction_holder(spark, sf_dir):
    held = M.BinaryPredictions(_scored(spark, sf_dir), "label", "guess", "p", "w")
    return spark.createDataFrame(list(held.scores().items()), "name string, v double").select("name", F.round("v", 9).alias("value"))


@query(f"""SELECT 'neg_mean_absolute_error' AS name, round(-sum(w * abs(pred - truth)) / sum(w), 4) AS value FROM {_S}
    UNION ALL SELECT 'neg_mean_squared_error' AS name, round(-sum(w * (pred - truth) * (pred - truth)) / sum(w), 4) AS value FROM {_S}
    UNION ALL SELECT 'neg_root_mean_squared_error' AS name, round(-sqrt(sum(w * (pred - truth) * (pred - truth)) / sum(w)), 4) AS value FROM {_S}
    UNION ALL SELECT 'r2' AS name, round(1 - sum(w * (pred - truth) * (pred - truth)) / sum(w * (truth - m) * (truth - m)), 4) AS value
    FROM {_S}, (SELECT sum(w * truth) / sum(w) AS m FROM {_S}) a""")
def regression_scorers(spark, sf_dir):
    df = _scored(spark, sf_dir).select("truth", "pred", F.col("w").alias("weight"))
    rows = [(name, s(df, "weight")) for name, s in M.regression_scorers().items()]
    return spark.createDataFrame(rows, "name string, v double").select("name", F.round("v", 4).alias("value"))


def _accepts(check) -> bool:
    try:
        check()
    except WorkflowError:
        return False
    return True


@query("""SELECT 'two labels' AS what, (SELECT count(DISTINCT l) FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS l FROM orders
        UNION ALL SELECT o_orderkey % 2 AS l FROM orders) x) <= 2 AS accepted
    UNION ALL SELECT 'statuses' AS what, (SELECT count(DISTINCT o_orderstatus) FROM orders) <= 2 AS accepted
    UNION ALL SELECT 'probabilities' AS what, (SELECT count(*) FROM orders WHERE (o_orderkey % 100) / 100.0 NOT BETWEEN 0 AND 1) = 0 AS accepted
    UNION ALL SELECT 'odds' AS what, (SELECT count(*) FROM orders WHERE (o_orderkey % 100) / 50.0 NOT BETWEEN 0 AND 1) = 0 AS accepted
    UNION ALL SELECT 'missing' AS what, false AS accepted""")
def prediction_validation(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(
        (F.col("o_orderstatus") == "O").cast("int").alias("label"), (F.col("o_orderkey") % 2).alias("guess"), F.ascii("o_orderstatus").alias("status"),
        (F.col("o_orderkey") % 100 / 100.0).alias("p"), (F.col("o_orderkey") % 100 / 50.0).alias("odds"),
        F.when(F.col("o_orderkey") % 100 != 7, 0.5).alias("gap"))
    rows = [("two labels", _accepts(lambda: M.check_labels(o, ["label", "guess"], 1))), ("statuses", _accepts(lambda: M.check_labels(o, ["status"]))),
            ("probabilities", _accepts(lambda: M.check_probabilities(o, "p"))), ("odds", _accepts(lambda: M.check_probabilities(o, "odds"))),
            ("missing", _accepts(lambda: M.check_probabilities(o, "gap")))]
    return spark.createDataFrame(rows, "what string, accepted boolean")


@query("""SELECT * FROM (VALUES ('precision', 'error', 'error'), ('precision', 'nan', 'NaN'), ('precision', 'fallback', '0.0'),
    ('recall', 'error', 'error'), ('recall', 'nan', 'NaN'), ('recall', 'fallback', '0.0'), ('f1', 'error', 'error'), ('f1', 'nan', 'NaN'),
    ('f1', 'fallback', '0.0'), ('r2', 'error', 'error'), ('r2', 'nan', 'NaN'), ('r2', 'fallback', '1.0'),
    ('roc_auc', 'error', 'error'), ('roc_auc', 'nan', 'NaN'), ('roc_auc', 'fallback', '0.5')) v(metric, policy, value)""")
def undefined_policies(spark, sf_dir):
    """Metrics of rows in which nothing is positive, and of a constant truth."""
    n = _read(spark, sf_dir, "nation").select(F.lit(0).alias("truth"), F.lit(0).alias("pred"), F.lit(0.5).alias("p"))
    rows = []
    for name, metric in (("precision", M.precision), ("recall", M.recall), ("f1", M.f1), ("r2", M.r2), ("roc_auc", M.roc_auc)):
        for policy in (M.ERROR, M.NAN, M.FALLBACK):
            try:
                value = metric(n, undefined=policy)
                rows.append((name, policy, "NaN" if math.isnan(value) else str(value)))
            except ValidationError:
                rows.append((name, policy, "error"))
    return spark.createDataFrame(rows, "metric string, policy string, value string")


@query("""SELECT count(*) AS "count", round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS standard_deviation, round(min(m), 6) AS minimum,
    round(max(m), 6) AS maximum FROM (SELECT avg(p_retailprice) AS m FROM part GROUP BY p_size) x""")
def fold_score_summary(spark, sf_dir):
    """The summary that cross-validation makes of its fold scores, here of fifty groups."""
    scores = [r["m"] for r in _read(spark, sf_dir, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("m")).collect()]
    s = M.summarize(scores)
    return spark.createDataFrame([(s.count, *(round(x, 6) for x in (s.mean, s.standard_deviation, s.minimum, s.maximum)))],
                                 "count long, mean double, standard_deviation double, minimum double, maximum double")


# -- estimators ------------------------------------------------------------------------------------
def _newton(source: str, rounds: int, penalty: float) -> str:
    """CTEs theta0 .. theta``rounds`` (fold, a, b, i): weighted logistic regression of y on u and v with an
    intercept, by whole Newton steps; ``source`` has (fold, u, v, y, w)."""
    out = [f"theta0 AS (SELECT fold, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS i FROM {source} GROUP BY fold)"]
    for k in range(rounds):
        out.append(f"""sums{k} AS (SELECT fold, max(a) AS a, max(b) AS b, max(i) AS i, sum(e * u) + {penalty} * max(a) AS g1, sum(e * v) + {penalty} * max(b) AS g2,
        sum(e) AS g3, sum(q * u * u) + {penalty} AS h11, sum(q * u * v) AS h12, sum(q * u) AS h13, sum(q * v * v) + {penalty} AS h22, sum(q * v) AS h23, sum(q) AS h33
        FROM (SELECT s.fold, u, v, a, b, i, w * (p - y) AS e, w * p * (1 - p) AS q FROM (SELECT s.fold, u, v, y, w, a, b, i,
            1 / (1 + exp(-(a * u + b * v + i))) AS p FROM {source} s JOIN theta{k} t ON t.fold = s.fold) s) x GROUP BY fold)""")
        det = "(h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13))"
        out.append(f"""theta{k + 1} AS (SELECT fold,
        a - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / {det} AS a,
        b - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / {det} AS b,
        i - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / {det} AS i FROM sums{k})""")
    return ", ".join(out)


_ROUNDS = 9


@query(f"""WITH src AS (SELECT 0 AS fold, o_totalprice / 1e5 AS u, (o_orderkey % 13) / 13.0 AS v, CAST(1 AS DOUBLE) AS w,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS y FROM orders), {_newton('src', _ROUNDS, 1 / 1.7)}
    SELECT 'x' AS term, round(a, 6) AS value FROM theta{_ROUNDS} UNION ALL SELECT 'z' AS term, round(b, 6) AS value FROM theta{_ROUNDS}
    UNION ALL SELECT 'intercept' AS term, round(i, 6) AS value FROM theta{_ROUNDS}""")
def logistic_fit(spark, sf_dir):
    d = _binary(spark, sf_dir)
    return _coefficients(spark, LogisticRegression(c=1.7).fit(d.df, d.features, "label", d.schema))


@query("SELECT o_orderkey AS row_id, round(0.25 - 0.5 * o_totalprice / 1e5 + 2.0 * ((o_orderkey % 13) / 13.0), 9) AS decision FROM orders")
def logistic_decision_fixed_coef(spark, sf_dir):
    d = _binary(spark, sf_dir)
    m = FittedLogistic(LogisticRegression(), (-0.5, 2.0), 0.25, (0, 1), d.schema, SolverReport(1, 0.0, GRADIENT))
    return m.decision_function(d.df, d.features, d.schema, validate=True).select("row_id", F.round("decision", 9).alias("decision"))


@query("""SELECT 2 AS rank, 1 AS iterations, 'direct_solution' AS reason, round(0.5 * (syy - 2 * bx * sxy - 2 * bz * szy + bx * bx * sxx + 2 * bx * bz * sxz + bz * bz * szz), 2) AS objective
    FROM (SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS bx, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS bz FROM (
        SELECT regr_sxx(y, x) AS sxx, regr_sxx(y, z) AS szz, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_sxy(y, z) AS szy, regr_sxy(x, z) AS sxz
        FROM (SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 17 AS DOUBLE) AS z, p_retailprice AS y FROM part) p) m) b""")
def solver_report(spark, sf_dir):
    d = _parts(spark, sf_dir)
    r = LinearRegression().fit(d.df, d.features, "y", d.schema).report
    return spark.createDataFrame([(r.rank, r.iterations, r.reason, round(r.objective, 2))], "rank int, iterations int, reason string, objective double")


# -- pipelines and selection -----------------------------------------------------------------------
@query(f"""SELECT stage, width, (SELECT count(*) FROM {_E}) AS rows FROM (VALUES ('impute', 3), ('vary', 2), ('scale', 2)) v(stage, width)""")
def transformer_contract(spark, sf_dir):
    """Every stage's output has as many rows as its input, and the columns of its schema."""
    d = _event_data(spark, sf_dir)
    model = (Pipeline().add("impute", SimpleImputer()).add("vary", VarianceThreshold()).add("scale", StandardScaler())
             .set_estimator("model", LinearRegression()).fit(d))
    df, columns, schema, rows = d.df, list(d.features), d.schema, []
    for name, stage in model.stages:
        df, columns = stage.transform(df, columns, schema)
        schema = stage.output_schema
        rows.append((name, schema.width if len(columns) == schema.width else -1, df.count()))
    return spark.createDataFrame(rows, "stage string, width int, rows long")


def _cv_logistic_sql() -> str:
    seed = seeds.derive(SEED, "cross-validation-splitter")
    last = f"theta{_ROUNDS}"
    return f"""WITH ev AS (SELECT * FROM {_E}), {_stratified_digest('SELECT row_id, label FROM ev', 3, seed, 2)},
    folds AS (SELECT DISTINCT fold FROM assigned), kept AS (SELECT ev.row_id, a, b, ev.label, w, x.fold AS own FROM ev JOIN assigned x ON x.row_id = ev.row_id),
    m AS (SELECT f.fold, avg(a) AS ma, avg(b) AS mb, sqrt(var_pop(b)) AS sb FROM folds f JOIN kept k ON k.own <> f.fold GROUP BY f.fold),
    m2 AS (SELECT m.fold, avg(coalesce(a, ma)) AS mi, sqrt(var_pop(coalesce(a, ma))) AS si FROM m JOIN kept k ON k.own <> m.fold GROUP BY m.fold),
    z AS (SELECT m.fold, k.own, (coalesce(a, ma) - mi) / si AS u, (b - mb) / sb AS v, label AS y, w FROM kept k, m JOIN m2 ON m.fold = m2.fold),
    src AS (SELECT * FROM z WHERE own <> fold), {_newton('src', _ROUNDS, 1.0)},
    test AS (SELECT z.fold, y, w, a * u + b * v + i AS d, 1 / (1 + exp(-(a * u + b * v + i))) AS p FROM z JOIN {last} t ON t.fold = z.fold WHERE z.own = z.fold),
    runs AS (SELECT fold, tp, fp, sum(tp) OVER (PARTITION BY fold ORDER BY p DESC) AS above FROM (
        SELECT fold, p, sum(w * y) AS tp, sum(w * (1 - y)) AS fp FROM test GROUP BY fold, p) g)
    SELECT fold, 'accuracy' AS scorer, round(sum(CASE WHEN (d > 0) = (y = 1) THEN w ELSE 0 END) / sum(w), 6) AS score FROM test GROUP BY fold
    UNION ALL SELECT fold, 'neg_log_loss' AS scorer, round(-sum(w * CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) / sum(w), 6) AS score FROM test GROUP BY fold
    UNION ALL SELECT fold, 'roc_auc' AS scorer, round(sum(fp * (above - tp / 2)) / (sum(tp) * sum(fp)), 6) AS score FROM runs GROUP BY fold"""


@query(_cv_logistic_sql())
def cv_logistic_scores(spark, sf_dir):
    d = _event_data(spark, sf_dir, CLASSIFICATION)
    pipe = (Pipeline().add("impute", SimpleImputer("mean")).add("vary", VarianceThreshold()).add("scale", StandardScaler())
            .set_estimator("logistic", LogisticRegression()))
    cv = cross_validate(pipe, d, StratifiedKFold(3, shuffle=True), [M.binary_scorers()[s] for s in ("accuracy", "neg_log_loss", "roc_auc")],
                        SEED, execution=BoundedPool(3, 1, spark))
    rows = [(f.fold, s, f.test_scores[s]) for f in cv.folds for s in cv.scorers]
    return spark.createDataFrame(rows, "fold int, scorer string, score double").withColumn("score", F.round("score", 6))


def _suppliers(spark, sf_dir, weight=None) -> Dataset:
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_acctbal").alias("x"), (F.col("s_acctbal") * 2 + F.col("s_nationkey")).alias("y"),
                    F.when(F.col("s_suppkey") > 1, 1.0).otherwise(0.0).alias("w"))
    return admit(rows, ["x"], "y", weight=weight)


@query("""SELECT 'r2 of one row' AS run, fold, 'scoring' AS phase, 'test' AS part, 'r2' AS scorer FROM (SELECT unnest(range(0, 4)) AS fold) f
    UNION ALL SELECT 'no feature left' AS run, fold, 'fitting' AS phase, NULL AS part, NULL AS scorer FROM (SELECT unnest(range(0, 2)) AS fold) f
    UNION ALL SELECT 'no weight' AS run, fold, 'materialization' AS phase, NULL AS part, NULL AS scorer FROM (SELECT unnest(range(0, 2)) AS fold) f""")
def cv_failure_phases(spark, sf_dir):
    """Recorded failures of runs over four rows, over a constant feature, and where one part of each fold has no weight."""
    few = matrix(spark, [[float(i), 2.0 * i] for i in range(4)], ["x", "y"])
    four = admit(few, ["x"], "y")
    flat = admit(few.withColumn("x", F.lit(1.0)), ["x"], "y")
    light = admit(few.withColumn("w", F.when(F.col("row_id") >= 2, 1.0).otherwise(0.0)), ["x"], "y", weight="w")
    linear = Pipeline().set_estimator("m", LinearRegression())
    picky = Pipeline().add("vary", VarianceThreshold()).set_estimator("m", LinearRegression())
    runs = (("r2 of one row", linear, four, 4, "r2"), ("no feature left", picky, flat, 2, MSE), ("no weight", linear, light, 2, MSE))
    rows = []
    for run, pipe, data, folds, name in runs:
        cv = cross_validate(pipe, data, KFold(folds), [M.regression_scorers()[name]], failure_policy=RECORD)
        rows += [(run, f.fold, x.phase, x.part, x.scorer) for f in cv.folds for x in f.failures]
    return spark.createDataFrame(rows, "run string, fold long, phase string, part string, scorer string")


@query("SELECT 4 AS folds, 4 AS successful, true AS timed UNION ALL SELECT 4 AS folds, 0 AS successful, true AS timed")
def cv_successful_folds(spark, sf_dir):
    few = admit(matrix(spark, [[float(i), 2.0 * i] for i in range(4)], ["x", "y"]), ["x"], "y")
    rows = []
    for data, name in ((_suppliers(spark, sf_dir), MSE), (few, "r2")):
        cv = cross_validate(Pipeline().set_estimator("m", LinearRegression()), data, KFold(4), [M.regression_scorers()[name]], failure_policy=RECORD)
        rows.append((len(cv.folds), cv.successful, cv.mean_fit_seconds > 0 and cv.mean_score_seconds > 0))
    return spark.createDataFrame(rows, "folds int, successful int, timed boolean")


@query("""SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS candidate, a, b, c FROM (VALUES (0, 100.0), (1, 0.0)) x(i, a), (VALUES (0, false), (1, true)) y(j, b),
    (VALUES (0, 'p'), (1, 'q'), (2, 'r')) z(k, c)""")
def grid_expansion(spark, sf_dir):
    found = grid([("a", [100.0, 0.0]), ("b", [False, True]), ("c", ["p", "q", "r"])])
    return spark.createDataFrame([(i, p["a"], p["b"], p["c"]) for i, p in enumerate(found)], "candidate long, a double, b boolean, c string")


_TWO_AXES = f"""WITH t AS (SELECT row_id, x, y, CAST(ntile(4) OVER (ORDER BY row_id) - 1 AS INT) AS fold FROM {_P}),
    k AS (SELECT unnest(range(0, 4)) AS fold), g AS (SELECT 2 * i + j AS candidate, alpha, icept FROM (VALUES (0, 1000.0), (1, 0.0)) a(i, alpha),
        (VALUES (0, false), (1, true)) b(j, icept)),
    m AS (SELECT k.fold, avg(x) AS mx, avg(y) AS my, sum(x * x) AS xx0, sum(x * y) AS xy0 FROM k JOIN t ON t.fold <> k.fold GROUP BY k.fold),
    s AS (SELECT m.fold, max(mx) AS mx, max(my) AS my, max(xx0) AS xx0, max(xy0) AS xy0, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy
        FROM m JOIN t ON t.fold <> m.fold GROUP BY m.fold),
    b AS (SELECT candidate, fold, CASE WHEN icept THEN xy / (xx + alpha) ELSE xy0 / (xx0 + alpha) END AS beta,
        CASE WHEN icept THEN my - mx * xy / (xx + alpha) ELSE 0 END AS start FROM s, g),
    c AS (SELECT b.candidate, b.fold, -avg((start + beta * x - y) * (start + beta * x - y)) AS score FROM b JOIN t ON t.fold = b.fold GROUP BY b.candidate, b.fold),
    means AS (SELECT candidate, avg(score) AS mean_score FROM c GROUP BY candidate)"""


def _two_axes(spark, sf_dir):
    d = admit(_parts(spark, sf_dir).df, ["x"], "y", unique_ids=True)
    return search(lambda p: Pipeline().set_estimator("ridge", RidgeRegression(p["alpha"], p["icept"])), [("alpha", [1000.0, 0.0]), ("icept", [False, True])],
                  d, KFold(4), [M.regression_scorers()[MSE]], MSE, SEED)


@query(_TWO_AXES + ' SELECT candidate, round(mean_score, 4) AS mean_score, CAST(rank() OVER (ORDER BY mean_score DESC) AS INT) AS "rank" FROM means')
def grid_two_axes(spark, sf_dir):
    rows = [(c.index, c.summaries[MSE].mean, c.rank) for c in _two_axes(spark, sf_dir).candidates]
    return spark.createDataFrame(rows, "candidate int, m double, rank int").select("candidate", F.round("m", 4).alias("mean_score"), "rank")


@query(_TWO_AXES + """, best AS (SELECT candidate FROM means ORDER BY mean_score DESC, candidate LIMIT 1),
    w AS (SELECT avg(x) AS mx, avg(y) AS my, sum(x * x) AS xx0, sum(x * y) AS xy0, regr_sxx(y, x) AS xx, regr_sxy(y, x) AS xy FROM t)
    SELECT best.candidate, round(CASE WHEN icept THEN xy / (xx + alpha) ELSE xy0 / (xx0 + alpha) END, 6) AS coefficient,
        round(CASE WHEN icept THEN my - mx * xy / (xx + alpha) ELSE 0 END, 6) AS intercept FROM best JOIN g ON g.candidate = best.candidate, w""")
def search_refit(spark, sf_dir):
    found = _two_axes(spark, sf_dir)
    model = found.model.estimator[1]
    return spark.createDataFrame([(found.best, round(model.coefficients[0], 6), round(model.intercept, 6))],
                                 "candidate int, coefficient double, intercept double")


@query("SELECT 0 AS candidate, CAST(NULL AS INT) AS \"rank\", 4 AS scored UNION ALL SELECT 1 AS candidate, CAST(NULL AS INT) AS \"rank\", 4 AS scored")
def search_undefined_scores(spark, sf_dir):
    """R2 of single rows as NaN: every fold has its score, yet no candidate a rank."""
    few = admit(matrix(spark, [[float(i), 2.0 * i] for i in range(4)], ["x", "y"]), ["x"], "y")
    found = search(lambda p: Pipeline().set_estimator("m", RidgeRegression(p["alpha"])), [("alpha", [0.0, 1.0])], few, KFold(4),
                   [M.regression_scorers(M.NAN)["r2"]], "r2")
    rows = [(c.index, c.rank, len(c.report.scores("r2"))) for c in found.candidates]
    return spark.createDataFrame(rows, "candidate int, rank int, scored int")


@query(_cv_sql(_ALPHAS[1:2]) + """ SELECT k.fold, round(max(CASE WHEN name = 'MSE' THEN value END), 4) AS squared, round(max(CASE WHEN name = 'BIAS' THEN value END), 6) AS bias
    FROM (SELECT 'MSE' AS name, fold, score AS value FROM c UNION ALL
        SELECT 'BIAS' AS name, b.fold, -abs(avg(icpt + beta * x - y)) AS value FROM b JOIN t ON t.fold = b.fold GROUP BY b.fold) k GROUP BY k.fold""")
def extension_interfaces(spark, sf_dir):
    """A splitter and a scorer from outside the library."""

    class Quarters:
        def assign(self, data, seed=0):
            return KFold(4).assign(data, seed)

    class Bias:
        name, needs, positive = "bias", "value", None

        def __call__(self, df, weight=None):
            return -abs(df.agg(F.avg(F.col("pred") - F.col("truth"))).first()[0])

    d = admit(_parts(spark, sf_dir).df, ["x"], "y", unique_ids=True)
    cv = cross_validate(Pipeline().set_estimator("ridge", RidgeRegression(_ALPHAS[1])), d, Quarters(), [M.regression_scorers()[MSE], Bias()], SEED)
    rows = [(f.fold, f.test_scores[MSE], f.test_scores["bias"]) for f in cv.folds]
    return spark.createDataFrame(rows, "fold int, s double, b double").select("fold", F.round("s", 4).alias("squared"), F.round("b", 6).alias("bias"))


# -- artifacts -------------------------------------------------------------------------------------
@query(f"SELECT count(*) AS training_rows, {SEED} AS root_seed, false AS weighted, 'events' AS source, 2 AS stages FROM events")
def artifact_metadata(spark, sf_dir):
    d = admit(_events(spark, sf_dir), ["a"], "y", finiteness=ALLOW_NAN, unique_ids=True)
    with tempfile.TemporaryDirectory() as folder:  # a small file of the driver's own
        path = os.path.join(folder, "model.bin")
        artifact.save(_pipeline(LinearRegression()).fit(d, SEED), path,
                      artifact.Metadata(training_rows=d.rows, root_seed=SEED, sample_weighted=False, labels=(("source", "events"),)))
        model, found = artifact.load(path, "regression")
    return spark.createDataFrame([(found.training_rows, found.root_seed, found.sample_weighted, dict(found.labels)["source"], len(model.stages))],
                                 "training_rows long, root_seed int, weighted boolean, source string, stages int")


@query("""SELECT * FROM (VALUES ('whole', true), ('another task', false), ('cut off', false), ('one byte changed', false), ('more bytes', false),
    ('too many bytes', false), ('too many features', false)) v(file, accepted)""")
def artifact_validation(spark, sf_dir):
    d = _event_data(spark, sf_dir)
    raw = artifact.encode(Pipeline().add("impute", SimpleImputer()).set_estimator("m", LinearRegression()).fit(d))
    changed = bytearray(raw)
    changed[len(raw) // 2] ^= 1
    files = (("whole", raw, "regression", None), ("another task", raw, "classification", None), ("cut off", raw[:-1], "regression", None),
             ("one byte changed", bytes(changed), "regression", None), ("more bytes", raw + b"x", "regression", None),
             ("too many bytes", raw, "regression", artifact.Limits(max_bytes=len(raw) - 1)),
             ("too many features", raw, "regression", artifact.Limits(max_features=2)))
    rows = []
    for name, data, task, limits in files:
        try:
            artifact.decode(data, task, **({"limits": limits} if limits else {}))
            rows.append((name, True))
        except ArtifactError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "file string, accepted boolean")


# -- seeds and execution ---------------------------------------------------------------------------
@query(f"""WITH c AS (SELECT 0 AS label, 1001 AS n, {SEED} AS seed), x AS ({_draws('c')})
    SELECT i AS draw, CAST(CASE WHEN x >= 9223372036854775808 THEN CAST(x AS HUGEINT) - 18446744073709551616 ELSE CAST(x AS HUGEINT) END AS BIGINT) AS value,
    CAST(x // 2048 AS DOUBLE) / 9007199254740992 AS uniform FROM x""")
def seed_values(spark, sf_dir):
    """A thousand draws of the generator, as whole numbers and as fractions."""
    whole, part, rows = seeds.Rng(SEED), seeds.Rng(SEED), []
    for i in range(1, 1001):
        value, whole = whole.next_int64()
        uniform, part = part.next_float()
        rows.append((i, value, uniform))
    return spark.createDataFrame(rows, "draw long, value long, uniform double")


@query(f"""WITH RECURSIVE names AS (SELECT * FROM (VALUES ('cross_validate', 0), ('cross_validate', 1), ('pipeline-estimator:model', 2)) v(name, number)),
    f AS (SELECT name, number, 0 AS k, CAST(14695981039346656037 AS UHUGEINT) AS h FROM names UNION ALL
        SELECT name, number, k + 1, (xor(h, CAST(ascii(substring(name, k + 1, 1)) AS UHUGEINT)) * 1099511628211) % {_64} FROM f WHERE k < length(name)),
    m AS (SELECT name, number, {_mixed('h')} AS a, CAST(number AS UHUGEINT) AS n FROM f WHERE k = length(name)),
    s AS (SELECT name, number, xor(xor(CAST({SEED} AS UHUGEINT), a), {_mixed('n')}) AS z FROM m),
    t AS (SELECT name, number, {_mixed('z')} AS x FROM s)
    SELECT name, number, CAST(CASE WHEN x >= 9223372036854775808 THEN CAST(x AS HUGEINT) - 18446744073709551616 ELSE CAST(x AS HUGEINT) END AS BIGINT) AS value FROM t""")
def seed_derivation(spark, sf_dir):
    rows = [(name, k, seeds.derive(SEED, name, k)) for name, k in (("cross_validate", 0), ("cross_validate", 1), ("pipeline-estimator:model", 2))]
    return spark.createDataFrame(rows, "name string, number int, value long")


@query("""SELECT backend, nationkey, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = nationkey) AS suppliers
    FROM (SELECT n_nationkey AS nationkey FROM nation) n, (VALUES ('sequential'), ('pool')) b(backend)""")
def execution_maps(spark, sf_dir):
    """A job for each nation, one after another and from four threads."""
    keys = sorted(r[0] for r in _read(spark, sf_dir, "nation").select("n_nationkey").collect())
    suppliers = _read(spark, sf_dir, "supplier")
    rows = []
    for name, backend in (("sequential", Sequential()), ("pool", BoundedPool(4, 1, spark))):
        found = backend.map(lambda i, k: (k, suppliers.where(F.col("s_nationkey") == k).count()), keys)
        rows += [(name, k, n) for k, n in found]
    return spark.createDataFrame(rows, "backend string, nationkey int, suppliers long")


@query("""SELECT * FROM (VALUES ('invalid environment limit'), ('conflicting environment limits'), ('workers exceed recommended'), ('nested parallelism'),
    ('potential oversubscription')) v(warning), (SELECT 3 AS inner_threads, 12 AS runnable) r""")
def oversubscription(spark, sf_dir):
    d = diagnose(4, None, 2, {"OMP_NUM_THREADS": "2", "MKL_NUM_THREADS": "3", "BLIS_NUM_THREADS": "x"})
    return spark.createDataFrame([(w, d.inner_threads, d.runnable) for w, _ in d.warnings], "warning string, inner_threads int, runnable int")


@query(f"""SELECT fold, count(*) AS rows, round(sum(y), 4) AS total FROM (SELECT CAST(ntile(3) OVER (ORDER BY row_id) - 1 AS INT) AS fold, y FROM {_E}) x GROUP BY fold""")
def split_views(spark, sf_dir):
    """Test parts of an assignment, as lazy views of one dataset."""
    data = _event_data(spark, sf_dir, check=False)
    out: DataFrame | None = None
    for f, s in enumerate(split_parts(data, KFold(3).assign(data))):
        own = s.test.df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("y"), 4).alias("total")).select(F.lit(f).alias("fold"), "rows", "total")
        out = own if out is None else out.unionByName(own)
    return out
