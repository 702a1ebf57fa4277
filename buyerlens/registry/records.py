"""Queries over metric records.

The records are measured from the given events: rule scores of every user are ranked on each
seed's held-out users, so they grow with the tables like the records of trained methods.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerlens.functions.frames import to_long
from buyerlens.functions.keyed import bucket
from buyerlens.operators import ranking, records, selection, significance, stability, transforms
from buyerlens.registry.base import query
from buyerlens.registry.events import features_of, stored_split_table, user_table
from buyerlens.registry.metrics import SEEDS as MAP_SEEDS
from buyerlens.registry.metrics import seed_assignments
from buyerlens.registry.sqlparts import part, r, split_case, stmt
from buyerlens.session import checkpoint_dir, materialise
from buyerlens.sources import records as sources
from buyerlens.sources.tables import read_or_build

SEEDS = (0, 1, 2, 3, 4, 5)
BETAS = (0.1, 0.5, 1.0)
LAMBDAS = (0.0, 1.0, 4.0)
METRICS = ("roc_auc", "pr_auc", "prec_at_10pct", "base_rate")
# Rule scores over the user table, in SQL that both engines read alike.
METHODS = {
    "raw": "n_events + total_purch_value / 100.0",
    "recency": "-recency_days",
    "frequency": "n_purch + 0.0",
    "monetary": "total_purch_value + 0.0",
    "price": "-mean_view_price",
}
TASKS = {"primary": "label_purchase", "churned": "label_churned"}
SWEEP_SCORE = "conversion * {b} * 10.0 + n_purch * {l} + mean_view_price / 10.0"


def per_seed(users: DataFrame) -> DataFrame:
    """Every user once per seed with the seed's split."""
    slot = bucket(F.col("seed"), "user_id", 100)
    return users.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS]))).withColumn(
        "split", F.when(slot < 60, "train").when(slot < 80, "val").otherwise("test")
    )


def _choices(name: str, value: str, options: dict):
    return F.inline(
        F.array(*[F.struct(F.lit(n).alias(name), c.alias(value)) for n, c in options.items()])
    )


def baseline_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(task, method, head, seed, metric, value)`` of five rule scores, smooth and in steps."""
    held_out = per_seed(user_table(spark, sf_dir)).where("split = 'test'")
    rules = {m: F.round(F.expr(e).cast("double"), 9) for m, e in METHODS.items()}
    rows = held_out.select("seed", *TASKS.values(), _choices("method", "rule", rules))
    heads = {"logreg": F.col("rule"), "gbt": F.floor(F.col("rule") / 5.0).cast("double")}
    rows = rows.select("*", _choices("head", "score", heads))
    labels = {t: F.col(c).cast("int") for t, c in TASKS.items()}
    scored = materialise(rows.select("seed", "method", "head", "score", _choices("task", "y", labels)))
    keys = ["task", "method", "head", "seed"]
    found = ranking.binary_metrics(scored, by=keys)
    return materialise(_rounded(to_long(found, keys, list(METRICS), "metric", "value")))


def _rounded(long: DataFrame) -> DataFrame:
    return long.withColumn("value", F.round("value", 9))


def sweep_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(beta, lambda_align, seed, metric, value)`` of a two-parameter score."""
    axis = {"beta": BETAS, "lambda_align": LAMBDAS}
    base = per_seed(user_table(spark, sf_dir)).where("split <> 'train'")
    for name, values in axis.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    score = F.expr(SWEEP_SCORE.format(b="beta", l="lambda_align")).cast("double")
    base = base.select(
        *axis,
        "seed",
        "split",
        F.round(score, 9).alias("score"),
        F.col("label_purchase").cast("int").alias("primary_y"),
        F.col("label_churned").cast("int").alias("churned_y"),
        "total_purch_value",
        "recency_days",
    )
    scored = materialise(base)
    keys = ["beta", "lambda_align", "seed"]
    by = [*keys, "split"]
    test = F.col("split") == "test"
    main = ranking.binary_metrics(scored, "primary_y", by=by)
    churn = ranking.binary_metrics(scored.where(test), "churned_y", by=keys)
    seen = scored.where(test).groupBy(*keys).agg(
        F.pow(F.corr("score", "total_purch_value"), 2).alias("_r2"),
        F.pow(F.corr("score", "recency_days"), 2).alias("mig"),
    )
    aligned = F.when(F.col("lambda_align") > 0, F.col("_r2"))
    pieces = [
        main.where(test).select(*keys, F.lit("pr_auc").alias("metric"), F.col("pr_auc").alias("value")),
        main.where(~test).select(*keys, F.lit("val_pr_auc").alias("metric"), F.col("pr_auc").alias("value")),
        churn.select(*keys, F.lit("churned_pr_auc").alias("metric"), F.col("pr_auc").alias("value")),
        seen.select(*keys, F.lit("r2_mean").alias("metric"), aligned.alias("value")),
        seen.select(*keys, F.lit("mig").alias("metric"), F.col("mig").alias("value")),
    ]
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return materialise(_rounded(out))


_AUC = """SELECT {keys}, metric, round(value, 9) AS value FROM (
  SELECT {keys}, unnest([
    {{'metric': 'roc_auc', 'value': (sum(rk) FILTER (y = 1) - max(p) * (max(p) + 1) / 2.0) / nullif(max(p) * (max(n) - max(p)), 0)}},
    {{'metric': 'pr_auc', 'value': sum(CAST(tp AS DOUBLE) / seen) FILTER (y = 1) / max(p)}},
    {{'metric': 'prec_at_10pct', 'value': sum(CASE WHEN seen <= k THEN y WHEN seen - tied < k
      THEN (k - (seen - tied)) * CAST(tied_pos AS DOUBLE) / tied / tied ELSE 0 END) / max(k)}},
    {{'metric': 'base_rate', 'value': avg(y)}}], recursive := true)
  FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS rk,
      sum(y) OVER d AS tp, count(*) OVER d AS seen, count(*) OVER g AS n, sum(y) OVER g AS p,
      sum(y) OVER (PARTITION BY {keys}, score) AS tied_pos, count(*) OVER (PARTITION BY {keys}, score) AS tied,
      greatest(1, round_even(count(*) OVER g * 0.1, 0)) AS k
    FROM {src} WINDOW g AS (PARTITION BY {keys}), w AS (PARTITION BY {keys} ORDER BY score),
      d AS (PARTITION BY {keys} ORDER BY score DESC)) GROUP BY {keys})"""
part(
    "bs",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS task, '{m}' AS method, '{h}' AS head, {s} AS seed, CAST({lab} AS INT) AS y, "
        f"{'sc' if h == 'logreg' else 'floor(sc / 5.0)'} AS score FROM (SELECT *, round(CAST({e} AS DOUBLE), 9) AS sc "
        f"FROM ut WHERE {split_case('user_id', str(s))} = 'test')"
        for s in SEEDS
        for m, e in METHODS.items()
        for h in ("logreg", "gbt")
        for t, lab in TASKS.items()
    )
    + ")",
    "ut",
)
part("rec", _AUC.format(keys="task, method, head, seed", src="bs"), "bs")
part(
    "ss",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT CAST({b} AS DOUBLE) AS beta, CAST({v} AS DOUBLE) AS lambda_align, {s} AS seed, "
        f"{split_case('user_id', str(s))} AS split, CAST(label_purchase AS INT) AS py, CAST(label_churned AS INT) AS cy, "
        f"total_purch_value, recency_days, round(CAST({SWEEP_SCORE.format(b=b, l=v)} AS DOUBLE), 9) AS score FROM ut"
        for s in SEEDS
        for b in BETAS
        for v in LAMBDAS
    )
    + ") WHERE split <> 'train'",
    "ut",
)
_SK = "beta, lambda_align, seed"
part("ssp", f"SELECT {_SK}, split, py AS y, score FROM ss", "ss")
part("ssc", f"SELECT {_SK}, cy AS y, score FROM ss WHERE split = 'test'", "ss")
part("swp", _AUC.format(keys=f"{_SK}, split", src="ssp"), "ssp")
part("swc", _AUC.format(keys=_SK, src="ssc"), "ssc")
part(
    "sw",
    f"""SELECT {_SK}, CASE WHEN split = 'test' THEN 'pr_auc' ELSE 'val_pr_auc' END AS metric, value
  FROM swp WHERE metric = 'pr_auc'
UNION ALL SELECT {_SK}, 'churned_pr_auc', value FROM swc WHERE metric = 'pr_auc'
UNION ALL SELECT {_SK}, 'r2_mean', CASE WHEN lambda_align > 0 THEN
    round(nullif(corr(score, total_purch_value), 'nan') ** 2, 9) END FROM ss WHERE split = 'test' GROUP BY {_SK}
UNION ALL SELECT {_SK}, 'mig', round(nullif(corr(score, recency_days), 'nan') ** 2, 9)
  FROM ss WHERE split = 'test' GROUP BY {_SK}""",
    "ss",
    "swp",
    "swc",
)


@query("baseline_records", stmt("rec", f"SELECT task, method, head, seed, metric, {r('value', 'value')} FROM rec"))
def baseline_records_query(spark, sf_dir):
    return baseline_records(spark, sf_dir)


@query("sweep_records", stmt("sw", f"SELECT {_SK}, metric, {r('value', 'value')} FROM sw"))
def sweep_records_query(spark, sf_dir):
    return sweep_records(spark, sf_dir)


part(
    "agr",
    """SELECT task, method, head, metric, n_seeds, avg(value) AS mean,
  CASE WHEN n_seeds > 1 THEN stddev_samp(value) ELSE 0 END AS std FROM (
  SELECT *, count(*) OVER (PARTITION BY task, method, head, metric) AS held,
    (SELECT count(DISTINCT seed) FROM rec) AS n_seeds FROM rec
  WHERE NOT (method = 'price' AND seed = 3 AND metric = 'prec_at_10pct')) WHERE held = n_seeds
GROUP BY task, method, head, metric, n_seeds""",
    "rec",
)


@query(
    "record_aggregate",
    stmt("agr", f"SELECT task, method, head, metric, n_seeds, {r('mean', 'mean')}, {r('std', 'std')} FROM agr"),
)
def record_aggregate(spark, sf_dir):
    rows = baseline_records(spark, sf_dir)
    lost = (F.col("method") == "price") & (F.col("seed") == 3) & (F.col("metric") == "prec_at_10pct")
    return records.aggregate(rows.where(~lost))


part(
    "ags",
    """SELECT beta, lambda_align, metric, count(*) AS n_seeds, avg(value) AS mean,
  coalesce(stddev_samp(value), 0) AS std FROM sw GROUP BY beta, lambda_align, metric""",
    "sw",
)
part(
    "pts",
    "SELECT beta, lambda_align, max(n_seeds) AS n_seeds, "
    + ", ".join(
        f"max(mean) FILTER (metric = '{m}') AS {m}_mean, max(std) FILTER (metric = '{m}') AS {m}_std"
        for m in ("pr_auc", "val_pr_auc", "churned_pr_auc", "r2_mean", "mig")
    )
    + " FROM ags GROUP BY beta, lambda_align",
    "ags",
)


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid points with means and deviations, stored: at most as many rows as the grid."""
    found = records.aggregate_sweep(sweep_records(spark, sf_dir))
    names = ("pr_auc", "val_pr_auc", "churned_pr_auc", "r2_mean", "mig")
    return materialise(records.points_wide(found, names))


@query(
    "sweep_aggregate",
    stmt("ags", f"SELECT beta, lambda_align, metric, n_seeds, {r('mean', 'mean')}, {r('std', 'std')} FROM ags"),
)
def sweep_aggregate(spark, sf_dir):
    return records.aggregate_sweep(sweep_records(spark, sf_dir))


_BEST = """SELECT task, method, mean FROM (SELECT task, method, avg(value) AS mean, row_number() OVER
  (PARTITION BY task ORDER BY avg(value) DESC, method) AS rn FROM rec
  WHERE head = '{head}' AND metric = 'pr_auc' AND method <> 'raw' AND value IS NOT NULL GROUP BY task, method) WHERE rn = 1"""
part("best", _BEST.format(head="gbt"), "rec")


@query("best_baseline", stmt("best", f"SELECT task, method, {r('mean', 'mean')} FROM best"))
def best_baseline(spark, sf_dir):
    return records.best_baselines(baseline_records(spark, sf_dir), "pr_auc", "gbt")


@query(
    "shared_seed_values",
    stmt(
        "rec",
        f"""SELECT a.task, a.head, a.seed, {r('a.value', 'a')}, {r('b.value', 'b')} FROM rec a JOIN rec b
  ON a.task = b.task AND a.head = b.head AND a.seed = b.seed AND a.metric = 'roc_auc' AND b.metric = 'roc_auc'
WHERE a.method = 'monetary' AND b.method = 'price' AND a.seed < 5 AND b.seed > 0""",
    ),
)
def shared_seed_values(spark, sf_dir):
    rows = baseline_records(spark, sf_dir).where("metric = 'roc_auc'")
    a = rows.where("method = 'monetary' AND seed < 5")
    b = rows.where("method = 'price' AND seed > 0")
    return records.shared_seeds(a, b, ["task", "head", "seed"])


@query(
    "seed_values",
    stmt(
        "rec sw",
        f"""SELECT 'sweep' AS source, seed, {r('value', 'value')} FROM sw
WHERE beta = 0.5 AND lambda_align = 1 AND metric = 'pr_auc'
UNION ALL SELECT 'baseline', seed, {r('value')} FROM rec
WHERE method = 'monetary' AND head = 'gbt' AND metric = 'pr_auc' AND task = 'primary'""",
    ),
)
def seed_values(spark, sf_dir):
    swept = records.at_point(sweep_records(spark, sf_dir), 0.5, 1.0, "pr_auc")
    base = records.of_method(baseline_records(spark, sf_dir), "monetary", "gbt", "pr_auc")
    return swept.select(F.lit("sweep").alias("source"), "*").unionByName(
        base.select(F.lit("baseline").alias("source"), "*")
    )


@query(
    "record_diff",
    stmt(
        "rec",
        f"""SELECT task, method, head, seed, metric,
  CASE WHEN method = 'price' AND seed = 5 THEN 'absent key'
    WHEN seed = 4 AND metric = 'base_rate' THEN 'absent metric' ELSE 'value' END AS problem,
  {r('value', 'value')}, {r('''CASE WHEN (method = 'price' AND seed = 5) OR (seed = 4 AND metric = 'base_rate') THEN NULL
    ELSE value + 0.01 END''', 'ref_value')} FROM rec
WHERE (method = 'price' AND seed = 5) OR (seed = 4 AND metric = 'base_rate')
  OR (value IS NOT NULL AND method = 'raw' AND seed = 2 AND metric = 'roc_auc')""",
    ),
)
def record_diff(spark, sf_dir):
    new = baseline_records(spark, sf_dir)
    ref = new.where("NOT (method = 'price' AND seed = 5) AND NOT (seed = 4 AND metric = 'base_rate')")
    moved = F.expr("method = 'raw' AND seed = 2 AND metric = 'roc_auc'")
    value = F.col("value") + F.when(moved, 0.01).otherwise(1e-12)
    return records.record_diff(new, ref.withColumn("value", value))


def _theta(t: str) -> str:
    return f"atan(abs({t}) / sqrt(n - 1))"


_T = "theta"
_TSQL = f"""CASE CAST(n - 1 AS INT) WHEN 1 THEN 1 - 2 * {_T} / pi() WHEN 2 THEN 1 - sin({_T})
  WHEN 3 THEN 1 - 2 / pi() * ({_T} + sin({_T}) * cos({_T}))
  WHEN 4 THEN 1 - sin({_T}) * (1 + cos({_T}) ** 2 / 2)
  WHEN 5 THEN 1 - 2 / pi() * ({_T} + sin({_T}) * (cos({_T}) + 2.0 / 3 * cos({_T}) ** 3)) END"""


def paired_sql(src: str, by: str, equal: str) -> str:
    """Fragments for paired tests of ``src`` rows ``(by, seed, a, b)``; masks are enumerated."""
    return f"""SELECT {by}, n AS n_seeds, mean_a, mean_b,
  CASE WHEN n >= 2 THEN 2.0 ** (1 - n) END AS wilcoxon_floor,
  CASE WHEN n < 2 THEN NULL WHEN eq THEN {equal} ELSE wp END AS wilcoxon_p,
  CASE WHEN n < 2 THEN NULL WHEN eq THEN {equal} WHEN sd = 0 THEN 0 ELSE {_TSQL} END AS ttest_p
FROM (SELECT *, {_theta('m / (sd / sqrt(n))')} AS theta FROM (
  SELECT {by}, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(a - b) AS m, stddev_samp(a - b) AS sd,
    bool_and(abs(a - b) <= 1e-8 + 1e-5 * abs(b)) AS eq FROM {src} GROUP BY {by})) s
LEFT JOIN (SELECT {by}, least(1.0, 2.0 * least(sum(CAST(w <= obs AS INT)), sum(CAST(w >= obs AS INT))) / count(*)) AS wp
  FROM (SELECT {by}, mask, any_value(obs) AS obs, sum(rk * ((mask >> CAST(i - 1 AS INT)) & 1)) AS w FROM (
    SELECT *, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) OVER (PARTITION BY {by}) AS obs,
      unnest(range(0, CAST(2 ** n AS INT))) AS mask FROM (
      SELECT {by}, d, row_number() OVER (PARTITION BY {by} ORDER BY seed) AS i, count(*) OVER (PARTITION BY {by}) AS n,
        rank() OVER (PARTITION BY {by} ORDER BY abs(d))
          + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0 AS rk
      FROM (SELECT {by}, seed, a - b AS d FROM {src}) WHERE d <> 0)) GROUP BY {by}, mask) GROUP BY {by}) USING ({by})"""


part(
    "pair1",
    """SELECT a.task, a.head, a.seed, a.value AS a, b.value AS b FROM rec a JOIN rec b
  ON a.task = b.task AND a.head = b.head AND a.seed = b.seed AND a.metric = 'pr_auc' AND b.metric = 'pr_auc'
WHERE a.method = 'monetary' AND b.method = 'price' AND a.value IS NOT NULL AND b.value IS NOT NULL""",
    "rec",
)
part("pt1", paired_sql("pair1", "task, head", "1.0"), "pair1")
_PT = ", ".join(r(c, c) for c in ("mean_a", "mean_b", "wilcoxon_floor", "wilcoxon_p", "ttest_p"))


@query("paired_tests", stmt("pt1", f"SELECT task, head, n_seeds, {_PT} FROM pt1"))
def paired_tests(spark, sf_dir):
    rows = baseline_records(spark, sf_dir).where("metric = 'pr_auc'")
    pairs = records.shared_seeds(
        rows.where("method = 'monetary'"), rows.where("method = 'price'"), ["task", "head", "seed"]
    )
    return significance.paired_tests(pairs, ["task", "head"])


part(
    "sigp",
    """SELECT b.task, b.method, best.method AS best_method, best.mean AS best_mean, b.seed, a.value AS a, b.value AS b
FROM rec b JOIN best ON best.task = b.task AND b.method <> best.method
JOIN rec a ON a.task = b.task AND a.method = best.method AND a.seed = b.seed AND a.head = 'gbt' AND a.metric = 'pr_auc'
WHERE b.head = 'gbt' AND b.metric = 'pr_auc' AND a.value IS NOT NULL AND b.value IS NOT NULL""",
    "rec",
    "best",
)
part("sigt", paired_sql("sigp", "task, method, best_method, best_mean", "NULL"), "sigp")


@query(
    "significance_vs_best",
    stmt(
        "sigt",
        f"""SELECT task, method, best_method, {r('best_mean', 'best_mean')}, n_seeds, {r('mean_b', 'mean')},
{', '.join(r(c, c) for c in ('wilcoxon_floor', 'wilcoxon_p', 'ttest_p'))} FROM sigt""",
    ),
)
def significance_vs_best(spark, sf_dir):
    return significance.significance_vs_best(baseline_records(spark, sf_dir))


def _front_sql(x: str, y: str, src: str = "pts", by: str = "") -> str:
    same = f"AND q.{by} = p.{by}" if by else ""
    return f"""SELECT p.* FROM {src} p WHERE p.{x} IS NOT NULL AND p.{y} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM {src} q WHERE q.{x} >= p.{x} AND q.{y} >= p.{y} AND (q.{x} > p.{x} OR q.{y} > p.{y}) {same})"""


# Means are compared after rounding, so that both engines order close points alike.
part(
    "ptr",
    "SELECT beta, lambda_align, n_seeds, "
    + ", ".join(
        f"round({m}_{s}, 9) AS {m}_{s}"
        for m in ("pr_auc", "val_pr_auc", "churned_pr_auc", "r2_mean", "mig")
        for s in ("mean", "std")
    )
    + " FROM pts",
    "pts",
)


def rounded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = grid_points(spark, sf_dir)
    cols = [c for c in points.columns if c.endswith(("_mean", "_std"))]
    return points.withColumns({c: F.round(c, 9) for c in cols})


@query(
    "pareto_frontier",
    stmt(
        "ptr",
        f"""SELECT beta, lambda_align, {r('mig_mean', 'mig_mean')}, {r('pr_auc_mean', 'pr_auc_mean')}
FROM ({_front_sql('mig_mean', 'pr_auc_mean', 'ptr')})""",
    ),
)
def pareto_frontier(spark, sf_dir):
    front = selection.pareto_frontier(rounded_points(spark, sf_dir), "mig_mean", "pr_auc_mean")
    return front.select("beta", "lambda_align", "mig_mean", "pr_auc_mean")


part(
    "sens",
    """SELECT beta, lambda_align, y, sl, x, xm, mult FROM (SELECT beta, lambda_align, val_pr_auc_mean AS y,
  mult, val_pr_auc_std * mult AS sl, unnest([{'xm': 'r2_mean', 'x': r2_mean_mean}, {'xm': 'mig', 'x': mig_mean}],
  recursive := true) FROM ptr, (SELECT unnest([0.5, 1.0, 2.0]) AS mult))""",
    "ptr",
)
part("sensf", _front_sql("x", "y", "(SELECT *, xm || mult AS g FROM sens)", "g"), "sens")
part(
    "sensb",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, xm || mult AS g, row_number() OVER (PARTITION BY xm, mult
  ORDER BY y DESC, beta, lambda_align) AS rn FROM sens WHERE y IS NOT NULL) WHERE rn = 1""",
    "sens",
)
part(
    "spot",
    """SELECT b.mult AS slack_multiple, b.xm AS x_metric, coalesce(c.beta, b.beta) AS beta,
  coalesce(c.lambda_align, b.lambda_align) AS lambda_align, CASE WHEN c.beta IS NULL THEN b.x ELSE c.x END AS x,
  coalesce(c.y, b.y) AS y, coalesce(b.sl, 0) AS y_slack, b.beta AS best_beta, b.lambda_align AS best_lambda_align,
  b.y AS best_y, (SELECT count(*) FROM sensf f WHERE f.g = b.g) AS frontier_size, c.beta IS NULL AS fallback_used
FROM sensb b LEFT JOIN (SELECT f.*, row_number() OVER (PARTITION BY f.g ORDER BY f.x DESC, f.beta, f.lambda_align) AS rn
  FROM sensf f JOIN sensb b ON f.g = b.g AND f.y >= b.y - coalesce(b.sl, 0)) c ON c.g = b.g AND c.rn = 1""",
    "sensf",
    "sensb",
)
_SPOT = (
    "beta, lambda_align, best_beta, best_lambda_align, frontier_size, fallback_used, "
    + ", ".join(r(c, c) for c in ("x", "y", "y_slack", "best_y"))
)


@query(
    "sweet_spot",
    stmt("spot", f"SELECT {_SPOT} FROM spot WHERE x_metric = 'r2_mean' AND slack_multiple = 1"),
)
def sweet_spot(spark, sf_dir):
    points = selection.selection_metric(rounded_points(spark, sf_dir), "val_pr_auc", "pr_auc")
    return selection.sweet_spots(points, "r2_mean_mean", "sel_mean", "sel_std")


@query(
    "selection_sensitivity",
    stmt("spot", f"SELECT CAST(slack_multiple AS DOUBLE) AS slack_multiple, x_metric, {_SPOT} FROM spot"),
)
def selection_sensitivity(spark, sf_dir):
    points = selection.with_settings(
        rounded_points(spark, sf_dir), [0.5, 1.0, 2.0], ["r2_mean", "mig"], "val_pr_auc"
    )
    return selection.sweet_spots(points, "_x_value", "_y_value", "_slack", ["slack_multiple", "x_metric"])


@query(
    "selection_metric",
    stmt(
        "ptr",
        f"""SELECT beta, lambda_align, {r('val_pr_auc_mean', 'sel_mean')}, {r('val_pr_auc_std', 'sel_std')},
  'val_pr_auc' AS selected_on, 'usual' AS variant FROM ptr
UNION ALL SELECT beta, lambda_align, {r('pr_auc_mean')}, {r('pr_auc_std')}, 'pr_auc', 'fallback' FROM ptr""",
    ),
)
def selection_metric(spark, sf_dir):
    points = rounded_points(spark, sf_dir)
    none = F.lit(None).cast("double")
    blind = points.withColumns({"val_pr_auc_mean": none, "val_pr_auc_std": none})
    cols = ["beta", "lambda_align", "sel_mean", "sel_std", "selected_on"]

    def pick(df, name):
        return selection.selection_metric(df, "val_pr_auc", "pr_auc").select(
            *cols, F.lit(name).alias("variant")
        )

    return pick(points, "usual").unionByName(pick(blind, "fallback"))


def _chosen(points: DataFrame) -> DataFrame:
    marked = selection.selection_metric(points, "val_pr_auc", "pr_auc")
    return selection.sweet_spots(marked, "r2_mean_mean", "sel_mean", "sel_std")


SPECS = [("primary", "pr_auc", "pr_auc"), ("churned", "pr_auc", "churned_pr_auc")]
part(
    "cmpp",
    """SELECT b.task, best.method AS best_baseline, 'pr_auc' AS metric, b.seed, s.value AS a, b.value AS b
FROM rec b JOIN best ON best.task = b.task AND best.method = b.method
JOIN sw s ON s.seed = b.seed AND s.metric = CASE b.task WHEN 'primary' THEN 'pr_auc' ELSE 'churned_pr_auc' END
JOIN (SELECT beta, lambda_align FROM spot WHERE x_metric = 'r2_mean' AND slack_multiple = 1) c
  ON s.beta = c.beta AND s.lambda_align = c.lambda_align
WHERE b.head = 'gbt' AND b.metric = 'pr_auc' AND s.value IS NOT NULL AND b.value IS NOT NULL""",
    "rec",
    "best",
    "sw",
    "spot",
)
part("cmpt", paired_sql("cmpp", "task, metric, best_baseline", "1.0"), "cmpp")


@query(
    "task_comparison",
    stmt("cmpt", f"SELECT task, metric, best_baseline, n_seeds, {_PT}, {r('mean_a - mean_b', 'delta')} FROM cmpt"),
)
def task_comparison(spark, sf_dir):
    swept = sweep_records(spark, sf_dir)
    found = records.points_wide(records.aggregate_sweep(swept), ("pr_auc", "val_pr_auc", "r2_mean"))
    cols = [c for c in found.columns if c.endswith(("_mean", "_std"))]
    points = materialise(found.withColumns({c: F.round(c, 9) for c in cols}))
    spot = _chosen(points).select("beta", "lambda_align")
    mine = swept.join(spot, ["beta", "lambda_align"]).select("seed", "metric", "value")
    return significance.task_comparison(mine, baseline_records(spark, sf_dir), SPECS, "gbt")


def _ablation_pick(where: str) -> str:
    return f"SELECT * FROM ptr WHERE {where} AND val_pr_auc_mean IS NOT NULL ORDER BY val_pr_auc_mean DESC, beta, lambda_align LIMIT 1"


@query(
    "ablation_table",
    stmt(
        "ptr spot best",
        f"""SELECT config, beta, lambda_align, {r('pr_auc_mean', 'mean')}, {r('pr_auc_std', 'std')},
  {r('mig_mean', 'mig')}, {r('r2_mean_mean', 'r2')} FROM (
  SELECT 'sweet_spot' AS config, p.* FROM ptr p JOIN spot s ON p.beta = s.beta AND p.lambda_align = s.lambda_align
    WHERE x_metric = 'r2_mean' AND slack_multiple = 1
  UNION ALL SELECT 'beta_vae', * FROM ({_ablation_pick('lambda_align = 0')})
  UNION ALL SELECT 'vae_align', * FROM ({_ablation_pick('beta = 1 AND lambda_align > 0')}))
UNION ALL SELECT 'bar (' || method || ')', NULL, NULL, {r('mean')}, NULL, NULL, NULL FROM best WHERE task = 'primary'""",
    ),
)
def ablation_table(spark, sf_dir):
    points = rounded_points(spark, sf_dir)
    marked = selection.selection_metric(points, "val_pr_auc", "pr_auc")
    rows = selection.ablation_points(marked, _chosen(points), "sel_mean")
    bar = records.best_baselines(baseline_records(spark, sf_dir), "pr_auc", "gbt").where("task = 'primary'")
    return selection.ablation_table(rows, bar, "pr_auc")


@query(
    "tradeoff_series",
    stmt(
        "pts",
        f"""SELECT lambda_align, CAST(row_number() OVER (PARTITION BY lambda_align ORDER BY beta) AS INT) AS place, beta,
  {r('r2_mean_mean', 'x')}, {r('r2_mean_std', 'x_err')}, {r('pr_auc_mean', 'y')}, {r('pr_auc_std', 'y_err')}
FROM pts WHERE r2_mean_mean IS NOT NULL AND pr_auc_mean IS NOT NULL""",
    ),
)
def tradeoff_series(spark, sf_dir):
    return selection.tradeoff_series(grid_points(spark, sf_dir), "r2_mean", "pr_auc")


@query(
    "extra_positives",
    stmt(
        "rec",
        f"""SELECT task, head, {r('''(avg(value) FILTER (method = 'monetary') - avg(value) FILTER (method = 'price')) * 10000''', 'extra_positives')}
FROM rec WHERE metric = 'prec_at_10pct' GROUP BY task, head""",
    ),
)
def extra_positives(spark, sf_dir):
    means = records.aggregate(baseline_records(spark, sf_dir)).where("metric = 'prec_at_10pct'")
    return selection.extra_positives(means, "monetary", "price")


part(
    "stm",
    """SELECT beta, lambda_align, avg(ari) AS ari_mean FROM ps WHERE k = 8 GROUP BY beta, lambda_align""",
    "ps",
)


@query(
    "three_way_frontier",
    stmt(
        "pts stm",
        f"""SELECT beta, lambda_align, {r('pr_auc_mean', 'downstream')}, {r('r2_mean_mean', 'r2')}, {r('ari_mean', 'ari_mean')}
FROM pts LEFT JOIN stm USING (beta, lambda_align)""",
    ),
)
def three_way_frontier(spark, sf_dir):
    agreement = stability.pairwise_stability(
        seed_assignments(spark, sf_dir).where("k = 8"), "id", MAP_SEEDS, ["beta", "lambda_align"]
    )
    return selection.three_way(grid_points(spark, sf_dir), agreement, "pr_auc")


@query(
    "most_stable_point",
    stmt(
        "ptr stm",
        f"""SELECT beta, lambda_align, {r('pr_auc_mean', 'downstream')}, {r('r2_mean_mean', 'r2')}, {r('ari_mean', 'ari_mean')}
FROM ptr LEFT JOIN stm USING (beta, lambda_align) WHERE pr_auc_mean >= (SELECT max(pr_auc_mean) FROM ptr) - 0.05
ORDER BY round(ari_mean, 9) DESC NULLS LAST, beta, lambda_align LIMIT 1""",
    ),
)
def most_stable_point(spark, sf_dir):
    agreement = stability.pairwise_stability(
        seed_assignments(spark, sf_dir).where("k = 8"), "id", MAP_SEEDS, ["beta", "lambda_align"]
    ).withColumn("ari_mean", F.round("ari_mean", 9))
    rows = materialise(selection.three_way(rounded_points(spark, sf_dir), agreement, "pr_auc"))
    return selection.most_stable_within(rows, "downstream", 0.05)


@query(
    "grid_lookup",
    stmt(
        "sw",
        f"""SELECT beta, lambda_align, seed, metric, {r('value', 'value')} FROM sw
WHERE beta = 0.5 AND lambda_align = 4 AND seed = (SELECT min(seed) FROM sw)""",
    ),
)
def grid_lookup(spark, sf_dir):
    rows = sweep_records(spark, sf_dir)
    first = rows.agg(F.min("seed").alias("s")).scalar()
    at = rows.where((F.col("beta") == 0.5) & (F.col("lambda_align") == 4.0))
    return at.withColumn("_s", first).where("seed = _s").drop("_s")


@query(
    "remaining_runs",
    stmt(
        "sw",
        f"""SELECT seed, beta, lambda_align FROM (SELECT unnest({list(range(8))}) AS seed),
  (SELECT CAST(unnest({list(BETAS)}) AS DOUBLE) AS beta), (SELECT CAST(unnest({list(LAMBDAS)}) AS DOUBLE) AS lambda_align)
WHERE (seed, beta, lambda_align) NOT IN (SELECT seed, beta, lambda_align FROM sw WHERE NOT (seed = 2 AND beta = 0.5))""",
    ),
)
def remaining_runs(spark, sf_dir):
    done = sweep_records(spark, sf_dir).where("NOT (seed = 2 AND beta = 0.5)")
    return sources.remaining(sources.grid(spark, range(8), BETAS, LAMBDAS), done)


@query(
    "run_manifest",
    stmt(
        "sw",
        """SELECT '0,1,2,3,4,5' AS seeds, '0.1,0.5,1.0' AS betas, '0.0,1.0,4.0' AS lambdas, count(*) AS n_runs,
  string_agg(run, ',' ORDER BY run) AS runs FROM (SELECT DISTINCT 's' || seed || '_b' ||
    CASE beta WHEN 1.0 THEN '1' ELSE CAST(beta AS VARCHAR) END || '_l' || CAST(CAST(lambda_align AS INT) AS VARCHAR) AS run FROM sw)""",
    ),
)
def run_manifest(spark, sf_dir):
    return sources.manifest(sweep_records(spark, sf_dir))


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep records in the nested form runs are stored in."""
    rows = sweep_records(spark, sf_dir)
    keys = ["seed", "beta", "lambda_align"]

    def value(name: str):
        return F.max(F.when(F.col("metric") == name, F.col("value")))

    wide = rows.groupBy(*keys).agg(
        *[value(m).alias(m) for m in ("pr_auc", "val_pr_auc", "churned_pr_auc", "r2_mean", "mig")]
    )
    plain = "map<string, double>"

    def tree(**tasks):
        return F.create_map(
            *[
                x
                for t, c in tasks.items()
                for x in (F.lit(t), F.create_map(F.lit("gbt"), F.create_map(F.lit("pr_auc"), F.col(c))))
            ]
        )

    r2 = F.struct(
        F.lit(None).cast(plain).alias("r2_per_construct"),
        F.col("r2_mean"),
        F.col("r2_mean").alias("r2_rfm_mean"),
    )
    return wide.select(
        F.lit("events").alias("dataset"),
        *keys,
        F.when(F.col("lambda_align") > 0, 12).otherwise(0).alias("aligned_dims"),
        F.create_map(F.lit("kl_free"), F.col("beta") + F.col("seed")).alias("loss_final"),
        F.array(F.create_map(F.lit("epoch"), F.lit(0.0))).alias("loss_history"),
        tree(primary="pr_auc", churned="churned_pr_auc").alias("downstream"),
        tree(primary="val_pr_auc").alias("downstream_val"),
        F.struct(
            "mig",
            F.col("mig").alias("sap"),
            F.lit(None).cast(plain).alias("mig_per_factor"),
            F.lit(None).cast(plain).alias("sap_per_factor"),
            F.lit(None).cast("map<string, struct<best_dim: int, best_r2: double>>").alias("axis_alignment"),
        ).alias("interpretability"),
        F.when(F.col("lambda_align") > 0, r2).alias("alignment"),
        F.lit(1.0).alias("wall_time_s"),
    )


_FLAT = stmt(
    "sw",
    f"""SELECT seed, beta, lambda_align, metric, {r('value', 'value')} FROM sw
UNION ALL SELECT seed, beta, lambda_align, 'sap', {r('value')} FROM sw WHERE metric = 'mig'
UNION ALL SELECT seed, beta, lambda_align, 'r2_rfm_mean', {r('value')} FROM sw WHERE metric = 'r2_mean'
UNION ALL SELECT DISTINCT seed, beta, lambda_align, 'kl_free', {r('beta + seed')} FROM sw
UNION ALL SELECT DISTINCT seed, beta, lambda_align, 'aligned_dims', CASE WHEN lambda_align > 0 THEN 12.0 ELSE 0.0 END FROM sw""",
)


@query("flatten_records", _FLAT)
def flatten_records(spark, sf_dir):
    return records.flatten(nested_records(spark, sf_dir))


@query("record_files", _FLAT)
def record_files(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    sources.write_records(nested_records(spark, sf_dir), path)
    return records.flatten(sources.read_sweep_records(spark, path))


@query(
    "table_cache",
    stmt("ut", "SELECT count(*) AS n, CAST(sum(n_events) AS BIGINT) AS events FROM ut"),
)
def table_cache(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/user-table-{uuid.uuid4().hex}"
    read_or_build(spark, path, lambda: user_table(spark, sf_dir))
    again = read_or_build(spark, path, lambda: user_table(spark, sf_dir).limit(0))
    return again.agg(F.count("*").alias("n"), F.sum("n_events").alias("events"))


@query(
    "record_concat",
    stmt(
        "rec",
        f"""SELECT method, count(*) AS n, CAST(sum(seed) AS BIGINT) AS seeds, {r('sum(value)', 'total')} FROM rec
WHERE method IN ('raw', 'price') GROUP BY method""",
    ),
)
def record_concat(spark, sf_dir):
    rows = baseline_records(spark, sf_dir)
    parts = [rows.where((F.col("seed") == s) & (F.col("method") == m)) for s in SEEDS for m in ("raw", "price")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("method").agg(
        F.count("*").alias("n"), F.sum("seed").alias("seeds"), F.sum("value").alias("total")
    )


@query(
    "top_changes",
    stmt(
        "utz uts",
        f"""SELECT label, name, {r('delta', 'delta')}, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER
  (PARTITION BY label ORDER BY abs(round(delta, 9)) DESC, name) AS place FROM (
  SELECT 'purchase' AS label, name, avg(z) FILTER (label_purchase) - avg(z) FILTER (NOT label_purchase) AS delta
    FROM utz JOIN uts USING (user_id) GROUP BY name
  UNION ALL SELECT 'churned', name, avg(z) FILTER (label_churned) - avg(z) FILTER (NOT label_churned)
    FROM utz JOIN uts USING (user_id) GROUP BY name)) WHERE place <= 8""",
    ),
)
def top_changes(spark, sf_dir):
    table = stored_split_table(spark, sf_dir)
    names = features_of(table)
    scaled = transforms.fit_scaler(table, names).apply(table, names)
    long = to_long(scaled, ["label_purchase", "label_churned"], names, "name", "z")
    gaps = []
    for label in ("purchase", "churned"):
        flag = F.col(f"label_{label}")
        gap = F.avg(F.when(flag, F.col("z"))) - F.avg(F.when(~flag, F.col("z")))
        gaps.append(
            long.groupBy("name").agg(F.round(gap, 9).alias("delta")).select(F.lit(label).alias("label"), "*")
        )
    return records.top_changes(gaps[0].unionByName(gaps[1]), "label", "name", "delta", 8)

