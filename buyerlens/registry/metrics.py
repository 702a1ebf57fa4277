"""Queries for ranking, clustering, interpretability and stability metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerlens.operators import clustering_quality as quality
from buyerlens.operators import interpretability as interp
from buyerlens.operators import ranking, stability
from buyerlens.registry.base import SEED, query
from buyerlens.registry.events import split_table
from buyerlens.registry.sqlparts import part, r, stmt
from buyerlens.session import materialise

Z_DIMS = 6
FACTORS = 4
SEEDS = (0, 1, 2, 3)
SIZES = (5, 8, 12)
GRID = ((0.5, 0.0), (0.5, 1.0), (1.0, 0.0), (1.0, 1.0))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, features)`` with double features."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity labels against the length, exact and in steps of 200 characters."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(docs, "doc_id")
    length = F.col("n_chars").cast("double")
    heads = {"smooth": length, "stepped": F.floor(length / 200).cast("double")}
    cells = [
        F.struct(F.lit(t).alias("task"), F.lit(h).alias("head"), F.col(t).alias("y"), s.alias("score"))
        for t in ("quality", "toxic")
        for h, s in heads.items()
    ]
    return materialise(rows.select("doc_id", F.inline(F.array(*cells))))


part(
    "sd",
    """SELECT doc_id, 'quality' AS task, 'smooth' AS head, quality AS y, CAST(n_chars AS DOUBLE) AS score
  FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, 'quality', 'stepped', quality, floor(n_chars / 200.0) FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, 'toxic', 'smooth', toxic, n_chars FROM labels JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, 'toxic', 'stepped', toxic, floor(n_chars / 200.0) FROM labels JOIN documents USING (doc_id)""",
)
part(
    "sdr",
    """SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY task, head, score) - 1) / 2.0 AS rk,
  sum(y) OVER d AS tp, count(*) OVER d AS seen, count(*) OVER (PARTITION BY task, head) AS n,
  sum(y) OVER (PARTITION BY task, head) AS p,
  sum(y) OVER (PARTITION BY task, head, score) AS tied_pos,
  count(*) OVER (PARTITION BY task, head, score) AS tied
FROM sd WINDOW w AS (PARTITION BY task, head ORDER BY score),
  d AS (PARTITION BY task, head ORDER BY score DESC)""",
    "sd",
)


def _binary(spark, sf_dir, *columns):
    scored = scored_documents(spark, sf_dir)
    return ranking.binary_metrics(scored, by=["task", "head"]).select("task", "head", *columns)


@query(
    "roc_auc",
    stmt(
        "sdr",
        f"""SELECT task, head, {r('(sum(rk) FILTER (y = 1) - max(p) * (max(p) + 1) / 2.0) / (max(p) * (max(n) - max(p)))', 'roc_auc')}
FROM sdr GROUP BY task, head""",
    ),
)
def roc_auc(spark, sf_dir):
    return _binary(spark, sf_dir, "roc_auc")


@query(
    "average_precision",
    stmt(
        "sdr",
        f"""SELECT task, head, {r('sum(CAST(tp AS DOUBLE) / seen) FILTER (y = 1) / max(p)', 'pr_auc')}
FROM sdr GROUP BY task, head""",
    ),
)
def average_precision(spark, sf_dir):
    return _binary(spark, sf_dir, "pr_auc")


@query(
    "precision_at_k",
    stmt(
        "sdr",
        f"""SELECT task, head, {r('''sum(CASE WHEN seen <= k THEN y
      WHEN seen - tied < k THEN (k - (seen - tied)) * CAST(tied_pos AS DOUBLE) / tied / tied ELSE 0 END) / max(k)''', 'prec_at_10pct')}
FROM (SELECT *, greatest(1, round_even(n * 0.1, 0)) AS k FROM sdr) GROUP BY task, head""",
    ),
)
def precision_at_k(spark, sf_dir):
    return _binary(spark, sf_dir, "prec_at_10pct")


@query(
    "base_rate",
    stmt("sd", f"SELECT task, head, {r('avg(y)', 'base_rate')} FROM sd GROUP BY task, head"),
)
def base_rate(spark, sf_dir):
    return _binary(spark, sf_dir, "base_rate")


@query(
    "majority_rate",
    stmt(
        "uts",
        f"""SELECT split, max(n) AS largest, {r('max(n) / sum(n)', 'majority_rate')} FROM (
  SELECT split, next_code, count(*) AS n FROM uts WHERE next_code IS NOT NULL GROUP BY 1, 2) GROUP BY split""",
    ),
)
def majority_rate(spark, sf_dir):
    return ranking.base_rates(split_table(spark, sf_dir), "label_next_code", ["split"])


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight coarse class scores per vector; labels 8 and 9 are classes never seen in training."""
    rows = embeddings(spark, sf_dir)
    head = F.transform(F.slice("features", 1, 8), lambda x: F.round(x, 1))
    return rows.select("id", F.col("label").alias("y"), head.alias("proba"))


part(
    "cs",
    """SELECT vec_id AS id, label AS y, CAST(generate_subscripts(proba, 1) - 1 AS INT) AS class, unnest(proba) AS p
FROM (SELECT vec_id, label, list_transform(embedding[1:8], lambda x: round(CAST(x AS DOUBLE), 1)) AS proba
  FROM embeddings)""",
)
part(
    "csr",
    """SELECT id, y, CASE WHEN y > 7 THEN 8 ELSE count(*) FILTER (p > own OR (p = own AND class > y)) END AS rank
FROM (SELECT *, max(p) FILTER (class = y) OVER (PARTITION BY id) AS own FROM cs) GROUP BY id, y""",
    "cs",
)


@query("true_class_rank", stmt("csr", "SELECT id, CAST(rank AS INT) AS rank FROM csr"))
def true_class_rank(spark, sf_dir):
    return class_scores(spark, sf_dir).select("id", ranking.true_class_rank("proba", "y").alias("rank"))


@query(
    "topk_accuracy",
    stmt(
        "csr",
        f"""SELECT {r('avg(CAST(rank < 1 AS INT))', 'acc_at_1')}, {r('avg(CAST(rank < 3 AS INT))', 'acc_at_3')},
  {r('avg(CAST(rank < 5 AS INT))', 'acc_at_5')}, CAST(8 AS BIGINT) AS n_classes,
  {r('(SELECT max(c) FROM (SELECT count(*) AS c FROM csr WHERE y < 8 GROUP BY y)) / count(*)', 'base_rate')}
FROM csr""",
    ),
)
def topk_accuracy(spark, sf_dir):
    return ranking.multiclass_metrics(class_scores(spark, sf_dir)).drop("macro_ovr_auc")


part(
    "ovr",
    """SELECT class, (sum(rk) FILTER (hit = 1) - P * (P + 1) / 2.0) / (P * (N - P)) AS auc FROM (
  SELECT class, CAST(y = class AS INT) AS hit,
    rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2.0 AS rk,
    sum(CAST(y = class AS INT)) OVER (PARTITION BY class) AS P, count(*) OVER (PARTITION BY class) AS N
  FROM cs) GROUP BY class, P, N""",
    "cs",
)


@query("one_vs_rest_auc", stmt("ovr", f"SELECT class, {r('auc', 'roc_auc')} FROM ovr"))
def one_vs_rest_auc(spark, sf_dir):
    return ranking.one_vs_rest_auc(class_scores(spark, sf_dir), "y", "proba")


@query("macro_ovr_auc", stmt("ovr", f"SELECT {r('avg(auc)', 'macro_ovr_auc')} FROM ovr"))
def macro_ovr_auc(spark, sf_dir):
    return ranking.multiclass_metrics(class_scores(spark, sf_dir)).select("macro_ovr_auc")


part(
    "el",
    """SELECT vec_id AS id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS dim,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings""",
)
@query(
    "silhouette",
    f"""SELECT {r('avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette_squared')} FROM (
  SELECT id, max(CASE WHEN l1 = l2 THEN s / nullif(n - 1, 0) END) AS a,
    min(CASE WHEN l1 <> l2 THEN s / n END) AS b, max(CASE WHEN l1 = l2 THEN n END) AS own_n FROM (
    SELECT p.vec_id AS id, p.label AS l1, q.label AS l2,
      sum(list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2) AS s, count(*) AS n
    FROM embeddings p, embeddings q GROUP BY 1, 2, 3) GROUP BY id)""",
)
def silhouette(spark, sf_dir):
    return quality.silhouette(embeddings(spark, sf_dir), "label", "features")


@query(
    "silhouette_euclidean",
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  ORDER BY md5('{SEED}:' || vec_id), vec_id LIMIT {quality.SILHOUETTE_ROWS})
SELECT {r('avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')} FROM (
  SELECT id, max(CASE WHEN l1 = l2 THEN s / nullif(n - 1, 0) END) AS a,
    min(CASE WHEN l1 <> l2 THEN s / n END) AS b, max(CASE WHEN l1 = l2 THEN n END) AS own_n FROM (
    SELECT p.vec_id AS id, p.label AS l1, q.label AS l2, sum(list_distance(p.x, q.x)) AS s, count(*) AS n
    FROM e p, e q GROUP BY 1, 2, 3) GROUP BY id)""",
)
def silhouette_euclidean(spark, sf_dir):
    return quality.silhouette_euclidean(embeddings(spark, sf_dir), "label", "features", seed=SEED)


part("ec", "SELECT label, dim, avg(x) AS c, count(*) AS n FROM el GROUP BY label, dim", "el")


@query(
    "davies_bouldin",
    stmt(
        "el ec",
        f"""SELECT {r('avg(r)', 'davies_bouldin')} FROM (
  SELECT a.label, max((a.s + b.s) / d) AS r FROM
    (SELECT label, avg(g) AS s FROM (SELECT id, label, sqrt(sum((x - c) ** 2)) AS g
      FROM el JOIN ec USING (label, dim) GROUP BY id, label) GROUP BY label) a,
    (SELECT label, avg(g) AS s FROM (SELECT id, label, sqrt(sum((x - c) ** 2)) AS g
      FROM el JOIN ec USING (label, dim) GROUP BY id, label) GROUP BY label) b,
    (SELECT p.label AS l1, q.label AS l2, sqrt(sum((p.c - q.c) ** 2)) AS d
      FROM ec p JOIN ec q ON p.dim = q.dim GROUP BY 1, 2) c
  WHERE a.label <> b.label AND l1 = a.label AND l2 = b.label GROUP BY a.label)""",
    ),
)
def davies_bouldin(spark, sf_dir):
    return quality.davies_bouldin(embeddings(spark, sf_dir), "label", "features")


@query(
    "calinski_harabasz",
    stmt(
        "el ec",
        f"""SELECT {r('''(SELECT sum(n * (c - m) ** 2) FROM ec JOIN (SELECT dim, avg(x) AS m FROM el GROUP BY dim) USING (dim))
  / (SELECT sum((x - c) ** 2) FROM el JOIN ec USING (label, dim))
  * ((SELECT count(*) FROM embeddings) - k) / (k - 1)''', 'calinski_harabasz')}
FROM (SELECT count(DISTINCT label) AS k FROM embeddings)""",
    ),
)
def calinski_harabasz(spark, sf_dir):
    return quality.calinski_harabasz(embeddings(spark, sf_dir), "label", "features")


@query(
    "degenerate_clustering",
    """SELECT CAST(NULL AS DOUBLE) AS silhouette_squared, CAST(NULL AS DOUBLE) AS davies_bouldin,
  CAST(NULL AS DOUBLE) AS calinski_harabasz, count(DISTINCT label * 0) AS n_clusters_found FROM embeddings""",
)
def degenerate_clustering(spark, sf_dir):
    one = embeddings(spark, sf_dir).withColumn("label", F.col("label") * 0)
    return quality.clustering_metrics(one, "label", "features")


def construct_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight dimensions as truths, each predicted from the dimension eight places on."""
    e = F.col("features")
    cells = [
        F.struct(F.lit(f"c{i}").alias("name"), e[i].alias("y"), (e[i + 8] * 0.5).alias("p")) for i in range(8)
    ]
    return embeddings(spark, sf_dir).select(F.inline(F.array(*cells)))


part(
    "r2",
    """SELECT 'c' || a.dim AS name, 1 - sum((a.x - b.x * 0.5) ** 2) / (var_pop(a.x) * count(*)) AS r2
FROM el a JOIN el b ON a.id = b.id AND b.dim = a.dim + 8 WHERE a.dim < 8 GROUP BY a.dim""",
    "el",
)


@query("construct_r2", stmt("r2", f"SELECT name, {r('r2', 'r2')} FROM r2"))
def construct_r2(spark, sf_dir):
    return ranking.r2_scores(construct_predictions(spark, sf_dir))


@query(
    "construct_r2_summary",
    stmt(
        "r2",
        f"SELECT {r('avg(r2)', 'r2_mean')}, {r('''avg(r2) FILTER (name IN ('c0', 'c1', 'c2'))''', 'r2_rfm_mean')} FROM r2",
    ),
)
def construct_r2_summary(spark, sf_dir):
    scores = ranking.r2_scores(construct_predictions(spark, sf_dir))
    return ranking.r2_summary(scores, ["c0", "c1", "c2"])


def codes_and_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six code dimensions and four factors: mixed, squared, heavily tied, constant."""
    e = F.col("features")
    coded = embeddings(spark, sf_dir).select(
        "id",
        F.slice("features", 1, Z_DIMS).alias("z"),
        F.array(e[0] + e[6] * 0.5, e[1] * e[1], F.floor(e[2] * 10).cast("double"), e[0] * 0.0 + 1.0).alias("v"),
    )
    return materialise(coded)


_PROBS = "[" + ", ".join(repr(i * (1.0 / 20)) for i in range(1, 20)) + "]"
part("zl", f"SELECT id, dim, x FROM el WHERE dim < {Z_DIMS}", "el")
part(
    "vl",
    """SELECT id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS factor, unnest(v) AS x FROM (
  SELECT vec_id AS id, [e[1] + e[7] * 0.5, e[2] * e[2], floor(e[3] * 10), e[1] * 0.0 + 1.0] AS v
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""",
)
part(
    "zb",
    f"""SELECT id, dim, (SELECT count(DISTINCT e) FROM (SELECT unnest(q) AS e) WHERE e <= x) AS zb
FROM zl JOIN (SELECT dim, quantile_cont(x, {_PROBS}) AS q FROM zl GROUP BY dim) USING (dim)""",
    "zl",
)
part(
    "vb",
    f"""SELECT id, factor, (SELECT count(DISTINCT e) FROM (SELECT unnest(q) AS e) WHERE e <= x) AS vb
FROM vl JOIN (SELECT factor, quantile_cont(x, {_PROBS}) AS q FROM vl GROUP BY factor) USING (factor)""",
    "vl",
)
part(
    "fh",
    """SELECT factor, -sum(p * ln(p)) AS h FROM (
  SELECT factor, vb, count(*) / sum(count(*)) OVER (PARTITION BY factor) AS p FROM vb GROUP BY factor, vb)
GROUP BY factor""",
    "vb",
)
part(
    "mi",
    """SELECT dim, factor, sum(p * ln(p / (pz * pv))) AS mi FROM (
  SELECT dim, factor, n / t AS p, sum(n) OVER (PARTITION BY dim, factor, zb) / t AS pz,
    sum(n) OVER (PARTITION BY dim, factor, vb) / t AS pv FROM (
    SELECT dim, factor, zb, vb, count(*) AS n, sum(count(*)) OVER (PARTITION BY dim, factor) AS t
    FROM zb JOIN vb USING (id) GROUP BY dim, factor, zb, vb)) GROUP BY dim, factor""",
    "zb",
    "vb",
)
part(
    "mig",
    """SELECT factor, CASE WHEN h >= 1e-12 THEN (m[1] - m[2]) / h END AS mig
FROM (SELECT factor, list(mi ORDER BY mi DESC) AS m FROM mi GROUP BY factor) JOIN fh USING (factor)""",
    "mi",
    "fh",
)
part(
    "zr",
    """SELECT dim, factor, CASE WHEN stddev_pop(b.x) < 1e-12 OR stddev_pop(a.x) < 1e-12 THEN 0.0
  ELSE corr(a.x, b.x) ** 2 END AS r2, stddev_pop(b.x) >= 1e-12 AS varies
FROM zl a JOIN vl b USING (id) GROUP BY dim, factor""",
    "zl",
    "vl",
)
part(
    "sap",
    """SELECT factor, CASE WHEN varies THEN m[1] - m[2] END AS sap FROM (
  SELECT factor, bool_or(varies) AS varies, list(r2 ORDER BY r2 DESC) AS m FROM zr GROUP BY factor)""",
    "zr",
)
part(
    "ax",
    """SELECT factor, dim AS best_dim, r2 AS best_r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY factor ORDER BY r2 DESC, dim) AS rn FROM zr) WHERE rn = 1""",
    "zr",
)


def _joint(df: DataFrame) -> DataFrame:
    return interp.joint_counts(df, interp.bin_edges(df, "z"), interp.bin_edges(df, "v"))


@query(
    "quantile_bins",
    stmt("vb", "SELECT id, factor, CAST(vb AS INT) AS vb FROM vb"),
)
def quantile_bins(spark, sf_dir):
    df = codes_and_factors(spark, sf_dir)
    binned = interp.digitise(df, "v", interp.bin_edges(df, "v"), "bins")
    return binned.select("id", F.posexplode("bins").alias("factor", "vb"))


@query("factor_entropy", stmt("fh", f"SELECT factor, {r('h', 'h')} FROM fh"))
def factor_entropy(spark, sf_dir):
    return interp.factor_entropy(_joint(codes_and_factors(spark, sf_dir)))


@query("mutual_information", stmt("mi", f"SELECT dim, factor, {r('mi', 'mi')} FROM mi"))
def mutual_information(spark, sf_dir):
    joint = _joint(codes_and_factors(spark, sf_dir))
    return interp.mutual_information(joint, ["dim", "factor"], "zb", "vb")


@query("mutual_information_gap", stmt("mig", f"SELECT factor, {r('mig', 'mig')} FROM mig"))
def mutual_information_gap(spark, sf_dir):
    return interp.mig_per_factor(_joint(codes_and_factors(spark, sf_dir)))


@query("squared_correlations", stmt("zr", f"SELECT dim, factor, {r('r2', 'r2')}, varies FROM zr"))
def squared_correlations(spark, sf_dir):
    return interp.squared_correlations(codes_and_factors(spark, sf_dir))


@query("separated_predictability", stmt("sap", f"SELECT factor, {r('sap', 'sap')} FROM sap"))
def separated_predictability(spark, sf_dir):
    return interp.sap_per_factor(interp.squared_correlations(codes_and_factors(spark, sf_dir)))


@query("axis_alignment", stmt("ax", f"SELECT factor, best_dim, {r('best_r2', 'best_r2')} FROM ax"))
def axis_alignment(spark, sf_dir):
    return interp.axis_alignment(interp.squared_correlations(codes_and_factors(spark, sf_dir)))


@query(
    "axis_labels",
    stmt(
        "ax",
        f"""SELECT best_dim, factor, {r('best_r2', 'best_r2')} FROM (SELECT *, row_number() OVER
  (PARTITION BY best_dim ORDER BY best_r2 DESC, factor) AS rn FROM ax) WHERE rn = 1""",
    ),
)
def axis_labels(spark, sf_dir):
    r2 = interp.squared_correlations(codes_and_factors(spark, sf_dir))
    return interp.axis_labels(interp.axis_alignment(r2))


@query(
    "interpretability_summary",
    stmt(
        "mig sap ax",
        f"""SELECT factor, {r('mig', 'mig')}, {r('sap', 'sap')}, best_dim, {r('best_r2', 'best_r2')}
FROM mig JOIN sap USING (factor) JOIN ax USING (factor)""",
    ),
)
def interpretability_summary(spark, sf_dir):
    return interp.summary(codes_and_factors(spark, sf_dir))


@query(
    "interpretability_overall",
    stmt(
        "mig sap",
        f"SELECT {r('avg(mig)', 'mig')}, {r('avg(sap)', 'sap')} FROM mig JOIN sap USING (factor)",
    ),
)
def interpretability_overall(spark, sf_dir):
    return interp.overall(interp.summary(codes_and_factors(spark, sf_dir)))


def seed_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of every vector per grid point, cluster number and seed: the place of the
    largest value in a run of dimensions that starts at a point given by all three."""
    points = F.array(*[F.struct(F.lit(b).alias("beta"), F.lit(v).alias("lambda_align")) for b, v in GRID])
    rows = embeddings(spark, sf_dir).select("*", F.inline(points))
    for name, values in {"k": SIZES, "seed": SEEDS}.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    start = (1 + 4 * F.col("beta") + 2 * F.col("lambda_align") + F.col("seed")).cast("int")
    rows = rows.withColumn("run", F.slice("features", start, F.col("k")))
    place = (F.array_position("run", F.array_max("run")) - 1).cast("int").alias("cluster")
    return rows.select("id", "label", "beta", "lambda_align", "k", "seed", place)


part(
    "sa",
    "SELECT id, label, beta, lambda_align, k, seed, CAST(list_position(run, list_max(run)) - 1 AS INT) AS cluster FROM ("
    + " UNION ALL ".join(
        f"SELECT vec_id AS id, label, CAST({b} AS DOUBLE) AS beta, CAST({lam} AS DOUBLE) AS lambda_align, "
        f"{k} AS k, {s} AS seed, embedding[{1 + int(4 * b) + int(2 * lam) + s}:{int(4 * b) + int(2 * lam) + s + k}] AS run "
        "FROM embeddings"
        for b, lam in GRID
        for k in SIZES
        for s in SEEDS
    )
    + ")",
)
part(
    "pc",
    """SELECT x.beta, x.lambda_align, x.k, x.seed AS seed_a, y.seed AS seed_b, x.cluster AS a, y.cluster AS b,
  count(*) AS n FROM sa x JOIN sa y ON x.id = y.id AND x.beta = y.beta AND x.lambda_align = y.lambda_align
  AND x.k = y.k AND x.seed < y.seed GROUP BY ALL""",
    "sa",
)
_G = "beta, lambda_align, k, seed_a, seed_b"
part(
    "ps",
    f"""SELECT {_G}, (ij - sa * sb / tt) / ((sa + sb) / 2 - sa * sb / tt) AS ari,
  mi / ((ha + hb) / 2) AS nmi FROM (
  SELECT {_G}, sum(n * (n - 1) / 2) AS ij, any_value(t * (t - 1) / 2) AS tt,
    sum(na * (na - 1) / 2 * n / na) AS sa, sum(nb * (nb - 1) / 2 * n / nb) AS sb,
    sum(n / t * ln(n * t / (na * nb))) AS mi,
    -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb FROM (
    SELECT *, CAST(sum(n) OVER (PARTITION BY {_G}, a) AS DOUBLE) AS na,
      CAST(sum(n) OVER (PARTITION BY {_G}, b) AS DOUBLE) AS nb,
      CAST(sum(n) OVER (PARTITION BY {_G}) AS DOUBLE) AS t FROM pc)
  GROUP BY {_G})""",
    "pc",
)


@query(
    "contingency_table",
    """SELECT label AS a, CAST(list_position(embedding[1:8], list_max(embedding[1:8])) - 1 AS INT) AS b,
  count(*) AS n FROM embeddings GROUP BY 1, 2""",
)
def contingency_table(spark, sf_dir):
    return stability.contingency(_two_partitions(spark, sf_dir), "label", "other")


def _two_partitions(spark, sf_dir):
    run = F.slice("features", 1, 8)
    place = (F.array_position(run, F.array_max(run)) - 1).cast("int")
    return embeddings(spark, sf_dir).select("id", "label", place.alias("other"))


@query(
    "adjusted_rand_index",
    stmt("ps", f"SELECT seed_a, seed_b, {r('ari', 'ari')} FROM ps WHERE beta = 0.5 AND lambda_align = 0 AND k = 8"),
)
def adjusted_rand_index(spark, sf_dir):
    return _one_config(spark, sf_dir).select("seed_a", "seed_b", "ari")


@query(
    "normalised_mutual_information",
    stmt("ps", f"SELECT seed_a, seed_b, {r('nmi', 'nmi')} FROM ps WHERE beta = 0.5 AND lambda_align = 0 AND k = 8"),
)
def normalised_mutual_information(spark, sf_dir):
    return _one_config(spark, sf_dir).select("seed_a", "seed_b", "nmi")


def _one_config(spark, sf_dir):
    rows = seed_assignments(spark, sf_dir).where("beta = 0.5 AND lambda_align = 0 AND k = 8")
    return stability.pair_scores(rows, "id", SEEDS)


@query(
    "pairwise_stability",
    stmt(
        "ps",
        f"""SELECT CAST(4 AS BIGINT) AS n_seeds, count(*) AS n_pairs, {r('avg(ari)', 'ari_mean')},
  {r('stddev_samp(ari)', 'ari_std')}, {r('avg(nmi)', 'nmi_mean')}, {r('stddev_samp(nmi)', 'nmi_std')}
FROM ps WHERE beta = 0.5 AND lambda_align = 0 AND k = 8""",
    ),
)
def pairwise_stability(spark, sf_dir):
    rows = seed_assignments(spark, sf_dir).where("beta = 0.5 AND lambda_align = 0 AND k = 8")
    return stability.pairwise_stability(rows, "id", SEEDS)


@query(
    "lone_seed_stability",
    """SELECT CAST(1 AS BIGINT) AS n_seeds, CAST(0 AS BIGINT) AS n_pairs, CAST(NULL AS DOUBLE) AS ari_mean,
  CAST(NULL AS DOUBLE) AS ari_std, CAST(NULL AS DOUBLE) AS nmi_mean, CAST(NULL AS DOUBLE) AS nmi_std
FROM (SELECT count(*) FROM embeddings)""",
)
def lone_seed_stability(spark, sf_dir):
    rows = seed_assignments(spark, sf_dir).where("beta = 0.5 AND lambda_align = 0 AND k = 8 AND seed = 0")
    return stability.pairwise_stability(rows, "id", [0])


@query(
    "stability_map",
    stmt(
        "ps",
        f"""SELECT beta, lambda_align, k, CAST(4 AS BIGINT) AS n_seeds, count(*) AS n_pairs, {r('avg(ari)', 'ari_mean')},
  {r('stddev_samp(ari)', 'ari_std')}, {r('avg(nmi)', 'nmi_mean')}, {r('stddev_samp(nmi)', 'nmi_std')}
FROM ps GROUP BY beta, lambda_align, k""",
    ),
)
def stability_map(spark, sf_dir):
    return stability.pairwise_stability(
        seed_assignments(spark, sf_dir), "id", SEEDS, ["beta", "lambda_align", "k"]
    )


@query(
    "universe_alignment",
    stmt(
        "uts",
        """SELECT seed, n, extra, n0 - (n - extra) AS lacking FROM (
  SELECT seed, count(*) AS n, count(*) FILTER (user_id % 10 = 3 AND seed = 1) AS extra,
    (SELECT count(*) FROM uts WHERE user_id % 10 <> 3) AS n0
  FROM uts, (SELECT unnest([0, 1, 2]) AS seed)
  WHERE NOT (seed IN (0, 2) AND user_id % 10 = 3) AND NOT (seed = 2 AND user_id % 10 = 4) GROUP BY seed)""",
    ),
)
def universe_alignment(spark, sf_dir):
    users = split_table(spark, sf_dir).select("user_id")
    digit = F.col("user_id") % 10
    frames = {
        0: users.where(digit != 3),
        1: users,
        2: users.where((digit != 3) & (digit != 4)),
    }
    return stability.same_universe(frames, "user_id")
