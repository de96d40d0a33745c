"""The engine's queries over the driver tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clustrum.functions import profile
from clustrum.functions.scratch import cut, scratch_root
from clustrum.operators import density, dimred, gmm, hierarchical, kmeans, metrics, pairwise, select, spectral, stability
from clustrum.operators.preprocess import STRATEGIES, Preprocessor, Strategy, fit_yeo_johnson, yeo_johnson
from clustrum.operators.schema import ColumnTypes, infer_column_types
from clustrum.sources import sinks, tables

from . import workflow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Between two consecutive pair distances of the smallest embeddings, so rounding can't move a pair over it.
EPS = 1.1775


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))


def labels(spark: SparkSession, sf_dir: str, label: Column | None = None) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") if label is None else label).cast("int").alias("label"))


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir, F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("label")))


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with nulls: the balance of every seventh key, the segment of every fifth."""
    return table(spark, sf_dir, "customer").withColumns({"c_acctbal": F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))})


def prepared(spark: SparkSession, sf_dir: str, strategy: Strategy, columns: ColumnTypes | None = None) -> tuple[DataFrame, Preprocessor]:
    df = customers(spark, sf_dir)
    types = columns or ColumnTypes(["c_acctbal"], ["c_mktsegment", "c_nationkey"], ["c_custkey"])
    model = Preprocessor(types, strategy).fit(df)
    return model.transform(df), model


P = "p AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS f, label FROM embeddings)"
NOISY = "n AS (SELECT vec_id AS row_id, CAST(CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS INTEGER) AS label FROM embeddings)"
CUST = "c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS seg FROM customer)"

# ---- profiling


@query("SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def profile_shape(spark, sf_dir):
    return profile.shape(table(spark, sf_dir, "lineitem"))


@query(f"""WITH {CUST} SELECT 'c_acctbal' AS "column", count(*) - count(bal) AS n_null, count(*) AS n_rows FROM c
UNION ALL SELECT 'c_mktsegment', count(*) - count(seg), count(*) FROM c""")
def profile_missing(spark, sf_dir):
    return profile.missing_columns(customers(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in ("l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")))
def profile_distinct(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"])


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'continuous' END AS kind FROM lineitem" for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
) + " UNION ALL SELECT unnest(['l_returnflag', 'l_linestatus', 'l_shipdate']), 'categorical' UNION ALL SELECT 'l_orderkey', 'excluded'")
def infer_types(spark, sf_dir):
    t = infer_column_types(table(spark, sf_dir, "lineitem"), ("l_orderkey",))
    rows = [(c, kind) for kind in ("continuous", "categorical", "excluded") for c in getattr(t, kind)]
    return spark.createDataFrame(rows, "column string, kind string")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS \"min\", round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS \"max\" FROM lineitem"
    for c in ("l_extendedprice", "l_discount")
))
def describe(spark, sf_dir):
    return rounded(profile.describe(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount"]))


@query(f"WITH {CUST} SELECT seg AS value, count(*) AS n FROM c GROUP BY seg")
def value_counts(spark, sf_dir):
    return profile.value_counts(customers(spark, sf_dir), "c_mktsegment")


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 50 AS w FROM orders),
h AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 49) AS BIGINT) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT b.bin, round(lo + b.bin * w, 6) AS lower, round(lo + (b.bin + 1) * w, 6) AS upper, coalesce(n, 0) AS n FROM (SELECT unnest(range(50)) AS bin) b CROSS JOIN e LEFT JOIN h ON b.bin = h.bin""")
def histogram50(spark, sf_dir):
    return rounded(profile.histogram(table(spark, sf_dir, "orders"), "o_totalprice"))


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h, count(*) AS n FROM orders),
b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 1024)), 1023) AS bin, count(*) AS k FROM orders, e GROUP BY 1),
g AS (SELECT CAST(j AS INTEGER) AS point, lo + (hi - lo) * j / 199 AS x FROM e, LATERAL (SELECT unnest(range(200)) AS j))
SELECT g.point, round(any_value(g.x), 6) AS x, round(sum(k * exp(-0.5 * pow((g.x - (lo + (bin + 0.5) * (hi - lo) / 1024)) / h, 2))) / any_value(h * sqrt(2 * pi())) * any_value((hi - lo) / 50), 6) AS height FROM g, b, e GROUP BY g.point""")
def density50(spark, sf_dir):
    return rounded(profile.density(table(spark, sf_dir, "orders"), "o_totalprice").drop("density"))


_CORR = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a, b in _CORR))
def correlations(spark, sf_dir):
    return rounded(profile.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("SELECT round(max(abs(r)), 6) AS max_abs_r, count(*) FILTER (WHERE abs(r) > 0.7) AS n_strong FROM (" + " UNION ALL ".join(f"SELECT corr({a}, {b}) AS r FROM lineitem" for a, b in _CORR) + ")")
def correlation_summary(spark, sf_dir):
    return rounded(profile.correlation_summary(profile.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS lowest, max({c}) AS highest, round(max({c}) - min({c}), 6) AS spread FROM lineitem" for c in ("l_quantity", "l_tax")))
def spread(spark, sf_dir):
    return profile.spread(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]).withColumn("spread", r6("spread"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(DISTINCT {c}) AS n_distinct, {k} AS kind FROM part"
    for c, t, k in (("p_partkey", "bigint", "'excluded'"), ("p_name", "string", "'categorical'"), ("p_brand", "string", "'categorical'"), ("p_type", "string", "'categorical'"), ("p_size", "int", "CASE WHEN count(DISTINCT p_size) <= 20 THEN 'categorical' ELSE 'continuous' END"), ("p_retailprice", "double", "CASE WHEN count(DISTINCT p_retailprice) <= 20 THEN 'categorical' ELSE 'continuous' END"))
))
def column_kinds(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    t = infer_column_types(df, ("p_partkey",))
    return profile.column_kinds(df, t.continuous, t.categorical)


@query(f"WITH {NOISY} SELECT count(*) AS n_rows, count(DISTINCT CASE WHEN label <> -1 THEN label END) AS n_clusters, count(*) FILTER (WHERE label = -1) AS n_noise, round(count(*) FILTER (WHERE label = -1) / count(*), 6) AS noise_share FROM n")
def label_summary(spark, sf_dir):
    return rounded(profile.label_summary(noisy(spark, sf_dir)))


# ---- preprocessing


@query(f"WITH {CUST} SELECT c_custkey, round(coalesce(bal, (SELECT median(bal) FROM c)), 6) AS v FROM c")
def impute_median(spark, sf_dir):
    out, _ = prepared(spark, sf_dir, Strategy("none"), ColumnTypes(["c_acctbal"], [], ["c_custkey"]))
    return out.select("c_custkey", r6(F.col("features")[0]).alias("v"))


@query(f"WITH {CUST}, i AS (SELECT c_custkey, coalesce(bal, (SELECT median(bal) FROM c)) AS x FROM c) SELECT c_custkey, round((x - (SELECT avg(x) FROM i)) / (SELECT stddev_pop(x) FROM i), 6) + 0.0 AS v FROM i")
def scale_standard(spark, sf_dir):
    out, _ = prepared(spark, sf_dir, Strategy("standard"), ColumnTypes(["c_acctbal"], [], ["c_custkey"]))
    return out.select("c_custkey", r6(F.col("features")[0]).alias("v"))


@query(f"""WITH {CUST}, i AS (SELECT c_custkey, coalesce(bal, (SELECT median(bal) FROM c)) AS x FROM c)
SELECT c_custkey, round((x - (SELECT median(x) FROM i)) / (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) FROM i), 6) + 0.0 AS v FROM i""")
def scale_robust(spark, sf_dir):
    out, _ = prepared(spark, sf_dir, Strategy("robust"), ColumnTypes(["c_acctbal"], [], ["c_custkey"]))
    return out.select("c_custkey", r6(F.col("features")[0]).alias("v"))


@query(f"""WITH {CUST}, v AS (SELECT DISTINCT coalesce(seg, 'missing') AS seg FROM c)
SELECT c_custkey, v.seg, CASE WHEN coalesce(c.seg, 'missing') = v.seg THEN 1.0 ELSE 0.0 END::DOUBLE AS hot FROM c CROSS JOIN v""")
def encode_onehot(spark, sf_dir):
    out, model = prepared(spark, sf_dir, Strategy("none", "onehot"), ColumnTypes([], ["c_mktsegment"], ["c_custkey"]))
    names = F.array(*(F.lit(n.split("=", 1)[1]) for n in model.feature_names()))
    return out.select("c_custkey", F.explode(F.arrays_zip(names.alias("seg"), F.col("features").alias("hot"))).alias("e")).select("c_custkey", "e.seg", "e.hot")


@query(f"""WITH {CUST}, v AS (SELECT seg, CAST(row_number() OVER (ORDER BY seg) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT coalesce(seg, 'missing') AS seg FROM c)),
k AS (SELECT c_nationkey, CAST(row_number() OVER (ORDER BY c_nationkey) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT c_nationkey FROM c))
SELECT c_custkey, v.code AS segment, k.code AS nation FROM c JOIN v ON coalesce(c.seg, 'missing') = v.seg JOIN k ON c.c_nationkey = k.c_nationkey""")
def encode_ordinal(spark, sf_dir):
    out, _ = prepared(spark, sf_dir, Strategy("none", "ordinal"), ColumnTypes([], ["c_mktsegment", "c_nationkey"], ["c_custkey"]))
    return out.select("c_custkey", F.col("features")[0].alias("segment"), F.col("features")[1].alias("nation"))


@query(f"WITH {CUST} SELECT c_custkey, round(count(*) OVER (PARTITION BY coalesce(seg, 'missing')) / (SELECT count(*) FROM c), 6) AS share FROM c")
def encode_frequency(spark, sf_dir):
    out, _ = prepared(spark, sf_dir, Strategy("none", "target_freq"), ColumnTypes([], ["c_mktsegment"], ["c_custkey"]))
    return out.select("c_custkey", r6(F.col("features")[0]).alias("share"))


@query("""WITH t AS (SELECT p_partkey, p_brand FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#3'), v AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT p_brand FROM t))
SELECT p_partkey, coalesce(v.code, -1.0) AS code FROM part LEFT JOIN v USING (p_brand)""")
def encode_unseen(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    model = Preprocessor(ColumnTypes([], ["p_brand"], ["p_partkey"]), Strategy("none", "ordinal")).fit(df.where("p_partkey % 2 = 0 AND p_brand < 'Brand#3'"))
    return model.transform(df).select("p_partkey", F.col("features")[0].alias("code"))


@query("""WITH z AS (SELECT o_orderkey, (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders) AS y FROM orders)
SELECT o_orderkey, round(CASE WHEN y >= 0 THEN (pow(y + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - y, 1.5) - 1) / 1.5 END, 6) + 0.0 AS v FROM z""")
def yeo_johnson_half(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    model = Preprocessor(ColumnTypes(["o_totalprice"], [], ["o_orderkey"]), Strategy("standard")).fit(df)
    return model.transform(df).select("o_orderkey", r6(yeo_johnson(F.col("features")[0], 0.5)).alias("v"))


@query()
def yeo_johnson_fit(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    found = fit_yeo_johnson(df, {"o_totalprice": (F.col("o_totalprice") - 150_000.0) / 50_000.0})
    return spark.createDataFrame(sorted(found.items()), "column string, lambda double")


@query()
def quantile_normal(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    model = Preprocessor(ColumnTypes(["value"], [], ["event_id"]), Strategy("quantile")).fit(df)
    return model.transform(df).select("event_id", r6(F.col("features")[0]).alias("v"))


def _strategy(name: str) -> Query:
    def run(spark, sf_dir):
        df = customers(spark, sf_dir).drop("c_name")
        types = infer_column_types(df, ("c_custkey",))
        return Preprocessor(types, STRATEGIES[name]).fit(df).transform(df)

    run.__name__ = "strategy_" + name.replace("+", "_")
    return run


for _name in STRATEGIES:
    query()(_strategy(_name))

# ---- neighbours

KNN = f"""{P}, d AS (SELECT a.row_id, b.row_id AS nbr_id, CASE WHEN a.row_id = b.row_id THEN 0.0 ELSE list_distance(a.f, b.f) END AS dist FROM p a CROSS JOIN p b),
knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY round(dist, 9), nbr_id) AS INTEGER) AS rank FROM d),
other AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY round(dist, 9), nbr_id) AS INTEGER) AS rank FROM d WHERE row_id <> nbr_id)"""


@query(f"WITH {KNN} SELECT row_id, nbr_id, round(dist, 6) AS dist, rank FROM knn WHERE rank <= 5")
def knn5(spark, sf_dir):
    p = points(spark, sf_dir)
    return rounded(pairwise.knn(p, p, 5)).select("row_id", "nbr_id", "dist", "rank")


@query(f"WITH {KNN} SELECT row_number() OVER (ORDER BY dist, row_id) - 1 AS position, round(dist, 6) AS dist FROM other WHERE rank = 4")
def k_distance_curve(spark, sf_dir):
    return rounded(pairwise.k_distance_curve(points(spark, sf_dir), 4)).withColumn("position", F.col("position").cast("long"))


@query(f"WITH {KNN} SELECT round(quantile_cont(dist, 0.95), 6) AS eps FROM other WHERE rank = 5")
def eps_quantile(spark, sf_dir):
    return spark.createDataFrame([(pairwise.pick_eps(points(spark, sf_dir), 5),)], "eps double").select(r6("eps").alias("eps"))


@query(f"""WITH {KNN}, v AS (SELECT k.row_id, p.label, count(*) AS n FROM knn k JOIN p ON k.nbr_id = p.row_id WHERE rank <= 5 GROUP BY ALL)
SELECT row_id, label FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) AS r FROM v) WHERE r = 1""")
def majority_vote(spark, sf_dir):
    p = points(spark, sf_dir)
    return pairwise.majority_vote(pairwise.knn(p, p, 5), labels(spark, sf_dir))


@query(f"""WITH {P}, {NOISY}, d AS (SELECT a.row_id, m.label, row_number() OVER (PARTITION BY a.row_id ORDER BY round(list_distance(a.f, b.f), 9), b.row_id) AS r
  FROM p a JOIN n ON a.row_id = n.row_id AND n.label = -1 CROSS JOIN p b JOIN n m ON b.row_id = m.row_id AND m.label <> -1),
v AS (SELECT row_id, label, row_number() OVER (PARTITION BY row_id ORDER BY count(*) DESC, label) AS r FROM d WHERE r <= 5 GROUP BY row_id, label)
SELECT n.row_id, coalesce(v.label, n.label) AS label FROM n LEFT JOIN v ON n.row_id = v.row_id AND v.r = 1""")
def noise_to_nearest(spark, sf_dir):
    return pairwise.assign_noise_to_nearest(points(spark, sf_dir), noisy(spark, sf_dir))


@query(f"WITH {NOISY} SELECT row_id, CAST(CASE WHEN label = -1 THEN (SELECT max(label) + 1 FROM n) ELSE label END AS INTEGER) AS label FROM n")
def noise_own_cluster(spark, sf_dir):
    return pairwise.noise_as_own_cluster(noisy(spark, sf_dir))


@query(f"""WITH {P}, s AS (SELECT * FROM p ORDER BY (row_id * 2654435761 + 42 * 40503) % 4294967296, row_id LIMIT 200),
d AS (SELECT a.row_id, b.label, row_number() OVER (PARTITION BY a.row_id ORDER BY round(CASE WHEN a.row_id = b.row_id THEN 0.0 ELSE list_distance(a.f, b.f) END, 9), b.row_id) AS r FROM p a CROSS JOIN s b),
v AS (SELECT row_id, label, row_number() OVER (PARTITION BY row_id ORDER BY count(*) DESC, label) AS r FROM d WHERE r <= 5 GROUP BY row_id, label)
SELECT row_id, label FROM v WHERE r = 1""")
def propagate_sample(spark, sf_dir):
    p = points(spark, sf_dir)
    some = stability.sample_rows(p, 200)
    return pairwise.propagate(p, some, labels(spark, sf_dir))


@query("SELECT vec_id AS row_id FROM embeddings ORDER BY (vec_id * 2654435761 + 43 * 40503) % 4294967296, vec_id LIMIT 400")
def sample_exact(spark, sf_dir):
    return stability.sample_rows(points(spark, sf_dir).select("row_id"), 400, 43)


# ---- metrics

_CENTRES = """l AS (SELECT label, unnest(f) AS x, generate_subscripts(f, 1) AS i, row_id FROM r), m AS (SELECT label, i, avg(x) AS m FROM l GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)"""
_DB = f"""{_CENTRES}, s AS (SELECT r.label, avg(list_distance(r.f, c.c)) AS s FROM r JOIN c USING (label) GROUP BY r.label),
db AS (SELECT round(avg(q), 6) AS davies_bouldin FROM (SELECT max((a.s + b.s) / list_distance(ca.c, cb.c)) AS q FROM s a JOIN c ca USING (label) JOIN s b ON a.label <> b.label JOIN c cb ON b.label = cb.label GROUP BY a.label))"""
_CH = """ g AS (SELECT i, avg(x) AS g FROM l GROUP BY i), k AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM r),
b AS (SELECT sum(n * (m - g) * (m - g)) AS b FROM m JOIN g USING (i) JOIN (SELECT label, count(*) AS n FROM r GROUP BY label) USING (label)),
w AS (SELECT sum((x - m) * (x - m)) AS w FROM l JOIN m USING (label, i)), ch AS (SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w, k)"""
_SIL = """dd AS (SELECT a.row_id, a.label AS own, b.label AS other, sum(CASE WHEN a.row_id = b.row_id THEN 0.0 ELSE list_distance(a.f, b.f) END) AS t, count(*) AS n FROM r a CROSS JOIN r b GROUP BY ALL),
ss AS (SELECT row_id, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM dd GROUP BY row_id),
sil AS (SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ss)"""
_ALL = f"r AS (SELECT p.row_id, p.f, p.label FROM p), {_DB}, {_CH}, {_SIL}"
_CLEAN = f"r AS (SELECT p.row_id, p.f, n.label FROM p JOIN n USING (row_id) WHERE n.label <> -1), {_DB}, {_CH}, {_SIL}"


@query(f"WITH {P}, {_ALL} SELECT silhouette FROM sil")
def silhouette(spark, sf_dir):
    return rounded(metrics.silhouette(metrics.labelled(points(spark, sf_dir), labels(spark, sf_dir))))


@query(f"WITH {P}, {_ALL} SELECT davies_bouldin FROM db")
def davies_bouldin(spark, sf_dir):
    return rounded(metrics.davies_bouldin(metrics.labelled(points(spark, sf_dir), labels(spark, sf_dir))))


@query(f"WITH {P}, {_ALL} SELECT calinski_harabasz FROM ch")
def calinski_harabasz(spark, sf_dir):
    return rounded(metrics.calinski_harabasz(metrics.labelled(points(spark, sf_dir), labels(spark, sf_dir))))


@query(f"WITH {P}, {_ALL} SELECT silhouette, davies_bouldin, calinski_harabasz, CAST(12.5 AS DOUBLE) AS bic FROM sil, db, ch")
def internal_metrics(spark, sf_dir):
    return rounded(metrics.internal_metrics(points(spark, sf_dir), labels(spark, sf_dir), bic=12.5))


@query(f"WITH {P}, {NOISY}, {_CLEAN} SELECT silhouette, davies_bouldin, calinski_harabasz, CAST(NULL AS DOUBLE) AS bic FROM sil, db, ch")
def metrics_without_noise(spark, sf_dir):
    return rounded(metrics.internal_metrics(points(spark, sf_dir), noisy(spark, sf_dir)))


@query("SELECT CAST(NULL AS DOUBLE) AS silhouette, CAST(NULL AS DOUBLE) AS davies_bouldin, CAST(NULL AS DOUBLE) AS calinski_harabasz, CAST(1.0 AS DOUBLE) AS bic")
def metrics_degenerate(spark, sf_dir):
    return metrics.internal_metrics(points(spark, sf_dir), labels(spark, sf_dir, F.lit(0)), bic=1.0)


def _ari(la: str, lb: str, rows: str) -> str:
    return f"""a AS (SELECT {la} AS la, {lb} AS lb FROM {rows}), t AS (SELECT CAST(sum(n * n) AS DOUBLE) AS ij, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT count(*) AS n FROM a GROUP BY la, lb)),
i AS (SELECT CAST(sum(n * n) AS DOUBLE) AS i FROM (SELECT count(*) AS n FROM a GROUP BY la)), j AS (SELECT CAST(sum(n * n) AS DOUBLE) AS j FROM (SELECT count(*) AS n FROM a GROUP BY lb)),
q AS (SELECT ij - n AS tp, i - ij AS fn, j - ij AS fp, n * n - i - j + ij AS tn FROM t, i, j)
SELECT round(CASE WHEN fn = 0 AND fp = 0 THEN 1.0 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END, 6) + 0.0 AS ari FROM q"""


@query(f"WITH {NOISY}, {_ari('n.label', 'e.label // 2', 'n JOIN embeddings e ON n.row_id = e.vec_id')}")
def adjusted_rand(spark, sf_dir):
    return rounded(metrics.adjusted_rand(noisy(spark, sf_dir), labels(spark, sf_dir, F.floor(F.col("label") / 2))))


# ---- clusterers


@query(f"""WITH RECURSIVE {P}, w AS (SELECT a.row_id, b.row_id AS nbr_id FROM p a JOIN p b ON a.row_id = b.row_id OR list_distance(a.f, b.f) <= {EPS}),
core AS (SELECT row_id FROM w GROUP BY row_id HAVING count(*) >= 5), e AS (SELECT w.row_id AS u, w.nbr_id AS v FROM w JOIN core a ON w.row_id = a.row_id JOIN core b ON w.nbr_id = b.row_id),
reach AS (SELECT row_id AS u, row_id AS v FROM core UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
comp AS (SELECT u AS row_id, min(v) AS c FROM reach GROUP BY u), named AS (SELECT row_id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS label FROM comp),
border AS (SELECT w.row_id, min(n.label) AS label FROM w JOIN named n ON w.nbr_id = n.row_id WHERE w.row_id NOT IN (SELECT row_id FROM core) GROUP BY w.row_id)
SELECT p.row_id, CAST(coalesce(n.label, b.label, -1) AS INTEGER) AS label FROM p LEFT JOIN named n USING (row_id) LEFT JOIN border b USING (row_id)""")
def dbscan(spark, sf_dir):
    return density.dbscan(EPS, 5)(points(spark, sf_dir))


def _fixed_centres(p: DataFrame, k: int = 3) -> DataFrame:
    return p.where(F.col("row_id") < k).select(F.col("row_id").cast("int").alias("label"), F.col("features").alias("centre"))


def _lloyd_sql(rows: str, iterations: int, name: str = "q") -> str:
    parts = [f"{name}c0 AS (SELECT CAST(row_id AS INTEGER) AS label, f AS c FROM p WHERE row_id < 3)"]
    near = "SELECT r.row_id, r.f, arg_min(c.label, {{d: list_sum(list_transform(list_zip(r.f, c.c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), l: c.label}}) AS label FROM {rows} r CROSS JOIN {c} c GROUP BY r.row_id, r.f"
    for i in range(iterations):
        parts.append(f"{name}n{i} AS ({near.format(rows=rows, c=f'{name}c{i}')})")
        parts.append(f"{name}m{i} AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM {name}n{i}) GROUP BY label, i)")
        parts.append(f"{name}c{i + 1} AS (SELECT label, coalesce((SELECT list(m ORDER BY i) FROM {name}m{i} m WHERE m.label = c.label), c.c) AS c FROM {name}c{i} c)")
    parts.append(f"{name}l AS ({near.format(rows=rows, c=f'{name}c{iterations}')})")
    return ", ".join(parts)


@query(f"WITH {P}, {_lloyd_sql('p', 3)} SELECT row_id, label FROM ql")
def lloyd_fixed(spark, sf_dir):
    p = points(spark, sf_dir)
    return kmeans.lloyd(p, _fixed_centres(p), 3)[0]


@query(f"""WITH {P}, s AS (SELECT * FROM p ORDER BY (row_id * 2654435761 + 42 * 40503) % 4294967296, row_id LIMIT (SELECT CAST(round_even(count(*) * 0.8, 0) AS BIGINT) FROM p)),
{_lloyd_sql('p', 2)}, {_lloyd_sql('s', 2, 'z')}, {_ari('z.label', 'q.label', 'zl z JOIN ql q USING (row_id)')}""")
def stability_fixed(spark, sf_dir):
    p = points(spark, sf_dir)
    start = _fixed_centres(p)
    report = stability.stability(lambda rows: kmeans.lloyd(rows, start, 2)[0], p, n_iter=1, sample_frac=0.8)
    return spark.createDataFrame([(report.per_iter[0],)], "ari double").select(r6("ari").alias("ari"))


def _clusterer(name: str, fit_predict: Callable[[], stability.FitPredict]) -> None:
    def run(spark, sf_dir):
        return fit_predict()(points(spark, sf_dir))

    run.__name__ = name
    query()(run)


_clusterer("kmeans_restarts", lambda: kmeans.kmeans(3, n_init=3, max_iter=50))
_clusterer("minibatch_kmeans", lambda: kmeans.minibatch_kmeans(3, batch_size=256, n_init=3, batches=5))
for _kind in ("full", "tied", "diag", "spherical"):
    _clusterer(f"gmm_{_kind}", lambda kind=_kind: gmm.gmm(3, kind, n_init=1, max_iter=20))
_clusterer("bayesian_gmm", lambda: gmm.bayesian_gmm(5, max_iter=15))
_clusterer("hdbscan", lambda: density.hdbscan(5))
for _kind in ("ward", "complete", "average"):
    _clusterer(f"agglomerative_{_kind}", lambda kind=_kind: hierarchical.agglomerative(4, kind))
_clusterer("spectral_neighbours", lambda: spectral.spectral(3))
_clusterer("spectral_rbf", lambda: spectral.spectral(3, "rbf"))
_clusterer("power_iteration", lambda: spectral.power_iteration(3))


@query()
def gmm_bic_curve(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = [(kind, k, gmm.gmm_bic(kind, n_init=1, max_iter=10)(k, p)) for kind in ("diag", "spherical") for k in (2, 3)]
    return spark.createDataFrame(rows, "covariance string, k int, bic double")


@query()
def gmm_bic_pick(spark, sf_dir):
    return select.pick_bic(gmm_bic_curve(spark, sf_dir))


@query()
def dendrogram_ward(spark, sf_dir):
    return hierarchical.dendrogram(points(spark, sf_dir), "ward")


@query()
def scan_k(spark, sf_dir):
    return stability.scan_clusters(lambda k: kmeans.kmeans(k, n_init=1, max_iter=20), points(spark, sf_dir), [2, 3], n_iter=2)


@query()
def density_sweep(spark, sf_dir):
    return workflow.density_sweep(points(spark, sf_dir), (5,))


@query()
def linkage_scan(spark, sf_dir):
    return workflow.linkage_scan(points(spark, sf_dir), [2, 3, 4])


@query()
def linkage_pick(spark, sf_dir):
    return workflow.pick_linkage(linkage_scan(spark, sf_dir))


@query()
def strategy_comparison(spark, sf_dir):
    return workflow.compare_strategies(customers(spark, sf_dir).drop("c_name"), "c_custkey", 3, 1, ("standard+onehot", "robust+ordinal"))


# ---- consensus


def label_sets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    half = labels(spark, sf_dir, F.floor(F.col("label") / 2))
    sign = labels(spark, sf_dir, (F.col("embedding")[0] > 0).cast("int"))
    return [labels(spark, sf_dir, F.col("vec_id") % 3), half, sign, noisy(spark, sf_dir)]


_SETS = "ls AS (SELECT vec_id AS row_id, [vec_id % 3, label // 2, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END, CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END] AS l FROM embeddings)"


_CO_ASSOCIATION = f"""WITH {_SETS}, pr AS (SELECT a.row_id, b.row_id AS nbr_id, list_sum(list_transform(list_zip(a.l, b.l), lambda x: CASE WHEN x[1] = x[2] AND x[1] <> -1 THEN 1 ELSE 0 END)) AS n FROM ls a JOIN ls b ON a.row_id <> b.row_id)
SELECT row_id, nbr_id, CAST(n / 4 AS DOUBLE) AS share FROM pr WHERE n > 0 UNION ALL SELECT row_id, row_id, CAST(1.0 AS DOUBLE) FROM ls"""


@query(_CO_ASSOCIATION)
def co_association(spark, sf_dir):
    return hierarchical.co_association(label_sets(spark, sf_dir))


@query(_CO_ASSOCIATION)
def co_association_by_tuples(spark, sf_dir):
    return hierarchical.expand_co_association(*hierarchical.co_association_tuples(label_sets(spark, sf_dir)))


@query(f"""WITH {_SETS}, k AS (SELECT row_id, l, CASE WHEN list_contains(l, -1) THEN row_id END AS own FROM ls)
SELECT CAST(l[1] AS INTEGER) AS l0, CAST(l[2] AS INTEGER) AS l1, CAST(l[3] AS INTEGER) AS l2, CAST(l[4] AS INTEGER) AS l3, own, count(*) AS n, min(row_id) AS "first", CAST(row_number() OVER (ORDER BY min(row_id)) - 1 AS INTEGER) AS t FROM k GROUP BY l, own""")
def consensus_tuples(spark, sf_dir):
    return hierarchical.label_tuples(label_sets(spark, sf_dir))[1]


@query()
def consensus(spark, sf_dir):
    return hierarchical.consensus(label_sets(spark, sf_dir), 3)


@query()
def consensus_leave_one_out(spark, sf_dir):
    return hierarchical.leave_one_out(label_sets(spark, sf_dir), 3)


# ---- dimension reduction


@query()
def pca_curve(spark, sf_dir):
    return rounded(dimred.variance_curve(points(spark, sf_dir)))


@query()
def pca_95(spark, sf_dir):
    return spark.createDataFrame([(dimred.components_for(points(spark, sf_dir)),)], "n_components int")


@query()
def pca_projection(spark, sf_dir):
    p = points(spark, sf_dir)
    return dimred.fit_pca(p).transform(p, 2)


@query()
def umap_layout(spark, sf_dir):
    return dimred.umap_all(points(spark, sf_dir), 2, 15, epochs=50)


@query()
def embedding_clusters(spark, sf_dir):
    """Each embedding clustered and scored in its own space."""
    p = points(spark, sf_dir)
    spaces = {"pca_2": dimred.as_points(dimred.fit_pca(p).transform(p, 2)), "umap_d2_nn15": dimred.as_points(dimred.umap_all(p, 2, 15, epochs=50))}
    out = None
    for space, rows in spaces.items():
        rows = rows.persist()
        own = metrics.internal_metrics(rows, kmeans.kmeans(3, n_init=1, max_iter=20)(rows)).withColumn("space", F.lit(space))
        out = own if out is None else out.unionByName(own)
    return out


# ---- ranking

#: The signals of nine recorded runs, three of them without a model.
RUNS = [
    ("01_eda", None, None, None, None, None, None),
    ("02_preprocess_experiments", None, None, None, None, None, None),
    ("03_baseline_kmeans", "KMeans", 0.07251752460413884, 3.355965219255134, 4582.944174054612, 0.9829179614795883, 0.0038331387789761573),
    ("04_gmm_bgmm", "GaussianMixture", 0.003931905553557733, 5.946381338460709, 1381.1392071043463, 0.6357175481426981, 0.000949502004480518),
    ("05_density_based", "HDBSCAN", 0.17921046120528308, 2.0393248013703165, 4350.986551304651, 0.3611235582210637, 0.3611235582210637),
    ("06_agglomerative_spectral", "AgglomerativeClustering", 0.27171888764655794, 1.4870029200077572, 31.080166245817296, 0.499612931428532, 0.500387068571468),
    ("07_dim_reduction_clustering", "KMeans on umap_d2_nn30", 0.7624605894088745, 0.5810822062871243, 33757.434557252105, 1.0, 0.0),
    ("08_consensus_ensemble", "Consensus (average linkage on co-assoc)", 0.15461219256545286, 2.9464885589718826, 186.38449699385387, 0.6325737803254404, 0.2575639912185684),
    ("09_final_selection", None, None, None, None, None, None),
]


def runs(spark: SparkSession) -> DataFrame:
    """The comparison table that is read from the runs' documents, written one for each."""
    folder = f"{scratch_root(spark)}/clustrum/runs-{uuid.uuid4().hex}"
    handle = spark._jvm.org.apache.hadoop.fs.Path(folder)
    handle.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(handle)
    for notebook, algorithm, *signals, mean, std in RUNS:
        best = {"algorithm": algorithm, "internal_metrics": dict(zip(("silhouette", "davies_bouldin", "calinski_harabasz"), signals, strict=True)), "stability": {"mean_ari": mean, "std_ari": std}}
        sinks.write_result(f"{folder}/{notebook}", {"notebook": notebook} | ({"best_model": best} if algorithm else {}))
    return tables.read_runs(spark, folder)


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)"


_Z = {"silhouette": "", "davies_bouldin": "-", "calinski_harabasz": "", "stab_mean": ""}
_RANKED = "r AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, x)) + ")" for x in RUNS) + ") AS t(notebook, algorithm, silhouette, davies_bouldin, calinski_harabasz, stab_mean, stab_std)), z AS (SELECT *, " + ", ".join(
    f"{s}(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) AS z_{c}" for c, s in _Z.items()
) + " FROM r), ranked AS (SELECT *, (z_silhouette + z_davies_bouldin + z_calinski_harabasz + z_stab_mean) / 4 AS combined_score FROM z)"


#: Label sets of the embeddings that are ranked as candidates: by name the SQL of their labels and the column.
_LABELINGS = {
    "03_thirds": ("row_id % 3", lambda: F.col("vec_id") % 3), "05_noisy": ("CASE WHEN row_id % 11 = 0 THEN -1 ELSE label END", lambda: F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("label"))),
    "06_halves": ("label // 2", lambda: F.floor(F.col("label") / 2)), "07_labels": ("label", lambda: F.col("label")), "08_sign": ("CASE WHEN f[1] > 0 THEN 1 ELSE 0 END", lambda: (F.col("embedding")[0] > 0).cast("int")),
}
_SCORED = "r AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS notebook, * FROM (WITH r AS (SELECT row_id, f, {x} AS label FROM p WHERE {x} <> -1), {_DB}, {_CH}, {_SIL} SELECT silhouette, davies_bouldin, calinski_harabasz FROM sil, db, ch), (WITH {_ari(x, 'label', 'p')})"
    for n, (x, _) in _LABELINGS.items()
) + "), z AS (SELECT *, " + ", ".join(f"{s}(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) AS z_{c}" for c, s in (_Z | {"ari": ""}).items() if c != "stab_mean") + " FROM r), ranked AS (SELECT *, (z_silhouette + z_davies_bouldin + z_calinski_harabasz + z_ari) / 4 AS combined_score FROM z)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label sets with their metrics; how they agree with the given labels stands for their stability."""
    p, given, out = points(spark, sf_dir), labels(spark, sf_dir), []
    sets = [labels(spark, sf_dir, column()) for _, column in _LABELINGS.values()]
    for name, own, scored in zip(_LABELINGS, sets, metrics.internal_metrics_of(p, sets), strict=True):
        row = rounded(scored).crossJoin(rounded(metrics.adjusted_rand(own, given)))
        out.append(row.select(F.lit(name).alias("notebook"), F.lit("labels").alias("algorithm"), "silhouette", "davies_bouldin", "calinski_harabasz", F.col("ari").alias("stab_mean"), F.lit(0.0).alias("stab_std")))
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {P}, {_SCORED} SELECT notebook, {', '.join(f'round(z_{c}, 4) + 0.0 AS z_{c}' for c in _Z if c != 'stab_mean')}, round(combined_score, 4) + 0.0 AS combined_score FROM ranked")
def ranked_label_sets(spark, sf_dir):
    ranked = select.rank_candidates(candidates(spark, sf_dir))
    return ranked.select("notebook", *((F.round(c, 4) + 0.0).alias(c) for c in ("z_silhouette", "z_davies_bouldin", "z_calinski_harabasz", "combined_score")))


@query(f"WITH {P}, {_SCORED} SELECT max_by(notebook, combined_score) FILTER (notebook NOT LIKE '08%') AS individual, max(notebook) FILTER (notebook LIKE '08%') AS consensus, max_by(notebook, silhouette) AS silhouette, min_by(notebook, davies_bouldin) AS davies_bouldin FROM ranked")
def picked_label_sets(spark, sf_dir):
    ranked = cut(select.rank_candidates(candidates(spark, sf_dir)), "ranked")
    best = {r["metric"]: r["best"] for r in select.best_per_metric(ranked, "notebook", {"silhouette": True, "davies_bouldin": False}).collect()}
    one = lambda df: df.first()["notebook"]
    return spark.createDataFrame([(one(select.pick_individual(ranked)), one(select.pick_consensus(ranked)), best["silhouette"], best["davies_bouldin"])], "individual string, consensus string, silhouette string, davies_bouldin string")


@query(f"WITH {_RANKED} SELECT notebook, algorithm, {', '.join(f'round(z_{c}, 6) AS z_{c}' for c in _Z)}, round(combined_score, 6) AS combined_score FROM ranked")
def combined_score(spark, sf_dir):
    ranked = select.rank_candidates(runs(spark))
    return rounded(ranked.select("notebook", "algorithm", *(f"z_{c}" for c in _Z), "combined_score"))


@query(f"WITH {_RANKED} SELECT notebook, round(combined_score, 6) AS combined_score FROM ranked WHERE notebook NOT LIKE '08\\_%' ESCAPE '\\' AND algorithm IS NOT NULL ORDER BY combined_score DESC NULLS LAST, stab_std LIMIT 1")
def pick_individual(spark, sf_dir):
    return rounded(select.pick_individual(select.rank_candidates(runs(spark))).select("notebook", "combined_score"))


@query(f"WITH {_RANKED} SELECT notebook, round(combined_score, 6) AS combined_score FROM ranked WHERE notebook LIKE '08\\_%' ESCAPE '\\' LIMIT 1")
def pick_consensus(spark, sf_dir):
    return rounded(select.pick_consensus(select.rank_candidates(runs(spark))).select("notebook", "combined_score"))


@query(f"""WITH {_RANKED} SELECT 'silhouette' AS metric, arg_max(notebook, silhouette) AS best FROM r UNION ALL SELECT 'davies_bouldin', arg_min(notebook, davies_bouldin) FROM r
UNION ALL SELECT 'calinski_harabasz', arg_max(notebook, calinski_harabasz) FROM r""")
def best_per_metric(spark, sf_dir):
    return select.best_per_metric(runs(spark), "notebook", {"silhouette": True, "davies_bouldin": False, "calinski_harabasz": True})


@query(f"WITH {_RANKED} " + " UNION ALL ".join(f"SELECT CAST(substr(notebook, 1, 2) AS INTEGER) AS k, '{c}' AS signal, round({c}, 6) AS value FROM r WHERE {c} IS NOT NULL" for c in ("silhouette", "davies_bouldin", "stab_mean")))
def signal_curves(spark, sf_dir):
    scan = runs(spark).select(F.substring("notebook", 1, 2).cast("int").alias("k"), "silhouette", "davies_bouldin", "stab_mean")
    return rounded(select.signal_curves(scan))


@query("SELECT 'right' AS side, vec_id AS row_id FROM embeddings WHERE vec_id % 50 = 0 AND vec_id % 49 <> 0 UNION ALL SELECT 'left', vec_id FROM embeddings WHERE vec_id % 49 = 0 AND vec_id % 50 <> 0")
def alignment_gaps(spark, sf_dir):
    p = points(spark, sf_dir)
    return select.alignment_gaps(p.where("row_id % 50 <> 0"), p.where("row_id % 49 <> 0"))


@query("SELECT vec_id AS \"Id\", label AS \"Predicted\" FROM embeddings")
def submission(spark, sf_dir):
    ids = points(spark, sf_dir).select(F.col("row_id").alias("Id"))
    return sinks.submission(ids, labels(spark, sf_dir))


@query("SELECT vec_id AS row_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y, CAST(CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS INTEGER) AS label, vec_id % 11 = 0 AS is_noise FROM embeddings")
def cluster_scatter(spark, sf_dir):
    return rounded(select.cluster_scatter(points(spark, sf_dir).select("row_id", F.col("features").alias("z")), noisy(spark, sf_dir)))
