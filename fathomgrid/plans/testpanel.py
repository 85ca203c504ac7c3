"""The panel's inputs from a star schema of orders: monthly log growth of revenue by part type, brand and supplier nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.operators import features as X
from fathomgrid.operators import panel as P
from fathomgrid.operators import scan

START, EVERY = 36, 12
COMMON = ["disc", "tax", "qty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(universe, asset, month, rev) in one scan: lines meet parts and suppliers, and are summed before the one shuffle.

    Spark broadcasts the two tables where they are small by its own statistics and else shuffles.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.trunc("l_shipdate", "month").alias("month"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(nations, "s_nationkey")
    whole = lines.join(parts, "l_partkey", "left").join(suppliers, "l_suppkey", "left")
    each = whole.select("month", "rev", F.stack(F.lit(3), F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("nation"), F.col("n_name")).alias("universe", "asset"))
    return each.filter("asset is not null").groupBy("universe", "asset", "month").agg(F.sum("rev").alias("rev"))


def raw_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.by_asset()
    return revenue(spark, sf_dir).select("universe", "asset", "month", (F.ln("rev") - F.ln(F.lag("rev").over(w))).alias("ret"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months in which every asset of a universe has a return, numbered by t."""
    return X.numbered(P.listwise(raw_returns(spark, sf_dir)))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lead_response(returns(spark, sf_dir)).filter("r_next is not null")


def macro_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns named like a macro file's, as monthly aggregates of lines."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month"))
    price = F.col("l_extendedprice")
    return m.agg(
        F.sum(price).alias("Index"),
        F.sum(price * F.col("l_discount")).alias("D12"),
        F.sum(price * F.col("l_tax")).alias("E12"),
        F.avg("l_discount").alias("b/m"),
        F.avg("l_tax").alias("ntis"),
        F.var_samp("l_quantity").alias("svar"),
        (F.avg("l_tax") / 12).alias("tbl"),
        (F.count(F.lit(1)) / 1000.0).alias("infl"),
        F.max(price).alias("BAA"),
        F.avg(price).alias("AAA"),
        (F.avg("l_discount") / 6).alias("lty"),
    )


def common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three common predictors by month."""
    return table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("qty"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's riskless rate, called RF."""
    return common(spark, sf_dir).select("month", (F.col("tax") / 10).alias("RF"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.own_history(returns(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, columns: list[str] = X.OWN) -> DataFrame:
    """Own history and common predictors as expanding z-scores, with the response; all rows, nulls included."""
    own = X.expanding_zscore(history(spark, sf_dir), columns)
    shared = X.expanding_zscore(common(spark, sf_dir), COMMON, ())
    return X.lead_response(own).join(shared, "month")


def model_panel(spark: SparkSession, sf_dir: str, stabilisation: int = 30) -> DataFrame:
    """(universe, asset, month, t, r_next, f): rows after the stabilisation (by position before rows with nulls go)."""
    own = ["ret_lag1", "vol12"]
    kept = P.complete(P.stabilised(scored(spark, sf_dir, own), stabilisation), [*own, *COMMON, "r_next"])
    return X.numbered(P.assembled(kept, COMMON, own, ["universe", "asset", "month", "r_next"]))


def pseudo_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as draws (field, i, j, chain, draw, value): four chains and five parameters."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.col("event_type").alias("field"), F.pmod("user_id", F.lit(4)).cast("int").alias("chain"))
    e = scan.numbered(e, ("field", "chain"), "event_id", "draw", 1 << 16)
    return e.select("field", F.lit(0).alias("i"), F.lit(0).alias("j"), "chain", F.col("draw").cast("int").alias("draw"), "value")


def pseudo_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding components as means (setting, j, mean): label pairs as settings, components as predictors."""
    v = table(spark, sf_dir, "embeddings").select(F.pmod("label", F.lit(3)).cast("int").alias("setting"), F.posexplode("embedding").alias("j", "x"))
    return v.groupBy("setting", "j").agg(F.avg(F.col("x").cast("double")).alias("mean"))


# The same tables for SQL, under the names of the functions above.
SQL = {
    "revenue": """revenue AS (
  SELECT 'type' AS universe, p_type AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
  UNION ALL SELECT 'brand', p_brand, CAST(date_trunc('month', l_shipdate) AS DATE), sum(l_extendedprice * (1 - l_discount)) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
  UNION ALL SELECT 'nation', n_name, CAST(date_trunc('month', l_shipdate) AS DATE), sum(l_extendedprice * (1 - l_discount)) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)""",
    "raw": "raw AS (SELECT universe, asset, month, ln(rev) - ln(lag(rev) OVER (PARTITION BY universe, asset ORDER BY month)) AS ret FROM revenue)",
    "returns": """full_months AS (SELECT universe, month FROM raw JOIN (SELECT universe, count(DISTINCT asset) AS n FROM raw GROUP BY 1) USING (universe) GROUP BY universe, month, n HAVING count(ret) = n),
  returns AS (SELECT universe, asset, month, ret, row_number() OVER (PARTITION BY universe, asset ORDER BY month) - 1 AS t FROM raw SEMI JOIN full_months USING (universe, month))""",
    "responses": "led AS (SELECT *, lead(ret) OVER (PARTITION BY universe, asset ORDER BY month) AS r_next FROM returns), responses AS (SELECT * FROM led WHERE r_next IS NOT NULL)",
    "macro": """macro AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_extendedprice) AS idx, sum(l_extendedprice * l_discount) AS d12, sum(l_extendedprice * l_tax) AS e12,
  avg(l_discount) AS bm, avg(l_tax) AS ntis, var_samp(l_quantity) AS svar, avg(l_tax) / 12 AS tbl, count(*) / 1000.0 AS infl, max(l_extendedprice) AS baa, avg(l_extendedprice) AS aaa, avg(l_discount) / 6 AS lty FROM lineitem GROUP BY 1)""",
    "common": "common AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_discount) AS disc, avg(l_tax) AS tax, avg(l_quantity) AS qty FROM lineitem GROUP BY 1)",
    "history": """l1 AS (SELECT *, lag(ret, 1) OVER w AS ret_lag1, lag(ret, 3) OVER w AS ret_lag3, lag(ret, 6) OVER w AS ret_lag6, lag(ret, 12) OVER w AS ret_lag12 FROM returns WINDOW w AS (PARTITION BY universe, asset ORDER BY month)),
  history AS (SELECT *, CASE WHEN count(ret) OVER y = 12 THEN avg(ret) OVER y END AS mean12, CASE WHEN count(ret) OVER y = 12 THEN stddev_samp(ret) OVER y END AS vol12, CASE WHEN count(ret) OVER y = 12 THEN skewness(ret) OVER y END AS skew12,
    CASE WHEN count(ret_lag1) OVER e = 11 THEN product(1 + ret_lag1) OVER e - 1 END AS mom12
    FROM l1 WINDOW y AS (PARTITION BY universe, asset ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), e AS (PARTITION BY universe, asset ORDER BY month ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))""",
    "forecasts": f"""prior AS (SELECT *, avg(r_next) OVER w AS benchmark, regr_intercept(r_next, ret) OVER w AS a, regr_slope(r_next, ret) OVER w AS b FROM responses WINDOW w AS (PARTITION BY universe, asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  keyed AS (SELECT *, {START} + CAST(floor((t - {START}) / {EVERY}.0) AS BIGINT) * {EVERY} AS t_refit FROM prior WHERE t >= {START}),
  forecasts AS (SELECT k.universe, k.asset, k.month, k.t, k.t_refit, p.a + p.b * k.ret AS predicted, k.r_next AS realised, k.benchmark, p.benchmark AS prefix FROM keyed k JOIN prior p ON k.universe = p.universe AND k.asset = p.asset AND k.t_refit = p.t)""",
    "weights": """centred AS (SELECT *, predicted - avg(predicted) OVER (PARTITION BY universe, t) AS d FROM forecasts),
  grossed AS (SELECT *, sum(abs(d)) OVER (PARTITION BY universe, t) AS g, sum(abs(predicted)) OVER (PARTITION BY universe, t) AS p FROM centred),
  weights AS (SELECT *, CASE WHEN g > 1e-12 * greatest(p, 1e-300) THEN d / g ELSE 0 END AS w FROM grossed),
  portfolio AS (SELECT universe, t, sum(w * realised) AS q FROM weights GROUP BY 1, 2)""",
    "draws": "draws AS (SELECT event_type AS field, (user_id % 4)::BIGINT AS chain, row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS draw, value FROM events)",
    "means": "means AS (SELECT (label % 3)::BIGINT AS setting, j, avg(x::DOUBLE) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) GROUP BY 1, 2)",
}
NEEDS = {
    "revenue": [],
    "raw": ["revenue"],
    "returns": ["raw"],
    "responses": ["returns"],
    "macro": [],
    "common": [],
    "history": ["returns"],
    "forecasts": ["responses"],
    "weights": ["forecasts"],
    "draws": [],
    "means": [],
}


def with_tables(*names: str) -> str:
    """WITH clause of the named tables and all they need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(SQL[n] for n in order)
