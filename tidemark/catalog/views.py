"""The driver's tables presented as market data: one Spark builder and one SQL text per view, kept side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CTES: dict[str, str] = {}
_BUILDERS: dict = {}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def view(name: str, sql: str):
    def register(fn):
        CTES[name] = sql
        _BUILDERS[name] = fn
        return fn
    return register


class Views:
    """Views of one scale-factor folder; each is built once per instance and stays lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._built = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = _BUILDERS[name](self) if name in _BUILDERS else self.table(name)
        return self._built[name]


def cents(col: str):
    """Exact integer sum of a two-decimal amount, so that both engines see identical closes."""
    return F.sum(F.round(F.col(col) * 100).cast("bigint"))


@view("bars", """
SELECT CAST(l_shipdate AS DATE) AS session_date, CAST(l_suppkey AS VARCHAR) AS ticker,
  CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100e0/CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS close,
  max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume, count(*) AS trades, max(l_tax) < 0.08e0 AS clean
FROM lineitem GROUP BY 1, 2""")
def _bars(v):
    li = v.table("lineitem")
    return (li.groupBy(F.to_date("l_shipdate").alias("session_date"), F.col("l_suppkey").cast("string").alias("ticker"))
            .agg((cents("l_extendedprice").cast("double") / 100.0
                  / F.sum(F.col("l_quantity").cast("bigint")).cast("double")).alias("close"),
                 F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("high"),
                 F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("low"),
                 F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("volume"),
                 F.count(F.lit(1)).alias("trades"), (F.max("l_tax") < 0.08).alias("clean")))


@view("bench", """
SELECT CAST(l_shipdate AS DATE) AS session_date,
  CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100e0/CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS bench_close
FROM lineitem GROUP BY 1""")
def _bench(v):
    return (v.table("lineitem").groupBy(F.to_date("l_shipdate").alias("session_date"))
            .agg((cents("l_extendedprice").cast("double") / 100.0
                  / F.sum(F.col("l_quantity").cast("bigint")).cast("double")).alias("bench_close")))


@view("kinds", """
SELECT CAST(s_suppkey AS VARCHAR) AS ticker,
  CASE s_suppkey % 4 WHEN 0 THEN 'common_stock' WHEN 1 THEN 'adr' WHEN 2 THEN 'etf' ELSE NULL END AS security_type
FROM supplier""")
def _kinds(v):
    k = F.col("s_suppkey") % 4
    return v.table("supplier").select(
        F.col("s_suppkey").cast("string").alias("ticker"),
        F.when(k == 0, "common_stock").when(k == 1, "adr").when(k == 2, "etf").alias("security_type"))


@view("obs", """
SELECT b.ticker, 'CIK:' || b.ticker AS security_id, b.session_date, b.close, c.bench_close,
  b.close*b.volume AS dollar_volume, b.clean, k.security_type
FROM bars b JOIN bench c ON b.session_date = c.session_date LEFT JOIN kinds k ON b.ticker = k.ticker""")
def _obs(v):
    return (v.bars.join(v.bench, "session_date").join(v.kinds, "ticker", "left")
            .select("ticker", F.concat(F.lit("CIK:"), "ticker").alias("security_id"), "session_date", "close",
                    "bench_close", (F.col("close") * F.col("volume")).alias("dollar_volume"), "clean", "security_type"))


@view("hist", """
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session_date)-1 AS idx, count(*) OVER (PARTITION BY ticker) AS n
FROM obs WHERE close > 0 AND bench_close > 0""")
def _hist(v):
    from tidemark.sources.bars import scan_histories
    return scan_histories(v.obs)


@view("iev", """
SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS event_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'results' WHEN '2-HIGH' THEN 'insider_buy' WHEN '3-MEDIUM' THEN 'insider_sell'
    ELSE 'filing_event' END AS event_type,
  o_totalprice AS value, o_orderkey AS accession, CAST(o_orderdate AS TIMESTAMP) AS published_at,
  CAST(o_orderdate AS TIMESTAMP) + CAST(o_orderkey % 48 AS INTEGER) * INTERVAL 1 HOUR AS available_at
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def _iev(v):
    p = F.col("o_orderpriority")
    li = v.table("lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("ticker")).distinct()
    at = F.col("o_orderdate").cast("timestamp")
    return (v.table("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
            .select("ticker", F.to_date("o_orderdate").alias("event_date"),
                    F.when(p == "1-URGENT", "results").when(p == "2-HIGH", "insider_buy")
                    .when(p == "3-MEDIUM", "insider_sell").otherwise("filing_event").alias("event_type"),
                    F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("accession"),
                    at.alias("published_at"),
                    F.timestamp_add("HOUR", (F.col("o_orderkey") % 48).cast("int"), at).alias("available_at")))


@view("refs", """
SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CAST(m AS DATE) AS snapshot_date,
  (s_suppkey + year(m)*12 + month(m)) % 7 <> 0 AS active,
  CASE s_suppkey % 4 WHEN 0 THEN 'CS' WHEN 1 THEN 'ADRC' WHEN 2 THEN 'ETF' ELSE 'WARRANT' END AS raw_type,
  CASE s_nationkey % 5 WHEN 0 THEN 'XNYS' WHEN 1 THEN 'XNAS' WHEN 2 THEN 'ARCX' WHEN 3 THEN 'BATS' ELSE 'OTCM' END AS exchange,
  CASE WHEN s_nationkey % 7 = 6 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'BBG' || s_suppkey END AS composite_figi,
  CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_suppkey AS VARCHAR) END AS cik,
  CAST(m AS TIMESTAMP) + INTERVAL 9 HOUR AS fetched_at
FROM supplier, (SELECT unnest(generate_series(DATE '1995-06-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS m) months""")
def _refs(v):
    s, nat = F.col("s_suppkey"), F.col("s_nationkey")
    months = F.explode(F.sequence(F.lit("1995-06-01").cast("date"), F.lit("2001-12-01").cast("date"),
                                  F.expr("interval 1 month"))).alias("m")
    k, e, m = s % 4, nat % 5, F.col("m")
    return v.table("supplier").select("*", months).select(
        s.cast("string").alias("ticker"), m.alias("snapshot_date"),
        ((s + F.year(m) * 12 + F.month(m)) % 7 != 0).alias("active"),
        F.when(k == 0, "CS").when(k == 1, "ADRC").when(k == 2, "ETF").otherwise("WARRANT").alias("raw_type"),
        F.when(e == 0, "XNYS").when(e == 1, "XNAS").when(e == 2, "ARCX").when(e == 3, "BATS").otherwise("OTCM")
        .alias("exchange"),
        F.when(nat % 7 == 6, "EUR").otherwise("USD").alias("currency"),
        F.when(s % 5 != 0, F.concat(F.lit("BBG"), s.cast("string"))).alias("composite_figi"),
        F.when(s % 11 != 0, s.cast("string")).alias("cik"),
        F.timestamp_add("HOUR", F.lit(9), m.cast("timestamp")).alias("fetched_at"))


@view("dividends", """
SELECT ticker, session_date AS event_date,
  CASE WHEN (CAST(ticker AS BIGINT) + year(session_date)*4 + quarter(session_date)) % 97 = 0 THEN close*2e0 ELSE close*0.005e0 END AS cash
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year(session_date), quarter(session_date) ORDER BY session_date) AS rn FROM bars)
WHERE rn = 1""")
def _dividends(v):
    d = F.col("session_date")
    first = (v.bars.groupBy("ticker", F.year(d).alias("y"), F.quarter(d).alias("q"))
             .agg(F.min_by(F.struct("session_date", "close"), d).alias("f")))
    odd = (F.col("ticker").cast("bigint") + F.col("y") * 4 + F.col("q")) % 97 == 0
    return first.select("ticker", F.col("f.session_date").alias("event_date"),
                        F.when(odd, F.col("f.close") * 2.0).otherwise(F.col("f.close") * 0.005).alias("cash"))


@view("splits", """
SELECT ticker, min(session_date) AS split_date, 1e0 + CAST(year(session_date) % 3 AS DOUBLE) AS split_ratio
FROM bars WHERE CAST(ticker AS BIGINT) % 3 = 0 AND year(session_date) % 2 = 1 GROUP BY ticker, year(session_date)""")
def _splits(v):
    y = F.year("session_date")
    return (v.bars.filter((F.col("ticker").cast("bigint") % 3 == 0) & (y % 2 == 1)).groupBy("ticker", y.alias("y"))
            .agg(F.min("session_date").alias("split_date"))
            .select("ticker", "split_date", (1.0 + (F.col("y") % 3).cast("double")).alias("split_ratio")))


@view("preds", """
SELECT CAST(l_shipdate AS DATE) AS session_date, CAST(l_suppkey AS VARCHAR) AS ticker, round(l_discount*10e0, 1) AS p,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem""")
def _preds(v):
    return v.table("lineitem").select(
        F.to_date("l_shipdate").alias("session_date"), F.col("l_suppkey").cast("string").alias("ticker"),
        F.round(F.col("l_discount") * 10.0, 1).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
