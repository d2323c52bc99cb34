"""Queries of sources, stress, liquidity, factors, feature registry and streamed books, and their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.functions import registry as features
from tapewright.functions import rolling as R
from tapewright.operators import portfolio as P
from tapewright.operators import scenarios as S
from tapewright.plans.aggregates import Q0, _returns
from tapewright.plans.build import on_bars, rounded
from tapewright.plans.indicators import RET, step
from tapewright.plans.oracle import TICKS, over_bars, roll, wide
from tapewright.plans.portfolios import CV, IV, RR, _returns as raw_returns
from tapewright.plans.records import BK, _updates
from tapewright.sources.tables import bars, read_csv_bars, table, ticks
from tapewright.streaming import incremental as I

QUERIES: dict = {}
ORACLES: dict = {}
EPOCH = "CAST(epoch(ts) AS BIGINT) AS ts"


def add(name, make, sql=None):
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


def _csv(spark, sf_dir):
    """Bars written as CSV to the shared folder and read again with a schema."""
    path = f"{I.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    out = bars(spark, sf_dir).select("symbol", F.col("ts").alias("timestamp"), "open", "high", "low", "close", "volume")
    out.write.option("header", True).csv(path)
    return rounded(read_csv_bars(spark, path), "open", "high", "low", "close", keys=("symbol", "ts", "volume"))


add("q_2_1_2_csv_bars", _csv, over_bars(f"SELECT symbol, {EPOCH}, volume, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM bars"))


def _json(spark, sf_dir):
    """Events written as JSON lines, read with a schema, filtered."""
    path = f"{I.shared_dir(spark)}/json-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").write.json(path)
    return spark.read.schema("event_id long, event_type string, user_id long, value double").json(path).where("event_type = 'error'").select("event_id", "user_id", "value")


add("q_2_1_37_json_events", _json, "SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")


# Positions: parts as instruments, brand as sector.
def _positions(s, d):
    li, part = table(s, d, "lineitem"), table(s, d, "part")
    x = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    g = x.groupBy(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("sector")).agg(F.sum("l_extendedprice").alias("value"), (F.sum("l_quantity") * F.first("p_retailprice")).alias("adv"), F.round(F.avg("l_discount") * 20, 9).alias("beta"), F.coalesce(F.stddev_samp("l_discount"), F.lit(0.0)).alias("volatility"))
    return g


PO = "WITH po AS (SELECT p_partkey AS symbol, p_brand AS sector, sum(l_extendedprice) AS value, sum(l_quantity) * min(p_retailprice) AS adv, round(avg(l_discount) * 20, 9) AS beta, coalesce(stddev_samp(l_discount), 0) AS vol FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
SCENARIOS = [("crash", -0.4, {"Brand#11": -0.1}), ("slump", -0.15, {"Brand#12": 0.05, "Brand#13": -0.3}), ("rally", 0.2, {})]
SX = PO + """, sc AS (SELECT * FROM (VALUES ('crash', -0.4::DOUBLE), ('slump', -0.15), ('rally', 0.2)) t(scenario, m)),
mv AS (SELECT scenario, symbol, value, greatest(-1.0, beta * m + CASE WHEN scenario = 'crash' AND sector = 'Brand#11' THEN -0.1 WHEN scenario = 'slump' AND sector = 'Brand#12' THEN 0.05 WHEN scenario = 'slump' AND sector = 'Brand#13' THEN -0.3 ELSE 0 END) AS mo FROM po, sc),
ls AS (SELECT scenario, sum(value * mo) AS pnl, sum(value) AS value, CAST(sum(CASE WHEN mo < -0.2 THEN 1 ELSE 0 END) AS BIGINT) AS n_hard_hit, first(symbol ORDER BY round(value * mo, 6), symbol) AS worst FROM mv GROUP BY scenario)
"""
add("q_2_4_33_stress", lambda s, d: rounded(S.stress(_positions(s, d), SCENARIOS), "pnl", "pnl_share", keys=("scenario", "n_hard_hit", "worst"), digits=3), SX + "SELECT scenario, n_hard_hit, worst, round(pnl, 3) AS pnl, round(pnl / value, 3) AS pnl_share FROM ls")
add(
    "q_2_4_110_stress_report", lambda s, d: rounded(S.stress_summary(S.stress(_positions(s, d), SCENARIOS)), "mean_share", keys=("worst_scenario", "beyond_5", "beyond_10", "beyond_20")),
    SX + "SELECT arg_min(scenario, pnl / value) AS worst_scenario, " + ", ".join(f"CAST(sum(CASE WHEN pnl / value < -{c} THEN 1 ELSE 0 END) AS BIGINT) AS beyond_{int(100 * c)}" for c in (0.05, 0.1, 0.2)) + ", round(avg(pnl / value), 6) AS mean_share FROM ls",
)
LQ = PO + ", lq AS (SELECT *, value / nullif(adv * 0.1, 0) AS dy, least(0.2, vol * sqrt(value / adv)) AS im FROM po)\n"
add(
    "q_2_4_117_days_to_liquidate", lambda s, d: rounded(S.liquidity(_positions(s, d)), "days", "impact", keys=("symbol",)),
    LQ + "SELECT symbol, round(dy, 6) AS days, round(im, 6) AS impact FROM lq",
)
add(
    "q_2_4_52_liquidity_profile", lambda s, d: rounded(S.liquidity_profile(_positions(s, d), "sector"), "mean_days", "liquid_1", "liquid_5", "mean_impact", keys=("sector",)),
    LQ + "SELECT sector, round(sum(value * dy) / sum(value), 6) AS mean_days, round(sum(value * least(1.0, 1 / dy)) / sum(value), 6) AS liquid_1, round(sum(value * least(1.0, 5 / dy)) / sum(value), 6) AS liquid_5, round(sum(value * im) / sum(value), 6) AS mean_impact FROM lq GROUP BY sector",
)
DR = lambda t: f"CAST('0x' || substr(md5(concat_ws(':', 7, k, '{t}')), 1, 8) AS BIGINT)"
add(
    "q_2_4_28_simulated_var", lambda s, d: rounded(S.simulated_var(_returns(s, d).groupBy("symbol").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd")), 10_000), "var_95", "var_99", keys=("symbol",), digits=5),
    over_bars(
        f"SELECT symbol, round(quantile_cont(mu + sd * z, 0.05), 5) AS var_95, round(quantile_cont(mu + sd * z, 0.01), 5) AS var_99 FROM (SELECT symbol, avg(r) AS mu, stddev_samp(r) AS sd FROM q1 GROUP BY symbol), (SELECT sqrt(-2 * ln(({DR('a')} + 1) / {2.0**32 + 1!r}::DOUBLE)) * cos({2 * math.pi!r} * ({DR('b')} / {2.0**32!r}::DOUBLE)) AS z FROM (SELECT unnest(range(10000)) AS k)) GROUP BY symbol",
        *Q0,
    ),
)


def _factors(s, d):
    r = _returns(s, d)
    return r.select("symbol", F.col("r").alias("y"), F.avg("r").over(Window.partitionBy("ts")).alias("x1"), R.lag("r").alias("x2")).where("x2 is not null")


FA = [*Q0, "f0 AS (SELECT symbol, r AS y, avg(r) OVER (PARTITION BY ts) AS x1, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS x2 FROM q1)",
      "f1 AS (SELECT symbol, count(*) AS n, covar_pop(x1, x1) AS a, covar_pop(x2, x2) AS b, covar_pop(x1, x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, covar_pop(y, y) AS v, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM f0 WHERE x2 IS NOT NULL GROUP BY symbol)",
      "f2 AS (SELECT *, (p * b - q * c) / (a * b - c * c) AS b1, (q * a - p * c) / (a * b - c * c) AS b2 FROM f1)"]
add("q_2_4_45_factor_exposures", lambda s, d: rounded(S.two_factor(_factors(s, d)), "beta_1", "beta_2", "alpha", "r2", keys=("symbol", "n"), digits=5), over_bars("SELECT symbol, n, round(b1, 5) AS beta_1, round(b2, 5) AS beta_2, round(my - b1 * m1 - b2 * m2, 5) AS alpha, round((b1 * p + b2 * q) / v, 5) AS r2 FROM f2", *FA))
add("q_2_4_46_risk_decomposition", lambda s, d: rounded(S.two_factor(_factors(s, d)), "systematic", "specific", keys=("symbol",), digits=8), over_bars("SELECT symbol, round(b1 * p + b2 * q, 8) AS systematic, round(v - b1 * p - b2 * q, 8) AS specific FROM f2", *FA))
add(
    "q_2_4_42_diversification", lambda s, d: rounded(S.diversification(P.covariances(raw_returns(s, d)), P.inverse_volatility(raw_returns(s, d))), "diversification_ratio", "effective_bets", "volatility", keys=(), digits=5),
    over_bars("SELECT round(sum(CASE WHEN a = b THEN abs(p.w) * sqrt(cov) END) / sqrt(sum(cov * p.w * q.w)), 5) AS diversification_ratio, round(pow(sum(CASE WHEN a = b THEN abs(p.w) END), 2) / sum(CASE WHEN a = b THEN p.w * p.w END), 5) AS effective_bets, round(sqrt(sum(cov * p.w * q.w)), 5) AS volatility FROM cv JOIN iv p ON a = p.symbol JOIN iv q ON b = q.symbol", RR, IV, CV),
)
add(
    "q_2_4_44_correlation_summary", lambda s, d: rounded(S.correlation_summary(P.covariances(raw_returns(s, d))), "mean", "median", "sd", "low", "high", "over_50", "over_70", keys=("n",), digits=5),
    over_bars("SELECT count(*) AS n, round(avg(c), 5) AS mean, round(quantile_cont(c, 0.5), 5) AS median, round(stddev_samp(c), 5) AS sd, round(min(c), 5) AS low, round(max(c), 5) AS high, round(avg(CASE WHEN c > 0.5 THEN 1.0 ELSE 0 END), 5) AS over_50, round(avg(CASE WHEN c > 0.7 THEN 1.0 ELSE 0 END), 5) AS over_70 FROM (SELECT cov / (sx * sy) AS c FROM cv WHERE a < b)", RR, CV),
)
FEATURES = {"return_1": "r", "sma_20": "m", "close_to_sma": "close / nullif(m, 0)", "volatility_20": "v", "volume_ratio": f"volume / nullif({roll('avg(volume)', 20)}, 0)", "risk_adjusted": "r / nullif(v, 0)"}
QUERIES["q_2_16_4_standard_features"] = on_bars(lambda b: features.standard().materialise(b, list(FEATURES)), *FEATURES)
ORACLES["q_2_16_4_standard_features"] = wide(FEATURES, "s1", step("s0", {"r": RET(1), "m": roll("avg(close)", 20)}), step("s1", {"v": roll("stddev_samp(r)", 20)}, "s0"))
add(
    "q_2_11_15_order_events", lambda s, d: rounded(S.order_flow_levels(_updates(s, d).withColumn("delta", F.when(F.col("seq") % 3 == 0, -F.col("size") / 2).otherwise(F.col("size")))), "level_size", keys=("symbol", "seq")),
    f"WITH {TICKS} SELECT symbol, seq, round(sum(d) OVER (PARTITION BY symbol, fp ORDER BY ts, seq), 6) AS level_size FROM (SELECT *, floor(price) AS fp, CASE WHEN seq % 3 = 0 THEN -(CASE WHEN size % 5 = 0 THEN 0.0 ELSE size END) / 2 ELSE CASE WHEN size % 5 = 0 THEN 0.0 ELSE size END END::DOUBLE AS d FROM ticks)",
)


def _streamed_book(spark, sf_dir):
    """Best prices of the streamed book after each symbol's last update."""
    t = I.timed_tick_stream(spark, sf_dir)
    p = F.floor("price").cast("double")
    updates = t.select("symbol", "ts", "seq", F.when(p < 50, "bid").otherwise("ask").alias("side"), p.alias("price"), F.when(F.col("size") % 5 == 0, 0.0).otherwise(F.col("size").cast("double")).alias("size"))
    last = I.drained(I.book_stream(updates), "book").groupBy("symbol").agg(F.max_by(F.struct("best_bid", "best_ask"), F.struct("ts", "seq")).alias("x"))
    return rounded(last.select("symbol", "x.*"), "best_bid", "best_ask", keys=("symbol",))


add("q_2_15_15_streamed_book", _streamed_book, BK + "SELECT symbol, round(bp, 6) AS best_bid, round(ap, 6) AS best_ask FROM bk")
