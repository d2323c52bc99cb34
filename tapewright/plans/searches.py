"""Queries of spreads, flow toxicity, book depth, parameter search and further splits (survey 2.4, 2.8 to 2.11, 2.13, 2.16) and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tapewright.operators import book as B
from tapewright.operators import cleaning
from tapewright.operators import evaluation as V
from tapewright.operators import microstructure as M
from tapewright.plans.aggregates import _returns
from tapewright.plans.build import on_bars, rounded
from tapewright.plans.evaluation import FM
from tapewright.plans.indicators import RET, step
from tapewright.plans.oracle import TICKS, W, lag, over_bars, roll, wide
from tapewright.plans.records import BK, _updates
from tapewright.sources.tables import bars, seconds, ticks

QUERIES: dict = {}
ORACLES: dict = {}
EPOCH = "CAST(epoch(ts) AS BIGINT) AS ts"


def add(name, make, sql):
    QUERIES[name] = make
    ORACLES[name] = sql


def place(x: str, n: int) -> str:
    past = f"coalesce(list({x}) FILTER ({x} IS NOT NULL) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING), [])"
    below, upto = (f"len(list_filter({past}, lambda v: v {o} {x}))" for o in ("<", "<="))
    return f"CASE WHEN {x} IS NOT NULL AND len({past}) = {n - 1} THEN ({below} + {upto} + CASE WHEN {below} < {upto} THEN 1 ELSE 0 END) / 2 / {n - 1} END"


SP = step("sp", {"s": "(high - low) / nullif((high + low) / 2, 0) * 10000"})
SPREAD = {"spread_bps": "s", "spread_momentum": f"s - {lag('s', 5)}", "spread_z": f"(s - {roll('avg(s)', 20)}) / nullif({roll('stddev_samp(s)', 20)}, 0)", "spread_place": place("s", 100)}
add("q_2_8_40_spread_analytics", on_bars(M.spread_analytics, *SPREAD), wide(SPREAD, "sp", SP))
TX = [
    step("t0", {"by_": "volume * coalesce((close - low) / nullif(high - low, 0), 0.5)", "se": "volume * (1 - coalesce((close - low) / nullif(high - low, 0), 0.5))", "mv": f"abs({RET(1)})"}),
    step("t1", {"im": f"abs({roll('sum(by_)', 20)} - {roll('sum(se)', 20)}) / nullif({roll('sum(by_)', 20)} + {roll('sum(se)', 20)}, 0)", "il": f"round(mv / nullif(volume / nullif({roll('avg(volume)', 20)}, 0), 0), 12)", "cl": f"round({roll('stddev_samp(mv)', 20)}, 12)"}, "t0"),
    step("t2", {"pi": place("il", 20), "pc": place("cl", 20)}, "t1"),
]
add("q_2_8_42_toxicity_index", on_bars(M.toxicity, "toxicity"), wide({"toxicity": "coalesce(0.4 * im + 0.3 * pi + 0.3 * pc, 0.5)"}, "t2", *TX))
PRE = f"OVER ({W} ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING)"
RV = [step("v0", {"lv": lag("close"), "dl": f"close - {lag('close')}", "k": f"row_number() OVER ({W})"}), step("v1", {"sl": f"CASE WHEN k > 100 THEN covar_samp(dl, lv) {PRE} / nullif(var_pop(lv) {PRE}, 0) END"}, "v0")]
add("q_2_9_15_mean_reversion_test", lambda s, d: rounded(M.reverting(bars(s, d)), "slope", keys=("symbol", "ts", "reverting")), over_bars(f"SELECT symbol, {EPOCH}, CAST(coalesce(sl < 0 AND -ln(2) / sl > 5 AND -ln(2) / sl < 50, false) AS BIGINT) AS reverting, round(sl, 6) AS slope FROM v1", *RV))


# Books.
def _depths(s, d):
    b = B.snapshots(_updates(s, d)).withColumn("mid", (F.col("bids")[0]["price"] + F.col("asks")[0]["price"]) / 2).where("mid is not null")
    size = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["size"])
    near = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["size"] / (1 + F.abs(x["price"] - F.col("mid"))))
    capped = F.filter("asks", lambda x: x["price"] <= F.col("asks")[0]["price"] + 3)
    return b.withColumns({
        "bid_at": size(F.filter("bids", lambda x: x["price"] >= F.col("mid") - 5)), "ask_at": size(F.filter("asks", lambda x: x["price"] <= F.col("mid") + 5)),
        "near_imbalance": F.try_divide(near(F.col("bids")) - near(F.col("asks")), near(F.col("bids")) + near(F.col("asks"))), "sweep": F.least(size(capped), F.lit(100.0)),
    })


def _of_levels(columns):
    return BK + "SELECT m.symbol, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in columns.items()) + " FROM tp JOIN m ON m.symbol = tp.symbol GROUP BY m.symbol"


AT = lambda side, test: f"coalesce(sum(size) FILTER (side = '{side}' AND {test}), 0)"
NB, NA = (f"sum(size / (1 + abs(price - mid))) FILTER (side = '{x}')" for x in ("bid", "ask"))
for _name, _cols in {
    "q_2_11_2_depth_at_price": {"bid_at": AT("bid", "price >= mid - 5"), "ask_at": AT("ask", "price <= mid + 5")},
    "q_2_11_5_distance_imbalance": {"near_imbalance": f"({NB} - {NA}) / nullif({NB} + {NA}, 0)"},
    "q_2_11_21_limit_sweep": {"sweep": f"least(100, {AT('ask', 'price <= ap + 3')})"},
}.items():
    add(_name, lambda s, d, c=tuple(_cols): rounded(_depths(s, d), *c, keys=("symbol",)), _of_levels(_cols))

# Sets, curves and splits.
add("q_2_10_6_keep_first", lambda s, d: cleaning.first_rows(ticks(s, d).withColumn("ts", F.date_trunc("hour", "ts")), "symbol", "ts").select("symbol", seconds(), "seq"), f"WITH {TICKS} SELECT symbol, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS ts, min(seq) AS seq FROM ticks GROUP BY 1, 2")


def _curves(s, d):
    b = bars(s, d).select("symbol", "ts", F.col("close").alias("value"))
    return b.where("ts < '2024-01-20'").withColumn("curve", F.lit(1)).union(b.where("ts >= '2024-01-10'").withColumn("curve", F.lit(2)))


add("q_2_4_25_combined_curves", lambda s, d: rounded(V.combined_curves(_curves(s, d)), "equity"), over_bars(f"SELECT symbol, {EPOCH}, round(first(e ORDER BY c), 6) AS equity FROM (SELECT *, v / first_value(v) OVER (PARTITION BY c, symbol ORDER BY ts) AS e FROM cu) GROUP BY symbol, ts", "cu AS (SELECT 1 AS c, symbol, ts, close AS v FROM bars WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT 2, symbol, ts, close FROM bars WHERE ts >= TIMESTAMP '2024-01-10')"))
add(
    "q_2_13_7_group_split", lambda s, d: V.group_split(bars(s, d)).select("symbol", seconds(), "role"),
    over_bars(f"SELECT symbol, {EPOCH}, CASE WHEN i < a - 5 THEN 'train' WHEN i < a + 3 THEN 'none' WHEN i < b - 5 THEN 'validation' WHEN i < b + 3 THEN 'none' ELSE 'test' END AS role FROM gs", step("gs", {"i": f"row_number() OVER ({W}) - 1", "a": "floor(0.7::DOUBLE * count(*) OVER (PARTITION BY symbol))", "b": "floor((0.7::DOUBLE + 0.15::DOUBLE) * count(*) OVER (PARTITION BY symbol))"})),
)


def mean_deviation(x: pd.Series) -> float:
    return (x - x.mean()).abs().mean()


add(
    "q_2_16_6_rolling_function", lambda s, d: rounded(V.rolling_apply(bars(s, d), "close", 10, mean_deviation, "deviation"), "deviation"),
    over_bars(f"SELECT symbol, {EPOCH}, round(CASE WHEN len(l) = 10 THEN list_avg(list_transform(l, lambda x: abs(x - list_avg(l)))) END, 6) AS deviation FROM (SELECT *, list(close) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM bars)"),
)

# Parameter search.
PARAMS = (5, 10, 20)
_scores = lambda s, d: V.crossover_scores(bars(s, d), PARAMS)
CS = [
    step("k0", {"r": RET(1), "fold": f"ntile(4) OVER ({W})", **{f"g{p}": f"sign(close - {roll('avg(close)', p)})" for p in PARAMS}}), step("k1", {f"v{p}": f"{lag(f'g{p}')} * r" for p in PARAMS}, "k0"),
    "cs AS (" + " UNION ALL ".join(f"SELECT symbol, fold, {p}::BIGINT AS param, round(sum(v{p}), 9) AS score FROM k1 GROUP BY 1, 2" for p in PARAMS) + ")",
    "bs AS (SELECT symbol, fold, last(param ORDER BY score, -param) AS param, max(score) AS ts_ FROM cs GROUP BY 1, 2)",
]
add("q_2_13_13_search_objective", lambda s, d: rounded(_scores(s, d), "score", keys=("symbol", "fold", "param")), over_bars("SELECT symbol, fold, param, round(score, 6) AS score FROM cs", *CS))
add("q_2_13_14_walk_forward_search", lambda s, d: rounded(V.walk_forward_search(_scores(s, d)), "train_score", "test_score", keys=("symbol", "fold", "param")), over_bars("SELECT bs.symbol, bs.fold, bs.param, round(bs.ts_, 6) AS train_score, round(cs.score, 6) AS test_score FROM bs JOIN cs ON cs.symbol = bs.symbol AND cs.fold = bs.fold + 1 AND cs.param = bs.param", *CS))
add(
    "q_2_1_38_metrics_sink", lambda s, d: rounded(V.fold_metrics(_returns(s, d)).unpivot(["symbol", "fold"], ["sharpe", "mean"], "metric", "value").where("value is not null"), "value", keys=("symbol", "fold", "metric"), digits=5),
    over_bars("SELECT symbol, fold, 'sharpe' AS metric, round(sharpe, 5) AS value FROM fm WHERE sharpe IS NOT NULL UNION ALL SELECT symbol, fold, 'mean', round(mean, 5) FROM fm WHERE mean IS NOT NULL", *FM),
)
