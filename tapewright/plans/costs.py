"""Queries of execution costs and sizes on line items as fills (survey 2.4, 2.11 and 2.12) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import rolling as R
from tapewright.operators import costs as K
from tapewright.plans.build import rounded
from tapewright.plans.indicators import step
from tapewright.plans.oracle import roll
from tapewright.plans.portfolios import EPOCH, U0, _universe, over_users
from tapewright.sources.tables import seconds, table

QUERIES: dict = {}
ORACLES: dict = {}
#: Odd, so that results are no ties of the rounding.
BASE = 5.01372913
ETA = 0.10372913
HOURS = {0: 1.5, 1: 1.2, 15: 1.3}


def _fills(s, d):
    """Line items as fills: returned ones are sales; a part's whole quantity stands for its daily volume."""
    x = table(s, d, "lineitem")
    adv = x.groupBy("l_partkey").agg(F.sum("l_quantity").alias("adv"))
    return x.join(adv, "l_partkey").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("quantity"), F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0).alias("side"), "adv", (F.col("l_discount") + 0.01).alias("sigma"), (F.col("l_tax") * 10 + 0.4).alias("volume_ratio"), (F.col("l_orderkey") % 24).alias("hour"), F.col("l_partkey").alias("part"),
    )


FI = """WITH f AS (SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS q, l_extendedprice / nullif(l_quantity, 0) AS p, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END::DOUBLE AS side,
 sum(l_quantity) OVER (PARTITION BY l_partkey) AS adv, l_discount + 0.01::DOUBLE AS sigma, l_tax * 10 + 0.4::DOUBLE AS vr, l_orderkey % 24 AS hour FROM lineitem),
 g AS (SELECT *, CASE WHEN side > 0 THEN p * 1.00051237::DOUBLE ELSE p / 1.00051237::DOUBLE END AS fill, p * (1 + CASE WHEN line % 2 = 0 THEN 0.0002 ELSE 0.001 END::DOUBLE * side) AS lim,
 1037.2913::DOUBLE * (q / 0.5) / adv AS tb, 500 * q / adv AS pb, least(50, greatest(1, 5.01372913 * greatest(0.5, 1 + (sigma / 0.02 - 1)) * CASE WHEN vr > 0 THEN greatest(0.5, 1 + 0.5 * (1 / vr - 1)) ELSE 1 END)) AS sp0,
 least(50, greatest(1, 5.01372913 * greatest(0.5, 1 + (sigma / 0.02 - 1)) * CASE WHEN vr > 0 THEN greatest(0.5, 1 + 0.5 * (1 / vr - 1)) ELSE 1 END * CASE hour WHEN 0 THEN 1.5 WHEN 1 THEN 1.2 WHEN 15 THEN 1.3 ELSE 1.0 END)) AS sp FROM f)
"""


def on_fills(name, make, sql, digits=6):
    """make() gives the columns by name; columns are built on use, since they need a session."""
    QUERIES[name] = lambda s, d: rounded(_fills(s, d).withColumns(make()), *sql, keys=("order_id", "line"), digits=digits)
    ORACLES[name] = FI + "SELECT order_id, line, " + ", ".join(f"round({e}, {digits}) AS {n}" for n, e in sql.items()) + " FROM g"


def _c(*names):
    return [F.col(n) for n in names]


def _simple():
    price, side, line = _c("price", "side", "line")
    fill = K.simple_fill(price, side, 5.1237)
    limit = price * (1 + F.when(line % 2 == 0, 0.0002).otherwise(0.001) * side)
    return {"fill": fill, "filled": K.limit_reached(fill, side, limit).cast("double")}


def _linear():
    quantity, adv, price, side, sigma, ratio = _c("quantity", "adv", "price", "side", "sigma", "volume_ratio")
    temporary, permanent = K.impact(quantity, 0.5, adv, ETA)
    total = temporary + permanent + K.spread(sigma, ratio, BASE) / 2
    return {"temporary_bps": temporary, "permanent_bps": permanent, "total_bps": total, "execution_price": K.shifted(price, side, total), "participation": quantity / (adv * 0.5)}


def _effective():
    quantity, adv, price, side, sigma, ratio = _c("quantity", "adv", "price", "side", "sigma", "volume_ratio")
    return {"effective_price": K.shifted(price, side, K.spread(sigma, ratio, BASE) / 2 + 5 * (quantity / adv) * 10_000)}


def _cost_parts():
    quantity, adv, price, side, sigma, ratio = _c("quantity", "adv", "price", "side", "sigma", "volume_ratio")
    value, temporary = quantity * price, K.impact(quantity, 0.5, adv, ETA)[0]
    half = K.spread(sigma, ratio, BASE) / 2
    return {"commission": value * 0.001, "spread_cost": value * half / 10_000, "impact_cost": value * temporary / 10_000, "total_bps": 10 + half + temporary, "value": value, "effective_price": K.shifted(price, side, 10 + half + temporary)}


on_fills("q_2_12_3_simple_fill", _simple, {"fill": "fill", "filled": "CASE WHEN (side > 0 AND fill <= lim) OR (side < 0 AND fill >= lim) THEN 1.0 ELSE 0.0 END"})
on_fills("q_2_12_4_linear_impact", _linear, {"temporary_bps": "tb", "permanent_bps": "pb", "total_bps": "tb + pb + sp0 / 2", "execution_price": "p * (1 + side * (tb + pb + sp0 / 2) / 10000)", "participation": "q / (adv * 0.5)"})
on_fills("q_2_12_5_spread_model", lambda: {"spread_bps": K.spread(*_c("sigma", "volume_ratio"), BASE, hour=F.col("hour"), busy=HOURS)}, {"spread_bps": "sp"})
on_fills("q_2_12_59_effective_price", _effective, {"effective_price": "p * (1 + side * (sp0 / 2 + 50000 * (q / adv)) / 10000)"})
on_fills("q_2_12_60_cost_breakdown", _cost_parts, {"commission": "q * p * 0.001", "spread_cost": "q * p * sp0 / 20000", "impact_cost": "q * p * tb / 10000", "total_bps": "10 + sp0 / 2 + tb"})
on_fills("q_2_11_29_fill_fields", _cost_parts, {"value": "q * p", "effective_price": "p * (1 + side * (10 + sp0 / 2 + tb) / 10000)"})
on_fills("q_2_12_61_impact_components", lambda: dict(zip(("expected", "variance"), K.impact_cost(F.col("quantity"), 0.5, *_c("adv", "sigma"), ETA))), {"expected": "(pb + tb * 0.5) / 10000", "variance": "pow(sigma * q, 2) * 0.5 / 3"})
on_fills("q_2_12_58_participation_price", lambda: {"fill": K.shifted(*_c("price", "side"), K.capped_impact(F.col("quantity"), *_c("adv", "sigma")) * 10_000 + 5)}, {"fill": "p * (1 + side * (least(sigma * sqrt(q / adv), 0.2) * 10000 + 5) / 10000)"})
on_fills("q_2_12_62_execution_price", lambda: {"execution_price": F.col("price") + F.col("side") * F.col("price") * F.col("sigma") / 97}, {"execution_price": "p + side * p * sigma / 97"})
on_fills("q_2_4_118_position_impact", lambda: {"impact": K.capped_impact(F.col("quantity"), *_c("adv", "sigma"))}, {"impact": "least(sigma * sqrt(q / adv), 0.2)"})
on_fills("q_2_12_35_volatility_adjusted_size", lambda: {"size": K.volatility_scaled(F.col("quantity") / 50 * F.col("side"), F.col("sigma"))}, {"size": "greatest(-1, least(1, q / 50 * side * greatest(0.25, least(2, 0.15 / sigma))))"})
on_fills("q_2_12_37_bet_size", lambda: {"size": K.bet_size(F.col("quantity") / 50, F.col("side"))}, {"size": "CASE WHEN q / 50 >= 0.55 THEN greatest(0, least(1, 2 * (q / 50) - 1)) * side ELSE 0 END"})
on_fills("q_2_12_63_fixed_fraction", lambda: {"shares": F.floor(1e6 * 0.02 / F.col("price")).cast("double")}, {"shares": "floor(20000 / p)"})
on_fills("q_2_12_64_volatility_target", lambda: {"size": K.target_size(1e6, 0.1, F.col("sigma"))}, {"size": "CASE WHEN sigma > 0 THEN 100000 / sigma ELSE 0 END"})
on_fills("q_2_12_54_adaptive_threshold", lambda: {"threshold": K.rebalance_threshold(F.col("sigma") * 3, F.col("volume_ratio") / 1000)}, {"threshold": "0.05 * greatest(0.5, least(2, 1 + (sigma * 3 - 0.15) / 0.15)) * (1 + vr / 10)"})
on_fills("q_2_4_21_trade_cost_pct", lambda: {"cost_pct": F.try_divide(100 * (F.col("quantity") * F.col("price") * 0.001 + 1), F.col("quantity") * F.col("price"))}, {"cost_pct": "100 * (q * p * 0.001 + 1) / (q * p)"})

QUERIES["q_2_4_20_trade_summary"] = lambda s, d: rounded(
    _fills(s, d).withColumns({"value": F.col("quantity") * F.col("price"), "part": F.col("part") % 10}).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") > 0).alias("buys"), F.count_if(F.col("side") < 0).alias("sells"), F.sum("value").alias("value"), F.sum(F.col("value") * 0.001).alias("costs"), F.avg("value").alias("mean_value")
    ), "value", "costs", "mean_value", keys=("part", "n", "buys", "sells"), digits=3,
)
ORACLES["q_2_4_20_trade_summary"] = "SELECT l_partkey % 10 AS part, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS buys, count(*) FILTER (l_returnflag = 'R') AS sells, round(sum(l_extendedprice), 3) AS value, round(sum(l_extendedprice) * 0.001, 3) AS costs, round(avg(l_extendedprice), 3) AS mean_value FROM lineitem GROUP BY 1"
QUERIES["q_2_4_59_trade_costs"] = lambda s, d: rounded(
    _fills(s, d).withColumns(_cost_parts()).groupBy("order_id").agg(F.sum("commission").alias("commission"), F.sum(F.col("spread_cost") + F.col("impact_cost")).alias("slippage"), (100 * F.sum(F.col("commission") + F.col("spread_cost") + F.col("impact_cost")) / F.sum("value")).alias("total_pct")), "commission", "slippage", "total_pct", keys=("order_id",), digits=6,
)
ORACLES["q_2_4_59_trade_costs"] = FI + "SELECT order_id, round(sum(q * p * 0.001), 6) AS commission, round(sum(q * p * (sp0 / 20000 + tb / 10000)), 6) AS slippage, round(100 * sum(q * p * (0.001 + sp0 / 20000 + tb / 10000)) / sum(q * p), 6) AS total_pct FROM g GROUP BY order_id"


# Weights of the wide universe by momentum, and those of the day before.
def _momentum_weights(s, d):
    u = _universe(s, d).withColumn("m", R.mean("r", 5)).where("m is not null")
    gross = u.groupBy("ts").agg(F.sum(F.abs("m")).alias("g"))
    return u.join(gross, "ts").where("g > 0").select("ts", "symbol", (F.col("m") / F.col("g")).alias("weight"))


_before = lambda w: w.withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
MW = [step("u1", {"m": roll("avg(r)", 5)}, "u0"), "w AS (SELECT * FROM (SELECT ts, symbol, m / nullif(sum(abs(m)) OVER (PARTITION BY ts), 0) AS weight FROM u1 WHERE m IS NOT NULL) WHERE weight IS NOT NULL)", "b AS (SELECT ts + INTERVAL 1 DAY AS ts, symbol, weight FROM w)", "dr AS (SELECT coalesce(w.ts, b.ts) AS ts, coalesce(w.symbol, b.symbol) AS symbol, coalesce(b.weight, 0) AS cu, coalesce(w.weight, 0) AS ta FROM w FULL JOIN b ON w.ts = b.ts AND w.symbol = b.symbol)"]


def _drift(s, d):
    w = _momentum_weights(s, d)
    return K.drift(_before(w), w, 0.01)


QUERIES["q_2_12_24_drift_and_trades"] = lambda s, d: rounded(_drift(s, d), "drift", keys=("symbol", "ts", "trade"), digits=7)
ORACLES["q_2_12_24_drift_and_trades"] = over_users(f"SELECT symbol, {EPOCH}, CASE WHEN ta - cu > 0.01 THEN 'buy' WHEN ta - cu < -0.01 THEN 'sell' ELSE 'hold' END AS trade, round(ta - cu, 7) AS drift FROM dr", U0, *MW)
QUERIES["q_2_12_73_portfolio_drift"] = lambda s, d: rounded(_drift(s, d).groupBy("ts").agg(F.sum(F.abs("drift")).alias("total_drift"), F.max(F.abs("drift")).alias("max_drift")), "total_drift", "max_drift", keys=("ts",))
ORACLES["q_2_12_73_portfolio_drift"] = over_users(f"SELECT {EPOCH}, round(sum(abs(ta - cu)), 6) AS total_drift, round(max(abs(ta - cu)), 6) AS max_drift FROM dr GROUP BY ts", U0, *MW)
QUERIES["q_2_12_56_needs_rebalance"] = lambda s, d: _drift(s, d).groupBy("ts").agg((F.max(F.abs("drift")) > 0.05).cast("long").alias("rebalance")).select(seconds(), "rebalance")
ORACLES["q_2_12_56_needs_rebalance"] = over_users(f"SELECT {EPOCH}, CAST(max(abs(ta - cu)) > 0.05 AS BIGINT) AS rebalance FROM dr GROUP BY ts", U0, *MW)
QUERIES["q_2_10_4_zero_filled_union"] = lambda s, d: rounded(_drift(s, d), "current", "target", digits=7)
ORACLES["q_2_10_4_zero_filled_union"] = over_users(f"SELECT symbol, {EPOCH}, round(cu, 7) AS current, round(ta, 7) AS target FROM dr", U0, *MW)
QUERIES["q_2_12_28_small_trades"] = lambda s, d: rounded(K.without_small_trades(_drift(s, d)), "weight", digits=7)
ORACLES["q_2_12_28_small_trades"] = over_users(f"SELECT symbol, {EPOCH}, round(CASE WHEN g > 0 THEN k / g ELSE k END, 7) AS weight FROM (SELECT *, sum(abs(k)) OVER (PARTITION BY ts) AS g FROM (SELECT *, CASE WHEN abs(ta - cu) >= 0.01 THEN ta ELSE cu END AS k FROM dr))", U0, *MW)
_exposure = lambda w: w.groupBy("ts").agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"), F.max(F.abs("weight")).alias("largest"), (F.sum("weight") / F.sum(F.abs("weight"))).alias("tilt"), (1 / F.sum(F.col("weight") * F.col("weight"))).alias("bets"))
QUERIES["q_2_12_47_gross_exposure"] = lambda s, d: rounded(_exposure(_momentum_weights(s, d)), "gross", "net", "largest", keys=("ts",))
ORACLES["q_2_12_47_gross_exposure"] = over_users(f"SELECT {EPOCH}, round(sum(abs(weight)), 6) AS gross, round(sum(weight), 6) AS net, round(max(abs(weight)), 6) AS largest FROM w GROUP BY ts", U0, *MW)
QUERIES["q_2_4_43_effective_bets"] = lambda s, d: rounded(_exposure(_momentum_weights(s, d)), "bets", keys=("ts",))
ORACLES["q_2_4_43_effective_bets"] = over_users(f"SELECT {EPOCH}, round(1 / sum(weight * weight), 6) AS bets FROM w GROUP BY ts", U0, *MW)
QUERIES["q_2_9_34_clipped_pair_weights"] = lambda s, d: rounded(_momentum_weights(s, d).withColumn("clipped", K.clip(F.col("weight"), -0.1, 0.1)), "clipped", digits=7)
ORACLES["q_2_9_34_clipped_pair_weights"] = over_users(f"SELECT symbol, {EPOCH}, round(greatest(-0.1, least(0.1, weight)), 7) AS clipped FROM w", U0, *MW)
QUERIES["q_2_4_116_sector_exposure"] = lambda s, d: rounded(_momentum_weights(s, d).groupBy("ts", (F.col("symbol") % 5).alias("sector")).agg(F.sum("weight").alias("exposure")), "exposure", keys=("ts", "sector"), digits=7)
ORACLES["q_2_4_116_sector_exposure"] = over_users(f"SELECT {EPOCH}, symbol % 5 AS sector, round(sum(weight), 7) AS exposure FROM w GROUP BY ts, 2", U0, *MW)
QUERIES["q_2_12_52_concentration_alert"] = lambda s, d: rounded(_momentum_weights(s, d).where(F.abs("weight") > 0.1), "weight", digits=7)
ORACLES["q_2_12_52_concentration_alert"] = over_users(f"SELECT symbol, {EPOCH}, round(weight, 7) AS weight FROM w WHERE abs(weight) > 0.1", U0, *MW)
