"""Queries of unit roots, pairs and breaks (survey 2.8.12 to 2.8.17, 2.8.57, 2.8.64) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.operators import breaks as B
from tapewright.operators import microstructure as M
from tapewright.operators import statistics as S
from tapewright.operators import stationarity as T
from tapewright.plans.build import rounded
from tapewright.plans.oracle import W, exchange_steps, over_bars, pivots, products, run
from tapewright.plans.statistics import PS, WA
from tapewright.sources.tables import bars, seconds

QUERIES: dict = {}
ORACLES: dict = {}
LAGS = 5
M_ = LAGS + 3


def add(name, make, sql):
    QUERIES[name] = make
    ORACLES[name] = sql


def unit_root(source: str, x: str, by: str, name: str, order: str = "ts") -> list[str]:
    """Steps to `name`: (by, n, lags, t) of the augmented regression of x, null-free, in `source`."""
    w = f"PARTITION BY {by} ORDER BY {order}"
    d = [f"lag(x, {k}) OVER ({w}) - lag(x, {k + 1}) OVER ({w})" if k else f"x - lag(x) OVER ({w})" for k in range(LAGS + 1)]
    values = ["1.0", "p", *[f"d{k}" for k in range(1, LAGS + 1)], "d0"]
    fits = ", ".join(
        f"CASE WHEN n > {q + 2} AND a{q}[{M_ * M_}] > 0 THEN {{'aic': round(n * ln(a{q}[{M_ * M_}] / n) + {2 * (q + 2)}, 6), 'lags': {q}::BIGINT, 't': a{q}[{2 * M_}] / nullif(sqrt(a{q}[{M_ * M_}] / (n - {q + 2}) * a{q}[{M_ + 2}]), 0)}} END"
        for q in range(LAGS + 1)
    )
    return [
        f"{name}_x AS (SELECT {by}, {order}, CAST({x} AS DOUBLE) AS x FROM {source} WHERE {x} IS NOT NULL)",
        f"{name}_l AS (SELECT {by}, lag(x) OVER ({w}) AS p, {', '.join(f'{c} AS d{k}' for k, c in enumerate(d))} FROM {name}_x)",
        f"{name}_g AS (SELECT {by}, count(*) AS n, {products(values)} AS g FROM {name}_l WHERE p IS NOT NULL AND d{LAGS} IS NOT NULL GROUP BY {by})",
        f"{name}_a AS (SELECT *, {', '.join(exchange_steps('g', M_, pivots(q + 2)) + f' AS a{q}' for q in range(LAGS + 1))} FROM {name}_g)",
        f"{name} AS (SELECT {by}, n, best.lags AS lags, best.t AS t FROM (SELECT {by}, n, list_min(list_filter([{fits}], lambda s: s.aic IS NOT NULL)) AS best FROM {name}_a))",
    ]


add(
    "q_2_8_13_adf", lambda s, d: rounded(T.unit_root(bars(s, d), "close", ["symbol"]).withColumn("stationary", (F.col("t") < T.UNIT_ROOT_5).cast("long")), "t", keys=("symbol", "n", "lags", "stationary"), digits=5),
    over_bars(f"SELECT symbol, n, lags, round(t, 5) AS t, CAST(t < {T.UNIT_ROOT_5} AS BIGINT) AS stationary FROM ur", *unit_root("bars", "close", "symbol", "ur")),
)
KP = [
    f"k0 AS (SELECT symbol, close, row_number() OVER ({W}) AS i, count(*) OVER (PARTITION BY symbol) AS n, close - avg(close) OVER (PARTITION BY symbol) AS e, ts FROM bars WHERE close IS NOT NULL)",
    f"k1 AS (SELECT symbol, i, n, CAST(least(ceil(12 * pow(n / 100, 0.25)), n - 1) AS BIGINT) AS lags, {run('sum(e)')} AS s FROM k0)",
    "k2 AS (SELECT p.symbol, p.n, p.lags, sum(p.s * p.s) AS num, sum(pow(p.s - coalesce(q.s, 0), 2)) + sum(CASE WHEN p.i >= p.n - p.lags AND p.i < p.n THEN p.s * p.s ELSE 0 END) AS var FROM k1 p LEFT JOIN k1 q ON q.symbol = p.symbol AND q.i = p.i - p.lags - 1 GROUP BY ALL)",
    "k3 AS (SELECT symbol, n, lags, num / nullif(n * (var / (lags + 1)), 0) AS kpss FROM k2)",
]
add("q_2_8_14_kpss", lambda s, d: rounded(T.kpss(bars(s, d), "close"), "kpss", keys=("symbol", "n", "lags", "stationary"), digits=5), over_bars(f"SELECT symbol, n, lags, round(kpss, 5) AS kpss, CAST(kpss < {T.KPSS_5} AS BIGINT) AS stationary FROM k3", *KP))

GRID = [k / 19 for k in range(20)]
WEIGHTS = [S.fractional_weights(d, 1e-3) for d in GRID]
LONGEST = max(map(len, WEIGHTS))
DOT = lambda w: f"CASE WHEN len(v) >= {len(w)} THEN list_sum(list_transform(range(1, {len(w) + 1}), lambda k: v[len(v) - k + 1] * {[float(x) for x in w]}[k])) END"
MD = [
    f"g0 AS (SELECT symbol, ts, close, list(close) OVER ({W} ROWS BETWEEN {LONGEST - 1} PRECEDING AND CURRENT ROW) AS v FROM bars WHERE close IS NOT NULL)",
    "g1 AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT symbol, ts, close, {d!r}::DOUBLE AS d, {DOT(w)} AS v FROM g0" for d, w in zip(GRID, WEIGHTS, strict=True)) + ") WHERE v IS NOT NULL)",
    *unit_root("g1", "v", "symbol, d", "ur"), "g2 AS (SELECT symbol, d, corr(close, v) AS c, count(*) AS n FROM g1 GROUP BY ALL)",
    "g3 AS (SELECT symbol, count(*) AS tested, min(d) FILTER (t < -2.86) AS best, arg_min(c, d) FILTER (t < -2.86) AS c FROM g2 LEFT JOIN (SELECT symbol, d, t FROM ur) USING (symbol, d) WHERE n >= 20 GROUP BY 1)",
]
add(
    "q_2_8_12_minimum_difference", lambda s, d: rounded(T.minimum_difference(bars(s, d), threshold=1e-3), "d", "correlation", keys=("symbol", "found", "tested")),
    over_bars("SELECT symbol, round(coalesce(best, 1.0), 6) AS d, round(CASE WHEN best IS NULL THEN 0 ELSE c END, 6) AS correlation, CAST(best IS NOT NULL AS BIGINT) AS found, tested FROM g3", *MD),
)

PT = [*PS, *unit_root("s2", "sp", "a, b", "ur"), "hl AS (SELECT a, b, any_value(h) AS hedge, 1 + regr_slope(sp - p, p) AS s FROM (SELECT a, b, h, sp, lag(sp) OVER (PARTITION BY a, b ORDER BY ts) AS p FROM s2) GROUP BY 1, 2)"]
add(
    "q_2_8_15_pair_tests", lambda s, d: rounded(T.pair_tests(M.pair_spreads(bars(s, d))), "hedge", "t", "half_life", keys=("a", "b", "n", "lags", "cointegrated"), digits=4),
    over_bars(f"SELECT a, b, round(hedge, 4) AS hedge, n, lags, round(t, 4) AS t, CAST(coalesce(t, 0) < {T.PAIR_5} AS BIGINT) AS cointegrated, CASE WHEN s > 0 AND s < 1 THEN round(-ln(2) / ln(s), 4) END AS half_life FROM hl LEFT JOIN ur USING (a, b)", *PT),
)
FOUND = "f0 AS (SELECT a, b, hedge, n, lags, t, CASE WHEN s > 0 AND s < 1 THEN -ln(2) / ln(s) END AS half_life FROM hl LEFT JOIN ur USING (a, b))"
add(
    "q_2_8_16_pair_search", lambda s, d: rounded(T.pair_search(bars(s, d)), "hedge", "t", "half_life", keys=("a", "b", "n", "lags"), digits=4),
    over_bars(f"SELECT a, b, n, lags, round(hedge, 4) AS hedge, round(t, 4) AS t, round(half_life, 4) AS half_life FROM f0 WHERE coalesce(t, 0) < {T.PAIR_5} AND (half_life IS NULL OR half_life BETWEEN 1 AND 252)", *PT, FOUND),
)
BANDS, BITS = 16, 4
SIGN = lambda k: f"CASE WHEN substr(h, {k + 1}, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
OVER = lambda k: f"(p{k} > m * s{k})"
PJ = [
    f"j0 AS (SELECT symbol, CAST(epoch(ts) AS BIGINT) AS t, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars)",
    f"j1 AS (SELECT symbol, band, r, md5('0:' || band || ':' || t) AS h FROM j0, range({BANDS}) b(band) WHERE r IS NOT NULL)",
    f"j2 AS (SELECT symbol, band, avg(r) AS m, {', '.join(f'sum({SIGN(k)} * r) AS p{k}, sum({SIGN(k)}) AS s{k}' for k in range(BITS))} FROM j1 GROUP BY ALL)",
    f"j3 AS (SELECT symbol, band, {' || '.join(f'CAST(CAST({OVER(k)} <> {OVER(0)} AS INT) AS VARCHAR)' for k in range(BITS))} AS word FROM j2)",
]
add(
    "q_2_8_16_projected_pairs", lambda s, d: T.projected_pairs(bars(s, d), BANDS, BITS),
    over_bars("SELECT x.symbol AS a, y.symbol AS b, count(*) AS shared FROM j3 x JOIN j3 y USING (band, word) WHERE x.symbol < y.symbol GROUP BY ALL", *PJ),
)
TL = "tl AS (SELECT a, b, CASE WHEN sxy = 0 THEN NULL ELSE (syy - sxx + sqrt(pow(syy - sxx, 2) + 4 * sxy * sxy)) / (2 * sxy) END AS h FROM (SELECT a, b, var_pop(y) AS syy, var_pop(x) AS sxx, covar_pop(y, x) AS sxy FROM s0 GROUP BY 1, 2))"
add(
    "q_2_8_17_total_least_squares", lambda s, d: rounded(T.total_least_squares(M.pair_rows(bars(s, d))), "hedge", "mean", "sd", keys=("a", "b"), digits=4),
    over_bars("SELECT a, b, round(any_value(h), 4) AS hedge, round(avg(y - h * x), 4) AS mean, round(stddev_samp(y - h * x), 4) AS sd FROM s0 JOIN tl USING (a, b) GROUP BY 1, 2", *PS, TL),
)

WALD = "CASE WHEN k >= floor(n * 0.15) AND k <= n - floor(n * 0.15) AND k > 1 THEN (m1 - m2) * (m1 - m2) / nullif(v1 / k + v2 / nullif(n - k, 0), 0) END"
BR = [
    *WA, f"b0 AS (SELECT symbol, ts, k, round({WALD}, 9) AS wald, r FROM w3)",
    "bl AS (SELECT symbol, list([k] ORDER BY wald DESC, k) AS ks FROM b0 WHERE wald >= LIMIT GROUP BY symbol)",
    "b1 AS (SELECT symbol, list_reduce(list_prepend([]::BIGINT[], ks), lambda a, c: CASE WHEN len(a) < 5 AND len(list_filter(a, lambda x: abs(x - c[1]) < 20)) = 0 THEN list_append(a, c[1]) ELSE a END) AS chosen FROM bl)",
    "b2 AS (SELECT symbol, unnest(chosen) AS pos FROM b1)",
    "b3 AS (SELECT b.symbol, pos, avg(r) FILTER (k <= pos) AS m, avg(r) FILTER (k > pos) AS q, max(ts) FILTER (k = pos) AS ts, max(wald) FILTER (k = pos) AS wald FROM b0 b JOIN b2 USING (symbol) GROUP BY ALL)",
]


def _breaks(limit):
    return lambda s, d: rounded(B.top_breaks(S.wald_breaks(bars(s, d)), limit=limit), "wald", "magnitude", keys=("symbol", "ts", "place", "direction"), digits=5)


SELECTED = "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, pos AS place, CASE WHEN q > m THEN 'increase' ELSE 'decrease' END AS direction, round(wald, 5) AS wald, round(abs(q - m), 5) AS magnitude FROM b3"
add("q_2_8_64_top_breaks", _breaks(B.CHI2_5), over_bars(SELECTED, *[x.replace("LIMIT", repr(B.CHI2_5)) for x in BR]))
add("q_2_8_64_spaced_candidates", _breaks(0.5), over_bars(SELECTED, *[x.replace("LIMIT", "0.5") for x in BR]))

# 2.8.57: the matrix is squared until its largest part is all that is left.
N = 5
SQUARE = f"list_transform(range({N * N}), lambda q: list_sum(list_transform(range({N}), lambda k: m[(q // {N}) * {N} + k + 1] * m[k * {N} + q % {N} + 1])) )"
TRACE = lambda m: f"list_sum(list_transform(range({N}), lambda k: {m}[k * {N + 1} + 1]))"
EI = [
    "e0 AS (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars)", f"e1 AS (SELECT ts, list(r ORDER BY symbol) AS v FROM e0 WHERE r IS NOT NULL GROUP BY ts HAVING count(*) = {N})",
    "e2 AS (SELECT ts, list(v) OVER (ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS h FROM e1)",
    f"e3 AS (SELECT ts, h, list_transform(range(1, {N + 1}), lambda i: list_avg(list_transform(h, lambda v: v[i]))) AS mu FROM e2 WHERE len(h) = 60)",
    f"e4 AS (SELECT ts, list_transform(range({N * N}), lambda q: list_sum(list_transform(h, lambda v: (v[q // {N} + 1] - mu[q // {N} + 1]) * (v[q % {N} + 1] - mu[q % {N} + 1]))) / 59) AS c FROM e3)",
    f"e5 AS (SELECT ts, c, {TRACE('c')} AS tr FROM e4)",
    f"e6 AS (SELECT ts, tr, c, list_reduce(list_prepend(list_transform(c, lambda v: v / tr), [[0.0::DOUBLE] FOR z IN range(18)]), lambda m, z: list_transform({SQUARE}, lambda v: v / list_sum(list_transform(m, lambda w: w * w)))) AS b FROM e5)",
    f"e7 AS (SELECT ts, list_sum(list_transform(range({N * N}), lambda q: c[q + 1] * b[q + 1])) / {TRACE('b')} / tr AS ratio FROM e6)",
]
add("q_2_8_57_eigenvalue_ratio", lambda s, d: rounded(B.eigenvalue_ratio(bars(s, d), 60), "eigenvalue_ratio", keys=("ts",), digits=5), over_bars("SELECT CAST(epoch(ts) AS BIGINT) AS ts, round(ratio, 5) AS eigenvalue_ratio FROM e7", *EI))
