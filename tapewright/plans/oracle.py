"""DuckDB text shared by the oracles: the bars and the windows that pandas' rolling has."""

from __future__ import annotations

TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS size FROM events)"""
USER_TICKS = TICKS.replace("event_type AS symbol", "user_id AS symbol").replace("ticks AS", "uticks AS")


def rollup(name: str = "bars", every: str = "15 MINUTE", source: str = "ticks") -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL {every}, ts) AS ts, first(price ORDER BY ts, seq) AS open,
  max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, CAST(sum(size) AS BIGINT) AS volume,
  sum(price * size) / nullif(sum(size), 0) AS vwap, count(*) AS trade_count FROM {source} GROUP BY 1, 2)"""


W = "PARTITION BY symbol ORDER BY ts"


def roll(agg: str, n: int, least: int | None = None, w: str = W) -> str:
    """agg such as 'avg(close)'; null until n (or least) values of its argument are there."""
    x = agg[agg.index("(") + 1 : agg.rindex(")")]
    frame = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {agg} {frame} END"


def lag(x: str, k: int = 1, w: str = W) -> str:
    return f"lag({x}, {k}) OVER ({w})"


def run(agg: str, w: str = W) -> str:
    return f"{agg} OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ema(x: str, span: float | None = None, alpha: float | None = None, w: str = W) -> str:
    """The recurrence itself, over the list of all values so far."""
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    values = f"list({x}) FILTER ({x} IS NOT NULL) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN {x} IS NOT NULL THEN list_reduce({values}, lambda y, v: {1.0 - a!r} * y + {a!r} * v) END"


TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


def over_bars(select: str, *steps: str) -> str:
    """SELECT ... FROM the last step; each step 'name AS (SELECT ...)' may use those before it, the first `bars`."""
    return "WITH " + ",\n".join([TICKS, rollup(), *steps]) + "\n" + select


def wide(columns: dict[str, str], source: str = "bars", *steps: str, digits: int = 6) -> str:
    """symbol, ts and the rounded columns."""
    cols = ", ".join(f"round({e}, {digits}) AS {n}" for n, e in columns.items())
    return over_bars(f"SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, {cols} FROM {source}", *steps)


def draw(seed: int, *on: str) -> str:
    """A hash of SQL texts, 0 to 2 ** 32 - 1, as in the queries."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(on)})), 1, 8) AS BIGINT)"


def products(columns: list[str], weight: str = "1.0") -> str:
    """List of all sums of products of two columns, row after row."""
    return "[" + ", ".join(f"sum(({a}) * ({b}) * ({weight}))" for a in columns for b in columns) + "]"


def exchange_steps(a: str, m: int, pivots: str) -> str:
    """Matrix `a` (a list of m * m) after exchange steps on the columns in the list `pivots`, such as [[0.0], [1.0]]."""
    step = (
        f"CASE WHEN q // {m} = p[1] AND q % {m} = p[1] THEN 1 / nullif(a[CAST(p[1] * {m} + p[1] AS BIGINT) + 1], 0)"
        f" WHEN q // {m} = p[1] THEN a[q + 1] / nullif(a[CAST(p[1] * {m} + p[1] AS BIGINT) + 1], 0)"
        f" WHEN q % {m} = p[1] THEN -a[q + 1] / nullif(a[CAST(p[1] * {m} + p[1] AS BIGINT) + 1], 0)"
        f" ELSE a[q + 1] - a[CAST(p[1] * {m} AS BIGINT) + q % {m} + 1] * a[(q // {m}) * {m} + CAST(p[1] AS BIGINT) + 1] / nullif(a[CAST(p[1] * {m} + p[1] AS BIGINT) + 1], 0) END"
    )
    return f"list_reduce(list_prepend({a}, {pivots}), lambda a, p: list_transform(range({m * m}), lambda q: {step}))"


def pivots(n: int) -> str:
    return "[" + ", ".join(f"[{k}.0::DOUBLE]" for k in range(n)) + "]"
