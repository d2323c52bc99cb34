"""Exponential averages as a blocked linear scan, so that one long series isn't one sequential task.

y_t = (1 - a) y_(t-1) + a x_t, started by the first value. A series is dealt to spans of time; inside
a span rows are numbered and cut into blocks of BLOCK rows, in which y is a running sum of scaled
values. What a block leaves behind is an affine map of what it starts with, so blocks are folded
within their span, and then spans within their series: 1,400 of them in ten years. Rows meet only
rows of their own span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: few enough that no power of 1 - a overflows for a up to 0.9999.
BLOCK = 64
#: Seconds (or units of a numeric order) of a span.
SPAN = 230_400


def alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def ema(df: DataFrame, specs: dict[str, tuple[str, float]], key: str = "symbol", order: str = "ts", adjust: bool = False, span: int = SPAN) -> DataFrame:
    """Adds columns: name -> (input column, alpha). Inputs may be null before their first value only.

    With adjust the weights are normalised over what has been seen, as pandas' default does.
    """
    at = F.unix_timestamp(order) if dict(df.dtypes)[order].startswith("timestamp") else F.col(order).cast("long")
    inputs = sorted({x for x, _ in specs.values()})
    firsts = df.groupBy(key).agg(*[F.min(F.when(F.col(x).isNotNull(), F.col(order))).alias(f"_f_{x}") for x in inputs])
    df = df.join(firsts, key).withColumn("_span", F.floor(at / span))
    df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_span").orderBy(order)) - 1)
    df = df.withColumns({"_block": F.expr(f"cast(_rn div {BLOCK} as int)"), "_j": F.col("_rn") % BLOCK})
    scans = {}  # name -> (values, 1 - alpha, input)
    for name, (x, a) in specs.items():
        weight = F.lit(1.0) if adjust else F.when(F.col(order) == F.col(f"_f_{x}"), 1.0).otherwise(a)
        scans[name] = (F.col(x) * weight, 1.0 - a, x)
        if adjust:
            scans[f"{name}__w"] = (F.when(F.col(x).isNotNull(), F.lit(1.0)), 1.0 - a, x)
    inside = Window.partitionBy(key, "_span", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    power = lambda r, n: F.pow(F.lit(max(r, 0.0)), n)

    def local(value, r):
        return F.coalesce(value, F.lit(0.0)) if r <= 0 else power(r, F.col("_j")) * F.sum(F.coalesce(value, F.lit(0.0)) * power(r, -F.col("_j"))).over(inside)

    df = df.withColumns({f"_l_{n}": local(v, r) for n, (v, r, _) in scans.items()})
    ends = df.groupBy(key, "_span", "_block").agg((F.max("_j") + 1).alias("_m"), *[F.max_by(f"_l_{n}", "_j").alias(f"_e_{n}") for n in scans])

    def folded(rows: str, name: str, r: float):
        """struct(y, into): what comes out of the maps in `rows` one after the other, and what goes into each of them, from 0 on."""
        start = F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("into"))
        return F.aggregate(rows, start, lambda s, b: F.struct((s["y"] * power(r, b["_m"]) + b[f"_e_{name}"]).alias("y"), F.concat(s["into"], F.array(s["y"])).alias("into")))

    spans = ends.groupBy(key, "_span").agg(F.array_sort(F.collect_list(F.struct("_block", "_m", *[f"_e_{n}" for n in scans]))).alias("_all"), F.sum("_m").alias("_m"))
    spans = spans.select(key, "_span", "_m", *[folded("_all", n, r).alias(f"_s_{n}") for n, (_, r, _) in scans.items()])
    series = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_span", "_m", *[F.col(f"_s_{n}.y").alias(f"_e_{n}") for n in scans]))).alias("_all"))
    parts = [F.transform("_all", lambda b: b["_span"]).alias("_of"), *[folded("_all", n, r)["into"].alias(f"_c_{n}") for n, (_, r, _) in scans.items()]]
    carried = series.select(key, *parts).select(key, F.explode(F.arrays_zip("_of", *[f"_c_{n}" for n in scans])).alias("_z")).select(key, F.col("_z._of").alias("_span"), *[f"_z._c_{n}" for n in scans])
    into = spans.select(key, "_span", *[F.col(f"_s_{n}.into").alias(f"_i_{n}") for n in scans]).join(carried, [key, "_span"])
    df = df.join(into, [key, "_span"])

    def whole(n):
        r = scans[n][1]
        start = F.get(f"_i_{n}", F.col("_block")) + F.col(f"_c_{n}") * power(r, F.col("_block") * BLOCK)
        return F.col(f"_l_{n}") + start * power(r, F.col("_j") + 1) if r > 0 else F.col(f"_l_{n}")

    out = {}
    for name, (x, _) in specs.items():
        y = F.try_divide(whole(name), whole(f"{name}__w")) if adjust else whole(name)
        out[name] = F.when(F.col(order) >= F.col(f"_f_{x}"), y)
    made = {"_rn", "_block", "_j", "_span", *(f"_f_{x}" for x in inputs), *(f"{kind}{n}" for kind in ("_l_", "_i_", "_c_") for n in scans), *out}
    return df.select(*[c for c in df.columns if c not in made], *[y.alias(name) for name, y in out.items()])
