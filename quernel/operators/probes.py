"""Named diagnostic probes and chart tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions.ordered import exact_quantiles
from quernel.operators import aggregates as A


@dataclass(frozen=True)
class ProbeResult:
    name: str
    title: str
    table: DataFrame


PROBES: dict[str, Callable[..., ProbeResult]] = {}


def probe(name: str) -> Callable:
    def put(f: Callable[..., ProbeResult]) -> Callable[..., ProbeResult]:
        PROBES[name] = f
        return f

    return put


def available() -> list[str]:
    return sorted(PROBES)


def run(name: str, *args, **kw) -> ProbeResult:
    if name not in PROBES:
        raise KeyError(f"no such probe: {name}; there are {', '.join(available())}")
    return PROBES[name](*args, **kw)


@probe("residual_by_time")
def residual_by_time(df: DataFrame, ts: str, residual: str, days: int = 7) -> ProbeResult:
    return ProbeResult("residual_by_time", f"Residual per {days} days", A.time_buckets(df, ts, residual, days))


@probe("residual_by_group")
def residual_by_group(df: DataFrame, group: str, residual: str, n: int = 10) -> ProbeResult:
    return ProbeResult("residual_by_group", f"Top {n} groups by mean residual", A.top_groups(df, group, residual, n))


@probe("importance_stability")
def importance_stability(gain: DataFrame, permutation: DataFrame, jaccard: float) -> ProbeResult:
    """gain: feature, gain; permutation: feature, mean."""
    g = gain.groupBy("feature").agg(F.avg("gain").alias("gain"))
    table = g.join(permutation.select("feature", F.col("mean").alias("permutation")), "feature", "left").orderBy(F.desc("gain"), "feature")
    return ProbeResult("importance_stability", f"Importances; top features agree to {jaccard:.2f}", table)


@probe("drift_importance_matrix")
def drift_importance_matrix(drift: DataFrame, importance: DataFrame) -> ProbeResult:
    table = drift.join(importance.select("feature", "importance"), "feature", "left")
    table = table.withColumn("critical", (F.col("risk_level") == "high") & (F.coalesce("importance", F.lit(0.0)) > 0))
    return ProbeResult("drift_importance_matrix", "Drift against importance", table)


@probe("icc_group_stability")
def icc_group_stability(icc: DataFrame) -> ProbeResult:
    return ProbeResult("icc_group_stability", "Strongest agreement within groups", icc.orderBy(F.desc("ICC"), "Type").limit(1))


@probe("target_feature_curve")
def target_feature_curve(df: DataFrame, feature: str, target: str) -> ProbeResult:
    return ProbeResult("target_feature_curve", f"{target} by {feature}", df.select(feature, target).na.drop())


def lowess(df: DataFrame, x: str, y: str, share: float = 0.3, points: int = 100) -> DataFrame:
    """x, y: local linear fits with tricube weights at `points` grid values, as one aggregate per grid value."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    s = rows.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    if s["a"] is None:
        return rows
    width = max((s["b"] - s["a"]) * share, 1e-12)
    grid = F.array(*[F.lit(s["a"] + (s["b"] - s["a"]) * i / max(1, points - 1)) for i in range(points)])
    near = rows.select("x", "y", F.explode(F.filter(grid, lambda g: F.abs(g - F.col("x")) < width)).alias("g"))
    w = F.pow(1 - F.pow(F.abs(F.col("x") - F.col("g")) / width, 3), 3)
    d = F.col("x") - F.col("g")
    sums = near.groupBy("g").agg(F.sum(w).alias("w"), F.sum(w * d).alias("wx"), F.sum(w * d * d).alias("wxx"), F.sum(w * F.col("y")).alias("wy"), F.sum(w * d * F.col("y")).alias("wxy"))
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    fit = F.when(F.abs(det) < 1e-12, F.col("wy") / F.col("w")).otherwise((F.col("wxx") * F.col("wy") - F.col("wx") * F.col("wxy")) / det)
    return sums.select(F.col("g").alias("x"), fit.alias("y"))


def box_table(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """group, low, q1, median, q3, high for box charts, of groups with values."""
    rows = df.select((F.col(group).cast("string") if group else F.lit("all")).alias("group"), F.col(value).alias("value"))
    by = exact_quantiles(rows, "value", (0.0, 0.25, 0.5, 0.75, 1.0), ["group"])
    return by.select("group", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def histogram_table(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    s = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    if s["a"] is None:
        return A.histogram(df, value, [0.0, 1.0])
    a, b = float(s["a"]), float(s["b"])
    b = b if b > a else a + 1
    return A.histogram(df, value, [a + (b - a) * i / bins for i in range(bins)] + [b])


def density_table(df: DataFrame, value: str, points: int = 100, bins: int = 512) -> DataFrame:
    """x, density: a Gaussian kernel estimate (Scott's width) over a fine histogram, so that cost does not grow with rows."""
    s = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s")).first()
    h = max((s["s"] or 1.0) * max(s["n"], 1) ** -0.2, 1e-9)
    fine = histogram_table(df, value, bins).where("n > 0").select(((F.col("low") + F.col("high")) / 2).alias("c"), "n")
    lo, hi = fine.agg(F.min("c"), F.max("c")).first()
    if lo is None:
        return fine
    grid = df.sparkSession.range(points).select((F.lit(lo - 3 * h) + F.col("id") * ((hi - lo + 6 * h) / max(1, points - 1))).alias("x"))
    k = F.exp(-F.pow((F.col("x") - F.col("c")) / h, 2) / 2) / (h * (2 * 3.141592653589793) ** 0.5)
    return grid.crossJoin(fine).groupBy("x").agg((F.sum(k * F.col("n")) / s["n"]).alias("density"))  # points * bins rows


def radar_table(table: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """label, axis, value scaled by the axis's largest absolute value."""
    rows = A.long_form(table, values, "double", [label]).withColumnRenamed("feature", "axis")
    top = rows.groupBy("axis").agg(F.max(F.abs("value")).alias("top"))
    return rows.join(top, "axis").select(label, "axis", F.when(F.col("top") > 0, F.col("value") / F.col("top")).otherwise(0.0).alias("value"))


def drift_chart(drift: DataFrame, by: str = "psi", n: int = 20) -> DataFrame:
    return drift.orderBy(F.desc(by), "feature").limit(n).select("feature", by, "risk_level")


def line_table(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y in the order of x: a line; values of equal x are averaged."""
    return df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.avg(y).alias("y")).orderBy("x")


def icc_bars(icc: DataFrame) -> DataFrame:
    """label, value: a bar for each kind of agreement."""
    return icc.select(F.col("Type").alias("label"), F.col("ICC").alias("value")).orderBy("label")


def scatter_table(df: DataFrame, x: str, y: str, most: int = 5000, seed: int = 42) -> DataFrame:
    """x, y of `most` rows, those with the least hashes: a sample, as a chart can't show all."""
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).na.drop()
    return rows.orderBy(F.xxhash64(F.lit(seed), "x", "y"), "x", "y").limit(most)


def violin_table(df: DataFrame, value: str, group: str, bins: int = 30) -> DataFrame:
    """group, low, high, n, share: a histogram for each group, over the bins of all rows."""
    s = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    if s["a"] is None:
        return df.sparkSession.createDataFrame([], "group string, low double, high double, n bigint, share double")
    low, width = float(s["a"]), (float(s["b"]) - float(s["a"])) / bins or 1.0
    k = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).alias("k")
    n = df.where(F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("group"), k).agg(F.count("*").alias("n"))
    whole = n.groupBy("group").agg(F.sum("n").alias("_all"))
    out = n.join(whole, n["group"].eqNullSafe(whole["group"])).drop(whole["group"])
    return out.select("group", (low + F.col("k") * width).alias("low"), (low + (F.col("k") + 1) * width).alias("high"), "n", (F.col("n") / F.col("_all")).alias("share"))


def to_svg(table: DataFrame, x: str, y: str, kind: str = "line", width: int = 640, height: int = 320, most: int = 5000) -> str:
    """A chart table drawn as SVG: 'line', 'scatter' or 'bar' (x: labels). `most` rows at most, as a report."""
    from html import escape

    if kind not in ("line", "scatter", "bar"):
        raise ValueError(f"unknown chart: {kind}")
    rows = [r for r in table.select(x, y).limit(most).collect() if r[0] is not None and r[1] is not None]
    ys = [float(r[1]) for r in rows] or [0.0]
    xs = [float(k) if kind == "bar" else float(r[0].timestamp() if hasattr(r[0], "timestamp") else r[0]) for k, r in enumerate(rows)] or [0.0]
    low, high = min([*ys, 0.0] if kind == "bar" else ys), max([*ys, 0.0] if kind == "bar" else ys)

    def place(v: float, a: float, b: float, size: int) -> float:
        return round(30 + (v - a) / ((b - a) or 1.0) * (size - 60), 2)

    points = [(place(a, min(xs), max(xs), width), height - place(b, low, high, height)) for a, b in zip(xs, ys, strict=True)] if rows else []
    if kind == "line":
        body = f'<polyline fill="none" stroke="black" points="{" ".join(f"{a},{b}" for a, b in points)}"/>'
    elif kind == "scatter":
        body = "".join(f'<circle cx="{a}" cy="{b}" r="2"/>' for a, b in points)
    else:
        zero, wide = height - place(0.0, low, high, height), max(1.0, (width - 60) / max(1, len(points)) * 0.7)
        body = "".join(f'<rect x="{a - wide / 2}" y="{min(b, zero)}" width="{wide}" height="{abs(zero - b)}"><title>{escape(str(r[0]))}</title></rect>' for (a, b), r in zip(points, rows, strict=True))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{body}<text x="30" y="{height - 8}">{escape(x)}</text><text x="4" y="16">{escape(y)}</text></svg>'


def save_chart(table: DataFrame, title: str, path: str, x: str, y: str, kind: str = "line") -> None:
    """The chart and its table as one HTML page."""
    from html import escape
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(f"<!DOCTYPE html><title>{escape(title)}</title>{to_svg(table, x, y, kind)}{to_html(table, title)}")


def to_html(table: DataFrame, title: str, most: int = 1000) -> str:
    """A chart table as a small HTML page; `most` rows at most, as a report."""
    from html import escape

    rows = table.limit(most).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in table.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><title>{escape(title)}</title><table><caption>{escape(title)}</caption><tr>{head}</tr>{body}</table>"


def save_html(table: DataFrame, title: str, path: str) -> None:
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(to_html(table, title))


def summary(results: Mapping[str, ProbeResult]) -> list[tuple[str, str]]:
    return [(k, v.title) for k, v in sorted(results.items())]
