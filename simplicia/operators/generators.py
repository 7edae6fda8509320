"""Clouds and series by generation, for experiments and tests: every point from a seeded row of spark.range, every
recursive series in a task of its own."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAU = 2 * math.pi


def _base(spark: SparkSession, n: int, clouds: int, seed: int) -> DataFrame:
    df = spark.range(clouds * n).select(F.floor(F.col("id") / n).alias("cloud"), F.pmod("id", F.lit(n)).alias("i"))
    return df.select("*", *(F.rand(seed + k).alias(f"u{k}") for k in range(4)), *(F.randn(seed + 10 + k).alias(f"z{k}") for k in range(3)))


def _points(df: DataFrame, x: Column, y: Column, z: Column, noise: float) -> DataFrame:
    return df.select("cloud", "i", *((c + noise * F.col(f"z{k}")).alias(f"x{k}") for k, c in enumerate((x, y, z))))


def circle(spark: SparkSession, n: int, radius: float = 1.0, noise: float = 0.05, clouds: int = 1, seed: int = 0) -> DataFrame:
    a = TAU * F.col("u0")
    return _points(_base(spark, n, clouds, seed), radius * F.cos(a), radius * F.sin(a), F.lit(0.0), noise)


def disk(spark: SparkSession, n: int, radius: float = 1.0, noise: float = 0.0, clouds: int = 1, seed: int = 0) -> DataFrame:
    """Uniform by area."""
    a, r = TAU * F.col("u0"), radius * F.sqrt("u1")
    return _points(_base(spark, n, clouds, seed), r * F.cos(a), r * F.sin(a), F.lit(0.0), noise)


def torus(spark: SparkSession, n: int, big: float = 2.0, small: float = 1.0, noise: float = 0.0, clouds: int = 1, seed: int = 0) -> DataFrame:
    """Uniform in the two angles, not by area."""
    a, b = TAU * F.col("u0"), TAU * F.col("u1")
    ring = big + small * F.cos(b)
    return _points(_base(spark, n, clouds, seed), ring * F.cos(a), ring * F.sin(a), small * F.sin(b), noise)


def sphere(spark: SparkSession, n: int, radius: float = 1.0, noise: float = 0.0, clouds: int = 1, seed: int = 0) -> DataFrame:
    """Uniform by area."""
    a, h = TAU * F.col("u0"), 2 * F.col("u1") - 1
    r = radius * F.sqrt(1 - h * h)
    return _points(_base(spark, n, clouds, seed), r * F.cos(a), r * F.sin(a), radius * h, noise)


def porous_block(spark: SparkSession, n: int, cavities: int = 3, box: float = 2.0, radius: float = 0.4, noise: float = 0.0, clouds: int = 1, seed: int = 0, tries: int = 6) -> DataFrame:
    """A cube without some balls: `tries` times as many points as needed are drawn and the first n outside kept, so
    a cloud may be smaller where the balls leave little room."""
    centre = lambda k, d: (F.rand(0) * 0 + F.lit((math.sin(12.9898 * (k + 1) + 78.233 * d + seed) * 43758.5453) % 1.0) * box)
    df = _base(spark, n * tries, clouds, seed)
    p = [box * F.col(f"u{d}") for d in range(3)]
    outside = F.lit(True)
    for k in range(cavities):
        outside = outside & (sum(((p[d] - centre(k, d)) ** 2 for d in range(3)), start=F.lit(0.0)) > radius * radius)
    kept = df.filter(outside)
    from pyspark.sql import Window

    first = kept.withColumn("r", F.row_number().over(Window.partitionBy("cloud").orderBy("i"))).filter(F.col("r") <= n).withColumn("i", F.col("r") - 1)
    return _points(first, *p, noise)


def double_helix(spark: SparkSession, n: int, turns: float = 3.0, radius: float = 1.0, pitch: float = 1.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Two strands of n points each, half a turn apart."""
    df = _base(spark, 2 * n, 1, seed)
    t = F.pmod("i", F.lit(n)) / n * TAU * turns
    a = t + F.floor(F.col("i") / n) * math.pi
    return _points(df, radius * F.cos(a), radius * F.sin(a), pitch * t / TAU, noise)


def jet(spark: SparkSession, kind: str, n: int = 50, clouds: int = 1, seed: int = 0) -> DataFrame:
    """Particles of a jet: exponential momenta and Gaussian angles, wider for gluons than for quarks."""
    mean, width = {"quark": (0.3, 0.3), "gluon": (0.5, 0.6)}[kind]
    df = _base(spark, n, clouds, seed)
    return df.select("cloud", "i", (width * F.col("z0")).alias("x0"), (width * F.col("z1")).alias("x1"), (-mean * F.ln(1 - F.col("u0"))).alias("x2"))


def periodic(spark: SparkSession, n: int = 2000, quasi: bool = False) -> DataFrame:
    t = 20.0 * F.col("id") / n
    x = F.sin(TAU * 0.5 * t) + (F.sin(TAU * 0.5 * math.sqrt(2) * t) if quasi else 0.5 * F.sin(TAU * t))
    return spark.range(n).select(F.col("id").alias("i"), x.alias("x"))


def structure(kind: str, phase: Column) -> Column:
    """Wave of a phase in turns, before standardising: sawtooth, pulse (an eighth on), square, sine."""
    p = phase - F.floor(phase)
    return {"saw": 2 * p - 1, "pulse": (p < 0.12).cast("double"), "square": F.when(p < 0.5, 1.0).otherwise(-1.0), "sine": F.sin(TAU * p)}[kind]


def simulated(spark: SparkSession, kind: str, n: int, series: int = 1, seed: int = 0, phi: float = 0.8, dt: float = 0.01, mu: float = 0.2, alpha: float = 0.5, beta: float = 1.0) -> DataFrame:
    """series, i, x of recursive processes, one task each: ar1, rossler, lorenz (explicit Euler), hawkes (intensity of
    a self-exciting process by thinning, smoothed over five steps)."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for s in f["id"]:
                rng = np.random.default_rng([seed, int(s)])
                x = np.empty(n)
                if kind == "ar1":
                    v = 0.0
                    for k in range(n):
                        v = phi * v + rng.normal()
                        x[k] = v
                elif kind in ("rossler", "lorenz"):
                    p = rng.normal(1.0, 0.1, 3)
                    for k in range(n):
                        a, b, c = p
                        d = (-b - c, a + 0.2 * b, 0.2 + c * (a - 5.7)) if kind == "rossler" else (10 * (b - a), a * (28 - c) - b, a * b - 8 / 3 * c)
                        p = p + dt * np.array(d)
                        x[k] = p[0]
                elif kind == "hawkes":
                    excess, t, steps = 0.0, 0.0, np.full(n, mu)
                    while t < n:
                        bound = mu + excess
                        wait = rng.exponential(1 / bound)
                        first, t = int(t) + 1, t + wait
                        for k in range(first, min(int(t) + 1, n)):
                            steps[k] = mu + excess * math.exp(-beta * (k - (t - wait)))
                        excess *= math.exp(-beta * wait)
                        if t < n and rng.uniform() * bound <= mu + excess:
                            excess += alpha
                    x = np.convolve(steps, np.ones(5) / 5, "same")
                yield pd.DataFrame({"series": s, "i": np.arange(n), "x": x})

    return spark.range(0, series, 1, max(1, min(series, 64))).mapInPandas(run, "series long, i long, x double")


def standardised_structure(df: DataFrame, kind: str, period: float) -> DataFrame:
    """Adds s: the structure's wave along i with zero mean and unit sd."""
    raw = df.withColumn("s", structure(kind, F.col("i") / period))
    m = raw.agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d"))
    return raw.join(F.broadcast(m)).withColumn("s", (F.col("s") - F.col("m")) / F.when(F.col("d") > 0, F.col("d")).otherwise(1.0)).drop("m", "d")


def embedded_signal(background: DataFrame, kind: str, snr: float, period: float = 32.0, mode: str = "add") -> DataFrame:
    """A structure inside a background x: added at snr times its sd, or modulating it; `none` leaves it alone."""
    df = standardised_structure(background, kind, period)
    sd = background.groupBy("series").agg(F.stddev_pop("x").alias("sd"))
    wave = {"add": F.col("x") + snr * F.col("sd") * F.col("s"), "mult": F.col("x") * (1 + snr * F.col("s")), "none": F.col("x")}[mode]
    return df.join(sd, "series").select("series", "i", wave.alias("x"))


def with_noise(cloud: DataFrame, key: str, coordinates: list[str], level: float, seed: int) -> DataFrame:
    """Gaussian noise of a share of the mean extent of each cloud's box."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    extent = sum((F.max(c).over(w) - F.min(c).over(w) for c in coordinates), start=F.lit(0.0)) / len(coordinates)
    scaled = cloud.withColumn("_e", extent)
    return scaled.withColumns({c: F.col(c) + level * F.col("_e") * F.randn(seed + k) for k, c in enumerate(coordinates)}).drop("_e")


def rotated(cloud: DataFrame, coordinates: list[str], seed: int) -> DataFrame:
    """A random rotation, the same for all points; seed 0 is the identity."""
    import numpy as np

    d = len(coordinates)
    q = np.eye(d)
    if seed:
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
        q = q * np.sign(np.diag(r))
        if np.linalg.det(q) < 0:
            q[:, 0] = -q[:, 0]
    return cloud.withColumns({c: sum((float(q[k, j]) * F.col(x) for j, x in enumerate(coordinates)), start=F.lit(0.0)) for k, c in enumerate(coordinates)})
