"""Regimes of rows from features alone: gauges, terrains, altitudes, and landmarks with their fields.

Terrains are k-means by Spark aggregations: a round groups the rows by the nearest centre and averages; the driver holds the centres. Starts
are the rows with the smallest hashes of a key, so the same table gives the same map.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pearson
from tidemark.operators.moments import moments
from tidemark.operators.quantiles import exact_quantiles, exact_quantiles_of

# The market columns that pressure is read from.
PRESSURE = ("mkt_order_imbalance", "mkt_flow_imbalance", "mkt_kyle_lambda", "mkt_depth_depletion", "mkt_stress", "mkt_signed_volume", "mkt_buy_ratio", "mkt_vol_per_trade")
#: Distances are compared after rounding, so that ties do not hang on the order of a sum.
DIGITS = 9


def widest(df: DataFrame, columns: list[str], n: int) -> list[str]:
    """The n columns with the largest variance, widest first; ties by order."""
    var = moments(df, columns).sd ** 2
    return [columns[i] for i in sorted(range(len(columns)), key=lambda i: (-var[i], i))[:n]]


def named_and_widest(df: DataFrame, columns: list[str], named: int, wide: int, fill: int | None = None) -> list[str]:
    """Up to `named` columns that are not anonymous (`X...`), then the widest anonymous ones: `wide` of them, or as many as fill up to `fill`; the first columns if there are none."""
    own = [c for c in columns if not c.startswith("X")][:named]
    more = max(0, fill - len(own)) if fill is not None else wide
    anonymous = [c for c in columns if c.startswith("X")]
    return own + (widest(df, anonymous, more) if anonymous and more else []) or columns[: fill or wide]


def gauge_state(df: DataFrame, columns: list[str], states: int, name: str) -> DataFrame:
    """Adds the column `name`: the mean |z| of the columns, cut at its own quantiles into states 0 (calm) and up; an edge belongs to the lower state."""
    m = moments(df, columns)
    value = sum((F.abs((F.col(c) - float(a)) / (float(s) + 1e-6)) for c, a, s in zip(columns, m.mean, m.sd)), F.lit(0.0)) / len(columns)
    out = df.withColumn(name, value)
    edges = exact_quantiles(out, name, [i / states for i in range(1, states)])
    return out.withColumn(name, sum((F.when(F.col(name) > e, 1).otherwise(0) for e in edges), F.lit(0)))


def pressure_state(df: DataFrame, columns: list[str], states: int = 3, name: str = "pressure") -> DataFrame:
    """Stress of the market columns; without any, that of the eight widest columns."""
    some = [c for c in PRESSURE if c in columns] or widest(df, columns, 8)
    return gauge_state(df, some, states, name)


@dataclass
class TerrainMap:
    """Columns in deviations from their mean, and the centres in those."""

    columns: list[str]
    mean: np.ndarray
    sd: np.ndarray
    centres: np.ndarray

    def z(self) -> list[Column]:
        return [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.sd)]

    def distances(self, points: np.ndarray | None = None) -> Column:
        """An array of squared distances to the centres (or other points)."""
        at = self.z()
        return F.array(*[F.round(sum((F.pow(x - float(v), 2) for x, v in zip(at, p)), F.lit(0.0)), DIGITS) for p in (self.centres if points is None else points)])

    def assign(self) -> Column:
        d = self.distances()
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    def altitude(self) -> Column:
        return F.sqrt(F.array_min(self.distances()))


def lloyd(df: DataFrame, space: TerrainMap, k: int, rounds: int, key: str, close: float = 1e-9) -> np.ndarray:
    """Centres of k-means over the rows of df in the map's space."""
    z = space.z()
    names = [f"_z{i}" for i in range(len(z))]
    rows = df.select(F.md5(F.col(key).cast("string")).alias("_h"), *[v.alias(n) for v, n in zip(z, names)])
    starts = rows.orderBy("_h", *names).limit(k).collect()
    centres = np.array([[r[n] for n in names] for r in starts], float)
    plain = TerrainMap(names, np.zeros(len(names)), np.ones(len(names)), centres)
    for _ in range(rounds):
        got = rows.withColumn("_c", plain.assign()).groupBy("_c").agg(*[F.avg(n).alias(n) for n in names]).collect()
        new = plain.centres.copy()
        for r in got:
            if r["_c"] is not None:
                new[r["_c"]] = [r[n] for n in names]
        moved = float(np.abs(new - plain.centres).max(initial=0))
        plain.centres = new
        if moved < close:
            break
    return plain.centres


def terrain_map(df: DataFrame, columns: list[str], key: str, k: int = 6, rounds: int = 50) -> TerrainMap:
    """k-means of the standardised columns; fewer centres than k if there are fewer rows."""
    m = moments(df, columns)
    space = TerrainMap(list(columns), m.mean, m.sd + 1e-6, np.zeros((0, len(columns))))
    space.centres = lloyd(df, space, k, rounds, key)
    return space


def with_terrain(df: DataFrame, space: TerrainMap) -> DataFrame:
    """Adds `terrain` and `altitude`, the distance to the terrain's centre."""
    return df.withColumns({"terrain": space.assign(), "altitude": space.altitude()})


def terrain_report(df: DataFrame) -> DataFrame:
    """(terrain, n, share, mean_altitude, max_altitude)."""
    every = df.agg(F.count("*").alias("_all"))
    g = df.groupBy("terrain").agg(F.count("*").alias("n"), F.avg("altitude").alias("mean_altitude"), F.max("altitude").alias("max_altitude"))
    return g.join(F.broadcast(every)).select("terrain", "n", (F.col("n") / F.col("_all")).alias("share"), "mean_altitude", "max_altitude")


@dataclass
class Beacons:
    """Landmarks in a terrain map's space: their places, kinds and reach."""

    space: TerrainMap
    places: np.ndarray
    kinds: list[str]
    reach: list[float] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [f"beacon_{i}_{k}" for i, k in enumerate(self.kinds)]

    def field(self) -> list[Column]:
        d = self.space.distances(self.places)
        return [F.exp(-d[i] / (2 * r * r)) for i, r in enumerate(self.reach)]


def beacon_fit(df: DataFrame, space: TerrainMap, key: str, *, rare: float = 0.06, peaks: int = 6, most: int = 12, tail: float = 0.97, bandwidth: float = 1.0, rounds: int = 50) -> Beacons:
    """Landmarks: the centroids of terrains with less than `rare` of the rows, and `peaks` centres of the rows whose altitude reaches the quantile `tail`.

    A tail of fewer than five rows a peak has none; without any landmark the highest row is one. A landmark reaches as far as the
    median distance of all rows from it. The tail is a filter by its edge; only centres and medians come to the driver.
    """
    rows = with_terrain(df, space)
    z = {f"_z{i}": c for i, c in enumerate(space.z())}
    sizes = rows.withColumns(z).groupBy("terrain").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in z]).orderBy("terrain").collect()  # k rows
    n = sum(r["n"] for r in sizes)
    places = [[r[c] for c in z] for r in sizes if r["n"] < rare * n]
    kinds = ["rare"] * len(places)
    edge = exact_quantiles(rows, "altitude", [tail])[0]
    high = rows.filter(F.col("altitude") >= edge)
    room = min(peaks, most - len(places))
    if room > 0 and high.count() >= 5 * peaks:
        found = lloyd(high, space, room, rounds, key)
        places += found.tolist()
        kinds += ["novelty"] * len(found)
    if not places:
        top = rows.withColumns(z).orderBy(F.desc("altitude"), key).select(*z).first()
        places, kinds = [list(top)], ["novelty"]
    out = Beacons(space, np.array(places[:most], float), kinds[:most])
    d = space.distances(out.places)
    far = {f"d{i}": F.sqrt(d[i]) for i in range(len(out.kinds))}
    middle = exact_quantiles_of(df.select(*[v.alias(n) for n, v in far.items()]), {n: [0.5] for n in far})
    out.reach = [max(1e-3, middle[n][0] * bandwidth) for n in far]
    return out


def beacon_field(df: DataFrame, beacons: Beacons) -> DataFrame:
    """Adds a column per landmark, exp(-d^2 / 2 reach^2), and `basin`, the landmark whose field is strongest (ties: the first)."""
    out = df.withColumns(dict(zip(beacons.names, beacons.field())))
    every = F.array(*[F.round(F.col(f"`{n}`"), DIGITS) for n in beacons.names])
    return out.withColumn("basin", (F.array_position(every, F.array_max(every)) - 1).cast("int"))


def beacon_report(df: DataFrame, beacons: Beacons, y: str) -> DataFrame:
    """(beacon, kind, reach, basin_rows, mean_field, corr): one scan over the rows of `beacon_field`."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("beacon"), F.lit(k).alias("kind"), F.lit(float(r)).alias("reach"), F.col(f"_n{i}").alias("basin_rows"), F.col(f"_m{i}").alias("mean_field"), F.col(f"_c{i}").alias("corr"))
        for i, (k, r) in enumerate(zip(beacons.kinds, beacons.reach))
    ])
    stats = [x for i, n in enumerate(beacons.names) for x in (F.count_if(F.col("basin") == i).alias(f"_n{i}"), F.avg(n).alias(f"_m{i}"), pearson(n, y).alias(f"_c{i}"))]
    return df.agg(*stats).select(F.explode(rows).alias("r")).select("r.*")
