"""Column transforms: fitted by a few aggregates, applied as expressions. Time-like ones join rows on their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keys import lagged, row_index
from tidemark.operators.quantiles import exact_quantiles


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact linear quantiles of one column; a handful of numbers."""
    return exact_quantiles(df, column, [float(s) for s in shares])


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns]).first()
    return {c: (float(row[c][0]), float(row[c][1])) for c in columns}


def z(column: str, mean: float, sd: float):
    return (F.col(column) - mean) / (sd + 1e-12)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null and non-finite values become the column's median, and 0 where there is none."""
    clean = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c).cast("double")) for c in columns}
    middle = df.agg(*[F.percentile(clean[c], 0.5).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(clean[c], F.lit(float(middle[c] or 0.0))) for c in columns})


def tf_quantize(df: DataFrame, column: str, levels: int = 15) -> DataFrame:
    """Clipped to the 0.5% and 99.5% quantiles and rounded (half to even) to equal steps."""
    low, high = quantiles(df, column, [0.005, 0.995])
    width = max(high - low, 1e-12)
    inside = F.greatest(F.lit(low), F.least(F.lit(high), F.col(column)))
    return df.withColumn("out", F.bround((inside - low) / width * levels) / levels * width + low)


def tf_rank(df: DataFrame, column: str, edges: int = 64) -> DataFrame:
    """The share of `edges` interior quantiles below the value."""
    found = quantiles(df, column, [(i + 1) / (edges + 1) for i in range(edges)])
    return df.withColumn("out", F.size(F.filter(F.array(*map(F.lit, found)), lambda e: e < F.col(column))) / F.lit(float(edges + 1)))


def tf_sign(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("out", F.signum(F.col(column) - quantiles(df, column, [0.5])[0]))


def tf_prism(df: DataFrame, column: str) -> DataFrame:
    """The value, its part up to the lower third, its part from the upper third on."""
    low, high = quantiles(df, column, [1 / 3, 2 / 3])
    x = F.col(column)
    return df.withColumns({"all": x, "low": F.when(x <= low, x).otherwise(0.0), "high": F.when(x >= high, x).otherwise(0.0)})


def tf_moire(df: DataFrame, columns: list[str]) -> DataFrame:
    """z and z times the row's mean |z|."""
    m = moments(df, columns)
    zs = {c: z(c, *m[c]) for c in columns}
    mean = sum((F.abs(v) for v in zs.values()), F.lit(0.0)) / len(columns)
    return df.withColumns({f"z_{c}": v for c, v in zs.items()} | {f"m_{c}": v * mean for c, v in zs.items()})


def tf_doppler(df: DataFrame, column: str) -> DataFrame:
    """The first difference, 0 in the first row."""
    return lagged(df, [column]).withColumn("out", F.coalesce(F.col(column) - F.col(f"{column}_lag"), F.lit(0.0))).drop(f"{column}_lag")


def tf_curvature(df: DataFrame, column: str) -> DataFrame:
    """The second difference, 0 in the first two rows."""
    two = lagged(lagged(df, [column], 1, "_1"), [column], 2, "_2")
    return two.withColumn("out", F.coalesce(F.col(column) - 2 * F.col(f"{column}_1") + F.col(f"{column}_2"), F.lit(0.0))).drop(f"{column}_1", f"{column}_2")


def ema(df: DataFrame, column: str, span: int, name: str = "ema", block: int = 64) -> DataFrame:
    """The unadjusted exponential mean by row number, started at the first value.

    Rows are cut into blocks. Inside a block a window gives its own part; what comes from before is the sum of
    the blocks' last parts, decayed by their distance. Parts whose decay is below 1e-18 are lost to rounding in any case
    and not sent, so each block hears from a fixed number of blocks and no task sees all rows.
    """
    import math

    from pyspark.sql import Window as W

    keep = 1 - 2 / (span + 1)
    reach = max(1, math.ceil(math.log(1e-18) / (block * math.log(keep))))
    rows = df.withColumn("_b", F.floor(F.col("row_idx") / block)).withColumn("_t", (F.col("row_idx") % block).cast("int"))
    weight = F.when(F.col("row_idx") == 0, 1.0).otherwise(1 - keep)
    inside = W.partitionBy("_b").orderBy("_t").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_own", F.sum(weight * F.col(column) * F.pow(F.lit(keep), -F.col("_t"))).over(inside) * F.pow(F.lit(keep), F.col("_t")))
    last = rows.filter(F.col("_t") == block - 1).select("_b", "_own")
    heard = last.select(F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_d"), "_b", "_own")
    heard = heard.groupBy((F.col("_b") + F.col("_d")).alias("_b")).agg(F.sum(F.col("_own") * F.pow(F.lit(keep), block * (F.col("_d") - 1))).alias("_before"))
    out = rows.join(heard, "_b", "left")
    return out.withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_t") + 1)).drop("_b", "_t", "_own", "_before")


def tf_tide(df: DataFrame, column: str, span: int = 64) -> DataFrame:
    return ema(df, column, span).withColumn("out", F.col(column) - F.col("ema")).drop("ema")


def tf_reaction_diffusion(df: DataFrame, column: str) -> DataFrame:
    return ema(ema(df, column, 4, "_fast"), column, 32, "_slow").withColumn("out", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")


#: Fixed definitions: order-book feature, as SQL over bid, ask, buy, sell, vol (doubles) and a small eps.
MARKET = {
    "mkt_spread_proxy": "ask - bid",
    "mkt_total_depth": "bid + ask",
    "mkt_net_flow": "buy - sell",
    "mkt_total_trades": "buy + sell",
    "mkt_vol_per_trade": "vol / (buy + sell + eps)",
    "mkt_buy_ratio": "buy / (buy + sell + eps)",
    "mkt_order_imbalance": "(bid - ask) / (bid + ask + eps)",
    "mkt_flow_imbalance": "(buy - sell) / (buy + sell + eps)",
    "mkt_kyle_lambda": "abs(buy - sell) / (vol + eps)",
    "mkt_depth_depletion": "vol / (bid + ask + eps)",
    "mkt_fill_probability": "vol / (buy + sell + eps)",
    "mkt_log_volume": "ln(1 + vol)",
    "mkt_log_depth": "ln(1 + bid + ask)",
    "mkt_stress": "vol / (bid + ask + eps) * abs(buy - sell) / (buy + sell + eps)",
    "mkt_signed_volume": "sign(buy - sell) * vol",
}


def market_features(df: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Adds the order-book features of bid_qty, ask_qty, buy_qty, sell_qty and volume; what is not finite becomes 0."""
    names = {"bid": "bid_qty", "ask": "ask_qty", "buy": "buy_qty", "sell": "sell_qty", "vol": "volume"}
    wide = df.withColumns({k: F.col(c).cast("double") for k, c in names.items()} | {"eps": F.lit(eps)})
    fine = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), 0.0).otherwise(c)
    return wide.withColumns({k: fine(F.expr(e)) for k, e in MARKET.items()}).drop("eps", *names)


def joint_codes(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 0 over the sorted distinct strings of both tables; null becomes 'None'."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")
    every = train.select(text).unionByName(test.select(text)).distinct()
    return row_index(every, "value").select("value", F.col("row_idx").cast("int").alias("code"))
