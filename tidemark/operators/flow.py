"""Order flow, liquidations and book depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio
from tidemark.operators.stats import cumulated
from tidemark.operators.zones import clusters


def taker_flow(trades: DataFrame) -> DataFrame:
    """Per symbol: notional bought and sold, delta and its share, count."""
    money = F.col("price") * F.col("qty")
    out = trades.groupBy("symbol").agg(F.sum(F.when(F.col("is_buy"), money).otherwise(0.0)).alias("buy"), F.sum(F.when(~F.col("is_buy"), money).otherwise(0.0)).alias("sell"), F.count("*").alias("n"))
    return out.withColumns({"delta": F.col("buy") - F.col("sell"), "delta_ratio": ratio(F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell"))})


def trailing(trades: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Trades in (now - seconds, now]."""
    return trades.where((F.unix_micros("ts") > F.unix_micros(now) - seconds * 1_000_000) & (F.unix_micros("ts") <= F.unix_micros(now)))


def window_change(trades: DataFrame) -> DataFrame:
    """Percent from the first to the last trade of each symbol that has two."""
    order = F.struct("ts", "trade_id")
    out = trades.groupBy("symbol").agg(F.min_by("price", order).alias("first"), F.max_by("price", order).alias("last"), F.count("*").alias("n"))
    return out.where("n >= 2").select("symbol", (100 * (ratio("last", "first") - 1)).alias("change_pct"), "n")


def footprint(trades: DataFrame, buckets: int = 20, reach: float = 0.05) -> DataFrame:
    """symbol, bucket, buy, sell around each symbol's last price, `reach` either way."""
    last = trades.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "trade_id")).alias("ref"))
    low = F.col("ref") * (1 - reach)
    size = F.col("ref") * (2 * reach) / buckets
    money = F.col("price") * F.col("qty")
    near = trades.join(last, "symbol").where(F.abs(F.col("price") / F.col("ref") - 1) <= reach).withColumn("bucket", F.least(F.floor((F.col("price") - low) / size), F.lit(buckets - 1)).cast("int"))
    return near.groupBy("symbol", "bucket").agg(F.sum(F.when(F.col("is_buy"), money).otherwise(0.0)).alias("buy"), F.sum(F.when(~F.col("is_buy"), money).otherwise(0.0)).alias("sell"))


def stacked_imbalance(bins: DataFrame, least: int = 3) -> DataFrame:
    """symbol, side, first, n of each run of at least `least` neighbouring bins with one sign of buy - sell."""
    signed = bins.withColumn("side", F.signum(F.col("buy") - F.col("sell")).cast("int")).where("side <> 0")
    island = F.col("bucket") - F.row_number().over(W.partitionBy("symbol", "side").orderBy("bucket"))
    return signed.withColumn("g", island).groupBy("symbol", "side", "g").agg(F.min("bucket").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least).drop("g")


def liquidation_notional(events: DataFrame) -> DataFrame:
    """Per symbol, notional liquidated of longs (sell orders) and shorts (buy orders)."""
    money = F.col("qty") * F.col("price")
    return events.groupBy("symbol").agg(F.sum(F.when(F.col("side") == "SELL", money).otherwise(0.0)).alias("longs"), F.sum(F.when(F.col("side") == "BUY", money).otherwise(0.0)).alias("shorts"))


def forward_liquidations(oi_bars: DataFrame, tiers: dict[int, float], maintenance: float = 0.005, buckets: int = 48, reach: float = 0.12) -> DataFrame:
    """symbol, bucket, longs, shorts: where positions opened on rising open interest would be liquidated.

    oi_bars: symbol, ts, close, oi. Each rise is split over leverage tiers (weights) and both sides.
    """
    w = W.partitionBy("symbol").orderBy("ts")
    last = oi_bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("ref"))
    rises = oi_bars.withColumn("rise", F.col("oi") - F.lag("oi").over(w)).where("rise > 0").join(last, "symbol")
    total = float(sum(tiers.values()))
    plan = F.array(*[F.struct(F.lit(1.0 / t).alias("margin"), F.lit(x / total / 2).alias("weight"), F.lit(s).alias("sign")) for t, x in tiers.items() for s in (1, -1)])
    parts = rises.select("symbol", "ref", "close", "rise", F.explode(plan).alias("t"))
    price = F.col("close") * (1 - F.col("t.sign") * (F.col("t.margin") - maintenance))
    low, size = F.col("ref") * (1 - reach), F.col("ref") * 2 * reach / buckets
    placed = parts.withColumns({"bucket": F.floor((price - low) / size).cast("int"), "money": F.col("rise") * F.col("t.weight") * F.col("close")}).where((F.col("bucket") >= 0) & (F.col("bucket") < buckets))
    side = lambda s: F.sum(F.when(F.col("t.sign") == s, F.col("money")).otherwise(0.0))
    return placed.groupBy("symbol", "bucket").agg(side(1).alias("longs"), side(-1).alias("shorts"))


def swept(zones: DataFrame, low: Column, high: Column, price: Column, keep: float = 0.35) -> DataFrame:
    """Zones inside the traded range keep a part of their size."""
    inside = price.between(low, high)
    return zones.withColumns({c: F.when(inside, F.col(c) * keep).otherwise(F.col(c)) for c in ("longs", "shorts")})


def depth_imbalance(bids: Column, asks: Column, n: int = 20) -> Column:
    """(bid - ask) / (bid + ask) notional of the first n levels of arrays of (price, qty)."""
    money = lambda side: F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda s, x: s + x["price"] * x["qty"])
    return ratio(money(bids) - money(asks), money(bids) + money(asks))


def microprice_bias(bid: Column, ask: Column, bid_qty: Column, ask_qty: Column) -> Column:
    """Size-weighted price less the middle, in half spreads."""
    micro = ratio(bid * ask_qty + ask * bid_qty, bid_qty + ask_qty)
    return ratio(micro - (bid + ask) / 2, (ask - bid) / 2)


def book_from_levels(levels: DataFrame, key: str, depth: int) -> DataFrame:
    """key, bids, asks: arrays of the `depth` best (price, qty) of each side. levels: key, side, price, qty."""
    sign = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    place = F.row_number().over(W.partitionBy(key, "side").orderBy(sign, "qty"))
    best = levels.withColumn("n", place).where(F.col("n") <= depth)
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("n", "price", "qty")))), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    return best.groupBy(key).agg(side("bid").alias("bids"), side("ask").alias("asks"))


def top_walls(levels: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n levels of most notional on each side."""
    money = F.col("price") * F.col("qty")
    place = F.row_number().over(W.partitionBy(key, "side").orderBy(F.desc(money), "price"))
    return levels.withColumn("rank", place).where(F.col("rank") <= n).select(key, "side", "rank", "price", money.alias("notional"))


def depth_bins(levels: DataFrame, key: str, width: float) -> DataFrame:
    """Notional by price bin and its share of the key's fullest bin."""
    binned = levels.groupBy(key, "side", F.floor(F.col("price") / width).cast("long").alias("bin")).agg(F.sum(F.col("price") * F.col("qty")).alias("notional"))
    return binned.withColumn("intensity", ratio("notional", F.max("notional").over(W.partitionBy(key))))


def _price_bucket(buckets: int, reach: float) -> Column:
    """Of a row with price and ref: its bucket over ref +- reach, NULL outside."""
    low = F.col("ref") * (1 - reach)
    at = F.floor((F.col("price") - low) / (F.col("ref") * 2 * reach / buckets))
    return F.when((F.col("ref") > 0) & F.col("price").between(low, F.col("ref") * (1 + reach)), F.least(at, F.lit(buckets - 1))).cast("int")


def depth_voids(levels: DataFrame, prices: DataFrame, buckets: int = 20, reach: float = 0.05, share: float = 0.2, n: int = 5, scale: float = 1.0) -> DataFrame:
    """symbol, bucket, price, depth, distance_pct: the n nearest buckets that hold no more than (scale times) the level at a share of all levels' sizes.

    levels: symbol, price, qty; prices: symbol, ref. The level at the share is the one of place int(share x count), from 1, at least the first.
    """
    money = F.col("price") * F.col("qty")
    near = levels.join(prices, "symbol").withColumns({"bucket": _price_bucket(buckets, reach), "money": money}).where("bucket IS NOT NULL")
    ranked = cumulated(near, "symbol", "money")
    at = F.greatest(F.floor(F.col("total") * share), F.lit(1)) - 1
    cut = ranked.groupBy("symbol").agg(F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("n")), F.col("money"))).alias("cut"))
    depth = near.groupBy("symbol", "bucket", "ref").agg(F.sum("money").alias("depth")).join(cut, "symbol").where(F.col("depth") <= F.col("cut") * scale)
    centre = F.col("ref") * (1 - reach) + (F.col("bucket") + 0.5) * (F.col("ref") * 2 * reach / buckets)
    out = depth.withColumn("price", centre).withColumn("distance_pct", F.abs(F.col("price") / F.col("ref") - 1) * 100)
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.round("distance_pct", 9), "bucket"))
    return out.withColumn("rank", place).where(F.col("rank") <= n).select("symbol", "rank", "bucket", "price", "depth", "distance_pct")


def depth_matrix(history: DataFrame, prices: DataFrame, buckets: int = 20, reach: float = 0.05, samples: int = 12) -> DataFrame:
    """symbol, sample, bucket, notional of the newest samples of a book's history (symbol, sample, price, qty)."""
    place = F.dense_rank().over(W.partitionBy("symbol").orderBy(F.desc("sample")))
    kept = history.select("symbol", "sample").distinct().withColumn("__n", place).where(F.col("__n") <= samples).drop("__n")
    binned = history.where("price > 0 AND qty > 0").join(prices, "symbol").withColumn("bucket", _price_bucket(buckets, reach)).where("bucket IS NOT NULL")
    return binned.groupBy("symbol", "sample", "bucket").agg(F.sum(F.col("price") * F.col("qty")).alias("notional")).join(kept, ["symbol", "sample"], "left_semi")


def venue_walls(levels: DataFrame, digits: int = 4) -> DataFrame:
    """Walls of several venues merged by rounded price, with the venues that show them."""
    return levels.groupBy("symbol", "side", F.round("price", digits).alias("price")).agg(F.sum(F.col("price") * F.col("qty")).alias("notional"), F.array_sort(F.collect_set("venue")).alias("venues"))


def wall_clusters(levels: DataFrame, key: str, tolerance: float = 0.003) -> DataFrame:
    """Levels grouped from the lowest price: a level joins while it is within tolerance of the group's first."""
    points = levels.select(key, "side", "price", (F.col("price") * F.col("qty")).alias("weight"))
    return clusters(points, [key, "side"], tolerance, by="anchor").select(key, "side", "anchor", F.col("weight").alias("notional"), "n")


def sticky_walls(history: DataFrame, least: int, digits: int = 2) -> DataFrame:
    """Price levels seen in at least `least` samples of a book's history (symbol, sample, side, price, qty)."""
    seen = history.groupBy("symbol", "side", F.round("price", digits).alias("price")).agg(F.countDistinct("sample").alias("samples"), F.avg(F.col("price") * F.col("qty")).alias("notional"))
    return seen.where(F.col("samples") >= least)


def imbalance_by_zone(levels: DataFrame, refs: DataFrame, zones: tuple[float, ...] = (0.5, 1.0, 2.0, 5.0)) -> DataFrame:
    """symbol, zone_pct, imbalance, covered_pct: bids against asks within each per cent of the reference price, nearer levels weighing more.

    levels: symbol, side (bid, ask), price, qty; refs: symbol, ref, one row a symbol. A level weighs exp(-2 d / zone) at
    distance d. covered_pct is how far the thinner side of the book reaches into the zone (0 for a missing side); a zone
    without levels has no row. All zones come out of one aggregate over the levels.
    """
    near = levels.join(refs.where("ref > 0"), "symbol").where("price IS NOT NULL AND qty > 0")
    p, ref = F.col("price"), F.col("ref")
    bid, ask = (F.col("side") == "bid") & (p <= ref), (F.col("side") == "ask") & (p >= ref)
    away = F.abs(p - ref) / ref * 100
    names, parts = [], []
    for k, z in enumerate(zones):
        band = ref * z / 100
        inside = (p >= ref - band) & (p <= ref + band)
        money = p * F.col("qty") * F.exp(F.lit(-2.0 / z) * away)
        for side, one in (("bid", bid), ("ask", ask)):
            parts += [F.sum(F.when(one & inside, money)).alias(f"__{side}_{k}"), F.max(F.when(one & inside, away)).alias(f"__{side}_far_{k}")]
        held = lambda c, k=k: F.coalesce(F.col(f"__{c}_{k}"), F.lit(0.0))
        names.append(F.struct(F.lit(float(z)).alias("zone_pct"), F.try_divide(held("bid") - held("ask"), held("bid") + held("ask")).alias("imbalance"), F.least(held("bid_far"), held("ask_far"), F.lit(float(z))).alias("covered_pct")))
    return near.groupBy("symbol").agg(*parts).select("symbol", F.inline(F.array(*names))).where("imbalance IS NOT NULL")
