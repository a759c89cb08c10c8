"""Cart features of an orders DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.functions import carts as fn
from trialflow.functions.stats import array_mean, population_stddev

CART_FEATURES = [
    "item_quantity",
    "mean_item_price",
    "max_item_price",
    "item_price_spread",
    "recomputed_total",
    "additions_total",
    "had_restaurant_discount",
    "max_item_share_pct",
]


def parse_carts(df: DataFrame, items: str = "items", out: str = "cart") -> DataFrame:
    """Add the parsed cart as array<struct> column ``out``."""
    return df.withColumn(out, fn.parse_cart(F.col(items)))


def cart_features(df: DataFrame, items: str = "items", null_as_zero: bool | str = False) -> DataFrame:
    """Replace the JSON column ``items`` by the eight cart features.

    A plain projection: no shuffle, no generated rows, no Python worker. The cart is parsed once
    per row, and what it holds is read in a second layer that leaves it behind.

    ``null_as_zero`` may name a further, last column instead: each row then comes twice, with false
    and with true there, read in that way; the cart is still parsed once.
    """
    cart, prices = F.col("_cart"), F.col("_prices")
    parsed = parse_carts(df, items, "_cart")
    kept, ways = [name for name in df.columns if name != items], []
    if isinstance(null_as_zero, str):
        ways, null_as_zero = [null_as_zero], F.col(null_as_zero)
        parsed = parsed.withColumn(*ways, F.explode(F.array(F.lit(False), F.lit(True))))
    read = parsed.select(
        *kept,
        *ways,
        fn.total_of(cart, lambda item: item["quantity"], null_as_zero)
        .try_cast("int")
        .alias("item_quantity"),
        fn.unit_prices(cart).alias("_prices"),
        fn.value_total(cart, null_as_zero).alias("recomputed_total"),
        fn.total_of(cart, lambda item: fn.money(item["totalAddition"]), null_as_zero).alias(
            "additions_total"
        ),
        fn.has_discount(cart).alias("had_restaurant_discount"),
    )
    features = {
        "mean_item_price": array_mean(prices),
        "max_item_price": F.array_max(prices),
        "item_price_spread": population_stddev(prices),
        "max_item_share_pct": fn.share_pct(F.array_max(prices), F.col("recomputed_total")),
    }
    return read.withColumns(features).select(*kept, *CART_FEATURES, *ways)
