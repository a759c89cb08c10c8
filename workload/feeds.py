"""The four feeds, derived by Spark from the given tables.

An order is a line of an order (``orders`` left join ``lineitem``): (order key, line number) is
its id, which repeats often enough to make deduplication work, and orders without lines
give orders without cart and restaurant. Customers play consumers, suppliers play restaurants,
and the market segment decides the experiment arm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialflow.session import pin_utc


@dataclass(frozen=True)
class Feeds:
    orders: DataFrame
    consumers: DataFrame
    restaurants: DataFrame
    assignment: DataFrame


# The given tables' schemas, so that opening one takes no job.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str) -> Feeds:
    pin_utc(spark)
    return Feeds(
        orders(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")),
        consumers(table(spark, sf_dir, "customer")),
        restaurants(table(spark, sf_dir, "supplier")),
        assignment(table(spark, sf_dir, "customer")),
    )


def orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    o = F.col
    second = (o("o_orderkey") * 7919 + F.coalesce(o("l_partkey"), F.lit(0)) * 31) % 86400
    day = F.coalesce("l_shipdate", "o_orderdate").cast("timestamp")
    return orders.join(
        lineitem, orders["o_orderkey"] == lineitem["l_orderkey"], "left"
    ).select(
        F.concat_ws("-", "o_orderkey", F.coalesce("l_linenumber", F.lit(0))).alias("order_id"),
        o("o_custkey").cast("string").alias("customer_id"),
        o("l_suppkey").cast("string").alias("merchant_id"),
        F.lit("America/Sao_Paulo").alias("merchant_timezone"),
        F.timestamp_add("SECOND", second.cast("int"), day).alias("order_created_at"),
        (o("o_orderstatus") == "P").alias("order_scheduled"),
        F.coalesce("l_extendedprice", "o_totalprice").alias("order_total_amount"),
        o("o_orderpriority").alias("origin_platform"),
        F.when(o("l_orderkey").isNotNull(), F.to_json(_cart())).alias("items"),
    )


def edge_carts(lineitem: DataFrame) -> DataFrame:
    """Lines whose cart text takes a form that depends on the line number."""
    no_parts = F.to_json(F.array(_item(F.lit(None).cast("double"), F.lit(0), F.lit(0))))
    items = (
        F.when(F.col("l_linenumber") == 1, F.to_json(_cart()))
        .when(F.col("l_linenumber") == 2, F.lit("[]"))
        .when(F.col("l_linenumber") == 3, F.lit("[{oops"))
        .when(F.col("l_linenumber") == 4, no_parts)
        .when(F.col("l_linenumber") == 5, F.to_json(_main_item()))
        .when(F.col("l_linenumber") == 6, F.lit(None).cast("string"))
        .otherwise(F.to_json(F.array(_main_item(), _main_item())))
    )
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", items.alias("items")
    )


def spoilt_orders(orders: DataFrame) -> DataFrame:
    """Orders as JSON lines; the last digit of the order key says what is wrong with a line.

    1: the amount is a word; 2: the time has no milliseconds; 3: the line is cut off; 4: amount
    and flag are words; the others are as they should be.
    """
    digit = F.substring_index("order_id", "-", 1).cast("bigint") % 10
    time = F.date_format("order_created_at", "yyyy-MM-dd'T'HH:mm:ss")
    word = lambda *digits: digit.isin(*digits)

    def field(name: str, value: Column, text: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value, text)

    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    amount = F.when(word(1, 4), F.lit('"n/a"')).otherwise(F.col("order_total_amount").cast("string"))
    flag = F.when(word(4), F.lit('"maybe"')).otherwise(F.col("order_scheduled").cast("string"))
    stamp = F.concat(time, F.when(word(2), F.lit("Z")).otherwise(F.lit(".000Z")))
    line = F.concat(
        F.lit("{"),
        field("order_id", quoted(F.col("order_id")), F.lit(",")),
        field("customer_id", quoted(F.col("customer_id")), F.lit(",")),
        field("order_created_at", quoted(stamp), F.lit(",")),
        field("order_scheduled", flag, F.lit(",")),
        field("order_total_amount", amount, F.lit("}")),
    )
    cut = F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))
    return orders.select(F.when(word(3), cut).otherwise(line).alias("value"))


def spoilt_restaurants(restaurants: DataFrame) -> DataFrame:
    """Restaurants as CSV lines; the last digit of the id says what is wrong with a line.

    1: the price range is a word; 2: the line has two fields only; 3: it has one too many.
    """
    digit = F.col("id").cast("bigint") % 10
    head = [F.col("id"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")]
    price = F.when(digit == 1, "cheap").otherwise(F.col("price_range").cast("string"))
    rest = ["average_ticket", "delivery_time", "minimum_order_value"]
    place = [F.lit("14025"), F.col("merchant_city"), F.col("merchant_state"), F.col("merchant_country")]
    whole = [*head, F.col("enabled").cast("string"), price, *[F.col(c).cast("string") for c in rest], *place]
    line = F.when(digit == 2, F.concat_ws(",", *head)).when(digit == 3, F.concat_ws(",", *whole, F.lit("x")))
    return restaurants.select(line.otherwise(F.concat_ws(",", *whole)).alias("value"))


def consumers(customer: DataFrame) -> DataFrame:
    signup = F.date_sub(F.lit("1994-12-31").cast("date"), F.col("c_nationkey") * 17)
    return customer.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_mktsegment").alias("language"),
        signup.cast("timestamp").alias("created_at"),
        (F.col("c_acctbal") >= 0).alias("active"),
        F.col("c_name").alias("customer_name"),
    )


def restaurants(supplier: DataFrame) -> DataFrame:
    opened = F.date_sub(F.lit("1994-12-31").cast("date"), F.col("s_nationkey") * 31)
    return supplier.select(
        F.col("s_suppkey").cast("string").alias("id"),
        opened.cast("timestamp").alias("created_at"),
        (F.col("s_acctbal") > 0).alias("enabled"),
        (F.col("s_nationkey") / F.lit(5)).cast("int").alias("price_range"),
        (F.col("s_acctbal") * F.lit(10.0)).alias("average_ticket"),
        (F.col("s_nationkey") + F.lit(20)).cast("double").alias("delivery_time"),
        F.lit(10.0).alias("minimum_order_value"),
        F.lit(None).cast("string").alias("merchant_zip_code"),
        F.col("s_name").alias("merchant_city"),
        F.col("s_nationkey").cast("string").alias("merchant_state"),
        F.lit("BR").alias("merchant_country"),
    )


def assignment(customer: DataFrame) -> DataFrame:
    """Two segments per arm; the fifth is held out, or unassigned if its balance is negative."""
    segment = F.col("c_mktsegment")
    arm = (
        F.when(segment.isin("AUTOMOBILE", "BUILDING"), "control")
        .when(segment.isin("FURNITURE", "HOUSEHOLD"), "target")
        .when(F.col("c_acctbal") >= 0, "holdout")
    )
    return customer.select(
        F.col("c_custkey").cast("string").alias("customer_id"), arm.alias("is_target")
    ).where(F.col("is_target").isNotNull())


def _cents(amount: Column) -> Column:
    text = F.floor(amount * F.lit(100.0) + F.lit(0.5)).cast("bigint").cast("string")
    return F.struct(text.alias("value"))


def _item(
    quantity: Column,
    unit: Column,
    total: Column,
    addition: Column | None = None,
    discount: Column | None = None,
    garnishes: Column | None = None,
) -> Column:
    amount = "struct<value: string>"
    nothing = F.lit(None).cast(amount)
    none_of_them = F.lit(None).cast(f"array<struct<unitPrice: {amount}, totalValue: {amount}>>")
    return F.struct(
        quantity.alias("quantity"),
        _cents(unit).alias("unitPrice"),
        _cents(total).alias("totalValue"),
        (nothing if addition is None else addition).alias("totalAddition"),
        (nothing if discount is None else discount).alias("totalDiscount"),
        (none_of_them if garnishes is None else garnishes).alias("garnishItems"),
    )


def _main_item() -> Column:
    quantity, price, tax = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")
    extra = tax * F.lit(100.0)
    garnish = F.struct(
        _cents(extra).alias("unitPrice"), _cents(extra * quantity).alias("totalValue")
    )
    return _item(
        quantity,
        price / quantity,
        price,
        _cents(extra),
        _cents(F.col("l_discount") * F.lit(100.0)),
        F.when(tax > 0, F.array(garnish)),
    )


def _cart() -> Column:
    """The line's item, and for returned lines a cheaper, fractional replacement item."""
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    replacement = _item(
        F.col("l_discount") * F.lit(10.0),
        price / quantity / F.lit(2.0),
        price / F.lit(20.0),
        F.when(F.col("l_linestatus") == "F", _cents(F.lit(0))),
        _cents(F.lit(0)),
    )
    return F.when(
        F.col("l_returnflag") == "R", F.array(_main_item(), replacement)
    ).otherwise(F.array(_main_item()))
