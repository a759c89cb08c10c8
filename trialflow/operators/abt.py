"""The analytical base table: one wide row per order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.functions.context import day_period, days_between, ticket_ratio
from trialflow.operators import history, skew
from trialflow.operators.skew import HOT_ROWS
from trialflow.operators.star import Dim, star_join

CONSUMER_COLUMNS = {"created_at": "customer_creation_date", "active": "is_customer_active"}
RESTAURANT_COLUMNS = {
    "id": "restaurant_id",
    "enabled": "is_restaurant_active",
    "price_range": "restaurant_price_range",
    "created_at": "restaurant_creation_date",
    "average_ticket": "restaurant_average_ticket",
    "delivery_time": "restaurant_delivery_time",
    "minimum_order_value": "restaurant_minimum_order_value",
    "merchant_state": "restaurant_state",
    "merchant_city": "restaurant_city_id",
}
ASSIGNMENT_COLUMNS = {"is_target": "arm"}

ABT_COLUMNS = [
    "order_id",
    "customer_id",
    "restaurant_id",
    "arm",
    "order_created_at",
    "day_period",
    "order_total_amount",
    "item_quantity",
    "mean_item_price",
    "max_item_price",
    "item_price_spread",
    "max_item_share_pct",
    "had_restaurant_discount",
    "days_since_last_order",
    "prior_mean_spend",
    "restaurant_visit_no",
    "customer_age_days",
    "ticket_ratio",
    "origin_platform",
    "is_customer_active",
    "restaurant_price_range",
    "restaurant_delivery_time",
]


def build_abt(
    orders: DataFrame,
    consumers: DataFrame,
    restaurants: DataFrame,
    assignment: DataFrame,
    tz_col: str | None = None,
    legacy_null_bucket: bool = False,
    hot_rows: int = HOT_ROWS,
    chunk_rows: int | None = None,
    all_columns: bool = True,
) -> DataFrame:
    """Join orders to their three dimensions and add context and history columns.

    ``orders`` is the cleaned, stored orders table with its cart features. Restaurants come
    first: from there on everything (two dimensions, both history windows) is keyed by
    customer, so one exchange on ``customer_id`` serves all of it. Customers with more than
    ``hot_rows`` orders, NULL included, are set apart beforehand: their few dimension rows are
    broadcast and their history is computed in ordered chunks. ``all_columns=False`` leaves
    out the restaurant columns that the stored table does not have.
    """
    columns = {
        column: name
        for column, name in RESTAURANT_COLUMNS.items()
        if all_columns or name in (*ABT_COLUMNS, "restaurant_average_ticket")
    }
    restaurant = Dim(restaurants, "merchant_id", "id", columns)
    hot = skew.find_hot_keys(orders, ["customer_id"], hot_rows, chunk_rows)
    if not hot.n_keys:
        rows = _with_history(_joined(orders, restaurant, consumers, assignment))
    else:
        ordinary, rest = skew.split_by_heat(orders, hot)
        rows = _with_history(
            _joined(ordinary, restaurant, consumers, assignment)
        ).unionByName(_hot_history(rest, restaurant, consumers, assignment, hot))
    return rows.withColumns(
        {
            "customer_age_days": days_between(
                F.col("customer_creation_date"), F.col("order_created_at")
            ),
            "ticket_ratio": ticket_ratio(
                F.col("order_total_amount"), F.col("restaurant_average_ticket")
            ),
            "day_period": day_period(
                F.col("order_created_at"),
                tz=tz_col and F.col(tz_col),
                legacy_null_bucket=legacy_null_bucket,
            ),
        }
    )


def abt_projection(enriched: DataFrame) -> DataFrame:
    """The 22 columns of the stored table, in order."""
    return enriched.select(*ABT_COLUMNS)


_ORDER = ("order_created_at", ["order_id"])
_VISITS = ["customer_id", "restaurant_id"]


def _joined(orders, restaurant, consumers, assignment) -> DataFrame:
    return star_join(
        orders,
        [
            restaurant,
            Dim(consumers, "customer_id", "customer_id", CONSUMER_COLUMNS),
            Dim(assignment, "customer_id", "customer_id", ASSIGNMENT_COLUMNS),
        ],
    )


def _with_history(df: DataFrame) -> DataFrame:
    ts, tiebreak = _ORDER
    df = history.plain_history(df, "customer_id", ts, "order_total_amount", tiebreak)
    return history.plain_ordinal(df, _VISITS, ts, tiebreak, "restaurant_visit_no")


def _hot_history(orders, restaurant, consumers, assignment, hot) -> DataFrame:
    """History first, on the narrow rows; then the two dimensions, of hot customers only."""
    ts, tiebreak = _ORDER
    chunked = skew.in_ordered_chunks(
        star_join(orders, [restaurant]), ["customer_id", ts, *tiebreak], hot
    )
    df = history.chunked_features(
        chunked, ts, tiebreak, "customer_id", "order_total_amount", _VISITS
    )
    dims = [(consumers, CONSUMER_COLUMNS), (assignment, ASSIGNMENT_COLUMNS)]
    for dim, wanted in dims:
        some, few = skew.only_hot(dim, "customer_id", hot)
        df = star_join(df, [Dim(some, "customer_id", "customer_id", wanted, few)])
    return df
