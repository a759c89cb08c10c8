"""Per-order features of a nested JSON cart, computed inside the row (nothing is exploded)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cart document's layout. Amounts are cents held as text.
CART_SCHEMA = (
    "array<struct<"
    "quantity: double,"
    "unitPrice: struct<value: string>,"
    "totalValue: struct<value: string>,"
    "totalAddition: struct<value: string>,"
    "totalDiscount: struct<value: string>,"
    "garnishItems: array<struct<"
    "unitPrice: struct<value: string>,"
    "totalValue: struct<value: string>>>>>"
)


def parse_cart(text: Column, schema: str = CART_SCHEMA) -> Column:
    """JSON text to items; unparsable text is NULL and a lone object is a one-item cart."""
    return F.from_json(text, schema)


def money(amount: Column) -> Column:
    """``{value: cents}`` to currency units; text that is no number is NULL."""
    return amount["value"].try_cast("double") / F.lit(100.0)


def unit_prices(items: Column) -> Column:
    """The unit prices above zero of items and their garnishes, in cart order."""

    def price(part: Column) -> Column:
        return money(part["unitPrice"])

    def prices(item: Column) -> Column:
        garnishes = F.coalesce(item["garnishItems"], F.array())
        return F.concat(F.array(price(item)), F.transform(garnishes, price))

    return F.filter(F.flatten(F.transform(items, prices)), lambda price: price > 0)


def _or_zero(value: Column, null_as_zero: bool | Column) -> Column:
    """``value`` with 0.0 for NULL if ``null_as_zero`` says so, for all rows or row by row."""
    filled = F.coalesce(value, F.lit(0.0))
    if isinstance(null_as_zero, Column):
        return F.when(null_as_zero, filled).otherwise(value)
    return filled if null_as_zero else value


def value_total(items: Column, null_as_zero: bool | Column = False) -> Column:
    """Sum of the total values of items and their garnishes; NULLs as in ``total_of``."""

    def add(acc: Column, part: Column) -> Column:
        return acc + _or_zero(money(part["totalValue"]), null_as_zero)

    def add_item(acc: Column, item: Column) -> Column:
        return F.aggregate(F.coalesce(item["garnishItems"], F.array()), add(acc, item), add)

    return F.aggregate(items, F.lit(0.0), add_item)


def total_of(parts: Column, amount, null_as_zero: bool | Column = False) -> Column:
    """Sum of ``amount(part)``; one NULL makes the sum NULL unless ``null_as_zero``."""

    def add(acc: Column, part: Column) -> Column:
        return acc + _or_zero(amount(part), null_as_zero)

    return F.aggregate(parts, F.lit(0.0), add)


def has_discount(items: Column) -> Column:
    return F.exists(items, lambda item: money(item["totalDiscount"]) > 0)


def share_pct(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; 0.0 unless the whole is positive and the part known."""
    return F.when(
        (whole > 0) & part.isNotNull(), part / whole * F.lit(100.0)
    ).otherwise(F.lit(0.0))
