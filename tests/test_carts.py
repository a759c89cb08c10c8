import pytest
from frames import plan_of
from pyspark.sql import functions as F

from trialflow.operators.carts import CART_FEATURES, cart_features, parse_carts
from workload import feeds, queries

A = (
    '{"quantity":2,"unitPrice":{"value":"1000"},"totalValue":{"value":"2000"},'
    '"totalAddition":{"value":"100"},"totalDiscount":{"value":"0"},"garnishItems":['
    '{"unitPrice":{"value":"300"},"totalValue":{"value":"600"}},'
    '{"unitPrice":{"value":"0"},"totalValue":{"value":"0"}}]}'
)
B = (
    '{"quantity":1,"unitPrice":{"value":"500"},"totalValue":{"value":"500"},'
    '"totalAddition":{"value":"0"},"totalDiscount":{"value":"50"}}'
)
EMPTY_PARTS = (
    '{"quantity":null,"unitPrice":{"value":"0"},"totalValue":{"value":"0"},'
    '"totalAddition":null,"totalDiscount":null,"garnishItems":null}'
)
SINGLE = (
    '{"quantity":1.7,"unitPrice":{"value":"500"},"totalValue":{"value":"500"},'
    '"totalAddition":{"value":"0"},"totalDiscount":{"value":"0"}}'
)
WORDS = '[{"quantity":1,"unitPrice":{"value":"ten"},"totalValue":{"value":"100"}}]'

# items -> quantity, mean, max, spread, total, additions, discount, share of the dearest
CASES = {
    "normal": (f"[{A},{B}]", (3, 6.0, 10.0, 2.943920288775949, 31.0, 1.0, True, 1000 / 31)),
    "null": (None, (None, 0.0, None, 0.0, None, None, None, 0.0)),
    "empty": ("[]", (0, 0.0, None, 0.0, 0.0, 0.0, False, 0.0)),
    "bad json": ("[{oops", (None, 0.0, None, 0.0, None, None, None, 0.0)),
    "null parts": (f"[{EMPTY_PARTS}]", (None, 0.0, None, 0.0, 0.0, None, None, 0.0)),
    "single": (f"[{SINGLE}]", (1, 5.0, 5.0, 0.0, 5.0, 0.0, False, 100.0)),
    "object": (SINGLE, (1, 5.0, 5.0, 0.0, 5.0, 0.0, False, 100.0)),
    "words": (WORDS, (1, 0.0, None, 0.0, 1.0, None, None, 0.0)),
}


@pytest.fixture(scope="module")
def carts(spark):
    rows = [(name, items) for name, (items, _) in CASES.items()]
    return spark.createDataFrame(rows, "name string, items string")


def test_truth_table(carts):
    got = {r["name"]: tuple(r[c] for c in CART_FEATURES) for r in cart_features(carts).collect()}
    for name, (_, want) in CASES.items():
        assert got[name] == pytest.approx(want), name


def test_null_as_zero(carts):
    rows = {r["name"]: r for r in cart_features(carts, null_as_zero=True).collect()}
    assert rows["null parts"]["item_quantity"] == 0
    assert rows["null parts"]["additions_total"] == 0.0
    assert rows["null"]["item_quantity"] is None


def test_features_replace_the_text_and_keep_the_rest(carts):
    assert cart_features(carts).columns == ["name", *CART_FEATURES]
    assert cart_features(carts).count() == len(CASES)


def test_parsed_cart_keeps_its_nesting(carts):
    row = parse_carts(carts.where("name = 'normal'")).first()
    assert [len(item["garnishItems"] or []) for item in row["cart"]] == [2, 0]


def test_json_is_parsed_once_and_without_python(spark, carts, tmp_path):
    carts.write.parquet(str(tmp_path / "carts"))
    stored = spark.read.parquet(str(tmp_path / "carts"))
    plan = plan_of(cart_features(stored))
    assert plan.count("from_json") == 1
    assert "Python" not in plan and "Exchange" not in plan


def test_unused_text_is_not_read(spark, carts, tmp_path):
    carts.write.parquet(str(tmp_path / "carts"))
    plan = plan_of(cart_features(spark.read.parquet(str(tmp_path / "carts"))).select("name"))
    assert "from_json" not in plan and "items" not in plan.split("ReadSchema")[1]


def test_discount_in_one_of_several_items(spark):
    text = f"[{SINGLE},{B}]"
    df = spark.createDataFrame([(text,)], "items string")
    assert cart_features(df).select(F.col("had_restaurant_discount")).first()[0] is True


def test_both_ways_of_reading_nulls_from_one_parse(carts):
    both = cart_features(carts, null_as_zero="lenient")
    assert both.columns == ["name", *CART_FEATURES, "lenient"] and plan_of(both).count("from_json(") == 1
    for way in (False, True):
        got = both.where(F.col("lenient") == way).drop("lenient").collect()
        assert sorted(got) == sorted(cart_features(carts, null_as_zero=way).collect())


def test_edge_case_query_parses_each_cart_once(spark, tmp_path):
    cart_row = (1, 7, 2, 4, 3.0, 10.0, 0.1, 0.2, "N", "O", None)
    spark.createDataFrame([cart_row], feeds.SCHEMAS["lineitem"]).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert plan_of(queries.cart_edge_cases(spark, str(tmp_path))).count("from_json(") == 1
