"""The registered queries in DuckDB SQL, written from the data model rather than the operators."""

from __future__ import annotations

from workload.queries import END, EVENTS_END, GRID_OFFSET, LAUNCH


def grid(expression: str, digits: int, name: str | None = None) -> str:
    scale = f"1e{digits}"
    return f"floor(({expression}) * {scale} + {GRID_OFFSET}) / {scale} AS {name or expression}"


def union_all(*selects: str) -> str:
    return "\nUNION ALL\n".join(selects)


def with_(*names: str) -> str:
    """WITH clause of the named pieces below, dependencies included, in order of definition."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        wanted.add(name)
        for dependency in PIECES[name][0]:
            add(dependency)

    for name in names:
        add(name)
    parts = [f"{n} AS ({sql})" for n, (_, sql) in PIECES.items() if n in wanted]
    return "WITH " + ",\n".join(parts) + "\n"


def cents(expression: str) -> str:
    return f"floor(({expression}) * 100 + 0.5) / 100.0"


_MAIN = f"""
    {cents('l_extendedprice / l_quantity')} AS u1,
    {cents('l_extendedprice')} AS t1,
    {cents('l_tax * 100')} AS a1,
    floor(l_discount * 100 * 100 + 0.5) AS d1,
    CASE WHEN l_tax > 0 THEN {cents('l_tax * 100')} END AS ug,
    CASE WHEN l_tax > 0 THEN {cents('l_tax * 100 * l_quantity')} END AS tg"""

_MEAN = "coalesce(list_avg(prices), 0.0)"
_SPREAD = "CASE WHEN list_count(prices) < 2 OR prices IS NULL THEN 0.0 " \
    "ELSE list_aggregate(prices, 'stddev_pop') END"


def features(total: str = "total") -> str:
    return ",\n".join(
        [
            "CAST(trunc(quantity) AS INTEGER) AS item_quantity",
            grid(_MEAN, 4, "mean_item_price"),
            grid("list_max(prices)", 4, "max_item_price"),
            grid(_SPREAD, 4, "item_price_spread"),
            grid(total, 4, "recomputed_total"),
            grid("additions", 4, "additions_total"),
            "discounted AS had_restaurant_discount",
            grid(
                f"CASE WHEN {total} > 0 AND list_max(prices) IS NOT NULL "
                f"THEN list_max(prices) / {total} * 100 ELSE 0.0 END",
                4,
                "max_item_share_pct",
            ),
        ]
    )


# name -> (pieces it reads, SQL)
PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    "feed": (
        (),
        """
        SELECT *,
            concat(o_orderkey, '-', coalesce(l_linenumber, 0)) AS order_id,
            CAST(o_custkey AS VARCHAR) AS customer_id,
            CAST(l_suppkey AS VARCHAR) AS merchant_id,
            coalesce(l_shipdate, o_orderdate)
              + to_seconds((o_orderkey * 7919 + coalesce(l_partkey, 0) * 31) % 86400)
              AS order_created_at,
            o_orderstatus = 'P' AS order_scheduled,
            coalesce(l_extendedprice, o_totalprice) AS order_total_amount,
            o_orderpriority AS origin_platform
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""",
    ),
    "feed_parts": (
        ("feed",),
        f"""
        SELECT *, {_MAIN},
            l_returnflag = 'R' AS two,
            {cents('l_extendedprice / l_quantity / 2')} AS u2,
            {cents('l_extendedprice / 20')} AS t2
        FROM feed""",
    ),
    "feed_carts": (
        ("feed_parts",),
        """
        SELECT *,
            CASE WHEN l_orderkey IS NOT NULL THEN
              [CASE WHEN u1 > 0 THEN u1 END, ug, CASE WHEN two AND u2 > 0 THEN u2 END]
            END AS prices,
            l_quantity + CASE WHEN two THEN l_discount * 10 ELSE 0 END AS quantity,
            t1 + coalesce(tg, 0) + CASE WHEN two THEN t2 ELSE 0 END AS total,
            CASE WHEN two AND l_linestatus <> 'F' THEN NULL ELSE a1 END AS additions,
            d1 > 0 AS discounted
        FROM feed_parts""",
    ),
    "consumers": (
        (),
        """
        SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment AS language,
            CAST(DATE '1994-12-31' - c_nationkey * 17 AS TIMESTAMP) AS created_at,
            c_acctbal >= 0 AS active
        FROM customer""",
    ),
    "restaurants": (
        (),
        """
        SELECT CAST(s_suppkey AS VARCHAR) AS id,
            CAST(DATE '1994-12-31' - s_nationkey * 31 AS TIMESTAMP) AS created_at,
            s_acctbal > 0 AS enabled,
            CAST(trunc(s_nationkey / 5.0) AS INTEGER) AS price_range,
            s_acctbal * 10 AS average_ticket,
            CAST(s_nationkey + 20 AS DOUBLE) AS delivery_time,
            CAST(10 AS DOUBLE) AS minimum_order_value,
            CAST(NULL AS VARCHAR) AS merchant_zip_code,
            s_name AS merchant_city,
            CAST(s_nationkey AS VARCHAR) AS merchant_state,
            'BR' AS merchant_country
        FROM supplier""",
    ),
    "assignment": (
        (),
        """
        SELECT * FROM (
            SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
                CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'control'
                     WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'target'
                     WHEN c_acctbal >= 0 THEN 'holdout' END AS is_target
            FROM customer
        ) WHERE is_target IS NOT NULL""",
    ),
    "users": (
        ("assignment",),
        """
        SELECT DISTINCT customer_id, is_target AS arm FROM assignment
        WHERE is_target IN ('control', 'target')""",
    ),
    "cleaned": (
        ("feed_carts",),
        """
        SELECT * FROM feed_carts
        QUALIFY row_number() OVER (
            PARTITION BY order_id
            ORDER BY order_created_at DESC, merchant_id NULLS FIRST, order_total_amount) = 1""",
    ),
    "abt": (
        ("cleaned", "consumers", "restaurants", "assignment"),
        """
        SELECT o.*, c.created_at AS signup, c.active, r.id AS restaurant_id, r.price_range,
            r.delivery_time, r.average_ticket, a.is_target AS arm,
            lag(order_created_at) OVER by_customer AS previous,
            avg(order_total_amount) OVER (by_customer
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_mean,
            row_number() OVER (PARTITION BY o.customer_id, r.id
                ORDER BY order_created_at, order_id) AS visit_no
        FROM cleaned o
        LEFT JOIN consumers c ON o.customer_id = c.customer_id
        LEFT JOIN restaurants r ON o.merchant_id = r.id
        LEFT JOIN assignment a ON o.customer_id = a.customer_id
        WINDOW by_customer AS (PARTITION BY o.customer_id ORDER BY order_created_at, order_id)""",
    ),
    "kpis": (
        ("abt",),
        """
        SELECT customer_id, sum(order_total_amount) AS revenue, count(*) AS order_count,
            avg(order_total_amount) AS avg_ticket,
            avg(trunc(quantity)) AS avg_items,
            avg(date_diff('day', CAST(previous AS DATE), CAST(order_created_at AS DATE)))
              AS avg_days_to_reorder,
            count(*) FILTER (visit_no = 1) AS new_restaurant_orders,
            count(*) FILTER (visit_no = 1) / count(*) * 100 AS new_restaurant_rate_pct
        FROM abt GROUP BY customer_id""",
    ),
    "first_two": (
        ("abt",),
        """
        SELECT customer_id, min(ts) AS first_order_at,
            max(ts) FILTER (n = 2) AS second_order_at
        FROM (SELECT customer_id, order_created_at AS ts, row_number() OVER (
                PARTITION BY customer_id ORDER BY order_created_at) AS n FROM abt)
        WHERE n <= 2 GROUP BY customer_id""",
    ),
    "flags": (
        ("first_two",),
        """
        SELECT *,
            CAST(coalesce(gap <= 7, false) AS INTEGER) AS is_retained_7d,
            CAST(coalesce(gap <= 14, false) AS INTEGER) AS is_retained_14d
        FROM (SELECT *, date_diff('day', CAST(first_order_at AS DATE),
                CAST(second_order_at AS DATE)) AS gap FROM first_two)""",
    ),
    "conditional": (
        ("users", "kpis", "flags"),
        """
        SELECT u.customer_id, u.arm, revenue, order_count, avg_ticket, avg_items,
            avg_days_to_reorder, new_restaurant_orders, new_restaurant_rate_pct,
            is_retained_7d, is_retained_14d
        FROM users u LEFT JOIN kpis USING (customer_id) LEFT JOIN flags USING (customer_id)""",
    ),
    "spine": (
        ("conditional",),
        """
        SELECT customer_id, arm, coalesce(revenue, 0) AS revenue,
            coalesce(order_count, 0) AS order_count, coalesce(avg_ticket, 0) AS avg_ticket,
            coalesce(avg_items, 0) AS avg_items,
            coalesce(avg_days_to_reorder, 0) AS avg_days_to_reorder,
            coalesce(new_restaurant_orders, 0) AS new_restaurant_orders,
            coalesce(new_restaurant_rate_pct, 0) AS new_restaurant_rate_pct,
            coalesce(is_retained_7d, 0) AS is_retained_7d,
            coalesce(is_retained_14d, 0) AS is_retained_14d
        FROM conditional""",
    ),
}


def segments(source: str, day: str, active=30, risk=(31, 90), bounded=False) -> str:
    age = f"date_diff('day', CAST(order_created_at AS DATE), DATE '{day}')"
    last = f"date_diff('day', CAST(max(order_created_at) AS DATE), DATE '{day}')"
    recent = f"{age} <= {active}" + (f" AND {age} >= 0" if bounded else "")
    return f"""
        SELECT customer_id,
            CASE WHEN min(order_created_at) >= DATE '{day}' - 7 THEN 'new'
                 WHEN count(*) FILTER ({recent}) >= 2 THEN 'active'
                 WHEN {last} BETWEEN {risk[0]} AND {risk[1]} THEN 'at_risk'
                 ELSE 'other' END AS lifecycle_segment
        FROM {source} GROUP BY customer_id"""


PIECES["segments"] = (("abt",), segments("abt", END))
PIECES["segmented"] = (
    ("spine", "segments"),
    "SELECT * FROM segments JOIN spine USING (customer_id)",
)

# metric -> (measure, scale, digits of its grid)
METRICS = {
    "revenue_per_user": ("revenue", 1, 1),
    "order_frequency": ("order_count", 1, 6),
    "avg_ticket": ("avg_ticket", 1, 2),
    "retention_7d_pct": ("is_retained_7d", 100, 6),
    "retention_14d_pct": ("is_retained_14d", 100, 6),
    "items_per_order": ("avg_items", 1, 6),
    "days_to_reorder": ("avg_days_to_reorder", 1, 6),
    "new_restaurant_rate_pct": ("new_restaurant_rate_pct", 1, 6),
}
LABELS = {
    "revenue_per_user": "Revenue per user",
    "order_frequency": "Orders per user",
    "avg_ticket": "Average ticket",
    "retention_7d_pct": "7-day retention, %",
    "retention_14d_pct": "14-day retention, %",
    "items_per_order": "Items per order",
    "days_to_reorder": "Days to the next order",
    "new_restaurant_rate_pct": "Orders at new restaurants, %",
}
OF_CONVERTED = {
    "avg_ticket", "items_per_order", "days_to_reorder", "new_restaurant_rate_pct"
}
BY_SEGMENT = [m for m in METRICS if m not in ("retention_7d_pct", "items_per_order")]
SEGMENT_TESTS = [m for m in BY_SEGMENT if m != "avg_ticket"]


def summary(source: str, by: str, metrics=tuple(METRICS), counts: bool = False) -> str:
    columns = []
    for name in metrics:
        measure, scale, digits = METRICS[name]
        columns.append(grid(f"avg({measure}) * {scale}", digits, name))
        columns.append(grid(f"stddev_samp({measure}) * {scale}", digits, f"stddev_{name}"))
        if counts:
            columns.append(f"count({measure}) AS n_{name}")
    return (
        f"SELECT {by}, {', '.join(columns)}, count(*) AS users, "
        f"count(*) FILTER (order_count > 0) AS converted_users FROM {source} GROUP BY {by}"
    )


def ttest(source, metrics, by="", n=None, equal_var=True, control_n_only=False) -> str:
    """Means, spreads and sizes per metric and side; p by Simpson's rule on the density of t."""
    keys = f"{by}, " if by else ""
    rows = []
    for name in metrics:
        measure, scale, _ = METRICS[name]
        size = n(name, measure) if n else "count(*)"
        rows.append(
            f"SELECT {keys}arm, '{name}' AS metric, '{LABELS[name]}' AS label, "
            f"avg({measure}) * {scale} AS m, stddev_samp({measure}) * {scale} AS s, "
            f"{size} AS n FROM {source} GROUP BY {keys}arm"
        )
    n_target = "any_value(n) FILTER (arm = '{}')".format(
        "control" if control_n_only else "target"
    )
    if equal_var:
        df = "nc + nt - 2"
        error = f"sqrt(((nc - 1) * sc * sc + (nt - 1) * st * st) / ({df}) * (1 / nc + 1 / nt))"
    else:
        vc, vt = "(sc * sc / nc)", "(st * st / nt)"
        error = f"sqrt({vc} + {vt})"
        df = f"({vc} + {vt}) ** 2 / ({vc} ** 2 / (nc - 1) + {vt} ** 2 / (nt - 1))"
    digits = [f"WHEN '{name}' THEN 1e{METRICS[name][2]}" for name in metrics]
    cut = f"CASE metric {' '.join(digits)} END"
    steps = 20000
    density = (
        "exp(lgamma((df + 1) / 2) - lgamma(df / 2) - ln(df * pi()) / 2"
        " - (df + 1) / 2 * ln(1 + u * u / df))"
    )
    output = [
        f"{by}" if by else "",
        "metric",
        "label",
        f"floor(mc * {cut} + {GRID_OFFSET}) / {cut} AS control_mean",
        f"floor(mt * {cut} + {GRID_OFFSET}) / {cut} AS target_mean",
        grid("(mt - mc) / mc * 100", 4, "lift_pct"),
        "CAST(nc AS BIGINT) AS n_control",
        "CAST(nt AS BIGINT) AS n_target",
        "status",
        grid("CASE WHEN status = 'tested' THEN t END", 6, "t_stat"),
        grid("CASE WHEN status = 'tested' THEN df END", 4, "df"),
        grid("CASE WHEN status = 'tested' THEN p END", 6, "p_value"),
        "CASE WHEN status = 'tested' THEN p < 0.05 END AS significant",
    ]
    return f"""
    , long AS ({union_all(*rows)}),
    sides AS (
        SELECT {keys}metric, any_value(label) AS label,
            any_value(m) FILTER (arm = 'control') AS mc,
            any_value(m) FILTER (arm = 'target') AS mt,
            any_value(s) FILTER (arm = 'control') AS sc,
            any_value(s) FILTER (arm = 'target') AS st,
            CAST(any_value(n) FILTER (arm = 'control') AS DOUBLE) AS nc,
            CAST({n_target} AS DOUBLE) AS nt,
            count(*) AS arms
        FROM long GROUP BY {keys}metric),
    judged AS (
        SELECT *, CASE WHEN arms < 2 THEN 'missing_arm'
            WHEN sc IS NULL OR st IS NULL OR sc = 0 OR st = 0 OR nc <= 1 OR nt <= 1
            THEN 'no_spread_or_n' ELSE 'tested' END AS status
        FROM sides),
    stats AS (
        SELECT *, CASE WHEN status = 'tested' THEN (mt - mc) / {error} END AS t,
            CASE WHEN status = 'tested' THEN {df} END AS df
        FROM judged),
    areas AS (
        SELECT {keys}metric, sum({density} * w) * any_value(h) / 3 AS area
        FROM (
            SELECT stats.*, abs(t) / {steps} AS h, abs(t) / {steps} * i AS u,
                CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
            FROM stats, range({steps} + 1) r(i) WHERE status = 'tested')
        GROUP BY {keys}metric),
    tests AS (
        SELECT stats.*, 1 - 2 * area AS p
        FROM stats LEFT JOIN areas USING ({keys}metric))
    SELECT {', '.join(c for c in output if c)} FROM tests"""


def check(name: str, severity: str, violations: str, total: str, source: str, share: float = 0) -> str:
    return (
        f"SELECT '{name}' AS \"check\", '{severity}' AS severity, "
        f"CAST({violations} AS BIGINT) AS violations, CAST({total} AS BIGINT) AS total, "
        f"{violations} <= {share} * {total} AS passed FROM {source}"
    )


def nulls(table: str, column: str, share: float, condition: str, source: str) -> str:
    return check(f"{table}: at most {share:.0%} of {column} is null", "warning",
                 f"count(*) FILTER ({condition})", "count(*)", source, share)


def spoilt(table: str, key: str, losses: dict[str, str], malformed: str, source: str) -> str:
    """What the load checks say of records whose key's last digit spoils them."""
    digit = lambda digits: f"count(*) FILTER ({key} % 10 IN ({digits or 'NULL'}))"
    rows = [check(f"{table}: records are well-formed", "warning", digit(malformed), "count(*)", source)]
    rows += [check(f"{table}: {c} loads", "warning", digit(d), "count(*)", source) for c, d in losses.items()]
    return union_all(*rows)


def pair(name: str, left: str, left_key: str, right: str, right_key: str) -> str:
    hit = f"count(*) FILTER (k IN (SELECT {right_key} FROM {right}))"
    return (
        f"SELECT '{name}' AS pair, count(*) AS total, {hit} AS matched, "
        f"count(*) - {hit} AS missing, {grid(f'{hit} / count(*) * 100', 6, 'matched_pct')} "
        f"FROM (SELECT DISTINCT {left_key} AS k FROM {left})"
    )


def not_in(left: str, right: str) -> str:
    return (
        f"(SELECT count(*) FROM (SELECT DISTINCT customer_id AS k FROM {left}) "
        f"WHERE k NOT IN (SELECT customer_id FROM {right}))"
    )


_DISTINCT_ORDERS = "count(DISTINCT order_id)"
_ABT_COLUMNS = ", ".join(
    [
        "order_id",
        "customer_id",
        "restaurant_id",
        "arm",
        "order_created_at",
        "CASE WHEN hour(order_created_at) BETWEEN 6 AND 11 THEN 'morning' "
        "WHEN hour(order_created_at) BETWEEN 12 AND 17 THEN 'afternoon' "
        "WHEN hour(order_created_at) BETWEEN 18 AND 23 THEN 'evening' "
        "ELSE 'night' END AS day_period",
        "order_total_amount",
        "CAST(trunc(quantity) AS INTEGER) AS item_quantity",
        grid(_MEAN, 4, "mean_item_price"),
        grid("list_max(prices)", 4, "max_item_price"),
        grid(_SPREAD, 4, "item_price_spread"),
        grid(
            "CASE WHEN total > 0 AND list_max(prices) IS NOT NULL "
            "THEN list_max(prices) / total * 100 ELSE 0.0 END",
            4,
            "max_item_share_pct",
        ),
        "discounted AS had_restaurant_discount",
        "CAST(date_diff('day', CAST(previous AS DATE), CAST(order_created_at AS DATE)) "
        "AS INTEGER) AS days_since_last_order",
        grid("prior_mean", 4, "prior_mean_spend"),
        "CAST(visit_no AS INTEGER) AS restaurant_visit_no",
        "CAST(date_diff('day', CAST(signup AS DATE), CAST(order_created_at AS DATE)) "
        "AS INTEGER) AS customer_age_days",
        grid(
            "CASE WHEN average_ticket > 0 THEN order_total_amount / average_ticket END",
            6,
            "ticket_ratio",
        ),
        "origin_platform",
        "active AS is_customer_active",
        "price_range AS restaurant_price_range",
        "delivery_time AS restaurant_delivery_time",
    ]
)
_KPI_COLUMNS = ", ".join(
    [
        grid("revenue", 2),
        "order_count",
        grid("avg_ticket", 4),
        grid("avg_items", 6),
        grid("avg_days_to_reorder", 6),
        "new_restaurant_orders",
        grid("new_restaurant_rate_pct", 6),
    ]
)

# One row per line and reading of NULL parts; which parts a cart has depends on its line number.
_EDGE_CARTS = f"""
    WITH parts AS (
        SELECT *, {_MAIN}, l_linenumber IN (2, 3, 6) AS bare FROM lineitem),
    carts AS (
        SELECT *,
            CASE WHEN l_linenumber IN (3, 6) THEN NULL
                 WHEN l_linenumber IN (2, 4) THEN []
                 WHEN l_linenumber = 7 THEN [u1, ug, u1, ug]
                 WHEN l_linenumber = 1 AND l_returnflag = 'R'
                   THEN [u1, ug, {cents('l_extendedprice / l_quantity / 2')}]
                 ELSE [u1, ug] END AS raw_prices,
            CASE WHEN l_linenumber IN (3, 6) THEN NULL
                 WHEN l_linenumber IN (2, 4) THEN 0.0
                 WHEN l_linenumber = 7 THEN t1 + coalesce(tg, 0) + t1 + coalesce(tg, 0)
                 WHEN l_linenumber = 1 AND l_returnflag = 'R'
                   THEN t1 + coalesce(tg, 0) + {cents('l_extendedprice / 20')}
                 ELSE t1 + coalesce(tg, 0) END AS total,
            CASE WHEN l_linenumber IN (3, 6) THEN NULL
                 WHEN l_linenumber = 2 THEN 0.0
                 WHEN l_linenumber = 4 THEN CASE WHEN null_as_zero THEN 0.0 END
                 WHEN l_linenumber = 7 THEN l_quantity * 2
                 WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN l_quantity + l_discount * 10
                 ELSE l_quantity END AS quantity,
            CASE WHEN l_linenumber IN (3, 6) THEN NULL
                 WHEN l_linenumber = 2 THEN 0.0
                 WHEN l_linenumber = 4 THEN CASE WHEN null_as_zero THEN 0.0 END
                 WHEN l_linenumber = 7 THEN a1 + a1
                 WHEN l_linenumber = 1 AND l_returnflag = 'R' AND l_linestatus <> 'F'
                   THEN CASE WHEN null_as_zero THEN a1 END
                 ELSE a1 END AS additions,
            CASE WHEN l_linenumber IN (3, 4, 6) THEN NULL
                 WHEN l_linenumber = 2 THEN false
                 ELSE d1 > 0 END AS discounted
        FROM parts, (VALUES (false), (true)) v(null_as_zero)),
    final AS (SELECT *, CASE WHEN raw_prices IS NOT NULL THEN
        list_transform(raw_prices, lambda x: CASE WHEN x > 0 THEN x END) END AS prices FROM carts)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, null_as_zero, {features()} FROM final"""

_EVENT_WINDOW = "PARTITION BY user_id ORDER BY ts, event_id"

ORACLE: dict[str, str] = {
    "ingest_json_roundtrip": with_("feed_carts")
    + f"""SELECT order_id, customer_id, merchant_id, order_created_at, order_scheduled,
        order_total_amount, origin_platform, CAST(NULL AS VARCHAR) AS cpf,
        l_orderkey IS NULL AS no_cart, {features()} FROM feed_carts""",
    "ingest_csv_roundtrip": with_("restaurants") + "SELECT * FROM restaurants",
    "ingest_quarantine": with_("feed", "restaurants")
    + union_all(
        spoilt("orders", "o_orderkey", {"order_created_at": "2", "order_scheduled": "4",
               "order_total_amount": "1, 4", "order_scheduled_date": ""}, "3", "feed"),
        spoilt("restaurants", "CAST(id AS BIGINT)", dict.fromkeys(
            ["created_at", "enabled", "average_ticket", "delivery_time", "minimum_order_value"], "")
            | {"price_range": "1"}, "2, 3", "restaurants"),
        check("orders: order_id is not null", "error",
              "count(*) FILTER (o_orderkey % 10 = 3)", "count(*)", "feed"),
        nulls("orders", "order_created_at", 0.01, "o_orderkey % 10 IN (2, 3)", "feed"),
        nulls("orders", "order_total_amount", 0.01, "o_orderkey % 10 IN (1, 3, 4)", "feed"),
        check("restaurants: id is not null", "error", "0", "count(*)", "restaurants"),
        nulls("restaurants", "price_range", 0.5,
              "CAST(id AS BIGINT) % 10 IN (1, 2)", "restaurants"),
    ),
    "table_write_read": with_("restaurants")
    + """SELECT id, average_ticket, CAST(NULL AS BOOLEAN) AS enabled,
        CAST(NULL AS INTEGER) AS price_range FROM restaurants""",
    "sql_view_projection": with_("restaurants", "consumers")
    + """SELECT r.id AS restaurant_id, r.enabled AS is_restaurant_active,
        r.price_range AS restaurant_price_range, r.created_at AS restaurant_creation_date,
        c.active AS is_customer_active
        FROM restaurants r LEFT JOIN consumers c ON r.id = c.customer_id""",
    "quality_report": with_("feed", "consumers", "restaurants", "assignment")
    + union_all(
        check("orders: order_id is not null", "error",
              "count(*) FILTER (order_id IS NULL)", "count(*)", "feed"),
        check("orders: order_total_amount >= 0", "error",
              "count(*) FILTER (order_total_amount < 0)", "count(*)", "feed"),
        check("orders: (order_id) is unique", "warning",
              f"(count(*) - {_DISTINCT_ORDERS})", "count(*)", "feed"),
        nulls("orders", "order_created_at", 0.01, "order_created_at IS NULL", "feed"),
        nulls("orders", "order_total_amount", 0.01, "order_total_amount IS NULL", "feed"),
        nulls("restaurants", "average_ticket", 0.01, "average_ticket IS NULL", "restaurants"),
        check("consumers: customer_id is not null", "error",
              "count(*) FILTER (customer_id IS NULL)", "count(*)", "consumers"),
        check("consumers: (customer_id) is unique", "error",
              "(count(*) - count(DISTINCT customer_id))", "count(*)", "consumers"),
        check("restaurants: (id) is unique", "error",
              "(count(*) - count(DISTINCT id))", "count(*)", "restaurants"),
        check("assignment: customer_id is not null", "error",
              "count(*) FILTER (customer_id IS NULL)", "count(*)", "assignment"),
        check("assignment: one row per user", "error", "count(*) FILTER (n > 1)", "count(*)",
              "(SELECT count(*) AS n FROM assignment GROUP BY customer_id)"),
        check("assignment: one arm per user", "error", "count(*) FILTER (n > 1)", "count(*)",
              "(SELECT count(DISTINCT is_target) AS n FROM assignment GROUP BY customer_id)"),
        check("buyers are consumers", "warning", not_in("feed", "consumers"),
              "count(DISTINCT customer_id)", "feed"),
        check("buyers are assigned", "warning", not_in("feed", "assignment"),
              "count(DISTINCT customer_id)", "feed"),
        check("cleaned orders: (order_id) is unique", "error", "0", _DISTINCT_ORDERS, "feed"),
    ),
    "duplicate_keys": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
        GROUP BY ALL HAVING count(*) > 1""",
    "duplicate_sample": """
        SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM lineitem
        WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem
            GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        ORDER BY l_orderkey, l_linenumber, l_shipdate DESC, l_partkey, l_suppkey LIMIT 10""",
    "dedup_latest": """SELECT * FROM lineitem QUALIFY row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice,
            l_discount, l_tax, l_returnflag, l_linestatus) = 1""",
    "orphan_orders": """SELECT DISTINCT o_orderkey FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "coverage": with_("feed", "users", "consumers")
    + union_all(
        pair("buyers in the experiment", "feed", "customer_id", "users", "customer_id"),
        pair("users with orders", "users", "customer_id", "feed", "customer_id"),
        pair("consumers in the experiment", "consumers", "customer_id", "users", "customer_id"),
        pair("orders with lines", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    ),
    "experiment_integrity": with_("feed", "users", "consumers")
    + f"""SELECT total AS users, matched AS users_with_orders,
        total - matched AS users_without_orders,
        {grid('matched / total * 100', 6, 'users_with_orders_pct')},
        known AS consumers_in_experiment, everyone - known AS consumers_not_in_experiment,
        {not_in('feed', 'consumers')} AS buyers_not_in_consumers,
        {not_in('feed', 'users')} AS buyers_not_in_experiment,
        (SELECT count(*) FROM (SELECT 1 FROM users GROUP BY customer_id HAVING count(*) > 1))
          AS users_in_several_arms
        FROM (SELECT count(*) AS total,
            count(*) FILTER (customer_id IN (SELECT customer_id FROM feed)) AS matched,
            count(*) FILTER (customer_id IN (SELECT customer_id FROM consumers)) AS known,
            (SELECT count(DISTINCT customer_id) FROM consumers) AS everyone
        FROM users)""",
    "arm_sizes": with_("users") + "SELECT arm, count(*) AS users FROM users GROUP BY arm",
    "order_period": with_("feed")
    + """SELECT min(order_created_at) AS first_order_at,
        max(order_created_at) AS last_order_at FROM feed""",
    "cart_features": with_("feed_carts")
    + f"SELECT order_id, merchant_id, order_created_at, {features()} FROM feed_carts",
    "cart_edge_cases": _EDGE_CARTS,
    "abt": with_("abt") + f"SELECT {_ABT_COLUMNS} FROM abt",
    "abt_hot_customers": with_("abt") + f"SELECT {_ABT_COLUMNS} FROM abt",
    "event_history": f"""
        SELECT event_id, ts, user_id, value, previous AS previous_order_at,
            CAST(date_diff('day', CAST(previous AS DATE), CAST(ts AS DATE)) AS INTEGER)
              AS days_since_last_order,
            {grid('prior_mean', 4, 'prior_mean_spend')}
        FROM (SELECT *, lag(ts) OVER ({_EVENT_WINDOW}) AS previous,
            avg(value) OVER ({_EVENT_WINDOW}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_mean
            FROM events)""",
    "event_ordinal": """SELECT event_id, ts, user_id, event_type, CAST(row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS nth
        FROM events""",
    "event_day_period": """SELECT event_id,
        CASE hour(ts) // 6 WHEN 1 THEN 'morning' WHEN 2 THEN 'afternoon' WHEN 3 THEN 'evening'
            WHEN 0 THEN 'night' END AS day_period FROM events""",
    "event_day_period_zoned": """
        SELECT event_id, zone, CASE WHEN moment IS NOT NULL THEN period END AS day_period,
            period AS legacy_day_period
        FROM (SELECT *, CASE hour(moment) // 6 WHEN 1 THEN 'morning' WHEN 2 THEN 'afternoon'
                WHEN 3 THEN 'evening' ELSE 'night' END AS period
            FROM (SELECT event_id, zones[user_id % 3 + 1] AS zone,
                CASE WHEN event_id % 10 <> 0 THEN ts + to_minutes(shifts[user_id % 3 + 1]) END AS moment
                FROM events, (SELECT ['UTC', 'America/Sao_Paulo', 'Asia/Kolkata'] AS zones,
                    [0, -180, 330] AS shifts)))""",
    "user_kpis": with_("kpis") + f"SELECT customer_id, {_KPI_COLUMNS} FROM kpis",
    "retention_flags": with_("flags")
    + """SELECT customer_id, first_order_at, second_order_at, is_retained_7d, is_retained_14d
        FROM flags""",
    "user_spine": with_("spine")
    + f"""SELECT customer_id, arm, {_KPI_COLUMNS}, is_retained_7d, is_retained_14d
        FROM spine""",
    "segment_spine": with_("segmented")
    + f"""SELECT customer_id, lifecycle_segment, arm, {_KPI_COLUMNS}, is_retained_7d,
        is_retained_14d FROM segmented""",
    "user_metrics": with_("spine", "segments")
    + f"""SELECT customer_id, arm, {_KPI_COLUMNS}, is_retained_7d, is_retained_14d,
        lifecycle_segment FROM spine LEFT JOIN segments USING (customer_id)""",
    "kpi_summary_by_arm": with_("spine") + summary("spine", "arm"),
    "kpi_summary_conditional": with_("conditional")
    + summary("conditional", "arm", counts=True),
    "lifecycle_segments": with_("segments") + "SELECT * FROM segments",
    "lifecycle_segments_at_launch": with_("abt")
    + f"""SELECT a.*, b.lifecycle_segment AS bounded_segment
        FROM ({segments('abt', LAUNCH)}) a
        JOIN ({segments('abt', LAUNCH, bounded=True)}) b USING (customer_id)""",
    "lifecycle_segments_of_events": segments(
        "(SELECT user_id AS customer_id, ts AS order_created_at FROM events "
        "WHERE event_type = 'purchase')",
        EVENTS_END,
        active=7,
        risk=(8, 20),
    ),
    "kpi_summary_by_segment": with_("segmented")
    + summary("segmented", "lifecycle_segment, arm", BY_SEGMENT),
    "ttest_by_arm": with_("spine") + ttest("spine", METRICS),
    "ttest_by_arm_converted_n": with_("spine")
    + ttest(
        "spine",
        METRICS,
        n=lambda name, _: "count(*) FILTER (order_count > 0)"
        if name in OF_CONVERTED
        else "count(*)",
    ),
    "ttest_by_arm_welch": with_("conditional")
    + ttest(
        "conditional", METRICS, n=lambda _, measure: f"count({measure})", equal_var=False
    ),
    "ttest_by_segment": with_("segmented")
    + ttest("segmented", SEGMENT_TESTS, by="lifecycle_segment"),
    "ttest_by_segment_control_n": with_("segmented")
    + ttest(
        "segmented",
        SEGMENT_TESTS,
        by="lifecycle_segment",
        n=lambda name, _: "count(*) FILTER (order_count > 0)"
        if name in OF_CONVERTED
        else "count(*)",
        control_n_only=True,
    ),
}

# The whole job, read back from its gold tables, must say what its parts say.
ORACLE["pipeline_summary_by_arm"] = ORACLE["kpi_summary_by_arm"]
ORACLE["pipeline_ttest_by_arm"] = ORACLE["ttest_by_arm"]
ORACLE["pipeline_ttest_by_segment"] = ORACLE["ttest_by_segment"]
ORACLE["pipeline_integrity"] = ORACLE["experiment_integrity"]
