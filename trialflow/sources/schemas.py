"""The four feeds' schemas and their timestamp text."""

TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

ORDERS = """
    cpf string, customer_id string, customer_name string,
    delivery_address_city string, delivery_address_country string,
    delivery_address_district string, delivery_address_external_id string,
    delivery_address_latitude string, delivery_address_longitude string,
    delivery_address_state string, delivery_address_zip_code string,
    items string, merchant_id string, merchant_latitude string, merchant_longitude string,
    merchant_timezone string, order_created_at timestamp, order_id string,
    order_scheduled boolean, order_total_amount double, origin_platform string,
    order_scheduled_date timestamp
"""

CONSUMERS = """
    customer_id string, language string, created_at timestamp, active boolean,
    customer_name string, customer_phone_area string, customer_phone_number string
"""

RESTAURANTS = """
    id string, created_at timestamp, enabled boolean, price_range int,
    average_ticket double, delivery_time double, minimum_order_value double,
    merchant_zip_code string, merchant_city string, merchant_state string,
    merchant_country string
"""

AB_TEST_USERS = "customer_id string, is_target string"
