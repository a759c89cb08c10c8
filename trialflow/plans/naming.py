"""Column and table names for readers of the tables this job's predecessor wrote.

Fixed values: every name and label below is part of a stored table's contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ABT_NAMES = {
    "arm": "ab_group",
    "day_period": "periodo_do_dia",
    "item_quantity": "quantidade_total_de_itens",
    "mean_item_price": "preco_medio_por_item",
    "max_item_price": "item_mais_caro_no_carrinho",
    "item_price_spread": "desvio_padrao_preco_itens",
    "max_item_share_pct": "percentual_valor_item_mais_caro",
    "had_restaurant_discount": "pedido_teve_desconto_restaurante",
    "days_since_last_order": "dias_desde_ultimo_pedido",
    "prior_mean_spend": "gasto_medio_historico_cliente",
    "restaurant_visit_no": "frequencia_cliente_no_restaurante",
    "customer_age_days": "dias_cliente_ativo_no_pedido",
    "ticket_ratio": "relacao_pedido_ticket_medio",
}

DAY_PERIOD_LABELS = {
    "morning": "Manhã",
    "afternoon": "Tarde",
    "evening": "Noite",
    "night": "Madrugada",
}

SUMMARY_NAMES = {
    "arm": "ab_group",
    "revenue_per_user": "receita_por_cliente",
    "stddev_revenue_per_user": "stddev_receita_por_cliente",
    "order_frequency": "frequencia_media_pedidos",
    "stddev_order_frequency": "stddev_frequencia_media_pedidos",
    "avg_ticket": "ticket_medio",
    "stddev_avg_ticket": "stddev_ticket_medio",
    "retention_7d_pct": "taxa_retencao_7d_pct",
    "stddev_retention_7d_pct": "stddev_retencao_7d",
    "retention_14d_pct": "taxa_retencao_14d_pct",
    "stddev_retention_14d_pct": "stddev_retencao_14d",
    "items_per_order": "itens_por_pedido",
    "stddev_items_per_order": "stddev_itens_por_pedido",
    "days_to_reorder": "tempo_medio_para_proxima_compra",
    "stddev_days_to_reorder": "stddev_tempo_medio_para_proxima_compra",
    "new_restaurant_rate_pct": "taxa_pedidos_novos_restaurantes_pct",
    "stddev_new_restaurant_rate_pct": "stddev_taxa_pedidos_novos_restaurantes_pct",
    "users": "total_usuarios",
    "converted_users": "usuarios_convertidos",
}


def legacy_abt(abt: DataFrame) -> DataFrame:
    """The ABT under its contract names and labels."""
    labels = F.create_map(*[F.lit(x) for pair in DAY_PERIOD_LABELS.items() for x in pair])
    return abt.withColumn("day_period", labels[F.col("day_period")]).withColumnsRenamed(
        ABT_NAMES
    )


def legacy_summary(summary: DataFrame) -> DataFrame:
    """An arm or segment summary under its contract names."""
    return summary.withColumnsRenamed(SUMMARY_NAMES)


def own_names(df: DataFrame) -> DataFrame:
    """A stored table under this package's column names, whichever names it was stored under."""
    return df.withColumnsRenamed(
        {
            stored: own
            for own, stored in {**ABT_NAMES, **SUMMARY_NAMES}.items()
            if own not in df.columns
        }
    )


def own_abt(abt: DataFrame) -> DataFrame:
    """A stored ABT under this package's names and labels."""
    own = {stored: label for label, stored in DAY_PERIOD_LABELS.items()}
    labels = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    period = F.col("day_period")
    return own_names(abt).withColumn("day_period", F.coalesce(labels[period], period))


def same_naming(columns: list[str], legacy: bool) -> bool:
    """Whether a stored summary has the contract names (``legacy``) or this package's."""
    return (SUMMARY_NAMES["arm"] in columns) == legacy
