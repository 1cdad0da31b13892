"""Display labels: translation lookup, status colours, message templates.

Codes (``critical``, ``high``, ``expired`` ...) are the keys everywhere; text is
attached last. Lookups are map literals evaluated on the executors (no join).
Unknown language falls back to Spanish, then a missing key to ``[key]``.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.sources.literals import literal_table

DEFAULT_LANG = "es"

# Data-bearing label templates, Spanish then English, as in the source.
TRANSLATIONS = {
    "es": {
        "status_critical": "🔴 Crítico",
        "status_warning": "🟠 Advertencia",
        "status_attention": "🟡 Atención",
        "status_optimal": "🟢 Óptimo",
        "col_status": "Estado",
        "col_days_remaining": "Días Restantes",
        "col_product": "Producto",
        "col_lot_code": "Código de Lote",
        "col_expiration": "Vencimiento",
        "rec_type_expired": "Lote Caducado",
        "rec_type_waste_risk": "Riesgo Alto de Merma",
        "rec_type_stockout_risk": "Riesgo de Quiebre de Stock",
        "rec_metric_expired": "{qty} items caducados (hace {days} días).",
        "rec_metric_expiring": "{qty} items vencen en {days} días.",
        "rec_metric_stockout": "Stock Total: {stock:.0f} | Consumo Semanal: {consumo:.1f}",
        "rec_action_expired": "Retirar de inventario y desechar inmediatamente.",
        "rec_action_expiring": "Usar urgente o donar. Priorizar en próximos vuelos.",
        "rec_action_stockout": "Reabastecer pronto. Inventario actual está por debajo del 50% del consumo.",
        "rec_lote_all": "N/A (Todos los lotes)",
        "prio_high": "Alta",
        "prio_medium": "Media",
        "prio_low": "Baja",
        "col_remaining_qty": "Cantidad Restante",
    },
    "en": {
        "status_critical": "🔴 Critical",
        "status_warning": "🟠 Warning",
        "status_attention": "🟡 Attention",
        "status_optimal": "🟢 Optimal",
        "col_status": "Status",
        "col_days_remaining": "Days Remaining",
        "col_product": "Product",
        "col_lot_code": "Lot Code",
        "col_expiration": "Expiration",
        "rec_type_expired": "Expired Lot",
        "rec_type_waste_risk": "High Risk of Waste",
        "rec_type_stockout_risk": "Risk of Stockout",
        "rec_metric_expired": "{qty} items expired ({days} days ago).",
        "rec_metric_expiring": "{qty} items expire in {days} days.",
        "rec_metric_stockout": "Total Stock: {stock:.0f} | Weekly Consumption: {consumo:.1f}",
        "rec_action_expired": "Remove from inventory and discard immediately.",
        "rec_action_expiring": "Use urgently or donate. Prioritize on upcoming flights.",
        "rec_action_stockout": "Restock soon. Current inventory is below 50% of consumption.",
        "rec_lote_all": "N/A (All lots)",
        "prio_high": "High",
        "prio_medium": "Medium",
        "prio_low": "Low",
        "col_remaining_qty": "Remaining Qty",
    },
}

# Status colours and the default colour.
STATUS_COLORS = {
    "critical": "#d9534f",
    "warning": "#f0ad4e",
    "attention": "#E5C100",
    "optimal": "#5cb85c",
}
DEFAULT_COLOR = "#000000"

# Rule code -> label keys of (type, metric, action).
RULE_KEYS = {
    "expired": ("rec_type_expired", "rec_metric_expired", "rec_action_expired"),
    "waste_risk": ("rec_type_waste_risk", "rec_metric_expiring", "rec_action_expiring"),
    "stockout_risk": ("rec_type_stockout_risk", "rec_metric_stockout", "rec_action_stockout"),
}


def translations_df(spark: SparkSession) -> DataFrame:
    rows = [(lang, k, v) for lang, d in TRANSLATIONS.items() for k, v in d.items()]
    return literal_table(spark, rows, "lang string, key string, template string")


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def _label_map() -> Column:
    return _map({f"{lang}|{k}": v for lang, d in TRANSLATIONS.items() for k, v in d.items()})


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x)


def label(lang, key) -> Column:
    """template for (lang, key); unknown lang -> es; missing key -> '[key]'."""
    m = _label_map()
    lang_c, key_c = _c(lang), _c(key)
    return F.coalesce(
        F.try_element_at(m, F.concat(lang_c, F.lit("|"), key_c)),
        F.try_element_at(m, F.concat(F.lit(DEFAULT_LANG + "|"), key_c)),
        F.concat(F.lit("["), key_c, F.lit("]")),
    )


def status_label(status, lang=DEFAULT_LANG) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return label(lang, F.concat(F.lit("status_"), s))


def status_color(status) -> Column:
    """colour of a status code, default black."""
    s = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.try_element_at(_map(STATUS_COLORS), s), F.lit(DEFAULT_COLOR))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """replace ``{name}`` / ``{name:fmt}`` placeholders with pre-formatted text."""
    out = template
    for name, v in values.items():
        out = F.regexp_replace(out, r"\{" + name + r"(:[^}]*)?\}", v)
    return out


def recommendations_text(recs: DataFrame, lang: str = DEFAULT_LANG) -> DataFrame:
    """Recommendation rows with display text (priority, type, lot, metric, action)."""
    rule = F.col("rule")

    def key_of(i):
        e = None
        for code, keys in RULE_KEYS.items():
            e = F.when(rule == code, F.lit(keys[i])) if e is None else e.when(rule == code, F.lit(keys[i]))
        return e

    metric = fill(
        label(lang, key_of(1)),
        {
            "qty": F.coalesce(F.col("qty").cast("string"), F.lit("")),
            "days": F.coalesce(F.abs(F.col("days_remaining")).cast("string"), F.lit("")),
            "stock": F.coalesce(F.col("stock").cast("string"), F.lit("")),
            "consumo": F.coalesce(F.format_string("%.1f", F.col("avg_weekly")), F.lit("")),
        },
    )
    return recs.select(
        "rule",
        "product_id",
        "lot_id",
        label(lang, F.concat(F.lit("prio_"), F.col("priority"))).alias("priority_text"),
        label(lang, key_of(0)).alias("type_text"),
        "product_name",
        F.coalesce(F.col("lot_number"), label(lang, F.lit("rec_lote_all"))).alias("lot_text"),
        metric.alias("metric_text"),
        label(lang, key_of(2)).alias("action_text"),
    )


def days_from_text(metric: str | Column) -> Column:
    """days parsed back from a metric text; 'expired'/'caducados' -> negative;
    no number of days -> 999."""
    m = F.col(metric) if isinstance(metric, str) else metric
    n = F.regexp_extract(m, r"(\d+)\s+(days|días)", 1)
    expired = m.contains("expired") | m.contains("caducados")
    return F.when(n == "", F.lit(999)).otherwise(
        F.when(expired, -n.cast("int")).otherwise(n.cast("int"))
    )


AUDIT_HEADERS = {
    "status": "col_status",
    "days_remaining": "col_days_remaining",
    "product_name": "col_product",
    "lot_number": "col_lot_code",
    "current_qty": "col_remaining_qty",
    "expiry_date": "col_expiration",
}


def header(lang: str, key: str) -> str:
    """Column header text (driver side: a constant, not data)."""
    d = TRANSLATIONS.get(lang, TRANSLATIONS[DEFAULT_LANG])
    return d.get(key, TRANSLATIONS[DEFAULT_LANG].get(key, f"[{key}]"))


def lot_audit_display(inventory: DataFrame, lang: str = DEFAULT_LANG) -> DataFrame:
    """P13 + F4 + F19: audit table with translated status, ISO dates, display headers."""
    cols = {
        "status": status_label("status", lang),
        "days_remaining": F.col("days_remaining"),
        "product_name": F.col("product_name"),
        "lot_number": F.col("lot_number"),
        "current_qty": F.col("current_qty"),
        "expiry_date": F.col("expiry_date").cast("string"),
    }
    return inventory.select(*[c.alias(header(lang, AUDIT_HEADERS[k])) for k, c in cols.items()])
