"""Column expressions used across operators. Every helper returns a built-in
``Column`` expression, so it stays inside whole-stage codegen (no Python UDFs)."""

from trolley.functions.calendar import iso_week, month_of, week_start, weekday0, date_text
from trolley.functions.numeric import round_even
from trolley.functions.labels import (
    FEATURE_LABELS, FEATURES, LEVEL_LABELS, DAY_NAMES, MONTH_NAMES, level_label,
    product_label, customer_label, rule_text, day_name, month_name,
)

__all__ = [
    "iso_week", "month_of", "week_start", "weekday0", "date_text",
    "round_even",
    "FEATURE_LABELS", "FEATURES", "LEVEL_LABELS", "DAY_NAMES", "MONTH_NAMES", "level_label",
    "product_label", "customer_label", "rule_text", "day_name", "month_name",
]
