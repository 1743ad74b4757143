"""Column-expression helpers (built-in Spark SQL functions only)."""

from kilowatt.functions.calendar import CALENDAR_FIELDS, calendar_columns, truncate
from kilowatt.functions.metrics import metrics_from_sums, regression_sums
from kilowatt.functions.text import java_tokens, lines, words
from kilowatt.functions.vectors import squared_distance, to_array, to_vector

__all__ = [
    "CALENDAR_FIELDS",
    "calendar_columns",
    "truncate",
    "metrics_from_sums",
    "regression_sums",
    "java_tokens",
    "lines",
    "words",
    "squared_distance",
    "to_array",
    "to_vector",
]
