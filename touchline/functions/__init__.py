"""Column -> Column helpers (all JVM-side built-in expressions, no UDFs)."""

from touchline.functions.semantics import (  # noqa: F401
    pandas_div, not_equal_keep_null, is_member, percent_of, sum_or_zero, all_of,
)
from touchline.functions.json_paths import parse_json_column, extract_fields, field  # noqa: F401
from touchline.functions.attribution import (  # noqa: F401
    classify_source, match_type, within_lookback, UNITS_PER_SECOND,
)
from touchline.functions.text import (  # noqa: F401
    money, to_number, to_int_strict, to_int_lenient, to_day, month_start_text,
    month_start_date, epoch_seconds, log1p_positive, trunc_int, money_text, fixed_text,
)
