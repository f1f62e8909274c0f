"""Column functions: every one returns a Catalyst expression (no Python UDF)."""

from .categories import (DEFAULT_COUNTY_OF_LOCATION, DEFAULT_SECTION_GROUPS, YES_NO_LABELS,
                         combine_sections, fill_default, map_or_self, map_values)
from .money import (annualise, format_money, line_value, money_product_sum, money_sum,
                    parse_money, parse_money_column)
from .pricing import (DEFAULT_PRICE_RULES, clean_model, estimate_price, first_number,
                      keyword_pattern, price_by_rules)
from .text import (dashes_to_dots, flag_contains, match_key, parse_event, slug, slug_col,
                   split_phone, squish, trim_ws)

__all__ = [n for n in dir() if not n.startswith("_")]
