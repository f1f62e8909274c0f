"""DataFrame -> DataFrame operators, column names as arguments."""

from .aggregate import (distinct_in_order, distinct_sorted, group_count, group_total, group_value,
                        next_row_id, rollup_to, share_of_total, summary_totals)
from .changes import (append_and_collapse, apply_buttons, apply_quantity_events, collapse_exact, collapse_items,
                      net_and_floor, running_quantity, upsert_items, upsert_with_rejects)
from .filters import (drop_columns, drop_null, filter_eq, filter_in, filter_two_step, has_column, having_gt,
                      is_empty, rename, select_columns, validate_items)
from .joins import complete_domain, left_join_nullsafe, remove_rows, split_matches
from .lookup import enrich_distinct, price_by_rule_table, rules_frame
from .ordering import (anonymise, append_rows, first_per_key, rank_groups, search_filter, sort_view,
                       table_page, with_buckets, with_chunks, with_row_id)

__all__ = [n for n in dir() if not n.startswith("_")]
