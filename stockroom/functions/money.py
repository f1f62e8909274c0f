"""Money and arithmetic column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ._util import as_col

# A number as pandas.to_numeric accepts it after '$' and ',' are removed.
# The guard keeps try_cast from taking Java-only forms such as '5d' or 'NaN'.
_NUMERIC = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"

# Exact accumulator for money sums: float sums depend on the order rows arrive.
# Ten digits after the point keep sub-cent prices and fractional quantities.
MONEY_DECIMAL = "decimal(38,10)"


def parse_money(col) -> Column:
    """``'$1,234.56'`` -> 1234.56; unparsable text -> null."""
    s = F.translate(as_col(col).cast("string"), "$,", "")
    return F.when(s.rlike(_NUMERIC), F.trim(s).try_cast("double"))


def parse_money_column(df: DataFrame, name: str) -> Column:
    """C4 on a named column; a column that is already numeric passes through."""
    if isinstance(df.schema[name].dataType, NumericType):
        return F.col(name).cast("double")
    return parse_money(name)


def format_money(col) -> Column:
    """1234.5 -> ``'$1,234.50'``; a negative number prints as ``'$-5.00'``."""
    return F.concat(F.lit("$"), F.format_number(as_col(col), 2))


def annualise(col, months: int = 12) -> Column:
    return as_col(col) * F.lit(months)


def line_value(qty, price) -> Column:
    """Quantity x unit price; a null operand gives null."""
    return as_col(qty) * as_col(price)


def money_sum(col) -> Column:
    """Order-independent sum of a money column, returned as double."""
    return F.sum(as_col(col).cast(MONEY_DECIMAL)).cast("double")


def money_product_sum(qty, price) -> Column:
    """Order-independent sum of qty x price, multiplied before any rounding,
    returned as double."""
    return F.sum((as_col(qty).cast("double") * as_col(price).cast("double")).cast(MONEY_DECIMAL)).cast("double")
