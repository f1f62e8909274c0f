"""stockroom: inventory and contract analytics as Spark DataFrame plans.

Every public function takes and returns DataFrames (or Columns) and names the
columns it works on, so each step runs unchanged on any table size.
"""

__version__ = "0.1.0"
