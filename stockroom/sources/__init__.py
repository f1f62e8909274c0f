"""Sources and sinks: CSV exports, table snapshots, GeoJSON domains."""

from .layout import flatten_sections
from .pending import fold_pending
from .readers import from_rows, load_table, read_export, read_feature_names, read_parquet, read_table
from .sinks import (SnapshotConflict, applied_batches, export_name, export_view, prune_snapshots, read_ledger, read_snapshot, snapshot_versions, update_snapshot, write_csv,
                    write_snapshot)

__all__ = [n for n in dir() if not n.startswith("_")]
