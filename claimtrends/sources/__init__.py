from .claims_csv import (
    CheckedClaims,
    export_csv,
    read_checked_claims,
    read_claim_files,
    read_claims,
    read_raw_csvs,
)
from .session import configure, shared_folder, use_folder
from .snapshots import Commit, Conflict, Store, input_files
from .sql_functions import register_functions
from .tables import (
    checkpoint_table,
    load_forecasts,
    materialize,
    new_path,
    read_parquet,
    register_views,
    save_forecasts,
    stage_counts,
    stage_tables,
    store,
    write_parquet,
)

__all__ = [
    "CheckedClaims", "Commit", "Conflict", "Store", "checkpoint_table", "configure", "export_csv", "input_files", "load_forecasts", "materialize",
    "new_path", "read_checked_claims", "read_claim_files", "read_claims", "read_parquet", "read_raw_csvs",
    "register_functions", "register_views",
    "save_forecasts", "shared_folder", "stage_counts", "stage_tables", "store", "use_folder",
    "write_parquet",
]
