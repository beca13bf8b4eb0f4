from .tables import (  # noqa: F401
    align_columns, categorical_columns, drop_cols, find_target, load_table, nan_to_null, numeric_columns,
    read_table, select_dtypes,
)
