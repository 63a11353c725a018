"""Sources and sinks."""

from weft.sources.readers import (
    conform,
    from_dict,
    from_pandas,
    from_partitions,
    from_sequence,
    number_range,
    read_blocks,
    read_csv,
    read_parquet,
    read_state,
    table,
    text_lines,
    time_series,
    write_state,
)
from weft.sources.shared import remove, shared_folder, stored

__all__ = [
    "conform",
    "from_dict",
    "from_pandas",
    "from_partitions",
    "from_sequence",
    "number_range",
    "read_blocks",
    "read_csv",
    "read_parquet",
    "read_state",
    "remove",
    "shared_folder",
    "stored",
    "table",
    "text_lines",
    "time_series",
    "write_state",
]
