"""Writers that can be run twice."""
from barwright.sinks.files import (
    append_new,
    append_rows,
    drop_partitions,
    merge_partitions,
    overwrite_partitions,
    overwrite_table,
    partition_values,
    write_formats,
)
from barwright.sinks.jdbc import write_jdbc
from barwright.sinks.landing import envelopes, land_envelopes, land_texts

__all__ = [
    "append_new",
    "append_rows",
    "drop_partitions",
    "envelopes",
    "land_envelopes",
    "land_texts",
    "merge_partitions",
    "overwrite_partitions",
    "overwrite_table",
    "partition_values",
    "write_formats",
    "write_jdbc",
]
