"""Relational sink."""

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    properties: Mapping[str, str],
    *,
    connections: int = 16,
    batch_size: int = 10_000,
) -> None:
    """Replace a database table by the rows of ``df``.

    ``connections`` bounds the load on the database; the rows are dealt out to as many tasks, so
    that what computes them keeps its own number of tasks. Each task commits once. A task lost after its commit is run again, so load a keyed table
    (``truncate=true`` in the properties keeps its definition) where that must not show.
    """
    options = {"numPartitions": str(connections), "batchsize": str(batch_size), **properties}
    df.repartition(connections).write.jdbc(url, table, mode="overwrite", properties=options)
