"""User functions over batches of rows."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A text takes up to four times its bytes as a Python string.
BATCH_BYTES = 8 << 20


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    new_fields: T.StructType | str,
    remove_columns: Sequence[str] = (),
) -> DataFrame:
    """Apply ``fn`` to Arrow batches; it returns the new columns of each batch.

    The other columns are kept except those in ``remove_columns``.  Batches have
    at most ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows and, as the session is
    set to that, not much more than ``BATCH_BYTES``: Python's memory does not follow the
    length of the texts.  Nothing is shuffled.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if isinstance(new_fields, str):
        new_fields = T.StructType.fromDDL(new_fields)
    added = new_fields.names
    kept = [f for f in df.schema.fields if f.name not in {*remove_columns, *added}]
    names = [f.name for f in kept]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = fn(batch)
            yield batch[names].assign(**{name: new[name].to_numpy() for name in added})
            # A column whose ``.str`` was used holds itself, so its texts would stay until
            # Python looks for cycles, which many texts in few objects do not make it do.
            del batch, new
            gc.collect()

    return df.mapInPandas(run, T.StructType(kept + new_fields.fields))
