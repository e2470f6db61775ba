"""Normalisation of arriving records: the stateless head of the plan runs on a stream as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame

from matchloom.operators import records


def prepared_stream(arriving: DataFrame) -> DataFrame:
    """Normalised columns and key sets of a streaming (or plain) DataFrame of source records."""
    return records.with_keys(records.prepare(arriving))
