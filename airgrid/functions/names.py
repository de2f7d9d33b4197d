"""Names of inner columns that no column of the caller has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(want: str, *frames: DataFrame) -> str:
    """want, with underscores until no column of the frames is named so in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while want.lower() in taken:
        want += "_"
    return want
