"""Where the values of a record come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldrec.schema import PROVENANCE


def provenance(source: str, raw: dict[str, Column], when: Column | None = None) -> Column:
    """An entry per field whose raw value (as text) isn't null, in that order; `when` is the run's time, if it is told."""
    at = F.lit(None).cast("timestamp") if when is None else when
    entries = [F.when(c.isNotNull(), F.struct(F.lit(n).alias("field"), F.lit(source).alias("source"), c.cast("string").alias("raw_value"), at.alias("extracted_at"))) for n, c in raw.items()]
    return F.array_compact(F.array(*entries)).cast(f"array<{PROVENANCE}>")
