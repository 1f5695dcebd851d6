"""What a user is told of an error row or of a fault in the configuration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldrec.operators.projection import ProjectionError
from goldrec.plans.config import ConfigError

#: error_type -> what its message begins with.
TOLD = {
    "FileNotFoundError": "No such file",
    "FileReadError": "The file can't be read",
    "UnsupportedFormatError": "The file is of no known format",
    "InvalidJSONError": "The file is not valid JSON",
    "SchemaValidationError": "The document has not the expected shape",
    "TextExtractionError": "No text could be taken from the file",
    "MappingError": "The record breaks a constraint",
    "MergeError": "The sources can't be merged",
    "NormalizationError": "The record can't be normalized",
    "ValidationError": "The record is not valid",
    "ProjectionError": "The record can't be projected",
    "ConfigError": "The configuration is wrong",
}
OTHER = "Something unexpected went wrong (--debug shows more)"


def message(error_type: Column, detail: Column) -> Column:
    """A sentence for an error row; null where error_type is null."""
    known = F.create_map(*(F.lit(x) for pair in TOLD.items() for x in pair))
    told = F.coalesce(F.try_element_at(known, error_type), F.lit(OTHER))
    return F.when(error_type.isNotNull(), F.concat_ws(": ", told, detail))


def of_exception(error: Exception) -> str:
    name = "ConfigError" if isinstance(error, ConfigError) else "ProjectionError" if isinstance(error, ProjectionError) else type(error).__name__
    return f"{TOLD[name]}: {error}" if name in TOLD else OTHER
