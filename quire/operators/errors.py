"""Errors and the exit codes that go with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_NOT_FOUND, UNSUPPORTED, OUT_OF_BOUNDS, CONVERSION_FAILED, TOO_LARGE, IO_ERROR, STRICT = 2, 3, 4, 5, 6, 7, 8


def exit_code(status: Column) -> Column:
    """The exit code of a status that readers give."""
    return F.when(status == "ok", 0).when(status.startswith("unsupported format"), UNSUPPORTED).when(status == "input too large", TOO_LARGE).when(status.startswith("out of bounds"), OUT_OF_BOUNDS).otherwise(CONVERSION_FAILED)
