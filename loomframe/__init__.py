"""loomframe: an expression dataframe engine on Spark."""

from loomframe import types
from loomframe.errors import ColumnNotFoundError, ComputeError, FrameError, InvalidArgumentError, SchemaError, ShapeError, StreamError
from loomframe.functions import all, coalesce, col, duration, element, exclude, implode, lit, seq_range, struct, when  # noqa: A004
from loomframe.functions.expr import Expr
from loomframe.operators.concat import concat
from loomframe.operators.frame import Frame, Grouped
from loomframe.sources.csv import read_csv, scan_csv
from loomframe.sources.json import read_json, scan_json
from loomframe.sources.memory import data
from loomframe.sources.parquet import from_spark, read_parquet

__all__ = [
    "ColumnNotFoundError", "ComputeError", "Expr", "Frame", "FrameError", "Grouped", "InvalidArgumentError", "SchemaError", "ShapeError", "StreamError",
    "all", "coalesce", "col", "concat", "data", "duration", "element", "exclude", "from_spark", "implode", "lit", "read_csv", "read_json", "read_parquet",
    "scan_csv", "scan_json", "seq_range", "struct", "types", "when",
]
