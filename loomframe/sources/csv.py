"""CSV, from text or files, with types found in one pass over the data, and back."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import InvalidArgumentError, StreamError
from loomframe.functions.spec import ROW
from loomframe.sources.memory import coerced, session

#: Texts that stand for null.
NULLS = ("", "NA", "null", "NaN")
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def split_rows(text: str, separator: str, quote: str) -> list[list[str]]:
    """Rows of CSV text: quotes doubled inside quotes, any line end, a byte order mark, blank lines left out."""
    text = text.removeprefix("﻿")
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    i, n, inside, any_quote = 0, len(text), False, False

    def end_row() -> None:
        nonlocal row, cell, any_quote
        row.append("".join(cell))
        if len(row) > 1 or row[0].strip() or any_quote:
            rows.append(row)
        row, cell, any_quote = [], [], False

    while i < n:
        c = text[i]
        if inside:
            if c != quote:
                cell.append(c)
            elif text[i + 1 : i + 2] == quote:
                cell.append(quote)
                i += 1
            else:
                inside = False
        elif c == quote and not cell:
            inside = any_quote = True
        elif text.startswith(separator, i):
            row.append("".join(cell))
            cell = []
            i += len(separator) - 1
        elif c in "\r\n":
            end_row()
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
        else:
            cell.append(c)
        i += 1
    if cell or row or any_quote:
        end_row()
    return rows


def typed(df: DataFrame) -> DataFrame:
    """Text columns as boolean, integer, double or timestamp if all their values are: one aggregate over the frame decides."""
    names = [c for c in df.columns if c != ROW]
    tests = []
    for i, n in enumerate(names):
        c = F.btrim(F.col(f"`{n}`"))
        tests += [
            F.bool_and(F.lower(c).isin("true", "false", "1", "0")).alias(f"b{i}"),
            F.bool_and(F.when(c.isNotNull(), c.rlike(r"^[+-]?[0-9]{1,19}$") & c.try_cast("bigint").isNotNull())).alias(f"i{i}"),
            F.bool_and(c.rlike(NUMBER)).alias(f"f{i}"),
            F.bool_and(F.when(c.isNotNull(), c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+([zZ]|[+-][0-9:]+)?)?$") & LT.parse_timestamp(c, T.StringType()).isNotNull())).alias(f"t{i}"),
        ]
    found = df.agg(*tests).first() if names else None
    out: list[Column] = []
    for i, n in enumerate(names):
        c = F.btrim(F.col(f"`{n}`"))
        if found[f"b{i}"]:
            v = F.lower(c).isin("true", "1")
            v = F.when(c.isNotNull(), v)
        elif found[f"i{i}"]:
            v = c.cast("bigint")
        elif found[f"f{i}"]:
            v = c.cast("double")
        elif found[f"t{i}"]:
            v = LT.parse_timestamp(c, T.StringType())
        else:
            v = F.col(f"`{n}`")
        out.append(v.alias(n))
    return df.select(*out, *([F.col(ROW)] if ROW in df.columns else []))


def nulled(df: DataFrame, nulls: Any) -> DataFrame:
    listed = list(nulls)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(listed), F.col(f"`{c}`")).alias(c) if c != ROW else F.col(c) for c in df.columns])


def read_csv(content: str, *, has_header: bool = True, separator: str = ",", quote_char: str = '"', null_values: Any = NULLS, schema: dict | None = None, infer_schema: bool = True):
    """A frame from CSV text. Short rows end in nulls, long ones are cut. Without a header columns are column_0, column_1..."""
    from loomframe.operators.frame import Frame

    rows = split_rows(content, separator, quote_char)
    if not rows:
        names, body = list(schema or {}), []
    elif has_header:
        names, body = [c.strip() for c in rows[0]], rows[1:]
    else:
        names, body = [f"column_{i}" for i in range(len(rows[0]))], rows
    wide = len(names)
    table = [tuple((r + [""] * wide)[:wide]) + (i,) for i, r in enumerate(body)]
    fields = [T.StructField(n, T.StringType()) for n in names]
    df = nulled(session().createDataFrame(table, T.StructType([*fields, T.StructField(ROW, T.LongType())])), null_values)
    if schema is not None:
        return Frame(coerced(df, schema))
    return Frame(typed(df) if infer_schema else df)


def scan_csv(path: str, *, has_header: bool = True, separator: str = ",", quote_char: str = '"', null_values: Any = NULLS, schema: dict | None = None, infer_schema: bool = True, multi_line: bool = False):
    """A frame from CSV files, read in parallel; multi_line for quoted line ends, which keep a file in one task."""
    from loomframe.operators.frame import Frame

    reader = session().read.option("header", has_header).option("sep", separator).option("quote", quote_char).option("escape", quote_char).option("multiLine", multi_line).option("inferSchema", False)
    df = reader.csv(path)
    if not has_header:
        df = df.toDF(*[f"column_{i}" for i in range(len(df.columns))])
    df = nulled(df, null_values)
    if schema is not None:
        return Frame(coerced(df, schema))
    return Frame(typed(df) if infer_schema else df)


#: Decimal mark and grouping mark of the locales that write_csv knows.
LOCALES = {"en-US": (".", ","), "en-GB": (".", ","), "de-DE": (",", "."), "es-ES": (",", "."), "it-IT": (",", "."), "fr-FR": (",", "\u202f"), "de-CH": (".", "\u2019")}


def number_text(c: Column, t: T.DataType, style: dict) -> Column:
    """A number as text. style: decimals (exactly so many), min_decimals and max_decimals (trailing zeros go), grouping, percent, currency (a sign), locale, accounting, fallback (for NaN)."""
    unknown = set(style) - {"decimals", "min_decimals", "max_decimals", "grouping", "percent", "currency", "locale", "accounting", "fallback"}
    if unknown or style.get("locale", "en-US") not in LOCALES:
        raise InvalidArgumentError(f"no number format {sorted(unknown) or style['locale']}")
    point, comma = LOCALES[style.get("locale", "en-US")]
    real = LT.is_float(t) or isinstance(t, T.DecimalType)
    low, high = (style["decimals"],) * 2 if style.get("decimals") is not None else (style.get("min_decimals", 0), style.get("max_decimals"))
    v = F.abs(c) if style.get("accounting") else c
    v = v * 100 if style.get("percent") else v
    plain = not (real or style.get("percent")) and not low
    if style.get("grouping") or not plain and high is not None:
        # halves are rounded away from zero before Spark's own formatting, which would take the even digit
        digits = 0 if plain else high if high is not None else 20
        s = F.format_number(v.cast("long") if plain else F.round(v.cast("decimal(38,18)"), digits) if digits <= 18 else v.cast("double"), digits)
        if digits > low:  # zeros at the end go, as far as min_decimals
            s = F.regexp_replace(s, rf"(\.\d{{{low}}}\d*?)0+$", "$1")
            s = F.regexp_replace(s, r"\.$", "")
    else:
        s = LT.lenient(v, v_type(t, style), LT.Utf8)
    marks = comma if style.get("grouping") else ""
    s = F.replace(F.replace(F.replace(s, F.lit(","), F.lit("\u0001")), F.lit("."), F.lit(point)), F.lit("\u0001"), F.lit(marks))
    if style.get("currency"):
        s = F.when(v < 0, F.concat(F.lit("-" + style["currency"]), F.substring(s, F.lit(2), F.length(s)))).otherwise(F.concat(F.lit(style["currency"]), s))
    if style.get("percent"):
        s = F.concat(s, F.lit("%"))
    if style.get("accounting"):
        s = F.when(c < 0, F.concat(F.lit("("), s, F.lit(")"))).otherwise(s)
    return F.when(F.isnan(c), F.lit(style.get("fallback", "NaN"))).otherwise(s) if LT.is_float(t) else s


def v_type(t: T.DataType, style: dict) -> T.DataType:
    return T.DoubleType() if style.get("percent") and LT.is_float(t) else t


def as_text(c: Column, t: T.DataType, date_format: str | None, time_format: str | None, style: dict) -> Column:
    from loomframe.functions.strings import datetime_pattern

    if isinstance(t, T.DateType):
        return F.date_format(c, datetime_pattern(date_format) if date_format else "yyyy-MM-dd")
    if LT.is_time(t):
        return F.date_format(c, datetime_pattern(time_format) if time_format else "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if LT.is_number(t):
        return number_text(c, t, style) if style else LT.lenient(c, t, LT.Utf8)
    return LT.lenient(c, t, LT.Utf8)


def write_csv(frame: Any, path: Any = None, *, include_header: bool = True, separator: str = ",", quote_char: str = '"', quote_style: str = "necessary", null_value: str = "", date_format: str | None = None, datetime_format: str | None = None, float_decimals: int | None = None, accounting_negatives: bool = False, number_format: dict | None = None, include_bom: bool = False, line_terminator: str = "\n", mode: str = "error") -> str:
    """CSV text of a frame (also written to `path` if that has a write method), or with a path a folder of CSV files written in parallel (then the empty text is given).

    quote_style: necessary, always, never, non_numeric. number_format: see number_text; float_decimals and accounting_negatives are short for two of its entries.
    """
    if quote_style not in ("necessary", "always", "never", "non_numeric"):
        raise InvalidArgumentError("quote_style is necessary, always, never or non_numeric")
    style = {**({"accounting": True} if accounting_negatives else {}), **(number_format or {})}
    schema = frame.df.schema
    special = "[" + "".join("\\" + c if not c.isalnum() else c for c in {separator[0], quote_char}) + r"\r\n]"

    def quoted(s: Column) -> Column:
        return F.concat(F.lit(quote_char), F.replace(s, F.lit(quote_char), F.lit(quote_char * 2)), F.lit(quote_char))

    cells = []
    for f in schema.fields:
        real = float_decimals is not None and (LT.is_float(f.dataType) or isinstance(f.dataType, T.DecimalType))
        s = as_text(F.col(f"`{f.name}`"), f.dataType, date_format, datetime_format, {**style, **({"decimals": float_decimals} if real else {})})
        number = LT.is_number(f.dataType)
        if quote_style == "always" or quote_style == "non_numeric" and not number:
            s = quoted(s)
        elif quote_style == "necessary":
            s = F.when(s.rlike(special), quoted(s)).otherwise(s)
        cells.append(F.coalesce(s, F.lit(null_value)))
    head = []
    for f in schema.fields:
        needs = quote_style in ("always", "non_numeric") or quote_style == "necessary" and any(c in f.name for c in (separator, quote_char, "\n", "\r"))
        head.append(quote_char + f.name.replace(quote_char, quote_char * 2) + quote_char if needs else f.name)
    header = separator.join(head)
    lines = frame._sorted().select(F.concat_ws(separator, *cells).alias("value"))
    bom = "﻿" if include_bom else ""
    if path is None or hasattr(path, "write"):
        rows = [r[0] for r in lines.toLocalIterator()]
        text = bom + line_terminator.join(([header] if include_header else []) + rows) + (line_terminator if rows or include_header else "")
        if path is not None:
            path.write(text)
        return text
    try:
        if include_header or include_bom:
            # each file begins with the header: it goes before a partition's first row
            def headed(batches):
                import pyarrow as pa

                first = True
                for b in batches:
                    got = b.column(0).to_pylist()
                    if first:
                        got = [bom + header, *got] if include_header else [bom + got[0], *got[1:]] if got else got
                        first = False
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["value"])
                if first and include_header:
                    yield pa.RecordBatch.from_arrays([pa.array([bom + header], pa.string())], names=["value"])

            lines = lines.mapInArrow(headed, "value string")
        lines.write.mode(mode).option("lineSep", line_terminator).text(path)
    except Exception as e:
        raise StreamError(f"can't write {path}: {e}") from e
    return ""


