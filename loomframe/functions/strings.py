"""The `.str` family. Lengths and positions count code points; what trims to nothing is null."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe import types as LT
from loomframe.errors import InvalidArgumentError

WHITE = r"\s\u00a0\ufeff\u2028\u2029\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Where an identifier breaks: at whatever is no letter or digit, between letters and digits, before a capital that follows a small letter, and
#: before the last capital of several that a small letter follows, unless that is the s of a plural (URLs).
BREAK = r"[^\p{L}\p{N}]+|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}(?!s(?!\p{Ll}))\p{Ll})"
#: Directives of strftime and strptime and their patterns.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "p": "a", "M": "mm", "S": "ss", "j": "DDD", "z": "xx", "ms": "SSS", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "Z": "zzz", "%": "%"}


def java(pattern: Any) -> tuple[str, bool]:
    """A pattern for Spark's regular expressions, and whether it came as one (else the text itself is looked for)."""
    if isinstance(pattern, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("s", re.S), ("m", re.M)) if pattern.flags & bit)
        return (f"(?{flags})" if flags else "") + re.sub(r"\(\?P<", "(?<", pattern.pattern), True
    return quoted(str(pattern)), False


def quoted(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", s)


def pieces(fmt: str) -> list[tuple[str, str]]:
    """A strftime format as ("text", ...) and ("field", directive) parts."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            d = "ms" if fmt.startswith("ms", i + 1) else fmt[i + 1]
            if d == "%":
                out.append(("text", "%"))
            elif d in DIRECTIVES or d in "uw":
                out.append(("field", d))
            else:
                raise InvalidArgumentError(f"no directive is called %{d}")
            i += 1 + len(d)
        else:
            out.append(("text", fmt[i]))
            i += 1
    return out


def datetime_pattern(fmt: str) -> str:
    """The Spark pattern of a strptime format."""
    return "".join(DIRECTIVES[v] if k == "field" else ("''" if v == "'" else f"'{v}'" if v.isalpha() else v) for k, v in pieces(fmt))


class Strings:
    def __init__(self, e):
        self.e = e

    def _s(self, fn, *operands):
        """fn over text; other types are printed first."""

        def build(ctx, x, *others):
            return fn(x if isinstance(ctx.type(x), T.StringType) else LT.lenient(x, ctx.type(x), LT.Utf8), *others)

        return self.e._map(build, *operands)

    def concat(self, other):
        return self._s(lambda x, y: F.concat(x, y.cast("string")), other)

    def contains(self, pattern):
        if hasattr(pattern, "_map"):
            return self._s(F.contains, pattern)
        if pattern is None:
            return self._s(lambda x: F.lit(None).cast("boolean"))
        p, is_re = java(pattern)
        return self._s(lambda x: x.rlike(p) if is_re else F.contains(x, F.lit(pattern)))

    def contains_any(self, patterns):
        def build(x):
            hit = F.lit(False)
            for p in patterns:
                j, is_re = java(p)
                hit = hit | (x.rlike(j) if is_re else F.contains(x, F.lit(p)))
            return F.when(x.isNotNull(), hit)

        return self._s(build)

    def count_matches(self, pattern):
        p, _ = java(pattern)
        return self._s(lambda x: F.regexp_count(x, F.lit(p)) if p else F.when(x.isNotNull(), F.length(x) + 1))

    def starts_with(self, prefix):
        return self._s(F.startswith, prefix)

    def ends_with(self, suffix):
        return self._s(F.endswith, suffix)

    def encode(self, encoding: str = "hex"):
        if encoding not in ("hex", "base64", "base64url"):
            raise InvalidArgumentError(f"no encoding is called {encoding!r}")
        if encoding == "hex":
            return self._s(lambda x: F.lower(F.hex(F.encode(x, "UTF-8"))))
        plain = lambda x: F.base64(F.encode(x, "UTF-8"))
        return self._s(plain if encoding == "base64" else lambda x: F.rtrim(F.translate(plain(x), "+/", "-_"), F.lit("=")))

    def decode(self, encoding: str = "hex", strict: bool = False):
        """Text from hex or base64 (also its URL form); what can't be decoded is null, or with strict an error."""
        if encoding not in ("hex", "base64", "base64url"):
            raise InvalidArgumentError(f"no encoding is called {encoding!r}")

        def build(x):
            if encoding == "hex":
                raw = F.when(x.rlike("^([0-9a-fA-F]{2})*$"), F.try_to_binary(x, F.lit("hex")))
            else:
                std = F.rtrim(F.translate(x, "-_", "+/"), F.lit("="))
                std = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), F.lit("="))
                raw = F.when(std.rlike("^[A-Za-z0-9+/]*={0,2}$"), F.try_to_binary(std, F.lit("base64")))
            out = F.try_validate_utf8(raw.cast("string"))
            return F.when(x.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("can't decode "), x)).cast("string")).otherwise(out) if strict else out

        return self._s(build)

    def encode_uri_component(self):
        def build(x):
            out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
            for code, c in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
                out = F.replace(out, F.lit(code), F.lit(c))
            return out

        return self._s(build)

    def decode_uri_component(self):
        """Percent codes decoded; text with a broken one stays as it is."""
        return self._s(lambda x: F.when(x.rlike("%(?![0-9a-fA-F]{2})"), x).otherwise(F.coalesce(F.try_validate_utf8(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))), x)))

    def explode(self):
        """The text as a list of its characters."""
        return self._s(lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, "")))

    def extract(self, pattern, group: int = 0):
        p, _ = java(pattern)
        return self._s(lambda x: F.when(x.rlike(p), F.regexp_extract(x, p, group)))

    def head(self, n: int = 1):
        return self._s(lambda x: F.left(x, F.lit(max(0, n))))

    def tail(self, n: int = 1):
        return self._s(lambda x: F.right(x, F.lit(max(0, n))))

    def len_chars(self):
        return self._s(F.char_length)

    len = len_chars

    def len_bytes(self):
        return self._s(F.octet_length)

    def lower(self):
        return self._s(F.lower)

    to_lowercase = lower

    def upper(self):
        return self._s(F.upper)

    to_uppercase = upper

    def lpad(self, width: int, fill: str = " "):
        return self._s(lambda x: F.when(F.char_length(x) < width, F.lpad(x, width, fill)).otherwise(x) if fill else x)

    pad_start = lpad

    def rpad(self, width: int, fill: str = " "):
        return self._s(lambda x: F.when(F.char_length(x) < width, F.rpad(x, width, fill)).otherwise(x) if fill else x)

    pad_end = rpad

    def zfill(self, width: int):
        return self.lpad(width, "0")

    def replace(self, pattern, replacement):
        """The first occurrence; a function as replacement gets the match and runs as an Arrow UDF."""
        return self._replace(pattern, replacement, 1)

    def replace_all(self, pattern, replacement):
        return self._replace(pattern, replacement, 0)

    def _replace(self, pattern, replacement, times):
        if callable(replacement):
            found = pattern if isinstance(pattern, re.Pattern) else re.compile(re.escape(pattern))

            @F.pandas_udf(T.StringType())
            def put(s):
                return s.map(lambda v: found.sub(lambda m: str(replacement(m[0], *m.groups())), v, count=times), na_action="ignore")

            return self._s(put)
        p, is_re = java(pattern)
        if is_re:
            to = re.sub(r"\\(\d)", r"$\1", replacement)
            return self._s(lambda x: _first(x, p, to) if times else F.regexp_replace(x, p, to))
        if times == 0:
            return self._s(lambda x: F.replace(x, F.lit(pattern), F.lit(replacement)))

        def once(x):
            at = F.locate(pattern, x)
            return F.when(at == 0, x).otherwise(F.concat(F.substring(x, F.lit(1), at - 1), F.lit(replacement), F.substring(x, at + len(pattern), F.length(x))))

        return self._s(once)

    def reverse(self):
        return self._s(F.reverse)

    def slice(self, offset: int, length: int | None = None):
        """From offset (negative: from the end), length characters or all."""

        def build(x):
            n = F.char_length(x)
            start = F.lit(offset) if offset >= 0 else F.greatest(F.lit(0), n + offset)
            return F.substring(x, start + 1, F.greatest(F.lit(0), F.lit(length)) if length is not None else n)

        return self._s(build)

    def split(self, delimiter: str):
        return self._s(lambda x: F.split(x, quoted(delimiter), -1)) if delimiter else self.explode()

    def strip_chars(self, characters=None, **options):
        return self._strip("both", characters, **options)

    def strip_chars_start(self, characters=None, **options):
        return self._strip("start", characters, **options)

    def strip_chars_end(self, characters=None, **options):
        return self._strip("end", characters, **options)

    def _strip(self, side, characters, *, literal: bool = False, case_insensitive: bool = False, max_matches: int | None = None):
        """A set of characters, a pattern of one character, or (literal) a text, off one end or both; null if nothing is left.

        max_matches: how many characters (literal: occurrences) each end loses at most.
        """
        if characters is None:
            unit = f"[{WHITE}]"
        elif isinstance(characters, re.Pattern):
            unit = f"(?:{java(characters)[0]})"
        elif literal:
            unit = f"(?:{quoted(characters)})"
        else:
            if not characters:
                return self._s(lambda x: F.nullif(x, F.lit("")))
            unit = "[" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in characters) + "]"
        flag = "(?i)" if case_insensitive else ""
        many = "+" if max_matches is None else f"{{1,{max_matches}}}"
        if max_matches == 0:
            return self._s(lambda x: F.nullif(x, F.lit("")))

        def build(x):
            if side in ("both", "start"):
                x = F.regexp_replace(x, f"{flag}^{unit}{many}", "")
            if side in ("both", "end"):
                x = F.regexp_replace(x, f"{flag}{unit}{many}\\z", "")
            return F.nullif(x, F.lit(""))

        return self._s(build)

    def trim(self):
        return self.strip_chars()

    def trim_start(self):
        return self.strip_chars_start()

    def trim_end(self):
        return self.strip_chars_end()

    def strip_prefix(self, prefix: str):
        return self._s(lambda x: F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x))

    def strip_suffix(self, suffix: str):
        return self._s(lambda x: F.when(F.endswith(x, F.lit(suffix)), F.substring(x, F.lit(1), F.length(x) - len(suffix))).otherwise(x))

    # ---- parsing

    def strptime(self, format: str, strict: bool = False, time_zone: str | None = None):
        """A timestamp (UTC) by %-directives; text that doesn't fit is null, or with strict an error."""
        fields = [v for k, v in pieces(format) if k == "field"]
        pattern = datetime_pattern(format)
        if not {"Y", "y", "F", "D"} & set(fields):
            pattern = "yyyy-MM-dd " + pattern

        def build(x):
            text = x if not pattern.startswith("yyyy-MM-dd ") or "F" in fields else F.concat(F.lit("1970-01-01 "), x)
            out = F.try_to_timestamp(text, F.lit(pattern))
            if "z" in fields:
                out = F.to_utc_timestamp(out, F.current_timezone())
            elif time_zone:
                out = F.to_utc_timestamp(out, time_zone)
            out = out.cast("timestamp_ntz")
            return F.when(x.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("no time is in "), x)).cast("timestamp_ntz")).otherwise(out) if strict else out

        return self._s(build)

    def to_date(self):
        return self.e.cast(LT.Date)

    def to_datetime(self):
        return self.e.cast(LT.Datetime())

    def to_time(self):
        return self.e.cast(LT.Time)

    def to_integer(self):
        return self.e.cast(LT.Int32)

    def to_decimal(self, precision: int | None = None, scale: int = 0):
        return self.e.cast(LT.Decimal(precision, scale))

    # ---- letter case of identifiers

    def _words(self, fn):
        def build(x):
            plain = F.regexp_replace(x, r"(\p{L})['’](\p{L})", "$1$2")
            words = F.filter(F.split(plain, BREAK), lambda w: w != "")
            return F.when(x.isNotNull(), fn(words))

        return self._s(build)

    def to_snakecase(self):
        return self._words(lambda w: F.lower(F.array_join(w, "_")))

    def to_kebabcase(self):
        return self._words(lambda w: F.lower(F.array_join(w, "-")))

    def to_titlecase(self):
        return self._words(lambda w: F.array_join(F.transform(w, capital), " "))

    def to_pascalcase(self):
        return self._words(lambda w: F.array_join(F.transform(w, capital), ""))

    def to_camelcase(self):
        return self._words(lambda w: F.array_join(F.transform(w, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(capital(x))), ""))


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def _first(x: Column, p: str, to: str) -> Column:
    """x with the first match of p replaced: what stands before it is found by splitting once."""
    head = F.get(F.split(x, p, 2), 0)
    rest = F.substring(x, F.length(head) + 1, F.length(x))
    match = F.regexp_extract(rest, f"^(?:{p})", 0)
    tail = F.substring(rest, F.length(match) + 1, F.length(rest))
    return F.when(x.rlike(p), F.concat(head, F.regexp_replace(match, f"^(?:{p})$", to), tail)).otherwise(x)
