"""The `.struct` family."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.errors import ColumnNotFoundError, SchemaError


class Structs:
    def __init__(self, e):
        object.__setattr__(self, "e", e)

    def _fields(self, ctx, x) -> list[str]:
        t = ctx.type(x)
        if not isinstance(t, T.StructType):
            raise SchemaError(f"{self.e.name} is no struct")
        return t.fieldNames()

    def field(self, name: str):
        def build(ctx, x):
            if name not in self._fields(ctx, x):
                raise ColumnNotFoundError(f"{self.e.name} has no field {name!r}")
            return x.getField(name)

        return self.e._map(build).alias(name)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return self.field(name)

    def __getitem__(self, name: str):
        return self.field(name)

    def rename_fields(self, mapping: dict[str, str]):
        return self.e._map(lambda ctx, x: F.when(x.isNotNull(), F.struct(*[x.getField(f).alias(mapping.get(f, f)) for f in self._fields(ctx, x)])))

    def with_fields(self, fields: Any):
        """Fields added or set anew from expressions (a list, or name: expression); a null struct stays null."""
        from loomframe.functions.expr import as_expr, named

        items = [(k, as_expr(v)) for k, v in fields.items()] if isinstance(fields, dict) else [(n.name, n) for n in map(named, fields)]

        def build(ctx, x, *values):
            new = dict(zip([k for k, _ in items], values))
            old = self._fields(ctx, x)
            return F.when(x.isNotNull(), F.struct(*[new.get(f, x.getField(f)).alias(f) for f in old], *[v.alias(k) for k, v in new.items() if k not in old]))

        return self.e._map(build, *[e for _, e in items])

    def unnest(self):
        """All fields as columns of their own."""
        return self.e._with(build=None, args=(self.e,), kind="unnest", name=self.e.name, extra=None, keys=None)
