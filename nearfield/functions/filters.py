"""The filter language, compiled to Columns.

A filter is a dict, as in JSON:

* leaf ``{key, scope: attrs|meta, match | exists | is_null | range}``; of
  several tests the first in that order counts, bool clauses beside it don't;
* ``{must, must_not, should, should_min}``;
* ``{has_id: {values}}``, alone or with any of the above.

Filters are two-valued: every leaf is true or false, never null, so NOT keeps
rows whose value is missing. Types are strict: 1 is neither "1" nor true.
Values come from VARIANT columns, where a missing key and an explicit null
differ, or from typed columns (``Typed``), which reach the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import u32

_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


class Value:
    """What a leaf asks of the value at a path."""

    def exists(self) -> Column:
        raise NotImplementedError

    def is_null(self) -> Column:
        raise NotImplementedError

    def number(self) -> Column:
        """The value as a double, null if it isn't a number."""
        raise NotImplementedError

    def equals(self, wanted) -> Column:
        """The value, or an element of it if it is an array, is ``wanted``."""
        raise NotImplementedError


def at_path(root: Column, key: str) -> Column:
    """The value at a dotted path. A name with both kinds of quotes can't be
    in a JSON path; it is looked up in the object as a map."""
    path = "$"
    for part in key.split("."):
        if "'" in part and '"' in part:
            root = F.try_variant_get(F.try_variant_get(root, path, "variant"), "$", "map<string,variant>")[part]
            path = "$"
        else:
            quote = '"' if "'" in part else "'"
            path += f"[{quote}{part}{quote}]"
    return F.try_variant_get(root, path, "variant")


class Variant(Value):
    def __init__(self, root: Column, key: str):
        self.v = at_path(root, key)
        self.kind = F.schema_of_variant(self.v)

    def exists(self):
        return self.v.isNotNull() & ~F.is_variant_null(self.v)

    def is_null(self):
        return F.is_variant_null(self.v)

    def number(self):
        return F.when(self.kind.rlike(_NUMBER), F.try_variant_get(self.v, "$", "double"))

    @staticmethod
    def _same(v: Column, kind: Column, wanted) -> Column:
        if wanted is None:
            return F.is_variant_null(v)
        if isinstance(wanted, bool):
            return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(wanted))
        if isinstance(wanted, int | float):
            return kind.rlike(_NUMBER) & (F.try_variant_get(v, "$", "double") == F.lit(float(wanted)))
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(str(wanted)))

    def equals(self, wanted):
        items = F.try_variant_get(self.v, "$", "array<variant>")
        inside = F.exists(items, lambda x: F.coalesce(self._same(x, F.schema_of_variant(x), wanted), F.lit(False)))
        return F.when(self.kind.startswith("ARRAY"), inside).otherwise(self._same(self.v, self.kind, wanted))


class Typed(Value):
    """A value in a column of its own; null stands for an absent key unless
    ``null_is_present``. ``kind``: string, number, boolean or array<...> of one."""

    def __init__(self, col: Column, kind: str, null_is_present: bool = False):
        self.col, self.kind, self.present = col, kind, null_is_present

    def exists(self):
        return self.col.isNotNull()

    def is_null(self):
        return self.col.isNull() if self.present else F.lit(False)

    def number(self):
        return self.col if self.kind == "number" else F.lit(None).cast("double")

    def equals(self, wanted):
        if wanted is None:
            return self.is_null() if not self.kind.startswith("array") else F.lit(False)
        own = "boolean" if isinstance(wanted, bool) else "number" if isinstance(wanted, int | float) else "string"
        if self.kind == own:
            return self.col == F.lit(wanted)
        if self.kind == f"array<{own}>":
            return F.array_contains(self.col, F.lit(wanted))
        return F.lit(False)


class Missing(Value):
    def exists(self):
        return F.lit(False)

    is_null = exists

    def number(self):
        return F.lit(None).cast("double")

    def equals(self, wanted):
        return F.lit(False)


class Scope:
    """Where leaves find values: VARIANT columns for attrs and meta, and typed
    columns that take the place of single keys."""

    def __init__(self, attrs: Column | None = None, meta: Column | None = None, typed: dict[tuple[str, str], Typed] | None = None):
        self.roots, self.typed = {"attrs": attrs, "meta": meta}, typed or {}

    def value(self, scope: str, key: str | None) -> Value:
        if not key:
            return Missing()
        if (scope, key) in self.typed:
            return self.typed[scope, key]
        root = self.roots.get(scope)
        return Missing() if root is None else Variant(root, key)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _leaf(expr: dict, scope: Scope) -> Column:
    value = scope.value(expr.get("scope") or "attrs", expr.get("key"))
    if "match" in expr:
        wanted = expr["match"] if isinstance(expr["match"], list | tuple) else [expr["match"]]
        return reduce(lambda a, b: a | b, (_sure(value.equals(w)) for w in wanted), F.lit(False))
    if "exists" in expr:
        found = _sure(value.exists())
        return found if expr["exists"] else ~found
    if "is_null" in expr:
        found = _sure(value.is_null())
        return found if expr["is_null"] else ~found
    bounds = expr["range"]
    if not isinstance(bounds, dict):
        raise ValueError("range must be an object")
    number = value.number()
    found = number.isNotNull() & ~F.isnan(number.cast("double"))
    for name, test in (("gt", number.__gt__), ("gte", number.__ge__), ("lt", number.__lt__), ("lte", number.__le__)):
        if bounds.get(name) is not None:
            found = found & test(F.lit(bounds[name]))
    return _sure(found)


def pushable(expr: dict, scope: Scope) -> Column | None:
    """Tests on typed columns that every row has to pass that the filter lets
    through, in the plain form that a scan can skip by; None if there are none.
    They narrow; the whole filter runs after them."""
    found: list[Column] = []
    if any(k in expr for k in ("match", "exists", "is_null", "range")):
        value = scope.value(expr.get("scope") or "attrs", expr.get("key")) if expr.get("key") else None
        if isinstance(value, Typed) and not value.kind.startswith("array"):
            if "match" in expr:
                wanted = expr["match"] if isinstance(expr["match"], list | tuple) else [expr["match"]]
                kinds = {"boolean": bool, "number": (int, float), "string": str}[value.kind]
                fit = [w for w in wanted if isinstance(w, kinds) and (value.kind == "boolean" or not isinstance(w, bool))]
                if None not in wanted:
                    found.append(value.col.isin(fit) if fit else F.lit(False))
            elif "exists" in expr:
                found += [value.col.isNotNull()] if expr["exists"] else []
            elif "range" in expr and "is_null" not in expr and value.kind == "number" and isinstance(expr["range"], dict):
                tests = {"gt": value.col.__gt__, "gte": value.col.__ge__, "lt": value.col.__lt__, "lte": value.col.__le__}
                found += [test(F.lit(expr["range"][name])) for name, test in tests.items() if expr["range"].get(name) is not None]
    else:
        found += [c for e in expr.get("must") or [] if (c := pushable(e, scope)) is not None]
    return reduce(lambda a, b: a & b, found) if found else None


def compile_filter(expr: dict, scope: Scope, id_col: Column | None = None) -> Column:
    """A boolean Column that is never null."""
    if "has_id" in expr:
        ids = sorted({u32(v) for v in expr["has_id"]["values"]})
        own = _sure((F.col("id") if id_col is None else id_col).isin(ids)) if ids else F.lit(False)
        rest = {k: v for k, v in expr.items() if k != "has_id"}
        return own & compile_filter(rest, scope, id_col) if rest else own
    if any(k in expr for k in ("match", "exists", "is_null", "range")):
        return _leaf(expr, scope)
    each = lambda name: [compile_filter(e, scope, id_col) for e in expr.get(name) or []]
    out = reduce(lambda a, b: a & b, each("must"), F.lit(True))
    out = reduce(lambda a, b: a & ~b, each("must_not"), out)
    if should := each("should"):
        least = expr.get("should_min")
        least = max(0, 1 if least is None else least)
        out = out & (reduce(lambda a, b: a + b, (s.cast("int") for s in should)) >= least)
    return out
