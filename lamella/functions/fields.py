"""Dictionary specs to expressions that read, replace and add fields at any depth of structs and arrays."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.plans.naming import col
from lamella.plans.schema import schema_of


def _method(name: str) -> Callable[..., Field]:
    """The method of columns of that name, put off until the column is known."""

    def method(self: Field, *args: Any) -> Field:
        return Field(lambda s, a: getattr(self.resolve(s, a), name)(*[_resolved(o, s, a) for o in args]))

    return method


class Field:
    """An expression over the fields of the struct around it, resolved when that struct is known.

    It always sees the original fields, also where a sibling is replaced. Inside an array's
    elements, ``list_min``, ``list_max``, ``list_sum``, ``list_mean`` and ``list_count`` reduce
    the field over the whole array.
    """

    def __init__(self, resolve: Callable[[Column, Column | None], Column]):
        self.resolve = resolve

    def apply(self, fn: Callable[..., Column], *others: Any) -> Field:
        """``fn`` of this expression and ``others`` (fields, columns or values)."""
        return Field(lambda s, a: fn(self.resolve(s, a), *[_resolved(o, s, a) for o in others]))

    __add__, __radd__, __sub__, __rsub__ = map(_method, ("__add__", "__radd__", "__sub__", "__rsub__"))
    __mul__, __rmul__, __truediv__, __rtruediv__ = map(_method, ("__mul__", "__rmul__", "__truediv__", "__rtruediv__"))
    __mod__, __rmod__, __pow__, __rpow__ = map(_method, ("__mod__", "__rmod__", "__pow__", "__rpow__"))
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = map(_method, ("__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__"))  # type: ignore[assignment]
    __and__, __rand__, __or__, __ror__ = map(_method, ("__and__", "__rand__", "__or__", "__ror__"))
    cast, isNull, isNotNull, isin, getField, getItem = map(_method, ("cast", "isNull", "isNotNull", "isin", "getField", "getItem"))
    between, like, rlike, startswith, endswith, contains, substr = map(_method, ("between", "like", "rlike", "startswith", "endswith", "contains", "substr"))
    __hash__ = None  # type: ignore[assignment]

    def __neg__(self) -> Field:
        return self.apply(lambda c: -c)

    def __invert__(self) -> Field:
        return self.apply(lambda c: ~c)


class ListField(Field):
    """A field by name; it can also be reduced over the array that its struct is an element of."""

    def __init__(self, name: str):
        self.name = name
        super().__init__(lambda s, a: s.getField(name))

    def _over(self, reduce_values: Callable[[Column], Column]) -> Field:
        def resolve(struct: Column, array: Column | None) -> Column:
            if array is None:
                raise ValueError(f"field({self.name!r}) is not in an array, so it can't be reduced over one.")
            return reduce_values(array.getField(self.name))

        return Field(resolve)

    def list_min(self) -> Field:
        return self._over(F.array_min)

    def list_max(self) -> Field:
        return self._over(F.array_max)

    def list_count(self) -> Field:
        return self._over(F.size)

    def list_sum(self) -> Field:
        return self._over(lambda v: F.aggregate(v, F.lit(0.0), lambda t, x: t + F.coalesce(x.cast("double"), F.lit(0.0))))

    def list_mean(self) -> Field:
        def mean(v: Column) -> Column:
            known = F.filter(v, lambda x: x.isNotNull())
            return F.try_divide(F.aggregate(known, F.lit(0.0), lambda t, x: t + x.cast("double")), F.size(known))

        return self._over(mean)


class When(Field):
    """A chain of conditions, open for more until ``otherwise``."""

    def __init__(self, cases: list[tuple[Any, Any]]):
        self.cases = cases
        super().__init__(lambda s, a: self._chain(s, a))

    def _chain(self, s: Column, a: Column | None) -> Column:
        out = None
        for condition, value in self.cases:
            c, v = _resolved(condition, s, a), _resolved(value, s, a)
            out = F.when(c, v) if out is None else out.when(c, v)
        return out

    def when(self, condition: Any, value: Any) -> When:
        return When([*self.cases, (condition, value)])

    def otherwise(self, value: Any) -> Field:
        return Field(lambda s, a: self._chain(s, a).otherwise(_resolved(value, s, a)))


def _resolved(value: Any, struct: Column, array: Column | None) -> Any:
    return value.resolve(struct, array) if isinstance(value, Field) else value


def field(name: str) -> ListField:
    """A field of the struct that the expression stands in."""
    return ListField(name)


def when(condition: Any, value: Any) -> When:
    """Like ``functions.when``, over fields."""
    return When([(condition, value)])


StructMode = Literal["select", "with_fields"]


class NestedExpressionBuilder:
    """Builds a column for each entry of a spec.

    An entry is None (keep), a callable of the column, an expression, or a dictionary that goes
    into a struct or the elements of an array. In ``select`` mode a struct has exactly the
    fields of its dictionary, in that order; in ``with_fields`` mode it keeps the others, replaced
    fields in place and new ones last. A null struct stays null in both.
    """

    def __init__(self, schema: T.StructType | DataFrame, struct_mode: StructMode = "select"):
        if struct_mode not in ("select", "with_fields"):
            raise ValueError(f"Invalid struct_mode {struct_mode!r}: use 'select' or 'with_fields'.")
        self.schema, self.struct_mode = schema_of(schema), struct_mode

    def build(self, fields: Mapping[str, Any]) -> list[Column]:
        return [self._top(name, spec) for name, spec in fields.items()]

    def _top(self, name: str, spec: Any) -> Column:
        if isinstance(spec, Column):
            return spec.alias(name)
        if spec is not None and not callable(spec) and not isinstance(spec, (Mapping, Field)):
            raise TypeError(f"Entry {name!r} is a {type(spec).__name__}; give None, a callable, an expression or a dictionary.")
        if name not in self.schema.names:
            raise ValueError(f"Column '{name}' not found in schema; it has {self.schema.names}.")
        if isinstance(spec, Field):
            raise TypeError(f"field() stands inside a struct; give {name!r} a column expression.")
        kept = self.schema[name]
        if spec is None:
            return col(name)
        if isinstance(spec, Mapping):
            return self._into(col(name), kept.dataType, spec, name, None).alias(name, metadata=kept.metadata)
        return spec(col(name)).alias(name)

    def _into(self, value: Column, kind: T.DataType, spec: Mapping[str, Any], at: str, array: Column | None) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: self._into(x, kind.elementType, spec, at, value))
        if isinstance(kind, T.StructType):
            return self._struct(value, kind, spec, at, array)
        raise ValueError(f"Cannot recurse into field with type {kind.simpleString()} (at '{at}').")

    def _struct(self, value: Column, kind: T.StructType, spec: Mapping[str, Any], at: str, array: Column | None) -> Column:
        made = {name: self._field(value, kind, name, entry, at, array) for name, entry in spec.items()}
        if self.struct_mode == "with_fields":
            if all(entry is None for entry in spec.values()):
                return value
            made = {n: made.get(n, value.getField(n)) for n in kind.names} | {n: c for n, c in made.items() if n not in kind.names}
        elif not made:
            raise ValueError(f"A struct needs at least one field (at '{at}').")
        # arrays whose elements are mapped, and fields that are kept, keep their size and other metadata
        kept = {f.name: f.metadata for f in kind.fields if isinstance(spec.get(f.name), (Mapping, type(None)))}
        return F.when(value.isNotNull(), F.struct(*[c.alias(n, metadata=kept.get(n)) for n, c in made.items()]))

    def _field(self, struct: Column, kind: T.StructType, name: str, spec: Any, at: str, array: Column | None) -> Column:
        there = name in kind.names
        own = struct.getField(name) if there else None
        if isinstance(spec, Field):
            return spec.resolve(struct, array)
        if isinstance(spec, Column):
            return spec
        if isinstance(spec, Mapping):
            if not there:
                raise ValueError(f"Cannot recurse into non-existent struct field '{name}' (at '{at}'); it has {kind.names}.")
            return self._into(own, kind[name].dataType, spec, f"{at}.{name}", None)
        if spec is None:
            if not there:
                raise ValueError(f"Field '{name}' not found in struct '{at}'; it has {kind.names}.")
            return own
        if callable(spec):
            if not there:
                raise ValueError(f"Cannot apply function to non-existent field '{name}' (at '{at}'); it has {kind.names}.")
            made = spec(own)
            return made.resolve(struct, array) if isinstance(made, Field) else made
        raise TypeError(f"Entry '{at}.{name}' is a {type(spec).__name__}; give None, a callable, an expression or a dictionary.")


def generate_nested_exprs(fields: Mapping[str, Any], schema: T.StructType | DataFrame, struct_mode: StructMode = "select") -> list[Column]:
    return NestedExpressionBuilder(schema, struct_mode).build(fields)


def apply_nested_operations(df: DataFrame, fields: Mapping[str, Any], struct_mode: StructMode = "select", use_with_columns: bool = False) -> DataFrame:
    """Selects the spec's columns from ``df``, or adds them to it; all see ``df`` as it was."""
    made = generate_nested_exprs(fields, df, struct_mode)
    if not use_with_columns:
        return df.select(*made)
    by_name = dict(zip(fields, made, strict=True))
    kept = [by_name.get(n, col(n)).alias(n) if n in by_name else col(n) for n in df.columns]
    return df.select(*kept, *[c.alias(n) for n, c in by_name.items() if n not in df.columns])


__all__ = ["Field", "NestedExpressionBuilder", "apply_nested_operations", "field", "generate_nested_exprs", "when"]
