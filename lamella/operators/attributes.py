"""Attributes of descendants seen from an ancestor, and predicates over children."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.tables import Tables
from lamella.plans.naming import col
from lamella.plans.schema import struct_inside, types_of
from lamella.plans.spec import HierarchyValidationError, LevelAttribute


def _present(v: Column) -> Column:
    return F.filter(v, lambda x: x.isNotNull())


def _sum(v: Column) -> Column:
    """Nulls skipped, 0 for an empty array, null for a null one; the type is that of the elements, widened as ``sum`` does."""
    return F.aggregate(_present(v), F.lit(0).cast("double"), lambda a, x: a + x.cast("double"))


def list_sum(v: Column, kind: T.DataType | None) -> Column:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return F.aggregate(_present(v), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    if isinstance(kind, T.DecimalType):
        wide = T.DecimalType(min(38, kind.precision + 10), kind.scale)
        return F.aggregate(_present(v), F.lit(0).cast(wide), lambda a, x: (a + x).cast(wide))
    return _sum(v)


#: How an array of an attribute's values is reduced (``kind``: the type of its elements) ...
LIST_AGGREGATIONS: dict[str, Callable[[Column, T.DataType | None], Column]] = {
    "list": lambda v, kind: v,
    "set": lambda v, kind: F.array_distinct(_present(v)),
    "sum": list_sum,
    "mean": lambda v, kind: F.try_divide(_sum(v), F.size(_present(v))),
    "min": lambda v, kind: F.array_min(v),
    "max": lambda v, kind: F.array_max(v),
    "first": lambda v, kind: F.get(v, F.lit(0)),
    "last": lambda v, kind: F.try_element_at(v, F.lit(-1)),
    "count": lambda v, kind: F.size(v).cast("long"),
    "single": lambda v, kind: F.get(F.array_distinct(_present(v)), F.lit(0)),
}
#: ... what comes from one hop when a further hop reduces it ...
INTERMEDIATE_AGGREGATIONS = LIST_AGGREGATIONS | {"count": lambda v, kind: list_sum(v, T.LongType())}
#: ... and the same over the rows of a child table, grouped by the parent's key; ``order`` is a
#: unique column that says what comes first, without it that is open.
GROUP_AGGREGATIONS: dict[str, Callable[[Column, Column | None], Column]] = {
    "list": lambda c, order=None: F.transform(F.collect_list(F.struct(c.alias("v"))) if order is None else F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("v")))), lambda x: x["v"]),
    "set": lambda c, order=None: F.collect_set(c),
    "sum": lambda c, order=None: F.coalesce(F.sum(c), F.lit(0)),
    "mean": lambda c, order=None: F.avg(c),
    "min": lambda c, order=None: F.min(c),
    "max": lambda c, order=None: F.max(c),
    "first": lambda c, order=None: F.first(c) if order is None else F.min_by(F.struct(c.alias("v")), order)["v"],
    "last": lambda c, order=None: F.last(c) if order is None else F.max_by(F.struct(c.alias("v")), order)["v"],
    "count": lambda c, order=None: F.count(F.lit(1)),
    "single": lambda c, order=None: F.min(c),
}
#: How a further hop reduces what the hop below gave; the others apply to themselves again.
GROUP_ON = {"count": "sum", "list": "list", "set": "list"}


def _known(agg: str) -> str:
    if agg not in LIST_AGGREGATIONS:
        raise ValueError(f"Unknown aggregation {agg!r}; use one of {list(LIST_AGGREGATIONS)}.")
    return agg


class Attributes(Tables):
    def attribute_expr(self, attribute: str, *, from_level: str, to_level: str, agg: str = "list", schema: T.StructType | DataFrame | None = None) -> Column:
        """An attribute of ``from_level``, for a frame packed at ``to_level``, reduced hop by hop from the innermost array.

        ``schema`` (the packed frame's) lets sums keep an integral or decimal type; without it
        they are doubles. Means over several hops are means of means; counts add up.
        """
        _known(agg)
        source, target = self._level(from_level), self._level(to_level)
        if source.name == target.name:
            return col(self.naming.qualified(target.path, attribute))
        if not self.spec.is_ancestor_of(to_level, from_level):
            raise ValueError(f"'{from_level}' is not below '{to_level}', so its attribute has no value there.")
        hops = self.spec.axis_of(from_level)[len(self.spec.axis_of(to_level)) :]
        first = self.levels[hops[0]].path
        kind = None
        if schema is not None:
            kind = types_of(schema if isinstance(schema, T.StructType) else schema.schema).get(first)
            for step in [*hops[1:], attribute]:
                struct = struct_inside(kind)
                kind = types_of(struct).get(step) if struct else None

        def reduce_hop(value: Column, rest: list[str]) -> Column:
            if not rest:  # a plain field of the array's elements, so a scan reads no other
                return LIST_AGGREGATIONS[agg](value.getField(attribute), kind)
            inner = F.transform(value, lambda x: reduce_hop(x.getField(rest[0]), rest[1:]))
            if agg == "sum":
                return list_sum(inner, kind)
            return INTERMEDIATE_AGGREGATIONS[agg](inner, kind)

        return reduce_hop(col(first), hops[1:])

    def enrich(self, frame: DataFrame, *attributes: LevelAttribute, at_level: str) -> DataFrame:
        """``frame``, packed at ``at_level``, with a column for each request, in one projection."""
        level = self._level(at_level)
        made = {
            self.naming.qualified(level.path, a.alias or a.attribute): self.attribute_expr(a.attribute, from_level=a.from_level, to_level=at_level, agg=a.agg, schema=frame)
            for a in attributes
        }
        return frame.withColumns(made) if made else frame

    def roll_up(self, frame: DataFrame, *attributes: LevelAttribute, at_level: str) -> DataFrame:
        """One row per entity of ``at_level`` with a column for each request, from a flat ``frame`` at ``attributes``' own level.

        The same values as ``enrich`` of the packed frame, by grouped aggregations that go up one
        level at a time: no child is put into an array, partial aggregation runs before each
        exchange, and a parent of any size takes one row per task. All requests are of one level.
        "list" and "set" are not offered here, as their result is an array of all children; "first" and
        "last" follow the levels' ``order_by``. Ancestors' columns are kept.
        """
        target = self._level(at_level)
        froms = list(dict.fromkeys(a.from_level for a in attributes))
        if len(froms) != 1 or not self.spec.is_ancestor_of(at_level, froms[0]):
            raise ValueError(f"roll_up takes attributes of one level below '{at_level}', not of {froms}.")
        for a in attributes:
            if _known(a.agg) in ("list", "set"):
                raise ValueError(f"roll_up makes no arrays, so {a.agg!r} is not offered; enrich a packed frame.")
        hops = self.spec.axis_of(froms[0])[len(self.spec.axis_of(at_level)) :]
        df = self._prepared(frame)
        names = [f"__hier_made_{i}" for i in range(len(attributes))]
        df = df.withColumns({m: col(self.naming.qualified(self.levels[froms[0]].path, a.attribute)) for m, a in zip(names, attributes, strict=True)})
        for number, name in enumerate(reversed(hops)):
            level = self.levels[name]
            keys = [k for k in level.ancestor_keys if k in df.columns]
            above = [n for v in self.spec.axis_of(name)[:-1] for n in self.own_columns(self.levels[v], df.schema) if n not in keys]
            by = [F.expr(o) if isinstance(o, str) else o for o in level.order_by] + [col(k) for k in level.id_columns if k in df.columns]
            order = F.struct(*[k.alias(f"o{i}") for i, k in enumerate(by)]) if by else None
            made = [GROUP_AGGREGATIONS[GROUP_ON.get(a.agg, a.agg) if number else a.agg](col(m), order).alias(m) for m, a in zip(names, attributes, strict=True)]
            df = df.groupBy(*[col(k) for k in keys]).agg(*made, *[self._one(n, df.schema, self.validate_on_pack) for n in above])
        wanted = {m: self.naming.qualified(target.path, a.alias or a.attribute) for m, a in zip(names, attributes, strict=True)}
        out = df.select(*[col(n).alias(wanted.get(n, n)) for n in df.columns])
        return out.select(*[col(n) for n in self.canonical_order(out.schema)])

    def _immediate(self, from_level: str, to_level: str, what: str) -> str:
        if self._level(from_level).parent != self._level(to_level).name:
            raise ValueError(f"{what} looks from a level at its immediate children; '{from_level}' is not a child of '{to_level}'.")
        return self.levels[from_level].path

    def promote_attribute(self, frame: DataFrame, attribute: str, *, from_level: str, to_level: str, agg: str = "list", alias: str | None = None) -> DataFrame:
        """``frame`` packed to ``to_level`` with the reduced attribute of its immediate children."""
        _known(agg)
        path = self._immediate(from_level, to_level, "promote_attribute")
        packed = self.pack(frame, to_level)
        struct = struct_inside(types_of(packed.schema).get(path))
        if struct is None or attribute not in struct.names:
            raise HierarchyValidationError(f"Field '{attribute}' not found in '{path}'; it has {struct.names if struct else []}.", level=from_level, details={"attribute": attribute})
        return self.enrich(packed, LevelAttribute(attribute, from_level, agg, alias), at_level=to_level)

    def any_child_satisfies(self, frame: DataFrame, *, from_level: str, to_level: str, condition: Callable[[Column], Column]) -> DataFrame:
        """Rows with a child that satisfies ``condition``; null conditions, null and empty arrays don't."""
        path = self._immediate(from_level, to_level, "any_child_satisfies")
        return frame.filter(F.exists(col(path), condition))

    def all_children_satisfy(self, frame: DataFrame, *, from_level: str, to_level: str, condition: Callable[[Column], Column]) -> DataFrame:
        """Rows whose children all satisfy ``condition``; null and empty arrays do, a null condition doesn't."""
        path = self._immediate(from_level, to_level, "all_children_satisfy")
        return frame.filter(col(path).isNull() | F.forall(col(path), lambda x: F.coalesce(condition(x), F.lit(False))))
