"""Flat to nested and back."""

from __future__ import annotations

from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.plans.naming import col, q
from lamella.plans.schema import ROW_ID, Introspection, struct_inside, types_of
from lamella.plans.spec import HierarchyValidationError, Level

ORDER = "__hier_order_"


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(holds_map(f.dataType) for f in kind.fields)


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that they equal those of ``left``, nulls too."""
    renamed = right.select(*[col(n).alias(f"__hier_right_{n}" if n in keys else n) for n in right.columns])
    return renamed, reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"__hier_right_{k}")) for k in keys])


class Packing(Introspection):
    preserve_child_order: bool
    validate_on_pack: bool
    #: Helper columns that say how rows are dealt; every fold groups by them too, so that it needs no other exchange.
    dealt_by: tuple[str, ...] = ("__hier_bucket",)

    # preparation

    def _prepared(self, df: DataFrame) -> DataFrame:
        """Computed keys added, and a row id if order counts: taken once, over the input, below every shuffle."""
        have = set(df.columns)
        made = {alias: col(source) for alias, source in self.spec.key_aliases.items() if alias not in have}
        made |= {c.name: c.column for v in self.levels.values() for c in v.computed if c.name not in have}
        if self.preserve_child_order and ROW_ID not in have:
            made[ROW_ID] = F.monotonically_increasing_id()
        return df.withColumns(made) if made else df

    def _finished(self, df: DataFrame) -> DataFrame:
        """Helper columns dropped, canonical order."""
        gone = {ROW_ID, *self.spec.key_aliases, *self.dealt_by}
        names = [n for n in self.canonical_order(df.schema) if n not in gone]
        return df.select(*[col(n) for n in names])

    # folding

    def _payload(self, level: Level, schema: T.StructType) -> tuple[Column, list[str]]:
        """The struct of a row at ``level``: own fields in schema order, packed children last as declared."""
        own = self.own_columns(level, schema)
        packed = [self.levels[c].path for c in level.children if self.levels[c].path in schema.names]
        return F.struct(*[col(n).alias(n.removeprefix(level.prefix)) for n in own + packed]), own + packed

    def _child_list(self, level: Level, payload: Column, schema: T.StructType, with_row_id: bool) -> Column:
        """The children's array, by the level's order and then by row."""
        keys = [F.expr(o) if isinstance(o, str) else o for o in level.order_by]
        order = [k.alias(f"{ORDER}{i}") for i, k in enumerate(keys)] + [col(ROW_ID).alias(ROW_ID)] * with_row_id
        if not order:
            return F.collect_list(payload)
        names = [f"{ORDER}{i}" for i in range(len(keys))] + [ROW_ID] * with_row_id
        listed = F.collect_list(F.struct(*order, payload.alias("p")))
        if not any(holds_map(f.dataType) for f in schema.fields):
            ordered = F.array_sort(listed)  # rows of equal order follow their payload, so the result is the same in every run
        else:

            def compare(a: Column, b: Column) -> Column:
                out = F.lit(0)
                for n in reversed(names):
                    x, y = a[n], b[n]
                    out = F.when(x.isNull() & y.isNotNull() | (x < y), -1).when(x.isNotNull() & y.isNull() | (x > y), 1).otherwise(out)
                return out

            ordered = F.array_sort(listed, compare)
        return F.transform(ordered, lambda x: x["p"])

    def _one(self, name: str, schema: T.StructType, checked: bool) -> Column:
        """The value of an ancestor's column for a group: the first that isn't null, by row id if there is one.

        If it is to be ``checked``, the least and the greatest value must agree, within the same
        aggregation; the query fails with an error that names the column if they don't.
        """
        if checked and self.is_hierarchy_column(name) and not isinstance(types_of(schema)[name], T.ArrayType) and not holds_map(types_of(schema)[name]):
            low = F.min(col(name))
            differ = F.raise_error(F.lit(f"Column '{name}' has several values within one entity. Pass validate=False to take the first."))
            return F.when(low.eqNullSafe(F.max(col(name))), low).otherwise(differ).alias(name)
        if ROW_ID in schema.names:
            return F.min_by(col(name), F.when(col(name).isNotNull(), col(ROW_ID))).alias(name)
        return F.first(col(name), ignorenulls=True).alias(name)

    def _fold(self, df: DataFrame, level: Level, checked: bool = False) -> DataFrame:
        """Rows of ``level`` become an array on their parent's rows; other columns take one value each.

        Grouping keys are the ancestors' keys, so folds from the leaf up group by ever shorter
        prefixes of the same list; partial aggregation runs before each exchange.
        """
        schema = df.schema
        payload, used = self._payload(level, schema)
        keys = [k for k in (*self.dealt_by, *level.ancestor_keys) if k in schema.names]
        rest = [n for n in schema.names if n not in used and n not in keys and n != ROW_ID]
        with_id = ROW_ID in schema.names
        aggs = [self._child_list(level, payload, schema, with_id).alias(level.path)]
        aggs += [self._one(n, schema, checked) for n in rest]
        aggs += [F.min(ROW_ID).alias(ROW_ID)] * with_id
        return df.groupBy(*[col(k) for k in keys]).agg(*aggs)

    def _flat(self, level: Level, schema: T.StructType) -> bool:
        """Whether anything of ``level`` or below it is a flat column."""
        return any(self.own_columns(self.levels[n], schema) for n in [level.name, *self.spec.descendants_of(level.name)])

    def _folded(self, df: DataFrame, level: Level, checked: bool = False) -> DataFrame:
        """Everything below ``level`` folded into it.

        Where several branches are flat, rows are their cross product; each branch is then cut
        out, reduced to its own rows and folded by itself before the branches meet again.
        """
        flat = [self.levels[c] for c in level.children if self._flat(self.levels[c], df.schema)]
        if len(flat) < 2:
            for child in flat:
                df = self._folded(df, child, checked)
                if self.own_columns(child, df.schema):
                    df = self._fold(df, child, checked)
            return df
        keys = [k for k in (*self.dealt_by, *level.keys) if k in df.columns]
        branches = {c.name: [n for n in df.columns if n == c.path or n.startswith(c.prefix)] for c in flat}
        crossed = {n for names in branches.values() for n in names}
        rest = [n for n in df.columns if n not in crossed and n not in keys and n != ROW_ID]
        first = [F.min(ROW_ID).alias(ROW_ID)] * (ROW_ID in df.columns)
        out = df.groupBy(*[col(k) for k in keys]).agg(*[self._one(n, df.schema, checked) for n in rest], *first)
        for child in flat:
            own = [*keys, *branches[child.name]]
            plain = df.select(*[col(n) for n in own], *[col(ROW_ID)] * bool(first))
            single = plain.groupBy(*[col(n) for n in own]).agg(*first) if first else plain.distinct()
            nested = self._fold(self._folded(single, child, checked), child, checked).drop(ROW_ID)
            right, on = null_safe_on(out, nested, keys)
            out = out.join(right, on, "left").drop(*[f"__hier_right_{k}" for k in keys])
        return out

    def pack(
        self,
        frame: DataFrame,
        at_level: str,
        *,
        extra_columns: Literal["preserve", "drop", "error"] = "preserve",
        parent_strategy: Literal["aggregate", "split_join"] = "aggregate",
        validate: bool | None = None,
        co_locate: bool = False,
    ) -> DataFrame:
        """One row per entity of ``at_level``; everything below nested, it and its ancestors flat.

        ``parent_strategy="split_join"`` keeps root attributes out of the folds: they are
        deduplicated by root key and joined back. ``validate`` (``validate_on_pack`` if None) lets the
        folds themselves compare the values of ancestors' columns: nothing runs now, and reading a
        column that varies within an entity fails. ``check_uniform`` raises at once, by a job.
        Without it such a column has its first value that isn't null. ``co_locate`` deals rows by root key once, so that no fold shuffles again; of
        use when roots are many. A frame coarser than ``at_level`` comes back as it is.
        """
        level = self._level(at_level)
        if extra_columns not in ("preserve", "drop", "error"):
            raise ValueError(f"extra_columns must be 'preserve', 'drop' or 'error', not {extra_columns!r}.")
        if parent_strategy not in ("aggregate", "split_join"):
            raise ValueError(f"parent_strategy must be 'aggregate' or 'split_join', not {parent_strategy!r}.")
        df = self._prepared(frame)
        extras = self.extra_columns(df.schema)
        extras = [n for n in extras if n not in self.spec.key_aliases]
        if extras and extra_columns == "error":
            raise HierarchyValidationError(f"Columns {extras} are not part of the hierarchy.", details={"extra_columns": extras})
        if extras and extra_columns == "drop":
            df = df.drop(*extras)
        checked = self.validate_on_pack if validate is None else validate
        root = self.levels[self.spec.root]
        root_keys = [k for k in root.id_columns if k in df.columns]
        attributes = [n for n in self.own_columns(root, df.schema) if n not in root_keys]
        if co_locate and root_keys:
            df = df.repartition(*[col(k) for k in root_keys])
        if parent_strategy == "split_join" and root_keys and attributes:
            dimension = df.groupBy(*[col(k) for k in root_keys]).agg(*[self._one(n, df.schema, checked) for n in attributes])
            right, on = null_safe_on(df, dimension, root_keys)
            folded = self._folded(df.drop(*attributes), level, checked)
            return self._finished(folded.join(right, on, "left").drop(*[f"__hier_right_{k}" for k in root_keys]))
        return self._finished(self._folded(df, level, checked))

    def check_uniform(self, frame: DataFrame, at_level: str) -> None:
        """Raises if a column of ``at_level`` or above has several values within one of its entities. One aggregation per level, no row leaves it."""
        df = self._prepared(frame)
        for name in reversed(self.spec.axis_of(at_level)):
            level = self.levels[name]
            keys = [k for k in level.keys if k in df.columns]
            own = [n for n in self.own_columns(level, df.schema) if n not in keys and not holds_map(types_of(df.schema)[n])]
            if not keys or not own or self.is_at_granularity(level, df.schema) and not level.children:
                continue
            spread = df.groupBy(*[col(k) for k in keys]).agg(*[(F.min(col(n)) != F.max(col(n))).alias(f"__d{i}") for i, n in enumerate(own)])
            bad = spread.agg(*[F.count_if(f"__d{i}").alias(f"__d{i}") for i in range(len(own))]).first()
            found = {n: bad[i] for i, n in enumerate(own) if bad[i]}
            if found:
                raise HierarchyValidationError(f"Columns vary within an entity: {found}.", level=name, details={"non_uniform": found})

    # unpacking

    def _explode(self, df: DataFrame, level: Level) -> DataFrame:
        """A packed level's array to rows (null and empty give one row of nulls), its fields to columns in place; a bare struct only to columns."""
        kind = types_of(df.schema)[level.path]
        struct = struct_inside(kind)
        if struct is None:
            return df
        if isinstance(kind, T.ArrayType):
            df = df.withColumn(level.path, F.explode_outer(col(level.path)))
        out: list[Column] = []
        for n in df.columns:
            if n == level.path:
                out += [col(n).getField(f).alias(level.prefix + f) for f in struct.names]
            else:
                out.append(col(n))
        return df.select(*out)

    def _unpacked(self, df: DataFrame, at_level: str) -> DataFrame:
        for name in self.spec.axis_of(at_level):
            if self.levels[name].path in df.columns:
                df = self._explode(df, self.levels[name])
        return df

    def unpack(self, frame: DataFrame, at_level: str) -> DataFrame:
        """One row per entity of ``at_level``; branches off its axis stay packed."""
        df = self._unpacked(frame, at_level)
        return df.select(*[col(n) for n in self.canonical_order(df.schema)])

    # validation of data

    def validate(self, frame: DataFrame, *, level: str | None = None, raise_on_error: bool = True) -> list[HierarchyValidationError]:
        """Errors for null keys, of one level or all, counted in one pass."""
        levels = [self._level(level)] if level else list(self.levels.values())
        keys = [(v, k) for v in levels for k in v.id_columns if k in frame.columns]
        if not keys:
            return []
        counts = frame.agg(*[F.count_if(col(k).isNull()).alias(f"__null_count_{i}") for i, (_, k) in enumerate(keys)]).first()
        errors = [HierarchyValidationError(f"'{k}' is null in {counts[i]} rows, which so belong to no entity.", level=v.name, details={"column": k, "null_count": counts[i]}) for i, (v, k) in enumerate(keys) if counts[i]]
        if errors and raise_on_error:
            raise errors[0]
        return errors


def first_by_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that with the smallest row id."""
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(q(ROW_ID))
    return df.withColumn("__hier_rank", F.row_number().over(window)).filter("__hier_rank = 1").drop("__hier_rank")
