"""Nested frames to one table per level and back."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.pack import Packing, first_by_row
from lamella.plans.naming import col
from lamella.plans.schema import ROW_ID, struct_inside, types_of
from lamella.plans.spec import HierarchyValidationError, Level


class Tables(Packing):
    def split_levels(self, frame: DataFrame) -> dict[str, DataFrame]:
        """A table per level, root first: the level's own columns and its ancestors' keys.

        Each level goes on from its parent's rows, so branches explode apart. Rows that stand
        for no entity go: at inner levels those with a null in any key, at leaves those with a null in a
        required field. Where rows are finer than the level they are reduced to one per key.
        The tables share ``frame``'s plan; persist it if it is costly to compute.
        """
        start = self._prepared(frame)
        working: dict[str, DataFrame] = {}
        out: dict[str, DataFrame] = {}
        for level in self.levels.values():
            df = working[level.parent] if level.parent else start
            packed = level.path in df.columns
            if packed:
                df = self._unpacked(df, level.name)
            working[level.name] = df
            own = [n for n in self.own_columns(level, df.schema) if n != ROW_ID and n not in self.spec.key_aliases]
            keys = [k for k in level.ancestor_keys if k in df.columns]
            if not own and not keys or not packed and not own:
                continue
            ids = [k for k in level.id_columns if k in own]
            guard = keys + ids if level.children else [n for n in level.required_columns if n in own or n in keys]
            carried = [ROW_ID] if ROW_ID in df.columns else []
            table = df.select(*[col(n) for n in keys + own + carried])
            if guard:
                table = table.filter(reduce(lambda a, b: a & b, [col(n).isNotNull() for n in guard]))
            if not self.is_at_granularity(level, df.schema):
                unique = keys + ids
                if not unique:
                    table = table.drop(*carried).distinct()
                elif carried:
                    table = first_by_row(table, unique)
                else:
                    table = table.dropDuplicates(unique)
            out[level.name] = table.drop(*carried)
        return out

    def normalize(self, frame: DataFrame, *, at_level: str | None = None) -> dict[str, DataFrame]:
        return self.split_levels(self.pack(frame, at_level or self.spec.root))

    def _check_keys(self, tables: Mapping[str, DataFrame]) -> None:
        for name, table in tables.items():
            level = self._level(name)
            lost = [k for k in level.id_columns if k not in table.columns]
            if lost:
                raise HierarchyValidationError(f"Table lacks its key columns {lost}; it has {table.columns}.", level=name, details={"missing": lost, "available": table.columns})

    def _nested(self, tables: Mapping[str, DataFrame], name: str, skip: str | None = None, how: str = "left") -> DataFrame:
        """``name``'s table with everything below it folded in, but for the branch ``skip``."""
        level = self.levels[name]
        df = tables[name]
        for child_name in level.children:
            if child_name == skip or child_name not in tables:
                continue
            child = self.levels[child_name]
            folded = self._fold_table(self._nested(tables, child_name, how=how), child)
            keys = [k for k in level.keys if k in df.columns and k in folded.columns]
            df = df.join(folded, keys, how)
        return df

    def _fold_table(self, df: DataFrame, child: Level) -> DataFrame:
        keys = [k for k in child.ancestor_keys if k in df.columns]
        payload, _ = self._payload(child, df.schema)
        return df.groupBy(*[col(k) for k in keys]).agg(self._child_list(child, payload, df.schema, ROW_ID in df.columns).alias(child.path))

    def denormalize(self, tables: Mapping[str, DataFrame], *, at_level: str | None = None) -> DataFrame:
        """The inverse of ``normalize``: one row per entity of ``at_level`` (the root if not given).

        Children are folded before they are joined, so branches never cross. A parent without
        child rows has a null array. Ancestors' attributes and branches off the axis are joined
        back on the ancestors' keys.
        """
        return self._finished(self._rebuilt(tables, at_level))

    def _rebuilt(self, tables: Mapping[str, DataFrame], at_level: str | None, how: str = "left") -> DataFrame:
        if not tables:
            raise HierarchyValidationError("Expected at least one table to denormalize.", details={"tables_provided": 0})
        root = self.spec.root
        target = self._level(at_level or root)
        if root not in tables:
            raise HierarchyValidationError(f"Missing root level '{root}' in table mapping.", level=root, details={"provided_levels": list(tables)})
        axis = self.spec.axis_of(target.name)
        lost = [n for n in axis if n not in tables]
        if lost:
            raise HierarchyValidationError(f"Tables {lost} are needed to reach '{target.name}'.", level=lost[0], details={"missing_levels": lost})
        ready = {n: self._prepared(t) for n, t in tables.items()}
        self._check_keys(ready)
        df = self._nested(ready, target.name, how=how)
        for name, below in zip(reversed(axis[:-1]), reversed(axis[1:]), strict=True):
            above = self.levels[name]
            coarse = self._nested(ready, name, skip=below, how=how).drop(ROW_ID)
            own = [n for n in self.own_columns(above, coarse.schema) if n not in above.keys]
            packed = [self.levels[c].path for c in above.children if c != below and self.levels[c].path in coarse.columns]
            keys = [k for k in above.keys if k in df.columns and k in coarse.columns]
            if own or packed:
                df = df.join(coarse.select(*[col(n) for n in keys + own + packed]), keys, how)
        return df

    # source tables with foreign keys

    def prepare_level_table(self, level_name: str, data: DataFrame, column_mapping: Mapping[str, str] | None = None) -> DataFrame:
        """``data`` with columns renamed by ``column_mapping`` and put below the level's path."""
        level, mapping = self._level(level_name), column_mapping or {}
        lost = [n for n in mapping if n not in data.columns]
        if lost:
            raise KeyError(f"column_mapping names {lost}, which are not among {data.columns}.")
        names = {n: mapping.get(n, n) for n in data.columns}
        return data.select(*[col(n).alias(new if new.startswith(level.prefix) else self.naming.qualified(level.path, new)) for n, new in names.items()])

    def build_from_tables(self, tables: Mapping[str, DataFrame], *, at_level: str | None = None, join_type: Literal["left", "inner"] = "left") -> DataFrame:
        """A nested frame from source tables (unprefixed columns) linked by ``parent_keys``.

        Ids need to be unique within a level for this. Each table first gets its ancestors' keys,
        by a join with its parent's keys alone; rows without a parent go, and so do the foreign
        key columns. Children are then folded before they are joined, so that siblings never
        cross. With ``"left"`` a childless parent gets one child of nulls, with ``"inner"`` it goes.
        """
        if join_type not in ("left", "inner"):
            raise ValueError(f"join_type must be 'left' or 'inner', not {join_type!r}.")
        lost = [n for n in self.spec.axis_of(at_level or self.spec.root) if n not in tables]
        if lost:
            raise HierarchyValidationError(f"Missing tables for levels {lost}.", level=lost[0], details={"missing_levels": lost})
        keyed: dict[str, DataFrame] = {}
        for level in self.levels.values():
            if level.name not in tables or level.parent is not None and level.parent not in keyed:
                continue
            df = self._prepared(self.prepare_level_table(level.name, tables[level.name]))
            self._check_keys({level.name: df})
            if level.parent is not None:
                if not level.parent_keys:
                    raise HierarchyValidationError("parent_keys are needed to join this level to its parent.", level=level.name)
                parent = self.levels[level.parent]
                links = [self.naming.qualified(level.path, k) for k in level.parent_keys]
                unknown = [k for k in links if k not in df.columns]
                if unknown:
                    raise HierarchyValidationError(f"parent_keys {unknown} are not among {df.columns}.", level=level.name, details={"missing": unknown})
                above = keyed[parent.name].select(*[col(k) for k in parent.keys])
                on = reduce(lambda a, b: a & b, [col(link) == col(k) for link, k in zip(links, parent.id_columns, strict=True)])
                df = df.join(above, on, "inner").drop(*[link for link in links if link not in level.id_columns])
            keyed[level.name] = df
        built = self._rebuilt(keyed, at_level, join_type)
        if join_type == "left":
            built = self._with_absent_children(built, self._level(at_level or self.spec.root))
        return self._finished(built)

    def _absent(self, level: Level, struct: T.StructType) -> Column:
        """A child of nulls, with such children of its own."""
        fields = []
        for f in struct.fields:
            inner = struct_inside(f.dataType) if f.name in level.children else None
            value = F.array(self._absent(self.levels[f.name], inner)) if inner else F.lit(None)
            fields.append(value.cast(f.dataType).alias(f.name))
        return F.struct(*fields)

    def _with_absent_children(self, df: DataFrame, level: Level) -> DataFrame:
        types = types_of(df.schema)
        made = {}
        for v in self.levels.values():
            kind = types.get(v.path)
            if isinstance(kind, T.ArrayType):
                made[v.path] = self._filled(col(v.path), v, kind)
        return df.withColumns(made) if made else df

    def _filled(self, value: Column, level: Level, kind: T.ArrayType) -> Column:
        """An array of children whose null arrays, at any depth, hold one child of nulls."""
        struct = kind.elementType

        def each(x: Column) -> Column:
            fields = []
            for f in struct.fields:
                inner = f.name in level.children and isinstance(f.dataType, T.ArrayType) and struct_inside(f.dataType)
                got = x.getField(f.name)
                fields.append((self._filled(got, self.levels[f.name], f.dataType) if inner else got).alias(f.name))
            return F.struct(*fields)

        deep = any(f.name in level.children for f in struct.fields)
        return F.coalesce(F.transform(value, each) if deep else value, F.array(self._absent(level, struct)).cast(kind))
