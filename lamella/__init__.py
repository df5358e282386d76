"""Nested and hierarchical data on Spark DataFrames.

Declare a tree of levels once, then move between flat rows with path-style column names, nested
arrays of structs, and one table per level; read and change fields at any depth; and query
per-level tables as one consistent hierarchy.
"""

from lamella.functions.fields import NestedExpressionBuilder, apply_nested_operations, field, generate_nested_exprs, when
from lamella.functions.flatten import convert_schema, unnest_all, unnest_rename
from lamella.operators.view import HierarchyView
from lamella.packer import HierarchicalPacker
from lamella.plans.schema import discover_levels
from lamella.plans.spec import Computed, DiscoveredLevel, HierarchySpec, HierarchyValidationError, LevelAttribute, LevelSpec, SchemaValidationResult

__all__ = [
    "Computed",
    "DiscoveredLevel",
    "HierarchicalPacker",
    "HierarchySpec",
    "HierarchyValidationError",
    "HierarchyView",
    "LevelAttribute",
    "LevelSpec",
    "NestedExpressionBuilder",
    "SchemaValidationResult",
    "apply_nested_operations",
    "convert_schema",
    "discover_levels",
    "field",
    "generate_nested_exprs",
    "unnest_all",
    "unnest_rename",
    "when",
]
