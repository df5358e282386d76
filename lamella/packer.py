"""The packer: every operator over frames of one hierarchy."""

from __future__ import annotations

from lamella.plans.naming import Naming
from lamella.plans.schema import discover_levels
from lamella.plans.spec import HierarchySpec
from lamella.streaming.bounded import Bounded


class HierarchicalPacker(Bounded):
    """Converts frames between flat, nested and one-table-per-level form.

    ``preserve_child_order`` keeps input order within parents: a row id is taken over the input
    as it is read, so give ``order_by`` on levels for an order that doesn't depend on files.
    ``validate_on_pack`` lets ``pack`` check, within its folds, that ancestors' columns agree.
    """

    def __init__(self, spec: HierarchySpec, *, granularity_separator: str = ".", escape_char: str = "\\", preserve_child_order: bool = True, validate_on_pack: bool = True):
        self.spec = spec
        self.naming = Naming(granularity_separator, escape_char)
        self.preserve_child_order, self.validate_on_pack = preserve_child_order, validate_on_pack
        self._resolve()

    discover_levels = staticmethod(discover_levels)
