"""Path-style column names and their quoting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def q(name: str) -> str:
    """``name`` as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


class Naming:
    """Paths are level names joined by a separator of any length; a separator inside a field is escaped."""

    def __init__(self, separator: str = ".", escape: str = "\\"):
        if separator == escape:
            raise ValueError(f"escape_char '{escape}' cannot be the same as granularity_separator '{separator}'.")
        self.separator, self.escape = separator, escape

    def escape_field(self, name: str) -> str:
        return name.replace(self.escape, self.escape * 2).replace(self.separator, self.escape + self.separator)

    def split(self, path: str) -> list[str]:
        """Components of a path, unescaped."""
        parts, at = [""], 0
        while at < len(path):
            if path.startswith(self.escape, at):
                rest = at + len(self.escape)
                for token in (self.escape, self.separator):
                    if path.startswith(token, rest):
                        parts[-1] += token
                        at = rest + len(token)
                        break
                else:
                    parts[-1] += self.escape
                    at = rest
            elif path.startswith(self.separator, at):
                parts.append("")
                at += len(self.separator)
            else:
                parts[-1] += path[at]
                at += 1
        return parts

    def join(self, components: Sequence[str]) -> str:
        return self.separator.join(map(self.escape_field, components))

    def qualified(self, path: str, field: str) -> str:
        """``field`` below ``path``; a field that holds an unescaped separator is a full path already."""
        if len(self.split(field)) > 1:
            return field
        return f"{path}{self.separator}{self.escape_field(self.split(field)[0])}"
