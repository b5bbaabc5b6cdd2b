"""The SQL text of a column, so that what is built once from columns can be a function in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column

#: A literal or quoted name, or a function whose name SQL reads as an operator.
_PART = re.compile(r"""'(?:[^'\\]|\\.)*'|`[^`]*`|(?<![\w`])(and|or|in|[=<>!+\-*/%&|^~]+)\(""", re.S)


def sql_text(column: Column) -> str:
    """What spark.sql() reads as this column. Needs a session with a driver of its own."""
    text = column._jc.node().sql()
    return _PART.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], text)
