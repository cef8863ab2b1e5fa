"""Names of columns that operators add beside a table's own."""

from __future__ import annotations

from collections.abc import Iterable


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with marks before it until no column is called so (in any case)."""
    own = {t.lower() for t in taken}
    while name.lower() in own:
        name = "_" + name
    return name
