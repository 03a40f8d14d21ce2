"""Independent SQL statements (DuckDB dialect) of the results the registered queries must give.

``statement(target)`` chains the named blocks the target needs into one WITH query.
"""

from __future__ import annotations

import re

from .blocks import BLOCKS


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [name for name in BLOCKS if name in words]


def statement(final: str) -> str:
    """``final`` preceded by the blocks it refers to, directly or through other blocks."""
    chosen: list[str] = []

    def add(sql: str, chain: tuple[str, ...] = ()) -> None:
        for name in _needs(sql):
            if name in chain or name in chosen:
                continue
            add(BLOCKS[name], (*chain, name))
            chosen.append(name)

    add(final)
    final = final.strip()
    if not chosen:
        return final
    if final.startswith("with"):
        final = f"select * from (\n{final}\n)"
    return "with " + ",\n".join(f"{name} as ({BLOCKS[name].strip()})" for name in chosen) + "\n" + final
