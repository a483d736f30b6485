"""Small text helpers for writing the SQL twins."""

from __future__ import annotations


def div(n: str, d: str) -> str:
    return f"({n}) / nullif({d}, 0)"


def sdiv(n: str, d: str, eps: str = "0.01e0") -> str:
    return f"CASE WHEN abs({d}) >= {eps} THEN ({n}) / ({d}) END"


def sratio(n: str, d: str) -> str:
    return f"CASE WHEN abs({d}) >= 0.01e0 AND ({n}) / ({d}) BETWEEN -1e3 AND 1e4 THEN ({n}) / ({d}) END"


def lag(x: str, n: int, by: str, key: str = "ticker") -> str:
    return f'lag({x}, {n}) OVER (PARTITION BY {key} ORDER BY {by})'


def growth(x: str, n: int, by: str) -> str:
    return f"{x} / nullif({lag(x, n, by)}, 0) - 1"


def clip(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


def case_suffix(x: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(
        f"WHEN ends_with({x}, '{s}') THEN '{v}'"
        for s, v in sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0]))
        if s
    )
    return f"CASE {whens} ELSE {default} END"
