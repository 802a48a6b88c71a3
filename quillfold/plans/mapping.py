"""The column mapping of a sheet: a JSON file of nested objects and lists in which an object with a column is a field."""

from __future__ import annotations

Field = tuple[str, str, str, str | None]


def fields_of(body: object) -> list[Field]:
    """(column, section, field, expected header) of every field in order; members of a list are numbered from 1. A column that isn't letters is an error."""
    out: list[Field] = []

    def walk(node: object, at: list[str]) -> None:
        if isinstance(node, dict) and isinstance(node.get("column"), str):
            out.append((node["column"].strip().upper(), ".".join(at[:-1]), node.get("field") or (at[-1] if at else ""), node.get("expected_header")))
        elif isinstance(node, dict):
            for k, v in node.items():
                walk(v, [*at, k])
        elif isinstance(node, list):
            for k, v in enumerate(node, 1):
                walk(v, [*at, str(k)])

    walk(body, [])
    bad = [f for f in out if not f[0].isalpha()]
    if bad:
        raise ValueError(f"not a column: {bad[0][0]}")
    return out
