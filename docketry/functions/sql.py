"""Small helpers to write rules as Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Iterable


def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``.

    Spark copies an expression to every place it is used when it moves a filter
    below the projection that named it. Bound to a lambda variable, it stays
    one expression that is evaluated once, and filters on plain columns still
    reach the scan. Do not nest more than a handful: Spark's type derivation
    doubles with every level.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def case(branches: Iterable[tuple[str, str]], otherwise: str = "NULL") -> str:
    """CASE over (condition, value); the first that holds applies."""
    whens = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"(CASE {whens} ELSE {otherwise} END)"


def struct(**fields: str) -> str:
    """A struct of named expressions."""
    return "named_struct(" + ", ".join(f"{quoted(name)}, {value}" for name, value in fields.items()) + ")"


def strings(values: Iterable[str]) -> str:
    """An array of string literals."""
    listed = ", ".join(quoted(v) for v in values)
    return f"array({listed})"


NO_STRINGS = "cast(array() AS array<string>)"
