"""Texts with {{placeholders}}, filled from results, and a check that a file is up to date."""

from __future__ import annotations

import re

_PLACE = re.compile(r"\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}")


def render(template: str, values: dict[str, object]) -> str:
    """The template with its placeholders filled; one without a value, and a value without use, is an error."""
    names = set(_PLACE.findall(template))
    if names != set(values):
        raise KeyError(f"without value: {sorted(names - set(values))}; unused: {sorted(set(values) - names)}")
    return _PLACE.sub(lambda m: str(values[m[1]]), template)


def drifted(path: str, template: str, values: dict[str, object]) -> bool:
    """Whether the file differs from what would be written now."""
    with open(path, encoding="utf-8") as file:
        return file.read() != render(template, values)


def check_claims(claims: dict[str, bool]) -> None:
    """Raises with every claim that the results don't bear out."""
    if broken := [name for name, holds in claims.items() if not holds]:
        raise AssertionError(f"claims that don't hold: {', '.join(broken)}")
