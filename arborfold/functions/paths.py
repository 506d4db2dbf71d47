"""Dotted paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    """The components without empty ones."""
    return F.filter(F.split(path, "[.]"), lambda c: c != "")


def normalize(path: Column) -> Column:
    return F.array_join(components(path), ".")


def length(path: Column) -> Column:
    return F.size(components(path))


def parent(path: Column) -> Column:
    """The path without its last component; null for one component or none."""
    c = components(path)
    return F.when(F.size(c) > 1, F.array_join(F.slice(c, F.lit(1), F.size(c) - 1), "."))


def file_name(path: Column) -> Column:
    """The last component, null if there is none."""
    return F.try_element_at(components(path), F.lit(-1))


def join(*paths: Column) -> Column:
    return F.array_join(F.flatten(F.array(*[components(p) for p in paths])), ".")


def is_component(text: Column) -> Column:
    """A component has no dots; it may be empty."""
    return ~F.contains(text, F.lit("."))


def build(*parts: object) -> str:
    """A path of literal parts; a part that holds a dot is an error."""
    for p in map(str, parts):
        if "." in p:
            raise ValueError(f"{p!r} is no path component")
    return ".".join(p for p in map(str, parts) if p)
