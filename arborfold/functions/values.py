"""Document values as (kind, value) pairs: type names, strict accessors, equality; list positions; ids, tickets, times."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("null", "bool", "int", "text", "doc", "list", "deleted")


def is_leaf(kind: Column) -> Column:
    return ~kind.isin("doc", "list")


def is_branch(kind: Column) -> Column:
    return kind.isin("doc", "list")


def _as(kind: Column, value: Column, want: str, type_: str, default: object) -> Column:
    strict = F.when(kind == want, value.cast(type_))
    return strict if default is None else F.coalesce(strict, F.lit(default))


def as_bool(kind: Column, value: Column, default: bool | None = None) -> Column:
    return _as(kind, value, "bool", "boolean", default)


def as_int(kind: Column, value: Column, default: int | None = None) -> Column:
    return _as(kind, value, "int", "bigint", default)


def as_text(kind: Column, value: Column, default: str | None = None) -> Column:
    return _as(kind, value, "text", "string", default)


def equals(kind: Column, value: Column, other: object) -> Column:
    """Whether a value is of the same kind as a Python value and equal to it."""
    want = "bool" if isinstance(other, bool) else "int" if isinstance(other, int) else "text"
    text = str(other).lower() if isinstance(other, bool) else str(other)
    return (kind == want) & F.coalesce(value == text, F.lit(False))


def display(kind: Column, value: Column) -> Column:
    return F.when(kind == "deleted", "<deleted>").when(kind == "null", "null").otherwise(value)


def position_order(numerator: Column, denominator: Column, other_numerator: Column, other_denominator: Column) -> Column:
    """-1, 0 or 1: two rational positions compared by exact cross products."""
    a, b, c, d = (x.cast("decimal(19,0)") for x in (numerator, denominator, other_numerator, other_denominator))
    return F.signum(a * d - c * b).cast("int")


def position_key(numerator: Column, denominator: Column, unique_id: Column) -> Column:
    """A sort key of positions with the same order as exact comparison while denominators stay below 10**9."""
    whole = F.floor(numerator.cast("decimal(38,18)") / denominator)
    rest = (numerator.cast("decimal(19,0)") - whole.cast("decimal(19,0)") * denominator.cast("decimal(19,0)")).cast("decimal(38,18)") / denominator.cast("decimal(19,0)")
    return F.struct(whole.alias("whole"), rest.cast("decimal(38,18)").alias("rest"), unique_id.alias("id"))


def between(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """A rational strictly between two others, reduced."""
    n, d = left[0] * right[1] + right[0] * left[1], 2 * left[1] * right[1]
    g = gcd(n, d)
    return n // g, d // g


def insert_position(live: list[tuple[int, int]], index: int) -> tuple[int, int]:
    """The position for an item put at an index of the live positions: before the first, after the last, or between."""
    if not live:
        return 1, 1
    if index <= 0:
        return live[0][0] // live[0][1] - 1, 1
    if index >= len(live):
        return live[-1][0] // live[-1][1] + 1, 1
    return between(live[index - 1], live[index])


def content_id(*fields: Column) -> Column:
    """An id of content: a SHA-256 of its fields, null apart from empty; the empty id stays the smallest of all."""
    marked = [F.coalesce(F.concat(F.lit("+"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat_ws("\x1f", *marked), 256)


def duration_ms(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)


def ticket(database: Column, peers: Column) -> Column:
    """A share ticket: one db parameter and a pr parameter for each peer."""
    each = F.transform(peers, lambda p: F.concat(F.lit("pr="), F.url_encode(p)))
    return F.concat_ws("&", F.concat(F.lit("arborfold:?db="), F.url_encode(database)), F.array_join(each, "&"))


def parse_ticket(text: Column) -> Column:
    """(database, peers) of a ticket; unknown parameters and empty peers are ignored."""
    pairs = F.split(F.substring_index(text, "?", -1), "&")
    one = F.filter(pairs, lambda p: F.startswith(p, F.lit("db=")))
    many = F.filter(pairs, lambda p: F.startswith(p, F.lit("pr=")) & (F.length(p) > 3))
    after = lambda p: F.substr(p, F.lit(4))
    return F.struct(F.url_decode(after(F.try_element_at(one, F.lit(1)))).alias("database"), F.transform(many, lambda p: F.url_decode(after(p))).alias("peers"))
