"""Typed tables and nested documents over a history, with staged changes that reads see."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborfold.functions.values import position_key
from arborfold.operators import fold
from arborfold.operators.skew import positions


class KeyNotFound(KeyError):
    """No visible row has the key."""


class TypeMismatch(TypeError):
    """A value is there but of another kind."""


class Table:
    """A table of JSON rows by key. history has (key, row, kind, height, entry_id), kind leaf or deleted.

    Changes are staged and laid over the committed rows by every read; patches() gives them for a commit.
    """

    def __init__(self, history: DataFrame, schema: str) -> None:
        self.history, self.schema = history, schema
        self._staged: list[tuple[str, str | None, str]] = []

    def state(self) -> DataFrame:
        """key, row, kind of every key ever written, tombstones included."""
        state = fold.last_writer(self.history, ["key"], ["row", "kind"]).select("key", "row", "kind")
        if not self._staged:
            return state
        rows = [(k, r, kind, i) for i, (k, r, kind) in enumerate(self._staged)]
        staged = self.history.sparkSession.createDataFrame(rows, "key string, row string, kind string, seq bigint")
        return fold.overlay(state, staged, ["key"], ["row", "kind"])

    def rows(self) -> DataFrame:
        """key and the parsed row's columns of all visible rows; text that is no row of the schema gives nulls."""
        return fold.live(self.state()).select("key", F.from_json("row", self.schema).alias("row")).select("key", "row.*")

    def search(self, predicate: Column | str) -> DataFrame:
        """Visible rows for which the predicate holds. It looks at the last version only, never at older ones."""
        return self.rows().where(predicate)

    def get(self, key: str) -> dict:
        """The row of a key as a dict. The key filter reaches the scan below the fold."""
        found = self.search(F.col("key") == key).drop("key").first()
        if found is None:
            raise KeyNotFound(key)
        return found.asDict(recursive=True)

    def contains(self, key: str) -> bool:
        return not fold.live(self.state()).where(F.col("key") == key).isEmpty()

    def insert(self, row: str) -> str:
        """Stages a row (JSON text) under a new random key, which it returns."""
        key = str(uuid.uuid4())
        self.set(key, row)
        return key

    def set(self, key: str, row: str) -> None:
        self._staged.append((key, row, "leaf"))

    def delete(self, key: str) -> bool:
        """Stages a tombstone if the key is visible; whether it was."""
        if not self.contains(key):
            return False
        self._staged.append((key, None, "deleted"))
        return True

    def patches(self) -> list[tuple[str, str | None, str]]:
        return list(self._staged)


LEAVES = ("null", "bool", "int", "text")


def encode(value: Any) -> tuple[str, str | None]:
    """(kind, value) of a plain Python value: None, bool, int or text."""
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "bool", str(value).lower()
    if isinstance(value, int):
        return "int", str(value)
    if isinstance(value, str):
        return "text", value
    raise TypeMismatch(f"{type(value).__name__} is no leaf")


def decode(kind: str, value: str | None) -> Any:
    """The plain Python value of a leaf."""
    return None if kind == "null" else value == "true" if kind == "bool" else int(value) if kind == "int" else value


def segments(path: str) -> list[str]:
    return [p for p in path.split(".") if p]


class Documents:
    """Nested documents over a history of path events (see fold.live_events), keyed by the given columns.

    Methods that take a key read or change one document, on the driver; the others give one row per document. Changes are
    staged as events after all committed ones and laid over them by every read; staged() gives them for a commit.
    """

    def __init__(self, events: DataFrame, keys: Sequence[str]) -> None:
        self.keys = list(keys)
        self._events = events.select(*self.keys, "path", "cont", "kind", F.col("value").cast("string").alias("value"), F.col("height").cast("bigint").alias("height"), F.col("entry_id").cast("string").alias("entry_id"))
        self._staged: list[tuple] = []
        self._changes = 0

    @property
    def events(self) -> DataFrame:
        """Committed events and, after all of them, the staged ones."""
        return self._events if not self._staged else self._events.unionByName(self.staged())

    def staged(self) -> DataFrame:
        return self._events.sparkSession.createDataFrame(self._staged, self._events.schema)

    # ---- changes ----

    def _stage(self, key: Sequence, nodes: list[tuple[list[str], str, str, str | None]]) -> None:
        """nodes: path, what holds each segment (d or l), kind, value; all of one change, which comes after those before."""
        order = (2**63 - 1, f"{self._changes:012d}")
        self._changes += 1
        self._staged += [(*key, path, list(cont), kind, value, *order) for path, cont, kind, value in nodes]

    def _way(self, path: str) -> list[tuple[list[str], str, str, str | None]]:
        parts = segments(path)
        if not parts:
            raise TypeMismatch("the document itself is no value")
        return [(parts[:n], "d" * n, "doc", None) for n in range(1, len(parts))]

    def _tree(self, path: list[str], cont: str, value: Any) -> list[tuple[list[str], str, str, str | None]]:
        if isinstance(value, dict):
            return [(path, cont, "adoc", None), *(n for k, v in value.items() for n in self._tree([*path, str(k)], cont + "d", v))]
        if isinstance(value, (list, tuple)):
            return [(path, cont, "list", None), *(n for i, v in enumerate(value) for n in self._tree([*path, f"{i + 1:010d}"], cont + "l", v))]
        return [(path, cont, *encode(value))]

    def set(self, key: Sequence, path: str, value: Any) -> Any:
        """Stages a leaf, document (dict) or list at a dotted path; documents on the way are made where there are none.

        Returns the staged value that it takes the place of, if there is one. A document replaces what was there; a
        list is merged into one that is there, item by item.
        """
        before = self._staged_value(key, path)
        parts = segments(path)
        self._stage(key, [*self._way(path), *self._tree(parts, "d" * len(parts), value)])
        return before

    insert = set

    def _staged_value(self, key: Sequence, path: str) -> Any:
        parts, found = segments(path), None
        for row in self._staged:
            *own, at, _, kind, value, _, _ = row
            if own == list(key) and at == parts[: len(at)] and (len(at) == len(parts) or kind not in ("doc", "list")):
                found = decode(kind, value) if len(at) == len(parts) and kind in LEAVES else None
        return found

    def set_json(self, key: Sequence, path: str, value: Any) -> None:
        """Stages any value as a text that holds JSON."""
        self.set(key, path, json.dumps(value, sort_keys=True))

    def delete(self, key: Sequence, path: str) -> bool:
        """Stages a tombstone if the path is visible in the document; whether it was."""
        if self._node(key, path) is None:
            return False
        parts = segments(path)
        self._stage(key, [*self._way(path), (parts, "d" * len(parts), "deleted", None)])
        return True

    # ---- reads of one document ----

    def _rows(self, key: Sequence, path: str) -> list:
        """The visible nodes at and below the path in one document."""
        found = self.get_path(path)
        for k, v in zip(self.keys, key):
            found = found.where(F.col(k).eqNullSafe(F.lit(v)))
        return sorted(found.collect(), key=lambda r: r["path"])

    def _node(self, key: Sequence, path: str):  # noqa: ANN202
        """The visible node at the path; a number as a segment below a list is the index of a live item."""
        parts = segments(path)
        rows = {tuple(r["path"]): r for r in self._rows(key, parts[0] if parts else "")}
        at: tuple = ()
        for p in parts:
            node = rows.get(at)
            if node is not None and node["kind"] == "list" and p.isdigit():
                items = sorted(x for x in rows if len(x) == len(at) + 1 and x[:-1] == at)
                if int(p) >= len(items):
                    return None
                at = items[int(p)]
            else:
                at = (*at, p)
        return rows.get(at)

    def get(self, key: Sequence, path: str, kind: str | None = None) -> Any:
        """The plain value of the visible leaf of one document; KeyNotFound if there is nothing, TypeMismatch for a
        branch or for another kind than the one asked for."""
        node = self._node(key, path)
        if node is None:
            raise KeyNotFound(path)
        if node["kind"] in ("doc", "list") or kind not in (None, node["kind"]):
            raise TypeMismatch(f"{path} is a {node['kind']}")
        return decode(node["kind"], node["value"])

    def get_option(self, key: Sequence, path: str, kind: str | None = None) -> Any:
        """As get(), but None for what is not there or of another kind."""
        try:
            return self.get(key, path, kind)
        except (KeyNotFound, TypeMismatch):
            return None

    def get_node(self, key: Sequence, path: str) -> Any:
        """The value at the path as plain Python data: leaves, dicts and lists (of live items)."""
        node = self._node(key, path) if segments(path) else None
        if node is None and segments(path):
            raise KeyNotFound(path)
        top = list(node["path"]) if node else []
        rows = {tuple(r["path"]): r for r in self._rows(key, ".".join(top))}

        def build(at: tuple) -> Any:
            kind = rows[at]["kind"] if at in rows else "doc"
            if kind in ("doc", "list"):
                below = sorted(x for x in rows if len(x) == len(at) + 1 and x[:-1] == at)
                return {x[-1]: build(x) for x in below} if kind == "doc" else [build(x) for x in below]
            return decode(kind, rows[at]["value"])

        return build(tuple(top))

    def get_json(self, key: Sequence, path: str) -> Any:
        """What the JSON text at the path holds; TypeMismatch if it is no text."""
        return json.loads(self.get(key, path, "text"))

    def names(self, key: Sequence, path: str = "") -> list[str]:
        """The visible names directly below the path."""
        n = len(segments(path))
        return [r["path"][-1] for r in self._rows(key, path) if len(r["path"]) == n + 1]

    def is_tombstone(self, key: Sequence, path: str) -> bool:
        found = self.get_all().where((F.col("kind") == "deleted") & (F.array_join("path", ".") == ".".join(segments(path))))
        for k, v in zip(self.keys, key):
            found = found.where(F.col(k).eqNullSafe(F.lit(v)))
        return not found.isEmpty()

    # ---- read, change, write ----

    def get_or_insert(self, key: Sequence, path: str, default: Any) -> Any:
        """The value; if nothing is there, the default, which is staged."""
        try:
            return self.get(key, path)
        except KeyNotFound:
            self.set(key, path, default)
            return default

    def modify(self, key: Sequence, path: str, change: Callable[[Any], Any]) -> Any:
        """Reads a leaf, stages what change makes of it and returns that; KeyNotFound if nothing is there."""
        new = change(self.get(key, path))
        self.set(key, path, new)
        return new

    def modify_or_insert(self, key: Sequence, path: str, default: Any, change: Callable[[Any], Any]) -> Any:
        """As modify(), starting from the default if nothing is there."""
        try:
            old = self.get(key, path)
        except KeyNotFound:
            old = default
        new = change(old)
        self.set(key, path, new)
        return new

    def editor(self, key: Sequence, path: str = "") -> Editor:
        return Editor(self, key, path)

    # ---- reads of all documents ----

    def get_all(self) -> DataFrame:
        return fold.nested(self.events, self.keys)

    def get_path(self, path: str) -> DataFrame:
        """The visible nodes at and below a dotted path; an empty one gives whole documents."""
        parts = segments(path)
        state = fold.nested(self.events, self.keys, parts).where(F.size("path") >= len(parts))
        return fold.live(state)

    def _at(self, path: str) -> DataFrame:
        return self.get_path(path).where(F.size("path") == len(segments(path)))

    def contains(self, path: str) -> DataFrame:
        """keys of the documents in which the path is visible."""
        return self._at(path).select(*self.keys)

    def get_as(self, path: str, kind: str) -> DataFrame:
        """keys, value and mismatch: the value if the node is of the kind, as a column of its type; mismatch where it is of another."""
        value = F.when(F.col("kind") == kind, F.col("value").cast({"bool": "boolean", "int": "bigint"}.get(kind, "string")))
        return self._at(path).select(*self.keys, value.alias("value"), (F.col("kind") != kind).alias("mismatch"))

    def lookup(self, path: str) -> DataFrame:
        """keys, kind and value of the visible node at the path; a number below a list is the index of a live item."""
        parts = segments(path)
        state = fold.live(fold.nested(self.events, self.keys, parts[:1]))
        at = state.select(*self.keys).distinct().withColumn("path", F.array().cast("array<string>"))
        for p in parts:
            named = at.withColumn("path", F.concat("path", F.array(F.lit(p))))
            if not p.isdigit():
                at = named
                continue
            above = F.slice("path", F.lit(1), F.size("path") - 1)
            lists = state.where("kind = 'list'").select(*self.keys, "path")
            items = state.where(F.size("path") > 0).select(*self.keys, above.alias("path"), F.col("path").alias("_item"))
            numbered = positions(items.join(at, [*self.keys, "path"], "left_semi").join(lists, [*self.keys, "path"], "left_semi"), [*self.keys, "path"], ["_item"])
            chosen = numbered.where(F.col("position") == int(p) + 1).select(*self.keys, F.col("_item").alias("path"))
            plain = at.join(lists, [*self.keys, "path"], "left_anti").withColumn("path", F.concat("path", F.array(F.lit(p))))
            at = chosen.unionByName(plain)
        return state.join(at, [*self.keys, "path"], "left_semi").select(*self.keys, "kind", "value")

    def counts(self) -> DataFrame:
        """keys, name, n_nodes, n_deleted: what each document holds under every top-level name."""
        return self.get_all().groupBy(*self.keys, F.element_at("path", 1).alias("name")).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("kind") == "deleted").alias("n_deleted"))

    def json(self, depth: int) -> DataFrame:
        return fold.to_json(self.get_all(), self.keys, depth)


class Editor:
    """A place in one document, from which values are read and changed."""

    def __init__(self, documents: Documents, key: Sequence, path: str) -> None:
        self.documents, self.key, self.path = documents, key, path

    def child(self, name: str) -> Editor:
        return Editor(self.documents, self.key, ".".join([*segments(self.path), *segments(name)]))

    def get(self) -> Any:
        return self.documents.get_node(self.key, self.path)

    def set(self, value: Any) -> None:
        self.documents.set(self.key, self.path, value)

    def delete_self(self) -> bool:
        return self.documents.delete(self.key, self.path)

    def delete_child(self, name: str) -> bool:
        return self.child(name).delete_self()


def list_items(positions_of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, index, value of live list items: rows (num, den, uid, value, deleted) in the order of their positions."""
    alive = positions_of.where("not deleted").select(*keys, "value", position_key(F.col("num"), F.col("den"), F.col("uid")).alias("_at"))
    return positions(alive, keys, ["_at"]).select(*keys, (F.col("position") - 1).alias("index"), "value")


def list_edit(items: DataFrame, keys: Sequence[str], what: str, index: int, value: str | None = None, uid: str = "new") -> DataFrame:
    """items (num, den, uid, value, deleted) of every list after one change by live index, tombstones kept.

    what is set, remove (a tombstone), insert or push. An index past the end changes nothing for set and remove, and
    appends for insert. New items go one before the first whole number, one after the last, or half way between.
    """
    columns = [*keys, "num", "den", "uid", "value", "deleted"]
    live = items.where("not deleted").select(*columns[:-1], position_key(F.col("num"), F.col("den"), F.col("uid")).alias("_at"))
    placed = positions(live, keys, ["_at"]).withColumn("index", F.col("position") - 1)
    if what in ("set", "remove"):
        hit = placed.where(F.col("index") == index).select(*keys, F.col("uid").alias("_uid"))
        same = [F.col(f"i.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys] + [F.col("i.uid") == F.col("h._uid")]
        joined = items.select(*columns).alias("i").join(hit.alias("h"), reduce(lambda a, b: a & b, same), "left")
        on = F.col("h._uid").isNotNull()
        new = F.when(on & F.lit(what == "set"), F.lit(value)).otherwise(F.col("i.value"))
        return joined.select(*[F.col(f"i.{c}") for c in columns[:-2]], new.alias("value"), (F.col("i.deleted") | (on & F.lit(what == "remove"))).alias("deleted"))
    n = F.count(F.lit(1))
    whole = F.floor(F.col("num") / F.col("den")).cast("bigint")
    at = F.lit(2**62 if what == "push" else index)
    pair = placed.groupBy(*keys).agg(
        n.alias("n"), F.min_by(whole, "index").alias("first"), F.max_by(whole, "index").alias("last"),
        *[F.max(F.when(F.col("index") == index - d, F.col(c))).alias(f"{c}{d}") for d in (1, 0) for c in ("num", "den")],
    )
    end, start = at >= F.col("n"), at <= 0
    num = F.when(end, F.col("last") + 1).when(start, F.col("first") - 1).otherwise(F.col("num1") * F.col("den0") + F.col("num0") * F.col("den1"))
    den = F.when(end | start, F.lit(1)).otherwise(2 * F.col("den1") * F.col("den0"))
    empty = items.select(*keys).distinct().join(pair.select(*keys), list(keys), "left_anti").select(*keys, F.lit(1).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"))
    added = pair.select(*keys, num.cast("bigint").alias("num"), den.cast("bigint").alias("den")).unionByName(empty)
    kept = items.select(*keys, F.col("num").cast("bigint").alias("num"), F.col("den").cast("bigint").alias("den"), "uid", "value", "deleted")
    return kept.unionByName(added.select(*keys, "num", "den", F.lit(uid).alias("uid"), F.lit(value).alias("value"), F.lit(False).alias("deleted")))
