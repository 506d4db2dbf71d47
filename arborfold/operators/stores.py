"""Views of system documents: the registry of stores, a database's settings, and databases found by them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.operators import fold
from arborfold.operators.tables import Documents


class DatabaseNotFound(LookupError):
    """No tracked database has the name."""


def _leaf(path: Sequence[str | None], kind: str = "text"):  # noqa: ANN202
    """The value of the leaf at a path (None: any segment), for an aggregate over a document's nodes."""
    at = (F.size("path") == len(path)) & (F.col("kind") == kind)
    for i, p in enumerate(path):
        if p is not None:
            at = at & (F.try_element_at("path", F.lit(i + 1)) == p)
    return F.max(F.when(at, F.col("value")))


class Registry:
    """Stores by name: a document of {name: {type, config, settings}}. keys name one document, as in Documents."""

    def __init__(self, documents: Documents) -> None:
        self.documents = documents

    def all(self) -> DataFrame:
        """keys, name, type, config of every registered store; deleted ones are hidden."""
        nodes = fold.live(self.documents.get_all())
        keys = self.documents.keys
        own = nodes.groupBy(*keys, F.element_at("path", 1).alias("name"))
        return own.agg(_leaf([None, "type"]).alias("type"), _leaf([None, "config"]).alias("config")).where("type is not null")

    def get_entry(self, key: Sequence, name: str) -> dict:
        """type and config (and settings, if there are any) of one store; KeyNotFound without."""
        return self.documents.get_node(key, name)

    def contains(self, key: Sequence, name: str) -> bool:
        return self.documents.get_option(key, f"{name}.type", "text") is not None

    def list(self, key: Sequence) -> list[str]:
        return self.documents.names(key)

    def settings(self, key: Sequence, name: str) -> Any:
        entry = self.get_entry(key, name)
        return entry.get("settings")

    def set_entry(self, key: Sequence, name: str, type_: str, config: str) -> None:
        """Stages type and config; settings that are there stay."""
        self.documents.set(key, f"{name}.type", type_)
        self.documents.set(key, f"{name}.config", config)


def open_states(registered: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (tree_id, store, type) with state: system (not registered), ok, registered (new here) or type_mismatch.

    registered has (tree_id, name, type); names that start with _ are system stores.
    """
    known = registered.select(F.col("tree_id").alias("_t"), F.col("name").alias("_s"), F.col("type").alias("_type"))
    joined = wanted.join(known, (F.col("tree_id") == F.col("_t")) & (F.col("store") == F.col("_s")), "left")
    state = F.when(F.startswith("store", F.lit("_")), "system").when(F.col("_type").isNull(), "registered").when(F.col("_type") == F.col("type"), "ok").otherwise("type_mismatch")
    return joined.select("tree_id", "store", "type", state.alias("state"))


def settings(documents: Documents) -> DataFrame:
    """keys, name, height_strategy, auth, n_keys of every document of settings.

    auth is none (no keys were ever configured), set, or corrupted: deleted, or no document.
    """
    state = documents.get_all()
    auth = F.max(F.when((F.size("path") == 1) & (F.element_at("path", 1) == "auth"), F.col("kind")))
    key = (F.size("path") == 3) & (F.slice("path", 1, 2) == F.array(F.lit("auth"), F.lit("keys"))) & (F.col("kind") != "deleted")
    return state.groupBy(*documents.keys).agg(
        _leaf(["name"]).alias("name"),
        F.coalesce(_leaf(["height_strategy"]), F.lit("incremental")).alias("height_strategy"),
        F.when(auth.isNull(), "none").when(auth == "doc", "set").otherwise("corrupted").alias("auth"),
        F.count_if(key).alias("n_keys"),
    )


class SettingsStore:
    """One document of settings: name, height strategy, keys with their permissions."""

    def __init__(self, documents: Documents, key: Sequence) -> None:
        self.documents, self.key = documents, key

    def name(self) -> str | None:
        return self.documents.get_option(self.key, "name", "text")

    def set_name(self, name: str) -> None:
        self.documents.set(self.key, "name", name)

    def height_strategy(self) -> str:
        return self.documents.get_option(self.key, "height_strategy", "text") or "incremental"

    def set_height_strategy(self, strategy: str) -> None:
        if strategy not in ("incremental", "timestamp"):
            raise ValueError(strategy)
        self.documents.set(self.key, "height_strategy", strategy)

    def auth_keys(self) -> dict[str, dict]:
        return {k: self.documents.get_node(self.key, f"auth.keys.{k}") for k in self.documents.names(self.key, "auth.keys")}

    def set_auth_key(self, pubkey: str, permission: str, priority: int | None = None, name: str | None = None, status: str = "Active") -> None:
        self.documents.set(self.key, f"auth.keys.{pubkey}", {"permission": permission, "priority": priority, "name": name, "status": status})

    def revoke(self, pubkey: str) -> None:
        self.documents.get_node(self.key, f"auth.keys.{pubkey}")  # KeyNotFound if it is not there
        self.documents.set(self.key, f"auth.keys.{pubkey}.status", "Revoked")


def find_database(tracked: DataFrame, settings_: DataFrame, name: str) -> DataFrame:
    """The tracked (tree_id) databases whose settings (tree_id, name) have the name; DatabaseNotFound if there are none."""
    found = tracked.join(settings_.where(F.col("name") == name).select("tree_id", "name"), "tree_id")
    if found.isEmpty():
        raise DatabaseNotFound(name)
    return found
