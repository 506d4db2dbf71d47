"""A database as a whole: one tree's entries, links and patches, read now or as of a snapshot.

    db = Database(entries, edges, patches, store_edges, "tree")
    db.table("people", "name string, age int").search("age > 30")
    db.at(["entry-1", "entry-2"]).table("people", "name string, age int").rows()
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborfold.operators import commits, dag, verify
from arborfold.operators.tables import Documents, Table


class EntryNotFound(LookupError):
    """No entry has the id."""


class EntryNotInTree(LookupError):
    """The entry belongs to another tree."""


class Database:
    """Reads of one tree.

    entries has (tree_id, entry_id, height[, status, valid]), edges (tree_id, child_id, parent_id), patches (tree_id,
    store, entry_id, height and the columns of the store's events), store_edges (tree_id, store, child_id, parent_id).
    """

    def __init__(self, entries: DataFrame, edges: DataFrame, patches: DataFrame, store_edges: DataFrame, tree_id: str, tips: Sequence[str] | None = None) -> None:
        self.tree_id, self.tips = tree_id, None if tips is None else sorted(set(tips))
        self._all = entries
        mine = F.col("tree_id") == tree_id
        self._entries, self._edges, self._patches, self._store_edges = (d.where(mine) for d in (entries, edges, patches, store_edges))

    def _ids(self, ids: Sequence[str]) -> DataFrame:
        return self._all.sparkSession.createDataFrame([(self.tree_id, i) for i in ids], "tree_id string, entry_id string")

    def at(self, tips: Sequence[str]) -> Database:
        """The database as of a snapshot; its tips must be entries of the tree."""
        bad = dag.bad_tips(self._all, self._ids(tips)).first() if tips else None
        if bad:
            raise (EntryNotFound if bad["error"] == "not_found" else EntryNotInTree)(bad["entry_id"])
        out = object.__new__(Database)
        out.__dict__.update(self.__dict__)
        out.tips = sorted(set(tips))
        return out

    def entries(self) -> DataFrame:
        """All entries at or above the snapshot. Without one no closure is needed: everything is above some tip."""
        return self._entries if self.tips is None else dag.tree_at(self._entries, self._edges, self._ids(self.tips))

    def get(self, entry_id: str) -> dict:
        found = self._all.where(F.col("entry_id") == entry_id).first()
        if found is None:
            raise EntryNotFound(entry_id)
        if found["tree_id"] != self.tree_id:
            raise EntryNotInTree(entry_id)
        return found.asDict(recursive=True)

    def snapshot(self, verified: bool = False) -> list[str]:
        """The tips of the tree, or of its verified entries; as of a snapshot, that snapshot."""
        if self.tips is not None:
            return self.tips
        tips = verify.verified_frontier(self._entries, self._edges) if verified else dag.tree_tips(self._entries, self._edges)
        return sorted(r["entry_id"] for r in tips.select("entry_id").collect())

    def store_snapshot(self, store: str) -> DataFrame:
        """entry_id of the store's tips."""
        patches, edges = (d.where(F.col("store") == store) for d in (self._patches, self._store_edges))
        if self.tips is None:
            return dag.store_tips(patches, edges).select("entry_id")
        return dag.store_tips_at(self._entries, self._edges, patches, edges, self._ids(self.tips)).select("entry_id")

    def store_entries(self, store: str) -> DataFrame:
        """The store's patches that the state is folded from."""
        patches = self._patches.where(F.col("store") == store)
        if self.tips is None:
            return patches
        return patches.join(dag.ancestors(self._edges, self._ids(self.tips)), "entry_id", "left_semi")

    def table(self, store: str, schema: str) -> Table:
        """A table store; its patches have key, row and kind."""
        return Table(self.store_entries(store), schema)

    def documents(self, store: str) -> Documents:
        """A document store; its patches have path, cont, kind and value."""
        return Documents(self.store_entries(store), ["tree_id", "store"])

    def added_since(self, tips: Sequence[str]) -> DataFrame:
        """tree_id, entry_id, height and position of what this database has and the older snapshot had not."""
        return dag.ids_added(self._entries, self._edges, self._ids(tips), self._ids(self.snapshot()))

    def missing_for(self, their_tips: Sequence[str]) -> DataFrame:
        """entry_id of what a peer with these tips needs; with none, everything."""
        ours = [t for t in self.snapshot() if t not in set(their_tips)]
        return dag.ancestors(self._edges, self._ids(ours), self._ids(their_tips))

    def merge_base(self, ids: Sequence[str]) -> str | None:
        """The lowest entry on every way up from the ids; None if there is none."""
        found = dag.merge_bases(self._edges, self._ids(ids)).first()
        return found["base"] if found else ids[0] if len(set(ids)) == 1 else None

    def verify(self) -> DataFrame:
        return verify.verify(self._entries, self._edges)

    def commit(self, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows and edges of new entries (tree_id, entry_id) on the current tips."""
        return commits.commit(self._entries, self._edges, new)
