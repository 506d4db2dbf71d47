"""Session, lineage cuts and the query registry."""
