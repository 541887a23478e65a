"""Query catalogue and helpers that cut lineage."""
