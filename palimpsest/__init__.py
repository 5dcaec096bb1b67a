"""Versioned relational tables on Spark: snapshots, transactions, ordered keys, a catalog."""
