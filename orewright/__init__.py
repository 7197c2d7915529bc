"""Evidence analytics on Spark: typed facts, gates, a bitemporal ledger, graphs, search and a guarded query layer."""
