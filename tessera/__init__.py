"""Tessera: data alignment, profiling, predicates and table changes as lazy Spark plans."""
