"""Sequence-graph analytics and corpus operators as Spark plans."""
