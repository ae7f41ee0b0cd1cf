"""Registered queries on the given tables, and the SQL that they must equal."""

from tilewright.plans import readers, tables, vectors

QUERIES = vectors.QUERIES | tables.QUERIES | readers.QUERIES
ORACLES = vectors.ORACLES | tables.ORACLES | readers.ORACLES
