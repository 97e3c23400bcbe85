"""Imports every module that registers queries."""

from quarry.functions import code, compress, structure
from quarry.operators import aggregates, logs, relations, retrieval, stored_index, windows
from quarry.plans import audit, composites, definitions, derived, graph, imports, outline, spectral
from quarry.registry import FLAGSHIP, ORACLE_SQL, QUERIES
from quarry.sources import files, maintenance, repository, tail
from quarry.streaming import changes, events, snapshots

MODULES = [retrieval, stored_index, aggregates, windows, relations, graph, spectral, logs, code, events, files, audit, composites, definitions, derived, imports, outline, structure, compress, maintenance, tail, repository, changes, snapshots]
__all__ = ["FLAGSHIP", "MODULES", "ORACLE_SQL", "QUERIES"]
