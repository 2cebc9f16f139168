"""All queries of the core and their SQL, by name."""

from cairn.plans import code_queries, data_queries, lookup_queries
from cairn.session import shipped

_MODULES = [data_queries, code_queries, lookup_queries]

QUERIES = {name: shipped(fn) for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
