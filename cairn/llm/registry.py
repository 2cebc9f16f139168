"""All queries of this subpackage and their SQL, by name."""

from cairn.llm import queries
from cairn.session import shipped

_MODULES = [queries]

QUERIES = {name: shipped(fn) for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
