"""Registered queries over the given tables, each beside its SQL twin."""

from auditspark.queries import grading, modelling, profiling

_MODULES = (profiling, modelling, grading)
ALL_QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ALL_ORACLES = {name: s for m in _MODULES for name, s in m.ORACLES.items()}
