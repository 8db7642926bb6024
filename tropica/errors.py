"""Failures of graph operators; each carries the numeric code that callers can test for."""

from __future__ import annotations


class GraphError(Exception):
    code = -1


class InvalidGraph(GraphError):
    code = -1000


class SymmetryRequired(GraphError):
    code = -1001


class ReadWriteError(GraphError):
    code = -1002


class NotCached(GraphError):
    code = -1003


class NoSelfEdgesAllowed(GraphError):
    code = -1004


class ConvergenceFailure(GraphError):
    code = -1005


class InvalidIndex(GraphError):
    code = -4


class InvalidValue(GraphError):
    code = -3


class DimensionMismatch(GraphError):
    code = -6


class IndexOutOfBounds(GraphError):
    code = -105


class NotImplementedKind(GraphError):
    code = -8


class NegativeCycle(GraphError):
    code = 1


class CacheNotNeeded(Warning):
    code = 1000
