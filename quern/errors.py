"""Errors of the engine."""


class QuernError(Exception):
    """Base of all errors raised by the engine."""


class SqlSyntaxError(QuernError):
    """The statement cannot be parsed."""


class UnsupportedFeature(QuernError):
    """The statement parses, but uses a feature that the engine does not have; nothing is dropped silently."""
