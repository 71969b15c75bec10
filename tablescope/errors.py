"""Exceptions raised by the library."""


class ValidationError(Exception):
    """The input cannot be used as a table, or a named column does not fit the operator."""


class CheckpointDirError(RuntimeError):
    """A cluster session names no shared folder for intermediate tables."""
