"""Distinct errors for the distinct ways in which an input can be unusable."""


class TriageError(Exception):
    """Base of all errors raised here."""


class SourceMissing(TriageError, FileNotFoundError):
    """The input path does not exist."""


class SourceEmpty(TriageError, ValueError):
    """The input file holds nothing, not even a header."""


class MissingColumns(TriageError, ValueError):
    """A required column is absent."""


class NoUsableRows(TriageError, ValueError):
    """Cleaning left no row."""


class TooFewClasses(TriageError, ValueError):
    """Training needs at least two classes."""


class LimitExceeded(TriageError, ValueError):
    """Something that must stay small (classes, a driver-held vocabulary) is not small."""


class ModelNotFound(TriageError, FileNotFoundError):
    """No fitted model is stored at the given path."""


class NoSharedFolder(TriageError, RuntimeError):
    """A cluster session names no shared folder for intermediate tables."""
