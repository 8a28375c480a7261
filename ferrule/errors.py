"""One root for all errors of the engine."""


class EngineError(Exception):
    """Any failure the engine reports itself."""


class ParseError(EngineError):
    """Text outside the dialect: says what was expected, what was found, where, and in which text."""


class AnalysisError(EngineError):
    """A statement that names or combines things that do not exist or do not fit."""


class StorageError(EngineError):
    """Tables, files or log entries that are missing, damaged or in the way."""


class SerializationError(StorageError):
    """A value that its column's type cannot hold."""


class ConstraintError(EngineError):
    """NULL for a column declared NOT NULL."""


class ConflictError(EngineError):
    """Another transaction wrote a row first."""
