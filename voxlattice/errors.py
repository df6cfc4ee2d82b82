"""The exceptions of the engine."""


class SpatialError(Exception):
    """Base of all errors that the engine raises itself."""


class IdError(SpatialError, ValueError):
    """An identifier outside its domain (zoom, index, interval)."""


class ParseError(IdError):
    """Text that is not an identifier."""


class GeometryError(SpatialError, ValueError):
    """A coordinate or shape that does not exist (latitude, radius, open solid)."""


class InvalidQueryParameter(SpatialError, ValueError):
    """A query operator with parameters that cannot be executed."""


class SourceReadError(SpatialError):
    """A source that could not be read."""


class UnsupportedFormat(SourceReadError):
    """A stored document or table of another format or version."""


class UnsupportedOperation(SpatialError, NotImplementedError):
    """An operation that the engine does not have for these operands."""


class InvalidShardMerge(SpatialError, ValueError):
    """Shards that overlap or lie outside their parent."""


class Cancelled(SpatialError):
    """The query's job group was cancelled."""
