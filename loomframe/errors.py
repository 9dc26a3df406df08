"""Exceptions. They are raised while a plan is built, from the schema, wherever that is possible."""


class FrameError(Exception):
    """Any error of this package."""


class ColumnNotFoundError(FrameError):
    """A name that the frame doesn't have."""


class SchemaError(FrameError):
    """Types or names that don't go together."""


class ComputeError(FrameError):
    """A value that can't be computed."""


class ShapeError(FrameError):
    """Heights or widths that don't agree."""


class InvalidArgumentError(FrameError):
    """An argument out of its range, or arguments that exclude each other."""


class StreamError(FrameError):
    """A source or sink that can't be read or written."""
