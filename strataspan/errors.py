"""What a call is refused for; raised when the plan is made, never after part of an answer."""


class GraphError(ValueError):
    pass


class ConflictingTemporalOpts(GraphError):
    pass


class InvalidTimeRange(GraphError):
    pass


class TxPinUnsupported(GraphError):
    pass


class NotFound(GraphError):
    pass


class MixedNumericColumn(GraphError):
    pass


class UniqueViolation(GraphError):
    pass


class ConstraintViolation(GraphError):
    pass


class LastLabel(GraphError):
    pass


class NothingToExcise(GraphError):
    pass


class OpenInterval(GraphError):
    pass


class PinTooOld(GraphError):
    """The pin is below what compaction or retention left answerable."""
