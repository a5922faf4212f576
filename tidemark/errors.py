"""Failures by what a caller can do about them; the command line's exit codes follow."""

from __future__ import annotations


class TidemarkError(Exception):
    exit_code = 1


class ConfigError(TidemarkError):
    exit_code = 10


class PlanError(ConfigError):
    pass


class DataSafetyError(TidemarkError):
    """Going on could lose or repeat events."""

    exit_code = 20


class DecodeError(DataSafetyError):
    pass


class StreamStateError(DataSafetyError):
    pass


class DuplicateSequence(DataSafetyError):
    pass


class DuplicateMarker(DataSafetyError):
    pass


class DuplicateEvent(DataSafetyError):
    pass


class PartiallyPersisted(DataSafetyError):
    def __init__(self, duplicates: int, events: int):
        super().__init__(f"{duplicates} of {events} events are already in the log")
        self.duplicates, self.events = duplicates, events


class IdentityMismatch(DataSafetyError):
    pass


class ResumeGap(DataSafetyError):
    pass


class IntegrityError(DataSafetyError):
    pass


class UnsupportedFormat(DataSafetyError):
    pass


class EventLimitExceeded(DataSafetyError):
    pass


class ByteLimitExceeded(DataSafetyError):
    pass


class ResourceLimit(TidemarkError):
    pass


class SequenceExpired(TidemarkError):
    def __init__(self, requested: int, first_available: int):
        super().__init__(f"sequence {requested} is expired; the first available is {first_available}")
        self.requested, self.first_available = requested, first_available


class ApiError(TidemarkError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code = code


class SinkError(TidemarkError):
    """Delivery that fails for good."""


class RetryableSinkError(TidemarkError):
    """Delivery that may work later."""
