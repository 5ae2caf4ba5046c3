"""Error categories, their order, and exceptions. Fixed values."""

from __future__ import annotations

STAGES = ("request_structure", "profile", "options", "resource_preflight", "decode", "geometry", "destination", "execution_invariant")
#: Which error of one stage is told first: the lower, and then the lower occurrence.
PRECEDENCE = {
    "arithmetic_overflow": 0,
    "resource_limit": 1,
    "unsupported_media": 2,
    "media_decode": 2,
    "media_geometry": 3,
    "destination_too_small": 4,
    "internal_invariant": 5,
    "invalid_request": 6,
    "unsupported_option": 6,
    "profile_mismatch": 6,
}


class EngineError(Exception):
    """An error with a category and context."""

    category = "internal_invariant"

    def __init__(self, message: str, **context: object) -> None:
        super().__init__(message)
        self.context = context


class ArithmeticOverflowError(EngineError):
    category = "arithmetic_overflow"


class ResourceLimitError(EngineError):
    category = "resource_limit"


class UnsupportedMediaError(EngineError):
    category = "unsupported_media"


class MediaDecodeError(EngineError):
    category = "media_decode"


class MediaGeometryError(EngineError):
    category = "media_geometry"


class DestinationTooSmallError(EngineError):
    category = "destination_too_small"


class InternalInvariantError(EngineError):
    category = "internal_invariant"


class InvalidRequestError(EngineError):
    category = "invalid_request"


class UnsupportedOptionError(EngineError):
    category = "unsupported_option"


class ProfileMismatchError(EngineError):
    category = "profile_mismatch"


BY_CATEGORY: dict[str, type[EngineError]] = {x.category: x for x in EngineError.__subclasses__()}


def raised(category: str, message: str, **context: object) -> EngineError:
    return BY_CATEGORY[category](message, **context)
