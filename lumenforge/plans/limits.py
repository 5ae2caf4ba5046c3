"""The 15 resource limits. Fixed values; callers may lower them only."""

from __future__ import annotations

LIMITS: dict[str, int] = {
    "requests_per_batch": 256,
    "messages_per_request": 256,
    "content_items_per_request": 1024,
    "text_bytes_per_request": 4 * 1024 * 1024,
    "media_per_request": 64,
    "media_per_batch": 256,
    "encoded_bytes_per_item": 64 * 1024 * 1024,
    "encoded_bytes_per_batch": 1024 * 1024 * 1024,
    "decoded_pixels_per_image_or_frame": 67_108_864,
    "decoded_edge_length": 32_768,
    "prepared_image_pixels_per_occurrence": 16_777_216,
    "raw_frames_per_video": 768,
    "rendered_tokens_per_request": 262_144,
    "rendered_tokens_per_batch": 1_048_576,
    "materialized_output_bytes_per_batch": 4 * 1024 * 1024 * 1024,
}


def lowered(overrides: dict[str, int] | None = None) -> dict[str, int]:
    """The limits with some of them lowered."""
    from .errors import InvalidRequestError, UnsupportedOptionError

    out = dict(LIMITS)
    for name, value in (overrides or {}).items():
        if name not in LIMITS:
            raise InvalidRequestError(f"unknown limit {name}")
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise InvalidRequestError(f"limit {name} must be a whole number")
        if value > LIMITS[name]:
            raise UnsupportedOptionError(f"limit {name} can't be raised")
        out[name] = value
    return out
