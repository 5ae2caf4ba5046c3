"""Schema of chat requests. Every field may be null."""

from __future__ import annotations

ITEM = "struct<type: string, text: string, input_index: int, min_pixels: long, max_pixels: long, resized_height: long, resized_width: long, sample_fps: double, raw_fps: double, total_pixels: long>"
TOOL_CALL = "struct<id: string, name: string, arguments_json: string>"
MESSAGE = f"struct<role: string, content_text: string, content_items: array<{ITEM}>, tool_calls: array<{TOOL_CALL}>, reasoning_content: string>"
IMAGE = "struct<kind: string, data: binary, format: string, height: int, width: int, row_stride: int>"
FRAME = "struct<data: binary, height: int, width: int, row_stride: int>"
VIDEO = f"struct<frames: array<{FRAME}>, timestamps: array<double>, fps: double, frames_indices: array<long>, total_num_frames: double, image_frames: boolean, preprocessed: boolean>"
OPTIONS = "struct<add_generation_prompt: boolean, add_vision_id: boolean, tools: array<string>, enable_thinking: boolean, excluded: array<string>>"
REQUEST = f"batch_id long, request_index int, profile string, messages array<{MESSAGE}>, images array<{IMAGE}>, videos array<{VIDEO}>, options {OPTIONS}"

ROLES = ("system", "user", "assistant", "tool")
ITEM_TYPES = ("text", "image", "video")
#: In the order in which they are told.
EXCLUDED = ("chat_template", "documents", "continue_final_message", "assistant_token_mask", "audio", "truncation", "left_padding", "pad_token_id")
