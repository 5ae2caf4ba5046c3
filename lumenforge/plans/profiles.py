"""The two model profiles. Fixed values."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

PATCH, TEMPORAL, MERGE, PATCH_WIDTH = 16, 2, 2, 1536
FACTOR = PATCH * MERGE
IMAGE_MIN, IMAGE_MAX = 4096, 16_777_216
MEAN = STD = 0.5

# Fixed values, equal to those of the models' published tokenizers.
PROFILES: dict[str, dict] = {
    "vl": {
        "pad": 151643,
        "eos": 151645,
        "image_pad": 151655,
        "video_pad": 151656,
        "vision_start": 151652,
        "vision_end": 151653,
        "model_max_length": 262144,
        "thinking": False,
    },
    "thinking": {
        "pad": 248044,
        "eos": 248046,
        "image_pad": 248056,
        "video_pad": 248057,
        "vision_start": 248053,
        "vision_end": 248054,
        "model_max_length": 262144,
        "thinking": True,
    },
}


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(profile: str) -> str:
    """SHA-256 of the profile's canonical JSON."""
    shared = {"patch": PATCH, "temporal": TEMPORAL, "merge": MERGE, "patch_width": PATCH_WIDTH, "mean": MEAN, "std": STD, "image_min": IMAGE_MIN, "image_max": IMAGE_MAX}
    return hashlib.sha256(canonical_json(PROFILES[profile] | shared).encode()).hexdigest()


def profiles_df(spark: SparkSession) -> DataFrame:
    """Two rows: every profile with its fingerprint."""
    rows = [(name, *p.values(), fingerprint(name)) for name, p in PROFILES.items()]
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in PROFILES["vl"].items())
    return spark.createDataFrame(rows, f"profile string, {kinds}, fingerprint string")


def check_semantics(table: dict[str, dict]) -> None:
    """A profile table from elsewhere must hold the frozen values."""
    from .errors import ProfileMismatchError

    for name, values in table.items():
        if name not in PROFILES or any(PROFILES[name].get(k) != v for k, v in values.items()):
            raise ProfileMismatchError(f"profile {name} differs from the frozen values")
