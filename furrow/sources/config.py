"""Configuration: JSON or YAML files that extend one another, with environment values and checks. Driver side only."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any


def merged(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``; mappings are merged, other values replaced. Neither is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def expanded(value: Any, env: dict[str, str] | None = None) -> Any:
    """${NAME} and ${NAME:-default} in strings, at any depth; an unset name without default is an error."""
    env = os.environ if env is None else env

    def put(m: re.Match) -> str:
        name, _, default = m[1].partition(":-")
        if name in env:
            return env[name]
        if ":-" in m[1]:
            return default
        raise KeyError(f"{name} isn't set")

    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    return re.sub(r"\$\{([^}]+)\}", put, value) if isinstance(value, str) else value


def _parse(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need PyYAML; JSON files don't") from e
    return yaml.safe_load(text) or {}


def load(path: str | Path, env: dict[str, str] | None = None, _above: tuple[Path, ...] = ()) -> dict:
    """A file laid over the one its ``extends`` names, relative to it. A cycle is an error."""
    path = Path(path).resolve()
    if path in _above:
        raise ValueError(f"{path} extends itself")
    own = _parse(path)
    parent = own.pop("extends", None)
    return expanded(merged(load(path.parent / parent, env, (*_above, path)), own) if parent else own, env)


def problems(config: dict, rules: dict[str, tuple[float, float]]) -> list[str]:
    """Dotted keys that are absent, no number or outside their range (both ends allowed)."""
    found = []
    for key, (low, high) in rules.items():
        value: Any = config
        for part in key.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            found.append(f"{key} isn't a number")
        elif not low <= value <= high:
            found.append(f"{key} = {value} isn't in {low}..{high}")
    return found


#: What a rule asks of a value: a number in a range, one of a few values, or another key's bound.
WITHIN, ABOVE, BETWEEN, ONE_OF, BELOW_KEY = "within", "above", "between", "one_of", "below_key"
# The rules of a session's and a run's configuration. Ends belong to "within"; "above" and "between" leave them out.
RULES = [
    ("runtime.queue_capacity", ONE_OF, (1,)),
    ("models.detector.task", ONE_OF, ("detect",)),
    ("models.detector.image_size", ABOVE, 0),
    ("models.detector.confidence_threshold", WITHIN, (0, 1)),
    ("models.detector.nms_iou_threshold", WITHIN, (0, 1)),
    ("models.detector.interval_frames", WITHIN, (1, None)),
    ("models.detector.tile_size", ABOVE, 0),
    ("models.detector.tile_overlap", WITHIN, (0, None)),
    ("models.detector.tile_overlap", BELOW_KEY, "models.detector.tile_size"),
    ("models.detector.global_nms_iou", WITHIN, (0, 1)),
    ("models.detector.max_detections_full_frame", WITHIN, (1, None)),
    ("models.segmenter.task", ONE_OF, ("segment",)),
    ("models.segmenter.image_size", ABOVE, 0),
    ("models.segmenter.confidence_threshold", WITHIN, (0, 1)),
    ("models.segmenter.nms_iou_threshold", WITHIN, (0, 1)),
    ("models.segmenter.interval_frames", WITHIN, (1, None)),
    ("storage.max_session_bytes", WITHIN, (1024 * 1024, None)),
    ("storage.min_free_bytes", WITHIN, (128 * 1024 * 1024, None)),
    ("storage.log_rotate_bytes", WITHIN, (1024, None)),
    ("storage.jsonl_rotate_bytes", WITHIN, (1024, None)),
    ("storage.jsonl_backup_count", WITHIN, (1, 20)),
    ("overlay.enabled", ONE_OF, (True, False)),
    ("overlay.stale_result_timeout_ms", WITHIN, (100, None)),
    ("overlay.mode", ONE_OF, ("compact",)),
    ("overlay.selection_strategy", ONE_OF, ("confidence", "confidence_central")),
    ("overlay.aspect_mode", ONE_OF, ("stretch", "contain", "cover")),
    ("overlay.rotation_degrees", ONE_OF, (0, 90, 180, 270)),
    ("live.frame_queue_size", ONE_OF, (1,)),
    ("live.drop_old_frames", ONE_OF, (True,)),
    ("live.batch_size", ONE_OF, (1,)),
    ("live.target_inference_fps", ABOVE, 0),
    ("live.stream_timeout_ms", WITHIN, (1000, None)),
    ("live.reconnect_interval_ms", WITHIN, (1000, None)),
    ("live.worker_heartbeat_timeout_ms", WITHIN, (1000, None)),
    ("logging.save_all_detections", ONE_OF, (True,)),
    ("logging.sample_interval_seconds", ABOVE, 0),
    ("registration.preview_width", WITHIN, (320, None)),
    ("registration.ratio_test", BETWEEN, (0, 1)),
    ("fusion.association_spacing_fraction", BETWEEN, (0, 0.5)),
    ("coverage.minimum_gap_opportunity", WITHIN, (1, None)),
    ("max_detections_per_tile", WITHIN, (1000, None)),
    ("max_detections_full_frame", ABOVE, 300),
    ("roi_mode", ONE_OF, ("full_frame", "manual_rectangle", "dataset_derived")),
    ("playback_mode", ONE_OF, ("processed_frames_only", "continuous_video")),
]


def value_at(config: dict, key: str) -> Any:
    for part in key.split("."):
        config = config.get(part) if isinstance(config, dict) else None
    return config


def broken(config: dict, rules: list[tuple] = RULES) -> list[str]:
    """Rules that a configuration breaks, as texts. Keys of sections (or plain keys) that it doesn't have aren't asked for; within a section all are."""

    def good(key: str, kind: str, asked: Any) -> bool:
        value = value_at(config, key)
        if kind == ONE_OF:
            return any(value == a and isinstance(value, bool) == isinstance(a, bool) for a in asked)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            return False
        if kind == BELOW_KEY:
            other = value_at(config, asked)
            return isinstance(other, (int, float)) and value < other
        if kind == ABOVE:
            return value > asked
        low, high = asked
        return low < value < high if kind == BETWEEN else (low is None or value >= low) and (high is None or value <= high)

    return [f"{key} = {value_at(config, key)!r} isn't {kind} {asked!r}" for key, kind, asked in rules if key.partition(".")[0] in config and not good(key, kind, asked)]
