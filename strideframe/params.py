"""Settings: YAML files with one level of `extends`, overrides for a clip, all as plain dictionaries on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml


def merged(base: Mapping[str, Any], more: Mapping[str, Any]) -> dict[str, Any]:
    """base with more on top; mappings are merged, everything else is replaced."""
    out = dict(base)
    for k, v in more.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(path: str | Path) -> dict[str, Any]:
    path = Path(path)
    own = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    parent = own.pop("extends", None)
    return merged(yaml.safe_load((path.parent / parent).read_text(encoding="utf-8")) or {}, own) if parent else own


def for_clip(settings: Mapping[str, Any], clip_id: str) -> dict[str, Any]:
    """A section with its clip_overrides for one clip applied."""
    base = {k: v for k, v in settings.items() if k != "clip_overrides"}
    return merged(base, (settings.get("clip_overrides") or {}).get(clip_id, {}))
