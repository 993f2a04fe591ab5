"""Settings: defaults, overlaid by a JSON file's keys; a bad file changes nothing."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits that results depend on."""

    ocr_confidence: float = 0.4
    min_fields: int = 3
    text_gate: int = 100
    ocr_gate: int = 50
    sampled_pages: int = 5
    max_retries: int = 3
    min_download_bytes: int = 1000


def load(path: str | None = None, base: Settings | None = None) -> Settings:
    out = base or Settings()
    if path:
        try:
            given = json.loads(Path(path).read_text(encoding="utf-8"))
            out = replace(out, **{f.name: given[f.name] for f in fields(out) if f.name in given})
        except (OSError, ValueError, TypeError) as e:
            logging.getLogger(__name__).warning("settings in %s are ignored: %s", path, e)
    return out
