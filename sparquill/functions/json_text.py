"""JSON values as the text that they are stored and compared as."""

from __future__ import annotations

import json
from typing import Any


def _plain(x: Any) -> Any:
    if isinstance(x, float) and x.is_integer():
        return int(x)  # 1.0 and 1 are one number
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def json_text(x: Any) -> str:
    """Compact JSON, keys in their order."""
    return json.dumps(_plain(x), separators=(",", ":"), ensure_ascii=False)
