"""One load per Python worker.

A Python worker process serves many tasks and each of their Arrow batches; a
model or tokenizer should be loaded by the first of them only.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_LOADED: dict[str, Any] = {}


def once(loader: Callable[[], Any], name: str) -> Any:
    """What ``loader`` returns, called once in this process for ``name``."""
    if name not in _LOADED:
        _LOADED[name] = loader()
    return _LOADED[name]
