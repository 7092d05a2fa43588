"""What a Python worker keeps from one task to the next: one thing at a time, so that operators that share workers don't add up."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` made for this key, if that is what the worker holds; else it is made now, in place of what was held."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    _HELD.clear()
