"""What a Python worker keeps from task to task: the memory of one operator at a time."""

from __future__ import annotations

from collections.abc import Callable, Hashable

_HELD: dict[Hashable, object] = {}


def keep_one(key: Hashable, make: Callable[[], object]):
    """The object of this key. It is made, and what other keys left is dropped, if the worker does not hold it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def drop_all() -> None:
    """For operators that keep nothing: give back what others left."""
    _HELD.clear()
