"""What a Python worker keeps from task to task: one object of each kind, the last one asked for.

Called from inside a task's function, which travels by value, this module is imported by the worker and so outlives the task.
"""

from __future__ import annotations

from collections.abc import Callable

_KEPT: dict[str, tuple[str, object]] = {}


def kept(kind: str, name: str, make: Callable[[], object]):
    """The object of this ``kind`` and ``name``, made once a worker; another name takes its place."""
    if kind not in _KEPT or _KEPT[kind][0] != name:
        _KEPT.pop(kind, None)
        _KEPT[kind] = name, make()
    return _KEPT[kind][1]
