"""Models that stay loaded as long as a Python worker lives.

Spark keeps Python workers between tasks and jobs (``spark.python.worker.reuse``). A stage made by
``Stage.from_loader`` is loaded by the first task of a worker that needs it; later tasks of that worker, also those of
other jobs, find it here. At most ``LIMIT`` models are held; the one that was used longest ago goes first, and its
``close()`` is called if it has one. What is still held when a worker ends goes with its process.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle

LIMIT = 4

_held: OrderedDict[str, Any] = OrderedDict()


def content_key(load: Callable[[], Any]) -> str:
    """The same key for loaders of the same code and captured values, also in a later plan of this driver."""
    return hashlib.sha256(cloudpickle.dumps(load)).hexdigest()


def loaded(key: str, load: Callable[[], Any], limit: int | None = None) -> Any:
    """The model under ``key``, loaded now if this worker does not hold it. A loader that raises leaves nothing behind."""
    if key in _held:
        _held.move_to_end(key)
        return _held[key]
    limit = LIMIT if limit is None else limit
    while len(_held) >= max(limit, 1):  # make room first, so that never more than the limit is in memory
        _release(_held.popitem(last=False)[1])
    _held[key] = load()
    return _held[key]


def release_all() -> int:
    """Let go of every model of this process; returns how many there were."""
    count = len(_held)
    while _held:
        _release(_held.popitem()[1])
    return count


def _release(model: Any) -> None:
    close = getattr(model, "close", None)
    if callable(close):
        close()
