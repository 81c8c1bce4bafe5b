"""The session as the operators need it."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

import tidelake
from tidelake.session import configure

#: What this worker process remembers from task to task, by the operator that uses it.
_KEPT: dict[str, dict[Any, Any]] = {}
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(tidelake.__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Configure the session, and let Python workers import this package where it lies.

    On a cluster the package is deployed as usual; this only helps where the driver's
    folders are the workers' too and the session was started from elsewhere.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, known]))
    return configure(spark)


def kept(owner: str, key: Any, make: Callable[[Any], Any]) -> Any:
    """What ``make(key)`` gave in this worker before, or gives now.

    Spark uses a worker again for other stages, where tokenizers and caches of words are in
    the way of their memory: whatever another operator keeps goes.
    """
    forget(owner)
    own = _KEPT.setdefault(owner, {})
    if key not in own:
        own[key] = make(key)
    return own[key]


def forget(owner: str | None = None) -> None:
    """Drop what operators other than ``owner`` keep in this worker; for the start of a task."""
    others = _KEPT.keys() - {owner}
    for name in others:
        del _KEPT[name]
    if others:
        pa.default_memory_pool().release_unused()
