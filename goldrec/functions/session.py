"""Column expressions that are the same for every table are built once per Spark session: each call from Python to the
JVM costs a fraction of a millisecond, and a large expression takes thousands."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext

_built: dict = {}


def once_per_session(make: Callable) -> Callable:
    """make's result for these arguments, kept as long as the session's context is the same. Arguments are told apart by
    their text."""

    @wraps(make)
    def kept(*args, **kwargs):
        context = SparkContext._active_spark_context
        key = (make.__module__, make.__qualname__, repr(args), repr(sorted(kwargs.items())))
        if key not in _built or _built[key][0] is not context:
            _built[key] = context, make(*args, **kwargs), args, kwargs  # the arguments too: their text may name an address
        return _built[key][1]

    return kept
