"""Binding a value inside a column expression."""

from __future__ import annotations

from functools import lru_cache, wraps
from typing import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once.

    Spark evaluates an expression that a lambda reads from outside once per
    element, and one that is written twice twice; a lambda's own variable is a
    value already.  (The value is the start of a fold over nothing, whose last step
    is ``body``: unlike ``transform`` it copies no result.  The expression is
    interpreted: for arrays of structs, not for whole-stage code.)
    """
    return F.aggregate(F.expr("array()"), value, lambda v, _: v, body)


def built_once(build: Callable) -> Callable:
    """An expression over column names, built once an application: it is the same
    for every table, and a large one is thousands of calls of the JVM."""
    @lru_cache(maxsize=32)
    def of(application: str, *args):
        return build(*args)

    @wraps(build)
    def call(*args):
        return of(SparkContext._active_spark_context.applicationId, *args)
    return call
