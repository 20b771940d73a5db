"""Running finished plans: a ceiling on what is read, no accidental products, a time limit. Nothing here writes."""

from __future__ import annotations

import threading
import uuid
import warnings

from pyspark.sql import DataFrame, Row

from .analyze import PlanError


class TooCostly(PlanError):
    """The plan reads, or multiplies, more than is allowed."""


class TimedOut(PlanError):
    """The plan ran longer than is allowed."""


#: What Spark says of relations whose size it doesn't know (spark.sql.defaultSizeInBytes).
UNKNOWN = (1 << 63) - 1


def plan_bytes(df: DataFrame) -> tuple[int, int]:
    """The optimizer's estimate of all that the plan reads, and how many relations it has no estimate for."""

    def leaves(node) -> list[int]:
        kids = node.children()
        own = [n for i in range(kids.size()) for n in leaves(kids.apply(i))]
        return own or [int(str(node.stats().sizeInBytes()))]

    sizes = leaves(df._jdf.queryExecution().optimizedPlan())
    return sum(n for n in sizes if n < UNKNOWN), sum(n >= UNKNOWN for n in sizes)


def check_cost(df: DataFrame, max_bytes: int) -> None:
    physical = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in physical:
        raise TooCostly("the plan multiplies two tables")
    n, unknown = plan_bytes(df)
    if n > max_bytes:
        raise TooCostly(f"the plan reads about {n} bytes; {max_bytes} are allowed")
    if unknown:
        warnings.warn(f"Spark has no size for {unknown} of the relations read: the ceiling doesn't cover them", stacklevel=2)


def run(df: DataFrame, timeout_s: float = 15.0, max_bytes: int = 1 << 40) -> list[Row]:
    """Collect a capped result under the limits; what runs too long is cancelled on the cluster."""
    check_cost(df, max_bytes)
    sc, tag = df.sparkSession.sparkContext, f"ask-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"stopped after {timeout_s:g} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
