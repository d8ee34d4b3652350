"""Join helpers: a broadcast is only hinted after the side's size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Most rows and bytes of a side that is broadcast. Beyond either the join shuffles (and AQE
# may still pick a broadcast from runtime statistics).
BROADCAST_ROW_LIMIT = 1_000_000
BROADCAST_BYTE_LIMIT = 64 * 1024 * 1024


def static_max_rows(df: DataFrame) -> int | None:
    """Upper bound on the row count that the optimizer proves from the plan alone (a
    limit, a global aggregate, a bounded range), or ``None``. No job is run."""
    try:
        bound = df._jdf.queryExecution().optimizedPlan().maxRows()
        return int(bound.get()) if bound.isDefined() else None
    except Exception:  # no JVM handle (remote session): fall back to counting
        return None


def row_bytes(df: DataFrame):
    """Expression for the size of a row: the length of its text, numbers and arrays included."""
    return F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def bounded_rows(df: DataFrame, limit: int, max_bytes: int | None = None) -> int | None:
    """Row count of ``df`` if it has at most ``limit`` rows and ``max_bytes`` bytes, else
    ``None``. Reading stops after limit + 1 rows."""
    size = F.coalesce(F.sum(row_bytes(df)), F.lit(0)) if max_bytes is not None else F.lit(0)
    n, held = df.limit(limit + 1).agg(F.count(F.lit(1)), size).first()
    return n if n <= limit and (max_bytes is None or held <= max_bytes) else None


def is_bounded(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, max_bytes: int = BROADCAST_BYTE_LIMIT) -> bool:
    """Has ``df`` at most ``limit`` rows and ``max_bytes`` bytes? A side of a thousand rows
    at most by its plan needs no job; else at most limit + 1 rows are read and measured.
    Nothing is remembered: a table that grew under its name is measured anew."""
    static = static_max_rows(df)
    return static is not None and static <= min(limit, 1000) or bounded_rows(df, limit, max_bytes) is not None


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """``F.broadcast(df)`` when ``df`` is within the bounds, else ``df`` unchanged."""
    return F.broadcast(df) if is_bounded(df, limit) else df
