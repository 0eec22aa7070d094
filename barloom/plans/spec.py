"""What is asked (Query), what will be read (Plan), what came back (Result, Metrics)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: str | int | float


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str | None = None

    @property
    def key(self) -> str:
        return "count" if self.function == "count" else f"{self.function}_{self.column}"


@dataclass(frozen=True)
class Query:
    table: str
    filters: list[Filter]
    aggregations: list[Aggregate]
    group_by: list[str] = field(default_factory=list)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class Pushdown:
    """The bounds that the scan tests on one column; a missing bound is None."""

    column: str
    low: int | float | None
    high: int | float | None
    include_low: bool = True
    include_high: bool = True


@dataclass(frozen=True)
class Plan:
    """The chunks that survive pruning, as rows of the chunk statistics, and the columns to read."""

    query: Query
    required_columns: list[str]
    candidates: list[dict[str, Any]]
    manifest_path: str
    total_chunks: int
    total_rows: int

    def as_dict(self) -> dict[str, Any]:
        return self.query.as_dict() | {
            "required_columns": self.required_columns,
            "candidate_chunks": self.candidates,
            "manifest_path": self.manifest_path,
            "total_chunks": self.total_chunks,
            "total_rows": self.total_rows,
            "selected_chunk_count": len(self.candidates),
        }


def share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


@dataclass(frozen=True)
class Metrics:
    total_chunks: int
    scanned_chunks: int
    total_blocks: int
    scanned_blocks: int
    rows_available: int
    rows_scanned: int
    rows_matched: int
    columns_read: list[str]
    native_filter_used: bool
    native_rows_evaluated: int

    def as_dict(self) -> dict[str, Any]:
        skipped, unread = self.total_chunks - self.scanned_chunks, self.total_blocks - self.scanned_blocks
        return asdict(self) | {
            "skipped_chunks": skipped,
            "skipped_blocks": unread,
            "column_count": len(self.columns_read),
            "pruning_rate": share(skipped, self.total_chunks),
            "block_pruning_rate": share(unread, self.total_blocks),
        }


@dataclass(frozen=True)
class Result:
    query: Query
    rows: list[dict[str, Any]]
    metrics: Metrics

    def as_dict(self) -> dict[str, Any]:
        return self.query.as_dict() | {"rows": self.rows, "metrics": self.metrics.as_dict(), "result_row_count": len(self.rows)}
