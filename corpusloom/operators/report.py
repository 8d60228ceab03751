"""What an index run saw, gathered while it writes: no second read of files, chunks or vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.sources.corpus import REASONS, skip_reason


@dataclass(frozen=True)
class RunTotals:
    """Counts of one run; ``tokens`` is None where the model reports none."""

    chunks: int
    truncated_chunks: int
    tokens: int | None
    embedding_batches: int
    files: int | None  # None: the corpus was given decoded, so files were not seen
    skipped: dict[str, int]  # files left out, by kind of reason


def _kind(reason: Column) -> Column:
    """The reason without what the file system added behind the colon."""
    return F.split_part(reason, F.lit(": "), F.lit(1))


class RunReport:
    """Pass a new one to ``index_files`` or ``index_roots``; ``totals`` answers when the run is done.

    Rows are counted on their way into the step's files, that is in the task that writes them, and
    of a task that was repeated or run twice only the one attempt that Spark accepts counts.  Files
    are counted as they are read.  That is the same task, but where roots share a path prefix and
    chunks are therefore dealt by id first: a lost executor's files may then be counted again.
    """

    def __init__(self) -> None:
        self._files: Observation | None = None
        self._rows = Observation()
        self._batch_size = 1

    def of_files(self, scanned: DataFrame) -> DataFrame:
        """``scanned`` (``file_path, content, reason``), watched."""
        self._files = Observation()
        kind = _kind(skip_reason())
        counts = [F.count_if(kind == reason).alias(f"reason{i}") for i, reason in enumerate(REASONS)]
        other = F.count_if(kind.isNotNull() & ~kind.isin(*REASONS)).alias("other")
        return scanned.observe(self._files, F.count("*").alias("files"), *counts, other)

    def of_rows(self, embedded: DataFrame, batch_size: int) -> DataFrame:
        """``embedded`` chunks (with ``was_truncated`` and ``usage_tokens``), watched."""
        self._batch_size = batch_size
        return embedded.observe(
            self._rows,
            F.count("*").alias("chunks"),
            F.count_if("was_truncated").alias("truncated"),
            F.sum("usage_tokens").alias("tokens"),
        )

    @property
    def totals(self) -> RunTotals:
        """Waits for the run's write, so ask after the run, not before."""
        rows = self._rows.get
        seen = {} if self._files is None else self._files.get
        skipped = {reason: seen.get(f"reason{i}", 0) for i, reason in enumerate(REASONS)}
        skipped["other"] = seen.get("other", 0)
        return RunTotals(
            chunks=rows["chunks"],
            truncated_chunks=rows["truncated"],
            tokens=rows["tokens"],
            embedding_batches=-(-rows["chunks"] // self._batch_size),
            files=seen.get("files"),
            skipped={reason: n for reason, n in skipped.items() if n},
        )

