"""What a command returns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records
from ..session import open_folder, remove_folder, settled_table, settling_in
from ..sinks import files, names


@dataclass(frozen=True)
class RunResult:
    """Rows of one run, under an id, with the path they are meant for. What a run lists is settled
    when it is made; its rows are read when an action asks for them, and nothing is
    written to the path before `write`.

    `rows` carry `stage` and `reason`: null for a usable row, and `raw`, the answer of one that is not. A row
    is either among the records or in quarantine, never both.

    What a run has settled lies in a folder of its own. `close` removes it, after the last read; so does the end of a
    `with` block over the run, whether it fails or not. What was written by `write` stays.
    """

    rows: DataFrame
    path: str
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    folder: str | None = None

    def settled(self) -> RunResult:
        """The same run with its rows written to its folder, for callers that use them more than once."""
        spark = self.rows.sparkSession
        folder = self.folder or open_folder(spark)
        with settling_in(spark, folder):
            rows = settled_table(self.rows, "run_rows")
        return replace(self, rows=rows, folder=folder)

    def close(self) -> None:
        """Remove what the run has settled; its rows can't be read any more."""
        if self.folder is not None:
            remove_folder(self.rows.sparkSession, self.folder)

    def __enter__(self) -> RunResult:
        return self

    def __exit__(self, *problem) -> None:
        self.close()

    def usable(self) -> DataFrame:
        return self.rows.filter(F.col("reason").isNull())

    def records(self, layout: str = "raw_v2") -> DataFrame:
        """Records in arrival order."""
        place = [name for name in ("scan_rank", "page", "position") if name in self.rows.columns]
        return records.raw_record(self.usable().orderBy(*place), layout)

    def digest(self, with_score: bool = False) -> DataFrame:
        """Digest rows in arrival order."""
        ordered = self.usable().orderBy("scan_rank", "page", "position")
        return records.digest(ordered, with_score)

    def quarantine(self) -> DataFrame:
        return records.split_quarantine(self.rows, "raw")[1]

    def write(self, folder: str, as_digest: bool = False) -> str:
        """Append the run's records to its file below `folder`, or write its digest there, and its
        rejected rows to the quarantine beside it; returns where the file is.

        Both come from the same settled rows, so they are of one computation.
        """
        kept, target = self.settled(), names.below(folder, self.path.rsplit("/", 1)[-1])
        if as_digest:
            files.write_digest(kept.digest(), target)
        else:
            files.append_raw(kept.records(), target)
        files.append_quarantine(kept.quarantine(), names.below(folder, "quarantine"))
        return target

    def tagged(self) -> DataFrame:
        return self.rows.withColumn("run_id", F.lit(self.run_id))


def in_own_folder(command: Callable[..., RunResult]) -> Callable[..., RunResult]:
    """A command whose run settles all it does in a folder of its own, which is removed if the command fails."""

    @wraps(command)
    def run(pages: DataFrame, *given, **named) -> RunResult:
        spark = pages.sparkSession
        folder = open_folder(spark)
        with settling_in(spark, folder):
            return replace(command(pages, *given, **named), folder=folder)

    return run
