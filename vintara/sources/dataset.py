"""Datasets in two states: labelled by period only, or qualified with availability."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.errors import UnqualifiedDataError
from vintara.functions.calendar import require_instant
from vintara.operators.pit import require_information_set, vintage_as_of
from vintara.sources.tables import Availability, Provenance

#: Rows that ``to_pandas`` collects at most; larger datasets stay on the cluster.
PANDAS_ROWS = 5_000_000


@dataclass(frozen=True)
class Dataset:
    """Observations, or period-labelled rows and the way to qualify them."""

    rows: DataFrame
    provenance: Provenance
    requalify: Callable[[Availability, str], DataFrame] | None = None

    @property
    def qualified(self) -> bool:
        return "available_time" in self.rows.columns

    def qualify(self, availability: Availability, tz: str) -> Dataset:
        """The same bytes decoded again under a policy. One way only."""
        if self.qualified or self.requalify is None:
            raise UnqualifiedDataError("only an unqualified dataset with its bytes can be qualified")
        return Dataset(self.requalify(availability, tz), self.provenance)

    def to_information_set(self, as_of: datetime) -> DataFrame:
        """What is visible at an instant."""
        if not self.qualified:
            raise UnqualifiedDataError("without availability nothing is known to be visible")
        at = self.rows.sparkSession.range(1).select(F.lit(require_instant(as_of, "as_of")).alias("decision_time"))
        return require_information_set(vintage_as_of(self.rows, at))

    def to_pandas(self):
        """All rows in order, for datasets of at most :data:`PANDAS_ROWS` rows."""
        if self.rows.limit(PANDAS_ROWS + 1).count() > PANDAS_ROWS:
            raise ValueError(f"more than {PANDAS_ROWS} rows; use the DataFrame")
        keys = [c for c in ("series_id", "observation_time", "available_time", "period_key") if c in self.rows.columns]
        return self.rows.orderBy(*keys).toPandas()

    def same_as(self, other: Dataset) -> bool:
        """Whether both have the same source and the same rows."""
        if (self.provenance.sha256, self.qualified) != (other.provenance.sha256, other.qualified):
            return False
        a, b = self.rows, other.rows.select(*self.rows.columns)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
