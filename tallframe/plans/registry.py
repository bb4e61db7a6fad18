"""All queries and SQL by name."""

from __future__ import annotations

from tallframe.plans import features, grid, relational, signals, spectra, statistics
from tallframe.plans.common import Query

QUERIES: dict[str, Query] = grid.QUERIES | relational.QUERIES | statistics.QUERIES | spectra.QUERIES | signals.QUERIES | features.QUERIES
ORACLES: dict[str, str] = grid.ORACLES | relational.ORACLES | statistics.ORACLES | spectra.ORACLES | signals.ORACLES | features.ORACLES
