"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pitwright.plans import domain, extensions, inventory, io_queries, relational, strategy_queries, studies

QUERIES: dict = {**relational.QUERIES, **domain.QUERIES, **inventory.QUERIES, **io_queries.QUERIES, **strategy_queries.QUERIES, **studies.QUERIES, **extensions.QUERIES}
ORACLES: dict[str, str] = {**relational.ORACLES, **domain.ORACLES, **inventory.ORACLES, **io_queries.ORACLES, **strategy_queries.ORACLES, **studies.ORACLES, **extensions.ORACLES}
FLAGSHIP = "m0_factor_decay"
