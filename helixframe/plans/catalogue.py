"""All registered queries of the library proper, with their DuckDB SQL."""

from __future__ import annotations

from helixframe.plans import genome, intervals, passages, records, streams, variation

_MODULES = (genome, passages, intervals, records, variation, streams)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
