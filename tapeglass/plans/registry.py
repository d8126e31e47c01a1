"""All registered queries and their SQL by name."""

from __future__ import annotations

from tapeglass.plans import flagging, newsroom, queries, reading, sql, upkeep, wire

QUERIES = {**queries.QUERIES, **flagging.QUERIES, **reading.QUERIES, **newsroom.QUERIES, **wire.QUERIES, **upkeep.QUERIES}
SQL: dict[str, str] = {**sql.SQL, **flagging.FLAGGING_SQL, **reading.READING_SQL, **newsroom.NEWSROOM_SQL, **wire.WIRE_QUERIES_SQL, **upkeep.UPKEEP_SQL}
