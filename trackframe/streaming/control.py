"""Control messages of a live stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONS = ("ping", "flush", "reset", "close")


def action(message: Column) -> Column:
    """What a JSON message asks for: one of ``ACTIONS``, ``unknown``, or ``error`` if it is no JSON object."""
    parsed = F.from_json(message, "type string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = parsed.isNull() | parsed["_bad"].isNotNull()
    return F.when(bad, "error").when(parsed["type"].isin(*ACTIONS), parsed["type"]).otherwise("unknown")
