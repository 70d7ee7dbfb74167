"""Named schemas of the records that flow between the operators."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<double>": T.ArrayType(T.DoubleType())}


def _schema(text: str) -> T.StructType:
    """'name type, ...' without a running session, since workers import this too."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split(" ") for part in text.split(", "))])


INPUT = _schema("event_ts long, ingest_ts long, id long, vec array<double>")
GROUPED = _schema(
    "group_id int, gtype string, part int, ptype string, home_part int, home_group int, event_ts long, ingest_ts long, id long, vec array<double>, machine int, origin string"
)
RESULT = _schema("out_ts long, in_ts long, left_id long, right_id long, machine int, part int, group_id int, match boolean")
GROUP_SIDE = _schema("ts long, machine int, space_id int, group_id int, gtype string, bytes long")
THROUGHPUT = _schema("ingest_ts long, n long")
ASSIGNMENT = _schema("machine int, group_id int, origin_machine int, space_id int, load long, size long")
