from datetime import datetime

from quarrylens.schema import RECORDS


def rows(spark, kind, *given):
    """Record rows from dicts, with _ord in the order given."""
    names = [x.split(" ", 1)[0] for x in RECORDS[kind].split(", ")]
    return spark.createDataFrame([tuple(g.get(n) for n in names) + (i,) for i, g in enumerate(given)], f"{RECORDS[kind]}, _ord BIGINT")


def at(day, hour=0, minute=0, second=0):
    return datetime(2024, 1, day, hour, minute, second)
