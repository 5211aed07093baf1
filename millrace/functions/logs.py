"""Log lines: user (missing in the older form), host, application, container, time, level, place, message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two forms of a line, and the cluster part of a host.
_TAIL = r"(xenon-[a-z0-9\-]+) (application_[a-z0-9_]+) (container_[a-z0-9_]+) (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) ([A-Z ]+) (\S+:\S+?) (.*)$"
NEW, OLD = r"(?s)^([\w\.]*) " + _TAIL, "(?s)^" + _TAIL
CLUSTER = "(xenon(-pii)?-[a-z]+-[0-9]+)-.*"
FIELDS = ("host", "application_id", "container_id", "time", "level", "place", "message")


def cluster_of(host: Column, pattern: str = CLUSTER) -> Column:
    """Null where the host does not match."""
    return F.when(host.rlike(f"^{pattern}$"), F.regexp_extract(host, f"^{pattern}$", 1))


def parse(df: DataFrame, line: str) -> DataFrame:
    """Adds user, FIELDS, timestamp (epoch milliseconds) and cluster; all null for a line of neither form."""
    text = F.col(line)
    new, old = text.rlike(NEW), text.rlike(OLD)
    user = F.regexp_extract(text, NEW, 1)
    out = df.withColumn("user", F.when(new, F.when(user == "", "unknown_user").otherwise(user)).when(old, F.lit("unknown_user")))
    for i, field in enumerate(FIELDS):
        value = F.when(new, F.regexp_extract(text, NEW, i + 2)).when(old, F.regexp_extract(text, OLD, i + 1))
        out = out.withColumn(field, F.trim(value) if field in ("level", "place", "message") else value)
    return out.withColumn("timestamp", F.unix_millis(F.to_timestamp("time", "yyyy-MM-dd HH:mm:ss"))).withColumn("cluster", cluster_of(F.col("host")))
