"""Server builds against a version list: the greatest listed build at or below the server's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.functions.semantics import datediff, ts_lit
from opslake.operators.timeseries import asof_join


def build_lookup(servers: DataFrame, versions: DataFrame, as_of: str, major: str = "major_version", minor: str = "minor_version") -> DataFrame:
    """Add listed_minor, branch, release_date, days_since_release and exact_build to every server.

    The two-part key is looked up as an as-of join on (major, minor): of the
    listed builds of the server's major version the greatest one not above its
    minor version; of several releases of one build the latest.  A server
    below the first listed build, or of a major version that is not listed,
    has nulls.  No pair of a server and another build is formed, so neither the
    list nor the few major versions limit the size of the other side.
    """
    listed = versions.groupBy(major, minor).agg(F.max_by(F.struct("branch", "release_date"), F.struct("release_date", "branch")).alias("r")).select(
        major, F.col(minor).alias("listed_minor"), "r.*")
    got = asof_join(servers, listed, [major], minor, "listed_minor", ["listed_minor", "branch", "release_date"])
    return got.select("*", datediff("day", F.col("release_date"), ts_lit(as_of)).alias("days_since_release"),
                      (F.col("listed_minor") == F.col(minor)).alias("exact_build"))
