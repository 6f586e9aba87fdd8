"""Jobs: latest status, lookups and checks of their life cycle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.operators.ordered import HOT_ROWS, scan

# Status before, status after.
LEGAL = (("queued", "running"), ("running", "done"), ("running", "error"))
FIRST = "queued"


def latest_status(changes: DataFrame) -> DataFrame:
    """The newest change of each job by (ts, seq)."""
    rest = [c for c in changes.columns if c != "job_id"]
    newest = changes.groupBy("job_id").agg(
        F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("s")
    )
    return newest.select("job_id", "s.*")


def look_up(ids: DataFrame, latest: DataFrame) -> DataFrame:
    """Status of the asked ``job_id``s, with ``found`` false for those never submitted."""
    known = latest.withColumn("found", F.lit(True))
    return ids.join(known, "job_id", "left").fillna(False, ["found"])


def transitions(changes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each change with the status before it, and whether that step is legal."""
    before = scan(
        changes, ["job_id"], ["ts", "seq"], last={"previous": F.col("status")},
        inclusive=False, hot_rows=hot_rows,
    )
    legal = F.col("previous").isNull() & (F.col("status") == FIRST)
    for a, b in LEGAL:
        legal = legal | ((F.col("previous") == a) & (F.col("status") == b))
    return before.withColumn("legal", F.coalesce(legal, F.lit(False)))
