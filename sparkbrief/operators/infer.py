"""Call a user's model function once for each distinct prompt of a table."""

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.functions.retry import JITTER, MAX_ATTEMPTS, RETRYABLE, WAIT_MAX, WAIT_MIN
from sparkbrief.staging import staged

ASKED = "_digest string, response string, error string, attempts int"


def _waits(rounds: int, wait_min: float, wait_max: float) -> list[float]:
    """Wait before each further round; the spread differs by round, so a rerun waits the same."""
    return [min(wait_min * 2**r + JITTER * (r * 37 % 100) / 100, wait_max) for r in range(rounds)]


def _answered(fn: Callable[[str], str], prompt: str) -> tuple[str | None, str | None]:
    try:
        return fn(prompt), None
    except Exception as exc:  # whatever a user's function raises ends as a row
        return None, str(exc)


def _asker(fn, attempts: int, wait_min: float, wait_max: float, sleep, concurrency: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                digests = batch.column("_digest").to_pylist()
                waiting = dict(zip(digests, batch.column("prompt").to_pylist(), strict=True))
                told: dict[str, tuple] = {}
                pauses = _waits(attempts - 1, wait_min, wait_max)
                for turn in range(attempts):
                    answers = pool.map(lambda p: _answered(fn, p), waiting.values())
                    again = {}
                    for digest, (response, error) in zip(list(waiting), answers, strict=True):
                        told[digest] = (response, error, turn + 1)
                        if error is not None and any(word in error.lower() for word in RETRYABLE):
                            again[digest] = waiting[digest]
                    waiting = again
                    if not waiting or turn == attempts - 1:
                        break
                    # One wait for all that failed in this round, not one for each.
                    sleep(pauses[turn])
                rows = [told[d] for d in digests]
                columns = [pa.array(digests, pa.string()), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]]
                yield pa.RecordBatch.from_arrays(columns, names=["_digest", "response", "error", "attempts"])

    return run


def batch_infer(
    df: DataFrame,
    prompt: str,
    fn: Callable[[str], str],
    stored: DataFrame | None = None,
    max_attempts: int = MAX_ATTEMPTS,
    wait_min: float = WAIT_MIN,
    wait_max: float = WAIT_MAX,
    sleep: Callable[[float], None] = time.sleep,
    parts: int | None = None,
    concurrency: int = 4,
) -> DataFrame:
    """Add ``response``, ``error`` and ``attempts`` of ``fn`` to each row.

    ``df`` is read twice, for its prompts and for its rows; stage it if it is costly.
    Prompts with a non-null answer in ``stored`` (``prompt, response``) are not asked again. Prompts
    are dealt out over ``parts`` tasks (twice the cores by default), each asking ``concurrency`` at
    a time: ``fn`` must bear to be called from several threads. Errors worth a retry are
    asked again in rounds with a growing wait. The answers are written before they are joined, as a second call may
    answer otherwise.
    """
    # Long prompts are compared and joined by digest.
    keyed = df.withColumn("_digest", F.sha2(F.col(prompt).cast("string"), 256))
    todo = (
        keyed.filter(F.col(prompt).isNotNull())
        .groupBy("_digest")
        .agg(F.any_value(prompt).alias("prompt"))
    )
    known = None
    if stored is not None:
        known = stored.filter(F.col("response").isNotNull() & F.col("prompt").isNotNull())
        known = known.groupBy(F.sha2("prompt", 256).alias("_digest")).agg(F.max("response").alias("response"))
        todo = todo.join(known.select("_digest"), "_digest", "left_anti")
    # A given number of parts is kept as it is; prompts are small, and would otherwise be merged into one task.
    parts = parts or 2 * df.sparkSession.sparkContext.defaultParallelism
    asked = todo.repartition(parts, "_digest").mapInArrow(
        _asker(fn, max_attempts, wait_min, wait_max, sleep, concurrency), ASKED
    )
    answers = staged(asked, "answers")
    if known is not None:
        answers = answers.unionByName(known, allowMissingColumns=True)
    return keyed.join(answers, "_digest", "left").drop("_digest")
