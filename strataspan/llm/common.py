"""What the corpus operators share: table reading, checkpoints and batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from strataspan.plans.lineage import checkpointed

#: Python works on slices of a batch with about so many characters.
SLICE_CHARS = 2_000_000


__all__ = ["BATCH_BYTES", "SLICE_CHARS", "checkpointed", "fresh", "ship", "slices", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(lengths: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into runs (from, to) of about `most` characters; a longer row is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, unless the driver's path says that they have it (PYTHONPATH, or the working folder)."""
    top = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    here = {str(Path(p).resolve()) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    if str(top) in here or getattr(context, "_strataspan_shipped", False) or not (top / "strataspan").is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="strataspan-")) / "strataspan.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((top / "strataspan").rglob("*.py")):
            z.write(f, f.relative_to(top))
    context.addPyFile(str(target))  # served to every executor by the driver
    context._strataspan_shipped = True


#: Bytes of one Arrow batch between the JVM and Python: each task holds a batch on either side, twice.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session at BATCH_BYTES at most (it stays so: plans read the setting when they run), so that tasks hold
    a few MB of text at a time, however long the texts are; and make sure that the executors' Python finds this package."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column has already (Spark's names ignore case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
