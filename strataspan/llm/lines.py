"""Substring dedup by hashing lines, the clauses in them and runs of short ones."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.llm.common import small_batches

#: A unit takes in the lines or clauses behind it until it has so many words.
MIN_WORDS = 8
#: A stretch of repeated units goes if it has so many words, or is the whole text.
MIN_RUN = 25
#: Pieces that repeat earlier ones of their own batch are dealt to so many groups instead of their digest's.
SPREAD = 1 << 20
#: Where lines and clauses end.
_CUT = re.compile(r"(?<=[.!?;:,])[^\w\s]*\s+|\s*\n\s*")


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, digest) of each unit, in code points, in text order.

    Pieces are lines, cut further where a clause or sentence ends. A unit begins with a piece and takes in the next ones until it has
    `min_words` words, so short lines are hashed together with those behind them, and a repeated passage gives the same units wherever it
    stands. The last unit reaches back until it has as many. The digest is that of the case-folded words joined by single spaces; a text
    of fewer than `min_words` words has no unit.
    """
    starts, ends, total, words = [], [], [0], []
    at = 0
    for cut in [*_CUT.finditer(text), None]:
        end = cut.start() if cut else len(text)
        own = text[at:end].casefold().split()
        if own:
            starts.append(at)
            ends.append(end)
            words += own
            total.append(len(words))
        at = cut.end() if cut else end
    out, j = [], 0
    if len(words) < min_words:
        return out

    def digest(i: int, j: int) -> int:
        return xxhash.xxh3_64_intdigest(" ".join(words[total[i] : total[j]]).encode("utf-8", "surrogatepass")) - (1 << 63)

    for i in range(len(starts)):
        while j < len(starts) and total[j] - total[i] < min_words:
            j += 1
        if total[j] - total[i] < min_words:
            if out[-1][1] < ends[-1]:
                i = next(k for k in range(i, -1, -1) if total[-1] - total[k] >= min_words)
                out.append((starts[i], ends[-1], digest(i, len(starts))))
            break
        out.append((starts[i], ends[j - 1], digest(i, j)))
    return out


def _explode(min_words: int):
    """doc, text_key, digest, span (start << 32 | end), spread: 0, or where another unit of the batch comes before with the same digest, a
    number of many. Such a unit is a repeat whatever else there is, so a line that a third of all texts hold meets itself once a batch."""

    def run(batches):
        for batch in batches:
            doc, key, digest, span = [], [], [], []
            for d, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for a, b, h in units(text.as_py(), min_words):
                    doc.append(d)
                    key.append(k)
                    digest.append(h)
                    span.append(a << 32 | b)
            ids = np.array([-(1 << 63) if d is None else d for d in doc], np.int64)
            keys, digests, spans = (np.array(x, np.int64) for x in (key, digest, span))
            null = np.array([d is not None for d in doc], bool)
            order = np.lexsort((spans, keys, ids, null, digests))
            same = np.zeros(len(order), bool)
            if len(order):
                group = np.r_[True, digests[order][1:] != digests[order][:-1]]
                first = order[np.flatnonzero(group)[np.cumsum(group) - 1]]  # of each row's digest, the earliest in the batch
                same[order] = (ids[first] != ids[order]) | (null[first] != null[order]) | (keys[first] != keys[order]) | (spans[first] != spans[order])
            spread = np.where(same, (keys ^ spans) % SPREAD + 1, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(keys), pa.array(digests), pa.array(spans), pa.array(spread.astype(np.int32))], ["doc", "text_key", "digest", "span", "spread"]
            )

    return run


def stretches(text: str, spans: list[int], min_run: int) -> list[tuple[int, int]]:
    """The (start, end) of what goes: repeated units that overlap or have only blanks and marks between them, joined."""
    joined: list[list[int]] = []
    for span in sorted(spans):
        a, b = span >> 32, span & 0xFFFFFFFF
        if joined and (a <= joined[-1][1] or not any(map(str.isalnum, text[joined[-1][1] : a]))):
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    whole = len(text.split())
    return [(a, b) for a, b in joined if (n := len(text[a:b].split())) >= min_run or n == whole]


def _cut(at: int, spans: int, min_run: int):
    """Replaces the column of spans by the text that is left and the stretches that went."""

    def run(batches):
        for batch in batches:
            rest, removed = [], []
            for text, found in zip(batch.column(at), batch.column(spans).to_pylist(), strict=True):
                text = text.as_py()
                gone = stretches(text, found, min_run) if found else []
                kept, end = [], 0
                for a, b in gone:
                    kept.append(text[end:a])
                    end = b
                rest.append("".join([*kept, text[end:]]) if gone else text)
                removed.append([{"start": a, "end": b} for a, b in gone])
            columns = [c for i, c in enumerate(batch.columns) if i not in (at, spans)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rest, pa.string()), pa.array(removed, _REMOVED)], ["doc_id", "text", "removed"])

    return run


_REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """Remove what repeats of all texts, except its earliest occurrence: stretches of units whose digest an earlier unit has.

    Units rank by (doc_id, text, offset), nulls first. Each digest's units are ordered in one shuffle of numbers, without texts; units that
    repeat one of their own batch skip their digest's group, so no digest gathers more than a unit a batch. A stretch goes if it has `min_run`
    words or is the whole text, so a single short line that many texts hold stays (with `min_run` 0 it goes, too).

    Input doc_id (integer), text; other columns are ignored. Null or empty texts have no unit and stay as they are; so do texts of fewer than
    `min_words` words. Rows of one doc_id and different texts are documents of their own; rows that are equal in both are one
    document, and are treated alike: none is a repeat of the other. An empty table gives no rows. Returns doc_id, text (what is left),
    removed (array of start, end: code points of the original text, ascending, without overlap), n_removed.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    unit = keyed.where(F.col("text").isNotNull() & (F.length("text") > 0)).mapInArrow(_explode(min_words), "doc long, text_key long, digest long, span long, spread int")
    earlier = Window.partitionBy("digest", "spread").orderBy("doc", "text_key", "span")
    repeats = unit.withColumn("rank", F.rank().over(earlier)).where("rank > 1 or spread > 0")
    gone = repeats.groupBy("doc", "text_key").agg(F.collect_set("span").alias("spans")).toDF("gone_doc", "gone_key", "spans")  # units of one document
    marked = keyed.join(gone, F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("text_key") == F.col("gone_key")), "left").select("doc", "text", "spans")
    out = marked.mapInArrow(_cut(1, 2, min_run), "doc_id long, text string, removed array<struct<start:int,end:int>>")
    return out.withColumn("n_removed", F.size("removed").cast("long"))
