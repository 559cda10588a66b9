"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspan.llm.common import checkpointed, fresh, slices, small_batches

#: Characters of a q-gram, and edits allowed for each character of an item.
Q, EDITS = 10, 0.08
#: Characters that one vectorised step takes, and pairs of text and item places that are counted at once.
STEP, PAIRS = 1 << 18, 1 << 19
#: Characters of the items that one index holds; a larger benchmark is sought in parts, one pass over the texts each.
PART_CHARS = 8_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_THIRD, _FOURTH = np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
_BITS = 22
SPAN = "array<struct<item_id:long,start:int,end:int,edits:int>>"
_SPAN = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def normal(text: str) -> str:
    """Lower case, every white space a blank; one character for each, so offsets hold."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for blank in "\t\n\r\x0b\x0c" if low.isascii() else _BLANKS:
        low = low.replace(blank, " ")
    return low


_BLANKS = "\t\n\r\x0b\x0c\x85\xa0\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def points(text: str) -> np.ndarray:
    """The code points; lone surrogates as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit key of the Q code points from each place on: a polynomial, by doubling."""
    two = data[:-1].astype(np.uint64) * _ODD + data[1:]
    four = two[:-2] * _MIX + two[2:]
    eight = four[:-4] * _THIRD + four[4:]
    keys = eight[: len(data) - Q + 1] * _FOURTH + two[8:]
    return (keys ^ (keys >> np.uint64(29))) * _ODD


def place(keys: np.ndarray) -> np.ndarray:
    return ((keys * _ODD) >> np.uint64(64 - _BITS)).astype(np.int32)


def budget(n: int, edits: float = EDITS) -> int:
    """Edits allowed for an item of n characters: the lemma must leave at least one shared q-gram."""
    return max(0, min(int(n * edits), (n - Q) // Q))


@dataclass(frozen=True)
class Index:
    """The items' q-grams. It grows with the benchmark alone, and `index` checks its size."""

    ids: np.ndarray
    texts: list[str]
    edits: np.ndarray
    least: np.ndarray  # shared q-grams that a match within the edits has at least
    keys: np.ndarray  # sorted
    item: np.ndarray
    at: np.ndarray
    bitmap: np.ndarray
    lines: dict[str, list[int]]  # items of fewer than Q characters, which are sought as whole lines


def index(items: list[tuple[int, str]], edits: float = EDITS) -> Index:
    """Items of fewer than Q characters have no q-gram; they are found where a whole line equals them. Null, empty and blank items match nothing."""
    kept = [(i, t) for i, t in ((i, normal(t).strip()) for i, t in items if i is not None and t) if t]
    lines: dict[str, list[int]] = {}
    for i, t in kept:
        if len(t) < Q:
            lines.setdefault(t, []).append(i)
    kept = [(i, t) for i, t in kept if len(t) >= Q]
    keys, item, at = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for k, (_, t) in enumerate(kept):
        g = grams(points(t))
        keys.append(g)
        item.append(np.full(len(g), k, np.int32))
        at.append(np.arange(len(g), dtype=np.int32))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[place(key)] = True
    n = np.array([len(t) for _, t in kept], np.int64)
    k = np.array([budget(len(t), edits) for _, t in kept], np.int64)
    return Index(np.array([i for i, _ in kept], np.int64), [t for _, t in kept], k, n + 1 - Q * (k + 1), key[order], np.concatenate(item)[order], np.concatenate(at)[order], bitmap, lines)


def align(patterns: list[str], windows: list[str], width: int) -> list[tuple[int, int]]:
    """(edits, end) of the best match of each whole pattern inside its window, the first end of the least edits.

    A banded dynamic program over all pairs at once: cell d < width of row i is the window place i + d, and a
    match may begin at any of them.
    """
    rows, n = max(map(len, patterns)), len(patterns)
    p = np.full((n, rows), -1, np.int64)
    t = np.full((n, rows + width), -2, np.int64)
    for i, (x, w) in enumerate(zip(patterns, windows, strict=True)):
        p[i, : len(x)] = [*map(ord, x)]
        w = w[: rows + width]
        t[i, : len(w)] = [*map(ord, w)]
    size, room = np.array([*map(len, patterns)]), np.array([*map(len, windows)])
    steps, far = np.arange(width), np.int64(1 << 40)
    row, best = np.zeros((n, width), np.int64), [(0, 0)] * n
    for i in range(rows):
        new = row + (t[:, i : i + width] != p[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        for j in np.flatnonzero(size == i + 1):
            cells = np.where(i + 1 + steps <= room[j], row[j], far)
            best[j] = int(cells.min()), i + 1 + int(cells.argmin())
    return best


def find(text: str | None, ix: Index) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, edits) of the items in one text by start; per item and place one match."""
    return find_all([text], ix)[0]


def bands(at: np.ndarray, keys: np.ndarray, ix: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item, band) of the bands that have as many shared q-grams as a match within the edits leaves, from the places of the texts' q-grams.

    Bands are of two strides, one stride apart, so the k+1 diagonals of a match with k edits lie in one of them. About PAIRS pairs of a text place and an
    item place are counted at a time, in the order of the text; a band's count is carried on until the text is beyond it.
    """
    left, right = np.searchsorted(ix.keys, keys, "left"), np.searchsorted(ix.keys, keys, "right")
    n = right - left
    span = np.int64(1) << 40
    held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    longest = max(map(len, ix.texts))
    ends = np.cumsum(n)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        m = n[lo:hi]
        flat = np.repeat(left[lo:hi] - np.cumsum(m) + m, m) + np.arange(m.sum())
        item = ix.item[flat].astype(np.int64)
        band = (np.repeat(at[lo:hi], m) - ix.at[flat] + _SHIFT) // (ix.edits[item] + 1)
        new, more = np.unique(np.concatenate([item * span + band, item * span + band - 1]), return_counts=True)
        both, back = np.unique(np.concatenate([held, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, more])).astype(np.int64)
        held = both
        if hi < len(at):
            item, band = held // span, held % span
            done = (band + 2) * (ix.edits[item] + 1) - _SHIFT + longest < at[hi]
        else:
            done = np.ones(len(held), bool)
        enough = held[done & (counts >= ix.least[held // span])]
        yield enough // span, enough % span
        held, counts = held[~done], counts[~done]
        lo = hi


_SHIFT = 1 << 24  # keeps diagonals positive: more than any item's characters


def find_all(texts: list[str | None], ix: Index) -> list[list[tuple[int, int, int, int]]]:
    plain = [normal(t) if t else "" for t in texts]
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if ix.lines:
        for found, text, t in zip(out, plain, texts, strict=True):
            found += _whole_lines(text, t or "", ix)
    if not len(ix.keys):
        return out
    gap = "\0" * Q  # no item's q-gram has a NUL, so none straddles two texts
    starts = np.cumsum([0, *[len(t) + Q for t in plain]])
    data = points(gap.join(plain) + gap)
    hits = []
    for lo in range(0, len(data) - Q + 1, STEP):
        keys = grams(data[lo : lo + STEP + Q - 1])
        near = np.flatnonzero(ix.bitmap[place(keys)])
        if len(near):
            sought = keys[near]
            found = np.searchsorted(ix.keys, sought)
            real = ix.keys[np.minimum(found, len(ix.keys) - 1)] == sought
            hits.append((near[real] + lo, sought[real]))
    if not hits:
        return out
    # Every occurrence of a shared q-gram is a pair (text place, item place) on the diagonal place - item place.
    at, keys = (np.concatenate(x) for x in zip(*hits, strict=True))
    tried = []
    for items, numbers in bands(at, keys, ix):
        for k, number in zip(items.tolist(), numbers.tolist(), strict=True):
            size, edits = len(ix.texts[k]), int(ix.edits[k])
            first = number * (edits + 1) - _SHIFT
            doc = int(np.searchsorted(starts, max(first + 2 * edits + 1, 0), "right")) - 1
            doc = max(0, min(doc, len(plain) - 1))
            base = int(starts[doc])
            lo, hi = first - edits - base, min(len(plain[doc]), first + 2 * (edits + 1) + size + edits - base)
            if hi - max(lo, 0) < size - edits:
                continue
            window = "\0" * -lo + plain[doc][max(lo, 0) : hi]  # the band may begin before the text
            exact = window.find(ix.texts[k])
            if exact >= 0:
                out[doc].append((int(ix.ids[k]), lo + exact, lo + exact + size, 0))
            else:
                tried.append((doc, lo, k, window))
        if len(tried) >= 256:
            _verify(tried, ix, out)
            tried = []
    _verify(tried, ix, out)
    return [_distinct(x) for x in out]


def _verify(tried: list[tuple[int, int, int, str]], ix: Index, out: list[list]) -> None:
    for lo in range(0, len(tried), 256):
        some = tried[lo : lo + 256]
        width = 4 * max(int(ix.edits[k]) for _, _, k, _ in some) + 3
        for (doc, at, k, window), (cost, end) in zip(some, align([ix.texts[k] for _, _, k, _ in some], [w for *_, w in some], width), strict=True):
            if cost <= ix.edits[k]:
                pad = "\0" * int(ix.edits[k])
                back = align([ix.texts[k][::-1]], [pad + window[:end][::-1]], width)[0][1] - len(pad)
                out[doc].append((int(ix.ids[k]), max(0, at + end - back), at + end, cost))


def _whole_lines(plain: str, text: str, ix: Index) -> list[tuple[int, int, int, int]]:
    """Lines of the text that equal a short item but for blanks around them."""
    found, at = [], 0
    for line in text.split("\n"):
        own = plain[at : at + len(line)]
        if len(line) < 64 and (short := own.strip()) in ix.lines:
            start = at + len(own) - len(own.lstrip())
            found += [(i, start, start + len(short), 0) for i in ix.lines[short]]
        at += len(line) + 1
    return found


def _distinct(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping matches of one item the one with the fewest edits stays."""
    kept: list[tuple[int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (x[3], x[1], x[2])):
        if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[1], x[0]))


def parts(items: Iterable[tuple[int, str]], most: int) -> Iterator[list[tuple[int, str]]]:
    """Lists of items of about `most` characters each; one empty list if there are none."""
    held, size, some = [], 0, False
    for item in items:
        held.append(item)
        size += len(item[1])
        if size >= most:
            yield held
            held, size, some = [], 0, True
    if held or not some:
        yield held


def _seek(docs: DataFrame, ix: Index, name: str, cutting: bool = False) -> DataFrame:
    """The rows with what the index finds in column `text`, after what column `name` holds already; or if `cutting`, without that column, and with the
    text and n_chars after the cuts, in the same pass, so that a task needs one Python worker."""
    broadcast = docs.sparkSession.sparkContext.broadcast(ix)
    columns = docs.columns
    at, old = columns.index("text"), columns.index(name) if name in columns else None
    size = columns.index("n_chars") if "n_chars" in columns else None
    names = [c for c in columns if c != name]

    def run(batches):
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), STEP * 4):
                part = batch.slice(a, b - a)
                texts, out = part.column(at).to_pylist(), list(part.columns)
                found = find_all(texts, broadcast.value)
                rows = [[dict(zip(("item_id", "start", "end", "edits"), x, strict=True)) for x in f] for f in found]
                if old is not None:
                    rows = [sorted(x + y, key=lambda s: (s["start"], s["item_id"])) for x, y in zip(part.column(old).to_pylist(), rows, strict=True)]
                dirty = [i for i, r in enumerate(rows) if r] if cutting else []
                if dirty:
                    counts = out[size].to_pylist() if size is not None else []
                    for i in dirty:
                        texts[i] = cut(texts[i], [(s["start"], s["end"]) for s in rows[i]])
                        if size is not None:
                            counts[i] = len(texts[i])
                    out[at] = pa.array(texts, pa.string())
                    if size is not None:
                        out[size] = pa.array(counts, out[size].type)
                out = [c for i, c in enumerate(out) if i != old]
                yield pa.RecordBatch.from_arrays(out if cutting else [*out, pa.array(rows, _SPAN)], names if cutting else [*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name)
    return docs.mapInArrow(run, kinds if cutting else f"{kinds}, `{name}` {SPAN}")


def _sought(docs: DataFrame, benchmark: DataFrame, edits: float, name: str, part_chars: int, cutting: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    chosen = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).orderBy("item_id", "text")
    rest = parts(((r["item_id"], r["text"]) for r in chosen.toLocalIterator()), part_chars)
    some, n = next(rest), 0
    while some is not None:
        following = next(rest, None)
        docs = _seek(checkpointed(docs) if n else docs, index(some, edits), name, cutting and following is None)
        some, n = following, n + 1
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, keep: tuple[str, ...] = (), name: str = "regions", part_chars: int = PART_CHARS) -> DataFrame:
    """The regions of every whole text that hold a benchmark item within its edit budget.

    docs: doc_id, text and the columns in `keep`; benchmark: item_id, text, streamed to the driver and sought in parts of about `part_chars` characters, each
    broadcast as an index; between parts the rows are checkpointed. Null or empty texts match nothing; so do null, empty and blank items; items of fewer than
    Q characters match whole lines; repeated items match each. Repeated rows repeat; an empty table gives no rows. Returns `keep`, doc_id, text and, as `name`,
    regions (item_id, start, end in code points, edits; by start).
    """
    return _sought(docs.select(*dict.fromkeys([*keep, "doc_id", "text"])), benchmark, edits, name, part_chars, False)


def excise(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, part_chars: int = PART_CHARS) -> DataFrame:
    """The documents without the regions that `contamination` finds; n_chars follows. Clean rows stay as they are, and all columns, whatever their names."""
    (name,) = fresh(docs.columns, "regions")
    return _sought(docs, benchmark, edits, name, part_chars, True)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which are sorted by start and may overlap."""
    kept, at = [], 0
    for a, b in spans:
        if a > at:
            kept.append(text[at:a])
        at = max(at, b)
    return "".join([*kept, text[at:]])
