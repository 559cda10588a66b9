"""Near-duplicates by Order MinHash over five-word k-mers, verified by banded alignment of words."""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.llm.common import checkpointed, fresh, slices, small_batches

#: Words of a k-mer; minimum k-mers of a sketch, in text order; sketches; least similarity of a link. With a fifth of all words replaced at random, two texts
#: share about a fifth of their k-mers and each sketch with probability 0.04, so it takes this many to find most links at the very threshold.
K, ELL, SKETCHES, SIMILARITY = 5, 2, 64, 0.8
#: Leaders that each text is aligned with first, those that share most sketches with it; pairs of one leader that a task aligns.
LEADERS, PAIRS = 2, 1024
#: Bins of a text's bag of words; texts of a bucket that a task compares with as many others at once; words of texts that it keeps split.
BINS, BLOCK, SPLIT = 64, 512, 400_000
#: Bins by which a task counts the words, and the pairs of neighbouring words, of texts it may have to align.
FINE = 1 << 16
#: Bytes that one vectorised step takes.
STEP = 1 << 18
_TO_BLANK = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))
#: Scripts that set no spaces: each character is a word.
_ALONE = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _blanked(text: str) -> bytes:
    """Lower case, as UTF-8, with a blank for each character that is no letter, mark or digit, and around each one of a script without spaces."""
    low = text.lower()
    if not low.isascii():
        for c in set(low):
            if c > "\x7f" and not (c.isalnum() or unicodedata.category(c)[0] == "M"):
                low = low.replace(c, " ")
        low = _ALONE.sub(r" \1 ", low)
    return low.encode("utf-8", "replace").translate(_TO_BLANK)


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters and digits of any script, as UTF-8; single characters in scripts without spaces."""
    return _blanked(text).split()


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


_POWER, _BACK = _powers(_BASE, 4 * STEP), _powers(_INVERSE, 4 * STEP)
_SEEDS = np.random.default_rng(20260101).integers(1 << 62, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word, the number of words of each text): prefix sums of a polynomial modulo 2^64."""
    data = [_blanked(t) for t in texts]
    blob = np.frombuffer(b" ".join([*data, b""]), dtype=np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    if not len(blob):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = np.concatenate([[False], blob != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):  # steps of whole words; a word longer than the tables is hashed alone
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + len(_POWER), "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        if b - a > len(_POWER):
            out[lo] = np.uint64(_long(blob[a:b].tobytes()))
        else:
            sums = np.concatenate([[np.uint64(0)], np.cumsum((blob[a:b].astype(np.uint64) + np.uint64(1)) * _POWER[: b - a], dtype=np.uint64)])
            out[lo:hi] = (sums[end[lo:hi] - a] - sums[start[lo:hi] - a]) * _BACK[start[lo:hi] - a]
        lo = hi
    return mix(out), counts


def _long(word: bytes) -> int:
    total = 0
    for b in reversed(word):
        total = (total * _BASE + b + 1) % (1 << 64)
    return total


def kmers(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each occurrence-labelled k-mer, k-mers of each text); a text of fewer than K words is one k-mer."""
    n = np.where(counts >= K, counts - K + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    last = np.repeat(first + counts, n)
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(K, np.uint64)])
    for j in range(K):
        h = h * np.uint64(_BASE) + np.where(at + j < last, padded[at + j], np.uint64(0))
    h = mix(h)
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, text)) if len(n) > 1 else np.argsort(h, kind="stable")
    sorted_h, sorted_t = h[order], text[order]
    same = np.concatenate([[False], (sorted_h[1:] == sorted_h[:-1]) & (sorted_t[1:] == sorted_t[:-1])])
    if same.any():
        run = np.arange(len(same)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        occurrence = np.empty(len(same), np.uint64)
        occurrence[order] = run.astype(np.uint64)
        h = np.where(occurrence > 0, mix(h + occurrence * np.uint64(_BASE)), h)
    return h, n


def sketches(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """texts x SKETCHES: each the ELL = 2 least labelled k-mers of a seeded order, hashed in the order of the text.

    n must be positive throughout.
    """
    start = np.cumsum(n) - n
    out = np.empty((len(n), SKETCHES), np.int64)
    rows = np.arange(len(n))
    for j, seed in enumerate(_SEEDS):
        v = h * seed
        v ^= v >> np.uint64(29)
        least = np.minimum.reduceat(v, start)
        at = np.flatnonzero(v == np.repeat(least, n))
        text = np.searchsorted(start, at, "right") - 1
        first = np.empty(len(n), np.int64)
        first[text[::-1]] = at[::-1]  # the first, if two labelled k-mers should collide
        v[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least = np.minimum.reduceat(v, start)
        at = np.flatnonzero(v == np.repeat(least, n))
        text = np.searchsorted(start, at, "right") - 1
        second = np.empty(len(n), np.int64)
        second[text[::-1]] = at[::-1]
        a, b = h[np.minimum(first, second)], h[np.maximum(first, second)]
        out[rows, j] = mix(a * np.uint64(_BASE) + b + np.uint64(j)).view(np.int64)
    return out


def sketch_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, its sketches); texts without words have none (zeros)."""
    hashes, counts = word_hashes(texts)
    return counts, _sketched(hashes, counts)


def _sketched(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), SKETCHES), np.int64)
    some = counts > 0
    if some.any():
        h, n = kmers(hashes, counts[some])
        out[some] = sketches(h, n)
    return out


def bags(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """texts x BINS: how many words of each text fall into each bin (65535 at most)."""
    text = np.repeat(np.arange(len(counts)), counts)
    bins = np.bincount(text * BINS + (hashes % np.uint64(BINS)).astype(np.int64), minlength=len(counts) * BINS)
    return np.minimum(bins, 65535).astype(np.uint16).reshape(-1, BINS)


def distance(a: list, b: list, most: int) -> int:
    """Levenshtein distance of two word sequences, or most + 1 if it is larger.

    Myers' bit vectors along the diagonal band of 2 * most + 1 cells: bit i of column j is row j - most + i.
    """
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a:
        return len(b)
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    rows = len(a)
    most = min(most, len(b))
    width = 2 * most + 1
    full = (1 << width) - 1
    # score: the distance at the band's lowest row, and once that has passed the last row, at the last row
    up, down, score = (full >> most) << most, 0, min(most, rows)
    for j in range(len(b)):
        shift = j - most
        eq = where.get(b[j], 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        d0 = ((((eq & up) + up) & (full << 1 | 1)) ^ up | eq | down) & full
        hp = (down | ~(d0 | up)) & full
        hn = d0 & up
        low = j + most + 1  # the row at the band's lowest cell
        if low <= rows:
            score += 0 if d0 >> (width - 1) & 1 else 1
        else:
            bit = width - 1 - (low - rows)
            if bit < 0:
                return most + 1
            score += (hp >> bit & 1) - (hn >> bit & 1)
        x = d0 >> 1
        up = (hn | ~(x | hp)) & full
        down = hp & x
    return min(score, most + 1)


def similar(a: list, b: list, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / max(length) is `least` or more."""
    n = max(len(a), len(b))
    most = int(n * (1 - least) + 1e-9)
    return distance(a, b, most) <= most


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of the edges (a, b) is connected with.

    Labels spread to neighbours and jump to their label's label until none changes; every round is a join and an
    aggregation by node, cut by a checkpoint. The driver sees one count a round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        sent = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        near = labels.unionByName(sent).groupBy("node").agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = near.join(up, "near", "left").select("node", F.least(F.col("near"), F.coalesce("far", "near")).alias("label"))
        new = checkpointed(new.join(labels.withColumnRenamed("label", "old"), "node"))
        changed = not new.where("label < old").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _sketch(batches):
    for batch in batches:
        texts = batch.column(1)
        for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 2 * STEP):
            part = batch.slice(a, b - a)
            hashes, counts = word_hashes([t or "" for t in part.column(1).to_pylist()])
            rows = _sketched(hashes, counts)
            bag = pa.array([x.tobytes() for x in bags(hashes, counts)], pa.binary())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, SKETCHES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts.astype(np.int32)), flat, bag], ["doc_id", "digest", "n", "sketch", "bag"])


def _verify(least: float):
    def run(batches):
        last, of_last = None, []
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if a != last:
                    last, of_last = a, words(x.as_py())
                keep.append(similar(of_last, words(y.as_py()), least))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _possible(least: float) -> Callable:
    """Of pairs, those that their bags of words don't exclude (see `candidates`)."""

    def run(batches):
        for batch in batches:
            n = np.maximum(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int32) for c in ("bag_a", "bag_b"))
            apart = a - b
            near = (np.abs(apart).sum(1) + np.abs(apart.sum(1))) // 2 <= (n * (1 - least) + 1e-9).astype(np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


_KEY = ["family", "low", "high"]


def _groups(batches) -> Iterator[pa.Table]:
    """The runs of rows of one key, whatever batches they lie in."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in _KEY], 1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held)


def candidates(group: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group that can link and need a test yet, and the least share of words in which they differ.

    Left out, exactly: pairs of one component, pairs without a common sketch, pairs that another pair of
    blocks has, and pairs whose lengths or bags of words differ by more edits than a link allows. An edit puts one word into a bag, takes one
    out, or both, and words that share a bin only make bags more alike; so the larger of the two surpluses is at most the distance.
    """
    n = group["n"].to_numpy().astype(np.int64)
    order = np.argsort(n, kind="stable")
    n, of = n[order], group["component"].to_numpy()[order]
    bag = np.frombuffer(b"".join(group["bag"].to_pylist()), np.uint16).reshape(-1, BINS)[order].astype(np.int32)
    brief = group["brief"].combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)[order]  # the low bits: equal where sketches are
    block, low, high = group["block"].to_numpy()[order], group["low"][0].as_py(), group["high"][0].as_py()
    most = (n * (1 - least) + 1e-9).astype(np.int64)
    ends = np.searchsorted(n - most, n, "right")  # rows of up to so many words more can link
    left, right, share = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    step = max(1, (1 << 20) // (BINS * len(n)))
    for a in range(0, len(n) - 1, step):
        b, end = min(a + step, len(n)), int(ends[min(a + step, len(n)) - 1])
        some = of[a:b, None] != of[None, a:end]
        some &= (np.arange(a, b)[:, None] < np.arange(a, end)) & (n[a:b, None] >= (n - most)[None, a:end])
        if low != high:
            some &= block[a:b, None] != block[None, a:end]
        x, y = np.nonzero(some)
        x, y = x + a, y + a
        for lo in range(0, len(x), 1 << 14):
            i, j = x[lo : lo + (1 << 14)], y[lo : lo + (1 << 14)]
            apart = bag[i] - bag[j]
            far = (np.abs(apart).sum(1) + np.abs(apart.sum(1))) // 2
            near = np.flatnonzero(far <= most[j])
            near = near[(brief[i[near]] == brief[j[near]]).any(1)]
            left.append(order[i[near]])
            right.append(order[j[near]])
            share.append(far[near] / n[j[near]])
    return np.concatenate(left), np.concatenate(right), np.concatenate(share)


def _involved(least: float) -> Callable:
    """Of each group, the rows that have a candidate in it."""

    def run(batches):
        for group in _groups(batches):
            left, right, _ = candidates(group, least)
            if len(left):
                yield from group.take(pa.array(np.unique(np.r_[left, right]))).to_batches()

    return run


def _counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the words of texts, and of their pairs of neighbouring words: where each text's bins start, the bins that hold some, how many each holds, and how
    many a text has."""
    w, n = word_hashes(texts)
    of = np.repeat(np.arange(len(n)), n)
    beside = of[:-1] == of[1:]
    out = []
    for h, text in ((w, of), (mix(w[:-1] * np.uint64(_BASE) + w[1:])[beside], of[:-1][beside])):
        keys, counts = np.unique(text * FINE + (h % np.uint64(FINE)).astype(np.int64), return_counts=True)
        out.append((np.searchsorted(keys, np.arange(len(n) + 1) * FINE), keys % FINE, counts, np.bincount(text, minlength=len(n))))
    return out


def bounds(texts: pa.ChunkedArray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each pair of texts (of n words each), a number of edits that it takes at least.

    An edit puts one word into a text, takes one out, or both, and so at most two pairs of neighbouring words: the larger surplus of words is at most the
    distance, that of neighbours at most twice the distance. Bins only make texts more alike. Texts are counted in parts of about SPLIT words.
    """
    out = np.zeros(len(left), np.int64)
    used = np.unique(np.r_[left, right])
    part = (np.cumsum(n[used]) - n[used]) // SPLIT
    i, j = np.searchsorted(used, left), np.searchsorted(used, right)
    table = np.zeros(FINE, np.int64)

    def counted(x: int) -> tuple[int, list]:
        rows = np.flatnonzero(part == x)
        return rows[0], _counted(texts.take(pa.array(used[rows])).to_pylist())

    for x in np.unique(part[i]).tolist():
        first, ones = counted(x)
        here = np.flatnonzero(part[i] == x)
        for y in np.unique(part[j[here]]).tolist():
            base, others = (first, ones) if x == y else counted(y)
            pairs = here[part[j[here]] == y]
            pairs = pairs[np.argsort(i[pairs], kind="stable")]
            for some in np.split(pairs, np.flatnonzero(np.diff(i[pairs])) + 1):
                one, other = i[some[0]] - first, j[some] - base
                for q in (0, 1):
                    start, bins, counts, size = ones[q]
                    mine = bins[start[one] : start[one + 1]]
                    table[mine] = counts[start[one] : start[one + 1]]
                    many = size[one]
                    start, bins, counts, size = others[q]
                    length = start[other + 1] - start[other]
                    ends = np.cumsum(length)
                    at = np.repeat(start[other] - ends + length, length) + np.arange(ends[-1])
                    sums = np.r_[0, np.cumsum(np.minimum(table[bins[at]], counts[at]))]
                    surplus = np.maximum(size[other], many) - (sums[ends] - sums[ends - length])
                    out[some] = np.maximum(out[some], -(-surplus // (q + 1)))
                    table[mine] = 0
    return out


def _links(least: float) -> Callable:
    """Of each group, the components that links between its texts connect, each with the least of those; the likeliest pairs are aligned first."""

    def run(batches):
        for group in _groups(batches):
            left, right, _ = candidates(group, least)
            if not len(left):
                continue
            texts, n = group["text"], group["n"].to_numpy().astype(np.int64)
            longer = np.maximum(n[left], n[right])
            far = bounds(texts, n, left, right)
            near = far <= (longer * (1 - least) + 1e-9).astype(np.int64)
            left, right, share = left[near], right[near], far[near] / longer[near]
            of = group["component"].to_pylist()
            parent = {c: c for c in of}

            def find(x, parent=parent):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            split, total = {}, 0
            for p in np.argsort(share, kind="stable").tolist():
                i, j = int(left[p]), int(right[p])
                x, y = find(of[i]), find(of[j])
                if x == y:
                    continue
                if total > SPLIT:
                    split, total = {}, 0
                for k in (i, j):
                    if k not in split:
                        split[k] = words(texts[k].as_py())
                        total += len(split[k])
                if similar(split[i], split[j], least):
                    parent[max(x, y)] = min(x, y)
            found = [(c, find(c)) for c in parent if find(c) != c]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _cut(df: DataFrame) -> DataFrame:
    """df, checkpointed; the shuffle files of what led to it go, as nothing refers to them any more."""
    out = checkpointed(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """digest, class_id, class_digest of every distinct text that is not null: of its class the least doc_id (nulls last), and of that the least digest."""
    small_batches(docs.sparkSession)
    # What the joins below bring together grows with the input, so none is broadcast through the driver.
    texts = _texts(docs).where(F.col("text").isNotNull())
    sketched = texts.select("doc_id", "text", "digest").mapInArrow(_sketch, "doc_id long, digest binary, n int, sketch array<long>, bag binary")
    some = sketched.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bag").alias("bag"))
    nodes = _cut(some.withColumn("rep", F.monotonically_increasing_id()))  # a number for each distinct text
    spread = nodes.where("n > 0").select("rep", F.explode("sketch").alias("s"))
    buckets = spread.groupBy("s").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = _cut(spread.join(buckets.select("s", "leader").hint("merge"), "s").select("s", "rep", "leader"))

    # Pairs with the leaders of the buckets that a text is in: excluded by lengths and bags of words, or aligned.
    facts = nodes.select("rep", "n", "bag")
    shared = members.where(F.col("rep") != F.col("leader")).groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("m"))
    nearest = Window.partitionBy("rep").orderBy(F.desc("m"), "leader")
    tried = shared.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= LEADERS).select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    tried = tried.join(facts.toDF("a", "n_a", "bag_a").hint("merge"), "a").join(facts.toDF("b", "n_b", "bag_b").hint("merge"), "b")
    fits = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - 1e-9
    tried = _cut(tried.where(fits).select("a", "b", "n_a", "n_b", "bag_a", "bag_b").mapInArrow(_possible(least), "a long, b long"))
    # A leader of many pairs stands in several copies, so that no task aligns all of them.
    asked = tried.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("salts"))
    needed = members.select("rep").distinct()
    wanted = nodes.join(needed.hint("merge"), "rep", "left_semi").select("rep", F.col("doc_id").alias("of"), "digest")
    known = texts.join(wanted.hint("merge"), (texts["digest"] == wanted["digest"]) & texts["doc_id"].eqNullSafe(F.col("of"))).select("rep", "text")
    known = _cut(known.dropDuplicates(["rep"]))
    leaders = known.toDF("a", "text_a").join(asked.hint("merge"), "a").select("a", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "text_a")
    salted = tried.join(asked.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    told = salted.join(known.toDF("b", "text_b").hint("merge"), "b").join(leaders.drop("salts").hint("merge"), ["a", "salt"])
    edges = _cut(told.select("a", "b", "text_a", "text_b").mapInArrow(_verify(least), "a long, b long"))
    labels = components(edges)

    # Buckets that hold several components, gathered by the least of them: a family meets as a whole, so a text goes there once, not with each sketch.
    in_one = members.select("s", "rep").join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("s", "rep", F.coalesce("label", "rep").alias("component"))
    mixed = in_one.groupBy("s").agg(F.min("component").alias("family"), F.max("component").alias("other")).where("family < other").select("s", "family")
    family = _cut(in_one.join(mixed.hint("merge"), "s").select("family", "rep", "component").distinct())
    sizes = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = family.join(sizes.hint("merge"), "family").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "component", "block")
    schema = "family long, low int, high int, rep long, component long, block int, n int, brief array<short>, bag binary"
    names = [x.split()[0] for x in schema.split(", ")]
    brief = F.transform("sketch", lambda x: x.bitwiseAND(F.lit(32767)).cast("short"))
    ready = dealt.join(nodes.select("rep", "n", brief.alias("brief"), "bag"), "rep").select(*names).repartition(*_KEY).sortWithinPartitions(*_KEY)
    rest = _cut(ready.mapInArrow(_involved(least), schema))
    with_text = rest.join(known.hint("merge"), "rep").select(*names, "text").repartition(*_KEY).sortWithinPartitions(*_KEY)
    more = _cut(with_text.mapInArrow(_links(least), "a long, b long"))
    labelled = nodes.select("rep", "digest", "doc_id").join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("digest", "doc_id", F.coalesce("label", "rep").alias("label"))
    if not more.isEmpty():  # links between components: these, not their texts, are connected further
        joined = components(more).toDF("label", "least")
        labelled = labelled.join(joined.hint("merge"), "label", "left").select("digest", "doc_id", F.coalesce("least", "label").alias("label"))
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    return labelled.join(first.hint("merge"), "label").select("digest", F.col("first.doc_id").alias("class_id"), F.col("first.digest").alias("class_digest"))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Classes of near-duplicates: documents linked, through others perhaps, by alignments of `least` or more.

    1. Every text gets its digest and SKETCHES order min-hashes; equal texts are one node,
       so a text with thousands of copies is sketched into buckets once.
    2. Texts that share a sketch share a bucket. Each text is aligned with the least members of its buckets, of those with the LEADERS that share
       most sketches with it, and the links' connected components follow. Texts whose lengths or bags of words alone forbid a link are not aligned.
    3. Buckets whose members are of different components yet, linked ones included, are gathered into families by their least component. Every pair in one of
       different components and with a common sketch is excluded by lengths, bags of words or counts of words and of neighbouring words, or aligned, unless links
       found meanwhile connect it. Families
       are compared by blocks of about BLOCK members, each pair of blocks by a task; texts go only to where they have a pair that is left to align.
    4. The connected components of all links are the classes: any two texts that share a sketch and are `least` alike are in one.

    Input doc_id (integer), text; other columns are ignored. Rows of one doc_id and different texts are documents of their own. Null texts and texts
    without words link with nothing, except that equal texts without words form one class; a null text is alone. Where a row's
    doc_id is null it takes the class of its equal or similar texts (null if none of them has an id). Empty tables give no rows.

    Returns doc_id, class_id (the least doc_id of the class), kept (whether the row is the one of the class that stays; rows that are equal in both columns alike).
    """
    named = _classes(docs, least)
    rows = _texts(docs).select("doc_id", "digest")
    done = rows.where(F.col("digest").isNotNull()).join(named, "digest").select("doc_id", "class_id", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest"))).alias("kept"))
    return done.unionByName(rows.where(F.col("digest").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class: the one with the least doc_id, and of equal rows any one. Rows with null texts all stay. All columns stay, whatever their names."""
    key, order = fresh([*docs.columns, "class_id", "class_digest"], "key", "order")

    def keyed(digest, doc_id):
        return F.concat(digest, F.coalesce(F.concat(F.lit(":"), doc_id.cast("string")), F.lit("")).cast("binary"))  # never null, so one shuffle does for both steps

    kept = _cut(_classes(docs, least).where(F.col("digest") == F.col("class_digest")).select(keyed(F.col("class_digest"), F.col("class_id")).alias(key)))
    rows = docs.withColumn(key, keyed(F.unhex(F.md5(F.col("text").cast("binary"))), F.col("doc_id").cast("long")))
    found = rows.where(F.col("text").isNotNull()).join(kept, key)
    one = found.withColumn(order, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).where(F.col(order) == 1)
    return one.select(*docs.columns).unionByName(docs.where(F.col("text").isNull()))
