"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataspan.llm.common import checkpointed, small_batches

#: The bounded sample that the index is fitted on; every row is indexed.
SAMPLE = 16_384
#: Coarse cells at most (of eight sample points at least), PQ parts, codes of a part.
CELLS, PARTS, CODES = 256, 16, 64
#: Of the sample's own nearest neighbours, the part whose cells a query must visit: the number of probed cells follows from the data. Near-random
#: vectors have theirs in many cells, clustered ones in few.
REACHED = 0.96
#: Deviations of its coding error by which a row's distance may be wrong, and the row be reranked all the same.
DEVIATIONS = 2.0
#: Rows that a task holds at once: neighbouring cells, or parts of a cell with more than a quarter of that. Groups of them at least.
BLOCK, GROUPS = 131_072, 8


@dataclass(frozen=True)
class Codebook:
    cells: np.ndarray  # cells x dim, unit vectors' means
    parts: list[tuple[int, int]]
    codes: list[np.ndarray]  # CODES x width of each part
    probes: int = 0

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        far = (self.cells**2).sum(1) - 2 * x @ self.cells.T
        return far.argsort(1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.cells[cell]
        out = np.empty((len(x), len(self.parts)), np.uint8)
        for j, (a, b) in enumerate(self.parts):
            out[:, j] = ((self.codes[j] ** 2).sum(1) - 2 * rest[:, a:b] @ self.codes[j].T).argmin(1)
        return out

    def bias(self, x: np.ndarray, cell: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a stored row adds to any query's distance, 2 c.r + r.r of its centroid c and its coded residual r, and its coding error."""
        rest = np.concatenate([self.codes[j][code[:, j]] for j in range(len(self.parts))], 1)
        return 2 * (self.cells[cell] * rest).sum(1) + (rest * rest).sum(1), np.sqrt(((x - self.cells[cell] - rest) ** 2).sum(1))

    def table(self, query: np.ndarray) -> np.ndarray:
        """PARTS x CODES products of the query's parts with each code."""
        out = np.zeros((len(self.parts), max(map(len, self.codes))))
        for j, (a, b) in enumerate(self.parts):
            out[j, : len(self.codes[j])] = self.codes[j] @ query[a:b]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        at = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def train(x: np.ndarray, cells: int = CELLS, parts: int = PARTS, seed: int = 11) -> Codebook:
    """x: unit vectors of the sample."""
    rng = np.random.default_rng(seed)
    coarse = _kmeans(x, max(1, min(cells, len(x) // 8)), rng)
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    spans = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    book = Codebook(coarse, spans, [])
    rest = x - coarse[book.nearest(x)[:, 0]]
    return Codebook(coarse, spans, [_kmeans(rest[:, a:b], CODES, rng) for a, b in spans])


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part: vectors that are not null, not empty, finite and not zero.

    A square sum that overflows or vanishes in double precision counts as not finite or zero.
    """
    v = F.col("embedding").cast("array<double>")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(fine)
        .where((norm > 0) & (norm < float("inf")))
    )


def fit(rows: DataFrame, size: int = SAMPLE, k: int = 5, reached: float = REACHED) -> tuple[Codebook | None, int]:
    """(codebook, dimension): fitted on the `size` rows with the least hashes; the commonest dimension in them counts.

    The number of cells that a query probes is the least that holds the part `reached` of the k nearest neighbours, in the sample, of 512 of its rows.
    """
    got = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toPandas()["v"]
    if not len(got):
        return None, 0
    lengths = got.map(len)
    dim = int(lengths.mode().iloc[0])
    x = unit(np.stack(list(got[lengths == dim])))
    book = train(x)
    own = np.random.default_rng(5).permutation(len(x))[:512]
    ranks = book.nearest(x[own], len(book.cells)).argsort(1)  # of each cell, its place in the order of visits
    cell = book.nearest(x)[:, 0]
    near = x[own] @ x.T
    near[np.arange(len(own)), own] = -9
    best = np.argpartition(-near, min(k, len(x) - 1) - 1, 1)[:, : min(k, len(x) - 1)] if len(x) > 1 else np.zeros((len(own), 1), int)
    needed = np.sort(np.take_along_axis(ranks, cell[best], 1).ravel())
    return Codebook(book.cells, book.parts, book.codes, int(needed[min(len(needed) - 1, int(reached * len(needed)))]) + 1), dim


def chain(cells: np.ndarray) -> np.ndarray:
    """The cells in an order in which each is followed by the nearest one that is left."""
    left, out = np.ones(len(cells), bool), [0]
    left[0] = False
    while left.any():
        rest = np.flatnonzero(left)
        out.append(int(rest[((cells[rest] - cells[out[-1]]) ** 2).sum(1).argmin()]))
        left[out[-1]] = False
    return np.array(out)


def deal(book: Codebook, held: np.ndarray, block: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each cell: neighbouring cells share a group of about `block` rows, a large cell has several."""
    room = max(1, min(block, -(-int(held.sum()) // groups)))
    first, parts, group, filled = np.zeros(len(held), np.int32), np.ones(len(held), np.int32), 0, 0
    for c in chain(book.cells):
        n = max(1, -(-int(held[c]) // room))
        if filled and filled + held[c] > room:
            group, filled = group + 1, 0
        first[c], parts[c] = group, n
        group, filled = (group + n, 0) if n > 1 else (group, filled + held[c])
    return first, parts


def visits(book: Codebook, held: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance to each cell's centroid, which cells the query visits): the nearest `probes`, and further ones until they hold over k rows."""
    far = ((book.cells - x) ** 2).sum(1)
    near = far.argsort(kind="stable")
    seen = held[near].cumsum() - held[near]
    visit = np.zeros(len(far), bool)
    visit[near[(np.arange(len(far)) < book.probes) | (seen <= k)]] = True
    return far, visit


class _Block:
    """The stored rows of one group."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int) -> None:
        t = pa.Table.from_batches(parts)
        column = lambda c: t[c].combine_chunks()
        self.row, self.ids, self.cell = (column(c).to_numpy() for c in ("row", "vec_id", "cell"))
        self.bias, self.error = column("bias").to_numpy(), column("error").to_numpy()
        self.codes = np.frombuffer(b"".join(column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1).astype(np.intp)
        self.v = np.asarray(column("v").flatten()).reshape(-1, dim)
        self.norm = np.sqrt((self.v.astype(float) ** 2).sum(1))

    def search(self, b: Codebook, held: np.ndarray, row: int, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k best rows here, by the asymmetric distances and then exactly.

        The table's sum gives the distance to a row's code; with the code's error it is known up to a deviation. Reranked is every row that may be
        among the k nearest within DEVIATIONS of them, so in a dense group all rows that its codes cannot tell apart.
        """
        x = unit(v)
        far, visit = visits(b, held, x, k)
        some = np.flatnonzero(visit[self.cell] & (self.row != row))
        if not len(some):
            return some, np.empty(0)
        coded = far[self.cell[some]] + self.bias[some] - 2 * b.table(x)[np.arange(self.codes.shape[1]), self.codes[some]].sum(1)
        spread = DEVIATIONS * 2 * np.sqrt(np.maximum(coded, 0) / len(x)) * self.error[some]
        middle = coded + self.error[some] ** 2
        if len(some) > k:
            some = some[middle - spread <= np.partition(middle + spread, k - 1)[k - 1]]
        cosine = np.empty(len(some))
        for lo in range(0, len(some), 4096):  # sums along rows: equal vectors give equal cosines
            part = some[lo : lo + 4096]
            cosine[lo : lo + 4096] = (self.v[part] * v).sum(1) / (self.norm[part] * np.sqrt((v * v).sum()))
        best = np.lexsort((self.row[some], self.ids[some], -cosine))[:k]
        return some[best], cosine[best]


_FOUND = "query long, query_id long, row long, vec_id long, score double"


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, sample: int = SAMPLE, block: int = BLOCK, groups: int = GROUPS, reached: float = REACHED) -> DataFrame:
    """The k nearest rows by cosine of each query (rows whose vec_id is divisible by `every`), its own row left out.

    Every row is assigned to a coarse cell and stored with PARTS one-byte codes of its residual. Neighbouring cells, or parts of large ones, form
    groups of about `block` rows. A query goes to the groups that hold cells it visits (see `fit`; never fewer than hold more than k rows, so no query
    lacks results). A task holds one group's rows, and queries stream past them: asymmetric distances of the visited cells' codes leave the rows that may be
    nearest, whose exact cosines in double precision leave the k best of the group; the best of all groups are ranked.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, as query or candidate; nor do those of
    another dimension than the sample's commonest, or rows with a null vec_id. Rows that repeat a vec_id are a candidate each, and a query each, with
    ranks of its own; between them, ties go by row. An empty table gives no rows. Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    book, dim = fit(rows, sample, k, reached)
    schema = "query_id long, rank int, vec_id long, score double"
    if book is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(book)  # at most CELLS + CODES vectors
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    number = "float" if narrow else "double"

    def assign(batches):
        b = shared.value
        for batch in batches:
            x = unit(np.asarray(batch.column("v").flatten(), float).reshape(-1, dim))
            if len(x):
                cell = b.nearest(x)[:, 0]
                code = b.encode(x, cell)
                bias, error = b.bias(x, cell, code)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(bias), pa.array(error)], [*batch.schema.names, "cell", "code", "bias", "error"])

    stored = f"row long, vec_id long, v array<{number}>, cell int, code binary, bias double, error double"
    numbered = rows.where(F.size("v") == dim).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("v").cast(f"array<{number}>").alias("v"))
    coded = checkpointed(numbered.mapInArrow(assign, stored))
    held = np.zeros(len(book.cells), np.int64)
    for r in coded.groupBy("cell").count().collect():  # a row a cell
        held[r["cell"]] = r["count"]
    first, parts = deal(book, held, block, groups)
    plan = spark.sparkContext.broadcast((held, first, parts))

    def route(batches):
        b, (held, first, parts) = shared.value, plan.value
        for batch in batches:
            x = unit(np.asarray(batch.column("v").flatten(), float).reshape(-1, dim))
            at, to = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for i in range(len(x)):
                _, visit = visits(b, held, x[i], k)
                cells = np.flatnonzero(visit & (held > 0))
                goes = np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c], dtype=np.int32) for c in cells]))
                at.append(np.full(len(goes), i))
                to.append(goes)
            at, to = np.concatenate(at), np.concatenate(to)
            for lo in range(0, len(at), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(to[lo : lo + 8192]), *batch.select(["row", "vec_id", "v"]).take(pa.array(at[lo : lo + 8192])).columns], ["group", "row", "vec_id", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, (held, _, _) = shared.value, plan.value
        group, parts, block = None, [], None
        for batch in batches:
            groups, asked = batch.column("group").to_numpy(), ~batch.column("stored").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (asked[1:] != asked[:-1])]) if len(groups) else []
            for lo, hi in zip(starts, [*starts[1:], len(groups)]):
                if groups[lo] != group:
                    group, parts, block = groups[lo], [], None
                if not asked[lo]:
                    parts.append(batch.slice(lo, hi - lo))
                    continue
                if not parts:
                    continue
                block = block or _Block(parts, dim)
                out: list[tuple] = []
                some = batch.slice(lo, hi - lo)
                for row, q, v in zip(some.column("row").to_pylist(), some.column("vec_id").to_pylist(), np.asarray(some.column("v").flatten(), float).reshape(-1, dim)):
                    at, cosine = block.search(b, held, row, v, k)
                    out += zip([row] * len(at), [q] * len(at), block.row[at].tolist(), block.ids[at].tolist(), cosine.tolist())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query", "query_id", "row", "vec_id", "score"])

    cell_first, cell_parts = (F.array(*[F.lit(int(n)) for n in x]) for x in (first, parts))
    dealt = coded.select((cell_first[F.col("cell")] + F.pmod(F.xxhash64("row"), cell_parts[F.col("cell")])).cast("int").alias("group"), F.lit(True).alias("stored"), "row", "vec_id", "v", "cell", "code", "bias", "error")
    asked = coded.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v").mapInArrow(route, f"group int, row long, vec_id long, v array<{number}>")
    both = dealt.unionByName(asked.withColumn("stored", F.lit(False)), allowMissingColumns=True)
    found = both.repartition("group").sortWithinPartitions("group", F.desc("stored")).mapInArrow(search, _FOUND)
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
