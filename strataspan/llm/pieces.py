"""SentencePiece encoding and decoding, with giant documents scanned in parallel by max-plus transfer matrices."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspan.llm.common import checkpointed, slices, small_batches

#: The public vocabulary file this was built with; any BPE model whose pieces hold the space mark only in front will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; longer documents are cut, wherever the cut falls. Matrices that are combined at a time.
CHUNK, FAN = 8192, 8
SPACE = "▁"
#: The state before a document's first piece and after its last.
EDGE = -1


class Pieces:
    """A model, and the lattice of its pieces.

    A BPE encoding is the one path of pieces over the text in which every two neighbours stay apart when they are encoded
    alone together. So the score of a path is the sum of its pairs' scores, 0 where the pair stays apart and minus infinity
    where it would merge otherwise, and exactly one path has a finite score: a max-plus problem whose state at a cut is
    the piece that covers the character before it.
    """

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.id, self.score, self.raw = {}, {}, []
        self.byte = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                self.id[piece], self.score[piece] = i, sp.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.id), default=1)
        # where this holds, no piece goes over a place between another character and a space mark
        self.resets = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.apart = lru_cache(1 << 15)(self._apart)
        self.canonical = lru_cache(1 << 15)(lambda p: self.merge(p) == [p])

    def merge(self, text: str) -> list[str]:
        """Plain BPE: join the best-scored neighbours, the leftmost of equals, until none can be joined."""
        parts = list(text)
        while True:
            best = max(((self.score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _apart(self, left: str, right: str) -> bool:
        return self.merge(left + right) == [left, right]

    def known(self, piece: str) -> bool:
        return len(piece) == 1 or piece in self.id and self.canonical(piece)

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.id:
                out.append(self.id[p])
            else:
                out += [self.byte[b] for b in p.encode("utf-8", "replace")] if self.byte else [self.lib.unk_id()]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    # The lattice over `text`, whose left and right ends may be context only.

    def states(self, text: str, cut: int, lo: int = 0) -> list[tuple[int, int]]:
        """Pieces (i, j) over the text with i < cut <= j."""
        return [(i, j) for i in range(max(lo, cut - self.longest), cut) for j in range(cut, min(len(text), i + self.longest) + 1) if self.known(text[i:j])]

    def follow(self, text: str, state: tuple[int, int] | None, at: int, stop: int) -> dict[int, int]:
        """From a piece that ends at `at` (None: nothing before): for every place reached by a finite path whose pieces begin before
        `stop`, where its last piece begins. No place has two such paths."""
        last = {at: state[0] if state else at}
        for p in range(at, stop):
            if p not in last:
                continue
            before = text[last[p] : p]
            for q in range(p + 1, min(len(text), p + self.longest) + 1):
                piece = text[p:q]
                if self.known(piece) and (not before or self.apart(before, piece)):
                    last[q] = p
        return last

    def reset_after(self, text: str, at: int, end: int) -> int | None:
        if self.resets:
            for p in range(max(at, 1), end):
                if text[p] == SPACE and text[p - 1] != SPACE:
                    return p
        return None

    def reset_before(self, text: str, at: int, begin: int) -> int | None:
        if self.resets:
            for p in range(min(at, len(text) - 1), max(begin, 1) - 1, -1):
                if text[p] == SPACE and text[p - 1] != SPACE:
                    return p
        return None


def code(cut: int, state: tuple[int, int]) -> int:
    """A state as a number that both neighbours of the cut agree on."""
    return (cut - state[0]) * 1024 + state[1] - cut


def place(cut: int, number: int) -> tuple[int, int]:
    return cut - number // 1024, cut + number % 1024


def transfer(m: Pieces, text: str, left: int, right: int, first: bool, last: bool) -> list[tuple[int, int]]:
    """The finite cells (entry, exit) of a chunk's matrix; the chunk is text[left:right], the rest context."""
    f = m.reset_after(text, left, right)
    b = m.reset_before(text, right - 1, left) if f is not None else None
    entries = [(EDGE, None, left)] if first else [(code(left, s), s, s[1]) for s in m.states(text, left)]
    exits = [] if last else [(code(right, s), s) for s in m.states(text, right)]
    if f is None:
        cells = []
        for number, state, at in entries:
            path = m.follow(text, state, at, right)
            cells += [(number, EDGE)] if last and right in path else []
            cells += [(number, x) for x, (i, j) in exits if path.get(j, -1) == i and i >= at] + [(number, code(right, state)) for _ in [0] if state and state[1] >= right and not last]
        return sorted(set(cells))
    # Every path passes the resets f and b, so the matrix is the outer sum of a column (entry to f) and a row (b to exit).
    into = [number for number, state, at in entries if at <= f and f in m.follow(text, state, at, f)]
    path = m.follow(text, None, b, right)
    out = [EDGE] if last else [x for x, (i, j) in exits if path.get(j, -1) == i and i >= b]
    return [(x, y) for x in into for y in out]


def combine(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Max-plus product of two matrices given by their finite (zero) cells."""
    rows: dict[int, list[int]] = {}
    for x, y in b:
        rows.setdefault(x, []).append(y)
    return sorted({(x, z) for x, y in a for z in rows.get(y, ())})


def product(matrices: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """The product of matrices in order, by neighbouring pairs."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def solve(matrices: list[list[tuple[int, int]]], entry: int = EDGE, exit_: int = EDGE) -> list[tuple[int, int]]:
    """(entry, exit) of each chunk on the one finite path between two states.

    There is just one, as a text has one BPE encoding, and a sequence of pieces is that encoding if and only if each two neighbours stay apart; a model
    of another kind is refused here.
    """
    ahead = [{exit_}]
    for m in reversed(matrices):  # what can reach the end
        ahead.append({x for x, y in m if y in ahead[-1]})
    ahead = ahead[::-1]
    now, out = entry, []
    for m, good in zip(matrices, ahead[1:], strict=True):
        ways = {y for x, y in m if x == now and y in good}
        if len(ways) != 1:
            raise ValueError(f"{len(ways)} paths where a BPE model has one")
        out.append((now, ways.pop()))
        now = out[-1][1]
    return out


def pieces_of(m: Pieces, text: str, begin: int, state: tuple[int, int] | None, end: int, final: tuple[int, int] | None) -> list[int]:
    """Ids of the path from `state` (or nothing) that begins at `begin` and ends with `final`, or at `end`."""
    path = m.follow(text, state, begin, end)
    at, out = final[1] if final else end, []
    if final and path.get(at) != final[0]:
        raise ValueError("no path")
    while at > begin:
        out.append(text[path[at] : at])
        at = path[at]
    return m.ids(out[::-1])


def backtrace(m: Pieces, text: str, left: int, right: int, entry: int, exit_: int) -> tuple[list[int], int, int]:
    """(ids, begin, end) of one chunk, given its states: the pieces after the entry's, up to and with the exit's.

    Between resets the path is the library's encoding of that stretch alone.
    """
    state = None if entry == EDGE else place(left, entry)
    final = None if exit_ == EDGE else place(right, exit_)
    begin, end = state[1] if state else left, final[1] if final else right
    if begin >= end:
        return [], begin, begin
    f = m.reset_after(text, begin, right)
    b = m.reset_before(text, min(right - 1, final[0] if final else right), begin) if f is not None else None
    if f is None or b is None or b < f:
        return pieces_of(m, text, begin, state, right, final), begin, end
    head = pieces_of(m, text, begin, state, f, None) if f > begin else []
    middle = m.lib.encode(text[f + 1 : b].replace(SPACE, " ")) if b > f else []
    return head + middle + pieces_of(m, text, b, None, right, final), begin, end


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def chunks(text: str, size: int, context: int) -> list[tuple[str, int, int, bool, bool]]:
    """(chunk with context, left, right, whether it is the first and the last)."""
    n = len(text)
    cuts = [*range(0, n, size), n]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < 2 * context:
        del cuts[-2]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = max(0, a - context), min(n, b + context)
        out.append((text[lo:hi], a - lo, b - lo, a == 0, b == n))
    return out


def packed(part: str) -> tuple[bytes, int]:
    """A chunk's text as it lies on disk, and its length in bytes before."""
    raw = part.encode()
    return pa.compress(raw, "zstd", asbytes=True), len(raw)


def unpacked(part: bytes, size: int) -> str:
    return pa.decompress(part, size, "zstd", asbytes=True).decode().replace(" ", SPACE)


def encode_chunked(text: str, m: Pieces, size: int = CHUNK) -> list[int]:
    """What `encode` does for one giant document, on one machine."""
    text = normal(text)
    cut = chunks(text, size, m.longest)
    states = solve([transfer(m, *c) for c in cut])
    return [i for c, (x, y) in zip(cut, states, strict=True) for i in backtrace(m, c[0], c[1], c[2], x, y)[0]]


ROW = "doc_id long, row long, chunk int, ids array<int>, whole boolean"


def _row(doc, row, chunk, ids, whole):
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(chunk, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(whole, pa.bool_())], ["doc_id", "row", "chunk", "ids", "whole"]
    )


_MATRIX = "row long, chunk long, entry array<int>, exit array<int>"
_STATE = "row long, chunk long, x int, y int"


def _cells(entry, exit_) -> list[list[tuple[int, int]]]:
    return [list(zip(x.tolist(), y.tolist(), strict=True)) for x, y in zip(entry, exit_, strict=True)]


def _up(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    cells = product(_cells(pdf["entry"], pdf["exit"]))
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "chunk": [pdf["parent"].iloc[0]], "entry": [[x for x, _ in cells]], "exit": [[y for _, y in cells]]})


def _down(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    states = solve(_cells(pdf["entry"], pdf["exit"]), int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0]))
    return pd.DataFrame({"row": pdf["row"], "chunk": pdf["chunk"], "x": [x for x, _ in states], "y": [y for _, y in states]})


def scan(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """row, chunk, x, y: the states at both cuts of every chunk, from the chunks' matrices (row, chunk, entry, exit).

    A tree: `fan` neighbours are combined at a time, level by level, until a document has one matrix; its states are the edges, and each level below takes
    the states between its neighbours from those above. No task sees more than `fan` matrices of a document, and levels are the logarithm of its chunks.
    """
    levels = [checkpointed(matrices)]
    parent = F.expr(f"chunk div {fan}")
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) >= fan:
        levels.append(checkpointed(levels[-1].withColumn("parent", parent).groupBy("row", "parent").applyInPandas(_up, _MATRIX)))
    known = levels[-1].select("row").distinct().select("row", F.lit(0).cast("long").alias("parent"), F.lit(EDGE).alias("x"), F.lit(EDGE).alias("y"))
    for level in reversed(levels):
        below = level.withColumn("parent", parent).join(known, ["row", "parent"])
        states = checkpointed(below.groupBy("row", "parent").applyInPandas(_down, _STATE))
        known = states.withColumnRenamed("chunk", "parent")
    return states


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Of queries made inside, the shuffle files go as soon as a query ends, not when the driver happens to collect garbage; for queries whose results are checkpointed."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def encode(docs: DataFrame, path: str = MODEL, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The piece ids of every whole text, in chunks of about `size` characters.

    A document of up to `size` characters is one chunk and one call of the library. A longer one is cut anywhere; each chunk
    yields, alone, the transfer matrix between the states at its two cuts (a few pieces each); `scan` combines the matrices
    associatively, which leaves one state at each cut; and each chunk is then backtraced alone from its two states. Only matrices and states
    meet by document, never its text. Chunks lie on disk compressed, at most twice at a time. Every chunk is decoded again and compared with its stretch of text. The model file goes to the executors with the job.

    Input doc_id (integer), text; other columns are ignored. Null or empty texts give one chunk without ids. Repeated rows are encoded
    each (`row` tells them apart); an empty table gives no rows. Returns doc_id, row, chunk (from 0), ids, whole (decoding gives the chunk's text).
    """
    small_batches(docs.sparkSession)
    path = shipped(docs.sparkSession, path)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "row", "text")
    giant = F.coalesce(F.length("text") > size, F.lit(False))

    def whole(batches):
        m = model(path)
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist(), 1 << 20):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(2).to_pylist()]
                ids = m.lib.encode(texts, num_threads=1)
                same = [m.decode(i)[1:] == t.replace(SPACE, " ").encode("utf-8", "replace") for i, t in zip(ids, texts, strict=True)]
                yield _row(part.column(0), part.column(1), np.zeros(len(ids), np.int32), ids, same)

    def cut(batches):
        m = model(path)
        for batch in batches:
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                # space marks take three bytes, so they come back only where a chunk is read
                for k, (piece, left, right, first, last) in enumerate(chunks(" " + text.as_py(), max(size, 4 * m.longest), m.longest)):
                    part, n = packed(piece)
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "row": row, "chunk": k, "part": part, "bytes": n, "left": left, "right": right, "first": first, "last": last}], schema=_PART)

    def texts(batches):
        """Rows of about a MB of text, as a batch of compressed chunks holds several times its size, and ids still more."""
        for batch in batches:
            for a, b in slices(batch.column(4).to_pylist(), 1 << 20):
                yield batch.slice(a, b - a)

    def matrix(batches):
        m = model(path)
        for batch in texts(batches):
            cells = [transfer(m, unpacked(part, n), *x) for part, n, *x in zip(*(batch.column(i).to_pylist() for i in range(3, 9)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([[x for x, _ in c] for c in cells], pa.list_(pa.int32())), pa.array([[y for _, y in c] for c in cells], pa.list_(pa.int32()))], ["row", "chunk", "entry", "exit"]
            )

    def trace(batches):
        m = model(path)
        for batch in texts(batches):
            ids, same = [], []
            for part, n, left, right, x, y in zip(*(batch.column(i).to_pylist() for i in range(3, 9)), strict=True):
                text = unpacked(part, n)
                out, a, b = backtrace(m, text, left, right, x, y)
                ids.append(out)
                same.append(m.decode(out) == text[a:b].replace(SPACE, " ").encode("utf-8", "replace"))
            yield _row(batch.column(0), batch.column(1), batch.column(2).cast(pa.int32()), ids, same)

    short = numbered.where(~giant).mapInArrow(whole, ROW)
    # Giant documents are split before anything else, and their chunks dealt out evenly.
    with shuffles_go(docs.sparkSession):
        parts = checkpointed(numbered.where(giant).mapInArrow(cut, "doc_id long, row long, chunk long, part binary, bytes int, left int, right int, first boolean, last boolean").repartition("row", "chunk"))
        states = scan(parts.mapInArrow(matrix, _MATRIX), fan)
    return short.unionByName(parts.join(states, ["row", "chunk"]).select("doc_id", "row", "chunk", "part", "bytes", "left", "right", "x", "y").mapInArrow(trace, ROW))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """The chunks with `text`, what their ids say, in place of `ids`; a document's text is that of its chunks in order. No ids give the empty text."""
    small_batches(encoded.sparkSession)
    path = shipped(encoded.sparkSession, path)
    columns = [c for c in encoded.columns if c != "ids"]

    def run(batches):
        m = model(path)
        for batch in batches:
            at = batch.schema.get_field_index("chunk")
            texts = [m.decode(i or []).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
            texts = [t[1:] if k == 0 else t for k, t in zip(batch.column(at).to_pylist(), texts, strict=True)]  # the space mark that encoding puts in front
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, "text"])

    return encoded.mapInArrow(run, encoded.select(*columns).schema.add("text", "string"))


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the model file to the executors, and returns its name there; a name that is no file here is taken to be there already."""
    if not os.path.isfile(path):
        return path
    known = spark.sparkContext.__dict__.setdefault("_strataspan_files", set())
    if path not in known:
        spark.sparkContext.addFile(path)
        known.add(path)
    return os.path.basename(path)


@lru_cache(4)
def model(path: str) -> Pieces:
    return Pieces(path if os.path.isfile(path) else SparkFiles.get(path))


_PART = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int64()), ("part", pa.binary()), ("bytes", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])


def digest(encoded: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_tokens, n_chunks, ids_hash (xxhash64 of its chunks' xxhash64s in order), whole.

    Each chunk is hashed alone; chunks of a document meet as numbers.
    """
    return (
        encoded.select("doc_id", "row", F.struct("chunk", F.xxhash64("ids").alias("h")).alias("part"), F.size("ids").cast("long").alias("n"), "whole")
        .groupBy("row", "doc_id")
        .agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list("part")).alias("parts"), F.min("whole").alias("whole"))  # the chunks of one document
        .select("doc_id", "n_tokens", "n_chunks", F.xxhash64(F.transform("parts", lambda p: p["h"])).alias("ids_hash"), "whole")
    )
