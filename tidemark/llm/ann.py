"""Approximate nearest neighbours: inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every row is indexed under its nearest
centroid c with one byte per subspace of its residual, which stands for r. A query q probes its
nearest cells. As |q - c - r|^2 = |q - c|^2 - 2 q.r + (2 c.r + |r|^2), one asymmetric table of
products of q with the codebooks, the same for all cells, and a figure kept per row give the rough
distances; the best `shortlist` of each batch of rows are reranked by the exact distance in double
precision.

Queries are broadcast in blocks of a bounded size and the index is read once for each block: it is
never shuffled or copied, so it does not matter how many rows a cell has. A task holds a batch of
the index and the best found for each query of a block.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a
null id. Vectors of each length are an index of their own. With fewer than k candidates all are
returned; ties go to the smaller id; rows with equal vectors or ids are candidates each, and each
query row leaves out itself alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, sampled, stored, table

K = 10
#: Cells are a quarter of the root of the rows, within these bounds; a query probes this share of them.
CELLS = (64, 4096)
PROBED = 0.75
SUBSPACES = 16
CODES = 256
SHORTLIST = 128
SAMPLE = 20_000
BLOCK_QUERIES = 8192
#: Lengths that the vectors of one table may have.
WIDTHS = 64
_ROUNDS = 12
_SIDE = 128


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centres**2).sum(axis=1)
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (norms - 2 * x[at : at + 4096] @ centres.T).argmin(axis=1)
    return out


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(_ROUNDS):
        of = _nearest(x, centres)
        counts = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


class Index:
    """Centroids and one codebook per subspace; their sizes are parameters."""

    def __init__(self, sample: np.ndarray, cells: int, subspaces: int = SUBSPACES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres = _means(sample, cells, rng)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [_means(rest[:, p], CODES, rng) for p in self.parts]

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, 2 c.r + |r|^2) of vectors."""
        cell = _nearest(x, self.centres)
        rest = x - self.centres[cell]
        codes = np.column_stack([_nearest(rest[:, p], book) for p, book in zip(self.parts, self.books, strict=True)]).astype(np.uint8)
        r = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return cell, codes, 2 * (self.centres[cell] * r).sum(axis=1) + (r * r).sum(axis=1)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """Per subspace, products of each query with each code."""
        return [(queries[:, p] @ book.T).astype(np.float32) for p, book in zip(self.parts, self.books, strict=True)]

    def to_cells(self, queries: np.ndarray, probes: int, sizes: np.ndarray, least: int) -> np.ndarray:
        """Squared distances of queries to centroids; infinite beyond the nearest `probes` and those that hold `least` rows."""
        far = (queries**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * queries @ self.centres.T
        out = np.full(far.shape, np.inf, np.float32)
        near = np.argsort(far, axis=1, kind="stable")
        held = np.cumsum(sizes[near], axis=1) - sizes[near]
        probed = np.where((np.arange(far.shape[1]) < probes) | (held < least), np.take_along_axis(far, near, axis=1), np.inf)
        np.put_along_axis(out, near, probed.astype(np.float32), axis=1)
        return out


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, np.float64).reshape(-1, width)


def _usable(vectors: DataFrame, id_col: str, vec_col: str, asked: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("vec"), F.coalesce(F.expr(asked), F.lit(False)).alias("asked")).where("id IS NOT NULL AND vec IS NOT NULL")
    return rows.where(sound & F.exists("vec", lambda x: x != 0))


def _scan(shared, k: int, probes: int, shortlist: int):
    """The best found in a task's rows (cell, code, term, row, id, vec) for each query of a block (row, id, vec)."""

    def search(index, sizes, queries, codes, cell, term, x, row, id_):
        number, q = queries
        rough = index.to_cells(q, probes, sizes, k + 1)[:, cell] + term.astype(np.float32)
        for s, t in enumerate(index.tables(q)):
            rough -= 2 * t[:, codes[:, s]]
        rough[number[:, None] == row[None, :]] = np.inf
        take = min(shortlist, rough.shape[1])
        near = np.argpartition(rough, take - 1, axis=1)[:, :take]
        for i in range(len(q)):
            at = near[i][np.isfinite(rough[i, near[i]])]
            exact = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
            at, exact = at[order := np.lexsort((row[at], id_[at], exact))[:k]], exact[order]
            yield np.full(len(at), number[i]), row[at], id_[at], exact

    def run(batches):
        index, sizes, number, ids, q = shared.value
        found = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            cell, term, row, id_ = (np.asarray(batch.column(i)) for i in (0, 2, 3, 4))
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            x = _matrix(batch.column(5), q.shape[1])
            new = [some for at in range(0, len(q), _SIDE) for some in search(index, sizes, (number[at : at + _SIDE], q[at : at + _SIDE]), codes, cell, term, x, row, id_)]
            found = [np.concatenate([a, *b]) for a, b in zip(found, zip(*new, strict=True), strict=True)]
            query = found[0]
            order = np.lexsort((found[1], found[2], found[3], query))
            rank = np.arange(len(query)) - np.searchsorted(query[order], query[order])
            found = [a[order[rank < k]] for a in found]
        name = dict(zip(number.tolist(), ids.tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array([name[i] for i in found[0].tolist()], pa.int64()), pa.array(found[1]), pa.array(found[2]), pa.array(found[3])], ["query", "query_id", "row", "vec_id", "score"])

    return run


_FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score double"


def search(vectors: DataFrame, asked: str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, probed: float = PROBED, cells: int | None = None, shortlist: int = SHORTLIST, sample: int = SAMPLE, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row that meets the condition `asked`, among all rows but itself."""
    spark = vectors.sparkSession
    rows = numbered(_usable(vectors, id_col, vec_col, asked).withColumn("id", F.col("id").cast("bigint")), "row", "vectors")
    widths = {r["n"]: (r["count"], r["q"]) for r in rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("count"), F.count_if("asked").alias("q")).limit(WIDTHS + 1).collect()}
    if len(widths) > WIDTHS:
        raise ValueError(f"vectors of more than {WIDTHS} lengths")
    parts = []
    for width, (count, wanted) in sorted(widths.items()):
        own = rows.where(F.size("vec") == width)
        n_cells = cells or int(np.clip(count**0.5 / 4, *CELLS))
        taken = sampled(own.select("row", "vec"), sample).toArrow()
        index = Index(_matrix(taken["vec"], width)[np.argsort(np.asarray(taken["row"]), kind="stable")], n_cells)
        probes = max(1, round(len(index.centres) * probed))
        fitted = spark.sparkContext.broadcast(index)

        def assign(batches, fitted=fitted, width=width):
            for batch in batches:
                if batch.num_rows:
                    cell, codes, term = fitted.value.coded(_matrix(batch.column(2), width))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(term), *batch.columns], ["cell", "code", "term", "row", "id", "vec"])

        indexed, _ = stored(own.select("row", "id", "vec").mapInArrow(assign, "cell int, code binary, term double, row bigint, id bigint, vec array<double>"), "index")
        sizes = np.zeros(len(index.centres), np.int64)
        for r in indexed.groupBy("cell").count().collect():  # a row per cell
            sizes[r["cell"]] = r["count"]
        blocks = -(-wanted // block_queries)
        for block in range(blocks):
            # about `block_queries` rows, dealt by a hash of their numbers
            queries = own.where(F.col("asked") & (F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)) == block)).select("row", "id", "vec").toArrow()
            shared = spark.sparkContext.broadcast((index, sizes, np.asarray(queries["row"]), np.asarray(queries["id"]), _matrix(queries["vec"], width)))
            parts.append(indexed.mapInArrow(_scan(shared, k, probes, shortlist), _FOUND))
    found = spark.createDataFrame([], _FOUND) if not parts else parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")
