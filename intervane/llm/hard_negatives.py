"""Hard negatives by a vector-approximation file: every row is kept twice, as one byte a dimension and exactly.

Each dimension is cut into cells at quantiles. For an anchor, a table holds the least and the greatest product that each cell of
each dimension can give; summed over a row's cells they bound its score from below and above. Exact vectors are only multiplied
for rows whose bounds allow them among the best, so the answer is exact whatever the cells are: they decide the work alone.

Anchors (a stated share of the rows) meet all rows in tiles of a group of rows by a group of anchors. A tile gives at most k rows
for each anchor, or each anchor and positive, from each block of rows, and the best of these are ranked over all tiles.

Vectors: vec_id, label, embedding; other columns are left behind. Rows with a null vec_id or label, a null vector or a null or
non-finite component take no part. Of rows with the same vec_id the one of least (label, vector) does. Missing components of
shorter vectors are zeros. Scaled components are held to +-2^24, so that scores fit 64 bits. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervane.llm.common import from_rows, releasing_pair, save

_MOST = 2**24
_ROWS, _ANCHORS = 8192, 128  # of one block of bounds in a tile
_FAR = np.iinfo(np.int64).max // 4


@dataclass(frozen=True)
class Mining:
    """What is mined, and the sizes of the work, which don't change the result.

    cells: of a dimension, at most 256. sample: rows at most, chosen by a hash of vec_id, that place the cells' bounds; the outer
    bounds are those of all rows.
    """

    scale: int = 256
    anchor_every: int = 100
    positives: int = 5
    negatives: int = 5
    least_percent: int = 80
    most_percent: int = 100
    cells: int = 128
    sample: int = 4096
    rows_a_tile: int = 65_536
    anchors_a_tile: int = 32_768


def relabelled(label, vec_id, every: int = 7, classes: int = 10):
    """The label, moved on by one where vec_id is divisible by every."""
    return F.when(vec_id % every == 0, (label + 1) % classes).otherwise(label)


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q array<int>) of the rows that take part, once each: q = floor(scale * component)."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ok)
    whole = lambda v: F.floor(F.greatest(F.lit(-float(_MOST)), F.least(F.lit(float(_MOST)), v.cast("double") * scale))).cast("int")
    x = x.select("vec_id", "label", F.transform("embedding", whole).alias("q"))
    return x.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


@dataclass(frozen=True)
class Cells:
    """Cells of each dimension: inner edges, and the least and greatest number of each (dimensions x cells)."""

    edges: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int) -> Cells:
        """From sampled rows and the range of all: the sample decides how tight the bounds are, never whether they hold."""
        edges, width = [], len(least)
        for d in range(width):
            inner = np.quantile(sample[:, d], np.arange(1, cells) / cells, method="higher") if len(sample) else np.array([])
            inner = np.unique(inner.astype(np.int64))
            edges.append(inner[(inner > least[d]) & (inner <= most[d])])
        n = max([1, *(len(e) + 1 for e in edges)])
        low, high = np.zeros((width, n), np.int64), np.zeros((width, n), np.int64)
        for d, e in enumerate(edges):
            low[d, : len(e) + 1], high[d, : len(e) + 1] = [least[d], *e], [*(e - 1), most[d]]
        return Cells(edges, low, high)

    def place(self, q: np.ndarray) -> np.ndarray:
        """Rows of components as rows of cell numbers."""
        out = np.empty(q.shape, np.uint8)
        for d, e in enumerate(self.edges):
            out[:, d] = np.searchsorted(e, q[:, d], "right")
        return out

    def bounds(self, anchors: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the score of each row with each anchor (rows x anchors), by lookup of each row's cells."""
        n, width = anchors.shape
        most = float(np.abs(anchors).max(initial=0)) * max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)) * max(width, 1)
        kind = np.int32 if most < 2**31 else np.int64
        total = np.zeros((len(cells), 2 * n), kind)
        for d in range(width):
            x, y = np.multiply.outer(self.low[d], anchors[:, d]), np.multiply.outer(self.high[d], anchors[:, d])
            total += np.concatenate([np.minimum(x, y), np.maximum(x, y)], axis=1).astype(kind)[cells[:, d]]
        return total[:, :n], total[:, n:]


@dataclass(frozen=True)
class Index:
    """The vector-approximation file, (vec_id, label, cells, exact, row_group) in the shared folder, its cells and its counts."""

    table: DataFrame
    cells: Cells
    rows: int
    anchors: int
    row_groups: int
    anchor_groups: int


def build(vectors: DataFrame, how: Mining | None = None) -> Index:
    """Index of all rows that take part."""
    how = how or Mining()
    spark = vectors.sparkSession
    rows = save(scaled(vectors, how.scale), "vectors")
    is_anchor = (F.col("vec_id") % how.anchor_every == 0).cast("long")
    n, anchors, width, narrow = rows.agg(F.count("*"), F.sum(is_anchor), F.max(F.size("q")), F.min(F.size("q"))).first()
    anchors, width = anchors or 0, width or 0
    least, most = np.zeros(width, np.int64), np.zeros(width, np.int64)
    for d, a, z in rows.select(F.posexplode("q").alias("d", "x")).groupBy("d").agg(F.min("x"), F.max("x")).collect():  # a row a dimension
        least[d], most[d] = (a, z) if d < narrow else (min(a, 0), max(z, 0))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(how.sample).select("q").toArrow().column("q").to_pylist()
    cells = Cells.of(np.array([q + [0] * (width - len(q)) for q in some], np.int64).reshape(len(some), width), least, most, min(how.cells, 256))
    groups = max(-(-n // how.rows_a_tile), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1024)), 1)

    def write(batches):
        for batch in batches:
            q = np.zeros((batch.num_rows, width), np.int32)
            for k, v in enumerate(batch.column("q").to_pylist()):
                q[k, : len(v)] = v
            place = cells.place(q)
            parts = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (place, q.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *parts], names=["vec_id", "label", "cells", "exact"])

    table = rows.mapInArrow(write, "vec_id long, label long, cells binary, exact binary")
    table = save(table.withColumn("row_group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), "vafile")
    return Index(table, cells, n, anchors, groups, max(1, -(-anchors // how.anchors_a_tile)))


def _tiles(index: Index, anchors: DataFrame):
    """Rows and anchors (vec_id, label, exact and more columns), each with the tiles that it belongs to."""
    across = F.explode(F.sequence(F.lit(0), F.lit(index.anchor_groups - 1)))
    down = F.explode(F.sequence(F.lit(0), F.lit(index.row_groups - 1)))
    rows = index.table.select(*[F.col(c).alias(c) for c in index.table.columns], across.alias("anchor_group"))
    own = anchors.withColumn("anchor_group", F.pmod(F.xxhash64("vec_id"), F.lit(index.anchor_groups)).cast("int")).withColumn("row_group", down)
    return rows.groupBy("row_group", "anchor_group"), own.groupBy("row_group", "anchor_group")


def _matrix(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


_POSITIVES = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
_NEGATIVES = pa.schema([*_POSITIVES, ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _nearest(index: Index, k: int):
    """A tile's function: the k best rows of each anchor's own label."""
    cells = index.cells
    width = len(cells.edges)

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        ids, labels = (rows[c].to_numpy() for c in ("vec_id", "label"))
        a_ids, a_labels = (anchors[c].to_numpy() for c in ("vec_id", "label"))
        if len(ids) and len(a_ids):
            exact, place = _matrix(rows["exact"], "<i4", width), _matrix(rows["cells"], "u1", width)
            vectors = _matrix(anchors["exact"], "<i4", width).astype(np.int64)
            for label in np.unique(a_labels):
                of_label, asked = np.nonzero(labels == label)[0], np.nonzero(a_labels == label)[0]
                for r0 in range(0, len(of_label), _ROWS):
                    mine = of_label[r0 : r0 + _ROWS]
                    at = {v: j for j, v in enumerate(ids[mine].tolist())}
                    for a0 in range(0, len(asked), _ANCHORS):
                        some = asked[a0 : a0 + _ANCHORS]
                        low, high = cells.bounds(vectors[some], place[mine])
                        for j, a in enumerate(some.tolist()):
                            lo, hi = low[:, j].astype(np.int64), high[:, j].astype(np.int64)
                            if (own := at.get(a_ids[a])) is not None:
                                lo[own] = hi[own] = -_FAR
                            least = np.partition(lo, len(lo) - k)[len(lo) - k] if len(lo) > k else -_FAR
                            may = mine[(hi >= least) & (hi > -_FAR)]
                            scores = exact[may].astype(np.int64) @ vectors[a]
                            out += [(a_ids[a], ids[may[b]], scores[b]) for b in _best(ids[may], scores, k)]
        return pa.Table.from_batches([from_rows(out, _POSITIVES)])

    return run


def _in_windows(index: Index, how: Mining):
    """A tile's function: for each anchor and positive, the best rows of other labels whose score is in the positive's window."""
    cells, k = index.cells, how.negatives
    width = len(cells.edges)

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        ids, labels = (rows[c].to_numpy() for c in ("vec_id", "label"))
        a_ids, a_labels, wanted = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
        if len(ids) and len(a_ids):
            exact, place = _matrix(rows["exact"], "<i4", width), _matrix(rows["cells"], "u1", width)
            vectors = _matrix(anchors["exact"], "<i4", width).astype(np.int64)
            for r0 in range(0, len(ids), _ROWS):
                mine = slice(r0, r0 + _ROWS)
                for a0 in range(0, len(a_ids), _ANCHORS):
                    low, high = cells.bounds(vectors[a0 : a0 + _ANCHORS], place[mine])
                    for j in range(low.shape[1]):
                        a = a0 + j
                        windows = [(p["id"], s, -(-how.least_percent * s // 100), how.most_percent * s // 100) for p in wanted[a] for s in (p["score"],)]
                        lo, hi, other = low[:, j], high[:, j], labels[mine] != a_labels[a]
                        may = np.zeros(len(lo), bool)
                        for _, _, least, most in windows:
                            inside = other & (lo >= least) & (hi <= most)
                            at = lo[inside]
                            sure = max(least, int(np.partition(at, len(at) - k)[len(at) - k])) if len(at) >= k else least
                            may |= other & (hi >= sure) & (lo <= most)
                        some = r0 + np.nonzero(may)[0]
                        scores = exact[some].astype(np.int64) @ vectors[a]
                        for p, s, least, most in windows:
                            fit = np.nonzero((scores >= least) & (scores <= most))[0]
                            best = fit[_best(ids[some[fit]], scores[fit], k)]
                            out += [(a_ids[a], p, s, ids[some[b]], scores[b]) for b in best]
        return pa.Table.from_batches([from_rows(out, _NEGATIVES)])

    return run


def positives(index: Index, how: Mining) -> DataFrame:
    """(anchor_id, positive_id, positive_score, place): the best other rows of each anchor's label, place from 1."""
    anchors = index.table.where(F.col("vec_id") % how.anchor_every == 0).select("vec_id", "label", "exact")
    rows, own = _tiles(index, anchors)
    found = rows.cogroup(own).applyInArrow(releasing_pair(_nearest(index, how.positives)), "anchor_id long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= how.positives)


def mine(vectors: DataFrame, how: Mining | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose vec_id is divisible by anchor_every. For each of an anchor's best positives: the best rows of other
    labels with least_percent * positive_score <= 100 * negative_score <= most_percent * positive_score, by score, then vec_id.
    """
    how = how or Mining()
    index = build(vectors, how)
    pairs = positives(index, how).groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))  # at most how.positives
    known = save(pairs.withColumnRenamed("anchor_id", "vec_id"), "positives")
    anchors = index.table.where(F.col("vec_id") % how.anchor_every == 0).select("vec_id", "label", "exact").join(known, "vec_id")
    rows, own = _tiles(index, anchors)
    types = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = rows.cogroup(own).applyInArrow(releasing_pair(_in_windows(index, how)), types)
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= how.negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql() -> str:
    """The same rows over embeddings in DuckDB, every anchor with every row."""
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
 QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5"""
