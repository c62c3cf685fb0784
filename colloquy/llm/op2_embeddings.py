"""Embedding near-dedup by a dual traversal of a cover tree, with exact threshold pairs.

Vectors are compared as points on the unit sphere, where cosine >= c is a distance of at most eps = sqrt(2 - 2 c). The tree has
nested levels whose radii halve:

* Top: pivots in farthest-first order over a bounded sample (SAMPLE vectors, the first by a hash of the id); each prefix of the
  order covers the sample with a smaller radius. Every vector goes to its nearest pivot. The index is fitted on the sample, but it
  holds every vector, and bounds use the radius that the vectors really have.
* Below a pivot, in pieces of at most about PIECE vectors: nodes, whose centres are a net of radius eps, and leaves, a net of
  radius eps / 2 that keeps the nodes' centres. A leaf hangs on the node nearest to its centre. Nodes and leaves know the radius
  that their vectors really have; those of a leaf (at most eps / 2) all link, so it needs only a count.

The traversal goes down in three steps, and nothing below a pruned pair is shipped:

* A node meets the cell of another pivot if the cell's radius, the node's and eps allow it, and if it comes within eps of the
  plane halfway between the two pivots, which anything in reach of the other cell must do. Only then is it sent to that cell, in
  blocks of about BLOCK leaves and in single precision.
* Two nodes are pruned when their centres are farther apart than both radii and eps. Nodes that have none left in a block send
  nothing more to it; the leaves of the others meet there.
* Leaves are pruned in the same way. A pair that lies within eps as a whole is linked by its counts, without its vectors, so a
  third of all rows in one tight group costs a few leaves; pairs in between are settled vector by vector.

All bounds keep a margin (MARGIN; ROUGH in single precision), and every single pair is decided by its cosine in double precision.

No tree can prune vectors that all lie equally far from each other; there the traversal compares all blocks of nodes, in matrix products.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of different length don't
link. A null id is returned as it is and never names a component (null if it has no other). Repeated rows are vectors of their
own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.staging import staged

from .common import components, mix

COSINE = 0.9
SAMPLE = 2048
PIECE = 4096
BLOCK = 16384
MARGIN = 1e-9
#: By how much a cosine in single precision may be off.
ROUGH = 1e-4
MOST_PIVOTS = 1024


def _pack(rows: np.ndarray, kind: type = np.float64) -> pa.Array:
    rows = np.ascontiguousarray(rows, kind)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _unpack(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """The vectors of a column, all of one width and none null, as a matrix over the column's own bytes."""
    own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    own = own.cast(pa.large_binary())
    ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    return np.frombuffer(own.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(own), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision; null where a vector can't be compared."""
    for batch in batches:
        lists = batch.column(2)
        widths = lists.value_lengths().fill_null(0).to_numpy()
        flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths) - widths
        rows, units = [], [pa.array([], pa.binary())]
        for w in np.unique(widths[widths > 0]):
            at = np.flatnonzero(widths == w)
            v = flat[starts[at][:, None] + np.arange(w)].astype(np.float64)
            top = np.abs(v).max(1)
            good = np.isfinite(top) & (top > 0)
            v = v[good] / top[good][:, None]
            rows.append(at[good])
            units.append(_pack(v / np.sqrt((v * v).sum(1))[:, None]))
        unit = _only(pa.concat_arrays(units), np.concatenate(rows), len(lists)) if rows else pa.nulls(len(lists), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), unit], ["rid", "vec_id", "unit"])


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n centres of which every prefix is a net of the points; stops when all are centres."""
    pick, near = [0], np.full(len(points), np.inf)
    while len(pick) < min(n, len(points)):
        near = np.minimum(near, 2 - 2 * points @ points[pick[-1]])
        if near.max() <= MARGIN:
            break
        pick.append(int(near.argmax()))
    return points[pick]


def nets(points: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """For each point the index of its node's centre and of its leaf's: nested nets with radii eps and eps / 2."""
    owner = np.zeros(len(points), np.int64)
    centres: list[int] = []
    upper, near = owner, np.full(len(points), -np.inf)
    for radius in (eps, eps / 2):
        upper = owner.copy()
        limit = 1 - radius * radius / 2
        open_ = near < limit
        while open_.any():
            c = int(open_.argmax())
            centres.append(c)
            dot = points @ points[c]
            closer = dot > near
            near[closer], owner[closer] = dot[closer], c
            open_ &= near < limit
            open_[c] = False
            owner[c] = c
    return upper[owner], owner


def _cells(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy() // 8
            cell, away = -lengths.astype(np.int64), np.full(len(lengths), 2.0)
            for length in np.unique(lengths):
                if int(length) in pivots:
                    first, own = pivots[int(length)]
                    every = np.flatnonzero(lengths == length)
                    for i in range(0, len(every), 2048):
                        at = every[i : i + 2048]
                        dot = _unpack(batch.column(1).take(pa.array(at))) @ own.T
                        cell[at] = first + dot.argmax(1)
                        away[at] = np.sqrt(np.maximum(0, 2 - 2 * dot.max(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int64()), pa.array(away, pa.float64())], ["rid", "unit", "cell", "away"])

    return run


def _leaf_rows(eps: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        rid, points = table["rid"].to_numpy(), _unpack(table["unit"])
        above, owner = nets(points, eps - 4 * MARGIN)
        cell, first = table["cell"][0].as_py(), np.unique(owner)
        centre = np.zeros((len(first), points.shape[1]))
        at = np.searchsorted(first, owner)
        np.add.at(centre, at, points)
        size = np.bincount(at, minlength=len(first))
        length = np.sqrt((centre * centre).sum(1))
        centre = np.where((size == 1)[:, None] | (length < 0.5)[:, None], points[first], centre / np.maximum(length, 1e-300)[:, None])
        for tries in range(2):
            away = np.sqrt(np.maximum(0, 2 - 2 * (points * centre[at]).sum(1)))
            radius = np.zeros(len(first))
            np.maximum.at(radius, at, away)
            radius = np.where(size == 1, 0.0, radius + MARGIN)
            wide = 2 * radius > eps - MARGIN
            if not wide.any() or tries:
                break
            centre[wide] = points[first[wide]]
        reach = float((table["away"].to_numpy()).max()) + MARGIN
        n, nodes = len(rid), np.unique(above)
        cover = np.zeros(len(nodes))
        np.maximum.at(cover, np.searchsorted(nodes, above), np.sqrt(np.maximum(0, 2 - 2 * (points * points[above]).sum(1))))
        cover = np.where(np.bincount(np.searchsorted(nodes, above)) == 1, 0.0, cover + MARGIN)
        hung = np.bincount(np.searchsorted(nodes, above[first]), minlength=len(nodes))
        out = pa.table({"rid": rid, "leaf": rid[first][at], "node": rid[above], "cover": _spread(cover, nodes, n), "hung": _spread(hung, nodes, n)})
        return out.append_column("unit", table["unit"]).append_column("cell", pa.array([cell] * len(rid), pa.int64())).append_column("centre", _only(_pack(centre), first, n)).append_column("radius", _spread(radius, first, n)).append_column("size", _spread(size, first, n)).append_column("reach", pa.array([reach] * len(rid)))

    return run


def _spread(values: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """values at the rows `at`, null elsewhere."""
    where = np.full(n, -1)
    where[at] = np.arange(len(at))
    return pa.array(values).take(pa.array(where, mask=where < 0))


def _only(values: pa.Array, at: np.ndarray, n: int) -> pa.Array:
    where = np.full(n, -1)
    where[at] = np.arange(len(at))
    return values.take(pa.array(where, mask=where < 0))


def _sent(shared, eps: float):
    """Where the nodes of a cell are compared: rows (ca, pa, cb, pb, side, node, cover, hung, centre), a block against another or itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            own = batch.column(3).to_numpy()
            for cell in np.unique(own):
                rows = np.flatnonzero(own == cell)
                part = batch.take(pa.array(rows))
                node, cover, unit, hung = part.column(0).to_numpy(), part.column(1).to_numpy(), _unpack(part.column(2)), part.column(4).to_numpy()
                others, pivot, reach, parts = cells[int(cell)]
                if pivot is None:
                    near = np.ones((len(node), len(others)), bool)
                else:
                    dot, me = unit @ pivot.T, int(np.flatnonzero(others == cell)[0])
                    between = np.sqrt(np.maximum(2 - 2 * pivot @ pivot[me], 1e-300))
                    plane = (dot[:, [me]] - dot) / between <= eps + cover[:, None] + MARGIN
                    near = plane & (np.sqrt(np.maximum(0, 2 - 2 * dot)) <= reach[None, :] + cover[:, None] + eps + MARGIN)
                    near[:, me] = True
                block = (mix(node.astype(np.uint64)) % np.uint64(parts[np.flatnonzero(others == cell)[0]])).astype(np.int64)
                thin = _pack(unit, np.float32)
                for k, other in enumerate(others.tolist()):
                    for p in range(int(parts[k])):
                        at = np.flatnonzero(near[:, k])
                        if not len(at):
                            continue
                        mine = block[at]
                        first = (cell < other) | ((cell == other) & (mine <= p))
                        here, there = np.stack([np.full(len(at), cell), mine]), np.stack([np.full(len(at), other), np.full(len(at), p)])
                        (ca, pa_), (cb, pb) = np.where(first, here, there), np.where(first, there, here)
                        columns = [ca, pa_, cb, pb, np.where(first, 0, 1).astype(np.int32), node[at], cover[at], hung[at]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), thin.take(pa.array(at))], ["ca", "pa", "cb", "pb", "side", "node", "cover", "hung", "centre"])

    return run


def _near_nodes(eps: float):
    """The nodes of two blocks, or of one, that their radii let meet another one there, and in one block those with several leaves."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ca, pa_, cb, pb = (k.as_py() for k in key)
        side, cover, points = table["side"].to_numpy(), table["cover"].to_numpy().astype(np.float32), _unpack(table["centre"], np.float32)
        same = (ca, pa_) == (cb, pb)
        a = np.flatnonzero(side == 0)
        a = a[np.argsort(cover[a], kind="stable")]
        b = a if same else np.flatnonzero(side == 1)
        met = (table["hung"].to_numpy() > 1) & same
        across = points[b].T
        for i in range(0, len(a) if len(b) else 0, 256):
            own = a[i : i + 256]
            widest = cover[own[-1]] + cover[b] + np.float32(eps)  # the widest node of the block first, each node's own reach after it
            dot = points[own] @ across
            r, c = np.nonzero(dot >= 1 - widest * widest / 2 - np.float32(ROUGH))
            reach = cover[own[r]] + cover[b[c]] + np.float32(eps)
            near = dot[r, c] >= 1 - reach * reach / 2 - np.float32(ROUGH)
            if same:
                near &= c > r + i
            r, c = r[near], c[near]
            met[own[r]] = True
            met[b[c]] = True
        kept = table.filter(pa.array(met))
        return kept.select(["ca", "pa", "cb", "pb", "side", "node"])

    return run


def _leaf_pairs(cosine: float, eps: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        rid, size, radius, points = table["leaf"].to_numpy(), table["size"].to_numpy(), table["radius"].to_numpy(), _unpack(table["centre"])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = key[0] == key[2] and key[1] == key[3]
        b = a if same else b
        rough_b = points[b].astype(np.float32).T
        found: list[np.ndarray] = []
        for i in range(0, len(a) if len(b) else 0, 256):
            own = a[i : i + 256]
            reach = radius[own].max() + radius[b] + eps
            dot = points[own].astype(np.float32) @ rough_b
            r, c = np.nonzero(dot >= (1 - reach * reach / 2 - ROUGH).astype(np.float32))
            if same:
                r, c = r[c > r + i], c[c > r + i]
            found.append(np.stack([own[r], b[c]]))
        x, y = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        dot = np.concatenate([(points[x[k : k + 8192]] * points[y[k : k + 8192]]).sum(1) for k in range(0, len(x), 8192)] or [np.zeros(0)])
        apart, both = np.sqrt(np.maximum(0, 2 - 2 * dot)), radius[x] + radius[y]
        single = both == 0
        link = np.where(single, dot >= cosine, apart + both <= eps - MARGIN)
        open_ = ~single & ~link & (apart <= both + eps + MARGIN)
        keep = link | open_
        return pa.table({"a": rid[x][keep], "b": rid[y][keep], "size_a": size[x][keep], "size_b": size[y][keep], "linked": link[keep]})

    return run


def _settled(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        side, rid, points = table["side"].to_numpy(), table["rid"].to_numpy(), _unpack(table["unit"])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = points[a] @ points[b].T >= cosine
        n = np.concatenate([links.sum(1), links.sum(0)])
        own = np.concatenate([rid[a], rid[b]])
        keep = n > 0
        pair = [table["a"][0].as_py(), table["b"][0].as_py()]
        return pa.table({"a": np.full(keep.sum(), pair[0]), "b": np.full(keep.sum(), pair[1]), "rid": own[keep], "n": n[keep]})

    return run


def _cells_of(known: list, pivots: dict[int, tuple[int, np.ndarray]], block: int) -> dict[int, tuple]:
    """For each cell the cells of its length, their pivots, radii and numbers of blocks. known: (cell, radius, leaves); cells below 0 have no pivot."""
    out, by_length = {}, {}
    for cell, radius, leaves in known:
        length = None if cell < 0 else next(n for n, (first, p) in pivots.items() if first <= cell < first + len(p))
        if length is None:
            out[cell] = (np.array([cell]), None, None, np.array([-(-leaves // block)]))
        else:
            by_length.setdefault(length, []).append((cell, radius, -(-leaves // block)))
    for length, own in by_length.items():
        cell, radius, parts = (np.array(x) for x in zip(*own, strict=True))
        shared = (cell, pivots[length][1][cell - pivots[length][0]], radius, parts)
        out |= {int(c): shared for c in cell}
    return out


def cover_tree_links(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, piece: int = PIECE, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, extra) of vectors (rid, unit): rid with its leaf, linked leaves with sizes, further links of a rid.

    members: rid, leaf, size (of the leaf). links: a, b, size_a, size_b. extra: a, b, rid, n.
    """
    spark, eps = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    n = vectors.count()
    first, pivots = 0, {}
    chosen = vectors.orderBy(F.xxhash64("rid")).limit(sample).collect()
    for length in sorted({len(r["unit"]) // 8 for r in chosen}):
        own = np.stack([np.frombuffer(r["unit"], np.float64) for r in chosen if len(r["unit"]) == 8 * length])
        pivots[length] = (first, farthest_first(own, min(MOST_PIVOTS, max(1, math.ceil(n / block)))))
        first += len(pivots[length][1])
    shared = spark.sparkContext.broadcast(pivots)
    celled = staged(vectors.mapInArrow(_cells(shared), "rid long, unit binary, cell long, away double"))
    pieces = celled.groupBy("cell").agg(F.ceil(F.count("*") / piece).alias("pieces"))
    dealt = celled.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64("rid"), F.col("pieces"))).drop("pieces")
    schema = "rid long, leaf long, node long, cover double, hung long, unit binary, cell long, centre binary, radius double, size long, reach double"
    grown = staged(dealt.groupBy("cell", "piece").applyInArrow(_leaf_rows(eps), schema))
    known = [tuple(r) for r in grown.groupBy("cell").agg(F.max("reach"), F.count("size")).collect()]
    cells = spark.sparkContext.broadcast(_cells_of(known, pivots, block))
    task = ["ca", "pa", "cb", "pb"]
    sent = grown.where("hung is not null").select("node", "cover", "unit", "cell", "hung").mapInArrow(_sent(cells, eps), "ca long, pa long, cb long, pb long, side int, node long, cover double, hung long, centre binary")
    near = staged(sent.groupBy(*task).applyInArrow(_near_nodes(eps), "ca long, pa long, cb long, pb long, side int, node long"))
    leaf = staged(grown.where("size is not null").select("leaf", "node", "centre", "radius", "size"))
    met = near.join(leaf, "node").groupBy(*task).applyInArrow(_leaf_pairs(cosine, eps), "a long, b long, size_a long, size_b long, linked boolean")
    met = staged(met)
    links, open_ = met.where("linked").drop("linked"), met.where("not linked").select("a", "b")
    unit = grown.select("rid", F.col("leaf").alias("of"), "unit")
    both = open_.join(unit, F.col("a") == F.col("of")).select("a", "b", F.lit(0).alias("side"), "rid", "unit").union(open_.join(unit, F.col("b") == F.col("of")).select("a", "b", F.lit(1).alias("side"), "rid", "unit"))
    extra = staged(both.groupBy("a", "b").applyInArrow(_settled(cosine), "a long, b long, rid long, n long"))
    sizes = leaf.select(F.col("leaf").alias("of"), "size")
    members = grown.select("rid", "leaf").join(sizes, F.col("leaf") == F.col("of")).drop("of")
    return members, links, extra


def near_vectors(table: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table (vec_id, embedding)."""
    given = table.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    given = staged(given.mapInArrow(_units, "rid long, vec_id long, unit binary"))
    members, links, extra = cover_tree_links(given.where("unit is not null").select("rid", "unit"), cosine, sample, piece, block)
    members = staged(members.withColumnRenamed("rid", "of"))
    by_leaf = links.select(F.col("a").alias("leaf"), F.col("size_b").alias("n")).union(links.select("b", "size_a")).groupBy("leaf").agg(F.sum("n").alias("leaf_links"))
    by_row = extra.groupBy("rid").agg(F.sum("n").alias("row_links"))
    edges = links.select("a", "b").union(extra.select("a", "b"))
    named = components(edges).withColumnsRenamed({"id": "leaf"})
    found = members.join(staged(by_leaf), "leaf", "left").join(staged(named), "leaf", "left").withColumn("component", F.coalesce("component", "leaf"))
    rows = given.select("rid", "vec_id").join(staged(found), F.col("rid") == F.col("of"), "left").join(staged(by_row), "rid", "left")
    zero = F.lit(0).cast("long")
    rows = staged(rows.select("vec_id", "rid", "component", (F.coalesce(F.col("size") - 1, zero) + F.coalesce("leaf_links", zero) + F.coalesce("row_links", zero)).alias("n_links")))
    first = staged(rows.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("component_id")).withColumnRenamed("component", "c"))
    out = rows.join(first, F.col("component") == F.col("c"), "left")
    out = out.select("vec_id", "n_links", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r(id, reach) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a
), c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.id LEFT JOIN n ON e.vec_id = n.a
"""
