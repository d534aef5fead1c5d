"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors are one node with a count. A table hashes a node with ``k`` functions: each rotates the vector by three rounds
of random signs and a fast Hadamard transform and takes the signed axis nearest to it; the bucket is the tuple of axes.
A node lives in its own bucket of each table and visits its ``probes`` next likely ones, where its best axis is given up for the
runner-up that costs least. Each visited pair is verified by its cosine in double precision. ``k`` follows the number of
nodes, so that a bucket holds about ``ROOM`` of them by chance; the number of tables follows from the share of pairs at
exactly the threshold that one table finds (simulated on random pairs of the same dimension, not on the data) and the
``recall`` asked for. Pairs above the threshold are found more often.

Nothing is collected: a bucket of more than ``ROOM`` nodes (found by counting buckets first) is split into tiles, each
visited by the others; a task holds one tile and streams its visitors. A pair that meets several times counts only at its
first meeting, which tasks tell from the two vectors alone, as codes are recomputed; so a tile sends sums of links and
a spanning forest, never its pairs. Tables are processed one after another, each written out, which bounds the disk.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths are
never compared. Rows of equal vectors are linked with each other. Null ids have links, but are no component's smallest id
(a component of such rows alone has null). Empty table: empty result. Other columns pass through; ``n_links
component_id kept`` of the input are replaced.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import packed
from .store import bounded, materialize, small, whole_id

COSINE, RECALL, PROBES = 0.9, 0.995, 2
#: Nodes of a bucket by chance, and of a tile.
ROOM = 2048
_ROW = "bucket long, dim int, visits boolean, node long, n long, vec binary"
_FOUND = "x long, y long, links long"


def _padded(dim: int) -> int:
    return 1 << max(0, dim - 1).bit_length()


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their (power of two) length."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


@lru_cache(maxsize=256)
def _signs(table: int, function: int, size: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([20240311, table, function, size])).choice(np.array([-1.0, 1.0]), (3, size))


def codes(unit: np.ndarray, table: int, k: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each unit vector in a table, and the buckets it visits (n x probes)."""
    size = _padded(unit.shape[1])
    padded = np.zeros((len(unit), size))
    padded[:, : unit.shape[1]] = unit
    width, top = 2 * size, min(probes + 1, size)
    best, others, loss = np.zeros(len(unit), np.int64), [], []
    for j in range(k):
        y = padded
        for signs in _signs(table, j, size):
            y = hadamard(y * signs) / math.sqrt(size)
        order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :top]
        value = np.take_along_axis(y, order, axis=1)
        axis = (2 * order + (value < 0)).astype(np.int64)
        best += axis[:, 0] * width**j
        others.append((axis[:, 1:] - axis[:, :1]) * width**j)
        loss.append(np.abs(value[:, :1]) - np.abs(value[:, 1:]))
    moved, cost = np.concatenate(others, axis=1), np.concatenate(loss, axis=1)
    pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return best, best[:, None] + np.take_along_axis(moved, pick, axis=1)


def meets(base_a, probes_a, base_b, probes_b) -> np.ndarray:
    """Whether two nodes meet in a table: they live together, or one visits the other."""
    return (base_a == base_b) | (probes_a == base_b[:, None]).any(axis=1) | (probes_b == base_a[:, None]).any(axis=1)


@lru_cache(maxsize=64)
def tables_for(dim: int, k: int, cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES) -> int:
    """Tables that find a pair at the threshold with probability ``recall``, by simulation on random pairs."""
    rng, hits, pairs = np.random.Generator(np.random.PCG64(7)), 0, max(100, min(1000, 500_000 // dim))
    for trial in range(4):
        a, b = rng.normal(size=(2, pairs, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        c = cosine * a + math.sqrt(1 - cosine * cosine) * b if dim > 1 else a
        hits += meets(*codes(a, 1_000_000 + trial, k, probes), *codes(c, 1_000_000 + trial, k, probes)).sum()
    found = min(max((hits - math.sqrt(hits)) / (4 * pairs), 1e-3), 1 - 1e-9)  # on the safe side of the simulation's noise
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # components of any size
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(batches):
    """The last column, an array, as raw doubles or floats."""
    for b in batches:
        col = b.column(b.num_columns - 1)
        offsets = np.asarray(col.offsets, np.int64)
        values = np.asarray(col.values)[offsets[0] : offsets[-1]] if len(col) else np.empty(0)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed(values, offsets - offsets[0])], [*b.schema.names[:-1], "vec"])


def _matrices(vec: pa.Array, dtype):
    """(rows, matrix) for each length of vectors in a column."""
    offsets = np.frombuffer(vec.buffers()[1], np.int64 if pa.types.is_large_binary(vec.type) else np.int32)[vec.offset : vec.offset + len(vec) + 1].astype(np.int64)
    data, size = np.frombuffer(vec.buffers()[2], np.uint8), np.diff(offsets)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        raw = data[offsets[rows][:, None] + np.arange(length)]
        yield rows, np.ascontiguousarray(raw).view(dtype)


def _own_buckets(tables: int, k: int, probes: int, dtype):
    """(tab, bucket, dim) of every node in every table."""

    def run(batches):
        for b in batches:
            for rows, x in _matrices(b.column("vec"), dtype) if b.num_rows else ():
                unit = _unit(x)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(codes(unit, t, k, probes)[0]), pa.array(np.full(len(rows), x.shape[1], np.int32))], ["tab", "bucket", "dim"])

    return run


def _placed(table: int, k: int, probes: int, dtype):
    """Every node in its own bucket and in those that it visits."""

    def run(batches):
        for b in batches:
            for rows, x in _matrices(b.column("vec"), dtype) if b.num_rows else ():
                home, away = codes(_unit(x), table, k, probes)
                here = b.take(pa.array(rows))
                for i, bucket in enumerate([home, *away.T]):
                    flat = [pa.array(np.ascontiguousarray(bucket)), pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(np.full(len(rows), i > 0))]
                    yield pa.RecordBatch.from_arrays([*flat, here.column("node"), here.column("n"), here.column("vec")], ["bucket", "dim", "visits", "node", "n", "vec"])

    return run


class _Side:
    """Nodes on one side of a comparison; codes of earlier tables are made when first needed."""

    def __init__(self, node, n, unit, k, probes):
        self.node, self.n, self.unit, self.k, self.probes, self.known = node, n, unit, k, probes, {}

    def codes(self, table: int):
        if table not in self.known:
            self.known[table] = codes(self.unit, table, self.k, self.probes)
        return self.known[table]


class _Tile:
    """The nodes of a tile; compares them with each other and with visitors. ``label``: who is connected in this tile."""

    def __init__(self, table: int, cosine: float, home: _Side):
        self.table, self.cosine, self.home, self.label = table, cosine, home, np.arange(len(home.node))

    def _first(self, i, j, other: _Side, away: bool) -> np.ndarray:
        """Which of the pairs meet here for the first time."""
        keep = np.ones(len(i), bool)
        for t in range(self.table):
            (ba, pa_), (bb, pb) = self.home.codes(t), other.codes(t)
            keep &= ~meets(ba[i], pa_[i], bb[j], pb[j])
        if away:  # the home node may visit the visitor as well: the smaller node's visit counts
            (_, mine), (theirs, _) = self.home.codes(self.table), other.codes(self.table)
            keep &= ~((mine[i] == theirs[j][:, None]).any(axis=1) & (other.node[j] > self.home.node[i]))
        return keep

    def compare(self, other: _Side, away: bool):
        """Sums of links and edges: (x, y or None, links)."""
        own, step = other is self.home, ROOM
        for lo in range(0, len(other.node), step):
            near = self.home.unit @ other.unit[lo : lo + step].T >= self.cosine
            if own:
                near = np.triu(near, 1 - lo)
            j, i = np.nonzero(near.T)
            j = j + lo
            if not len(i):
                continue
            keep = self._first(i, j, other, away)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            links = np.zeros(len(self.home.node), np.int64), np.zeros(len(other.node), np.int64)
            np.add.at(links[0], i, other.n[j])
            np.add.at(links[1], j, self.home.n[i])
            for side, sums in zip((self.home, other), links):
                at = np.flatnonzero(sums)
                yield side.node[at], None, sums[at]
            yield self._edges(i, j, other, own)

    def _edges(self, i, j, other: _Side, own: bool):
        x, y = [], []
        bounds = [0, *(np.flatnonzero(j[1:] != j[:-1]) + 1).tolist(), len(j)]
        for lo, hi in zip(bounds, bounds[1:]):
            roots = np.unique(self.label[np.append(i[lo:hi], j[lo])] if own else self.label[i[lo:hi]])
            ends = self.home.node[roots]
            x += [int(ends[0] if own else other.node[j[lo]])] * (len(roots) - own)
            y += ends[own:].tolist()
            if len(roots) > 1:
                self.label[np.isin(self.label, roots[1:])] = roots[0]
        return np.array(x, np.int64), np.array(y, np.int64), None


def _compared(table: int, k: int, probes: int, cosine: float, dtype):
    """Rows sorted by (bucket, dim, tile, kind): nodes of a tile (kind 0), then those of earlier tiles (1) and visitors (2)."""

    def sends(found):
        for x, y, links in found:
            n = len(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.nulls(n, pa.int64()) if y is None else pa.array(y, pa.int64()), pa.nulls(n, pa.int64()) if links is None else pa.array(links, pa.int64())], ["x", "y", "links"])

    def side(parts):
        node, n = (np.concatenate([np.asarray(p.column(c)) for p in parts]) for c in ("node", "n"))
        units = [np.concatenate([_unit(m) for _, m in _matrices(p.column("vec"), dtype)]) for p in parts]
        return _Side(node, n, np.concatenate(units), k, probes)

    def run(batches):
        key, held, tile = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([np.asarray(b.column(c), np.int64) for c in ("bucket", "dim", "tile", "kind")])
            edge = np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows]):
                now, kind, part = tuple(cols[:3, lo]), cols[3, lo], b.slice(lo, hi - lo)
                if now != key or kind:
                    if held:
                        tile = _Tile(table, cosine, side(held))
                        yield from sends(tile.compare(tile.home, False))
                        held = []
                if now != key:
                    key, tile = now, None
                if kind == 0:
                    held.append(part)
                elif tile is not None:
                    yield from sends(tile.compare(side([part]), kind == 2))
        if held:
            tile = _Tile(table, cosine, side(held))
            yield from sends(tile.compare(tile.home, False))

    return run


def near_links(nodes: DataFrame, cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES, room: int = ROOM, k: int | None = None) -> DataFrame:
    """(x, y, links) from a written table of distinct nodes (node, n, vec): sums of links of x (y null), or an edge x - y of
    a spanning forest of each tile."""
    dtype = np.float32 if dict(nodes.dtypes).get("real") == "float" else np.float64
    count, width = nodes.agg(F.count(F.lit(1)), F.max(F.octet_length("vec"))).first()
    dim = max(1, (width or 0) // np.dtype(dtype).itemsize)
    bits = 1 + _padded(dim).bit_length() - 1
    k = k or min(62 // bits, max(1, math.ceil(math.log(max(1, count / room)) / (bits * math.log(2)))))
    tables = tables_for(dim, k, cosine, recall, probes)
    nodes = bounded(nodes.select("node", "n", "vec"))
    sizes = nodes.select("vec").mapInArrow(_own_buckets(tables, k, probes, dtype), "tab int, bucket long, dim int").groupBy("tab", "bucket", "dim").agg(F.count(F.lit(1)).alias("size"))
    heavy = materialize(sizes.where(F.col("size") > room).select("tab", "bucket", "dim", F.ceil(F.col("size") / room).cast("int").alias("tiles")))
    few = small(heavy)
    found = None
    for t in range(tables):
        rows = nodes.mapInArrow(_placed(t, k, probes, dtype), _ROW).join(few.where(F.col("tab") == t).drop("tab"), ["bucket", "dim"], "left")
        last, own = F.coalesce("tiles", F.lit(1)) - 1, F.pmod(F.xxhash64("node"), F.coalesce("tiles", F.lit(1))).cast("int")
        rows = rows.withColumn("own", F.when(F.col("visits"), F.lit(0)).otherwise(own)).withColumn("tile", F.explode(F.sequence(F.col("own"), last)))
        rows = rows.select("bucket", "dim", "tile", F.when(F.col("visits"), F.lit(2)).when(F.col("tile") == F.col("own"), F.lit(0)).otherwise(F.lit(1)).alias("kind"), "node", "n", "vec")
        dealt = rows.repartition("bucket", "dim", "tile").sortWithinPartitions("bucket", "dim", "tile", "kind")
        here = materialize(dealt.mapInArrow(_compared(t, k, probes, cosine, dtype), _FOUND))
        found = here if found is None else found.unionByName(here)
    return found


def _valid(name: str):
    good = F.forall(name, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.col(name).isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(name, lambda x: x != 0), F.lit(False))


def dedup(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES, room: int = ROOM, k: int | None = None) -> DataFrame:
    """All rows with n_links, component_id and kept."""
    vectors = vectors.drop("n_links", "component_id", "kept")
    if not dict(vectors.dtypes)["embedding"].startswith(("array<float>", "array<double>")):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    real = dict(vectors.dtypes)["embedding"][6:-1]
    key = [F.when(_valid("embedding"), F.xxhash64(*seed, "embedding")).alias(f"__h{i}") for i, seed in enumerate(([], [F.lit(77)]))]
    met = vectors.select(whole_id("vec_id"), "embedding", *key).where("__h0 IS NOT NULL").groupBy("__h0", "__h1").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.any_value("embedding").alias("embedding"))
    met = bounded(met).mapInArrow(_pack, "__h0 long, __h1 long, n long, least long, vec binary")
    nodes = materialize(met.select("*", F.monotonically_increasing_id().alias("node"), F.lit(0).cast(real).alias("real")))
    found = near_links(nodes, cosine, recall, probes, room, k)
    links = found.where("y IS NULL").groupBy(F.col("x").alias("node")).agg(F.sum("links").alias("links"))
    labels = components(found.where("y IS NOT NULL").select("x", "y"))
    about = nodes.drop("vec", "real").join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    about = materialize(about)
    least = about.groupBy("label").agg(F.min("least").alias("component_id"))
    about = about.join(least, "label").select("__h0", "__h1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    alone = F.col("n_links").isNull()
    out = vectors.select("*", *key).join(about, ["__h0", "__h1"], "left").drop("__h0", "__h1")
    out = out.withColumn("component_id", F.when(alone, whole_id("vec_id")).otherwise(F.col("component_id"))).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    return out.withColumn("kept", whole_id("vec_id").eqNullSafe(F.col("component_id")))


def op12_embedding_dedup(spark, sf_dir):
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")
