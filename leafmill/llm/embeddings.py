"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations of the principal axes are learnt so that the signs of a vector's coordinates form balanced binary codes.
The codes are cut into substrings, each the key of one table; vectors that share a key are compared by their
original components.  Tables are as many as a pair at the threshold needs to share one with probability ``recall``,
by the angle of such a pair and by pairs made from the sample, as centring widens angles where vectors share a direction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .tables import bounded_batches, cut, load


@dataclass
class Codes:
    """Projections to code bits, ``bits`` columns for each of ``tables`` tables."""

    mean: np.ndarray
    project: np.ndarray
    bits: int
    tables: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Table keys of unit vectors, one row each, a few million signs at a time."""
        out = np.zeros((len(x), self.tables), np.int64)
        step = max(1, (1 << 22) // self.project.shape[1])
        for lo in range(0, len(x), step):
            signs = (x[lo : lo + step] - self.mean) @ self.project > 0
            out[lo : lo + step] = signs.reshape(len(signs), self.tables, self.bits) @ (1 << np.arange(self.bits, dtype=np.int64))
        return out


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: the rotation that brings the rows of ``x`` closest to the corners of a cube."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        corners = np.where(x @ rotation > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(x.T @ corners)
        rotation = left @ right
    return rotation


def plan_tables(rows: int, cosine: float, recall: float, bucket: int = 16) -> tuple[int, int]:
    """Bits of a key so that a bucket holds about ``bucket`` of ``rows`` vectors, and the tables that ``recall`` needs."""
    bits = int(min(30, max(4, math.ceil(math.log2(max(rows, 2) / bucket)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


#: Where centred codes need more than so many times the tables of the plan, random ones through the origin are taken.
WIDENED = 8


def threshold_pairs(x: np.ndarray, cosine: float, seed: int, most: int = 4000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to ``most`` unit vectors of ``x`` and partners at ``cosine``: moved in any direction, and as ``x`` itself varies."""
    rng = np.random.default_rng(seed)
    a = x[rng.permutation(len(x))[:most]]
    out = []
    for move in (rng.standard_normal(a.shape), x[rng.integers(len(x), size=len(a))] - x[rng.integers(len(x), size=len(a))]):
        move = move - (move * a).sum(axis=1, keepdims=True) * a
        size = np.linalg.norm(move, axis=1, keepdims=True)
        some = size[:, 0] > 1e-6
        if some.any():
            out.append((a[some], cosine * a[some] + math.sqrt(1 - cosine**2) * move[some] / size[some]))
    return out


def found_share(codes: Codes, pairs: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Share of pairs that have a key in common, the least of the kinds of pairs."""
    return min([float((codes.keys(a) == codes.keys(b)).any(axis=1).mean()) for a, b in pairs], default=1.0)


def unit(batch: np.ndarray) -> np.ndarray:
    return batch / np.linalg.norm(batch, axis=1, keepdims=True)


def fit(vectors: DataFrame, rows: int, cosine: float, recall: float, sample: int = 20_000, seed: int = 5) -> Codes | None:
    """Codes learnt from about ``sample`` of the ``rows`` vectors (a documented bound, chosen by a hash of the vector)."""
    draw = F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample / max(rows, 1)) * (1 << 30))
    got = vectors.where(draw).select("vector").toArrow().column(0).combine_chunks()
    if not len(got):
        got = vectors.limit(1).select("vector").toArrow().column(0).combine_chunks()
    x = np.array(got.to_pylist(), float)
    if not len(x):
        return None
    x = unit(x)
    bits, tables = plan_tables(rows, cosine, recall)
    mean = x.mean(axis=0)
    axes = np.linalg.svd(x - mean, full_matrices=True)[2].T if len(x) <= x.shape[1] else np.linalg.eigh(np.cov((x - mean).T))[1][:, ::-1]
    pairs = threshold_pairs(x, cosine, seed)
    centred = _grow(lambda turn: axes @ learn_rotation((x - mean) @ axes, seed + turn), mean, bits, tables, pairs, recall, WIDENED * tables)
    if centred is not None:
        return centred
    width = x.shape[1]
    return _grow(lambda turn: np.linalg.qr(np.random.default_rng(seed + turn).standard_normal((width, width)))[0], np.zeros(width), bits, tables, pairs, recall)


def _grow(rotate, mean: np.ndarray, bits: int, tables: int, pairs: list, recall: float, most: int | None = None) -> Codes | None:
    """Codes of ``tables`` tables and as many more as it takes to find ``recall`` of the pairs; none if more than ``most``."""
    width = len(mean)
    per_rotation = max(1, width // bits)
    project: list[np.ndarray] = []
    while True:
        while sum(p.shape[1] for p in project) < bits * tables:
            rotation = rotate(len(project))
            project.append(rotation[:, : per_rotation * bits] if width >= bits else np.tile(rotation, (1, -(-bits // width)))[:, :bits])
        codes = Codes(mean, np.concatenate(project, axis=1)[:, : bits * tables], bits, tables)
        if found_share(codes, pairs) >= recall:
            return codes
        tables += max(1, tables // 8)
        if most is not None and tables > most:
            return None


def _vectors(batch: pa.RecordBatch, at: int) -> np.ndarray:
    lists = batch.column(at)
    return lists.flatten().to_numpy().reshape(len(batch), -1).astype(float) if len(batch) else np.zeros((0, 0))


def compare_groups(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, block: np.ndarray, table: int, codes: Codes, cosine: float):
    """Links of one group: summed weights of each member's new partners, and each member's local component.

    A pair counts in the first table that holds both, and there in the group of its two blocks.
    """
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    near &= ids[:, None] != ids[None, :]
    if block.min() != block.max():
        near &= block[:, None] != block[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return None
    member = np.unique(a)
    keys = np.zeros((len(ids), codes.tables), np.int64)
    keys[member] = codes.keys(x[member])
    first = np.empty(len(a), np.int64)
    step = min(50_000, max(1, 2_500_000 // codes.tables))
    for lo in range(0, len(a), step):
        part = slice(lo, lo + step)
        first[part] = (keys[a[part]] == keys[b[part]]).argmax(axis=1)
    new = first == table
    links = np.bincount(a[new], weights=weight[b[new]], minlength=len(ids)).astype(np.int64)
    label = ids.copy()
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        if (least == label).all():
            break
        label = least
    return member, links[member], label[member]


def _compare(batches: Iterator[pa.RecordBatch], codes: Codes, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (group, table, block, node, weight, vector), sorted by group: links and local components of members."""
    held: list[pa.RecordBatch] = []

    def finish(rows: pa.Table) -> pa.RecordBatch:
        batch = rows.combine_chunks().to_batches()[0]
        group, table, block, node, weight = (batch.column(i).to_numpy() for i in range(5))
        x = unit(_vectors(batch, 5))
        cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
        out: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo > 1 and (found := compare_groups(node[lo:hi], x[lo:hi], weight[lo:hi], block[lo:hi], table[lo], codes, cosine)):
                member, links, label = found
                for column, value in zip(out, (node[lo:hi][member], links, label), strict=True):
                    column.append(value)
        flat = [pa.array(np.concatenate([*c, np.zeros(0, np.int64)])) for c in out]
        return pa.RecordBatch.from_arrays(flat, names=["node", "links", "near"])

    for batch in batches:
        if not len(batch):
            continue
        group = batch.column(0).to_numpy()
        last = int(np.searchsorted(group, group[-1]))
        if last or (held and held[-1].column(0)[-1].as_py() != group[0]):
            yield finish(pa.Table.from_batches([*held, batch.slice(0, last)])) if last else finish(pa.Table.from_batches(held))
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield finish(pa.Table.from_batches(held))


#: Members of a table bucket that are compared in one group.
BLOCK = 512


def near_vectors(
    embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, recall: float = 0.99, sample: int = 20_000
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Two vectors are linked if their cosine in double precision is at least ``cosine`` and they share a table key;
    every row is indexed.  Equal vectors first become one class with a weight, so copies are never paired.  A bucket
    of more than ``BLOCK`` classes is cut into blocks by a hash and every pair of blocks is a group of its own, so no
    task holds more than two blocks of a bucket at once and no pair is left out; pairs are counted where they are
    found and only sums and local components leave the group.

    Vectors that are null, empty, zero, or hold null or non-finite components, rows with a null id, and vectors whose
    length is not the most frequent one, link with nothing: n_links 0, component_id their own id (null for a null
    id), kept.  Rows of one id are counted as vectors of their own and share a component.  Empty tables give no rows;
    other columns are not read.
    """
    bounded_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    good = F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)")
    usable = rows.where("vec_id is not null").where(good)
    sizes = usable.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    fits = good & (F.size("vector") == F.lit(sizes["d"] if sizes else -1))
    classes = cut(usable.where(fits).groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    total = classes.count()
    codes = fit(classes, total, cosine, recall, sample)
    alone = F.col("vec_id").alias("component_id")
    if codes is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone, F.lit(True).alias("kept"))
    shared = embeddings.sparkSession.sparkContext.broadcast(codes)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = shared.value.keys(unit(_vectors(batch, 1)))
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "keys"])

    keyed = classes.select("node", "vector").mapInArrow(key, "node long, keys array<long>").select("node", F.posexplode("keys").alias("table", "key"))
    keyed = cut(keyed)
    crowded = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = crowded.select("table", "key", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    placed = keyed.join(crowded, ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    placed = placed.select("node", "table", "key", "block", other)
    group = F.xxhash64("table", "key", F.least("block", "other"), F.greatest("block", "other"))
    placed = placed.select(group.alias("group"), F.col("table").cast("long").alias("table"), "block", "node")
    full = placed.join(classes, "node").select("group", "table", "block", "node", "weight", "vector")
    dealt = full.repartition("group").sortWithinPartitions("group", "table")
    found = cut(dealt.mapInArrow(lambda it: _compare(it, shared.value, cosine), "node long, links long, near long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = connected_components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    judged = classes.join(links, "node", "left").join(label, "node", "left")
    judged = judged.select("vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    usable_key = F.when(F.col("vec_id").isNotNull() & F.coalesce(fits, F.lit(False)), F.col("vector"))
    out = rows.select("vec_id", usable_key.alias("vector")).join(judged, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings at a cosine of 0.9."""
    return near_vectors(load(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
walk(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, walk.seen FROM walk JOIN link l ON l.a = walk.node WHERE walk.seen < l.b),
c AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component AS component_id, vec_id = component AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
