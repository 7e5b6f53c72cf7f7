"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Two collections of ``s`` short MinHash tuples are computed per document.  Every pair of one tuple from each is a
key of one of ``s * s`` tables, so ``2 * s * t`` minima give ``s * s`` tables of ``2 * t`` minima each.  A key can
only be shared where both halves are shared, so halves that occur once are dropped before pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .tables import Scratch, bounded_batches, free, load

_U = np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its word shingles."""
    starts, ends, word_lo = W.find_words(data, offs, W.NOT_SPACE)
    hashes = W.hash_words(data, starts, ends, fold=True)
    joined = W.combine(hashes, size)
    for a, b in zip(word_lo[:-1].tolist(), word_lo[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(joined[a : b - size + 1])
        elif b > a:
            yield W.combine(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` minima of each non-empty set, one row per set."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), count), np.uint64)
    rng = np.random.default_rng(7919)
    with np.errstate(over="ignore"):
        for k in range(count):
            xor, odd = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
            values = (flat ^ xor) * (odd * _U(2) + _U(1))
            values ^= values >> _U(29)
            out[:, k] = np.minimum.reduceat(values, begins)
    return out


#: Words of 64 bits that hold the parities of a set.
PARITY = 8
SIGNED = "doc_id long, n long, set_lo long, set_hi long, keys array<long>, parity array<long>"


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, as PARITY words: whether the shingles that fall on each of 64 * PARITY places are odd in number.

    The places where two sets differ are at most as many as the shingles that only one of them has.
    """
    out = np.zeros((len(sets), PARITY), np.int64)
    width = 64 * PARITY
    for lo in range(0, len(sets), 2048):
        part = sets[lo : lo + 2048]
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        place = (np.concatenate(part) >> _U(40)).astype(np.int64) % width
        odd = (np.bincount(row * width + place, minlength=len(part) * width) & 1).astype(np.uint8)
        out[lo : lo + 2048] = np.packbits(odd.reshape(len(part), width), axis=1).view(np.int64)
    return out


def _sign(batches: Iterator[pa.RecordBatch], size: int, tuples: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of SIGNED: set sizes and digests, the keys of both collections of minima, parities."""
    salt = np.array([W.factor(1000 + t) for t in range(2 * tuples)], np.uint64)
    for batch in batches:
        flat, offs = W.text_buffers(batch.column(1))
        for lo, hi in W.chunks(offs):
            sets = list(shingle_sets(flat[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size))
            n = np.array([len(x) for x in sets], np.int64)
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            ids = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            full = np.flatnonzero(n)
            keys = np.zeros((len(sets), 2 * tuples), np.int64)
            if len(full):
                low = _minima([sets[i] for i in full], 2 * tuples * width).reshape(len(full), 2 * tuples, width)
                with np.errstate(over="ignore"):
                    own = np.tile(salt, (len(full), 1))
                    for j in range(width):
                        own += low[:, :, j] * W.factor(j)
                keys[full] = W.mix(own).view(np.int64)
            sized = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(ids[:, 0]), pa.array(ids[:, 1]), sized(keys), sized(parities(sets))],
                names=["doc_id", "n", "set_lo", "set_hi", "keys", "parity"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offs = W.text_buffers(batch.column(1))
        for lo, hi in W.chunks(offs):
            sets = list(shingle_sets(flat[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size))
            begins = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = pa.array(np.concatenate(sets).view(np.int64))
            ids = [int.from_bytes(xxhash.xxh3_128_digest(x.tobytes())[:8], "little", signed=True) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(begins, values)], names=["c", "shingles"])


def _differ(x: str, y: str) -> F.Column:
    """The number of places at which the parities in columns ``x0, x1, ...`` and ``y0, y1, ...`` differ."""
    return sum((F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(1, PARITY)), F.bit_count(F.col(f"{x}0").bitwiseXOR(F.col(f"{y}0"))))


def _may_link(n1: str, x: str, n2: str, y: str, percent: int) -> F.Column:
    """Whether sizes and parities allow a similarity of ``percent``: at most (1 - p) / (1 + p) of all shingles may differ."""
    least = F.greatest(F.abs(F.col(n1) - F.col(n2)), _differ(x, y))
    return (100 + percent) * least <= (100 - percent) * (F.col(n1) + F.col(n2))


def _named(nodes: DataFrame, c: str, n: str, x: str, *more: F.Column) -> DataFrame:
    """``nodes`` with its columns named anew for one side of a pair."""
    return nodes.select(F.col("c").alias(c), F.col("n").alias(n), *[F.col(f"p{i}").alias(f"{x}{i}") for i in range(PARITY)], *more)


#: Up to so many ids (of 8 bytes) are broadcast to pick texts and sets; for more, both sides are shuffled.
FEW = 500_000


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(c, d)``, a written table, whose full sets are similar enough."""
    used = pairs.select("c").unionByName(pairs.select(F.col("d").alias("c"))).distinct()
    if used.count() <= FEW:
        sets = sets.join(F.broadcast(used), "c", "left_semi")
    met = pairs.join(sets.select("c", F.col("shingles").alias("x")), "c").join(sets.select(F.col("c").alias("d"), F.col("shingles").alias("y")), "d")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    percent: int = 80,
    tuples: int = 12,
    width: int = 2,
    star_rounds: int = 2,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents``.

    Words are runs of characters other than white space with A-Z lower-cased; a document's set holds its distinct
    shingles of ``shingle`` words, or its whole word sequence if that is shorter.  Documents whose sets have a
    Jaccard similarity of at least ``percent`` % are linked.  With the defaults a pair at 80 % misses every table
    with probability 1 - (1 - 0.36**12)**2 < 0.00001.

    Equal sets first become one class, named by its smallest document, so copies are never paired.  In up to
    ``star_rounds`` rounds every class is compared with the closest of the hubs of its table buckets; what is still
    apart is then compared pair by pair, so no candidate link between different components is skipped.  Pairs are
    left out before their sets are read only where sizes and parities prove them too different.  Equality of 64-bit
    hashes stands for equality of shingles and, among candidates, of sets.

    Null or empty text: an empty set, linked with nothing, kept.  Rows of one doc_id are one document that any of
    its texts can link.  A null doc_id cannot name a component: its row joins a class of equal sets, else
    component_id is null; a row is kept if doc_id and component_id are equal or both null.  Texts of any length are
    read whole, each in memory on its own.  Repeated rows count as one document each time; ties go to the smallest
    doc_id.  Empty tables give no rows; other columns are not read, whatever their names.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    signed = scratch.keep(rows.mapInArrow(partial(_sign, size=shingle, tuples=tuples, width=width), SIGNED))
    classes = signed.where("n > 0").groupBy("set_lo", "set_hi").agg(
        F.min("doc_id").alias("node"), *[F.any_value(k).alias(k) for k in ("n", "keys", "parity")]
    )
    spelt = [F.col("parity")[i].alias(f"p{i}") for i in range(PARITY)]
    classes = scratch.keep(classes.where("node is not null").select(F.col("set_lo").alias("c"), "set_hi", "node", "n", "keys", *spelt))
    free(spark)
    # A table key can only be shared where both halves are.
    pieces = classes.select("c", F.posexplode("keys").alias("t", "key"))
    shared = pieces.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    halves = pieces.join(shared, "key").groupBy("c").agg(
        F.collect_list(F.when(F.col("t") < tuples, F.col("key"))).alias("us"), F.collect_list(F.when(F.col("t") >= tuples, F.col("key"))).alias("vs")
    )
    tables = halves.select("c", F.explode("us").alias("u"), "vs").select("c", "u", F.explode("vs").alias("v")).select(F.xxhash64("u", "v").alias("bucket"), "c")
    alive = tables.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    entries = tables.join(alive, "bucket").groupBy("c").agg(F.collect_set("bucket").alias("buckets"))
    nodes = scratch.keep(entries.join(classes.select("c", "node", "n", "keys", *[f"p{i}" for i in range(PARITY)]), "c"))
    free(spark)
    wanted = nodes.select(F.col("node").alias("doc_id")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    sets = rows.join(wanted, "doc_id", "left_semi").mapInArrow(partial(_sets, size=shingle), "c long, shingles array<long>")
    sets = scratch.keep(sets.join(nodes.select("c"), "c", "left_semi").dropDuplicates(["c"]))
    free(spark)

    links, label = [], None
    for turn in range(star_rounds):
        live = _labelled(nodes, label)
        pairs = scratch.keep(_stars(live, turn, percent))
        links.append(scratch.keep(_linked(pairs, sets, percent), pairs))
        free(spark)
        if turn + 1 < star_rounds:
            label = scratch.keep(_nearer(live.select("node", F.col("label").alias("component")).distinct(), links[-1]), label)
    if links:
        label = scratch.keep(connected_components(reduce(DataFrame.unionByName, links), scratch=scratch), label, *links)
        free(spark)
    pairs = scratch.keep(_rest(_labelled(nodes, label), tuples, percent))
    found = scratch.keep(_linked(pairs, sets, percent), pairs, sets)
    free(spark)
    # Links that are left join whole components.
    label = nodes.select("node", F.col("node").alias("component")).distinct() if label is None else label
    of = lambda side: label.select(F.col("node").alias(side), F.col("component").alias(f"{side}_component"))
    joined = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = joined.select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    above = connected_components(joined, scratch=scratch).select(F.col("node").alias("component"), F.col("component").alias("least"))
    above = scratch.keep(above, found)
    free(spark)
    every = nodes.select("node").distinct().join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    label = scratch.keep(every.join(above, "component", "left").select("node", F.coalesce("least", "component").alias("component")), label, nodes)

    class_of = classes.join(label, "node", "left").select(F.col("c").alias("set_lo"), "set_hi", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n", "set_lo", "set_hi").join(class_of, ["set_lo", "set_hi"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _labelled(nodes: DataFrame, label: DataFrame | None) -> DataFrame:
    """``nodes`` with the label of their component so far."""
    if label is None:
        return nodes.withColumn("label", F.col("node"))
    named = nodes.join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
    return named.select("c", "node", "label", "n", *[f"p{i}" for i in range(PARITY)], "keys", "buckets")


def _nearer(label: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after one round of links: the least of a node's and its partners' labels, then that label's own label.

    Nodes of one label are connected, though connected nodes need not have one label yet.
    """
    both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beside = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
    once = label.join(beside, "node", "left").select("node", F.least("component", "least").alias("component"))
    up = once.select(F.col("node").alias("component"), F.col("component").alias("least"))
    return once.join(up, "component", "left").select("node", F.least("component", "least").alias("component"))


def _stars(live: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each class and the closest hub, in this turn's order, of its buckets with several components."""
    placed = live.select(F.explode("buckets").alias("bucket"), "c", "label")
    rank = F.xxhash64("c", F.lit(turn)) if turn else F.col("label")
    hubs = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(rank.alias("rank"), "c", "label")).alias("hub"))
    hubs = hubs.where("lo < hi").select("bucket", F.col("hub.c").alias("d"), F.col("hub.label").alias("hub_label"))
    met = placed.join(hubs, "bucket").where("label <> hub_label").select("c", "d").distinct()
    both = met.join(_named(live, "c", "n1", "x", F.col("node").alias("a")), "c").join(_named(live, "d", "n2", "y", F.col("node").alias("b")), "d")
    both = both.where(_may_link("n1", "x", "n2", "y", percent))
    best = F.min(F.struct(_differ("x", "y").alias("by"), "d", "a", "b"))
    return both.groupBy("c").agg(best.alias("best")).select("c", "best.d", "best.a", "best.b")


def _rest(live: DataFrame, tuples: int, percent: int) -> DataFrame:
    """All pairs of one bucket but different components that may link, each in the first table that holds both.

    The largest component of a bucket is not paired with itself.
    """
    placed = live.select(F.explode("buckets").alias("bucket"), "c", "label")
    counted = placed.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    major = counted.groupBy("bucket").agg(F.max(F.struct("size", "label"))["label"].alias("major"), F.count("*").alias("labels"))
    mixed = placed.join(major.where("labels > 1").select("bucket", "major"), "bucket")
    side = lambda c, n, x, a, l, k: _named(live, c, n, x, F.col("node").alias(a), F.col("keys").alias(k), F.col("label").alias(l))
    minor = mixed.where("label <> major").select("bucket", "c", "major").join(side("c", "n1", "x", "a", "l1", "k1"), "c")
    every = mixed.select("bucket", F.col("c").alias("d")).join(side("d", "n2", "y", "b", "l2", "k2"), "d")
    pairs = minor.join(every, "bucket").where("l1 <> l2 and (l2 = major or c < d)").where(_may_link("n1", "x", "n2", "y", percent))
    same = lambda lo: F.element_at(F.array_intersect(F.slice("k1", lo, tuples), F.slice("k2", lo, tuples)), 1)
    return pairs.where(F.xxhash64(same(1), same(tuples + 1)) == F.col("bucket")).select("c", "d", "a", "b")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on four-word shingles."""
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=4, percent=80)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk(node, seen) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.a, walk.seen FROM walk JOIN edge e ON e.b = walk.node WHERE walk.seen < e.a),
c AS (SELECT node, min(seen) AS component FROM walk GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component AS component_id, d.doc_id = c.component AS kept
FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n USING (doc_id)
"""
