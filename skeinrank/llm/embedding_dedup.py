"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours, then threshold edges.

The graph starts from blocks of vectors with equal signs of random projections. In each iteration the neighbours of a
vector (both ways) are compared with each other, and every list keeps its best; it ends when hardly a list changes.
A list is saturated when its last neighbour still passes the threshold; saturated vectors are compared across components
too, by balls and a bound of angles, and components that such a link joins become one. All lists of a component are then
enlarged to the whole component, in blocks, so its links are counted exactly. An audit compares a
sample of vectors with all vectors, and the sample grows until it holds enough vectors that truly have links, or all
vectors; while its recall is too low, further projections are added and the lists grow. If it stays too low, the query
fails and says the recall.

Equal vectors are one class from the start, so a vector that fills a third of the table is one vertex.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors are compared
with those of their own dimension, in double precision (doubles are never narrowed); a row with a null id has no links
and a null component; an id that repeats with its vector counts once for each row (one that repeats with other vectors
is not told apart: their links are taken together); an empty table gives an empty result; other columns (labels too) are
not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_dealt, materialize
from .components import connected_components

THRESHOLD = 0.95
NEIGHBOURS, TABLES, BLOCK = 10, 6, 512
ITERATIONS, SETTLED = 6, 0.002
#: The audit's first and largest step, and the classes with links that it looks for.
AUDIT_ROWS, AUDIT_MOST, AUDIT_LINKED = 1024, 8192, 400
AUDIT_RECALL, ROUNDS = 0.99, 6


def unit(rows: list[bytes]) -> np.ndarray:
    """Packed vectors of one dimension as double unit vectors. The first byte says the kind of the numbers after it."""
    kind = np.dtype(KINDS[rows[0][0]]) if rows else np.dtype("<f4")
    x = np.frombuffer(b"".join(r[1:] for r in rows), kind).reshape(len(rows), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


#: Numbers of packed vectors: tables of floats are kept as they are, all others as doubles.
KINDS = {4: "<f4", 8: "<f8"}


def dimension(vec: bytes) -> int:
    return (len(vec) - 1) // vec[0]


def _pack(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec: the packed vector, null where it cannot be compared."""
    size = 4 if dict(vectors.dtypes)[vector_col] == "array<float>" else 8
    head, kind = bytes([size]), KINDS[size]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), kind)
                out.append(head + x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if size == 4 else "array<double>").alias("v")).mapInArrow(run, "vec_id long, vec binary")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each list (v, u, sim, fresh); a neighbour that comes twice counts once, as not fresh if one isn't."""
    once = pairs.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("r") <= k).drop("r")


def _blocks(nodes: DataFrame, count: int, k: int, tables: int, seed: int) -> DataFrame:
    """First lists: the k nearest within each block, and the block's first vector."""
    bits = max(1, int(np.ceil(np.log2(max(2.0, count / (BLOCK / 2))))))

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in vecs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                dim = dimension(vecs[at[0]])
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                signs = (unit([vecs[i] for i in at]) @ planes[dim] > 0).reshape(len(at), tables, bits)
                code = (signs * (1 << np.arange(bits))).sum(2)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(code[:, t].astype(np.int64)), pa.array(ids[at]), pa.array([vecs[i] for i in at], pa.binary())], names=["t", "dim", "code", "v", "vec"])

    dealt = nodes.select("v", "vec").mapInArrow(codes, "t int, dim int, code long, v long, vec binary")
    # A block over the size is dealt out further, differently for each table; the iterations bring its parts together.
    sizes = nodes.select("v", "vec").mapInArrow(codes, "t int, dim int, code long, v long, vec binary").groupBy("t", "dim", "code").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"))
    dealt = dealt.join(sizes, ["t", "dim", "code"]).withColumn("part", F.pmod(F.xxhash64("v", "t", F.lit(seed)), F.col("parts")))

    def near(table: pa.Table) -> pa.Table:
        ids = table.column("v").to_numpy()
        x = unit(table.column("vec").to_pylist())
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        most = min(k, len(ids) - 1)
        if most <= 0:
            return pa.table({"v": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "sim": pa.array([], pa.float64()), "fresh": pa.array([], pa.bool_())})
        top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        hub = int(ids.argmin())
        star = np.flatnonzero((sims[:, hub] >= THRESHOLD) & (np.arange(len(ids)) != hub))
        v = np.concatenate([np.repeat(np.arange(len(ids)), most), star])
        u = np.concatenate([top.ravel(), np.full(len(star), hub)])
        return pa.table({"v": ids[v], "u": ids[u], "sim": sims[v, u], "fresh": np.ones(len(v), bool)})

    return dealt.groupBy("t", "dim", "code", "part").applyInArrow(near, "v long, u long, sim double, fresh boolean")


def _descend(graph: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Candidates from one iteration: the neighbours of each vector, both ways, compared with each other where one of the
    two edges is fresh; pairs that beat a list's last neighbour. Of backward neighbours the k nearest serve."""
    last = graph.groupBy("v").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("last"))
    back = graph.select(F.col("u").alias("v"), F.col("v").alias("u"), "sim", "fresh")
    around = graph.unionByName(_best(back, k)).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
    lively = graph.where("fresh").select("v").unionByName(graph.where("fresh").select(F.col("u").alias("v"))).distinct()
    around = around.join(lively, "v", "left_semi")
    carried = nodes.select(F.col("v").alias("u"), "vec").join(last.withColumnRenamed("v", "u"), "u", "left").withColumn("last", F.coalesce("last", F.lit(-2.0)))
    around = around.join(carried, "u")

    def compare(table: pa.Table) -> pa.Table:
        ids, fresh, last_ = table.column("u").to_numpy(), table.column("fresh").to_numpy(), table.column("last").to_numpy()
        x = unit(table.column("vec").to_pylist())
        sims = x @ x.T
        good = (sims > last_[:, None]) & (fresh[:, None] | fresh[None, :])
        np.fill_diagonal(good, False)
        a, b = np.nonzero(good)
        return pa.table({"v": ids[a], "u": ids[b], "sim": sims[a, b], "fresh": np.ones(len(a), bool)})

    return around.groupBy("v").applyInArrow(compare, "v long, u long, sim double, fresh boolean")


def _cover(rows: DataFrame, threshold: float) -> DataFrame:
    """v, ball, angle, component, vec of rows(v, component, vec): every vector is at or above the threshold to the first
    vector of its ball, a ball lies in one component and has at most about BLOCK vectors."""
    sizes = rows.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))

    def cover(table: pa.Table) -> pa.Table:
        v = table.column("v").to_numpy()
        x = unit(table.column("vec").to_pylist())
        ball, angle, left = np.empty(len(v), np.int64), np.zeros(len(v)), np.arange(len(v))
        while len(left):
            sims = x[left] @ x[left[0]]
            sims[0] = 1.0
            inside = sims >= threshold
            ball[left[inside]], angle[left[inside]] = v[left[0]], np.arccos(np.clip(sims[inside], -1, 1))
            left = left[~inside]
        return pa.table({"v": v, "ball": ball, "angle": angle, "component": table.column("component"), "vec": table.column("vec")})

    return dealt.groupBy("component", "part").applyInArrow(cover, "v long, ball long, angle double, component long, vec binary")


def _joined(comps: DataFrame, graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """comps(v, component) with the components joined that links between saturated vectors connect.

    A vector whose list is not saturated has its links in the list; two saturated ones may be linked outside both lists.
    Saturated vectors are covered by balls. A link between two balls needs their centres' angle within the sum of both
    radii and the threshold's angle, so of the pairs of balls of different components only those are compared member by
    member, and of these only the pairs that the centres' own links have not joined already."""
    full = graph.groupBy("v").agg(F.count("*").alias("listed"), F.min("sim").alias("last")).where((F.col("listed") >= k) & (F.col("last") >= threshold)).select("v")
    members, _ = materialize(_cover(full.join(comps, "v").join(nodes.select("v", "vec"), "v"), threshold), "embedding-balls")
    radii = members.groupBy("ball").agg(F.max("angle").alias("radius"))
    centres = members.where("v = ball").select("ball", "component", "vec").join(radii, "ball")
    blocks = -(-centres.count() // (2 * BLOCK))
    if not blocks:
        return comps
    widest = float(np.arccos(threshold)) + 1e-6  # and a little for rounding

    dealt = centres.withColumn("dim", F.octet_length("vec")).withColumn("own", F.pmod(F.xxhash64("ball"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("dim", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "ball", "component", "vec", "radius")

    def meet(table: pa.Table) -> pa.Table:
        own, ball, component, radius = (table.column(c).to_numpy() for c in ("own", "ball", "component", "radius"))
        lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi"))
        x = unit(table.column("vec").to_pylist())
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        sims = x[left] @ x[right].T
        near = np.arccos(np.clip(sims, -1, 1)) <= radius[left][:, None] + radius[right][None, :] + widest
        near &= component[left][:, None] != component[right][None, :]
        if lo == hi:
            near &= ball[left][:, None] < ball[right][None, :]
        i, j = np.nonzero(near)
        a, b = left[i], right[j]
        return pa.table({"a": ball[a], "b": ball[b], "component_a": component[a], "component_b": component[b], "sim": sims[i, j]})

    pairs, _ = materialize(dealt.groupBy("dim", "lo", "hi").applyInArrow(meet, "a long, b long, component_a long, component_b long, sim double"), "embedding-meetings")
    if pairs.isEmpty():
        return comps
    known = pairs.where(F.col("sim") >= threshold).select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).distinct()
    roots = connected_components(known).select("id", F.col("component").alias("root"))
    root = lambda side: roots.select(F.col("id").alias(f"component_{side}"), F.col("root").alias(f"root_{side}"))
    apart = pairs.join(root("a"), "component_a", "left").join(root("b"), "component_b", "left")
    apart = apart.where(F.coalesce("root_a", "component_a") != F.coalesce("root_b", "component_b")).select("a", "b", "component_a", "component_b")
    one = apart.join(members.select(F.col("ball").alias("a"), "vec"), "a").select("a", "b", "component_a", "component_b", "vec", F.lit(True).alias("first"))
    two = apart.join(members.select(F.col("ball").alias("b"), "vec"), "b").select("a", "b", "component_a", "component_b", "vec", F.lit(False).alias("first"))

    def linked(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy()
        x = unit(table.column("vec").to_pylist())
        hit = (x[first] @ x[~first].T >= threshold).any()
        return pa.table({"a": table.column("component_a")[: int(hit)], "b": table.column("component_b")[: int(hit)]})

    found = one.unionByName(two).groupBy("a", "b").applyInArrow(linked, "a long, b long")
    roots = connected_components(known.unionByName(found)).select(F.col("id").alias("component"), F.col("component").alias("root"))
    return comps.join(roots, "component", "left").select("v", F.coalesce("root", "component").alias("component"))


def _within(comps: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """v, component, n: for each vector the rows of other classes of its component at or above the threshold. Members are compared block by
    block, and only counts leave a block."""
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = comps.join(sizes, "component").join(nodes, "v")
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "v", "vec", "n_rows")

    def count(table: pa.Table) -> pa.Table:
        own_, v, n = (table.column(c).to_numpy() for c in ("own", "v", "n_rows"))
        comp, lo, hi = (table.column(c)[0].as_py() for c in ("component", "lo", "hi"))
        x = unit(table.column("vec").to_pylist())
        if lo == hi:
            hit = x @ x.T >= threshold
            np.fill_diagonal(hit, False)
            got = hit @ n
        else:
            left, right = np.flatnonzero(own_ == lo), np.flatnonzero(own_ == hi)
            hit = x[left] @ x[right].T >= threshold
            got = np.zeros(len(v), np.int64)
            got[left], got[right] = hit @ n[right], n[left] @ hit
        return pa.table({"v": v, "component": np.full(len(v), comp), "n": got.astype(np.int64)})

    return rows.groupBy("component", "lo", "hi").applyInArrow(count, "v long, component long, n long").groupBy("v", "component").agg(F.sum("n").alias("n"))


def _audit(counted: DataFrame, nodes: DataFrame, count: int, threshold: float) -> float:
    """The recall of a sample of classes, compared with all vectors: the share of its links that were counted or, where
    that is less, the mean share over its linked classes (so a few large groups do not hide missed pairs).

    The sample grows until it holds AUDIT_LINKED classes with a true link, or all classes."""
    units = 1 << 30
    placed = nodes.join(counted.select("v", "n"), "v", "left").select("v", "vec", F.coalesce("n", F.lit(0)).alias("n"), F.pmod(F.xxhash64("v", F.lit(99)), F.lit(units)).alias("h"))
    done, rows = 0, AUDIT_ROWS
    got = total = linked = 0
    shares = 0.0
    while done < units and linked < AUDIT_LINKED:
        upto = units if rows >= count else min(units, done + -(-rows * units // count))
        sample = placed.where((F.col("h") >= done) & (F.col("h") < upto)).select("v", "vec", "n").collect()  # about `rows` rows
        true = _true_links(sample, nodes, threshold)
        for r in sample:
            if t := true.get(r.v, 0):
                found = min(r.n, t)
                got, total, linked, shares = got + found, total + t, linked + 1, shares + found / t
        done, rows = upto, min(4 * rows, AUDIT_MOST)
    return min(got / total, shares / linked) if linked else 1.0


def _true_links(sample: list, nodes: DataFrame, threshold: float) -> dict[int, int]:
    """For each row (v, vec) of the sample the rows of other classes at or above the threshold."""
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.vec), []).append(r)
    held = {size: (unit([bytes(r.vec) for r in rs]), np.array([r.v for r in rs])) for size, rs in by_size.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {size: np.zeros(len(own), np.int64) for size, (_, own) in held.items()}
        for batch in batches:
            ids, n, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            lengths = np.array([len(x) for x in vecs])
            for size, (x, own) in held.items():
                every = np.flatnonzero(lengths == size)
                for at in (every[i : i + 1024] for i in range(0, len(every), 1024)):
                    hit = (x @ unit([vecs[i] for i in at]).T >= threshold) & (own[:, None] != ids[at][None, :])
                    totals[size] += hit @ n[at]
        for size, (_, own) in held.items():
            some = np.flatnonzero(totals[size])
            yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(totals[size][some])], names=["v", "n"])

    return {r.v: r.n for r in nodes.select("v", "n_rows", "vec").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id) of every row, and the audited recall, which is AUDIT_RECALL at least."""
    packed, _ = materialize(_pack(vectors, id_col, vector_col), "embedding-vectors")
    full = packed.where("vec is not null and vec_id is not null")
    classes = full.groupBy("vec").agg(F.min("vec_id").alias("v"), F.count("*").alias("n_rows"))
    nodes, _ = materialize(classes, "embedding-classes")
    count = nodes.count()
    graph, recall, counted = None, 0.0, None
    for turn in range(ROUNDS):
        more = _blocks(nodes, count, k, TABLES, 7 + turn)
        graph, _ = materialize(_best(more if graph is None else more.unionByName(graph.withColumn("fresh", F.lit(False))), k), "embedding-graph")
        for _ in range(ITERATIONS):
            candidates = _descend(graph, nodes, k)
            new, _ = materialize(_best(graph.withColumn("fresh", F.lit(False)).unionByName(candidates), k), "embedding-graph")
            changed = new.where("fresh").count()
            graph = new
            if changed <= SETTLED * k * count:
                break
        links = graph.where(F.col("sim") >= threshold).select(F.col("v").alias("a"), F.col("u").alias("b"))
        comps, _ = materialize(connected_components(links).select(F.col("id").alias("v"), "component"), "embedding-components")
        comps, _ = materialize(_joined(comps, graph, nodes, k, threshold), "embedding-components")
        counted, _ = materialize(_within(comps, nodes, threshold), "embedding-counts")
        recall = _audit(counted, nodes, count, threshold)
        if recall >= AUDIT_RECALL:
            break
        k *= 2
    else:
        raise RuntimeError(f"the audited recall is {recall:.4f} after {ROUNDS} rounds, {AUDIT_RECALL} is asked for")
    known = nodes.join(counted, "v", "left").select("vec", "n_rows", (F.col("n_rows") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "v").alias("component_id"))
    known, _ = materialize(known, "embedding-known")
    members = join_dealt(full, known, ["vec"], "vec_id", n="n_rows").select("vec_id", "n_links", "component_id")
    rest = packed.where("vec is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(rest), recall


def op9_nn_descent(spark, sf_dir: str) -> DataFrame:
    found, _ = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
