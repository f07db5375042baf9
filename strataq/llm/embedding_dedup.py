"""Embedding near-dedup: all pairs of vectors with a cosine of 0.95 or more, by dual traversals of cover trees.

Equal vectors are one node with a weight. The others are dealt into cells around pivots, which are a bounded sample; a cell is cut by a
hash into chunks of ``CHUNK_BYTES``, and a task makes each chunk a cover tree (:mod:`strataq.llm.cover_tree`). Pairs of cells
whose covering radii keep them further apart than the threshold are never met; the chunks of the others are dealt into blocks, and
each pair of blocks is a group, where each pair of its chunks meets: their trees are traversed together. What a meeting gives is bounded by its points, however many
links they have: the weight that each point links with, and links enough to connect what is connected.

Every pair is found, and none by a bound alone that is below the threshold: bounds only leave out pairs that are further
apart, or take whole balls that are nearer. Where the vectors have no structure (as random ones have none), no cell is far from
another and the work grows with the square of the distinct vectors; what is shuffled then is each chunk once for each block, and a block
is ``BLOCK_BYTES`` of them.

Defined results: a vector that is null, empty or zero, or has a null or non-finite component, links with nothing, and vectors
of different lengths don't link. Each row is a vector: rows that repeat a vec_id or a vector count for each other's links.
A null vec_id links as any other does and is never the smallest of its component; where all are null, the component is. An empty table
gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.components import components
from strataq.llm.cover_tree import Tree, distances, traverse, unit
from strataq.tables import written

#: Bytes of a chunk's vectors in double precision, and the rows it has at the most.
CHUNK_BYTES, MOST_ROWS = 8 << 20, 4_096
#: Bytes of a block of chunks (in double precision too), two of which a group holds, and blocks that fewer chunks make, so that all cores have groups.
BLOCK_BYTES, BLOCKS = 32 << 20, 16
#: Groups of blocks that are tasks of their own.
MOST_TASKS = 2_000
#: Pivots, all of which go to every task.
MOST_PIVOTS = 4_096
_NODES = ("low", "high", "first", "last", "radius", "children")
_TREE = "cell int, salt int, vectors binary, rep array<long>, copies array<long>, low array<long>, high array<long>, first array<long>, last array<long>, radius array<double>, children array<long>"


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite components throughout, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def in_cells(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``reps`` with the nearest pivot and the distance to it."""
    sent = reps.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                far = distances(unit(matrix(part.column("embedding"))), sent.value)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], [*part.schema.names, "cell", "far"])

    return reps.mapInArrow(assign, f"rep long, copies long, embedding {reps.schema['embedding'].dataType.simpleString()}, cell int, far double")


def build(key: tuple, table: pa.Table) -> pa.Table:
    """The cover tree of a chunk as one row."""
    table = table.sort_by("rep")  # the same tree however the rows came
    vectors = matrix(table.column("embedding"))
    tree = Tree(unit(vectors))
    lists = {"rep": table.column("rep").to_numpy()[tree.order], "copies": table.column("copies").to_numpy()[tree.order]} | {name: getattr(tree, name) for name in _NODES}
    columns = {"cell": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py()], pa.int32()), "vectors": pa.array([vectors[tree.order].tobytes()])}
    columns |= {name: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for name, v in lists.items()}
    return pa.table(columns)


def meetings(block: int, per: int, owner: np.ndarray, centres: np.ndarray, radius: np.ndarray, most: float) -> Iterator[tuple[int, np.ndarray]]:
    """The blocks from ``block`` on that it meets, each with the numbers of the chunks of both that have one to meet in the other.

    ``owner`` has the cell of each chunk, ``per`` chunks are a block.
    """
    own = np.arange(block * per, min(len(owner), (block + 1) * per))
    cells, at = np.unique(owner[own], return_inverse=True)
    met = _near(cells, np.arange(len(centres)), centres, radius, most)
    for other in range(block, -(-len(owner) // per)):
        theirs = np.arange(other * per, min(len(owner), (other + 1) * per))
        pairs = met[np.ix_(at, owner[theirs])]
        if pairs.any():
            yield other, np.unique(np.concatenate([own[pairs.any(axis=1)], theirs[pairs.any(axis=0)]]))


def _near(cells: np.ndarray, others: np.ndarray, centres: np.ndarray, radius: np.ndarray, most: float) -> np.ndarray:
    """Whether points of two cells can be as near as ``most``."""
    return distances(centres[cells], centres[others]) <= radius[cells][:, None] + radius[others] + most + 1e-6


def _opened(row: dict, width: int, dtype: str) -> tuple[Tree, np.ndarray, np.ndarray]:
    """A chunk's tree, reps and copies."""
    tree = Tree.of(unit(np.frombuffer(row["vectors"], dtype).reshape(-1, width)), **{n: np.array(row[n]) for n in _NODES})
    return tree, np.array(row["rep"]), np.array(row["copies"])


def _met(a: tuple[Tree, np.ndarray, np.ndarray], b: tuple[Tree, np.ndarray, np.ndarray] | None = None, most: float = 0.0) -> pa.Table:
    tree, reps, copies = b or a
    found = traverse(a[0], tree, most, a[2], copies)
    here, there, roots = found.settle()
    names = np.concatenate([a[1], reps])
    linked, n = (np.concatenate([here, there]), len(names)) if b else (here, len(here))
    root = names[roots][:n]
    keep = (linked > 0) | (root != names[:n])
    return pa.table({"rep": names[:n][keep], "linked": linked[keep], "root": root[keep]})


def meet_blocks(key: tuple, table: pa.Table, per: int, width: int, dtype: str, most: float, centres: np.ndarray, radius: np.ndarray) -> pa.Table:
    """All meetings of the chunks of two blocks, or of those of one with each other."""
    block, other = (k.as_py() for k in key)
    table = table.sort_by("chunk")
    numbers, cells = table.column("chunk").to_numpy(), table.column("cell").to_numpy()
    near = _near(cells, cells, centres, radius, most)
    opened = [_opened(table.slice(k, 1).to_pylist()[0], width, dtype) for k in range(table.num_rows)]
    met = []
    for i in np.flatnonzero(numbers // per == block):
        for j in np.flatnonzero((numbers // per == other) & (numbers >= numbers[i]) & near[i]):
            met.append(_met(opened[i], opened[j] if i != j else None, most))
    return pa.concat_tables(met)


def _links(reps: DataFrame, width: int, most: float) -> DataFrame:
    """(rep, linked, root) of all meetings of vectors of one length."""
    spark, n = reps.sparkSession, reps.count()
    kind = reps.schema["embedding"].dataType
    dtype = "float32" if kind.elementType.simpleString() == "float" else "float64"
    rows = max(16, min(MOST_ROWS, CHUNK_BYTES // (8 * width)))
    pivots = reps.orderBy(F.xxhash64("embedding"), "rep").limit(max(1, min(MOST_PIVOTS, -(-n // rows)))).select("embedding").toArrow()
    centres = unit(matrix(pivots.column("embedding")))
    cells = written(in_cells(reps, centres), "cells")
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():
        size[r.cell], radius[r.cell] = r.n, r.radius
    chunks = -(-size // rows)
    dealt = spark.createDataFrame([(k, int(c)) for k, c in enumerate(chunks) if c], "cell int, chunks int")
    dealt = cells.join(F.broadcast(dealt), "cell").withColumn("salt", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    trees = written(dealt.select("cell", "salt", "rep", "copies", "embedding").groupBy("cell", "salt").applyInArrow(build, _TREE), "trees")
    owner = np.repeat(np.arange(len(chunks)), chunks)
    per = max(1, min(BLOCK_BYTES // (8 * width * rows), -(-len(owner) // BLOCKS)))
    blocks = -(-len(owner) // per)
    sent = spark.sparkContext.broadcast((owner, np.arange(len(owner)) - (np.cumsum(chunks) - chunks)[owner], centres, radius))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of each pair of blocks."""
        owner, salt, centres, radius = sent.value
        for batch in batches:
            for block in batch.column("id").to_pylist():
                for other, held in meetings(block, per, owner, centres, radius, most):
                    columns = [np.full(len(held), block), np.full(len(held), other), held, owner[held], salt[held]]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in columns], ["block", "other", "chunk", "cell", "salt"])

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        return meet_blocks(key, table, per, width, dtype, most, *sent.value[2:])

    wanted = spark.range(blocks).repartition("id").mapInArrow(deal, "block int, other int, chunk int, cell int, salt int")
    sides = wanted.join(trees, ["cell", "salt"]).repartition(min(MOST_TASKS, blocks * (blocks + 1) // 2), "block", "other").groupBy("block", "other")
    return written(sides.applyInArrow(settle, "rep long, linked long, root long"), "met")


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding")
    groups = rows.where(usable(F.col("embedding"))).groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    reps = written(groups.select(F.monotonically_increasing_id().alias("rep"), "embedding", "least_id", "copies"), "reps")
    widths = [r[0] for r in reps.select(F.size("embedding")).distinct().collect()]
    most = float(np.sqrt(2 - 2 * least))
    met = vectors.sparkSession.createDataFrame([], "rep long, linked long, root long")
    for width in sorted(widths):
        met = met.unionByName(_links(reps.where(F.size("embedding") == width).select("rep", "copies", "embedding"), width, most))
    counts = met.groupBy("rep").agg(F.sum("linked").alias("linked"))
    joined = components(met.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    nodes = written(reps.join(counts, "rep").join(joined, "rep", "left").select("rep", "least_id", "embedding", "linked", F.coalesce("component", "rep").alias("component")), "nodes")
    smallest = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    told = nodes.join(smallest, "component").select("embedding", "component_id", (F.col("linked") - 1).alias("n_links"))
    # a hot vector's rows are split by Spark (skew join); all others have few
    linked = rows.where(usable(F.col("embedding"))).join(told, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
