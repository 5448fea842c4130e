"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c are apart by the squared distance 2 - 2c. After a fixed random rotation
they are split into blocks, and two vectors within that distance are within their share of it, the
block's part of all dimensions, in one block at least. Each block is joined by range: a vector lies
at home in one cell of a grid over the block's first coordinates and asks in every cell that its
range touches. In a cell the block's distance, on all its coordinates, selects the candidates; those
that no earlier block selects are held against the cosine in double precision, so each link counts
once. Equal vectors are one row with its number of copies, and a full cell is dealt to blocks of
bounded size. A block returns counts and a star of each linked set, never its pairs.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Staged, components
from spanloom.llm.simhash import stars

SLACK = 1e-9
CELL_ROWS = 64_000
LEAST_ROWS = 2_000
CELL_BITS = 12


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, so that no block holds little but noise."""
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def unit_rows(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of length 1 in double precision; all are finite, of ``dims`` components and not zero."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(points: np.ndarray, width: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the grid that the balls of radius ``reach`` around the points touch: point, cell number, whether it is home."""
    home = np.floor(points / width).astype(np.int64)
    below, above = points - home * width, (home + 1) * width - points
    who, cells, own = [], [], []
    for step in product((-1, 0, 1), repeat=points.shape[1]):
        d = np.array(step)
        cost = (np.where(d < 0, below, np.where(d > 0, above, 0.0)) ** 2).sum(axis=1)
        at = np.flatnonzero(cost <= reach * reach)
        number = np.zeros(len(at), np.int64)
        for k in range(points.shape[1]):
            number = (number << CELL_BITS) | (home[at, k] + d[k] + (1 << (CELL_BITS - 1)))
        who.append(at)
        cells.append(number)
        own.append(np.full(len(at), not any(step)))
    return np.concatenate(who), np.concatenate(cells), np.concatenate(own)


def dealt(asked: DataFrame, staged: Staged, most: int) -> DataFrame:
    """Those who ask in a cell (home false) and those at home there, dealt to blocks (part, door).

    A block has about ``most`` of either: each part of those who ask meets each part of those at home.
    """
    ceiling = lambda n: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    parts = asked.groupBy("dims", "cell").agg(ceiling(F.count("*")).alias("parts"), ceiling(F.count_if("home")).alias("doors"))
    rows = asked.join(staged.write(parts, "parts"), ["dims", "cell"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    asking = rows.select("row", "dims", "cell", "copies", "v", F.lit(False).alias("home"), one("parts").alias("part"), every("doors").alias("door"))
    living = rows.where("home").select("row", "dims", "cell", "copies", "v", F.lit(True).alias("home"), every("parts").alias("part"), one("doors").alias("door"))
    return asking.unionByName(living)


def near_embeddings(vectors: DataFrame, cosine: float = 0.95, blocks: int = 2, grid_dims: int = 1) -> DataFrame:
    """Links of vectors with a cosine of at least ``cosine`` and their components.

    Returns (vec_id, n_links, component_id, kept), a row for each row of vectors. Null and zero
    vectors, and those with null or non-finite components, link with nothing; vectors of different
    lengths don't link with each other. Repeated rows link with each other. A null vec_id is
    counted for others and has no component. Of equal vectors, and of any tie, the smallest vec_id
    names the component; an empty table gives no rows. Labels and other columns are ignored. ``grid_dims``,
    4 at most, is the number of coordinates of a block that make its grid.
    """
    spark = vectors.sparkSession
    staged = Staged(spark)
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    usable = "v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = staged.write(rows.select("vec_id", F.when(F.expr(usable), F.col("v")).alias("v")), "vectors")
    good = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    good = staged.write(good.withColumn("row", F.monotonically_increasing_id()), "good")
    reach_all = 2 - 2 * cosine

    def place(batches):
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            for dims in np.unique(size):
                part = batch.filter(pa.array(size == dims))
                x = unit_rows(part.column("v"), int(dims))
                turned = x @ rotation(int(dims))
                n_blocks = min(blocks, int(dims))
                edges = [round(int(dims) * k / n_blocks) for k in range(n_blocks + 1)]
                for b in range(n_blocks):
                    low, high = edges[b], edges[b + 1]
                    reach = float(np.sqrt(reach_all * (high - low) / dims) + SLACK)
                    points = turned[:, low : low + min(grid_dims, 4, high - low)]
                    who, cell, home = cells_of(points, max(2 * reach, 1e-3), reach)
                    at = pa.array(who)
                    cell |= b << 48
                    yield pa.RecordBatch.from_arrays([part.column("row").take(at), pa.array(np.full(len(at), dims, np.int32)), pa.array(cell), pa.array(home), part.column("copies").take(at), part.column("v").take(at)], ["row", "dims", "cell", "home", "copies", "v"])

    vector = good.schema["v"].dataType.simpleString()
    asked = staged.write(good.select("row", "copies", "v").mapInArrow(place, f"row long, dims int, cell long, home boolean, copies long, v {vector}"), "asked")

    def join(table: pa.Table) -> pa.Table:
        dims, block = table.column("dims")[0].as_py(), table.column("cell")[0].as_py() >> 48
        row, home = table.column("row").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        unit = lambda at: unit_rows(pa.FixedSizeListArray.from_arrays(pa.array(v[at].ravel()), dims), dims)
        turn = rotation(dims)
        n_blocks = min(blocks, dims)
        edges = [round(dims * k / n_blocks) for k in range(n_blocks + 1)]
        budget = [reach_all * (edges[k + 1] - edges[k]) / dims + SLACK for k in range(n_blocks)]
        here, asks = np.flatnonzero(home), np.flatnonzero(~home)
        copies = table.column("copies").to_numpy()
        links = np.zeros(len(asks), np.int64)
        # the same vector stands at home and asks: one place for both
        nodes, place_of = np.unique(row, return_inverse=True)
        label = np.arange(len(nodes))
        own = slice(edges[block], edges[block + 1])
        # one product gives |x|^2 + |y|^2 - 2xy; single precision only proposes, with room for its error
        near_by = np.empty((len(row), edges[block + 1] - edges[block] + 1), np.float32)
        for low in range(0, len(row), 4096):  # doubles of some rows at a time
            turned = unit(slice(low, low + 4096)) @ turn[:, own]
            near_by[low : low + 4096] = np.concatenate((turned, (turned**2).sum(axis=1, keepdims=True)), axis=1)
        right = np.concatenate((-2 * near_by[here, :-1], np.ones((len(here), 1), np.float32), near_by[here, -1:]), axis=1).T.copy()
        for low in range(0, len(asks), 128):  # bounds the table of distances
            some = asks[low : low + 128]
            left = np.concatenate((near_by[some], np.ones((len(some), 1), np.float32)), axis=1)
            i, j = np.divmod(np.flatnonzero((left @ right <= budget[block] + 1e-4).ravel()), len(here))
            a, b = some[i], here[j]
            keep = row[a] != row[b]
            a, b, i = a[keep], b[keep], i[keep]
            true = np.zeros(len(a), bool)
            for at in range(0, len(a), 20_000):
                x, y = unit(a[at : at + 20_000]), unit(b[at : at + 20_000])
                near = (x * y).sum(axis=1) >= cosine
                gaps = ((x - y) @ turn) ** 2
                for k in range(block + 1):  # this block selects it, and no earlier one, which would have counted it
                    gap = gaps[:, edges[k] : edges[k + 1]].sum(axis=1)
                    near &= (gap <= budget[k]) if k == block else (gap > budget[k])
                true[at : at + 20_000] = near
            np.add.at(links, low + i[true], copies[b[true]])
            if true.any():  # folded at once, so that no pair outlives its rows of the table
                label = stars(len(nodes), label[place_of[a[true]]], label[place_of[b[true]]])[label]
        out, some = np.flatnonzero(label != np.arange(len(nodes))), np.flatnonzero(links)
        return pa.table({"row": pa.array(np.concatenate((row[asks[some]], nodes[out]))), "links": pa.array(np.concatenate((links[some], np.zeros(len(out), np.int64)))), "to": pa.array(np.concatenate((row[asks[some]], nodes[label[out]])))})

    # smaller blocks for fewer rows, so that many tasks share them
    most = min(CELL_ROWS, max(LEAST_ROWS, good.count() // 6))
    found = staged.write(dealt(asked, staged, most).groupBy("dims", "cell", "part", "door").applyInArrow(join, "row long, links long, to long"), "found")
    linked = components(spark, found.where("row <> to").select(F.col("row").alias("a"), F.col("to").alias("b")), staged)
    count = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    members = good.join(linked, F.col("row") == F.col("id"), "left").select("row", "v", "copies", "first", F.coalesce("component", "row").alias("component"))
    members = staged.write(members.join(count, "row", "left"), "members")
    least = staged.write(members.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    # copies link with each other too
    members = members.join(least, "component").select("v", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.where("v is not null").join(members, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))
