"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside cells, one representative per group.

Centres are fitted on a bounded sample; every vector is assigned to the cell of its nearest centre. Two similar vectors
may lie in different cells. If their cosine is at least t, each is within sqrt(1 - t*t) of the plane that separates its
own cell from the other one's. So a vector also visits every cell with a larger number whose plane is that near, where
it meets the other: no link is lost, and each pair of vectors meets once.

A cell's vectors are dealt into blocks of bounded size, and each tile of two blocks is a task's matrix product. A tile
hands on numbers of links and, for the groups, one edge per vector; pairs are never written. Equal vectors are one vector
with a weight from the start. A group of g similar but different vectors costs g * g products, as each one's number of
links is exact, dealt over many tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import settled, written
from postlens.llm.components import components

#: Bounds of the sample that centres are fitted on: vectors, and bytes of them.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Vectors of a block, about.
BLOCK = 1_024
#: Numbers of cells that are compared by their cost.
CELLS = (8, 16, 32, 64, 128, 256, 512, 1024)
_ROUNDS = 6
#: What handing a copy of a vector to another cell costs, in products of two vectors.
_VISIT = 2_000


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1)[:, None]  # neither overflow nor underflow in the squares
    return v / np.linalg.norm(v, axis=1)[:, None]


def spherical_kmeans(unit: np.ndarray, k: int, apart: float, rounds: int = _ROUNDS, seed: int = 5) -> np.ndarray:
    """At most ``k`` unit centres of the sample, no two of them with a cosine above ``apart``.

    Centres that come too near each other are one: a dense group is not cut into cells that all its vectors would visit.
    """
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:k]]
    for _ in range(rounds):
        cell = (unit @ centres.T).argmax(axis=1)
        size = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, unit)
        norms = np.linalg.norm(sums, axis=1)
        order = np.argsort(-size, kind="stable")
        order = order[(size[order] > 0) & (norms[order] > 1e-9)]
        sums = sums[order] / norms[order][:, None]
        near = sums @ sums.T
        chosen: list[int] = []
        for i in range(len(sums)):
            if not chosen or near[i, chosen].max() <= apart:
                chosen.append(i)
        centres = sums[chosen]
    return centres


def cells_of(unit: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and as a mask (vector, cell) the cells with larger numbers that it visits.

    The plane between two cells is at ``u . x = 0`` for ``u`` the unit difference of their centres. A vector at distance d
    on its own side has a cosine of at most sqrt(1 - d*d) with any vector on the other side.
    """
    if not len(centres):
        return np.zeros(len(unit), np.int64), np.zeros((len(unit), 1), bool)
    near = unit @ centres.T
    cell = near.argmax(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-18))
    gap = near[np.arange(len(unit)), cell][:, None] - near
    reach = sqrt(max(0.0, 1 - least * least)) if least > 0 else 2.0
    visits = gap <= (reach + 1e-9) * between[cell]
    return cell, visits & (np.arange(len(centres))[None, :] > cell[:, None])


def fitted(unit: np.ndarray, group: np.ndarray, total: int, least: float, cells: int | None = None) -> np.ndarray:
    """Centres for about as many cells as cost least: products inside cells, assignment, and copies of vectors.

    The numbers compared are those of ``CELLS`` with at least 16 vectors of the sample each, up to the root of the table.
    """
    if len(unit) < 2:
        return unit[:0]
    apart = max(2 * least * least - 1, 0.5) if least > 0 else 0.5
    wanted = [cells] if cells else [k for k in CELLS if k == CELLS[0] or (16 * k <= len(unit) and k * k <= total)]
    best, best_cost = None, np.inf
    scale = total / len(unit)
    for k in wanted:
        centres = spherical_kmeans(unit, k, apart)
        cell, visits = cells_of(unit, centres, least)
        n = len(centres)
        homes = np.unique(group, return_inverse=True)[1] * n
        own = np.bincount(homes + cell, minlength=homes.max() + n)
        row, to = np.nonzero(visits)
        guests = np.bincount(homes[row] + to, minlength=len(own))
        cost = (own * (own / 2 + guests)).sum() * scale * scale + total * n + len(row) * scale * _VISIT
        if cost < best_cost:
            best, best_cost = centres, cost
    return best


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the places of the vectors and their unit vectors."""
    lengths = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    out = []
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        out.append((at, unit_rows(values[starts[at][:, None] + np.arange(dim)])))
    return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, unit in _vectors(batch.column("v")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1").take(pa.array(at)), batch.column("label").take(pa.array(at)),
                 pa.array([len(unit[0])] * len(at), pa.int32()), pa.array([x.tobytes() for x in unit], pa.binary())],
                ["h1", "label", "dim", "unit"],
            )


def _assigned(centres, least: float):
    """Each vector in its cell and once for each cell it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _vectors(batch.column("v")):
                known = centres.value if len(centres.value) and centres.value.shape[1] == unit.shape[1] else np.zeros((0, 1))
                cell, visits = cells_of(unit, known, least)
                row, to = np.nonzero(visits)
                home = np.concatenate((np.ones(len(at), bool), np.zeros(len(row), bool)))
                row = np.concatenate((np.arange(len(at)), row))
                to = np.concatenate((cell, to))
                for i in range(0, len(row), 4_096):
                    part = slice(i, i + 4_096)
                    rows = batch.take(pa.array(at[row[part]]))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("name"), rows.column("label"), pa.array(np.full(rows.num_rows, unit.shape[1], np.int32)),
                         pa.array(to[part].astype(np.int32)), pa.array(home[part]), rows.column("m"), rows.column("v")],
                        ["name", "label", "dim", "cell", "home", "m", "v"],
                    )

    return run


def _links(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Strips of the matrix of links of two blocks: the first row of a strip, and the strip.

    A cosine within rounding of the bound is computed again as the plain sum of products over the lengths.
    """
    ua, ub = unit_rows(a), unit_rows(b)
    for i in range(0, len(a), 256):
        cosine = ua[i : i + 256] @ ub.T
        linked = cosine >= least
        for r, c in zip(*np.nonzero(np.abs(cosine - least) < 1e-12)):
            x, y = a[i + r].astype(np.float64), b[c].astype(np.float64)
            linked[r, c] = np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= least
        yield i, linked


def linked_in_tile(a: dict, b: dict, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the vectors of a tile that have links, their numbers of links, and the smallest name each one reaches."""
    rows, columns = [], []
    for i, linked in _links(a["v"], b["v"], least):
        if same:
            at = np.arange(len(linked))
            linked[at, i + at] = False
        r, c = np.nonzero(linked)
        rows.append((r + i).astype(np.int32))
        columns.append(c.astype(np.int32))
    r, c = np.concatenate(rows), np.concatenate(columns)
    n_a, n_b = (np.bincount(x, weights=w, minlength=n).astype(np.int64) for x, w, n in (
        (r, b["m"][c], len(a["m"])), (c, a["m"][r], len(b["m"]))))
    low_a, low_b = a["name"].copy(), b["name"].copy()
    while True:
        if same:
            low_b = low_a
        before = low_a.copy(), low_b.copy()
        np.minimum.at(low_a, r, low_b[c])
        np.minimum.at(low_b, c, low_a[r])
        if (before[0] == low_a).all() and (before[1] == low_b).all():
            break
    sides = [(a["name"], n_a, low_a)] if same else [(a["name"], n_a, low_a), (b["name"], n_b, low_b)]
    return tuple(np.concatenate([side[k][side[1] > 0] for side in sides]) for k in range(3))


def _block(batch: pa.RecordBatch, i: int, side: str) -> dict:
    rows = batch.column(side)[i].values
    vectors = rows.field("v")
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return {
        "name": rows.field("name").to_numpy(), "m": rows.field("m").to_numpy(),
        "v": values.reshape(len(rows), -1),
    }


def _tiles(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a = _block(batch, i, "one")
                same = batch.column("same")[i].as_py()
                name, n, low = linked_in_tile(a, a if same else _block(batch, i, "other"), least, same)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n), pa.array(low)], ["name", "n", "low"])

    return run


def _usable(v: Column) -> Column:
    """Finite components, none null, and not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cells: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label link if their cosine in double precision is at least ``least``. ``n_links`` counts the other rows
    linked directly, ``component_id`` is the smallest id reachable by links, and the row with that id is kept.

    * Vectors that are null, empty, zero, or hold null, NaN or infinite components, and rows with a null label, link with
      nothing: 0 links, themselves as component, kept. Vectors of different lengths do not link.
    * Repeated rows are rows of their own: each counts as a link of the others, and those with the smallest id are all kept.
    * A row without id links like others but gives a component no id: one that only such rows form has a null
      ``component_id`` and all its rows are kept.
    * An empty table gives no rows. Other columns are not read. ``cells`` sets the number of cells.
    """
    if not -1 <= least <= 1:
        raise ValueError("least is a cosine")
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    rows = rows.withColumn("fine", F.col("label").isNotNull() & _usable(F.col("v")))
    # Two hashes name a label and vector; -0.0 is 0.0.
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = rows.withColumn("v", F.when(F.col("fine"), plain))
    rows = rows.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit("second"), "v", "label")})
    classes = rows.where("fine").groupBy("h1", "h2", "label", "v").agg(
        F.min("id").alias("low_id"), F.count("*").alias("m")
    )
    classes = written(classes.withColumn("name", F.monotonically_increasing_id()), "classes")

    total = classes.count()
    dim = (classes.agg(F.max(F.size("v")).alias("d")).first()["d"] or 1)
    most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    share = min(1_000_000, 1_000_000 * most // max(total, 1))
    drawn = classes.where(F.pmod(F.xxhash64("h2", "h1"), F.lit(1_000_000)) < share).select("h1", "label", "v")
    drawn = sorted(map(tuple, drawn.mapInArrow(_sampled, "h1 long, label string, dim int, unit binary").collect()))
    dims = [r[2] for r in drawn]
    common = max(sorted(set(dims)), key=dims.count) if dims else 1
    drawn = [r for r in drawn if r[2] == common]
    sample = np.frombuffer(b"".join(bytes(r[3]) for r in drawn), np.float64).reshape(-1, common)
    labels = np.array([r[1] for r in drawn])
    centres = spark.sparkContext.broadcast(fitted(sample, labels, total, least, cells))

    assigned = written(
        classes.select("name", "label", "m", "v").mapInArrow(
            _assigned(centres, least), "name long, label string, dim int, cell int, home boolean, m long, v array<double>"
        ),
        "cells",
    )
    place = ["label", "dim", "cell"]
    sizes = assigned.groupBy(*place).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    sizes = sizes.where("homes > 0 and homes + guests > 1").select(
        *place, F.ceil(F.col("homes") / block).alias("home_blocks"), F.ceil(F.col("guests") / block).alias("guest_blocks")
    )
    ways = F.when(F.col("home"), F.col("home_blocks")).otherwise(F.col("guest_blocks"))
    dealt = assigned.join(sizes, place).withColumn("no", F.pmod(F.xxhash64("name"), ways))
    blocks = dealt.groupBy(*place, "home", "no", "home_blocks", "guest_blocks").agg(
        F.collect_list(F.struct("name", "m", "v")).alias("members")  # about as many as a block has
    )
    blocks = written(blocks, "blocks")
    # Tiles: a home block with itself, with the home blocks after it, and with all guest blocks.
    after = F.sequence(F.col("no"), F.col("home_blocks") - 1)
    guests = F.when(F.col("guest_blocks") > 0, F.sequence(F.lit(0).cast("long"), F.col("guest_blocks") - 1))
    tile = lambda guest, other: F.struct(F.lit(guest).alias("guest"), other.alias("no"))
    met = F.concat(
        F.transform(after, lambda j: tile(False, j)),
        F.coalesce(F.transform(guests, lambda j: tile(True, j)), F.array().cast("array<struct<guest:boolean,no:bigint>>")),
    )
    one = blocks.where("home").select(*place, F.col("no").alias("i"), F.explode(met).alias("met"), F.col("members").alias("one"))
    one = one.select(*place, "i", F.col("met.guest").alias("guest"), F.col("met.no").alias("j"), "one")
    before = F.when(F.col("home"), F.expr("case when no > 0 then sequence(0L, no - 1) end")).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("home_blocks") - 1)
    )
    other = blocks.select(*place, F.explode(before).alias("i"), (~F.col("home")).alias("guest"), F.col("no").alias("j"),
                          F.col("members").alias("other"))
    alone = one.where(~F.col("guest") & (F.col("i") == F.col("j"))).select("one", F.lit(None).cast(one.schema["one"].dataType).alias("other"), F.lit(True).alias("same"))
    paired = one.where(F.col("guest") | (F.col("i") < F.col("j"))).join(other, [*place, "i", "guest", "j"]).select(
        "one", "other", F.lit(False).alias("same")
    )
    found = settled(
        alone.unionByName(paired).mapInArrow(_tiles(least), "name long, n long, low long").groupBy("name", "low").agg(F.sum("n").alias("n"))
    )
    roots = components(found.select(F.col("name").alias("a"), F.col("low").alias("b")))
    links = found.groupBy("name").agg(F.sum("n").alias("links"))
    known = classes.select("name", "h1", "h2", "low_id", "m").join(links, "name", "left").join(
        roots.withColumnRenamed("node", "name"), "name", "left"
    ).withColumn("root", F.coalesce("root", "name"))
    lowest = known.where("links is not null").groupBy("root").agg(F.min("low_id").alias("least_id"))
    known = known.join(lowest, "root", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("least_id", "low_id").alias("component"),
    )
    # Rows that link with nothing bring their own result; the others fetch that of their class.
    odd = rows.where(~F.col("fine")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = rows.where("fine").select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n_links", "component")
    return out.unionByName(odd).select(
        F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
