"""A clustered index of reference vectors on disk, and exact nearest neighbours from it.

Unit vectors lie in cells, each around a pivot taken from the vectors themselves. By the triangle
inequality on angles a cell of radius r holds nothing nearer to a query than the query's angle to the
pivot less r. A first round visits the nearest cells of each query until they hold k vectors; the k-th
of these bounds the answer, and a second round visits just the cells that may still hold something as
near.

The table is partitioned by cell, so cells that nobody visits are not read. Cells near each other form
tiles of ``TILE_BYTES`` at most (a larger cell is cut by hash into tiles of its own), and queries form
blocks of the same size by the tile nearest to them. A query is copied to the tiles it visits and a cell
to the blocks that visit it, so a task holds one block and one tile however large the tables are, and
vectors that leave no cell out are copied once a tile or block, not once a cell.

What goes to the driver and the tasks is the list of cells: ``MOST_CELLS`` pivots at most.

Similarities are compared at ``DIGITS`` decimals; of equal ones the smaller id comes first.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.picks import row_hash
from ..functions.scores import l2_normalize
from .lineage import cut, shared_folder
from .skew import null_safe_join, salted_join

CELL_ROWS = 1 << 13
MOST_CELLS = 1 << 16
DIGITS = 12
#: Bytes of the vectors of a tile or block at most, and numbers of a matrix made at a time.
TILE_BYTES, STRIP = 1 << 24, 1 << 21
_SLACK = 1e-7  # of an angle, for rounding
_BLOCK = ["_home", "_part"]


def normalized(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, l2_normalize(F.col(vector).cast("array<double>")))


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def _strips(rows: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Parts of ``rows`` whose matrix with ``width`` columns stays small."""
    step = max(1, STRIP // max(width, 1))
    for at in range(0, len(rows), step):
        yield rows.iloc[at : at + step]


@dataclass(frozen=True)
class VectorIndex:
    path: str
    schema: str
    cell_rows: int
    cells: np.ndarray  # numbers of the cells that hold vectors
    pivots: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/vectors")


def build_index(refs: DataFrame, path: str, model: str = "", version: str = "", cell_rows: int = CELL_ROWS) -> VectorIndex:
    """Write the index of ``vec_id, taxid, embedding`` to a new folder ``path`` and open it."""
    spark = refs.sparkSession
    unit = cut(normalized(refs.select("vec_id", "taxid", "embedding").where("embedding IS NOT NULL")))
    wanted = min(MOST_CELLS, -(-unit.count() // cell_rows))
    chosen = unit.select("vec_id", "embedding").orderBy(row_hash("vec_id"), "vec_id").limit(wanted).collect()
    pivots = np.array([r["embedding"] for r in chosen], float)
    held = spark.sparkContext.broadcast(pivots)  # MOST_CELLS vectors at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _strips(batch, len(held.value)):
                angles = _angles(np.stack(rows["embedding"].to_list()), held.value)
                cell = angles.argmin(axis=1)
                yield rows.assign(cell=cell.astype(np.int32), angle=angles[np.arange(len(rows)), cell])

    types = dict(unit.dtypes)
    schema = f"vec_id {types['vec_id']}, taxid {types['taxid']}, embedding array<double>, cell int, angle double"
    placed = unit.mapInPandas(assign, schema)
    placed.repartition("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(schema).parquet(f"{path}/vectors")
    stats = {r["cell"]: r for r in stored.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    cells = [(k, r["embedding"], float(stats[k]["radius"]), stats[k]["n"]) for k, r in enumerate(chosen) if k in stats]
    about = (model, version, cell_rows, schema)
    manifest = "cell int, pivot array<double>, radius double, n bigint, model string, version string, cell_rows int, schema string"
    spark.createDataFrame([(*c, *about) for c in cells or [(None,) * 4]], manifest).coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path, model, version)


def open_index(spark: SparkSession, path: str, model: str = "", version: str = "") -> VectorIndex:
    """The index at ``path``; one made with another model or version is refused."""
    rows = spark.read.parquet(f"{path}/cells").collect()  # the list of cells
    about = rows[0]
    if (about["model"], about["version"]) != (model, version):
        raise ValueError(f"the index was built with {about['model']!r} {about['version']!r}, not {model!r} {version!r}")
    cells = sorted((r for r in rows if r["cell"] is not None), key=lambda r: r["cell"])
    return VectorIndex(
        path, about["schema"], about["cell_rows"], np.array([r["cell"] for r in cells], np.int32),
        np.array([r["pivot"] for r in cells], float), np.array([r["radius"] for r in cells], float),
        np.array([r["n"] for r in cells], np.int64),
    )


def _lower_bounds(rows: pd.DataFrame, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The least angle from each query to anything in each cell."""
    return np.maximum(_angles(np.stack(rows["embedding"].to_list()), pivots) - radius, 0.0)


def _first_cells(bounds: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """For each query, which cells the first round visits: the nearest ones that hold k vectors."""
    order = np.argsort(bounds, axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    out = np.zeros(bounds.shape, bool)
    np.put_along_axis(out, order, before < k, axis=1)
    return out


@dataclass(frozen=True)
class _Tiles:
    """``first`` and ``number`` of the tiles of each cell; several cells may share one."""

    rows: int
    first: np.ndarray
    number: np.ndarray


def _tiles(index: VectorIndex, cores: int) -> _Tiles:
    n, total = len(index.sizes), int(index.sizes.sum())
    width = index.pivots.shape[1] if n else 1
    # Small tables are cut into more tiles and blocks, so that every core has some.
    rows = max(1, min(TILE_BYTES // (8 * max(width, 1)), max(1 << 10, -(-total // math.isqrt(4 * cores)))))
    first, number = np.zeros(n, np.int64), np.maximum(-(-index.sizes // rows), 1)
    if n:
        leaders = index.pivots[:: math.isqrt(n)]
        near = np.concatenate([(part @ leaders.T).argmax(axis=1) for part in np.array_split(index.pivots, -(-n * len(leaders) // STRIP))])
        tile, held = 0, 0
        for cell in np.argsort(near, kind="stable"):
            if held and held + index.sizes[cell] > rows:
                tile, held = tile + 1, 0
            first[cell] = tile
            held += index.sizes[cell]
            if number[cell] > 1:
                tile, held = tile + number[cell], 0
    return _Tiles(rows, first, number)


def _tiles_of(wanted: np.ndarray, tiles: _Tiles) -> tuple[np.ndarray, np.ndarray]:
    """Rows and tiles, each pair once, for a matrix of rows and the cells they want."""
    row, cell = np.nonzero(wanted)
    number = tiles.number[cell]
    within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    pairs = np.column_stack([np.repeat(row, number), np.repeat(tiles.first[cell], number) + within])
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pairs[:, 0], pairs[:, 1]


def _best(refs: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of ``refs`` for each query, by similarity and then by id."""
    cols = ["query_id", "vec_id", "taxid", "similarity"]
    if refs.empty or queries.empty:
        return pd.DataFrame(columns=cols)
    refs = refs.sort_values("vec_id")
    vectors, ids, taxa = np.stack(refs["embedding"].to_list()), refs["vec_id"].to_numpy(), refs["taxid"].to_numpy()
    top, found = min(k, len(refs)), []
    for some in _strips(queries, len(refs)):
        sims = np.stack(some["embedding"].to_list()) @ vectors.T
        # What may round to the k-th value or more, then the exact order of these few.
        least = np.partition(sims, len(refs) - top, axis=1)[:, len(refs) - top]
        rows, hits = np.nonzero(sims >= least[:, None] - 2 * 10.0**-DIGITS)
        values = np.round(sims[rows, hits], DIGITS)
        # Places are in the order of the ids, so a stable sort keeps the lower id on a tie.
        order = np.lexsort((-values, rows))
        rows, hits, values = rows[order], hits[order], values[order]
        counts = np.bincount(rows, minlength=len(some))
        kept = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) < top
        rows, hits, values = rows[kept], hits[kept], values[kept]
        parts = (some["query_id"].to_numpy()[rows], ids[hits], taxa[hits], values)
        found.append(pd.DataFrame(dict(zip(cols, parts, strict=True))))
    return pd.concat(found)


def _visit(asked: DataFrame, needed: DataFrame, index: VectorIndex, tiles: _Tiles, k: int) -> DataFrame:
    """The best ``k`` of each visited tile: ``query_id, vec_id, taxid, similarity``.

    ``asked`` has the queries once for each tile they visit, ``needed`` the cells each block visits.
    """
    spark = asked.sparkSession
    places = [(int(c), int(f), int(n)) for c, f, n in zip(index.cells, tiles.first, tiles.number, strict=True)]
    place = F.broadcast(spark.createDataFrame(places or [(0, 0, 1)], "cell int, _first int, _number int"))  # the list of cells
    refs = index.vectors(spark).select("vec_id", "taxid", "embedding", "cell")
    refs = refs.join(F.broadcast(needed.select("cell").distinct()), "cell", "left_semi").join(place, "cell")
    tile = F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_number")).cast("int")
    refs = salted_join(refs.withColumn("_tile", tile), needed, ["cell"], ["vec_id"]).drop("cell", "_first", "_number")
    types = dict(refs.dtypes) | dict(asked.dtypes)
    return (
        refs.groupBy(*_BLOCK, "_tile")
        .cogroup(asked.groupBy(*_BLOCK, "_tile"))
        .applyInPandas(
            lambda a, b: _best(a, b, k),
            f"query_id {types['query_id']}, vec_id {types['vec_id']}, taxid {types['taxid']}, similarity double",
        )
    )


def _top(found: DataFrame, k: int) -> DataFrame:
    """``query_id, _hits``: at most k rows of each cell part reach the choice."""
    hit = F.struct((-F.col("similarity")).alias("d"), "vec_id", "taxid")
    return found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(hit)), 1, k).alias("_hits"))


def nearest_in_index(queries: DataFrame, index: VectorIndex, k: int = 1, visited: list | None = None) -> DataFrame:
    """Exact cosine neighbours: ``query_id, vec_id, taxid, similarity, rank``.

    ``queries`` has ``query_id, embedding``; those without a vector find nothing. The frames of
    (query, cell) visits are appended to ``visited``.
    """
    spark = queries.sparkSession
    kept = normalized(queries.select("query_id", "embedding").where("embedding IS NOT NULL"))
    kind = dict(kept.dtypes)["query_id"]
    tiles = _tiles(index, spark.sparkContext.defaultParallelism)
    held = spark.sparkContext.broadcast((index.pivots, index.radius, index.sizes, index.cells, tiles))  # the list of cells

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, radius, _, _, tiles = held.value
        for batch in batches:
            for rows in _strips(batch, len(pivots)) if len(pivots) else ():
                yield rows.assign(_home=tiles.first[_lower_bounds(rows, pivots, radius).argmin(axis=1)].astype(np.int32))

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Queries and the cells they visit: without ``_least`` in the first round, with it in the second."""
        pivots, radius, sizes, _, _ = held.value
        for batch in batches:
            for rows in _strips(batch, len(pivots)):
                bounds = _lower_bounds(rows, pivots, radius)
                visits = _first_cells(bounds, sizes, k)
                if "_least" in rows:
                    reach = np.arccos(np.clip(rows["_least"].to_numpy(), -1.0, 1.0))[:, None]
                    visits = bounds <= reach + _SLACK
                yield rows, visits

    def by_tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, visits in wanted(batches):
            row, tile = _tiles_of(visits, held.value[4])
            yield rows[["query_id", "embedding", *_BLOCK]].iloc[row].assign(_tile=tile.astype(np.int32))

    def by_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, visits in wanted(batches):
            for block, at in rows.groupby(_BLOCK).indices.items():
                cell = held.value[3][visits[at].any(axis=0)]
                yield pd.DataFrame({"_home": block[0], "_part": block[1], "cell": cell}).astype(np.int32)

    def by_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, visits in wanted(batches):
            query, cell = np.nonzero(visits)
            yield pd.DataFrame({"query_id": rows["query_id"].to_numpy()[query], "cell": held.value[3][cell].astype(np.int32)})

    def visit(rows: DataFrame) -> DataFrame:
        if visited is not None:
            visited.append(rows.mapInPandas(by_cell, f"query_id {kind}, cell int"))
        asked = rows.mapInPandas(by_tile, f"query_id {kind}, embedding array<double>, _home int, _part int, _tile int")
        needed = cut(rows.mapInPandas(by_block, "_home int, _part int, cell int").distinct())
        return _visit(asked, needed, index, tiles, k)

    unit = cut(kept.mapInPandas(home, f"query_id {kind}, embedding array<double>, _home int"))
    parts = unit.groupBy("_home").agg(F.ceil(F.count(F.lit(1)) / tiles.rows).cast("int").alias("_parts"))
    part = F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int")
    unit = unit.join(F.broadcast(cut(parts)), "_home").withColumn("_part", part).drop("_parts")  # a row a tile
    found = cut(visit(unit))
    # The k-th similarity of the first round; with fewer than k vectors all cells were visited. A task of
    # the second round meets whole cells of its block, also those of the first, so its hits stand alone.
    once = cut(_top(found, k))
    least = once.where(F.size("_hits") == k).select("query_id", (-F.element_at("_hits", -1)["d"]).alias("_least"))
    again = visit(cut(null_safe_join(unit, least, ["query_id"])))
    best = once.where(F.size("_hits") < k).unionByName(_top(again, k))
    return best.select("query_id", F.posexplode("_hits").alias("_at", "_hit")).select(
        "query_id", "_hit.vec_id", "_hit.taxid", (-F.col("_hit.d")).alias("similarity"), (F.col("_at") + 1).alias("rank"),
    )


def nearest_vectors(queries: DataFrame, refs: DataFrame, k: int = 1, block: int = CELL_ROWS) -> DataFrame:
    """The same for references at hand, from an index written to the shared folder."""
    spark = refs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    return nearest_in_index(queries, build_index(refs, path, cell_rows=block), k)
