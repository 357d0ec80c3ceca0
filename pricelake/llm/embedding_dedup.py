"""Near-duplicate embeddings: int8 tile products with per-vector error bounds, exact where it matters.

Unit vectors u are stored as int8 codes q with a scale s, so that u = s*q + r with |r| = e known exactly. For two
vectors the true cosine differs from s_u*s_v*(q_u . q_v) by at most e_u + |s_u*q_u| * e_v (Cauchy-Schwarz), so pairs
whose product plus that bound stays under the threshold can't link and are never looked at again; only the others
are recomputed in double precision, and that value alone decides.

Plan: equal vectors of a label become one representative with a count. Representatives are sorted by label and by
their projection on one direction and cut into tiles of bounded size. Unit vectors with a cosine of at least t are at
most sqrt(2-2t) apart, hence so are their projections, and tile pairs further apart are skipped. BAND neighbouring tiles
are a band; a task holds the tiles of a band and compares them with one tile after another of those within reach, so
a tile is sent once for each band and not for each tile, and a label with a third of all vectors is shared by as many
tasks as it has bands. Tasks return link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, written
from .components import connected_components, forest

#: A tile holds at most so many vectors, and so many bytes.
TILE_ROWS, TILE_BYTES = 2048, 4 << 20
#: Tiles that a task holds at once, and bands and tiles that are matched up together.
BAND, TOGETHER = 8, 1024
#: What rounding in double precision may add to a bound.
SLACK = 1e-9

_TILE = "label int, dim int, tile long, lo double, hi double, ids binary, copies binary, codes binary, scales binary, errors binary, vectors binary"


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and exact error norms of unit vectors, a row each."""
    scales = np.abs(units).max(axis=1) / 127.0
    codes = np.rint(units / scales[:, None]).astype(np.int8)
    errors = np.linalg.norm(units - codes * scales[:, None], axis=1)
    return codes, scales, errors


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    wide = vectors.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1)[:, None]


def _direction(dim: int) -> np.ndarray:
    v = np.random.default_rng(dim).standard_normal(dim)
    return v / np.linalg.norm(v)


def _projections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("embedding"))
        place = np.zeros(batch.num_rows)
        for i, v in enumerate(column):
            x = np.asarray(v.values, dtype=np.float64)
            place[i] = x @ _direction(len(x)) / np.linalg.norm(x)
        yield batch.append_column("place", pa.array(place))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of the sorted rows: a new one at each label or length, or when the last is full."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    key, held = None, []

    def tile() -> pa.RecordBatch:
        nonlocal made
        raw = np.stack([x for _, _, x, _ in held])
        units = unit_vectors(raw)
        codes, scales, errors = quantised(units)
        made += 1
        row = {
            "label": [key[0]], "dim": [key[1]], "tile": [(part << 32) + made], "lo": [held[0][3]], "hi": [held[-1][3]],
            "ids": [np.array([h[0] for h in held], dtype=np.int64).tobytes()],
            "copies": [np.array([h[1] for h in held], dtype=np.int64).tobytes()],
            "codes": [codes.tobytes()], "scales": [scales.tobytes()], "errors": [errors.tobytes()], "vectors": [raw.tobytes()],
        }
        types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

    for batch in batches:
        names = batch.schema.names
        columns = [batch.column(names.index(n)) for n in ("label", "dim", "rep", "copies", "place", "embedding")]
        for label, dim, rep, copies, place, vector in zip(*columns, strict=True):
            now = (label.as_py(), dim.as_py())
            if held and (now != key or len(held) >= min(TILE_ROWS, max(16, TILE_BYTES // (5 * key[1])))):
                yield tile()
                held = []
            key = now
            held.append((rep.as_py(), copies.as_py(), np.asarray(vector.values, dtype=np.float64), place.as_py()))
    if held:
        yield tile()


class _Tile:
    def __init__(self, row: dict):
        dim, self.tile = row["dim"], row["tile"]
        self.ids, self.copies = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["copies"], dtype=np.int64)
        # Sums of products of codes are whole numbers, which single precision holds up to 2^24.
        self.codes = np.frombuffer(row["codes"], dtype=np.int8).reshape(-1, dim).astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)
        self.scales, self.errors = (np.frombuffer(row[n], dtype=np.float64) for n in ("scales", "errors"))
        self.length = np.linalg.norm(self.codes * self.scales[:, None], axis=1)
        self.units = unit_vectors(np.frombuffer(row["vectors"], dtype=np.float64).reshape(-1, dim))
        self.lo, self.hi = row["lo"], row["hi"]


def _pairs(x: _Tile, y: _Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two tiles that link; of a tile with itself each pair once."""
    about = (x.codes @ y.codes.T).astype(np.float64)
    about *= x.scales[:, None] * y.scales[None, :]
    about += x.errors[:, None] + x.length[:, None] * y.errors[None, :]
    left, right = np.nonzero(about >= threshold - SLACK)
    if x.tile == y.tile:
        left, right = left[left < right], right[left < right]
    keep = np.zeros(left.size, dtype=bool)
    for at in range(0, left.size, 1 << 16):
        i, j = left[at : at + (1 << 16)], right[at : at + (1 << 16)]
        keep[at : at + (1 << 16)] = np.einsum("ij,ij->i", x.units[i], y.units[j]) >= threshold
    return left[keep], right[keep]


def _linked(threshold: float, far: float):
    """Rows come sorted by band, the band's own tiles first; each other one is compared with those, and let go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, held = None, []
        for batch in batches_of(batches, 1):
            row = batch.to_pylist()[0]
            if row["band"] != band:
                band, held = row["band"], []
            tile = _Tile(row)
            if row["own"]:
                held.append(tile)
            for x in held:
                if x.tile > tile.tile and row["own"] or max(x.lo - tile.hi, tile.lo - x.hi) > far:
                    continue
                same = x.tile == tile.tile
                left, right = _pairs(x, tile, threshold)
                if not left.size:
                    continue
                n = len(x.ids)
                links = np.zeros(n + len(tile.ids))
                np.add.at(links, left, tile.copies[right])
                np.add.at(links, right + n * (not same), x.copies[left])
                root = forest(len(links), left, right + n * (not same))
                found = np.flatnonzero(links)
                every = np.concatenate([x.ids, tile.ids])
                yield pa.RecordBatch.from_arrays([pa.array(every[found]), pa.array(links[found].astype(np.int64)), pa.array(every[root[found]])], names=["a", "links", "b"])

    return run


def _banded(tiles: DataFrame, far: float) -> DataFrame:
    """(band, own, tile): each band with its own tiles, and the later ones within reach."""
    heads = tiles.select("label", "dim", "tile", "lo", "hi")  # a row for each tile
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("label", "dim").orderBy("lo", "tile")) - 1)
    heads = heads.withColumn("number", F.expr(f"place div {BAND}")).withColumn("part", F.expr(f"place div {TOGETHER}"))
    bands = heads.groupBy("label", "dim", "number").agg(F.min("lo").alias("from"), F.max("hi").alias("to"), F.min("part").alias("first_part"))
    last = heads.groupBy("label", "dim").agg(F.max("part").alias("last_part"))
    # A band is matched with tiles of its own or later places, TOGETHER at a time.
    bands = bands.join(last, ["label", "dim"]).withColumn("part", F.explode(F.sequence("first_part", "last_part")))
    bands = bands.select("label", "dim", "part", F.col("number").alias("band_number"), "from", "to")
    pairs = heads.join(bands, ["label", "dim", "part"]).where("number >= band_number").where((F.col("lo") - F.col("to") <= far) & (F.col("from") - F.col("hi") <= far))
    return pairs.select(F.struct("label", "dim", "band_number").alias("band"), (F.col("number") == F.col("band_number")).alias("own"), "tile")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Link equally labelled vectors whose cosine reaches ``threshold``; more columns are ignored.

    Needs vec_id (long), embedding (array of float or double) and label (int); returns a row per input row: vec_id, n_links,
    component_id, kept. A vector that is null, empty, zero or has null or non-finite components, or whose label is
    null, links with nothing; vectors of unlike lengths don't link. Rows that repeat are vectors of their own and count
    as links of each other. component_id is the smallest vec_id of the group; null ids link like any other, and a group of
    null ids alone has a null component_id. An empty table gives an empty result. ``threshold`` must be over 0.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable").drop("usable")
    reps = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()))  # vec_id may be null, or be that of unlike vectors
    placed = reps.withColumn("dim", F.size("embedding")).select("label", "dim", "rep", "copies", "embedding")
    placed = placed.mapInArrow(_projections, "label int, dim int, rep long, copies long, embedding array<double>, place double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = written(
        placed.repartitionByRange(parts, "label", "dim", "place").sortWithinPartitions("label", "dim", "place", "rep").mapInArrow(_tiles, _TILE)
    )

    far = math.sqrt(2 - 2 * threshold) + SLACK
    sent = _banded(tiles, far).join(tiles.drop("label"), "tile").repartition(parts, "band").sortWithinPartitions("band", F.desc("own"), "tile")
    found = written(sent.mapInArrow(_linked(threshold, far), "a long, links long, b long"))

    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    groups = connected_components(found.select("a", "b")).select(F.col("node").alias("rep"), F.col("component"))
    reps = written(reps.join(links, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    least = reps.groupBy("component").agg(F.min("least").alias("component_id"))
    reps = reps.drop("least").join(least, "component")
    linked = good.join(reps, ["label", "embedding"]).select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        "component_id",
    )
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
