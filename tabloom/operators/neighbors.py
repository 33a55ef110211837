"""Exact k-nearest-neighbour join under a Minkowski metric.

1. Copies: equal vectors are reduced to one row with their k+1 smallest ids, so a
   vector that fills a third of the table costs one row.
2. Two levels: every vector goes to the cell of its nearest pivot (a bounded hash sample), and
   neighbouring cells make up blocks of about 16 times the root of the number of rows (between
   `MIN_BLOCK` and `MAX_BLOCK`). So where nothing can be excluded, the copies of queries that
   move grow with the power 1.5 of the rows, not 2, until blocks have their full size. A block
   that has more rows is cut by hash, so none grows with the data.
3. A first pass searches the block around the nearest pivot; its k-th distance bounds the
   result. The second pass searches only blocks with a cell within the bound, by the cell's
   distances from its pivot and by the plane half way between two pivots. Both passes match
   queries to blocks by an equi-join on the block id and emit at most k rows per (query, block).
4. Inside a block only rows within a query's bound are compared exactly. With up to `BOX_WIDTH`
   coordinates, rows are split again around pivots of their own, the part nearest to a query tightens
   its bound, and boxes of rows that do not reach a box of queries are not looked at. With more, one
   matrix product bounds all distances of the block from below, whatever the metric.

Distances are rounded to 9 digits and ties go to the smaller id, so that two runs, or
two engines, agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash32, quoted
from ..functions.vectors import list_matrix, minkowski, minkowski_pairs, powers, stack
from ..session import materialize, rows_if_small

DIGITS = 9
MIN_BLOCK, MAX_BLOCK = 1024, 32_768
PART_ROWS = 256
TILE_CELLS = 1 << 21
CELLS_PER_BLOCK, MAX_PIVOTS = 4, 1024
LEAF_ROWS, BOX_WIDTH = 64, 8
SPANS, PAIRS = 3, 1 << 11
TILE_ROWS, TILE_COLUMNS = 256, 1024
MAX_CELLS = 200_000
SLACK = 1e-8


def block_rows(size: int) -> int:
    """Rows of a block, by the number of distinct vectors."""
    return min(MAX_BLOCK, max(MIN_BLOCK, int(16 * size**0.5)))


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    p: float = 2.0,
    id_col: str = "id",
    vector: str = "vector",
    by: str | None = None,
    exclude_self: bool = False,
    payload: str | None = None,
) -> DataFrame:
    """(query, neighbor, distance, rank[, payload]) with rank 1..k per query row.

    `by` keeps neighbours inside the same group; `exclude_self` drops a row with the
    query's own id; `payload` is a corpus column that travels with the neighbour.
    """
    group = F.col(quoted(by)).cast("string") if by else F.lit("")
    held = F.col(quoted(payload)) if payload else F.lit(None).cast("double")
    keep = k + 1 if exclude_self else k

    # A row is its vector's text digest plus id; equal vectors share the digest.
    def shaped(df: DataFrame, extra) -> DataFrame:
        values = F.col(quoted(vector)).cast("array<double>")
        rows = df.select(F.col(quoted(id_col)).alias("id"), group.alias("grp"), F.transform(values, lambda x: x + F.lit(0.0)).alias("vec"), *extra)
        return rows.withColumn("vkey", F.md5(F.concat_ws(",", F.col("grp"), F.col("vec").cast("array<string>"))))

    left, right = shaped(queries, []), shaped(corpus, [held.alias("payload")])
    nearest_ids = Window.partitionBy("vkey").orderBy("id")
    copies = right.withColumn("c", F.row_number().over(nearest_ids)).where(F.col("c") <= keep)
    points = copies.groupBy("vkey").agg(
        F.first("grp").alias("grp"),
        F.first("vec").alias("vec"),
        F.sort_array(F.collect_list(F.struct("id", "payload"))).alias("members"),
    )
    points = materialize(points.withColumn("first_id", F.col("members")[0]["id"]), "points")
    probes = left.groupBy("vkey").agg(F.first("grp").alias("grp"), F.first("vec").alias("vec"))

    hits = _search(probes, points, keep, p)
    members = points.select(F.col("vkey").alias("nkey"), "members")
    # Per distinct query vector the candidates are at most `keep` vectors with `keep`
    # members each; rows with equal vectors share the list.
    flat = hits.join(members, "nkey").select("vkey", "distance", F.explode("members").alias("m"))
    flat = flat.select("vkey", "distance", F.col("m.id").alias("neighbor"), F.col("m.payload").alias("payload"))
    best = Window.partitionBy("vkey").orderBy("distance", "neighbor")
    flat = flat.withColumn("r", F.row_number().over(best)).where(F.col("r") <= keep)
    lists = flat.groupBy("vkey").agg(
        F.sort_array(F.collect_list(F.struct("distance", "neighbor", "payload"))).alias("found")
    )
    matched = left.select(F.col("id").alias("query"), "vkey").join(lists, "vkey")
    found = F.col("found")
    if exclude_self:
        found = F.filter(found, lambda h: h["neighbor"] != F.col("query"))
    result = matched.select("query", F.posexplode(F.slice(found, 1, k)).alias("pos", "hit")).select(
        "query",
        F.col("hit.neighbor").alias("neighbor"),
        F.col("hit.distance").alias("distance"),
        (F.col("pos") + 1).alias("rank"),
        F.col("hit.payload").alias("payload"),
    )
    return result if payload else result.drop("payload")


def _search(probes: DataFrame, points: DataFrame, k: int, p: float) -> DataFrame:
    """(vkey, nkey, first_id, distance): the k nearest distinct vectors of each query."""
    size = points.count()
    rows_each = block_rows(size)
    pivots = _pivots(points, min(MAX_PIVOTS, max(1, CELLS_PER_BLOCK * size // rows_each)))

    near = _nearest_pivot(pivots, p)(F.col("vec"))
    placed = points.withColumn("near", near).select(
        F.col("vkey").alias("nkey"),
        "first_id",
        "grp",
        "vec",
        F.col("near.cell").alias("cell"),
        F.col("near.distance").alias("to_pivot"),
    )
    placed = materialize(placed, "cells")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    areas = _areas(pivots, [counts.get(c, 0) for c in range(len(pivots))], rows_each)
    area = F.element_at(F.array(*map(F.lit, areas)), F.col("cell") + 1).alias("area")
    cells = placed.groupBy("grp", "cell").agg(
        F.min("to_pivot").alias("low"), F.max("to_pivot").alias("high"), F.count(F.lit(1)).alias("rows")
    )
    together = Window.partitionBy("grp", "area")
    blocks_of = F.ceil(F.sum("rows").over(together) / rows_each).cast("int")
    cells = cells.select("*", area).withColumn("blocks", blocks_of)
    table = cells.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct("cell", "low", "high", "area", "blocks"))).alias("cells")
    )
    block = F.pmod(hash32("nkey"), F.col("blocks").cast("bigint")).cast("int")
    blocks = (
        placed.join(cells.select("grp", "cell", "area", "blocks"), ["grp", "cell"])
        .withColumn("block", block)
        .select("grp", "area", "block", "nkey", "first_id", "vec")
    )

    # First pass: one block of the area of the cell whose pivot is nearest.
    probes = materialize(probes, "probes")
    held = rows_if_small(cells.select("grp", "cell", "low", "high", "area", "blocks"), MAX_CELLS)
    if held is None:
        routed = probes.join(table, "grp").withColumn("to", _pivot_bounds(pivots, p)(F.col("vec")))

        def to_pivot(c):
            return F.element_at("to.distance", c["cell"] + 1)

        ranked = F.transform("cells", lambda c: F.struct(to_pivot(c).alias("d"), c["area"].alias("area"), c["blocks"].alias("blocks")))
        first = routed.withColumn("n", F.array_min(ranked))
    else:
        groups = _groups(held)
        first = probes.withColumn("n", _nearest_cell(groups, pivots, p)("grp", "vec")).where("n.blocks > 0")
    first = first.select(
        "vkey",
        "grp",
        F.col("n.area").alias("area"),
        F.pmod(hash32("vkey"), F.col("n.blocks").cast("bigint")).cast("int").alias("block"),
    )
    first = materialize(first.withColumn("bound", F.lit(float("inf"))), "first-visits")
    found = _match(first, probes, blocks, k, p, rows_each)
    if size <= rows_each:
        return found
    found = materialize(found, "first-pass")
    per_query = Window.partitionBy("vkey").orderBy("distance", "first_id")
    numbered = found.withColumn("r", F.row_number().over(per_query))
    bound = numbered.where(F.col("r") == k).select("vkey", F.col("distance").alias("bound"))

    # Second pass: every other block that the triangle inequality does not exclude.
    if held is None:
        visits = _second_visits(routed, bound, first, to_pivot)
    else:
        seen = probes.select("vkey", "grp", "vec").join(first.select("vkey", "area", "block"), "vkey").join(bound, "vkey", "left")
        seen = seen.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        visits = _routed_visits(seen.select("vkey", "grp", "vec", "area", "block", "bound"), groups, pivots, p)
    visits = materialize(visits, "visits")
    both = found.unionByName(_match(visits, probes, blocks, k, p, rows_each))
    return both.withColumn("r", F.row_number().over(per_query)).where(F.col("r") <= k).drop("r")


def _groups(held: list) -> dict[str, dict[str, np.ndarray]]:
    """By group its cells in the order of their areas, and where each area starts."""
    frame = pd.DataFrame([tuple(r) for r in held], columns=["grp", "cell", "low", "high", "area", "blocks"])
    out = {}
    for grp, part in frame.groupby("grp"):
        part = part.sort_values(["area", "cell"])
        own = {name: part[name].to_numpy() for name in ("cell", "low", "high", "area", "blocks")}
        own["start"] = np.flatnonzero(np.diff(own["area"], prepend=-1))
        out[grp] = own
    return out


def _by_group(grp: np.ndarray, groups: dict, rows_each: int):
    """Row numbers of one group at a time, in pieces."""
    for name in pd.unique(grp):
        if name in groups:
            rows = np.flatnonzero(grp == name)
            for at in range(0, len(rows), rows_each):
                yield groups[name], rows[at : at + rows_each]


def _nearest_cell(groups: dict, pivots: np.ndarray, p: float):
    """Area and blocks of the group's cell whose pivot is nearest; no blocks without a cell."""
    step = max(1, TILE_CELLS // len(pivots))

    @F.pandas_udf("area int, blocks int")
    def nearest(grp: pd.Series, vec: pd.Series) -> pd.DataFrame:
        x, area, blocks = stack(vec), np.zeros(len(vec), np.int32), np.zeros(len(vec), np.int32)
        for own, rows in _by_group(grp.to_numpy(), groups, step):
            best = minkowski(x[rows], pivots[own["cell"]], p).argmin(axis=1)
            area[rows], blocks[rows] = own["area"][best], own["blocks"][best]
        return pd.DataFrame({"area": area, "blocks": blocks})

    return nearest


def _routed_visits(seen: DataFrame, groups: dict, pivots: np.ndarray, p: float) -> DataFrame:
    """(query, block) of all blocks within a query's bound but the one it has seen; ids only."""
    step = max(1, TILE_CELLS // len(pivots))
    between = minkowski(pivots, pivots, p)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, vkey, grp = list_matrix(batch.column(2)), batch.column(0), batch.column(1)
            area, block, bound = (batch.column(i).to_numpy() for i in (3, 4, 5))
            for own, rows in _by_group(grp.to_numpy(zero_copy_only=False), groups, step):
                distance, least = _bounds(x[rows], pivots, between, p)
                d = distance[:, own["cell"]]
                nearest = np.maximum(np.maximum(d - own["high"], own["low"] - d), least[:, own["cell"]])
                inside = np.logical_or.reduceat(nearest <= bound[rows, None] + SLACK, own["start"], axis=1)
                at, which = np.nonzero(inside)
                which = own["start"][which]
                times = own["blocks"][which]
                to_block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, to_area = np.repeat(rows[at], times), np.repeat(own["area"][which], times)
                new = (to_area != area[at]) | (to_block != block[at])
                at = at[new]
                columns = [vkey.take(pa.array(at)), grp.take(pa.array(at))]
                columns += [pa.array(v[new].astype(np.int32)) for v in (to_area, to_block)] + [pa.array(bound[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["vkey", "grp", "area", "block", "bound"])

    return seen.mapInArrow(route, "vkey string, grp string, area int, block int, bound double")


def _second_visits(routed: DataFrame, bound: DataFrame, first: DataFrame, to_pivot) -> DataFrame:
    """(query, block) of all blocks within a query's bound but the one it has seen; ids only."""
    limited = routed.join(bound, "vkey", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    within = F.filter(
        "cells",
        lambda c: F.greatest(to_pivot(c) - c["high"], c["low"] - to_pivot(c), F.element_at("to.least", c["cell"] + 1))
        <= F.col("bound") + SLACK,
    )
    areas = F.array_distinct(F.transform(within, lambda c: F.struct(c["area"].alias("area"), c["blocks"].alias("blocks"))))
    every = F.explode(F.sequence(F.lit(0), F.col("c.blocks") - 1))
    return (
        limited.select("vkey", "grp", "bound", F.explode(areas).alias("c"))
        .select("vkey", "grp", F.col("c.area").alias("area"), every.alias("block"), "bound")
        .join(first.select("vkey", "area", "block"), ["vkey", "area", "block"], "left_anti")
    )


def _areas(pivots: np.ndarray, counts: list[int], rows_each: int) -> list[int]:
    """For each cell the number of its area: pivots are halved along their widest direction until a half fits a block."""
    areas, open_parts, number = [0] * len(pivots), [np.arange(len(pivots))], 0
    weight = np.array(counts, dtype=np.float64)
    while open_parts:
        part = open_parts.pop()
        if len(part) == 1 or weight[part].sum() <= rows_each:
            for cell in part:
                areas[cell] = number
            number += 1
            continue
        off = pivots[part] - pivots[part].mean(axis=0)
        along = off @ np.linalg.svd(off, full_matrices=False)[2][0]
        order = part[np.argsort(along, kind="stable")]
        total = np.cumsum(weight[order])
        cut = int(np.clip(np.searchsorted(total, total[-1] / 2) + 1, 1, len(order) - 1))
        open_parts += [order[:cut], order[cut:]]
    return areas


def _pivots(points: DataFrame, count: int) -> np.ndarray:
    rows = points.select("vec", hash32("vkey").alias("h"), "vkey").orderBy("h", "vkey").limit(count).collect()
    return np.array([r["vec"] for r in rows], dtype=np.float64)


def _pivot_bounds(pivots: np.ndarray, p: float):
    """Of each vector the distances to all pivots, and how far it is at least from what lies nearest to each.

    A row of another pivot's cell lies beyond the points that are as far from both pivots.
    """
    between = minkowski(pivots, pivots, p)

    @F.pandas_udf("distance array<double>, least array<double>")
    def bounds(vec: pd.Series) -> pd.DataFrame:
        distance, least = _bounds(stack(vec), pivots, between, p)
        return pd.DataFrame({"distance": list(distance), "least": list(least)})

    return bounds


def _bounds(x: np.ndarray, pivots: np.ndarray, between: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    d = minkowski(x, pivots, p)
    own = d.argmin(axis=1)
    nearest = d[np.arange(len(d)), own][:, None]
    if p != 2:
        return d, (d - nearest) / 2.0
    gap = between[own]
    doubt = 1e-12 * d * d
    return d, np.divide(d * d - nearest * nearest - doubt, 2.0 * gap, where=gap > 0, out=np.zeros_like(d))


def _nearest_pivot(pivots: np.ndarray, p: float):
    @F.pandas_udf("cell int, distance double")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        x = stack(vec)
        cell = _nearest(x, pivots, p) if len(x) else np.zeros(0, int)
        return pd.DataFrame({"cell": cell.astype("int32"), "distance": minkowski_pairs(x, pivots[cell], p) if len(x) else []})

    return nearest


def _match(visits: DataFrame, probes: DataFrame, blocks: DataFrame, k: int, p: float, rows_each: int) -> DataFrame:
    """The k nearest vectors of a block for each query that visits it, as far as its bound.

    Visits name queries; their vectors come from `probes` on the way to the block.

    The queries of one block are spread over chunks, so neither side of a group is much
    larger than a block; the block's rows are repeated once per chunk in use.
    """
    keys = ["grp", "area", "block"]
    load = visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (4 * rows_each)).cast("int").alias("chunks"))
    asked = visits.join(probes.select("vkey", "vec"), "vkey").join(load, keys).withColumn("chunk", F.pmod(F.xxhash64("vkey"), F.col("chunks").cast("bigint")).cast("int"))
    served = blocks.join(load, keys).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    id_type = blocks.schema["first_id"].dataType.simpleString()

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vkey": [], "nkey": [], "first_id": [], "distance": []})
        right = right.sort_values("first_id")
        rows, cols, distances = nearest_in_block(stack(left["vec"]), left["bound"].to_numpy(), stack(right["vec"]), k, p)
        picked = right.iloc[cols]
        return pd.DataFrame(
            {
                "vkey": left["vkey"].to_numpy()[rows],
                "nkey": picked["nkey"].to_numpy(),
                "first_id": picked["first_id"].to_numpy(),
                "distance": distances,
            }
        )

    key = [*keys, "chunk"]
    return (
        asked.select(*key, "vkey", "vec", "bound")
        .groupBy(*key)
        .cogroup(served.select(*key, "nkey", "first_id", "vec").groupBy(*key))
        .applyInPandas(search, f"vkey string, nkey string, first_id {id_type}, distance double")
    )


def nearest_in_block(a: np.ndarray, bound: np.ndarray, b: np.ndarray, k: int, p: float):
    """(row of a, row of b, distance) of the k nearest rows of b, as far as each bound; ties to the earlier row.

    The part of b around the nearest pivot bounds a query's distances; rows of b within the bound
    are then compared exactly. For the Euclidean distance they are found by inner products, whose
    rounding only lets more rows through. Many coordinates need no parts, see `_sieved`.
    """
    take = min(k, len(b))
    if a.shape[1] > BOX_WIDTH and _fits(a, b, p):
        return _sieved(a, bound, b, take, p)
    count = max(1, len(b) // max(PART_ROWS, 4 * k))
    pivots = b[np.linspace(0, len(b) - 1, count).astype(int)]
    part = _nearest(b, pivots, p)
    by_part = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[by_part], np.arange(count + 1))
    asked = _nearest(a, pivots, p)
    limit = bound.astype(np.float64).copy()
    turn = np.argsort(asked, kind="stable")
    for own in np.split(turn, np.flatnonzero(np.diff(asked[turn])) + 1):
        rows = by_part[edges[asked[own[0]]] : edges[asked[own[0]] + 1]] if len(own) else own
        if len(rows) >= take:
            step = max(1, TILE_CELLS // len(rows))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                limit[some] = np.minimum(limit[some], np.partition(minkowski(a[some], b[rows], p), take - 1, axis=1)[:, take - 1])

    # Queries come in boxes of neighbours; only leaves of b that reach into a box are looked at.
    leaves = _leaves(b)
    low, high = (np.array([cut(b[leaf], axis=0) for leaf in leaves]) for cut in (np.min, np.max))
    reach = np.where(np.isinf(limit), np.inf, limit + SLACK)
    out = []
    for own in _leaves(a):
        gap = np.maximum(np.maximum(low - a[own].max(axis=0), a[own].min(axis=0) - high), 0.0)
        away = (gap**p).sum(axis=1) ** (1.0 / p)
        near = np.flatnonzero(away <= reach[own].max())
        if not len(near):
            continue
        cols = np.sort(np.concatenate([leaves[i] for i in near])) if len(near) < len(leaves) else None
        found = _compared(a[own], limit[own], b if cols is None else b[cols], take, p)
        out.append((own[found[0]], found[1] if cols is None else cols[found[1]], found[2]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    rows, cols, distance = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], distance[order]


def _leaves(rows: np.ndarray) -> list[np.ndarray]:
    """Row numbers of boxes of at most `LEAF_ROWS`, halved along their widest coordinate.

    With more than `BOX_WIDTH` coordinates boxes exclude next to nothing, and all rows stay together.
    """
    if rows.shape[1] > BOX_WIDTH:
        return [np.arange(len(rows))]
    done, todo = [], [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        if len(part) <= LEAF_ROWS:
            done.append(part)
            continue
        widest = np.ptp(rows[part], axis=0).argmax()
        half = len(part) // 2
        order = part[np.argpartition(rows[part, widest], half)]
        todo += [order[:half], order[half:]]
    return done


def _compared(a: np.ndarray, limit: np.ndarray, b: np.ndarray, take: int, p: float):
    """(row of a, row of b, distance) of the nearest rows of b by tiles; fewer than `take` if the limits say so.

    A rough number for each pair (inner products, or sums in single precision) lets through every row
    within the limit, and some beyond it by their rounding; these are compared exactly.
    """
    middle = b.mean(axis=0)
    left, right = a - middle, b - middle
    left_size, right_size = (left * left).sum(1), (right * right).sum(1)
    rounding = 1e-12 * (left_size + right_size.max())
    if p != 2:
        # Powers of gaps in single precision are off by less than this share of the largest gap there is.
        widest = np.abs(left).max(axis=1) + np.abs(right).max()
        fits = bool(np.isfinite(widest).all()) and widest.max(initial=0.0) ** p * a.shape[1] < 1e37
        share = 1e-5 if fits and widest.min(initial=1.0) ** p > 1e-30 else 1e-13
        off = share * max(1.0, p) * a.shape[1] ** (1.0 / p) * widest
        if share == 1e-5:
            left, right = left.astype(np.float32), right.astype(np.float32)
    out = []
    step = max(1, (TILE_CELLS if p == 2 else TILE_CELLS >> 4) // len(b))
    for start in range(0, len(a), step):
        tile = slice(start, start + step)
        if p == 2:
            apart = left_size[tile, None] + right_size[None, :] - 2.0 * (left[tile] @ right.T)
            edge = (limit[tile] + SLACK) ** 2 + rounding[tile]
        else:
            apart, edge = powers(left[tile], right, p), (limit[tile] + SLACK + off[tile]) ** p
        wide = np.flatnonzero(np.isinf(edge))
        if len(wide):
            more = np.partition(apart[wide], take - 1, axis=1)[:, take - 1]
            if p == 2:
                edge[wide] = more + (2.0 * rounding[tile][wide] + SLACK * (1.0 + 2.0 * np.sqrt(np.abs(more))))
            else:
                edge[wide] = (more.astype(np.float64) ** (1.0 / p) + 2.0 * off[tile][wide] + SLACK) ** p
        # An edge is compared in the tile's precision, never rounded down.
        rows, cols = np.nonzero(apart <= np.nextafter(edge.astype(apart.dtype), np.inf, dtype=apart.dtype)[:, None])
        distance = np.round(_pair_distances(a[tile], b, rows, cols, p), DIGITS)
        order = np.lexsort((cols, distance, rows))
        rows, cols, distance = rows[order], cols[order], distance[order]
        first = np.searchsorted(rows, rows, side="left")
        best = np.arange(len(rows)) - first < take
        out.append((rows[best] + start, cols[best], distance[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _fits(a: np.ndarray, b: np.ndarray, p: float) -> bool:
    """Whether powers of gaps neither overflow nor vanish in single precision."""
    widest = np.abs(a - b[0]).max(initial=0.0) + np.abs(b - b[0]).max()
    power = max(p, 2.0)
    return bool(p >= 1 and np.isfinite(widest) and widest**power * a.shape[1] < 1e36 and widest**power > 1e-30)


def _lift(b: np.ndarray, p: float):
    """A map of rows whose squared Euclidean distance is at most the distance to the power of its second value, times its third.

    From p = 2 on it is the row itself, by the inequality of power means. Below, each coordinate is cut at
    quantiles of b; with u the covered share of a span of width w, sqrt(w) * (u, sqrt(u * (1 - u))) is at the
    squared distance w * |u - v| if u or v is 0 or 1, and at most that if both are inside.
    """
    size = b.shape[1]
    if p >= 2:
        return (lambda x: x - b[0]), 2.0, size ** (1.0 - 2.0 / p)
    edges = np.quantile(b, np.linspace(0.0, 1.0, SPANS + 1), axis=0, method="lower")
    wide = np.diff(edges, axis=0)

    def lifted(x: np.ndarray) -> np.ndarray:
        share = np.divide(x[:, None, :] - edges[None, :-1], wide, where=wide > 0, out=np.zeros((len(x), *wide.shape)))
        np.clip(share, 0.0, 1.0, out=share)
        out = np.stack([share, np.sqrt(share * (1.0 - share))], axis=1) * np.sqrt(wide)
        return out.reshape(len(x), -1)

    return lifted, 1.0, size ** (1.0 - 1.0 / p)


def _sieved(a: np.ndarray, limit: np.ndarray, b: np.ndarray, take: int, p: float):
    """(row of a, row of b, distance) of the nearest rows of b as far as each limit, for many coordinates.

    Products in single precision bound the distances of a small tile from below; what they let through is
    compared in single precision if the metric is not the Euclidean one, and then exactly. A query
    without a limit, or with one that excludes little, gets one from the rows with the least bounds.
    """
    lifted, power, factor = _lift(b, p)
    right = lifted(b)
    middle = right.mean(axis=0)
    right -= middle
    # Each product is off by less than this share of the two squared lengths; the columns carry their part.
    share = 1.2e-7 * (right.shape[1] + 16)
    right_size = (right * right).sum(axis=1) * (1.0 - share)
    right = np.column_stack([-2.0 * right, right_size]).astype(np.float32)
    doubt = 1e-7 * np.ptp(b, axis=0).sum() if power == 1 else 0.0
    a32, b32 = (a - b[0]).astype(np.float32), (b - b[0]).astype(np.float32)
    off = 1e-5 * p * a.shape[1] ** (1.0 / p) * (float(np.abs(a32).max(initial=0.0)) + float(np.abs(b32).max()))
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]

    def placed(own: np.ndarray, bound: np.ndarray):
        """The rows, their columns of the product, and how large an entry within the bound can be."""
        left = lifted(a[own]) - middle
        left_size = (left * left).sum(axis=1) * (1.0 - share)
        room = ((bound + SLACK) ** power * factor * (1.0 + 1e-9) + doubt - left_size).astype(np.float32)
        return a[own], np.column_stack([left, np.ones(len(left))]).astype(np.float32), np.nextafter(room, np.float32(np.inf))

    def compare(own: np.ndarray, tile: np.ndarray, bound: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        if p != 2:
            rough = a32[own]
            near = [_roughly(rough, b32, rows[at : at + PAIRS], cols[at : at + PAIRS], p) for at in range(0, len(rows), PAIRS)]
            kept = np.concatenate(near) <= ((bound + SLACK + off) ** p)[rows] if near else np.zeros(0, bool)
            rows, cols = rows[kept], cols[kept]
        distance = np.round(_pair_distances(tile, b, rows, cols, p), DIGITS)
        order = np.lexsort((cols, distance, rows))
        rows, cols, distance = rows[order], cols[order], distance[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < take
        out.append((own[rows[best]], cols[best].astype(int), distance[best]))

    # Limited queries: products in small tiles, compared while they are in the processor's cache.
    limit = np.asarray(limit, dtype=np.float64)
    limited, loose = np.flatnonzero(np.isfinite(limit)), [np.flatnonzero(~np.isfinite(limit))]
    held = np.empty((TILE_ROWS, TILE_COLUMNS), dtype=np.float32)
    for start in range(0, len(limited), TILE_ROWS):
        own = limited[start : start + TILE_ROWS]
        tile, left, room = placed(own, limit[own])
        found = []
        for at in range(0, len(b), TILE_COLUMNS):
            part = right[at : at + TILE_COLUMNS]
            apart = np.matmul(left, part.T, out=held[: len(left), : len(part)])
            rows, cols = np.divmod(np.flatnonzero(apart <= room[:, None]).astype(np.int32), np.int32(len(part)))
            found.append((rows, cols + np.int32(at)))
        rows, cols = (np.concatenate(x) for x in zip(*found))
        many = np.bincount(rows, minlength=len(own)) > max(4 * take, len(b) // 8)
        if many.any():
            loose.append(own[many])
            kept = ~many[rows]
            rows, cols = rows[kept], cols[kept]
        compare(own, tile, limit[own], rows, cols)

    # The others: whole rows of the product, whose least entries give a limit.
    every = np.concatenate(loose)
    step = max(1, TILE_CELLS // len(b))
    for start in range(0, len(every), step):
        own = every[start : start + step]
        tile, left, _ = placed(own, limit[own])
        apart = left @ right.T
        picks = np.argpartition(apart, take - 1, axis=1)[:, :take]
        reached = _pair_distances(tile, b, np.repeat(np.arange(len(own)), take), picks.ravel(), p).reshape(-1, take).max(axis=1)
        bound = np.minimum(limit[own], reached)
        room = placed(own, bound)[2]
        compare(own, tile, bound, *np.divmod(np.flatnonzero(apart <= room[:, None]), len(b)))
    rows, cols, distance = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(rows, kind="stable")
    return rows[order], cols[order], distance[order]


def _roughly(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray, p: float) -> np.ndarray:
    """Distances of some pairs to the power p, in the precision of the rows."""
    gap = a[rows]
    gap -= b[cols]
    np.abs(gap, out=gap)
    if p == 1:
        return gap.sum(axis=1)
    return np.einsum("ij,ij->i", gap * gap, gap) if p == 3 else (gap**p).sum(axis=1)


def _nearest(rows: np.ndarray, pivots: np.ndarray, p: float) -> np.ndarray:
    step = max(1, TILE_CELLS // len(pivots))
    return np.concatenate([minkowski(rows[at : at + step], pivots, p).argmin(axis=1) for at in range(0, len(rows), step)])


def _pair_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray, p: float) -> np.ndarray:
    """The same numbers as `minkowski`, for some pairs only."""
    out = [minkowski_pairs(a[rows[at : at + TILE_CELLS]], b[cols[at : at + TILE_CELLS]], p) for at in range(0, len(rows), TILE_CELLS)]
    return np.concatenate(out) if out else np.zeros(0)
