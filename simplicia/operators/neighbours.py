"""Near neighbours and spanning trees of clouds of any size.

Clouds of up to SMALL points are a row each and go through a kernel, so they cost one shuffle and no join. Larger ones are dealt
by grid cells rather than by cloud: a cloud's box is halved level by level into cells (of the first three coordinates; a
point's other coordinates only count in distances, so a cell search stays exact). A task sees the points of some cells, never
such a whole cloud, and no stage makes all pairs of one. Equal points are one place, so copies don't pair with each other.

Joins of the grid are marked for sorting: Spark's size rule goes by the bytes of a Parquet file, of which a hash table
on the driver takes many times as much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from simplicia.sources.store import stored

#: Points of a cloud that the kernels take whole (a matrix of 2 MB).
SMALL = 512
#: Levels of halving; points of unlike places share a cell of the last one only if they lie within 2^-LEVELS of the box.
LEVELS = 20


def _distance(a: list[str], b: list[str]) -> Column:
    return F.sqrt(sum(((F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)), start=F.lit(0.0)))


def _boxes(places: DataFrame, key: str, coordinates: list[str]) -> DataFrame:
    """places with the corner of their cloud's box and its longest side (1 for a cloud of one place)."""
    grid = coordinates[:3]
    side = F.greatest(*(F.max(c) - F.min(c) for c in grid)) if len(grid) > 1 else F.max(grid[0]) - F.min(grid[0])
    box = places.groupBy(key).agg(*(F.min(c).alias(f"_o_{c}") for c in grid), side.alias("_side"))
    return places.join(box.withColumn("_side", F.when(F.col("_side") > 0, F.col("_side")).otherwise(1.0)).hint("merge"), key)


def _cell(coordinates: list[str], size: Column, shift: Column | None = None) -> Column:
    """The cell of a point in cells of a size, as an array of numbers; with a shift that of a neighbour."""
    parts = [F.floor((F.col(c) - F.col(f"_o_{c}")) / size) for c in coordinates[:3]]
    return F.array(*(p + F.get(shift, F.lit(k)) if shift is not None else p for k, p in enumerate(parts)))


def _around(n: int) -> Column:
    steps = [()]
    for _ in range(n):
        steps = [(*s, k) for s in steps for k in (-1, 0, 1)]
    return F.array(*(F.array(*(F.lit(k).cast("long") for k in s)) for s in steps))


def _gap(coordinates: list[str], size: Column, cell: Column) -> Column:
    """Distance of a point to a cell in the coordinates of the grid."""
    parts = []
    for k, c in enumerate(coordinates[:3]):
        x, low = F.col(c) - F.col(f"_o_{c}"), F.get(cell, F.lit(k)) * size
        parts.append(F.greatest(low - x, x - low - size, F.lit(0.0)))
    return F.sqrt(sum((p * p for p in parts), start=F.lit(0.0)))


def _places(cloud: DataFrame, key: str, point: str, coordinates: list[str], k: int) -> DataFrame:
    """Distinct points: key, coordinates, copies, ids (the k first of them) and id, the first."""
    w = Window.partitionBy(key, *coordinates).orderBy(point)
    first = cloud.select(key, point, *coordinates).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    ids = first.groupBy(key, *coordinates).agg(F.sort_array(F.collect_list(point)).alias("ids"))
    copies = cloud.groupBy(key, *coordinates).agg(F.count("*").alias("copies"))
    return ids.join(copies.hint("merge"), [key, *coordinates]).withColumn("id", F.get("ids", F.lit(0)))


def by_size(cloud: DataFrame, key: str, coordinates: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The points (none of their coordinates null) of clouds of up to `most` points, and those of the others, None if there
    are no others."""
    whole = cloud.dropna(subset=[key, *coordinates])
    large = stored(whole.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(key), "large")
    if large.isEmpty():
        return whole, None
    large = large.hint("merge")
    return whole.join(large, key, "left_anti"), whole.join(large, key, "left_semi")


def by_cloud(cloud: DataFrame, key: str, point: str, coordinates: list[str], found, schema: str) -> DataFrame:
    """Rows that a kernel finds in each cloud: found(points, coordinates as a matrix) gives the columns behind the key, with points
    in ascending order. A task takes its clouds in Arrow batches and puts out no more than some clouds' rows at once."""
    kinds = dict(cloud.dtypes)
    rows = F.sort_array(F.collect_list(F.struct(F.col(point).alias("p"), *(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(coordinates)))))
    # a number of partitions that stays, as a cloud costs its points squared
    dealt = cloud.repartition(int(cloud.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    got = dealt.groupBy(key).agg(rows.alias("_rows")).select(key, F.col("_rows.p").alias("p"), *(F.col(f"_rows.c{k}").alias(f"c{k}") for k in range(len(coordinates))))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            flat = {c: b.column(c).flatten() for c in b.schema.names[1:]}
            ends = np.append(0, np.cumsum(pc.list_value_length(b.column("p")).to_numpy()))
            x = np.column_stack([flat[f"c{k}"].to_numpy(zero_copy_only=False) for k in range(len(coordinates))])
            parts, held = [], 0

            def out(parts):
                owners = np.concatenate([np.full(len(p[1][0]), p[0]) for p in parts])
                columns = [np.concatenate(c) for c in zip(*(p[1] for p in parts), strict=True)]
                columns = [flat["p"].take(pa.array(c)) if c.dtype.kind == "i" and at < 2 else pa.array(c) for at, c in enumerate(columns)]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owners)), *columns], names=names)

            for o in range(b.num_rows):
                low, high = ends[o], ends[o + 1]
                got = found(x[low:high])
                parts.append((o, [low + got[0], low + got[1], *got[2:]]))
                held += len(got[0])
                if held > 200_000:
                    yield out(parts)
                    parts, held = [], 0
            if parts:
                yield out(parts)

    names = [key, *(f.strip().split()[0] for f in schema.split(","))]
    return got.mapInArrow(run, f"{key} {kinds[key]}, " + schema.replace("POINT", kinds[point]))


def _squares(x):
    """Squared distances of all rows, coordinate by coordinate as the grid's expressions add them up."""
    import numpy as np

    out = np.zeros((len(x), len(x)))
    for c in x.T:
        step = c[:, None] - c[None, :]
        out += step * step
    return out


def _nearest_whole(k: int):
    def found(x):
        import numpy as np

        n = len(x)
        most = min(k, n - 1)
        d = np.sqrt(_squares(x))
        order = np.argsort(d, axis=1, kind="stable")  # ties by number, as points ascend
        others = order[order != np.arange(n)[:, None]].reshape(n, n - 1)[:, :most].ravel()
        own = np.repeat(np.arange(n), most)
        return own, others, d[own, others], np.tile(np.arange(1, most + 1, dtype=np.int32), n)

    return found


def nearest(cloud: DataFrame, key: str, point: str, coordinates: list[str], k: int) -> DataFrame:
    """key, i, j, d, rank: the k nearest other points of every point (all, if there are fewer), ties by number. Clouds of up to
    SMALL points go through a kernel, larger ones through the grid."""
    small, large = by_size(cloud.select(key, point, *coordinates), key, coordinates, SMALL)
    out = by_cloud(small, key, point, coordinates, _nearest_whole(k), "i POINT, j POINT, d double, rank int")
    return out if large is None else stored(out.unionByName(nearest_by_cells(large, key, point, coordinates, k)), "nearest")


def nearest_by_cells(cloud: DataFrame, key: str, point: str, coordinates: list[str], k: int) -> DataFrame:
    """The neighbours that `nearest` gives, of clouds of any size.

    A place takes the deepest cell around it that holds k + 1 points. The distance of the k-th of them bounds the search: the
    cells around it at the deepest level whose cells are at least that wide, as far as they reach into the bound."""
    places = stored(_boxes(_places(cloud, key, point, coordinates, k + 1), key, coordinates), "places")
    size = lambda level: F.col("_side") * F.pow(F.lit(0.5), level)
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    at = places.select(key, "id", "copies", "ids", "_side", *coordinates, *(f"_o_{c}" for c in coordinates[:3]), level.alias("level"))
    at = at.withColumn("cell", _cell(coordinates, size(F.col("level"))))
    counts = at.groupBy(key, "level", "cell").agg(F.sum("copies").alias("held")).hint("merge")
    home = at.join(counts, [key, "level", "cell"]).filter((F.col("held") > k) | (F.col("level") == 0)).groupBy(key, "id").agg(F.max("level").alias("level")).hint("merge")
    asked = at.join(home, [key, "id", "level"])
    renamed = [F.col(c).alias(f"_b_{c}") for c in coordinates]
    index = at.select(key, "level", "cell", F.col("ids").alias("others"), *renamed).hint("merge")
    others = [f"_b_{c}" for c in coordinates]
    best = lambda met, extra: (  # noqa: E731  the k + 1 first of what each place meets, itself among them
        met.select(key, "id", *extra, _distance(coordinates, others).alias("d"), F.explode("others").alias("j"))
        .withColumn("rank", F.row_number().over(Window.partitionBy(key, "id").orderBy("d", "j")))
        .filter(F.col("rank") <= k + 1)
    )
    bound = best(asked.select(key, "id", "level", "cell", *coordinates).join(index, [key, "level", "cell"]), []).groupBy(key, "id").agg(F.max("d").alias("reach"), F.count("*").alias("found")).hint("merge")
    # a cloud with no more than k others is searched whole
    reach = F.when(F.col("found") > k, F.col("reach")).otherwise(F.col("_side") * 4)
    wide = places.join(bound, [key, "id"]).withColumn("reach", reach)
    fits = F.when(F.col("reach") > 0, F.floor(F.log2(F.col("_side") / F.col("reach")) - 1e-9)).otherwise(F.lit(LEVELS))
    search = wide.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), fits)).cast("int")).withColumn("way", F.explode(_around(len(coordinates[:3]))))
    search = search.withColumn("cell", _cell(coordinates, size(F.col("level")), F.col("way"))).filter(_gap(coordinates, size(F.col("level")), F.col("cell")) <= F.col("reach") * (1 + 1e-9))
    lists = best(search.select(key, "id", "level", "cell", *coordinates).join(index, [key, "level", "cell"]), [])
    named = cloud.select(key, F.col(point).alias("i"), *coordinates).join(places.select(key, "id", *coordinates).hint("merge"), [key, *coordinates]).select(key, "i", "id")
    out = named.join(lists.select(key, "id", "j", "d").hint("merge"), [key, "id"]).filter("i <> j")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key, "i").orderBy("d", "j"))).filter(F.col("rank") <= k).select(key, "i", "j", "d", "rank")


def _within(places: DataFrame, key: str, coordinates: list[str]) -> DataFrame:
    """key, a, b, d: places of different components (comp) within their cloud's radius. Only cells that don't lie, with
    all their neighbours, in one component take part."""
    grid = coordinates[:3]
    at = places.withColumn("cell", _cell(coordinates, F.col("radius")))
    pure = at.groupBy(key, "cell").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"))
    spread = pure.withColumn("way", F.explode(_around(len(grid)))).select(key, F.array(*(F.get("cell", F.lit(k)) + F.get("way", F.lit(k)) for k in range(len(grid)))).alias("cell"), "_low", "_high")
    mixed = spread.groupBy(key, "cell").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).filter("_low < _high").select(key, "cell").hint("merge")
    asked = at.join(mixed, [key, "cell"], "left_semi")
    a = asked.select(key, F.col("id").alias("a"), F.col("comp").alias("ca"), "radius", *coordinates, F.explode(_around(len(grid))).alias("way"), F.col("cell").alias("_c"))
    a = a.withColumn("cell", F.array(*(F.get("_c", F.lit(k)) + F.get("way", F.lit(k)) for k in range(len(grid))))).drop("_c", "way")
    b = at.select(key, "cell", F.col("id").alias("b"), F.col("comp").alias("cb"), *(F.col(c).alias(f"_b_{c}") for c in coordinates))
    met = a.join(b.hint("merge"), [key, "cell"]).filter("ca <> cb and a < b").withColumn("d", _distance(coordinates, [f"_b_{c}" for c in coordinates]))
    return met.filter(F.col("d") <= F.col("radius")).select(key, "a", "b", "d")


def _spanning_whole(x):
    """The tree of one cloud by adding the nearest place each time; a place's first point stands for its copies."""
    import numpy as np

    first = np.sort(np.unique(x + 0.0, axis=0, return_index=True)[1])  # -0.0 is 0.0
    n = len(first)
    d = np.sqrt(_squares(x[first]))
    a, b, w = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1)
    best, via, inside = d[0].copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    inside[0] = True
    for at in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        a[at], b[at], w[at] = min(via[j], j), max(via[j], j), best[j]
        inside[j] = True
        nearer = d[j] < best
        best[nearer], via[nearer] = d[j][nearer], j
    return first[a], first[b], w


def spanning_edges(cloud: DataFrame, key: str, point: str, coordinates: list[str]) -> DataFrame:
    """key, a, b, d: the edges of a shortest spanning tree of the distinct points of every cloud, which are the finite bars of
    its components (death d). Clouds of up to SMALL points go through a kernel, larger ones through the grid."""
    small, large = by_size(cloud.select(key, point, *coordinates), key, coordinates, SMALL)
    out = by_cloud(small, key, point, coordinates, _spanning_whole, "a POINT, b POINT, d double")
    return out if large is None else stored(out.unionByName(spanning_edges_by_cells(large, key, point, coordinates)), "tree")


def spanning_edges_by_cells(cloud: DataFrame, key: str, point: str, coordinates: list[str]) -> DataFrame:
    """The tree that `spanning_edges` gives. A cloud of any size: edges up to a radius come from grid cells; on them every component
    takes its least edge, and the components that meet become one, until none is left within the radius; then the radius
    of the clouds that still fall apart is doubled. Ties are broken by the edge's ends, so no circle closes."""
    first = cloud.groupBy(key, *coordinates).agg(F.min(point).alias("id"))
    sized = first.join(first.groupBy(key).agg(F.count("*").alias("_n")).hint("merge"), key)
    places = _boxes(sized, key, coordinates).withColumn("radius", F.col("_side") / F.pow("_n", F.lit(1.0 / len(coordinates[:3])))).withColumn("comp", F.col("id")).drop("_n")
    places, found = stored(places, "tree-places"), []
    while True:
        apart = places.groupBy(key).agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low < _high").select(key).hint("merge")
        places = stored(places.join(apart, key, "left_semi"), "tree-places")
        if places.isEmpty():
            break
        edges = stored(_within(places, key, coordinates), "tree-edges")
        label = places.select(key, "id", "comp")
        while True:
            of = lambda end, name: label.select(key, F.col("id").alias(end), F.col("comp").alias(name)).hint("merge")  # noqa: B023, E731
            live = edges.join(of("a", "ca"), [key, "a"]).join(of("b", "cb"), [key, "b"]).filter("ca <> cb")
            ways = F.explode(F.array(F.struct(F.col("ca").alias("comp"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("comp"), F.col("ca").alias("to"))))
            least = live.select(key, F.struct("d", "a", "b").alias("edge"), ways.alias("w")).groupBy(key, "w.comp").agg(F.min_by(F.struct("edge", "w.to"), F.struct("edge")).alias("x"))
            least = stored(least.select(key, "comp", "x.edge", F.col("x.to").alias("up")), "tree-least")
            if least.isEmpty():
                break
            found.append(least.select(key, "edge.a", "edge.b", "edge.d").distinct())
            up = least.select(key, "comp", "up")
            back = up.select(key, F.col("comp").alias("up"), F.col("up").alias("_again")).hint("merge")
            # of two components that chose each other the smaller one is the root
            up = stored(up.join(back, [key, "up"], "left").select(key, "comp", F.when((F.col("_again") == F.col("comp")) & (F.col("comp") < F.col("up")), F.col("comp")).otherwise(F.col("up")).alias("up")), "tree-up")
            while True:
                over = up.select(key, F.col("comp").alias("up"), F.col("up").alias("_over")).hint("merge")
                jumped = stored(up.join(over, [key, "up"], "left").select(key, "comp", F.coalesce("_over", "up").alias("up"), (F.col("_over") != F.col("up")).alias("_moved")), "tree-up")
                up = jumped.drop("_moved")
                if jumped.filter("_moved").isEmpty():
                    break
            label = stored(label.join(up.hint("merge"), [key, "comp"], "left").select(key, "id", F.coalesce("up", "comp").alias("comp")), "tree-label")
        places = stored(places.drop("comp").join(label.hint("merge"), [key, "id"]).withColumn("radius", F.col("radius") * 2), "tree-places")
    if not found:
        return first.select(key, F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d")).filter("false")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
