"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are dealt to nodes around pivots, and nodes of more than ``BLOCK``
vectors to nodes of their own, by distance, until all are small: the upper
levels of a cover tree, each node with its centre and covering radius.  The
leaves are packed as blocks; queries are dealt to groups of at most ``GROUP``
the same way.  A group first meets the block where most of its queries are,
which gives each query's kth score so far.  Then it goes down the levels: a
node is left out if the inner product of the centres plus what both covering
radii allow stays below the group's worst kth score.  Only centres travel for
this.  The blocks that are left are streamed, once for each bucket of groups
that needs them, and inside a pair a cover tree over the queries and one over
the vectors are walked together by the same bound.

Bounds are only ever compared with ``<``, so ties are kept; among equal scores
the smaller id comes first.  A query never finds its own id.  Vectors that are
null, empty, or hold a null or non-finite component take no part; a component
that scaling takes beyond the range of a double counts as its end, and scores
are exact but end at the range of a long.  Shorter vectors count as padded with
0; rows with equal ids are all candidates, and as queries count once (the least
vector); equal vectors beyond a block's size share several blocks; an empty
table gives an empty result; k larger than the table gives all; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 4096
GROUP = 1024
LEAF = 256
FAN = 8
#: Children of a node of the upper levels, at most.
WIDE_FAN = 64
#: Rows of one node that share a task when they are dealt to its children.
SALT_ROWS = 1 << 16
#: Bytes of query vectors in a bucket of groups.
BUCKET_BYTES = 32 << 20
NONE = -(1 << 63)
MOST_DOUBLE = 1.7976931348623157e308


class Tree:
    """A cover tree over the rows of x: centres are points, children's centres are far apart, radii cover all below."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, exact: np.ndarray | None = None):
        self.x, self.ids = x, ids
        self.exact = x if exact is None else exact  # integers, where floats don't hold the products
        self.bounded = self.exact.dtype != object  # else no float holds the products, and nothing is left out
        self.rows: list[np.ndarray] = []
        self.centre: list[np.ndarray] = []
        self.norm: list[float] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        if len(x):
            self._add(np.arange(len(x)))

    def _add(self, rows: np.ndarray) -> int:
        centre = self.x[rows[0]].astype(np.float64)
        away = np.sqrt(np.square(self.x[rows] - centre).sum(axis=1))
        me = len(self.rows)
        self.rows.append(rows)
        self.centre.append(centre)
        self.norm.append(float(np.sqrt(centre @ centre)))
        self.radius.append(float(away.max()))
        self.children.append([])
        if len(rows) > LEAF and self.radius[me] > 0:
            near, owner, number = away.copy(), np.zeros(len(rows), int), 1
            # farthest first, until half the radius covers all or the fan is full
            while number < FAN and near.max() > self.radius[me] / 2:
                far = int(near.argmax())
                d = np.sqrt(np.square(self.x[rows] - self.x[rows[far]]).sum(axis=1))
                closer = d < near
                owner[closer], near[closer] = number, d[closer]
                number += 1
            parts = [rows[owner == k][np.argsort(near[owner == k], kind="stable")] for k in range(number)]
            if number > 1:
                self.children[me] = [self._add(p) for p in parts if len(p)]
        return me


class Search:
    """The k best of each query of one tree among what it has met."""

    def __init__(self, queries: Tree, k: int, floor: np.ndarray):
        self.q, self.k = queries, k
        n = len(queries.x)
        self.scores = np.full((n, k), NONE)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor  # scores that each query's kth is known to reach

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def meet(self, data: Tree) -> None:
        if not len(data.x) or not len(self.q.x):
            return
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            if data.bounded and self._bound(a, data, b) < self.kth()[self.q.rows[a]].min():
                continue
            mine, theirs = self.q.children[a], data.children[b]
            if not mine and not theirs:
                self._leaves(self.q.rows[a], data, data.rows[b])
            elif not theirs or mine and self.q.radius[a] > data.radius[b]:
                stack += [(c, b) for c in mine]
            else:
                pairs = [(a, c) for c in theirs]
                pairs.sort(key=lambda p: self._bound(p[0], data, p[1]))
                stack += pairs  # the best is met first

    def _bound(self, a: int, data: Tree, b: int) -> float:
        q, r, s = self.q, self.q.radius[a], data.radius[b]
        middle = float(q.centre[a] @ data.centre[b])
        slack = q.norm[a] * s + data.norm[b] * r + r * s
        return middle + slack + 1e-6 * (abs(middle) + slack + 1)

    def _leaves(self, rows: np.ndarray, data: Tree, others: np.ndarray) -> None:
        got = self.q.exact[rows] @ data.exact[others].T
        if got.dtype == object:
            got = np.minimum(np.maximum(got, NONE + 1), -NONE - 1)
        got = got.astype(np.int64)
        r, c = np.nonzero(got >= self.kth()[rows][:, None])
        own = self.q.ids[rows[r]] != data.ids[others[c]]
        r, c = r[own], c[own]
        if not r.size:
            return
        touched = np.unique(rows[r])
        owner = np.concatenate([rows[r], np.repeat(touched, self.k)])
        scores = np.concatenate([got[r, c], self.scores[touched].ravel()])
        found = np.concatenate([data.ids[others[c]], self.found[touched].ravel()])
        order = np.lexsort((found, ~scores, owner))  # ~ turns the order round and holds for NONE
        owner, scores, found = owner[order], scores[order], found[order]
        place = np.arange(owner.size) - np.searchsorted(owner, owner)
        best = place < self.k
        self.scores[owner[best], place[best]] = scores[best]
        self.found[owner[best], place[best]] = found[best]


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * x), as doubles, of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST_DOUBLE)))

    def floor(x):
        y = F.least(F.greatest(x * F.lit(float(scale)), F.lit(-MOST_DOUBLE)), F.lit(MOST_DOUBLE))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    return rows.select("id", F.transform("v", floor).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of each vector and each centre, without larger temporaries than the result for each centre."""
    return np.stack([np.sqrt(np.square(x - c).sum(axis=1)) for c in centres], axis=1)


def _dealt(rows: DataFrame, pivots: DataFrame, salts: int, width: int, unit: float) -> DataFrame:
    """rows (node, id, v) with the child whose pivot is nearest, and the distance.

    Pivots stand before the rows of their node; a node's rows are salted over
    several tasks, each of which gets the node's pivots.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ahead = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("node", "salt", F.lit(0).alias("kind"), F.col("child").alias("id"), "v")
    after = rows.select("node", F.pmod(F.xxhash64("id", "v"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "v")
    both = ahead.unionByName(after).repartition(n, "node", "salt").sortWithinPartitions("node", "salt", "kind", "id")

    def assign(batches):
        now, children, centres = None, [], []
        for batch in batches:
            node, salt, kind = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero((np.diff(node) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if kind[low] == 0:
                    if now != (node[low], salt[low]):
                        now, children, centres = (node[low], salt[low]), [], []
                    children.append(part.column(3).to_numpy())
                    centres.append(_matrix(part.column(4), width) / unit)
                    continue
                names, points = np.concatenate(children), np.concatenate(centres)
                for at in range(0, part.num_rows, 2048):
                    some = part.slice(at, 2048)
                    d = _distances(_matrix(some.column(4), width) / unit, points)
                    own = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(names[own]), some.column(3), some.column(4), some.column(0), pa.array(d[np.arange(own.size), own])], names=["node", "id", "v", "parent", "away"])

    return both.mapInArrow(assign, "node long, id long, v array<double>, parent long, away double")


def grow(rows: DataFrame, size: int, width: int, unit: float, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """(rows (id, v, node, part) of the leaves, nodes (node, parent, centre, radius, n) by level).

    Nodes are split by distance until they hold at most size vectors or only
    equal ones; of those, parts hold at most about size.  Each round is two
    shuffles; a node's pivots are the least by hash in each of a number of
    buckets of vectors, so they differ.
    """
    todo = rows.select(F.lit(0).cast("long").alias("node"), "id", "v")
    most, done, levels = rows.count(), None, []
    while most:
        fan = min(WIDE_FAN, max(2, 2 * math.ceil(most / size)))
        bucket = F.pmod(F.xxhash64("v", F.lit(len(levels))), F.lit(fan))
        pivots = todo.groupBy("node", bucket.alias("k")).agg(F.min_by("v", F.xxhash64("v")).alias("v"))
        pivots = materialize(pivots.select("node", (F.col("node") * (WIDE_FAN + 1) + F.col("k") + 1).alias("child"), "v"), f"{name}-pivots")
        now = materialize(_dealt(todo, pivots, max(1, math.ceil(most / SALT_ROWS)), width, unit), f"{name}-rows")
        stats = now.groupBy("node", "parent").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        stats = materialize(stats.join(pivots.select(F.col("child").alias("node"), F.col("v").alias("centre")), "node").withColumn("open", (F.col("n") > size) & (F.col("radius") > 0)), f"{name}-nodes")
        levels.append(stats)
        flat = now.join(stats.select("node", "open", "n"), "node")
        part = F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / size)).cast("int")
        closed = flat.filter("not open").select("id", "v", "node", part.alias("part"))
        done = closed if done is None else done.unionByName(closed)
        most = stats.filter("open").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        todo = flat.filter("open").select("node", "id", "v")
    return done, levels


def _packs(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """(node, part, ids, matrix) of the leaves."""

    def pack(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        x = _matrix(table["v"], width)
        order = np.lexsort((*x.T[::-1], ids))
        return pa.table({"node": table["node"][:1], "part": table["part"][:1], "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "matrix": pa.array([x[order].astype(kind).tobytes()], pa.binary())})

    return rows.select("id", "v", "node", "part").groupBy("node", "part").applyInArrow(pack, "node long, part int, ids binary, matrix binary")


class Space:
    """How vectors are kept: the narrowest kind that holds all components, and what holds all inner products."""

    def __init__(self, width: int, most: float):
        self.width = width
        self.kind = next(kind for kind, top in (("<i1", 127), ("<i2", 32767), ("<i4", 2**31 - 1), ("<f8", math.inf)) if most <= top)
        top = most / 2.0**40 * most * width  # kept finite as long as may be
        self.real = np.float32 if top < 2.0**-17 else np.float64
        self.exact = None if top < 2.0**12 else np.int64 if top < 2.0**22 else object
        #: Distances are taken in this unit, so that their squares stay finite.
        self.unit = 1.0 if most < 1e100 else most

    def tree(self, ids: bytes, raw: bytes) -> Tree:
        x = np.frombuffer(raw, self.kind).reshape(-1, self.width)
        exact = None
        if self.exact is np.int64:
            exact = x.astype(np.int64)
        elif self.exact is object:
            exact = np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
        return Tree((x / self.unit).astype(self.real), np.frombuffer(ids, "<i8"), exact)


def _meet(groups: DataFrame, blocks: DataFrame, wanted: DataFrame, k: int, space: Space, n_groups: int) -> DataFrame:
    """(query_id, vec_id, score, g): the k best of each query among the blocks wanted for its group.

    groups: (g, ids, matrix, floor); wanted: (g, node, part, bound).  Groups are
    put into buckets; a block goes once to each bucket that wants it, and a
    bucket's blocks are spread over several tasks, each of which has its groups.
    """
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, math.ceil(n_groups * GROUP * space.width * 8 / BUCKET_BYTES))
    splits = max(1, math.ceil(n / buckets))
    bucket = F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("bucket")
    ahead = groups.select(bucket, F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("kind"), F.lit(0.0).alias("rank"), "g", "ids", "matrix", "floor", F.array().cast("array<long>").alias("for"))
    needs = wanted.groupBy(bucket, "node", "part").agg(F.collect_list("g").alias("for"), F.max("bound").alias("bound"))  # at most a bucket's groups
    needs = needs.join(blocks, ["node", "part"])
    after = needs.select("bucket", F.pmod(F.xxhash64("node", "part"), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("kind"), (-F.col("bound")).alias("rank"), F.lit(-1).cast("long").alias("g"), "ids", "matrix", F.lit(None).cast("binary").alias("floor"), "for")
    # the blocks that may hold the best come first
    both = ahead.unionByName(after).repartition(n, "bucket", "split").sortWithinPartitions("bucket", "split", "kind", "rank")

    def walk(batches):
        now, searches, waiting = None, {}, {}

        def found():
            for g, search in searches.items():
                have = search.scores > NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(search.q.ids, have.sum(axis=1))), pa.array(search.found[have]), pa.array(search.scores[have]), pa.array(np.full(have.sum(), g))], names=["query_id", "vec_id", "score", "g"])

        for batch in batches:
            names = batch.schema.names
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r].as_py() for i, name in enumerate(names)}
                if now != (row["bucket"], row["split"]):
                    yield from found()
                    now, searches, waiting = (row["bucket"], row["split"]), {}, {}
                if row["kind"] == 0:
                    waiting[row["g"]] = row
                    continue
                data = space.tree(row["ids"], row["matrix"])
                for g in row["for"]:
                    if g not in searches:
                        own = waiting.pop(g)
                        q = space.tree(own["ids"], own["matrix"])
                        searches[g] = Search(q, k, np.frombuffer(own["floor"], "<i8") if own["floor"] else np.full(len(q.x), NONE))
                    searches[g].meet(data)
        yield from found()

    return both.mapInArrow(walk, "query_id long, vec_id long, score long, g long")


def _reached(groups: DataFrame, levels: list[DataFrame], space: Space) -> DataFrame:
    """(g, node, bound) of the leaves that may hold a score of a group's worst kth or more.

    groups: (g, centre, radius, worst).  Level by level, a node's children are
    met only by the groups that reach the node.
    """

    def bounds(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q, c = (_matrix(batch.column(batch.schema.get_field_index(name)), space.width) for name in ("q_centre", "centre"))
            r, s, worst = (batch.column(batch.schema.get_field_index(name)).to_numpy().astype(float) for name in ("q_radius", "radius", "worst"))
            if space.exact is object:  # no float holds the products, and nothing is left out
                most, go = np.zeros(len(q)), np.ones(len(q), bool)
            else:
                middle = np.einsum("ij,ij->i", q, c)
                slack = np.sqrt(np.square(q).sum(axis=1)) * s + np.sqrt(np.square(c).sum(axis=1)) * r + r * s
                most = middle + slack + 1e-6 * (np.abs(middle) + slack + 1)
                go = most >= worst
            keep = [batch.column(batch.schema.get_field_index(name)) for name in ("g", "node", "open")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(most)], names=["g", "node", "open", "bound"]).filter(pa.array(go))

    ask = groups.select("g", F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"), "worst")
    at, out = groups.select("g", F.lit(0).cast("long").alias("parent")), None
    for depth, nodes in enumerate(levels):
        nodes = nodes.select("parent", "node", "centre", "radius", "open")
        # the first level has at most WIDE_FAN nodes
        pairs = at.join(F.broadcast(nodes) if depth == 0 else nodes, "parent").join(ask, "g")
        met = materialize(pairs.select("g", "node", "open", "q_centre", "q_radius", "worst", "centre", "radius").mapInArrow(bounds, "g long, node long, open boolean, bound double"), "cover-reached")
        leaves = met.filter("not open").select("g", "node", "bound")
        out = leaves if out is None else out.unionByName(leaves)
        at = met.filter("open").select("g", F.col("node").alias("parent"))
    return out


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best. is_query: a condition on the column ``id``."""
    spark = vectors.sparkSession
    rows = materialize(usable_vectors(vectors, id_col, vector_col, scale), "cover-vectors")
    width, most = rows.agg(F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    asked = rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    if not width or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(width, most)
    leaves, levels = grow(rows, BLOCK, width, space.unit, "cover-data")
    leaves = materialize(leaves, "cover-leaves")
    blocks = materialize(_packs(leaves, width, space.kind), "cover-blocks")
    in_groups, tops = grow(asked, GROUP, width, space.unit, "cover-asked")
    in_groups = materialize(in_groups.withColumn("g", F.xxhash64("node", "part")), "cover-grouped")
    groups = materialize(_packs(in_groups, width, space.kind).select(F.xxhash64("node", "part").alias("g"), "node", "ids", "matrix"), "cover-groups")
    centres = reduce(DataFrame.unionByName, tops)
    n_groups = groups.count()
    # where most of a group's queries are
    home = in_groups.select("id", "g").join(leaves.select("id", F.col("node").alias("n"), F.col("part").alias("p")), "id").groupBy("g", "n", "p").agg(F.count("*").alias("c"))
    home = materialize(home.groupBy("g").agg(F.max_by(F.struct("n", "p"), F.struct("c", "n", "p")).alias("m")).select("g", F.col("m.n").alias("node"), F.col("m.p").alias("part"), F.lit(0.0).alias("bound")), "cover-home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = _meet(groups.select("g", "ids", "matrix", F.lit(None).cast("binary").alias("floor")), blocks, home, k, space, n_groups)
    near = materialize(near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "cover-near")
    kth = near.filter(F.col("rank") == k).groupBy("g").agg(F.collect_list(F.struct("query_id", "score")).alias("kth"))  # at most a group's queries

    def floors(batches):
        for batch in batches:
            got = []
            for ids, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                scores = {e["query_id"]: e["score"] for e in known or ()}
                got.append(np.array([scores.get(i, NONE) for i in np.frombuffer(ids, "<i8").tolist()], "<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in got], pa.binary()), pa.array([int(x.min()) for x in got], pa.int64())], names=["g", "floor", "worst"])

    floor = materialize(groups.join(kth, "g", "left").select("g", "ids", "kth").mapInArrow(floors, "g long, floor binary, worst long"), "cover-floors")
    reach = groups.select("g", "node").join(centres.filter("not open").select("node", "centre", "radius"), "node").join(floor.select("g", "worst"), "g")
    wanted = _reached(reach, levels, space).join(blocks.select("node", "part"), "node").join(home.select("g", "node", "part"), ["g", "node", "part"], "left_anti")
    rest = _meet(groups.join(floor, "g").select("g", "ids", "matrix", "floor"), blocks, wanted, k, space, n_groups)
    every = near.select("query_id", "vec_id", "score").unionByName(rest.select("query_id", "vec_id", "score"))
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
