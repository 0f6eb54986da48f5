"""Exact top-k inner products: paged M-trees searched best first.

Vectors are quantised to integers, so scores are exact, as long as they fit 63 bits.
Routing pivots are fitted on a bounded sample (``SAMPLE`` rows), one for each page that
the rows need, up to ``PIVOTS``; every vector is indexed: it goes to the page of its
nearest pivot, and a pivot's rows are dealt over as many pages as their number needs,
so a hot vector is many pages.  Each page is an M-tree:
nodes with a routing vector, a covering radius, the distance to the parent's
routing vector, and the smallest id below.

A node can hold no score above <q, c> + |q| * radius, and, before <q, c> is
computed, none above <q, parent> + |q| * (distance to parent + radius); both
follow from the triangle inequality.  Nodes are visited in order of their bound,
by blocks of queries, and only for queries whose k-th score found so far is not
above it; at a tie, a node of equal vectors is left out if its smallest id is
larger than the k-th id.  Queries first search a page of their
nearest pivot, and take the k-th score found there to all other pages.

Queries travel in groups of ``QUERY_GROUP``, pages in trees of ``PAGE_ROWS``; a
task holds one of each.  A page's tree is sent to the groups that may find a better
score in it; which those are is computed for blocks of ``BOUND_GROUP`` queries.

Defined cases: rows whose vector is null, or holds a null or a non-finite
component, or whose id is null, take no part; a shorter vector, an empty one too, counts
as padded with zeros; rows that repeat an id are candidates each (never for a query of the
same id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.stages import forget, stage

SAMPLE = 4096
PIVOTS = 512  # at most; one a page, as long as there are fewer
PAGE_ROWS = 8192
QUERY_GROUP = 4096  # queries that search a page together
BOUND_GROUP = 512  # queries whose bounds on all pages one task computes
EXACT = 2.0**52  # below this, sums of floats are exact
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FANOUT, LEAF = 16, 48


def quantised(vector: Column) -> Column:
    """floor(256 * component) as integers; null where the vector takes no part."""
    d = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(d, lambda x: F.floor(x * 256).cast("long")))


def matrix(lists: list, width: int | None = None) -> np.ndarray:
    width = max((len(v) for v in lists), default=0) if width is None else width
    out = np.zeros((len(lists), max(width, 1)), np.int64)
    for i, v in enumerate(lists):
        part = v[: out.shape[1]]
        out[i, : len(part)] = part
    return out


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots, from the point nearest the centre; duplicates end it."""
    points = points.astype(float)
    first = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    chosen = [first]
    far = ((points - points[first]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    points, pivots = points.astype(float), pivots.astype(float)
    return (points**2).sum(1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(1)[None, :]


class MTree:
    """nodes: (centre, radius, min id, children or None, lo, hi); a leaf's rows are lo..hi.

    Geometry is in floats; ``whole`` are the points as integers.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.whole, self.ids = points[order].astype(np.int64), ids[order]
        self.points = self.whole.astype(float)
        self.rows = np.arange(len(ids))
        self.to_parent = np.zeros(len(ids))
        self.nodes: list[tuple] = []
        self._out: list[np.ndarray] = []
        self.root = self._build(self.rows, None)
        self.rows = np.concatenate(self._out) if self._out else self.rows
        self.whole, self.ids, self.to_parent = self.whole[self.rows], self.ids[self.rows], self.to_parent[self.rows]
        self.points = self.whole.astype(float)
        del self._out

    def _build(self, rows: np.ndarray, centre: np.ndarray | None) -> int:
        pts = self.points[rows]
        if centre is None:
            centre = pts[((pts - pts.mean(0)) ** 2).sum(1).argmin()]
        away = np.sqrt(((pts - centre) ** 2).sum(1))
        radius, least = float(away.max()) * (1 + 1e-12), int(self.ids[rows].min())
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= LEAF:
            lo = self._filled
            self._out.append(rows)
            self.to_parent[rows] = away
            self.nodes[at] = (centre, radius, least, None, lo, lo + len(rows))
            self._filled = lo + len(rows)
            return at
        rng = np.random.default_rng(len(rows))
        some = pts[rng.permutation(len(rows))[:512]]
        pivots = some[_spread(some, FANOUT)]
        if len(pivots) == 1:  # one point many times: leaves in order of their ids
            parts = [(rows[i : i + LEAF], pts[0]) for i in range(0, len(rows), LEAF)]
            if len(parts) > FANOUT:
                step = -(-len(rows) // FANOUT)
                parts = [(rows[i : i + step], pts[0]) for i in range(0, len(rows), step)]
        else:
            nearest = _distances(pts, pivots).argmin(1)
            parts = [(rows[nearest == j], pivots[j]) for j in range(len(pivots)) if (nearest == j).any()]
            if len(parts) == 1:
                half = len(rows) // 2
                parts = [(rows[:half], parts[0][1]), (rows[half:], parts[0][1])]
        kids = [self._build(part, c) for part, c in parts]
        centres = np.array([self.nodes[k][0] for k in kids])
        self.nodes[at] = (centre, radius, least, (np.array(kids), centres, np.sqrt(((centres - centre) ** 2).sum(1)), np.array([self.nodes[k][1] for k in kids]), np.array([self.nodes[k][2] for k in kids])), 0, 0)
        return at

    def dump(self) -> bytes:
        return pickle.dumps((self.whole, self.ids, self.to_parent, self.nodes, self.root), protocol=5)

    @classmethod
    def load(cls, page: bytes) -> MTree:
        tree = cls.__new__(cls)
        tree.whole, tree.ids, tree.to_parent, tree.nodes, tree.root = pickle.loads(page)
        tree.points = tree.whole.astype(float)
        return tree

    _filled = 0  # rows put into leaves so far

    def search(self, whole: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids, inner products computed): k columns a query, NONE where there are fewer.

        A block of queries goes down the tree together: the node whose bound is
        highest for any query comes first, and only the queries whose own bound
        still reaches their k-th score take part in it.  ``floor``/``floor_id``: a
        k-th result each query knows already (NONE, LAST if it knows none); ``own``: an id it may not find.
        Bounds are floats with room for rounding; scores are integers, by integer arithmetic where floats may round.
        """
        m, q = len(whole), whole.astype(float)
        norm = np.sqrt((q * q).sum(1)) * (1 + 1e-12)
        top = float(np.sqrt((self.points**2).sum(1)).max(initial=0.0))
        exact = float(norm.max(initial=0.0)) * top < EXACT
        room = 1e-6 + 1e-12 * norm * top * max(1, q.shape[1])
        best, ids = np.full((m, k), NONE), np.full((m, k), LAST)
        worst, worst_id = floor.astype(np.int64).copy(), floor_id.astype(np.int64).copy()
        computed, turn = m, 0
        dots = q @ self.nodes[self.root][0]
        bound = dots + norm * self.nodes[self.root][1]
        heap = [(-float(bound.max(initial=-np.inf)), 0, self.root, np.arange(m), dots)]
        while heap:
            _, _, node, act, dots = heapq.heappop(heap)
            _, radius, least, kids, lo, hi = self.nodes[node]
            live = dots + norm[act] * radius + room[act] >= worst[act]
            if radius == 0 and exact:  # nothing here scores higher than its centre, and ties lose to smaller ids
                live &= ~((dots == worst[act]) & (least > worst_id[act]))
            act, dots = act[live], dots[live]
            if not len(act):
                continue
            if kids is None:
                near = (dots + room[act])[:, None] + norm[act][:, None] * self.to_parent[None, lo:hi] >= worst[act][:, None]
                cols = np.flatnonzero(near.any(0))
                if not len(cols):
                    continue
                computed += int(near.sum())
                found = self.ids[lo:hi][cols]
                score = np.rint(q[act] @ self.points[lo:hi][cols].T).astype(np.int64) if exact else whole[act] @ self.whole[lo:hi][cols].T
                able = near[:, cols] & (found[None, :] != own[act][:, None])
                score = np.where(able, score, NONE)
                some = np.flatnonzero((able & (score >= worst[act][:, None])).any(1))
                if not len(some):
                    continue
                rows = act[some]
                all_scores = np.hstack([best[rows], score[some]])
                all_ids = np.hstack([ids[rows], np.where(able[some], found[None, :], LAST)])
                order = np.lexsort((all_ids, np.invert(all_scores)), axis=1)[:, :k]  # ~x falls as x grows, without overflow
                best[rows], ids[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
                last, last_id = best[rows, k - 1], ids[rows, k - 1]
                higher = (last > worst[rows]) | ((last == worst[rows]) & (last_id < worst_id[rows]))
                worst[rows[higher]], worst_id[rows[higher]] = last[higher], last_id[higher]
            else:
                which, centres, to_parent, radii, _ = kids
                near = (dots + room[act])[:, None] + norm[act][:, None] * (to_parent + radii)[None, :] >= worst[act][:, None]
                cols = np.flatnonzero(near.any(0))
                if not len(cols):
                    continue
                computed += int(near.sum())
                to_child = q[act] @ centres[cols].T
                for j, c in enumerate(cols.tolist()):
                    mine = np.flatnonzero(near[:, c])
                    turn += 1
                    high = float((to_child[mine, j] + norm[act[mine]] * radii[c]).max())
                    heapq.heappush(heap, (-high, turn, int(which[c]), act[mine], to_child[mine, j]))
        lost = (best < floor[:, None]) | ((best == floor[:, None]) & (ids >= floor_id[:, None]))
        best[lost] = NONE
        return best, ids, computed


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1).to_pylist(), pivots.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_distances(x, pivots).argmin(1).astype(np.int32))], names=["id", "v", "pivot"])

    return run


def _build_page(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = MTree(matrix(pdf["v"].tolist()), pdf["id"].to_numpy())
    centre, radius = tree.nodes[tree.root][:2]
    top = float(np.sqrt((tree.points**2).sum(1)).max())
    return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "tree": [tree.dump()], "centre": [list(map(float, centre))], "radius": [radius], "top": [top]})


def _search(k: int):
    def run(pages: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if len(pages) and len(queries):
            tree = MTree.load(pages["tree"].iloc[0])
            q = matrix(queries["v"].tolist(), tree.whole.shape[1])
            own = queries["id"].to_numpy()
            best, ids, _ = tree.search(q, own, k, queries["floor"].to_numpy(), queries["floor_id"].to_numpy())
            row, col = np.nonzero((best != NONE) | (ids != LAST))
            row, col = row[ids[row, col] != LAST], col[ids[row, col] != LAST]
            return pd.DataFrame({"query_id": own[row], "score": best[row, col], "vec_id": ids[row, col]})
        return pd.DataFrame({"query_id": [], "score": [], "vec_id": []}, dtype="int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller id.

    Query rows that share an id are all asked, and what they find is ranked together, as in the SQL.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    empty = "query_id long, rank int, vec_id long, score long"
    spark = vectors.sparkSession
    if not len(sample):
        return spark.createDataFrame([], empty)
    width, n = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    points = matrix(sample["v"].tolist(), width)
    pivots = points[_spread(points, min(PIVOTS, -(-n // PAGE_ROWS)))]
    # a repeated row is a candidate of its own: ids need not be unique in a page
    dealt = stage(rows.select("id", "v").mapInArrow(_assign(pivots), "id long, v array<long>, pivot int"), "topk-assigned")
    counts = {r["pivot"]: r["count"] for r in dealt.groupBy("pivot").count().collect()}  # at most PIVOTS rows
    pages_of = [-(-counts.get(p, 0) // PAGE_ROWS) for p in range(len(pivots))]
    first = np.concatenate([[0], np.cumsum(pages_of)]).astype(int).tolist()
    start = F.element_at(F.array(*[F.lit(x) for x in first]), F.col("pivot") + 1)
    many = F.element_at(F.array(*[F.lit(max(1, x)) for x in pages_of]), F.col("pivot") + 1)
    paged = dealt.withColumn("page", (start + F.pmod(F.xxhash64("id", F.lit(3)), many)).cast("int"))
    pages = stage(paged.groupBy("page").applyInPandas(_build_page, "page int, tree binary, centre array<double>, radius double, top double"), "topk-pages")

    forget(dealt)

    asked = rows.where("q").select("id", "v")
    n_asked = asked.count()
    groups = max(1, -(-n_asked // QUERY_GROUP))
    group = F.pmod(F.xxhash64("id", "v", F.lit(5)), F.lit(groups)).cast("int")
    homes = asked.mapInArrow(_assign(pivots), "id long, v array<long>, pivot int").select("id", "v", start.cast("int").alias("home"), group.alias("g"))
    homes = stage(homes, "topk-queries")
    schema = "query_id long, score long, vec_id long"

    def found(queries: DataFrame) -> DataFrame:
        asking = queries.select("id", "v", "floor", "floor_id", F.col("page").alias("to_page"), F.col("g").alias("to_g"))
        # a page's tree goes to the groups of queries that search it, and to no others
        wanted = asking.select(F.col("to_page").alias("page"), F.col("to_g").alias("g")).distinct()
        trees = pages.select("page", "tree").join(wanted, "page")
        return trees.groupBy("page", "g").cogroup(asking.groupBy("to_page", "to_g")).applyInPandas(_search(k), schema)

    none, last = F.lit(int(NONE)), F.lit(int(LAST))
    near = stage(found(homes.select("id", "v", F.col("home").alias("page"), "g", none.alias("floor"), last.alias("floor_id"))), "topk-near")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = near.withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
    # which other pages can hold a better score: queries, in blocks, against the centres of all pages
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    blocks = max(1, -(-n_asked // BOUND_GROUP))
    limits = homes.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", "home", "g", F.coalesce("floor", none).alias("floor"), F.coalesce("floor_id", last).alias("floor_id"), norm.alias("norm"), F.pmod(F.xxhash64("id", "v", F.lit(9)), F.lit(blocks)).cast("int").alias("block"))
    rest = pages.select("page", "centre", "radius", "top").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dot = F.aggregate(F.zip_with("v", "centre", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    room = 1e-3 + F.col("norm") * (F.col("radius") + F.col("top")) * 1e-9
    able = limits.join(rest, "block").where((F.col("page") != F.col("home")) & (dot + F.col("norm") * F.col("radius") + room >= F.col("floor")))
    far = found(able.select("id", "v", "page", "g", "floor", "floor_id"))
    best = near.unionByName(far).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
