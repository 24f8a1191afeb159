"""The most similar vectors of every vector, by vantage-point trees per shard.

Vectors are scaled to length one; cosine c then means the distance sqrt(2 - 2c). Exact copies (equal to six decimals) are one point.

1. A tree of vantage points over a bounded sample cuts the space of each model into shards of about ``shard`` points, ``least`` of them at any size.
2. A point lies in one shard and asks in every shard its ball may reach: at a vantage point with radius m it goes to both sides if its
   own distance d has |d - m| <= ``factor`` * r, r being the radius of its ball. With ``probes`` it asks in that many of them at most, those with the
   least lower bound of the distance (the greatest |d - m| on the way); without, in all.
3. Each shard builds its own vantage-point tree and answers all questions that reached it, with the same relaxed triangle inequality, leaf by leaf as
   matrix products.
4. The answers of the shards are merged.

No task holds more than about ``PART`` points and as many questions: a shard with more points is cut by their digests into parts, in each of which its questions are asked, and
questions likewise.

The triangle inequality proper is ``factor`` 1, which gives exact results. Distances to a vantage point differ far less than the points' own distance does
(in d dimensions by about its 1/sqrt(d)-th part), so a smaller factor prunes most and loses little: ``ALL`` or, with a floor, ``ABOVE`` over sqrt(d) unless one is
given. What is lost adds up with the levels of the trees, those of the shards and those within them. With a floor on the cosine the ball is known from the start.
Without one, a point first asks its own shard, and the k-th distance found there is the radius for the rest.

A point's answers leave out its own document. A class of copies may be of several documents; so that it or a document of any size stays bounded, its answer holds the ``2 * k``
best under at most ``k`` a document, of which the k best of other documents are always a part: no document is more than k of the first 2k.

Unusable vectors (null, of other length than ``dimensions``, with a null or not finite value, all zero) and rows without id or model are left out; a null
document_id is a document of its own. Ties: the smaller id by bytes. Redelivered rows count once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

SAMPLE = 16_000
MOST_SAMPLE = 400_000
A_SHARD = 16
LEAF = 192
SALTS = 16
PART = 120_000
BLOCK = 4_096
RISING = 0.9
WIDE, NARROW, SHARDS, PROBES = 60_000, 20_000, 8, 8
ALL = 2.0
ABOVE = 1.6


def current_points(chunks: DataFrame) -> DataFrame:
    """(id, doc, model, vector) of the current rows with a usable vector."""
    body = F.struct("generated_at", "document_id", "model", "dimensions", "vector")
    now = chunks.select("id", "generated_at", "document_id", "model", "dimensions", "vector").filter("id is not null").groupBy("id").agg(F.max(body).alias("b")).select("id", "b.document_id", "b.model", "b.dimensions", "b.vector")
    usable = "model is not null and vector is not null and size(vector) = dimensions and dimensions > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    return now.filter(usable).select("id", F.coalesce("document_id", F.concat(F.lit("\0"), "id")).alias("doc"), "model", "vector")


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y)))


def relaxed(factor: float | None, floor: float | None, d: int) -> float:
    """The factor for vectors of d dimensions: the one given, else by ``ALL`` or ``ABOVE``; 1, which loses nothing, at most."""
    return factor if factor is not None else min(1.0, (ALL if floor is None else ABOVE) / d**0.5)


class Tree:
    """A vantage-point tree over the rows of a matrix of unit vectors: inner nodes (point, radius, near, far), leaves hold row numbers."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int = 1):
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(seed)
        todo = [(np.arange(len(x)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][2 + side] = at
            if len(rows) <= leaf:
                self.nodes.append(["leaf", rows])
                continue
            # of a few candidates, the one whose distances spread most
            some = rows if len(rows) <= 256 else rows[rng.integers(0, len(rows), 256)]
            best = max(rng.integers(0, len(rows), 4), key=lambda i: _distance(x[some], x[rows[i]]).std())
            p = x[rows[best]].copy()
            d = _distance(x[rows], p)
            m = float(np.median(d))
            near = d <= m
            if near.all():
                near = d < m
            if near.all() or not near.any():  # all at one distance: no vantage point tells them apart
                near = np.arange(len(rows)) < len(rows) // 2
                self.nodes.append([None, None, -1, -1])
            else:
                self.nodes.append([p, m, -1, -1])
            todo += [(rows[near], at, 0), (rows[~near], at, 1)]

    def reach(self, q: np.ndarray, width: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf's node, rows of q that reach it): a row goes to both sides of a radius that lies within its width."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node[0], str):
                yield at, rows
                continue
            if node[0] is None:
                todo += [(node[2], rows), (node[3], rows)]
                continue
            gap = _distance(q[rows], node[0].astype(q.dtype)) - node[1]
            near, far = rows[gap <= width[rows]], rows[gap >= -width[rows]]
            if len(near):
                todo.append((node[2], near))
            if len(far):
                todo.append((node[3], far))

    def ask(self, q: np.ndarray, width: np.ndarray, probes: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(rows of q, leaves' nodes): the leaves each row reaches, the ``probes`` of them with the least lower bounds."""
        todo, rows_, leaves, bounds = [(0, np.arange(len(q)), np.zeros(len(q)))], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        while todo:
            at, rows, bound = todo.pop()
            node = self.nodes[at]
            if isinstance(node[0], str):
                rows_.append(rows)
                leaves.append(np.full(len(rows), at))
                bounds.append(bound)
            elif node[0] is None:
                todo += [(node[2], rows, bound), (node[3], rows, bound)]
            else:
                gap = _distance(q[rows], node[0].astype(q.dtype)) - node[1]
                for side, over in ((2, gap), (3, -gap)):
                    go = over <= width[rows]
                    if go.any():
                        todo.append((node[side], rows[go], np.maximum(bound[go], over[go])))
        rows, leaves, bounds = np.concatenate(rows_), np.concatenate(leaves), np.concatenate(bounds)
        if probes is None:
            return rows, leaves
        order = np.lexsort((leaves, bounds, rows))
        o = rows[order]
        start = np.ones(len(o), bool)
        start[1:] = o[1:] != o[:-1]
        order = order[np.arange(len(o)) - np.maximum.accumulate(np.where(start, np.arange(len(o)), 0)) < probes]
        return rows[order], leaves[order]

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf's node that each row of q lies in."""
        out = np.zeros(len(q), np.int64)
        todo = [(0, np.arange(len(q)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node[0], str):
                out[rows] = at
            elif node[0] is None:
                todo.append((node[2], rows))
            else:
                near = _distance(q[rows], node[0].astype(q.dtype)) <= node[1]
                todo += [(node[2], rows[near]), (node[3], rows[~near])]
        return out


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, docs: np.ndarray, k: int, need: np.ndarray) -> np.ndarray:
    """Places of the ``need`` best of each owner with at most k a document, in order (score down, id up)."""
    order = np.lexsort((ids, -score, owner))
    o, d = owner[order], docs[order]
    by_doc = np.lexsort((np.arange(len(o)), d, o))
    run = np.ones(len(o), bool)
    run[1:] = (o[by_doc][1:] != o[by_doc][:-1]) | (d[by_doc][1:] != d[by_doc][:-1])
    first = np.maximum.accumulate(np.where(run, np.arange(len(o)), 0))
    rank = np.zeros(len(o), np.int64)
    rank[by_doc] = np.arange(len(o)) - first
    order = order[rank < k]
    o = owner[order]
    start = np.ones(len(o), bool)
    start[1:] = o[1:] != o[:-1]
    first = np.maximum.accumulate(np.where(start, np.arange(len(o)), 0))
    return order[np.arange(len(o)) - first < need[o]]


def search(tree: Tree, x: np.ndarray, q: np.ndarray, radius: np.ndarray, low: np.ndarray, factor: float, xdoc: np.ndarray, k: int, qdoc: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, cosine): answers of each row of q with cosine ``low`` at least, from the leaves its ball reaches.

    ``known`` rows of q are of one document, ``qdoc``, whose rows are no answers. What an answer must beat rises as leaves are seen: to the k-th best so far, for rows that
    are not known to the 2k-th best so far of the rows whose documents have no more than k rows here. These can't be more than k a
    document, so 2k of them make a full answer. Rows of larger documents are held against the same bound, but don't raise it."""
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    plain = np.bincount(xdoc, minlength=1)[xdoc] <= k
    bound = low.astype(np.float32) - np.float32(1e-5)
    rising = len(low) > 0 and low.min() < RISING
    top = np.full((len(q), 2 * k), -2, np.float32) if rising else None
    got = []

    def visit(at: int, rows: np.ndarray, keep: bool) -> None:
        members = tree.nodes[at][1]
        s = q32[rows] @ x32[members].T
        hit = s >= bound[rows][:, None]
        i, j = np.nonzero(hit)
        mine = xdoc[members[j]] == qdoc[rows[i]]
        hit[i[mine], j[mine]] = False
        if keep:
            i, j = i[~mine], j[~mine]
            got.append((rows[i], members[j], s[i, j]))
        if rising:
            own = hit & (plain[members][None, :] | known[rows][:, None])
            some = np.flatnonzero(own.any(1))
            if len(some):
                both = np.concatenate([top[rows[some]], np.where(own[some], s[some], np.float32(-2))], 1)
                n = both.shape[1]
                best = np.partition(both, (n - 2 * k, n - k), axis=1)[:, -2 * k :]
                top[rows[some]] = best
                bound[rows[some]] = np.maximum(bound[rows[some]], np.where(known[rows[some]], best[:, k], best[:, 0]) - np.float32(1e-5))

    if rising:  # a look around the home leaf: bounds only
        for at, rows in tree.reach(q32, np.full(len(q), 0.25 * factor)):
            visit(at, rows, False)
        top[:] = -2
        radius = np.minimum(radius, np.sqrt(np.maximum(0, 2 - 2 * bound)))
    for at, rows in tree.reach(q32, factor * radius):
        visit(at, rows, True)
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, s = (np.concatenate(c) for c in zip(*got))
    keep = s >= bound[i]  # by the bounds at the end
    i, j = i[keep], j[keep]
    s = np.einsum("nd,nd->n", q[i], x[j])
    keep = s >= low[i] - 1e-12
    return i[keep], j[keep], s[keep]


def _classes(points: DataFrame) -> DataFrame:
    """Points with ``cls``, a digest of the unit vector to six decimals, and ``unit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = pa.compute.list_value_length(b.column(3)).to_numpy()
            for n in np.unique(sizes):
                part = b.filter(pa.array(sizes == n))
                u = _matrix(part.column(3))
                keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in np.round(u, 6) + 0.0]
                unit = pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, n), pa.int32()), pa.array(u.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f"{m}/{n}" for m in part.column(2).to_pylist()]), pa.array(keys, pa.binary()), unit], names=["id", "doc", "model", "cls", "unit"])

    return points.select("id", "doc", "model", "vector").mapInArrow(run, "id string, doc string, model string, cls binary, unit array<float>")


class Index:
    """Shards, classes and heads of a set of points."""

    def __init__(self, points: DataFrame, k: int, shard: int, least: int = 1):
        self.k = k
        self.points = cut(_classes(points))
        by_class = Window.partitionBy("model", "cls").orderBy("id")
        heads = (
            self.points.select("model", "cls", "doc", "id")
            .withColumn("r", F.row_number().over(Window.partitionBy("model", "cls", "doc").orderBy("id")))
            .filter(F.col("r") <= k)
            .withColumn("r", F.row_number().over(by_class))
            .filter(F.col("r") <= 2 * k)
            .drop("r")
        )
        self.classes = cut(self.points.groupBy("model", "cls").agg(F.count("*").alias("n"), F.min(F.struct("id", "doc")).alias("one"), F.min("unit").alias("unit")))
        single = self.classes.filter("n = 1").select("model", "cls", "one.doc", "one.id", "unit")
        several = heads.join(self.classes.filter("n > 1").select("model", "cls", "unit"), ["model", "cls"]).select("model", "cls", "doc", "id", "unit")
        self.heads = single.unionByName(several)
        counts = {r["model"]: r["n"] for r in self.classes.groupBy("model").agg(F.count("*").alias("n")).collect()}  # a row a model
        shards = {m: max(least, round(n / shard)) for m, n in counts.items()}
        # about ``wanted`` classes by their digest, no more than twice as many at any size
        wanted = min(MOST_SAMPLE, max(SAMPLE, A_SHARD * sum(shards.values())))
        share = min(1.0, wanted / max(1, sum(counts.values())))
        place = F.pmod(F.xxhash64("cls"), F.lit(1_000_000_000))
        sample = self.classes.filter(place < int(share * 1_000_000_000) + 1).select("model", "unit").limit(2 * wanted).toPandas()
        self.trees: dict[str, Tree] = {}
        self.sample = {}
        for m, n in counts.items():
            rows = sample[sample["model"] == m]["unit"]
            if len(rows):
                x = np.stack([np.asarray(v, np.float64) for v in rows])
                self.trees[m] = Tree(x, max(1, -(-len(x) // shards[m])))
                self.sample[m] = (x, n / len(x))

    def _plan_parts(self, factor: Callable[[int], float] | None, radius: float = 1.0, probes: int | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Into how many parts the points of each shard and the questions to it are split, by how many of the sample lie in it and reach it: none has many more than ``PART``."""
        out = {}
        for m, (x, weight) in self.sample.items():
            tree = self.trees[m]
            home = tree.home(x)
            asked = tree.ask(x, np.full(len(x), factor(x.shape[1]) * radius), probes)[1] if factor is not None else home
            out[m] = tuple(np.maximum(1, np.ceil(np.bincount(at, minlength=len(tree.nodes)) * weight / PART)).astype(np.int64) for at in (home, asked))
        return out

    def _route(self, df: DataFrame, kind: int, factor: Callable[[int], float] | None, radius: str | None, parts: dict[str, tuple[np.ndarray, np.ndarray]], probes: int | None = None) -> DataFrame:
        """Rows (model, cls, id, doc, unit[, radius]) to the shards they lie in (no factor) or ask in. Points go to one part of the points and all of the questions, a question the other way."""
        trees = self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = pa.Table.from_batches([b])
                for m in set(t.column("model").to_pylist()):
                    part = t.filter(pa.compute.equal(t.column("model"), m))
                    x = _matrix(part.column("unit").combine_chunks())
                    r = part.column("radius").to_numpy()
                    tree = trees.get(m)
                    if tree is None:
                        rows, shards = np.arange(len(x)), np.zeros(len(x), np.int64)
                    elif factor is None:
                        rows, shards = np.arange(len(x)), tree.home(x)
                    else:
                        rows, shards = tree.ask(x, factor(x.shape[1]) * r, probes)
                    of_points, of_questions = (n[shards] for n in parts.get(m, (np.ones(1, np.int64), np.ones(1, np.int64))))
                    many, mine = (of_questions, of_points) if kind == 0 else (of_points, of_questions)
                    at = np.repeat(np.arange(len(rows)), many)
                    each = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    fixed = np.array([int.from_bytes(c[4 * kind : 4 * kind + 4], "little") for c in part.column("cls").to_pylist()], np.int64)[rows] % mine
                    piece = fixed[at] * of_questions[at] + each if kind == 0 else each * of_questions[at] + fixed[at]
                    rows, shards = rows[at], shards[at]
                    out = part.take(pa.array(rows)).append_column("shard", pa.array(shards, pa.int32())).append_column("part", pa.array(piece, pa.int32()))
                    yield from out.select(["model", "shard", "part", "kind", "cls", "id", "doc", "unit", "radius"]).combine_chunks().to_batches()

        text = F.lit(None).cast("string")
        cols = [F.col("id"), F.col("doc")] if kind == 0 else [text.alias("id"), F.when(F.col("n") == 1, F.col("one.doc")).alias("doc")]
        rows = df.select("model", F.lit(kind).alias("kind"), "cls", *cols, "unit", (F.lit(0.0) if radius is None else F.expr(radius)).cast("double").alias("radius"))
        return rows.mapInArrow(run, "model string, shard int, part int, kind int, cls binary, id string, doc string, unit array<float>, radius double")

    def answers(self, factor: float | None, floor: float | None = None, probes: int | None = None) -> DataFrame:
        """(model, cls, found: [(score, id, doc)]): the best of each class, in order: k of other documents for a class of one document, else 2k, at most k a document."""
        k = self.k
        given, factor = factor, lambda d: relaxed(given, floor, d)
        if floor is not None:
            r = float(np.sqrt(max(0.0, 2 - 2 * floor)))
            parts = self._plan_parts(factor, r, probes)
            return self._merge(self._ask(self._route(self.heads, 0, None, None, parts), self._route(self.classes, 1, factor, f"{r}D", parts, probes), factor, floor))
        parts = self._plan_parts(None)
        first = self._ask(self._route(self.heads, 0, None, None, parts), self._route(self.classes, 1, None, "2D", parts), factor, None)
        first = cut(first)
        known = first.groupBy("model", "cls").agg(F.sort_array(F.collect_list("score"), False).alias("s"), F.first("shard").alias("home"))
        # what is found elsewhere must beat the last of a full answer at home
        need = F.when(F.col("n") == 1, k).otherwise(2 * k)
        radius = F.when(F.size("s") >= need, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.try_element_at("s", need)))).otherwise(F.lit(2.0))
        wide = self.classes.join(known, ["model", "cls"], "left").withColumn("radius", radius).drop("s")
        parts = self._plan_parts(factor, probes=probes)
        asked = self._route(wide, 1, factor, "coalesce(radius, 2D)", parts, probes).join(known.select("model", "cls", F.col("home").alias("shard")), ["model", "cls", "shard"], "left_anti")
        points = self._route(self.heads, 0, None, None, parts)
        return self._merge(first.unionByName(self._ask(points, asked.select(points.columns), factor, None)))

    def _ask(self, points: DataFrame, asked: DataFrame, factor: Callable[[int], float], floor: float | None) -> DataFrame:
        k = self.k

        def run(t: pa.Table) -> pa.Table:
            kind = t.column("kind").to_numpy()
            p, q = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
            names = ["model", "cls", "shard", "score", "id", "doc"]
            empty = pa.table({n: pa.array([], t.schema.field(n).type if n != "score" else pa.float64()) for n in names})
            if not p.num_rows or not q.num_rows:
                return empty
            p = p.take(pa.compute.sort_indices(p.column("id").combine_chunks().cast(pa.binary())))  # in the order of their ids' bytes
            x, y = _matrix(p.column("unit").combine_chunks()), _matrix(q.column("unit").combine_chunks())
            docs = pa.compute.dictionary_encode(p.column("doc").combine_chunks())
            doc = docs.indices.to_numpy()
            known = q.column("doc").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            mine = pa.compute.fill_null(pa.compute.index_in(q.column("doc").combine_chunks(), value_set=docs.dictionary), -1).to_numpy(zero_copy_only=False)
            mine, need = np.where(known, mine, -1), np.where(known, k, 2 * k)
            tree = Tree(x, LEAF)
            ids = np.arange(len(x))
            radius = q.column("radius").to_numpy()
            low = np.full(len(y), floor) if floor is not None else np.where(radius >= 2.0, -1.1, 1 - radius**2 / 2 - 1e-9)
            got = []
            for a in range(0, len(y), BLOCK):  # hits of a block are cut to answers before the next
                some = slice(a, a + BLOCK)
                i, j, s = search(tree, x, y[some], radius[some], low[some], factor(x.shape[1]), doc, k, mine[some], known[some])
                best = _best(i, s, ids[j], doc[j], k, need[some])
                got.append((i[best] + a, j[best], s[best]))
            i, j, s = (np.concatenate(c) for c in zip(*got))
            out = q.select(["model", "cls", "shard"]).take(pa.array(i))
            return pa.table({"model": out.column("model"), "cls": out.column("cls"), "shard": out.column("shard"), "score": pa.array(s), "id": p.column("id").take(pa.array(j)), "doc": p.column("doc").take(pa.array(j))}) if len(i) else empty

        return points.unionByName(asked).groupBy("model", "shard", "part").applyInArrow(run, "model string, cls binary, shard int, score double, id string, doc string")

    def _merge(self, hits: DataFrame) -> DataFrame:
        k = self.k
        found = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("down"), "id", "doc", "score")))
        return hits.groupBy("model", "cls").agg(found.alias("f")).select("model", "cls", F.transform("f", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"), x["doc"].alias("doc"))).alias("found"))

    def neighbours(self, answers: DataFrame) -> DataFrame:
        """(id, rank, neighbour, score): every point's k best of other documents."""
        k = self.k
        single = self.classes.filter("n = 1").select("model", "cls", "one.id", "one.doc").join(answers, ["model", "cls"])
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
        copies = answers.join(self.classes.filter("n > 1").select("model", "cls"), ["model", "cls"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        members = self.points.select("model", "cls", "id", "doc").withColumn("salt", salt).join(copies, ["model", "cls", "salt"])
        rows = single.select("id", "doc", "found").unionByName(members.select("id", "doc", "found"))
        mine = F.slice(F.filter("found", lambda x: x["doc"] != F.col("doc")), 1, k)
        return rows.select("id", F.posexplode(mine).alias("r", "x")).select("id", (F.col("r") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.col("x.score").alias("score"))


def similar(points: DataFrame, k: int = 10, floor: float | None = None, factor: float | None = None, shard: int | None = None, least: int | None = None, probes: int | None = None) -> DataFrame:
    """(id, rank, neighbour, score): the k most similar points of other documents and the same model, with cosine ``floor`` at least if one is given.

    ``factor`` 1 without ``probes`` is exact. Unless given, shards hold ``WIDE`` points; with a floor, whose balls are small, ``NARROW``, at least ``SHARDS`` of them, of which a
    question asks in ``PROBES`` at most (0 for no such bound)."""
    near = floor is not None
    shard, least = shard or (NARROW if near else WIDE), least or (SHARDS if near else 1)
    probes = (PROBES if near and factor is None else None) if probes is None else probes or None
    index = Index(points, k, shard, least)
    return index.neighbours(index.answers(factor, floor, probes))


def closed(similarities: DataFrame, k: int) -> DataFrame:
    """Similarities found from either side: an answer of one is a candidate of the other, each keeps its k best. What a relaxed search loses it seldom loses from both sides.

    Copies of one vector may name one id very often; a ranking keeps k rows an id in each task before it shuffles."""
    back = similarities.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "score")
    both = similarities.select("id", "neighbour", "score").unionByName(back).groupBy("id", "neighbour").agg(F.max("score").alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "neighbour")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "rank", "neighbour", "score")


def mutual(similarities: DataFrame) -> DataFrame:
    """(id_a, id_b, score): pairs of which each is an answer of the other, id_a < id_b by bytes."""
    a = F.least("id", "neighbour").alias("id_a")
    b = F.greatest("id", "neighbour").alias("id_b")
    return similarities.groupBy(a, b).agg(F.count("*").alias("n"), F.max("score").alias("score")).filter("n = 2").select("id_a", "id_b", "score")
