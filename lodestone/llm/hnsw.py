"""Embedding near duplicates by hierarchical navigable small-world graphs.

Equal vectors are one. Of the others a sample gives pivots, at most MOST_CELLS, and each
vector lives in the cell of its nearest pivot; a small-world graph over the pivots finds it where
there are many. Every vector then visits the cells of some of its nearest pivots and is compared there
with all that live in them, exactly. What is near in a cell is joined to groups at once, so that what leaves it are links to
groups and never all pairs of a cluster. Cells of more than PART vectors fall into parts, each of which all visitors meet.

An audit compares a sample of queries with every vector there is and says how many cells have to be visited for the recall.
Each sampled vector is asked for together with one made at just the threshold from it,
so that there is always something to be found. Where too many cells would be needed, all are visited,
and the result is exact.

Searches in a graph run for many queries at once, a step of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, column, components, lean, list_array, stars

THRESHOLD = 0.95
#: Vectors of a cell, about, and of a part of one at most; cells, at most, beyond which they grow.
CELL, PART, MOST_CELLS = 2048, 16384, 4096
#: Pivots nearer to each other than this are one, so that a cluster stays in one cell.
APART = 0.8
#: From so many pivots on they are searched by their graph.
GRAPHED = 1024
#: Cells that a vector visits, at least and at most; cosines worked out at once.
LEAST_VISITS, MOST_VISITS, COSINES = 3, 64, 500_000
LINKS, BUILD_BEAM, BEAM, WIDEST = 12, 48, 32, 512
#: Links of a node that lead far.
FAR = 4
RECALL, AUDIT = 0.95, 256


class Graph:
    """Layers of links between rows of x; layer 0 has all of them, each layer above about one in LINKS of the one below."""

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = x
        level = np.minimum((-np.log(np.random.default_rng(seed).random(len(x))) / np.log(LINKS)).astype(int), 6)
        level[:1] = level.max(initial=0)
        self.nodes = [np.flatnonzero(level >= k) for k in range(level.max(initial=0) + 1)]
        self.links: list[np.ndarray] = [np.zeros((0, 0), np.int32)] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            self._build(k)

    def _build(self, layer: int) -> None:
        """Links for the nodes of a layer, inserted in batches that double; the layers above are complete."""
        nodes, width = self.nodes[layer], LINKS * (2 if layer == 0 else 1)
        links = self.links[layer] = np.full((len(self.x), width), -1, dtype=np.int32)
        done = 0
        ready = np.zeros(len(self.x), bool)
        while done < len(nodes):
            batch = nodes[done : done + max(1, min(done, 512))]
            found = np.zeros((len(batch), 0), np.int64)
            if done:
                start = self.entries(self.x[batch], layer, ready)
                found, _ = self.beam(self.x[batch], start, layer, BUILD_BEAM)
            inner = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(inner, -2)
            near = np.argsort(-inner, axis=1)[:, : min(LINKS, len(batch) - 1)]
            candidates = np.concatenate([found, batch[near]], axis=1) if len(batch) > 1 else found
            ready[batch] = True
            incoming: dict[int, list[int]] = {}
            for i, node in enumerate(batch.tolist()):
                c = candidates[i]
                c = np.unique(c[(c >= 0) & (c != node)])
                best = self._choose(node, c, LINKS)
                links[node, : len(best)] = best
                for b in best.tolist():
                    incoming.setdefault(b, []).append(node)
            for node, more in incoming.items():
                old = links[node][links[node] >= 0]
                both = np.unique(np.concatenate([old, np.array(more, dtype=np.int64)]))
                if len(both) > width:  # the farthest stay too, as ways out of a cluster
                    away = both[np.argsort(self.x[both] @ self.x[node], kind="stable")[:FAR]]
                    both = np.union1d(self._choose(node, np.setdiff1d(both, away), width - FAR), away)
                links[node] = -1
                links[node, : len(both)] = both
            done += len(batch)

    def _choose(self, node: int, c: np.ndarray, most: int) -> np.ndarray:
        """The nearest candidates, those first that are nearer to the node than to one chosen before."""
        if len(c) <= 1:
            return c
        s = self.x[c] @ self.x[node]
        order = np.argsort(-s, kind="stable")[: 4 * most]
        c, s = c[order], s[order]
        between = self.x[c] @ self.x[c].T
        taken, rest = [], []
        for i in range(len(c)):
            (taken if not taken or between[i, taken].max() < s[i] else rest).append(i)
            if len(taken) == most:
                break
        return c[(taken + rest)[:most]]

    def entries(self, q: np.ndarray, layer: int, ready: np.ndarray | None = None) -> np.ndarray:
        """The best node of the layer above for each query, found from the top; any ready one where there is none above."""
        at = np.full((len(q), 1), self.nodes[-1][0], dtype=np.int64)
        for k in range(len(self.nodes) - 1, layer, -1):
            at = self.beam(q, at, k, 1)[0][:, :1]
        if ready is not None and not ready[at].all():
            first = self.nodes[layer][0]
            at = np.where(ready[at], at, first)
        return at

    def beam(self, q: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the best of each query, best first; -1 where there are fewer."""
        links, n, rows = self.links[layer], len(q), np.arange(len(q))
        ids = np.full((n, width), -1, dtype=np.int64)
        sims = np.full((n, width), -3, dtype=np.float32)
        open_ = np.zeros((n, width), bool)
        ids[:, 0], open_[:, 0] = start[:, 0], True
        sims[:, 0] = np.einsum("qd,qd->q", q, self.x[start[:, 0]])
        seen = np.zeros((n, len(self.x)), bool)
        seen[rows, start[:, 0]] = True
        live = rows
        while len(live):
            score = np.where(open_[live], sims[live], -4)
            best = score.argmax(1)
            going = score[np.arange(len(live)), best] > -4
            live, best = live[going], best[going]
            if not len(live):
                break
            open_[live, best] = False
            around = links[ids[live, best]].astype(np.int64)
            fresh = (around >= 0) & ~seen[live[:, None], np.maximum(around, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], around[r, c]] = True
            s = np.full(around.shape, -3, dtype=np.float32)
            s[r, c] = np.einsum("kd,kd->k", q[live[r]], self.x[around[r, c]])
            all_s = np.concatenate([sims[live], s], axis=1)
            all_i = np.concatenate([ids[live], np.where(fresh, around, -1)], axis=1)
            all_o = np.concatenate([open_[live], fresh], axis=1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width] if all_s.shape[1] > width else np.argsort(-all_s, axis=1)
            sims[live], ids[live], open_[live] = (np.take_along_axis(z, top, 1) for z in (all_s, all_i, all_o))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def hits(self, q: np.ndarray, threshold: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, cosine) at the threshold or above of the beams that aren't full of such, and the queries whose are."""
        out, full = [], [np.zeros(0, np.int64)]
        step = max(16, min(512, (64 << 20) // max(1, len(self.x) + 60 * width)))
        for at in range(0, len(q), step):
            some = q[at : at + step]
            ids, sims = self.beam(some, self.entries(some, 0), 0, min(width, len(self.x)))
            over = (sims[:, -1] >= threshold - 1e-5) & (width < len(self.x))
            full.append(at + np.flatnonzero(over))
            i, k = np.nonzero((sims >= threshold - 1e-5) & ~over[:, None])
            sure = self.sure(some, i, ids[i, k], sims[i, k], threshold)
            out.append((at + i[sure], ids[i, k][sure], sims[i, k][sure]))
        a, b, c = zip(*out) if out else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)])
        return np.concatenate(a), np.concatenate(b), np.concatenate(c), np.concatenate(full)

    def sure(self, q: np.ndarray, i: np.ndarray, node: np.ndarray, s: np.ndarray, threshold: float) -> np.ndarray:
        """Which of these cosines reach the threshold, those close to it in double precision."""
        out = s >= threshold + 1e-5
        close = np.flatnonzero(~out & (s >= threshold - 1e-5))
        out[close] = np.einsum("kd,kd->k", q[i[close]].astype(float), self.x[node[close]].astype(float)) >= threshold - 1e-6
        return out

    def near(self, q: np.ndarray, threshold: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, cosine) at the threshold or above; queries with full beams are answered exactly."""
        a, b, c, full = self.hits(q, threshold, width)
        parts = [(a, b, c)]
        for at in range(0, len(full), 256):
            rows = full[at : at + 256]
            s = q[rows] @ self.x.T
            i, k = np.nonzero(s >= threshold - 1e-5)
            sure = self.sure(q[rows], i, k, s[i, k], threshold)
            parts.append((rows[i[sure]], k[sure], s[i, k][sure]))
        return tuple(np.concatenate(z) for z in zip(*parts))

    def group(self, threshold: float) -> None:
        """Sets labels: nodes that near duplicates join share the least of them."""
        n = len(self.x)
        own = np.arange(n)

        def root(i: int) -> int:
            while own[i] != i:
                own[i] = own[own[i]]
                i = own[i]
            return i

        def unite(a: np.ndarray, b: np.ndarray) -> None:
            for i, j in zip(a.tolist(), b.tolist()):
                i, j = root(i), root(j)
                own[max(i, j)] = min(i, j)

        a, b, _, full = self.hits(self.x, threshold, min(BEAM, n))
        unite(a, b)
        if len(full):  # their nearest first, so that few groups are left to be told apart
            for at in range(0, len(full), 256):
                rows = full[at : at + 256]
                links = self.links[0][rows]
                i, k = np.nonzero(links >= 0)
                s = np.einsum("kd,kd->k", self.x[rows[i]], self.x[links[i, k]])
                near = self.sure(self.x[rows], i, links[i, k], s, threshold)
                unite(rows[i[near]], links[i, k][near])
        self.labels = np.array([root(i) for i in range(n)], dtype=np.int64)
        unite(*self.exact(self.x, full, threshold))
        self.labels = np.array([root(i) for i in range(n)], dtype=np.int64)

    def exact(self, q: np.ndarray, rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, label) of the groups that these queries are near to, by all cosines."""
        order = np.argsort(self.labels, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(self.labels[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        x, names = self.x[order], self.labels[order][starts]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(16, (16 << 20) // max(1, len(x)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            best = np.maximum.reduceat(q[some] @ x.T, starts, axis=1)
            i, k = np.nonzero(best >= threshold - 1e-6)
            out.append((some[i], names[k]))
        return tuple(np.concatenate(z) for z in zip(*out))

    def near_groups(self, q: np.ndarray, threshold: float, width: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(query, label), each once, of the groups that the queries are near to."""
        if exact:
            return self.exact(q, np.arange(len(q)), threshold)
        a, b, _, full = self.hits(q, threshold, width)
        both = np.unique(np.column_stack([a, self.labels[b]]), axis=0)
        c, d = self.exact(q, full, threshold)
        return np.concatenate([both[:, 0], c]), np.concatenate([both[:, 1], d])


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The unit vectors of a batch in one matrix."""
    v = column(batch, "v")
    return v.flatten().to_numpy().astype(np.float32).reshape(len(v), -1)


def at_threshold(x: np.ndarray, threshold: float, seed: int = 11) -> np.ndarray:
    """For each vector one in a random direction from it, just within the threshold."""
    u = np.random.default_rng(seed).standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    size = np.linalg.norm(u, axis=1, keepdims=True)
    cosine = min(1.0, threshold + 0.1 * (1 - threshold))
    made = cosine * x + np.sqrt(1 - cosine**2) * u / np.maximum(size, 1e-9)
    return np.where(size > 1e-6, made, x).astype(np.float32)


class Cells:
    """The pivots of the vectors of one dim."""

    def __init__(self, sample: np.ndarray, most: int):
        kept = np.zeros((0, sample.shape[1]), np.float32)
        for k in range(len(sample)):
            if len(kept) == most:
                break
            if not (kept @ sample[k] >= APART).any():
                kept = np.concatenate([kept, sample[k : k + 1]])
        self.pivots = kept
        self.graph = Graph(kept) if len(kept) >= GRAPHED else None

    def nearest(self, x: np.ndarray, width: int) -> np.ndarray:
        """The cells of the nearest pivots of each vector, nearest first; -1 where the graph finds fewer."""
        width = min(width, len(self.pivots))
        if self.graph is not None and width < len(self.pivots):
            beam = max(width, BEAM)
            parts = [self.graph.beam(y, self.graph.entries(y, 0), 0, min(beam, len(self.pivots)))[0][:, :width] for y in (x[at : at + 512] for at in range(0, len(x), 512))]
            return np.concatenate(parts) if parts else np.zeros((0, width), np.int64)
        out = [np.zeros((0, width), np.int64)]
        step = max(16, COSINES // len(self.pivots))
        for at in range(0, len(x), step):
            away = -(x[at : at + step] @ self.pivots.T)
            top = np.argpartition(away, width - 1, axis=1)[:, :width]
            out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(away, top, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, vectors) of a batch."""
    dims = column(batch, "dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield dim, column(part, "id").to_numpy(), _vectors(part)


def _homes(cells: dict[int, Cells]):
    """Over vectors: (dim, cell, n) of the cells where they live; without pivots for a dim there is one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in _by_dim(batch):
                home = cells[dim].nearest(x, 1)[:, 0] if dim in cells else np.zeros(len(ids), np.int64)
                cell, n = np.unique(home, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(cell), pa.int32()), pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["dim", "cell", "n"])

    return run


def _sure(q: np.ndarray, x: np.ndarray, s: np.ndarray, threshold: float) -> np.ndarray:
    """Which of these cosines of all of q with all of x reach the threshold, those close to it in double precision."""
    near = s >= threshold + 1e-5
    i, k = np.nonzero((s >= threshold - 1e-5) & ~near)
    near[i, k] = np.einsum("kd,kd->k", q[i].astype(float), x[k].astype(float)) >= threshold - 1e-6
    return near


def _needed(cells: dict[int, Cells], asked: dict[int, np.ndarray], threshold: float):
    """Over vectors: (dim, q, visits, n), how many are near to each query of the audit and meet it from so many visits on; 0 if never."""
    orders = {dim: cells[dim].nearest(q, MOST_VISITS) for dim, q in asked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, whole in _by_dim(batch):
                if dim not in asked:
                    continue
                q, order = asked[dim], orders[dim]
                for at in range(0, len(whole), max(16, COSINES // len(q))):
                    x = whole[at : at + max(16, COSINES // len(q))]
                    i, k = np.nonzero(_sure(q, x, q @ x.T, threshold))
                    if not len(i):
                        continue
                    theirs = cells[dim].nearest(x, MOST_VISITS)
                    either = [order[i] == theirs[k, :1], theirs[k] == order[i, :1]]
                    visits = np.min([np.where(e.any(1), e.argmax(1) + 1, MOST_VISITS + 1) for e in either], axis=0)
                    code, n = np.unique(i * (MOST_VISITS + 1) + np.where(visits > MOST_VISITS, 0, visits), return_counts=True)
                    columns = [pa.array([dim] * len(code), pa.int32()), pa.array(code // (MOST_VISITS + 1), pa.int32()), pa.array(code % (MOST_VISITS + 1), pa.int32()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "q", "visits", "n"])

    return run


SPREAD = "dim int, cell int, part int, visits int, id long, v array<float>"


def _visits(cells: dict[int, Cells], parts: dict[tuple[int, int], int], width: int):
    """Over vectors: a row for each part of each cell they visit, visits 0 where they live."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in _by_dim(batch):
                order = cells[dim].nearest(x, width) if dim in cells else np.zeros((len(ids), 1), np.int64)
                row, place = np.nonzero(order >= 0)
                cell = order[row, place]
                times = np.array([parts.get((dim, c), 0) for c in range(int(cell.max(initial=0)) + 1)])[cell]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, place, cell = np.repeat(row, times), np.repeat(place, times), np.repeat(cell, times)
                own = (place == 0) & (part == (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % np.repeat(times, times))
                for at in range(0, len(row), 10_000):
                    r = row[at : at + 10_000]
                    columns = [pa.array([dim] * len(r), pa.int32()), *(pa.array(c[at : at + 10_000], pa.int32()) for c in (cell, part, (~own).astype(np.int32))), pa.array(ids[r])]
                    vectors = list_array(x[r].ravel(), np.full(len(r), x.shape[1]), pa.float32())
                    yield pa.RecordBatch.from_arrays([*columns, vectors], names=["dim", "cell", "part", "visits", "id", "v"])

    return run


def _joined(ids: np.ndarray, x: np.ndarray, labels: np.ndarray, q_ids: np.ndarray, q: np.ndarray, threshold: float, own: bool) -> list[np.ndarray]:
    """Pairs of a query and the name of a group near it; with own the queries are x, and their groups are joined."""
    out = []
    step = max(1, COSINES // len(x))
    for at in range(0, len(q), step):
        near = _sure(q[at : at + step], x, q[at : at + step] @ x.T, threshold)
        low = np.where(near, labels, len(x)).min(1)
        high = np.where(near, labels, -1).max(1)
        if own and (low < high).any():
            i, k = np.nonzero(near & (low < high)[:, None])
            tree = stars(low[i], labels[k])
            to = np.arange(len(x))
            to[column(tree, "u").to_numpy()] = column(tree, "v").to_numpy()
            labels[:] = to[labels]
        elif not own:
            some = np.flatnonzero(high >= 0)
            out.append(np.column_stack([q_ids[at + some], ids[low[some]]]))
            i, k = np.nonzero(near & (low < high)[:, None])
            both = np.unique(np.column_stack([i, labels[k]]), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            out.append(np.column_stack([q_ids[at + both[:, 0]], ids[both[:, 1]]]))
    return out


def _met(threshold: float):
    """Over rows of SPREAD by part of a cell, first those who live there: (a, b) of a vector and the one that a group near it is named after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, made = None, [], None
        for whole in batches:
            for batch in (whole.slice(at, 10_000) for at in range(0, whole.num_rows, 10_000)):
                keys = np.column_stack([column(batch, c).to_numpy() for c in ("dim", "cell", "part", "visits")])
                starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
                for s, e in zip(starts, [*starts[1:], len(keys)]):
                    now, visitors, some = tuple(keys[s, :3].tolist()), bool(keys[s, 3]), batch.slice(s, e - s)
                    if now != key or visitors:
                        if held:
                            made = _group(held, threshold)
                            yield from _pairs([np.column_stack([made[0], made[0][made[2]]])])
                        elif now != key:
                            made = None  # nobody lives there
                        held = []
                    if now != key:
                        key, made = now, None
                    if not visitors:
                        held.append(some)
                    elif made is not None:
                        yield from _pairs(_joined(*made, column(some, "id").to_numpy(), _vectors(some), threshold, False))
        if held:
            made = _group(held, threshold)
            yield from _pairs([np.column_stack([made[0], made[0][made[2]]])])

    return run


def _group(held: list[pa.RecordBatch], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, labels) of those who live in a part; near ones share the label."""
    whole = pa.Table.from_batches(held).combine_chunks().sort_by("id").to_batches()[0]
    ids, x = column(whole, "id").to_numpy(), _vectors(whole)
    labels = np.arange(len(ids))
    _joined(ids, x, labels, ids, x, threshold, True)
    return ids, x, labels


def _pairs(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    both = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    both = both[both[:, 0] != both[:, 1]]
    if len(both):
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def sampled(vectors: DataFrame, seed: int, most: int) -> dict[int, np.ndarray]:
    """At most so many vectors in one matrix for each dim, by a hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).select("id", "v", "dim").toArrow()
    out: dict[int, list[np.ndarray]] = {}
    for batch in rows.to_batches():
        for dim, _, x in _by_dim(batch):
            out.setdefault(dim, []).append(x)
    return {dim: np.concatenate(parts) for dim, parts in out.items()}


def links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """(a, b) whose closure are the near duplicates among unit vectors (id, v, dim), each id once."""
    scratch = scratch or Scratch(vectors.sparkSession, "hnsw")
    count = max(1, min(MOST_CELLS, -(-vectors.count() // CELL)))
    cells = {dim: Cells(x, count) for dim, x in sampled(vectors, 1, 2 * count).items()}
    asked = {dim: np.concatenate([x, at_threshold(x, threshold)]) for dim, x in sampled(vectors, 3, AUDIT).items() if dim in cells}
    needed = vectors.mapInArrow(lean(_needed(cells, asked, threshold)), "dim int, q int, visits int, n long")
    found: dict[tuple[int, int], np.ndarray] = {}
    for r in needed.groupBy("dim", "q", "visits").agg(F.sum("n").alias("n")).collect():
        found.setdefault((r.dim, r.q), np.zeros(MOST_VISITS + 1))[r.visits] += r.n
    shares = np.mean([np.cumsum(n[1:]) / n.sum() for n in found.values()], axis=0) if found else np.ones(MOST_VISITS)
    enough = np.flatnonzero(shares >= recall)
    width = max(LEAST_VISITS, int(enough[0]) + 1) if len(enough) else MOST_CELLS
    homes = vectors.mapInArrow(lean(_homes(cells)), "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()
    parts = {(r.dim, r.cell): -(-r.n // PART) for r in homes}
    spread = vectors.mapInArrow(lean(_visits(cells, parts, width)), SPREAD)
    placed = spread.repartition(max(1, min(2000, sum(parts.values()))), "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "visits")
    return scratch.save(placed.mapInArrow(lean(_met(threshold)), "a long, b long"))


def usable(df: DataFrame) -> DataFrame:
    """(id, v, dim), v of length 1, of the vectors that have a direction; of several of one id the least."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    base = df.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    # scaled by the greatest member first, so that no square is too large or too small
    most = F.array_max(F.transform("v", F.abs))
    fine = base.where(~F.exists("v", lambda x: x.isNull())).withColumn("most", most).where((F.col("most") > 0) & (F.col("most") < float("inf")))
    one = fine.groupBy("id").agg(F.min(F.struct("v", "most")).alias("s")).select("id", F.transform("s.v", lambda x: x / F.col("s.most")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = one.withColumn("length", length).select("id", F.transform("v", lambda x: (x / F.col("length")).cast("float")).alias("v"))
    return unit.withColumn("dim", F.size("v"))


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id and component of every distinct vec_id; component is the least vec_id that near duplicates lead to.

    A vector that is null, empty, zero, not finite or has a null member is a component of its
    own, as is one without near duplicates; length, from the least to the greatest that a
    double holds, doesn't matter. Vectors of other dimensions are never compared. A
    null vec_id is left out; of several vectors of one vec_id the
    least counts; repeated rows and equal vectors are near duplicates, in whatever order. Other
    columns are ignored, and an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "hnsw")
    vectors = scratch.save(usable(df).withColumn("first", F.min("id").over(Window.partitionBy("v"))))
    equal = vectors.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    found = links(vectors.where("id = first").select("id", "v", "dim"), threshold, recall, scratch)
    groups = components(found.union(equal), scratch)
    ids = df.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    return ids.join(groups, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("component", "vec_id").alias("component"))
