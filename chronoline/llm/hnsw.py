"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Equal vectors collapse to one class. Classes are dealt to shards by hash. Each shard builds one graph: LEADERS times the
square root of its classes, chosen by hash and none within reach of a common link of another, are linked in layers, and
below the last layer every class hangs on its HOMES nearest leaders, in their cells. A query's beam runs down the layers
and ends in the nearest leaders, whose cells are compared whole, a cell with all queries that came to it by matrix
products; a class met in several cells of a beam counts once.
Shards search in pairs, each pair once: the queries of one in the graph of the other, links count for both ends.

Each pair is audited against all vectors of the shard: hash-chosen queries, AUDITED at a time, until AUDITED of them
have links other than to themselves or AUDIT_MOST were looked at. The recall of each audited query counts alike, so that
a large group of copies does not hide what is lost of small ones. Below AUDIT the pair's beam doubles, up to all cells;
the audited queries alone find that beam, then all are searched with it. A pair whose audit has no link at all has
nothing to lose by it and keeps its beam. The measured recall is in the result if `with_recall` is set.

Links are those of the cosine in double precision: what the product in single precision leaves in doubt, by the bound of
its error, is computed again. Each task emits link counts and a spanning forest, never pairs, and the forests are
joined by connected components.

Shards are SHARDS, or as many as keep a shard's vectors within SHARD bytes, whichever is more. A task holds one shard's
graph (vectors as wide as the column has them and in single precision), the queries of another and ROOM bytes of each
working array; graphs travel in rows of PIECE bytes, and hits are counted and reduced to a forest as they are found, so
no array grows with a group of copies or with the table. Vectors of different dimensions link with nothing of another
dimension. Null, empty or zero vectors and those with null or non-finite components link with nothing. Repeated rows
count as separate vectors with the same vec_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.shared import MIX, connected_components, drop_settled, find_roots, mix64, release, settle, spread_join, trim

SHARDS, SHARD, LEADERS, HOMES, DEGREE, BEAM, AUDIT, AUDITED, AUDIT_MOST, WAYS = 5, 20 << 20, 3, 4, 12, 16, 0.995, 48, 1_536, 4
#: Leaders with a cosine of APART are one: for links of 0.95, two vectors that may link with the same third.
APART = 0.805
#: Bytes of a working array and of a row that holds a piece of a graph; edges that a task holds before it reduces them.
ROOM, PIECE, EDGES = 32 << 20, 1 << 20, 1 << 18


def beam_search(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best `beam` nodes for each query over one layer, best first: ids (-1 where fewer) and similarities."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True
    ids, sims = np.full((n, beam), -1), np.full((n, beam), -2.0, np.float32)
    entry = entry[:, :beam]
    ids[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("nd,nkd->nk", queries, x[entry]), -2)
    seen[rows, entry] = True
    fresh = ids >= 0
    active = np.arange(n)
    while len(active):
        i = np.arange(len(active))[:, None]
        best = np.argpartition(np.where(fresh[active], -sims[active], 3), min(WAYS, beam - 1), axis=1)[:, :WAYS]
        use = fresh[active][i, best]
        fresh[active[:, None], best] = False
        around = []
        for k in range(best.shape[1]):
            near = np.where(use[:, k, None], links[ids[active, best[:, k]]], -1)
            new = (near >= 0) & ~seen[active[:, None], near]
            near = np.where(new, near, -1)
            seen[active[:, None], near] = True
            around.append(near)
        near = np.concatenate(around, axis=1)
        sim = np.einsum("nd,nkd->nk", queries[active], x[near])
        sim[near < 0] = -2
        all_ids, all_sims = np.concatenate([ids[active], near], axis=1), np.concatenate([sims[active], sim], axis=1)
        all_fresh = np.concatenate([fresh[active], near >= 0], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active], sims[active], fresh[active] = all_ids[i, top], all_sims[i, top], all_fresh[i, top]
        active = active[fresh[active].any(1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    return ids[rows, order], sims[rows, order]


def choose(x: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Up to `degree` neighbours of each node from candidates sorted best first: those nearer to it than to one chosen before, then the nearest left."""
    n, width = ids.shape
    out = np.full((n, degree), -1)
    for lo in range(0, n, 512):
        a = slice(lo, lo + 512)
        cand, sim = ids[a], sims[a]
        among = np.einsum("nkd,njd->nkj", x[cand], x[cand])
        valid = (cand >= 0) & (cand != own[a, None])
        picked = np.zeros(cand.shape, bool)
        for k in range(width):
            blocked = (picked & (among[:, k] >= sim[:, k, None])).any(1)
            picked[:, k] = valid[:, k] & ~blocked & (picked.sum(1) < degree)
        rank = np.where(picked, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        best = np.argsort(rank, axis=1)[:, :degree]
        r = np.arange(len(cand))[:, None]
        out[a, : best.shape[1]] = np.where(valid[r, best], cand[r, best], -1)
    return out


def x_bytes(x: np.ndarray) -> int:
    """Bytes of a vector of x."""
    return max(1, x.shape[1] * x.itemsize)


class Graph:
    """Layers of links over leaders, each higher layer the first of them, and all unit vectors x in the cells of their nearest leaders, the homes."""

    def __init__(self, x: np.ndarray, names: np.ndarray):
        some = np.lexsort((names, mix64(names.astype(np.uint64) * MIX + MIX)))[: int(np.ceil(LEADERS * len(x) ** 0.5))]
        self.leaders = self._apart(x[some])
        homes = np.empty((len(x), min(HOMES, len(self.leaders))), np.int32)
        step = max(16, ROOM // (16 * len(self.leaders)))
        for lo in range(0, len(x), step):
            far = -(x[lo : lo + step] @ self.leaders.T)
            near = np.argpartition(far, homes.shape[1] - 1, axis=1)[:, : homes.shape[1]]
            homes[lo : lo + step] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
        self.order = np.lexsort((names, homes[:, 0]))
        self.x = np.ascontiguousarray(x[self.order])
        self._settle(homes[self.order])
        sizes = [len(self.leaders)]
        while sizes[0] > DEGREE:
            sizes.insert(0, sizes[0] // DEGREE)
        self.layers = []
        for n in sizes:
            self.layers.append(self._layer(n, 2 * DEGREE if n == sizes[-1] else DEGREE))

    @classmethod
    def of(cls, x: np.ndarray, leaders: np.ndarray, homes: np.ndarray, layers: list[np.ndarray]) -> Graph:
        """A graph that was built before, of the same vectors in its own order."""
        graph = cls.__new__(cls)
        graph.x, graph.leaders, graph.layers = x, leaders, layers
        graph._settle(homes)
        return graph

    def _settle(self, homes: np.ndarray) -> None:
        """Who lives in each cell: vectors whose first home it is, in a row, and guests from others."""
        every = np.arange(len(self.leaders) + 1)
        self.homes, self.starts = homes, np.searchsorted(homes[:, 0], every)
        away = homes[:, 1:].ravel()
        order = np.argsort(away, kind="stable")
        self.guests, self.guest_starts = (order // max(1, homes.shape[1] - 1)).astype(np.int32), np.searchsorted(away[order], every)

    @staticmethod
    def _apart(x: np.ndarray) -> np.ndarray:
        """The vectors of x without those near to one before that stays."""
        kept = x[:0]
        for lo in range(0, len(x), 256):
            new = x[lo : lo + 256]
            new = new[~(new @ kept.T >= APART).any(1)] if len(kept) else new
            near, stays = np.tril(new @ new.T >= APART, -1), np.ones(len(new), bool)
            for i in np.flatnonzero(near.any(1)):
                stays[i] = not (near[i] & stays).any()
            kept = np.concatenate([kept, new[stays]])
        return kept

    def _layer(self, n: int, degree: int) -> np.ndarray:
        x, links = self.leaders, np.full((n + 1, degree), -1, np.int32)
        done = min(n, 256)
        s = x[:done] @ x[:done].T
        np.fill_diagonal(s, -2)
        near = np.argsort(-s, axis=1, kind="stable")[:, : 4 * degree]
        links[:done] = choose(x, np.arange(done), near, np.take_along_axis(s, near, 1), degree)
        self._back(links, np.arange(done), links[:done].copy(), degree)
        while done < n:
            new = np.arange(done, min(n, done + min(done, 1024)))
            q = x[new]
            ids, sims = beam_search(x[:done], links[:done], q, self._entry(q, done), 2 * degree)
            s = q @ q.T
            np.fill_diagonal(s, -2)
            k = min(degree, len(new))
            mates = np.argpartition(-s, k - 1, axis=1)[:, :k]
            ids, sims = np.concatenate([ids, mates + done], 1), np.concatenate([sims, np.take_along_axis(s, mates, 1)], 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            chosen = choose(x, new, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), degree)
            links[new] = chosen
            self._back(links, new, chosen, degree)
            done += len(new)
        return links[:n]

    def _back(self, links: np.ndarray, new: np.ndarray, chosen: np.ndarray, degree: int) -> None:
        """Links back from the chosen; a node with too many chooses anew."""
        to, back = chosen.ravel(), np.repeat(new, chosen.shape[1])
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        nodes, first, count = nodes[order], first[order], count[order]
        lo = hi = 0
        while hi < len(nodes):  # the most wanted nodes first, so that few of them share a wide array
            width = int(count[hi])
            lo, hi = hi, hi + min(2048, max(1, ROOM // (2 * x_bytes(self.leaders) * (degree + width))))
            a, c = nodes[lo:hi], count[lo:hi]
            at = first[lo:hi, None] + np.arange(width)
            more = np.where(np.arange(width) < c[:, None], back[np.minimum(at, len(back) - 1)], -1)
            more[(more[:, :, None] == links[a][:, None, :]).any(2)] = -1
            ids = np.concatenate([links[a], more], 1)
            sims = np.einsum("nd,nkd->nk", self.leaders[a], self.leaders[ids])
            sims[ids < 0] = -2
            order = np.argsort(-sims, axis=1, kind="stable")[:, : 4 * degree]
            links[a] = choose(self.leaders, a, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), degree)

    def _entry(self, q: np.ndarray, within: int) -> np.ndarray:
        at = self._descend(q, self.layers)
        return np.where(at < within, at, -1)

    def _descend(self, q: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        at = np.zeros((len(q), 1), int)
        for links in layers:
            at = beam_search(self.leaders[: len(links)], links, q, at, 4)[0]
        return at

    def cells(self, q: np.ndarray, beam: int) -> np.ndarray:
        """The `beam` nearest leaders of each query that its beam finds, -1 where fewer."""
        out, step = np.empty((len(q), beam), np.int32), max(16, min(512, ROOM // len(self.leaders)))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            out[lo : lo + step] = beam_search(self.leaders, self.layers[-1], part, self._descend(part, self.layers[:-1]), beam)[0]
        return out

    def met(self, cell: int) -> np.ndarray:
        """The nodes of a cell, guests last."""
        return np.concatenate([np.arange(self.starts[cell], self.starts[cell + 1]), self.guests[self.guest_starts[cell] : self.guest_starts[cell + 1]]])

    def compare(self, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray, low: np.float32, cell: int = 0, cells: np.ndarray | None = None):
        """Parts of (row, node, similarity) of similarity >= low between rows of q and nodes.

        With the cells that each row's beam found, nodes are those of `cell`; one counts in the first of its homes among them."""
        wide = max(1, ROOM // (4 * x_bytes(self.x)))
        for some in (nodes[lo : lo + wide] for lo in range(0, len(nodes), wide)):
            x, step = self.x[some].T, max(1, min(wide, ROOM // 64 // len(some)))
            for lo in range(0, len(rows), step):
                sims = (q[rows[lo : lo + step]] @ x).ravel()
                hit = np.flatnonzero(sims >= low)
                row, node = lo + hit // len(some), some[hit % len(some)]
                if cells is not None and len(hit):
                    first = self._first(cells, row, node, cell)
                    hit, row, node = hit[first], row[first], node[first]
                if len(hit):
                    yield rows[row], node, sims[hit]

    def _first(self, cells: np.ndarray, row: np.ndarray, node: np.ndarray, cell: int) -> np.ndarray:
        """Whether no home of a node before the cell is among the cells of a row."""
        out = self.homes[node, 0] == cell
        away, step = np.flatnonzero(~out), max(1, ROOM // (8 * cells.shape[1]))
        for lo in range(0, len(away), step):
            at = away[lo : lo + step]
            homes, mine = self.homes[node[at]], cells[row[at]]
            met, before = np.zeros(len(at), bool), np.ones(len(at), bool)
            for k in range(homes.shape[1]):
                before &= homes[:, k] != cell
                met |= before & (mine == homes[:, k, None]).any(1)
            out[at] = ~met
        return out


def _search(graph: Graph, q: np.ndarray, rows: np.ndarray, low: np.float32, beam: int):
    """Parts of (row, node, similarity) of similarity >= low in the cells that beams find; all cells where the beam is no less."""
    n = len(graph.leaders)
    step = max(16, ROOM // (16 * beam))
    for lo in range(0, len(rows), step):
        part = rows[lo : lo + step]
        if beam >= n:
            for at in range(0, len(graph.x), 1024):
                yield from graph.compare(q, part, np.arange(at, min(at + 1024, len(graph.x))), low)
            continue
        cells = graph.cells(q[part], beam)
        order = np.argsort(cells, axis=None, kind="stable")
        first, order = np.searchsorted(cells.ravel()[order], np.arange(n + 1)), order // beam
        for cell in range(n):
            some = order[first[cell] : first[cell + 1]]
            yield from graph.compare(q, part[some], graph.met(cell), low, cell, cells[some])


def _low(threshold: float, x: np.ndarray) -> tuple[np.float32, np.float32]:
    """Below the first no product in single precision is a link, from the second on each is; the error bound is doubled."""
    doubt = (x.shape[1] + 16) * 2.0**-23
    return np.float32(threshold - max(1e-3, doubt)), np.float32(threshold + doubt)


def audit_of(graph: Graph, q: np.ndarray, own: np.ndarray, low: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Audited rows of q and, for each, which nodes it links with; own: the node that is the query itself, or -1."""
    order = np.argsort(mix64(np.arange(len(q), dtype=np.uint64) * MIX), kind="stable")[:AUDIT_MOST]
    rows, links, found = [np.zeros(0, np.int64)], [np.zeros((0, len(graph.x)), bool)], 0
    for lo in range(0, len(order), AUDITED):
        part = order[lo : lo + AUDITED]
        true = (q[part] @ graph.x.T) >= low
        mine = np.flatnonzero(own[part] >= 0)
        true[mine, own[part[mine]]] = False
        some = true.any(1)
        rows.append(part[some])
        links.append(true[some])
        found += int(some.sum())
        if found >= AUDITED:
            break
    return np.concatenate(rows), np.concatenate(links)


def beam_of(graph: Graph, q: np.ndarray, low: np.float32, own: np.ndarray) -> tuple[int, float, int]:
    """The beam that the audited queries of q need, their mean recall with it (1 if none has links), and how many have links."""
    rows, true = audit_of(graph, q, own, low)
    place = np.full(len(q), -1)
    place[rows] = np.arange(len(rows))
    beam = BEAM
    while True:
        got = np.zeros(true.shape, bool)
        for who, what, _ in _search(graph, q, rows, low, beam):
            got[place[who], what] = True
        recall = float(((got & true).sum(1) / np.maximum(1, true.sum(1))).mean()) if len(rows) else 1.0
        if recall >= AUDIT or beam >= len(graph.leaders):
            return beam, recall, len(rows)
        beam *= 2


def linked(graph: Graph, q: np.ndarray, threshold: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Pairs (query, node of the graph's order) that the audited search finds, the mean recall of the audited queries
    with links (1 if none has any), and how many those are."""
    low = _low(threshold, q)[0]
    beam, recall, audited = beam_of(graph, q, low, np.full(len(q), -1) if own is None else own)
    hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *(x[:2] for x in _search(graph, q, np.arange(len(q)), low, beam))]
    who, what = (np.concatenate(x) for x in zip(*hits))
    return who, what, recall, audited


def _matrix(table: pa.Table) -> np.ndarray:
    """The vectors of a table as its column has them, float or double."""
    col = table.column("v").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _unit32(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, np.float32)
    for lo in range(0, len(x), 8192):
        out[lo : lo + 8192] = _unit(x[lo : lo + 8192])
    return out


def _trimmed(run, *tables: pa.Table) -> pa.Table:
    try:
        return run(*tables)
    finally:
        trim()


def _build(table: pa.Table) -> pa.Table:
    raw, names, weight = _matrix(table), table.column("vec_id").to_numpy(), table.column("weight").to_numpy()
    graph = Graph(_unit32(raw), names)
    apart: list[pickle.PickleBuffer] = []
    small = pickle.dumps((graph.leaders, graph.homes, graph.layers, raw[graph.order], names[graph.order], weight[graph.order]), protocol=5, buffer_callback=apart.append)
    del raw, graph
    views = [memoryview(small), *(x.raw() for x in apart)]
    views = [memoryview(np.array([len(views), *map(len, views)], np.int64)).cast("B"), *views]
    pieces = [view[lo : lo + PIECE] for view in views for lo in range(0, len(view), PIECE)]
    same = lambda c: table.column(c).combine_chunks().take(pa.array([0] * len(pieces)))
    return pa.table({"dim": same("dim"), "shard": same("shard"), "piece": pa.array(range(len(pieces)), pa.int32()), "graph": pa.array(pieces, pa.binary())})


def _load(table: pa.Table) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of its pieces in any order, its vectors as the column had them, their names and weights; copied once."""
    pieces = [x.as_buffer() for x in table.column("graph")]
    pieces = [pieces[i] for i in np.argsort(table.column("piece").to_numpy())]
    held, at = np.empty(sum(x.size for x in pieces), np.uint8), 0
    for x in pieces:
        held[at : at + x.size] = np.frombuffer(x, np.uint8)
        at += x.size
    many = int(held[:8].view(np.int64)[0])
    ends = 8 * (many + 1) + np.cumsum([0, *held[8 : 8 * (many + 1)].view(np.int64)])
    small, *apart = (held[lo:hi].data for lo, hi in zip(ends[:-1], ends[1:]))
    leaders, homes, layers, raw, names, weight = pickle.loads(small, buffers=apart)
    return Graph.of(_unit32(raw), leaders, homes, layers), raw, names, weight


def _emitted(a, b, n, recall, audited) -> pa.Table:
    """Rows of one of three kinds: (a, n) links of a, (a, b) an edge of the forest, (recall, audited) of the block."""
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()), "recall": pa.array(recall, pa.float64()), "audited": pa.array(audited, pa.int64())})


def _tree(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges reduced to (node, smallest node reached)."""
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = find_roots(at[: len(a)], at[len(a) :], len(nodes))
    tree = root != np.arange(len(nodes))
    return nodes[tree], nodes[root[tree]]


def _query(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _emitted([], [], [], [], [])
        graph, x, names, weight = _load(right)
        asked, own = left.column("v"), left.column("vec_id").to_numpy()
        # of a shard with itself every link is found from both ends, of two shards from one
        pair = "block" in left.column_names and left.column("block")[0] != left.column("shard")[0]
        weight, own_weight = weight.astype(float), left.column("weight").to_numpy().astype(float) if pair else None
        order = np.argsort(names, kind="stable")
        at = order[np.minimum(np.searchsorted(names, own, sorter=order), len(names) - 1)]
        q, (low, sure) = _unit32(_matrix(left)), _low(threshold, x)
        beam, recall, audited = beam_of(graph, q, low, np.where(names[at] == own, at, -1))
        count, back, many = np.zeros(len(q)), np.zeros(len(names)), max(1, ROOM // (4 * 8 * x.shape[1]))
        root, a, b = np.arange(len(q) + len(names)), [], []
        for who, what, sims in _search(graph, q, np.arange(len(q)), low, beam):
            ok = own[who] != names[what]
            doubt = np.flatnonzero(ok & (sims < sure))
            for lo in range(0, len(doubt), many):
                d = doubt[lo : lo + many]
                ok[d] = np.einsum("nd,nd->n", _unit(_matrix(pa.table({"v": asked.take(pa.array(who[d]))}))), _unit(x[what[d]])) >= threshold
            who, what = who[ok], what[ok]
            if not len(who):
                continue
            np.add.at(count, who, weight[what])
            if pair:
                np.add.at(back, what, own_weight[who])
            new = root[who] != root[len(q) + what]
            a.append(root[who[new]])
            b.append(root[len(q) + what[new]])
            if sum(map(len, a)) > EDGES:
                root, a, b = find_roots(np.concatenate(a), np.concatenate(b), len(root))[root], [], []
        if a:
            root = find_roots(np.concatenate(a), np.concatenate(b), len(root))[root]
        both, moved = np.concatenate([own, names]), np.flatnonzero(root != np.arange(len(root)))
        a, b = _tree([both[moved]], [both[root[moved]]])
        some, other = np.flatnonzero(count > 0), np.flatnonzero(back > 0)
        linked_ids, n = np.concatenate([own[some], names[other]]), np.concatenate([count[some], back[other]]).astype(np.int64)
        edges, none = len(a), [None] * len(n)
        return _emitted([*linked_ids, *a, None], [*none, *b, None], [*n, *[None] * edges, None], [*none, *[None] * edges, recall], [*none, *[None] * edges, audited])

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding", with_recall: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links of cosine >= threshold between all vectors.

    with_recall adds audited_recall, the least recall that the audit of a pair of shards has ended with (1 if no
    audited query has links), and audited, the number of audited queries with links; both are alike in all rows.
    """
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vector).cast(f"array<{kind}>")
    big = F.lit(float("inf"))
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = settle(df.select(F.col(key).cast("long").alias("vec_id"), F.when(fine, v).alias("v")).select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")))
    fine_rows = rows.where("v is not null and vec_id is not null")
    classes = settle(fine_rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.max(F.size("v")).alias("dim")))
    reps = fine_rows.join(classes, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"])
    held = (classes.agg(F.sum("dim")).first()[0] or 0) * (4 if kind == "float" else 8)
    shards = max(SHARDS, -(-held // SHARD))
    reps = settle(reps.select("vec_id", "v", "weight", "dim", F.pmod("h1", F.lit(shards)).cast("int").alias("shard")))
    graphs = settle(reps.groupBy("dim", "shard").applyInArrow(lambda table: _trimmed(_build, table), "dim int, shard int, piece int, graph binary"))
    asked = reps.withColumnRenamed("shard", "block").withColumn("shard", F.explode(F.sequence(F.lit(0), "block")))
    dealt = graphs.withColumn("block", F.explode(F.sequence("shard", F.lit(shards - 1))))
    by, query = ["dim", "shard", "block"], _query(threshold)
    release(df.sparkSession)
    found = settle(asked.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(lambda left, right: _trimmed(query, left, right), "a long, b long, n long, recall double, audited long"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    verdict = settle(classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left").select("h1", "h2", "weight", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    recall = found.where("recall is not null").agg(F.coalesce(F.min("recall"), F.lit(1.0)), F.coalesce(F.sum("audited"), F.lit(0))).first() if with_recall else None
    for table in (classes, reps, graphs, found, parts):
        drop_settled(table)
    linked_rows = spread_join(fine_rows.select("vec_id", "h1", "h2"), verdict, ["h1", "h2"], "weight", [F.monotonically_increasing_id()]).select("vec_id", "n_links", "component_id")
    out = linked_rows.union(rows.where("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long"), "vec_id")).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out if recall is None else out.withColumns({"audited_recall": F.lit(float(recall[0])), "audited": F.lit(int(recall[1])).cast("long")})
