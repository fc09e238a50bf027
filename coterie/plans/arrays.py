"""One individual at a time as arrays over a broadcast graph: the population-parallel side of the operators.

Nodes are places 0..n-1 in id order; a label vector names a community by any
number.  The relational side of the same definitions is in ``coterie.operators``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 65_536  #: communities whose edges are lists at a time


@dataclass
class Csr:
    ids: np.ndarray
    start: np.ndarray
    adj: np.ndarray
    deg: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, src: np.ndarray, dst: np.ndarray) -> Csr:
        u, v = np.concatenate([src, dst]), np.concatenate([dst, src])
        order = np.lexsort((v, u))
        deg = np.bincount(u, minlength=len(ids))
        return cls(ids, np.concatenate([[0], np.cumsum(deg)]), v[order], deg)

    @property
    def n(self) -> int:
        return len(self.ids)

    @property
    def m(self) -> int:
        return len(self.adj) // 2

    def rows(self) -> np.ndarray:
        """The first end of every directed edge."""
        return np.repeat(np.arange(self.n), self.deg)

    def around(self, u: int) -> np.ndarray:
        return self.adj[self.start[u] : self.start[u + 1]]

    def edges_of(self, nodes: np.ndarray) -> np.ndarray:
        """The places in ``adj`` of the edges of ``nodes``, node after node."""
        counts = self.deg[nodes]
        return np.repeat(self.start[nodes] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class GraphView:
    """The graph as custom objectives see it: node ids as the caller knows them."""

    def __init__(self, csr: Csr):
        self.csr = csr

    def nodes(self) -> list[int]:
        return self.csr.ids.tolist()

    def edges(self) -> list[tuple[int, int]]:
        u = self.csr.rows()
        once = u < self.csr.adj
        return list(zip(self.csr.ids[u[once]].tolist(), self.csr.ids[self.csr.adj[once]].tolist(), strict=True))

    def place(self, node: int) -> int:
        at = int(np.searchsorted(self.csr.ids, node))
        if at == self.csr.n or self.csr.ids[at] != node:
            raise KeyError(node)
        return at

    def neighbors(self, node: int) -> list[int]:
        return self.csr.ids[self.csr.around(self.place(node))].tolist()

    def degree(self, node: int) -> int:
        return int(self.csr.deg[self.place(node)])

    def partition(self, labels: np.ndarray) -> dict[int, int]:
        return dict(zip(self.csr.ids.tolist(), labels.tolist(), strict=True))


def canonical(labels: np.ndarray) -> np.ndarray:
    """Each label replaced by the first place that bears it."""
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    return first[back]


def community_sums(g: Csr, labels: np.ndarray):
    _, dense = np.unique(labels, return_inverse=True)
    same = dense[g.rows()] == dense[g.adj]
    k = dense.max() + 1 if len(dense) else 0
    inside = np.bincount(dense[g.rows()][same], minlength=k)
    return dense, same, np.bincount(dense, minlength=k), np.bincount(dense, weights=g.deg, minlength=k), inside


def objective_vector(g: Csr, labels: np.ndarray, name: str, r: float = 1.0, alpha: float = 1.0) -> list[float]:
    """A named objective set, minimised; the definitions are those of ``operators.objectives``."""
    dense, same, size, degsum, inside = community_sums(g, labels)
    two_m = float(len(g.adj))
    values = {}
    if name in ("intra_inter", "cs_cf_q", "kkm_rc_q"):
        intra = 1 - inside.sum() / two_m if two_m else 0.0
        inter = ((degsum / two_m) ** 2).sum() if two_m else 0.0
        values |= {"intra": intra, "inter": inter, "q": 1 - intra - inter if two_m else 0.0}
    if name in ("kkm_rc", "kkm_rc_q"):
        values |= {"kkm": 2.0 * (len(labels) - len(size)) - (inside / size).sum(), "rc": ((degsum - inside) / size).sum()}
    if name.startswith("cs_cf"):
        k_in = np.bincount(g.rows()[same], minlength=g.n).astype(float)
        mu = np.bincount(dense, weights=(k_in / size[dense]) ** r, minlength=len(size)) / size
        values |= {"cs": (mu * inside).sum(), "cf": (k_in[g.deg > 0] / g.deg[g.deg > 0] ** alpha).sum()}
    from coterie.operators.objectives import SETS

    return [float(values[c] * sign) for c, sign in SETS[name]]


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each place over links ``a, b``."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def split_parts(g: Csr, labels: np.ndarray) -> np.ndarray:
    u = g.rows()
    same = labels[u] == labels[g.adj]
    return components_of(g.n, u[same], g.adj[same])


def majority(g: Csr, labels: np.ndarray, nodes: np.ndarray, weights: np.ndarray | None = None, stepwise: bool = False) -> np.ndarray:
    """``nodes`` take the heaviest label around them; of equal ones the label that reached its weight first in id order.

    All at once from a snapshot, or (``stepwise``) one after another.
    """
    out = labels.copy()
    if stepwise:
        for u in nodes.tolist():
            a, b = g.start[u], g.start[u + 1]
            near = g.adj[a:b]
            total: dict[int, float] = {}
            last: dict[int, int] = {}
            for v, x, w in zip(near.tolist(), out[near].tolist(), np.ones(b - a) if weights is None else weights[a:b].tolist(), strict=True):
                total[x] = total.get(x, 0.0) + w
                last[x] = v  # neighbours come in id order
            if total:
                out[u] = min(total, key=lambda x: (-round(total[x], 9), last[x]))
        return out
    nodes = nodes[g.deg[nodes] > 0]
    if not len(nodes):
        return out
    counts = g.deg[nodes]
    at = g.edges_of(nodes)
    who, lab, v = np.repeat(np.arange(len(nodes)), counts), labels[g.adj[at]], g.adj[at]
    order = np.lexsort((v, lab, who))
    who, lab, v = who[order], lab[order], v[order]
    w = np.ones(len(at)) if weights is None else weights[at][order]
    first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (lab[1:] != lab[:-1])))
    total, last = np.add.reduceat(w, first), np.maximum.reduceat(v, first)
    who, lab = who[first], lab[first]
    best = np.lexsort((last, -np.round(total, 9), who))
    top = best[np.append(True, who[best][1:] != who[best][:-1])]
    out[nodes[who[top]]] = lab[top]
    return out


def propagate_from(g: Csr, centres: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Labels spread from centres in ascending sweeps; a node keeps its label on ties; unreached parts take their least place.

    A sweep visits the neighbours of what the last one changed, so its time does not grow with the graph.
    """
    labels = np.full(g.n, -1)
    labels[centres] = centres
    fixed = np.zeros(g.n, bool)
    fixed[centres] = True
    waiting = np.unique(g.adj[g.edges_of(centres)])
    for _ in range(g.n):
        waiting = waiting[~fixed[waiting]]
        if not len(waiting):
            break
        changed = []
        for u in waiting.tolist():
            near = g.around(u)
            lab, w = labels[near], weights[g.start[u] : g.start[u + 1]]
            pull: dict[int, float] = {}
            for x, y in zip(lab.tolist(), w.tolist(), strict=True):
                if x >= 0:
                    pull[x] = pull.get(x, 0.0) + y
            if pull:
                best, own = max(pull.values()), int(labels[u])
                if own < 0 or pull.get(own, 0.0) < best:
                    labels[u] = min(x for x, y in pull.items() if y == best)
                    changed.append(u)
        waiting = np.unique(g.adj[g.edges_of(np.array(changed, int))])
    unset = labels < 0
    if unset.any():
        u = g.rows()
        both = unset[u] & unset[g.adj]
        labels[unset] = components_of(g.n, u[both], g.adj[both])[unset]
    return labels


def encode(g: Csr, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each community the place of largest weight to its own, the lowest on ties."""
    u = g.rows()
    same = labels[u] == labels[g.adj]
    own = np.bincount(u[same], weights=weights[same], minlength=g.n)
    order = np.lexsort((np.arange(g.n), -np.round(own, 9), labels))
    return np.sort(order[np.append(True, labels[order][1:] != labels[order][:-1])])


def absorb(g: Csr, labels: np.ndarray, weights: np.ndarray, most_size: int = 2, rounds: int = 5) -> np.ndarray:
    """Communities of up to ``most_size`` join their heaviest neighbour, one after another by label.

    One sort lists the members of all small communities that have an edge; they are read ``BLOCK`` communities at a time.
    """
    labels = labels.copy()
    for _ in range(rounds):
        names, dense, sizes = np.unique(labels, return_inverse=True, return_counts=True)
        linked = np.zeros(len(names), bool)
        linked[dense[g.deg > 0]] = True
        members = np.flatnonzero((linked & (sizes <= most_size))[dense])
        members = members[np.argsort(dense[members], kind="stable")]
        own = dense[members]
        firsts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.arange(0)
        ends = np.append(firsts[1:], len(own))
        moved = False
        for i in range(0, len(firsts), BLOCK):
            a, b = firsts[i : i + BLOCK], ends[i : i + BLOCK]
            nodes = members[a[0] : b[-1]]
            at = g.edges_of(nodes)
            cuts = np.append(0, np.cumsum(g.deg[nodes]))
            near, labs, ws = g.adj[at].tolist(), dense[g.adj[at]].tolist(), weights[at].tolist()
            now: dict[int, int] = {}  # what this block has moved
            for c, first, end, e, f in zip(own[a].tolist(), a.tolist(), b.tolist(), cuts[a - a[0]].tolist(), cuts[b - a[0]].tolist(), strict=True):
                inside, outside = 0.0, {}
                for v, x, w in zip(near[e:f], labs[e:f], ws[e:f], strict=True):
                    x = now.get(v, x)
                    if x == c:
                        inside += w / 2
                    else:
                        outside[x] = outside.get(x, 0.0) + w
                if outside:
                    target = max(outside, key=lambda x: (outside[x], sizes[x], -x)) if len(outside) > 1 else next(iter(outside))
                    if end - first == 1 or inside == 0 or outside[target] > inside:
                        now.update((u, target) for u in members[first:end].tolist())
            if now:
                dense[list(now)] = list(now.values())
                moved = True
        if not moved:
            break
        labels = names[dense]
    return labels


def climb(g: Csr, labels: np.ndarray, sweeps: int = 64) -> np.ndarray:
    """Modularity ascent by single moves in ascending order (the first phase of Louvain)."""
    labels = canonical(labels)
    total = np.bincount(labels, weights=g.deg, minlength=g.n)
    two_m = max(len(g.adj), 1)
    for _ in range(sweeps):
        moved = False
        for u in range(g.n):
            if not g.deg[u]:
                continue
            own = int(labels[u])
            ties: dict[int, int] = {}
            for x in labels[g.around(u)].tolist():
                ties[x] = ties.get(x, 0) + 1
            total[own] -= g.deg[u]
            gain = {x: t - total[x] * g.deg[u] / two_m for x, t in ties.items()}
            stay = gain.get(own, -total[own] * g.deg[u] / two_m)
            best = min(gain, key=lambda x: (-gain[x], x))
            if gain[best] > stay + 1e-12 and best != own:
                labels[u] = own = best
                moved = True
            total[own] += g.deg[u]
        if not moved:
            break
    return labels


def diffusion_kernel(g: Csr, beta: float) -> np.ndarray:
    """``exp(beta (A - D))``."""
    a = np.zeros((g.n, g.n))
    a[g.rows(), g.adj] = 1
    values, vectors = np.linalg.eigh(beta * (a - np.diag(g.deg)))
    return (vectors * np.exp(values)) @ vectors.T


def ensemble(parents: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Node by node the first label that two parents share in their order; one at random if all differ."""
    stack = np.array(parents)
    out = stack[rng.integers(len(parents), size=stack.shape[1]), np.arange(stack.shape[1])]
    open_ = np.ones(stack.shape[1], bool)
    for i in range(1, len(parents)):
        hit = open_ & (stack[:i] == stack[i]).any(axis=0)
        out[hit] = stack[i][hit]
        open_ &= ~hit
    return out


def tally(parents: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """Node by node the commonest label; a tie is drawn."""
    stack = np.array(parents)
    votes = (stack[:, None] == stack[None]).sum(axis=1) + rng.random(stack.shape) * 0.5
    # all bearers of one label share its first bearer's draw
    for i in range(1, len(stack)):
        for j in range(i):
            same = stack[i] == stack[j]
            votes[i][same] = votes[j][same]
    return stack[votes.argmax(axis=0), np.arange(stack.shape[1])]


def grafted(receiver: np.ndarray, donor: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    chosen = donor[rng.integers(len(donor))]
    return np.where(donor == chosen, chosen, receiver)
