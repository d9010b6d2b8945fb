"""Elimination in K + eta I of many locations with a cut kernel, rows in the order of the coordinate that makes the envelope least.

Barrier tasks hold the strips of rows that a pivot block reaches, every
so many strips one, and send each other a block column in each step; nothing is
written.  All tasks together hold half the square of the envelope's width, for
each of the sums below, and time grows with the locations times that square.

Derivatives by the size of one or two diagonal matrices added to the matrix are
eliminated beside it: they are traces of the inverse.  Columns of a border Y are
eliminated as more rows, which leaves -Y' M^-1 Y in the corner.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from multiprocessing.connection import Client, Listener

import numpy as np
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

from gaussmill.functions.kernels import Kernel
from gaussmill.runtime import ship_package

#: Rows of a strip, columns evaluated and changed at once, and numbers of eliminated columns that a task keeps for substitution.
HEIGHT, WIDE, CHUNK, KEPT = 256, 4096, 1024, 60_000_000


@dataclass
class Envelope:
    """Locations x over their scales, in order, with weights; row r has entries from row first[r] on."""

    x: np.ndarray
    w: np.ndarray
    eta: float
    kernel: Kernel
    threshold: float | None
    height: int
    order: np.ndarray = field(repr=False)
    low: np.ndarray = field(repr=False)  # the first strip that a strip has entries in

    @classmethod
    def of(cls, x: np.ndarray, w: np.ndarray, scale: list[float], kernel: Kernel, threshold: float | None, eta: float) -> Envelope:
        x = x / np.array(scale)
        reach = kernel.reach(threshold) * (1 + 1e-9) if threshold is not None else math.inf
        best = None
        for k in range(x.shape[1]):
            order = np.lexsort((*(x[:, j] for j in range(x.shape[1]) if j != k), x[:, k]))
            first = np.searchsorted(x[order, k], x[order, k] - reach)
            size = ((np.arange(len(x)) - first).astype(float) ** 2).sum()
            if best is None or size < best[0]:
                best = size, order, first
        _, order, first = best
        return cls(x[order], w[order], eta, kernel, threshold, HEIGHT, order, first[::HEIGHT] // HEIGHT)

    @property
    def count(self) -> int:
        return len(self.low)

    def span(self, s: int) -> slice:
        return slice(s * self.height, min(len(self.x), (s + 1) * self.height))

    def until(self, n: int) -> Envelope:
        """Of the first n strips."""
        at = n * self.height
        return Envelope(self.x[:at], self.w[:at], self.eta, self.kernel, self.threshold, self.height, self.order[:at], self.low[:n])

    def rows(self, s: int, base: int) -> np.ndarray:
        """The entries of a strip's rows from column `base` to its diagonal block."""
        at = self.span(s)
        out = np.empty((at.stop - at.start, at.stop - base))
        for a in range(base, at.stop, WIDE):
            b = min(at.stop, a + WIDE)
            total = np.zeros((at.stop - at.start, b - a))
            for k in range(self.x.shape[1]):
                total += (self.x[at, k, None] - self.x[None, a:b, k]) ** 2
            v = self.kernel(np.sqrt(total, out=total))
            out[:, a - base : b - base] = (v if self.threshold is None else np.multiply(v, v >= self.threshold, out=v)) * self.w[at, None] * self.w[a:b]
        place = np.arange(at.stop - at.start)
        out[place, at.start - base + place] += self.eta
        return out

    def kept_from(self, tasks: int) -> int:
        """The first of the last strips whose eliminated columns the tasks can keep."""
        t, held = self.count, 0
        while t:
            at = self.span(t - 1)
            # strip t - 1 joins with its own columns, and its block column joins all kept strips that reach it
            held += (at.stop - at.start) * sum(self.span(s).stop - self.span(s).start for s in range(t - 1, self.count) if self.low[s] <= t - 1)
            if held > tasks * KEPT and t < self.count:
                break
            t -= 1
        return t


class Ring:
    """Connections of every barrier task to every other."""

    def __init__(self, context: BarrierTaskContext | None, key: bytes):
        self.rank, self.size, self.links = 0, 1, {}
        if context is None:
            return
        infos, self.rank = context.getTaskInfos(), context.partitionId()
        self.size = len(infos)
        with Listener(("", 0), backlog=self.size, authkey=key) as door:
            ports = [int(p) for p in context.allGather(str(door.address[1]))]
            for other in range(self.rank):
                self.links[other] = Client((infos[other].address.rsplit(":", 1)[0], ports[other]), authkey=key)
                self.links[other].send(self.rank)
            for _ in range(self.rank + 1, self.size):
                link = door.accept()
                self.links[link.recv()] = link
        self.pool = ThreadPoolExecutor(max(1, self.size - 1))

    def all(self, mine: np.ndarray) -> list[np.ndarray]:
        """Everyone's numbers, flat, in the order of ranks."""
        mine = np.ascontiguousarray(mine, float).ravel()
        sent = [self.pool.submit(link.send_bytes, memoryview(mine).cast("B")) for link in self.links.values()] if len(mine) else []
        if not len(mine):
            for link in self.links.values():
                link.send_bytes(b"")
        out = [mine if r == self.rank else np.frombuffer(self.links[r].recv_bytes()) for r in range(self.size)]
        for s in sent:
            s.result()
        return out

    def close(self) -> None:
        for link in self.links.values():
            link.close()


def _terms(states: int) -> list[list[tuple[int, int]]]:
    """Pairs of terms whose products make each term of a product: the value, its derivatives by s and t, and by both, as bits."""
    return [[(a, k ^ a) for a in range(k + 1) if a & k == a] for k in range(states)]


def _product(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [sum(a[i] @ b[j] for i, j in of) for of in _terms(len(a))]


def _inverse(d: list[np.ndarray]) -> tuple[list[np.ndarray], int, np.ndarray]:
    """The inverse of a block and its derivatives, the number of negative eigenvalues, and the logarithm of the determinant's size with its derivatives."""
    own = (d[0] + d[0].T) / 2
    try:
        logs, negative = [2 * float(np.log(np.diag(np.linalg.cholesky(own))).sum())], 0
        p = [np.linalg.inv(own)]
    except np.linalg.LinAlgError:
        lam, u = np.linalg.eigh(own)
        logs, negative = [float(np.log(np.abs(lam)).sum())], int((lam < 0).sum())
        p = [(u / lam) @ u.T]
    turned = [p[0] @ m for m in d]
    for k in range(1, len(d)):
        p.append(-turned[k] @ p[0])
        logs.append(float(np.trace(turned[k])))
    if len(d) == 4:
        p[3] = p[3] + turned[1] @ turned[2] @ p[0] + turned[2] @ turned[1] @ p[0]
        logs[3] -= float((turned[1] * turned[2].T).sum())
    return p, negative, np.array(logs)


def _eliminate(ring: Ring, m: Envelope, added: list[np.ndarray], border: np.ndarray, keep: int, definite: bool):
    """Runs in every task; see `eliminated`."""
    states, n, q = 1 << len(added), len(m.x), border.shape[1]
    held: dict[int, list[np.ndarray]] = {}
    base: dict[int, int] = {}
    pivots: dict[int, np.ndarray] = {}
    high = [int(np.searchsorted(m.low, k, side="right")) for k in range(m.count)]  # the strips before it reach k; low ascends
    size = lambda s: m.span(s).stop - m.span(s).start
    edge = [np.ascontiguousarray(border.T)] + [np.zeros((q, n)) for _ in range(states - 1)]
    corner, negative, logs, spare = np.zeros((states, q, q)), 0, np.zeros(states), np.empty((m.height, CHUNK))
    for k in range(m.count):
        at = m.span(k)
        for s in range(k, high[k]):
            if s % ring.size == ring.rank and s not in held:
                base[s] = m.low[s] * m.height
                own = m.span(s)
                held[s] = [m.rows(s, base[s])] + [np.zeros((size(s), own.stop - base[s])) for _ in range(states - 1)]
                for a, v in enumerate(added):
                    place = np.arange(size(s))
                    held[s][1 << a][place, own.start - base[s] + place] = v[own]
        block = lambda s, e: held[s][e][:, at.start - base[s] : at.stop - base[s]]
        owned = [[s for s in range(k, high[k]) if s % ring.size == r] for r in range(ring.size)]
        mine = owned[ring.rank]
        got = ring.all(np.stack([np.vstack([block(s, e) for s in mine]) for e in range(states)]) if mine else np.zeros(0))
        below = m.span(high[k] - 1).stop - at.stop
        d, c = [None] * states, [np.empty((below, at.stop - at.start)) for _ in range(states)]
        for strips, flat in zip(owned, got, strict=True):
            if strips:
                whole, start = flat.reshape(states, -1, at.stop - at.start), 0
                for s in strips:
                    for e in range(states):
                        part = whole[e, start : start + size(s)]
                        if s == k:
                            d[e] = part
                        else:
                            c[e][m.span(s).start - at.stop : m.span(s).stop - at.stop] = part
                    start += size(s)
        p, less, log = _inverse(d)
        negative, logs = negative + less, logs + log
        if definite and negative:
            break
        for s in mine:
            if s > k:
                to = m.span(s).stop - at.stop
                w = _product([block(s, e) for e in range(states)], p)
                for e, of in enumerate(_terms(states)):
                    target = held[s][e][:, at.stop - base[s] :]
                    for i, j in of:
                        for a in range(0, to, CHUNK):
                            b = min(to, a + CHUNK)
                            target[:, a:b] -= np.matmul(w[i], c[j][a:b].T, out=spare[: len(w[i]), : b - a])
                done = at.stop - base[s]
                if k < keep and 4 * done >= held[s][0].shape[1]:
                    for e in range(states):
                        held[s][e] = held[s][e][:, done:].copy()
                    base[s] = at.stop
        if k >= keep:
            if k % ring.size == ring.rank:
                pivots[k] = p[0]
        else:
            held.pop(k, None)
        if ring.rank == ring.size - 1 and q:
            y = [v[:, at].copy() for v in edge]
            w = _product(y, p)
            for e, of in enumerate(_terms(states)):
                for i, j in of:
                    edge[e][:, at.stop : at.stop + below] -= w[i] @ c[j].T
                    corner[e] -= w[i] @ y[j].T
    if keep == m.count or (definite and negative):
        return negative, logs, ring.all(corner)[-1].reshape(states, q, q), None
    u = np.zeros((n, q))
    right = ring.all(edge[0][:, m.span(keep).start :] if ring.rank == ring.size - 1 else np.zeros(0))[-1].reshape(q, -1)
    for k in reversed(range(keep, m.count)):
        at = m.span(k)
        part = np.zeros((at.stop - at.start, q))
        for s in range(k + 1, high[k]):
            if s % ring.size == ring.rank:
                part += held[s][0][:, at.start - base[s] : at.stop - base[s]].T @ u[m.span(s)]
        sums = sum(v.reshape(-1, q) for v in ring.all(part))
        first = m.span(keep).start
        mine = pivots[k] @ (right[:, at.start - first : at.stop - first].T - sums) if k in pivots else np.zeros(0)
        u[at] = ring.all(mine)[k % ring.size].reshape(-1, q)
    return negative, logs, None, u[m.span(keep).start :]


def tasks_of(spark: SparkSession) -> int:
    """Tasks that run at the same time; barriers don't work with executors that come and go."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    return max(1, spark.sparkContext.defaultParallelism // int(spark.conf.get("spark.task.cpus", "1")))


def _run(spark: SparkSession, m: Envelope, added: list[np.ndarray], border: np.ndarray, keep: int, definite: bool):
    ship_package(spark)
    count, key = min(tasks_of(spark), m.count), secrets.token_bytes(16)
    sent = spark.sparkContext.broadcast((m, added, border))

    def work(_):
        ring = Ring(BarrierTaskContext.get() if count > 1 else None, key)
        try:
            out = _eliminate(ring, *sent.value, keep, definite)
        finally:
            ring.close()
        if ring.rank == 0:
            yield out

    tasks = spark.sparkContext.parallelize(range(count), count)
    out = (tasks.barrier() if count > 1 else tasks).mapPartitions(work).collect()[0]
    sent.destroy()
    return out


def eliminated(spark: SparkSession, m: Envelope, added: tuple[np.ndarray, ...] = (), border: np.ndarray | None = None, definite: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of negative eigenvalues of M, log |det M| and -Y' M^-1 Y, the latter two followed by their derivatives by s, by t and by both of M + s A + t B.

    A and B are the diagonal matrices `added`, none, one or two; `definite` stops at the first negative eigenvalue.
    """
    border = np.zeros((len(m.x), 0)) if border is None else border
    return _run(spark, m, [v[m.order] for v in added], border[m.order], m.count, definite)[:3]


def solve(spark: SparkSession, m: Envelope, y: np.ndarray, product: Callable[[np.ndarray], np.ndarray], tol: float) -> np.ndarray:
    """M^-1 y, `product` being v -> M v; corrected until every residual falls below tol times its right side.

    An elimination keeps what the last rows need for substitution; the rows before them form a lesser system, which is eliminated anew.
    """
    norm, x, before = np.linalg.norm(y, axis=0), np.zeros_like(y), math.inf
    r = y.copy()
    while True:
        size = float(np.max(np.linalg.norm(r, axis=0) / np.where(norm > 0, norm, 1.0), initial=0.0))
        if size <= tol:
            return x
        if not size < 0.5 * before:
            raise ArithmeticError(f"elimination leaves a residual of {size:.1e}: the matrix is close to singular")
        before, part, right, left = size, np.zeros_like(y), r, m
        while left.count:
            keep = left.kept_from(min(tasks_of(spark), left.count))
            own = left.order[left.span(keep).start :]
            part[own] = _run(spark, left, [], right[left.order], keep, False)[3]
            left = left.until(keep)
            right = r - product(part) if left.count else right
        x = x + part
        r = y - product(x)
