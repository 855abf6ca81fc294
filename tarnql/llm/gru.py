"""A gated recurrent language model in numpy, with a class-factored output.

The vocabulary is ``head`` frequent words and ``tail`` classes of all other words.  The
output is a softmax over classes times a softmax over the words of the class: frequent
words form classes of ``WIDTH`` by rank, both factors depending on the state; within a
tail class, words keep their share in the corpus counts, which the caller applies.
Biases start at the logarithms of the counts, so an untrained model is the unigram model.

Texts run in lanes, one after the other, the state reset at each text's start and carried
from window to window: likelihoods are of whole texts, while gradients stop at a window's
edge (truncated backpropagation through time).
"""

from __future__ import annotations

import heapq
import math

import numpy as np

HIDDEN, HEAD, WIDTH, TAIL = 16, 1024, 32, 32
HEAD_CLASSES = HEAD // WIDTH
CLASSES = HEAD_CLASSES + TAIL
START = HEAD + TAIL
START_LANES, TRAIN_LANES, TRAIN_WINDOW = 16, 128, 32
SCORE_LANES, SCORE_WINDOW = 256, 64
#: Steps of a window whose outputs are computed at once, so that they stay in the cache; no score depends on it.
SCORE_STEPS = 16
RATE = 0.1
#: Tokens of a text that train as one sequence; scores are of whole texts.
PIECE = 2048
NAMES = ("E", "U", "V", "Wc", "bc", "Ww", "bw")


def fresh(head_counts: np.ndarray, tail_masses: np.ndarray) -> dict[str, np.ndarray]:
    """An untrained model from counts (0 for an unused place) of head words by rank, and of tail classes."""
    rng = np.random.default_rng(7)
    words = np.zeros(HEAD)
    words[: len(head_counts)] = head_counts
    mass = np.concatenate([words.reshape(HEAD_CLASSES, WIDTH).sum(axis=1), tail_masses]) + 1e-9
    noise = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "E": noise(START + 1, 3 * HIDDEN), "U": noise(HIDDEN, 2 * HIDDEN), "V": noise(HIDDEN, HIDDEN),
        "Wc": np.zeros((HIDDEN, CLASSES), np.float32), "bc": np.log(mass / mass.sum()).astype(np.float32),
        "Ww": np.zeros((HEAD, HIDDEN), np.float32), "bw": np.log(words + 1e-9).astype(np.float32),
    }


def lanes(ids: np.ndarray, lengths: np.ndarray, width: int, longest_first: bool = True):
    """Texts laid out in lanes, each after the other in the lane that has the least: inputs and targets (steps x lanes, longest lane first; target -1 where a lane has ended), the text of each place, and starts."""
    width = max(1, min(width, len(lengths)))
    offsets = np.cumsum(lengths) - lengths
    heap = [(0, k) for k in range(width)]
    members: list[list[int]] = [[] for _ in range(width)]
    for d in np.argsort(-lengths, kind="stable").tolist() if longest_first else range(len(lengths)):
        load, k = heapq.heappop(heap)
        members[k].append(d)
        heapq.heappush(heap, (load + int(lengths[d]), k))
    load = np.array([int(lengths[m].sum()) for m in members])
    order = np.argsort(-load, kind="stable")
    target = np.full((width, int(load.max(initial=0))), -1, np.int32)
    given = np.full(target.shape, START, np.int32)
    text = np.full(target.shape, -1, np.int32)
    for row, k in enumerate(order.tolist()):
        at = 0
        for d in members[k]:
            n = int(lengths[d])
            own = ids[offsets[d] : offsets[d] + n]
            target[row, at : at + n] = own
            given[row, at + 1 : at + n] = own[:-1]
            text[row, at : at + n] = d
            at += n
    return given.T, target.T, text.T


class Room:
    """Arrays that one window after the other uses: fresh ones of a megabyte cost more in page faults than in sums."""

    def __init__(self, m):
        self.kind, self.held = m["U"].dtype, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        """An array of any content; the next call of this name overwrites it."""
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.kind)
        return self.held[name][:size].reshape(shape)

    def flat(self, name: str, x: np.ndarray) -> np.ndarray:
        """Steps x rows x lanes as rows x places."""
        steps, rows, n = x.shape
        out = self(name, rows, steps, n)
        np.copyto(out, x.transpose(1, 0, 2))
        return out.reshape(rows, steps * n)

    def columns(self, name: str, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        # all are in range: other modes would go through one more buffer
        return np.take(x, at, axis=1, out=self(name, len(x), len(at)), mode="clip")


def _forward(m, given, h, room: Room, keeps: bool = True):
    """States after each step of a window (steps x hidden x lanes), the last ones, and with ``keeps`` what its gradient needs.

    Lanes are the last axis, so that gates and states and their slices are contiguous.
    """
    H, (steps, n) = HIDDEN, given.shape
    rows = np.take(m["E"], given.ravel(), axis=0, out=room("rows", given.size, 3 * H), mode="clip")
    gates = room("gates", steps, 3 * H, n)
    np.copyto(gates, rows.reshape(steps, n, 3 * H).transpose(0, 2, 1))
    U, V = -m["U"].T, m["V"].T
    goes_on = (given != START).astype(room.kind)
    whole = goes_on.all(axis=1).tolist()
    states = room("states", steps, H, n)
    places = steps if keeps else 1
    before, zr, rh, cand = (room(name, places, rows, n) for name, rows in (("before", H), ("zr", 2 * H), ("rh", H), ("cand", H)))
    h = h.T
    for t in range(steps):
        k = t if keeps else 0
        h0, g, rest, c = before[k], zr[k], rh[k], cand[k]
        if whole[t]:
            h0[:] = h
        else:
            np.multiply(h, goes_on[t], out=h0)
        # sigmoids: of negated sums, 1 / (1 + exp)
        np.matmul(U, h0, out=g)
        g -= gates[t, : 2 * H]
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        np.multiply(g[H:], h0, out=rest)
        np.matmul(V, rest, out=c)
        c += gates[t, 2 * H :]
        np.tanh(c, out=c)
        h = np.subtract(h0, c, out=states[t])
        h *= g[:H]
        h += c
    return states, h.T.copy(), (before, zr, rh, cand, goes_on, whole)


def _classes(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // WIDTH, ids - HEAD + HEAD_CLASSES)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column by column, the logarithm of one entry's probability, and the sum of what ``x`` becomes, exponentials."""
    x -= x.max(axis=0)
    chosen = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return chosen - np.log(total), total


def _by_class(ids: np.ndarray):
    """Places of tokens (-1: none) in order of their classes, those of head words first; their ids and classes; (words, first, end) of each class of head words."""
    # sixteen bits are sorted by radix
    cls = np.where(ids < 0, CLASSES, _classes(ids)).astype(np.int16)
    order = np.argsort(cls, kind="stable")[: np.count_nonzero(ids >= 0)]
    cls = cls[order]
    cuts = np.searchsorted(cls, np.arange(HEAD_CLASSES + 1)).tolist()
    return order, ids[order], cls, [(slice(c * WIDTH, (c + 1) * WIDTH), cuts[c], cuts[c + 1]) for c in range(HEAD_CLASSES) if cuts[c] < cuts[c + 1]]


def _outputs(m, states, ids: np.ndarray, room: Room):
    """Of tokens in order of classes (``_by_class``, which is the last result): logarithms of probabilities; states, with a row of ones for the biases; exponentials and their sums over classes, and over the words of head words' classes."""
    found = order, ids, cls, classes = _by_class(ids)
    s = room("with ones", HIDDEN + 1, len(order))
    np.take(room.flat("flat", states), order, axis=1, out=s[:HIDDEN], mode="clip")
    s[HIDDEN] = 1
    p = np.matmul(np.vstack([m["Wc"], m["bc"]]).T, s, out=room("classes", CLASSES, len(order)))
    logp, total = _softmax(p, cls)
    heads = classes[-1][2] if classes else 0
    q, W = room("words", WIDTH, heads), np.column_stack([m["Ww"], m["bw"]])
    for words, a, b in classes:
        np.matmul(W[words], s[:, a:b], out=q[:, a:b])
    within, part = _softmax(q, ids[:heads] % WIDTH)
    logp[:heads] += within
    return logp, s, (p, total), (q, part), found


def log_likelihoods(m, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text, the sum of natural logarithms of class and head-word probabilities."""
    given, target, text = lanes(ids, lengths, SCORE_LANES)
    out, room = np.zeros(len(lengths)), Room(m)
    h = np.zeros((given.shape[1], HIDDEN), np.float32)
    for k in range(0, len(given), SCORE_WINDOW):
        n = int((target[k] >= 0).sum())
        x, y, d = (a[k : k + SCORE_WINDOW, :n] for a in (given, target, text))
        states, h, _ = _forward(m, x, h[:n], room, keeps=False)
        logp = np.zeros(y.shape)
        for j in range(0, len(x), SCORE_STEPS):
            own = slice(j, j + SCORE_STEPS)
            found, _, _, _, (order, *_) = _outputs(m, states[own], y[own].ravel(), room)
            logp[own].reshape(-1)[order] = found
        live = y >= 0
        out += np.bincount(d[live], logp[live], len(lengths))
    return out


def _gradients(m, x, y, h, full: int | None = None, room: Room | None = None):
    """Of a window's loss by ``full`` tokens (as many as it has, if not given); also the state at its end and the summed loss."""
    H, (steps, width) = HIDDEN, x.shape
    room = room or Room(m)
    states, last, (before, zr, rh, cand, goes_on, whole) = _forward(m, x, h, room)
    logp, s, (p, total), (q, part), (order, ids, cls, classes) = _outputs(m, states, y.ravel(), room)
    loss, count, heads = -logp.sum(), len(ids), len(part)
    n = np.float32(full or count)
    p /= total
    p[cls, np.arange(count)] -= 1
    q /= part
    q[ids[:heads] % WIDTH, np.arange(heads)] -= 1
    outer = s @ p.T
    inner = np.zeros((HEAD, H + 1), room.kind)
    # the last column is for places without a token
    ds = room("ds", H, count + 1)
    ds[:, count] = 0
    np.matmul(m["Wc"], p, out=ds[:, :count])
    for words, a, b in classes:
        np.matmul(q[:, a:b], s[:, a:b].T, out=inner[words])
        ds[:, a:b] += m["Ww"][words].T @ q[:, a:b]
    g = {"Wc": outer[:H], "bc": outer[H], "Ww": inner[:, :H], "bw": inner[:, H]}
    at = np.full(y.size, count)
    at[order] = np.arange(count)
    dstates = room("dstates", steps, H, width)
    np.copyto(dstates, room.columns("in order", ds, at).reshape(H, steps, width).transpose(1, 0, 2))
    # what each step's gradients are multiplied by
    z, r = zr[:, :H], zr[:, H:]
    by_n, by_z, by_r = (room(name, steps, H, width) for name in ("by_n", "by_z", "by_r"))
    np.subtract(1, z, out=by_n)
    np.subtract(before, cand, out=by_z)
    by_z *= by_n
    by_z *= z
    cand *= cand
    by_n -= np.multiply(by_n, cand, out=cand)
    np.subtract(1, r, out=by_r)
    by_r *= r
    by_r *= before
    da = room("da", steps, 3 * H, width)
    dh = np.zeros((H, width), room.kind)
    for k in range(steps - 1, -1, -1):
        dh += dstates[k]
        dzr, dn = da[k, : 2 * H], da[k, 2 * H :]
        np.multiply(dh, by_z[k], out=dzr[:H])
        np.multiply(dh, by_n[k], out=dn)
        drh = m["V"] @ dn
        np.multiply(drh, by_r[k], out=dzr[H:])
        dh *= z[k]
        drh *= r[k]
        dh += drh
        dh += m["U"] @ dzr
        if not whole[k]:
            dh *= goes_on[k]
    flat = room.flat("flat da", da)
    g["U"] = room.flat("flat", before) @ flat[: 2 * H].T
    g["V"] = room.flat("flat", rh) @ flat[2 * H :].T
    given = x.ravel().astype(np.int16)
    order = np.argsort(given, kind="stable")
    given = given[order]
    first = np.flatnonzero(np.concatenate([[True], given[1:] != given[:-1]]))
    rows = given[first], np.add.reduceat(room.columns("by word", flat, order), first, axis=1).T / n
    return {k: v / n for k, v in g.items()}, rows, last, loss


def still(m) -> dict[str, np.ndarray]:
    """The sums of squared gradients (AdaGrad) of a model that has seen nothing."""
    return {k: np.full(v.shape, 1e-3, np.float32) for k, v in m.items()}


def pieces(lengths: np.ndarray, size: int) -> np.ndarray:
    """Lengths of texts of which the longer ones are cut into pieces of ``size``."""
    n = -(-lengths // size)
    out = np.full(int(n.sum()), size, np.int64)
    out[np.cumsum(n) - 1] = lengths - (n - 1) * size
    return out


def train(m, sums, ids: np.ndarray, lengths: np.ndarray, width: int = 0) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], float]:
    """The model and its sums after one more pass over some texts in their order, and the mean loss on the way.

    A text longer than ``PIECE`` trains in pieces, so that no lane is much longer than the
    others.  A window with few texts left moves the model little: its loss is divided by
    the tokens of a full one.
    """
    m, sums = ({k: v.copy() for k, v in x.items()} for x in (m, sums))
    width = width or TRAIN_LANES
    given, target, _ = lanes(ids, pieces(lengths, PIECE), width, longest_first=False)
    h = np.zeros((given.shape[1], HIDDEN), np.float32)
    total, room = 0.0, Room(m)
    for k in range(0, len(given), TRAIN_WINDOW):
        n = int((target[k] >= 0).sum())
        g, (rows, dE), h, loss = _gradients(m, given[k : k + TRAIN_WINDOW, :n], target[k : k + TRAIN_WINDOW, :n], h[:n], width * TRAIN_WINDOW, room)
        total += loss
        for name, d in g.items():
            sums[name] += d * d
            m[name] -= RATE * d / np.sqrt(sums[name])
        sums["E"][rows] += dE * dE
        m["E"][rows] -= RATE * dE / np.sqrt(sums["E"][rows])
    return m, sums, total / max(1, len(ids))


def packed(m, sums) -> np.ndarray:
    return np.concatenate([x[k].ravel() for x in (m, sums) for k in NAMES]).astype(np.float32)


def unpacked(flat: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    half = len(flat) // 2
    return _unpacked(flat[:half]), _unpacked(flat[half:])


def _unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    H = HIDDEN
    shapes = {"E": (START + 1, 3 * H), "U": (H, 2 * H), "V": (H, H), "Wc": (H, CLASSES), "bc": (CLASSES,), "Ww": (HEAD, H), "bw": (HEAD,)}
    out, at = {}, 0
    for name in NAMES:
        n = int(np.prod(shapes[name]))
        out[name] = np.asarray(flat[at : at + n], np.float32).reshape(shapes[name])
        at += n
    return out
