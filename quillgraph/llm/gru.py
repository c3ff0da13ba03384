"""A gated recurrent network with a class-factored softmax, in numpy.

Ids: 0 is the end of a text, up to ``HEAD`` are frequent words, then come ``TAIL`` classes of
the other words. A frequent word's probability is its class's times its own within the
class; a tail class is a class of its own.

Arrays have units in rows and texts in columns, so that each gate of a step is one block of memory.
"""

from __future__ import annotations

import numpy as np

HEAD, PER_CLASS, TAIL, HIDDEN = 1024, 32, 64, 16
HEAD_CLASSES = HEAD // PER_CLASS
CLASSES = HEAD_CLASSES + TAIL
IDS = HEAD + TAIL
#: Steps that a gradient goes back; the state goes on to the next window.
WINDOW = 16
#: Texts that learn side by side, at most; fewer where there are few tokens.
LANES = 512

Weights = dict[str, np.ndarray]


def initial(counts: np.ndarray, seed: int) -> Weights:
    """Weights under which each id has its share of ``counts`` whatever came before."""
    rng = np.random.default_rng(seed)
    share = counts.astype(np.float64) + 0.5
    head = share[:HEAD].reshape(HEAD_CLASSES, PER_CLASS)
    classes = np.concatenate([head.sum(1), share[HEAD:]])
    w = {
        "input": rng.normal(size=(3 * HIDDEN, IDS)) * 0.3,
        "hidden": rng.normal(size=(3 * HIDDEN, HIDDEN)) / np.sqrt(HIDDEN),
        "bias": np.concatenate([np.full(HIDDEN, -1.0), np.zeros(2 * HIDDEN)]),
        "to_class": np.zeros((CLASSES, HIDDEN)),
        "class_bias": np.log(classes / classes.sum()),
        "to_word": np.zeros((HEAD_CLASSES, PER_CLASS, HIDDEN)),
        "word_bias": np.log(head / head.sum(1, keepdims=True)),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


def advance(w: Weights, ids: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States (units x steps x texts) after each row of ``ids`` (steps x texts), from ``h`` (units x texts). A state is cleared where a text begins (id -1)."""
    n, (steps, texts), one = HIDDEN, ids.shape, np.float32(1)
    out = np.empty((n, steps, texts), np.float32)
    begins = ids < 0
    fresh = begins.any(1).tolist()
    x = np.take(w["input"] + w["bias"][:, None], np.maximum(ids, 0), axis=1)
    hidden = w["hidden"]
    if keep is not None:
        keep |= {"old": np.empty((n, steps, texts), np.float32), "gates": np.empty((2 * n, steps, texts), np.float32), "u": np.empty((n, steps, texts), np.float32), "new": np.empty((n, steps, texts), np.float32)}
    for t in range(steps):
        if fresh[t]:
            h = np.where(begins[t], np.float32(0), h)
        u = hidden @ h
        gates = u[: 2 * n]
        gates += x[: 2 * n, t]
        np.negative(gates, gates)
        np.exp(gates, gates)
        gates += one
        np.reciprocal(gates, gates)
        new = gates[n:] * u[2 * n :]
        new += x[2 * n :, t]
        np.tanh(new, new)
        if keep is not None:
            keep["old"][:, t], keep["gates"][:, t], keep["u"][:, t], keep["new"][:, t] = h, gates, u[2 * n :], new
        new -= h
        new *= gates[:n]
        new += h
        out[:, t] = h = new
    return out


def class_of(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < HEAD, ids // PER_CLASS, ids - HEAD + HEAD_CLASSES)


def _shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of each column, in place, and the logarithm of their sum, up to a factor of the column's own."""
    e = np.exp(x)
    total = e.sum(0)
    if not (np.isfinite(total).all() and (total > 0).all()):
        top = x.max(0)
        e = np.exp(x - top)
        total = e.sum(0)
        e /= total
        return e, np.log(total) + top
    e /= total
    return e, np.log(total)


def _by_class(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of frequent words, class by class, and each class with its first and past-the-end place among them."""
    order = np.argsort(group.astype(np.int16), kind="stable")
    ends = np.searchsorted(group[order], np.arange(HEAD_CLASSES + 1)).tolist()
    return order[: ends[-1]], [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]


def log_probability(w: Weights, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural logarithm of each id's probability after its state (columns)."""
    out, group = np.empty(len(ids), np.float32), class_of(ids)
    for at in range(0, len(ids), 2048):  # columns that stay in the cache
        own = group[at : at + 2048]
        x = w["to_class"] @ states[:, at : at + 2048]
        x += w["class_bias"][:, None]
        out[at : at + 2048] = x[own, np.arange(len(own))] - _shares(x)[1]
    order, classes = _by_class(group)
    sorted_states, words, inner = np.take(states, order, axis=1), ids[order] % PER_CLASS, np.empty(len(order), np.float32)
    for k, a, b in classes:
        x = w["to_word"][k] @ sorted_states[:, a:b]
        x += w["word_bias"][k][:, None]
        inner[a:b] = x[words[a:b], np.arange(b - a)] - _shares(x)[1]
    out[order] += inner
    return out


def gradients(w: Weights, before: np.ndarray, ids: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[Weights, np.ndarray, float]:
    """Of the mean loss over a window (steps x texts), the last state and the loss. ``before`` are the ids one step earlier."""
    keep: dict = {}
    n, shape = HIDDEN, before.shape
    states = advance(w, before, h, keep)
    flat, target, weight = states.reshape(n, -1), ids.ravel(), (live / max(1, live.sum())).ravel().astype(np.float32)
    columns, group = np.arange(len(target)), class_of(target)
    x = w["to_class"] @ flat
    x += w["class_bias"][:, None]
    said = x[group, columns]
    d, total = _shares(x)
    loss = float((total - said) @ weight)
    d[group, columns] -= 1
    d *= weight
    g = {"to_class": d @ flat.T, "class_bias": d.sum(1), "to_word": np.zeros_like(w["to_word"]), "word_bias": np.zeros_like(w["word_bias"])}
    dh = w["to_class"].T @ d
    order, classes = _by_class(group)
    sorted_states, words, weights, inner = np.take(flat, order, axis=1), target[order] % PER_CLASS, weight[order], np.zeros((n, len(order) + 1), np.float32)
    for k, a, b in classes:
        own, row = sorted_states[:, a:b], (words[a:b], np.arange(b - a))
        x = w["to_word"][k] @ own
        x += w["word_bias"][k][:, None]
        said = x[row]
        e, total = _shares(x)
        loss += float((total - said) @ weights[a:b])
        e[row] -= 1
        e *= weights[a:b]
        g["to_word"][k], g["word_bias"][k] = e @ own.T, e.sum(1)
        inner[:, a:b] = w["to_word"][k].T @ e
    place = np.full(len(target), len(order))  # the last column of ``inner`` is zero
    place[order] = np.arange(len(order))
    dh += np.take(inner, place, axis=1)
    dh = dh.reshape(states.shape)
    update, reset, old, new = keep["gates"][:n], keep["gates"][n:], keep["old"], keep["new"]
    # What a state's gradient is multiplied by, for all steps at once.
    to_new = update * (1 - new * new)
    to_update = (new - old) * update * (1 - update)
    to_reset = keep["u"] * reset * (1 - reset)
    stay = 1 - update
    hidden, back, begins = w["hidden"].T.copy(), np.zeros_like(h), before < 0
    fresh = begins.any(1).tolist()
    dx, du = np.empty((3 * n, *shape), np.float32), np.empty((3 * n, *shape), np.float32)
    step = np.empty((3 * n, shape[1]), np.float32)
    for t in range(shape[0] - 1, -1, -1):
        back += dh[:, t]
        np.multiply(back, to_update[:, t], step[:n])
        dnew = back * to_new[:, t]
        np.multiply(dnew, to_reset[:, t], step[n : 2 * n])
        np.multiply(dnew, reset[:, t], step[2 * n :])
        du[:, t] = step
        dx[2 * n :, t] = dnew
        back *= stay[:, t]
        back += hidden @ step
        if fresh[t]:
            back[:, begins[t]] = 0
    dx[: 2 * n] = du[: 2 * n]
    g["hidden"], g["bias"] = du.reshape(3 * n, -1) @ old.reshape(n, -1).T, dx.sum((1, 2))
    seen = np.maximum(before, 0).ravel()
    g["input"] = np.stack([np.bincount(seen, row, IDS) for row in dx.reshape(3 * n, -1)]).astype(np.float32)
    return g, np.ascontiguousarray(states[:, -1]), loss


class Adam:
    """Over all weights as one vector."""

    def __init__(self, w: Weights):
        size = sum(x.size for x in w.values())
        self.m, self.s, self.t = np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def update(self, w: Weights, g: Weights, rate: float) -> None:
        self.t += 1
        flat = np.concatenate([g[k].ravel() for k in w])
        flat *= np.float32(min(1.0, 1.0 / (float(np.sqrt(flat @ flat)) + 1e-9)))
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * flat
        flat *= flat
        self.s *= np.float32(0.99)
        self.s += np.float32(0.01) * flat
        step = np.sqrt(self.s)
        step *= np.float32((1 - 0.99**self.t) ** -0.5)
        step += np.float32(1e-6)
        np.divide(self.m, step, step)
        step *= np.float32(rate / (1 - 0.9**self.t))
        at = 0
        for x in w.values():
            x -= step[at : at + x.size].reshape(x.shape)
            at += x.size


def streams(texts: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, one after the other, cut into lanes of equal length: ids before, targets (steps x lanes), which of them are live, and the ids that lead up to each lane.

    A text is its ids, which end with 0; -1 is before its first.
    """
    target = np.concatenate(texts).astype(np.int32)
    before = np.concatenate([np.array([-1], np.int32), target[:-1]])
    before[np.cumsum([len(x) for x in texts])[:-1]] = -1
    steps = -(-len(target) // lanes)
    lanes = -(-len(target) // steps)
    pad = lanes * steps - len(target)
    live = np.arange(lanes * steps).reshape(lanes, steps) < len(target)
    led = np.concatenate([np.full(2 * WINDOW, -1, np.int32), before])
    leads = np.stack([led[k * steps : k * steps + 2 * WINDOW] for k in range(lanes)])
    laid = [np.ascontiguousarray(np.pad(x, (0, pad), constant_values=fill).reshape(lanes, steps).T) for x, fill in ((before, -1), (target, 0))]
    return laid[0], laid[1], np.ascontiguousarray(live.T), leads.T


def lanes_of(tokens: int) -> int:
    """Lanes for so many tokens: enough windows for the weights to settle come first."""
    return int(max(16, min(LANES, tokens // (WINDOW * 64))))


def train(w: Weights, texts: list[np.ndarray], times: np.ndarray, rate: float, seed: int) -> Weights:
    """Truncated backpropagation over whole texts, each as often as ``times`` has it: windows of each lane in turn, the state carried
    from one to the next. A lane that begins within a text takes its state from the ids that lead up to it."""
    w, rng = {k: v.copy() for k, v in w.items()}, np.random.default_rng(seed)
    adam, sizes = Adam(w), np.array([len(x) for x in texts])
    total, done = max(1, int((sizes * times).sum())), 0
    for turn in range(int(times.max())):
        order = rng.permutation(np.flatnonzero(times > turn))
        before, target, live, leads = streams([texts[k] for k in order.tolist()], lanes_of(int(sizes[order].sum())))
        h = advance(w, leads, np.zeros((HIDDEN, before.shape[1]), np.float32))[:, -1]
        for t in range(0, len(before), WINDOW):
            part = live[t : t + WINDOW]
            g, h, _ = gradients(w, before[t : t + WINDOW], target[t : t + WINDOW], part, h)
            adam.update(w, g, rate * (1 - 0.7 * done / total))
            done += int(part.sum())
    return w

