"""A gated recurrent unit with a class-factored softmax, in numpy: forward, truncated backpropagation, scoring.

Tokens come as symbols 0 .. SHORT + TAILS - 1. The first SHORT symbols are the most frequent words by rank, each with an
embedding and an output vector of its own; the others stand for all further words of a tail class.

    P(symbol | h) = softmax(Wc [h, 1])[class] * softmax(W2[words of the class] [h, 1])[word]

There are BINS classes of frequent words, narrow ones for the first ranks and wide ones for the last, and TAILS tail
classes, whose words share their class by corpus counts (see ``lm``); the second factor is 1 for these.

Documents run in lanes side by side. A lane's state is carried from window to window and set to zero at a document's
end; backpropagation stops at the window's start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

SHORT = 6_000
BINS = 48
TAILS = 24
SYMBOLS = SHORT + TAILS
CLASSES = BINS + TAILS
HIDDEN = 12
EMBED = 10
WINDOW = 32
#: Lanes of a training shard: one for so many tokens, within limits.
TOKENS_PER_LANE, LEAST_LANES, MOST_LANES = 8_192, 16, 1_024
SCORE_LANES = 1_024
#: Rows of a softmax at a time, so that it stays in the processor's cache.
ROWS = 512
#: Bounds of output weights and biases: states lie in [-1, 1], so that exp() of a logit can't overflow.
LIMIT, LOW_BIAS, HIGH_BIAS = 3.0, -20.0, 8.0

SHAPES = {
    "E": (SYMBOLS, EMBED),
    "P": (EMBED, 3 * HIDDEN),
    "b": (3 * HIDDEN,),
    "U": (HIDDEN, 3 * HIDDEN),
    "Wc": (CLASSES, HIDDEN + 1),
    "W2": (SHORT, HIDDEN + 1),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
Model = dict[str, np.ndarray]

#: First rank of each bin, and the end: widths grow with the square of the bin's number, one word at least.
EDGES = np.maximum(np.arange(BINS + 1), np.round(SHORT * (np.arange(BINS + 1) / BINS) ** 3).astype(np.int64))
BIN_OF = np.repeat(np.arange(BINS), np.diff(EDGES))
CLASS_OF = np.concatenate([BIN_OF, BINS + np.arange(TAILS)])


def unpack(flat: np.ndarray) -> Model:
    """The model's arrays as views of one flat vector."""
    found, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        found[name] = flat[at : at + n].reshape(shape)
        at += n
    return found


def initial(counts: np.ndarray, seed: int = 7) -> np.ndarray:
    """A flat model whose biases give the unigram distribution of ``counts`` by symbol."""
    rng, flat = np.random.default_rng(seed), np.zeros(SIZE, np.float32)
    m = unpack(flat)
    for name, scale in (("E", 0.3), ("P", 0.3), ("U", 0.2), ("Wc", 0.05), ("W2", 0.02)):
        m[name][...] = rng.normal(0, scale, SHAPES[name])
    m["b"][HIDDEN : 2 * HIDDEN] = 1.0  # at first the state is kept rather than replaced
    share = counts + 0.5
    of_class = np.bincount(CLASS_OF, share, CLASSES)
    m["Wc"][:, HIDDEN] = np.log(of_class / of_class.sum())
    m["W2"][:, HIDDEN] = np.log(share[:SHORT] / of_class[BIN_OF])
    bounded(m)
    return flat


def bounded(m: Model) -> None:
    for name in ("Wc", "W2"):
        np.clip(m[name][:, :HIDDEN], -LIMIT, LIMIT, out=m[name][:, :HIDDEN])
        np.clip(m[name][:, HIDDEN], LOW_BIAS, HIGH_BIAS, out=m[name][:, HIDDEN])


def lanes_of(lengths: np.ndarray, n: int) -> list[list[int]]:
    """Segments dealt to at most ``n`` lanes, the longest first and each to the shortest lane; longest lane first."""
    heap = [(0, k) for k in range(min(n, len(lengths)))]
    lanes: list[list[int]] = [[] for _ in heap]
    for s in np.argsort(-lengths, kind="stable").tolist():
        filled, k = heapq.heappop(heap)
        lanes[k].append(s)
        heapq.heappush(heap, (filled + int(lengths[s]), k))
    total = {k: filled for filled, k in heap}
    return [lanes[k] for k in sorted(total, key=lambda k: -total[k])]


def windows(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lanes: list[list[int]], width: int) -> Iterator:
    """(place, valid, ends) of each window, all (width, lanes): places in ``symbols``; true at a segment's last token."""
    size = [int(lengths[x].sum()) for x in lanes]
    order = np.concatenate([np.arange(starts[s], starts[s] + lengths[s], dtype=np.int32) for x in lanes for s in x])
    last = np.zeros(len(symbols), bool)
    last[starts + lengths - 1] = True
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    left = np.array(size)
    for t in range(0, int(left[0]), width):
        n = int(np.searchsorted(-left, -t, side="left"))  # lanes longer than t
        at = t + np.arange(width)[:, None]
        valid = at < left[None, :n]
        place = order[np.minimum(first[None, :n] + at, len(order) - 1)]
        yield place, valid, last[place] & valid


class Net:
    def __init__(self, flat: np.ndarray) -> None:
        self.m = unpack(flat)

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        return (self.m["E"][ids.reshape(-1)] @ self.m["P"] + self.m["b"]).reshape(*ids.shape, 3 * HIDDEN)

    def forward(self, x: np.ndarray, ends: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, dict]:
        """States before each token with a 1 behind, (T, n, H + 1), and in ``h`` the state after the window.

        ``x`` are the inputs of the window's symbols; what ``backward`` needs is kept if asked.
        """
        u_all, (steps, n, _), H = self.m["U"], x.shape, HIDDEN
        states = np.ones((steps, n, H + 1), np.float32)
        saved = {k: np.empty((steps, n, w), np.float32) for k, w in (("g", 2 * H), ("u", H), ("c", H))} if keep else {}
        gates, u, c = np.empty((n, 2 * H), np.float32), np.empty((n, 3 * H), np.float32), np.empty((n, H), np.float32)
        for t in range(steps):
            states[t, :, :H] = h
            np.matmul(h, u_all, out=u)
            # Gates are sigmoids, 1 / (1 + exp(-a)).
            np.add(x[t, :, : 2 * H], u[:, : 2 * H], out=gates)
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[:, :H], u[:, 2 * H :], out=c)
            c += x[t, :, 2 * H :]
            np.tanh(c, out=c)
            h -= c
            h *= gates[:, H:]
            h += c
            if keep:
                saved["g"][t], saved["u"][t], saved["c"][t] = gates, u[:, 2 * H :], c
            if ends[t].any():
                h[ends[t]] = 0
        return states, saved

    def outputs(
        self, hs: np.ndarray, targets: np.ndarray, grads: Model | None, unknown: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log P of each target; with ``grads``, adds the loss's gradients and returns that of the states too.

        With ``unknown``, the share of unknown words in each tail class, log P of an unknown word is returned instead.
        """
        m, classes = self.m, CLASS_OF[targets]
        order = np.argsort(classes.astype(np.uint8), kind="stable")
        hs, inner = hs[order], targets[order]
        classes = classes[order]
        log_p = np.empty(len(hs), np.float32)
        back = np.empty_like(hs) if grads is not None else None
        odd = np.empty(len(hs), np.float32) if unknown is not None else None
        for a in range(0, len(hs), ROWS):
            s = slice(a, a + ROWS)
            p, total = self._softmax(hs[s], m["Wc"], classes[s], log_p[s], back[s] if back is not None else None, grads and grads["Wc"])
            if odd is not None:
                odd[s] = np.log(p[:, BINS:] @ unknown / total)
        cuts = np.searchsorted(classes, np.arange(BINS + 1)).tolist()
        part = np.empty(len(hs), np.float32)
        more = np.empty_like(hs) if grads is not None else None
        for k, (low, high) in enumerate(zip(EDGES[:-1].tolist(), EDGES[1:].tolist(), strict=True)):
            if high - low > 1:
                for a in range(cuts[k], cuts[k + 1], ROWS):
                    s = slice(a, min(a + ROWS, cuts[k + 1]))
                    self._softmax(
                        hs[s], m["W2"][low:high], inner[s] - low, part[s],
                        more[s] if more is not None else None, grads and grads["W2"][low:high],
                    )
                    log_p[s] += part[s]
                    if back is not None:
                        back[s] += more[s]
        found = np.empty_like(log_p)
        found[order] = log_p
        if odd is not None:
            of_unknown = np.empty_like(odd)
            of_unknown[order] = odd
            return found, of_unknown
        if back is None:
            return found, None
        d_states = np.empty_like(back)
        d_states[order] = back
        return found, d_states

    @staticmethod
    def _softmax(hs, weights, targets, out, back, grads) -> tuple[np.ndarray, np.ndarray]:
        """Fills ``out`` with log P of the targets; gives exp of the logits, as far as no gradient is asked, and its sums."""
        p = hs @ weights.T
        rows = np.arange(len(hs))
        hit = p[rows, targets]
        np.exp(p, out=p)
        total = p @ np.ones(p.shape[1], np.float32)
        np.subtract(hit, np.log(total), out=out)
        if back is not None:
            p[rows, targets] -= total
            total = np.reciprocal(total)[:, None]
            np.matmul(p, weights, out=back)
            back *= total
            grads += p.T @ (hs * total)
        return p, total

    def backward(self, ids, ends, states, saved, d_states, grads: Model) -> None:
        m, (steps, n), H = self.m, ids.shape, HIDDEN
        dx, du = np.empty((steps, n, 3 * H), np.float32), np.empty((steps, n, 3 * H), np.float32)
        slope = saved["g"] * (1 - saved["g"])
        bend = 1 - saved["c"] * saved["c"]
        dh, back = np.zeros((n, H), np.float32), np.ascontiguousarray(m["U"].T)
        for t in range(steps - 1, -1, -1):
            if ends[t].any():
                dh[ends[t]] = 0
            r, z = saved["g"][t, :, :H], saved["g"][t, :, H:]
            dc = dh * (1 - z)
            dc *= bend[t]
            dx[t, :, 2 * H :] = dc
            np.multiply(dc, saved["u"][t], out=dx[t, :, :H])
            np.multiply(dh, states[t, :, :H] - saved["c"][t], out=dx[t, :, H : 2 * H])
            dx[t, :, : 2 * H] *= slope[t]
            du[t, :, : 2 * H] = dx[t, :, : 2 * H]
            np.multiply(dc, r, out=du[t, :, 2 * H :])
            dh *= z
            dh += du[t] @ back
            dh += d_states[t, :, :H]
        flat_dx, flat_ids = dx.reshape(-1, 3 * H), ids.reshape(-1)
        grads["U"] += np.ascontiguousarray(states[:, :, :H]).reshape(-1, H).T @ du.reshape(-1, 3 * H)
        grads["b"] += flat_dx.sum(axis=0)
        grads["P"] += m["E"][flat_ids].T @ flat_dx
        cells = (flat_ids[:, None] * EMBED + np.arange(EMBED)).reshape(-1)
        grads["E"] += np.bincount(cells, (flat_dx @ m["P"].T).reshape(-1), SYMBOLS * EMBED).reshape(SYMBOLS, EMBED)


class Adam:
    """Adam in blocks that stay in the processor's cache."""

    BLOCK = 32_768

    def __init__(self, n: int) -> None:
        self.one, self.two, self.steps = np.zeros(n, np.float32), np.zeros(n, np.float32), 0
        self.buffer = np.empty(self.BLOCK, np.float32)

    def step(self, flat: np.ndarray, grad: np.ndarray, rate: float) -> None:
        self.steps += 1
        rate *= float(np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps))
        for a in range(0, len(flat), self.BLOCK):
            s = slice(a, a + self.BLOCK)
            g, one, two = grad[s], self.one[s], self.two[s]
            x = self.buffer[: len(g)]
            one *= 0.9
            np.multiply(g, 0.1, out=x)
            one += x
            two *= 0.99
            g *= g
            g *= 0.01
            two += g
            np.sqrt(two, out=x)
            x += 1e-6
            np.divide(one, x, out=x)
            x *= rate
            flat[s] -= x
            g[:] = 0


def train(flat: np.ndarray, texts: list[np.ndarray], rate: float) -> tuple[np.ndarray, int]:
    """The model after one pass of Adam over documents of symbols, and the number of tokens."""
    lengths = np.array([len(x) for x in texts], np.int64)
    total = int(lengths.sum())
    if not total:
        return flat, 0
    symbols, starts = np.concatenate(texts).astype(np.int32), np.cumsum(lengths) - lengths
    lanes = lanes_of(lengths, int(np.clip(total // TOKENS_PER_LANE, LEAST_LANES, MOST_LANES)))
    flat, grad = flat.copy(), np.zeros_like(flat)
    net, adam, grads = Net(flat), Adam(len(flat)), unpack(grad)
    h, full = np.zeros((len(lanes), HIDDEN), np.float32), WINDOW * len(lanes)
    for place, valid, ends in windows(symbols, starts, lengths, lanes, WINDOW):
        ids, h = symbols[place], h[: place.shape[1]]
        states, saved = net.forward(net.inputs(ids), ends, h, keep=True)
        ok, all_states, targets = valid.reshape(-1), states.reshape(-1, HIDDEN + 1), ids.reshape(-1)
        if ok.all():
            _, d_states = net.outputs(all_states, targets, grads)
        else:  # lanes that end here; what follows their end has no part in the loss
            d_states = np.zeros_like(all_states)
            _, d_states[ok] = net.outputs(all_states[ok], targets[ok], grads)
        net.backward(ids, ends, states, saved, d_states.reshape(states.shape), grads)
        n = int(valid.sum())
        grad /= n
        adam.step(flat, grad, rate * float(np.sqrt(n / full)))  # the last lanes alone count for less
        bounded(net.m)
    return flat, total


def score(
    flat: np.ndarray, texts: list[np.ndarray], unknown: np.ndarray | None = None, at: list[np.ndarray] | None = None
) -> tuple[np.ndarray, list[np.ndarray]]:
    """The natural log-likelihood of each whole document of symbols.

    Also, for the places ``at`` of each document, what it gains if the word there, of a tail class, is an unknown one:
    then any tail class counts, by its share ``unknown`` of such words.
    """
    lengths = np.array([len(x) for x in texts], np.int64)
    if not len(lengths):
        return np.zeros(0), []
    symbols, starts = np.concatenate(texts).astype(np.int32), np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    lanes, net, found = lanes_of(lengths, SCORE_LANES), Net(flat), np.zeros(len(texts))
    table, shares = net.inputs(np.arange(SYMBOLS)), np.ones(TAILS, np.float32) if unknown is None else unknown.astype(np.float32)
    gains = np.zeros(len(symbols), np.float32)
    h = np.zeros((len(lanes), HIDDEN), np.float32)
    for place, valid, ends in windows(symbols, starts, lengths, lanes, WINDOW):
        ids, h = symbols[place], h[: place.shape[1]]
        states, _ = net.forward(table[ids], ends, h, keep=False)
        ok = valid.reshape(-1)
        log_p, of_unknown = net.outputs(states.reshape(-1, HIDDEN + 1)[ok], ids.reshape(-1)[ok], None, shares)
        here = place.reshape(-1)[ok]
        found += np.bincount(owner[here], log_p, len(texts))
        gains[here] = of_unknown - log_p
    return found, [gains[s + p] for s, p in zip(starts, at, strict=True)] if at is not None else []
