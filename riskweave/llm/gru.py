"""A small gated recurrent language model in numpy with a class-factored softmax.

Words are numbered by falling frequency. The first ones, the model's words, are cut into
classes of about equal mass; two more classes hold the other frequent words and the rare
ones. The probability of a word is that of its class times that within the class; within
the last two, ``WordTree`` has it from the state and the states before the word's
training tokens. Documents lie one after another in lanes that advance together; the state
is carried from window to window and reset where a document begins. Gradients stop at the
start of a window.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 8
CLASSES = 16
WINDOW = 24
LANES = 256
#: Input vectors that the words beyond the model's share, by their number or hash.
INPUTS = 4096
#: Average tokens that are added to those of a word or of a group of words.
PRIOR_TOKENS = 10.0
#: Tokens that a tree scores or adds up at once, and those of a group.
TREE_TOKENS = 400_000
GROUP_TOKENS = 4000


def word_classes(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """First word of each class, and the number of words at the end."""
    mass = np.cumsum(counts) / max(counts.sum(), 1)
    edges = np.searchsorted(mass, np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate([[0], np.minimum(edges, len(counts)), [len(counts)]]))


def initial(counts: np.ndarray, rest: tuple, edges: np.ndarray, seed: int = 1) -> dict:
    """Parameters whose outputs are the unigram model; ``rest`` are the last classes' tokens."""
    rng = np.random.default_rng(seed)
    words, classes = len(counts), len(edges) - 1
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    mass = np.append(np.add.reduceat(counts, edges[:-1]), rest) + 0.5
    return {
        "E": small(words + 1 + INPUTS, 3 * HIDDEN),  # inputs: words, a start, other words
        "U": small(HIDDEN, 3 * HIDDEN),
        "b": np.zeros(3 * HIDDEN, np.float32),
        "Wc": np.zeros((HIDDEN, classes + 2), np.float32),
        "bc": np.log(mass / mass.sum()).astype(np.float32),
        "Ww": np.zeros((HIDDEN, words), np.float32),
        "bw": np.log(counts + 0.5).astype(np.float32),
    }


class WordTree:
    """Probabilities of words given a state, by softmaxes along the path of a tree.

    Words are cut into groups of equal size, these into groups again. A node's vector is in
    closed form, that of a linear discriminant between the states before the training tokens
    of its words and those of its siblings, so that sums over tokens are all that's needed.

    ``unigram`` is each word's probability regardless of the state; ``sums`` has the sums of
    the states before its ``counts`` tokens, ``second`` those of the states' products.
    """

    def __init__(self, unigram: np.ndarray, counts: np.ndarray, sums: np.ndarray, second: np.ndarray, depth: int):
        words = len(unigram)
        self.whole = float(np.log(max(unigram.sum(), 1e-300)))
        self.width = next(b for b in range(1, words + 2) if b**depth >= words)
        self.mean = sums.sum(axis=0) / max(counts.sum(), 1)
        spread = second - counts.sum() * np.outer(self.mean, self.mean) + PRIOR_TOKENS * np.eye(HIDDEN)
        inverse = np.linalg.inv(spread / (counts.sum() + PRIOR_TOKENS))
        rows = self.width**depth
        grown = lambda x: np.concatenate([x, np.zeros((rows - words, *x.shape[1:]))])
        mass, met, off = grown(unigram), grown(counts), grown(sums - counts[:, None] * self.mean)
        self.levels = []
        for level in range(depth):
            nodes = self.width ** (level + 1)
            added = lambda x: x.reshape(nodes, -1, *x.shape[1:]).sum(axis=1)
            offset = added(off) / (added(met) + PRIOR_TOKENS)[:, None]
            vector = offset @ inverse
            with np.errstate(divide="ignore"):
                bias = np.log(added(mass)) - 0.5 * (offset * vector).sum(axis=1)
            bias = bias.reshape(-1, self.width)
            most = bias.max(axis=1, keepdims=True)
            bias = (bias - np.where(np.isfinite(most), most, 0)).astype(np.float32)
            vector = vector.astype(np.float32).reshape(-1, self.width, HIDDEN)
            # States and their mean lie within (-1, 1): exponents this small need no shift.
            small = 2 * np.abs(vector).sum(axis=2).max() < 60
            self.levels.append((vector, bias, small))

    def log_probabilities(self, words: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Natural logs of the words' probabilities; all words' add up to ``unigram``'s sum."""
        order = np.argsort(words.astype(np.int32))
        words = words[order].astype(np.int64)
        states = np.ascontiguousarray((states[order] - self.mean.astype(np.float32)).T)
        found = np.full(len(words), self.whole)
        for level, (vectors, biases, small) in enumerate(self.levels):
            node = words // self.width ** (len(self.levels) - 1 - level)
            group, mine = node // self.width, node % self.width
            cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(words)], strict=True):
                for at in range(lo, hi, GROUP_TOKENS):
                    to = min(at + GROUP_TOKENS, hi)
                    logits = vectors[group[at]] @ states[:, at:to]
                    logits += biases[group[at]][:, None]
                    if not small:
                        logits -= logits.max(axis=0)
                    found[at:to] += logits[mine[at:to], np.arange(to - at)]
                    found[at:to] -= np.log(np.exp(logits, out=logits).sum(axis=0))
        back = np.empty(len(words))
        back[order] = found
        return back


def lay_out(docs: list[np.ndarray]):
    """Targets, document numbers and starts of lanes, time first; -1 is filling."""
    total, longest = sum(map(len, docs)), max(map(len, docs))
    lanes = max(1, min(LANES, len(docs), max(total // max(longest, 1), 16)))
    order = np.argsort([-len(d) for d in docs], kind="stable")
    room = np.zeros(lanes, dtype=np.int64)
    of_lane: list[list[int]] = [[] for _ in range(lanes)]
    for i in order:
        lane = int(room.argmin())
        of_lane[lane].append(i)
        room[lane] += len(docs[i])
    # Longest lanes first: those still running are always the first ones.
    of_lane = [of_lane[i] for i in np.argsort(-room, kind="stable")]
    steps = int(room.max())
    target = np.full((steps, lanes), -1, dtype=np.int32)
    owner = np.full((steps, lanes), -1, dtype=np.int32)
    start = np.zeros((steps, lanes), dtype=bool)
    for lane, members in enumerate(of_lane):
        at = 0
        for i in members:
            n = len(docs[i])
            target[at : at + n, lane] = docs[i]
            owner[at : at + n, lane] = i
            start[at, lane] = True
            at += n
    return target, owner, start


def add_rows(table: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the row of ``table`` that its id names."""
    for k in range(rows.shape[1]):
        table[:, k] += np.bincount(ids, rows[:, k], len(table)).astype(table.dtype)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Model:
    """``frequent`` numbers are of words; higher ones are of rare words, by a hash.

    ``tree`` has the frequent words beyond the model's, for scoring.
    """

    def __init__(self, params: dict, edges: np.ndarray, frequent: int, tree: WordTree | None = None):
        self.p = {k: np.ascontiguousarray(v, dtype=np.float32) for k, v in params.items()}
        self.edges = edges
        words = int(edges[-1])
        self.words, self.frequent, self.tree = words, frequent, tree
        self.start = words
        classes = len(edges) - 1
        self.class_of = np.append(np.repeat(np.arange(classes), np.diff(edges)), [classes, classes + 1]).astype(np.int16)

    def states(self, inputs, fresh, h):
        """Gates and states of one window, time first; ``fresh`` resets the state."""
        p, H = self.p, HIDDEN
        x = p["E"][inputs] + p["b"]
        T, B, _ = x.shape
        zr = np.empty((T, B, 2 * H), np.float32)
        cand = np.empty((T, B, H), np.float32)
        rec = np.empty((T, B, H), np.float32)
        prev = np.empty((T, B, H), np.float32)
        out = np.empty((T, B, H), np.float32)
        for t in range(T):
            h = np.where(fresh[t][:, None], np.float32(0), h)
            prev[t] = h
            a = h @ p["U"]
            zr[t] = _sigmoid(x[t, :, : 2 * H] + a[:, : 2 * H])
            rec[t] = a[:, 2 * H :]
            cand[t] = np.tanh(x[t, :, 2 * H :] + zr[t, :, H:] * rec[t])
            z = zr[t, :, :H]
            h = out[t] = cand[t] + z * (h - cand[t])
        return zr, cand, rec, prev, out, h

    def outputs(self, h, target, grad=None):
        """Natural log probabilities of targets (``words``, ``words + 1``: the last classes)."""
        p = self.p
        cls = self.class_of[target]
        rows = np.arange(len(target))
        logits = h @ p["Wc"] + p["bc"]
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e @ np.ones(e.shape[1], np.float32)
        logp = logits[rows, cls] - np.log(total)
        dh = None
        if grad is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grad["Wc"] += h.T @ e
            grad["bc"] += e.sum(axis=0)
            dh = e @ p["Wc"].T
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(len(self.edges)))
        for c in range(len(self.edges) - 1):
            lo, hi = self.edges[c], self.edges[c + 1]
            at = order[cuts[c] : cuts[c + 1]]
            if hi - lo < 2 or not len(at):
                continue
            hc = h[at]
            w = p["Ww"][:, lo:hi]
            inner = hc @ w + p["bw"][lo:hi]
            inner -= inner.max(axis=1, keepdims=True)
            e = np.exp(inner)
            total = e @ np.ones(e.shape[1], np.float32)
            mine = (np.arange(len(at)), target[at] - lo)
            logp[at] += inner[mine] - np.log(total)
            if grad is not None:
                e /= total[:, None]
                e[mine] -= 1
                grad["Ww"][:, lo:hi] += hc.T @ e
                grad["bw"][lo:hi] += e.sum(axis=0)
                dh[at] += e @ w.T
        return logp, dh

    def backward(self, inputs, fresh, kept, dout, grad):
        """Gradients of one window from those of its states."""
        p, H = self.p, HIDDEN
        zr, cand, rec, prev, _ = kept
        T, B, _ = zr.shape
        dx = np.empty((T, B, 3 * H), np.float32)
        da = np.empty((T, B, 3 * H), np.float32)
        dh = np.zeros((B, H), np.float32)
        ut = p["U"].T.copy()
        for t in range(T - 1, -1, -1):
            dh = dh + dout[t]
            z, r = zr[t, :, :H], zr[t, :, H:]
            dc = dh * (1 - z) * (1 - cand[t] * cand[t])
            dz = dh * (prev[t] - cand[t]) * z * (1 - z)
            dr = dc * rec[t] * r * (1 - r)
            dx[t, :, :H], dx[t, :, H : 2 * H], dx[t, :, 2 * H :] = dz, dr, dc
            da[t, :, : 2 * H] = dx[t, :, : 2 * H]
            da[t, :, 2 * H :] = dc * r
            dh = dh * z + da[t] @ ut
            dh[fresh[t]] = 0
        grad["U"] += prev.reshape(-1, H).T @ da.reshape(-1, 3 * H)
        flat = dx.reshape(-1, 3 * H)
        grad["b"] += flat.sum(axis=0)
        add_rows(grad["E"], inputs.reshape(-1), flat)

    def run(self, docs: list[np.ndarray], learn=None, sums=None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each document without its rare words' within their class, and
        the states before these words, document by document.

        In training ``learn(grad)`` is called per window, and ``sums`` gets the states before
        the frequent words beyond the model's, then these states' products; these words
        aren't scored then within their class.
        """
        scores = np.zeros(len(docs))
        states: list = [np.zeros((0, HIDDEN), np.float16)]
        places: list = [np.zeros(0, np.int64)]
        waiting: list = []

        def handle_waiting():
            numbers, owners, before = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            if learn is not None:
                add_rows(sums, numbers, before)
                sums[-HIDDEN:] += before.T @ before
                return
            found = self.tree.log_probabilities(numbers, before)
            scores[:] += np.bincount(owners, found, minlength=len(docs))

        if not docs:
            return scores, states[0]
        code, owner, start = lay_out(docs)
        steps, lanes = code.shape
        target = np.where(code >= self.frequent, np.int32(self.words + 1), np.minimum(code, np.int32(self.words)))
        inputs = np.empty_like(code)
        inputs[0] = self.start
        last = np.maximum(code[:-1], 0)
        last = np.where(last >= self.words, self.words + 1 + last % INPUTS, last)
        inputs[1:] = np.where(start[1:], self.start, last)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for at in range(0, steps, WINDOW):
            to = min(at + WINDOW, steps)
            running = int((target[at] >= 0).sum())
            x, fresh, h = inputs[at:to, :running], start[at:to, :running], h[:running]
            *kept, h = self.states(x, fresh, h)
            goal = target[at:to, :running].reshape(-1)
            real = np.flatnonzero(goal >= 0)
            hs = kept[4].reshape(-1, HIDDEN)[real]
            grad = None
            if learn is not None:
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
            logp, dh = self.outputs(hs, goal[real], grad)
            numbers = code[at:to, :running].reshape(-1)[real]
            owners = owner[at:to, :running].reshape(-1)[real]
            middle = np.flatnonzero((numbers >= self.words) & (numbers < self.frequent))
            waiting.append((numbers[middle] - self.words, owners[middle], hs[middle]))
            if sum(len(x) for x, *_ in waiting) > TREE_TOKENS:
                handle_waiting()
            if learn is None:
                rare = np.flatnonzero(numbers >= self.frequent)
                states.append(hs[rare].astype(np.float16))
                places.append(owners[rare].astype(np.int64) * steps + at + real[rare] // running)
            scores += np.bincount(owners, logp.astype(float), minlength=len(docs))
            if learn is not None:
                dout = np.zeros((len(goal), HIDDEN), np.float32)
                dout[real] = dh
                self.backward(x, fresh, kept, dout.reshape(to - at, running, HIDDEN), grad)
                learn(grad)
        if waiting:
            handle_waiting()
        return scores, np.concatenate(states)[np.argsort(np.concatenate(places))]


class Adagrad:
    def __init__(self, model: Model, rate: float = 0.1, first: float = 0.01):
        self.model, self.rate = model, rate
        self.squares = {k: np.full_like(v, first) for k, v in model.p.items()}

    def __call__(self, grad: dict) -> None:
        # One scale for all windows: those at the end, with few lanes, move little.
        scale = np.float32(1 / (LANES * WINDOW) ** 0.5)
        for k, g in grad.items():
            g *= scale
            self.squares[k] += g * g
            self.model.p[k] -= self.rate * g / np.sqrt(self.squares[k])
