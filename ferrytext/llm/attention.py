"""A small causal self-attention language model in numpy.

A text is cut into rows of ``FRESH`` ids. A row is scored by a window of ``WINDOW`` ids, the row before it and itself, so
windows overlap by half, and each id is scored once and sees ``FRESH`` ids before it at least. An attention layer with a
causal mask predicts the class of the next id, as a correction of how often each class follows the id before it in the
corpus. An id's share of its class comes from corpus counts too: of the pair with the id before it if the pair is
among those remembered, else of the id alone; what is discounted from pairs goes to ids, so all shares of a class sum to 1.

All products of embeddings and weights are tables at scoring time, so a window needs three matrix products. Each is made for
one window at a time: a product over all rows of a batch may round a row by its place and the batch's size, and a text's
score must not depend on the texts beside it.
"""

from __future__ import annotations

import numpy as np

WINDOW, FRESH = 16, 8
CLASSES, WIDTH, INPUTS = 96, 16, 2048
HEADS = 64
#: Adam's largest step in the pass over all windows, a fifth of that in which the network starts.
PASS_RATE = 0.002
#: Rows of logits that are held at once, so that they stay in a core's cache.
ROOM_ROWS = 512
#: What is taken from every pair's count for ids that it was not seen with, and what an id's count is raised by.
DISCOUNT, SMOOTH = 0.75, 0.1
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def heads_of(counts: np.ndarray) -> np.ndarray:
    """Places of the most frequent ids; all others share the last of HEADS."""
    out = np.full(len(counts), HEADS - 1)
    first = np.argsort(-counts, kind="stable")[: HEADS - 1]
    first = first[counts[first] > 0]
    out[first] = np.arange(len(first))
    return out


def classes_of(counts: np.ndarray, before: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """A class per id: k-means on the (reduced) counts of the heads before it; unseen ids are in class 0."""
    seen = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    out = np.zeros(len(counts), np.int64)
    if len(seen) < classes:
        out[seen] = np.arange(len(seen))
        return out
    weight = counts[seen].astype(float)
    profile = before[seen].astype(np.float32)
    share = profile.sum(0, dtype=float)
    sums = profile.sum(1, keepdims=True, dtype=float).astype(np.float32)
    profile += (0.1 * share / share.sum()).astype(np.float32)
    profile /= sums + np.float32(0.1)
    np.sqrt(profile, out=profile)
    profile -= profile.mean(0, dtype=float).astype(np.float32)
    _, values, axes = np.linalg.svd(profile[:1024], full_matrices=False)
    points = (profile @ axes[:12].T).astype(float)
    centres = points[: classes - 1].copy()
    for _ in range(12):
        near = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        mass = np.bincount(near, weight, classes - 1)
        for axis in range(points.shape[1]):
            sums = np.bincount(near, weight * points[:, axis], classes - 1)
            centres[:, axis] = np.where(mass > 0, sums / np.maximum(mass, 1e-9), centres[:, axis])
    out[seen] = near + 1
    return out


def framed(flat: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts (their ids one after the other, and how many each has) in whole rows of FRESH places, and the first row of
    each: a row of ends, then an end, the text, an end, and places with ``end + 1`` that don't count. One place follows, as a
    text's last end may stand right after its rows; if it doesn't, there is ``end + 1``, which is read as an end."""
    rows = 1 + -(-(sizes + 1) // FRESH)
    first = np.cumsum(rows) - rows
    stream = np.full(int(rows.sum()) * FRESH + 1, end + 1, np.int64)
    base = first * FRESH
    stream[base[:, None] + np.arange(1, FRESH + 1)] = end
    stream[base + FRESH + 1 + sizes] = end
    stream[np.repeat(base + FRESH + 1 - np.cumsum(sizes) + sizes, sizes) + np.arange(len(flat))] = flat
    return stream, first


def scored_rows(stream: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The rows of a framed stream that hold ids to be scored: all but the first of each text."""
    rows = np.ones(len(stream) // FRESH, bool)
    rows[first] = False
    return np.flatnonzero(rows)


def windows_of(stream: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """What each of ``rows`` needs: its window and one id more."""
    return stream[(rows[:, None] - 1) * FRESH + np.arange(WINDOW + 1)]


class Pairs:
    """Log shares of remembered pairs of ids, by two places each may stand at; of pairs that want the same places those
    given first are kept."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys) - 1).bit_length()) if len(keys) else 4
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.float32)
        left, self.kept = np.arange(len(keys)), np.zeros(len(keys), bool)
        for multiplier in _MULTIPLIERS:
            at = self._place(keys[left], multiplier)
            free = self.keys[at] == 0
            left, at = left[free], at[free]
            at, one = np.unique(at, return_index=True)
            self.keys[at] = keys[left[one]] + np.uint64(1)
            self.kept[left[one]] = True
            left = np.flatnonzero(~self.kept)

    def _place(self, keys: np.ndarray, multiplier: int) -> np.ndarray:
        return ((keys * np.uint64(multiplier)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Values of kept keys."""
        for multiplier in _MULTIPLIERS:
            at = self._place(keys, multiplier)
            mine = self.keys[at] == keys + np.uint64(1)
            self.values[at[mine]] = values[mine]

    def get(self, keys: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        out, left = otherwise, None
        for multiplier in _MULTIPLIERS:
            at = self._place(keys if left is None else keys[left], multiplier)
            found = self.keys.take(at) == (keys if left is None else keys[left]) + np.uint64(1)
            mine = np.flatnonzero(found)
            out[mine if left is None else left[mine]] = self.values.take(at[mine])
            left = np.flatnonzero(~found) if left is None else left[~found]
        return out


class _Room:
    """What a step of learning from n windows writes to, so that no step asks the system for memory."""

    def __init__(self, n: int, kind: np.dtype) -> None:
        made = lambda *shape: np.empty((n, *shape), kind)
        self.x, self.turned, self.dx = made(WINDOW, WIDTH), made(WIDTH, WINDOW), made(WINDOW, WIDTH)
        #: attention's weights above the gradients of its scores, and what each is multiplied by for the gradient of x
        self.weights, self.factors = made(2 * FRESH, WINDOW), made(2 * FRESH, WIDTH)
        self.mean, self.h, self.dh = made(FRESH, WIDTH), made(FRESH, WIDTH + 1), made(FRESH, WIDTH)
        self.h[..., WIDTH] = 1
        rows = min(n * FRESH, ROOM_ROWS)
        self.d, self.after = np.empty((rows, CLASSES), kind), np.empty((rows, CLASSES), np.float32)
        self.mask = np.tri(WINDOW, dtype=kind)[-FRESH:]
        self.spots = np.arange(INPUTS * WIDTH).reshape(INPUTS, WIDTH)
        self.places = np.empty((n, WINDOW, WIDTH), self.spots.dtype)


class AttentionModel:
    """``end``, the last of the ids, begins and ends every text.

    counts: occurrences per id; cls: the class of each (``classes_of``); follows: how often each class comes after each
    id; pairs: ids, the ids before them, and counts, of the pairs to be remembered, most frequent first; windows: what the network
    starts from (``windows_of``); ``passed`` and ``settle`` take it on to all others. Without windows the model is uniform over
    classes.
    """

    def __init__(
        self, counts: np.ndarray, cls: np.ndarray, follows: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray],
        windows: np.ndarray, steps: int = 1_200, batch: int = 128, seed: int = 7,
    ) -> None:
        rng = np.random.default_rng(seed)
        self.n_ids, self.end, self.cls = len(counts), len(counts) - 1, cls
        smooth = counts + SMOOTH
        share = smooth / np.bincount(cls, smooth, CLASSES)[cls]
        self.share = np.log(share).astype(np.float32)
        #: ids after which anything was seen have rows of their own in the tables by the id before; all others share row 0
        total = follows.sum(1)
        self.row = np.zeros(self.n_ids, np.int64)
        seen = np.flatnonzero(total)
        self.row[seen] = np.arange(len(seen)) + 1
        prior = np.bincount(cls, counts, CLASSES) + 0.5
        prior /= prior.sum()
        table = np.concatenate([np.zeros((1, CLASSES)), follows[seen]])
        self.after = np.log((table + 2 * prior) / (table.sum(1, keepdims=True) + 2)).astype(np.float32)
        self._remember(pairs, table, share)
        order = np.argsort(-counts, kind="stable")
        self.inputs = np.full(self.n_ids, INPUTS - 1, np.int64)
        self.inputs[order[: INPUTS - 1]] = np.arange(min(self.n_ids, INPUTS - 1))
        shapes = {"E": (INPUTS, WIDTH), "P": (WINDOW, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH)}
        self.w = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()}
        self.w["O"] = rng.normal(0, 0.1 * bool(len(windows)), (WIDTH, CLASSES)).astype(np.float32)
        self.w["b"] = np.zeros(CLASSES, np.float32)
        self._train(windows, steps, batch, rng)
        self._tables()

    def _remember(self, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], table: np.ndarray, share: np.ndarray) -> None:
        ids, before, n = pairs
        keys = before.astype(np.uint64) * np.uint64(self.n_ids) + ids.astype(np.uint64)
        self.pairs = Pairs(keys)
        ids, before, n, keys = (x[self.pairs.kept] for x in (ids, before, n, keys))
        cell = self.row[before] * CLASSES + self.cls[ids]
        mass = np.bincount(cell, n - DISCOUNT, table.size)
        rest = 1 - mass / np.maximum(table.ravel(), 1)
        with np.errstate(divide="ignore"):
            self.rest = np.log(rest).astype(np.float32)
        self.pairs.put(keys, np.log((n - DISCOUNT) / table.ravel()[cell] + rest[cell] * share[ids]).astype(np.float32))

    def within(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Log share of each id in its class after the id before it."""
        keys = before.astype(np.uint64) * np.uint64(self.n_ids) + ids.astype(np.uint64)
        return self.pairs.get(keys, self.rest[self.row[before] * CLASSES + self.cls[ids]] + self.share[ids])

    def loss(self, windows: np.ndarray, room: _Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log probability of the classes of the last FRESH ids of windows plus one, and its gradients;
        ids from n_ids on don't count. Queries and keys meet in one matrix, Q times K turned, and means are taken of x before V, so
        that nothing is made of a window's first places but x. Logits are divided by no sum and lie in ``room`` for a few windows
        at a time; what rows are scaled by goes to the narrow side of products."""
        n, w = len(windows), self.w
        room = room or _Room(n, w["E"].dtype)
        ids, real = np.minimum(windows, self.end), (windows[:, -FRESH:] < self.n_ids).ravel()
        weight, target = (real / real.sum()).astype(room.x.dtype), self.cls.take(ids[:, -FRESH:]).ravel()
        inputs, before = self.inputs.take(ids[:, :-1]), self.row.take(ids[:, -FRESH - 1 : -1]).ravel()
        flat = lambda m: m.reshape(-1, m.shape[-1])
        x, mean, h, dh, dx, scale = room.x, room.mean, room.h, room.dh, room.dx, w["Q"].dtype.type(WIDTH**-0.5)
        a, ds, dmean, query = room.weights[:, :FRESH], room.weights[:, FRESH:], room.factors[:, :FRESH], room.factors[:, FRESH:]
        np.take(w["E"], inputs, axis=0, out=x, mode="clip")
        x += w["P"]
        last, turned = np.ascontiguousarray(x[:, -FRESH:]), room.turned
        turned[:] = x.transpose(0, 2, 1)
        met = w["Q"] @ w["K"].T * scale
        query[:] = (flat(last) @ met).reshape(query.shape)
        np.matmul(query, turned, out=a)
        np.exp(np.clip(a, -30, 30, out=a), out=a)
        a *= room.mask
        a /= a @ np.ones((WINDOW, 1), x.dtype)
        np.matmul(a, x, out=mean)
        np.add((flat(mean) @ w["V"]).reshape(last.shape), last, out=h[..., :WIDTH])

        late, out, ones = flat(h), np.vstack([w["O"], w["b"]]), np.ones(CLASSES, h.dtype)
        tame = max(late.max(), -late.min()) * np.abs(out).sum(0).max() < 60
        masses, got, g_out = np.empty(len(late), h.dtype), np.empty(len(late), h.dtype), np.zeros_like(out)
        for at in range(0, len(late), len(room.d)):
            rows = slice(at, min(at + len(room.d), len(late)))
            m = rows.stop - at
            d = np.matmul(late[rows], out, out=room.d[:m])
            d += np.take(self.after, before[rows], axis=0, out=room.after[:m], mode="clip")
            if not tame:
                d -= d.max(-1, keepdims=True)
            np.exp(d, out=d)
            mass = np.matmul(d, ones, out=masses[rows])
            places = np.arange(0, m * CLASSES, CLASSES) + target[rows]
            got[rows] = found = d.ravel().take(places)
            d.ravel()[places] = found - mass  # what follows has all of the gradient, not only that of the sums
            each = (weight[rows] / mass)[:, None]
            by = np.matmul(d, w["O"].T, out=flat(dh)[rows])
            by *= each
            g_out += (late[rows] * each).T @ d
        value = float((weight * -np.log(got / masses + 1e-12)).sum())
        g_v = flat(mean).T @ flat(dh)
        dmean[:] = (flat(dh) @ w["V"].T).reshape(dmean.shape)
        np.matmul(dmean, turned, out=ds)
        ds -= (flat(dmean * mean) @ np.ones(WIDTH, x.dtype)).reshape(n, FRESH, 1)
        ds *= a
        dquery = flat(np.matmul(ds, x))
        np.matmul(room.weights.transpose(0, 2, 1), room.factors, out=dx)
        dh += (dquery @ met.T).reshape(dh.shape)
        g_met = flat(last).T @ dquery * scale
        dx[:, -FRESH:] += dh
        np.take(room.spots, inputs, axis=0, out=room.places, mode="clip")
        g_inputs = np.bincount(room.places.ravel(), dx.ravel(), w["E"].size).reshape(w["E"].shape)
        g = {"E": g_inputs.astype(dx.dtype), "P": (np.ones(n, dx.dtype) @ dx.reshape(n, -1)).reshape(w["P"].shape)}
        g |= {"Q": g_met @ w["K"], "K": g_met.T @ w["Q"], "V": g_v, "O": g_out[:WIDTH], "b": g_out[WIDTH]}
        return value, g

    def _train(self, windows: np.ndarray, steps: int, batch: int, rng: np.random.Generator, top: float = 0.01) -> None:
        """Adam on the windows in random order; all of them, and again where ``steps`` batches need more."""
        if not len(windows):
            return
        steps, order = max(steps, -(-len(windows) // batch)), np.zeros(0, np.int64)
        flat = np.concatenate([v.ravel() for v in self.w.values()])
        cuts = np.cumsum([v.size for v in self.w.values()])[:-1]
        self.w = {k: x.reshape(v.shape) for (k, v), x in zip(self.w.items(), np.split(flat, cuts))}  # views of flat
        m, s, g, root = (np.zeros_like(flat) for _ in range(4))
        room = _Room(batch, flat.dtype)
        for step in range(1, steps + 1):
            while len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(windows))])
            at, order = order[:batch], order[batch:]
            _, parts = self.loss(windows[at].astype(np.int64), room)
            np.concatenate([parts[k].ravel() for k in self.w], out=g)
            rate = top * min(1, step / 30) * (1 - 0.9 * step / steps)
            m *= 0.9
            m += np.multiply(g, 0.1, out=root)
            g *= g
            g *= 0.01
            s *= 0.99
            s += g
            np.sqrt(np.multiply(s, 1 / (1 - 0.99**step), out=root), out=root)
            root += 1e-8
            np.divide(m, root, out=root)
            root *= rate / (1 - 0.9**step)
            flat -= root

    def passed(self, windows: np.ndarray, batch: int = 256, top: float = PASS_RATE) -> np.ndarray:
        """All weights in a row after a pass over the windows, each of which is learned from once; the model stays as it is."""
        before = self.w
        self.w = {k: v.copy() for k, v in before.items()}
        self._train(windows, 0, min(batch, max(1, len(windows))), np.random.default_rng(len(windows)), top)
        after, self.w = self.w, before
        return np.concatenate([x.ravel() for x in after.values()])

    def settle(self, weights: np.ndarray) -> None:
        """Takes weights in a row as its own."""
        parts = np.split(weights.astype(np.float32), np.cumsum([x.size for x in self.w.values()])[:-1])
        self.w = {k: x.reshape(v.shape) for (k, v), x in zip(self.w.items(), parts)}
        self._tables()

    def _tables(self) -> None:
        """Queries (by Q and K turned) and embeddings, by id and by place, and the product that makes logits of means and embeddings."""
        w = self.w
        met = w["Q"] @ w["K"].T / np.float32(WIDTH**0.5)
        self.queries, self.query_places = w["E"] @ met, w["P"] @ met
        self.out = np.vstack([w["V"] @ w["O"], w["O"]])
        self.logits = self.after + w["b"]
        longest = lambda table, places: np.sqrt(((np.abs(table).max(0) + np.abs(places).max(0)) ** 2).sum())
        q, x, v = longest(self.queries, self.query_places), longest(w["E"], w["P"]), longest(w["E"] @ w["V"], w["P"] @ w["V"])
        #: no exponential of scores or logits can leave the range of single precision, so none needs to be clipped
        self.tame = q * x < 60 and (x + v) * np.sqrt((w["O"] ** 2).sum(0)).max() < 60

    def log10(self, flat: np.ndarray, sizes: np.ndarray, batch: int = 256) -> np.ndarray:
        """log10 probability of each text's ids and its end, of texts one after the other. What a batch needs is written to the
        same arrays as that of the one before."""
        if not len(sizes):
            return np.zeros(0)
        stream, first = framed(flat, sizes, self.end)
        ids, target = np.minimum(stream[:-1], self.end).reshape(-1, FRESH), stream[1:].reshape(-1, FRESH)
        real = target < self.n_ids
        real[first] = False
        sums, mask, ones = np.zeros(len(ids)), np.tri(WINDOW, dtype=np.float32)[-FRESH:], np.ones((CLASSES, 1), np.float32)
        coded, before_rows = self.inputs[ids], self.row[ids]
        batch = min(batch, len(ids))
        made = lambda *shape: np.empty((batch, *shape), np.float32)
        found, room = np.empty((batch + 1, FRESH, WIDTH), np.float32), (made(WINDOW, WIDTH), made(FRESH, WIDTH), made(FRESH, WINDOW))
        room += made(FRESH, 2 * WIDTH), made(FRESH, CLASSES), made(FRESH, CLASSES), made(FRESH, 1)
        cells = np.arange(0, batch * FRESH * CLASSES, CLASSES)
        into = lambda table, at, out: np.take(table, at, axis=0, out=out, mode="clip")  # noqa: E731  all are in range
        for a in range(1, len(ids), batch):
            rows = slice(a, min(a + batch, len(ids)))
            n = rows.stop - a
            x, query, s, h, z, after, mass = (m[:n] for m in room)
            y = np.minimum(target[rows], self.end).ravel()
            into(self.w["E"], coded[a - 1 : rows.stop], found[: n + 1])
            np.add(found[:n], self.w["P"][:FRESH], out=x[:, :FRESH])
            np.add(found[1 : n + 1], self.w["P"][FRESH:], out=x[:, FRESH:])
            into(self.queries, coded[rows], query)
            query += self.query_places[-FRESH:]
            np.matmul(query, x.transpose(0, 2, 1), out=s)
            if not self.tame:
                np.clip(s, -60, 60, out=s)
            np.exp(s, out=s)
            s *= mask
            s /= s @ ones[:WINDOW]
            np.matmul(s, x, out=h[..., :WIDTH])
            h[..., WIDTH:] = x[:, FRESH:]
            np.matmul(h, self.out, out=z)
            z += into(self.logits, before_rows[rows], after)
            if not self.tame:
                np.clip(z, -60, 60, out=z)
            got = z.ravel().take(cells[: len(y)] + self.cls.take(y))
            np.matmul(np.exp(z, out=z), ones, out=mass)
            got -= np.log(mass, out=mass).ravel()
            sums[rows] = np.where(real[rows], got.reshape(-1, FRESH), 0).sum(-1, dtype=float)
        for a in range(0, len(ids), 8 * batch):
            rows = slice(a, a + 8 * batch)
            at = np.flatnonzero(real[rows])
            within = np.zeros(real[rows].shape, np.float32)
            within.ravel()[at] = self.within(target[rows].ravel().take(at), ids[rows].ravel().take(at))
            sums[rows] += within.sum(-1, dtype=float)
        return np.add.reduceat(sums, first) / np.log(10)
