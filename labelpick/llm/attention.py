"""A small causal self-attention language model in numpy.

A piece's embedding attends over the pieces before it in its window; the sum of both gives, on top of the log
probabilities of the pair counts, the logits of the next piece. The next piece is predicted in two steps, its class and
then itself within the class, so that a prediction costs two short softmaxes instead of one over all pieces.

Windows overlap: each has CONTEXT pieces that are only looked at and as many that are scored, so every piece is scored
once and sees at least CONTEXT pieces before it, unless the text starts there.
"""

from __future__ import annotations

import numpy as np

PIECES = 2048           # piece ids, the last one is the end of a text (and what stands before its start)
END = PIECES - 1
PAD = PIECES            # outside of a text
CLASS = 32              # pieces per class
CLASSES = PIECES // CLASS
CONTEXT = 16
DIM = 16
SHAPES = {"E": (PIECES + 1, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "r": (2 * CONTEXT,),
          "c": (DIM, CLASSES), "u": (PIECES, DIM)}
_AT = np.arange(CONTEXT, 2 * CONTEXT)[:, None] - np.arange(2 * CONTEXT)  # how far back each key is
_LATER = _AT < 0


def fresh(seed: int = 0) -> np.ndarray:
    """Starting weights: with these the model is that of the pair counts."""
    rng = np.random.default_rng(seed)
    start = {name: rng.normal(0, 0.3, shape) for name, shape in SHAPES.items()}
    start["r"], start["c"], start["u"] = -0.5 * np.arange(2 * CONTEXT), np.zeros((DIM, CLASSES)), np.zeros((PIECES, DIM))
    return np.concatenate([start[name].ravel() for name in SHAPES]).astype(np.float32)


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape)
        at += size
    return out


def pair_logs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the class after a piece, and of a piece within its class after a piece, from pair counts.

    Pair counts are smoothed towards single counts, these towards the uniform distribution, so nothing is impossible.
    """
    single = counts.sum(0) + 0.5
    single /= single.sum()
    pair = (counts + 5 * single) / (counts.sum(1, keepdims=True) + 5)
    of_class = pair.reshape(PIECES, CLASSES, CLASS).sum(2)
    within = pair.reshape(PIECES, CLASSES, CLASS) / of_class[:, :, None]
    # the second table by class: (class, piece before, place in the class)
    return np.log(of_class).astype(np.float32), np.log(within.transpose(1, 0, 2), order="C").astype(np.float32)


def windows(pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (n, 2 * CONTEXT) and targets (n, CONTEXT) of texts of the given sizes (each with its end) laid end to end.

    PAD fills up windows; each target is in one window.
    """
    blocks = -(-sizes // CONTEXT)
    rows = blocks + 1  # one of padding before each text
    first = (np.cumsum(rows) - rows) * CONTEXT
    ends = np.cumsum(sizes)
    within = np.arange(len(pieces)) - np.repeat(ends - sizes, sizes)
    place = np.repeat(first + CONTEXT, sizes) + within
    total = int(rows.sum()) * CONTEXT
    target, seen = np.full(total, PAD, np.int32), np.full(total + 1, PAD, np.int32)
    target[place] = pieces
    seen[place + 1] = pieces
    seen[first + CONTEXT] = END
    # what follows a text's end in the next row of padding is no input
    last = place[ends[sizes > 0] - 1] + 1
    seen[last[last < total]] = np.where(target[last[last < total]] == PAD, PAD, seen[last[last < total]])
    seen, target = seen[:total].reshape(-1, CONTEXT), target.reshape(-1, CONTEXT)
    own = np.ones(len(target), bool)
    own[first // CONTEXT] = False
    at = np.flatnonzero(own)
    return np.concatenate([seen[at - 1], seen[at]], 1), target[at]


def some_windows(pieces: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
                 number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single windows, as ``windows`` gives them: each by where its text starts, the text's size, and its number in it."""
    at = number[:, None] * CONTEXT + np.arange(-CONTEXT, CONTEXT)
    inside = (at >= 0) & (at < sizes[:, None])
    x = np.where(inside, np.where(at == 0, END, pieces[np.where(inside & (at > 0), starts[:, None] + at - 1, 0)]), PAD)
    at = at[:, CONTEXT:]
    inside = inside[:, CONTEXT:]
    return x, np.where(inside, pieces[np.where(inside, starts[:, None] + at, 0)], PAD)


def pair_codes(pieces: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """piece before * PIECES + piece, for all pieces of texts laid end to end; END stands before a text."""
    before = np.empty(len(pieces), np.int64)
    before[1:] = pieces[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = END
    return before * PIECES + pieces


def _bias(w) -> np.ndarray:
    """What is added to the scores of (place, key): by how far back the key is; nothing later is seen."""
    return np.where(_LATER, np.float32(-1e9), w["r"][np.maximum(_AT, 0)]).astype(w["r"].dtype)


def tables(w: dict) -> dict:
    """``w`` with the query of every piece, as it does not depend on where the piece stands.

    A query is taken through the (scaled) query and key weights at once, so that it meets plain embeddings. Values are
    mixed as embeddings too, and go through the value weights when they are summed up.
    """
    m = (w["q"] * w["q"].dtype.type(DIM ** -0.5)) @ w["k"].T
    longest = lambda t: np.sqrt(np.einsum("ij,ij->i", t, t).max())
    query = w["E"] @ m
    reach = longest(query) * longest(w["E"]) + np.abs(w["r"]).max()
    size = max(longest(w["c"].T), longest(w["u"]))
    return w | {"m": m, "query": query, "bias": _bias(w), "reach": reach, "size": size}


RUN = 64  # windows, and
ROWS = 1024  # targets that go through the layers together, few enough to stay in a core's cache


def _take(table: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.take(table, rows, 0, out[:len(rows)], "clip")  # all rows exist; "clip" writes to ``out`` directly


class _Room:
    """Arrays that are used again and again, as fetching new memory costs more than the arithmetic.

    ``learns``: with those for the gradient of a batch of that many windows.
    """

    def __init__(self, dtype=np.float32, learns: int = 0):
        near = lambda n, *shape: np.empty((n, *shape), dtype)
        self.q, self.e, self.a = near(RUN, CONTEXT, DIM), near(RUN, 2 * CONTEXT, DIM), near(RUN, CONTEXT, 2 * CONTEXT)
        self.h, self.mix, self.o = near(RUN, CONTEXT, DIM), near(RUN, CONTEXT, DIM), near(RUN, CONTEXT, DIM)
        self.z, self.more = near(ROWS, CLASSES), near(ROWS, CLASSES)
        self.inner, self.add = self.z.reshape(-1, CLASS)[:ROWS], self.more.reshape(-1, CLASS)[:ROWS]
        if learns:
            self.part, self.own = near(ROWS, DIM), near(RUN, CONTEXT, DIM)
            self.both, self.meet = near(RUN, 2 * CONTEXT, 2 * CONTEXT), near(RUN, 2 * CONTEXT, DIM)
            self.all_h, self.all_mix, self.all_o, self.back = (near(learns, CONTEXT, DIM) for _ in range(4))
            self.all_a, self.de = near(learns, CONTEXT, 2 * CONTEXT), near(learns, 2 * CONTEXT, DIM)
            self.sorted = near(2 * CONTEXT * learns, DIM)
            self.rows, self.dh = near(CONTEXT * learns, DIM), near(CONTEXT * learns, DIM)


def _hidden(w, x, room, a=None, mix=None, o=None, h=None) -> np.ndarray:
    """Own embeddings on top of what attention sums up.

    Written to ``h``, as attention is to ``a``, the embeddings that it mixes to ``mix``, and their values to ``o``.
    """
    n, learns = len(x), a is not None
    a, mix, o, h = (a, mix, o, h) if learns else (t[:n] for t in (room.a, room.mix, room.o, room.h))
    q, e = _take(w["query"], x[:, CONTEXT:], room.q), _take(w["E"], x, room.e)
    np.matmul(q, e.transpose(0, 2, 1), out=a)
    a += w["bias"]
    pad = x == PAD
    some = np.flatnonzero(pad.any(1))
    if len(some):
        a[some] += np.where(pad[some], np.float32(-1e9), np.float32(0))[:, None]  # PAD keys are invisible
    if not w["reach"] < 60:  # exponentials could overflow without taking out the largest
        a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    total = (a.reshape(-1, 2 * CONTEXT) @ np.ones(2 * CONTEXT, a.dtype)).reshape(n, CONTEXT, 1)
    if learns:
        a /= total
    np.matmul(a, e, out=mix)
    if not learns:
        mix /= total
    np.matmul(mix.reshape(-1, DIM), w["v"], out=o.reshape(-1, DIM))
    return np.add(e[:, CONTEXT:], o, out=h)


def _in_range(w, h: np.ndarray) -> bool:
    """Whether exponentials of the logits stay in range as they are.

    Pair logs are at most 0 and sum to one, so small products with the weights are enough.
    """
    return bool(np.sqrt(np.einsum("ij,ij->i", h, h).max()) * w["size"] < 40)


def _exponentials(z: np.ndarray, safe: bool) -> np.ndarray:
    """In place; the sums of the rows are returned. ``safe``: none can overflow, and not all of a row vanish."""
    if not safe:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the targets, sorted by their class, and where each class begins; those without a target are left out."""
    of = (y.ravel() // CLASS).astype(np.uint8)  # PAD comes last
    edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=CLASSES + 1)[:CLASSES])])
    return np.argsort(of, kind="stable")[:edges[-1]], edges


def log_probabilities(w: dict, logs, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the targets, (n, CONTEXT); 0 where there is none."""
    w = w if "query" in w else tables(w)
    out = np.zeros(y.size, np.float64)
    order, edges = _by_class(y)
    if not len(order):
        return out.reshape(y.shape)
    room, hidden = _Room(w["E"].dtype), np.empty((*y.shape, DIM), w["E"].dtype)
    for a in range(0, len(x), RUN):
        hidden[a:a + RUN] = _hidden(w, x[a:a + RUN].astype(np.intp), room)
    h, y, prev = hidden.reshape(-1, DIM).take(order, 0), y.ravel()[order], x[:, CONTEXT:].ravel()[order].astype(np.intp)
    safe, found, sums = _in_range(w, h), np.empty(len(y), w["E"].dtype), np.empty(len(y), w["E"].dtype)
    for a in range(0, len(y), ROWS):
        i = slice(a, a + ROWS)
        z = _take(logs[0], prev[i], room.z)
        z += np.matmul(h[i], w["c"], out=room.more[:len(z)])
        at = np.arange(len(z)) * CLASSES + y[i] // CLASS
        found[i] = z.ravel().take(at)
        top = 0 if safe else z.max(1)
        sums[i] = np.log(_exponentials(z, safe)) + top
    found -= sums
    place, z_room, add_room = y % CLASS, room.z.reshape(-1, CLASS), room.more.reshape(-1, CLASS)
    inner = np.empty_like(found)
    for g in range(CLASSES):
        u = w["u"][g * CLASS:(g + 1) * CLASS].T
        for a in range(edges[g], edges[g + 1], len(z_room)):
            i = slice(a, min(a + len(z_room), edges[g + 1]))
            z = _take(logs[1][g], prev[i], z_room)
            z += np.matmul(h[i], u, out=add_room[:len(z)])
            inner[i] = z.ravel().take(np.arange(0, z.size, CLASS) + place[i])
            top = 0 if safe else z.max(1)
            sums[i] = np.log(_exponentials(z, safe)) + top
    out[order] = found.astype(np.float64) + (inner - sums)
    return out.reshape(-1, CONTEXT)


def _targets(z: np.ndarray, at: np.ndarray, n: int, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logits become, up to a factor per row, their gradient for the targets ``at``.

    Probabilities of the targets, and the factors (over n).
    """
    sums, flat = _exponentials(z, safe), z.reshape(-1)
    hit = flat.take(at)
    flat[at] = hit - sums
    hit /= sums
    sums *= n
    return hit, np.divide(1, sums, out=sums)[:, None]


def _add_up(rows: np.ndarray, ids: np.ndarray, room) -> np.ndarray:
    """Sums of the rows of each piece, (PIECES + 1, columns)."""
    out, ids = np.zeros((PIECES + 1, rows.shape[-1]), rows.dtype), ids.ravel().astype(np.int16)
    order = np.argsort(ids, kind="stable")
    n = np.bincount(ids, minlength=len(out))
    found = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[found]
    # a pair of numbers is added at once if taken for a complex one
    pairs = np.result_type(rows.dtype, np.complex64)
    rows = _take(rows.reshape(len(ids), -1), order, room.sorted).view(pairs)
    out[found] = np.add.reduceat(rows, first).view(out.dtype)
    return out


def gradient(w: dict, logs, x: np.ndarray, y: np.ndarray, room: _Room | None = None) -> tuple[float, np.ndarray]:
    """Mean loss of the targets and its gradient."""
    flat = np.zeros(sum(int(np.prod(s)) for s in SHAPES.values()), np.float32)
    d, dtype = views(flat), w["E"].dtype
    order, edges = _by_class(y)
    n = len(order)
    if not n:
        return 0.0, flat
    room = room or _Room(dtype, learns=len(x))
    logs = [t.astype(dtype, copy=False) for t in logs]
    w, x, windows, chance = tables(w), x.astype(np.intp, copy=False), len(x), np.empty(n, dtype)
    runs = [slice(i, min(i + RUN, windows)) for i in range(0, windows, RUN)]
    for i in runs:
        _hidden(w, x[i], room, room.all_a[i], room.all_mix[i], room.all_o[i], room.all_h[i])
    own = x[:, CONTEXT:]
    h, prev, y = _take(room.all_h.reshape(-1, DIM), order, room.rows), own.ravel()[order], y.ravel()[order]
    of, place, safe, dh = y // CLASS, y % CLASS, _in_range(w, h), room.dh[:n]
    dc, back_c = np.zeros((CLASSES, DIM), dtype), np.ascontiguousarray(w["c"].T)
    for start in range(0, n, ROWS):
        i = slice(start, min(start + ROWS, n))
        z = np.matmul(h[i], w["c"], out=room.z[:len(of[i])])
        z += _take(logs[0], prev[i], room.more)
        chance[i], factor = _targets(z, np.arange(0, z.size, CLASSES) + of[i], n, safe)
        np.matmul(z, back_c, out=dh[i])
        dh[i] *= factor
        dc += z.T @ np.multiply(h[i], factor, out=room.part[:len(z)])
    d["c"][:] = dc.T
    entry, table = of * PIECES + prev, logs[1].reshape(-1, CLASS)
    for start in range(0, n, ROWS):
        i = slice(start, min(start + ROWS, n))
        z, part = room.inner[:len(of[i])], room.part[:len(of[i])]
        some = [(max(edges[g] - start, 0), min(edges[g + 1] - start, len(z)), slice(g * CLASS, (g + 1) * CLASS))
                for g in range(of[start], of[i.stop - 1] + 1)]
        for a, b, g in some:
            np.matmul(h[start + a:start + b], w["u"][g].T, out=z[a:b])
        z += _take(table, entry[i], room.add)
        more, factor = _targets(z, np.arange(0, z.size, CLASS) + place[i], n, safe)
        chance[i] *= more
        h[i] *= factor
        for a, b, g in some:
            np.matmul(z[a:b], w["u"][g], out=part[a:b])
            d["u"][g] += z[a:b].T @ h[start + a:start + b]
        part *= factor
        dh[i] += part
    back, de, flatten = room.back[:windows], room.de[:windows], lambda t: t.reshape(-1, DIM)
    back[:] = 0
    flatten(back)[order] = dh
    scores, dm = np.zeros((CONTEXT, 2 * CONTEXT), dtype), np.zeros((DIM, DIM), dtype)
    for i in runs:
        e, q = _take(w["E"], x[i], room.e), _take(w["query"], own[i], room.q)
        # gradients of scores, and attention; what each of them brings the keys from queries and from what comes back
        both, meet = room.both[:len(q)], room.meet[:len(q)]
        ds, meet[:, :CONTEXT], both[:, CONTEXT:] = both[:, :CONTEXT], q, room.all_a[i]
        np.matmul(back[i], w["v"].T, out=meet[:, CONTEXT:])
        np.matmul(meet[:, CONTEXT:], e.transpose(0, 2, 1), out=ds)
        ds -= np.einsum("ijk,ijk->ij", back[i], room.all_o[i])[..., None]
        ds *= both[:, CONTEXT:]
        scores += ds.sum(0)
        dq = flatten(np.matmul(ds, e, out=room.own[:len(q)]))
        np.matmul(both.transpose(0, 2, 1), meet, out=de[i])
        de[i, CONTEXT:] += back[i]
        de[i, CONTEXT:] += (dq @ w["m"].T).reshape(q.shape)
        dm += flatten(e[:, CONTEXT:]).T @ dq
    d["r"][:] = np.bincount(np.maximum(_AT, 0).ravel(), scores.ravel(), 2 * CONTEXT)
    dm *= dtype.type(DIM ** -0.5)
    d["q"][:], d["k"][:] = dm @ w["k"], dm.T @ w["q"]
    d["v"][:] = flatten(room.all_mix[:windows]).T @ flatten(back)
    d["E"][:] = _add_up(de, x, room)
    d["E"][PAD] = 0
    return -np.log(np.maximum(chance, 1e-30)).sum() / n, flat


STEPS, LEAST_BATCH, MOST_BATCH = 32, 16, 1024


def descend(flat: np.ndarray, logs, x: np.ndarray, y: np.ndarray, rate: float, seed: int = 0) -> np.ndarray:
    """Adam over the windows once, in a seeded order, in about STEPS steps (more if a batch would pass MOST_BATCH)."""
    flat = flat.astype(np.float32).copy()
    m, s, change = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    order = np.random.default_rng(seed).permutation(len(x))
    batch = min(max(len(x) // STEPS, LEAST_BATCH), MOST_BATCH)
    room, x = _Room(learns=min(batch, len(x))), x.astype(np.intp, copy=False)
    for step, start in enumerate(range(0, len(order), batch), 1):
        some = order[start:start + batch]
        _, g = gradient(views(flat), logs, x[some], y[some], room)
        m += np.multiply(np.subtract(g, m, out=change), 0.1, out=change)
        g *= g
        s += np.multiply(np.subtract(g, s, out=g), 0.02, out=g)
        np.sqrt(np.divide(s, 1 - 0.98 ** step, out=g), out=g)
        g += 1e-8
        np.multiply(np.divide(m, 1 - 0.9 ** step, out=change), rate, out=change)
        flat -= np.divide(change, g, out=change)
    return flat
