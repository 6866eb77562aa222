"""A small gated recurrent network with a class-factored softmax, in numpy."""

from __future__ import annotations

import math

import numpy as np

from watchkeep.llm.labelled import Adam

INPUT, HIDDEN = 16, 24
WINDOW, LANES = 64, 128
SCORE_ROWS = 32_768  # tokens scored at once
NEAR_ROWS = 1_008  # rows whose arrays stay in a core's own cache


class Shape:
    """``heads`` frequent words in classes of ``size``, then ``tails`` classes of other words.

    Token numbers below ``heads`` are words by rank; heads + g is any word of tail class g.
    """

    def __init__(self, heads: int, tails: int, size: int = 64):
        self.heads, self.tails, self.size = heads, tails, size
        self.head_classes = -(-heads // size)
        self.classes = self.head_classes + tails
        self.padded = self.head_classes * size

    def target_class(self, token: np.ndarray) -> np.ndarray:
        return np.where(token < self.heads, token // self.size, self.head_classes + token - self.heads)


def start(shape: Shape, head_counts: np.ndarray, tail_counts: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters whose predictions are the counts' shares; the other weights are seeded."""
    rng = np.random.default_rng(11)
    draw = lambda a, b, s: rng.normal(0, s, (a, b)).astype(np.float32)
    padded = np.zeros(shape.padded)
    padded[: shape.heads] = head_counts
    per_class = np.concatenate([padded.reshape(-1, shape.size).sum(axis=1), tail_counts]) + 0.5
    within = np.where(np.arange(shape.padded) < shape.heads, np.log(padded + 0.5), -30.0)
    within = within.reshape(-1, shape.size)
    within -= np.log(np.exp(within).sum(axis=1, keepdims=True))
    return {
        "E": draw(shape.heads + shape.tails, INPUT, 0.3), "X": draw(INPUT, 3 * HIDDEN, 0.25),
        "bx": np.zeros(3 * HIDDEN, np.float32), "R": draw(HIDDEN, 3 * HIDDEN, 0.2),
        "C": draw(HIDDEN, shape.classes, 0.05), "bc": np.log(per_class / per_class.sum()).astype(np.float32),
        "W": draw(shape.padded, HIDDEN, 0.05), "bw": within.reshape(-1).astype(np.float32),
    }


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in p.values()])


def restore(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at: at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


class Room:
    """Arrays by name that are used again: new ones of this size go back to the system each time, a page fault every 4 KB."""

    def __init__(self, kind: np.dtype):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, self.kind)
        return self.held[name][:size].reshape(shape)


def _squash(x: np.ndarray, scale: float = 1.0) -> None:
    """The logistic function of ``scale`` times x, in place; exp takes half the time of tanh and may overflow."""
    np.multiply(x, -scale, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _squash_signed(x: np.ndarray) -> None:
    """tanh in place."""
    _squash(x, 2.0)
    x *= 2
    x -= 1


def _step(a: np.ndarray, x: np.ndarray, gates: np.ndarray, n: np.ndarray) -> None:
    """Gates and candidate of a step, in place; ``a`` is the state's part, ``x`` the input's."""
    np.add(x[:, : 2 * HIDDEN], a[:, : 2 * HIDDEN], out=gates)
    _squash(gates)
    np.multiply(gates[:, HIDDEN:], a[:, 2 * HIDDEN:], out=n)
    n += x[:, 2 * HIDDEN:]
    _squash_signed(n)


def _advance(h: np.ndarray, gates: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """The next state; ``out`` may be ``h``."""
    np.subtract(h, n, out=out)
    out *= gates[:, :HIDDEN]
    out += n


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums along the second axis, by a product with ones."""
    return x @ np.ones((x.shape[1], 1), x.dtype)


def _near(count: int) -> list[slice]:
    return [slice(at, min(at + NEAR_ROWS, count)) for at in range(0, count, NEAR_ROWS)]


def _rows(table: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.take(table, at, axis=0, out=out, mode="clip")


class _Heads:
    """The head words among ``token``, class by class: ``rows``, their states ``own``, their ``logit``, and the exponentials ``e`` in their class with ``sums``."""

    def __init__(self, p: dict[str, np.ndarray], shape: Shape, token: np.ndarray, s: np.ndarray, room: Room):
        rows = np.flatnonzero(token < shape.heads)
        number = token[rows] // shape.size
        order = np.argsort(number.astype(np.int16 if shape.head_classes < 1 << 15 else np.int64), kind="stable")
        self.rows, number = rows[order], number[order]
        self.target = np.arange(len(rows)), token[self.rows] - number * shape.size
        cut = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)] if len(number) else []
        # (class's words, its rows)
        self.classes = [(slice(number[a] * shape.size, (number[a] + 1) * shape.size), slice(a, b)) for a, b in zip(cut, cut[1:], strict=False)]
        self.own = _rows(s, self.rows, room("own", len(rows), s.shape[1]))
        self.e = room("inner", len(rows), shape.size)
        for block, at in self.classes:
            np.matmul(self.own[at], p["W"][block].T, out=self.e[at])
            self.e[at] += p["bw"][block]
        self.logit = self.e[self.target]
        np.exp(self.e, out=self.e)
        self.sums, ones = room("sums", len(rows), 1), np.ones((shape.size, 1), room.kind)
        for _, at in self.classes:
            np.matmul(self.e[at], ones, out=self.sums[at])


def log_likelihood(p: dict[str, np.ndarray], shape: Shape, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log probability of each sequence tokens[first[i]:first[i + 1]], from an empty state.

    All sequences advance together; the state of each is carried from window
    to window to its end.  A window has as many steps as make it worth while,
    so a few long sequences take few windows.  Tail tokens count with their class alone.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    out = np.zeros(len(order))
    table = p["E"] @ p["X"] + p["bx"]
    room = Room(p["R"].dtype)
    h = np.zeros((int((length > 0).sum()), HIDDEN), room.kind)
    ends, active, blocks = length.tolist(), len(h), []
    t, longest = 0, ends[0] if ends else 0
    while t < longest:
        targets = []
        held, most = 0, SCORE_ROWS + len(h)
        s, who = room("states", most, HIDDEN), np.empty(most, np.int64)
        with np.errstate(over="ignore"):
            while t < longest and held < SCORE_ROWS:
                while ends[active - 1] <= t:
                    active -= 1
                if active < len(h) or not blocks:
                    h = h[:active]
                    blocks = [(near, h[near], *(room(k, near.stop - near.start, w * HIDDEN) for k, w in (("a", 3), ("x", 3), ("gates", 2), ("n", 1))))
                              for near in _near(active)]
                token = tokens[begin[:active] + t]
                s[held: held + active] = h
                who[held: held + active] = np.arange(active)
                targets.append(token)
                for near, some, a, x, gates, n in blocks:
                    _step(np.matmul(some, p["R"], out=a), _rows(table, token[near], x), gates, n)
                    _advance(some, gates, n, some)
                held, t = held + active, t + 1
        s, token, who = s[:held], np.concatenate(targets), who[:held]
        score = np.empty(held, room.kind)
        for near in _near(held):
            logits = np.matmul(s[near], p["C"], out=room("classes", len(s[near]), shape.classes))
            logits += p["bc"]
            own = logits[np.arange(len(logits)), shape.target_class(token[near])]
            np.subtract(own, np.log(_row_sums(np.exp(logits, out=logits))[:, 0]), out=score[near])
        heads = _Heads(p, shape, token, s, room)
        score[heads.rows] += heads.logit - np.log(heads.sums[:, 0])
        out += np.bincount(who, score, minlength=len(out))
    result = np.empty(len(out))
    result[order] = out
    return result


class Trainer:
    """Truncated backpropagation over a stream of sequences, in LANES lanes."""

    def __init__(self, p: dict[str, np.ndarray], shape: Shape, rate: float):
        self.p = {k: v.copy() for k, v in p.items()}
        self.shape, self.adam, self.seen = shape, Adam(self.p, rate), 0
        self.room = Room(self.p["R"].dtype)

    def train(self, tokens: np.ndarray, fresh: np.ndarray) -> None:
        """``fresh`` marks the first token of each sequence, where the state is emptied."""
        lanes = max(1, min(LANES, len(tokens) // WINDOW))
        long = -(-len(tokens) // lanes)
        spare = lanes * long - len(tokens)  # places after the last token, which count nothing
        deal = lambda a, fill: np.append(a, np.full(spare, fill, a.dtype)).reshape(lanes, long)
        grid, new = deal(tokens, 0), deal(fresh, True)
        live = deal(np.ones(len(tokens), bool), False) if spare else None
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, long, WINDOW):
            part = slice(t, t + WINDOW)
            h = self._window(grid[:, part], new[:, part], h, live[:, part] if spare else None)
        self.seen += len(tokens)

    def _window(self, token: np.ndarray, new: np.ndarray, h: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """One update; arrays are by step, then lane.  Tokens that are not ``live`` have no part in it."""
        p, shape, room = self.p, self.shape, self.room
        lanes, steps = token.shape
        flat = token.T.reshape(-1)
        by_step = lambda name, width: room(name, steps, lanes, width)
        embedded = _rows(p["E"], flat, room("embedded", len(flat), INPUT))
        x = np.matmul(embedded, p["X"], out=room("x", len(flat), 3 * HIDDEN))
        x += p["bx"]
        x = x.reshape(steps, lanes, 3 * HIDDEN)
        kept = (~new.T).astype(np.float32)[:, :, None]
        states, gates, parts, n = by_step("states", HIDDEN), by_step("gates", 2 * HIDDEN), by_step("parts", 3 * HIDDEN), by_step("n", HIDDEN)
        after = room("after", lanes, HIDDEN)
        with np.errstate(over="ignore"):
            for t in range(steps):
                h = np.multiply(h, kept[t], out=states[t])
                _step(np.matmul(h, p["R"], out=parts[t]), x[t], gates[t], n[t])
                _advance(h, gates[t], n[t], after)
                h = after
        s = states.reshape(-1, HIDDEN)
        scale = np.full((len(flat), 1), 1 / len(flat), np.float32)
        if live is not None:
            scale[:, 0] = live.T.reshape(-1) / np.float32(live.sum())
        g = {k: room("g" + k, *p[k].shape) for k in ("W", "bw", "E")}
        for v in g.values():
            v.fill(0)
        every, ds = room("classes", len(flat), shape.classes), room("ds", len(flat), HIDDEN)
        target = shape.target_class(flat)
        for near in _near(len(flat)):
            d = np.matmul(s[near], p["C"], out=every[near])
            d += p["bc"]
            np.exp(d, out=d)
            d /= _row_sums(d)
            d[np.arange(len(d)), target[near]] -= 1
            d *= scale[near]
            np.matmul(d, p["C"].T, out=ds[near])
        g["C"], g["bc"] = s.T @ every, every.sum(axis=0)
        heads = _Heads(p, shape, flat, s, room)
        e = heads.e
        e /= heads.sums
        e[heads.target] -= 1
        e *= scale[heads.rows]
        passed = room("passed", len(e), HIDDEN)
        for block, at in heads.classes:
            np.matmul(e[at].T, heads.own[at], out=g["W"][block])
            np.sum(e[at], axis=0, out=g["bw"][block])
            np.matmul(e[at], p["W"][block], out=passed[at])
        ds[heads.rows] += passed
        ds = ds.reshape(steps, lanes, HIDDEN)
        # What a step passes back is linear in its own gradient; the factors are made for all steps at once.
        z, r, q = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:], parts[:, :, 2 * HIDDEN:]
        new_state, one = by_step("new_state", HIDDEN), by_step("one", HIDDEN)
        np.multiply(n, n, out=one)
        np.subtract(1, one, out=one)
        np.multiply(np.subtract(1, z, out=new_state), one, out=new_state)
        factor = room("factor", steps, lanes, 3, HIDDEN)
        for_z, for_r, for_q = factor[:, :, 0], factor[:, :, 1], factor[:, :, 2]
        np.subtract(states, n, out=for_z)
        for_z *= z
        for_z *= np.subtract(1, z, out=one)
        np.multiply(new_state, q, out=for_r)
        for_r *= r
        for_r *= np.subtract(1, r, out=one)
        np.multiply(new_state, r, out=for_q)
        back, dx = np.ascontiguousarray(p["R"].T), by_step("dx", 3 * HIDDEN)
        dh, at, held = by_step("dh", HIDDEN), room("at", lanes, HIDDEN), room("held", lanes, HIDDEN)
        at.fill(0)
        for t in reversed(range(steps)):
            dh[t] = at
            np.multiply(at[:, None, :], factor[t], out=dx[t].reshape(lanes, 3, HIDDEN))
            np.multiply(at, z[t], out=held)
            np.matmul(dx[t], back, out=at)
            at += held
            at += ds[t]
            at *= kept[t]
        g["R"] = s.T @ dx.reshape(-1, 3 * HIDDEN)
        np.multiply(dh, new_state, out=dx[:, :, 2 * HIDDEN:])
        dx = dx.reshape(-1, 3 * HIDDEN)
        g["X"], g["bx"] = embedded.T @ dx, dx.sum(axis=0)
        de = np.matmul(dx, p["X"].T, out=room("de", len(flat), INPUT))
        order = np.argsort(flat.astype(np.int16 if len(p["E"]) < 1 << 15 else np.int64), kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(ordered) > 0]))
        g["E"][ordered[first]] = np.add.reduceat(_rows(de, order, room("ordered", len(flat), INPUT)), first, axis=0)
        norm = np.sqrt(sum(float(np.multiply(v, v, out=room("square", *v.shape)).sum()) for v in g.values()))
        if norm > 1:
            for v in g.values():
                v /= np.float32(norm)
        self.adam.update(g)
        return h
