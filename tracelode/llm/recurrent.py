"""A gated recurrent language model in numpy: one layer, output softmax factored into kinds and classes.

Tokens are numbers: 0 .. size-1 are those of the vocabulary, `size` stands for known words outside it (if
there are any), `size + 1` for words that training has not seen. The vocabulary is split into classes, in
order of frequency, by probability and by number of tokens alike, and the classes are split into kinds in
the same way. The probability of a token is that of its kind times that of its class in the kind times that
of the token in the class, all given the state. The two other tokens are kinds of their own.

Used inside tasks; the number of floats of a model is in proportion to its vocabulary.
"""

from __future__ import annotations

import math

import numpy as np

WINDOW = 32
TOGETHER = 1 << 14
ROWS = 512
_LOGITS = 1 << 16
_HELD = 1 << 12
_PIECE = 1 << 14


def _dealt(mass: np.ndarray, parts: int) -> np.ndarray:
    """Part of each of `mass`, in order: at most `parts` parts, from 0 on.

    Half by number: no part has more than twice its share of them, whatever their mass.
    """
    share = ((np.cumsum(mass) - mass / 2) / mass.sum() + (np.arange(len(mass)) + 0.5) / len(mass)) / 2
    return np.unique(np.minimum((share * parts).astype(int), parts - 1), return_inverse=True)[1]


class Layout:
    """Classes of a vocabulary given by descending counts, and kinds, as many as the square root of the classes."""

    def __init__(self, counts: np.ndarray, classes: int):
        self.size, mass = len(counts), counts + 1.0
        owner = _dealt(mass, classes) if self.size else np.zeros(0, dtype=np.int64)
        self.classes = int(owner[-1]) + 1 if self.size else 0
        self.first = np.searchsorted(owner, np.arange(self.classes + 1))
        self.class_of = np.concatenate([owner, self.classes + np.arange(2)]).astype(np.int64)
        above = _dealt(np.add.reduceat(mass, self.first[:-1]), math.ceil(self.classes**0.5)) if self.size else owner
        own = int(above[-1]) + 1 if self.size else 0
        self.first_class = np.searchsorted(above, np.arange(own + 1))
        self.kind_of = np.concatenate([above, own + np.arange(2)]).astype(np.int64)
        self.kinds = own + 2
        self.widest = max(self.kinds, int(np.diff(self.first).max(initial=0)), int(np.diff(self.first_class).max(initial=0)))


def _log_softmax(logits: np.ndarray, pick: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of the picked columns; `logits` become exponentials, whose row sums and the places of
    the picked among them are returned too.

    `logits` come shifted by a bound, so that none is above 0; rows so far below it that they would vanish have
    their own shift. There are as many `ones` as columns, or more.
    """
    at = np.arange(0, logits.size, logits.shape[1])
    at += pick
    low = logits.take(at)
    if low.min() < -60:
        logits -= logits.max(axis=1, keepdims=True)
        low = logits.take(at)
    np.exp(logits, out=logits)
    total = logits @ ones[: logits.shape[1]]
    low -= np.log(total)
    return low, total, at


def _shifted(weights: np.ndarray, bias: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weights with the bias as one more column, less the highest logit that any state can give in its group.

    States lie between -1 and 1; `first` are the first rows of the groups.
    """
    out = np.empty((len(weights), weights.shape[1] + 1), dtype=np.float32)
    out[:, :-1] = weights
    if len(weights):
        most = np.maximum.reduceat(np.abs(weights) @ np.ones(weights.shape[1], dtype=np.float32) + bias, first)
        out[:, -1] = bias - np.repeat(most, np.diff(np.append(first, len(weights))))
    return out


def _room(memory: dict, name: str, *shape: int) -> np.ndarray:
    """An array to fill that stays in `memory` from step to step: new pages would cost as much as the filling."""
    size = int(np.prod(shape))
    if name not in memory or len(memory[name]) < size:
        memory[name] = np.empty(size, dtype=np.float32)
    return memory[name][:size].reshape(shape)


class Model:
    """Parameters as one flat float32 array with named views."""

    def __init__(self, layout: Layout, hidden: int, counts: np.ndarray, others: tuple[float, float], seed: int = 1):
        self.layout, self.hidden = layout, hidden
        shapes = {
            "enter": (3 * hidden, layout.size + 2), "keep": (hidden, 3 * hidden), "bias": (3 * hidden,),
            "kind_w": (layout.kinds, hidden), "kind_b": (layout.kinds,), "class_w": (layout.classes, hidden), "class_b": (layout.classes,),
            "word_w": (layout.size, hidden), "word_b": (layout.size,),
        }
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), dtype=np.float32)
        self.part, at = {}, 0
        for name, shape in shapes.items():
            width = int(np.prod(shape))
            self.part[name] = self.flat[at : at + width].reshape(shape)
            at += width
        draw = np.random.default_rng(seed)
        for name, scale in (("enter", 0.3), ("keep", 0.3), ("kind_w", 0.05), ("class_w", 0.05), ("word_w", 0.05)):
            part = self.part[name].T if name == "enter" else self.part[name]
            part[...] = draw.normal(0, scale, part.shape)
        self.part["bias"][:hidden] = -1.0
        # Before training the model gives the unigram probabilities.
        self.part["word_b"][...] = np.log(counts + 1.0)
        mass = np.array([(counts[a:b] + 1.0).sum() for a, b in zip(layout.first[:-1], layout.first[1:])])
        self.part["class_b"][...] = np.log(mass)
        above = [mass[a:b].sum() for a, b in zip(layout.first_class[:-1], layout.first_class[1:])]
        self.part["kind_b"][...] = np.log(np.array([*above, others[0] + 1.0, others[1] + 1.0]))
        self.part["kind_b"][...] -= self.part["kind_b"].max()

    def _entry(self) -> np.ndarray:
        """What each token brings to the gates, a row for each number of a gate.

        Gates are halved, here and in `_kept`, as the tanh form of a sigmoid asks for.
        """
        out = self.part["enter"] + self.part["bias"][:, None]
        out[: 2 * self.hidden] *= np.float32(0.5)
        return out

    def _kept(self) -> np.ndarray:
        """What the state brings to the gates."""
        out = self.part["keep"].T.copy()
        out[: 2 * self.hidden] *= np.float32(0.5)
        return out

    def _run(self, entry: np.ndarray, tokens: np.ndarray, state: np.ndarray) -> np.ndarray:
        """States before each of the steps of `tokens` (steps, rows), then the one after the last.

        Rows are the last axis, of `state` as well, so that a gate's numbers lie together.
        """
        h, half, one = self.hidden, np.float32(0.5), np.float32(1.0)
        weights = self._kept()
        states = np.empty((len(tokens) + 1, *state.shape), dtype=np.float32)
        states[0] = state
        entered, held = np.empty((2, 3 * h, state.shape[1]), dtype=np.float32)
        gates, given, fresh = entered[: 2 * h], held[: 2 * h], held[2 * h :]
        for step, old, new in zip(tokens, states, states[1:]):
            np.take(entry, step, axis=1, out=entered, mode="clip")
            np.matmul(weights, old, out=held)
            gates += given
            np.tanh(gates, out=gates)
            gates += one
            gates *= half
            fresh *= gates[h:]
            fresh += entered[2 * h :]
            np.tanh(fresh, out=fresh)
            fresh -= old
            fresh *= gates[:h]
            np.add(fresh, old, out=new)
        return states

    def _lines(self, states: np.ndarray, memory: dict) -> np.ndarray:
        """States (steps, hidden, rows) as one line each, step by step, with a one for the bias at the end."""
        steps, h, rows = states.shape
        out = _room(memory, "lines", steps, rows, h + 1)
        out[:, :, :h] = states.transpose(0, 2, 1)
        out[:, :, h] = 1
        return out.reshape(-1, h + 1)

    def _targets(self, lines: np.ndarray, place: np.ndarray, tokens: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each token given the state before it, `lines[place]`, and the gradient on the states.

        Tokens are put in order of their classes, so that each class works on rows that lie together.
        """
        layout, h = self.layout, self.hidden
        narrow = np.uint16 if layout.classes < 1 << 15 else np.int64
        order = np.argsort(layout.class_of.astype(narrow).take(tokens), kind="stable")
        target = tokens.take(order)
        class_of = layout.class_of.take(target)
        kind_of = layout.kind_of.take(class_of)
        place = place.take(order)
        known = lines.take(place, axis=0)
        found = np.zeros(len(tokens), dtype=np.float32)
        back = None if grads is None else np.zeros((len(tokens), h), dtype=np.float32)
        ones = np.ones(layout.widest, dtype=np.float32)
        levels = (
            ("kind", np.array([0, layout.kinds]), np.array([0, len(tokens)]), kind_of),
            ("class", layout.first_class, np.searchsorted(kind_of, np.arange(layout.kinds - 1)), class_of),
            ("word", layout.first, np.searchsorted(class_of, np.arange(layout.classes + 1)), target),
        )
        for name, first, cuts, chosen in levels:
            w, b = name + "_w", name + "_b"
            weights = _shifted(self.part[w], self.part[b], first[:-1])
            for low, high, start, end in zip(cuts.tolist(), cuts[1:].tolist(), first.tolist(), first[1:].tolist()):
                # Blocks whose logits stay in a core's cache.
                block = max(1, _LOGITS // (end - start)) if end - start > 1 else 0
                for at in range(low, high, block) if block else ():
                    part = slice(at, min(at + block, high))
                    own, pick = known[part], chosen[part] - start
                    logits = own @ weights[start:end].T
                    inside, total, at_pick = _log_softmax(logits, pick, ones)
                    found[part] += inside
                    if grads is not None:
                        logits *= (np.float32(-1) / total)[:, None]
                        logits.reshape(-1)[at_pick] += 1
                        change = logits.T @ own
                        grads[w][start:end] += change[:, :h]
                        grads[b][start:end] += change[:, h]
                        back[part] += logits @ self.part[w][start:end]
        out = np.empty_like(found)
        out[order] = found
        if back is None:
            return out, None
        spread = np.zeros((len(lines), h), dtype=np.float32)
        spread[place] = back
        return out, spread

    def score(self, texts: list[np.ndarray], start: int) -> np.ndarray:
        """Natural log probability of each token sequence; `start` is read before the first token.

        All sequences advance together, the longest first; states go from window to window to the end.
        """
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        ranked = lengths[order]
        sums = np.zeros(len(texts))
        state = np.zeros((self.hidden, len(texts)), dtype=np.float32)
        # Texts end to end, each after the token that is read first.
        ahead = np.array([start], dtype=np.int64)
        stream = np.concatenate([ahead, *(part for i in order.tolist() for part in (texts[i], ahead))])
        first = np.cumsum(ranked + 1) - ranked - 1
        entry = self._entry()
        # Steps of long texts are few rows each: their states wait until a good number can be scored together.
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        held = lines = at = 0

        def settle() -> None:
            if waiting:
                found, _ = self._targets(*(np.concatenate(part) for part in list(zip(*waiting))[:3]), None)
                np.add.at(sums, np.concatenate([owner for *_, owner in waiting]), found.astype(np.float64))
                waiting.clear()

        while True:
            live = int(np.searchsorted(-ranked, -at, side="left"))
            if not live:
                settle()
                return sums
            # Few rows go many steps at once, many rows few, so that what a window holds stays in a core's cache.
            steps = min(max(1, _HELD // live), int(ranked[0]) - at)
            grid = stream.take(first[:live] + np.arange(at, at + steps + 1)[:, None], mode="clip")
            inside = np.flatnonzero(np.arange(at, at + steps)[:, None] < ranked[:live])
            states = self._run(entry, grid[:-1], state[:, :live])
            waiting.append((self._lines(states[1:], {}), inside + lines, grid[1:].take(inside), order.take(inside % live)))
            lines += steps * live
            held += len(inside)
            if held >= TOGETHER or lines >= 2 * TOGETHER:
                settle()
                held = lines = 0
            state = states[-1]
            at += steps

    def train(self, texts: list[np.ndarray], start: int, rate: float, memory: dict) -> None:
        """One pass of truncated backpropagation: rows of texts laid end to end, states carried on.

        A row reads the last token of the row before it first; the last row is filled up with tokens that
        are not learned.
        """
        stream = np.concatenate([np.concatenate([[start], t]) for t in texts]) if texts else np.zeros(0, np.int64)
        fresh = np.zeros(len(stream), dtype=bool)
        at = 0
        for t in texts:
            fresh[at] = True
            at += len(t) + 1
        # Wide enough for few calls a token, narrow enough for some twenty steps a pass over a small part.
        rows = int(min(ROWS, max(1, len(stream) // (24 * WINDOW))))
        if len(stream) < 2:
            return
        span = -(-(len(stream) - 1) // rows)
        fill = span * rows + 1 - len(stream)
        place = np.arange(span + 1)[:, None] + span * np.arange(rows)
        grid = np.concatenate([stream, np.full(fill, start, dtype=stream.dtype)])[place]
        fresh = np.concatenate([fresh, np.ones(fill, dtype=bool)])[place]
        state = np.zeros((rows, self.hidden), dtype=np.float32)
        for low in range(0, span, WINDOW):
            high = min(low + WINDOW, span)
            state = self._learn(grid[low : high + 1], fresh[low : high + 1], state, rate, memory)

    def _learn(self, grid: np.ndarray, fresh: np.ndarray, state: np.ndarray, rate: float, memory: dict) -> np.ndarray:
        h = self.hidden
        read, want, valid = grid[:-1], grid[1:], ~fresh[1:]
        # A text's first token starts from an empty state.
        clear = fresh[:-1]
        state = state * ~clear[0][:, None]
        states, tape = self._run_cleared(read, state, clear, memory)
        if "grads" not in memory:
            memory["grads"] = np.zeros_like(self.flat)
        flat = memory["grads"]
        flat[...] = 0
        grads, at = {}, 0
        for name, part in self.part.items():
            grads[name] = flat[at : at + part.size].reshape(part.shape)
            at += part.size
        place = np.flatnonzero(valid)
        _, spread = self._targets(self._lines(states[1:], memory), place, want.take(place), grads)
        self._backward(read, states, clear, tape, spread, grads, memory)
        flat *= np.float32(1 / max(1, len(place)))
        self._step(flat, rate, memory)
        return states[-1].T.copy()

    def _run_cleared(self, tokens: np.ndarray, state: np.ndarray, clear: np.ndarray, memory: dict) -> tuple:
        """States (steps + 1, hidden, rows), and what the way back needs: gates and new values, what the state gave."""
        h, half, one = self.hidden, np.float32(0.5), np.float32(1.0)
        weights, entry = self._kept(), self._entry()
        entered, given = _room(memory, "tape", 2, len(tokens), 3 * h, len(state))
        states = _room(memory, "states", len(tokens) + 1, h, len(state))
        states[0] = state.T
        for t in range(len(tokens)):
            np.take(entry, tokens[t], axis=1, out=entered[t], mode="clip")
            if t and clear[t].any():
                states[t][:, clear[t]] = 0
            old, gates, fresh = states[t], entered[t, : 2 * h], entered[t, 2 * h :]
            held = np.matmul(weights, old, out=given[t])
            gates += held[: 2 * h]
            np.tanh(gates, out=gates)
            gates += one
            gates *= half
            fresh += gates[h:] * held[2 * h :]
            np.tanh(fresh, out=fresh)
            step = fresh - old
            step *= gates[:h]
            np.add(step, old, out=states[t + 1])
        return states, (entered, given)

    def _backward(self, tokens, states, clear, tape, spread, grads, memory) -> None:
        h, steps, one = self.hidden, len(tokens), np.float32(1.0)
        entered, given = tape
        into, through = _room(memory, "back", 2, *entered.shape)
        spread, lines = _room(memory, "spread", *states[1:].shape), spread
        spread[...] = lines.reshape(steps, -1, h).transpose(0, 2, 1)
        pulled = np.zeros_like(states[0])
        for t in range(steps - 1, -1, -1):
            keep, reset, fresh = entered[t, :h], entered[t, h : 2 * h], entered[t, 2 * h :]
            grad, own, passed = spread[t], into[t], through[t]
            grad += pulled
            kept = grad * keep
            d_keep, d_reset, d_fresh = own[:h], own[h : 2 * h], own[2 * h :]
            np.multiply(fresh, fresh, out=d_fresh)
            np.subtract(one, d_fresh, out=d_fresh)
            d_fresh *= kept
            np.subtract(one, keep, out=d_keep)
            d_keep *= kept
            d_keep *= fresh - states[t]
            np.multiply(d_fresh, reset, out=passed[2 * h :])
            np.subtract(one, reset, out=d_reset)
            d_reset *= given[t, 2 * h :]
            d_reset *= passed[2 * h :]
            passed[: 2 * h] = own[: 2 * h]
            pulled = self.part["keep"] @ passed
            grad -= kept
            pulled += grad
            if clear[t].any():
                pulled[:, clear[t]] = 0
        grads["keep"] += np.matmul(states[:-1], through.transpose(0, 2, 1)).sum(axis=0)
        grads["bias"] += into.sum(axis=(0, 2))
        flat, weights = tokens.reshape(-1), np.empty(tokens.shape)
        for number, sums in enumerate(grads["enter"]):
            weights[...] = into[:, number]
            sums += np.bincount(flat, weights.reshape(-1), len(sums))

    def _step(self, grad: np.ndarray, rate: float, memory: dict) -> None:
        """Adam, upwards, piece by piece so that what is worked on stays in a core's cache."""
        if "mean" not in memory:
            memory["mean"], memory["square"], memory["count"] = np.zeros_like(grad), np.zeros_like(grad), 0
        memory["count"] += 1
        n = memory["count"]
        # Means are kept as sums: the factors that make means of them are in `back` and `pace`.
        back = (0.01 / (1 - 0.99**n)) ** 0.5
        pace = 0.1 * rate / (1 - 0.9**n) / back
        for low in range(0, len(grad), _PIECE):
            own, mean, square, flat = (a[low : low + _PIECE] for a in (grad, memory["mean"], memory["square"], self.flat))
            mean *= np.float32(0.9)
            mean += own
            own *= own
            square *= np.float32(0.99)
            square += own
            np.sqrt(square, out=own)
            own += np.float32(1e-8 / back)
            np.divide(mean, own, out=own)
            own *= np.float32(pace)
            flat += own
