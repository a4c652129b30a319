"""Log-likelihood of whole documents under a gated recurrent language model, with a unigram base beside it.

Words are lower-cased (A-Z) runs of non-blank characters, and each document ends with one end token. Counts of all words
are taken over all training documents. The most frequent ``HEAD`` words, the end and "any other word" are the symbols of
a GRU whose output softmax is factored by classes: first a class or group of classes, then the class within its group,
then the word within its class. Any other word's share is its count plus one over the sum of those (one more for words
never seen), so every word has a probability and all of them sum to one.

Training is truncated backpropagation through time in numpy: a first model from a bounded sample of documents in one
task, then every training document goes to a task by its hash, each task trains that model on all its tokens, and the
models are averaged by tokens seen. So no task's size grows with the input, and how the input's files are cut changes no
score. In scoring the state is carried from window to window through each whole document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, stored
from .textnum import SPACED, blocks, spans, text_bytes, word_hashes

HEAD, HIDDEN = 1 << 15, 24
FINE, FINE_WORDS, CLASS_WORDS, CLASSES_A_GROUP = 1024, 64, 256, 4
TOP = 1 << 17  # words whose counts are broadcast; those of all others are joined
FIRST_DOCS, FIRST_TOKENS, FIRST_EPOCHS, FIRST_RATE, FIRST_LANES = 1500, 600_000, 2, 0.01, 64
RATE, TASK_TOKENS = 0.004, 3_000_000
STEPS, LANES, SCORE_LANES, WINDOWS = 64, 512, 512, 2
PIECE = 512  # states whose choices are weighed at once, so that they stay in the processor's cache
FOLDS, HELD_OUT = 7, 2
MODELS_A_GROUP, SLICES = 16, 64  # a model has about 7 MB, a slice of it 0.1 MB
_LN10, _SLOT = float(np.log(10.0)), np.uint64((1 << 20) - 1)


@dataclass
class Counts:
    """Hashes (sorted) and counts of the TOP most frequent words, which of them are head symbols, and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    symbol: np.ndarray  # of each: its number below n_head, or ``other``
    n_head: int
    tokens: int  # of all training documents, with ends
    distinct: int  # with the end
    ends: int
    head_tokens: int  # of head words
    slots: np.ndarray | None = None
    crowded: np.ndarray | None = None

    @property
    def end(self) -> int:
        return self.n_head

    @property
    def other(self) -> int:
        return self.n_head + 1

    @property
    def other_mass(self) -> int:
        """The sum of count plus one over words that are no symbol, and one for words never seen."""
        return self.tokens - self.ends - self.head_tokens + self.distinct - 1 - self.n_head + 1

    def frequency(self) -> np.ndarray:
        """Counts of the symbols; that of ``other`` is its mass."""
        out = np.zeros(self.n_head + 2)
        head = self.symbol < self.n_head
        out[self.symbol[head]] = self.counts[head]
        out[self.end], out[self.other] = self.ends, self.other_mass
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the top words, and whether it is there."""
        if not self.hashes.size:
            return np.zeros(hashes.size, np.int64), np.zeros(hashes.size, bool)
        if self.slots is None:  # the first word of each slot, and by its side whether the slot has others
            self.slots, own = np.zeros(1 << 20, np.int32), (self.hashes & _SLOT).astype(np.int64)
            self.slots[own[::-1]] = np.arange(own.size, dtype=np.int32)[::-1]
            self.crowded = np.bincount(own, minlength=1 << 20) > 1
        slot = (hashes & _SLOT).astype(np.int64)
        at = self.slots[slot].astype(np.int64)
        there = self.hashes[at] == hashes
        again = np.flatnonzero(~there & self.crowded[slot])
        at[again] = np.minimum(np.searchsorted(self.hashes, hashes[again]), self.hashes.size - 1)
        there[again] = self.hashes[at[again]] == hashes[again]
        return at, there


def _documents(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, bounds of each row's words)."""
    data, offsets = text_bytes(column)
    for i, j in blocks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, bounds = spans(part, at, SPACED)
        yield i, j, word_hashes(part, start, end), bounds


def word_counts(training: DataFrame) -> DataFrame:
    """(hash, n) of every word of the rows' ``text``, and the number of rows under the null hash. Tasks count before they send."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(place, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def sent(words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, words.size, 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000])], ["hash", "n"])

        for batch in batches:
            rows += batch.num_rows
            for _, _, hashes, _ in _documents(batch.column(0)):
                if hashes.size:
                    held.append(np.unique(hashes, return_counts=True))
                    size += held[-1][0].size
                if size > 2_000_000:
                    held = [merged()]
                    size = held[0][0].size
                    if size > 1_000_000:
                        yield from sent(*held[0])
                        held, size = [], 0
        if held:
            yield from sent(*merged())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows], pa.int64())], ["hash", "n"])

    return training.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def gathered(counts: DataFrame, head: int = HEAD, top: int = TOP) -> Counts:
    """What scoring needs of stored ``word_counts``: totals, and the most frequent words, ``top`` at most: those from the lowest
    step of frequency (sixteenths of a power of two) at which no more than ``top`` words remain."""
    words = counts.where("hash IS NOT NULL")
    n, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = counts.where("hash IS NULL").agg(F.sum("n")).first()[0] or 0
    step = F.floor(F.log2("n") * 16)
    sizes = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()  # some hundred steps
    least, held = None, 0
    for row in sizes:
        held += row["words"]
        if held > top:
            break
        least = row["step"]
    chosen = words.where(step >= least if least is not None else F.lit(False)).toPandas().sort_values(["n", "hash"], ascending=[False, True])  # ``top`` rows at most
    hashes, numbers = chosen["hash"].to_numpy(np.int64).view(np.uint64), chosen["n"].to_numpy(np.int64)
    n_head = min(head, hashes.size)
    symbol = np.minimum(np.arange(hashes.size), n_head)
    symbol = np.where(symbol < n_head, symbol, n_head + 1)
    order = np.argsort(hashes)
    return Counts(hashes[order], numbers[order], symbol[order], n_head, (n or 0) + ends, distinct + (ends > 0), ends, int(numbers[:n_head].sum()))


def symbols_of(hashes: np.ndarray, counts: Counts) -> np.ndarray:
    at, there = counts.find(hashes)
    return np.where(there, counts.symbol[at] if counts.symbol.size else counts.other, counts.other)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin in sorted ``x``."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: x.size])


class Gru:
    """Parameters as float32 arrays. Symbols: head words, then the end, then other. The output is factored: words stand in
    classes, runs of them by frequency (FINE_WORDS each among the first FINE words, CLASS_WORDS each behind them), and the
    classes behind the first ones in groups of CLASSES_A_GROUP. The first choice is among fine classes, groups, the end and
    other words, the next among a group's classes, the last among a class's words."""

    def __init__(self, n_head: int, hidden: int = HIDDEN, seed: int = 5, frequency: np.ndarray | None = None) -> None:
        self.n_head, self.hidden = n_head, hidden
        most = min(n_head, FINE)
        self.starts = np.concatenate([np.arange(0, most, FINE_WORDS), np.arange(most, n_head, CLASS_WORDS), [n_head]])
        classes, self.fine = self.starts.size - 1, -(-most // FINE_WORDS)
        self.group_starts = np.append(np.arange(0, classes - self.fine, CLASSES_A_GROUP), classes - self.fine)
        self.class_of = np.repeat(np.arange(classes), np.diff(self.starts))
        first = self.fine + self.group_starts.size - 1
        self.root_of = np.append(np.where(self.class_of < self.fine, self.class_of, self.fine + (self.class_of - self.fine) // CLASSES_A_GROUP), [first, first + 1])
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        h = hidden
        self.p = {
            "e": draw(n_head + 2, h, scale=0.3), "i": draw(h, 3 * h, scale=h**-0.5), "ib": np.zeros(3 * h, np.float32), "u": draw(h, 3 * h, scale=h**-0.5),
            "r": draw(first + 2, h, scale=0.1), "rb": np.zeros(first + 2, np.float32), "g": draw(classes - self.fine, h, scale=0.1), "gb": np.zeros(classes - self.fine, np.float32),
            "w": draw(n_head, h, scale=0.1), "wb": np.zeros(n_head, np.float32),
        }
        if frequency is not None:  # the first guess is that of counts
            n = frequency + 0.5
            root, of_class = np.bincount(self.root_of, weights=n), np.bincount(self.class_of, weights=n[:n_head], minlength=classes)
            self.p["rb"][:] = np.log(root / root.sum())
            grouped = np.arange(classes - self.fine) // CLASSES_A_GROUP
            self.p["gb"][:] = np.log(of_class[self.fine :] / root[self.fine + grouped])
            self.p["wb"][:] = np.log(n[:n_head] / of_class[self.class_of])
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.step = self.learned = 0  # updates, and targets learned from
        self.safe = False  # whether exponentials need no shift, see ``_bounded``

    def packed(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p.values()])

    def unpack(self, flat: np.ndarray) -> Gru:
        at = 0
        for key, a in self.p.items():
            self.p[key] = flat[at : at + a.size].astype(np.float32).reshape(a.shape)
            at += a.size
        return self

    def _bounded(self) -> bool:
        """Whether no logit can come near the range in which float32 exponentials fail: states lie between -1 and 1. It holds
        for the WINDOWS updates that follow, too, for none of them moves a parameter by much more than its rate."""
        p = self.p
        return all(not p[w].size or float((np.abs(p[w]).sum(axis=1) + np.abs(p[w + "b"])).max()) < 40 for w in ("r", "g", "w"))

    def states(self, inputs: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states [T, B, H] after each of ``inputs`` [T, B], from ``state`` [B, H]; an end token clears the state. ``keep`` gets
        what backpropagation needs of each step: the state before, both gates, the candidate and its recurrent part.

        Within the steps lanes are the last axis, [H, B], so that gates and candidates are whole rows of memory."""
        h, n, ut = self.hidden, inputs.shape[0], np.ascontiguousarray(self.p["u"].T)
        out = np.empty((n, h, inputs.shape[1]), self.p["u"].dtype)
        given = self.p["i"].T @ self.p["e"][inputs].transpose(0, 2, 1)
        given += self.p["ib"][:, None]
        clear = inputs == self.n_head
        cleared = clear.any(axis=1)
        state = np.ascontiguousarray(state.T)
        with np.errstate(over="ignore"):  # an infinite exponential is a closed gate
            for t in range(n):
                if cleared[t]:
                    state = np.where(clear[t], out.dtype.type(0), state)
                g = ut @ state
                gates = g[: 2 * h] + given[t, : 2 * h]
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                new = gates[h:] * g[2 * h :]
                new += given[t, 2 * h :]
                np.tanh(new, out=new)
                if keep is not None:
                    keep.append((state, gates[:h], gates[h:], new, g[2 * h :]))
                state = np.subtract(state, new, out=out[t])
                state *= gates[:h]
                state += new
        return np.ascontiguousarray(out.transpose(0, 2, 1))

    def log_chances(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logs of the chances of ``targets`` [M] after ``states`` [M, H]. With ``grads`` (a dict that is filled), also
        the gradient of minus their sum by states."""
        out, back = np.zeros(targets.size), None if grads is None else np.zeros_like(states)
        every = np.arange(targets.size)
        states = np.concatenate([states, np.ones((len(states), 1), states.dtype)], axis=1)  # the last column meets the bias
        root = self.root_of[targets]
        self._choose(states, every, np.zeros(targets.size, np.intp), root, np.array([0, self.p["rb"].size]), "r", out, back, grads)
        words = np.flatnonzero(targets < self.n_head)
        own = self.class_of[targets[words]]
        self._choose(states, words, own, targets[words], self.starts, "w", out, back, grads)
        grouped = own >= self.fine
        self._choose(states, words[grouped], root[words[grouped]] - self.fine, own[grouped] - self.fine, self.group_starts, "g", out, back, grads)
        return out, back

    def _choose(self, states: np.ndarray, at: np.ndarray, group: np.ndarray, row: np.ndarray, starts: np.ndarray, key: str, out: np.ndarray, back: np.ndarray | None, grads: dict | None) -> None:
        """Adds to ``out`` the log chances of choosing ``row`` among the rows of ``group``, whose bounds are ``starts``, at the places
        ``at`` of the states; and gradients to ``back`` and ``grads``."""
        w = np.column_stack([self.p[key], self.p[key + "b"]])
        order = np.argsort(group.astype(np.min_scalar_type(starts.size)), kind="stable") if starts.size > 2 else slice(None)
        at, group, row = at[order], group[order], row[order]
        here = states if at.size == len(states) and starts.size == 2 else states[at]
        first = _runs(group)
        used = group[first]
        place, m = row - starts[group], np.arange(at.size)
        totals, best = np.empty(at.size, states.dtype), np.empty(at.size, states.dtype)
        if grads is not None:
            gw, own_back = np.zeros_like(w), np.empty((at.size, self.hidden), here.dtype)
        pieces = [(k, c, min(b, c + PIECE)) for k, a, b in zip(used, first, np.append(first[1:], at.size), strict=False) for c in range(a, b, PIECE)]
        for k, a, b in pieces:
            rows = slice(starts[k], starts[k + 1])
            own, h, i = w[rows], here[a:b], (m[: b - a], place[a:b])
            chance = h @ own.T
            if not self.safe:
                chance -= chance.max(axis=1, keepdims=True)
            best[a:b] = chance[i]
            np.exp(chance, out=chance)
            total = totals[a:b] = chance.sum(axis=1)
            if grads is not None:
                chance[i] -= total
                share = (1 / total)[:, None]  # scales what is narrow, not the chances
                gw[rows] += chance.T @ (h * share)
                np.multiply(chance @ own[:, :-1], share, out=own_back[a:b])
        out[at] += best - np.log(totals)
        if grads is not None:
            back[at] += own_back
            grads[key], grads[key + "b"] = np.ascontiguousarray(gw[:, :-1]), np.ascontiguousarray(gw[:, -1])

    def learn(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """One window of truncated backpropagation [T, B], in which targets below 0 are none; the state after it and the sum of
        log chances."""
        h, kept, grads = self.hidden, [], {}
        hs = self.states(inputs, state, kept)
        there = targets.ravel() >= 0
        if there.all():
            logs, back = self.log_chances(hs.reshape(-1, h), targets.ravel(), grads)
        else:
            logs, found = self.log_chances(hs.reshape(-1, h)[there], targets.ravel()[there], grads)
            back = np.zeros((inputs.size, h), hs.dtype)
            back[there] = found
        back = np.ascontiguousarray(back.reshape(hs.shape).transpose(0, 2, 1))
        later, ends, du, u = np.zeros_like(state.T, order="C"), inputs == self.n_head, np.zeros_like(self.p["u"]), self.p["u"]
        given = np.empty((inputs.shape[0], 3 * h, inputs.shape[1]), hs.dtype)
        for t in range(inputs.shape[0] - 1, -1, -1):
            before, z, r, new, part = kept.pop()
            own, dh = given[t], later
            dh += back[t]
            kz = dh * z
            dh -= kz
            slope = new * new
            np.subtract(1, slope, out=slope)
            dn = np.multiply(dh, slope, out=own[2 * h :])
            np.subtract(before, new, out=slope)
            slope *= 1 - z
            np.multiply(kz, slope, out=own[:h])
            np.subtract(1, r, out=slope)
            slope *= r
            slope *= part
            np.multiply(dn, slope, out=own[h : 2 * h])
            dg = own.copy()
            dg[2 * h :] *= r
            du += before @ dg.T
            later = u @ dg
            later += kz
            later[:, ends[t]] = 0
        flat = inputs.ravel()
        grads["u"], grads["ib"] = du, given.sum(axis=(0, 2))
        grads["i"] = (self.p["e"][inputs].transpose(0, 2, 1) @ given.transpose(0, 2, 1)).sum(axis=0)
        by_input = np.ascontiguousarray((self.p["i"] @ given).transpose(0, 2, 1)).reshape(-1, h)
        order = np.argsort(flat.astype(np.min_scalar_type(self.n_head + 1)), kind="stable")
        first = _runs(flat[order])
        rows = flat[order[first]]
        n = max(1, int(there.sum()))
        self.learned += int(there.sum())
        self._adam(grads, rate, n, rows, np.add.reduceat(by_input[order], first, axis=0))
        return hs[-1], float(logs.sum())

    def _adam(self, grads: dict[str, np.ndarray], rate: float, n: int, rows: np.ndarray, row_grads: np.ndarray) -> None:
        """One step of Adam for the mean over ``n`` targets; of the embeddings, only the window's ``rows`` move."""
        self.step += 1
        fix = np.float32(rate * (1 - 0.99**self.step) ** 0.5 / (1 - 0.9**self.step))
        for key, g in [*grads.items(), ("e", row_grads)]:
            if key not in self.moments:
                self.moments[key] = (np.zeros_like(self.p[key]), np.zeros_like(self.p[key]))
            m, v = self.moments[key]
            if key == "e":
                m, v = m[rows], v[rows]
            g *= np.float32(0.1 / n)
            m *= np.float32(0.9)
            m += g
            g *= g  # a hundredth of the square
            v *= np.float32(0.99)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= fix
            if key == "e":
                self.moments[key][0][rows], self.moments[key][1][rows] = m, v
                self.p[key][rows] -= g
            else:
                self.p[key] -= g

    def train(self, stream: np.ndarray, rate: float, lanes: int = LANES, steps: int = STEPS) -> float:
        """Trains on a stream of symbols in which an end token stands before each document and behind the last: each symbol but
        the first is a target once. Mean log chance."""
        n = stream.size - 1
        if n < 1:
            return 0.0
        lanes = max(1, min(lanes, n // steps))
        length = -(-n // lanes)
        padded = np.full(lanes * length + 1, -1, np.int64)
        padded[: stream.size] = stream
        inputs, targets = (padded[k : k + lanes * length].reshape(lanes, length).T for k in (0, 1))
        state, total = np.zeros((lanes, self.hidden), np.float32), 0.0
        for t in range(0, length, steps):
            if t % (steps * WINDOWS) == 0:
                self.safe = self._bounded()
            given = inputs[t : t + steps]
            state, logs = self.learn(np.where(given < 0, self.n_head, given), targets[t : t + steps], state, rate)
            total += logs
        return total / n

    def score(self, documents: list[np.ndarray], lanes: int = SCORE_LANES, steps: int = STEPS) -> np.ndarray:
        """Natural log chance of each document's symbols (its end among them), the state carried through all its windows. Documents
        follow each other in lanes of about equal length; the end of one clears the state for the next."""
        out = np.zeros(len(documents))
        if not documents:
            return out
        self.safe = self._bounded()
        lengths = np.array([d.size for d in documents], np.int64)
        loads: list[tuple[int, int]] = [(0, lane) for lane in range(min(lanes, len(documents)))]
        dealt: list[list[int]] = [[] for _ in loads]
        for k in np.argsort(-lengths, kind="stable").tolist():
            load, lane = heapq.heappop(loads)
            dealt[lane].append(k)
            heapq.heappush(loads, (load + int(lengths[k]), lane))
        dealt.sort(key=lambda own: -int(lengths[own].sum()))
        symbols = [np.concatenate([documents[k] for k in own]) for own in dealt]
        owners = [np.repeat(own, lengths[own]) for own in dealt]
        sizes = np.array([s.size for s in symbols])
        state, last = np.zeros((sizes.size, self.hidden), np.float32), np.full(sizes.size, self.n_head)
        for t in range(0, int(sizes[0]), steps):
            active = int(np.searchsorted(-sizes, -t, side="left"))
            width = min(steps, int(sizes[0]) - t)
            targets, owner = np.full((active, width), -1), np.zeros((active, width), np.int64)
            for lane in range(active):
                piece = symbols[lane][t : t + width]
                targets[lane, : piece.size], owner[lane, : piece.size] = piece, owners[lane][t : t + width]
            targets, owner = targets.T, owner.T.ravel()
            there = targets.ravel() >= 0
            given = np.where(targets < 0, self.n_head, targets)
            hs = self.states(np.concatenate([last[None, :active], given[:-1]]), state[:active])
            state, last = hs[-1], given[-1]
            flat, wanted = hs.reshape(-1, self.hidden), given.ravel()
            if not there.all():
                flat, wanted, owner = flat[there], wanted[there], owner[there]
            out += np.bincount(owner, weights=self.log_chances(flat, wanted)[0], minlength=out.size)
        return out


def stream_of(hashes: np.ndarray, bounds: np.ndarray, counts: Counts) -> np.ndarray:
    """Symbols of all rows, an end token before each and one behind the last."""
    n = bounds.size - 1
    out = np.empty(hashes.size + n + 1, np.int64)
    place = np.ones(out.size, bool)
    place[bounds + np.arange(n + 1)] = False
    out[~place] = counts.end
    out[place] = symbols_of(hashes, counts)
    return out


def train_all(model: Gru, streams: Iterator[np.ndarray], rate: float, lanes: int = LANES, steps: int = STEPS) -> None:
    """Trains on streams one behind the other, WINDOWS windows at a time; what is left of one goes before the next."""
    rest, whole = np.zeros(0, np.int64), lanes * steps * WINDOWS
    for stream in streams:
        rest = np.concatenate([rest, stream[1:] if rest.size else stream])
        while rest.size > whole:
            model.train(rest[: whole + 1], rate, lanes, steps)
            rest = rest[whole:]
    model.train(rest, rate, lanes, steps)


def _average(models: DataFrame, tasks: int) -> np.ndarray | None:
    """The mean of parameters in rows (task, slice, tokens, params), weighted by tokens: slice by slice, MODELS_A_GROUP models
    at a time until one is left."""

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        weights = np.array(group.column("tokens").to_pylist(), np.float64)
        total = sum(w * np.frombuffer(p.as_buffer(), np.float32) for w, p in zip(weights, group.column("params"), strict=True))
        return pa.table({"task": group.column("part").slice(0, 1), "slice": group.column("slice").slice(0, 1), "tokens": [int(weights.sum())], "params": [(total / weights.sum()).astype(np.float32).tobytes()]})

    while True:
        groups = -(-tasks // MODELS_A_GROUP)
        dealt = models.withColumn("part", F.col("task") % groups)
        models = stored(dealt.groupBy("slice", "part").applyInArrow(mean, "task long, slice int, tokens long, params binary"), "models")
        if groups == 1:
            break
        tasks = groups
    rows = models.orderBy("slice").select("params").collect()  # SLICES rows: one model
    return np.concatenate([np.frombuffer(r[0], np.float32) for r in rows]) if rows else None


def fit(training: DataFrame, counts: Counts, first_docs: int = FIRST_DOCS, task_tokens: int = TASK_TOKENS) -> np.ndarray:
    """The model's parameters from rows (doc_id, text). The first sample is the rows whose hash lies in the share of the hash
    space that makes about ``first_docs`` of them, FIRST_TOKENS tokens of it at most; after it, every row is learned from once.

    Rows go to tasks by hash, as many tasks as make about ``task_tokens`` each, in the order of the hash, so how files are cut
    changes no score.
    """
    sc = training.sparkSession.sparkContext
    shared = sc.broadcast(counts)
    ranked = training.select("text", F.xxhash64("doc_id", "text").alias("rank"))
    chosen = ranked.where(F.shiftrightunsigned("rank", 11) * F.lit(2.0**-53) < F.lit(min(1.0, first_docs / max(1, counts.ends))))

    def begin(group: pa.Table) -> pa.Table:
        known = shared.value
        model, stream = Gru(known.n_head, frequency=known.frequency()), np.array([known.end])
        for column in group.sort_by([("rank", "ascending"), ("text", "ascending")]).column("text").chunks:
            for _, _, hashes, bounds in _documents(column):
                if stream.size <= FIRST_TOKENS:
                    stream = np.concatenate([stream, stream_of(hashes, bounds, known)[1:]])
        for k in range(FIRST_EPOCHS):
            model.train(stream[: FIRST_TOKENS + 1], FIRST_RATE / (k + 1), FIRST_LANES)
        return pa.table({"params": [model.packed().tobytes()]})

    made = chosen.groupBy(F.lit(1).alias("all")).applyInArrow(begin, "params binary").collect()
    if not made:
        return Gru(counts.n_head, frequency=counts.frequency()).packed()
    first = sc.broadcast(np.frombuffer(made[0][0], np.float32))
    tasks = max(1, round(counts.tokens / task_tokens))

    def go_on(group: pa.Table) -> pa.Table:
        known, part = shared.value, group.column("part")[0].as_py()
        model = Gru(known.n_head).unpack(first.value)
        texts = group.sort_by([("rank", "ascending"), ("text", "ascending")]).column("text")
        train_all(model, (stream_of(hashes, bounds, known) for c in texts.chunks for _, _, hashes, bounds in _documents(c)), RATE)
        slices = [x.tobytes() for x in np.array_split(model.packed(), SLICES)]
        return pa.table({"task": [part] * SLICES, "slice": pa.array(range(SLICES), pa.int32()), "tokens": [model.learned] * SLICES, "params": slices})

    # About ``task_tokens`` a group, some tens of megabytes, whatever the input.
    dealt = ranked.withColumn("part", F.pmod(F.xxhash64("rank", F.lit(7)), F.lit(tasks)))
    models = stored(dealt.groupBy("part").applyInArrow(go_on, "task long, slice int, tokens long, params binary"), "models")
    found = _average(models, tasks)
    return first.value if found is None else found


_ROWS = "row long, doc_id long, held_out boolean, n_tokens long, n_top long, log_counts double, n_other long, log_symbols double, rest array<long>, rest_n array<int>"


def scored_rows(rows: DataFrame, counts: Counts, params: np.ndarray) -> DataFrame:
    """Per row of (doc_id, held_out, text): what the model and the broadcast counts give, and the words that are left to join."""
    sc = rows.sparkSession.sparkContext
    shared, weights = sc.broadcast(counts), sc.broadcast(params)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        model = Gru(known.n_head).unpack(weights.value)
        log_count = np.log10(known.counts + 1.0)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            documents: list[np.ndarray] = []
            facts: list[tuple] = []
            for _, _, hashes, bounds in _documents(batch.column(2)):
                at, there = known.find(hashes)
                symbols = np.where(there, known.symbol[at] if known.symbol.size else known.other, known.other)
                logs = np.where(there, log_count[at] if log_count.size else 0.0, 0.0)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own, here = symbols[a:b], there[a:b]
                    documents.append(np.append(own, known.end))
                    others = own == known.other
                    rest, times = np.unique(hashes[a:b][~here], return_counts=True)
                    facts.append((b - a + 1, int(here.sum()), float(logs[a:b].sum()), float(logs[a:b][others].sum()), int(others.sum()), rest.view(np.int64), times.astype(np.int32)))
            found = model.score(documents) / _LN10
            n = batch.num_rows
            log_all = [f[2] for f in facts]
            columns = [
                pa.array(np.arange(number, number + n)), batch.column(0), batch.column(1), pa.array([f[0] for f in facts], pa.int64()), pa.array([f[1] for f in facts], pa.int64()),
                pa.array(log_all, pa.float64()), pa.array([f[4] for f in facts], pa.int64()), pa.array([s + f[3] for s, f in zip(found, facts, strict=True)], pa.float64()),
                pa.array([f[5] for f in facts], pa.list_(pa.int64())), pa.array([f[6] for f in facts], pa.list_(pa.int32())),
            ]
            number += n
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_top", "log_counts", "n_other", "log_symbols", "rest", "rest_n"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(score, _ROWS)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    A null or empty text is its end token alone. Words are told apart by 64-bit hashes. Rows that repeat are scored each,
    and count each in training; null ids are not held out. Without training documents, every word is unknown and the
    model is untrained. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_mod(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    training = rows.where("NOT held_out")
    counted = stored(word_counts(training), "words")
    counts = gathered(counted)
    found = stored(scored_rows(rows, counts, fit(training, counts)), "scores")
    # The words outside the broadcast: none of them is frequent, so no key of this join is hot.
    rest = found.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("w")).select("row", F.col("w.rest").alias("hash"), F.col("w.rest_n").alias("times"))
    joined = rest.join(counted.where("hash IS NOT NULL"), "hash").groupBy("row").agg(F.sum("times").alias("n_rest"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("log_rest"))
    known_end = int(counts.ends > 0)
    n_rest, log_rest = F.coalesce("n_rest", F.lit(0)), F.coalesce("log_rest", F.lit(0.0))
    base = F.col("log_counts") + log_rest + float(np.log10(counts.ends + 1.0)) - F.col("n_tokens") * float(np.log10(counts.tokens + counts.distinct + 1.0))
    score = F.col("log_symbols") + log_rest - F.col("n_other") * float(np.log10(max(1, counts.other_mass)))
    return found.join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_top") + n_rest + known_end).cast("long").alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score")
    )
