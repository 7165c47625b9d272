"""Gated recurrent language model in numpy with a class-factored output, trained by truncated backpropagation.

The corpus's training words are counted (all of them, in a shuffle). The most frequent ones, at most HEAD, are dealt by
frequency into CLASSES classes of WORDS; a class `middle` holds the next ones that are seen twice or more, a class
`rare` all others and unseen words. The network gives P(class | state), and within a head class P(word | class, state);
within `middle` and `rare` a word's share is its corpus count's with one added (and one unseen word in `rare`). These multiply to a distribution
over all words. Output biases start at the corpus's unigram, so training starts from the base model.

Scoring packs whole documents into lanes that step together; the state of a lane is carried from window to window until
its document ends, and set back where the next one begins. Frequent words' counts travel with the model (a bounded
table); rare words are joined with the full count table, and their logarithms summed by document.

Weights start from a sample of training documents (hash of the id; about SAMPLE_BYTES of text). From there every
partition passes once over all its training documents, long ones in windows with carried state, and the weights become
the partitions' mean by tokens. Every count, and so every class's mass and every word's share in it, is that of the
whole corpus.

Defined results: null and empty texts are one end token. Null ids count as the empty text for the held-out rule.
Repeated rows get equal results. Without training documents the base and the model see every word as unseen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, gathered, id_remainder, materialize, utf8

CLASSES, WORDS = 40, 40
HEAD = CLASSES * WORDS
#: Words whose counts travel with the model, at most, and their length in bytes, at most.
KNOWN, KNOWN_BYTES = 120_000, 64
HIDDEN = 24
ENDINGS = 512
SAMPLE_BYTES, SAMPLE_LONGEST = 3 << 20, 1 << 15
LANES, WINDOW = 256, 32
TRAIN_LANES, TRAIN_WINDOW, EPOCHS, RATE = 32, 20, 2, 0.006
#: The pass over all documents: lanes, least tokens of an update, rate; texts and bytes packed at once; numbers of a row
#: of weights on their way.
PASS_LANES, PASS_TOKENS, PASS_RATE, PASS_ROWS, PASS_BYTES, PIECE = 256, 4096, 0.006, 5000, 20 << 20, 1024
#: Rows of one key from which on they are summed in a product of their own.
LONG_RUN = 48
END = b"\n"
_BLANKS = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
LN10 = math.log(10)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_BLANKS).split() if text else []


def cut(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and how many each text has."""
    pieces = pc.split_pattern(pa.array([t.translate(_BLANKS) if t else b"" for t in texts], pa.binary()), b" ")
    flat, at = pieces.flatten(), pieces.offsets.to_numpy()
    good = pc.not_equal(pc.binary_length(flat), 0)
    n = np.add.reduceat(good.to_numpy(zero_copy_only=False), at[:-1] - at[0], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    return flat.filter(good), n


def _classes(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < HEAD, symbols // WORDS, symbols - HEAD + CLASSES).astype(np.uint8)


def _exponentials(scores: np.ndarray) -> np.ndarray:
    """Sums of exp of rows of scores, which become those exponentials. Scores are at most 0; rows that vanish are raised first."""
    low = np.flatnonzero(scores.max(axis=1) < -60) if scores.size and scores.min() < -60 else []
    if len(low):
        scores[low] -= scores[low].max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    return scores @ np.ones(scores.shape[1], scores.dtype)


class Vocabulary:
    """Symbols: 0 .. HEAD-1 head words (END among them), then middle, then rare; inputs add hashed endings of other words."""

    def __init__(self, counts: dict[bytes, int], total: int, distinct: int):
        order = sorted(counts, key=lambda w: (-counts[w], w))
        head = [END, *[w for w in order if w != END]][:HEAD]
        there = set(head)
        middle = [w for w in order if w not in there]
        self.middle = sum(counts[w] + 1 for w in middle)
        # A code is a head word's symbol, then a middle word's place, then an ending of the others.
        self.listed = pa.array([*head, *middle], pa.binary())
        self.places = np.concatenate([np.arange(len(head)), HEAD + np.arange(len(middle))])
        self.rare_from = HEAD + len(middle)
        self.symbols = np.concatenate([np.arange(HEAD), np.full(len(middle), HEAD), np.full(ENDINGS, HEAD + 1)]).astype(np.int16)
        self.inputs = np.concatenate([np.arange(HEAD), HEAD + endings(pa.array(middle, pa.binary())), HEAD + np.arange(ENDINGS)]).astype(np.int16)
        seen = np.zeros(self.rare_from + ENDINGS)
        seen[: len(head)] = [counts.get(w, 0) for w in head]
        seen[HEAD : self.rare_from] = [counts[w] for w in middle]
        self.known, self.logs = seen > 0, np.log10(seen + 1)
        self.within = np.zeros(len(seen))
        self.within[HEAD : self.rare_from] = np.log10((seen[HEAD : self.rare_from] + 1) / max(1, self.middle))
        # A training word of count 2 has been seen once elsewhere: to training it is what a word of count 1 is to scoring.
        self.taught = np.where((seen == 2) & (self.symbols == HEAD), HEAD + 1, self.symbols).astype(np.int16)
        self.rare_total = total - sum(counts.values())
        self.rare_distinct = distinct - len(counts)
        n = np.ones(HEAD)
        n[: len(head)] = [counts.get(w, 0) + 1 for w in head]
        n[len(head) :] = 1e-9
        grid = n.reshape(CLASSES, WORDS)
        self.class_bias = np.log(np.concatenate([grid.sum(axis=1), [self.middle + 1e-9, self.rare_total + self.rare_distinct + 1]])).astype(np.float32)
        self.word_bias = np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)
        self.rare_mass = math.log10(self.rare_total + self.rare_distinct + 1)
        self.base_mass = math.log10(total + distinct + 1)


def endings(words: pa.Array) -> np.ndarray:
    """A bucket of the last two bytes and the first one of each word; no word is empty."""
    if not len(words):
        return np.zeros(0, np.int64)
    at, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64), np.frombuffer(words.buffers()[2], np.uint8).astype(np.int64)
    size = np.diff(at)
    return (data[at[1:] - 1] * 31 + data[at[:-1] + (size - 2) % size] * 7 + data[at[:-1]] * 131) % ENDINGS


def sums_of_rows(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For each key from 0 to n - 1 the sum of its rows: the second rows of all keys at once, then the third ones, and so on."""
    order, size = np.argsort(keys.astype(np.int16), kind="stable"), np.bincount(keys, minlength=n)
    first, out = np.cumsum(size) - size, np.zeros((n, rows.shape[1]), rows.dtype)
    for k in np.flatnonzero(size > LONG_RUN).tolist():
        np.matmul(np.ones(size[k], rows.dtype), rows.take(order[first[k] : first[k] + size[k]], axis=0), out=out[k])
    short = np.flatnonzero((size > 0) & (size <= LONG_RUN))
    short = short[np.argsort(-size[short], kind="stable")]
    first, more = first[short], len(short) - np.cumsum(np.bincount(size[short], minlength=LONG_RUN + 1))
    sums = rows.take(order[first], axis=0)
    for k in range(1, LONG_RUN):
        if not (m := int(more[k])):
            break
        sums[:m] += rows.take(order[first[:m] + k], axis=0)
    out[short] = sums
    return out


class Network:
    """x: each input symbol's share of the three gates; u: the state's; c, cb: classes; w, wb: words in a class."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 0):
        rng, h = np.random.default_rng(seed), HIDDEN
        normal = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"x": normal(HEAD + ENDINGS, 3 * h), "u": normal(h, 3 * h), "c": normal(h, CLASSES + 2) * 0.1, "cb": vocabulary.class_bias.copy(), "w": normal(CLASSES, h, WORDS) * 0.1, "wb": vocabulary.word_bias.copy()}
        self.moments = None

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        """Of inputs (steps, lanes) their share of the gates, each gate's in one piece: (steps, 3, lanes, HIDDEN)."""
        return self.p["x"].reshape(-1, HIDDEN).take(inputs.astype(np.int32)[:, None] * 3 + np.arange(3, dtype=np.int32)[:, None], axis=0)

    def turns(self) -> np.ndarray:
        """The state's weights by gate, those of the first two with the sign that step() wants."""
        return self.p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2) * np.array([-1, -1, 1], np.float32)[:, None, None]

    @staticmethod
    def step(gates: np.ndarray, state: np.ndarray, turns: np.ndarray):
        """The next state and what the state gave to the third gate; gates (3, lanes, HIDDEN) become z, r and n."""
        zr, (z, r, n) = gates[:2], gates
        np.subtract(state @ turns[:2], zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        own = state @ turns[2]
        n += r * own
        np.tanh(n, out=n)
        new = state - n
        new *= z
        new += n
        return new, own

    def scores(self, hidden: np.ndarray, classes: np.ndarray, symbols: np.ndarray):
        """Of positions sorted by class: scores of classes and, of those in head classes, of the class's words, each less a
        bound that no state (within -1 and 1) can make them pass; where each class begins; the states with a 1 behind each."""
        p = self.p
        top = (p["cb"] + np.abs(p["c"]).sum(axis=0)).max()
        tops = (p["wb"] + np.abs(p["w"]).sum(axis=1)).max(axis=1)
        # The biases are the weights of a last input that is 1.
        ones = np.ones((len(hidden), HIDDEN + 1), np.float32)
        ones[:, :HIDDEN] = hidden
        outer = ones @ np.vstack([p["c"], p["cb"] - top])
        within = np.concatenate([p["w"], (p["wb"] - tops[:, None])[:, None]], axis=1)
        cuts = np.searchsorted(classes, np.arange(CLASSES + 1)).tolist()
        inner = np.empty((cuts[-1], WORDS), np.float32)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                np.matmul(ones[a:b], within[k], out=inner[a:b])
        return outer, inner, cuts, ones

    def logs(self, hidden: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """ln P of each symbol (a head word, HEAD for middle, HEAD + 1 for rare) given its state."""
        classes = _classes(symbols)
        order = np.argsort(classes, kind="stable")
        classes, symbols = classes[order], symbols[order]
        outer, inner, cuts, _ = self.scores(hidden.take(order, axis=0), classes, symbols)
        rows, head = np.arange(len(symbols)), cuts[-1]
        found = outer[rows, classes]
        words = inner[rows[:head], symbols[:head] % WORDS]
        with np.errstate(divide="ignore"):
            found -= self._log_sums(outer)
            found[:head] += words - self._log_sums(inner)
        out = np.empty(len(symbols))
        out[order] = found
        return out

    @staticmethod
    def _log_sums(scores: np.ndarray) -> np.ndarray:
        low = np.flatnonzero(scores.max(axis=1) < -60) if scores.size and scores.min() < -60 else []
        tops = scores[low].max(axis=1) if len(low) else 0
        out = np.log(_exponentials(scores))
        if len(low):
            out[low] += tops
        return out

    def train_window(self, inputs, symbols, fresh, mask, state):
        """Forward and truncated backward over arrays (steps, lanes); returns gradients and the last state."""
        p, h, (steps, lanes) = self.p, HIDDEN, inputs.shape
        gates, turns = self.gates(inputs), self.turns()
        before, hidden, own = (np.empty((steps, lanes, h), np.float32) for _ in range(3))
        starts, keep = fresh.any(axis=1), (~fresh).astype(np.float32)[:, :, None]
        for t in range(steps):
            if starts[t]:
                state = state * keep[t]
            before[t] = state
            state, own[t] = self.step(gates[t], state, turns)
            hidden[t] = state
        z, r, n = gates[:, 0], gates[:, 1], gates[:, 2]
        flat = mask.ravel()
        target = symbols.ravel()
        classes = np.where(flat, _classes(target), CLASSES + 2).astype(np.uint8)
        order = np.argsort(classes, kind="stable")[: int(flat.sum())]
        classes, target = classes[order], target[order]
        outer, inner, cuts, seen = self.scores(hidden.reshape(-1, h).take(order, axis=0), classes, target)
        rows, head = np.arange(len(order)), cuts[-1]
        outer /= _exponentials(outer)[:, None]
        outer[rows, classes] -= 1
        inner /= _exponentials(inner)[:, None]
        inner[rows[:head], target[:head] % WORDS] -= 1
        top, inside = seen.T @ outer, np.zeros((CLASSES, h + 1, WORDS), np.float32)
        pull = outer @ p["c"].T
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if a < b:
                np.matmul(seen[a:b].T, inner[a:b], out=inside[k])
                pull[a:b] += inner[a:b] @ p["w"][k].T
        g = {"c": top[:h], "cb": top[h], "w": inside[:, :h].copy(), "wb": inside[:, h].copy()}
        back = np.zeros((steps * lanes, h), np.float32)
        back[order] = pull
        back = back.reshape(steps, lanes, h)
        # What does not depend on the flow from later steps, for all steps at once.
        by_n, by_z, by_r = (1 - z) * (1 - n * n), (before - n) * z * (1 - z), own * r * (1 - r)
        d_own, d_n = np.empty((steps, lanes, 3 * h), np.float32), np.empty((steps, lanes, h), np.float32)
        flow, turned = np.zeros((lanes, h), np.float32), np.ascontiguousarray(p["u"].T)
        for t in range(steps - 1, -1, -1):
            flow += back[t]
            np.multiply(flow, by_n[t], out=d_n[t])
            np.multiply(flow, by_z[t], out=d_own[t, :, :h])
            np.multiply(d_n[t], by_r[t], out=d_own[t, :, h : 2 * h])
            np.multiply(d_n[t], r[t], out=d_own[t, :, 2 * h :])
            flow *= z[t]
            flow += d_own[t] @ turned
            if starts[t]:
                flow *= keep[t]
        g["u"] = before.reshape(-1, h).T @ d_own.reshape(-1, 3 * h)
        d_own[:, :, 2 * h :] = d_n
        g["x"] = sums_of_rows(d_own.reshape(-1, 3 * h), inputs.ravel(), len(p["x"]))
        return g, state

    def update(self, g: dict, n: int, rate: float) -> None:
        """Adam."""
        if self.moments is None:
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
            self.time = 0
        self.time += 1
        norm = math.sqrt(sum(float(np.vdot(v, v)) for v in g.values())) / max(1, n)
        scale = np.float32(1 / max(1, n) * min(1, 1 / max(norm, 1e-9)))
        fix1, fix2 = 1 - 0.9**self.time, 1 - 0.99**self.time
        for k, v in g.items():
            v *= scale
            m, s = self.moments[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * v
            v *= v
            s *= np.float32(0.99)
            s += np.float32(0.01) * v
            np.sqrt(s, out=v)
            v *= np.float32(1 / math.sqrt(fix2))
            v += np.float32(1e-8)
            np.divide(m, v, out=v)
            v *= np.float32(rate / fix1)
            self.p[k] -= v


class Coded:
    """Texts as codes: `flat` with the end after each text's words, `at` where each text begins in it, and its parts in `docs`."""

    def __init__(self, v: Vocabulary, texts: list[bytes | None]):
        words, self.n = cut(texts)
        found = pc.index_in(words, value_set=v.listed)
        far = found.is_null()
        self.far, self.rare_words = np.flatnonzero(far.to_numpy(zero_copy_only=False)), words.filter(far)
        own = v.places[found.fill_null(0).to_numpy()]
        own[self.far] = v.rare_from + endings(self.rare_words)
        self.at = np.cumsum(self.n + 1) - self.n - 1
        self.flat = np.zeros(len(own) + len(texts), np.int32)
        inner = np.ones(len(self.flat), bool)
        inner[self.at + self.n] = False
        self.flat[inner] = own
        # The end has code 0.
        self.docs = np.split(self.flat, self.at[1:]) if texts else []

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each text, the sum of its codes' values."""
        return np.add.reduceat(values[self.flat], self.at) if len(self.at) else np.zeros(0)

    def rare(self, first: int) -> tuple[pa.Array, pa.Array]:
        """Each rare word with the places of the texts that hold it, counted from first, once for each time."""
        coded = self.rare_words.dictionary_encode()
        numbers, owner = coded.indices.to_numpy(), first + np.repeat(np.arange(len(self.n)), self.n)[self.far]
        order = np.argsort(numbers, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=len(coded.dictionary)))])
        return coded.dictionary, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(owner[order], pa.int64()))


def packed(docs: list[np.ndarray], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first to the shortest lane; lanes by falling length."""
    import heapq

    heap = [(0, k) for k in range(max(1, min(lanes, len(docs))))]
    out: list[list[int]] = [[] for _ in heap]
    size = [0] * len(heap)
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        n, k = heapq.heappop(heap)
        out[k].append(d)
        size[k] = n + len(docs[d])
        heapq.heappush(heap, (size[k], k))
    return [out[k] for k in sorted(range(len(out)), key=lambda k: -size[k])]


def streams(outs: list[np.ndarray], intos: list[np.ndarray], lanes: list[list[int]]):
    """Per lane: target symbols, input symbols (the one before; END at a start), starts, and the document of each."""
    for lane in lanes:
        target = np.concatenate([outs[d] for d in lane])
        sizes = np.array([len(outs[d]) for d in lane])
        starts = np.cumsum(sizes) - sizes
        feed = np.concatenate([np.zeros(1, np.int16), np.concatenate([intos[d] for d in lane])[:-1]])
        feed[starts] = 0
        fresh = np.zeros(len(target), bool)
        fresh[starts] = True
        yield target, feed, fresh, np.repeat(np.array(lane, np.int32), sizes)


def windows(lanes: list[tuple], step: int, reach: int = 16):
    """Tables (steps, lanes) of targets, inputs, starts and owners (-1: none) of successive windows, lanes by falling length.

    Tables are filled for `reach` windows at a time; lanes that have ended are left out.
    """
    sizes = np.array([len(x[0]) for x in lanes], np.int64)
    for base in range(0, int(sizes.max(initial=0)), step * reach):
        live, wide = int((sizes > base).sum()), min(step * reach, int(sizes[0]) - base)
        tables = [np.zeros((live, wide), t) for t in (np.int16, np.int16, bool, np.int32)]
        tables[3][:] = -1
        for k in range(live):
            for table, x in zip(tables, lanes[k], strict=True):
                part = x[base : base + wide]
                table[k, : len(part)] = part
        turned = [np.ascontiguousarray(t.T) for t in tables]
        for at in range(0, wide, step):
            there = int((sizes > base + at).sum())
            yield [t[at : at + step, :there] for t in turned]


def log_likelihoods(net: Network, outs: list[np.ndarray], intos: list[np.ndarray]) -> np.ndarray:
    """ln P of the symbols of each document."""
    result = np.zeros(len(outs))
    lanes = list(streams(outs, intos, packed(outs, LANES)))
    state = np.zeros((len(lanes), HIDDEN), np.float32)
    for target, feed, fresh, owner in windows(lanes, WINDOW):
        steps, live = target.shape
        state = state[:live]
        gates, turns = net.gates(feed), net.turns()
        keep, starts = (~fresh).astype(np.float32)[:, :, None], fresh.any(axis=1)
        hidden = np.empty((steps, live, HIDDEN), np.float32)
        for t in range(steps):
            if starts[t]:
                state = state * keep[t]
            hidden[t] = state = net.step(gates[t], state, turns)[0]
        own = owner.ravel()
        good = own >= 0
        logs = net.logs(hidden.reshape(-1, HIDDEN)[good], target.ravel()[good])
        result += np.bincount(own[good], logs, len(outs))
    return result


def train(texts: list[bytes], v: Vocabulary, *, epochs: int = EPOCHS, rate: float = RATE) -> Network:
    net, found = Network(v), Coded(v, texts).docs
    outs, intos = [v.taught[c] for c in found], [v.inputs[c] for c in found]
    rng = np.random.default_rng(1)
    total, done = epochs * sum(map(len, outs)), 0
    for _ in range(epochs):
        order = rng.permutation(len(outs)).tolist()
        count = min(TRAIN_LANES, len(order))
        lanes = sorted(streams(outs, intos, [order[k::count] for k in range(count)]), key=lambda x: -len(x[0])) if count else []
        state = np.zeros((len(lanes), HIDDEN), np.float32)
        for target, feed, fresh, owner in windows(lanes, TRAIN_WINDOW):
            mask = owner >= 0
            n = int(mask.sum())
            grads, state = net.train_window(feed, target, fresh, mask, state[: target.shape[1]])
            net.update(grads, n, rate * max(0.05, 1 - done / total))
            done += n
    net.moments = None
    return net


def pass_over(net: Network, outs: list[np.ndarray], intos: list[np.ndarray], rate: float) -> int:
    """One pass of updates over all symbols of the documents; how many they are."""
    lanes = list(streams(outs, intos, packed(outs, PASS_LANES))) if outs else []
    state = np.zeros((len(lanes), HIDDEN), np.float32)
    held, n, total = None, 0, 0
    for target, feed, fresh, owner in windows(lanes, TRAIN_WINDOW):
        mask = owner >= 0
        grads, state = net.train_window(feed, target, fresh, mask, state[: target.shape[1]])
        held = grads if held is None else {k: g + grads[k] for k, g in held.items()}
        n += int(mask.sum())
        if n >= PASS_TOKENS:
            net.update(held, n, rate)
            total += n
            held, n = None, 0
    if n:
        net.update(held, n, rate * n / PASS_TOKENS)
    return total + n


def taught(docs: DataFrame, start, text_col: str = "text") -> dict | None:
    """Weights after a pass over all docs from those of start, a broadcast (vocabulary, network): each partition's, averaged by tokens."""
    bound_batches(docs.sparkSession)
    fields, names = "piece int, tokens long, part binary", ["piece", "tokens", "part"]

    def send(pieces, tokens, parts):
        return pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array(tokens, pa.int64()), pa.array(parts, pa.binary())], names=names)

    def run(batches):
        v, first = start.value
        net, tokens = Network(v), 0
        net.p = {k: w.copy() for k, w in first.p.items()}
        for batch in gathered(batches, PASS_ROWS, PASS_BYTES):
            found = Coded(v, utf8(batch, text_col)).docs
            tokens += pass_over(net, [v.taught[c] for c in found], [v.inputs[c] for c in found], PASS_RATE)
        if tokens:
            flat = np.concatenate([w.ravel() for w in net.p.values()]).astype(np.float64) * tokens
            parts = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
            yield send(range(len(parts)), [tokens] * len(parts), parts)

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for piece, tokens, part in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                n, x = sums.get(piece, (0, 0.0))
                sums[piece] = n + tokens, x + np.frombuffer(part)
        if sums:
            yield send(list(sums), [n for n, _ in sums.values()], [x.tobytes() for _, x in sums.values()])

    rows = docs.select(text_col).mapInArrow(run, fields).repartition("piece").mapInArrow(add, fields).collect()
    if not rows:
        return None
    flat, at, out = np.concatenate([np.frombuffer(r.part) / r.tokens for r in sorted(rows, key=lambda r: r.piece)]), 0, {}
    for k, w in start.value[1].p.items():
        out[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
        at += w.size
    return out


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all tokens of docs, END once a row; counted before the shuffle."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in gathered(batches, PASS_ROWS, PASS_BYTES):
            words, n = cut(utf8(batch, text_col))
            found = words.value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([found.field("counts"), pa.array([len(n)], pa.int64())])], names=["word", "n"])

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words of count t or more, for the least t (a step of a fine logarithmic scale) that leaves at most `most`; none of count 1 but END, always."""
    short = counts.where((F.octet_length("word") <= KNOWN_BYTES) & ((F.col("n") > 1) | (F.col("word") == END)))
    level = F.floor(F.log2("n") * 16).cast("int")
    steps = {r.level: r.n for r in short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = None, 0
    for s in sorted(steps, reverse=True):
        if held + steps[s] > most:
            break
        least, held = s, held + steps[s]
    kept = F.lit(False) if least is None else level >= least
    return {bytes(r.word): r.n for r in short.where(kept | (F.col("word") == END)).collect()}


_held: dict = {}
SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_rare long"


def score_documents(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (id_remainder(id_col, 7) == 2).alias("held_out"))
    seen = docs.where("NOT held_out")
    counts = materialize(count_words(seen, "text"), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    v = Vocabulary(frequent(counts, KNOWN), total, distinct)
    size, longest = F.octet_length("text"), SAMPLE_LONGEST
    there = seen.where(size <= longest).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    share = min(1.0, SAMPLE_BYTES / max(1, there))
    drawn = seen.where((size <= longest) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)))
    sample = sorted(bytes(r.text) for r in drawn.select(F.col("text").cast("binary")).collect())
    net = train(sample, v)
    start = spark.sparkContext.broadcast((v, net))
    net.p = taught(seen, start) or net.p
    start.unpersist()
    broadcast = spark.sparkContext.broadcast((v, net))
    scored = materialize(_scored(docs, broadcast), "scored")
    found = scored.where("word IS NOT NULL").select("word", "docs").join(counts, "word", "left").select(F.explode("docs").alias("uid"), F.coalesce("n", F.lit(0)).alias("c"))
    sums = found.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("logs"), F.sum((F.col("c") > 0).cast("long")).alias("known"))
    rows = scored.where("word IS NULL").join(sums, "uid", "left")
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * v.base_mass).alias("base_score"), (F.col("score") + logs - F.col("n_rare") * v.rare_mass).alias("score"),
    )


def _scored(docs: DataFrame, broadcast) -> DataFrame:
    """A row for each document, without its rare words' logarithms, and a row for each rare word with its documents."""
    bound_batches(docs.sparkSession)
    names = [f.split(" ")[0] for f in SCORED.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        key = broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else id(broadcast.value)
        if key not in _held:
            _held.clear()
            _held[key] = broadcast.value
        v, net = _held[key]
        uid = TaskContext.get().partitionId() << 33
        for batch in gathered(batches, PASS_ROWS, PASS_BYTES):
            got = Coded(v, utf8(batch, "text"))
            ln, n = log_likelihoods(net, [v.symbols[c] for c in got.docs], [v.inputs[c] for c in got.docs]), len(got.n)
            known, base, score, far = got.sums(v.known.astype(np.int64)), got.sums(v.logs), ln / LN10 + got.sums(v.within), got.sums((np.arange(len(v.known)) >= v.rare_from).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + n)), batch.column("doc_id"), batch.column("held_out"), *map(pa.array, (got.n + 1, known, base, score, far)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))],
                names=[*names, "word", "docs"],
            )
            words, where = got.rare(uid)
            uid += n
            if m := len(words):
                empty = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*empty, words, where], names=[*names, "word", "docs"])

    return docs.mapInArrow(run, SCORED + ", word binary, docs array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
