"""A gated recurrent language model trained and applied by Spark tasks.

Exact word counts come from the whole training corpus. The words above a frequency that falls
with the corpus's size get places of their own in a gated recurrent network with a class-factored
softmax; the others share one place and are told apart by their counts. Texts become places once,
in a written table. Training is truncated backpropagation in numpy: in each round every task
trains on its documents from common parameters, and the results are averaged by tokens. Training
and scoring carry the state across windows, so a score covers all words of a document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.common import ROW, crc_mod, keyed_rows, materialise

END = b""  # no word is empty
NEW = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
OWN = "__lm_"  # begins the names of the columns that ``encode`` adds
OTHER = 1  # place of the words without one of their own; 0 is the end of a text
EMBED, HIDDEN, WINDOW = 16, 24, 32
CLASSES, PLACES = 48, 4096  # at least, with so many words
SHARE = 16  # a word of a frequency of 1 / (SHARE * sqrt(all tokens)) or more has a place
STRETCH = 32_768  # weights that are added up as one
CHUNK = 1024  # tokens whose class scores are worked on at a time, so that they stay in the cache
AT_ONCE = 16_384  # tokens whose probabilities are found together where no gradient is needed
TOKENS_A_WEIGHT = 4  # of a trainer at least, so that the networks that are averaged stay small against the texts
WAYS = 64  # of adding networks up side by side
BY_ROW = (0, 5)  # weights whose rows go by their own gradients: the embedding and the words' output
ROW_PACE = 20  # the rate of rows that go by their own gradients, as a multiple of Adam's


class Words:
    """The words of a column of texts, between ASCII white space and with A-Z lowered, and where each text's begin."""

    def __init__(self, column: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
        self.flat, self.starts = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        self.starts -= self.starts[0]
        empty = pc.equal(pc.binary_length(self.flat), 0)  # before leading and after trailing white space
        if pc.any(empty).as_py():
            full = pc.invert(empty)
            self.starts = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][self.starts]
            self.flat = self.flat.filter(full)

    def places(self, known: pa.Array) -> np.ndarray:
        """Position of each word among the known ones, or -1."""
        return pc.fill_null(pc.index_in(self.flat, value_set=known), -1).to_numpy(zero_copy_only=False)


class Lanes:
    """Texts laid end to end in parallel lanes of about equal length, the state reset where one begins.

    Lanes stand in the order of their lengths, so that those still running come first.
    """

    def __init__(self, texts: list[np.ndarray], count: int):
        whole = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        count = max(1, min(count, len(whole)))
        heap = [(0, k) for k in range(count)]
        dealt: list[list[int]] = [[] for _ in range(count)]
        for i in whole:
            length, k = heapq.heappop(heap)
            dealt[k].append(i)
            heapq.heappush(heap, (length + len(texts[i]) + 1, k))
        order = sorted(heap, reverse=True)
        self.lengths = np.array([n for n, _ in order])
        self.steps, self.count = int(self.lengths[0]), count
        self.inputs = np.zeros((count, self.steps), np.int32)
        self.targets = np.zeros((count, self.steps), np.int32)
        self.keep = np.ones((count, self.steps), np.float32)
        self.text = np.full((count, self.steps), len(texts), np.int32)  # len(texts): filling
        for lane, (_, k) in enumerate(order):
            at = 0
            for i in dealt[k]:
                n = len(texts[i])
                self.inputs[lane, at + 1 : at + n + 1] = texts[i]
                self.targets[lane, at : at + n] = texts[i]
                self.keep[lane, at] = 0
                self.text[lane, at : at + n + 1] = i
                at += n + 1

    def windows(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Each window of the lanes still running, first the lanes, then as (steps, lanes) inputs, targets, what keeps the state (steps, 1, lanes) and the texts."""
        for t in range(0, self.steps, WINDOW):
            live = slice(0, int(np.count_nonzero(self.lengths > t)))
            inputs, targets, keep, text = (np.ascontiguousarray(x[live, t : t + WINDOW].T) for x in (self.inputs, self.targets, self.keep, self.text))
            yield live, inputs, targets, keep[:, None], text


class Network:
    """Embedding, gated recurrent layer, and a softmax over classes and then over a class's words.

    Weights: embedding, the layer's input, recurrent and bias weights, and the output weights of
    classes and of words, whose last column is the bias (a state's last entry is 1).
    """

    def __init__(self, weights: list[np.ndarray], class_of: np.ndarray, starts: np.ndarray):
        self.weights = weights
        self.class_of, self.starts = class_of, starts  # output weights stand in the order of classes

    @staticmethod
    def begin(counts: np.ndarray, seed: int = 11) -> Network:
        """Small random weights; output biases that give the words' own frequencies."""
        rng = np.random.default_rng(seed)
        order = np.argsort(-counts, kind="stable")
        root = np.sqrt(counts[order] / counts.sum())
        # about as many classes as a token's class then has words, which makes the fewest scores a token
        classes = max(CLASSES, round(0.6 * len(counts) ** 0.5))
        binned = np.minimum((np.cumsum(root) - root) / root.sum() * classes, classes - 1).astype(np.int64)
        binned = np.unique(binned, return_inverse=True)[1]
        class_of = np.empty(len(counts), np.int64)
        class_of[order] = binned
        mass = np.bincount(class_of, weights=counts)
        n, c = len(counts), len(mass)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        bias = np.zeros(3 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1.0
        by_class = np.argsort(class_of, kind="stable")
        class_w, word_w = np.zeros((c, HIDDEN + 1), np.float32), np.zeros((n, HIDDEN + 1), np.float32)
        class_w[:, -1] = np.log(mass / mass.sum())
        word_w[:, -1] = np.log(counts / mass[class_of])[by_class]
        weights = [normal(0.1, n, EMBED), normal(EMBED**-0.5, EMBED, 3 * HIDDEN), normal(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN), bias, class_w, word_w]
        return Network(weights, class_of, np.searchsorted(np.sort(class_of), np.arange(c + 1)))

    def prepared(self) -> Network:
        """Number the places by class, so that a class's words lie together in the output weights."""
        self.rank = np.empty(len(self.class_of), np.int64)
        self.rank[np.argsort(self.class_of, kind="stable")] = np.arange(len(self.class_of))
        self.rank_class = np.sort(self.class_of)
        return self

    def run(self, inputs: np.ndarray, keep: np.ndarray, state: np.ndarray, trace: bool = False):
        """States after each step (steps, HIDDEN, lanes), the last one, and, to train, what the steps computed.

        Lanes are the last axis, so that a step's operations run over unbroken memory.
        """
        embed = self.weights[0]
        steps, lanes = inputs.shape
        one, two, three = HIDDEN, 2 * HIDDEN, 3 * HIDDEN
        given, joined = embed.take(inputs, axis=0), self.joined()
        joined[:two] *= -1  # a gate is 1 / (1 + exp(-x))
        out = np.empty((steps, HIDDEN, lanes), embed.dtype)
        kept = np.empty((steps if trace else 1, 4 * HIDDEN, lanes), embed.dtype)
        fed = np.ones((steps if trace else 1, EMBED + HIDDEN + 1, lanes), embed.dtype)
        begins = self.beginnings(keep)
        for t in range(steps):
            k, f = kept[t if trace else 0], fed[t if trace else 0]
            f[:EMBED] = given[t].T
            before = f[EMBED:-1]
            if begins[t]:
                np.multiply(state, keep[t], out=before)
            else:
                before[:] = state
            np.dot(joined, f, out=k)
            gates, new, state = k[:two], k[two:three], out[t]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[:one], k[three:], out=state)
            new += state
            np.tanh(new, out=new)
            np.subtract(before, new, out=state)
            state *= gates[one:]
            state += new
        return out, state.copy(), (kept, fed)

    def joined(self) -> np.ndarray:
        """The layer's weights as one matrix over a word's vector, the state and a 1: those of both gates, then what the word and what the state gives to the new state."""
        _, into, recur, bias, *_ = self.weights
        two, three = 2 * HIDDEN, 3 * HIDDEN
        out = np.zeros((4 * HIDDEN, EMBED + HIDDEN + 1), into.dtype)
        out[:three, :EMBED], out[:three, -1] = into.T, bias
        out[:two, EMBED:-1], out[three:, EMBED:-1] = recur[:, :two].T, recur[:, two:].T
        return out

    @staticmethod
    def beginnings(keep: np.ndarray) -> list[bool]:
        """Whether a text begins in any lane, for each step."""
        return (keep == 0).any(axis=(1, 2)).tolist()

    @staticmethod
    def by_token(states: np.ndarray) -> np.ndarray:
        """(steps, HIDDEN, lanes) as one row for each token, with a 1 at its end."""
        steps, hidden, lanes = states.shape
        out = np.ones((steps, lanes, hidden + 1), states.dtype)
        out[:, :, :-1] = states.transpose(0, 2, 1)
        return out.reshape(-1, hidden + 1)

    def steepest(self) -> float:
        """No score exceeds this, as states lie within -1 and 1."""
        return max(float(np.abs(w).sum(axis=1).max()) for w in self.weights[4:])

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray, weight: np.ndarray | None = None, steep: bool = True):
        """Natural log probability of each target.

        With ``weight`` of each token also the gradients of the weighted loss: of the states (and of
        their last 1), of the classes' weights, of some rows of the words' weights, and which rows.
        ``steep``: scores might overflow and are clipped.
        """
        class_w, word_w = self.weights[4:]
        target = self.rank.take(targets)
        order = np.argsort(target.astype(np.uint16) if len(word_w) <= 1 << 16 else target, kind="stable")  # by class, then by word
        states, target = states.take(order, axis=0), target.take(order)
        kind = self.rank_class.take(target)
        count, dtype = len(target), states.dtype
        sizes = np.diff(self.starts)
        ends = np.searchsorted(kind, np.arange(len(self.starts)))
        present = np.flatnonzero((np.diff(ends) > 0) & (sizes > 1))
        of_class, of_word, total, within = np.empty(count, dtype), np.zeros(count, dtype), np.empty(count, dtype), np.ones(count, dtype)
        own = (np.arange(count) - ends[kind]) * sizes[kind] + target - self.starts[kind]  # place of a target's score among its class's
        if weight is not None:
            weight, back = weight.take(order), np.zeros_like(states)
            rows, first = self.rows_of(present), 0
            word_grad = np.zeros((rows.stop - rows.start if isinstance(rows, slice) else len(rows), HIDDEN + 1), dtype)
        ones = np.ones(int(sizes.max(initial=1)), dtype)
        room = np.empty(int(max((np.diff(ends) * sizes)[present], default=0)), dtype)
        for lo, hi, a, b in zip(*(x.tolist() for x in (self.starts[present], self.starts[present + 1], ends[present], ends[present + 1])), strict=True):
            flat, seen, w, at = room[: (b - a) * (hi - lo)], states[a:b], word_w[lo:hi], own[a:b]
            scores = np.dot(seen, w.T, out=flat.reshape(b - a, hi - lo))
            if steep:
                np.minimum(scores, 60, out=scores)
            of_word[a:b] = flat.take(at)
            np.exp(scores, out=scores)
            np.dot(scores, ones[: hi - lo], out=within[a:b])
            if weight is not None:
                scores *= (weight[a:b] / within[a:b])[:, None]
                flat[at] -= weight[a:b]  # what is left is the gradient of the scores
                if isinstance(rows, slice):
                    first = lo - rows.start
                np.dot(scores.T, seen, out=word_grad[first : first + hi - lo])
                first += hi - lo
                np.dot(scores, w, out=back[a:b])
        ones, class_grad, starts = np.ones(len(class_w), dtype), np.zeros_like(class_w), np.arange(CHUNK) * len(class_w)
        for a in range(0, count, CHUNK):
            some = slice(a, min(a + CHUNK, count))
            scores = states[some] @ class_w.T
            if steep:
                np.minimum(scores, 60, out=scores)
            flat, at = scores.reshape(-1), starts[: len(scores)] + kind[some]
            of_class[some] = flat.take(at)
            np.exp(scores, out=scores)
            np.dot(scores, ones, out=total[some])
            if weight is not None:
                scores *= (weight[some] / total[some])[:, None]
                flat[at] -= weight[some]
                class_grad += scores.T @ states[some]
                back[some] += np.dot(scores, class_w)
        found = of_class + of_word
        found -= np.log(total)
        found -= np.log(within)
        out = np.empty(count, dtype)
        out[order] = found
        if weight is None:
            return out
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        return out, back.take(place, axis=0), class_grad, word_grad, rows

    def rows_of(self, classes: np.ndarray) -> slice | np.ndarray:
        """The words' rows of some classes; if few are missing between them, a slice of all from first to last, which is updated far faster."""
        if not len(classes):
            return np.empty(0, np.int64)
        lo, hi = int(self.starts[classes[0]]), int(self.starts[classes[-1] + 1])
        if 8 * (self.starts[classes + 1] - self.starts[classes]).sum() >= 7 * (hi - lo):
            return slice(lo, hi)
        return np.concatenate([np.arange(self.starts[c], self.starts[c + 1]) for c in classes])

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, real: np.ndarray, state: np.ndarray, steep: bool = True):
        """Gradients of a window's mean loss, by backpropagation to its first step; the rows of each; the state after it.

        Rows are those that the window touches of the embedding and of the words' weights, so that
        a step's work follows its words.
        """
        embed = self.weights[0]
        steps, lanes = inputs.shape
        states, state, (kept, fed) = self.run(inputs, keep, state, True)
        weight = (real / max(1, real.sum())).astype(embed.dtype).reshape(-1)
        _, back, class_grad, word_grad, rows = self.log_likelihood(self.by_token(states), targets.reshape(-1), weight, steep)
        back = np.ascontiguousarray(back.reshape(steps, lanes, HIDDEN + 1)[:, :, :-1].transpose(0, 2, 1))
        one, two, three = HIDDEN, 2 * HIDDEN, 3 * HIDDEN
        d_all = np.empty((4 * HIDDEN, lanes), embed.dtype)  # of what ``joined`` gives
        joined = np.ascontiguousarray(self.joined().T[:-1])
        joined_grad = np.zeros((EMBED + HIDDEN + 1, 4 * HIDDEN), embed.dtype)
        each = np.empty((EMBED, steps, lanes), embed.dtype)
        fed_back = np.zeros((EMBED + HIDDEN, lanes), embed.dtype)
        later = fed_back[EMBED:]
        begins = self.beginnings(keep)
        d_r, d_z, d_new, d_pulled = d_all[:one], d_all[one:two], d_all[two:three], d_all[three:]
        for t in range(steps - 1, -1, -1):
            k = kept[t]
            r, z, new, pulled = k[:one], k[one:two], k[two:three], k[three:]
            d = back[t]
            d += later
            np.multiply(new, new, out=d_new)
            np.subtract(1, d_new, out=d_new)
            d_new *= d
            through = d * z
            np.subtract(fed[t, EMBED:-1], new, out=d_z)
            d_z *= through
            rest = 1 - z
            d_z *= rest
            d_new *= rest
            np.multiply(d_new, r, out=d_pulled)
            np.multiply(d_pulled, pulled, out=d_r)
            np.subtract(1, r, out=rest)
            d_r *= rest
            joined_grad += fed[t] @ d_all.T
            np.dot(joined, d_all, out=fed_back)
            each[:, t] = fed_back[:EMBED]
            later += through
            if begins[t]:
                later *= keep[t]
        # each word's gradient is added up over its occurrences
        ids = inputs.reshape(-1)
        number = np.zeros(len(embed), np.int64)
        number[ids] = 1
        given = np.flatnonzero(number)
        number[given] = np.arange(len(given))
        number = number.take(ids)
        embed_grad = np.ascontiguousarray(np.array([np.bincount(number, x, len(given)) for x in each.reshape(EMBED, -1)], embed.dtype).T)
        recur_grad = np.concatenate([joined_grad[EMBED:-1, :two], joined_grad[EMBED:-1, three:]], axis=1)
        return [embed_grad, joined_grad[:EMBED, :three], recur_grad, joined_grad[-1, :three], class_grad, word_grad], [given, *[slice(None)] * 4, rows], state

    def train(self, texts: list[np.ndarray], moments: list[list[np.ndarray]], step: list[int], rate: float) -> int:
        """Descend over all windows of the texts; the number of tokens.

        The layer and the classes take Adam steps; a row of the embedding or of a word's weights
        goes by the mean square of its own gradients so far.
        """
        size = sum(len(x) + 1 for x in texts)
        lanes = Lanes(texts, int(np.clip(size // max(4096, *(len(x) + 1 for x in texts)), 8, 384)))  # all about as long as the longest text
        state = np.zeros((HIDDEN, lanes.count), np.float32)
        steep = True
        for live, inputs, targets, keep, text in lanes.windows():
            if step[0] % 8 == 0:
                steep = self.steepest() > 30
            grads, rows, state = self.gradients(inputs, targets, keep, text < len(texts), state[:, live], steep)
            squares = [np.dot(g * g, np.ones(g.shape[1], g.dtype)) if i in BY_ROW else np.vdot(g, g) for i, g in enumerate(grads)]
            norm = float(np.sqrt(sum(float(x.sum()) for x in squares)))
            clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            step[0] += 1
            warm = rate * min(1.0, step[0] / 20)
            scale = np.float32(warm * np.sqrt(1 - 0.99 ** step[0]) / (1 - 0.9 ** step[0]))
            for i, (w, g, k, m, v) in enumerate(zip(self.weights, grads, rows, *moments, strict=True)):
                if i in BY_ROW:
                    seen = m[k] + squares[i] * (clip * clip / np.float32(g.shape[1]))
                    m[k] = seen
                    g *= (np.float32(ROW_PACE * warm) * clip / (np.sqrt(seen) + np.float32(1e-7)))[:, None]
                    w[k] -= g
                else:
                    g *= clip
                    m += np.float32(0.1) * (g - m)
                    v += np.float32(0.01) * (g * g - v)
                    w -= scale * m / (np.sqrt(v) + np.float32(1e-7))
        return size

    def blank_moments(self) -> list[list[np.ndarray]]:
        """Zeros that ``train`` keeps its averages in."""
        by_row = lambda i, w: np.zeros(len(w) if i in BY_ROW else w.shape, w.dtype)
        return [[by_row(i, w) for i, w in enumerate(self.weights)] for _ in range(2)]

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each whole text."""
        if not texts:
            return np.empty(0)
        lanes = Lanes(texts, int(np.clip(sum(len(x) + 1 for x in texts) // max(1024, *(len(x) + 1 for x in texts)), 1, 384)))
        state, out = np.zeros((HIDDEN, lanes.count), np.float32), np.zeros(len(texts) + 1)
        steep = self.steepest() > 60
        held, size, steps = [], 0, 0
        for live, inputs, targets, keep, text in lanes.windows():
            states, state, _ = self.run(inputs, keep, state[:, live])
            held.append((self.by_token(states), targets.reshape(-1), text.reshape(-1)))
            size, steps = size + text.size, steps + len(text)
            if size >= AT_ONCE or steps == lanes.steps:
                states, targets, which = (np.concatenate(x) for x in zip(*held, strict=True))
                real = np.flatnonzero(which < len(texts))
                found = self.log_likelihood(states.take(real, axis=0), targets.take(real), steep=steep)
                out += np.bincount(which.take(real), weights=found, minlength=len(texts) + 1)
                held, size = [], 0
        return out[:-1]


class Corpus:
    """Word counts of the training texts: totals and frequent words at hand, all words in a table.

    Words of at least ``least_placed`` occurrences have places: their number grows with the corpus,
    by the root of its tokens at most. ``unplaced_share`` is the share of tokens without a place.
    """

    def __init__(self, counts: DataFrame, frequent_share: int, most_places: int | None = None):
        self.counts = counts
        total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.total, self.distinct = int(total[0] or 0), int(total[1])
        # counts sum to the total, so at most frequent_share words have a frequency of 1/frequent_share
        self.least = max(1, -(-self.total // frequent_share))
        got = counts.where(F.col("n") >= self.least).orderBy(F.desc("n"), "word").toArrow()
        found = dict(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True))
        self.ends = found.pop(END, 0)
        if not self.ends:
            self.ends = (counts.where(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0]) or 0
        self.words = list(found)
        self.numbers = np.array(list(found.values()), np.int64)
        self.least_placed = max(self.least, -(-self.total // max(1, int(SHARE * self.total**0.5))))
        places = max(PLACES, int(np.count_nonzero(self.numbers >= self.least_placed)))
        self.placed = self.words[: places if most_places is None else min(places, most_places)]
        own = self.numbers[: len(self.placed)]
        # words without a place: each its count plus one, and one more for all that were never seen
        others = self.distinct - (self.ends > 0) - len(self.placed)
        self.other_mass = int(self.total - self.ends - own.sum()) + others + 1
        self.unplaced_share = float(self.total - self.ends - own.sum()) / max(1, self.total - self.ends)
        self.place_counts = np.concatenate([[self.ends + 1, self.other_mass], own]).astype(np.float64)

    def plain(self) -> dict:
        return {"words": b" ".join(self.words), "numbers": self.numbers, "placed": len(self.placed), "other_mass": self.other_mass, "ends": self.ends, "total": self.total, "distinct": self.distinct}


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts, the end of each text counted as the empty word; each batch summed first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.value_counts(Words(batch.column(0)).flat)
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([counts.field("values").cast(pa.binary()), counts.field("counts")], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(docs: DataFrame, corpus: Corpus, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A written table of ``docs`` (the columns ``carry``, all by default) with what training and scoring need.

    That is a row key, the places of each whole text's words and sums over its words' counts, so
    that texts are split and looked up once.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c not in NEW]
    shared = docs.sparkSession.sparkContext.broadcast(corpus.plain())
    own = {f"{OWN}places": pa.binary(), f"{OWN}tokens": pa.int64(), f"{OWN}known": pa.int64(), f"{OWN}base": pa.float64(), f"{OWN}other": pa.float64(), f"{OWN}rare": pa.list_(pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        known = pa.array(c["words"].decode().split(" ") if c["words"] else [], pa.string())
        logs = np.r_[np.log10(c["numbers"] + 1.0), 0.0]  # the last: words not at hand
        in_base, in_other = np.log10(c["total"] + c["distinct"] + 1.0), np.log10(float(c["other_mass"]))
        end_log = np.log10(c["ends"] + 1.0)
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                found = Words(batch.column(len(carried)))
                rows, id_ = batch.num_rows, found.places(known)
                n = np.diff(found.starts)
                whose = np.repeat(np.arange(rows, dtype=np.int32), n)
                have, unplaced = id_ >= 0, (id_ < 0) | (id_ >= c["placed"])
                log = logs[id_]
                total = lambda w, whose=whose, rows=rows: np.bincount(whose, weights=w, minlength=rows)
                place = np.where(unplaced, OTHER, id_ + 2).astype(np.int32)
                offsets = pa.array(4 * found.starts, pa.int32())
                places = pa.Array.from_buffers(pa.binary(), rows, [None, offsets.buffers()[1], pa.py_buffer(place)])
                rare = found.flat.filter(pa.array(~have)).cast(pa.binary())
                ends = np.r_[0, np.cumsum(np.bincount(whose[~have], minlength=rows))].astype(np.int32)
                columns = [places, pa.array(n + 1), pa.array(total(have).astype(np.int64) + (c["ends"] > 0)), pa.array(total(log) + end_log - (n + 1) * in_base), pa.array(total(np.where(unplaced, log - in_other, 0.0))), pa.ListArray.from_arrays(pa.array(ends), rare)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *columns], [*carried, *own])
            pa.default_memory_pool().release_unused()

    types = [T.BinaryType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.ArrayType(T.BinaryType())]
    schema = T.StructType([*(docs.schema[c] for c in carried), *(T.StructField(n, t) for n, t in zip(own, types, strict=True))])
    return keyed_rows(docs.select(*carried, F.col(text).alias(f"{OWN}text")).mapInArrow(run, schema))


def _place_lists(column: pa.Array, most: int = 3_000_000) -> Iterator[list[np.ndarray]]:
    """The texts of a column of places, in lists of about ``most`` words (or of a single longer text)."""
    some, held = [], 0
    for value in column:
        some.append(np.frombuffer(value.as_buffer(), np.int32))
        held += len(some[-1]) + 1
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def train_round(encoded: DataFrame, net: Network, rate: float, trainers: int) -> Network:
    """The token-weighted mean of the networks that at most ``trainers`` tasks train on their texts, from ``net``."""
    shared = encoded.sparkSession.sparkContext.broadcast((net.weights, net.class_of, net.starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, class_of, starts = shared.value
        own = Network([w.copy() for w in weights], class_of, starts).prepared()
        moments, step, size = own.blank_moments(), [0], 0
        for batch in batches:
            for texts in _place_lists(batch.column(0)):
                size += own.train(texts, moments, step, rate)
        if size:
            flat = np.concatenate([w.reshape(-1) for w in own.weights])
            parts = [flat[k : k + STRETCH].tobytes() for k in range(0, len(flat), STRETCH)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([size] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["part", "size", "mean"])

    def add(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        mean = sum(np.frombuffer(x.as_py(), np.float32) * (n / sum(sizes)) for x, n in zip(table["mean"], sizes, strict=True))
        return pa.table({"part": table["part"][:1], "size": pa.array([sum(sizes)], pa.int64()), "mean": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    schema = "part int, size long, mean binary"
    trained = encoded.select(f"{OWN}places").coalesce(trainers).mapInArrow(run, schema)
    # stretches of weights are added up apart, and many networks in two steps, so that no task sees all of them
    if trainers > WAYS:
        trained = trained.withColumn("way", F.spark_partition_id() % WAYS).groupBy("part", "way").applyInArrow(add, schema)
    mean = trained.groupBy("part").applyInArrow(add, schema)
    got = sorted((r["part"], r["size"], bytes(r["mean"])) for r in mean.collect())  # as large as one network
    if not got:
        return net
    flat = np.concatenate([np.frombuffer(x, np.float32) for _, _, x in got])
    ends = np.cumsum([w.size for w in net.weights])
    return Network([flat[end - w.size : end].reshape(w.shape) for w, end in zip(net.weights, ends, strict=True)], net.class_of, net.starts)


def train(encoded: DataFrame, corpus: Corpus, rounds: int = 3, rate: float = 0.01) -> Network:
    """A network trained on all texts of ``encoded``, each in one of the rounds.

    Each task of a round trains on its rows from common weights, so the weights depend on how the
    table is cut into tasks; every row is used whatever the cut. Tasks are joined until each has
    several tokens for each weight: the networks that a round shuffles stay below its texts.
    """
    net = Network.begin(corpus.place_counts)
    trainers = max(1, corpus.total // (rounds * TOKENS_A_WEIGHT * sum(w.size for w in net.weights)))
    for k in range(rounds):
        net = train_round(encoded.where(F.pmod(F.xxhash64(ROW), F.lit(rounds)) == k), net, rate * 0.5**k, trainers)
    return net


def count(docs: DataFrame, text: str = "text", most_places: int | None = 1_000_000, frequent_share: int = 2_000_000) -> Corpus:
    """The word counts of all texts of ``docs``, in a written table.

    ``most_places`` bounds the network (41 numbers a place, broadcast and held by each task); it is
    reached at some 10**12 tokens.
    """
    return Corpus(materialise(count_words(docs, text), "counts"), frequent_share, most_places)


def fit(docs: DataFrame, text: str = "text", most_places: int | None = 1_000_000, frequent_share: int = 2_000_000, rounds: int = 3, rate: float = 0.01) -> tuple[Corpus, Network]:
    """Count all words of ``docs`` and train a network on all its texts (see ``train``)."""
    corpus = count(docs, text, most_places, frequent_share)
    return corpus, train(encode(docs, corpus, text, []), corpus, rounds, rate)


def score_encoded(encoded: DataFrame, corpus: Corpus, net: Network) -> DataFrame:
    """What ``encode`` carried with the scores of ``score``."""
    shared = encoded.sparkSession.sparkContext.broadcast((net.weights, net.class_of, net.starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*shared.value).prepared()
        for batch in batches:
            found = [own.scores(texts) for texts in _place_lists(batch.column(1))]
            model = np.concatenate(found) / np.log(10) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model)], [ROW, "model"])

    model = encoded.select(ROW, f"{OWN}places").mapInArrow(run, f"{ROW} long, model double")
    # words too rare to be at hand were counted as unseen; the table of all counts makes up for it
    rare = encoded.select(ROW, F.explode(f"{OWN}rare").alias("word")).join(corpus.counts.where(F.col("n") < corpus.least).select("word", F.col("n").alias("c")), "word")
    more = rare.groupBy(ROW).agg(F.count(F.lit(1)).alias("seen"), F.sum(F.log10(F.col("c") + 1.0)).alias("gain"))
    gain = F.coalesce("gain", F.lit(0.0))
    own = [c for c in encoded.columns if c.startswith(OWN)]
    return (
        encoded.join(model, ROW)
        .join(more, ROW, "left")
        .withColumns({
            "n_tokens": F.col(f"{OWN}tokens"),
            "n_known": F.col(f"{OWN}known") + F.coalesce("seen", F.lit(0)),
            "train_tokens": F.lit(corpus.total).cast("long"),
            "base_score": F.col(f"{OWN}base") + gain,
            "score": F.col("model") + F.col(f"{OWN}other") + gain,
        })
        .drop(ROW, "model", "seen", "gain", *own)
    )


def score(docs: DataFrame, corpus: Corpus, net: Network, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score of each whole text.

    base_score: add-one unigram log10 probability. score: the network's log10 probability, over the
    same words: an unplaced word has the chance of its place times (c + 1) over the sum of those.
    Null and empty texts hold the end alone; repeated rows are rows of their own; columns of the
    new names are replaced. The rows are written with their keys first.
    """
    return score_encoded(encode(docs, corpus, text), corpus, net)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out remainder of the id's crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    corpus = count(docs.where(~held_out))
    encoded = encode(docs, corpus, carry=["doc_id"])
    scored = score_encoded(encoded, corpus, train(encoded.where(~held_out), corpus))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
