"""Distinct sampled segmentations into pieces by the Gumbel top-k trick, and decoding.

A text's lattice has its character positions as nodes and the vocabulary's pieces as edges. A
piece's probability follows its place in the vocabulary, as Zipf's law has it, for models whose
scores are merge ranks. Backward sums over the lattice give the mass of every node's
completions, so the perturbed value of the best completion below any prefix can be drawn without
visiting it. The search is A-star over prefixes: it always takes the prefix whose drawn value is
largest, follows it to a complete segmentation, and draws truncated Gumbel values for the
branches left behind, those of one segmentation as a single set until it is the best. Segmentations come out distinct and in order of their perturbed values;
the greatest value left over gives their inclusion probabilities.

No piece spans a change between letters, other characters and the start of white space, so the
lattice is a chain of small ones, which are shared by all texts of a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
ATOM = re.compile(r"▁*+[^\W\d_²]++|▁*+(?:(?!▁)[\W\d_²])++|▁++", re.S)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> tuple[list[str], int]:
    """(pieces by id, id of the byte piece of 0) of a SentencePiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    own = [p for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(len(ATOM.findall(p)) != 1 for p in own):
        whole = [p for p in own if len(ATOM.findall(p)) != 1]
        raise ValueError(f"pieces span atoms: {whole[:5]}")
    first = pieces.index("<0x00>")
    return ["" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) else p for i, p in enumerate(pieces)], first


class Decoder:
    """Bytes of each piece; the text of a list of ids."""

    def __init__(self, pieces: list[str], first_byte: int):
        self.data = [p.replace(SPACE, " ").encode() for p in pieces]
        for b in range(256):
            self.data[first_byte + b] = bytes([b])

    def bytes(self, ids: list[int]) -> bytes:
        """The text's bytes without the space that encoding puts in front."""
        found = itemgetter(*ids)(self.data) if len(ids) > 1 else [self.data[i] for i in ids]
        return b"".join(found)[1:]

    def text(self, ids: list[int]) -> str:
        return self.bytes(ids).decode("utf-8", "replace")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seeds: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on a seed and a place alone."""
    with np.errstate(over="ignore"):
        x = _mix(seeds + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattices:
    """Edges of all atoms seen, with their probabilities among the edges of their node."""

    def __init__(self, pieces: list[str], first_byte: int, sharpness: float = 1.0, most_edges: int = 8_000_000):
        self.logs = -sharpness * np.log(np.arange(len(pieces)) + 3.0)
        self.first_byte, self.most_edges = first_byte, most_edges
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, ids, marks of low hash bits
        with np.errstate(over="ignore"):
            for length in range(1, max(map(len, pieces)) + 1):
                some = [(self._hash(p), i) for i, p in enumerate(pieces) if len(p) == length]
                some.sort()
                marks = np.zeros(1 << 16, bool)
                hashes = np.array([h for h, _ in some], np.uint64)
                marks[(hashes >> np.uint64(48)).astype(np.int64)] = True
                self.by_length.append((hashes, np.array([i for _, i in some], np.int64), marks))
        self.clear()

    FACTOR = 0x9E3779B97F4A7C15

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = ((h ^ ord(c)) * self.FACTOR) % (1 << 64)
        return h

    def clear(self) -> None:
        self.start: dict[str, int] = {}  # first node of each atom
        self.nodes = self.edges = 0
        # room for all edges at once: pages that are never written cost nothing
        edges = self.most_edges + (1 << 20)
        self.first = np.zeros(edges // 2, np.int32)  # first edge of a node
        self.likeliest = np.zeros(edges // 2, np.int32)  # its most probable edge
        self.until = np.zeros(edges // 2)  # sum of its shares up to and with that edge
        self.share = np.zeros(edges)  # probability of an edge at its node
        self.upto = np.zeros(edges)  # node plus the shares up to and with the edge
        self.goal = np.zeros(edges, np.int32)  # node that the edge leads to, or -1
        self.piece = np.zeros(edges, np.int32)  # id, or -1 - code point of a character that only bytes can spell

    def _store(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            held = np.concatenate([held, np.zeros(max(len(held), len(values)), held.dtype)])
            setattr(self, name, held)
        held[at : at + len(values)] = values

    def add(self, atoms: list[str]) -> None:
        """Build the lattices of atoms not seen before; a node is a character's place."""
        # by length, so that the tables of a part are as narrow as its atoms; in parts that fit the cache
        new = sorted(set(atoms).difference(self.start), key=len)
        for low in range(0, len(new), 2000):
            self._build(new[low : low + 2000])

    def _build(self, new: list[str]) -> None:
        codes = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        starts = np.cumsum(sizes) - sizes
        remaining = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
        width = min(len(self.by_length), int(sizes.max()))
        value = np.full((len(codes), width), -np.inf)  # of the edge of each length from each node
        piece = np.zeros((len(codes), width), np.int32)
        at = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        for length, (hashes, ids, marks) in enumerate(self.by_length[:width], 1):
            fits = remaining[at] >= length
            at, h = at[fits], h[fits]
            h = (h ^ codes[at + length - 1]) * np.uint64(self.FACTOR)
            likely = np.flatnonzero(marks[(h >> np.uint64(48)).astype(np.int64)])
            if len(likely):
                place = np.minimum(np.searchsorted(hashes, h[likely]), len(hashes) - 1)
                found = hashes[place] == h[likely]
                some, which = at[likely[found]], ids[place[found]]
                value[some, length - 1] = self.logs[which]
                piece[some, length - 1] = which
        alone = np.flatnonzero(np.isneginf(value[:, 0]))  # characters that are no piece are spelled in bytes
        code = codes[alone].astype(np.int64)
        value[alone, 0] = self.logs[-1] * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        piece[alone, 0] = -1 - code
        # sums over completions, from the ends of the atoms to their starts
        mass = np.zeros(len(codes) + width + 1)
        order = np.argsort(remaining, kind="stable")
        levels = np.searchsorted(remaining[order], np.arange(1, int(sizes.max()) + 2))
        shares, best = np.zeros_like(value), np.zeros(len(codes), np.int64)
        for r in range(1, len(levels)):
            some = order[levels[r - 1] : levels[r]]
            n = min(r, width)
            sums = value[some, :n]
            for k in range(1, min(n, r - 1) + 1):  # an edge of length r ends the atom
                sums[:, k - 1] += mass[some + k]
            best[some] = likeliest = sums.argmax(axis=1)
            top = sums[np.arange(len(some)), likeliest]
            sums -= top[:, None]
            np.exp(sums, out=sums)
            total = sums.sum(axis=1)
            mass[some] = top + np.log(total)
            sums /= total[:, None]
            shares[some, :n] = sums
        cell = np.flatnonzero(shares.reshape(-1) > 0)
        source = cell // width
        length = cell - source * width
        share = shares.reshape(-1)[cell]
        heads = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
        lasts = np.r_[heads[1:] - 1, len(share) - 1]
        upto = np.cumsum(share)  # the shares of a node add up to 1
        likeliest = heads + np.add.reduceat((length < best[source]).astype(np.int64), heads)
        upto = np.clip(upto, source, source + 1)
        upto[lasts] = source[lasts] + 1
        until = upto[likeliest] - source[likeliest]
        inner = remaining[source] > length + 1
        for name, values in (("share", share), ("upto", upto + self.nodes), ("goal", np.where(inner, source + length + 1 + self.nodes, -1)), ("piece", piece.reshape(-1)[cell])):
            self._store(name, self.edges, values)
        self._store("first", self.nodes, heads + self.edges)
        self._store("likeliest", self.nodes, likeliest + self.edges)
        self._store("until", self.nodes, until)
        self.start.update(zip(new, (starts + self.nodes).tolist(), strict=True))
        self.nodes += len(codes)
        self.edges += len(share)

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random completions from each of the nodes to its atom's end: (edges in order, whose they are)."""
        active, now, who, taken, step = np.arange(len(nodes)), nodes, [], [], 0
        while len(active):
            u = uniform(seeds[active], step)
            e = self.likeliest[now]
            until = self.until[now]
            other = np.flatnonzero((u >= until) | (u < until - self.share[e]))
            if len(other):
                e[other] = np.searchsorted(self.upto[: self.edges], now[other] + u[other], "right")
            who.append(active)
            taken.append(e)
            now = self.goal[e]
            more = now >= 0
            active, now, step = active[more], now[more], step + 1
        if not who:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        whose = np.concatenate(who)
        order = np.argsort(whose, kind="stable")
        return np.concatenate(taken)[order], whose[order]

    def others(self, edge: int, out: set[int]) -> list[int]:
        """Edges of the same node that are not in ``out``."""
        node = math.ceil(self.upto[edge]) - 1
        last = self.first[node + 1] if node + 1 < self.nodes else self.edges
        return [e for e in range(self.first[node], last) if e not in out]

    def spelled(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of edges, with bytes for characters that are no piece."""
        ids = self.piece[edges]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        if ids[odd].min() >= -128:  # one byte each
            ids[odd] = self.first_byte - 1 - ids[odd]
            return ids
        spelled = [[self.first_byte + b for b in chr(-1 - x).encode()] for x in ids[odd].tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[odd] = list(map(len, spelled))
        out = np.repeat(ids, counts)
        out[out < 0] = np.concatenate(spelled)
        return out


def _gumbel(loc: float | np.ndarray, u: float | np.ndarray) -> np.ndarray:
    return loc - np.log(-np.log(u))


def _truncated(loc: float, bound: float, u: float) -> float:
    """A Gumbel value at ``loc``, conditioned to lie below ``bound``."""
    return float(-np.logaddexp(-bound, -_gumbel(loc, u)))


class Found:
    """A segmentation found, and the best perturbed value among those that leave it at one of its own steps.

    ``masses`` holds what leaves it at each step since ``since``, relative to the prefix before.
    """

    __slots__ = ("edges", "value", "log_prob", "since", "prefix", "masses", "best", "out")

    def __init__(self, edges: np.ndarray, value: float, log_prob: float, since: int, prefix: float, masses: np.ndarray):
        self.edges, self.value, self.log_prob = edges, value, log_prob
        self.since, self.prefix, self.masses = since, prefix, masses
        self.best = -math.inf
        self.out: dict[int, set[int]] = {}

    def draw(self, u: float) -> None:
        """Draw the best value of what leaves it, below its bound: all its branches as one set."""
        total = float(self.masses.sum())
        self.best = _truncated(self.prefix + math.log(total), self.value if self.best == -math.inf else self.best, u) if total > 0 else -math.inf


def _finish(lattices: Lattices, edges: list[np.ndarray], since: list[int], values: list[float], u: np.ndarray) -> list[Found]:
    """Segmentations with the masses of their branches, computed at once."""
    flat = np.concatenate(edges) if edges else np.empty(0, np.int64)
    log_share = np.log(lattices.share[flat])
    out, high = [], 0
    for k, e in enumerate(edges):
        low, high = high, high + len(e)
        total = np.cumsum(log_share[low:high])  # of this text alone, so that its batch makes no difference
        prefix = float(total[since[k] - 1]) if since[k] else 0.0
        own = np.exp(np.minimum(total[since[k] :] - prefix, 0.0))
        # the share of the prefix that is lost at each step
        masses = np.maximum(np.r_[1.0, own[:-1]] - own, 0.0) if len(own) else own
        x = Found(e, values[k], float(total[-1]) if len(total) else 0.0, since[k], prefix, masses)
        x.draw(float(u[k]))
        out.append(x)
    return out


def top_segmentations(lattices: Lattices, texts: list[np.ndarray], seeds: np.ndarray, k: int) -> list[tuple[list[Found], float]]:
    """For each text, given as the first nodes of its atoms, at most ``k`` distinct segmentations.

    They come in the order of their perturbed values, with the greatest value left over. Texts are
    independent of each other; they are taken together only to share array operations.
    """
    if not texts:
        return []
    with np.errstate(over="ignore", divide="ignore"):
        sizes = np.array([len(x) for x in texts], np.int64)
        whose = np.repeat(np.arange(len(texts)), sizes)
        index = np.arange(len(whose)) - (np.cumsum(sizes) - sizes)[whose]
        edges, atom = lattices.walk(np.concatenate(texts), _mix(seeds[whose] ^ ((index + 1).astype(np.uint64) << np.uint64(20))))
        parts = np.split(edges, np.cumsum(np.bincount(whose[atom], minlength=len(texts)))[:-1])
        values = _gumbel(0.0, uniform(seeds, 1 << 40))
        found = [[x] for x in _finish(lattices, parts, [0] * len(texts), values.tolist(), uniform(seeds, 1 << 41))]
        for turn in range(1, k):
            own_seeds = _mix(seeds + np.uint64(turn))
            u = np.stack([uniform(own_seeds, (1 << 42) + j) for j in range(4)], axis=1)
            todo, heads, starts, since, next_values = [], [], [], [], []
            for i, have in enumerate(found):
                source = max(have, key=lambda f: f.best)
                value = source.best
                if value == -math.inf:
                    continue
                # the step at which the best one leaves, and the edge that it takes
                upto = np.cumsum(source.masses)
                step = min(int(np.searchsorted(upto, u[i, 0] * upto[-1], "right")), len(upto) - 1)
                at = source.since + step
                out = source.out.setdefault(at, {int(source.edges[at])})
                left = lattices.others(int(source.edges[at]), out)
                weights = np.cumsum(lattices.share[left])
                chosen = left[min(int(np.searchsorted(weights, u[i, 1] * weights[-1], "right")), len(left) - 1)]
                out.add(chosen)
                source.masses[step] *= 1 - lattices.share[chosen] / weights[-1] if len(left) > 1 else 0.0
                source.draw(float(u[i, 2]))
                ahead = int(np.count_nonzero(lattices.goal[source.edges[:at]] < 0)) + 1  # atoms begun so far
                goal = int(lattices.goal[chosen])
                todo.append(i)
                heads.append(np.append(source.edges[:at], chosen))
                starts.append(np.append(goal, texts[i][ahead:]) if goal >= 0 else texts[i][ahead:])
                since.append(at + 1)
                next_values.append(value)
            if not todo:
                break
            sizes = np.array([len(x) for x in starts], np.int64)
            whose = np.repeat(np.arange(len(todo)), sizes)
            index = np.arange(len(whose)) - (np.cumsum(sizes) - sizes)[whose]
            edges, atom = lattices.walk(np.concatenate(starts), _mix(own_seeds[todo][whose] ^ ((index + 1).astype(np.uint64) << np.uint64(20))))
            tails = np.split(edges, np.cumsum(np.bincount(whose[atom], minlength=len(todo)))[:-1])
            fresh = _finish(lattices, [np.concatenate([a, b]) for a, b in zip(heads, tails, strict=True)], since, next_values, u[todo, 3])
            for i, x in zip(todo, fresh, strict=True):
                found[i].append(x)
    return [(have, max(f.best for f in have)) for have in found]


def sample_segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, model: str | None = None, seed: int = 1, sharpness: float = 1.0) -> DataFrame:
    """``docs`` with ``samples``: at most ``k`` distinct segmentations of each whole text, best first.

    A sample is (pieces, log_prob, perturbed, inclusion, round_trip): ids, log probability,
    perturbed value, probability to be among the first k at the value of the next, and whether
    decoding gives the text again. Draws are seeded by the row's key, so a row's samples depend on
    nothing else; rows with equal keys and texts get equal samples, and null keys share a seed.
    A null or empty text has the one segmentation of no pieces. A column named samples is replaced.
    """
    pieces, first_byte = load_pieces(model or default_model())
    docs = docs.drop("samples")
    shared = docs.sparkSession.sparkContext.broadcast((pieces, first_byte))
    key_at, text_at, names = docs.columns.index(key), docs.columns.index(text), docs.columns
    sample = pa.struct([("pieces", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, decoder = Lattices(*shared.value, sharpness), Decoder(*shared.value)
        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                batch = whole.slice(low, 64)
                if lattices.edges > lattices.most_edges:
                    lattices.clear()
                texts = [x.as_py() or "" for x in batch.column(text_at)]
                atoms = [ATOM.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
                lattices.add([a for some in atoms for a in some])
                sizes, ids, columns = [], [], ([], [], [], [])
                seeds = np.array([xxhash.xxh3_64_intdigest(str(row.as_py()), seed) for row in batch.column(key_at)], np.uint64)
                nodes = [np.fromiter(map(lattices.start.__getitem__, some), np.int64, len(some)) for some in atoms]
                for body, (found, cut) in zip(map(str.encode, texts), top_segmentations(lattices, nodes, seeds, k), strict=True):
                    sizes.append(len(found))
                    for f in found:
                        spelled = lattices.spelled(f.edges)
                        ids.append(spelled)
                        chance = 1.0 if cut == -math.inf else -math.expm1(-math.exp(min(700.0, f.log_prob - cut)))
                        for column, item in zip(columns, (f.log_prob, f.value, chance, decoder.bytes(spelled.tolist()) == body), strict=True):
                            column.append(item)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                fields = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.float64(), pa.bool_()), strict=True))]
                built = pa.StructArray.from_arrays(fields, fields=list(sample))
                samples = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), built)
                yield pa.RecordBatch.from_arrays([*batch.columns, samples], [*names, "samples"])

    kind = T.ArrayType(T.StructType([T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("inclusion", T.DoubleType()), T.StructField("round_trip", T.BooleanType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("samples", kind)]))


def decode_pieces(rows: DataFrame, column: str = "pieces", model: str | None = None, into: str = "decoded") -> DataFrame:
    """``rows`` with the text of the piece ids in ``column``: null for null, empty for no pieces."""
    shared = rows.sparkSession.sparkContext.broadcast(load_pieces(model or default_model()))
    rows = rows.drop(into)
    at, names = rows.columns.index(column), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(*shared.value)
        for batch in batches:
            texts = [None if x.as_py() is None else decoder.text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, into])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, a row each: their pieces, scores and round trip."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    samples = sample_segmentations(docs)
    one = F.posexplode("samples").alias("rank", "s")
    return samples.select("doc_id", one).select(
        "doc_id",
        (F.col("rank") + 1).alias("rank"),
        F.size("s.pieces").cast("long").alias("n_pieces"),
        F.hash("s.pieces").alias("pieces_hash"),
        F.col("s.log_prob").alias("log_prob"),
        F.col("s.perturbed").alias("perturbed"),
        F.col("s.inclusion").alias("inclusion"),
        F.col("s.round_trip").alias("round_trip"),
    )
