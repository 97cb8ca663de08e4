"""SentencePiece encoding and decoding, and sampled segmentations by Gumbel top-k without replacement.

The lattice of a text has a node before each character and an edge for each piece of the vocabulary
that the text holds there. Pieces never cross a chunk (a run of word-boundary marks and what follows up to the
next), so the lattice is a chain of chunk lattices, and equal chunks share theirs. A piece weighs
-log(rank + OFFSET); weights are normalised backwards, so an edge has the probability of being taken at its node.

Sampling is a perturbed A-star search over that lattice. A partial path has the perturbed value of
the best segmentation below it. The root's value is a Gumbel draw. Following a path, the child taken
at random keeps its parent's value, and the best of all children not taken gets a Gumbel value at
their joint log-probability, truncated at the parent's. Those siblings form the search's frontier: the
one with the largest value is followed next, down to a complete segmentation. The k segmentations found
first are a sample of k without replacement; kappa, the largest value left on the frontier, gives each
its inclusion score 1 - exp(-exp(log p - kappa)).

All draws are hashes of (row key, sample, chunk, node): results do not depend on batches or tasks.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import release_memory, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a mark that is part of the text; a lone surrogate is in no decoded text.
OWN_MARK = "\ud800"
OFFSET = 10.0
BYTE_WEIGHT = -12.0
#: Characters of texts whose lattices are held at once.
SLICE_CHARS = 500_000
STEPS = 1 << 20
HASH_BITS = 19
#: Ends a chunk where chunks are joined; in no piece.
STOP = "\0"
#: Chunks of more characters (texts without spaces) are cut where no piece crosses; all their parts are worked on at once.
LONG = 64


class Vocabulary:
    """Pieces of a model file; built once a worker."""

    def __init__(self, path: str) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = np.full(256, -1, dtype=np.int64)
        self.weight = np.full(size + 1, BYTE_WEIGHT)
        trie: dict[int, int] = {}  # node and code point: the next node
        piece_at = [-1]
        plain = 0
        for i in range(size):
            piece = self.processor.id_to_piece(i)
            if self.processor.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_unused(i)):
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                self.weight[i] = -np.log(plain + OFFSET)
                plain += 1
                if not re.search(f"[^{MARK}]{MARK}", piece):  # else it would cross a chunk
                    node = 0
                    for char in piece:
                        node = trie.setdefault(node << 21 | ord(char), len(piece_at))
                        if node == len(piece_at):
                            piece_at.append(-1)
                    piece_at[node] = i
        self.piece_at = np.array(piece_at, dtype=np.int32)
        self.root = np.full(0x110000, -1, dtype=np.int32)
        for key, node in trie.items():
            if key < 1 << 21:
                self.root[key] = node
        self._hash(np.fromiter(trie, np.int64, len(trie)), np.fromiter(trie.values(), np.int32, len(trie)))
        self.spelling = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.spelling_size = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.spelling_at = np.cumsum(self.spelling_size) - self.spelling_size
        self.fallback = size  # the edge of a character that no piece covers

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """The trie's edges in an open hash table: a key lies in its slot or one of the next few."""
        self.slot_keys = np.full((1 << HASH_BITS) + 64, -1, dtype=np.int64)
        self.slot_next = np.full((1 << HASH_BITS) + 64, -1, dtype=np.int32)
        slots, self.probes = _slot(keys), 1
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            free = first[self.slot_keys[slots[first]] < 0]
            self.slot_keys[slots[free]], self.slot_next[slots[free]] = keys[free], values[free]
            left = np.ones(len(keys), dtype=bool)
            left[free] = False
            keys, values, slots = keys[left], values[left], slots[left] + 1
            self.probes += bool(len(keys))

    def _step(self, keys: np.ndarray) -> np.ndarray:
        """The node behind each edge, -1 where there is none."""
        slots = _slot(keys)
        held = self.slot_keys[slots]
        out = np.where(held == keys, self.slot_next[slots], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slots[open_] += 1
            held = self.slot_keys[slots[open_]]
            found = held == keys[open_]
            out[open_[found]] = self.slot_next[slots[open_[found]]]
            open_ = open_[~found & (held >= 0)]
        return out

    def pieces_in(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece in the code points, by walking the trie from all places at once."""
        start, node, depth = np.arange(len(points), dtype=np.int32), self.root[points], 1
        out = []
        while True:
            inner = node >= 0
            start, node = start[inner], node[inner]
            if not len(start):
                break
            piece = self.piece_at[node]
            whole = piece >= 0
            out.append((start[whole], start[whole] + np.int32(depth), piece[whole]))
            inner = start + depth < len(points)
            start, node = start[inner], node[inner]
            node = self._step(node.astype(np.int64) << 21 | points[start + depth])
            depth += 1
        if not out:
            return (np.zeros(0, np.int32),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def char_ids(self, char: str) -> np.ndarray:
        return self.byte_id[list((MARK if char == OWN_MARK else char).encode("utf-8", "replace"))]


def _slot(keys: np.ndarray) -> np.ndarray:
    """Multiplicative hashing; the factor is a fixed value (2**64 over the golden ratio)."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without the mark that it starts with. One mark is put before the text, and
    spaces are marks."""
    if not text:
        return []
    plain = text.replace(MARK, OWN_MARK) if MARK in text else text
    if "  " not in plain and plain[0] != " " and plain[-1] != " ":
        return plain.split(" ")
    return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + plain.replace(" ", MARK))]


class Lattice:
    """Lattices of distinct chunks: edges sorted by node, with their probabilities given the node."""

    def __init__(self, vocab: Vocabulary, chunks: list[str]) -> None:
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(chunks) else np.zeros(0, np.int64)
        total = int((sizes + 1).sum())
        joined = "".join([c + STOP for c in chunks])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        inner = np.ones(total, dtype=bool)
        inner[self.first + sizes] = False  # a STOP that is part of a text is an ordinary character
        node, end, piece = vocab.pieces_in(points)
        covered = np.zeros(total, dtype=bool)
        covered[node[end == node + 1]] = True
        bare = np.flatnonzero(~covered & inner).astype(np.int32)
        left = np.zeros(total, dtype=np.int64)  # characters from a node to the end of its chunk
        if total:
            left = np.repeat(self.first + sizes, sizes + 1) - np.arange(total)
        self.last = self.first + sizes
        self.cut = np.zeros(total, dtype=bool)
        self.cut[self.last] = True
        if total and sizes.max() > LONG:
            left = self._cut_long(sizes, node, end, left)
        self.cuts = np.flatnonzero(self.cut)
        node, end = np.concatenate([node, bare]), np.concatenate([end, bare + 1])
        piece = np.concatenate([piece, np.full(len(bare), vocab.fallback, dtype=np.int32)])
        order = np.argsort(node, kind="stable")
        self.node, self.end, self.piece = node[order], end[order], piece[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=total))])
        weight = vocab.weight[self.piece]
        # nodes nearest to the next cut first; of one distance all parts of chunks at once
        distance = left[self.node]
        order = np.argsort(distance.astype(np.uint16) if total and left.max() < 1 << 16 else distance, kind="stable")
        by_node, by_end, by_weight = self.node[order], self.end[order], weight[order]
        beta = np.zeros(total)
        bounds = np.searchsorted(left[by_node], np.arange(1, (left.max() if total else 0) + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                continue
            value = by_weight[a:b] + np.where(self.cut[by_end[a:b]], 0.0, beta[by_end[a:b]])
            group = by_node[a:b]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
            top = np.maximum.reduceat(value, starts)
            sizes_here = np.diff(np.concatenate([starts, [b - a]]))
            beta[group[starts]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, sizes_here)), starts))
        degree = np.diff(self.start)
        self.logp = weight + np.where(self.cut[self.end], 0.0, beta[self.end]) - np.repeat(beta, degree)
        upto = np.cumsum(np.exp(self.logp)) if len(node) else np.zeros(0)
        before = np.repeat(np.concatenate([[0.0], upto])[self.start[:-1]], degree)
        self.mass = np.minimum(upto - before, 1.0)
        del upto, before
        if len(node):
            self.mass[self.start[self.node + 1] - 1] = 1.0
        # ids of an edge: its piece, or the bytes of a character that no piece covers
        own = np.flatnonzero(self.piece == vocab.fallback)
        chars, which = np.unique(points[self.node[own]], return_inverse=True)
        spelled = [vocab.char_ids(chr(c)) for c in chars.tolist()]
        lengths = np.fromiter(map(len, spelled), np.int8, len(spelled))
        self.flat_ids = np.concatenate([np.arange(vocab.fallback), *spelled]).astype(np.int32)
        self.id_at, self.id_count = self.piece, np.ones(len(self.piece), dtype=np.int8)
        self.id_at[own] = (vocab.fallback + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))[which]
        self.id_count[own] = lengths[which]


    def _cut_long(self, sizes: np.ndarray, node: np.ndarray, end: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Marks the nodes of long chunks that no piece crosses. Every segmentation passes them, so the edges on
        either side are independent of each other. Returns the characters from each node to the next cut."""
        total = len(self.cut)
        crossed = np.bincount(node + 1, minlength=total + 1) - np.bincount(end, minlength=total + 1)
        inside = np.repeat(sizes > LONG, sizes + 1)
        self.cut |= (np.cumsum(crossed)[:total] == 0) & inside
        cuts = np.flatnonzero(self.cut)
        after = np.minimum(np.searchsorted(cuts, np.arange(total), side="right"), len(cuts) - 1)
        out = np.where(inside, cuts[after] - np.arange(total), left)
        out[self.last] = 0
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser. Its multipliers are fixed values of that function."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key, sample: int, place: np.ndarray, step) -> np.ndarray:
    """Draws in (0, 1) fixed by row key, sample, place in the row and node of the chunk (or a reserved number)."""
    at = place.astype(np.uint64) * np.uint64(STEPS) + np.asarray(step).astype(np.uint64)
    salt = np.uint64((sample + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    mixed = _mix(key + _mix(at + salt))
    return ((mixed >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _walk(lattice: Lattice, occurrence: np.ndarray, place: np.ndarray, node: np.ndarray, key: np.ndarray, sample: int):
    """Random edges from each node to the end of its chunk: (occurrence, edge), in order of occurrence and node.

    occurrence: numbers of the chunks in the batch, ascending; place: their numbers within the row. The parts of
    a long chunk are walked side by side: every path passes the cuts between them."""
    stop = lattice.last[np.searchsorted(lattice.last, node)] if len(node) else node
    first = lattice.first[np.searchsorted(lattice.last, node)] if len(node) else node
    if len(lattice.cuts) > len(lattice.last):
        lo, hi = np.searchsorted(lattice.cuts, node, side="right"), np.searchsorted(lattice.cuts, stop)
        more = np.maximum(hi - lo, 0)
        within = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        extra = lattice.cuts[np.repeat(lo, more) + within]
        which = np.concatenate([np.arange(len(node)), np.repeat(np.arange(len(node)), more)])
        occurrence, place, key, first = occurrence[which], place[which], key[which], first[which]
        node = np.concatenate([node, extra])
    occurrences, edges = [], []
    live = np.flatnonzero(lattice.start[node] < lattice.start[node + 1])
    at = node[live]
    while len(live):
        draw = uniform(key[live], sample, place[live], (at - first[live]) % (STEPS - 8))
        edge = lattice.start[at]
        late = np.flatnonzero(lattice.mass[edge] < draw)
        while len(late):  # the last edge of a node has mass 1
            edge[late] += 1
            late = late[lattice.mass[edge[late]] < draw[late]]
        occurrences.append(occurrence[live])
        edges.append(edge)
        at = lattice.end[edge]
        inner = ~lattice.cut[at]
        live, at = live[inner], at[inner]
    if not edges:
        return (np.zeros(0, np.int64),) * 2
    occurrence, edge = np.concatenate(occurrences), np.concatenate(edges)
    # within an occurrence edges are sorted by their node
    order = np.argsort(occurrence * len(lattice.node) + edge, kind="stable")
    return occurrence[order], edge[order]


def _log_rest(logp: np.ndarray) -> np.ndarray:
    """log(1 - exp(logp)), -inf where nothing is left."""
    with np.errstate(divide="ignore"):
        rest = np.log(-np.expm1(np.minimum(logp, 0)))
    return np.where(logp >= -1e-12, -np.inf, rest)


def _truncated(location, bound, draw):
    """A Gumbel at location that is at most bound; -inf at location -inf."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        out = location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(draw))
    return np.where(np.isneginf(location), -np.inf, np.minimum(out, bound))


def _truncated_one(location: float, bound: float, draw: float) -> float:
    return min(bound, location - math.log(math.exp(min(location - bound, 700.0)) - math.log(draw)))


class _Path:
    """One segmentation of a row: its edges, their chunks' numbers in the batch, the log-probability before each."""

    __slots__ = ("edges", "occurrences", "before", "logp")

    def __init__(self, edges, occurrences, logs):
        self.edges, self.occurrences = edges, occurrences
        upto = np.cumsum(logs)
        self.before = upto - logs
        self.logp = float(upto[-1]) if len(logs) else 0.0


def _numbered(chunks: list[str], odd: bool) -> tuple[np.ndarray, list[str]]:
    """The number of each chunk among the distinct ones, and those with their first mark. odd: some hold a lone
    surrogate, which pandas can't hash."""
    if odd:
        names: dict[str, int] = {}
        flat = np.array([names.setdefault(c, len(names)) for c in chunks], dtype=np.int64)
        return flat, [MARK + c for c in names]
    said = np.empty(len(chunks), dtype=object)
    said[:] = chunks
    flat, found = pd.factorize(said)
    return flat, [MARK + c for c in found.tolist()]


def sample_rows(texts: list[str], keys: np.ndarray, k: int, path: str = MODEL) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k distinct segmentations (ids, log p, log inclusion score), best value first.

    A text with fewer than k segmentations yields all of them, each with inclusion score 1 (log 0).
    An empty text has one segmentation, without pieces.
    """
    vocab = vocabulary(path)
    rows = [chunks_of(t) for t in texts]
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    flat, names = _numbered(list(itertools.chain.from_iterable(rows)), any(MARK in t for t in texts))
    lattice = Lattice(vocab, names)
    doc_at = np.concatenate([[0], np.cumsum(counts)])
    nodes = lattice.first[flat] if len(flat) else flat
    keys = keys.astype(np.uint64)
    every = np.repeat(np.arange(len(rows)), counts)
    occurrence = np.arange(len(flat))
    place = occurrence - doc_at[every]

    found: list[list[_Path]] = [[] for _ in rows]
    # frontier entries of each row: value, path, decision, edges of its node that were followed
    frontier: list[list[list]] = [[] for _ in rows]
    root = -np.log(-np.log(uniform(keys, 0, np.zeros(len(rows)), STEPS - 1)))

    def add(sample: int, parts, prefix: dict, bound: np.ndarray) -> None:
        """Take up paths: parts are the walked (occurrence, edge), prefix the (edges, occurrences) before, bound
        the value of each row's path. The best k siblings along the new part join the frontier."""
        where, edge = parts
        at = np.searchsorted(where, doc_at)
        logs, before, number = lattice.logp[edge], np.zeros(len(edge)), np.zeros(len(edge), np.int64)
        for d, (head_e, head_o) in prefix.items():
            a, b, n = at[d], at[d + 1], len(head_e)
            new = edge[a:b]
            route = _Path(np.concatenate([head_e, new]) if n else new, np.concatenate([head_o, where[a:b]]) if n else where[a:b], np.concatenate([lattice.logp[head_e], logs[a:b]]) if n else logs[a:b])
            found[d].append(route)
            before[a:b], number[a:b] = route.before[n:], np.arange(n, n + b - a)
        row = every[where]
        draw = uniform(keys[row], sample, number, STEPS - 2)
        value = _truncated(before + _log_rest(logs), bound[row], draw)
        for d, (head_e, _) in prefix.items():
            here = value[at[d] : at[d + 1]]
            for _ in range(min(k, len(here))):
                t = int(here.argmax())
                if here[t] == -np.inf:
                    break
                frontier[d].append([float(here[t]), found[d][-1], len(head_e) + t, {int(edge[at[d] + t])}])
                here[t] = -np.inf

    none = np.zeros(0, np.int64)
    add(0, _walk(lattice, occurrence, place, nodes, keys[every], 0), dict.fromkeys(range(len(rows)), (none, none)), root)
    for sample in range(1, k):
        prefix, bound, firsts, starts = {}, np.zeros(len(rows)), [], []
        for d, entries in enumerate(frontier):
            if not entries:
                continue
            best = max(range(len(entries)), key=lambda i: entries[i][0])
            value, route, t, used = entries[best]
            node = int(lattice.node[route.edges[t]])
            options = [e for e in range(lattice.start[node], lattice.start[node + 1]) if e not in used]
            mass = np.exp(lattice.logp[options])
            draws = uniform(keys[d], sample, np.array([t, t]), np.array([STEPS - 3, STEPS - 4]))
            edge = options[min(int(np.searchsorted(np.cumsum(mass) / mass.sum(), draws[0])), len(options) - 1)]
            rest = [e for e in options if e != edge]
            if rest:
                location = route.before[t] + np.log(np.exp(lattice.logp[rest]).sum())
                entries[best] = [_truncated_one(float(location), value, float(draws[1])), route, t, used | {edge}]
            else:
                entries.pop(best)
            prefix[d] = (np.append(route.edges[:t], edge), route.occurrences[: t + 1])
            bound[d] = value
            firsts.append(int(route.occurrences[t]))
            starts.append(int(lattice.end[edge]))
        if not prefix:
            break
        todo = np.concatenate([np.arange(a, doc_at[d + 1]) for d, a in zip(prefix, firsts)])
        start = nodes[todo]
        start[np.searchsorted(todo, firsts)] = starts
        add(sample, _walk(lattice, todo, place[todo], start, keys[every[todo]], sample), prefix, bound)

    out = []
    for d, paths in enumerate(found):
        kappa = max((e[0] for e in frontier[d]), default=-np.inf)
        out.append([(_ids(lattice, p.edges), p.logp, inclusion(p.logp, kappa)) for p in paths])
    return out


def inclusion(logp: float, kappa: float) -> float:
    """log(1 - exp(-exp(logp - kappa)))"""
    if kappa == -np.inf:
        return 0.0
    x = logp - kappa
    if x < -30:
        return x
    return float(np.log(-np.expm1(-np.exp(min(x, 30.0)))))


def _ids(lattice: Lattice, edges: np.ndarray) -> np.ndarray:
    count = lattice.id_count[edges].astype(np.int64)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return lattice.flat_ids[np.repeat(lattice.id_at[edges], count) + within]


def encode(text: str, path: str = MODEL) -> list[int]:
    """The model's own segmentation."""
    return vocabulary(path).processor.encode(text)


def decode(ids, path: str = MODEL) -> str:
    """The text of any segmentation; exact for every id list that sample_rows() returns."""
    vocab, ids = vocabulary(path), np.asarray(ids, dtype=np.int64)
    sizes = vocab.spelling_size[ids]
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return vocab.spelling[np.repeat(vocab.spelling_at[ids], sizes) + within][1:].tobytes().decode("utf-8", "replace")


def _row_key(doc_id) -> int:
    return int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest(), "little")


def sampled(docs: DataFrame, k: int = 2, path: str = MODEL) -> DataFrame:
    """doc_id, rank (from 0), ids, log_prob, log_inclusion and decoded (the ids give the text back), up to k
    rows for each row of docs.

    Null texts count as empty: one row without ids. Rows with equal ids and texts get equal samples;
    ids are of any plain type, a null id is a key like any other. Long texts without spaces are one chunk, cut
    where no piece crosses. Nothing is shuffled; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("rank", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("log_inclusion", pa.float64()), ("decoded", pa.bool_())])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), []
            for x in batch.column("body"):
                texts.append(x.as_buffer().to_pybytes().decode("utf-8", "replace"))
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and (to == at or held + len(texts[to]) <= SLICE_CHARS):
                    held += len(texts[to])
                    to += 1
                keys = np.array([_row_key(i) for i in ids[at:to]], dtype=np.uint64)
                out = []
                for i, text, paths in zip(ids[at:to], texts[at:to], sample_rows(texts[at:to], keys, k, path)):
                    for rank, (tokens, logp, included) in enumerate(paths):
                        out.append((i, rank, tokens, logp, included, decode(tokens, path) == text))
                columns = zip(*out, strict=True)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema)
                at = to
                del out, columns, keys
            release_memory()

    source = docs.select("doc_id", utf8(F.col("text")).alias("body"))
    return source.mapInArrow(run, f"doc_id {id_type.simpleString()}, rank int, ids array<int>, log_prob double, log_inclusion double, decoded boolean")
