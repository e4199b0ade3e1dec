"""SentencePiece encoding and decoding with sampled segmentations (operator 7).

A text is cut at spaces; a chunk is the mark and the characters up to the next space. Its lattice has an edge for
every vocabulary piece (and for a character without a piece, its UTF-8 bytes' pieces). Segmentations of the whole
text have probability proportional to the exponential of their pieces' scores.

Samples are drawn without replacement by the Gumbel top-k trick: every segmentation gets its log-probability plus
Gumbel noise, and those with the k largest values are the samples. A-star finds them without enumeration. A node
is a prefix of pieces; its value is the largest perturbed value below it, which is drawn from the exact
(log-sum-exp) weight of its completions, so the search never expands a node in vain: the best open node is
followed to the end at once, its best child having its own value, while the siblings along the way get truncated
Gumbel values and stay open. One more value than samples is kept: with kappa the (k+1)-th largest, a sample of
log-probability p has the inclusion score 1 - exp(-exp(p - kappa)), given as a logarithm.

All uniforms are hashes of (row key, round, chunk, step), so samples depend on the row alone and not on batches,
partitions or retries. The weights of a chunk's lattice are kept for the task process in a pool; when it holds more
than POOL characters, the chunks in use stay and the others go. New chunks are added some ADDED characters at a time
(more where chunks are long), which bounds the arrays that make their lattices. Results depend on neither. All steps run in numpy over many texts.

Siblings deep in a text can be skipped exactly: uniforms have 52 bits, so Gumbel noise is below 37, and a node of
log-probability p stays below p + 37. Where the values kept are not above that bound, all are drawn.

Defined cases: null and empty texts are the mark alone. A text with fewer than k segmentations returns them all,
with inclusion score 1. Equal perturbed values are ordered by round, place and edge. Repeated rows (equal doc_id and
text) give equal samples; a null doc_id is a key like any other. Decoding gives back any text exactly: a literal
mark is spelt in bytes. A chunk of more than LONGEST characters without a space is cut there, so that each of its
segmentations has a piece's end at every LONGEST-th character; its memory is then that of the text's own pieces and
of its different stretches of LONGEST characters, some 200 bytes a character at most. An empty table gives no rows.
Other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import row_groups, texts_of
from .ngrams import mix
from .vocabulary import MARK, Vocabulary

SAMPLES, SEED, POOL, LONGEST, ADDED = 2, 7, 600_000, 1 << 16, 1 << 15
_U = np.uint64
_STEP, _NEAR, _DEEP = _U(0x9E3779B97F4A7C15), -6.0, -6.0 - 37.0
#: Stands for a mark that the text itself holds: no UTF-8 text decodes to it, and no piece has it.
_LITERAL = "\ud800"
_NOT_TAIL = bytes([*range(0x80), *range(0xC0, 0x100)])  # bytes that begin a character
SCHEMA = "doc_id long, n_chars long, n_samples int, n_pieces array<long>, log_prob array<double>, log_inclusion array<double>, ids_sha256 string, round_trip boolean"


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for every n of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniforms in (0, 1) from the upper 52 bits of hashes: all are doubles, none is 0 or 1."""
    return ((h >> _U(12)).astype(float) + 0.5) * 2.0**-52


class Trie:
    """The usable pieces' prefixes as nodes: the first character's in an array, other steps in an open hash table."""

    BITS = 19

    def __init__(self, pieces: dict[str, int], scores: np.ndarray):
        nodes: dict[tuple[int, str], int] = {}
        owner: list[int] = []
        for text, i in pieces.items():
            at = -1
            for c in text:
                step = (at, c)
                at = nodes.get(step, -1)
                if at < 0:
                    at = nodes[step] = len(owner)
                    owner.append(-1)
            owner[at] = i
        self.piece = np.array(owner, np.int32)
        self.score = np.where(self.piece >= 0, scores[self.piece], 0.0) if owner else np.empty(0)
        self.first = np.full(0x110000, -1, np.int32)
        size = 1 << max(self.BITS, len(owner).bit_length() + 2)
        self.mask, self.down = size - 1, _U(64 - (size.bit_length() - 1))
        self.key, self.to = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        key = np.array([p << 21 | ord(c) for p, c in nodes if p >= 0], np.int64)
        to = np.array([n for (p, _), n in nodes.items() if p >= 0], np.int32)
        for (p, c), n in nodes.items():
            if p < 0:
                self.first[ord(c)] = n
        slot = self._slot(key)
        while len(key):  # of those that want an empty slot one gets it; the rest go on to the next
            free = np.flatnonzero(self.key[slot] < 0)
            self.key[slot[free]] = key[free]
            rest = np.flatnonzero(self.key[slot] != key)
            got = np.flatnonzero(self.key[slot] == key)
            self.to[slot[got]] = to[got]
            key, to, slot = key[rest], to[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _STEP >> self.down).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes after these characters, or -1."""
        key = node.astype(np.int64) << 21 | code
        slot = self._slot(key)
        held = self.key[slot]
        out = np.where(held == key, self.to[slot], np.int32(-1))
        rows = np.flatnonzero((held != key) & (held >= 0))
        while len(rows):
            slot[rows] = at = (slot[rows] + 1) & self.mask
            held = self.key[at]
            hit = held == key[rows]
            out[rows[hit]] = self.to[at[hit]]
            rows = rows[~hit & (held >= 0)]
        return out


class _Numbers(dict):
    """Chunk -> its number in the pool; a new chunk gets the next one."""

    def __init__(self, chunks: list[str]):
        super().__init__(zip(chunks, range(len(chunks)), strict=True))
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with more after its first used values, in place where there is room."""
    end = used + len(more)
    if end > len(held):
        room = np.empty(max(end, 2 * len(held)), held.dtype)  # what is not yet used is not written, so takes no memory
        room[:used] = held[:used]
        held = room
    held[used:end] = more
    return held


def _parts(chunks: list[str], most: int) -> Iterator[list[str]]:
    """The chunks in order, in parts of about most characters, or 128 times the longest chunk's: a part takes as many
    steps as its longest chunk has characters, so all parts together take one for every 128 characters at most, and
    those of one part."""
    size = np.fromiter(map(len, chunks), np.int64, len(chunks))
    ends, most = np.cumsum(size), max(most, 128 * int(size.max(initial=0)))
    at = [*np.flatnonzero(np.diff((ends - 1) // most, prepend=-1)).tolist(), len(chunks)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield chunks[a:b]


class Pool:
    """The lattices of chunks seen: by position its edges, by edge its length, piece and conditional log-probability."""

    def __init__(self, vocabulary: Vocabulary, pool: int = POOL):
        self.v, self.limit = vocabulary, pool
        self.bytes_of = [p.replace(MARK, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.width = np.array([len(x) for x in self.bytes_of], np.int64)
        apart = vocabulary.special | set(vocabulary.byte_ids)
        self.trie = Trie({p: i for i, p in enumerate(vocabulary.pieces) if p and i not in apart and p.find(MARK, 1) < 0}, np.array(vocabulary.scores))
        self.words = _Numbers([])
        self.start = self.size = self.uses = np.empty(0, np.int64)  # of chunks: first position, positions, uses since the last turn
        self.first = np.zeros(1, np.int64)  # of positions: first edge (and the end)
        self.length, self.piece = np.empty(0, np.uint8), np.empty(0, np.int32)
        self.logp = self.cum = np.empty(0)
        self.n_words = self.n_pos = self.n_edges = 0

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """The chunks' numbers in the pool; new ones are added."""
        out = np.fromiter(map(self.words.__getitem__, chunks), np.int64, len(chunks))
        new, self.words.new = self.words.new, []
        for part in _parts(new, ADDED):
            self._add(part)
        self.uses[: self.n_words] += np.bincount(out, minlength=self.n_words)
        return out

    def turn(self) -> None:
        """A full pool keeps the chunks used twice or more since the last turn, if those fill at most half of it."""
        if self.n_pos <= self.limit:
            return
        uses, size = self.uses[: self.n_words], self.size[: self.n_words]
        least = 2
        while size[uses >= least].sum() > self.limit // 2:
            least *= 2
        old = np.flatnonzero(uses >= least)
        chunks = list(self.words)
        self.words = _Numbers([chunks[i] for i in old])
        pos = np.repeat(self.start[old], size[old]) + _ramp(size[old])
        count = self.first[pos + 1] - self.first[pos]
        edge = np.repeat(self.first[pos], count) + _ramp(count)
        self.length, self.piece, self.logp, self.cum = self.length[edge], self.piece[edge], self.logp[edge], self.cum[edge]
        self.first = np.append(0, np.cumsum(count))
        self.size, self.uses = size[old], np.zeros(len(old), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.n_words, self.n_pos, self.n_edges = len(old), len(pos), len(edge)

    def _add(self, chunks: list[str]) -> None:
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(len(code))  # characters up to the chunk's end
        count = np.zeros(len(code), np.int64)
        levels = []  # of every length: positions, nodes that are pieces, and how many shorter ones the position has
        node = self.trie.first[code]
        at = np.flatnonzero(node >= 0)
        node, n = node[at], 1
        while len(at):
            hit = np.flatnonzero(self.trie.piece[node] >= 0)
            found = at[hit]
            levels.append((n, found, node[hit], count[found]))
            count[found] += 1
            more = np.flatnonzero(left[at] > n)
            at, node = at[more], node[more]
            node = self.trie.step(node, code[at + n])
            more = np.flatnonzero(node >= 0)
            at, node, n = at[more], node[more], n + 1
        single = np.zeros(len(code), bool)
        for n, found, _, _ in levels[:1]:
            single[found] = True
        lone = np.flatnonzero(~single)
        # A position's edges stand together, longer ones first: they are the likelier, so a draw ends sooner.
        count[lone] += 1
        heads = np.cumsum(count) - count
        total = int(count.sum())
        e_len, e_piece, e_score = np.empty(total, np.uint8), np.empty(total, np.int32), np.empty(total)
        last = heads + count - 1
        for n, found, nodes, shorter in levels:
            to = last[found] - shorter - ~single[found]
            e_len[to], e_piece[to], e_score[to] = n, self.trie.piece[nodes], self.trie.score[nodes]
        to = last[lone]
        e_len[to], e_piece[to], e_score[to] = 1, -1 - np.where(code[lone] == ord(_LITERAL), ord(MARK), code[lone]), self.v.unknown
        # Log-weights of completions, from the chunks' ends backwards, for all chunks at once.
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        per_level = np.bincount(left)[1:]
        beta, end = np.zeros(len(code) + 1), 0
        for n in per_level:
            at, end = order[end : end + n], end + n
            c = count[at]
            edges = np.repeat(heads[at], c) + _ramp(c)
            length = e_len[edges]
            rest = np.repeat(left[at], c) > length
            x = e_score[edges] + np.where(rest, beta[np.repeat(at, c) + length], 0.0)
            e_score[edges] = x
            beta[at] = np.logaddexp.reduceat(x, np.cumsum(c) - c)
        logp = e_score - np.repeat(beta[:-1], count)
        cum = np.exp(logp)
        at, rank = np.flatnonzero(count > 1), 1
        while len(at):  # summed within each position, so that a value depends on its chunk alone
            edges = heads[at] + rank
            cum[edges] += cum[edges - 1]
            rank += 1
            at = at[count[at] > rank]
        cum[last] = 2.0  # the last edge takes what rounding leaves
        n_words, n_pos, n_edges = self.n_words, self.n_pos, self.n_edges
        self.start = _grown(self.start, n_words, n_pos + ends - size)
        self.size = _grown(self.size, n_words, size)
        self.uses = _grown(self.uses, n_words, np.zeros(len(size), np.int64))
        self.first = _grown(self.first, n_pos + 1, n_edges + heads + count)
        self.length = _grown(self.length, n_edges, e_len)
        self.piece = _grown(self.piece, n_edges, e_piece)
        self.logp, self.cum = _grown(self.logp, n_edges, logp), _grown(self.cum, n_edges, cum)
        self.n_words, self.n_pos, self.n_edges = n_words + len(size), n_pos + len(code), n_edges + total


@dataclass
class Paths:
    """Pieces of the texts' segmentations, in order: the position before each, the edge taken and its chunk; ends by text."""

    pos: np.ndarray
    edge: np.ndarray
    chunk: np.ndarray
    ends: np.ndarray

    def offsets(self) -> np.ndarray:
        return np.append(0, self.ends)

    def sums(self, logp: np.ndarray) -> np.ndarray:
        """Log-probability of each text's pieces up to each of them, summed text by text: other texts don't matter."""
        out, at = np.empty(len(logp)), self.offsets().tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            np.cumsum(logp[a:b], out=out[a:b])
        return out


def _follow(pool: Pool, word: np.ndarray, key: np.ndarray, chunk: np.ndarray, cur: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, edge, number of pieces by row) of paths drawn from cur to the end of every chunk."""
    end = pool.start[word[chunk]] + pool.size[word[chunk]]
    rows, steps = np.flatnonzero(cur < end), []
    while len(rows):
        at = cur[rows]
        u = _unit(mix(key[rows] + _U(int(_STEP) * (len(steps) + 1) & (1 << 64) - 1)))
        edge = pool.first[at]
        more = np.flatnonzero(u >= pool.cum[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] >= pool.cum[edge[more]]]
        steps.append((rows, at, edge))
        cur[rows] = at + pool.length[edge]
        rows = rows[cur[rows] < end[rows]]
    made = np.zeros(len(chunk), np.int64)
    for k, (r, _, _) in enumerate(steps):
        made[r] = k + 1
    offset = np.cumsum(made) - made
    pos, edges = np.empty(int(made.sum()), np.int64), np.empty(int(made.sum()), np.int64)
    for k, (r, at, edge) in enumerate(steps):
        pos[offset[r] + k], edges[offset[r] + k] = at, edge
    return pos, edges, made


def chunks_of(text: str) -> list[str]:
    """The chunks of a text: the mark and the characters up to the next space, LONGEST characters at most."""
    chunks = (MARK + text.replace(MARK, _LITERAL).replace(" ", " " + MARK)).split(" ")
    if len(text) < LONGEST or max(map(len, chunks)) <= LONGEST:
        return chunks
    return [c[i : i + LONGEST] for c in chunks for i in range(0, len(c), LONGEST)]


class Sampler:
    """Draws k segmentations of each text without replacement; see the module's text."""

    def __init__(self, pool: Pool, texts: list[str], seeds: np.ndarray):
        parts = [chunks_of(t) for t in texts]
        self.pool, self.seeds, self.n = pool, seeds, len(texts)
        self.word = pool.numbers([c for x in parts for c in x])
        self.first = np.append(0, np.cumsum([len(x) for x in parts]))

    def _draw(self, turn: int, docs: np.ndarray, before: list[Paths], node: dict[str, np.ndarray] | None) -> tuple[Paths, np.ndarray]:
        """Whole paths of docs: the prefix of the node's path, its edge, then a draw. Also the first piece drawn, by text."""
        pool = self.pool
        if node is None:
            begin, pos = self.first[docs], None
            head = np.zeros(len(docs), np.int64)
        else:
            head = node["at"] + 1
            path_pos, path_edge, path_chunk = (np.empty(len(docs), np.int64) for _ in range(3))
            for t, p in enumerate(before):
                own = np.flatnonzero(node["turn"] == t)
                i = p.offsets()[docs[own]] + node["at"][own]
                path_pos[own], path_chunk[own] = p.pos[i], p.chunk[i]
            path_edge[:] = node["edge"]
            begin, pos = path_chunk, path_pos + pool.length[path_edge]
        n = self.first[docs + 1] - begin
        chunk = np.repeat(begin, n) + _ramp(n)
        owner = np.repeat(docs, n)
        cur = pool.start[self.word[chunk]]
        if pos is not None:
            cur[np.cumsum(n) - n] = pos
        key = mix(self.seeds[owner] + mix((chunk - self.first[owner]).astype(np.uint64) + _U(turn << 48)))
        d_pos, d_edge, made = _follow(pool, self.word, key, chunk, cur)
        tail = np.add.reduceat(made, np.cumsum(n) - n) if len(n) else made
        total = np.zeros(self.n, np.int64)
        total[docs] = head + tail
        ends = np.cumsum(total)
        size = int(ends[-1]) if len(ends) else 0
        out = Paths(np.empty(size, np.int64), np.empty(size, np.int64), np.empty(size, np.int64), ends)
        start = (ends - total)[docs]
        at = np.repeat(start + head, tail) + _ramp(tail)
        out.pos[at], out.edge[at], out.chunk[at] = d_pos, d_edge, np.repeat(chunk, made)
        if node is not None:
            for t, p in enumerate(before):
                own = np.flatnonzero(node["turn"] == t)
                h = head[own] - 1
                to, source = np.repeat(start[own], h) + _ramp(h), np.repeat(p.offsets()[docs[own]], h) + _ramp(h)
                out.pos[to], out.edge[to], out.chunk[to] = p.pos[source], p.edge[source], p.chunk[source]
            to = start + head - 1
            out.pos[to], out.edge[to], out.chunk[to] = path_pos, path_edge, path_chunk
        drawn = np.zeros(self.n, np.int64)
        drawn[docs] = head
        return out, drawn

    def _siblings(self, turn: int, path: Paths, total: np.ndarray, drawn: np.ndarray, value: np.ndarray, docs: np.ndarray, deep: float) -> dict[str, np.ndarray]:
        """Open nodes beside the pieces drawn, where the prefix has a log-probability above deep."""
        pool, offsets = self.pool, path.offsets()
        above = np.append(0, np.cumsum(total > deep))  # log-probabilities only fall, so these stand at a text's head
        lo = offsets[docs]
        near = above[offsets[docs + 1]] - above[lo]
        hi = np.minimum(offsets[docs + 1], lo + near + 1)
        begin = lo + drawn[docs]
        n = np.maximum(0, hi - begin)
        at = np.repeat(begin, n) + _ramp(n)
        owner = np.repeat(docs, n)
        phi = np.where(at > np.repeat(lo, n), total[at - 1], 0.0)
        first = pool.first[path.pos[at]]
        n = pool.first[path.pos[at] + 1] - first
        edge = np.repeat(first, n) + _ramp(n)
        rank = _ramp(n)
        at, owner, phi = np.repeat(at, n), np.repeat(owner, n), np.repeat(phi, n)
        beside = edge != path.edge[at]
        at, owner, phi, edge, rank = at[beside], owner[beside], phi[beside], edge[beside], rank[beside]
        phi = phi + pool.logp[edge]
        index = at - offsets[owner]
        u = _unit(mix(self.seeds[owner] + mix(index.astype(np.uint64) * _U(64) + rank.astype(np.uint64) + _U((turn << 48) + (1 << 60)))))
        g = phi - np.log(np.exp(np.minimum(phi - value[owner], 700)) - np.log(u))  # Gumbel(phi) cut off at the value
        return {"doc": owner, "g": g, "at": index, "edge": edge, "turn": np.full(len(g), turn)}

    def samples(self, k: int) -> tuple[list[Paths], np.ndarray, np.ndarray]:
        """The k paths, their texts' log-probabilities (k, n; -inf: no more segmentations), and kappa (n)."""
        docs, node, paths = np.arange(self.n), None, []
        value = -np.log(-np.log(_unit(mix(self.seeds + _U(1 << 61)))))
        found = np.full((k, self.n), -np.inf)
        opened = {c: np.empty(0, float if c == "g" else np.int64) for c in ("doc", "g", "at", "edge", "turn")}
        for turn in range(k):
            path, drawn = self._draw(turn, docs, paths, node)
            paths.append(path)
            total = path.sums(self.pool.logp[path.edge])
            found[turn, docs] = total[path.ends[docs] - 1]
            need = k - turn
            new = self._siblings(turn, path, total, drawn, value, docs, _DEEP)
            near = new["g"] > _NEAR
            new = {c: x[near] for c, x in new.items()}
            count = np.bincount(opened["doc"][opened["g"] > _NEAR], minlength=self.n) + np.bincount(new["doc"], minlength=self.n)
            few = docs[count[docs] < need]
            if len(few):  # too few values above what was skipped: draw all
                again, keep = self._siblings(turn, path, total, drawn, value, few, -np.inf), ~np.isin(new["doc"], few)
                new = {c: np.concatenate([x[keep], again[c]]) for c, x in new.items()}
            opened = {c: np.concatenate([opened[c], new[c]]) for c in opened}
            order = np.lexsort((opened["edge"], opened["at"], opened["turn"], -opened["g"], opened["doc"]))
            opened = {c: x[order] for c, x in opened.items()}
            rank = _ramp(np.bincount(opened["doc"], minlength=self.n))
            opened = {c: x[rank < need] for c, x in opened.items()}
            heads = np.flatnonzero(np.diff(opened["doc"], prepend=-1))
            node = {c: x[heads] for c, x in opened.items()}
            docs = node["doc"]
            value = np.full(self.n, -np.inf)
            value[docs] = node["g"]
            if turn < k - 1:
                rest = np.ones(len(opened["g"]), bool)
                rest[heads] = False
                opened = {c: x[rest] for c, x in opened.items()}
        return paths, found, value

    def ids(self, path: Paths) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the paths (unknown characters as bytes), and offsets by text."""
        piece, v = self.pool.piece[path.edge], self.pool.v
        lone = np.flatnonzero(piece < 0)
        if not len(lone):
            return piece.astype(np.int32), path.offsets()
        codes, inverse = np.unique(-1 - piece[lone].astype(np.int64), return_inverse=True)
        spelt = [[v.byte_ids[b] for b in chr(c).encode()] for c in codes]
        width = np.ones(len(piece), np.int64)
        sizes = np.array([len(x) for x in spelt])
        width[lone] = sizes[inverse]
        out = np.repeat(piece, width)
        at = np.cumsum(width)[lone] - width[lone]
        flat, head = np.concatenate([np.array(x) for x in spelt]), np.cumsum(sizes) - sizes
        to = np.repeat(at, width[lone]) + _ramp(width[lone])
        out[to] = flat[np.repeat(head[inverse], width[lone]) + _ramp(width[lone])]
        return out.astype(np.int32), np.append(0, np.cumsum(width))[path.offsets()]


def decode(ids: Iterable[int], bytes_of: list[bytes]) -> bytes:
    """The text of piece ids, without the mark that encoding puts before it."""
    return b"".join(map(bytes_of.__getitem__, ids))[1:]


def round_trips(ids: np.ndarray, ends: np.ndarray, texts: list[bytes], real: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Of every text whether its ids (from ends[i] to ends[i + 1]; none where it is not real) decode to it."""
    pool = _pool_of(vocabulary)
    whole = b"".join(map(pool.bytes_of.__getitem__, ids.tolist()))
    at = np.append(0, np.cumsum(pool.width[ids]))[ends].tolist()
    return np.array([not r or whole[a + 1 : b] == t for r, a, b, t in zip(real.tolist(), at[:-1], at[1:], texts, strict=True)], bool)


def row_seeds(keys: list, seed: int = SEED) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(repr(k).encode(), seed) for k in keys], np.uint64)


def log_inclusion(logp: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(logp - kappa))), also where the probability is far below what a double holds."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        x = logp - kappa
        return np.where(np.isneginf(kappa), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700))))))


_pools: dict[Vocabulary, Pool] = {}


def _pool_of(vocabulary: Vocabulary) -> Pool:
    if vocabulary not in _pools:
        _pools.clear()
        _pools[vocabulary] = Pool(vocabulary)
    pool = _pools[vocabulary]
    pool.turn()
    return pool


def encode(texts: list[bytes], keys: list, vocabulary: Vocabulary, k: int = SAMPLES, seed: int = SEED) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Of k samples (ids, offsets by text), then log-probabilities and log-inclusion scores (k, n)."""
    sampler = Sampler(_pool_of(vocabulary), [t.decode("utf-8", "replace") for t in texts], row_seeds(keys, seed))
    paths, logp, kappa = sampler.samples(k)
    return [sampler.ids(p) for p in paths], logp, log_inclusion(logp, kappa)


def sampled_encodings(docs: DataFrame, vocabulary: Vocabulary, k: int = SAMPLES, with_ids: bool = False) -> DataFrame:
    """The report of SCHEMA for every row of docs; with_ids adds ids, the piece ids of every sample."""
    schema = SCHEMA + (", ids array<array<int>>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def report(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keys = texts_of(batch), batch.column("doc_id").to_pylist()
        found, logp, inclusion = encode(texts, keys, vocabulary, k)
        back = [round_trips(ids, ends, texts, np.isfinite(logp[t]), vocabulary) for t, (ids, ends) in enumerate(found)]
        rows = []
        for i, text in enumerate(texts):
            have = [t for t in range(k) if np.isfinite(logp[t, i])]
            ids = [found[t][0][found[t][1][i] : found[t][1][i + 1]] for t in have]
            digest = hashlib.sha256()
            for x in ids:
                digest.update(len(x).to_bytes(8, "little") + x.tobytes())
            row = [keys[i], len(text) - len(text.translate(None, _NOT_TAIL)), len(have), [len(x) for x in ids], [float(logp[t, i]) for t in have], [float(inclusion[t, i]) for t in have], digest.hexdigest(), all(back[t][i] for t in have)]
            rows.append(row + [ids] * with_ids)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.bool_()] + [pa.list_(pa.list_(pa.int32()))] * with_ids

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_groups(whole, most_bytes=1 << 19):
                yield report(batch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, schema)


def decoded(encoded: DataFrame, vocabulary: Vocabulary, column: str = "ids", to: str = "text") -> DataFrame:
    """encoded with the text of each row's piece ids (array<int>; null stays null) as the last column, or in place
    of a column of that name. Rows are decoded in Arrow batches, without a shuffle."""
    kept = [c for c in encoded.columns if c != to]
    out = encoded.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*out.schema.fields, StructField(to, StringType())])
    at = kept.index(column)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _pool_of(vocabulary).bytes_of
        for batch in batches:
            texts = [None if x is None else decode(x, bytes_of) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*kept, to])

    return out.mapInArrow(of, schema)
