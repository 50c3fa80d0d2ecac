"""Sampled SentencePiece segmentations without replacement, by perturbed A* search over the lattice of pieces.

A text's segmentations are the paths of a lattice. Each gets a Gumbel-perturbed log-probability; the k largest are k
distinct samples without replacement. The search never lists paths: a frontier holds sets of paths (a fixed prefix and
the arcs already taken behind it), each with the largest perturbed value in it, drawn top-down under the truncation
that its parent sets. The best set is popped, one path is drawn from it, and what remains is split along that path.
The value of the best set left after k pops is the threshold from which inclusion scores follow.

Pieces do not cross the start of a run of spaces or a line break, so the lattice of a text is a chain of small ones,
built once for each distinct chunk of the texts that a task has seen lately.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import documents

MARK = "▁"  # stands for a space
_CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xC6A4A7935BD1E995)  # brings the last character of a piece into the first bits of its hash
_STEP, _PATH, _PLACE = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5), np.uint64(0x9FB21C651E98DF25)
#: Characters of the texts that are searched together; bounds a task's memory besides one longest text.
BLOCK_CHARS = 200_000
#: Distinct chunks whose lattices a task keeps from block to block.
KEPT_CHUNKS = 20_000


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit counters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


@dataclass
class Lattice:
    """Of all chunks: nodes first[c]..last[c] of chunk c, and arcs begin[n]..begin[n+1] of node n, longer pieces first."""

    first: np.ndarray
    last: np.ndarray
    begin: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    log_p: np.ndarray
    cumulative: np.ndarray

    def joined(self, more: Lattice) -> Lattice:
        """Both in one, with the chunks of more behind these."""
        nodes, arcs = np.int32(len(self.begin) - 1), self.begin[-1]
        shifted = [(self.first, more.first + nodes), (self.last, more.last + nodes), (self.begin[:-1], more.begin + arcs), (self.to, more.to + nodes)]
        return Lattice(*map(np.concatenate, [*shifted, (self.piece, more.piece), (self.log_p, more.log_p), (self.cumulative, more.cumulative)]))


class Chunks:
    """The numbers and the lattice of the chunks seen so far; begun afresh where a block finds more than KEPT_CHUNKS."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.numbers, self.lattice = pieces, {}, None

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the chunks of each text, all of which are in the lattice then."""
        if len(self.numbers) > KEPT_CHUNKS:
            self.numbers, self.lattice = {}, None
        known = len(self.numbers)
        lists = [self.pieces.chunks(t) for t in texts]
        new = [c for c in dict.fromkeys(itertools.chain.from_iterable(lists)) if c not in self.numbers]
        self.numbers.update(zip(new, range(known, known + len(new)), strict=True))
        found = [np.fromiter(map(self.numbers.__getitem__, c), np.int64, len(c)) for c in lists]
        del lists
        if new or self.lattice is None:
            more = self.pieces.lattice(new)
            self.lattice = more if self.lattice is None else self.lattice.joined(more)
        return found


class Pieces:
    """A vocabulary of pieces with log-probabilities; characters without a piece fall back to their UTF-8 bytes."""

    def __init__(self, pieces: list[str], log_p: list[float], byte_ids: list[int], byte_log_p: float):
        """Empty strings in pieces (controls, bytes) are never matched; byte_ids holds the id of each byte's piece."""
        self.surface = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            self.surface[i] = bytes([b])
        self.blob = np.frombuffer(b"".join(self.surface), np.uint8)
        self.sizes = np.fromiter(map(len, self.surface), np.int32, len(self.surface))
        self.offsets = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.byte_ids, self.byte_log_p = byte_ids, byte_log_p
        for p in pieces:
            if "\n" in p or re.search(f"[^{MARK}]{MARK}", p):
                raise ValueError(f"piece {p!r} crosses a boundary of chunks")
        self.log_p = np.array(log_p)
        by_length: dict[int, list[tuple[int, int]]] = {}
        self.longest = max((len(p) for p in pieces), default=1)
        # A bit for each length, eight lengths to a table; each worker holds a vocabulary of its own.
        self.prefixes = np.zeros((self.longest // 8 + 1, 1 << 20), np.uint8)
        for i, p in enumerate(pieces):
            h = 0
            for n, ch in enumerate(p, 1):
                h = (h * int(_MULT) + ord(ch) + 1) % (1 << 64)
                mixed = h * int(_SPREAD) % (1 << 64)
                self.prefixes[n >> 3, mixed >> 44] |= 1 << (n & 7)
            if p:
                by_length.setdefault(len(p), []).append((mixed, i))
        self.by_length = {n: tuple(np.array(x, t) for x, t in zip(zip(*sorted(v), strict=True), (np.uint64, np.int64), strict=True)) for n, v in by_length.items()}
        # For the first 16 bits of a hash the place of the first piece that has them, -1 if none has.
        self.places, self.company = {}, {}
        for n, (keys, _) in self.by_length.items():
            short, first, count = np.unique(keys >> np.uint64(48), return_index=True, return_counts=True)
            self.company[n] = int(count.max()) - 1
            self.places[n] = np.full(1 << 16, -1, np.int32)
            self.places[n][short.astype(np.int64)] = first

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a SentencePiece model. Merge-rank scores are no log-probabilities: rank r weighs 1 / (r + 1) then."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)])
        usual = scores[plain]
        if usual.min() < -1000:
            rank = np.cumsum(plain)
            scores = -np.log(rank + 1.0)
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([model.id_to_piece(i) if plain[i] else "" for i in range(n)], scores.tolist(), byte_ids, float(scores[plain].min()))

    def chunks(self, text: str) -> list[str]:
        """The text with its leading mark, cut where no piece can cross."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return _CHUNK.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")

    def lattice(self, chunks: list[str]) -> Lattice:
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n_chars = len(points)
        first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        last = first + lengths
        # Narrow types: the arcs of a block take most of a worker's memory.
        char_node = (np.arange(n_chars) + np.repeat(np.arange(len(chunks)), lengths)).astype(np.int32)
        room = np.repeat(last, lengths).astype(np.int32) - char_node  # characters up to the chunk's end
        # Matches by length: (characters at which they start, pieces).
        matches: list[tuple[int, np.ndarray, np.ndarray]] = []
        active, h, arcs_at = np.arange(n_chars, dtype=np.int32), np.zeros(n_chars, np.uint64), np.zeros(n_chars, np.int32)
        for n in range(1, self.longest + 1):
            if n > 1:
                fits = room[active] >= n
                active, h = active[fits], h[fits]
            h = h * _MULT + points[active + (n - 1)] + np.uint64(1)
            mixed = h * _SPREAD
            short = (mixed >> np.uint64(44)).astype(np.int32)
            alive = np.flatnonzero((self.prefixes[n >> 3][short] & (1 << (n & 7))).astype(bool))
            active, h, mixed, short = active[alive], h[alive], mixed[alive], short[alive]
            if not len(active):
                break
            if n in self.by_length:
                keys, ids = self.by_length[n]
                at = self.places[n][short >> 4]
                may = np.flatnonzero(at >= 0)
                at, whole = at[may], mixed[may]
                for _ in range(self.company[n]):  # pieces of one place follow each other
                    after = np.minimum(at + 1, len(keys) - 1)
                    at = np.where(keys[after] <= whole, after, at)
                hit = np.flatnonzero(keys[at] == whole)
                who = active[may[hit]]
                matches.append((n, who, ids[at[hit]].astype(np.int32)))
                arcs_at[who] += 1
        single = np.zeros(n_chars, bool)
        if matches and matches[0][0] == 1:
            single[matches[0][1]] = True
        bare = np.flatnonzero(~single)
        code = points[bare].astype(np.int64)
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        own_byte = np.array(self.byte_ids)[np.minimum(code, 127)]
        arcs_at[bare] += 1
        # Arcs of a node stand together, longer pieces first.
        begin_char = np.concatenate([[0], np.cumsum(arcs_at)])
        n_arcs = int(begin_char[-1])
        del active, h
        size, piece, score = np.empty(n_arcs, np.int16), np.empty(n_arcs, np.int32), np.empty(n_arcs, np.float32)
        free = begin_char[1:].copy()
        for n, who, ids in [(1, bare, np.where(code < 0x80, own_byte, -1 - code)), *matches]:
            free[who] -= 1
            place = free[who]
            size[place], piece[place] = n, ids
            score[place] = self.log_p[ids] if who is not bare else n_bytes * self.byte_log_p
        del matches, free, points
        src = np.repeat(np.arange(n_chars, dtype=np.int32), arcs_at)
        to = char_node[src] + size
        del size
        # From the chunks' ends: the nodes with so many characters left, and all their arcs.
        beta, log_p = np.zeros(n_chars + len(chunks)), np.empty(n_arcs)
        order = np.argsort(room.astype(np.uint16) if n_chars and room.max() < 65536 else room, kind="stable")
        counts = arcs_at[order]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        arc_order = np.repeat((begin_char[order] - offsets[:-1]).astype(np.int32), counts) + np.arange(n_arcs, dtype=np.int32)
        o_score, o_to, o_node, o_room = score[arc_order], to[arc_order], char_node[order], room[order]
        o_log_p = np.empty(n_arcs)
        del score
        cuts = np.flatnonzero(np.concatenate([[True], o_room[1:] != o_room[:-1], [True]])).tolist() if n_chars else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x, y = offsets[a], offsets[b]
            values = o_score[x:y] + beta[o_to[x:y]]
            starts, count = offsets[a:b] - x, counts[a:b]
            top = np.maximum.reduceat(values, starts)
            total = top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, count)), starts))
            beta[o_node[a:b]] = total
            o_log_p[x:y] = values - np.repeat(total, count)
        log_p[arc_order] = o_log_p
        del arc_order, o_score, o_to, o_log_p
        log_p = np.where(arcs_at[src] == 1, 0.0, np.minimum(log_p, -1e-16))
        per_node = np.zeros(n_chars + len(chunks), np.int64)
        per_node[char_node] = arcs_at
        begin = np.concatenate([[0], np.cumsum(per_node)])
        # Summed arc by arc within each node, so that a node's sums do not depend on what else is in the block.
        cumulative = np.exp(log_p)
        k, nodes = 1, np.flatnonzero(arcs_at > 1)
        while len(nodes):
            at = begin_char[nodes] + k
            cumulative[at] += cumulative[at - 1]
            k, nodes = k + 1, nodes[arcs_at[nodes] > k + 1]
        cumulative[begin_char[1:] - 1] = 1.0
        return Lattice(first, last, begin, to, piece, log_p, cumulative)

    def ids(self, piece: np.ndarray) -> np.ndarray:
        """Piece ids of arcs, with characters that have no piece as the ids of their bytes."""
        if (piece >= 0).all():
            return piece.astype(np.int32)
        out: list[int] = []
        for p in piece.tolist():
            if p >= 0:
                out.append(p)
            else:
                out += [self.byte_ids[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32)

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids, with the leading space that encoding puts in front."""
        size = self.sizes[ids]
        ends = np.cumsum(size, dtype=np.int32)
        if not len(ends):
            return b""
        return self.blob[np.repeat(self.offsets[ids] - (ends - size), size) + np.arange(ends[-1], dtype=np.int32)].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; the leading space is taken off."""
        return self.decoded(np.asarray(ids, np.int64)).decode("utf-8", "replace").removeprefix(" ")


@dataclass
class Sample:
    arcs: np.ndarray
    log_prob: float
    perturbed: float
    inclusion: float = 1.0


def _drawn(lattice: Lattice, node: np.ndarray, end: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Arcs drawn from each node to its end, one path after the other, and how many each path has."""
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(node), np.int64)
    active = np.flatnonzero(node < end)
    node, end, seed = node[active], end[active], seed[active]
    while len(active):
        u = _uniform(seed)
        arc = lattice.begin[node]
        more = np.flatnonzero(lattice.cumulative[arc] < u)
        while len(more):
            arc[more] += 1
            more = more[lattice.cumulative[arc[more]] < u[more]]
        steps.append((active, arc))
        count[active] += 1
        node = lattice.to[arc]
        go = node < end
        active, node, end, seed = active[go], node[go], end[go], seed[go] + _STEP
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], np.int64)
    for k, (who, arc) in enumerate(steps):
        out[begin[who] + k] = arc
    return out, count


def top_k(pieces: Pieces, texts: list[str], seeds: list[int], k: int, chunks: Chunks | None = None) -> tuple[Lattice, list[list[Sample]]]:
    """For each text its k sampled segmentations (fewer if it has fewer), best first, with inclusion scores."""
    chunks = chunks or Chunks(pieces)
    occurrences = chunks.of(texts)
    lattice = chunks.lattice
    chunk_ends = np.zeros(len(lattice.begin), bool)
    chunk_ends[lattice.last] = True
    bases = np.array([xxhash.xxh3_64_intdigest(s.to_bytes(8, "little", signed=True)) for s in seeds], np.uint64)
    found: list[list[Sample]] = [[] for _ in texts]
    frontier: list[list] = [[] for _ in texts]
    # A popped set: text, value, arcs of its prefix, (occurrence, node) behind them, arcs taken before at that node.
    popped = [(d, float(-np.log(-np.log(_uniform(bases[d : d + 1]))[0])), np.empty(0, np.int64), 0, -1, ()) for d in range(len(texts))]
    for turn in range(k):
        starts, ends, seeds_, firsts = [], [], [], []
        for d, _, prefix, at, node, taken in popped:
            ahead = occurrences[d][at:]
            start, end = lattice.first[ahead], lattice.last[ahead]
            base = bases[d : d + 1] + np.array([turn + 1], np.uint64) * _PATH
            first = -1
            if node >= 0:
                a, b = int(lattice.begin[node]), int(lattice.begin[node + 1])
                free = np.array([x for x in range(a, b) if x not in taken])
                p = np.exp(lattice.log_p[free] - lattice.log_p[free].max())
                u = _uniform(base + np.array([len(prefix) + 1], np.uint64) * _STEP)[0]
                first = int(free[min(np.searchsorted(np.cumsum(p), u * p.sum()), len(free) - 1)])
                start[0] = lattice.to[first]
            firsts.append(first)
            starts.append(start)
            ends.append(end)
            seeds_.append(base + np.arange(at, at + len(ahead)).astype(np.uint64) * _PLACE)
        if not popped:
            break
        sizes = np.array([len(x) for x in starts])
        arcs, count = _drawn(lattice, np.concatenate(starts), np.concatenate(ends), np.concatenate(seeds_))
        arc_begin = np.concatenate([[0], np.cumsum(count)])
        occ_begin = np.concatenate([[0], np.cumsum(sizes)])
        heads = [arcs[arc_begin[occ_begin[i]] : arc_begin[occ_begin[i + 1]]] for i in range(len(popped))]
        rest = [np.concatenate([[f], h]) if f >= 0 else h for f, h in zip(firsts, heads, strict=True)]
        _split(lattice, popped, rest, frontier, bases, turn, k - turn)
        for i, (d, value, prefix, at, node, _) in enumerate(popped):
            path = np.concatenate([prefix, rest[i]]) if len(prefix) else rest[i]
            found[d].append(Sample(path, float(lattice.log_p[path].sum()), value))
        popped = []
        for d, sets in enumerate(frontier):
            if sets and turn < k - 1:
                value, _, path_no, index, taken = heapq.heappop(sets)
                path = found[d][path_no].arcs
                # The occurrence that an arc lies in: as many chunks are behind it as arcs before it led to a chunk's last node.
                ended = int(np.count_nonzero(chunk_ends[lattice.to[path[:index]]])) if index else 0
                popped.append((d, -value, path[:index], _nth_full(lattice, occurrences[d], ended), _source(lattice, path[index]), taken))
    for d, samples in enumerate(found):
        bound = -frontier[d][0][0] if frontier[d] else -np.inf
        for s in samples:
            s.inclusion = float(-np.expm1(-np.exp(min(s.log_prob - bound, 700)))) if np.isfinite(bound) else 1.0
    return lattice, found


def _source(lattice: Lattice, arc: int) -> int:
    return int(np.searchsorted(lattice.begin, arc, "right")) - 1


def _nth_full(lattice: Lattice, chunks: np.ndarray, n: int) -> int:
    """The index of the chunk after n chunks that are not empty; empty ones right before it are passed over."""
    full = np.flatnonzero(lattice.last[chunks] > lattice.first[chunks])
    return int(full[n])


def _split(lattice: Lattice, popped: list, rest: list, frontier: list, bases: np.ndarray, turn: int, wanted: int) -> None:
    """Put the best sets that remain of each popped set, split along its drawn path, on the text's frontier."""
    lengths = np.array([len(r) for r in rest])
    full = np.flatnonzero(lengths)
    if not len(full):
        return
    lengths = lengths[full]
    arcs = np.concatenate([rest[i] for i in full])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    log_p = lattice.log_p[arcs]
    before = np.empty(len(arcs))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):  # per text, so that a text's sums are its own
        before[a:b] = np.cumsum(log_p[a:b]) - log_p[a:b]
    left = -np.expm1(log_p)
    for i, at in zip(full.tolist(), begin[:-1].tolist(), strict=True):
        _, _, prefix, _, node, taken = popped[i]
        if taken:
            left[at] = max(0.0, left[at] - np.exp(lattice.log_p[list(taken)]).sum())
            if len(taken) + 1 == lattice.begin[node + 1] - lattice.begin[node]:
                left[at] = 0.0
    fixed = np.array([lattice.log_p[popped[i][2]].sum() for i in full])
    salts = bases[[popped[i][0] for i in full]] + np.array([turn + 1], np.uint64) * _PLACE
    u = _uniform(np.repeat(salts, lengths) + (np.arange(len(arcs)) - np.repeat(begin[:-1], lengths)).astype(np.uint64) * _PATH)
    with np.errstate(divide="ignore"):
        late = np.log(-np.log(u)) - (before + np.repeat(fixed, lengths) + np.log(left))
    owner = np.arange(len(full))
    for _ in range(wanted):
        best = np.minimum.reduceat(late, begin[:-1])
        places = np.flatnonzero((late == np.repeat(best, lengths)) & np.isfinite(late))
        who = np.searchsorted(begin, places, "right") - 1
        who, one = np.unique(who, return_index=True)
        for w, place in zip(owner[who].tolist(), places[one].tolist(), strict=True):
            d, value, prefix, _, _, taken = popped[full[w]]
            index = place - int(begin[w])
            kept = (*taken, int(arcs[place])) if index == 0 else (int(arcs[place]),)
            heapq.heappush(frontier[d], (float(np.logaddexp(-value, late[place])), turn, turn, len(prefix) + index, kept))
        late[places[one]] = np.inf


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The vocabulary of this path, loaded once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces.load(path)
    return _loaded[path]


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, seed: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k rows per input row (fewer where a text has fewer segmentations), numbered by rank from 1.

    Columns: doc_id, rank, n_pieces, log_prob (normalised over the lattice), perturbed, inclusion (the chance that the
    sample holds this segmentation, given the threshold that the search stopped at; for long texts it may be less than a
    double holds, and 0 then), ids_hash, decoded (whether the
    ids decode to the text) and, with_ids, ids. Draws depend on the row's doc_id and seed alone; rows that repeat an id
    and text repeat the samples, and null ids draw as one id. Null and empty texts have one segmentation, without
    pieces. A U+2581 in a text decodes as a space, as in any SentencePiece model.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    names = ["doc_id", "rank", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_hash", "decoded", *["ids"] * with_ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, ids, texts, held = pieces_of(model), [], [], 0
        chunks = Chunks(pieces)
        for batch in batches:
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held >= BLOCK_CHARS:
                    yield rows(chunks, ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield rows(chunks, ids, texts)

    def rows(chunks: Chunks, ids: list, texts: list[str]) -> pa.RecordBatch:
        pieces = chunks.pieces
        mixed = [(i if i is not None else -1) ^ (seed * 0x1F3D5B79) for i in ids]
        lattice, found = top_k(pieces, texts, [(m + (1 << 63)) % (1 << 64) - (1 << 63) for m in mixed], k, chunks)
        out: list[tuple] = []
        lists: list[np.ndarray] = []
        for i, text, samples in zip(ids, texts, found, strict=True):
            plain = (" " * bool(text) + text.replace(MARK, " ")).encode("utf-8", "surrogatepass")
            for rank, s in enumerate(samples, 1):
                own = pieces.ids(lattice.piece[s.arcs])
                lists.append(own)
                hashed = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
                out.append((i, rank, len(own), s.log_prob, s.perturbed, s.inclusion, hashed, pieces.decoded(own) == plain))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
        if with_ids:
            ends = np.cumsum([0, *map(len, lists)])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int32())))
        return pa.record_batch(columns, names)

    schema = "doc_id long, rank int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_hash long, decoded boolean"
    return documents(docs, id_col, text_col).mapInArrow(search, schema + ", ids array<int>" * with_ids)


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column `decoded_text`: the text of the ids; null for null ids."""
    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        pieces = pieces_of(model)
        return ids.map(lambda x: None if x is None else pieces.decode([int(i) for i in x]))

    return rows.withColumn("decoded_text", decode(ids_col))
