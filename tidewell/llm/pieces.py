"""SentencePiece encoding and decoding, and sampled segmentations without replacement.

All segmentations of a text into the model's pieces are paths of a lattice; a path's weight
is e to the power of ``alpha`` times its pieces' scores. Gumbel top-k: give every path its
log-probability plus independent Gumbel noise and take the k greatest, which is a sample
without replacement. They are found without listing paths, by best-first (A-star) search:
a node of the search stands for all paths that begin alike, its priority is the greatest
perturbed value among them, drawn top down, so the bound is exact and the first k leaves
popped are the sample. Pieces never reach over the blank that opens a word, so the lattice is
a chain of words' lattices, and those of equal words are built once for a batch.
"""

from __future__ import annotations

import heapq
import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
SAMPLES, ALPHA, SEED = 3, 0.002, 3
BATCH_CHARS = 2_500_000
_UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_CP_BITS = np.int64(21)
_SLOT_BITS = 20


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)


class Model:
    """The model's pieces as a trie over code points, with scores; a character that no
    piece begins with falls back to its UTF-8 bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.processor
        self.size = p.get_piece_size()
        self.texts, self.bytes, scores = [], {}, np.zeros(self.size)
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i in range(self.size):
            text = p.id_to_piece(i)
            scores[i] = p.get_score(i)
            if p.is_byte(i):
                self.bytes[int(text[3:5], 16)] = i
                self.texts.append(bytes([int(text[3:5], 16)]))
                continue
            if p.is_control(i) or p.is_unknown(i):
                self.texts.append(b"")
                continue
            self.texts.append(text.replace(BLANK, " ").encode())
            at = 0
            for c in text:
                at = nodes.setdefault((at, ord(c)), len(ends))
                if at == len(ends):
                    ends.append(-1)
            ends[at] = i
        self.longest = max(len(p.id_to_piece(i)) for i in range(self.size) if not p.is_byte(i))
        self.ends = np.array(ends)
        keys = np.array([(a << 21) | c for a, c in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(nodes.values()))[order]
        slots = _slot(self.keys)
        self.slot_key = np.full(1 << _SLOT_BITS, -1, dtype=np.int64)
        self.slot_next = np.full(1 << _SLOT_BITS, -1, dtype=np.int64)
        self.slot_key[slots], self.slot_next[slots] = self.keys, self.next
        self.shared = np.bincount(slots, minlength=1 << _SLOT_BITS) > 1
        usual = scores[scores > -1e8]
        self.scores = np.maximum(scores, usual.min() - 10)  # pieces that are there for blanks alone have -1e9
        self.fallback = float(usual.min()) - 10

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none: by a hash table, and by search where keys
        share a slot."""
        keys = (states << _CP_BITS) | codes
        slots = _slot(keys)
        out = np.where(self.slot_key[slots] == keys, self.slot_next[slots], -1)
        unsure = np.flatnonzero(self.shared[slots] & (out < 0))
        if len(unsure):
            at = np.minimum(np.searchsorted(self.keys, keys[unsure]), len(self.keys) - 1)
            out[unsure] = np.where(self.keys[at] == keys[unsure], self.next[at], -1)
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; the blank that encoding puts in front is taken off."""
        return b"".join(map(self.texts.__getitem__, np.asarray(ids, dtype=np.int64).tolist())).decode("utf-8", "replace")[1:]

    def expand(self, ids: np.ndarray, extra: list[list[int]]) -> np.ndarray:
        """Ids with those from ``size`` on replaced by the bytes that they stand for."""
        bare = np.flatnonzero(ids >= self.size)
        if not len(bare):
            return ids
        own = [extra[i] for i in (ids[bare] - self.size).tolist()]
        sizes = np.ones(len(ids), dtype=np.int64)
        sizes[bare] = [len(x) for x in own]
        out = np.repeat(ids, sizes)
        for at, x in zip((np.cumsum(sizes) - sizes)[bare].tolist(), own, strict=True):
            out[at : at + len(x)] = x
        return out


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """The model of a file, once for each worker."""
    return Model(path)


def units(text: str) -> list[str]:
    """The words of a text as the model sees it, each with the blanks before it."""
    return _UNIT.findall(BLANK + text.replace(" ", BLANK))


class Lattices:
    """The lattices of distinct words. Node (word, end) is numbered by end, then by
    word; edges are sorted by the node they end in, ``weight`` is the probability of the
    edge being the last one of a path to that node."""

    def __init__(self, m: Model, words: list[str], alpha: float):
        words = sorted(words, key=len, reverse=True)
        self.place = {w: i for i, w in enumerate(words)}
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.sizes = sizes
        longest = int(sizes[0]) if len(sizes) else 0
        having = len(words) - np.searchsorted(sizes[::-1], np.arange(longest + 1), side="left")
        self.base = np.concatenate([[0], np.cumsum(having)])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        start = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at, state = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        whole = np.zeros(len(codes), dtype=bool)
        for d in range(m.longest):
            inside = start[at] + d < sizes[word[at]]
            at, state = at[inside], state[inside]
            state = m.step(state, codes[at + d])
            at, state = at[state >= 0], state[state >= 0]
            if not len(at):
                break
            piece = m.ends[state]
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), d + 1), piece[hit]))
            if d == 0:
                whole[at[hit]] = True
        bare = np.flatnonzero(~whole)
        chars, which = np.unique(codes[bare], return_inverse=True)
        self.extra = [[m.bytes[b] for b in chr(c).encode("utf-8", "replace")] for c in chars.tolist()]
        found.append((bare, np.ones(len(bare), dtype=np.int64), m.size + which))
        at, length, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        score = alpha * np.where(piece < m.size, m.scores[np.minimum(piece, m.size - 1)], m.fallback)
        node = self.base[start[at] + length] + word[at]
        order = np.argsort(node, kind="stable")
        self.piece, node, score = piece[order], node[order], score[order]
        self.source = (self.base[start[at]] + word[at])[order]
        total = int(self.base[-1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=total))])
        log = np.zeros(total)
        for j in range(1, longest + 1):
            lo, hi = int(self.base[j]), int(self.base[j + 1])
            e, f = int(self.first[lo]), int(self.first[hi])
            log[lo:hi] = np.logaddexp.reduceat(log[self.source[e:f]] + score[e:f], self.first[lo:hi] - e)
        self.log_weight = np.minimum(0.0, log[self.source] + score - log[node])
        weight = np.exp(self.log_weight)
        self.cumulated = np.concatenate([[0.0], np.cumsum(weight)])
        self.starts = len(words)
        self._refer(weight, node)

    def _refer(self, weight: np.ndarray, node: np.ndarray) -> None:
        """Every word's reference path, by the likeliest last edge from the end on: most
        draws are this path, and are found by one comparison. ``stay`` is the probability
        of the reference path to a node."""
        total, starts = len(self.first) - 1, self.starts
        top = np.zeros(total)
        if len(weight):
            top[starts:] = np.maximum.reduceat(weight, self.first[starts:-1])
        hits = np.flatnonzero(weight == top[node])[::-1]
        self.main = np.zeros(total, dtype=np.int64)
        self.main[node[hits]] = hits  # the first of equals is written last
        self.stay = np.ones(total)
        for j in range(1, len(self.base) - 1):
            lo, hi = int(self.base[j]), int(self.base[j + 1])
            self.stay[lo:hi] = top[lo:hi] * self.stay[self.source[self.main[lo:hi]]]
        at = self.base[self.sizes] + np.arange(starts)
        self.word_stay = self.stay[at]
        live, who, edges = np.arange(starts), [], []
        while len(live):
            edge = self.main[at]
            who.append(live)
            edges.append(edge)
            at = self.source[edge]
            more = at >= starts
            at, live = at[more], live[more]
        self.ref_edges, self.ref_size = _ragged(who, edges, starts)
        self.ref_first = np.cumsum(self.ref_size) - self.ref_size
        logs = np.concatenate([[0.0], np.cumsum(self.log_weight[self.ref_edges])])
        self.ref_log = logs[self.ref_first + self.ref_size] - logs[self.ref_first]
        # What all other edges into an edge's node weigh: added up, not taken off 1, where the edge is the likeliest.
        with np.errstate(divide="ignore"):
            self.others = np.log1p(-np.minimum(weight, 1.0))
        if len(weight):
            likeliest = self.main[starts:]
            masked = weight.copy()
            masked[likeliest] = 0.0
            sums = np.add.reduceat(masked, self.first[starts:-1])
            with np.errstate(divide="ignore"):
                self.others[likeliest] = np.log(sums)
            # Sums too small for doubles are added up as logarithms.
            for n in np.flatnonzero((sums < 1e-290) & (np.diff(self.first[starts:]) > 1)).tolist():
                edges = np.arange(self.first[starts + n], self.first[starts + n + 1])
                self.others[likeliest[n]] = np.logaddexp.reduce(self.log_weight[edges[edges != likeliest[n]]])
        self.ref_rest = self._rest(self.ref_edges, self.ref_size)

    def _rest(self, edges: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """By path, given as ``sizes`` edges from its end, the logarithm of what all other paths of its word weigh: the sum over
        the nodes at which they leave it."""
        if not len(edges):
            return np.full(len(sizes), -np.inf)
        own = self.log_weight[edges]
        first = np.cumsum(sizes) - sizes
        before = np.cumsum(own) - own
        before = before - np.repeat(before[first], sizes)
        return np.logaddexp.reduceat(before + self.others[edges], first)

    def draw(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One path for each word given: (pieces in order, edges from the end, number of them by
        word, log-probability by word, that of all its other paths). A word gets its reference path or, by the same number,
        one of the others, which is drawn from its end with the reference's mass taken off."""
        u = _uniform(keys, 0)
        live = np.flatnonzero(u >= self.word_stay[words])
        log, sizes, rest = self.ref_log[words], self.ref_size[words], self.ref_rest[words]
        log[live] = 0.0
        node = self.base[self.sizes[words[live]]] + words[live]
        on = np.ones(len(live), dtype=bool)
        who, edges = [], []
        step = 1
        while len(live):
            lo, hi = self.first[node], self.first[node + 1]
            below, above = self.cumulated[lo], self.cumulated[hi]
            main = self.main[node]
            gap = np.where(on, self.cumulated[main + 1] - self.cumulated[main], 0.0)
            left = gap * (1.0 - self.stay[self.source[main]])
            t = _uniform(keys[live], step) * (above - below - gap + left)
            keep = on & ((t < left) | (above - below - gap <= 0))
            t = np.maximum(t - left, 0.0) * on + t * ~on
            x = below + t
            x = np.where(on & (x >= self.cumulated[main]), x + gap, x)
            edge = np.clip(np.searchsorted(self.cumulated, x, side="right") - 1, lo, hi - 1)
            edge = np.where(keep, main, edge)
            slipped = on & ~keep & (edge == main)  # rounding at the reference's border
            edge = np.where(slipped, np.where(main > lo, main - 1, np.minimum(main + 1, hi - 1)), edge)
            on = on & (edge == main)
            log[live] += self.log_weight[edge]
            who.append(live)
            edges.append(edge)
            node = self.source[edge]
            more = node >= self.starts
            node, live, on = node[more], live[more], on[more]
            step += 1
        if not who:
            back = _gather(self.ref_edges, self.ref_first[words], sizes)
        else:
            other, count = _ragged(who, edges, len(words))
            sizes = np.where(count > 0, count, sizes)
            rest[count > 0] = self._rest(other, count[count > 0])
            pool = np.concatenate([self.ref_edges, other])
            place = len(self.ref_edges) + np.cumsum(count) - count
            back = _gather(pool, np.where(count > 0, place, self.ref_first[words]), sizes)
        ends = np.cumsum(sizes)
        turned = np.repeat(2 * ends - sizes - 1, sizes) - np.arange(len(back))
        return self.piece[back[turned]], back, sizes, log, rest

    def _leaving(self, word: int, taken: list[tuple[int, ...]]) -> list[tuple[float, tuple[int, ...], int, set[int]]]:
        """Where other paths leave those of ``taken``: (log of what they weigh, the edges up to there, the node, the edges taken there)."""
        out, todo = [], [(int(self.base[self.sizes[word]]) + word, (), 0.0, taken)]
        while todo:
            node, path, log, along = todo.pop()
            own = {x[len(path)] for x in along}
            if len(own) == 1:
                mass = float(self.others[next(iter(own))])
            else:
                left = self._open(node, own)
                mass = float(np.logaddexp.reduce(self.log_weight[left])) if left else -np.inf
            if mass > -np.inf:
                out.append((log + mass, path, node, own))
            for e in sorted(own):
                if int(self.source[e]) >= self.starts:
                    further = along if len(own) == 1 else [x for x in along if x[len(path)] == e]
                    todo.append((int(self.source[e]), (*path, e), log + float(self.log_weight[e]), further))
        return out

    def _open(self, node: int, own: set[int]) -> list[int]:
        return [e for e in range(int(self.first[node]), int(self.first[node + 1])) if e not in own]

    def log_rest(self, word: int, taken: list[tuple[int, ...]]) -> float:
        """The logarithm of what all paths of a word but those of ``taken`` weigh."""
        masses = [x[0] for x in self._leaving(word, taken)]
        top = max(masses, default=-np.inf)
        return top + math.log(sum(math.exp(x - top) for x in masses)) if masses else -np.inf

    def draw_other(self, word: int, taken: list[tuple[int, ...]], dice: random.Random) -> tuple[tuple[int, ...], float]:
        """A path (edges from the end) that isn't one of ``taken``, drawn from the rest, and its
        log-probability: first where it leaves those, then by which edge, then its beginning."""

        def chosen(logs: np.ndarray) -> int:
            mass = np.cumsum(np.exp(logs - logs.max()))
            return min(int(np.searchsorted(mass, dice.random() * mass[-1], side="right")), len(logs) - 1)

        ways = self._leaving(word, taken)
        masses = np.array([x[0] for x in ways])
        if not ways:
            return (), -np.inf
        _, path, at, own = ways[chosen(masses)]
        edges = self._open(at, own)
        path = [*path, edges[chosen(self.log_weight[edges])]]
        node = int(self.source[path[-1]])
        while node >= self.starts:
            lo, hi = int(self.first[node]), int(self.first[node + 1])
            path.append(lo + chosen(self.log_weight[lo:hi]))
            node = int(self.source[path[-1]])
        return tuple(path), float(self.log_weight[path].sum())


def _ragged(who: list[np.ndarray], items: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Items of each owner, in the order of the steps that they came in, and how many."""
    if not who:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    owner, item = np.concatenate(who), np.concatenate(items)
    return item[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)


def _gather(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[first : first + size] for all owners, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that keys and a step determine."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (step + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (_mix(keys + salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class _Text:
    """The search of one text: its sampled paths, and the heap of what else there is."""

    def __init__(self, words: np.ndarray, seed: int):
        self.words, self.seed = words, seed
        self.paths: list[tuple] = []  # (pieces, edges from the end, sizes, logs, perturbed, rests)
        self.heap: list[tuple] = []


def _keys(jobs: list[_Text], begins: list[int], salt: int) -> np.ndarray:
    """A key for every word from ``begins`` on: of the text's seed, the number of its
    samples and the word's position."""
    sizes = np.array([len(j.words) - b for j, b in zip(jobs, begins, strict=True)])
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1])) - np.repeat(ends - sizes - np.array(begins), sizes)
    own = np.array([j.seed + 97 * len(j.paths) + salt for j in jobs], dtype=np.uint64)
    return _mix(_mix(np.repeat(own, sizes)) + at.astype(np.uint64))


def _push(todo: list[tuple[_Text, int, float | None]], most: int) -> None:
    """Pushes the siblings of every text's last path: for each of its words from a position on,
    all other paths of that word behind the same words. At that position some paths are taken
    already: what the others weigh there is given. No more than ``most`` can still be popped."""
    todo = [t for t in todo if t[1] < len(t[0].words)]
    if not todo:
        return
    jobs, begins, given = zip(*todo, strict=True)
    last = [j.paths[-1] for j in jobs]
    logs = np.concatenate([p[3][b:] for p, b in zip(last, begins, strict=True)])
    sizes = np.array([len(j.words) - b for j, b in zip(jobs, begins, strict=True)])
    first = np.cumsum(sizes) - sizes
    sums = np.cumsum(logs) - logs
    base = np.array([float(p[3][:b].sum()) if b else 0.0 for p, b in zip(last, begins, strict=True)])
    before = sums - np.repeat(sums[first] - base, sizes)
    rest = np.concatenate([p[5][b:] for p, b in zip(last, begins, strict=True)])
    for i, own in zip(first.tolist(), given, strict=True):
        if own is not None:
            rest[i] = own
    perturbed = np.repeat(np.array([p[4] for p in last]), sizes)
    with np.errstate(divide="ignore"):
        noise = np.log(-np.log1p(-_uniform(_keys(list(jobs), list(begins), 41), 0)))
        value = -np.logaddexp(-perturbed, noise - (before + rest))
    value[rest == -np.inf] = -np.inf
    owner = np.repeat(np.arange(len(jobs)), sizes)
    for _ in range(most):
        top = np.maximum.reduceat(value, first)
        hits = np.flatnonzero(value == top[owner])
        hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
        for i, v in zip(hits.tolist(), value[hits].tolist(), strict=True):
            if v > -np.inf:
                j = int(owner[i])
                heapq.heappush(jobs[j].heap, (-v, len(jobs[j].paths) - 1, begins[j] + i - int(first[j])))
        value[hits] = -np.inf


def _piece_slice(path: tuple, begin: int, end: int) -> np.ndarray:
    ends = np.cumsum(path[2])
    return path[0][(ends[begin - 1] if begin else 0) : (ends[end - 1] if end else 0)]


def sample_texts(m: Model, texts: list[str], seeds: list[int], k: int = SAMPLES, alpha: float = ALPHA) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations, best first: (ids, log-probability,
    perturbed log-probability, log of the inclusion probability). Fewer if there are fewer."""
    split = [units(t) if t else [] for t in texts]
    flat = list(chain.from_iterable(split))
    lattices = Lattices(m, list(set(flat)), alpha)
    numbers = np.fromiter(map(lattices.place.__getitem__, flat), np.int64, len(flat))
    parts = np.split(numbers, np.cumsum([len(own) for own in split])[:-1]) if split else []
    jobs = [_Text(words, seed) for words, seed in zip(parts, seeds, strict=True)]
    used: list[dict] = [{} for _ in jobs]

    def suffixes(todo: list[tuple[int, int]]) -> list[tuple]:
        """Draws the words from a position on, for several texts at once."""
        words = [jobs[j].words[b:] for j, b in todo]
        keys = _keys([jobs[j] for j, _ in todo], [b for _, b in todo], 0)
        pieces, back, sizes, logs, rests = lattices.draw(np.concatenate(words), keys)
        ends = np.cumsum([len(w) for w in words])
        piece_ends = np.concatenate([[0], np.cumsum(sizes)])
        out, at = [], 0
        for end in ends.tolist():
            a, b = piece_ends[at], piece_ends[end]
            out.append((pieces[a:b], back[a:b], sizes[at:end], logs[at:end], rests[at:end]))
            at = end
        return out

    live = [j for j, job in enumerate(jobs) if len(job.words)]
    if live:
        roots = _uniform(_mix(np.array([jobs[j].seed for j in live], dtype=np.uint64)), 77)
        roots = -np.log(-np.log(np.clip(roots, 1e-300, 1 - 1e-16)))
        for j, part, root in zip(live, suffixes([(j, 0) for j in live]), roots.tolist(), strict=True):
            jobs[j].paths.append((*part[:4], root, part[4]))
        _push([(jobs[j], 0, None) for j in live], k)
    for number in range(1, k):
        popped = []
        for j in live:
            job = jobs[j]
            while job.heap:
                value, parent, at = heapq.heappop(job.heap)
                old = job.paths[parent]
                ends = np.cumsum(old[2])
                own = tuple(old[1][(ends[at - 1] if at else 0) : ends[at]].tolist())
                key = (at, _piece_slice(old, 0, at).tobytes())
                taken = used[j].setdefault(key, {})
                taken[own] = float(old[3][at])
                dice = random.Random(job.seed + 131 * len(job.paths))
                path, log = lattices.draw_other(int(job.words[at]), list(taken), dice)
                if path:
                    popped.append((j, parent, at, -value, path, log, dict(taken)))
                    taken[path] = log
                    break
        rest = [(j, at + 1) for j, _, at, *_ in popped if at + 1 < len(jobs[j].words)]
        drawn = iter(suffixes(rest)) if rest else iter(())
        none = np.zeros(0, np.int64)
        grown = []
        for j, parent, at, value, path, log, taken in popped:
            job, old = jobs[j], jobs[j].paths[parent]
            tail = next(drawn) if at + 1 < len(job.words) else (none, none, none, np.zeros(0), np.zeros(0))
            ends = np.cumsum(old[2])
            a = int(ends[at - 1]) if at else 0
            new = (
                np.concatenate([old[0][:a], lattices.piece[list(path)][::-1], tail[0]]),
                np.concatenate([old[1][:a], np.array(path, np.int64), tail[1]]),
                np.concatenate([old[2][:at], [len(path)], tail[2]]),
                np.concatenate([old[3][:at], [log], tail[3]]),
                value,
                np.concatenate([old[5][:at], [0.0], tail[4]]),
            )
            job.paths.append(new)
            grown.append((job, at, lattices.log_rest(int(job.words[at]), [*taken, path])))
        _push(grown, k - number)
    out = []
    for job in jobs:
        bound = -job.heap[0][0] if job.heap else -np.inf
        rows = []
        for pieces, _, _, logs, value, _ in job.paths:
            log = float(logs.sum())
            x = log - bound
            included = 0.0 if x == np.inf else (float(np.log(-np.expm1(-np.exp(min(x, 700.0))))) if x > -30 else x)
            rows.append((m.expand(pieces, lattices.extra), log, float(value), included))
        if not len(job.words):
            rows.append((np.zeros(0, np.int64), 0.0, 0.0, 0.0))
        out.append(rows)
    return out


SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, decoded string"


def _run(docs: DataFrame, path: str, k: int, alpha: float, seed: int, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            while at < len(ids):
                texts, size, begin = [], 0, at
                while at < len(ids) and (not texts or size < BATCH_CHARS):
                    texts.append(batch.column(1)[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                seeds = [xxhash.xxh64_intdigest(f"{i}", seed) >> 1 for i in ids[begin:at]]
                found = sample_texts(m, texts, seeds, k, alpha)
                rows = [row(m, i, t, n, *s) for i, t, own in zip(ids[begin:at], texts, found, strict=True) for n, s in enumerate(own, 1)]
                yield _batch(rows, schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, schema)


def sample_segmentations(docs: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Up to ``k`` distinct sampled segmentations of every whole text, with their scores
    and the text that their ids decode to.

    ``log_prob`` is a segmentation's log-probability, ``perturbed`` that with its Gumbel
    noise, by which samples are ranked, and ``log_inclusion`` the logarithm of the probability
    to be among the k given the greatest value left out (0 if all are in). Noise is seeded
    by doc_id, so a row's samples don't depend on its partition; rows of one doc_id and text get
    the same ones. A null or empty text has the one segmentation without ids. The model writes blanks as ▁, so a ▁
    of a text comes back as a blank. No path is too unlikely to be drawn: a text with three segmentations has three samples. Runs where the
    rows lie, without a shuffle; other columns are ignored; an empty table gives no rows.
    """
    return _run(docs, path, k, alpha, seed, SCHEMA, lambda m, i, t, n, ids, a, b, c: (i, n, ids, a, b, c, m.decode(ids)))


DIGEST = (
    "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, "
    "round_trip boolean"
)


def sample_digests(docs: DataFrame, path: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``sample_segmentations`` with a checksum in place of ids, and whether they decode to
    the text; nothing as long as a text leaves the worker."""

    def row(m: Model, i, text, n, ids, a, b, c) -> tuple:
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        return i, n, len(ids), crc, a, b, c, m.decode(ids) == text

    return _run(docs, path, k, alpha, seed, DIGEST, row)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)
    columns = zip(zip(*rows, strict=True), kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in columns], list(names))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the model's own best segmentation; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model(path).processor
        for batch in batches:
            ids = p.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>")
