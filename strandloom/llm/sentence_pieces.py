"""SentencePiece encoding by sampling without replacement, and decoding.

A text's segmentations are the paths of a lattice whose edges are pieces. The vocabulary file is a public one; its
merge order gives piece probabilities by Zipf's law (log p = -log(rank + 10), normalised by the lattice itself, times
``theta``). Gumbel top-k: every path has its log-probability plus Gumbel noise, and the k best are k samples without
replacement. Perturbed A* finds them without listing paths: a partial path's priority is the noise maximum over all
its completions, drawn top-down; the best child inherits its parent's maximum, so a popped entry runs straight down
to a full path, and the siblings it passes are the new entries of the queue.

All this is done on exp(-value), where Gumbel maxima are minima of exponential variables. Which edge of a node has
the minimum is independent of how small it is, so one uniform number picks it by the edges' probabilities; and given
the minimum m, the variable of a sibling of probability p is m + E / p, because waiting has no memory. Its value is
phi - log of that, phi being the log-probability of the path so far.

Pieces never span the start of a space run, so a text's lattice is a chain of small ones, which repeat. They are built
once and kept; walks run over all chunks of many texts at once. Noise is a hash of row key, round, place and edge: a
task that is run again, or batches cut elsewhere, give the same samples.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, keep_only

SPACE = "▁"
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+(?![^{SPACE}])|{SPACE}+(?=\n)|\n")
SAMPLES, THETA, SEED = 3, 1.0, 1
SLICE_CHARS = 400_000
CACHE = 180_000  # lattices that a worker keeps (about 150 MB); beyond it, the half that was used most
#: Siblings at nodes below this log-probability phi are left out: one of them reaches a value over -10 with probability
#: e**(phi + 10), under 1e-15, and the k best values of a text lie far above.
LOWEST = -45.0


class Places(dict):
    """Numbers chunks as they are first asked for; ``new`` has those whose lattices are still to be built."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class Vocabulary:
    """Pieces of a SentencePiece model file, their log-weights, and bytes for what has no piece."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.weight = {self.pieces[i]: (i, -theta * math.log(rank[model.get_score(i)] + 10)) for i in plain}
        self.longest = max(map(len, self.weight))
        self.byte_weight = -theta * math.log(n + 10)
        if any(SPACE in p.lstrip(SPACE) for p in self.weight):
            raise ValueError("a piece spans the start of a space run")
        # for each length the hashes, in order, of all beginnings of pieces, with the piece's id (-1: only a beginning) and weight
        starts: list[dict[int, tuple[int, float]]] = [{} for _ in range(self.longest)]
        for p, piece in self.weight.items():
            for n, h in enumerate(hashes(codes([p]))[0].tolist()):
                if n + 1 == len(p):
                    starts[n][h] = piece
                else:
                    starts[n].setdefault(h, (-1, 0.0))
        self.known = []
        for at in starts:
            h = np.array(sorted(at), np.uint64)
            self.known.append((h, np.array([at[x][0] for x in h.tolist()], np.int64), np.array([at[x][1] for x in h.tolist()])))
        self.most = CACHE
        self.clear()
        # decoding: the bytes of each id; a piece's space sign is a space
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def chunks(self, text: str) -> list[str]:
        """The text's parts whose lattices are independent; a literal space sign is marked as a character of its own."""
        if not text:
            return []
        text = text.replace(SPACE, "\0\0") if SPACE in text else text
        return CHUNKS.findall(SPACE + text.replace(" ", SPACE))

    def clear(self) -> None:
        """Forget all lattices."""
        self.room: dict[str, np.ndarray] = {}
        self.place = Places()  # of a chunk in the arrays by chunk
        self.names: list[str] = []
        self.node0 = self.uses = np.empty(0, np.int64)  # by chunk: its first node, and how often it was asked for
        # by node: number of edges (none at a chunk's last node) and the first of them
        self.count, self.first = np.empty(0, np.int32), np.empty(0, np.int32)
        # by edge: node it leads to, piece (or -1 - place of a character without one), node it starts from
        self.to = self.piece = self.owner = np.empty(0, np.int32)
        self.q = self.upto = np.empty(0)  # log-probability of the edge at its node, and the sum of probabilities up to it

    def trim(self) -> None:
        """Keep the half of the lattices that was used most; what they were used counts half from now on."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        ends = np.append(self.node0[1:], len(self.count))
        sizes = (ends - self.node0)[keep]
        nodes = ranges(self.node0[keep], sizes)
        shift = np.repeat(self.node0[keep] - (np.cumsum(sizes) - sizes), sizes)  # how far each kept node moves
        counts = self.count[nodes].astype(np.int64)
        edges = ranges(self.first[nodes].astype(np.int64), counts)
        moved = np.repeat(shift, counts)
        old = {"count": counts, "first": np.cumsum(counts) - counts, "to": self.to[edges] - moved, "owner": self.owner[edges] - moved, "piece": self.piece[edges], "q": self.q[edges], "upto": self.upto[edges]}
        names, uses = [self.names[i] for i in keep.tolist()], self.uses[keep] // 2
        self.clear()
        for n, c in enumerate(names):
            self.place[c] = n
        self.place.new.clear()
        self.names = names
        for name, x in (old | {"node0": np.cumsum(sizes) - sizes, "uses": uses}).items():
            self.extend(name, x)

    def add(self, chunks: list[str]) -> None:
        """Build the lattices of new ``chunks``, all at once."""
        code, size = codes(chunks), np.array([len(c) for c in chunks], np.int64)
        sums, down = hashes(code)
        sums = np.concatenate([np.zeros(1, np.uint64), sums])
        ends = np.repeat(np.cumsum(size), size)
        at = np.arange(len(code))
        fits, found = at, []  # characters where some piece goes on to length n; (character, length, piece, weight) of the edges
        for n, (known, piece, weight) in enumerate(self.known, 1):
            fits = fits[fits + n <= ends[fits]]
            h = (sums[fits + n] - sums[fits]) * down[fits]
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[k] == h)
            fits, k = fits[hit], k[hit]
            whole = np.flatnonzero(piece[k] >= 0)
            found.append((fits[whole], np.full(len(whole), n), piece[k[whole]], weight[k[whole]]))
            if n == 1:
                bare = np.ones(len(code), bool)
                bare[fits[whole]] = False
                bare = np.flatnonzero(bare)
                size_in_bytes = 1 + (code[bare] > 0x7F) + (code[bare] > 0x7FF) + (code[bare] > 0xFFFF)
                found.append((bare, np.ones(len(bare), np.int64), -1 - (at - (ends - np.repeat(size, size)))[bare], self.byte_weight * size_in_bytes))
        found.reverse()  # longest first: mostly the likeliest, which spares the walk steps
        node, step, piece, w = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.argsort(node, kind="stable")
        node, step, piece, w = node[order], step[order], piece[order], w[order]
        # nodes of the new chunks, ends included: the sum over all ways on from each, from the ends backwards
        node0 = np.cumsum(size + 1) - size - 1
        shift = np.repeat(np.arange(len(chunks)), size)
        count = np.zeros(len(code) + len(chunks), np.int64)
        count[at + shift] = np.bincount(node, minlength=len(code))
        first = np.cumsum(count) - count
        to = node + shift[node] + step
        beta = np.zeros(len(count))
        last, by_size = node0 + size, np.argsort(-size, kind="stable")
        longer = np.searchsorted(-size[by_size], -np.arange(1, size.max() + 1), side="right") if len(size) else []
        for d, k in enumerate(longer, 1):
            x = last[by_size[:k]] - d
            e = ranges(first[x], count[x])
            v = w[e] + beta[to[e]]
            starts = np.cumsum(count[x]) - count[x]
            top = np.maximum.reduceat(v, starts)
            beta[x] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count[x])), starts))
        q = w + beta[to] - beta[node + shift[node]]
        p = np.exp(q)
        upto = np.cumsum(p)
        upto -= np.repeat((upto - p)[first[count > 0]], count[count > 0])
        upto[(first + count - 1)[count > 0]] = 2.0  # the last takes what rounding leaves
        self.names += chunks
        old_nodes, old_edges = len(self.count), len(self.to)
        new = {"node0": node0 + old_nodes, "uses": np.zeros(len(chunks), np.int64), "count": count, "first": first + old_edges, "owner": node + shift[node] + old_nodes, "to": to + old_nodes, "piece": piece, "q": q, "upto": upto}
        for name, x in new.items():
            self.extend(name, x)

    def extend(self, name: str, new: np.ndarray) -> None:
        """Append to an array; its room grows by half, so that little is copied."""
        old, room = len(getattr(self, name)), self.room.get(name)
        if room is None or old + len(new) > len(room):
            self.room[name] = np.empty(3 * (old + len(new)) // 2, getattr(self, name).dtype)
            self.room[name][:old] = getattr(self, name)
            room = self.room[name]
        room[old : old + len(new)] = new
        setattr(self, name, room[: old + len(new)])

    def lattices(self, parts: list[list[str]]) -> np.ndarray:
        """Places of the chunks of ``parts``, one after the other."""
        if len(self.place) > self.most:
            self.trim()
        kind = np.fromiter(map(self.place.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        if self.place.new:
            self.add(self.place.new)
            self.place.new = []
        self.uses += np.bincount(kind, minlength=len(self.uses))
        return kind

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def decode(self, ids) -> str:
        raw = b"".join([self.raw[i] for i in ids])
        text = raw.decode("utf-8", "replace")
        text = text[1:] if text.startswith(" ") else text
        return text.replace("\0\0", SPACE) if "\0\0" in text else text


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of code times a power, mod 2**64, and the powers' inverses: (sum to j - sum to i) * inverse at i is the hash of i..j."""
    if len(_powers[0]) < len(code):
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(len(code), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(code)], dtype=np.uint64), _powers[1][: len(code)]


@lru_cache(maxsize=2)
def vocabulary(path: str, theta: float = THETA) -> Vocabulary:
    return Vocabulary(path, theta)


def forget() -> None:
    """Let go of all that a worker keeps."""
    vocabulary.cache_clear()
    for i, x in enumerate(_powers):
        _powers[i] = x[:1]


def uniform(seed: np.ndarray) -> np.ndarray:
    h = seed + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class Batch:
    """The lattices of some texts in flat arrays."""

    def __init__(self, v: Vocabulary, texts: list[str], keys: np.ndarray, seed: int):
        self.v, self.keys = v, keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)
        parts = [v.chunks(t) for t in texts]
        self.n_chunks = np.array([len(p) for p in parts], np.int64)
        self.first_chunk = np.cumsum(self.n_chunks) - self.n_chunks
        self.text = np.repeat(np.arange(len(texts)), self.n_chunks)
        self.place = np.arange(len(self.text)) - self.first_chunk[self.text]
        self.kind = v.lattices(parts)
        self.node0, self.first, self.count = v.node0, v.first, v.count
        self.to, self.piece, self.owner, self.q, self.upto = v.to, v.piece, v.owner, v.q, v.upto

    def walk(self, round_: int, chunk: np.ndarray, node: np.ndarray, step: np.ndarray) -> list[tuple]:
        """Run from ``node`` of each ``chunk`` to its end. For every node passed: chunk, step, chosen edge, and whether it had others."""
        seen = []
        while len(chunk):
            chosen, forked = self.first[node].astype(np.int64), self.count[node] > 1
            open_ = np.flatnonzero(forked)
            if len(open_):
                u = uniform(self.seeds(round_, chunk[open_], step[open_]))
                edge, more = chosen[open_], np.arange(len(open_))
                while len(more):  # a node's likeliest edges mostly come first, so most stop at once
                    more = more[u[more] >= self.upto[edge[more]]]
                    edge[more] += 1
                chosen[open_] = edge
            seen.append((chunk, step, chosen, forked))
            node, step = self.to[chosen], step + 1
            on = np.flatnonzero(self.count[node])
            chunk, node, step = chunk[on], node[on], step[on]
        return seen

    def seeds(self, round_: int, chunk: np.ndarray, step: np.ndarray) -> np.ndarray:
        """A number for each place of each text: a function of key, round and place alone, whatever their sizes."""
        place = self.place[chunk].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + step.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return self.keys[self.text[chunk]] ^ (place + np.uint64(round_ * 0xA0761D6478BD642F & (1 << 64) - 1))

    def samples(self, k: int) -> tuple[list[list[tuple]], np.ndarray]:
        """For each text its samples (chunk order edges, log-probability, perturbed value), best first, and the bound: the next best perturbed value."""
        n = len(self.n_chunks)
        # entries of the queue: text, perturbed value, log-probability, round of the parent, position in its path, edge
        queue = {c: np.empty(0, t) for c, t in (("text", np.int64), ("value", np.float64), ("phi", np.float64), ("parent", np.int64), ("at", np.int64), ("edge", np.int64))}
        root = np.flatnonzero(self.n_chunks > 0)
        u = uniform(self.keys ^ np.uint64(0xA0761D6478BD642F))
        value = -np.log(-np.log(u))
        paths: list[dict] = []
        live = {"text": root, "value": value[root], "phi": np.zeros(len(root)), "parent": np.full(len(root), -1), "at": np.zeros(len(root), np.int64), "edge": np.full(len(root), -1)}
        bound = np.full(n, -np.inf)
        for round_ in range(k):
            path = self.complete(round_, live, paths)
            paths.append(path)
            fresh = self.siblings(round_, path)
            queue = {c: np.concatenate([queue[c], fresh[c]]) for c in queue}
            # most entries lie far below the best: a text with enough high ones needs no others
            high = queue["value"] > -10
            enough = np.bincount(queue["text"][high], minlength=n) >= k - round_
            use = high | ~enough[queue["text"]]
            queue = {c: x[use] for c, x in queue.items()}
            # each text needs the best entry now, and later as many as rounds are left
            order = np.lexsort((queue["edge"], queue["at"], -queue["value"], queue["text"]))
            text = queue["text"][order]
            nth = np.arange(len(text)) - np.searchsorted(text, text)
            order = order[nth < k - round_]
            queue = {c: x[order] for c, x in queue.items()}
            heads = np.flatnonzero(np.append(True, queue["text"][1:] != queue["text"][:-1])) if len(order) else np.empty(0, np.int64)
            if round_ == k - 1:
                bound[queue["text"][heads]] = queue["value"][heads]
            live = {c: x[heads] for c, x in queue.items()}
            rest = np.ones(len(order), bool)
            rest[heads] = False
            queue = {c: x[rest] for c, x in queue.items()}
        return paths, bound

    def complete(self, round_: int, live: dict, paths: list[dict]) -> dict:
        """Full paths of the entries of ``live`` (one a text): nodes passed in order, with what lies before the branch copied from the parent."""
        old_chunk, old_step, old_edge, old_text = [], [], [], []
        chunk0, node0, step0 = [], [], []
        # what was decided before: the parent's nodes before the branch, and the branch
        for r in range(round_):
            mine = np.flatnonzero(live["parent"] == r)
            if not len(mine):
                continue
            p, t = paths[r], live["text"][mine]
            start = p["start"][t]
            idx = ranges(start, live["at"][mine] - start)
            branch = live["at"][mine]
            old_chunk += [p["chunk"][idx], p["chunk"][branch]]
            old_step += [p["step"][idx], p["step"][branch]]
            old_edge += [p["edge"][idx], live["edge"][mine]]
            c = p["chunk"][branch]
            node = self.to[live["edge"][mine]]
            on = self.count[node] > 0
            later = self.first_chunk[t] + self.n_chunks[t] - c - 1
            more = ranges(c + 1, later)
            chunk0 += [c[on], more]
            node0 += [node[on], self.node0[self.kind[more]]]
            step0 += [p["step"][branch][on] + 1, np.zeros(len(more), np.int64)]
        if round_ == 0:
            every = np.arange(len(self.kind))
            chunk0, node0, step0 = [every], [self.node0[self.kind]], [np.zeros(len(every), np.int64)]
        join = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
        seen = self.walk(round_, join(chunk0), join(node0), join(step0))
        new_chunk, new_step, new_edge, forked = (join([s[i] for s in seen]) for i in range(4))
        n_old = sum(map(len, old_chunk))
        chunk, step = join([*old_chunk, new_chunk]), join([*old_step, new_step])
        # steps of a chunk are 0, 1, ...: a node's place needs no sorting
        steps = np.bincount(chunk, minlength=len(self.kind))
        where = (np.cumsum(steps) - steps)[chunk] + step
        edge = np.empty(len(where), np.int64)
        edge[where] = join([*old_edge, new_edge])
        sorted_chunk = np.repeat(np.arange(len(self.kind)), steps)
        sorted_step = np.arange(len(where)) - np.repeat(np.cumsum(steps) - steps, steps)
        per_text = np.bincount(self.text, weights=steps, minlength=len(self.n_chunks)).astype(np.int64)
        end = np.cumsum(per_text)
        start = end - per_text
        done = np.concatenate([[0.0], np.cumsum(self.q[edge])])
        before = done[:-1] - np.repeat(done[start], per_text)
        value = np.full(len(self.n_chunks), -np.inf)
        value[live["text"]] = live["value"]
        fresh = where[n_old:][forked.astype(bool)]
        fresh = fresh[before[fresh] >= LOWEST]
        return {"chunk": sorted_chunk, "step": sorted_step, "edge": edge, "start": start, "end": end, "phi": done[end] - done[start], "value": value, "before": before, "fresh": fresh, "texts": live["text"]}

    def siblings(self, round_: int, path: dict) -> dict:
        """The edges not taken at the forks that ``path`` passed for the first time, with their perturbed values."""
        at = path["fresh"]
        chunk, step, chosen = path["chunk"][at], path["step"][at], path["edge"][at]
        node = self.owner[chosen]
        first, count = self.first[node].astype(np.int64), self.count[node].astype(np.int64)
        nth = ranges(np.zeros(len(at), np.int64), count)
        own = np.repeat(np.arange(len(at)), count)
        edge = first[own] + nth
        other = np.flatnonzero(edge != chosen[own])
        own, nth, edge = own[other], nth[other], edge[other]
        text = self.text[chunk[own]]
        phi = path["before"][at][own]
        wait = -np.log(uniform(self.seeds(round_, chunk, step)[own] + (nth + 1).astype(np.uint64))) * np.exp(-self.q[edge])
        value = phi - np.log(wait + np.exp(np.minimum(phi - path["value"][text], 700)))
        return {"text": text, "value": value, "phi": phi + self.q[edge], "parent": np.full(len(edge), round_), "at": at[own], "edge": edge}

    def ids(self, path: dict) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids along the paths of ``path['texts']`` and how many each text has."""
        rows = ranges(path["start"][path["texts"]], (path["end"] - path["start"])[path["texts"]])
        piece = self.piece[path["edge"][rows]]
        text = self.text[path["chunk"][rows]]
        low = np.flatnonzero(piece < 0)
        if len(low):
            runs = [self.v.byte_ids(self.v.names[self.kind[c]][-1 - p]) for c, p in zip(path["chunk"][rows][low].tolist(), piece[low].tolist())]
            times = np.ones(len(piece), np.int64)
            times[low] = [len(r) for r in runs]
            piece = np.repeat(piece, times)
            text = np.repeat(text, times)
            piece[piece < 0] = np.concatenate(runs)
        return piece.astype(np.int32), np.bincount(text, minlength=len(self.n_chunks))[path["texts"]]


def sample_batch(v: Vocabulary, texts: list[str], keys: np.ndarray, k: int, seed: int = SEED) -> dict[str, np.ndarray]:
    """Columns row, sample, ids (with sizes), log_prob, perturbed, inclusion of the samples of ``texts``."""
    b = Batch(v, texts, keys, seed)
    paths, bound = b.samples(k)
    out = {c: [] for c in ("row", "sample", "size", "ids", "log_prob", "perturbed")}
    for r, p in enumerate(paths):
        rows = p["texts"]
        ids, sizes = b.ids(p)
        for c, x in (("row", rows), ("sample", np.full(len(rows), r)), ("size", sizes), ("ids", ids), ("log_prob", p["phi"][rows]), ("perturbed", p["value"][rows])):
            out[c].append(x)
    empty = np.flatnonzero(b.n_chunks == 0)
    for c, x in (("row", empty), ("sample", np.zeros(len(empty), int)), ("size", np.zeros(len(empty), int)), ("log_prob", np.zeros(len(empty))), ("perturbed", np.full(len(empty), np.inf))):
        out[c].append(x)
    got = {c: np.concatenate(x) if x else np.empty(0) for c, x in out.items()}
    with np.errstate(over="ignore"):
        got["inclusion"] = -np.expm1(-np.exp(got["log_prob"] - bound[got["row"]]))
    return got


def encode(docs: DataFrame, path: str, k: int = SAMPLES, theta: float = THETA, seed: int = SEED, key: str = "doc_id", lattices: int = CACHE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """key, sample (0 is the best perturbed), ids, log_prob, perturbed value and inclusion score; up to k rows a row of ``docs``.

    Samples of a row are distinct segmentations of its whole text; a text with fewer segmentations has fewer rows.
    ``inclusion`` is the probability that the segmentation is among the samples given the best value left out, and 1
    when nothing was left out. Null and empty texts give one sample without ids. A row's samples depend on its key,
    its text and ``seed`` only: rows that repeat a key and text repeat the samples. Other columns are ignored.
    ``path`` names a vocabulary file that every executor has. ``lattices`` and
    ``slice_chars`` (of texts sampled together) bound a worker's memory and change no result.
    """
    kind = docs.schema[key].dataType

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("pieces", forget)
        v = vocabulary(path, theta)
        v.most = lattices
        for b in batches:
            texts, ids, keys = b.column(1), b.column(0), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = pc.utf8_length(texts).to_pylist()
            at = 0
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size + sizes[end] <= slice_chars):
                    size += sizes[end]
                    end += 1
                got = sample_batch(v, texts.slice(at, end - at).to_pylist(), keys[at:end], k, seed)
                offsets = np.concatenate([[0], np.cumsum(got["size"])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(got["ids"].astype(np.int32)))
                rows = ids.slice(at, end - at).take(pa.array(got["row"].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([rows, pa.array(got["sample"].astype(np.int32)), lists, pa.array(got["log_prob"]), pa.array(got["perturbed"]), pa.array(got["inclusion"])], names=[key, "sample", "ids", "log_prob", "perturbed", "inclusion"])
                at = end
        give_back()

    texts = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("seed"))
    return texts.mapInArrow(each, f"{key} {kind.simpleString()}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``encoded`` with a column text made of its ids. Null ids give null; unknown and control ids give nothing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = [None if ids is None else v.decode(ids) for ids in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(each, f"{schema}, text string")


def default_path() -> str:
    """The vocabulary file of the queries: ``STRANDLOOM_PIECES`` in the driver's environment, else a public one of 32,000 pieces."""
    return os.environ.get("STRANDLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def query(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode(docs, path or default_path())
