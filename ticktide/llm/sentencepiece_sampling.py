"""SentencePiece encoding and decoding, with sampled segmentations without replacement.

A text's segmentations into a model's pieces form a lattice. A segmentation's
probability is the product of its pieces' weights, normalised over the lattice by
the sums from each node to the end; a piece of merge rank r weighs (r + 10) to the
power -alpha. Gumbel top-k draws k distinct segmentations: the search keeps disjoint
parts of the lattice (a path's prefix and the pieces that may not follow it) by
their perturbed log mass, which bounds every segmentation in the part from above,
takes the best part, draws its best segmentation, and splits the rest of the part
at each node of that path, as A-star sampling does. What comes out first, second,
and so on are the k largest perturbed segmentations. The next bound (kappa) gives
each its inclusion score 1 - exp(-exp(log p - kappa)).

No piece of the model crosses certain places (before white space, around a line
end, between letters and a mark); the lattice falls into units there, and a unit's
nodes are worked out once while it is in the worker's table. A chunk's distinct
words are parted into units once, and many of its documents are drawn together.
Draws are hashes of the row's key, a seed, and the place in the text, so they do
not depend on batches, partitions or retries.

Defined cases: null and empty texts have one segmentation, without pieces; a text
with fewer than k segmentations gives all it has, with inclusion 1; characters that
the model does not have become its byte pieces; U+2581 decodes to a space, as the
model defines; rows with the same key draw alike; an empty table gives an empty
result; other columns are not read. Memory follows the longest text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens

SPACE = "▁"
#: Units whose nodes a worker keeps, and characters of text whose units are looked up together.
MOST_UNITS, CHUNK = 200_000, 1 << 20
#: Units whose nodes are worked out together, and characters of text that are drawn together.
ADDED, DRAWN = 1 << 13, 1 << 17
#: In the place of a running sum, above all draws: the only edge of its node.
ALONE = 3.0
#: Stands after a unit's last character; no code point.
STOP = 0x10FFFF + 1
#: Places that no piece crosses; checked against the model when it is read.
_UNITS = re.compile(r"▁*[^\W_²]+(?=[.,;:!?▁\n]|\Z)|[.,;:!?]+(?=[▁\n]|\Z)|▁*[^▁\n]+|▁+|\n")
_CROSSING = re.compile(r"[^▁]▁|\n.|.\n|[^\W_²][.,;:!?]", re.S)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salted(key: np.ndarray, salt: int) -> np.ndarray:
    return _mixed(key + np.uint64(salt * 0xD1342543DE82EF95 % 2**64))


def spread(place: np.ndarray) -> np.ndarray:
    return place.astype(np.uint64) * _GOLDEN


def unit_interval(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) for sums of salted keys and spread places."""
    out = (_mixed(x) >> np.uint64(12)).astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


def uniforms(key: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) for (key, place, salt)."""
    return unit_interval(salted(key, salt) + spread(place))


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.data, self.n = np.empty(1 << 12, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            bigger = np.empty(max(2 * len(self.data), self.n + len(values)), self.data.dtype)
            bigger[: self.n] = self.data[: self.n]
            self.data = bigger
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Numbers(dict):
    """Numbers units in the order they come; the new ones are listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Lattice:
    """Nodes and edges of units. An edge is a piece; a node's edges stand together, the longest first."""

    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weight: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        words: list[tuple[str, int]] = []
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                if _CROSSING.search(piece):
                    raise ValueError(f"piece {piece!r} crosses a unit's edge")
                words.append((piece, i))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
            rank = -score if -1e8 < score <= 0 and not model.is_byte(i) else 1e5
            weight.append(-alpha * np.log(rank + 10))
        self.weight = np.array(weight)
        self.spellings = pa.array(self.bytes_of, pa.large_binary())
        self._trie(words)
        self._clear()

    def _trie(self, words: list[tuple[str, int]]) -> None:
        step: dict[tuple[int, int], int] = {}
        own = [-1]
        for word, i in words:
            node = 0
            for c in word:
                nxt = step.get((node, ord(c)))
                if nxt is None:
                    nxt = step[node, ord(c)] = len(own)
                    own.append(-1)
                node = nxt
            own[node] = i
        keys = np.array([(a << 21) | c for a, c in step], np.int64)
        to = np.fromiter(step.values(), np.int64, len(step))
        # open addressing: a key stands in the first free slot from its hash on, -1 in a free one
        bits = (8 * len(keys)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            own_slot = self.keys[slot] == keys
            self.to[slot[own_slot]] = to[own_slot]
            keys, to, slot = keys[~own_slot], to[~own_slot], (slot[~own_slot] + 1) & self.mask
        self.own = np.array(own, np.int64)
        self.root = np.full(0x110000, -1, np.int32)
        for (a, c), b in step.items():
            if a == 0:
                self.root[c] = b

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _GOLDEN) >> self.shift).view(np.int64)

    def _steps(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the keys that the trie has, and the nodes they lead to."""
        slot = self._slots(keys)
        found = self.keys[slot]
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            found[more] = self.keys[slot[more]]
            more = more[(found[more] != keys[more]) & (found[more] >= 0)]
        good = np.flatnonzero(found == keys)
        return good, self.to[slot[good]]

    def _clear(self) -> None:
        self.units = Numbers()
        if not hasattr(self, "begin"):
            self.begin, self.spaced = Grown(np.int64), Grown(bool)
            self.first, self.degree = Grown(np.int64), Grown(np.int32)
            self.piece, self.next = Grown(np.int32), Grown(np.int32)
            self.lp, self.cum = Grown(np.float64), Grown(np.float64)
        for grown in vars(self).values():
            if isinstance(grown, Grown):
                grown.n = 0

    def nodes(self, texts: list[str | None]) -> list[np.ndarray]:
        """The first nodes of the units of each text.

        A run of spaces begins a unit, so in a text whose spaces stand alone between
        words each word has its own units: those of the distinct words are looked up.
        """
        if len(self.units) > MOST_UNITS:
            self._clear()
        plain = np.fromiter(map(_parted, texts), bool, len(texts))
        whole = [_UNITS.findall(normalised(t)) for t, p in zip(texts, plain) if not p]
        try:
            words = pc.split_pattern(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string()), " ")
        except UnicodeEncodeError:  # lone surrogates
            plain[:] = False
            whole = [_UNITS.findall(normalised(t)) for t in texts]
            words = pa.array([], pa.list_(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        of_words = _UNITS.findall(normalised(pc.binary_join(distinct, pa.scalar(" ", pa.large_string()))[0].as_py()))
        rest = sum(map(len, whole))
        found = np.fromiter(map(self.units.__getitem__, chain(of_words, chain.from_iterable(whole))), np.int64, len(of_words) + rest)
        for at in range(0, len(self.units.new), ADDED):
            self._add(self.units.new[at : at + ADDED])
        self.units.new = []
        begin = self.begin.data[found]
        at = np.flatnonzero(self.spaced.data[found[: len(of_words)]])
        many = np.diff(np.append(at, len(of_words)))
        word = coded.indices.to_numpy(zero_copy_only=False)
        flat = begin[_ragged(at[word], many[word])]
        cuts = np.append(0, np.cumsum(many[word]))[words.offsets.to_numpy()].tolist()
        of_plain, of_whole, k = pairwise(cuts), iter(whole), len(of_words)
        out = []
        for p in plain.tolist():
            if p:
                a, b = next(of_plain)
                out.append(flat[a:b])
            else:
                size = len(next(of_whole))
                out.append(begin[k : k + size])
                k += size
        return out

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, piece, degree, first): all pieces in the text, a node's together, longest first.

        Characters without a piece of their own get an edge for their bytes.
        """
        at = np.flatnonzero(codes != STOP)
        state = self.root[codes[at]].astype(np.int64)
        alive = state >= 0
        found = []
        where, state, length = at[alive], state[alive], 1
        degree = np.zeros(len(codes), np.int64)
        single = np.zeros(len(codes), bool)
        while len(where):
            own = self.own[state]
            hit = own >= 0
            begin = where[hit]
            if length == 1:
                single[begin] = True
            found.append((begin, length, own[hit], degree[begin]))
            degree[begin] += 1
            good, state = self._steps((state << 21) | codes[where + length])
            where, length = where[good], length + 1
        bare = at[~single[at]]
        found.append((bare, 1, -1 - codes[bare], degree[bare]))
        degree[bare] += 1
        first = np.cumsum(degree) - degree
        n = int(degree.sum())
        start, end, piece = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        for begin, length, own, rank in found:
            slot = first[begin] + degree[begin] - 1 - rank
            start[slot], end[slot], piece[slot] = begin, begin + length, own
        return start, end, piece, degree, first

    def _add(self, units: list[str]) -> None:
        size = np.fromiter(map(len, units), np.int64, len(units))
        stops = np.cumsum(size + 1) - 1
        codes = np.full(int(stops[-1]) + 1, STOP, np.int64)
        inside = np.ones(len(codes), bool)
        inside[stops] = False
        codes[inside] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        start, end, piece, degree, first = self._edges(codes)
        lp = self.weight[np.maximum(piece, 0)]
        odd = np.flatnonzero(piece < 0)
        lp[odd] = self.weight[self.byte_id[0]] * _utf8_length(-1 - piece[odd])
        # sums from each node to its unit's end, by the distance from there
        distance = np.repeat(stops, size + 1) - np.arange(len(codes))
        order = np.argsort(distance.astype(np.uint16) if distance.max() < 1 << 16 else distance, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(distance))])
        total = np.zeros(len(codes))
        ordered = degree[order]
        upto = np.append(0, np.cumsum(ordered))
        edges = _ragged(first[order], ordered)
        far, step = end[edges], lp[edges]
        for a, b in pairwise(cuts[1:].tolist()):
            if a < b:
                x, y = upto[a], upto[b]
                begin = upto[a:b] - x
                value = total[far[x:y]]
                value += step[x:y]
                high = np.maximum.reduceat(value, begin)
                value -= np.repeat(high, ordered[a:b])
                total[order[a:b]] = high + np.log(np.add.reduceat(np.exp(value, out=value), begin))
        lp = np.minimum(lp + total[end] - total[start], 0.0)
        alone = degree[start] == 1
        lp[alone] = 0.0
        p = np.exp(lp)
        run = np.cumsum(p)
        own = np.flatnonzero(degree)
        cum = run - np.repeat((run - p)[first[own]], degree[own])
        cum[first[own] + degree[own] - 1] = 2.0
        cum[alone] = ALONE
        base_node, base_edge = self.first.n, self.piece.n
        self.begin.extend(stops - size + base_node)
        self.spaced.extend(codes[stops - size] == ord(SPACE))
        self.first.extend(first + base_edge)
        self.degree.extend(degree)
        for grown, values in (
            (self.piece, piece), (self.next, end + base_node), (self.lp, lp), (self.cum, cum),
        ):
            grown.extend(values)

    def piece_ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, and how many each edge gives: one of bytes gives several."""
        piece = self.piece.data[edges]
        many = np.ones(len(edges), np.int32)
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return piece.astype("<u4"), many
        codes = -1 - piece[odd].astype(np.int64)
        many[odd] = _utf8_length(codes)
        out = np.repeat(piece, many).astype("<u4")
        first = (np.cumsum(many) - many)[odd]
        plain = codes < 128
        out[first[plain]] = self.byte_id[codes[plain]]
        for at, c in zip(first[~plain].tolist(), codes[~plain].tolist()):
            raw = list(chr(c).encode("utf-8", "surrogatepass"))
            out[at : at + len(raw)] = self.byte_id[raw]
        return out, many

    def ids(self, edges: np.ndarray) -> np.ndarray:
        return self.piece_ids(edges)[0]

    def spelled(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of piece ids put together, and the end of each piece's bytes."""
        if not len(ids):
            return b"", np.empty(0, np.int64)
        _, offsets, data = self.spellings.take(pa.array(ids, pa.uint32())).buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)
        return data.slice(0, int(ends[-1])).to_pybytes() if ends[-1] else b"", ends[1:]

    def walk(self, node: np.ndarray, key: np.ndarray, doc: np.ndarray, place: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Drawn edges from each node to its unit's end, and their number per node.

        ``key`` of each text, and ``doc``, the text of each node.
        """
        first, degree, cum, nxt = self.first.data, self.degree.data, self.cum.data, self.next.data
        count = np.zeros(len(node), np.int64)
        many = degree[node]
        who = np.flatnonzero(many)
        now, many, steps = node[who], many[who], []
        far = spread(place * 256)
        while len(who):
            t = len(steps)
            if t % 256 == 0:
                mark = salted(key, salt + t // 256)[doc] + far
            edge = first[now]
            several = np.flatnonzero(many > 1)
            if len(several):
                u = unit_interval(mark[who[several]] + spread(np.array([t % 256])))
                e = edge[several]
                more = np.flatnonzero(u >= cum[e])
                e[more] += 1
                while len(more):
                    more = more[u[more] >= cum[e[more]]]
                    e[more] += 1
                edge[several] = e
            steps.append((who, edge))
            count[who] = t + 1
            now = nxt[edge]
            many = degree[now]
            live = np.flatnonzero(many)
            who, now, many = who[live], now[live], many[live]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for t, (w, e) in enumerate(steps):
            out[begin[w] + t] = e
        return out, count


def _utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indexes begin[i] to begin[i] + count[i] - 1, one run after the other."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


class Paths:
    """One drawn path per document, and the parts of the lattice that it leaves."""

    def __init__(self, lattice: Lattice, docs: np.ndarray, edges: np.ndarray, units: np.ndarray, count: np.ndarray):
        self.docs, self.edges, self.units, self.count = docs, edges, units, count
        self.begin = np.cumsum(count) - count
        lp = lattice.lp.data[edges]
        run = np.cumsum(lp)
        self.before = run - lp - np.repeat((run - lp)[np.minimum(self.begin, max(len(lp) - 1, 0))], count) if len(lp) else lp
        total = np.add.reduceat(np.append(lp, 0.0), self.begin) if len(count) else np.empty(0)
        self.total = np.where(count > 0, total, 0.0)
        self.value, self.top = np.empty(0), np.empty(0)

    def split(self, lattice: Lattice, key: np.ndarray, top: np.ndarray, kept: np.ndarray, salt: int) -> None:
        """Perturbed masses, before they are held below ``top``, of what leaves the path at or after piece ``kept`` of each document."""
        self.top = top
        place = _ragged(np.zeros(len(self.count), np.int64), self.count)
        leaves = lattice.cum.data[self.edges] != ALONE
        if kept.any():
            leaves &= place >= np.repeat(kept, self.count)
        live = np.flatnonzero(leaves)
        row = np.repeat(np.arange(len(self.count)), self.count)[live]
        u = unit_interval(salted(key, salt)[self.docs][row] + spread(place[live]))
        rest = np.log(np.maximum(1.0 - np.exp(lattice.lp.data[self.edges[live]]), 1e-300))
        self.value = np.full(len(self.edges), -np.inf)
        self.value[live] = self.before[live] + rest - np.log(-np.log(u))

    def best(self, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest bound of each document, and where it is. Bounds rise with the masses."""
        value, at = np.full(n_docs, -np.inf), np.zeros(n_docs, np.int64)
        some = self.count > 0
        if not some.any():
            return value, at
        high = np.maximum.reduceat(self.value, self.begin[some])
        where = np.flatnonzero(self.value == np.repeat(high, self.count[some]))
        k = np.searchsorted(where, self.begin[some])
        left = high > -np.inf
        high[left] = -np.logaddexp(-self.top[some][left], -high[left])
        value[self.docs[some]], at[self.docs[some]] = high, where[k]
        return value, at


def drawn_paths(lattice: Lattice, nodes: list[np.ndarray], key: np.ndarray, k: int) -> tuple[list[tuple], np.ndarray]:
    """k segmentations of each text, best first, as (paths, their texts, perturbed log p) per rank; and kappa of each text.

    ``key``: an unsigned 64-bit number for each text.
    """
    n = len(nodes)
    size = np.array([len(x) for x in nodes], np.int64)
    base = np.cumsum(size) - size
    flat = np.concatenate(nodes) if n else np.empty(0, np.int64)
    doc_of = np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) - base[doc_of]
    top = -np.log(-np.log(uniforms(key, np.zeros(n, np.int64), 1)))
    edges, count = lattice.walk(flat, key, doc_of, place, 1000)
    per_doc = np.bincount(doc_of, weights=count, minlength=n).astype(np.int64)
    path = Paths(lattice, np.arange(n), edges, np.repeat(np.arange(len(flat)), count), per_doc)
    path.split(lattice, key, top, np.zeros(n, np.int64), 2)
    paths = [path]
    #: parts whose first piece may not be one of several: per round, (bound, path, place, edges ruled out)
    extras: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]] = []
    drawn = [(path, np.arange(n), top)]
    for rank in range(1, k + 1):
        value = np.full(n, -np.inf)
        source, at = np.full(n, -1), np.zeros(n, np.int64)
        for j, p in enumerate(paths):
            v, a = p.best(n)
            better = v > value
            value[better], source[better], at[better] = v[better], j, a[better]
        for j, x in enumerate(extras):
            better = x[0] > value
            value[better], source[better] = x[0][better], len(paths) + j
        kappa = value
        if rank == k:
            break
        who = np.flatnonzero(value > -np.inf)
        if not len(who):
            break
        origin, spot, ruled = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
        for d in who.tolist():
            j = int(source[d])
            if j < len(paths):
                origin[d], spot[d] = j, at[d]
                ruled[d] = [int(paths[j].edges[at[d]])]
                paths[j].value[at[d]] = -np.inf
            else:
                x = extras[j - len(paths)]
                origin[d], spot[d], ruled[d] = x[1][d], x[2][d], x[3][d]
                x[0][d] = -np.inf
        # the piece at the spot, among those not ruled out
        u = uniforms(key[who], np.full(len(who), rank), 3)
        chosen = np.empty(len(who), np.int64)
        heads, units, left = [], np.empty(len(who), np.int64), np.empty(len(who))
        for i, d in enumerate(who.tolist()):
            p = paths[origin[d]]
            row = int(np.searchsorted(p.docs, d))
            edge = int(p.edges[spot[d]])
            node = int(np.searchsorted(lattice.first.data[: lattice.first.n], edge, "right")) - 1
            a = int(lattice.first.data[node])
            may = [e for e in range(a, a + int(lattice.degree.data[node])) if e not in ruled[d]]
            p_may = np.exp(lattice.lp.data[may])
            weights = np.cumsum(p_may)
            pick = min(int(np.searchsorted(weights, u[i] * weights[-1], "right")), len(may) - 1)
            chosen[i] = may[pick]
            heads.append(p.edges[p.begin[row] : spot[d]])
            units[i] = p.units[spot[d]]
            spare = weights[-1] - p_may[pick]
            left[i] = p.before[spot[d]] + (np.log(spare) if spare > 1e-300 and len(may) > 1 else -np.inf)
        # then the rest of its unit, and the units after it
        ends = base[who] + size[who]
        n_after = ends - units - 1
        after = _ragged(units + 1, n_after)
        begins = np.cumsum(n_after + 1) - (n_after + 1)
        starts = np.empty(int((n_after + 1).sum()), np.int64)
        own = np.empty_like(starts)
        is_head = np.zeros(len(starts), bool)
        is_head[begins] = True
        starts[is_head], own[is_head] = lattice.next.data[chosen], units
        starts[~is_head], own[~is_head] = flat[after], after
        text = np.repeat(who, n_after + 1)
        tail, count = lattice.walk(starts, key, text, own - base[text], 1000 * (rank + 1))
        row = np.repeat(np.arange(len(who)), n_after + 1)
        n_tail = np.bincount(row, weights=count, minlength=len(who)).astype(np.int64)
        n_head = np.array([len(h) for h in heads], np.int64)
        total = n_head + 1 + n_tail
        begin = np.cumsum(total) - total
        new, new_units = np.empty(int(total.sum()), np.int64), np.empty(int(total.sum()), np.int64)
        head_at = _ragged(begin, n_head)
        new[head_at] = np.concatenate(heads)
        new_units[head_at] = np.concatenate(
            [paths[origin[d]].units[spot[d] - h : spot[d]] for d, h in zip(who.tolist(), n_head.tolist(), strict=True)]
        )
        new[begin + n_head], new_units[begin + n_head] = chosen, units
        tail_at = _ragged(begin + n_head + 1, n_tail)
        new[tail_at], new_units[tail_at] = tail, np.repeat(own, count)
        path = Paths(lattice, who, new, new_units, total)
        path.split(lattice, key, value[who], n_head + 1, 2 + 10 * rank)
        bound = np.full(n, -np.inf)
        g = left - np.log(-np.log(uniforms(key[who], np.full(len(who), rank), 4)))
        bound[who] = np.where(left > -np.inf, -np.logaddexp(-value[who], -g), -np.inf)
        for i, d in enumerate(who.tolist()):
            ruled[d] = [*ruled[d], int(chosen[i])]
        where = np.zeros(n, np.int64)
        where[who] = begin + n_head
        paths.append(path)
        extras.append((bound, np.full(n, len(paths) - 1), where, ruled))
        drawn.append((path, who, value[who]))
    return drawn, kappa


def _inclusion(lp: float, kappa: float) -> float:
    near = lp - kappa if kappa > -np.inf else np.inf
    return float(-np.expm1(-np.exp(min(near, 700.0))))


def draw(lattice: Lattice, nodes: list[np.ndarray], key: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(text, rank, edges, log p, perturbed log p, inclusion) of k segmentations of each text, best first."""
    drawn, kappa = drawn_paths(lattice, nodes, key, k)
    for rank, (path, who, value) in enumerate(drawn):
        for i, d in enumerate(who.tolist()):
            lp = float(path.total[i])
            yield d, rank, path.edges[path.begin[i] : path.begin[i] + path.count[i]], lp, float(value[i]), _inclusion(lp, kappa[d])


def draw_encoded(
    lattice: Lattice, nodes: list[np.ndarray], key: np.ndarray, k: int, decoded: bool
) -> Iterator[tuple[int, int, bytes, float, float, float, bytes]]:
    """(text, rank, ids, log p, perturbed log p, inclusion, bytes decoded from the ids), all texts of a rank together."""
    drawn, kappa = drawn_paths(lattice, nodes, key, k)
    for rank, (path, who, value) in enumerate(drawn):
        ids, many = lattice.piece_ids(path.edges)
        ends = np.append(0, np.cumsum(many, dtype=np.int64))
        begin, end = ends[path.begin], ends[path.begin + path.count]
        raw, (text, stops) = ids.tobytes(), lattice.spelled(ids) if decoded else (b"", np.zeros(len(ids), np.int64))
        stops = np.append(0, stops)
        columns = zip(who.tolist(), begin.tolist(), end.tolist(), stops[begin].tolist(), stops[end].tolist(), path.total.tolist(), value.tolist())
        for d, a, b, x, y, lp, v in columns:
            yield d, rank, raw[4 * a : 4 * b], lp, v, _inclusion(lp, kappa[d]), text[x:y]


def normalised(text: str | None) -> str:
    """Spaces marked, and one added before, as the model does."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _parted(text: str | None) -> bool:
    """Whether the text's spaces stand alone between its words."""
    return bool(text) and text[0] != " " and text[-1] != " " and "  " not in text and SPACE not in text


_lattices: dict[tuple[str, float], Lattice] = {}


def lattice_of(path: str, alpha: float) -> Lattice:
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattice(path, alpha)
    return _lattices[path, alpha]


def text_of(spelled: bytes) -> str:
    """The text of pieces' bytes, without the space that encoding added."""
    return (spelled[1:] if spelled[:1] == b" " else spelled).decode("utf-8", "replace")


def decode_ids(lattice: Lattice, ids: np.ndarray) -> str:
    """The text of piece ids, without the space that encoding added."""
    return text_of(b"".join(map(lattice.bytes_of.__getitem__, ids.tolist())))


def _runs(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of together at most ``most`` characters, or of one text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def samples(lattice: Lattice, texts: list[str | None], keys: np.ndarray, k: int, how=draw) -> Iterator[tuple]:
    """``how`` (draw, or draw_encoded) over runs of the texts of each chunk."""
    for a, b in _runs(texts, CHUNK):
        nodes = lattice.nodes(texts[a:b])
        for x, y in _runs(texts[a:b], DRAWN):
            for d, *rest in how(lattice, nodes[x:y], keys[a + x : a + y], k):
                yield a + x + d, *rest


SAMPLE = "sample int, n_pieces long, log_prob double, perturbed double, inclusion double"


def encode_samples(
    docs: DataFrame, path: str, k: int, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
    texts: bool = False,
) -> DataFrame:
    """k sampled segmentations of each row, best perturbed first.

    (id, sample, n_pieces, log_prob, perturbed, inclusion, ids); with ``digests``,
    instead of the ids their CRC-32 and that of the text decoded from them; with
    ``texts``, the ids and that text as the last columns in either case.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"), F.col(text_col).alias("text")
    )
    last = [("ids_crc32", "long", pa.int64()), ("text_crc32", "long", pa.int64())] if digests else []
    last += [("ids", "binary", pa.binary())] if texts or not digests else []
    last += [("text", "string", pa.string())] if texts else []
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path, alpha)
        own = [t for _, _, t in last]
        names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", *(c for c, _, _ in last)]
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            keys = batch["key"].to_numpy(zero_copy_only=False).view(np.uint64)
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), *own]

            def rows():
                how = partial(draw_encoded, decoded=digests or texts)
                for d, rank, raw, lp, value, inclusion, spelled in samples(lattice, batch["text"].to_pylist(), keys, k, how):
                    text = text_of(spelled)
                    end = (zlib.crc32(raw), zlib.crc32(text.encode())) if digests else ()
                    end += (raw,) if texts or not digests else ()
                    end += (text,) if texts else ()
                    size = 64 + (len(raw) if texts or not digests else 0) + (4 * len(text) if texts else 0)
                    yield size, (ids[d], rank, len(raw) // 4, lp, value, inclusion, *end)

            yield from tokens.batched(rows(), pa.schema(list(zip(names, kinds))))

    return rows.mapInArrow(run, f"doc_id {kind}, {SAMPLE}, {', '.join(f'{c} {t}' for c, t, _ in last)}")


def encode_best(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the model's own segmentation."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            ids = model.encode([x or "" for x in batch["text"].to_pylist()], num_threads=1)
            raw = [np.array(x, "<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with ``ids``) with ``text`` instead of the ids."""
    rest = [c for c in encoded.columns if c != "ids"]
    rows = encoded.select(*rest, "ids")
    schema = rows.select(*rest, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path, 1.0)
        for batch in batches:
            texts = [None if x is None else decode_ids(lattice, np.frombuffer(x, "<u4")) for x in batch["ids"].to_pylist()]
            columns = [batch[c] for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*rest, "text"])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: two distinct segmentations of every whole text: their ids, and the text they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_samples(docs, tokens.public_path("piece_bpe_32k.model"), k=2, digests=True, texts=True)
