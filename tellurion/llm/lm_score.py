"""Language-model scores: a causal self-attention model over subword ids beside a word-unigram base.

The model predicts the next id's class by one attention layer over the last SPAN ids, and the id by its share of its class over all training
documents; both are proper distributions, so a text's score is its log-probability. Texts are scored in windows of STRIDE ids that overlap by SPAN, each id
once, by batched masked attention; what an id contributes as query, key, value and input are rows of tables made once.

The base needs the training count of every word. Words travel as blocks of hashes by range; each range counts its words and returns each document's
partial sums, so no vocabulary is ever in one place.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurion.sources.shared import new_path

from .common import U64, binary, crc_mod, groups, lower, mix, remembered, roomy, row_of, sliced, space, stash, text_bytes, within, word_hashes

#: The attention starts from about so many training documents, those whose ids hash lowest, and then learns from all of them in ROUNDS rounds, each
#: document in one; in a round every part of the documents learns by itself, and the parts' weights are averaged.
FIT_ROWS = 2_000
ROUNDS, ROUND_RATE = 8, 0.005
DIM, CLASSES, GROUPS, SPAN, STRIDE = 16, 256, 16, 16, 32
#: Ids with rows of their own in the model's tables; the others share SHARED rows by class.
OWN, SHARED = 4096, 256
SKETCH, SKETCH_BITS = 24, 24
EPOCHS, RATE, WINDOWS, LEARN_WINDOWS = 3, 0.02, 256, 256
#: Ids that a part learns from at a time.
CHUNK = 400_000
RUN = 1024
_encoders: dict[str, Subwords] = remembered(__name__)


class Subwords:
    """Ids of whole texts, A-Z in lower case, by a vocabulary of byte-pair ranks; the number after its last is the end of a text.

    Runs of bytes that are all white space, or none, are encoded in stretches of RUN bytes at most: the library's time and stack grow with a run.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (self.end + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(x) for x in pieces])
        self.begins = np.cumsum(self.size) - self.size
        # what was looked up: ascending hashes, the last above all; each one's slot; the slots' ids end to end and their bounds
        self.names, self.slots = np.array([2**64 - 1], U64), np.zeros(1, np.int64)
        self.pool, self.bounds_of = np.zeros(0, np.int32), np.zeros(2, np.int64)

    @classmethod
    def of(cls, path: str) -> Subwords:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows end to end, each row's followed by the end, and the rows' n + 1 offsets.

        Texts are cut where no piece of the vocabulary's pattern crosses, and a short stretch that comes again is looked up.
        """
        raw, at = text_bytes(column)
        n = len(raw)
        low = np.zeros(n + _SHORT, np.uint8)
        low[:n] = lower(raw)
        edge = np.zeros(n + 1, bool)  # where a row or part of a run begins: no piece goes on
        edge[at] = edge[_cuts(raw)] = True
        begin = edge.copy()
        begin[:-1] |= (low[:n] == 32) & _ink(low[1 : n + 1]) & ~edge[1:]
        start = np.flatnonzero(begin[:n])
        size = np.diff(np.append(start, n))
        short = size <= _SHORT
        coded = pa.array(_hash(low, start[short], size[short])).dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        first = np.zeros(len(names), np.int64)
        first[codes[::-1]] = np.flatnonzero(short)[::-1]
        of = np.zeros(len(start), np.int64)  # of each stretch, the one whose ids it has
        of[short], of[~short] = codes, len(names) + np.arange(len(start) - len(codes))
        ids, many = self._looked_up(names, lambda which: self._pieces(low, start[first[which]], size[first[which]]))
        rest, more = self._pieces(low, start[~short], size[~short])
        ids = np.concatenate([ids, rest, [self.end]])
        many = np.concatenate([many, more, [1]])
        place = np.searchsorted(start, at[1:])
        of = np.insert(of, place, len(many) - 1)  # each row's end
        size = many.take(of)
        ends = np.cumsum(size)
        out = np.repeat((np.cumsum(many) - many).take(of) - ends + size, size)
        out += np.arange(len(out))
        return ids.astype(np.int32).take(out), np.concatenate([[0], ends[place + np.arange(len(place))]])

    def _pieces(self, low: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches of low end to end, and how many each has. Those that begin with a space before a character follow others without a seam."""
        seams = np.flatnonzero((size < 2) | (low.take(start) != 32) | ~_ink(low.take(start + 1)))
        cuts = np.unique(np.concatenate([[0], seams, [len(start)]])).tolist()
        text, bounds = low.tobytes(), np.stack([start, start + size], 1).tolist()
        rows = [self.encoding.encode_ordinary(b"".join([text[a:b] for a, b in bounds[lo:hi]]).decode("utf-8")) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.fromiter(chain.from_iterable(rows), np.int32, sum(map(len, rows)))
        ends = np.cumsum(self.size.take(ids))
        return ids, np.diff(np.searchsorted(ends, np.cumsum(size), side="right"), prepend=0)

    def _looked_up(self, names: np.ndarray, pieces) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the stretches of these hashes end to end, and how many each has. pieces works out those of some.

        Of a full table the half learnt last is forgotten.
        """
        if len(self.names) > _MOST:
            old = self.slots < _MOST // 2
            self.names, self.slots = self.names[old], self.slots[old]
            self.bounds_of = self.bounds_of[: _MOST // 2 + 1].copy()
            self.pool = self.pool[: self.bounds_of[-1]].copy()
        order = np.argsort(names)  # in order, what is searched for next is near
        asked = names[order]
        place = np.searchsorted(self.names, asked)
        new = order[self.names.take(place) != asked]
        if len(new):
            ids, many = pieces(np.sort(new))
            slots = len(self.bounds_of) - 1 + np.argsort(np.argsort(new))
            self.pool = np.concatenate([self.pool, ids])
            self.bounds_of = np.concatenate([self.bounds_of, self.bounds_of[-1] + np.cumsum(many)])
            at = np.searchsorted(self.names, names[new])
            self.names, self.slots = np.insert(self.names, at, names[new]), np.insert(self.slots, at, slots)
            place = np.searchsorted(self.names, asked)
        slot = np.zeros(len(names), np.int64)
        slot[order] = self.slots.take(place)
        start = self.bounds_of.take(slot)
        many = self.bounds_of.take(slot + 1) - start
        return self.pool.take(np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())), many

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The lower-cased bytes of each row of ids."""
        size = self.size.take(ids)
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.begins.take(ids) - ends[:-1], size)
        place += np.arange(ends[-1])
        data = self.bytes.take(place)
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends[at].astype(np.int64)), pa.py_buffer(data)])


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where runs of more than RUN bytes of white space, or of others, are cut: before a character."""
    white = space(raw)
    edges = np.concatenate([[0], np.flatnonzero(white[1:] != white[:-1]) + 1, [len(raw)]])
    out = [np.arange(edges[i] + RUN, edges[i + 1], RUN) for i in np.flatnonzero(np.diff(edges) > RUN)]
    cuts = np.concatenate(out) if out else np.zeros(0, np.int64)
    while len(inner := np.flatnonzero((raw[cuts] & 0xC0) == 0x80)):  # within a character
        cuts[inner] -= 1
    return cuts


def _ink(x: np.ndarray) -> np.ndarray:
    """Bytes after a space that surely begin no white space: printable ASCII, and first bytes of characters beyond it but those that white space has too."""
    return within(x, 0x21, 0x7E) | within(x, 0xC3, 0xDF) | within(x, 0xE4, 0xF4)


#: Stretches of so many bytes at most are looked up, by a 64-bit hash, in a table of about so many, some 40 bytes each.
_SHORT, _MOST = 32, 400_000


#: Of eight bytes of a word, the first 0 to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _hash(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of up to _SHORT bytes of low, which has as many more at its end."""
    words = np.lib.stride_tricks.as_strided(low[: len(low) // 8 * 8].view(U64), (max(0, len(low) - 7),), (1,), writeable=False)
    out = size.astype(U64)
    for k in range(0, _SHORT, 8):
        some = np.flatnonzero(size > k) if k else slice(None)
        left = np.minimum(size[some] - k, 8)
        out[some] = mix(out[some] * U64(0x9E3779B97F4A7C15) + (words[start[some] + k] & _FIRST.take(left)))
    return np.minimum(out, U64(2**64 - 2))


_END_WORD = U64(0x5DEECE66D1234567)


class Model:
    """tables of inputs, queries, keys, values by row; bias by distance; output weights; row, class and log10 share of class by id.

    A class is predicted in two steps, its group and then the class among the group's, each a softmax: their product is a distribution over all classes.
    """

    def __init__(self, counts: np.ndarray, ids: np.ndarray, at: np.ndarray, seed: int = 5, sums: np.ndarray | None = None):
        """counts: of every id over the training documents. ids, at: those of the documents to start on, and their offsets. sums: those of the
        sketches over all training documents; without, over ids."""
        rng = np.random.default_rng(seed)
        self.row = _rows(counts)
        self.begin, self.pad = OWN, OWN + 1  # rows of the begin of a text and of nothing
        rows = OWN + 2 + SHARED
        self.kind, self.edges = self._classes(counts, _sketched(ids, at, self.row, _sketches(counts)) if sums is None else sums)
        rest = self.row > self.pad
        self.row[rest] = OWN + 2 + self.kind[rest] % SHARED
        smooth = counts + 0.5
        mass = np.bincount(self.kind, smooth)
        self.share = np.log10(smooth / mass[self.kind]).astype(np.float32)
        self.group = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges))
        self.group_of = self.group[self.kind].astype(np.uint8)  # by id
        whole = np.bincount(self.group, mass)
        scale = 0.3
        self.p = {
            "x": rng.normal(0, scale, (rows, DIM)), "q": rng.normal(0, scale, (rows, DIM)), "k": rng.normal(0, scale, (rows, DIM)), "v": rng.normal(0, scale, (rows, DIM)),
            "d": np.zeros(SPAN + 1), "o": rng.normal(0, scale, (DIM, len(mass))), "b": np.log(mass / whole[self.group]), "go": rng.normal(0, scale, (DIM, len(whole))), "gb": np.log(whole / whole.sum()),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        if len(ids):
            self.learn(ids, at, rng, EPOCHS, RATE, 0)

    def _classes(self, counts, sums) -> tuple[np.ndarray, np.ndarray]:
        """Classes of ids that follow alike ids, by k-means over the sketches of the ids before them, and the bounds of groups of alike classes."""
        kind = (np.arange(len(counts)) % CLASSES).astype(np.int32)
        size = np.linalg.norm(sums, axis=1)
        seen = np.flatnonzero(size > 0)
        if len(seen) < 2 * CLASSES:
            some, kind = np.unique(kind, return_inverse=True)
            return kind.astype(np.int32), np.unique(np.arange(GROUPS + 1) * len(some) // GROUPS)
        near, centre = _means((sums[seen] / size[seen][:, None]).astype(np.float32), counts[seen], CLASSES)
        kind[seen] = near
        some, kind = np.unique(kind, return_inverse=True)  # a class without ids would take some of the probability
        of, _ = _means(centre[some], np.bincount(kind, counts + 0.5), GROUPS)
        order = np.argsort(of, kind="stable")
        place = np.argsort(order)
        return place[kind].astype(np.int32), np.append(np.flatnonzero(np.append(True, np.diff(of[order]) > 0)), len(some))

    def copy(self, weights: np.ndarray | None = None) -> Model:
        """The model with weights of its own: the same, or those given end to end."""
        out = object.__new__(Model)
        out.__dict__ |= self.__dict__
        ends = np.cumsum([self.p[k].size for k in _NAMES])
        out.p = {k: (self.p[k].copy() if weights is None else weights[e - self.p[k].size : e].reshape(self.p[k].shape).astype(np.float32)) for k, e in zip(_NAMES, ends, strict=True)}
        return out

    def windows(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows before each place with SPAN more in front, ids to predict with -1 for none, document) of every window of STRIDE."""
        size = np.diff(at)
        n = -(-size // STRIDE)
        doc = np.repeat(np.arange(len(size)), n)
        room = SPAN + n * STRIDE  # of a document's windows, with nothing in front
        begin = np.cumsum(room) - room + SPAN
        place = np.arange(len(ids)) + np.repeat(begin - at[:-1], size)
        inputs = np.full(int(room.sum()) + 1, self.pad, np.int32)
        inputs[place + 1] = self.row.take(ids)
        inputs[begin + size] = self.pad  # the last id is none
        inputs[begin[size > 0]] = self.begin
        wanted = np.full(len(inputs), -1, np.int32)
        wanted[place] = ids
        start = begin[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        if not len(doc):
            return np.zeros((0, SPAN + STRIDE), np.int32), np.zeros((0, STRIDE), np.int32), doc
        view = np.lib.stride_tricks.sliding_window_view
        return view(inputs, SPAN + STRIDE)[start - SPAN], view(wanted, STRIDE)[start], doc

    def _mask(self) -> np.ndarray:
        """Added to scores of a block: the bias of the distance, and nothing beyond SPAN or ahead."""
        d = self.p["d"]
        return np.where(_NEAR, d.take(_STEPS), d.dtype.type(-1e4))

    def _queries(self) -> tuple[np.ndarray, np.ndarray]:
        """(queries in the scale of scores, mask): what blocks of windows have in common."""
        return self.p["q"] * np.float32(DIM**-0.5), self._mask()

    def _most(self) -> float:
        """No score of attention is larger."""
        length = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))
        return length(self.p["q"]) * length(self.p["k"]) * DIM**-0.5 + float(self.p["d"].max())

    def _attend(self, rows, grad: bool = False, cap: bool = True, common=None):
        """What each place has from itself and what it attends to: (rows, what the gradient needs, h). Blocks of SPAN places attend to twice SPAN."""
        p = self.p
        here = rows[:, SPAN:]
        scaled, mask = common or self._queries()
        q, k, v = scaled.take(here, axis=0).reshape(len(rows), -1, SPAN, DIM), _blocks(p["k"].take(rows, axis=0)), _blocks(p["v"].take(rows, axis=0))
        a = np.matmul(q, k.transpose(0, 1, 3, 2))
        a += mask
        start = np.flatnonzero(rows[:, SPAN - 1] == self.pad)  # windows at the begin of a text have nothing before them; what is behind one is masked
        a[start, 0] += np.where(rows[start, : 2 * SPAN] == self.pad, np.float32(-1e4), np.float32(0))[:, None, :]
        if (grad or cap) and a.size and a.max() > 30:
            np.minimum(a, 30, out=a)
        np.exp(a, out=a)
        total = (a.reshape(-1, 2 * SPAN) @ np.ones(2 * SPAN, a.dtype) + a.dtype.type(1e-9)).reshape(*a.shape[:-1], 1)
        np.reciprocal(total, out=total)
        met = np.matmul(a, v)
        met *= total
        h = p["x"].take(here.reshape(-1), axis=0)
        h += met.reshape(-1, DIM)
        return here, q, k, v, a, total, met, h

    def _sorted(self, target):
        """(order, classes, ends): places with an id to predict, by the group of its class, those classes, and where each group's end."""
        group = self.group_of.take(target, mode="wrap")
        group[target < 0] = GROUPS
        many = np.cumsum(np.bincount(group, minlength=GROUPS + 1))
        order = np.argsort(group, kind="stable")[: many[GROUPS - 1]]
        return order, self.kind.take(target.take(order)), np.append(0, many[: len(self.edges) - 1])

    def _logs(self, h, order, kind, ends, grad: bool = False):
        """The natural log-probability of the class at each place of order; with grad, the softmaxes less what was there, of groups and of each group's classes.

        Each softmax has a row for each of its classes and a column for each place, so that all passes run along many places; they lie end to end.
        """
        p = self.p
        h = h.take(order, axis=0)
        n, groups = len(order), len(self.edges) - 1
        many, width = np.diff(ends), np.diff(self.edges)
        ahead = n * groups + np.cumsum(many * width)
        flat = np.empty(ahead[-1] if groups else 0, h.dtype)
        z = flat[: n * groups].reshape(groups, n)
        np.matmul(p["go"].T, h.T, out=z)
        inner = []
        for s, e, a, b, end in zip(ends[:-1].tolist(), ends[1:].tolist(), self.edges[:-1].tolist(), self.edges[1:].tolist(), ahead.tolist(), strict=True):
            if e > s:
                y = flat[end - (e - s) * (b - a) : end].reshape(b - a, e - s)
                if b > a + 1:
                    np.matmul(p["o"][:, a:b].T, h[s:e].T, out=y)
                else:
                    y[:] = 0  # the only class of a group is certain
                inner.append((slice(s, e), slice(a, b), y))
        if flat.size and flat.max() > 60:  # far beyond what weights of this size give
            np.minimum(flat, 60, out=flat)
        # where each place's own group and class are: a class's row begins many of its group after the one before it
        place = np.arange(n)
        first = np.repeat(ahead - many * width - ends[:-1] - many * self.edges[:-1], width) + np.repeat(many, width) * np.arange(len(self.group))
        own = np.stack([(self.group * n).take(kind) + place, first.take(kind) + place])
        top = flat.take(own)
        top[0] += p["gb"].take(self.group).take(kind)
        top[1] += p["b"].take(kind)
        np.exp(flat, out=flat)
        total = np.empty((2, n), h.dtype)
        factor, factors = np.exp(p["gb"]), np.exp(p["b"])  # of the biases
        np.matmul(factor, z, out=total[0])
        for at, of, y in inner:
            np.matmul(factors[of], y, out=total[1, at])
        total += h.dtype.type(1e-30)
        if grad:
            part = 1 / total
            z *= factor[:, None]
            z *= part[0]
            for at, of, y in inner:
                y *= factors[of, None]
                y *= part[1, at]
            flat[own.reshape(-1)] -= 1
        top -= np.log(total, out=total)
        return h, top[0] + top[1], z, inner

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each document's ids."""
        out = np.zeros(len(at) - 1)
        rows, target, doc = self.windows(ids, at)
        cap, common = self._most() > 30, self._queries()
        for lo in range(0, len(rows), WINDOWS):
            h = self._attend(rows[lo : lo + WINDOWS], cap=cap, common=common)[-1]
            t = target[lo : lo + WINDOWS].reshape(-1)
            order, kind, ends = self._sorted(t)
            top = self._logs(h, order, kind, ends)[1]
            got = np.zeros(len(t))
            got[order] = top * np.float32(1 / np.log(10)) + self.share.take(t.take(order))
            np.add.at(out, doc[lo : lo + WINDOWS], got.reshape(-1, STRIDE).sum(1))
        return out

    def learn(self, ids, at, rng, epochs: int, high: float, low: float, state: dict | None = None) -> None:
        """Steps down the gradient over ids, at a rate that falls from high to low; state carries the moments from call to call."""
        rows, target, _ = self.windows(ids, at)
        state = {} if state is None else state
        if not state:
            state |= {"step": 0, "m": {k: np.zeros_like(v) for k, v in self.p.items()}, "s": {k: np.zeros_like(v) for k, v in self.p.items()}}
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), LEARN_WINDOWS):
                pick = order[lo : lo + LEARN_WINDOWS]
                rate = high - (high - low) * (epoch * len(order) + lo) / (epochs * len(order) + 1)
                self._step(self._gradient(rows[pick], target[pick]), rate, state)

    def _step(self, grad: dict[str, np.ndarray], rate: float, state: dict) -> None:
        state["step"] += 1
        # the moments are kept 10 and 100 times as large: their means need no product with each gradient
        size = np.float32((0.01 / (1 - 0.99 ** state["step"])) ** 0.5)
        pace = np.float32(rate * 0.1 / (1 - 0.9 ** state["step"])) / size
        for k, g in grad.items():
            m, s = state["m"][k], state["s"][k]
            m *= np.float32(0.9)
            m += g
            s *= np.float32(0.99)
            g *= g
            s += g
            np.sqrt(s, out=g)
            g += np.float32(1e-7) / size
            np.divide(m, g, out=g)
            g *= pace
            self.p[k] -= g
        for k in ("b", "gb"):
            np.clip(self.p[k], -20, 20, out=self.p[k])

    def _gradient(self, rows, target) -> dict[str, np.ndarray]:
        p = self.p
        here, q, k, v, w, total, met, h = self._attend(rows, True)  # w times total: how much of each place
        t = target.reshape(-1)
        order, kind, ends = self._sorted(t)
        hs, _, z, inner = self._logs(h, order, kind, ends, True)
        one = np.ones(len(order), h.dtype)
        g = {"go": (z @ hs).T, "gb": z @ one, "o": np.zeros_like(p["o"]), "b": np.zeros_like(p["b"])}
        ds = np.zeros_like(hs)
        for at, of, y in inner:
            g["o"][:, of] = (y @ hs[at]).T
            np.matmul(y, one[at], out=g["b"][of])
            np.matmul(y.T, p["o"][:, of].T, out=ds[at])
        ds += z.T @ p["go"].T
        scale = h.dtype.type(1 / max(1, len(order)))
        for x in (*g.values(), ds):
            x *= scale
        dh = np.zeros_like(h)
        dh[order] = ds
        part = dh.reshape(q.shape) * total
        da = np.matmul(part, v.transpose(0, 1, 3, 2))
        da -= np.einsum("wbid,wbid->wbi", part, met)[..., None]
        da *= w
        flat = da.reshape(-1, _BACK.size)
        g["d"] = np.bincount(_STEPS.reshape(-1), np.ones(len(flat), flat.dtype) @ flat, minlength=SPAN + 1).astype(p["d"].dtype)
        g["x"], g["q"] = _by_row(here, len(p["x"]), dh, np.matmul(da, k))
        g["q"] *= np.float32(DIM**-0.5)
        g["k"], g["v"] = _by_row(_blocks(rows), len(p["k"]), np.matmul(da.transpose(0, 1, 3, 2), q), np.matmul(w.transpose(0, 1, 3, 2), part))
        return g


#: How far back each place that a block attends to is from each place of the block.
_BACK = np.arange(SPAN)[:, None] + SPAN - np.arange(2 * SPAN)[None, :]
_NEAR, _STEPS = (_BACK >= 0) & (_BACK <= SPAN), np.clip(_BACK, 0, SPAN)


def _blocks(x: np.ndarray) -> np.ndarray:
    """What each block of SPAN places of a window attends to, itself and the SPAN before it, without a copy."""
    step = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x), STRIDE // SPAN, 2 * SPAN, *x.shape[2:]), (step[0], SPAN * step[1], *step[1:]), writeable=False)


def _by_row(rows, size: int, *grads) -> list[np.ndarray]:
    """The sum of each gradient's vectors by row."""
    rows = rows.reshape(-1)
    order = np.argsort(rows.astype(np.uint16) if size <= 1 << 16 else rows, kind="stable")
    own = rows[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    out = []
    for d in grads:
        total = np.zeros((size, DIM), d.dtype)
        pairs = d.reshape(-1, DIM).take(order, axis=0).view(f"c{2 * d.itemsize}")  # two numbers are added at a time
        total[own[first]] = np.add.reduceat(pairs, first, axis=0).view(d.dtype)
        out.append(total)
    return out


def _means(x: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: the cluster of each row, and the clusters' centres."""
    centre = x[np.argsort(-weight, kind="stable")[:k]].copy()
    for _ in range(12):
        near = (x @ centre.T).argmax(1)
        weighted = x * np.sqrt(weight)[:, None]
        m = np.stack([np.bincount(near, weighted[:, j], minlength=len(centre)) for j in range(x.shape[1])], 1)
        some = np.bincount(near, minlength=len(centre)) > 0
        centre[some] = (m / (np.linalg.norm(m, axis=1)[:, None] + 1e-9))[some]
    return near, centre


def _rows(counts: np.ndarray) -> np.ndarray:
    """The row of each id: its own for the OWN commonest, one of the SHARED by number for the others."""
    row = (OWN + 2 + np.arange(len(counts)) % SHARED).astype(np.int32)
    row[np.argsort(-counts, kind="stable")[:OWN]] = np.arange(min(OWN, len(counts)))
    return row


def _sketches(counts: np.ndarray) -> np.ndarray:
    """Random integers of each row, smaller for common ones: ids' sums of them are exact in any order, and alike for ids that follow alike ids."""
    rows = OWN + 2 + SHARED
    freq = np.bincount(_rows(counts), counts, minlength=rows) + 1.0
    freq[OWN] += counts[-1]  # as many begins as ends
    return np.rint(np.random.default_rng(7).normal(0, 1 << SKETCH_BITS, (rows, SKETCH)) / np.sqrt(freq)[:, None])


def _sketched(ids: np.ndarray, at: np.ndarray, row: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Of each id, the sum of the sketches of the rows before it."""
    before = np.concatenate([[OWN], row[ids[:-1]]]) if len(ids) else np.zeros(0, np.int32)
    before[at[:-1][at[:-1] < len(ids)]] = OWN
    kind = np.uint32 if len(row) * len(sketch) < 1 << 32 else np.uint64
    pair = np.sort(ids.astype(kind) * kind(len(sketch)) + before.astype(kind))  # each pair once, with how often it comes
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(pair)))
    of, before = np.divmod(pair[first], kind(len(sketch)))
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    out = np.zeros((len(row), SKETCH))
    if len(start):
        out[of[start]] = np.add.reduceat(sketch[before] * times[:, None], start, axis=0)
    return out


_IDS = "doc_id long, held boolean, round int, pick int, place long, ids binary"


def _encoded(tokenizer: str):
    """The ids of each text, two bytes each where the vocabulary allows."""

    def run(batches):
        encoder = Subwords.of(tokenizer)
        kind = _kind(encoder.end + 1)
        for b in (x for whole in batches for x in sliced(whole, limit=1 << 20)):
            ids, at = encoder.encode(b.column("text"))
            ids = ids.astype(kind)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), binary([ids[s:e] for s, e in zip(at[:-1], at[1:], strict=True)])], names=[x.split()[0] for x in _IDS.split(", ")])

    return run


def encoded(rows: DataFrame, held: Column, tokenizer: str) -> DataFrame:
    """_IDS of rows (doc_id, text), written to the shared folder: every text is encoded once. Those held out have the round -1."""
    place = F.xxhash64("doc_id", "text")
    keyed = rows.select(
        "doc_id", held.alias("held"), F.when(held, -1).otherwise(F.pmod(F.xxhash64(place), F.lit(ROUNDS))).cast("int").alias("round"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 30)).cast("int").alias("pick"), place.alias("place"), "text",
    )
    path = new_path(rows.sparkSession, "ids")
    keyed.mapInArrow(roomy(_encoded(tokenizer)), _IDS).write.partitionBy("round").parquet(path)
    return rows.sparkSession.read.schema(_IDS).parquet(path)


def _kind(size: int):
    return np.uint16 if size <= 1 << 16 else np.int32


def _joint(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of encoded texts end to end, and their offsets."""
    kind = _kind(size)
    ids = np.frombuffer(b"".join(texts), kind).astype(np.int32)
    return ids, np.concatenate([[0], np.cumsum([len(x) // kind().itemsize for x in texts])]).astype(np.int64)


def _ids_counted(size: int):
    """(id, n): how often each id stands in the texts of a task."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_joint(b.column("ids").to_pylist(), size)[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["id", "n"])

    return run


_BUCKETS = 16


def _sketches_dealt(counts):
    """Blocks of ids and their sums of sketches over a task's texts."""

    def run(batches):
        size = len(counts.value)
        row, sketch = _rows(counts.value), _sketches(counts.value)
        total = np.zeros((size, SKETCH))
        for b in batches:
            total += _sketched(*_joint(b.column("ids").to_pylist(), size), row, sketch)
        some = np.flatnonzero(total.any(1))
        dealt = [some[some % _BUCKETS == k] for k in range(_BUCKETS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BUCKETS), pa.int32()), binary([x.astype(np.int32) for x in dealt]), binary([total[x].astype(np.int64) for x in dealt])], names=["bucket", "ids", "sums"])

    return run


def _sketches_summed(batches):
    for _, t in groups(batches, 1):
        ids = [np.frombuffer(x, np.int32) for x in t.column("ids").to_pylist()]
        every, of = np.unique(np.concatenate(ids), return_inverse=True)
        total, lo = np.zeros((len(every), SKETCH), np.int64), 0
        for x, sums in zip(ids, t.column("sums").to_pylist(), strict=True):
            total[of[lo : lo + len(x)]] += np.frombuffer(sums, np.int64).reshape(-1, SKETCH)
            lo += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), binary([every]), binary([total])], names=["bucket", "ids", "sums"])


_NAMES = ("x", "q", "k", "v", "d", "o", "b", "go", "gb")
_WEIGHTS = "part int, n long, weights binary"


def _learnt(model, size: int, rate: float):
    """The weights of a part, the texts of a task, after it has learnt from them, times the number of their ids."""

    def run(batches):
        part = TaskContext.get().partitionId()
        net, rng, state = model.value.copy(), np.random.default_rng(part), {}
        total, held, waiting = 0, [], 0

        def learn():
            net.learn(*_joint(held, size), rng, 1, rate, rate, state)

        for text in (x for b in batches for x in b.column("ids").to_pylist()):
            held.append(text)
            waiting += len(text)
            if waiting > CHUNK * _kind(size)().itemsize:
                learn()
                total, held, waiting = total + waiting, [], 0
        if held:
            learn()
            total += waiting
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total]), binary([np.concatenate([net.p[k].reshape(-1) for k in _NAMES]).astype(np.float64) * total])], names=["part", "n", "weights"])

    return run


def _added(batches):
    """The sum of all weights of a task; parts are added in their order, so that the sum doesn't depend on who came first."""
    rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([sum(r[1] for r in rows)]), binary([sum(np.frombuffer(r[2]) for r in rows)])], names=["part", "n", "weights"])


def fit(training: DataFrame, tokenizer: str) -> Model:
    """The model of training's (doc_id, text) rows."""
    return fitted(encoded(training, F.lit(False), tokenizer), tokenizer)


def fitted(texts: DataFrame, tokenizer: str) -> Model:
    """The model of the rows of _IDS that aren't held out: counts and classes of all; attention started on about FIT_ROWS documents in one task, then
    learnt from all of them in rounds, unless these are all."""
    spark = texts.sparkSession
    few = max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    end = Subwords.of(tokenizer).end
    size = end + 1
    texts = texts.where("round >= 0")
    counts = np.zeros(size, np.int64)
    for r in texts.select("ids").mapInArrow(_ids_counted(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a vocabulary's worth
        counts[r["id"]] = r["n"]
    n_rows = int(counts[end])
    sums = np.zeros((size, SKETCH))
    blocks = "bucket int, ids binary, sums binary"
    for r in texts.select("ids").mapInArrow(roomy(_sketches_dealt(spark.sparkContext.broadcast(counts))), blocks).repartition(_BUCKETS, "bucket").sortWithinPartitions("bucket").mapInArrow(_sketches_summed, blocks).collect():  # a vocabulary's worth
        sums[np.frombuffer(r["ids"], np.int32)] = np.frombuffer(r["sums"], np.int64).reshape(-1, SKETCH)
    rate = min(1.0, FIT_ROWS / max(1, n_rows))
    sample = texts.where(F.col("pick") < int(rate * (1 << 30)) + 1).select("place", "ids")
    given = spark.sparkContext.broadcast((counts, sums))

    def started(batches):
        import pickle

        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(given.value[0], *_joint([x for _, x in rows], size), sums=given.value[1]))], pa.binary())], names=["model"])

    import pickle

    got = sample.repartition(1).mapInArrow(roomy(started), "model binary").collect()
    model = pickle.loads(got[0]["model"]) if got else Model(counts, np.zeros(0, np.int32), np.zeros(1, np.int64), sums=sums)
    if rate == 1:
        return model
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(model)
        learnt = texts.where(F.col("round") == k).select("ids").mapInArrow(roomy(_learnt(start, size, ROUND_RATE * (1 - k / ROUNDS))), _WEIGHTS)
        total = learnt.repartitionById(few, F.pmod("part", F.lit(few))).mapInArrow(_added, _WEIGHTS).repartition(1).mapInArrow(_added, _WEIGHTS).collect()  # a model's worth
        if total:
            model = model.copy(np.frombuffer(total[0]["weights"]) / total[0]["n"])
    return model


_ENTRY = "part int, base long, words binary, trained binary, docs_of binary, rows binary, times binary, info binary"
_ROWS = 65_000


def _dealt(model, tokenizer: str, bits: int):
    """Blocks of a range's words: distinct hashes, their training counts, and which word stands how often in which document."""

    def run(batches):
        net, encoder = model.value, Subwords.of(tokenizer)
        number = TaskContext.get().partitionId() << 36
        size = encoder.end + 1
        for b in (y.slice(lo, _ROWS) for whole in batches for y in sliced(whole, "ids", 4 << 20) for lo in range(0, y.num_rows, _ROWS)):
            doc_ids = b.column("doc_id").to_pylist()
            held = b.column("held").to_numpy(zero_copy_only=False)
            base = number
            number += len(doc_ids)
            scores, hashes, many = [], [], []
            for part in sliced(b, "ids", 1 << 18):
                ids, ends = _joint(part.column("ids").to_pylist(), size)
                scores.append(net.score(ids, ends))
                h, at = word_hashes(encoder.decode(ids, ends))
                hashes.append(h)
                many.append(np.diff(at))
            score, h, at = np.concatenate(scores), np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(many))])
            row = np.concatenate([row_of(at), np.arange(len(doc_ids))])
            coded = pa.array(np.concatenate([h, np.full(len(doc_ids), _END_WORD)])).dictionary_encode()
            words = coded.dictionary.to_numpy()
            order = np.argsort(words)
            words, rank = words[order], np.argsort(order)
            pair = np.sort(rank.take(coded.indices.to_numpy()).astype(U64) << U64(16) | row.astype(U64))
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            times, pair = np.diff(np.append(first, len(pair))), pair[first].astype(np.int64)
            of, row = pair >> 16, pair & 0xFFFF
            trained = np.bincount(of, times * ~held[row], minlength=len(words)).astype(np.uint32)
            docs_of = np.bincount(of, minlength=len(words)).astype(np.uint32)
            edges = np.searchsorted(words, np.arange(1 << bits, dtype=U64) << U64(64 - bits))
            ends = np.append(edges[1:], len(words))
            some = np.flatnonzero(ends > edges)
            cut = np.append(0, np.cumsum(docs_of.astype(np.int64)))
            row, times = row.astype(np.uint16), times.astype(np.uint32)
            names = np.array([0 if d is None else d for d in doc_ids], np.int64)
            flags = held.astype(np.int8) + 2 * np.array([d is None for d in doc_ids], np.int8)
            # what is known of the documents themselves goes on once, to any part below 0
            info = names.tobytes() + score.tobytes() + flags.tobytes()
            nothing = [np.zeros(0, np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(some, -1 - base % 9973).astype(np.int32)), pa.array(np.full(len(some) + 1, base)), binary([words[edges[k] : ends[k]] for k in some] + nothing), binary([trained[edges[k] : ends[k]] for k in some] + nothing),
                    binary([docs_of[edges[k] : ends[k]] for k in some] + nothing), binary([row[cut[edges[k]] : cut[ends[k]]] for k in some] + nothing), binary([times[cut[edges[k]] : cut[ends[k]]] for k in some] + nothing), pa.array([b""] * len(some) + [info], pa.binary()),
                ], names=[x.split()[0] for x in _ENTRY.split(", ")],
            )

    return run


def _summed(parts: int):
    """Partial sums of each document over a task's ranges, dealt by document; and how many words and tokens the training has there."""

    def run(batches):
        by: dict[int, list] = {}
        got: list[list[np.ndarray]] = [[] for _ in range(7)]

        def keep(*columns):
            for g, x in zip(got, columns, strict=True):
                g.append(x)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] >= 0:
                    by.setdefault(r[0], []).append(r[1:7])
                else:
                    n = len(r[7]) // 17
                    zero = np.zeros(n)
                    keep(r[1] + np.arange(n), np.frombuffer(r[7], np.int64, n), np.frombuffer(r[7], np.int8, n, 16 * n), np.frombuffer(r[7], np.float64, n, 8 * n), zero, zero, zero)
        distinct = tokens = 0
        for part in sorted(by):
            blocks = by.pop(part)
            words = [np.frombuffer(x[1], U64) for x in blocks]
            every, of = np.unique(np.concatenate(words), return_inverse=True)
            count = np.bincount(of, np.concatenate([np.frombuffer(x[2], np.uint32) for x in blocks]), minlength=len(every))
            distinct += int((count > 0).sum())
            tokens += int(count.sum())
            c = count[of]
            lo = 0
            for block, w in zip(blocks, words, strict=True):
                here = np.repeat(c[lo : lo + len(w)], np.frombuffer(block[3], np.uint32))
                lo += len(w)
                row, times = np.frombuffer(block[4], np.uint16), np.frombuffer(block[5], np.uint32).astype(float)
                n = np.bincount(row, times)
                docs = np.flatnonzero(n)
                zero = np.zeros(len(docs))
                keep(block[0] + docs, zero.astype(np.int64), zero.astype(np.int8), zero, n[docs], np.bincount(row, times * (here > 0))[docs], np.bincount(row, times * np.log10(here + 0.5))[docs])
        if not got[0]:
            return
        keys, docs, held, score, n, known, base = map(np.concatenate, got)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        # a document's id, flag and score are 0 but in the one place that has them
        totals = [np.add.reduceat(x[order], first, dtype=x.dtype) for x in (docs, held, score, n, known, base)]
        keys = keys[order[first]]
        bucket = (mix(keys.view(U64)) % U64(parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(edges))
        cols = [x[order] for x in (keys, *totals)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(binary([c[edges[k] : edges[k + 1]] for k in some]) for c in cols), *(pa.array(np.where(np.arange(len(some)) == 0, x, 0).astype(np.int64)) for x in (distinct, tokens))], names=[x.split()[0] for x in _PARTIAL.split(", ")])

    return run


_PARTIAL = "bucket int, keys binary, docs binary, held binary, scores binary, n binary, known binary, base binary, distinct_words long, tokens long"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, sum_log double, score double"


def _joined(batches):
    for _, t in groups(batches, 1):
        read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])  # noqa: B023, E731
        keys = read("keys", np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        total = lambda c, kind: np.add.reduceat(read(c, kind)[order], first, dtype=kind)  # noqa: B023, E731
        flag = total("held", np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(total("docs", np.int64), mask=flag >= 2), pa.array(flag % 2 == 1), pa.array(total("n", np.float64).astype(np.int64)), pa.array(total("known", np.float64).astype(np.int64)), pa.array(total("base", np.float64)), pa.array(total("scores", np.float64))], names=[x.split()[0] for x in _OUT.split(", ")])


def score(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents (doc_id, text).

    Rows whose id's crc32 leaves 1 modulo 5 are held out of all counts and of the model; a null id isn't. A null text is empty: its end alone is
    scored. A repeated row counts and is scored as often as it comes. score is the model's log10 probability of the text's ids and their end.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (2 * parts - 1).bit_length())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = encoded(rows, F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)), tokenizer)
    model = spark.sparkContext.broadcast(fitted(texts, tokenizer))  # tables of a fixed size
    dealt = texts.select("doc_id", "held", "ids").mapInArrow(roomy(_dealt(model, tokenizer, bits)), _ENTRY).repartition(parts, "part")
    partial = stash(dealt.mapInArrow(roomy(_summed(parts)), _PARTIAL))
    total = partial.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct_words"), F.lit(0)).alias("v")).first()
    whole = partial.drop("distinct_words", "tokens").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_joined, _OUT)
    scale = float(np.log10(total["n"] + 0.5 * (total["v"] + 1)))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total["n"])).cast("long").alias("train_tokens"), (F.col("sum_log") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score")
