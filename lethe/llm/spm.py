"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut, as one array of code points, wherever no piece has both letters
side by side. The distinct words of a block that aren't remembered are grouped by
length and advance together: substring hashes probe the sorted keys of the pieces
of each length (hits are compared by code points), and at every end position the
best of all pieces that end there is kept as a backpointer by a vectorised
maximum. Words are told apart by 64-bit hashes and compared by code points; one
that only shares a hash is searched again.

For unigram models the best is the largest sum of scores. For BPE models sums of
scores would not give the model's own result, so a path may only go on with a
piece that byte-pair merging would leave beside the one before: then just one
path is left at each position, and it is the merging's result. Whether two
pieces may stand side by side is decided by merging both at once and looking
for a merge across the border, for all pairs of a step together.

Edge cases: null and empty texts have no ids and count as restored; characters
outside the vocabulary become byte pieces, or the unknown id where the model has
none; bytes that are no UTF-8 are read as U+FFFD (not restored); a text with U+2581
of its own is not restored, since that is how models write a space; among pieces of
equal score the shorter is kept; repeated rows and null doc_ids are encoded each;
an empty table gives an empty result; other columns are ignored. Texts of any
length are cut into blocks between words, so that a task holds arrays of some
``_BLOCK`` code points, however long a text is, besides the text and its ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices

_SPACE = "▁"
_NONE = np.iinfo(np.int64).max
_P = np.uint64(0x9E3779B97F4A7C15)
#: Code points that are cut and hashed at once.
_BLOCK = 1 << 19


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Sorted:
    """Sorted hashes, and where those of the same leading bits begin."""

    def __init__(self, keys: np.ndarray):
        bits = min(18, max(1, len(keys).bit_length() + 1))
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.begins = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.deepest = int(np.diff(self.begins, append=len(keys)).max())

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        at = self.begins[(h >> self.shift).astype(np.int64)]
        out = np.full(h.shape, -1, np.int64)
        last = len(self.keys) - 1
        for k in range(self.deepest):
            here = np.minimum(at + k, last)
            np.copyto(out, here, where=self.keys[here] == h)
        return out


class Vocabulary:
    """Pieces of a model file and the tables that encoding needs. Of fixed size, so
    it may be broadcast."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            raw = f.read()
        model.ParseFromString(raw)
        self.digest = hashlib.sha256(raw).hexdigest()
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise NotImplementedError("only models that don't change their input are supported")
        kinds = [p.type for p in model.pieces]
        if proto.ModelProto.SentencePiece.USER_DEFINED in kinds:
            raise NotImplementedError("user-defined pieces")
        names = [p.piece for p in model.pieces]
        self._set([(i, n) for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == 1], np.array([p.score for p in model.pieces]), model.trainer_spec.model_type == 2, norm.add_dummy_prefix)
        self.unknown = kinds.index(2)
        self.bytes = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == 6}
        self._speak([bytes([int(n[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" if k == 3 else n.encode() for n, k in zip(names, kinds, strict=True)])

    def _speak(self, said: list[bytes]) -> None:
        """What each id says, as bytes side by side."""
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_n = np.array([len(x) for x in said], np.int64)
        self.said_at = np.cumsum(self.said_n) - self.said_n

    def _set(self, pieces: list[tuple[int, str]], scores: np.ndarray, merges: bool, prefix: bool) -> None:
        self.scores, self.merges, self.prefix = scores, merges, prefix
        self.ids = {n: i for i, n in pieces}
        if any(_SPACE in n.lstrip(_SPACE) for n in self.ids):
            raise NotImplementedError("pieces that cross words")
        self.longest = max(map(len, self.ids))
        if not {c for n in self.ids for c in n} <= self.ids.keys():
            raise NotImplementedError("letters of pieces that are no pieces")
        # the place of each letter that some piece has beside another, 0 for all others
        letters = sorted({c for n in self.ids if len(n) > 1 for c in n})
        self.place = np.zeros(0x110000, np.uint16)
        self.place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for n in self.ids:
            at = self.place[_codes(n)]
            self.beside[at[:-1], at[1:]] = True
        if merges:
            self._merging()
        usable = [(i, n) for i, n in pieces if not merges or self.whole[i]]
        self.keys = {}
        for size in range(1, self.longest + 1):
            own = [(i, n) for i, n in usable if len(n) == size]
            if own:
                codes = np.array([_codes(n) for _, n in own])
                hashes = self.hashes(codes, size)[:, 0]
                order = np.argsort(hashes)
                self.keys[size] = (_Sorted(hashes[order]), np.array([i for i, _ in own], np.int32)[order], codes[order])

    @staticmethod
    def hashes(codes: np.ndarray, size: int) -> np.ndarray:
        """Of all substrings of ``size`` in each row."""
        m = mix(codes.astype(np.uint64))
        out = np.zeros((codes.shape[0], codes.shape[1] - size + 1), np.uint64)
        for i in range(size):
            out = out * _P + m[:, i : i + out.shape[1]]
        return out

    def _merging(self) -> None:
        """For each piece: ranks of the merges that make it, in their order, and the
        leftmost and rightmost piece after each; whether merging makes it at all."""
        n = len(self.scores)
        order = np.unique(-self.scores, return_inverse=True)[1]
        self.rank = order.astype(np.int64)
        pairs: dict[tuple[int, int], int] = {}
        for name, i in self.ids.items():
            for k in range(1, len(name)):
                a, b = self.ids.get(name[:k]), self.ids.get(name[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        keys = mix(np.array([a * n + b for a, b in pairs], np.uint64))
        at = np.argsort(keys)
        self.pair_keys, self.pair_ranks = _Sorted(keys[at]), self.rank[np.array(list(pairs.values()), np.int64)[at]]
        depth = self.longest
        self.steps = np.full((n, depth), _NONE)
        self.left, self.right = np.zeros((n, depth), np.int32), np.zeros((n, depth), np.int32)
        self.whole = np.zeros(n, bool)
        for name, i in self.ids.items():
            parts = [self.ids[c] for c in name]
            step = 0
            while True:
                self.left[i, step], self.right[i, step] = parts[0], parts[-1]
                best = min(((self.rank[pairs[p]], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs), default=None)
                if best is None:
                    break
                r, k = best
                parts[k : k + 2] = [pairs[parts[k], parts[k + 1]]]
                self.steps[i, step] = r
                step += 1
            self.whole[i] = parts == [i]
        self.made = (self.steps != _NONE).sum(axis=1)
        self.upto = np.maximum.accumulate(self.steps, axis=1)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of pieces: whether merging both strings together merges nothing
        across the border. Merges go by rank, and from left to right within one."""
        depth = int(max(self.made[a].max(initial=0), self.made[b].max(initial=0)))
        # a string's merge comes once all its earlier ones are done: in the order of their highest rank so far
        order = np.argsort(np.concatenate([self.upto[a, :depth], self.upto[b, :depth]], axis=1), axis=1, kind="stable")
        mine = np.zeros((len(a), 2 * depth + 1), np.int64)
        np.cumsum(order < depth, axis=1, out=mine[:, 1:])
        i = np.minimum(mine, self.made[a][:, None])
        j = np.minimum(np.arange(2 * depth + 1) - mine, self.made[b][:, None])
        a, b = a[:, None], b[:, None]
        at = self.pair_keys.find(mix((self.right[a, i].astype(np.int64) * len(self.scores) + self.left[b, j]).view(np.uint64)))
        across = np.where(at >= 0, self.pair_ranks[at], _NONE)
        return ~((across < self.steps[a, i]) & (across <= self.steps[b, j])).any(axis=1)


class _Memory:
    """Words met before and their ids, as arrays. Beyond ``most`` words, those not
    used for longest are forgotten."""

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.letters, self.letters_at, self.letters_n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.ids_at, self.ids_n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each of sorted hashes is, or -1."""
        at = np.searchsorted(self.keys, h)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == h[hit]
        return np.where(hit, at, -1)

    def add(self, h: np.ndarray, letters: np.ndarray, letters_n: np.ndarray, ids: np.ndarray, ids_n: np.ndarray) -> None:
        """Words of new hashes; letters and ids lie side by side."""
        if len(self.keys) + len(h) > self.most:
            self._forget(np.argsort(-self.used, kind="stable")[: self.most // 2])
        at = np.concatenate([self.letters_at, len(self.letters) + np.cumsum(letters_n) - letters_n])
        ids_at = np.concatenate([self.ids_at, len(self.ids) + np.cumsum(ids_n) - ids_n])
        self.letters, self.ids = np.concatenate([self.letters, letters]), np.concatenate([self.ids, ids])
        order = np.argsort(keys := np.concatenate([self.keys, h]), kind="stable")
        self.keys, self.letters_at, self.ids_at = keys[order], at[order], ids_at[order]
        self.letters_n, self.ids_n = np.concatenate([self.letters_n, letters_n])[order], np.concatenate([self.ids_n, ids_n])[order]
        self.used = np.concatenate([self.used, np.full(len(h), self.now)])[order]

    def _forget(self, keep: np.ndarray) -> None:
        keep = np.sort(keep)
        self.letters, self.ids = self.letters[_ranges(self.letters_at[keep], self.letters_n[keep])], self.ids[_ranges(self.ids_at[keep], self.ids_n[keep])]
        self.keys, self.used, self.letters_n, self.ids_n = self.keys[keep], self.used[keep], self.letters_n[keep], self.ids_n[keep]
        self.letters_at, self.ids_at = np.cumsum(self.letters_n) - self.letters_n, np.cumsum(self.ids_n) - self.ids_n


class Encoder:
    """Encodes texts; words met before are remembered, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 250_000, hash_bits: int = 64):
        self.v, self.memory = vocabulary, _Memory(remember)
        self.shift = np.uint64(64 - hash_bits)  # fewer bits, to test what happens when hashes clash
        # pairs of pieces that were decided before: one place for each hash
        self.pair, self.follows = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.v.scores) + b
        at = (mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        out = self.follows[at]
        new = np.flatnonzero(self.pair[at] != key)
        if len(new):
            own, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.v.may_follow(a[new[first]], b[new[first]])
            out[new] = found[back]
            self.pair[at[new[first]]], self.follows[at[new[first]]] = own, found
        return out

    def laid_out(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts as the model reads them, and where each text ends."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
        ahead = (sizes > 0).astype(np.int64) if self.v.prefix else np.zeros(len(sizes), np.int64)
        ends = np.cumsum(sizes + ahead)
        out = np.full(len(codes) + int(ahead.sum()), ord(_SPACE), np.uint32)
        if self.v.prefix:
            own = np.ones(len(out), bool)
            own[(ends - sizes - 1)[sizes > 0]] = False
            out[own] = codes
        else:
            out[:] = codes
        out[out == 32] = ord(_SPACE)
        return out, ends

    def ids_of(self, codes: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of laid-out texts, and where each text's end."""
        ids, word_ends, token_ends, at, tokens = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0, 0
        while at < len(codes):
            size = _BLOCK
            while not len(ends := self._cuts(codes[at : at + size], text_ends, at, at + size >= len(codes))):
                size *= 2  # a word of more than a block
            found, counts = self._words(codes[at : at + ends[-1]], ends)
            ids.append(found)
            word_ends.append(at + ends)
            token_ends.append(tokens + np.cumsum(counts))
            at, tokens = at + int(ends[-1]), int(token_ends[-1][-1])
        whole = np.concatenate(token_ends)[np.searchsorted(np.concatenate(word_ends), text_ends)]
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), whole

    def _cuts(self, codes: np.ndarray, text_ends: np.ndarray, at: int, last: bool) -> np.ndarray:
        """Ends of words in a block."""
        place = self.v.place[codes]
        apart = np.ones(len(codes), bool)
        apart[:-1] = ~self.v.beside[place[:-1], place[1:]]
        apart[-1] = last
        inside = text_ends[np.searchsorted(text_ends, at, side="right") : np.searchsorted(text_ends, at + len(codes), side="right")]
        apart[inside - at - 1] = True
        return np.flatnonzero(apart) + 1

    def _words(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of a block, and how many each has."""
        m = self.memory
        m.now += 1
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        weights = np.multiply.accumulate(np.full(int(sizes.max()), _P))
        h = np.add.reduceat(mix(codes.astype(np.uint64)) * weights[_ranges(np.zeros(len(sizes), np.int64), sizes)], starts)
        h = mix(h ^ sizes.astype(np.uint64)) >> self.shift
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = m.find(own) < 0
        pick = first[new]
        ids, counts = self._search_all(codes, starts[pick], sizes[pick])
        m.add(own[new], codes[_ranges(starts[pick], sizes[pick])], sizes[pick], ids, counts)
        where = m.find(own)
        if (where < 0).any():  # a block with more words than are remembered: what was forgotten comes again
            pick = first[where < 0]
            ids, counts = self._search_all(codes, starts[pick], sizes[pick])
            m.most = max(m.most, 3 * len(own))
            m.add(own[where < 0], codes[_ranges(starts[pick], sizes[pick])], sizes[pick], ids, counts)
            where = m.find(own)
        m.used[where] = m.now
        where = where[back]
        wrong = m.letters_n[where] != sizes
        same = np.flatnonzero(~wrong)
        equal = m.letters[_ranges(m.letters_at[where[same]], sizes[same])] == codes[_ranges(starts[same], sizes[same])] if wrong.any() else m.letters[_ranges(m.letters_at[where], sizes)] == codes
        if not equal.all():
            wrong[same] = ~np.logical_and.reduceat(equal, np.cumsum(sizes[same]) - sizes[same])
        if not wrong.any():
            return m.ids[_ranges(m.ids_at[where], m.ids_n[where])], m.ids_n[where]
        odd = np.flatnonzero(wrong)
        ids, counts = self._search_all(codes, starts[odd], sizes[odd])
        n, at = m.ids_n[where], m.ids_at[where]
        n[odd], at[odd] = counts, len(m.ids) + np.cumsum(counts) - counts
        return np.concatenate([m.ids, ids])[_ranges(at, n)], n

    def _search_all(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words side by side, and how many each has. Words of one length are
        searched together."""
        out, counts, where = [], np.zeros(len(starts), np.int64), []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            room = max(1, (1 << 18) // size)
            for at in range(0, len(rows), room):
                some = rows[at : at + room]
                ids, n = self._of_size(codes[starts[some][:, None] + np.arange(size)])
                counts[some] = n
                out.append(ids)
                where.append(some)
        if not out:
            return np.zeros(0, np.int32), counts
        order = np.concatenate(where)
        n = counts[order]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(n) - n
        return np.concatenate(out)[_ranges(at, counts)], counts

    def _of_size(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of one length: their ids, laid out from the right by the backpointers."""
        last, back = self._search(codes)
        n, size = codes.shape
        if size == 1 and (last[:, 1] < 0).any():
            found = [[i] if i >= 0 else self._raw(c) for i, c in zip(last[:, 1].tolist(), codes[:, 0].tolist(), strict=True)]
            return np.array([i for f in found for i in f], np.int32), np.array([len(f) for f in found], np.int64)
        out = np.full((n, size), -1, np.int32)
        ends, rows, filled = np.full(n, size), np.arange(n), np.zeros(n, np.int64)
        while len(rows := rows[ends[rows] > 0]):
            filled[rows] += 1
            out[rows, size - filled[rows]] = last[rows, ends[rows]]
            ends[rows] -= back[rows, ends[rows]]
        return out[out >= 0], filled

    def _raw(self, code: int) -> list[int]:
        """Byte pieces of a letter that the vocabulary lacks."""
        raw = [self.v.bytes.get(b) for b in chr(code).encode()]
        return [self.v.unknown] if None in raw else raw

    def _search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word and end position: the last piece of its best path, and that
        piece's length."""
        v, (n, size) = self.v, codes.shape
        probed = {}
        one = mix(codes.astype(np.uint64))
        h = np.zeros((n, size + 1), np.uint64)
        for k in range(1, min(size, v.longest) + 1):
            h = h[:, :-1] * _P + one[:, k - 1 :]
            if k in v.keys:
                keys, ids, spelt = v.keys[k]
                at = keys.find(h)
                row, start = np.nonzero(at >= 0)
                if len(row):
                    found = at[row, start]
                    same = (spelt[found] == codes[row[:, None], start[:, None] + np.arange(k)]).all(axis=1)
                    probed[k] = np.full(h.shape, -1, np.int32)
                    probed[k][row[same], start[same]] = ids[found[same]]
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        last, back = np.full((n, size + 1), -1, np.int32), np.ones((n, size + 1), np.int32)
        for end in range(1, size + 1):
            sizes = [k for k in probed if k <= end]
            if not sizes:
                continue
            value = np.full((len(sizes), n), -np.inf)
            pieces = np.stack([probed[k][:, end - k] for k in sizes])
            before = np.stack([best[:, end - k] for k in sizes])
            size_at, row = np.nonzero((pieces >= 0) & (before > -np.inf))
            if v.merges:
                ahead = np.stack([last[:, end - k] for k in sizes])[size_at, row]
                fits = ahead < 0  # the piece is the first of its word
                fits[~fits] = self._may_follow(ahead[~fits], pieces[size_at[~fits], row[~fits]])
                value[size_at[fits], row[fits]] = 0
            else:
                value[size_at, row] = before[size_at, row] + v.scores[pieces[size_at, row]]
            top = value.argmax(axis=0)
            best[:, end] = value[top, np.arange(n)]
            back[:, end] = np.array(sizes)[top]
            last[:, end] = pieces[top, np.arange(n)]
        return last, back

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, ends = self.ids_of(*self.laid_out(pa.array(texts, pa.string())))
        return [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []

    def spoken(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for, a space as models write it, and where those of
        each text end."""
        v = self.v
        n = v.said_n[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return v.said[_ranges(v.said_at[ids], n)].tobytes(), upto[ends]

    def decode(self, ids: list[int]) -> str:
        said, _ = self.spoken(np.array(ids, np.int64), np.array([len(ids)]))
        return self._plain(said)

    def _plain(self, said: bytes) -> str:
        text = said.decode("utf-8", "replace").replace(_SPACE, " ")
        return text[1:] if self.v.prefix and text[:1] == " " else text

    def restored(self, codes: np.ndarray, text_ends: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether decoding each text's ids gives the text back: as bytes, before the
        model's sign for a space becomes one."""
        said, said_ends = self.spoken(ids, ends)
        if said == codes.tobytes().decode("utf-32-le").encode():
            n = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))])
            if (n[text_ends] == said_ends).all():
                return np.ones(len(ends), bool)
        begin, said_begin = np.concatenate([[0], text_ends[:-1]]).tolist(), np.concatenate([[0], said_ends[:-1]]).tolist()
        return np.array([codes[a:b].tobytes().decode("utf-32-le").encode() == said[c:d] for a, b, c, d in zip(begin, text_ends.tolist(), said_begin, said_ends.tolist(), strict=True)], bool)


_held: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each worker process, so that tasks share what it remembers."""
    v = shared.value
    if v.digest not in _held:
        _held.clear()
        _held[v.digest] = Encoder(v)
    return _held[v.digest]


def _readable(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts as valid UTF-8, and which of them were not."""
    try:
        column.validate(full=True)
        return column, np.zeros(len(column), bool)
    except pa.ArrowInvalid:
        raw = column.cast(pa.large_binary()).to_pylist()
        own = [None if t is None else t.decode("utf-8", "replace") for t in raw]
        return pa.array(own, pa.string()), np.array([t is not None and t != o.encode() for t, o in zip(raw, own, strict=True)], bool)


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                own, broken = _readable(part.column("text"))
                codes, text_ends = encoder.laid_out(own)
                ids, ends = encoder.ids_of(codes, text_ends)
                same = encoder.restored(codes, text_ends, ids, ends) & ~broken & ~pc.fill_null(pc.match_substring(own, _SPACE), False).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], ends])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(same)], names=["doc_id", "n_tokens", "ids", "restored"])

    return run


def default_model() -> str:
    """The model file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and restored (whether decoding the ids gives the text
    back) for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file or default_model()))
    return docs.mapInArrow(_encode(shared), "doc_id long, n_tokens long, ids array<int>, restored boolean")


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            column = batch.column("ids")
            ids = column.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            said, ends = encoder.spoken(ids.astype(np.int64), np.cumsum(sizes))
            begin = [0, *ends.tolist()]
            own = [encoder._plain(said[a:b]) if ok else None for a, b, ok in zip(begin, begin[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.string())], names=["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text of encoded documents (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model_file or default_model()))
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shared), "doc_id long, text string")
