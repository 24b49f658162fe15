"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Words of equal length advance together: at each position the hashes of all substrings that end there probe the sorted
piece keys, the score of every candidate is computed for all words at once, and the vectorised maximum stores a backpointer.

For unigram models the score is the sum of the piece scores. A BPE model doesn't maximise a sum: it applies merges by rank. There
a candidate is admitted if it may follow the last piece of the best segmentation before it, that is if merging the two
pieces' characters gives these two pieces again; exactly one candidate at each position is admitted, and the path is
the result of the merges. Pairs are checked by undoing merges, vectorised, and remembered.

Words are cut at white space, and long ones wherever no piece spans two neighbouring characters, so cuts change nothing. One
pass over the rows, no shuffle; the model (bounded by its vocabulary) is broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.common import map_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNKNOWN_PENALTY = 10.0
#: Words longer than this are cut at characters that no piece spans; words remembered by a task.
LONG, REMEMBER = 24, 150_000
#: Words longer than this that can't be cut advance alone, so many of their characters being probed at once.
ALONE, STRETCH = 512, 100_000
#: Characters that are split into words at once.
CHARS = 2_000_000
#: Characters of words that advance together.
MANY = 500_000

#: Bits that address runs of the sorted keys, and slots of remembered pairs.
_TOP, _SLOTS = 18, 20
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = np.uint64(0xFF51AFD7ED558CCD)  # spreads the keys of short pieces over the top bits
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _keys(chars: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of the rows of (n, length) code points."""
    h = np.zeros(len(chars), np.uint64)
    for c in chars.T:
        h = h * base + c.astype(np.uint64) + np.uint64(1)
    return h


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


@dataclass
class Model:
    """The tables of a model. Piece places are ids; rank orders merges, -1 for single characters."""

    pieces: list[str]
    scores: np.ndarray
    kind: int
    unknown: int
    bytes_of: dict[int, int]  # byte -> id
    dummy_prefix: bool
    keys: np.ndarray = None
    checks: np.ndarray = None
    ids: np.ndarray = None
    first: np.ndarray = None  # place of the first key with each value of the top bits, or after
    lengths: list[int] = field(default_factory=list)
    bigrams: np.ndarray = None
    rank: np.ndarray = None
    left: np.ndarray = None
    right: np.ndarray = None
    merge_keys: np.ndarray = None
    merge_rank: np.ndarray = None


def load(data: bytes) -> Model:
    """Read a model file. Raises for what isn't supported: normalisation rules, user-defined pieces, pieces with white space inside."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(data)
    n, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    if kind not in (UNIGRAM, BPE) or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("this model isn't supported")
    pieces = [p.piece for p in proto.pieces]
    types = np.array([p.type for p in proto.pieces])
    usable = np.flatnonzero(types == NORMAL)
    if (types == 4).any() or any(SPACE in pieces[i].lstrip(SPACE) for i in usable):
        raise ValueError("user-defined pieces, and pieces with white space inside, aren't supported")
    m = Model(pieces, np.array([p.score for p in proto.pieces], np.float64), kind, int(np.flatnonzero(types == UNKNOWN)[0]), {int(pieces[i][1:-1], 16): int(i) for i in np.flatnonzero(types == BYTE)}, n.add_dummy_prefix)
    if kind == BPE:
        usable = _merges(m, usable)
    by_length: dict[int, list[int]] = {}
    for i in usable:
        by_length.setdefault(len(pieces[i]), []).append(int(i))
    m.lengths = sorted(by_length)
    ids, keys, checks, bigrams = [], [], [], [np.zeros(0, np.uint64)]
    for length, own in by_length.items():
        chars = _points([pieces[i] for i in own], length)
        ids += own
        keys.append(_keys(chars, _BASES[0]) * _MIX)
        checks.append(_keys(chars, _BASES[1]))
        bigrams += [_pair(chars[:, i], chars[:, i + 1]) for i in range(length - 1)]
    keys, checks = np.concatenate(keys), np.concatenate(checks)
    order = np.argsort(keys, kind="stable")
    m.keys, m.checks, m.ids = keys[order], checks[order], np.array(ids)[order]
    m.first = np.searchsorted(m.keys, np.arange((1 << _TOP) + 1, dtype=np.float64) * 2.0 ** (64 - _TOP)).astype(np.int32)
    m.bigrams = np.unique(np.concatenate(bigrams))
    return m


def _probe(m: Model, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place): which keys are piece keys, and where. The top bits give a short run of the sorted keys."""
    top = (keys >> np.uint64(64 - _TOP)).astype(np.int64)
    at = m.first[top]
    live = np.flatnonzero(at < m.first[top + 1])
    found, places = [], []
    at, end, keys = at[live], m.first[top[live] + 1], keys[live]
    while len(live):
        same = m.keys[at] == keys
        found.append(live[same])
        places.append(at[same])
        more = np.flatnonzero(~same & (at + 1 < end))
        live, at, end, keys = live[more], at[more] + 1, end[more], keys[more]
    return (np.concatenate(found), np.concatenate(places)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)


def _merges(m: Model, usable: np.ndarray) -> np.ndarray:
    """Fill the merge tables: how each piece is made from two others. Pieces that merging never makes are dropped."""
    id_of = {m.pieces[i]: int(i) for i in usable}
    n = len(m.pieces)
    order = sorted((i for i in usable if len(m.pieces[i]) > 1), key=lambda i: -m.scores[i])
    m.rank = np.full(n, -1, np.int64)
    m.rank[order] = np.arange(len(order))
    m.left, m.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    reached = [int(i) for i in usable if len(m.pieces[i]) == 1]
    for i in order:
        parts = list(m.pieces[i])
        while len(parts) > 2:
            near = [(m.rank[id_of[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in id_of]
            if not near:
                break
            _, k = min(near)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2 and parts[0] in id_of and parts[1] in id_of:
            m.left[i], m.right[i] = id_of[parts[0]], id_of[parts[1]]
            reached.append(int(i))
    made = np.flatnonzero(m.left >= 0)
    keys = m.left[made] * n + m.right[made]
    by = np.argsort(keys)
    m.merge_keys, m.merge_rank = keys[by], m.rank[made][by]
    return np.array(sorted(reached))


def may_follow(m: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the characters of pieces a and b gives a, b again. Merges are undone, the latest first: at each
    step, no merge across the border may come before the one undone on its side (on the right also not with it)."""
    ok = np.ones(len(a), bool)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)
    while len(live):
        key = a * len(m.pieces) + b
        at = np.minimum(np.searchsorted(m.merge_keys, key), len(m.merge_keys) - 1)
        crossed = (m.merge_keys[at] == key) & (m.merge_rank[at] < limit)
        ok[live[crossed]] = False
        ra, rb = m.rank[a], m.rank[b]
        go = ~crossed & ((ra >= 0) | (rb >= 0))
        live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
        from_left = ra > rb
        limit = np.where(from_left, ra, rb + 1)
        a, b = np.where(from_left, m.right[a], a), np.where(from_left, b, m.left[b])
    return ok


def may_follow_one(m: Model):
    """may_follow for a pair at a time, from tables for it."""
    merge = {divmod(k, len(m.pieces)): r for k, r in zip(m.merge_keys.tolist(), m.merge_rank.tolist())}
    rank, left, right = m.rank.tolist(), m.left.tolist(), m.right.tolist()

    def ask(a: int, b: int) -> bool:
        limit = float("inf")
        while True:
            if merge.get((a, b), limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, limit = right[a], ra
            else:
                b, limit = left[b], rb + 1

    return ask


class Codec:
    """Encodes and decodes with a model; one in each task."""

    def __init__(self, model: Model):
        self.m = model
        self.words: dict[str, bytes] = {}  # the ids of a word, as int32
        self.ask = None
        self.pair_keys, self.pair_ok = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, bool)
        self.surface = [(p.replace(SPACE, " ").encode("utf-8", "replace")) for p in model.pieces]
        for value, i in model.bytes_of.items():
            self.surface[i] = bytes([value])
        self.least = float(model.scores.min()) - UNKNOWN_PENALTY

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow, with a slot for each remembered pair; a newer pair takes the slot of an older one."""
        key = a * len(self.m.pieces) + b
        slot = (key.astype(np.uint64) * _BASES[0] >> np.uint64(64 - _SLOTS)).astype(np.int64)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            own, back = np.unique(key[new], return_inverse=True)
            fresh = may_follow(self.m, own // len(self.m.pieces), own % len(self.m.pieces))[back]
            ok[new] = fresh
            # pairs that meet in a slot: only the last one written is remembered, key and answer alike
            into, last = np.unique(slot[new][::-1], return_index=True)
            last = len(new) - 1 - last
            self.pair_keys[into], self.pair_ok[into] = key[new][last], fresh[last]
        return ok

    def _batch(self, words: list[str], length: int) -> list[bytes]:
        """Viterbi over words of one length."""
        m, n = self.m, len(words)
        chars = _points(words, length)
        sums = [np.zeros((length + 1, n), np.uint64) for _ in _BASES]
        for h, base in zip(sums, _BASES):
            for i in range(length):
                h[i + 1] = h[i] * base + chars[:, i].astype(np.uint64) + np.uint64(1)
        longest = max(m.lengths)
        powers = [[np.uint64(pow(int(b), k, 1 << 64)) for k in range(longest + 1)] for b in _BASES]
        best = np.zeros((length + 1, n))
        last = np.full((length + 1, n), -1, np.int64)  # piece that ends here; -1: none, or unknown
        back = np.zeros((length + 1, n), np.int32)
        for i in range(1, length + 1):
            # an unknown character: one position, worse than any piece
            top = best[i - 1] + self.least
            piece, step = np.full(n, -1, np.int64), np.ones(n, np.int32)
            for k in m.lengths:
                if k > i:
                    break
                hit, at = _probe(m, (sums[0][i] - sums[0][i - k] * powers[0][k]) * _MIX)
                if not len(hit):
                    continue
                true = m.checks[at] == sums[1][i][hit] - sums[1][i - k][hit] * powers[1][k]
                hit, cand = hit[true], m.ids[at[true]]
                if m.kind == BPE:
                    prev = last[i - k][hit]
                    ok = prev < 0  # at the start, or after a character that no merge crosses
                    ask = np.flatnonzero(~ok)
                    ok[ask] = self._follows(prev[ask], cand[ask])
                    hit, cand = hit[ok], cand[ok]
                    score = np.zeros(len(hit))
                else:
                    score = best[i - k][hit] + m.scores[cand]
                win = score > top[hit]
                hit = hit[win]
                top[hit], piece[hit], step[hit] = score[win], cand[win], k
            best[i], last[i], back[i] = top if m.kind != BPE else 0, piece, step
        # back along the pointers, all words at once; -2 stands for nothing
        at, every, path = np.full(n, length), np.arange(n), []
        while at.any():
            p = last[at, every]
            p[at == 0] = -2
            path.append(p)
            at = at - back[at, every]
        grid = np.array(path[::-1], np.int32).T
        flat, ends = grid[grid > -2].tobytes(), np.cumsum((grid > -2).sum(1)) * 4
        starts = np.concatenate([[0], ends[:-1]])
        out = [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        for w in np.flatnonzero((grid == -1).any(1)):
            out[w] = self._with_unknown(words[w], last[:, w], back[:, w])
        return out

    def _alone(self, word: str) -> bytes:
        """Viterbi over one long word: the substrings that end in a stretch of it are probed together, then the maxima run over the hits."""
        m, n = self.m, len(word)
        longest = max(m.lengths)
        last, back, best = [-1] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
        bpe, least = m.kind == BPE, self.least
        if bpe and self.ask is None:
            self.ask = may_follow_one(m)
        for at in range(0, n, STRETCH):
            start, end = max(0, at - longest), min(n, at + STRETCH)
            chars = _points([word[start:end]], end - start)[0].astype(np.uint64) + np.uint64(1)
            # h[i] = sum of c[j] b^(i - 1 - j), by sums of c[j] b^-(j + 1); all bases are odd, so they have inverses modulo 2^64
            sums = []
            for base in _BASES:
                up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(chars), base))])
                down = np.cumprod(np.full(len(chars), np.uint64(pow(int(base), -1, 1 << 64))))
                sums.append((up * np.concatenate([[np.uint64(0)], np.cumsum(chars * down)]), up))
            (h0, p0), (h1, p1) = sums
            hits: list[list[tuple[int, int]]] = [[] for _ in range(end - at)]
            for k in m.lengths:
                i = np.arange(max(at - start + 1, k), end - start + 1)
                found, place = _probe(m, (h0[i] - h0[i - k] * p0[k]) * _MIX) if len(i) else ((), ())
                if len(found):
                    true = m.checks[place] == h1[i[found]] - h1[i[found] - k] * p1[k]
                    for j, c in zip((i[found[true]] - (at - start) - 1).tolist(), m.ids[place[true]].tolist()):
                        hits[j].append((k, c))
            for j, own in enumerate(hits):
                i = at + j + 1
                top, piece, step = best[i - 1] + least, -1, 1
                for k, c in sorted(own):
                    if bpe:
                        prev = last[i - k]
                        if prev >= 0 and not self.ask(prev, c):
                            continue
                        score = 0.0
                    else:
                        score = best[i - k] + float(m.scores[c])
                    if score > top:
                        top, piece, step = score, c, k
                best[i], last[i], back[i] = 0.0 if bpe else top, piece, step
        return self._with_unknown(word, last, back)

    def _with_unknown(self, word: str, last: np.ndarray, back: np.ndarray) -> bytes:
        ids, i = [], len(word)
        while i:
            ids += [int(last[i])] if last[i] >= 0 else reversed(self._unknown(word[i - 1]))
            i -= int(back[i])
        return np.array(ids[::-1], np.int32).tobytes()

    def _unknown(self, char: str) -> list[int]:
        if not self.m.bytes_of:
            return [self.m.unknown]
        return [self.m.bytes_of[b] for b in char.encode("utf-8", "replace")]

    def _cut(self, word: str) -> list[str]:
        """Parts between which no piece spans two characters."""
        if len(word) <= LONG:
            return [word]
        c = _points([word], len(word))[0]
        pair = _pair(c[:-1], c[1:])
        at = np.minimum(np.searchsorted(self.m.bigrams, pair), len(self.m.bigrams) - 1)
        cuts = [0, *(np.flatnonzero(self.m.bigrams[at] != pair) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts are split and encoded a bounded number of characters at a time."""
        out, part, size = [], [], 0
        for t in texts:
            if part and size + len(t) > CHARS:
                out += self._encode(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        split = []
        for t in texts:
            words = _WORDS.findall(SPACE * self.m.dummy_prefix + t.replace(" ", SPACE)) if t else []
            if words and max(map(len, words)) > LONG:
                words = [p for w in words for p in self._cut(w)]
            split.append(words)
        if len(self.words) > REMEMBER:
            self.words.clear()
        known = self.words
        new: dict[int, list[str]] = {}
        for w in set().union(*split) - known.keys():
            new.setdefault(len(w), []).append(w)
        for length, words in new.items():
            if length > ALONE:
                known.update((w, self._alone(w)) for w in words)
                continue
            many = max(1, MANY // length)
            for k in range(0, len(words), many):
                part = words[k : k + many]
                known.update(zip(part, self._batch(part, length)))
        out = [np.frombuffer(b"".join(map(known.__getitem__, s)), np.int32) for s in split]
        return out if self.m.bytes_of else [self._joined(x) for x in out]

    def _joined(self, ids: np.ndarray) -> np.ndarray:
        """Without byte pieces a run of unknown characters is one piece."""
        unknown = ids == self.m.unknown
        return ids[~(unknown & np.concatenate([[False], unknown[:-1]]))] if len(ids) else ids

    def decode(self, ids) -> str:
        text = b"".join(map(self.surface.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if self.m.dummy_prefix and text.startswith(" ") else text


def sentencepiece_encode(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL, with_ids: bool = True) -> DataFrame:
    """The columns ``keep``, n_tokens, token_sha256 (of the ids as little-endian 32-bit integers), and round_trip: decoding gives the text again.

    With ``with_ids`` also ids, the tokens. Null and empty texts have no tokens and make the round trip (to the empty text).
    A text that holds U+2581 itself doesn't: the format can't tell it from a space. Repeated rows are encoded alike; an empty
    table gives an empty result. A kept column whose name is a result's gets underscores at its end.
    """
    import hashlib

    with open(model, "rb") as f:
        tables = docs.sparkSession.sparkContext.broadcast(load(f.read()))

    def encode():
        codec = Codec(tables.value)

        def each(texts: list) -> list:
            texts = [t or "" for t in texts]
            ids = codec.encode(texts)
            out = [[len(x) for x in ids], [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], [codec.decode(x) == t for x, t in zip(ids, texts)]]
            return [*out, ids] if with_ids else out

        return each

    return map_rows(docs, [docs[text]], list(keep), "n_tokens long, token_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids, encode)
