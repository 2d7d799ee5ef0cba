"""SentencePiece encoding and decoding with N-best segmentations.

Segmentations are paths through the lattice of all pieces that match a text; a path's score is the sum of its pieces'
scores in the vocabulary file. The best path and its scores to every place come from a forward Viterbi pass. A backward
A* search from the end then yields paths in order of score: its heuristic, the forward score, is exact, so it expands
little beyond the paths that it returns.

No piece of the vocabulary holds the space mark after another character (checked when it is read), so a text's lattice
is a chain of the lattices of its space-led words. Words are searched once and kept; the N best paths of a text are
those of its chain of words.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import read, small_batches
from emberlog.llm.words import mix

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Words kept with their paths in one task; when there are more, they are found again.
KEPT_WORDS = 300_000
#: Words searched together, and the length beyond which a word is searched by itself and not kept.
WORDS_AT_ONCE, LONG_WORD = 10_000, 64
#: Places of one part of a long word's lattice, and characters of words kept in one task.
PART, KEPT_CHARS = 1 << 16, 1 << 24

ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("score", T.DoubleType()),
    T.StructField("alternatives", T.ArrayType(T.StructType([
        T.StructField("score", T.DoubleType()),
        T.StructField("edits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))),
    ]))),
])
_EDIT = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]
    bytes: list[int]
    names: list[str]
    byte_score: float
    longest: int

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        whole = {n: (i, model.get_score(i)) for i, n in enumerate(names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        if any(MARK in n.lstrip(MARK) for n in whole):
            raise ValueError("a piece holds a space mark after another character")
        bytes_ = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        least = min(s for _, s in whole.values() if s > -1e8)  # pieces never to be used have scores far below
        return cls(whole, bytes_, names, least - 10, max(map(len, whole)))

    def lattice(self, word: str, lead: int) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """Edges (start, score, ids) into each place of a word whose first `lead` characters are space marks.

        Where no piece of one character matches, the character's bytes are an edge.
        """
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(word) + 1)]
        for i, c in enumerate(word):
            literal = i >= lead and c == MARK  # a mark in the text itself, not a space
            if not literal:
                for j in range(i + 1, min(len(word), i + self.longest) + 1):
                    if (found := self.pieces.get(word[i:j])) is not None and (i >= lead or j <= lead or word[i:j].count(MARK) == lead - i):
                        into[j].append((i, found[1], (found[0],)))
            if literal or c not in self.pieces:
                raw = c.encode("utf-8", "surrogatepass")
                into[i + 1].append((i, self.byte_score * len(raw), tuple(self.bytes[b] for b in raw)))
        return into


def n_best(into: list[list[tuple[int, float, tuple[int, ...]]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of a lattice, best first: forward Viterbi scores guide a backward A* search."""
    size = len(into)
    forward = [0.0] + [-np.inf] * (size - 1)
    for j in range(1, size):
        forward[j] = max((forward[i] + s for i, s, _ in into[j]), default=-np.inf)
    out: list[tuple[float, tuple[int, ...]]] = []
    heap, pushed = [(-forward[-1], 0, size - 1, 0.0, None)], 1
    while heap and len(out) < n:
        f, _, at, g, path = heapq.heappop(heap)
        if at == 0:
            ids: list[int] = []
            while path is not None:
                ids += path[0]
                path = path[1]
            out.append((-f, tuple(ids)))
            continue
        for i, s, piece in into[at]:
            heapq.heappush(heap, (-(g + s + forward[i]), pushed, i, g + s, (piece, path)))
            pushed += 1
    return out


class Matcher:
    """Numbers of the pieces that match at each place of many words of one length."""

    STEP = 0x100000001B3

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.longest = vocabulary.longest
        names = list(vocabulary.pieces)
        self.none = len(names)
        self.score = np.array([vocabulary.pieces[x][1] for x in names] + [-np.inf])
        self.id = np.array([vocabulary.pieces[x][0] for x in names] + [-1], np.int32)
        keys = np.zeros(len(names), np.uint64)
        for k, x in enumerate(names):
            h = 0
            for c in x:
                h = (h * self.STEP + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        keys = mix(keys)
        slot = (keys >> np.uint64(44)).astype(np.int64)
        number = np.arange(len(names), dtype=np.int32)
        self.table = np.full(1 << 20, self.none, np.int32)
        self.table[slot] = number
        self.keys = np.append(keys, np.uint64(0))
        lost = number[self.table[slot] != number]  # share a slot with another piece
        self.lost = lost[np.argsort(keys[lost])]
        self.lost_keys = keys[self.lost]
        self.crowded = np.zeros(1 << 20, bool)
        self.crowded[slot[lost]] = True

    def match(self, text: np.ndarray) -> list[np.ndarray]:
        """text: characters by place and word. By length 1.. : the piece at each place of each word, or `none`."""
        h, out = np.zeros_like(text), []
        with np.errstate(over="ignore"):
            for n in range(1, min(len(text), self.longest) + 1):
                h = h[: len(text) - n + 1] * np.uint64(self.STEP) + text[n - 1 :] + np.uint64(1)
                key = mix(h)
                slot = (key >> np.uint64(44)).astype(np.int64)
                found = self.table[slot]
                found[self.keys[found] != key] = self.none
                if len(self.lost) and (busy := self.crowded[slot]).any():
                    some = key[busy]
                    at = np.minimum(np.searchsorted(self.lost_keys, some), len(self.lost) - 1)
                    found[busy] = np.where(self.lost_keys[at] == some, self.lost[at], found[busy])
                out.append(found)
        return out


class LongLattice:
    """The lattice of one long word, made a part at a time, so that memory beyond 8 bytes a character doesn't follow its length.

    The forward pass goes through the parts in order, with the scores of the places before as its frontier; the search
    backward makes a part again when it comes to it, and keeps a few.
    """

    def __init__(self, vocabulary: Vocabulary, matcher: Matcher, word: str, lead: int) -> None:
        self.vocabulary, self.matcher, self.lead = vocabulary, matcher, lead
        self.text = np.frombuffer((MARK * lead + word).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size, self.parts = len(self.text), OrderedDict()

    def part(self, k: int) -> tuple[list[int], list[int], list[float], list[int]]:
        """Edges into places k * PART + 1 .. (k + 1) * PART: where each place's begin, and of every edge its start, score and
        code (number of the piece, or -2 - c for the bytes of character c). Edges into a place are in order of start."""
        if (found := self.parts.get(k)) is not None:
            self.parts.move_to_end(k)
            return found
        top = min(self.size, (k + 1) * PART)
        low = max(0, k * PART + 1 - self.matcher.longest)
        text = self.text[low:top].astype(np.uint64)
        marks = np.append(0, np.cumsum(text == ord(MARK)))
        literal = (text == ord(MARK)) & (np.arange(low, top) >= self.lead)
        starts, ends, codes = [], [], []
        for n, matched in enumerate(self.matcher.match(text[:, None]), 1):
            i = np.flatnonzero((matched[:, 0] != self.matcher.none) & ~literal[: len(matched)])
            # A piece over the end of the leading marks holds these only.
            mixed = (low + i < self.lead) & (low + i + n > self.lead)
            i = i[~mixed | (marks[i + n] - marks[i] == self.lead - low - i)]
            starts.append(i), ends.append(i + n), codes.append(matched[i, 0].astype(np.int64))
            if n == 1:
                bare = np.flatnonzero(literal | (matched[:, 0] == self.matcher.none))
                starts.append(bare), ends.append(bare + 1), codes.append(-2 - text[bare].astype(np.int64))
        start, end, code = (np.concatenate(x) for x in (starts, ends, codes))
        keep = end + low > k * PART
        start, end, code = start[keep] + low, end[keep] + low, code[keep]
        order = np.lexsort((code < 0, start, end))
        start, end, code = start[order], end[order], code[order]
        c = np.where(code < 0, -2 - code, 0)
        width = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
        score = np.where(code < 0, self.vocabulary.byte_score * width, self.matcher.score[np.maximum(code, 0)])
        cut = np.searchsorted(end, np.arange(k * PART + 1, top + 2))
        self.parts[k] = found = (cut.tolist(), start.tolist(), score.tolist(), code.tolist())
        if len(self.parts) > 4:
            self.parts.popitem(last=False)
        return found

    def n_best(self, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """As n_best() of the whole lattice."""
        forward = array("d", [0.0]) * (self.size + 1)
        for k in range(-(-self.size // PART)):
            cut, start, score, _ = self.part(k)
            for j in range(len(cut) - 1):
                forward[k * PART + j + 1] = max((forward[start[e]] + score[e] for e in range(cut[j], cut[j + 1])), default=-np.inf)
        out: list[tuple[float, tuple[int, ...]]] = []
        heap, pushed = [(-forward[-1], 0, self.size, 0.0, None)], 1
        while heap and len(out) < n:
            f, _, at, g, path = heapq.heappop(heap)
            if at == 0:
                codes: list[int] = []
                while path is not None:
                    codes.append(path[0])
                    path = path[1]
                codes = np.array(codes, np.int64)
                ids = np.where(codes < 0, codes, self.matcher.id[np.maximum(codes, 0)])
                out.append((-f, tuple(_spelt(ids, np.array([len(ids)]), self.vocabulary)[0].tolist())))
                continue
            k, j = divmod(at - 1, PART)
            cut, start, score, code = self.part(k)
            for e in range(cut[j], cut[j + 1]):
                heapq.heappush(heap, (-(g + score[e] + forward[start[e]]), pushed, start[e], g + score[e], (code[e], path)))
                pushed -= 1  # of equals the newest first: straight to the start, not through all of them
        return out


@dataclass
class Best:
    """Best paths of some words: their ids in a row, each word's number of ids, score, and loss of the second path."""

    ids: np.ndarray
    count: np.ndarray
    score: np.ndarray
    gap: np.ndarray


def _spelt(codes: np.ndarray, count: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Codes below -1 stand for characters without a piece; their bytes' ids take their place."""
    raw = codes < -1
    if not raw.any():
        return codes.astype(np.int32), count
    c = np.where(raw, -2 - codes, 0)
    width = np.where(raw, np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4))), 1)
    at = np.append(0, np.cumsum(width))
    out = np.empty(at[-1], np.int32)
    out[at[:-1]] = codes
    of = np.array(vocabulary.bytes, np.int32)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for n in range(1, 5):
        own = np.flatnonzero(raw & (width == n))
        for k in range(n):
            bits = c[own] >> (6 * (n - 1 - k))
            out[at[own] + k] = of[bits if n == 1 else (bits | lead[n]) if k == 0 else (bits & 0x3F) | 0x80]
    word = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(word, width, len(count)).astype(np.int64)


def viterbi(words: list[str], vocabulary: Vocabulary, matcher: Matcher) -> Best:
    """Best paths of many space-led words (one space each) of one length, all a place further at each step.

    The second path's loss is the least that another edge into a place of the best path loses: beyond it the best path
    is followed, and before it the forward score is exact.
    """
    many, size = len(words), len(words[0]) + 1
    raw = "".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass")
    text = np.ascontiguousarray(np.frombuffer(raw, np.uint32).reshape(many, size).T).astype(np.uint64)
    matched = matcher.match(text)
    bare = matched[0] == matcher.none
    bare[1:] |= text[1:] == ord(MARK)
    scores = [matcher.score[x] for x in matched]
    width = np.where(text < 0x80, 1, np.where(text < 0x800, 2, np.where(text < 0x10000, 3, 4)))
    scores[0] = np.where(bare, vocabulary.byte_score * width, scores[0])
    forward, loss, back = np.zeros((size + 1, many)), np.full((size + 1, many), np.inf), np.zeros((size + 1, many), np.int64)
    for j in range(1, size + 1):
        best, second = forward[j - 1] + scores[0][j - 1], np.full(many, -np.inf)
        by = np.ones(many, np.int64)
        for n in range(2, min(j, len(scores)) + 1):
            score = forward[j - n] + scores[n - 1][j - n]
            second = np.maximum(second, np.minimum(best, score))
            by[score > best] = n
            best = np.maximum(best, score)
        forward[j], back[j], loss[j] = best, by, best - second
    # Back from the ends: a piece of every word at each step, the last one first.
    at, every, steps, gap = np.full(many, size), np.arange(many), [], np.full(many, np.inf)
    flat = np.full((len(matched), size, many), matcher.none, np.int32)
    for n, x in enumerate(matched):
        flat[n, : len(x)] = x
    while (on := every[at > 0]).size:
        n = back[at[on], on]
        gap[on] = np.minimum(gap[on], loss[at[on], on])
        c = at[on] - n
        code = np.full(many, -1, np.int64)
        code[on] = np.where((n == 1) & bare[c, on], -2 - text[c, on].astype(np.int64), matcher.id[flat[n - 1, c, on]])
        steps.append(code)
        at[on] = c
    table = np.column_stack(steps[::-1])
    ids, count = _spelt(table[table != -1], (table != -1).sum(1), vocabulary)
    return Best(ids, count, forward[size], gap)


class Encoder:
    """N-best encoder of whole texts, a batch at a time. Known words are numbered; number 0 is no word."""

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST) -> None:
        self.vocabulary, self.matcher, self.n = vocabulary, Matcher(vocabulary), n
        self.paths: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self.forget()

    def forget(self) -> None:
        self.last, self.held = None, 0
        self.known: dict[str | tuple[str, int], int] = {}
        self.best = Best(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1), np.full(1, np.inf))
        self.start = np.zeros(1, np.int64)

    def add(self, keys: list, found: list[Best]) -> None:
        self.known.update(zip(keys, range(len(self.best.count), len(self.best.count) + len(keys))))
        every = [self.best, *found]
        self.best = Best(*(np.concatenate([getattr(x, name) for x in every]) for name in ("ids", "count", "score", "gap")))
        self.start = np.append(0, np.cumsum(self.best.count))[:-1]

    def all_paths(self, word: str, lead: int) -> list[tuple[float, tuple[int, ...]]]:
        found = self.paths.get((word, lead))
        if found is None:
            if len(self.paths) > KEPT_WORDS // 10:
                self.paths.clear()
            if len(word) > LONG_WORD:  # kept until the next such word, as one text asks for it twice
                if self.last is None or self.last[0] != (word, lead):
                    self.last = ((word, lead), LongLattice(self.vocabulary, self.matcher, word, lead).n_best(self.n))
                return self.last[1]
            found = self.paths[word, lead] = n_best(self.vocabulary.lattice(MARK * lead + word, lead), self.n)
        return found

    def words(self, text: str) -> list[str | tuple[str, int]]:
        """The space-led words of a text, which gets a space before it; those with several spaces with their number."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            every = [(w.lstrip(" "), len(w) - len(w.lstrip(" "))) for w in re.findall(" +[^ ]*", " " + text)]
            return [w if lead == 1 and w else (w, lead) for w, lead in every]
        return text.split(" ")

    def learn(self, texts: list[list[str | tuple[str, int]]]) -> None:
        """Number the new words of some texts' words, and find their best paths."""
        if len(self.known) > KEPT_WORDS or self.held > KEPT_CHARS:
            self.forget()
        new: dict[int, list] = {}
        for w in {w for t in texts for w in t}.difference(self.known):
            new.setdefault(len(w) if isinstance(w, str) and len(w) <= LONG_WORD else 0, []).append(w)
        keys, found = [], []
        self.held += sum(len(w if isinstance(w, str) else w[0]) for words in new.values() for w in words)
        for size, words in new.items():
            for k in range(0, len(words), WORDS_AT_ONCE):
                part = words[k : k + WORDS_AT_ONCE]
                keys += part
                if size:
                    found.append(viterbi(part, self.vocabulary, self.matcher))
                    continue
                paths = [self.all_paths(*(w if isinstance(w, tuple) else (w, 1))) for w in part]
                found.append(Best(
                    np.fromiter(chain.from_iterable(p[0][1] for p in paths), np.int32), np.array([len(p[0][1]) for p in paths]),
                    np.array([p[0][0] for p in paths]), np.array([p[0][0] - p[1][0] if len(p) > 1 else np.inf for p in paths]),
                ))
        if keys:
            self.add(keys, found)

    def others(self, words: list, at: np.ndarray, score: float) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
        """The next n-1 (score, [(word number, ids)]) of a text whose words have the numbers `at`."""
        if self.n < 2 or not len(at):
            return []
        gaps = self.best.gap[at]
        # Only the n-1 words with the least losses can differ from the best path: other changes have n-1 better ones.
        few = np.flatnonzero(gaps <= np.partition(gaps, self.n - 2)[self.n - 2]) if len(gaps) > self.n else np.arange(len(gaps))
        loose = sorted((gaps[k], int(k)) for k in few if gaps[k] < np.inf)[: self.n - 1]
        options = []
        for _, k in loose:
            name, lead = words[k] if isinstance(words[k], tuple) else (words[k], 1)
            i = at[k]
            best = (self.best.score[i], tuple(self.best.ids[self.start[i] : self.start[i] + self.best.count[i]].tolist()))
            options.append([best, *(x for x in self.all_paths(name, lead) if x[1] != best[1])][: self.n])
        heap, out = [(0.0, (0,) * len(loose), 0)], []
        while heap and len(out) < self.n:
            lost, choice, first = heapq.heappop(heap)
            out.append((float(score - lost), [(k, options[x][c][1]) for x, (c, (_, k)) in enumerate(zip(choice, loose)) if c]))
            for x in range(first, len(loose)):
                if choice[x] + 1 < len(options[x]):
                    more = options[x][choice[x]][0] - options[x][choice[x] + 1][0]
                    heapq.heappush(heap, (lost + more, (*choice[:x], choice[x] + 1, *choice[x + 1 :]), x))
        return out[1:]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[float], list[list[dict]]]:
        """Ids of all texts in a row, where each text's end (n+1 offsets), best scores, alternatives as edits."""
        words = [self.words(t or "") for t in texts]
        self.learn(words)
        sizes = np.array([len(w) for w in words])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        count, end = self.best.count[at], np.append(0, np.cumsum(sizes))
        place = np.append(0, np.cumsum(count))
        ids = self.best.ids[np.repeat(self.start[at] - place[:-1], count) + np.arange(place[-1])]
        scores, alternatives = [], []
        for k, (lo, hi) in enumerate(zip(end, end[1:])):
            score = float(self.best.score[at[lo:hi]].sum())
            edits = []
            for s, changes in self.others(words[k], at[lo:hi], score):
                where = [(int(place[lo + w] - place[lo]), int(count[lo + w]), x) for w, x in sorted(changes)]
                edits.append({"score": s, "edits": [_edit(ids[place[lo] + a : place[lo] + a + n], a, x) for a, n, x in where]})
            scores.append(score)
            alternatives.append(edits)
        return ids, place[end], scores, alternatives


def _edit(before: np.ndarray, at: int, after: tuple[int, ...]) -> dict:
    """What of a word's ids changes; of a long word's only the part that differs."""
    if len(before) <= LONG_WORD:
        return {"start": at, "stop": at + len(before), "ids": after}
    new, least = np.array(after, before.dtype), min(len(before), len(after))
    differ = np.flatnonzero(before[:least] != new[:least])
    head = int(differ[0]) if len(differ) else least
    differ = np.flatnonzero(before[::-1][: least - head] != new[::-1][: least - head])
    tail = int(differ[0]) if len(differ) else least - head
    return {"start": at + head, "stop": at + len(before) - tail, "ids": after[head : len(after) - tail]}


def spellings(names: list[str]) -> list[bytes]:
    """The bytes of each piece: a byte piece's own, and for others UTF-8 with spaces for marks."""
    return [bytes([int(n[3:5], 16)]) if len(n) == 6 and n.startswith("<0x") else n.replace(MARK, " ").encode() for n in names]


def joined(ids: list[int], spelt: list[bytes]) -> str:
    text = b"".join(map(spelt.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decode_ids(ids: list[int], names: list[str]) -> str:
    """The text of some ids: byte pieces are joined to UTF-8, marks become spaces, the first space goes."""
    return joined(ids, spellings(names))


def _encoded(batches: Iterator[pa.RecordBatch], text_col: str, vocabulary: Vocabulary, n: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary, n)
    for batch in batches:
        texts = batch.column(text_col).to_pylist()
        ids, ends, scores, alternatives = encoder.encode(texts)
        fields = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(scores, pa.float64()), pa.array(alternatives, _ALTERNATIVES)]
        found = pa.StructArray.from_arrays(fields, ["ids", "score", "alternatives"], mask=pa.array([t is None for t in texts], pa.bool_()))
        yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "encoded"])


def _decoded(batches: Iterator[pa.RecordBatch], ids_of: Callable[[pa.RecordBatch], pa.ListArray], spelt: list[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = ids_of(batch)
        ids, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        texts = [joined(ids[lo:hi], spelt) if there else None for lo, hi, there in zip([0, *ends], ends, column.is_valid().to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """docs with a column `encoded` (replacing one of that name): ids and score of the best path, and alternatives.

    An alternative is one of the next n-1 paths, as edits: ids[start:stop] of the best path give way to other ids. There
    are fewer where a text has fewer paths. Null texts have null, empty texts no ids and score 0. Long texts are encoded
    whole, texts without spaces too: their lattice is made a part at a time. Of paths of equal score any may come first, the same in every run
    over the same batch. Repeated rows are encoded alike. An empty table gives an empty result. The vocabulary is read by the driver and broadcast (its size is that of the file).
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("encoded")
    sent = spark.sparkContext.broadcast(Vocabulary.load(model))
    schema = T.StructType([*docs.schema.fields, T.StructField("encoded", ENCODED)])
    return docs.mapInArrow(lambda batches: _encoded(batches, text_col, sent.value, n), schema)


def decode(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """rows with a column `decoded` (replacing one of that name); null ids have null."""
    rows = rows.drop("decoded")
    sent = rows.sparkSession.sparkContext.broadcast(spellings(Vocabulary.load(model).names))
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(lambda batches: _decoded(batches, lambda b: b.column(ids_col), sent.value), schema)


def round_trip(docs: DataFrame, text_col: str = "text", model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """docs with `encoded` as by encode(), the digest of the text decoded from its ids, and whether that is the text itself.

    These are `decoded_sha256` and `round_trip` (replacing ones of these names); null texts have null in both.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("encoded", "decoded_sha256", "round_trip", "decoded")
    vocabulary = Vocabulary.load(model)
    sent, spelt = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(spellings(vocabulary.names))
    schema = T.StructType([*docs.schema.fields, T.StructField("encoded", ENCODED), T.StructField("decoded", T.StringType())])
    # Both in one pass: a second one would double the Python workers, and send every text and id through them again.
    rows = docs.mapInArrow(lambda batches: _decoded(_encoded(batches, text_col, sent.value, n), lambda b: b.column("encoded").flatten()[0], spelt.value), schema)
    return rows.withColumns({"decoded_sha256": F.sha2("decoded", 256), "round_trip": F.col("decoded") == F.col(text_col)}).drop("decoded")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.size("encoded.ids").cast("long").alias("n_pieces"), "encoded.score", "encoded.ids", "encoded.alternatives", "decoded_sha256", "round_trip")
