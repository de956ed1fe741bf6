"""SentencePiece encoding and decoding by a max-plus scan.

The best segmentation of a text maximises the sum of its pieces' scores (the unigram lattice). Giant
texts, of ``chunk`` characters and more, are cut into chunks at fixed offsets. A piece may straddle a cut, so the state at a cut is
how many characters past it the straddling piece ends. A chunk yields the transfer matrix of best
scores from each state at its start to each state at its end; matrices combine associatively in
max-plus arithmetic, in two levels of blocks. With the scores at its start known, each chunk
tells for every end state the start state it goes back to; those maps compose from the right, and then
each chunk is backtraced on its own.

Scores are the model file's. Whole-number scores, as in the files here, add up exactly, and equal sums go to the
longer last piece, so the result does not depend on where the cuts fall.

Inside a chunk, a space that follows another character ends every piece, since no piece of the
vocabulary goes on past it (checked when the model is loaded), and so does a character that is in no piece. The runs between
are solved many at a time and remembered.

Spaces are the model's word marks and one is put before the text. A character that no piece covers, and a literal
word mark (U+2581), becomes byte pieces, so ``decode(encode(x)) == x`` for every text. Defined cases: null text has
null ids; the empty text has no ids; repeated rows and null ids are kept; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, new_folder, python_rows, segments, stage, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = 65_536
BLOCK = 256
SEGMENT = 1 << 18
#: Runs of up to so many characters are remembered, and about so many of them in each worker.
REMEMBERED = 40
MEMORY = 100_000
UNK_PENALTY = 10
NEG = -(1 << 62)


class Vocabulary:
    """Pieces with their scores, spelled with plain spaces."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: list[int], spelling: dict[int, str], unk_score: int):
        self.pieces, self.byte_ids, self.spelling, self.unk_score = pieces, byte_ids, spelling, unk_score
        self.longest = max(map(len, pieces), default=1)
        self.raw = {i: t.encode("utf-8", "surrogatepass") for i, t in spelling.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        spelled = [self.raw.get(i, b"") for i in range(max(self.raw, default=0) + 1)]
        self.byte_size = np.array([len(x) for x in spelled], dtype=np.int64)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.byte_flat = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.cuts = not any(" " in p.lstrip(" ") for p in pieces)
        letters = "".join(sorted(set().union(*pieces) - {" "}))
        inside = f"[{re.escape(letters)}]" if letters else r"(?!)"
        # Runs of the pieces' own characters, each with the spaces before it; any other character by itself.
        self.words = re.compile(f" +{inside}*|{inside}+|[^ {re.escape(letters)}]" if self.cuts else r"(?s).+")
        self._build_trie()
        self.forget()

    def _build_trie(self) -> None:
        """Edges of the pieces' trie as one sorted array of node * alphabet + code; a code is 0 if the character is no piece."""
        singles = sorted(p for p in self.pieces if len(p) == 1)
        self.code = np.zeros(0x110000, dtype=np.int64)
        self.code[[ord(c) for c in singles]] = np.arange(1, len(singles) + 1)
        self.width = len(singles) + 1
        edges: dict[int, int] = {}
        ends, scores, depths = [-1], [0], [0]
        for piece, (i, score) in self.pieces.items():
            codes = self.code[[ord(c) for c in piece]].tolist()
            if not all(codes):
                continue  # holds a character that is no piece; such texts are solved one by one
            node = 0
            for c in codes:
                key = node * self.width + c
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                    scores.append(0)
                    depths.append(depths[node] + 1)
                node = edges[key]
            ends[node], scores[node] = i, score
        bits = max(4, (4 * len(edges) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.nodes = np.zeros(1 << bits, dtype=np.int32)
        spots = self._spot(np.array(list(edges), dtype=np.int64)).tolist()
        for spot, (key, node) in zip(spots, edges.items()):
            while self.keys[spot] >= 0:
                spot = spot + 1 & (1 << bits) - 1
            self.keys[spot], self.nodes[spot] = key, node
        self.ends = np.array(ends, dtype=np.int32)
        self.depths = np.array(depths, dtype=np.int32)
        self.scores = np.array(scores, dtype=np.int64 if all(isinstance(x, int) for x in scores) else np.float64)

    def _spot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _follow(self, key: np.ndarray) -> np.ndarray:
        """The node that each edge leads to, or -1."""
        spot = self._spot(key)
        held = self.keys[spot]
        out = np.where(held == key, self.nodes[spot], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            spot[open_] = spot[open_] + 1 & len(self.keys) - 1
            held = self.keys[spot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.nodes[spot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spelling, byte_ids = {}, {}, [0] * 256
        lowest = 0.0
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text, score = model.id_to_piece(i).replace(MARK, " "), model.get_score(i)
                score = int(score) if float(score).is_integer() else score
                lowest = min(lowest, score)
                pieces[text] = (i, score)
                spelling[i] = text
        return cls(pieces, byte_ids, spelling, lowest - UNK_PENALTY)

    # --- the lattice ---------------------------------------------------------------------------

    def forward(self, text: str, own: int, entry: list) -> tuple[list, list[int]]:
        """Best score and the last piece's start for every position; pieces start before ``own``."""
        n = len(text)
        best = [NEG] * (n + 1)
        back = [-1] * (n + 1)
        best[: len(entry)] = entry[: n + 1]
        pieces, longest, unk = self.pieces, self.longest, self.unk_score
        for i in range(own):
            here = best[i]
            if here == NEG:
                continue
            stop = min(i + longest, n)
            single = pieces.get(text[i : i + 1])
            value = here + (unk if single is None else single[1])
            if value > best[i + 1]:
                best[i + 1], back[i + 1] = value, i
            for j in range(i + 2, stop + 1):
                got = pieces.get(text[i:j])
                if got is not None and here + got[1] > best[j]:
                    best[j], back[j] = here + got[1], i
        return best, back

    def ids_between(self, text: str, start: int, stop: int) -> list[int]:
        """The ids of one edge of the lattice: a piece, or the bytes of a character."""
        got = self.pieces.get(text[start:stop])
        return [got[0]] if got is not None else [self.byte_ids[b] for b in text[start:stop].encode("utf-8", "surrogatepass")]

    def solve(self, text: str) -> tuple[int, list[int]]:
        """Best score and ids of a text that stands between two cuts."""
        best, back = self.forward(text, len(text), [0])
        at, parts = len(text), []
        while at > 0:
            parts.append(self.ids_between(text, back[at], at))
            at = back[at]
        return best[-1], [i for p in reversed(parts) for i in p]

    # --- runs, remembered ----------------------------------------------------------------------

    def forget(self) -> None:
        """Known runs: ``index`` numbers them; ``flat[start : start + count]`` are the ids of one, ``score`` its sum."""
        self.index: dict[str, int] = {}
        self.start = np.empty(0, dtype=np.int64)
        self.count = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=self.scores.dtype)
        self.flat = np.empty(0, dtype=np.int32)

    def number(self, words: list[str]) -> np.ndarray:
        """The numbers of runs, all of them solved."""
        index = self.index
        known = len(index)
        give = index.setdefault
        out = np.array([give(w, len(index)) for w in words], dtype=np.int64)
        if len(index) > known:
            fresh = list(islice(index, known, None))
            counts = np.zeros(len(fresh), dtype=np.int64)
            scores = np.zeros(len(fresh), dtype=self.scores.dtype)
            parts = self._learn(fresh, counts, scores)
            begin = np.cumsum(counts) - counts + len(self.flat)
            self.start = np.r_[self.start, begin]
            self.count, self.score = np.r_[self.count, counts], np.r_[self.score, scores]
            self.flat = np.concatenate([self.flat, parts])
        return out

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of runs, one after another."""
        counts = self.count[numbers]
        shift = self.start[numbers] - (np.cumsum(counts) - counts)
        return self.flat[np.repeat(shift, counts) + np.arange(int(counts.sum()))]

    def _learn(self, words: list[str], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Solves distinct runs; fills their counts and scores and returns their ids, one after another."""
        usual = [i for i, w in enumerate(words) if len(w) <= REMEMBERED]
        where, owner, ids = self._side_by_side(words, np.array(usual, dtype=np.int64), scores)
        solved = np.zeros(len(words), dtype=bool)
        solved[where] = True
        owners, parts = [owner], [ids]
        for i in np.flatnonzero(~solved).tolist():
            scores[i], found = self.solve(words[i])
            owners.append(np.full(len(found), i, dtype=np.int64))
            parts.append(np.array(found, dtype=np.int32))
        owner, ids = np.concatenate(owners), np.concatenate(parts)
        counts += np.bincount(owner, minlength=len(words))
        return ids[np.argsort(owner, kind="stable")]

    def _side_by_side(self, words: list[str], usual: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Many runs at once: all trie walks step together, then all lattices do.

        Returns which runs it solved, and the owners and ids of all their pieces in order. Runs with a character that is no piece are left.
        """
        none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
        if not len(usual) or not len(self.nodes):
            return none
        fresh = [words[i] for i in usual.tolist()]
        lengths = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh))
        codes = self.code[np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts = np.cumsum(lengths) - lengths
        plain = np.minimum.reduceat(codes, starts) > 0
        if not plain.all():
            usual = usual[plain]
            codes, lengths = codes[np.repeat(plain, lengths)], lengths[plain]
            starts = np.cumsum(lengths) - lengths
        if not len(usual):
            return none
        n = len(usual)
        stops = np.repeat(starts + lengths, lengths)
        word = np.repeat(np.arange(n), lengths)
        offset = (np.arange(len(codes)) - starts[word]).astype(np.int16)
        # Place p of word w is node p + w of its lattice.
        base = starts + np.arange(n)
        best = np.full(len(codes) + n, NEG, dtype=self.scores.dtype)
        back = np.zeros(len(codes) + n, dtype=np.int64)  # the trie node of the last piece
        best[base] = 0
        # Trie walks from every character, in order of the character's offset in its word.
        at = np.argsort(offset, kind="stable")
        node = np.zeros(len(codes), dtype=np.int64)
        found = []
        for depth in range(1, self.longest + 1):
            live = at + depth <= stops[at]
            at, node = at[live], node[live]
            if not len(at):
                break
            to = self._follow(node.astype(np.int64) * self.width + codes[at + depth - 1])
            live = to >= 0
            at, node = at[live], to[live]
            whole = self.ends[node] >= 0
            edges = at[whole]
            found.append((depth, edges + word[edges], node[whole], np.searchsorted(offset[edges], np.arange(lengths.max() + 1))))
        # All lattices advance together, by offset: of equal sums the earliest start stays.
        for i in range(int(lengths.max())):
            for depth, tail, node, bounds in found:
                low, high = bounds[i], bounds[i + 1]
                if low < high:
                    total = best[tail[low:high]] + self.scores[node[low:high]]
                    head = tail[low:high] + depth
                    better = total > best[head]
                    best[head[better]] = total[better]
                    back[head[better]] = node[low:high][better]
        # All words walk back together.
        here, who = base + lengths, np.arange(n)
        path_word, path_id = [], []
        while len(who):
            path_word.append(who)
            path_id.append(self.ends[back[here]])
            here = here - self.depths[back[here]]
            live = here != base[who]
            here, who = here[live], who[live]
        scores[usual] = best[base + lengths]
        owner, ids = np.concatenate(path_word[::-1]), np.concatenate(path_id[::-1])
        order = np.argsort(owner, kind="stable")  # the last steps back come first
        return usual, usual[owner[order]], ids[order]

    def encode(self, text: str) -> tuple[int, list[int]]:
        score, ids, _ = self.encode_all([text])
        return score[0], ids.tolist()

    def encode_all(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Scores of texts, their ids one after another, and where each text's ids begin and the last ones end."""
        if len(self.index) > MEMORY:
            self.forget()
        split = [self.words.findall(" " + t) if t else [] for t in texts]
        numbers = self.number([w for words in split for w in words])
        ends = np.cumsum([len(words) for words in split])
        counts = np.r_[0, np.cumsum(self.count[numbers])]
        sums = np.r_[0, np.cumsum(self.score[numbers])]
        begins = np.r_[0, ends]
        return (sums[begins[1:]] - sums[begins[:-1]]).tolist(), self.gather(numbers), counts[begins]

    def spell_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids."""
        sizes = self.byte_size[ids]
        shift = self.byte_start[ids] - (np.cumsum(sizes) - sizes)
        blob = self.byte_flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()
        cuts = np.r_[0, np.cumsum(sizes)][bounds].tolist()
        return [blob[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids) -> str:
        """The text of ids from ``encode``."""
        return self.spell(ids)[1:]

    def spell(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids if i in raw]).decode("utf-8", "surrogatepass")

    # --- one chunk -----------------------------------------------------------------------------

    def parts(self, text: str, own: int) -> list[str]:
        """The runs that begin in the chunk, the first and the last of which may lie across its ends; one run if no cut is known."""
        if not self.cuts:
            return [text]
        found = self.words.findall(text)
        size = len(text)
        while len(found) > 1 and size - len(found[-1]) >= own:  # begins past the chunk's end
            size -= len(found.pop())
        if size < len(text):
            found[-1] += text[size:]
        if len(self.index) > MEMORY:
            self.forget()
        return found

    def matrix(self, text: str, own: int) -> np.ndarray:
        """Best scores from each state at the chunk's start to each at its end; NEG where there is no path."""
        k = self.longest
        runs = self.parts(text, own)
        if len(runs) == 1:
            return self._direct(text, own)
        out = np.full((k, k), NEG, dtype=object)
        first, last = len(runs[0]), len(text) - len(runs[-1])
        numbers = self.number(runs[1:-1])
        middle = self.score[numbers].sum().item()
        tail, _ = self.forward(text[last:], own - last, [0])
        ends = tail[own - last : own - last + k]
        for s in range(min(k, first + 1)):
            head, _ = self.forward(text[s:first], first - s, [0])
            if head[-1] != NEG:
                for t, e in enumerate(ends):
                    if e != NEG:
                        out[s, t] = head[-1] + middle + e
        return out

    def _direct(self, text: str, own: int) -> np.ndarray:
        """The matrix of a chunk without a cut. From the first state on, another start is followed only until it
        differs from the first by a constant over a whole piece's length: from there on the paths are one."""
        k = self.longest
        out = np.full((k, k), NEG, dtype=object)
        base, _ = self.forward(text, own, [0])
        for s in range(min(k, own + 1)):
            if s == 0:
                ends = base[own : own + k]
            else:
                ends = self._from(text, own, s, base)
            for t, e in enumerate(ends[:k]):
                out[s, t] = e
        return out

    def _from(self, text: str, own: int, s: int, base: list) -> list:
        k, size = self.longest, 8 * self.longest
        while True:
            stop = min(s + size, own)
            entry = [NEG] * s + [0]
            best, _ = self.forward(text[: stop + k], stop, entry)
            if stop == own:
                return best[own : own + k]
            # Positions stop-k .. stop-1 are final; all later ones follow from them.
            gaps = {(b == NEG, a == NEG, a - b if a != NEG and b != NEG else 0) for a, b in zip(best[stop - k : stop], base[stop - k : stop])}
            if len(gaps) == 1 and next(iter(gaps))[:2] == (False, False):
                gap = next(iter(gaps))[2]
                return [e if e == NEG else e + gap for e in base[own : own + k]]
            size *= 2

    def trace(self, text: str, own: int, entry: list) -> tuple[list[int], list[int], list[list[int]], list[bool]]:
        """What the chunk holds for each end state, given the best scores of the states at its start.

        The start state that each end state goes back to (-1: no path); the ids up to the last place on all paths; the ids from there
        to each end; and whether the ids spell the characters between start and end.
        """
        k = self.longest
        runs = self.parts(text, own)
        if len(runs) == 1:
            best, back = self.forward(text, own, entry)
            return self._fork(text, back, [own + t if own + t < len(best) and best[own + t] != NEG else -1 for t in range(k)])
        first, last = len(runs[0]), len(text) - len(runs[-1])
        _, back = self.forward(text[:first], first, entry)
        start = first
        while back[start] >= 0:
            start = back[start]
        common = self._ids(text, back, first)
        common += self.gather(self.number(runs[1:-1])).tolist()
        best, back = self.forward(text[last:], own - last, [0])
        places = [own - last + t if own - last + t < len(best) and best[own - last + t] != NEG else -1 for t in range(k)]
        fine = self.spell(common) == text[start:last]
        tails, states, good = [], [], []
        for p in places:
            ids = self._ids(text[last:], back, p) if p >= 0 else []
            tails.append(ids)
            states.append(start if p >= 0 else -1)
            good.append(p < 0 or fine and self.spell(ids) == text[last : last + p])
        return states, common, tails, good

    def _fork(self, text: str, back: list[int], places: list[int]) -> tuple[list[int], list[int], list[list[int]], list[bool]]:
        paths = []
        for p in places:
            path = [p] if p >= 0 else []
            while path and back[path[-1]] >= 0:
                path.append(back[path[-1]])
            paths.append(path)
        shared = set.intersection(*(set(path) for path in paths if path))
        meet = max(shared, default=-1)
        common = self._ids(text, back, meet) if meet >= 0 else []
        origin = meet
        while origin >= 0 and back[origin] >= 0:
            origin = back[origin]
        fine = meet < 0 or self.spell(common) == text[origin:meet]
        states, tails, good = [], [], []
        for path in paths:
            low = meet if meet >= 0 else path[-1] if path else 0
            ids = self._ids(text, back, path[0], low) if path else []
            states.append(path[-1] if path else -1)
            tails.append(ids)
            good.append(not path or fine and self.spell(ids) == text[low : path[0]])
        return states, common, tails, good

    def _ids(self, text: str, back: list[int], at: int, low: int = -1) -> list[int]:
        parts = []
        while at != low and back[at] >= 0:
            parts.append(self.ids_between(text, back[at], at))
            at = back[at]
        return [i for p in reversed(parts) for i in p]


# --- max-plus arithmetic -------------------------------------------------------------------------


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; object arrays of exact numbers, NEG is minus infinity."""
    out = np.full((a.shape[0], b.shape[1]), NEG, dtype=object)
    for i in range(a.shape[0]):
        for k in range(a.shape[1]):
            if a[i, k] != NEG:
                for j in range(b.shape[1]):
                    if b[k, j] != NEG and a[i, k] + b[k, j] > out[i, j]:
                        out[i, j] = a[i, k] + b[k, j]
    return out


def pack_scores(m) -> list[str | None]:
    return [None if v == NEG else repr(v) for v in np.asarray(m, dtype=object).ravel().tolist()]


def unpack_scores(values) -> list:
    return [NEG if v is None else float(v) if "." in v or "e" in v or "n" in v else int(v) for v in values]


# --- the distributed scan --------------------------------------------------------------------------

_LOADED: dict[str, Vocabulary] = {}  # one for each worker process


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk: int, longest: int) -> DataFrame:
    """The giant texts' chunks, each with the characters after it that a straddling piece may need."""

    def rows(batch):
        for uid, key, text in batch:
            text = " " + text
            count = -(-len(text) // chunk)
            for i in range(count):
                yield uid, key, i, count, text[i * chunk : (i + 1) * chunk + longest - 1], min(chunk, len(text) - i * chunk)

    giant = docs.where(F.length(text_col) >= chunk).select(F.monotonically_increasing_id().alias("uid"), id_col, text_col)
    return map_rows(giant, rows, f"uid bigint, {id_col} bigint, idx int, n int, part string, own int", ["uid", F.col(id_col).cast("bigint"), text_col])


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``(id, n_chunks, score, ids, round_trip)`` for each row; round_trip says that the ids decode to the text."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(model)
    k = vocabulary.longest
    if chunk < k:
        raise ValueError("a chunk must hold the longest piece")
    shared = spark.sparkContext.broadcast((vocabulary.pieces, vocabulary.byte_ids, vocabulary.spelling, vocabulary.unk_score))

    token = uuid.uuid4().hex

    def loaded() -> Vocabulary:
        if token not in _LOADED:
            _LOADED.clear()
            _LOADED[token] = Vocabulary(*shared.value)
        return _LOADED[token]

    out = f"{id_col} bigint, n_chunks int, score string, ids array<int>, round_trip boolean"
    docs = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias(text_col))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = loaded()
        for batch in batches:
            keys, at = batch.column(0), 0
            for part in segments(python_rows(batch.select([1])), SEGMENT):
                part = [t for (t,) in part]
                scores, ids, bounds = v.encode_all([t or "" for t in part])
                missing = np.array([t is None for t in part])
                good = [None if t is None else b == (" " + t if t else t).encode("utf-8", "surrogatepass") for t, b in zip(part, v.spell_all(ids, bounds))]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(at, len(part)),
                        pa.array([0 if t is None else 1 for t in part], pa.int32()),
                        pa.array([None if t is None else repr(x) for t, x in zip(part, scores)], pa.string()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(missing)),
                        pa.array(good, pa.bool_()),
                    ],
                    names=[id_col, "n_chunks", "score", "ids", "round_trip"],
                )
                at += len(part)
        v.forget()  # the worker lives on

    small = docs.where(F.col(text_col).isNull() | (F.length(text_col) < chunk))
    short = small.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(whole, out)

    folder = new_folder(spark, "pieces")
    chunks = stage(_chunks(docs, id_col, text_col, chunk, k).repartition("uid", "idx"), "chunks", folder)
    if chunks.isEmpty():
        return short.select(id_col, "n_chunks", F.col("score").cast("double").alias("score"), "ids", "round_trip")

    def matrices(batch):
        v = loaded()
        for uid, idx, n, part, own in batch:
            yield uid, idx, n, pack_scores(v.matrix(part, own))

    made = stage(
        map_rows(chunks, matrices, "uid bigint, idx int, n int, m array<string>", ["uid", "idx", "n", "part", "own"]), "matrices", folder
    ).withColumn("blk", F.floor(F.col("idx") / block).cast("int"))
    states = stage(_scan(made, k), "states", folder)

    def traces(batch):
        v = loaded()
        for uid, key, idx, n, part, own, entry in batch:
            yield uid, key, idx, n, *v.trace(part, own, unpack_scores(entry))

    going = map_rows(
        chunks.join(states.select("uid", "idx", "entry"), ["uid", "idx"]), traces,
        f"uid bigint, {id_col} bigint, idx int, n int, back array<int>, common array<int>, tails array<array<int>>, good array<boolean>",
        ["uid", id_col, "idx", "n", "part", "own", "entry"],
    )
    going = stage(going, "traces", folder).withColumn("blk", F.floor(F.col("idx") / block).cast("int"))
    ends = _compose(going.select("uid", "idx", "blk", "back"), k)
    place = F.col("end") + 1
    chosen = going.join(ends, ["uid", "idx"]).select(
        "uid", id_col, "idx", "n", F.concat("common", F.element_at("tails", place)).alias("ids"), F.element_at("good", place).alias("good")
    )
    giant = (
        chosen.groupBy("uid", id_col)
        .agg(
            F.max("n").alias("n_chunks"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ids"))), lambda x: x["ids"])).alias("ids"),
            F.min("good").alias("round_trip"),
        )
        .join(states.where("idx = n - 1").select("uid", F.col("total").alias("score")), "uid")
    )
    columns = [id_col, "n_chunks", F.col("score").cast("double").alias("score"), "ids", "round_trip"]
    return short.select(*columns).unionByName(giant.select(*columns))


def _scan(made: DataFrame, k: int) -> DataFrame:
    """Scores of the states at each chunk's start, by blocks: products of blocks, starts of blocks, starts of chunks.

    A text has at most 2^31 characters, so a block holds at most ``block`` matrices and a text at most
    2^31 / (chunk * block) blocks.
    """
    import pandas as pd

    def square(values) -> np.ndarray:
        return np.array(unpack_scores(values), dtype=object).reshape(k, k)

    def product(pdf):
        pdf = pdf.sort_values("idx")
        m = square(pdf["m"].iloc[0])
        for values in pdf["m"].iloc[1:]:
            m = times(m, square(values))
        return pd.DataFrame({"uid": [pdf["uid"].iloc[0]], "blk": [pdf["blk"].iloc[0]], "m": [pack_scores(m)]})

    def along(pdf, at):
        pdf = pdf.sort_values(at)
        row = np.array([[0] + [NEG] * (k - 1)], dtype=object)
        rows = []
        for values in pdf["m"]:
            rows.append(pack_scores(row))
            row = times(row, square(values))
        return pdf, rows

    def block_starts(pdf):
        pdf, rows = along(pdf, "blk")
        return pd.DataFrame({"uid": pdf["uid"], "blk": pdf["blk"], "start": rows})

    def chunk_starts(pdf):
        pdf = pdf.sort_values("idx")
        row = np.array([unpack_scores(pdf["start"].iloc[0])], dtype=object)
        rows, totals = [], []
        for values in pdf["m"]:
            rows.append(pack_scores(row))
            row = times(row, square(values))
            totals.append(pack_scores(row)[0])
        return pd.DataFrame({"uid": pdf["uid"], "idx": pdf["idx"], "n": pdf["n"], "entry": rows, "total": totals})

    products = made.groupBy("uid", "blk").applyInPandas(product, "uid bigint, blk int, m array<string>")
    starts = products.groupBy("uid").applyInPandas(block_starts, "uid bigint, blk int, start array<string>")
    return made.join(starts, ["uid", "blk"]).groupBy("uid", "blk").applyInPandas(
        chunk_starts, "uid bigint, idx int, n int, entry array<string>, total string"
    )


def _compose(going: DataFrame, k: int) -> DataFrame:
    """The end state of each chunk: maps from end to start state, composed from the right by blocks."""
    import pandas as pd

    def follow(maps, state: int) -> int:
        for back in maps:
            state = -1 if state < 0 else back[state]
        return state

    def block_map(pdf):
        maps = list(pdf.sort_values("idx", ascending=False)["back"])
        return pd.DataFrame({"uid": [pdf["uid"].iloc[0]], "blk": [pdf["blk"].iloc[0]], "back": [[int(follow(maps, s)) for s in range(k)]]})

    def block_ends(pdf):
        pdf = pdf.sort_values("blk", ascending=False)
        state, ends = 0, []
        for back in pdf["back"]:
            ends.append(int(state))
            state = back[state]
        return pd.DataFrame({"uid": pdf["uid"], "blk": pdf["blk"], "last": ends})

    def chunk_ends(pdf):
        pdf = pdf.sort_values("idx", ascending=False)
        state, ends = pdf["last"].iloc[0], []
        for back in pdf["back"]:
            ends.append(int(state))
            state = back[state]
        return pd.DataFrame({"uid": pdf["uid"], "idx": pdf["idx"], "end": ends})

    blocks = going.groupBy("uid", "blk").applyInPandas(block_map, "uid bigint, blk int, back array<int>")
    lasts = blocks.groupBy("uid").applyInPandas(block_ends, "uid bigint, blk int, last int")
    return going.join(lasts, ["uid", "blk"]).groupBy("uid", "blk").applyInPandas(chunk_ends, "uid bigint, idx int, end int")


def decode(frame: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of rows with ids as ``encode`` makes them; null ids give a null text."""
    v = Vocabulary.load(model)
    shared = frame.sparkSession.sparkContext.broadcast((v.pieces, v.byte_ids, v.spelling, v.unk_score))

    def setup():
        words = Vocabulary(*shared.value)
        return lambda batch: ((key, None if ids is None else words.decode(ids)) for key, ids in batch)

    return map_rows(frame, None, f"{id_col} bigint, text string", [F.col(id_col).cast("bigint"), ids_col], setup)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "n_chunks", "score", "ids", "round_trip")
