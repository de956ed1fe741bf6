"""Language identification by cross-parsing entropy.

For each language a suffix automaton over a bounded sample of labelled text yields longest
matches. A text is parsed greedily into the longest phrases that occur in the sample; few phrases
mean that the sample predicts the text. The cost of a language is phrases times log2 of the sample's
length, an estimate of the text's code length given the sample, and the cheapest language wins.

Letters are lower-cased and spelled in UTF-8, so any script fits; each run of anything else is one space. The
automata become flat transition tables, and all windows of a batch walk them in step, byte by byte. A text is cut into windows of
``window`` bytes, every one of which is parsed, so one long text costs no more than many short ones.

Every language that has a label is learned. The model is bounded by parameters: at most ``rows`` labelled rows a language, ``chars``
characters a language, and ``total`` characters of all languages together, which they share evenly where ``chars`` each would be more. Rows are
drawn by a hash of their id over the whole table, and of a long text a stretch at a place drawn by the hash as well.

Defined cases: null text or text without a letter is ``und`` with score 0; unknown letters are
phrases of their own; equal costs go to the language that sorts first; without any learned language
every text is ``und``; a null id is not held out and not learned from; repeated rows are judged alike; texts of any length are parsed
whole; an empty table gives an empty result and an empty model; extra columns are kept, and the columns that ``predict`` adds replace those of
their names. ``known_language`` adds none, so a table's own ``lang_pred`` and ``score`` stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import table

UND = "und"
ROWS = 48
CHARS = 24_000
TOTAL = 16 * CHARS
#: The chosen rows' ids are broadcast up to this many of them.
BROADCAST_ROWS = 500_000
WINDOW = 512
LANES = 4096

SPACE, OTHER, PAD = 0, 1, 2  # codes before those of the bytes in use


class Automaton:
    """Suffix automaton of a string of codes: ``step[state]`` maps a code to the next state."""

    def __init__(self, codes):
        self.step: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        step = self.step
        for c in codes:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new

    def table(self, width: int) -> np.ndarray:
        """``table[state * width + code]`` = offset of the next state * 4 + phrases that end there.

        A character that cannot extend the match ends a phrase and opens the next one; one that the
        sample lacks is a phrase of its own. PAD ends the open phrase.
        """
        root = np.full(width, 1, dtype=np.int32)  # a phrase of one unknown character
        for c, state in self.step[0].items():
            root[c] = state * width * 4
        root[PAD] = 0
        out = np.empty((len(self.step), width), dtype=np.int32)
        out[0] = root
        out[1:] = root + 1
        for state, moves in enumerate(self.step):
            if state:
                row = out[state]
                for c, to in moves.items():
                    row[c] = to * width * 4
        return out.ravel()


_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point: its lower-case code point if it is a letter, else 0."""
    global _LETTERS
    if _LETTERS is None:
        out = np.zeros(0x110000, dtype=np.uint32)
        for i in range(len(out)):
            ch = chr(i)
            if ch.isalpha():
                low = ch.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _LETTERS = out
    return _LETTERS


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters; each run of anything else is one 0."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    low = _letters()[points]
    if not len(low):
        return low
    return low[(low != 0) | np.r_[True, low[:-1] != 0]]


def spelled(letters: np.ndarray) -> np.ndarray:
    """The letters' UTF-8 bytes: at most 256 symbols for any script."""
    return np.frombuffer(letters.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)


class Model:
    """Transition tables of all languages over the bytes of their letters."""

    def __init__(self, samples: dict[str, str]):
        parts = {lang: spelled(letters_of(text)) for lang, text in samples.items()}
        self.langs = sorted(lang for lang, part in parts.items() if part.any())
        seen = np.unique(np.concatenate([np.zeros(1, dtype=np.uint8), *parts.values()]))[1:]
        self.code = np.full(256, OTHER, dtype=np.uint8)
        self.code[0] = SPACE
        self.code[seen] = np.arange(3, 3 + len(seen), dtype=np.uint8)
        self.width = 3 + len(seen)
        self.tables, self.weights = [], []
        for lang in self.langs:
            codes = self.code[parts[lang]].tolist()
            self.tables.append(Automaton(codes).table(self.width))
            self.weights.append(math.log2(len(codes) + 1))

    def phrases(self, windows: np.ndarray) -> np.ndarray:
        """Phrases of each column of ``windows`` (characters by lanes), per language."""
        out = np.zeros((len(self.tables), windows.shape[1]), dtype=np.int64)
        for k, moves in enumerate(self.tables):
            at = np.zeros(windows.shape[1], dtype=np.int32)
            count = np.zeros(windows.shape[1], dtype=np.int32)
            for row in windows:
                got = moves[at + row]
                count += got & 3
                at = got >> 2
            out[k] = count + (at != 0)
        return out

    def costs(self, texts: list[str | None], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Phrases times weight for each text and language, and whether the text has a letter."""
        total = np.zeros((len(texts), len(self.langs)))
        lettered = np.zeros(len(texts), dtype=bool)
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        lanes = 0

        def walk():
            nonlocal held, owners, lanes
            if held and self.langs:
                block, owner = np.concatenate(held), np.concatenate(owners)
                counts = self.phrases(np.ascontiguousarray(block.T).astype(np.int32))
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(owner, weights=counts[k], minlength=len(texts))
            held, owners, lanes = [], [], 0

        for i, text in enumerate(texts):
            low = letters_of(text or "")
            lettered[i] = bool((low != 0).any())
            if not lettered[i]:
                continue
            codes = self.code[spelled(low)]
            for start in range(0, len(codes), window * LANES):
                part = codes[start : start + window * LANES]
                rows = -(-len(part) // window)
                block = np.full(rows * window, PAD, dtype=np.uint8)
                block[: len(part)] = part
                held.append(block.reshape(rows, window))
                owners.append(np.full(rows, i))
                lanes += rows
                if lanes >= LANES:
                    walk()
        walk()
        return total * np.array(self.weights), lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        cost, lettered = self.costs(texts)
        langs, scores = [], []
        for row, ok in zip(cost, lettered):
            if not ok or not self.langs:
                langs.append(UND)
                scores.append(0.0)
                continue
            best = int(np.argmin(row))
            others = np.delete(row, best)
            langs.append(self.langs[best])
            scores.append(float(1 - row[best] / others.min()) if len(others) and others.min() > 0 else 1.0)
        return langs, scores


_MODELS: dict[tuple, Model] = {}


def _model(samples: dict[str, str]) -> Model:
    """One model for each worker process and sample."""
    key = tuple(sorted(samples.items()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(samples)
    return _MODELS[key]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, chars: int = CHARS, total: int = TOTAL
) -> dict[str, str]:
    """The sample: for each language at most ``chars`` characters, from at most ``rows`` labelled rows of it; of all at most ``total``."""
    lang, key, text = (F.col(f"`{c}`") for c in (lang_col, id_col, text_col))
    known = docs.where(~held_out(id_col) & key.isNotNull() & lang.isNotNull() & text.isNotNull())
    known = known.select(lang.alias("_lang"), key.cast("string").alias("_id"), text.cast("string").alias("_text"))
    counts = known.groupBy("_lang").count()
    languages = counts.count()
    chars = max(1, min(chars, total // max(1, languages)))
    each = max(1, chars // 8)
    # Rows are chosen by id and language alone; texts are read for the chosen ones only.
    small = F.broadcast if languages * rows <= BROADCAST_ROWS else lambda df: df
    share = counts.select("_lang", (F.lit(8.0 * rows) / F.col("count")).alias("_share"))
    draw, at = F.xxhash64("_id", F.lit("sample")), F.xxhash64("_id", F.lit("place"))
    order = Window.partitionBy("_lang").orderBy("_draw", "_id")
    chosen = (
        known.select("_lang", "_id", draw.alias("_draw"))
        .join(small(share), "_lang")
        .where(F.pmod("_draw", F.lit(1 << 20)) < F.col("_share") * (1 << 20))
        .select("_lang", "_id", "_draw")
        .distinct()
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= rows)
    )
    stretch = F.substring("_text", 1 + F.pmod(at, F.greatest(F.lit(1), F.length("_text") - (each - 1))).cast("int"), F.lit(each))
    order = Window.partitionBy("_lang").orderBy("_draw", "_text")
    drawn = (
        known.join(small(chosen), ["_lang", "_id"])
        .select("_lang", "_draw", stretch.alias("_text"))
        .withColumn("_n", F.row_number().over(order))  # rows of one id are several
        .where(F.col("_n") <= rows)
        .select("_lang", "_n", "_text")
        .collect()
    )
    out: dict[str, str] = {}
    for r in sorted(drawn, key=lambda r: (r["_lang"], r["_n"])):
        out[r["_lang"]] = (out.get(r["_lang"], "") + " " + r["_text"])[:chars]
    return out


def predict(docs: DataFrame, samples: dict[str, str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns more, the predicted language and its score; columns of these ``names`` are replaced."""
    kept = [c for c in docs.columns if c not in names]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    where = kept.index(text_col)
    schema = StructType([*frame.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                langs, scores = model.predict(part.column(where).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, *names]
                )

    return frame.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents that have a language, in their own columns."""
    names = ("_loomlog_lang", "_loomlog_score")
    return predict(docs, fit(docs), names=names).where(F.col(names[0]) != UND).drop(*names)
