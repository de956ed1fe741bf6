r"""Chat formatting with prefix-target expansion.

Every turn becomes one formatted piece, ``### role: text</turn>`` and a newline; a conversation's pieces in
order are its formatted text. ``examples`` explodes every assistant turn into an example of its own: its context is all of the
formatted text before its reply, written out in full, and only the reply is trainable. Contexts of many megabytes come in several rows;
``materialise`` gives each in one. ``read_back`` takes the examples, reads every context, sees that it is the prefix that it should
be, and reads turns and replies from them.

Control strings inside texts are escaped so that a text can neither close its turn nor open another:
a backslash is doubled, ``##`` becomes ``\#\#`` (so ``###`` never stands) and ``</turn>`` becomes ``\</turn>``; in roles a colon is escaped
too. Taking away each escaping backslash gives the text back.

Offsets and checksums of contexts come from sums over blocks of turns and then within a block, and a conversation's examples are written and read in
runs of at most ``TOGETHER``, each with the turns before it, so a conversation with very many turns is spread over many tasks. What contexts hold together grows
with the square of a conversation's length; they stream from where they are written to where they are read. Only the SHA-256 of a conversation, which must
see it in order, passes through one task, a turn at a time.

Defined cases: turns are ordered by turn, then role, then text; null turns come first; turns that tie in all three are alike. Null roles and texts
are empty; rows with a null conversation are one conversation; repeated rows are
turns of their own; texts of any length are whole, one turn and one part of a context in memory at a time (a writing task keeps what it
has of a conversation beyond ``SPOOL`` in a temporary file); an empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import io
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pack, python_rows, table

OPEN, CLOSE, END = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
TURNS = 1024
#: Examples of a conversation that one task writes; bytes of a part of a context, which ends with a turn; bytes of a conversation that a writing task keeps in memory.
TOGETHER = 1024
PART = 1 << 20
SPOOL = 32 << 20
HASH = (1 << 32) - 1


def _escaped(col):
    col = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    col = F.replace(col, F.lit("##"), F.lit("\\#\\#"))
    return F.replace(col, F.lit("</turn>"), F.lit("\\</turn>"))


def expand(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row per turn: ``conv_id, turn, role, start, context_sum, formatted, target_start, target_stop, nth, total``.

    ``start`` is the piece's place in the conversation's formatted text, ``context_sum`` the sum of the hashes of all pieces before it. Where there is a
    target, the reply (escaped) begins at ``target_start`` and ends before ``target_stop``. ``nth`` counts the targets before it, ``total`` those of the conversation.
    """
    head = F.concat(F.lit(OPEN), F.replace(_escaped(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(CLOSE))
    formatted = F.concat(head, _escaped(F.col("text")), F.lit(END))
    turn = F.col("turn").cast("bigint")
    pieces = conversations.select(
        "conv_id",
        turn.alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.floor(turn / turns).cast("bigint").alias("part"),  # null turns are a block of their own, before all others
    )
    # 32 bits of a hash, so that the sums of two thousand million turns fit.
    trained = F.col("role") == TRAINED
    pieces = pieces.withColumns(
        {"size": F.length(formatted).cast("bigint"), "hash": F.xxhash64(formatted).bitwiseAND(F.lit(HASH)), "target": trained.cast("bigint")}
    )
    sums = pieces.groupBy("conv_id", "part").agg(F.sum("size").alias("size"), F.sum("hash").alias("hash"), F.sum("target").alias("target"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = sums.select(
        F.col("conv_id").alias("c"),
        F.col("part").alias("p"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("hash").over(before), F.lit(0)).alias("base_hash"),
        F.coalesce(F.sum("target").over(before), F.lit(0)).alias("base_target"),
        F.sum("target").over(whole).alias("total"),
    )
    inside = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        pieces.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p")))
        .withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("context_sum", F.col("base_hash") + F.coalesce(F.sum("hash").over(inside), F.lit(0)))
        .withColumn("nth", F.col("base_target") + F.coalesce(F.sum("target").over(inside), F.lit(0)))
        .withColumn("head", head)
        .withColumn("formatted", formatted)
    )
    return placed.select(
        "conv_id",
        "turn",
        "role",
        "start",
        "context_sum",
        "formatted",
        F.when(trained, F.col("start") + F.length("head")).alias("target_start"),
        F.when(trained, F.col("start") + F.length("formatted") - len(END)).alias("target_stop"),
        "nth",
        "total",
    )


class _Text:
    """A conversation's formatted text as it grows: ``last``, and before it closed parts, which end with a turn and are kept in a file beyond ``SPOOL``."""

    def __init__(self, size: int | None):
        self.size, self.last, self.lengths, self.file = size, bytearray(), [], None

    def add(self, piece: bytes) -> None:
        self.last += piece
        if self.size is not None and len(self.last) >= self.size:
            self.file = self.file or tempfile.SpooledTemporaryFile(max_size=SPOOL)
            self.file.seek(0, io.SEEK_END)
            self.file.write(self.last)
            self.lengths.append(len(self.last))
            self.last = bytearray()

    def closed(self) -> Iterator[bytes]:
        if self.file:
            self.file.seek(0)
        for length in self.lengths:
            yield self.file.read(length)


def examples(expanded: DataFrame, others: bool = False, size: int | None = PART, together: int = TOGETHER) -> DataFrame:
    """``(conv_id, turn, start, part, context_stop, context_sum, context, opening, reply)`` of every assistant turn.

    The context is the formatted text up to ``context_stop``: the pieces before ``start``, whose hashes sum up to ``context_sum``, then
    ``opening``. It is whole; one of more than ``size`` bytes comes in rows of its own by ``part``, one after the other, of which the last holds all other columns (with no
    ``size``, each comes in one row). ``reply`` is what is trained, as formatted. ``others`` adds the turns that are no examples, their piece as the opening and all else
    null. Of a conversation's examples each task writes ``together`` at most, in order.
    """
    text, number = pa.string(), pa.int64()
    columns = ["conv_id", "turn", "start", "part", "context_stop", "context_sum", "context", "opening", "reply"]
    arrow = pa.schema([(c, text if c in ("context", "opening", "reply") else number) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last, held = None, _Text(size)
            for batch in batches:
                for conv, share, own, turn, start, total, formatted, low, high in python_rows(batch):
                    if (conv, share) != last:
                        last, held = (conv, share), _Text(size)
                    if own and low is not None:
                        opening, part = formatted[: low - start], 0
                        for closed in held.closed():
                            yield conv, turn, start, part, None, None, closed, None, None
                            part += 1
                        yield conv, turn, start, part, low, total, b"".join((held.last, opening.encode())), opening, formatted[low - start : high - start]
                    elif own and others:
                        yield conv, turn, start, 0, None, None, None, formatted, None
                    held.add(formatted.encode())

        yield from pack(rows(), arrow.names, arrow)

    own = F.floor(F.col("nth") / together)
    until = F.greatest(own, F.floor((F.col("total") - 1) / together))
    dealt = expanded.withColumn("share", F.explode(F.sequence(own, until))).withColumn("own", F.col("share") == own)
    # A number of tasks, so that adaptive execution does not join shares: they are small when read and large when written.
    tasks = int(expanded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _in_order(dealt, ["own", "turn", "start", "context_sum", "formatted", "target_start", "target_stop"], ("share",), (tasks,))
    return ordered.mapInArrow(run, ", ".join(f"{f.name} {'string' if f.type == text else 'bigint'}" for f in arrow))


def _in_order(pieces: DataFrame, columns: list[str], within: tuple[str, ...] = (), tasks: tuple[int, ...] = ()) -> DataFrame:
    """Pieces of each conversation, or of each share ``within`` it, in one task and in order."""
    keys = ["conv_id", *within]
    return pieces.select(F.col("conv_id").cast("bigint").alias("conv_id"), *within, *columns).repartition(*tasks, *keys).sortWithinPartitions(*keys, "start")


def materialise(expanded: DataFrame) -> DataFrame:
    """``(conv_id, turn, context, reply)`` of every example, both as formatted, each in one row. A task holds one context; what it writes grows with the square of
    a conversation's length."""
    return examples(expanded, size=None).select("conv_id", "turn", "context", "reply")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


_PIECE = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.S)


def read_piece(formatted: str) -> tuple[str, str, int]:
    """Role, text and the offset of the escaped text in a formatted turn."""
    m = _PIECE.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2]), m.start(2)


def piece_hash(formatted: str) -> int:
    """A piece's part of the sums, as ``expand`` makes it."""
    return xxhash.xxh64_intdigest(formatted.encode("utf-8", "surrogatepass"), 42) & HASH


def _contexts_read(made: DataFrame) -> DataFrame:
    """The rows of ``made`` with a digest of each context, read from its parts as they follow each other, in its place."""
    text, number = pa.string(), pa.int64()
    columns = ["start", "context_stop", "context_sum", "context_read", "opening", "reply"]
    arrow = pa.schema([(c, text if c in ("context_read", "opening", "reply") else number) for c in ["conv_id", *columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            following, digest = None, None
            for batch in batches:
                batch = batch.set_column(0, "context", batch.column(0).cast(pa.binary()))
                for context, part, conv, start, stop, total, opening, reply in python_rows(batch):
                    if context is None:
                        yield conv, start, stop, total, None, opening, reply
                        continue
                    if part == 0:
                        digest = xxhash.xxh3_128()
                    elif (conv, start, part) != following:
                        raise ValueError(f"conversation {conv}: part {part} of the context at {start} is not what is expected")
                    following = conv, start, part + 1
                    digest.update(context)
                    if reply is not None:
                        yield conv, start, stop, total, digest.hexdigest(), opening, reply

        yield from pack(rows(), arrow.names, arrow)

    read = made.select("context", "part", "conv_id", "start", "context_stop", "context_sum", "opening", "reply")
    return read.mapInArrow(run, ", ".join(f"{f.name} {'string' if f.type == text else 'bigint'}" for f in arrow))


def read_back(made: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its examples and, between them, the turns that are none (``examples`` with ``others``).

    Each example's whole context is read where it lies, its parts following each other as ``examples`` leaves them, and held against the text that precedes it, by digest,
    range and checksum; its reply is what is trained. Rows stream through in order; what is held is one turn and the running digests.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    fields = [f.split() for f in schema.split(", ")]
    names, types = [n for n, _ in fields], [pa.int64() if t == "bigint" else pa.string() for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            state = None
            for batch in batches:
                for conv, start, context_stop, context_sum, context_read, opening, reply in python_rows(batch):
                    if state is None or state[0] != conv:
                        if state is not None:
                            yield close(state)
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, xxhash.xxh3_128()]
                    if start != state[5]:
                        raise ValueError(f"conversation {conv}: a turn at {start}, expected {state[5]}")
                    formatted = opening if reply is None else opening + reply + END
                    role, text, at = read_piece(formatted)
                    if (role == TRAINED) != (reply is not None):
                        raise ValueError(f"conversation {conv}: the turn at {start} is not as its role wants")
                    if reply is not None:
                        context = state[7].copy()
                        context.update(opening.encode("utf-8", "surrogatepass"))
                        if (context_stop, context_sum, context_read, at) != (start + len(opening), state[6], context.hexdigest(), len(opening)):
                            raise ValueError(f"conversation {conv}: the context of the reply at {start} is not what precedes it")
                        said = unescape(reply)
                        state[3] += len(said)
                        state[4].update(said.encode("utf-8", "surrogatepass"))
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[5] += len(formatted)
                    state[6] += piece_hash(formatted)
                    state[7].update(formatted.encode("utf-8", "surrogatepass"))
            if state is not None:
                yield close(state)

        def close(state):
            conv, n, turns, chars, loss, size, *_ = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        yield from pack(rows(), names, pa.schema(list(zip(names, types))))

    columns = ["start", "context_stop", "context_sum", "context_read", "opening", "reply"]
    return _in_order(_contexts_read(made), columns).mapInArrow(run, schema)


#: The conversation that the contract adds; its texts look like control strings.
PROBE = "\\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(examples(expand(given.unionByName(probe)), others=True))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '##', '\#\#'), '</turn>', '\</turn>')) AS body,
    length(replace(replace(replace(replace(role, '\', '\\'), '##', '\#\#'), '</turn>', '\</turn>'), ':', '\:')) AS head
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + head + 2 + body + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
