import hashlib
import random

import pytest

from loomlog.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, start string"


def rows():
    rng = random.Random(7)
    bits = ["\\", "#", "##", "###", "####", "</turn>", "<", "/turn>", "### assistant: ", "\n", ": ", "é", "日本", "word ", "\\\\#", chat.PROBE]
    out = []
    for c in range(30):
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "system", "assistant", "to:ol\\", None, ""])
            text = rng.choice([None, "", "".join(rng.choices(bits, k=rng.randrange(1, 14)))])
            out.append((c, t, role, text, "clash"))
    out += [(None, 0, "user", "x", ""), (None, 1, "assistant", "y", ""), (50, None, "assistant", "z", ""), (50, 3, "user", "same", ""), (50, 3, "user", "same", ""), (50, -9, "user", "early", ""), (50, -2000, "assistant", "earlier", "")]
    out += [(60, t, "assistant", f"t{t}", "") for t in range(50)] + [(61, 0, "assistant", "long " * 100_000, "")]
    return out


def brute(data):
    convs = {}
    for c, t, r, x, _ in data:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        full = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((str(c), len(turns), hashlib.sha256(full.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def test_reads_back(spark):
    data = rows()
    expanded = chat.expand(spark.createDataFrame(data, SCHEMA), turns=7)
    got = chat.read_back(chat.examples(expanded, others=True)).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got) == brute(data)
    assert sum(r.formatted_chars for r in got) == sum(len(r.formatted) for r in expanded.collect())


def test_no_control_string_survives_in_a_text(spark):
    for r in chat.expand(spark.createDataFrame(rows(), SCHEMA)).collect():
        body = r.formatted[len(chat.OPEN) : -len(chat.END)]
        assert "###" not in body and body.replace("\\</turn>", "").count("</turn>") == 0


def test_examples(spark):
    data = [(1, 0, "user", "hi ###", ""), (1, 1, "assistant", "a\\b", ""), (1, 2, "user", "</turn>", ""), (1, 3, "assistant", "bye", "")]
    out = chat.materialise(chat.expand(spark.createDataFrame(data, SCHEMA))).orderBy("turn").collect()
    first = "### user: hi \\#\\##</turn>\n### assistant: "
    assert [(r.context, r.reply) for r in out] == [
        (first, "a\\\\b"),
        (first + "a\\\\b</turn>\n### user: \\</turn></turn>\n### assistant: ", "bye"),
    ]
    assert chat.unescape(out[0].reply) == "a\\b"


def test_examples_name_their_contexts(spark):
    """Each assistant turn is an example whose context, by range and checksum, is all that was said before."""
    data = rows()
    expanded = chat.expand(spark.createDataFrame(data, SCHEMA), turns=4)
    texts = {}
    for r in expanded.orderBy("conv_id", "start").collect():
        texts.setdefault(r.conv_id, []).append((r.start, r.formatted, r.role))
    found = {(r.conv_id, r.start): r for r in chat.examples(expanded).collect()}
    written = {(r.conv_id, len(r.context)): r for r in chat.materialise(expanded).collect()}
    assert len(found) == len(written) == sum(role == "assistant" for t in texts.values() for _, _, role in t)
    for conv, pieces in texts.items():
        digest, before = 0, ""
        for start, formatted, role in pieces:
            assert start == len(before)
            if role == "assistant":
                r = found[conv, start]
                assert r.context_sum == digest and before + r.opening == written[conv, r.context_stop].context and r.reply == written[conv, r.context_stop].reply
                assert formatted == r.opening + r.reply + chat.END
            digest += chat.piece_hash(formatted)
            before += formatted


def test_a_wrong_context_is_seen(spark):
    data = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "a", ""), (1, 2, "user", "b", ""), (1, 3, "assistant", "c", "")]
    expanded = chat.expand(spark.createDataFrame(data, SCHEMA))
    good = chat.examples(expanded, others=True)
    wrongs = [good.withColumn("context_sum", good.context_sum + 1), good.withColumn("context_stop", good.context_stop - 1), good.where("turn <> 1"), good.where("turn <> 2")]
    for wrong in (*wrongs, good.withColumn("opening", chat.F.replace("opening", chat.F.lit("hi"), chat.F.lit("ho")))):
        with pytest.raises(Exception, match="is not what precedes it|is not as its role|expected"):
            chat.read_back(wrong).collect()


def test_examples_hold_their_contexts(spark):
    """Contexts in one part or in several, written by one task or by several: each is whole."""
    data = rows()
    expanded = chat.expand(spark.createDataFrame(data, SCHEMA), turns=4)
    wanted, before = {}, {}
    for r in expanded.orderBy("conv_id", "start").collect():
        if r.role == "assistant":
            wanted[r.conv_id, r.start] = before.get(r.conv_id, "") + r.formatted[: r.target_start - r.start]
        before[r.conv_id] = before.get(r.conv_id, "") + r.formatted
    for size, together in ((chat.PART, chat.TOGETHER), (70, 3), (1, 1)):
        made = chat.examples(expanded, others=True, size=size, together=together)
        got, tasks = {}, set()
        for r in made.withColumn("task", chat.F.spark_partition_id()).where("context IS NOT NULL").orderBy("conv_id", "start", "part").collect():
            assert r.part == len(got.setdefault((r.conv_id, r.start), []))
            got[r.conv_id, r.start].append(r.context)
            tasks |= {r.task} if r.conv_id == 60 else set()
        assert {k: "".join(v) for k, v in got.items()} == wanted
        assert (len(tasks) > 1) == (together < 50) and (max(map(len, got.values())) > 1) == (size < 100)
        back = chat.read_back(made).collect()
        assert sorted((str(r.conv_id), r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in back) == brute(data)


def test_contexts_kept_in_a_file(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPOOL", 100)
    text, whole = chat._Text(40), b""
    for i in range(50):
        piece = f"piece {i} é".encode() * (i % 5)
        text.add(piece)
        whole += piece
        assert b"".join([*text.closed(), text.last]) == whole
    assert text.file._rolled


def test_the_query_reads_whole_contexts(spark, monkeypatch, tmp_path):
    data = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "a", ""), (1, 2, "user", "b", ""), (1, 3, "assistant", "c", "")]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    made, context = chat.examples, chat.F.col("context")
    assert len(chat.op4_chat(spark, str(tmp_path)).collect()) == 2
    for wrong in (chat.F.replace(context, chat.F.lit("hi"), chat.F.lit("ho")), chat.F.substring(context, 2, 1000), chat.F.lit(None).cast("string")):
        monkeypatch.setattr(chat, "examples", lambda *a, wrong=wrong, **k: made(*a, **k).withColumn("context", wrong))
        with pytest.raises(Exception, match="is not what precedes it"):
            chat.op4_chat(spark, str(tmp_path)).collect()


def test_empty(spark):
    frame = chat.expand(spark.createDataFrame([], SCHEMA))
    made = chat.examples(frame)
    assert frame.count() == 0 and made.count() == 0 and chat.read_back(chat.examples(frame, others=True)).count() == 0 and chat.materialise(frame).count() == 0
