import itertools
import random
import re

import pytest

from loomlog.llm import langid, pieces, secrets
from test_decontaminate import brute as hits_of
from test_decontaminate import split
from test_langid import brute as language_of
from test_pieces import sequential
from test_simhash import copies_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def write(spark, folder, docs, bench):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def corpus():
    rng = random.Random(6)
    words = {"en": [f"the{c}ing" for c in "abcdefghkl"], "fr": [f"é{c}eaux" for c in "abcdefghkl"]}
    bench = [(i, " ".join(rng.choices(words["en"], k=20))) for i in range(5)]
    docs = []
    for i in range(80):
        lang = rng.choice(["en", "fr"])
        text = " ".join(rng.choices(words[lang], k=rng.choice([5, 60, 200])))
        if i % 9 == 0:
            text = text[: len(text) // 2] + " " + bench[i % 5][1]
        if i % 7 == 0:
            text += " token = 'abcdefghijklmnop" + str(i) + "' " + "0123456789abcdef" * 2
        docs.append((i, text, lang, "s", len(text)))
        if i % 5 == 0:
            docs.append((1000 + i, text, None, "s", len(text)))
        if i % 3 == 0 and len(text.split()) > 150:
            docs.append((1500 + i, text.replace(" ", " edit ", 1), lang, "s", len(text)))
    passage = " ".join(bench[2][1].split()[3:16])
    for i, lang in enumerate(["en", "fr", "en"]):
        body = [rng.choice(words[lang]) + "s" for _ in range(5000)]
        body[700 * i + 9 : 700 * i + 9] = passage.split()
        docs.append((3000 + i, ", ".join(body), lang, "s", 1))
    docs += [(2000, None, "en", None, None), (2001, "", "en", "s", 0), (2002, "123 ...", None, "s", 7)]
    return docs, bench


WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cleaned(text, bench):
    """The text without benchmark words, or None if the document goes."""
    first = True
    while True:
        words = split(text)
        hit = set()
        for _, t in bench:
            w = split(t)
            k = min(13, len(w))
            grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
            hit |= {j for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in grams for j in range(i, i + k)}
        if not hit:
            return text
        if first and 20 * len(hit) >= len(words):
            return None
        places = itertools.count()
        text = WORD.sub(lambda m: "" if next(places) in hit else m[0], text)
        first = False


def redacted(text):
    spans = []
    for r in secrets.RULES:
        for m in re.finditer(r.pattern, text, re.ASCII):
            if m.end(r.value) - m.start(r.value) >= r.least:
                spans.append((m.start(r.value), m.end(r.value), r.kind))
    out, at = "", 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += text[at:a] + f"<{kind}>"
        at = max(at, b)
    return out + text[at:]


def test_against_brute_force(spark, tmp_path):
    """Every stage again in plain Python; only the language sample and the vocabulary file are the package's."""
    docs, bench = corpus()
    samples = langid.fit(spark.createDataFrame(docs, DOCS))
    kept = [d for d in docs if language_of(d[1], samples)[0] != "und"]
    firsts = {key for key, least in copies_of([(d[0], d[1]) for d in kept]) if key == least}
    kept = [d for d in kept if str(d[0]) in firsts]
    texts = {d[0]: cleaned(d[1], bench) for d in kept}
    assert None in texts.values() and any(t is not None and t != d[1] for d in kept for t in [texts[d[0]]])
    assert len([t for t in texts.values() if t]) > 30
    vocabulary = pieces.Vocabulary.load(pieces.MODEL)
    want = {key: sequential(vocabulary, redacted(text))[1] for key, text in texts.items() if text is not None}
    out = corpus_pipeline.run(spark, write(spark, tmp_path, docs, bench)).collect()
    assert {r.doc_id: r.ids for r in out} == want and len(out) == len(want)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, bench = corpus()
    folder = write(spark, tmp_path, docs, bench)
    for rows in (docs, []):
        frame = spark.createDataFrame(rows, DOCS)
        for _, step in corpus_pipeline.STAGES[:-1]:
            frame = step(spark, frame, folder)
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        corpus_pipeline.STAGES[-1][1](spark, frame, folder).count()


def test_rows_of_all_kinds_in_each_stage(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    _, bench = corpus()
    extra = "score double, lang_pred string, fp long, component_id long, label long, uid long, w string, spans string, found string, key string, ids string"
    long = " ".join(f"thing{i % 977}" for i in range(120_000))
    texts = [(1, "the thing is here"), (1, "the thing is here"), (2, ""), (3, None), (None, "the when other"), (None, None), (4, long), (5, long + " tail"), (6, "password = 'abcdefghijklmnop'")]
    docs = [(k, t, None if i % 2 else "en", None, None if i % 3 else 5, 0.5, "xx", 7, 8, 9, 10, "w", "s", "f", "k", "i") for i, (k, t) in enumerate(texts)]
    folder = write(spark, tmp_path, [d[:5] for d in docs], bench)
    frame = spark.createDataFrame(docs, f"{DOCS}, {extra}")
    key = lambda r: tuple(map(str, r))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, frame, folder)
        assert out.columns == frame.columns, name
        got = sorted((tuple(r) for r in out.collect()), key=key)
        if name == "language":
            assert got == sorted((d for d in docs if d[1]), key=key)
        elif name == "near_duplicates":
            left = [d for i, d in enumerate(docs) if i not in (1, 7) and d[0] not in (2, 3)]
            assert [g for g in got if g[0] not in (2, 3)] == sorted(left, key=key) and sum(g[0] in (2, 3) for g in got) == 1
        elif name == "benchmark":
            assert got == sorted(docs, key=key)
        else:
            assert [g for g in got if g[0] != 6] == sorted((d for d in docs if d[0] != 6), key=key)
            assert [g[1] for g in got if g[0] == 6] == ["password = '<assign>'"]
    out = {r.doc_id: r for r in corpus_pipeline.tokens(spark, frame.where("doc_id is not null").dropDuplicates(["doc_id"]), folder).collect()}
    assert out[3].ids is None and out[2].n_tokens == 0 and out[4].n_tokens > 100_000 and out[4].round_trip


def test_no_passage_is_left(spark, tmp_path):
    bench = [(1, " ".join(f"b{i}" for i in range(24))), (2, " ".join(f"c{i}" for i in range(20)))]
    plain = [" ".join(f"w{j}x{i}" for i in range(900)) for j in range(4)]
    half = 450 * 2
    nested = " ".join([*bench[0][1].split()[:12], bench[1][1], *bench[0][1].split()[12:]])
    texts = [plain[0], plain[1][:half] + " " + bench[0][1] + "; " + plain[1][half:], plain[2][:half] + " " + nested + " " + plain[2][half:], bench[1][1] + " short", None]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    assert [r[0] for r in hits_of(docs, bench) if r[2] and not r[5]] == ["1", "2"]
    frame = corpus_pipeline.benchmark(spark, spark.createDataFrame(docs, DOCS), write(spark, tmp_path, docs, bench))
    out = {r.doc_id: r for r in frame.collect()}
    assert set(out) == {0, 1, 2, 4} and out[0].text == texts[0] and out[4].text is None and out[4].n_chars is None
    assert all(not r[2] for r in hits_of([tuple(r) for r in out.values()], bench))
    assert out[1].text.split() == (plain[1][:half] + " ; " + plain[1][half:]).split() and out[2].text.split() == (plain[2][:half] + " " + plain[2][half:]).split()
    assert all(r.n_chars == len(r.text) for r in out.values() if r.text)
