import math
import random

import numpy as np

from loomlog.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, score string"


def parse(text, sample):
    """Greedy longest phrases of text that occur in sample."""
    i = n = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        i = max(j, i + 1)
        n += 1
    return n


def test_automaton_parses_like_brute_force():
    rng = random.Random(3)
    for _ in range(30):
        sample = "".join(rng.choices("abcd ", k=rng.randrange(5, 300)))
        text = "".join(rng.choices("abcde ", k=rng.randrange(1, 200)))
        model = langid.Model({"x": sample})
        clean = "".join(chr(c) if c else " " for c in langid.letters_of(text))
        known = "".join(chr(c) if c else " " for c in langid.letters_of(sample))
        codes = model.code[langid.spelled(langid.letters_of(text))].astype(np.int32)
        lane = np.r_[codes, np.full(5, langid.PAD)].astype(np.int32)[:, None]
        assert model.phrases(lane)[0, 0] == parse(clean, known)


def rows():
    rng = random.Random(1)
    words = {"zh": ["天地玄黄", "宇宙洪荒", "日月盈昃"], "ja": ["いろはに", "ほへとち", "りぬるを"], "en": ["the", "thing", "when", "this", "other"], "de": ["der", "und", "nicht", "schön", "über"], "xx": ["ζωή", "και", "λόγος"]}
    out = []
    for i in range(400):
        lang = rng.choice(list(words))
        out.append((i, " ".join(rng.choices(words[lang], k=30)), lang, "clash"))
    return out


def test_predictions(spark):
    data = rows()
    extra = [(900, None, "en", ""), (901, "", None, ""), (902, "12 34 !", "de", ""), (None, "the thing", "en", ""), (5, data[5][1], data[5][2], "")]
    extra += [(903, "nicht der " * 60000, None, ""), (904, "漢字", None, "")]
    docs = spark.createDataFrame(data + extra, SCHEMA)
    samples = langid.fit(docs)
    assert sorted(samples) == ["de", "en", "ja", "xx", "zh"] and all(len(s) <= langid.CHARS for s in samples.values())
    out = langid.predict(docs, samples).collect()
    assert len(out) == len(data) + len(extra)
    got = {r.doc_id: r.lang_pred for r in out}
    assert sum(got[i] == lang for i, _, lang, _ in data) == len(data)
    assert got[900] == got[901] == got[902] == "und" and got[903] == "de" and got[904] in samples
    assert all(0 <= r.score <= 1 for r in out)
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(data) + len(extra) - 3
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, kept.collect()), key=key) == sorted((r for r in data + extra if r[0] not in (900, 901, 902)), key=key)


def brute(text, samples):
    """Language and score by phrases counted one after the other in each window."""
    spell = lambda t: langid.spelled(langid.letters_of(t)).tobytes()
    codes = spell(text or "")
    if not codes.strip(b"\0") or not samples:
        return "und", 0.0
    costs = []
    for lang in sorted(samples):
        known = spell(samples[lang])
        n = sum(parse(codes[i : i + langid.WINDOW], known) for i in range(0, len(codes), langid.WINDOW))
        costs.append((n * math.log2(len(known) + 1), lang))
    best = min(costs)
    others = [c for c, lang in costs if lang != best[1]]
    return best[1], 1 - best[0] / min(others) if others and min(others) > 0 else 1.0


def test_predictions_match_brute_force(spark):
    rng = random.Random(8)
    data = [(r[0], r[1][: rng.choice([1, 5, 40, 400])], r[2], "") for r in rows()[:150]]
    data += [(500 + i, "".join(rng.choices("abché ,ü天", k=rng.choice([1, 3, 700, 3000]))), rng.choice(["mix", None]), "") for i in range(40)]
    data += [(600, None, "en", ""), (601, " 1 ", "en", ""), (None, "the", "en", "")]
    docs = spark.createDataFrame(data, SCHEMA)
    samples = langid.fit(docs)
    got = sorted((str(r.doc_id), r.text, r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, samples).collect() if r.text)
    assert got == sorted((str(k), t, lang, round(score, 9)) for k, t, *_ in data if t for lang, score in [brute(t, samples)])
    assert brute(None, samples) == ("und", 0.0) == brute("1", {})


def test_every_language_is_learned_within_the_total(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1200)]
    data = [(i, letters[i // 2] * 60, f"lang{i // 2:04d}", "") for i in range(2400)]
    samples = langid.fit(spark.createDataFrame(data, SCHEMA))
    assert len(samples) > 1100 and sum(map(len, samples.values())) <= langid.TOTAL and all(samples.values())


def test_long_texts_are_sampled_over_their_length(spark):
    text = "a" * 50_000 + "b" * 50_000
    samples = langid.fit(spark.createDataFrame([(i, text, "x", "") for i in range(200)], SCHEMA))
    assert 0.2 < samples["x"].count("b") / len(samples["x"]) < 0.8


def test_empty_and_unlabelled(spark):
    assert langid.predict(spark.createDataFrame([], SCHEMA), {}).count() == 0
    docs = spark.createDataFrame([(1, "some text", None, "")], SCHEMA)
    assert [r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()] == ["und"]


def test_windows_of_a_long_text_sum_up():
    model = langid.Model({"a": "abcabcabd" * 20, "b": "xyzxyyz" * 20})
    text = "abc" * 5000
    cost, _ = model.costs([text, None, text])
    assert cost[0].tolist() == cost[2].tolist() and cost[1].tolist() == [0, 0] and cost[0][0] < cost[0][1]


def test_letters_of_every_plane():
    every = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    assert all((langid.letters_of("".join(every[i : i + 4096])) != 0).all() for i in range(0, len(every), 4096))
    model = langid.Model({"en": "the thing", "zh": "漢字"})
    assert model.predict(["\U00030000\U00030001", "12 34"])[0][0] != "und" and model.predict(["12 34"])[0][0] == "und"
