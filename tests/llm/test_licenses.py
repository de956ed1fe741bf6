import math
import random
import re

import pytest

from loomlog.llm import licenses

SCHEMA = "doc_id bigint, text string, score string, labels string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    words = split(text)
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(texts, templates=licenses.TEMPLATES):
    """Labels and score of each text, every template held against every place of it."""
    split_all = [split(t) for t in texts]
    own_words = [split(t.text) for t in templates]
    keys = [[split(k) for k in t.keys] for t in templates]
    idf = {w: math.log((len(texts) + 1) / (sum(w in set(words) for words in split_all) + 1)) for own in own_words for w in own}
    out = []
    for words, text in zip(split_all, texts):
        base = {x for x in brute(text)[4].split(",") if x}
        labels, score = set(base), 0.5 if base else 0.0
        for own, phrases, t in zip(own_words, keys, templates):
            rare = sorted(set(own) & set(words), key=lambda w: (-idf[w], w.encode()))[: licenses.RARE]
            need = max(min(2, len(set(own))), math.ceil(licenses.AGREE * len(rare)))
            for place in range(1 - len(own), len(words)):
                there = [0 <= place + q < len(words) and words[place + q] == w for q, w in enumerate(own)]
                if len({w for w, ok in zip(own, there) if ok} & set(rare)) < need:
                    continue
                near = words[max(0, place - licenses.SLACK) : max(0, place + len(own) + licenses.SLACK)]
                if all(any(near[i : i + len(k)] == k for i in range(len(near))) for k in phrases):
                    labels.add(t.label)
                    score = max(score, sum(there) / len(own))
        out.append((",".join(sorted(labels)), score))
    return out


def test_labels_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for i in range(70):
        parts = []
        for t in rng.sample(licenses.TEMPLATES, rng.choice([0, 1, 1, 2])):
            words = t.text.split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1, 2])] = rng.choices(["other", "software", "license", "the"], k=rng.choice([0, 1, 2]))
            parts.append(" ".join(words[rng.choice([0, 0, 2]) : len(words) - rng.choice([0, 0, 5])]))
        parts.insert(rng.randrange(len(parts) + 1), " ".join(rng.choices(["some", "code", "here", "license", "mit", "the", "of"], k=rng.randrange(0, 25))))
        texts.append(rng.choice(["\n", " -- "]).join(parts))
    texts += [None, "", "mit license", texts[3]]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).orderBy("doc_id").collect()
    want = brute_labels(texts)
    assert [r.labels for r in got] == [w[0] for w in want] and all(abs(r.score - w[1]) < 1e-9 for r, w in zip(got, want))
    assert len({w[0] for w in want}) > 15 and any(0.5 < w[1] < 1 for w in want)


def rows():
    rng = random.Random(11)
    bits = ["MIT", "License", "mit", "license", "apache", "Apache-License", "general public", "public", "GNU", "word", "É", "日本", "2.0", "\n"]
    out = [(i, " ".join(rng.choices(bits, k=rng.randrange(0, 60))), "x", "y") for i in range(150)]
    out += [(200 + i, "Intro words. " + t.text + " tail", "", "") for i, t in enumerate(licenses.TEMPLATES)]
    return out + [(300, None, None, None), (301, "", "", ""), (None, "mit license", "", ""), (3, out[3][1], "", ""), (302, "mit license " * 50_000, "", "")]


def test_base_matches_brute_force(spark):
    data = rows()
    got = licenses.scan(spark.createDataFrame(data, SCHEMA)).collect()
    key = lambda r: tuple(map(str, r))
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key)
    assert found == sorted(((k, *brute(t)) for k, t, *_ in data), key=key)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if r.doc_id is not None and 200 <= r.doc_id < 300:
            assert licenses.TEMPLATES[r.doc_id - 200].label in r.labels.split(",") and r.score == 1.0


@pytest.mark.parametrize("t", range(len(licenses.TEMPLATES)))
def test_edited_templates_are_found(t):
    index = licenses.Index()
    words = licenses.TEMPLATES[t].text.split()
    if len(words) < 20:
        return
    words[-5], words[-2] = "changed", "edited"
    text = "other text before " + " ".join(words)
    assert licenses.TEMPLATES[t].label in index.scan(text, dict.fromkeys(index.vocabulary, 1.0))[5]


@pytest.mark.parametrize("common", range(len(licenses.TEMPLATES)))
def test_every_notice_of_a_file_is_found(common):
    index = licenses.Index()
    idf = {w: 0.5 if w in index.words[common] else 5.0 for w in index.vocabulary}
    texts = [t.text for t in licenses.TEMPLATES]
    for t, template in enumerate(licenses.TEMPLATES):
        both = f"{texts[common]}\n\nsome code here\n\n{texts[t]}"
        assert {template.label, licenses.TEMPLATES[common].label} <= set(index.scan(both, idf)[5].split(","))
    assert {t.label for t in licenses.TEMPLATES} == set(index.scan("\n".join(texts), idf)[5].split(","))


def test_key_phrases_are_mandatory():
    index = licenses.Index()
    text = licenses.TEMPLATES[7].text.replace("retain the above", "keep the above")
    assert index.scan(text, {})[5] == ""


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
