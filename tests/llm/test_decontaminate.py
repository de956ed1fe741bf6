import hashlib
import random
import re

import pytest

from loomlog.llm import decontaminate

DOCS = "doc_id bigint, text string, item_id string, gram string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, n=13):
    out = []
    for key, text, *_ in docs:
        words = split(text)
        hit, items = set(), set()
        for item, t in bench:
            w = split(t)
            k = min(n, len(w))
            grams = {tuple(w[i : i + k]) for i in range(max(1, len(w) - n + 1))} if w else set()
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    items.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((str(key), len(words), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out)


def data():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "ñandú", "日本"]
    bench = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 12, 13, 14, 30])) + ["Ztail"])) for i in range(25)]
    bench += [(100, None), (101, ""), (102, "..."), (3, bench[3][1]), (None, "An Item without id"), (200, bench[5][1])]
    docs = []
    for i in range(60):
        body = rng.choices(words, k=rng.choice([0, 5, 30, 300]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(body) + 1)
            body[at:at] = (bench[rng.randrange(25)][1] or "").upper().split()
        docs.append((i, rng.choice([" ", ", ", "--"]).join(body), "x", "y"))
    docs += [(70, None, None, None), (71, "", None, None), (None, bench[4][1], None, None), (4, docs[4][1], "x", "y"), (72, (bench[9][1] + " gap ") * 400, "", "")]
    return docs, bench


@pytest.mark.parametrize("limits", [{}, {"most": 1}, {"broadcast_bytes": 0}])
def test_matches_brute_force(spark, limits):
    docs, bench = data()
    got = decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id bigint, text string"), **limits)
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect())
    assert rows == brute(docs, bench)


def test_removal(spark):
    docs, bench = data()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id bigint, text string")
    bad = [r[5] for r in brute(docs, bench)]
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == len(docs) - sum(bad)
    text = "Keep this, " + bench[3][1].replace("w", "W") + "; and that."
    clean = decontaminate.remove_spans(spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id bigint, text string"), b.where("item_id = 3"))
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[2] == "plain" and out[3] is None
    assert out[1].startswith("Keep this, ") and out[1].endswith("; and that.") and split(out[1]) == ["keep", "this", "and", "that"]


def test_many_separate_hits_in_a_long_text(spark):
    bench = [(1, " ".join(f"b{i}" for i in range(13))), (2, "alone")]
    text = (bench[0][1] + "; Gap, alone x ") * 20_000 + bench[0][1] + " " + bench[0][1]
    docs = [(1, text, None, None), (2, "gap", None, None)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.report(d, b).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (20_000 * 16 + 26, 20_000 * 14 + 26, 2) and got[2].n_hit == 0
    out = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b).collect()}
    assert out[1].split() == [";", "Gap,", "x"] * 20_000 and out[2] == "gap"


def test_few_windows_leave_the_row(spark, tmp_path):
    """A benchmark of the corpus's own words, all of them: what is staged for verification is little more than the true hits."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    bench = [(i, " ".join(rng.choices(words, k=60))) for i in range(2000)]
    docs = [(i, " ".join(rng.choices(words, k=500)), None, None) for i in range(200)] + [(500, bench[7][1], None, None)]
    known = decontaminate.windows(spark.createDataFrame(bench, "item_id bigint, text string"))
    decontaminate.hits(spark.createDataFrame(docs, DOCS), known, folder=f"file://{tmp_path}").count()
    found = spark.read.parquet(f"file://{tmp_path}/rows").selectExpr("sum(size(found))").first()[0]
    assert 48 <= found <= 48 + 200


def test_empty(spark):
    docs, bench = data()
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(d, b).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.report(d.limit(0), b).count() == 0
