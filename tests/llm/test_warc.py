import gzip
import hashlib

import pytest

from loomlog.llm import warc

SCHEMA = "page_id bigint, url string, html string, key string"


def rows():
    big, other = "<p>é</p>" * 200, "x" * 999
    out = [(i, f"http://h{i % 3}.example.com/p/{i}?q={i}", f"<html>{i}</html>" * (i % 120), "clash") for i in range(150)]
    out += [(200 + i, "https://hot.example.com/same", big, "") for i in range(40)]
    out += [(300 + i, None, other, "") for i in range(3)]
    out += [(400, "not a url", None, ""), (401, "", "", ""), (402, "http://[bad", "a\r\n\r\nb" * 300, ""), (403, "http://x/\r\nWARC-Type: y", "", "")]
    out += [(None, "http://null.example.com/", big, ""), (None, None, "z", ""), (404, "http://日本.example/ü ü%20", "WARC/1.1\r\n\r\n", "")]
    return out + [out[30], (405, "http://long.example/", "long " * 200_000, ""), (239, "https://hot.example.com/other", big, "")]


def brute(data):
    out = []
    for page, _, html, _ in data:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in data if (h or "") == (html or "") and p is not None]
        top = max(same, default=None)
        revisit = page is not None and len(payload) >= 1000 and top != page
        out.append((str(page), len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("lines", [1000, 4])
def test_round_trip(spark, lines):
    data = rows()
    got = warc.round_trip(spark.createDataFrame(data, SCHEMA).repartition(3), lines=lines).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(data)
    texts = {(r.page_id, hashlib.sha1(bytes(r.payload)).hexdigest()) for r in got if r.record_type == "response"}
    assert all(r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest() for r in got if r.record_type == "response") and texts


def test_look_up_reads_few_blocks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.example.com/{i}", "t", "") for i in range(3000)], SCHEMA)
    folder = f"file://{tmp_path}"
    parts = warc.build_index(warc.write_archives(pages, folder), folder, lines=20)
    reader = warc.Reader(folder, parts)
    found = list(reader.find(warc.escaped("http://h7.example.com/57")))
    assert [f[0] for f in found] == [57] and reader.reads <= 2
    assert list(reader.find("zzz")) == [] and list(reader.find("")) == []
    data = gzip.decompress(open(f"{tmp_path}/warc/{found[0][1]}", "rb").read())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_hot_digests_are_dealt_out(spark):
    big = "<p>same</p>" * 120
    data = [(i, f"http://h/{i}", big if i % 3 else f"{i} " * 400, "") for i in range(6000)]
    typed = warc._typed(spark.createDataFrame(data, SCHEMA))
    assert typed.where("refers_to is not null").count() == 3999 and typed.where("refers_to <> 5999").count() == 0


def test_readers_follow_the_bytes(spark):
    captures = spark.createDataFrame([(40 << 20,)] * 50, "length bigint")
    assert warc.ranges(captures, 100 << 20) == 20 and warc.ranges(captures.limit(0)) == spark.sparkContext.defaultParallelism


def test_keys():
    assert warc.surt("http://Blog.Example.com:80/a?b#c") == "com,example,blog)/a?b"
    assert warc.surt("https://example.com:8443") == "com,example:8443)/"
    assert warc.surt(None) == "" and warc.surt("plain") == "plain"


def test_damage_is_seen():
    good = warc.record(1, "http://a/", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"paylxad\r\n"))


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
