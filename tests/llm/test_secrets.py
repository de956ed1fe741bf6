import random
import re

from loomlog.llm import secrets

SCHEMA = "doc_id bigint, text string, spans string"
KINDS = ["assign", "access", "hex"]


def brute(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)), [sum(s[1] == k for s in spans) for k in range(3)]


def texts():
    rng = random.Random(4)
    bits = ["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "abc123", "x/y+z_", "AKIA", "ABCD1234", "0123456789abcdef",
            "deadbeef", "é", "日本", "\n", "AKI", "pass", "ghp_" + "a1B2" * 9, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890ab"]
    out = ["".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(400)]
    return out + [None, "", "password=password=abcdefghijklm", "token: short", "AKIA" + "Z" * 14, "AKIA" + "Z" * 13, "0" * 15, "0" * 16, "é" * 50_000 + "secret='abcdefghijkl'", "ab" * 300_000]


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [(None, "token=abcdefghijklmnop"), rows[3]]
    got = secrets.scan(spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA))
    found = sorted((str(r.doc_id), ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.spans if s.kind in KINDS)) for r in got.collect())
    assert found == sorted((str(k), brute(t)[0]) for k, t in rows)


SAMPLES = {
    "forge": "ghp_" + "a1B2" * 9, "chat": "xoxb-1234567890-ab", "mapkey": "AIza" + "x_-1Z" * 7, "pay": "sk_live_" + "a1" * 8, "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl",
    "forgefine": "github_pat_" + "a" * 22 + "_" + "b" * 59, "forgelab": "glpat-" + "aB3_-" * 4, "package": "npm_" + "a1B2" * 9, "index": "pypi-AgEIcHlwaS5vcmc" + "x" * 50,
    "mail": "SG." + "a" * 22 + "." + "b" * 43, "storage": "AccountKey=" + "aB+/" * 21 + "aB==", "oauth": "ya29." + "a" * 30,
    "client": "GOCSPX-" + "a" * 28, "droplet": "dop_v1_" + "0f" * 32, "shop": "shpat_" + "0aF1" * 8, "till": "sq0atp-" + "a" * 22, "hub": "hf_" + "aB" * 17, "login": "postgres://user:pa$$w@db",
    "pem": "-----BEGIN EC PRIVATE KEY-----\nMHcCAQEEIIG\n-----END EC PRIVATE KEY-----",
}


def test_every_rule_against_plain_search(spark):
    """Each expression over each text, without an index; texts are made of whole and damaged samples."""
    assert set(SAMPLES) == {r.kind for r in secrets.ADDED}
    rng = random.Random(6)
    rows = []
    for i in range(300):
        parts = [rng.choice([" ", "\n", "é", "token = ", "x", ""]) for _ in range(rng.randrange(8))]
        for kind in rng.sample(sorted(SAMPLES), rng.choice([0, 1, 2, 3])):
            text = SAMPLES[kind]
            cut = rng.randrange(len(text))
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([text, text, text[:cut], text[:cut] + "é" + text[cut:], text.upper()]))
        rows.append((i, "".join(parts), ""))
    rows += [(400 + i, text, "") for i, text in enumerate(SAMPLES.values())]
    want = []
    for key, text, _ in rows:
        spans = []
        for k, r in enumerate(secrets.RULES):
            for m in re.finditer(r.pattern, text, re.ASCII):
                if m.end(r.value) - m.start(r.value) >= r.least:
                    spans.append((m.start(), k, r.kind, m.end()))
        want.append((key, ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))))
    got = secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.spans)) for r in got) == want
    found = dict(want)
    assert all(f"{kind}:0:" in found[400 + i] for i, kind in enumerate(SAMPLES))


def test_added_rules_and_redaction(spark):
    text = "a ghp_" + "Z" * 36 + " b token = 'abcdefghijkl' end"
    docs = spark.createDataFrame([(1, text, len(text)), (2, "clean text", 10), (3, None, None)], "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs).collect()}
    assert out[1] == ("a <forge> b token = '<assign>' end", len("a <forge> b token = '<assign>' end"))
    assert out[2] == ("clean text", 10) and out[3] == (None, None)
    assert secrets.redact(docs.limit(0)).count() == 0 and secrets.scan(docs.limit(0)).count() == 0


def test_whole_keys_are_redacted():
    key = "\n".join(["MIIEpAIBAAKCAQEA7b+/x" * 3] * 4 + ["q9Zx0A=="])
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    bodies = [f"\n{key}\n", "\\n" + key.replace("\n", "\\n") + "\\n", f"\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,0A1B\r\n\r\n{key}\n"]
    search = secrets.Searcher()

    def redacted(text):
        return secrets.redact_text(text, [(c, e, secrets.RULES[k].kind) for _, k, _, c, e in search.search([text])[0]])

    for body in bodies:
        assert redacted(f"a {begin}{body}{end} b") == "a <pem> b"
        assert redacted(f"a {begin}{body}{end}\n{begin}{body}{end} b") == "a <pem>\n<pem> b"
        cut = redacted(f"a {begin}{body} then words")
        assert cut.startswith("a <pem>") and cut.endswith(" then words") and "MII" not in cut and "q9Z" not in cut
    assert redacted(f"the line {begin} opens a key, {begin}") == "the line <pem> opens a key, <pem>"
    assert redacted((begin + "- words ") * 20_000) == "<pem>- words " * 20_000


def test_queries():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert (query is None) == (rule.kind == "hex")
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", (("tri", b"aki"), ("tri", b"kia")))
    assert secrets.trigram_query("abc|xy") is None and secrets.trigram_query("(abc|xyz)d?") is not None


def test_candidates_hold_every_match():
    rng = random.Random(9)
    pool = [t or "" for t in texts()[:400]]
    search = secrets.Searcher()
    for _ in range(20):
        part = rng.sample(pool, 20)
        lists = search.postings([t.encode().lower() for t in part])
        for query, regex in zip(search.queries, search.compiled):
            kept = set(search.candidates(query, lists, len(part)).tolist())
            assert {i for i, t in enumerate(part) if regex.search(t)} <= kept

