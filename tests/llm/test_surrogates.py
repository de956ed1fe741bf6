import hashlib
import hmac
import random
import re

import pytest
import regex

from loomlog.llm import surrogates

KEY = b"key of the tests"
SCHEMA = "doc_id bigint, text string, n_email string, surrogate string"
PEOPLE = [
    (1, "Write to anna.b@mail.example.com or call +1 (017) 555-7713. Anna.B@MAIL.example.com again."),
    (2, "Server 97.51.17.173, card 4111111111111111 and 4111 1111 1111 1111, other 9807915762804490 4845168114407329."),
    (3, "SSN 123-45-6789; IBAN GB29 NWBK 6016 1331 9268 19 and GB29NWBK60161331926819"),
    (4, "Frau Maria Lopez met Mr. Lopez and Dr. Иван Петров, then Mme Curie and FRAU."),
    (5, "Herr LOPEZ and Prof. Μαρία Παπαδοπούλου; +49 151 2345678 x"),
    (6, "No personal data here, version 1.2.3, 2024-05-06, 12345, hash 04dbebab91ab85687d33eeaaf9ac699e1188f962."),
    (7, None),
    (8, ""),
    (None, "anna.b@mail.example.com"),
    (9, "é@x y@z @ über.34@mail2.example.com, end"),
]


def run(spark, rows, key=KEY):
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], SCHEMA)
    return {str(r.doc_id): r for r in surrogates.replace_personal_data(docs, key).collect()}


# --- the operator again, in plain Python --------------------------------------------------------------------------


def tokens_of(entity):
    """(token, kind, norm, gender) of each token; titles have no kind."""
    kind = next((k for k, p in surrogates.KINDS.items() if k != "name" and regex.fullmatch(p, entity)), "name")
    if kind != "name":
        digits = re.sub("[^0-9]", "", entity)
        if kind == "phone":
            code = regex.match(f"(?:{surrogates.CODES}|[0-9]{{3}})", digits)[0] if entity[0] == "+" else ""
            return [(entity, kind, f"{code}.{digits[len(code):]}", "n")]
        return [(entity, kind, digits if kind in ("card", "ssn") else entity.replace(" ", "") if kind == "iban" else entity.lower(), "n")]
    words = entity.split(" ")
    first = words[0].removesuffix(".")
    titled = any(first in t for t in surrogates.TITLES.values())
    gender = next((g for g in "mf" if first in (surrogates.TITLES if titled else surrogates.GIVEN)[g]), "n")
    return [(w, None if titled and i == 0 else "surname" if i == len(words) - 1 else "given", w.lower(), gender) for i, w in enumerate(words)]


def luhn(digits):
    return sum((d * 2 - 9 * (d > 4) if i % 2 else d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def script_of(word):
    return next((n for n, cls, *_ in surrogates.SCRIPTS if cls and regex.search(cls, word)), "latin")


def draw(key, kind, norm, gender, script, attempt):
    def block(*parts):
        seed = "\x1f".join(parts)
        return "".join(hmac.new(key, (seed + end).encode(), hashlib.sha256).hexdigest() for end in ("", "+"))

    h, d = block("entity", kind, norm, str(attempt)), block("domain", norm.partition("@")[2])
    byte = lambda i, h=h: int(h[2 * (i % 60) : 2 * (i % 60) + 2], 16)

    def shape(text, h=h):
        out = ""
        for i, c in enumerate(text):
            if "0" <= c <= "9":
                c = str(byte(i, h) % 10)
            elif c.isalpha():
                letters = next(a for cls, a in surrogates.ALPHABETS if not cls or regex.match(cls, c))
                new = letters[byte(i, h) % len(letters)]
                c = new.upper() if c != c.lower() else new
            out += c
        return out

    wider = "0" * max(0, attempt - surrogates.WIDER + 1)
    if kind == "email":
        local, domain = norm.split("@")
        return shape(local + wider) + "@" + shape(domain.rpartition(".")[0], d) + "." + domain.rpartition(".")[2]
    if kind == "ipv4":
        return ".".join(str(1 + byte(i) % 254) for i in range(4)) + ("." + shape(wider) if wider else "")
    if kind == "iban":
        account = shape(norm[4:] + wider)
        check = f"{98 - mod97(account + norm[:2] + '00'):02d}" if mod97(norm[4:] + norm[:4]) == 1 else shape(norm[2:4])
        return norm[:2] + check + account
    if kind == "phone":
        code, number = norm.split(".")
        return f"{code}.{shape(number + wider)}"
    if kind == "card" and luhn(norm) == 0:
        body = shape(norm[:-1] + wider)
        return body + str(-luhn(body + "0") % 10)
    if kind in ("card", "ssn"):
        return shape(norm + wider)
    _, _, consonants, vowels, endings = next(x for x in surrogates.SCRIPTS if x[0] == script)
    syllables = [c + v for c in consonants for v in vowels]
    drawn = (syllables[int(h[4 * (i % 30) : 4 * (i % 30) + 4], 16) % len(syllables)] for i in range(1, 4 + attempt // 2))
    return "".join(drawn) + endings["s" if kind == "surname" else gender]


def settle(key, known):
    """known: {(kind, norm): (gender, script)} to {(kind, norm): surrogate}."""
    held = {place: None for place in known}
    out, pending, attempt = {}, set(known), 0
    while pending:
        claims = {}
        for kind, norm in sorted(pending):
            claims.setdefault((kind, draw(key, kind, norm, *known[kind, norm], attempt)), norm)
        for (kind, surrogate), norm in claims.items():
            if (kind, surrogate) not in held:
                held[kind, surrogate] = norm
                out[kind, norm] = surrogate
        pending -= set(out)
        attempt += 1
    return out


def laid(token, kind, surrogate):
    if kind is None:
        return token
    if kind in ("given", "surname"):
        return surrogate.upper() if token == token.upper() and len(token) > 1 else surrogate.capitalize() if token[0] == token[0].upper() else surrogate
    if kind == "email":
        return "@".join("".join(c.upper() if a[i : i + 1] != a[i : i + 1].lower() else c for i, c in enumerate(b)) for a, b in zip(token.split("@"), surrogate.split("@")))
    if kind == "ipv4":
        return surrogate
    rest = iter(surrogate.replace(".", ""))
    out = "".join(next(rest) if re.match("[0-9A-Za-z]", c) else c for c in token)
    return out + "".join(rest)


def brute(rows, key=KEY):
    found = [[tokens_of(m[0]) for m in regex.finditer(surrogates.ANY, t or "")] for _, t in rows]
    known = {}
    for token, kind, norm, gender in (x for entities in found for tokens in entities for x in tokens):
        if kind:
            genders, script = known.setdefault((kind, norm), (set(), script_of(token)))
            genders.add(gender)
            known[kind, norm] = genders, min(script, script_of(token))
    known = {k: ("m" if "m" in g and "f" not in g else "f" if "f" in g and "m" not in g else "n", script) for k, (g, script) in known.items()}
    names = settle(key, known)
    out = []
    for (key_, text), entities in zip(rows, found):
        pieces = iter([" ".join(laid(t, k, names.get((k, n))) for t, k, n, _ in tokens) for tokens in entities])
        out.append((str(key_), None if text is None else regex.sub(surrogates.ANY, lambda _: next(pieces), text)))
    return out


MADE = [  # makers of entities from a few of each, so that spellings and texts repeat
    lambda r: r.choice(["a.b", "A.B", "x9", "жук", "Δέλτα", "山"]) + "@" + r.choice(["ex.com", "Mail.EX.com", "ex.com", "пример.com"]),
    lambda r: f"10.{r.randrange(3)}.0.{r.randrange(4)}",
    lambda r: f"{r.randrange(120, 123)}-45-678{r.randrange(3)}",
    lambda r: r.choice(["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282 2463 10005"]),
    lambda r: r.choice(["GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926819", "DE00 1234 5678 9012 3456 78"]),
    lambda r: r.choice(["+49 1701234567", "+491701234567", "+1 (017) 555-7713", "+1 017 555 7713", "017 555 7713", "+4917 012 34567", "+353 12 345 678"]),
    lambda r: r.choice(["Frau ", "Herr ", "Dr. ", "Г-жа ", ""]) + r.choice(["Maria Lopez", "Anna LOPEZ", "Иван Петров", "Μαρία Παππά", "Élodie Curie", "Anna Maria O'Neil"]),
]
PLAIN = ["the", "+", ", ", ".", "\x01", "\x01\x02", "\x03", "v1.2.3.4.5", "12-34", "Frau maria", "a@b", "\n", "$1", "é"]


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "; "]).join(rng.choice([lambda r: r.choice(PLAIN), *MADE])(rng) for _ in range(rng.randrange(0, 12)))) for i in range(250)]
    rows += PEOPLE + [rows[3], (900, "Anna.B@mail.example.com " * 3000)]
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], SCHEMA).repartition(5)
    got = surrogates.replace_personal_data(docs, KEY).collect()
    assert sorted(((str(r.doc_id), r.text) for r in got), key=str) == sorted(brute(rows), key=str)


def test_hostile_texts(spark):
    """Texts that make an expression repeat, each about a megabyte."""
    n = 350_000
    texts = ["a." * n, "a@" * n, "x@" + "a." * n + "com", "x@" + "a" * n, "1" * 3 * n, "1 " * n, "+1 " * n, "1." * n, "Frau " * (n // 2), "Frau A" * (n // 3), "Mr. Aa Bb Cc " * (n // 8), "GB29" * n, "\x01" * n, "A" * n, "((12" * n]
    out = run(spark, list(enumerate(texts)))
    assert [len(out[str(i)].text) >= len(t) * 0.9 for i, t in enumerate(texts)] == [True] * len(texts)
    assert out["0"].text == texts[0] and out["4"].text == texts[4] and out["12"].text == texts[12] and out["10"].n_name == n // 8


def test_spellings_of_a_number_share_a_surrogate(spark):
    out = run(spark, [(1, "+49 1701234567 or +491701234567 or +49 170 123 4567"), (2, "Anna.B@Mail.Example.COM then anna.b@mail.example.com")])
    numbers = [re.sub(r"\D", "", x) for x in out["1"].text.split(" or ")]
    assert len(set(numbers)) == 1 and numbers[0].startswith("49")
    a, b = out["2"].text.split(" then ")
    assert a.lower() == b and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z]@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.COM", a[:-3] + "COM")


def test_a_full_format_grows(spark, tmp_path):
    """Every number of three digits is real, so none is left for a surrogate of three."""
    rows = [("ssn", f"{i:03d}", "n", "latin", 1) for i in range(1000)]
    known = spark.createDataFrame(rows, "kind string, norm string, gender string, script string, n int")
    got = {r.norm: r.surrogate for r in surrogates.dictionary(known, KEY, f"file://{tmp_path}").collect()}
    assert len(got) == len(set(got.values())) == 1000 and not set(got) & set(got.values()) and {len(v) for v in got.values()} <= {4, 5}


def test_a_hot_entity_is_dealt_over_salts(spark):
    """More than one occurrence in 4,096, and more than 1,000: one surrogate all the same."""
    rows = [(i, f"note {i} to boss@corp.example and u{i}@corp.example") for i in range(2500)]
    out = run(spark, rows)
    pairs = [re.fullmatch(r"note \d+ to (\S+) and (\S+)", out[str(i)].text).groups() for i in range(2500)]
    assert len({a for a, _ in pairs}) == 1 and len({b for _, b in pairs}) == 2500 and all(out[str(i)].n_email == 2 for i in range(2500))


def test_hmac(spark):
    for key in (b"", b"k", b"long " * 40):
        got = spark.range(1).select(surrogates.hmac_sha256(key, surrogates.F.lit("messäge"))).first()[0]
        assert got == hmac.new(key, "messäge".encode(), hashlib.sha256).hexdigest()


def test_format_coreference_and_distinctness(spark):
    out = run(spark, PEOPLE + [PEOPLE[0]])
    for text in ("anna.b@", "555-7713", "97.51.17.173", "4111111111111111", "9807915762804490", "6789", "NWBK", "Maria", "Lopez", "LOPEZ", "Петров", "Παπα", "Curie", "über.34"):
        assert not any(r.text and text in r.text for r in out.values()), text
    mails = re.findall(r"\S+@\S+", out["1"].text)
    assert mails[0].lower().rstrip(".") == mails[1].lower().rstrip(".") == out["None"].text.lower() and re.fullmatch(r"[a-z]{4}\.[a-z]@[a-z]{4}\.[a-z]{7}\.com", mails[0])
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.", out["1"].text)
    ip, card, spaced, x, y = re.fullmatch(r"Server ([\d.]+), card (\d{16}) and ([\d ]{19}), other (\d{16}) (\d{16})\.", out["2"].text).groups()
    assert all(0 < int(o) < 256 for o in ip.split(".")) and spaced.replace(" ", "") == card and len({card, x, y}) == 3
    assert sum((d * 2 - 9 * (d > 4) if i % 2 else d) for i, d in enumerate(map(int, reversed(card)))) % 10 == 0
    a, b = re.fullmatch(r"SSN \d{3}-\d{2}-\d{4}; IBAN (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) and (GB\d\d[A-Z]{4}\d{14})", out["3"].text).groups()
    assert a.replace(" ", "") == b
    first, last, again, ivan, petrov, curie = re.fullmatch(r"Frau (\w+) (\w+) met Mr\. (\w+) and Dr\. (\w+) (\w+), then Mme (\w+) and FRAU\.", out["4"].text).groups()
    assert last == again and first.endswith("na") and re.fullmatch("[А-Я][а-я]+", ivan) and re.fullmatch("[А-Я][а-я]+", petrov) and curie[0].isupper()
    assert f"Herr {last.upper()} and Prof. " in out["5"].text and re.search("Prof. [Α-Ω][α-ως]+ [Α-Ω][α-ως]+;", out["5"].text)
    assert out["6"].text == PEOPLE[5][1] and out["7"].text is None and out["8"].text == ""
    assert (out["1"].n_email, out["2"].n_card, out["2"].n_ipv4, out["3"].n_ssn, out["3"].n_iban, out["4"].n_name, out["6"].n_card) == (2, 4, 1, 1, 2, 4, 0)
    assert out["1"].surrogate == "clash" and out["9"].text.startswith("é@x y@z @ ")


def test_key_decides(spark):
    assert run(spark, PEOPLE)["1"].text == run(spark, PEOPLE)["1"].text
    assert run(spark, PEOPLE)["1"].text != run(spark, PEOPLE, key=b"other")["1"].text


def test_collisions_are_drawn_again(spark, tmp_path):
    rows = [("email", f"{c}{d}@x.com", "n", "latin", 1) for c in "abcdefghijklmnopqrstuvwxyz" for d in range(10)]
    rows += [("given", f"name{i}", "f", "latin", 1) for i in range(3000)]
    known = spark.createDataFrame(rows, "kind string, norm string, gender string, script string, n int")
    found = surrogates.dictionary(known, KEY, f"file://{tmp_path}").collect()
    assert len(found) == len(rows)
    assert len({(r.kind, r.surrogate) for r in found}) == len(rows)
    assert not {(r.kind, r.surrogate) for r in found} & {(k, n) for k, n, *_ in rows}


def test_long_text_and_empty(spark):
    text = "pad " * 30_000 + "a.b@c.de " * 500
    assert run(spark, [(1, text)])["1"].n_email == 500
    assert surrogates.replace_personal_data(spark.createDataFrame([], SCHEMA), KEY).count() == 0


@pytest.mark.parametrize("text", ["only words", "a@b", "1.2.3.4.5", "12-34", "x1234567890123456", "Frau maria"])
def test_clean_texts_stay(spark, text):
    assert run(spark, [(1, text)])["1"].text == text
