"""Secret scanning with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must
contain. Texts go through in segments; a segment's postings (trigram to documents) are built
in one vectorised pass, each rule's query is answered by intersecting and uniting postings, and only the
candidates are verified with the expression itself. A rule without mandatory trigrams scans every text in full.
Segments live and die inside a task, so nothing is shuffled and a lost task is simply run again.

Offsets are code points, ends exclusive. Defined cases: null text is empty; a text without secrets has empty spans;
repeated rows and null ids are kept; matches of one rule never overlap, those of different rules may, and those that begin together
stand in the order of the rules; texts of any length are searched whole, a long one as a segment of its own; an empty table gives an empty result; ``scan``
ignores columns besides id and text, ``redact`` keeps all, whatever their names.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser as P
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, python_rows, segments, table

SEGMENT = 1 << 20


class Rule(NamedTuple):
    """``least`` is the length that group ``value`` needs; shorter matches are dropped."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0


def _either_case(text: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", text)


#: The base rules, then those that the method adds, in the order in which kinds sort.
BASE = (
    Rule("assign", rf"""({_either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: The key after its BEGIN line: all up to the END line or, where none follows, the base64 run. Line ends may be escaped. No run of
#: five dashes is passed, so a search ends at the next line of this kind.
PEM_KEY = (
    r"(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:(?:\s|\\[rn])*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:(?:\s|\\[rn])*[A-Za-z0-9+/]{16,}={0,2})*(?:(?:\s|\\[rn])*[A-Za-z0-9+/]{1,15}={1,2})?)"
)
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("mapkey", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forgefine", r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}"),
    Rule("forgelab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("package", r"npm_[A-Za-z0-9]{36}"),
    Rule("index", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    Rule("mail", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("storage", r"AccountKey=[A-Za-z0-9+/]{86}=="),
    Rule("oauth", r"ya29\.[A-Za-z0-9_-]{30,}"),
    Rule("client", r"GOCSPX-[A-Za-z0-9_-]{28}"),
    Rule("droplet", r"do[op]_v1_[a-f0-9]{64}"),
    Rule("shop", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"),
    Rule("till", r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}"),
    Rule("hub", r"hf_[A-Za-z]{34}"),
    Rule("login", r"[a-z]{2,12}://([^\s:/@\"'<>]{1,64}:[^\s:/@\"'<>]{3,128})@[A-Za-z0-9]", 1),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----" + PEM_KEY),
)
RULES = BASE + ADDED

# --- Boolean trigram queries -------------------------------------------------------------------
# A query is None (every text may match), ("tri", bytes), ("and", parts) or ("or", parts).

MOST_STRINGS = 64


def _both(kind: str, parts: list):
    if kind == "and":
        parts = [p for p in parts if p is not None]
    elif any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[bytes]):
    """What a text holds that contains one of ``strings``."""
    return _both("or", [_both("and", [("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value).encode().lower())
        elif op is K.RANGE and value[1] - value[0] < 16:
            out |= {chr(c).encode().lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 16 else None


def _walk(nodes) -> tuple[set[bytes] | None, object]:
    """The finite set of strings that the expression matches, if small, and its query otherwise."""
    exact: set[bytes] | None = {b""}
    whole = True
    query: list = []

    def flush():
        nonlocal exact
        if exact:
            query.append(_of_strings(exact))
        exact = {b""}

    for op, value in nodes:
        strings, inner = None, None
        if op is K.LITERAL:
            strings = {chr(value).encode().lower()}
        elif op is K.IN:
            strings = _class(value)
        elif op is K.SUBPATTERN:
            strings, inner = _walk(value[3])
        elif op is K.BRANCH:
            both = [_walk(b) for b in value[1]]
            if all(s is not None for s, _ in both):
                strings = set().union(*(s for s, _ in both))
            else:
                inner = _both("or", [_of_strings(s) if s is not None else q for s, q in both])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, body = value
            once, part = _walk(body)
            if once is not None and high != K.MAXREPEAT and high * max(map(len, once), default=0) <= 8 and len(once) <= 4:
                strings, power = set(), {b""}
                for n in range(high + 1):
                    if n >= low:
                        strings |= power
                    power = {a + b for a in power for b in once}
            elif low:
                inner = part if once is None else _of_strings(once)
                if once is not None and len(once) == 1:
                    inner = _of_strings({next(iter(once)) * low})
        elif op is K.AT:
            continue
        if strings is not None and len(strings) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        whole = False
        flush()
        if strings is not None:
            exact = strings
        elif inner is not None:
            query.append(inner)
    if whole:
        return exact, None
    flush()
    return None, _both("and", query)


def trigram_query(pattern: str):
    """Trigrams (of ASCII-lowered UTF-8) that every match of ``pattern`` must hold."""
    strings, query = _walk(P.parse(pattern))
    return _of_strings(strings) if strings is not None else query


def _trigrams(query) -> set[bytes]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(_trigrams, query[1]))


# --- Index of a segment ------------------------------------------------------------------------


class Searcher:
    """The rules, compiled, with their queries and a look-up from trigram to posting list."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.terms = sorted(set().union(*map(_trigrams, self.queries)))
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.lookup = np.zeros(1 << 24, dtype=np.uint16)
        for i, t in enumerate(self.terms):
            self.lookup[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def postings(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """For each term in use, the sorted documents of the segment that hold it."""
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        data = np.frombuffer(b"\xff\xff".join(texts), dtype=np.uint8)  # 0xff is in no UTF-8 text
        hits, terms = [], []
        for low in range(0, max(0, len(data) - 2), SEGMENT):  # slices keep the memory bounded for a long text
            wide = data[low : low + SEGMENT + 2].astype(np.uint32)
            found = self.lookup[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
            hits.append(np.flatnonzero(found) + low)
            terms.append(found[hits[-1] - low].astype(np.int64) - 1)
        if not hits:
            return {}
        at, found = np.concatenate(hits), np.concatenate(terms)
        if not len(at):
            return {}
        docs = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(found * len(texts) + docs)
        term, doc = pairs // len(texts), pairs % len(texts)
        cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        return {int(term[c]): part for c, part in zip(cuts, np.split(doc, cuts[1:]))}

    def candidates(self, query, lists: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        if query[0] == "tri":
            return lists.get(self.place[query[1]], np.empty(0, dtype=np.int64))
        parts = [self.candidates(q, lists, n) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, p, assume_unique=True)
        return out

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """Per text: (start, rule, end, value start, value end), sorted."""
        lists = self.postings([t.encode("utf-8", "surrogatepass").lower() for t in texts]) if texts else {}
        out: list[list] = [[] for _ in texts]
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for i in self.candidates(query, lists, len(texts)).tolist():
                for m in self.compiled[k].finditer(texts[i]):
                    if m.end(rule.value) - m.start(rule.value) >= rule.least:
                        out[i].append((m.start(), k, m.end(), m.start(rule.value), m.end(rule.value)))
        for spans in out:
            spans.sort()
        return out


_SEARCHERS: dict[tuple, Searcher] = {}


def _searcher(rules: tuple[Rule, ...]) -> Searcher:
    if rules not in _SEARCHERS:
        _SEARCHERS[rules] = Searcher(rules)
    return _SEARCHERS[rules]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, spans)`` per row; spans are structs (kind, start, stop, value_start, value_stop) by start, then rule."""

    def rows(batch):
        search = _searcher(rules)
        for part in segments(batch, SEGMENT):
            for (key, _), spans in zip(part, search.search([t or "" for _, t in part])):
                yield key, [{"kind": rules[k].kind, "start": a, "stop": b, "value_start": c, "value_stop": d} for a, k, b, c, d in spans]

    schema = f"{id_col} bigint, spans array<struct<kind:string,start:int,stop:int,value_start:int,value_stop:int>>"
    return map_rows(docs, rows, schema, [F.col(id_col).cast("bigint"), F.col(text_col).cast("string")])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = {r.kind for r in BASE}
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = F.filter("spans", lambda x: x["kind"].isin(*sorted(base)))
    return found.select(
        "doc_id",
        *[count(r.kind) for r in BASE],
        F.sha2(F.array_join(F.transform(of_base, named), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", named), ",").alias("spans"),
    )


def _sql() -> str:
    """The query again: each rule's matches and the texts between them, whose lengths add up to places."""
    parts = []
    for order, r in enumerate(RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        value = f"regexp_extract_all(text, {pattern}, {r.value})"
        parts.append(
            f"""SELECT rid, {order} AS o, '{r.kind}' AS kind, {r.least} AS least, unnest(regexp_extract_all(text, {pattern}, 0)) AS m, unnest({value}) AS v,
  unnest(regexp_split_to_array(text, {pattern})[:-2]) AS gap, unnest(range(len({value}))) AS i FROM d WHERE regexp_matches(text, {pattern})"""
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, o ORDER BY i) AS stop FROM f),
s AS (SELECT rid, o, kind, CAST(stop - length(m) AS BIGINT) AS a, kind || ':' || CAST(stop - length(m) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM p WHERE length(v) >= least),
g AS (
  SELECT rid, {counts}, string_agg(span, ',' ORDER BY a, o) AS spans, string_agg(span, ',' ORDER BY a, o) FILTER (WHERE kind IN ({base})) AS base FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


ORACLE = _sql()


def redact_text(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each run of overlapping values replaced by the first one's kind."""
    if not spans:
        return text
    out, at = [], 0
    for start, stop, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the values of all secrets replaced by the name of their kind; an ``n_chars`` column follows the text."""
    import pyarrow as pa

    where = docs.columns.index(text_col)
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        search = _searcher(rules)
        for whole in batches:
            at = 0
            for part in segments(python_rows(whole.select([where])), SEGMENT):
                batch = whole.slice(at, len(part))
                at += len(part)
                texts = [t for (t,) in part]
                chars = batch.column(sized).to_pylist() if sized is not None else []
                for j, spans in enumerate(search.search([t or "" for t in texts])):
                    if spans:
                        texts[j] = redact_text(texts[j], [(c, d, rules[k].kind) for _, k, _, c, d in spans])
                        if sized is not None:
                            chars[j] = len(texts[j])
                columns = list(batch.columns)
                columns[where] = pa.array(texts, batch.schema.field(where).type)
                if sized is not None:
                    columns[sized] = pa.array(chars, batch.schema.field(sized).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
