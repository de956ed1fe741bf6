r"""Surrogates for personal data; DataFrame functions only.

One expression marks the entities of a text, which then is an array of gaps and entities; texts are matched once and staged with
it. Each entity has a kind and a normal form, so that spellings of one entity are one row of the dictionary (coreference over the whole
corpus). The dictionary draws a replacement for each normal form by HMAC-SHA-256 under the caller's key: digits for digits, letters
for letters of the same script, names of the same script and gender. A draw that is a real entity of its kind, or that another entity
holds, is drawn again: only these rows go into the next round, and from attempt ``WIDER`` on the replacement grows,
so that rounds end however full a format is. Occurrences meet the dictionary by normal form and are laid back in the
original's format: separators, letter case, country codes and titles stay; a card number that passes the Luhn check and an
IBAN that passes its check passes it afterwards.

Entities that hold more than one row in 4,096 are dealt over salts by their count; at most 4,096 can, so their list is
broadcast. Texts without an entity are never shuffled, and equal texts are worked on once.

Defined cases: null and empty texts stay; repeated rows are replaced alike; null ids are kept; where several kinds match at a place, the first
of ``KINDS`` wins; no expression repeats a group without bound, so texts of any length and make are matched in linear time and
a stack of bounded depth; of entities that draw the same replacement, the first in order of normal form keeps it; a name is a title followed
by one to three capitalised words, of which the last is the surname, or a given name of ``GIVEN`` and one or two such words, so other
names stay; an empty table gives an empty result; extra columns are kept, and the counts ``n_<kind>`` replace columns of those names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_share, new_folder, stage, table

#: Attempts from which on a replacement is longer than what it replaces.
WIDER = 16

# Titles by gender.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Sr", "Don", "Monsieur", "Signor", "Sir", "Господин", "Г-н", "г-н", "Κύριος", "Κος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Doña", "Madame", "Mademoiselle", "Mme", "Mlle", "Signora", "Lady", "Госпожа", "Г-жа", "г-жа", "Κυρία", "Κα"),
    "n": ("Dr", "Prof", "Mx"),
}
# Common given names by gender, none of which is an everyday word.
GIVEN = {
    "m": ("John", "James", "Robert", "Michael", "David", "William", "Thomas", "Daniel", "Peter", "Paul", "Hans", "Jürgen", "Wolfgang", "Klaus", "Juan", "José", "Carlos", "Luis",
          "Pedro", "Jean", "Pierre", "Jacques", "Giovanni", "Marco", "Mohammed", "Ahmed", "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Γιώργος", "Νίκος"),
    "f": ("Mary", "Maria", "María", "Anna", "Elizabeth", "Jennifer", "Linda", "Barbara", "Susan", "Sarah", "Emily", "Laura", "Carmen", "Sofia", "Lucía", "Marie", "Sophie", "Claire",
          "Petra", "Ursula", "Giulia", "Francesca", "Fatima", "Aisha", "Мария", "Анна", "Ольга", "Елена", "Наталья", "Μαρία", "Ελένη"),
}
# Country calling codes of one and of two digits; all others have three.
CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
# The letters of scripts in their order, by a class that tells the script.
ALPHABETS = (
    (r"\p{IsCyrillic}", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
    (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{IsHan}", "一二三四五六七八九十天地日月山水火木金土"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하"),
    ("", "abcdefghijklmnopqrstuvwxyz"),
)
#: Script, a class that tells it, and consonants, vowels and endings of its made-up names.
SCRIPTS = (
    ("cyrillic", r"\p{IsCyrillic}", "бвгдзклмнпрст", "аеиоу", {"m": "р", "f": "на", "n": "ло", "s": "вич"}),
    ("greek", r"\p{IsGreek}", "βγδζκλμνπρστ", "αειου", {"m": "ρος", "f": "να", "n": "λι", "s": "δης"}),
    ("latin", "", "bdfgklmnprstvz", "aeiou", {"m": "ron", "f": "na", "n": "li", "s": "sen"}),
)


def _longest_first(groups: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({w for group in groups.values() for w in group}, key=lambda w: (-len(w), w))


def _begins(words: list[str]) -> str:
    """A look-ahead that most places fail at their first letter."""
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])"


_TITLES, _GIVEN = _longest_first(TITLES), _longest_first(GIVEN)
_CAPITAL = r" \p{Lu}[\p{L}'’-]++"
_TITLED = rf"(?:{'|'.join(_TITLES)})\.?(?:{_CAPITAL}){{1,3}}"
_NAMED = rf"(?:{'|'.join(_GIVEN)})(?:{_CAPITAL}){{1,2}}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_END = r"(?![\p{L}\p{N}])"
#: Kinds in order of preference where several match at one place, each after a place without a letter or number before it.
KINDS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,127}\p{L}{2,24}",
    "iban": rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}",
    "ipv4": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    "card": rf"(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_END}",
    "phone": rf"(?:(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})[ .-][0-9]{{3,4}}[ .-][0-9]{{3,4}}|\+[0-9]{{1,3}}[ .-]?[0-9]{{6,12}}){_END}",
    "name": rf"{_begins(_TITLES + _GIVEN)}(?:{_TITLED}|{_NAMED})",
}
_START = r"(?<![\p{L}\p{N}])"
ANY = f"{_START}(?:{'|'.join(f'(?:{p})' for p in KINDS.values())})"
#: Texts without any of these hold no entity; most texts end here.
QUICK = rf"[0-9@]|{_START}{_begins(_TITLES + _GIVEN)}(?:{'|'.join(_TITLES + _GIVEN)})\.? \p{{Lu}}"

#: A mark around entities; the same character in a text is doubled by another control character, which no expression tells from it.
_MARK, _OWN, _SPELLED = "\x01\x03", "\x01", "\x01\x02"
PARTS, TID, PIECES = "_loomlog_parts", "_loomlog_tid", "_loomlog_pieces"


# --- draws ---------------------------------------------------------------------------------------


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 as lower-case hex."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _byte(i: str) -> str:
    return f"cast(conv(substring(h, 2 * pmod({i}, 60) + 1, 2), 16, 10) as int)"


def _shape(x: str) -> str:
    """``x`` with digits for digits and letters for letters of the same script and case, drawn from ``h``."""
    letter = "case"
    for cls, letters in ALPHABETS:
        drawn = f"substring('{letters}', pmod({_byte('i')}, {len(letters)}) + 1, 1)"
        letter += f" when c rlike '{cls.replace(chr(92), chr(92) * 2)}' then {drawn}" if cls else f" else {drawn} end"
    return (
        f"array_join(transform(split({x}, ''), (c, i) -> case when c between '0' and '9' then cast(pmod({_byte('i')}, 10) as string)"
        f" when not c rlike '\\\\p{{L}}' then c when c = upper(c) and c <> lower(c) then upper({letter}) else {letter} end), '')"
    )


def _luhn(x: str) -> str:
    """The Luhn sum of a string of digits, modulo 10."""
    digit = f"cast(substring({x}, length({x}) - i, 1) as int)"
    return (
        f"pmod(aggregate(transform(sequence(0, length({x}) - 1), i -> case when i % 2 = 0 then {digit}"
        f" when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end), 0, (a, d) -> a + d), 10)"
    )


def _mod97(x: str) -> str:
    """The remainder by 97 of a string of digits and capitals, which stand for 10 to 35."""
    return f"aggregate(split({x}, ''), 0, (a, c) -> case when c between '0' and '9' then pmod(a * 10 + cast(c as int), 97) else pmod(a * 100 + ascii(c) - 55, 97) end)"


def _name(ending: str) -> str:
    """A made-up name of the row's script, longer with every second attempt."""
    out = "case script"
    for script, _, consonants, vowels, endings in SCRIPTS:
        syllables = ", ".join(f"'{c}{v}'" for c in consonants for v in vowels)
        count = len(consonants) * len(vowels)
        drawn = (
            f"array_join(transform(sequence(1, 3 + cast(attempt div 2 as int)), i -> element_at(array({syllables}),"
            f" pmod(cast(conv(substring(h, 4 * pmod(i, 30) + 1, 4), 16, 10) as int), {count}) + 1)), '')"
        )
        tail = f"case {ending} " + " ".join(f"when '{g}' then '{e}'" for g, e in endings.items()) + " end"
        out += f" when '{script}' then concat({drawn}, {tail})"
    return out + " end"


def _draw() -> str:
    """The replacement of a row of the dictionary: kind, norm, gender, script, attempt, h, d (hash of an e-mail's domain)."""
    wider = f"repeat('0', greatest(0, attempt - {WIDER - 1}))"
    local = f"concat(split(norm, '@')[0], {wider})"
    domain = "regexp_extract(norm, '@(.*)[.][^.]+$', 1)"
    top = "regexp_extract(norm, '([.][^.]+)$', 1)"
    octets = ", ".join(f"cast(1 + pmod({_byte(str(i))}, 254) as string)" for i in range(4))
    body = f"concat(substring(norm, 1, length(norm) - 1), {wider})"
    checked = f"concat({_shape(body)}, cast(pmod(10 - {_luhn(f'concat({_shape(body)}, 0)')}, 10) as string))"
    account = _shape(f"concat(substring(norm, 5), {wider})")
    check = f"lpad(cast(98 - {_mod97(f'''concat({account}, substring(norm, 1, 2), '00')''')} as string), 2, '0')"
    valid = f"{_mod97('concat(substring(norm, 5), substring(norm, 1, 4))')} = 1"
    return f"""case kind
      when 'email' then concat({_shape(local)}, '@', {_shape(domain).replace('(h,', '(d,')}, {top})
      when 'ipv4' then concat(concat_ws('.', {octets}), case when attempt >= {WIDER} then concat('.', {_shape(wider)}) else '' end)
      when 'iban' then concat(substring(norm, 1, 2), case when {valid} then {check} else {_shape("substring(norm, 3, 2)")} end, {account})
      when 'phone' then concat(split(norm, '[.]')[0], '.', {_shape(f"concat(split(norm, '[.]')[1], {wider})")})
      when 'card' then case when {_luhn('norm')} = 0 then {checked} else {_shape(f"concat(norm, {wider})")} end
      when 'ssn' then {_shape(f"concat(norm, {wider})")}
      when 'given' then {_name('gender')}
      when 'surname' then {_name("'s'")} end"""


# --- entities ------------------------------------------------------------------------------------


def marked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``PARTS``, gaps and entities in turn, and ``TID``, a key of the text; both null without an entity.

    Where a text has entities, it is in its parts, and its own column is null.
    """
    text = F.col(f"`{text_col}`")
    quick = F.coalesce(text.rlike(QUICK), F.lit(False))
    spelled = F.replace(text, F.lit(_OWN), F.lit(_SPELLED))
    parts = F.split(F.regexp_replace(spelled, f"({ANY})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    found = docs.withColumn(text_col, text.cast("string")).withColumn(PARTS, F.when(quick, parts))
    found = found.withColumn(PARTS, F.when(F.size(PARTS) > 1, F.col(PARTS)))
    has = F.col(PARTS).isNotNull()
    found = found.withColumn(TID, F.when(has, F.md5(text.cast("binary"))))
    return found.withColumn(text_col, F.when(~has, text))


def occurrences(carriers: DataFrame) -> DataFrame:
    """``(tid, pos, sub, token, kind, norm, gender, script)`` of each token of the entities in ``(tid, entities)``; names have one for each word."""
    found = carriers.select("tid", F.posexplode("entities").alias("pos", "entity"))
    kind = reduce(
        lambda other, k: F.when(F.col("entity").rlike(rf"^(?:{KINDS[k]})$"), F.lit(k)).otherwise(other), reversed([k for k in KINDS if k != "name"]), F.lit("name")
    )
    found = found.withColumn("of", kind)
    tokens = F.when(F.col("of") == "name", F.split("entity", " ")).otherwise(F.array("entity"))
    found = found.withColumn("tokens", tokens).select("tid", "pos", "of", "tokens", F.posexplode("tokens").alias("sub", "token"))
    first = F.regexp_replace(F.element_at("tokens", 1), r"\.$", "")
    titled = first.isin(*_TITLES)
    gender = F.lit("n")
    for g in ("f", "m"):
        gender = F.when(F.when(titled, first.isin(*TITLES[g])).otherwise(first.isin(*GIVEN[g])), g).otherwise(gender)
    last = F.col("sub") == F.size("tokens") - 1
    kind = F.when(F.col("of") != "name", F.col("of")).when((F.col("sub") == 0) & titled, "title").when(last, "surname").otherwise("given")
    digits = F.regexp_replace("token", "[^0-9]", "")
    code = F.when(F.col("token").startswith("+"), F.regexp_extract(digits, f"^(?:{CODES}|[0-9]{{3}})", 0)).otherwise("")
    norm = (
        F.when(F.col("of") == "phone", F.concat(code, F.lit("."), F.substring(digits, F.length(code) + 1, F.length(digits))))
        .when(F.col("of").isin("card", "ssn"), digits)
        .when(F.col("of") == "iban", F.replace("token", F.lit(" "), F.lit("")))
        .otherwise(F.lower("token"))
    )
    script = F.lit("latin")
    for name, letters, *_ in SCRIPTS:
        if letters:
            script = F.when(F.col("token").rlike(letters), name).otherwise(script)
    return found.select("tid", "pos", "sub", "token", kind.alias("kind"), norm.alias("norm"), gender.alias("gender"), script.alias("script"))


def entities(found: DataFrame) -> DataFrame:
    """``(kind, norm, gender, script, n)`` of the distinct entities and how many occurrences each has. A name with both genders has none."""
    male, female = F.max(F.col("gender") == "m"), F.max(F.col("gender") == "f")
    gender = F.when(male & ~female, "m").when(female & ~male, "f").otherwise("n")
    return found.where("kind <> 'title'").groupBy("kind", "norm").agg(gender.alias("gender"), F.min("script").alias("script"), F.count(F.lit(1)).alias("n"))


def dictionary(known: DataFrame, key: bytes, folder: str) -> DataFrame:
    """``(kind, norm, surrogate)``: distinct replacements of the distinct entities, none of them a real entity.

    A round claims replacements: real entities and those settled before come first, then the round's draws in order of normal
    form. Each claim goes to the first; those that lose draw again.
    """
    place = ["kind", "surrogate"]

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        def block(salt: str, *cols) -> Column:
            seed = F.concat_ws("\u001f", F.lit(salt), *cols)
            return F.concat(hmac_sha256(key, seed), hmac_sha256(key, F.concat(seed, F.lit("+"))))

        rows = rows.withColumn("attempt", F.lit(attempt)).withColumn("h", block("entity", F.col("kind"), F.col("norm"), F.lit(str(attempt))))
        rows = rows.withColumn("d", block("domain", F.regexp_extract("norm", "@(.*)$", 1)))
        return rows.withColumn("surrogate", F.expr(_draw())).drop("h", "d", "attempt")

    real = known.select("kind", F.col("norm").alias("surrogate"))
    pending, settled, attempt = known.select("kind", "norm", "gender", "script"), None, 0
    while attempt == 0 or not pending.isEmpty():
        draws = stage(drawn(pending, attempt), f"draws-{attempt}", folder)
        taken = real if settled is None else real.unionByName(settled.select(*place)).join(draws.select(*place), place, "left_semi")
        claims = taken.select(*place, F.struct(F.lit(0).alias("rank"), F.lit("").alias("norm")).alias("by"))
        claims = claims.unionByName(draws.select(*place, F.struct(F.lit(1).alias("rank"), F.col("norm")).alias("by")))
        won = claims.groupBy(*place).agg(F.min("by").alias("by")).where("by.rank = 1").select("kind", F.col("by.norm").alias("norm"), "surrogate")
        won = stage(won, f"won-{attempt}", folder)
        settled = won if settled is None else settled.unionByName(won)
        pending = draws.drop("surrogate").join(won.select("kind", "norm"), ["kind", "norm"], "left_anti")
        attempt += 1
    return settled


# --- replacing -----------------------------------------------------------------------------------

#: A token in its own format: separators stay, letters and digits come from the replacement in order, and what is left over follows.
LAID = """aggregate(split(token, ''), named_struct('out', '', 'k', 0), (a, c) ->
  case when c rlike '[0-9A-Za-z]' then named_struct('out', concat(a.out, substring(replace(surrogate, '.', ''), a.k + 1, 1)), 'k', a.k + 1)
       else named_struct('out', concat(a.out, c), 'k', a.k) end, a -> concat(a.out, substring(replace(surrogate, '.', ''), a.k + 1)))"""
CASED = """case when token = upper(token) and length(token) > 1 then upper(surrogate)
  when substring(token, 1, 1) = upper(substring(token, 1, 1)) then concat(upper(substring(surrogate, 1, 1)), substring(surrogate, 2))
  else surrogate end"""
#: An e-mail address, before and after the @, with capitals where the token has them.
_SPELLED_AS = """array_join(transform(split(split(surrogate, '@')[{n}], ''), (c, i) ->
  case when substring(split(token, '@')[{n}], i + 1, 1) <> lower(substring(split(token, '@')[{n}], i + 1, 1)) then upper(c) else c end), '')"""
MAIL = f"concat({_SPELLED_AS.format(n=0)}, '@', {_SPELLED_AS.format(n=1)})"


def replace_personal_data(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and the counts ``n_<kind>``. Equal keys give equal surrogates; keep the key secret."""
    folder = new_folder(docs.sparkSession, "surrogates")
    counts = [f"n_{k}" for k in KINDS]
    kept = [c for c in docs.columns if c not in counts]
    frame = stage(marked(docs.select(*[F.col(f"`{c}`") for c in kept]), text_col), "marked", folder)
    has = F.col(PARTS).isNotNull()

    inside = F.filter(PARTS, lambda x, i: i % 2 == 1)
    carriers = frame.where(has).select(F.col(TID).alias("tid"), inside.alias("entities")).dropDuplicates(["tid"])
    found = stage(occurrences(carriers), "occurrences", folder)
    known = stage(entities(found), "entities", folder)
    names = dictionary(known, key, folder)

    # An entity may stand in a third of all texts: such ones are dealt over salts, the more the more they hold.
    share = hot_share(known.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar())
    hot = known.withColumn("share", share).where("n > share").select("kind", "norm", F.ceil(F.col("n") / F.col("share")).cast("int").alias("salts"))
    hot = F.broadcast(stage(hot, "hot", folder))
    one = F.coalesce("salts", F.lit(1))
    salted = found.join(hot, ["kind", "norm"], "left").withColumn("salt", F.pmod(F.xxhash64("tid"), one).cast("int")).drop("salts")
    spread = names.join(hot, ["kind", "norm"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")

    laid = F.when(F.col("surrogate").isNull(), F.col("token"))
    laid = laid.when(F.col("kind").isin("phone", "card", "ssn", "iban"), F.expr(LAID)).when(F.col("kind") == "email", F.expr(MAIL))
    laid = laid.when(F.col("kind").isin("given", "surname"), F.expr(CASED)).otherwise(F.col("surrogate"))
    placed = salted.join(spread, ["kind", "norm", "salt"], "left").select("tid", "pos", "sub", "kind", laid.alias("piece"))
    of_kind = [F.sum(F.when(F.col("kind") == ("surname" if k == "name" else k), 1).otherwise(0)).alias(f"n_{k}") for k in KINDS]
    entity = placed.groupBy("tid", "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sub", "piece"))), lambda x: x["piece"]), " ").alias("piece"), *of_kind
    )
    pieces = entity.groupBy("tid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]).alias(PIECES), *[F.sum(c).alias(c) for c in counts]
    )
    pieces = stage(pieces.withColumnRenamed("tid", TID), "pieces", folder)

    touched = frame.where(has).join(pieces, TID)
    rebuilt = F.array_join(
        F.transform(PARTS, lambda x, i: F.when(i % 2 == 1, F.get(F.col(PIECES), (i / 2).cast("int"))).otherwise(F.replace(x, F.lit(_SPELLED), F.lit(_OWN)))), ""
    )
    touched = touched.select(*[rebuilt.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], *[F.col(c).cast("long").alias(c) for c in counts])
    clean = frame.where(~has).select(*[F.col(f"`{c}`") for c in kept], *[F.lit(0).cast("long").alias(c) for c in counts])
    return clean.unionByName(touched)


#: The key of the registered query alone, whose result must be the same each time; ``replace_personal_data`` has none of its own.
QUERY_KEY = b"the registered query's key, no secret"


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
