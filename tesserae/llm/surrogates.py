"""Personal data replaced by surrogates, in DataFrame expressions only.

Entities are found by one pattern. Each is mapped by a keyed cipher that works inside the classes of
its characters: digits become digits, letters letters of the same case and script (vowels stay vowels
and consonants consonants), separators stay, so type, script and format are kept. The cipher runs
over the entity forwards and backwards, each character shifted by a keyed SHA-256 of the characters
already written, and so is one-to-one among strings of a shape; an entity has the same surrogate
wherever it occurs. Card numbers and IBANs that are valid get valid check digits, and IBANs keep their
country. Names are found by their titles; within a document their words are then replaced wherever they
stand, with or without title, each word always by the same one, so that mentions still belong together.
A title stays, and so does a last letter that marks a feminine name; all other letters change.

A collision check looks for surrogates that are themselves entities of the corpus (or equal their own
original) or that two entities share; those entities get surrogates under further keys, then longer
ones, until each is neither an entity nor another's surrogate.

Defined cases: null stays null and empty stays empty; texts without entities are returned unchanged;
repeated rows get equal surrogates; an empty table gives an empty result; further columns pass
through, but for one named ``n_entities``, which is replaced (internal names start with ``_p_``). The key
stands in the query's plan, so plans are as confidential as it is. A name without a title anywhere in its
document isn't found.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.session import cut, hashed_semi

#: type -> pattern. Order matters: the first that matches at a position wins.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "name": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Г-н|Г-жа)\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?",
}
#: All patterns as one. Only word starts are tried, and there only the types that the first character allows.
ANY = (
    r"(?=[+(0-9A-Za-zГ])(?<![0-9A-Za-z])(?:" + PATTERNS["email"] + "|" + PATTERNS["secret"]
    + r"|(?=[+(0-9])(?:" + "|".join(PATTERNS[k] for k in ("ip", "card", "ssn", "phone")) + ")"
    + r"|(?=[A-ZГ])(?:" + PATTERNS["iban"] + "|" + PATTERNS["name"] + "))"
)
TITLE = r"^(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Г-н|Г-жа)\.? "
#: Classes within which characters are shifted.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áàâäéèêëíìîïóòôöúùûü", "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
HEX = "0123456789abcdef"


def _other_letters(most: int = 1000) -> list[str]:
    """Classes of the letters outside ``CLASSES`` by script and case; scripts of ``most`` letters and more (Han, Hangul, Yi) are left out."""
    known, found = set("".join(CLASSES)), defaultdict(list)
    for c in map(chr, range(0x80, 0x10000)):
        kind = unicodedata.category(c)
        if kind[0] == "L" and c not in known:
            found[unicodedata.name(c, "").split(" ")[0].split("-")[0], kind].append(c)
    single = defaultdict(list)
    for (_, kind), letters in found.items():
        if len(letters) == 1:
            single[kind] += letters
    return ["".join(x) for x in [*found.values(), *single.values()] if 1 < len(x) < most]


#: Classes of plain letters and digits, and of digits.
ASCII, DIGITS = CLASSES[:5], CLASSES[:1]
#: Last letters that mark feminine names, and classes for all others.
FEMININE = "aáàâаяα"
LAST = ["".join(c for c in k if c not in FEMININE) for k in CLASSES]
#: Classes that only characters beyond ASCII are looked up in.
OTHER = _other_letters()
#: Further keys tried for an entity whose surrogate is taken before the surrogate is made longer.
KEYS = 4
#: Passes of the cipher: forwards, backwards, forwards.
PASSES = 3


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(entity: str) -> str:
    """SQL for the type of the entity in the SQL expression ``entity``."""
    tests = {"email": "@", "secret": "^[0-9a-f]{32,64}$", "iban": "^[A-Z]{2}[0-9]{2}", "ip": r"^(?:[0-9]+\.){3}[0-9]+$", "card": "^(?:[0-9]{4}[ -]?){3}[0-9]{3,4}$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "phone": r"^[+(0-9]"}
    return "CASE " + " ".join(f"WHEN {entity} RLIKE {_quote(p)} THEN '{k}'" for k, p in tests.items()) + " ELSE 'name' END"


def _hash(key: str, written: str) -> str:
    """SQL: a number from a keyed hash of what is written already."""
    return f"cast(conv(substr(sha2(concat({_quote(key + '|')}, {written}), 256), 1, 15), 16, 10) as bigint)"


def _shifted(c: str, classes: list[str], key: str, written: str, other: list[str]) -> str:
    """SQL: the character ``c`` shifted within its class k."""
    when = lambda ks: " ".join(f"WHEN locate({c}, {_quote(k)}) > 0 THEN {_quote(k)}" for k in ks)
    found = f"CASE {when(classes)}" + (f" WHEN ascii({c}) > 127 THEN CASE {when(other)} END" if other else "") + " END"
    return f"transform(array({found}), k -> CASE WHEN k IS NULL THEN {c} ELSE substr(k, cast(pmod(locate({c}, k) - 1 + {_hash(key, written)}, length(k)) as int) + 1, 1) END)[0]"


def _pass(chars: str, classes: list[str], key: str, other: list[str]) -> str:
    """SQL: the characters in the array ``chars``, each shifted within its class by a keyed hash of those already written."""
    return f"aggregate({chars}, '', (s, c) -> concat(s, {_shifted('c', classes, key, 's', other)}))"


def _cipher(text: str, classes: list[str], key: str, other: list[str] = []) -> str:  # noqa: B006
    for p in range(PASSES):
        text = _pass(f"split({text}, '')", classes, f"{key}/{p}", other)
        if p + 1 < PASSES:
            text = f"reverse({text})"
    return f"reverse({text})" if (PASSES - 1) % 2 else text


def _luhn(body: str) -> str:
    """SQL: the digit that makes the number valid whose other digits are those in ``body``."""
    return f"filter(array('0', '1', '2', '3', '4', '5', '6', '7', '8', '9'), x -> luhn_check(concat(regexp_replace({body}, '[^0-9]', ''), x)))[0]"


def _remainder(chars: str) -> str:
    """SQL: the number that digits and letters (A is 10) stand for, modulo 97."""
    return f"aggregate(split({chars}, ''), 0L, (n, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (n * 10 + cast(c as bigint)) % 97 ELSE (n * 100 + ascii(c) - 55) % 97 END)"


def surrogate(entity: str, key: str) -> str:
    """SQL for the surrogate of the entity (of a name, one word) in the SQL expression ``entity``: one step of the permutation."""
    e = "e"
    name = f"transform(array({_cipher(f'substr({e}, 1, length({e}) - 1)', CLASSES, key + '/name', OTHER)}), p -> concat(p, transform(array(right({e}, 1)), l -> CASE WHEN locate(l, {_quote(FEMININE)}) > 0 THEN l ELSE {_shifted('l', LAST, key + '/last', 'p', OTHER)} END)[0]))[0]"
    host = lambda k: _cipher("h", ASCII, key + k)
    other_host = f"transform(array(regexp_extract({e}, {_quote('@(.*)[.]')}, 1)), h -> transform(array({host('/host')}), g -> CASE WHEN g <> h THEN g ELSE transform(array({host('/host again')}), f -> CASE WHEN f <> h THEN f ELSE concat('x', h) END)[0] END)[0])[0]"
    email = f"concat({_cipher(f'substring_index({e}, {_quote('@')}, 1)', ASCII, key + '/email')}, '@', {other_host}, '.', substring_index({e}, '.', -1))"
    country = f"concat(regexp_extract({e}, {_quote('^[+][0-9]{1,3}(?=[ .(-])')}, 0), {_cipher(f'substr({e}, length(regexp_extract({e}, {_quote('^[+][0-9]{1,3}(?=[ .(-])')}, 0)) + 1)', DIGITS, key + '/phone')})"
    octets = f"array_join(transform(split({e}, '[.]'), (o, k) -> cast(pmod(cast(o as bigint) + {_hash(key + '/ip', f"concat(k, '.', array_join(slice(split({e}, '[.]'), 1, k), '.'))")}, 256L) as string)), '.')"
    card = f"transform(array({_cipher(f'substr({e}, 1, length({e}) - 1)', DIGITS, key + '/card')}), b -> concat(b, {_luhn('b')}))[0]"
    plain = f"replace({e}, ' ', '')"
    check = f"lpad(cast(98 - {_remainder(f"concat(replace(b, ' ', ''), substr({e}, 1, 2), '00')")} as string), 2, '0')"
    iban = f"transform(array({_cipher(f'substr({e}, 5)', ASCII, key + '/iban')}), b -> concat(substr({e}, 1, 2), CASE WHEN {_remainder(f'concat(substr({plain}, 5), substr({plain}, 1, 4))')} = 1 THEN {check} ELSE {_cipher(f'substr({e}, 3, 2)', DIGITS, key + '/check')} END, b))[0]"
    body = (
        f"CASE {kind_of(e)} WHEN 'email' THEN {email} WHEN 'secret' THEN {_cipher(e, [HEX], key + '/secret')} WHEN 'ip' THEN {octets} WHEN 'phone' THEN {country} WHEN 'name' THEN {name} WHEN 'iban' THEN {iban} "
        f"ELSE CASE WHEN {kind_of(e)} = 'card' AND luhn_check(regexp_replace({e}, '[^0-9]', '')) THEN {card} ELSE {_cipher(e, DIGITS, key + '/digits')} END END"
    )
    return f"transform(array({entity}), e -> {body})[0]"


def _words(found: str) -> str:
    """SQL: the words of the name ``found`` without its title."""
    return f"split(regexp_replace({found}, {_quote(TITLE)}, ''), ' ')"


def with_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_p_found``, the entities of each text in order, and ``_p_any``, the pattern that finds them; texts that cannot hold one skip the search.

    The words of titled names are looked for in the whole text.
    """
    name = "`" + text.replace("`", "``") + "`"
    titled = docs.withColumn("_p_found", F.expr(f"CASE WHEN {name} RLIKE '[0-9@]|[^ ]\\\\.? [\\\\p{{Lu}}]' THEN regexp_extract_all({name}, {_quote(ANY)}, 0) ELSE cast(array() AS array<string>) END"))
    titled = titled.withColumn("_p_names", F.expr(f"array_distinct(flatten(transform(filter(_p_found, x -> x RLIKE {_quote(TITLE)}), x -> {_words('x')})))"))
    quoted = "array_join(transform(_p_names, w -> concat('\\\\Q', w, '\\\\E')), '|')"
    letter = r"[\p{L}\p{N}]"
    titled = titled.withColumn("_p_any", F.expr(f"CASE WHEN size(_p_names) > 0 THEN concat({_quote(ANY + '|(?<!' + letter + ')(?:')}, {quoted}, {_quote(')(?!' + letter + ')')}) ELSE {_quote(ANY)} END"))
    return titled.withColumn("_p_found", F.expr(f"CASE WHEN size(_p_names) > 0 THEN regexp_extract_all({name}, _p_any, 0) ELSE _p_found END")).drop("_p_names")


def units(found: str) -> str:
    """SQL: the strings that get surrogates of their own for an entity: the words of a name, else itself."""
    return f"CASE WHEN {kind_of(found)} = 'name' THEN {_words(found)} ELSE array({found}) END"


def entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(entity, kind, surrogate): the distinct entities of the corpus (of names, words), each ciphered once."""
    found = with_entities(docs.select(text), text).select(F.explode("_p_found").alias("found")).distinct()
    single = found.select(F.explode(F.expr(units("found"))).alias("entity")).distinct()
    return single.select("entity", F.expr(kind_of("entity")).alias("kind"), F.expr(surrogate("entity", key)).alias("surrogate"))


def longer(text: str, times: int) -> str:
    """SQL for the surrogate in the SQL expression ``text`` made longer, so that equal results come from equal surrogates only."""
    name, email, digits = (_quote(x * times) for x in ("na", "na", "0"))
    return f"CASE {kind_of(text)} WHEN 'name' THEN concat(substr({text}, 1, length({text}) - 1), {name}, right({text}, 1)) WHEN 'email' THEN concat({email}, {text}) ELSE concat({text}, {digits}) END"


def collisions(table: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate) for entities whose plain surrogate is itself an entity of the corpus or another's surrogate.

    In each round all that are left get a candidate; it counts if it is neither an entity nor a surrogate.
    The candidates outgrow all entities and surrogates in the end, so none is left.
    """
    taken = table.select(F.explode(F.array("entity", "surrogate")).alias("surrogate"))
    twice = table.groupBy("surrogate").agg(F.min("entity").alias("first"), F.count("*").alias("n")).where("n > 1")
    own = table.join(table.select(F.col("entity").alias("surrogate")), "surrogate", "left_semi").select("entity")
    open_ = cut(own.unionByName(table.join(twice, "surrogate").where("entity <> first").select("entity")).distinct())
    done, times = table.select("entity", "surrogate").limit(0), 0
    while not open_.isEmpty():
        times += 1
        new = surrogate("entity", f"{key}/{min(times, KEYS)}")
        tried = open_.select("entity", F.expr(new).alias("surrogate"))
        if times > KEYS:
            tried = tried.select("entity", F.expr(longer("surrogate", 1 << (times - KEYS - 1))).alias("surrogate"))
        tried = cut(tried)
        fits = cut(tried.join(taken, "surrogate", "left_anti").groupBy("surrogate").agg(F.min("entity").alias("entity")).select("entity", "surrogate"))
        done, taken = done.unionByName(fits), taken.unionByName(fits.select("surrogate"))
        open_ = cut(tried.join(fits, "entity", "left_anti").select("entity"))
    return done


def replace(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``n_entities``, the number of replacements.

    Entities are ciphered once in the distinct table for the collision check; where it finds none, the
    texts are rewritten in place without a shuffle. Otherwise only documents that hold a colliding
    entity take part in a join.
    """
    docs = docs.drop("n_entities")
    name = "`" + text.replace("`", "``") + "`"
    exceptions = cut(collisions(cut(entities(docs, key, text)), key))
    found = with_entities(docs, text)

    def rewritten(df: DataFrame, unit: str) -> DataFrame:
        """``unit`` is SQL for the surrogate of the unit u."""
        plain = f"transform(_p_found, x -> concat(CASE WHEN {kind_of('x')} = 'name' THEN regexp_extract(x, {_quote(TITLE)}, 0) ELSE '' END, array_join(transform({units('x')}, u -> {unit}), ' ')))"
        new = f"CASE WHEN size(_p_found) = 0 OR _p_found IS NULL THEN {name} ELSE array_join(zip_with(split({name}, _p_any, -1), {plain}, (gap, s) -> concat(gap, coalesce(s, ''))), '') END"
        return df.withColumn("_p_text", F.expr(new)).withColumn("n_entities", F.coalesce(F.greatest(F.size("_p_found"), F.lit(0)), F.lit(0)).cast("long")).withColumn(text, F.col("_p_text")).select(*docs.columns, "n_entities")

    if exceptions.isEmpty():
        return rewritten(found, surrogate("u", key))
    hit = cut(found.select(doc_id, F.explode("_p_found").alias("found")).distinct().select(doc_id, F.explode(F.expr(units("found"))).alias("entity")).distinct().join(exceptions, "entity").groupBy(doc_id).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_p_map")))
    some, none = hashed_semi(found, doc_id, hit, doc_id)
    changed = some.join(hit, doc_id, "left")
    return rewritten(none, surrogate("u", key)).unionByName(rewritten(changed, f"coalesce(try_element_at(_p_map, u), {surrogate('u', key)})"))
