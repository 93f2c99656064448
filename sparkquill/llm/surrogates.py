"""Operator 8: keyed surrogates for personal data.

Entities are found by one pattern: e-mail and IPv4 addresses, payment cards of 15 and 16 digits and IBANs (by their check digits, so that other numbers stay), US social security numbers, phone numbers, access keys,
named secrets, long hexadecimal tokens, and names after one or more forms of address: any number of words, with initials, particles, apostrophes, hyphens and inner capitals, or all in capitals. Each gets a surrogate of its own type, drawn from the
caller's key, the type and the entity's canonical form: letters become letters, digits digits, case and punctuation stay; cards keep
their first digit (those of 15 digits two) and a valid check digit, IBANs their country, layout and valid check digits; addresses keep valid octets. The canonical form drops what only varies in writing
(case of addresses, punctuation of numbers), so one entity has one surrogate in every document and spelling.

Names are replaced word by word, so that "Mr John Miller" and "Mr Miller" keep their surname in common: each distinct word gets
syllables of its own script and, as a given name, an ending of the gender that the forms of address before it show in most
cases (where they show none, of its last letter). Capital and small letters don't tell words apart, and the surrogate is written as the word is. Particles stay; initials
are rotated by a keyed number of places in their alphabet, so that distinct ones stay distinct.

Coreference: within a document, the words of a found name are entities wherever they stand as capitalised words, with or without a form of
address, and get the surrogates that they have in the name. Names that never follow a form of address in their document aren't found.

Collision check: all distinct entities and words and their surrogates are compared; where two of a type share a surrogate, or a
surrogate is itself an entity of the input, all but the first draw again. From the third draw on names, mail addresses and
secrets grow by a letter or syllable a draw, so the space they draw from outgrows any input. Types of fixed length can't grow: if one is
so full that MOST_DRAWS draws don't settle it, an error names it.

Null texts stay null. Texts without entities stay as they are, byte for byte. Rows are changed one by one, so repeated rows
stay equal. An empty table gives an empty table. Other columns are kept; only `text` is replaced. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquill.llm._stage import drop_staged, salted_lookup, staged

MOST_DRAWS = 60

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TITLES_MALE = ["Mr", "Herr", "Monsieur", "Señor", "Signor", "Mister", "Господин"]
TITLES_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Señorita", "Signora", "Госпожа"]
TITLES_ANY = ["Dr", "Prof", "Доктор"]
#: Forms of address that are abbreviations of other things too when they are in capitals.
NOT_IN_CAPITALS = ["Ms", "Mme"]


def _one_of(words: list[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_TITLE = _one_of(TITLES_MALE + TITLES_FEMALE + TITLES_ANY)
_LOUD_TITLE = _one_of([t.upper() for t in TITLES_MALE + TITLES_FEMALE + TITLES_ANY if t not in NOT_IN_CAPITALS])
PARTICLES = ["de", "del", "della", "di", "da", "das", "do", "dos", "du", "des", "la", "le", "las", "los", "van", "von", "vom", "zu", "zum", "zur", "der", "den", "ten", "ter", "bin", "ibn", "al", "el", "af", "av"]
_PARTICLE = _one_of(PARTICLES)
#: A word of a name: an initial before another word, or a capital and letters, with apostrophes before a capital or two letters.
_WORD = rf"(?!(?:{_TITLE}|{_LOUD_TITLE})(?!\p{{L}}))\p{{Lu}}(?:\.(?=[ \-]\p{{Lu}})|['’]\p{{Lu}}[\p{{L}}\p{{M}}]++|[\p{{L}}\p{{M}}]++)(?:['’](?=\p{{Lu}}|\p{{L}}{{2}})[\p{{L}}\p{{M}}]++)*+"
_LOUD_WORD = rf"(?!(?:{_LOUD_TITLE})(?!\p{{L}}))\p{{Lu}}(?:\.(?=[ \-]\p{{Lu}})|(?:['’]?\p{{Lu}})++)(?!\p{{L}})"
_NAMES = {
    t: rf"(?:(?:{t})\.? )++(?:(?:{_PARTICLE}) )*+{w}(?:[ \-](?:(?:{_PARTICLE})[ \-])*{w})*+" for t, w in ((_TITLE, _WORD), (_LOUD_TITLE, _LOUD_WORD))
}
#: Lengths of IBANs by country (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU", 21: "CH HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBAN = "|".join(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

#: Type and pattern, most specific first. Possessive quantifiers and look-behinds keep the search linear.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"),
    ("secret", r"(?<![A-Za-z])(?:[Tt]oken|TOKEN|[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Aa]pi[_\-]?[Kk]ey|API_KEY) ?[=:] ?[\"']?[A-Za-z0-9+/_\-]{8,}+"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("hex", r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"),
    ("ip", rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"),
    ("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])"),
    ("card", r"(?<!\d)(?<!\d[ \-])(?:[3-6]\d{3}(?:[ \-]?\d{4}){3}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?![ \-]?\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"),
    ("phone", r"(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?![\d])"),
    ("name", rf"(?<!\p{{L}})(?=[MHSFDPГД])(?:{_NAMES[_TITLE]}|{_NAMES[_LOUD_TITLE]})"),
]
PATTERN = "|".join(p for _, p in PATTERNS)
#: Families of types, in the order of PATTERNS, with what every text with an entity of the family must hold.
FAMILIES = [
    (["email"], lambda text: F.contains(text, F.lit("@"))),
    (["secret", "key", "hex"], lambda text: text.rlike(r"(?=[TtPpSsAa])(?:(?:[Tt]oken|TOKEN|[Pp]assw(?:or)?d|PASSWORD|[Ss]ecret|SECRET|[Aa]pi[_\-]?[Kk]ey|API_KEY) ?[=:]|A[KS]IA)|[0-9a-f]{32}")),
    (["ip", "iban", "card", "ssn", "phone"], lambda text: text.rlike(r"\+\d|\d[\d .\-()]{6}")),
    (["name"], lambda text: text.rlike(rf"(?=[MHSFDPГД])(?:{_TITLE}|{_LOUD_TITLE})\.? \p{{L}}")),
]

NAMES_BIT = len(FAMILIES) - 1

_SYLLABLES = {
    "latin": ["ba", "ber", "ca", "da", "del", "e", "fa", "gar", "ha", "in", "jo", "ka", "lan", "le", "ma", "mir", "na", "nor", "o", "pe", "ra", "ros", "sa", "sel", "ta", "tor", "u", "va", "vin", "wa", "xan", "zo"],
    "cyrillic": ["ба", "вер", "га", "да", "ел", "жи", "за", "ив", "ка", "ла", "ми", "на", "о", "пе", "ра", "си", "та", "ул", "фи", "ха", "че", "ша", "эл", "ю", "яр", "бор", "дан", "лев", "мар", "ник", "рос", "сла"],
}
_ENDINGS = {
    ("latin", "male"): ["n", "s", "k", "rd"], ("latin", "female"): ["na", "la", "ria", "ssa"], ("latin", "none"): ["er", "ing", "ow", "man"],
    ("cyrillic", "male"): ["н", "с", "м", "р"], ("cyrillic", "female"): ["на", "ля", "рия", "са"], ("cyrillic", "none"): ["ин", "ов", "ев", "ын"],
}


def families(text: Column) -> Column:
    """Bit i is set where the text can have entities of the i-th family."""
    mask = F.lit(0)
    for i, (_, hint) in enumerate(FAMILIES):
        mask = mask + F.when(hint(text), F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def entities(text: Column, mask: Column) -> Column:
    """All entities of a text in order. Only the alternatives of the families in `mask` are tried: the others can't match."""
    out = F.array().cast("array<string>")
    for wanted in range(1, 1 << len(FAMILIES)):
        names = [n for i, (kinds, _) in enumerate(FAMILIES) if wanted >> i & 1 for n in kinds]
        pattern = "|".join(p for n, p in PATTERNS if n in names)
        out = F.when(mask == wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(out)
    return out


def kind(entity: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(PATTERNS):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def canonical(name: Column, entity: Column) -> Column:
    """What two spellings of one entity have in common."""
    digits = _digits(entity)
    return (
        F.when(name == "email", F.lower(entity))
        .when(name == "secret", F.regexp_replace(entity, r"^[A-Za-z_\-]+ ?[=:] ?[\"']?", ""))
        .when(name == "phone", F.when(F.length(digits) > 10, F.substr(digits, F.length(digits) - 9)).otherwise(digits))
        .when(name.isin("card", "ssn"), digits)
        .when(name == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(name == "word", F.lower(entity))
        .otherwise(entity)
    )


def _stream(seed: Column) -> Column:
    """128 hexadecimal digits from the key, for as many draws of 16 bits."""
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}|"), seed), 256) for i in range(3)])


def _draw(stream: Column, k: Column, modulus: int | Column) -> Column:
    """The k-th draw (from 0), taken cyclically from the stream with its position mixed in."""
    at = F.pmod(k * 3, F.lit(186)) + 1
    return F.pmod(F.conv(F.substr(stream, at, F.lit(6)), 16, 10).cast("long") + k, F.lit(modulus) if isinstance(modulus, int) else modulus).cast("int")


def _pick(letters: str | list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in letters]), index)


def _shaped(text: Column, stream: Column, hexadecimal: Column | None = None) -> Column:
    """Digits for digits, letters for letters of the same case (hexadecimal ones where asked for), anything else as it is."""
    base = 6 if hexadecimal is not None else 26

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.between("0", "9"), _draw(stream, i, 10).cast("string"))
            .when(c.between("a", "z"), F.char(F.lit(97) + _draw(stream, i, base)))
            .when(c.between("A", "Z"), F.char(F.lit(65) + _draw(stream, i, base)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _numbered(entity: Column, stream: Column, first: Column) -> Column:
    """Digits replaced by draws counted from the right (so that every spelling gets the same), from the digit number `first` on."""
    chars = F.split(entity, "")
    count = F.length(_digits(entity))

    def one(c: Column, i: Column) -> Column:
        left = F.length(_digits(F.substr(entity, F.lit(1), i + 1)))
        place = count - left
        drawn = _draw(stream, place, 10)
        # area and exchange codes of ten digits don't begin with 0 or 1
        return F.when(~c.between("0", "9") | (left <= first), c).when(place.isin(6, 9) & ~c.isin("0", "1"), (F.lit(2) + _draw(stream, place, 8)).cast("string")).otherwise(drawn.cast("string"))

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check rule over all digits but the last."""
    body = F.reverse(F.substr(digits, F.lit(1), F.length(digits) - 1))
    return F.aggregate(
        F.transform(F.split(body, ""), lambda c, i: F.when(i % 2 == 1, F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(2 * F.coalesce(c.try_cast("int"), F.lit(0)) - F.when(c >= "5", 9).otherwise(0))),
        F.lit(0),
        lambda acc, v: acc + v,
    )


def _card(entity: Column, stream: Column) -> Column:
    drawn = _numbered(entity, stream, F.when(F.length(_digits(entity)) == 15, 2).otherwise(1))
    check = F.pmod(10 - F.pmod(_luhn(_digits(drawn)), F.lit(10)), F.lit(10)).cast("string")
    return F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), check)


def _mod97(compact: Column) -> Column:
    """An account number's remainder by 97, its first four characters taken last and letters read as 10 to 35."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.pmod(acc * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _iban(entity: Column, stream: Column) -> Column:
    """Country and layout stay, the rest is drawn, and the check digits are made to fit."""
    compact = F.replace(entity, F.lit(" "), F.lit(""))
    drawn = _shaped(F.substr(compact, F.lit(5)), stream)
    country = F.substr(compact, F.lit(1), F.lit(2))
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), drawn))).cast("string"), 2, "0")
    new = F.concat(country, check, drawn)

    def one(c: Column, i: Column) -> Column:
        return F.when(c == " ", c).otherwise(F.substr(new, F.length(F.replace(F.substr(entity, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def is_entity(found: Column) -> Column:
    """Whether what the pattern found is an entity: a number of 15 or 16 digits is a card, and an account number an IBAN, only if the check digits are right."""
    digits = _digits(found)
    card = F.length(digits).isin(15, 16) & found.rlike(r"^[3-6][\d \-]+$")
    iban = found.rlike(rf"^(?:{_IBAN})$")
    return F.when(card, F.pmod(_luhn(digits) + F.right(digits, F.lit(1)).try_cast("int"), F.lit(10)) == 0).when(iban, _mod97(F.replace(found, F.lit(" "), F.lit(""))) == 1).otherwise(F.lit(True))


def _grown(attempt: Column, stream: Column) -> Column:
    """A letter for each draw from the third on."""
    more = F.greatest(attempt - 1, F.lit(0))
    return F.when(more == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.char(F.lit(97) + _draw(stream, 40 + i, 26))), ""))


def _name_word(word: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """Syllables of the word's script, one more for each draw from the third on, and an ending of the gender."""
    last = F.sequence(F.lit(0), 2 + F.greatest(attempt - 1, F.lit(0)))

    def built(script: str) -> Column:
        syllables = _SYLLABLES[script]
        stem = F.array_join(F.transform(last, lambda j: _pick(syllables, _draw(stream, j, len(syllables)))), "")
        ending = F.lit(None).cast("string")
        for sex in ("male", "female", "none"):
            ending = F.when(gender == sex, _pick(_ENDINGS[script, sex], _draw(stream, F.lit(50), 4))).otherwise(ending)
        tail = F.when((gender == "none") & word.rlike("[ая]$"), F.lit("а")).otherwise(F.lit("")) if script == "cyrillic" else F.lit("")
        return F.initcap(F.concat(stem, ending, tail))

    return F.when(word.rlike("\\p{IsCyrillic}"), built("cyrillic")).otherwise(built("latin"))


def surrogate(entity: Column, attempt: Column, key: str) -> Column:
    """The replacement of one entity that isn't a name; `attempt` counts the draws before it."""
    name = kind(entity)
    return _surrogate(entity, name, _stream(F.concat_ws("|", F.lit(key), name, attempt.cast("string"), canonical(name, entity))), attempt, F.lit("none"))


def _surrogate(entity: Column, name: Column, stream: Column, attempt: Column, gender: Column) -> Column:
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (1 + _draw(stream, k, 254)).cast("string")), ".")
    local = F.substring_index(entity, "@", 1)
    top = F.substring_index(entity, ".", -1)
    host = F.substr(entity, F.length(local) + 1, F.length(entity) - F.length(local) - F.length(top))
    shaped = _shaped(F.concat(local, host), stream)
    prefix = F.regexp_extract(entity, r"^([A-Za-z_\-]+ ?[=:] ?[\"']?)", 1)
    value = F.substr(entity, F.length(prefix) + 1)
    return (
        F.when(name == "email", F.concat(F.substr(shaped, F.lit(1), F.length(local)), _grown(attempt, stream), F.substr(shaped, F.length(local) + 1), top))
        .when(name == "secret", F.concat(prefix, F.when(value.rlike("^[0-9a-f]+$"), _shaped(value, stream, F.lit(True))).otherwise(_shaped(value, stream)), _grown(attempt, stream)))
        .when(name == "key", F.concat(F.substr(entity, F.lit(1), F.lit(4)), _shaped(F.substr(entity, F.lit(5)), stream)))
        .when(name == "hex", _shaped(entity, stream, F.lit(True)))
        .when(name == "ip", octets)
        .when(name == "card", _card(entity, stream))
        .when(name == "iban", _iban(entity, stream))
        .when(name == "phone", _numbered(entity, stream, F.greatest(F.lit(0), F.length(_digits(entity)) - 10)))
        .when(name == "word", _name_word(entity, gender, stream, attempt))
        .otherwise(_numbered(entity, stream, F.lit(0)))
    )


def _drawn(found: DataFrame, key: str) -> DataFrame:
    """Columns entity, name, gender and attempt, with canonical and the surrogate (each step its own column, so that it's computed once)."""
    return (
        found.withColumn("canonical", canonical(F.col("name"), F.col("entity")))
        .withColumn("stream", _stream(F.concat_ws("|", F.lit(key), "name", F.col("attempt").cast("string"), "canonical")))
        .withColumn("surrogate", _surrogate(F.col("entity"), F.col("name"), F.col("stream"), F.col("attempt"), F.col("gender")))
        .withColumn("new_canonical", canonical(F.col("name"), F.col("surrogate")))
        .drop("stream")
    )


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """entity, name, surrogate for distinct entities and words of names (entity, name: the type, gender): no two canonical forms of a
    type share a surrogate, and no surrogate is an entity of the input. The table is staged."""
    table = staged(_drawn(found.select("entity", "name", "gender", F.lit(0).alias("attempt")), key), "surrogates")
    while True:
        forms = table.select("name", "canonical", "new_canonical").distinct()
        taken = forms.groupBy("name", "new_canonical").agg(F.min("canonical").alias("owner"), F.count("*").alias("n")).filter("n > 1")
        clash = forms.join(taken, ["name", "new_canonical"]).filter("canonical <> owner").select("name", "canonical")
        known = table.select("name", F.col("canonical").alias("new_canonical")).distinct()
        clash = staged(clash.union(forms.join(known, ["name", "new_canonical"], "left_semi").select("name", "canonical")).distinct(), "clashes")
        if clash.isEmpty():
            drop_staged(clash)
            return table
        redrawn = table.join(clash, ["name", "canonical"], "left_semi")
        full = redrawn.filter(F.col("attempt") >= MOST_DRAWS).select("name").first()
        if full is not None:
            raise RuntimeError(f"{MOST_DRAWS} draws found no free surrogates of type {full[0]}: the input fills its form")
        again = _drawn(redrawn.select("entity", "name", "gender", (F.col("attempt") + 1).alias("attempt")), key)
        rest = table.join(clash, ["name", "canonical"], "left_anti")
        old, table = table, staged(rest.unionByName(again.select(*rest.columns)), "surrogates")
        drop_staged(old, clash)


def _name_parts(names: DataFrame) -> DataFrame:
    """entity (a name after forms of address, or a word of one) -> entity, title, signs between the words, and each word: at, written, word (lower case; null for initials and particles)."""
    title = F.regexp_extract("entity", rf"^((?:(?:{_TITLE}|{_LOUD_TITLE})\.? )*)", 1)
    rows = names.select("entity", title.alias("title")).withColumn("rest", F.substr("entity", F.length("title") + 1))
    rows = rows.withColumn("words", F.split("rest", "[ \\-]")).withColumn("signs", F.regexp_extract_all("rest", F.lit("[ \\-]"), F.lit(0)))
    parts = rows.select("entity", "title", "signs", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "written"))
    return parts.withColumn("word", F.when(_named(F.col("written")), F.lower("written")))


def _named(word: Column) -> Column:
    """Whether a word of a name is neither an initial nor a particle."""
    return word.rlike(r"^\p{Lu}") & ~word.endswith(".")


def _genders(parts: DataFrame) -> DataFrame:
    """word, gender, n_parts of each distinct word: as a given name (the first of several words) it has a gender, else none."""
    titles = F.split(F.upper(F.replace("title", F.lit("."), F.lit(""))), " ")
    male, female = (F.arrays_overlap(titles, F.array(*[F.lit(t.upper()) for t in names])) for names in (TITLES_MALE, TITLES_FEMALE))
    given = (F.col("at") == 0) & (F.col("n_words") > 1)
    seen = parts.filter("word IS NOT NULL").groupBy("word").agg(F.count_if(given).alias("g"), F.count_if(given & male).alias("m"), F.count_if(given & female).alias("f"), F.count("*").alias("n_parts"))
    woman = (F.col("f") > F.col("m")) | ((F.col("f") == F.col("m")) & F.col("word").rlike("[aа]$"))
    return seen.select("word", F.when(F.col("g") == 0, F.lit("none")).when(woman, F.lit("female")).otherwise(F.lit("male")).alias("gender"), "n_parts")


_ALPHABETS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ"]


def _rotated(initial: Column, key: str) -> Column:
    """An initial, turned in its alphabet by a number of places (1 at least) that follows from the key."""
    turn = int.from_bytes(hashlib.sha256(f"{key}|initial".encode()).digest()[:8], "big")
    new = [a[k:] + a[:k] for a in _ALPHABETS for k in [1 + turn % (len(a) - 1)]]
    return F.translate(initial, "".join(_ALPHABETS), "".join(new))


def surrogates_of(counts: DataFrame, key: str) -> DataFrame:
    """entity, n, surrogate for distinct entities (entity, n: its occurrences)."""
    known = staged(counts.withColumn("name", kind(F.col("entity"))), "entities")
    named = F.col("name").isin("name", "other")  # "other": a word of a name that stands alone
    parts = staged(_name_parts(known.filter(named)), "name_words")
    words = staged(_genders(parts), "words")
    items = known.filter(~named).select("entity", "name", F.lit("none").alias("gender")).unionByName(words.select(F.col("word").alias("entity"), F.lit("word").alias("name"), "gender"))
    table = surrogate_table(items, key)
    drawn = words.join(table.filter("name = 'word'").select(F.col("entity").alias("word"), F.col("surrogate").alias("new")), "word").select("word", "new", "n_parts")
    met = salted_lookup(parts, drawn, "word", "entity", "n_parts", nulls=True).withColumn("sign", F.when(F.col("at") > 0, F.get("signs", F.col("at") - 1)).otherwise(F.col("title")))
    loud = (F.col("written") == F.upper("written")) & (F.length("written") > 1)
    new = F.when(loud, F.upper("new")).otherwise(F.col("new"))
    new = F.coalesce(new, F.when(F.col("written").endswith("."), _rotated(F.col("written"), key)).otherwise(F.col("written")))
    whole = met.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", F.concat("sign", new).alias("w")))).alias("w"))  # one name's words
    told = whole.select("entity", F.array_join(F.transform("w", lambda x: x["w"]), "").alias("surrogate"))
    out = staged(known.select("entity", "n").join(table.filter("name <> 'word'").select("entity", "surrogate").unionByName(told), "entity"), "replacements")
    drop_staged(known, parts, words, table)
    return out


def mentions(found: Column) -> Column:
    """A pattern for the words of the names among a text's entities, wherever they stand as capitalised words; '' without names. It goes behind PATTERN."""
    names = F.filter(found, lambda e: e.rlike(rf"^(?:{dict(PATTERNS)['name']})$"))
    bare = F.transform(names, lambda e: F.regexp_replace(e, rf"^(?:(?:{_TITLE}|{_LOUD_TITLE})\.? )+", ""))
    words = F.filter(F.flatten(F.transform(bare, lambda e: F.split(e, "[ \\-]"))), _named)
    first = F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
    written = F.array_distinct(F.concat(words, first, F.transform(words, lambda w: F.upper(w))))
    longest = F.reverse(F.array_sort(F.transform(written, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    listed = F.array_join(F.transform(longest, lambda x: x["w"]), "|")
    return F.when(F.size(words) > 0, F.concat(F.lit(r"|(?<![\p{L}\p{M}\p{N}])(?:"), listed, F.lit(r")(?![\p{L}\p{M}\p{N}])"))).otherwise(F.lit(""))


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with all entities of the column `text` replaced by surrogates drawn with the secret `key`, and `_n_entities`.

    The texts are searched once (those with a name once more, for its words), and written down with what was found. Only rows with an entity are joined; the others pass
    through. Entities meet their surrogates with hot ones salted, so an address that stands in a third of all documents doesn't end in one task.
    """
    # the row travels as one value, so that no column of the input meets a name used here
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.lit(0).alias("_")).alias("box"), F.col(f"`{text}`").alias("body"))
    found = boxed.withColumn("mask", F.coalesce(families(F.col("body")), F.lit(0))).withColumn("found", entities(F.col("body"), F.col("mask")))
    named = F.col("mask").bitwiseAND(F.lit(1 << NAMES_BIT)) != 0
    found = found.withColumn("more", F.when(named, mentions(F.col("found"))).otherwise(F.lit("")))
    again = F.regexp_extract_all("body", F.concat(F.lit(PATTERN), F.col("more")), F.lit(0))  # only texts with a name are searched a second time
    found = found.withColumn("found", F.when(F.col("more") != "", again).otherwise(F.col("found"))).drop("mask")
    found = staged(found.withColumn("n", F.size(F.filter("found", is_entity))).withColumn("row", F.monotonically_increasing_id()), "found")
    plain = found.filter("n = 0").select("box", "body", "n")
    rows = found.filter("n > 0")
    each = rows.select("row", F.posexplode("found").alias("at", "entity")).filter(is_entity(F.col("entity")))
    table = surrogates_of(each.groupBy("entity").agg(F.count("*").alias("n")), key)
    met = salted_lookup(each, table, "entity", "row", "n")
    new = met.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias("new"))  # one document's entities
    gaps = F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.element_at("new", i), F.get(F.col("found"), i), F.lit(""))))
    changed = rows.withColumn("gaps", F.split(F.col("body"), F.concat(F.lit(PATTERN), F.col("more")), -1)).join(new, "row").select("box", F.array_join(gaps, "").alias("body"), "n")
    both = plain.unionByName(changed)
    return both.select(*[F.col("body").alias(text) if c == text else F.col(f"box.`{c}`") for c in docs.columns], F.col("n").alias("_n_entities"))
