"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Found are mail addresses, secrets, bank and card numbers, social security and phone numbers, IP addresses and names
after a title. A mention is taken apart into entities (an address into its local part and domain, a name into given
names, initials among them, and a family name; small words such as "van" stay); each entity gets one surrogate in the whole table, drawn with a keyed SHA-512, so that the same person or
address stays recognisable as the same (coreference) whatever the writing. A surrogate keeps the kind: digits stand
for digits and letters for letters of the same script and case, separators stay, a number that passes the Luhn check
is replaced by one that does, an IP address by one of the reserved ranges 240.0.0.0/4 and 2001:db8::/32, a given name by one of the same
gender and script. Surrogates are checked against each other and against every entity found: a collision draws again,
in later rounds with a longer form where the kind has a free length, so different entities stay different and
nobody's data is handed to somebody else.

Texts are only moved if they may hold a mention at all; the replacements of a text are joined to it by a hash of the
text, which many copies may share.

Defined cases: null and empty texts stay as they are; equal texts get equal replacements; ties between entities for a
surrogate go to the smaller entity; an empty table stays empty; all other columns pass through, whatever their names,
and ``n_chars``, if there, follows the new text.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gladeline.llm.tables import stored
from gladeline.operators.joins import fresh, join_to_unique

#: Titles by gender; names are found after them.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κ."],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "κα."],
    "n": ["Dr", "Prof"],
}


def _any_case(titles: list[str]) -> str:
    """A pattern of titles in either case; "miss" is a verb and "ms" a unit, so other writings of "Ms" need the dot."""
    rest = "|".join(t.replace(".", r"\.") for t in sorted(titles, key=len, reverse=True) if t not in ("Ms", "Miss"))
    return f"(?iu:{rest})" + (r"|Miss|MISS|Ms|(?i:ms)(?=\.)" if "Ms" in titles else "")


_TITLE = _any_case([t for ts in TITLES.values() for t in ts])
#: A part of a name: initials, a letter alone before a further part, or a word with hyphens and apostrophes.
_PART = (
    rf"(?!(?:{_TITLE})\.? )(?:(?:\p{{Lu}}\.)++|\p{{Lu}}(?= \p{{Lu}}\p{{L}})"
    r"|\p{Lu}(?:[\p{L}\p{M}]++|(?=['’-]\p{L}))(?:-\p{L}[\p{L}\p{M}]*+|['’](?![sS](?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+)"
)
#: Small words inside a name; they stay.
_PARTICLES = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|al|el|zu|ter) )*+"
_HEX = "[0-9A-Fa-f]{1,4}"
_LOCAL = r"[\p{L}\p{N}._%+-]"

#: Kinds of mentions in the order in which they are tried.
PATTERNS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)+",
    "secret": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])"
    r"|(?<=(?i:token|secret|password|passwd|api[_-]?key)[\"']? ?[=:] ?[\"'])[^\"'\s]{6,}+"
    r"|(?<=(?i:token|secret|password|passwd|api[_-]?key)[\"']? ?[=:] ?)(?=[^\"'\s]*\d)[^\"'\s]{6,}+",  # unquoted: with a digit
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
    # in either case: one group may be letters alone, as words of four letters look the same
    r"|(?<![\p{L}\p{N}])[A-Za-z]{2}\d{2}(?: ?[A-Za-z]{4})?(?: ?(?=[A-Za-z]{0,3}\d)[A-Za-z0-9]{4}){2,7}(?: ?(?=[A-Za-z]{0,2}\d)[A-Za-z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<!\d)(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\d.])(?:\+?\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\p{L}\p{N}+])\+[1-9](?:[ ./-]?\(?\d\)?){6,14}(?!\d)"
    r"|(?<![\p{L}\p{N}._+-])[2-9]\d{2}[2-9]\d{6}(?![\p{L}\p{N}_]|[.-]\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{6}}(?:\d{{1,3}}\.){{3}}\d{{1,3}}"
    rf"|(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:(?:{_HEX}:){{0,6}}(?:(?:\d{{1,3}}\.){{3}}\d{{1,3}}|{_HEX}))?)(?![\p{{L}}\p{{N}}:]|\.\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_PARTICLES}{_PART}(?: {_PARTICLES}{_PART})*+",
}
MENTION = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no mention.
HINT = rf"[0-9@=:]|(?:{_TITLE})\.? {_PARTICLES}\p{{Lu}}"

#: Letters and syllables of surrogates, by script.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до га го за зе ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε βο δα δε δο γα γο ζα ζε κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το φα φε φο".split(),
}
ENDINGS = {
    ("latin", "m"): ["n", "s", "rd"], ("latin", "f"): ["a", "na", "lia"], ("latin", "n"): ["l", "m", "r"],
    ("cyrillic", "m"): ["н", "р", "т"], ("cyrillic", "f"): ["а", "на", "ла"], ("cyrillic", "n"): ["ль", "м", "к"],
    ("greek", "m"): ["ς", "νος", "ρης"], ("greek", "f"): ["α", "να", "λη"], ("greek", "n"): ["ξ", "ν", "ρ"],
}
_CYRILLIC, _GREEK = r"\p{IsCyrillic}", r"\p{IsGreek}"
#: Rounds after which the form of a surrogate with a free length grows by one place.
ROUNDS_A_LENGTH = 3


def kind_of(mention: Column) -> Column:
    """The kind of a mention; what only its surroundings told is a secret."""
    out = F.lit("secret")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _gender(mention: Column) -> Column:
    out = F.lit("n")
    for gender in ("m", "f"):
        out = F.when(mention.rlike(rf"^(?:{_any_case(TITLES[gender])})\.? "), F.lit(gender)).otherwise(out)
    return out


def _entity(kind, value) -> Column:
    return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), value.alias("value"))


def _words(mention: Column) -> Column:
    return F.split(F.regexp_replace(mention, rf"^(?:{_TITLE})\.? ", ""), " ")


def _is_part(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def entities_of(mention: Column, kind: Column) -> Column:
    """The entities of a mention in the order of the text: kind and normal form."""
    small, digits = F.lower(mention), F.regexp_replace(mention, r"\D", "")
    names, given = F.filter(_words(mention), _is_part), F.concat(F.lit("given_"), _gender(mention))
    parts = F.transform(names, lambda w, i: _entity(F.when(i == F.size(names) - 1, "family").otherwise(given), F.lower(w)))
    return (
        F.when(kind == "email", F.array(_entity("local", F.substring_index(small, "@", 1)), _entity("domain", F.substring_index(small, "@", -1))))
        .when(kind == "name", parts)
        # a number of the North American plan is the same with and without its country code
        .when(kind == "phone", F.array(_entity(kind, F.regexp_replace(digits, r"^1(?=\d{10}$)", ""))))
        .when(kind.isin("ssn", "card"), F.array(_entity(kind, digits)))
        .when(kind == "iban", F.array(_entity(kind, F.upper(F.regexp_replace(mention, " ", "")))))
        .when(kind == "ip6", F.array(_entity(kind, small)))
        .otherwise(F.array(_entity(kind, mention)))
    )


def _draw(digest: Column, place: Column, among: int) -> Column:
    """The number from 0 to ``among - 1`` that a hexadecimal digest gives for a place."""
    return F.pmod(F.conv(F.substr(digest, F.pmod(place * 5, F.lit(124)) + 1, F.lit(5)), 16, 10).cast("long"), F.lit(among))


def _pick(digest: Column, place: Column, options) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (_draw(digest, place, len(options)) + 1).cast("int"))


def _letter(digest: Column, place: Column, like: Column) -> Column:
    of = {s: F.substr(F.lit(x), (_draw(digest, place, len(x)) + 1).cast("int"), F.lit(1)) for s, x in LETTERS.items()}
    small = F.when(like.rlike(_CYRILLIC), of["cyrillic"]).when(like.rlike(_GREEK), of["greek"]).otherwise(of["latin"])
    return F.when(like.rlike(r"\p{Lu}"), F.upper(small)).otherwise(small)


def _alike(value: Column, digest: Column) -> Column:
    """Letters for letters and digits for digits; the rest stays."""

    def other(c, i):
        return F.when(c.rlike(r"\d"), _draw(digest, i, 10).cast("string")).when(c.rlike(r"\p{L}"), _letter(digest, i, c)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _extra(digest: Column, n: Column, like: Column) -> Column:
    """``n`` more letters in the script of ``like``."""
    places = F.filter(F.sequence(F.lit(0), n), lambda i: i > 0)
    return F.array_join(F.transform(places, lambda i: _letter(digest, i + 100, F.lower(like))), "")


def _luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def _number(value: Column, digest: Column) -> Column:
    """Other digits after the first; Luhn-valid if the value is."""
    drawn = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.substr(_alike(value, digest), F.lit(2)))
    head = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    checked = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string")))
    return F.when(_luhn(value), F.element_at(F.filter(checked, _luhn), 1)).otherwise(drawn)


def _remainder(number: Column) -> Column:
    """An account number without its blanks modulo 97, letters counting from 10 and the first four signs last."""
    turned = F.concat(F.substr(number, F.lit(5)), F.substr(number, F.lit(1), F.lit(4)))

    def add(total, c):
        letter = F.ascii(c) - 55
        return F.when(c.rlike(r"\d"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + letter) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add)


def _account(value: Column, digest: Column) -> Column:
    """Another account of the same country; its check digits are right if the value's are."""
    drawn = _alike(F.substr(value, F.lit(5)), digest)
    country, check = F.substr(value, F.lit(1), F.lit(2)), F.substr(value, F.lit(3), F.lit(2))
    right = F.lpad((98 - _remainder(F.concat(country, F.lit("00"), drawn))).cast("string"), 2, "0")
    return F.concat(country, F.when(_remainder(value) == 1, right).otherwise(check), drawn)


def _name(value: Column, gender: str | None, digest: Column, longer: Column) -> Column:
    def made(script):
        ending = [""] if gender is None else ENDINGS[script, gender]
        places = F.sequence(F.lit(1), F.lit(3 if gender is None else 2) + longer)
        body = F.array_join(F.transform(places, lambda i: _pick(digest, i, SYLLABLES[script])), "")
        return F.concat(body, _pick(digest, F.lit(20), ending))

    return F.when(value.rlike(_CYRILLIC), made("cyrillic")).when(value.rlike(_GREEK), made("greek")).otherwise(made("latin"))


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The candidate that a key gives an entity in a round; normal form."""
    digest = F.sha2(F.concat_ws("\u0000", F.lit(key), kind, value, attempt.cast("string")).cast("binary"), 512)
    longer = F.floor(attempt / ROUNDS_A_LENGTH).cast("int")
    hexadecimal = F.array_join(F.transform(
        F.split(value, ""), lambda c, i: F.when(c.rlike("[A-F]"), F.upper(F.substr(digest, F.pmod(i, F.lit(128)) + 1, F.lit(1)))).otherwise(F.substr(digest, F.pmod(i, F.lit(128)) + 1, F.lit(1)))
    ), "")
    case = F.when(value == F.upper(value), F.upper(hexadecimal)).otherwise(F.lower(hexadecimal))
    octets = [(_draw(digest, F.lit(0), 15) + 240).cast("string"), *[_draw(digest, F.lit(i), 256).cast("string") for i in (1, 2, 3)]]
    host, top = F.regexp_extract(value, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(value, r"^(.*)\.([^.]*)$", 2)
    out = (
        F.when(kind == "local", F.concat(_alike(value, digest), _extra(digest, longer, value)))
        .when(kind == "domain", F.concat(_alike(host, digest), _extra(digest, longer, host), F.lit("."), top))
        .when(kind == "ip", F.concat_ws(".", *octets))
        .when(kind == "ip6", F.concat_ws(":", F.lit("2001:db8"), *[F.substr(digest, F.lit(4 * i + 1), F.lit(4)) for i in range(6)]))
        .when(kind.isin("ssn", "phone", "card"), _number(value, digest))
        .when(kind == "iban", _account(value, digest))
        .when(kind == "family", _name(value, None, digest, longer))
    )
    for gender in ("m", "f", "n"):
        out = out.when(kind == f"given_{gender}", _name(value, gender, digest, longer))
    return out.when(value.rlike("^[0-9A-Fa-f]+$"), F.concat(case, F.repeat(F.lit("0"), longer))).otherwise(
        F.concat(_alike(value, digest), _extra(digest, longer, value))
    )


def assign(entities: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """``kind, value, other``: one surrogate per entity, all different per kind and none of them an entity.

    A round settles all entities but those in a collision, so few are left after the first.
    """
    original = entities.select("kind", F.col("value").alias("other"))
    left, settled = entities, None
    for attempt in count():
        if attempt == rounds:
            raise ValueError("a kind of entity has more values than its format has surrogates")
        other = surrogate(F.col("kind"), F.col("value"), key, F.lit(attempt))
        drawn = left.select("kind", "value", other.alias("other"))
        free = drawn.groupBy("kind", "other").agg(F.min("value").alias("value")).join(original, ["kind", "other"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "other"), ["kind", "other"], "left_anti")
        free = stored(free.select("kind", "value", "other"))
        settled = free if settled is None else settled.unionByName(free)
        left = stored(left.join(free, ["kind", "value"], "left_anti"))
        if left.isEmpty():
            return settled


def _in_format(mention: Column, kind: Column, others: Column) -> Column:
    """A mention's surrogates written the way the mention is written."""
    first, last = F.get(others, F.lit(0)), F.element_at(others, -1)
    chars = F.split(mention, "")
    # the i-th digit or letter of the normal form takes the place of the i-th one of the mention
    counts = F.transform(chars, lambda c, i: F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x.rlike(r"[\p{L}\d]"))))
    # signs before the normal form (a country code) stay
    before = F.element_at(counts, -1) - F.length(first)

    def sign(x):
        own = F.substr(first, (x["n"] - before).cast("int"), F.lit(1))
        counted = x["c"].rlike(r"[\p{L}\d]") & (x["n"] > before)
        return F.when(counted & x["c"].rlike(r"\p{Ll}"), F.lower(own)).when(counted, own).otherwise(x["c"])

    placed = F.array_join(F.transform(F.arrays_zip(chars.alias("c"), counts.alias("n")), sign), "")
    shout = (mention == F.upper(mention)) & (mention != F.lower(mention))
    title = F.regexp_extract(mention, rf"^(?:{_TITLE})\.? ", 0)
    words = _words(mention)

    def part(w, i):
        x = F.get(others, F.size(F.filter(F.slice(words, 1, i + 1), _is_part)) - 1)
        # initials stay initials: as many letters of the surrogate
        initials = F.array_join(F.transform(F.split(w, ""), lambda c, k: F.when(c == ".", c).otherwise(F.upper(F.substr(x, F.pmod(F.floor(k / 2), F.length(x)).cast("int") + 1, F.lit(1))))), "")
        whole = F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))
        return F.when(~_is_part(w), w).when(w.rlike(r"^(?:(?:\p{Lu}\.)+|\p{Lu})$"), initials).otherwise(whole)

    written = F.array_join(F.transform(words, part), " ")
    address = F.concat(first, F.lit("@"), last)
    return (
        F.when(kind == "email", F.when(shout, F.upper(address)).otherwise(address))
        .when(kind == "name", F.concat(title, F.when(shout, F.upper(written)).otherwise(written)))
        .when(kind.isin("ssn", "phone", "card", "iban"), placed)
        .otherwise(first)
    )


def _one_gender(parts: DataFrame) -> DataFrame:
    """Given names with one kind in the whole table, so that a person keeps a surrogate under any title.

    The titles that have a gender decide; where they differ or none has one, the name is taken as neutral.
    """
    is_given = F.col("kind").startswith("given_")
    told = F.collect_set("kind")
    men, women = F.array_contains(told, "given_m"), F.array_contains(told, "given_f")
    agreed = F.when(men & ~women, "given_m").when(women & ~men, "given_f").otherwise("given_n")
    by_value = parts.filter(is_given).groupBy("value").agg(agreed.alias("agreed"))
    met = join_to_unique(parts, by_value, ["value"], "left")
    return met.select("mention", "as", "at", F.when(is_given, F.col("agreed")).otherwise(F.col("kind")).alias("kind"), "value")


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """``mention, replacement`` for a table of different mentions."""
    known = stored(mentions.withColumn("kind", kind_of(F.col("mention"))).withColumn("parts", entities_of(F.col("mention"), F.col("kind"))))
    parts = known.select("mention", F.col("kind").alias("as"), F.posexplode("parts").alias("at", "part"))
    parts = _one_gender(parts.select("mention", "as", "at", "part.kind", "part.value"))
    chosen = assign(stored(parts.select("kind", "value").distinct()), key)
    found = join_to_unique(parts, chosen, ["kind", "value"])
    whole = found.groupBy("mention", "as").agg(F.sort_array(F.collect_list(F.struct("at", "other"))).alias("others"))
    others = F.transform("others", lambda x: x["other"])
    return whole.select("mention", _in_format(F.col("mention"), F.col("as"), others).alias("replacement"))


def replace_mentions(docs: DataFrame, key: str, count_as: str | None = None) -> DataFrame:
    """``docs`` with every mention in ``text`` replaced; ``count_as`` names a further column, their number per text."""
    text = F.col("text").cast("string")
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    found = F.regexp_extract_all(text, F.lit(MENTION), 0)
    pairs = docs.filter(hinted).select(F.xxhash64(text).alias("key"), F.explode(F.array_distinct(found)).alias("mention")).distinct()
    pairs = stored(pairs)
    known = stored(replacements(pairs.select("mention").distinct(), key))
    # the columns used on the way are named unlike any of the table's
    key_name, other_name, found_name = fresh(docs.columns, "__key", "__other", "__found")
    per_text = join_to_unique(pairs, known, ["mention"]).groupBy(F.col("key").alias(key_name)).agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias(other_name)
    )
    keyed = docs.filter(hinted).withColumn(key_name, F.xxhash64(text))
    met = join_to_unique(keyed, per_text, [key_name], "left")
    # what stands between the mentions, each followed by the mention's replacement
    between, here, others = F.split(text, MENTION, -1), F.col(found_name), F.col(other_name)
    mended = F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.element_at(others, F.coalesce(F.get(here, i), F.lit(""))), F.lit("")))), "")
    met = met.withColumn(found_name, F.when(others.isNotNull(), found))
    changed = F.when(others.isNull(), text).otherwise(mended)

    def columns(new_text, n):
        out = [new_text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
        if "n_chars" in docs.columns:
            kind = dict(docs.dtypes)["n_chars"]
            at = docs.columns.index("n_chars")
            out[at] = F.when(F.lit(n is None), F.col("n_chars")).otherwise(F.char_length(new_text).cast(kind)).alias("n_chars")
        return out + ([F.coalesce(n, F.lit(0)).cast("int").alias(count_as)] if count_as else [])

    untouched = docs.filter(~hinted).select(*columns(text, F.lit(0)) if count_as else [F.col(f"`{c}`") for c in docs.columns])
    return met.select(*columns(changed, F.when(here.isNull(), F.lit(0)).otherwise(F.size(here)))).unionByName(untouched)
