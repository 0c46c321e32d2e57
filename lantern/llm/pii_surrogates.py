"""Surrogates for personal data, in DataFrame operations alone.

Entities: e-mail and IPv4 addresses, phone, payment card (of an issuer's range, passing Luhn's
check) and social security numbers, IBANs, and names: the words after a title, and the same
words wherever else they stand in that text. Each gets a keyed replacement of its own type and
format: digits stay digits, letters stay letters of their case, punctuation, country codes,
top-level domains and a card's first two digits stand; cards and IBANs pass their checks; names
keep gender (if all their titles agree), script, case and number of words.

A surrogate is drawn for the entity, not for its spelling: letter case, blanks and punctuation
of a number make no difference, and each spelling gets the same digits and letters in its own
format. Collisions are looked for over the corpus: a surrogate that two entities share, or that is
some entity of the corpus itself, is drawn again for all but the first, until none is left. Names and
e-mail addresses grow by a letter or more with each draw, so there is always one left. Other formats can be exhausted, as the
numbers of a length are finite: what is still without a surrogate after 24 draws gets a marker, such as
`[phone 0123456789ab]`, that is keyed and distinct too, and one for all spellings.

The key must be given; without it nobody can recompute a surrogate.

A null text stays null and an empty one empty, with 0 entities. Ids may be null or repeated; rows
are treated by their text alone. Columns of the input named like the result's are not read.
An empty table gives an empty result. Texts are whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# What entities look like, as Java patterns.
TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Κυρία"
TITLES_M = "Mr|Herr|Monsieur|Señor|Sr|Г-н|Κύριος"
TITLES = f"{TITLES_F}|{TITLES_M}|Dr|Prof|Professor|Doctor|Doktor|Docteur|Mx"
NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "abroad": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?![\d-])",
    "phone": r"(?<![\w)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\d-])|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:[4-6]\d{3}|2[2-7]\d{2})[ -]?(?:\d{4}[ -]?){2}\d{4}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "titled": rf"(?<![\p{{L}}])(?:(?:{TITLES})\.? )+{NAME}(?: {NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has a run of digits, an @ or a title.
MAYBE = rf"\d\d|\d\.\d|@|(?:{TITLES})\.? \p{{Lu}}"
# Country calling codes of one and two digits; all others have three.
CODES = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Syllables of made-up names by script, one for each hexadecimal digit.
SYLLABLES = {
    "latin": "ba do fe gi ha jo ka lu me ni or pa ri sa te va".split(),
    "cyrillic": "ба до фе ги ха жо ка лу ме ни ор па ри са те ва".split(),
    "greek": "βα δο φε γι χα ζο κα λυ με νι ορ πα ρι σα τε ξα".split(),
}
# Endings of names by script: women's, men's.
ENDINGS = {"latin": ("na", "rt"), "cyrillic": ("на", "рт"), "greek": ("να", "ρτ")}
#: Draws after which a format counts as exhausted.
EXHAUSTED = 24
#: Replacements that are broadcast at most, and their characters.
SMALL, SMALL_CHARS = 300_000, 16_000_000


def kind_of(surface: Column) -> Column:
    out = F.lit("name")  # a word of a name, without its title
    for kind in reversed(PATTERNS):
        out = F.when(surface.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return F.when((out == "card") & (luhn(F.regexp_replace(surface, r"\D", "")) != 0), "as it is").otherwise(out)


def parts_of(kind: Column, surface: Column) -> Column:
    """array<struct<kind,text,sex>>: titles and names by words, others whole. sex: 1 for a woman's given name, 2 for a man's."""
    def part(kind: Column | str, text: Column, sex: Column | int = 0) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), (F.lit(sex) if isinstance(sex, int) else sex).cast("int").alias("sex"))

    titles = F.regexp_extract(surface, rf"^(?:(?:{TITLES})\.? )+", 0)
    names = F.split(F.substring(surface, F.length(titles) + 1, F.length(surface)), " ")
    sex = F.when(titles.rlike(rf"(?:^| )(?:{TITLES_F})\.? "), 1).when(titles.rlike(rf"(?:^| )(?:{TITLES_M})\.? "), 2).otherwise(0)
    words = F.flatten(F.transform(names, lambda w, i: F.array(part("as it is", F.when(i == 0, titles).otherwise(F.lit(" "))), part("name", w, F.when(i < F.size(names) - 1, sex).otherwise(0)))))
    return F.when(kind == "titled", words).otherwise(F.array(part(kind, surface)))


def canonical(kind: Column, surface: Column) -> Column:
    """What makes two surfaces the same entity."""
    return F.when(kind.isin("abroad", "phone", "card", "ssn"), F.regexp_replace(surface, r"\D", "")).when(kind == "iban", F.replace(surface, F.lit(" "), F.lit(""))).otherwise(F.lower(surface))


def luhn(digits: Column) -> Column:
    """Sum of a digit string by Luhn's rule, mod 10."""
    def term(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + term(i)) % 10


def mod97(code: Column) -> Column:
    """Remainder of an IBAN, its first four characters moved to the end and letters read as 10 to 35."""
    def step(a: Column, c: Column) -> Column:
        value = F.conv(c, 36, 10).cast("int")
        return F.when(value > 9, (a * 100 + value) % 97).otherwise((a * 10 + value) % 97)

    return F.aggregate(F.split(F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4))), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def surrogate(key: str, kind: Column, own: Column, sex: Column, attempt: Column) -> Column:
    """The canonical surrogate of an entity."""
    def stream(salt: str) -> Column:
        return F.concat(*(F.sha2(F.concat_ws("|", F.lit(key + salt + str(k)), kind, own, attempt.cast("string")), 256) for k in range(2)))

    digits, hexes = F.translate(stream("d"), "abcdef", "729405"), stream("n")
    # All 26 letters: a third stream tells which of two alphabets a letter is of
    letters, others, which = F.translate(stream("l"), "0123456789abcdef", "qwrtypsdfghjklzx"), F.translate(stream("m"), "0123456789abcdef", "aeioubcmnvaeioum"), stream("w")
    code = F.when(own.rlike(CODES), F.length(F.regexp_extract(own, CODES, 0))).otherwise(3)
    fixed = F.when(kind == "abroad", code).when(kind == "iban", F.lit(4)).when(kind == "card", F.lit(2)).otherwise(F.lit(0))
    until = F.when(kind == "email", F.length(F.regexp_extract(own, r"^(.*\.)[^.]*$", 1))).otherwise(F.length(own))

    def char(i: Column) -> Column:
        c = F.substring(own, i, F.lit(1))
        place = F.pmod(i - 1, F.lit(128)) + 1
        letter = F.when(F.substring(which, place, F.lit(1)) < "a", F.substring(letters, place, F.lit(1))).otherwise(F.substring(others, place, F.lit(1)))
        new = F.when(c.rlike(r"\d"), F.substring(digits, place, F.lit(1))).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)
        return F.when((i <= fixed) | (i > until), c).otherwise(new)

    plain = F.array_join(F.transform(F.sequence(F.lit(1), F.length(own)), char), "")
    octet = lambda k: F.conv(F.substring(hexes, 2 * k + 1, 2), 16, 10)
    ip = F.concat_ws(".", (F.pmod(octet(0).cast("int"), F.lit(223)) + 1).cast("string"), *(octet(k) for k in range(1, 4)))
    # The last digit of a card and the third and fourth character of an IBAN are chosen to pass the check.
    cut = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit("0"))
    card = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), ((10 - luhn(cut)) % 10).cast("string"))
    blank = F.concat(F.substring(plain, F.lit(1), F.lit(2)), F.lit("00"), F.substring(plain, F.lit(5), F.length(plain)))
    iban = F.concat(F.substring(plain, F.lit(1), F.lit(2)), F.lpad((98 - mod97(blank)).cast("string"), 2, "0"), F.substring(plain, F.lit(5), F.length(plain)))
    script = F.when(own.rlike(r"\p{IsCyrillic}"), "cyrillic").when(own.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    name = F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        stem = F.array_join(F.transform(F.sequence(F.lit(1), F.least(attempt + 4, F.lit(128))), lambda i: F.element_at(table, F.conv(F.substring(hexes, i, F.lit(1)), 16, 10).cast("int") + 1)), "")
        ending = F.when(sex == 1, ENDINGS[s][0]).when(sex == 2, ENDINGS[s][1]).otherwise("")
        name = F.when(script == s, F.concat(stem, ending)).otherwise(name)
    # An address that was taken gets longer with each attempt
    grown = F.concat(F.substring(letters, F.lit(1), F.least(attempt, F.lit(128))), plain)
    new = F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban).when(kind == "name", name).when(kind == "email", grown).otherwise(plain)
    marker = F.concat(F.lit("["), kind, F.lit(" "), F.substring(hexes, F.lit(1), F.least(F.lit(12) + attempt, F.lit(128))), F.lit("]"))
    return F.when((attempt >= EXHAUSTED) & ~kind.isin("name", "email"), marker).otherwise(new)


def rendered(kind: Column, surface: Column, new: Column) -> Column:
    """The surrogate in the surface's format."""
    def char(i: Column) -> Column:
        c = F.substring(surface, i, F.lit(1))
        place = F.length(F.regexp_replace(F.substring(surface, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(new, place, F.lit(1))).otherwise(c)

    spaced = F.array_join(F.transform(F.sequence(F.lit(1), F.length(surface)), char), "")
    cased = F.array_join(F.transform(F.sequence(F.lit(1), F.length(surface)), lambda i: F.when(F.substring(surface, i, F.lit(1)).rlike(r"\p{Lu}"), F.upper(F.substring(new, i, F.lit(1)))).otherwise(F.substring(new, i, F.lit(1)))), "")
    cased = F.concat(cased, F.substring(new, F.length(surface) + 1, F.length(new)))  # an address may have grown
    named = F.when((F.length(surface) > 1) & (surface == F.upper(surface)), F.upper(new)).otherwise(F.initcap(new))
    return F.when(kind == "as it is", surface).when(new.startswith("["), new).when(kind == "name", named).when(kind == "email", F.when(surface == F.lower(surface), new).otherwise(cased)).when(kind == "ip", new).otherwise(spaced)


def draws(entities: DataFrame, key: str) -> DataFrame:
    """(kind, own, new) of all entities, no two of a kind alike and none an entity itself. entities: distinct (kind, own, sex)."""
    taken, rest, attempt = None, entities, 0
    parts = max(8, -(-entities.count() // 2000))  # or the few bytes of many entities would end up in one task
    while True:
        drawn = C.cut(rest.repartition(parts, "kind", "own").withColumn("new", surrogate(key, F.col("kind"), F.col("own"), F.col("sex"), F.lit(attempt))))
        free = drawn.groupBy("kind", "new").agg(F.min("own").alias("own")).join(entities.select("kind", F.col("own").alias("new")), ["kind", "new"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "new"], "left_anti")
        won = C.cut(free.select("kind", "own", "new"))
        taken = won if taken is None else taken.union(won)
        rest = C.cut(drawn.join(won.select("kind", "own"), ["kind", "own"], "left_anti").drop("new"))
        if rest.isEmpty():
            return taken
        attempt += 1


def _broadcast(df: DataFrame, chars: Column) -> DataFrame:
    """df, broadcast if it is small enough."""
    n, size = df.agg(F.count("*"), F.sum(chars)).first()
    return F.broadcast(df) if n <= SMALL and (size or 0) <= SMALL_CHARS else df


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows of docs with surrogates in text_col, and `n_entities`."""
    if not key:
        raise ValueError("a key is needed")
    names_kept = [c for c in docs.columns if c != "n_entities"]
    rest = [c for c in names_kept if c != text_col]
    rows = docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("_row"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_at"))
    # explode() drops texts without a match and evaluates the patterns once, as a filter wouldn't.
    matches = F.filter(F.array(F.regexp_extract_all(F.col("_text"), F.lit(ANY), F.lit(0))), lambda m: F.size(m) > 0)
    titled = rf"^(?:(?:{TITLES})\.? )+"
    found = rows.where(F.col("_text").rlike(MAYBE)).select("_at", F.col("_text").alias("text"), F.explode(matches).alias("matches"))
    names = F.array_distinct(F.flatten(F.transform(F.filter("matches", lambda m: m.rlike(titled)), lambda m: F.split(F.regexp_replace(m, titled, ""), " "))))
    found = found.withColumn("names", names).withColumn("text", F.when(F.size("names") > 0, F.col("text"))).dropDuplicates(["_at"])
    found = C.cut(found.withColumn("pattern", F.when(F.size("names") > 0, F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join("names", "|"), F.lit(r")(?!\p{L})")))))
    found = C.cut(found.select("_at", "pattern", F.when(F.col("pattern").isNull(), F.col("matches")).otherwise(F.regexp_extract_all("text", "pattern", F.lit(0))).alias("matches")))
    places = found.select("_at", F.posexplode("matches").alias("place", "surface"))
    surfaces = C.cut(places.select("surface").distinct().withColumn("kind", kind_of(F.col("surface"))))
    parts = surfaces.select("surface", F.posexplode(parts_of(F.col("kind"), F.col("surface"))).alias("part", "p")).select("surface", "part", "p.kind", "p.text", "p.sex")
    parts = C.cut(parts.withColumn("own", canonical(F.col("kind"), F.col("text"))))
    sexes = F.when(F.max("sex") == F.min(F.when(F.col("sex") > 0, F.col("sex"))), F.max("sex")).otherwise(0)
    entities = C.cut(parts.where("kind <> 'as it is'").groupBy("kind", "own").agg(sexes.alias("sex")))
    new = draws(entities, key)
    parts = parts.join(new, ["kind", "own"], "left").withColumn("new", rendered(F.col("kind"), F.col("text"), F.col("new")))
    whole = parts.groupBy("surface").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), "").alias("new"), F.max((F.col("kind") != "as it is").cast("int")).alias("real"))
    whole = C.cut(whole)
    lists = places.join(_broadcast(whole, F.length("surface") + F.length("new")), "surface").groupBy("_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]).alias("_new"), F.sum("real").cast("int").alias("_real"))
    lists = C.cut(lists.join(found.select("_at", F.col("pattern").alias("_pattern")), "_at"))
    chars = F.aggregate("_new", F.lit(0), lambda a, x: a + F.length(x)) + F.coalesce(F.length("_pattern"), F.lit(0))
    joined = rows.join(_broadcast(lists, chars), "_at", "left")
    between = F.when(F.col("_pattern").isNull(), F.split(F.col("_text"), ANY, -1)).otherwise(F.split(F.col("_text"), F.col("_pattern"), F.lit(-1)))
    text = F.array_join(F.zip_with(between, "_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = [F.when(F.col("_new").isNull(), F.col("_text")).otherwise(text).alias(c) if c == text_col else F.col(f"_row.{c}").alias(c) for c in names_kept]
    return joined.select(*out, F.coalesce("_real", F.lit(0)).alias("n_entities"))
