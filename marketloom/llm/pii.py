"""Surrogates for personal data, with DataFrame functions only.

Entities (e-mail and IP addresses, phone, card, account and social security numbers,
secrets, names after a title) are found with one pattern.  Every distinct entity gets a
surrogate drawn by a keyed SHA-256 of its type and canonical form, so all its mentions,
in whatever letter case or digit grouping, stay one entity.  A surrogate keeps the
type and the format: letters stay letters of their case and script, digits stay
digits, separators stay; names keep the gender of their title and their script, phone
numbers their country code, cards and accounts valid check digits.  A number counts as
a card only if its check digit is right.

Names: a title, further neutral titles, and any number of name words with inner capitals,
apostrophes, hyphens, initials and particles.  Within a document a titled surname is the
one full name with it of a fitting gender, and its untitled later mentions (the full name,
the surname) are replaced too; a surname of several persons without a title is the first
one's.  Where a title is a given name as well ("Mr Don Smith", later "Don Smith"), the later
mention is the full name.  Given names alone, and surnames of one letter, stay in clear without a title.

Collision checks: a surrogate that another entity of its type has drawn too, or that is
a real entity of the corpus, is drawn again with the next attempt number until none is
left, so distinct entities stay distinct.  After ``PLAIN_ATTEMPTS`` attempts a format is
taken to be nearly used up, and its surrogates get a drawn tail, so the rounds end.

Rows without entities are passed on as they are, without a shuffle; those with entities
are joined with the replacements of their own entities.

Defined results: null and empty texts stay; rows with equal id and text get the same
text; null ids and all other columns are kept, columns whose names begin with two
underscores apart, which are used here; texts of any length are searched whole, by
patterns whose unbounded parts need no stack; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.scratch import Scratch
from marketloom.llm.skew import spread_join

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Titles by gender: fixed words of the supported languages.
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Lady", "Dame", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña", "Signora", "Signorina", "Госпожа", "Dra", "Doctora", "Professorin")
MALE = ("Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Signore", "Господин")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Professeur", "Mx", "Доктор", "Профессор")
#: Given names by gender and script, and syllables of surnames: fixed words.
GIVEN = {
    ("f", "latin"): ("Anna", "Clara", "Elena", "Greta", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sofia", "Alma", "Berta", "Carla", "Dora", "Edith", "Flora", "Helena", "Ida", "Judith", "Lena", "Mona", "Olga"),
    ("m", "latin"): ("Adrian", "Bruno", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Leo", "Martin", "Oscar", "Pablo", "Simon", "Anton", "Benno", "Carlos", "David", "Erik", "Frank", "Georg", "Henri", "Jakob", "Karl", "Louis", "Max"),
    ("n", "latin"): ("Alex", "Kim", "Robin", "Sascha", "Noa", "Mika", "Jona", "Charlie"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Слава", "Паша", "Шура"),
    ("f", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"),
    ("f", "greek"): ("Άννα", "Ελένη", "Μαρία", "Σοφία", "Ειρήνη", "Δάφνη", "Ιόλη", "Ζωή"),
    ("m", "greek"): ("Νίκος", "Γιάννης", "Πέτρος", "Μάρκος", "Αλέξης", "Στέλιος", "Ηλίας", "Λευτέρης"),
    ("n", "greek"): ("Αντώνα", "Φώτη", "Χάρι", "Βάγια"),
    ("m", "cyrillic"): ("Антон", "Борис", "Иван", "Лев", "Марк", "Олег", "Павел", "Фёдор"),
}
SYLLABLES = {"latin": ("ba", "del", "kor", "lin", "mar", "nov", "per", "ros", "sen", "tal", "ver", "zan", "hal", "gro", "fen", "dor"), "cyrillic": ("бел", "вор", "гор", "дан", "кор", "лен", "мар", "нов", "пет", "сер", "тол", "чер"), "greek": ("βαλ", "γαρ", "δελ", "κορ", "λιν", "μαρ", "νικ", "περ", "ρος", "σεν", "ταλ", "φιλ")}
#: Country calling codes: those of one digit, of two, else three.
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
LETTERS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "accent": "áàâäãéèêëíìîïñóòôöõúùûüç", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

PLAIN_ATTEMPTS = 6  # rounds of drawing in which a surrogate has the length of its entity

_GAP, _END = r"[  ]+", r"(?:\.[  ]*|[  ]+)"
_PARTICLES = rf"(?:(?:von|van|vom|der|den|de|del|della|di|da|do|dos|das|du|la|le|los|las|y|zu|zum|zur|ten|ter|bin|ibn|al|el|af|av|фон|де|ван){_GAP})*+"
_WORD = r"(?:(?:[dlDL]['’]|al-|el-)?\p{Lu}[\p{L}\p{M}]*+(?:['’\-‐‑](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]++)*+)"
#: A name word, or initials before another one
_TOKEN = rf"(?:(?:\p{{Lu}}\.-?)++(?=[  ]?{_PARTICLES}\p{{Lu}})|{_WORD})"
_TITLES = "(?:" + "|".join(FEMALE + MALE + NEUTRAL) + rf"){_END}(?:(?:" + "|".join(NEUTRAL) + rf"){_END})*+"

_PARTS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}][\p{L}\p{N}.-]*(?<=\.\p{L}{2,24})(?![\p{L}\p{N}])",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}|(?=[0-9]{0,63}[A-Fa-f])(?=[A-Fa-f]{0,63}[0-9])[0-9A-Fa-f]{32,64})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?:(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])|(?<![0-9A-Za-z:])(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:]))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<!\p{{L}}){_TITLES}{_PARTICLES}{_TOKEN}(?:(?:{_GAP}{_PARTICLES}|(?<=[.-])){_TOKEN})*+(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in _PARTS.values())


def may_hold(text: Column) -> Column:
    """False only for texts without any entity: each has a digit, an @, a title or a key's prefix."""
    out = text.rlike("[0-9@]")
    for word in ("AKIA", "ghp_", "sk-", *(f"{t}{end}" for t in FEMALE + MALE + NEUTRAL for end in (" ", ".", "\u00a0"))):
        out = out | text.contains(word)
    return out


def kind(entity: Column) -> Column:
    """The type of a matched string, which depends on the string alone; null for a long number that is no card's."""
    whole = lambda name: entity.rlike("^(?:" + _PARTS[name] + ")$")
    out = F.when(entity.contains("@"), "email")
    for name in ("secret", "iban", "ip", "ssn", "phone"):
        out = out.when(whole(name), name)
    card = F.when(_checks(F.regexp_replace(entity, "[^0-9]", "")), "card")
    return out.when(whole("card"), card).otherwise("name")


def _checks(digits: Column) -> Column:
    """Whether the last digit is right (Luhn)."""
    return F.call_function("luhn_check", digits)


def gender(entity: Column) -> Column:
    starts = lambda titles: entity.rlike("^(?:" + "|".join(titles) + f"){_END}")
    return F.when(starts(FEMALE), "f").when(starts(MALE), "m").otherwise("n")


def body(entity: Column) -> Column:
    """A name without its titles, with plain spaces."""
    return F.regexp_replace(F.regexp_replace(entity, f"^{_TITLES}", ""), _GAP, " ")


def surname(body: Column) -> Column:
    """The last word, before a suffix."""
    return F.regexp_extract(F.regexp_replace(body, r" (?:Jr|Sr|II|III|IV)$", ""), r"([^ .]+)$", 1)


def alone(body: Column) -> Column:
    """Whether a name is a surname without given names."""
    return ~F.regexp_replace(body, f"^{_PARTICLES}", "").rlike("[ .]")


def canonical(entity: Column, of: Column) -> Column:
    """What all mentions of one entity share."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    name = F.concat(gender(entity), F.lit(":"), body(entity))
    phone = F.concat(F.when(entity.startswith("+"), "+").otherwise(""), digits)
    return F.when(of == "phone", phone).when(of.isin("card", "ssn"), digits).when(of == "name", name).when(of == "iban", F.regexp_replace(entity, " ", "")).otherwise(F.lower(entity))


def _pick(choices: tuple[str, ...] | str, draw: Column, salt) -> Column:
    salt = salt if isinstance(salt, Column) else F.lit(salt)
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(F.xxhash64(draw, salt), F.lit(len(choices))) + 1).cast("int"))


def _mapped(value: Column, draw: Column, fixed: int = 0, hexadecimal: bool = False) -> Column:
    """``value`` with each letter and digit after the first ``fixed`` characters drawn anew in its class."""

    def one(c: Column, i: Column) -> Column:
        if hexadecimal:
            changed = F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", draw, i))
        else:
            changed = F.when(c.rlike("[0-9]"), _pick("0123456789", draw, i)).when(c.rlike("[a-z]"), _pick(LETTERS["lower"], draw, i)).when(c.rlike("[A-Z]"), _pick(LETTERS["upper"], draw, i))
            changed = changed.when(c.rlike(r"\p{IsCyrillic}"), _pick(LETTERS["cyrillic"], draw, i)).when(c.rlike(r"\p{IsGreek}"), _pick(LETTERS["greek"], draw, i)).when(c.rlike(r"\p{L}"), _pick(LETTERS["accent"], draw, i))
        return F.when(i < fixed, c).otherwise(F.coalesce(changed, c))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _card(value: Column, draw: Column) -> Column:
    """Digits after the first drawn, the last one by Luhn."""
    drawn = _mapped(value, draw, fixed=1)
    front = drawn.substr(F.lit(1), F.length(drawn) - 1)
    return F.concat(front, F.get(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: _checks(F.concat(front, d))), F.lit(0)))


def _iban(value: Column, draw: Column) -> Column:
    """The country's letters, check digits modulo 97, and the rest drawn."""
    country, rest = F.substring(value, 1, 2), _mapped(value.substr(F.lit(5), F.length(value)), draw)
    step = lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55) % 97
    left = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(step(s, c)))
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _phone(value: Column, draw: Column) -> Column:
    """The country code, or the first digit, and the rest drawn."""
    code = F.regexp_extract(value, _COUNTRY, 0)
    code = F.when(code == "", F.substring(value, 1, 1)).otherwise(code)
    return F.concat(code, _mapped(value.substr(F.length(code) + 1, F.length(value)), draw))


def surrogate(of: Column, value: Column, key: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity; the hash behind it is taken once."""
    drawn = F.array(F.sha2(F.concat_ws("|", key, of, value, attempt.cast("string")), 256))
    return F.get(F.transform(drawn, lambda draw: _surrogate(of, value, draw, attempt)), F.lit(0))


def _surrogate(of: Column, value: Column, draw: Column, attempt: Column) -> Column:
    tail = lambda choices, n=8: F.when(attempt >= PLAIN_ATTEMPTS, F.concat(*[_pick(choices, draw, f"t{i}") for i in range(n)])).otherwise("")
    digits = tail("0123456789")
    octets = [(F.pmod(F.xxhash64(draw, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)]
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    last = F.substring_index(domain, ".", -1)
    host = domain.substr(F.lit(1), F.length(domain) - F.length(last) - 1)
    email = F.concat(_mapped(local, draw), tail(LETTERS["lower"]), F.lit("@"), _mapped(host, F.concat(draw, F.lit("d"))), F.lit("."), last)
    name = None
    for (g, script), given in GIVEN.items():
        parts = [_pick(SYLLABLES[script], draw, f"s{i}") for i in range(4)] + [tail(SYLLABLES[script], 6)]
        full = F.concat(_pick(given, draw, "g"), F.lit(" "), F.initcap(F.concat(*parts)))
        single = F.initcap(F.concat(*parts))
        whole = F.concat(F.lit(f"{g}:"), F.when(alone(value.substr(F.lit(3), F.length(value))), single).otherwise(full))
        written = {"cyrillic": value.rlike(r"\p{IsCyrillic}"), "greek": value.rlike(r"\p{IsGreek}"), "latin": ~value.rlike(r"[\p{IsCyrillic}\p{IsGreek}]")}
        test = value.startswith(f"{g}:") & written[script]
        name = F.when(test, whole) if name is None else name.when(test, whole)
    prefix = F.when(value.rlike("^(akia|ghp_)"), 4).when(value.rlike("^sk-"), 3).otherwise(0)
    plain = F.when(prefix > 0, F.concat(F.substring(value, 1, 4), _mapped(value.substr(F.lit(5), F.length(value)), draw))).otherwise(_mapped(value, draw, hexadecimal=True))
    plain = F.concat(plain, tail("0123456789abcdef"))
    ip = F.when(value.contains(":"), _mapped(value, draw, hexadecimal=True)).otherwise(F.concat_ws(".", *octets))
    return (F.when(of == "email", email).when(of == "ip", ip).when(of == "secret", plain).when(of == "name", name).when(of == "iban", F.concat(_iban(value, draw), digits))
            .when(of == "card", F.concat(_card(value, draw), digits)).when(of == "phone", F.concat(_phone(value, draw), digits)).otherwise(F.concat(_mapped(value, draw, fixed=1), digits)))


def rendered(entity: Column, of: Column, made: Column) -> Column:
    """A canonical surrogate in the format of one mention."""
    made = F.when(of == "phone", F.ltrim(made, F.lit("+"))).otherwise(made)
    spread = lambda pattern: F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(pattern), made.substr(F.length(F.regexp_replace(entity.substr(F.lit(1), i + 1), f"(?!{pattern}).", "")), F.lit(1))).otherwise(c)), "")
    rest = lambda pattern: made.substr(F.length(F.regexp_replace(entity, f"(?!{pattern}).", "")) + 1, F.length(made))
    title = F.regexp_extract(entity, f"^({_TITLES})", 1)
    shown = F.when(alone(body(entity)), F.substring_index(F.substring(made, 3, 1000), " ", -1)).otherwise(F.substring(made, 3, 1000))
    shout = (entity == F.upper(entity)) & (entity != F.lower(entity))
    return (F.when(of.isin("phone", "card", "ssn"), F.concat(spread("[0-9]"), rest("[0-9]"))).when(of == "iban", F.concat(spread("[0-9A-Z]"), rest("[0-9A-Z]")))
            .when(of == "name", F.concat(title, shown)).when(shout, F.upper(made)).otherwise(made))


def distinct_surrogates(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, value, made) of distinct entities (kind, value), no two alike and none a real entity."""
    secret = F.lit(key)
    done, attempt = None, 0
    todo = entities.withColumn("made", surrogate(F.col("kind"), F.col("value"), secret, F.lit(0)))
    todo = scratch.save(todo, "drawn-0")
    while True:
        first = todo.groupBy("kind", "made").agg(F.min("value").alias("owner"))
        checked = todo.join(first, ["kind", "made"]).join(entities.select("kind", F.col("value").alias("made"), F.lit(True).alias("real")), ["kind", "made"], "left")
        bad = F.col("real").isNotNull() | (F.col("value") != F.col("owner"))
        if done is not None:
            checked = checked.join(done.select("kind", "made", F.lit(True).alias("used")), ["kind", "made"], "left")
            bad = bad | F.col("used").isNotNull()
        checked = scratch.save(checked.select("kind", "value", "made", bad.alias("bad")), f"checked-{attempt}")
        good = checked.filter(~F.col("bad")).drop("bad")
        done = good if done is None else done.union(good)
        again = checked.filter("bad").select("kind", "value")
        if again.isEmpty():
            return done
        attempt += 1
        todo = scratch.save(again.withColumn("made", surrogate(F.col("kind"), F.col("value"), secret, F.lit(attempt))), f"drawn-{attempt}")


def persons(names: DataFrame) -> DataFrame:
    """``value`` of the person that each titled mention (__key, entity) means within its document."""
    parts = names.withColumns({"g": gender(F.col("entity")), "b": body(F.col("entity"))}).withColumns({"last": surname(F.col("b")), "short": alone(F.col("b"))})
    parts = parts.withColumn("last", F.when(F.col("last") == "", F.col("b")).otherwise(F.col("last")))
    seen = parts.groupBy("__key", "last").agg(F.array_sort(F.collect_set(F.struct("short", "b", "g"))).alias("seen"))
    fits = lambda x: (x["g"] == F.col("g")) | (x["g"] == "n") | (F.col("g") == "n")
    own = lambda x: fits(x) & ((x["b"] == F.col("b")) | (F.col("short") & ~x["short"]))
    out = parts.join(seen, ["__key", "last"]).withColumn("all", F.filter("seen", own))
    out = out.withColumn("full", F.filter("all", lambda x: ~x["short"])).withColumn("all", F.when(F.size("full") > 0, F.col("full")).otherwise(F.col("all")))
    out = out.withColumns({"bodies": F.array_distinct(F.transform("all", lambda x: x["b"])), "genders": F.array_distinct(F.transform(F.concat("all", F.array(F.struct("short", "b", "g"))), lambda x: x["g"]))})
    out = out.withColumn("genders", F.array_remove("genders", "n"))
    one = F.size("bodies") == 1
    who = F.when(one, F.col("bodies")[0]).otherwise(F.col("b"))
    sex = F.when(one & (F.size("genders") == 1), F.get("genders", F.lit(0))).otherwise(F.col("g"))
    return out.select("__key", "entity", "b", "last", F.lit("name").alias("kind"), F.concat(sex, F.lit(":"), who).alias("value"))


def pseudonymise(documents: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """``documents`` with every entity replaced; ``found_col`` names an added column of their number."""
    scratch = Scratch(documents.sparkSession, "pii")
    text = F.col(text_col)
    has = F.coalesce(may_hold(text) & text.rlike(PATTERN), F.lit(False))
    row_key = F.sha2(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), text), 256)
    all_found = lambda: F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    touched = documents.filter(has)
    mentions = scratch.save(touched.select(row_key.alias("__key"), F.explode(F.array_distinct(all_found())).alias("entity")).distinct(), "mentions")
    # written out step by step, so that no expression holds copies of the one before
    typed = scratch.save(mentions.select("entity").distinct().withColumn("kind", kind(F.col("entity"))).filter("kind is not null"), "kinds")
    typed = scratch.save(typed.withColumn("value", canonical(F.col("entity"), F.col("kind"))), "typed")
    people = scratch.save(persons(spread_join(mentions, typed.filter("kind = 'name'").select("entity"), "entity")), "people")
    plain = typed.filter("kind != 'name'")
    entities = plain.select("kind", "value").union(people.select("kind", "value")).distinct()
    made = scratch.save(distinct_surrogates(scratch.save(entities, "entities"), key, scratch), "made")
    # one replacement for each distinct mention, before it meets the documents
    replaced = plain.join(made, ["kind", "value"]).select("entity", rendered(F.col("entity"), F.col("kind"), F.col("made")).alias("new"))
    named = scratch.save(spread_join(people, made, ["kind", "value"]), "named")
    titled = named.select("__key", "entity", rendered(F.col("entity"), F.col("kind"), F.col("made")).alias("new"))
    shown = F.substring("made", 3, 1000)
    later = named.filter(F.col("value").endswith(F.concat(F.lit(":"), F.col("b")))).select("__key", F.col("b").alias("entity"), shown.alias("new"))
    later = later.union(named.select("__key", F.col("last").alias("entity"), F.substring_index(shown, " ", -1).alias("new")))
    later = later.filter(F.length("entity") > 1).groupBy("__key", "entity").agg(F.min("new").alias("new"))
    word = F.concat(F.lit("\\Q"), F.col("entity"), F.lit("\\E"))
    longest = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("entity")).alias("n"), word.alias("w")))), lambda x: x["w"])
    untitled = later.groupBy("__key").agg(F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])")).alias("__pattern"))
    entry = lambda rows, rank: rows.select("__key", F.struct("entity", F.lit(rank).alias("rank"), "new").alias("e"))
    new = entry(spread_join(mentions, replaced, "entity"), 1).union(entry(titled, 2)).union(entry(later, 0))
    sorted_ones = new.groupBy("__key").agg(F.array_sort(F.collect_list("e")).alias("all"))
    # a string that is a titled mention and an untitled one too: the first of its entries
    first = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["entity"] != x["entity"]))
    entries = F.transform(first, lambda x: F.struct(x["entity"], x["new"]))
    maps = sorted_ones.select("__key", F.map_from_entries(entries).alias("__map")).join(untitled, "__key", "left")
    joined = touched.withColumn("__key", row_key).join(maps, "__key", "left")
    # the constant pattern is compiled once, a document's own one for the document
    own = lambda f: F.when(F.col("__pattern").isNull(), f(F.lit(PATTERN))).otherwise(f(F.col("__pattern")))
    joined = joined.withColumns({"__parts": own(lambda p: F.split(text, p, -1)), "__found": own(lambda p: F.regexp_extract_all(text, p, F.lit(0)))})
    shown_as = lambda i: F.coalesce(F.element_at(F.col("__map"), F.get(F.col("__found"), i)), F.get(F.col("__found"), i), F.lit(""))
    pieces = F.transform(F.col("__parts"), lambda part, i: F.concat(part, shown_as(i)))
    replaced_ones = F.filter("__found", lambda x: F.element_at(F.col("__map"), x).isNotNull())
    added = {found_col: F.greatest(F.size(replaced_ones), F.lit(0)).cast("long")} if found_col else {}
    changed = joined.withColumns({**added, text_col: F.array_join(pieces, "")}).drop("__key", "__map", "__pattern", "__parts", "__found")
    same = documents.filter(~has)
    if found_col:
        same = same.withColumn(found_col, F.lit(0).cast("long"))
    return changed.unionByName(same)
