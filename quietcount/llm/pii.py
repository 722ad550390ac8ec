"""PII: surrogate generation in native expressions.

Entities (e-mail addresses, IPv4 and IPv6 addresses, phone and card numbers, persons after a form of address)
are found in whole texts. A person's name is taken part by part: the last name is a surname, earlier ones
are given names with a gender (that of the form of address; after Dr and Prof that of the given name).
Every distinct entity or part, told by kind and canonical form (lower-cased, or digits only), gets one
surrogate for the whole corpus, so mentions stay coreferent, and "Mr Smith" with "Mr John Smith" too.
The surrogate comes from a keyed hash and keeps the type: digits stay digits, letters stay letters of their
script, octets octets of their length, names names of their gender and script; the country code of a phone
number stays, a card number that fulfils the Luhn rule gets a surrogate that does. Each mention is written in
its own format and case. A surrogate that two entities share, or that is itself an entity of the corpus,
is drawn again with the next salt until none is left, so distinct entities stay distinct. Where many are
drawn again the kind's space is crowded, and it grows with the salt: from NAME_SALT on a name gets a
further part each time, from WIDE_SALT on an e-mail address gets letters in front and a phone number of
less than 10 digits gets digits at its end, octets take three digits and then all values.

Texts with a hit are cut into mentions and what lies between once and stored so; only they are shuffled. The
rest pass through the scan. Entities are counted map-side before they meet, and the join back to mentions
is thin, so an entity in a third of the rows costs no more.

Defined results: null text stays null and empty stays empty, with no entities; rows that repeat doc_id
and text get the same text; ties don't arise, as a surrogate that several entities drew stays with the
smallest canonical form; very long texts and words are read whole, in time linear in their length and without recursion; empty tables give
empty results; further columns are kept by `pseudonymised`. Four numbers after "version", "release" or the
like are no address. Up to four capitalised words after a form of address are its names (two after one in capitals), over any white space; a
day, a month, an article or another word of ORDINARY ends them. A capitalised noun right after a surname, as German has them, can't be told
from a further name and is replaced too.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietcount.llm.common import documents, written

#: Setting that holds the secret key; whoever knows it can test guesses of the originals.
KEY_SETTING = "quietcount.pii.key"
#: Rounds in which not one more entity finds a surrogate before the job gives up. Names, addresses and short phone numbers grow with the salt,
#: so only a format of fixed length (a card number, an IPv6 address) of which the corpus holds nearly all numbers can come to that.
IDLE_ROUNDS = 20
#: Salts from which a crowded space grows; before, surrogates keep the entity's lengths.
NAME_SALT, WIDE_SALT, ALL_OCTETS_SALT = 3, 4, 7
#: Forms of address by gender, and names that surrogates are drawn from.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Don")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña")
OTHER_TITLES = ("Dr", "Prof")
TITLES = MALE_TITLES + FEMALE_TITLES + OTHER_TITLES
MALE_NAMES = ("Adam", "Bruno", "Carlo", "David", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Nils", "Oscar", "Paul")
FEMALE_NAMES = ("Anna", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula")
MALE_ENDS = ("us", "bert", "win", "rich", "mund", "hard", "wald", "mar")
FEMALE_ENDS = ("ina", "ella", "issa", "ara", "ona", "ika", "etta", "linde")
SURNAME_STARTS = ("Ash", "Berg", "Cald", "Dorn", "Elm", "Feld", "Grün", "Hart", "Ing", "Jors", "Kest", "Lind", "Mont", "Nord", "Ost", "Peters")
SURNAME_ENDS = ("ford", "mann", "ton", "well", "berg", "son", "stein", "ville", "wood", "hall", "feld", "ley", "mere", "by", "dale", "worth")
CYRILLIC_MALE = ("адам", "борис", "виктор", "глеб", "денис", "егор", "захар", "игорь", "кирилл", "лев", "максим", "олег", "павел", "роман", "степан", "фёдор")
CYRILLIC_FEMALE = ("алла", "белла", "вера", "галина", "дарья", "елена", "зоя", "инна", "ксения", "лариса", "майя", "нина", "ольга", "полина", "рита", "софия")
CYRILLIC_MALE_ENDS = ("слав", "мир", "ян", "ент", "ий", "он", "ил", "ан")
CYRILLIC_FEMALE_ENDS = ("слава", "мира", "яна", "ента", "ия", "она", "ила", "ана")
CYRILLIC_STARTS = ("бел", "верх", "гор", "дуб", "ерм", "жур", "зай", "кал", "лев", "мор", "ник", "ост", "пет", "род", "сав", "том")
CYRILLIC_SURNAME_ENDS = ("енко", "чук", "юк", "ских", "ейко", "ун", "ец", "ак")
GREEK_MALE = ("αλέξης", "βασίλης", "γιώργος", "δημήτρης", "ηλίας", "θωμάς", "κώστας", "λουκάς", "μάρκος", "νίκος", "πέτρος", "σπύρος")
GREEK_FEMALE = ("άννα", "βάσω", "γεωργία", "δήμητρα", "ειρήνη", "ζωή", "κατερίνα", "λίνα", "μαρία", "νίκη", "σοφία", "χριστίνα")
GREEK_MALE_ENDS = ("ανός", "ίνος", "έτος", "άριος")
GREEK_FEMALE_ENDS = ("ανή", "ίνα", "έτα", "άρια")
GREEK_STARTS = ("αγγελ", "βλαχ", "γεωργ", "δημητρ", "ζαχαρ", "καραμ", "λαμπρ", "μακρ", "νικολ", "παπαδ", "σταμ", "χατζ")
GREEK_SURNAME_ENDS = ("άκη", "ίδη", "έλη", "άτου", "ώτη", "ούδη")
#: Given names whose ending misleads; otherwise -a, -e, -а, -я, -α and -η are read as female.
FEMALE_OTHERWISE = ("ruth", "karin", "ingrid", "helen", "susan", "carol", "sarah", "elizabeth", "elisabeth", "margaret", "jennifer", "karen", "ellen", "doris", "iris", "любовь")
MALE_OTHERWISE = ("luca", "joshua", "george", "mike", "steve", "dave", "pierre", "andre", "philippe", "jose", "joe", "uwe", "arne", "никита", "илья", "фома")
#: Country codes of one and two digits; all others have three. A national number keeps its first 0.
COUNTRY_CODE = "^(?:[+]|00)(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})|^0"
#: Letters by script, as Java names it; digits of other scripts become ASCII digits.
ALPHABETS = {
    "Latin": "abcdefghijklmnopqrstuvwxyz",
    "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Armenian": "".join(map(chr, range(0x561, 0x587))),
    "Georgian": "".join(map(chr, range(0x10D0, 0x10F1))),
    "Devanagari": "".join(map(chr, range(0x915, 0x929))),
    "Thai": "".join(map(chr, range(0xE01, 0xE2F))),
    "Hiragana": "".join(map(chr, range(0x3042, 0x3083, 2))),
    "Katakana": "".join(map(chr, range(0x30A2, 0x30E3, 2))),
    "Hangul": "".join(map(chr, range(0xAC00, 0xD7A4, 588))),
    "Han": "".join(map(chr, range(0x4E00, 0x9F00, 256))),
}
#: Patterns of the kinds, in the order in which they are tried at a place.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
LOCAL = r"[\p{L}\p{N}._%+-]"
#: Repeats are possessive: Java matches those in a loop, others by recursion, which long words overflow.
NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’](?=\p{Lu})|-(?=\p{L}))++"
#: White space between the words of a person, line ends too.
GAP = r"[\s\p{Z}]{1,4}+"
#: Words that are no part of a name although they start with a capital where they follow one.
ORDINARY = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonnabend Sonntag Januar Februar März Mai Juni Juli Oktober Dezember "
    "Lundi Mardi Mercredi Jeudi Vendredi Samedi Dimanche Lunes Martes Miércoles Jueves Viernes Sábado Domingo "
    "The A An And Or But If In On At To Of By For From With As Is Was Are Were Be Been Has Had Have Will Would Can Could Should May Might Must Do Does Did Not No "
    "He She It They We You I His Her Their Its This That These Those There Then When Where Who What Why How Said Says Went Came Goes Left Gave Took Made "
    "Der Die Das Den Dem Des Ein Eine Einen Und Oder Aber Wenn Im Am Zum Zur Von Vom Mit Für Auf Aus Bei Nach Als Ist War Sind Waren Hat Hatte Wird Wurde Kann Er Sie Es Wir Ihr Ich Nicht Dann Da "
    "Le La Les Un Une Et Ou Mais Dans Sur Avec Pour Est Était Il Elle Nous Vous Ils El Los Las Una Y O Pero En Con Por Es Era Su"
).split()
NO_NAME = f"(?!(?:{'|'.join(dict.fromkeys(ORDINARY + [w.upper() for w in ORDINARY]))})(?![\\p{{L}}\\p{{M}}'’-]))"
GROUP = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    # starts where a word does, or right after the last find: long words are read once
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{GROUP}:){{7}}{GROUP}|[0-9A-Fa-f]{{4}}(?::{GROUP}){{0,5}}::(?:{GROUP}(?::{GROUP}){{0,5}})?)(?![\p{{L}}\p{{N}}:]|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
    r"|(?<![\p{L}\d.,])00[1-9]\d{0,2}(?:[ .-]\d{2,9}){2,4}(?![\d.]\d|\d)|(?<![\p{L}\d.,])0[1-9]\d{1,3}[ /-]\d{3,4}[ -]?\d{3,4}(?![\d.,]\d|\d)",
    "card": r"(?<![\p{L}\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\p{L}\d])",
    "person": rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.?{GAP}{NO_NAME}{NAME}(?:{GAP}{NO_NAME}{NAME}){{0,3}}"
    rf"|(?:{'|'.join(t.upper() for t in TITLES)})\.?{GAP}{NO_NAME}{NAME}(?:{GAP}{NO_NAME}{NAME})?)",
}
#: What stands before four numbers of a version.
VERSION = r"(?<!\b(?i:version|release|build|ver|v)[ .:]{0,2})"
ANY = "|".join(f"(?:{VERSION if k == 'ip' else ''}{p})" for k, p in PATTERNS.items())
#: Cheap test that every text with an entity passes.
MAYBE = rf"[@0-9]|::|{'|'.join(TITLES + tuple(t.upper() for t in TITLES))}"


def quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def values() -> Column:
    """Array of the mentions in `text`, in their order."""
    return F.expr(f"CASE WHEN text RLIKE '{quoted(MAYBE)}' THEN regexp_extract_all(text, '{quoted(ANY)}', 0) ELSE array() END")


def holds() -> Column:
    """Whether `text` holds an entity."""
    return F.coalesce(F.col("text").rlike(MAYBE) & F.col("text").rlike(ANY), F.lit(False))


def listed(options: tuple[str, ...]) -> str:
    return ", ".join(f"'{o}'" for o in options)


def kind_of(value: Column) -> Column:
    out = F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for kind in ("ip", "ip6", "phone", "card"):
        out = out.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("person")


def parts() -> Column:
    """Array of struct(part, kind, canonical, mention, lead) of a mention (kind, value): the names of a person,
    whose kinds are given_m, given_f and surname, or the mention itself; lead is the text before the part."""
    canonical = """CASE WHEN kind = 'phone' THEN concat(CASE WHEN value LIKE '+%' THEN '+' ELSE '' END, regexp_replace(value, '[^0-9]', ''))
        WHEN kind = 'card' THEN regexp_replace(value, '[^0-9]', '') ELSE lower(value) END"""
    female = f"""CASE WHEN lower(regexp_replace(words[0], '[.]', '')) IN ({listed(tuple(t.lower() for t in FEMALE_TITLES))}) THEN true
        WHEN lower(regexp_replace(words[0], '[.]', '')) IN ({listed(tuple(t.lower() for t in MALE_TITLES))}) THEN false
        WHEN lower(w) IN ({listed(FEMALE_OTHERWISE)}) THEN true WHEN lower(w) IN ({listed(MALE_OTHERWISE)}) THEN false
        ELSE lower(w) RLIKE '[aeаяαη]$' END"""
    names = f"""transform(slice(words, 2, size(words)), (w, i) -> named_struct('part', i,
        'kind', CASE WHEN i = size(words) - 2 THEN 'surname' WHEN {female} THEN 'given_f' ELSE 'given_m' END,
        'canonical', lower(w), 'mention', w, 'lead', concat(CASE WHEN i = 0 THEN words[0] ELSE '' END, regexp_extract_all(value, '{quoted(GAP)}', 0)[i])))"""
    return F.expr(f"""CASE WHEN kind = 'person' THEN transform(array(split(value, '{quoted(GAP)}')), words -> {names})[0]
        ELSE array(named_struct('part', 0, 'kind', kind, 'canonical', {canonical}, 'mention', value, 'lead', '')) END""")


def _digit(at: str) -> str:
    """A digit from 4 hex digits of the hash h, for 0-based place `at`."""
    return f"pmod(cast(conv(substring(h, 1 + pmod(4 * ({at}), 60), 4), 16, 10) AS bigint) + ({at}) div 15 * 7, {{}})"


def _names(options: tuple[str, ...], at: int | str) -> str:
    return f"element_at(array({listed(options)}), 1 + cast({_digit(str(at)).format(len(options))} AS int))"


def _name(starts: tuple[str, ...], ends: tuple[str, ...], composed: bool) -> str:
    """A name from starts (with an end if composed), longer by an end for every salt from NAME_SALT on."""
    more = f"CASE WHEN salt < {NAME_SALT} THEN '' ELSE array_join(transform(sequence({NAME_SALT}, salt), i -> {_names(ends, 'i')}), '') END"
    return f"lower(concat({_names(starts, 1)}, {_names(ends, 2) if composed else chr(39) * 2}, {more}))"


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canonical, salt) with `surrogate`, in canonical form."""
    hashed = entities.withColumn("h", F.sha2(F.concat_ws("\0", F.lit(key), "kind", "canonical", F.col("salt").cast("string")), 256))
    pick = _digit("i")
    scripts = "\n".join(f"WHEN c RLIKE '[\\\\p{{Is{k}}}&&\\\\p{{L}}]' THEN substring('{v}', 1 + cast({pick.format(len(v))} AS int), 1)" for k, v in ALPHABETS.items())
    latin = ALPHABETS["Latin"]
    letters = f"""CASE WHEN c RLIKE '\\\\p{{N}}' THEN cast({pick.format(10)} AS string) {scripts}
        WHEN c RLIKE '\\\\p{{L}}' THEN substring('{latin}', 1 + cast({pick.format(len(latin))} AS int), 1) ELSE c END"""
    more = f"greatest(salt - {WIDE_SALT - 1}, 0)"
    # an address grows by its own first letter or digit, so in its script; its top-level name stays
    first = "coalesce(nullif(regexp_extract(canonical, '[\\\\p{L}0-9]', 0), ''), 'a')"
    email = f"concat(array_join(transform(split(concat(repeat({first}, {more}), regexp_extract(canonical, '^(.*)\\\\.[^.]*$', 1)), ''), (c, i) -> {letters}), ''), '.', regexp_extract(canonical, '([^.]*)$', 1))"
    hexed = f"array_join(transform(split(canonical, ''), (c, i) -> CASE WHEN c = ':' THEN c ELSE lower(hex({pick.format(16)})) END), '')"
    octet = f"CASE WHEN salt >= {ALL_OCTETS_SALT} THEN 1 + {pick.format(254)} WHEN salt >= {WIDE_SALT} THEN 100 + {pick.format(155)} ELSE CASE length(c) WHEN 1 THEN 1 + {pick.format(9)} WHEN 2 THEN 10 + {pick.format(90)} ELSE 100 + {pick.format(155)} END END"
    ip = f"array_join(transform(split(canonical, '\\\\.'), (c, i) -> cast({octet} AS string)), '.')"
    # up to 6 more digits always fit the pattern's last groups
    longer = f"CASE WHEN length(regexp_replace(canonical, '[+]', '')) < 10 THEN repeat('0', least({more}, 6)) ELSE '' END"
    code = f"regexp_extract(canonical, '{COUNTRY_CODE}', 0)"
    phone = f"concat({code}, array_join(transform(split(concat(substring(canonical, 1 + length({code})), {longer}), ''), (c, i) -> cast({pick.format(10)} AS string)), ''))"

    def luhn(digits: str) -> str:
        """Sum of a number whose digit before the last check digit is doubled first."""
        doubled = "CASE WHEN i % 2 = 1 THEN cast(d AS int) WHEN cast(d AS int) > 4 THEN 2 * cast(d AS int) - 9 ELSE 2 * cast(d AS int) END"
        return f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> {doubled}), 0, (a, x) -> a + x)"

    # the issuer's digit stays
    body = f"concat(substring(canonical, 1, 1), array_join(transform(split(substring(canonical, 2, length(canonical) - 2), ''), (c, i) -> cast({pick.format(10)} AS string)), ''))"
    check = "cast(pmod(10 - {}, 10) AS string)"
    valid = f"{check.format(luhn('left(canonical, length(canonical) - 1)'))} = right(canonical, 1)"
    card = f"transform(array({body}), b -> concat(b, CASE WHEN {valid} THEN {check.format(luhn('b'))} ELSE cast({_digit('0').format(10)} AS string) END))[0]"
    forms = {
        "surname": [(CYRILLIC_STARTS, CYRILLIC_SURNAME_ENDS), (GREEK_STARTS, GREEK_SURNAME_ENDS), (SURNAME_STARTS, SURNAME_ENDS)],
        "given_m": [(CYRILLIC_MALE, CYRILLIC_MALE_ENDS), (GREEK_MALE, GREEK_MALE_ENDS), (MALE_NAMES, MALE_ENDS)],
        "given_f": [(CYRILLIC_FEMALE, CYRILLIC_FEMALE_ENDS), (GREEK_FEMALE, GREEK_FEMALE_ENDS), (FEMALE_NAMES, FEMALE_ENDS)],
    }
    # names of other scripts are drawn by letter, and grow by their own first letter
    other = f"array_join(transform(split(concat(canonical, repeat(left(canonical, 1), {more})), ''), (c, i) -> {letters}), '')"
    named = []
    for kind, of_script in forms.items():
        cases = " ".join(
            f"WHEN canonical RLIKE '^\\\\p{{Is{script}}}' THEN {_name(*lists, kind == 'surname')}"
            for script, lists in zip(("Cyrillic", "Greek", "Latin"), of_script, strict=True)
        )
        named.append(f"WHEN '{kind}' THEN CASE {cases} ELSE {other} END")
    form = f"CASE kind WHEN 'email' THEN {email} WHEN 'ip' THEN {ip} WHEN 'ip6' THEN {hexed} WHEN 'phone' THEN {phone} {' '.join(named)} ELSE {card} END"
    return hashed.withColumn("surrogate", F.expr(form)).drop("h")


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical, surrogate of every entity; no surrogate twice, none that is an entity."""
    now = written(surrogates(entities.withColumn("salt", F.lit(0)), key), "surrogates")
    taken = entities.select("kind", F.col("canonical").alias("surrogate"))
    placed, idle = 0, 0
    while True:
        first = now.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"), F.count(F.lit(1)).alias("n"))
        clash = first.join(taken.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left").where("n > 1 OR real")
        again = now.join(clash, ["kind", "surrogate"]).where("real OR canonical <> first").select("kind", "canonical", (F.col("salt") + 1).alias("salt"))
        again = written(again, "again")
        left = again.count()
        if not left:
            return now.select("kind", "canonical", "surrogate")
        idle = idle + 1 if placed and left >= placed else 0
        placed = left
        if idle == IDLE_ROUNDS:
            raise RuntimeError(f"{left} entities find no surrogate: every number of their format is an entity")
        fresh = surrogates(again, key).select("kind", "canonical", "salt", "surrogate")
        kept = now.select("kind", "canonical", "salt", "surrogate").join(again, ["kind", "canonical"], "left_anti")
        now = written(kept.unionByName(fresh), "surrogates")


def rendered() -> Column:
    """The surrogate in the format and case of the mention, after what led to it."""
    # a number's digits are set into the mention's places, from its first to its last; further ones follow
    number = """transform(array(regexp_replace(surrogate, '[^0-9]', '')), n -> aggregate(split(mention, ''), named_struct('at', 0, 'out', ''),
        (a, c) -> CASE WHEN c RLIKE '[0-9]' THEN named_struct('at', a.at + 1, 'out', concat(a.out, substring(n, a.at + 1, 1)))
                  ELSE named_struct('at', a.at, 'out', concat(a.out, c)) END, a -> concat(a.out, substring(n, a.at + 1))))[0]"""
    # each letter takes the case of the one it replaces; letters that an address grew by come first
    cased = """transform(array(named_struct('m', split(mention, ''), 'more', length(surrogate) - length(mention))), x ->
        array_join(transform(split(surrogate, ''), (c, i) -> CASE WHEN x.m[greatest(i - x.more, 0)] RLIKE '\\\\p{Lu}' THEN upper(c) ELSE c END), ''))[0]"""
    name = "CASE WHEN mention = upper(mention) THEN upper(surrogate) ELSE concat(upper(left(surrogate, 1)), substring(surrogate, 2)) END"
    return F.expr(f"concat(lead, CASE WHEN kind IN ('phone', 'card') THEN {number} WHEN kind IN ('email', 'ip', 'ip6') THEN {cased} ELSE {name} END)")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, and n_entities, n_email, n_ip, n_phone, n_card, n_person (which
    take the place of columns of these names)."""
    kinds = list(PATTERNS)
    docs = docs.drop("n_entities", *[f"n_{k}" for k in kinds])
    others = [c for c in docs.columns if c != "text"]
    # rows travel as one struct, so no column of docs can clash with those made here
    docs = docs.select(F.struct(*others).alias("row"), "text")
    cut = docs.withColumn("found", values()).where("size(found) > 0").withColumn("gaps", F.split("text", ANY))
    cut = written(cut.select(F.monotonically_increasing_id().alias("uid"), "row", "gaps", "found"), "mentions")
    found = cut.select("uid", F.posexplode("found").alias("at", "value")).withColumn("kind", kind_of(F.col("value")))
    found = found.select("uid", "at", F.explode(parts()).alias("x")).select("uid", "at", "x.*")
    table = distinct_surrogates(written(found.select("kind", "canonical").distinct(), "entities"), key)
    new = found.join(table, ["kind", "canonical"]).withColumn("new", rendered())
    pieces = new.groupBy("uid").agg(F.collect_list(F.struct("at", "part", "kind", "new")).alias("pieces"))
    between = "transform(gaps, (g, i) -> named_struct('at', i, 'part', -1, 'kind', '', 'new', g))"
    woven = F.expr(f"array_join(transform(array_sort(concat({between}, pieces)), x -> x.new), '')")
    person = "x.kind IN ('surname', 'given_m', 'given_f')"
    counts = [F.expr(f"cast(size(filter(pieces, x -> x.part = 0 AND {person if k == 'person' else f'x.kind = {chr(39)}{k}{chr(39)}'})) AS bigint)").alias(f"n_{k}") for k in kinds]
    changed = cut.join(pieces, "uid").select("row.*", woven.alias("text"), F.size("found").cast("long").alias("n_entities"), *counts)
    zero = F.lit(0).cast("long")
    plain = docs.where(~holds()).select("row.*", "text", zero.alias("n_entities"), *[zero.alias(f"n_{k}") for k in kinds])
    return changed.unionByName(plain)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the setting; without it every run draws one of its own and forgets it."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    return pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), key)


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
