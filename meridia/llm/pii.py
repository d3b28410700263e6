"""PII: detected entities become keyed surrogates of the same type, script and format.

Kinds: e-mail, IPv4, phone, card (13 to 19 digits), US social security number, IBAN
and names: a listed first name and a surname, a title and one or two names, or one or
two names after words that introduce one ("my name is", "Dear", "ich heiße", "me llamo").

*Coreference.* What is permuted is an entity's ``unit``: the digits of a phone without its
country code, of a card and a social security number, an IBAN's account, an e-mail in
lower case, a name's word in lower case. ``rendered`` puts a unit's surrogate back into
the entity's format and case. So one number in three formats, ``ana@`` and ``Ana@``, and
a full name and its surname get matching surrogates, everywhere.

*Surrogates.* A unit's surrogate is a keyed permutation of the units of its form: a
Feistel network on the two halves of its characters that moves each character within its
own alphabet (digits, vowels, consonants, accented letters, Cyrillic, Greek, by case; any
other letter among its neighbours in Unicode of its case) and leaves what is no letter or
digit. The first of a few keys counts under which no more than a quarter of the letters
and digits stay in their places. Phones keep the country code, cards the first digit and
whether Luhn's check holds, addresses stay four bytes, IBANs keep the country and whether
their check digits are right, e-mails the top domain. Listed first names go round their
list of one language and gender in an order by the key.

*Collisions.* A surrogate could be a unit that the corpus has itself, or, as keys differ,
another unit's surrogate. ``assign`` joins surrogates to units, and gives those that
collide further attempts under another key. What still collides after these, as where a
short form has as many units as surrogates, gets a longer surrogate: a number
of its own is added, in letters for names, at the start of e-mails and else at the end.
Such a one keeps its kind's format only as far as that can grow. Listed first names are
drawn from few, and so are no part of this: it is the surname that tells names apart.

All is built-in expressions: matches are found once, transformed as an array, and put
between the pieces that the same expression splits off. No row leaves the JVM.

Edge cases: a null text stays null, an empty one empty, both without entities. Time is
linear in the text: no pattern starts inside a run that it already refused, and repeats
are bounded. Repeated rows and ties change nothing, as surrogates depend on the entity
alone; rows that share an id share the entities that were given further attempts. An
empty table gives an empty result; only the named columns are read, and ``replace``
passes others on unchanged, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import fresh, written

KINDS = ("email", "ip", "phone", "card", "ssn", "iban", "name")

#: First names that are detected and drawn from, by language and gender.
FIRST_NAMES = {
    ("en", "f"): "Emily Sarah Jessica Hannah Olivia Charlotte Megan Rachel Abigail Heather Mary Linda Susan Karen".split(),
    ("en", "m"): "James William Michael Andrew Matthew Joshua Christopher Ethan Benjamin Jonathan John Robert David Thomas".split(),
    ("de", "f"): "Anna Katharina Sabine Ursula Monika Heike Claudia Ingrid Petra Birgit".split(),
    ("de", "m"): "Jürgen Stefan Wolfgang Klaus Dieter Matthias Uwe Thorsten Günther Heinrich".split(),
    ("fr", "f"): "Camille Élodie Mathilde Chloé Manon Amélie Juliette Océane Margaux Léa".split(),
    ("fr", "m"): "Julien Mathieu Antoine Nicolas Guillaume Étienne François Sébastien Rémi Thibault".split(),
    ("es", "f"): "María Carmen Lucía Pilar Dolores Inés Rocío Marta Beatriz Alejandra Ana Laura Isabel Elena".split(),
    ("es", "m"): "José Javier Alejandro Fernando Joaquín Íñigo Álvaro Gonzalo Rodrigo Ramón Juan Carlos Luis Miguel".split(),
    ("hi", "f"): "Priya Anjali Pooja Divya Sunita Kavita Neha Meera".split(),
    ("hi", "m"): "Rahul Amit Arjun Vikram Sanjay Rajesh Anil Suresh".split(),
    ("ar", "f"): "Fatima Aisha Layla Zainab Maryam Huda Salma Amina".split(),
    ("ar", "m"): "Mohammed Ahmed Hassan Ibrahim Mustafa Khalid Yusuf Omar".split(),
    ("zh", "f"): "Fang Xiu Yan Ling Mei Hui Xia Na".split(),
    ("zh", "m"): "Wei Jun Jie Lei Qiang Hao Ming Tao".split(),
    ("ru", "f"): "Анна Ольга Татьяна Наталья Екатерина Светлана Ирина Юлия".split(),
    ("ru", "m"): "Иван Дмитрий Сергей Алексей Андрей Николай Владимир Михаил".split(),
}
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Sra)\.?"

ALPHABETS = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "AEIOU",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâãäåæèéêëìíîïòóôõöøùúûü",
    "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ",
    "çñßýÿ",
    "ÇÑÝ",
    "абвгдежзиклмнопрстуфхцчшщэюя",
    "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)

#: Letters whose case is folded: those of alphabets that have a twin in the other case, in the same order.
LOWER = "".join(x for x in ALPHABETS if x != x.upper() and x.upper() in ALPHABETS)
UPPER = LOWER.upper()

#: Letters that ALPHABETS leaves out and that belong together.
FURTHER = ("йёъыь", "ЙЁЪЫЬ", "άέήίόύώϊϋΐΰς", "ΆΈΉΊΌΎΏΪΫ")


def _other_letters() -> tuple[list[str], list[tuple[int, int]]]:
    """All letters that ALPHABETS leaves out: groups of one script, case and row of 128 code points, and ranges of rows full of one kind."""
    listed, rows = set("".join(ALPHABETS + FURTHER)), defaultdict(list)
    for code in range(128, 0x110000):
        if (case := unicodedata.category(chr(code)))[0] == "L" and chr(code) not in listed:
            rows[case, unicodedata.name(chr(code), "").split(" ")[0], code >> 7].append(chr(code))
    groups, few, ranges = list(FURTHER), defaultdict(list), []
    for (case, _, row), letters in rows.items():
        if len(letters) == 128:
            if ranges and ranges[-1][1] == row << 7:
                ranges[-1] = (ranges[-1][0], (row + 1) << 7)
            else:
                ranges.append((row << 7, (row + 1) << 7))
        elif len(letters) < 5:
            few[case] += letters
        else:
            groups.append("".join(letters))
    return groups + ["".join(x) for x in few.values()], ranges


OTHER_GROUPS, OTHER_RANGES = _other_letters()

#: Words that introduce a name; a look back from a capital letter only.
CUES = "[Mm]y name is|[Dd]ear|[Ss]igned|[Rr]egards,|[Ss]incerely,|je m'appelle|ich heiße|mein Name ist|me llamo|mi nombre es|меня зовут"
NO_NAMES = "Sir|Sirs|Madam|All|Team|Customer|Customers|Colleague|Colleagues|Friend|Friends|God|Editor|Reader|Readers"
#: Country codes of phones; after ITU-T E.164, all that are not listed have three digits.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SURNAME = r"\p{Lu}[\p{L}'-]{1,40}"
_FIRST = "|".join(sorted((x for names in FIRST_NAMES.values() for x in names), key=lambda x: (-len(x), x)))
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,24}",
    "ip": rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "phone": r"(?=[+(\d])(?:(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?=\d)(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-])",
    "iban": r"(?=[A-Z]{2}\d\d)(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?=[A-ZÀ-ÞА-Я])(?<![\p{{L}}'-])(?:(?:{_FIRST}) {_SURNAME}|{TITLES} {_SURNAME}(?: {_SURNAME})?|(?<=(?<!\p{{L}})(?:{CUES}) )(?!(?:{NO_NAMES})(?!\p{{L}})){_SURNAME}(?: {_SURNAME})?)",
}
#: Each alternative starts with what its first character can be, so most places cost one look.
ENTITY = "|".join(PATTERNS.values())
#: What can be found in a text without @, and in one without digits too.
WITHOUT_AT, WITHOUT_DIGITS = "|".join(p for k, p in PATTERNS.items() if k != "email"), PATTERNS["name"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _number(hexes: Column, at: Column) -> Column:
    """Four hexadecimal digits as a number."""
    return F.conv(F.substring(hexes, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _other(c: Column, by: Column) -> Column:
    """A character outside ASCII and ALPHABETS: a letter moves on in its group or row, others stay."""
    code = F.ascii(c)
    letter = F.decode(F.unhex(F.lpad(F.hex(code - code % 128 + (code + by) % 128), 8, "0")), "UTF-32")
    groups = F.split(F.lit("|".join(OTHER_GROUPS)), r"\|")
    return F.when(reduce(or_, (code.between(a, z - 1) for a, z in OTHER_RANGES)), letter).otherwise(
        let(
            F.get(F.filter(groups, lambda g: F.instr(g, c) > 0), F.lit(0)),
            lambda g: F.when(g.isNotNull(), F.substring(g, F.pmod(F.instr(g, c) - 1 + by, F.length(g)) + 1, F.lit(1))).otherwise(c),
        )
    )


#: For each letter of all alphabets, where its own starts and how long that is, as characters from 256 on.
_STARTS = "".join(chr(256 + "".join(ALPHABETS).index(x[0])) * len(x) for x in ALPHABETS)
_SIZES = "".join(chr(256 + len(x)) * len(x) for x in ALPHABETS)


def _shifted(text: Column, seed: Column) -> Column:
    """Each character moved on in its alphabet, by what a hash of ``seed`` says for its place."""
    every = F.lit("".join(ALPHABETS))
    of = lambda values, at: F.ascii(F.substring(F.lit(values), at, F.lit(1))) - 256
    within = lambda at, by: let(of(_STARTS, at), lambda start: start + F.pmod(at - 1 - start + by, of(_SIZES, at)) + 1)
    moved = lambda c, by: let(
        F.instr(every, c), lambda at: F.when(at > 0, F.substring(every, within(at, by), F.lit(1))).when(F.ascii(c) > 127, _other(c, by)).otherwise(c)
    )
    return let(F.sha2(seed, 256), lambda h: F.array_join(F.transform(_characters(text), lambda c, i: moved(c, _number(h, i % 16))), ""))


def permuted(text: Column, key: Column, tag: Column) -> Column:
    """Four half rounds of a Feistel network on the halves of ``text``."""
    seed = lambda n, half: F.concat(key, F.lit("|"), tag, F.lit(f"|{n}|"), half)
    return let(
        F.floor(F.length(text) / 2).cast("int"),
        lambda n: let(
            F.substring(text, F.lit(1), n),
            lambda a: let(
                F.substring(text, n + 1, F.length(text)),
                lambda b: let(
                    _shifted(a, seed(1, b)),
                    lambda a1: let(
                        _shifted(b, seed(2, a1)),
                        lambda b1: let(_shifted(a1, seed(3, b1)), lambda a2: F.concat(a2, _shifted(b1, seed(4, a2)))),
                    ),
                ),
            ),
        ),
    )


def _ip(entity: Column, key: Column) -> Column:
    """The four bytes permuted as two halves of 16 bits."""
    part = lambda i: F.element_at(F.split(entity, r"\."), i).cast("int")
    move = lambda x, n, y: F.pmod(x + _number(F.sha2(F.concat(key, F.lit(f"|ip|{n}|"), y.cast("string")), 256), F.lit(0)), F.lit(65536))
    shown = lambda x: F.concat_ws(".", F.floor(x / 256).cast("int").cast("string"), F.pmod(x, F.lit(256)).cast("string"))
    return let(
        part(3) * 256 + part(4),
        lambda low: let(
            move(part(1) * 256 + part(2), 1, low),
            lambda high: let(move(low, 2, high), lambda low1: let(move(high, 3, low1), lambda high1: F.concat_ws(".", shown(high1), shown(move(low1, 4, high1))))),
        ),
    )


def _luhn(digits: Column) -> Column:
    """The digit that Luhn's check wants after ``digits``."""
    values = F.transform(F.split(F.reverse(digits), "(?!$)"), lambda d, i: F.when(i % 2 == 0, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.pmod(-F.aggregate(values, F.lit(0), lambda a, x: a + x), F.lit(10))


def _check_digit(old: Column, new: Column) -> Column:
    """The last digit of a card, as far from Luhn's digit as the old one was."""
    only = lambda x: F.regexp_replace(x, "[^0-9]", "")
    body = F.substring(old, F.lit(1), F.length(old) - 1)
    return F.pmod(F.right(old, F.lit(1)).cast("int") - _luhn(only(body)) + _luhn(only(new)), F.lit(10)).cast("string")


def _first_name(name: Column, key: Column) -> Column:
    """The name that follows in its list, in an order that the key says; null if in no list."""
    lists = F.split(F.lit(";".join(",".join(names) for names in FIRST_NAMES.values())), ";")
    own = F.get(F.filter(F.transform(lists, lambda x: F.split(x, ",")), lambda names: F.array_contains(names, name)), F.lit(0))
    ordered = lambda names: F.transform(F.sort_array(F.transform(names, lambda n: F.struct(F.sha2(F.concat(key, F.lit("|first|"), n), 256).alias("h"), n.alias("n")))), lambda x: x["n"])
    return let(ordered(own), lambda names: F.get(names, F.pmod(F.array_position(names, name).cast("int"), F.size(names))))


def _is_word_of_name(word: Column) -> Column:
    """A word of a name that is no title and in no list."""
    return ~word.rlike(f"^(?:{TITLES}|{_FIRST})$")


def kind_of(entity: Column) -> Column:
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(entity.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(entity.rlike(r"^[A-Z]{2}\d"), "iban")
        .when(entity.rlike(r"^\d"), "card")
        .otherwise("name")
    )


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def refold(new: Column, old: Column) -> Column:
    """``new`` in upper case where ``old`` is, place by place."""
    upper = lambda x: F.translate(x, LOWER, UPPER)
    at = lambda i: F.substring(old, i + 1, F.lit(1))
    each = F.array_join(F.transform(_characters(new), lambda c, i: F.when(at(i) != fold(at(i)), upper(c)).otherwise(c)), "")
    first = lambda x: F.concat(upper(F.substring(x, F.lit(1), F.lit(1))), F.substring(x, F.lit(2), F.length(x)))
    return let(fold(old), lambda low: F.when(low == old, new).when(old == first(low), first(new)).when(old == upper(low), upper(new)).otherwise(each))


#: What an entity keeps beside its unit, in front and behind.
_COUNTRY_START, _TOP_DOMAIN = f"^(?:{COUNTRY})?", r"\.[A-Za-z]+$"


def _front(entity: Column, kind: Column) -> Column:
    return F.when(kind == "phone", F.regexp_extract(entity, _COUNTRY_START, 0)).otherwise("")


def _unit(entity: Column, kind: Column) -> Column:
    """What of an entity that is no name is permuted."""
    return (
        F.when(kind == "email", fold(F.regexp_replace(entity, _TOP_DOMAIN, "")))
        .when(kind == "ip", entity)
        .when(kind == "iban", F.replace(entity, F.lit(" ")))
        .otherwise(F.regexp_replace(F.substring(entity, F.length(_front(entity, kind)) + 1, F.length(entity)), "[^0-9]", ""))
    )


def _parts(entity: Column, kind: Column) -> Column:
    """Units of an entity: one, or of a name one a word, null for titles and listed names."""
    words = F.transform(F.split(entity, " "), lambda w: F.when(_is_word_of_name(w), fold(w)))
    return F.when(kind == "name", words).otherwise(F.array(_unit(entity, kind)))


def units_of(entity: Column) -> Column:
    """Array of struct (kind, unit): the words of a name, the one unit of all else."""
    return let(kind_of(entity), lambda kind: F.transform(F.array_compact(_parts(entity, kind)), lambda unit: F.struct(kind.alias("kind"), unit.alias("unit"))))


def _filled(shape: Column, new: Column, slot: Callable[[Column], Column]) -> Column:
    """``shape`` with the characters of ``new`` in its slots, what is left of them behind."""
    step = lambda acc, c: F.struct(
        F.concat(acc["out"], F.when(slot(c), F.substring(new, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["n"] + slot(c).cast("int")).alias("n")
    )
    return F.aggregate(
        _characters(shape), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda acc: F.concat(acc["out"], F.substring(new, acc["n"] + 1, F.length(new)))
    )


def _formatted(entity: Column, kind: Column, new: Column) -> Column:
    """An entity that is no name with ``new`` for its unit."""
    front = _front(entity, kind)
    rest = F.substring(entity, F.length(front) + 1, F.length(entity))
    return (
        F.when(kind == "email", F.concat(refold(new, F.regexp_replace(entity, _TOP_DOMAIN, "")), F.regexp_extract(entity, _TOP_DOMAIN, 0)))
        .when(kind == "ip", new)
        .when(kind == "iban", _filled(entity, new, lambda c: c != " "))
        .otherwise(F.concat(front, F.when(F.length(rest) <= F.length(new), new).otherwise(_filled(rest, new, lambda c: F.instr(F.lit("0123456789"), c) > 0))))
    )


def rendered(entity: Column, of_unit: Callable[[Column, Column], Column], key: Column) -> Column:
    """The entity with what ``of_unit`` gives for (kind, unit), and with other first names."""
    word = lambda w, new: F.coalesce(refold(new, w), _first_name(w, key), w)
    shown = lambda kind, news: F.when(kind == "name", F.array_join(F.zip_with(F.split(entity, " "), news, word), " ")).otherwise(_formatted(entity, kind, F.get(news, F.lit(0))))
    return let(kind_of(entity), lambda kind: let(F.transform(_parts(entity, kind), lambda unit: F.when(unit.isNotNull(), of_unit(kind, unit))), lambda news: shown(kind, news)))


def _mod_97(text: Column) -> Column:
    """The number that an IBAN's characters spell, letters being 10 to 35, modulo 97."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(_characters(text), F.lit(0), lambda acc, c: F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)))


def _iban_check(old: Column, new: Column) -> Column:
    """Check digits for the account ``new``, as far from the right ones as those of ``old`` (a whole IBAN) were."""
    country = F.substring(old, F.lit(1), F.lit(2))
    right = lambda account: 98 - _mod_97(F.concat(account, country, F.lit("00")))
    digits = F.substring(old, F.lit(3), F.lit(2)).cast("int")
    moved = F.pmod(digits - 2 + right(new) - right(F.substring(old, F.lit(5), F.length(old))), F.lit(97)) + 2
    return F.lpad(F.when(digits.between(2, 98), moved).otherwise(digits).cast("string"), 2, "0")


def _alike(old: Column, new: Column) -> Column:
    """How many letters and digits are in their old places."""
    return F.size(F.filter(F.zip_with(_characters(old), _characters(new), lambda a, b: (a == b) & (F.instr(F.lit("@.-_+%' "), a) == 0)), lambda x: x))


#: Keys that are tried for a surrogate that looks little like its unit.
TRIES = 6


def _unlike(core: Column, kind: Column, key: Column) -> Column:
    """``core`` permuted under the first key that leaves a quarter of it in place at most."""
    few = lambda new: _alike(core, new) * 4 <= F.length(core)
    tried = lambda i: let(permuted(core, F.concat(key, F.lit("|"), i.cast("string")), kind), lambda new: F.when((i == TRIES - 1) | few(new), new))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("string"), lambda acc, i: F.coalesce(acc, tried(i)))


def unit_surrogate(kind: Column, unit: Column, key: Column) -> Column:
    cut = lambda start, end: F.substring(unit, F.lit(start + 1), F.length(unit) - start - end)
    account = lambda x: F.concat(F.substring(unit, F.lit(1), F.lit(2)), _iban_check(unit, x), x)
    card = lambda x: let(F.concat(F.substring(unit, F.lit(1), F.lit(1)), x), lambda new: F.concat(new, _check_digit(unit, new)))
    core = F.when(kind == "iban", cut(4, 0)).when(kind == "card", cut(1, 1)).otherwise(unit)
    changed = lambda x: F.when(kind == "iban", account(x)).when(kind == "card", card(x)).otherwise(x)
    return F.when(kind == "ip", _ip(unit, key)).otherwise(let(core, lambda c: let(_unlike(c, kind, key), changed)))


def surrogate(entity: Column, key: Column) -> Column:
    """The entity's surrogate under ``key``."""
    return rendered(entity, lambda kind, unit: unit_surrogate(kind, unit, key), key)


def entities(text: str | Column) -> Column:
    """All entities of a text, in order; what it can't hold for want of @ or digits isn't looked for."""
    text = F.col(text) if isinstance(text, str) else text
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.contains("@"), found(ENTITY)).when(text.rlike("[0-9]"), found(WITHOUT_AT)).otherwise(found(WITHOUT_DIGITS))


def _keyed(key: str, attempt: Column | int) -> Column:
    return F.concat(F.lit(f"{key}|"), (F.lit(attempt) if isinstance(attempt, int) else attempt).cast("string"))


UNIT = ["kind", "unit"]


def _colliding(given: DataFrame) -> DataFrame:
    """Units whose surrogate is a unit, a listed name or, but for one of them, shared."""
    listed = [x.translate(str.maketrans(UPPER, LOWER)) for names in FIRST_NAMES.values() for x in names]
    named = given.filter((F.col("kind") == "name") & F.col("surrogate").isin(listed)).select(*UNIT)
    taken = given.join(given.select("kind", F.col("unit").alias("surrogate")), ["kind", "surrogate"], "left_semi").select(*UNIT)
    shared = given.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.max("unit").alias("unit")).filter("n > 1").select(*UNIT)
    return written(taken.unionByName(named).unionByName(shared).distinct(), "collisions")


def _lengthened(kind: Column, base: Column, number: Column) -> Column:
    """``base`` with the digits of ``number``, as letters for a name."""
    letters = lambda x: F.translate(number, "0123456789", x)
    name = F.concat(base, F.when(base.rlike(r"\p{IsCyrillic}$"), letters("бвгджзклмн")).when(base.rlike(r"\p{IsGreek}$"), letters("βγδζθκλμνπ")).otherwise(letters("bcdfghjklm")))
    return F.when(kind == "email", F.concat(number, base)).when(kind == "name", name).otherwise(F.concat(base, number))


def _given_longer(given: DataFrame, bad: DataFrame) -> DataFrame:
    """``given`` with longer surrogates for the units of ``bad``, none of which collides.

    Each unit has a number of its own, and all numbers have so many digits, so no two of a
    round are the same. Those that meet a unit or a surrogate given before get a digit
    more; as these are so many and so long only, that ends.
    """
    every = given.select("kind", F.col("unit").alias("surrogate"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*UNIT))
    left = given.join(bad, UNIT, "left_semi").select("*", F.pmod(F.xxhash64(*UNIT), F.lit(PARTS)).alias("part"))
    left = written(left.select(*UNIT, "attempt", F.col("surrogate").alias("base"), ((own - 1) * PARTS + F.col("part")).cast("long").alias("number")), "collisions")
    kept = given.join(bad, UNIT, "left_anti").select(*UNIT, "attempt", "surrogate")
    digits = len(str(left.agg(F.max("number")).first()[0]))
    while not left.isEmpty():
        number = F.lpad(F.col("number").cast("string"), digits, "0")
        tried = written(left.select(*UNIT, (F.col("attempt") + 1).alias("attempt"), _lengthened(F.col("kind"), F.col("base"), number).alias("surrogate")), "surrogates")
        met = written(tried.join(every.unionByName(kept.select("kind", "surrogate")), ["kind", "surrogate"], "left_semi").select(*UNIT), "collisions")
        kept = written(kept.unionByName(tried.join(met, UNIT, "left_anti")), "surrogates")
        left, digits = written(left.join(met, UNIT, "left_semi"), "collisions"), digits + 1
    return kept


def assign_units(units: DataFrame, key: str, *, attempts: int = 8) -> DataFrame:
    """(kind, unit, attempt, surrogate) of distinct units: surrogates that are no unit themselves and that none share.

    Each round looks at what still collides; usually the first finds nothing. What
    collides after ``attempts`` gets longer surrogates.
    """
    new = unit_surrogate(F.col("kind"), F.col("unit"), _keyed(key, F.col("attempt"))).alias("surrogate")
    given = written(units.select(*UNIT, F.lit(0).alias("attempt")).select("*", new), "surrogates")
    for attempt in range(attempts):
        bad = _colliding(given)
        if bad.isEmpty():
            return given
        if attempt == attempts - 1:
            break
        again = given.join(bad, UNIT, "left_semi").select(*UNIT, (F.col("attempt") + 1).alias("attempt")).select("*", new)
        given = written(given.join(bad, UNIT, "left_anti").select(*UNIT, "attempt", "surrogate").unionByName(again), "surrogates")
    return _given_longer(given, bad)


def _with_moved(entity: Column, key: str, moved: Column) -> Column:
    """An entity's surrogate, its units' being those of the map ``moved`` where it has them."""
    first = _keyed(key, 0)
    return rendered(entity, lambda kind, unit: F.coalesce(F.element_at(moved, F.concat_ws(":", kind, unit)), unit_surrogate(kind, unit, first)), first)


def _moved_map(rows: DataFrame, by: str, moved: DataFrame) -> DataFrame:
    """(by, moved) from rows (by, kind, unit): a map of units to surrogates."""
    pair = F.struct(F.concat_ws(":", *UNIT).alias("unit"), "surrogate")
    return rows.join(moved, UNIT).groupBy(by).agg(F.map_from_entries(F.collect_set(pair)).alias("moved"))


def assign(found: DataFrame, key: str, *, attempts: int = 8) -> DataFrame:
    """(entity, surrogate, attempt) of distinct entities: see ``assign_units``; the attempt is the most of a unit's."""
    rows = found.select("entity", F.explode(units_of(F.col("entity"))).alias("u")).select("entity", "u.*")
    given = assign_units(rows.select(*UNIT).distinct(), key, attempts=attempts)
    most = rows.join(given, UNIT).groupBy("entity").agg(F.max("attempt").alias("attempt"))
    both = found.select("entity").join(_moved_map(rows, "entity", given), "entity", "left").join(most, "entity", "left")
    return both.select("entity", _with_moved(F.col("entity"), key, F.col("moved")).alias("surrogate"), F.coalesce("attempt", F.lit(0)).alias("attempt"))


#: The column of what was found, and parts in which what collides is numbered.
FOUND, PARTS = "_pii_found", 256


def _moved(docs: DataFrame, key: str, doc_id: str, text: str) -> DataFrame | None:
    """(id, moved) of documents with units that collide, or None if there are none."""
    found = docs.select(F.col(doc_id).alias("_id"), F.explode(F.array_distinct(F.flatten(F.transform(entities(text), units_of)))).alias("u"))
    found = written(found.select("_id", "u.*"), "entities")
    moved = assign_units(found.select(*UNIT).distinct(), key).filter("attempt > 0").select(*UNIT, "surrogate")
    return None if moved.isEmpty() else _moved_map(found, "_id", moved)


def replace(docs: DataFrame, key: str, *, doc_id: str = "doc_id", text: str = "text", check: bool = True, found: bool = False) -> DataFrame:
    """``docs`` with surrogates in ``text``; all other columns as they are, ``found`` adds what was found as FOUND.

    With ``check``, a first pass over the corpus looks for collisions. If there are any,
    the new surrogates of the units that collide are joined to the documents that hold them.
    """
    here, again = fresh(docs, FOUND), fresh(docs, "_pii_moved")
    moved = _moved(docs, key, doc_id, text) if check else None
    rows = docs.select("*", entities(text).alias(here))
    if moved is not None:
        moved = moved.select(F.col("_id").alias(fresh(docs, "_pii_id")), F.col("moved").alias(again))
        rows = rows.join(moved, rows[doc_id].eqNullSafe(moved[moved.columns[0]]), "left")
    new = (lambda e: surrogate(e, _keyed(key, 0))) if moved is None else (lambda e: _with_moved(e, key, F.col(again)))
    joined = F.array_join(F.zip_with(F.split(F.col(text), ENTITY, -1), F.concat(F.transform(here, new), F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    return rows.withColumn(text, F.when(F.size(here) > 0, joined).otherwise(F.col(text))).select(*docs.columns, *[here] * found)


def op8_pii(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """doc_id, the text with surrogates, and how many entities of each kind it had."""
    count = lambda kind: F.coalesce(F.size(F.filter("kinds", lambda x: x == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")
    out = replace(docs.select("doc_id", "text"), key, found=True)
    return out.select("doc_id", "text", F.transform(FOUND, kind_of).alias("kinds")).select("doc_id", "text", *map(count, KINDS))
