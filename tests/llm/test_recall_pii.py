"""Recall and form of surrogates on planted entities, judged by code that knows nothing of the detector."""

import random
import re
from collections import defaultdict

import pytest

from meridia.llm import pii

#: First names that the detector lists and some that it doesn't, surnames of several languages.
LISTED = ["Emily", "James", "Sarah", "David"]
UNLISTED = ["Oluwaseun", "Thandiwe", "Bjarne", "Saoirse", "Kwame", "Ximena"]
SURNAMES = ["Okafor", "Lindqvist", "Müller", "García", "O'Brien", "Nakamura", "Petrov", "Dubois", "Haddad", "Kowalski"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban(country, account):
    moved = account + "".join(str(int(c, 36)) for c in country) + "00"
    return f"{country}{98 - int(moved) % 97:02d}{account}"


def iban_holds(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def planted(rnd):
    """(kind, entity) of many forms; every entity is another one."""
    out = []
    word = lambda n: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(n))
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    for _ in range(60):
        out.append(("email", f"{word(3)}{rnd.choice(['.', '_', '-', '+', ''])}{word(2)}{rnd.choice(['', digits(2)])}@{word(3)}.{rnd.choice(['com', 'org', 'de', 'co.uk'])}"))
        out.append(("ip", ".".join(str(rnd.randint(1, 254)) for _ in range(4))))
        area, line = f"{rnd.randint(2, 9)}{digits(2)}", digits(4)
        out.append(("phone", rnd.choice([f"+1 {area} 555 {line}", f"({area}) 555-{line}", f"{area}-555-{line}", f"+44 20 7{digits(3)} {line}", f"+49 30 {digits(7)}"])))
        body = "4" + digits(14)
        body += str((10 - luhn(body + "0")) % 10)
        out.append(("card", rnd.choice([body, " ".join(re.findall("....", body)), "-".join(re.findall("....", body))])))
        out.append(("ssn", f"{rnd.randint(100, 665)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}"))
        code = iban("DE", digits(18))
        out.append(("iban", rnd.choice([code, " ".join(re.findall(".{1,4}", code))])))
    for i, (first, last) in enumerate((f, s) for f in LISTED for s in SURNAMES):
        out.append(("listed name", f"{first} {last}{'' if i % 2 else '-' + word(2).title()}"))
    for first in UNLISTED:
        for last in SURNAMES:
            out.append(("name after a cue", rnd.choice([f"my name is {first} {last}", f"Dear {first} {last}", f"Dr. {first} {last}", f"me llamo {first} {last}", f"ich heiße {first} {last}"])))
            out.append(("name without a cue", f"{first} {last}x"))
    return list(dict.fromkeys(out))


BEFORE, AFTER = "they wrote to us about it and said that ", ", which is all that was kept of the note"


@pytest.fixture(scope="module")
def replaced(spark):
    found = planted(random.Random(11))
    texts = [f"{BEFORE}{e}{AFTER}" for _, e in found]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[::7] + [f"{BEFORE}nothing{AFTER}"])], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in pii.replace(rows, "a key of the test").collect()}
    assert got[len(got) - 1] == f"{BEFORE}nothing{AFTER}"
    return found, got


def middle(text):
    assert text.startswith(BEFORE) and text.endswith(AFTER)
    return text[len(BEFORE) : -len(AFTER)]


def gone(kind, entity, new):
    """No part of an entity that tells it apart is left in place."""
    if "name" in kind:
        return entity.split()[-1] not in new
    letters = lambda x: re.sub(r"[^0-9A-Za-z]", "", x)
    return letters(entity) != letters(new)


def test_recall_by_kind(replaced):
    found, got = replaced
    hits = defaultdict(list)
    for i, (kind, entity) in enumerate(found):
        hits[kind].append(gone(kind, entity, middle(got[i])))
    recall = {k: sum(v) / len(v) for k, v in hits.items()}
    print(recall)
    assert all(recall[k] >= 0.9 for k in ("email", "ip", "phone", "card", "ssn", "iban", "listed name", "name after a cue")), recall
    assert recall["name without a cue"] <= 0.1  # as the README says: such a name isn't found


def test_surrogates_keep_their_form_and_are_told_apart(replaced):
    found, got = replaced
    shape = lambda x: re.sub(r"[a-z]+", "a", re.sub(r"\d", "0", x.lower()))
    new = {}
    for i, (kind, entity) in enumerate(found):
        surrogate = new[entity] = middle(got[i])
        if kind == "email":
            assert re.fullmatch(r"[\w.+-]+@[a-z0-9.-]+", surrogate) and surrogate.rsplit(".", 1)[1] == entity.rsplit(".", 1)[1]
        elif kind == "ip":
            assert len(surrogate.split(".")) == 4 and all(0 <= int(x) <= 255 for x in surrogate.split("."))
        elif kind in ("phone", "card", "ssn"):
            assert shape(surrogate) == shape(entity)
            if kind == "card":
                assert luhn(re.sub(r"\D", "", surrogate)) == 0
        elif kind == "iban":
            assert iban_holds(entity) and iban_holds(surrogate) and shape(surrogate) == shape(entity)
    assert len(set(new.values())) == len(new)
    assert not set(new.values()) & {e for k, e in found if k != "name without a cue"}
    for j, i in enumerate(range(0, len(found), 7)):  # the same entity in another document
        assert got[len(found) + j] == got[i]
