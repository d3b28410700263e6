"""Surrogates of letters outside the alphabets, and of forms without a free one."""

import unicodedata

from pyspark.sql import functions as F

from meridia.llm import pii


def test_letters_of_any_script_change(spark):
    names = ["Dr Սարգսյան", "Dr Ｓｍｉｔｈ", "Dr Łśźćż", "Dr Άγγελος", "Dr Ꙗ語한𠀀"]
    given = {r.entity: r.surrogate for r in pii.assign(spark.createDataFrame([(x,) for x in names], "entity string"), "key").collect()}
    assert sorted(given) == sorted(names) and not set(given.values()) & set(names)
    for old, new in given.items():
        assert [unicodedata.category(c) for c in old] == [unicodedata.category(c) for c in new]
    assert all("ARMENIAN" in unicodedata.name(c) for c in given[names[0]][3:])


def test_full_form_gets_longer_surrogates(docs_of):
    """All two-letter surnames of a form: none of its surrogates is free."""
    names = [f"Mr {a}{b}" for a in "BCDFGHJKLMNPQRSTVWXYZ" for b in "aeiou"]
    got = [r.text for r in pii.replace(docs_of([f"x {n}, {n}!" for n in names]), "key").orderBy("doc_id").collect()]
    new = [t[2:-1].split(", ") for t in got]
    assert all(a == b for a, b in new) and len({a for a, _ in new}) == len(names)
    assert not {a for a, _ in new} & set(names)
