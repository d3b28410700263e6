"""Verdicts on urls without a rule: any share of blocked urls counts, at any size of the table."""

import pytest

from meridia.llm import url_filter

SCHEMA = "page_id long, url string, html string"


def verdicts(spark, pages, **options):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], SCHEMA)
    return {pages[r.page_id][0]: r.verdict for r in url_filter.judge_urls(rows, **options).collect()}


def test_few_blocked_urls_are_distrust(spark):
    """One of three urls is blocked by a rule: the others are distrusted, and who links there."""
    pages = [("http://a.net/fr/1", None), ("http://a.net/x", None), ("http://a.net/y", None), ("http://b.org/", '<a href="http://a.net/x">'), ("http://c.org/", None)]
    got = verdicts(spark, pages)
    assert got == {"http://a.net/fr/1": "block", "http://a.net/x": "block", "http://a.net/y": "block", "http://b.org/": "block", "http://c.org/": "allow"}


def test_verdicts_do_not_depend_on_the_number_of_seeds(spark):
    """Further blocked hosts leave the verdicts of others as they are."""
    pages = [("http://bad.net/fr/1", None), ("http://spam.org/", '<a href="http://bad.net/">'), ("http://far.org/", '<a href="http://spam.org/">')]
    more = [(f"http://h{i}.net/fr/1", None) for i in range(40)]
    for all_pages in (pages, pages + more):
        got = verdicts(spark, all_pages, least_distrust=0.1)
        assert got["http://spam.org/"] == got["http://far.org/"] == "block"


def test_ranks_rest_or_it_is_an_error(spark):
    """A ring of two hosts passes everything on for ever: the ranks still come to rest, and too few rounds are told."""
    edges = spark.createDataFrame([("t", "a", "b", 1.0), ("t", "b", "a", 1.0)], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("t", "a", 1.0)], "kind string, host string, mass double")
    got = {r.host: r.score for r in url_filter.propagate(edges, seeds).collect()}
    assert abs(got["a"] - 0.15 / (1 - 0.85**2)) < 1e-4 and abs(got["b"] - 0.85 * 0.15 / (1 - 0.85**2)) < 1e-4
    with pytest.raises(ValueError, match="still move"):
        url_filter.propagate(edges, seeds, rounds=3)
