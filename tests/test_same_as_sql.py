"""Queries against their SQL on small tables with odd pages."""

import math

import duckdb
import pytest

from shelfloom import catalog
from shelfloom.operators import markup as mk

SF = "/root/testdata/sf0.001"


@pytest.fixture
def same(spark, tmp_path):
    """same(name, pages): the query's rows over these pages (page_id, url, html), once they are found equal to those of its SQL."""

    def run(name, pages):
        con = duckdb.connect()
        for table in ("part", "events"):
            con.execute(f"copy (from '{SF}/{table}.parquet') to '{tmp_path}/{table}.parquet'")
        con.execute("create table pages (page_id bigint, url varchar, html varchar)")
        con.executemany("insert into pages values (?, ?, ?)", pages)
        con.execute(f"copy pages to '{tmp_path}/pages.parquet'")
        for table in ("part", "events"):
            con.execute(f"create view {table} as from '{tmp_path}/{table}.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        found = con.execute(catalog.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=str)
        got = plain(df.select(*columns).collect())
        assert got == plain(found.fetchall())
        return got

    return run


@pytest.mark.parametrize("name", ["m12_additive_score", "m13_ranked_candidates"])
def test_words_beside_letters_of_other_scripts(same, name):
    """é and ß are no part of a word, so that one of the poor results' words may stand right beside them."""
    page = '<!DOCTYPE html><html><head><title>dog food</title></head><body><div class="ad">{}</div><article><h1>x</h1></article></body></html>'
    ads = ("plain", "éreview", "bestß", "ñvsñ", "reviews", "_best", "best", "9 bestê")
    rows = same(name, [(2 + 10 * k, "https://a.example.com/x", page.format(ad)) for k, ad in enumerate(ads)])
    assert len(rows) == len(ads)


@pytest.mark.parametrize("name", ["m12_additive_score", "m13_ranked_candidates"])
def test_words_of_other_kinds_and_sizes(same, name):
    """What is wanted is a bulk bag for dogs, whatever a page's title begins with; pounds of other sizes count neither way."""
    page = '<!DOCTYPE html><html><head><title>{}</title></head><body><div class="ad">{}</div><article><h1>x</h1></article></body></html>'
    titles, ads = ("cat food here", "a packet of", "red packets cat", "dog cat", "plain"), ("plain", "3 lb bag", "40lbs", "1 pound or 2 pounds", "8-11 lb!", "2.5 lb", "cat")
    rows = same(name, [(k, None if k % 53 == 52 else "https://a.example.com/x", page.format(titles[k % 5], ads[k % 7])) for k in range(400)])
    assert len(rows) == 400 and len(set(rows)) == 400


def test_references_without_their_sign(same):
    """Within a page's text they stay as they are; at its end they are the rest of a cut one."""
    page = "<html><head><title>t&amp</title></head><body><h1>a &copy;&amp</h1><p>b&amp;amp &middot; c&copy d</p>"
    ends = ("", "e&amp", "e &quot <b></b> ", "e&amp</p></body></html>", "e&amp;", "e&amp;copy", "e&amp;&copy")
    rows = same("n07_clean_text", [(k, "https://a.example.com/x", f"{page}{end}") for k, end in enumerate(ends)])
    assert rows[1][1] == "a ©&amp b&amp · c&copy d e&"


def test_stretches_end_with_a_completed_reference():
    page = mk.Page("<div><p>a&amp</p><p>b <i>c&amp", signed=True).row()
    assert page["text"] == "a&amp b c&" and [page["text"][e["begin"] : e["until"]] for e in page["elements"]] == ["a&amp b c&", "a&amp", "b c&", "c&"]


def test_signs_of_titles_and_links_stay(same):
    """Signs within a page's title or a link are the page's own, not marks of where the query puts something."""
    page = '<html><head><title>{}</title></head><body><a href="/{}">x</a><a href="/">root</a><a href="/red">y</a><p>%z%"></p></body></html>'
    odd = (("red### ink", "inkê"), ("5% red", "a.b"), ("#", "ink"), ("red $1", "inkß."), ("% red", "ink"), ("\\red", "ink$1"))
    rows = same("n09_variant_addresses", [(k, "https://a.example.com/x", page.format(*o)) for k, o in enumerate(odd)])
    assert len(rows) == 2 * len(odd) and any(r[5] > 4 for r in rows)
