"""What web pages show: title, text, links, images, fields by selector, and sizes named in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import markup as mk
from .registry import query, t


def _plain(sql: str) -> str:
    """SQL: entities of a text as characters. These five occur in the tables, at the end of cut pages without their sign."""
    return f"replace(replace(replace(replace(regexp_replace({sql}, '&(amp|copy|middot|quot)$', '&\\1;'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


#: SQL: markup without comments, scripts, styles, titles and what a cut page ends with.
_SEEN = "regexp_replace(regexp_replace({0}, '(?s)<!--.*?(-->|$)|<script[^>]*>.*?(</script>|$)|<style[^>]*>.*?(</style>|$)|<title[^>]*>.*?(</title>|$)|<![^>]*(>|$)', '', 'g'), '</?[a-zA-Z][^>]*$', '')"
_FLAT = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '</?(a|b|i|meta)(\s[^>]*)?>', '', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_TEXT = _plain(_FLAT.format(_SEEN.format("html")))
_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_LINKS = r"regexp_extract_all(" + _SEEN.format("html") + r", '<a href=\"([^\"]*)\"', 1)".replace('\\"', '"')
_TITLE = _plain(r"trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)(</title>|$)', 1), '\s+', ' ', 'g'))")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.parsed(t(spark, sf_dir, "pages"))


@query(f"select page_id, nullif({_TITLE}, '') as title, cast(len({_LINKS}) as int) as links from pages")
def n02_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page")
    return pages(spark, sf_dir).select("page_id", mk.first_text(page, "title").alias("title"), F.size(mk.attributes_of(page, "a[href]", "href")).alias("links"))


@query(f"with l as (select page_id, {_ROOT} as root, unnest({_LINKS}) as href, generate_subscripts({_LINKS}, 1) as n from pages) select page_id, cast(n - 1 as int) as place, case when href like '/%' then root || href else href end as link from l where trim(href) <> ''")
def n02_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page as an absolute address, in order."""
    links = F.transform(mk.attributes_of(F.col("page"), "a[href]", "href"), lambda v: mk.absolute(v, F.col("url")))
    return pages(spark, sf_dir).select("page_id", F.posexplode(links).alias("place", "link"))


@query(f"""with i as (select page_id, {_ROOT} as root, replace(replace({_SEEN.format('html')}, '<a href="', '<img alt="" src="..'), '.">', '.png">') as html from pages), a as (select page_id, root, unnest(regexp_extract_all(html, 'src="\\.\\.([^"]*)"', 1)) as src, generate_subscripts(regexp_extract_all(html, 'src="\\.\\.([^"]*)"', 1), 1) as n from i),
o as (select page_id, root || src as u, min(n) as n from a group by all) select page_id, string_agg(u, ' ' order by n) as images from o group by 1""")
def n06_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute addresses of a page's images, each once: the pages' links, turned into images with addresses one folder up."""
    html = F.replace(F.replace("html", F.lit('<a href="'), F.lit('<img alt="" src="..')), F.lit('.">'), F.lit('.png">'))
    base = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), F.lit("/shop/page?x=1"))
    own = mk.parsed(t(spark, sf_dir, "pages").select("page_id", base.alias("base"), html.alias("html")))
    return own.select("page_id", F.array_join(mk.images(F.col("page"), F.col("base")), " ").alias("images")).where("images <> ''")


@query(f"select page_id, {_TEXT} as text from pages")
def n07_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page shows: no scripts, styles and comments, entities (with their semicolon, but for a cut page's last) as characters, blanks drawn together."""
    return mk.parsed(t(spark, sf_dir, "pages"), signed=True).select("page_id", "page.text")


def page_title(v: Column) -> Column:
    """A page's title as a product's: no price or shop after it, slugs as words."""
    text = F.regexp_replace(x.collapsed(v), r"\s*[-–|]\s*\$?\d[\d,]*(?:\.\d{2})\s*$", "")
    bare = F.trim(F.regexp_replace(text, r"\s*[|–]\s*[^|–]+$", ""))
    named = F.when(bare != "", bare).otherwise(text)
    return F.when(named.rlike("^[a-z0-9]+([-_][a-z0-9]+)+$"), F.initcap(F.translate(named, "-_", "  "))).otherwise(named)


_SLUG = "rtrim(lower(regexp_replace(title, '[^A-Za-z]+', '-', 'g')), '-')"
_BARE = r"trim(regexp_replace(regexp_replace(raw, '\s*[-–|]\s*\$?\d[\d,]*(?:\.\d{2})\s*$', ''), '\s*[|–]\s*[^|–]+$', ''))"


@query(f"""with p as (select page_id, {_TITLE} as title from pages where {_TITLE} <> ''), r as (select page_id, case page_id % 3 when 0 then title || ' - $' || cast(page_id * 1000 as varchar) || '.50' when 1 then title || ' | Shop ' || cast(page_id as varchar) else {_SLUG} end as raw from p),
b as (select page_id, raw, {_BARE} as bare from r) select page_id, case when regexp_full_match(bare, '[a-z0-9]+([-_][a-z0-9]+)+') then array_to_string(list_transform(string_split(replace(bare, '_', '-'), '-'), lambda w: upper(w[1]) || w[2:]), ' ') else bare end as title from b""")
def n08_page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the pages, with a price, a shop's name, or as a slug, brought back to plain ones."""
    own, n = pages(spark, sf_dir).select("page_id", mk.first_text(F.col("page"), "title").alias("title")).where("title is not null"), F.col("page_id")
    raw = F.when(n % 3 == 0, F.concat("title", F.lit(" - $"), (n * 1000).cast("string"), F.lit(".50"))).when(n % 3 == 1, F.concat("title", F.lit(" | Shop "), n.cast("string"))).otherwise(F.rtrim(F.lower(F.regexp_replace("title", "[^A-Za-z]+", "-")), F.lit("-")))
    return own.select("page_id", page_title(raw).alias("title"))


_NAV = "regexp_extract_all(regexp_extract(" + _SEEN.format("html") + ", '(?s)<nav>(.*?)(</nav>|$)', 1), '(?s)<a href=\"[^\"]*\">([^<]*)', 1)"


@query(rf"""select page_id, nullif({_plain(_FLAT.format("regexp_extract(" + _SEEN.format("html") + ", '(?s)<h1>(.*?)(</h1>|$)', 1)"))}, '') as title, regexp_extract(html, '<html lang="([^"]*)"', 1) as lang,
array_to_string(list_transform({_NAV}, lambda s: trim(s)), '|') as menu, nullif({_plain(_FLAT.format("regexp_extract(" + _SEEN.format("html") + ", '(?s)<div class=.ad.>(.*?)(</div>|$)', 1)"))}, '') as ad,
array_to_string(regexp_extract_all({_SEEN.format('html')}, '<li>(<a href="[^"]*">[^<]*)', 1), '') as markup from pages""")
def n10_fields_by_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of all kinds by a schema of selectors."""
    schema = {
        "title": ("article h1", "text"), "lang": ("html", "attribute", "lang"), "menu": ("nav li a", "list"), "ad": ("div.ad", "text"),
        "entries": ("body nav li", "nested_list", {"href": ("a[href]", "attribute", "href"), "text": ("a", "text"), "html": ("a", "html")}),
    }
    own = mk.parsed(t(spark, sf_dir, "pages").withColumn("source", F.col("html"))).select("page_id", *mk.fields(F.col("page"), F.col("source"), schema))
    return own.select("page_id", "title", "lang", F.array_join("menu", "|").alias("menu"), "ad", F.array_join(F.transform("entries", lambda e: F.regexp_replace(e["html"], "(?s)</a.*$", "")), "").alias("markup"))


# -- sizes -----------------------------------------------------------------------------------------------------------------

#: What a size is counted in, by kind, and words beside a size that say it is the product's own.
MEASURES = {"mass": "lbs|lb|pounds|pound|ounces|ounce|oz|kilograms|kilogram|kg|grams|gram|g", "volume": "quarts|quart|qt|gallons|gallon|gal|liters|liter|ml|l", "count": "pack|pk|count|ct", "length": "inches|inch|in|cm|mm"}
OWN_WORDS = ("net", "weight", "weighs", "contains", "holds", "filled", "bag", "box", "bottle", "tub", "can", "case")
_SIZE = rf"(?<![\w.])(\d+(?:\.\d+)?)\s?({'|'.join(MEASURES.values())})(?!\w)"
_OPEN, _SHUT = "\x02", "\x03"
#: Characters before a size in which its words are looked for.
REACH = 40
#: Kinds in the order in which they name a product's size.
KIND_RANK = {"mass": 0, "volume": 0, "count": 1, "length": 2}


def size_metric(text: Column) -> Column:
    """The size that a text names best: struct<amount, unit, kind, place>, or null without one.

    Mass and volume come before counts, counts before lengths; among these a size with one of OWN_WORDS in the 40 characters
    before it, then the earlier one.
    """
    flat = F.translate(x.collapsed(text), _OPEN + _SHUT, "  ")
    pieces = F.split(F.regexp_replace(flat, f"(?i){_SIZE}", f"{_OPEN}$1{_SHUT}$2{_OPEN}"), _OPEN)  # texts at even places, sizes at odd ones
    unit = lambda p: F.lower(F.regexp_extract(p, f"{_SHUT}(.*)", 1))
    kind = lambda p: F.coalesce(*(F.when(unit(p).rlike(f"^({units})$"), k) for k, units in MEASURES.items()))
    rank = lambda k: F.coalesce(*(F.when(k == name, n) for name, n in KIND_RANK.items()))

    def found(own: Column) -> Column:
        def before(i: Column) -> Column:
            ends = F.transform(F.slice(own, F.greatest(i - 2 * REACH + 1, F.lit(1)), F.least(i, F.lit(2 * REACH))), lambda p: F.right(F.replace(p, F.lit(_SHUT), F.lit("")), F.lit(REACH)))
            return F.lower(F.right(F.array_join(ends, ""), F.lit(REACH)))

        said = lambda i: F.when(before(i).rlike(rf"\b({'|'.join(OWN_WORDS)})\b"), 0).otherwise(1)
        one = lambda p, i: F.struct(rank(kind(p)).alias("rank"), said(i).alias("own"), i.alias("place"), F.regexp_extract(p, f"^([^{_SHUT}]*)", 1).cast("double").alias("amount"), unit(p).alias("unit"), kind(p).alias("kind"))
        return F.array_min(F.array_compact(F.transform(own, lambda p, i: F.when(i % 2 == 1, one(p, i)))))

    told = lambda b: F.when(b.isNotNull(), F.struct(b["amount"].alias("amount"), b["unit"].alias("unit"), b["kind"].alias("kind"), F.floor(b["place"] / 2).cast("int").alias("place")))
    return x.bound(x.bound(pieces, found), told)


_UNITS_SQL = "|".join(MEASURES.values())
_KIND_SQL = "case " + " ".join(f"when regexp_full_match(unit, '{u}') then '{k}'" for k, u in MEASURES.items()) + " end"
#: A text of columns: what the part is called, then amounts in units that follow its columns.
_UNIT_LIST = ("lb", "Ounces", "mL", "pack", "cm", "stars", "kg.", "IN")


@query(rf"""with u(v) as (values ({list(_UNIT_LIST)})), p as (select p_partkey, p_name || ' ' || p_type || ', ' || p_size || v[p_partkey % 8 + 1] || ' ' || case when p_size % 2 = 0 then 'net ' else '' end || p_retailprice || '  ' || v[p_size % 8 + 1] || repeat(' x', p_size) || ' box of ' || p_size || ' ' || v[p_partkey % 7 + 2] as text from part, u),
f as (select p_partkey, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '(?i)(^|[^\w.])(\d+(?:\.\d+)?)\s?({_UNITS_SQL})\b', '\1|\2~\3|', 'g'), '|') as pieces from p),
e as (select p_partkey, unnest(range(2, len(pieces) + 1, 2)) as k, pieces from f), s as (select p_partkey, k, lower(right(replace(array_to_string(pieces[1:k - 1], ''), '~', ''), {REACH})) as before, string_split(pieces[k], '~')[1]::double as amount, lower(string_split(pieces[k], '~')[2]) as unit from e),
r as (select *, {_KIND_SQL} as kind, regexp_matches(before, '\b({"|".join(OWN_WORDS)})\b') as own from s)
select part.p_partkey, amount, unit, kind, cast(k / 2 - 1 as int) as place from part left join (select * from r qualify row_number() over (partition by p_partkey order by case kind when 'count' then 1 when 'length' then 2 else 0 end, own desc, k) = 1) using (p_partkey)""")
def n05_size_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = lambda n: F.get(F.array(*map(F.lit, _UNIT_LIST)), n)
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    text = F.concat("p_name", F.lit(" "), "p_type", F.lit(", "), size, unit((key % 8).cast("int")), F.lit(" "), F.when(F.col("p_size") % 2 == 0, "net ").otherwise(""), F.col("p_retailprice").cast("string"), F.lit("  "), unit(F.col("p_size") % 8), F.expr("repeat(' x', p_size)"), F.lit(" box of "), size, F.lit(" "), unit((key % 7 + 1).cast("int")))
    own = t(spark, sf_dir, "part").select("p_partkey", size_metric(text).alias("s"))
    return own.select("p_partkey", "s.amount", "s.unit", "s.kind", "s.place")


# -- addresses of variants -----------------------------------------------------------------------------------------------

#: Points of a candidate for each word and measure in common with the product wanted, and for measures of another variant: fixed values.
WORD_POINTS, MEASURE_POINTS, OTHER_POINTS = 5.0, 4.0, -8.0


def variant_addresses(pages: DataFrame) -> DataFrame:
    """page_id, rank, address, color, size, score of the variants that pages point to, best first.

    pages: page_id, page (parsed), base (the page's address), expected (the name wanted). An element's data-url or value that
    asks for a variation is a candidate; color and size are the values of its parameters whose names end so, or what the page
    shows for a value (data-attr-value with aria-label "Select ..."). Equal addresses count once, the first; ties stay in order.
    """
    page = F.col("page")
    variation = '[{0}*="Product-Variation"]'
    raw = F.concat(*(mk.attributes_of(page, variation.format(a), a) for a in ("data-url", "value")))
    shown = x.bound(mk.numbered(page), lambda every: F.transform(mk.selected(every, "[data-attr-value][aria-label]"), lambda x: F.struct(F.try_element_at(x["e"]["attributes"], F.lit("data-attr-value")).alias("k"), F.regexp_extract(F.try_element_at(x["e"]["attributes"], F.lit("aria-label")), "^Select (.+)$", 1).alias("v"))))
    labels = x.bound(F.filter(shown, lambda s: s["v"] != ""), lambda s: F.map_from_entries(F.filter(s, lambda e, i: ~F.exists(F.slice(s, 1, i), lambda b: b["k"] == e["k"]))))
    one = pages.select("page_id", "base", "expected", labels.alias("labels"), F.posexplode(F.array_distinct(raw)).alias("place", "raw"))
    address = mk.absolute(F.col("raw"), F.col("base"))
    pairs = F.transform(F.split(F.regexp_extract("address", r"\?([^#]*)", 1), "&"), lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), F.coalesce(F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)), F.lit("")).alias("v")))
    value = lambda end: F.get(F.filter(F.col("pairs"), lambda p: p["k"].endswith(end) & (p["v"] != "")), F.lit(0))["v"]
    own = one.withColumn("address", address).withColumn("pairs", pairs).withColumns({"color": value("_color"), "size": value("_size")}).where("color is not null or size is not null")
    named = own.withColumns({c: F.coalesce(F.try_element_at("labels", F.col(c)), F.col(c)) for c in ("color", "size")}).withColumn("said", F.concat_ws(" ", "color", "size"))
    named = named.withColumns({"words": x.keywords("said"), "wanted": x.keywords("expected"), "has": x.variant_tokens(F.col("said")), "asked": x.variant_tokens(F.col("expected"))})
    common = lambda a, b: F.size(F.array_intersect(a, b))
    score = WORD_POINTS * common("words", "wanted") + MEASURE_POINTS * common("has", "asked") + F.when(x.variants_conflict(F.col("asked"), F.col("has")), OTHER_POINTS).otherwise(0.0)
    scored = named.withColumn("score", score)
    first = scored.groupBy("page_id", "address").agg(F.min_by(F.struct("place", "color", "size", "score"), "place").alias("x")).select("page_id", "address", "x.*")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "place"))
    return first.select("page_id", rank.alias("rank"), "address", "color", "size", "score")


_KEYWORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in (" + ", ".join(f"'{w}'" for w in x.STOP_WORDS) + ")))"


@query(f"""with l as (select page_id, {_ROOT} as root, {_TITLE} as title, unnest({_LINKS}) as href, generate_subscripts({_LINKS}, 1) as n from pages),
c as (select page_id, root || '/on/Product-Variation?pid=' || page_id || '&dwvar_' || page_id || '_color=' || href[2:] || '&dwvar_' || page_id || '_size=' || (length(href) % 3 + 1) || 'lb' as address, href[2:] as color, (length(href) % 3 + 1) || 'lb' as size, title, page_id % 3 + 1 as want, length(href) % 3 + 1 as has, n from l where href <> '/'),
s as (select *, 5.0 * len(list_intersect({_KEYWORDS.format("color || ' ' || size")}, {_KEYWORDS.format("title || ' ' || want || ' lb'")})) + case when want = has then 4.0 else -8.0 end as score from c),
f as (select page_id, address, color, size, score, min(n) as n from s group by all)
select page_id, cast(row_number() over (partition by page_id order by score desc, n) as int) as rank, address, color, size, score from f""")
def n09_variant_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' links, turned into buttons that ask for variants, against the pages' titles with a weight."""
    key, link = F.col("page_id").cast("string"), F.lit('<a href="/')
    asks = lambda p, v: F.concat(F.lit('<button data-url="/on/Product-Variation?pid='), key, F.lit("&amp;dwvar_"), key, F.lit("_color="), v, F.lit("&amp;dwvar_"), key, F.lit("_size="), ((F.length(v) + 1) % 3 + 1).cast("string"), F.lit("lb"), F.substr(p, F.length(v) + 1))
    button = lambda p: F.when(p.rlike('^[^"]+">'), asks(p, F.substring_index(p, '"', 1))).otherwise(F.concat(link, p))
    parts = F.split("html", r'\Q<a href="/\E', -1)  # what each link's address begins, after what stands before all of them
    html = x.bound(parts, lambda own: F.concat(F.get(own, F.lit(0)), F.array_join(F.transform(F.slice(own, 2, F.size(own)), button), "")))
    own = mk.parsed(t(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")))
    title = F.coalesce(mk.first_text(F.col("page"), "title"), F.lit(""))
    return variant_addresses(own.select("page_id", "page", F.col("url").alias("base"), F.concat(title, F.lit(" "), (F.col("page_id") % 3 + 1).cast("string"), F.lit(" lb")).alias("expected")))
