"""Traits read from product text and payloads: kinds of pets, weights, trust, images, classes of results, sanitised fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as pl
from ..functions import text as x
from ..functions.workflow import parse_table
from ..operators import markup as mk
from ..operators import pages as pg
from ..operators import tables as op
from ..sources.feeds import leading_number
from . import search as se
from .reading import _LINKS, _NAV, _TITLE
from .registry import query, t

#: Words of each trait: fixed values.
PET_TYPES = {
    "Dog": r"\b(dog|dogs|puppy|puppies|canine|k9|k-9|pup)\b",
    "Cat": r"\b(cat|cats|kitten|kittens|feline|kitty)\b",
    "Bird": r"\b(bird|birds|parrot|parakeet|cockatiel|finch|avian|budgie|cockatoo|macaw|lovebird)\b",
    "Fish": r"\b(fish|aquarium|aquatic|pond|koi|goldfish|betta|tropical fish|freshwater|saltwater|marine)\b",
    "Reptile": r"\b(reptile|reptiles|snake|snakes|lizard|lizards|turtle|turtles|tortoise|gecko|bearded dragon|iguana)\b",
    "Small Animal": r"\b(rabbit|rabbits|hamster|hamsters|guinea pig|gerbil|ferret|ferrets|small animal|chinchilla|mouse|mice|rat|rats)\b",
    "Horse": r"\b(horse|horses|equine|pony|ponies|mare|stallion|foal|equestrian)\b",
    "Livestock": r"\b(chicken|chickens|poultry|goat|goats|sheep|cattle|cow|cows|pig|pigs|livestock|farm animal|duck|ducks|turkey|turkeys)\b",
}
LIFE_STAGES = {
    "puppy": r"\b(puppy|puppies|kitten|kittens|baby|junior|starter|young|growth)\b",
    "adult": r"\b(adult|maintenance)\b",
    "senior": r"\b(senior|mature|older|aging|7\+|11\+|geriatric)\b",
    "all": r"\b(all (life )?stages?|all ages?)\b",
}
SIZE_CLASSES = {
    "small": r"\b(small breed|toy breed|small dog|mini|miniature|under 20\s*lb|5-20\s*lb|teacup)\b",
    "medium": r"\b(medium breed|medium dog|20-50\s*lb|mid-size)\b",
    "large": r"\b(large breed|large dog|50-100\s*lb|big dog)\b",
    "giant": r"\b(giant breed|extra large|100\+\s*lb|xl breed|x-large)\b",
    "all": r"\b(all (breed )?sizes?|any size)\b",
}
SPECIAL_NEEDS = {
    "grain-free": r"\b(grain[- ]?free|no grain)\b",
    "sensitive-stomach": r"\b(sensitive stomach|digestive|easy digest|gentle formula)\b",
    "weight-management": r"\b(weight (management|control)|healthy weight|low calorie|lite|light|diet)\b",
    "high-protein": r"\b(high[- ]?protein|protein[- ]?rich)\b",
    "limited-ingredient": r"\b(limited ingredient|simple recipe|single protein)\b",
    "dental-care": r"\b(dental|teeth|oral care|tartar)\b",
    "joint-support": r"\b(joint|hip|glucosamine|mobility|arthritis)\b",
    "skin-coat": r"\b(skin|coat|fur|omega|shiny coat)\b",
}
#: Spellings of weight ranges in order, with the group of the least and of the most pounds: fixed values.
WEIGHT_RANGES = ((r"\b(\d+)\s*-\s*(\d+)\s*lb", 1, 2), (r"\bunder\s*(\d+)\s*lb", 0, 1), (r"\bover\s*(\d+)\s*lb", 1, 0), (r"\b(\d+)\+\s*lb", 1, 0), (r"\bup to\s*(\d+)\s*lb", 0, 1))
#: Parts of source names by trust: fixed values.
MARKETPLACES = ("amazon", "ebay", "etsy", "walmart", "marketplace", "seller", "ai_search", "shop")
TRUSTED = ("shopsite_input", "bradley", "central-pet", "central_pet", "orgill", "doitbest", "do_it_best", "manufacturer", "catalog", "distributor")
#: Words that lead a name without being a brand: fixed values.
NO_BRAND = ("new", "best", "heirloom", "official", "premium", "organic", "product", "products", "cat", "dog", "pad", "pads", "litter", "box", "system", "count", "pack", "pk", "ct")

# Texts of products: phrases in turn after the name
_PHRASES = (
    "Adult dog food, grain-free, 20-50 lb", "Kitten growth formula up to 10 lb", "Parrot seed mix", "Senior large breed joint support over 50 lb", "Goldfish flakes, all ages",
    "Horse and pony treats for all life stages", "Chicken feed 50+ lb, high protein", "Guinea pig hay under 5 lb", "Dental chews for toy breed and small dog, 5 - 20 lb", "Bearded dragon diet for skin",
)
_q = lambda s: s.replace("'", "''")
_PRODUCT_TEXT = f"texts as (select p_partkey, p_name || '. ' || ([{', '.join(f'''{chr(39)}{_q(p)}{chr(39)}''' for p in _PHRASES)}])[p_partkey % {len(_PHRASES)} + 1] as v from part)"


def product_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % len(_PHRASES) + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(". "), phrase).alias("v"))


def traits(text: Column, words: dict[str, str]) -> Column:
    """Names of the traits whose words a text holds, in the table's order."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(name)) for name, p in words.items())))


def _traits_sql(words: dict[str, str], empty: str = "") -> str:
    found = ", ".join(f"case when regexp_matches(v, '(?i){_q(p)}') then '{name}' end" for name, p in words.items())
    return f"coalesce(nullif(array_to_string(list_filter([{found}], lambda s: s is not null), ','), ''), '{empty}')"


@query(f"with {_PRODUCT_TEXT} select p_partkey, {_traits_sql(PET_TYPES)} as pets, {_traits_sql(LIFE_STAGES, 'all')} as stages, {_traits_sql(SIZE_CLASSES, 'all')} as sizes, {_traits_sql(SPECIAL_NEEDS)} as needs from texts")
def i34_pet_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pets, life stages and sizes (all, where none is named) and special needs of each product."""
    joined = lambda words, empty="": F.coalesce(F.nullif(F.array_join(traits(F.col("v"), words), ","), F.lit("")), F.lit(empty))
    return product_texts(spark, sf_dir).select("p_partkey", joined(PET_TYPES).alias("pets"), joined(LIFE_STAGES, "all").alias("stages"), joined(SIZE_CLASSES, "all").alias("sizes"), joined(SPECIAL_NEEDS).alias("needs"))


def weight_range(text: Column) -> tuple[Column, Column]:
    """Least and most pounds by the first spelling that matches; null for an open end."""
    def end(which: int) -> Column:
        out = None
        for p, *groups in WEIGHT_RANGES:
            value = F.regexp_extract(text, f"(?i){p}", groups[which]).try_cast("int") if groups[which] else F.lit(None).cast("int")
            hit = text.rlike(f"(?i){p}")
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return out

    return end(0), end(1)


def _range_sql(which: int) -> str:
    return "case " + " ".join(f"when regexp_matches(v, '(?i){p}') then " + (f"try_cast(regexp_extract(v, '(?i){p}', {g[which]}) as int)" if g[which] else "null") for p, *g in WEIGHT_RANGES) + " end"


@query(f"with {_PRODUCT_TEXT} select p_partkey, {_range_sql(0)} as least, {_range_sql(1)} as most from texts")
def i35_weight_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    least, most = weight_range(F.col("v"))
    return product_texts(spark, sf_dir).select("p_partkey", least.alias("least"), most.alias("most"))


def trust(source: Column) -> Column:
    """Trust in a source by its name: the shop's own input, marketplaces, known suppliers, others."""
    s = F.lower(source)
    names = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(s, p))
    return F.when(s == "shopsite_input", "canonical").when(names(MARKETPLACES), "marketplace").when(names(TRUSTED), "trusted").otherwise("standard")


def evidence_rank(source: Column, level: Column) -> Column:
    """Order of sources as evidence: the shop's own, makers, then by trust."""
    return F.when(level == "canonical", 0).when(F.contains(F.lower(source), F.lit("manufacturer")), 1).when(level == "trusted", 2).when(level == "standard", 3).otherwise(4)


_SOURCES = ("shopsite_input", "Orgill", "amazon", "acme-manufacturer", "blog", "petshop", "central_pet")
_any = lambda parts: " or ".join(f"contains(lower(source), '{p}')" for p in parts)


@query(f"""with s as (select page_id, ({se._list(_SOURCES)})[page_id % {len(_SOURCES)} + 1] as source from pages), l as (select *, case when lower(source) = 'shopsite_input' then 'canonical' when {_any(MARKETPLACES)} then 'marketplace' when {_any(TRUSTED)} then 'trusted' else 'standard' end as level from s)
select page_id, level, case level when 'canonical' then 0 when 'trusted' then 1 when 'standard' then 2 else 3 end as rank, case when level = 'canonical' then 0 when contains(lower(source), 'manufacturer') then 1 when level = 'trusted' then 2 when level = 'standard' then 3 else 4 end as evidence from l""")
def i37_source_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("page_id") % len(_SOURCES) + 1).cast("int"))
    own = t(spark, sf_dir, "pages").select("page_id", source.alias("source")).withColumn("level", trust(F.col("source")))
    level = F.col("level")
    rank = F.when(level == "canonical", 0).when(level == "trusted", 1).when(level == "standard", 2).otherwise(3)
    return own.select("page_id", "level", rank.alias("rank"), evidence_rank(F.col("source"), level).alias("evidence"))


def image_address(v: Column) -> Column:
    """An image's address; a size mark before the ending, and parameters, go from those of the large shop."""
    u, sized = F.trim(v), r"(?i)^https?://[^/]*amazon\.[^/]*/.*images/I/"
    bare = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"\._[^/]+_(\.\w+)$", "$1")
    return F.when(u.rlike(sized), bare).otherwise(u)


def image_key(address: Column) -> Column:
    """What makes two addresses the same image: the path in lower case where hosts mirror each other, else the address."""
    return F.when(address.rlike(r"(?i)amazon\..*/images/I/"), F.lower(F.regexp_replace(address, "(?i)^https?://[^/]+", ""))).otherwise(address)


def distinct_images(images: Column) -> Column:
    """Normalised addresses, the first of each image, empty ones gone."""
    clean = F.filter(F.transform(images, image_address), lambda u: u != "")
    return x.bound(F.struct(clean.alias("u"), F.transform(clean, image_key).alias("k")), lambda s: F.filter(s["u"], lambda _, i: F.array_position(s["k"], F.get(s["k"], i)) == i + 1))


@query("select p_partkey, array_to_string(['https://m.media-amazon.com/images/I/a' || p_partkey || '.jpg', 'https://cdn.acme.com/' || p_partkey || '.png'], ' ') as images, 2 as n from part")
def i44_image_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and mirrors of one image meet; blanks and repeats go."""
    of = lambda *parts: F.concat(*(F.col("p_partkey").cast("string") if p is None else F.lit(p) for p in parts))
    images = F.array(of("https://m.media-amazon.com/images/I/a", None, "._AC_SL1500_.jpg?x=1"), F.lit("  "), of(" https://cdn.acme.com/", None, ".png"), of("https://images.amazon.com/images/I/A", None, ".jpg"), of("https://cdn.acme.com/", None, ".png"))
    d = distinct_images(images)
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(d, " ").alias("images"), F.size(d).alias("n"))


@query("""select p_partkey, '{"title":"' || p_name || '","sources":[{"brand":"' || p_brand || '"},{"size":{"n":' || p_size || '}}]}' as payload from part""")
def l05_without_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without the keys that only tell how they were come by, at any depth."""
    raw = F.concat(F.lit('{"title":"'), "p_name", F.lit('","Error":null,"sources":[{"brand":"'), "p_brand", F.lit('","Cost_USD":0.1},{"scraped_at":"x","size":{"n":'), F.col("p_size").cast("string"), F.lit(',"message":"m"}}]}'))
    return t(spark, sf_dir, "part").select("p_partkey", pl.without_keys(raw).alias("payload"))


@query("""select p_partkey, 'https://a.com/' || p_partkey || '.png data:image/png;base64,' || p_partkey || ' /img/' || p_partkey as images from part""")
def l06_image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image addresses anywhere in a payload: by their look, or embedded under a key that names images; each once, at most 24."""
    k = F.col("p_partkey").cast("string")
    raw = F.concat(F.lit('{"url":"https://a.com/page","a":[{"u":"https://a.com/'), k, F.lit('.png"}],"hero":{"v":["data:image/png;base64,'), k, F.lit('","none"]},"b":"data:image/png;base64,zz","scraped_at":"/img/x","c":"/img/'), k, F.lit('","d":"https://a.com/'), k, F.lit('.png"}'))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(pl.image_candidates(raw), " ").alias("images"))


@query("select p_partkey, p_brand as brand, cast(p_size as varchar) as size, 2 as n from part")
def l07_table_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two cells of a page's table as a map; the last of equal keys stays."""
    html = F.concat(F.lit("<table><tr><th>Brand</th><td>none</td></tr><tr><td> Size</td><td><b>"), F.col("p_size").cast("string"), F.lit("</b></td></tr><tr><td>alone</td></tr><tr><td>Brand</td><td>"), "p_brand", F.lit("</td></tr></table>"))
    cells = parse_table({"html": html}, {"field": "html", "target": "m"})["m"]
    own = t(spark, sf_dir, "part").select("p_partkey", cells.alias("m"))
    return own.select("p_partkey", F.col("m.Brand").alias("brand"), F.col("m.Size").alias("size"), F.size("m").alias("n"))


def brand_prefix(candidate: Column, name: Column) -> Column:
    """The one to three words before a candidate's first word of the expected name; leading numbers don't count, and words that lead any name are no brand."""
    words = lambda v: F.regexp_extract_all(F.lower(F.coalesce(v, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    expected = F.filter(words(name), lambda w: ~w.rlike("^[0-9]+$"))
    place = lambda own: F.array_position(F.transform(own, lambda w: F.array_contains(expected, w)), F.lit(True))
    before = x.bound(words(candidate), lambda own: F.array_join(F.slice(own, 1, F.greatest(place(own) - 1, F.lit(0)).cast("int")), " "))
    head = F.split(F.regexp_replace(before, "^([0-9]+( |$))+", ""), " ")
    good = F.size(head).between(1, 3) & (F.element_at(head, 1) != "") & ~F.exists(head, lambda w: w.rlike("^[0-9]+$")) & (F.size(F.array_except(head, F.array(*map(F.lit, NO_BRAND)))) > 0)
    return F.when(good, F.array_join(F.transform(head, F.initcap), " "))


_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query(f"""with p as (select page_id, {_TITLE} as title from pages), w as (select page_id, {_TOKENS.format('title')} as w, list_filter({_TOKENS.format("split_part(title, ' ', 3) || ' ' || split_part(title, ' ', 4)")}, lambda v: not regexp_full_match(v, '[0-9]+')) as e from p),
k as (select page_id, w, list_position(list_transform(w, lambda v: list_contains(e, v)), true) as k from w), h as (select page_id, string_split(regexp_replace(array_to_string(case when k > 1 then w[1:k - 1] else [] end, ' '), '^([0-9]+( |$))+', ''), ' ') as head from k)
select page_id, case when len(head) between 1 and 3 and head[1] <> '' and len(list_filter(head, lambda v: regexp_full_match(v, '[0-9]+'))) = 0 and len(list_filter(head, lambda v: v not in ({", ".join(f"'{v}'" for v in NO_BRAND)}))) > 0 then array_to_string(list_transform(head, lambda v: upper(v[1]) || v[2:]), ' ') end as brand from h""")
def m07_brand_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the third and fourth words of each page's title, if it can be a brand."""
    own = mk.parsed(t(spark, sf_dir, "pages")).select("page_id", F.coalesce(mk.first_text(F.col("page"), "title"), F.lit("")).alias("title"))
    words = F.split("title", " ")
    return own.select("page_id", brand_prefix(F.col("title"), F.concat_ws(" ", F.get(words, F.lit(2)), F.get(words, F.lit(3)))).alias("brand"))


#: Classes of search results: the first row whose tier is the result's, whose signals it all shows and whose bars it shows none of.
SOURCE_CLASSES = (
    ("official_root", "official", ("root",), ()),
    ("official_family", "official", ("line", "related"), ()),
    ("official_exact", "official", ("certain",), ("line",)),
    ("official_generic", "official", (), ()),
    ("major_retailer_exact", "major_retailer", ("related",), ("listing",)),
    ("major_retailer", "major_retailer", (), ()),
    ("secondary_retailer_exact", "secondary_retailer", ("related",), ("listing",)),
    ("secondary_retailer", "secondary_retailer", (), ()),
    ("marketplace_exact", "marketplace", ("identified",), ()),
    ("marketplace", "marketplace", (), ()),
)


def signals(path: Column, host: Column, identified: Column, variant: Column, overlap: Column, wanted: Column) -> Column:
    """What a search result shows: kinds of its path; identified (names the sku); related (or a variant's size, or a wanted word); certain (or all of the wanted words).

    overlap: how many of the wanted words it has; wanted: how many there are.
    """
    told = {"identified": identified, "related": identified | variant | (overlap > 0), "certain": identified | variant | F.when(wanted > 0, overlap == wanted).otherwise(overlap > 0)}
    return F.concat(se.path_kinds(path, host), F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in told.items()))))


def source_class(tier: Column, shown: Column) -> Column:
    """Class of a search result by SOURCE_CLASSES; unknown outside of the tiers."""
    words = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    has = lambda needs: F.size(F.array_intersect(words(needs), shown)) == len(needs)
    return F.coalesce(*(F.when((tier == of) & has(needs) & ~F.arrays_overlap(shown, words(bars)), name) for name, of, needs, bars in SOURCE_CLASSES), F.lit("unknown"))


_OVERLAP_SQL = "len(list_filter(['dog', 'bulk'], lambda w: list_contains(regexp_extract_all(path, '[a-z0-9]+'), w)))"


@query(f"""with {se.RESULTS_SQL}, r as (select *, {se._SEG} as s, {se._TIER_SQL} as tier, {_OVERLAP_SQL} as o, contains(path, 'pea') as ident from results), k as (select *, {se._CATEGORY_SQL} as listing, {se._LINE_SQL} as line from r)
select page_id, case when tier = 'official' then case when len(s) = 0 then 'official_root' when line then case when ident or o > 0 then 'official_family' else 'official_generic' end when ident or o = 2 then 'official_exact' else 'official_generic' end
when tier in ('major_retailer', 'secondary_retailer') then tier || case when not listing and (ident or o > 0) then '_exact' else '' end when tier = 'marketplace' then case when ident then 'marketplace_exact' else 'marketplace' end else 'unknown' end as class from k""")
def m11_source_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product wanted is a bulk bag for dogs, known by 'pea' in an address."""
    words = F.regexp_extract_all("path", F.lit("[a-z0-9]+"), F.lit(0))
    overlap = F.size(F.array_intersect(F.array(F.lit("dog"), F.lit("bulk")), words))
    path, host = F.col("path"), F.col("host")
    own = se.results(spark, sf_dir).withColumn("tier", se.tier(host, F.lit("Acme")))
    return own.select("page_id", source_class(F.col("tier"), signals(path, host, F.contains(path, F.lit("pea")), F.lit(False), overlap, F.lit(2))).alias("class"))


def selected(candidates: DataFrame, picks: DataFrame, keys: list[str], candidate: str, *order: Column | str) -> DataFrame:
    """keys, chosen, method: a selector's pick where it made one, else the best ranked candidate."""
    best = op.first_by(candidates, keys, *order).select(*keys, F.col(candidate).alias("__best"))
    own = best.join(picks.select(*keys, F.col(candidate).alias("__pick")), keys, "left")
    return own.select(*keys, F.coalesce("__pick", "__best").alias("chosen"), F.when(F.col("__pick").isNotNull(), "selector").otherwise("fallback").alias("method"))


@query("""with b as (select p_brand, p_partkey as best from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) = 1), k as (select p_brand, min(p_partkey) as pick from part where p_type = 'PROMO' and p_size >= 40 group by 1)
select p_brand, coalesce(pick, best) as chosen, case when pick is not null then 'selector' else 'fallback' end as method from b left join k using (p_brand)""")
def m19_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    picks = p.where("p_type = 'PROMO' and p_size >= 40").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    return selected(p, picks, ["p_brand"], "p_partkey", F.desc("p_retailprice"), "p_partkey")


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html: a page for each part with a graph of two products and a breadcrumb list, and a block that does not parse."""
    part = t(spark, sf_dir, "part")
    node = F.concat(F.lit('{"@type":"Product","name":"'), "p_name", F.lit('","brand":{"name":"'), "p_brand", F.lit('"},"sku":"'), F.col("p_partkey").cast("string"), F.lit('","image":["//cdn.a.com/1.png","//cdn.a.com/1.png"]}'))
    other = F.lit('{"@type":["Product"],"name":"other","image":"https://a.com/2.png"}')
    html = F.concat(F.lit('<html><script type="application/ld+json">not json</script><script type="application/ld+json">{"@graph":['), other, F.lit(","), node, F.lit(']}</script><script type="application/ld+json">[{"@type":"BreadcrumbList"}]</script></html>'))
    return part.select(F.col("p_partkey").alias("page_id"), html.alias("html"), "p_name", "p_brand")


@query("select p_partkey as page_id, 3 as nodes, 2 as products from part")
def n01_linked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of linked data: graphs and lists flattened, broken blocks passed over."""
    n = pg.linked_data(product_pages(spark, sf_dir))
    return n.groupBy("page_id").agg(F.count("*").cast("int").alias("nodes"), F.count_if(pg.of_type("Product")).cast("int").alias("products"))


@query("""select p_partkey as page_id, p_name as name, p_brand as brand, 'https://cdn.a.com/1.png' as images, 10 as score, 0.98::double as confidence from part""")
def n04_page_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that agrees best with what is expected of the page."""
    own = product_pages(spark, sf_dir)
    wanted = own.select("page_id", F.col("page_id").cast("string").alias("sku"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))
    return pg.products(own, wanted).select("page_id", "name", "brand", F.array_join("images", " ").alias("images"), "score", "confidence")


#: Ways of reading a field from text, tried in order: field, way, most characters, pattern of the value. "whole" takes the digits of a text that is little but its value; "only" takes a value that is the only one, however often it occurs.
READINGS = (
    ("upc", "whole", 24, r"^([^0-9]*[0-9]){8,14}[^0-9]*$"),
    ("upc", "labelled", None, r"(?i)\b(?:UPC|EA)[#:\sA-Z-]{0,20}([0-9]{8,14})\b"),
    ("upc", "only", None, r"\b([0-9]{8,14})\b"),
    ("rating", "first", None, r"([0-9]+(?:\.[0-9]+)?)"),
    ("reviews", "first", None, r"([0-9][0-9,]*)"),
)


def reading(text: Column, field: str) -> Column:
    """struct<value, way> of the first way that reads a field from a text, else null."""
    out = []
    for _, way, most, pattern in (r for r in READINGS if r[0] == field):
        if way == "whole":
            value = F.when(text.rlike(pattern), F.regexp_replace(text, "[^0-9]", ""))
        elif way == "only":
            every = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
            value = F.when(F.size(every) == 1, F.get(every, F.lit(0)))
        else:
            value = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        value = value if most is None else F.when(F.length(text) <= most, value)
        out.append(F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(way).alias("way"))))
    return F.coalesce(*out)


def sanitized(title: Column, upc: Column, rating: Column, reviews: Column) -> tuple[Column, Column]:
    """Fields of a payload (struct) and what was done to them (array of notes: field and read, dropped or range).

    A title over 300 characters and a rating above 5 are dropped; a field that no way reads is dropped if it held anything.
    """
    name, given = x.collapsed(title), {"upc": upc, "rating": rating, "reviews": reviews}
    own = {f: reading(text, f) for f, text in given.items()}
    stars = own["rating"]["value"].try_cast("double")
    notes = []
    for f, r in own.items():
        beyond = stars > 5 if f == "rating" else F.lit(False)
        notes.append(F.when(r.isNull(), F.when(F.trim(given[f]) != "", F.lit(f"{f} dropped"))).when(beyond, F.lit(f"{f} range")).when((r["way"] != "whole") & (r["value"] != given[f]), F.lit(f"{f} read")))
    fields = F.struct(F.when(F.length(name) <= 300, F.nullif(name, F.lit(""))).alias("title"), own["upc"]["value"].alias("upc"), F.when(stars <= 5, stars).alias("rating"), F.replace(own["reviews"]["value"], F.lit(","), F.lit("")).try_cast("int").alias("reviews"))
    return fields, F.array_compact(F.array(*notes))


@query(r"""with d as (select doc_id, text, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) as name, regexp_replace(text, '[^0-9]', '', 'g') as digits, regexp_extract(text, '(?i)\b(?:UPC|EA)[#:\sA-Z-]{0,20}([0-9]{8,14})\b', 1) as labelled, list_distinct(regexp_extract_all(text, '\b([0-9]{8,14})\b', 1)) as codes,
regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)', 1) as stars, regexp_extract(text, '([0-9][0-9,]*)', 1) as counted from (select doc_id, coalesce(text, '') as text from documents)),
u as (select *, case when length(text) <= 24 and length(digits) between 8 and 14 then 'whole' when labelled <> '' then 'labelled' when len(codes) = 1 then 'only' end as way, try_cast(nullif(stars, '') as double) as rated from d)
select doc_id, case when length(name) <= 300 then nullif(name, '') end as title, case way when 'whole' then digits when 'labelled' then labelled when 'only' then codes[1] end as upc, case when rated <= 5 then rated end as rating, try_cast(replace(nullif(counted, ''), ',', '') as int) as reviews,
array_to_string(list_filter([case when way is null and trim(text) <> '' then 'upc dropped' when way in ('labelled', 'only') and text <> case way when 'labelled' then labelled else codes[1] end then 'upc read' end,
case when stars = '' then case when trim(text) <> '' then 'rating dropped' end when rated > 5 then 'rating range' when stars <> text then 'rating read' end,
case when counted = '' then case when trim(text) <> '' then 'reviews dropped' end when counted <> text then 'reviews read' end], lambda s: s is not null), '; ') as notes from u""")
def c19_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as if it were a payload's fields: its first line a title, its whole text a code, a rating and a number of reviews."""
    text = F.coalesce("text", F.lit(""))
    fields, notes = sanitized(F.substring_index(text, "\n", 1), text, text, text)
    own = t(spark, sf_dir, "documents").select("doc_id", fields.alias("f"), notes.alias("w"))
    return own.select("doc_id", "f.title", "f.upc", "f.rating", "f.reviews", F.array_join("w", "; ").alias("notes"))


_LAST = "regexp_extract(url, '([^/]*)$', 1)"
_LEADING = "coalesce(try_cast(nullif(regexp_extract(trim({0}), '^[+-]?\\d*\\.?\\d+'), '') as double), 0)"


@query(f"select page_id, {_LEADING.format(_LAST)} as price, cast(floor({_LEADING.format('html')}) as int) as quantity, {_LEADING.format(_TITLE)} as weight from pages")
def a03_typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a text begins with, 0 where it begins with none: the last part of an address, the markup and the title of each page."""
    number = lambda c: F.coalesce(leading_number(c), F.lit(0.0))
    own = mk.parsed(t(spark, sf_dir, "pages").withColumn("source", F.col("html"))).select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("a"), F.col("source").alias("b"), mk.first_text(F.col("page"), "title").alias("c"))
    return own.select("page_id", number(F.col("a")).alias("price"), F.floor(number(F.col("b"))).cast("int").alias("quantity"), number(F.col("c")).alias("weight"))


_MENU = "list_transform(" + _NAV + ", lambda w: trim(w))"


@query(f"""with p as (select page_id, {_MENU} as menu, nullif({_TITLE}, '') as title, regexp_extract(url, '://([^/]*)', 1) as host, {_LINKS} as links from pages),
l as (select page_id, list_filter(list_transform(menu || menu, lambda w: w), lambda w: w <> '') as w from p), d as (select page_id, list_filter(w, lambda v, i: list_position(list_transform(w, lambda z: lower(z)), lower(v)) = i) as w from l)
select page_id, coalesce(case when page_id % 3 = 0 then title end, host) as brand, array_to_string(d.w, '|') as category, '' as weight, array_to_string(list_filter(p.links[1:3], lambda v: v <> ''), ' ') as images from p join d using (page_id)""")
def a16_field_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first filled alias of each field; lists between pipes without repeats; required fields empty where none is filled; all images in order. A page's title, host, menu and links are the fields."""
    page = F.col("page")
    menu = x.bound(mk.numbered(page), lambda every: F.transform(mk.selected(every, "nav a"), lambda e: mk.text_of(page, e["e"])))
    raw = mk.parsed(t(spark, sf_dir, "pages")).select("page_id", F.when(F.col("page_id") % 3 == 0, mk.first_text(page, "title")).alias("ProductField16"), F.regexp_extract("url", "://([^/]*)", 1).alias("Brand"), menu.alias("menu"), mk.attributes_of(page, "nav a", "href").alias("links"))
    image = lambda k: F.coalesce(F.get("links", F.lit(k)), F.lit("None"))
    own = raw.select("page_id", "ProductField16", "Brand", F.array_join(F.concat("menu", "menu"), " | ").alias("ProductField24"), image(0).alias("Graphic"), F.lit(" ").alias("MoreInfoImage1"), image(1).alias("MoreInfoImage2"), image(2).alias("MoreInfoImage3"))
    filled = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in own.columns), F.lit(""))
    images = F.filter(F.array(*(F.trim(F.col(n)) for n in own.columns if n == "Graphic" or n.startswith("MoreInfoImage"))), lambda v: (v != "") & (F.lower(v) != "none"))
    return own.select("page_id", filled("ProductField16", "Brand").alias("brand"), F.array_join(x.pipe_values("ProductField24"), "|").alias("category"), filled("Weight").alias("weight"), F.array_join(images, " ").alias("images"))
