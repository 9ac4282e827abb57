"""Small tables with results worked out by hand."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.functions import statistics as st
from shelfloom.functions import text as x
from shelfloom.operators import tables as op
from shelfloom.operators.taxonomy import descendants, tree
from shelfloom.sources import feeds
from shelfloom.streaming import events as ev


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column("v")).first()[0]


@pytest.mark.parametrize(("text", "pounds"), [("16 oz", "1.00"), ("5 lb", "5.00"), ("1 lb 8 oz", "1.50"), ("500 g", "1.10"), ("N/A", None), ("", None), ("invalid", None), (None, None)])
def test_pounds(spark, text, pounds):
    assert one(spark, x.pounds, text) == pounds


@pytest.mark.parametrize(("text", "name"), [("sm blk collar 5 lbs", "Small Black Collar 5 lb."), ("ACME chkn 10 ounces", "ACME Chicken 10 oz."), ("rug 2x4 feet", "Rug 2 X 4 ft."), ("bag 5.50 lb", "Bag 5.5 lb."), ("", "")])
def test_product_name(spark, text, name):
    assert one(spark, x.product_name, text) == name


@pytest.mark.parametrize(("text", "valid"), [("036000291452", True), ("0-36000-29145-2", True), ("036000291453", False), ("12", False), ("abc", False), ("", False)])
def test_upc(spark, text, valid):
    assert one(spark, x.valid_upc, text) is valid


@pytest.mark.parametrize(("url", "plain"), [("HTTPS://Shop.Example.com/a/?utm_source=x&b=2&a=1#top", "https://shop.example.com/a?b=2&a=1"), ("https://x.com", "https://x.com/"), ("not a url", "not a url"), ("", "")])
def test_url(spark, url, plain):
    assert one(spark, x.canonical_url, url) == plain


def test_lists(spark):
    assert one(spark, x.pipe_values, " Dog | dog|Cat||") == ["Dog", "Cat"]
    assert one(spark, x.keyword_list, "a, b;A|c\nb") == "a, b, c"
    assert one(spark, x.pipe_values, None) == []
    assert one(spark, x.slug, " Wild  Bird & Seed! ") == "wild-bird-seed"
    assert one(spark, x.snake, "unitPrice Max") == "unit_price_max"
    assert one(spark, lambda c: x.truncated(c, 10), "hello wide world") == "hello..."


def test_merge_and_upsert(spark):
    a = spark.createDataFrame([("s1", {"x": 1, "y": 2}), ("s2", {"x": 3})], "sku string, sources map<string,int>")
    b = spark.createDataFrame([("s1", {"y": 9}), ("s3", {"z": 4})], "sku string, sources map<string,int>")
    got = {r.sku: r.sources for r in op.merged_sources(a, b, "sku").collect()}
    assert got == {"s1": {"x": 1, "y": 9}, "s2": {"x": 3}, "s3": {"z": 4}}
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, op.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, op.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    with pytest.raises(ValueError, match="1 values"):
        op.strict_persist(new, old, "k")
    assert op.balanced_slices(old.limit(0), 5, "k").count() == 0


def test_tree(spark):
    nodes = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "d", None)], "id int, name string, parent_id int")
    assert {(r.id, r.depth, tuple(r.names), r.is_leaf) for r in tree(nodes).collect()} == {(1, 1, ("a",), False), (2, 2, ("a", "b"), False), (3, 3, ("a", "b", "c"), True), (4, 1, ("d",), True)}
    assert {r.id for r in descendants(nodes, 2).collect()} == {2, 3}


def test_feeds(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Item #,Description,Price\nA1," Big ""red"", bowl ",12.5\nB2,Leash\n')
    assert [tuple(r) for r in feeds.csv(spark, str(tmp_path / "f.csv")).collect()] == [("A1", 'Big "red", bowl', "12.5"), ("B2", "Leash", "")]
    line = "HD1" + "SKU000000001" + "012345678905" + "Hammer".ljust(33) + "00001299" + "00000850" + "000250"
    (tmp_path / "f.txt").write_text(f"{line}\nXX\n\n")
    r = feeds.fixed_width(spark, str(tmp_path / "f.txt"), prefix="HD1").collect()
    assert [(v.name, v.price, v.cost, v.quantity) for v in r] == [("Hammer", 12.99, 8.5, 250)]
    rows = spark.createDataFrame([(1, "s1", "Bowl", "red", "$1,200.50", "7 ea"), (2, "s1", "Later", "", "1", "1"), (3, "", "No sku", "", "", "")], "o int, SKU_NO string, DESCRIPTION1 string, DESCRIPTION2 string, PRICE string, QOH string")
    assert [tuple(v) for v in feeds.register_rows(rows, "o").collect()] == [("s1", "Bowl red", 1200.5, 7)]


def test_statistics(spark):
    assert st.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert st.t_quantile(0.95, 9) == pytest.approx(2.2621572, abs=1e-6)
    row = spark.createDataFrame([(8, 2)], "w int, l int").select(st.sign_p_value("w", "l")).first()
    assert row[0] == pytest.approx(0.109375)
    import math

    for w, l in ((0, 0), (5, 5), (1, 9), (300, 240)):
        exact = min(1.0, 2 * sum(math.comb(w + l, k) for k in range(min(w, l) + 1)) / 2 ** (w + l)) if w + l else 1.0
        assert st.sign_two_sided(w, l) == pytest.approx(exact, rel=1e-9)
        if w + l:
            assert min(1.0, 2 * st.incomplete_beta(max(w, l), min(w, l) + 1, 0.5)) == pytest.approx(exact, rel=1e-9)
    assert 0 < st.sign_two_sided(500_600, 499_400) < 1
    pairs = spark.createDataFrame([("a", v) for v in (1.0, 2.0, -3.0, 0.0, 4.0)] + [("b", v) for v in (1.0, -1.0, 1.0, 2.0)] + [("c", 0.0)], "k string, d double")
    got = {r.k: (r.n, r.w, r.z) for r in st.signed_rank(pairs, "d", "k").collect()}
    assert got["a"][:2] == (4, 3.0) and got["a"][2] == pytest.approx((3 - 5) / math.sqrt(7.5))
    assert got["b"][:2] == (4, 2.0) and got["b"][2] == pytest.approx((2 - 5) / math.sqrt(7.5 - 24 / 48))
    assert "c" not in got


def test_t_interval(spark):
    """Ten differences of mean 1: 2.262157 standard errors to each side; none with one row."""
    df = spark.createDataFrame([(9.0,), (29.0,), (0.0,), (None,)], "df double")
    margins = [r[0] for r in df.select(st.t_margin("df")).collect()]
    assert margins[:2] == [pytest.approx(2.2621572, abs=1e-6), pytest.approx(2.0452296, abs=1e-6)] and margins[2:] == [None, None]


def test_payloads(spark):
    from shelfloom.functions import payload as pl

    rows = ['{"a":{"ERROR":1,"b":[{"message":2,"c":"ü"}]}}', "not json", None, '"x"', '{"Hero":{"x":{"y":{"z":{"u":{"v":{"deep":"/i.png"}}}}}},"p":" /k.png "}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string").orderBy("i")
    assert [r[0] for r in df.select(pl.without_keys(F.col("v"))).collect()][:4] == ['{"a":{"b":[{"c":"ü"}]}}', None, None, '"x"']
    assert [r[0] for r in df.select(pl.image_candidates(F.col("v"))).collect()] == [[], [], [], [], ["/k.png"]]
    many = spark.createDataFrame([("[" + ",".join(f'"/{i}.png"' for i in range(30)) + "]",)], "v string")
    assert many.select(F.size(pl.image_candidates(F.col("v")))).first()[0] == 24


def test_bulk_transition_resets(spark):
    rows = spark.createDataFrame([("a", "scraped", 1), ("b", "scraped", 2)], "sku string, status string, result int")
    moves = spark.createDataFrame([("a", "imported")], "sku string, to_status string")
    assert sorted(map(tuple, ev.bulk_transition(rows, moves, "sku", ("result",)).select("sku", "status", "result").collect())) == [("a", "imported", None), ("b", "scraped", 2)]
    with pytest.raises(ValueError, match="nothing changes"):
        ev.bulk_transition(rows, spark.createDataFrame([("a", "imported"), ("b", "exporting")], "sku string, to_status string"), "sku", ("result",))


def plain_breaker(rows, threshold, cool):
    state, failures, opened = "closed", 0, None
    for at, ok in rows:
        if state == "open":
            if (at - opened).total_seconds() < cool:
                continue
            state = "half_open"
        if ok:
            state, failures, opened = "closed", 0, None
        else:
            failures += 1
            if state == "half_open" or failures >= threshold:
                state, opened = "open", at
    return state, failures


def test_breaker_batch_and_stream(spark, tmp_path):
    ev.with_rocksdb(spark)
    rng = np.random.default_rng(3)
    start = datetime(2024, 1, 1)
    rows = [(int(rng.integers(3)), start + timedelta(minutes=10 * i), i, bool(rng.random() < 0.5)) for i in range(200)]
    schema = "site long, ts timestamp, event_id long, ok boolean"
    expected = {s: plain_breaker([(r[1], r[3]) for r in rows if r[0] == s], 3, 3600) for s in range(3)}
    df = spark.createDataFrame(rows, schema)
    assert {r.site: (r.state, r.failures) for r in ev.breaker_replay(df).collect()} == expected
    for k, part in enumerate((rows[:100], rows[100:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = ev.circuit_breaker(stream).writeStream.outputMode("update").format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {r.site: (r.state, r.failures) for r in spark.table("breaker").collect()}
    finally:
        q.stop()
    assert got == expected


def test_stream_windows(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = ev.windowed_counts(ev.deduplicated(stream)).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        closed = spark.table("windows").agg(F.sum("n")).first()[0]
    finally:
        q.stop()
    assert 0 < closed <= e.count()


def test_transitions(spark):
    rows = spark.createDataFrame([("a", "imported"), ("b", "scraped")], "sku string, status string")
    ok = spark.createDataFrame([("a", "scraping")], "sku string, to_status string")
    assert {r.sku: r.status for r in ev.bulk_transition(rows, ok, "sku").collect()} == {"a": "scraping", "b": "scraped"}
    with pytest.raises(ValueError, match="not allowed"):
        ev.bulk_transition(rows, spark.createDataFrame([("b", "exporting")], "sku string, to_status string"), "sku")


def test_workflow(spark):
    from shelfloom.functions import workflow

    html = "<table><tr><th>Brand</th><td> <b>Acme</b> </td></tr><tr><td>Size</td><td>5 lb</td></tr><tr><td>Brand</td><td>Late</td></tr></table>"
    df = spark.createDataFrame([("a UPC#: BAG: 811048023995 x", html, '{"p": {"tags": ["x", "y"]}}', "2.2 kg"), ("nothing", "", "{}", "heavy"), (None, None, None, None)], "raw string, html string, js string, w string")
    steps = [
        {"action": "transform_value", "params": {"field": "raw", "target": "upc", "transformations": [{"type": "regex_extract", "pattern": r"UPC#?:\s*(?:\w+:\s*)?(\d{12})"}]}},
        {"action": "parse_table", "params": {"field": "html", "target": "specs"}},
        {"action": "extract_from_json", "params": {"field": "js", "path": "p.tags.1", "target": "tag"}},
        {"action": "parse_weight", "params": {"field": "w", "target": "grams", "unit": "g"}},
        {"action": "conditional", "params": {"field": "upc", "condition": "field_exists", "then": [{"action": "combine_fields", "params": {"format": "upc {upc}", "target": "label"}}], "else": [{"action": "combine_fields", "params": {"format": "no code", "target": "label"}}]}},
    ]
    got = workflow.run(df, steps).select("upc", "specs", "tag", "grams", "label").collect()
    assert tuple(got[0]) == ("811048023995", {"Size": "5 lb", "Brand": "Late"}, "y", 2200.0, "upc 811048023995")
    assert tuple(got[1]) == (None, {}, None, None, "no code") and tuple(got[2])[0] is None and got[2].label == "no code"
    with pytest.raises(ValueError, match="unknown action"):
        workflow.run(df, [{"action": "click"}])
    assert workflow.substituted({"a": "{x} {{y}} {z}"}, {"x": "1", "y": "2"}) == {"a": "1 2 {z}"}
    assert one(spark, x.title_words, "o'neil foo-bar 2nd") == "O'Neil Foo-Bar 2Nd"
    assert one(spark, x.variant_tokens, "Crate 36 x 24 inches, 2 packs 5.5 lbs") == ["24x36", "2ct", "5.5lb"]


def test_pages(spark):
    from shelfloom.operators import pages

    html = """<meta content="Seed Mix" property="og:title"><script type="application/ld+json">{"@graph": [
      {"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"item": {"name": "Birds"}}, {"name": "Seed"}, {"name": "Seed"}]},
      {"@type": ["Product", "Thing"], "name": "Other mix", "image": "//x.com/a.png"},
      {"@type": "Product", "name": "Acme  Seed Mix", "brand": {"name": "Acme"}, "sku": "00-12", "image": ["https://x.com/b.png", "https://x.com/b.png", "b.png"]},
      {"@type": "Product", "name": "No image", "sku": "0012"}]}</script><script type="application/ld+json">{broken</script>"""
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    wanted = spark.createDataFrame([(1, "0012", "ACME", "seed mix"), (2, "1", "b", "c")], "page_id long, sku string, brand string, name string")
    got = pages.products(df, wanted).collect()
    assert [(r.page_id, r.name, r.brand, r.sku, r.images, r.score) for r in got] == [(1, "Acme Seed Mix", "Acme", "00-12", ["https://x.com/b.png"], 10)]
    assert got[0].confidence == 0.98
    assert [tuple(r) for r in pages.breadcrumbs(df).collect()] == [(1, ["Birds", "Seed"])]
    assert [r[0] for r in df.select(pages.meta(F.col("html"), "og:title")).collect()] == ["Seed Mix", None, None]


def test_trees_of_any_depth(spark):
    chain = spark.createDataFrame([(i, f"n{i}", i - 1 if i else None) for i in range(300)], "id int, name string, parent_id int")
    got = {r.id: r for r in tree(chain).collect()}
    assert len(got) == 300 and got[299].depth == 300 and got[299].path == list(range(300)) and [i for i, r in got.items() if r.is_leaf] == [299]
    with pytest.raises(ValueError, match="cycle"):
        tree(spark.createDataFrame([(1, "a", None), (2, "b", 3), (3, "c", 2)], "id int, name string, parent_id int"))
    assert tree(chain.limit(0)).count() == 0 and {r.id for r in descendants(chain, 295).collect()} == set(range(295, 300))


def test_paired_keys_have_to_be_equal(spark):
    from shelfloom.plans.search import paired

    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int"), spark.createDataFrame([(1, 5), (2, 6)], "k int, b int")
    assert paired(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError, match="1 keys are on one side only"):
        paired(a, b.where("k = 1"), ["k"])
    with pytest.raises(ValueError, match="1 are repeated"):
        paired(a.union(a.where("k = 1")), b, ["k"])


@pytest.mark.parametrize(("text", "name"), [("5.567lb bag", "5.57 lb. Bag"), ('rope 2.50 gallons in 4"', "Rope 2.5 gal. In 4 in."), ("tank 10 LITERS", "Tank 10 L"), ("mulch 2 cu ft", "Mulch 2 cf."), ("", "")])
def test_units_in_names(spark, text, name):
    assert one(spark, x.product_name, text) == name


def test_intake(spark):
    from shelfloom.plans import intake

    with pytest.raises(ValueError, match="no adapter"):
        intake.feed(spark, "edi", "/nowhere")
    with pytest.raises(ValueError, match="is a sku column"):
        intake.sku_rows(spark.createDataFrame([("a",)], "name string"))
    both = spark.createDataFrame([("1", " a ", None), (" ", "b", "x"), (None, "c", "y")], "SKU_NO string, sku string, note string")
    assert [tuple(r) for r in intake.sku_rows(both).collect()] == [("1", "a", "")]


def test_traits(spark):
    from shelfloom.plans import traits

    df = spark.createDataFrame([("k-9 food up to 7 lb",), ("CATS over 9 lb",), (None,)], "v string")
    least, most = traits.weight_range(F.col("v"))
    assert [tuple(r) for r in df.select(traits.traits(F.col("v"), traits.PET_TYPES), least, most).collect()] == [(["Dog"], None, 7), (["Cat"], 9, None), ([], None, None)]
    names = spark.createDataFrame([("Purina Pro Chow dog", "chow"), ("chow", "chow"), ("9 dog chow", "chow"), ("x 2 chow", "chow"), ("acme thing", None)], "c string, n string")
    assert [r[0] for r in names.select(traits.brand_prefix(F.col("c"), F.col("n"))).collect()] == ["Purina Pro", None, None, None, None]


def test_readings_of_fields(spark):
    from shelfloom.plans import traits

    rows = [("0 12345-67890", "4.5", "12"), ("see UPC#: 123456789012 and 999999999999 there, a long text", "4.5 of 5", "(1,200 reviews)"), ("code 12345678 and once more 12345678, nothing else at all", "9", "x"), ("12345678 or 87654321, which of them", "", " "), (None, None, None)]
    fields, notes = traits.sanitized(F.lit(" a  b "), F.col("u"), F.col("r"), F.col("n"))
    got = spark.createDataFrame(rows, "u string, r string, n string").select(fields.alias("f"), notes.alias("notes")).collect()
    assert [(g.f.upc, g.f.rating, g.f.reviews, g.notes) for g in got] == [
        ("01234567890", 4.5, 12, []), ("123456789012", 4.5, 1200, ["upc read", "rating read", "reviews read"]), ("12345678", None, None, ["upc read", "rating range", "reviews dropped"]),
        (None, None, None, ["upc dropped"]), (None, None, None, []),
    ]


def test_classes_of_results(spark):
    from shelfloom.plans import search, traits

    rows = [("/Products/Dog//Food/", "acme.com", "official", 1), ("/products/dog/food", "chewy.com", "major_retailer", 1), ("/collections/dog", "chewy.com", "major_retailer", 1), ("//", "acme.com", "official", 0), (None, "ebay.com", "marketplace", 0), ("/a/b/c/d", "acme.com", "official", 2), ("/c/x", "acme.com", "official", 0), ("/S", "x.com", "unknown", 3)]
    df = spark.createDataFrame(rows, "path string, host string, tier string, overlap int")
    shown = traits.signals(F.col("path"), F.col("host"), F.lit(False), F.lit(False), F.col("overlap"), F.lit(2))
    got = df.select(search.path_kinds(F.col("path"), F.col("host")).alias("k"), traits.source_class(F.col("tier"), shown).alias("c")).collect()
    assert [(r.k, r.c) for r in got] == [(["line"], "official_family"), ([], "major_retailer_exact"), (["listing"], "major_retailer"), (["root"], "official_root"), (["root"], "marketplace"), (["listing"], "official_exact"), ([], "official_generic"), (["listing"], "unknown")]


def test_entries_of_sources_are_merged_field_by_field(spark):
    a = spark.createDataFrame([(1, {"x": {"p": "1", "q": "1"}, "y": {"p": "2"}}), (2, {"x": {"p": "1"}}), (4, None)], "k int, sources map<string, map<string, string>>")
    b = spark.createDataFrame([(1, {"x": {"q": "9", "r": None}, "z": {}}), (3, {"x": {"p": "3"}}), (4, {"x": None})], "k int, sources map<string, map<string, string>>")
    got = {r.k: r.sources for r in op.merged_sources(a, b, "k").collect()}
    assert got == {1: {"x": {"p": "1", "q": "9", "r": None}, "y": {"p": "2"}, "z": {}}, 2: {"x": {"p": "1"}}, 3: {"x": {"p": "3"}}, 4: {"x": None}}
