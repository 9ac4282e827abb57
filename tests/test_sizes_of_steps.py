"""Steps whose cost has to stay in proportion to the rows."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from shelfloom import catalog
from shelfloom.functions.workflow import parse_table
from shelfloom.operators import markup as mk


def test_pages_go_to_python_by_size(spark):
    """2,000 pages of 40,000 characters in one task: Python gets a few MB of them at a time."""
    pages = spark.range(0, 2000, 1, 1).select("id", F.concat(F.lit("<p>"), F.repeat(F.lit("x"), 40_000)).alias("html"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert mk.parsed(pages).agg(F.sum(F.length("page.text"))).first()[0] == 2000 * 40_000

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    assert 1 << 20 < pages.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 1 << 23


def test_tables_of_many_rows(spark):
    """Cells are read once, not once for every row; the last of equal keys stays."""
    rows = "".join(f"<tr><td>k{k % 1500}</td><td>{k}</td></tr>" for k in range(2000))
    df = spark.createDataFrame([(f"<table>{rows}</table>",), ("<tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr><tr><td>a</td><td>3</td></tr>",), ("",), (None,)], "html string").repartition(1)
    began = time.time()
    got = df.select(parse_table({"html": F.col("html")}, {"field": "html", "target": "m"})["m"].alias("m")).collect()
    assert time.time() - began < 20
    assert sorted((len(r.m) if r.m is not None else -1) for r in got) == [-1, 0, 2, 1500]
    big, small = (next(r.m for r in got if r.m and len(r.m) == n) for n in (1500, 2))
    assert small == {"a": "3", "b": "2"} and all(int(v) == int(k[1:]) + (1500 if int(k[1:]) < 500 else 0) for k, v in big.items())


def test_fields_of_an_order_are_read_once(spark):
    """Below the step that makes a row for each line, not above it."""
    plan = catalog.queries()["a15_shop_orders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate explode")
    assert "<FullName" in below and "<FullName" not in above
