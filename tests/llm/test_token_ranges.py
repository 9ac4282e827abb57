"""Token files where ranges are few: a task cuts its range into several files, copies of one row too."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import common, tokenfile


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.prepared(spark)


def test_few_ranges_make_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "MOST_RANGES", 2)
    copies = [(5, "the same text of one row " * 4)] * 500 + [(i, f"document {i}") for i in range(200)] + [(9, "long " * 2000), (None, None)]
    df = spark.createDataFrame(copies, "doc_id long, text string")
    out = f"file://{tmp_path}/few"
    manifest = tokenfile.write_token_files(df, out, P.path("word_bpe_49k.json"), "word", shard_chars=2000)
    files = manifest.orderBy("shard").collect()
    assert 15 < len(files) < 60 and len({r.shard // tokenfile.MOST_FILES for r in files}) == 2 and max(r.n_docs for r in files) < 300
    got = tokenfile.read_token_files(spark, out).toPandas().sort_values("start")
    assert len(got) == len(copies) and got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    assert got.doc_id.isna().tolist()[0] and got.doc_id.dropna().is_monotonic_increasing
    assert tokenfile.read_token_files(spark, out, [5]).agg(F.count("*")).first()[0] == 501
