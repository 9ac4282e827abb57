"""The field of personal data on lines like those of real texts, and on the given documents."""

import re

import pytest

from shelfloom.llm import pii

HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
#: Lines without personal data, labelled by hand.
CLEAN = [
    f"commit {HEX}", f"fixed in {HEX}, see the log", HEX, f"Merge {HEX[:32]} into main", f"sha256:{HEX}{HEX[:24]}", f"https://example.com/files/{HEX}.png", f"see //a.com/{HEX}", f"src=\"//cdn.a.com/x/{HEX}\"", f"http://a.com/?v={HEX}",
    "2024-01-02T03:04:05.123456", "at 2024-01-02T03:04:05Z the job ended", "from 2024-01-02 03:04:05 to 2024-01-03", "model ABC1234567", "order AB1234567 was sent", "flight LH1234567", "Einstein-Podolsky-Rosen-Experiment2020", "Donaudampfschifffahrtsgesellschaft-Kapitän-2021",
    "id 123e4567-e89b-12d3-a456-426614174000 of the row", "IMG_20240102_123456789.jpg", "/usr/lib/x86_64-linux-gnu/libabc123def456.so", "isbn 978-3-16-148410-0", "ean 4006381333931", "the key to success is 3 things", "token ring networks of 1985", "password reset instructions follow", "call extension 12345", "v1.2.3-rc4+build20240102", "x = 3.14159265358979",
]
#: Lines with personal data, and what is to be found.
MARKED = [
    (f'token = "{HEX}" of, ornd', HEX), (f'token = "{HEX}"### La', HEX), (f'TOKEN = "{HEX.upper()}"!! A,!!', HEX.upper()), (f"password={HEX[:20]} ok", HEX[:20]), ("api_key: AbC123dEf456GhI789jKl0", "AbC123dEf456GhI789jKl0"), (f"the secret = '{HEX[:24]}'.", HEX[:24]),
    ("ssn 123-45-6789", "123-45-6789"), ("his passport no AB1234567 expired", "AB1234567"), ("iban DE89370400440532013000 please", "DE89370400440532013000"),
]


@pytest.fixture(scope="module")
def weights():
    return pii.field()


def test_clean_lines_are_left_alone(weights):
    wrong = [(line, [line[a:b] for a, k, b in every if k >= len(pii.BASE)]) for line, (_, every) in zip(CLEAN, pii.spans_of(CLEAN, weights), strict=True) if any(k >= len(pii.BASE) for _, k, _ in every)]
    assert not wrong


def test_marked_lines_are_found_to_the_character(weights):
    lines = [line for line, _ in MARKED]
    found = [[line[a:b] for a, k, b in every if k >= len(pii.BASE)] for line, (_, every) in zip(lines, pii.spans_of(lines, weights), strict=True)]
    assert found == [[value] for _, value in MARKED]


def test_field_on_documents(spark, weights):
    """Every secret of the given documents stands in quotes behind a cue; nothing else there is one."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    right = found = told = 0
    for text, (_, every) in zip(texts, pii.spans_of(texts, weights), strict=True):
        true = {m.span(1) for m in re.finditer(r'token\s*=\s*"([0-9a-f]{40})"', text, re.IGNORECASE)} | {(m.start(1), m.end(1)) for m in re.finditer(r'TOKEN = "([0-9A-F]{40})"', text)}
        own = {(a, b) for a, k, b in every if k >= len(pii.BASE)}
        right, found, told = right + len(true & own), found + len(own), told + len(true)
    assert told >= 10 and right == told and right == found
