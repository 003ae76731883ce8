"""Masks, keywords and paging: literal outcomes, and properties that hold for
any input."""

import json

import pytest
from hypothesis import given, settings, strategies as st

from tierline.functions.pii import mask_for
from tierline.functions.text import STOP_WORDS, keywords
from tierline.sources.pages import land_pages

MASKS = [
    ("email", "j.doe@example.com", "j***@example.com"), ("email", "a@b@c", "a***@b@c"), ("email", "no at sign", "***"),
    ("email", "@host", "***@host"), ("email", "", "***"), ("email", None, None), ("work_email", "é@x", "é***@x"),
    ("phone", "+1 (555) 010-0123", "***-***-0123"), ("phone", "123", "***"), ("phone", "", "***"), ("phone", None, None),
    ("mobile", "a1b2c3d4", "***-***-1234"),
    ("full_name", "Ada King Lovelace", "A*** K*** L***"), ("full_name", "  x\ty ", "x*** y***"), ("full_name", "", ""),
    ("name", "Zoë", "Z***"), ("name", None, None),
    ("ssn", "123-45-6789", "[REDACTED]"), ("ssn", "", "[REDACTED]"), ("ssn", None, None),
]


def test_masks_of_known_values(spark):
    for column in {c for c, _, _ in MASKS}:
        cases = [(i, v) for i, (c, v, _) in enumerate(MASKS) if c == column]
        got = {r.i: r.m for r in spark.createDataFrame(cases, f"i int, `{column}` string").select("i", mask_for(column).alias("m")).collect()}
        assert got == {i: MASKS[i][2] for i, _ in cases}


TEXT = st.text(alphabet=st.sampled_from(list("ab@.- 0123456789xé\tZ+()")), max_size=20)


@settings(max_examples=10, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_masks_never_show_more_than_their_rest(spark, values):
    """A phone shows at most four digits, a name one letter a word, an e-mail
    one character of its local part, anything else nothing; null stays null."""
    cols = ["email", "phone", "full_name", "ssn"]
    df = spark.createDataFrame([(v, v, v, v) for v in [*values, None]], ", ".join(f"{c} string" for c in cols))
    *rows, null = df.select(*[mask_for(c).alias(c) for c in cols]).collect()
    assert tuple(null) == (None,) * 4
    for v, r in zip(values, rows, strict=True):
        assert sum(c.isdigit() for c in r.phone) in (0, 4) and r.phone.startswith("***")
        assert all(len(w) == 4 and w.endswith("***") for w in r.full_name.split())
        assert r.ssn == "[REDACTED]"
        hidden = r.email.split("@")[0]
        assert hidden.endswith("***") and len(hidden) <= 4 and r.email.endswith(v[v.index("@"):] if "@" in v else "***")


KEYWORDS = [
    ("What orders have the highest Total?", ["orders", "highest", "total"]),
    ("orders, ORDERS and orders2024x", ["orders", "orders", "orders"]),
    ("abc de 1234", []), ("", []), (None, []), ("tableau table tables", ["tableau", "tables"]),
    ("caféteria", ["teria"]),
]


def test_keywords_of_known_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KEYWORDS)], "i int, q string")
    got = {r.i: r.k for r in df.select("i", keywords("q").alias("k")).collect()}
    assert got == {i: k for i, (_, k) in enumerate(KEYWORDS)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdeTHISwithdata .,É")), max_size=40), min_size=1, max_size=10))
def test_keywords_are_words_of_the_text_in_order(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    for t, r in zip(texts, df.select(keywords("q").alias("k")).collect(), strict=True):
        rest = t.lower()
        for w in r.k:
            assert len(w) >= 4 and w.isascii() and w.isalpha() and w not in STOP_WORDS
            rest = rest[rest.index(w) + len(w):]


def pages(spark, counts, cursors=None, first=0):
    rows = []
    for i, n in enumerate(counts):
        body = {"items": [{"p": i, "i": k} for k in range(n)], "meta": {"next_cursor": (cursors or {}).get(i)}}
        rows.append(("x", first + i, f"u{i}", None, json.dumps(body)))
    return spark.createDataFrame(rows, "pull_id string, page int, url string, link_header string, body string")


def landed(df, *args, **kw):
    return sorted({r.page for r in land_pages(df, *args, **kw).collect()})


OFFSETS = [     # records per page, page size, pages allowed -> pages landed
    ([2, 2, 2], 2, 10, [0, 1, 2]), ([2, 1, 2], 2, 10, [0, 1]), ([2, 0, 2], 2, 10, [0]), ([0, 2], 2, 10, []),
    ([2, 2, 2, 2], 2, 3, [0, 1, 2]), ([3, 3], 2, 10, [0, 1]), ([1], 5, 1, [0]),
]


@pytest.mark.parametrize("first", [0, 1, 7])
def test_offset_pages(spark, first):
    for counts, size, most, want in OFFSETS:
        assert landed(pages(spark, counts, first=first), "offset", "items", page_size=size, max_pages=most) == [first + p for p in want]


CURSORS = [     # records per page, pages with a cursor, pages allowed -> pages landed
    ([1, 1, 1], {0: "a", 1: "b", 2: "c"}, 10, [0, 1, 2]), ([1, 1, 1], {0: "a"}, 10, [0, 1]), ([1, 1], {}, 10, [0]),
    ([1, 0, 1], {0: "a", 1: "b", 2: "c"}, 10, [0]), ([1, 1, 1, 1], {i: "c" for i in range(4)}, 2, [0, 1]),
]


@pytest.mark.parametrize("first", [0, 1])
def test_cursor_pages(spark, first):
    for counts, cursors, most, want in CURSORS:
        assert landed(pages(spark, counts, cursors, first), "cursor", "items", max_pages=most) == [first + p for p in want]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=8), st.integers(1, 4), st.integers(1, 9))
def test_offset_landing_is_a_prefix_that_grows_with_the_bound(spark, counts, size, most):
    df = pages(spark, counts)
    got = landed(df, "offset", "items", page_size=size, max_pages=most)
    assert got == list(range(len(got))) and len(got) <= most
    assert all(counts[p] >= size for p in got[:-1]) and all(counts[p] > 0 for p in got)
    assert landed(df, "offset", "items", page_size=size, max_pages=None)[:len(got)] == got
