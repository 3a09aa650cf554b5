import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import dates, href, text


@pytest.mark.parametrize(
    ("base", "raw", "want"),
    [
        ("", "a.xhtml", "a.xhtml"),
        ("OEBPS", "Text/a.xhtml#x", "OEBPS/Text/a.xhtml"),
        ("OEBPS/Text", "../Images/./b.png?q=1", "OEBPS/Images/b.png"),
        ("OEBPS", "/c//d", "c/d"),
        ("", "..\\x", None),
        ("a", "..\\x", "x"),
        ("", "http://x/y", None),
        ("", "C:\\x", None),
        ("a", "b/c:d", None),
        ("a", "b/... /c", None),
        ("a", "x\x01y", None),
        ("a", "#f", None),
        ("a", " \xa0b\ufeff", "a/b"),
        ("a", "..", None),
    ],
)
def test_normalize(base, raw, want):
    assert href.normalize(base, raw) == want


def test_decode_path():
    assert href.decode_path("a%20b/%C3%A9") == "a b/é"
    assert href.decode_path("%2541") == "%41"
    assert href.decode_path("a%2Fb/%00/%E9/%zz") == "a%2Fb/%00/%E9/%zz"
    assert href.decode_path("%2e%2e/x") is None
    assert href.candidates("a%20b") == ["a b", "a%20b"] and href.candidates("ab") == ["ab"]
    assert href.split_fragment("a#%C3%A9") == ("a", "é") and href.split_fragment("a#") == ("a", None)
    assert href.stem("x/.hidden") == ".hidden" and href.stem("x/a.b.c") == "a.b" and href.dirname("a") == ""


def test_text():
    assert text.ascii_lower("İABÉ") == "İabÉ" and text.utf16_len("a\U0001d11e") == 3
    assert text.sample("a" * 63 + "\U0001d11eb") == "a" * 63 and text.collapse_html("\n a\xa0 \t b ") == "a\xa0 b"
    assert text.fnv1a64(b"") == "cbf29ce484222325" and text.fnv1a64(b"a") == "af63dc4c8601ec8c"
    assert text.tokens(" b a  b ") == ["b", "a"] and text.tokens(None) == []


def test_columns(spark):
    rows = spark.createDataFrame([("x/.a.b", "a\U0001d11eb", "\\./..//x", " 1e3 ")], "p string, t string, n string, d string")
    r = rows.select(href.stem_col(F.col("p")), text.utf16_len_col(F.col("t")), text.entry_name_col(F.col("n")), text.finite_double_col(F.col("d"))).first()
    assert tuple(r) == (".a", 4, "..//x", 1000.0)
    bad = spark.createDataFrame([("1d",), ("NaN",), ("",), ("0x1",), (".5",), ("5.",), (None,)], "d string").select(text.finite_double_col(F.col("d"))).collect()
    assert [x[0] for x in bad] == [None, None, None, None, 0.5, 5.0, None]
    got = rows.select(href.normalize_href(F.lit("a"), F.col("p")), href.decode_href(F.lit("a%20"))).first()
    assert tuple(got) == ("a/x/.a.b", "a ")


def test_publication_date(spark):
    utc = datetime.UTC
    cases = {
        "1997": datetime.datetime(1997, 1, 1, tzinfo=utc),
        "2000-02-29": datetime.datetime(2000, 2, 29, tzinfo=utc),
        "1900-02-29": None,
        "2001-05-06T01:02+14:00": datetime.datetime(2001, 5, 5, 11, 2, tzinfo=utc),
        "2001-05-06T01:02+14:30": None,
        "2001-05-06T01:02:03.98765Z": datetime.datetime(2001, 5, 6, 1, 2, 3, 987000, tzinfo=utc),
        "2001-05-06T25:02": None,
        "2001-5-6": None,
        "": None,
        "x": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.unix_millis(dates.publication_date(F.col("t"))).alias("ms"))
    assert {r.t: r.ms for r in df.collect()} == {k: None if v is None else int(v.timestamp() * 1000) for k, v in cases.items()}
