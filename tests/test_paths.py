import datetime as dt
import decimal
import json

import pytest

from tabulon.errors import OptionError
from tabulon.plans import paths as P

VECTORS = {"a/b": "a%2Fb", "10:30": "10%3A30", "key=value": "key%3Dvalue", "tag#1": "tag%231", "50%": "50%25", "what?": "what%3F", "a\\b": "a%5Cb", "*.txt": "%2A.txt", "a[0]{x}^2": "a%5B0%5D%7Bx}%5E2", 'say "hello"': "say %22hello%22", "it's": "it%27s", "a, b": "a, b", "é": "%C3%A9", "\t": "%09"}


@pytest.mark.parametrize("value,want", VECTORS.items())
def test_escape(value, want):
    assert P.Template("{{c}}", ["c"]).resolve({"c": value}) == want


@pytest.mark.parametrize(
    "value,want",
    [(dt.date(2022, 1, 8), "2022-01-08"), (dt.datetime(2022, 1, 1, 15, 30, 45), "2022-01-01T15%3A30%3A45"), (decimal.Decimal("123.45"), "123.45"), (None, P.DEFAULT_PARTITION), ("", P.DEFAULT_PARTITION), (True, "true"), (7, "7")],
)
def test_values(value, want):
    assert P.Template("{{ c }}", ["c"]).resolve({"c": value}) == want


def test_raw():
    t = P.Template("{{c | raw}}/x.parquet", ["c"])
    assert t.resolve({"c": "US/West"}) == "US/West/x.parquet"
    assert t.resolve({"c": None}) == f"{P.DEFAULT_PARTITION}/x.parquet"
    with pytest.raises(OptionError):
        t.resolve({"c": "../up"})


@pytest.mark.parametrize("text", ["{{c", "{{d}}", "{{c | upper}}", "{% if c %}", "c}}"])
def test_bad_templates(text):
    with pytest.raises(OptionError):
        P.Template(text, ["c"])


@pytest.mark.parametrize("text,n,want", [("v2.0/data", 1, "v2.0/data_1"), ("{{c}}/nyc.parquet", 2, "us/nyc_2.parquet"), ("{{c}}.arrow", 0, "us.arrow"), ("x/.hidden", 3, "x/.hidden_3")])
def test_numbered(text, n, want):
    assert P.Template(text, ["c"]).numbered({"c": "us"}, n) == want


def test_partition_key_tells_values_apart():
    keys = [["a", "b"], ["ab", ""], ["", "ab"], [None, "ab"], ["a", None], ["1:a", ""], ["1", ":a"]]
    assert len({P.partition_key(k) for k in keys}) == len(keys)


def test_listings():
    files = [P.OutputFile("b.parquet", 1200, (("event_day", dt.date(1970, 1, 3)), ("x", float("nan")))), P.OutputFile("a.parquet", 5, (("event_day", None), ("x", 1.5)))]
    got = json.loads(P.listing_json(files))
    assert [f["path"] for f in got] == ["b.parquet", "a.parquet"]
    assert got[0]["partition_values"] == [{"column": "event_day", "value": 2}, {"column": "x", "value": None}]
    text = P.listing_text(files).splitlines()
    assert text[0].split() == ["Event", "Day", "X", "Path", "Row", "Count"] and text[2].split()[2] == "a.parquet" and text[3].endswith("1,200")
    assert P.listing_text([]) == ""
