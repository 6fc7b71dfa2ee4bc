import pyarrow as pa
import pytest

from tabulon.plans import decisions as D
from tabulon.plans.options import Bloom, BloomConfig

SCHEMA = pa.schema([("k", pa.int64()), ("s", pa.string()), ("f", pa.float64()), ("b", pa.bool_()), ("u", pa.struct([("n", pa.string())]))])


def found(c, rows=100, **distinct):
    return {d.name: d for d in D.decide(SCHEMA, c, rows, {k: D.Cardinality(v, 4.0) for k, v in distinct.items()})}


def test_dictionary_modes():
    got = found(D.Columns(), k=19, s=20)
    assert got["k"].dictionary and not got["s"].dictionary  # the limit of a fifth is strict
    assert got["u.n"].dictionary and not got["f"].dictionary and not got["b"].dictionary
    assert not found(D.Columns(dictionary=False), k=1, s=1)["k"].dictionary
    assert found(D.Columns(dictionary=False, always=("s",)), k=1, s=99)["s"].dictionary
    assert not found(D.Columns(never=("u",)), k=1, s=1)["u.n"].dictionary
    assert found(D.Columns(dictionary=False, analyze=("u",)), k=1, s=1)["u.n"].dictionary
    assert not found(D.Columns(), rows=0, k=0, s=0)["k"].dictionary


def test_dictionary_size_limit():
    assert D.dictionary_pays(D.Cardinality(10, 50.0), 100, pa.string(), 500)
    assert not D.dictionary_pays(D.Cardinality(10, 50.0), 100, pa.string(), 499)
    assert D.dictionary_bytes(D.Cardinality(10), pa.string()) == 320
    assert D.dictionary_bytes(D.Cardinality(10), pa.binary()) == 640
    assert D.dictionary_bytes(D.Cardinality(10), pa.int64()) == 80


def test_bloom_follows_dictionary_unless_sized():
    got = found(D.Columns(), k=5, s=90)
    assert got["k"].bloom == Bloom(0.01, 5) and got["s"].bloom is None and got["u.n"].bloom is None
    sized = D.Columns(bloom=BloomConfig(None, {"s": Bloom(0.1, 7), "u": Bloom(0.2, 3)}))
    got = found(sized, k=5, s=90)
    assert got["s"].bloom == Bloom(0.1, 7) and got["u.n"].bloom == Bloom(0.2, 3) and got["k"].bloom is None
    assert found(D.Columns(bloom=BloomConfig(Bloom(), {}, ("k",))), k=5, s=5)["k"].bloom is None
    assert found(D.Columns(distinct={"u": 4}), k=5, s=5)["u.n"].bloom == Bloom(0.01, 4)
    assert found(D.Columns(bloom=None), k=5, s=5)["k"].bloom is None


def test_what_is_measured():
    assert D.to_measure(SCHEMA, D.Columns()) == ["k", "s"]
    assert D.to_measure(SCHEMA, D.Columns(dictionary=False, bloom=None)) == []
    assert D.to_measure(SCHEMA, D.Columns(always=("k",), bloom=None)) == ["s"]


@pytest.mark.parametrize("exact", [True, False])
def test_measure(spark, exact):
    df = spark.createDataFrame([(i % 3, "ab") for i in range(50)], "k int, s string")
    assert D.measure(df, ["k", "s"], exact) == (50, {"k": D.Cardinality(3), "s": D.Cardinality(1, 2.0)})


def test_measured_filters_are_sized_for_a_row_group():
    """A filter is of one row group; a given size stays."""
    measured = {"k": D.Cardinality(5_000)}
    schema = pa.schema([("k", pa.int64())])
    size = lambda c, **how: D.decide(schema, c, 100_000, measured, **how)[0].bloom.ndv
    assert size(D.Columns(), group_rows=400) == 400 and size(D.Columns(), group_rows=50_000) == 5_000 == size(D.Columns())
    assert size(D.Columns(distinct={"k": 5_000}), group_rows=400) == 5_000
