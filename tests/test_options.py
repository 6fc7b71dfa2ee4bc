import pyarrow as pa
import pytest

from tabulon.errors import OptionError
from tabulon.plans import options as O  # noqa: E741
from tabulon.plans import types as T


@pytest.mark.parametrize("text,want", [("1", 1), ("4096", 4096), ("512MB", 512_000_000), ("1GiB", 1 << 30), ("1.5 KiB", 1536), ("2k", 2000), ("3tb", 3 * 10**12)])
def test_byte_size(text, want):
    assert O.byte_size(text) == want


@pytest.mark.parametrize("text", ["", "0", "0MB", "abc", "12XB", "-1"])
def test_bad_byte_size(text):
    with pytest.raises(OptionError):
        O.byte_size(text)


@pytest.mark.parametrize("text,cpus,want", [("4", 8, 4), ("reserve:2", 8, 6), ("reserve:20", 8, 1), ("reserve:7:min:3", 8, 3)])
def test_thread_budget(text, cpus, want):
    assert O.ThreadBudget.parse(text).resolve(cpus) == want


@pytest.mark.parametrize("text", ["0", "x", "reserve", "reserve:x", "reserve:1:min:0", "reserve:1:max:2", "-3"])
def test_bad_thread_budget(text):
    with pytest.raises(OptionError):
        O.ThreadBudget.parse(text)


@pytest.mark.parametrize("text,want", [("total", 80), ("total:50", 50), ("TOTAL:50%", 50), ("available:25:min:30", 30), ("available", 40), ("reserve:90", 10), ("reserve:200", 0), ("reserve:200:min:7", 7), ("64", 64)])
def test_memory_budget(text, want):
    assert O.MemoryBudget.parse(text).resolve(total=100, available=50) == want


@pytest.mark.parametrize("text", ["total:0", "total:101", "total:x", "total:50:max:3", "total:50:min", "reserve", "other:3", "0"])
def test_bad_memory_budget(text):
    with pytest.raises(OptionError):
        O.MemoryBudget.parse(text)


def test_pool_reserve():
    assert O.PoolReserve.parse("10").resolve(1000) == 100
    assert O.PoolReserve.parse("10%").resolve(1000) == 100
    assert O.PoolReserve.parse("200MB").resolve(10**9) == 200_000_000
    for bad in ("0", "100", "100%", "x"):
        with pytest.raises(OptionError):
            O.PoolReserve.parse(bad)
    for reserve, pool in (("50", 1), ("2KB", 2000), ("10", 0)):
        with pytest.raises(OptionError):
            O.PoolReserve.parse(reserve).resolve(pool)


def test_sort_spec():
    assert O.SortSpec.parse(" a , b:DESC,,c:ascending, a:desc").columns == (("a", False), ("b", True), ("c", False))
    for bad in ("", " , ", "a:up", ":desc"):
        with pytest.raises(OptionError):
            O.SortSpec.parse(bad)
    assert O.SortSpec.parse("a:desc,b:desc").after(["a"]).columns == (("a", False), ("b", True))


def test_bloom():
    assert O.Bloom.parse("") == O.Bloom(0.01, None)
    assert O.Bloom.parse("fpp=0.05, ndv=10") == O.Bloom(0.05, 10)
    assert O.Bloom.parse_column("user.name:ndv=5") == ("user.name", O.Bloom(0.01, 5))
    for bad in ("fpp=0", "fpp=1", "fpp=nan", "ndv=0", "ndv=x", "fpp=.1,fpp=.2", "x=1", "fpp"):
        with pytest.raises(OptionError):
            O.Bloom.parse(bad)
    with pytest.raises(OptionError):
        O.BloomConfig.build(None, [("a", O.Bloom())], ["a"])
    with pytest.raises(OptionError):
        O.BloomConfig.build(None, [("a", O.Bloom()), ("a", O.Bloom())], [])


def test_compression_levels():
    assert O.compression("ZSTD", 3) == ("zstd", 3)
    for codec, level in (("snappy", 1), ("lz4", 1), ("none", 1), ("gzip", 10), ("zstd", 0), ("foo", None)):
        with pytest.raises(OptionError):
            O.compression(codec, level)


def test_columns_and_encodings():
    assert O.dictionary_column("a") == ("a", "analyze")
    assert O.dictionary_column("a:always") == ("a", "always")
    assert O.column_encoding("a=plain") == ("a", "plain")
    for f, bad in ((O.dictionary_column, "a:never"), (O.column_encoding, "a"), (O.column_encoding, "a=x")):
        with pytest.raises(OptionError):
            f(bad)


@pytest.mark.parametrize("encoding,good,bad", [("rle", pa.bool_(), pa.int32()), ("delta-binary-packed", pa.timestamp("us"), pa.string()), ("delta-byte-array", pa.string(), pa.int8()), ("delta-length-byte-array", pa.binary(), pa.float32()), ("byte-stream-split", pa.float64(), pa.string())])
def test_encoding_types(encoding, good, bad):
    assert T.encoding_problem(encoding, good) is None
    assert T.encoding_problem(encoding, bad)
    assert T.encoding_problem("plain", bad) is None


def test_leaves_and_types():
    schema = pa.schema([("id", pa.int64()), ("tags", pa.list_(pa.string())), ("m", pa.map_(pa.string(), pa.int32())), ("user", pa.struct([("name", pa.string())])), ("d", pa.dictionary(pa.int8(), pa.string()))])
    assert [x.name for x in T.leaves(schema)] == ["id", "tags.list.element", "m.key_value.key", "m.key_value.value", "user.name", "d"]
    assert T.leaves(schema)[4].under("user") and not T.leaves(schema)[4].under("us")
    for x, part, dictionary in ((pa.bool_(), True, False), (pa.float64(), True, False), (pa.string(), True, True), (pa.binary(), False, True), (pa.date32(), True, True), (pa.list_(pa.int8()), False, False), (pa.decimal128(9, 2), True, True)):
        assert T.can_partition(x) == part and T.can_have_dictionary(x) == dictionary, x
    assert [T.default_encoding(x) for x in (pa.int8(), pa.float32(), pa.string(), pa.bool_(), pa.date32())] == ["DELTA_BINARY_PACKED", "BYTE_STREAM_SPLIT", "DELTA_LENGTH_BYTE_ARRAY", "PLAIN", None]
