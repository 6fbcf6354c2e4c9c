import struct

import numpy as np
import pytest

from gridloom.operators import catalog
from gridloom.sources import netcdf as nc

ROWS = [(f"a/{i}.nc" if i % 2 else f"{i}.nc", None if i == 3 else 30.0 + 10 * i, [float(v + i) for v in range(12)], [3, 4], f"storm {i}") for i in range(9)]
SCHEMA = "rel_path string, wmo_wind double, bt array<float>, bt_shape array<int>, title string"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("nc")
    nc.register(spark)
    spark.createDataFrame(ROWS, SCHEMA).write.format("gridnc").mode("append").save(f"file://{root}")
    return root


@pytest.mark.parametrize("version", [1, 2, 5])
def test_bytes_round_trip(version):
    x = np.arange(12, dtype=float)
    data = nc.encode({"wmo_wind": 41.5, "name": "söme"}, {"bt": (x, (3, 4)), "other": (x[:5], (5,))}, version)
    read = lambda at, n: data[at : at + n]
    header = nc.read_header(read, len(data))
    assert header.attributes["wmo_wind"][0] == 41.5 and header.attributes["name"] == "söme"
    values, shape = nc.read_variable(read, header, "bt")
    assert values.tolist() == x.tolist() and shape == (3, 4)
    assert nc.read_variable(read, header, "other")[0].tolist() == x[:5].tolist() and nc.read_variable(read, header, "none") is None
    with pytest.raises(nc.NotClassic, match="ends within other"):
        nc.read_variable(lambda at, n: data[:-4][at : at + n], header, "other")
    with pytest.raises(nc.NotClassic, match="within the header"):
        nc.read_header(read, 60)


def packed_file(records=3, stream=False):
    """Written by hand: an unlimited dimension, two record variables that alternate, packing and a fill value."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    att = lambda k, kind, raw: name(k) + struct.pack(">ii", kind, 1) + raw + b"\0" * (-len(raw) % 4)
    head = b"CDF\x01" + struct.pack(">i", -1 if stream else records)
    head += struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 3)
    head += struct.pack(">ii", 12, 1) + name("wmo_wind") + struct.pack(">iiff", 5, 2, 1.0, 2.0)
    own = struct.pack(">ii", 12, 3) + att("_FillValue", 3, struct.pack(">h", -99)) + att("scale_factor", 6, struct.pack(">d", 0.5)) + att("add_offset", 6, struct.pack(">d", 200))
    first = lambda begin: name("bt") + struct.pack(">iii", 2, 0, 1) + own + struct.pack(">iii", 3, 8, begin)
    second = lambda begin: name("t") + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 4, 4, begin)
    size = len(head) + 8 + len(first(0)) + len(second(0))
    data = head + struct.pack(">ii", 11, 2) + first(size) + second(size + 8)
    for r in range(records):
        data += struct.pack(">hhh", r, -99, 2 * r) + b"\0\0" + struct.pack(">i", 1000 + r)
    return data


@pytest.mark.parametrize("stream", [False, True])
def test_records_packing_and_fill(spark, stream):
    data = packed_file(stream=stream)
    read = lambda at, n: data[at : at + n]
    header = nc.read_header(read, len(data))
    values, shape = nc.read_variable(read, header, "bt")
    assert shape == (3, 3)
    assert np.array_equal(values.reshape(3, 3), [[200, np.nan, 200], [200.5, np.nan, 201], [201, np.nan, 202]], equal_nan=True)
    assert nc.read_variable(read, header, "t")[0].tolist() == [1000, 1001, 1002]
    # an attribute of two numbers is no scalar
    assert nc.columns_of(read, len(data), nc.T._parse_datatype_string("wmo_wind double, bt_shape array<int>").fields) == {"wmo_wind": None, "bt_shape": [3, 3]}


def test_a_header_is_all_that_attributes_read(spark):
    reads = []
    x = np.zeros(65_536)
    data = nc.encode({"wmo_wind": 40.0, **{f"a{i}": "y" * 100 for i in range(80)}}, {"bt": (x, (256, 256))})

    def read(at, n):
        reads.append(n)
        return data[at : at + n]

    got = nc.columns_of(read, len(data), nc.T._parse_datatype_string("rel_path string, wmo_wind double").fields)
    assert got == {"wmo_wind": 40.0} and sum(reads) <= 4 * nc.FIRST_READ < len(data) / 10
    reads.clear()
    nc.columns_of(read, len(data), nc.T._parse_datatype_string("bt array<float>").fields)
    assert sum(reads) < len(data) + 4 * nc.FIRST_READ


def test_reads_what_is_asked(spark, root):
    every = nc.read_files(spark, f"file://{root}", SCHEMA).collect()
    assert sorted(map(tuple, every)) == sorted(ROWS)
    narrow = nc.read_files(spark, str(root), "wmo_wind double, rel_path string, missing double, gone array<float>").collect()
    assert sorted((r.rel_path, r.wmo_wind) for r in narrow) == sorted((r[0], r[1]) for r in ROWS) and all(r.missing is None and r.gone is None for r in narrow)
    assert spark.read.format("gridnc").load(f"file://{root}").columns == ["rel_path", "wmo_wind", "bt"]
    index = catalog.dataset_index(nc.read_files(spark, str(root), "rel_path string, wmo_wind double"))
    assert {r.rel_path: r.ss_cat for r in index.collect()} == {"a/1.nc": 0, "2.nc": 0, "4.nc": 1, "a/5.nc": 1, "6.nc": 2, "a/7.nc": 3, "8.nc": 3}


def test_partitions_follow_sizes(spark, root):
    names = [(f"{i:03}", 100) for i in range(10)]
    assert [len(p.names) for p in nc.dealt(names, lambda s: s, 300)] == [3, 3, 3, 1]
    df = spark.read.format("gridnc").schema("rel_path string, bt array<float>").option("partitionBytes", 400).load(str(root))
    assert df.rdd.getNumPartitions() > 2 and df.count() == 9


def test_bad_files(spark, tmp_path):
    with pytest.raises(Exception, match="no \\*.nc below"):
        nc.read_files(spark, str(tmp_path)).collect()
    (tmp_path / "good.nc").write_bytes(nc.encode({"wmo_wind": 50.0}, {}))
    (tmp_path / "bad.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    (tmp_path / "empty.nc").write_bytes(b"")
    with pytest.raises(Exception, match="bad.nc: no such magic bytes"):
        nc.read_files(spark, str(tmp_path)).collect()
    assert [r.rel_path for r in nc.read_files(spark, str(tmp_path), bad="skip").collect()] == ["good.nc"]
    with pytest.raises(Exception, match="fail or skip"):
        nc.read_files(spark, str(tmp_path), bad="other").collect()


def test_stores_that_only_spark_opens(spark, root):
    got = nc._whole_files(spark, f"file://{root}", SCHEMA, "*.nc", "fail").collect()
    assert sorted(map(tuple, got)) == sorted(ROWS)
