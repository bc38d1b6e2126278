"""The columnar file format, checksums, statistics and generated logs."""

import io
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.engine import Engine
from millrace.operators import checksum, stats
from millrace.sources import colfile, logs

EXTREMES = [0, 1, -1, 2, -2, -3, 2**31 - 1, -(2**31), 2**63 - 1, -(2**63)]
INTS = st.lists(st.integers(-(2**63), 2**63 - 1), max_size=60)


def test_zigzag():
    assert colfile.zigzag([0, -1, 1, -2, 2, -3]).tolist() == [0, 1, 2, 3, 4, 5]
    assert colfile.zigzag([2**63 - 1, -(2**63)]).tolist() == [2**64 - 2, 2**64 - 1]
    assert colfile.unzigzag(colfile.zigzag(EXTREMES)).tolist() == EXTREMES


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60))
def test_varints(values):
    data = colfile.put_varints(np.array(values, np.uint64))
    assert colfile.get_varints(data).tolist() == values


def test_varint_bytes():
    assert colfile.put_varints(np.array([0, 127, 128, 300])) == bytes([0, 127, 128, 1, 172, 2])
    with pytest.raises(colfile.BadFile):
        colfile.get_varints(b"\x80")


@given(INTS)
def test_int64_column(values):
    assert colfile.unpack_int64(colfile.pack_int64(values)).tolist() == values


@pytest.mark.parametrize("offsets", [colfile.STARTS, colfile.ENDS, colfile.LENGTHS])
@given(values=st.lists(st.binary(max_size=20), max_size=30))
def test_varchar_column(offsets, values):
    assert colfile.unpack_varchar(colfile.pack_varchar(values, offsets), offsets) == values


def opened(data):
    return colfile.ColumnFile(pa.PythonFile(io.BytesIO(data), mode="r"))


def sample(n=1000):
    rng = np.random.default_rng(1)
    return [
        ("id", 1, list(range(100, 100 + n))), ("random_val", 1, rng.integers(0, 1000, n).tolist()),
        ("description", 2, [f"val-{i}".encode() for i in range(n)]),
    ]


def test_file_roundtrip_and_pruning():
    f = opened(colfile.dump(sample()))
    assert f.rows == 1000 and [c.name for c in f.columns] == ["id", "random_val", "description"]
    for name, _, values in sample():
        assert list(f.read([name])[name]) == values
    assert list(f.read(["description", "id"])) == ["id", "description"]


def test_batches_do_not_span_files(tmp_path):
    paths = []
    for part in (range(15), range(15, 20)):
        paths.append(str(tmp_path / f"{part[0]}"))
        (tmp_path / f"{part[0]}").write_bytes(colfile.dump([("id", 1, list(part)), ("name", 2, [b"row%d" % i for i in part])]))
    for size, sizes in ((4, [4, 4, 4, 3, 4, 1]), (10, [10, 5, 5]), (100, [15, 5])):
        found = list(colfile.read_batches(paths, size))
        assert [len(b["id"]) for b in found] == sizes
        assert [v for b in found for v in b["id"].tolist()] == list(range(20))
        assert [v for b in found for v in b["name"]] == [b"row%d" % i for i in range(20)]
    assert [list(b) for b in colfile.read_batches(paths, 10, ["id"])] == [["id"]] * 3


@pytest.mark.parametrize(
    "spoil",
    [
        lambda d: b"", lambda d: b"Xxxx" + d[4:], lambda d: d[:-1] + b"x", lambda d: d[:40],
        lambda d: d[:-12] + (2**40).to_bytes(8, "little") + d[-4:], lambda d: d[:-12] + (3).to_bytes(8, "little") + d[-4:],
    ],
)
def test_bad_files(spoil):
    with pytest.raises(colfile.BadFile):
        opened(spoil(colfile.dump(sample(5))))


def test_data_source(spark, tmp_path):
    colfile.register(spark)
    df = spark.createDataFrame([(i, f"row{i} é") for i in range(50)], "id long, name string")
    target = str(tmp_path / "t")
    df.repartition(3).write.format("columnfile").option("path", target).option("offsets", "ends").mode("append").save()
    back = spark.read.format("columnfile").option("offsets", "ends").load(target)
    assert sorted(map(tuple, back.collect())) == [(i, f"row{i} é") for i in range(50)]
    some = spark.read.format("columnfile").option("offsets", "ends").option("columns", "id").load(target)
    assert some.columns == ["id"] and some.count() == 50
    df.limit(2).write.format("columnfile").option("path", target).mode("overwrite").save()
    assert spark.read.format("columnfile").load(target).count() == 2
    with pytest.raises(Exception, match="nulls can't be stored"):
        spark.createDataFrame([(None, "x")], "id long, name string").write.format("columnfile").option("path", target).mode("overwrite").save()
    assert spark.read.format("columnfile").load(target).count() == 2


def test_data_source_is_registered_once(spark):
    """Whatever session asks for it first, and after an engine has made one of its own."""
    for session in (spark, spark.newSession(), Engine(spark).spark, spark, spark.newSession()):
        colfile.register(session)
        colfile.register(session)


def test_data_source_in_sessions_that_are_not_active(spark, tmp_path):
    """A session that another one, or none, is active beside; a thread may have no active session."""

    def counted(session, name):
        colfile.register(session)
        session.range(5).write.format("columnfile").option("path", f"{tmp_path}/{name}").mode("append").save()
        return session.read.format("columnfile").load(f"{tmp_path}/{name}").count()

    colfile.register(spark)
    assert [counted(spark.newSession(), f"s{i}") for i in range(3)] == [5] * 3
    with ThreadPoolExecutor(1) as pool:
        assert list(pool.map(counted, (spark.newSession(), spark), "ab")) == [5, 5]


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 56
        for _ in range(8):
            crc = (crc << 1 ^ (checksum.POLYNOMIAL if crc >> 63 else 0)) & (2**64 - 1)
    return crc


def test_crc64():
    assert checksum.crc64(b"123456789") == 0x6C40DF5F0B497347
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 100, 5000):
        data = rng.bytes(n)
        assert checksum.crc64(data) == slow_crc(data)
        k = n // 3
        assert checksum.crc64(data[k:], checksum.crc64(data[:k])) == checksum.crc64(data)
        assert checksum.join(checksum.crc64(data[:k]), checksum.crc64(data[k:]), n - k) == checksum.crc64(data)
    many = [rng.bytes(int(n)) for n in rng.integers(0, 6000, 40)] + [b""]
    assert checksum.crc64_many(many) == [checksum.crc64(x) for x in many]


def test_block_orders():
    assert checksum.block_order(25, 10) == [(0, 10), (10, 10), (20, 5)]
    assert checksum.block_order(25, 10, alternating=True) == [(0, 10), (5, 10), (20, 5)]
    assert checksum.block_order(15, 10, alternating=True) == [(0, 10), (0, 10)]
    assert checksum.block_order(15, 10, alternating=True, clamp=False) == [(0, 10)]
    assert checksum.block_order(0) == []


@pytest.mark.parametrize(("alternating", "clamp"), [(False, True), (True, True), (True, False)])
def test_file_checksums(spark, tmp_path, alternating, clamp):
    rng = np.random.default_rng(3)
    files = {f"f{n}": rng.bytes(n) for n in (0, 1, 100, 1000, 2345)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: r.crc64 for r in checksum.file_checksums(spark, str(tmp_path), 100, alternating, clamp).collect()}
    order = {k: b"".join(v[a : a + n] for a, n in checksum.block_order(len(v), 100, alternating, clamp)) for k, v in files.items()}
    assert got == {k: f"{slow_crc(v):016x}" for k, v in order.items()}


def test_stats(spark):
    df = spark.createDataFrame([(1, "aé"), (2, "\n"), (6, "")], "n long, s string")
    assert stats.column_stats(df).first().asDict() == {"rows": 3, "n_mean": 3.0, "s_ascii_bytes": 2, "s_bytes": 4}
    assert stats.column_stats(df.limit(0)).first().asDict() == {"rows": 0, "n_mean": 0.0, "s_ascii_bytes": 0, "s_bytes": 0}


def test_logs(spark):
    a, b = (logs.logs(spark, 1000, start=5).repartition(n).collect() for n in (1, 3))
    assert sorted(a) == sorted(b)
    assert {r.host for r in a} == set(logs.HOSTS) and {r.log_level for r in a} == set(logs.LEVELS)
    assert sorted(r.timestamp for r in a) == list(range(5, 1005)) and all(0 <= r.value < 10_000 for r in a)
