import hashlib
import io
import json
import os

import pytest

from tidelake.sources import segments as s


def container(members, magic=s.MAGIC, length=None, index=None):
    rows, at = [], 0
    for i, data in members:
        rows.append({"id": i, "offset": at, "length": len(data), "sha256": hashlib.sha256(data).hexdigest()})
        at += len(data)
    text = json.dumps({"members": index(rows) if index else rows}).encode()
    return magic + (len(text) if length is None else length).to_bytes(8, "little") + text + b"".join(d for _, d in members)


class Counting(io.BytesIO):
    asked = 0

    def read(self, n=-1):
        out = super().read(n)
        Counting.asked += len(out)
        return out


def test_only_wanted_members_are_read():
    data = container([(f"m{k}", bytes([k]) * 100_000) for k in range(50)])
    Counting.asked = 0
    rows = list(s.read_members(Counting(data), len(data), "x", 0, len(data), {"m7"}))
    assert [r[1] for r in rows] == ["m7"] and rows[0][5] == bytes([7]) * 100_000
    assert Counting.asked < 110_000
    cut = len(data) // 2
    both = [[r[1] for r in s.read_members(Counting(data), len(data), "x", a, b, content=False)] for a, b in ((0, cut), (cut, len(data)))]
    assert both[0] + both[1] == [f"m{k}" for k in range(50)] and both[0] and both[1]


def member(**change):
    return lambda rows: [rows[0] | change]


@pytest.mark.parametrize("data", [
    container([("a", b"x")], magic=b"OTHERMAG"), container([("a", b"x")], length=1 << 40), container([("a", b"x")])[:12], container([("a", b"x")], index=member(offset=-1)),
    container([("a", b"x")], index=member(length=9)), container([("a", b"x")], index=member(sha256="0")), container([("a", b"x")], index=lambda r: r + r),
])
def test_faults_are_refused(data):
    with pytest.raises(ValueError):
        list(s.read_members(io.BytesIO(data), len(data), "x", 0, len(data)))


def test_a_member_of_a_sparse_gigabyte(spark, tmp_path):
    data = b"the end"
    text = json.dumps({"members": [{"id": "hole", "offset": 0, "length": (1 << 30) - 7, "sha256": "-"}, {"id": "last", "offset": (1 << 30) - 7, "length": 7, "sha256": hashlib.sha256(data).hexdigest()}]}).encode()
    with open(f"{tmp_path}/big.seg", "wb") as out:
        out.write(s.MAGIC + len(text).to_bytes(8, "little") + text)
        out.truncate(len(s.MAGIC) + 8 + len(text) + (1 << 30))
        out.seek(-7, os.SEEK_END)
        out.write(data)
    s.register(spark)
    got = spark.read.format("tidelake_segment").option("ids", "last").option("split_bytes", 256 << 20).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 5
    assert [(r.id, bytes(r.content)) for r in got.collect()] == [("last", data)]
    assert sorted(r.id for r in spark.read.format("tidelake_segment").option("content", "false").load(f"{tmp_path}/big.seg").collect()) == ["hole", "last"]


def test_round_trip_and_pushed_ids(spark, tmp_path):
    rows = [(f"s{k % 3}", k, f"m{k}", os.urandom(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "seg string, k int, id string, data binary")
    s.write_segments(df, str(tmp_path), "seg", "k", "id", "data")
    assert sorted(os.listdir(tmp_path)) == ["s0.seg", "s1.seg", "s2.seg"]
    read = lambda **how: spark.read.format("tidelake_segment").options(**how).load(str(tmp_path))
    got = read().collect()
    assert sorted((os.path.basename(r.path)[:2], r.id, bytes(r.content)) for r in got) == sorted((a, c, d) for a, _, c, d in rows)
    for name in ("s0", "s1", "s2"):
        mine = sorted((r for r in got if r.path.endswith(f"{name}.seg")), key=lambda r: r.offset)
        assert [r.id for r in mine if r.length] == [c for a, k, c, _ in rows if a == name and k]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert sorted(r.id for r in read(pushdown=True).where("id IN ('m3', 'm5') AND length > 3").collect()) == ["m5"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="there already"):
        s.write_segments(df, str(tmp_path), "seg", "k", "id", "data")
    s.write_segments(df.where("seg = 's1'"), str(tmp_path), "seg", "k", "id", "data", mode="overwrite")
    assert sorted(os.listdir(tmp_path)) == ["s1.seg"]
