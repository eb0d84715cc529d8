import gzip

from gaugeworks.llm import warc
from gaugeworks.llm.common import staged


def test_members_around_damage():
    records = [warc.record_bytes(i, f"http://h/{i}", "page " * i) for i in range(30)]
    members = [warc.gzip_member(r) for r in records]
    data = bytearray(b"".join(members))
    starts = [sum(map(len, members[:i])) for i in range(31)]
    assert [m[2] for m in warc.parse_members(bytes(data))] == records
    data[starts[7] + len(members[7]) // 2] ^= 4
    data[starts[20]] ^= 255
    found = list(warc.parse_members(bytes(data)))
    assert [m[0] for m in found] == starts[:30]
    assert [i for i, m in enumerate(found) if m[2] is None] == [7, 20]
    assert gzip.decompress(members[3]) == records[3]


def archive(spark, tmp_path, rows, damage=None, name="a"):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string").coalesce(2)
    folder = f"file://{tmp_path}/{name}"
    index = warc.write_warc(pages, folder, damage)
    return index, staged(warc.read_warc(spark, folder), "test")


def test_replicas(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 3 else None, "body\r\n\r\nWARC/1.1\r\n" * (i % 5) if i % 4 else None, "clash") for i in range(60)]
    rows += [(None, "http://no-key", "x", "clash"), (5, "http://again", "", "clash"), (61, "http://long", "y" * 300_000, "clash")]
    index, left = archive(spark, tmp_path, rows)
    assert index.count() == left.count() == len(rows)
    bodies = sorted((r.uri or "", r.payload.decode()) for r in left.collect())
    assert bodies == sorted(((u or "").replace("\r", "%0D").replace("\n", "%0A"), h or "") for _, u, h, _ in rows)

    _, same = archive(spark, tmp_path, rows, name="b")
    assert warc.audit(left, same).count() == 0

    bad = lambda key, member: member[:-1] + bytes([member[-1] ^ 1]) if key in (3, 40, 61) else member
    _, right = archive(spark, tmp_path, rows, bad, name="c")
    for size in (64 << 10, 128):
        found = warc.audit(left, right, range_bytes=size, fanout=3)
        named = index.join(found, ["path", "offset"]).collect()
        assert sorted((r.page_id, r.status) for r in named) == [(3, "changed"), (40, "changed"), (61, "changed")]

    fewer = left.filter("offset > 0")
    assert {r.status for r in warc.audit(left, fewer).collect()} == {"missing"}
    assert {r.status for r in warc.audit(fewer, left).collect()} == {"extra"}
    assert warc.audit(left, left.limit(0)).count() == left.count()


def test_no_pages(spark, tmp_path):
    index, records = archive(spark, tmp_path, [])
    assert index.count() == 0
