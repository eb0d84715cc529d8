"""Web archives and their fixity: Merkle trees over offset ranges of WARC files.

Every record is stored as a gzip member of its own. A file's bytes are cut into fixed ranges; a
range is hashed over the offsets, lengths and digests of the records that start in it, sixteen
ranges into the next larger one, and so on to a root per file. Two replicas compare their roots,
and only below differing nodes are children compared, down to the records. Ranges depend on offsets
and not on record numbers, so damage in one record leaves the tree around it comparable.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import shared_path, spread, staged, table
from gaugeworks.llm.files import made_folder, opened, whole_file

#: Bytes after which a writer starts a new file; a reader holds one file at a time.
FILE_BYTES = 64 << 20
RANGE_BYTES = 64 << 10
FANOUT = 16
DATE = "2024-01-01T00:00:00Z"

#: Bytes unpacked at a time: what lies behind a member is copied once only.
_STEP = 16 << 10
_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00"
_RECORD = "path string, offset long, length long, digest binary, uri string, record_sha256 string, payload binary, intact boolean"


def record_bytes(page_id: object, url: str | None, html: str | None) -> bytes:
    """One response record. A null url has no target line, a null page an empty body; line ends in
    a url are escaped, so they cannot end the header."""
    body = (html or "").encode("utf-8", "replace")
    target = f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" if url is not None else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Date: {DATE}\r\n"
        f"{target}Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode("utf-8", "replace") + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(pages: DataFrame, folder: str, damage: Callable[[object, bytes], bytes] | None = None) -> DataFrame:
    """Write page_id, url and html as WARC files; returns (path, offset, page_id) of each record.

    ``damage`` stands for a faulty disk: it gets the key and stored bytes of a record and returns as
    many bytes.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for batch in batches for row in batch.itertuples(index=False))
        row = next(rows, None)
        number = 0
        while row is not None:
            name = f"part-{TaskContext.get().partitionId():06d}-{number:04d}.warc.gz"
            offset, index = 0, []
            with whole_file(folder, name) as out:
                while row is not None and offset < FILE_BYTES:
                    key, url, html = (None if pd.isna(x) else x for x in row)
                    member = gzip_member(record_bytes(key, url, html))
                    out.write(damage(key, member) if damage else member)
                    index.append((name, offset, key))
                    offset += len(member)
                    row = next(rows, None)
            yield pd.DataFrame(index, columns=["path", "offset", "page_id"]).astype({"page_id": "Int64"})
            number += 1

    made_folder(folder)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return staged(rows.mapInPandas(write, "path string, offset long, page_id long"), "warc-index")


def parse_members(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, length, record) of every member; a damaged stretch up to the next whole member has
    no record."""
    at = 0
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        parts, end = [], at
        try:
            while not unpacker.eof and end < len(data):
                parts.append(unpacker.decompress(data[end : end + _STEP]))
                end = min(len(data), end + _STEP)
            whole = unpacker.eof
        except zlib.error:
            whole = False
        if whole:
            end -= len(unpacker.unused_data)
            yield at, end - at, b"".join(parts)
        else:
            end = data.find(_MEMBER, at + 1)
            while end >= 0 and not _starts_record(data, end):
                end = data.find(_MEMBER, end + 1)
            end = len(data) if end < 0 else end
            yield at, end - at, None
        at = end


def _starts_record(data: bytes, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all files in ``folder``: where they are stored, the digest of the stored bytes,
    target uri, digest and body of the record. Damaged stretches are rows that are not intact."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                source, name = opened(path)
                with source.open_input_file(name) as file:
                    data = file.read()
                found = []
                for offset, length, record in parse_members(data):
                    stored = hashlib.sha256(data[offset : offset + length]).digest()
                    uri = body = whole = None
                    if record is not None:
                        head, _, body = record.partition(b"\r\n\r\n")
                        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
                        uri = fields[b"WARC-Target-URI"].decode("utf-8", "replace") if b"WARC-Target-URI" in fields else None
                        body = body[: int(fields.get(b"Content-Length", b"0"))]
                        whole = hashlib.sha256(record).hexdigest()
                    found.append((name.rpartition("/")[2], offset, length, stored, uri, whole, body, record is not None))
                    if len(found) == 256:
                        yield pd.DataFrame(found, columns=_COLUMNS)
                        found = []
                if found:
                    yield pd.DataFrame(found, columns=_COLUMNS)

    return spread(files, "path").mapInPandas(read, _RECORD)


_COLUMNS = [field.split(" ")[0] for field in _RECORD.split(", ")]


def merkle_tree(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees from the ranges up to one root per file: rows (path, node, hash)."""
    leaf = F.struct("offset", "length", "digest")
    ordered = F.transform(
        F.array_sort(F.collect_list(leaf)), lambda r: F.concat_ws(":", r["offset"], r["length"], F.hex(r["digest"]))
    )
    node = F.floor(F.col("offset") / range_bytes).cast("long")
    level = records.groupBy("path", node.alias("node")).agg(F.sha2(F.array_join(ordered, ","), 256).alias("hash"))
    levels = [staged(level, "merkle")]
    while not levels[-1].filter("node > 0").isEmpty():
        child = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda c: F.concat_ws(":", c["node"], c["hash"]))
        up = levels[-1].groupBy("path", F.floor(F.col("node") / fanout).cast("long").alias("parent"))
        level = up.agg(F.sha2(F.array_join(child, ","), 256).alias("hash")).withColumnRenamed("parent", "node")
        levels.append(staged(level, "merkle"))
    return levels


def _differ(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    other = right.withColumnRenamed(value, "_other")
    return left.join(other, keys, "full").filter(~F.col(value).eqNullSafe(F.col("_other")))


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two replicas: (path, offset, status).

    status is changed, missing (only on the left) or extra (only on the right). Only children of
    differing nodes are compared. Replicas without records, or equal ones, give no rows.
    """
    trees = [merkle_tree(side, range_bytes, fanout) for side in (left, right)]
    while len(trees[0]) != len(trees[1]):
        # The lower tree gets the levels it lacks, each a single root.
        low = min(trees, key=len)
        root = low[-1].select("path", "node", F.sha2(F.concat_ws(":", "node", "hash"), 256).alias("hash"))
        low.append(root)
    open_ = _differ(trees[0][-1], trees[1][-1], ["path", "node"], "hash").select("path", "node")
    for below in range(len(trees[0]) - 2, -1, -1):
        parent = open_.withColumnRenamed("node", "parent")
        sides = [
            tree[below].withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(parent, ["path", "parent"], "left_semi").drop("parent")
            for tree in trees
        ]
        open_ = staged(_differ(*sides, ["path", "node"], "hash").select("path", "node"), "differing")
    leaves = [
        side.select("path", "offset", "digest", F.floor(F.col("offset") / range_bytes).cast("long").alias("node"))
        .join(open_, ["path", "node"], "left_semi").drop("node")
        for side in (left, right)
    ]
    status = F.when(F.col("_other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return _differ(*leaves, ["path", "offset"], "digest").select("path", "offset", status.alias("status"))


#: The second replica of the registered query sits on a disk that flips a bit in these pages.
DAMAGE_EVERY, DAMAGE_AT = 97, 13


def _flip(key: object, member: bytes) -> bytes:
    if key is None or int(key) % DAMAGE_EVERY != DAMAGE_AT:
        return member
    middle = len(member) // 2
    return member[:middle] + bytes([member[middle] ^ 4]) + member[middle + 1 :]


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages twice, once on a faulty disk, and audit the replicas against each other."""
    pages = table(spark, sf_dir, "pages")
    folders = [shared_path(spark, "warc") for _ in range(2)]
    index = write_warc(pages, folders[0])
    write_warc(pages, folders[1], _flip)
    left, right = (
        staged(read_warc(spark, f).select("path", "offset", "length", "digest", "record_sha256"), "warc-records") for f in folders
    )
    found = audit(left, right)
    rows = index.join(left.drop("digest"), ["path", "offset"]).join(found, ["path", "offset"], "left")
    return rows.select("page_id", "record_sha256", F.coalesce("status", F.lit("intact")).alias("status"))


OP8_SQL = f"""
SELECT page_id, sha256(
         'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
         || 'WARC-Date: {DATE}' || nl
         || CASE WHEN url IS NULL THEN '' ELSE 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || nl END
         || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(body) || nl || nl || body || nl || nl
       ) AS record_sha256,
       CASE WHEN page_id % {DAMAGE_EVERY} = {DAMAGE_AT} THEN 'changed' ELSE 'intact' END AS status
FROM (SELECT page_id, url, coalesce(html, '') AS body, chr(13) || chr(10) AS nl FROM pages)
"""
