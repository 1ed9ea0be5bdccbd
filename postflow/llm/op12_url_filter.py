"""URL filters over a memory-mapped sorted digest array.

Rules (host, path, verdict) become an index: one Spark job writes it as files of
the shared folder, one for each range of digests, and every executor fetches the
files through Spark and maps them into memory; nothing of it passes the driver as
data or is held as a Python object, so the list of rules may be long. A file holds

    the number of keys, the keys' sorted 64-bit xxhash digests, their ends, and the
    keys themselves (full strings), each with what it stands for.

There are two kinds of keys: a rule's host, which stands for the path lengths of its
rules, and a rule's host and path, which stands for its verdict. A host and all its
parent domains are looked up first, and only for those that have rules their paths,
one for each such length. Each look-up is one vectorised binary search over a batch;
where a digest is found, the stored string must be equal as well.

The longest fitting rule (characters of host and path; of two as long, that with
the longer host) decides; without one the verdict is `default`, as a filter list
lets pass what it does not name.

Defined results. Null url or one without `://`: empty host and path; only a rule
with an empty host could fit it. Rules: hosts are lower-cased (A-Z); a rule with a
null host or verdict is left out, a null path counts as empty; a rule given with
both verdicts blocks. Repeated rows are each judged alike. No rules, or an empty
table: the default, or no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import ascii_lower, shared_dir

KEYS_A_FILE = 4_000_000
VERDICTS = ("allow", "block")  # of one rule given with both, the later


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    known = F.coalesce(at > 0, F.lit(False))
    return F.when(known, ascii_lower(host)).otherwise(""), F.when(known, path).otherwise("")


def _digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def _host_key(host: bytes) -> bytes:
    return b"h" + host


def _rule_key(host: bytes, path: bytes) -> bytes:
    return b"r" + host + b"\x00" + path


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, digest (order-preserving as a long), value of hosts and rules."""
    for b in batches:
        keys, values = [], []
        for host, path, verdict, lengths in zip(*(b.column(c).to_pylist() for c in ("host", "path", "verdict", "lengths")),
                                                strict=True):
            if lengths is None:
                keys.append(_rule_key(host.encode(), path.encode()))
                values.append(bytes([VERDICTS.index(verdict)]))
            else:
                keys.append(_host_key(host.encode()))
                values.append(struct.pack(f"<{len(lengths)}I", *lengths))
        digests = np.array([_digest(k) for k in keys], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array((digests ^ np.uint64(1 << 63)).view(np.int64)), pa.array(values, pa.binary())],
            ["key", "digest", "value"])


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of one file from its rows in the order of digests."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    digests = table["digest"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    keys, values = table["key"].to_pylist(), table["value"].to_pylist()
    ends = np.cumsum(np.array([x for k, v in zip(keys, values, strict=True) for x in (len(k), len(v))], np.uint64))
    data = [np.uint64([len(keys)]).tobytes(), digests.tobytes(), ends.astype(np.uint64).tobytes()]
    for k, v in zip(keys, values, strict=True):
        data += [k, v]
    yield pa.RecordBatch.from_arrays([pa.array([b"".join(data)], pa.binary())], ["bytes"])


def build_index(rules: DataFrame) -> list[str]:
    """Write the index of rules (host, path, verdict) and make its files known to all
    executors; the names of the files."""
    spark = rules.sparkSession
    clean = (rules.filter(F.col("host").isNotNull() & F.col("verdict").isin(*VERDICTS))
             .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    lengths = clean.groupBy("host").agg(F.sort_array(F.collect_set(F.octet_length("path"))).alias("lengths"))
    none = F.lit(None)
    rows = (clean.withColumn("lengths", none.cast("array<int>"))
            .unionByName(lengths.select("host", F.lit("").alias("path"), none.cast("string").alias("verdict"), "lengths"))
            .mapInArrow(_digests, "key binary, digest long, value binary"))
    n_files = 1 + rows.count() // KEYS_A_FILE
    folder = f"{shared_dir(spark)}/llm-url-index-{uuid.uuid4().hex[:12]}"
    # a text file of one line is the bytes as they are, and one byte more
    (rows.repartitionByRange(n_files, "digest").sortWithinPartitions("digest", "key")
     .mapInArrow(_file, "bytes binary").select(F.col("bytes").cast("string").alias("value"))
     .write.text(folder))
    files = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
             .filter("length > 0").select("path").orderBy("path").collect()]
    for f in files:
        spark.sparkContext.addFile(f)
    return [PurePosixPath(f).name for f in files]


class DigestFile:
    """One file of the index, mapped into memory."""

    def __init__(self, path: str):
        self.bytes = np.memmap(path, np.uint8, "r")
        n = int(self.bytes[:8].view(np.uint64)[0])
        self.digests = self.bytes[8: 8 + 8 * n].view(np.uint64)
        self.ends = self.bytes[8 + 8 * n: 8 + 24 * n].view(np.uint64)
        self.start = 8 + 24 * n

    def __len__(self) -> int:
        return len(self.digests)

    def _piece(self, i: int) -> bytes:
        lo = int(self.ends[i - 1]) if i else 0
        return self.bytes[self.start + lo: self.start + int(self.ends[i])].tobytes()

    def confirm(self, at: int, digest: int, key: bytes) -> bytes | None:
        """What `key` stands for; keys that share a digest lie side by side."""
        while at < len(self) and self.digests[at] == digest:
            if self._piece(2 * at) == key:
                return self._piece(2 * at + 1)
            at += 1
        return None


class DigestIndex:
    """All files of the index: look-ups of many keys at a time."""

    def __init__(self, paths: list[str], digest=_digest):
        self.files = [DigestFile(p) for p in paths]
        self.first = np.array([f.digests[0] for f in self.files], np.uint64)
        self.digest = digest

    def find(self, keys: list[bytes]) -> list[bytes | None]:
        found: list[bytes | None] = [None] * len(keys)
        if not self.files or not keys:
            return found
        digests = np.array([self.digest(k) for k in keys], np.uint64)
        # digests that two files share begin in the earlier one
        low = np.maximum(np.searchsorted(self.first, digests, "left") - 1, 0)
        high = np.searchsorted(self.first, digests, "right") - 1
        for n, f in enumerate(self.files):
            own = np.flatnonzero((low <= n) & (n <= high))
            at = np.searchsorted(f.digests, digests[own])
            hit = f.digests[np.minimum(at, len(f) - 1)] == digests[own]
            for i, a in zip(own[hit].tolist(), at[hit].tolist(), strict=True):
                if found[i] is None:
                    found[i] = f.confirm(a, int(digests[i]), keys[i])
        return found


def _domains(host: bytes) -> list[bytes]:
    """The host and all its parent domains."""
    out = [host]
    at = host.find(b".")
    while at >= 0:
        out.append(host[at + 1:])
        at = host.find(b".", at + 1)
    return out


def longest_rules(index: DigestIndex, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
    """(rule, verdict) of the longest rule that fits each host and path."""
    raw = [h.encode() for h in hosts]
    distinct = {h: _domains(h) for h in set(raw)}
    domains = sorted({d for ds in distinct.values() for d in ds})
    lengths = {d: struct.unpack(f"<{len(v) // 4}I", v)
               for d, v in zip(domains, index.find([_host_key(d) for d in domains]), strict=True) if v is not None}
    tries = [(i, d, n) for i, h in enumerate(raw) for d in distinct[h] for n in lengths.get(d, ())]
    pieces = [p.encode() for p in paths]
    tries = [(i, d, pieces[i][:n]) for i, d, n in tries if len(pieces[i]) >= n]
    best: list[tuple | None] = [None] * len(hosts)
    for (i, d, p), v in zip(tries, index.find([_rule_key(d, p) for _, d, p in tries]), strict=True):
        if v is not None:
            domain, path = d.decode(), p.decode()
            rank = (len(domain) + len(path), len(domain))
            if best[i] is None or rank > best[i][0]:
                best[i] = (rank, domain + path, VERDICTS[v[0]])
    return [b and b[1:] for b in best]


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    names = build_index(rules)
    kind = pages.schema["page_id"].dataType.simpleString()
    host, path = host_and_path(F.col("url"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex([SparkFiles.get(n) for n in names])
        for b in batches:
            found = longest_rules(index, b.column("host").to_pylist(), b.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("page_id", "host", "path")),
                 pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    return (pages.select("page_id", host.alias("host"), path.alias("path"))
            .mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string"))
