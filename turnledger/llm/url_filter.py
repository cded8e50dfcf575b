"""URL filters over a sorted digest array.

A list of strings becomes an array sorted by their 64-bit xxhash keys. Spark sorts it by key ranges and writes each range as a block;
Spark ships the blocks to the executors, which lay them down as one file: keys, values, offsets, strings. Workers map the
file into memory, probe all candidates of a batch with one binary search, and confirm each hit against the stored string,
so that colliding keys decide nothing. No list passes through the driver's memory.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words that block a host when a part of its name, between dots and hyphens, equals one.
BAD_NAMES = ("betting", "casino", "pills", "poker", "porn", "spam", "viagra", "warez")


def _key(text: bytes) -> int:
    """As a signed number, which is how Spark sorts it."""
    key = xxhash.xxh64_intdigest(text)
    return key - (1 << 64) if key >> 63 else key


def write_array(path: str, blocks: Iterable[tuple[np.ndarray, np.ndarray, pa.BinaryArray]], count: int) -> None:
    """Writes count, keys, values, offsets, strings, from blocks (keys, values, strings) in the order of their keys. Strings whose
    keys collide lie next to each other."""
    with open(path, "wb") as out:
        out.write(np.array([count], "<i8").tobytes())
    out = np.memmap(path, "<i8", "r+", 0, 3 * count + 2)
    at, offset = 0, 0
    out[2 * count + 1] = 0
    for keys, values, strings in blocks:
        n = len(keys)
        out[1 + at : 1 + at + n], out[1 + count + at : 1 + count + at + n] = keys, values
        texts = strings.to_pylist()
        out[2 + 2 * count + at : 2 + 2 * count + at + n] = offset + np.cumsum([len(t) for t in texts])
        with open(path, "ab") as tail:
            tail.write(b"".join(texts))
        offset, at = offset + sum(map(len, texts)), at + n
    out.flush()


class DigestArray:
    """A mapped index file."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, "<i8", 1)[0])
        head = np.memmap(path, "<i8", "r", 8, 3 * n + 1)
        self.keys, self.values, self.offsets = head[:n], head[n : 2 * n], head[2 * n :]
        self.at, self.bytes = 8 * (3 * n + 2), np.memmap(path, np.uint8, "r")

    def find(self, texts: list[bytes]) -> list[int]:
        """The value of each string, -1 where it is not in the list."""
        out = [-1] * len(texts)
        if not len(self.keys) or not texts:
            return out
        keys = np.fromiter(map(_key, texts), np.int64, len(texts))
        spots = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(spots, len(self.keys) - 1)] == keys):
            k = int(spots[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                a, b = int(self.offsets[k]), int(self.offsets[k + 1])
                if self.bytes[self.at + a : self.at + b].tobytes() == texts[i]:
                    out[i] = int(self.values[k])
                    break
                k += 1
        return out


#: Strings of one block.
BLOCK_STRINGS = 1_000_000


def ship_index(spark: SparkSession, entries: DataFrame) -> list[str]:
    """entries: text binary, value long; of equal texts the largest value stays. Sorts and writes the blocks, lets Spark hand the files
    to every executor and tells their names."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(list(map(_key, batch.column(0).to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, *batch.columns], ["key", "text", "value"])

    one = stored(entries.groupBy("text").agg(F.max("value").alias("value")).mapInArrow(keyed, "key long, text binary, value long"))
    blocks = stored(one.repartitionByRange(max(1, -(-one.count() // BLOCK_STRINGS)), "key").sortWithinPartitions("key", "text"))
    files = sorted(blocks.inputFiles())
    for f in files:
        spark.sparkContext.addFile(f)
    return [f.rpartition("/")[2] for f in files]


def local_array(names: list[str]) -> DigestArray:
    """The array of some shipped blocks, laid down once on each executor."""
    files = [SparkFiles.get(name) for name in names]
    path = (files[0] if files else SparkFiles.getRootDirectory() + "/none") + ".array"
    if not os.path.exists(path):
        sizes = [pq.read_metadata(f).num_rows for f in files]
        firsts = sorted((pq.read_table(f, columns=["key"]).column(0)[0].as_py(), f) for f, n in zip(files, sizes, strict=True) if n)

        def blocks():
            for _, f in firsts:
                table = pq.read_table(f, columns=["key", "value", "text"]).combine_chunks()
                yield table.column("key").to_numpy(), table.column("value").to_numpy(), table.column("text")

        own = f"{path}.{uuid.uuid4().hex}"
        write_array(own, blocks(), sum(sizes))
        os.replace(own, path)
    return DigestArray(path)


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    stop = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    tail = rest[stop:]
    end = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return rest[:stop].translate(_LOWER), tail[:end]


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every rule string that would fit, the longest first: the host and what follows each of its dots, with
    the path's beginnings of the lengths that rules have."""
    hosts, rest = [], host
    while host:
        hosts.append(rest)
        _, dot, rest = rest.partition(".")
        if not dot:
            break
    heads = [path[:n] for n in lengths if n <= len(path)]
    return sorted({h + p for h in hosts for p in heads}, key=lambda x: (-len(x), x))


def _parts(url: Column) -> tuple[Column, Column]:
    """split_url as expressions."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def page_list(pages: DataFrame, bad_names=BAD_NAMES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """text (host and path), value: 1 if any page there, under whatever scheme or query, names a bad word in its host or its
    HTML, else 0. One row an address, so the list grows with the pages."""
    host, path = _parts(F.col(url_col))
    named = F.arrays_overlap(F.split(F.translate(host, "-", "."), r"\."), F.array(*map(F.lit, bad_names)))
    told = F.lower(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).rlike(f"(?:^|[^a-z])(?:{'|'.join(bad_names)})(?:[^a-z]|$)")
    rows = pages.select(F.concat(host, path).alias("text"), (host != "").alias("has_host"), (named | told).cast("long").alias("value"))
    return rows.filter("has_host").groupBy("text").agg(F.max("value").alias("value"))


def judged(pages: DataFrame, rules=RULES, bad_names=BAD_NAMES, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    The longest rule that fits decides; of equal rules block wins. Without a rule the list (text: host and path, value: 1 blocks) decides;
    what it does not hold is blocked if the host is empty (a null url, or one without "://") or its name has a bad word, else
    allowed. Rules and bad names are few and written by hand; the list may be of any size. Repeated rows and
    null ids give rows each, other ids are whole numbers; an empty table gives none; very long urls are judged whole. Only the two columns are read."""
    lengths = sorted({len(path) for _, _, path in rules})
    entries = [(("r" + host + path).encode(), int(action == "block")) for action, host, path in rules]
    entries += [(b"n" + name.encode(), 1) for name in bad_names]
    # the same string may part differently into host and path: a rule counts only where its own parting fits
    partings: dict[str, set[int]] = {}
    for _, host, path in rules:
        partings.setdefault(host + path, set()).add(len(host))
    loose = {k: v for k, v in partings.items() if "/" in k[: max(v)] or not k[max(v) :].startswith("/")}
    if loose:
        raise ValueError(f"a rule's path starts with its first slash: {sorted(loose)[:3]}")
    spark = pages.sparkSession
    table = spark.createDataFrame(entries, "text binary, value long")
    if listed is not None:
        table = table.unionByName(listed.select(F.concat(F.lit("p"), F.col("text").cast("string")).cast("binary").alias("text"), F.col("value").cast("long").alias("value")))
    names_of_blocks = ship_index(spark, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = local_array(names_of_blocks)
        for batch in batches:
            parts = [split_url(u.as_py()) for u in batch.column(1)]
            probes, owner = [], []
            for k, (host, path) in enumerate(parts):
                for c in candidates(host, path, lengths):
                    probes.append(b"r" + c.encode())
                    owner.append(k)
            rule: list[str | None] = [None] * len(parts)
            verdict: list[str] = ["allow" if host else "block" for host, _ in parts]
            for k, text, value in zip(owner, probes, index.find(probes), strict=True):
                if value >= 0 and rule[k] is None:
                    rule[k], verdict[k] = text[1:].decode(), "block" if value else "allow"
            open_ = [k for k, (host, _) in enumerate(parts) if host and rule[k] is None]
            on_list = dict(zip(open_, index.find([("p" + "".join(parts[k])).encode() for k in open_]), strict=True))
            names, owner = [], []
            for k in open_:
                host = parts[k][0]
                if on_list[k] >= 0:
                    verdict[k] = "block" if on_list[k] else "allow"
                else:
                    for word in host.replace("-", ".").split("."):
                        names.append(b"n" + word.encode())
                        owner.append(k)
            for k, value in zip(owner, index.find(names), strict=True):
                if value >= 0:
                    verdict[k] = "block"
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import read

    pages = read(spark, sf_dir, "pages")
    return judged(pages, listed=page_list(pages))


_RULES = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in RULES)
_NAMES = ", ".join(f"'{x}'" for x in BAD_NAMES)

OP6_SQL = rf"""
WITH u AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
    regexp_matches(lower(coalesce(html, '')), '(?:^|[^a-z])(?:{"|".join(BAD_NAMES)})(?:[^a-z]|$)') AS told
  FROM pages
), rules(action, rule_host, rule_path) AS (VALUES {_RULES}),
fits AS (
  SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r
), listed AS (
  SELECT host || path AS address, bool_or(told OR list_has_any(string_split(replace(host, '-', '.'), '.'), [{_NAMES}])) AS bad
  FROM u WHERE host <> '' GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host = '' OR bad THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits USING (r) LEFT JOIN listed ON host <> '' AND address = host || path
"""
