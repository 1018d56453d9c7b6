"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A canonical URL is a lower-case host and a path without scheme, query or fragment. An entry fits its host and all
subdomains, where the path starts with the entry's. The keys a URL could be listed under are its host's suffixes with
its path's prefixes, of the lengths that entries have. The Bloom filter, whose 512-bit blocks are read once a key,
discards nearly all keys; the others meet the list in an exact join on the key, which removes false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, keep, raw, refuse, small, table
from .words import _BASE, _BASE_INV, _BYTES, mix, powers

#: Bits a key and bits set a key. A filter within ``BROADCAST_BYTES`` goes to every worker whole; a larger one is cut into
#: shards of about so many listed keys, each of which meets the keys of its own share.
BITS, SET = 16, 8
SHARD_KEYS, GROUP_KEYS = 1 << 19, 100_000
# The rules (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Listed sites that are blocked where no rule fits; a list to be replaced by one's own.
LISTED = (("cheap-pills.example.com", "/"), ("spam-farm.example.org", "/"))


def key_hashes(array: pa.Array) -> np.ndarray:
    """64-bit hashes of whole strings."""
    data, offs = raw(array)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[offs[1:]] - total[offs[:-1]]) * powers(_BASE_INV, len(data) + 1)[offs[:-1]] + np.diff(offs).astype(np.uint64))


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and the mask of its bits in the block's eight words."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    spread = mix(hashes, 5)
    masks = np.zeros((len(hashes), 8), np.uint64)
    for k in range(SET):  # one bit in each word
        masks[:, k] = np.uint64(1) << (spread >> np.uint64(6 * k) & np.uint64(63))
    return block, masks


def bloom(keys: DataFrame, count: int) -> np.ndarray:
    """The filter of a ``key`` column: (blocks, 8) words, built in parallel and combined by OR."""
    blocks = max(1, -(-count * BITS // 512))
    pieces = min(64, blocks)
    edges = [blocks * i // pieces for i in range(pieces + 1)]

    def part(batches):
        own = np.zeros((blocks, 8), np.uint64)
        for batch in batches:
            block, masks = _places(key_hashes(batch.column("key")), blocks)
            np.bitwise_or.at(own, block, masks)
        if own.any():
            yield pa.RecordBatch.from_pydict({"piece": np.arange(pieces, dtype=np.int32), "bits": [own[a:b].tobytes() for a, b in zip(edges, edges[1:])]})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = key[0].as_py()
        own = np.zeros((edges[i + 1] - edges[i]) * 8, np.uint64)
        for batch in batches:
            for x in batch.column("bits"):
                own |= np.frombuffer(x.as_buffer(), np.uint64)
        yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "bits": pa.array([own.tobytes()], pa.binary())})

    out = np.zeros((blocks, 8), np.uint64)
    for row in keys.select("key").mapInArrow(part, "piece int, bits binary").groupBy("piece").applyInArrow(merge, "piece int, bits binary").toLocalIterator():
        out[edges[row["piece"]] : edges[row["piece"] + 1]] = np.frombuffer(row["bits"], np.uint64).reshape(-1, 8)
    return out


def possible(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, masks = _places(hashes, len(bits))
    return ((bits[block] & masks) == masks).all(1)


def split_url(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host`` and ``path``; both empty where the URL is null or has no ``://``.

    Rows stay, repeated ones too, as do other columns; one named ``host`` or ``path`` is an error.
    """
    refuse(urls, "host", "path")
    url = F.col(f"`{url_col}`")
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring_index(url, "://", 1)).otherwise("")
    rest = F.when(at > 0, url.substr(F.length(rest) + 4, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))})


def entries(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    """The list as a table: key, verdict, rule (null for listed sites), its rank among entries that fit."""
    rows = [(host + path, verdict, host + path, 1_000_000 + len(host + path), len(host), len(path)) for verdict, host, path in rules]
    rows += [(host + path, "block", None, len(host + path), len(host), len(path)) for host, path in listed]
    return spark.createDataFrame(rows, "key string, verdict string, rule string, rank int, host_size int, path_size int")


def sharded(keys: DataFrame, listed: DataFrame, count: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The distinct ``keys`` (key) that a Bloom filter of the listed ones, cut into shards by a hash of the key, lets pass."""
    shards = max(1, -(-count // shard_keys))
    blocks = max(1, -(-shard_keys * BITS // 512))
    salts = max(1, -(-keys.count() // (shards * GROUP_KEYS)))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((blocks, 8), np.uint64)
        for batch in batches:
            block, masks = _places(key_hashes(batch.column("key")), blocks)
            np.bitwise_or.at(own, block, masks)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([own.tobytes()], pa.binary())})

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        found = left.select(["key"])
        if not right.num_rows:
            return found.slice(0, 0)
        bits = np.frombuffer(right.column("bits")[0].as_buffer(), np.uint64).reshape(-1, 8)
        return found.filter(pa.array(possible(bits, key_hashes(found.column("key").combine_chunks()))))

    filters = listed.select("key", shard).groupBy("shard").applyInArrow(build, "shard long, bits binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = keys.select("key", shard, F.pmod(F.xxhash64("key", F.lit(1)), F.lit(salts)).cast("int").alias("salt"))
    return dealt.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(test, "key string")


def judge(pages: DataFrame, listed: DataFrame, default: str = "allow", most_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``pages`` (host, path and more) with ``rule`` and ``verdict``: those of the longest rule that fits, else of a listed site, else ``default``.

    Between rules of one length the one with the longer host counts. Every row of ``pages`` stays, repeated ones and those
    with an empty host too (the default, since no entry fits); an empty table gives an empty one. ``pages`` must not have
    columns ``rule``, ``verdict`` or ``best``; others are carried.
    """
    if clash := {"rule", "verdict", "best"} & set(pages.columns):
        raise ValueError(f"names of result columns: {sorted(clash)}")
    sizes = sorted(r["path_size"] for r in listed.select("path_size").distinct().collect())
    count = listed.count()
    bits = pages.sparkSession.sparkContext.broadcast(bloom(listed, count)) if count * BITS // 8 <= most_bytes else None

    def keys(batches):
        for batch in batches:
            rows, found = [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                ends = [path[:n] for n in sizes if n <= len(path)]
                while host and ends:
                    found += [host + end for end in ends]
                    rows += [i] * len(ends)
                    _, dot, host = host.partition(".")
            if found:
                array = pa.array(found, pa.string())
                at = np.flatnonzero(possible(bits.value, key_hashes(array))) if bits else np.arange(len(found))
                if len(at):
                    row = pa.array(np.array(rows, np.int64)[at])
                    yield pa.RecordBatch.from_arrays([batch.column("host").take(row), batch.column("path").take(row), array.take(pa.array(at))], ["host", "path", "key"])

    hits = pages.select("host", "path").distinct().mapInArrow(keys, "host string, path string, key string")
    met = listed
    if bits is None:  # the shards judge distinct keys, so a key that many URLs have is no large group
        hits = keep(hits, "keys")
        met = keep(sharded(keep(hits.select("key").distinct(), "distinct"), listed, count, shard_keys).join(listed, "key"), "met")
    best = hits.join(small(met), "key").groupBy("host", "path").agg(F.max(F.struct("rank", "host_size", "rule", "verdict")).alias("best"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select(*pages.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = split_url(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path")
    return judge(pages, entries(spark))


SQL = """
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
entry(verdict, h, p, rule, rank) AS (VALUES
  ('allow', 'org', '/', 'org/', 1000004), ('block', 'example.org', '/es/', 'example.org/es/', 1000015),
  ('block', 'example.org', '/en/1', 'example.org/en/1', 1000016), ('allow', 'com', '/fr/', 'com/fr/', 1000007),
  ('block', 'com', '/de/', 'com/de/', 1000007), ('block', 'cheap-pills.example.com', '/', NULL, 24), ('block', 'spam-farm.example.org', '/', NULL, 22)),
urls AS (SELECT DISTINCT host, path FROM split),
best AS (
  SELECT host, path, max({'rank': rank, 'hs': length(h), 'rule': coalesce(rule, ''), 'verdict': verdict}) AS b
  FROM urls JOIN entry ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, nullif(b.rule, '') AS rule, coalesce(b.verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (host, path)
"""
