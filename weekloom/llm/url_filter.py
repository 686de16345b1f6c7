"""URL filter over a memory-mapped sorted array of rule digests.

A rule is a host and the beginning of a path, with a verdict. The index is four arrays in
files: the sorted 64-bit xxhash keys, the verdicts, and the rules' full strings with their
offsets. Spark ships the files to each executor's disk; workers map them, so only touched
pages are in memory. A URL's possible rules (each parent of its host with each length of
path that some rule has) are probed by one vectorised binary search per batch, and a hit
counts only if the stored string is equal.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm.common import kept, table

MAX_INDEX_BYTES = 1 << 30
DEFAULT = "allow"
# The rules of the registered query: fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlIndex:
    """Names of the shipped files, and the lengths of path that rules have."""

    name: str
    path_lengths: tuple[int, ...]


def build_index(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> UrlIndex:
    """Index ``rules`` of (verdict, host, path) and ship it to the executors.

    A host covers itself and its subdomains. A rule given twice blocks if either blocks. The
    list goes through the driver, as configuration does; more than ``MAX_INDEX_BYTES`` of it
    is refused.
    """
    verdicts: dict[bytes, int] = {}
    lengths, size = set(), 0
    for verdict, host, path in rules:
        key = (host.lower() + path).encode()
        size += 0 if key in verdicts else len(key) + 17
        if size > MAX_INDEX_BYTES:
            raise ValueError(f"the rules take more than {MAX_INDEX_BYTES} bytes")
        verdicts[key] = max(verdicts.get(key, 0), int(verdict == "block"))
        lengths.add(len(path))
    keys = sorted(verdicts, key=lambda s: (xxhash.xxh64_intdigest(s), s))
    arrays = {
        "digests": np.array([xxhash.xxh64_intdigest(s) for s in keys], np.uint64),
        "offsets": np.cumsum([0, *map(len, keys)]).astype(np.int64),
        "strings": np.frombuffer(b"".join(keys) or b"\0", np.uint8),
        "blocks": np.array([verdicts[s] for s in keys], np.uint8),
    }
    name, folder = f"url-index-{uuid.uuid4().hex}", tempfile.mkdtemp()
    for part, values in arrays.items():
        np.save(path := os.path.join(folder, f"{name}-{part}.npy"), values)
        spark.sparkContext.addFile(path)
    return UrlIndex(name, tuple(sorted(lengths)))


class _Index:
    def __init__(self, name: str):
        load = lambda part: np.load(SparkFiles.get(f"{name}-{part}.npy"), mmap_mode="r")
        self.digests, self.offsets, self.strings, self.blocks = map(load, ("digests", "offsets", "strings", "blocks"))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key in the index, or -1."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, digests)
        out = np.full(len(keys), -1)
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests)) if len(self.digests) else ():
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == digests[i]:  # different strings may share a digest
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out


def _judge(index: UrlIndex, hosts: pd.Series, paths: pd.Series, default: str) -> pd.DataFrame:
    stored = kept(("url index", index.name), lambda: _Index(index.name))
    parents: dict[str, list[str]] = {}
    for host in hosts.unique():
        labels = host.split(".")
        parents[host] = [".".join(labels[i:]) for i in range(len(labels))]
    distinct, row, keys = {}, [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        for n in index.path_lengths:
            if n <= len(path):
                for parent in parents[host]:
                    row.append(i)
                    keys.append(distinct.setdefault(parent + path[:n], len(distinct)))
    found = stored.find([k.encode() for k in distinct])
    texts, best = list(distinct), [(-1, "", -1)] * len(hosts)
    for i, k in zip(row, keys):
        if found[k] >= 0:
            best[i] = max(best[i], (len(texts[k]), texts[k], int(found[k])))
    names = ("allow", "block")
    return pd.DataFrame(
        {
            "rule": [t if j >= 0 else None for _, t, j in best],
            "verdict": [names[stored.blocks[j]] if j >= 0 else default for *_, j in best],
        }
    )


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty if the URL is null or has no ``://``."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    host = F.translate(part(r"(?s)^.*?://([^/?#]*)"), UPPER, LOWER)
    return df.withColumns({"host": host, "path": part(r"(?s)^.*?://[^/?#]*([^?#]*)")})


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``df``.

    A rule fits its host and all subdomains if the path begins with the rule's; the longest
    wins (of equally long ones the later in code-point order). Without a rule, ``rule`` is
    null and the verdict ``default``: the list names what to refuse. Rows are kept as they
    are, repeated ones too; columns of ``df`` with one of the new names are replaced.
    """
    index = build_index(df.sparkSession, rules)

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            yield _judge(index, hosts, paths, default)

    judged = F.pandas_udf(judge, "rule string, verdict string")
    split = host_and_path(df.drop("host", "path", "rule", "verdict"), url)
    return split.withColumn("judged", judged("host", "path")).select(*split.columns, "judged.rule", "judged.verdict")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL against the five rules."""
    return filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = f"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages
), r(verdict, host, path) as (values {", ".join(map(str, RULES))}),
m as (
  select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict,
    row_number() over (partition by p.page_id order by length(r.host || r.path) desc nulls last) as nth
  from p left join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
)
select page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') as verdict from m where nth = 1
"""
