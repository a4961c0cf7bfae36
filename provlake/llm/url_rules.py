"""Operator 9, URL filters: a sort-merge range join of hosts and nested rules.

A host's canonical key is its labels in reverse. Then a rule's host and all its
subdomains are one interval of keys, and two intervals nest or are apart. Sorted hosts and
sorted rules are swept together, keeping a stack of the rules whose interval is open; the
stack at a host is exactly the rules that fit it. Of those whose path starts the url's
path, the longest (host and path together, then host) wins.

Rules are dealt by host and path into blocks of a bounded number, so that no host's rules
are one block; each block is broadcast and swept over the urls, and the best rule so far goes on to the next block, so no number of rules is too
large. Urls never move: there is no shuffle and no hot host.

Defined results: a null url, or one without "://", has an empty host and path and fits no
rule with a host; urls without a rule get the default verdict; repeated rows each get
theirs; of equal rules with different verdicts "block" wins; null rule hosts, paths count
as empty, and a rule with an empty host fits empty hosts alone; very long urls are taken whole; an empty table gives no rows; other columns of
pages, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.llm._spark import ascii_lower, bounded_batches
from provlake.plans.session import checkpointed

BLOCK_RULES = 200_000
END = "\x01"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def key_of(host: str) -> str:
    """Labels in reverse, each closed, so that a key starts with the keys of its parents."""
    return END.join(reversed(host.split("."))) + END if host else "\x00"


def sweep(hosts: list[str], rules: list[tuple[str, dict]]) -> Iterable[tuple[str, list]]:
    """(host, the rules of its open intervals), innermost first, for hosts and rules sorted by key."""
    stack: list[tuple[str, dict]] = []
    at = 0
    for key, host in sorted((key_of(h), h) for h in hosts):
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        yield host, [x[1] for x in reversed(stack)]


def longest(path: str, active: list[dict]) -> tuple | None:
    """The longest rule among the open ones whose path starts the url's."""
    best = None
    for entry in active:
        for n in entry["lengths"]:  # long ones first
            if n <= len(path) and (hit := entry["paths"].get(path[:n])):
                if best is None or hit[2] > best[2]:
                    best = hit
                break
    return best


def grouped(rules: list[tuple[str, str, str]]) -> list[tuple[str, dict]]:
    """Rules by host key, sorted; each with its paths and their lengths."""
    by: dict[str, dict] = {}
    for host, path, verdict in sorted(rules, key=lambda r: (r[0], r[1], r[2] == "block")):
        entry = by.setdefault(key_of(host), {"paths": {}})
        entry["paths"][path] = (host + path, verdict, (len(host) + len(path), len(host)))
    for entry in by.values():
        entry["lengths"] = sorted({len(p) for p in entry["paths"]}, reverse=True)
    return sorted(by.items())


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", block_rules: int = BLOCK_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url).

    rules(host, path, verdict): host, A-Z in any case; path from its first slash on.
    """
    bounded_batches(pages.sparkSession)
    rules = rules.select(F.coalesce(ascii_lower(F.col("host")), F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    blocks = -(-rules.count() // block_rules) or 1
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(-1).alias("rule_chars"), F.lit(-1).alias("host_chars"))
    schema = out.schema

    def swept(table):
        def run(batches):
            sorted_rules = table.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.to_pydict()
                active = dict(sweep(set(x["host"]), sorted_rules))
                for i, (host, path) in enumerate(zip(x["host"], x["path"], strict=True)):
                    best = longest(path, active[host])
                    if best and best[2] > (x["rule_chars"][i], x["host_chars"][i]):
                        x["rule"][i], x["verdict"][i], (x["rule_chars"][i], x["host_chars"][i]) = best
                yield pa.RecordBatch.from_pydict(x, schema=batch.schema)

        return run

    for k in range(blocks):
        block = rules if blocks == 1 else rules.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == k)
        held = grouped([tuple(r) for r in block.collect()])  # bounded by block_rules on average
        out = out.mapInArrow(swept(pages.sparkSession.sparkContext.broadcast(held)), schema)
        if blocks > 1:
            out = checkpointed(out)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
