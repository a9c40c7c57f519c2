"""URL filter: a trie over reversed host labels and path segments.

The rules are compiled on the driver into one trie.  Its first levels are host
labels from the right (``com``, ``example``), the levels below a rule's host are
the whole segments of its path; a last, partial segment is kept as a prefix at
its node.  A url walks down its labels, and at each node that ends a rule's host
down its segments, so the work depends on the url's depth and not on the number
of rules.  Of the rules that fit, the longest decides.

The rules are configuration, not data: ``MAX_RULE_BYTES`` bounds what is
broadcast, and a larger list is refused rather than sent out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path, verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DEFAULT = "allow"
MAX_RULE_BYTES = 256 << 20


class Node:
    __slots__ = ("below", "paths", "prefixes", "rule")

    def __init__(self) -> None:
        self.below: dict[str, Node] = {}
        #: At the end of a rule's host: the trie of path segments.
        self.paths: Node | None = None
        #: Partial last segments and the rules that end in them.
        self.prefixes: dict[str, tuple[int, int, str, str]] = {}
        #: The rule whose path ends with this segment's slash.
        self.rule: tuple[int, int, str, str] | None = None


def build(rules: Iterable[tuple[str, str, str]]) -> Node:
    root = Node()
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.below.setdefault(label, Node())
        node.paths = at = node.paths or Node()
        value = (len(host) + len(path), len(host), host + path, verdict)
        *whole, rest = path.split("/")
        for segment in whole:
            at = at.below.setdefault(segment, Node())
        # the same rule given twice: block wins
        if rest:
            at.prefixes[rest] = max(at.prefixes.get(rest, value), value, key=lambda v: v[3])
        else:
            at.rule = max(at.rule or value, value, key=lambda v: v[3])
    return root


def _fits(node: Node, path: str) -> Iterator[tuple[int, int, str, str]]:
    """Rules below the host's node whose path starts this path."""
    *whole, rest = path.split("/")
    for segment in [*whole, None]:
        if node.rule:
            yield node.rule
        if node.prefixes:
            here = rest if segment is None else segment
            for n in range(1, len(here) + 1):
                if here[:n] in node.prefixes:
                    yield node.prefixes[here[:n]]
        if segment is None or segment not in node.below:
            return
        node = node.below[segment]


def decide(root: Node, host: str, path: str, default: str = DEFAULT) -> tuple[str | None, str]:
    """The longest rule (host and path together; equally long: the longer host) that fits, and its verdict."""
    best = max(_fits(root.paths, path), default=None) if root.paths else None
    node = root
    for label in reversed(host.split(".")):
        node = node.below.get(label)
        if node is None:
            break
        if node.paths:
            best = max(filter(None, (best, max(_fits(node.paths, path), default=None))), default=None)
    return (best[2], best[3]) if best else (None, default)


def url_host(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """All columns of ``pages`` but those named like the new ones, with ``host``, ``path``, ``rule`` and ``verdict``.

    A null url, or one without ``://``, has an empty host and path and gets the
    default.  ``rules`` are (host, path, verdict); a rule fits its host and all
    subdomains if the url's path starts with the rule's.
    """
    rules = [(h.lower(), p, v) for h, p, v in rules]
    if sum(len(h) + len(p) for h, p, _ in rules) > MAX_RULE_BYTES:
        raise ValueError("the rules are larger than what is broadcast")
    sent = pages.sparkSession.sparkContext.broadcast(rules)
    tries: list[Node] = []

    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        if not tries:
            tries.append(build(sent.value))
        return pd.DataFrame([decide(tries[0], h, p, default) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"])

    judged = F.pandas_udf(judge, "rule string, verdict string")
    new = {"host", "path", "rule", "verdict"}
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    parts = pages.select(*kept, url_host(url).alias("host"), url_path(url).alias("path"))
    return parts.withColumn("judged", judged("host", "path")).select(*kept, "host", "path", "judged.rule", "judged.verdict")
