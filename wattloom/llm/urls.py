"""URL filter: pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")


class HostRule(NamedTuple):
    """Fits a host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


class Pattern(NamedTuple):
    """A regular expression over ``host + path``, and the tokens that every URL it fits must have."""

    regex: str
    literals: tuple[str, ...]


# rules of the production query
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
PATTERNS = (
    Pattern(r"(^|\.)spam-farm\.", ("spam", "farm")),
    Pattern(r"(^|\.)cheap-pills\.", ("cheap", "pills")),
    Pattern(r"(^|[.-])casino([.-]|$|/)", ("casino",)),
    Pattern(r"(^|\.)adult(s)?-only\.", ("only",)),
    Pattern(r"/wp-login\.php", ("wp", "login", "php")),
)


class PatternIndex:
    """Rules by the one of their literal tokens that fewest rules name."""

    def __init__(self, patterns: Sequence[Pattern]):
        use = Counter(t for p in patterns for t in set(p.literals))
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for i, p in enumerate(patterns):
            if not p.literals:
                raise ValueError(f"a rule needs a literal token: {p.regex}")
            self.by_token[min(set(p.literals), key=lambda t: (use[t], -len(t), t))].append(i)
        self.compiled = [re.compile(p.regex) for p in patterns]

    def blocks(self, url: str) -> bool:
        for token in set(TOKEN.findall(url)) & self.by_token.keys():
            if any(self.compiled[i].search(url) for i in self.by_token[token]):
                return True
        return False


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case (A-Z) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def host_rule(rules: dict[str, list[HostRule]], host: str, path: str) -> HostRule | None:
    """The longest rule that fits; of equally long ones that of the longer host."""
    best, labels = None, host.split(".")
    for i in range(len(labels)):
        for r in rules.get(".".join(labels[i:]), ()):
            if path.startswith(r.path) and (best is None or len(r.host + r.path) > len(best.host + best.path)):
                best = r
    return best


def judge_urls(
    pages: DataFrame, rules: Sequence[HostRule] = HOST_RULES, patterns: Sequence[Pattern] = PATTERNS, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row.

    The longest host rule that fits decides; without one (rule is null) the URL is blocked if a pattern fits
    host and path. A null URL, or one without ``://``, has an empty host and path, fits no rule and is allowed.
    Rows are judged one by one, so repeated rows, ties and rows without an id stay as they are; an empty table
    gives an empty result. Both rule lists are arguments and travel with the task; a URL's tokens fetch
    the few patterns that can fit, so the cost of a URL does not grow with the list.
    """
    index, by_host = PatternIndex(patterns), defaultdict(list)
    for r in rules:
        by_host[r.host].append(r)
    by_host = dict(by_host)
    kind = pages.schema[page_id].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            hosts, paths, names, verdicts = [], [], [], []
            for u in batch.column(1).to_pylist():
                host, path = split_url(u)
                r = host_rule(by_host, host, path) if host else None
                hosts.append(host)
                paths.append(path)
                names.append(r and r.host + r.path)
                verdicts.append(r.verdict if r else "block" if index.blocks(host + path) else "allow")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string"
    )
