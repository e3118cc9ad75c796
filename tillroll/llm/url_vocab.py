"""URL filter by a weighted vocabulary.

An Aho-Corasick automaton over the lower-cased URL counts strict and soft
terms that stand between non-alphanumeric characters (or the ends).  One strict
term, or ``soft_limit`` distinct soft terms, blocks the URL.  Host and path
rules come first: a rule ``host/path`` fits the host and its subdomains if the
URL's path starts with the rule's path; the longest fitting rule decides, the
alphabetically first among equals.

Defined cases: a null URL or one without ``://`` has an empty host and path, no
rule, and is judged by its terms alone (null: allowed).  Repeated rows stay;
other columns are not read.  The automaton is a parameter-sized constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("porn", "xxx", "hentai", "escort", "casino", "viagra", "warez", "hardcore")
SOFT = ("ads", "track", "adult", "sex", "bet", "poker", "loan", "pills", "dating", "hot", "nude", "crack", "torrent",
        "cheap", "bonus")
SOFT_LIMIT = 2
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))


def _ascii_lower(s: str) -> str:
    return s.translate({c: c + 32 for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path then up to ``?``, ``#`` or the end."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = min((rest[:i] for c in "?#" if (i := rest.find(c)) >= 0), key=len, default=rest)
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return _ascii_lower(host), path


class Vocabulary:
    """Strict and soft terms in one automaton."""

    def __init__(self, strict: tuple[str, ...], soft: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in [*((t, 0) for t in soft), *((t, 1) for t in strict)]:
            self.automaton.add_word(term, (term, weight))
        self.empty = not (strict or soft)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[int, int]:
        """Distinct strict and soft terms with a boundary on both sides."""
        if self.empty or not url:
            return 0, 0
        low = _ascii_lower(url)
        found = set()
        word = lambda c: c.isascii() and c.isalnum()
        for end, (term, weight) in self.automaton.iter(low):
            begin = end - len(term) + 1
            if (begin == 0 or not word(low[begin - 1])) and (end + 1 == len(low) or not word(low[end + 1])):
                found.add((weight, term))
        strict = sum(w for w, _ in found)
        return strict, len(found) - strict


class Rules:
    """Rules by host suffix: a host is looked up once per label."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append(("/" + path, rule, verdict))

    def of(self, host: str, path: str) -> tuple[str, str] | None:
        fits, at = [], 0
        while host:
            fits += [(-len(r), r, v) for p, r, v in self.by_host.get(host[at:], ()) if path.startswith(p)]
            if (dot := host.find(".", at)) < 0:
                break
            at = dot + 1
        return min(fits)[1:] if fits else None


def judge(pages: DataFrame, rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT,
          soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, by_host = Vocabulary(strict, soft), Rules(rules)
        for df in batches:
            out = []
            for url in df["url"]:
                url = url if isinstance(url, str) else None
                host, path = split_url(url)
                rule = by_host.of(host, path)
                n_strict, n_soft = vocabulary.hits(url)
                method = "block" if n_strict or n_soft >= soft_limit else "allow"
                out.append((host, path, rule[0] if rule else None, rule[1] if rule else method, n_strict, n_soft))
            res = pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "n_strict", "n_soft"], dtype=object)
            res.insert(0, "page_id", df["page_id"].to_numpy())
            yield res

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInPandas(
        run, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def oracle_sql(rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT, soft_limit: int = SOFT_LIMIT) -> str:
    """DuckDB statement for ``judge(pages)``: the same vocabulary by regular expressions, term by term."""
    def has(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::int"
    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}'))"
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, translate(url, '{upper}', '{lower}') AS low,
        CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM u),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/]*'), '{upper}', '{lower}') AS host,
        CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM r),
c AS (SELECT *, {' + '.join(has(t) for t in strict)} AS n_strict, {' + '.join(has(t) for t in soft)} AS n_soft,
        CASE {' '.join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ordered)} END AS rule FROM h)
SELECT page_id::bigint AS page_id, host, path, rule,
  CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in ordered)}
       WHEN n_strict > 0 OR n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict,
  n_strict::bigint AS n_strict, n_soft::bigint AS n_soft FROM c"""
