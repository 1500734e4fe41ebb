"""URL filter: host and path rules, then a weighted vocabulary that one Aho-Corasick pass counts.

Rules come first: a rule `host/path` fits its host and all subdomains if the URL's path starts with the rule's path; the
longest fitting rule decides. URLs that no rule fits are judged by the vocabulary: terms are found in the URL after its
scheme (A-Z lower-cased) in one automaton pass, and count only where no ASCII letter or digit stands beside them. One
strict term rejects; soft terms reject when `min_soft` different ones occur and their weights sum to `min_weight`.

Defined cases: a null URL or one without `://` has an empty host and path, no rule, and is allowed; a very long URL is one
pass over its characters; repeated rows are judged alike; other columns are kept out of the way in a struct.

Map-only: no shuffle; rules and vocabulary are parameters or a table of bounded size, sent with the function; a worker builds the
automaton once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
# Usual terms of adult, gambling, pharmacy and loan spam in English, German, Spanish and French URLs; a table's columns
# can take their place (UrlFilter.from_table).
STRICT = ("adult-x", "casino", "porn", "porno", "pornos", "xxx", "escort", "escorts", "spam-farm", "viagra", "cialis", "hentai", "camgirl", "camgirls", "spielbank", "sexkontakte", "tragaperras", "rencontre-coquine")
SOFT = {
    "free": 1.0, "bets": 1.5, "bet": 1.5, "betting": 1.5, "cheap": 1.0, "pills": 1.5, "win": 1.0, "loan": 1.0, "loans": 1.0, "adult": 1.5, "spam": 1.5, "sex": 1.5, "poker": 1.5, "jackpot": 1.5, "bonus": 1.0, "slots": 1.5,
    "gratis": 1.0, "wetten": 1.5, "billig": 1.0, "pillen": 1.5, "gewinn": 1.0, "kredit": 1.0, "erotik": 1.5,
    "apuestas": 1.5, "barato": 1.0, "pastillas": 1.5, "premio": 1.0, "adultos": 1.5,
    "gratuit": 1.0, "paris-sportifs": 1.5, "pilules": 1.5, "gagner": 1.0, "adulte": 1.5,
}
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "host string, path string, rule string, verdict string, strict_hits int, soft_hits int, weight double"


#: What a worker has built for the filter it used last.
_built: dict = {}


@dataclass(frozen=True)
class UrlFilter:
    rules: tuple = RULES
    strict: tuple = STRICT
    soft: dict = field(default_factory=lambda: dict(SOFT))
    min_soft: int = 2
    min_weight: float = 2.0

    @classmethod
    def from_table(cls, terms: DataFrame, rules: tuple = RULES, most: int = 1_000_000, **options) -> UrlFilter:
        """From terms (term, weight): a null weight makes a strict term. At most `most` different terms, since all workers hold them."""
        found = terms.where("term IS NOT NULL AND term <> ''").groupBy(F.lower("term").alias("term")).agg(F.max("weight").alias("weight"), F.max(F.col("weight").isNull()).alias("strict"))
        rows = found.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"over {most} terms")
        return cls(rules, tuple(sorted(r["term"] for r in rows if r["strict"])), {r["term"]: float(r["weight"]) for r in sorted(rows) if not r["strict"]}, **options)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t in {*self.strict, *self.soft}:
            a.add_word(t, t)
        a.make_automaton()
        return a

    @cached_property
    def labels(self) -> int:
        """Labels of the longest host of a rule: no more of a URL's host are looked at."""
        return max((rule.partition("/")[0].count(".") + 1 for rule, _ in self.rules), default=1)

    def by_host(self) -> dict[str, list[tuple[str, str, str]]]:
        """Rules of each host, the longest first."""
        out: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in self.rules:
            host, slash, path = rule.partition("/")
            out.setdefault(host, []).append((slash + path, rule, verdict))
        return {h: sorted(r, key=lambda x: -len(x[0])) for h, r in out.items()}

    def judge(self, url: str | None, automaton, by_host) -> tuple:
        before, mark, rest = (url or "").partition("://")
        host = path = ""
        if mark:
            end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
            host, tail = rest[:end].translate(ASCII_LOWER), rest[end:]
            cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
            path = tail[:cut]
        text = rest.translate(ASCII_LOWER) if mark else ""
        found = {t for e, t in automaton.iter(text) if not _word(text, e + 1) and not _word(text, e - len(t))}
        strict, soft = found.intersection(self.strict), found.intersection(self.soft)
        weight = float(sum(self.soft[t] for t in soft))
        best, labels = None, host.rsplit(".", self.labels)[-self.labels :] if host else []
        for at in (".".join(labels[i:]) for i in range(len(labels))):
            for p, rule, verdict in by_host.get(at, ()):
                if path.startswith(p):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
        bad = bool(strict) or len(soft) >= self.min_soft and weight >= self.min_weight
        rule, verdict = best or (None, "block" if bad else "allow")
        return host, path, rule, verdict, len(strict), len(soft), weight

    def column(self, url: str | Column) -> Column:
        """Struct of host, path, rule, verdict, strict_hits, soft_hits, weight for a URL column."""

        name = uuid.uuid4().hex

        @F.pandas_udf(SCHEMA)
        def judged(urls: pd.Series) -> pd.DataFrame:
            if name not in _built:
                _built.clear()
                _built[name] = self.automaton(), self.by_host()
            automaton, by_host = _built[name]
            return pd.DataFrame([self.judge(u, automaton, by_host) for u in urls], columns=[c.split()[0] for c in SCHEMA.split(", ")])

        return judged(F.col(url) if isinstance(url, str) else url)


def _word(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (c := text[i]).isascii() and c.isalnum()


def url_query(pages: DataFrame) -> DataFrame:
    judged = pages.select("page_id", UrlFilter().column("url").alias("judged"))
    return judged.select("page_id", *(F.col(f"judged.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight")))


def _sql() -> str:
    edge = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda r: f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))"
    rules = sorted(RULES, key=lambda r: -len(r[0]))
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, {lower("rest")} AS u, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (SELECT page_id, host, path, {" + ".join(map(edge, STRICT))} AS strict_hits, {" + ".join(map(edge, SOFT))} AS soft_hits,
                {" + ".join(f"{edge(t)} * {w}::DOUBLE" for t, w in SOFT.items())} AS weight FROM part),
ruled AS (SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in rules)} END AS rule FROM hits)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules)}
            WHEN strict_hits > 0 OR (soft_hits >= 2 AND weight >= 2) THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits, weight
FROM ruled
"""


SQL = _sql()
