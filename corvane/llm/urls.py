"""URL filter: rules for hosts and paths, then a weighted vocabulary.

An Aho-Corasick automaton finds all terms in a lower-cased url, in which percent escapes of ASCII characters are decoded; a hit counts if neither neighbour is a letter
or digit. Each term adds its weight once, however often it stands; LIMIT or more is a rejection, so a strict term
(weight LIMIT) rejects alone and soft ones (weight 1) do together. The vocabulary is a parameter, or a table (term, weight).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

LIMIT = 2
MOST_TERMS = 1_000_000
# The default vocabulary, written for this module: words of url slugs by topic. Strict ones hardly stand in a url of another kind; soft ones do, but not two of them.
STRICT = (
    "casino casinos gambling gamble sportsbook jackpots slotmachine pokies roulette blackjack baccarat bookie bookies "
    "porn porno pornos pornhub xxx hentai camgirl camgirls camsex livesex sexcam sexchat nudes milf upskirt bdsm hardcore-sex escort-service "
    "viagra cialis levitra xanax tramadol phentermine oxycodone steroids-online buy-pills "
    "warez keygen keygens serialz cracked-software nulled torrentz "
    "spam spammer phishing malware ransomware botnet ddos-service carding cvv fullz "
    "replica-watches fake-id fake-ids counterfeit payday-loan payday-loans get-rich-quick forex-robot "
).split()
SOFT = (
    "ads adult bet bets betting bingo bonus bonuses casinoonline cash cheap cheapest click clicks coupon coupons crack cracks credit crypto dating deal deals "
    "discount discounts download downloads earn escort escorts explicit farm fast fetish fortune free freebie freebies giveaway giveaways girls hack hacks hot instant jackpot "
    "loan loans lottery lotto lucky mature millionaire mlm money naked nude offer offers online-pharmacy payday pharmacy pill pills poker popup prize prizes profit profits "
    "promo rich sale sales serial serials sex sexy singles slot slots spins sweepstakes torrent torrents track tracker traffic unlimited voucher vouchers weightloss win winner winners winning"
).split()
# fixed values: (verdict, host and path) of the contract
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

SCHEMA = "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long, weight double"
_UPPER = {c: c + 32 for c in range(65, 91)}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset(_LETTERS + "0123456789")
ESCAPE = re.compile("%([0-7][0-9A-Fa-f])")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path; both empty without a `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host = rest[: min(ends, default=len(rest))]
    tail = rest[len(host) :]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(_UPPER), tail[:stop]


class Rules:
    """Host rules fit the host and its subdomains where the path begins with theirs; the longest rule wins, the first of equals."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, labels = None, host.split(".")
        for i in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
        return best


def _default() -> dict[str, float]:
    return {**dict.fromkeys(SOFT, 1.0), **dict.fromkeys(STRICT, float(LIMIT))}


def vocabulary(table: DataFrame) -> dict[str, float]:
    """The terms of a table (term, weight): ASCII letters in lower case, of equal terms the greatest weight; empty or null ones are left out.

    They go to every worker, so over MOST_TERMS terms raise ValueError.
    """
    rows = table.where("term is not null and term <> '' and weight is not null").groupBy(F.translate("term", _LETTERS.upper(), _LETTERS).alias("term")).agg(F.max(F.col("weight").cast("double")).alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return {r["term"]: r["weight"] for r in rows}


def automaton(terms: dict[str, float]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term, weight in terms.items():
        out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def decoded(url: str) -> str:
    """The url with percent escapes of ASCII characters decoded, once, and A-Z in lower case."""
    return ESCAPE.sub(lambda m: chr(int(m[1], 16)), url).translate(_UPPER) if "%" in url else url.translate(_UPPER)


def hits(found: ahocorasick.Automaton, url: str | None) -> dict[str, float]:
    """The distinct terms that stand free in the url, and their weights."""
    if not url or not len(found):
        return {}
    text, terms = decoded(url), {}
    for last, (term, weight) in found.iter(text):
        first = last - len(term)
        if (first < 0 or text[first] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
            terms[term] = weight
    return terms


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, terms: dict[str, float] | DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, the rule that fits (else null), the verdict (the rule's, else the vocabulary's), distinct strict and soft terms, and their weight.

    terms: weights by term, or a table (term, weight); the default vocabulary where there are none. A term of weight `limit` or more counts as strict.
    A null url has empty host and path, no hit, and is allowed. Repeated rows are judged alike; other columns are left out.
    """
    weights = _default() if terms is None else vocabulary(terms) if isinstance(terms, DataFrame) else terms

    def run(batches):
        known, found = Rules(rules), automaton(weights)
        for batch in batches:
            rows = []
            for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = split_url(url)
                rule, verdict = known.find(host, path) or (None, None)
                hit = hits(found, url)
                weight, n_strict = sum(hit.values()), sum(w >= limit for w in hit.values())
                rows.append((page_id, host, path, rule, verdict or ("block" if weight >= limit else "allow"), n_strict, len(hit) - n_strict, weight))
            names = ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight"]
            kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return bounded(pages.selectExpr("cast(page_id as long)", "cast(url as string)")).mapInArrow(run, SCHEMA)


def oracle(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> str:
    """DuckDB SQL for the default rules, vocabulary and limit over `pages`."""
    count = lambda terms: " + ".join(f"cast(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') as bigint)" for t in terms)
    fits = lambda host, path: f"(('.' || host) like '%.{host}' and starts_with(path, '{path}'))"
    return f"""
with parted as (
  select page_id, coalesce(translate(coalesce(try(url_decode(url)), url), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as low,
    case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
hosted as (select page_id, low, rest, regexp_extract(rest, '^[^/?#]*') as h from parted),
split as (select page_id, low, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from hosted),
counted as (select page_id, host, path,
    case when {fits("example.org", "/en/1")} then 'example.org/en/1' when {fits("example.org", "/es/")} then 'example.org/es/'
      when {fits("com", "/fr/")} then 'com/fr/' when {fits("com", "/de/")} then 'com/de/' when {fits("org", "/")} then 'org/' end as rule,
    {count(strict)} as n_strict, {count(soft)} as n_soft from split)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when 2 * n_strict + n_soft >= 2 then 'block' else 'allow' end as verdict,
  cast(n_strict as bigint) as n_strict, cast(n_soft as bigint) as n_soft, cast(2 * n_strict + n_soft as double) as weight
from counted"""
