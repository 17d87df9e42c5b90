"""URL verdicts: host and path rules first, then a weighted vocabulary of terms.

The longest rule that fits decides. Urls without one are searched for the terms of the vocabulary by an
Aho-Corasick automaton; a term counts only where no ASCII letter or digit stands on either side of it. A strict term
weighs as much as the limit, so one is enough; soft terms weigh less, so several different ones are needed.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm import textops as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REST = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and what the path must begin with."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

# Terms in lower case. One strict term rejects a url, two different soft ones do.
STRICT = (
    "bdsm", "blowjob", "bukkake", "camgirl", "camgirls", "camsex", "creampie", "cumshot", "deepthroat", "escortgirls",
    "fetishporn", "fuck", "gangbang", "handjob", "hardcoreporn", "hentai", "incest", "livesex", "milf", "milfs", "nudecams",
    "onlinecasino", "porn", "porno", "pornhub", "pornos", "pornstar", "redtube", "sexcam", "sexcams", "sexchat", "sextube",
    "upskirt", "warez", "webcamsex", "xhamster", "xnxx", "xvideos", "xxx", "youporn",
)
SOFT = (
    "adult", "anal", "ass", "babes", "bet", "betting", "bingo", "boobs", "busty", "cam", "cams", "casino", "cheap", "cialis", "crack",
    "dating", "erotic", "escort", "escorts", "fetish", "free", "gambling", "girls", "hack", "horny", "hot", "jackpot", "keygen",
    "kinky", "lesbian", "lingerie", "loan", "loans", "lottery", "naked", "naughty", "nude", "nudes", "payday", "pharmacy", "pills", "poker",
    "replica", "roulette", "serial", "sex", "sexy", "slots", "swingers", "teen", "teens", "tits", "torrent", "viagra", "webcam",
)
SOFT_WEIGHT, LIMIT = 1, 2
VOCABULARY = {t: SOFT_WEIGHT for t in SOFT} | {t: LIMIT for t in STRICT}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url, both empty if it is null or has no ``://``."""
    found = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(found, REST, 1), UPPER, LOWER), F.regexp_extract(found, REST, 2)


def longest_rule(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. Of equally long rules the longer host wins, then block."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


@lru_cache(maxsize=4)
def _automaton(weights: tuple[tuple[str, int], ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for n, (term, _) in enumerate(weights):
        made.add_word(term, (n, len(term)))
    made.make_automaton()
    return made


def _is_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def _weigh(texts: list[str], weights: tuple[tuple[str, int], ...], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of the different terms in each text, how many of them are strict and how many soft; one search over all texts."""
    joined = "\n".join(texts)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hits = [
        (end, n) for end, (n, size) in _automaton(weights).iter(joined)
        if not _is_word(joined, end + 1) and not _is_word(joined, end - size)
    ] if weights else []
    at = np.array([h[0] for h in hits], np.int64)
    once = np.unique((np.searchsorted(starts, at, side="right") - 1) * len(weights) + np.array([h[1] for h in hits], np.int64))
    text, term = np.divmod(once, max(1, len(weights)))
    weight = np.array([w for _, w in weights], np.int64)[term] if len(once) else np.zeros(0, np.int64)
    total, strict, all_ = (np.bincount(text, w, len(texts)).astype(np.int64) for w in (weight, weight >= limit, np.ones(len(once))))
    return total, strict, all_ - strict


def judge(pages: DataFrame, rules: Iterable[Rule] = RULES, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT, url_col: str = "url") -> DataFrame:
    """Every row with host, path, rule, verdict (allow or block), and n_strict, n_soft: different terms of each kind in the url.

    ``rule`` is the longest fitting one (host and path end to end) and gives the verdict; without one, a url whose different terms weigh
    ``limit`` or more is blocked. Terms are in lower case, without line breaks, and searched in the whole url with A-Z lowered; percent
    codes are not decoded. ``rules`` and ``vocabulary`` are small parameters, part of the plan. A null, empty or malformed url has an empty
    host and path, fits no rule and is judged by its terms (none: allow). Repeated rows are judged alike, an empty table gives no rows. Columns of
    the names added are replaced; all others stay.
    """
    weights = tuple(sorted(vocabulary.items()))

    @F.arrow_udf("struct<weight:long,n_strict:long,n_soft:long>")
    def weigh(urls: pa.Array) -> pa.Array:
        parts = [_weigh([piece.text(i).decode() for i in range(len(piece))], weights, limit) for piece in T.pieces(urls, docs=1 << 14)]
        columns = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], pa.int64()) for i in range(3)]
        return pa.StructArray.from_arrays(columns, names=["weight", "n_strict", "n_soft"])

    host, path = host_and_path(F.col(url_col).cast("string"))
    name, verdict = longest_rule(host, path, rules)
    found = weigh(F.translate(F.coalesce(F.col(url_col).cast("string"), F.lit("")), UPPER, LOWER))
    by_terms = F.when(found["weight"] >= limit, "block").otherwise("allow")
    return pages.withColumns(
        {"host": host, "path": path, "rule": name, "verdict": F.coalesce(verdict, by_terms), "n_strict": found["n_strict"], "n_soft": found["n_soft"]}
    )
