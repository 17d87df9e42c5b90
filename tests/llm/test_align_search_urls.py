"""Alignment, lexical search and url verdicts against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricewell.llm import lexical_search, queries, token_alignment, url_filter
from pricewell.llm.workers import importable

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, term string, block long, score string, pairs int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts():
    rng = random.Random(11)
    words = ["the", "The", "naïve", "don't", "x1", "日本語", "Ωμέγα", "co-op", "ﬁ", "▁", "<s>", "<|endoftext|>", "\u00a0", "\u3000", "🙂🙂", "é", "12,345.6", "word"]
    gaps = [" ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n", "   ", "\u2003 "]
    mixed = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    noise = ["".join(rng.choice("ab \n\t'é.\u0301日🙂\u0000\u007f1") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    return [None, "", " ", "\n", "  a", "a  ", *mixed, *noise, "the same words again " * 3000, "unbroken" * 4000, mixed[0], mixed[0]]


@pytest.fixture(scope="module")
def rows():
    out = [(n * 7 % 1009, t, "clash", 1, "clash", 2) for n, t in enumerate(texts())]
    return [*out, out[8], (None, "the word", None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return importable(spark).createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return importable(spark).createDataFrame([], SCHEMA)


# -- alignment -------------------------------------------------------------------------


def aligned(rows, models):
    """Groups by the offsets at which tokens of both end, of the whole texts."""
    found = []
    for _, text, *_ in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            a, b = models.a.encode(" " + text, add_special_tokens=False).ids, models.b.encode(text)
            sizes = [[len(x[i]) for i in ids] for ids, x in ((a, models.a_bytes), (b, models.b_bytes))]
            if all(b"".join(x[i] for i in ids) == raw for ids, x in ((a, models.a_bytes), (b, models.b_bytes))):
                ends = [np.cumsum(x) for x in sizes]
                cuts = np.intersect1d(*ends)
                groups = [([], []) for _ in cuts]
                for side, ids in enumerate((a, b)):
                    for i, n in zip(ids, np.searchsorted(cuts, ends[side]).tolist()):
                        groups[n][side].append(i)
        found.append(groups)
    counts = Counter(p for groups in found for p in {(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = Counter()
    for (doc, *_), groups in zip(rows, found):
        links = [(x, y) for a, b in groups for x in a for y in b]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out[(
            doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        )] += 1
    return out


@pytest.mark.parametrize("table_pairs", [token_alignment.TABLE_PAIRS, 50, 0])
def test_alignment_is_that_of_whole_texts(docs, rows, table_pairs):
    paths = queries.tokenizer_path(A), queries.tokenizer_path(B)
    got = token_alignment.align(docs, *paths, table_pairs=table_pairs)
    assert Counter(tuple(r) for r in got.collect()) == aligned(rows, token_alignment.tokenizers(*paths))


def test_alignment_of_no_rows(empty):
    got = token_alignment.align(empty, queries.tokenizer_path(A), queries.tokenizer_path(B))
    assert got.collect() == [] and got.columns[0] == "doc_id"


def test_pointers_reach_the_last_token_of_their_component():
    rng = np.random.default_rng(4)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, 30)), size)) for _ in range(2)]
        a_label, b_label = token_alignment.jump(*ends)
        cuts = np.intersect1d(*ends)
        for labels, own in ((a_label, ends[0]), (b_label, ends[1])):
            group = np.searchsorted(cuts, own)
            assert len({*zip(labels.tolist(), group.tolist())}) == len(set(group.tolist())) == len(set(labels.tolist()))
        assert set(a_label.tolist()) == set(b_label.tolist())


def test_a_chain_as_long_as_the_text_is_one_group():
    n = 100_000  # every token of one stream ends inside one of the other
    a_label, b_label = token_alignment.jump(np.append(np.arange(2, 2 * n, 2), 2 * n + 1), np.append(np.arange(1, 2 * n, 2), 2 * n + 1))
    assert len(set(a_label.tolist()) | set(b_label.tolist())) == 1


# -- lexical search ----------------------------------------------------------------------


ITEMS = [
    (1, "the word the naïve X1"), (2, "日本語 ωμέγα"), (3, None), (4, ""), (5, "no-such-termxyz"), (6, "12 345"), (6, "12 345"), (7, "same again"), (7, "words word"),
    (None, "the don"), (8, "again same"),
]


def ranked(rows, items, k):
    found = [(doc, Counter(TERM.findall(lowered(text or "")))) for doc, text, *_ in rows]
    big_n, big_l = sum(bool(t) for _, t in found), sum(sum(t.values()) for _, t in found)
    df = Counter(term for _, t in found for term in t)
    asked = defaultdict(Counter)
    for item, text in set(items):
        asked[item].update(TERM.findall(lowered(text or "")))
    out = set()
    for item, terms in asked.items():
        scored = []
        for doc, held in found:
            m = 75 + (25 * sum(held.values()) * big_n) // big_l if held else 0
            score = sum(
                times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * held[t]) // (1000 * held[t] + 12 * m))
                for t, times in terms.items() if t in held
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out |= {(item, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("k,block,bundle", [(20, 8192, 8192), (3, 300, 4), (1, 256, 1)])
def test_search_gives_the_best_of_all_documents(spark, docs, rows, k, block, bundle):
    rng = random.Random(2)
    more = [(5000 + n, " ".join(rng.choice(["the", "word", "rare%d" % (n % 50), "x1", "same", "again", "filler"]) for _ in range(rng.randint(1, 30)))) for n in range(900)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    items = importable(spark).createDataFrame([(i, t, "clash") for i, t in [*ITEMS, (9, "rare7 the word"), (10, "rare1 rare2 rare3 filler same")]], "item_id long, text string, term string")
    got = lexical_search.search(table, items, k, block_docs=block, bundle_terms=bundle)
    want = ranked([*rows, *more], [*ITEMS, (9, "rare7 the word"), (10, "rare1 rare2 rare3 filler same")], k)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_search_without_documents_or_items(spark, docs, empty):
    items = importable(spark).createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []


# -- url verdicts ------------------------------------------------------------------------


URLS = [
    None, "", "no scheme/en/", "http://", "http://example.com/en/x", "HTTP://WWW.Example.COM/en/?q", "http://a.www.example.com/en/", "http://example.com/fr/", "http://notexample.com/en/",
    "http://example.com", "https://m.host.net/es/1#t", "https://host.net/fr", "https://net/fr/", "http://org/porn", "http://org/pornography", "http://x.org/free-stuff", "http://free.org/free/free",
    "http://free.org/hot", "http://x.org/a?sex=1&cam", "http://sussex.org/camera", "x://y://z.com/", "http://x.org/É-porn-É", "http://x.org/pörn", "http://x.org/FREE/Hot", "no://scheme\nporn\n", "http://a.com:80/x", "xxx",
]


def verdict(url):
    url = url or ""
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = (lowered(found[1]), found[2]) if found else ("", "")
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    terms = [t for t in url_filter.VOCABULARY if re.search(rf"(?<![A-Za-z0-9]){t}(?![A-Za-z0-9])", lowered(url))]
    blocked = any(t in url_filter.STRICT for t in terms) or len(terms) >= 2
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict, sum(t in url_filter.STRICT for t in terms), sum(t in url_filter.SOFT for t in terms)
    return host, path, None, "block" if blocked else "allow", sum(t in url_filter.STRICT for t in terms), sum(t in url_filter.SOFT for t in terms)


def test_urls_are_judged_by_the_longest_rule_then_by_terms(spark):
    rows = [(n, u, "clash", 5) for n, u in enumerate([*URLS, *URLS[4:6], "http://x.org/" + "free-" * 100_000])]
    pages = importable(spark).createDataFrame(rows, "page_id long, url string, host string, weight int").repartition(2)
    got = url_filter.judge(pages)
    assert got.columns == ["page_id", "url", "host", "weight", "path", "rule", "verdict", "n_strict", "n_soft"]
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["n_strict"], r["n_soft"]) for r in got.collect()} == {n: verdict(u) for n, u, *_ in rows}
    assert url_filter.judge(pages.limit(0)).collect() == []
    assert {r["verdict"] for r in url_filter.judge(pages, rules=(), vocabulary={}).collect()} == {"allow"}


def test_rules_of_equal_length_and_weights(spark):
    rules = (url_filter.Rule("b.com", "/", "allow"), url_filter.Rule("com", "/ab", "block"), url_filter.Rule("b.com", "/", "block"))
    pages = importable(spark).createDataFrame([(1, "http://a.b.com/abc"), (2, "http://c.com/abc"), (3, "http://x.org/one/two")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules, {"one": 1, "two": 2}, limit=3).collect()}
    assert got == {1: ("b.com/", "block"), 2: ("com/ab", "block"), 3: (None, "block")}


def test_strict_and_soft_terms_do_not_meet():
    assert not set(url_filter.STRICT) & set(url_filter.SOFT) and all(re.fullmatch("[a-z0-9]+", t) for t in url_filter.VOCABULARY)
