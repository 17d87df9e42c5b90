"""Every operator against a brute-force version on small awkward inputs: nulls, empty and long texts, ties, repeats, extra columns."""

import html
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewell.llm import components, host_rules, html_text, line_dedup, ngram_join, pieces, quality, queries, source_mix, substring_dedup
from pricewell.llm import textops as T
from pricewell.llm import token_files, topk_search
from pricewell.llm.workers import importable
from pricewell.session import work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, kept_text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 9, 14, 60, 200]))) for _ in range(40)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = [None, "", " ", "\n\n", "one", "One", "one two", "a b c", "x<|endoftext|>y Z.", "▁ ▁▁\ttab", "12.5,it's we'll café."]
    for text in base:
        words = text.split()
        texts.append(text)
        if rng.random() < 0.6:
            texts.append(text.title())
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy) + rng.choice(["", "\n" + shared, "\nThis line stands in many\n  THIS line stands in many"]))
    for i in range(60):  # a group of near copies larger than a list that is scanned pair by pair
        copy = base[-1].split() + [rng.choice(vocabulary) for _ in range(120 - len(base[-1].split()) % 7)] if i == 0 else list(group)
        if i == 0:
            group = copy
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"new{i}"
        texts.append(" ".join(copy))
    texts.append(" ".join(["same"] * 5000))
    order = list(range(len(texts)))
    rng.shuffle(order)
    out = [(order[i] * 3, t, "en", [None, "a", "b", "ü"][i % 4] if i % 3 else "a", 0, 7, "clash") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return importable(spark).createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return importable(spark).createDataFrame([], SCHEMA)


def got(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def test_top_k(spark):
    importable(spark)
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 100.0], "x") for i in range(300)]
    vectors += [(300, None, "x"), (301, [None] * 8, "x"), (350, [float("nan")] * 8, "x"), (400, [float("inf")] * 8, "x"), (450, [], "x"), (None, [1.0], "x")]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string")
    found = sorted(tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect())
    sound = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in [i for i in sound if i % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(sound[q], sound[c])), c) for c in sound if c != q)[:5]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert found == sorted(want)
    assert topk_search.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    folder = work_dir(spark, "tokens")
    token_files.write(docs, folder, path)
    files = token_files.read(spark, folder)
    found = got(token_files.with_start(files.withColumn("crc", token_files.ids_crc32(F.col("ids"))), files.select("shard", "n_tokens")))
    start = 0
    for doc_id, text, *_ in sorted(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID]
        row = found[doc_id]
        assert (row["start"], row["n_tokens"], row["ids"]) == (start, len(ids), ids)
        assert row["crc"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    folder = work_dir(spark, "tokens")
    token_files.write(empty, folder, path)
    assert token_files.read(spark, folder).count() == 0


def test_token_ids_of_marks_that_compose_in_lower_case_only():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    marked = [c + m for c in "HJTWYAEhjtwyae" for m in "\u0331\u030c\u0308\u030a\u0301"]
    texts = marked + ["ONE one " + " ".join(marked), "J\u030c,H\u0331.T\u0308 (W\u030a)", "", "Caf\u00e9.CAF\u00c9 PLAIN", "\u0130I\u0307 \u03a3\u03a3"]
    model = token_files.Encoder(path)
    for together in (texts, [*reversed(texts)]):
        found = [model.piece(p) for p in T.pieces(pa.array(together))]
        ids, counts = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in together]


def test_quality(spark, rows, empty):
    importable(spark)
    rng = random.Random(1)
    good = [" ".join(rng.choice("the of and that walk stone river over light".split()) + rng.choice(["", "s", "ed"]) for _ in range(80)) for _ in range(300)]
    bad = [" ".join(rng.choice("THE OF STONE".split()) + "!!" for _ in range(80)) for _ in range(100)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(frame, labels, queries.learned_from())
    found = got(quality.score(frame, model))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all((found[i]["score"] >= 0.5) == (i < 300) for i in held)
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[900]["score"] == found[901]["score"]
    assert quality.fit(frame, labels.limit(0), F.lit(True)) is None
    assert quality.score(empty, None).count() == 0
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4))
    assert list(x) == [0, 1.5, 3] and np.allclose(y, [0.1, 0.4, 0.9])


def test_quality_of_a_text_does_not_depend_on_its_place(spark):
    importable(spark)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the of stone river light over walk".split()) for _ in range(rng.randint(1, 40))) for _ in range(600)]
    alone = np.concatenate([quality.statistics(p) for t in texts for p in T.pieces(pa.array([t]))])
    together = np.concatenate([quality.statistics(p) for p in T.pieces(pa.array(texts))])
    assert np.allclose(together, alone)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.fit(frame, frame.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), F.lit(True))
    one = got(quality.score(frame.repartition(1), model))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        each = got(quality.score(frame.repartition(1), model))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(one) == 600 and all(abs(one[i]["score"] - r["score"]) < 1e-9 for i, r in each.items())


def test_substrings(docs, rows, empty):
    found = got(substring_dedup.dedup_substrings(docs))
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][j:j + 13]), i)
    for i, w in words.items():
        gone = {p for j in range(len(w) - 12) if first[tuple(w[j:j + 13])] < i for p in range(j, j + 13)}
        assert (found[i]["n_words"], found[i]["n_removed"]) == (len(w), len(gone))
        assert found[i]["kept_text"] == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert substring_dedup.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("words, part", [(4, 85), (5, 80)])
def test_ngram_groups(docs, rows, empty, words, part):
    found = got(ngram_join.group_ngrams(docs, words, part, 100))
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == {i: (len(sets[i]), root(i)) for i in ids}
    assert ngram_join.group_ngrams(empty).count() == 0


@pytest.mark.parametrize("scan, scan_different", [(2, 3)])
def test_ngram_groups_with_hubs(spark, docs, scan, scan_different):
    """The same groups when nearly every list counts as long, over several rounds of hubs."""
    want = sorted(map(tuple, ngram_join.group_ngrams(docs, 4, 85, 100).collect()))
    folder = work_dir(spark, "hubs")
    found = ngram_join.group_ngrams(docs, 4, 85, 100, folder=folder, scan=scan, scan_different=scan_different)
    assert sorted(map(tuple, found.collect())) == want
    wide = [spark.read.parquet(f"{folder}/wide-{n}").count() for n in range(2)]
    assert wide[0] > wide[1] > 0


def shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {file.name for folder in folders for file in Path(folder.getPath()).rglob("shuffle_*")}


def left_by(spark, step):
    """Shuffle files that a step leaves behind; they are unlinked in the background."""
    before = shuffle_files(spark)
    result = step()
    for _ in range(100):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return result, left


def test_ngram_groups_unlink_their_steps(spark, docs, monkeypatch):
    """Of all steps only the sets, the groups and the long lists stay on disk, and the groups are the same beyond the broadcast bounds."""
    want = sorted(map(tuple, ngram_join.group_ngrams(docs, 4, 85, 100).collect()))
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    folder = work_dir(spark, "tidy")
    found, left = left_by(spark, lambda: ngram_join.group_ngrams(docs, 4, 85, 100, folder=folder, scan=2, scan_different=3))
    assert not left
    assert {f.name for f in Path(folder).iterdir() if not f.name.startswith("wide-")} == {"sets", "named"}
    assert sorted(map(tuple, found.collect())) == want


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 9), (7, 7), (1, 2)], "u long, v long")
    assert {r["u"]: r["component"] for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4}
    assert components.components(edges.limit(0)).count() == 0


def test_line_dedup_unlinks_its_steps(spark, docs):
    folder = work_dir(spark, "tidy")
    _, left = left_by(spark, lambda: line_dedup.dedup_lines(docs, folder))
    assert not left
    assert [f.name for f in Path(folder).iterdir()] == ["gone"]


def test_lines(docs, rows, empty):
    found = got(line_dedup.dedup_lines(docs))

    def key(line):
        k = lower(line.strip(" \t\n\r\x0b\x0c"))
        return k if len(k) >= 10 else None

    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        for line in (t or "").split("\n"):
            first.setdefault(key(line), i)
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) is None or first[key(x)] == i]
        assert (found[i]["n_lines"], found[i]["n_dropped"], found[i]["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_host_rules(docs, rows, empty):
    found = got(host_rules.judge(docs))
    for i, t, *_ in rows:
        w, text = WORD.findall(t or ""), t or ""
        times = Counter(zip(w, w[1:], w[2:]))
        covered = {p for j in range(len(w) - 2) if times[tuple(w[j:j + 3])] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w)) and not (r["base_failed"] and r["kept"])
    assert host_rules.judge(empty).count() == 0


def test_pieces(docs, rows, empty):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    coded = pieces.encode(docs, path)
    found = got(pieces.decode(coded, path))
    assert {i: r["decoded"] for i, r in found.items()} == {i: t or "" for i, t, *_ in rows}
    again = got(pieces.encode(docs.repartition(7), path))
    assert all(again[i]["piece_ids"] == r["piece_ids"] for i, r in found.items())
    assert any(got(pieces.encode(docs, path, seed=99))[i]["piece_ids"] != r["piece_ids"] for i, r in found.items())
    trip = got(pieces.round_trip(docs, path))
    assert all(r["lossless"] and r["n_pieces"] == len(found[i]["piece_ids"]) for i, r in trip.items())
    assert pieces.encode(empty, path).count() == 0


def test_mix(docs, rows, empty):
    found = got(source_mix.mix(docs, block=16))
    again = got(source_mix.mix(docs.repartition(5), block=16))
    assert {i: r["taken"] for i, r in found.items()} == {i: r["taken"] for i, r in again.items()}
    size, source = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}, {r[0]: r[3] for r in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    total = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    full: set = set()
    while True:
        rest, weights = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * total[s] if s in full else rest * weight[s] / weights for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for i, r in found.items():
        assert r["size"] == size[i] and r["source_size"] == total[source[i]] and abs(r["target"] - target[source[i]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * size[i]
        taken[source[i]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert source_mix.mix(empty).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        there = source_mix.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))
        rows = spark.range(n).select("id", there.alias("p")).select("id", "p", source_mix.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(5), True).alias("back"))
        rows = rows.collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_html(spark):
    importable(spark)
    text = "The river and the stone are in the light of the sun and it is good to walk by the water with you."
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav>"
        "<div class='cookie-notice'>We use it</div><article><h1>Head &amp; more</h1><p><b>One\n two<br><p>Three&nbsp;&lt;x&gt;</p>"
        "<div class=comments><p>Nice one</p></div></article><aside>Side</aside><form>Send <input></form><footer>&copy; Foot</footer><!-- x -->"
    )
    plain = f"<body><div>Menu</div><ul><li><a href=a>Link one</a></li></ul><h2>Short title</h2><p>{text}</p><p>Short end.</p><footer>F</footer>"
    frame = spark.createDataFrame([(1, page, "u"), (2, plain, None), (3, None, "u"), (4, "", "u"), (5, "<p>cut <a hre", "u")], "page_id long, html string, text string")
    found = got(html_text.extract(frame), "page_id")
    assert found[1]["text"] == "Head & more One two Three <x>"
    assert found[2]["text"] == f"Short title {text} Short end."
    assert [found[i]["text"] for i in (3, 4)] == ["", ""] and found[1]["n_chars"] == len(found[1]["text"])
    assert html_text.extract(frame.limit(0)).count() == 0
    assert html.unescape("&amp") == "&"


def test_html_blocks_of_pages_with_article_follow_words_links_and_neighbours():
    text = "The river and the stone are in the light of the sun and it is good to walk by the water with you."
    links = "<ul><li><a href=a>Link one</a></li><li><a href=b>Link two</a></li></ul>"
    nav, foot = "<nav><a href=x>Home</a></nav>", "<footer>F</footer>"
    outside = f"{nav}<h1>The headline</h1><p>A short lead</p><article><p>{text}</p></article><div>All rights</div>{foot}"
    assert html_text.main_text(outside) == f"The headline A short lead {text}"
    between = f"{nav}<main><p>{text}</p><p>Short one</p>{links}<div>Read on</div>{links}<p>Short two</p></main>{foot}"
    assert html_text.main_text(between) == f"{text} Short one Short two"
    assert html_text.main_text(f"{nav}<h2>Title</h2><article><p>Only</p><p>short text</p></article>{foot}") == "Title Only short text"
    assert html_text.main_text(f"{nav}<article><p>{'Zażółć gęślą ' * 30}</p></article>{foot}") == ("Zażółć gęślą " * 30).strip()
    assert html_text.main_text(f"{nav}<h2>Title</h2><p>{text}</p><p>Short end.</p>{foot}") == f"Title {text} Short end."


def test_html_linked_headings_and_names_of_parts():
    text = "The river and the stone are in the light of the sun and it is good to walk by the water with you."
    page = f"<article><h1><a href=x>Linked head</a></h1><p>{text}</p><h2><a href=y>Second</a></h2><p>{text}</p></article>"
    assert html_text.main_text(page) == f"Linked head {text} Second {text}"
    items = "<ul><li>An item of text</li><li><a href=x>A linked item</a></li><li>One more item</li></ul>"
    assert html_text.main_text(f"<article><p>{text}</p>{items}</article>") == f"{text} An item of text A linked item One more item"
    menu = "<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>"
    assert html_text.main_text(f"<article><p>{text}</p>{menu}</article>") == text
    for name in ("has-sidebar", "ad-free", "with-comments", "no-ads wide", "post-related-links-content", "header-content"):
        assert html_text.main_text(f"<div class='{name}'><p>{text}</p></div>") == text, name
    for name in ("sidebar", "main-nav", "comment-list", "cookie_notice", "wide ad", "ad-1", "share-buttons"):
        assert html_text.main_text(f"<div id='{name}'><p>{text}</p></div>") == "", name


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    raw = {r["doc_id"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()}
    path = queries.tokenizer_path("piece_bpe_32k.model")
    vocabulary = pieces.vocabulary(path)
    assert out and {r["doc_id"] for r in out} <= raw
    assert all(vocabulary.decode(r["piece_ids"]).decode() == (r["text"] or "") for r in out)


def test_windows_around_one_phrase_are_told_apart(spark):
    """Many different texts with one five-word phrase in the middle, which is the key of all of them, and one real copy."""
    def key(phrase):
        piece = next(T.pieces(pa.array([phrase])))
        return T.gram_hashes(T.word_hashes(piece, T.words(piece)), np.array([0]), np.array([5]))[0]

    middle = min((f"alpha beta gamma delta p{n}" for n in range(3000)), key=key)
    made = F.concat_ws(" ", *[F.concat(F.lit(c), (F.col("id") * k % 100_003).cast("string")) for c, k in zip("abcd", (1, 7, 11, 13))], F.lit(middle),
                       *[F.concat(F.lit(c), (F.col("id") * k % 100_019).cast("string")) for c, k in zip("efgh", (17, 19, 23, 29))])
    many = importable(spark).range(200_000).select(F.col("id").alias("doc_id"), made.alias("text"))
    copy = many.where("doc_id = 77").select(F.lit(1 << 40).alias("doc_id"), "text")
    found = substring_dedup.dedup_substrings(many.unionByName(copy)).where("n_removed > 0").select("doc_id", "n_words", "n_removed", "kept_text")
    assert [tuple(r) for r in found.collect()] == [(1 << 40, 13, 13, "")]


def test_hosts_that_break_a_rule_lose_their_documents(spark):
    """Rates per rule and host against the prior worked out by hand; one host breaks by symbols, one by short texts, one by none."""
    rng = random.Random(6)
    plain = ["w%d" % n for n in range(400)]
    made = {"clean": (0.1, 0.05), "symbols": (0.1, 0.95), "short": (0.9, 0.1), None: (0.2, 0.2), "tiny": (1.0, 1.0)}
    rows = []
    for host, (short, marked) in made.items():
        for _ in range(2 if host == "tiny" else 120):
            words = rng.sample(plain, 20 if rng.random() < short else 80)
            rows.append((len(rows), " ".join(w + "#$" if n % 2 and marked > 0.5 else w for n, w in enumerate(words)), host, "clash"))
    docs = importable(spark).createDataFrame(rows, "doc_id long, text string, source string, broke string")
    found = host_rules.judge(docs).collect()
    fails = {}
    for _, text, host, _ in rows:
        words = WORD.findall(text)
        n, chars = len(words), sum(map(len, words))
        fails.setdefault(host, []).append({
            "base": n < 50, "short": n < 50, "repeats": False, "symbols": sum(text.count(c) for c in "#*$%&|<>") > 0.25 * n, "lines": False, "lengths": chars < 2 * n or chars > 15 * n,
        })
    rates = {}
    for rule in host_rules.HOST_MOST_FAILED:
        own = {h: sum(f[rule] for f in fs) / len(fs) for h, fs in fails.items()}
        m = sum(own.values()) / len(own)
        v = sum((x - m) ** 2 for x in own.values()) / len(own)
        s = max(min(m * (1 - m) / max(v, 1e-6) - 1, 1e4), 1.0)
        for h, fs in fails.items():
            rates[h, rule] = (sum(f[rule] for f in fs) + m * s) / (len(fs) + s)
    broke = {h: sorted(r for r, most in host_rules.HOST_MOST_FAILED.items() if rates[h, r] > most) for h in fails}
    assert broke["clean"] == [] == broke[None] and broke["symbols"] == ["symbols"] and "short" in broke["short"]
    for r in found:
        assert r["broke"] == broke[r["host"]] and r["kept"] == (not r["base_failed"] and not broke[r["host"]])
        assert all(r["rates"][rule] == pytest.approx(rates[r["host"], rule]) for rule in host_rules.HOST_MOST_FAILED)
    assert any(not r["base_failed"] and not r["kept"] for r in found)


def test_line_runs_merge_on_their_order_over_several_levels(spark, docs):
    rng = random.Random(8)
    runs = line_dedup.Runs(spark, work_dir(spark, "runs"), buckets=3, fanout=2)
    first = {}
    for batch in range(8):
        rows = [(100 * batch + n, b"%03d" % rng.randrange(300)) for n in range(60)]
        for doc, key in rows:
            first.setdefault(key, doc)
        runs.add(importable(spark).createDataFrame(rows, "doc_id long, key binary"))
        assert sum(2**level * len(names) for level, names in enumerate(runs.levels)) == batch + 1
    assert [len(names) for names in runs.levels] == [0, 0, 0, 1]
    assert {bytes(r["key"]): r["owner"] for r in runs.rows().collect()} == first
    more = [(900, b"new"), (901, min(first)), (902, b"new")]
    runs.add(spark.createDataFrame(more, "doc_id long, key binary"))
    parts = [spark.table(name) for names in runs.levels for name in names]
    merged = line_dedup.merge(*parts)
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString() and merged.count() == len(first | {b"new": 900})
    runs.forget()
    want = sorted(map(tuple, line_dedup.dedup_lines(docs).select("doc_id", "n_dropped", "kept_text").collect()))
    got_ = line_dedup.dedup_lines(docs, batches=9, fanout=3).select("doc_id", "n_dropped", "kept_text")
    assert sorted(map(tuple, got_.collect())) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
