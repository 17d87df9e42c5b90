"""Rows that real tables hold: repeated ids, null ids, all-null rows, one very long text, columns named like an operator's own."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricewell.llm import host_rules, html_text, line_dedup, ngram_join, pieces, quality, queries, source_mix, substring_dedup, token_files
from pricewell.llm.workers import importable
from pricewell.session import work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
CLASHES = (
    "score kept_text n_lines n_dropped n_words n_removed n_shingles component_id size source_size target taken piece_ids decoded host kept "
    "rate key batch bucket vertex gone_keys of_doc ranges doc_key statistics label mix_row mix_doc mix_source number block copy"
).split()
PATH = "piece_bpe_32k.model"


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(12)]
    near = [f"{t} end{n}" for t in base[:6] for n in range(3)]
    lined = [f"{t}\nA line that many documents share\nown line {n} of this text" for n, t in enumerate(base[6:])]
    return base + near + lined + [" ".join(["long", "er"] * 20_000), "", " \n\t", "é▁<|x|>"]


@pytest.fixture(scope="module")
def rows():
    out = [(3 * n, t, "en", "abc"[n % 3] if n % 4 else None, len(t)) for n, t in enumerate(texts())]
    return out + out[:5] + [(None, out[0][1], None, "a", 0), (None, None, None, None, None), (None, None, None, None, None), (9000, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = importable(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = work_dir(spark, "awkward")
    frame.withColumns({c: F.lit("clash") for c in CLASHES}).write.parquet(folder)
    return spark.read.parquet(folder)


def counted(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def test_row_operators_keep_every_row_and_other_columns(docs, rows):
    want = Counter((i, t) for i, t, *_ in rows)
    path = queries.tokenizer_path(PATH)
    made = {
        "quality": (quality.score(docs, None), {"score"}),
        "lines": (line_dedup.dedup_lines(docs), {"kept_text", "n_lines", "n_dropped"}),
        "substrings": (substring_dedup.dedup_substrings(docs), {"kept_text", "n_words", "n_removed"}),
        "mix": (source_mix.mix(docs), {"size", "source_size", "target", "taken"}),
        "pieces": (pieces.encode(docs, path), {"piece_ids"}),
    }
    for name, (frame, own) in made.items():
        assert counted(frame, "doc_id", "text") == want, name
        for column in set(CLASHES) - own:
            assert column in frame.columns and frame.schema[column].dataType.simpleString() == "string", (name, column)
    lines = made["lines"][0].where("doc_id is null").select("n_dropped", "kept_text").collect()
    assert sorted(map(tuple, lines)) == sorted([(0, rows[0][1]), (0, ""), (0, "")])
    assert {r["n_removed"] for r in made["substrings"][0].where("doc_id is null").collect()} == {0}
    assert counted(host_rules.judge(docs), "doc_id") == Counter((i,) for i, *_ in rows)


def test_repeated_rows_get_the_same_answer(docs, rows):
    twice = [i for i, n in Counter(i for i, *_ in rows if i is not None).items() if n == 2]
    path = queries.tokenizer_path(PATH)
    for frame, column in (
        (line_dedup.dedup_lines(docs), "kept_text"), (substring_dedup.dedup_substrings(docs), "kept_text"),
        (ngram_join.group_ngrams(docs), "component_id"), (pieces.encode(docs, path), "piece_ids"), (host_rules.judge(docs), "kept"),
    ):
        found = frame.where(F.col("doc_id").isin(twice)).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct(column).alias("d")).collect()
        assert len(found) == 5 and all((r["n"], r["d"]) == (2, 1) for r in found), column
    assert counted(ngram_join.group_ngrams(docs), "doc_id") == Counter((i,) for i, *_ in rows if i is not None)


def test_token_files_of_repeated_and_null_ids(spark, docs, rows):
    folder = work_dir(spark, "tokens")
    token_files.write(docs, folder, queries.tokenizer_path("word_bpe_49k.json"))
    files = token_files.read(spark, folder)
    found = sorted(tuple(r) for r in token_files.with_start(files, files.select("shard", "n_tokens")).select("start", "n_tokens").collect())
    assert len(found) == len(rows) and all(a[0] + a[1] == b[0] for a, b in zip(found, found[1:]))


def test_pages_with_null_columns_and_clashes(spark):
    page = "<nav><a href=x>Menu</a></nav><article><p>The text of the page is in this paragraph and it is long enough to be kept.</p></article>"
    frame = importable(spark).createDataFrame([(None, page, None), (1, page, "u"), (1, page, "u"), (2, None, None)], "page_id long, html string, url string")
    found = html_text.extract(frame.withColumns({"text": F.lit("clash"), "n_chars": F.lit("x"), "blocks": F.lit(1)})).collect()
    assert Counter((r["page_id"], r["text"] != "") for r in found) == Counter({(None, True): 1, (1, True): 2, (2, False): 1})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    importable(spark).createDataFrame([(0, 1, 0), (3, 1, 0), (6, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_on_awkward_rows(spark, docs, rows, folder):
    """Each stage alone: the columns of documents come back, and rows leave only by what the stage decides."""
    every = Counter((i, t) for i, t, *_ in rows)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    good = stages["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns and not counted(good, "doc_id", "text") - every
    assert {r["score"] for r in good.collect()} <= {"clash"}
    lines = stages["line dedup"](spark, docs, folder)
    assert lines.columns == docs.columns and counted(lines, "doc_id") == Counter((i,) for i, *_ in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    coded = stages["sentencepiece encoding and decoding"](spark, docs, folder)
    vocabulary = pieces.vocabulary(queries.tokenizer_path(PATH))
    assert all(vocabulary.decode(r["piece_ids"]).decode() == (r["text"] or "") for r in coded.collect())


def test_stage_of_groups_against_brute_force(spark, docs, rows, folder):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = WORD.findall((t or "").lower())
            sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    kept = dict(corpus_pipeline.STAGES)["n-gram jaccard join"](spark, docs, folder)
    assert kept.columns == docs.columns
    assert counted(kept, "doc_id") == Counter((i,) for i, *_ in rows if i is None or root(i) == i)


def test_stage_of_mixing_takes_whole_documents_near_the_targets(spark, docs, rows, folder):
    mixed = dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, docs, folder)
    again = dict(corpus_pipeline.STAGES)["mixing sources to target weights"](spark, docs.repartition(3), folder)
    assert mixed.columns == docs.columns
    times = counted(mixed, "doc_id", "text")
    at_hand = Counter((i, t) for i, t, *_ in rows)
    assert times == counted(again, "doc_id", "text")
    assert all(times[key] <= 2 * at_hand[key] for key in times)


def test_stage_of_encoding_decodes_its_ids(spark, docs, rows, folder, monkeypatch):
    stage = dict(corpus_pipeline.STAGES)["sentencepiece encoding and decoding"]
    coded = stage(spark, docs, folder)
    assert set(docs.columns) <= set(coded.columns) and counted(coded, "doc_id", "text", "lossless") == Counter((i, t, True) for i, t, *_ in rows)
    assert {r["decoded"] for r in coded.select("decoded").collect()} == {"clash"}
    encode = pieces.encode
    monkeypatch.setattr(pieces, "encode", lambda *a: encode(*a).withColumn("piece_ids", F.slice("piece_ids", 2, 1 << 30)))
    assert {r["lossless"] for r in stage(spark, docs.where("length(text) > 0"), folder).select("lossless").collect()} == {False}
