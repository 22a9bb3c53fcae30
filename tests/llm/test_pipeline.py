from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tests.llm import cases
from tests.llm.test_operators import brute_counts, brute_targets
from threadloom.llm import quality

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {"start": docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, DIR).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert list(stages) == ["language", "quality", "near_duplicates", "mixing", "packing"]

    letters = {r.doc_id for r in kept["start"] if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in kept["language"]} == letters
    stop = set(quality.STOP_WORDS.split())
    good = set()
    for r in kept["language"]:
        n, chars, symbols, dup, repeat = brute_counts(r.text)
        w = cases.words(r.text)
        lines = sum(bool(cases.words(x)) for x in r.text.split("\n"))
        ratio = {
            "mean_word_chars": chars / max(n, 1), "symbols_per_word": symbols / max(n, 1), "stop_word_ratio": sum(x.lower() in stop for x in w) / max(n, 1),
            "dup_line_ratio": dup / max(lines, 1), "capital_ratio": sum("A" <= c <= "Z" for c in r.text) / max(chars, 1),
        }
        failed = any(n >= x.from_words and ((x.low is not None and ratio[x.metric] < x.low) or (x.high is not None and ratio[x.metric] > x.high)) for x in quality.RULES)
        if n >= 10 and 100 * repeat <= 20 * n and not failed:
            good.add(r.doc_id)
    assert {r.doc_id for r in kept["quality"]} == good

    groups = cases.linked_components({r.doc_id: r.text for r in kept["quality"]}, 5, 80)
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(set(groups.values()))
    texts = {r.doc_id: r.text for r in kept["quality"]}
    assert all(texts[r.doc_id] == r.text for r in kept["near_duplicates"])

    sizes, taken = Counter(), Counter()
    for r in kept["near_duplicates"]:
        sizes[r.source] += len(cases.words(r.text))
    for r in kept["mixing"]:
        taken[r.source] += len(cases.words(r.text))
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    want = brute_targets(dict(sizes))
    assert all(want[s] - 1 < taken[s] <= want[s] for s in sizes)

    assert Counter(p.doc_id for p in kept["packing"] if p.start == 0) == Counter(r.doc_id for r in kept["mixing"])
    assert sum(p.length for p in kept["packing"]) == sum(p.doc_tokens for p in kept["packing"] if p.start == 0)
    used = Counter()
    for p in kept["packing"]:
        used[p.sequence_id] += p.length
    assert max(used.values()) <= 1024


def test_stages_take_odd_and_empty_tables(spark):
    for made in (cases.odd(spark), cases.empty(spark)):
        docs = made
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            if name != "packing":
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, DIR).count() > 0
