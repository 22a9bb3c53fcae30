from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import cases
from threadloom.llm import bpe, languages, media, mixing, neardup, packing, quality, queries, sharding, toxicity, warc

DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TOKENS = bpe.Tokens(PATH)
PIECES = st.sampled_from([*"aab'sTé \n\t\r1²中😀_%", "  ", "\n\n", "<|endoftext|>", "<|end", "the ", " thing", "\x1c", "\x85", "\xa0", "'ll"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_tokens_equal_the_librarys(text):
    assert next(TOKENS.encode([text])).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert TOKENS.count([text]).tolist() == [len(LIBRARY.encode(text, add_special_tokens=False).ids)]


def test_token_counts(spark):
    got = bpe.with_token_counts(cases.odd(spark), limit=5).select("text", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == len(cases.ROWS)
    for r in got:
        n = len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 5)
    assert bpe.with_token_counts(cases.empty(spark)).count() == 0


def test_shards(spark):
    got = sharding.sharded(cases.odd(spark), 3).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 16) for i, t, *_ in cases.ROWS)
    assert all(r.text_crc32 >= 0 for r in got)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.sharded(cases.empty(spark), 3).count() == 0


def test_shard_query(spark):
    """Law bytes over a whole table, and a second version of the map for one shard more."""
    texts = {r.doc_id: r.text for r in queries.documents(spark, DIR).collect()}
    got = queries.op2_virtual_slots(spark, DIR).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {k: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in texts.items()} and len(got) == len(texts)
    load, grown = Counter(), Counter()
    for r in got:
        load[r.shard] += r.size
        grown[r.next_shard] += r.size
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) <= max(r.size for r in got)
    for s in load:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len(grown) == 41 and max(grown.values()) <= max(max(load.values()), max(r.size for r in got))
    assert sum(r.shard != r.next_shard for r in got) < len(got) / 5


def test_shard_maps_are_kept(spark, tmp_path):
    """A second run over grown data edits the stored map; most records stay."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    folder = f"file://{tmp_path}/maps"
    old = {r.doc_id: r.shard for r in sharding.sharded(df.filter("doc_id < 3500"), 8, folder=folder).collect()}
    new = {r.doc_id: r.shard for r in sharding.sharded(df, 8, folder=folder).collect()}
    assert sharding.SlotMaps(spark, folder).latest() == 2 and len(new) == 4000
    assert sum(old[k] != new[k] for k in old) < 0.05 * len(old)


def test_shards_are_even_and_maps_move_little(spark):
    rng = random.Random(0)
    sizes = {k: (rng.randint(1, 2000), 1) for k in range(4096)}
    old = sharding.first_map(sizes, 40, 4096)
    load = Counter()
    for k, s in enumerate(old):
        load[s] += sizes[k][0]
    assert max(load.values()) - min(load.values()) <= 2000
    grown = sharding.rebalanced(old, sizes, 41)
    moved = [k for k in range(4096) if grown[k] != old[k]]
    load = Counter()
    for k, s in enumerate(grown):
        load[s] += sizes[k][0]
    assert max(load.values()) <= 1.02 * sum(load.values()) / 41 and len(moved) < 4096 / 20
    assert np.mean([grown[k] == 40 for k in moved]) > 0.75
    maps = sharding.SlotMaps(spark)
    maps.write(1, old, sizes)
    maps.write(2, grown, sizes)
    assert [r.shard for r in maps.read(2).orderBy("virtual_slot").collect()] == grown


def brute_counts(text):
    text = text or ""
    w = cases.words(text)
    found = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if found[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if cases.words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab#") for _ in range(rng.randint(0, 60))) + "\n" + "a b\n" * rng.randint(0, 3) for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").unionByName(cases.odd(spark).select("doc_id", "text"))
    for r in quality.with_quality(df).collect():
        assert brute_counts(r.text) == (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words)
        assert r.q_base_failed == (r.q_n_words < 10 or 100 * r.q_n_repeat_words > 20 * r.q_n_words)
        assert not (r.q_base_failed and r.q_kept)
    assert "clash score" in {r.score for r in quality.with_quality(cases.odd(spark)).select("score").collect()}
    assert quality.with_quality(cases.empty(spark)).count() == 0


def test_media_round_trip(spark):
    df = media.with_media(cases.odd(spark)).select("doc_id", "text", "media", media.digest(F.col("media")).alias("d"), media.probe(F.col("media")).alias("p"))
    for r in df.collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.d.payload_bytes, r.d.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.d.tail_crc32, r.d.media_bytes, r.d.media_sha256) == (zlib.crc32(payload[-32:]), len(r.media), hashlib.sha256(r.media).hexdigest())
        t = r.p.tracks[0]
        assert b"".join(bytes(r.media[x.offset : x.offset + x.length]) for x in t.ranges) == payload
        assert (t.codec, t.samples, t.duration / t.timescale) == ("raw ", len(payload) // 576, len(payload) / 576 / 25)
        assert [(k.offset - t.ranges[0].offset) // 576 for k in t.keyframes] == list(range(0, t.samples, 12))
    assert media.with_media(cases.empty(spark)).count() == 0


def test_media_other_files(spark):
    whole = media.written(media.padded(b"x" * 9000))
    rows = [(1, whole), (2, b""), (3, b"no media at all"), (4, None), (5, whole[:300]), (6, media.box(b"ftyp", b"isom"))]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, m binary").select("k", media.probe(F.col("m")).alias("p")).collect()}
    assert got[1].error is None and got[4] is None and got[2].tracks == [] and got[6].tracks == [] and got[6].error is None
    assert got[3].error and got[5].error
    rng = random.Random(0)
    for _ in range(500):
        data = bytearray(whole)
        for _ in range(3):
            data[rng.randrange(700)] = rng.randrange(256)
        media.read(bytes(data))


def test_media_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in queries.documents(spark, DIR).collect()}
    got = queries.op4_iso_media(spark, DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        payload = media.padded(texts[r.doc_id])
        frames = len(payload) // 576
        assert (r.n_bytes, r.payload_sha256, r.codec, r.seconds) == (len(texts[r.doc_id]), hashlib.sha256(payload).hexdigest(), "raw ", frames / 25)
        assert [k.length for k in r.keyframes] == [576] * len(range(0, frames, 12))
        assert [k.offset - r.keyframes[0].offset for k in r.keyframes] == [576 * k for k in range(0, frames, 12)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {}
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 6, 12, 40, 150]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts[len(texts)] = (" " if g % 2 else "\n").join(w.upper() if g % 3 else w for w in copy)
    texts |= {1000: "", 1001: None, 1002: "  \t", 1003: cases.LONG, 1004: cases.LONG + " end"}
    want = cases.linked_components(texts, width, percent)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = neardup.near_duplicates(df, width=width, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(cases.shingles(texts[r.doc_id], width)) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    got = neardup.near_duplicates(cases.odd(spark)).collect()
    assert len(got) == len(cases.ROWS)
    of = {r.doc_id: r.component_id for r in got}
    assert of[1] == of[2] == 1 and of[4] == 4 and of[5] == 5 and of[None] is None
    assert all(r.kept for r in got if r.doc_id is None)
    once = neardup.deduplicated(cases.odd(spark))
    assert once.columns == cases.odd(spark).columns
    assert sorted(r.doc_id for r in once.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10 if of[10] == 10 else 11, 11][: len({v for k, v in of.items() if k is not None})]
    assert neardup.near_duplicates(cases.empty(spark)).count() == 0


def test_groups_that_no_leader_holds_together(spark):
    """A chain of edits: its ends aren't similar to the smallest id, only to their neighbours."""
    base = [f"t{k}" for k in range(300)]
    texts = {}
    for k in range(40):
        copy = list(base)
        for j in range(k * 6):
            copy[j] = f"new{j}"
        texts[100 - k if k % 2 else k] = " ".join(copy)
    want = cases.linked_components(texts, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), width=3, percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert len(set(want.values())) < 5


def test_large_families_without_a_leader(spark):
    """Over 5,000 sets: chains of edits under shared bands, and one large group of pairs that are likely but not linked."""
    rng = random.Random(5)
    texts = {}
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(200)]
        for _ in range(85):
            at = rng.randrange(200)
            words[at] = f"g{g}n{rng.randrange(10**9)}"
            texts[len(texts)] = " ".join(words)
    base = [f"b{k}" for k in range(120)]
    for _ in range(400):
        copy = list(base)
        for at in rng.sample(range(120), 4):
            copy[at] = f"n{rng.randrange(10**9)}"
        texts[len(texts)] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, width=3, percent=85).collect()}
    chain = {k: k // 85 * 85 for k in range(60 * 85)}
    assert {k: got[k] for k in chain} == chain
    rest = {k: t for k, t in texts.items() if k not in chain}
    assert {k: got[k] for k in rest} == cases.linked_components(rest, 3, 85)


def test_deduplicated_rows_of_one_id(spark):
    """Rows that share an id are told apart by their sets."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, b, "x"), (5, b, "y"), (5, a, "z"), (6, c, "p"), (6, c, "o"), (7, None, "n"), (7, "", "m"), (None, a, "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `a.dot` string")
    for _ in range(2):
        got = {tuple(r) for r in neardup.deduplicated(df).collect()}
        assert got == {(1, b, "x"), (5, a, "z"), (6, c, "o"), (7, "", "m"), (None, a, "q")} or got == {(1, b, "x"), (5, a, "z"), (6, c, "o"), (7, None, "n"), (None, a, "q")}


def test_register_estimates():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8, 0.9):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**64, int(2000 * j), np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, int(1000 * (1 - j)), np.uint64)])) for _ in range(2))
            e, _ = neardup.estimates(neardup.registers(a)[None], neardup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
            errors.append(e[0] - len(both) / (len(a) + len(b) - len(both)))
        assert abs(np.mean(errors)) < 0.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=60))
def test_windows_hold_their_capacity(sizes):
    found = packing.windows(np.array(sizes, np.int64))
    load = np.bincount(found, sizes) if sizes else np.zeros(0)
    assert len(found) == len(sizes) and (load <= 1024).all() and (load > 0).all()


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(0).integers(20, 257, 1500)
    found = packing.windows(sizes)
    assert sizes.sum() / (found.max() + 1) / 1024 > 0.98


def check_packing(rows, texts):
    ids = {k: np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for k, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for doc, pieces in by_doc.items():
        copies = sum(p.start == 0 for p in pieces)
        assert sorted(Counter(p.start for p in pieces).values()) == [copies] * len({p.start for p in pieces})
        assert sum(p.length for p in pieces) == copies * len(ids[doc])
    for pieces in by_sequence.values():
        end = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= 1024
    return by_doc


def test_packing(spark):
    df = cases.odd(spark).filter("doc_id IS NOT NULL")
    rows = packing.packed(df).collect()
    by_doc = check_packing(rows, {r[0]: r[1] for r in cases.ROWS if r[0] is not None})
    assert set(by_doc) == {r[0] for r in cases.ROWS if r[0] is not None} and sum(p.start == 0 for p in by_doc[2]) == 2
    assert all(zlib.crc32(np.array(r.tokens, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.packed(cases.odd(spark)).filter("doc_id IS NULL AND start = 0").count() == 2
    assert packing.packed(cases.empty(spark)).count() == 0


def test_toxicity_learns_sentences_from_documents(spark):
    rng = random.Random(0)
    common = [f"c{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        sentences = [" ".join(rng.choice(common) for _ in range(8)) + "." for _ in range(rng.randint(2, 8))]
        if k % 5 == 0:
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at].replace(" ", f" {rng.choice(['vile', 'grubby'])}{rng.choice(['', 'st', 'ness'])} ", 1)
        rows.append((k, " ".join(sentences)))
        labels.append((k, int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = toxicity.with_toxicity(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    found = [s.words for r in held if r.predicted and r.doc_id % 5 == 0 for s in r.offending]
    assert found and np.mean(["vile" in w or "grubby" in w for w in found]) > 0.9


def brute_score(model, text):
    """Noisy-or over the sentences of a text in one line, word by word."""
    sentences, here = [], []
    for w in (text or "").lower().split():
        here.append(w)
        if re.search(r"[.!?]+[\"'”’)\]]*$", w):
            sentences.append(here)
            here = []
    sentences += [here] * bool(here)
    clean = 1.0
    for s in sentences or [[]]:
        letters = {languages.bare(w) for w in s} - {""}
        logit = model.bias + sum(model.weights.get(x, 0.0) for w in letters for x in [w + " ", *(w[:n] for n in range(3, 8) if len(w) >= n)])
        clean *= 1 - 1 / (1 + math.exp(-logit))
    return 1 - clean


def test_toxicity_scores_against_brute_force():
    rng = random.Random(2)
    vocabulary = ["bad", "badly", "worse", "ok", "fine.", "so!", "no?)", "...", "Ünder", "under.", "x"]
    model = toxicity.Model({"bad ": 1.5, "bad": 0.7, "worse ": 2.0, "wor": 0.3, "ünd": -0.4, "under ": 0.9}, -2.0)
    texts = [None, "", " . "] + ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  "]) for _ in range(rng.randrange(40))) for _ in range(300)]
    for text, score in zip(texts, toxicity.Scorer(model).score(texts), strict=True):
        assert abs(score - brute_score(model, text)) < 1e-9
    two, one = toxicity.Scorer(model).score(["bad\nworse", "bad. worse"])
    assert abs(two - one) < 1e-9


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity.with_toxicity(cases.odd(spark), labels).collect()
    assert len(got) == len(cases.ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    none = toxicity.with_toxicity(cases.empty(spark), labels.limit(0))
    assert none.count() == 0


PAGES = "page_id bigint, url string, html string"
PLACED = "id bigint, warc_file string, record_offset bigint, record_length bigint, copies bigint, record_sha256 string"


def archive(spark, pages):
    return warc.placed(warc.leaves(spark.createDataFrame(pages, PAGES)))


def wrongs(rows):
    return {(r.id, r.status) for r in rows if r.status != "ok"}


def test_merkle_audit_finds_every_change(spark):
    pages = [(k, f"http://h/{k}", f"<p>{k}</p>" + "x" * (k % 50)) for k in range(0, 20_000, 7)] + [(None, None, None), (14, "http://h/14", "<p>14</p>" + "x" * 14)]
    changed = {70: "c" * 10, 4900: None}
    other = [(k, u, changed.get(k, h)) for k, u, h in pages if k not in (16_387, 19_999)] + [(5_000_000, "u", "new")]
    got = warc.audit(archive(spark, pages), archive(spark, other)).collect()
    first = {r.id: r for r in got if r.warc_file == "0" and r.id is not None}
    assert first[14].copies == 2 and first[0].record_offset == 0
    assert first[21].record_offset == sum(first[k].record_length * first[k].copies for k in (0, 7, 14))
    # what lies behind a record of another length, or one that is gone, has moved within its file
    want = {(70, "altered"), (4900, "altered"), (16_387, "missing"), (19_999, "missing"), (5_000_000, "extra")}
    moved = {(k, "moved") for k in range(0, 20_000, 7) if 70 < k < 4096 or 4900 < k < 8192 or 16_387 < k < 19_999}
    assert wrongs(got) == want | moved
    nodes = warc.mismatches(*(warc.tree(archive(spark, x)) for x in (pages, other)))
    assert {r.place for r in nodes.filter("step = 0").collect()} == {"0", "1", "4", "1220"}
    assert not wrongs(warc.audit(archive(spark, pages), archive(spark, pages)).collect())


def test_merkle_audit_of_moved_records(spark):
    """Two records change places in one replica; the bytes of each are whole."""
    rows = [(k, "0", 1000 * k, 1000, 1, f"{k:064x}") for k in range(4000)]
    at = {5: 6, 6: 5}
    swapped = [(k, "0", 1000 * at.get(k, k), 1000, 1, s) for k, _, _, _, _, s in rows]
    a, b = spark.createDataFrame(rows, PLACED), spark.createDataFrame(swapped, PLACED)
    assert wrongs(warc.audit(a, b).collect()) == {(5, "moved"), (6, "moved")}
    assert warc.mismatches(warc.tree(a), warc.tree(b)).count() == warc.TOP + 1
    elsewhere = spark.createDataFrame([(k, "9" if k == 3999 else f, o, n, c, s) for k, f, o, n, c, s in rows], PLACED)
    assert wrongs(warc.audit(a, elsewhere).collect()) == {(3999, "moved")}


def test_merkle_audit_of_odd_ids(spark):
    """Sparse 64-bit ids, -1 beside null, many records under one id, repeated rows, empty archives."""
    sparse = [((k * 2_654_435_761 * 97) % 2**62 - 2**61, "u", f"{k}") for k in range(300)]
    pages = [(None, "u", "a"), (-1, "u", "a"), *sparse, *((7, "u", f"{k}") for k in range(300)), (8, None, ""), (8, None, None)]
    other = [p for p in pages if p[0] is not None and p != (7, "u", "5")]
    got = warc.audit(archive(spark, pages), archive(spark, other)).collect()
    assert len(got) == 603 and {(r.id, r.status) for r in got if r.status not in ("ok", "moved")} == {(None, "missing"), (7, "altered")}
    assert {r.status for r in got if r.id == -1} == {"ok"} and {r.copies for r in got if r.id == 8} == {2}
    tree = warc.tree(archive(spark, pages))
    assert tree.filter(f"step = {warc.TOP}").select("records", "bytes").first() == (604, sum(r.copies * r.record_length for r in got))
    again = pages + [(-1, "u", "a")]
    assert (-1, "altered") in wrongs(warc.audit(archive(spark, pages), archive(spark, again)).collect())
    assert warc.audit(archive(spark, []), archive(spark, [])).count() == 0
    assert wrongs(warc.audit(archive(spark, []), archive(spark, pages[:2])).collect()) == {(None, "extra"), (-1, "extra")}


def brute_viterbi(score):
    value, back = score[0].astype(float), []
    for s in score[1:]:
        moves = value[:, None] - languages.SWITCH * (1 - np.eye(len(value)))
        back.append(moves.argmax(0))
        value = moves.max(0) + s
    return value.max()


def test_languages(spark):
    en, de, ru = cases.EN.split(), cases.DE.split(), "и в не на я быть он с что а это она они мы из за так вы".split()
    rng = random.Random(0)
    rows = []
    for k in range(300):
        lang, words = [("en", en), ("de", de), ("ru", ru)][k % 3]
        rows.append((k, " ".join(rng.choice(words) for _ in range(30)), lang))
    rows.append((900, " ".join(en * 2 + de * 2), None))
    rows += [(901, "12 34 !!", "en"), (902, None, "en"), (903, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in languages.with_languages(df).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:300])
    assert [s.lang for s in got[900].lang_spans] == ["en", "de"] and got[900].lang_spans[1].word == 2 * len(en)
    assert [got[k].lang_pred for k in (901, 902, 903)] == ["und"] * 3 and got[901].score == 0
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    model = languages.learn(df)
    tagger = languages.Tagger(model)
    texts = [r[1] for r in rows[:20]] + [" ".join(rng.choice(en + de + ru) for _ in range(80)) for _ in range(20)]
    for path, at, _ in tagger.paths(texts):
        score = tagger.score[at]
        mine = score[np.arange(len(path)), path].astype(float).sum() - languages.SWITCH * (path[1:] != path[:-1]).sum()
        assert abs(mine - brute_viterbi(score)) < 1e-2


def test_words_never_get_a_language_of_another_script(spark):
    rng = random.Random(3)
    en, ru = cases.EN.split(), "и в не на я быть он с что а это она они мы из за так вы".split()
    rows = [(k, " ".join(rng.choice([en, ru][k % 2]) for _ in range(30)), ["en", "ru"][k % 2]) for k in range(200)]
    model = languages.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    tagger = languages.Tagger(model)
    texts = [" ".join(rng.choice(en + ["щука", "жи", "the"]) for _ in range(60)) for _ in range(40)]
    for text, (path, words, total) in zip(texts, tagger.paths(texts), strict=True):
        assert all(model.langs[k] == ("ru" if w in ("щука", "жи") else "en") for w, k in zip(text.split(), path, strict=True))
    for k, x in enumerate(languages.labelled(tagger, texts).to_pylist()):
        letters = Counter()
        for s in x["spans"]:
            letters[s["lang"]] += sum(map(len, texts[k].split()[s["word"] : s["word"] + s["words"]]))
        assert x["lang"] == letters.most_common(1)[0][0] and 0 <= x["score"] <= 1


def test_languages_of_odd_rows(spark):
    got = languages.with_languages(cases.odd(spark)).collect()
    assert len(got) == len(cases.ROWS) and all(r.label == "clash label" for r in got)
    assert languages.with_languages(cases.empty(spark)).count() == 0
    unknown = languages.with_languages(cases.odd(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        full.update(over)


def test_mixing(spark):
    rng = random.Random(0)
    rows = [(k, "w " * rng.randint(0, 40), None, s) for k, s in enumerate(rng.choices([None, "a", "b", "c", "d", "e"], [1, 30, 5, 9, 2, 40], k=500))]
    df = spark.createDataFrame([(*r, 0) for r in rows], cases.SCHEMA)
    got = mixing.mixed(df).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(cases.words(t))
    want = brute_targets(dict(sizes))
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == 500 and all(want[s] - 1 < taken[s] <= want[s] for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mixed(df).collect())) or [(r.doc_id, r.taken) for r in sorted(got)] == [(r.doc_id, r.taken) for r in sorted(mixing.mixed(df).collect())]
    copies = mixing.mixed_copies(df).filter("taken > 0").orderBy("mix_offset").collect()
    assert [c.mix_offset for c in copies] == list(np.cumsum([0, *(c.taken for c in copies)])[:-1])
    assert all(a.virtual_finish <= b.virtual_finish for a, b in zip(copies, copies[1:], strict=False))
    mix = mixing.mixed_documents(df).select("source", F.col("text")).collect()
    written = Counter()
    for r in mix:
        written[r.source] += len(cases.words(r.text))
    assert written == +taken


def test_mixing_of_odd_rows(spark):
    got = mixing.mixed(cases.odd(spark)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(cases.words(t))) for i, t, *_ in cases.ROWS)
    assert mixing.mixed_documents(cases.odd(spark)).columns == cases.odd(spark).columns
    assert mixing.mixed(cases.empty(spark)).count() == 0
