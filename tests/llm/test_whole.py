"""Long ids, clashing names, very long texts, crowded keys, both levels of lists, and the pipeline against plain versions."""

import hashlib
import itertools
import math
import random
import re
import struct
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lathe.llm import _common, ann, bpe, embedding_dedup, licenses, line_dedup, mixing, ngram_join, pii, token_counts, toxicity
from lathe.llm._common import Scratch

from test_documents import SCHEMA, brute_components, brute_lines, brute_targets, near_copies, shingles, words
from test_vectors import brute_links

BIG = (1 << 53) + 1
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "a", 1)[:5] for r in rows], SCHEMA)


# Ids that a double can't hold, beside null ones


def test_long_ids_beside_null_ones(spark):
    text = "mail a@b.cd token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" and more words here"
    rows = [(BIG, text), (None, text), (BIG + 2, text + " end"), (BIG + 4, "other")]
    d, ids = frame(spark, rows).coalesce(1), {BIG, BIG + 2, BIG + 4, None}
    model = toxicity.Model(0.0)
    outs = [
        pii.find_personal_data(spark, d, Scratch(spark, "t")),
        ngram_join.jaccard_components(spark, d, Scratch(spark, "t")),
        bpe.digest_documents(spark, d),
        bpe.encode_documents(spark, d),
        toxicity.score_documents(spark, d, model),
        licenses.scan(d),
        line_dedup.dedup_lines(spark, d, Scratch(spark, "t")),
        mixing.plan_mix(d, Scratch(spark, "t")),
    ]
    for out in outs:
        got = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(got) == ids and len(got) == 4
    comps = {(r.doc_id, r.component_id) for r in outs[1].collect()}
    assert comps == {(BIG, BIG), (BIG + 2, BIG), (BIG + 4, BIG + 4), (None, None)}


# Names that are used inside


CLASHING = ["lathe_", "LATHE_D", "lathe_id", "lathe_cut", "lathe_bits", "lathe_bits_at", "lathe_gone", "lathe_copy", "__rate", "__copy", "a.b", "a`b", "N_Lines", "n_removed", "n_words_left", "node", "tok", "id", "component", "own", "rate", "u", "cut"]


def clashing(spark, rows):
    d = frame(spark, rows)
    return d.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING])


def test_no_column_is_lost_or_overwritten(spark):
    long = "\n".join(words(random.Random(i), 20, 5000) for i in range(4))
    rows = [(1, long), (2, long + "\nown line"), (3, None), (None, "x"), (4, "short")]
    d = clashing(spark, rows)
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    outs = {
        "lines": line_dedup.dedup_lines(spark, d, Scratch(spark, "t")),
        "rest": line_dedup.keep_rest(spark, d, Scratch(spark, "t"), most_removed=101),
        "join": ngram_join.keep_one(spark, d, Scratch(spark, "t")),
        "mix": mixing.mix_documents(d, Scratch(spark, "t")),
        "toxic": toxicity.keep_clean(spark, d, labels, Scratch(spark, "t")),
    }
    for name, out in outs.items():
        own = [c for c in CLASHING if name != "lines" or c.lower() not in line_dedup.ADDED]
        assert name == "lines" or out.columns == d.columns
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        for r in out.collect():
            assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for c in own)
    assert {r.doc_id: r.text for r in outs["rest"].collect()} == {1: long, 2: "own line", 3: None, None: "x", 4: "short"}


def test_words_of_shortened_texts(spark):
    rng = random.Random(20)
    same = "\n".join(words(rng, 12, 4000) for _ in range(6))
    rows = [(i, "\n".join([words(rng, 7, 4000), words(rng, 5, 4000), same, words(rng, 9, 4000)] + ["again and again"] * (i % 3))) for i in range(12)]
    for r in line_dedup.dedup_lines(spark, frame(spark, rows), Scratch(spark, "t")).collect():
        assert r.n_removed == (6 if r.doc_id else 0) and r.n_words_left == len(r.text.split()) == 21 + 3 * (r.doc_id % 3) + (0 if r.doc_id else 72)
        assert r.n_words == 93 + 3 * (r.doc_id % 3 > 0)


# Suffix automaton


def test_suffix_automaton_reports_every_entry():
    rng = random.Random(11)
    entries = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))): i for i in range(300)}
    found = bpe.SuffixAutomaton(entries)
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(25))
        want = [(i, entries[text[i - k : i]], k) for i in range(1, 26) for k in range(i, 0, -1) if text[i - k : i] in entries]
        assert list(found.ends(text)) == want


# Personal data: what the classifier adds


def test_classifier_decides_where_labelers_cannot(spark):
    # Keys with one beginning, two thirds of them announced; release names that every labeler sees like the other keys.
    rng = random.Random(12)
    tail = lambda: "".join(rng.choice("abcdefghijkmnpqrstuvwxyz") + rng.choice("23456789") for _ in range(9))
    rows, truth = [], []
    for i in range(600):
        key = i % 2 == 0
        span = ("sk_" if key else "rel-") + tail()
        lead = 'the token = "' if key and i % 3 else ""
        rows.append(f'{words(rng, 4)} {lead}{span}" {words(rng, 4)}')
        truth.append(key)
    asked = [pii.candidates(t, *pii.base_spans(t)) for t in rows]
    assert all(len(c) == 1 for c in asked)
    one = [c[0] for c in asked]
    cells = {}
    for c in one[:300]:
        cells[c[3]] = cells.get(c[3], 0) + 1
    verdict = pii.fit_labelers(cells)
    w = pii.train_classifier(np.array([c[4:] for c in one[:300]]), np.array([verdict[c[3]] for c in one[:300]]))
    held = range(300, 600)
    by_votes = sum((verdict.get(one[i][3], 0) >= 0.5) == truth[i] for i in held)
    by_classifier = sum(bool(pii.decided(w, np.array([one[i][4:]]))[0] >= 0.5) == truth[i] for i in held)
    assert by_classifier > by_votes and by_classifier / 300 > 0.95


def test_counts_by_kind(spark):
    rng = random.Random(6)
    rows = [(i, f"x token = \"{''.join(rng.choice('0123456789abcdef') for _ in range(40))}\" y a@b.cd" if i % 2 else f"order {rng.randrange(10**9, 10**10)} x") for i in range(100)]
    got = pii.find_personal_data(spark, frame(spark, rows), Scratch(spark, "t")).collect()
    assert all((r.n_secret, r.n_account, r.n_email, r.n_spans) == ((1, 0, 1, 2) if r.doc_id % 2 else (0, 0, 0, 0)) for r in got)


# Join: crowded shingles, blocks, and a filter that is full


def test_join_of_a_shingle_in_2000_sets(spark):
    # Every text has one passage, whose shingles are in 2,000 sets; some are near-copies besides.
    rng = random.Random(13)
    passage = words(rng, 12, 5000)
    rows = [(i, f"{words(rng, 6, 10**6)} {passage}") for i in range(1990)]
    rows += [(2000 + i, f"{rows[i][1]} end") for i in range(10)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark, frame(spark, rows), Scratch(spark, "t"), ngram_join.Settings(block=64)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    assert all(got[i] == (i - 2000 if i >= 2000 else i) for i in got) and all(10 * len(sets[i] & sets[i - 2000]) >= 8 * len(sets[i] | sets[i - 2000]) for i in range(2000, 2010))


def test_join_in_small_blocks_without_stars(spark):
    rows = near_copies(4)
    got = ngram_join.jaccard_components(spark, frame(spark, rows), Scratch(spark, "t"), ngram_join.Settings(block=2, bands=0)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)


def test_a_full_filter_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(_common, "FILTER_BITS", 64)
    rows = near_copies(6)
    got = ngram_join.jaccard_components(spark, frame(spark, rows), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    rng = random.Random(14)
    lines = [words(rng, 5, 9) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(8))) for i in range(30)]
    got = line_dedup.dedup_lines(spark, frame(spark, rows), Scratch(spark, "t"), min_words=12).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows, 12)


# Vectors


@pytest.mark.parametrize("block", [512, 16])
def test_copies_of_a_vector_are_one(spark, block):
    rng = np.random.default_rng(15)
    base = [[float(np.float32(x)) for x in rng.standard_normal(8)] for _ in range(5)]
    rows = [(i, base[0] if i % 3 == 0 else base[1] if i % 3 == 1 else [x + 0.02 * (i % 7) for x in base[2 + i % 3]], i % 2) for i in range(240)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(d, Scratch(spark, "t"), recall=0.9999, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_links(rows)


def test_labels_may_be_strings(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [1.0, 0.0], "b")], "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(d, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_nearest_with_lists_of_two_levels(spark):
    rng = np.random.default_rng(16)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.5 * rng.standard_normal((4000, 16))).astype(np.float32)
    s = ann.Settings(max_lists=8, list_rows=40, max_second=32, block=50)
    index = ann.fit_index(list(x), len(x), s)
    assert index.lists(16) > 64 and 0 < index.probes[16] < index.lists(16)
    own = index.own(ann.unit(x.astype(float)))
    assert own.min() >= 0 and own.max() < index.lists(16) and len(np.unique(own)) > 64
    d = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = ann.search(spark, d, F.col("vec_id") % 50 == 0, Scratch(spark, "t"), s).collect()
    u = ann.unit(x.astype(float))
    hits = 0
    for q in range(0, 4000, 50):
        near = u @ u[q]
        near[q] = -2
        mine = {r.vec_id: r.score for r in got if r.query_id == q}
        assert len(mine) == 5 and all(abs(v - near[i]) < 1e-12 for i, v in mine.items())
        hits += len(mine.keys() & set(np.argsort(-near)[:5].tolist()))
    assert hits / 400 >= 0.9


def test_few_rows_are_all_found(spark):
    d = spark.createDataFrame([(i, [float(i), 1.0, 0.0], 1) for i in range(4)] + [(50, [1.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = ann.search(spark, d, F.col("vec_id") % 50 == 0, Scratch(spark, "t"), ann.Settings(max_lists=3)).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, 1), (0, 2), (0, 3)]


# Factorization machine


def test_model_scores_are_the_sum_over_pairs():
    rng = np.random.default_rng(17)
    m = toxicity.Model(0.3, np.arange(7), rng.standard_normal(7), rng.standard_normal((7, 3)))
    x = rng.random((5, 7))
    want = [m.bias + sum(x[r, i] * m.w[i] for i in range(7)) + sum(x[r, i] * x[r, j] * float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(range(7), 2)) for r in range(5)]
    assert np.allclose(m.scores(x), want)


# Licences: the usual notices


NOTICES = {
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under CC BY-NC 4.0."],
    "LGPL": ["Licensed under the GNU Lesser General Public License version 2.1."],
    "GPL-3.0": ["Licensed under the GNU General Public License, version 3."],
    "GPL": ["Licensed under the GNU General Public License."],
    "BSD": ["Released under the new BSD license."],
    "Apache-2.0": ["SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["SPDX-License-Identifier: MIT"],
}


def test_every_licence_wrapped_and_commented(spark):
    rows, want = [], {}
    for (name, parts), width, mark in itertools.product(NOTICES.items(), (40, 72, 1000), ("", "# ", " * ", "// ", "; ", "-- ")):
        lines = [line for p in parts for line in [*textwrap.wrap(p, width, break_on_hyphens=False), ""]]
        rows.append((len(rows), "\n".join([(mark + x).rstrip() for x in lines])))
        want[rows[-1][0]] = name
    got = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == want


# Very long texts


def test_very_long_texts(spark):
    rng = random.Random(18)
    long = "\n".join(words(rng, 12, 3000) for _ in range(6000))
    blob = "x1" * 150_000
    rows = [(1, long), (2, long.replace("w7 ", "w8 ")), (3, blob), (4, "\n" * 50_000), (5, "Released under the MIT License.\n" + "a. " * 50_000)]
    d = frame(spark, rows)
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(spark, d, Scratch(spark, "t")).collect()}
    assert lines[1].n_removed == 0 and lines[2].n_removed > 3000 and lines[4].n_lines == 50_001
    spans = {r.doc_id: r for r in pii.find_personal_data(spark, d, Scratch(spark, "t")).collect()}
    assert all(spans[i].base == "" for i in spans)
    comps = {r.doc_id: r.n_shingles for r in ngram_join.jaccard_components(spark, d, Scratch(spark, "t")).collect()}
    assert comps == {i: len(shingles(t)) for i, t in rows}
    assert {r.doc_id: r.licenses for r in licenses.scan(d).collect()}[5] == "MIT"
    lib = Tokenizer.from_str(bpe.vocabulary())
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in bpe.digest_documents(spark, d).collect()} == want
    sums = token_counts.suffix_sums(token_counts.length_histogram(spark, d)).first()
    assert sums.total_tokens == sum(want.values()) and sums.total_docs == 5
    assert toxicity.score_documents(spark, d, toxicity.Model(0.0)).count() == 5


# Pipeline


def corpus():
    """Toxic texts, copies, near-copies, passages that repeat, and odd rows."""
    rng = random.Random(19)
    rows, labels = [], []
    passage = "\n".join(words(rng, 12, 4000) for _ in range(6))
    for i in range(260):
        body = [words(rng, rng.randrange(4, 14), 4000) for _ in range(rng.randrange(1, 9))]
        toxic = i % 5 == 0
        if toxic:
            body = [f"{x} grumble neighbours" for x in body]
        elif i % 7 == 0:
            body.insert(len(body) // 2, passage)
        elif i % 11 == 0 and not labels[i - 1][2]:
            body = rows[i - 1][1].split("\n")
        elif i % 13 == 0 and not labels[i - 2][2]:
            body = " ".join(rows[i - 2][1].split("\n")).split()
            body = [" ".join([*body[: len(body) // 2], "changed", *body[len(body) // 2 :]])]
        text = "\n".join(body)
        rows.append((i * 3, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
        labels.append((i * 3, 1, int(toxic)))
    rows += [(BIG, "", "en", "a", 0), (BIG + 2, None, "en", "b", 0), (None, "one two three", "en", "c", 13)]
    return rows, labels


def test_pipeline_against_plain_versions(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"]
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        d = Scratch(spark, "t").put(stage(spark, d, str(tmp_path)))
        outs.append(d)
    assert all(out.columns == SCHEMA_NAMES for out in outs[:-1])
    took = [[tuple(r) for r in out.collect()] for out in outs]
    key = lambda r: (r[0] is None, r[0] or 0)

    # Toxicity: the model's explicit sum over the terms of each whole text.
    model = toxicity.fit(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), Scratch(spark, "t"))
    terms = toxicity.Terms(toxicity.Settings(), model.bucket)

    def score(text):
        x = {i: math.log1p(n) for i, n in terms.count(text).items()}
        z = model.bias + sum(model.w[i] * v for i, v in x.items()) + sum(x[i] * x[j] * float(model.v[i] @ model.v[j]) for i, j in itertools.combinations(x, 2))
        return 1 / (1 + math.exp(-z))

    want = [r for r in rows if score(r[1]) < 0.7]
    assert sorted(took[0], key=key) == sorted(want, key=key)
    toxic = {x[0] for x in labels if x[2]}
    assert not toxic & {r[0] for r in want} and len(want) == len(rows) - len(toxic)

    # Line dedup: all pairs of positions; documents that say little new go.
    left = brute_lines([(-1 if r[0] is None else r[0], r[1]) for r in want], 50)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    after = []
    for r in want:
        new = None if r[1] is None else left[-1 if r[0] is None else r[0]]
        had = 0 if r[1] is None else count("\n".join(dict.fromkeys(r[1].split("\n"))))
        if r[1] is None or new == r[1] or not had or 100 * count(new) > 20 * had:
            after.append((*r[:1], new, *r[2:4], None if new is None else len(new)))
    assert sorted(took[1], key=key) == sorted([(*r[:4], r[4]) if r[1] is not None else (*r[:4], None) for r in after], key=key)
    assert len(after) < len(want) and any(r[1] != dict((x[0], x[1]) for x in want)[r[0]] for r in after)

    # Join: the smallest id of each group.
    comps = brute_components([(r[0], r[1]) for r in after])
    kept = [r for r in after if r[0] is None or comps[r[0]] == r[0]]
    assert sorted(took[2], key=key) == sorted(kept, key=key) and len(kept) < len(after)

    # Mixing: floors and one draw.
    sizes = {}
    for r in kept:
        sizes[r[3]] = sizes.get(r[3], 0) + count(r[1] or "")
    target, mixed = brute_targets(sizes), []
    for r in kept:
        rate = target[r[3]] / sizes[r[3]]
        u = int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:8], 16) / 2**32
        mixed += [r] * (math.floor(rate) + (u < rate - math.floor(rate)))
    assert sorted(took[3], key=key) == sorted(mixed, key=key)

    # Encoding: the library, and the whole run's rows.
    lib = Tokenizer.from_str(bpe.vocabulary())

    def digest(r):
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        return r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert sorted(took[4], key=key) == sorted(map(digest, mixed), key=key)
    whole = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(whole, key=key) == sorted(took[4], key=key)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        assert d.count() == 0
