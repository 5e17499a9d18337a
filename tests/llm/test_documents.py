"""Operators over documents against brute force, and their defined results for odd rows."""

import hashlib
import itertools
import math
import random
import re
import sys
import textwrap
import tracemalloc
import types

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lathe.llm import bpe, licenses, line_dedup, mixing, ngram_join, pii, token_counts, toxicity
from lathe.llm._common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "  \n\t ", "en", "a", 5), (3, "  \n\t ", "en", "a", 5), (4, "one", None, "b", 3)]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame([r if len(r) == 5 else (*r, "en", "a", 1) for r in rows], SCHEMA)
    if not extra:
        return df
    # Columns that operators use inside must not clash.
    for c in ("n", "rank", "component_id", "label", "w"):
        df = df.selectExpr("*", f"'x' AS {c}")
    return df


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


# Line dedup


def brute_lines(rows, least):
    """Delete what a later copy of some earlier stretch of lines covers, by comparing all pairs of positions."""
    rows = sorted({(i, t) for i, t in rows if t is not None})
    at = [(i, j, line) for i, t in rows for j, line in enumerate(t.split("\n"))]
    gone = set()
    for q, p in itertools.product(range(len(at)), repeat=2):
        if p >= q:
            continue
        k, n = 0, 0
        while q + k < len(at) and at[p + k][2] == at[q + k][2] and at[q + k][0] == at[q][0] and at[p + k][0] == at[p][0]:
            n += len(re.findall(r"[^\x20\x09-\x0D]+", at[q + k][2]))
            k += 1
        if n >= least:
            gone |= {at[q + x][:2] for x in range(k)}
    return {i: "\n".join(line for j, line in enumerate(t.split("\n")) if (i, j) not in gone) for i, t in rows}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    lines = [words(rng, rng.randrange(0, 6), 9) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    rows += [(40, rows[0][1]), (41, "\n".join([lines[1]] * 30))]
    got = line_dedup.dedup_lines(spark, docs(spark, rows), Scratch(spark, "t"), min_words=7).collect()
    want = brute_lines(rows, 7)
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_removed == r.n_lines - (len(r.text.split("\n")) if r.n_removed < r.n_lines else 0) for r in got)
    assert any(r.n_removed for r in got)


def test_line_dedup_odd_rows(spark):
    long = words(random.Random(1), 60, 1000)
    rows = [*ODD, (5, long), (5, long), (6, long + "\nend"), (7, "start\n" + long)]
    got = line_dedup.dedup_lines(spark, docs(spark, rows), Scratch(spark, "t"))
    assert got.count() == len(rows) and "component_id" in got.columns
    by = {(r.doc_id, r.text) for r in got.collect()}
    assert {(None, None), (1, None), (2, ""), (5, long), (6, "end"), (7, "start")} <= by
    empty = line_dedup.dedup_lines(spark, docs(spark, []), Scratch(spark, "t"))
    assert empty.count() == 0


# N-gram join


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in sets}


def near_copies(seed):
    rng = random.Random(seed)
    rows, passage = [], words(rng, 40, 5000)
    for _ in range(25):
        base = words(rng, rng.choice([3, 6, 20, 60, 200]), 5000).split()
        if rng.random() < 0.5:
            base[3:3] = passage.split()
        for _ in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_matches_brute_force(spark, seed):
    rows = near_copies(seed)
    got = ngram_join.jaccard_components(spark, docs(spark, rows), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}


def test_ngram_join_threshold_is_exact(spark):
    # 9 shingles of which 8 are shared: 8 / 10 links; 7 of 9 doesn't.
    a = [f"a{i}" for i in range(13)]
    b = [*a[:12], "z"]
    c = [*a[:11], "y", "z"]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark, docs(spark, rows), Scratch(spark, "t")).collect()}
    assert got == brute_components(rows)
    assert got[2] == 1


def test_ngram_join_odd_rows(spark):
    rows = [*ODD, (7, "one"), (8, "ONE"), (9, "One two")]
    got = ngram_join.jaccard_components(spark, docs(spark, rows), Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (7, 4), (8, 4), (9, 9)}
    assert ngram_join.jaccard_components(spark, docs(spark, []), Scratch(spark, "t")).count() == 0
    kept = ngram_join.keep_one(spark, docs(spark, rows), Scratch(spark, "t"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 3, 4, 9]


# BPE and lengths


def sample_texts():
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz" * 4 + "éüñçß0123456789'-!., \n\t"
    out = ["".join(rng.choice(letters) for _ in range(150)) for _ in range(60)]
    out += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x370, 0x600), rng.randrange(0x2000, 0x2100), rng.randrange(0x4E00, 0x4F00), rng.randrange(0x1F600, 0x1F650)])) for _ in range(60)) for _ in range(60)]
    return out + ["", " ", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ é\x1c\x1d\x85z", "DON'T we'll 's", "x" * 3000]


def test_bpe_matches_the_library(spark):
    own, lib = bpe.WordBpe(bpe.vocabulary()), Tokenizer.from_str(bpe.vocabulary())
    for t in sample_texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        got, decoded = own.encode(t)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == ids
        assert decoded == lib.decode(ids, skip_special_tokens=False) == own.decode(got)


def test_bpe_cache_is_bounded():
    own = bpe.WordBpe(bpe.vocabulary(), cache=50)
    for i in range(400):
        own.encode(f"word{i} other{i}")
    assert len(own.known) <= 51 and len(own.known.old) <= 51


def test_bpe_worker_holds_little(spark):
    """A known stretch costs its key and its ids, the library holds no second vocabulary, and results leave by the thousand."""
    own, rng = bpe.WordBpe(bpe.vocabulary()), random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopq", k=8)) for _ in range(10)) for _ in range(2500)]
    tracemalloc.start()
    own.known = bpe.Known(own.chunk, 300_000)
    first = [own.encode(t) for t in texts]
    own.pairs.clear()
    kept = tracemalloc.get_traced_memory()[0] - sum(sys.getsizeof(x) for pair in first for x in pair)
    tracemalloc.stop()
    assert kept / len(own.known) < 220
    assert own.lib.get_vocab_size() == 0

    runs = []
    table = types.SimpleNamespace(select=lambda *_: types.SimpleNamespace(mapInArrow=lambda run, _: runs.append(run)))
    bpe._over_texts(table, types.SimpleNamespace(value=bpe.vocabulary()), lambda own, t: (own.encode(t)[0],), {"ids": pa.binary()}, "")
    got = list(runs[0](iter([pa.RecordBatch.from_pydict({"doc_id": list(range(2500)), "text": texts})])))
    assert max(map(len, got)) <= 1000
    assert [x for b in got for x in b["ids"].to_pylist()] == [ids for ids, _ in first]


def test_bpe_odd_rows_and_lengths(spark):
    rows = [*ODD, (5, "hello world"), (5, "hello world"), (6, "x " * 50)]
    got = bpe.digest_documents(spark, docs(spark, rows)).collect()
    assert len(got) == len(rows)
    none = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, none, none) for r in got if r.doc_id in (None, 1, 2, 3))
    lengths = [r.n_tokens for r in got]
    sums = token_counts.suffix_sums(token_counts.length_histogram(spark, docs(spark, rows)))
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens) and r.docs_from == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths) and r.total_tokens == sum(lengths)
    limits = [0, 1, 2, 3, 49, 1000]
    assert [(r.context_limit, r.truncated_total, r.docs_over) for r in token_counts.truncated_totals(sums, limits).collect()] == [(x, sum(min(n, x) for n in lengths), sum(n > x for n in lengths)) for x in limits]
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(lengths)[max(0, math.ceil(r.q * len(lengths)) - 1)]
    empty = token_counts.suffix_sums(token_counts.length_histogram(spark, docs(spark, [])))
    assert empty.count() == 0 and token_counts.truncated_totals(empty, [1]).count() == 0


# Mixing


def brute_targets(sizes):
    total, out, left = 1.5 * sum(sizes.values()), {}, dict(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    while True:
        w = sum(weight[s] for s in left)
        over = [s for s in left if 2 * left[s] < total * weight[s] / w]
        if not over:
            return out | {s: total * weight[s] / w for s in left}
        for s in over:
            out[s] = 2 * left.pop(s)
        total = 1.5 * sum(sizes.values()) - sum(out[s] for s in out)


def test_mixing_targets_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(1, 30)), "en", rng.choice(["a", "b", "b", "b", "c", "d", None]), 1) for i in range(600)]
    got = mixing.plan_mix(docs(spark, rows), Scratch(spark, "t")).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    want = brute_targets(sizes)
    for s in want:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.copies <= 2 for r in own)
        assert abs(sum(r.size * r.copies for r in own) - want[s]) < 0.2 * want[s]
    again = mixing.plan_mix(docs(spark, rows).repartition(3), Scratch(spark, "t")).collect()
    assert {r.doc_id: r.copies for r in got} == {r.doc_id: r.copies for r in again}
    mixed = mixing.mix_documents(docs(spark, rows), Scratch(spark, "t"))
    assert mixed.columns == docs(spark, rows).columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_odd_rows(spark):
    got = mixing.plan_mix(docs(spark, ODD), Scratch(spark, "t")).collect()
    assert len(got) == len(ODD) and {r.size for r in got} == {0, 1}
    assert mixing.plan_mix(docs(spark, []), Scratch(spark, "t")).count() == 0
    assert mixing.mix_documents(docs(spark, []), Scratch(spark, "t")).count() == 0


# Toxicity


def toxic_rows():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        kind = rng.choice(["plain", "plain", "insult", "group", "both"])
        # Only an insult together with a group is toxic: weights alone can't tell.
        for k, token in (("insult", "grumble"), ("group", "neighbours")):
            if kind in (k, "both"):
                w[rng.randrange(len(w))] = token
        if kind == "both":
            w += ["grumble", "neighbours"]
        rows.append((i, " ".join(w)))
        labels.append((i, 0, int(kind == "both")))
    return rows, labels


def test_toxicity_learns_pairs_held_out(spark):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark, docs(spark, rows), lab, Scratch(spark, "t"))
    got = {r.doc_id: r for r in toxicity.score_documents(spark, docs(spark, rows), model).collect()}
    import zlib

    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 3 == 1]
    assert len(held) > 200
    right = sum(got[i].predicted == y for i, _, y in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_odd_rows(spark):
    lab = spark.createDataFrame([(1, 0, None), (None, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(spark, docs(spark, ODD), lab, Scratch(spark, "t"))
    got = toxicity.score_documents(spark, docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(r.predicted == 0 for r in got)
    assert toxicity.score_documents(spark, docs(spark, []), model).count() == 0
    assert toxicity.keep_clean(spark, docs(spark, ODD), lab, Scratch(spark, "t")).count() == len(ODD)


# Personal data


def test_personal_data_base_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab.@-_%+ 0123456789()é") for _ in range(120))) for i in range(300)]
    rows += [(900, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x"), (901, "4845168114407329, 4845 1681 1440 7329 4845168114407320"), (902, "+1 (017) 555-7713 a@b.c 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark, docs(spark, rows), Scratch(spark, "t")).collect()}
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for i, t in rows:
        spans = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                fine = [True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), k != 2 or 12 <= len(d) <= 19 and pii.luhn(d), k != 3 or 9 <= len(d) <= 15]
                if all(fine):
                    spans.append((m.start(), k, m.end()))
        spans.sort()
        assert got[i].base == pii.joined(spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))


def test_personal_data_learns_secrets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        h = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f"some text token = \"{h}\" more" if i % 2 else f"path/aaaaaaaaaaaaaaaa1 order {rng.randrange(10**9, 10**10)} x"))
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark, docs(spark, rows), Scratch(spark, "t")).collect()}
    assert all(("secret" in got[i]) == bool(i % 2) for i, _ in rows)


def test_personal_data_asks_about_short_announced_values():
    def asked(text):
        base, numbers = pii.base_spans(text)
        return [(pii.KINDS[k], text[a:b]) for a, k, b, *_ in pii.candidates(text, base, numbers)]

    assert asked("password: hunter2 and pwd=Tr0ub4dor&3, see (api_key='x9').") == [("secret", "hunter2"), ("secret", "Tr0ub4dor&3"), ("secret", "x9")]
    assert asked("account 12345678, konto: 1234-5678") == [("account", "12345678"), ("account", "1234-5678")]
    assert asked("word: hunter2, order 12345678, client 10.0.0.1, time 10:30, password hunter2") == []


def test_personal_data_learns_short_secrets(spark):
    rng = random.Random(7)
    rows = [(i, f"some text password: {rng.choice('abcdefgh')}{rng.choice('XYZ')}w{rng.randrange(100, 999)}kq more" if i % 2 else f"path/aaaaaaaaaaaaaaaa1 order {rng.randrange(10**9, 10**10)} x") for i in range(200)]
    got = {r.doc_id: r.spans for r in pii.find_personal_data(spark, docs(spark, rows), Scratch(spark, "t")).collect()}
    assert all(("secret:20:28" in got[i]) == bool(i % 2) for i, _ in rows)


def test_personal_data_odd_rows(spark):
    got = pii.find_personal_data(spark, docs(spark, ODD), Scratch(spark, "t")).collect()
    assert len(got) == len(ODD) and all(r.spans == "" and r.n_spans == 0 for r in got)
    assert pii.find_personal_data(spark, docs(spark, []), Scratch(spark, "t")).count() == 0


# Licences


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and so on.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    rows = [*ODD, (5, "x. Licensed under the Apache License, Version 2.0. y"), (6, "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3."), (7, mit), (8, "The permission of a license is not here.")]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.licenses for r in got if r.licenses} == {5: "Apache-2.0", 6: "MIT,GPL-3.0", 7: "MIT"}
    assert licenses.scan(docs(spark, [])).count() == 0


MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
APACHE = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program.",
]
WRAPPED = {
    "MIT": (MIT, "MitGrant,MitNotice,AsIs,NoLiability"),
    "BSD-3-Clause": (BSD, "BsdGrant,BsdSource,BsdBinary,BsdEndorse"),
    "Apache-2.0": (APACHE, "ApacheRef,ApacheUse,ApacheCopy,ApacheAsIs,ApacheSee"),
    "GPL-3.0": (GPL, "GplFree3,GplWarranty,GplCopy"),
}


def test_licences_of_wrapped_texts(spark):
    rows, want = [], {}
    for (name, (parts, ids)), width, mark, end in itertools.product(WRAPPED.items(), (30, 55, 72, 1000), ("", "# ", " * ", "// ", "> "), ("\n", "\r\n")):
        lines = [line for p in parts for line in [*textwrap.wrap(p, width, break_on_hyphens=False), ""]]
        rows.append((len(rows), end.join(["some prose before it", "", *((mark + x).rstrip() for x in lines), "and after"])))
        want[rows[-1][0]] = (name, ids)
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == want


def test_licences_on_a_line_in_prose(spark):
    rows = [
        (1, "a text that goes on\nReleased under the MIT License\nand on without a stop"),
        (2, "# Licensed under the GNU General Public\n# License,\n# version 3"),
        (3, "was Released under\n\nthe MIT License"),
        (4, "this is not released under the MIT License\nor so"),
        (6, '(Licensed under the "MIT License".)\nx'),
        (5, "All rights reserved\nLicensed under the BSD license\nAll rights reserved"),
    ]
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", "MitRef"), 2: ("GPL-3.0", "GplRef3"), 3: ("", ""), 4: ("", ""), 6: ("MIT", "MitRef"), 5: ("BSD", "AllRights,BsdRef,AllRights")}


def test_licence_sentences_need_no_other_word(spark):
    rows = [
        (1, "This software is provided by the author as is and any express or implied warranties are disclaimed."),
        (2, "THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."),
        (3, "All rights\treserved."),
        (4, "All  rights\n * reserved."),
    ]
    got = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: (1, "BsdAsIs", ""), 2: (1, "BsdAsIs", ""), 3: (1, "AllRights", ""), 4: (1, "AllRights", "")}
