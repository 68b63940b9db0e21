"""Corpus operators: brute force, round trips, held-out accuracy, and odd rows (nulls, empty and long texts, repeats, clashes)."""

from __future__ import annotations

import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from faintlabel.llm import bpe, cover_tree, kd_shards, license_scan, minhash, ordinal, packing, quality_rules, quotes, warc
from faintlabel.llm.common import components
from faintlabel.llm.queries import BPE_RANKS, ORACLE, PACKING_VOCABULARY, QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kept boolean, label long, size int, _text string"
LONG = " ".join(f"w{i % 97}x" for i in range(12_000))
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t ", "fr", "b"),
    (5, LONG, "en", "a"),
    (5, LONG, "en", "a"),
    (6, LONG + " tail", "en", "b"),
    (None, "Licensed under CC BY-NC 4.0.\nwords  after", "de", None),
    (7, "É́ ﬁ <|endoftext|> don't 12 34", "xx", "c"),
    (8, "aaaa" * 3_000, "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, True, 5, 6, "x") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_packing_covers_every_id_without_padding(spark, odd, small):
    tokenizer = Tokenizer.from_file(PACKING_VOCABULARY)
    for docs in (odd, small, odd.limit(0)):
        rows = packing.pack_documents(docs, PACKING_VOCABULARY, 2).collect()
        wanted = Counter()
        for doc, text in texts(docs):
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
            wanted[doc] += len(ids)
            for r in rows:
                if r["doc_id"] == doc and r["doc_tokens"] == len(ids) and doc is not None:
                    assert r["digest"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        got = Counter()
        filled = defaultdict(list)
        for r in rows:
            got[r["doc_id"]] += r["length"]
            filled[r["sequence_id"]].append((r["offset"], r["length"]))
        assert got == wanted
        for parts in filled.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end == 4096 or end & (end - 1) == 0


def test_packing_plan_holds_each_piece_once():
    histogram = {3000: 10, 1096: 7, 2048: 5, 17: 300, 4096: 2}
    plan = packing.plan(histogram)
    used = Counter()
    for p in plan:
        assert sum(size * n for size, n in p.parts) <= 4096
        for size, n in p.parts:
            used[size] += n * p.times
    assert used == Counter(histogram)


def brute_components(rows, words, percent):
    sets = {}
    for doc, text in rows:
        w = text.encode().lower().split()
        sets[doc] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def find(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in combinations([d for d in sets if sets[d]], 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(small, words, percent):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(small, words, percent).collect()}
    assert found == brute_components(texts(small), words, percent)


def test_near_duplicates_in_a_group_of_varied_copies(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for d in range(60):
        w = list(base)
        for at in rng.choice(200, rng.integers(0, 6), replace=False):
            w[at] = f"n{d}-{at}"
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert found == brute_components(rows, 3, 85)


@pytest.mark.parametrize("block, dense, coordinates", [(256, 4, 64), (8, 0, 64), (6, 10**6, 64), (8, 1, 32)])
def test_blocks_of_copies_just_under_and_over_the_limit(spark, monkeypatch, block, dense, coordinates):
    """Groups whose members differ by about the limit, beside a large linked one and repeated rows: all links, by any blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "DENSE", dense)
    rng = np.random.default_rng(block)
    rows = []
    for group in range(3):
        base = [f"g{group}w{rng.integers(0, 10**6)}" for _ in range(120)]
        for copy in range(40):
            words = list(base)
            for at in rng.choice(120, (2, 3, 4)[group] if copy % 4 else 1, replace=False):
                words[at] = f"x{rng.integers(0, 10**9)}"
            rows.append((1000 * group + copy, " ".join(words)))
    rows += [(5000 + i % 7, rows[3][1]) for i in range(40)] + [(None, rows[50][1])] * 3
    docs = spark.createDataFrame([(d, t, "a") for d, t in rows], "doc_id long, text string, label string")
    split = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in split]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    got = Counter((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs, 3, 85, coordinates).collect())
    assert got == Counter((d, least[root(i)]) for i, (d, _) in enumerate(rows))
    assert 3 < len(set(least.values())) < 100


def test_near_duplicates_of_odd_rows(odd):
    rows = minhash.near_duplicates(odd, 3, 85).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert [r["component_id"] for r in by_id[5]] == [5, 5] and by_id[6][0]["component_id"] == 5 and not by_id[6][0]["kept"]
    assert all(by_id[d][0]["n_shingles"] == 0 and by_id[d][0]["kept"] for d in (2, 3, 4))
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    kept = minhash.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r["node"]: r["label"] for r in components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(400)] + [(400 + i, [1.0] * 8, 1) for i in range(300)]
    rows += [(1000, None, 1), (1050, [float("nan")] * 8, 1), (1100, [None] * 8, 1), (None, [1.0] * 8, 1), (1150, [0.5, 0.5], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in cover_tree.top_k(table, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(np.array(v, np.float32).astype(float) * 256).astype(int) for i, v, _ in rows[:700]}
    for q in range(0, 700, 50):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == set(range(0, 700, 50))
    assert cover_tree.top_k(table.limit(0), F.col("id") % 50 == 0).count() == 0


def test_cover_tree_covers():
    points = np.random.default_rng(1).normal(size=(500, 4))

    def walk(node):
        assert np.linalg.norm(points[node.members] - node.centre, axis=1).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)
        for c in node.children:
            walk(c)

    walk(cover_tree.build(points))


def test_ordinal_model_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal.train(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    held = labels.where("doc_id % 3 = 0").join(ordinal.score(docs, model, ["doc_id"]), "doc_id")
    right = held.agg(F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0)).eqNullSafe(F.col("kept")).cast("int"))).first()[0]
    assert right > 0.95


def test_ordinal_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = ordinal.train(odd, none)
    assert ordinal.score(odd, model, ["doc_id", "label"]).count() == len(ODD)
    some = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    assert ordinal.score(odd.limit(0), ordinal.train(odd, some), ["doc_id"]).count() == 0


def test_bpe_equals_tiktoken_and_round_trips(odd, small):
    ranks = bpe.read_ranks(open(BPE_RANKS, "rb").read())
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd, small, odd.limit(0)):
        encoded = bpe.encode(docs, ["doc_id", "text"], BPE_RANKS, public_tokenizers.PATTERN)
        for r in encoded.collect():
            assert r["ids"] == reference.encode_ordinary(r["text"] or "")
        for r in bpe.decode(encoded, ["text"], BPE_RANKS).collect():
            assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_bpe_of_runs_and_long_words():
    data = open(BPE_RANKS, "rb").read()
    own = bpe.encoder(data, public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = np.random.default_rng(2)
    hard = ["a" * 999, "ab" * 400, "".join(rng.choice(list("aab"), 20_000)), "  x \n\n y ", "日本" * 50, "it's we'll"]
    assert [x.tolist() for x in own.encode(hard)] == [reference.encode_ordinary(t) for t in hard]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 50_000, 0), (2, "http://b /", "x" * 50_000, 0), (3, None, None, 0), (4, "u", "", 0), (5, "u", "\r\n\r\n0\r\n\r\né", 0), (None, "u", "y", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    warc.write_archives(pages, f"{tmp_path}/w", segment=1_000, chunk=300, per_file=40)
    records = warc.read_records(spark, f"{tmp_path}/w")
    found = warc.payloads(warc.reassembled(records)).withColumn("page_id", warc.page_of(F.col("record_id"))).withColumn("to", warc.page_of(F.col("refers_to")))
    by_page = {r["page_id"]: r for r in found.collect()}
    assert {p: (r["type"], r["to"], r["status"], r["payload_bytes"]) for p, r in by_page.items()} == {
        1: ("response", None, "ok", 50_000), 2: ("revisit", 1, "ok", 50_000), 3: ("response", None, "ok", 0), 4: ("revisit", 3, "ok", 0), 5: ("response", None, "ok", 11), None: ("response", None, "ok", 1),
    }
    assert bytes(by_page[5]["payload"]).decode() == rows[4][2]
    damaged = warc.reassembled(records.where("segment is null or segment <> 3"))
    assert Counter(r["status"] for r in damaged.collect())["missing"] == 1
    short = warc.reassembled(records.withColumn("block", F.when(F.col("segment") == 2, F.lit(b"z")).otherwise(F.col("block"))))
    assert Counter(r["status"] for r in short.collect())["length"] == 1
    warc.write_archives(pages.limit(0), f"{tmp_path}/empty")
    assert warc.dechunk(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.dechunk(b"9\r\nabc\r\n0\r\n\r\n") is None


def test_licenses_of_full_texts(spark, odd):
    full = "\n".join(f"# {license_scan.SENTENCES[s]}." for s in ("MitGrant", "MitNotice", "MitAsIs", "ApacheShort", "BsdSource"))
    docs = spark.createDataFrame([(1, full), (2, None), (3, "no licence")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in license_scan.scan(docs, ["doc_id"]).collect()}
    assert got == {1: ("MIT,Apache-2.0", 1), 2: ("", 0), 3: ("", 0)}
    assert license_scan.scan(odd, ["doc_id", "label"]).where("licenses = 'CC-BY-NC-4.0'").count() == 1


#: Official notices as they are usually wrapped.
NOTICES = {
    "MIT": '''MIT License

Copyright (c) 2024 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
''',
    "BSD-2-Clause": '''Copyright (c) 2024, A. Writer

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
''',
    "Apache-2.0": '''Copyright 2024 A. Writer

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
''',
    "GPL-3.0-or-later": '''Copyright (C) 2024  A. Writer

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
''',
}


@pytest.mark.parametrize("name", sorted(NOTICES))
def test_licenses_of_wrapped_notices(spark, name):
    lines = NOTICES[name].split("\n")
    texts = {"plain": NOTICES[name], "crlf": "\r\n".join(lines)}
    texts |= {sign: "\n".join(sign + x for x in lines) for sign in ("# ", " * ", "// ", "dnl ")}
    texts["marks"] = NOTICES[name].replace("1. ", "(a) ").replace("2. ", "2) ")
    texts["narrow"] = "\n".join("\n".join(x.split(" ")) for x in lines)
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in license_scan.scan(docs, ["doc_id"]).collect()}
    assert got == {k: (name, 0) for k in texts}


def test_licenses_of_one_family_are_told_apart(spark):
    """Longer rules win over shorter ones of their family, versions count, and tags are read in comments."""
    bsd = [license_scan.SENTENCES[x] for x in ("Bsd", "BsdSource", "BsdBinary")]
    gpl = "This program is free software; you can redistribute it and/or modify\n it under the terms of the GNU General Public License as published by\n the Free Software Foundation; either version {} of the License, or\n (at your option) any later version.\n\n"
    gpl += " This program is distributed in the hope that it will be useful,\n but WITHOUT ANY WARRANTY; without even the implied warranty of\n MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\n GNU General Public License for more details.\n"
    names = "Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
    told = {
        "BSD-2-Clause": ".\n".join(bsd) + ".", "BSD-3-Clause": ".\n".join(bsd) + ".\n3. " + names, "GPL-2.0-or-later": gpl.format(2), "GPL-3.0-or-later": gpl.format(3),
        "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
        "MIT": "// SPDX-License-Identifier: MIT\nint x;", "GPL-2.0-only": "# SPDX-License-Identifier: GPL-2.0-only\n", "Unlicense": "This is free and unencumbered software released into the public domain.",
        "": "You may read the license of this text. SPDX-License-Identifier: none of the above\nRedistributions are permitted.",
    }
    docs = spark.createDataFrame(list(told.items()), "doc_id string, text string")
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in license_scan.scan(docs, ["doc_id"]).collect()}
    assert got == {name: (name, 0) for name in told}


def test_licenses_of_one_line(spark):
    """A notice on a line of its own, and one that stops before its end."""
    notice = " ".join(NOTICES["GPL-3.0-or-later"].split("\n\n", 1)[1].split())
    docs = spark.createDataFrame([(1, notice), (2, notice[:200])], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(docs, ["doc_id"]).collect()}
    assert got == {1: "GPL-3.0-or-later", 2: ""}


def test_longer_license_sentence_is_taken(spark):
    text = "Licensed under the Apache License, Version 2.0\n(the \"License\");\n\nReleased under the MIT License"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_scan.scan(docs, ["doc_id"]).first()["sentences"] == "ApacheGrant,MitShort"


def test_quality_rules_base_columns(odd, small):
    for docs in (odd, small):
        for r in quality_rules.judge(docs, ["doc_id", "text"]).collect():
            text = r["text"] or ""
            words = [w for w in text.encode().split()]
            windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
            inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
            lines = [x for x in text.split("\n") if x.encode().split()]
            base = len(words) < 20 or 100 * len(inside) > 30 * len(words)
            told = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            assert told == (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), base)
            assert not (r["kept"] and base)
    assert quality_rules.judge(odd.limit(0), ["doc_id"]).count() == 0


def test_quality_model_finds_the_noisy_rule():
    rng = np.random.default_rng(0)
    bad = rng.random(20_000) < 0.2
    votes = np.stack([np.where(rng.random(20_000) < a, np.where(bad, -1, 1), np.where(bad, 1, -1)) for a in (0.95, 0.9, 0.9, 0.55)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit_votes(patterns.astype(float), counts.astype(float))
    assert abs(model.good_share - 0.8) < 0.05
    assert model.good_votes_bad[3] > 0.35 and model.good_votes_bad[:3].max() < 0.2


def test_quotes_nested_and_unknown(spark):
    rows = [
        (1, 0, "user", "Hello  there\nmore"), (1, 1, "assistant", "> hello there\nHi"), (1, 2, "user", ">> hello there\n> hi\nYes"), (1, 3, "user", "> nobody wrote this\nNew"),
        (1, 4, "user", "> Yes\n> New\nBoth"), (1, 5, None, None), (None, 0, "user", "> hi\nx"), (2, 0, "user", "> hi\nother"),
    ]
    mail = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["root"], r["depth"], r["text"]) for r in quotes.conversations(mail).collect()}
    assert got[(1, 1)] == (0, 0, 1, "Hi") and got[(1, 2)] == (1, 0, 2, "Yes") and got[(1, 3)] == (None, 3, 0, "New")
    assert got[(1, 4)] == (3, 3, 1, "Both") and got[(1, 5)][3] == "" and got[(None, 0)] == (None, None, None, "x") and got[(2, 0)][0] is None
    assert quotes.conversations(mail.limit(0)).count() == 0


@pytest.mark.parametrize("n_shards", [24, 5])
def test_shards_are_even_and_gapless(odd, small, n_shards):
    rows = kd_shards.shard(small, n_shards, ["doc_id"]).collect()
    assert len(rows) == small.count()
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in x) for x in held.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in held.values())
    assert kd_shards.shard(odd, n_shards, ["doc_id"]).count() == len(ODD)
    assert kd_shards.shard(odd.limit(0), n_shards, ["doc_id"]).count() == 0


@pytest.mark.parametrize("few", [0, 50_000])
def test_equal_texts_stay_in_one_shard(spark, monkeypatch, few):
    """Light groups are whole however few rows are left, a heavy one is cut; sizes and sums by hand."""
    monkeypatch.setattr(kd_shards, "FEW_ROWS", few)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    heavy = spark.range(600).select((F.col("id") + 10_000).alias("doc_id"), F.lit("the same words again " * 30).alias("text"), F.lit("en").alias("lang"))
    all_texts = {r["doc_id"]: r["text"] or "" for r in docs.unionByName(heavy).collect()}
    rows = kd_shards.shard(docs.unionByName(heavy), 24, ["doc_id"]).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in all_texts.items()}
    sizes, where = Counter(), defaultdict(set)
    weight = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
        where[all_texts[r["doc_id"]]].add(r["shard"])
        weight[all_texts[r["doc_id"]]] += r["size"]
    target = sum(sizes.values()) / 24
    assert all(len(s) == 1 for t, s in where.items() if weight[t] <= 0.05 * target)
    assert weight["the same words again " * 30] > target and len(where["the same words again " * 30]) > 1
    assert max(sizes.values()) - min(sizes.values()) < 0.15 * target


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == Counter(wanted)


def test_long_and_short_texts_are_judged_alike(spark):
    """Nothing changes at a length: texts of few words go on both sides of 2,000 words, texts of many stay."""
    rows = []
    for n in (1_500, 1_999, 2_000, 2_001, 6_000):
        rng = np.random.default_rng(n)
        rows.append((2 * n, " ".join(rng.choice([f"buy{i}" for i in range(20)], n))))
        rows.append((2 * n + 1, " ".join(f"{'abcdefghij'[i % 10] * 3}{rng.integers(0, n)}" + "." * (i % 12 == 11) for i in range(n))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    votes = quality_rules.signals(docs, ["doc_id"]).select("doc_id", next(r for r in quality_rules.rules() if r.name == "vocabulary").vote().alias("vote"))
    told = defaultdict(set)
    for r in votes.collect():
        told[r["doc_id"] % 2].add(r["vote"])
    assert told == {0: {-1}, 1: {1}}
    few = [set(ordinal.features_of(t).tolist()) for d, t in rows if d in (3_998, 4_000)]
    distinct = [ordinal._place(f"distinct {k}") for k in range(20)]
    assert len({tuple(p in f for p in distinct) for f in few}) == 1 and any(p in few[0] for p in distinct)


def test_a_words_whole_shape_counts():
    words = ordinal._Words()
    a, b = (ordinal.features_of(f"{'x1' * 30}{end}", words) for end in ("#", "%"))
    assert ordinal._place("s " + "a0" * 30 + "#") in a and ordinal._place("s " + "a0" * 30 + "%") in b


def test_pipeline_drops_what_its_stages_reject(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SMALL)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert after.count() <= now.count()
        if name == "near duplicates":
            wanted = brute_components([(r["doc_id"], r["text"]) for r in now.collect()], 5, 80)
            assert {r["doc_id"] for r in after.collect()} == {c for _, c in wanted.values()}
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in now.collect()}


def test_packing_asks_once_for_each_piece(monkeypatch):
    encoder = packing.WordEncoder(Path(PACKING_VOCABULARY).read_bytes())
    texts = ["alpha beta it's", "alpha, (beta) gamma!' it", "x" * 100 + " beta", "", "café ﬁne alpha", "gamma alpha a1 a1, 's"]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    asked, encode = [], encoder._encode_pieces
    monkeypatch.setattr(encoder, "_encode_pieces", lambda pieces: asked.extend(pieces) or encode(pieces))
    monkeypatch.setattr(packing, "LETTERS", 1)  # every text is learnt by itself
    assert list(encoder.encode(texts)) == want
    assert asked.count("alpha") == 1 and asked.count("beta") == 1  # also as pieces of other words
    assert "x" * 100 not in encoder.known
    monkeypatch.setattr(packing, "MEMORY", 0)  # a generation a text: what is met again moves on, the rest is forgotten
    assert list(encoder.encode(texts * 2)) == want * 2 and not encoder.known.places


def test_packing_encodes_pieces_without_the_rules_for_texts():
    encoder = packing.WordEncoder(Path(PACKING_VOCABULARY).read_bytes())
    signs = [chr(c) for c in range(0x250) if packing.PLAIN.fullmatch(chr(c))]
    texts = [f"a{c}B {c} {c}{c}7 {c}'s" for c in signs]
    assert len(signs) > 500 and all(map(encoder.is_plain, texts))
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder.tokenizer = None  # its rules cost more than the model
    assert list(encoder.encode(texts)) == want


def test_encoder_memory_is_bounded():
    """A worker's growth over 25 MB of texts with 400,000 different words."""
    code = """
import pyarrow.parquet as pq, public_tokenizers, pathlib
from faintlabel.llm import packing
from faintlabel.llm.common import portions, slices, text_of
def resident():
    return int(pathlib.Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6
own = packing.WordEncoder(pathlib.Path(public_tokenizers.path("word_bpe_49k.json")).read_bytes())
before = most = resident()
batches = pq.ParquetFile("/root/testdata/sf0.1/documents.parquet").iter_batches(10_000, columns=["text"])
for batch in slices(batches, packing.STEP):
    for at, encoded in portions(own.encode(text_of(batch, "text"))):
        most = max(most, resident())
print(most - before)
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert float(run.stdout) < 165
