"""Near-duplicates, languages, licences, toxicity, URLs, language-model scores and the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from tonearm.llm import factor_machine, license_rules, maxent_lm, order_minhash, queries, spans, string_kernel, url_markov

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = [a + b for a in ("ba", "ke", "lo", "mi", "su", "tra", "ven") for b in ("dor", "fin", "gas", "hul", "jen", "kop", "lar")]


# Near-duplicates


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_aligning_many_pairs_holds_the_words_of_few():
    import tracemalloc

    words = " ".join(VOCABULARY * 20)
    left, right = (pa.array([f"{words} {i} {end}" for i in range(1200)]) for end in ("a", "b"))
    tracemalloc.start()
    try:
        found = order_minhash.close_rows(left, right)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == list(range(1200))
    assert most < 2 * 1200 * 980 * 8 / 2, "less than half of the hashes of all words"
    assert order_minhash.close_rows(left[:40], pa.array(["x"] * 33 + left[33:40].to_pylist())) == list(range(33, 40))
    assert order_minhash.close_rows(left[:0], right[:0]) == []


def test_batches_of_whole_texts_have_few_rows(spark):
    from tonearm import session

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert session.materialize(rows, batch_rows=100).agg(F.max("n"), F.sum("n")).first()[:] == (100, 3000)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_banded_alignment():
    pick = random.Random(3)
    for _ in range(1500):
        a = [pick.randrange(6) for _ in range(pick.randrange(1, 30))]
        b = [x for x in a if pick.random() > 0.1] + [pick.randrange(6) for _ in range(pick.randrange(3))]
        m = common(a, b)
        assert order_minhash.common(a, b, 100) == m
        share = 2 * m / (len(a) + len(b)) if b else 0
        assert order_minhash.similarity(a, b) == (pytest.approx(share) if share >= 0.8 else 0)


def test_repeated_kmers_are_told_apart_and_order_counts():
    words = np.array([1, 2, 3, 4, 5] * 4, np.uint64)
    assert len(set(order_minhash.labelled(words).tolist())) == len(words) - 4
    forth, back = np.arange(100, dtype=np.uint64), np.arange(100, dtype=np.uint64).reshape(2, 50)[::-1].ravel()
    one, two = ([order_minhash.signatures(order_minhash.labelled(x), 200, picks) for x in (forth, back)] for picks in (1, 2))
    # Swapped halves share nearly all k-mers, but about half of all picks of two change their order.
    assert (one[0] == one[1]).mean() > 0.85 and (two[0] == two[1]).mean() < 0.65


def test_word_sketches_let_pairs_at_the_bound_pass():
    random_ = np.random.default_rng(9)
    for n in (10, 60, 300, 3000):
        words = random_.integers(0, 1 << 62, (400, n), dtype=np.uint64)
        for share, low, high in ((0.81, 0.99, 1), (0.5, 0, 0.25 if n > 50 else 1)):
            other = words.copy()
            other[:, : n - int(np.ceil(n * share))] += np.uint64(1)
            a, b = (np.array([order_minhash.word_sketch(w) for w in x]) for x in (words, other))
            assert low <= order_minhash.may_align(a, b, 0.8)[0].mean() <= high


def copies(n=160):
    pick = random.Random(8)
    texts = []
    for i in range(n):
        words = [pick.choice(VOCABULARY) + str(pick.randrange(40)) for _ in range(pick.randrange(60, 160))]
        texts.append(words)
        for share in (0.0, 0.01, 0.03, 0.06)[: i % 5]:
            texts.append([w if pick.random() > share else "new" + str(pick.randrange(999)) for w in words])
    passage = ["shared" + str(i) for i in range(60)]
    texts += [passage + [pick.choice(VOCABULARY) + str(pick.randrange(99)) for _ in range(40)] for _ in range(120)]
    base = [pick.choice(VOCABULARY) + str(pick.randrange(40)) for _ in range(120)]
    texts += [[w if pick.random() > 0.04 else "var" + str(pick.randrange(9999)) for w in base] for _ in range(200)]
    order = list(range(len(texts)))
    pick.shuffle(order)
    return [(order[i], " ".join(t)) for i, t in enumerate(texts)]


def test_near_duplicates_brute_force(spark, monkeypatch):
    rows = copies()
    monkeypatch.setattr(order_minhash, "BLOCK", 32)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = {i: t.split() for i, t in rows}
    number = {w: k for k, w in enumerate({w for t in texts.values() for w in t})}
    coded = {i: [number[w] for w in t] for i, t in texts.items()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(coded)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if top(i) != top(j) and len(set(coded[i]) & set(coded[j])) > 30 and order_minhash.similarity(coded[i], coded[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    want = {i: top(i) for i in ids}
    assert all(want[got[i]] == want[i] for i in ids)  # nothing is linked that shouldn't be
    assert sum(got[i] == want[i] for i in ids) >= 0.995 * len(ids)


def test_near_duplicates_odd_rows(spark, odd_documents, no_documents):
    rows = order_minhash.near_duplicates(odd_documents).collect()
    got = Counter((r.doc_id, r.class_id, r.kept) for r in rows)
    assert got[(4, 4, True)] == 2 and got[(5, 4, False)] == 1 and got[(None, None, True)] == 2
    assert all(got[(i, i, True)] == 1 for i in (1, 2, 3, 6, 7, 8, 9, 10, 11))
    assert order_minhash.near_duplicates(no_documents).count() == 0


# Languages


def test_languages_held_out(spark, documents):
    found = string_kernel.classify(documents, queries.remainder(4) == 2)
    rows = found.join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_ignore_everything_but_text(spark, documents):
    told = string_kernel.classify(documents, queries.remainder(4) == 2)
    hidden = documents.withColumn("lang", F.when(queries.remainder(4) == 2, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    blind = string_kernel.classify(hidden, queries.remainder(4) == 2)
    assert sorted(told.select("doc_id", "lang_pred", F.round("score", 5)).collect()) == sorted(blind.select("doc_id", "lang_pred", F.round("score", 5)).collect())


def test_kernel_is_cosine_of_gram_sets():
    data = np.frombuffer(b"abcab!abd", np.uint8)
    points = string_kernel.presence(data, np.array([0, 5, 9]))
    grams = [{s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} for s in ("abcab", " abd")]
    assert points.sum(axis=1).tolist() == [len(g) for g in grams]
    unit = points / np.sqrt(points.sum(axis=1, keepdims=True))
    assert string_kernel.kernel(points, unit)[0, 1] == pytest.approx(len(grams[0] & grams[1]) / math.sqrt(len(grams[0]) * len(grams[1])))


def _least_windows(rows, quota):
    """By brute force: of each language the distinct windows, in the order of their hashes."""
    found = {}
    for lang, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        cuts, _row = string_kernel.windows(data, np.array([0, len(data)]))
        for low, high in zip(cuts[:-1], cuts[1:]):
            key = int(spans.hashes(data, np.array([low]), np.array([high]))[0]) >> 1
            found.setdefault(lang, set()).add((key, bytes(data[low:high])))
    return {lang: sorted(own)[:quota] for lang, own in found.items()}


def test_copies_do_not_starve_a_language(spark, documents):
    rows = [(r.lang, r.text) for r in documents.where("lang is not null and text rlike '[a-z]'").select("lang", "text").collect()]
    names = {lang for lang, _ in rows}
    heavy = [("en", "one text that repeats and repeats")] * 20_000
    for added in ([], heavy):
        docs = spark.createDataFrame(rows + added, "lang string, text string").repartition(7)
        quota = 40
        want = _least_windows(rows + added[:1], quota)
        got = string_kernel._sampled(docs, quota * len(names))
        assert sorted(got) == sorted((lang, window) for lang, own in want.items() for _, window in own)
    assert sum(lang == "en" for lang, _ in got) == quota


def test_languages_brute_force(spark, documents):
    """Scores by sets of slots and the normal equations in the landmarks' own coordinates."""
    docs = documents.where("lang is not null and text rlike '[a-z]'").select("lang", "text")
    rows = [tuple(r) for r in docs.collect()]
    names = sorted({lang for lang, _ in rows})
    model = string_kernel.fit(docs, 30 * len(names), 3 * len(names))
    sample = sorted((key, lang, window) for lang, own in _least_windows(rows, 30).items() for key, window in own)

    def slots(window):
        text = [b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in window.decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape")]
        codes = [(size, sum(b << 8 * (size - 1 - k) for k, b in enumerate(text[i : i + size]))) for size in (1, 2, 3) for i in range(len(text) - size + 1)]
        return {(((code + (size << 26)) * 2654435761) & 0xFFFFFFFF) >> 19 for size, code in codes}

    def cosine(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    points = [slots(window) for _, _, window in sample]
    places, turns = Counter(), []
    for i, (_, lang, _) in enumerate(sample):
        turns.append((places[lang], i))
        places[lang] += 1
    # Landmarks of a turn come in the order of languages, as groups were made in the order of the sample.
    chosen = {i for _, i in sorted(turns, key=lambda x: (x[0], x[1]))[: 3 * len(names)]}
    marks = [points[i] for i in sorted(chosen)]
    k_nm = np.array([[cosine(p, m) for m in marks] for p in points])
    k_mm = np.array([[cosine(a, b) for b in marks] for a in marks])
    y = np.array([[1.0 if lang == x else -1.0 for x in names] for _, lang, _ in sample])
    c = string_kernel.RIDGE * len(sample) / len(marks)
    weights = np.linalg.solve(k_nm.T @ k_nm + c * k_mm, k_nm.T @ y)
    for _, text in rows[:40]:
        data = np.frombuffer(text.encode(), np.uint8)
        cuts, _row = string_kernel.windows(data, np.array([0, len(data)]))
        total = sum(np.array([cosine(slots(bytes(data[a:b])), m) for m in marks]) @ weights * (b - a) for a, b in zip(cuts[:-1], cuts[1:]))
        shares = np.exp(string_kernel.SHARPNESS * total / len(data))
        got = model.scores(data, np.array([0, len(data)]))[0]
        assert got == pytest.approx(shares / shares.sum(), abs=2e-3)


def test_languages_odd_rows(spark, odd_documents, no_documents):
    rows = string_kernel.classify(odd_documents, F.lit(False)).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 8))
    assert by[9].lang_pred == "xx" and by[6].lang_pred == "de"
    assert {r.lang_pred for r in string_kernel.classify(odd_documents, F.lit(True)).collect()} == {"und"}
    assert string_kernel.classify(no_documents, F.lit(False)).count() == 0
    carried = string_kernel.classify(odd_documents, F.lit(False), carry=True).select("row.*")
    assert carried.columns == odd_documents.columns and carried.count() == len(rows)


# Licences


def test_licenses_sql(spark):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        assert compare.difference(spark, compare.connect(folder), folder, queries.QUERIES["op3_license_rules"], queries.ORACLE["op3_license_rules"]) is None


def test_license_sequences(spark, odd_documents, no_documents):
    mit = [s for s, i in license_rules.SENTENCES.items() if i in ("mit-grant", "mit-notice", "as-is-software")]
    texts = [
        ". ".join(mit).upper() + ".", "Foo.\n * " + ";\n * other line\n".join(mit), "Released under the MIT License.\nLicensed under CC BY-NC 4.0. Bye",
        "permission is hereby granted", "Licensed under the Apache License, Version 2.0 (the \"License\");\n you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n http://x",
        " ".join(["Released under the MIT License."] * 3),
    ]
    rows = license_rules.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == [["MIT"], ["MIT"], ["MIT", "CC-BY-NC-4.0"], [], ["Apache-2.0"], ["MIT"]]
    assert rows[5].sentence_ids == ["mit-line"] * 3
    assert all(r.licenses == [] for r in license_rules.scan(odd_documents).collect())
    assert license_rules.scan(no_documents).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
NAMES = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of FITNESS. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.  If not, see <http://www.gnu.org/licenses/>."""
NOTICES = ((MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + NAMES, "BSD-3-Clause"), (GPL.format(":", 3), "GPL-3.0-or-later"), (GPL.format(";", 2), "GPL-2.0-or-later"))


def test_wrapped_and_commented_licenses(spark):
    import textwrap

    rows, want = [], []
    for notice, name in NOTICES:
        for width in (50, 72, 80):
            for first, leader, last in (("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("", ";; ", ""), ("", "REM ", ""), ("<!--\n", "   ", "\n-->")):
                for end in ("\n", "\r\n"):
                    lines = ["Copyright (c) 2020 Someone"] + [y for x in notice.split("\n") for y in textwrap.wrap(x, width) or [""]]
                    rows.append((len(rows), first + end.join(leader + x for x in lines) + last + end + "int main() {}"))
                    want.append([name])
    got = license_rules.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in got] == want
    # A blank line still ends a sentence, and so does a full stop.
    apart = [(0, "Released under\n\nthe MIT License."), (1, "Released under. the MIT License."), (2, "Not released under\nthe MIT License."), (3, "Released under\nthe MIT License with more")]
    assert all(r.licenses == [] for r in license_rules.scan(spark.createDataFrame(apart, "doc_id long, text string")).collect())


NAMED = """ * Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""
STATEMENTS = (
    (BSD + "\n" + NAMED.format("Google Inc. or the University of Somewhere, Berkeley"), ["BSD-3-Clause"]), (BSD + "\n" + NAMED.format("X"), ["BSD-3-Clause"]),
    (ISC, ["ISC"]), (LGPL, ["LGPL-2.1-or-later"]),
    ("This file is licensed under the MIT License.", ["MIT"]), ("the source code is made available under the terms of the Mozilla Public Licence, v. 2.0.", ["MPL-2.0"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]), ("x\n# SPDX-License-Identifier: Apache-2.0\ny", ["Apache-2.0"]),
    ("// SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)", ["MIT", "GPL-2.0-or-later"]), ("SPDX-License-Identifier: MIT-0 AND LGPL-2.1", ["MIT-0", "LGPL-2.1"]),
    ("SPDX-License-Identifier: Nonesuch", []), ("licensed under the Foo License.", []), ("See: this file is licensed under the MIT License.", []),
)


def test_named_holders_statements_and_spdx_lines(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(STATEMENTS)], "doc_id long, text string")
    assert [r.licenses for r in license_rules.scan(rows).orderBy("doc_id").collect()] == [names for _, names in STATEMENTS]
    # Every known sentence is found and named, and every short statement gives its licence.
    known = [*license_rules.SENTENCES.items(), *((s.replace("*", "some one"), i) for s, i in license_rules.SLOT_SENTENCES.items())]
    known += [(f"this project is released under the terms of the {n}", None) for n in license_rules.NAMES]
    known += [(f"SPDX-License-Identifier: {n}", None) for n in license_rules.SPDX]
    found = license_rules.scan(spark.createDataFrame(list(enumerate(s for s, _ in known)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.sentence_ids for r, (_, i) in zip(found, known) if i] == [[i] for _, i in known if i]
    stated = [r.licenses for r, (_, i) in zip(found, known) if i is None]
    assert stated == [[n] for n in [*license_rules.NAMES.values(), *license_rules.SPDX]]


def test_license_sql_on_wrapped_notices(spark, tmp_path):
    import textwrap

    texts = [None, "", *(text for text, _ in STATEMENTS)]
    for notice in [text for text, _ in NOTICES] + [text for text, _ in STATEMENTS]:
        for width in (30, 70):
            for leader in ("", " * ", "REM ", "c "):
                texts.append("Copyright\n" + "\r\n".join(leader + x for line in notice.split("\n") for x in textwrap.wrap(line, width) or [""]) + "\nend")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    want = con.execute(license_rules.scan_sql() + " ORDER BY doc_id").fetchall()
    got = license_rules.scan(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, ",".join(r.sentence_ids), ",".join(r.licenses)) for r in got] == want


# Toxicity


def insults(n=3000):
    """Label 1 is an insult that meets a group: neither alone."""
    pick = random.Random(4)
    rows = []
    for i in range(n):
        words = [pick.choice(VOCABULARY) + pick.choice(VOCABULARY) for _ in range(30)]
        bad, group = pick.random() < 0.5, pick.random() < 0.5
        words += ["vermin"] * bad + ["neighbours"] * group
        pick.shuffle(words)
        rows.append((i, " ".join(words), int(bad and group)))
    return rows


def test_machine_learns_pairs(spark):
    rows = spark.createDataFrame(insults(), "doc_id long, text string, toxic int")
    held = F.col("doc_id") % 3 == 1
    got = factor_machine.score(rows.drop("toxic"), rows.select("doc_id", "toxic"), held).join(rows.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.98 * len(got)


def test_margins_brute_force():
    random_ = np.random.default_rng(2)
    machine = factor_machine.Machine(np.arange(10, dtype=np.uint32) * 3, 0.3, random_.standard_normal(10), random_.standard_normal((10, 4)))
    found, cuts = np.array([0, 3, 4, 27, 6, 9], np.uint32), np.array([0, 4, 4, 6])
    got = machine.margins(*machine.place(found, cuts))
    for r, own in enumerate(([0, 1, 9], [], [2, 3])):
        pairs = sum(machine.factors[i] @ machine.factors[j] for n, i in enumerate(own) for j in own[n + 1 :])
        assert got[r] == pytest.approx(0.3 + machine.weights[own].sum() + pairs)


def test_toxicity_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(4, 0, 1, "x"), (6, 0, 0, "x"), (7, 0, 0, "x"), (None, 0, 1, "x"), (10, 1, None, "x"), (4, 0, 1, "x")], "doc_id long, quality int, toxic int, score string")
    rows = factor_machine.score(odd_documents, labels, queries.remainder(3) == 1).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert {r.score for r in factor_machine.score(odd_documents, labels.limit(0), F.lit(False)).collect()} == {0.5}
    assert factor_machine.score(no_documents, labels, F.lit(False)).count() == 0
    assert factor_machine.score(odd_documents, labels, F.lit(False), carry=True).select("row.*").columns == odd_documents.columns


# URLs


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = max(((w, d, s) for w, d, s in url_markov.RULES if (host == d or host.endswith("." + d)) and path.startswith(s)), key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


URLS = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/x", "http://example.org/es/", "http://example.org", "http://example.org/en/15?x=/es/", "http://notexample.org/es/",
        "a://b://example.org/es/", "http://x.com/fr/y#z", "http://COM/de/", "http://x.com/dex", "http://x.net?y/fr/", "http://x.net#/fr/", "http://x.com:80/fr/", "http://É.com/de/\nq", "http://" + "a" * 5000 + ".net/"]


def test_url_rules_and_models_brute_force(spark):
    pages = [(i, u) for i, u in enumerate(URLS + URLS[4:8])] + [(100 + r.page_id, r.url) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()] + [(None, "http://q.net/a")]
    got = url_markov.judge(spark.createDataFrame(pages, "page_id long, url string").withColumns({"score": F.lit("x"), "good": F.lit(1), "gram": F.lit(1)})).collect()
    assert len(got) == len(pages)
    good, bad = Counter(), Counter()

    def places(url):
        text = "\2" * 4 + "".join("0" if c.isascii() and c.isdigit() else c for c in url) + "\3"
        return [text[i : i + 5] for i in range(len(text) - 4)]

    for _, u in pages:
        word = rule_of(u)[3]
        for g in places(u) if word else ():
            for n in range(5):
                (good if word == "allow" else bad)[("own", g[4 - n :])] += 1
                (good if word == "allow" else bad)[("before", g[4 - n : 4])] += 1

    def score(url):
        total = 0
        for g in places(url):
            p = q = 1 / 256
            for n in range(5):
                own, before = ("own", g[4 - n :]), ("before", g[4 - n : 4])
                p = (good[own] + 4 * p) / (good[before] + 4)
                q = (bad[own] + 4 * q) / (bad[before] + 4)
            total += math.log(q) - math.log(p)
        return total / len(places(url))

    by_id = {r.page_id: r for r in got}
    for i, u in pages:
        host, path, rule, word = rule_of(u)
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if word:
            assert r.verdict == word
        if u is None:
            assert r.score is None and r.verdict == "allow"
        else:
            assert r.score == pytest.approx(score(u), abs=1e-9)
    open_rows = [r for r in got if r.rule is None and r.score is not None]
    bound = max([r.score for r in open_rows if r.verdict == "allow"])
    assert all(r.score > bound for r in open_rows if r.verdict == "block")
    decided = [r for r in got if r.rule]
    assert sum((r.score > bound) == (r.verdict == "block") for r in decided) >= 0.85 * len(decided)


def test_urls_sql(spark):
    for folder in (FOLDER, "/root/testdata/sf0.01"):
        assert compare.difference(spark, compare.connect(folder), folder, queries.QUERIES["op5_url_markov"], queries.ORACLE["op5_url_markov"]) is None


def test_url_plan_is_native(spark):
    plan = queries.QUERIES["op5_url_markov"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("common", [1, 200])
def test_url_models_keep_rare_strings(spark, monkeypatch, common):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url")
    want = {r.page_id: (r.verdict, r.score) for r in url_markov.judge(pages).collect()}
    monkeypatch.setattr(url_markov, "KEPT", common)  # nearly all strings are too rare to be broadcast
    got = {r.page_id: (r.verdict, r.score) for r in url_markov.judge(pages).collect()}
    assert got.keys() == want.keys()
    for i, (verdict, score) in want.items():
        assert got[i] == (verdict, score if score is None else pytest.approx(score, abs=1e-9))


def test_urls_without_rules_are_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/x"), (3, None)], "page_id long, url string")
    assert {r.verdict for r in url_markov.judge(pages).collect()} == {"allow"}
    assert url_markov.judge(pages.limit(0)).count() == 0


# Language-model scores


def test_scores_brute_force(spark, documents, odd_documents, no_documents):
    held = queries.remainder(7) == 2
    for docs in (documents, odd_documents.unionByName(documents, allowMissingColumns=True)):
        split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ")
        rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("h")).collect()
        tokens = [[w for w in split(r.text).split(" ") if w] + [None] for r in rows]
        count = Counter(w for r, own in zip(rows, tokens) if not r.h for w in own)
        n, v = sum(count.values()), len(count)
        want = sorted(((str(r.doc_id), r.h, len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), 5)) for r, own in zip(rows, tokens)), key=repr)
        got = maxent_lm.score(docs, held).collect()
        assert sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        hidden = [r for r in got if r.held_out]
        assert sum(r.score for r in hidden) > sum(r.base_score for r in hidden)  # a better model than unigrams
    assert maxent_lm.score(no_documents, held).count() == 0
    assert {r.train_tokens for r in maxent_lm.score(odd_documents, F.lit(True)).collect()} == {0}


def test_model_sums_to_one():
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog"] * 40
    found, cuts = maxent_lm.tokens(*spans.utf8(pa.array(texts)))
    words, counts = np.unique(found, return_counts=True)
    shape = (words & np.uint64(15)).astype(int)
    top = np.argsort(-counts)[:5]
    corpus = maxent_lm.Corpus(np.bincount(shape, counts, 16).astype(int), np.bincount(shape, minlength=16), list(zip(words[top].view(np.int64).tolist(), counts[top].tolist())))
    weights = np.zeros((3 * maxent_lm.SLOTS + 1, maxent_lm.CLASSES), np.float32)
    weights[-1] = corpus.prior
    start = maxent_lm._activations(weights, maxent_lm.contexts(found, cuts))[np.arange(len(found)), corpus.classes(found)].sum()
    for _ in range(20):
        maxent_lm._trained(weights, corpus, found, cuts, np.ones_like(weights))
    after = maxent_lm._activations(weights, maxent_lm.contexts(found, cuts))
    assert after[np.arange(len(found)), corpus.classes(found)].sum() > 0.6 * start
    frequent = np.isin(words, corpus.frequent)
    within = np.where(frequent, 1, (counts + 1) / (corpus.rest_tokens + corpus.rest_words + 1)[shape])
    unseen = 1 / (corpus.rest_tokens + corpus.rest_words + 1)
    for values in np.exp(after[:20]):
        total = (values[corpus.classes(words)] * within).sum() + (values[maxent_lm.FREQUENT :] * unseen).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_contexts_reach_the_word(spark):
    """Words of one class that differ in what stands before them."""
    pick = random.Random(5)
    pairs = list(range(400)) * 6
    pick.shuffle(pairs)
    rows = [(n, " ".join(f"k{i}aa v{i}zz" for i in pairs[n * 8 : n * 8 + 8])) for n in range(300)]
    rows += [(1000 + i, f"k{i}aa v{i}zz") for i in range(40)] + [(2000 + i, f"k{i}aa v{i + 1}zz") for i in range(40)] + [(3000, "k1aa unseenzz")]
    got = {r.doc_id: r.score for r in maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert all(got[1000 + i] > got[2000 + i] + 1 for i in range(40))
    assert all(math.isfinite(x) and x < 0 for x in got.values())


def test_shares_of_a_context_sum_up():
    found, cuts = maxent_lm.tokens(*spans.utf8(pa.array(["the cat sat on the mat", "the cat ran", "a dog sat on a cat", "the cat sat"])))
    keys, counts = np.unique(maxent_lm.ngrams(found, cuts), return_counts=True)
    seen, given = maxent_lm.shares(counts, *maxent_lm.totals(keys, counts))
    heads = keys >> np.uint64(24)
    for head in np.unique(heads):
        own = heads == head
        assert seen[own].sum() == pytest.approx(given[own][0]) and 0 <= given[own][0] < 1 and len(set(given[own])) == 1
    assert given.max() > 0


def test_answers_give_the_shares_of_all_texts():
    pick = random.Random(11)
    texts = [" ".join(f"w{min(int(pick.expovariate(0.2)), 40)}" for _ in range(60)) for _ in range(90)]
    train = np.array([n % 7 != 2 for n in range(90)])
    cut = [maxent_lm.tokens(*spans.utf8(pa.array(texts[n : n + 30]))) for n in (0, 30, 60)]
    keys = [maxent_lm.ngrams(found, cuts, range(2, 3))[0] for found, cuts in cut]
    taught = np.concatenate([np.repeat(train[30 * n : 30 * n + 30], np.diff(cuts)) for n, (_, cuts) in enumerate(cut)])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(place, taught, len(distinct)).astype(int)
    want = np.stack(maxent_lm.shares(counts, *maxent_lm.totals(distinct, counts)))
    asked = []
    for n, (found, cuts) in enumerate(cut):
        words, which = maxent_lm._ranks(found)
        groups = pa.RecordBatch.from_pydict({
            "chunk": [n], "held_out": [(~train[30 * n : 30 * n + 30]).tolist()], "lengths": [maxent_lm._planes(np.diff(cuts).astype("<u8"))],
            "words": [maxent_lm._planes(maxent_lm._gaps(words))], "which": [maxent_lm._planes(which.astype("<u4"))],
        })
        asked += maxent_lm._ngram_requests(4, 8, 2)(iter([groups]))
    asked = pa.Table.from_batches(asked)
    answers = pa.concat_tables(maxent_lm._ngram_count(asked.filter(pc.equal(asked["bucket"], b))) for b in range(8, 12))
    for n, own in enumerate(keys):
        got = maxent_lm._shares_of(answers.filter(pc.equal(answers["chunk"], n)), range(8, 12))
        _, at = maxent_lm._ranks(own)
        assert np.allclose(np.stack(got)[:, at], want[:, np.searchsorted(distinct, own)], atol=1e-7) and want[0].max() > 0


def test_texts_are_read_once_and_grouped(spark, documents):
    """What is shuffled are packed tokens, not texts; small batches fill a group."""
    plan = maxent_lm.score(documents, queries.remainder(7) == 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "which#" in plan and "text#" not in plan
    batches = [pa.RecordBatch.from_pydict({"id": list(range(100)), "text": ["x" * 20_000] * 100}) for _ in range(9)]
    groups = list(maxent_lm._groups(iter(batches)))
    assert sum(g.num_rows for g in groups) == 900 and len(groups) <= 4
    assert max(g.num_rows for g in groups) * 20_032 <= maxent_lm.CHUNK_BYTES
    assert [g.num_rows for g in maxent_lm._groups(iter([pa.RecordBatch.from_pydict({"text": ["a", "b" * (maxent_lm.CHUNK_BYTES + 1), "c"]})]))] == [1, 1, 1]


def test_packed_keys_are_small():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 200_000, dtype=np.uint64))
    packed = maxent_lm._planes(maxent_lm._gaps(keys))
    assert len(packed) < 6.2 * len(keys) and (np.cumsum(maxent_lm._values(packed, "<u8"), dtype=np.uint64) == keys).all()
    few = np.where(np.random.default_rng(4).random(100_000) < 0.2, 2, 1).astype("<u4")
    assert len(maxent_lm._planes(few)) < 0.2 * len(few)


# Pipeline


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    toxic = {r.doc_id for r in factor_machine.score(docs, labels, queries.remainder(3) == 1).where("predicted = 1").collect()}
    kept = [r for r in docs.collect() if r.doc_id not in toxic]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["toxicity"](spark, docs, FOLDER)
    assert first.columns == docs.columns and sorted(first.collect()) == sorted(kept)
    second = stages["language"](spark, first, FOLDER)
    assert second.columns == docs.columns and second.count() > 0.98 * first.count()
    third = stages["near_duplicates"](spark, second, FOLDER)
    classes = order_minhash.near_duplicates(second).collect()
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted({r.class_id for r in classes})
    pieces = stages["packing"](spark, third, FOLDER)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in third.collect()}
    assert corpus_pipeline.run(spark, FOLDER).count() == pieces.count()


def test_pipeline_odd_rows(spark, odd_documents, no_documents):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, odd_documents, FOLDER)
        assert left.columns == odd_documents.columns
        assert stage(spark, no_documents, FOLDER).count() == 0
        if name == "language":
            assert {r.doc_id for r in left.collect()} & {1, 2, 3, 8} == set()
        if name == "near_duplicates":
            assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, 8, 9, 10, 11, None, None], key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, no_documents, FOLDER).count() == 0


def test_pipeline_packs_odd_rows(spark, odd_documents):
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd_documents, FOLDER).collect()
    ids = Counter(r.doc_id for r in odd_documents.select("doc_id").collect())
    assert Counter(r.doc_id for r in pieces if r.start == 0) == ids
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert [r.doc_tokens for r in pieces if r.doc_id in (1, 2)] == [1, 1]


def test_one_doc_id_with_several_texts(spark):
    """Rows are told apart by doc_id and text: no unique text goes because its doc_id is also a copy's."""
    texts = {name: " ".join(f"{name}{i * 7 % 90}" for i in range(80)) for name in "abc"}
    rows = [(1, texts["a"], "p"), (2, texts["a"], "q"), (2, texts["b"], "r"), (2, texts["b"], "s"), (3, texts["c"], "t"), (4, texts["c"] + " end", "u"), (3, None, "v"), (3, None, "w"), (None, texts["a"], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, position string")
    left = corpus_pipeline.one_of_each(spark, docs, FOLDER)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(1, texts["a"]), (2, texts["b"]), (3, texts["c"]), (3, None), (None, texts["a"])], key=str)
