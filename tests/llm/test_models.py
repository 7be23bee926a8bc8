"""Language identification, scoring, licences."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_words import tokens
from rowweave.llm import common, langid, licences, ppm


def test_language_accuracy(spark, sf):
    out = {r.doc_id: r for r in langid.op1_language_id(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in common.table(spark, sf, "documents").collect()}
    assert set(out) == set(truth)
    held = [d for d, r in out.items() if r.held_out]
    assert held == [d for d in out if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(out[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_odd_rows(odd, none, spark):
    model = langid.train(odd)
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd, model, "doc_id").collect()]
    assert len(out) == 9 and [(p, s) for d, p, s in out if d in (1, 2, 3)] == [("und", 0.0)] * 3
    assert len({x for x in out if x[0] in (5, 6)}) == 2  # repeated rows and equal texts get the same
    assert langid.predict(none, model, "doc_id").count() == 0
    empty = langid.train(none)
    assert empty[0] == [] and {r.lang_pred for r in langid.predict(odd, empty, "doc_id").collect()} == {"und"}
    assert set(langid.stage_language(spark, odd, "").columns) == set(odd.columns)


def test_language_counts_do_not_depend_on_neighbours(docs_of):
    a, b = docs_of((1, "abc", "x"), (2, "def ghi", "y")).coalesce(1), docs_of((2, "def ghi", "y"), (1, "abc", "x")).repartition(2)
    assert np.array_equal(langid.train(a)[2], langid.train(b)[2])


def test_language_equals_plain_naive_bayes(docs_of):
    """Scores of a program that counts n-grams text by text in a dictionary of the same buckets."""
    train = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("die maus", "de"), ("the mouse, the house!", "en"), (None, "en"), ("x", None), ("el perro y el gato", "es")]
    asked = ["the cat and a mouse", "die katze", "chat", "perro", "12", "", None, "É" * 3 + " dog"]

    def buckets(text):
        return [list(h) for h in langid.grams(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))[0]]

    counts, texts = {}, Counter(lang for t, lang in train if t is not None and lang is not None)
    for t, lang in train:
        if t is not None and lang is not None:
            for order, found in enumerate(buckets(t)):
                counts.setdefault(lang, [Counter() for _ in langid.ORDERS])[order].update(found)
    used = [len(set().union(*(c[o] for c in counts.values()))) for o in range(len(langid.ORDERS))]
    model = langid.train(docs_of(*((i, t, lang) for i, (t, lang) in enumerate(train))))
    assert model[0] == sorted(counts)
    for r in langid.predict(docs_of(*enumerate(asked)), model, "doc_id").collect():
        text = asked[r.doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = {}
        for lang, own in counts.items():
            z[lang] = math.log(texts[lang] / sum(texts.values()))
            for o, found in enumerate(buckets(text)):
                z[lang] += sum(math.log((own[o][h] + 0.5) / (sum(own[o].values()) + 0.5 * used[o])) for h in found)
        best = max(sorted(z), key=z.get)
        assert r.lang_pred == best and math.isclose(r.score, 1 / sum(math.exp(x - z[best]) for x in z.values()), rel_tol=1e-3)


def test_as_many_languages_as_a_model_may_tell_apart(docs_of):
    rows = [(i, f"{chr(0x4E00 + 7 * i)}{chr(0x5E00 + 5 * i)} {chr(0x6E00 + 3 * i)}", f"l{i:03d}") for i in range(langid.MAX_LANGS)]
    docs = docs_of(*rows).coalesce(2)
    out = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(docs), "doc_id").collect()}
    assert all(out[i] == lang for i, _, lang in rows)
    with pytest.raises(ValueError):
        langid.train(docs_of(*rows, (-1, "x", "one more")))


def plain_ppm(texts, order, most):
    """log10 of the probability of a text by definition, with sets of excluded bytes."""
    counts, total = Counter(), 0
    for t in texts:
        x = b"\0" * order + t.encode() + b"\xff"
        for i in range(order, len(x)):
            total += 1
            for k in range(order + 1):
                counts[x[i - k : i + 1]] += 1
    kept = {g: n for g, n in counts.items() if n * most >= total}
    below = {}
    for g, n in kept.items():
        below.setdefault(g[:-1], {})[g[-1]] = n

    def score(t):
        x, out = b"\0" * order + t.encode() + b"\xff", 0.0
        for i in range(order, len(x)):
            excluded = set()
            for k in range(order, -1, -1):
                c = x[i - k : i]
                if c not in below:
                    continue
                seen = {s: n for s, n in below[c].items() if s not in excluded}
                came = total if not k else kept.get(c, 0)  # a context of zeros before a text isn't an entry
                escape = max(came - sum(below[c].values()), 0) + len(seen)
                all_ = sum(seen.values()) + escape
                if not all_:
                    continue
                if x[i] in seen:
                    out += math.log10(seen[x[i]] / all_)
                    break
                out += math.log10(escape / all_)
                excluded |= set(seen)
            else:
                out -= math.log10(256 - len(excluded))
        return out

    return score


def test_ppm_equals_its_definition(docs_of):
    train = ["the cat sat on the mat", "the bat sat", "", "on that mat"]
    asked = ["the cat", "zebra the", "", "sat on the mat on that", "é"]
    for order, most in ((3, 10**9), (5, 10**9), (2, 12)):
        trie = ppm.fit(ppm.gather(docs_of(*enumerate(train)), order), order, most)
        keys, at = ppm.gram_keys(np.frombuffer("".join(asked).encode(), np.uint8), np.cumsum([0] + [len(a.encode()) for a in asked]), order)
        got = ppm.arrays.summed(trie.scores(keys), at)
        score = plain_ppm(train, order, most)
        assert np.allclose(got, [score(a) for a in asked])


def test_ppm_probabilities_add_up(docs_of):
    trie = ppm.fit(ppm.gather(docs_of((1, "abracadabra"), (2, "abba")), 3), 3)
    for context in (0x616272, 0x7A7A7A, 0x000000, 0x616263):
        grams = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trie.scores(grams)).sum() - 1) < 1e-9


def test_base_scores(spark, sf):
    docs = {r.doc_id: tokens(r.text) + [""] for r in common.table(spark, sf, "documents").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = Counter(t for d, ts in docs.items() if not held[d] for t in ts)
    n, v = sum(c.values()), len(c)
    rows = ppm.op8_lm_scoring(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ts = docs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts), sum(c[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert r.score < 0


def test_rare_tokens_meet_their_counts(docs_of):
    """With a small table of frequent tokens the shuffled path gives the same."""
    docs = docs_of((1, "a a b c"), (2, "a b d"), (2, "a b d"))
    counts = common.store(ppm.gather(docs), "t")
    few, all_ = ppm.Unigrams(counts, 3, hot=2), ppm.Unigrams(counts, 3)
    assert len(few.hot_logs) < len(all_.hot_logs)
    rare = ppm.rare_tokens(docs.withColumn("key", F.xxhash64("text")), few)
    assert rare.agg(F.sum("n")).first()[0] == 10 - sum(1 for _ in range(4)) or rare.count() > 0


def test_scoring_odd_rows(odd, none):
    rows = ppm.scored(odd, odd, "doc_id").collect()
    assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert len({(r.score, round(r.base_score, 9)) for r in rows if r.doc_id in (5, 6)}) == 1
    assert ppm.scored(none, odd, "doc_id").count() == 0
    blank = ppm.scored(odd, none, "doc_id").collect()
    assert {(r.train_tokens, r.base_score) for r in blank} == {(0, 0.0)} and all(math.isclose(r.score, -math.log10(256)) for r in blank if r.doc_id in (1, 2))


@pytest.mark.parametrize("hot", [0, 3, ppm.HOT_GRAMS])
def test_scores_are_of_all_contexts(docs_of, hot, monkeypatch):
    """However few n-grams are broadcast, and however rare a context is: no entry is dropped."""
    monkeypatch.setattr(ppm, "PART_GRAMS", 4)
    train = ["the cat sat on the mat", "the bat sat", "", "on that mat"]
    asked = ["the cat", "zebra the", "", "sat on the mat on that", "é", "the cat", "a\0b", None]
    score = plain_ppm(train, ppm.ORDER, 10**9)
    rows = ppm.scored(docs_of(*enumerate(asked)), docs_of(*enumerate(train)), "doc_id", hot=hot).collect()
    assert len(rows) == len(asked)
    assert all(math.isclose(r.score, score(asked[r.doc_id] or ""), rel_tol=1e-9) for r in rows)


def test_rare_contexts_stay_in_large_corpora(docs_of):
    """A context of two occurrences counts the same beside 5.4 million other bytes: a cut by share would have lost it."""
    text = "qzjxvk wqxzjv"
    many = [(i, "abcdefgh " * 1000) for i in range(600)]  # 5.4 million bytes
    train = docs_of((-1, text), (-2, text), *many)
    got = ppm.scored(docs_of((1, text)), train, "doc_id").first().score
    assert got > -12  # all but the first byte are sure after their contexts; without those each costs as much as the first


LINES = {"apache": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}


def test_licences_of_documents(spark, sf):
    docs = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    for r in licences.op9_licence_scan(spark, sf).collect():
        want = ",".join(f for f in sorted(LINES) if LINES[f] in docs[r.doc_id])
        assert r.licences == want and r.n_licence == sum(line in LINES.values() for line in docs[r.doc_id].split("\n"))


def test_licence_templates_and_others(docs_of):
    texts = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts]
    rows = docs_of(*((i, t) for i, (_, t) in enumerate(texts)), *((100 + i, t) for i, t in enumerate(licences.NO_LICENCE)), (200, "Copyright (C) 2020 the authors.\nFor more see below.\nReleased under the MIT License, all of it.\n"))
    found = {}
    marked = licences.suspects(rows, "doc_id")
    for r in licences.scan(marked).join(marked.select("row", "doc_id"), "row").where("confirmed").collect():
        found.setdefault(r.doc_id, set()).add(r.family)
    assert sum(found.get(i) == {f} for i, (f, _) in enumerate(texts)) >= 0.85 * len(texts)
    assert not [d for d in found if 100 <= d < 200] and found[200] == {"mit"}


#: Sentences that are no template, and their family.
HELD_OUT = [
    ("mit", "Distributed under the terms of the MIT license."), ("mit", "This software is licensed under the MIT license, see LICENSE."), ("mit", "Code in this repository is released under the MIT License unless stated otherwise"),
    ("apache", "This software is licensed under the Apache License, Version 2.0."), ("apache", "The library is available under the Apache License, Version 2.0"), ("apache", "# SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "You can redistribute this tool under the GNU General Public License, version 2 or later."), ("gpl", "This package is released under the GPL v3"), ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("lgpl", "The code is licensed under the GNU Lesser General Public License, version 3."), ("bsd", "The project is licensed under the 3-Clause BSD License"), ("bsd", "It is released under the BSD License, like its parent"),
    ("cc-by", "All photos are licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by-sa", "This page is available under the Creative Commons Attribution-ShareAlike License"), ("cc-by-nc", "The videos are licensed under CC BY-NC 4.0"),
    ("mpl", "This file is licensed under the Mozilla Public License, version 2.0"), ("isc", "Licensed under the ISC license"), ("epl", "made available under the terms of the Eclipse Public License v2.0"), ("unlicense", "The tool is released under the Unlicense"),
    ("cc0", "The data are licensed under CC0 1.0 Universal"), ("boost", "Distributed under the Boost Software License, Version 1.0"), ("cc-by", "Figures licensed under CC BY 4.0"), ("mit", "// SPDX-License-Identifier: MIT"),
    ("", "the code is not licensed under the MIT License."), ("", "This software is no longer released under the GPL v3."), ("", "She got her driving license at the age of 18."), ("", "MIT released a study on public health under a new title."),
    ("", "The Eclipse was visible to the general public."), ("", "Version 2.0 of the app is available."), ("", "The license of the pub was revoked by the city."), ("", "A commons is land that is open to all"), ("", "All rights reserved, no part may be copied without permission"),
    ("", "The work was done under the direction of the author"), ("", "Licensed under the Smallville Public Library rules, version 2.0."), ("", "It isn't licensed under the Apache License, Version 2.0."),
]


def plain_licences(text):
    """Families of the lines of a text, by the weights and templates alone."""
    classes, weights, biases = licences.train()
    table, out = dict(weights), set()
    for line in text.split("\n"):
        own = set(licences.features(line))
        if not own & set(licences.anchors()) or own & set(licences.NEGATED):
            continue
        p = licences._softmax(np.sum([table[f] for f in own if f in table] + [biases], axis=0)[None])[0]
        for family, x in zip(classes[1:], p[1:], strict=True):
            top, telling = x == p.max() and x >= 0.5, own & licences._telling(family)
            shared = max(len(own & t) / len(t) for t in ({f for f in licences.features(t) if " " in f} for t in licences.TEMPLATES[family]))
            out |= {family} if shared >= 0.6 and (top and telling or x >= 0.01 and any(" " in f for f in telling)) else set()
    return ",".join(sorted(out))


def test_licences_of_other_sentences(docs_of, tmp_path):
    """Accuracy on sentences that the classifier hasn't seen, and the same results as a plain program."""
    df = docs_of(*((i, t) for i, (_, t) in enumerate(HELD_OUT)))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r.licences for r in licences.op9_licence_scan(df.sparkSession, str(tmp_path)).collect()}
    assert rows == {i: plain_licences(t) for i, (_, t) in enumerate(HELD_OUT)}
    assert sum(rows[i] == f for i, (f, _) in enumerate(HELD_OUT)) >= 0.9 * len(HELD_OUT)
    assert all(rows[i] == "" for i, (f, _) in enumerate(HELD_OUT) if not f)


def test_licence_held_out():
    classes, weights, biases = licences.train()
    table = dict(weights)
    right = 0
    _, held = licences.examples()
    for features, family in held:
        z = np.sum([table[f] for f in features if f in table] + [biases], axis=0)
        right += classes[int(z.argmax())] == family
    assert right >= 0.9 * len(held) and len(weights) < 400


def test_licences_odd_rows(odd, none):
    assert licences.scan(licences.suspects(odd)).count() == 0 and licences.scan(licences.suspects(none)).count() == 0


def test_licences_of_odd_rows(docs_of, tmp_path):
    line, long_ = "Licensed under CC BY-NC 4.0.", " ".join(f"w{i}" for i in range(50_000))
    df = docs_of((None, line), (1, line), (1, line), (2, None), (3, ""), (4, f"{long_}\n{line}\n{long_}"), (5, f"{long_} {line}"), extra=("row", "key", "unit", "TEXT_"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = licences.op9_licence_scan(df.sparkSession, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.licences) for r in rows) == [(0, "cc-by-nc"), (1, "cc-by-nc"), (1, "cc-by-nc"), (2, ""), (3, ""), (4, "cc-by-nc"), (5, "cc-by-nc")]


MIT_TEXT = """MIT License

Copyright (c) 2020 the authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."""
BSD_TEXT = """Some words on the program.
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""


def test_licences_of_wrapped_texts(docs_of, tmp_path):
    prose = "\n".join("the river ran slowly past an old mill where nobody had worked" for _ in range(30))
    both = "Licensed under the Apache License, Version 2.0 or licensed under the MIT License."
    nc = "Some words.\nLicensed under CC BY-NC 4.0.\nMore words."
    texts = [MIT_TEXT, MIT_TEXT.replace(" ", "\n"), BSD_TEXT, f"{prose}\n{BSD_TEXT}\n{prose}", both, prose, nc]
    df = docs_of(*enumerate(texts))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in licences.op9_licence_scan(df.sparkSession, str(tmp_path)).collect()}
    assert [rows[i].licences for i in range(len(texts))] == ["mit", "mit", "bsd", "bsd", "apache,mit", "", "cc-by-nc"]
    assert [rows[i].n_licence for i in (2, 3, 4, 5, 6)] == [1, 1, 2, 0, 1]
