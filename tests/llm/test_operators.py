"""Small cases of each operator against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import exact_dedup as dedup_module
from lodeseek.llm import html_text, jaccard
from lodeseek.llm.exact_dedup import exact_dedup
from lodeseek.llm.html_text import extract_text, main_text
from lodeseek.llm.jaccard import least_overlap, need, ngram_jaccard_join, ngram_jaccard_links, shingles
from lodeseek.llm.licences import NAMES, RULES, SENTENCES, STATED, TRIGGER, licence_scan
from lodeseek.llm.line_dedup import line_dedup
from lodeseek.llm.mixing import mix, mix_plan, source_targets
from lodeseek.llm.oracles import ORACLES
from lodeseek.llm.url_filters import url_filter, validity_intervals

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, kept boolean, block string, rank int"


def table(spark, rows):
    """Rows of (id, text, source) with other columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 0, 7, "r", True, "b", 1) for i, t, s in rows], DOCS)


LONG = " ".join(f"w{i}" for i in range(30_000))
MESSY = [(5, "same text here", "a"), (9, "same text here", "b"), (None, "same text here", None), (1, None, "a"), (2, "", None), (3, LONG, "a"), (4, LONG, "c"), (6, LONG + "!", "c"), (7, "é" * 3000, "b"), (8, "é" * 3000, "b"), (8, "é" * 3000, "b"), (10, " \t\n", "a")]


def test_exact_dedup(spark):
    got = exact_dedup(table(spark, MESSY), block_bytes=64).collect()
    groups = defaultdict(list)
    for i, t, _ in MESSY:
        groups[t or ""].append(i)
    want = Counter()
    for i, t, _ in MESSY:
        ids = groups[t or ""]
        want[(i, max(x for x in ids if x is not None), len(ids), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_hot_blocks_and_prefixes(spark):
    """Texts that share their first blocks with hundreds of others differ all the same."""
    rows = [(k, "x" * 256 + ("" if k % 2 else str(k % 5)), "a") for k in range(600)]
    got = {r.doc_id: r.keep_id for r in exact_dedup(table(spark, rows), block_bytes=64).collect()}
    best = {}
    for k, t, _ in rows:
        best[t] = max(best.get(t, -1), k)
    assert got == {k: best[t] for k, t, _ in rows}


def test_exact_dedup_does_not_rest_on_digests(spark, monkeypatch):
    """With a digest that different blocks share, names are looked up by content, and the result is the same."""
    docs = table(spark, MESSY)
    want = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs, block_bytes=64).collect())
    monkeypatch.setattr(dedup_module, "_digest", lambda block: F.unhex(F.substring(F.sha2(block, 256), 1, 2)))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs, block_bytes=64).collect()) == want


def shares(sizes, weights=(5, 2, 1)):
    """The process as it is stated: share, stop those above their cap, share the rest again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= set(over)
    return target | {s: left * weight[s] / total for s in open_}


@pytest.mark.parametrize("ranges", [1, 7])
def test_targets_of_many_sources(spark, ranges):
    """Thousands of sources with sizes of many orders, null and empty names, and sources without words."""
    rng = random.Random(ranges)
    sizes = {f"host{k}.{'é' * (k % 3)}": int(rng.paretovariate(0.4)) % 10**7 for k in range(3000)} | {None: 17, "": 5, "none": 0}
    sized = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {r.source: r for r in source_targets(sized).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = shares(sizes)
    assert {s: r.source_size for s, r in got.items()} == sizes
    assert all(got[s].target == pytest.approx(want[s], rel=1e-12) for s in sizes)
    assert source_targets(sized.limit(0)).count() == 0 and source_targets(sized.where("size = 0")).first().target == 0


def test_mixing(spark):
    random.seed(5)
    rows = [(k, "w " * random.randint(0, 40), random.choice(["a", "a", "a", "b", "c", None, "d"])) for k in range(900)]
    rows += [(None, "x y", "a"), (None, "x y", "a"), (7000, None, "zero"), (7001, LONG, "big")]
    plan = mix_plan(table(spark, rows)).select("id", F.col("row.source").alias("s"), "size", "source_size", "target", "copies").collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    # The process as it is stated: share, stop those above their cap, share the rest again.
    target, open_ = {}, set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= set(over)
    target |= {s: left * weight[s] / total for s in open_}
    assert len(plan) == len(rows)
    for r in plan:
        assert r.source_size == sizes[r.s] and r.target == pytest.approx(target[r.s]) and 0 <= r.copies <= 2
    assert sorted(map(repr, plan)) == sorted(map(repr, mix_plan(table(spark, rows).repartition(3)).select("id", F.col("row.source").alias("s"), "size", "source_size", "target", "copies").collect()))
    emitted = mix(table(spark, rows))
    assert emitted.columns == table(spark, []).columns and emitted.count() == sum(r.copies for r in plan)
    for s in ("a", "b"):
        taken = sum(r.copies * r.size for r in plan if r.s == s)
        assert abs(taken - target[s]) < 0.15 * sizes[s]


def brute_lines(rows):
    at = defaultdict(list)
    for i, t in rows:
        worded = [(k, x) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        for j in range(len(worded) - 2):
            at[tuple(x for _, x in worded[j : j + 3])].append(((i is not None, i or 0), worded[j][0], worded[j + 2][0], t))
    gone = defaultdict(set)
    for places in at.values():
        first = min(p[:2] for p in places)
        for key, a, b, t in places:
            if (key, a) != first:
                gone[key, t].update(range(a, b + 1))
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[(i is not None, i or 0), t]) for i, t in rows if t is not None}


def test_line_dedup(spark):
    random.seed(2)
    passage = ["one two", "three", "", "four five six", "seven"]
    rows = [(k, "\n".join([f"own {k}", *passage[: random.randint(2, 5)], f"end {k}"])) for k in range(30)]
    rows += [(100, "a\na\na\na\na"), (101, None), (102, ""), (103, "\n\n \n"), (104, "a\nb"), (None, "\n".join(passage)), (105, "\n".join(f"l{k}" for k in range(20_000))), (106, "l5\nl6\nl7\nnew"), (107, "q\nr\ns"), (107, "q\nr\ns"), (99, "q\nr\ns")]
    got = line_dedup(table(spark, [(i, t, "s") for i, t in rows])).select(F.col("row.doc_id").alias("i"), F.col("row.text").alias("t"), "clean", "n_lines", "n_removed").collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.clean == want.get((r.i, r.t)) and r.n_lines == len((r.t or "").split("\n"))


def brute_components(rows, words=5, percent=75):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    find = lambda k: k if root[k] == k else find(root[k])
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((rows[k][0], len(sets[k]), least.get(find(k))) for k in range(len(rows)))


def near_rows():
    random.seed(11)
    rows, n = [], 0
    for size in [1, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 18, 25, 40, 120]:
        base = [f"{random.choice('abcdefgh')}{random.randint(0, 999)}" for _ in range(size)]
        for _ in range(14):
            text = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
                k = random.randrange(len(text))
                text[k : k + 1] = random.choice([[], ["new" + str(random.randint(0, 99))], [text[k], "more"]])
                text = text or ["z"]
            rows.append((n, " ".join(text)))
            n += 1
    shared = " ".join(f"s{k}" for k in range(60))
    rows += [(1000 + k, shared + " " + " ".join(f"o{k}x{j}" for j in range(60))) for k in range(20)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "A B C D E F"), (2004, "a b\tc d\ne f"), (2005, "É f"), (2006, "é f"), (2007, LONG), (2008, LONG + " tail"), (None, LONG), (None, "lonely text of five words"), (2009, "one two"), (2009, "one two"), (2010, "two one")]
    return rows


def test_jaccard(spark):
    rows = near_rows()
    got = ngram_jaccard_join(table(spark, [(i, t, "s") for i, t in rows])).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_jaccard_bounds():
    for n in range(1, 40):
        for m in range(n, 60):
            least = next(i for i in range(0, 200) if 100 * i >= 75 * (n + m - i))
            assert need(n, m, 75) == least and (least > n or least >= max(least_overlap(n, 75), least_overlap(m, 75)))
    assert len(shingles("a b c d e f a b c d e f")) == 6 and len(shingles("a b")) == 1 and len(shingles(" ")) == 0


def hot_rows():
    """Near copies of one text that are each linked with some of the others only, apart by up to eight changed words; and unrelated texts around one common passage."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    common = [f"c{i}" for i in range(30)]
    rows = []
    for k in range(260):
        words = list(base)
        for at in rng.sample(range(120), rng.choice((1, 2, 3, 4, 5))):
            words[at] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(words)))
    for k in range(260, 420):
        # The passage and a few words of a small group: components of their own in the lists of the passage.
        own = [f"g{k // 4}-{j}" for j in range(5)] + [f"k{k % 4}"]
        rows.append((k, " ".join(common + own)))
    for k in range(420, 520):
        # Short texts that differ in the last word: few shingles to join, in long lists.
        rows.append((k, " ".join([*(f"t-{j}" for j in range(21)), f"s{k}"])))
    return rows


def brute_links(rows):
    sets = [set(shingles(t).tolist()) for _, t in rows]
    return [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


def test_jaccard_hot_lists(spark):
    """One hot token list of many components: results as by brute force, links from both sides, rows linear."""
    rows = hot_rows()
    docs = table(spark, [(i, t, "s") for i, t in rows])
    got = ngram_jaccard_join(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert sum(r.stays for r in got) == len({r.component_id for r in got})
    sides = Counter(r.side for r in ngram_jaccard_links(docs).collect())
    assert sides["subsets"] > 0 and sides["lists"] > 0
    # Far fewer than all pairs of the groups are looked at and linked.
    assert sum(sides.values()) < len(brute_links(rows)) / 3


def test_jaccard_every_boundary(spark, monkeypatch):
    """All sets heavy, some light, all light: the same components."""
    rows = hot_rows()[::3]
    docs = table(spark, [(i, t, "s") for i, t in rows])
    want = brute_components(rows)
    for size in (0, 4, 12, 1000):
        monkeypatch.setattr(jaccard, "_boundary", lambda lists, percent, size=size: size if size < 1000 else 30)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(docs).collect()) == want


def test_jaccard_stays(spark):
    """One row of each component stays; repeated rows are told by the stage, and texts without words stay all."""
    rows = [(4, "a b c d e f g h", "s"), (4, "a b c d e f g h", "s"), (9, "a b c d e f g h", "s"), (None, "a b c d e f g h", "s"), (1, "", "s"), (2, None, "s"), (4, "z y x w v u", "s"), (None, "q r s t u v", "s")]
    got = ngram_jaccard_join(table(spark, rows)).where("stays")
    assert Counter(r.doc_id for r in got.collect()) == Counter([4, 4, 4, 1, 2, None])
    assert got.select("mark").distinct().count() == 5


def test_packed_shingles():
    low, names = np.arange(70_000, dtype=np.uint32) * np.uint32(3), np.arange(70_000, dtype=np.uint64) << np.uint64(20)
    for size in (1, 1000, 70_000):
        back = jaccard._unpack(jaccard._pack(low[:size], names[:size]))
        assert (back[0] == low[:size]).all() and (back[1] == names[:size]).all()


def test_jaccard_class_names_are_spread():
    """Classes with small first bytes have names of their own, and no name is a count."""
    names = [jaccard._name(k.to_bytes(4, "little") + bytes(12)) for k in range(0, 1 << 16, 97)]
    assert len(set(names)) == len(names) and min(names) >= jaccard._COUNTS
    assert jaccard._COUNTS <= jaccard._name(b"\xff" * 16) < 1 << 64


def test_licences(spark):
    assert all(re.search(TRIGGER, s) for s in SENTENCES) and set(NAMES.values()) <= set(STATED)
    assert all(i in set(NAMES.values()) | set(SENTENCES.values()) for seq, _ in RULES for i in seq)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    rows = [
        (1, "Some text here.\nReleased under the MIT License.\nMore text.", "a"), (2, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "a"),
        (3, "This work is licensed under the GNU General Public License, version 3.", "a"), (4, "Licensed under CC BY-NC 4.0. All rights reserved.", "a"), (5, mit, "a"), (6, None, "a"), (7, "", "a"), (8, "No licence here, only a permit.", "a"),
        (9, "Released under the MIT License. Released under the MIT License. Licensed under CC BY 4.0.", "a"), (None, "released under gpl version 2", "a"), (10, LONG, "a"),
        (11, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "a"),
    ]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licence_scan(table(spark, rows)).collect()}
    want = {1: ["MIT"], 2: ["Apache-2.0"], 3: ["GPL-3.0-only"], 4: ["CC-BY-NC-4.0"], 5: ["MIT"], 6: [], 7: [], 8: [], 9: ["MIT", "CC-BY-4.0"], None: ["GPL-2.0-only"], 10: [], 11: ["BSD-2-Clause"]}
    assert {k: v[1] for k, v in got.items()} == want
    assert got[2][0] == ["apache-2.0", "apache-file"] and got[5][0] == ["mit-grant", "mit-notice"] and got[6][0] == []


def test_licences_reach_every_sentence_and_rule(spark):
    """Each known sentence and statement alone, with and without a subject, and the sentences of each rule in turn."""
    known = {s: i for s, i in SENTENCES.items()} | {f"released under the {s}": i for s, i in NAMES.items()} | {f"this work is licensed under {s}": i for s, i in NAMES.items()}
    text = {i: s for s, i in known.items()}
    rows = [(k, s.capitalize() + ".", "a") for k, s in enumerate(known)]
    rows += [(1000 + k, ". ".join(text[i].capitalize() for i in seq) + ".\n", "a") for k, (seq, _) in enumerate(RULES)]
    got = {r.doc_id: r for r in licence_scan(table(spark, rows)).collect()}
    assert {s: got[k].sentence_ids for k, s in enumerate(known)} == {s: [i] for s, i in known.items()}
    assert [(got[1000 + k].sentence_ids, got[1000 + k].licences) for k in range(len(RULES))] == [(seq, [licence]) for seq, licence in RULES]


APACHE = """Copyright 2020 A. Uthor

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program; if not, see <https://www.gnu.org/licenses/>.
"""
MIT = """MIT License

Copyright (c) 2020 A. Uthor

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
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licences_standard_headers(spark):
    """Headers as they are printed: wrapped lines, clauses, capitals and defined terms."""
    gpl = ["gpl-2+-grant", "gpl-warranty", "gpl-see", "gpl-copy"]
    want = {
        APACHE: (["apache-2.0", "apache-file", "apache-copy", "apache-basis", "apache-see"], ["Apache-2.0"]),
        GPL: (gpl, ["GPL-2.0-or-later"]),
        GPL.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3").replace("\n", "\r\n"): (["gpl-3+-grant", *gpl[1:]], ["GPL-3.0-or-later"]),
        MIT: (["mit-grant", "mit-notice", "mit-warranty"], ["MIT"]),
        MIT.replace(" ", "\n"): (["mit-grant", "mit-notice", "mit-warranty"], ["MIT"]),
        BSD: (["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], ["BSD-3-Clause"]),
        "Released under the GNU General Public License,\nVersion 3\nThanks to all": (["gpl-3"], ["GPL-3.0-only"]),
        "A page of mine\nReleased under the MIT License\nThanks to all": (["mit"], ["MIT"]),
        "Released under the GNU General Public License.\n\nVersion 2 of this page.": (["gpl"], ["GPL"]),
        "Released under the MIT License by some and not by others.": ([], []),
    }
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licence_scan(table(spark, [(k, t, "a") for k, t in enumerate(want)])).collect()}
    assert got == dict(enumerate(want.values()))


LGPL = GPL.replace("This program", "This library").replace("this program", "this library").replace("General", "Lesser General").replace("either version 2 ", "either version 2.1 ")
AGPL = GPL.replace("General", "Affero General").replace("Foundation; either version 2 ", "Foundation, either version 3 ").replace("free software; you", "free software: you")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0
"""
ISC = """Copyright (c) 2020, A. Uthor

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL DAMAGES.
"""
KERNEL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def commented(text, first, each, last):
    return first + "".join(each + line + "\n" for line in text.split("\n")) + last


def test_licences_of_files(spark):
    """Headers as files have them, plain and in comments, tags, and licence statements; Spark and DuckDB agree on all."""
    want = {
        LGPL: ["LGPL-2.1-or-later"], AGPL: ["AGPL-3.0-or-later"], MPL: ["MPL-2.0"], EPL: ["EPL-2.0"], ISC: ["ISC"], KERNEL: ["GPL-2.0-only"],
        GPL: ["GPL-2.0-or-later"], APACHE: ["Apache-2.0"], MIT: ["MIT"], BSD: ["BSD-3-Clause"],
        GPL.replace("This program is free", "Some Tool is free"): ["GPL-2.0-or-later"],
    }
    want |= {commented(t, *c): v for t, v in list(want.items()) for c in (("/*\n", " * ", " */\nint main;"), ("#!/bin/sh\n", "# ", "set -e"), ("", "// ", "\n#include <x>"))}
    want |= {
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
        "Licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": ["CC-BY-NC-ND-4.0"],
        "// SPDX-License-Identifier: MIT\n#include <x>": ["MIT"], "/* SPDX-License-Identifier: GPL-2.0 */ int a;": ["GPL-2.0-only"],
        "# SPDX-License-Identifier: (Apache-2.0 OR MIT)\nimport x": ["Apache-2.0", "MIT"], "SPDX-License-Identifier: LicenseRef-Own\nx": [],
        "A licence is a word. The license of the MIT press is another.": [],
    }
    docs = table(spark, [(k, t, "a") for k, t in enumerate([*want, None, ""])])
    got = {r.doc_id: r for r in licence_scan(docs).collect()}
    assert {k: sorted(got[k].licences) for k in range(len(want))} == dict(enumerate(want.values()))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    for doc_id, n, ids, licences in con.execute(ORACLES["op3_licences"]).fetchall():
        r = got[doc_id]
        assert (n, ids, licences) == (len(r.sentence_ids), ",".join(r.sentence_ids), ",".join(r.licences))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) { x("</p>") }</script></head><body class="no-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p>First <b>bold</b><br>para&nbsp;graph.</p>
<!-- note --><div class="ad-slot">Buy</div><p>Second &lt;one&gt; &eacute;.<ul><li>item one<li>item two</ul><form><input><button>Go</button></form><section id="comments"><p>Nice</p></section></article></main><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "Head & line\n\nFirst bold para graph.\n\nSecond <one> é.\n\nitem one\n\nitem two"
    assert main_text(PAGE) == want
    assert main_text(PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("<main>", "<div>").replace("</main>", "</div>")) == want
    assert main_text(PAGE[: PAGE.index("Second")] + "Cut <a hre") == "Head & line\n\nFirst bold para graph.\n\nCut"
    assert main_text(None) == main_text("") == main_text("<html><nav>x</nav></html>") == ""
    assert main_text("plain & simple") == "plain & simple" and main_text("<p>" + LONG) == LONG
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars long, text string")
    got = Counter(tuple(r) for r in extract_text(pages).collect())
    assert got == Counter({(1, "u", want, len(want)): 2, (None, None, "", 0): 1, (2, "v", "", 0): 1})


def test_html_unmarked_page_keeps_text_around_furniture():
    """Furniture of many blocks in the midst of a page without <article> or <main> parts its text; no part is lost."""
    advert = '<div class="related"><h3>More</h3><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div>'
    form = "<form class=newsletter><div><p>Join</p><p>Now</p><p>Here</p></div></form>"
    page = f"<html><body><div><h1>Head</h1><p>First part.</p>{advert}<p>Second and longer part.</p><p>More of it.</p>{form}<p>Last.</p></div><footer><p>x</p></footer></body></html>"
    assert main_text(page) == "Head\n\nFirst part.\n\nSecond and longer part.\n\nMore of it.\n\nLast."


def brute_stretches(counts, window):
    sums = [sum(counts[i : i + window]) for i in range(len(counts))]
    surge, edge = min(html_text.SURGE, max(sums, default=0) / 2), min(html_text.EDGE, max(counts, default=0))
    out, i = [], 0
    while i < len(sums):
        if sums[i] < surge or not surge:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j] >= surge / 4:
            j += 1
        full = [k for k in range(i, j) if counts[k] >= edge]
        out += [(full[0], full[-1] + 1)] if full else []
        i = j
    return out


def test_html_stretches():
    rng = random.Random(2)
    for _ in range(3000):
        counts = [float(rng.choice((0, 0, 2, 14, 19, 20, 25, 31, 79, 80, 300))) for _ in range(rng.randrange(14))]
        for window in (1, 3, 5):
            assert html_text.stretches(counts, window) == brute_stretches(counts, window)


FURNITURE = [
    '<div class="ad"><h3>Buy</h3><p>Now and at once, while stocks last in the shop.</p><p>Really.</p></div>',
    '<aside><p>Beside the text there is another text of some length to be read.</p><ul><li>a</li><li>b</li><li>c</li></ul></aside>',
    '<form class="newsletter"><p>Join</p><p>us</p><input></form>',
    '<div class="related"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></div>',
    "<nav><a href=/>Home</a><a href=/x>More</a></nav>",
    "<script>var a = '<p>no</p>';</script>",
]


def test_html_generated_pages():
    """Articles of long and short blocks with furniture between any two: all blocks stay and nothing else, marked or not."""
    rng = random.Random(7)
    for _ in range(300):
        blocks = [("h1", "A heading of the page")]
        for k in range(rng.randrange(1, 12)):
            tag = rng.choice(("p", "p", "p", "h2", "li", "blockquote"))
            blocks.append((tag, " ".join(f"w{k}{j}" for j in range(rng.choice((1, 2, 8, 30, 120))))))
        inner = ""
        for tag, text in blocks:
            inner += f"<{tag}>{text}</{tag}>" + (rng.choice(FURNITURE) if rng.random() < 0.3 else "")
        want = "\n\n".join(text for _, text in blocks)
        top, end = "<header><p>Site</p></header><nav><a href=/>Home</a></nav>", "<footer><p>Imprint</p></footer>"
        assert main_text(f"<html><body>{top}<article>{inner}</article><div>Read more here, on this and other pages of ours</div>{end}</body></html>") == want
        assert main_text(f"<html><body>{top}<div>Home</div><div>OK</div>{inner}<div>Top</div><div>OK</div>{end}</body></html>") == want


def test_html_weak_marks():
    """A block of prose whose class has a weak mark is text; a short one, or one with another mark, is none."""
    prose = "<h2>On search</h2>" + "".join(f"<p>{'Words about the subject of it all. ' * 8}{k}</p>" for k in range(3))
    other = "<div><p>" + "A text of the page itself. " * 10 + "</p></div>"
    for attrs, stays in (("search-results-essay", True), ("social-policy", True), ("form-and-content", True), ("cookie-notice", False), ("comments", False), ("related-form", False)):
        assert ("On search" in main_text(f"<body>{other}<div class={attrs}>{prose}</div></body>")) is stays, attrs
    assert "short" not in main_text(f"<body>{other}<div class=search-box><p>short</p></div></body>")


def test_html_marked_layouts_keep_the_article():
    """A layout wrapper whose class or id has a mark's word is no furniture; parts that are stay out."""
    nav, side = "<nav><a href=x>Menu</a></nav>", '<div class="sidebar"><article class="card"><h2>Card</h2><p>Teased.</p></article></div>'
    related = '<div class="related"><article class="card"><p>Other.</p></article></div><div class="comments"><p>Nice</p></div>'
    text = "<h1>Head</h1><p>First part of the text.</p><p>Second part of the text.</p>"
    want = "Head\n\nFirst part of the text.\n\nSecond part of the text."
    for attrs in ('class="layout has-sidebar"', 'id="content" class="with-sidebar"', 'class="post-content social"', 'class="no-ads"', "id=with-comments"):
        for inner in (f"<article>{text}</article>", f"<main>{text}</main>", text):
            cards = side + related if inner != text else '<div class="sidebar"><p>Side</p></div>'
            assert main_text(f"<html><body>{nav}<div {attrs}>{inner}{cards}</div><footer>x</footer></body></html>") == want, (attrs, inner)
            assert main_text(f"<html><body>{nav}<div {attrs}><div class='social'>{inner}</div></div>{cards}</body></html>") == want, (attrs, inner)
            assert main_text(f"<html><body>{nav}<div {attrs}>{inner}<div>{nav}</body></html>") == want, (attrs, inner)
    assert main_text(f"<body><article><div class='entry social'>{text}</div></article></body>") == want
    assert main_text(f"<body><div class='masthead'><h1>Site</h1></div><div class='has-sidebar'>{text}</div></body>") == want


def test_url_filter(spark):
    entries = spark.createDataFrame(
        [("l", "d:bad.com", "block", 10, "add"), ("l", "d:bad.com", "block", 20, "remove"), ("l", "d:bad.com", "block", 30, "add"), ("l", "p:bad.com/ok", "allow", 5, "add"), ("m", "d:sub.bad.com", "allow", 12, "add"),
         ("l", "d:tie.com", "block", 7, "add"), ("l", "d:tie.com", "block", 7, "remove"), ("l", None, "block", 1, "add"), ("n", "d:same.com", "allow", 1, "add"), ("m", "d:same.com", "block", 1, "add")],
        "list string, key string, verdict string, at int, action string",
    )
    assert validity_intervals(entries).count() == 6
    captures = [("http://bad.com/x", 9), ("http://bad.com/x", 10), ("http://u@WWW.bad.com:80/x", 19), ("http://bad.com/x", 20), ("http://bad.com/ok/y?z", 35), ("http://bad.com/okay", 35), ("https://a.sub.bad.com", 15), ("http://notbad.com/", 15),
                ("http://tie.com", 9), (None, 9), ("http://bad.com", None), ("nonsense", 15), ("http://bad.com/x", 10), ("http://same.com", 3)]
    want = [False, True, True, False, False, True, False, False, False, False, False, False, True, False]
    rows = spark.createDataFrame([(k, u, t, "x") for k, (u, t) in enumerate(captures)], "page_id int, url string, fetched int, key string")
    got = {r.i: r.blocked for r in url_filter(rows, entries).select(F.col("row.page_id").alias("i"), "blocked").collect()}
    assert got == dict(enumerate(want))
    assert url_filter(rows.limit(0), entries.limit(0)).count() == 0


def test_empty_tables(spark):
    none = table(spark, [])
    assert exact_dedup(none).count() == mix_plan(none).count() == line_dedup(none).count() == ngram_jaccard_join(none).count() == licence_scan(none).count() == 0
