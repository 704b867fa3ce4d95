import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.llm import byte_bpe, chat_format, exact_dedup, html_extract, license_scan, line_dedup, packing, pieces, quality

P = pytest.importorskip("public_tokenizers")
RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, id string, h string, n string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "id", "h", "n") for k, t in enumerate(texts)], DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# --- exact dedup


def dedup_brute(texts):
    lower = [(t or "").translate({k: k + 32 for k in range(65, 91)}) for t in texts]
    return sorted(((k, max(i for i, o in enumerate(lower) if o == t), lower.count(t), k == max(i for i, o in enumerate(lower) if o == t), hashlib.sha256(t.encode()).hexdigest()) for k, t in enumerate(lower)), key=str)


TEXTS = ["A b", "a B", None, "", "É", "é", "x" * 100_000, "X" * 100_000, "x" * 99_999, "Ärger Z", "ärger z", "Ärger z"] + ["hot"] * 40


def test_exact_dedup(spark):
    assert rows(exact_dedup.exact_dedup(docs(spark, TEXTS))) == dedup_brute(TEXTS)


def test_exact_dedup_compares_texts_behind_equal_hashes(spark):
    weak = {"hash_of": lambda c: F.length(c).cast("long") * 0 + 7, "digest_of": lambda c: F.substring(F.sha2(c, 256), 1, 1), "bucket_capacity": 1, "max_depth": 3}
    assert rows(exact_dedup.exact_dedup(docs(spark, TEXTS), **weak)) == dedup_brute(TEXTS)


def indexed(spark, texts, capacity, depth):
    table = docs(spark, texts).select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("digest"))
    slots, bits = exact_dedup.directory(table.select("h").distinct(), depth, capacity)
    return table.drop("body"), exact_dedup.build_index(table, slots, bits), slots, bits


def test_exact_dedup_splits_buckets(spark):
    texts = [f"text {k % 300}" for k in range(400)]
    _, index, slots, bits = indexed(spark, texts, 20, 10)
    sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 20 and sum(sizes) == 300
    assert slots.count() == 2**bits and slots.agg(F.count_distinct("bucket")).first()[0] >= len(sizes)
    assert rows(exact_dedup.exact_dedup(docs(spark, texts), bucket_capacity=20, max_depth=10)) == dedup_brute(texts)


def test_exact_dedup_finds_texts_by_the_directory(spark):
    """With two buckets exchanged in the directory, the rows of these find nothing; the others find what they did."""
    texts = [f"text {k % 300}" for k in range(400)]
    entries, index, slots, bits = indexed(spark, texts, 20, 10)
    index = index.cache()
    right = rows(exact_dedup.look_up(entries, index, slots, bits, 400), "id", "keep_id")
    assert right == sorted(((k, max(j for j in range(400) if j % 300 == k % 300)) for k in range(400)), key=str)
    a, b = [r["bucket"] for r in index.select("bucket").distinct().orderBy("bucket").limit(2).collect()]
    wrong = slots.withColumn("bucket", F.when(F.col("bucket") == a, F.lit(b)).when(F.col("bucket") == b, F.lit(a)).otherwise(F.col("bucket")))
    lost = index.where(F.col("bucket").isin(a, b)).agg(F.sum("group_size")).first()[0]
    found = rows(exact_dedup.look_up(entries, index, wrong, bits, 400), "id", "keep_id")
    assert len(found) == 400 - lost and set(found) < set(right)


def test_directory_doubles_only_where_needed():
    assert exact_dedup.fold_directory({0: 5, 1: 5, 7: 1}, 3, 100) == [(0, 0)]
    assert sorted(exact_dedup.fold_directory({0: 5, 1: 5, 7: 1}, 3, 6)) == [(1, 1), (2, 1), (3, 0), (3, 1)]
    assert exact_dedup.fold_directory({}, 3, 1) == [(0, 0)]


def test_exact_dedup_of_nothing(spark):
    assert rows(exact_dedup.exact_dedup(docs(spark, []))) == []


# --- licence scan


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    texts = [mit, "x. Licensed under the Apache License, Version 2.0.", "Released under the MIT License. y\nAll rights reserved!", "license", None, "", "word " * 50_000 + "\nLicensed under CC BY-NC 4.0."]
    got = {r["doc_id"]: (r["sequence"], r["rule"], r["license"], r["all_licenses"]) for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert got[0] == ("MIT2|MIT3|ASIS", "mit-full", "MIT", "MIT")
    assert got[1] == ("APA1", "apache-2-line", "Apache-2.0", "Apache-2.0")
    assert got[2] == ("MIT1|ARR1", "mit-line", "MIT", "MIT,proprietary")
    assert got[3] == got[4] == got[5] == ("", None, None, "")
    assert got[6][2] == "CC-BY-NC-4.0"
    assert rows(license_scan.license_scan(docs(spark, []))) == []


PUBLISHED = {
    "mit-full": """Copyright (c) 2020 A Name

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.""",
    "apache-2-header": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.""",
    "gpl-3-notice": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-2-notice": """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License along
    with this program; if not, write to the Free Software Foundation, Inc.,
    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "mpl-2-line": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "gpl-3-reserved": "This work is licensed under the GNU General Public\nLicense version 3. All rights\nreserved.",
    "apache-2-line": "Licensed under the Apache License,\nVersion 2.0.",
    "mit-line": "This project is licensed under\nthe MIT License.",
    "gpl-3-line": "This work is licensed under the GNU General\nPublic License, version 3.",
    "cc-by-nc-4-line": "This work is licensed under\nCC BY-NC 4.0.",
    "cc-by-sa-4-line": "Licensed under\nCC BY-SA 4.0.",
    "cc-by-4-line": "This work is licensed under\nCC BY 4.0.",
    "reserved": "Copyright 2020 A Name. All rights\nreserved.",
    "lgpl-2.1-notice": """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version. */""",
    "lgpl-3-notice": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU Lesser General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "agpl-3-notice": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    You should have received a copy of the GNU Affero General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "isc-permission": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "0bsd-permission": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.""",
    "zlib-full": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "unlicense-full": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "boost-full": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:""",
    "boost-line": "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file.)",
    "epl-2-notice": """ * This program and the accompanying materials are made available under the
 * terms of the Eclipse Public License v. 2.0 which is available at
 * https://www.eclipse.org/legal/epl-2.0.""",
    "cc0-line": "This work is licensed under CC0 1.0.",
}
PUBLISHED |= {f"spdx-{name.lower()}": f"# SPDX-License-Identifier: {name}" for name in license_scan.SPDX}
PUBLISHED["agpl-3-terms"] = PUBLISHED["agpl-3-notice"].split("\n\n")[0]
PUBLISHED["zlib-permission"] = PUBLISHED["zlib-full"].split("\n\n")[1]
PUBLISHED["unlicense-line"] = PUBLISHED["unlicense-full"].split("\n\n")[0]
PUBLISHED["gpl-3-terms"], PUBLISHED["gpl-2-terms"] = (PUBLISHED[k].split("\n\n")[0] for k in ("gpl-3-notice", "gpl-2-notice"))
PUBLISHED["bsd-2-clause"] = PUBLISHED["bsd-3-clause"].split("\n\n3.")[0]
PUBLISHED["mit-permission"] = PUBLISHED["mit-full"].split("\n\nThe above")[0]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_license_rules_by_their_published_texts(spark, end):
    assert set(PUBLISHED) == {rule for rule, _, _ in license_scan.RULES}
    texts = [f"A line before it\n\n{t}\n\nA line after it".replace("\n", end) for t in PUBLISHED.values()]
    got = {r["doc_id"]: r["rule"] for r in license_scan.license_scan(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == list(PUBLISHED)


def test_license_sql_finds_the_same_in_wrapped_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from rankfold.llm import oracles

    texts = [*PUBLISHED.values(), "\n\n".join(PUBLISHED.values()), None, "", *(t.replace("\n", "\r\n") for t in PUBLISHED.values()), *(t.replace(" ", "  \t") for t in PUBLISHED.values())]
    df = docs(spark, texts).select("doc_id", "text")
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    got = license_scan.license_scan(df)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.oracle_sql()['op1_license_scan']})").fetchall()
    assert rows(got) == sorted(want, key=str)


def test_license_sentences_must_be_whole(spark):
    wrapped = [r["license"] for r in license_scan.license_scan(docs(spark, [f"This is free and unencumbered software released into the public{gap}domain." for gap in (" ", "\n", "  ", "\n# ")])).orderBy("doc_id").collect()]
    assert wrapped == ["Unlicense"] * 4
    texts = ["Not all rights\nreserved.", "All rights\nreserved here.", "All rights. No, reserved.", "All" + " " * 5000 + "rights reserved."]
    assert [r["sequence"] for r in license_scan.license_scan(docs(spark, texts)).orderBy("doc_id").collect()] == ["", "", "", "ARR1"]


# --- chat formatting


def test_chat_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "end")]
    logged = {1: a[:2], 2: a, 3: a[:3], 4: a, 5: [("user", "hi")], 6: [("user", "hi"), ("assistant", "no")], 7: [(None, None)], 8: [("user", "hi")] * 3}
    table = [(c, k, r, t, "x") for c, turns in logged.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "hi", "x")]
    got = {r["conv_id"]: r for r in chat_format.format_chats(spark.createDataFrame(table, "conv_id long, turn int, role string, text string, chat string")).collect()}
    assert sorted(got) == [2, 6, 7, 8]
    assert got[2]["n_copies"] == 2 and got[2]["n_turns"] == 4
    assert got[2]["chat"] == "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in a)
    assert got[7]["chat"] == "<|unknown|>\n<|end|>\n"


def test_chat_orders_turns_and_takes_an_empty_table(spark):
    schema = "conv_id long, turn int, role string, text string"
    got = chat_format.format_chats(spark.createDataFrame([(1, 5, "b", "y"), (1, None, "a", "x"), (1, 5, "a", "z")], schema)).collect()
    assert [r["chat"] for r in got] == ["<|a|>\nx<|end|>\n<|a|>\nz<|end|>\n<|b|>\ny<|end|>\n"]
    assert chat_format.format_chats(spark.createDataFrame([], schema)).collect() == []


# --- line dedup


def without_repeated_runs(texts, n):
    """Of each run of n lines that occurs more than once the first copy's lines are held, then every other copy goes that has none of these."""
    places, out = {}, []
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        for i in range(len(lines) - n + 1):
            if "".join(lines[i : i + n]).strip():
                places.setdefault(tuple(lines[i : i + n]), []).append((d, i))
    held = {(d, i + j) for (d, i), *more in places.values() if more for j in range(n)}
    copies = [[(d, i + j) for j in range(n)] for _, *more in places.values() for d, i in more]
    cut = {x for run in copies if not held.intersection(run) for x in run}
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        gone = {i for i in range(len(lines)) if (d, i) in cut}
        out.append((t if t is None or not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_line_dedup_takes_whole_passages(spark):
    passages = [[f"passage {n}.{j}" for j in range(n)] for n in range(2, 7)]
    texts = ["\n".join([f"before {k} {n}", *p, f"after {k} {n}"]) for k in range(4) for n, p in enumerate(passages)]
    texts += ["\n".join(p) for p in passages] + ["A\nB\nC", "x\nB\nC\nD", "C\nD\ny", None, "", "\n\n\n", "\n\n\n", "one", "one", "z\n" * 5000]
    for n in (2, 3):
        found = line_dedup.line_dedup(docs(spark, texts).repartition(3), min_lines=n)
        assert found.columns == ["doc_id", "text", "id", "h", "n", "n_runs", "n_repeated", "lines_removed"]
        got = {r["doc_id"]: r for r in found.collect()}
        assert [(got[k]["text"], got[k]["lines_removed"]) for k in range(len(texts))] == without_repeated_runs(texts, n)
        if n == 2:
            assert all(got[k]["text"] == f"before {k // 5} {k % 5}\nafter {k // 5} {k % 5}" for k in range(5, 20))
    assert rows(line_dedup.line_dedup(docs(spark, []))) == []


def test_line_dedup_loses_no_passage(spark):
    """Every two lines in a row that the input has twice still stand somewhere, whatever overlaps."""
    r = random.Random(12)
    texts = ["P\nQ", "P\nQ\nR\nZ", "X\nQ\nR", "ha\nha\nha\nend"] + ["\n".join(r.choice("abcdefg") * r.randint(1, 2) for _ in range(r.randint(0, 12))) for _ in range(150)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.line_dedup(docs(spark, texts).repartition(3)).collect()}
    assert [got[k] for k in range(3)] == ["P\nQ", "P\nQ\nR\nZ", "X"]
    pairs = lambda t: [p for x in t for p in zip(x.split("\n"), x.split("\n")[1:]) if "".join(p)]
    before, after = pairs(texts), set(pairs(got.values()))
    assert all(p in after for p in before if before.count(p) > 1)
    assert sum(map(len, got.values())) < 0.9 * sum(map(len, texts))


def test_line_dedup_on_a_hot_passage(spark):
    r = random.Random(4)
    texts = ["\n".join([*(f"own {k} {j}" for j in range(r.randint(0, 9))), "shared 1", "shared 2", "shared 3"]) for k in range(600)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs(spark, texts).repartition(5)).collect()}
    assert [got[k] for k in range(600)] == [t for t, _ in without_repeated_runs(texts, 2)]


def test_line_dedup_of_repeated_rows_null_ids_and_clashing_columns(spark):
    """Rows with one id and text: the first keeps its lines, whichever it is.  Columns named like results go."""
    same = "a line\nof two\nof three"
    table = [(1, same, "x", 5), (1, same, "y", 5), (2, same, "z", 5), (1, "other\nof two\nof three", "w", 5), (None, "a line\nof two", "v", 5)]
    got = line_dedup.line_dedup(spark.createDataFrame(table, "doc_id long, text string, no string, N_RUNS int"))
    assert got.columns == ["doc_id", "text", "no", "n_runs", "n_repeated", "lines_removed"]
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert [r[1] for r in found if r[0] is None] == ["a line\nof two"]  # comes first
    assert [r[1] for r in found if r[0] == 2] == [""]
    assert sum("of three" in r[1] for r in found) == 1 and all(r[1] in ("", same, "other", "other\nof two\nof three") for r in found if r[0] == 1)
    again = line_dedup.line_dedup(spark.createDataFrame([(1, "p\nq\nr")] * 3, "doc_id long, text string")).collect()
    assert sorted((r["text"], r["n_repeated"]) for r in again) == [("", 2), ("", 2), ("p\nq\nr", 0)]


# --- BPE


AWKWARD = [None, "", " ", "  a", "it's we'll 'tis 'S x'", "a\n\n b\t\tc  ", "naïve 漢字 😀　\xa0x", "\0 a\0b \0\0", "1a2 3４", "word " * 3000, "x" * 5000, "<|endoftext|>", "a  \r\n  b", "'re", "''s", "!'s", "́é"]


def awkward(n=400):
    r = random.Random(2)
    letters = "ab'stmdrevlL  \n\t1٣é.!_,\x00　\xa0漢😀"
    return AWKWARD + ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("stable", [True, False])
def test_bpe_round_trip_and_library(spark, monkeypatch, stable, tmp_path):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "CHUNK", 2000)
    texts = awkward()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pieces.load_ranks(RANKS), special_tokens={})
    table = docs(spark, texts).repartition(3)
    if stable:
        table.write.parquet(str(tmp_path / "t"))
        table = spark.read.parquet(str(tmp_path / "t"))
    encoded = byte_bpe.encode(table, RANKS, decoded=True, stable=stable).withColumnRenamed("decoded", "by_word")
    got = {r["doc_id"]: r for r in byte_bpe.decode(encoded, RANKS).collect()}
    for k, t in enumerate(texts):
        assert got[k]["ids"] == library.encode_ordinary(t or ""), repr(t)
        assert bytes(got[k]["decoded"]).decode() == bytes(got[k]["by_word"]).decode() == (t or "")
    assert rows(byte_bpe.encode(docs(spark, []), RANKS)) == []


def test_bpe_fails_where_texts_change_between_readings(spark):
    def restless(batches):
        for pdf in batches:
            yield pdf.assign(text=[f"{t} {random.SystemRandom().random()}" for t in pdf["text"]])

    table = docs(spark, ["a b", "c d", "e f g"]).select("doc_id", "text").mapInPandas(restless, "doc_id long, text string")
    with pytest.raises(Exception, match="twice"):
        byte_bpe.encode(table, RANKS).collect()


def test_bpe_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    got = byte_bpe.encode(df, RANKS).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in got) == [(0, 2), (3, 2), (3, 2)]


# --- packing


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    texts = awkward(60) + ["hello <|endoftext|> world", "<|endoftext|>", " <|endoftext|><|endoftext|>\n\n x", "<|endoftext", "a'<|endoftext|>s  "]
    got = packing.pack_documents(docs(spark, texts).repartition(2), JSON, capacity=64, group=50).toPandas()
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == k].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own)))
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids)
        assert own.length.max() <= 64 and (len(own) == 1 or own.length.iloc[1:].eq(64).all())
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert rows(packing.pack_documents(docs(spark, []), JSON)) == []


def test_local_search_only_gains():
    r = random.Random(7)
    for _ in range(60):
        lengths = [r.choice([r.randint(1, 30), r.randint(20, 64)]) for _ in range(r.randint(1, 80))]
        first = packing.best_fit(lengths, 64)
        square = sum(sum(lengths[i] for i in b) ** 2 for b in first)
        better = packing.improve([list(b) for b in first], lengths, 64)
        assert sorted(i for b in better for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 64 for b in better)
        assert len(better) <= len(first) and sum(sum(lengths[i] for i in b) ** 2 for b in better) >= square


def test_local_search_empties_a_bin():
    lengths = [6, 4, 5, 5, 3, 4, 3]  # 30 in bins of 10: three will do
    assert len(packing.improve([[0, 4], [2, 1], [5, 6], [3]], lengths, 10)) == 3


def test_local_search_exchanges_any_two_of_a_bin():
    """No piece fits a gap of 9, and only 15 and 16 for 26 gains; 24 shorter pieces lie in their bin."""
    groups = [[10] * 24 + [15, 16]] + [[26, 265]] * 32
    lengths, bins = [n for g in groups for n in g], []
    for g in groups:
        bins.append(list(range(sum(map(len, bins)), sum(map(len, bins)) + len(g))))
    better = packing.improve([list(b) for b in bins], lengths, 300)
    assert sorted(i for b in better for i in b) == list(range(len(lengths)))
    assert [10, 10, 15, 265] in [sorted(lengths[i] for i in b) for b in better]  # then 16 goes back for two of 10


def fewest_bins(lengths, capacity):
    best = [len(lengths)]

    def go(k, fills):
        if len(fills) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(fills)
            return
        for i, fill in enumerate(fills):
            if fill + lengths[k] <= capacity and fill not in fills[:i]:
                go(k + 1, [*fills[:i], fill + lengths[k], *fills[i + 1 :]])
        go(k + 1, [*fills, lengths[k]])

    go(0, [])
    return best[0]


def test_local_search_saves_bins_that_best_fit_needs():
    assert len(packing.best_fit([5, 4, 4, 3, 2, 2], 10)) == 3
    assert len(packing.improve(packing.best_fit([5, 4, 4, 3, 2, 2], 10), [5, 4, 4, 3, 2, 2], 10)) == 2
    r = random.Random(1)
    saved = 0
    for _ in range(300):
        lengths = [r.randint(2, 14) for _ in range(r.randint(1, 10))]
        first, least = packing.best_fit(lengths, 20), fewest_bins(sorted(lengths, reverse=True), 20)
        better = packing.improve([list(b) for b in first], lengths, 20)
        assert packing.least_bins(np.array(lengths), 20) <= least <= len(better) <= len(first)
        saved += len(first) - len(better)
    assert saved > 0
    thirds = [int(r.gauss(700, 120)) for _ in range(2000)]
    assert len(packing.improve(packing.best_fit(thirds, 2048), thirds, 2048)) < len(packing.best_fit(thirds, 2048))


def test_packing_hot_id_and_repeated_rows(spark):
    rows_ = [(7, "a b c d"), (None, None)] * 300 + [(7, "x " * 700)] * 3
    got = packing.pack_documents(spark.createDataFrame(rows_, "doc_id long, text string"), JSON, capacity=64, group=64).toPandas()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
    assert got.sequence_id.nunique() == -(-got.length.sum() // 64)
    assert got.doc_id.isna().sum() == 300


def test_tokens_of_words_with_equal_polynomials(spark):
    """A word of a Thue-Morse sequence and its complement have one value under any polynomial modulo 2**64."""
    import tiktoken
    from tokenizers import Tokenizer

    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    texts = [word, word.translate({97: 98, 98: 97}), f"x {word}"]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pieces.load_ranks(RANKS), special_tokens={})
    got = byte_bpe.encode(docs(spark, texts).coalesce(1), RANKS, decoded=True).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [enc.encode_ordinary(t) for t in texts]
    assert [bytes(r["decoded"]).decode() for r in got] == texts
    library = Tokenizer.from_file(JSON)
    packed = {r["doc_id"]: r["ids_crc32"] for r in packing.pack_documents(docs(spark, texts).coalesce(1), JSON).collect()}
    assert packed == {k: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for k, t in enumerate(texts)}


# --- quality


def test_quality_held_out_accuracy(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    texts, marks = [], []
    for k in range(400):
        words = [word() for _ in range(60)]
        good = k % 3 > 0
        texts.append(" ".join(words) + "." if good else [" ".join(w.upper() + "!!" for w in words), " ".join(w for w in words for _ in range(8))][k % 2])
        marks.append((k, int(good)))
    texts += [None, "", "a", "z " * 30_000]
    labels = spark.createDataFrame([*marks, (None, 1), (1, None), (2, 1)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.quality(docs(spark, texts), labels, fit_rows=200).collect()}
    assert len(got) == len(texts)
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    held = [(k, m) for k, m in marks if got[k]["held_out"]]
    assert len(held) > 80 and np.mean([got[k]["predicted"] == m for k, m in held]) > 0.97
    assert all(0 <= x["score"] <= 1 for x in got.values()) and got[400]["score"] == got[401]["score"]


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x["score"] for x in quality.quality(docs(spark, ["a b c"]), none).collect()] == [0.5]
    assert quality.quality(docs(spark, []), none).collect() == []


def test_quality_tells_vocabularies_apart(spark):
    """Texts of one shape whose only difference is their words: held-out texts are told apart."""
    r = random.Random(5)
    lists = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n % 6 + 3)) for n in range(150)] for _ in range(2)]
    texts = [" ".join(r.choice(lists[k % 2]) for _ in range(60)) for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, quality int")
    got = [x for x in quality.quality(docs(spark, texts), labels).collect() if x["held_out"]]
    assert len(got) > 60 and np.mean([x["predicted"] == x["doc_id"] % 2 for x in got]) > 0.95


def test_quality_votes_like_a_plain_search(spark):
    """Scores against one text at a time, one neighbour at a time, on the same latent vectors; the operator's own included."""
    r = random.Random(6)
    texts = [" ".join(r.choice(("ab", "cd", "EF!", "g1", "h,")) * r.randint(1, 3) for _ in range(r.randint(1, 40))) for _ in range(120)]
    marks = [(k, int(r.random() < 0.5)) for k in range(120)]
    used = sorted((k for k, _ in marks if zlib.crc32(str(k).encode()) % 3 != 1), key=str)
    model = quality.fit(np.concatenate([quality.term_counts([texts[k].encode()]) for k in used]).astype(np.float32), np.array([float(marks[k][1]) for k in used]))
    got = {x["doc_id"]: x["score"] for x in quality.quality(docs(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    for k, t in enumerate(texts):
        z = model.latent(quality.term_counts([t.encode()]))[0].astype(float)
        near = sorted(((sum(a * b for a, b in zip(z, v)), y) for v, y in zip(model.vectors.astype(float), model.labels)), reverse=True)
        weights = [(max(c, 0.0) ** model.sharpness, y) for c, y in near[: model.k]]
        if near[model.k - 1][0] - near[model.k][0] > 1e-4:
            assert abs(got[k] - sum(w * y for w, y in weights) / sum(w for w, _ in weights)) < 1e-3


def test_quality_takes_clashing_columns_and_ids_of_text(spark):
    table = [("a", "x y z", 0.1, True, "r"), ("a", "x y z", 0.2, False, "s"), ("b", None, 0.3, True, "t"), (None, "q", 0.4, True, "u")]
    df = spark.createDataFrame(table, "doc_id string, text string, score double, PREDICTED boolean, `row` string")
    got = quality.quality(df, spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "doc_id string, quality int"))
    assert got.columns == ["doc_id", "text", "row", "held_out", "score", "predicted"]
    assert sorted(x["row"] for x in got.collect()) == ["r", "s", "t", "u"] and len({x["score"] for x in got.where("doc_id = 'a'").collect()}) == 1
    empty = quality.quality(df, spark.createDataFrame([], "doc_id string, quality int"))
    assert {x["score"] for x in empty.collect()} == {0.5}


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now, it is good.</div><header>Site</header>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>
 text&nbsp;here.<p>Second, after a <br>break &lt;tag&gt;.</p><aside>Side note.</aside><form>Name <input></form></article>
<section id="comments"><p>A reader's comment, quite long, with marks.</p></section><footer>&copy; us</footer></body></html>"""


def test_html_main_part():
    assert html_extract.main_text(PAGE) == "Title & more First bold text here. Second, after a break <tag>."


def test_html_without_main_part_uses_ratios():
    body = "".join(f"<p>A long paragraph number {k}, with some marks, and an end. It goes on, and on, for a while.</p>" for k in range(8))
    page = f"<body><div><a>x</a></div><ul><li>One</li><li>Two</li><li>Six</li></ul><table><tr><td>a</td><td>b</td><td>c</td></tr></table><div>{body}</div></body>"
    text = html_extract.main_text(page)
    assert "number 0," in text and "number 7," in text and "One" not in text


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- x", "<script>x", "</p></b>", "&amp", "<p a='>'>x</p>", "<div " * 500, "<div>" * 3000 + "x"])
def test_html_awkward_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_html_operator(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = rows(html_extract.extract(df))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, "u", 63), (1, "u", 63), (2, None, 0)]
    assert html_extract.extract(df.limit(0)).collect() == []


BODY = "".join(f"<p>A long paragraph number {k}, with some marks, and an end. It goes on, and on, for a while, until it stops.</p>" for k in range(8))


@pytest.mark.parametrize(
    "around",
    [
        "<div>%s</div><article><h3>Teaser</h3><div>Read on</div></article><article><h3>Another</h3><div>More</div></article>",
        "<article><h3>Teaser</h3><div>Read on</div></article><div>%s</div>",
        "<div>%s</div><article class='comment'><p>A reader's comment, quite long, with marks, and more marks, which goes on, and on, for a while.</p></article>",
        "<div>%s</div><article id='comment-12'><p>A reader's comment, quite long, with marks, and more marks, which goes on, and on, for a while.</p></article>",
        "<article class='post tag-news has-sidebar'>%s<div><div>Buy now</div><div>Click</div><div>Only today</div><div>Sale</div></div></article>",
        "<main><div>%s</div><ul><li>Buy now</li><li>Click</li><li>Only today</li><li>Sale</li></ul></main>",
        "<article>%s</article><ul><li>Buy now</li><li>Click</li><li>Only today</li><li>Sale</li></ul>",
    ],
)
def test_html_ratios_decide_beside_and_inside_articles(around):
    text = html_extract.main_text(f"<body>{around % BODY}</body>")
    assert all(f"number {k}," in text for k in range(8))
    assert not any(word in text for word in ("Teaser", "Read on", "More", "reader's", "Buy now", "Only today", "Sale"))


def test_html_paragraph_ends_at_the_next_behind_an_open_inline_element():
    assert [path for path, *_ in html_extract._blocks("<body><p><b>One.<p>Two.<p>Three.</body>")] == ["body/p"] * 3


SENTENCE = "Such work goes on, and on, as others have said, and it will end, some day, in a sentence like this one."


@pytest.mark.parametrize("inner", [f'<div class="related work"><p>{SENTENCE}</p></div>', f'<p class="search-results">{SENTENCE}</p>', f"<p>{SENTENCE} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>"])
def test_html_names_do_not_silence_an_article(inner):
    text = html_extract.main_text(f"<body><article>{BODY}{inner}{BODY}</article></body>")
    assert text.count("number 0,") == 2 and SENTENCE in text and ("math" not in inner or f"{SENTENCE} x=1" in text)


def test_html_link_list_inside_an_article_goes():
    links = "<ul><li><a href='/'>Home</a></li><li><a href='/l'>Login</a></li><li><a href='/m'>More</a></li></ul>"
    assert not {"Home", "Login"} & set(html_extract.main_text(f"<body><article>{links}{BODY}{links}</article></body>").split())


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "comments", "sidebar_left"])
def test_html_named_furniture_goes_even_if_long(name):
    page = f"<body><div>{BODY}</div><div class='{name}'>{'<p>' + SENTENCE * 9 + '</p>'}{BODY.replace('number', 'remark')}</div></body>"
    text = html_extract.main_text(page)
    assert all(f"number {k}," in text for k in range(8)) and "remark" not in text and SENTENCE not in text
    alone = html_extract.main_text(f"<body><div class='{name}'>{BODY}</div></body>")  # a name is no veto
    assert all(f"number {k}," in alone for k in range(8))


def test_html_ratios_find_what_no_name_tells():
    text = "".join(f"<p>{SENTENCE * 3}</p>" for _ in range(4))
    advert, teaser = "<div>Buy two lamps now.</div>", "<article><p>Read on here.</p></article>"
    for page in (f"<article><h1>A title of some words</h1>{text}</article>{teaser}", f"{advert}<article>{text}</article>", f"<main>{text}</main>{advert}{teaser}"):
        got = html_extract.main_text(f"<body>{page}</body>")
        assert got.count(SENTENCE.strip()) == 12 and "lamps" not in got and "Read on" not in got
    assert "A title of some words" in html_extract.main_text(f"<body><article><h1>A title of some words</h1>{text}</article>{teaser}</body>")


def ratios_by_hand(blocks, spread=1.0, share=0.3):
    """The definition, block by block and in plain sums."""
    def per_path(count):
        return [sum(count(o) for o in blocks if (o[0], *o[2:4]) == (b[0], *b[2:4])) for b in blocks]

    nodes = per_path(lambda _: 1)
    text = [t / n for t, n in zip(per_path(lambda b: b[4]), nodes)]
    marks = [(1 + t) / n for t, n in zip(per_path(lambda b: sum(c in ".,;:!?…。，；：！？、" for c in b[1])), nodes)]
    runs, fused = [], []
    for k, b in enumerate(blocks):
        runs.append(runs[-1] + (blocks[k - 1][2:4] != b[2:4]) if k else 0)
    weigh = [np.exp(-0.5 * (d / spread) ** 2) for d in range(-3, 4)]
    for k in range(len(blocks)):
        first, last = runs.index(runs[k]), len(runs) - 1 - runs[::-1].index(runs[k])
        near = [min(max(k + d, first), last) for d in range(-3, 4)]
        fused.append(np.prod([sum(w * r[j] for w, j in zip(weigh, near)) / sum(weigh) for r in (text, marks)]) ** 0.5)
    plain = [f for f, b in zip(fused, blocks) if b[3] == 1.0] or [f * b[3] for f, b in zip(fused, blocks)]
    bound = share * sum(plain) / len(plain)
    a_main = any(b[2] for b in blocks)
    fused = [f * b[3] * (1.0 if b[2] or not a_main else 1 / 3) for f, b in zip(fused, blocks)]
    same = lambda b: [f for f, o in zip(fused, blocks) if (o[0], *o[2:4]) == (b[0], *b[2:4])]
    return " ".join(b[1] for b in blocks if sum(same(b)) / len(same(b)) >= bound)


def test_html_against_ratios_by_hand():
    r = random.Random(8)
    tags, names = ["div", "p", "ul", "li", "h2", "section", "article", "td", "a"], ["", "", "", " class='ad'", " class='related'", " id='x'"]

    def made(depth):
        if not depth or r.random() < 0.3:
            return " ".join(r.choice(["word", "and, so", "end.", "x"]) for _ in range(r.choice([1, 3, 12, 60])))
        return "".join(f"<{t}{r.choice(names)}>{made(depth - 1)}</{t}>" for t in (r.choice(tags) for _ in range(r.randint(1, 5))))

    pages, decided = [f"<body>{made(4)}</body>" for _ in range(150)], 0
    for page in pages:
        blocks = html_extract._blocks(page)
        assert html_extract.main_text(page) == (ratios_by_hand(blocks) if blocks else "")
        decided += html_extract.main_text(page) != " ".join(b[1] for b in blocks)
    assert decided > 30
