import os
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")

from rankfold.llm import quality  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark, folder):
    """Good, bad, repeated and near-equal documents, with labels for some."""
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("aeioulnrst"), r.integers(2, 8)))
    shared = [" ".join(word() for _ in range(8)) for _ in range(12)]
    rows, labels = [], []
    for k in range(160):
        lines = [" ".join(word() for _ in range(int(r.integers(4, 12)))) for _ in range(int(r.integers(1, 9)))]
        if k % 4 == 3:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines]
        elif k % 5 == 0:
            lines += shared
        elif k % 5 == 1 and rows and rows[-1][1]:
            lines = [rows[-1][1].split("\n")[0] + " " + rows[-1][1].replace("\n", " ")]
        rows.append((k, "\n".join(lines), "en", "s", sum(map(len, lines)) + len(lines) - 1))
        labels.append((k, int(k % 4 != 3), 0))
    rows += [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (203, "a text <|endoftext|>with a  <|endoftext|><|endoftext|>\nmark", "en", "s", 54), (202, rows[0][1], "en", "s", rows[0][4])]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, labels


def brute_quality(rows, labels):
    label = {k: q for k, q, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1}
    ids = sorted(label)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    model = quality.fit(np.concatenate([quality.term_counts([texts[i]]) for i in ids]).astype(np.float32).astype(float), np.array([float(label[i]) for i in ids]))
    out = []
    for r in rows:
        counts = quality.term_counts([texts[r[0]]])
        if not counts.sum():
            score = model.prior
        else:
            cosine = (model.vectors.astype(float) @ model.latent(counts)[0].astype(float))
            near = np.argsort(-cosine)[: model.k]
            weight = np.maximum(cosine[near], 0) ** model.sharpness
            score = (weight * model.labels[near]).sum() / weight.sum()
        if score >= 0.5:
            out.append(r)
    return out


def brute_lines(rows):
    places, out = {}, []
    for r in sorted(rows):
        lines = (r[1] or "").split("\n")
        for i in range(len(lines) - 1):
            if "".join(lines[i : i + 2]).strip():
                places.setdefault("\n".join(lines[i : i + 2]), []).append((r[0], i))
    held = {(k, j) for (k, i), *more in places.values() if more for j in (i, i + 1)}
    cut = {(k, j) for _, *more in places.values() for k, i in more if not {(k, i), (k, i + 1)} & held for j in (i, i + 1)}
    for r in sorted(rows):
        lines = (r[1] or "").split("\n")
        gone = {i for i in range(len(lines)) if (r[0], i) in cut}
        text = r[1] if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((r[0], text, *r[2:4], len(text) if text is not None and text != r[1] else r[4]))
    return out


def brute_near(rows):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, part = [grams(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    least = {}
    for r, p in zip(rows, part):
        least[p] = min(least.get(p, r[0]), r[0])
    return [r for r, p in zip(rows, part) if r[0] == least[p]]


def test_each_stage_against_brute_force(spark, tmp_path):
    folder = str(tmp_path / "tables")
    os.makedirs(folder)
    rows, labels = fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = rows
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (lambda x: brute_quality(x, labels), brute_lines, brute_near)):
        docs = stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        want = brute(want)
        assert sorted(map(tuple, docs.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0]), name
    assert 60 < len(want) < 140
    packed = corpus_pipeline.pack(spark, docs, folder).toPandas()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in want:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        own = packed[packed.doc_id == r[0]].sort_values("piece")
        assert own.length.sum() == len(ids)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)]
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert packed.sequence_id.nunique() == -(-packed.length.sum() // 2048)
    run = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert run[key].sort_values(key).values.tolist() == packed[key].sort_values(key).values.tolist()
