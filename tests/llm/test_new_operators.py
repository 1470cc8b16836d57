"""Spelling variants, the Merkle manifest and near-duplicate vectors on odd rows and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, embedding_dedup, merkle, mixing, ngram_join, spelling, tokens
from tidemark.session import new_path

UPPER = {i: i + 32 for i in range(65, 91)}


def edits_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k + 1:] == b[k:] or a[k:] == b[k + 1:]


def variants_by_force(counts):
    near = {w: [v for v in counts if edits_one(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def corpus(seed):
    rnd, texts = random.Random(seed), []
    roots = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(7, 9))) for _ in range(30)] + ["aaaaaaaa", "aaaaaaaaa", "a" * 3000]
    for root in roots:
        for word, n in ((root, 60), (root[1:], 3), (root[:3] + "x" + root[3:], 5), (root[:-1] + "z", 2), (root + "ÿ", 70), (root[:2] + root[2:4].upper() + root[4:], 4)):
            texts += [word] * n
    rnd.shuffle(texts)
    return [" ".join(texts[i:i + 50]) + ".,1" for i in range(0, len(texts), 50)]


def test_variants_against_brute_force(spark):
    texts = [*corpus(3), None, "", "short words only", "Straße×straße÷x"]
    rows = [*((i, t, "x") for i, t in enumerate(texts)), (None, texts[0], "x"), (0, texts[0], "x")]
    counts = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    want = variants_by_force({w: n for w, n in counts.items() if n >= 2})
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    path = new_path(spark, "variants")
    docs.write.parquet(f"{path}/documents.parquet")
    got = spelling.op11_spelling_variants(spark, path).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(x[2] not in (x[0], x[1]) for x in want) or any(x[1] for x in want)


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    rnd = random.Random(9)
    words = sorted({"interna" + "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) + "tional" for _ in range(400)})
    monkeypatch.setattr(spelling, "CELL", 8)
    frame = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long")
    got = {(r["word"], r["near"]) for r in spelling.near_words(frame).collect()}
    assert got == {(a, b) for a in words for b in words if edits_one(a, b)} and got
    assert spelling.variants(frame.limit(0)).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_force(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: H(*map(field, (r[0], r[3], r[2], r[4], text)))

    def tree(hashes):
        paths = [[] for _ in hashes]
        of = list(range(len(hashes)))
        while len(hashes) > 1:
            for i, k in enumerate(of):
                run = k // 8 * 8
                paths[i].append((hashes[run:k], hashes[k + 1:run + 8]))
            hashes = [H(*hashes[k:k + 8]) for k in range(0, len(hashes), 8)]
            of = [k // 8 for k in of]
        return hashes[0], paths

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([y[2] for y in sorted(langs[x], key=lambda y: y[:3])]) for x in names}
    root, upper = tree([trees[x][0] for x in names])
    out = []
    for k, name in enumerate(names):
        for (_, _, h, r), path in zip(sorted(langs[name], key=lambda y: y[:3]), trees[name][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, r[1] and r[1].translate(UPPER) if hit else r[1])
            for before, after in path + upper[k]:
                folded = H(*before, folded, *after)
            proof = H(*(h for b, a in path + upper[k] for h in b + a))
            out.append((r[0], h, trees[name][0], root, proof, folded, folded == root))
    return out


@pytest.mark.parametrize("langs", [("en",), ("en", None, "dé", "z"), tuple(f"l{i}" for i in range(11))])
def test_manifest_against_brute_force(spark, langs):
    rnd = random.Random(len(langs))
    rows = [(i, rnd.choice(["Some Text É", "", None, "lower", "Long " * 70000]) if i % 9 == 0 else f"Text {i}", rnd.choice(langs[:1] * 9 + langs),
             rnd.choice(["a", None]), i, i) for i in range(150)]
    rows += [rows[3], rows[3], (7, "same id", "en", None, None, 0), (None, "no id", "en", "a", 1, 0), (None, None, None, None, None, 0)]
    path = new_path(spark, "manifest")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, idx long")
    docs.withColumns({"grp": F.lit("x"), "h": F.lit(1)}).write.parquet(f"{path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, path)
    assert Counter(map(tuple, got.collect())) == Counter(manifest_by_force(rows))
    empty = new_path(spark, "manifest")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert merkle.op12_merkle_manifest(spark, empty).count() == 0


def vectors_by_force(rows, cosine):
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    group, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if good(a[1]) and good(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    group = [group[j] if g == group[i] else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((r[0], links[i], min(ids, default=None), r[0] == min(ids, default=None)))
    return Counter(out)


def test_vectors_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    near = np.concatenate([base[:10] + 0.12 * rng.standard_normal((10, 32)) for _ in range(6)])
    chain = [np.cos(t) * base[20] / np.linalg.norm(base[20]) + np.sin(t) * base[21] / np.linalg.norm(base[21]) for t in np.arange(0, 1, 0.1)]
    rows = [(i, [float(y) for y in x], "x") for i, x in enumerate([*base, *near, *chain, 3 * base[5], base[6], base[6], -base[6]])]
    rows += [(900, None, "x"), (901, [], "x"), (902, [0.0] * 32, "x"), (903, [1.0, None], "x"), (904, [float("nan")] * 32, "x"),
             (905, [1.0, 2.0], "x"), (906, [2.0, 4.1], "x"), (None, rows[7][1], "x"), (3, rows[8][1], "x"), rows[4], rows[4]]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 3)
    monkeypatch.setattr(embedding_dedup, "CELL", 5)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node string")
    got = Counter(map(tuple, embedding_dedup.near_duplicates(frame).collect()))
    assert got == vectors_by_force(rows, 0.95)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_recall_just_above_the_threshold():
    """Pairs at the threshold meet in a table, and stay within the Hamming radius, in more than 0.9 of all cases."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    y = 0.951 * x + np.sqrt(1 - 0.951 ** 2) * side
    bits, tables = embedding_dedup.plan(50_000, 0.95)
    centre, turn = embedding_dedup.learn(x, bits * tables)
    a, b = ((v - centre) @ turn >= 0 for v in (x, y))
    met = (a.reshape(-1, tables, bits) == b.reshape(-1, tables, bits)).all(axis=2).any(axis=1)
    close = (a != b).sum(axis=1) <= embedding_dedup._radius(np.arccos(0.95), bits * tables)
    assert (met & close).mean() > 0.9
    assert abs(a.mean() - 0.5) < 0.02


def test_staging_removes_what_is_not_kept(spark):
    frame = spark.range(3)
    with common.staging() as keep:
        gone = common.stored(frame, "gone")
        with common.staging() as inner:
            kept = keep(inner(common.stored(gone, "kept")))
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(gone.staged_at).count()


def test_marked_loses_no_key(spark):
    rows = spark.createDataFrame([(i if i % 10 else None, i * 7) for i in range(2000)] + [(None, None)], "a long, b long")
    keys = rows.filter("b % 100 = 0 or b is null")
    out = common.marked(rows, ["a", F.col("b")], keys)
    assert out.columns == ["a", "b", "_may"]
    got = [tuple(r) for r in out.collect()]
    said = {(a, b) for a, b, may in got if may}
    inside = {tuple(r) for r in keys.collect()}
    assert len(got) == 2001 and inside <= said and len(said) < len(inside) + 20
    none = common.marked(rows, ["a", "b"], keys.limit(0))
    assert none.filter("_may").count() == 0 and none.count() == 2001


def test_ngram_points_take_half_a_byte_a_group_and_their_bound_holds():
    rng = np.random.default_rng(4)
    for size in (1, 5, 60, 257, 900, 4000, 40000):
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        b = np.unique(np.concatenate((a[size // 5:], rng.integers(0, 1 << 63, size // 4, np.uint64))))
        p, q = ngram_join.point(a), ngram_join.point(b)
        assert len(p) <= max(8, len(a))
        groups = 2 * min(len(p), len(q))
        x, y = (ngram_join.fold(ngram_join.counts_of(v), groups) for v in (p, q))
        assert x.sum() == len(a) and y.sum() == len(b)
        assert np.minimum(x, y).sum() >= len(np.intersect1d(a, b))
    # counts of 16 and more in a group take more groups, not fewer bits
    crowd = np.arange(40, dtype=np.uint64) << np.uint64(4)
    assert ngram_join.counts_of(ngram_join.point(crowd)).sum() == 40
    assert len(ngram_join.point(np.unique(rng.integers(0, 1 << 63, 500, np.uint64)))) <= 128


@pytest.mark.parametrize("words", [1, 8, 1 << 20])
def test_labels_are_exact_however_full_the_bitmaps(spark, monkeypatch, words):
    monkeypatch.setattr(common, "_FILTER_WORDS", words)
    rows = spark.range(3000).select(F.col("id").alias("row"), F.col("id").cast("string").alias("text"))
    for labels in (1, 4, 7):
        known = common.stored(rows.select("row", F.pmod(F.xxhash64("row"), F.lit(labels)).alias("copies")), "known")
        out = common.labelled(rows, "row", known, "copies", labels)
        assert out.columns == ["row", "text", "copies"]
        assert sorted(map(tuple, out.collect())) == sorted((r, str(r), c) for r, c in known.collect())
    assert common.labelled(rows.limit(0), "row", known.limit(0), "copies", 4).count() == 0


def test_the_mix_does_not_shuffle_texts(spark):
    docs = spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"),
                                             F.expr("array_join(transform(sequence(1, 30), i -> sha2(concat(id, ':', i), 256)), ' ')").alias("text"))
    docs = common.stored(docs, "docs")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        mix = common.stored(mixing.mixed(docs), "mix")
        assert written() - before < 1 << 20  # the texts are 6 MB
        got = sorted(map(tuple, mix.groupBy("doc_id").count().collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    assert got == sorted((r["doc_id"], r["copies"]) for r in mixing.copies(sizes).collect() if r["copies"])


def test_marks_behind_letters_are_encoded_apart_from_them():
    whole = tokens.Encoder(tokens.default_path())
    library, rng, asked = whole.tokenizer, random.Random(8), []
    marks = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    texts = [w + "".join(rng.choices(marks, k=k)) for w in ("abc", "Don", "éÇ", "s", "ENTchre") for k in (1, 2, 3, 5, 20) for _ in range(80)]
    texts += [w + m + t for w in ("it", "queue") for m in (*marks, "###", "'s", "''", "<|endoftext|>", "|>") for t in ("", "s", "LL", "7")]
    pieces = whole._pieces
    whole._pieces = lambda some: asked.extend(some) or pieces(some)
    ids, bounds = whole.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text
    asked.clear()
    whole.encode(pa.array([f"{w}%%%" for w in ("einein", "thoues", "ndes", "Mentch")]))
    assert asked == ["%%%"]
