"""The training-data operators on odd rows and against brute force."""

import bisect
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (license_texts, licenses, mixing, ngram_join, packing, quality, substrings, token_files, tokens, tool_calls,
                          toxicity, vector_search)
from tidemark.llm.components import components, joined_up
from tidemark.session import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, unit string, row string"


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 60)
    near = base.rsplit(" ", 1)[0] + " other"
    passage = prose(2, 55)
    texts = [base, base, near, base.upper(), None, "", " \n\t ", "one two", "one two", prose(3, 5000),
             prose(4, 30) + "\n" + passage + "\n" + prose(5, 30), prose(6, 25) + "\n" + passage, "tiny tiny\n" * 60,
             prose(7, 40) + " Licensed under the Apache License, Version 2.0. " + prose(8, 20)]
    made = [(i, t, "en", ("a", "b", None)[i % 3], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return [*made, made[0], (None, prose(9, 30), None, "a", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_against_brute_force(docs, rows, empty):
    def covered(w, k):
        places = {}
        for i in range(len(w) - k + 1):
            places.setdefault(tuple(w[i:i + k]), []).append(i)
        return len({i + j for p in places.values() if len(p) > 1 for i in p for j in range(k)})

    want = []
    for r in rows:
        w, lines = WORD.findall(r[1] or ""), [x for x in (r[1] or "").split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * covered(w, 8) > 30 * len(w)
        kept = not failed and 100 * covered(w, 5) <= 40 * len(w) and not covered(w, 201)
        want.append((r[0], len(w), len(lines) - len(set(lines)), covered(w, 8), covered(w, 5), failed, kept))
    got = quality.quality_rules(docs).select("doc_id", "n_words", "n_dup_lines", "n_repeat_words", "covered_words",
                                             "base_failed", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.keep_good(docs).count() == sum(w[-1] for w in want)
    assert quality.quality_rules(empty).count() == 0


def test_join_against_brute_force(docs, rows, empty):
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})

    def shingles(text):
        w = WORD.findall((text or "").translate(fold))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        want.append((r[0], len(sets[i]), min(ids) if sets[i] and ids else r[0]))
    got = [tuple(r) for r in ngram_join.jaccard_components(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    clash = docs.withColumns({c: F.lit(c) for c in ("id", "hash", "same", "row", "_hash", "text_hash", "component")})
    assert {(r["doc_id"], r["hash"]) for r in ngram_join.one_of_each(clash).collect()} == {(r["doc_id"], "hash") for r in kept.collect()}
    # one of each group, and every text without words
    assert kept.count() == len({g for g, s in zip(group, sets, strict=True) if s}) + sum(not s for s in sets)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_groups_grow_by_links_between_them(spark):
    links = [(2, 1), (3, 2), (11, 10), (21, 20), (21, 22)]
    more = [(3, 40), (40, 11), (50, 51), (20, 22), (None, 7)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    both = {tuple(r) for r in joined_up(components(frame(links)), frame(more)).collect()}
    assert both == {tuple(r) for r in components(frame(links + more)).collect()}
    none = frame([])
    assert {tuple(r) for r in joined_up(components(none), frame(links)).collect()} == {
        tuple(r) for r in joined_up(components(frame(links)), none).collect()}


def test_tree_keeps_every_pair():
    rnd = np.random.default_rng(5)
    base = [np.unique(rnd.integers(0, 1 << 62, 200).astype(np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate((b[k:], rnd.integers(0, 1 << 62, k).astype(np.uint64)))) for b in base for k in (0, 5, 20, 60)]
    n = np.array([len(s) for s in sets])
    whole = np.arange(len(sets))
    x, y, _ = ngram_join.tree_pairs(n, [ngram_join.point(s) for s in sets], whole, whole * 0, whole >= 0, whole * 0, 80, None)
    found = {frozenset(p) for p in zip(x.tolist(), y.tolist(), strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (n[i] + n[j] - common):
                assert frozenset((i, j)) in found


def test_paragraphs(spark, rows, empty):
    """Lines and runs of lines against brute force."""
    long_line, short = prose(50, 52), [prose(51 + i, 13) for i in range(4)]
    chinese = "天地玄黃宇宙洪荒日月盈昃辰宿列張" * 40
    texts = ["\n".join([long_line, *short[:2], prose(70, 5), chinese]), "\n\n".join([prose(71, 9), *short, prose(72, 9)]),
             "\n".join([*short[2:], prose(73, 4), long_line.upper(), chinese]), "\n".join([short[3], " ", *short[:3]]), "\n".join(short[:3])]
    made = [*rows, *((200 + i, t, "en", "a", len(t), "x", "y") for i, t in enumerate(texts))]
    seen, want = set(), set()
    for r in sorted(set(made), key=lambda r: (r[0] is None, r[0] or 0)):
        run, at = [], 0
        for line in [*(r[1] or "").split("\n"), "end of text " + str(r)]:
            w = list(WORD.finditer(line))
            body = fold(" ".join(x.group() for x in w))
            if w and body in seen:
                run.append((at + w[0].start(), at + w[-1].end(), max(len(w), (w[-1].end() - w[0].start()) // 10)))
            elif w:
                if sum(x[2] for x in run) >= 50:
                    want.add((r[0], run[0][0], run[-1][1]))
                run, seen = [], seen | {body}
            at += len(line) + 1
    docs = spark.createDataFrame(made, SCHEMA)
    assert {(r["doc_id"], r["start"], r["stop"]) for r in substrings.paragraphs(docs).collect()} == want
    assert {202, 203} <= {x[0] for x in want} and not {200, 204} & {x[0] for x in want}
    assert substrings.repeats(empty).count() == 0 and substrings.without_repeats(empty).count() == 0


def test_mixing(docs, rows, empty):
    sizes = docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("size"))
    got = mixing.copies(sizes).collect()
    total = sum(r["size"] for r in got)
    goals = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert abs(sum(t for t, _ in goals.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-9 for t, s in goals.values()) and all(r["copies"] <= 3 for r in got)
    for source, (target, _) in goals.items():
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= max(r["size"] for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.copies(sizes).collect()))
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got) and mixing.mixed(docs).columns == docs.columns
    assert mixing.copies(empty.select("doc_id", "source", F.lit(1).cast("long").alias("size"))).count() == 0


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    odd = ["", "  ", "a<|endoftext|> b<|STARTOFTEXT|>", "ΑΣ Σ aΣ. don't it's 'S x'll", "é ́x a b\tc d\x1ce\x85f",
           "가 각 12 3.4!? $$$###\r\nfoo\x0bbar", "İI ß ﬁ", "word" * 100, "İstanbul, ŉa ıx ſs Ñandú. ÉTÉ! a.b .a a., ,",
           "x .. y ., z. , . á.b", "日本語。テキスト, 中文."]
    ids, bounds = tokens.encoder(tokens.default_path()).encode(pa.array(odd))
    for i, text in enumerate(odd):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing(docs, rows, empty):
    got = packing.pack(docs, capacity=64).collect()
    ids = tokens.encoder(tokens.default_path())
    want = sorted(len(ids.encode(pa.array([r[1] or ""]))[0]) + 1 for r in rows)
    assert sum(want) == sum(r["length"] for r in got)
    cuts = [(r[0], p, 64 * p) for r in rows for p in range(-(-(len(ids.encode(pa.array([r[1] or ""]))[0]) + 1) // 64))]
    assert sorted(cuts, key=str) == sorted(((r["doc_id"], r["piece"], r["start"]) for r in got), key=str)
    held = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(empty).count() == 0


def best_fit_decreasing(counts, capacity=2048):
    """How many sequences plain best fit takes, longest first, piece by piece."""
    rooms = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        i = bisect.bisect_left(rooms, length)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - length)
    return len(rooms)


@pytest.mark.parametrize("draw", [
    lambda r: int(r.lognormvariate(6, 0.9)) + 1,
    lambda r: r.choice([r.randint(1, 300), r.randint(500, 2047), 2048]),
    lambda r: r.randint(1, 2048)])
def test_plan_against_best_fit(draw):
    rnd = random.Random(3)
    counts = {}
    for _ in range(20000):
        n = min(2048, draw(rnd))
        counts[n] = counts.get(n, 0) + 1
    runs = packing.plan(counts)
    ranks, room = {}, {}
    for r in runs:
        ranks.setdefault(r.length, []).extend(range(r.first, r.first + r.n))
        for i in range(r.n):
            room.setdefault(r.at + i, []).append((r.offset, r.length))
    assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for parts in room.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(room) <= 1.0025 * best_fit_decreasing(counts)


def test_token_files(spark, docs, rows, empty):
    folder = new_path(spark, "token-files")
    token_files.write(docs, folder)
    got = token_files.digests(token_files.read(spark, folder)).collect()
    ids = tokens.encoder(tokens.default_path())
    start = 0
    for r, doc in zip(sorted(got, key=lambda r: r["start"]), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        body = np.append(ids.encode(pa.array([doc[1] or ""]))[0], 2).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc[0], start, len(body), zlib.crc32(body.tobytes()))
        start += len(body)
    assert sorted(r["doc_id"] for r in token_files.lookup(spark, folder, [3, 11, 77]).collect()) == [3, 11]
    nothing = new_path(spark, "token-files")
    token_files.write(empty, nothing)
    assert token_files.read(spark, nothing).count() == 0


def test_vectors(spark):
    rnd = np.random.default_rng(2)
    made = [(i, [float(x) for x in rnd.normal(size=16)]) for i in range(120)]
    made += [(200, made[0][1]), (201, made[0][1]), (202, None), (203, [1.0, None]), (204, [float("nan")] * 16), (205, []),
             (None, made[1][1]), (50, made[50][1]), (7, made[9][1])]
    got = vector_search.top_k(spark.createDataFrame(made, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    # every row is a candidate, rows that share an id too
    q = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in made if i is not None and v and len(v) == 16 and None not in v and not np.isnan(v).any()]
    want = []
    for i in {i for i, _ in q if i % 50 == 0}:
        best = sorted((-int(x @ y), j) for k, x in q if k == i for j, y in q if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 0.0]), (1, [5.0, 5.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vector_search.top_k(few, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 655360), (0, 2, 1, 65536), (0, 3, 2, 65536)]


def fold(word):
    return "".join(x.lower() if x < "\x80" else x for x in word)


def _passages(rows, n=50):
    """Brute force: (id, start, stop) of the spans that go."""
    first, out = {}, set()
    for r in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w, spans = list(WORD.finditer(r[1] or "")), []
        folded = [fold(x.group()) for x in w]
        for k in range(len(w) - n + 1):
            body, start, stop = tuple(folded[k:k + n]), w[k].start(), w[k + n - 1].end()
            if body in first:
                doc, end = first[body]
                spans.append((max(start, end) if doc == r[0] else start, stop))
            else:
                first[body] = r[0], stop
        while spans:
            start, stop = spans.pop(0)
            while spans and spans[0][0] <= stop:
                stop = max(stop, spans.pop(0)[1])
            out.add((r[0], start, stop))
    return out


def test_passages_inside_lines(spark, rows, empty):
    passage = prose(20, 60)
    broken = "\n".join(" ".join(passage.split()[i:i + 3]) for i in range(0, 60, 3))
    texts = [(100, f"{prose(21, 30)} {passage} {prose(22, 30)}\n{prose(23, 9)}"), (101, f"é {prose(24, 11)} {passage.upper()} {prose(25, 8)}"),
             (102, f"{prose(26, 10)}\n{broken}\n{prose(27, 10)}"), (103, f"{passage} {prose(28, 3)}"), (104, " ".join(passage.split()[:49])),
             (105, "word " * 300), (106, f"{prose(29, 70)} {prose(29, 70)}")]
    made = [*rows, *((i, t, "en", "a", len(t), "x", "y") for i, t in texts)]
    docs = spark.createDataFrame(made, SCHEMA)
    got = {(r["doc_id"], r["start"], r["stop"]) for r in substrings.passages(docs).collect()}
    assert got == _passages(made) and {101, 102, 103, 105, 106} <= {x[0] for x in got} and not {100, 104} & {x[0] for x in got}
    # columns with the names that the operators use inside
    clash = docs.withColumns({c: F.lit(c) for c in ("row", "gone", "new", "text_hash", "start", "stop", "_text", "_hash", "id", "hash")})
    out = substrings.without_repeats(clash)
    left = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == clash.columns and left[101]["text_hash"] == "text_hash" and left[101]["text"] == f"é {prose(24, 11)} {prose(25, 8)}"
    assert left[101]["n_chars"] == len(left[101]["text"]) and left[102]["text"] == f"{prose(26, 10)}\n{prose(27, 10)}"
    assert left[103]["text"] == prose(28, 3)
    assert substrings.passages(empty).count() == 0


def test_pipeline_cuts_passages_inside_lines(spark):
    import corpus_pipeline

    passage = prose(20, 60)
    docs = spark.createDataFrame([(i, f"{prose(30 + i, 12)} {passage} {prose(40 + i, 12)}", "en", "a", 0, "x", "y") for i in range(2)], SCHEMA)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()}
    assert passage in left[0] and left[1] == f"{prose(31, 12)} {prose(41, 12)}"


def test_licenses(docs, empty):
    got = licenses.scan(docs, license_texts.templates()).collect()
    assert ("apache-2.0", 100, 13) in {(r["template"], r["coverage"], r["doc_id"]) for r in got}
    assert {r["doc_id"] for r in got} == {13} and licenses.scan(empty, license_texts.templates()).count() == 0
    text, template = np.array([1, 2, 9, 3, 4, 5], np.uint64), np.array([1, 2, 3, 4, 6, 5], np.uint64)
    assert licenses.align(template, text, -8, 8) == (5, 0, 5)


def test_licenses_repeated_short_notices(spark):
    notice, partial = "Released under the MIT License.", "Released under MIT License."
    texts = ["\n".join([notice] * n) for n in (1, 2, 3, 9, 40)] + [f"{partial} {notice} {prose(50, 4)} {notice}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs, [("mit", notice)]).collect():
        got.setdefault(r["doc_id"], []).append(texts[r["doc_id"]][r["start"]:r["stop"]])
    assert [len(got[i]) for i in range(6)] == [1, 2, 3, 9, 40, 2]
    assert {x for i in range(6) for x in got[i]} == {notice[:-1]}


def common_words(a, b):
    """Longest common subsequence, the plain way."""
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_licenses_against_brute_force(spark, monkeypatch):
    rnd, known = random.Random(9), license_texts.templates()
    plain = lambda text: re.findall(r"[a-z0-9]+", text.lower())
    texts = []
    for _, text, needed in known:
        words = text.split()
        for _ in range(len(words) // 12):
            i = rnd.randrange(1, len(words) - 1)
            if not set(plain(words[i])) & set(plain(needed)):
                words[i] = rnd.choice(["", f"{words[i]} zz", "qq"])
        texts.append(f"{prose(len(texts), 30)} {' '.join(w for w in words if w)} {prose(len(texts) + 500, 30)}")
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    got = licenses.scan(docs.repartition(3), known).collect()
    assert {r["doc_id"] for r in got} == set(range(len(known)))
    for r in got:
        template = plain(next(t for n, t, _ in known if n == r["template"]))
        # as many words as any alignment with the whole text finds, and all of them inside the span
        assert r["matched"] == common_words(template, plain(texts[r["doc_id"]]))
        assert r["matched"] == common_words(template, plain(texts[r["doc_id"]][r["start"]:r["stop"]]))
    for i, (name, text, _) in enumerate(known):
        of = [r for r in got if r["doc_id"] == i]
        best = {n: common_words(plain(t), plain(texts[i])) for n, t, must in known
                if set(plain(must)) <= set(plain(texts[i])) and 100 * common_words(plain(t), plain(texts[i])) >= 70 * len(plain(t))}
        assert max(r["matched"] for r in of) == max(best.values()), name
    # set by set, the matches of a text meet again
    monkeypatch.setattr(licenses, "TEMPLATE_WORDS", 300)
    assert sorted(licenses.scan(docs, known).collect()) == sorted(got)


def test_one_license_a_line(spark):
    lines = {f"This work is licensed under the GNU General Public License, version {v}.": f"gpl-{v}.0" for v in (2, 3)}
    lines |= {license_texts.TEXTS[n]: n for n in ("gpl-3.0-header", "lgpl-3.0-header", "agpl-3.0-header", "isc", "cc-by-4.0", "cc-by-nc-4.0")}
    lines |= {"// SPDX-License-Identifier: ISC": "isc-tag", "# SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0-tag",
              "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
              "disclaimer.": "bsd-clause-source", "SPDX-License-Identifier: LicenseRef-Own": None,
              "This work is licensed under the GNU General Public License, version 7.": None}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs, license_texts.templates()).collect():
        got.setdefault(r["doc_id"], []).append(r["template"])
    assert [got.get(i) for i in range(len(lines))] == [x and [x] for x in lines.values()]


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(4)
    made = []
    for i in range(600):
        bad = i % 5 == 0
        made.append((i, prose(i + 100, 40) + (" " + rnd.choice(["vilewort", "vilezeug", "vilekram"]) if bad else ""), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in made] + [(None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made if i < 400], "doc_id long, toxic int")
    models, threshold = toxicity.train(docs, labels, ["toxic"])
    got = {r[0]: r[1] for r in docs.select("doc_id", toxicity.probabilities("text", models, ["toxic"])["p_toxic"]).collect()}
    assert all((got[i] >= threshold) == bool(y) for i, _, y in made if i >= 400) and got[900] < threshold and got[None] < threshold
    models, threshold = toxicity.train(docs, labels.limit(0), ["toxic"])
    assert threshold == 1.0


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, 5, "c", "search", '{"query":"x","limit":3}', ["b"]), (1, 3, "b", "search", '{"limit":99,"query":1,"more":0}', ["a"]),
        (1, 9, "a", "search", '{"limit":2,"query":"q"}', None), (1, 9, "a", "search", "{}", None), (1, 1, None, "search", "{}", None),
        (1, 2, "x", "search", '{"query":"x","limit":3}', ["y"]), (1, 2, "y", "search", "{bad", ["x"]), (2, 1, "a", "nothing", "{}", ["zz"]),
        (None, 1, "n", "search", None, None)], "conv_id long, pos long, call_id string, tool string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, 10, "a", "done"), (1, 11, "a", "again"), (1, 4, "c", None), (1, 4, "o", "lost")],
                                    "conv_id long, pos long, call_id string, content string")
    schemas = spark.createDataFrame(tool_calls.SCHEMAS, "tool string, argument string, kind string, required boolean, least double, "
                                                        "most double, allowed array<string>")
    got = tool_calls.link(calls, results, schemas).collect()
    by = {}
    for r in got:
        by.setdefault((r["conv_id"], r["call_id"]), []).append(r)
    status = {k: sorted(r["status"] for r in v) for k, v in by.items()}
    assert status == {(1, "a"): ["duplicate_call", "ok"], (1, "b"): ["invalid"], (1, "c"): ["ok"], (1, None): ["missing_id"], (1, "x"): ["cycle"],
                      (1, "y"): ["cycle"], (2, "a"): ["unknown_tool"], (None, "n"): ["bad_json"], (1, "o"): ["orphan_result"]}
    place = {k[1]: v[0]["place"] for k, v in by.items() if k[0] == 1 and k[1] in ("b", "c")}
    first = next(r for r in by[1, "a"] if r["status"] == "ok")
    assert first["place"] < place["b"] < place["c"]
    assert by[1, "b"][0]["problems"] == ["kind query", "range limit", "unexpected more"]
    assert first["message"] == '{"arguments":{"limit":2,"query":"q"},"id":"a","result":"done","tool":"search"}'
    assert tool_calls.link(calls.limit(0), results.limit(0), schemas).count() == 0


def test_numbers_have_one_spelling(spark):
    same = [["1", "1.0", "1e0", "0.1e1", "10E-1"], ["0", "-0", "-0.0", "0e5"], ["3", "3e0"], ["-2.5", "-2.50", "-25e-1"],
            ["1e25", "10000000000000000000000000", "1E+25"], ["12345678901234567890", "12345678901234567890.0"], ["1e-30", "10e-31"]]
    given = [(i, f'{{"limit":{x},"query":"{x} 1.0 \\" 2.0"}}') for i, group in enumerate(same) for x in group]
    calls = spark.createDataFrame([(1, n, f"{i}-{n}", "t", text, []) for n, (i, text) in enumerate(given)] + [
        (1, 99, "far", "t", '{"limit":1e400,"query":"x"}', [])],
        "conv_id long, pos long, call_id string, tool string, arguments string, after array<string>")
    schemas = spark.createDataFrame([("t", "limit", "integer", True, None, None, None), ("t", "query", "string", True, None, None, None)],
                                    "tool string, argument string, kind string, required boolean, least double, most double, "
                                    "allowed array<string>")
    none = spark.createDataFrame([], "conv_id long, pos long, call_id string, content string")
    got = {r["call_id"]: r for r in tool_calls.link(calls, none, schemas).collect()}
    assert got.pop("far")["status"] == "bad_json"
    spelled = {}
    for n, (i, text) in enumerate(given):
        r = got[f"{i}-{n}"]
        message = r["message"]
        spelled.setdefault(i, set()).add((message[message.index('"limit":'):message.index(',"query"')], r["status"]))
        assert json.loads(message)["arguments"]["query"] == json.loads(text)["query"]
        assert float(json.loads(message)["arguments"]["limit"]) == float(json.loads(text)["limit"])
    assert all(len(x) == 1 for x in spelled.values())
    assert [next(iter(x))[1] for x in spelled.values()] == ["missing_result"] * 3 + ["invalid"] + ["missing_result"] * 2 + ["invalid"]


def test_long_chains_and_joins_have_their_depth(spark):
    edges = [(i, i - 1) for i in range(1, 40)] + [(50, 39), (50, 3), (51, 50), (60, 61), (61, 60), (62, 61)]
    nodes = spark.createDataFrame([(i,) for i in sorted({x for e in edges for x in e})], "id long")
    got = {r["id"]: r["depth"] for r in tool_calls.depths(nodes, spark.createDataFrame(edges, "child long, parent long")).collect()}
    assert got == {**{i: i for i in range(40)}, 50: 40, 51: 41, 60: None, 61: None, 62: None}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == source.columns, name
        path = str(tmp_path / name.replace(" ", "-"))
        after.write.parquet(path)
        docs = spark.read.parquet(path)
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
