"""Operators that work text by text, against the libraries and plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runmetrics.llm import langid, licenses, packing, pieces, simhash, token_counts
from runmetrics.llm.bpe import COMMON, Splitter

from .conftest import SF, TEXTS


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_common_characters_split_as_the_library_does(library):
    splitter = Splitter()
    for code in (c for c in range(0x3100) if not COMMON.match(chr(c))):
        for text in (f"a{chr(code)}1", f" {chr(code)} {chr(code)}"):
            own = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert splitter._words.findall(text) == own


def test_counts_equal_the_library(spark, documents, edge, library):
    for docs in (documents, edge):
        rows = {(r.doc_id, r.text): r for r in docs.collect()}
        found = token_counts.token_counts(docs).collect()
        assert len(found) == docs.count()
        expected = Counter((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024)
                           for d, t in (k for k in ((r.doc_id, r.text) for r in docs.collect())))
        assert Counter(tuple(r) for r in found) == expected and rows
    assert token_counts.token_counts(edge.limit(0)).count() == 0


def test_counts_of_random_strings(library):
    random.seed(4)
    texts = ["".join(random.choice("aaab '\n\t  1é日✓՘\U0001F600<|endoftext|>sS.!") for _ in range(random.randrange(60))) for _ in range(500)] + ["a" * 3001]
    assert token_counts.PairMerges().count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def plain_best(text, vocabulary):
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = [(best[b][0] + vocabulary.pieces[text[b:end]][1], -b) for b in range(max(0, end - vocabulary.longest), end) if text[b:end] in vocabulary.pieces]
        options.append((best[end - 1][0] + vocabulary.unknown, -(end - 1)))
        best.append(max(options))
    cuts = [len(text)]
    while cuts[-1]:
        cuts.append(-best[cuts[-1]][1])
    cuts.reverse()
    return [i for a, b in zip(cuts, cuts[1:]) for i in vocabulary._ids(text[a:b])]


def test_streaming_search_equals_plain_viterbi():
    random.seed(5)
    own = pieces.Vocabulary({"a": (1, -1.0), "b": (2, -2.0), "ab": (3, -2.5), "aba": (4, -3.0), "bab": (5, -3.25), "aaaa": (6, -3.5)}, list(range(100, 356)))
    for _ in range(500):
        text = "".join(random.choice("aaabbc") for _ in range(random.randrange(150)))
        assert own.search(text) == plain_best(text, own)
    model = pieces.Vocabulary.load()
    for text in [t for t in TEXTS if t and len(t) < 6000] + [" a  b", "a ", "  ", "x  y z"]:
        assert model.encode([text])[0].tolist() == plain_best("▁" + text.replace(" ", "▁"), model)


def test_pieces_round_trip(spark, documents, edge):
    for docs in (documents, edge):
        found = pieces.encode_decode(docs).collect()
        texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
        assert len(found) == docs.count()
        assert Counter((r.doc_id, r.decoded) for r in found if r.round_trip) == Counter({k: n for k, n in texts.items() if "▁" not in k[1]})
        for row in found:
            ids = np.array(row.ids, "<u4")
            assert (len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(row.decoded.encode()).hexdigest()) == (row.n_ids, row.ids_crc32, row.decoded_sha256)
    assert pieces.encode_decode(edge.limit(0)).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    import xxhash
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(documents):
    for text in [r.text for r in documents.limit(60).collect()] + TEXTS:
        assert simhash.fingerprint(text or "") == plain_fingerprint(text or "")


@pytest.mark.parametrize("expression,labels,permissive", [
    ("MIT", {"mit"}, True), ("GPL-2.0-only", {"gpl-2"}, False), ("MIT OR GPL-3.0", {"mit", "gpl-3"}, True), ("MIT AND GPL-3.0", {"mit", "gpl-3"}, False),
    ("GPL-3.0 OR MIT AND Apache-2.0", {"gpl-3", "mit", "apache-2"}, True), ("(GPL-3.0 OR MIT) AND GPL-2.0+", {"gpl-3", "mit", "gpl-2"}, False),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR BSD-3-Clause", {"gpl-2", "bsd-3-clause"}, True),
])
def test_license_expressions(expression, labels, permissive):
    assert licenses.evaluate(expression) == (labels, permissive)


@pytest.mark.parametrize("expression", ["", "MIT OR", "AND MIT", "MIT MIT", "(MIT", "MIT)", "()", "MIT & BSD"])
def test_bad_license_expressions(expression):
    with pytest.raises(ValueError):
        licenses.evaluate(expression)


@pytest.mark.parametrize("line,expression", [
    (" MIT", "MIT"), (" MIT.", "MIT"), (" MIT. Apache-2.0 or later", "MIT"), (" MIT This file is part of the tool", "MIT"), ("MIT and this file", "MIT"),
    (" (MIT OR GPL-2.0+) AND BSD-3-Clause */ x", "( MIT OR GPL-2.0+ ) AND BSD-3-Clause"), (" MIT OR (GPL-3.0 see there", "MIT"), (" MIT, Apache-2.0", "MIT"),
    (" GPL-2.0-only WITH Classpath-exception-2.0 or so", "GPL-2.0-only WITH Classpath-exception-2.0"), (" GPL-2.0 with care", "GPL-2.0"),
    (" LicenseRef-Own-1 OR MIT-0", "LicenseRef-Own-1 OR MIT-0"), (" foo", None), ("", None), (" AND MIT", None), (" ( )", None), (" see LICENSE", None),
    (" MIT WITH LLVM-exception WITH LLVM-exception", "MIT WITH LLVM-exception"), (" mitigated", None), (" (MIT) WITH LLVM-exception", "( MIT )"),
])
def test_leading_license_expressions(line, expression):
    assert licenses.leading(line) == expression
    if expression:
        licenses.evaluate(expression)


def test_leading_expressions_are_the_longest_valid_begin():
    random.seed(4)
    words = ["MIT", "GPL-2.0+", "and", "OR", "with", "LLVM-exception", "(", ")", "prose"]

    def valid(tokens):
        try:
            licenses.postfix(" ".join(tokens))
        except ValueError:
            return False
        # each "with" stands between one licence and one exception, exceptions stand nowhere else, no prose
        places = [i for i, t in enumerate(tokens) if t == "with"]
        excepted = [i for i, t in enumerate(tokens) if t == "LLVM-exception"]
        return "prose" not in tokens and [i + 1 for i in places] == excepted and all(tokens[i - 1] in words[:2] for i in places)

    for _ in range(4000):
        tokens = random.choices(words, k=random.randrange(1, 9))
        best = max((n for n in range(1, len(tokens) + 1) if valid(tokens[:n])), default=0)
        assert licenses.leading(" ".join(tokens)) == (" ".join(tokens[:best]) or None), tokens


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + phrase.count(" ") + 1] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})))


def test_license_scan(documents, edge):
    scanner = licenses.Scanner()
    tricky = ["cc by nc by nc cc by nc", "under the mit license" * 2, "// SPDX-License-Identifier: (MIT OR GPL-2.0+) AND BSD-3-Clause */\nx", "SPDX-License-Identifier: MIT MIT"]
    for text in [r.text for r in documents.collect()] + TEXTS + tricky:
        found = scanner.scan(text or "")
        assert found[:5] == plain_scan(text)
        assert set(found[4].split(",")) <= set(found[5].split(",")) | {""} and 0 <= found[6] <= 1
    assert scanner.scan(tricky[2])[5] == "bsd-3-clause,gpl-2,mit" and scanner.scan(tricky[2])[7] is True
    assert scanner.scan(tricky[3])[5:9] == ("mit", 0.0, True, 0)
    found = licenses.scan_licenses(edge)
    assert found.count() == edge.count() and licenses.scan_licenses(edge.limit(0)).count() == 0


def plain_path(scores, penalty):
    paths = {s: ([s], scores[0][s]) for s in range(len(scores[0]))}
    for row in scores[1:]:
        paths = {s: max(((p + [s], v + row[s] - (penalty if p[-1] != s else 0)) for p, v in paths.values()), key=lambda x: x[1]) for s in range(len(row))}
    return max(v for _, v in paths.values())


def test_language_viterbi_is_optimal():
    random.seed(6)
    scores = np.array([[random.uniform(-9, 0) for _ in range(3)] for _ in range(50)], np.float32)
    counts = np.array([7, 0, 1, 30, 12])
    ids = np.array([random.randrange(50) for _ in range(counts.sum())])
    begins = np.cumsum(counts) - counts
    path = langid.viterbi(scores, ids, begins, counts, 2.0)
    for begin, n in zip(begins, counts):
        if n:
            own = path[begin:begin + n]
            value = sum(float(scores[i][s]) for i, s in zip(ids[begin:begin + n], own)) - 2.0 * sum(a != b for a, b in zip(own, own[1:]))
            assert value == pytest.approx(plain_path([scores[i].tolist() for i in ids[begin:begin + n]], 2.0), abs=1e-3)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    spans = langid.Labeller(model).label(["the and of that with is for " * 5 + "der die und nicht ein ist von " * 5])[0][2]
    assert [s.split(":")[0] for s in spans.split(",")] == ["en", "de"]


def test_scripts_that_no_language_uses_are_rejected(spark, documents):
    model = langid.fit(documents)
    texts = ["これは日本語の文章です。漢字も少しあります。", "Это русский текст о погоде", "the and of that with is for", "the and of that with is これは日本語の文章ですがながい"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in langid.keep_identified(docs, model).collect()) == [2, 3]
    assert langid.keep_identified(documents, model).count() == documents.filter("text rlike '[a-zA-Z]'").count()


def test_the_sample_share_is_never_nothing():
    assert langid.share(10_000, 10 ** 30) == 1
    for size in (10_001, 10 ** 10, 10 ** 13):
        assert abs(langid.share(10_000, size) / langid._STEPS * size - 10_000) < 1


def test_language_of_edge_cases(spark, edge):
    model = langid.fit(edge)
    assert model.langs == ["en", "es"]
    found = {(r.doc_id, r.lang_pred) for r in langid.predict(edge, model).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (11, "und"), (None, "und")} <= found
    kept = langid.keep_identified(edge, model)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {d for d, lang in found if lang != "und"} - {12}  # Greek isn't learned
    nothing = langid.fit(edge.limit(0))
    assert {r.lang_pred for r in langid.predict(edge, nothing).collect()} == {"und"} and langid.predict(edge.limit(0), model).count() == 0
    one = langid.fit(edge, sample=1)
    assert langid.predict(edge, one).count() == edge.count()


def check_packing(docs, rows, tokens):
    places = {}
    per = {}
    for r in rows:
        per.setdefault((r.doc_id, r.ids_crc32 if r.piece == 0 else None), []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for of in places.values():
        end = 0
        for offset, length in sorted(of):
            assert offset == end
            end += length
        assert end <= 1024
    expected = Counter()
    for d in docs.collect():
        ids = tokens.ids(d.text or "")
        cuts = packing.cut(len(ids), 1024)
        assert all(length == 1024 for _, length in cuts[1:]) and sum(length for _, length in cuts) == len(ids)
        expected += Counter((d.doc_id, i, s, n, zlib.crc32(ids[s:s + n].tobytes())) for i, (s, n) in enumerate(cuts))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    return len(places), sum(r.length for r in rows)


def test_packing(spark, documents, edge, library):
    tokens = packing.Tokens()
    for r in documents.limit(50).collect():
        assert tokens.ids(r.text).tolist() == [*library.encode(r.text, add_special_tokens=False).ids, 2]
    sequences, total = check_packing(documents, packing.pack(documents.repartition(11)).collect(), tokens)
    sizes = [n for r in documents.collect() for _, n in packing.cut(len(tokens.ids(r.text or "")), 1024)]
    at_once = len(packing.best_fit(np.array(sizes), 1024)[2])
    assert total == sum(sizes) and sequences <= at_once * 1.03 + 1
    larger = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    packed = packing.pack(larger).agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert packed[0] <= 1.002 * packed[1] / 1024 + 1
    check_packing(edge, packing.pack(edge).collect(), tokens)
    assert packing.pack(edge.limit(0)).count() == 0


def test_best_fit_places_items_in_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([600, 500, 500, 400, 24, 24]), 1024)
    assert fills.tolist() == [1024, 1024] and bins.tolist() == [0, 1, 1, 0, 0, 1] or fills.sum() == 2048
    assert packing.best_fit(np.array([], np.int64), 1024)[2].tolist() == []


@pytest.mark.parametrize("arity, share", [(2, 1.02), (packing.ARITY, 1.01)])
def test_packing_by_a_tree_over_small_partitions(spark, documents, monkeypatch, arity, share):
    monkeypatch.setattr(packing, "ARITY", arity)
    monkeypatch.setattr(packing, "BATCH_ROWS", 7)
    small = documents.repartition(-(-documents.count() // 18))
    sequences, total = check_packing(documents, packing.pack(small).collect(), packing.Tokens())
    assert sequences <= share * total / 1024 + 1


def test_steps_follow_every_item_into_its_bin():
    random.seed(11)
    for _ in range(40):
        items = pd.DataFrame([(node, fill, random.choice([1, 2, 9, 40])) for node in range(8, 11) for fill in random.sample(range(1, 1020), random.randrange(1, 30))],
                             columns=["node", "fill", "n"])
        for root in (True, False):
            out = packing._merge(1024, root)((1,), items)
            bins = {r.fill: r.n for r in out[out.steps.isna()].itertuples() if r.node == 1}
            held = {}
            for r in out[out.steps.notna()].itertuples():
                for rank in range(r.n):
                    step = [s for s in r.steps if s["rank"] <= rank][-1]
                    which, place = divmod(rank - step["rank"], step["times"])
                    held.setdefault((step["fill"], step["place"] + which), []).append((step["shift"] + place * r.fill, r.fill, step["bin"] + which))
            assert sorted(held) == sorted((fill, rank) for fill, n in bins.items() for rank in range(n))
            assert sum(map(len, held.values())) == items["n"].sum()
            for (fill, _), of in held.items():
                end = 0
                for offset, length, _ in sorted(of):
                    assert offset == end
                    end += length
                assert end == fill <= 1024 and len({b for *_, b in of}) == 1
            finished = [of[0][2] for (fill, _), of in held.items() if root or fill >= 1020]
            assert len(set(finished)) == len(finished)


def test_merged_fills_are_best_fit():
    random.seed(9)
    for _ in range(60):
        counts = {random.randrange(1, 1020): random.choice([1, 2, 7, 60]) for _ in range(random.randrange(1, 40))}
        sizes = np.repeat(list(counts), list(counts.values()))
        rules, bins = packing.merge_fills(counts, 1024)
        held = {}
        for fill, rank, times, shift, into in rules.tolist():
            end = min((r for f, r, *_ in rules.tolist() if f == fill and r > rank), default=counts[fill])
            for i in range(end - rank):
                held.setdefault(into + i // times, []).append((shift + i % times * fill, fill))
        for items in held.values():
            ends = np.cumsum([fill for _, fill in sorted(items)])
            assert ends[-1] <= 1024 and [offset for offset, _ in sorted(items)] == [0, *ends[:-1].tolist()]
        assert sorted(f for items in held.values() for _, f in items) == sorted(sizes.tolist())
        assert sorted(sum(f for _, f in items) for items in held.values()) == sorted(packing.best_fit(sizes, 1024)[2].tolist())
        assert {b: sum(f for _, f in items) for b, items in held.items()} == {b + i: fill for b, n, fill in bins.tolist() for i in range(n)}


def test_packing_merges_all_underfull_bins(spark):
    # a document a partition, what fits together far apart
    rows = [(i, "a " * (600 if i < 8 else 400)) for i in range(16)]
    tokens = packing.Tokens()
    long, short = len(tokens.ids(rows[0][1])), len(tokens.ids(rows[-1][1]))
    assert long > 512 and 1024 - long >= short
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 16), "doc_id long, text string")
    assert check_packing(docs, packing.pack(docs).collect(), tokens)[0] == 8
