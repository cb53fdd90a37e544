"""Periodic runs, the conversation trie and quality rules, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runmetrics.llm import burst_trie, periodic, quality, queries

from .conftest import SF

WORD = r"[^\x20\x09-\x0D]+"


def plain_runs(words, least=24, times=3):
    """Every maximal stretch of a period, by trying all periods at all places."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)  # periods ascend, so the first is the smallest
            i = j + 1 if j > i else i + 1
    # a stretch whose smallest period was found at a lag that divides a larger one is listed once
    return sorted((s, length, q) for (s, length), q in best.items())


def random_words(rnd):
    kind = rnd.randrange(4)
    if kind == 0:
        return [rnd.choice("ab") for _ in range(rnd.randrange(120))]
    if kind == 1:
        unit = [rnd.choice("abcdef") for _ in range(rnd.randrange(1, 30))]
        return [rnd.choice("xyz") for _ in range(rnd.randrange(9))] + unit * rnd.randrange(1, 8) + unit[:rnd.randrange(len(unit))] + ["end"] * rnd.randrange(40)
    if kind == 2:
        inner = ["a"] * rnd.randrange(1, 28) + ["b"] * rnd.randrange(1, 5)
        return (inner * rnd.randrange(1, 6) + ["c"]) * rnd.randrange(1, 5)
    return [f"w{rnd.randrange(rnd.choice((3, 40, 400)))}" for _ in range(rnd.randrange(200))]


def test_runs_equal_brute_force():
    rnd = random.Random(3)
    texts = [random_words(rnd) for _ in range(400)] + [[], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, list("abcdefgh") * 3, list("abcdefghi") * 3]
    found = periodic.scan([" ".join(words) for words in texts])
    for words, (runs, collapsed) in zip(texts, found):
        expected = plain_runs(words)
        assert runs == expected
        dropped = {i for s, length, q in expected for i in range(s + q, s + length)}
        assert collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_splitting_keeps_what_may_hold_a_run():
    words = np.array([5, *[0, 1, 2] * 9, 6, *[3, 4] * 11, 7, *[8] * 30, 0, 1, 2])
    found = list(periodic.split_segments(words, np.zeros(len(words), np.int64), 24, 3))
    assert sorted(found) == [(1, 28), (52, 82)]
    assert list(periodic.split_segments(np.array([], np.int64), np.array([], np.int64), 24, 3)) == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(None, times=2)


def test_long_repetitive_texts_are_scanned_in_little_time():
    fib = ["a", "b"]
    for _ in range(18):
        fib = fib + [*fib[:len(fib) - len(fib) // 2]]
    texts = ["a " * 200_000, "a b c d e " * 40_000, " ".join(fib[:50_000])]
    (one, _), (five, left), _ = periodic.scan(texts)
    assert one == [(0, 200_000, 1)] and five == [(0, 200_000, 5)] and left == "a b c d e"


def as_rebuilt(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_of_runs_equals_brute_force(spark):
    found = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    seen = 0
    for d in docs:
        words = as_rebuilt(d.doc_id, re.findall(WORD, d.text or ""))
        if len(words) > 3000:
            words_runs = periodic.scan([" ".join(words)])[0][0]  # the plain search is quadratic
        else:
            words_runs = plain_runs(words)
        seen += bool(words_runs)
        r = found[d.doc_id]
        best = max(words_runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        dropped = {i for s, length, q in words_runs for i in range(s + q, s + length)}
        assert r.n_runs == len(words_runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in words_runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
    assert seen > 10


def test_runs_of_edge_cases(spark, edge):
    found = periodic.periodic_runs(edge).collect()
    assert len(found) == edge.count()
    texts = Counter((r.doc_id, r.text) for r in edge.select("doc_id", "text").collect())
    for (doc_id, text), n in texts.items():
        (runs, collapsed), = periodic.scan([text or ""])
        assert sum(r.doc_id == doc_id and r.collapsed == collapsed and [tuple(x) for x in r.runs] == runs for r in found) >= n
    assert [tuple(x) for r in found if r.doc_id == 15 for x in r.runs] == [(0, 15000, 5)]
    assert periodic.periodic_runs(edge.limit(0)).count() == 0


def plain_trie(sequences):
    """Nodes of {conversation: [(role, text)]}, as rows of the contract."""
    last = lambda c: (c is None, c or 0)
    members = defaultdict(list)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    least = {p: min(m, key=last) for p, m in members.items()}
    children = Counter(p[:-1] for p in members if p)
    rows = []
    for path, m in members.items():
        below = [p for p in members if p[:len(path)] == path]
        ends = sorted((c for c in m if len(sequences[c]) == len(path)), key=last)
        rows.append((
            least[path], len(path), least[path[:-1]] if path else None, len(m), children[path], sum(not children[p] for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()))
    return Counter(rows)


def as_sequences(rows):
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append(((turn is not None, turn or 0, digest(role or "", text or "")), (role or "", text or "")))
    return {conv: [t for _, t in sorted(turns)] for conv, turns in found.items()}


def nodes_of(spark, rows, capacity):
    turns = burst_trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return Counter(tuple(r) for r in burst_trie.prefix_trie(turns, turns.select("conv"), capacity).collect())


@pytest.mark.parametrize("capacity", [1, 6, 256])
def test_trie_equals_brute_force(spark, capacity):
    rnd = random.Random(capacity)
    rows = [(conv, turn, rnd.choice(("user", "assistant")), rnd.choice(("a", "bb", ""))) for conv in range(40) for turn in range(rnd.randrange(1, 6))]
    rows += [(100, t, "user", "same") for t in range(7)] + [(101, t, "user", "same") for t in range(7)] + [(102, t, "user", "same") for t in range(9)]
    rows += [(None, None, None, None), (None, 2, "user", None), (7, None, "user", "first"), (7, 1, "user", "a"), (7, 1, "user", "a"), (200, 3, "user", "x" * 50_000)]
    assert nodes_of(spark, rows, capacity) == plain_trie(as_sequences(rows))


def test_many_copies_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(burst_trie, "BLOCK", 16)
    rows = [(conv, turn, "user", f"t{turn}") for conv in range(60) for turn in range(3)] + [(1000, turn, "user", f"t{turn}" if turn < 2 else "long") for turn in range(150)]
    rows += [(conv, turn, "user", "long twice") for conv in (2000, 2001) for turn in range(70)]
    assert nodes_of(spark, rows, 8) == plain_trie(as_sequences(rows))


def test_oversized_containers_burst_and_others_do_not(spark):
    rows = [(conv, turn, "user", f"{conv if turn > 2 else 0}") for conv in range(30) for turn in range(4)] + [(99, 0, "user", "alone")]
    turns = burst_trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    containers = burst_trie.burst(turns, burst_trie.classes(turns, turns.select("conv")), 20).all()
    big = {(r.depth, r.n) for r in containers.filter("big").groupBy("depth").agg(F.count("*").alias("n")).collect()}
    assert big == {(0, 31), (1, 30), (2, 30), (3, 30)}
    assert containers.filter("not big").groupBy("depth", "head").agg(F.sum(F.col("n") - F.col("depth") + 1).alias("n")).filter("n > 20").count() == 0


def test_empty_trie(spark):
    assert nodes_of(spark, [], 4) == Counter()


def plain_counts(text):
    words = re.findall(WORD, text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    repeated = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def plain_rules(rows):
    """(doc_id, counts, failed, kept, removed words) of (doc_id, text, host)."""
    norm = lambda line: re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")).lower()
    texts, holders = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if re.search(WORD, line):
                holders[host, norm(line)].add(text or "")
    over = {key for key, held in holders.items() if len(held) >= 8 and len(held) * 100 > len(texts[key[0]]) * 5}
    made = Counter()
    for doc_id, text, host in rows:
        counts = plain_counts(text or "")
        gone = sum(len(re.findall(WORD, line)) for line in (text or "").split("\n") if (host, norm(line)) in over)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        kept = not failed and counts[0] - gone >= 10 and 100 * (counts[0] - gone) >= 50 * counts[0]
        made[doc_id, *counts, failed, kept, gone] += 1
    return made


def shared_lines():
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rnd.sample(words, n))
    rows = [(i, f"Menu | home 1{i % 10}\n{prose(30)}\n  \nMENU |  home 77\r\n{prose(5)}", f"h{i % 2}") for i in range(24)]
    rows += [(100 + i, prose(12) + "\nall rights reserved by the owners of this very long site notice that says little of what stands beside it", "h0") for i in range(12)]
    rows += [(200 + i, "the same text on every page of this group of copies\nwith two lines", "h1") for i in range(30)]
    rows += [(300, None, "h0"), (301, "", None), (302, prose(40), None), (None, prose(40), None), (302, prose(40), "h1")]
    return rows


def test_rules_equal_brute_force(spark, documents, edge):
    own = spark.createDataFrame(shared_lines(), "doc_id long, text string, source string")
    for docs in (documents, edge, own):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        assert Counter(tuple(r) for r in quality.quality_rules(docs).drop("removed").collect()) == plain_rules(rows)
    assert quality.quality_rules(edge.limit(0)).count() == 0
    judged = plain_rules(shared_lines())
    assert any(k[-1] for k in judged) and any(k[-2] for k in judged) and any(not k[-3] and not k[-2] for k in judged)


def test_clean_drops_shared_lines_and_depleted_documents(spark):
    docs = spark.createDataFrame(shared_lines(), "doc_id long, text string, source string").withColumn("line", F.lit(1)).withColumn("row", F.lit("r"))
    left = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert left[0].text.count("\n") == 2 and "enu" not in left[0].text and left[0].row == "r"
    assert not any(i in left for i in range(100, 112)) and 300 not in left and 301 not in left
    assert left[200].text.startswith("the same") and quality.clean(docs).columns == docs.columns


def test_window_repeats_of_random_words(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(40))) for _ in range(150)] + ["a b c d e a b c d e", "a a a a a", "a a a a a a", "x " * 30_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = docs.select("text", quality.repeat_words(quality.words(F.col("text"))).alias("n")).collect()
    assert all(r.n == plain_counts(r.text)[4] for r in found)
