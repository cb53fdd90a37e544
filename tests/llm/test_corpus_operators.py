"""Operators that compare documents or gather statistics, against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runmetrics.llm import ann, chat, components, exact_dedup, pii, queries, simhash

from .conftest import SF

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("capacity", [4096, 2])
def test_exact_dedup(documents, edge, capacity):
    for docs in (documents, edge):
        rows = docs.select("doc_id", "text").collect()
        groups = defaultdict(list)
        for r in rows:
            groups[norm(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        found = exact_dedup.deduplicate(docs, capacity=capacity).collect()
        assert len(found) == len(rows) and sum(r.kept for r in found) == len(groups)
        digests = {hashlib.sha256(n.encode()).hexdigest(): sorted(g) for n, g in groups.items()}
        for r in found:
            first = digests[r.text_sha256][0]
            assert (r.keep_id, r.group_size) == (None if first[1] else first[2], len(digests[r.text_sha256]))
            assert not r.kept or r.doc_id == r.keep_id
    assert exact_dedup.deduplicate(edge.limit(0)).count() == 0


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    random.seed(1)
    hashes = [random.getrandbits(64) - (1 << 63) for _ in range(300)] + [(5 << 58) + (i << 49) for i in range(20)]
    keys = spark.createDataFrame([(h,) for h in hashes], "h long")
    buckets, depths = exact_dedup.directory(keys, 16)
    assert len(depths) > 3 and buckets.select("bucket").distinct().count() == buckets.count()
    found = exact_dedup.owned(keys, buckets, depths).collect()
    assert sorted(r.h for r in found) == sorted(hashes)
    assert max(Counter(r.bucket for r in found).values()) <= 16


def test_chains_compare_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PAGES", 2)
    docs = spark.createDataFrame([(1, "x y"), (2, "xy"), (3, "z"), (4, None)], "doc_id long, text string")
    shared = docs.select(F.xxhash64(exact_dedup.normalised("text")).alias("h")).distinct()
    assert exact_dedup.chains(docs, shared).count() == 0  # no hash has two texts


def test_keep_first_keeps_one_row_each(edge):
    kept = exact_dedup.keep_first(edge, exact_dedup.deduplicate(edge).filter("kept"))
    assert kept.columns == edge.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(r.text) for r in edge.collect()})


def test_components_equal_union_find(spark):
    random.seed(2)
    pairs = [(random.randrange(400), random.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 5000 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: find(x) for x in parent} and len(found) == len(parent)


def plain_components(prints):
    values = sorted({p for _, p in prints})
    own = {v: v for v in values}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    array = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= 3):
            a, b = find(v), find(values[i + 1 + int(j)])
            own[max(a, b)] = min(a, b)
    first = {}
    for d, p in prints:
        if d is not None:
            first[find(p)] = min(first.get(find(p), d), d)
    return Counter((d, f"{p:016x}", first.get(find(p))) for d, p in prints)


def test_near_duplicates(documents, edge):
    for docs in (documents, edge):
        prints = [(r.doc_id, simhash.fingerprint(r.text or "")) for r in docs.collect()]
        assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == plain_components(prints)
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_links_find_all_neighbours(spark, parts):
    random.seed(3)
    centres = [random.getrandbits(64) for _ in range(40)] + [random.getrandbits(32) for _ in range(40)]
    values = set(centres)
    for c in centres:
        for _ in range(6):
            values.add(c ^ sum(1 << b for b in random.sample(range(64), random.randrange(1, 5))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), parts=parts)
    labels = {r.node: r.component for r in components.components(found).collect()}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                assert labels[a] == labels[b]
    plain = plain_components([(i, v) for i, v in enumerate(values)])
    assert len({labels.get(v, v) for v in signed}) == len({c for _, _, c in plain})


def luhn(number):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(number)))) % 10 == 0


def plain_spans(text):
    def fits(kind, value):
        number = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
                "card": 13 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]
    return [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(kind, m[0])]


def test_personal_data(spark, documents, edge):
    random.seed(7)
    texts = ["".join(random.choice("a.@b-+1 (5)é\U0001F600%4.9") for _ in range(random.randrange(80))) for _ in range(800)]
    texts += ["a@b.c_x@y.z", "a@b.c" * 3, "4111 1111 1111 1111 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1", "x@y.z " * 2000, "9" * 3000]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (documents, edge, made):
        # rows that repeat an id share their terms, not their spans
        expected = Counter((r.doc_id, tuple(plain_spans(r.text))) for r in docs.collect())
        assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base)) for r in pii.find(docs).collect()) == expected
    assert pii.find(edge.limit(0)).count() == 0


def test_disclosing_terms(spark):
    rare = [(i, f"call qwertyx on +1 (741) 555-306{i % 2} please and so on") for i in range(4)]
    docs = spark.createDataFrame(rare + [(i, "please and so on call the office on Monday") for i in range(110, 260)] + [(99, "qwertyz alone")], "doc_id long, text string")
    found = {r.doc_id: {(t.term, t.removed) for t in r.terms} for r in pii.disclosures(docs).collect()}
    # "qwertyx" is near one of the two numbers in half of its documents; common words disclose nothing
    plain = {}
    n = docs.count()
    for value in (0, 1):
        d_c, d_ct, d_t = 2, 2, 4
        share = np.log2(n * d_ct / (d_c * d_t)) / np.log2(n / d_c)
        plain[value] = (share >= pii.GENERALISE, share >= pii.REMOVE)
    assert found == {i: {("qwertyx", bool(plain[i % 2][1]))} for i in range(4) if plain[i % 2][0]} and found
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "call [WORD] on [PHONE] please and so on" and clean[99] == "qwertyz alone" and clean[110] == docs.filter("doc_id = 110").first().text


def test_terms_disclose_from_anywhere_in_the_text(spark):
    far = " the office is open on Monday and so on" * 5
    rows = [(i, f"Wu 77 qwertyx{far} mail a@b.c") for i in range(3)] + [(i, far + " please") for i in range(10, 200)]
    rows += [(5, "É+1 (741) 555-3069 xé@y.z_x@y.z 4111 1111 1111 1111abc"), (6, "É+1 (741) 555-3069 xé@y.z_x@y.z 4111 1111 1111 1111abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: {t.term for t in r.terms} for r in pii.disclosures(docs).collect()}
    assert {i: found[i] for i in range(3)} == dict.fromkeys(range(3), {"wu", "77", "qwertyx", "mail"})
    # words beside a span count, parts of words that a span cuts don't
    assert found[5] == found[6] == {"é", "xé"}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == f"  {far}  [EMAIL]" and clean[10] == far + " please"


def plain_disclosures(rows):
    """The disclosing terms of each document by plain counts, for ids that don't repeat."""
    word = re.compile(r"[^\W_]+")
    n, held, words = len(rows), defaultdict(set), defaultdict(set)
    near = {}
    for doc, text in rows:
        spans = {(kind, m.start(), m.end(), m.group()) for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text) if kind == "email"}
        for _, _, _, value in spans:
            held[value.lower()].add(doc)
        for w in {w.lower() for w in word.findall(text)}:
            words[w].add(doc)
        if spans:
            near[doc] = {m.group().lower() for m in word.finditer(text) if not any(m.start() < e and s < m.end() for _, s, e, _ in spans)}
    found = defaultdict(dict)
    for docs_c in held.values():
        if len(docs_c) >= 2 and n > len(docs_c):
            for t in set().union(*(near[d] for d in docs_c)):
                both = {d for d in docs_c if t in near[d]}
                share = np.log2(n * len(both) / (len(docs_c) * max(len(words[t]), len(both)))) / np.log2(n / len(docs_c))
                if len(both) >= 2 and share >= pii.GENERALISE:
                    for d in both:
                        found[d][t] = found[d].get(t, False) or bool(share >= pii.REMOVE)
    return {d: set(terms.items()) for d, terms in found.items()}


def test_terms_equal_plain_counts(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(600):
        words = [f"word{rnd.randrange(60)}" for _ in range(15)]
        for person in rnd.sample(range(40), rnd.randrange(0, 3)):
            words[rnd.randrange(15)] = f"p{person}x@mail.org"
            words += [f"nick{person}", f"team{person // 4}"][:rnd.randrange(3)]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "list " + " ".join(f"m{k}q@list.org" for k in range(100)) + " of " + " ".join(f"only{k}" for k in range(120))) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: {(t.term, t.removed) for t in r.terms} for r in pii.disclosures(docs).collect()}
    assert found == plain_disclosures(rows) and len(found) > 50
    assert len(found[1000]) == 122


def test_pairs_of_classes_not_of_entities_and_terms(spark):
    rows = [(i, " ".join(f"m{k}q@list.org" for k in range(100)) + " " + " ".join(f"only{k}" for k in range(120))) for i in range(2)] + [(i, "other text") for i in range(10, 60)]
    pii.disclosures(spark.createDataFrame(rows, "doc_id long, text string"))
    import glob
    import os
    from runmetrics.session import shared_dir
    latest = max(glob.glob(f"{shared_dir(spark)}/evidence-*"), key=os.path.getmtime)
    assert spark.read.parquet(latest).count() == 2  # a row a document: one class of entities, one of terms


def test_redaction_keeps_rows_and_columns(edge):
    clean = pii.redact(edge, chars_column="n_chars")
    assert clean.columns == edge.columns and clean.count() == edge.count()
    rows = {r.doc_id: r for r in clean.collect()}
    assert rows[18].text == "mail [EMAIL] or [PHONE], card [CARD] at [IP]" and rows[18].n_chars == len(rows[18].text)
    assert rows[0].text is None and rows[2].text == " \t\n"


def test_overlapping_spans_are_replaced_once(spark):
    docs = spark.createDataFrame([(1, "x +4111 1111 1111 111 y 4111-1111-1111-1111@a.b z")], "doc_id long, text string")
    text = pii.redact(docs).first().text
    assert text.startswith("x [") and text.endswith(" z") and not re.search("[0-9]", text)


def test_chat_round_trip(spark):
    control = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "\\", "[", "<", "a", "\n", "%0A", "%", "é"]
    random.seed(8)
    rows = [(c, t, random.choice(["user", "assistant", "system", "o%0A\ndd[INST]", None]), random.choice([None, ""] + ["".join(random.choices(control, k=8))] * 9))
            for c in [*range(40), None] for t in range(random.randrange(1, 7))]
    rows += [(1, 0, "user", "again"), (1, 0, "user", "again")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(1)).withColumn("score", F.lit("x"))
    made = chat.format_trees(chat.as_trees(table))
    found = {r.tree_id: r for r in made.select("tree_id", "n_turns", chat.parsed(chat.formatted(F.col("segments"))).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    expected = defaultdict(list)
    for c, t, role, text in rows:
        expected[c].append((t, role, text))
    for c, turns in expected.items():
        # Spark sorts nulls first
        turns.sort(key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))
        assert [tuple(t) for t in found[c].turns] == [(role or "", text or "") for _, role, text in turns]
        assert found[c].loss == "".join(text or "" for _, role, text in turns if role == "assistant") and found[c].n_turns == len(turns)
    assert chat.format_trees(chat.as_trees(table.limit(0))).count() == 0


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, 1.0), (1, 2, 1, 2.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 2, 9.0), (2, 1, 2, 1.0), (2, 2, 1, 1.0), (2, 3, 2, 1.0), (3, 1, 77, None), (3, 1, 77, None)]
    table = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, score double").withColumns({"role": F.lit("user"), "text": F.col("message_id").cast("string")})
    found = [(r.tree_id, r.leaf_id, r.rank, r.score, [t.text for t in r.turns]) for r in
             chat.format_trees(table, None).select("*", chat.parsed(chat.formatted(F.col("segments"))).alias("turns")).collect()]
    assert sorted(found) == [(1, 3, 3, 6.0, ["1", "3"]), (1, 4, 1, 12.0, ["1", "2", "4"]), (1, 5, 2, 12.0, ["1", "2", "5"]), (3, 1, 1, 0.0, ["1"])]
    assert {(r.tree_id, r.leaf_id) for r in chat.format_trees(table, 1).collect()} == {(1, 4), (3, 1)}


def test_a_deep_tree(spark):
    rows = spark.range(1, 301).select(F.lit(1).alias("tree_id"), F.col("id").alias("message_id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"),
                                      F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    found = chat.format_trees(rows).select("n_turns", "score", chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert found[0] == (300, 300.0, "".join(str(i) for i in range(1, 301))) and len(found) == 1


def plain_nearest(rows, is_query, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if is_query(q):
            best = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    score = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
                    best[i] = max(score, best.get(i, -9))
            out[q] = sorted(((-round(s, 12), i) for i, s in best.items()))[:k]
    return out


def test_nearest_recall(spark):
    vectors = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    plain = plain_nearest([(r.vec_id, r.embedding) for r in vectors.collect()], lambda i: i % 50 == 0)
    found = queries.op6_nearest(spark, SF.replace("0.001", "0.1")).collect()
    wanted = {(q, i): -s for q, near in plain.items() for s, i in near}
    got = {(r.query_id, r.vec_id): r.score for r in found}
    assert len(got) == len(wanted) == len(found) and len(wanted.keys() & got.keys()) >= 0.9 * len(wanted)
    assert all(abs(got[pair] - wanted[pair]) < 1e-9 for pair in wanted.keys() & got.keys())


def test_nearest_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 4)
    monkeypatch.setattr(ann, "QUERIES", 2)
    rows = [(i, [1.0, 0.0, float(i % 3)]) for i in range(30)] + [(i, [1.0, 1.0, 1.0]) for i in range(100, 130)] + [
        (200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 1.0]), (204, [float("nan"), 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]),
        (300, [1.0, 2.0]), (301, [2.0, 1.0]), (5, [0.0, 1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "list": F.lit(2), "rank": F.lit("x")})
    found = ann.nearest(table, F.col("vec_id") % 10 == 0, target=1.0).collect()
    plain = plain_nearest(rows, lambda i: i % 10 == 0)
    assert {q: [i for _, i in near] for q, near in plain.items() if near} == {
        q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in found}}
    assert ann.nearest(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_a_repeated_id_takes_one_place(spark):
    rnd = random.Random(7)
    rows = [(7, [1.0, 0.001 * i, 0.0]) for i in range(10)] + [(7, [1.0, 0.0, 0.0])] * 30 + [(i, [1.0, rnd.random(), rnd.random()]) for i in range(20, 50)] + [(50, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = plain_nearest(rows, lambda i: i % 50 == 0)
    found = ann.nearest(table, F.col("vec_id") % 50 == 0, target=1.0).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == [i for _, i in plain[50]] and len(found) == 5


def test_very_large_and_small_vectors(spark):
    rows = [(i, [x * scale for x in (1.0, 0.1 * i, 0.05 * i * i)]) for i, scale in zip(range(12), [1e300, 1e-300, 1.0, 1e160, 1e-170, 3.0] * 2)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, target=1.0).collect()
    plain = plain_nearest([(i, [1.0, 0.1 * i, 0.05 * i * i]) for i in range(12)], lambda i: i % 5 == 0)
    assert {(r.query_id, r["rank"]): r.vec_id for r in found} == {(q, n + 1): i for q, near in plain.items() for n, (_, i) in enumerate(near)}


def test_pipeline_stages(spark, documents, edge):
    for docs in (documents, edge.select(*documents.columns), documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns
            rows = after.collect()
            before = docs.collect()
            docs = spark.createDataFrame(rows, after.schema)
            if name == "language":
                assert {r.doc_id for r in before if re.search("[a-z]{3} [a-z]{2} [a-z]{2}", r.text or "")} <= {r.doc_id for r in rows}
            elif name == "exact copies":
                assert sorted(norm(r.text) for r in rows) == sorted({norm(r.text) for r in before})
            elif name == "near copies":
                prints = plain_components([(r.doc_id, simhash.fingerprint(r.text or "")) for r in before])
                assert sorted(r.doc_id for r in rows) == sorted({c for _, _, c in prints})
            else:
                assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before)
                own = {r.doc_id: r.text for r in before}
                assert all(not plain_spans(r.text) or r.text != own[r.doc_id] for r in rows)
                assert all(r.text == own[r.doc_id] for r in rows if not plain_spans(own[r.doc_id]))
    assert "sequence_id" in corpus_pipeline.run(spark, SF).columns


def test_copies_of_documents_without_ids_of_their_own(spark):
    different = ["the quick brown fox jumps over a lazy dog", "one two three four five six seven", "rain falls on the plain in spring", "we sell red and blue boats here"]
    rows = [(None, different[0]), (None, different[1]), (5, different[2]), (5, different[3]), (3, "some copied text of a page"), (7, "some copied  text of a page"), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = corpus_pipeline.exact_copies(spark, docs, SF)
    wanted = [*different, "some copied  text of a page", "short"]
    assert sorted(r.text for r in exact.collect()) == sorted(wanted) and exact.columns == docs.columns
    # the longer copy has id 7, as another text has; drop it by its row, not by its id
    longer = spark.createDataFrame([(7, "x y"), (3, "x  y"), (7, "z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.exact_copies(spark, longer, SF).collect()) == [(3, "x  y"), (7, "z")]
    near = corpus_pipeline.near_copies(spark, docs, SF)
    assert sorted(r.text for r in near.collect()) == sorted([*different, "some copied text of a page", "short"]) and near.columns == docs.columns
