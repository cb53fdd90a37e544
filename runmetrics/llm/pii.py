"""Personal data, and terms that disclose it, by information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers, leftmost and non-overlapping in each
kind. Each distinct value is a protected entity c. Terms are all words, of every length, of the whole texts that hold an
entity, outside base spans. Over all documents, with N documents, D(c) that hold c, D(t) that hold t and D(c,t) that hold
both:

    IC(c) = log2(N / D(c))        PMI(c;t) = log2(N D(c,t) / (D(c) D(t)))

A term discloses an entity when PMI(c;t) / IC(c) is at least ``GENERALISE``; from ``REMOVE`` on it says practically as
much as the entity itself. Evidence from one document is none: D(c,t) must be at least ``SUPPORT``. In documents that
hold c, all places of a disclosing term become spans of kind ``term``: removed, or generalised to the class of the word.
Places inside base spans are not repeated. Documents without a base span get no spans at all.

Null and empty texts have no spans and stay as they are. Positions are code points, ends exclusive. Rows that repeat an
id count as one document and share their disclosing terms; each gets a row. Null ids are an id like any other. An empty
table gives no rows. Other columns are passed by ``redact`` and take no part. Texts are worked through whole, very long
ones too; a text and the arrays of its words and spans are one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import whole, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
GENERALISE, REMOVE = 0.8, 0.95
SUPPORT = 2
# The patterns of the kinds. Classes that can't overlap are matched possessively, and matches begin where
# a run of their first class begins (or where the last match ended), so that long runs aren't searched again and again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_BYTES = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
_WORD = r"[\p{L}\p{N}]+"
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where body uses it inside another lambda."""
    return F.transform(F.array(value), body)[0]


def prefix_fold(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element, ``merge`` of all before it. In blocks and block totals, so long arrays aren't copied at each step."""
    def fold(array: Column) -> Column:
        return F.aggregate(array, zero, merge)

    def blocks(array: Column) -> Column:
        return F.when(F.size(array) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.ceil(F.size(array) / _BLOCK).cast("int") - 1))

    def each(array: Column, before: Column) -> Column:
        def one(_, at):
            block = F.floor(at / _BLOCK).cast("int")
            return merge(F.element_at(before, block + 1), fold(F.slice(array, block * _BLOCK + 1, at % _BLOCK)))
        return F.transform(array, one)

    return let(values, lambda array: let(
        F.transform(blocks(array), lambda b: fold(F.slice(array, b * _BLOCK + 1, F.lit(_BLOCK)))),
        lambda totals: let(F.transform(blocks(array), lambda b: fold(F.slice(totals, F.lit(1), b))), lambda before: each(array, before))))


def matches(text: Column, pattern: Column) -> Column:
    """All matches of a pattern as an array of (start, end, value)."""
    def located(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda value, at: (F.length(F.element_at(gaps, at + 1)) + F.length(value)).cast("long"))
        starts = prefix_fold(steps, F.lit(0).cast("long"), lambda a, b: a + b)
        return let(starts, lambda before: F.transform(found, lambda value, at: let(
            F.element_at(before, at + 1) + F.length(F.element_at(gaps, at + 1)),
            lambda start: F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value")))))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, let(
        F.split(text, pattern, -1), lambda gaps: located(found, gaps))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    def add(total: Column, place: Column, number: Column) -> Column:
        digit = F.substring(number, place, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(place % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return let(F.reverse(value), lambda number: F.aggregate(
        F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda total, place: add(total, place, number))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_BYTES)
    if kind == "card":
        return let(digits(value), lambda number: F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base spans of a text, an array of (kind, start, end, value) in the order of the kinds."""
    hint = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]")}
    none = F.array().cast(_SPANS)

    def of(kind: str) -> Column:
        found = F.filter(matches(text, F.lit(PATTERNS[kind])), lambda m: valid(kind, m["value"]))
        return F.when(hint[kind], F.transform(found, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))).otherwise(none)

    return F.concat(*(of(kind) for kind in KINDS))


def _words(text: Column) -> Column:
    """The different words of a text, in lower case. A word is lowered by itself, as where its places are looked up."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))), lambda w: F.lower(w)))


def _outside(text: Column, spans: Column) -> Column:
    """The text between spans, in lines; words that a span cuts are left out."""
    head, tail = r"^[\p{L}\p{N}]+", r"[\p{L}\p{N}]+$"

    def build(ordered: Column) -> Column:
        def gaps(covered: Column) -> Column:
            def gap(s: Column, done: Column) -> Column:
                # with a character of the span at each end, to tell whether it belongs to the word beside it
                first = F.substring(text, F.lit(1), (s["start"] + 1).cast("int"))
                later = F.regexp_replace(F.substring(text, done.cast("int"), (s["start"] - done + 2).cast("int")), head, "")
                return F.when(s["start"] >= done, F.regexp_replace(F.when(done == 0, first).otherwise(later), tail, "")).otherwise(F.lit(""))

            parts = F.transform(ordered, lambda s, at: let(F.element_at(covered, at + 1), lambda done: gap(s, done)))
            last = F.array_max(F.transform(ordered, lambda s: s["end"]))
            return F.concat(F.array_join(parts, "\n"), F.lit("\n"), F.regexp_replace(F.substring(text, last.cast("int"), F.length(text)), head, ""))

        return let(prefix_fold(F.transform(ordered, lambda s: s["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b)), gaps)

    return let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), build)


_TERMS = "array<struct<term:string,removed:boolean>>"
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _marked(docs: DataFrame, id_column: str, text_column: str, whole_texts: bool) -> DataFrame:
    """``docs`` with __base, the base spans, and __shared, whether other rows have the same id; written.

    Without ``whole_texts`` the text is left out of rows that can't get more spans: those without a base span, unless
    they share their id.
    """
    ids = docs.groupBy(F.struct(F.col(id_column).alias("id")).alias("__id")).agg(F.count("*").alias("__rows"))
    repeated = written(ids.filter("__rows > 1").select("__id"), "repeated")
    own = F.struct(F.col(id_column).alias("id"))
    rows = docs.withColumn("__shared", F.lit(False)) if repeated.isEmpty() else docs.join(
        repeated.withColumn("__shared", F.lit(True)), own == F.col("__id"), "left").drop("__id").withColumn("__shared", F.col("__shared").isNotNull())
    text = whole(text_column)
    based = rows.withColumn("__base", F.when(text.rlike("[@+0-9]"), base_spans(text)).otherwise(F.array().cast(_SPANS)))
    if not whole_texts:
        based = based.withColumn(text_column, F.when((F.size("__base") > 0) | F.col("__shared"), F.col(text_column)))
    return written(based, "marked")


def _disclosed(docs: DataFrame, marked: DataFrame, id_column: str, text_column: str, generalise: float, remove: float, support: int) -> DataFrame:
    """(doc, terms): the disclosing terms of each document (a struct of its id) that has any, as an array of (term, removed).

    Entities of the same documents are one class, and so are terms of the same documents with entities and equal D(t):
    they are judged alike, so evidence is gathered for pairs of classes.
    """
    doc = F.struct(F.col(id_column).alias("id")).alias("doc")
    spans = marked.filter(F.size("__base") > 0)
    entity = lambda s: F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], r"[^0-9.]+", "")))
    held = written(spans.select(
        F.monotonically_increasing_id().alias("row"), doc, F.array_distinct(F.transform("__base", entity)).alias("entities"),
        _words(_outside(whole(text_column), F.col("__base"))).alias("terms")), "held")
    hashes = [F.bit_xor(F.xxhash64(F.lit(seed), "doc")).alias(f"x{seed}") for seed in (1, 2)]
    each = held.select("row", "doc", F.explode("entities").alias("entity"))
    documents = each.select("entity", "doc").distinct().groupBy("entity").agg(F.count("*").alias("d_c"), *hashes).filter(F.col("d_c") >= support).select(
        "entity", "d_c", F.struct("d_c", "x1", "x2").alias("entities"))
    total = docs.count()
    # D(c,t) is D(c) at most, so a term of more documents than this can't reach the share (with room for rounding)
    most = F.col("d_c") * F.pow(F.lit(float(max(total, 1))) / F.col("d_c"), F.lit(1.0 - generalise)) * (1 + 1e-9)
    owners = written(each.join(documents, "entity").withColumn("most", most).select("row", "doc", "entities", "most").distinct(), "owners")
    bounds = owners.groupBy("row").agg(F.max("most").alias("bound"))
    terms = held.join(bounds, "row").select("row", "doc", "bound", F.explode("terms").alias("term"))
    wanted = written(terms.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("term"), "wanted")
    spread = docs.select(F.explode(_words(whole(text_column))).alias("term")).groupBy("term").agg(F.count("*").alias("d_t")).join(wanted, "term")
    rare = written(terms.join(spread, "term").filter("d_t <= bound").select("row", "doc", "term", "d_t"), "rare")
    alike = written(rare.select("term", "d_t", "doc").distinct().groupBy("term", "d_t").agg(*hashes).select(
        "term", F.struct("d_t", "x1", "x2").alias("terms")), "alike")
    named = written(rare.join(alike, "term").select("row", "doc", "term", "terms"), "named")
    evidence = written(owners.join(named.select("row", "terms").distinct(), "row").filter(F.col("terms.d_t") <= F.col("most")).select(
        "doc", "entities", "terms").distinct(), "evidence")
    pairs = evidence.groupBy("entities", "terms").agg(F.count("*").alias("d_ct")).filter(F.col("d_ct") >= support)
    d_c, d_t = F.col("entities.d_c"), F.col("terms.d_t")
    information = F.log2(F.lit(total) / d_c)
    # rows that repeat an id may hold the term in fewer rows than documents, so D(t) is at least D(c,t)
    shared = F.log2(F.lit(total) * F.col("d_ct") / (d_c * F.greatest(d_t, "d_ct")))
    judged = written(pairs.withColumn("share", F.when(information > 0, shared / information).otherwise(F.lit(0.0)))
                     .filter(F.col("share") >= generalise).select("entities", "terms", (F.col("share") >= remove).alias("removed")), "judged")
    own = evidence.join(judged, ["entities", "terms"]).groupBy("doc", "terms").agg(F.max("removed").alias("removed")).join(
        named.select("doc", "terms", "term").distinct(), ["doc", "terms"]).select("doc", "term", "removed")
    # rows that repeat an id share the terms of all entities of the id
    repeated = marked.filter("__shared").select(doc).distinct()
    others = owners.select("doc", "entities").distinct().join(repeated, "doc", "left_semi").join(judged, "entities").join(alike, "terms").select("doc", "term", "removed")
    of_each = own.unionByName(others).groupBy("doc", "term").agg(F.max("removed").alias("removed"))
    return written(of_each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("term", "removed"))).alias("terms")), "disclosures")


def disclosures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", generalise: float = GENERALISE,
                remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, terms): the disclosing terms of each document that has any, as an array of (term, removed)."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = _disclosed(narrow, _marked(narrow, "doc_id", "text", False), "doc_id", "text", generalise, remove, support)
    return found.select(F.col("doc.id").alias("doc_id"), "terms")


def lookup(names: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function that tells whether a word is among ``names``, which are dealt into about as many lists as each list holds."""
    number = F.greatest(F.ceil(F.sqrt(F.size(names))).cast("int"), F.lit(1))

    def place(word: Column, lists: Column) -> Column:
        return F.pmod(F.hash(word), lists)

    return let(number, lambda n: let(
        F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter(names, lambda name: place(name, n) == b)),
        lambda lists: body(lambda word: F.array_contains(F.element_at(lists, place(word, n) + 1), word))))


def term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Places of disclosing terms outside base spans, as (kind, start, end, value)."""
    none = F.array().cast(_SPANS)
    found = lookup(F.transform(terms, lambda t: t["term"]), lambda known: F.filter(matches(text, F.lit(_WORD)), lambda m: let(F.lower(m["value"]), known)))
    free = F.filter(found, lambda m: ~F.exists(base, lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    located = F.transform(free, lambda m: F.struct(F.lit(TERM).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.when(F.size(F.coalesce(terms, F.array().cast(_TERMS))) > 0, located).otherwise(none)


def with_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", whole_texts: bool = True) -> DataFrame:
    """All columns of ``docs``, then __text, __base, __terms (disclosing terms) and __term_spans.

    Base spans are found once and written. Rows that can have no disclosing terms take no part in a join; without
    ``whole_texts`` their text is null.
    """
    marked = _marked(docs, id_column, text_column, whole_texts)
    disclosed = _disclosed(docs, marked, id_column, text_column, GENERALISE, REMOVE, SUPPORT).select(F.col("doc").alias("__doc"), F.col("terms").alias("__terms"))
    may = (F.size("__base") > 0) | F.col("__shared")
    joined = marked.filter(may).join(disclosed, F.struct(F.col(id_column).alias("id")) == F.col("__doc"), "left").drop("__doc", "__shared")
    alone = marked.filter(~may).drop("__shared").withColumn("__terms", F.lit(None).cast(_TERMS))
    rows = joined.unionByName(alone).withColumn("__text", whole(text_column))
    return rows.withColumn("__term_spans", term_spans(F.col("__text"), F.col("__terms"), F.col("__base")))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, base and terms: the spans of every document as arrays of (kind, start, end, value)."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return with_spans(narrow, whole_texts=False).select("doc_id", F.col("__base").alias("base"), F.col("__term_spans").alias("terms"))


def described(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replacement(span: Column, removes: Callable[[Column], Column]) -> Column:
    shape = (F.when(span["value"].rlike(r"^\p{N}+$"), F.lit("[NUMBER]")).when(span["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[WORD]")))
    return F.when(span["kind"] != TERM, F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))).when(let(F.lower(span["value"]), removes), F.lit("")).otherwise(shape)


def cleaned(text: Column, spans: Column, terms: Column) -> Column:
    """The text with its spans replaced; spans that overlap an earlier one extend it."""
    def build(ordered: Column, removes: Callable[[Column], Column]) -> Column:
        ends = prefix_fold(F.transform(ordered, lambda s: s["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))

        def piece(covered: Column) -> Column:
            parts = F.transform(ordered, lambda s, at: let(F.element_at(covered, at + 1), lambda done: F.when(
                s["start"] >= done, F.concat(F.substring(text, (done + 1).cast("int"), (s["start"] - done).cast("int")), _replacement(s, removes))).otherwise(F.lit(""))))
            last = F.array_max(F.transform(ordered, lambda s: s["end"]))
            return F.concat(F.array_join(parts, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))

        return let(ends, piece)

    names = F.transform(F.filter(terms, lambda t: t["removed"]), lambda t: t["term"])
    return lookup(names, lambda removes: let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("rev"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))), lambda ordered: build(ordered, removes)))


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", chars_column: str | None = None) -> DataFrame:
    """``docs`` with the text of documents that hold personal data cleaned; ``chars_column``, if given, follows the text."""
    names = docs.columns
    found = with_spans(docs, id_column, text_column)
    terms = F.coalesce("__terms", F.array().cast(_TERMS))
    touched = F.size("__base") > 0
    clean = F.when(touched, cleaned(F.col("__text"), F.concat("__base", "__term_spans"), terms)).otherwise(F.col(f"`{text_column}`"))
    result = found.withColumn("__clean", clean).withColumn("__touched", touched)
    columns = {n: F.col(f"`{n}`") for n in names}
    columns[text_column] = F.col("__clean").alias(text_column)
    if chars_column in columns:
        columns[chars_column] = F.when(F.col("__touched"), F.length("__clean")).otherwise(F.col(f"`{chars_column}`")).cast(docs.schema[chars_column].dataType).alias(chars_column)
    return result.select(*columns.values())
