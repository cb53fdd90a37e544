"""The registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import ann, burst_trie, chat, exact_dedup, langid, licenses, packing, periodic, pieces, pii, quality, simhash, token_counts
from .common import table, whole, written


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(number(kind) for kind in pii.KINDS), F.sha2(pii.described(F.col("base")), 256).alias("base_sha256"),
        pii.described(F.concat("base", "terms")).alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    made = chat.format_trees(chat.as_trees(rows.unionByName(extra)))
    text = made.select("tree_id", chat.formatted(F.col("segments")).alias("text"), chat.loss_text(F.col("segments")).alias("loss"))
    turns = text.withColumn("turns", chat.parsed(F.col("text")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("text").cast("long").alias("formatted_chars"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs.filter(~langid.held_out())))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("bucket")


def _rebuilt(turns: DataFrame) -> DataFrame:
    """The stand-in input of op11: the first h turns of conversation c - c % 100, then c's own behind its first h."""
    own_id = F.col("conv.id")
    h = F.coalesce(F.crc32(own_id.cast("string")) % 6, F.lit(0))
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    first = sizes.select("conv", burst_trie.key(own_id - own_id % 100).alias("base"), h.alias("h"))
    shift = first.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("there")), "base", "left").select(
        "conv", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("k"))
    heads = first.join(turns.filter("at < 5").select(F.col("conv").alias("base"), "at", "id", "chars"), "base").filter("at < h").select("conv", "at", "id", "chars")
    own = turns.join(shift, "conv").filter("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "id", "chars")
    return heads.unionByName(own)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    turns = burst_trie.numbered(rows)
    return burst_trie.prefix_trie(written(_rebuilt(turns), "rebuilt"), turns.select("conv"))


def _with_repeats(doc_id: Column, text: Column) -> Column:
    """The stand-in input of op12: in one of ten documents the words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(found: Column) -> Column:
        n = F.size(found)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.when(n == 0, text).otherwise(F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.get(found, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    return F.when(h % 10 == 0, pii.let(quality.words(whole(text)), repeated)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs).withColumn("best", periodic.strongest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("removed")


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_packing, op3_token_counts, op4_sentence_pieces, op5_chat, op6_nearest, op7_simhash, op8_licenses, op9_language, op10_exact_dedup,
    op11_prefix_trie, op12_periodic_runs, op13_quality_rules)}

ORACLE = {
    "op5_chat": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g') as safe,
         regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g') as safe_role
  from rows),
joined as (
  select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
         coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '') as loss,
         sum(case when role = 'assistant' then 7 + length(safe) else 14 + length(safe_role) + length(safe) end) as chars
  from escaped group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
       cast(chars as bigint) as formatted_chars
from joined""",
    "op10_exact_dedup": r"""
with plain as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
ranked as (
  select *, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size, row_number() over w as place
  from plain window w as (partition by norm order by n desc, doc_id nulls last))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from ranked""",
    "op11_prefix_trie": r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, id) - 1 as pos, id, chars
  from (select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] as id,
               length(coalesce(text, '')) as chars from conversations) x),
convs as (
  select conv_id, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(cast(conv_id as varchar), ''),
             lambda c: [cast(ascii(c) as bigint), 0, 0, 0, 0, 0, 0, 0]))),
           lambda x, e: xor(xor(x, e) >> 1, 3988292384 * (xor(x, e) & 1))), 4294967295) % 6 as h
  from (select conv_id, count(*) as n from turns group by conv_id) x),
rebuilt as (
  select c.conv_id, t.pos, t.id, t.chars from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and t.pos < c.h
  union all
  select c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.id, t.chars
  from convs c join turns t on t.conv_id = c.conv_id and t.pos >= c.h left join convs b on b.conv_id = c.conv_id - c.conv_id % 100),
paths as (
  select conv_id, pos + 1 as depth, string_agg(id, '') over (partition by conv_id order by pos) as path, chars from rebuilt
  union all select conv_id, 0, '', 0 from convs),
nodes as (select depth, path, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(chars) as own from paths group by depth, path),
children as (select depth - 1 as depth, path[1:32 * (depth - 1)] as path, count(*) as n from nodes where depth > 0 group by 1, 2),
parts as (select n.conv_id, n.depth, n.own, case when c.n is null then 1 else 0 end as leaf from nodes n left join children c on c.depth = n.depth and c.path = n.path),
sums as (
  select a.depth, a.path, sum(p.leaf) as n_leaves, sum(p.own) as saved from parts p join paths a on a.conv_id = p.conv_id and a.depth <= p.depth
  group by a.depth, a.path),
ends as (
  select depth, path, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
  from (select conv_id, max(depth) as depth, arg_max(path, depth) as path from paths group by conv_id) x group by depth, path)
select n.conv_id, cast(n.depth as bigint) as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children,
       cast(s.n_leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n join sums s on s.depth = n.depth and s.path = n.path
left join nodes u on u.depth = n.depth - 1 and u.path = n.path[1:32 * (n.depth - 1)]
left join children c on c.depth = n.depth and c.path = n.path
left join ends e on e.depth = n.depth and e.path = n.path""",
    "op13_quality_rules": r"""
with plain as (
  select row_number() over () as row, doc_id, source, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select row, w, unnest(range(1, len(w) - 3)) as pos from plain),
windows as (select row, pos, count(*) over (partition by row, w[pos:pos + 4]) as uses from places),
repeats as (
  select row, count(*) as n_repeat_words from (select distinct row, pos + k as word from windows, range(5) r(k) where uses > 1) x group by row),
lines as (
  select row, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
         lower(regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g')) as norm
  from (select row, source, text, unnest(string_split(text, chr(10))) as line from plain) x where regexp_matches(line, '[^\x20\x09-\x0D]')),
doubled as (select row, count(*) - count(distinct line) as n_dup_lines from lines group by row),
hosts as (select source, count(distinct text) as of_host from plain group by source),
shared as (select source, norm, count(distinct text) as documents from lines group by source, norm),
over_limit as (
  select s.source, s.norm from shared s join hosts h on h.source is not distinct from s.source
  where s.documents >= 8 and s.documents * 100 > h.of_host * 5),
removed as (select l.row, sum(l.n) as gone from lines l join over_limit o on o.source is not distinct from l.source and o.norm = l.norm group by l.row),
counts as (
  select p.doc_id, len(p.w) as n_words, length(regexp_replace(p.text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(regexp_replace(p.text, '[^#*$%&|<>]+', '', 'g')) as n_symbols, coalesce(d.n_dup_lines, 0) as n_dup_lines,
         coalesce(r.n_repeat_words, 0) as n_repeat_words, coalesce(g.gone, 0) as gone
  from plain p left join repeats r on r.row = p.row left join doubled d on d.row = p.row left join removed g on g.row = p.row)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
       cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
       n_words < 10 or n_repeat_words * 100 > n_words * 20 as base_failed,
       not (n_words < 10 or n_repeat_words * 100 > n_words * 20) and n_words - gone >= 10 and (n_words - gone) * 100 >= n_words * 50 as kept,
       cast(gone as bigint) as n_removed_words
from counts""",
}
