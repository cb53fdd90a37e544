"""Catalog: scalar functions, one query each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..functions import digest as dg, maps, status as st, template as tp, text as tx, times as tm
from . import tables as t
from .oracle import add, sql_ts, ts


def scalar(name: str, table: str, keys: str, columns: Callable[[], dict[str, Column]], sql: str | None) -> None:
    """Register the columns over a table next to the SQL select list of the same names."""
    key_list = keys.split()

    def query(spark, sf):
        return t.load(spark, sf, table).select(*key_list, *[c.alias(n) for n, c in columns().items()])

    add(name, query, None if sql is None else f"select {', '.join(key_list)}, {sql} from {table}")


c = F.col
scalar("F1_upper", "documents", "doc_id", lambda: {"out": tx.upper("text")}, "upper(replace(text, 'ß', 'SS')) as out")
scalar("F2_lower", "documents", "doc_id", lambda: {"out": tx.lower("text")}, "lower(text) as out")
scalar("F3_base64_encode", "documents", "doc_id", lambda: {"out": tx.base64_encode("text")}, "base64(encode(text)) as out")
scalar(
    "F4_base64_decode", "documents", "doc_id",
    lambda: {
        "out": tx.base64_decode(tx.base64_encode("text")),
        "bad": tx.base64_decode(F.concat(F.lit("*"), c("source")), strict=False),
    },
    "text as out, cast(null as varchar) as bad",
)
scalar(
    "F5_join", "nation", "n_nationkey",
    lambda: {
        "comma": tx.join_array(F.array(c("n_name"), c("n_nationkey").cast("string"))),
        "dash": tx.join_array(F.split(c("n_name"), "_"), " - "),
    },
    "concat(n_name, ',', cast(n_nationkey as varchar)) as comma, replace(n_name, '_', ' - ') as dash",
)
scalar(
    "F6_default", "customer", "c_custkey",
    lambda: {
        "out": tx.default_if_empty(F.when(c("c_custkey") % 3 == 0, "").when(c("c_custkey") % 3 == 1, c("c_name")), "fallback"),
        "other": tx.default_if_empty(F.lit(""), c("c_mktsegment")),
    },
    "case when c_custkey % 3 = 1 then c_name else 'fallback' end as out, c_mktsegment as other",
)
scalar(
    "F7_format_time", "orders", "o_orderkey",
    lambda: {
        "from_epoch": tm.format_time(F.unix_seconds("o_orderdate").cast("string"), "%Y/%m/%d at %H:%M"),
        "from_text": tm.format_time(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "with_offset": tm.format_time(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")),
        "unreadable": tm.format_time("o_orderpriority"),
    },
    """strftime(o_orderdate, '%Y/%m/%d at %H:%M') as from_epoch, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as from_text,
       strftime(o_orderdate - interval 2 hour, '%Y-%m-%d %H:%M:%S') as with_offset, cast(null as varchar) as unreadable""",
)
scalar(
    "F8_timestamp", "orders", "o_orderkey",
    lambda: {"out": tm.now_text("%d.%m.%Y %H:%M:%S", as_of=c("o_orderdate")), "is_now": F.length(tm.now_text())},
    "strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') as out, 19 as is_now",
)
scalar(
    "F9_uuid", "customer", "c_custkey",
    lambda: {"out": F.uuid()}, None,
)
scalar(
    "F9_uuid_form", "customer", "c_custkey",
    lambda: {"well_formed": F.uuid().rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")},
    "true as well_formed",
)
scalar("F10_sha256", "documents", "doc_id", lambda: {"out": dg.digest("text", "sha256")}, "sha256(text) as out")
scalar("F11_sha512", "documents", "doc_id", lambda: {"out": dg.digest("text", "sha512")}, None)
scalar("F12_md5", "pages", "page_id", lambda: {"out": dg.digest("html", "md5")}, "md5(html) as out")
scalar(
    "F13_digest_base64", "pages", "page_id",
    lambda: {"md5": dg.digest("html", "md5", as_base64=True), "sha256": dg.digest("html", "sha256", as_base64=True)},
    "base64(unhex(md5(html))) as md5, base64(unhex(sha256(html))) as sha256",
)
scalar(
    "F14_sanitize_filename", "pages", "page_id", lambda: {"out": tx.sanitize_filename("url")},
    r"regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g') as out",
)
scalar(
    "F15_duration_text", "customer", "c_custkey",
    lambda: {
        "ms": tm.duration_text_ms(
            F.concat((c("c_custkey") % 24).cast("string"), F.lit("h "), (c("c_custkey") % 60).cast("string"), F.lit("min "),
                     c("c_nationkey").cast("string"), F.lit("ms"))
        ),
        "day": tm.duration_text_ms(F.concat(c("c_nationkey").cast("string"), F.lit("d"))),
        "bad_unit": tm.duration_text_ms(F.concat(c("c_nationkey").cast("string"), F.lit("parsec"))),
        "bad_text": tm.duration_text_ms("c_name"),
    },
    """cast(c_custkey % 24 * 3600000 + c_custkey % 60 * 60000 + c_nationkey as bigint) as ms, cast(c_nationkey * 86400000::bigint as bigint) as day,
       cast(null as bigint) as bad_unit, cast(null as bigint) as bad_text""",
)


def _pairs(spark, sf):
    rows = t.load(spark, sf, "customer").select(
        "c_custkey",
        tx.key_value_map(
            F.array(
                F.concat(F.lit("name="), c("c_name")), F.concat(F.lit("expr=a="), c("c_nationkey").cast("string")),
                F.lit("empty="), F.concat(F.lit("name=last "), c("c_mktsegment")),
            )
        ).alias("m"),
    )
    return rows.select("c_custkey", F.explode("m").alias("key", "value"))


add(
    "F16_key_value_map", _pairs,
    """select c_custkey, unnest(['expr','empty','name']) as key,
              unnest([concat('a=', cast(c_nationkey as varchar)), '', concat('last ', c_mktsegment)]) as value from customer""",
)
scalar(
    "F18_has_template", "pages", "page_id", lambda: {"out": tx.has_template("html")},
    "contains(html, '{{') and contains(html, '}}') as out",
)


def _icons(spark, sf):
    rows = t.nested_runs(spark, sf).select("run_id", F.col("status").alias("run_status"), F.posexplode("tasks").alias("ordinal", "t"))
    s = F.col("t.status")
    return rows.select(
        "run_id", "ordinal", st.icon("run_status", st.RUN_ICONS).alias("run_icon"), st.icon(s, st.TASK_ICONS).alias("task_icon"),
        st.icon(s, st.TASK_DETAIL_ICONS).alias("detail_icon"), st.icon(s, st.LISTING_ICONS).alias("listing_icon"),
    )


add(
    "F19_status_icon", _icons,
    """select t.run_id, t.ordinal, case n.status when 'success' then '✅' when 'failed' then '❌' else 'ℹ️' end as run_icon,
              case t.status when 'success' then '✅' when 'skipped' then '⚠️' when 'running' then 'ℹ️' else '❌' end as task_icon,
              case t.status when 'success' then '✅' when 'skipped' then '⚠️' when 'running' then '🔄' else '❌' end as detail_icon,
              case t.status when 'success' then '✓' when 'skipped' then '⊘' when 'running' then '⟳' else '✗' end as listing_icon
       from nested_tasks t join nested n on n.run_id = t.run_id""",
    ("nested_tasks", "nested"),
)
scalar(
    "F20_seconds_text", "lineitem", "l_orderkey l_linenumber l_partkey l_extendedprice",
    lambda: {
        "one": tm.seconds_text(F.round(c("l_extendedprice") * 10).cast("long"), 1),
        "two": tm.seconds_text(F.round(c("l_extendedprice")).cast("long"), 2),
    },
    """printf('%.1f', cast(round(l_extendedprice * 10) as bigint) / 1000.0::double) as one,
       printf('%.2f', cast(round(l_extendedprice) as bigint) / 1000.0::double) as two""",
)
scalar(
    "F22_reduction_percent", "documents", "doc_id",
    lambda: {
        "percent": F.round(dg.reduction_percent(F.octet_length("text"), F.length("text")), 6),
        "empty": dg.reduction_percent(F.lit(0), F.length("text")),
    },
    """case when octet_length(encode(text)) > 0 then round((octet_length(encode(text))::double - length(text)::double)
       / octet_length(encode(text))::double * 100, 6) else 0.0 end as percent, 0.0::double as empty""",
)
scalar(
    "F23_rfc3339", "events", "event_id", lambda: {"out": tm.rfc3339("ts")},
    "concat(strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g'), 'Z') as out",
)
scalar(
    "F25_destination_parts", "pages", "page_id",
    lambda: dict(zip(("scheme", "host"), tx.destination_parts("url"))),
    "regexp_extract(url, '^([A-Za-z]+):', 1) as scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) as host",
)
scalar(
    "F26_glob_match", "pages", "page_id",
    lambda: {
        "by_name": tx.glob_match("url", ["*.html"]), "by_path": tx.glob_match("url", ["http*://**/{en,de}/*"]),
        "one": tx.glob_match("url", ["[0-9]?"]),
    },
    r"""regexp_full_match(regexp_extract(url, '[^/]*$'), '[^/]*\.html') or regexp_full_match(url, '[^/]*\.html') as by_name,
       regexp_full_match(url, 'http[^/]*://(.*/)?(en|de)/[^/]*') as by_path,
       regexp_full_match(regexp_extract(url, '[^/]*$'), '[0-9][^/]') or regexp_full_match(url, '[0-9][^/]') as one""",
)


def _tags(spark, sf):
    rows = t.load(spark, sf, "customer").select(
        "c_custkey", F.create_map(F.lit("segment"), c("c_mktsegment"), F.lit("nation"), c("c_nationkey").cast("string")).alias("metadata")
    )
    return rows.select(
        "c_custkey", maps.tag("metadata", "segment").alias("segment"), maps.tag("metadata", "absent").alias("absent"),
        maps.tags_match("metadata", {"segment": "BUILDING", "nation": "3"}).alias("both"),
    )


add(
    "F28_tag_lookup", _tags,
    """select c_custkey, c_mktsegment as segment, cast(null as varchar) as absent,
              c_mktsegment = 'BUILDING' and c_nationkey = 3 as both from customer""",
)
scalar(
    "F29_placeholders", "orders", "o_orderkey",
    lambda: {
        "out": tx.fill_placeholders(
            "{type}: {title} ({title}) {unknown} {date}",
            {"title": c("o_orderpriority"), "type": c("o_orderstatus"), "date": F.date_format("o_orderdate", "yyyy-MM-dd")},
        )
    },
    """concat(o_orderstatus, ': ', o_orderpriority, ' (', o_orderpriority, ') {unknown} ', strftime(o_orderdate, '%Y-%m-%d')) as out""",
)


def _lines(spark, sf):
    rows = t.load(spark, sf, "documents").select(
        "doc_id", tx.checksum_line(dg.digest("text", "md5"), F.concat_ws("/", "source", c("doc_id").cast("string"))).alias("line")
    )
    digest, path = tx.parse_checksum_line("line")
    return rows.select("doc_id", "line", digest.alias("digest"), path.alias("path"))


add(
    "F30_checksum_line", _lines,
    """select doc_id, concat(md5(text), '  ', source, '/', cast(doc_id as varchar)) as line, md5(text) as digest,
              concat(source, '/', cast(doc_id as varchar)) as path from documents""",
)

# Templates ------------------------------------------------------------------------------


def _rendered(spark, sf):
    c_ = t.load(spark, sf, "customer")
    n = t.load(spark, sf, "nation").select(c("n_nationkey").alias("c_nationkey"), F.struct("n_name", "n_regionkey").alias("nation"))
    rows = c_.join(n, "c_nationkey").withColumn("variables", F.create_map(F.lit("env"), c("c_mktsegment")))
    template = (
        "{{c_name}} of {{ nation.n_name }}/{{nation.n_regionkey}} [{{upper variables.env}}] {{lower c_name}} "
        "{{default missing \"none\"}}{{missing}}{{nation.nothing}} {{base64_encode c_name}} <b>{{{c_mktsegment}}}</b>"
    )
    return rows.select("c_custkey", tp.render(rows, template).alias("out"))


_RENDERED = """concat(c_name, ' of ', n_name, '/', cast(n_regionkey as varchar), ' [', upper(c_mktsegment), '] ', lower(c_name),
              ' none ', base64(encode(c_name)), ' <b>', c_mktsegment, '</b>')"""
add("R1_render", _rendered, f"select c_custkey, {_RENDERED} as out from customer join nation on c_nationkey = n_nationkey")


def _rendered_data(spark, sf):
    rows = t.load(spark, sf, "customer").withColumns(
        {
            "vars": F.create_map(F.lit("name"), c("c_name"), F.lit("segment"), F.lit("{{name}}")),
            "config": F.create_map(
                F.concat(F.lit("{{ segment }}."), c("c_mktsegment")), F.lit("run {{name}} as {{ name }}{{absent}}"),
                F.lit("plain"), c("c_mktsegment"),
            ),
        }
    )
    return rows.select(
        "c_custkey", F.explode(tp.render_map("config", "vars")).alias("key", "value"),
        F.array_join(tp.render_array(F.array(F.lit("{{name}}"), F.lit("x")), "vars"), ";").alias("items"),
    )


add(
    "R2_render_map", _rendered_data,
    """select c_custkey, unnest([concat('{{name}}.', c_mktsegment), 'plain']) as key,
              unnest([concat('run ', c_name, ' as ', c_name), c_mktsegment]) as value, concat(c_name, ';x') as items from customer""",
)


def _rendered_json(spark, sf):
    deep = F.struct(F.struct(F.lit("{{absent}}!").alias("deep"), F.lit("{{ open").alias("text")).alias("b"))
    listed = F.array(F.struct(F.lit("x {{ segment }}").alias("{{name}}"), c("c_nationkey").alias("n")))
    rows = t.load(spark, sf, "customer").select(
        "c_custkey", F.to_json(F.struct(F.lit("{{name}}").alias("a"), listed.alias("list"), deep.alias("o"))).alias("document"),
        F.create_map(F.lit("name"), c("c_name"), F.lit("segment"), F.concat(F.lit('"'), "c_mktsegment", F.lit("\\"))).alias("vars"),
    )
    return rows.select("c_custkey", tp.render_json("document", "vars").alias("out"))


add(
    "R2_render_json", _rendered_json,
    r"""select c_custkey, concat('{"a":"', c_name, '","list":[{"', c_name, '":"x \"', c_mktsegment, '\\","n":', cast(c_nationkey as varchar),
              '}],"o":{"b":{"deep":"!","text":"{{ open"}}}') as out from customer""",
)


def _context(spark, sf):
    rows = t.nested_runs(spark, sf).select(
        "run_id", "workflow_name", F.struct(F.col("status"), F.size("tasks").alias("count")).alias("workflow"),
        tp.build_variables(
            {"env": "prod", "team": "data"}, {"team": "reports"}, F.create_map(F.lit("run"), F.col("run_id").cast("string"))
        ).alias("variables"),
    )
    return rows.select(
        "run_id", tp.render(rows, "{{variables.env}} {{variables.team}} {{variables.run}} {{workflow.status}} {{workflow.count}}").alias("out")
    )


add(
    "R3_context", _context,
    """select run_id, concat('prod reports ', cast(run_id as varchar), ' ', n.status, ' ', cast(n.o_custkey % 5 as varchar)) as out
       from nested n""",
    ("nested",),
)


def _registered(spark, sf):
    tp.register_helper("initials", lambda value: F.regexp_replace(value, "[^A-Z]", ""))
    rows = t.load(spark, sf, "customer")
    return rows.select("c_custkey", tp.render(rows, "{{initials c_name}}-{{initials c_mktsegment}}").alias("out"))


add(
    "X1_register_helper", _registered,
    """select c_custkey, concat(regexp_replace(c_name, '[^A-Z]', '', 'g'), '-', regexp_replace(c_mktsegment, '[^A-Z]', '', 'g')) as out
       from customer""",
)


def _text_rows(spark, sf):
    rows = t.load(spark, sf, "nation")
    return tp.render_rows(rows, "Nation {{n_name}}\nregion {{n_regionkey}}\n", "n_nationkey")


add(
    "R4_render_rows", _text_rows,
    "select n_nationkey, concat('Nation ', n_name, chr(10), 'region ', cast(n_regionkey as varchar), chr(10)) as content from nation",
)
scalar(
    "F7_parse_time", "events", "event_id",
    lambda: {"seconds": ts(tm.parse_time(F.unix_seconds("ts").cast("string"))), "text": ts(tm.parse_time(tm.rfc3339("ts")))},
    f"{sql_ts('ts')} as seconds, {sql_ts('ts')} as text",
)
