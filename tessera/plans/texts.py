"""Queries of text forms: SVG paths and documents, request records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import ring as P
from tessera.functions import svg as G
from tessera.plans.views import ctes, view
from tessera.streaming import requests as Q

_PATH = ", g_path as (select id, 'M ' || array_to_string(list_transform(ring, lambda p: printf('%.4f', p.x) || ' ' || printf('%.4f', p.y)), ' L ') || ' Z' as d from g_poly)"


def svg_tokens(s, d):
    paths = view(s, d, "g_poly").select("id", G.path(F.col("ring")).alias("d"))
    return paths.select("id", F.posexplode(G.tokens(F.col("d"))).alias("i", "token"))


TOKENS = ctes("g_poly") + _PATH + r", t as (select id, regexp_extract_all(d, '[MmLlHhVvCcSsQqTtAaZz]|[^MmLlHhVvCcSsQqTtAaZz\s]+') as t from g_path) select id, unnest(range(len(t)))::INTEGER as i, unnest(t) as token from t"


def svg_roundtrip(s, d):
    svg = F.concat(F.lit('<svg><path fill="none" d="'), G.path(F.col("ring")), F.lit('"/></svg>'))
    back = view(s, d, "g_poly").select("id", "ring", G.ring(G.path_of(svg)).alias("back"))
    return back.select("id", F.size("back").cast("long").alias("n"), F.round(P.signed_area(F.col("back")), 3).alias("area"))


ROUNDTRIP = ctes("g_poly") + ", v as (select id, ring[i].x as x, ring[i].y as y, ring[i % 12 + 1].x as nx, ring[i % 12 + 1].y as ny from (select id, ring, unnest(range(1, 13)) as i from g_poly)) select id, count(*) as n, round(sum(x * ny - nx * y) / 2, 3) as area from v group by id"


def bezier_points(s, d):
    p = [(F.col("ring")[k]["x"], F.col("ring")[k]["y"]) for k in range(4)]
    both = view(s, d, "g_poly").select("id", F.posexplode(F.arrays_zip(G.bezier(p).alias("c"), G.bezier(p[:3]).alias("q"))).alias("i", "b"))
    return both.select("id", "i", *[(F.round(F.col(f"b.{c}.{a}"), 8) + F.lit(0.0)).alias(f"{c}{a}") for c in "cq" for a in "xy"])


_CUBIC = "(1-t)**3 * ring[1].{0} + 3 * (1-t)**2 * t * ring[2].{0} + 3 * (1-t) * t**2 * ring[3].{0} + t**3 * ring[4].{0}"
_QUADRATIC = "(1-t)**2 * ring[1].{0} + 2 * (1-t) * t * ring[2].{0} + t**2 * ring[3].{0}"
BEZIER = ctes("g_poly") + ", t as (select id, ring, (unnest(range(1, 17)) - 1)::INTEGER as i from g_poly), u as (select *, (i + 1) / 16.0::DOUBLE as t from t) select id, i, " + ", ".join(f"round({f.format(a)}, 8) + 0.0 as {c}{a}" for c, f in (("c", _CUBIC), ("q", _QUADRATIC)) for a in "xy") + " from u"


def svg_render(s, d):
    """A document a sheet of placements."""
    p = view(s, d, "g_placement")
    body = G.rect_body(F.col("x_min"), F.col("y_min"), F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), "#aabbcc")
    pages = p.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("id", body.alias("body")))).alias("b"))
    return pages.select("sheet", G.document(F.lit(320.0), F.lit(50.0), F.transform("b", lambda x: x["body"])).alias("svg"))


_ATTR = " || ".join(f"' {k}=\"' || printf('%.2f', {v}) || '\"'" for k, v in (("x", "x_min"), ("y", "y_min"), ("width", "x_max - x_min"), ("height", "y_max - y_min")))
RENDER = ctes("g_placement") + f""" select sheet, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 320.00 50.00">' || chr(10) || string_agg(body, chr(10) order by id, body) || chr(10) || '</svg>' as svg from (select *, '<rect' || {_ATTR} || ' fill="#aabbcc"/>' as body from g_placement) group by sheet"""


def request_parse(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    fields = F.struct(
        F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("r"), "user_id")).alias("correlationId"), F.when(F.col("event_id") % 7 != 0, F.get_json_object("props", "$.k").cast("double")).alias("binWidth"), F.lit(100.0).alias("binHeight"),
        (F.col("user_id") - 100).alias("amountOfParts"), F.when(F.col("event_id") % 3 == 0, F.lit(4)).alias("amountOfRotations"), F.when(F.col("event_type") == "error", F.lit(True)).alias("cancelled"))
    rows = Q.parse(e.select("event_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")))
    return rows.select("event_id", "correlation_id", "cancelled", "bin_width", "amount", "rotations", "error")


PARSE = """with e as (select event_id, case when event_id % 50 <> 0 then 'r' || user_id end as correlation_id, coalesce(event_type = 'error', false) as cancelled, case when event_id % 7 <> 0 then json_extract_string(props, '$.k')::DOUBLE end as bin_width,
 greatest(user_id - 100, 0)::BIGINT as amount, case when event_id % 3 = 0 then 4 else 8 end::BIGINT as rotations from events)
 select *, case when correlation_id is null then 'correlationId is missing' when cancelled then null when coalesce(bin_width, 0) <= 0 then 'bin is missing' when amount = 0 then 'no parts' end as error from e"""


def cancellation_state(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("at"), (F.col("event_type") == "error").alias("cancel"), "event_id")
    return Q.with_cancellations(e, 86_400).select("event_id", "id", "dropped")


CANCEL = """with e as (select user_id as id, floor(epoch(ts))::BIGINT as at, event_type = 'error' as cancel, event_id from events)
 select event_id, id, exists (select 1 from e c where c.id = e.id and c.cancel and c.at between e.at - 86400 and e.at) as dropped from e where not cancel"""


def retry_routing(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    rows = e.select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 4).cast("int").alias("attempt"), (F.col("event_type") != "view").alias("retryable"), F.col("event_type").alias("topic"))
    return Q.route(rows).select("event_id", "next_attempt", "next_topic", "delay_s")


ROUTING = """with e as (select event_id, case when event_id % 4 <> 0 then event_id % 4 else 1 end::INTEGER as a, event_type <> 'view' as r, event_type as t from events)
 select event_id, case when r and a < 3 then a + 1 end as next_attempt, case when r and a < 3 then t || '.retry.' || a end as next_topic, case when r and a < 3 then case a when 1 then 5 else 60 end end as delay_s from e"""


def offset_watermark(s, d):
    return Q.watermark(view(s, d, "g_offset"))


WATERMARK = ctes("g_offset") + ", g as (select part, coalesce(min(pos) filter (where not done), max(pos) + 1)::BIGINT as commit from g_offset group by part) select g.part, g.commit, count(*) filter (where done and pos > g.commit) as pending from g join g_offset o on o.part = g.part group by g.part, g.commit"

QUERIES = {
    "q49_svg_tokens": (svg_tokens, TOKENS),
    "q50_svg_roundtrip": (svg_roundtrip, ROUNDTRIP),
    "q51_bezier_points": (bezier_points, BEZIER),
    "q52_svg_render": (svg_render, RENDER),
    "q53_request_parse": (request_parse, PARSE),
    "q54_cancellation_state": (cancellation_state, CANCEL),
    "q55_retry_routing": (retry_routing, ROUTING),
    "q56_offset_watermark": (offset_watermark, WATERMARK),
}
