"""Queries of bookkeeping and of ordered picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import rect as R
from tessera.operators import metrics as M
from tessera.operators import spatial as S
from tessera.plans.shapes import _NEAR
from tessera.plans.views import ctes, view


def instance_totals(s, d):
    return M.totals(view(s, d, "g_item"))


TOTALS = ctes("g_item") + " select sum(w * h * demand) as area, sum(demand)::BIGINT as quantity, count(*) filter (where demand > 0) as types from g_item"


def layout_density(s, d):
    placed = view(s, d, "g_placement")
    sheets = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("sheet"), (F.lit(320.0) * (50 + F.col("o_custkey") % 10)).alias("area"))
    return M.layout_density(placed, sheets).select("sheet", "placed", "n", F.round("density", 9).alias("density"))


DENSITY = ctes("g_placement") + """, u as (select sheet, sum((x_max - x_min) * (y_max - y_min)) as placed, count(*) as n from g_placement group by sheet)
 select o_orderkey as sheet, coalesce(placed, 0.0)::DOUBLE as placed, coalesce(n, 0)::BIGINT as n, round(coalesce(placed, 0) / (320.0::DOUBLE * (50 + o_custkey % 10)), 9) as density from orders left join u on sheet = o_orderkey"""


def demand_remaining(s, d):
    return M.remaining(view(s, d, "g_item"), view(s, d, "g_placement"))


REMAINING = ctes("g_item", "g_placement") + " select i.id, demand, coalesce(n, 0)::BIGINT as placed, (demand - coalesce(n, 0))::BIGINT as remaining from g_item i left join (select item, count(*) as n from g_placement group by item) p on p.item = i.id"


def bin_cost(s, d):
    return M.cost(view(s, d, "g_bin"), view(s, d, "g_placement").select("bin", "sheet"))


COST = ctes("g_bin", "g_placement") + " select b.id, stock, coalesce(n, 0)::BIGINT as used, (stock - coalesce(n, 0))::BIGINT as left, (cost * coalesce(n, 0))::BIGINT as cost from g_bin b left join (select bin, count(distinct sheet) as n from g_placement group by bin) p on p.bin = b.id"


def fit_strip(s, d):
    return M.fit_strip(view(s, d, "g_placement")).select("sheet", F.round("width", 6).alias("width"), "n")


FIT = ctes("g_placement") + " select sheet, round(max(x_max) * 1.00001::DOUBLE, 6) as width, count(*) as n from g_placement group by sheet"


def utilisation_pages(s, d):
    """Averages over the pages, not ratios of sums."""
    u = M.utilisation(view(s, d, "g_placement"), 320.0, 50.0, 2.0)
    return u.agg(F.round(F.avg("with_halo"), 6).alias("with_halo"), F.round(F.avg("bare"), 6).alias("bare"), F.count("*").alias("pages"))


PAGES = ctes("g_placement") + """, u as (select sheet, least(sum((x_max - x_min + 2) * (y_max - y_min + 2)) / 16000, 1.0) as h, sum((x_max - x_min) * (y_max - y_min)) / 16000 as b from g_placement group by sheet)
 select round(avg(h), 6) as with_halo, round(avg(b), 6) as bare, count(*) as pages from u"""


def placement_order(s, d):
    """Of items by falling diameter, within each required quality."""
    w = Window.partitionBy("min_quality").orderBy(F.desc(F.col("w") * F.col("w") + F.col("h") * F.col("h")), "id")
    return view(s, d, "g_item").select("id", "min_quality", F.row_number().over(w).alias("place"))


ORDER = ctes("g_item") + " select id, min_quality, row_number() over (partition by min_quality order by w * w + h * h desc, id)::INTEGER as place from g_item"


def left_bottom_top1(s, d):
    """The free candidate of least 10 x + y in every sheet: candidates of kind 0, hazards of kind 1."""
    rects = view(s, d, "g_rect")
    free = S.detect(rects.where("kind = 0"), rects.where("kind = 1")).where(~F.col("hit"))
    cost = F.col("x_max") * 10 + F.col("y_max")
    return free.groupBy("sheet").agg(F.min_by("id", F.struct(cost, F.col("id"))).alias("id"), F.min(cost).alias("cost"))


TOP1 = ctes("g_rect") + f", f as (select a.*, 10 * x_max + y_max as cost from g_rect a where kind = 0 and not exists (select 1 from g_rect b where {_NEAR} and b.kind = 1)) select sheet, arg_min(id, (cost, id)) as id, min(cost) as cost from f group by sheet"


def wave_winner(s, d):
    """Of the runs of a wave the one with more placed, then fewer pages, then first: a bin's orders as runs."""
    runs = view(s, d, "g_placement").groupBy("bin", "sheet").agg(F.count("*").alias("placed"), F.countDistinct("rot").alias("pages"))
    w = Window.partitionBy("bin").orderBy(F.desc("placed"), "pages", "sheet")
    return runs.withColumn("k", F.row_number().over(w)).where("k = 1").select("bin", "sheet", "placed", "pages")


WINNER = ctes("g_placement") + ", r as (select bin, sheet, count(*) as placed, count(distinct rot) as pages from g_placement group by bin, sheet) select bin, sheet, placed, pages from r qualify row_number() over (partition by bin order by placed desc, pages, sheet) = 1"


def solution_density(s, d):
    """Ratio of the sums over all layouts, and the halved one of holes as in a container's own area."""
    placed = view(s, d, "g_placement")
    r = R.rect()
    return placed.groupBy("bin").agg(F.round(F.sum(R.area(r)) / (F.countDistinct("sheet") * 16000.0), 6).alias("density"), F.countDistinct("item").alias("types"), (F.countDistinct("item") <= 1).alias("single"))


SOLUTION = ctes("g_placement") + " select bin, round(sum((x_max - x_min) * (y_max - y_min)) / (count(distinct sheet) * 16000), 6) as density, count(distinct item) as types, count(distinct item) <= 1 as single from g_placement group by bin"

QUERIES = {
    "q31_instance_totals": (instance_totals, TOTALS),
    "q32_layout_density": (layout_density, DENSITY),
    "q33_demand_remaining": (demand_remaining, REMAINING),
    "q34_bin_cost": (bin_cost, COST),
    "q35_fit_strip": (fit_strip, FIT),
    "q36_utilisation_pages": (utilisation_pages, PAGES),
    "q37_placement_order": (placement_order, ORDER),
    "q38_left_bottom_top1": (left_bottom_top1, TOP1),
    "q39_wave_winner": (wave_winner, WINNER),
    "q66_solution_density": (solution_density, SOLUTION),
}
