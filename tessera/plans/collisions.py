"""Queries of collision detection and collection, with their filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rect as R
from tessera.operators import spatial as S
from tessera.plans.shapes import _NEAR, boxed
from tessera.plans.views import ctes, view


def collect_collisions(s, d):
    """Parts of kind 0 against the hazards of kinds 1 and 2."""
    rects = view(s, d, "g_rect")
    out = S.collect(rects.where("kind = 0"), rects.where("kind <> 0"))
    return out.select("a_id", "b_id", F.coalesce(R.overlap_area(R.rect("a_"), R.rect("b_")), F.lit(0.0)).alias("area"))


COLLECT = ctes("g_rect") + f" select a.id as a_id, b.id as b_id, (least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) * (least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) as area from g_rect a join g_rect b on {_NEAR} where a.kind = 0 and b.kind <> 0"


def detect_collisions(s, d):
    rects = view(s, d, "g_rect")
    return S.detect(rects.where("kind = 0"), rects.where("kind <> 0")).select("id", "hit")


DETECT = ctes("g_rect") + f" select a.id, exists (select 1 from g_rect b where {_NEAR} and b.kind <> 0) as hit from g_rect a where a.kind = 0"


def layout_feasible(s, d):
    return S.feasible(view(s, d, "g_placement"), cell=64.0)


FEASIBLE = ctes("g_placement") + f" select sheet, not bool_or(hit) as feasible from (select a.sheet, exists (select 1 from g_placement b where {_NEAR} and a.id <> b.id) as hit from g_placement a) group by sheet"


def quality_filter(s, d):
    """Zones below an item's required quality are irrelevant; items that require none see all zones."""
    rects = view(s, d, "g_rect")
    items = rects.where("kind = 0").withColumn("required", F.when(F.col("id") % 2 == 0, F.col("id") % 9 + 1))
    skip = F.coalesce(F.col("b_quality") < F.col("a_required"), F.lit(False))
    hits = S.collect(items, rects.where("kind = 1"), irrelevant=skip)
    return hits.groupBy("a_id").agg(F.count("*").alias("n"), F.min("b_quality").alias("worst"))


QUALITY = ctes("g_rect") + f", i as (select *, case when id % 2 = 0 then id % 9 + 1 end as required from g_rect where kind = 0) select a.id as a_id, count(*) as n, min(b.quality) as worst from i a join g_rect b on {_NEAR} where b.kind = 1 and not coalesce(b.quality < required, false) group by a.id"


def containment(s, d):
    """Circles wholly inside a polygon's box, by box relation."""
    a, b = R.rect("a_"), R.rect("b_")
    pairs = S.spatial_join(S.prefixed(boxed(s, d, "g_circle"), "a_"), S.prefixed(boxed(s, d, "g_rect"), "b_"), lambda: R.contains(b, a))
    return pairs.select("a_id", "b_id")


CONTAINMENT = ctes("g_circle", "g_rect") + " select c.id as a_id, r.id as b_id from g_circle c join g_rect r on c.sheet = r.sheet and x_min <= cx - c.r and y_min <= cy - c.r and x_max >= cx + c.r and y_max >= cy + c.r"


def snapshot_diff(s, d):
    """Placements to keep, to remove and to add between two versions of all layouts."""
    rows = view(s, d, "g_placement").select("sheet", "id", "item", "rot")
    old = rows.where("id % 7 <> 0")
    new = rows.where("id % 5 <> 0").withColumn("rot", F.when(F.col("id") % 11 == 0, (F.col("rot") + 90) % 360).otherwise(F.col("rot")))
    gone, added = old.exceptAll(new).withColumn("change", F.lit("remove")), new.exceptAll(old).withColumn("change", F.lit("add"))
    return gone.unionByName(added).unionByName(old.intersectAll(new).withColumn("change", F.lit("keep")))


SNAPSHOT = ctes("g_placement") + """, o as (select sheet, id, item, rot from g_placement where id % 7 <> 0), n as (select sheet, id, item, case when id % 11 = 0 then (rot + 90) % 360 else rot end as rot from g_placement where id % 5 <> 0)
 select *, 'remove' as change from (select * from o except all select * from n) union all select *, 'add' from (select * from n except all select * from o) union all select *, 'keep' from (select * from o intersect all select * from n)"""

QUERIES = {
    "q26_collect_collisions": (collect_collisions, COLLECT),
    "q27_detect_collisions": (detect_collisions, DETECT),
    "q28_layout_feasible": (layout_feasible, FEASIBLE),
    "q29_quality_filter": (quality_filter, QUALITY),
    "q30_containment": (containment, CONTAINMENT),
    "q48_snapshot_diff": (snapshot_diff, SNAPSHOT),
}
