"""Slots drawn for every template and image, the reasons why a draw isn't asked, and answers under the drawn slots.

A template's open places (a region, a rectangle, a threshold, a number of boxes) are drawn from a grid of choices, of which those
stay that are clear of the image's own values: one pixel more or one box less can't change the answer. Of these the choice with
the smallest hash of template, image and choice is taken, so a draw is the same on every engine and needs no attempts. What a
draw can't mend, as two longest boxes, is told as a reason.

All is told row by row: an eligible image has MOST boxes at most, which is what bounds its array; larger images are left out
before boxes are gathered. Images and boxes are dealt by image once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.operators import answers, generator
from tidemark.operators import templates as T
from tidemark.operators.generator import FEWEST, MOST
from tidemark.sources import entities as E

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
Q = G.QUADRANTS
#: Length thresholds, their margin in pixels and in tenths, the margin of a number of boxes, boxes for a distance.
LENGTHS, PIXELS, TENTH, COUNT_MARGIN, PAIR = (15, 150, 5), 2, 10, 2, 3
#: What the first of four statistics has to lead by; numbers of boxes in an image and in a quadrant.
LEAD, BOXES, QUADRANT_BOXES = 0.02, (3, 12), (2, 6)
#: Sides and grid of a drawn rectangle, factors of the image's noise.
SIDES, GRID, FACTORS = (250, 300, 350, 400, 450), 50, (0.6, 0.7, 0.8, 1.2, 1.35, 1.5)
SLOTS = {"region": "string", "x1": "int", "y1": "int", "x2": "int", "y2": "int", "threshold": "double", "count_threshold": "int"}
#: Why a draw isn't asked.
NO_CHOICE, FEW, LONGEST, SHORTEST = "no choice is clear", "too few boxes for a distance", "longest is tied", "shortest is tied"
FULLEST, LONG_TIED, BRIGHT, NOISY, NEAR = "fullest quadrant is tied", "quadrant with most long ones is tied", "brightest quadrant leads by too little", "noisiest quadrant leads by too little", "count is near its threshold"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pick(what: str, choices: Column) -> Column:
    """The choice with the smallest hash for the row's image_id; null if there is none. Choices are whole numbers or names."""
    key = lambda c: F.md5(F.concat_ws("|", F.lit(what), "image_id", c.cast("string")).cast("binary"))
    return F.array_min(F.transform(choices, lambda c: F.struct(key(c).alias("h"), c.alias("c"))))["c"]


def clear_lengths(sides: Column) -> Column:
    """Length thresholds that no side is within PIXELS or a tenth of."""
    far = lambda v, t: (F.abs(v - t) > PIXELS) & (TENTH * F.abs(v - t) > t)
    return F.filter(F.sequence(*(F.lit(v) for v in LENGTHS)), lambda t: F.forall(sides, lambda v: far(v, t)))


def clear_counts(n: Column, span: tuple[int, int]) -> Column:
    """Numbers of boxes that n isn't near."""
    return F.filter(F.sequence(F.lit(span[0]), F.lit(span[1])), lambda k: F.abs(n - k) >= COUNT_MARGIN)


def leads(prefix: str) -> Column:
    """Is the largest of a statistic's four quadrants ahead of the second? False if one is missing."""
    v = F.sort_array(F.array(*(F.col(f"{prefix}_{q}") for q in Q)), False)
    whole = reduce(lambda a, b: a & b, (F.col(f"{prefix}_{q}").isNotNull() for q in Q))
    return whole & (v[0] - v[1] > LEAD * F.abs(v[0]))


def single(values: Column, top) -> Column:
    """Is there one largest (F.array_max) or smallest value (F.array_min)?"""
    return F.size(F.filter(values, lambda v: v == top(values))) == 1


def drawable(wide: DataFrame, boxes: DataFrame) -> DataFrame:
    """The eligible images of templates.wide with bs, their boxes as structs q, s (long side), cx, cy (twice the centre), and sides."""
    own = boxes.withColumn("m", F.count("*").over(W.partitionBy("image_id"))).where(F.col("m").between(FEWEST, MOST))
    one = F.struct("n", G.quadrant().alias("q"), G.long_side().alias("s"), (F.col("x1") + F.col("x2")).alias("cx"), (F.col("y1") + F.col("y2")).alias("cy"))
    arrays = own.groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("bs")).withColumn("sides", F.transform("bs", lambda b: b["s"]))
    return wide.join(arrays, "image_id")


def _number(cond) -> Column:
    return F.size(F.filter("bs", cond))


def _fullest(values: list[Column]) -> Column:
    """The first quadrant with the largest value."""
    top = F.greatest(*values)
    return reduce(lambda e, i: e.when(values[i] == top, Q[i]), range(1, 4), F.when(values[0] == top, Q[0]))


def drawn(found: DataFrame) -> DataFrame:
    """drawable's rows with a column for every place that is drawn, and with the quadrants that count as noisiest and fullest."""
    regions = F.array(*(F.lit(q) for q in Q))
    clear, sides = clear_lengths(F.col("sides")), F.array(*(F.lit(s) for s in SIDES))
    splits = F.filter(F.col("clear"), lambda t: F.size(F.filter("sides", lambda v: v >= t)).between(1, F.col("n_boxes") - 1))
    noise = lambda i: F.floor(F.col("noise_full") * F.get(F.array(*(F.lit(f) for f in FACTORS)), i) * 2 + 0.5) / 2
    calm = F.filter(F.sequence(F.lit(0), F.lit(len(FACTORS) - 1)), lambda i: (noise(i) > 0) & (F.abs(F.col("noise_full") - noise(i)) * TENTH > noise(i)))
    d = found.withColumns({"clear": clear, "noisy": T._NOISY(), "dense": T._largest("n")})
    d = d.withColumns({"n_clear": F.size("clear"), "n_splits": F.size(splits), "n_calm": F.size(calm), "n_bounds": F.size(clear_counts(F.col("n_boxes"), BOXES))})
    d = d.withColumns({
        "quadrant": pick("l1_quadrant_count", regions), "shown": pick("l1_brightness", F.array(F.lit("full"), *(F.lit(q) for q in Q))), "w": pick("l1_rect_count w", sides), "h": pick("l1_rect_count h", sides),
        "over": pick("l2_count_over_length", splits), "long": pick("l3_quadrant_most_long", F.col("clear")), "boxes": pick("l4_count_branch", clear_counts(F.col("n_boxes"), BOXES)), "part": pick("l4_quadrant_branch region", regions),
        "most": pick("l4_maxlen_branch", F.col("clear")), "u": pick("l4_noise_branch", calm), "k": pick("l5_noisy_quadrant k", F.sequence(*(F.lit(v) for v in QUADRANT_BOXES))), "t": pick("l5_noisy_quadrant", F.col("clear")), "scene_t": pick("l5_scene_quadrant", F.col("clear")),
    })
    places = lambda side: F.sequence(F.lit(0), G.SIZE - side, F.lit(GRID))
    d = d.withColumns({"x": pick("l1_rect_count x", places(F.col("w"))), "y": pick("l1_rect_count y", places(F.col("h"))), "part_boxes": pick("l4_quadrant_branch", clear_counts(T._of_quadrant("n", F.col("part")), QUADRANT_BOXES)), "n_part_bounds": F.size(clear_counts(T._of_quadrant("n", F.col("part")), QUADRANT_BOXES)), "noise_t": noise(F.col("u"))})
    over = lambda q: _number(lambda b: (b["q"] == q) & (b["s"] >= F.col("long")))
    return d.withColumns({f"over_{q}": over(q) for q in Q})


def places() -> dict[str, dict[str, Column]]:
    """The slots of each template that has some, by the columns of drawn."""
    c = F.col
    return {
        "l1_quadrant_count": {"region": c("quadrant")}, "l1_rect_count": {"x1": c("x"), "y1": c("y"), "x2": c("x") + c("w"), "y2": c("y") + c("h")}, "l1_brightness": {"region": c("shown")},
        "l2_count_over_length": {"threshold": c("over")}, "l3_quadrant_most_long": {"threshold": c("long")}, "l4_count_branch": {"threshold": c("boxes")}, "l4_quadrant_branch": {"region": c("part"), "threshold": c("part_boxes")},
        "l4_maxlen_branch": {"threshold": c("most")}, "l4_noise_branch": {"threshold": c("noise_t")}, "l5_noisy_quadrant": {"threshold": c("t"), "count_threshold": c("k")}, "l5_scene_quadrant": {"threshold": c("scene_t")},
    }


#: The number of choices of a template's place, where there may be none; a number is told without the hashes of a draw.
CHOICES = {
    "l2_count_over_length": "n_splits", "l3_quadrant_most_long": "n_clear", "l4_count_branch": "n_bounds", "l4_quadrant_branch": "n_part_bounds", "l4_maxlen_branch": "n_clear", "l4_noise_branch": "n_calm",
    "l5_noisy_quadrant": "n_clear", "l5_scene_quadrant": "n_clear",
}


def checks() -> dict[str, list[tuple[Column, str]]]:
    """What speaks against asking a template of an image, the first that holds counts."""
    few, longest, shortest = F.col("n_boxes") < PAIR, ~single(F.col("sides"), F.array_max), ~single(F.col("sides"), F.array_min)
    fullest = ~single(F.array(*(F.col(f"n_{q}") for q in Q)), F.array_max)
    over = F.array(*(F.col(f"over_{q}") for q in Q))
    close = F.abs(T._of_quadrant("n", F.col("noisy")) - F.col("k")) < COUNT_MARGIN
    return {
        "l2_nearest_ratio": [(few, FEW)], "l2_longest_neighbor": [(few, FEW), (longest, LONGEST)], "l2_longest_shortest_distance": [(few, FEW), (longest, LONGEST), (shortest, SHORTEST)],
        "l3_quadrant_most_ships": [(fullest, FULLEST)], "l3_quadrant_most_long": [(~single(over, F.array_max) | (F.array_max(over) < 1), LONG_TIED)],
        "l3_quadrant_brightest": [(~leads("brightness"), BRIGHT)], "l3_quadrant_noisiest": [(~leads("noise"), NOISY)],
        "l5_noisy_quadrant": [(~leads("noise"), NOISY), (close, NEAR)], "l5_scene_quadrant": [(fullest, FULLEST), ((F.col("scene") == "inshore") & ~leads("noise"), NOISY)],
    }


def answers_drawn() -> dict[str, Column]:
    """The answers of the templates that have slots, by the columns of drawn."""
    c, of = F.col, T._of_quadrant
    inside = lambda b: (b["cx"] >= 2 * c("x")) & (b["cx"] < 2 * (c("x") + c("w"))) & (b["cy"] >= 2 * c("y")) & (b["cy"] < 2 * (c("y") + c("h")))
    long_in = lambda which, t: _number(lambda b: (b["q"] == which) & (b["s"] >= t))
    over = lambda t: _number(lambda b: b["s"] >= t)
    return {
        "l1_quadrant_count": of("n", c("quadrant")), "l1_rect_count": _number(inside), "l1_brightness": F.when(c("shown") == "full", c("brightness_full")).otherwise(of("brightness", c("shown"))),
        "l2_count_over_length": over(c("over")), "l3_quadrant_most_long": _fullest([c(f"over_{q}") for q in Q]),
        "l4_count_branch": F.when(c("n_boxes") > c("boxes"), c("pair_px")).otherwise(c("max_side").cast("double")), "l4_quadrant_branch": F.when(of("n", c("part")) >= c("part_boxes"), of("max", c("part")).cast("double")).otherwise(c("pair_px")),
        "l4_maxlen_branch": F.when(c("max_side") >= c("most"), over(c("most"))).otherwise(c("n_boxes")), "l4_noise_branch": F.when(c("noise_full") > c("noise_t"), c("n_boxes")).otherwise(c("n_edge")),
        "l5_noisy_quadrant": F.when(of("n", c("noisy")) >= c("k"), long_in(c("noisy"), c("t"))).otherwise(of("n", c("noisy"))),
        "l5_scene_quadrant": F.when(c("scene") == "inshore", long_in(c("noisy"), c("scene_t"))).otherwise(long_in(c("dense"), c("scene_t"))),
    }


def branches_drawn() -> dict[str, Column]:
    """The branch that a template takes under its slots."""
    c = F.col
    return {
        "l4_scene_branch": c("scene") == "inshore", "l4_count_branch": c("n_boxes") > c("boxes"), "l4_quadrant_branch": T._of_quadrant("n", c("part")) >= c("part_boxes"), "l4_maxlen_branch": c("max_side") >= c("most"),
        "l4_noise_branch": c("noise_full") > c("noise_t"), "l5_noisy_quadrant": T._of_quadrant("n", c("noisy")) >= c("k"), "l5_scene_quadrant": c("scene") == "inshore",
    }


def told(rows: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """image_id, scene_group, split, template, level, answer_type, SLOTS, reason, num or cat, took: every template on each of drawn's rows.

    A template whose place has no clear choice has NO_CHOICE as its reason; an answer is told only where there is no reason.
    keep: what of a template is asked for (None: all); nothing else is drawn.
    """
    slots, against, own, took = places(), checks(), answers_drawn(), branches_drawn()

    def one(t, level, kind):
        mine = slots.get(t, {})
        missing = [(F.col(CHOICES[t]) == 0, NO_CHOICE)] if t in CHOICES else []
        reason = reduce(lambda e, r: e.when(*r), [*missing, *against.get(t, [])], F.when(F.lit(False), ""))
        value = own[t] if t in own else T.TEMPLATES[t].columns()[1]
        num, cat = (F.lit(None), value) if kind == "category" else (value, F.lit(None))
        fixed = {"template": F.lit(t), "level": F.lit(level), "answer_type": F.lit(kind), **{c: mine.get(c, F.lit(None)).cast(k) for c, k in SLOTS.items()}}
        more = {"reason": reason, "num": F.when(reason.isNull(), num.cast("double")), "cat": F.when(reason.isNull(), cat.cast("string")), "took": took.get(t, F.lit(None)).cast("boolean")}
        return F.struct(*(v.alias(c) for c, v in (fixed | more).items() if keep is None or c in keep))

    each = F.explode(F.array(*(one(t, level, kind) for t, level, kind, _, _ in answers.KINDS))).alias("x")
    return rows.select("image_id", "scene_group", "split", each).select("image_id", "scene_group", "split", "x.*")


def draws(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] | None = None) -> DataFrame:
    """told over all eligible images and label boxes. Every table reads it once, so it isn't written: it has 23 rows an image."""
    return told(drawn(drawable(T.wide(spark, sf_dir), E.labels(spark, sf_dir))), keep)


def candidates(spark: SparkSession, sf_dir: str, split: str = generator.SPLIT) -> DataFrame:
    """The questions under drawn slots as generator.assign takes them."""
    d = draws(spark, sf_dir).where((F.col("split") == split) & F.col("reason").isNull() & (F.col("num").isNotNull() | F.col("cat").isNotNull()))
    cents = F.floor(F.col("num") * 10000 + 0.5).cast("long").cast("string")
    balance = F.when(F.col("took"), "then").when(~F.col("took"), "else").otherwise(F.coalesce("cat", cents))
    return d.withColumns({"balance": balance, "zero": F.coalesce(F.col("num") == 0, F.lit(False)), "pri": F.md5(F.concat_ws("|", "template", "image_id").cast("binary"))})


# ---- the same in SQL


def _pick(what: str, choices: str) -> str:
    return f"(list_sort([{{'h': md5('{what}|' || image_id || '|' || v), 'v': v}} for v in {choices}])[1]).v"


def _of(prefix: str, which: str) -> str:
    return T._pick(prefix, which)


_NAMES = "[" + ", ".join(f"'{q}'" for q in Q) + "]"
_SPAN = lambda a, b, step=1: f"range({a}, {b + 1}, {step})"
_CLEAR_COUNTS = lambda n, span: f"[z for z in {_SPAN(*span)} if abs({n} - z) >= {COUNT_MARGIN}]"
_NOISE_T = lambda i: f"(floor(noise_full * list_extract({list(FACTORS)}::double[], ({i} + 1)::bigint) * 2 + 0.5) / 2)"
_LEADS = lambda p: f"coalesce(list_sort([{', '.join(f'{p}_{q}' for q in Q)}], 'desc')[1] - list_sort([{', '.join(f'{p}_{q}' for q in Q)}], 'desc')[2] > {LEAD} * abs(list_sort([{', '.join(f'{p}_{q}' for q in Q)}], 'desc')[1]), false) and {' and '.join(f'{p}_{q} is not null' for q in Q)}"
_SINGLE = lambda xs, top: f"len([s for s in {xs} if s = {top}({xs})]) = 1"
_N = lambda cond: f"len([b for b in bs if {cond}])"
_PLACES = {
    "l1_quadrant_count": {"region": "quadrant"}, "l1_rect_count": {"x1": "x", "y1": "y", "x2": "x + w", "y2": "y + h"}, "l1_brightness": {"region": "shown"},
    "l2_count_over_length": {"threshold": "over_t"}, "l3_quadrant_most_long": {"threshold": "long_t"}, "l4_count_branch": {"threshold": "boxes"}, "l4_quadrant_branch": {"region": "part", "threshold": "part_boxes"},
    "l4_maxlen_branch": {"threshold": "most"}, "l4_noise_branch": {"threshold": "noise_t"}, "l5_noisy_quadrant": {"threshold": "t", "count_threshold": "k"}, "l5_scene_quadrant": {"threshold": "scene_t"},
}
_COUNTS_N, _COUNTS_OVER = (f"[{', '.join(f'{p}_{q}' for q in Q)}]" for p in ("n", "over"))
_FEW, _LONG, _SHORT = (f"n_boxes < {PAIR}", FEW), (f"not ({_SINGLE('sides', 'list_max')})", LONGEST), (f"not ({_SINGLE('sides', 'list_min')})", SHORTEST)
_FULL, _NOISE = (f"not ({_SINGLE(_COUNTS_N, 'list_max')})", FULLEST), (f"not ({_LEADS('noise')})", NOISY)
_CHECKS = {
    "l2_nearest_ratio": [_FEW], "l2_longest_neighbor": [_FEW, _LONG], "l2_longest_shortest_distance": [_FEW, _LONG, _SHORT], "l3_quadrant_most_ships": [_FULL],
    "l3_quadrant_most_long": [(f"not ({_SINGLE(_COUNTS_OVER, 'list_max')}) or list_max({_COUNTS_OVER}) < 1", LONG_TIED)], "l3_quadrant_brightest": [(f"not ({_LEADS('brightness')})", BRIGHT)], "l3_quadrant_noisiest": [_NOISE],
    "l5_noisy_quadrant": [_NOISE, (f"abs({_of('n', 'noisy')} - k) < {COUNT_MARGIN}", NEAR)], "l5_scene_quadrant": [_FULL, (f"scene = 'inshore' and {_NOISE[0]}", NOISY)],
}
_ANSWERS = {
    "l1_quadrant_count": _of("n", "quadrant"), "l1_rect_count": _N("b.cx >= 2 * x and b.cx < 2 * (x + w) and b.cy >= 2 * y and b.cy < 2 * (y + h)"), "l1_brightness": f"case when shown = 'full' then brightness_full else {_of('brightness', 'shown')} end",
    "l2_count_over_length": _N("b.s >= over_t"), "l3_quadrant_most_long": "case " + " ".join(f"when over_{q} = list_max({_COUNTS_OVER}) then '{q}'" for q in Q) + " end",
    "l4_count_branch": "case when n_boxes > boxes then pair_px else max_side end", "l4_quadrant_branch": f"case when {_of('n', 'part')} >= part_boxes then {_of('max', 'part')} else pair_px end",
    "l4_maxlen_branch": f"case when max_side >= most then {_N('b.s >= most')} else n_boxes end", "l4_noise_branch": "case when noise_full > noise_t then n_boxes else n_edge end",
    "l5_noisy_quadrant": f"case when {_of('n', 'noisy')} >= k then {_N('b.q = noisy and b.s >= t')} else {_of('n', 'noisy')} end", "l5_scene_quadrant": f"case when scene = 'inshore' then {_N('b.q = noisy and b.s >= scene_t')} else {_N('b.q = dense and b.s >= scene_t')} end",
}


def _told(t: str, level: int, kind: str) -> str:
    mine = _PLACES.get(t, {})
    missing = [(" or ".join(f"{v} is null" for v in mine.values()), NO_CHOICE)] if mine else []
    against = [*missing, *_CHECKS.get(t, [])]
    reason = "case " + " ".join(f"when {e} then '{r}'" for e, r in against) + " end" if against else "cast(null as varchar)"
    slots = ", ".join(f"cast({mine.get(c, 'null')} as {'varchar' if k == 'string' else k}) as {c}" for c, k in SLOTS.items())
    value = f"cast({_ANSWERS[t]} as {'varchar' if kind == 'category' else 'double'})" if t in _ANSWERS else "cast(null as double)"
    num, cat = ("cast(null as double)", value if t in _ANSWERS else "cast(null as varchar)") if kind == "category" else (value, "cast(null as varchar)")
    return f"select image_id, '{t}' as template, {level} as level, '{kind}' as answer_type, {slots}, {reason} as reason, {num} as own_num, {cat} as own_cat from drawn"


_DRAWS = f"""{E.with_entities("images", "label")}{T.with_tools("facts", "nearest", "stats")}, {answers._answers_sql("label")},
bx as (select image_id, list({{'q': case when y1 + y2 < {G.SIZE} then case when x1 + x2 < {G.SIZE} then '{Q[0]}' else '{Q[1]}' end else case when x1 + x2 < {G.SIZE} then '{Q[2]}' else '{Q[3]}' end end, 's': greatest(x2 - x1, y2 - y1), 'cx': x1 + x2, 'cy': y1 + y2}} order by n) as bs, list(greatest(x2 - x1, y2 - y1) order by n) as sides from label group by image_id),
per as (select facts.*, wide.* exclude (vec_id), {T._PX} as pair_px, bs, sides, [z for z in {_SPAN(*LENGTHS)} if len([s for s in sides if abs(s - z) <= {PIXELS} or {TENTH} * abs(s - z) <= z]) = 0] as clear, {T._most("noise")} as noisy, {T._most("n")} as dense
  from facts join bx using (image_id) left join nearest using (image_id) {T._JOIN} where n_boxes between {FEWEST} and {MOST}),
first_draw as (select *, {_pick("l1_quadrant_count", _NAMES)} as quadrant, {_pick("l1_brightness", "['full', " + _NAMES[1:])} as shown, {_pick("l1_rect_count w", str(list(SIDES)))} as w, {_pick("l1_rect_count h", str(list(SIDES)))} as h,
  {_pick("l2_count_over_length", "[z for z in clear if len([s for s in sides if s >= z]) between 1 and n_boxes - 1]")} as over_t, {_pick("l3_quadrant_most_long", "clear")} as long_t, {_pick("l4_count_branch", _CLEAR_COUNTS("n_boxes", BOXES))} as boxes, {_pick("l4_quadrant_branch region", _NAMES)} as part,
  {_pick("l4_maxlen_branch", "clear")} as most, {_pick("l4_noise_branch", f"[z for z in range(0, {len(FACTORS)}) if {_NOISE_T('z')} > 0 and abs(noise_full - {_NOISE_T('z')}) * {TENTH} > {_NOISE_T('z')}]")} as u,
  {_pick("l5_noisy_quadrant k", _SPAN(*QUADRANT_BOXES))} as k, {_pick("l5_noisy_quadrant", "clear")} as t, {_pick("l5_scene_quadrant", "clear")} as scene_t from per),
drawn as materialized (select *, {_pick("l1_rect_count x", f"range(0, {G.SIZE} - w + 1, {GRID})")} as x, {_pick("l1_rect_count y", f"range(0, {G.SIZE} - h + 1, {GRID})")} as y, {_pick("l4_quadrant_branch", _CLEAR_COUNTS("part_n", QUADRANT_BOXES))} as part_boxes, {_NOISE_T("u")} as noise_t,
  {", ".join(_N(f"b.q = '{q}' and b.s >= long_t") + f" as over_{q}" for q in Q)} from (select *, {_of("n", "part")} as part_n from first_draw)),
told as ({" union all ".join(_told(t, level, kind) for t, level, kind, _, _ in answers.KINDS)}),
draws as (select d.* exclude (own_num, own_cat), case when reason is null then case when template in ({", ".join(f"'{t}'" for t in _ANSWERS)}) then own_num else a.num end end as num, case when reason is null then case when template in ({", ".join(f"'{t}'" for t in _ANSWERS)}) then own_cat else a.cat end end as cat
  from told d left join label_answers a using (template, image_id))"""


@query(f"{_DRAWS} select image_id, template, {', '.join(SLOTS)}, reason from draws")
def slot_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of every template on every eligible image, and why a question isn't asked."""
    return draws(spark, sf_dir).select("image_id", "template", *SLOTS, "reason")


@query(f"{_DRAWS} select image_id, template, level, answer_type, {', '.join(SLOTS)}, num, cat from draws where reason is null and (num is not null or cat is not null)")
def slotted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions that can be asked under their drawn slots, with their answers."""
    asked = draws(spark, sf_dir).where(F.col("reason").isNull() & (F.col("num").isNotNull() | F.col("cat").isNotNull()))
    return asked.select("image_id", "template", "level", "answer_type", *SLOTS, "num", "cat")


@query(f"{_DRAWS} select template, coalesce(reason, 'asked') as reason, count(*) as n from draws group by all")
def slot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images each template can be asked of, and what speaks against the others."""
    return draws(spark, sf_dir, ("template", "reason")).groupBy("template", F.coalesce("reason", F.lit("asked")).alias("reason")).agg(F.count("*").alias("n"))
