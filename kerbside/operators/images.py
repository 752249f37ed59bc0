"""Photos as grids of grey values: hashes of differences, statistics of blocks, and signs in metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up, haversine_km
from ..plans.dialect import half_up as sql_half_up
from ..plans.dialect import km
from ..plans.registry import query
from .integrity import ALIKE_BITS, hash_classes, near_hashes, noisy_or_of, weights_of

c = F.col
#: The grid of a hash, the blocks of an error level, how far an outlier is from the mean and
#: above what, the shares of outliers of a local change, and its peak.
COLUMNS, ROWS, BLOCK, SIGMAS, LEAST, SHARE, PEAK = 9, 8, 16, 3, 4, (0.004, 0.15), (6.0, 3.0, 0.5)


def difference_hash(grid: Column) -> Column:
    """64 bits of a grid of 8 rows of 9 grey values, row by row: whether each is above the one to its
    right, the first being the highest bit. Null for grids of another size or with nulls."""
    # each value's place in the grid, without the last of each row
    at = [y * COLUMNS + x for y in range(ROWS) for x in range(COLUMNS - 1)]
    bits = F.array(*[F.when(grid[k] > grid[k + 1], F.lit(1)).otherwise(F.lit(0)) for k in at])
    whole = (F.size(grid) == COLUMNS * ROWS) & F.forall(grid, lambda v: v.isNotNull())
    return F.when(F.coalesce(whole, F.lit(False)), F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b.cast("long"))))


def grids(t) -> DataFrame:
    """(id, grid, level): an embedding of 64 values as a grid of 8 rows; each row's ninth value is the next
    row's first. ``level`` are whole numbers, as an error level has."""
    v = t.embeddings.select(c("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).filter("size(v) = 64")
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda y: F.concat(F.slice("v", y * 8 + 1, 8), F.array(c("v")[(y * 8 + 8) % 64]))))
    return v.select("id", grid.alias("grid"), F.transform("v", lambda x: F.floor(F.abs(x) * 100.0)).alias("level"))


def image_hash_rows(t) -> DataFrame:
    return grids(t).select("id", difference_hash(c("grid")).alias("hash"))


BITS = "e as (select vec_id as id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where len(embedding) = 64)"
HALF = "cast(list_sum(list_transform(range({0}, {1}), lambda k: case when v[k + 1] > v[(k + 1) % 64 + 1] then 1::bigint << cast({1} - 1 - k as int) else 0 end)) as bigint)"
PHOTO_BITS = f"{BITS}, h as (select id, {HALF.format(0, 32)} as hi, {HALF.format(32, 64)} as lo from e), r as (select hi, lo, min(id) as rep_id, count(*) as members from h group by 1, 2)"


@query(f"with {PHOTO_BITS} select h.id, printf('%08x%08x', hi, lo) as hash, rep_id, members from h join r using (hi, lo)")
def image_hashes(t):
    """The hash of every grid as 16 hexadecimal digits, and the class of those with the same one."""
    rows = image_hash_rows(t)
    return rows.join(hash_classes(rows), "hash").select("id", F.lower(F.lpad(F.hex("hash"), 16, "0")).alias("hash"), "rep_id", "members")


@query(f"with {PHOTO_BITS} select a.rep_id as a_id, b.rep_id as b_id, cast(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) as int) as distance from r a join r b on a.rep_id < b.rep_id where bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {ALIKE_BITS}")
def image_hash_pairs(t):
    """Near matches of the hashed grids, between the representatives of equal hashes."""
    return near_hashes(image_hash_rows(t))


def block_means(level: Column, width: int, height: int, block: int = BLOCK) -> Column:
    """Means of whole blocks of a grid in row order, row by row of blocks; a rest at the right and the
    bottom belongs to none."""
    corners = [(y * block * width + x * block) for y in range(height // block) for x in range(width // block)]
    total = lambda at: F.aggregate(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda y: F.slice(level, F.lit(at + 1) + y * width, block))), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[total(at) / float(block * block) for at in corners])


def block_statistics(df: DataFrame, width: int, height: int, block: int = BLOCK) -> DataFrame:
    """(id, mean_error, median_error, peak_error, outlier_ratio, localized) of (id, level): statistics of the
    means of blocks, and whether few of them stand out so far that a part may have been put in.
    Grids of another size, or with nulls, go."""
    whole = df.filter((F.size("level") == width * height) & F.forall("level", lambda v: v.isNotNull()))
    b = whole.select("id", block_means(c("level"), width, height, block).alias("b"))
    n = F.size("b")
    fold = lambda f: F.aggregate("b", F.lit(0.0), lambda s, v: s + f(v))
    b = b.withColumn("mean", fold(lambda v: v) / n)
    b = b.withColumns({"sd": F.sqrt(fold(lambda v: (v - c("mean")) * (v - c("mean"))) / n), "median": F.array_sort("b")[F.floor(n / 2).cast("int")], "peak": F.array_max("b")})
    ratio = F.size(F.filter("b", lambda v: (v > c("mean") + SIGMAS * c("sd")) & (v > LEAST))) / n
    b = b.withColumn("ratio", ratio)
    local = (c("ratio") > SHARE[0]) & (c("ratio") < SHARE[1]) & (c("peak") > F.greatest(F.lit(PEAK[0]), F.lit(PEAK[1]) * (c("median") + PEAK[2])))
    return b.select("id", half_up(c("mean"), 2).alias("mean_error"), half_up(c("median"), 2).alias("median_error"), half_up(c("peak"), 2).alias("peak_error"), half_up(c("ratio"), 4).alias("outlier_ratio"), local.alias("localized"))


@query(f"""
    with {BITS}, l as (select id, list_transform(v, lambda x: floor(abs(x) * 100e0)) as v from e),
    b as (select id, list_transform(range(16), lambda k: (v[k // 4 * 16 + k % 4 * 2 + 1] + v[k // 4 * 16 + k % 4 * 2 + 2] + v[k // 4 * 16 + k % 4 * 2 + 9] + v[k // 4 * 16 + k % 4 * 2 + 10]) / 4e0) as b from l),
    m as (select *, list_sum(b) / 16e0 as mean from b), s as (select *, sqrt(list_sum(list_transform(b, lambda x: (x - mean) * (x - mean))) / 16e0) as sd, list_sort(b)[9] as median, list_max(b) as peak from m),
    o as (select *, len(list_filter(b, lambda x: x > mean + 3e0 * sd and x > 4)) / 16e0 as ratio from s)
    select id, {sql_half_up('mean', 2)} as mean_error, {sql_half_up('median', 2)} as median_error, {sql_half_up('peak', 2)} as peak_error, {sql_half_up('ratio', 4)} as outlier_ratio, ratio > 0.004e0 and ratio < 0.15e0 and peak > greatest(6e0, 3e0 * (median + 0.5e0)) as localized from o""")
def block_errors(t):
    """Error levels in blocks of 2 x 2: the grids given are 8 x 8, so none holds a block of 16 x 16."""
    return block_statistics(grids(t), 8, 8, 2)


#: Programs that make and that edit pictures, widths of screens, and the weights of the signs.
AI_TOOL = r"stable.?diffusion|midjourney|dall.?e|firefly|imagen|ai.generated|generative|comfyui|automatic1111|novelai|leonardo\.ai|sdxl|flux\.1|ideogram|gemini|chatgpt|openai"
EDITOR = r"photoshop|gimp|lightroom|snapseed|picsart|canva|facetune|pixlr|affinity|paint\.net|photopea|remini"
SCREENS = (720, 750, 828, 1080, 1125, 1170, 1179, 1242, 1284, 1290, 1440, 1366, 1536, 1920, 2560)
SIGNS = {"ai_metadata": 0.8, "edited": 0.3, "no_camera_metadata": 0.1, "date_mismatch": 0.35, "gps_mismatch": 0.4, "screenshot_like": 0.25, "low_resolution": 0.15}
DAYS_APART, KM_APART, SMALL = 2, 3.0, 400


def photo_signals(df: DataFrame) -> DataFrame:
    """``df`` of photos with a flag for each sign of its metadata, ``photo_score`` and ``signals``.

    Needs make, model, software, description, format, has_exif, width, height, taken_on, reported_on,
    photo_lat, photo_lng, lat and lng, each of which may be null; what isn't known is no sign, but for
    a camera that isn't named.
    """
    words = F.concat_ws(" ", "software", "description")
    signs = {
        "ai_metadata": words.rlike(f"(?i){AI_TOOL}|trainedAlgorithmicMedia"), "edited": F.coalesce("software", F.lit("")).rlike(f"(?i){EDITOR}"), "no_camera_metadata": c("make").isNull() & c("model").isNull(),
        "date_mismatch": F.abs(F.datediff("taken_on", "reported_on")) > DAYS_APART, "gps_mismatch": haversine_km(c("photo_lat"), c("photo_lng"), c("lat"), c("lng")) > KM_APART,
        "screenshot_like": (c("format") == "png") & ~c("has_exif") & c("width").isin(*SCREENS), "low_resolution": F.greatest("width", "height") < SMALL,
    }
    flagged = df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in signs.items()})
    return flagged.withColumn("photo_score", half_up(noisy_or_of(weights_of(SIGNS)), 2)).withColumn("signals", F.concat_ws(",", *[F.when(c(k), k) for k in SIGNS]))


SCORE = sql_half_up("1e0 - " + " * ".join(f"(1e0 - case when {k} then {w}e0 else 0e0 end)" for k, w in SIGNS.items()), 2)


@query(f"""
    with s as (select id, regexp_matches(concat_ws(' ', software, description), '(?i){AI_TOOL}|trainedAlgorithmicMedia') as ai_metadata, regexp_matches(coalesce(software, ''), '(?i){EDITOR}') as edited, make is null and model is null as no_camera_metadata,
        coalesce(abs(date_diff('day', reported_on, taken_on)) > {DAYS_APART}, false) as date_mismatch, coalesce({km('photo_lat', 'photo_lng', 'lat', 'lng')} > {KM_APART}, false) as gps_mismatch,
        format = 'png' and not has_exif and width in {SCREENS} as screenshot_like, greatest(width, height) < {SMALL} as low_resolution from photos)
    select id, {SCORE} as photo_score, concat_ws(',', {", ".join(f"case when {k} then '{k}' end" for k in SIGNS)}) as signals from s""")
def image_meta_signals(t):
    """Signs of made, edited, old or far-away photos, from columns of metadata."""
    return photo_signals(t.photos).select("id", "photo_score", "signals")
