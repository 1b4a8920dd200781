"""License scans: MinHash bands over overlapping text windows, exact containment after.

Texts are lower-cased words (runs of letters and digits) and shingles of five.
A window is 12 shingles long and starts at every fourth; each of its ``BANDS``
bands is one MinHash (the least of a keyed hash of its shingles).  A template of
at least 8 shingles has a window at each of its shingles, so a passage always
faces one that is aligned with it: windows with a Jaccard similarity of ``s``
meet in some band with probability 1 - (1 - s) ** BANDS, which is 0.994 at 0.47,
what the worst aligned window of a passage with containment 0.8 has.  Shorter
templates use windows of one shingle, at every shingle: the MinHash of one
element is that element, and a passage with containment 0.8 shares one at least.

A retrieved template is verified exactly: the share of its distinct shingles that occur
in the document, wherever other text interrupts it, must reach ``containment``.  A row
carries each template shingle and each key it holds once, so a text that repeats a notice
a hundred thousand times takes no more than one that has it once.

Everything is DataFrame functions.  The template keys the windows are held
against are literals, bounded by the templates.

Defined cases: null text, or text of fewer than five words, matches nothing;
repeated rows match each; a template of fewer than five words is an error; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farewise.llm.common import pick
from farewise.llm.templates import LICENSES

SHINGLE = 5
BANDS = 8
STRIDE = 4
STEPS = 3  # a window is STEPS strides long
SHORT = 8  # templates of fewer shingles use windows of one
CONTAINMENT = 0.8


def collision_probability(similarity: float, bands: int = BANDS, rows: int = 1) -> float:
    return 1 - (1 - similarity**rows) ** bands


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``hs``, the hashes of the word shingles of column ``text``, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_w") - (SHINGLE - 1)
    shingles = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(SHINGLE)]),
    )
    return hashed.withColumn("hs", F.when(n > 0, shingles).otherwise(F.array().cast("array<bigint>"))).drop("_w")


def _band(hs: Column, j: int) -> Column:
    return F.array_min(F.transform(hs, lambda h: F.xxhash64(h, F.lit(j))))


def template_table(spark: SparkSession, templates=LICENSES) -> DataFrame:
    """license_id, shingles (distinct hashes), n (shingles in order)."""
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in templates])
    table = with_shingles(spark.range(1).select(F.inline(rows)), "text")
    return table.select("license_id", "hs", F.array_distinct("hs").alias("shingles"), F.size("hs").alias("n"))


def template_keys(table: DataFrame) -> DataFrame:
    """license_id, band (-1: a single shingle), key, at (the window's place in the template)."""
    width = STRIDE * STEPS
    single = table.filter(F.col("n") < SHORT).select(
        "license_id", F.lit(-1).alias("band"), F.posexplode("hs").alias("at", "key")
    ).select("license_id", "band", "key", "at")
    places = F.sequence(F.lit(0), F.greatest(F.col("n") - width, F.lit(0)))
    windows = table.filter(F.col("n") >= SHORT).select("license_id", "hs", F.explode(places).alias("at"))
    keys = F.array(*[
        F.struct(F.lit(j).alias("band"), _band(F.slice("hs", F.col("at") + 1, F.lit(width)), j).alias("key")) for j in range(BANDS)
    ])
    wide = windows.select("license_id", "at", F.inline(keys)).select("license_id", "band", "key", "at")
    return single.unionByName(wide)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=LICENSES,
         containment: float = CONTAINMENT) -> DataFrame:
    """One row per document row and license found: doc_id, license_id, containment, shingle
    (the first place in the document of any of the license's shingles)."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    if table.filter("n = 0").count():
        raise ValueError(f"a template needs at least {SHINGLE} words")
    keys = template_keys(table)
    by_band: dict[int, list[int]] = {}
    for band, key in keys.select("band", "key").distinct().collect():  # bounded by the templates
        by_band.setdefault(band, []).append(key)
    theirs = [h for (h,) in table.select(F.explode("shingles")).distinct().collect()]  # bounded by the templates

    rows = pick(docs, id=id_col, text=text_col).select(
        F.col("id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text"
    )
    # No filter stands on the arrays below: Spark would push it down to the scan with the
    # whole chain of expressions inside, and evaluate that once per element.
    base = with_shingles(rows, "text").drop("text")
    steps = F.greatest(F.ceil(F.size("hs") / STRIDE).cast("int"), F.lit(1))

    def minima(j: int) -> Column:
        """The MinHash of every stretch of STRIDE shingles (slice() would copy the whole array for each)."""

        def least(b):
            here = [F.coalesce(F.get("hs", b * STRIDE + k), F.get("hs", b * STRIDE)) for k in range(STRIDE)]
            return F.least(*[F.xxhash64(h, F.lit(j)) for h in here])

        return F.transform(F.sequence(F.lit(0), steps - 1), least)

    least = base.withColumns({f"m{j}": minima(j) for j in range(BANDS) if j in by_band})

    def wide_keys(j: int) -> Column:
        def window(b):
            return F.least(*[F.coalesce(F.get(f"m{j}", b + k), F.get(f"m{j}", b)) for k in range(STEPS)])

        known = F.filter(F.transform(F.sequence(F.lit(0), F.size(f"m{j}") - 1), window), lambda key: key.isin(by_band[j]))
        return F.transform(F.array_distinct(known), lambda key: F.struct(F.lit(j).alias("band"), key.alias("key")))

    found = []
    if -1 in by_band:
        known = F.array_distinct(F.filter("hs", lambda h: h.isin(by_band[-1])))
        found.append(F.transform(known, lambda h: F.struct(F.lit(-1).alias("band"), h.alias("key"))))
    found += [wide_keys(j) for j in range(BANDS) if j in by_band]
    own = F.transform(
        F.array_distinct(F.filter("hs", lambda h: h.isin(theirs))),
        lambda h: F.struct(h.alias("h"), (F.array_position("hs", h) - 1).alias("place")),
    )
    hits = least.withColumns({"hits": F.concat(*found), "own": own})
    hits = hits.select("doc_id", "row", "own", F.explode_outer("hits").alias("x")).filter(F.col("x").isNotNull())
    known = keys.join(table.select("license_id", "shingles"), "license_id").select("license_id", "band", "key", "shingles").distinct()
    met = hits.select("doc_id", "row", "own", "x.*").join(F.broadcast(known), ["band", "key"])
    mine = F.filter("own", lambda o: F.array_contains("shingles", o["h"]))
    match = met.withColumn("mine", mine).select(
        "doc_id", "row", "license_id", (F.size("mine") / F.size("shingles")).alias("containment"),
        F.array_min(F.transform("mine", lambda o: o["place"])).cast("int").alias("shingle"),
    ).filter(F.col("containment") >= containment)
    # the same values from every key of a license
    return match.groupBy("row", "doc_id", "license_id").agg(F.max("containment").alias("containment"), F.min("shingle").alias("shingle")).select(
        "doc_id", "license_id", "containment", "shingle"
    )
