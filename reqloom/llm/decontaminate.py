"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows are 13 consecutive words (an item of fewer words is one
window). A window's tokens are its word shingles of width 3 (or the window's
length). One pass over the documents keeps the places of shingles that occur in
the benchmark; their frequencies there order the shingles by rarity. A document
can hold a window only if it holds the window's rarest shingle, the necessary
prefix for containment in full, so only that one is joined. The window must then
fit before and behind that place (positional and length bounds), and is verified
shingle by shingle on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.llm.common import ascii_lower, fresh_name, if_few, table, written

WINDOW = 13
SHINGLE = 3
#: Benchmark shingles, at most, that are tested in place; beyond it documents' shingles are joined with them.
IN_PLACE = 50_000
#: Benchmark rows, at most, that are broadcast; beyond it Spark shuffles (or decides by its own threshold).
BROADCAST_ROWS = 200_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased words; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``column`` as a generated row: the optimiser can't copy it into each place that uses it."""
    return df.withColumn(name, F.explode(F.array(column)))


def _places(width: int, listed: list[int] | None = None) -> Column:
    """(pos, shingle) of the shingles in ``w``; with ``listed`` those whose hash is listed."""
    at = lambda i: [F.get(F.col("w"), i + n) for n in range(width)]
    starts = F.when(F.size("w") >= width, F.sequence(F.lit(0), F.size("w") - width)).otherwise(F.array().cast("array<int>"))
    if listed is not None:
        starts = F.filter(starts, lambda i: F.xxhash64(*at(i)).isin(listed))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *at(i)).alias("shingle")))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(window_id, words, length, items): each distinct window with the ids of the items that have it.

    Items without words have none. Null ids keep their windows, but aren't among the items.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.lit(window), F.size("w"))
    cut = items.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda s: F.slice("w", s, length))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("window_id"), "words", F.size("words").alias("length"), "items")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, longest, n_items, items), one row for each row of ``docs``.

    ``longest``: words of the longest window that occurs, else 0. ``items`` are sorted as strings.
    """
    windows = written(item_windows(benchmark, item_col, item_text, window), "windows")
    width = F.least(F.lit(shingle), F.col("length"))
    placed = windows.select("window_id", "length", "words", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("length") - width), lambda i: F.array_join(F.slice("words", i + 1, width), " "))).alias("at", "shingle"))
    placed = written(placed.select("window_id", "length", F.least(F.lit(shingle), F.col("length")).alias("width"), "at", "shingle", "words"), "window-shingles")
    widths = sorted(r[0] for r in placed.select("width").distinct().collect())  # at most ``shingle`` numbers

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("split"))
    rows = _once(rows, "w", F.col("split")).drop("split")
    own = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("shingle"))
    found = [F.array(own)]
    wide_rows = []
    for k in widths:
        mine = placed.where(F.col("width") == k).select("shingle", F.xxhash64(*(F.get(F.split("shingle", " "), F.lit(i)) for i in range(k))).alias("hash")).distinct()
        if (n := mine.count()) > IN_PLACE:
            wide_rows.append((k, mine, n))
            continue
        listed = [r["hash"] for r in mine.select("hash").distinct().collect()]
        found.append(_places(k, listed))
    n_words = F.size("w").alias("n_words")
    kept = rows.select("row", "doc_id", "text_hash", n_words, F.explode(F.concat(*found)).alias("m")).select("row", "doc_id", "text_hash", "n_words", "m.pos", "m.shingle")
    for k, mine, n in wide_rows:
        each = rows.select("row", "doc_id", "text_hash", n_words, F.explode(_places(k)).alias("m"))
        each = each.select("row", "doc_id", "text_hash", "n_words", "m.pos", "m.shingle")
        kept = kept.unionByName(each.join(_few(mine.select("shingle"), n), "shingle", "left_semi"))
    kept = written(kept, "document-shingles")
    texts = kept.where("pos = -1").select("row", "doc_id", "text_hash", "n_words")
    places = kept.where("pos >= 0").select("row", "n_words", "pos", "shingle")

    n_placed = placed.count()
    frequency = places.groupBy("shingle").agg(F.count("*").alias("n"))
    rarity = placed.join(frequency, "shingle", "left").select("window_id", "length", "at", "shingle", F.coalesce("n", F.lit(0)).alias("n"))
    order = Window.partitionBy("window_id").orderBy("n", "shingle", "at")
    prefix = rarity.withColumn("k", F.row_number().over(order)).where("k = 1 and n > 0").select("window_id", "length", "at", "shingle")
    prefix = written(prefix, "prefix-tokens")

    # a broadcast prefix table leaves a hot shingle's places where they are; without it AQE splits the join
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    candidates = places.join(_few(prefix, n_placed), "shingle").where(fits).select("row", "window_id", "length", start.alias("start"))
    covering = placed.where((F.col("at") % F.col("width") == 0) | (F.col("at") == F.col("length") - F.col("width"))).select("window_id", F.col("at").alias("off"), F.col("shingle").alias("needed"), F.count("*").over(Window.partitionBy("window_id")).alias("parts"))
    expected = candidates.join(_few(covering, n_placed), "window_id").select("row", "window_id", "length", "start", "parts", (F.col("start") + F.col("off")).alias("pos"), F.col("needed").alias("shingle"))
    same = places.select("row", "pos", "shingle")
    held = expected.join(same, ["row", "pos", "shingle"]).groupBy("row", "window_id", "length", "start", "parts").agg(F.count("*").alias("n")).where("n = parts")
    held = written(held.select("row", "window_id", "length", "start"), "occurrences")

    end = F.col("start") + F.col("length")
    before = Window.partitionBy("row").orderBy("start", "length", "window_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = held.select("row", "start", end.alias("stop"), F.coalesce(F.max(end).over(before), F.lit(0)).alias("reached"))
    hits = reach.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).cast("long").alias("n_hit"), F.max(F.col("stop") - F.col("start")).alias("longest"))
    named = held.select("row", "window_id").distinct().join(_few(windows.select("window_id", "items"), n_placed), "window_id").select("row", F.explode("items").alias("item"))
    items = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = texts.join(hits, "row", "left").join(items, "row", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "text_hash", F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("longest", F.lit(0)).alias("longest"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of ``docs``.

    ``n_hit`` words of a document lie inside an occurrence of some item's
    window. Null texts have no words; such documents have no hit and such items
    no window. Repeated rows give repeated rows, repeated items count once, items
    with a null id hit but aren't listed. Very long texts are read whole; of
    windows equally rare the shingle's order decides, which bears on the work
    alone. Empty tables on either side give no rows or no hits. Other columns
    aren't read.
    """
    found = overlaps(docs, benchmark, id_col, text_col, item_col, item_text)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; columns stay as they are.

    A text goes if a whole window of ``window`` words occurs in it, whatever its
    share of the text, and if items shorter than a window make up the share of
    words that :func:`decontamination` calls contaminated. Null and empty texts
    stay. Rows repeated whole stay or go together, of an id with several texts
    each text for itself; null ids are judged as any other. Very long texts are
    read whole. Empty tables on either side let all rows stay.
    """
    bad_id, bad_hash = (fresh_name(docs.columns, x) for x in ("bad_id", "bad_hash"))
    found = overlaps(docs, benchmark, id_col, text_col, item_col, item_text, window)
    bad = found.where((F.col("longest") >= window) | F.expr(CONTAMINATED))
    bad = written(bad.select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct(), "contaminated")
    same = docs[id_col].cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs[text_col]) == F.col(bad_hash))
    return docs.join(if_few(bad), same, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table against the whole ``benchmark`` table."""
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
i AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
),
dw AS (
  SELECT r, s, l, array_to_string(w[s : s + l - 1], ' ') AS x
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)
),
o AS (SELECT r, s, dw.l, item_id FROM dw JOIN iw USING (l, x)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT r, s, l FROM o)) GROUP BY r),
n AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
