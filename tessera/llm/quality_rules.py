"""Quality rules: text statistics, and lines that many documents of a host share.

DataFrame functions only. Lines are normalised and hashed, the distinct documents of
each (host, line) counted in two combined steps, so that a line of every document
costs one row a task, and lines above the limit are subtracted from their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\f\r"


def repeated_window_words(words: Column, windows: Column) -> Column:
    """Words in windows of three that occur twice or more; `windows` holds the hash of each.

    Equal windows are found by sorting (hash, position), then the positions are put in
    order again and the union of their windows measured: n log n, all within the row.
    """
    tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def in_company(sorted_rows: Column) -> Column:
        twice = lambda e, i: (e["h"] == F.get(sorted_rows, i - 1)["h"]) | (e["h"] == F.get(sorted_rows, i + 1)["h"])
        return F.array_sort(F.transform(F.filter(sorted_rows, lambda e, i: F.coalesce(twice(e, i), F.lit(False))), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        step = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(step, F.lit(3), lambda s, x: s + x))

    bind = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  evaluates value once
    counted = bind(tagged, lambda s: bind(in_company(s), covered))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(counted).cast("long")


def text_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text counts as empty: all are 0.
    """
    rows = docs.select(*keep, text_of(text_col).alias("_t"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda line: F.length(F.translate(line, _WHITE, "")) > 0))
    n = F.size("_words")
    window = F.transform(
        F.slice("_words", 1, F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2)),
    )
    rows = rows.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", _WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.col("_words"),
        window.alias("_windows"),
    )
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated_window_words(F.col("_words"), F.col("_windows")).alias("n_repeat_words"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_docs: int = 10, least_kept: float = 0.3, texts: bool = False,
) -> DataFrame:
    """Statistics and verdict per row: id, the five counts, base_failed, removed_words, kept.

    A line (lower-cased, white space collapsed) that `max_docs` or more distinct
    documents of a host hold is removed from them; a document that keeps less than
    `least_kept` of its words is depleted. kept is false for a document that fails
    the base rules (under 50 words, or over half of them in repeated windows) or is
    depleted. A null host is a host of its own; rows equal in id, host and text are one
    document, each of which gets its result; an empty table gives no rows. With `texts` the
    text without its removed lines follows as kept_text (a null one is empty).
    """
    key = F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("\x1e")), F.coalesce(host_col, F.lit("\x1e")), text_of(text_col)).cast("binary")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), text_of(text_col).alias("_text"), key.alias("_key"))
    line = F.trim(F.regexp_replace("_line", r"[\x20\x09-\x0D]+", " "))
    lines = rows.select("_host", "_key", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    lines = lines.select("_host", "_key", "_pos", F.lower(line).alias("_line")).where("_line <> ''")
    lines = lines.select(
        F.xxhash64("_host", "_line").alias("_hash"), "_key", "_pos", (F.length("_line") - F.length(F.translate("_line", " ", "")) + 1).alias("_n")
    )
    common = lines.groupBy("_hash").agg(F.countDistinct("_key").alias("_docs")).where(F.col("_docs") >= max_docs).select("_hash")
    removed = lines.join(common, "_hash").groupBy("_key").agg(F.collect_set(F.struct("_pos", "_n")).alias("_gone"))
    removed = removed.select("_key", F.aggregate("_gone", F.lit(0).cast("long"), lambda s, x: s + x["_n"]).alias("_removed"), F.col("_gone._pos").alias("_places"))
    stats = text_statistics(rows, ["_id", "_key", *["_text"] * texts], "_text").join(removed, "_key", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("_removed", F.lit(0).cast("long"))
    left = F.array_join(F.filter(F.split("_text", "\n", -1), lambda line, i: ~F.array_contains("_places", i)), "\n")
    return stats.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), gone.alias("removed_words"),
        (~failed & (F.col("n_words") - gone >= F.lit(least_kept) * F.col("n_words"))).alias("kept"),
        *[F.when(F.col("_places").isNull(), F.col("_text")).otherwise(left).alias("kept_text")] * texts,
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls, t FROM d
), tri AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1
), cover AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), ln AS (
  SELECT rid, source, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l
  FROM (SELECT rid, source, unnest(string_split(t, chr(10))) AS l FROM d)
), common AS (
  SELECT source, l FROM ln WHERE l <> '' GROUP BY source, l HAVING count(DISTINCT rid) >= 10
), gone AS (
  SELECT rid, sum(len(ln.l) - len(replace(ln.l, ' ', '')) + 1) AS n
  FROM ln JOIN common ON ln.source IS NOT DISTINCT FROM common.source AND ln.l = common.l GROUP BY rid
), s AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
    len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (SELECT count(*) - count(DISTINCT x) FROM unnest(ls) AS u(x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d JOIN (SELECT rid, ws, ls FROM w) USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN gone USING (rid)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND n_words - removed_words >= 0.3 * n_words AS kept
FROM v
"""
