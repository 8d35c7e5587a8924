"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised (A-Z lower-cased, runs of white space as one space, trimmed) and hashed; for each host (here the
``source``) the distinct documents that hold a line are counted.  A line of at least ``min_docs`` documents is above the
limit and is removed where it stands in ``min_share`` of its host's documents or, if ``many_docs`` is given, in that many
of them, however many there are; a document that loses more than ``max_loss`` of its word characters is depleted and is
rejected.  Documents of one host with the same text count as one document, so a whole-document copy does not turn its own
lines into boilerplate (near-duplicate removal is another operator).

Scale: line counts are combined map-side before the shuffle, and the distinct count is two-staged, so that a line
held by a third of all rows costs one row a task.  Lines above the limits are broadcast only when their counted number is
under ``broadcast_rows``, else joined by a shuffle that AQE may split.

Defined results: null text: no words, base_failed, not kept; null source: a host of its own; repeated rows: a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize

SEP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEP))


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Repeated 3-word windows: window hashes carry their position in the low bits, so one primitive sort brings equal
    windows together; each start of a repeated window then covers up to three words.  Rows without a repeated window
    (one hash-set pass tells) skip the sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_text", text).withColumn("_words", _words(F.col("_text")))
    d = d.withColumn("n_words", F.size("_words").cast("long")).withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    h, n = F.col("_h"), F.size("_h")
    d = d.withColumn(
        "_win",
        F.when(n >= 4, F.transform(F.slice(h, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))),
    )
    d = d.withColumn("_dups", F.size(F.array_distinct("_win")) < F.size("_win"))
    bits = F.ceil(F.log2(n + 2)).cast("int")
    d = d.withColumn("_b", bits)
    packed = F.sort_array(F.transform("_win", lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, F.col("_b")), F.col("_b")).bitwiseOR(i.cast("long"))))
    d = d.withColumn("_sorted", F.when(F.col("_dups"), packed))
    s = F.col("_sorted")
    key = lambda x: F.call_function("shiftright", x, F.col("_b"))
    starts = F.transform(
        F.filter(s, lambda x, i: F.coalesce(key(x) == key(F.get(s, i + 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(s, i - 1)), F.lit(False))),
        lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b")) - 1),
    )
    d = d.withColumn("_starts", F.when(F.col("_dups"), F.sort_array(starts)))
    st = F.col("_starts")
    gaps = F.transform(st, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(st, i + 1) - x, F.lit(3).cast("long"))))
    d = d.withColumn("n_repeat_words", F.when(F.col("_dups"), F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long")))
    d = d.withColumn("word_chars", F.length(F.translate("_text", SPACES, "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"))
    d = d.withColumn("_lines", _lines(F.col("_text")))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.drop("_text", "_lines", "_words", "_h", "_win", "_dups", "_b", "_sorted", "_starts")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), SEP, " ")))


def lines_above_limits(rows: DataFrame, text: Column, host: Column, min_docs: int, min_share: float, many_docs: int | None) -> DataFrame:
    """(_host, _line) of the lines above the limits; each row sends each of its distinct lines once."""
    doc = F.xxhash64(text).alias("_doc")
    lines = rows.select(host.alias("_host"), doc, F.explode(F.array_distinct(F.transform(_lines(text), _line_key))).alias("_line"))
    counts = lines.groupBy("_host", "_line").agg(F.countDistinct("_doc").alias("_df")).where(F.col("_df") >= min_docs)
    hosts = rows.select(host.alias("_host"), doc).groupBy("_host").agg(F.countDistinct("_doc").alias("_n"))
    limit = min_share * F.col("_n") if many_docs is None else F.least(min_share * F.col("_n"), F.lit(many_docs))
    return counts.join(hosts, "_host").where(F.col("_df") >= limit).select("_host", "_line")


def line_frequency(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_docs: int = 5, min_share: float = 0.01, many_docs: int | None = None,
                   max_loss: float = 0.5, broadcast_rows: int = 200_000) -> DataFrame:
    """All rows and columns of ``docs`` with the base columns, lost_chars (word characters in lines above the limits),
    clean_text (the text without those lines) and kept.

    Input columns of these names are replaced; those that start with an underscore are left out.
    """
    rows = docs.drop(*[c for c in docs.columns if c.startswith("_") or c in ("lost_chars", "clean_text")])
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\u0000null"))
    above = materialize(lines_above_limits(rows, text, host, min_docs, min_share, many_docs))
    small = above.count() <= broadcast_rows
    # what a text loses depends on its host and itself only, so its copies share one row here
    held = rows.select(host.alias("_host"), F.xxhash64(text).alias("_doc"), F.posexplode(_lines(text)).alias("_pos", "_raw"))
    held = held.select("_host", "_doc", "_pos", _line_key(F.col("_raw")).alias("_line"), F.length(F.translate("_raw", SPACES, "")).alias("_chars"))
    cut = held.join(F.broadcast(above) if small else above, ["_host", "_line"]).dropDuplicates(["_host", "_doc", "_pos"])
    lost = cut.groupBy("_host", "_doc").agg(F.sum("_chars").alias("lost_chars"), F.collect_set("_line").alias("_cut"))
    keyed = rows.withColumns({"_host": host, "_doc": F.xxhash64(text)})
    judged = base_columns(keyed, text_col).join(lost, ["_host", "_doc"], "left")
    judged = judged.withColumn("lost_chars", F.coalesce("lost_chars", F.lit(0)).cast("long"))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~F.array_contains("_cut", _line_key(x))), "\n")
    judged = judged.withColumn("clean_text", F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(left))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= max_loss * F.col("word_chars"))).drop("_host", "_doc", "_cut")
