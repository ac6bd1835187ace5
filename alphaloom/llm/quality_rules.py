"""Quality rules in DataFrame functions only: repetition inside a text, line frequency across documents.

Base rules look at one text. The cross-document rule normalises lines (lower case,
digit runs as 0, white space runs as one space), hashes them, and counts for each
host (the source column) the distinct documents that hold a line; exact copies of a
text count as one document, so a clean text isn't rejected for being copied. A line in
more than `min_docs` documents and more than `share_percent` of the host's is
boilerplate and is removed; a document left with under `min_words` words or under
`left_percent` of its words is depleted and rejected.

Scale: counts are combined before each shuffle, only hashes and small arrays move, and a
host's boilerplate lines are at most 100 / share_percent times its mean number of
lines, so they fit one array. Documents meet that array in an equi-join on the host,
which Spark broadcasts if it is small and splits where a host is hot.

Defined results: null or empty text has no words (base_failed, not kept); a null host is
the host ''; repeated rows count as one document and give repeated results; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.shared import table

MIN_DOCS, SHARE_PERCENT, MIN_WORDS, LEFT_PERCENT = 20, 2, 10, 30
WORD = r"[^\x20\x09-\x0D]+"


def _normal_lines(text: Column) -> Column:
    """Normalised lines, as many as the text has; blank lines become empty."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def _hashes(lines: Column) -> Column:
    """A hash for each line, null for blank ones."""
    return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x)))


def _counted(x: Column) -> Column:
    return F.when(x == "", 0).otherwise(F.length(x) - F.length(F.translate(x, " ", "")) + 1)


def boilerplate_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """(host, common): for each host that has any, the hashes of its lines above the limits."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    docs = df.select(host, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = docs.select("host", F.xxhash64("t").alias("doc"), F.explode(F.array_distinct(F.array_compact(_hashes(_normal_lines(F.col("t")))))).alias("line"))
    per_line = lines.groupBy("host", "line", "doc").agg(F.lit(1).alias("_")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = per_line.where(F.col("n") > min_docs)
    sizes = docs.select("host", F.xxhash64("t").alias("doc")).groupBy("host", "doc").agg(F.lit(1).alias("_")).groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    above = often.join(sizes, "host").where(100 * F.col("n") > share_percent * F.col("docs"))
    return above.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("common"))


def base_features(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines): lines holds (hash, words) of each line with words. Carried columns follow as c0, c1, ..."""
    own = [f"c{k}" for k in range(len(carry))]
    d = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
        *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, own)])
    d = d.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), 0)).withColumn("normal", _normal_lines(F.col("t")))
    d = d.withColumn("raw", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("words")
    d = d.select(
        "id", "host", n.cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.filter(F.transform("normal", lambda x: F.struct(F.when(x != "", F.xxhash64(x)).alias("h"), _counted(x).alias("w"))), lambda x: x["w"] > 0).alias("lines"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(5)]))).otherwise(F.array().cast("array<long>")).alias("grams"), *own)
    # Only texts that repeat a window need the positions: sort (hash, position), keep those with an equal neighbour, add up what they newly cover.
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    placed = F.when(repeats, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("placed", placed).drop("grams")
    twice = F.filter(F.transform("placed", lambda x, j: F.when(
        (x["h"] == F.get("placed", j - 1)["h"]) | (x["h"] == F.get("placed", j + 1)["h"]), x["i"])), lambda x: x.isNotNull())
    d = d.withColumn("at", F.when(F.col("placed").isNotNull(), F.sort_array(twice))).drop("placed")
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate("at", start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(5), p - a["last"])).alias("sum")), lambda a: a["sum"])
    # The partition number makes this column one that no filter is pushed through: a filter on the verdict would else be rewritten in terms of the text, each array once per mention.
    return d.withColumn("n_repeat_words", F.when(F.spark_partition_id() >= 0, F.coalesce(covered, F.lit(0).cast("long")))).drop("at")


def _judged(df: DataFrame, id_col: str, host_col: str, text_col: str, min_words: int, left_percent: int, common: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """base_features() of df beside its host's boilerplate lines (common), with words_left, removed, base_failed and kept."""
    d = base_features(df, id_col, host_col, text_col, carry).join(common, "host", "left")
    stays = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("common"), x["h"])))
    total = F.aggregate("lines", F.lit(0), lambda a, x: a + x["w"])
    d = d.withColumn("stays", stays).withColumn("words_left", F.aggregate("stays", F.lit(0), lambda a, x: a + x["w"])).withColumn("total", total)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    enough = (F.col("words_left") >= min_words) & (100 * F.col("words_left") >= left_percent * F.col("total"))
    return d.withColumn("removed", (F.size("lines") - F.size("stays")).cast("long")).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough)


def quality_rules(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS,
                  share_percent: int = SHARE_PERCENT, min_words: int = MIN_WORDS, left_percent: int = LEFT_PERCENT, common: DataFrame | None = None) -> DataFrame:
    """(id, counts, base_failed, n_lines_removed, words_left, kept) for every row of df; common: a table of boilerplate_lines(), by default df's own."""
    common = boilerplate_lines(df, host_col, text_col, min_docs, share_percent) if common is None else common
    d = _judged(df, id_col, host_col, text_col, min_words, left_percent, common)
    return d.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("removed").alias("n_lines_removed"), F.col("words_left").cast("long").alias("words_left"), "kept")


def _without_lines(text: Column, common: Column) -> Column:
    """text without the lines whose hashes are in common."""
    pairs = F.arrays_zip(F.split(text, "\n", -1).alias("raw"), _hashes(_normal_lines(text)).alias("h"))
    left = F.filter(pairs, lambda x: ~F.coalesce(F.array_contains(common, x["h"]), F.lit(False)))
    return F.array_join(F.transform(left, lambda x: x["raw"]), "\n")


def passed(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS,
           share_percent: int = SHARE_PERCENT, min_words: int = MIN_WORDS, left_percent: int = LEFT_PERCENT, common: DataFrame | None = None) -> DataFrame:
    """The rows of df that the rules keep, all columns, boilerplate lines taken out of their texts. Verdict and removal go by one set of lines, in one pass that needs no row's id."""
    common = boilerplate_lines(df, host_col, text_col, min_docs, share_percent) if common is None else common
    d = _judged(df, id_col, host_col, text_col, min_words, left_percent, common, tuple(df.columns)).where("kept")
    cut = lambda c: F.when(F.col("removed") > 0, _without_lines(F.col(c), F.col("common"))).otherwise(F.col(c))
    return d.select(*[(cut(f"c{k}") if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(df.columns)])


def without_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, share_percent: int = SHARE_PERCENT, common: DataFrame | None = None) -> DataFrame:
    """df with the lines above the limits taken out of its texts (null texts stay null), all columns kept, whatever their names; common as in quality_rules()."""
    common = boilerplate_lines(df, host_col, text_col, min_docs, share_percent) if common is None else common
    own = [f"c{k}" for k in range(len(df.columns))]
    d = df.toDF(*own).withColumn("key", F.coalesce(F.col(own[df.columns.index(host_col)]).cast("string"), F.lit(""))).join(common, F.col("key") == F.col("host"), "left")
    cut = lambda t: F.when(F.col("common").isNull() | t.isNull(), t).otherwise(_without_lines(t, F.col("common")))
    return d.select(*[(cut(F.col(k)) if c == text_col else F.col(k)).alias(c) for c, k in zip(df.columns, own)])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT rid, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS raw,
         list_transform(string_split(regexp_replace(regexp_replace(lower(t), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')) AS normal
  FROM docs
), lines AS (
  SELECT rid, host, t, unnest(list_filter(normal, lambda x: x <> '')) AS line FROM words
), per_line AS (
  SELECT host, line, count(DISTINCT t) AS n FROM lines GROUP BY ALL
), sizes AS (
  SELECT host, count(DISTINCT t) AS docs FROM docs GROUP BY ALL
), common AS (
  SELECT host, line FROM per_line JOIN sizes USING (host) WHERE n > 20 AND 100 * n > 2 * docs
), left_over AS (
  SELECT rid, sum(len(string_split(line, ' '))) AS total, count(c.line2) AS n_lines_removed,
         coalesce(sum(len(string_split(line, ' '))) FILTER (WHERE c.line2 IS NULL), 0) AS words_left
  FROM lines LEFT JOIN (SELECT host AS host2, line AS line2 FROM common) c ON lines.host = c.host2 AND lines.line = c.line2 GROUP BY ALL
), grams AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS g FROM words, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) >= 5
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM grams) WHERE k > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY ALL
), counts AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(list_filter(raw, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(raw, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(words_left, 0)::BIGINT AS words_left,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(words_left >= 10 AND 100 * words_left >= 30 * total, false) AS kept
FROM counts LEFT JOIN left_over USING (rid)
"""
