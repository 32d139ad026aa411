"""Quality rules by cross-document line frequency, in DataFrame operations only.

Lines are normalised (lower case, digits alike, no white space) and hashed.  Per host, and over all hosts, the distinct
documents that hold a line are counted.  Near copies vote once: a document's voter is the smallest hash of its three-word windows, which
copies share unless an edit touches or undercuts just that window, so that a document with many copies does not make its own lines
frequent.  A line is frequent from a fixed number of voters on, in its host or in the corpus, so that a passage is judged alike in
hosts of any size; fewer are enough for a long line than for a short one.  A line that more than ``share`` of a host's
documents hold, and ``least`` of them, is frequent there as well.  Frequent lines are removed, and a document
that keeps less than ``keep_share`` of its words, or fewer than ``keep_words``, is depleted.

The text is read once; what is shuffled are 64-bit hashes.  Counting combines on the map side and is dealt by
(host, line, text), so a host or line that holds a third of all rows is spread; the join back is salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

SPACE = r"[ \\t\\n\\x0B\\f\\r]"
SALTS = 32
#: Words from which a line is long, and the voters that make a long and a short line frequent in a host and in the corpus.
LONG_WORDS = 8
HOST_LIMITS, CORPUS_LIMITS = (50, 500), (60, 1000)


def text_measures(docs: DataFrame) -> DataFrame:
    """Add word and line measures to rows (row, host, id, text); drops nothing."""
    out = docs.selectExpr(
        "row", "host", "id", "text",
        f"filter(split(coalesce(text, ''), '{SPACE}+'), w -> w <> '') AS words",
        f"filter(split(coalesce(text, ''), '\\n'), l -> l rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]') AS lines")
    out = out.selectExpr(
        "row", "host", "id", "text", "lines", "cast(size(words) AS long) AS n_words",
        f"cast(length(regexp_replace(coalesce(text, ''), '{SPACE}+', '')) AS long) AS word_chars",
        "cast(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS long) AS n_symbols",
        "cast(size(lines) - size(array_distinct(lines)) AS long) AS n_dup_lines",
        "transform(words, w -> xxhash64(w)) AS h")
    out = out.withColumn("win", F.expr(
        "CASE WHEN size(h) < 3 THEN array() ELSE transform(sequence(0, size(h) - 3), "
        "i -> xxhash64(h[i], h[i + 1], h[i + 2])) END").cast("array<bigint>"))
    out = out.withColumn("voter", F.coalesce(F.array_min("win"), F.xxhash64(F.col("text"), F.lit(1))))
    # only texts that repeat a window sort their windows
    out = out.withColumn("s", F.expr("CASE WHEN size(array_distinct(win)) < size(win) "
                                     "THEN sort_array(transform(win, (x, i) -> struct(x AS v, i AS i))) END")) \
        .drop("win", "h")
    out = out.withColumn("p", F.expr(
        "CASE WHEN s IS NOT NULL THEN sort_array(transform(filter(s, (e, k) -> "
        "coalesce(e.v = get(s, k - 1).v, false) OR coalesce(e.v = get(s, k + 1).v, false)), e -> e.i)) END")).drop("s")
    out = out.withColumn("n_repeat_words", F.expr(
        "coalesce(aggregate(transform(p, (x, k) -> least(3, coalesce(get(p, k + 1) - x, 3))), 0L, (a, x) -> a + x), 0L)"))
    return out.drop("p").withColumn("line", F.expr(
        "transform(lines, l -> struct(xxhash64(translate(lower(l), '0123456789 \\t\\x0B\\f\\r', '0000000000')) AS hash, "
        f"size(filter(split(l, '{SPACE}+'), w -> w <> '')) AS words))".replace("\\x0B", "\\u000B"))).drop("lines")


def frequent_lines(measured: DataFrame, share: float, least: int, host_limits: tuple[int, int] = HOST_LIMITS,
                   corpus_limits: tuple[int, int] = CORPUS_LIMITS) -> DataFrame:
    """(host, hash) of the lines above a limit; ``measured`` has host, voter and line (hash, words)."""
    limit = lambda pair: F.when(F.col("words") >= LONG_WORDS, pair[0]).otherwise(pair[1])
    hosts = measured.groupBy("host").agg(F.countDistinct("voter").alias("docs"))
    cells = (measured.select("host", "voter", F.explode(F.array_distinct("line")).alias("l"))
             .select("host", "voter", "l.hash", "l.words").groupBy("hash", "host", "voter").agg(F.max("words").alias("words")))
    votes = cells.groupBy("hash", "host").agg(F.count("*").alias("votes"), F.max("words").alias("words"))
    corpus = (cells.groupBy("hash", "voter").agg(F.max("words").alias("words"))
              .groupBy("hash").agg(F.count("*").alias("everywhere"), F.max("words").alias("words"))
              .filter(F.col("everywhere") >= limit(corpus_limits)).select("hash", "everywhere"))
    judged = votes.join(hosts, "host").join(corpus, "hash", "left")
    return judged.filter(F.col("everywhere").isNotNull() | (F.col("votes") >= limit(host_limits))
                         | ((F.col("votes") >= least) & (F.col("votes") > share * F.col("docs")))).select("host", "hash")


def line_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   share: float = 0.01, least: int = 10, keep_share: float = 0.3, keep_words: int = 20,
                   host_limits: tuple[int, int] = HOST_LIMITS, corpus_limits: tuple[int, int] = CORPUS_LIMITS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_frequent_lines, n_words_left, kept, and ``frequent``, the distinct hashes of its
    frequent lines (for ``remove_lines``).

    Words are runs of characters other than blank and tab to CR; a null or empty text has none and fails
    the base rules.  Windows of three words count as equal by a 64-bit hash.  A null host is a host of its own.
    Ids may repeat or be null: every row is judged for itself.  Other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.xxhash64(F.col(host_col)), F.lit(0)).alias("host"),
                       F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = stored(text_measures(rows).drop("text"))
    frequent = frequent_lines(measured, share, least, host_limits, corpus_limits).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = measured.select("row", "host", F.explode("line").alias("l"),
                            F.expr(f"int(pmod(xxhash64(row), {SALTS}))").alias("salt")) \
        .select("row", "host", "salt", "l.hash", "l.words")
    removed = (lines.join(frequent, ["host", "hash", "salt"])
               .groupBy("row").agg(F.count("*").alias("n_frequent_lines"), F.sum("words").alias("gone"),
                                   F.collect_set("hash").alias("frequent")))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    depleted = (left < keep_share * F.col("n_words")) | (left < keep_words)
    return measured.drop("line", "voter").join(removed, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), F.coalesce("n_frequent_lines", F.lit(0)).alias("n_frequent_lines"),
        left.alias("n_words_left"), (~base_failed & ~depleted).alias("kept"),
        F.coalesce("frequent", F.array().cast("array<bigint>")).alias("frequent"))


def remove_lines(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` that are kept, without their frequent lines.  Ids must be unique here."""
    verdict = judged.filter("kept").select(F.col(id_col).alias("_id"), F.col("frequent").alias("_frequent"))
    line_hash = "xxhash64(translate(lower(l), '0123456789 \\t\\u000B\\f\\r', '0000000000'))"
    text = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), l -> NOT array_contains(_frequent, {line_hash})), '\\n')")
    return docs.join(verdict, F.col(id_col) == F.col("_id")).withColumn(text_col, text).drop("_id", "_frequent")
