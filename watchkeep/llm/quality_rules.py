"""Quality rules: repetition inside a text, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.llm.common import store

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
# A line is above its limit in more distinct documents of a host than both.
LINE_DOCS = 5
LINE_SHARE = 0.01
# What must be left of a document: words, and percent of its words.
LEFT_PERCENT = 30


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_hash(line: Column) -> Column:
    """Lines are equal in any case and with any spaces."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more.

    Windows are 64-bit hashes.  Only texts with a repeated hash are sorted; the
    windows then cover the union of the ranges that begin at their places.
    """
    def marked(hashes):
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(s, e, j):
            return F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))

        places = bound(pairs, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda e, i: same(s, e, i - 1) | same(s, e, i + 1)), lambda e: e["i"])))
        steps = bound(places, lambda p: F.transform(
            p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW)))))
        total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0).cast("long"))

    windows = bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))
    return F.when(F.size(words) > WINDOW, bound(windows, marked)).otherwise(F.lit(0).cast("long"))


def _host() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id", _host().alias("host"), F.xxhash64(text).alias("content"),
        F.monotonically_increasing_id().alias("row"), text.alias("text"),
        words_of(text).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHARACTER)).alias("lines"),
    )
    line = lambda x: F.struct(
        line_hash(x).alias("line"),
        F.size(words_of(x)).cast("long").alias("words"))
    return split.select(
        "doc_id", "host", "content", "row", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", line).alias("lines"),
    )


def _frequent(measured: DataFrame) -> DataFrame:
    """(host, line) of the normalised lines above their host's limit.

    Documents are counted by content, so exact copies of one document are one.
    """
    # Distinct (host, line, content) rows first: no key gathers its documents.
    seen = measured.select("host", "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    per_line = seen.distinct().groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > LINE_DOCS)
    per_host = measured.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return per_line.join(per_host, "host").where(F.col("docs") > F.col("host_docs") * LINE_SHARE).select("host", "line")


def _judged(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every row, and the hashes of the lines to remove."""
    measured = store(_measured(docs), "quality")
    frequent = store(_frequent(measured), "frequent-lines")
    lines = measured.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    removed = lines.join(frequent, ["host", "line"]).groupBy("row").agg(
        F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))  # lines of one row
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    left = F.col("n_words") - gone
    depleted = (left < LEAST_WORDS) | (100 * left < LEFT_PERCENT * F.col("n_words"))
    return measured.drop("lines").join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("removed_words"), "host", "content", "removed_lines",
    )


def line_rules(docs: DataFrame) -> DataFrame:
    """The measures of every row of ``docs`` (doc_id, text, source), and whether it is kept.

    ``base_failed``: fewer than 20 words, or over 30 percent of them in 8-word
    windows that occur twice.  Lines are lower-cased with single spaces; a line
    in more than five distinct documents of its host and more than one percent
    of them is removed.  A document is depleted with fewer than 20 words or
    less than 30 percent of its words left.

    Null texts are empty and fail; null hosts are one host; repeated rows give
    repeated results; a very long text is one row, its lines are counted apart;
    an empty table gives no rows; other columns are not read.
    """
    return _judged(docs).drop("removed_lines")


def _with_verdicts(docs: DataFrame) -> DataFrame:
    """``docs`` with columns _watchkeep_kept and _watchkeep_lines.

    A verdict depends on a row's text and host only, so one row per such pair
    that is rejected or loses lines is joined back.  That table is stored, so
    that adaptive execution can split a large group of copies.
    """
    told = _judged(docs).where("not kept or removed_words > 0").select(
        F.col("host").alias("_watchkeep_host"), F.col("content").alias("_watchkeep_content"),
        F.col("kept").alias("_watchkeep_kept"), F.col("removed_lines").alias("_watchkeep_lines"))
    told = store(told.dropDuplicates(["_watchkeep_host", "_watchkeep_content"]), "verdicts")
    host, content = _host(), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(told, (host == told["_watchkeep_host"]) & (content == told["_watchkeep_content"]), "left")


def _kept() -> Column:
    return F.coalesce(F.col("_watchkeep_kept"), F.lit(True))


def _left_text() -> Column:
    stays = lambda x: ~F.array_contains("_watchkeep_lines", line_hash(x)) | ~x.rlike(WORD_CHARACTER)
    text = F.array_join(F.filter(F.split("text", "\n"), stays), "\n")
    return F.when(F.col("_watchkeep_lines").isNotNull(), text).otherwise(F.col("text")).alias("text")


def _columns(docs: DataFrame, text: Column) -> list[Column]:
    return [text if c == "text" else F.col(c) for c in docs.columns]


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``line_rules`` keeps, all columns as they are."""
    return _with_verdicts(docs).where(_kept()).select(*docs.columns)


def without_frequent_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines above their host's limit taken out of the text.

    Lines without a word, null texts and other columns stay; a text may become empty.
    """
    return _with_verdicts(docs).select(*_columns(docs, _left_text()))


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``line_rules`` keeps, without frequent lines: both at once."""
    return _with_verdicts(docs).where(_kept()).select(*_columns(docs, _left_text()))
