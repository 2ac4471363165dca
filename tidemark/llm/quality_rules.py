"""Quality rules with cross-document line frequency, in SQL functions only.

Lines are normalised (white space collapsed, lower case) and hashed; for each
host the number of different documents that hold a line is counted, a document
and its exact copies counting once.  Lines in more than
``max(min_docs, max_share * documents of the host)`` documents are removed;
documents that keep less than half of their words are rejected.

The lines above the limit are at most ``1 / max_share`` times a host's mean
number of lines per document, so one short list per host is joined back to the
texts: while the lists are small (``BROADCAST_BYTES``) no document is shuffled, and
where they are not, documents are joined by host.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, hold, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Repeated windows of a text that are looked for in place.
FEW = 32
#: Lists of frequent lines up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def _norm(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _solid(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _repeat_words(gram: str) -> Column:
    """Words that lie in windows found twice or more, from the array of the
    hashes of all windows.

    Sorted hashes show which repeat.  Up to ``FEW`` of them are looked for in
    place, in a few bytes a word; where more repeat, windows are sorted with
    their positions.  Both ways give the same number."""
    g = F.col(gram)
    none = F.lit(False)

    def count(at: Column) -> Column:  # ascending positions
        step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(5), p - acc["last"])).alias("total"))
        return F.aggregate(at, F.struct(F.lit(-9).alias("last"), F.lit(0).alias("total")), step, lambda acc: acc["total"])

    def twins(rows: Column) -> Column:  # of windows sorted with their positions
        def twin(v: Column, k: Column) -> Column:
            same = lambda j: F.coalesce(F.get(rows, j)["h"] == v["h"], none)
            return F.when(same(k - 1) | same(k + 1), v["i"])

        return F.sort_array(F.filter(F.transform(rows, twin), lambda x: x.isNotNull()))

    def covered(again: Column) -> Column:
        few = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(again, F.get(g, i)))
        many = F.get(F.transform(F.array(F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), twins), 0)
        return count(F.when(F.size(again) <= FEW, few).otherwise(many))

    def repeated(hashes: Column) -> Column:
        return F.array_distinct(F.filter(hashes, lambda h, i: F.coalesce(F.get(hashes, i - 1) == h, none)))

    again = F.get(F.transform(F.array(F.sort_array(g)), repeated), 0)
    found = F.get(F.transform(F.array(again), covered), 0)
    return F.when(F.size(F.array_distinct(g)) < F.size(g), found).otherwise(F.lit(0))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed.  Null texts count as empty.

    Words and windows are held as 64-bit hashes, so a text of any length costs
    a few numbers a word beside itself.
    """
    cols = [c for c in docs.columns if not c.startswith("qr_")]
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    lines = F.transform(F.filter(_lines(t), _solid), lambda x: F.xxhash64(x))
    d = docs.select(*cols, words.alias("qr_words"), lines.alias("qr_lines"))
    d = d.withColumn("qr_n", F.size("qr_words"))
    window = lambda i: F.xxhash64(*[F.get("qr_words", i + j) for j in range(5)])
    gram = F.when(F.col("qr_n") >= 6, F.transform(F.sequence(F.lit(0), F.greatest(F.col("qr_n") - 5, F.lit(0))), window))
    d = d.withColumn("qr_grams", F.coalesce(gram, F.array().cast("array<bigint>")))
    d = d.select(
        *[F.col(c) for c in cols],
        F.col("qr_n").cast("long").alias("qr_n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("qr_word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("qr_n_symbols"),
        (F.size("qr_lines") - F.size(F.array_distinct("qr_lines"))).cast("long").alias("qr_n_dup_lines"),
        _repeat_words("qr_grams").cast("long").alias("qr_n_repeat_words"),
    )
    return d.withColumn("qr_base_failed", (F.col("qr_n_words") < 10) | (100 * F.col("qr_n_repeat_words") > 20 * F.col("qr_n_words")))


def frequent_lines(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = 10, max_share: float = 0.05) -> DataFrame:
    """Per host the hashes of the lines above the limit: (qr_host, qr_hot).

    Null hosts are a host of their own."""
    t = F.coalesce(F.col(text), F.lit(""))
    each = docs.select(F.to_json(F.array(host)).alias("qr_host"), F.xxhash64(t, F.length(t)).alias("qr_text"), F.filter(_lines(t), _solid).alias("l"))
    known = each.select("qr_host", "qr_text").distinct().groupBy("qr_host").agg(F.count(F.lit(1)).alias("n"))
    hashed = each.select("qr_host", "qr_text", F.explode(F.array_distinct(F.transform("l", lambda x: F.xxhash64(_norm(x))))).alias("h"))
    counts = hashed.groupBy("qr_host", "h", "qr_text").agg(F.lit(1).alias("one")).groupBy("qr_host", "h").agg(F.count(F.lit(1)).alias("docs"))
    hot = counts.filter(F.col("docs") > min_docs).join(known, "qr_host").filter(F.col("docs") > F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.col("n")))
    return hot.groupBy("qr_host").agg(F.collect_set("h").alias("qr_hot"))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", min_docs: int = 10, max_share: float = 0.05, min_left: float = 0.5) -> DataFrame:
    """All rules: adds the base columns, qr_text (the text without its frequent
    lines), qr_left (its words) and qr_kept.

    Null and empty texts have no words and are rejected by the base rules; a text
    of any length is judged whole.  A line at the limit stays.
    Repeated rows and ids are judged row by row.  Columns that begin with
    ``qr_`` are replaced, all others kept.  An empty table gives no rows.
    """
    hot = hold(frequent_lines(docs, host, text, min_docs, max_share), StorageLevel.MEMORY_AND_DISK)
    n, m = hot.agg(F.coalesce(F.sum(F.size("qr_hot")), F.lit(0)), F.count(F.lit(1))).first()
    small = 8 * n + 64 * m <= BROADCAST_BYTES
    d = base_rules(docs, text).withColumn("qr_host", F.to_json(F.array(host)))
    d = d.join(F.broadcast(hot) if small else hot, "qr_host", "left")
    t = F.coalesce(F.col(text), F.lit(""))
    left = F.array_join(F.filter(_lines(t), lambda x: ~_solid(x) | ~F.array_contains("qr_hot", F.xxhash64(_norm(x)))), "\n")
    # A filter on qr_kept that moved below this projection would compute the arrays
    # above again for each of their elements; the row mark holds it here.
    d = d.withColumns({"qr_text": F.when(F.col("qr_hot").isNull(), t).otherwise(left), "qr_mark": F.monotonically_increasing_id()})
    same = F.length("qr_text") == F.length(t)
    d = d.withColumn("qr_left", F.when(same, F.col("qr_n_words")).otherwise(F.regexp_count("qr_text", F.lit(WORD)).cast("long")))
    kept = ~F.col("qr_base_failed") & (F.col("qr_left") >= min_left * F.col("qr_n_words")) & (F.col("qr_mark") >= 0)
    return d.withColumn("qr_kept", kept).drop("qr_host", "qr_hot", "qr_mark")


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that pass, without their frequent lines; columns of documents.
    Null and empty texts go; repeated rows, ties, long texts and empty tables are
    treated as in quality_rules."""
    d = quality_rules(docs).filter("qr_kept")
    new = {"text": F.col("qr_text"), "n_chars": F.length("qr_text").cast("long")}
    return d.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict for every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    d = quality_rules(docs)
    return d.select("doc_id", *[F.col(f"qr_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")], F.col("qr_left").alias("n_left"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, list_slice(ws, i, i + 4) AS gram
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 6)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM r) GROUP BY rid),
b AS (SELECT w.rid, doc_id, source, t, ls, len(ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.rid = rep.rid),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b),
l AS (SELECT rid, source, t, l, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS nl
      FROM (SELECT rid, source, t, unnest(ls) AS l FROM f)),
nd AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
hot AS (SELECT l.source, nl FROM l JOIN nd ON l.source IS NOT DISTINCT FROM nd.source GROUP BY l.source, nl, nd.n
        HAVING count(DISTINCT t) > greatest(10.0, 0.05 * nd.n)),
gone AS (SELECT rid, sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS n
         FROM l JOIN hot ON l.source IS NOT DISTINCT FROM hot.source AND l.nl = hot.nl GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND (n_words - coalesce(gone.n, 0)) >= 0.5 * n_words) AS kept,
  (n_words - coalesce(gone.n, 0))::BIGINT AS n_left
FROM f LEFT JOIN gone ON f.rid = gone.rid
"""
