"""How far the words of sources differ, by an inverted index of corrections.

Per language, each source's counts of the kept terms become shares of a billion,
p = 1 + floor(10^9 (count + 1) / (N + V)).  Sources a and b differ by the sum over
all V kept terms of f(p, q) = floor((p - q)^2 / q).  Hardly any term is in both, so
the sum is not taken term by term: a pair begins at V times f of the two shares of
a count of zero, and terms that occur only correct it,

* a term of a, whatever b has: f(p, q0) - f(p0, q0), and likewise for b.  This
  depends on the count alone, so counts that are equal are taken together;
* a term of both, from its postings: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0);
  counts that are equal are taken together here too.

All of it is whole-number arithmetic in 64 bits; where that does not suffice
(10^15 words of a language and more), Spark raises.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_root, slices, table

#: A term is kept in a language from this many of its documents on.
LEAST_DOCS = 3
#: Ranks of the terms of a source.
TERMS = 200
#: Different terms that a task gathers before it passes their counts on.
GATHER = 300_000
#: Sources that are broadcast at most; more are joined in blocks.
BROADCAST_GROUPS = 20_000

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: ASCII letters in lower case, all other ASCII as blanks; bytes of other characters stay.
_FOLD = bytes(c if c >= 128 else _LOWER[_UPPER.index(c)] if c in _UPPER else c if c in _LOWER else 32 for c in range(256))
_PIECE = 4 << 20


def terms_of(text: str) -> Counter:
    """How often each term is in a text; pieces bound what is split at once."""
    data = text.encode().translate(_FOLD)
    own: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        own.update(data[at:end].split())
        at = end
    return own


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have them, as
    each task has gathered them.

    Nulls in the three columns are ''.  Every language and source that occurs also
    has a row with a null term.  Every row is a document."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    names = ["lang", "source", "term", "n", "docs"]

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (a, b), (n, seen) in held.items():
            terms = list(n)
            cols = [pa.array([a] * (len(terms) + 1), pa.string()), pa.array([b] * (len(terms) + 1), pa.string()), pa.array([None, *(t.decode() for t in terms)], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(seen[t] for t in terms)], pa.int64())], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            for part, texts in slices(batch):
                for a, b, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                    n, seen = held.setdefault((a, b), (Counter(), Counter()))
                    own, size = terms_of(t.as_py()), size - len(n)
                    n.update(own)
                    seen.update(own.keys())
                    size += len(n)
                if size > GATHER:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return d.mapInArrow(read, "lang string, source string, term string, n long, docs long")


def term_index(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, term, docs, n, postings): in how many documents of the language a term
    is, how often, and how often in each source.

    Counts are shuffled once, by language and term: a term has at most one row a
    source and task by then, and at most one posting a source in the end.  The row of
    a language with a null term has all its sources, with counts of zero."""
    d = term_counts(docs, lang, source, text).repartition("lang", "term")
    d = d.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return d.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("postings"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), exactly: three digits at a time."""
    out, left = F.expr("0L"), count + 1
    for place in (10**9, 10**6, 10**3, 1):
        out = out + F.call_function("div", left, total) * place
        left = left % total * 1000
    return out + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _others(rows: DataFrame, groups: DataFrame, many: int) -> DataFrame:
    """Each row beside every other source of its language (other, other_p0).

    So many rows are what is asked for.  A large set of sources is joined in
    blocks, each of a bounded number of sources, so no language is one task."""
    o = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    if many <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(o), "lang").filter("other <> source")
    blocks = -(-many // 1000)
    o = o.withColumn("block", F.pmod(F.xxhash64("other"), F.lit(blocks)))
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).join(o, ["lang", "block"]).filter("other <> source").drop("block")


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank).  Part ``pair``: how far each other
    source of the language is from this one, farthest first.  Part ``term``: the
    terms that this source has more of than its language, up to rank ``terms``.

    Nulls count as ''; an empty text, a repeated row and a text of any length are
    documents as any other (a task holds the different terms of the longest).
    Ties go by the item's bytes.  A language that keeps no term has all its pairs at
    0.  Other columns are not read; an empty table gives no rows.
    """
    shared_root(docs.sparkSession)
    index = term_index(docs, lang, source, text).checkpoint()
    kept = index.filter(F.col("term").isNotNull() & (F.col("docs") >= least_docs))
    each = kept.select("lang", "term", F.col("n").alias("all_n"), F.explode("postings").alias("x")).select("lang", "term", "all_n", "x.*")
    sizes = each.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_size"))
    groups = index.filter("term is null").select("lang", F.explode("postings.source").alias("source")).join(sizes, ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["size", "v", "lang_size"])
    total = F.nullif(F.col("size") + F.col("v"), F.lit(0))  # nothing is counted in a language that keeps no term
    groups = groups.select("lang", "source", total.alias("total"), share(F.lit(0), total).alias("p0"), "v", "lang_size").checkpoint()
    many = groups.count()
    small = (lambda g: F.broadcast(g)) if many <= BROADCAST_GROUPS else (lambda g: g)
    at = lambda name: small(groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"{name}_total"), F.col("p0").alias(f"{name}_p0")))
    flip = lambda a, b, there, back: F.explode(F.array(F.struct(a.alias("source"), b.alias("item"), there.alias("value")), F.struct(b.alias("source"), a.alias("item"), back.alias("value"))))

    base = _others(groups, groups, many).select("lang", "source", F.col("other").alias("item"), F.coalesce(F.col("v") * gap(F.col("p0"), F.col("other_p0")), F.lit(0)).alias("value"))
    alike = each.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).join(small(groups.select("lang", "source", "total", "p0")), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total")))
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("other_p0")
    single = _others(alike, groups, many).select("lang", flip(F.col("source"), F.col("other"), F.col("times") * (gap(p, q0) - gap(p0, q0)), F.col("times") * (gap(q0, p) - gap(q0, p0))).alias("c")).select("lang", "c.*")
    both = kept.select("lang", "postings", F.explode("postings").alias("x")).select("lang", "x", F.explode("postings").alias("y")).filter("x.source < y.source")
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count(F.lit(1)).alias("times"))
    both = both.join(at("a"), ["lang", "a"]).join(at("b"), ["lang", "b"]).withColumns({"p": share(F.col("n"), F.col("a_total")), "q": share(F.col("m"), F.col("b_total"))})
    p, q, p0, q0 = F.col("p"), F.col("q"), F.col("a_p0"), F.col("b_p0")
    corrected = lambda p, q, p0, q0: F.col("times") * (gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0))
    double = both.select("lang", flip(F.col("a"), F.col("b"), corrected(p, q, p0, q0), corrected(q, p, q0, p0)).alias("c")).select("lang", "c.*")
    pairs = reduce(DataFrame.unionByName, (base, single.filter("value <> 0"), double.filter("value <> 0"))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    each = each.join(small(groups.select("lang", "source", "total", "v", "lang_size")), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total")), share(F.col("all_n"), F.col("lang_size") + F.col("v"))
    more = each.withColumns({"p": p, "q": q}).filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    cols = ("lang", "source", "part", "item", "value", "rank")
    ranked = lambda d, part: d.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    return ranked(pairs, "pair").select(*cols).unionByName(ranked(more, "term").filter(F.col("rank") <= terms).select(*cols))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of a language, and the terms that set each source apart."""
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, rid, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS size FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS size FROM k GROUP BY lang),
f AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + v.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (v.size + v.v) AS lang_p
      FROM s JOIN v ON s.lang = v.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM f AS a JOIN f AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
         FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - lang_p) * (p - lang_p) // lang_p)::BIGINT AS value FROM f WHERE n > 0 AND p > lang_p)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM term) WHERE rank <= 200
"""
