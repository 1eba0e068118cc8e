"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Native DataFrame expressions only. Each text gets its counts inside its own row (no shuffle): words, code points in
words, symbols, repeated lines, and words in three-word windows that occur again. Four rates (per
thousand) follow from them. For each language and source, a quantile sketch of each rate over the rows that
pass the base rules is a histogram with 8 significant bits: bucket counts that add up, so sketches merge by summing, map-side first, with
a relative error of 1/128 and some thousand buckets at most. A group with fewer than ``MIN_ROWS`` rows
takes the merged sketch of its language, or of all rows.

A rate is refused above ``q50 + SPREAD * (q50 - q25) + slack``; characters per word also below the mirrored
bound. The median holds while less than half of a group is junk.

Null text: no words, base failed. Null language or source: a group of its own. Repeated rows count each.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.tables import Scratch, pick, table

MIN_ROWS = 200
SPREAD = 8
#: rate -> (numerator, denominator, slack per thousand, two-sided)
RATES = {
    "symbols": ("n_symbols", "n_words", 100, False),
    "word_length": ("word_chars", "n_words", 1000, True),
    "dup_lines": ("n_dup_lines", "n_lines", 400, False),
    "repeats": ("n_repeat_words", "n_words", 350, False),
}
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def text_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row."""
    src = pick(docs, id=id_col, text=text_col, lang=lang_col, source=source_col).withColumn("text", F.coalesce("text", F.lit("")))
    a = src.select(
        "id", "lang", "source", F.length(F.translate("text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANK, "") != "").alias("lines"),
        F.array_remove(F.split(F.translate("text", BLANK[1:], " " * 5), " "), "").alias("words"))
    b = a.select(
        "id", "lang", "source", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    c = b.withColumn("w", F.expr("if(size(h) < 3, cast(array() as array<bigint>), slice(transform(h, (x, i) -> xxhash64(x, get(h, i + 1), get(h, i + 2))), 1, size(h) - 2))")).drop("h")
    # windows in order of their hash: equal ones are neighbours; texts without equal windows skip this
    d = c.withColumn("s", F.expr("if(size(array_distinct(w)) = size(w), null, sort_array(transform(w, (x, i) -> struct(x as h, i as i))))")).drop("w")
    e = d.withColumn("again", F.expr(
        "transform(filter(s, (x, i) -> coalesce(x.h = get(s, i - 1).h, false) or coalesce(x.h = get(s, i + 1).h, false)), x -> x.i)")).drop("s")
    return e.withColumn("n_repeat_words", F.coalesce(F.expr(
        "cast(size(array_distinct(flatten(transform(again, i -> array(i, i + 1, i + 2))))) as bigint)"), F.lit(0).cast("long"))).drop("again").withColumn(
        "n_repeat_words", F.greatest("n_repeat_words", F.lit(0).cast("long")))


def _bucket(v: str):
    """The largest number <= v with 8 significant bits."""
    return F.expr(f"shiftleft(shiftright({v}, greatest(length(bin({v})) - 8, 0)), greatest(length(bin({v})) - 8, 0))")


def thresholds(counts: DataFrame, min_rows: int = MIN_ROWS, spread: int = SPREAD) -> DataFrame:
    """(lang, source, low_*, high_*) from the sketches; ``counts`` has the rates as ``r_*`` and ``base_failed``."""
    good = counts.filter("not base_failed")
    pairs = ", ".join(f"'{m}', r_{m}" for m in RATES)
    long = good.selectExpr("lang", "source", f"stack({len(RATES)}, {pairs}) as (metric, v)").withColumn("bucket", _bucket("v"))
    sketch = long.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    # rows of a group that is too small merge upwards: by language, then over all
    groups = counts.select("lang", "source").distinct()
    by_group = good.groupBy("lang", "source").agg(F.count("*").alias("n_group"))
    by_lang = by_group.groupBy("lang").agg(F.sum("n_group").alias("n_lang"))
    level = (groups.join(by_group.withColumnRenamed("lang", "l").withColumnRenamed("source", "s"), F.expr("lang <=> l and source <=> s"), "left").drop("l", "s")
             .join(by_lang.withColumnRenamed("lang", "l"), F.expr("lang <=> l"), "left").drop("l")
             .select("lang", "source", F.expr(f"case when n_group >= {min_rows} then 2 when n_lang >= {min_rows} then 1 else 0 end").alias("level")))
    none = F.lit(None).cast("string")
    lang_sketch = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    all_sketch = lang_sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    every = (sketch.select(F.lit(2).alias("level"), "lang", "source", "metric", "bucket", "n")
             .unionByName(lang_sketch.select(F.lit(1).alias("level"), "lang", none.alias("source"), "metric", "bucket", "n"))
             .unionByName(all_sketch.select(F.lit(0).alias("level"), none.alias("lang"), none.alias("source"), "metric", "bucket", "n")))
    key = "level, lang, source, metric"
    ranked = every.withColumn("upto", F.expr(f"sum(n) over (partition by {key} order by bucket)")).withColumn(
        "total", F.expr(f"sum(n) over (partition by {key})"))
    q = ranked.groupBy("level", "lang", "source", "metric").agg(
        *[F.min(F.expr(f"case when 100 * upto >= {p} * total then bucket end")).alias(f"q{p}") for p in (25, 50, 75)])
    # q25 of a one-sided spread below the median, q75 above it
    bounds = q.groupBy("level", "lang", "source").agg(*[
        x for m, (_, _, slack, both) in RATES.items() for x in (
            F.max(F.expr(f"case when metric = '{m}' then q50 + {spread} * (q50 - q25) + {slack} end")).alias(f"high_{m}"),
            F.max(F.expr(f"case when metric = '{m}' then {f'q50 - {spread} * (q75 - q50) - {slack}' if both else '0'} end")).alias(f"low_{m}"))])
    b = bounds.withColumnsRenamed({"level": "bl", "lang": "b_lang", "source": "b_source"})
    on = F.expr("level = bl and b_lang <=> if(level >= 1, lang, null) and b_source <=> if(level = 2, source, null)")
    return level.join(b, on, "left").drop("bl", "b_lang", "b_source", "level")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          min_rows: int = MIN_ROWS, spread: int = SPREAD) -> DataFrame:
    """Counts, base_failed and kept of every row."""
    tmp = Scratch(docs.sparkSession)
    counts = text_counts(docs, id_col, text_col, lang_col, source_col)
    rated = counts.withColumns({f"r_{m}": F.expr(f"1000 * {a} div greatest({b}, 1)") for m, (a, b, _, _) in RATES.items()})
    rated = tmp.put(rated.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")))
    limits = thresholds(rated, min_rows, spread).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    inside = " and ".join(f"r_{m} between coalesce(low_{m}, r_{m}) and coalesce(high_{m}, r_{m})" for m in RATES)
    return (rated.join(limits, F.expr("lang <=> t_lang and source <=> t_source"))
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    F.expr(f"not base_failed and {inside}").alias("kept")))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rates = ", ".join(f"1000 * {a} // greatest({b}, 1) AS r_{m}" for m, (a, b, _, _) in RATES.items())
    stack = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, r_{m} AS v FROM rated WHERE NOT base_failed" for m in RATES)
    high = ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN q50 + {SPREAD} * (q50 - q25) + {slack} END) AS high_{m}, "
        f"max(CASE WHEN metric = '{m}' THEN {f'q50 - {SPREAD} * (q75 - q50) - {slack}' if both else '0'} END) AS low_{m}"
        for m, (_, _, slack, both) in RATES.items())
    inside = " AND ".join(f"r_{m} BETWEEN coalesce(low_{m}, r_{m}) AND coalesce(high_{m}, r_{m})" for m in RATES)
    quant = ", ".join(f"min(CASE WHEN 100 * upto >= {p} * total THEN bucket END) AS q{p}" for p in (25, 50, 75))
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
b AS (SELECT *, len(w) AS n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM a),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
c AS (SELECT b.doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM b LEFT JOIN rep USING (doc_id)),
rated AS (SELECT *, {rates}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
sk AS (SELECT lang, source, metric, (v >> s) << s AS bucket, count(*) AS n
       FROM (SELECT *, greatest(length(bin(v)) - 8, 0) AS s FROM ({stack})) GROUP BY ALL),
good AS (SELECT lang, source, count(*) AS n_group FROM rated WHERE NOT base_failed GROUP BY ALL),
lev AS (SELECT g.lang, g.source, CASE WHEN n_group >= {MIN_ROWS} THEN 2 WHEN n_lang >= {MIN_ROWS} THEN 1 ELSE 0 END AS level
        FROM (SELECT DISTINCT lang, source FROM rated) g
        LEFT JOIN good x ON g.lang IS NOT DISTINCT FROM x.lang AND g.source IS NOT DISTINCT FROM x.source
        LEFT JOIN (SELECT lang, sum(n_group) AS n_lang FROM good GROUP BY lang) y ON g.lang IS NOT DISTINCT FROM y.lang),
ev AS (SELECT 2 AS level, lang, source, metric, bucket, n FROM sk
       UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM sk GROUP BY lang, metric, bucket
       UNION ALL SELECT 0, NULL, NULL, metric, bucket, sum(n) FROM sk GROUP BY metric, bucket),
rk AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
              sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM ev),
q AS (SELECT level, lang, source, metric, {quant} FROM rk GROUP BY ALL),
bo AS (SELECT level, lang, source, {high} FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {inside} AS kept
FROM rated r JOIN lev ON r.lang IS NOT DISTINCT FROM lev.lang AND r.source IS NOT DISTINCT FROM lev.source
LEFT JOIN bo ON bo.level = lev.level AND bo.lang IS NOT DISTINCT FROM (CASE WHEN lev.level >= 1 THEN r.lang END)
            AND bo.source IS NOT DISTINCT FROM (CASE WHEN lev.level = 2 THEN r.source END)
"""


ORACLE = _oracle()
