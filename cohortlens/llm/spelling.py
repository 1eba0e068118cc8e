"""Spelling variants grouped by a dictionary of trie-node pairs.

Two words are near if one inserted, deleted or replaced character turns one into the other. The operator takes distinct
words with their counts and returns each word's number of near words, its *form* (the most frequent near word, if that
is ``times`` as frequent as the word) and its *root* (the last form of forms). It is exact:

1. The nodes of the trie of all words, and of the trie of all reversed words, are numbered: words are sorted over range partitions
   and one sweep gives every node the place at which the sort first reaches it. A prefix of a partition's first word that the
   words before already had keeps their number; these corrections are one path for each partition.
2. A word with m characters has the pairs (prefix node, suffix node) around each skipped character (m of them) and
   around each place between characters (m + 1). Equal skipped pairs are replacements, a skipped pair equal to an unskipped
   one is a deletion. In a stretch of equal characters only the first skip counts as a deletion, so each pair of words meets once.
3. One shuffle by the integer pair. The words that share a skipped pair differ in one character, so a group is at most as large as the
   alphabet, and one word at most has the unskipped pair. Near counts and the best near word come from the group at once:
   no pairs of words are formed, and the work is linear in the characters of the words.
4. Forms are at least ``times`` (over 1) as frequent, so they form chains without cycles, whose ends are found by doubling in a
   logarithmic number of joins.

Results for special inputs: a null text has no words; words and texts of any length are handled in memory linear in them; ties go
to the word that is smaller in code-point order; repeated rows count as often as they stand; a null id deletes nothing in ``counted``;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.tables import Scratch, pick, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10
ONE_IN = 31

#: a number is the partition (above) and the place in it (below)
PLACE_BITS = 40


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, least_letters: int = LEAST_LETTERS,
            least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """``(word, n)``: the distinct words of all texts and their counts.

    Words are maximal runs of ``letters`` after A-Z became a-z. Every word of one document in ``one_in`` (a hash of
    ``id:word``) loses the character at the hash's place first, which makes misspellings to group.
    """
    src = pick(docs, id=id_col, text=text_col)
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    # shorter runs can't give a word, deleted character or not
    runs = src.select(F.col("id").cast("long").cast("string").alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"([{letters}]{{{least_letters},}})"), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = "cast(h % char_length(run) as int)"
    word = F.expr(f"case when h % {one_in} = 0 then concat(substring(run, 1, {at}), substring(run, {at} + 2)) else run end")
    return (hashed.select(word.alias("word")).filter(F.char_length("word") >= least_letters)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count))


def _common(x: str, y: str) -> int:
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(x, y)))


def _sweep(key: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        last, path, nodes, row = "", [0], 0, 0
        for b in batches:
            paths = []
            for word in b.column(b.schema.get_field_index(key)).to_pylist():
                same = _common(last, word)
                first = (part << PLACE_BITS) + nodes + 1
                path = path[: same + 1] + list(range(first, first + len(word) - same))
                nodes += len(word) - same
                last = word
                paths.append(np.array(path, np.int64))
            off = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
            rows = (part << PLACE_BITS) + row + np.arange(b.num_rows)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(rows, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int64), *paths])))], schema=schema)
    return run


def numbered(words: DataFrame, key: str, tmp: Scratch) -> DataFrame:
    """``words`` with ``part``, ``place`` (ascending with the distinct strings in ``key``) and ``path``: the numbers of the trie's nodes
    from the root (0) to the string; equal prefixes have equal numbers."""
    spark = words.sparkSession
    out = T.StructType([*words.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()),
                        T.StructField("path", T.ArrayType(T.LongType()))])
    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    schema = pa.schema([*[(f.name, kinds[f.dataType.simpleString()]) for f in words.schema.fields],
                        ("part", pa.int32()), ("place", pa.int64()), ("path", pa.list_(pa.int64()))])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    swept = tmp.put(words.repartitionByRange(parts, key).sortWithinPartitions(key).mapInArrow(_sweep(key, schema), out))
    # one path for each partition reaches the driver
    ends = swept.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("path", key).alias("path")).orderBy("part")
    last, path, fixes = "", [0], []
    for e in ends.toLocalIterator():
        fix = path[1: _common(last, e["first"]) + 1]
        fixes.append((e["part"], fix))
        below = (1 << PLACE_BITS) - 1
        path = [fix[(x & below) - 1] if 0 < x & below <= len(fix) else x for x in e["path"]]
        last = e["last"]
    fixed = spark.createDataFrame(fixes, "part int, fix array<long>")
    below = f"(x & {(1 << PLACE_BITS) - 1})"
    return (swept.join(F.broadcast(fixed), "part")
            .withColumn("path", F.expr(f"transform(path, x -> if({below} between 1 and size(fix), fix[cast({below} as int) - 1], x))"))
            .drop("part", "fix"))


#: kinds of entries
SKIPPED, DELETED, WHOLE = 0, 1, 2


def entries(words: DataFrame) -> DataFrame:
    """``(prefix, suffix, n, m, kind)`` of words ``(word, id, n, forward, backward)``; ``m`` is -id."""
    skips = F.expr(f"""transform(sequence(0, size(forward) - 2), i -> struct(forward[i] as prefix, backward[size(backward) - 2 - i] as suffix,
                       if(i > 0 and letters[i] = letters[i - 1], {SKIPPED}, {DELETED}) as kind))""")
    wholes = F.expr(f"transform(forward, (x, i) -> struct(x as prefix, backward[size(backward) - 1 - i] as suffix, {WHOLE} as kind))")
    return (words.withColumn("letters", F.expr("split(word, '')")).select("n", (-F.col("id")).alias("m"), F.inline(F.concat(skips, wholes)))
            .select("prefix", "suffix", "n", "m", "kind"))


def near(entry: DataFrame) -> DataFrame:
    """``(id, n_near, best_n, best)`` of every word with near words."""
    group = entry.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(F.struct("n", "m", "kind")), asc=False).alias("g")).filter("size(g) > 1")
    group = group.select(F.expr(f"filter(g, x -> x.kind <> {WHOLE})").alias("s"), F.expr(f"get(filter(g, x -> x.kind = {WHOLE}), 0)").alias("v"))
    strip = "struct({0}.n as n, {0}.m as m)"
    other = f"if(x.m = s[0].m, if(size(s) > 1, {strip.format('s[1]')}, null), {strip.format('s[0]')})"
    inserted = f"x.kind = {DELETED} and v is not null"
    skipped = F.expr(f"""transform(s, x -> struct(-x.m as id, size(s) - 1 + if({inserted}, 1, 0) as k,
                         greatest({other}, if({inserted}, {strip.format('v')}, null)) as best))""")
    free = f"filter(s, x -> x.kind = {DELETED})"
    whole = F.expr(f"""if(v is null or size({free}) = 0, array(), array(struct(-v.m as id, size({free}) as k, {strip.format(f'get({free}, 0)')} as best)))""")
    return (group.select(F.inline(F.concat(skipped, whole))).filter("k > 0").groupBy("id")
            .agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))
            .select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.m")).alias("best")))


def ends(links: DataFrame, tmp: Scratch) -> DataFrame:
    """``(id, to)`` with ``to`` replaced by the last of the chain; ``links`` has no cycles and one row an id."""
    links = tmp.put(links)
    while True:
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jumped = tmp.put(links.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        tmp.drop(links)
        links = jumped
        if not links.filter("moved").limit(1).count():
            return links.select("id", "to")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of distinct words ``(word, n)``; ``times`` is over 1."""
    tmp = Scratch(words.sparkSession)
    base = tmp.put(words.select("word", F.col("n").cast("long").alias("n")))  # sorting reads it twice
    forward = numbered(base, "word", tmp).withColumnsRenamed({"place": "id", "path": "forward"}).withColumn("drow", F.reverse("word"))
    both = tmp.put(numbered(forward, "drow", tmp).withColumnRenamed("path", "backward").select("id", "word", "n", "forward", "backward"))
    known = both.select("id", "word", "n")
    found = tmp.put(known.select("id", "n").join(near(entries(both)), "id", "left")
                    .withColumn("form", F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))))
    last = ends(found.filter("form is not null").select("id", F.col("form").alias("to")), tmp)
    named = known.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    root = known.select(F.col("id").alias("to"), F.col("word").alias("root_word"))
    formed = (found.filter("form is not null").select("id", "form").join(named, "form").join(last, "id").join(root, "to")
              .select("id", "form_word", "form_n", "root_word"))
    return (known.join(found.select("id", "n_near"), "id").join(formed, "id", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def query(spark, sf_dir: str) -> DataFrame:
    return variants(counted(table(spark, sf_dir, "documents")))


#: the same by strings: CRC-32 from its polynomial, near words by joins on the text around a character
ORACLE = """
with recursive tab as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run
  from documents),
long_runs as (select doc_id, run, count(*) as k from runs where length(run) >= 7 group by all),
hashed as (
  select run, k, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''),
         lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))),
         lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295) as h
  from long_runs, tab),
word_counts as (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(k)::bigint as n
  from hashed group by 1),
words as (select word, n from word_counts where length(word) >= 7 and n >= 2),
skips as (
  select word, n, substr(word, 1, i::int) as a, substr(word, i::int + 2) as z from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (
  select x.word, y.word as other, y.n as other_n from skips x join skips y on x.a = y.a and x.z = y.z and x.word <> y.word
  union select x.word, y.word, y.n from skips x join words y on x.a || x.z = y.word
  union select y.word, x.word, x.n from skips x join words y on x.a || x.z = y.word),
best as (
  select word, count(*) as n_near, max(other_n) as best_n from pairs group by word),
formed as (
  select b.word, min(p.other) as form, b.best_n as form_n from best b join words w on w.word = b.word join pairs p on p.word = b.word and p.other_n = b.best_n
  where b.best_n >= 10 * w.n group by b.word, b.best_n),
follow as (
  select word, form as last, 1 as step from formed
  union all select f.word, g.form, step + 1 from follow f join formed g on g.word = f.last),
roots as (select word, arg_max(last, step) as root from follow group by word)
select w.word, f.form, coalesce(r.root, w.word) as root, w.n, coalesce(b.n_near, 0)::bigint as n_near, f.form_n
from words w left join best b on b.word = w.word left join formed f on f.word = w.word left join roots r on r.word = w.word
"""
