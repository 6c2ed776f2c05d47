"""Line de-duplication by an exact set-similarity join.

A line is the set of its words. A line is removed when an earlier line (smaller doc_id, then
smaller number in its document) is equal or has Jaccard similarity of ``PERCENT`` or more with
it; lines without a word always stay. All candidates come from the join:

* words are ordered by rarity: the (logarithm of the) count of each of 2**BUCKET_BITS hash
  buckets over all lines (a table of fixed size, sent as one literal), then the word's hash. Any one order for all lines gives exact results;
* prefix filter: lines that similar share a word among each line's first
  ``size - ceil(t * size) + 1`` words. Where all of these are frequent, pairs of words of a prefix
  one longer are the keys (two such lines share two words there), or, of lines of LONG words and more, the frequent
  words themselves, so that a line's keys stay in proportion to its words (lines a little longer than LONG have both, as
  similar lines may lie on either side). Lines so short that only an equal set is that similar have their whole set as key;
* positional and length filters, and a parity bitmap of all words (its bits differ in at most as
  many places as the sets do), drop candidates inside the join;
* what is left is verified on the words themselves.

Lines meet the first line of each key before all others: a line that this finds a match for needs
no other, so that groups of very many similar lines give few candidates. Keys of more than HEAVY lines are
then joined in blocks, a task a block.

Defined results: null texts have no line; documents with a null id are left alone; repeated rows
of an id are one document (of rows of one id with different texts, a line number that goes, goes in all); the first
occurrence stays; very long lines are lines like others; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagespan.llm.shared import NARROW_ROWS, dropped, fresh, shared_dir, tidy, written

PERCENT = 80
BUCKET_BITS, RANK_BITS = 18, 8
#: Words found more often than this are keys in pairs only, up to lines of LONG words.
FREQUENT, LONG = 4096, 160
#: Keys of more lines than this are joined in blocks of BLOCK lines.
HEAVY, BLOCK = 4096, 1024
#: Ranks are eighths of the count's binary logarithm.
_SCALE = 8
_HASH_BITS = 63 - RANK_BITS
#: A line's place in one number, which hash aggregation can hold: the id, then 31 bits of the line's number.
_LINE = 1 << 31


def _bound(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _pieces(line: Column) -> Column:
    """Words, and empty strings. Java splits at a single blank without a pattern; other white space is rare within lines."""
    blank = F.when(line.rlike("[\\x09-\\x0D]"), F.regexp_replace(line, "[\\x09-\\x0D]", " ")).otherwise(line)
    return F.split(blank, " ")


def words_of(line: Column) -> Column:
    return F.array_remove(F.array_distinct(_pieces(line)), "")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.posexplode(F.split(F.col(text), "\n")).alias("l", "line"))


def _copies(line: str | Column) -> list[Column]:
    """128 bits of hash, by which lines count as equal."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _distinct(lines: DataFrame) -> DataFrame:
    """Every line with a word once, at its first place: d, l, line."""
    place = F.col("d").cast("decimal(19,0)") * F.lit(_LINE).cast("decimal(10,0)") + F.col("l").cast("decimal(10,0)")
    first = lines.filter(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).groupBy("line").agg(F.min(place).alias("at"))
    l_ = F.pmod("at", F.lit(_LINE).cast("decimal(10,0)"))
    return first.select(F.round((F.col("at") - l_) / F.lit(_LINE).cast("decimal(10,0)")).cast("long").alias("d"), l_.cast("int").alias("l"), "line")


def _bucketed(df: DataFrame, parts: int, *by: str) -> tuple[str, DataFrame]:
    """``df``, which is dealt by ``by`` into ``parts``, as a table that joins on ``by`` read without an exchange (they sort it anyway)."""
    spark = df.sparkSession
    name = f"lines_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, *by).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    tidy(spark)
    return name, spark.table(name)


def _rarity(distinct: DataFrame) -> Column:
    """A literal: the rank of each hash bucket, by how often its words occur."""
    bucket = F.shiftrightunsigned(F.xxhash64("w"), 64 - BUCKET_BITS)
    words = distinct.select(F.explode(_pieces(F.col("line"))).alias("w")).filter("w <> ''").groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.least(F.floor(_SCALE * F.log2(1 + F.col("n"))), F.lit((1 << RANK_BITS) - 1)).cast("int")
    ranks = ["0"] * (1 << BUCKET_BITS)
    for r in words.select("b", rank.alias("r")).collect():  # at most 2**BUCKET_BITS rows
        ranks[r["b"]] = str(r["r"])
    return F.split(F.lit(",".join(ranks)), ",").cast("array<int>")


def _ordered(line: Column, ranks: Column) -> Column:
    """The line's words as numbers that sort by rarity: bucket rank, then hash."""
    hashes = F.transform(F.array_remove(_pieces(line), ""), lambda w: F.xxhash64(w))
    rank = lambda h: F.coalesce(F.get(ranks, F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")), F.lit(0)).cast("long")
    numbers = F.transform(hashes, lambda h: F.shiftleft(rank(h), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, RANK_BITS + 1)))
    return F.sort_array(F.array_distinct(numbers))


def _prefix(size: Column, percent: int) -> Column:
    return size - F.ceil(size * percent / 100).cast("int") + 1


def _keys(distinct: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """key, place, and the line's (d, l), size and bitmap, for every key of every line."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    side = F.lit(64).cast("long")
    parity = lambda f: F.aggregate("t", F.lit(0).cast("long"), f)
    both = parity(lambda a, x: a.bitwiseXOR(bit(x)))
    one = parity(lambda a, x: F.when(x.bitwiseAND(side) != 0, a.bitwiseXOR(bit(x))).otherwise(a))
    size = F.size("t")
    hot = F.lit((_SCALE * (FREQUENT.bit_length() - 1)) << _HASH_BITS)
    lines = distinct.select("d", "l", _ordered(F.col("line"), ranks).alias("t"))
    lines = lines.select("d", "l", size.alias("s"), F.xxhash64("t").alias("all"), both.alias("both"), one.alias("m1"), F.slice("t", F.lit(1), _prefix(size, percent) + 1).alias("q"))
    s = F.col("s")
    whole = 100 * s < percent * (s + 1)  # neither a larger nor a smaller set can match
    # the rare words are the first of the prefix
    m0 = F.col("both").bitwiseXOR(F.col("m1")).alias("m0")
    lines = lines.select("d", "l", "s", "all", m0, "m1", "q", whole.alias("whole"), _prefix(s, percent).alias("most"), F.filter("q", lambda x: x >= hot).alias("tail"))
    rare = F.size("q") - F.size("tail")
    # where one common word may do, there is no pair, so that frequent words are keys as well
    alone = (percent * s <= 100) | (s >= LONG) | (rare >= F.col("most"))
    paired = (F.size("tail") > 0) & (percent * s < 100 * LONG)
    singles = F.when(F.col("whole"), F.lit(1)).when(alone, F.col("most")).otherwise(rare)
    lines = lines.select("d", "l", "s", "all", "m0", "m1", "q", "tail", "whole", singles.alias("n"), paired.alias("paired"), rare.alias("first"))
    after = lambda i: F.slice("tail", i + 2, F.greatest(F.size("tail") - i - 1, F.lit(0)))
    pairs = F.flatten(F.transform("tail", lambda a, i: F.transform(after(i), lambda b: F.xxhash64(a, b))))
    words = F.slice("q", F.lit(1), F.col("n"))
    keys = F.when(F.col("whole"), F.array("all")).when(F.col("paired"), F.concat(words, pairs)).otherwise(words)
    # pairs come after all single words; none begins before the first frequent word
    rare, n = F.when(F.col("paired"), F.col("first")).otherwise(F.lit(0)), F.col("n")
    out = lines.select("d", "l", "s", "m0", "m1", n.alias("n"), rare.alias("rare"), F.posexplode(keys).alias("i", "key"))
    return out.select("key", F.when(F.col("i") < F.col("n"), F.col("i")).otherwise(F.col("rare")).alias("i"), "d", "l", "s", "m0", "m1")


def _may_match(x: str, y: str, percent: int) -> Column:
    """y is the earlier line; sizes, places and bitmaps allow the similarity."""
    c = lambda side, name: F.col(f"{side}.{name}")
    total = c(x, "s") + c(y, "s")
    need = percent * total  # overlap >= percent * total / (100 + percent)
    rest = F.least(c(x, "s") - c(x, "i"), c(y, "s") - c(y, "i"))
    differ = F.bit_count(c(x, "m0").bitwiseXOR(c(y, "m0"))) + F.bit_count(c(x, "m1").bitwiseXOR(c(y, "m1")))
    earlier = (c(y, "d") < c(x, "d")) | ((c(y, "d") == c(x, "d")) & (c(y, "l") < c(x, "l")))
    return earlier & ((100 + percent) * rest >= need) & ((100 + percent) * differ <= (100 - percent) * total)


def _verified(pairs: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    """The later lines (d, l) of the pairs (xd, xl, yd, yl) that are similar, as a written table; only lines in pairs travel."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("xd").alias("d"), F.col("xl").alias("l")).unionByName(pairs.select(F.col("yd").alias("d"), F.col("yl").alias("l"))).distinct()
    ids = written(ids, "ids")
    worded = distinct.join(F.broadcast(ids) if ids.count() <= NARROW_ROWS else ids, ["d", "l"], "left_semi")
    worded = written(worded.select("d", "l", words_of(F.col("line")).alias("words")), "worded")
    x, y = worded.toDF("xd", "xl", "a"), worded.toDF("yd", "yl", "b")
    both = pairs.join(x, ["xd", "xl"]).join(y, ["yd", "yl"])
    common = F.size(F.array_intersect("a", "b"))
    found = both.filter((100 + percent) * common >= percent * (F.size("a") + F.size("b"))).select(F.col("xd").alias("d"), F.col("xl").alias("l")).distinct()
    found = written(found, "matched")
    dropped(pairs)
    dropped(ids)
    dropped(worded)
    return found


def _places(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x.d").alias("xd"), F.col("x.l").alias("xl"), F.col("y.d").alias("yd"), F.col("y.l").alias("yl")).distinct()


def _met(x: DataFrame, y: DataFrame, percent: int, *more: str) -> DataFrame:
    """Distinct candidates (xd, xl, yd, yl) of lines that share a key."""
    same = F.col("x.key") == F.col("y.key")
    for c in more:
        same &= F.col(f"x.{c}") == F.col(f"y.{c}")
    return _places(x.alias("x").join(y.alias("y"), same & _may_match("x", "y", percent)))


def _met_in_blocks(left: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """The same for keys of very many lines: later lines are dealt into blocks, every earlier line goes to all blocks of its key."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    x = left.withColumn("block", F.pmod(F.hash("d", "l"), blocks))
    y = keys.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return _met(x.repartition("key", "block"), y.repartition("key", "block"), percent, "block")


def removed_lines(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, l, similar of every line to remove: copies (similar is false) and similar lines."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = _lines(docs, doc_id, text).filter(F.length("line") > 0)
    distinct = written(_distinct(lines), "lines")
    # a key of one line says nothing; others carry their key's first line and number of lines
    of = Window.partitionBy("key").orderBy("d", "l")
    whole = of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(F.struct("d", "l", "i", "s", "m0", "m1")).over(whole)
    keyed = _keys(distinct, _rarity(distinct), percent).repartition(n, "key").withColumns({"n": F.count(F.lit(1)).over(whole), "r": F.row_number().over(of), "h": head}).filter("n > 1")
    name, table = _bucketed(keyed, n, "key")  # so that its join with itself needs no exchange
    del keyed
    led = table.filter("r > 1").select(F.struct("d", "l", "i", "s", "m0", "m1").alias("x"), F.col("h").alias("y")).filter(_may_match("x", "y", percent))
    first = _verified(_places(led), distinct, percent)
    few = lambda df: F.broadcast(df) if df.count() <= NARROW_ROWS else df
    # a key's first line has met all others
    keys = table.filter("r > 1 and n > 2").drop("h")
    left = keys.filter("r > 2").join(few(first), ["d", "l"], "left_anti")
    heavy = F.col("n") > HEAVY
    rest = _met(left.filter(~heavy), keys.filter(~heavy), percent)
    if not keys.filter(heavy).isEmpty():
        rest = rest.unionByName(_met_in_blocks(left.filter(heavy), keys.filter(heavy), percent)).distinct()
    more = _verified(rest, distinct, percent)
    dropped(table)
    docs.sparkSession.sql(f"drop table {name}")
    similar = first.unionByName(more).withColumn("similar", F.lit(True))
    named = distinct.select("d", "l", *_copies("line"))  # first, so that no text travels
    state = named.join(similar, ["d", "l"], "left").select("h1", "h2", F.col("d").alias("fd"), F.col("l").alias("fl"), F.coalesce("similar", F.lit(False)).alias("similar"))
    state = written(state, "state")
    dropped(distinct)
    out = lines.select("d", "l", *_copies("line")).join(state, ["h1", "h2"]).filter("similar or d <> fd or l <> fl")
    return out.select("d", "l", "similar").distinct()


def deduplicated(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without the removed lines, and the names of columns with their numbers.

    A text of which every line goes becomes empty; texts without removed lines stay as they are.
    """
    gone = removed_lines(docs, percent, doc_id, text).groupBy("d").agg(F.collect_set("l").alias("ls"), F.count_if(~F.col("similar")).alias("ne"), F.count_if(F.col("similar")).alias("ns"))
    key, drop, exact, near = fresh(docs, "gone_doc", "gone_lines", "n_exact", "n_similar")
    both = docs.withColumn(key, F.col(doc_id).cast("long")).join(gone.toDF(key, drop, exact, near), key, "left")
    # the numbers that stay, by a hash set, then their lines: linear in the document's lines
    kept = _bound(F.split(F.col(text), "\n"), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drop)), lambda i: F.get(ls, i)), "\n"))
    new = F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept)
    columns = [new.alias(c) if c == text else F.col(c) for c in docs.columns]
    return both.select(*columns, F.coalesce(F.col(exact), F.lit(0)).alias(exact), F.coalesce(F.col(near), F.lit(0)).alias(near)), {"n_exact": exact, "n_similar": near}


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's removed lines, and the digest of what stays of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, _ = deduplicated(docs)
    return out.select("doc_id", "n_exact", "n_similar", F.md5("text").alias("text_md5"))
