"""Document fingerprints by SpotSigs.

A signature is an anchor, a common word that is followed by a content word, with the chain of content words after it:
the next one, and the one after that unless more than SKIP common words stand between. A document's fingerprint is its
set of signature hashes. Sets are compared by Jaccard likeness; for a search they are partitioned by set length, so
that sets whose lengths alone rule a likeness out never meet, and the meeting ones are pruned by length before their
intersection is counted. All is DataFrame expressions.

Words are runs of letters and digits, lower-cased. A text without a signature takes the hashes of its pairs of
neighbouring words, or of its one word, or of the whole text if it has characters but no word; an empty (or null) text
has the empty set. Two empty sets are alike (1), an empty and another not (0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, require_columns

#: Common words of English, French, German and Spanish.
ANCHORS = tuple(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur ne nous ou par pas pour qu que qui sa se ses son sur un une vous "
    "auch auf aus bei das dem den der des die ein eine einem einen einer er es für ich im ist mit nicht oder sich sie sind und von wie wir zu zum zur "
    "al como con cual del el ella ellos era es esta este fue la las lo los más no o para pero por se si sin sobre su sus una y".split()
)
SKIP = 3
THRESHOLD = 0.8
#: Buckets whose first rows are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
QUANTILES = 200
#: Bytes of text for a range of ids, and for a task.
BUCKET_BYTES = 8 << 20
TASK_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _spots(words_col: str) -> Column:
    w = F.col(words_col)
    anchors = [a for a in dict.fromkeys(ANCHORS)]

    def spot(word: Column, i: Column) -> Column:
        first = F.get(w, i + 1)
        second = F.lit("")
        for k in range(SKIP + 2, 1, -1):
            later = F.get(w, i + k)
            second = F.when(~later.isin(anchors), later).otherwise(second)
        return F.when(word.isin(anchors) & ~first.isin(anchors), F.xxhash64(word, first, second))

    return F.array_distinct(F.filter(F.transform(w, spot), lambda h: h.isNotNull()))


def _plain(words_col: str, text: Column) -> Column:
    w = F.col(words_col)
    pairs = F.array_distinct(F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1))))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) > 1, pairs).when(F.size(w) == 1, F.array(F.xxhash64(w[0]))).when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(none)


def signatures(df: DataFrame, *, text_col: str = "text", out_col: str = "signatures") -> DataFrame:
    """df with the set of signature hashes, a list of distinct integers. A column of that name is replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, spots = fresh(df, "words"), fresh(df, "spots")
    staged = df.withColumn(w, words(text)).withColumn(spots, _spots(w))
    return staged.withColumn(out_col, F.when(F.size(spots) > 0, F.col(spots)).otherwise(_plain(w, text))).drop(w, spots)


def fingerprint(signatures_col: str) -> Column:
    """The set as a string: its hashes in order."""
    return F.array_join(F.sort_array(F.col(signatures_col)).cast("array<string>"), " ")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without counting where their lengths rule out `at_least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    whole = both / (F.size(a) + F.size(b) - both)
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * at_least), F.lit(0.0)).otherwise(whole)


def length_partition(size: Column, threshold: float) -> Column:
    """Sets of a likeness of threshold or more lie in the same partition or in neighbouring ones."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(threshold) + 1e-9).cast("int")


def similar_classes(df: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", signatures_col: str = "signatures") -> tuple[DataFrame, DataFrame]:
    """Membership (id, class_id) and links (a, b, likeness) between classes of equal sets, a < b.

    A class is named by its least id. Links lose none of threshold or more: within a length partition and the next,
    two such sets share one of the first |set| - ceil(threshold * |set|) + 1 hashes in order of rarity.
    """
    require_columns(df, id_col, signatures_col)
    own = df.select(F.col(id_col).alias("id"), fingerprint(signatures_col).alias("fp"))
    names = own.groupBy("fp").agg(F.min("id").alias("class_id"))
    membership = own.join(names, "fp").select("id", "class_id")
    sets = names.where("class_id is not null").select("class_id", F.when(F.col("fp") == "", F.array().cast("array<bigint>")).otherwise(F.split("fp", " ").cast("array<bigint>")).alias("s"))
    single = sets.select("class_id", F.size("s").alias("n"), F.explode("s").alias("h"))
    rarity = single.groupBy("h").agg(F.count("*").alias("df"))
    rank = F.row_number().over(W.partitionBy("class_id").orderBy("df", "h"))
    prefix = single.join(rarity, "h").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).where("df > 1")
    part = length_partition(F.col("n"), threshold)
    left = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "h", part.alias("p"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "h", F.explode(F.array(part, part - 1, part + 1)).alias("p"))
    ratio = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold)
    pairs = left.join(right, ["h", "p"]).where((F.col("a") < F.col("b")) & ratio).select("a", "b").distinct()
    sa, sb = sets.select(F.col("class_id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("class_id").alias("b"), F.col("s").alias("sb"))
    scored = pairs.join(sa, "a").join(sb, "b").select("a", "b", likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness"))
    return membership, scored.where(F.col("likeness") >= threshold)


def with_next(df: DataFrame, add, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None):
    """(id, text, next_text and the columns that add() makes of text, with theirs of the next row as next_NAME), next
    in ascending order of id (null first, equal ids by text); after the last comes the first.

    Rows are dealt out by ranges of id, at least one for each BUCKET_BYTES of text, cut at quantiles and evenly between
    them; the first row of each range is sent to the range before it as well. The ranges' first ids, one row each, are
    sorted in one task.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = rows.agg(F.percentile_approx("id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("cuts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    total, tasks = seen["bytes"] or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(4 * tasks, -(-total // BUCKET_BYTES))
    cuts = seen["cuts"]
    cuts = sorted(set(cuts or [0]))
    fine = max(1, math.ceil(buckets / len(cuts)))
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    i = F.greatest(F.size(F.filter(bounds, lambda b: b <= F.col("id"))), F.lit(1))
    low, high = F.element_at(bounds, i), F.element_at(bounds, F.least(i + 1, F.lit(len(cuts))))
    share = F.when(high > low, F.floor((F.col("id") - low) * fine / (high - low))).otherwise(F.lit(0))
    bucket = F.when(F.col("id").isNull(), F.lit(0)).otherwise((i - 1) * fine + F.least(F.greatest(share, F.lit(0)), F.lit(fine - 1))).cast("bigint")
    placed = rows.withColumn("bucket", bucket)
    firsts = placed.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull(), "id")).getField("id").alias("first"))
    turn = W.orderBy("bucket")
    whole = turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sent = firsts.select("first", F.coalesce(F.lag("bucket").over(turn), F.max("bucket").over(whole)).alias("to"))
    if buckets <= BROADCAST_BUCKETS:
        sent = F.broadcast(sent)
    both = placed.join(sent, F.col("id").eqNullSafe(F.col("first")), "left")
    goes = F.filter(F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("guest")))), lambda x: x.isNotNull())
    dealt = both.select("id", "text", F.explode(goes).alias("g")).select("id", "text", "g.bucket", "g.guest")
    made = add(dealt.repartition(max(tasks, -(-total // TASK_BYTES)), "bucket"))
    added = [c for c in made.columns if c not in ("id", "text", "bucket", "guest")]
    order = W.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("id"), "text")
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in ["text", *added]]
    return made.select("id", "text", "guest", *added, *following).where("guest = 0").drop("guest")
