"""SpotSigs fingerprints in SQL functions: chains of content words behind common-word anchors.

Wherever a common word is followed by a content word, that anchor, the content word and the next
content word (common words between them skipped) make a signature. A document's fingerprint is the
set of its signatures. A text with hardly any anchors takes every word as one. Sets are
compared by Jaccard; a pair whose lengths alone rule out the threshold is never compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width

# The anchors, common words of English, French, German and Spanish.
COMMON = (
    "the a an and of to in is it that was for on with as be by at are this or not from have has but they you he she we his her "
    "le la les un une des du de et est que qui en dans pour par sur au aux avec ce se ne pas plus il elle nous vous "
    "der die das ein eine und zu den von mit ist auf nicht dem des sich auch als für im er sie es wir "
    "el los las una y del que al con por para su lo como más pero sus o este"
).split()
#: Fewer anchored signatures than this, and all words become anchors.
FEW = 4
#: Split points of the doc_id order that the driver keeps, at most, and documents between two of them.
MOST_SPLITS, SPLIT_DOCS = 65_536, 500


def signatures(text: Column) -> Column:
    """Sorted distinct signatures (32-bit hashes) of a text; null and wordless texts have none."""

    def chains(words):
        content = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~F.get(words, i).isin(*COMMON))

        def spots(at):
            made = F.transform(at, lambda p, r: F.when((p > 0) & (F.coalesce(F.get(at, r - 1), F.lit(-1)) != p - 1), F.hash(F.get(words, p - 1), F.get(words, p), F.get(words, F.get(at, r + 1)))))
            return F.filter(made, lambda h: h.isNotNull())

        anchored = F.get(F.transform(F.array(content), spots), F.lit(0))
        every = F.transform(words, lambda w, i: F.hash(w, F.get(words, i + 1), F.get(words, i + 2)))
        return F.get(F.transform(F.array(anchored), lambda s: F.when(F.size(s) >= FEW, s).otherwise(every)), F.lit(0))

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    none = F.array().cast("array<int>")
    return F.array_sort(F.array_distinct(F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) == 0, none).otherwise(chains(ws))), F.lit(0))))


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a signature, ascending."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 1 for two empty ones. Below `least` by their lengths alone: 0, uncompared."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    value = common / (F.size(a) + F.size(b) - common)
    short, long_ = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(long_ == 0, 1.0).when((short == 0) | (short < least * long_), 0.0).otherwise(value)


def pairs(docs: DataFrame, *, least: float = 0.8) -> DataFrame:
    """a, b (a < b), likeness: representatives of signature sets (least doc_id) whose Jaccard is
    at least `least`. Documents of one set are one class; use `classes` for membership.

    Sets are dealt by length, so that only lengths within the ratio `least` meet, and by the rarest
    signatures that any partner must share (the prefix that the threshold leaves open); pairs are then verified."""
    sets = classes(docs).groupBy("sigs").agg(F.min("class_id").alias("id")).where("size(sigs) > 0")
    rarity = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    ordered = (
        sets.select("id", F.explode("sigs").alias("sig")).join(rarity, "sig")
        .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("by_rarity"))
        .withColumn("size", F.size("by_rarity"))
    )
    prefix = ordered.withColumn("prefix", F.expr(f"slice(by_rarity.sig, 1, size - CAST(ceil({least} * size) AS INT) + 1)"))
    # a length class spans a factor 1 / least; partners lie in the same class or the next
    level = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(least)))
    seeds = prefix.select("id", "size", level.alias("level"), F.explode("prefix").alias("sig"))
    probes = seeds.withColumn("level", F.explode(F.array("level", F.col("level") + 1)))
    a, b = seeds.alias("a"), probes.alias("b")
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.id") != F.col("b.id")))
    met = met.where(f"least(a.size, b.size) >= {least} * greatest(a.size, b.size)")
    found = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    left, right = (sets.select(F.col("id").alias(x), F.col("sigs").alias(f"{x}_sigs")) for x in "ab")
    return found.join(left, "a").join(right, "b").withColumn("likeness", jaccard(F.col("a_sigs"), F.col("b_sigs"), least)).where(f"likeness >= {least}").select("a", "b", "likeness")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, sigs and class_id: the least doc_id of the same signature set."""
    own = docs.select("doc_id", signatures(F.col("text")).alias("sigs"))
    return own.join(own.groupBy("sigs").agg(F.min("doc_id").alias("class_id")), "sigs")


def _bucket(splits: list[int]) -> Column:
    """How many split points are at most doc_id, by binary search in a literal array. Null comes first."""
    points = F.array(*[F.lit(x).cast("long") for x in splits]) if splits else F.array().cast("array<long>")
    low = F.lit(0)
    steps = len(splits).bit_length()
    if not steps:
        return low
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi")), lambda s, _: F.when(s.lo >= s.hi, s).otherwise(
        F.when(F.get(points, F.floor((s.lo + s.hi) / 2).cast("int")) <= ids, F.struct((F.floor((s.lo + s.hi) / 2).cast("int") + 1).alias("lo"), s.hi.alias("hi"))).otherwise(
            F.struct(s.lo.alias("lo"), F.floor((s.lo + s.hi) / 2).cast("int").alias("hi")))), lambda s: s.lo)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sigs, next_text, next_sigs: of the next document by doc_id; after the last the first.

    The doc_id order is cut at about evenly spaced ids; each stretch is sorted by itself, and the first document
    of a stretch is also sent, as a guest, to the stretch before. Texts move once."""
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    n = ids.count()
    wanted = min(MOST_SPLITS, n // SPLIT_DOCS)
    splits = sorted({int(x) for x in ids.approxQuantile("doc_id", [(i + 1) / (wanted + 1) for i in range(wanted)], 0.1 / (wanted + 1))}) if wanted else []
    bucket = _bucket(splits)
    heads = sorted((r["bucket"], r["head"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).alias("head")).collect())
    before = {h: heads[k - 1][0] for k, (_, h) in enumerate(heads)}
    guests = F.broadcast(spark.createDataFrame([(h, int(b), k == 0) for k, (h, b) in enumerate(before.items())], "_head long, _to int, _wraps boolean"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(guests, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("_head"), "left")
    # a guest sorts behind all rows of the stretch it visits
    own, guest = F.struct(bucket.cast("int").alias("b"), F.lit(0).alias("g")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("g"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest)))).select("doc_id", "text", F.col("_at.b").alias("_b"), F.col("_at.g").alias("_g"))
    dealt = rows.repartition(shuffle_width(spark), "_b").withColumn("sigs", signatures(F.col("text")))
    order = Window.partitionBy("_b").orderBy("_g", "doc_id", F.xxhash64("text"))
    led = dealt.withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)})
    return led.where("_g = 0").drop("_b", "_g")


def fingerprints_of_edits(docs: DataFrame) -> DataFrame:
    """Of each document and its edited text: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has the last quarter of its code points (rounded down) replaced by as many first ones of
    the next document. Null text counts as empty. Null doc_id comes first; repeated rows follow one another. A
    single document is its own next. An empty table gives no rows; other columns are ignored."""
    text, n = F.coalesce(F.col("text"), F.lit("")), F.length(F.coalesce(F.col("text"), F.lit("")))
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), quarter))
    rows = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"), jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
