"""Near duplicates by b-bit MinHash: bands for candidates, packed low bits to estimate.

1. Each text becomes its set of word shingles (64-bit hashes). Equal sets form a class, and
   only the class's first document goes on, so copies cost nothing more.
2. 128 minima per set: four in a row are a band's bucket key, and the lowest two bits of each
   are packed into a signature of 256 bits.
3. In a bucket each document meets the bucket's centre only, another one in each band. The
   agreement of two signatures, by counting bits and corrected for chance collisions, is the
   estimated similarity; pairs far below the threshold go.
4. Each document's best pair is confirmed on the full sets, and confirmed pairs are joined to
   components. Then the best pair of each two components that still meet at a centre is. At
   last, the documents of buckets that still hold several components are paired by the
   rarest of their differences to a common centre, which leaves out no link, and pairs
   between components are confirmed. A link inside a component changes nothing, so no group
   of copies is paired with itself.

Bands miss a pair at the threshold of 0.8 with a chance of 5e-8, and the estimate is allowed
six standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm import arrays
from passbook.llm.components import components
from passbook.session import saved, shared_dir

#: Minima of a set, bands of them, and low bits kept of each.
MINIMA, BANDS, BITS = 128, 32, 2
#: Similarity of a link, in percent.
PERCENT = 80
#: Estimates this far below the threshold are allowed for.
MARGIN = 0.25


def shingle_sets(texts: arrays.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted in each, and the bounds of the texts.

    A text of fewer than ``n`` words has its whole sequence as its one shingle.
    """
    words = arrays.words_of(texts, lower=True)
    value, at = arrays.grams(words, n)
    doc = words.doc[at]
    count = np.bincount(words.doc, minlength=len(texts))
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(words.doc, few)
        whole = np.zeros(len(few), np.uint64)
        factor = arrays.numbers(n, 3) | np.uint64(1)
        for k in range(n - 1):
            there = count[few] > k
            whole[there] += words.hash[first[there] + k] * factor[k]
        value = np.append(value, arrays.mix(whole + count[few].astype(np.uint64)))
        doc = np.append(doc, few)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig array of longs, bands array of longs) per document.

    h1 and h2 identify the set; both are null, like sig and bands, for an empty one.
    """
    rows_of_band = MINIMA // BANDS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = arrays.numbers(MINIMA, 4)
        factor = arrays.numbers(MINIMA, 5) | np.uint64(1)
        weight = arrays.numbers(rows_of_band, 6) | np.uint64(1)
        per_word = 64 // BITS
        for whole in batches:
            for batch in arrays.blocks(whole):
                value, bounds = shingle_sets(arrays.texts_of(batch.column("text")), n)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                starts = bounds[:-1][some]
                least = np.zeros((MINIMA, len(some)), np.uint64)
                for j in range(MINIMA if len(some) else 0):
                    least[j] = np.minimum.reduceat((value ^ salt[j]) * factor[j], starts)
                least = arrays.mix(least)
                bands = np.zeros((len(some), BANDS), np.uint64)
                for k in range(rows_of_band):
                    bands += (least[k::rows_of_band] * weight[k]).T
                bands = arrays.mix(bands)
                low = least & np.uint64(2**BITS - 1)
                sig = np.zeros((len(some), MINIMA // per_word), np.uint64)
                for j in range(MINIMA):
                    sig[:, j // per_word] |= low[j] << np.uint64(BITS * (j % per_word))
                h1, h2 = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
                if len(some):
                    h1 = np.add.reduceat(arrays.mix(value + np.uint64(7)), starts)
                    h2 = np.add.reduceat(arrays.mix(value ^ np.uint64(arrays.GOLDEN)), starts)
                ends = np.zeros(len(size) + 1, np.int32)
                np.cumsum(size > 0, out=ends[1:])
                missing = pa.array(size == 0)

                def scalar(x, some=some, n_rows=len(size), missing=missing):
                    out = np.zeros(n_rows, np.int64)
                    out[some] = x.view(np.int64)
                    return pa.array(out, mask=np.asarray(missing))

                def listed(x, ends=ends, missing=missing):
                    flat = pa.array(np.ascontiguousarray(x).ravel().view(np.int64))
                    return pa.ListArray.from_arrays(pa.array(ends * x.shape[1], pa.int32()), flat, mask=missing)

                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        pa.array(size.astype(np.int64)),
                        scalar(h1),
                        scalar(h2),
                        listed(sig),
                        listed(bands),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "sig", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>, bands array<long>"
    )


def agreement(x: Column, y: Column) -> Column:
    """Number of minima of which the low bits agree."""
    each = 0x5555555555555555
    differs = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        d = x[i].bitwiseXOR(y[i])
        either = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(each))
        differs = differs + F.bit_count(either)
    return F.lit(MINIMA) - differs


def least_agreement(percent: int) -> int:
    """Agreements that a pair at the threshold has but for the margin; chance ones included."""
    chance = 2.0**-BITS
    return int(MINIMA * (chance + (1 - chance) * (percent / 100 - MARGIN)))


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    ``texts`` (doc_id, text) is a stored table. A pair's texts meet by two joins of stored
    tables, so that a text in many pairs is split over tasks.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.blocks(whole, "x"):
                x, x_at = shingle_sets(arrays.texts_of(batch.column("x")), n)
                y, y_at = shingle_sets(arrays.texts_of(batch.column("y")), n)
                keep = np.zeros(batch.num_rows, bool)
                for i in range(batch.num_rows):
                    own, other = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
                    if len(own) and len(other):
                        both = len(np.intersect1d(own, other, assume_unique=True))
                        keep[i] = 100 * both >= percent * (len(own) + len(other) - both)
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    first = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    second = first.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return second.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def differences(nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Stored differences of the sets of ``nodes`` (node, component, grp) to a common centre.

    A group's centre holds the shingles that more than half of its nodes have. For a set
    without d of the centre's c shingles and with a others, less = 100 d + percent a. Two sets
    of a group are similar enough where (100 + percent) times the differences that they share
    are at least less + less - (100 - percent) c, their ``need``. Returns node, component, grp,
    c, less, without, beside (arrays).
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrays.blocks(whole):
                value, bounds = shingle_sets(arrays.texts_of(batch.column("text")), n)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.record_batch(
                    [*(batch.column(c) for c in ("node", "component", "grp")), sets], names=["node", "component", "grp", "has"]
                )

    spark = nodes.sparkSession
    sets = nodes.join(texts.withColumnRenamed("doc_id", "node"), "node").select("node", "component", "grp", "text")
    sets = sets.mapInArrow(listed, "node long, component long, grp long, has array<long>")
    sets = saved(sets, shared_dir(spark, "minhash-set"))
    size = sets.groupBy("grp").agg(F.count("*").alias("size"))
    each = sets.select("grp", F.explode("has").alias("shingle")).groupBy("grp", "shingle").agg(F.count("*").alias("times"))
    centre = each.join(size, "grp").where("2 * times > size").groupBy("grp").agg(F.collect_list("shingle").alias("centre"))
    centre = saved(centre, shared_dir(spark, "minhash-centre"))
    empty = F.array().cast("array<long>")
    both = sets.join(centre, "grp", "left").withColumn("centre", F.coalesce("centre", empty))
    both = both.select(
        "node",
        "component",
        "grp",
        F.size("centre").cast("long").alias("c"),
        F.array_except("centre", "has").alias("without"),
        F.array_except("has", "centre").alias("beside"),
    )
    less = 100 * F.size("without") + percent * F.size("beside")
    return saved(both.withColumn("less", less.cast("long")), shared_dir(spark, "minhash-difference"))


def prefix_pairs(nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b, ca, cb, agree) of ``nodes`` (node, component, grp) of one group and different
    components that may be linked; ``agree`` is higher where a link is more likely.

    Every pair that is linked is among them, or both are paired with the node that is nearest
    to the centre. That node is linked with all that are near enough to the centre for no
    difference to be needed. All other links share differences, so many that one is among the
    first few of both, rarest first: nodes stand in classes of ``less``, and look for partners
    of each class with as many of their differences as that class leaves room for. What sets
    of a large group differ in is rare, however much they have in common. For each difference,
    only nodes outside its most frequent component look for partners.
    """
    spark = nodes.sparkSession
    known = differences(nodes, texts, n, percent)
    slack = (100 - percent) * F.col("c")
    nearest = known.groupBy("grp").agg(
        F.min_by(F.struct("node", "component", "less"), F.struct("less", "node")).alias("best"), F.max("less").alias("most_less")
    )
    known = saved(known.join(nearest, "grp"), shared_dir(spark, "minhash-nearest"))
    star = known.where((F.col("component") != F.col("best.component")) & (F.col("less") + F.col("best.less") <= slack))
    star = star.select(
        F.col("node").alias("a"), F.col("best.node").alias("b"), F.col("component").alias("ca"),
        F.col("best.component").alias("cb"), F.lit(1 << 30).cast("long").alias("agree"),
    )
    kind = F.transform("without", lambda x: F.struct(F.lit(0).alias("kind"), x.alias("shingle")))
    other = F.transform("beside", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("shingle")))
    whole = 100 + percent

    def class_of(less: Column) -> Column:
        return F.floor(1.5 * F.log2(1 + less / whole)).cast("int")

    def least_of(number: Column) -> Column:
        return F.greatest(F.lit(0), F.floor((F.pow(2.0, number / 1.5) - 1) * whole) - 1).cast("long")

    each = known.select("node", "component", "grp", "c", "less", "most_less", F.explode(F.concat(kind, other)).alias("d"))
    each = each.select("node", "component", "grp", "c", "less", "most_less", "d.kind", "d.shingle")
    times = each.groupBy("grp", "kind", "shingle").agg(F.count("*").alias("times"))
    ordered = each.join(times, ["grp", "kind", "shingle"]).groupBy("node", "component", "grp", "c", "less", "most_less")
    ordered = ordered.agg(F.sort_array(F.collect_list(F.struct("times", "kind", "shingle"))).alias("all"))
    # For each class of partners, how many of the differences may hold the first shared one.
    size = F.size("all")
    classes = F.transform(F.sequence(F.lit(0), class_of(F.col("most_less"))), lambda j: F.struct(j.alias("other"), least_of(j).alias("least")))
    ordered = ordered.withColumn("own", class_of(F.col("less"))).withColumn("size", size).withColumn("class", F.explode(classes))
    need = F.greatest(F.lit(1), F.ceil((F.col("less") + F.col("class.least") - slack) / whole))
    most = F.least(F.col("size"), F.floor(least_of(F.col("class.other") + 1) / percent) + 1)
    ordered = ordered.where(need <= most).select(
        "node", "component", "grp", "c", "less", "size", "own", F.col("class.other").alias("other"),
        F.posexplode(F.slice("all", F.lit(1), (F.col("size") - need + 1).cast("int"))).alias("place", "d"),
    )
    keys = ["grp", "kind", "shingle", "lo", "hi"]
    ordered = ordered.where("d.times > 1").select(
        "node", "component", "grp", "c", "less", "size", "place", "own", "d.kind", "d.shingle",
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
    )
    ordered = saved(ordered, shared_dir(spark, "minhash-prefix"))
    most = saved(
        ordered.groupBy(*keys, "component")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(F.max_by("component", "n").alias("most"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        shared_dir(spark, "minhash-most"),
    )
    met = saved(ordered.join(most, keys), shared_dir(spark, "minhash-prefix"))
    few = met.where("component <> most").select(
        *keys,
        F.col("node").alias("a"),
        F.col("component").alias("ca"),
        F.col("size").alias("a_size"),
        F.col("place").alias("a_place"),
        F.col("less").alias("a_less"),
        F.col("own").alias("a_own"),
    )
    left = F.least(F.col("a_size") - F.col("a_place"), F.col("size") - F.col("place"))
    found = (
        few.join(met, keys)
        .where(
            (F.col("ca") != F.col("component"))
            & ((F.col("component") == F.col("most")) | (F.col("a") < F.col("node")))
            & ((F.col("a_own") != F.col("own")) | (F.col("lo") == F.col("hi")))
            & (whole * left >= F.col("a_less") + F.col("less") - slack)
        )
        .groupBy("a", F.col("node").alias("b"), "ca", F.col("component").alias("cb"))
        .agg(F.count("*").alias("agree"))
    )
    return star.unionByName(found)


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, component) after joining the components of ``edges`` (a, b)."""
    joined = components(edges).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return saved(
        labels.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")),
        shared_dir(labels.sparkSession, "minhash-label"),
    )


def best_of_components(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b, ca, cb, agree) the one with most agreement for each two components."""
    order = F.col("agree").cast("long") * F.lit(1 << 32) + F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 32) - 1))
    best = pairs.groupBy(F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2")).agg(
        F.max_by(F.struct("a", "b"), order).alias("p")
    )
    return best.select("p.a", "p.b")


def cluster(docs: DataFrame, n: int = 4, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_shingles, component_id, kept).

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets; a
    component's id is its smallest doc_id. Null and empty texts, and texts of white space,
    have an empty set, link with nothing and are their own component. Rows that repeat a
    doc_id count as one document: their links are shared, and each row is returned. A null
    doc_id has a null component and is kept. No rows in, no rows out.
    """
    spark = docs.sparkSession
    signed = saved(signatures(docs, n), shared_dir(spark, "minhash"))
    sets = signed.where(F.col("h1").isNotNull() & F.col("doc_id").isNotNull())
    classes = saved(
        sets.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node")), shared_dir(spark, "minhash-class")
    )
    # A doc_id that repeats with another text stands in several classes and links them.
    split = (
        sets.groupBy("doc_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .join(sets.select("doc_id", "h1", "h2", "n_shingles"), "doc_id")
        .join(classes, ["h1", "h2", "n_shingles"])
        .select("doc_id", "node")
        .distinct()
    )
    split = saved(
        split.join(split.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")),
        shared_dir(spark, "minhash-split"),
    )
    nodes = saved(
        sets.join(classes, ["h1", "h2", "n_shingles"])
        .where("doc_id = node")
        .select("node", "h1", "sig", "bands")
        .dropDuplicates(["node", "h1"]),
        shared_dir(spark, "minhash-node"),
    )
    salt = F.element_at(
        F.array(*(F.lit(int(v)) for v in arrays.numbers(BANDS, 8).view(np.int64))), (F.col("band") + 1).cast("int")
    )
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = saved(
        banded.groupBy("band", "key")
        .agg(F.min(F.col("node").bitwiseXOR(salt)).alias("c"), F.count("*").alias("n"))
        .where("n > 1")
        .select("band", "key", F.col("c").bitwiseXOR(salt).alias("centre")),
        shared_dir(spark, "minhash-bucket"),
    )
    met = saved(banded.join(buckets, ["band", "key"]), shared_dir(spark, "minhash-met"))
    sig = nodes.select("node", "sig")
    least = least_agreement(percent)
    stars = met.where("node <> centre").select("node", "centre").distinct()
    stars = saved(
        stars.join(sig, "node")
        .join(sig.select(F.col("node").alias("centre"), F.col("sig").alias("c_sig")), "centre")
        .withColumn("agree", agreement(F.col("sig"), F.col("c_sig")))
        .where(F.col("agree") >= least)
        .select(F.col("node").alias("a"), F.col("centre").alias("b"), "agree"),
        shared_dir(spark, "minhash-star"),
    )
    shared = met.select(F.col("node").alias("doc_id")).distinct()
    texts = saved(docs.select("doc_id", "text").join(shared, "doc_id"), shared_dir(spark, "minhash-text"))
    every = met.select("node").union(split.select("b")).union(split.select("a")).distinct()
    labels = saved(every.withColumn("component", F.col("node")), shared_dir(spark, "minhash-label"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Links (a, b) among the pairs, stored."""
        return saved(confirmed(pairs, texts, n, percent), shared_dir(spark, "minhash-link"))

    def between(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) of nodes in different components, with them as ca and cb."""
        of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return pairs.join(of_a, "a").join(of_b, "b").where("ca <> cb")

    def joined(links: DataFrame) -> DataFrame:
        """The labels after the links."""
        return relabelled(labels, between(links).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())

    rank = F.col("agree").cast("long") * F.lit(1 << 32) + F.xxhash64("b").bitwiseAND(F.lit((1 << 32) - 1))
    best = stars.groupBy("a").agg(F.max_by("b", rank).alias("b"))
    labels = joined(linked(best).unionByName(split))
    labels = joined(linked(best_of_components(between(stars))))
    placed = saved(met.select("band", "key", "node").join(labels, "node"), shared_dir(spark, "minhash-placed"))
    mixed = (
        placed.groupBy("band", "key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("band", "key")
    )
    mixed = saved(mixed, shared_dir(spark, "minhash-mixed"))
    inside = saved(placed.join(mixed, ["band", "key"]), shared_dir(spark, "minhash-inside"))
    # Components that meet in a bucket, directly or by others, are a group; links stay in it.
    first = inside.groupBy("band", "key").agg(F.min("component").alias("a"))
    meet = inside.select("band", "key", F.col("component").alias("b")).distinct().join(first, ["band", "key"])
    group = components(meet.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("grp"))
    open_ = inside.select("node", "component").distinct().join(group, "component").select("node", "component", "grp")
    open_ = saved(open_, shared_dir(spark, "minhash-open"))
    rest = saved(prefix_pairs(open_, texts, n, percent), shared_dir(spark, "minhash-rest"))
    labels = joined(linked(best_of_components(rest)))
    # What the best pairs did not join is confirmed pair by pair.
    now = open_.join(labels.withColumnRenamed("component", "now"), "node").select("component", "now").distinct()
    now = saved(now, shared_dir(spark, "minhash-now"))
    apart = (
        rest.join(now.select(F.col("component").alias("ca"), F.col("now").alias("na")), "ca")
        .join(now.select(F.col("component").alias("cb"), F.col("now").alias("nb")), "cb")
        .where("na <> nb")
        .select("a", "b")
    )
    labels = joined(linked(saved(apart, shared_dir(spark, "minhash-apart"))))
    of_class = saved(
        classes.join(labels, "node", "left").withColumn("component_id", F.coalesce("component", "node")),
        shared_dir(spark, "minhash-component"),
    ).select("h1", "h2", "n_shingles", "component_id")
    found = signed.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def first_of_each(docs: DataFrame, n: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, with their columns."""
    gone = cluster(docs, n, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
