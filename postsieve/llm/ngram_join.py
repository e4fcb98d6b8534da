"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles. Two sets with a Jaccard index of at least t share
a shingle among the first n - ceil(t n) + 1 of each, in any one order of all shingles. Documents
with the same such prefix and size form one group, which is listed once under each shingle of its
prefix. Groups that share a shingle are candidates; their members are verified exactly.

The result is a class per document, not all pairs. So candidates are taken in two steps. First every group of
a list is verified against the list's head, the group with most frequent shingles, which settles
lists of many near copies with one pair per member. Then pairs of groups that share a shingle and are not yet in one class are
expanded to their members and verified: no link between different classes is left out. Pairs are
verified only if their prefixes share as many shingles as their sizes then demand. Members of one
group share their prefix, which tells nothing: they are compared with the group's lead first, and
where that leaves several classes in a group, by prefixes in the order of its own counts.

Shingles come in the order of their hashes, with frequent ones last: those that repeat within a
task's block of shingles are counted over all blocks, and the most frequent, at most
`MAX_FREQUENT`, are broadcast. Any order gives the same result; this one keeps passages that many
documents share out of most prefixes. Lists of frequent shingles are split by group over several
keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm import hashing
from postsieve.llm.base import settle
from postsieve.llm.graph import components

#: Least Jaccard index in percent, and words per shingle.
PERCENT = 75
WORDS = 5
#: A shingle is frequent from this many counted documents on; how many are broadcast at most (16 bytes each).
FREQUENT = 64
MAX_FREQUENT = 200_000
#: Documents whose ids are broadcast at most to fetch their texts (some 16 bytes each); more are joined.
MAX_SENT = 500_000
#: Shingles in a block, and groups under one key of a frequent shingle, about.
BLOCK = 1 << 20
LIST = 1_000


def _digest(numbers: np.ndarray, n: int) -> int:
    """64 bits that stand for a sorted set or a prefix, and its size."""
    weights = hashing.powers(len(numbers) + 1, hashing.BASES[1])[0][1:len(numbers) + 1]
    total = np.array([np.sum(hashing.mix(numbers) * weights, dtype=np.uint64) + np.uint64(n)], np.uint64)
    return int(hashing.mix(total).view(np.int64)[0])


def _sizes(words: int):
    """Rows (id, n, node) of documents, and (shingle, seen) of shingles repeated in a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def repeated() -> pa.RecordBatch:
            found, seen = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
            many = seen >= 2
            none = pa.nulls(int(many.sum()), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, none, pa.array(found[many].view(np.int64)), pa.array(seen[many].astype(np.int64))],
                names=["id", "n", "node", "shingle", "seen"],
            )

        for batch in batches:
            ns, nodes = [], []
            for text in batch.column(1):
                own = hashing.shingles(text.as_buffer() if text.is_valid else None, words)
                ns.append(len(own))
                nodes.append(_digest(own, len(own)))
                held.append(own)
                size += len(own)
                if size >= BLOCK:
                    yield repeated()
                    held, size = [], 0
            none = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), none, none],
                names=["id", "n", "node", "shingle", "seen"],
            )
        yield repeated()
    return run


def _prefixes(words: int, percent: int, frequent):
    """Rows (grp, n, node, prefix, part, weight) of documents; prefix is empty if this task has dealt the group already.

    weight is the share of a document's shingles that are frequent, in a thousand.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        dealt: set[int] = set()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(0):
                own = hashing.shingles(text.as_buffer() if text.is_valid else None, words)
                n = len(own)
                if not n:
                    continue
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                count = np.where(known[at] == own, counts[at], 0) if len(known) else np.zeros(n, np.int64)
                k = n - -(-percent * n // 100) + 1
                weight = int(1000 * np.count_nonzero(count) // n)
                order = np.lexsort((own, count))[:k]
                prefix, count = own[order], count[order]
                group = _digest(prefix, n)
                parts = np.maximum(count // LIST, 1)
                place = (np.uint64(group & (2**64 - 1)) % parts.astype(np.uint64)).astype(np.int64)
                parts = np.where(parts > 1, place, -1)
                first = group not in dealt
                if first and len(dealt) < 1_000_000:
                    dealt.add(group)
                rows.append((group, n, _digest(own, n), prefix.view(np.int64) if first else [], parts if first else [], weight))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=["grp", "n", "node", "prefix", "part", "weight"]
            )
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashing.shingles(t.as_buffer() if t.is_valid else None, words).view(np.int64) for t in batch.column(0)]
            nodes = [_digest(own.view(np.uint64), len(own)) for own in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"]
            )
    return run


def _frequent(spark: SparkSession, counted: DataFrame):
    """The most frequent shingles and their counts, sorted, as a broadcast of at most MAX_FREQUENT pairs."""
    top = (
        counted.groupBy("shingle").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= FREQUENT)
        .orderBy(F.desc("seen"), "shingle").limit(MAX_FREQUENT).toArrow()
    )
    known = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return spark.sparkContext.broadcast((known[order], top.column("seen").to_numpy()[order]))


def _sized(percent: int):
    """Whether two sizes allow the index asked for."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _shared_at_least(percent: int):
    """Shingles that the prefixes of a pair share at least if its index is high enough.

    With n - alpha + l shingles of either, where alpha is the least intersection, at least l are shared.
    """
    alpha = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - F.lit(1e-9))
    spare = [alpha - F.ceil(percent * F.col(n) / 100 - F.lit(1e-9)) + 1 for n in ("na", "nb")]
    return F.greatest(F.least(*spare), F.lit(1))


def _shared_in_ranges(percent: int, la: str, ma: str, lb: str, mb: str):
    """A lower bound of `_shared_at_least` for sizes from la to ma and from lb to mb."""
    alpha, prefix = percent / (100 + percent), percent / 100
    return F.least(
        alpha * F.col(lb) - (prefix - alpha) * F.col(ma), alpha * F.col(la) - (prefix - alpha) * F.col(mb)
    ) - F.lit(1e-6)


def _fetched(nodes: DataFrame, docs: DataFrame, sized: DataFrame, words: int, name: str) -> DataFrame:
    """(node, n, own): the sets of the distinct `nodes`."""
    # one document of each set; few enough are sent to the texts, else the texts are shuffled
    one = settle(sized.join(nodes, "node").groupBy("node").agg(F.min("id").alias("id")), f"{name}_nodes")
    small = one.count() <= MAX_SENT
    one = one.select(F.col("id").alias("of")).distinct()
    texts = docs.join(F.broadcast(one) if small else one, F.col("id").eqNullSafe(F.col("of"))).select("text")
    return settle(
        texts.mapInArrow(_sets(words), "node long, own array<long>").groupBy("node", F.size("own").alias("n"))
        .agg(F.first("own").alias("own")),
        f"{name}_sets",
    )


def _linked(pairs: DataFrame, docs: DataFrame, sized: DataFrame, percent: int, words: int, name: str) -> DataFrame:
    """The pairs (a, b, na, nb) whose sets have the Jaccard index asked for, compared in full."""
    pairs = settle(pairs, f"{name}_pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    sets = _fetched(nodes, docs, sized, words, name)
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("own").alias("own_a"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("own").alias("own_b"))
    both = pairs.join(a, ["a", "na"]).join(b, ["b", "nb"])
    common = F.size(F.array_intersect("own_a", "own_b"))
    return settle(
        both.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b").distinct(), f"{name}_links"
    )


def _within(
    members: DataFrame, comps: DataFrame, docs: DataFrame, sized: DataFrame, percent: int, words: int,
) -> DataFrame | None:
    """Pairs (a, b, na, nb) of one group's members in different classes that may link; None if no group has such members.

    Sets of one size n that share `least` shingles share one of the first n - least + 1 in any one
    order. Here it is that of the counts within the group, so that what all members share comes last.
    """
    least = F.ceil(2 * percent * F.col("n") / (100 + percent) - F.lit(1e-9))
    # where least is n only equal sets link, and these are one node
    placed = members.where(least < F.col("n")).join(comps, "node", "left").select("grp", "node", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    placed = settle(placed.join(mixed.select("grp"), "grp"), "ngram_within")
    if placed.isEmpty():
        return None
    sets = _fetched(placed.select("node").distinct(), docs, sized, words, "ngram_within").select("node", "own")
    single = placed.join(sets, "node").select("grp", "node", "n", "comp", F.explode("own").alias("shingle"))
    counts = single.groupBy("grp", "shingle").agg(F.count("*").alias("seen")).where("seen > 1")
    # shingles of one member come first and are not listed, but take their places
    ranked = single.join(counts, ["grp", "shingle"], "left").groupBy("grp", "node", "n", "comp").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(1)).alias("seen"), "shingle"))).alias("all")
    )
    entries = settle(
        ranked.select("grp", "node", "n", "comp", F.explode(F.slice("all", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("s"))
        .where("s.seen > 1").select("grp", "node", "n", "comp", F.col("s.shingle").alias("shingle")),
        "ngram_within_lists",
    )
    per = entries.select("grp", "shingle", "comp").distinct()
    met = per.withColumnRenamed("comp", "ca").join(per.withColumnRenamed("comp", "cb"), ["grp", "shingle"]).where("ca < cb")
    one, other = (
        entries.select("grp", "shingle", F.col("comp").alias(f"c{i}"), F.col("node").alias(i), F.col("n").alias(f"n{i}")) for i in "ab"
    )
    return met.join(one, ["grp", "shingle", "ca"]).join(other, ["grp", "shingle", "cb"]).select("a", "b", "na", "nb").distinct()


def classes(
    docs: DataFrame, *, ident: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS,
) -> DataFrame:
    """One row per document: `ident`, n_shingles, component_id (smallest id reachable by links).

    Two documents link if the Jaccard index of their shingle sets is at least `percent` / 100. A
    document without words, or with a null text, has n_shingles 0, links with nothing and is its
    own component. Equal texts have equal sets and link. Ids only name the documents: repeated ids
    are rows of their own, and a component's id is its smallest id that isn't null (null if all
    are). An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    first = settle(
        body.mapInArrow(_sizes(words), "id long, n long, node long, shingle long, seen long"), "ngram_sizes"
    )
    sized = first.where(F.col("n").isNotNull()).select("id", "n", "node")
    frequent = _frequent(spark, first.where(F.col("shingle").isNotNull()))
    grouped = settle(
        body.select("text").mapInArrow(
            _prefixes(words, percent, frequent), "grp long, n long, node long, prefix array<long>, part array<long>, weight long"
        ),
        "ngram_prefixes",
    )
    listed = (
        grouped.where(F.size("prefix") > 0)
        .select("grp", "weight", F.explode(F.arrays_zip("prefix", "part")).alias("k"))
        .select(F.col("k.prefix").alias("shingle"), F.col("k.part").alias("part"), "grp", "weight")
        .repartition("shingle", "part")
    )
    # the head is the group with the most frequent shingles: of many near copies, one with few changes
    heads = listed.groupBy("shingle", "part").agg(
        F.max(F.struct("weight", "grp")).alias("top"), F.min("grp").alias("least"), F.max("grp").alias("last")
    ).select("shingle", "part", F.col("top.grp").alias("head"), F.col("top.weight").alias("weight"), "least", "last")
    # every list but those of one group; of a shingle that is split into parts all stay
    lists = settle(
        listed.drop("weight").join(heads, ["shingle", "part"]).where((F.col("least") < F.col("last")) | (F.col("part") >= 0))
        .select("shingle", "grp", "head", "weight").distinct(),
        "ngram_lists",
    )
    members = settle(grouped.select("grp", "node", "n").distinct(), "ngram_members")
    leads = members.groupBy("grp").agg(F.min("node").alias("lead"), F.max("node").alias("other"), F.first("n").alias("n"))
    leads = settle(leads, "ngram_leads")

    lead = leads.select("grp", F.col("lead").alias("a"), F.col("n").alias("na"))
    head = leads.select(F.col("grp").alias("head"), F.col("lead").alias("b"), F.col("n").alias("nb"))
    tops = lists.groupBy("shingle").agg(F.max(F.struct("weight", "head")).alias("top")).select("shingle", F.col("top.head").alias("top"))
    heads_of_parts = lists.select("shingle", "head").distinct().join(tops, "shingle").where("head <> top")
    star = lists.select("grp", "head").unionAll(heads_of_parts.select(F.col("head").alias("grp"), F.col("top").alias("head")))
    # written, as it is read three times: the driver plans each use anew, with all that the use stands on
    star = settle(star.where("grp <> head").distinct().join(lead, "grp").join(head, "head").where(_sized(percent)), "ngram_star")
    prefixes = grouped.where(F.size("prefix") > 0).select("grp", "prefix")
    prefixes = prefixes.join(
        star.select("grp").unionAll(star.select("head")).distinct(), "grp", "left_semi"
    ).groupBy("grp").agg(F.first("prefix").alias("prefix"))
    star = star.join(prefixes.select("grp", F.col("prefix").alias("pa")), "grp").join(
        prefixes.select(F.col("grp").alias("head"), F.col("prefix").alias("pb")), "head"
    ).where(F.size(F.array_intersect("pa", "pb")) >= _shared_at_least(percent)).select("a", "b", "na", "nb")
    inside = members.join(leads.where("lead < other").select("grp", "lead"), "grp").where("node <> lead").select(
        F.col("node").alias("a"), F.col("lead").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb")
    )
    links = _linked(star.unionAll(inside), body, sized, percent, words, "ngram_star")
    comps = components(links)

    # what is not in one class yet: pairs of classes under one shingle, expanded to their members
    entries = lists.select("shingle", "grp").distinct()
    # how many of its prefix a group can share with any other group: those under which there is another
    held = entries.groupBy("grp").agg(F.count("*").alias("held"))
    placed = (
        entries.join(held, "grp").join(members, "grp")
        .join(comps, "node", "left").select("shingle", "node", "n", "held", F.coalesce("comp", "node").alias("comp"))
    )
    mixed = placed.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    placed = settle(placed.join(mixed.select("shingle"), "shingle"), "ngram_placed")
    per = placed.groupBy("shingle", "comp").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("held").alias("held"), F.count("*").alias("many")
    )
    x, y = (
        per.select("shingle", F.col("comp").alias(f"c{i}"), F.col("least").alias(f"l{i}"), F.col("most").alias(f"m{i}"), F.col("held").alias(f"h{i}"), F.struct("many", "comp").alias(f"s{i}"))
        for i in "ab"
    )
    # the class with fewer members under the shingle is expanded first, and its members meet the other's
    met = x.join(y, "shingle").where(
        (F.col("sa") < F.col("sb"))
        & (100 * F.col("ma") >= percent * F.col("lb")) & (100 * F.col("mb") >= percent * F.col("la"))
        & (F.least("ha", "hb") >= _shared_in_ranges(percent, "la", "ma", "lb", "mb"))
    ).select("shingle", "ca", "cb", "lb", "mb", "hb")
    one, other = (
        placed.select("shingle", F.col("comp").alias(f"c{i}"), F.col("node").alias(i), F.col("n").alias(f"n{i}"), F.col("held").alias(f"own_{i}"))
        for i in "ab"
    )
    rest = met.join(one, ["shingle", "ca"]).where(
        F.least("own_a", "hb") >= _shared_in_ranges(percent, "na", "na", "lb", "mb")
    ).join(other, ["shingle", "cb"]).where(_sized(percent) & (F.least("own_a", "own_b") >= _shared_at_least(percent)))
    # which class comes first differs from shingle to shingle: a pair is one pair either way round
    ordered = F.col("a") < F.col("b")
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    pair += [F.when(ordered, F.col(one)).otherwise(F.col(two)).alias(one) for one, two in (("na", "nb"), ("nb", "na"))]
    rest = rest.select(*pair).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(
        F.col("shared") >= _shared_at_least(percent)
    ).select("a", "b", "na", "nb")
    # members of one group, whose shared prefix is not in the lists
    within = _within(members, comps, body, sized, percent, words)
    if within is not None:
        rest = rest.unionAll(within).distinct()
    more = _linked(rest, body, sized, percent, words, "ngram_rest")
    if not more.isEmpty():
        comps = components(links.unionAll(more))

    named = sized.join(comps, "node", "left").select("id", "n", "node", F.coalesce("comp", "node").alias("comp"))
    smallest = named.where("n > 0").groupBy("comp").agg(F.min("id").alias("least"))
    return (
        named.join(smallest, "comp", "left")
        .select(F.col("id").alias(ident), F.col("n").alias("n_shingles"),
                F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))
    )


def keep_one(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows and columns of `docs` with one document of each class: the one with the smallest id.

    Rows without an id can't be told from each other, so they all stay. Of rows that are equal in
    id and text one stays.
    """
    own = settle(classes(docs, ident=ident, text=text, **options), "ngram_classes")
    gone = own.where(F.col(ident) != F.col("component_id")).select(F.col(ident).alias("_gone")).distinct()
    few = gone.count() <= MAX_SENT
    kept = docs.join(F.broadcast(gone) if few else gone, docs[ident] == F.col("_gone"), "left_anti")
    repeated = own.where(F.col(ident).isNotNull()).groupBy(ident).count().where("count > 1")
    if repeated.isEmpty():
        return kept
    packed = kept.select(F.struct("*").alias("_row"), F.col(ident).alias("_id"), F.xxhash64(F.col(text)).alias("_h"))
    one = packed.where(F.col("_id").isNotNull()).dropDuplicates(["_id", "_h"]).unionAll(packed.where(F.col("_id").isNull()))
    return one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
