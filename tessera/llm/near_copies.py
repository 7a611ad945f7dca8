"""Near copies for the pipeline: five-word shingles at Jaccard similarity 0.8 or more.

SimHash proposes: the byte-position index of :mod:`simhash_dedup`, over fingerprints of five-word
shingles, gives all pairs within two bits.  At similarity 0.8 two fingerprints of 64 bits differ in about ten,
beyond what shared bytes can guarantee, so a prefix index proposes all the others, and whole shingle sets
decide.  Links make components, and no component is missed:

* Equal sets are put together first.  Shingles have one order for all texts: those that a sample of the texts
  repeats come last, by their number there, others by hash.  Two sets of similarity 0.8 share one of their first
  ``size // 5 + 1`` shingles, and one more for each by which both go on.  A text is posted under ``size // 20`` more than
  these; texts of a list of up to 32 meet pairwise.
* A pair whose shared first shingles and remaining ones together can't reach 0.8 is dropped before texts are read.
* A pair that meets in no such list shares longer lists only, one more than the smaller text's ``size // 20``.  A text in fewer of them leaves
  them all: texts with one passage in common share few of their first shingles.  Lists that are short then meet pairwise too.
* A list that is still longer isn't compared pairwise.  It elects a chief, and each text of it is told by its delta: the shingles that one of the two
  has and the other lacks.  Two sets differ in as many shingles as their deltas do, so a pair is linked for certain
  where both deltas are short, and then both are linked to the text whose delta is shortest for its size: one link a text.
  All are compared with some of them.  Texts that still are not in the component of most (outer ones)
  need a partner with a good part of their delta in common: a second prefix index over the deltas, rarest shingles
  first, finds all of those that are not in one component yet.  Deltas of linked texts differ in a quarter of the size at most, so a
  text is posted under ``size // 4 + 1`` shingles at most, however far it is from the chief.  Which are rare is told by one delta in ``DELTAS``.

The samples decide on an order, never on a link.  Work is linear in the postings but for texts that are made of common passages
in ever other choice, which meet pairwise.

Words are lower-cased as bytes; a text of fewer words than five is one shingle; texts without words are
alike; texts of any length are read whole; repeated rows and shared ids count as rows of one set; a row with a null id stays only
if its whole component has none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash_dedup
from .common import bytes_of, discard, map_batches, raw_key, staged, tidy, written
from .components import components

WIDTH = 5
SEED = 42
#: Lists up to this length are compared pairwise.
SHORT_LIST = 32
#: One shingle in so many is posted beyond those of which two near sets share one.
MORE = 20
#: Texts, and repeated shingles of them, that the order of shingles is made of.
SAMPLE_TEXTS = 10_000
SAMPLE_SHINGLES = 1 << 17
#: Texts of a chief that all its texts are compared with.
STARS = 64
#: Of so many deltas one is drawn for the order of their shingles.
DELTAS = 8
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; none without words."""
    return np.unique(simhash_dedup.shingle_hashes(text, width).view(np.int64))


def similar(shared: Column, one: Column, two: Column) -> Column:
    """Jaccard similarity 0.8 or more, in whole numbers."""
    return 9 * shared >= 4 * (one + two)


def n_first(size: int) -> int:
    """Of how many first shingles a set is posted under."""
    return size // 5 + 1 + size // MORE


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and in how many; at most ``SAMPLE_SHINGLES``."""
    step = max(1, docs.count() // SAMPLE_TEXTS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in bytes_of(batch.column("text"))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["key"])

    drawn = docs.select(F.col(text_col).alias("text")).where(F.pmod(raw_key("text"), F.lit(step)) == 0).dropDuplicates(["text"])
    return _most(map_batches(drawn, run, "key long"))


def _most(drawn: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The repeated ones of ``key``, sorted, and how often they are there; at most ``SAMPLE_SHINGLES``, of those most often there."""
    counts = drawn.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n")).limit(SAMPLE_SHINGLES).toArrow()
    keys, n = (np.asarray(found.column(c).combine_chunks(), np.int64) for c in ("key", "n"))
    at = np.argsort(keys)
    return keys[at], n[at]


def rare_first(one: np.ndarray, common: tuple[np.ndarray, np.ndarray], chief: int = 0) -> np.ndarray:
    """A sorted set in order: uncommon shingles by hash, then common ones by number and hash; of a delta, those common among its chief's."""
    keys, n = common
    if not len(one) or not len(keys):
        return one
    told = one ^ chief
    place = np.minimum(np.searchsorted(keys, told), len(keys) - 1)
    return one[np.argsort(np.where(keys[place] == told, n[place], 0), kind="stable")]


def first_shingles(one: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first :func:`n_first` shingles of a sorted set."""
    return rare_first(one, common)[: n_first(len(one))]


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``raw``, ``node`` (hash of the shingle set), ``print`` (SimHash), ``size`` and ``first`` of every row; no text."""
    common = common_shingles(docs, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [simhash_dedup.shingle_hashes(t, WIDTH) for t in bytes_of(batch.column("text"))]
        prints = np.array([simhash_dedup.vote(h) for h in hashes], np.uint64).view(np.int64)
        sets = [np.unique(h.view(np.int64)) for h in hashes]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        first = pa.array([first_shingles(s, common) for s in sets], pa.list_(pa.int64()))
        columns = [pa.array(node), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), first]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), *columns], ["id", "raw", "node", "print", "size", "first"])

    source = docs.select(F.col(id_col).alias("id"), raw_key(text_col).alias("raw"), F.col(text_col).alias("text"))
    return map_batches(source, run, f"id {source.schema['id'].dataType.simpleString()}, raw long, node long, print long, size long, first array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``node`` and ``all`` (its whole shingle set) of the texts named by ``wanted(raw, node)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in bytes_of(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "all"])

    source = docs.select(raw_key(text_col).alias("raw"), F.col(text_col).alias("text")).join(wanted, "raw").select("node", "text")
    # copies of one text give equal sets
    return map_batches(source, run, "node long, all array<long>").dropDuplicates(["node"])


def by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes whose SimHash is the same or linked: each print's least node stands for it."""
    prints = staged(nodes.groupBy("print").agg(F.min("node").alias("chief"), F.count("*").alias("n")), "prints")
    found = simhash_dedup.links(prints.select("print"))
    one = prints.select(F.col("print").alias("a"), F.col("chief").alias("one"))
    two = prints.select(F.col("print").alias("b"), F.col("chief").alias("two"))
    linked = found.join(one, "a").join(two, "b").select("one", "two")
    same = nodes.join(prints.where("n > 1"), "print").where("node != chief").select(F.col("chief").alias("one"), F.col("node").alias("two"))
    return linked.union(same).select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))


def _near(one: str, two: str) -> Column:
    return (F.col(one) * 5 >= F.col(two) * 4) & (F.col(two) * 5 >= F.col(one) * 4)


def _met(posts: DataFrame, limit: int) -> DataFrame:
    """From ``node``, ``size``, ``key``: pairs ``a``, ``b`` of lists of up to ``limit`` nodes; ``key``, ``node`` of longer lists as entries ``a``, ``b``."""
    lists = posts.select("key", "node", "size").repartition("key").sortWithinPartitions("key", "node")

    def split(key, node, size, known):
        starts, length = simhash_dedup._runs(key)
        long = np.repeat((length > limit) | np.isin(key[starts], [k for k in known if k is not None]), length)
        found = [(key[long], node[long], True)]
        key, node, size = key[~long], node[~long], size[~long]
        for one, two in simhash_dedup._neighbours(*simhash_dedup._runs(key), limit):
            near = (size[one] * 5 >= size[two] * 4) & (size[two] * 5 >= size[one] * 4)
            found.append((node[one[near]], node[two[near]], False))
        for a, b, entry in found:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), entry))], ["a", "b", "entry"])

    def run(batches):
        columns, passing, last = [np.zeros(0, np.int64)] * 3, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, size = (np.asarray(c, np.int64) for c in batch.columns)
            # rows of equal sets have one posting
            fresh = np.append(last != (key[0], node[0]), (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            last = (key[-1], node[-1])
            columns = [np.concatenate((c, x[fresh])) for c, x in zip(columns, (key, node, size), strict=True)]
            key = columns[0]
            if not len(key):
                continue
            # the last list may go on in the next batch; once it is long, its entries need not wait
            whole, before = int(np.searchsorted(key, key[-1])), passing
            if len(key) - whole > limit or key[-1] == passing:
                whole, passing = len(key), key[-1]
            yield from split(*(c[:whole] for c in columns), (before, passing))
            columns = [c[whole:] for c in columns]
        if len(columns[0]):
            yield from split(*columns, (passing,))

    return lists.mapInArrow(tidy(run), "a long, b long, entry boolean")


def _plausible(pairs: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """``a``, ``b`` and their sizes, of pairs that can reach similarity 0.8.

    A pair shares its short lists (``n`` of them), at most as many long ones as the text with fewer has, and else only
    what one of the two has behind its first shingles.
    """
    sizes = nodes.select("node", "size").join(entries.groupBy("node").agg(F.count("*").alias("long")), "node", "left")
    sizes = staged(sizes.select("node", F.struct("size", F.coalesce("long", F.lit(0)).alias("long"), (F.col("size") - F.floor(F.col("size") / 5) - 1 - F.floor(F.col("size") / MORE)).alias("rest")).alias("of")), "sizes")
    both = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = both.join(sizes.select(F.col("node").alias("a"), F.col("of").alias("one")), "a").join(sizes.select(F.col("node").alias("b"), F.col("of").alias("two")), "b")
    most = F.col("n") + F.least("one.long", "two.long") + F.greatest("one.rest", "two.rest")
    good = both.where(_near("one.size", "two.size") & similar(most, F.col("one.size"), F.col("two.size")))
    return good.select("a", "b", F.col("one.size").alias("a_size"), F.col("two.size").alias("b_size"))


def _lasting(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key``, ``node``, ``size`` of the entries whose text is in enough of these lists to have a partner that it meets in no other.

    A partner has four fifths of its size at least, and shares one shingle more than the smaller text is posted under beyond the guaranteed.
    """
    least = F.floor(F.floor((4 * F.col("size") + 4) / 5) / MORE) + 1
    able = entries.groupBy("node").agg(F.count("*").alias("n")).join(nodes.select("node", "size"), "node").where(F.col("n") >= least)
    return entries.join(able.select("node", "size"), "node").select("key", "node", "size")


def _elected(entries: DataFrame) -> DataFrame:
    """``chief`` and ``node`` of long lists: each list's elected text with all texts of the list, itself included."""
    one = F.struct(F.xxhash64("node").alias("draw"), F.col("node").alias("chief"))
    chiefs = entries.groupBy("key").agg(F.min(one)["chief"].alias("chief"))
    return entries.join(chiefs, "key").select("chief", "node").distinct()


def _deltas(elected: DataFrame, whole: DataFrame) -> DataFrame:
    """``chief``, ``node``, ``size``, ``delta`` and ``far``: nine times the delta's length less the size.

    Two sets are linked if nine times the length of what their deltas don't share is at most the sum of their
    sizes: if their ``far`` is at most 18 times what the deltas share.
    """
    own = whole.select("node", "all")
    chief = whole.select(F.col("node").alias("chief"), F.col("all").alias("c_all"))
    both = elected.join(own, "node").join(chief, "chief")
    delta = F.concat(F.array_except("all", "c_all"), F.array_except("c_all", "all"))
    found = both.select("chief", "node", F.size("all").cast("long").alias("size"), delta.alias("delta"))
    return found.withColumn("far", 9 * F.size("delta").cast("long") - F.col("size"))


def _linked(a: str, b: str) -> Column:
    """Whether two texts of one chief are linked, told by structs with ``size`` and ``delta``."""
    shared = F.size(F.array_intersect(f"{a}.delta", f"{b}.delta"))
    return 9 * (F.size(f"{a}.delta") + F.size(f"{b}.delta") - 2 * shared) <= F.col(f"{a}.size") + F.col(f"{b}.size")


def certain_links(deltas: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that need no shared delta: both ends of any such pair are linked to the node of least ``far``."""
    nearest = deltas.groupBy("chief").agg(F.min(F.struct("far", "node")).alias("best"))
    found = deltas.join(nearest, "chief").where((F.col("far") + F.col("best.far") <= 0) & (F.col("node") != F.col("best.node")))
    return found.select(F.col("node").alias("a"), F.col("best.node").alias("b"))


def sided(deltas: DataFrame, roots: DataFrame) -> DataFrame:
    """The deltas with each node's ``root`` so far, and ``outer``: it is not the root that most texts of the chief have."""
    rooted = deltas.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = rooted.groupBy("chief", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("chief").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    return rooted.join(main, "chief").withColumn("outer", F.col("root") != F.col("main")).drop("main")


def star_links(known: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` of the texts of each chief with outer ones with up to ``STARS`` of them, of another root."""
    text = F.struct("node", "root", "size", "delta")
    draw = F.struct(F.xxhash64("node").alias("draw"), text.alias("two"))
    mixed = known.join(known.where("outer").select("chief").distinct(), "chief", "left_semi")
    stars = mixed.groupBy("chief", F.pmod(F.xxhash64("node"), F.lit(STARS)).alias("lot")).agg(F.min(draw)["two"].alias("two"))
    met = mixed.select("chief", text.alias("one")).join(stars, "chief").where((F.col("one.root") != F.col("two.root")) & _linked("one", "two"))
    return met.select(F.col("one.node").alias("a"), F.col("two.node").alias("b"))


def common_of_chiefs(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of one chief's drawn deltas have, told by ``chief ^ shingle`` and sorted, and in how many; at most ``SAMPLE_SHINGLES``."""
    drawn = known.where(F.pmod(F.xxhash64("node"), F.lit(DELTAS)) == 0)
    return _most(drawn.select("chief", F.explode("delta").alias("key")).select(F.col("chief").bitwiseXOR(F.col("key")).alias("key")))


def outer_posts(known: DataFrame) -> DataFrame:
    """The second prefix index: ``chief``, ``key`` and the text, of chiefs with outer ones; ``left``: how many of its delta are left from the key on.

    Linked nodes of two roots share one eighteenth of the sum of both ``far`` at least, and one shingle at least, as
    certain links have been drawn before.  Their deltas differ in as many shingles as their sets do: a ninth of both sizes at most,
    so a quarter of either.  ``inner``: the key will do for a partner that is outer.
    """
    least = known.groupBy("chief").agg(F.min("far").alias("inside"), F.min(F.when(F.col("outer"), F.col("far"))).alias("outside"))
    # chiefs with outer nodes only; the least that a partner may have
    known = known.join(least.where("outside IS NOT NULL"), "chief")

    def first(least: str) -> Column:
        shared = F.ceil((F.col("far") + F.col(least)) / 18)
        return F.least(F.size("delta") - F.greatest(shared, F.lit(1)), F.floor(F.col("size") / 4)) + 1

    common = common_of_chiefs(known)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        *columns, first, deltas = batch.columns
        chiefs = np.asarray(columns[0], np.int64)
        keys = [rare_first(np.sort(np.asarray(d.values, np.int64)), common, c)[:n] for d, c, n in zip(deltas, chiefs, first.to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names[:-2], "keys"])

    sized = known.withColumn("inner_first", first("outside")).withColumn("first", F.when(F.col("outer"), first("inside")).otherwise(F.col("inner_first")))
    posted = sized.where("first > 0").select("chief", "node", "root", "size", "far", "outer", F.size("delta").cast("long").alias("length"), F.col("inner_first").cast("long"), F.col("first").cast("long"), "delta")
    posts = map_batches(posted, run, "chief long, node long, root long, size long, far long, outer boolean, length long, inner_first long, keys array<long>")
    placed = posts.select("chief", "node", "root", "size", "far", "outer", "length", "inner_first", F.posexplode("keys").alias("place", "key"))
    return placed.select("chief", "key", "node", "root", "size", "far", "outer", (F.col("length") - F.col("place")).alias("left"), (F.col("place") < F.col("inner_first")).alias("inner"))


def outer_pairs(known: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that may be linked, of two roots, so that one node at least is outer."""
    placed = staged(outer_posts(known), "placed")
    one = placed.where("outer").select("chief", "key", F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("size").alias("a_size"), F.col("inner").alias("a_inner"), F.col("far").alias("a_far"), F.col("left").alias("a_left"))
    two = placed.where("inner").select("chief", "key", F.col("node").alias("b"), F.col("root").alias("b_root"), F.col("size").alias("b_size"), F.col("outer").alias("b_outer"), F.col("far").alias("b_far"), F.col("left").alias("b_left"))
    # of two outer nodes both keys are inner, and one of the two rows will do
    once = ~F.col("b_outer") | (F.col("a_inner") & (F.col("a") < F.col("b")))
    # from the first shared key on, both have to have as many as the pair must share
    enough = 18 * F.least("a_left", "b_left") >= F.col("a_far") + F.col("b_far")
    meet = one.join(two, ["chief", "key"]).where(enough & (F.col("a_root") != F.col("b_root")) & once & _near("a_size", "b_size"))
    return meet.select("chief", "a", "b").distinct()


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Each written table's shuffle files go when it is there, not only when the driver's JVM collects its garbage."""
    before = spark.conf.get(SHUFFLES_END)
    spark.conf.set(SHUFFLES_END, True)
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_END, before)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHORT_LIST) -> DataFrame:
    """The elected row of each component, ``id`` and ``raw``: smallest id, then smallest raw hash; nulls last."""
    spark = docs.sparkSession
    with _shuffles_end(spark):
        prints, prints_at = written(_prints(docs, id_col, text_col), "shingles")
        least = F.struct(F.col("id").isNull().alias("none"), "id", "raw")
        nodes = staged(prints.groupBy("node").agg(F.min(least).alias("least"), F.min("raw").alias("raw"), F.min("print").alias("print"), F.min("size").alias("size")), "sets")
        met, met_at = written(_met(prints.select("node", "size", F.explode("first").alias("key")), limit), "lists")
        discard(spark, prints_at)
        entries = met.where("entry").select(F.col("a").alias("key"), F.col("b").alias("node"))
        again = staged(_met(_lasting(entries, nodes), limit), "again")
        held = again.where("entry").select(F.col("a").alias("key"), F.col("b").alias("node"))
        shared = met.where("NOT entry").union(again.where("NOT entry")).select("a", "b", F.lit(1).alias("n")).union(by_simhash(nodes).distinct().select("a", "b", F.lit(0)))
        pairs = staged(_plausible(shared, nodes, entries), "pairs")
        elected = staged(_elected(_lasting(held, nodes)), "elected")
        discard(spark, met_at)
        named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(elected.select("node")).distinct()
        whole, whole_at = written(_sets(docs, nodes.join(named, "node").select("raw", "node"), text_col), "whole")
        deltas, deltas_at = written(_deltas(elected, whole), "deltas")
        checked = pairs.join(whole.select(F.col("node").alias("a"), F.col("all").alias("a_all")), "a").join(whole.select(F.col("node").alias("b"), F.col("all").alias("b_all")), "b")
        links = checked.where(similar(F.size(F.array_intersect("a_all", "b_all")), F.col("a_size"), F.col("b_size"))).select("a", "b")
        links = staged(links.union(certain_links(deltas)), "links")
        discard(spark, whole_at)
        links = links.union(staged(star_links(sided(deltas, components(links))), "stars"))
        known = staged(sided(deltas, components(links)), "sided")
        one = known.select("chief", F.col("node").alias("a"), F.struct("size", "delta").alias("one"))
        two = known.select("chief", F.col("node").alias("b"), F.struct("size", "delta").alias("two"))
        last = outer_pairs(known).join(one, ["chief", "a"]).join(two, ["chief", "b"]).where(_linked("one", "two")).select("a", "b")
        found = components(links.union(staged(last, "last"))).withColumnRenamed("node", "member")
        discard(spark, deltas_at)
        rooted = nodes.join(found, nodes["node"] == found["member"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        return rooted.groupBy("root").agg(F.min("least").alias("first")).select("first.id", "first.raw")
