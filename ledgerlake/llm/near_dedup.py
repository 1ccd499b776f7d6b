"""Near-duplicate documents by HyperMinHash bands, an estimate from the registers, and a check on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hyperminhash as hmh
from .common import read_table, written
from .components import connected_components
from .shingles import WordHashes, shingle_set

#: Links hold from this similarity on, as a ratio of whole numbers.
PART, WHOLE = 75, 100
#: Nodes up to this many bytes of ids are broadcast to pick their texts; beyond it the texts are shuffled.
BROADCAST_BYTES = 32_000_000


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        n, digest, regs = [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py(), hashes)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            regs.append(hmh.registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "digest", "regs"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        keys = np.concatenate([hmh.band_keys(np.frombuffer(x.as_py(), np.uint16)) for x in batch.column(2)])
        rows = pa.array(np.repeat(np.arange(len(batch)), hmh.BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(rows), batch.column(1).take(rows)], ["key", "node", "n"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingle_set(x.as_py(), hashes).tobytes() for x in batch.column(1)]
        digests = [xxhash.xxh3_128_digest(x) for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["node", "digest", "members"])


def _verify(least: float):
    """Of pairs with registers and sets, those whose estimate may reach `least`, with the true sizes."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b, regs_a, regs_b, sets_a, sets_b = (batch.column(i) for i in range(6))
            n, m = (np.array([len(x.as_buffer()) // 8 for x in s]) for s in (sets_a, sets_b))
            agree = np.array([(np.frombuffer(x.as_buffer(), np.uint16) == np.frombuffer(y.as_buffer(), np.uint16)).sum() for x, y in zip(regs_a, regs_b, strict=True)])
            keep = np.flatnonzero(hmh.may_reach(agree, n, m, least))
            both = np.zeros(len(batch), np.int64)
            for i in keep:
                x, y = (np.frombuffer(s[int(i)].as_buffer(), np.uint64) for s in (sets_a, sets_b))
                both[i] = len(np.intersect1d(x, y, assume_unique=True))
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.take(kept), b.take(kept), pa.array(both[keep]), pa.array((n + m - both)[keep])], ["a", "b", "both", "either"])

    return check


def _shingles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(len(batch)):  # a set at a time: sets may be large
            s = np.frombuffer(batch.column(2)[at].as_buffer(), np.int64)
            rows = pa.array(np.zeros(len(s), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(0).slice(at, 1).take(rows), batch.column(1).slice(at, 1).take(rows)], ["shingle", "node", "cluster"])


def _compare_blocks(table: pa.Table) -> pa.Table:
    """Links from members of a block of the first side to members of a block of the second that are in other clusters;
    for each member of the first one link to each cluster at most."""
    node, side, cluster = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "side", "cluster"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members").combine_chunks()]
    sizes = np.array([len(s) for s in sets])
    first, second = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    kind = table.schema.field("node").type
    if not len(first) or not len(second):
        return pa.table({"a": pa.array([], kind), "b": pa.array([], kind)})
    tokens = np.concatenate([sets[i] for i in second])
    owner = np.repeat(np.arange(len(second)), sizes[second])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    found_a, found_b = [], []
    for i in first:
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        width = hi - lo
        at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
        both = np.bincount(owner[at], minlength=len(second))
        link = np.flatnonzero((WHOLE * both >= PART * (sizes[i] + sizes[second] - both)) & (cluster[second] != cluster[i]))
        if len(link):
            _, one = np.unique(cluster[second][link], return_index=True)
            found_a += [node[i]] * len(one)
            found_b += list(node[second[link[one]]])
    return pa.table({"a": pa.array(found_a, kind), "b": pa.array(found_b, kind)})


#: A block of a family has about so many members, and so many shingles, at most.
BLOCK_MEMBERS, BLOCK_SHINGLES = 400, 400_000


def _links_between_clusters(groups: DataFrame, clusters: DataFrame, candidates: DataFrame, id_type: str) -> DataFrame:
    """Links (a, b) between members of a band group that are in different clusters (step 5 of near_duplicates)."""
    placed = groups.join(clusters, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("cluster"))
    # in a group of two, both have been compared
    several = placed.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count(F.lit(1)).alias("rows")).where("low <> high and rows > 2").select("key")
    unsure = written(placed.join(several, "key", "left_semi"), "unsure")
    members = unsure.select("node", "n", "cluster").distinct().join(candidates.select("node", "members"), "node").select("node", "cluster", "members")
    shingles = members.mapInArrow(_shingles_of, f"shingle long, node {id_type}, cluster {id_type}")
    common = shingles.groupBy("shingle").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low <> high").select("shingle")
    usable = shingles.join(common, "shingle", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("usable"))
    able = written(unsure.select("node", "n", "cluster").distinct().join(usable, "node").where(WHOLE * F.col("usable") >= PART * F.col("n")).select("node", "n", "cluster"), "able")
    ties = unsure.join(able.select("node"), "node", "left_semi")
    hubs = ties.groupBy("key").agg(F.min("node").alias("a"))
    family = connected_components(ties.join(hubs, "key").select("a", F.col("node").alias("b")).distinct(), "families").withColumnRenamed("component", "family")
    of_family = able.join(family, "node")
    # links within a family's largest cluster are of no use, so its members are on the second side alone
    by_cluster = of_family.groupBy("family", "cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = lambda members, shingles: F.greatest(F.ceil(members / BLOCK_MEMBERS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = (
        by_cluster.groupBy("family")
        .agg(F.count(F.lit(1)).alias("clusters"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), F.max(F.struct("members", "cluster", "shingles")).alias("largest"))
        .where("clusters > 1")
        .select("family", F.col("largest.cluster").alias("largest"), blocks(F.col("members") - F.col("largest.members"), F.col("shingles") - F.col("largest.shingles")).alias("firsts"), blocks(F.col("members"), F.col("shingles")).alias("seconds"))
    )
    dealt = of_family.join(sizes, "family")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = dealt.where("cluster <> largest").select("family", block("firsts").alias("i"), to_all("seconds").alias("j"), F.lit(1).alias("side"), "node", "cluster")
    second = dealt.select("family", to_all("firsts").alias("i"), block("seconds").alias("j"), F.lit(2).alias("side"), "node", "cluster")
    pairs = first.unionByName(second).join(candidates.select("node", "members"), "node")
    return written(pairs.groupBy("family", "i", "j").applyInArrow(_compare_blocks, f"a {id_type}, b {id_type}"), "between")


#: Members of one centre that are compared with one copy of its set.
MEMBERS_A_COPY = 2000


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.75 or more;
    component_id is the smallest id that can be reached over links, and kept says whether it is the row's own.

    1. Each text becomes a set of shingle hashes; the set's size, digest and HyperMinHash registers are written.
    2. Rows of equal sets form a class, whose node is its smallest id. From here on only classes count, so a group of
       exact copies of any size is one node.
    3. Each class has 64 band keys of 5 registers. Two sets of similarity 0.75 miss every common band once in 10^7
       or less. Keys that several classes share are kept, each with its smallest node as its centre.
    4. Every member is compared with its centres: by sizes, large sets by the estimate from their registers too, which
       loses a link once in 10^9, then on full sets. Confirmed links give clusters.
    5. What can still be linked lies in one band group but in different clusters. Of a link's two sets, three
       quarters of each are shingles that both clusters have: members with fewer such shingles go. What remains of a
       family (groups that share members) is dealt into blocks of bounded size: members outside its largest cluster
       are compared with all, so work grows with their number times the family's. No pair within a cluster is
       emitted, none is unless it is a link, and no link between clusters of a band group is lost.
    6. Components of all confirmed links.

    Null or wordless texts have no shingles: n_shingles 0, linked with nothing. Rows with equal ids count as one
    node. A row with a null id belongs to the class of its set; if no row of that class has an id, component_id and
    kept are null and false. Empty tables give no rows. Other columns of docs are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    sketches = written(own.mapInArrow(_sketch, f"id {id_type}, n long, digest binary, regs binary"), "sketches")
    classes = written(
        sketches.where("n > 0").groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")),
        "classes",
    )
    nodes = classes.where("node is not null")
    bands = nodes.select("node", "n", "regs").mapInArrow(_bands, f"key long, node {id_type}, n long")
    shared = bands.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last").drop("last")
    groups = written(bands.join(shared, "key"), "groups")
    members = groups.select("node").distinct()
    if _is_small(members):
        members = F.broadcast(members)
    candidates = written(
        own.join(members, F.col("id") == F.col("node"), "left_semi")
        .mapInArrow(_sets, f"node {id_type}, digest binary, members binary")
        .dropDuplicates(["node", "digest"])
        .join(nodes.select("node", "digest", "regs"), ["node", "digest"])
        .select("node", "regs", "members"),
        "candidates",
    )

    def verified(pairs: DataFrame, least: float, name: str) -> DataFrame:
        # a centre of many members is dealt over copies of its set, so that it is sent once a copy and not once a member
        copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_A_COPY).cast("int").alias("copies"))
        dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy"))
        left = candidates.join(copies, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("regs").alias("regs_a"), F.col("members").alias("set_a"))
        right = candidates.select(F.col("node").alias("b"), F.col("regs").alias("regs_b"), F.col("members").alias("set_b"))
        full = dealt.join(right, "b").join(left, ["a", "copy"]).select("a", "b", "regs_a", "regs_b", "set_a", "set_b")
        return written(full.mapInArrow(_verify(least), f"a {id_type}, b {id_type}, both long, either long"), name)

    linked = WHOLE * F.col("both") >= PART * F.col("either")
    stars = verified(groups.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), PART / WHOLE, "stars")
    first = stars.where(linked).select("a", "b")
    clusters = connected_components(first, "clusters")

    rest = _links_between_clusters(groups, clusters, candidates, id_type)
    components = connected_components(first.unionByName(rest), "components")
    of_class = classes.select("digest", "node").join(components, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return (
        sketches.select("id", "n", "digest").join(of_class.where("component_id is not null"), "digest", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates, the one with the smallest id, and all its columns.

    Rows with one id stay or go together, but rows that repeat an id and a text stay once. Rows with a null id stay
    unless their text has words and is exactly a text of a row with an id, and equal ones of them stay once. Texts
    without words, null ones among them, always stay.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = written(found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.bool_or("kept").alias("kept")).where("not kept").select(id_col), "gone")
    named = docs.where(F.col(id_col).isNotNull())
    out = named.join(F.broadcast(gone) if _is_small(gone) else gone, id_col, "left_anti").select(docs.columns)
    repeated = named.groupBy(id_col).count().where("count > 1").select(id_col)
    if not repeated.isEmpty():
        once = out.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col]).select(docs.columns)
        out = out.join(repeated, id_col, "left_anti").select(docs.columns).unionByName(once)
    nameless = docs.where(F.col(id_col).isNull())
    if not nameless.isEmpty():
        worded = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        rest = nameless.where(worded).join(named.select(text_col), text_col, "left_anti").dropDuplicates([text_col]).select(docs.columns)
        out = out.unionByName(rest).unionByName(nameless.where(~worded))
    return out


def _is_small(ids: DataFrame) -> bool:
    width = F.coalesce(F.length(F.col(ids.columns[0]).cast("string")), F.lit(0)) + 8
    return (ids.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES = {}
