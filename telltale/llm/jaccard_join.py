"""N-gram Jaccard join: documents as points of group counts in R-trees, joined under a bound of their overlap."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.components import components
from telltale.llm.shared import MULTIPLIER, Scratch, WordIds, free, key, mix, named, small_batches, uid, windows

#: Routing: minima of ROWS permutations make one key, and a link has BANDS chances to share one. Two sets with a
#: Jaccard of 0.85 share none with probability (1 - 0.85**6)**48, about 1e-10.
ROWS, BANDS = 6, 48
#: Coordinates of a point: shingles are hashed into so many groups.
GROUPS = 256
LEAF = 16


def shingles(text: bytes | None, size: int, ids: WordIds) -> np.ndarray:
    """The sorted set of a text's hashed word shingles; a text of fewer words has one, an empty text none."""
    words = ids.array((text or b"").lower().split())
    return np.unique(windows(words, min(size, len(words)))) if len(words) else words


class Routes:
    """Keys of a set: documents that may link share one, with the probability above."""

    def __init__(self):
        rng = np.random.default_rng(20240501)
        self.xor = rng.integers(0, 1 << 32, ROWS * BANDS, np.uint32)
        self.times = rng.integers(0, 1 << 32, ROWS * BANDS, np.uint32) | np.uint32(1)

    def __call__(self, items: np.ndarray) -> np.ndarray:
        low = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
        short = (items >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(short), 1024):
            low = np.minimum(low, ((short[k : k + 1024, None] ^ self.xor) * self.times).min(0))
        keys = np.arange(BANDS, dtype=np.uint64)
        for row in low.astype(np.uint64).reshape(BANDS, ROWS).T:
            keys = mix(keys * MULTIPLIER + row)
        return keys.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, routes = WordIds(), Routes()
        for batch in batches:
            sets = [shingles(t, size, ids) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([routes(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "th", "n", "digest", "keys"],
            )

    return docs.select(key(docs).alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text")).mapInArrow(sign, "doc_id long, th long, n long, digest binary, keys array<long>")


class RTree:
    """A bulk-loaded R-tree: points sorted by halving on the widest coordinate; each node keeps the maxima of its box.

    The overlap of two sets is at most the sum of the lesser of their counts in each group; for a node, the counts of
    its box's upper corner bound every point in it, and its least size bounds what overlap is needed.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.arange(len(points))
        self.points, self.sizes, self.nodes = points, sizes, []
        self.root = self.build(0, len(points))

    def build(self, a: int, b: int) -> int:
        own = self.order[a:b]
        kids: tuple = ()
        if b - a > LEAF:
            box = self.points[own]
            widest = int((box.max(0).astype(np.int64) - box.min(0)).argmax())
            self.order[a:b] = own[np.argsort(box[:, widest], kind="stable")]
            kids = (self.build(a, (a + b) // 2), self.build((a + b) // 2, b))
        self.nodes.append((a, b, self.points[own].max(0), int(self.sizes[own].min()), kids))
        return len(self.nodes) - 1

    def near(self, point: np.ndarray, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose bound allows the similarity, and their bounds."""
        found, todo = [], [self.root]
        while todo:
            a, b, top, least, kids = self.nodes[todo.pop()]
            if (100 + percent) * int(np.minimum(top, point).sum()) >= percent * (size + least):
                if kids:
                    todo += kids
                else:
                    found.append(self.order[a:b])
        at = np.concatenate(found) if found else np.empty(0, int)
        bound = np.minimum(self.points[at], point).sum(1)
        ok = (100 + percent) * bound >= percent * (size + self.sizes[at])
        return at[ok], bound[ok]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def join_tile(ids: list[int], sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked in a tile: pairs already connected through others aren't compared.

    sides: 0 and 1 for the two parts of a tile pair, whose links within a part are found elsewhere; 2 for one part.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.zeros((len(sets), GROUPS), np.int32)
    for k, s in enumerate(sets):
        points[k] = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    tree, part, side, links = RTree(points, sizes), np.arange(len(sets)), np.array(sides), []
    for i in np.argsort(sizes, kind="stable"):
        at, bound = tree.near(points[i], int(sizes[i]), percent)
        fit = (at != i) & (part[at] != part[i]) & ((side[at] != side[i]) | (side[at] == 2))
        at, bound = at[fit], bound[fit]
        at = at[np.argsort(-bound / (sizes[at] + sizes[i]), kind="stable")]
        while len(at):
            j, at = at[0], at[1:]
            if (100 + percent) * overlap(sets[i], sets[j]) >= percent * int(sizes[i] + sizes[j]):
                links.append((ids[i], ids[j]))
                part[part == part[j]] = part[i]
                at = at[part[at] != part[i]]
    return links


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs (cls, low) whose whole sets are alike enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("items").to_pylist(), batch.column("others").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append((100 + percent) * overlap(x, y) >= percent * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select("cls", "items"), "cls").join(sets.select(F.col("cls").alias("low"), F.col("items").alias("others")), "low")
    return both.select(F.col("cls").alias("a"), F.col("low").alias("b"), "items", "others").mapInArrow(compare, "a long, b long")


def tile_jobs(large: DataFrame, connected: DataFrame, tile: int) -> DataFrame:
    """cls, root, job, side: large clusters' classes in all tile pairs whose sizes allow a link, but for tiles of one and the same connected part.

    A part of over tile / 8 classes in a step of sizes has tiles of its own, the others share tiles.
    """
    c = large.join(connected.select(F.col("node").alias("cls"), F.col("root").alias("part")), "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    many = c.groupBy("root", "step", "part").agg(F.count("*").alias("rows")).where(F.col("rows") > tile / 8).select("root", "step", "part", F.lit(True).alias("own"))
    c = c.join(many, ["root", "step", "part"], "left").withColumn("part", F.when(F.col("own"), F.col("part")).otherwise(-1))
    need = F.ceil(F.greatest(F.count("*") / F.lit(tile / 2), F.sum("n") / F.lit(tile * 2000))).cast("int")
    tiles = c.groupBy("root", "step", "part").agg(need.alias("tiles"))
    c = c.join(tiles, ["root", "step", "part"]).withColumn("nth", F.pmod(F.xxhash64("cls"), "tiles"))
    label = lambda step, part, nth: F.concat_ws("/", step, part, nth)
    others = tiles.select("root", F.col("step").alias("step2"), F.col("part").alias("part2"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("nth2"))
    near = c.withColumn("step2", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))).join(others, ["root", "step2"])
    near = near.where((F.col("part") != F.col("part2")) | (F.col("part") == -1)).withColumn("one", label("step", "part", "nth")).withColumn("two", label("step2", "part2", "nth2"))
    return near.select("cls", "root", F.concat_ws(" ", F.least("one", "two"), F.greatest("one", "two")).alias("job"), F.when(F.col("one") == F.col("two"), 2).otherwise((F.col("one") > F.col("two")).cast("int")).alias("side"))


def jaccard_groups(docs: DataFrame, size: int = 4, percent: int = 85, tile: int = 1500) -> DataFrame:
    """doc_id, n_shingles and component_id of linked_rows(), with null doc_ids as they were."""
    return linked_rows(docs, size, percent, tile).select(named("doc_id").alias("doc_id"), "n_shingles", named("component_id").alias("component_id"))


def linked_rows(docs: DataFrame, size: int, percent: int, tile: int = 1500) -> DataFrame:
    """doc_id (never null), th (hash of the text), n_shingles and component_id: the least doc_id that links lead to, for every document.

    Two documents link when 100 * overlap >= percent * union of their sets of word shingles. Equal sets are one class.
    Classes that share a routing key are brought together (as connected clusters, each class once). In a small cluster
    an R-tree of group counts finds the pairs that the overlap bound allows, and their whole sets are compared. In one
    of over `tile` classes (or 4000 times as many shingles) each class is first compared with the least class of each
    of its keys; classes that this connects need not meet again. The others are cut into tiles by size, connection and
    hash, and two tiles are a job with an R-tree if their sizes allow a link and they aren't connected throughout. So
    the copies of one document cost a few comparisons each, however many they are.
    Null and empty texts have no shingles and link with nothing; repeated rows are one class; a null doc_id comes after
    all others; an empty table gives no rows; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    known = scratch.cut(uid(signatures(docs, size)))
    best = known.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "uid")).alias("best"))
    best = best.select("digest", F.col("best.uid").alias("cls"), F.col("best.doc_id").alias("least"))
    members = scratch.cut(known.select("doc_id", "th", "uid", "n", "digest").join(best, "digest", "left"))
    keyed = known.join(members.where("uid = cls").select("uid"), "uid", "left_semi").select(F.col("uid").alias("cls"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("cls").alias("low"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    meet = components(keyed.join(shared, "key").select(F.col("cls").alias("a"), F.col("low").alias("b")), scratch)
    cluster = meet.unionByName(meet.select(F.col("root").alias("node"), "root").distinct())
    inside = members.where("uid = cls").join(cluster, F.col("cls") == F.col("node")).select("cls", "doc_id", "th", "digest", "n", "root")
    # sizes that can link lie in the same or neighbouring steps
    inside = scratch.cut(inside.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / (percent - 0.5)))).cast("int")))
    whole = inside.groupBy("root").agg(((F.count("*") > tile) | (F.sum("n") > tile * 4000)).alias("large"))
    inside = inside.join(whole, "root")
    texts = docs.select(key(docs).alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))

    def remake(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            sets = [shingles(t, size, ids).tobytes() for t in batch.column("text").to_pylist()]
            same = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.select(["cls", "root"]).columns, pa.array(sets, pa.binary())], ["cls", "root", "items"]).filter(same)

    def sets_of(classes: DataFrame) -> DataFrame:
        """cls, root, items: the sets of classes, made again from one text of each (rows that repeat make them repeatedly)."""
        # the same join at every size, so that small tables tell what large ones need
        return texts.join(classes.select("doc_id", "th", "cls", "root", "digest").hint("merge"), ["doc_id", "th"]).select("cls", "root", "digest", "text").mapInArrow(remake, "cls long, root long, items binary")

    rows = sets_of(inside.where("not large")).select("cls", "root", F.lit("").alias("job"), F.lit(2).alias("side"), "items")
    large, starred = inside.where("large"), None
    if not large.isEmpty():
        sets = scratch.cut(sets_of(large).dropDuplicates(["cls"]))
        starred = scratch.cut(star_links(keyed.join(shared, "key").where("cls <> low").select("cls", "low").distinct(), sets, percent))
        rows = rows.unionByName(tile_jobs(large, components(starred, scratch), tile).join(sets.select("cls", "items"), "cls").select("cls", "root", "job", "side", "items"))

    def link(table: pa.Table) -> pa.Table:
        seen = {(c, s): i for c, s, i in zip(*(table.column(x).to_pylist() for x in ("cls", "side", "items")), strict=True)}
        found = join_tile([k[0] for k in seen], [np.frombuffer(i, np.uint64) for i in seen.values()], [k[1] for k in seen], percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    links = rows.groupBy("root", "job").applyInArrow(link, "a long, b long")
    if starred is not None:
        links = links.unionByName(starred)
    scratch.drop(known)  # what the links need of it is written
    linked = components(links, scratch)
    least = members.where("uid = cls").select(F.col("cls").alias("c"), "least")
    tops = linked.join(least, F.col("node") == F.col("c")).groupBy("root").agg(F.min("least").alias("low"))
    tops = tops.join(least, F.col("root") == F.col("c")).select("root", F.least("low", "least").alias("low"))
    named = linked.join(tops, "root").select(F.col("node").alias("c"), "low").unionByName(tops.select(F.col("root").alias("c"), "low"))
    out = members.join(named, F.col("cls") == F.col("c"), "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("low", "least", "doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """docs, all columns (whatever their names), with the document of least doc_id of each group of linked ones.

    A row is found again by doc_id (null like any other, and after all others) and text; rows that repeat both stay or
    go together. Null and empty texts link with nothing and stay; an empty table stays empty.
    """
    doc, text = free(docs, "doc", "th")
    gone = linked_rows(docs, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias(doc), F.col("th").alias(text)).distinct()
    return docs.join(gone, (key(docs) == gone[doc]) & (F.xxhash64(docs["text"]) == gone[text]), "left_anti")
