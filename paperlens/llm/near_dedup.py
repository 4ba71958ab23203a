"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find grouping.

1. Each text becomes its set of word shingles (64-bit hashes). SuperMinHash gives each element a random permutation of the
   signature's slots and offers, in round j, the value j + random to slot p(j): the ranks of one element are correlated,
   which lowers the variance, and once every slot has a value of an earlier round the document is done (early stopping).
2. Texts with equal sets collapse to their smallest id. Signatures are cut into bands; the number of bands follows from
   the threshold so that a pair at the threshold is missed with a chance below one in a million. A bucket's hub is its
   smallest id, and all buckets of one hub are one group: a group holds every pair of its buckets.
3. Star rounds: each member is held against one hub, that whose two-bit sketch agrees best (five standard deviations of
   slack), on full sets; in the next round, members outside their hub's component against one more hub of their groups.
   That is one pair a document and round, however large a group is. Confirmed links join components (alternating
   large-star and small-star rounds over tables).
4. Groups that still hold several components are compared as a whole, on full sets: groups are dealt out in blocks of
   bounded size, and a task holds two blocks against each other, element by element in one array operation a document. It
   compares only members of different components and returns links that join two, fewer than it has rows: no pairs are
   listed. Groups that share many members meet as one, where that makes fewer comparisons.

Texts that are null, empty or without words have an empty set and are linked with nothing; a text of fewer words than a
shingle is one element. Texts of any length are taken whole. Rows that share an id are one node with the links of each. Rows
with a null id are linked with nothing, get a null component and are kept. Clashing columns of the input are not carried over.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from paperlens.llm.common import bounded, discard, held, small, stored

#: Cached words, and the longest word that is cached, in bytes.
CACHE_WORDS, CACHE_WORD_BYTES = 100_000, 64
#: Documents and elements that are signed at once.
SIGN_DOCS, SIGN_ELEMENTS = 2_000, 300_000
#: Chance that banding misses a pair at the threshold; slack of the sketch in standard deviations.
MISS, SLACK_DEVIATIONS = 1e-6, 5.0
#: Rounds in which each member meets one hub.
STAR_ROUNDS = 2
#: Documents that meet one copy of a hub, and documents and elements of a block.
HUB_DOCS, BLOCK_DOCS, BLOCK_ELEMENTS = 2_000, 1_000, 1_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; words are runs without ASCII white space, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, "uint64")
    h = np.fromiter(map(held("word hashes", _WordHashes).__getitem__, words), "uint64", len(words))
    size = min(k, len(h))
    out = np.full(len(h) - size + 1, size, "uint64")
    for i in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def superminhash(elements: np.ndarray, docs: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m, uint64: the round in the top 16 bits, the random part below) of documents given as flat elements."""
    sig = np.full(n_docs * m, EMPTY)
    e, d = elements, docs.astype("int64")
    swaps: list[np.ndarray] = []
    for j in range(m):
        rnd = _mix(e + np.uint64((j + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        swap = (j + (rnd >> np.uint64(40)) % np.uint64(m - j)).astype("int16")
        slot = swap.copy()
        for i in range(j - 1, -1, -1):  # follow the earlier swaps of the Fisher-Yates shuffle back
            np.copyto(slot, np.int16(i), where=slot == swaps[i])
        value = np.uint64(j << 48) | (_mix(rnd ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(16))
        np.minimum.at(sig, d * m + slot, value)
        swaps.append(swap)
        open_ = (sig.reshape(n_docs, m) == EMPTY).any(axis=1)
        keep = open_[d]
        if not keep.any():
            break
        if not keep.all():
            e, d, swaps = e[keep], d[keep], [s[keep] for s in swaps]
    return sig.reshape(n_docs, m)


def plan_bands(percent: int) -> tuple[int, int]:
    """Rows a band and bands for a threshold in percent."""
    t = percent / 100
    rows = 6 if t >= 0.85 else 5 if t >= 0.75 else 4 if t >= 0.65 else 3
    return rows, math.ceil(math.log(MISS) / math.log(1 - t**rows)) if t < 1 else 1


def signatures(df: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, set_id (hash of the full set), bands array<long>, sketch array<long>; the last three null without words."""
    rows, bands = plan_bands(percent)
    m = rows * bands
    longs = math.ceil(m / 32)

    def sign(sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate([*sets, np.empty(0, "uint64")])
        sig = superminhash(flat, np.repeat(np.arange(len(sets)), sizes), len(sets), m)
        mixed = _mix(sig)
        out = np.zeros((len(sets), bands), "uint64")
        for r in range(rows):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + mixed[:, r::rows])
        out = _mix(out + np.arange(bands, dtype="uint64") * np.uint64(0xD1342543DE82EF95))
        two = np.zeros((len(sets), longs * 32), "uint64")
        two[:, :m] = mixed & np.uint64(3)
        sketch = (two.reshape(len(sets), longs, 32) << (np.arange(32, dtype="uint64") * np.uint64(2))).sum(axis=2, dtype="uint64")
        return out.view("int64"), sketch.view("int64")

    def lists(rows_: np.ndarray, valid: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(np.where(valid, rows_.shape[1], 0))]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows_[valid].ravel()), mask=pa.array(~valid))

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            first = 0
            while first < len(texts):
                sets, total = [], 0
                while first + len(sets) < len(texts) and len(sets) < SIGN_DOCS and total < SIGN_ELEMENTS:
                    sets.append(shingle_set(texts[first + len(sets)], k))
                    total += len(sets[-1])
                n = len(sets)
                out, sketch = sign(sets)
                valid = np.array([len(s) > 0 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        lists(out, valid),
                        lists(sketch, valid),
                    ],
                    [key, "n_shingles", "set_id", "bands", "sketch"],
                )
                first += n

    array = T.ArrayType(T.LongType())
    schema = T.StructType([df.schema[key], T.StructField("n_shingles", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("bands", array), T.StructField("sketch", array)])
    return bounded(df).select(key, text).mapInArrow(work, schema)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """id, n, elements (the full set as 8-byte numbers) of docs: id, text."""

    def work(batches):
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "elements"])

    return bounded(docs).select("id", "text").mapInArrow(work, T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("elements", T.BinaryType())]))


def similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def hubs_apart(stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs with the copy of their hub that they meet, and hub, copies of those with several: one for every HUB_DOCS pairs, so
    that a hub of any number of pairs is no single task."""
    large = stars.groupBy("hub").agg(F.ceil(F.count("*") / HUB_DOCS).cast("int").alias("copies")).where("copies > 1")
    large = small(stored(large, "large-hubs"))
    copy = F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1))).cast("int")
    return stars.join(large, "hub", "left").select(*stars.columns, copy.alias("copy")), large


def copied(hubs: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of hubs: once for each of the hub's copies."""
    return hubs.join(large, "hub", "left").select(*hubs.columns, F.explode(F.expr("sequence(0, coalesce(copies, 1) - 1)")).alias("copy"))


def confirmed(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, hub), as links (a, b), those whose full sets reach the threshold. A hub's set is sent once a copy, not
    with each of its pairs. sets: id, n, elements; ids can repeat."""
    spread, large = hubs_apart(stars)
    members = spread.join(sets.select(F.col("id").alias("a"), "elements"), "a").select("hub", "copy", F.lit(1).alias("part"), "a", "elements")
    hubs = copied(stars.select("hub").distinct(), large).join(sets.select(F.col("id").alias("hub"), "elements"), "hub").select("hub", "copy", F.lit(0).alias("part"), F.col("hub").alias("a"), "elements")
    kind = stars.schema["a"].dataType

    def work(batches):
        at, hub_sets = None, []
        for batch in batches:
            keep = []
            for hub, copy, part, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                own = np.frombuffer(raw, "<u8")
                if (hub, copy) != at:
                    at, hub_sets = (hub, copy), []
                if part == 0:
                    hub_sets.append(own)
                keep.append(part == 1 and any(similar(len(np.intersect1d(own, h, assume_unique=True)), len(own), len(h), percent) for h in hub_sets))
            found = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(3).cast(to_arrow_type(kind)), found.column(0).cast(to_arrow_type(kind))], ["a", "b"])

    rows = members.unionByName(hubs).repartition("hub", "copy").sortWithinPartitions("hub", "copy", "part")
    return rows.mapInArrow(work, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _runs(batches, keys: int) -> Iterator[pa.Table]:
    """Tables of the rows whose first columns are equal; rows come sorted by them."""
    parts, last = [], None
    for batch in batches:
        marks, first = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True)), 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > first:
                    parts.append(batch.slice(first, i - first))
                if parts:
                    yield pa.Table.from_batches(parts)
                parts, first, last = [], i, mark
        if len(marks) > first:
            parts.append(batch.slice(first))
    if parts:
        yield pa.Table.from_batches(parts)


def joining_links(ids: list, components_: list, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple]:
    """Links between members of different components that join these; sides: 0 and 1 for two blocks, else one block with itself."""
    number = {c: i for i, c in enumerate(dict.fromkeys(components_))}
    label = np.array([number[c] for c in components_])
    size = np.array([len(s) for s in sets])
    dense = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1].ravel(), np.cumsum(size)[:-1])
    mark = np.zeros(max(int(d.max()) for d in dense) + 1, "int32")
    one = not sides.any()
    left, right = (np.arange(len(ids)),) * 2 if one else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
    if not len(left) or not len(right):
        return
    flat, starts = np.concatenate([dense[y] for y in right]), np.concatenate([[0], np.cumsum(size[right])[:-1]])
    for x in left:
        open_ = (label[right] != label[x]) & (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x]))
        if one:
            open_ &= right > x
        at = np.flatnonzero(open_)
        if not len(at):
            continue
        mark[dense[x]] = 1
        common = np.array([mark[dense[y]].sum() for y in right[at]]) if len(at) < 40 else np.add.reduceat(mark[flat], starts)[at]
        mark[dense[x]] = 0
        for y in right[at[similar(common, size[x], size[right[at]], percent)]]:
            if label[y] != label[x]:
                yield ids[x], ids[y]
                label[label == label[y]] = label[x]


def linked_within(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components within groups: meet (the group), id, c (component). sets: id, n, elements."""
    sized = groups.join(sets.select(F.col("id").alias("own"), "n"), F.col("id") == F.col("own")).groupBy("meet").agg(F.count("*").alias("docs"), F.sum("n").alias("elements"))
    blocks = sized.select("meet", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int").alias("blocks"))
    placed = groups.join(blocks, "meet").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.select("meet", F.col("id").alias("dealt"), "c", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("meet", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), F.expr("int(block > other)").alias("side"), "c", "dealt")
    rows = dealt.join(sets.select("id", "elements"), F.col("dealt") == F.col("id")).select("meet", "p", "q", "side", "c", "dealt", "elements")
    kind = groups.schema["id"].dataType

    def work(batches):
        for table in _runs(batches, 3):
            found = list(joining_links(table.column(5).to_pylist(), table.column(4).to_pylist(), np.array(table.column(3).to_pylist()), [np.frombuffer(s, "<u8") for s in table.column(6).to_pylist()], percent))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, to_arrow_type(kind)) for x in zip(*found, strict=True)], ["a", "b"])

    return rows.repartition("meet", "p", "q").sortWithinPartitions("meet", "p", "q").mapInArrow(work, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest reachable id) of all ids in the links (a, b) that are not their own: large-star and small-star rounds until nothing changes."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        old, edges = edges, stored(small.where("u <> v").distinct(), "links")
        discard(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.withColumnsRenamed({"u": "id", "v": "component"})
        before = state


def _mixed(groups: DataFrame, found: DataFrame) -> DataFrame:
    """hub, id, c of the members of groups that hold several components, and main: the component of the hub."""
    placed = groups.join(found.withColumnRenamed("id", "member"), F.col("id") == F.col("member"), "left").select("hub", "id", F.coalesce("component", "id").alias("c"))
    several = placed.groupBy("hub").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(F.expr("CASE WHEN id = hub THEN c END")).alias("main")).where("low <> high")
    return stored(placed.join(several.select("hub", "main"), "hub"), "mixed")


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept of each row; component_id is the smallest id of its group, the one that is kept."""
    signed = stored(signatures(df, k, percent, key, text).withColumnRenamed(key, "id"), "signatures")
    node = F.col("set_id").isNotNull() & F.col("id").isNotNull()
    owners = stored(signed.where(node).groupBy("set_id").agg(F.min("id").alias("owner")), "owners")
    # One row a distinct set. The owner's row is found by its id; repeated rows of one id and set collapse.
    sets = signed.where(node).join(owners, "set_id").where("id = owner").groupBy("id", "set_id").agg(F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    sets = stored(sets.drop("set_id"), "sets")
    m, t = math.prod(plan_bands(percent)), percent / 100
    off = (1 - t) * 0.75  # chance that a slot's two bits differ at the threshold
    most_off = math.ceil(m * off + SLACK_DEVIATIONS * math.sqrt(m * off * (1 - off)))
    bits = [f"(x.sketch[{i}] ^ y.sketch[{i}])" for i in range(math.ceil(m / 32))]
    differing = F.expr(" + ".join(f"bit_count(({b} | shiftrightunsigned({b}, 1)) & 6148914691236517205L)" for b in bits))
    x = sets.select("id", "n", "sketch").alias("x")

    def weighed(stars: DataFrame) -> DataFrame:
        """a, hub, off (differing slots of the sketches), fits (sizes and sketches allow the threshold); a and hub once each."""
        spread, large = hubs_apart(stars)
        sketches = copied(sets.select(F.col("id").alias("hub"), "n", "sketch").join(stars.select("hub").distinct(), "hub", "left_semi"), large).alias("y")
        both = spread.alias("s").join(x, F.expr("s.a = x.id")).join(sketches, F.expr("s.hub = y.hub AND s.copy = y.copy")).select("s.a", "s.hub", differing.alias("off"), F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)").alias("sized"))
        return both.groupBy("a", "hub").agg(F.min("off").alias("off"), F.max(F.expr(f"sized AND off <= {most_off}")).alias("fits"))

    spread = sets.select(F.explode("bands").alias("bucket"), F.col("id").alias("a"))
    shared = spread.groupBy("bucket").agg(F.min("a").alias("hub"), F.max("a").alias("most")).where("hub <> most").select("bucket", "hub")
    stars = weighed(stored(spread.join(shared, "bucket").where("a <> hub").select("a", "hub").distinct(), "pairs"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("fits"), "off", "hub")) == 1
    stars = stored(stars.withColumn("best", best & F.col("fits")), "stars")
    # A group of a hub and one member is settled once their sketches or their full sets have been compared.
    groups = stars.groupBy("hub").agg(F.count("*").alias("others"), F.bool_and(F.expr("best OR NOT fits")).alias("settled")).where("others > 1 OR NOT settled").select("hub")
    groups = stars.select("hub", F.col("a").alias("id")).join(groups, "hub").union(groups.select("hub", F.col("hub").alias("id")))
    groups = stored(groups, "groups")
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    needed = stars.where("best").select(F.explode(F.array("a", "hub")).alias("id")).union(groups.select("id")).distinct()
    full = stored(full_sets(docs.join(small(stored(needed, "needed")), "id", "left_semi"), k), "full-sets")
    links = stored(confirmed(stars.where("best").select("a", "hub"), full, percent), "confirmed")
    # Ids with several sets tie the owners of these together.
    owned = signed.where(node).select("id", "set_id").join(owners, "set_id").select("id", "owner").distinct()
    several = owned.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    links = links.union(owned.join(several, "id", "left_semi").where("id <> owner").select("owner", "id"))
    found = components(links)
    mixed = _mixed(groups, found)
    for turn in range(1, STAR_ROUNDS):
        # Of the members outside the component of their group's hub, one becomes a further hub; the others meet one of these.
        outside = mixed.where("c <> main")
        hubs = outside.groupBy("hub").agg(F.min_by(F.struct("id", "c"), F.xxhash64("id", F.lit(turn))).alias("next"))
        more = outside.join(hubs, "hub").where("c <> next.c").groupBy("id").agg(F.min("next.id").alias("next")).select(F.col("id").alias("a"), F.col("next").alias("hub"))
        late = stored(confirmed(stored(weighed(stored(more, "pairs")).where("fits").select("a", "hub"), "stars"), full, percent), "confirmed")
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(late))
        mixed = _mixed(groups, found)
    # Groups that share members form a cluster. A cluster meets as one where that takes no more comparisons than its groups one by one.
    clusters = components(mixed.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    sizes = mixed.groupBy("hub").agg(F.count("*").alias("n")).join(clusters.select(F.col("id").alias("hub"), "component"), "hub", "left").select("hub", F.expr("n * n").alias("pairs"), F.coalesce("component", "hub").alias("cluster"))
    whole = clusters.groupBy(F.col("component").alias("cluster")).agg((F.count("*") + 1).alias("all"))
    fewer = sizes.groupBy("cluster").agg(F.sum("pairs").alias("pairs")).join(whole, "cluster").where("all * all <= pairs").select("cluster", F.lit(True).alias("whole"))
    meets = sizes.join(fewer, "cluster", "left").select("hub", F.expr("CASE WHEN whole THEN cluster ELSE hub END").alias("meet"))
    meeting = stored(mixed.join(meets, "hub").select("meet", "id", "c").distinct(), "meeting")
    late = stored(linked_within(meeting, full, percent), "joining")
    found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(late))

    groups = owners.join(found.withColumnRenamed("id", "owner"), "owner", "left").select("set_id", F.coalesce("component", "owner").alias("component_id"))
    named = signed.where(node).select("id", "n_shingles", "set_id").join(groups, "set_id").select("id", "n_shingles", "component_id")
    alone = signed.where(~node).join(found, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = named.union(alone)
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
