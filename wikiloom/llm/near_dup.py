"""MinHash near-duplicates (operator 7): one-permutation hashing, optimal densification, star-shaped candidates.

A document is its set of word shingles. Equal sets are one class, found by fingerprint; the least id stands for it. A
class's signature comes from one pass over its shingles: a shingle's hash picks a bin and a value, a bin keeps its least
value, an empty bin borrows from the full bin that a universal hash of (bin, attempt) hits first. Bands of the
signature are buckets; in each, every member is compared with the bucket's least member only, so pairs grow with the
members. All links are confirmed on full shingle sets. Where a bucket still holds members of different components,
these meet in blocks inside tasks: no pair that shares a bucket goes unseen, and no pairs are emitted but links. Such
buckets of the same family of texts share most members, so they are gathered to one and its sets are sent once. A large
bucket, as a passage that many documents share fills it, is first split by its members' rare shingles: two sets as similar
as wanted share one of the least frequent shingles of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.llm.caches import own_cache
from wikiloom.llm.components import components
from wikiloom.llm.token_counts import slices
from wikiloom.plans.session import bound_arrow_batches
from wikiloom.plans.shared import drop_shared, shared_table

#: At a similarity of 0.85 a pair shares no bucket with probability (1 - 0.85**5)**24 < 1e-6; above, far less.
BANDS, ROWS = 24, 5
BINS = BANDS * ROWS
#: Bits of the filter of ids, at least (1 MB) and at most (32 MB), in maps of the size that Spark's bitmap functions have.
LEAST_BITS, MOST_BITS, MAP_BITS = 1 << 23, 1 << 28, 1 << 15
#: Ids that rows may need which get new ones: 2^20 partitions of 2^33.
NEW_IDS = 1 << 53
#: A block of a bucket's members has about so many bytes of shingles, and members, at most.
BLOCK_BYTES, BLOCK_MEMBERS = 1 << 18, 128
#: So many of a bucket's blocks meet all its blocks in one task; a bucket with more is dealt over several.
BLOCKS_A_PART = 16
#: A mixed bucket of more members is compared by their rare shingles instead of as a whole.
LARGE_BUCKET = 256
#: Slots of the table of shingle frequencies, a byte each whatever the corpus.
SLOT_BITS = 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes a Python worker keeps.
WORD_CACHE = 100_000
_words: dict[bytes, int] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of ``size`` words (fewer words: all of them as one)."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and blank and 9 to 13 alone separate
    if not words:
        return np.zeros(0, np.uint64)
    known = own_cache(_words, WORD_CACHE)
    hashes = list(map(known.get, words))
    if None in hashes:
        for i, w in enumerate(words):
            if hashes[i] is None:
                hashes[i] = known[w] = xxhash.xxh64_intdigest(w)
    h = np.asarray(hashes, np.uint64)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out ^ h[i : len(h) - n + 1 + i])
    return np.unique(out)


def _attempts(bins: int, tries: int) -> np.ndarray:
    """Which bin an empty bin asks in each attempt, by a hash of (bin, attempt) alone."""
    t = np.arange(tries, dtype=np.uint64)
    return np.stack([(mix64(np.uint64(j * 1_000_003) + t) % np.uint64(bins)).astype(np.int16) for j in range(bins)])


_ATTEMPTS: dict[int, np.ndarray] = {}


def signature(found: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash with optimal densification of a set that isn't empty."""
    value = mix64(found ^ np.uint64(0x2545F4914F6CDD1D))
    at = (value >> np.uint64(32)) % np.uint64(bins)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(bins, empty, np.uint64)
    np.minimum.at(least, at.astype(np.int64), value)
    full = least != empty
    if not full.all():
        if bins not in _ATTEMPTS:
            _ATTEMPTS[bins] = _attempts(bins, 64 * bins)
        asked = _ATTEMPTS[bins]
        lacking = np.flatnonzero(~full)
        source = np.full(len(lacking), -1)
        step, todo = 0, np.arange(len(lacking))
        while len(todo) and step < asked.shape[1]:
            part = asked[lacking[todo], step : step + 64]
            hit = full[part]
            got = hit.any(axis=1)
            source[todo[got]] = part[got, hit[got].argmax(axis=1)]
            todo = todo[~got]
            step += 64
        source[todo] = np.flatnonzero(full)[0]
        least[lacking] = least[source]
    return least


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for each band, the band's number mixed in."""
    grid = sig.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key ^ grid[:, r])
    return key.view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, fp, keys) of every row; fp is null and keys empty for an empty set or a null id."""
    names = ["id", "n_shingles", "fp", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sizes, prints, keys = [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = shingles(text or "")
                    sizes.append(len(own))
                    if not len(own) or doc is None:
                        prints.append(None)
                        keys.append([])
                        continue
                    a, b = np.bitwise_xor.reduce(mix64(own)), np.add.reduce(mix64(own ^ _GOLDEN))
                    prints.append(f"{len(own):x}-{int(a):016x}{int(b):016x}")
                    keys.append(band_keys(signature(own, bands * rows), bands, rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.string()), pa.array(keys, pa.list_(pa.int64()))], names=names)

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_shingles long, fp string, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles) as sorted 64-bit numbers in a binary column, from (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t or "").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def marked(docs: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """``docs`` with a column likely: false where the value of ``on`` is not among those of ``ids``, by a bitmap of hashes with
    eight bits a row of ``ids``, LEAST_BITS to MOST_BITS, so that it can be broadcast. Where there are so many that most bits of
    the largest map were set, all rows are likely."""
    count = ids.count()
    if count > MOST_BITS:
        return docs.withColumn("likely", F.lit(True))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * count).bit_length()))
    at = F.pmod(F.xxhash64(on), F.lit(bits))
    maps = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / MAP_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("at") % MAP_BITS).alias("map"))
    placed = docs.withColumn("at", at).withColumn("part", F.floor(F.col("at") / MAP_BITS))
    tested = placed.join(F.broadcast(shared_table(maps, "near-filter")), "part", "left")
    byte = F.conv(F.hex(F.substring(F.col("map"), (F.col("at") % MAP_BITS / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return tested.withColumn("byte", byte).withColumn("likely", F.expr("coalesce(shiftright(byte, cast(at % 8 as int)) & 1 = 1, false)")).select(*docs.columns, "likely")


def likely_among(docs: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    """The rows of ``docs`` that may be among ``ids``. It spares the shuffle of most rows; the exact join follows."""
    return marked(docs, ids, on).where("likely").drop("likely")


def gathered(open_: DataFrame) -> DataFrame:
    """Buckets (key, id, component) that share members become one, in which each member is once, where that has LARGE_BUCKET
    members at most; the others stay as they are. Members of one bucket stay together."""
    first = shared_table(open_.groupBy("key").agg(F.min("id").alias("v")), "near-first")
    edges = shared_table(open_.join(first, "key").select(F.col("id").alias("u"), "v").distinct(), "near-met")
    groups = shared_table(components(edges).select(F.col("node").alias("id"), F.col("component").alias("group")), "near-gathered")
    small = shared_table(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= LARGE_BUCKET).select("group"), "near-small")
    held = groups.join(small, "group", "left_semi")
    once = open_.select("id", "component").distinct().join(held, "id").select(F.col("group").alias("key"), "id", "component")
    return shared_table(once.union(open_.join(held.select("id"), "id", "left_anti").select("key", "id", "component")), "near-open")


def confirmed(pairs: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= numerator * union, on full sets."""
    left = likely_among(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), pairs.select("u").distinct(), "u")
    right = likely_among(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), pairs.select("v").distinct(), "v")
    shorter, longer = F.least(F.octet_length("a"), F.octet_length("b")), F.greatest(F.octet_length("a"), F.octet_length("b"))
    both = pairs.join(left, "u").join(right, "v").where(100 * shorter >= numerator * longer).select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                linked = []
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    merged = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
                    merged.sort(kind="stable")
                    common = int((merged[1:] == merged[:-1]).sum())
                    linked.append(100 * common >= numerator * (len(merged) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "u long, v long")


def shingle_levels(own: DataFrame) -> np.ndarray:
    """For each slot, by a shingle's first SLOT_BITS bits, the binary logarithm of how often its shingles occur in ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                values = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
                slot, n = np.unique(values >> np.uint64(64 - SLOT_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    counted = own.select("shingles").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    table = counted.select("slot", F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()  # a row a slot at most
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    levels[table["slot"].to_numpy()] = table["level"].to_numpy()
    return levels


def rare_keys(members: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """(key, id, component): groups of members (id, component) such that any two that are to be linked share a group.

    A member's keys are its least frequent shingles, by one order for all: of n shingles so many that a set with
    numerator / 100 of them in common has one of these among its own keys. Groups of one component go, and of groups with
    the same members one stays.
    """
    own = shared_table(likely_among(sets, members).join(members, "id").select("id", "component", "shingles"), "near-wide")
    levels = shingle_levels(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                keys = []
                for packed in batch.column(2).to_pylist():
                    values = np.frombuffer(packed, np.uint64)
                    n = len(values)
                    order = np.argsort(levels[values >> np.uint64(64 - SLOT_BITS)], kind="stable")  # values are sorted
                    keys.append(values[order[: n + 1 - -(-numerator * n // 100)]].view(np.int64))
                row = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(row), batch.column(1).take(row)], names=["key", "id", "component"])

    posted = shared_table(own.mapInArrow(run, "key long, id long, component long"), "near-rare")
    marks = []
    for seed in (1, 2):  # sums that tell multisets of ids apart
        mark = F.xxhash64("id", F.lit(seed))
        marks += [F.sum(F.shiftrightunsigned(mark, 32)).alias(f"high{seed}"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias(f"low{seed}")]
    groups = posted.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n"), *marks).where("least != most")
    once = shared_table(groups.groupBy("n", "high1", "low1", "high2", "low2").agg(F.min("key").alias("key")).select("key"), "near-groups")
    drop_shared(own)
    return posted.join(once, "key").distinct()


def block_links(open_: DataFrame, sets: DataFrame, numerator: int) -> DataFrame:
    """Links between members (key, id, component) of a bucket that are of different components.

    A bucket's most frequent component needs no comparison within itself: its members and the others are dealt into
    blocks by hash, and blocks of the others meet all blocks of the bucket. A large bucket's comparisons are dealt over
    parts, BLOCKS_A_PART blocks of the others in each. A task counts the intersections of all pairs of two blocks at
    once and returns no more links than join what it found.
    """
    held = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = shared_table(held.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main")), "near-main")
    lengths = sets.select("id", F.octet_length("shingles").alias("bytes"))
    members = shared_table(open_.join(main, "key").withColumn("rest", F.col("component") != F.col("main")).drop("main").join(lengths, "id"), "near-members")
    many = members.groupBy("key", "rest").agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS)).alias("blocks"))
    others = F.max(F.when(F.col("rest"), F.col("blocks"))).over(Window.partitionBy("key"))  # two rows a key at most
    sizes = shared_table(many.withColumn("parts", F.ceil(others / BLOCKS_A_PART)), "near-many")
    dealt = members.join(sizes, ["key", "rest"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(likely_among(sets, open_.select("id").distinct()), "id")
    # Dealt by block: the joins before may have left a whole bucket together.
    grouped = dealt.repartition("key", "rest", "block").groupBy("key", "rest", "block", "parts").agg(F.collect_list(F.struct("id", "component", "shingles")).alias("m"))
    blocks = shared_table(grouped.select("key", "rest", "block", "parts", F.col("m.id").alias("ids"), F.col("m.component").alias("own"), F.col("m.shingles").alias("sets")), "near-blocks")
    left = blocks.where("rest").select("key", F.pmod("block", "parts").alias("part"), F.col("block").alias("b"), F.col("ids").alias("ids_a"), F.col("own").alias("own_a"), F.col("sets").alias("sets_a"))
    right = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = left.join(right, ["key", "part"]).where("NOT rest OR b <= block").select("ids_a", "own_a", "sets_a", "ids", "own", "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids_a, own_a, sets_a, ids_b, own_b, sets_b = (batch.column(c)[row].as_py() for c in range(6))
                found = links_between(ids_a, own_a, [np.frombuffer(x, np.uint64) for x in sets_a], ids_b, own_b, [np.frombuffer(x, np.uint64) for x in sets_b], numerator)
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

    return shared_table(pairs.mapInArrow(run, "u long, v long").distinct(), "near-links")


def links_between(ids_a: list[int], own_a: list[int], sets_a: list[np.ndarray], ids_b: list[int], own_b: list[int], sets_b: list[np.ndarray], numerator: int) -> list[tuple[int, int]]:
    """Links between documents of two blocks that are of different components, as a forest over the components."""
    size_a = np.array([len(x) for x in sets_a])
    values = np.concatenate(sets_a)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(sets_a)), size_a)[order]
    own = np.asarray(own_a)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    out = []
    for doc, component, shingled in zip(ids_b, own_b, sets_b, strict=True):
        first, last = np.searchsorted(values, shingled), np.searchsorted(values, shingled, side="right")
        n = last - first
        at = np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets_a))
        near = (100 * common >= numerator * (size_a + len(shingled) - common)) & (own != component)
        for a in np.flatnonzero(near):
            x, y = top(int(own[a])), top(component)
            if x != y:
                above[max(x, y)] = min(x, y)
                out.append((ids_a[a], doc))
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", numerator: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id_col, n_shingles, component_id and kept for every row of ``df``.

    Documents are linked if their shingle sets' similarity is at least numerator / 100; component_id is the least id
    that a document reaches, itself included, and kept tells whether it is that one. A null or empty text, or one of
    white space, has no shingles and no links; a null id has no links, a null component_id, and is kept. Rows with one
    id are one document: they share what any of them links with. Repeated rows each get their row, of which all or
    none are kept. Other columns are not read; an empty table gives no rows.
    """
    bound_arrow_batches(df.sparkSession)
    sketched = shared_table(sketches(df, id_col, text_col, bands, rows), "near-sketches")
    prints = sketched.where("fp IS NOT NULL")
    # Equal sets: classes of more than one row, by the least id.
    classes = shared_table(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "near-classes")
    known = prints.select("id", "fp").join(classes, "fp", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    copies = shared_table(known.where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct(), "near-copies")
    # Buckets of more than one class.
    equal = marked(prints.select("id", "fp", "keys"), classes.select("fp"), "fp")
    single = equal.where("NOT likely").select("id", "keys").union(equal.where("likely").join(classes, "fp", "left").where("rep IS NULL OR rep = id").select("id", "keys"))
    posted = shared_table(single.select("id", F.explode("keys").alias("key")), "near-posted")
    # A table of its own has one row a bucket, so that the join with it can split a large bucket.
    shared = shared_table(posted.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").drop("last"), "near-shared")
    buckets = shared_table(likely_among(posted, shared, "key").join(shared, "key"), "near-buckets")
    pairs = shared_table(buckets.where("id != centre").select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct(), "near-pairs")
    drop_shared(posted)
    members = shared_table(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "id"), "near-members")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    sets = shared_table(shingle_sets(likely_among(texts, members).join(members, "id", "left_semi")).distinct(), "near-sets")
    links = shared_table(confirmed(pairs, sets, numerator), "near-links")
    found = shared_table(components(copies.union(links)), "near-components")
    # The centre has met its whole bucket. Where the others still are of different components, they meet in blocks.
    placed = buckets.where("id != centre").select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = shared_table(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key"), "near-mixed")
    open_ = shared_table(placed.join(mixed, "key"), "near-open")
    if not open_.isEmpty():
        open_ = gathered(open_)
        large = shared_table(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_BUCKET).select("key"), "near-large")
        if not large.isEmpty():
            wide = open_.join(large, "key", "left_semi").select("id", "component").distinct()
            open_ = open_.join(large, "key", "left_anti").select("key", "id", "component").union(rare_keys(wide, sets, numerator).select("key", "id", "component"))
            open_ = shared_table(open_, "near-open")
        links = links.union(block_links(open_, sets, numerator))
        found = shared_table(components(copies.union(links)), "near-components")
    out = sketched.select("id", "n_shingles").join(found.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``df``, one of each group of near duplicates, with all their columns.

    The row of a group that stays is that of the least id; but the texts of an id that stands for several different
    texts count as documents of their own, and one of these goes first. Of rows with equal id and text one stays, that
    whose columns come first as JSON. Rows with a null id, or without words, have no duplicates and stay, repeated rows
    but one excepted where the id isn't null. An empty table gives no rows. Columns of any name pass as they are.
    """
    text, mark = F.col(text_col).cast("string"), F.xxhash64(F.col(text_col).cast("string"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"), mark.alias("mark"))
    named = rows.where("id IS NOT NULL")
    held = named.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("low"), F.max("mark").alias("high")).where("n > 1")
    repeated = shared_table(held.select("id", (F.col("low") != F.col("high")).alias("clash")), "near-repeated")
    if not repeated.isEmpty():
        # One row of each id and text, and for texts that share an id new ids below all others, if there is room.
        known = named.join(repeated, "id", "left")
        several = known.where("clash IS NOT NULL").groupBy("id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"), F.first("clash").alias("clash"))
        below = named.agg(F.min("id")).first()[0] - 1
        others = known.where("clash IS NULL").select("row", "id")
        if below - NEW_IDS >= -(1 << 63):
            renamed = several.select("row", F.when(F.col("clash"), F.lit(below) - F.monotonically_increasing_id()).otherwise(F.col("id")).alias("id"))
            once = others.unionByName(shared_table(renamed, "near-renamed"))
        else:  # all rows get new ids, in the order that they would have
            ordered = several.select("row", "id", "clash").unionByName(others.withColumn("clash", F.lit(False))).orderBy(F.col("clash").desc(), "id")
            once = shared_table(ordered.select("row", F.monotonically_increasing_id().alias("id")), "near-renamed")
        named = once.withColumn("text", F.col("row").getField(text_col).cast("string"))
    kept = near_duplicates(named.select("id", "text"), "id", "text", **settings).where("kept").select("id")
    stay = named.join(kept, "id", "left_semi").select("row.*")
    return stay.unionByName(rows.where("id IS NULL").select("row.*"))
