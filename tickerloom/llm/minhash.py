"""Near-duplicates by b-bit MinHash: bands, packed signatures, exact confirmation.

A text's set is that of its distinct word shingles. ``BANDS * ROWS`` minima are taken; bands
of whole minima give candidate buckets, and the low ``BITS`` bits of the minima, packed into
64-bit words, estimate the similarity of a candidate pair by bit counts, corrected for chance
agreement. Pairs that the estimate does not rule out are confirmed on the full sets.

No pair of a bucket is emitted for its own sake. Texts with equal sets are one class. Every
bucket first links its members to its most central class, the one whose buckets are fullest;
confirmed links are contracted to components. In two more rounds what still lies outside a
bucket's largest component is held against one of its members, another one in each bucket.
Only classes of one bucket that are in different components after that are paired with each
other. In a bucket of at most FEW classes these are all pairs that sizes and signatures do not
rule out, each of them once. Fuller buckets are searched by an exact prefix filter: two sets
that share t elements share one of their n - t + 1 rarest, and what a crowd of near copies has
in common is never rare. So no link is lost, and a group of many copies costs a multiple of
its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm import grams
from tickerloom.llm.components import components
from tickerloom.llm.frames import byte_slices, ids_and_texts, materialised, sub_batches

BANDS, ROWS = 56, 6
BITS = 2
WORDS = 20  # 64-bit words of a signature: WORDS * 64 / BITS minima, the first of them banded
MINIMA = WORDS * 64 // BITS
SHINGLE = 5
SIMILAR = 80  # per cent
#: A pair is ruled out when its estimate is this far below the threshold: about five standard
#: errors of 640 two-bit minima at a similarity of 0.8.
MARGIN = 0.1
STAR_ROUNDS = 3
SALT = 512
#: Classes of a bucket up to which its pairs are looked at one by one.
FEW = 16
#: Set sizes of one band differ by one in BAND at most.
BAND = 50

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_C = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, none if empty."""
    w = grams.words(raw, offsets, grams.BLANK_SEPARATED)
    begin = w.runs(n)
    hashes = w.hashes(begin, n) if len(begin) else np.zeros(0, np.uint64)
    doc = w.doc[begin]
    cut = np.searchsorted(doc, np.arange(len(offsets)))
    counts = np.diff(w.first)
    out = []
    for d, count in enumerate(counts.tolist()):
        if count >= n:
            out.append(np.unique(hashes[cut[d] : cut[d + 1]]))
        elif count:
            out.append(w.hashes(np.array([w.first[d]]), count))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 128):
        values = x[start : start + 128, None] * _A + _B
        np.minimum(least, values.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    m = least[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    return grams.mix((grams.mix(m) * _C).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 / BITS of them in a word."""
    per = 64 // BITS
    low = (least.astype(np.uint64) >> np.uint64(8)) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(WORDS, per) << shifts, axis=1).view(np.int64)


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures (arrays of longs), corrected for collisions."""
    mask = int.from_bytes(bytes([0x55]) * 8, "big")
    other = "|".join(f" shiftrightunsigned(x, {k})" for k in range(1, BITS))
    agree = f"bit_count(~(x | {other}) & {mask}L)"
    total = f"aggregate(zip_with({a}, {b}, (p, q) -> p ^ q), 0, (s, x) -> s + {agree})"
    share = f"({total} / {WORDS * 64 // BITS}.0D)"
    return F.expr(f"({share} - {0.5 ** BITS}D) / {1 - 0.5 ** BITS}D")


def signatures(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set key (k1, k2), packed signature and band keys of every row."""
    rows = ids_and_texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            sets = shingle_sets(*byte_slices(batch.column("text")), shingle)
            k1, k2, sketch, bands = [], [], [], []
            for s in sets:
                one, two = set_key(s)
                k1.append(one)
                k2.append(two)
                least = minima(s) if len(s) else None
                sketch.append(packed(least) if len(s) else None)
                bands.append(band_keys(least) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                    pa.array(sketch, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "k1", "k2", "sketch", "bands"],
            )

    return rows.mapInArrow(
        sign, f"doc_id {kind}, n_shingles long, k1 long, k2 long, sketch array<long>, bands array<long>"
    )


SET_KEY = ["n_shingles", "k1", "k2"]


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """vid and set (sorted hashes as bytes) of the wanted classes, from one text of each."""
    texts = ids_and_texts(docs, id_col, text_col)
    rows = texts.join(
        wanted.select(F.col("first_id").alias("doc_id"), "vid", *SET_KEY), "doc_id"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches):
            vid, out = [], []
            for v, n, k1, s in zip(
                batch.column("vid").to_pylist(), batch.column("n_shingles").to_pylist(),
                batch.column("k1").to_pylist(),
                shingle_sets(*byte_slices(batch.column("text")), shingle), strict=True,
            ):
                # a doc_id may stand for several texts; take the one of this class
                if len(s) == n and int(np.add.reduce(s, dtype=np.uint64).view(np.int64)) == k1:
                    vid.append(v)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(vid, pa.int64()), pa.array(out, pa.binary())], names=["vid", "set"]
            )

    found = rows.select("vid", "n_shingles", "k1", "text").mapInArrow(cut, "vid long, set binary")
    unnamed = wanted.where("first_id IS NULL").select("vid", *SET_KEY)
    if not unnamed.isEmpty():  # classes of null keys only have no key to join by: their sets do
        own = texts.where("doc_id IS NULL").select("text").mapInArrow(
            lambda batches: _keyed_sets(batches, shingle), "n_shingles long, k1 long, k2 long, set binary"
        )
        found = found.unionByName(own.dropDuplicates(SET_KEY).join(unnamed, SET_KEY).select("vid", "set"))
    return found.dropDuplicates(["vid"])


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Sum and mixed exclusive or of a set of hashes."""
    k1 = int(np.add.reduce(s, dtype=np.uint64).view(np.int64))
    return k1, int(np.bitwise_xor.reduce(grams.mix(s + np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0


def _keyed_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches):
        sets = shingle_sets(*byte_slices(batch.column("text")), shingle)
        keys = [set_key(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(s) for s in sets], pa.int64()), pa.array([k for k, _ in keys], pa.int64()),
             pa.array([k for _, k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=[*SET_KEY, "set"],
        )


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Rows of one ``a`` arrive together, its own set first, in runs of about SALT partners, so a
    task holds one set at a time and a hub is spread over many tasks.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = sizes.select("a", F.expr(f"CAST(n / {SALT} AS INT) + 1").alias("m"))
    salted = pairs.join(salts, "a").withColumn("salt", F.expr("CAST(pmod(xxhash64(b), m) AS INT)")).select("a", "b", "salt")
    member = salted.join(sets.withColumnRenamed("vid", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "set")
    head = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("vid", "a"), "a").select(
        "a", "salt", F.lit(0).alias("role"), F.lit(None).cast("long").alias("b"), "set"
    )
    rows = head.unionByName(member).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, role, y, data in zip(
                batch.column("a").to_pylist(), batch.column("role").to_pylist(),
                batch.column("b").to_pylist(), batch.column("set"), strict=True,
            ):
                other = np.frombuffer(data.as_buffer(), np.uint64)
                if not role:
                    own = other
                    continue
                most = min(len(own), len(other))
                if 100 * most < similar * max(len(own), len(other)):
                    continue
                both = np.concatenate([own, other])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= similar * (len(own) + len(other) - shared):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(confirm, "a long, b long")


def _not_ruled_out(similar: int) -> Column:
    """On columns na, nb, sa, sb: sizes and packed signatures leave the pair possible."""
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similar
    return fits & (estimate("sa", "sb") >= similar / 100 - MARGIN)


def _promising(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """Pairs that sizes and packed signatures do not rule out."""
    left = classes.select(F.col("vid").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    right = classes.select(F.col("vid").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    return pairs.join(left, "a").join(right, "b").where(_not_ruled_out(similar)).select("a", "b")


def _open_pairs(placed: DataFrame, wanted: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) of one bucket and different components that nothing rules out."""
    members = placed.groupBy("key").agg(F.count("*").alias("members"))
    placed = placed.select("key", "vid", "comp", "fullness").join(members, "key")
    placed = placed.join(wanted.select("vid", "n_shingles"), "vid")
    placed = materialised(placed.withColumnRenamed("n_shingles", "n"), "mh-open")
    few = _pairs_of_few(placed.where(F.col("members") <= FEW), wanted, similar)
    many = placed.where(F.col("members") > FEW)
    if many.isEmpty():
        return few
    found = materialised(_pairs_of_many(many, sets, similar), "mh-rare")
    return few.unionByName(_promising(found, wanted, similar)).distinct()


def _pairs_of_few(placed: DataFrame, wanted: DataFrame, similar: int) -> DataFrame:
    """All open pairs of buckets of few classes, each from the least bucket that both share."""
    own = placed.groupBy("vid").agg(F.collect_set("key").alias("keys"))  # BANDS at most
    placed = placed.join(own.join(wanted.select("vid", "sketch"), "vid"), "vid")
    one, two = (
        placed.select("key", F.col("vid").alias(x), F.col("comp").alias(f"c{x}"), F.col("keys").alias(f"k{x}"),
                      F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        for x in "ab"
    )
    leads = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")
    pairs = one.join(two, "key").where((F.col("ca") < F.col("cb")) & _not_ruled_out(similar) & leads)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _pairs_of_many(placed: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Open pairs of crowded buckets that share an element rare enough; a superset of the links.

    Sets of na and nb elements are linked if they share t = similar * (na + nb) / (100 + similar)
    of them or more. In any order of all elements the first one shared is then among the first
    na - t + 1 of the one set and nb - t + 1 of the other. The order is by how many sets of the
    group hold an element, so the beginning of a set is what it shares with few. Buckets with a
    common full member are one group. Sets meet by element and by the bands of both sizes,
    since t follows from the sizes; what lies in the largest component of a list of sets with
    one element meets only the others of the list, not its own kind.
    """
    top = placed.groupBy("key").agg(F.max(F.struct("fullness", "vid")).alias("top"))
    near = placed.join(top, "key").groupBy("vid").agg(F.max("top").alias("top"))
    named = placed.select("key", "vid").join(near, "vid").groupBy("key").agg(F.max("top").alias("top"))
    member = placed.join(named, "key").select(
        F.col("top.vid").alias("grp"), "vid", "comp", "n", F.floor(F.log("n") * BAND).alias("own")
    ).distinct()
    bands = member.groupBy("grp", "own").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    bands = bands.groupBy("grp").agg(F.collect_list(F.struct("own", "low", "high")).alias("bands"))
    # for each band: how many of a set's first elements matter among the sets of that band
    fits = f"filter(bands, b -> 100 * b.high >= {similar} * n AND 100 * n >= {similar} * b.low)"
    least = f"({similar} * (n + greatest(b.low, ({similar} * n + 99) div 100)) + {99 + similar}) div {100 + similar}"
    reach = f"transform({fits}, b -> struct(b.own AS other, n - {least} + 1 AS most))"
    member = materialised(member.join(bands, "grp").withColumn("reach", F.expr(reach)).drop("bands"), "mh-members")

    wide = sets.join(member.select("vid").distinct(), "vid", "left_semi").mapInArrow(_elements, "vid long, item long")
    wide = wide.join(member.select("grp", "vid", "comp", "n", "own", F.expr("array_max(reach.most)").alias("most")), "vid")
    often = wide.groupBy("grp", "item").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("grp", "vid").orderBy("often", "item"))
    first = wide.join(often, ["grp", "item"]).withColumn("pos", rank).where("pos <= most AND often > 1")
    first = materialised(first.drop("most", "often"), "mh-first")

    kinds = first.groupBy("grp", "item", "comp").agg(F.count("*").alias("c")).groupBy("grp", "item").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("kinds")
    )
    lists = first.join(kinds.where("kinds > 1").drop("kinds"), ["grp", "item"])
    lists = lists.join(member.select("grp", "vid", "reach"), ["grp", "vid"]).withColumn(
        "other", F.explode(F.expr("filter(reach, r -> r.most >= pos).other"))
    )
    one = lists.where("comp != main").select(
        "grp", "item", F.col("own").alias("o1"), F.col("other").alias("o2"), "main",
        F.col("vid").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"),
    )
    two = lists.select(
        "grp", "item", F.col("other").alias("o1"), F.col("own").alias("o2"),
        F.col("vid").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"),
    )
    shared = f"({similar} * (na + nb) + {99 + similar}) div {100 + similar}"
    pairs = one.join(two, ["grp", "item", "o1", "o2"]).where(
        "ca != cb AND (cb = main OR ca < cb)"
        f" AND {shared} <= least(na - pa, nb - pb) + 1 AND 100 * least(na, nb) >= {similar} * greatest(na, nb)"
    )
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vid and item: one row for each element of a set."""
    for batch in batches:
        found, held = [], 0
        for v, data in [*zip(batch.column("vid").to_pylist(), batch.column("set"), strict=True), (None, None)]:
            if found and (data is None or held > 100_000):
                vid = np.repeat(np.array([x for x, _ in found]), [len(s) for _, s in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vid, pa.int64()), pa.array(np.concatenate([s for _, s in found]), pa.int64())],
                    names=["vid", "item"],
                )
                found, held = [], 0
            if data is not None:
                found.append((v, np.frombuffer(data.as_buffer(), np.int64)))
                held += len(found[-1][1])


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Linked are texts with 100 * intersection >= ``similar`` * union of their shingle sets;
    component_id is the smallest doc_id reachable, kept says whether it is the row's own.
    Texts without words (null, empty) have an empty set and are linked with nothing. Rows that
    repeat a doc_id are one vertex for each of their texts; a null doc_id joins its group but
    names none, and a group of nulls has a null component and is kept. An empty table gives an
    empty result. Bands miss a link at the very threshold with a chance below 1e-7.
    """
    signed = materialised(signatures(docs, shingle, id_col, text_col), "mh-signatures")
    classes = signed.where("n_shingles > 0").groupBy(*SET_KEY).agg(
        F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    classes = materialised(classes.withColumn("vid", F.monotonically_increasing_id()), "mh-classes")
    rows = classes.select("vid", F.explode("bands").alias("key"))
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = rows.join(crowded, "key")
    buckets = materialised(buckets, "mh-buckets")
    full = buckets.groupBy("vid").agg(F.sum("n").alias("fullness"))
    wanted = materialised(classes.drop("bands").join(full, "vid"), "mh-wanted")
    sets = materialised(_sets_of(docs, wanted, shingle, id_col, text_col), "mh-sets")

    labels: DataFrame | None = None
    links: DataFrame | None = None
    for k in range(STAR_ROUNDS + 1):
        placed = buckets.select("key", "vid").join(wanted.select("vid", "fullness"), "vid")
        if labels is None:
            placed = placed.withColumns({"comp": F.col("vid"), "size": F.lit(1)})
        else:
            sizes = labels.groupBy("comp").agg(F.count("*").alias("size"))
            known = labels.join(sizes, "comp")
            placed = placed.join(known, "vid", "left").withColumns(
                {"comp": F.coalesce("comp", "vid"), "size": F.coalesce("size", F.lit(1))}
            )
            mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            placed = placed.join(mixed.where("lo != hi").select("key"), "key")
        placed = materialised(placed, "mh-placed")
        if placed.isEmpty():
            break  # every bucket lies in one component
        if k < STAR_ROUNDS:
            first = F.col("fullness") if k == 0 else F.xxhash64("vid", "key", F.lit(k))
            order = F.struct("size", first.alias("first"), "vid")
            centre = placed.groupBy("key").agg(F.max_by(F.struct("vid", "comp"), order).alias("c"))
            pairs = placed.join(centre, "key").where("c.comp != comp").select(
                F.col("c.vid").alias("a"), F.col("vid").alias("b")
            ).distinct()
            pairs = _promising(pairs, wanted, similar)
        else:
            pairs = _open_pairs(placed, wanted, sets, similar)
        pairs = materialised(pairs, "mh-pairs")
        found = materialised(_confirmed(pairs, sets, similar), "mh-links")
        if labels is not None and found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        labels = components(links, labels)
    tops = classes.select("vid", *SET_KEY, "first_id")
    if labels is None:
        tops = tops.withColumn("comp", F.col("vid"))
    else:
        tops = tops.join(labels, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    least = tops.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    tops = materialised(tops.join(least, "comp").select(*SET_KEY, "component_id"), "mh-components")
    full = signed.select("doc_id", *SET_KEY).where("n_shingles > 0").join(tops, SET_KEY).select(
        "doc_id", "n_shingles", "component_id"
    )
    bare = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(
    docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id; all columns stay.

    Rows without words and rows with a null doc_id stay unless a group names another row; of
    rows that repeat the kept doc_id with one text, all stay (exact dedup comes before).
    Columns may have any names.
    """
    found = near_duplicates(docs, shingle, similar, id_col, text_col)
    gone = materialised(found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct(), "mh-gone")
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    own = F.col(f"_c{docs.columns.index(id_col)}")
    return plain.join(gone, own == F.col("_gone"), "left_anti").toDF(*docs.columns)
