"""MinHash near-dedup (operator 8): one-permutation hashing with optimal densification, banded buckets, and
star-shaped candidate edges.

1. *Sketch*: a document's shingles, hashed once, fall into 128 bins; the least hash of a bin is its value. An empty
   bin takes the value of a bin that its own sequence of tries finds first (optimal densification). Bands of four
   bins give 32 bucket keys. Documents with one and the same set are one class, whose smallest id stands for it.
2. *Star edges*: in a bucket, each class is compared with one only, the class with the smallest set. Pairs are
   confirmed on the full sets of the whole texts; the texts of a star's members pass by the one set of its centre.
3. *The rest*: a star alone could miss a link between two members one of which is unlike the centre. Buckets of at
   most FEW classes that are still in several components compare these directly. In larger ones, the classes outside the
   largest component are compared with PIVOTS of its members. What then is apart is set against a *core*, the
   shingles of most of some members: two sets share at most as much of the core as either of them holds, so if one
   holds too little, a link needs a number of shared shingles outside the core that follows from the sizes. Such
   pairs meet over a prefix of their shingles outside (of n shingles of which k must be shared, one is among any
   n - k + 1). Two sets share at least what they hold of the core less its size, so for many links that alone is
   proof: all such links of a group are among those to the one member that holds most for its size, its *anchor*, which
   make one star. Pairs that are still apart and both hold enough of the core are compared directly. The core
   decides only how much is compared: no pair that could be a link is left out.

A link at the threshold is missed only if no band agrees: (1 - 0.8^4)^32 = 5e-8.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.shingles import mixed, shared_count, shingle_set
from vellumspark.llm.store import saved

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Classes of a bucket that are compared directly if its star leaves them apart; members of a star that one group
#: takes; further centres in larger buckets; members from which a core is taken.
FEW, GROUP, PIVOTS, SAMPLE = 64, 256, 8, 64

_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)
with np.errstate(over="ignore"):
    _TRIES = (mixed(np.arange(1, 1 + 1024 * BINS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(57)).astype(np.intp).reshape(1024, BINS)
    _BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def sketch(sorted_set: np.ndarray) -> np.ndarray:
    """The values of all bins of a set that isn't empty."""
    at = np.searchsorted(sorted_set, _EDGES)
    ends = np.append(at[1:], len(sorted_set))
    full = at < ends
    values = sorted_set[np.minimum(at, len(sorted_set) - 1)]
    empty = np.flatnonzero(~full)
    for first, last in ((0, 16), (16, len(_TRIES))):
        if not len(empty):
            return values
        tries = _TRIES[first:last, empty]
        found = full[tries]
        hit = found.any(0)
        values[empty[hit]] = values[tries[found.argmax(0), np.arange(len(empty))][hit]]
        empty = empty[~hit]
    if len(empty):  # about 1 in 3000 for a set of one bin: then the first full bin
        values[empty] = values[np.flatnonzero(full)[0]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = _BAND.copy()
        for column in values.reshape(BANDS, ROWS).T:
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _sketches(words: int):
    def run(batches):
        for batch in batches:
            counts, keys, bands = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(sketch(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n_shingles", "set_key", "bands"])

    return run


def _confirm(words: int, percent: int):
    """Rows sorted by centre, salt and kind: the centre's text first, then the members'."""

    def run(batches):
        centre, base = None, None
        for batch in batches:
            a, b, linked = [], [], []
            for c, salt, kind, member, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                s = shingle_set(text.as_py(), words)
                if kind == 0:
                    centre, base = (c, salt), s
                elif (c, salt) == centre:
                    n = shared_count(base, s)
                    a.append(c)
                    b.append(member)
                    linked.append(n * 100 >= percent * (len(base) + len(s) - n))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked) of the pairs (a, b), which are written, on full sets; a is the centre. Stars are counted before the
    shuffle; only those of more than GROUP members have a row of their number of groups, so that members find theirs without meeting at the centre first."""
    large = saved(pairs.groupBy("a").agg(F.count("*").alias("n")).where(f"n > {GROUP}").select("a", F.ceil(F.col("n") / GROUP).cast("int").alias("salts")), "large")
    members = pairs.join(large, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("id"))
    centres = members.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("id"))
    rows = members.unionByName(centres).join(texts, "id").select("a", "salt", "kind", "id", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "id")
    return rows.mapInArrow(_confirm(words, percent), "a long, b long, linked boolean")


def _core(words: int):
    def run(sample):
        values, counts = np.unique(np.concatenate([shingle_set(t, words) for t in sample["text"]]), return_counts=True)
        core = values[2 * counts > len(sample)]
        return pd.DataFrame({"g": sample["g"].iloc[:1], "core": [core.view(np.int64)]})

    return run


def _outside(words: int, percent: int):
    """Members by group, each group's core first: the shingles outside the core that could decide a link."""

    def run(batches):
        group, core, floor = None, None, 0
        for batch in batches:
            g, ids, held, far, keys = [], [], [], [], []
            for name, salt, least, core_now, member, text in zip(*(batch.column(i) for i in range(6)), strict=True):
                if member.as_py() is None:
                    group, floor = (name.as_py(), salt.as_py()), least.as_py()
                    core = core_now.values.to_numpy().view(np.uint64)
                    continue
                s = shingle_set(text.as_py(), words)
                new = np.setdiff1d(s, core, assume_unique=True)
                # A link takes percent / (100 + percent) of both sizes; the other set has at least ``other`` shingles.
                other = max(floor, len(s) * percent / 100)
                need = int(np.ceil(percent * (len(s) + other) / (100 + percent) - (len(s) - len(new)) - 1e-9))
                g.append(group[0])
                ids.append(member.as_py())
                held.append(len(s) - len(new))
                far.append(need > 0)
                keys.append((new[: max(0, len(new) - need + 1)] if need > 0 else new).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(ids, pa.int64()), pa.array(held, pa.int64()), pa.array(far, pa.bool_()), pa.array(keys, pa.list_(pa.int64()))], ["g", "id", "held_core", "far", "keys"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ids of the links (a, b): the smallest id reachable, which isn't listed itself. Alternates large and small
    stars (each an aggregation of minima and a join) until the edges stay the same; every round is written, and so are the minima:
    Spark splits a hot key of a join whose sides are read from tables, not one whose side was aggregated by that key."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    if edges.isEmpty():
        return edges.toDF("id", "component")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v >= u or v = m").select(F.greatest("u", "v").alias("u"), "m")
        large = saved(large.select("u", F.col("m").alias("v")).where("u > v").distinct(), "large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
        seen = now


def _merged(labels: DataFrame, tested: DataFrame, alone: bool = False) -> DataFrame:
    """The labels (id, component) after the links among what was tested; alone: every id is still its own component."""
    ends = tested.where("linked").select("a", "b")
    if not alone:
        for c in ("a", "b"):
            ends = ends.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")), c)
        ends = ends.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    moved = components(ends).select(F.col("id").alias("component"), F.col("component").alias("to"))
    return saved(labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "labels")


def _apart(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets whose classes are in several components, with each row's component, and the largest (main) with
    PIVOTS of its members."""
    inside = buckets.join(labels, "id")
    picks = [F.min(F.struct(F.xxhash64("id", F.lit(k)), "id", "n")).alias(f"p{k}") for k in range(PIVOTS)]
    parts = inside.groupBy("bucket", "component").agg(F.count("*").alias("members"), *picks)
    most = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("members", "component", *(f"p{k}" for k in range(PIVOTS)))).alias("most"))
    pivots = F.array(*(F.struct(F.col(f"most.p{k}.id").alias("id"), F.col(f"most.p{k}.n").alias("n")) for k in range(PIVOTS)))
    most = most.where("parts > 1").select("bucket", F.col("most.component").alias("main"), F.array_distinct(pivots).alias("pivots"))
    return saved(inside.join(saved(most, "most"), "bucket"), "apart")


def _linked_classes(buckets: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Labels (id, component) of the classes in buckets (bucket, id, n, centre, n_centre, held)."""
    fits = f"least(n, n_other) * 100 >= greatest(n, n_other) * {percent}"

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    labels = saved(buckets.select("id", F.col("id").alias("component")).distinct(), "labels")
    pairs = buckets.withColumnRenamed("n_centre", "n_other").where(f"id <> centre and {fits}")
    pairs = saved(pairs.select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    tested = saved(confirmed(pairs, texts, words, percent), "tested")
    known = both_ways(tested)
    labels = _merged(labels, tested, alone=True)

    apart = _apart(buckets, labels)
    few = apart.where(f"held <= {FEW}")
    one = few.select("bucket", F.col("id").alias("a"), F.col("component").alias("of_a"), F.col("n").alias("n_other"))
    two = few.select("bucket", F.col("id").alias("b"), F.col("component").alias("of_b"), "n")
    direct = one.join(two, "bucket").where(f"a < b and of_a <> of_b and {fits}").select("a", "b")
    more = apart.where(f"held > {FEW} and component <> main").select(F.col("id").alias("a"), "n", F.explode("pivots").alias("p"))
    more = more.select("a", F.col("p.id").alias("b"), "n", F.col("p.n").alias("n_other")).where(fits).select("b", "a").toDF("a", "b")
    pairs = saved(direct.unionByName(more).distinct().join(known, ["a", "b"], "left_anti").join(known.toDF("b", "a"), ["a", "b"], "left_anti"), "pairs")
    tested = saved(confirmed(pairs, texts, words, percent), "tested")
    known = saved(known.unionByName(both_ways(tested)), "known")
    labels = _merged(labels, tested)

    many = _apart(buckets.where(f"held > {FEW}"), labels)
    if many.isEmpty():
        return labels
    members = saved(many.select(F.col("main").alias("g"), "id", "n", "component").distinct(), "members")
    order = Window.partitionBy("g").orderBy(F.xxhash64("id"), "id")
    sample = members.withColumn("turn", F.row_number().over(order)).where(f"turn <= {SAMPLE}").select("g", "id")
    cores = sample.join(texts, "id").groupBy("g").applyInPandas(_core(words), "g long, core array<long>")
    groups = members.groupBy("g").agg(F.min("n").alias("floor"), F.ceil(F.count("*") / GROUP).cast("int").alias("salts"))
    groups = saved(groups.join(cores, "g"), "groups")
    heads = groups.select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "floor", "core", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("text"))
    rows = members.join(groups.select("g", "salts"), "g").join(texts, "id")
    rows = rows.select("g", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(None).cast("int").alias("floor"), F.lit(None).cast("array<long>").alias("core"), "id", "text")
    rows = heads.select("g", "salt", F.col("floor").cast("int"), "core", "id", "text").unionByName(rows)
    rows = rows.repartition("g", "salt").sortWithinPartitions("g", "salt", F.asc_nulls_first("id"))
    shown = saved(rows.mapInArrow(_outside(words, percent), "g long, id long, held_core long, far boolean, keys array<long>"), "outside")
    # a and b are linked for certain if surplus_a + surplus_b >= full: then so is each with the member of the greatest surplus.
    surplus = shown.drop("keys").join(members.drop("component"), ["g", "id"]).withColumn("surplus", F.col("held_core") * (100 + percent) - F.col("n") * percent)
    anchors = surplus.groupBy("g").agg(F.max_by("id", F.struct("surplus", "id")).alias("anchor"), F.max("surplus").alias("most"))
    anchors = saved(anchors.join(groups.select("g", (F.size("core") * (100 + percent)).alias("full")), "g"), "anchors")
    sure = surplus.join(anchors, "g").where("id <> anchor and surplus + most >= full")
    labels = _merged(labels, saved(sure.select(F.col("anchor").alias("a"), F.col("id").alias("b"), F.lit(True).alias("linked")).distinct(), "sure"))
    main = saved(groups.select("g").join(labels.toDF("g", "main"), "g"), "main")
    shown = saved(shown.join(members.drop("component"), ["g", "id"]).join(labels, "id").join(main, "g"), "shown")
    # Of two members in different components, one isn't in the main one. A link takes ``need`` shingles outside the core.
    need = f"ceil({percent} * (n + n_other) / {100 + percent}D - 1e-9) - least(core_a, core_b)"
    apart = f"of_a <> of_b and (of_b = main or a < b) and {fits}"
    one = shown.where("component <> main").select("g", F.col("id").alias("a"), F.col("component").alias("of_a"), F.col("n").alias("n_other"), F.col("held_core").alias("core_a"), "far", "keys")
    two = shown.select("g", "main", F.col("id").alias("b"), F.col("component").alias("of_b"), "n", F.col("held_core").alias("core_b"), F.col("far").alias("far_b"), F.col("keys").alias("keys_b"))
    met = one.withColumn("key", F.explode("keys")).drop("keys").join(two.withColumn("key", F.explode("keys_b")).drop("keys_b"), ["g", "key"]).where(apart).select("a", "b")
    close = one.where("not far").drop("keys").join(two.where("not far_b").drop("keys_b"), "g").where(f"{apart} and {need} <= 0").select("a", "b")
    pairs = saved(both_ways(met.unionByName(close)).distinct().join(known, ["a", "b"], "left_anti"), "pairs")
    return _merged(labels, saved(confirmed(pairs, texts, words, percent), "tested"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: ``id_col``, n_shingles, component_id, kept, class_id.

    Two documents are linked if 100 * shared >= percent * union of their shingle sets. A null, empty or blank text
    has no shingles and is linked with nothing; documents with one set are linked, without being paired. component_id
    is the smallest id reachable over links; kept: it is the row's own id; class_id: the smallest id with the same
    set (the own id without shingles). Ids are integers; rows that repeat an id are taken to repeat the text and share
    the result. A null id keeps its row, alone (component null, kept true). An empty table gives no rows; only the two
    columns are read, so others may have any name.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    sketches = saved(rows.mapInArrow(_sketches(words), "id long, n_shingles long, set_key binary, bands array<long>"), "sketches")
    usable = sketches.where("id is not null and n_shingles > 0")
    classes = saved(usable.groupBy("set_key").agg(F.min("id").alias("class_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    banded = classes.select(F.col("class_id").alias("id"), "n", F.posexplode("bands").alias("band", "key"))
    full = banded.groupBy("band", "key").agg(F.min(F.struct("n", "id")).alias("least"), F.count("*").alias("held")).where("held > 1")
    full = saved(full.select("band", "key", F.col("least.id").alias("centre"), F.col("least.n").alias("n_centre"), "held"), "full")
    buckets = banded.join(full, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "id", "n", "centre", "n_centre", "held")
    buckets = saved(buckets, "buckets")
    ids = saved(buckets.select("id").distinct(), "ids")
    texts = saved(rows.join(ids, "id", "left_semi").dropDuplicates(["id"]), "texts")
    labels = _linked_classes(buckets, texts, words, percent)
    of = saved(classes.select("set_key", "class_id").join(labels.withColumnRenamed("id", "class_id"), "class_id", "left").select("set_key", "class_id", F.coalesce("component", "class_id").alias("component_id")), "of")
    linked = usable.join(of, "set_key").select("id", "n_shingles", "component_id", "class_id")
    alone = sketches.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), F.col("id").alias("class_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "class_id")
