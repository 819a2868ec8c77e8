"""Exact n-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two sets link when 100 * |A and B| >= percent * |A or B|. Then each shares at least that part of its own shingles,
``common(n)``, with the other. The join uses this three times.

1. Filter. In hash order a set's first ``prefix(n)`` shingles must share ``needed(n)`` with other sets. Only these
   travel, as blobs dealt out by hash range; sets that share fewer are linked with nothing.
2. Keys. What is left is joined by size. Small (light) sets enumerate their subsets of the fixed sizes that a
   partner must share. Large (heavy) sets post their rarest shingles, just enough that linked sets meet in a list,
   to inverted lists. The boundary is the size up to which subsets cost less than lists, from counted sizes.
3. Links. In a pass each set is compared with one partner from another component, the same one for as many sets as
   possible, so a pass makes no more edges than there are sets, however many lists a group of near copies shares.
   Components are formed, and the next pass looks only at lists whose members lie in different components; there each
   list offers more partners than in the first. When such a pass does not close lists with a good part of the pairs left, all pairs
   left in open lists are compared, each in the first list where it meets; so every component comes out exact. Before
   full sets are fetched, two exact bounds drop pairs: a shared shingle's ranks in both sets bound the overlap from
   above, and so do the bits in which the parities of both sets' shingles differ.

Shingles are 64-bit hashes of 64-bit word hashes; small sets, of which many may exist, are compared by a second
64 bits too. Equal sets are one class, represented by the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks_of, maybe_broadcast, rows_of, thrifty
from .components import connected_components
from .shingles import shingle_sets

SHINGLE_WORDS, PERCENT = 5, 80
#: Text characters whose blobs are built at once, and text characters whose shingles one hash range holds, about.
GATHER, RANGE = 4 << 20, 16 << 20
#: Largest size for which subsets are considered at all.
MAX_LIGHT = 14
#: 64-bit words of a set's parity bits.
WORDS = 16
#: Members of one component in one list beyond which they are not joined among themselves.
CROWD = 512
#: Part of the pairs in open lists that must go in a pass for another one to be worth it.
WORTH = 0.25
#: Orders of the sets by which a list offers partners, after the first pass, which has one.
ORDERS = 8
#: Lists of a set, before one at hand, in which a pair is known to have met.
BEFORE = 32


def common(n, percent: int):
    """Least number of its n shingles that a set shares with any set it links to."""
    return -(-n * percent // 100)


def slack(n, percent: int):
    """How many more shared shingles the filter looks for; grows with n, so the smaller set sets the need."""
    return n // 10 + 1


def prefix(n, percent: int):
    return np.minimum(n, n - common(n, percent) + slack(n, percent))


def needed(n, percent: int):
    """Shingles that the prefixes of a set of n and of a linked one share, as that one may be as small as common(n)."""
    least = common(n, percent)
    return np.minimum(slack(least, percent), common(least, percent))


META = "id long, n long, d1 long, d2 long, times long, need long, bucket int, low binary, ids binary, needs binary"


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an array, least significant bytes first: the equal upper ones compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _both_sets(texts: list[str | None], size: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """The shingle set of each text, and for small ones also their second hashes."""
    first = list(shingle_sets(texts, size))
    small = [k for k, s in enumerate(first) if 0 < len(s) <= MAX_LIGHT]
    second = dict(zip(small, shingle_sets((texts[k] for k in small), size, seed=1), strict=True))
    return [(s, second.get(k)) for k, s in enumerate(first)]


def _digest(s: np.ndarray, t: np.ndarray | None) -> tuple[int, int]:
    """128 bits of a set."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes() + (b"" if t is None else t.tobytes()))
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _gather(bucket_bits: int, size: int, percent: int):
    """A row for each document (bucket null): id, n, digest of its set, how many of its prefix shingles other documents
    at hand share, and how many must be shared. Rows of a bucket: each prefix shingle in one hash range once, with the
    id that waits to hear of it elsewhere; a shingle found to be shared already has need 0 and only tells others."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in META.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.int32()] + [pa.binary()] * 3
        told = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        rows = (row for batch in batches for row in rows_of(batch, "id", "text"))
        for held in chunks_of(rows, GATHER, lambda r: len(r[1] or "")):
            ids = np.array([r[0] for r in held], np.int64)
            meta, hashes, owner = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for k, (s, t) in enumerate(_both_sets([r[1] for r in held], size)):
                meta.append((len(s), *_digest(s, t)))
                take = int(prefix(len(s), percent)) if len(s) else 0
                hashes.append(s[:take])
                owner.append(np.full(take, k, np.int32))
            n, d1, d2 = map(list, zip(*meta, strict=True))
            need = np.minimum(needed(np.maximum(np.array(n), 1), percent), 65535)
            # the prefix holds the smallest hashes, so ranges are taken of a product
            v = np.concatenate(hashes) * np.uint64(0xD6E8FEB86659FD93)
            order = np.argsort(v, kind="stable")
            v, o = v[order], np.concatenate(owner)[order]
            begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
            count = np.diff(np.append(begin, len(v)))
            times = np.bincount(o[np.repeat(count > 1, count)], minlength=len(ids))
            none = [None] * len(ids)
            yield told([ids, n, d1, d2, times, need, none, none, none, none])
            if not len(v):
                continue
            v, o = v[begin], o[begin]
            waits = np.where(count > 1, 0, need[o]).astype(np.uint16)
            part = (v >> np.uint64(64 - bucket_bits)).astype(np.int32)
            low = (v >> np.uint64(32 - bucket_bits)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(part)) + 1
            spans = list(zip([0, *cuts], [*cuts, len(v)], strict=True))
            none = [None] * len(spans)
            yield told([*[none] * 6, [int(part[a]) for a, _ in spans], [low[a:b].tobytes() for a, b in spans], [_planes(ids[o[a:b]]) for a, b in spans], [_planes(waits[a:b]) for a, b in spans]])

    return run


def _shared(batch):
    """Of one hash range: for each id that waits, how many of its prefix shingles came from elsewhere too."""
    import pandas as pd

    low = np.concatenate([np.frombuffer(x, np.uint32) for x in batch["low"]])
    ids = np.concatenate([_unplanes(x, np.int64) for x in batch["ids"]])
    need = np.concatenate([_unplanes(x, np.uint16) for x in batch["needs"]])
    _, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
    hit = (count[inverse] > 1) & (need > 0)
    who, first, times = np.unique(ids[hit], return_index=True, return_counts=True)
    return pd.DataFrame({"id": who, "times": times.astype(np.int64), "need": need[hit][first].astype(np.int64)})


def _parity(s: np.ndarray) -> np.ndarray:
    """Each shingle flips one of 64 * WORDS bits; sets differ in at least as many shingles as in bits."""
    flips = np.bincount((s >> np.uint64(8)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


SETS = "id long, h long, s array<long>, t array<long>, bits array<long>"


def _sets_of(size: int):
    """(id, hash of the set, set, second hashes of a small one, parity bits)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        longs = pa.list_(pa.int64())
        for batch in batches:
            rows = list(rows_of(batch, "id", "text"))
            for held in chunks_of(rows, GATHER, lambda r: len(r[1] or "")):
                both = _both_sets([r[1] for r in held], size)
                offsets = np.cumsum([0, *(len(s) for s, _ in both)]).astype(np.int32)
                values = np.concatenate([s for s, _ in both]).view(np.int64)
                second = pa.array([None if t is None else t.view(np.int64) for _, t in both], longs)
                bits = pa.array([_parity(s) for s, _ in both], longs)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([_digest(*x)[0] for x in both], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), second, bits], ["id", "h", "s", "t", "bits"])

    return run


def boundary(sizes: dict[int, int], percent: int, mean_list: float) -> int:
    """The largest size up to which enumerating subsets costs no more than posting and scanning lists."""
    best, light, heavy = 0, 0.0, 0.0
    for n in range(1, MAX_LIGHT + 1):
        light += sizes.get(n, 0) * sum(comb(n, k) for k in subset_sizes(n, percent))
        heavy += sizes.get(n, 0) * (n - common(n, percent) + 1) * (1 + mean_list)
        if light <= heavy:
            best = n
    return best


def subset_sizes(n: int, percent: int) -> list[int]:
    """Sizes of subsets that a set of n and a linked one of the same size or larger must share."""
    return sorted({min(n, common(m, percent)) for m in range(n, n * 100 // percent + 1)})


def _light_keys(percent: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            keys, reps, sizes = [], [], []
            for rep, n, s in rows_of(batch, "rep", "n", "s"):
                values = np.sort(np.array(s, np.int64))
                for k in subset_sizes(n, percent):
                    for pick in combinations(range(n), k):
                        keys.append(xxhash.xxh3_64_intdigest(values[list(pick)].tobytes(), seed=k) - (1 << 63))
                        reps.append(rep)
                        sizes.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, reps, sizes)], ["key", "rep", "n"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose full sets link; both sides come by equi-joins, only sets in pairs move."""
    sets = sets.join(maybe_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("rep"))), "rep", "left_semi")
    left = sets.select(F.col("rep").alias("a"), F.col("s").alias("sa"), F.col("t").alias("ta"))
    right = sets.select(F.col("rep").alias("b"), F.col("s").alias("sb"), F.col("t").alias("tb"))

    def link(x, y):
        both = F.size(F.array_intersect(x, y))
        return 100 * both >= percent * (F.size(x) + F.size(y) - both)

    told = pairs.join(left, "a").join(right, "b").where(link("sa", "sb") & F.when(F.col("ta").isNotNull() & F.col("tb").isNotNull(), link("ta", "tb")).otherwise(True))
    return told.select("a", "b").distinct()


def _may_link(pairs: DataFrame, sets: DataFrame, percent: int, a: str, b: str) -> DataFrame:
    """Of rows with two sets, in the columns a and b, those whose sizes and parity bits allow a link."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    differ = F.aggregate(F.zip_with(f"{a}_bits", f"{b}_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    by_bits = (n + m - differ) / F.lit(2.0) >= (percent * (n + m)) / F.lit(100.0 + percent) - 1e-9
    return pairs.join(side(a), a).join(side(b), b).where(_sizes_fit(n, m, percent) & by_bits).select(*pairs.columns)


def _sizes_fit(a, b, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _posted(work: Scratch, sets: DataFrame, percent: int) -> DataFrame:
    """Inverted lists (key, rep, n, at = rank in the set): of each set the shingles that others have, rarest first, as many as it must post.

    Shingles that no other set has come before all others in that order and need no list. Frequencies are written, so
    that a shingle of very many sets can be dealt to several tasks when they come back.
    """
    tokens = sets.select("rep", "h", "n", F.explode("s").alias("key"))
    known = work.save(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    work.sweep()
    lists = tokens.join(known, "key").groupBy("rep", "h", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("held"))
    n_common = F.ceil(F.col("n") * percent / F.lit(100))
    room = (F.col("n") - n_common + 1) - (F.col("n") - F.size("held"))
    return lists.withColumn("room", room.cast("int")).where("room > 0").select("rep", "n", (F.col("n") - F.size("held")).alias("alone"), F.posexplode(F.slice("held", F.lit(1), F.col("room"))).alias("at", "x")).select(F.col("x.key").alias("key"), "rep", "n", (F.col("alone") + F.col("at")).alias("at"))


def _meet(left: DataFrame, right: DataFrame, apart, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one list that may still link; the bounds are part of the join itself."""
    a, b = left.alias("a"), right.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    # 100 * overlap >= percent * (n + m - overlap)
    least = (percent * (n + m)) / F.lit(100.0 + percent) - 1e-9
    by_rank = F.least(n - F.col("a.at"), m - F.col("b.at")) >= least
    differ = sum((F.bit_count(F.col(f"a.w{k}").bitwiseXOR(F.col(f"b.w{k}"))) for k in range(WORDS)), start=F.lit(0))
    by_bits = (n + m - differ) / F.lit(2.0) >= least
    # what shares an earlier list, where ranks bound no more, met there; the first shared list of either set always counts
    anew = ~F.arrays_overlap("a.before", "b.before")
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & _sizes_fit(n, m, percent) & by_rank & by_bits & anew)
    return found.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"))


def _partners(work: Scratch, in_lists: DataFrame, tested: DataFrame | None, k: int, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each set of an open list at most one partner there, from another component, not compared yet.

    in_lists has key, rep and component, of open lists only. A list offers its first and its last member in orders of all
    sets that differ from pass to pass: in one order at first, then in ORDERS, as two components may be joined by few of
    their pairs only. Of its lists' offers from other components a set takes the first that size and bits allow to link.
    """
    here = in_lists.select("key", "rep", "component")
    member = lambda end, order: (x := end(F.struct(F.xxhash64("rep", F.lit(100 + ORDERS * k + order)), "rep", "component")), F.struct(x["rep"].alias("rep"), x["component"].alias("component")))[1]
    ends = here.groupBy("key").agg(F.array_distinct(F.array(*[member(end, order) for order in range(ORDERS if k else 1) for end in (F.min, F.max)])).alias("ends"))
    ends = work.save(ends, f"ends-{k}")
    # lists of one group offer the same sets, so these are put together before each offer becomes a row
    others = F.sort_array(F.transform(F.filter("ends", lambda x: x["component"] != F.col("component")), lambda x: x["rep"]))
    met = here.join(ends, "key").select("rep", others.alias("others")).where(F.size("others") > 0)
    offers = met.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others")).select("rep", F.explode("others").alias("other"))
    offers = work.save(offers, f"offers-{k}").withColumns({"a": F.least("rep", "other"), "b": F.greatest("rep", "other")})
    if tested is not None:
        offers = offers.join(maybe_broadcast(tested), ["a", "b"], "left_anti")
    near = _may_link(offers, sets, percent, "rep", "other")
    chosen = near.groupBy("rep").agg(F.min(F.struct(F.xxhash64("other", F.lit(100 + ORDERS * k)).alias("order"), "a", "b")).alias("offer"))
    return chosen.select("offer.a", "offer.b").distinct()


def _grown(work: Scratch, found: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Components (rep, component) after more links (a, b) between sets: components of the graph between components."""
    told = maybe_broadcast(found)
    side = lambda x: told.select(F.col("rep").alias(x), F.col("component").alias(f"{x}_in"))
    edges = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_in").alias("a"), F.col("b_in").alias("b"))
    joined = connected_components(work, edges, name).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return work.save(found.join(maybe_broadcast(joined), "component", "left").select("rep", F.coalesce("into", "component").alias("component")), f"{name}-found")


def _open(in_lists: DataFrame) -> DataFrame:
    """(key, size, pairs) of the lists with members in different components: members, and pairs of such members."""
    here = in_lists.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    lists = here.groupBy("key").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count(F.lit(1)).alias("components"))
    return lists.where("components > 1").select("key", "size", ((F.col("size") * F.col("size") - F.col("same")) / 2).alias("pairs"))


def _met(work: Scratch, rest: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``rest`` that share a list, lie in different components and may link."""
    earlier = Window.partitionBy("rep").orderBy("at", "key").rowsBetween(-BEFORE, -1)
    rest = work.save(rest.withColumn("before", F.collect_list("key").over(earlier)), "rest")
    crowds = rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("here")).where(F.col("here") > CROWD).select("key", "component")
    crowds = work.save(crowds, "crowds")
    if crowds.isEmpty():
        return _meet(rest, rest, F.col("a.component") < F.col("b.component"), percent).distinct()
    few = work.save(rest.join(crowds, ["key", "component"], "left_anti"), "few")
    many = work.save(rest.join(crowds, ["key", "component"], "left_semi"), "many")
    several = crowds.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    met = _meet(few, few, F.col("a.component") < F.col("b.component"), percent).unionByName(_meet(few, many, F.lit(True), percent))
    return met.unionByName(_meet(many.join(several, "key", "left_semi"), many, F.col("a.component") < F.col("b.component"), percent)).distinct()


def link_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: id, n_shingles, set_id (smallest id with the same set), component_id, links.

    links counts, for the class, the verified links to other classes that were needed to form components; equal
    texts are linked by set_id. Null, empty and blank texts have n_shingles 0 and link with nothing: their set_id
    and component_id are their own id. Repeated rows repeat their result; rows of one id with different texts are one
    document that links by each of them; an empty table gives an empty one; other columns are not read. A text is
    read whole, whatever its length. Ids are integers; rows without an id are left out.
    """
    work = Scratch(spark, "jaccard-join")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    # hash ranges by the amount of text, so that what a task holds of one does not grow with the corpus
    amount = slim.agg(F.sum(F.char_length("text"))).first()[0] or 0
    bucket_bits = min(24, max(5, (amount // RANGE).bit_length()))

    gathered = work.save(slim.mapInArrow(thrifty(_gather(bucket_bits, size, percent)), META), "gathered")
    meta = work.save(gathered.where("bucket is null").select("id", "n", "d1", "d2", "times", "need"), "meta")
    blobs = gathered.where("bucket is not null").select("bucket", "low", "ids", "needs")
    counted = blobs.groupBy("bucket").applyInPandas(_shared, "id long, times long, need long").unionByName(meta.where("times > 0").select("id", "times", "need"))
    alive = counted.groupBy("id").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need").select("id")
    alive = work.save(alive, "alive")
    work.drop("gathered")
    work.sweep()

    # classes of equal sets; one of each goes on
    classes = meta.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = work.save(classes, "classes")
    reps = work.save(classes.join(alive.withColumnRenamed("id", "rep"), "rep", "left_semi").select(F.col("rep").alias("id")).distinct(), "reps")
    chosen = slim.join(maybe_broadcast(reps), "id", "left_semi").mapInArrow(thrifty(_sets_of(size)), SETS)
    several = work.save(meta.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("n", "d1", "d2")).alias("x"), F.max(F.struct("n", "d1", "d2")).alias("y")).where("rows > 1").select("id", (F.col("x") != F.col("y")).alias("differ")), "several")
    if not several.isEmpty():  # a repeated row gives its set once
        chosen = chosen.dropDuplicates(["id", "h"])
    sets = work.save(chosen.select(F.col("id").alias("rep"), "h", F.size("s").cast("long").alias("n"), "s", "t", "bits"), "sets")

    counts = {r["n"]: r["count"] for r in sets.where(F.col("n") <= MAX_LIGHT).groupBy("n").count().collect()}
    lists = work.save(_posted(work, sets, percent), "posted")
    length = lists.groupBy("key").count().agg(F.avg("count")).first()[0] or 0.0
    light = boundary(counts, percent, length)
    keys = lists.where(F.col("n") >= common(light + 1, percent))
    if light:
        keys = keys.unionByName(sets.where(F.col("n") <= light).select("rep", "n", "s").mapInArrow(thrifty(_light_keys(percent)), "key long, rep long, n long").withColumn("at", F.lit(0).cast("long")))
    keys = work.save(keys, "keys")
    work.drop("frequencies", "posted")
    work.sweep()

    found = work.save(keys.select("rep").distinct().select("rep", F.col("rep").alias("component")), "alone")
    links, tested, left, k = None, None, None, 0
    while True:
        in_lists = keys.join(maybe_broadcast(found), "rep")
        lists = work.save(_open(in_lists), f"open-{k}")
        if lists.isEmpty():
            rest = None
            break
        # closed lists stay closed, so later passes do not meet them again
        in_lists = work.save(in_lists.join(lists.select("key"), "key", "left_semi"), f"in-{k}")
        work.drop("keys", f"in-{k - 1}")
        keys = in_lists.drop("component")
        before, left = left, lists.agg(F.sum("pairs")).first()[0]
        # how much a pass closes counts, not how many of its pairs link: where few are left to find, most of few do
        if k > 1 and left >= (1 - WORTH) * before:
            rest = in_lists
            break
        pairs = work.save(_partners(work, in_lists, tested, k, sets, percent), f"pairs-{k}")
        new = work.save(_verified(pairs, sets, percent), f"links-{k}")
        work.drop(f"open-{k}", f"ends-{k}", f"offers-{k}")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        found = _grown(work, found, new, f"pass-{k}")
        work.drop("alone", f"pass-{k - 1}-found")
        work.sweep()
        k += 1
    if rest is not None:
        words = [F.col("bits")[w].alias(f"w{w}") for w in range(WORDS)]
        met = _met(work, rest.join(sets.select("rep", *words), "rep"), percent)
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        new = work.save(_verified(work.save(met, "met"), sets, percent), "links-last")
        links = new if links is None else links.unionByName(new)
        found = _grown(work, found, new, "last")

    if not several.where("differ").isEmpty():  # a document links by each of its texts
        ids = several.where("differ").select("id")
        own = meta.where("n > 0").join(ids, "id", "left_semi").join(classes, ["n", "d1", "d2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        own = work.save(own.where("a <> b").distinct(), "own")
        every = own.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(found, "rep", "left_anti").select("rep", F.col("rep").alias("component"))
        found = _grown(work, work.save(found.unionByName(every), "every"), own, "ids")
    told = classes.select("n", "d1", "d2", "rep").join(found, "rep", "left")
    if links is not None:
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        told = told.join(degree, "rep", "left")
    else:
        told = told.withColumn("links", F.lit(0))
    told = work.save(told.select("n", "d1", "d2", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "told")
    own = meta.join(told, ["n", "d1", "d2"], "left")
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("set_id"), F.coalesce("component", "id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
