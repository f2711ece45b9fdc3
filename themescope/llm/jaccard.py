"""N-gram Jaccard join with token-combination prefixes.

A document is its set of word shingles (tokens).  Two sets of Jaccard similarity t or more share at least k
tokens among the first ``n - ceil(t n) + k`` of each, in any common order of tokens.  With k = 2 such a pair
either shares a *rare* token there, and meets under that token, or two *frequent* ones, and meets under
their combination.  The classes of a rare token are compared where its rows are read, so that only pairs that
can link move on.  Everything that meets is verified on whole sets.

Equal sets are one class from the start.  In a large bucket members are first compared with one pivot, the
member with the fewest tokens of its own; only pairs that this leaves in different components are compared
afterwards, so a large group of near copies never becomes all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themescope.llm.common import ROW_KEY, groups_of_rows, stored, text_buffer, with_ids, with_row_key
from themescope.llm.hashing import Words, mix, running, second, span

SHINGLE_WORDS, PERCENT = 3, 90
#: A token in the prefixes of more classes than this is frequent; so is a bucket with more members large.
FREQUENT = 16
#: Sets with a prefix of up to so many tokens use combinations of frequent ones, at most 66 rows a set; from
#: ``percent`` of that size on, single ones as well, so two sets that can be similar always have one kind of key
#: in common.
COMBINED_PREFIX = 12
#: Tokens that are common in a task's batch go to the end of the order; so many of them are sent to all
#: tasks at most.  The order decides what is cheap, never what is found.
ORDERED_TOKENS = 100_000
#: Bytes of text whose tokens a task counts at once.
SLICE_BYTES = 1 << 22
#: 64-bit words of a set's parity sketch at least; a power of two.
SKETCH_WORDS = 2
#: Bits of a sketch at least, for each token in which two similar sets may differ.  Sets without common tokens
#: differ in about half of all bits.
SKETCH_BITS = 4
#: Rows of (class, document) that are sent to all tasks at most.
BROADCAST_ROWS = 500_000


def _sets(batch: pa.RecordBatch, text_col: str, n: int):
    """Row number and sorted distinct tokens of every row."""
    data, offsets = text_buffer(batch.column(text_col))
    for a, b in groups_of_rows(offsets, 1 << 21):
        at = offsets[a: b + 1]
        words = Words(data[at[0]: at[-1]], at - at[0], "visible", lower=True)
        sums = running(words.hash)
        places = np.arange(max(0, len(words.hash) - n + 1))
        grams = span(sums, places, places + n)
        for i in range(b - a):
            first, last = int(words.row[i]), int(words.row[i + 1])
            if last - first >= n:
                yield a + i, np.unique(grams[first: last - n + 1])
            elif last > first:
                whole = span(sums, np.array([first]), np.array([last]))
                yield a + i, second(whole, last - first)
            else:
                yield a + i, np.zeros(0, np.uint64)


def _class(tokens: np.ndarray) -> int:
    """Name of a set; 0 for the empty one."""
    if not len(tokens):
        return 0
    total = np.add.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))
    return int(second(np.array([total]), len(tokens)).view(np.int64)[0])


def _sketch(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Parity of the number of tokens that fall on each bit.  Two sets differ in at least as many tokens as their
    sketches differ in bits, so a pair whose sketches are too far apart cannot be similar."""
    differ = 2 * len(tokens) * (100 - percent) // (100 + percent)  # of two similar sets of this size
    bits = 64 * max(SKETCH_WORDS, 1 << max(0, (SKETCH_BITS * differ + 63) // 64 - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _described(keyed: DataFrame, text_col: str, n: int, percent: int) -> DataFrame:
    """Rows of two kinds: (_k, n, c, sketch) of each document; (token, seen) of tokens common in a batch."""
    sketches = pa.list_(pa.int64())

    def run(batches):
        for whole in batches:
            _, offsets = text_buffer(whole.column(text_col))
            for a, b in groups_of_rows(offsets, SLICE_BYTES):
                batch = whole.slice(a, b - a)
                keys = batch.column(ROW_KEY)
                sizes, names, bits, every, known = [], [], [], [], set()
                for _, tokens in _sets(batch, text_col, n):
                    sizes.append(len(tokens))
                    names.append(_class(tokens))
                    bits.append(_sketch(tokens, percent))
                    if names[-1] not in known:
                        known.add(names[-1])
                        every.append(tokens)
                rows = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(sizes, pa.int32()), pa.array(names, pa.int64()),
                     pa.array(bits, sketches), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())],
                    names=[ROW_KEY, "n", "c", "sketch", "token", "seen"])
                token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
                common = count >= max(4, len(known) // 1000)
                token, count = token[common].view(np.int64), count[common]
                rows = len(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, sketches),
                     pa.array(token), pa.array(count, pa.int64())], names=[ROW_KEY, "n", "c", "sketch", "token", "seen"])

    return stored(keyed.select(ROW_KEY, text_col).mapInArrow(
        run, f"{ROW_KEY} long, n int, c long, sketch array<long>, token long, seen long"), "jaccard-sets")


def _prefixes(keyed: DataFrame, text_col: str, n: int, percent: int, common) -> DataFrame:
    """(token, c, n, pos, common) of the extended prefix of each set, once per class and slice."""
    def run(batches):
        late, weight = common.value
        for batch in sliced(batches):
            known, out = set(), []
            for _, tokens in _sets(batch, text_col, n):
                size, name = len(tokens), _class(tokens)
                if not size or name in known:
                    continue
                known.add(name)
                rank = np.zeros(size, np.int64)
                if len(late):
                    at = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
                    rank = np.where(late[at] == tokens, weight[at], 0)
                length = _prefix(size, percent)
                chosen = np.lexsort((tokens, rank))[:length]
                out.append((tokens[chosen], name, size, rank[chosen] > 0))
            if out:
                sizes = np.array([len(t[0]) for t in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([t[0] for t in out]).view(np.int64)),
                     pa.array(np.repeat(np.array([t[1] for t in out], np.int64), sizes)),
                     pa.array(np.repeat(np.array([t[2] for t in out], np.int32), sizes)),
                     pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes])),
                     pa.array(np.concatenate([t[3] for t in out]))],
                    names=["token", "c", "n", "pos", "common"])

    def sliced(batches):
        for batch in batches:
            _, offsets = text_buffer(batch.column(text_col))
            for a, b in groups_of_rows(offsets, SLICE_BYTES):
                yield batch.slice(a, b - a)

    return stored(keyed.select(ROW_KEY, text_col).mapInArrow(
        run, "token long, c long, n int, pos int, common boolean"), "jaccard-prefixes")


_MARKED = "token long, c long, n int, pos int, often boolean, other long"


def _shared_tokens(prefixes: DataFrame, percent: int) -> DataFrame:
    """(token, c, n, pos, often, other) of two kinds of rows.  Where ``other`` is null: a token that two classes
    have and one of these; ``often``: more than FREQUENT have it.  Else: two classes that meet under a rare token
    and can link.

    The tokens of the common list, few by its bound, are counted with combining in each task and never
    meet in one.  All others are placed by token once: a task reads them in order, drops lonely tokens and
    repeated rows, holds FREQUENT + 1 rows of a token at most, and compares the classes of a rare one at once.
    """
    def run(batches):
        held, token, last, often = [], None, None, False  # rows of the token at hand, while it may be lonely or rare
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        names = ["token", "c", "n", "pos", "often", "other"]

        def rows(values):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in values], t) for i, t in enumerate(types)], names=names)

        def pairs(held):
            for i, (_, c, n, pos) in enumerate(held):
                for _, d, m, at in held[i + 1:]:
                    # as _can_link, for single tokens
                    if (100 * n >= percent * m and 100 * m >= percent * n
                            and (min(n - pos, m - at) + 1) * (100 + percent) >= percent * (n + m)):
                        yield None, min(c, d), None, None, None, max(c, d)

        for batch in batches:
            at = batch.column("token").to_numpy()
            if not len(at):
                continue
            # Only rows of tokens that stand more than once, or at the edge of the batch, are looked at singly.
            same = at[1:] == at[:-1]
            many = np.zeros(len(at), bool)
            many[1:] |= same
            many[:-1] |= same
            many[0] = many[-1] = True
            part = batch.filter(pa.array(many))
            out = []
            for row in zip(*(part.column(i).to_pylist() for i in range(4))):
                if row[0] != token:
                    out += pairs(held)
                    held, token, last, often = [], row[0], None, False
                if row[1] == last:
                    continue
                last = row[1]
                if often:
                    out.append((*row, True, None))
                    continue
                held.append(row)
                if len(held) > FREQUENT:
                    often = True
                    out += [(*r, True, None) for r in held]
                    held = []
            if out:
                yield rows(out)
        out = list(pairs(held))
        if out:
            yield rows(out)

    columns = ["token", "c", "n", "pos"]
    rest = (prefixes.filter("NOT common").select(*columns).repartition("token").sortWithinPartitions("token", "c")
            .mapInArrow(run, _MARKED))
    common = prefixes.filter("common").select(*columns)
    counts = common.groupBy("token").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("m"))
    counts = counts.filter("a <> b").select("token", (F.col("m") > FREQUENT).alias("often"))
    common = common.join(F.broadcast(counts), "token")  # ORDERED_TOKENS rows at most
    common = common.dropDuplicates(["token", "c"]).select(*columns, "often", F.lit(None).cast("long").alias("other"))
    return stored(rest.unionByName(common), "jaccard-marked")


def _prefix(size: int, percent: int) -> int:
    """Length of the extended prefix of a set."""
    return min(size, size - (percent * size + 99) // 100 + 2)


def combined_size(percent: int) -> int:
    """The largest size up to which all prefixes hold COMBINED_PREFIX tokens at most."""
    size = 1
    while _prefix(size + 1, percent) <= COMBINED_PREFIX:
        size += 1
    return size


def _keys(rows: DataFrame, percent: int) -> DataFrame:
    """(key, c, n, pos, slack): what classes that share ``rows`` of tokens meet under.  ``slack`` is 1 where a
    shared token may stand before the key's place."""
    combined = combined_size(percent)
    single = rows.filter(~F.col("often") | (F.col("n") * 100 >= combined * percent)).select(
        F.xxhash64("token").alias("key"), "c", "n", "pos", F.lit(1).alias("slack"))
    lists = (rows.filter(F.col("often") & (F.col("n") <= combined)).groupBy("c", "n")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t")))  # at most a prefix
    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(
        F.slice("t", i + 2, F.size("t")), lambda y: F.struct(
            F.xxhash64(F.least(x["token"], y["token"]), F.greatest(x["token"], y["token"]), F.lit(2)).alias("key"),
            x["pos"].alias("pos")))))
    both = lists.select("c", "n", F.explode(pairs).alias("p")).select("p.key", "c", "n", F.col("p.pos").alias("pos"),
                                                                        F.lit(0).alias("slack"))
    keys = single.unionByName(both)
    sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(_rank()).alias("best"))
                   .filter("m > 1"), "jaccard-buckets")
    return stored(keys.join(sizes, "key"), "jaccard-keys")


_WIDE = "decimal(38,0)"


def _rank():
    """Few tokens of its own first, then the class: (pos, c) as one number."""
    return (F.col("pos").cast("decimal(10,0)") * F.expr("18446744073709551616BD")
            + (F.col("c").cast("decimal(20,0)") + F.expr("9223372036854775808BD"))).cast(_WIDE)


def _pivot():
    return (F.pmod(F.col("best"), F.expr("18446744073709551616BD")) - F.expr("9223372036854775808BD")).cast("long")


def _can_link(percent: int):
    """Sizes and places leave room for the overlap that the threshold asks for.

    Both sides have the same slack; naming both lets the two sides of a join be one exchange."""
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + F.greatest("x.slack", "y.slack")
    return ((room * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n")))
            & (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent))


def _meeting(x: DataFrame, y: DataFrame, percent: int, condition, near=None) -> DataFrame:
    condition = condition & _can_link(percent)
    if near is not None:
        condition = condition & near
    return (x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & condition)
            .select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct())


def _wanted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, _k) of the classes in ``pairs``, each with the document that stands for it."""
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = stored(wanted.join(classes.select("c", F.col("rep").alias(ROW_KEY)), "c"), "jaccard-wanted")
    # two numbers a row; a larger table is joined by a shuffle
    return F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted


def _near(na, nb, sa, sb, percent: int):
    """Sizes and sketches allow the two sets to be similar; true of every similar pair.

    Folding a sketch in the middle gives that of half the length.  Where one is longer still, sizes differ too
    much already.
    """
    width = F.least(F.size(sa), F.size(sb))
    fold = lambda s: F.when(F.size(s) == width, s).otherwise(F.zip_with(
        F.slice(s, 1, width), F.slice(s, width + 1, width), lambda x, y: x.bitwiseXOR(y)))
    sa, sb = fold(sa), fold(sb)
    apart = F.aggregate(F.zip_with(sa, sb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (na + nb - apart) * (100 + percent) >= 2 * percent * (na + nb)


def _possible(pairs: DataFrame, described: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sizes and sketches allow to be similar; no similar pair is lost."""
    pairs = stored(pairs, "jaccard-pairs")
    known = stored(described.select(ROW_KEY, "n", "sketch").join(_wanted(pairs, classes), ROW_KEY).drop(ROW_KEY), "jaccard-sketches")
    x, y = known.alias("x"), known.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.c")).join(y, F.col("b") == F.col("y.c"))
    near = _near(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch"), percent)
    return stored(both.filter(near).select("a", "b"), "jaccard-possible")


def _verified(pairs: DataFrame, keyed: DataFrame, classes: DataFrame, text_col: str, n: int, percent: int) -> DataFrame:
    """The pairs (a stored table) whose whole sets are similar."""
    wanted = _wanted(pairs, classes)

    def run(batches):
        for batch in batches:
            names = batch.column("c").to_pylist()
            for i, tokens in _sets(batch, text_col, n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i]], pa.int64()), pa.array([tokens.view(np.int64)], pa.list_(pa.int64()))],
                    names=["c", "tokens"])

    sets = stored(keyed.select(ROW_KEY, text_col).join(wanted, ROW_KEY).select("c", text_col)
                  .mapInArrow(run, "c long, tokens array<long>"), "jaccard-whole")
    both = (pairs.join(sets.select(F.col("c").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("tb")), "b"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return stored(both.withColumn("i", shared).filter(
        F.col("i") * (100 + percent) >= percent * (F.size("ta") + F.size("tb"))).select("a", "b"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every node of ``edges`` (a, b): the smallest node that it is connected with.

    Labels take the smallest of their neighbours' and then follow their own label's label, until nothing
    changes; each round is written, so a lost executor repeats one round at most.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "component-edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                    .select("v", F.least("v", "m").alias("label")), "component-labels")
    while True:
        near = stored(both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m")), "component-near")
        step = stored(labels.join(near, labels["v"] == near["a"]).select(
            "v", F.col("label").alias("was"), F.least("label", "m").alias("label")), "component-step")
        follow = step.select(F.col("v").alias("label"), F.col("label").alias("next"))
        moved = stored(step.join(follow, "label").select("v", "was", F.least("label", "next").alias("label")), "component-labels")
        labels = moved.select("v", "label")
        if not moved.filter("was <> label").limit(1).count():
            return labels


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id.

    Words are runs of anything but 0x20 and 0x09-0x0D after lower-casing A-Z; a set holds the distinct runs
    of ``n`` words, or the whole sequence if that is shorter.  Documents link when 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id that links lead to.  A missing or wordless text
    has an empty set and links with nothing; repeated rows have equal sets and link; a missing id counts as
    smallest; extra columns are not looked at; an empty table gives none.

    Tokens and sets are compared by 64-bit fingerprints.
    """
    keyed = with_row_key(docs, id_col, text_col)
    spark = docs.sparkSession
    described = _described(keyed[0], text_col, n, percent)
    members = described.filter(f"{ROW_KEY} IS NOT NULL").select(ROW_KEY, "n", "c")
    late = (described.filter("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen"))
            .orderBy(F.desc("seen"), "token").limit(ORDERED_TOKENS).collect())
    order = sorted((r["token"] & 0xFFFFFFFFFFFFFFFF, r["seen"]) for r in late)
    common = spark.sparkContext.broadcast((np.array([t for t, _ in order], np.uint64), np.array([s for _, s in order], np.int64)))
    classes = stored(members.filter("n > 0").groupBy("c").agg(F.min(ROW_KEY).alias("rep"), F.count(F.lit(1)).alias("size")),
                     "jaccard-classes")
    marked = _shared_tokens(_prefixes(keyed[0], text_col, n, percent, common), percent)
    keys = _keys(marked.filter("other IS NULL").drop("other"), percent)
    small, large = keys.filter(F.col("m") <= FREQUENT), keys.filter(F.col("m") > FREQUENT)
    pivots = large.filter(F.col("c") == _pivot())
    met = _meeting(small, small, percent, F.col("x.c") < F.col("y.c")).unionByName(
        _meeting(large, pivots, percent, F.col("x.c") != F.col("y.c"))).unionByName(
        marked.filter("other IS NOT NULL").select(F.col("c").alias("a"), F.col("other").alias("b"))).distinct()
    met = _possible(met, described, classes, percent)
    links = _verified(met, keyed[0], classes, text_col, n, percent)
    label = components(links)
    # what the pivots left apart
    placed = large.join(label.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    placed = stored(placed, "jaccard-placed")
    apart = stored(placed.groupBy("key").agg(F.min("label").alias("u"), F.max("label").alias("w"))
                   .filter("u <> w").select("key"), "jaccard-apart")
    rest = placed.join(apart, "key", "left_semi").select("key", "c", "n", "pos", "slack", "label")
    rest = stored(rest.join(classes.select("c", F.col("rep").alias(ROW_KEY)), "c")
                  .join(described.select(ROW_KEY, "sketch"), ROW_KEY).drop(ROW_KEY), "jaccard-rest")
    near = _near(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch"), percent)
    more = _meeting(rest, rest, percent, (F.col("x.c") < F.col("y.c")) & (F.col("x.label") != F.col("y.label")), near)
    more = stored(more.join(met, ["a", "b"], "left_anti"), "jaccard-more")
    if more.limit(1).count():
        again = _verified(more, keyed[0], classes, text_col, n, percent)
        label = components(links.unionByName(again))
    group = classes.join(label.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    group = stored(group, "jaccard-grouped")
    least = stored(group.groupBy("label").agg(F.min("rep").alias("component"), F.sum("size").alias("all")).filter("all > 1"),
                   "jaccard-components")
    named = stored(group.join(least, "label").select("c", "component"), "jaccard-named")
    result = members.join(named, "c", "left").select(
        ROW_KEY, F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", ROW_KEY).alias("component"))
    if keyed[1]:
        names = keyed[0].select(F.col(ROW_KEY).alias("component"), F.col(id_col).alias("component_id"))
        result = result.join(names, "component").drop("component")
    else:
        result = result.withColumnRenamed("component", "component_id")
    return with_ids(result, keyed, id_col).select(id_col, "n_shingles", "component_id")
