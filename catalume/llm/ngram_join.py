"""N-gram Jaccard join: which documents' shingle sets overlap by the threshold or more, and the components they form.

Equal sets are one class. Shingles have a global order, the rarest first; two sets that reach the threshold share a shingle
among the first (1 - threshold) of each, so these prefixes are the index lists. Set relations save most of the work without
changing the result:

* Shingles that only one class holds are counted but never listed; most prefixes consist of them.
* A list is cut into blocks by set size and position. A class is held against blocks, not against their members, and blocks
  whose sizes and positions cannot reach the threshold are skipped.
* Classes join the family of the class that leads most of their lists. A family is compared within itself, in bands of set
  size of which only neighbours can link, and with single classes of smaller families that share an unskipped block.
* In a comparison the answers of one set, the hub, are computed once. Those of another set follow from them by the shingles
  in which it differs from the hub, for all partners in one matrix product.

Nothing is ever emitted for a pair that does not link. Families are cut into blocks of ``block`` classes or ``most``
shingles, so no task holds a family. The same comparisons count links and connect components.

Document frequencies are exact and come from packed rows: a chunk (a bounded run of documents of one task) sends each of its
shingles once, with its owner or a list kept with the chunk, to the shingle's hash range, and gets back those that others
hold as well. Chunks are told by task and number, so the input must give its rows in the same order when read again, as files
do. Shingles are 48-bit and classes 64-bit hashes.

Defined results: null, empty and blank texts have no shingles and no links; fewer words than a shingle are one shingle; each
row is a document by itself, also where rows share a doc_id; exact copies are linked with each other and with all that one of
them is linked with; a null doc_id takes part, but never names a component; texts of any length are read whole; ties cannot
arise; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm.common import Scratch, fresh, load, scramble, slices, task_count, windows, word_hash
from catalume.llm.components import components

KEY_BITS, DOC_BITS = 48, 16
RANGE_SHINGLES = 2 << 20


def shingle_runs(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The 48-bit shingle hashes of all texts, repeated ones included, and the text each belongs to."""
    words, counts = [], []
    for text in texts:
        own = (text or b"").lower().split()
        words += own
        counts.append(len(own))
    hashes, counts = word_hash().array(words), np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    keys, owners = [], []
    if len(hashes) >= width:
        start = np.flatnonzero(owner[: len(owner) - width + 1] == owner[width - 1 :])
        keys.append(windows(hashes, width)[start])
        owners.append(owner[start])
    first = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        keys.append(windows(hashes[first[i] : first[i] + counts[i]], width))
        owners.append(np.array([i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys) >> np.uint64(64 - KEY_BITS), np.concatenate(owners)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingle_runs([text or b""], width)[0])


def packed(keys: np.ndarray) -> bytes:
    """Sorted integers as differences, equal-ranked bytes together (shuffles compress the zeros)."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    wide = "<u8" if len(gaps) and int(gaps.max()) >> 32 else "<u4"
    return wide[-1].encode() + gaps.astype(wide).view(np.uint8).reshape(-1, int(wide[-1])).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = int(data[:1])
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(wide, -1).T).view(f"<u{wide}").reshape(-1)
    return np.cumsum(gaps.astype(np.uint64), dtype=np.uint64)


def set_marks(keys: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's set, from distinct (key, document) pairs in any order; 0 for empty sets."""
    held = np.flatnonzero(sizes)
    out = [np.zeros(len(sizes), np.uint64) for _ in range(2)]
    if len(held):
        own = keys[np.argsort(owner.astype(np.uint16), kind="stable")]
        start = (np.cumsum(sizes) - sizes)[held]
        for i, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            with np.errstate(over="ignore"):
                out[i][held] = scramble(np.add.reduceat(scramble(own * np.uint64(2) + np.uint64(salt)), start) + sizes[held].astype(np.uint64))
    return out[0].view(np.int64), out[1].view(np.int64)


FIELDS = ["r", "chunk", "kind", "doc_id", "copy", "n", "c1", "c2", "a", "b", "c"]
SCHEMA = "r int, chunk long, kind int, doc_id long, copy long, n long, c1 long, c2 long, a binary, b binary, c binary"
DOCUMENT, CHUNK, ASKED, ANSWERED = range(4)


def rows_of(**columns) -> pa.RecordBatch:
    """A batch of SCHEMA; columns that are not given are null."""
    n = max(len(x) for x in columns.values() if not isinstance(x, int))
    kinds = {"r": pa.int32(), "kind": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}
    out = []
    for name in FIELDS:
        x, kind = columns.get(name), kinds.get(name, pa.int64())
        out.append(pa.nulls(n, kind) if x is None else pa.array(np.full(n, x), kind) if isinstance(x, int) else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(out, FIELDS)


def requests(docs: DataFrame, width: int, ranges: int, chunk_shingles: int = 1 << 20) -> DataFrame:
    """Rows of SCHEMA for ``docs`` (doc_id, copy, text): each document; each chunk's sets and lists; its shingles by range."""

    def close(chunk: int, parts: list):
        ids, copies, keys, owners = (np.concatenate([p[i] for p in parts]) for i in range(4))
        valid = np.concatenate([p[4] for p in parts])
        docs = len(ids)
        pairs = np.unique((keys << np.uint64(DOC_BITS)) | owners.astype(np.uint64))
        keys, owner = pairs >> np.uint64(DOC_BITS), (pairs & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
        sizes = np.bincount(owner, minlength=docs)
        c1, c2 = set_marks(keys, owner, sizes)
        yield rows_of(r=ranges + (chunk + (chunk >> 24)) % ranges, chunk=chunk, kind=DOCUMENT, doc_id=pa.array(ids, mask=~valid), copy=copies, n=sizes, c1=c1, c2=c2)
        _, first, same = np.unique(c1, return_index=True, return_inverse=True)
        keep = first[same][owner] == owner  # of equal sets in the chunk, one takes part
        keys, owner = keys[keep], owner[keep]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(start, append=len(keys))
        listed = times > 1
        members = owner[np.repeat(listed, times)]
        who = owner[start] if len(start) else owner
        who = np.where(listed, docs + np.cumsum(listed) - 1, who).astype("<u4")
        yield rows_of(
            r=ranges + (chunk + (chunk >> 24)) % ranges, chunk=chunk, kind=CHUNK, a=[np.stack([sizes, c1]).astype("<i8").tobytes()], b=[times[listed].astype("<u4").tobytes()], c=[members.astype("<u4").tobytes()]
        )
        keys = keys[start]
        cut = [0, *np.searchsorted(keys, [((i << KEY_BITS) + ranges - 1) // ranges for i in range(1, ranges)]).tolist(), len(keys)]
        own = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cut, cut[1:])) if lo < hi]
        for some in (own[i : i + 256] for i in range(0, len(own), 256)):
            yield rows_of(
                r=[i for i, _, _ in some], chunk=chunk, kind=ASKED, a=[packed(keys[lo:hi]) for _, lo, hi in some],
                b=[who[lo:hi].tobytes() for _, lo, hi in some], c=[times[lo:hi].astype("<u4").tobytes() for _, lo, hi in some],
            )

    def task(batches):
        part, made, parts, docs, size = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in slices(batches, 2 << 20, 8192):
            keys, owner = shingle_runs(batch.column("text").cast(pa.binary()).to_pylist(), width)
            if parts and (size + len(keys) > chunk_shingles or docs + batch.num_rows >= 1 << DOC_BITS):
                yield from close((part << 24) + made, parts)
                parts, docs, size, made = [], 0, 0, made + 1
            ids = batch.column("doc_id")
            found = [np.asarray(x) for x in (ids.fill_null(0), batch.column("copy"))]
            parts.append((*found, keys, owner + docs, np.asarray(ids.is_valid())))
            docs, size = docs + batch.num_rows, size + len(keys)
        if parts:
            yield from close((part << 24) + made, parts)

    return docs.mapInArrow(task, SCHEMA)


def tally(table: pa.Table) -> pa.Table:
    """A range's shingles that more than one class holds, with their document frequencies, for each chunk that asked."""
    if table.column("kind")[0].as_py() != ASKED:
        return table
    keys = [unpacked(x) for x in table.column("a").to_pylist()]
    owners, times = ([np.frombuffer(x, "<u4") for x in table.column(c).to_pylist()] for c in ("b", "c"))
    ends = np.cumsum([len(k) for k in keys])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    held = np.add.reduceat(np.concatenate(times).astype(np.int64)[order], start)
    df = np.empty(len(flat), np.int64)
    df[order] = np.repeat(held, np.diff(start, append=len(flat)))
    out = []
    for i, hi in enumerate(ends):
        own = df[hi - len(keys[i]) : hi]
        shared = own > 1
        out.append((packed(keys[i][shared]), owners[i][shared].tobytes(), np.minimum(own[shared], 0xFFFFFFFF).astype("<u4").tobytes()))
    a, b, c = zip(*out, strict=True)
    return pa.Table.from_batches([rows_of(chunk=np.asarray(table.column("chunk")), kind=ANSWERED, a=a, b=b, c=c)])


def prefix_lists(rows: DataFrame, num: int, den: int) -> DataFrame:
    """token, cls, n, pos: the shared shingles in the prefix of each class, its set size and the shingle's position."""

    def chunk(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_pylist()
        own = kind.index(CHUNK)
        a, b, c = (table.column(x)[own].as_py() for x in "abc")
        sizes, marks = np.frombuffer(a, "<i8").reshape(2, -1)
        lengths, members = np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(c, "<u4").astype(np.int64)
        offsets = np.cumsum(lengths) - lengths
        keys, owners, dfs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, k in enumerate(kind):
            if k == ANSWERED:
                key, who, df = unpacked(table.column("a")[i].as_py()), np.frombuffer(table.column("b")[i].as_py(), "<u4").astype(np.int64), np.frombuffer(table.column("c")[i].as_py(), "<u4")
                single = who < len(sizes)
                lists = who[~single] - len(sizes)
                times = lengths[lists]
                at = np.repeat(offsets[lists] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                keys += [key[single], np.repeat(key[~single], times)]
                owners += [who[single], members[at]]
                dfs += [df[single], np.repeat(df[~single], times)]
        key, doc, df = np.concatenate(keys), np.concatenate(owners), np.concatenate(dfs)
        order = np.lexsort((key, df, doc))
        key, doc = key[order], doc[order]
        shared = np.bincount(doc, minlength=len(sizes))
        n = sizes[doc]
        pos = n - shared[doc] + np.arange(len(doc)) - (np.cumsum(shared) - shared)[doc]
        keep = pos < n - (n * num + den - 1) // den + 1
        return pa.table({"token": key[keep].view(np.int64), "cls": marks[doc[keep]], "n": n[keep], "pos": pos[keep]})

    found = rows.where(F.col("kind").isin(CHUNK, ANSWERED)).groupBy("chunk").applyInArrow(chunk, "token long, cls long, n long, pos long")
    return found.dropDuplicates(["token", "cls"])


def feasible(n, pos, m, qos, num: int, den: int):
    """Whether sets of sizes n and m with a common shingle at these positions can reach the threshold."""
    both = F.least(pos, qos) + 1 + F.least(n - pos - 1, m - qos - 1)
    return (n * den >= m * num) & (m * den >= n * num) & (both * (num + den) >= (n + m) * num)


def families(lists: DataFrame, scratch: Scratch, num: int, den: int, rounds: int = 4) -> DataFrame:
    """cls, n, fam for the classes that share lists. Any labels give right results; good ones keep comparisons few."""
    votes = lists.where((F.col("cls") != F.col("head.cls")) & feasible(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos"), num, den))
    votes = votes.groupBy("cls", F.col("head.cls").alias("up")).agg(F.count("*").alias("v"))
    up = scratch.save(votes.groupBy("cls").agg(F.max_by("up", F.struct("v", "up")).alias("up")), "votes")
    for _ in range(rounds):  # a leader's own leader is taken; leaders have smaller hashes, so there are no cycles
        above = up.select(F.col("cls").alias("up"), F.col("up").alias("top"))
        after = scratch.save(up.join(above, "up", "left").select("cls", F.coalesce("top", "up").alias("up")), "votes")
        scratch.drop(up)
        up = after
    return lists.groupBy("cls").agg(F.first("n").alias("n")).join(up, "cls", "left").select("cls", "n", F.coalesce("up", "cls").alias("fam"))


def dealt(lists: DataFrame, scratch: Scratch, block: int, most: int, num: int, den: int) -> DataFrame:
    """g, side, cls: the comparisons; sides 0 and 1 are held against each other, side 2 against itself."""
    member = families(lists, scratch, num, den)
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)) + 1e-9).cast("int")  # sets two bands apart cannot link
    member = scratch.save(member.withColumn("band", band), "families")
    cut = F.ceil(F.greatest(F.count("*") / float(block), F.sum("n") / float(most))).cast("int")
    blocks = member.groupBy("fam", "band").agg(cut.alias("k"), F.count("*").alias("m"))
    size = member.groupBy("fam").agg(F.count("*").alias("size"))
    blocks = scratch.save(blocks.join(size, "fam"), "blocks")

    own = member.join(blocks, ["fam", "band"]).where("size > 1").withColumn("p", F.expr("cast(pmod(xxhash64(cls), k) as int)"))
    near = blocks.select("fam", F.col("band").alias("_band"), F.col("k").alias("_k"))
    up = near.select("fam", (F.col("_band") - 1).alias("band"), F.col("_k").alias("above"))
    down = near.select("fam", (F.col("_band") + 1).alias("band"), F.col("_k").alias("below"))
    own = own.join(up, ["fam", "band"], "left").join(down, ["fam", "band"], "left")
    turns = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda q: F.struct(F.when(q == F.col("p"), 2).otherwise((q < F.col("p")).cast("int")).alias("side"), F.xxhash64("fam", "band", F.lit(0), F.least(q, "p"), F.greatest(q, "p")).alias("g"))),
        F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda q: F.struct(F.lit(0).alias("side"), F.xxhash64("fam", "band", F.lit(1), "p", q).alias("g")))).otherwise(F.array()),
        F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda q: F.struct(F.lit(1).alias("side"), F.xxhash64("fam", F.col("band") - 1, F.lit(1), q, "p").alias("g")))).otherwise(F.array()),
    )
    inside = own.where("m > 1 or above > 0 or below > 0").select("cls", F.explode(turns).alias("x")).select("x.g", "x.side", "cls")

    named = lists.drop("head").join(member.drop("n").join(size, "fam"), "cls")
    named = scratch.save(named, "named")
    held = named.groupBy("token", "fam", "band", "size").agg(*(f("n").alias(f"n_{i}") for i, f in enumerate((F.min, F.max))), *(f("pos").alias(f"pos_{i}") for i, f in enumerate((F.min, F.max))))
    several = held.groupBy("token").agg(F.min("fam").alias("x"), F.max("fam").alias("y")).where("x < y").select("token")
    held = held.join(several, "token").select("token", F.col("fam").alias("to"), F.col("band").alias("at"), F.col("size").alias("many"), "n_0", "n_1", "pos_0", "pos_1")
    both = F.least("pos", "pos_1") + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n_1") - F.col("pos_0") - 1)
    visits = named.join(held, "token").where(
        ((F.col("size") < F.col("many")) | ((F.col("size") == F.col("many")) & (F.col("fam") < F.col("to"))))
        & (F.col("n") * den >= F.col("n_0") * num) & (F.col("n_1") * den >= F.col("n") * num)
        & (both * (num + den) >= (F.col("n") + F.col("n_0")) * num)
    )
    visits = scratch.save(visits.select("cls", "n", "to", "at").distinct(), "visits")
    guests = visits.groupBy("to", "at").agg(cut.alias("kv"))
    hosts = guests.join(blocks.select(F.col("fam").alias("to"), F.col("band").alias("at"), "k"), ["to", "at"])
    hosts = scratch.save(hosts, "hosts")
    coming = visits.join(hosts, ["to", "at"]).withColumn("v", F.expr("cast(pmod(xxhash64(cls), kv) as int)"))
    coming = coming.select("cls", F.lit(0).alias("side"), "to", "at", "v", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("q"))
    home = member.select("cls", F.col("fam").alias("to"), F.col("band").alias("at")).join(hosts, ["to", "at"]).withColumn("q", F.expr("cast(pmod(xxhash64(cls), k) as int)"))
    home = home.select("cls", F.lit(1).alias("side"), "to", "at", F.explode(F.sequence(F.lit(0), F.col("kv") - 1)).alias("v"), "q")
    across = coming.unionByName(home).select(F.xxhash64("to", "at", F.lit(2), "v", "q").alias("g"), "side", "cls")
    return inside.unionByName(across)


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], same: bool, slab: int = 4096) -> np.ndarray:
    """|x & y| for each x and y (sorted arrays); for ``same``, which means that ys is xs, the diagonal is left undefined.

    The hub is the first x. |x & y| = |hub & y| + |(x - hub) & y| - |(hub - x) & y|, so a set close to the hub needs only
    its few differences; a set that differs in more shingles than it has is counted directly.
    """
    hub = xs[0]
    flat, owner = np.concatenate(ys), np.repeat(np.arange(len(ys)), [len(y) for y in ys])

    def inside(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
        return whole[np.minimum(np.searchsorted(whole, part), len(whole) - 1)] == part

    base = np.bincount(owner[inside(hub, flat)], minlength=len(ys))
    derived, gains, losses = np.zeros(len(xs), bool), [], []
    for i, x in enumerate(xs):
        common = inside(hub, x)
        derived[i] = len(hub) - int(common.sum()) < int(common.sum())
        gains.append(x[~common] if derived[i] else x)
        losses.append(hub[~inside(x, hub)] if derived[i] else hub[:0])
    out = base[None, :] * derived[:, None].astype(np.int64)
    ranked = np.sort(flat)
    known = ranked[:-1][ranked[1:] == ranked[:-1]] if same else ranked  # a gain that only its own set holds adds nothing
    pool = np.union1d(np.intersect1d(np.concatenate(gains), known), np.intersect1d(np.concatenate(losses), ranked))
    if not len(pool):
        return out
    steps = []
    for sign, parts in ((1, gains), (-1, losses)):
        own, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        found = inside(pool, own)
        steps.append((row[found], np.searchsorted(pool, own[found]), sign))
    found = inside(pool, flat)
    row_y, at_y = owner[found], np.searchsorted(pool, flat[found])
    for lo in range(0, len(pool), slab):
        left, right = np.zeros((len(xs), slab), np.float32), np.zeros((len(ys), slab), np.float32)
        for row, at, sign in steps:
            near = (at >= lo) & (at < lo + slab)
            left[row[near], at[near] - lo] = sign
        near = (at_y >= lo) & (at_y < lo + slab)
        right[row_y[near], at_y[near] - lo] = 1
        out = out + np.rint(left @ right.T).astype(np.int64)
    return out


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each row and then each column of a link matrix the first node of its component in it."""
    n, m = linked.shape
    label = np.arange(n + m)
    while True:
        before = label
        rows = np.where(linked, label[None, n:], n + m).min(axis=1, initial=n + m)
        label = np.concatenate([np.minimum(label[:n], rows), label[n:]])
        columns = np.where(linked, label[:n, None], n + m).min(axis=0, initial=n + m)
        label = np.concatenate([label[:n], np.minimum(label[n:], columns)])
        label = label[label]
        if (label == before).all():
            return label


def compared(docs: DataFrame, classes: DataFrame, plan: DataFrame, scratch: Scratch, width: int, num: int, den: int, every: bool) -> DataFrame:
    """a, b, w. Rows with b: links between classes (``every``), or enough of them to connect all that are linked; rows
    without b: w documents are linked with class a, to be summed.
    """
    near = scratch.save(plan.join(classes.select(F.col("c1").alias("cls"), "rep", "copies"), "cls").select("g", "side", "cls", "copies", "rep.*"), "dealt")
    wanted = near.select(*[F.col(c).alias(f"_{c}") for c in near.columns])
    side = F.broadcast(wanted) if near.count() <= 200_000 else wanted  # beyond, both sides are shuffled
    rows = docs.join(side, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("copy") == F.col("_copy")))
    rows = rows.select(F.col("_g").alias("g"), F.col("_side").alias("side"), F.col("_cls").alias("cls"), F.col("_copies").alias("copies"), "text")

    def group(table: pa.Table) -> pa.Table:
        sides: tuple[dict, dict, dict] = ({}, {}, {})
        for side, cls, copies, text in zip(table.column("side").to_pylist(), table.column("cls").to_pylist(), table.column("copies").to_pylist(), table.column("text").cast(pa.binary()), strict=True):
            if cls not in sides[side]:  # repeated rows
                sides[side][cls] = copies, shingle_set(text.as_py(), width)
        same = bool(sides[2])
        left, right = (sides[2], sides[2]) if same else sides[:2]
        if not left or not right:
            return pa.table({c: np.zeros(0, np.int64) for c in "abw"})
        (a, v, xs), (b, w, ys) = (([*s], *zip(*s.values(), strict=True)) for s in (left, right))
        a, b, v, w = (np.array(x, np.int64) for x in (a, b, v, w))
        n, m = (np.array([len(x) for x in sets], np.int64) for sets in (xs, ys))
        both = overlaps([*xs], [*ys], same)
        linked = den * both >= num * (n[:, None] + m[None, :] - both)
        if same:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(np.triu(linked) if same else linked)
        counts = [(a, linked @ w)] if same else [(a, linked @ w), (b, linked.T @ v)]
        ids, sums = (np.concatenate(x) for x in zip(*counts, strict=True))
        some = sums > 0
        if every:
            edges = a[i], b[j]
        else:
            label, nodes = spanning(linked), np.concatenate([a, b])
            off = label != np.arange(len(nodes))
            edges = nodes[off], nodes[label[off]]
        none = pa.nulls(int(some.sum()), pa.int64()), pa.nulls(len(edges[0]), pa.int64())
        columns = [(pa.array(edges[0]), pa.array(ids[some])), (pa.array(edges[1]), none[0]), (none[1], pa.array(sums[some]))]
        return pa.table([pa.concat_arrays(x) for x in columns], names=["a", "b", "w"])

    return scratch.save(rows.groupBy("g").applyInArrow(group, "a long, b long, w long"), "links")


def joined(docs: DataFrame, width: int, num: int, den: int, block: int, most: int, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, copy, n, c1), their classes (c1, copies, component, linked) and the rows of compared()."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(4 * task_count(spark), size // 6 // RANGE_SHINGLES)
    rows = scratch.save(requests(docs, width, ranges).groupBy("r").applyInArrow(tally, SCHEMA), "rows")
    lists = scratch.save(prefix_lists(rows, num, den), "prefixes")
    heads = lists.groupBy("token").agg(F.min(F.struct("cls", "n", "pos")).alias("head"), F.max("cls").alias("last")).where("head.cls < last")
    shared = scratch.save(lists.join(heads.drop("last"), "token"), "lists")
    scratch.drop(lists)
    texts = rows.where(F.col("kind") == DOCUMENT).select("doc_id", "copy", "n", "c1", "c2")
    classes = texts.where("n > 0").groupBy("c1").agg(F.min(F.struct("doc_id", "copy")).alias("rep"), F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = scratch.save(classes, "classes")
    plan = dealt(shared, scratch, block, most, num, den)
    found = compared(docs, classes, plan, scratch, width, num, den, every)
    roots = scratch.save(components(found.where("b is not null").select("a", "b"), scratch), "components")
    ids = classes.join(roots, F.col("c1") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c1"))
    least = ids.groupBy("root").agg(F.min("first").alias("component"))
    linked = found.where("b is null").groupBy(F.col("a").alias("c1")).agg(F.sum("w").alias("linked"))
    place = ids.join(least, "root").join(linked, "c1", "left")
    place = place.select("c1", "copies", "component", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("linked"))
    return texts, scratch.save(place, "place"), found


def placed(texts: DataFrame, place: DataFrame, *more) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links and the columns ``more`` for each document."""
    out = texts.join(place, "c1", "left")
    held = F.col("n") > 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(held, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(held, F.col("linked")).otherwise(0).cast("long").alias("n_links"), *more,
    )


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, block: int = 256, most: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (the other documents that it is linked with) for each row of ``docs``
    (doc_id, text); links have Jaccard similarity >= num / den.
    """
    texts, place, _ = joined(docs, width, num, den, block, most)
    return placed(texts, place)


def near_duplicate_links(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, block: int = 256, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """All links between classes of equal sets (a < b: class ids), and near_duplicates() with each document's class_id."""
    texts, place, found = joined(docs, width, num, den, block, most, every=True)
    links = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links, placed(texts, place, F.when(F.col("n") > 0, F.col("c1")).alias("class_id"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` but those that are near duplicates of a smaller doc_id; rows with a null doc_id stay."""
    key, copy = fresh(docs, "_id", "_copy")
    texts, place, _ = joined(docs, **{"width": 5, "num": 4, "den": 5, "block": 256, "most": 1 << 20} | how)
    gone = placed(texts, place, "copy").where("component_id < doc_id").select(F.col("doc_id").alias(key), F.col("copy").alias(copy)).distinct()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(key)) & (own == F.col(copy)), "left_anti")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "doc_id", "text"))
