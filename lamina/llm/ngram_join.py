"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles.  All documents put their shingles in
one order, estimated rare ones first.  With t = ceil(0.8 n) the first n - t + l shingles of
two similar documents have at least min(l, l') in common, so each document picks its own l:
the one with the fewest estimated candidates, documents that share l shingles of a prefix
whose lists hold s entries being s / l at most.  Pairs with too few common prefix shingles are
never verified.

Places in that order rule out more.  Documents of n and m shingles are similar if
4 / 9 (n + m) are common, so their i-th common shingle has that many less i - 1 behind it on both sides.
The first l common shingles of a document with one that is no smaller lie among its first
n - ceil(8 / 9 n) + l: lone documents are indexed by these only and probed by larger ones.  So
documents that share only a common passage, behind their own rare shingles, don't meet at
all, and the cost that picks l counts only the places that can meet.

A group of thousands of near copies has millions of similar pairs, but its component needs
only a spanning tree.  So candidates are first verified against one leader of each prefix
shingle, and only documents that this leaves in different components meet in full: each
document of the smaller component against blocks of the larger one, and each lone document
against blocks of lone ones that have a common prefix shingle.  Exact overlaps with a block are
counted inside one task.  No pair inside a component is ever written.

Most candidates are not similar, and the sets of shingles are the bulk of what could move.  So each set
has a sketch of 2 to 4 bits a shingle: the parity of its shingles in each of so many cells.  Two sketches
differ in no more cells than the sets do in shingles, which are a ninth of both sizes at most if the sets are
similar.  Sketches meet first, and only sets that are left over move for the exact count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import textmath as tm
from lamina.llm.shared import connected_components, discard, fresh_path, packed, partitions, stage, stage_at, unpacked

#: Shingles the frequency estimate keeps at most (the order of others is by hash alone).
FREQUENT = 1 << 17
FLUSH = 1_500_000
#: Shingle hashes in one block of a component or of lone documents.
BLOCK = 1 << 15
#: The map of wanted keys that tasks get has 2 ** MAP bits at most, and pages of so many.
MAP, PAGE = 26, 1 << 15


def _frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles estimated to be in most documents, sorted by hash, and their counts.

    It only ranks shingles, so any estimate gives right results: each task counts what it
    sees, shingles it saw three times are summed over tasks, the FREQUENT commonest stay.
    """

    def count(batches):
        held, size, seen = [], 0, set()

        def out():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= 3
            return pa.RecordBatch.from_arrays([pa.array(g[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], ["g", "c"])

        for batch in batches:
            for _, raw, offs in tm.slices(batch.column(0)):
                rows, g, n = tm.shingle_sets(raw, offs, k)
                digest = _digest(g, n)
                fresh = np.array([n[i] > 0 and not (d in seen or seen.add(d)) for i, d in enumerate(digest.tolist())], bool)
                held.append(g[fresh[rows]])
                size += len(held[-1])
                if size > 4 * FLUSH:
                    yield out()
                    held, size, seen = [], 0, set()
        if held:
            yield out()

    top = (
        docs.select("text").mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where("c >= 16")
        .orderBy(F.desc("c"), "g").limit(FREQUENT).toArrow()
    )
    g, c = top["g"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(g)
    return g[order], c[order]


def _digest(g: np.ndarray, n: np.ndarray, salt: int = 0xA5A5A5A5) -> np.ndarray:
    """A 64-bit name of each set: rows with equal sets have equal names."""
    total = np.r_[np.uint64(0), np.cumsum(tm.mix(g ^ np.uint64(salt)), dtype=np.uint64)]
    ends = np.r_[0, np.cumsum(n)]
    return tm.mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64) * tm.PLACE[13]).view(np.int64)


def _named(g: np.ndarray, n: np.ndarray, odd: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The name of each set and 64 more bits that tell sets of one name apart; names in ``odd`` give way to one of both."""
    name, check = _digest(g, n) >> np.int64(64 - bits), _digest(g, n, 0x3C3C3C3C5A5A5A5A)
    if len(odd):
        both = tm.mix(name.view(np.uint64) ^ tm.mix(check.view(np.uint64))).view(np.int64)
        name = np.where(np.isin(name, odd), both, name)
    return name, check


def _lengths(n: np.ndarray, est: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The multi-match count l of sets of size n with the fewest estimated candidates."""
    total = np.r_[0.0, np.cumsum(est - 1.0)]  # partners of each shingle besides the set itself
    least = (4 * n + 4) // 5
    ells = np.stack([np.minimum(1 + n // k, np.maximum(least, 1)) for k in (32, 16, 8)])
    # Partners of about n shingles: the l-th common one is among the first n / 9 + l.
    reach = np.minimum(begin[:-1] + n - (8 * n + 8) // 9 + ells, begin[1:])
    cost = (total[reach] - total[begin[:-1]]) / ells
    return ells[cost.argmin(0), np.arange(len(n))]


def _at_least(n: str = "n"):
    """The least l that a set similar to one of size n can have (a column)."""
    return 1 + F.floor(F.floor(F.col(n) * 4 / 5) / 32)


#: Places are exact up to so many shingles, beyond it in shares of the set's size.
EXACT = 65_535


def _room(n: str = "n", place: str = "place"):
    """The most shingles a document has at and after a place (a column)."""
    at = F.when(F.col(n) <= EXACT, F.col(place)).otherwise(F.floor(F.col(place) * F.col(n) / EXACT))
    return (F.col(n) - at).cast("long")


def _prefixes(docs: DataFrame, frequent, k: int, buckets: int, odd: np.ndarray, bits: int) -> DataFrame:
    """One row for each document: ``doc_id, n, node, check``, and packed prefix shingles by bucket.

    A set that a task meets again is not packed again; ``node`` names the set (see ``_named``).
    """

    def run(batches):
        fg, fc = frequent.value
        held, size, seen = [], 0, set()

        def out():
            nodes, ns, ells, idx, tok, at = (np.concatenate(x) for x in zip(*held, strict=True))
            place = (tok % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            ends = np.searchsorted(place[order], np.arange(buckets + 1))
            cols = [[], [], [], [], [], [], [], [], []]
            for b in np.flatnonzero(np.diff(ends)):
                own = order[ends[b] : ends[b + 1]]
                used, member = np.unique(idx[own], return_inverse=True)
                # Members ascend: steps of 0 and 1 take next to nothing when packed.
                step = np.diff(member, prepend=0).astype(np.uint32)
                for c, v in zip(cols, (int(b), len(used), len(own), *map(packed, (nodes[used], ns[used].astype(np.int32), ells[used].astype(np.int32), step, tok[own], at[own]))), strict=True):
                    c.append(v)
            none = pa.nulls(len(cols[0]), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, *(pa.array(c, pa.int32()) for c in cols[:3]), *(pa.array(c, pa.binary()) for c in cols[3:])], names)

        base = 0
        for batch in batches:
            ids = batch.column(0)
            for first, raw, offs in tm.slices(batch.column(1)):
                rows, g, n = tm.shingle_sets(raw, offs, k)
                node, check = _named(g, n, odd, bits)
                m = len(n)
                empty = pa.nulls(m, pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(first, m), pa.array(n.astype(np.int64)), pa.array(node, mask=n == 0), pa.array(check, mask=n == 0), *[pa.nulls(m, pa.int32())] * 3, *[empty] * 6], names)
                fresh = np.array([n[i] > 0 and not (d in seen or seen.add(d)) for i, d in enumerate(node.tolist())], bool)
                if not fresh.any():
                    continue
                keep = fresh[rows]
                rows, g = rows[keep], g[keep]
                at = np.searchsorted(fg, g)
                hit = np.zeros(len(g), bool)
                if len(fg):
                    hit = fg[np.minimum(at, len(fg) - 1)] == g
                est = np.where(hit, fc[np.minimum(at, max(len(fg) - 1, 0))] if len(fg) else 1, 1)
                order = np.lexsort((g, est, rows))
                rows, g, est = rows[order], g[order], est[order]
                ns = np.where(fresh, n, 0)
                begin = np.r_[0, np.cumsum(ns)]
                rank = np.arange(len(g)) - begin[rows]
                ell = _lengths(ns, est, begin)
                pick = rank < (ns - (4 * ns + 4) // 5 + ell)[rows]
                of = ns[rows[pick]]
                place = np.where(of <= EXACT, rank[pick], rank[pick] * EXACT // of).astype(np.uint16)
                held.append((node, ns, ell, rows[pick] + base, g[pick], place))
                base += m
                size += int(pick.sum())
                if size > FLUSH:
                    yield out()
                    held, size, base = [], 0, 0
        if held:
            yield out()

    names = ["doc_id", "n", "node", "check", "bucket", "docs", "size", "nodes", "ns", "ells", "steps", "tok", "places"]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, check long, bucket int, docs int, size int, nodes binary, ns binary, ells binary, steps binary, tok binary, places binary")


def _shared(table: pa.Table) -> pa.Table:
    """The (shingle, document) entries of one bucket whose shingle has two documents or more."""
    get = lambda name, kind, many: [unpacked(x, m, kind) for x, m in zip(table[name].to_pylist(), table[many].to_pylist(), strict=True)]
    idx = [np.cumsum(x) for x in get("steps", np.uint32, "size")]
    tok, place = np.concatenate(get("tok", np.uint64, "size")), np.concatenate(get("places", np.uint16, "size"))
    node, n, ell = (np.concatenate([v[i] for v, i in zip(get(c, kind, "docs"), idx, strict=True)]) for c, kind in (("nodes", np.int64), ("ns", np.int32), ("ells", np.int32)))
    order = np.lexsort((node, tok))
    tok, node, n, ell, place = tok[order], node[order], n[order], ell[order], place[order]
    new = np.r_[True, (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])]
    tok, node, n, ell, place = tok[new], node[new], n[new], ell[new], place[new]
    head = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    many = np.repeat(np.diff(np.r_[head, len(tok)]), np.diff(np.r_[head, len(tok)])) > 1
    return pa.table([pa.array(tok[many].view(np.int64)), pa.array(node[many]), pa.array(n[many]), pa.array(ell[many]), pa.array(place[many].astype(np.int32))], ["tok", "node", "n", "ell", "place"])


def _likely(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among ``keys``, and those without a key; nothing is moved for it.

    Tasks get a map in which each key sets two bits of 16 or more, 2 ** MAP in all at most: a key that is among
    ``keys`` always passes, one in about a hundred others does (more where the map is full).
    """
    spark = rows.sparkSession
    bits = 1 << min(MAP, max(PAGE.bit_length() - 1, (16 * keys.count()).bit_length()))
    spots = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(2)]
    spot = F.col("spot")
    pages = (
        keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*spots)).alias("spot"))
        .groupBy(F.shiftright(spot, PAGE.bit_length() - 1).alias("page")).agg(F.bitmap_construct_agg(spot.bitwiseAND(PAGE - 1)).alias("own")).toArrow()
    )
    held = np.zeros((bits // PAGE, PAGE // 8), np.uint8)
    for page, own in zip(pages["page"].to_pylist(), pages["own"], strict=True):
        held[page] = np.frombuffer(own.as_buffer(), np.uint8)
    known = spark.sparkContext.broadcast(held.ravel())
    names = rows.columns

    def run(batches):
        cells = known.value
        for batch in batches:
            spare = batch.column("spare").to_numpy(zero_copy_only=False)
            one, two = ((cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in (batch.column(c).to_numpy() for c in ("one", "two")))
            yield batch.select(names).filter(pa.array(spare | (one & two == 1)))

    return rows.select("*", F.col(key).isNull().alias("spare"), spots[0].alias("one"), spots[1].alias("two")).mapInArrow(run, rows.schema)


def _sketches(g: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each set the parity of its shingles in each cell; cells are a power of two, 2 n at least, 8 at least."""
    cells = 1 << np.maximum(3, np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    ends = np.r_[0, np.cumsum(cells)]
    at = np.repeat(ends[:-1], n) + (g & np.repeat(cells - 1, n).astype(np.uint64)).astype(np.int64)
    flat = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little")
    return [flat[a:b].tobytes() for a, b in zip(ends[:-1] // 8, ends[1:] // 8, strict=True)]


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (as rows of bytes) with fewer cells: cells that fall together add up."""
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _close(n: int, x: bytes, ns: np.ndarray, xs: list[bytes]) -> np.ndarray:
    """Which of the sets with sizes ``ns`` and sketches ``xs`` may be similar to that with ``n`` and ``x``; never false if they are."""
    ok = 5 * np.minimum(n, ns) >= 4 * np.maximum(n, ns)
    width = np.array([len(y) for y in xs])
    mine = np.frombuffer(x, np.uint8)[None]
    for w in np.unique(width[ok]):
        own = np.flatnonzero(ok & (width == w))
        y = np.frombuffer(b"".join([xs[i] for i in own]), np.uint8).reshape(len(own), w)
        least = min(int(w), len(x))
        ok[own] = 9 * np.bitwise_count(_fold(mine, least) ^ _fold(y, least)).sum(1, dtype=np.int64) <= n + ns[own]
    return ok


def _sets(docs: DataFrame, k: int, odd: np.ndarray, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, raw, offs in tm.slices(batch.column(0)):
                _, g, n = tm.shingle_sets(raw, offs, k)
                ends = np.r_[0, np.cumsum(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_named(g, n, odd, bits)[0]), pa.array(n.astype(np.int64)), pa.array(_sketches(g, n), pa.binary()), pa.array([g[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                    ["node", "n", "sketch", "grams"])

    return docs.select("text").mapInArrow(run, "node long, n long, sketch binary, grams binary")


def _survivors(pairs: DataFrame) -> DataFrame:
    """Of rows ``node, n, sketch, lone, block, part, members(node, n, sketch)`` what may be similar by the sketches.

    Rows ``node, lone, block, part`` name who still meets a block, rows with ``member`` which of its sets may be met.
    """
    names = ["node", "lone", "block", "part", "member"]

    def run(batches):
        seen: set[int] = set()  # a set is in one block only
        for batch in batches:
            out = [[], [], [], [], []]
            for node, n, x, *block, members in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "sketch", "lone", "block", "part")), batch.column("members"), strict=True):
                flat = members.values
                ids = flat.field(0).to_numpy()
                ok = _close(n, x, flat.field(1).to_numpy(), flat.field(2).to_pylist()) & (ids != node)
                fresh = [i for i in ids[ok].tolist() if not (i in seen or seen.add(i))]
                for row in [(node, *block, None)] * bool(ok.any()) + [(None, *block, i) for i in fresh]:
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    return pairs.mapInArrow(run, "node long, lone boolean, block long, part long, member long")


def _near(pairs: DataFrame) -> DataFrame:
    """Of rows ``node, n, sketch, b, bn, b_sketch`` the pairs ``node, b`` that may be similar by the sketches."""

    def run(batches):
        for batch in batches:
            n, x, bn, y = (batch.column(c).to_pylist() for c in ("n", "sketch", "bn", "b_sketch"))
            ok = [bool(_close(i, a, np.array([j]), [b])[0]) for i, a, j, b in zip(n, x, bn, y, strict=True)]
            yield batch.select(["node", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "node long, b long")


def _verify(pairs: DataFrame) -> DataFrame:
    """Of rows ``a, a_grams, members(node, grams)`` the exact links ``src, dst``.

    A task leaves out links between documents that its earlier ones connect.
    """

    def run(batches):
        up: dict[int, int] = {}

        def top(z):
            while up.setdefault(z, z) != z:
                up[z] = up[up[z]]
                z = up[z]
            return z

        for batch in batches:
            src, dst = [], []
            for a, mine, members in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x = np.frombuffer(mine.as_buffer(), np.uint64)
                flat = members.values
                ids = flat.field(0).to_numpy()
                ys = [np.frombuffer(g.as_buffer(), np.uint64) for g in flat.field(1)]
                sizes = np.array([len(y) for y in ys])
                y = np.concatenate(ys)
                at = np.searchsorted(x, y)
                hit = x[np.minimum(at, len(x) - 1)] == y
                common = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes)[:-1]])
                ok = 100 * common >= 80 * (len(x) + sizes - common)
                for b in ids[ok].tolist():
                    p, q = top(a), top(b)
                    if p != q:
                        up[p] = q
                        src.append(a)
                        dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return pairs.mapInArrow(run, "src long, dst long")


def similar_groups(docs: DataFrame, k: int = 5, bits: int = 64) -> DataFrame:
    """Group documents whose k-word shingle sets have a Jaccard similarity of 0.8 or more.

    Args: ``docs`` with ``doc_id`` long and ``text``; other columns are ignored.
    Returns ``doc_id, n_shingles, component_id``; component_id is the least doc_id that
    links reach.  Links are exact on 64-bit shingle hashes; sets count as equal by 128 bits.  ``bits``: of the
    names that sets go by first; any number gives the same groups.

    Null or blank texts have no shingles and are alone in their component.  A null doc_id is
    kept with its size, joins the component of its text, which its links join to others, and never names one (a component
    of nulls only is null).  Repeated rows give repeated rows.  An empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(docs, k))
    odd = np.zeros(0, np.int64)
    while True:
        path, entries_path = fresh_path(spark, "prefixes"), fresh_path(spark, "entries")
        rows = _prefixes(docs, frequent, k, partitions(spark), odd, bits).withColumn("part", F.when(F.col("bucket").isNull(), "sizes").otherwise("buckets"))
        staged = stage_at(rows, path, by=("part",))
        sizes = staged.where("part = 'sizes'").select("doc_id", "n", "node")
        reps = stage(staged.where("part = 'sizes' and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("lo"), F.max("check").alias("hi")), "reps")
        # Names are 64 bits; the few that two sets share (one pair in 2**64) are told apart by 64 more.
        shared = np.array([r["node"] for r in reps.where("lo <> hi").select("node").collect()], np.int64)
        if not len(shared):
            break
        odd = np.union1d(odd, shared)
        discard(spark, path)
    entries = stage_at(staged.where("part = 'buckets'").drop("part").groupBy("bucket").applyInArrow(_shared, "tok long, node long, n int, ell int, place int"), entries_path)
    # Only the sizes are read from here on.
    discard(spark, f"{path}/part=buckets")
    # The first common shingle of a set with a similar one has 4 / 5 of the set at and after it.
    # It has as many common ones with its prefix as the least l of the two.
    able = stage(entries.withColumn("room", _room()).groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.max("room").alias("most")).where("5 * most >= 4 * n").where(F.col("c") >= _at_least()).select("node"), "able")
    # Entries of a few others may stay; they have no set below, so they link nothing.
    entries = stage(_likely(entries, "node", able), "entries")
    discard(spark, entries_path)
    wanted = stage(reps.join(able, "node", "left_semi").select("doc_id"), "wanted")
    # A set that only rows without a doc_id have is found by its name.
    sets = stage(_sets(_likely(docs, "doc_id", wanted), k, odd, bits).join(able, "node", "left_semi").dropDuplicates(["node"]), "sets")
    sketches = sets.select("node", "n", "sketch")

    # First each entry's document against the leader of its shingle.
    leader = entries.groupBy("tok").agg(F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("ell").alias("bl"), _room().alias("b_room"))).alias("x")).select("tok", "x.b", "x.bn", "x.bl", "x.b_room")
    star = (
        entries.join(leader, "tok").withColumn("room", _room()).where("node <> b and 5 * least(n, bn) >= 4 * greatest(n, bn) and 9 * (least(room, b_room) + least(ell, bl) - 1) >= 4 * (n + bn)")
        .groupBy("node", "b").agg(F.count("*").alias("c"), F.first(F.least("ell", "bl")).alias("l")).where("2 * c >= l")
    )
    star = stage(_near(star.join(sketches, "node").join(sketches.toDF("b", "bn", "b_sketch"), "b")), "star")
    likely = _likely(sets, "node", star.select("node").union(star.select("b")).distinct()).select("node", "grams")
    one = likely.select(F.col("node").alias("b"), F.array(F.struct("node", "grams")).alias("members"))
    links = stage(_verify(star.join(likely, "node").join(one, "b").select("node", "grams", "members")), "links")

    # Then documents that are still apart, against blocks of the larger component.
    root = connected_components(links)
    nodes = entries.select("node", "n").distinct().join(root, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    nodes = nodes.join(nodes.groupBy("root").agg(F.count("*").alias("m")), "root")
    # Lone documents stand in one block with those that share their commonest prefix shingle.
    common = entries.join(entries.groupBy("tok").agg(F.count("*").alias("c")), "tok").groupBy("node").agg(F.max(F.struct("c", "tok"))["tok"].alias("common"))
    nodes = nodes.join(common, "node").withColumn("lone", F.col("m") == 1).withColumn("block", F.when(F.col("lone"), F.col("common")).otherwise(F.col("root")))
    weight = nodes.groupBy("lone", "block").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    nodes = stage(nodes.join(weight, ["lone", "block"]).select("node", "root", "m", "lone", "block", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")), "nodes")
    placed = stage(entries.join(nodes, "node").withColumn("room", _room()).drop("place"), "placed")
    indexed = placed.where("not lone or room > ceil(8 * n / 9) - ell")
    own = {"lone": "b_lone", "block": "b_block", "part": "b_part"}
    side = indexed.withColumnsRenamed(own).groupBy("tok", *own.values()).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("ell").alias("bl"), F.max("ell").alias("b_most"), F.max("room").alias("b_room"), F.first("m").alias("bm"))
    # Of two lone documents the larger one probes.  Else the document of the smaller component does.
    turn = "(lone and b_lone and n >= lo) or (not b_lone and root <> b_block and (m < bm or m = bm and root < b_block))"
    least = "4 * (n + greatest(lo, ceil(0.8 * n)))"
    meet = (
        placed.drop("block", "part").join(side, "tok").where(f"({turn}) and 5 * hi >= 4 * n and 4 * lo <= 5 * n and 9 * (least(room, b_room) + least(ell, b_most) - 1) >= {least}")
        .groupBy("node", *own.values()).agg(
            F.count("*").alias("c"), F.min(F.least("ell", "bl")).alias("l"), F.max(F.least("room", "b_room")).alias("most"), F.first("n").alias("n"), F.min("lo").alias("lo"))
        .where(f"c >= l and 9 * most >= {least}").select("node", *own.values())
    )
    meet = stage(meet, "meet")
    meet = meet.withColumnsRenamed({v: k for k, v in own.items()})
    met = nodes.select("node", *own).join(meet.select(*own).distinct(), list(own), "left_semi")
    blocks = sketches.join(met, "node").groupBy(*own).agg(F.collect_list(F.struct("node", "n", "sketch")).alias("members"))
    left = stage(_survivors(meet.join(sketches, "node").join(blocks, list(own))), "left")
    probes, members = left.where("node is not null").drop("member"), left.where("member is not null").select(F.col("member").alias("node"), *own).distinct()
    some = _likely(sets, "node", probes.select("node").union(members.select("node")).distinct()).select("node", "grams")
    blocks = some.join(members, "node").groupBy(*own).agg(F.collect_list(F.struct("node", "grams")).alias("members"))
    more = _verify(probes.join(some, "node").join(blocks, list(own)).select("node", "grams", "members"))
    links = stage(links.unionByName(more), "links")

    root = connected_components(links)
    named = reps.join(root, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final = named.join(least, "root").select("node", "component_id")
    out = sizes.join(final, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
