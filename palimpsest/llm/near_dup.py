"""N-gram Jaccard join by a token-group matrix: groups of similar documents, their token unions, and bounds that open few.

Steps (t is the least similarity, a set the distinct shingles of a document):

1. Documents with equal sets are one class, led by the smallest doc_id; only leaders go on.
2. Leaders that may link share a part. Two sets with a similarity of t or more differ in at most d tokens, where d
   follows from their sizes. So if tokens are dealt by hash into d + 1 parts, they agree in a whole part; a part's
   tokens make a 64-bit key. Sizes come in bands, and a set near the lower end of its band also sends keys for the band
   below. Parts in which a set has nothing tell nothing, so there are some parts to spare and these are left out. A set
   that has more of them than there are to spare is dealt anew under another salt, and sends these keys too: two sets
   agree in a part that isn't empty if either of them has few enough empty ones, and if neither has, both go on to the
   next salt. A set that has too many under all SALTS, which is next to none, sends its empty parts too. Keys that several leaders have are found by an exchange of
   sorted arrays. With parts to spare, two sets that link agree in more than one: a leader that has fewer keys in
   common with all others together links with none, and goes no further.
3. A leader's group is the one of its shared keys that most leaders have: similar documents have it in common, so
   they fall into few groups. Large groups are cut into shares of SHARE members.
4. In a share, the tokens of its members (those in two sets at least) and its members make a matrix, whose product
   with itself has all overlaps. Each share also holds the group's pivot, the member with the most shared keys.
5. Pivots of groups that share keys are held against one another's groups, which connects most of these. Then members
   that are not connected with their own pivot are queries to all groups they share a key with, and other members to
   those whose pivot is in a larger component than their own. Keys that the same groups have count once here: a member
   of a large group has many of them. Against a share, first the count of a query's tokens in the
   union of the share bounds what any member can have in common with it; only shares that reach the bound are opened.

Every pair of different sets that links is either compared or in one component already, so components are exact: of a
pair that shares a key, either one is not connected with its pivot, and asks the other's group; or both are, and the
one in the smaller component asks unless their pivots are connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ENTRIES, answered, as_table, block_of, counted, entries
from .common import chunks, discard, lean, maybe_in, mix, release, sequences, staged, word_hashes, words_of
from .components import components

#: Members of a share of a group, and their tokens, about; also of the queries held against a share by one task.
SHARE, TOKENS = 512, 1_500_000
#: Leaders in a block of the exchange of keys, about.
LEADERS = 2500
#: Ways to deal a set that has too many empty parts. More of them make keys of empty parts rarer; none is lost with fewer.
SALTS = 16
_SHINGLE, _WHOLE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def shingle_sets(texts: pa.ChunkedArray | pa.Array, words: int):
    """For runs of texts: (from, to, sorted distinct shingle hashes text by text, where each text's begin)."""
    for i, j, data, at in chunks(texts):
        starts, ends, first = words_of(data, at)
        h = word_hashes(data, starts, ends, lower=True)
        size = np.diff(first)
        doc = np.repeat(np.arange(j - i), size)
        s = sequences(h, words, _SHINGLE)
        whole = doc[: len(s)] == doc[words - 1 :] if len(s) else np.zeros(0, bool)
        s, d = s[whole], doc[: len(s)][whole]
        for k in np.flatnonzero((size > 0) & (size < words)):  # the whole sequence is the one shingle
            s = np.append(s, sequences(h[first[k] : first[k + 1]], int(size[k]), _WHOLE) ^ np.uint64(size[k]))
            d = np.append(d, k)
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
        s, d = s[new], d[new]
        yield i, j, s, np.searchsorted(d, np.arange(j - i + 1))


def linked(common, a, b, t: tuple[int, int]):
    """Whether sets of sizes a and b with so much in common link: common / union >= t."""
    common = np.asarray(common).astype(np.int64)
    return t[1] * common >= t[0] * (a + b - common)


class Bands:
    """Bands of set sizes, and the number of parts in each."""

    def __init__(self, t: tuple[int, int], ratio: float = 1.5, most: int = 1 << 40):
        num, den = t
        self.t, self.least = t, -(-num // max(1, den - num))  # smaller sets link with equal ones alone
        tops = [max(self.least, 2)]
        while tops[-1] < most:
            tops.append(int(tops[-1] * ratio) + 1)
        self.tops = np.array(tops, np.int64)
        apart = (self.tops + self.tops * den // num) * (den - num) // (den + num)
        low = np.concatenate([[self.least], self.tops[:-1] + 1])
        # so many that even sets at the low end of a band seldom have more empty parts; small sets can't have as many
        self.spare = np.zeros(len(tops), np.int64)
        for _ in range(30):
            parts = apart + 1 + self.spare
            mean = parts * np.exp(-low / parts)
            self.spare = np.minimum(np.ceil(mean + 2 * np.sqrt(mean)).astype(np.int64), apart // 3)
        self.parts = apart + 1 + self.spare

    def keys(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of sets (sorted tokens, where each begins); where each set's keys begin; and of each set, how many keys
        are of its own band, and how many of them, and of those of the band below, it has in common with one it links
        with in that band."""
        size = np.diff(at)
        band = np.searchsorted(self.tops, size)
        own = size >= self.least
        below = own & (band > 0) & (self.t[0] * size <= self.t[1] * self.tops[np.maximum(band - 1, 0)])
        keys, whose = [], []
        counts = np.zeros((3, len(size)), np.int32)
        for i, (which, b) in enumerate(((own, band), (below, band - 1))):
            for salt in range(SALTS):
                sets = np.flatnonzero(which)
                if not len(sets):
                    break
                parts, spare, of = self.parts[b[sets]], self.spare[b[sets]], b[sets].astype(np.uint64)
                base = np.cumsum(parts) - parts
                owner = np.repeat(np.arange(len(sets)), size[sets])
                salted = mix(tokens[np.repeat(which, size)] ^ ((of[owner] | np.uint64(salt << 48)) * np.uint64(0x9E3779B97F4A7C15)))
                slot = base[owner] + ((salted >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                total = int(parts.sum())
                sums = np.zeros(total, np.uint64)
                np.add.at(sums, slot, mix(salted ^ np.uint64(0x94D049BB133111EB)))
                empty = np.bincount(slot, minlength=total) == 0
                owner = np.repeat(np.arange(len(sets)), parts)
                empties = np.bincount(owner, weights=empty, minlength=len(sets)).astype(np.int64)
                over = empties > spare
                if salt == 0:  # parts empty in both are no keys in common, and as many as are to spare at most count as such
                    counts[i + 1, sets] = spare + 1 - np.minimum(empties, spare)
                place = np.arange(total).astype(np.uint64) - base[owner].astype(np.uint64) + (of[owner] << np.uint64(40)) + np.uint64(salt << 32)
                keep = ~empty | (over[owner] & (salt == SALTS - 1))
                if i == 0:
                    counts[0, sets] += np.bincount(owner[keep], minlength=len(sets)).astype(np.int32)
                keys.append(mix(sums + mix(place))[keep])
                whose.append(sets[owner[keep]])
                which = np.zeros(len(size), bool)
                which[sets[over]] = True
        k, w = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *whose])
        order = np.argsort(w, kind="stable")
        return k[order], np.searchsorted(w[order], np.arange(len(size) + 1)), counts


def _packed(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.binary())


COUNTS = ("own", "need", "need_below")


def described(docs: DataFrame, words: int, bands: Bands) -> DataFrame:
    """doc_id, n (tokens), mark (128 bits of a hash of the set; null if empty), keys and COUNTS (see Bands) of each row."""

    @lean
    def run(batches):
        for batch in batches:
            for i, j, s, at in shingle_sets(batch.column(1), words):
                k, ka, counts = bands.keys(s, at)
                marks = [hashlib.blake2b(s[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), _packed(marks), _packed([k[a:b].tobytes() for a, b in zip(ka[:-1], ka[1:], strict=True)]), *map(pa.array, counts)], names=["doc_id", "n", "mark", "keys", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, mark binary, keys binary, own int, need int, need_below int")


CANDIDATE = "rep long, n long, home long, n_shared int, shared array<long>"


def candidates(leaders: DataFrame, blocks: int) -> DataFrame:
    """Leaders (rep, n, keys, COUNTS) that may link: their shared keys, and the most frequent of these."""

    def laid(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, the row of each, whether it is of the row's own band, and whether it is the first of its like."""
        held = [np.frombuffer(x, "<u8") for x in t["keys"].to_pylist()]
        size = np.array([len(x) for x in held], np.int64)
        k, d = np.concatenate([np.zeros(0, np.uint64), *held]), np.repeat(np.arange(len(held)), size)
        own = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) < t["own"].to_numpy()[d]
        order = np.argsort(k, kind="stable")
        first = np.ones(len(k), bool)
        first[1:] = k[order][1:] != k[order][:-1]
        return k[order], d[order], own[order], first

    def tell(t: pa.Table) -> pa.Table:
        k, _, _, first = laid(t)
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, len(k))).astype("<u4")
        return as_table(entries(t["blk"][0].as_py(), blocks, k[at], times, None), ENTRIES)

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        k, d, own, first = laid(left)
        mask, totals = answered(right, blocks, k[first])
        times = np.ones(len(mask), np.int64)
        times[mask] = totals
        times = times[np.cumsum(first) - 1] if len(k) else np.zeros(0, np.int64)
        hit = times > 1
        for band, need in ((own, "need"), (~own, "need_below")):
            enough = np.bincount(d[hit & band], minlength=left.num_rows) >= left[need].to_numpy()
            hit &= ~band | enough[d]
        k, d, times = k[hit].view(np.int64), d[hit], times[hit]
        order = np.lexsort((k, -times, d))
        k, d = k[order], d[order]
        at = np.searchsorted(d, np.arange(left.num_rows + 1))
        some = np.flatnonzero(np.diff(at))
        shared = pa.ListArray.from_arrays(pa.array(np.append(at[some], len(k)).astype(np.int32)), pa.array(k))
        return pa.table([left["rep"].take(pa.array(some)), left["n"].take(pa.array(some)), pa.array(k[at[some]]), pa.array(np.diff(at)[some].astype(np.int32)), shared], names=["rep", "n", "home", "n_shared", "shared"])

    grouped = leaders.withColumn("blk", block_of(blocks, "rep")).groupBy("blk")
    return grouped.cogroup(counted(grouped.applyInArrow(tell, ENTRIES)).groupBy("blk")).applyInArrow(pick, CANDIDATE)


def _overlaps(a: list[np.ndarray], b: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """Tokens in common of each of a with each of b, counting those in union: products of slices of 4096 tokens, which single
    precision holds exactly, are summed as integers."""
    out = np.zeros((len(a), len(b)), np.int64)

    def cells(sets):
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        col = np.searchsorted(union, every)
        ok = (col < len(union)) & (union[np.minimum(col, len(union) - 1)] == every)
        row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[ok]
        col = col[ok].astype(np.int32)
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    if not len(union):
        return out
    left = cells(a)
    right = left if b is a else cells(b)

    def matrix(n, row, col, c, width):
        m = np.zeros((n, width), np.float32)
        part = slice(*np.searchsorted(col, [c, c + width]))
        m[row[part], col[part] - c] = 1
        return m

    for c in range(0, len(union), 4096):
        width = min(4096, len(union) - c)
        x = matrix(len(a), *left, c, width)
        out += (x @ (x if b is a else matrix(len(b), *right, c, width)).T).astype(np.int64)
    return out


def _roots(link: np.ndarray) -> np.ndarray:
    """The first member of each member's component, of a symmetric matrix of links."""
    root = np.full(len(link), -1)
    for i in range(len(link)):
        if root[i] < 0:
            edge, seen = np.array([i]), np.zeros(len(link), bool)
            seen[i] = True
            while len(edge):
                near = link[edge].any(axis=0) & ~seen
                seen |= near
                edge = np.flatnonzero(near)
            root[seen] = i
    return root


def _compare(t: pa.Table, link: tuple[int, int]) -> pa.Table:
    """Edges found in one share. Rows: its members, its group's pivot, and queries (rep, n, tokens, role, part).

    role: 0 member, 1 pivot that is a member elsewhere, 2 query. part: the component a member is known to be in.
    """
    role = t["role"].to_numpy()
    order = np.lexsort((t["rep"].to_numpy(), role))
    role, rep, n, part = role[order], t["rep"].to_numpy()[order], t["n"].to_numpy()[order], t["part"].to_numpy()[order]
    blobs = t["tokens"].combine_chunks() if isinstance(t["tokens"], pa.ChunkedArray) else t["tokens"]
    sets = [np.frombuffer(blobs[int(i)].as_py(), "<u8") for i in order]
    members = role < 2
    c = int(members.sum())
    every, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets[:c]]), return_counts=True)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if c == len(sets):
        common = _overlaps(sets, sets, every[times > 1])  # a token of one member is in no overlap
        roots = _roots(linked(common, n[:, None], n[None, :], link))
        a.append(rep[roots != np.arange(c)])
        b.append(rep[roots[roots != np.arange(c)]])
    elif c:
        low = n[:c].min()
        load = np.cumsum([len(x) for x in sets[c:]])
        part_of = np.maximum(np.arange(len(load)) // SHARE, load // TOKENS)
        for p in np.unique(part_of):
            asked = range(c + int(np.searchsorted(part_of, p)), c + int(np.searchsorted(part_of, p, "right")))
            bound = np.array([np.isin(sets[i], every, assume_unique=True).sum() for i in asked])
            size = n[list(asked)]
            open_ = np.array(asked)[link[1] * bound >= link[0] * np.maximum(size, low)]
            if not len(open_):
                continue
            common = _overlaps([sets[i] for i in open_], sets[:c], every)
            q, m = np.nonzero(linked(common, n[open_][:, None], n[None, :c], link) & (rep[open_][:, None] != rep[None, :c]))
            # one edge to each component of the members is as good as all
            keep = np.unique(np.stack([q, part[m]]), axis=1, return_index=True)[1]
            a.append(rep[open_[q[keep]]])
            b.append(rep[m[keep]])
    release()
    return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def ngram_jaccard_classes(docs: DataFrame, words: int = 5, t: tuple[int, int] = (80, 100)) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text with A-Z in lower case. A set is the distinct shingles of so many
    words; with fewer words the whole sequence is the one; without any the set is empty and links with nothing. Sets
    link when t[1] * intersection >= t[0] * union. A null doc_id links with nothing and has no component; rows that
    repeat a doc_id link each by its own set, and classes that the same doc_id leads count as one. Other columns are
    not looked at.
    """
    bands = Bands(t)
    rows = staged(described(docs, words, bands), "described")
    full = rows.where("n > 0 and doc_id is not null")
    one_each = full.groupBy("mark").agg(F.min(F.struct("doc_id", "n", "keys", *COUNTS)).alias("x"))
    classes = staged(one_each.select("mark", F.col("x.doc_id").alias("rep"), "x.n", "x.keys", *(f"x.{c}" for c in COUNTS)), "classes")
    light = staged(rows.select("doc_id", "n", "mark"), "marks")
    rows = discard(rows, light)
    leaders = classes.where(F.octet_length("keys") > 0)
    blocks = max(1, -(-leaders.count() // LEADERS))
    found = staged(candidates(leaders.select("rep", "n", "keys", *COUNTS), blocks), "candidates")
    classes = discard(classes, staged(classes.select("mark", "rep"), "leaders"))

    @lean
    def tokens(batches):
        for batch in batches:
            for i, j, s, at in shingle_sets(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), _packed([s[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])], names=["rep", "n", "tokens"])

    some = maybe_in(docs.select(F.col("doc_id").alias("rep"), "text"), found.select("rep"), "rep")[0]
    asked = some.join(found.select("rep").distinct(), "rep").select("rep", "text")
    sets = asked.mapInArrow(tokens, "rep long, n long, tokens binary")
    homes = staged(found.groupBy("home").agg(F.count("*").alias("size"), F.sum("n").alias("load"), F.max_by("rep", F.struct("n_shared", F.bitwise_not("rep"))).alias("pivot")), "homes")
    parts_of = lambda size, load: F.ceil(F.greatest(F.col(size) / SHARE, F.col(load) / TOKENS)).cast("int")
    homes = homes.withColumn("shares", parts_of("size", "load"))
    share = F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int")
    placed = staged(found.select("rep", "n", "home").join(homes, "home").withColumn("share", share).join(sets, ["rep", "n"]), "members")
    one = ["home", "share", "turn", "rep", "n", "tokens", "role", "part"]
    alike = placed.withColumn("turn", F.lit(0)).withColumn("role", F.lit(0)).withColumn("part", F.col("rep"))
    pivots = placed.where("shares > 1 and rep = pivot").withColumn("turn", F.lit(0)).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).where("at <> share")
    pivots = pivots.withColumn("share", F.col("at")).withColumn("role", F.lit(1)).withColumn("part", F.col("rep"))
    compare = lambda df: df.select(*one).groupBy("home", "share", "turn").applyInArrow(lambda x: _compare(x, t), "a long, b long")
    near = staged(compare(alike.where("size > 1").select(*one).union(pivots.select(*one))), "near")

    # keys that leaders of several groups have, with those groups
    keys = found.select("rep", F.col("home").alias("own"), F.explode("shared").alias("key"))
    mixed = keys.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("key", "x")
    mixed = staged(keys.select("key", F.col("own").alias("home")).distinct().join(mixed, "key"), "mixed")

    def ask(queries: DataFrame, parts: DataFrame | None) -> DataFrame:
        """Edges of queries (rep, home) against all shares of those groups, so many queries in turn as a task can hold."""
        q = staged(queries.join(placed.select("rep", "n"), "rep"), "queries")
        turns = q.groupBy("home").agg(F.count("*").alias("asks"), F.sum("n").alias("weigh")).withColumn("turns", parts_of("asks", "weigh"))
        q = q.join(turns, "home").withColumn("turn", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("turns")).cast("int"))
        q = q.drop("n").join(placed.select("rep", "n", "tokens"), "rep").join(homes.select("home", "shares"), "home").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        held = alike.drop("turn").join(turns.select("home", "turns"), "home").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        if parts is not None:
            held = held.drop("part").join(parts, "rep")
        return compare(held.select(*one).union(q.withColumn("role", F.lit(2)).withColumn("part", F.col("rep")).select(*one)))

    edges = near
    if not mixed.isEmpty() or not homes.where("shares > 1").isEmpty():
        # pivots first: each asks the first of the groups that have a key in common
        pairs = mixed.where("home <> x").select("home", "x").distinct().join(homes.select("home", "pivot"), "home")
        edges = edges.union(staged(ask(pairs.select(F.col("pivot").alias("rep"), F.col("x").alias("home")), None), "bridges"))
        known = components(edges)
        parts = placed.select("rep", F.col("home").alias("own")).distinct().join(known.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "own", F.coalesce("component", "rep").alias("part"))
        parts = staged(parts, "parts")
        main = staged(homes.join(parts.select(F.col("rep").alias("pivot"), F.col("part").alias("main")), "pivot").select("home", "main", "shares"), "main")
        placed_in = parts.join(main.select(F.col("home").alias("own"), F.col("main").alias("own_main"), "shares"), "own")
        apart = staged(placed_in.where("part <> own_main").select("rep", "own", "shares"), "apart")
        # keys that the same groups have are as one, the least of them
        same = mixed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("home")).alias("x"), F.bit_xor(F.xxhash64("home", F.lit(1))).alias("y"))
        same = same.join(same.groupBy("n", "x", "y").agg(F.min("key").alias("first")), ["n", "x", "y"]).select("key", "first")
        same = staged(same, "same")
        groups = staged(mixed.select("key", "home").join(same.where("key = first").select("key"), "key").join(main.select("home", "main"), "home"), "groups")
        has = staged(keys.join(same, "key").select("rep", F.col("first").alias("key")).distinct(), "has")
        asks = has.join(apart.select("rep"), "rep").join(groups.select("key", "home"), "key").select("rep", "home").distinct()
        asks = asks.union(apart.where("shares > 1").select("rep", F.col("own").alias("home"))).distinct()
        # of two components the smaller one's members ask
        rank = F.struct("members", "main").alias("rank")
        ranks = parts.groupBy(F.col("part").alias("main")).agg(F.count("*").alias("members")).select("main", rank)
        torn = groups.join(ranks, "main").select("key", "home", "rank")
        torn = torn.join(torn.groupBy("key").agg(F.min("rank").alias("m"), F.max("rank").alias("n")).where("m <> n").select("key"), "key")
        firm = placed_in.where("part = own_main").select("rep", F.col("own_main").alias("main")).join(ranks, "main").select("rep", F.col("rank").alias("own_rank"))
        across = has.join(firm, "rep").join(staged(torn, "torn"), "key").where("own_rank < rank").select("rep", "home").distinct()
        edges = edges.union(staged(ask(asks.union(across).distinct(), parts.select("rep", "part")), "far"))
    final = staged(components(edges), "components")
    whole = classes.select("mark", "rep").join(final, F.col("rep") == F.col("id"), "left").select("mark", F.coalesce("component", "rep").alias("least"))
    out = rows.join(whole, "mark", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("least"))).otherwise(F.col("doc_id")).alias("component_id"))
