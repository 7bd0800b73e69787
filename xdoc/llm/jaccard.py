"""Near-duplicate groups by an exact Jaccard join of shingle sets.

1. Equal sets collapse to one, known by a hash; where sets differ that share one
   of two hashes, by the other.
2. Each set posts its front tokens: those with a hash in the first ``FRONT`` of
   the range. Their lists tell on how many sets each stands. In the order that all
   sets follow (front tokens by that number, then the others by hash), two linked
   sets share one of their prefixes' tokens, a prefix being one token more than a
   set may have alone. Tokens of a single set fill most prefixes wholly; such sets
   are linked with none and go no further. (Where a set's front tokens are fewer
   than its prefix, it posts as many others.) Those that are left do the same once
   more among themselves, with all their tokens.
3. Sets on a token's list gather around the list's smallest. Each set goes with
   the leader that it meets most often; these groups, cut into chunks with their
   leader in each, are joined exactly (``setjoin``), and so are those of leaders'
   leaders, cut into chunks by chance. This tells most links, and what they connect.
4. Large connected groups, and else sets with one leader's leader, form blocks of
   bounded size. Two blocks with a list in common are joined exactly, unless all
   their sets are connected already. So every two sets that share a prefix token
   are joined, or known to be in one group; no list is turned into pairs of sets,
   and no task holds more than two blocks.
5. Links become components.

Posts travel in buckets whose number grows with them, so a task's memory doesn't;
all the sets of one token are in one bucket, as twelve bytes each.

Defined results: a null or empty text, or one without words, has no set and is
its own component; fewer words than a shingle make one token of all of them;
equal ids are one vertex, and each of their rows gets its own row with the number
of its own shingles; a null id has a null component and takes no part in links;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Spans, chunks, materialize, mix, ngrams, partitions, sequence, utf8, words
from .components import components
from .setjoin import SetJoin

SHINGLE, PERCENT = 5, 75
#: The part of the range of hashes, as a fraction, whose tokens come first in the order of tokens.
FRONT = (3, 8)
LAST_FRONT, LAST = np.uint64((1 << 64) * FRONT[0] // FRONT[1] - 1), np.uint64((1 << 64) - 1)
#: Posts of a bucket, and those that a task holds before it sends them.
BUCKET, HELD = 1 << 20, 1 << 20
#: Sets of a block, and tokens, about; sets from which a connected group has blocks of its own; tokens of one task's blocks.
BLOCK, BLOCK_TOKENS, KIN, TASK_TOKENS = 128, 1 << 18, 32, 1 << 22


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE):
    """Distinct shingle hashes of each text, ascending; offsets begin at 0."""
    starts, ends, rows = words(data, offsets)
    hashes = Spans(LOWER[data]).hash(starts, ends)
    grams, at = ngrams(hashes, rows, n)
    owner = rows[at]
    per_row = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(per_row) - per_row
    for row in np.flatnonzero((per_row > 0) & (per_row < n)).tolist():
        grams = np.append(grams, sequence(hashes, first[row : row + 1], int(per_row[row])))
        owner = np.append(owner, row)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return np.split(grams, np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))[:-1])


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        a = mix(np.array([np.add.reduce(mix(tokens ^ np.uint64(0xA5A5A5A5)))], np.uint64) + np.uint64(len(tokens)))
        b = mix(np.array([np.add.reduce(mix(tokens + np.uint64(0x5BD1E995)))], np.uint64) ^ np.uint64(len(tokens)))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def set_name(tokens: np.ndarray, clashes: frozenset[int]) -> int:
    """Its first hash; where that is one of several sets, its second."""
    first, second = set_hash(tokens)
    return second if first in clashes else first


def _sets(batches):
    """(batch, row, tokens) of every text in the second column that has a set."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in chunks(offsets):
            for k, tokens in enumerate(shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])):
                yield batch, a + k, tokens


def _input(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))


def survey(docs: DataFrame) -> DataFrame:
    """A row per document: its set's size, how many front tokens it has, and two hashes (null without a set)."""
    def run(batches):
        rows, of, ids = [], None, None

        def table():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc", "n", "m", "h1", "h2"])

        for batch, row, tokens in _sets(batches):
            if of is not batch:
                of, ids = batch, batch.column(0).to_pylist()
            rows.append((ids[row], len(tokens), int(np.searchsorted(tokens, LAST_FRONT, "right")), *(set_hash(tokens) if len(tokens) else (None, None))))
            if len(rows) == 4096:
                yield table()
                rows = []
        if rows:
            yield table()

    return docs.mapInArrow(run, "doc long, n long, m long, h1 long, h2 long")


def _prefix(n, percent: int):
    """One token more than a set of ``n`` may have alone."""
    return n + 1 + (-percent * n) // 100


# ---------------------------------------------------------------- packed records

_SHARED = np.dtype([("set", "<i8"), ("token", "<u8"), ("df", "<u4")])
_SIZES = np.dtype([("set", "<i8"), ("n", "<u4"), ("m", "<u4")])
_POST = np.dtype([("token", "<u8"), ("set", "<i8"), ("n", "<u4")])


def _planes(values: np.ndarray, ascending: bool = False) -> bytes:
    """First bytes of all numbers, then second bytes, and so on; of their differences where they ascend."""
    if ascending and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(raw: bytes, kind, n: int, at: int, ascending: bool = False) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=values.dtype) if ascending else values, at + n * width


def _pack(records: np.ndarray) -> bytes:
    """Records, ascending by their first field."""
    names = records.dtype.names
    return zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(np.ascontiguousarray(records[f]), f == names[0] and records.dtype[f].kind == "u") for f in names))


def _unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    raws = [zstandard.ZstdDecompressor().decompress(b) for b in blobs]
    found, at = np.zeros(sum(map(len, raws)) // kind.itemsize, kind), 0
    for raw in raws:
        n, byte = len(raw) // kind.itemsize, 0
        for f in kind.names:
            found[f][at : at + n], byte = _from_planes(raw, kind[f], n, byte, f == kind.names[0] and kind[f].kind == "u")
        at += n
    return found


def _dealt(records: np.ndarray, keys: np.ndarray, buckets: int):
    """(bucket, records) for each bucket of the keys."""
    if not len(records):
        return
    bucket = (keys.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), records[a:b]


_BLOBS = "bucket int, kind int, data binary"


def _blob_table(pairs: list[tuple[int, bytes]], kind: int = 0) -> pa.Table:
    return pa.table({"bucket": pa.array([b for b, _ in pairs], pa.int32()), "kind": pa.array([kind] * len(pairs), pa.int32()), "data": pa.array([d for _, d in pairs], pa.binary())})


# ---------------------------------------------------------------- lists of prefix tokens

def postings(source: DataFrame, tokens_of, buckets: int, clashes: frozenset[int], last: np.uint64, percent: int = PERCENT) -> DataFrame:
    """Front tokens (up to ``last``) of distinct sets, packed by bucket, with those others that short fronts leave in a prefix. ``tokens_of`` takes batches of ``source``."""
    def run(batches):
        held, names, seen, count = [], [], set(), 0

        def flush():
            tokens, at = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            order = np.argsort(tokens, kind="stable")
            every, out = np.array(names, np.int64), []
            for bucket, part in _dealt(order, tokens[order], buckets):
                own, local = np.unique(at[part], return_inverse=True)
                raw = np.array([len(own), len(part)], np.uint32).tobytes() + _planes(every[own]) + _planes(tokens[part], True) + _planes(local.astype(np.uint32))
                out.append((bucket, zstandard.ZstdCompressor(level=1).compress(raw)))
            return _blob_table(out).to_batches()

        for tokens in tokens_of(batches):
            n = len(tokens)
            if not n:
                continue
            name = set_name(tokens, clashes)
            if name in seen:
                continue
            seen.add(name)
            names.append(name)
            held.append(tokens[: max(int(np.searchsorted(tokens, last, "right")), _prefix(n, percent))])
            count += len(held[-1])
            if count >= HELD:
                yield from flush()
                held, names, seen, count = [], [], set(), 0
        if held:
            yield from flush()

    return source.mapInArrow(run, _BLOBS)


def shared_tokens(posts: DataFrame, buckets: int) -> DataFrame:
    """(set, token, on how many sets it stands) of the tokens that two sets or more posted, packed by set."""
    def run(key, table):
        names, tokens, owners, base = [], [], [], 0
        for blob in table.column("data").to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(blob)
            k, t = np.frombuffer(raw, np.uint32, 2).tolist()
            own, at = _from_planes(raw, np.int64, k, 8)
            some, at = _from_planes(raw, np.uint64, t, at, True)
            local, _ = _from_planes(raw, np.uint32, t, at)
            names.append(own)
            tokens.append(some)
            owners.append(local + np.uint32(base))
            base += k
        names, at = np.unique(np.concatenate(names), return_inverse=True)  # tasks that had one set each posted it
        tokens, owners = np.concatenate(tokens), at.astype(np.uint32)[np.concatenate(owners)]
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])]
        tokens, owners = tokens[new], owners[new]
        head = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        sizes = np.diff(np.r_[head, len(tokens)])
        df = np.repeat(sizes, sizes)
        keep = df > 1
        found = np.zeros(int(keep.sum()), _SHARED)
        found["set"], found["token"], found["df"] = names[owners[keep]], tokens[keep], df[keep]
        found = found[np.argsort(found["set"], kind="stable")]
        return _blob_table([(b, _pack(part)) for b, part in _dealt(found, found["set"], buckets)])

    return posts.groupBy("bucket").applyInArrow(run, _BLOBS)


def prefixes(shared: DataFrame, sets: DataFrame, buckets: int, last: np.uint64, percent: int = PERCENT, names: bool = False) -> DataFrame:
    """Those prefix tokens of each set that others posted too, packed by token; nothing of sets whose prefix is all their own.

    ``sets``: (set, n, m), its size and how many front tokens it has. ``names``: the sets alone, not their tokens.
    """
    def sizes(batches):
        for batch in batches:
            own = np.zeros(batch.num_rows, _SIZES)
            for k, f in enumerate(_SIZES.names):
                own[f] = batch.column(k).to_numpy()
            yield from _blob_table([(b, _pack(part)) for b, part in _dealt(own, np.ascontiguousarray(own["set"]), buckets)], 1).to_batches()

    def run(key, table):
        kinds = np.array(table.column("kind").to_pylist())
        blobs = table.column("data").to_pylist()
        own = _unpack([b for b, k in zip(blobs, kinds, strict=True) if k], _SIZES)
        found = _unpack([b for b, k in zip(blobs, kinds, strict=True) if not k], _SHARED)
        own = own[np.argsort(own["set"])]
        front = found["token"] <= last
        found = found[np.lexsort((found["token"], np.where(front, found["df"], np.uint32(0xFFFFFFFF)), found["set"]))]
        front = found["token"] <= last
        at = np.searchsorted(own["set"], found["set"])
        if not len(found):
            return pa.table({"set": pa.array([], pa.int64())}) if names else _blob_table([])
        new = np.r_[True, found["set"][1:] != found["set"][:-1]]
        head, of = np.flatnonzero(new), np.cumsum(new) - 1
        rank, fronts = np.arange(len(found)) - head[of], np.add.reduceat(front.astype(np.int64), head)[of]
        n, m = own["n"][at].astype(np.int64), own["m"][at].astype(np.int64)
        # front tokens of this set alone come first of all
        keep = np.where(front, rank < _prefix(n, percent) - (m - fronts), True)
        if names:
            return pa.table({"set": np.unique(found["set"][keep])})
        posts = np.zeros(int(keep.sum()), _POST)
        posts["token"], posts["set"], posts["n"] = found["token"][keep], found["set"][keep], n[keep]
        posts = posts[np.argsort(posts["token"], kind="stable")]
        return _blob_table([(b, _pack(part)) for b, part in _dealt(posts, np.ascontiguousarray(posts["token"]), buckets)])

    return shared.union(sets.select("set", "n", "m").mapInArrow(sizes, _BLOBS)).groupBy("bucket").applyInArrow(run, "set long" if names else _BLOBS)


def lists(posts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Token lists with two sets or more: (token, set, n, leader). Leader: the smallest set of those in range of size."""
    def run(key, table):
        posts = _unpack(table.column("data").to_pylist(), _POST)
        posts = posts[np.lexsort((posts["set"], posts["n"], posts["token"]))]
        same = posts["token"][1:] == posts["token"][:-1]
        keep = np.zeros(len(posts), bool)
        keep[1:] |= same
        keep[:-1] |= same
        posts = posts[keep]
        head = np.flatnonzero(np.r_[True, posts["token"][1:] != posts["token"][:-1]])[: len(posts)]
        leader, n = np.empty(len(posts), np.int64), posts["n"].astype(np.int64)
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(posts)][: len(head)], strict=True):
            while a < b:  # ascending sizes: each leader takes those that it may be linked with
                end = a + int(np.searchsorted(n[a:b], n[a] * 100 // percent, "right"))
                leader[a:end] = posts["set"][a]
                a = end
        return pa.table({"token": pa.array(posts["token"].view(np.int64)), "set": pa.array(posts["set"]), "n": pa.array(n), "leader": pa.array(leader)})

    return posts.groupBy("bucket").applyInArrow(run, "token long, set long, n long, leader long")


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, z): the compressed text of the document that stands for each wanted set."""
    def squeeze(batches):
        own = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.compress((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["doc", "z"])

    # wanted sets grow with the table, so they are never broadcast; texts pass by a hash table of them unsorted
    return docs.mapInArrow(squeeze, "doc long, z binary").join(wanted.hint("shuffle_hash"), "doc").select("set", "z")


def _unpacked(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct sets, ascending, with their tokens; of rows with one id, those whose set is the wanted one."""
    own, found = zstandard.ZstdDecompressor(), {}
    names = table.column("set").to_pylist()
    texts = pa.array([own.decompress(z).decode() for z in table.column("z").to_pylist()], pa.string())
    for name, (_, _, tokens) in zip(names, _sets([pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), texts], names=["set", "text"])]), strict=True):
        if name not in found and len(tokens) and name in set_hash(tokens):
            found[name] = tokens
    return np.array(sorted(found), np.int64), [found[k] for k in sorted(found)]


def _packed_sets(batches):
    """Tokens of the sets of (set, z)."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield from _unpacked(pa.Table.from_batches([batch.slice(a, 256)]))[1]


def _join_groups(members: DataFrame, percent: int, tasks: int, center: str | None = None) -> DataFrame:
    """Rows (gid, set, z) joined within each gid: (set, root), root the first of its links there, or ``center`` if that is among them."""
    def run(key, table):
        sets, tokens = _unpacked(table)
        join = SetJoin(tokens, percent)
        join.run()
        root = sets[join.labels()] if len(sets) else sets
        if center is not None:
            middle = table.column(center)[0].as_py()
            at = int(np.searchsorted(sets, middle))
            if at < len(sets) and sets[at] == middle:
                root = np.where(root == root[at], middle, root)
        return pa.table({"set": pa.array(sets, pa.int64()), "root": pa.array(root, pa.int64())})

    columns = ["gid", "set", "z", *([center] if center else [])]
    return members.select(*columns).repartition(tasks, "gid").groupBy("gid").applyInArrow(run, "set long, root long")


def _chunk(sets: Column, tokens: Column, of: Column) -> Column:
    """Which of the chunks of about BLOCK members and BLOCK_TOKENS tokens a set belongs to."""
    return F.pmod(F.xxhash64(F.lit(11), of), F.greatest(F.lit(1), F.ceil(sets / BLOCK), F.ceil(tokens / BLOCK_TOKENS))).cast("int")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per document."""
    spark = docs.sparkSession
    own = _input(docs, doc_id, text)
    rows = materialize(survey(own), "survey")
    first = materialize(rows.where("h1 IS NOT NULL AND doc IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.min("n").alias("n"), F.min("m").alias("m")), "sets")
    # by the birthday bound a handful of sets even among billions
    clashes = frozenset(r.h1 for r in first.groupBy("h1").count().where("count > 1").collect())
    name = F.when(F.col("h1").isin(*clashes), F.col("h2")).otherwise(F.col("h1")) if clashes else F.col("h1")
    first, rows = first.select(name.alias("set"), "doc", "n", "m"), rows.select("doc", "n", name.alias("set"))
    every, here = partitions(spark), own.where("doc IS NOT NULL")
    count = lambda df, column: df.agg(F.sum(column)).first()[0] or 0

    # 2. sets that may be linked: by their front tokens, then by all of their tokens
    posts = postings(here, lambda batches: (tokens for _, _, tokens in _sets(batches)), int(max(every, -(-count(first, F.greatest("m", F.col("n") / 4)) // BUCKET))), clashes, LAST_FRONT, percent)
    alive = materialize(prefixes(shared_tokens(posts, every), first, every, LAST_FRONT, percent, names=True).join(first, "set").select("set", "doc", "n"), "alive")
    texts = materialize(packed_texts(own, alive.select("set", "doc")), "texts")
    total = count(alive, "n")
    posts = postings(texts, _packed_sets, int(max(every, -(-total // BUCKET))), clashes, LAST, percent)
    listed = materialize(lists(prefixes(shared_tokens(posts, every), alive.withColumn("m", F.col("n")), every, LAST, percent), percent), "lists")
    tasks = int(max(every, -(-total // TASK_TOKENS)))

    # 3. leaders, and exact joins around them
    size = listed.groupBy("set").agg(F.max("n").alias("n"))
    votes = listed.where("set <> leader").groupBy("set", "leader").agg(F.count(F.lit(1)).alias("votes"))
    leader = votes.groupBy("set").agg(F.max(F.struct(F.col("votes"), (-F.col("leader")).alias("minus"))).alias("best")).select("set", (-F.col("best.minus")).alias("leader"))
    led = materialize(size.join(leader, "set", "left").select("set", "n", F.coalesce("leader", "set").alias("leader")), "led")
    led = materialize(led.join(led.select(F.col("set").alias("leader"), F.col("leader").alias("boss")), "leader", "left").select("set", "n", "leader", F.coalesce("boss", "leader").alias("boss")), "led")
    members = led.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    groups = led.join(members, "leader").where((F.col("members") > 1) & (F.col("set") != F.col("leader")))
    groups = groups.select(F.xxhash64("leader", _chunk(F.col("members"), F.col("tokens"), F.col("set"))).alias("gid"), "leader", "set")
    groups = groups.union(groups.select("gid", "leader", F.col("leader").alias("set")).distinct())
    near = materialize(_join_groups(groups.join(texts, "set"), percent, tasks, "leader"), "near")
    wider = led.groupBy("boss").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"), (F.min("leader") != F.max("leader")).alias("several"))
    wider = led.join(wider.where((F.col("members") > BLOCK) | F.col("several")), "boss")
    wider = wider.select(F.xxhash64("boss", _chunk(F.col("members"), F.col("tokens"), F.xxhash64(F.lit(5), "set"))).alias("gid"), "set")
    near = near.union(materialize(_join_groups(wider.join(texts, "set"), percent, tasks), "wider")).where("set <> root").distinct()
    near = materialize(near, "near")

    # 4. blocks: large connected groups by their label, others by their leader's leader
    known = components(near.select(F.col("set").alias("a"), F.col("root").alias("b")))
    held = led.join(known.select(F.col("v").alias("set"), "label"), "set", "left").select("set", "n", "boss", F.coalesce("label", "set").alias("root"))
    grown = held.groupBy("root").agg(F.count(F.lit(1)).alias("together"))
    held = held.join(grown, "root").withColumn("kin", F.when(F.col("together") >= KIN, F.col("root")))
    held = held.withColumn("of", F.coalesce("kin", "boss")).withColumn("mixed", F.col("kin").isNull())
    crowd = held.groupBy("of", "mixed").agg(F.count(F.lit(1)).alias("crowd"), F.sum("n").alias("tokens"))
    held = held.join(crowd, ["of", "mixed"])
    held = held.select("set", "n", "kin", F.xxhash64("of", "mixed", _chunk(F.col("crowd"), F.col("tokens"), F.col("set"))).alias("block"))
    held = materialize(held, "blocks")
    meets = listed.select("token", "set").join(held, "set").groupBy("token", "block").agg(F.max("kin").alias("kin"), F.min("n").alias("low"), F.max("n").alias("high"))
    meets = materialize(meets, "meets")
    left, right = meets.alias("l"), meets.alias("r")
    fit = (F.col("l.low") * percent <= F.col("r.high") * 100) & (F.col("r.low") * percent <= F.col("l.high") * 100)
    apart = ~F.coalesce(F.col("l.kin") == F.col("r.kin"), F.lit(False))
    pairs = left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.block") < F.col("r.block")) & fit & apart).select(F.col("l.block").alias("a"), F.col("r.block").alias("b")).distinct()
    crowded = held.where(F.col("kin").isNull()).groupBy("block").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    pairs = materialize(pairs.union(crowded.select(F.col("block").alias("a"), F.col("block").alias("b"))), "pairs")
    sides = pairs.select(F.xxhash64("a", "b").alias("gid"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    far = _join_groups(sides.join(held.select("set", "block"), "block").join(texts, "set"), percent, tasks)

    # 5. components of documents: a set stands for its smallest document
    edges = near.union(materialize(far, "far").where("set <> root")).distinct()
    edges = edges.join(first.select("set", F.col("doc").alias("a")), "set").join(first.select(F.col("set").alias("root"), F.col("doc").alias("b")), "root").select("a", "b")
    # rows of one id with different texts connect their sets
    copies = rows.where("set IS NOT NULL AND doc IS NOT NULL").join(first.select("set", F.col("doc").alias("first")), "set").select("doc", "n", "set", "first")
    edges = edges.union(copies.where("doc <> first").join(copies.groupBy("doc").agg((F.min("set") != F.max("set")).alias("several")).where("several"), "doc").select(F.col("doc").alias("a"), F.col("first").alias("b")))
    label = components(materialize(edges, "links"))
    whole = rows.join(first.select("set", F.col("doc").alias("first")), "set", "left")
    whole = whole.withColumn("first", F.coalesce("first", "doc")).join(label, F.col("first") == F.col("v"), "left")
    return whole.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("label", "first")).alias("component_id"))
