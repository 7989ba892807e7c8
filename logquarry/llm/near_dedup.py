"""MinHash near-dedup with SetSketch registers.

1. Each text becomes its set of word shingles (64-bit hashes over keyed library hashes of the words),
   a 128-bit digest of the set, and a SetSketch: registers are exponentially spaced, truncated
   minima, so two sketches merge by the larger register and equal registers are as likely as the sets
   are alike.
2. Rows with equal sets are one class, with the first of them as its representative, before anything
   is compared.
3. Registers are banded; classes that share a band are candidates. In a bucket every member is
   paired with one centre only (a star), never with all others. The joint likelihood of a pair's
   registers estimates its Jaccard similarity; pairs far below the threshold are dropped.
4. Pairs are verified on full shingle sets, grouped by centre in salted groups of bounded size. There
   shingles are named from their words, so a link never rests on a hash.
5. Components are found over verified links. A bucket that still holds several components gets a new
   centre (the member nearest to the registers' consensus); at last all members outside its largest
   component are compared with the whole bucket on full sets, so that a star cannot hide a link. This
   is done block against block, in tasks of bounded size that return links and no pairs: the work in a
   bucket whose members are all alike, but not enough, grows with the square of what is left in it.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PART_BITS, Texts, arrow_map, hash64, held_rows, mix, ship, slices, split_words, stage, word_hashes
from .components import components, extend

SEED = 901
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Pairs that an estimate puts further below the threshold than this (five standard deviations) are not verified.
MARGIN = 0.16
#: Shingles that are compared with one centre in a task, shingles on either side of a block, and members of a bucket that choose a centre together.
GROUP, BLOCK, BUCKET = 100_000, 400_000, 4096
#: A-Z to a-z, other bytes as they are.
FOLD = bytes(range(256)).lower()
#: Shingles whose occurrences are multiplied at once, and multiplications in the time of one look-up.
COLUMNS, FAST = 4096, 50


def bands_for(threshold: float, registers: int = 126) -> tuple[int, int]:
    """Rows and bands whose chance to miss a pair at the threshold is below 1e-4, with as long rows as can be."""
    for rows in range(8, 0, -1):
        bands = registers // rows
        if (1 - threshold**rows) ** bands < 1e-4:
            return rows, bands
    return 1, registers


def shingles(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice, sorted within documents, and n+1 offsets. Fewer words than n are one shingle."""
    words, off = split_words(t, FOLD)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(t.n + 1, np.int64)
    hasher = hash64(SEED)
    h = word_hashes("near").of(words)
    size = np.diff(off)
    grams, doc = hasher.grams(h, n), np.repeat(np.arange(t.n), size)
    inside = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    value, owner = [grams[inside]], [doc[: len(grams)][inside]]
    for k in range(1, n):
        for i in np.flatnonzero(size == k):
            value.append(mix(hasher.grams(h[off[i] : off[i + 1]], k) + np.uint64(k)))
            owner.append(np.array([i]))
    return _distinct(np.concatenate(value), np.concatenate(owner), t.n)


def _distinct(value: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(n + 1))


def named_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Like shingles(), with integer names in place of hashes: equal names for equal word sequences of these texts."""
    names: dict[bytes, int] = {}
    code, size = [], []
    for text in texts:
        words = text.lower().split()
        if 0 < len(words) < n:  # a shingle of its own: its words and a byte that no word has
            words = [b" ".join(words) + b" "] * n
        code += [names.setdefault(w, len(names)) for w in words]
        size.append(len(words))
    code, doc = np.array(code, np.int64), np.repeat(np.arange(len(texts)), size)
    m = max(0, len(code) - n + 1)
    name = code[:m]
    for k in range(1, n):
        name = np.unique(name * np.int64(len(names) + 1) + code[k : k + m], return_inverse=True)[1].astype(np.int64)
    inside = doc[:m] == doc[n - 1 :] if m else np.zeros(0, bool)
    return _distinct(name[inside], doc[:m][inside], len(texts))


def registers(value: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """SetSketch registers (documents x m, uint16); zeros for an empty set."""
    out = np.zeros((len(off) - 1, m), np.uint16)
    some = np.flatnonzero(np.diff(off))
    if not len(some):
        return out
    start = off[:-1][some]
    rng = np.random.Generator(np.random.PCG64(SEED))
    a = rng.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**64, m, dtype=np.uint64)
    for j in range(m):
        least = np.minimum.reduceat(value * a[j] + b[j], start)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
        out[some, j] = np.clip(np.floor(1 - np.log(x / RATE) / math.log(BASE)), 0, TOP + 1)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0.0, 1.0, 101)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches with known set sizes: the maximum of the joint likelihood on a grid."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    p, q = chance(u - v * _GRID), chance(v - u * _GRID)
    like = more[:, None] * np.log(np.maximum(p, 1e-12)) + less[:, None] * np.log(np.maximum(q, 1e-12)) + same[:, None] * np.log(np.maximum(1 - p - q, 1e-12))
    like[_GRID[None, :] > np.minimum(u / v, v / u) + 0.01] = -np.inf
    return _GRID[like.argmax(1)]


def _rid() -> Column:
    return F.shiftleft("part", PART_BITS).bitwiseOR(F.col("row").cast("long"))


def _place(rid: str) -> list[Column]:
    """The part and the row that a rid names."""
    return [F.shiftright(rid, PART_BITS).alias("of_part"), F.col(rid).bitwiseAND((1 << PART_BITS) - 1).cast("int").alias("of_row")]


def _chosen(rows: pa.Table, places: pa.Table) -> pa.Array:
    return pc.is_in(rows.column("row").combine_chunks(), value_set=places.column("of_row").combine_chunks())


def texts_at(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text) of the held rows whose rids are in reps."""

    def pick(rows: pa.Table, places: pa.Table) -> pa.Table:
        own = rows.filter(_chosen(rows, places))
        rid = pc.bit_wise_or(pc.shift_left(own.column("part"), PART_BITS), own.column("row").cast(pa.int64()))
        return pa.table([rid, own.column("text")], names=["rep", "text"])

    return docs.select("part", "row", "text").groupBy("part").cogroup(reps.select(*_place("rep")).groupBy("of_part")).applyInArrow(pick, "rep long, text string")


def sketches(docs: DataFrame, words: int, m: int) -> DataFrame:
    """rid, doc_id, n (shingles), a and b (digest of the set), regs, of rows (part, row, doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        for t in slices(batch.column(2)):
            value, off = shingles(t, words)
            regs = registers(value, off, m)
            digest = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(c)))]) for c in (0x51ED, 0xC0FFEE)]
            d1, d2 = ((c[off[1:]] - c[off[:-1]]).view(np.int64) for c in digest)
            own = slice(*t.rows)
            yield {"rid": batch.column(0).slice(own.start, t.n), "doc_id": batch.column(1).slice(own.start, t.n), "n": np.diff(off), "a": d1, "b": d2, "regs": [r.tobytes() for r in regs]}

    return arrow_map(docs.select(_rid().alias("rid"), "doc_id", "text"), run, f"rid long, doc_id {kind}, n long, a long, b long, regs binary")


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _near(pairs: DataFrame, classes: DataFrame, cut: float) -> DataFrame:
    """Pairs (u, v) whose sketches estimate at least cut, with the shingles of v (nv)."""
    pairs = pairs.join(classes.select(F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("regs").alias("ru")), "u")
    pairs = pairs.join(classes.select(F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("regs").alias("rv")), "v").select("u", "v", "nu", "nv", "ru", "rv")

    def run(batch: pa.RecordBatch):
        if batch.num_rows:
            nu, nv = (np.asarray(batch.column(i), float) for i in (2, 3))
            j = estimate(_regs(batch.column(4).to_pylist()), _regs(batch.column(5).to_pylist()), nu, nv)
            keep = pa.array((j >= cut) & (np.minimum(nu, nv) >= (cut + MARGIN) * np.maximum(nu, nv) - 1e-6))
            yield {"u": batch.column(0).filter(keep), "v": batch.column(1).filter(keep), "nv": batch.column(3).filter(keep)}

    return arrow_map(pairs, run, "u long, v long, nv long")


def _bytes(column: pa.ChunkedArray) -> list[bytes]:
    return column.combine_chunks().cast(pa.large_binary()).to_pylist()


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v, nv) with 100 * |intersection| >= percent * |union| on full sets; texts: (rep, text)."""
    ship(pairs.sparkSession)
    sized = pairs.groupBy("u").agg(F.sum("nv").alias("c")).select(F.col("u").alias("centre"), F.expr(f"cast(ceil(c / {GROUP}) as int)").alias("salts"))
    members = pairs.join(sized, pairs.u == sized.centre).select("centre", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), F.col("v").alias("rep"), F.lit(1).alias("role"))
    centres = sized.select("centre", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.col("centre").alias("rep"), F.lit(0).alias("role"))
    rows = members.unionByName(centres).join(texts, "rep").select("centre", "salt", "role", "rep", "text")

    def check(table: pa.Table) -> pa.Table:
        table = table.sort_by("role")
        value, off = named_sets(_bytes(table.column("text")), words)
        size = np.diff(off)
        has = np.zeros(int(value.max(initial=0)) + 1, bool)
        has[value[: off[1]]] = True
        both = np.diff(np.concatenate([[0], np.cumsum(has[value])])[off])
        ok = (100 * both >= percent * (size[0] + size - both)) & (both > 0)
        ok[0] = False
        keep = pa.array(ok)
        return pa.table({"u": table.column("centre").combine_chunks().filter(keep), "v": table.column("rep").combine_chunks().filter(keep)})

    return rows.groupBy("centre", "salt").applyInArrow(check, "u long, v long")


def _labelled(table: DataFrame, labels: DataFrame) -> DataFrame:
    return table.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _propose(cut: float):
    """Pairs of one bucket: the member nearest to the registers' consensus with the members of other components."""

    def propose(table: pa.Table) -> pa.Table:
        rep, comp = np.asarray(table.column("rep")), np.asarray(table.column("component"))
        n, regs = np.asarray(table.column("n")), _regs(table.column("regs").to_pylist())
        order = np.argsort(rep)
        rep, comp, n, regs = rep[order], comp[order], n[order], regs[order]
        consensus = np.sort(regs, axis=0)[len(regs) // 2]  # the median register
        i = int((regs == consensus).sum(1).argmax())
        others = np.flatnonzero(comp != comp[i])
        if len(others):
            j = estimate(np.broadcast_to(regs[i], regs[others].shape), regs[others], np.full(len(others), float(n[i])), n[others].astype(float))
            others = others[j >= cut]
        return pa.table({"u": np.full(len(others), rep[i]), "v": rep[others], "nv": n[others]})

    return propose


def shared(value: np.ndarray, off: np.ndarray, asked: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of sets, asked x known: by multiplying occurrence matrices, or by look-ups where few shingles are in many sets."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    row, col = np.full(len(off) - 1, -1), np.full(len(off) - 1, -1)
    row[asked], col[known] = np.arange(len(asked)), np.arange(len(known))
    a, k = row[doc] >= 0, col[doc] >= 0
    n = int(value.max(initial=0)) + 1
    use = (np.bincount(value[a], minlength=n) > 0) & (np.bincount(value[k], minlength=n) > 0)
    a, k = a & use[value], k & use[value]
    name = np.cumsum(use) - 1
    width = int(use.sum())
    out = np.zeros((len(asked), len(known)), np.float32)
    av, ar, kv, kr = name[value[a]], row[doc[a]], name[value[k]], col[doc[k]]
    if len(known) * width <= FAST * len(kv):
        for lo in range(0, width, COLUMNS):
            ia, ik = (av >= lo) & (av < lo + COLUMNS), (kv >= lo) & (kv < lo + COLUMNS)
            left, right = np.zeros((len(asked), COLUMNS), np.float32), np.zeros((len(known), COLUMNS), np.float32)
            left[ar[ia], av[ia] - lo] = 1
            right[kr[ik], kv[ik] - lo] = 1
            out += left @ right.T
    else:
        start = np.searchsorted(ar, np.arange(len(asked) + 1))
        for i in range(len(asked)):
            has = np.zeros(width, bool)
            has[av[start[i] : start[i + 1]]] = True
            out[i] = np.bincount(kr[has[kv]], minlength=len(known))
    return out.astype(np.int64)


def _cross(words: int, percent: int):
    """Links between components of one bucket: each member asked for (role 0) against the others (role 1), one link to a component."""

    def cross(table: pa.Table) -> pa.Table:
        table = table.sort_by([("role", "ascending"), ("rep", "ascending")])
        role, rep, comp = (np.asarray(table.column(c)) for c in ("role", "rep", "component"))
        value, off = named_sets(_bytes(table.column("text")), words)
        size, asked, known = np.diff(off), np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        us, vs = [], []
        if len(asked) and len(known):
            both = shared(value, off, asked, known)
            near = (100 * both >= percent * (size[asked][:, None] + size[known][None, :] - both)) & (comp[asked][:, None] != comp[known][None, :])
            for i in np.flatnonzero(near.any(1)):
                others = known[near[i]]
                _, first = np.unique(comp[others], return_index=True)
                us += [rep[asked[i]]] * len(first)
                vs += rep[others[first]].tolist()
        return pa.table({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return cross


def link_classes(classes: DataFrame, texts_of, words: int, percent: int, m: int, rounds: int = 1) -> DataFrame:
    """(node, component) over classes (rep, n, regs); texts_of(reps) gives their texts."""
    threshold = percent / 100
    rows, bands = bands_for(threshold, m)
    key = [F.xxhash64(F.substring("regs", 1 + 2 * rows * i, 2 * rows)) for i in range(bands)]
    banded = classes.select("rep", "n", F.posexplode(F.array(*key)).alias("band", "key"))
    centres = stage(banded.groupBy("band", "key").agg(F.min("rep").alias("u"), F.max("rep").alias("w")).where("u < w").drop("w"), "centres")
    members = stage(banded.join(centres, ["band", "key"]).select("band", "key", "rep", "n", "u"), "members")
    texts = stage(texts_of(members.select("rep").distinct()), "texts")
    tested = stage(_near(members.where("rep <> u").select("u", F.col("rep").alias("v")).distinct(), classes, threshold - MARGIN), "near")
    labels = components(stage(verify(tested, texts, words, percent), "verified"))
    ship(classes.sparkSession)

    def still_open() -> tuple[DataFrame, DataFrame]:
        """Members of buckets that hold several components, and for each bucket its members, its shingles, and its largest component with its shingles."""
        every = _labelled(members.select("band", "key", "rep", "n"), labels)
        by = every.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        main = F.max(F.struct("c", "component", "s"))
        many = by.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("c"), F.sum("s").alias("s"), main.alias("m")).where("k > 1")
        many = stage(many.select("band", "key", "c", "s", F.col("m.component").alias("main"), F.col("m.s").alias("main_s")), "open")
        return stage(every.join(many.select("band", "key"), ["band", "key"]), "inside"), many

    for turn in range(rounds):
        inside, many = still_open()
        if many.isEmpty():
            return labels
        salt = F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("c") / BUCKET)).cast("int")
        wide = inside.join(many, ["band", "key"]).join(classes.select("rep", "regs"), "rep").select("band", "key", salt.alias("salt"), "rep", "component", "n", "regs")
        proposed = wide.groupBy("band", "key", "salt").applyInArrow(_propose(threshold - MARGIN), "u long, v long, nv long")
        known = tested.select("u", "v").union(tested.select("v", "u"))
        fresh = stage(proposed.where("u <> v").distinct().join(known, ["u", "v"], "left_anti"), "fresh")
        tested = tested.unionByName(fresh)
        labels = extend(labels, stage(verify(fresh, texts, words, percent), "verified"))
    # exact: all that is not in a bucket's largest component against the whole bucket, in blocks of bounded size
    inside, many = still_open()
    if many.isEmpty():
        return labels
    blocks = many.select("band", "key", "main", F.ceil((F.col("s") - F.col("main_s")) / BLOCK).cast("int").alias("nu"), F.ceil(F.col("s") / BLOCK).cast("int").alias("nv"))
    rows_ = inside.join(blocks, ["band", "key"])
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    asked = rows_.where("component <> main").select("band", "key", block("nu").alias("iu"), F.explode(F.expr("sequence(0, nv - 1)")).alias("iv"), "rep", "component", F.lit(0).alias("role"))
    others = rows_.select("band", "key", F.explode(F.expr("sequence(0, nu - 1)")).alias("iu"), block("nv").alias("iv"), "rep", "component", F.lit(1).alias("role"))
    grouped = asked.unionByName(others).join(texts, "rep").groupBy("band", "key", "iu", "iv")
    return extend(labels, stage(grouped.applyInArrow(_cross(words, percent), "u long, v long"), "crossing"))


def linked_rows(docs: DataFrame, words: int, percent: int, m: int) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and head (the rid of the component's first row) of held rows (part, row, doc_id, text)."""
    sig = stage(sketches(docs, words, m), "sketches")
    whole = sig.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    classes = stage(whole.groupBy("n", "a", "b").agg(first.alias("first"), F.first("regs").alias("regs")).withColumn("rep", F.col("first.rid")), "classes")
    labels = link_classes(classes.select("rep", "n", "regs"), partial(texts_at, docs), words, percent, m)
    named = stage(_labelled(classes.select("n", "a", "b", "rep", "first"), labels), "named")
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    named = stage(named.join(heads, "component").select("n", "a", "b", F.col("head.doc_id").alias("component_id"), F.col("head.rid").alias("head")), "heads")
    linked = whole.select("rid", "doc_id", "n", "a", "b").join(named, ["n", "a", "b"]).select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "head")
    alone = sig.where("n = 0").select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("rid").alias("head"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", m: int = 126) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Rows whose shingle sets have 100 * |intersection| >= percent * |union| are linked, each by its own
    text; component_id is the smallest doc_id of the rows reachable (null only if all their ids are
    null), kept marks the rows with this id. A null or empty text, or one without words, has no
    shingles and is linked with nothing. Repeated rows share a component; rows of one id with
    different texts may have different ones. An empty table gives no rows.
    """
    base = held_rows(docs, "rows", F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return linked_rows(base, words, percent, m).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", m: int = 126) -> DataFrame:
    """docs without the near-copies: one row of each component stays, that of the smallest id (null the last), the first of repeated rows."""
    rows = held_rows(docs, "rows", F.struct(*docs.columns).alias("own"))
    own = F.col("own")
    gone = linked_rows(rows.select("part", "row", own[id_col].alias("doc_id"), own[text_col].alias("text")), words, percent, m).where("rid <> head")

    def rest(held: pa.Table, places: pa.Table) -> pa.Table:
        return held.filter(pc.invert(_chosen(held, places))).select(["own"])

    kept = rows.groupBy("part").cogroup(gone.select(*_place("rid")).groupBy("of_part")).applyInArrow(rest, f"own {rows.schema['own'].dataType.simpleString()}")
    return kept.select(*[F.col("own")[c].alias(c) for c in docs.columns])
