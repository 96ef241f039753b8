"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of five-word shingles; texts with one set form a
   class, and only classes go on.
2. MinHash bands put classes into buckets.  Each bucket first proposes its
   members against one centre, the member that shares most of its buckets.
3. Signatures are compared batch by batch; a pair goes as soon as the
   posterior chance of a similarity of ``THRESHOLD`` or more falls below
   ``MISS``.  What survives is verified on the full sets.
4. Verified links are joined to components.  Buckets that still hold several
   components then compare all members of different components, in blocks of
   bounded size: the same signatures prune, and survivors are verified within
   the block, each in the first bucket that holds both.

No bucket is dropped or cut, and no group is emitted as all its pairs: what
leaves a block is links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import stage
from tessera.llm.graph import components

THRESHOLD = 75  # per cent
ROWS, BANDS = 5, 40  # a pair at the threshold shares no bucket with probability 2e-5
HASHES = ROWS * BANDS
BATCH = 25
MISS = 1e-5
BLOCK = 256

_MULTIPLIERS = np.random.default_rng(4).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _needed() -> list[int]:
    """Fewest matches after each batch that keep a pair: with a uniform prior
    the posterior of similarity t or more after m of n matches is
    P(Binomial(n + 1, t) <= m)."""
    t, out = THRESHOLD / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if total >= MISS:
                break
            m += 1
        out.append(m)
    return out


NEEDED = _needed()


def signature(distinct: np.ndarray) -> np.ndarray:
    """``HASHES`` minima over a set of shingle hashes."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(distinct), 512):
        np.minimum(low, (distinct[i:i + 512, None] * _MULTIPLIERS).min(axis=0), out=low)
    return low


def likely(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row numbers of the pairs whose signatures survive every batch."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, need in enumerate(NEEDED):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches += (left[alive, cut] == right[alive, cut]).sum(axis=1)
        stay = matches >= need
        alive, matches = alive[stay], matches[stay]
    return alive


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, nid, g, sig, keys = [], [], [], [], []
        for i, j, h, d, _, _ in W.words(batch.column("text")):
            at = W.bounds(d, j - i)
            for k in range(j - i):
                s = np.unique(W.shingles(h[at[k]:at[k + 1]]))
                n.append(len(s))
                if not len(s):
                    nid.append(None), g.append(None), sig.append(None), keys.append(None)
                    continue
                low = signature(s)
                nid.append(int(W.mix(s).sum(dtype=np.uint64).view(np.int64)))
                g.append(int(W.mix(s * np.uint64(3)).sum(dtype=np.uint64).view(np.int64)))
                short = low >> np.uint64(48)
                sig.append(short.astype(np.uint16).tobytes())
                # A bucket's key is made of what the signature holds, so two
                # signatures tell which buckets their texts share.
                per = (W.mix(short).reshape(BANDS, ROWS) * W._POSITION[:ROWS]).sum(axis=1, dtype=np.uint64)
                keys.append(W.mix(per + np.arange(BANDS, dtype=np.uint64)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(nid, pa.int64()),
             pa.array(g, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["id", "th", "n", "nid", "g", "sig", "keys"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), HASHES)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keep = likely(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")))
            yield batch.select(["a", "b"]).take(pa.array(keep))


def _set_of(text: str) -> np.ndarray:
    h = np.concatenate([x[2] for x in W.words(pa.array([text], pa.large_string()))])
    return np.unique(W.shingles(h))


def _linked(left: np.ndarray, right: np.ndarray) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(left) + len(right) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, left = None, None
    for batch in batches:
        keep = []
        for r, (a, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")))):
            if a != last:
                last, left = a, _set_of(x)
            if _linked(left, _set_of(y)):
                keep.append(r)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _block_links(band: int, rows: list[tuple]) -> list[tuple[int, int]]:
    """Links between members of different components in one block."""
    side, nid, label, sig, text = zip(*rows)
    side, nid, label = np.array(side), np.array(nid), np.array(label)
    m = np.frombuffer(b"".join(sig), np.uint16).reshape(len(sig), HASHES)
    p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(q)  # a block against itself
    q = p if alone else q
    if not len(p) or not len(q):
        return []
    matches = np.zeros((len(p), len(q)), np.int16)
    for c in range(BATCH):
        matches += m[p, c][:, None] == m[q, c][None, :]
    ok = (matches >= NEEDED[0]) & (label[p][:, None] != label[q][None, :])
    if alone:
        ok = np.triu(ok, 1)
    x, y = np.nonzero(ok)
    x, y = p[x], q[y]
    links, sets = [], {}
    for i in range(0, len(x), 16_384):
        u, v = x[i:i + 16_384], y[i:i + 16_384]
        keep = likely(m[u], m[v])
        u, v = u[keep], v[keep]
        first = (m[u] == m[v]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
        for s, t in zip(u[first].tolist(), v[first].tolist()):
            for k in (s, t):
                if k not in sets:
                    sets[k] = _set_of(text[k])
            if _linked(sets[s], sets[t]):
                links.append((int(nid[s]), int(nid[t])))
    return links


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of blocks (key, i, j), which arrive in order; a block has about
    two times ``BLOCK`` rows."""
    held: list[tuple] = []
    now, band = None, None

    def table(links):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    for batch in batches:
        links = []
        cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", "band", "side", "nid", "label", "sig", "text")]
        for key, i, j, of, *rest in zip(*cols):
            if (key, i, j) != now:
                if len(held) > 1:
                    links += _block_links(band, held)
                now, band = (key, i, j), of
                held.clear()
            held.append(tuple(rest))
        if links:
            yield table(links)
    links = _block_links(band, held) if len(held) > 1 else []
    if links:
        yield table(links)


PAIR = "a long, b long"


def _verified(pairs: DataFrame, reps: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a centre, b member) that pass the signatures and the full sets."""
    sig = reps.select("nid", "sig")
    near = stage(pairs.join(sig.toDF("b", "sig_b"), "b").join(sig.toDF("a", "sig_a"), "a")
                 .select("a", "b", "sig_a", "sig_b").mapInArrow(_compare, PAIR))
    both = (near.join(full.toDF("b", "text_b"), "b").join(full.toDF("a", "text_a"), "a")
            .select("a", "b", "text_a", "text_b"))
    return stage(both.mapInArrow(_verify, PAIR))


def _residual(members: DataFrame, labels: DataFrame, reps: DataFrame, full: DataFrame) -> DataFrame:
    """Links between different components of a bucket."""
    now = stage(members.select("key", "band", "nid").join(labels.toDF("nid", "label"), "nid", "left")
                .select("key", "band", "nid", F.coalesce("label", "nid").alias("label")))
    per = now.groupBy("key", "label").agg(F.count("*").alias("c"))
    open_keys = (per.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"),
                                        F.count("*").alias("labels"))
                 .where("labels > 1")
                 .select("key", F.col("top.label").alias("giant"),
                         F.ceil(F.col("top.c") / BLOCK).alias("giants"),
                         F.ceil((F.col("all") - F.col("top.c")) / BLOCK).alias("strays")))
    rows = now.join(open_keys, "key").withColumn("is_giant", F.col("label") == F.col("giant"))
    own = F.pmod(F.xxhash64("nid"), F.when(F.col("is_giant"), F.col("giants")).otherwise(F.col("strays")))
    # A stray's block meets the stray blocks from its own on and, under negative
    # numbers, every block of the largest component; that one never meets itself.
    meets = F.when(F.col("is_giant"),
                   F.transform(F.sequence(F.lit(0), F.col("strays") - 1),
                               lambda i: F.struct(i.alias("i"), (-1 - F.col("own")).alias("j"), F.lit(1).alias("side")))
                   ).otherwise(F.concat(
                       F.transform(F.sequence(F.lit(0), F.col("strays") - 1),
                                   lambda o: F.struct(F.least(o, F.col("own")).alias("i"),
                                                      F.greatest(o, F.col("own")).alias("j"),
                                                      (o < F.col("own")).cast("int").alias("side"))),
                       F.transform(F.sequence(F.lit(1), F.col("giants")),
                                   lambda g: F.struct(F.col("own").alias("i"), (-g).alias("j"), F.lit(0).alias("side")))))
    dealt = (rows.withColumn("own", own).select("key", "band", "nid", "label", F.explode(meets).alias("m"))
             .select("key", "band", "nid", "label", "m.i", "m.j", "m.side")
             .join(reps.select("nid", "sig").join(full, "nid"), "nid"))
    return stage(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                 .select("key", "i", "j", "band", "side", "nid", "label", "sig", "text").mapInArrow(_blocks, PAIR))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row (id, n_shingles, component_id, kept, text_hash, group).

    Texts are linked when 100 * intersection >= 75 * union of their sets of
    five-word shingles (A-Z lower-cased; a shorter text is one shingle).
    ``component_id`` is the smallest id reachable, ``kept`` says that it is the
    row's own; ``group`` numbers the component and ``text_hash`` tells texts of
    one id apart.  Defined cases: null, empty and blank texts have no shingles,
    are linked with nothing and are kept; rows with one id and different texts
    are compared as different texts; repeated rows get the same result; rows
    with a null id take part, are never kept and have a null component only if
    no id is reachable.  Other input columns play no part.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.withColumn("th", F.xxhash64("text"))
    id_type = dict(texts.dtypes)["id"]
    signed = stage(texts.mapInArrow(_signed, f"id {id_type}, th long, n long, nid long, g long, sig binary, "
                                             "keys array<long>"))
    classes = (signed.where("n > 0").groupBy("nid")
               .agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("rep")))
    rep_rows = classes.select(F.col("nid"), F.col("rep.id").alias("id"), F.col("rep.th").alias("th"))
    chosen = rep_rows.toDF("rnid", "rid", "rth")
    reps = stage(signed.join(chosen, (F.col("nid") == F.col("rnid")) & F.col("id").eqNullSafe(F.col("rid"))
                             & (F.col("th") == F.col("rth")), "left_semi")
                 .select("nid", "id", "th", "sig", "keys").dropDuplicates(["nid"]))

    banded = reps.select("nid", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = stage(banded.join(shared, "key"))
    score = members.groupBy("nid").agg(F.sum("c").alias("score"))
    scored = members.select("key", "nid").join(score, "nid")
    centre = scored.groupBy("key").agg(F.max(F.struct("score", "nid")).alias("top")).select(
        "key", F.col("top.nid").alias("a"))
    pairs = (members.join(centre, "key").where("nid <> a").select("a", F.col("nid").alias("b")).distinct())
    who = reps.select("nid", "id", "th").join(score, "nid", "left_semi").toDF("nid", "rid", "rth")
    full = stage(texts.join(who, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")))
                 .select("nid", "text").dropDuplicates(["nid"]))  # texts of all classes in a bucket
    labels = components(_verified(pairs, reps, full))
    more = _residual(members, labels, reps, full)
    top = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    smallest = (classes.join(top.toDF("nid", "label"), "nid", "left")
                .select("nid", F.coalesce("label", "nid").alias("label"), F.col("rep.id").alias("id")))
    low = smallest.groupBy("label").agg(F.min("id").alias("component_id"))
    component = smallest.join(low, "label").select("nid", "component_id", "label")
    found = signed.select("id", "th", "n", "nid").join(component, "nid", "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"),
                        F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"),
                        F.col("th").alias("text_hash"), F.col("label").alias("group"))
