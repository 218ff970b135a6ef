"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters, each pair verified once.

Documents with equal shingle sets form a class; classes are joined. Candidates come from shared prefix shingles. A
first pass compares every class with its buckets' pivots only (a star, linear in the bucket); what it links is one
component. A second pass compares the pairs of a bucket whose components still differ, so every link between different
components is found while a group of near copies never expands into all its pairs. Buckets above ``BLOCK`` rows are
joined block by block.

The suffix filter bounds the sets' difference by dividing the order of hashes: parts of two sets differ in at least as
many shingles as their sizes do, and the parts are halved while a pair survives. Before it, parity bitmaps dismiss pairs
where they meet: two sets differ in at least as many shingles as their bitmaps differ in bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .components import components
from .textkernel import U, Words, mix, shingles, steps

#: Words of a shingle; a link needs 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 4, 85
#: Shingles whose counts order the prefixes, at most: the most frequent of all documents'. The others count as rare;
#: the bound (10 MB on each worker) changes the order, and so the work, never the result.
FREQUENT = 1 << 20
#: Shingles counted together before counts of 2 and more go to the shuffle; rows of a bucket joined at once.
COUNT_STEP, BLOCK = 1 << 20, 1024
WORDS = 8  # 64-bit words of a parity bitmap
#: Parts into which the suffix filter divides a set at most, and the widths that it compares, coarse to fine.
PARTS, WIDTHS = 512, (64, 8, 1)
_MASK_BITS, _MOST_MASK_BITS = 23, 27


def _sets(texts, k: int):
    """(position, sorted distinct shingle hashes) of each text, in order."""
    for part in steps(texts):
        words = Words([b for _, b in part])
        yield from zip((i for i, _ in part), shingles(words.hashes(), words.offset, k))


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, level) of the most frequent shingles over all documents, ``FREQUENT`` at most.

    Counts of all text are gathered; those of 1 within some two million shingles carry no news and stay behind.
    """

    def run(batches):
        held, size = [], 0

        def counted():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            u, n = u[n > 1], n[n > 1]
            return pd.DataFrame({"h": u.view(np.int64), "n": n})

        for batch in batches:
            for _, z in _sets(batch["text"], k):
                held.append(z)
                size += len(z)
                if size >= COUNT_STEP:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    counts = materialise(docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 4).cast("int")), "counts")
    total, least = 0, 0
    for r in counts.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # a few hundred levels
        total += r["n"]
        if total > FREQUENT:
            least = r["level"] + 1
            break
    rows = counts.where(F.col("level") >= least).select("h", "level").toPandas()
    discard(counts)
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["level"].to_numpy(np.int16)[order]


def _bitmap(z: np.ndarray) -> np.ndarray:
    odd = np.bincount(((z * U(0xD6E8FEB86659FD93)) >> U(64 - 9)).view(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parts(z: np.ndarray) -> bytes:
    """How many shingles of a set lie in each of ``PARTS`` parts of the order of hashes, 255 at most."""
    return np.minimum(np.bincount((z >> U(64 - 9)).view(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def suffix_filter(x: np.ndarray, y: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs can still link, by the sizes of their sets' parts (rows of ``PARTS``); ``total`` is both sets' size.

    The intersection is (total - difference) / 2 at most. Sizes above 255 count as 255, which only lowers the bound.
    """
    alive = np.arange(len(total))
    for width in WIDTHS:
        keep = []
        for at in range(0, len(alive), 512):
            rows = alive[at : at + 512]
            a, b = (v[rows].reshape(len(rows), PARTS // width, width).sum(2, dtype=np.int32) for v in (x, y))
            keep.append((100 + percent) * (total[rows] - np.abs(a - b).sum(1)) >= 2 * percent * total[rows])
        alive = alive[np.concatenate(keep)] if keep else alive
    return alive


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, hub, tokens, b0..): each row's set size, set signature, rare-first prefix and bitmap."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(frequent_shingles(docs, k))  # FREQUENT entries of 10 bytes at most

    def run(batches):
        frequent, level = held.value
        for batch in batches:
            n, s1, s2, hub, tokens, maps = [], [], [], [], [], []
            for _, z in _sets(batch["text"], k):
                n.append(len(z))
                x = mix(z + U(0x51ED270B7A1C9E35))
                s1.append(int(np.add.reduce(x).view(np.int64)) if len(z) else 0)
                s2.append(int(np.bitwise_xor.reduce(mix(x)).view(np.int64)) if len(z) else 0)
                if len(frequent) and len(z):
                    at = np.minimum(np.searchsorted(frequent, z), len(frequent) - 1)
                    rank = np.where(frequent[at] == z, level[at] + 1, 0).astype(np.int16)
                    ordered = z[np.argsort(rank, kind="stable")]
                    hub.append(int(1000 * np.count_nonzero(rank) // len(z)))
                else:
                    ordered = z
                    hub.append(0)
                tokens.append(ordered[: len(z) - -(-percent * len(z) // 100) + 1].view(np.int64) if len(z) else np.empty(0, np.int64))
                maps.append(_bitmap(z))
            maps = np.array(maps, dtype=np.int64).reshape(-1, WORDS)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "s1": s1, "s2": s2, "hub": hub, "tokens": tokens} | {f"b{j}": maps[:, j] for j in range(WORDS)})

    schema = "doc_id long, n long, s1 long, s2 long, hub int, tokens array<long>, " + ", ".join(f"b{j} long" for j in range(WORDS))
    return docs.mapInPandas(run, schema)


def _enough(percent: int, a: Column, b: Column, overlap: Column) -> Column:
    return (100 + percent) * overlap >= percent * (a + b)


def _positional(percent: int, x: str, y: str) -> Column:
    """Length filter, and the positional one: what can still be shared after a common shingle at these places."""
    n, m, p, q = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & _enough(percent, n, m, F.least(p, q) + F.least(n - p, m - q))


def _parity(percent: int, x: str, y: str) -> Column:
    differ = sum((F.bit_count(F.col(f"{x}.b{j}").bitwiseXOR(F.col(f"{y}.b{j}"))) for j in range(WORDS)), F.lit(0))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    # the intersection is (n + m - difference) / 2 at most
    return (100 + percent) * (n + m - differ) >= 2 * percent * (n + m)


def _masked(ids: DataFrame, bits: int = _MASK_BITS) -> tuple[Column, object]:
    """The slot of a doc_id, and a fixed bitmap of the slots of ``ids``: it spares most texts, joins decide the rest."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).cast("int")
    words = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("m")).toPandas()
    mask = np.zeros(1 << (bits - 6), dtype=np.int64)  # 1 MB, or 16 MB at most, whatever the input
    mask[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    return slot, ids.sparkSession.sparkContext.broadcast(mask)


def _wanted(held, slot: pd.Series) -> np.ndarray:
    s = slot.to_numpy(np.int64)
    return (held.value[s >> 6] >> (s & 63)) & 1 == 1


def _both(pairs: DataFrame, rows: DataFrame, *cols: str) -> DataFrame:
    """Each pair with the columns of its rows, as x_ and y_."""
    for key, side in (("a", "x"), ("b", "y")):
        pairs = pairs.join(rows.select(F.col("doc_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in cols]), key)
    return pairs


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of ids that link, by their whole sets; each pair is compared once.

    The suffix filter reads sizes of parts before any text is moved; texts take less room than their sets.
    """
    candidates = materialise(pairs, "pairs")
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    slot, held = _masked(candidates.select(F.explode(F.array("a", "b")).alias("doc_id")))

    def run(batches):
        for batch in batches:
            batch = batch[_wanted(held, batch["slot"])]
            found = [(len(z), parts(z)) for _, z in _sets(batch["text"], k)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": [f[0] for f in found], "parts": [f[1] for f in found], "text": batch["text"], "slot": batch["slot"]})

    rows = materialise(docs.withColumn("slot", slot).mapInPandas(run, "doc_id long, n long, parts binary, text string, slot int"), "candidates")

    def near(batches):
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), dtype=np.uint8).reshape(-1, PARTS) for c in ("x_parts", "y_parts"))
                yield batch[["a", "b"]].iloc[suffix_filter(x, y, (batch["x_n"] + batch["y_n"]).to_numpy(), percent)]

    pairs = materialise(_both(candidates, rows, "n", "parts").mapInPandas(near, "a long, b long").distinct(), "near")
    _, kept = _masked(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))

    @F.pandas_udf("boolean")
    def wanted(slot: pd.Series) -> pd.Series:
        return pd.Series(_wanted(kept, slot))

    texts = rows.where(wanted("slot")).select("doc_id", "text")

    def compare(batches):
        for batch in batches:
            keep = []
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                for (_, x), (_, y) in zip(_sets(part["x_text"], k), _sets(part["y_text"], k)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    links = materialise(_both(pairs, texts, "text").mapInPandas(compare, "a long, b long").distinct(), "links")
    discard(candidates, pairs, rows)
    return links


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: its set size and the smallest id that links reach.

    ``count_links`` adds n_links, the documents that link with the row's own, those with equal sets among them. For
    it every pair of a bucket is compared, so a group of m near copies costs m * (m - 1) / 2 comparisons; components
    need only the pairs that connect them, and without it no others are looked for. Null texts and texts without words have no shingles and link with
    nothing; repeated rows are returned as often. Rows that share an id count as one document with several texts: all its
    classes are in one component, while n_shingles and n_links are the row's own. A null doc_id has a null component. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialise(prefixes(docs, k, percent), "prefixes")
    # only classes of several rows are joined back, from files, so that Spark can split a class that holds most rows
    key = ["s1", "s2", "n"]
    classes = materialise(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size"), "classes")
    wide = ["hub", "tokens", *[f"b{j}" for j in range(WORDS)]]
    rep = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    members = sets.join(classes, key, "left").select("doc_id", "n", rep.alias("rep"), *wide)
    members = materialise(members.select("doc_id", "n", "rep", *[F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in wide]), "members")
    discard(sets, classes)
    reps = members.where("doc_id = rep").select("rep", "n", *wide)
    members = members.select("doc_id", "n", "rep")
    maps = reps.select("rep", "n", *[f"b{j}" for j in range(WORDS)])
    # an id with several texts holds their classes together
    several = materialise(members.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("doc_id"), "several")
    same_id = materialise(members.join(several, "doc_id").where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "same")

    # most prefix shingles are one class's own: they are counted in narrow rows, and only the others' rows are kept
    rows = reps.select("rep", "n", "hub", F.posexplode("tokens").alias("pos", "token"))
    shared = materialise(reps.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "shared")
    rows = materialise(rows.join(shared, "token"), "buckets")
    discard(shared)
    pivots = rows.groupBy("token").agg(F.max(F.struct("hub", (-F.col("rep")).alias("back"), "n", "pos")).alias("p"))
    pivots = materialise(pivots.select("token", (-F.col("p.back")).alias("pivot"), F.struct(F.col("p.n").alias("n"), F.col("p.pos").alias("pos")).alias("y")), "pivots")

    # first pass: each class against its buckets' pivots
    star = rows.join(pivots, "token").where("rep <> pivot").withColumn("x", F.struct("n", "pos")).where(_positional(percent, "x", "y"))
    star = star.select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
    star = star.join(maps.select(F.col("rep").alias("a"), F.struct(*maps.columns).alias("x")), "a").join(maps.select(F.col("rep").alias("b"), F.struct(*maps.columns).alias("y")), "b")
    star = materialise(star.where(_parity(percent, "x", "y")).select("a", "b").distinct(), "star")
    discard(pivots)
    links = verified(docs, star, k, percent)
    found = components(links.unionByName(same_id))
    discard(several, same_id)

    # second pass: pairs of a bucket whose components still differ, or all where links are counted
    buckets, labelled = rows, rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rows = materialise(labelled.select("token", "rep", "n", "pos", "component"), "labelled")
    discard(buckets)
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where(F.lit(count_links) | (F.col("lo") != F.col("hi")))
    open_rows = rows.join(mixed.select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "token").join(maps, ["rep", "n"])
    side = F.struct("rep", "n", "pos", "component", *[f"b{j}" for j in range(WORDS)])
    left = open_rows.select("token", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), side.alias("x"))
    right = open_rows.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), side.alias("y"))
    # the smaller class of a pair finds it within its shorter prefix already
    shorter = F.col("x.pos") <= F.col("x.n") - F.ceil(F.lit(2 * percent) * F.col("x.n") / F.lit(100 + percent))
    first = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
    again = left.join(right, (left["token"] == right["token"]) & (left["block"] == right["block"]) & (F.lit(count_links) | (F.col("x.component") != F.col("y.component"))) & first & shorter & _positional(percent, "x", "y") & _parity(percent, "x", "y"))
    again = again.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    more = verified(docs, again, k, percent)
    discard(star, rows)
    # components known so far are stars already; only the second pass's links are new
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    result = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")]
    if not count_links:
        return out.select(*result)
    links = links.unionByName(more)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = materialise(members.where("rep IS NOT NULL").groupBy("rep").agg(F.countDistinct("doc_id").alias("size")), "sizes")
    degree = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    out = out.join(degree, "rep", "left").join(size, "rep", "left")
    return out.select(*result, (F.coalesce("others", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).alias("n_links"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and the transitive closure of those that link.
ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= {PERCENT} * (a.n + b.n - i)
), e2 AS (
  SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), r AS (
  SELECT doc_id AS d, doc_id AS t FROM documents
  UNION
  SELECT r.d, e2.y FROM r JOIN e2 ON e2.x = r.t
)
SELECT d AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(t) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY d
"""


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows, all columns, without near-duplicates: of each component the document with the smallest id stays.

    Of rows that share an id one stays, the first by text and then by the other columns. Rows without an id belong to
    no component and all stay. It is decided on ids alone: rows whose slot holds no id to be judged are kept where they
    are, and only the others are joined, so the texts that stay are not moved.
    """
    out = join(docs, k, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("times"))
    out = materialise(out.where("doc_id <> component OR times > 1"), "judged")
    bits = min(_MOST_MASK_BITS, max(_MASK_BITS, (16 * out.count()).bit_length()))
    slot, held = _masked(out, bits)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id")).withColumn("slot", slot)

    @F.pandas_udf("boolean")
    def judged(slot: pd.Series) -> pd.Series:
        return pd.Series(_wanted(held, slot))

    kept = rows.where(~judged("slot") | F.col("doc_id").isNull()).select("row")
    rest = rows.where(judged("slot") & F.col("doc_id").isNotNull()).join(out, "doc_id", "left").where("component IS NULL OR doc_id = component")
    rest = materialise(rest.select("doc_id", "times", "row"), "rest")
    alone = rest.where("coalesce(times, 1) = 1").select("row")
    names = ["text", *[f.name for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]]
    first = rest.where("times > 1").groupBy("doc_id").agg(F.min_by("row", F.struct(*[F.col("row")[c] for c in names])).alias("row")).select("row")
    return kept.unionByName(alone).unionByName(first).select("row.*")
