"""N-gram Jaccard join (operator 6).

Method: a document's prefix is the first part of its shingles in a global order, so long that two documents
similar enough share a shingle of it.  Documents with the same prefix and size form one group; pairs of groups
that share a prefix shingle are filtered by size and by the shingles' places, then expanded to their members and
verified exactly.

The order is by classes of document frequency, rarest first, then by hash.  Frequencies are counted over all
shingles of all documents with packed hash sets per chunk (see exchange.py).  A shingle of one document only can
match nothing, so a document with more of these than it may lack is linked with nothing and goes no further.

Links are only needed as far as they connect documents.  First each group is verified against the hub of its
prefix shingles (the document with the fewest single shingles), which connects groups of near copies by as many
checks as they have members.  Then only pairs from different components are looked for, and all of these are
verified, so no link between components is lost, and copies never become all pairs.

Documents with equal shingle sets are linked and stand for one another.  A null or empty text has no shingles
and is alone.  Shingles are told by 64-bit hashes, so two texts of 200 words each take a wrong shingle for a common
one with a chance of 2**-49.

In linked_documents a row with a null id is alone, and rows that share an id are one vertex, so their texts' links
are joined.  keep_one goes by rows, whatever their ids: of each component one row stays, the one with the smallest
id (null last) and then the smallest digest of its text; of rows equal in id and text one stays.  Extra columns are
carried or ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import exchange as X
from orbitframe.llm import kernels as K
from orbitframe.llm.components import components
from orbitframe.llm.shared import checkpointed

SHINGLE, PERCENT = 4, 85
BITS = 1024  # of the bitmap that filters pairs
TEXT_KEY = 32  # hexadecimal digits of a text's digest


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin; A-Z are lower-cased."""
    out, sizes = [], []
    for _, _, data, at in K.chunks(texts):
        starts, ends, first = K.words_of(data, at)
        words = K.word_hashes(data, starts, ends, lower=True) if len(starts) else np.zeros(0, np.uint64)
        place = np.flatnonzero(K.inside(first, width, len(words)))
        grams = K.gram_hashes(words, width)[place] if len(place) else np.zeros(0, np.uint64)
        doc = np.searchsorted(first, place, side="right") - 1
        n = np.diff(first)
        for k in range(1, width):  # the whole text is one shingle
            short = np.flatnonzero(n == k)
            if len(short):
                grams, doc = np.concatenate([grams, K.gram_hashes(words, k)[first[short]]]), np.concatenate([doc, short])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])) if len(grams) else np.zeros(0, bool)
        out.append(grams[new])
        sizes.append(np.bincount(doc[new], minlength=len(n)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.append(0, np.cumsum(np.concatenate(sizes) if sizes else [])).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """Shingles of a set of n that must meet one of any partner's: n less the fewest common ones, and one."""
    return n - -(-n * percent // 100) + 1


def described(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, number of single shingles and, of documents that may have a link: set_id, digest of the text, and (once per chunk and set) the other shingles in global order."""
    layout = X.layout_of(docs, text_col)
    layout = layout._replace(bits=layout.bits - 8)  # two shingles taken for one only make the filter weaker
    rows = X.chunked(docs, layout, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def send(table: pa.Table) -> pa.Table:
        found = X.HashSet(shingle_sets(X.sorted_docs(table)[1], width)[0], layout)
        chunk = table.column("chunk")[0].as_py()
        out = []
        for b, lo, hi, v in found.buckets():
            count = found.count[lo:hi]
            out.append((b, X.join_parts(X.pack(v), X.bit_list(count > 1), count[count > 1].astype("<i4").tobytes())))
        return X.binary_table(["bucket", "chunk", "payload"], [o[0] for o in out], [chunk] * len(out), [o[1] for o in out])

    def classes(table: pa.Table) -> pa.Table:
        """One byte per shingle: the bits of its document frequency."""
        values, counts = [], []
        for payload in table.column("payload").to_pylist():
            packed, flags, more = X.split_parts(payload, 3)
            values.append(X.unpack(packed))
            n = np.ones(len(values[-1]), np.int64)
            n[X._flags(flags, len(n))] = np.frombuffer(more, "<i4")
            counts.append(n)
        _, group = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(group, weights=np.concatenate(counts))
        kinds = (np.floor(np.log2(total)) + 1).astype(np.uint8)[group]
        ends = np.cumsum([len(v) for v in values])
        out = [kinds[e - len(v) : e].tobytes() for v, e in zip(values, ends, strict=True)]
        return X.binary_table(["chunk", "bucket", "payload"], table.column("chunk").to_pylist(), [table.column("bucket")[0].as_py()] * len(out), out)

    names = ["doc_id", "n", "single", "set_id", "text_key", "live"]

    def describe(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = X.sorted_docs(table) if table.num_rows else (pa.array([], table.column("doc_id").type), pa.array([], pa.string()))
        grams, first = shingle_sets(texts, width)
        found = X.HashSet(grams, layout)
        kinds = np.ones(len(found.distinct), np.uint8)
        for b, payload in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True):
            kinds[found.cuts[b] : found.cuts[b + 1]] = np.frombuffer(payload, np.uint8)
        kinds = kinds[found.inverse] if len(grams) else kinds
        size = np.diff(first)
        single = K.segment_sum(kinds == 1, first)
        may = (size > 0) & (100 * (size - single) >= percent * size)
        set_ids, text_keys, live, seen = [None] * len(size), [None] * len(size), [None] * len(size), set()
        data, at = K.string_parts(texts)
        for d in np.flatnonzero(may):
            text_keys[d] = hashlib.sha256(data[at[d] : at[d + 1]]).hexdigest()[:TEXT_KEY]
            mine, k = grams[first[d] : first[d + 1]], kinds[first[d] : first[d + 1]]
            set_ids[d] = hashlib.sha256(mine.tobytes()).hexdigest()[:32]
            if set_ids[d] not in seen:
                seen.add(set_ids[d])
                mine, k = mine[k > 1], k[k > 1]
                live[d] = mine[np.lexsort((mine, k))].tobytes()
        return pa.table([ids, pa.array(size), pa.array(single), pa.array(set_ids, pa.string()), pa.array(text_keys, pa.string()), pa.array(live, pa.binary())], names=names)

    replies = rows.groupBy("chunk").applyInArrow(send, X.SETS).groupBy("bucket").applyInArrow(classes, X.REPLIES)
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(describe, f"doc_id {kind}, n long, single long, set_id string, text_key string, live binary")


def prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, single, hash of the prefix, the prefix shingles in order, and a bitmap of the shared shingles.

    Each shingle turns over one bit, so two bitmaps differ in no more bits than the sets differ in shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, names, bitmaps = [], [], []
            for n, single, live in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                part = live[: 8 * max(0, prefix_size(n, percent) - single)]
                tokens.append(np.frombuffer(part, "<i8"))
                names.append(hashlib.sha256(part).hexdigest()[:32])
                places = (np.frombuffer(live, "<u8") % np.uint64(BITS)).astype(np.int64)
                bitmaps.append(np.packbits(np.bincount(places, minlength=BITS) % 2 == 1).view("<i8"))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(names), pa.array(tokens, pa.list_(pa.int64())), pa.array(bitmaps, pa.list_(pa.int64()))], ["node", "n", "single", "prefix", "tokens", "bits"])

    return sets.select("node", "n", "single", "live").mapInArrow(run, "node long, n long, single long, prefix string, tokens array<long>, bits array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs x, y of nodes whose sets are similar enough."""
    small = sets.select("node", "n", "live")
    left = pairs.join(small.toDF("x", "nx", "lx"), "x").join(small.toDF("y", "ny", "ly"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for nx, ny, lx, ly in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                both = len(np.intersect1d(np.frombuffer(lx, "<u8"), np.frombuffer(ly, "<u8"), assume_unique=True))
                keep.append(100 * both >= percent * (nx + ny - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return left.select("x", "y", "nx", "ny", "lx", "ly").mapInArrow(run, "x long, y long")


def _own(name: str) -> Column:
    """The column as a key of its own: an aggregate gets an exchange of its own before a join, so that Spark can split the other side's frequent keys."""
    return F.concat(F.col(name), F.lit("")).alias(name)


def _size_fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def links(sets: DataFrame, percent: int) -> DataFrame:
    """Links x, y that connect all sets that are connected by pairs similar enough."""
    rows = checkpointed(prefix_rows(sets, percent))
    # Groups of equal prefix and size, and the hub of each prefix shingle and size class.
    groups = rows.groupBy("prefix", "n").agg(F.min(F.struct("single", "node"))["node"].alias("head"), F.min("single").alias("single"), F.first("tokens").alias("tokens"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) / 2)
    tokens = groups.select("head", "single", band.alias("band"), F.explode("tokens").alias("token"))
    hubs = tokens.groupBy("token", "band").agg(F.min(F.struct("single", "head"))["head"].alias("hub"), F.count("*").alias("many")).where("many > 1").drop("many")
    votes = tokens.join(hubs, ["token", "band"]).where("head != hub").groupBy("head", "hub").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("head").agg(F.max(F.struct("votes", "hub"))["hub"].alias("y")).select(F.col("head").alias("x"), "y")
    members = rows.join(groups.select(_own("prefix"), "n", "head"), ["prefix", "n"]).where("node != head").select(F.col("node").alias("x"), F.col("head").alias("y"))
    first = checkpointed(verified(chosen.unionAll(members).distinct(), sets, percent))
    tied = components(first.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # Pairs of groups from different components.  A shingle's rows in its main component need not meet each other.
    placed = rows.join(tied.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = checkpointed(placed.groupBy("prefix", "n", "component").agg(F.min("node").alias("head"), F.min("single").alias("least"), F.first("tokens").alias("tokens"), F.when(F.min("bits") == F.max("bits"), F.min("bits")).alias("bits")))
    each = grouped.select("head", "n", "component", F.col("least").alias("single"), "bits", F.posexplode("tokens").alias("at", "token"))
    sizes = each.groupBy("token", "component").agg(F.count("*").alias("many"))
    main = sizes.groupBy("token").agg(F.max(F.struct("many", "component"))["component"].alias("main"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    shared = each.join(main, "token")
    off = shared.where("component != main").select("token", *(F.col(c).alias(f"{c}_x") for c in ("head", "n", "component", "single", "at", "bits")))
    every = shared.select("token", "main", *(F.col(c).alias(f"{c}_y") for c in ("head", "n", "component", "single", "at", "bits")))
    c = F.col
    most = F.least(c("n_x") - c("single_x") - c("at_x"), c("n_y") - c("single_y") - c("at_y"))  # if this is their first common shingle
    apart = (c("component_x") != c("component_y")) & ((c("component_y") == c("main")) | (c("head_x") < c("head_y")))
    near = _size_fits(c("n_x"), c("n_y"), percent) & (100 * most >= percent * (c("n_x") + c("n_y") - most))
    # A group's members may have several bitmaps; then it has none and this filter lets it pass.
    turned = F.aggregate(F.zip_with("bits_x", "bits_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, k: total + k)
    whole = c("n_x") + c("n_y")
    same = (whole - c("single_x") - c("single_y") - F.coalesce(turned, F.lit(0))) / 2  # at most
    pairs = off.join(every, "token").where(apart & near & (100 * same >= percent * (whole - same))).select("head_x", "head_y").distinct()
    who = placed.join(grouped.select(_own("prefix"), "n", "component", "head"), ["prefix", "n", "component"]).select("head", "node")
    wide = pairs.join(who.toDF("head_x", "x"), "head_x").join(who.toDF("head_y", "y"), "head_y").select("x", "y")
    return first.unionAll(verified(wide, sets, percent))


def tied_sets(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links a-b of the distinct sets of described rows, set_id and node of each set)."""
    grouped = rows.groupBy("set_id").agg(F.first("n").alias("n"), F.first("single").alias("single"), F.first("live", ignorenulls=True).alias("live"))
    sets = checkpointed(grouped.withColumn("node", F.monotonically_increasing_id()))
    edges = checkpointed(links(sets, percent))
    return edges.select(F.col("x").alias("a"), F.col("y").alias("b")), sets.select("set_id", "node")


def linked_documents(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids, sizes of shingle sets, and the smallest id that each row reaches by links."""
    rows = checkpointed(described(docs, width, percent, id_col, text_col))
    linkable = F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()
    some = rows.where(linkable)
    edges, sets = tied_sets(some, percent)
    # the sets of an id with several texts are one vertex
    owned = some.groupBy("doc_id").agg(F.min("set_id").alias("one"), F.max("set_id").alias("other")).where("one != other").select("doc_id")
    shared = some.join(owned, "doc_id", "left_semi").select("doc_id", "set_id").distinct().join(sets, "set_id")
    shared = shared.join(shared.groupBy("doc_id").agg(F.min("node").alias("least")), "doc_id").select(F.col("node").alias("a"), F.col("least").alias("b"))
    tied = components(edges.unionAll(shared))
    placed = sets.join(tied.withColumnRenamed("id", "node"), "node", "left").select("set_id", F.coalesce("component", "node").alias("tie"))
    named = some.select("doc_id", "n", "set_id").join(placed, "set_id")
    least = named.groupBy("tie").agg(F.min("doc_id").cast("long").alias("component"))
    out = named.join(least.select(F.col("tie").bitwiseXOR(F.lit(0)).alias("tie"), "component"), "tie").select("doc_id", "n", "component")
    out = out.unionAll(rows.where(~linkable).select("doc_id", "n", F.col("doc_id").cast("long").alias("component")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which one of each component is left."""
    rows = checkpointed(described(docs, width, percent, id_col, text_col)).where(F.col("set_id").isNotNull())
    edges, sets = tied_sets(rows, percent)
    tied = components(edges)
    placed = sets.join(tied.withColumnRenamed("id", "node"), "node", "left").select("set_id", F.coalesce("component", "node").alias("tie"))
    named = rows.select("doc_id", "text_key", "set_id").join(placed, "set_id").groupBy("tie", "doc_id", "text_key").agg(F.count("*").alias("many"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    named = checkpointed(named.withColumn("rank", rank))
    first = named.groupBy("tie").agg(F.min("rank").alias("first"))
    judged = named.join(first.select(F.col("tie").bitwiseXOR(F.lit(0)).alias("tie"), "first"), "tie")
    # what goes: rows after the first of their component, and the first as well where it is repeated, to be put back once
    gone = judged.where((F.col("rank") != F.col("first")) | (F.col("many") > 1)).select("doc_id", "text_key")
    again = judged.where((F.col("rank") == F.col("first")) & (F.col("many") > 1)).select("doc_id", "text_key")
    # the row is carried as one value, so that no name of its columns can clash
    key = F.left(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), F.lit(TEXT_KEY))
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"), key.alias("row_key"))
    met = lambda keys: F.col("row_id").eqNullSafe(keys["doc_id"]) & (F.col("row_key") == keys["text_key"])
    kept = packed.join(gone, met(gone), "left_anti").select("row")
    if again.isEmpty():  # saves dealing out the rows a second time
        return kept.select("row.*")
    back = packed.join(again, met(again), "left_semi").groupBy("row_id", "row_key").agg(F.first("row").alias("row")).select("row")
    return kept.unionAll(back).select("row.*")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
