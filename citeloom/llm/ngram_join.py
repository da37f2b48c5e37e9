"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are word shingles. Documents with equal rows are one
class first. A pair of classes can only reach the similarity if, in one order of all shingles, the first
n - ceil(s n) + 1 shingles of both have one in common; the order takes rare shingles first, so that classes
of their own drop out and shared passages bring few classes together. What is left falls into candidate
groups, whose blocks of rows are multiplied with each other if their sizes allow a link: overlap counts
accumulate shingle by shingle, and pairs below the bound that follows from the two sizes are discarded. A block pair reports a spanning
forest of its links and the number of links of each class, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hold, id_and_text, materialize, pieces, raw_bytes
from .components import components
from .shingles import shingle_set

#: Share of the hash space whose shingles are counted, as a bound of the 64-bit hash.
COUNTED = int(0.3 * 2**64)
#: Classes from which a counted shingle goes to the end of the order.
COMMON = 64
#: Hashes that a map task gathers before it hands them on, and those that a counting task gets.
GATHER, COUNT_TASK = 1 << 20, 1 << 21
#: Rows of a block; groups with fewer rows share a task, as many as make up a block. Blocks are numbered band by band.
BLOCK, BLOCKS = 1000, 1 << 32
#: Columns with more rows than this are multiplied as dense blocks of so many columns, the others pair by pair.
DENSE_FROM, DENSE_COLUMNS = 24, 2048


def need(n, percent: int):
    """The least number of shingles that a set of n shares with one that is similar enough."""
    return (n * percent + 99) // 100


def _signature(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("shingles")
        for batch in pieces(batches):
            sets = [shingle_set(t, width) for t in raw_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(np.searchsorted(s, np.uint64(COUNTED))) for s in sets], pa.int64()), pa.array([_signature(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "tie", "n", "low", "sig"],
            )

    return run


def _counted_postings(width: int, parts: int):
    """(part, hashes, counts, signatures): blocks of counted shingles, class after class, with each class's number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("shingles")
        sets, sigs, held, done = [], [], 0, set()

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
            part = (hashes % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for p in range(parts):
                mine = order[cuts[p] : cuts[p + 1]]
                if len(mine):
                    owners, counts = np.unique(owner[mine], return_counts=True)
                    for col, x in zip(rows, (p, hashes[mine].tobytes(), counts.astype(np.uint32).tobytes(), b"".join(sigs[o] for o in owners)), strict=True):
                        col.append(x)
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["part", "hashes", "counts", "sigs"])

        for batch in pieces(batches):
            for text in raw_bytes(batch.column(0)):
                s = shingle_set(text, width)
                if len(s) and (sig := _signature(s)) not in done:
                    done.add(sig)
                    low = s[: np.searchsorted(s, np.uint64(COUNTED))]
                    if len(low):
                        sets.append(low)
                        sigs.append(sig)
                        held += len(low)
                if held >= GATHER:
                    yield flush()
                    sets, sigs, held = [], [], 0
        if held:
            yield flush()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one part: (sig, hash, df) of the shingles that two classes or more have."""
    hold("shingles")
    sigs = np.frombuffer(b"".join(table["sigs"].to_pylist()), "<u8").reshape(-1, 2)
    owner = np.repeat(np.arange(len(sigs), dtype=np.int32), np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32))
    hashes = np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)
    by_sig = np.lexsort((sigs[:, 1], sigs[:, 0]))
    ordered = sigs[by_sig]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)])
    number = np.empty(len(sigs), np.int32)
    number[by_sig] = np.cumsum(new) - 1
    names = ordered[new]
    cls = number[owner]
    order = np.lexsort((cls, hashes))
    h, c = hashes[order], cls[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    h, c = h[keep], c[keep]
    runs = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    df = np.repeat(np.diff(runs), np.diff(runs))
    many = df > 1
    n = int(many.sum())
    found = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(names[c[many]]))])
    return pa.table({"sig": found, "hash": h[many].view(np.int64), "df": df[many].astype(np.int32)})


def _order(width: int, percent: int):
    """Survivors' whole sets and the part of their prefix that other classes may share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, prefixes = [], []
            texts = raw_bytes(batch.column("text"))
            for text, hashes, dfs in zip(texts, batch.column("hashes").to_pylist(), batch.column("dfs").to_pylist(), strict=True):
                s = shingle_set(text, width)
                low = int(np.searchsorted(s, np.uint64(COUNTED)))
                h, df = np.array(hashes, np.int64).view(np.uint64), np.array(dfs, np.int64)
                left = len(s) - need(len(s), percent) + 1 - (low - len(h))  # the shingles that no other class has come first
                rare = np.lexsort((h, df))
                few, common = rare[df[rare] <= COMMON], rare[df[rare] > COMMON]
                prefixes.append(np.concatenate([h[few], s[low:], h[common]])[: max(0, left)].view(np.int64).tolist())
                sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("n"), batch.column("docs"), pa.array(sets, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["sig", "n", "docs", "members", "prefix"])

    return run


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """The product of the rows' incidence matrix with its transpose (without the diagonal's own counts for unshared columns)."""
    m = len(rows)
    owner = np.repeat(np.arange(m), [len(r) for r in rows])
    columns = np.concatenate(rows)
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], columns[1:] != columns[:-1], [True]]))
    starts, df = cuts[:-1], np.diff(cuts)
    out = np.zeros(m * m, np.float32)
    one = np.float32(1)
    for d in range(2, DENSE_FROM + 1):
        at = starts[df == d]
        i, j = np.triu_indices(d, 1)
        for k in range(0, len(at), max(1, 500_000 // len(i))):
            own = owner[at[k : k + max(1, 500_000 // len(i)), None] + np.arange(d)]
            np.add.at(out, (own[:, i] * m + own[:, j]).ravel(), one)
    out = out.reshape(m, m)
    out += out.T
    at = np.flatnonzero(df > DENSE_FROM)
    for k in range(0, len(at), DENSE_COLUMNS):
        part = at[k : k + DENSE_COLUMNS]
        x = np.zeros((m, len(part)), np.float32)
        for col, a in enumerate(part):
            x[owner[starts[a] : starts[a] + df[a]], col] = 1
        out += x @ x.T
    return out


def linked(rows: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs reach the similarity; those whose sizes alone forbid it are out whatever the product says."""
    n = np.array([len(r) for r in rows], np.float64)
    product = overlaps(rows)
    links = np.empty(product.shape, bool)
    for k in range(0, len(rows), 256):  # a few rows at a time, to keep double precision's copies small
        o, own = product[k : k + 256].astype(np.float64), n[k : k + 256, None]
        links[k : k + 256] = (100 * o >= percent * (own + n - o)) & (100 * np.minimum(own, n) >= percent * np.maximum(own, n))
    np.fill_diagonal(links, False)
    return links


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(row, root) of a spanning forest: every row that some link reaches from a root."""
    out, seen = [], np.zeros(len(links), bool)
    for root in range(len(links)):
        if seen[root] or not links[root].any():
            continue
        seen[root], front = True, [root]
        while front:
            reached = np.flatnonzero(links[front].any(0) & ~seen)
            seen[reached] = True
            out += [(int(r), root) for r in reached]
            front = reached.tolist()
    return out


def _multiply(percent: int):
    def run(table: pa.Table) -> pa.Table:
        hold("shingles")
        place = table.select(["grp", "bi", "bj"]).to_pylist()
        members, sig = table["members"].to_pylist(), table["sig"].to_pylist()
        docs, block = table["docs"].to_numpy().astype(np.float64), table["block"].to_numpy()
        groups: dict[tuple, list[int]] = {}
        for i, x in enumerate(place):
            groups.setdefault((x["grp"], x["bi"], x["bj"]), []).append(i)
        out: tuple[list, list, list] = ([], [], [])
        for (_, bi, bj), at in groups.items():
            links = linked([np.frombuffer(members[i], np.uint64) for i in at], percent)
            if bi != bj:  # pairs within a block are another task's
                links &= block[at][:, None] != block[at][None, :]
            roots = dict(_forest(links))
            weight = np.concatenate([links[k : k + 256] @ docs[at] for k in range(0, len(links), 256)])
            for i in np.flatnonzero(links.any(1)).tolist():
                for col, x in zip(out, (sig[at[i]], sig[at[roots.get(i, i)]], int(weight[i])), strict=True):
                    col.append(x)
        return pa.table({"sig": pa.array(out[0], pa.binary()), "root": pa.array(out[1], pa.binary()), "links": pa.array(out[2], pa.int64())})

    return run


def _groups(survivors: DataFrame) -> DataFrame:
    """sig, grp: classes that chains of shared prefix shingles bring together; classes that share none are left out."""
    postings = survivors.select("sig", F.explode("prefix").alias("hash"))
    heads = postings.groupBy("hash").agg(F.min("sig").alias("head"), F.count("*").alias("c")).where("c > 1").select(F.col("hash").alias("own"), "head")
    star = postings.withColumn("k", F.xxhash64("hash")).join(heads.withColumn("k2", F.xxhash64("own")), (F.col("k") == F.col("k2")) & (F.col("hash") == F.col("own")))
    return components(star, "sig", "head").select(F.col("node").alias("sig"), F.col("root").alias("grp"))


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, tie (hash of the text), n_shingles, component_id, n_links.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the
    least doc_id that links reach, n_links the number of other rows linked. No bucket, group or number of
    partners is capped. Null and empty texts have no shingles, link with nothing and are their own component.
    A null id is no id: a component's id is the least that isn't null. Repeated rows link with each other."""
    rows = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    members = materialize(rows.mapInArrow(_members(width), "doc_id long, tie long, n long, low long, sig binary"), "members")
    total = members.where("sig is not null").groupBy("sig").agg(F.first("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, int(total * 0.3) // COUNT_TASK + 1)
    counted = rows.select("text").mapInArrow(_counted_postings(width, parts), "part int, hashes binary, counts binary, sigs binary")
    shared = counted.groupBy("part").applyInArrow(_shared, "sig binary, hash long, df int")
    # A class stays while the shingles that it alone has don't fill its prefix.
    by_class = shared.groupBy("sig").agg(F.collect_list("hash").alias("hashes"), F.collect_list("df").alias("dfs"))
    classes = members.where("sig is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.first("n").alias("n"), F.first("low").alias("low"), F.count("*").alias("docs"))
    kept = classes.join(by_class, "sig", "left").select("sig", "n", "low", "docs", F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"), F.coalesce("hashes", F.array().cast("array<long>")).alias("hashes"), F.coalesce("dfs", F.array().cast("array<int>")).alias("dfs"))
    kept = kept.where(F.col("low") - F.size("hashes") < F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1)
    texts = rows.join(kept, rows["doc_id"].eqNullSafe(kept["first_id"]) & (rows["tie"] == kept["first_tie"])).dropDuplicates(["sig"]).select("text", "sig", "n", "docs", "hashes", "dfs")
    survivors = materialize(texts.mapInArrow(_order(width, percent), "sig binary, n long, docs long, members binary, prefix array<long>").where("size(prefix) > 0"), "survivors")
    groups = materialize(_groups(survivors), "groups")
    edges = materialize(_products(survivors, groups, percent), "links")
    roots = components(edges, "sig", "root")
    links = edges.groupBy("sig").agg(F.sum("links").alias("links"))
    named = classes.select("sig", F.col("first.doc_id").alias("id"), "docs").join(roots.withColumnRenamed("node", "sig"), "sig", "left").join(links, "sig", "left")
    named = materialize(named.select("sig", "id", "docs", F.coalesce("root", "sig").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = materialize(named.join(least, "root").select(F.col("sig").alias("own"), "component_id", (F.col("docs") - 1 + F.col("links")).alias("n_links")), "labels")
    full = members.where("sig is not null").join(labels, F.col("sig") == F.col("own"))
    empty = members.where("sig is null").select("doc_id", "tie", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = full.select("doc_id", "tie", F.col("n").alias("n_shingles"), "component_id", F.col("n_links").cast("long").alias("n_links")).unionByName(empty)
    for table in (survivors, groups, edges, named):
        discard(table)
    return out


def _products(survivors: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """sig, root, links: per block pair, each linked class, a class that leads its tree, and the documents that it links with.

    A group of more classes than a block is cut by size into bands, each as wide as the similarity lets two linked sets
    differ, and bands into blocks. A block meets the blocks of its own band and of the next ones: no others can hold a link."""
    rows = survivors.select("sig", "n", "docs", "members")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m")).withColumnRenamed("grp", "whole")
    placed = groups.withColumn("k", F.xxhash64("grp")).join(sizes.withColumn("k2", F.xxhash64("whole")), (F.col("k") == F.col("k2")) & (F.col("grp") == F.col("whole"))).select("sig", "grp", "m")
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    band = F.when(F.col("m") <= BLOCK, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / width)).cast("long")
    placed = materialize(placed.join(rows.select("sig", "n"), "sig").select("sig", "grp", "m", band.alias("band")), "bands")
    bands = placed.groupBy("grp", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # A group has as many bands as its sizes span, some dozens at most.
    bands = bands.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("blocks")).withColumnRenamed("grp", "whole")
    placed = placed.withColumn("k", F.xxhash64("grp")).join(bands.withColumn("k2", F.xxhash64("whole")), (F.col("k") == F.col("k2")) & (F.col("grp") == F.col("whole"))).select("sig", "grp", "m", "band", "blocks")
    number = lambda b, i: b * BLOCKS + i
    blocks_of = lambda b: F.coalesce(F.try_element_at("blocks", b), F.lit(0))
    own = number(F.col("band"), F.pmod(F.xxhash64("sig", F.lit(1)), blocks_of(F.col("band"))))
    every = lambda b: F.when(blocks_of(b) > 0, F.sequence(number(b, F.lit(0)), number(b, blocks_of(b) - 1))).otherwise(F.array().cast("array<long>"))
    near = F.flatten(F.array(every(F.col("band") - 1), every(F.col("band")), every(F.col("band") + 1)))
    placed = placed.withColumn("block", own).withColumn("other", F.explode(near))
    placed = placed.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    bins = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups.count() // BLOCK + 1)
    task = F.when(F.col("m") <= BLOCK, F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.xxhash64("grp", "bi", "bj"))
    ready = placed.withColumn("task", task).select("task", "sig", "grp", "block", "bi", "bj").join(rows.drop("n"), "sig")
    return ready.select("task", "sig", "grp", "docs", "members", "block", "bi", "bj").groupBy("task").applyInArrow(_multiply(percent), "sig binary, root binary, links long")


def digest(docs: DataFrame) -> DataFrame:
    return ngram_join(docs, 4, 85).select("doc_id", "n_shingles", "component_id", "n_links")


def representatives(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the least (id, hash of the text); rows without a shingle all stay."""
    found = materialize(ngram_join(docs, width, percent, id_col, text_col), "joined")
    first = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "tie")).alias("f")).select("f.doc_id", "f.tie")
    stay = first.unionByName(found.where("n_shingles = 0").select("doc_id", "tie").distinct()).select(F.col("doc_id").alias("_cl_id"), F.col("tie").alias("_cl_tie"))
    base = docs.withColumn("_cl_key", F.col(f"`{id_col}`").cast("long")).withColumn("_cl_own", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    both = base.join(stay, base["_cl_key"].eqNullSafe(stay["_cl_id"]) & (base["_cl_own"] == stay["_cl_tie"]), "left_semi")
    return both.dropDuplicates(["_cl_key", "_cl_own"]).drop("_cl_key", "_cl_own")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + least(4, len(words)) - 1], ' ') AS sh
      FROM (SELECT *, unnest(generate_series(1, greatest(1, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(k.n_links, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x) k USING (doc_id)
"""
