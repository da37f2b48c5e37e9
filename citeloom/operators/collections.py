"""Paper collections: filters by entity, cluster and list, merges, joins of attributes, samples, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import EXTRACTION_FIELDS
from citeloom.operators.scratch import written


def having_all(papers: DataFrame, doc_entity: DataFrame, names: list[str]) -> DataFrame:
    """Papers with every one of the entities."""
    wanted = sorted({n.lower() for n in names})
    hits = doc_entity.where(F.col("entity").isin(wanted)).groupBy("doc_id").agg(F.countDistinct("entity").alias("n")).where(F.col("n") == len(wanted))
    return papers.join(hits, "doc_id", "left_semi")


def having_any(papers: DataFrame, doc_entity: DataFrame, names: list[str]) -> DataFrame:
    return papers.join(doc_entity.where(F.col("entity").isin([n.lower() for n in names])), "doc_id", "left_semi")


def in_clusters(papers: DataFrame, membership: DataFrame, ids: list) -> DataFrame:
    return papers.join(membership.where(F.col("cluster_id").cast("string").isin([str(i) for i in ids])), "doc_id", "left_semi")


def in_list(papers: DataFrame, listed: DataFrame) -> DataFrame:
    return papers.join(listed, "doc_id", "left_semi")


def excluding(papers: DataFrame, kept: DataFrame) -> DataFrame:
    """The papers that all filters together don't keep."""
    return papers.join(kept, "doc_id", "left_anti")


def find_entity(doc_entity: DataFrame, name: str) -> DataFrame:
    return doc_entity.where(F.col("entity") == name.lower()).select("doc_id")


def merge_first(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """The parts one after the other; of rows with one key the first stays."""
    tagged = [p.withColumn("part_no", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = Window.partitionBy(key).orderBy("part_no", order)
    return rows.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def append_new(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """base and the rows of more whose key, whatever its case, base hasn't."""
    fresh = more.withColumn("low", F.lower(key)).join(base.select(F.lower(key).alias("low")).distinct(), "low", "left_anti").drop("low")
    return base.unionByName(fresh, allowMissingColumns=True)


def attach(papers: DataFrame, found: DataFrame, key: str, fields: list[str], newest: str, empty: str = "") -> DataFrame:
    """papers with fields of the last row found for their key, whatever its case; missing ones get `empty`."""
    last = Window.partitionBy("low").orderBy(F.desc(newest))
    one = found.withColumn("low", F.lower(key)).withColumn("rn", F.row_number().over(last)).where("rn = 1").select("low", *[F.col(f).alias(f"new_{f}") for f in fields])
    both = papers.withColumn("low", F.lower(key)).join(one, "low", "left").drop("low", *fields)
    return both.select("*", *[F.coalesce(f"new_{f}", F.lit(empty)).alias(f) for f in fields]).drop(*[f"new_{f}" for f in fields])


def fill_in_turn(base: DataFrame, sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """The first source's value that isn't null, and its number; a source is asked for what those before it lack."""
    out = base
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"v{i}")), key, "left")
    names = [F.col(f"v{i}") for i in range(len(sources))]
    source = F.coalesce(*[F.when(c.isNotNull(), i) for i, c in enumerate(names)])
    return out.select(*base.columns, F.coalesce(*names).alias(value), source.alias("source_no"))


def titles_or_keys(keys: DataFrame, papers: DataFrame) -> DataFrame:
    return keys.join(papers.select("doc_id", "title"), "doc_id", "left").select("doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"))


def with_cluster(papers: DataFrame, membership: DataFrame) -> DataFrame:
    return papers.join(membership, "doc_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit("-1")))


def browse(membership: DataFrame, samples: int = 3) -> DataFrame:
    """Clusters with their size and their first members."""
    rank = Window.partitionBy("cluster_id").orderBy("doc_id")
    sized = membership.groupBy("cluster_id").agg(F.count("*").alias("size"))
    first = membership.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= samples)
    lists = first.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("samples"))
    return sized.join(lists, "cluster_id")


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int = 1) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= k)


def _drawn(key: str, seed: int) -> Column:
    """A hash of key and seed, which orders rows by chance, but the same each time."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def neighbours_by_chance(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """a, b: each row's key and the next one's in an order by chance; a pair a row but the last."""
    order = numbered(rows.select(F.col(key).alias("a"), _drawn(key, seed).alias("h")), [F.col("h"), F.col("a")], "i").select("a", "i")
    return order.join(order.select(F.col("a").alias("b"), (F.col("i") - 1).alias("i")), "i").select("a", "b")


def random_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a hash of key and seed: the same rows each time, whatever the partitions."""
    return rows.withColumn("h", _drawn(key, seed)).orderBy("h", key).limit(n).drop("h")


def stratified_sample(papers: DataFrame, membership: DataFrame, seed: int, target: int = 50, major: tuple[int, int] = (5, 6), minor: tuple[int, int] = (2, 2), singletons: int = 3, bare: int = 5) -> DataFrame:
    """Some papers of each large cluster and each small one, a few of clusters of one, then papers without an abstract and others up to the target.

    The choice within a stratum is by a hash of key and seed. Columns: doc_id, stratum (0 major, 1 minor, 2 single, 3 no abstract, 4 fill)."""
    h = _drawn("doc_id", seed)
    sizes = membership.groupBy("cluster_id").agg(F.count("*").alias("size"))
    rows = papers.join(membership, "doc_id").join(sizes, "cluster_id").withColumn("h", h)
    rows = rows.withColumn("stratum", F.when(F.col("size") >= major[0], 0).when(F.col("size") >= minor[0], 1).otherwise(2))
    group = F.when(F.col("stratum") < 2, F.col("cluster_id")).otherwise(F.lit("single"))
    quota = F.when(F.col("stratum") == 0, major[1]).when(F.col("stratum") == 1, minor[1]).otherwise(singletons)
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("stratum", group).orderBy("h", "doc_id"))).where(F.col("rn") <= quota).select("doc_id", "stratum", "has_abstract")
    lacking = first.agg(F.greatest(F.lit(0), F.lit(bare) - F.count_if(~F.col("has_abstract"))).alias("lacking"))
    rest = rows.join(first, "doc_id", "left_anti")
    none = rest.where(~F.col("has_abstract")).orderBy("h", "doc_id").limit(bare).withColumn("rn", F.row_number().over(Window.orderBy("h", "doc_id"))).join(F.broadcast(lacking)).where(F.col("rn") <= F.col("lacking"))
    second = first.select("doc_id", "stratum").unionByName(none.select("doc_id", F.lit(3).alias("stratum")))
    missing = second.agg(F.greatest(F.lit(0), F.lit(target) - F.count("*")).alias("missing"))
    fill = rest.join(none, "doc_id", "left_anti").orderBy("h", "doc_id").limit(target).withColumn("rn", F.row_number().over(Window.orderBy("h", "doc_id"))).join(F.broadcast(missing)).where(F.col("rn") <= F.col("missing"))
    return second.unionByName(fill.select("doc_id", F.lit(4).alias("stratum")))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in the order, from 0. Places come from sorted ranges and the ranges' counts, so no task holds all rows.

    The ranges are written once: rows and counts must be of one and the same division, and planning it twice would draw
    its borders twice."""
    ranged = written(rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("range_no").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).select("range_no", "before")
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(*order)) - 1
    return ranged.withColumn("place", place).join(F.broadcast(before), "range_no").withColumn(name, F.col("place") + F.col("before")).drop("range_no", "place", "before")


def batches(rows: DataFrame, order: str, size: int, part: str | None = None) -> DataFrame:
    """rows with batch_id, the row's place in the order divided by size; counted within each value of `part` if given."""
    if part:
        return rows.withColumn("batch_id", F.floor((F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1) / size))
    return numbered(rows, [F.col(order)], "batch_id").withColumn("batch_id", F.floor(F.col("batch_id") / size))


#: What a prompt says before its papers: what to read, and the form of the answer.
HEADER = (
    "Read the papers below. For each, state in at most a sentence: "
    + ", ".join(EXTRACTION_FIELDS)
    + ". Leave a field empty where a paper says nothing of it. Answer with one JSON array; each element is an object with the paper's doi and these fields.\n\n"
)
FULL_HEADER = HEADER.replace("Read the papers below.", "Read the papers below; where methods, results or discussion are given, prefer them to the abstract.")
#: Characters of each section that a prompt takes.
SECTIONS = {"Methods": ("methods_text", 3000), "Results": ("results_text", 3000), "Discussion": ("discussion_text", 2000)}


def _entry(*more: Column) -> Column:
    """A paper's lines in a prompt; null lines are left out."""
    abstract = F.when(F.trim(F.coalesce("abstract", F.lit(""))) == "", "(no abstract available)").otherwise(F.trim("abstract"))
    lines = [
        F.lit("---"), F.concat(F.lit("DOI: "), F.col("doc_id").cast("string")), F.concat(F.lit("Title: "), F.coalesce("title", F.lit("(no title)"))),
        F.concat(F.lit("Year: "), F.coalesce(F.col("year").cast("string"), F.lit("unknown"))), F.concat(F.lit("Abstract: "), abstract), *more, F.lit("---"),
    ]
    return F.concat_ws("\n", *lines)


def _batched(rows: DataFrame, size: int) -> DataFrame:
    """batch_id, n_papers, full, block of rows(doc_id, full, block): the papers' entries, in order, parted by blank lines."""
    grouped = batches(rows, "doc_id", size).groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "block"))).alias("b"), F.count("*").alias("n_papers"), F.max("full").alias("full"))
    return grouped.select("batch_id", "n_papers", "full", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("block"))


def prompts(rows: DataFrame, size: int, header: str = HEADER) -> DataFrame:
    """One prompt text for each batch of papers (doc_id, title, year, abstract), and its number of papers."""
    found = _batched(rows.where(F.col("doc_id").isNotNull()).select("doc_id", F.lit(False).alias("full"), _entry().alias("block")), size)
    return found.select("batch_id", "n_papers", F.concat(F.lit(header), "block").alias("prompt"))


def fulltext_prompts(rows: DataFrame, size: int = 5, header: str = HEADER, full_header: str = FULL_HEADER) -> DataFrame:
    """Prompts of papers with methods_text, results_text and discussion_text: batches in which some paper has one take the header for full texts."""
    given = {label: F.substring(F.when(F.col(c) != "", F.col(c)), 1, n) for label, (c, n) in SECTIONS.items()}
    lines = [F.concat(F.lit(f"{label}: "), c) for label, c in given.items()]
    full = F.coalesce(*given.values()).isNotNull()
    found = _batched(rows.where(F.col("doc_id").isNotNull()).select("doc_id", full.alias("full"), _entry(*lines).alias("block")), size)
    return found.select("batch_id", "n_papers", F.col("full").alias("has_fulltext"), F.concat(F.when(F.col("full"), full_header).otherwise(header), "block").alias("prompt"))


def answered(prompted: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """batch_id, answer: the caller's model asked with every prompt, a task's prompts one after the other; a failed call answers null.

    Prompts out, answers in: which model answers, and how, is the caller's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str | None:
            try:
                return ask(prompt)
            except Exception:  # whatever a caller's model raises: the batch stays unanswered and can be asked again
                return None

        for frame in frames:
            yield pd.DataFrame({"batch_id": frame["batch_id"], "answer": frame["prompt"].map(one)})

    return prompted.select("batch_id", "prompt").mapInPandas(run, "batch_id long, answer string")


def research_rows(papers: DataFrame, membership: DataFrame, labels: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """Papers with cluster_id and its label, and the extracted fields where there are some: the table that a finished job hands over."""
    rows = papers.join(membership, "doc_id", "left").join(labels, "cluster_id", "left")
    if extractions is not None:
        rows = rows.join(extractions, "doc_id", "left")
    return rows.select("doc_id", *[c for c in papers.columns if c != "doc_id"], "cluster_id", "label", *[c for c in (extractions.columns if extractions is not None else []) if c != "doc_id"])


def extraction_report(papers: DataFrame, extractions: DataFrame, by: str, filled: str) -> DataFrame:
    """Per value of `by`: papers, those with the field filled, and their share to six places."""
    rows = papers.join(extractions, "doc_id", "left").groupBy(by)
    return rows.agg(F.count("*").alias("n_papers"), F.count(filled).alias("n_extracted"), F.round(F.avg(F.col(filled).isNotNull().cast("int")), 6).alias("share"))


def works_of(keys: DataFrame, lookup: DataFrame) -> DataFrame:
    """Keys with their work id and citations (0 where unknown) from a lookup table; every key stays."""
    return keys.join(lookup, "doc_id", "left").withColumn("cites", F.coalesce("cites", F.lit(0)))


def citing_papers(citing: DataFrame, papers: DataFrame, patterns: list[str], year_floor: int) -> DataFrame:
    """low, ref, doc_id: citing papers (doc_id, ref) whose title matches a pattern, from a year on; of one title, whatever its case, the first."""
    rows = citing.join(papers, "doc_id").where((F.col("year") >= year_floor) & F.lower("title").rlike("|".join(patterns))).withColumn("low", F.lower("title"))
    return top_per_group(rows, "low", [F.col("ref"), F.col("doc_id")]).select("low", "ref", "doc_id")


def hypothesis_papers(hypotheses: DataFrame, chosen: list[int]) -> DataFrame:
    """doc_id of the papers that the chosen hypotheses name, distinct."""
    return hypotheses.where(F.col("hyp").isin(chosen)).select(F.explode("docs").alias("doc_id")).distinct()


def fulltext_rate(rows: DataFrame, size: int = 50) -> DataFrame:
    """batch_id, checked, available of rows(doc_id, ok), in batches by id."""
    return batches(rows, "doc_id", size).groupBy("batch_id").agg(F.count("*").alias("checked"), F.count_if("ok").alias("available"))


def export_clusters(papers: DataFrame, membership: DataFrame, ids: list) -> DataFrame:
    """The papers of the chosen clusters, each once, in their own columns; unknown clusters add nothing."""
    return in_clusters(papers, membership, ids)


def reset(papers: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """What a view shows after a reset: all papers again, whatever was kept or excluded before."""
    return papers
