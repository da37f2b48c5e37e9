"""Entities of papers: vocabularies, extraction from titles, abstracts and topics, document frequencies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.collections import numbered

# Words that, capitalised in a title or found in an abstract, name no entity.
STOP_WORDS = [
    "the", "a", "an", "of", "in", "for", "to", "and", "with", "on", "using", "towards", "building", "based", "new", "novel", "large", "comprehensive", "survey", "review",
    "challenges", "future", "applications", "current", "scale", "from", "single", "multi", "via", "through", "across", "beyond", "into", "between", "among", "how",
    "what", "why", "when", "where", "which", "who", "can", "may", "could", "would", "should", "will", "shall", "are", "is", "was", "were", "been", "being", "have", "has",
    "had", "its", "their", "our", "your", "his", "her", "this", "that", "these", "those", "all", "any", "some", "each", "both", "few", "more", "most", "other", "such",
    "only", "just", "also", "very", "quite", "rather", "too", "not", "but", "yet", "however", "although", "though", "while", "model", "models", "modeling", "modelling",
    "analysis", "approach", "method", "methods", "study", "studies", "data", "learning", "cell", "cells", "cellular", "biology", "biological", "protein", "proteins",
    "gene", "genes", "genomic", "molecular", "network", "networks", "system", "systems", "computational", "development", "prediction", "predictions", "predictive",
    "inference", "identification", "detection", "classification", "generation", "synthesis", "integration", "exploration", "understanding", "insights", "perspective",
    "perspectives", "framework", "platform", "pipeline", "tool", "tools", "software", "enables", "enabling", "enabled", "reveals", "revealing", "revealed", "improved",
    "improving", "improvement", "enhanced", "enhancing", "scalable", "efficient", "effective", "robust", "accurate", "high", "low", "deep", "wide", "long", "short",
    "resolution", "level", "levels", "type", "types", "driven", "guided", "informed", "aware", "within", "without",
]
# The vocabulary's methods.
METHODS = [
    "scGPT", "transformer", "transformers", "LSTM", "CNN", "RNN", "GRU", "neural network", "deep learning", "machine learning", "ML", "DL", "AI", "random forest",
    "support vector", "SVM", "clustering", "k-means", "classification", "regression", "ensemble", "boosting", "XGBoost", "reinforcement learning", "RL", "GAN", "VAE",
    "autoencoder", "diffusion model", "attention mechanism", "self-attention", "BERT", "GPT", "LLM", "foundation model", "language model", "embedding",
    "representation learning", "transfer learning", "fine-tuning", "pre-training", "pretraining", "zero-shot", "few-shot", "contrastive learning",
    "graph neural network", "GNN", "graph convolutional", "GCN", "message passing", "node embedding", "simulation", "optimization", "algorithm", "RNA-seq", "scRNA-seq",
    "spatial transcriptomics", "ATAC-seq", "ChIP-seq", "Hi-C", "CITE-seq", "multiome", "mass spectrometry", "proteomics", "metabolomics", "genomics", "CRISPR",
    "gene editing", "perturbation", "screening", "Perturb-seq", "FBA", "flux balance analysis", "constraint-based", "ODE", "differential equation",
    "stochastic simulation", "Monte Carlo", "MCMC", "Bayesian", "variational inference", "dimensionality reduction", "PCA", "UMAP", "t-SNE", "batch correction",
    "data integration", "imputation",
]
# The vocabulary's organisms; the last is matched after all others.
ORGANISMS = [
    "human", "mouse", "yeast", "zebrafish", "fruit fly", "E. coli", "Escherichia coli", "S. cerevisiae", "Saccharomyces cerevisiae", "C. elegans",
    "Caenorhabditis elegans", "Drosophila", "Arabidopsis", "Mycoplasma", "bacteria", "bacterial", "microbial", "microbiome", "mammalian", "vertebrate", "eukaryote",
    "eukaryotic", "prokaryote", "stem cell", "iPSC", "ESC", "T cell", "B cell", "NK cell", "neuron", "neuronal", "immune cell", "macrophage", "dendritic cell",
    "cancer cell", "tumor cell", "epithelial", "endothelial", "cardiomyocyte", "hepatocyte", "fibroblast", "keratinocyte", "organoid", "spheroid", "tissue", "organ",
    "rat",
]
# The vocabulary's concepts.
CONCEPTS = [
    "gene expression", "transcription", "translation", "regulation", "pathway", "signaling", "metabolism", "homeostasis", "metabolic", "differentiation", "development",
    "proliferation", "apoptosis", "cell cycle", "drug discovery", "drug design", "therapeutic", "biomarker", "diagnosis", "prognosis", "precision medicine",
    "personalized medicine", "systems biology", "computational biology", "bioinformatics", "multi-omics", "multiomics", "heterogeneity", "variability", "dynamics",
    "evolution", "adaptation", "response", "perturbation response", "disease", "cancer", "diabetes", "Alzheimer", "COVID", "COVID-19", "virtual cell", "whole-cell",
    "in silico", "digital twin", "cell state", "cell fate", "cell identity", "cell atlas", "gene regulatory network", "GRN", "protein-protein interaction", "PPI",
    "chromatin accessibility", "epigenetics", "epigenome", "methylation",
]
# The vocabulary's data sets.
DATASETS = [
    "UniProt", "PDB", "Protein Data Bank", "GenBank", "RefSeq", "Ensembl", "KEGG", "Reactome", "Gene Ontology", "GO", "TCGA", "GTEx", "UK Biobank", "GnomAD", "ClinVar",
    "Human Cell Atlas", "HCA", "Allen Brain Atlas", "ENCODE", "FANTOM", "CellxGene", "CELLxGENE", "Single Cell Portal", "GEO", "ArrayExpress", "Tabula Muris",
    "Tabula Sapiens", "HuBMAP", "BioGRID", "STRING", "DrugBank", "ChEMBL", "PubChem", "scRNA-seq atlas", "cell atlas", "expression atlas",
]
KINDS = ["METHOD", "ORGANISM", "CONCEPT", "DATASET"]
# Parts of a capitalised word that make it a data set.
DATASET_PARTS = "seq|omics|data|atlas|bank"
CAPITALISED = r"(?U)\b[A-Z][A-Za-z0-9-]*\b"


def default_vocabulary() -> dict[str, list[str]]:
    return {"METHOD": METHODS, "ORGANISM": ORGANISMS, "CONCEPT": CONCEPTS, "DATASET": DATASETS}


def merged_vocabulary(extra: dict[str, list[str]] | None = None, base: dict[str, list[str]] | None = None) -> list[tuple[int, str, str]]:
    """(rank, kind, term): base and extra terms by kind, without a term that the kind has in another case."""
    base, out = default_vocabulary() if base is None else base, []
    for kind in KINDS:
        seen: set[str] = set()
        for term in [*base.get(kind, []), *(extra or {}).get(kind, [])]:
            if term.lower() not in seen:
                seen.add(term.lower())
                out.append((len(out), kind, term))
    return out


def _found(text: Column, vocabulary: list[tuple[int, str, str]]) -> Column:
    """Structs of the terms in the text, at word borders, in the vocabulary's order.

    A term can only be where its first word is: the text's distinct words meet a map from first words to terms, and only
    the terms of those that are in it are tried as patterns, however large the vocabulary is."""
    terms: dict[str, list[tuple[int, str, str, str]]] = {}
    for n, kind, term in vocabulary:
        low = term.lower()
        terms.setdefault(re.search(r"\w+", low)[0], []).append((n, low, kind, r"(?U)\b" + re.escape(low) + r"\b"))
    if not terms:
        return F.array().cast("array<struct<rank:int,entity:string,kind:string>>")
    struct = lambda t: F.struct(F.lit(t[0]).alias("rank"), F.lit(t[1]).alias("entity"), F.lit(t[2]).alias("kind"), F.lit(t[3]).alias("pattern"))
    by_word = F.create_map(*[c for w, ts in terms.items() for c in (F.lit(w), F.array(*map(struct, ts)))])
    low = F.lower(text)
    there = F.array_intersect(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)), F.array(*map(F.lit, terms)))
    tried = F.filter(F.flatten(F.transform(there, lambda w: by_word[w])), lambda t: F.regexp_like(low, t["pattern"]))
    return F.transform(F.array_sort(tried), lambda t: F.struct(t["rank"].alias("rank"), t["entity"].alias("entity"), t["kind"].alias("kind")))


def title_entities(papers: DataFrame, vocabulary: list[tuple[int, str, str]]) -> DataFrame:
    """doc_id, entity, kind: vocabulary terms of the title, first kind first, then capitalised words that are neither terms nor stop words."""
    terms = papers.select("doc_id", F.explode(_found(F.col("title"), vocabulary)).alias("e")).select("doc_id", "e.*")
    words = papers.select("doc_id", F.posexplode(F.regexp_extract_all("title", F.lit(CAPITALISED), F.lit(0))).alias("p", "word"))
    words = words.where((F.length("word") >= 3) & ~F.lower("word").isin(STOP_WORDS))
    words = words.select("doc_id", (F.col("p") + 1_000_000).alias("rank"), F.lower("word").alias("entity"), F.when(F.lower("word").rlike(DATASET_PARTS), "DATASET").otherwise("METHOD").alias("kind"))
    first = Window.partitionBy("doc_id", "entity").orderBy("rank")
    return terms.unionByName(words).withColumn("rn", F.row_number().over(first)).where("rn = 1").select("doc_id", "entity", "kind")


def abstract_entities(papers: DataFrame, vocabulary: list[tuple[int, str, str]]) -> DataFrame:
    """doc_id, entity: vocabulary terms of the abstract; terms that are stop words don't count."""
    words = [v for v in vocabulary if v[2].lower() not in STOP_WORDS]
    return papers.select("doc_id", F.explode(F.transform(_found(F.col("abstract"), words), lambda e: e["entity"])).alias("entity")).distinct()


def topic_entities(papers: DataFrame) -> DataFrame:
    """doc_id, entity of variant topics: a string, or an object's display name and its subfield's."""
    t = papers.select("doc_id", F.explode("topics").alias("t"))
    plain = F.when(F.schema_of_variant("t") == "STRING", F.try_variant_get("t", "$", "string"))
    names = F.array_compact(F.array(plain, F.try_variant_get("t", "$.display_name", "string"), F.try_variant_get("t", "$.subfield.display_name", "string")))
    return t.select("doc_id", F.explode(names).alias("entity")).where("entity <> ''").select("doc_id", F.lower("entity").alias("entity")).distinct()


def paper_entities(papers: DataFrame, vocabulary: list[tuple[int, str, str]] | None = None, use_abstract: bool = False, use_topics: bool = False) -> DataFrame:
    """doc_id, entity over the chosen fields, distinct."""
    vocabulary = merged_vocabulary() if vocabulary is None else vocabulary
    parts = [title_entities(papers, vocabulary).select("doc_id", "entity")]
    if use_abstract:
        parts.append(abstract_entities(papers, vocabulary))
    if use_topics:
        parts.append(topic_entities(papers))
    return reduce(DataFrame.unionByName, parts).distinct()


def document_frequency(doc_entity: DataFrame) -> DataFrame:
    return doc_entity.groupBy("entity").agg(F.count("*").alias("df"))


def additions(titles: DataFrame, both: DataFrame) -> DataFrame:
    """The rows that abstracts add."""
    return both.join(titles, ["doc_id", "entity"], "left_anti")


def entity_stats(papers: DataFrame, doc_entity: DataFrame, known: list[str], connector: float = 0.1) -> DataFrame:
    """One row: papers, mean and median entities a paper, share of known entities, connectors (df over a share of papers), share of papers with one at most."""
    per = papers.select("doc_id").join(doc_entity.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = per.agg(F.count("*").alias("n_papers"), F.avg("n").alias("mean_entities"), F.median("n").alias("median_entities"), F.avg((F.col("n") <= 1).cast("int")).alias("low_share"))
    two = document_frequency(doc_entity).join(F.broadcast(papers.agg(F.count("*").alias("all_papers")))).agg(
        F.avg(F.col("entity").isin(known).cast("int")).alias("known_share"), F.count_if(F.col("df") > connector * F.col("all_papers")).alias("connectors")
    )
    return one.join(F.broadcast(two))


def mine_vocabulary(papers: DataFrame, known: list[str], least: int = 2) -> DataFrame:
    """word, mentions: capitalised title words of three letters or more that aren't stop words or known, with some mentions."""
    words = papers.select(F.explode(F.regexp_extract_all("title", F.lit(CAPITALISED), F.lit(0))).alias("word"))
    good = words.where((F.length("word") >= 3) & ~F.lower("word").isin(STOP_WORDS) & ~F.lower("word").isin([k.lower() for k in known] or [""]))
    return good.groupBy("word").agg(F.count("*").alias("mentions")).where(F.col("mentions") >= least)


def entity_matrix(papers: DataFrame, doc_entity: DataFrame) -> DataFrame:
    """The 0/1 matrix as rows: doc_id and the sorted numbers of its entities; papers without entities keep an empty row."""
    number = numbered(document_frequency(doc_entity).select("entity"), [F.col("entity")], "col")
    rows = doc_entity.join(number, "entity").groupBy("doc_id").agg(F.sort_array(F.collect_list("col")).alias("cols"))
    return papers.select("doc_id").join(rows, "doc_id", "left").withColumn("cols", F.coalesce("cols", F.array().cast("array<long>")))
