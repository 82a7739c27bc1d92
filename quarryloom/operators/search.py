"""Vector and text search, fusion, reranking; traversal and communities."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, split_identifier
from .graph import pair_counts
from .lineage import cut


def nearest(vectors: DataFrame, query: list[float], k: int, most: float | None = None, scan_limit: int | None = None) -> DataFrame:
    """(id, distance) of the k nearest by 1 - cosine, ties by id. Null vectors and those of another length are left out.

    The query is a literal, so every task keeps its own k rows and no vector is shuffled.
    """
    rows = vectors.limit(scan_limit) if scan_limit else vectors
    rows = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") == len(query)))
    rows = rows.select("id", (1 - cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in query]))).alias("distance"))
    if most is not None:
        rows = rows.filter(F.col("distance") <= most)
    return rows.orderBy("distance", "id").limit(k)


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, stemmed: bool = False) -> DataFrame:
    """(doc_id, score) for documents (doc_id, text): words lower-cased, apart by white space. The few query terms are counted in one pass; with ``stemmed``, by stems."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    if stemmed:
        words, terms = stems(words), sorted({porter(t) for t in terms})
    equal = lambda t: lambda w: w == F.lit(t)
    tf = [F.size(F.filter("words", equal(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").alias("len"), *tf)
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    both = rows.crossJoin(F.broadcast(stats))  # one row of statistics
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    score = sum((F.when(F.col(f"tf{i}") > 0, part(i)).otherwise(0.0) for i in range(len(terms))), F.lit(0.0))
    return both.select("doc_id", score.alias("score")).filter("score > 0")


def fused(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two (id, rank)."""
    both = a.select("id", F.col("rank").alias("ra")).join(b.select("id", F.col("rank").alias("rb")), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.select("id", (part("ra") + part("rb")).alias("score"))


def rerank_mmr(candidates: DataFrame, query: list[float], k: int, weight: float = 0.7) -> DataFrame:
    """(id, position): maximal marginal relevance over the 3 * k nearest, a bounded number of rows in one task."""
    near = nearest(candidates, query, 3 * k).join(candidates, "id").select("id", "distance", F.col("embedding").cast("array<double>").alias("embedding"))

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["distance", "id"]).reset_index(drop=True)
        v = np.stack(rows["embedding"])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
        like, taken = 1 - rows["distance"].to_numpy(), []
        while len(taken) < min(k, len(rows)):
            spread = (v @ v[taken].T).max(1) if taken else np.zeros(len(v))
            gain = weight * like - (1 - weight) * spread
            gain[taken] = -np.inf
            taken.append(int(gain.argmax()))
        return pd.DataFrame({"id": rows["id"].iloc[taken].to_numpy(), "position": range(len(taken))})

    return near.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(pick, "id long, position long")


def hops(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(id, hop): least number of steps from ``start`` (id), up to ``most``. Each round joins the frontier alone and drops what was reached before."""
    edges = cut(edges.select("source_id", "target_id").distinct())  # each round reads them, none computes them again
    reached = start.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, most + 1):
        step = frontier.join(edges, F.col("id") == F.col("source_id")).select(F.col("target_id").alias("id")).distinct()
        frontier = cut(step.join(reached, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def propagated_labels(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, community) after a fixed number of rounds: the commonest label among the neighbours, the smallest of equals. Not Leiden."""
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).filter("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id"), "community").agg(F.count("*").alias("n"))
        labels = votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
    return labels


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(community, internal, total, cohesion): edges inside a community over edges that touch it."""
    counted = pair_counts(edges, members, "community")
    inside = F.when(F.col("source_community") == F.col("target_community"), F.col("n")).otherwise(0).alias("inside")
    touch = counted.select(F.explode(F.array_distinct(F.array("source_community", "target_community"))).alias("community"), inside, "n")
    return touch.groupBy("community").agg(F.sum("inside").alias("internal"), F.sum("n").alias("total")).withColumn("cohesion", F.col("internal") / F.col("total"))


def interactions(edges: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n): edges between two communities, at least ``least``."""
    counted = pair_counts(edges, members, "community").filter("source_community <> target_community")
    pair = [F.least("source_community", "target_community").alias("a"), F.greatest("source_community", "target_community").alias("b")]
    return counted.groupBy(*pair).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def traces(edges: DataFrame, entries: DataFrame, most: int = 10, least: int = 3, per_entry: int | None = None) -> DataFrame:
    """(trace): paths from the entries (id) along edges, up to ``most`` steps, without cycles; short ones and those whose steps another trace holds are dropped.

    Their number grows with the branches on the way. ``per_entry`` keeps, at
    every step, the first so many paths of an entry, by their steps: a bound that cuts results.
    """
    edges = cut(edges.select("source_id", "target_id").distinct())
    paths = entries.select(F.array("id").alias("trace")).distinct()
    done = None
    for _ in range(most - 1):
        step = paths.join(edges, (F.element_at("trace", -1) == edges["source_id"]) & ~F.array_contains("trace", edges["target_id"]), "left")
        step = step.select(F.when(F.col("target_id").isNull(), F.col("trace")).otherwise(F.concat("trace", F.array("target_id"))).alias("trace"), F.col("target_id").isNull().alias("ended"))
        if per_entry:
            first = Window.partitionBy(F.col("trace")[0], "ended").orderBy("trace")
            step = step.withColumn("nth", F.row_number().over(first)).filter((F.col("nth") <= per_entry) | F.col("ended")).drop("nth")
        step = cut(step)
        ended = step.filter("ended").select("trace")
        done = ended if done is None else done.unionByName(ended)
        paths = step.filter("NOT ended").select("trace")
        if paths.isEmpty():
            break
    done = done.unionByName(paths).filter(F.size("trace") >= least).distinct()
    # a larger trace holds the first step too: an equi-join on one of its steps
    steps = done.select(F.col("trace").alias("big"), F.explode("trace").alias("step"))
    held = done.select("trace", F.col("trace")[0].alias("step")).join(steps, "step").filter((F.size("big") > F.size("trace")) & (F.size(F.array_except("trace", "big")) == 0))
    return done.join(held.select("trace").distinct(), "trace", "left_anti")


def community_names(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, name): the folder that most of a community's nodes (id, file_path) lie in, the first of equals."""
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    votes = members.join(nodes.select("id", folder.alias("folder")), "id").groupBy("community", "folder").agg(F.count("*").alias("n"))
    return votes.groupBy("community").agg(F.min_by("folder", F.struct(-F.col("n"), "folder")).alias("name"))


def entry_scores(edges: DataFrame) -> DataFrame:
    """(id, score): how much a node calls for each time it is called, and once more: entries call much and are called little."""
    calls = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("calls"))
    called = edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("called"))
    return calls.join(called, "id", "left").select("id", (F.col("calls") / (F.coalesce("called", F.lit(0)) + 1)).alias("score"))


def blended(vector: Column, text: Column, other: Column, weight: float = 0.7) -> Column:
    """weight * cosine + (1 - weight) * Levenshtein similarity."""
    longest = F.greatest(F.length(text), F.length(other), F.lit(1))
    return weight * vector + (1 - weight) * (1 - F.levenshtein(text, other) / longest)


#: Words that say nothing of what is looked for.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "what", "where", "which", "with"]


def query_terms(text: Column) -> Column:
    """Search terms of a query: words and the parts of compound names, lower case, each once, stop words left out."""
    words = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_.\-/]+", " "), " "), lambda w: w != "")
    parts = F.flatten(F.transform(words, lambda w: F.split(F.lower(split_identifier(w)), " ")))
    return F.filter(F.array_distinct(parts), lambda w: ~w.isin(STOP_WORDS) & (w != ""))


def confidence(tier: Column) -> Column:
    """How sure a call's resolution is: 1.0 in the same file, 0.8 by an import, 0.4 by a name alone; null for none."""
    return F.when(tier == "same-file", 1.0).when(tier == "import", 0.8).when(tier == "global", 0.4)


def resolved_calls(calls: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """(path, seq, source_id, target_id, confidence): calls (path, seq, name, source_id) by the best tier.

    A callable of the same file, else one of a file that the caller imports
    (from_file, target), else the only one of that name anywhere. Both sides of every
    join are sorted: rows that a parser makes are many times what Spark takes from the
    size of its input, and would be sent through the driver.
    """
    calls = calls.hint("merge")
    known = symbols.filter(F.col("label").isin("Function", "Method", "Constructor", "Class")).select(F.col("path").alias("at"), "name", F.col("node_id").alias("target_id"))
    own = calls.join(known.withColumnRenamed("at", "path"), ["path", "name"]).withColumn("tier", F.lit("same-file"))
    reach = imported.select(F.col("from_file").alias("path"), F.col("target").alias("at")).distinct()
    by_import = calls.join(reach, "path").hint("merge").join(known, ["at", "name"]).withColumn("tier", F.lit("import")).drop("at")
    alone = known.groupBy("name").agg(F.min("target_id").alias("target_id"), F.countDistinct("target_id").alias("n")).filter("n = 1").drop("n")
    by_name = calls.join(alone, "name").withColumn("tier", F.lit("global"))
    columns = ["path", "seq", "source_id", "target_id", "tier"]
    found = own.select(columns).unionByName(by_import.select(columns)).unionByName(by_name.select(columns)).withColumn("confidence", confidence(F.col("tier")))
    best = found.groupBy("path", "seq", "source_id").agg(F.max_by("target_id", F.struct("confidence", "target_id")).alias("target_id"), F.max("confidence").alias("confidence"))
    return best.select("path", "seq", "source_id", "target_id", "confidence")


def decayed(reached: DataFrame, rate: float, most: int) -> DataFrame:
    """(id, hop, weight): the ``most`` nearest of :func:`hops`, weighted exp(-rate * hop), ties by id."""
    return reached.withColumn("weight", F.exp(-F.lit(rate) * F.col("hop"))).orderBy("hop", "id").limit(most)


def by_community(hits: DataFrame, members: DataFrame, strong: int = 5, moderate: int = 2) -> DataFrame:
    """(community, hits, score, signal) of hits (id, score): strong, moderate or weak by how many fall into a community."""
    out = hits.join(members, "id").groupBy("community").agg(F.count("*").alias("hits"), F.sum("score").alias("score"))
    return out.withColumn("signal", F.when(F.col("hits") >= strong, "strong").when(F.col("hits") >= moderate, "moderate").otherwise("weak"))


def processes_of(steps: DataFrame, members: DataFrame, community) -> DataFrame:
    """(process, ids): the steps (process, step, id), in order, of every process that has a step in the community."""
    touching = steps.join(members.filter(F.col("community") == community), "id", "left_semi").select("process").distinct()
    found = steps.join(touching, "process", "left_semi")
    return found.groupBy("process").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "id"))), lambda x: x["id"]).alias("ids"))


def layered(text_hits: DataFrame, vector_hits: DataFrame, edges: DataFrame, members: DataFrame, rate: float = 0.5, most_hops: int = 2, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(ids with weight, communities): two ranked lists (id, rank) fused, their neighbourhood weighted by distance, and the communities they fall into."""
    hits = cut(fused(text_hits, vector_hits))
    around = decayed(hops(edges, hits.select("id"), most_hops), rate, most)
    return around, by_community(hits, members)


#: Porter's suffixes of steps 2, 3 and 4, longest first where one ends another.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter(word: str) -> str:
    """A lower-case English word's stem by Porter's algorithm of 1980."""
    if len(word) < 3:
        return word
    forms = lambda stem: "".join("v" if c in "aeiou" or (c == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, c in enumerate(stem))
    measure = lambda stem: len(re.findall("v+c+", forms(stem)))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and forms(w)[-1] == "c"
    short = lambda w: forms(w)[-3:] == "cvc" and w[-1] not in "wxy"
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in forms(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in forms(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, new in sorted(rules, key=lambda x: -len(x[0])):
            if word.endswith(end):
                word = word[: -len(end)] + new if measure(word[: -len(end)]) else word
                break
    for end in sorted(_STEP4, key=lambda x: -len(x)):
        if word.endswith(end):
            stem = word[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def stems(words: Column) -> Column:
    """Stems of an array of words; an option for text search, off by default."""

    @F.pandas_udf("array<string>")
    def of(column: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(word: str) -> str:
            if word not in known:
                known[word] = porter(word)
            return known[word]

        return column.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return of(words)
