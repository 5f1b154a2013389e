"""One canonical record per cluster: choice, backfill, provenance, order, and what became of each source record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave.operators.order import ranked
from litweave.session import cut

#: Which database is preferred.
DB_RANK = {"ACM Digital Library": 0, "IEEE Xplore": 1, "Scopus": 2}
#: Fields that are filled from the other records of a cluster; type and title stay the keeper's own.
SCALARS = ("year", "doi", "doi_raw", "venue", "volume", "issue", "start_page", "end_page", "publisher", "url", "issn", "isbn")


def _some(name: str, kind: str) -> Column:
    c = F.col(name)
    return F.coalesce(F.size(c) > 0, F.lit(False)) if kind.startswith("array") else F.coalesce(c != "", F.lit(False))


def _rank(db: Column) -> Column:
    c = F.lit(9)
    for k, v in DB_RANK.items():
        c = F.when(db == k, v).otherwise(c)
    return c


def completeness(records: DataFrame) -> Column:
    """Sort key, best first: doi, abstract, keywords, authors, venue and start page present, longer abstract, database,
    lowest idx."""
    kinds = dict(records.dtypes)
    missing = [(~_some(c, kinds[c])).cast("int") for c in ("doi", "abstract", "keywords", "authors", "venue", "start_page")]
    parts = [*missing, -F.length(F.coalesce("abstract", F.lit(""))), _rank(F.col("source_db")), F.col("idx")]
    return F.struct(*(p.alias(f"c{i}") for i, p in enumerate(parts)))


def canonical(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster: the keeper (``idx``), each scalar its own or else the first given by idx, authors likewise,
    the longest keywords and abstract, and n_in_cluster, found_in, merged_idxs. One aggregation, no window."""
    kinds = dict(records.dtypes)
    r = records.join(clusters, "idx").withColumn("__k", completeness(records))
    kept = [c for c in ("type", "title") if c in kinds]
    aggs = [F.min_by(c, "__k").alias(a) for c, a in (("idx", "keeper"), ("source_db", "source_db"), *((c, c) for c in kept))]
    for c in (*(s for s in SCALARS if s in kinds), "authors"):
        ok = _some(c, kinds[c])
        aggs += [F.min_by(c, F.struct((~ok).cast("int").alias("m"), F.lit(0).alias("o"), F.col("__k"))).alias(f"__b_{c}"), F.min_by(c, "__k").alias(f"__o_{c}"), F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("idx"))).alias(f"__f_{c}")]
    for c, size in (("keywords", F.size("keywords")), ("abstract", F.length("abstract"))):
        aggs.append(F.min_by(c, F.struct((-F.coalesce(size, F.lit(-1))).alias("n"), F.col("__k"))).alias(c))
    g = r.groupBy("root").agg(*aggs, F.count("*").alias("n_in_cluster"), F.array_sort(F.collect_set("source_db")).alias("found_in"), F.array_sort(F.collect_list("idx")).alias("merged_idxs"))
    own = lambda c: F.when(_some(f"__o_{c}", kinds[c]), F.col(f"__o_{c}")).otherwise(F.col(f"__f_{c}"))
    return g.select("root", F.col("keeper").alias("idx"), "n_in_cluster", "found_in", "merged_idxs", *kept, *(own(c).alias(c) for c in (*(s for s in SCALARS if s in kinds), "authors")), "keywords", "abstract", "source_db")


def number(corpus: DataFrame, by: str = "year") -> DataFrame:
    """Adds cid: 1 and on in the order of year (a missing one first), ntitle, root."""
    c = corpus.withColumn("__y", F.coalesce(F.when(F.col(by) != "", F.col(by)), F.lit("0000")))
    return ranked(c, "cid", "__y", "ntitle", "root").drop("__y")


def disposition(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """(idx, cid, n_in_cluster, status): retained, or duplicate-removed."""
    m = corpus.select("cid", F.col("idx").alias("keeper"), "n_in_cluster", F.explode("merged_idxs").alias("idx"))
    return records.join(m, "idx").withColumn("status", F.when(F.col("idx") == F.col("keeper"), "retained").otherwise("duplicate-removed")).drop("keeper")


def last_survivors(merges: DataFrame) -> DataFrame:
    """(survivor, absorbed, why): each merge with the survivor at the end of its chain, by doubling the steps taken. Of
    several survivors of one record the least counts."""
    m = cut(merges.where("survivor <> absorbed").groupBy("absorbed").agg(F.min("survivor").alias("survivor"), F.min_by("why", "survivor").alias("why")))
    for _ in range(64):
        up = m.select(F.col("absorbed").alias("survivor"), F.col("survivor").alias("above"))
        if m.join(up, "survivor", "left_semi").isEmpty():
            return m.select("survivor", "absorbed", "why")
        m = cut(m.join(up, "survivor", "left").select("absorbed", F.coalesce("above", "survivor").alias("survivor"), "why"))
        if not m.where("survivor = absorbed").isEmpty():
            break
    raise ValueError("records absorb each other in a circle")


def overlay(corpus: DataFrame, merges: DataFrame) -> DataFrame:
    """Applies manual merges (survivor, absorbed, why). The survivor's empty fields are filled from the absorbed records,
    the least id first, the longer keywords win, provenance is united; absorbed records go and their ids are not used
    again. In a chain of merges all go to its last survivor. Merges whose absorbed record is gone are done already; one
    whose survivor is missing raises, and so do merges in a circle."""
    kinds = dict(corpus.dtypes)
    merges = last_survivors(merges)
    pending = merges.join(corpus.select(F.col("cid").alias("absorbed")), "absorbed", "left_semi")
    lost = pending.join(corpus.select(F.col("cid").alias("survivor")), "survivor", "left_anti").first()
    if lost:
        raise ValueError(f"no survivor {lost['survivor']} for {lost['absorbed']}")
    fill = [c for c in (*SCALARS, "authors", "abstract") if c in kinds]
    a = pending.join(corpus, F.col("absorbed") == F.col("cid")).groupBy("survivor").agg(
        F.array_sort(F.collect_list("absorbed")).alias("absorbed_cids"), F.array_sort(F.collect_list("title")).alias("absorbed_titles"), F.array_join(F.array_sort(F.collect_list("why")), "; ").alias("merge_note"),
        F.max_by("keywords", F.struct(F.size("keywords").alias("n"), -F.col("absorbed"))).alias("__kw"), F.flatten(F.collect_list("found_in")).alias("__in"), F.flatten(F.collect_list("merged_idxs")).alias("__ids"),
        *(F.min_by(F.when(_some(c, kinds[c]), F.col(c)), F.when(_some(c, kinds[c]), F.col("absorbed"))).alias(f"__{c}") for c in fill),
    )
    out = corpus.join(pending.select(F.col("absorbed").alias("cid")), "cid", "left_anti").join(a, F.col("cid") == F.col("survivor"), "left")
    new = {c: F.when(_some(c, kinds[c]), F.col(c)).otherwise(F.coalesce(F.col(f"__{c}"), F.col(c))) for c in fill}
    empty = lambda c, k: F.coalesce(F.col(c), F.array().cast(k))
    new["keywords"] = F.when(F.coalesce(F.size("__kw"), F.lit(-1)) > F.coalesce(F.size("keywords"), F.lit(0)), F.col("__kw")).otherwise(F.col("keywords"))
    new["found_in"] = F.array_sort(F.array_union(empty("found_in", "array<string>"), empty("__in", "array<string>")))
    new["merged_idxs"] = F.array_sort(F.array_union(empty("merged_idxs", kinds["merged_idxs"]), empty("__ids", kinds["merged_idxs"])))
    new["n_in_cluster"] = F.when(F.col("survivor").isNull(), F.col("n_in_cluster")).otherwise(F.size(new["merged_idxs"]).cast("long"))
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in corpus.columns), "absorbed_cids", "absorbed_titles", "merge_note")
