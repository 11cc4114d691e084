"""Joins of hits, labels, structures and files. Sides are joined by key; Spark broadcasts one whose size it knows to be small."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts, ids
from .filters import LEVELS


def first_labels(labels: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """One row for each id: the first one by `order` (line number), else the smallest."""
    rest = F.struct(*[c for c in labels.columns if c != id_col])
    best = F.min_by(rest, order) if order else F.min(rest)
    return labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(best.alias("_first")).select(id_col, "_first.*")


def attach_labels(hits: DataFrame, labels: DataFrame, order: str | None = None) -> DataFrame:
    """Hits with q_ and t_ levels of query and target; hits of which either is unlabelled go."""
    first = first_labels(labels, "id", order)
    q = first.select(F.col("id").alias("query"), *[F.col(c).alias(f"q_{c}") for c in LEVELS])
    t = first.select(F.col("id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in LEVELS])
    return hits.join(q, "query").join(t, "target")


def limit_to(df: DataFrame, listed: DataFrame, item: str = "id", name: str = "id") -> DataFrame:
    """Items on a list, which may name them with or without extension."""
    names = listed.select(ids.strip_structure_extension(F.col(name)).alias("_listed")).distinct()
    return df.join(names, ids.strip_structure_extension(df[item]) == names["_listed"], "left_semi")


def pending(items: DataFrame, existing: DataFrame, item: str = "id", overwrite: bool = False) -> DataFrame:
    """Items that have no output yet; all of them when outputs are to be overwritten."""
    return items if overwrite else items.join(existing.select(item).distinct(), item, "left_anti")


def exclude_eval(items: DataFrame, eval_ids: DataFrame, item: str = "id") -> DataFrame:
    """Items whose first seven characters name no evaluation item."""
    out = eval_ids.select(F.substring(item, 1, 7).alias("_eval")).distinct()
    return items.join(out, F.substring(items[item], 1, 7) == out["_eval"], "left_anti")


def same_query_set(hits: DataFrame, queries: DataFrame) -> DataFrame:
    return hits.join(queries.select("query").distinct(), "query", "left_semi")


def restrict_to_train_labels(rows: DataFrame, index: DataFrame, label: str = "label") -> DataFrame:
    """Rows of classes that training knows, with the training index of the class (index: label, label_idx)."""
    return rows.join(index.select(F.col("label").alias(label), "label_idx"), label)


def in_classification(listed: DataFrame, domains: DataFrame, files: DataFrame) -> DataFrame:
    """Files of domains whose PDB id (first word of the description) is listed."""
    wanted = listed.select(F.upper("pdb_id").alias("_pdb")).distinct()
    word = F.upper(F.regexp_extract(domains["description"], r"^\s*(\S+)", 1))
    sids = domains.join(wanted, word == wanted["_pdb"], "left_semi").select(F.col("sid").alias("_sid")).distinct()
    return files.join(sids, ids.stem(files["path"]) == sids["_sid"], "left_semi")


#: Names that stand for a range when ranges are cut.
_DRAWN = 64


def _cuts(keys: DataFrame, parts: int) -> list[str]:
    """Keys that cut all keys into about `parts` equal ranges, from a bounded sample in the order of a hash."""
    drawn = sorted(r[0] for r in keys.select("key").orderBy(F.xxhash64("key"), "key").limit(_DRAWN * parts).collect())
    return sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []


def _held_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted names and prefixes in one go: the prefixes of the name at hand lie on a stack, each one the beginning of the next."""
    now, stack = None, []
    for batch in batches:
        paths, found = [], []
        for part, key, path in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if part != now:
                now, stack = part, []
            while stack and not key.startswith(stack[-1]):
                stack.pop()
            if path is None:
                if not stack or stack[-1] != key:
                    stack.append(key)
            else:
                paths += [path] * len(stack)
                found += stack
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], ["path", "prefix"])


def match_prefix(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, prefix) of every file whose name starts with a prefix (not empty), by merging sorted names and prefixes.

    Names and prefixes are one row each in the shuffle, dealt out by ranges; a range starts with the prefixes before it that its
    first key begins with. Equal names of many files are told apart by path, so they fill many ranges. Null paths and
    prefixes match nothing; repeated prefixes count once, repeated paths as often as they occur. Runs a job that draws the ranges.
    """
    spark = files.sparkSession
    name = ids.basename(F.col("path"))
    end = F.lit("\0")
    names = files.where(F.col("path").isNotNull()).select(F.concat(name, end, "path").alias("key"), "path")
    known = prefixes.where("prefix != ''").select(F.col("prefix").alias("key")).distinct()
    cuts = _cuts(names, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<string>"), lambda c: c <= F.col("key")))
    starts = spark.createDataFrame(list(enumerate(cuts, 1)), "part int, first string")
    begun = starts.select("part", "first", F.explode(F.sequence(F.lit(1), F.length("first"))).alias("n")).select("part", F.expr("substring(first, 1, n)").alias("key"))
    none = F.lit(None).cast("string").alias("path")
    held = begun.join(known, "key").select("part", "key", none)
    rows = names.select(part.alias("part"), "key", "path").unionByName(known.select(part.alias("part"), "key", none)).unionByName(held)
    return rows.repartition("part").sortWithinPartitions("part", "key", F.col("path").asc_nulls_first()).mapInArrow(_held_prefixes, "path string, prefix string")


def unmatched_prefixes(matches: DataFrame, prefixes: DataFrame) -> DataFrame:
    return prefixes.select("prefix").distinct().join(matches, "prefix", "left_anti")


def annotate(structures: DataFrame, cla: DataFrame, entry: DataFrame, go: DataFrame, uniprot: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 20-column annotation of structures(sid, path, image, sequence); what a source lacks is empty. Columns of structures named in
    `keep`, such as a place in a list, follow.

    cla(sid, sccs); entry(pdb_id, json), go(pdb_id, body), uniprot(pdb_id, json): pre-fetched answers by PDB id.
    """
    one = lambda df, key, value: df.where(F.col(key).isNotNull()).groupBy(F.upper(key).alias("_pdb")).agg(F.min(value).alias(f"_{value}"))
    s = structures.withColumn("_pdb", ids.pdb_id(F.col("sid")))
    classes = cla.where("sid IS NOT NULL").groupBy("sid").agg(F.min("sccs").alias("sccs"))
    s = s.join(classes, "sid", "left")
    s = s.join(one(entry, "pdb_id", "json").withColumnRenamed("_json", "_entry"), "_pdb", "left")
    s = s.join(one(go, "pdb_id", "body"), "_pdb", "left").join(one(uniprot, "pdb_id", "json").withColumnRenamed("_json", "_uniprot"), "_pdb", "left")
    f, regions = facts.entry_facts(F.col("_entry")), facts.transmembrane_count(F.col("_uniprot"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    level: list[Column] = [blank(ids.level(F.col("sccs"), n + 1)) for n in range(4)]
    columns = {
        "SCOPeID": F.col("sid"),
        "PDBFileName": ids.basename(F.col("path")),
        "ProteogramFileName": ids.basename(F.col("image")),
        "PDBId": blank(F.col("_pdb")),
        "ChainId": blank(ids.chain_id(F.col("sid"))),
        "PDBAndChainId": blank(ids.pdb_chain(F.col("sid"))),
        **{name: level[k] for k, name in enumerate(("SCOPeClass", "SCOPeFold", "SCOPeSuperfamily", "SCOPeFamily"))},
        "PDBSequenceLength": F.length("sequence"),
        "PDBDepositDate": f["deposit_date"],
        "PDBExperimentalMethod": f["experimental_method"],
        "PDBMolecularWeight": f["molecular_weight"],
        "PDBDisulfideBond": f["disulfide_bonds"],
        "PDBProteinEntityCount": f["protein_entities"],
        "PDBIsTransmembrane": regions > 0,
        "PDBTransmembraneRegionCounts": regions,
        "PDBeGOAnnotation": blank(F.col("_body")),
        "PDBSequence": F.col("sequence"),
    }
    return s.select(*[c.alias(k) for k, c in columns.items()], *keep)


def resolve_assets(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with the path of their target's image; png before jpg before other kinds, null when missing."""
    rank = F.when(F.lower("path").endswith(".png"), 2).when(F.lower("path").rlike(r"\.jpe?g$"), 1).otherwise(0)
    best = files.groupBy(ids.strip_structure_extension(F.col("path")).alias("_name")).agg(F.max_by("path", F.struct(rank, "path")).alias("asset"))
    return hits.join(best, ids.strip_structure_extension(hits["target"]) == best["_name"], "left").drop("_name")


def extract_listed_chains(listed: DataFrame, atoms: DataFrame) -> DataFrame:
    """Atoms of each listed (pdb_id, chain, sid) under its sid; atoms carry the PDB id as structure_id."""
    want = listed.select(F.upper("pdb_id").alias("_pdb"), F.col("chain"), F.col("sid")).distinct()
    joined = atoms.withColumn("_pdb", F.upper("structure_id")).join(want, ["_pdb", "chain"])
    return joined.withColumn("structure_id", F.col("sid")).drop("_pdb", "sid")


def image_labels(images: DataFrame, annotations: DataFrame, level: str, order: str | None = None) -> DataFrame:
    """Images(path) with the label of the annotation whose SCOPeID is their stem; null where there is none."""
    keep = ["SCOPeID", level] + ([order] if order else [])
    first = first_labels(annotations.select(*dict.fromkeys(keep)), "SCOPeID", order)
    joined = images.withColumn("SCOPeID", ids.stem(F.col("path"))).join(first.select("SCOPeID", F.col(level).alias("label")), "SCOPeID", "left")
    return joined


def matched_only(labelled: DataFrame) -> DataFrame:
    """Labelled images alone; an error when there is none."""
    out = labelled.where("label IS NOT NULL")
    if out.isEmpty():
        raise ValueError("no image has an annotation")
    return out
