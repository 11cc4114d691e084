"""Protein-like tables drawn from the given ones by rules that SQL can repeat, with that SQL."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.common import scratch_dir
from .operators.filters import LEVELS as LEVELS
from .operators.filters import with_levels
from .sources.files import write_files, write_packed

STAGES = ["click", "view", "purchase", "error", "login"]
AA = "ARNDCQEGHILKMFPSTWYV"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("item_id"), F.lit("given").alias("model"), F.col("embedding").alias("vec"), "label")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and four nested levels: label by fours, by twos, itself, and with the parity of the id."""
    rows = table(spark, sf_dir, "embeddings")
    parts = [F.expr("label div 4"), F.expr("label div 2"), F.col("label"), F.col("vec_id") % 2]
    sccs = F.concat_ws(".", *[p.cast("string") for p in parts])
    return with_levels(rows.select(F.col("vec_id").cast("string").alias("id"), sccs.alias("sccs")))


LABELS_SQL = """labels AS (
  SELECT id, a AS class, a || '.' || b AS fold, a || '.' || b || '.' || c AS superfamily, a || '.' || b || '.' || c || '.' || d AS family
  FROM (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label // 4 AS VARCHAR) AS a, CAST(label // 2 AS VARCHAR) AS b,
               CAST(label AS VARCHAR) AS c, CAST(vec_id % 2 AS VARCHAR) AS d FROM embeddings))"""

HITS_SQL = """e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
hits AS (
  SELECT query, target, score, rank FROM (
    SELECT query, target, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank
    FROM (SELECT a.id AS query, b.id AS target, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a, e b))
  WHERE rank <= 6)"""


def near_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second search method: the five items of next higher number."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"))
    return rows.select(F.col("vec_id").cast("string").alias("query"), "rank", (F.col("vec_id") + F.col("rank")).cast("string").alias("target"), (1.0 / F.col("rank")).alias("score"))


NEAR_SQL = """near AS (
  SELECT CAST(vec_id AS VARCHAR) AS query, CAST(vec_id + rank AS VARCHAR) AS target, 1.0 / rank AS score, rank
  FROM embeddings, (SELECT unnest(range(1, 6)) AS rank))"""


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten neighbouring orders make a structure; quantity, price and discount are coordinates."""
    rows = table(spark, sf_dir, "lineitem").withColumn("structure_id", F.expr("l_orderkey div 10"))
    order = Window.partitionBy("structure_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return rows.select(
        "structure_id",
        (F.row_number().over(order) - 1).alias("res_idx"),
        F.substring(F.lit(AA), (F.col("l_partkey") % 20 + 1).cast("int"), F.lit(1)).alias("aa"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 2000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
    )


RESIDUES_SQL = f"""residues AS MATERIALIZED (
  SELECT l_orderkey // 10 AS structure_id,
         row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS res_idx,
         substr('{AA}', CAST(l_partkey % 20 + 1 AS INTEGER), 1) AS aa, l_quantity AS x, l_extendedprice / 2000 AS y, l_discount * 100 AS z
  FROM lineitem),
sizes AS (SELECT structure_id, count(*) AS n FROM residues GROUP BY 1)"""

PAIRS_SQL = RESIDUES_SQL + """,
pairs AS MATERIALIZED (
  SELECT a.structure_id, a.res_idx AS i, b.res_idx AS j, a.aa AS aa_i, b.aa AS aa_j,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
  FROM residues a JOIN residues b ON a.structure_id = b.structure_id WHERE b.res_idx - a.res_idx > 0)"""


def frame_atoms(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Lines are atoms, orders residues, ten orders a structure of three frames; lines flagged N are solvent. `together` deals lines by
    structure before they are repeated for its frames, so what follows by frame needs no exchange of atoms."""
    rows = table(spark, sf_dir, "lineitem").withColumn("structure_id", F.expr("l_orderkey div 10"))
    if together:  # by number: Spark would put what is small before it grows into a few tasks
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "structure_id")
    order = Window.partitionBy("structure_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = rows.withColumn("atom_idx", F.row_number().over(order) - 1).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select(
        "structure_id",
        "frame",
        F.when(F.col("l_returnflag") == "N", "solvent").otherwise("protein").alias("kind"),
        (F.col("l_orderkey") % 10).cast("int").alias("res_idx"),
        "atom_idx",
        (F.col("l_quantity") / 20 + F.col("frame") * 0.01).alias("x"),
        (F.col("l_extendedprice") / 50000).alias("y"),
        F.col("l_discount").alias("z"),
        F.when(F.col("l_returnflag") == "A", -F.col("l_tax")).otherwise(F.col("l_tax")).alias("q"),
        (0.25 + F.col("l_linenumber") / 100).alias("sigma"),
        (0.1 + F.col("l_tax")).alias("epsilon"),
    )


ATOMS_SQL = """atoms AS (
  SELECT l_orderkey // 10 AS structure_id, frame, CASE WHEN l_returnflag = 'N' THEN 'solvent' ELSE 'protein' END AS kind,
         CAST(l_orderkey % 10 AS INTEGER) AS res_idx, l_quantity / 20 + frame * 0.01::DOUBLE AS x, l_extendedprice / 50000 AS y, l_discount AS z,
         CASE WHEN l_returnflag = 'A' THEN -l_tax ELSE l_tax END AS q, 0.25::DOUBLE + l_linenumber / 100 AS sigma, 0.1::DOUBLE + l_tax AS epsilon
  FROM lineitem, (SELECT unnest(range(0, 3)) AS frame)),
ap AS (
  SELECT *, CASE WHEN r <= 0.8 THEN -4 * eps * pow(s / r, 6) ELSE 0 END AS vdw_att, CASE WHEN r <= 0.8 THEN 4 * eps * pow(s / r, 12) ELSE 0 END AS vdw_rep,
         138.935456::DOUBLE * qq / r AS es
  FROM (SELECT a.structure_id, a.frame, a.res_idx AS i, b.res_idx AS j, b.kind AS other, (a.sigma + b.sigma) / 2 AS s, sqrt(a.epsilon * b.epsilon) AS eps, a.q * b.q AS qq,
               sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS r
        FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.frame = b.frame AND a.kind = 'protein'
         AND ((b.kind = 'protein' AND a.res_idx < b.res_idx) OR b.kind != 'protein'))),
na AS (SELECT structure_id, frame, res_idx, count(*) AS size FROM atoms WHERE kind = 'protein' GROUP BY ALL),
pe AS (
  SELECT p.structure_id, p.frame, p.i, p.j, sum(vdw_att) / any_value(x.size * y.size) AS vdw_att, sum(vdw_rep) / any_value(x.size * y.size) AS vdw_rep,
         sum(CASE WHEN es > 0 THEN 0 ELSE es END) / any_value(x.size * y.size) AS es_att, sum(CASE WHEN es > 0 THEN es ELSE 0 END) / any_value(x.size * y.size) AS es_rep
  FROM ap p JOIN na x ON x.structure_id = p.structure_id AND x.frame = p.frame AND x.res_idx = p.i
  JOIN na y ON y.structure_id = p.structure_id AND y.frame = p.frame AND y.res_idx = p.j
  WHERE other = 'protein' AND r >= 0.1 GROUP BY 1, 2, 3, 4),
so AS (
  SELECT na.structure_id, na.frame, na.res_idx, coalesce(sum(p.vdw_att + p.vdw_rep) / any_value(size), 0) AS vdw_solv, coalesce(sum(p.es) / any_value(size), 0) AS es_solv
  FROM na LEFT JOIN ap p ON p.structure_id = na.structure_id AND p.frame = na.frame AND p.i = na.res_idx AND p.other != 'protein' AND p.r > 0.1
  GROUP BY 1, 2, 3),
pn AS (
  SELECT pe.structure_id, pe.frame, pe.i, pe.j, vdw_att - (x.vdw_solv + y.vdw_solv) / 2 AS vdw_att, vdw_rep, es_att - (x.es_solv + y.es_solv) / 2 AS es_att, es_rep
  FROM pe JOIN so x ON x.structure_id = pe.structure_id AND x.frame = pe.frame AND x.res_idx = pe.i
  JOIN so y ON y.structure_id = pe.structure_id AND y.frame = pe.frame AND y.res_idx = pe.j)"""


def energy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries: users are runs, event types stages."""
    rows = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    step = F.row_number().over(order)
    stage = F.when(F.col("event_type") == "click", "npt").when(F.col("event_type") == "view", "production").when(F.col("event_type") == "purchase", "nvt").otherwise(F.col("event_type"))
    return rows.select(
        F.col("user_id").alias("run_id"), stage.alias("stage"), step.cast("long").alias("step"), (step * 0.5).cast("double").alias("time_ps"), (F.col("value") * 100 - 4000).alias("energy_kj"), F.lit(100).cast("long").alias("n_atoms")
    )


LOG_SQL = """log AS (
  SELECT user_id AS run_id, CASE event_type WHEN 'click' THEN 'npt' WHEN 'view' THEN 'production' WHEN 'purchase' THEN 'nvt' ELSE event_type END AS stage,
         row_number() OVER o AS step, CAST(row_number() OVER o * 0.5 AS DOUBLE) AS time_ps, value * 100 - 4000 AS energy_kj, 100 AS n_atoms
  FROM events WINDOW o AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as domains: p_partkey, sid, sccs, brand."""
    rows = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    sid = F.concat(F.lit("d"), F.substring(F.md5(key.cast("string")), 1, 4), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz1_"), (key % 28 + 1).cast("int"), F.lit(1)), (key % 7).cast("string"))
    letter = F.substring(F.lit("abcdefgh"), (key % 8 + 1).cast("int"), F.lit(1))
    sccs = F.concat_ws(".", letter, (key % 16).cast("string"), (key % 48).cast("string"), (key % 96).cast("string"))
    return rows.select(key, sid.alias("sid"), sccs.alias("sccs"), F.col("p_brand").alias("brand"))


DOMAINS_SQL = """domains AS (
  SELECT p_partkey, p_brand AS brand,
         'd' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 4) || substr('abcdefghijklmnopqrstuvwxyz1_', CAST(p_partkey % 28 + 1 AS INTEGER), 1) || CAST(p_partkey % 7 AS VARCHAR) AS sid,
         substr('abcdefgh', CAST(p_partkey % 8 + 1 AS INTEGER), 1) || '.' || (p_partkey % 16) || '.' || (p_partkey % 48) || '.' || (p_partkey % 96) AS sccs
  FROM part)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as predictions: the softmax of five times their cosines to the mean vector of each label, against the label's number."""
    from .functions.vectors import cosine, softmax

    rows = table(spark, sf_dir, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("mean"))
    listed = means.agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("means"))  # a row, as many vectors as labels
    scores = F.transform("means", lambda m: F.round(5 * cosine(m["mean"], F.col("embedding")), 6))
    number = (F.array_position(F.transform("means", lambda m: m["label"]), F.col("label")) - 1).cast("int")
    return rows.crossJoin(F.broadcast(listed)).select(F.col("vec_id").alias("id"), number.alias("label"), softmax(scores).alias("probs"))


PREDICTIONS_SQL = """lm AS (
  SELECT label, list(x ORDER BY k) AS mean FROM (
    SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2) GROUP BY 1),
ln AS (SELECT label, mean, row_number() OVER (ORDER BY label) - 1 AS number FROM lm),
p AS (
  SELECT id, label, list_transform(s, lambda x: exp(x) / list_sum(list_transform(s, lambda y: exp(y)))) AS probs, s
  FROM (SELECT e.vec_id AS id, CAST(any_value(own.number) AS INTEGER) AS label, list(round(5 * list_cosine_similarity(ln.mean, CAST(e.embedding AS DOUBLE[])), 6) ORDER BY ln.number) AS s
        FROM embeddings e JOIN ln own ON own.label = e.label, ln GROUP BY e.vec_id)),
c AS (SELECT id, label, list_position(s, list_max(s)) - 1 AS pred FROM p)"""


def whole_files(files: DataFrame, folder: str | None = None) -> str:
    """files(path, value) written below a folder (a new one unless given); the folder."""
    folder = folder or f"{scratch_dir(files.sparkSession)}/files/{uuid.uuid4().hex}"
    write_files(files.select("path", F.col("value").alias("content")), folder)
    return folder


def packed_files(files: DataFrame, folder: str | None = None) -> str:
    """The same as whole_files(), packed: files that are as many as structures."""
    folder = folder or f"{scratch_dir(files.sparkSession)}/packed/{uuid.uuid4().hex}"
    write_packed(files.select("path", F.col("value").alias("content")), folder)
    return folder


def png(height: int, width: int, bgr: bytes) -> bytes:
    """A picture file of rows of blue, green and red bytes."""
    rgb = np.frombuffer(bgr, np.uint8).reshape(height, width, 3)[:, :, ::-1]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], axis=1)
    block = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + block(b"IHDR", head) + block(b"IDAT", zlib.compress(raw.tobytes())) + block(b"IEND", b"")


def picture_files(pictures: DataFrame) -> str:
    """Pictures (path, image) written as PNG files, packed; their folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [png(r["height"], r["width"], r["data"]) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["path", "value"])

    return packed_files(pictures.select("path", "image").mapInArrow(run, "path string, value binary"))


def pixel_digests(variants: DataFrame) -> DataFrame:
    """image_id, feature, n, rgb of variants(image_id, feature, height, width, data): number of pixels and MD5 of their values as text."""

    def digest(data: bytes) -> str:
        blue, green, red = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32).T
        codes, of = np.unique((red << 16) + (green << 8) + blue, return_inverse=True)
        names = [f"{c >> 16},{c >> 8 & 255},{c & 255}" for c in codes.tolist()]
        return hashlib.md5(";".join([names[k] for k in of.tolist()]).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [h * w for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            found = [digest(x.as_py()) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.string())], ["image_id", "feature", "n", "rgb"])

    rows = variants.select("image_id", "feature", "height", "width", "data")
    return rows.mapInArrow(run, f"image_id {dict(rows.dtypes)['image_id']}, feature string, n long, rgb string")


def text_files(lines: DataFrame, column: str = "value") -> str:
    """Lines written as text files to the shared folder; their path."""
    path = f"{scratch_dir(lines.sparkSession)}/text/{uuid.uuid4().hex}"
    lines.select(F.col(column).alias("value")).write.text(path)
    return path

